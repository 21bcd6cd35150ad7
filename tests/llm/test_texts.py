"""Leakage, mixtures and subjects."""

import random

import pytest

from touchline.llm.leakage import Automaton, LeakSpec, find_leaks, leak_spans, remove_leaks, squeeze, squeeze_with_places
from touchline.llm.mixture import budgets, mix, token_counter
from touchline.llm.subjects import SubjectSpec, sentences, tag_subjects, units

WORDS = [a + b for a in ("kar", "mol", "vis", "ten", "lun", "dra", "fos") for b in ("ba", "del", "ip", "mont", "o", "ush", "zan", "ek")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_spans(t, p, m):
    """Maximal common stretches, place by place."""
    out = []
    for d in range(-len(p), len(t) + 1):
        run = 0
        for j in range(len(p) + 1):
            i = d + j
            if j < len(p) and 0 <= i < len(t) and t[i] == p[j]:
                run += 1
            else:
                if run >= m:
                    out.append((i - run, j - run, run))
                run = 0
    return sorted(out)


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    spec = LeakSpec(min_chars=5)
    a = Automaton([(i, text(rng, 20)) for i in range(6)] + [(9, ""), (10, "??"), (11, text(rng, 3) + " " + "ab " * 20)], spec)
    for n in range(20):
        t = squeeze(text(rng, 25) + ("abab" * 4 if n % 2 else ""))
        longest = [max(n for n in range(e + 1) if any(t[e - n : e] in p for p in a.flat)) for e in range(1, len(t) + 1)]
        assert a.lengths_at(t)[0].tolist() == longest
        want = {k: s for k, p in enumerate(a.flat) if (s := brute_spans(t, p, 5))}
        assert {k: sorted(s) for k, s in a.spans(t)} == want
        assert {k: sorted(s) for k, s in a.spans(t, most=50)} == want
        assert (0 in a.candidates([t])) or not a.leaked(t)


def test_automaton_of_very_long_passages():
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(65_600))
    a = Automaton([(1, long + "x" * 20), (2, "q" + long + "z" * 20)])
    t = "q" + long + "x" * 20
    assert {k: run for k, (run, _, _) in a.leaked(t).items()} == {1: 1, 2: 0}


def test_passages_do_not_hide_each_other(spark):
    rng = random.Random(11)
    pieces = [[text(rng, 9) for _ in range(6)] for _ in range(1)][0]
    one, two = (" ".join(f"{p} {text(rng, 2)}" for p in pieces) for _ in range(2))
    doc = f"{text(rng, 60)} {one} {text(rng, 60)}"
    items = [(1, one, ""), (2, two, ""), *[(i, text(rng, 40), "") for i in range(3, 30)]]
    alone = {x for i in items for x in leaks(spark, [(1, doc, "")], [i])}
    assert alone == {(1, 1), (1, 2)} == leaks(spark, [(1, doc, "")], items) == leaks(spark, [(1, doc, "")], items, spec=LeakSpec(shard_chars=2000))


def test_other_scripts_and_removal(spark):
    rng = random.Random(3)
    cyrillic = " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(7)) for _ in range(40))
    latin = text(rng, 40)
    dirty = f"{text(rng, 30)} <b>&quot;{latin[:100]}</b>&amp;{latin[100:]}&#33; {text(rng, 20)}"
    docs = [(1, f"caf\u0065\u0301 {cyrillic.upper()} fin", "c"), (2, dirty, "c"), (3, text(rng, 200), "c"), (4, None, "c"), (5, "", "c"), (2, dirty, "c")]
    items = [(1, cyrillic, ""), (2, latin, "")]
    assert leaks(spark, docs, items) == {(1, 1), (2, 2)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, passage string, text string")
    names = {"doc": "doc_id", "text": "text", "item": "item_id", "passage": "passage"}
    spans = {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in leak_spans(d, i, **names).collect()}
    at = dirty.index(latin[:20])
    assert (1, 1, 6, 6 + len(cyrillic)) in spans and (2, 2, at, dirty.index("&#33;")) in spans
    out = [tuple(r) for r in remove_leaks(d, i, **names).orderBy("doc_id").collect()]
    assert [r[0] for r in out] == [1, 2, 2, 3, 4, 5] and [r[3] for r in out] == [len(cyrillic), dirty.index("&#33;") - at, dirty.index("&#33;") - at, 0, 0, 0]
    assert out[0][1] == "caf\u0065\u0301   fin" and out[3][1] == docs[2][1] and out[4][1] is None
    for t in (dirty, docs[0][1], "a&nosuch;b <i\nx>c &lt;b&gt; \uff21\uff22 \ufb01"):
        assert squeeze_with_places(t)[0] == squeeze(t)


def leaks(spark, docs, items, **kw):
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, passage string, text string")
    return {(r["doc_id"], r["item_id"]) for r in find_leaks(d, i, doc="doc_id", text="text", item="item_id", passage="passage", **kw).collect()}


def test_leaks_whole_partial_broken_and_altered(spark):
    rng = random.Random(2)
    items = [(i, text(rng, 60), "x") for i in range(5)]
    p = [x[1].split() for x in items]
    shared = " ".join(p[0][10:40])
    items.append((7, f"{text(rng, 20)} {shared} {text(rng, 20)}", "x"))
    altered = [w if k % 8 else "changed" for k, w in enumerate(p[3])]
    cut = items[1][1][:120] + "\n" + items[1][1][120:]
    docs = [
        (1, f"{text(rng, 50)} <b>{items[0][1].upper()}</b>, {text(rng, 30)}", "c"),
        (2, f"{text(rng, 50)}\n{cut}", "c"),
        (3, f"{text(rng, 50)} " + " ".join(p[2][20:36]) + f" {text(rng, 50)}", "c"),
        (4, f"{text(rng, 50)} " + " ".join(p[2][20:29]) + f" {text(rng, 50)}", "c"),  # nine words are too few
        (5, " ".join(altered), "c"),
        (6, " ".join(p[4][30:] + p[4][:30]), "c"),
        (7, "", "c"), (8, None, "c"), (9, text(rng, 400), "c"),
    ]
    docs.append(docs[0])
    want = {(1, 0), (1, 7), (2, 1), (3, 2), (5, 3), (6, 4)}
    assert leaks(spark, docs, items + [(None, "a b", ""), (8, None, ""), (11, "", "")]) == want


def test_leaks_empty(spark):
    assert leaks(spark, [], [(1, "a b c", "")]) == set()
    assert leaks(spark, [(1, "a b c", "")], []) == set()
    short = "alpha beta gamma delta"  # has to be there whole
    docs = [(1, f"so {short.upper()}!", ""), (2, "alpha beta gamma dexta", ""), (3, "a b c", "")]
    assert leaks(spark, docs, [(1, short, ""), (2, "...", ""), (3, "a b c", "")]) == {(1, 1)}  # three letters say nothing


def test_budgets():
    aims = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 1)]
    got = budgets(aims, {"a": 1000, "b": 100, "c": 1000})
    assert got["b"] == pytest.approx(200) and got["a"] == pytest.approx(200 / 0.3 * 0.5) and got["c"] == pytest.approx(200 / 0.3 * 0.2)
    got = budgets(aims, {"a": 1000, "b": 100, "c": 1000}, total=1500)
    assert got["b"] == 200 and got["a"] + got["c"] == pytest.approx(1300)
    assert budgets(aims, {}) == {"a": 0, "b": 0, "c": 0, "none": 0}


def test_mixture_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    docs = [(i, "big" if i % 3 == 0 else rng.choice(["mid", "small", None, "other"]), rng.randrange(0, 60), "clash") for i in range(9000)]
    targets = [("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 3), ("gone", 0.1, 4), (None, 0.0, 1)]
    d, t = spark.createDataFrame(docs, "doc long, source string, n long, copies string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    for total in (None, 400_000, 30_000):
        mixture, report = mix(d, t, doc="doc", source=F.col("source"), tokens=F.col("n"), total=total)
        rows, rep = mixture.collect(), {r["source"]: r for r in report.collect()}
        size = {s: sum(n for _, x, n, _ in docs if x == s) for s in ("big", "mid", "small")}
        want = budgets([x for x in targets if x[0]], size, total)
        most = {s: r for s, _, r in targets}
        for s in size:
            mine = [r for r in rows if r["source"] == s]
            used = sum(r["tokens"] * r["copies"] for r in mine)
            assert abs(used - want[s]) <= 60 and used == rep[s]["used_tokens"]
            assert max(r["copies"] for r in mine) <= most[s]
            assert max(r["copies"] for r in mine) - min([r["copies"] for r in mine] + [0] * (len(mine) < sum(1 for x in docs if x[1] == s and x[2] > 0))) <= 1
        assert rep["gone"]["used_tokens"] == 0 and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    empty = mix(d.limit(0), t, doc="doc", source=F.col("source"), tokens=F.col("n"))
    assert empty[0].count() == 0 and all(r["used_tokens"] == 0 for r in empty[1].collect())


def test_token_counter(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("a" * 20_000,)], "t string")
    got = [r[0] for r in df.select(token_counter()(F.col("t"))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1000


def test_sentences():
    assert len(sentences("One here. Two there!\n- three\n- four\nwrapped\nline goes on. <p>Six.</p><p>Seven</p>")) == 6
    assert [len(u) for u in units(" ".join(["word"] * 45) + ". Two here.", 22)] == [15, 15, 15, 2]
    assert sentences("") == [] and sentences("... 12%") == [["0"]]


def corpus(rng, n):
    """Documents of one or two subjects with filler, terms known only to the generator."""
    terms = {s: [f"{s}term{k}" for k in range(6)] for s in ("law", "sport", "tech")}
    docs, truth = [], []
    for i in range(n):
        subjects = rng.sample(sorted(terms), rng.choice([0, 1, 1, 2]))
        parts = [f"Please see the {rng.choice(['folder', 'list', 'board'])} by {rng.choice(['noon', 'monday'])}." for _ in range(4)]
        for s in subjects:
            parts += [f"The {rng.choice(terms[s])} was {rng.choice(['seen', 'noted', 'moved'])} with the {rng.choice(terms[s])} today." for _ in range(rng.choice([3, 4, 6]))]
        other = rng.choice([s for s in terms if s not in subjects])
        if rng.random() < 0.3:
            parts.append(f"Someone asked about the {rng.choice(terms[other])}.")
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "x"))
        truth.append(set(subjects))
    return docs, truth


def test_subjects_held_out(spark):
    rng = random.Random(9)
    docs, truth = corpus(rng, 900)
    labels = []
    for i in range(0, 900, 3):
        for s in truth[i]:
            if rng.random() < 0.9:
                labels.append((i, s.upper() + " ", "a"))
        if rng.random() < 0.1:
            labels.append((i, rng.choice(["law", "sport", "nonsense", None]), "b"))
    docs += [(1000, "", "x"), (1001, None, "x")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string, text string")
    areas = spark.createDataFrame([("law", ""), ("sport", ""), ("tech", "")], "subject string, description string")
    got = {(r["doc_id"], r["subject"]) for r in tag_subjects(d, lab, areas, doc="doc_id", text="text", subject="subject").collect()}
    want = {(i, s) for i, t in enumerate(truth) for s in t}
    held = lambda pairs: {p for p in pairs if p[0] % 3}
    hit = len(held(got) & held(want))
    assert hit / len(held(got)) > 0.97 and hit / len(held(want)) > 0.97
    few = tag_subjects(d, lab, areas, doc="doc_id", text="text", subject="subject", spec=SubjectSpec(max_train=50))
    assert few.count() > 0
    assert tag_subjects(d, lab.limit(0), areas, doc="doc_id", text="text", subject="subject").count() == 0
    assert tag_subjects(d, lab, areas.limit(0), doc="doc_id", text="text", subject="subject").count() == 0
    assert tag_subjects(d.limit(0), lab, areas, doc="doc_id", text="text", subject="subject").count() == 0


def test_subjects_named_in_any_spelling(spark):
    docs, truth = corpus(random.Random(3), 300)
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    plain, odd = {"law": "match_law", "sport": "sport", "tech": "tech"}, {"law": "Match Law", "sport": "sport ", "tech": "TECH"}
    lab = spark.createDataFrame([(i, plain[s]) for i, t in enumerate(truth) for s in t], "doc_id long, subject string")
    tags = lambda names, **kw: {(r["doc_id"], r["subject"]) for r in tag_subjects(d, lab, spark.createDataFrame([(n,) for n in names], "subject string"), doc="doc_id", text="text", subject="subject", spec=SubjectSpec(**kw)).collect()}
    found, spelled = tags(plain.values()), tags([*odd.values(), "match-law"])
    assert len(found) > 100 and spelled == {(i, {v: odd[k] for k, v in plain.items()}[s]) for i, s in found}
    with pytest.raises(ValueError):
        tags(plain.values(), max_areas=2)
