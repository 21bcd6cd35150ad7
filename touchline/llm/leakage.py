"""Evaluation passages inside training texts, found with a suffix automaton of the passages."""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|<!--.*?-->", re.DOTALL)
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: What counts: a-z, digits, and letters of other scripts. Accented Latin letters don't, since they are what broken encodings break.
_OTHER = re.compile("[^a-z0-9\u0370-\u1dff\u2e80-\ud7ff\uf900-\ufdff\ufe70-\ufefc\U00010000-\U0003ffff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


@dataclass(frozen=True)
class LeakSpec:
    """``min_words`` of a passage in a row are a leak. Shorter matches of at least ``min_chars`` characters that lie in
    one order and place, no more than ``drift`` characters off, are added up; a leak if they cover ``coverage`` of the passage. A
    passage of fewer than ``min_words`` words has to be there whole. Passages are split into shards of about ``shard_chars``
    characters, one automaton and one pass over the texts each, so what a worker holds is bounded however many there are."""

    min_words: int = 13
    min_chars: int = 18
    coverage: float = 0.4
    drift: int = 48
    shard_chars: int = 400_000


def squeeze(text: str) -> str:
    """Letters and digits only, lower case: case, punctuation, markup, spacing and line breaks vanish."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _OTHER.sub("", text.lower())


def words(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    text = _TAG.sub("", text)
    return [w for w in (_OTHER.sub("", w) for w in unicodedata.normalize("NFKC", text).lower().split()) if w]


def squeeze_with_places(text: str) -> tuple[str, list[int], list[int]]:
    """The squeezed text and, for each of its characters, where what it came from begins and ends in ``text``."""
    chars: list[tuple[str, int, int]] = []
    at = 0
    for m in _ENTITY.finditer(text):
        if (said := html.unescape(m[0])) == m[0]:
            continue
        chars += [(c, i, i + 1) for i, c in enumerate(text[at : m.start()], at)] + [(c, m.start(), m.end()) for c in said]
        at = m.end()
    chars += [(c, i, i + 1) for i, c in enumerate(text[at:], at)]
    plain = "".join(c for c, _, _ in chars)
    drop = [m.span() for m in _TAG.finditer(plain)]
    for a, b in reversed(drop):
        del chars[a:b]
    out, start, end, k = [], [], [], 0
    while k < len(chars):
        to = k + 1
        while to < len(chars) and unicodedata.combining(chars[to][0]):  # a letter and its marks are normalised together
            to += 1
        for c in _OTHER.sub("", unicodedata.normalize("NFKC", "".join(c for c, _, _ in chars[k:to])).lower()):
            out.append(c)
            start.append(chars[k][1])
            end.append(chars[to - 1][2])
        k = to
    return "".join(out), start, end


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(code: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of the ``m`` codes from each position on, the same wherever they stand."""
    if len(code) < m:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(code) - 1, b, dtype=np.uint64)], dtype=np.uint64) for b in (_BASE, _BACK))
        total = np.r_[np.uint64(0), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)]
        h = (total[m:] - total[:-m]) * back[: len(code) - m + 1]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Automaton:
    """Generalised suffix automaton of some passages, with sparse transitions, and where each piece of ``min_chars`` characters stands in them.

    ``code1`` and ``next1`` hold a state's first transition, ``more`` all others; ``home`` is the state on its suffix path that stands for the last
    ``min_chars`` characters (-1 where it has fewer), ``post_*`` the passages and end positions of every such state.
    """

    def __init__(self, items: list[tuple[int, str]], spec: LeakSpec = LeakSpec()):
        self.spec, self.ids = spec, [i for i, _ in items]
        texts = [words(p or "") for _, p in items]
        self.lengths = np.array([sum(map(len, t)) for t in texts], dtype=np.int64)
        # starts of words in each passage's squeezed text, and its end
        self.starts = [np.cumsum([0, *map(len, t)]) for t in texts]
        self.flat = ["".join(t) for t in texts]
        self._build()
        self._prefilter()

    def _build(self) -> None:
        step: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def clone(p: int, c: int, q: int) -> int:
            new = len(step)
            step.append(step[q].copy())
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = new
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = new
                p = link[p]
            return new

        seen: list[tuple[int, int, int]] = []  # state, passage, characters of it read so far
        for k, text in enumerate(self.flat):
            last = 0
            for j, c in enumerate(codes(text).tolist(), 1):
                q = step[last].get(c, -1)
                if q >= 0:
                    last = q if length[q] == length[last] + 1 else clone(last, c, q)
                else:
                    new = len(step)
                    step.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    p = last
                    while p >= 0 and c not in step[p]:
                        step[p][c] = new
                        p = link[p]
                    if p >= 0:
                        q = step[p][c]
                        link[new] = q if length[q] == length[p] + 1 else clone(p, c, q)
                    last = new
                if j >= self.spec.min_chars:
                    seen.append((last, k, j))
        n = len(step)
        self.link, self.length = np.array(link, dtype=np.int32), np.array(length, dtype=np.int32)
        self.code1, self.next1 = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        key, to = array("q"), array("i")
        for s, out in enumerate(step):
            for i, (c, q) in enumerate(out.items()):
                if i:
                    key.append((s << 21) | c)
                    to.append(q)
                else:
                    self.code1[s], self.next1[s] = c, q
        self.more_key, self.more_to = np.array(key, dtype=np.int64), np.array(to, dtype=np.int32)
        self.home = np.full(n, -1, dtype=np.int32)
        for s in np.argsort(self.length, kind="stable"):
            if self.length[s] >= self.spec.min_chars:
                up = self.home[self.link[s]]
                self.home[s] = s if up < 0 else up
        state, item, end = (np.array(x, dtype=np.int64) for x in zip(*seen)) if seen else (np.zeros(0, np.int64),) * 3
        at = self.home[state].astype(np.int64)
        order = np.lexsort((end, item, at))
        self.post_key = at[order] * len(self.flat) + item[order]  # sorted
        self.post_item, self.post_end = item[order].astype(np.int32), end[order].astype(np.int32)

    def _prefilter(self) -> None:
        """Hashes of all pieces of ``min_chars`` characters, the passages that hold each, and how many of a passage's a text must have at least to hold a leak."""
        m = self.spec.min_chars
        grams, items, least, runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
        for k, text in enumerate(self.flat):
            h = gram_hashes(codes(text), m)
            grams.append(h)
            items.append(np.full(len(h), k, dtype=np.int64))
            w, s = min(self.spec.min_words, len(self.starts[k]) - 1), self.starts[k]
            runs.append(max(m, int(np.min(s[w:] - s[:-w])) if w else m))
            # what is covered has at most m characters a piece; a piece counts as often as it stands in the passage
            least.append(max(1, min(runs[-1] - m + 1, math.ceil(self.spec.coverage * self.lengths[k] / m))))
        self.least, self.runs = np.array(least, dtype=np.int64), np.array(runs, dtype=np.int64)
        gram, item = np.concatenate(grams), np.concatenate(items)
        at = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.lexsort((item, gram))
        self.grams, self.gram_start = np.unique(gram[order], return_index=True)
        self.gram_start = np.r_[self.gram_start, len(gram)]
        self.gram_item, self.gram_at = item[order].astype(np.int32), at[order].astype(np.int32)
        self.bits = max(10, int(np.ceil(np.log2(16 * max(1, len(self.grams))))))
        self._sift()

    def _sift(self) -> None:
        self.sieve = np.zeros(2**self.bits, dtype=bool)
        self.sieve[self.grams >> np.uint64(64 - self.bits)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_fast", "sieve")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._sift()

    @property
    def fast(self) -> tuple:
        """The arrays as Python sees them fastest."""
        if "_fast" not in self.__dict__:
            more = dict(zip(self.more_key.tolist(), self.more_to.tolist()))
            self._fast = tuple(array("i", x.tobytes()) for x in (self.code1, self.next1, self.link, self.length)) + (more,)
        return self._fast

    def candidates(self, texts: list[str], most: int = 4_000_000) -> np.ndarray:
        """Positions of those squeezed texts that have enough of some passage. Exact: a text left out holds no leak.

        About ``most`` (piece, passage) pairs are counted at a time; a text that has more by itself is taken uncounted.
        """
        m = self.spec.min_chars
        size = np.array([len(t) for t in texts], dtype=np.int64)
        h = gram_hashes(codes("".join(texts)), m)
        if not len(h) or not len(self.grams):
            return np.zeros(0, dtype=np.int64)
        hit = np.flatnonzero(self.sieve[h >> np.uint64(64 - self.bits)])
        gram = np.minimum(np.searchsorted(self.grams, h[hit]), len(self.grams) - 1)
        true = self.grams[gram] == h[hit]
        hit, gram = hit[true], gram[true]
        end = np.cumsum(size)
        of = np.searchsorted(end, hit, side="right")
        inside = hit + m <= end[of]  # not over the border of two texts
        of, gram, hit = of[inside], gram[inside], hit[inside]
        lo, c = self.gram_start[gram], self.gram_start[gram + 1] - self.gram_start[gram]
        pairs = np.bincount(of, weights=c, minlength=len(texts))
        out = [np.flatnonzero(pairs > most)]
        portion = np.cumsum(np.where(pairs > most, 0, pairs)) // most
        for q in np.unique(portion[(pairs > 0) & (pairs <= most)]):
            mine = (portion[of] == q) & (pairs[of] <= most)
            out.append(self._enough(of[mine], hit[mine], lo[mine], c[mine]))
        return np.unique(np.concatenate(out))

    def _enough(self, of: np.ndarray, hit: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Texts in which some passage's stretches are together, or one of them alone, long enough for a leak. Rows are hits of text ``of`` at ``hit``, with their entries."""
        m, count = self.spec.min_chars, len(self.flat)
        place = np.repeat(lo - np.cumsum(c) + c, c) + np.arange(c.sum())
        _, pair, times = np.unique(np.repeat(of, c) * count + self.gram_item[place], return_inverse=True, return_counts=True)
        kept = (times[pair] >= self.least[self.gram_item[place]])
        if not kept.any():
            return np.zeros(0, dtype=np.int64)
        place, pair, x, text = place[kept], pair[kept], np.repeat(hit, c)[kept], np.repeat(of, c)[kept]
        shift = x - self.gram_at[place]
        order = np.lexsort((x, shift, pair))
        pair, x, shift, item, text = pair[order], x[order], shift[order], self.gram_item[place][order], text[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1]) | (x[1:] != x[:-1] + 1)])
        n = np.diff(np.r_[first, len(x)]) + m - 1
        owner = np.flatnonzero(np.r_[True, pair[first][1:] != pair[first][:-1]])
        whole, longest, k = np.add.reduceat(n, owner), np.maximum.reduceat(n, owner), item[first[owner]]
        return text[first[owner]][(whole >= self.spec.coverage * self.lengths[k]) | (longest >= self.runs[k])]

    def lengths_at(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The longest piece of any passage that ends at each position of ``text``, and the automaton's state there."""
        code1, next1, link, length, more = self.fast
        state, n = 0, 0
        longest, states = array("i"), array("i")
        for c in codes(text).tolist():
            while True:
                if code1[state] == c:
                    state = next1[state]
                    n += 1
                    break
                if (q := more.get((state << 21) | c)) is not None:
                    state = q
                    n += 1
                    break
                if not state:
                    n = 0
                    break
                state = link[state]
                n = length[state]
            longest.append(n)
            states.append(state)
        return np.array(longest, dtype=np.int64), np.array(states, dtype=np.int64)

    def spans(self, text: str, enough: bool = False, most: int = 4_000_000) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Per passage all its maximal stretches of at least ``min_chars`` characters in ``text``, as (place in text, place in passage, length).

        A passage's stretches don't depend on the others: every place whose longest match is long enough is looked up in all passages
        that hold its last ``min_chars`` characters, and neighbours along a diagonal are joined. About ``most`` places are held at a time.
        With ``enough``, passages of which there is too little for a leak are left out.
        """
        m = self.spec.min_chars
        longest, states = self.lengths_at(text)
        at = np.flatnonzero(longest >= m)
        home, count = self.home[states[at]].astype(np.int64), len(self.flat)
        whole = np.searchsorted(self.post_key, (home + 1) * count) - np.searchsorted(self.post_key, home * count)
        parts = min(count, 1 + int(whole.sum()) // most)
        for part in range(parts):
            a, b = part * count // parts, (part + 1) * count // parts
            lo, hi = np.searchsorted(self.post_key, home * count + a), np.searchsorted(self.post_key, home * count + b)
            c = hi - lo
            if not c.sum():
                continue
            place = np.repeat(lo - np.cumsum(c) + c, c) + np.arange(c.sum())
            item, j, e = self.post_item[place].astype(np.int64), self.post_end[place].astype(np.int64), np.repeat(at + 1, c)
            if enough:
                mine = (np.bincount(item, minlength=count) >= self.least)[item]
                item, j, e = item[mine], j[mine], e[mine]
                if not len(item):
                    continue
            order = np.lexsort((e, e - j, item))
            item, j, e = item[order], j[order], e[order]
            first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (e[1:] - j[1:] != e[:-1] - j[:-1]) | (e[1:] != e[:-1] + 1)])
            n = np.diff(np.r_[first, len(item)]) + m - 1
            owner = np.flatnonzero(np.r_[True, item[first][1:] != item[first][:-1]])
            last = np.r_[owner[1:], len(first)]
            if enough:
                k = item[first[owner]]
                held = (np.add.reduceat(n, owner) >= self.spec.coverage * self.lengths[k]) | (np.maximum.reduceat(n, owner) >= self.runs[k])
                owner, last = owner[held], last[held]
            for x, y in zip(owner, last):
                yield int(item[first[x]]), list(zip((e[first[x:y]] - m).tolist(), (j[first[x:y]] - m).tolist(), n[x:y].tolist()))

    def leaked(self, text: str) -> dict[int, tuple[int, float, list[tuple[int, int]]]]:
        """Passages that leaked into the squeezed ``text``: the most words in a row, the greatest share covered, and the stretches of ``text`` concerned."""
        out = {}
        for k, spans in self.spans(text, enough=True):
            run, share, where = self._score(k, spans)
            if where:
                out[self.ids[k]] = (run, share, where)
        return out

    def _score(self, k: int, spans: list[tuple[int, int, int]]) -> tuple[int, float, list[tuple[int, int]]]:
        starts, size, spec = self.starts[k], int(self.lengths[k]), self.spec
        at, n = np.array([s[1] for s in spans]), np.array([s[2] for s in spans])
        runs = np.searchsorted(starts, at + n, side="right") - 1 - np.searchsorted(starts, at, side="left")
        least = min(spec.min_words, len(starts) - 1)
        where = [(d, d + c) for (d, _, c), r in zip(spans, runs.tolist()) if r >= least]
        run = max(0, int(runs.max()))
        if n.sum() < spec.coverage * size:
            return run, 0.0, where
        best, part, held = 0, [], []
        # neighbours along a diagonal, that is, with the same shift from passage to text
        for d, a, c in [*sorted(spans, key=lambda x: (x[0] - x[1], x[1])), (math.inf, 0, 0)]:
            if part and d - a - part[-1][0] > spec.drift // 4:
                if (got := _covered(part)) > best:
                    best, held = got, part
                part = []
            part.append((d - a, a, c))
        if best >= spec.coverage * size:
            where.append((min(p[0] + p[1] for p in held), max(p[0] + p[1] + p[2] for p in held)))
        return run, best / size, where


def _covered(part: list[tuple[int, int, int]]) -> int:
    total, upto = 0, 0
    for _, at, n in sorted(part, key=lambda x: x[1]):
        total += max(0, at + n - max(at, upto))
        upto = max(upto, at + n)
    return total


def _shards(items: DataFrame, item: str, passage: str, spec: LeakSpec) -> list:
    """Broadcast automata, one a shard. They are built by executors, one at a time is brought to the driver, and each has at most about
    ``spec.shard_chars`` characters (or one longer passage)."""
    spark = items.sparkSession
    kept = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).filter("i is not null and p is not null").dropDuplicates()
    size = F.length("p").cast("long")
    n = max(1, -(-(kept.agg(F.sum(size)).first()[0] or 0) // spec.shard_chars))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        held = sorted((i, p) for i, p in zip(pdf["i"].tolist(), pdf["p"]) if words(p))
        return pd.DataFrame({"blob": [pickle.dumps(Automaton(held, spec))] if held else []})

    # a passage's deliveries stay together; the shards differ in size as hashes do
    built = kept.withColumn("shard", F.pmod(F.xxhash64("i"), F.lit(n))).groupBy("shard").applyInPandas(build, "blob binary")
    built = materialise(built.withColumn("shard", F.monotonically_increasing_id()), "automata")
    out = []
    for row in built.select("shard").collect():  # one number a shard
        blob = built.filter(F.col("shard") == row["shard"]).select("blob").first()["blob"]
        out.append(spark.sparkContext.broadcast(pickle.loads(bytes(blob))))
    return out


def _scan(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, passage: str, spec: LeakSpec, places: bool) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"d {kind[0]}, i {kind[1]}, words_in_row int, coverage double, spans array<struct<a: int, b: int>>"
    texts = docs.filter(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t"))

    def scanner(shared):  # noqa: ANN001, ANN202
        def scan(batches):  # noqa: ANN001
            automaton = shared.value
            for pdf in batches:
                out = []
                for part in range(0, len(pdf), 200):  # few texts at a time, however long they are
                    held, docs_ = pdf["t"].iloc[part : part + 200].tolist(), pdf["d"].iloc[part : part + 200].tolist()
                    plain = [squeeze(t) for t in held]
                    for k in automaton.candidates(plain).tolist():
                        if places:
                            t, start, end = squeeze_with_places(held[k])
                            found = automaton.leaked(t)
                        else:
                            found, start, end = automaton.leaked(plain[k]), None, None
                        for i, (run, share, where) in found.items():
                            out.append((docs_[k], i, run, share, [(start[a], end[b - 1]) for a, b in where] if places else []))
                yield pd.DataFrame(out, columns=["d", "i", "words_in_row", "coverage", "spans"])

        return scan

    parts = [texts.mapInPandas(scanner(shared), schema) for shared in _shards(items, item, passage, spec)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def find_leaks(docs: DataFrame, items: DataFrame, *, doc: str, text: str, item: str, passage: str, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """The passages of ``items`` that stand wholly or in part in the texts of ``docs``.

    Columns: doc, item, words_in_row (longest stretch of whole words), coverage (share of the passage found in its
    order; 0 where it plays no part). One row a pair; it doesn't depend on what other passages there are. Null or empty texts and passages match
    nothing, nor do passages of fewer than ``spec.min_chars`` letters and digits; repeated rows of one document or item count once; no items or no documents give no
    rows; extra columns are ignored. Letters are a-z and those of other scripts; accented Latin ones are left out on both sides.

    Whole texts are read once per shard of the passages (one, up to ``spec.shard_chars`` characters), without a shuffle. Hashes of all pieces of
    ``spec.min_chars`` characters tell exactly which texts hold too few pieces of passages for a leak; the others are streamed
    through a suffix automaton of the passages, which tracks the longest match at every character.
    """
    found = _scan(docs, items, doc, text, item, passage, spec, places=False)
    return found.groupBy(F.col("d").alias(doc), F.col("i").alias(item)).agg(F.max("words_in_row").alias("words_in_row"), F.max("coverage").alias("coverage"))


def leak_spans(docs: DataFrame, items: DataFrame, *, doc: str, text: str, item: str, passage: str, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """Where the passages found by ``find_leaks`` stand: doc, item, start and end (code points of the text as it is), one row a stretch.

    A stretch found by its words is as long as they are; one found by coverage goes from its first match to its last.
    """
    found = _scan(docs, items, doc, text, item, passage, spec, places=True)
    return found.select(F.col("d").alias(doc), F.col("i").alias(item), F.inline("spans").alias("start", "end")).distinct()


def remove_leaks(docs: DataFrame, items: DataFrame, *, doc: str, text: str, item: str, passage: str, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """``docs`` with every leaked stretch cut out of ``text`` (a blank stands in its place) and ``removed_chars``; other columns and null texts stay.

    ``doc`` has to name a text: rows of one doc with different texts get the stretches of each. Documents without leaks aren't touched.
    """
    spans = leak_spans(docs, items, doc=doc, text=text, item=item, passage=passage, spec=spec)
    per_doc = spans.groupBy(F.col(doc).alias("_d")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))

    @F.pandas_udf("struct<t: string, n: int>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, where in zip(texts, spans):
            if t is None or where is None:
                out.append((t, 0))
                continue
            kept, at, gone = [], 0, 0
            for s in where:
                a, b = max(s["start"], at), min(s["end"], len(t))
                if b > a:
                    kept.append(t[at:a])
                    at, gone = b, gone + b - a
            out.append((" ".join([*kept, t[at:]]), gone))
        return pd.DataFrame(out, columns=["t", "n"])

    out = docs.join(per_doc, docs[doc] == per_doc["_d"], "left").withColumn("_cut", cut(F.col(text), F.col("_spans")))
    return out.withColumns({text: F.col("_cut.t"), "removed_chars": F.col("_cut.n")}).drop("_d", "_spans", "_cut")
