"""Subject areas of documents, by interpolated n-gram language models of every subject."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h\d|td|tr|table)\b[^<>]{0,300}>", re.IGNORECASE)
_BREAK = re.compile(r"<br\b[^<>]{0,300}>", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_QUOTE = re.compile(r"(?m)^[ \t]*>+[ \t]?")
_HEADING = re.compile(r"(?m)^(\s*#.*)$")
_END = re.compile(r"(?<=[.!?…])[\s\"”»)]+|\n\s*\n|\n(?=\s*(?:[-*#•]|\d+[.)]))|(?<=[.!?:])\n")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")


@dataclass(frozen=True)
class SubjectSpec:
    """``max_train`` labelled documents and ``max_chars`` characters of them at most fit the models (a hash-random sample of whole texts); everything else
    covers all documents. Texts are judged in units: sentences, those of more than ``unit`` words in equal parts. ``min_units`` units make a subject. A token's
    log ratio counts from ``low`` to ``high``; ``filler`` is the part of a unit's likeness to subjectless ones that is taken off. ``thresholds`` are the
    evidences (nats: the difference of cross-entropies a token times the tokens) tried for a unit; each subject takes the one that agrees best with the labels of documents its models haven't
    seen (``folds`` of them in turn)."""

    max_train: int = 12_000
    max_chars: int = 200_000_000
    max_areas: int = 10_000
    min_units: int = 3
    unit: int = 22
    passes: int = 4
    folds: int = 2
    cap: int = 1
    filler: float = 0.3
    prior: float = 300.0
    context: float = 5.0
    low: float = -0.5
    high: float = 3.0
    unlabelled: float = -1e9
    thresholds: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
    default: float = 2.0
    seed: int = field(default=17)


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of every sentence; numbers are one word, line breaks end no sentence by themselves."""
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub("\n", _BLOCK.sub("\n\n", text)))
    if ">" in text:
        text = _QUOTE.sub("", text)
    if "#" in text:
        text = _HEADING.sub(r"\1\n", text)
    out = []
    for part in _END.split(text):
        if part and (w := ["0" if x[0].isdigit() else x for x in _TOKEN.findall(part.lower())]):
            out.append(w)
    return out


def units(text: str, longest: int) -> list[list[str]]:
    """The sentences of a text, long ones in equal parts of at most ``longest`` words."""
    out = []
    for s in sentences(text):
        parts = -(-len(s) // longest)
        out += [s[i * len(s) // parts : (i + 1) * len(s) // parts] for i in range(parts)]
    return out


@dataclass
class Corpus:
    """Units as one array of word numbers, with the previous word of each."""

    word: np.ndarray
    prev: np.ndarray
    sentence: np.ndarray  # where each unit begins in ``word``
    doc: np.ndarray  # the document of each unit
    size: np.ndarray  # words of each unit


class Speller:
    """Numbers of words. A word of five letters or more that is one slip (a letter too many, too few, wrong or two swapped)
    off a known one counts as that; otherwise unknown words are number 0."""

    def __init__(self, vocabulary: dict[str, int], most: int = 500_000):
        self.known, self.most = dict(vocabulary), most
        self.near: dict[str, int] = {}
        for w, n in vocabulary.items():
            if len(w) >= 5:
                for v in (w, *self._shorter(w)):
                    self.near.setdefault(v, n)

    @staticmethod
    def _shorter(w: str) -> list[str]:
        return [w[:i] + w[i + 1 :] for i in range(len(w))]

    def __call__(self, w: str) -> int:
        n = self.known.get(w)
        if n is None:
            n = 0
            if len(w) >= 5:
                n = next((self.near[v] for v in (w, *self._shorter(w)) if v in self.near), 0)
            if len(self.known) < self.most:
                self.known[w] = n
        return n


def encode(texts: list[str | None], number: Speller, longest: int) -> Corpus:
    """Unknown words are number 0, the beginning of a unit is number 1."""
    word: list[int] = []
    sentence, doc, size = [], [], []
    for d, text in enumerate(texts):
        if not text:
            continue
        for s in units(text, longest):
            sentence.append(len(word))
            doc.append(d)
            size.append(len(s))
            word.extend([number(w) for w in s])
    w = np.array(word, dtype=np.int64)
    prev = np.r_[1, w[:-1]] if len(w) else w
    start = np.array(sentence, dtype=np.int64)
    prev[start] = 1
    return Corpus(w, prev, start, np.array(doc, dtype=np.int64), np.array(size, dtype=np.int64))


class SubjectModels:
    """Interpolated bigram models: of each subject, and of all that isn't it as its background.

    A document counts a word or bigram ``cap`` times at most, so a long one weighs little more than a short one. A bigram is interpolated
    with the word, the word with the whole sample. ``gain`` is a word's log ratio of both models.
    """

    def __init__(self, subjects: list[str], vocabulary: dict[str, int], spec: SubjectSpec):
        self.subjects, self.vocabulary, self.spec = subjects, vocabulary, spec
        self.threshold = np.full(len(subjects), spec.default)
        self._speller: Speller | None = None

    @property
    def speller(self) -> Speller:
        if self._speller is None:
            self._speller = Speller(self.vocabulary)
        return self._speller

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_speller": None}

    def fit(self, c: Corpus, doc: np.ndarray, cls: np.ndarray, weight: np.ndarray, word: np.ndarray, prev: np.ndarray) -> None:
        """``cls`` is the class of every token occurrence given (the last one is no subject)."""
        k, v = len(self.subjects) + 1, len(self.vocabulary) + 2
        pair = prev * v + word
        self.pairs, row = np.unique(pair, return_inverse=True)

        def counts(unit: np.ndarray, n: int) -> np.ndarray:
            code = (doc * k + cls) * np.int64(n) + unit
            _, first, times = np.unique(code, return_index=True, return_counts=True)
            out = np.zeros((n, k))
            np.add.at(out, (unit[first], cls[first]), weight[first] * np.minimum(times, self.spec.cap))
            return out

        bi, uni = counts(row, len(self.pairs)), counts(word, v)
        ctx = np.zeros((v, k))
        np.add.at(ctx, self.pairs // v, bi)
        total = uni.sum(0)
        base = (uni.sum(1) + 0.5) / (total.sum() + 1000)
        own, rest = (lambda a: a), (lambda a: a.sum(-1, keepdims=True) - a)
        p, q = self.spec.prior, self.spec.context
        one = [(side(uni) + p * base[:, None]) / (side(total) + p) for side in (own, rest)]
        w, h = self.pairs % v, self.pairs // v
        two = [np.log((side(bi) + q * o[w]) / (side(ctx)[h] + q)) for side, o in zip((own, rest), one)]
        self.seen = np.vstack([(two[0] - two[1]), np.zeros(k)]).astype(np.float32)
        self.word_gain = np.log(one[0] / one[1]).astype(np.float32)
        self.context_gain = np.log((rest(ctx) + q) / (own(ctx) + q)).astype(np.float32)

    def score(self, c: Corpus) -> np.ndarray:
        """Evidence (nats) of every unit for every subject: by how much the subject's cross-entropy a token is below its background's, times the tokens."""
        k = len(self.subjects)
        if not len(c.word):
            return np.zeros((0, k), dtype=np.float32)
        v = len(self.vocabulary) + 2
        out = np.empty((len(c.sentence), k + 1), dtype=np.float32)
        edges = [*range(0, len(c.sentence), 20_000), len(c.sentence)]
        for a, b in zip(edges, edges[1:]):
            lo, hi = c.sentence[a], c.sentence[b] if b < len(c.sentence) else len(c.word)
            w, h = c.word[lo:hi], c.prev[lo:hi]
            at = np.minimum(np.searchsorted(self.pairs, h * v + w), len(self.pairs) - 1)
            known = (self.pairs[at] == h * v + w)[:, None]
            gain = np.where(known, self.seen[at], self.word_gain[w] + self.context_gain[h])
            out[a:b] = np.add.reduceat(np.clip(gain, self.spec.low, self.spec.high), c.sentence[a:b] - lo, axis=0)
        return out[:, :k] - self.spec.filler * np.maximum(out[:, k:], 0)

    def votes(self, c: Corpus, score: np.ndarray, docs: int, threshold: np.ndarray) -> np.ndarray:
        """Units of each document that deal with each subject: that of most evidence, if enough."""
        out = np.zeros((docs, len(self.subjects)), dtype=np.int64)
        if len(score):
            best = score.argmax(1)
            hit = score[np.arange(len(score)), best] > threshold[best]
            np.add.at(out, (c.doc[hit], best[hit]), 1)
        return out


def _fitted(models: SubjectModels, c: Corpus, has: np.ndarray) -> None:
    """Fits the models. Units are shared out among a document's labelled subjects over a few passes, since a document may have several."""
    spec, k = models.spec, len(models.subjects)
    of = np.repeat(np.arange(len(c.sentence)), c.size)  # the unit of every token
    token, cls = np.nonzero(has[c.doc[of]])
    weight = 1.0 / has.sum(1)[c.doc[of[token]]]
    models.fit(c, c.doc[of[token]], cls, weight, c.word[token], c.prev[token])
    bias = np.where(has, 0.0, spec.unlabelled)[c.doc]
    for turn in range(spec.passes):
        fit = models.score(c) + bias
        best = fit.argmax(1)
        best[fit[np.arange(len(fit)), best] <= (1.0 if turn == 0 else 1.5)] = k
        models.fit(c, c.doc[of], best[of], np.ones(len(of)), c.word, c.prev)


def _part(c: Corpus, docs: np.ndarray) -> Corpus:
    """The units of the documents marked in ``docs``."""
    mine = docs[c.doc]
    token = np.repeat(mine, c.size)
    size = c.size[mine]
    return Corpus(c.word[token], c.prev[token], np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(size) else size, c.doc[mine], size)


def train(texts: list[str], labels: list[set[int]], subjects: list[str], spec: SubjectSpec = SubjectSpec()) -> SubjectModels:
    """Models from labelled documents, and each subject's threshold, calibrated on documents that the models of the other folds haven't seen."""
    n: Counter[str] = Counter()
    for t in texts:
        if t:
            n.update({w for s in sentences(t) for w in s})
    least = max(3, len(texts) // 2000)
    vocabulary = {w: i + 2 for i, w in enumerate(sorted(w for w, times in n.items() if times >= least))}
    models, k = SubjectModels(subjects, vocabulary, spec), len(subjects)
    c = encode(texts, models.speller, spec.unit)
    if not len(c.word):
        return models
    has = np.zeros((len(texts), k), dtype=bool)
    for d, ls in enumerate(labels):
        has[d, list(ls)] = True
    right, found = np.zeros((len(spec.thresholds), k)), np.zeros((len(spec.thresholds), k))
    for f in range(spec.folds):
        held = np.arange(len(texts)) % spec.folds == f
        seen, unseen = _part(c, ~held), _part(c, held)
        if not len(seen.word) or not len(unseen.word):
            continue
        fold = SubjectModels(subjects, vocabulary, spec)
        _fitted(fold, seen, has)
        score = fold.score(unseen)
        for i, t in enumerate(spec.thresholds):
            got = fold.votes(unseen, score, len(texts), np.full(k, t)) >= spec.min_units
            right[i] += (got & has)[held].sum(0)
            found[i] += got[held].sum(0)
    agreed = 2 * right / np.maximum(1, found + has.sum(0))
    for s in range(k):
        # all that agree within half a hundredth are as good; of these the one nearest to the default
        good = [t for t, a in zip(spec.thresholds, agreed[:, s]) if a >= agreed[:, s].max() - 0.005]
        models.threshold[s] = min(good, key=lambda t: abs(t - spec.default))
    _fitted(models, c, has)
    return models


def tag_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, *, doc: str, text: str, subject: str, spec: SubjectSpec = SubjectSpec()) -> DataFrame:
    """The subjects of every document, as doc, subject and n_sentences; documents without subject have no row.

    ``labels`` has doc and subject, in any case and with blanks, "-" or "_" between words, and so may ``areas``, whose spelling is returned (of
    several spellings of one area the smallest); at most ``spec.max_areas`` areas (more raise an error). Labels that
    ``areas`` lacks, null labels and repeated ones don't count. Null or empty texts have no subject. No labels or no areas give no rows. Extra columns are ignored.

    Models are fitted on at most ``spec.max_train`` labelled documents, drawn by hash; every document is then read whole, once, without a shuffle.
    """
    spark = docs.sparkSession
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    known = areas.filter(F.col(subject).isNotNull()).groupBy(plain(F.col(subject)).alias("p")).agg(F.min(subject).alias("s")).limit(spec.max_areas + 1).collect()
    if len(known) > spec.max_areas:
        raise ValueError(f"more than {spec.max_areas} areas")
    known.sort(key=lambda r: r["s"])
    names = [r["s"] for r in known]
    told = labels.select(F.col(doc).alias("d"), plain(F.col(subject)).alias("s")).filter(F.col("d").isNotNull() & F.col("s").isin([r["p"] for r in known]))
    told = told.groupBy("d").agg(F.collect_set("s").alias("s")).orderBy(F.xxhash64("d", F.lit(spec.seed))).limit(spec.max_train)
    texts = docs.filter(F.col(doc).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc).alias("d"), F.col(text).alias("t"))
    sample = materialise(texts.join(F.broadcast(told), "d").withColumn("z", F.xxhash64("d", F.lit(spec.seed))), "labelled")  # at most max_train documents
    sizes = sample.select("z", F.length("t").alias("n")).toPandas().sort_values("z")
    fits = sizes["z"][sizes["n"].cumsum() <= spec.max_chars]
    sample = sample.filter(F.col("z") <= int(fits.max()) if len(fits) else F.lit(False)).toPandas().sort_values("d")
    number = {r["p"]: i for i, r in enumerate(known)}
    models = train(sample["t"].tolist(), [{number[x] for x in s} for s in sample["s"]], names, spec)
    kind = docs.schema[doc].dataType.simpleString()
    schema = f"d {kind}, s string, n long"
    if not len(sample) or not hasattr(models, "pairs"):
        return spark.createDataFrame([], schema).select(F.col("d").alias(doc), F.col("s").alias(subject), F.col("n").alias("n_sentences"))
    shared = spark.sparkContext.broadcast(models)

    def tag(batches):  # noqa: ANN001
        m = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):  # few texts at a time, however long they are
                pdf = batch.iloc[at : at + 500]
                c = encode(pdf["t"].tolist(), m.speller, m.spec.unit)
                votes = m.votes(c, m.score(c), len(pdf), m.threshold)
                d, s = np.nonzero(votes >= m.spec.min_units)
                yield pd.DataFrame({"d": pdf["d"].to_numpy()[d], "s": np.array(m.subjects, dtype=object)[s], "n": votes[d, s]})

    return texts.mapInPandas(tag, schema).groupBy(F.col("d").alias(doc), F.col("s").alias(subject)).agg(F.max("n").alias("n_sentences"))
