"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on the presence of words and of word beginnings (PREFIXES bytes). Besides the log
loss and a ridge, training penalises the squared change of the score between a sentence of a labelled
text and the same sentence after a swap: every identity term in it gives way to each other term of its
group, and to nothing. The features of swapped sentences are taken anew from their words, so that the
beginnings of a term change with it, and neutral mentions of groups carry no score of their own.

Labels come only from rows whose crc32(doc_id as text) is not 0 modulo FOLDS. At most MAX_SAMPLE
labelled documents are used, those of the smallest hashes of doc_id, and at most MAX_SWAPS different
swaps of their sentences; every document is scored in full.

Edge cases: null text is empty and scores the model's base rate; without labels of both kinds all
texts get the smoothed base rate; a doc_id labelled twice counts as toxic if either label is; of rows
that share a doc_id one is learnt from, that of the smallest text hash; null doc_ids are never held out
nor learnt from; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared, textkit

FOLDS = 5
#: Labelled documents learnt from at most, and pairs of a sentence and its swapped form.
MAX_SAMPLE, MAX_SWAPS = 20_000, 20_000
#: Characters of a sentence on either side of an identity term.
CONTEXT = 200
#: Words with weights of their own at most, by chi-squared; each must stand in MIN_DOCS labelled texts.
MAX_WORDS, MIN_DOCS, MIN_CHI2 = 1000, 5, 30.0
#: Bytes of the word beginnings that are features too, for words that are longer.
PREFIXES = (4, 5, 6)
RIDGE, SWAP_PENALTY, STEPS = 0.01, 4.0, 1500

# Neutral terms for groups of people; a term is swapped within its line.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    ["woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indian"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["deaf", "blind", "disabled", "autistic"],
    ["old", "young", "elderly", "teenage"],
]

GROUP_OF = {term: group for group in IDENTITY_TERMS for term in group}
_EDGE = "0-9A-Za-z\x80-\U0010ffff"  # what a word is made of; see _BREAKS
_TERM = re.compile(f"(?<![{_EDGE}])(?:{'|'.join(sorted(GROUP_OF, key=len, reverse=True))})(?![{_EDGE}])")
_STOP = re.compile(r"[.!?\n]")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_BREAKS = np.array([not (c >= 0x80 or chr(c).isalnum()) for c in range(256)])


def _hash_words(words: list[str]) -> np.ndarray:
    return textkit.Words(pa.array(words, pa.string()), lower=True, breaks=_BREAKS).hashes()


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, rows, number of rows): every word and word beginning of the texts."""
    words = textkit.Words(texts, lower=True, breaks=_BREAKS)
    rows, size = words.rows(), words.ends - words.starts
    hashes, owners = [words.hashes()], [rows]
    for n in PREFIXES:
        longer = size > n
        hashes.append(textkit.mix(words.hashes(n)[longer] + np.uint64(n)))
        owners.append(rows[longer])
    return np.concatenate(hashes), np.concatenate(owners), len(words.offsets) - 1


@dataclass
class Model:
    """Sorted word hashes, their weights, and the bias."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of the toxic label for each text, all of its words counted."""
        h, rows, n = _features(texts)
        k = len(self.words)
        z = np.full(n, self.bias)
        if k and len(h):
            at = np.minimum(np.searchsorted(self.words, h), k - 1)
            hit = self.words[at] == h
            seen = np.unique(rows[hit] * k + at[hit])
            z += np.bincount(seen // k, weights=self.weights[seen % k], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Presence:
    """A sparse 0/1 matrix: features[i] stands in row rows[i]."""

    rows: np.ndarray
    features: np.ndarray
    n: int

    @classmethod
    def of(cls, lists) -> Presence:
        lists = list(lists)
        features = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
        return cls(np.repeat(np.arange(len(lists)), [len(p) for p in lists]), features, len(lists))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.features], minlength=self.n)

    def back(self, d: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.features, weights=d[self.rows], minlength=k)


def mentions(text: str) -> list[str]:
    """The different sentences of a text that name a group, lower-cased; CONTEXT characters around the
    name at most."""
    text = text.translate(_UPPER)
    found = {}
    for m in _TERM.finditer(text):
        before, after = text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT]
        stop = _STOP.search(after)
        found[_STOP.split(before)[-1] + m[0] + (after[: stop.start()] if stop else after)] = True
    return list(found)


def swapped(sentence: str) -> Iterator[str]:
    """The sentence with each of its identity terms replaced by every other one of the group, and left
    out; all places of a term change at once."""
    for term in sorted(set(_TERM.findall(sentence))):
        for other in ["", *GROUP_OF[term]]:
            if other != term:
                yield _TERM.sub(lambda m, term=term, other=other: other if m[0] == term else m[0], sentence)


def train(x: Presence, y: np.ndarray, k: int, own: Presence, other: Presence, ridge: float = RIDGE, penalty: float = SWAP_PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of k features and bias, by Adam on the whole batch.

    own, other: sentences and their swapped forms, row by row. Minimises the mean log loss (kinds
    weighed equally) + ridge / n * |w|^2 / 2 + penalty * mean of (score - swapped score)^2.
    """
    n = x.n
    weigh = np.where(y > 0, n / (2 * max(y.sum(), 1)), n / (2 * max(n - y.sum(), 1)))  # both kinds weigh the same
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x.times(w) + b)))
        d = weigh * (p - y) / n
        gw, gb = ridge / n * w + x.back(d, k), d.sum()
        if own.n:
            p, q = (1 / (1 + np.exp(-(s.times(w) + b))) for s in (own, other))
            gap = 2 * penalty * (p - q) / own.n
            up, down = gap * p * (1 - p), gap * q * (1 - q)
            gw, gb = gw + own.back(up, k) - other.back(down, k), gb + up.sum() - down.sum()
        g = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _numbered(words: np.ndarray, hashes: np.ndarray, rows: np.ndarray, n: int) -> list[bytes]:
    """For each row the places of its features in `words`, as little-endian 32-bit numbers."""
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    hit = words[at] == hashes
    pairs = np.unique(rows[hit] * len(words) + at[hit])
    bounds = np.searchsorted(pairs // len(words), np.arange(n + 1))
    places = (pairs % len(words)).astype("<i4")
    return [places[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def _presence(cells) -> Presence:
    return Presence.of([np.frombuffer(bytes(c), dtype="<i4").astype(np.int64) for c in cells])


def learn(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, max_swaps: int = MAX_SWAPS) -> Model:
    """Fit on the labelled rows of docs(doc_id, text) outside fold 0; labels(doc_id, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0))
    sample = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), "toxic", F.xxhash64(text).alias("print"), text.alias("text"))  # the sample has max_sample rows

    def described(batches):
        for batch in textkit.chunks(batches, "text"):
            h, owners, n = _features(batch.column(3))
            order = np.lexsort((h, owners))
            h, owners = h[order].view(np.int64), owners[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (owners[1:] != owners[:-1])]) if len(h) else np.zeros(0, bool)
            h, bounds = h[new], np.searchsorted(owners[new], np.arange(n + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h))
            named = pa.array([mentions(t or "") for t in batch.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, named], names=["doc_id", "toxic", "print", "words", "mentions"])

    seen = shared.materialise(rows.mapInArrow(described, "doc_id long, toxic int, print long, words array<long>, mentions array<string>"), "toxicity-sample")
    if seen.count() > seen.select("doc_id").distinct().count():
        one = seen.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "words", "mentions"), "print").alias("r")).select("doc_id", "r.*")
        seen = shared.materialise(one, "toxicity-rows")  # a row for each doc_id of the sample
    size = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = size["n"], size["pos"]
    if not n or not pos or pos == n:
        return Model(bias=float(np.log((pos + 0.5) / (n - pos + 1.5))))
    counts = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("toxic").cast("double").alias("a"))
    gap = F.col("a") * F.lit(float(n)) - F.col("c") * F.lit(float(pos))
    chi2 = gap * gap * F.lit(float(n)) / (F.col("c") * (F.lit(float(n)) - F.col("c")) * F.lit(float(pos)) * F.lit(float(n - pos)))
    picked = counts.where((F.col("c") >= MIN_DOCS) & (F.col("c") < n)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "word").limit(MAX_WORDS)
    chosen = np.array([r["word"] for r in picked.collect()], dtype=np.int64).view(np.uint64)
    words = np.unique(np.concatenate([chosen, _hash_words(list(GROUP_OF))]))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(words)

    def matrix(batches):
        for batch in batches:
            lists = batch.column(1)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            got = _numbered(held.value, np.asarray(lists.flatten()).view(np.uint64), rows, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["toxic", "at"])

    def swap(batches):
        for batch in batches:
            pairs = [(s, t) for s in batch.column(0).to_pylist() for t in swapped(s)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs)], names=["own", "other"])

    def numbers(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_numbered(held.value, *_features(c)), pa.binary()) for c in batch.columns], names=["own", "other"])

    known_rows = seen.orderBy("doc_id").select("toxic", "words").mapInArrow(matrix, "toxic int, at binary").collect()  # max_sample rows at most
    sentences = seen.select(F.explode("mentions").alias("own")).distinct()
    pairs = sentences.mapInArrow(swap, "own string, other string").orderBy(F.xxhash64("own", "other"), "own", "other").limit(max_swaps)
    swaps = pairs.mapInArrow(numbers, "own binary, other binary").collect()  # max_swaps rows at most
    y = np.array([r["toxic"] for r in known_rows], dtype=np.float64)
    weights, bias = train(_presence(r["at"] for r in known_rows), y, len(words), _presence(r["own"] for r in swaps), _presence(r["other"] for r in swaps))
    return Model(words, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in textkit.chunks(batches, "text"):
            s = held.value.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return docs.select("doc_id", out.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in textkit.chunks(batches, "text"):
            yield batch.filter(pa.array(held.value.score(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
