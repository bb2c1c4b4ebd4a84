"""Toxicity by subword-bag embeddings and a linear softmax (operator 5).

A word's vector is the mean of its character n-grams' vectors, a bag's the mean of its words', and a
linear softmax of it tells the two labels. Both are trained together in numpy. A few words among
many make a document toxic, so its bag is that of its most toxic words: two, and one more for
every ``WORDS_PER_PICK`` words of the whole text. One such word by chance does not fill the bag. A
misspelt word shares most of its n-grams' vectors with the word.

Defined results: a null or empty text has the score of no evidence (the bias alone); repeated rows
score alike; without labels of both kinds every score is 0; a row without an id is not held out; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fold, slices, texts
from .training import labelled, with_texts

#: Most labelled documents of either kind that the model is fitted on.
TOXIC = 1_500
CLEAN = 3_500
#: Characters of either kind's training texts; the first that fit, by a hash of the id.
CHARS = 24_000_000
THRESHOLD = 0.5
BUCKETS = 1 << 16
DIM = 12
GRAMS = (3, 4, 5)
#: Words of a text for each word of its bag beyond the first two.
WORDS_PER_PICK = 400
ROUNDS = 100
#: Rounds between two choices of each text's candidate words, and candidates beyond those picked.
REFRESH, SPARE = 10, 12
#: n-grams of fewer training documents than this have no vector.
LEAST_DOCS = 4
#: Pull of the vectors towards zero, and share of a label's weight that is not trusted.
DECAY, DOUBT = 3e-6, 0.04
CACHE = 300_000
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~…“”„«»‘’–—¡¿"


def grams(word: str) -> list[int]:
    """Buckets of the word's character n-grams and of the word itself."""
    word = f"<{word.strip(EDGES)}>".encode()
    found = [zlib.crc32(word) % BUCKETS]
    for n in GRAMS:
        found += [zlib.crc32(word[i : i + n]) % BUCKETS for i in range(len(word) - n + 1)]
    return found


def picks(n):
    """Words in the bag of a text of ``n`` words."""
    return np.minimum(n, 2 + n // WORDS_PER_PICK)


class Model:
    """Vectors of n-gram buckets and the softmax; for two labels its logits differ by one vector."""

    def __init__(self, vectors: np.ndarray, softmax: np.ndarray, bias: float):
        self.bucket_score = (vectors @ (softmax[1] - softmax[0])).astype(np.float32)
        self.bias = float(bias)
        self._cache: dict[str, float] = {}
        self._scores: list[float] = []

    def __getstate__(self):
        return {"bucket_score": self.bucket_score, "bias": self.bias, "_cache": {}, "_scores": []}

    def word(self, word: str) -> float:
        if not self._scores:
            self._scores = self.bucket_score.tolist()
        found = grams(word)
        return sum(map(self._scores.__getitem__, found)) / len(found)

    def score(self, text: str) -> float:
        words = text.lower().split()
        if len(self._cache) > CACHE:
            self._cache = {}
        cache = self._cache
        try:
            values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        except KeyError:
            cache.update((w, self.word(w)) for w in set(words).difference(cache))
            values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        k = int(picks(len(values)))
        z = self.bias + (np.partition(values, len(values) - k)[-k:].mean() if k else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts_: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Train vectors, softmax and bias together, full batch, by Adam."""
    types: dict[str, int] = {}
    docs = [np.array([types.setdefault(w, len(types)) for w in t.lower().split()] or [-1], np.int32) for t in texts_]
    sizes, buckets = array("q"), array("i")  # flat from the start: lists of ints would take ten times the memory
    for w in types:
        found = grams(w)
        sizes.append(len(found)), buckets.extend(found)
    size = np.array(sizes or [1], np.int64)
    flat = np.array(buckets or [0], np.int32)
    del types, sizes, buckets
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    # buckets of too few documents stay zero
    doc_count = np.zeros(BUCKETS, np.int32)
    for d in docs:
        if d[0] >= 0:
            own = np.unique(d)
            doc_count[np.unique(np.concatenate([flat[first[w] : first[w] + size[w]] for w in own.tolist()]))] += 1
    used = (doc_count >= LEAST_DOCS).astype(np.float64)
    tokens = np.concatenate(docs)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    k = np.maximum(picks(np.array([len(d) for d in docs])), 1)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)) * used[:, None], rng.normal(0, 0.3, (2, DIM)), np.array([-2.0])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = labels * (1 - 2 * DOUBT) + DOUBT
    for t in range(1, rounds + 1):
        vectors, softmax, bias = params
        direction = softmax[1] - softmax[0]
        per_type = np.add.reduceat((vectors @ direction)[flat], first) / size
        if (t - 1) % REFRESH == 0:
            near = _top(np.where(tokens >= 0, per_type[tokens], 0.0), owner, k + SPARE)
            token, mine = tokens[near], owner[near]
        value = np.where(token >= 0, per_type[token], 0.0)
        chosen = _top(value, mine, k)
        row = mine[chosen]
        z = np.bincount(row, value[chosen], minlength=len(docs)) / k + bias[0]
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(docs)
        good = token[chosen] >= 0
        by_type = np.bincount(token[chosen][good], (slope / k)[row[good]], minlength=len(size))
        live = np.nonzero(by_type)[0]
        counts = size[live]
        pos = np.repeat(first[live], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        by_bucket = np.bincount(flat[pos], np.repeat(by_type[live] / counts, counts), minlength=BUCKETS) * used
        down = by_bucket @ vectors
        grads = [by_bucket[:, None] * direction[None, :] + DECAY * vectors, np.stack([-down, down]), np.array([slope.sum()])]
        for p, g, (m, s) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
        params[0] *= used[:, None]
    return Model(params[0], params[1], params[2][0])


def _top(value: np.ndarray, owner: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the ``k[d]`` largest values of each document ``d``, by document; owners are sorted."""
    order = np.lexsort((-value, owner))
    start = np.searchsorted(owner, np.arange(len(k)))
    return order[np.arange(len(order)) - start[owner] < k[owner]]


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    """Fit on bounded samples of the labelled training rows; None without both kinds."""
    chosen = with_texts(
        docs, labelled(docs, labels, "toxic", 1, toxic, "1"), labelled(docs, labels, "toxic", 0, clean, "0")
    )
    # a bounded number of rows; a running total over them in one task holds no texts back
    before = Window.partitionBy("role").orderBy(F.xxhash64("id"), "id")
    rows = chosen.withColumn("so_far", F.sum(F.length("text")).over(before)).where(F.col("so_far") <= CHARS).collect()
    rows.sort(key=lambda r: (r.id, r.role))
    y = np.array([int(r.role) for r in rows], np.float64)
    return fit([r.text for r in rows], y) if 0 < y.sum() < len(y) else None


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shared.value.score(t) if shared.value else 0.0 for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scores(docs, train(docs, documents(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
