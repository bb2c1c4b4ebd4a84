"""Quality classifier by non-negative positive-unlabelled learning (operator 7).

Trusted positives are documents labelled of high quality; everything else is unlabelled web text
with an unknown share of positives. That share is estimated by best-bin estimation, and a small
network on measures of the whole text minimises the non-negative unbiased risk.

Defined results: a null or empty text scores 0; repeated rows score alike; without a positive
label among the training rows every text with words scores 1 (nothing is known against it); a row
without an id is not held out; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, raw_texts, slices
from .training import labelled, unlabelled, with_texts

#: Most positives and most unlabelled documents that the model is fitted on.
POSITIVES = 6_000
UNLABELLED = 12_000
THRESHOLD = 0.3
HIDDEN = 24
ROUNDS = 700

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_STOP = b".,;:'\"()-"
_LOUD = b"!?"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"
_WHITE = b" \t\n\r\x0b\x0c"
FEATURES = 18


def measures(text: bytes) -> list[float]:
    """Shares and ratios of a whole UTF-8 text; all zero for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    size = len(text)

    def share(chars: bytes) -> float:
        return (size - len(text.translate(None, chars))) / size

    white, upper, lower = share(_WHITE), share(_UPPER), share(_LOWER)
    other = len(text.translate(None, bytes(range(128)))) / size
    lengths = list(map(len, words))
    unique = len(set(words))
    lines = [x for x in text.split(b"\n") if x]
    pairs = set(zip(words, words[1:], strict=False))
    single = lengths.count(1)
    log = float(np.log1p(n))
    return [
        upper, lower, share(_DIGIT), share(_STOP), share(_LOUD), share(_SYMBOL), white, other,
        sum(lengths) / n, max(lengths) ** 0.5, unique / n, unique / n**0.75, len(pairs) / n,
        sum(map(eq, words, words[1:])) / n, single / n, len(set(lines)) / max(len(lines), 1), len(lines) / n, log,
    ]


def measured(rows: DataFrame) -> DataFrame:
    """(id, role, x) of rows (id, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [measures(t) for t in raw_texts(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("role"), pa.array(x, pa.list_(pa.float64()))], ["id", "role", "x"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "role", "text").mapInArrow(run, f"id {kind}, role string, x array<double>")


class Network:
    """One hidden layer on standardised inputs, trained by Adam; a plain value, cheap to ship."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.steps = 0

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.tanh(self._inputs(x) @ w + b) @ v + c[0]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float, decay: float = 1e-3) -> None:
        """One step against ``slope``, the risk's derivative by each row's logit."""
        w, b, v, _ = self.weights
        z = self._inputs(x)
        h = np.tanh(z @ w + b)
        back = slope[:, None] * v[None, :] * (1 - h * h)
        grads = [z.T @ back + decay * w, back.sum(axis=0), h.T @ slope + decay * v, np.array([slope.sum()])]
        self.steps += 1
        for at, (g, (m, s)) in enumerate(zip(grads, self.moments, strict=True)):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.weights[at] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled_: np.ndarray) -> float:
    """Best-bin estimate of the positives' share among the unlabelled, from scores of either."""
    cut = np.quantile(positive, np.linspace(0.02, 0.8, 40))
    p = np.array([(positive >= c).mean() for c in cut])
    u = np.array([(unlabelled_ >= c).mean() for c in cut])
    slack = np.sqrt(np.log(40) / (2 * len(positive))) + np.sqrt(np.log(40) / (2 * len(unlabelled_)))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def fit(positive: np.ndarray, web: np.ndarray, rounds: int = ROUNDS) -> tuple[Network, float]:
    """The network of least non-negative risk, and the class prior that it uses."""
    both = np.concatenate([positive, web])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    # for the prior: positives against the unlabelled, scored on the half not trained on
    plain = Network(mean, scale, seed=3)
    p, u = positive[::2], web[::2]
    x, y = np.concatenate([p, u]), np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    weight = np.where(y == 1, 0.5 / max(len(p), 1), 0.5 / max(len(u), 1))
    for _ in range(rounds // 2):
        plain.step(x, weight * (_sigmoid(plain.logits(x)) - y), 0.01)
    prior = class_prior(plain.logits(positive[1::2]), plain.logits(web[1::2]))
    network = Network(mean, scale)
    n = len(positive)
    for _ in range(rounds):
        z = network.logits(both)
        s = _sigmoid(z)
        # sigmoid loss l(z) = sigmoid(-z): risk = prior * E+[l(z)] + max(0, Eu[l(-z)] - prior * E+[l(-z)])
        bend = s * (1 - s)
        negative = s[n:].mean() - prior * s[:n].mean()
        if negative >= 0:
            network.step(both, np.concatenate([-2 * prior * bend[:n] / n, bend[n:] / len(web)]), 0.01)
        else:  # the negative part is overfitted: step back along it
            network.step(both, np.concatenate([prior * bend[:n] / n, -bend[n:] / len(web)]), 0.005)
    return network, prior


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, web: int = UNLABELLED) -> Network | None:
    """Fit on bounded samples of the training rows; None without positives."""
    chosen = with_texts(
        docs, labelled(docs, labels, "quality", 1, positives, "positive"), unlabelled(docs, web, "unlabelled")
    )
    rows = measured(chosen).toPandas().sort_values(["role", "id"])
    x = {role: np.array(part["x"].tolist(), np.float64) for role, part in rows.groupby("role")}
    if len(x.get("positive", ())) < 2 or len(x.get("unlabelled", ())) < 2:
        return None
    return fit(x["positive"], x["unlabelled"])[0]


def scores(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([measures(t) for t in raw_texts(b, "text")], np.float64).reshape(-1, FEATURES)
            score = np.ones(len(x)) if model.value is None else _sigmoid(model.value.logits(x))
            score = np.where(x[:, -1] > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score)], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def kept(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, whole; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([measures(t) for t in raw_texts(b, text_col)], np.float64).reshape(-1, FEATURES)
            score = np.ones(len(x)) if model.value is None else _sigmoid(model.value.logits(x))
            yield b.filter(pa.array((score >= threshold) & (x[:, -1] > 0)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scores(docs, train(docs, documents(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
