"""Benchmark decontamination by latent semantic retrieval (operator 10).

The benchmark's items are cut into short passages. Document frequencies over all windows of the
corpus weight their words (TF-IDF); a distributed randomised SVD of the passages gives the latent
space. Every window of every whole document is projected into it and compared by cosine with all
passages; each candidate is checked word by word: the longest common subsequence with the whole
item around the window, and for paraphrases the presence of the item's answer. A long answer has to
stand there nearly whole, a short one as a phrase at or beside the place. Where no answer is given,
a long last sentence or the item's rarer half of words tell a paraphrase.

The SVD is of the benchmark's passages, not of the corpus: the words that tell a leak are rare in
the corpus and do not survive a truncated SVD of it. Its sums are taken over ``STEP`` passages at a
time on the executors. A benchmark of more than ``MOST_WORDS`` words is dealt into parts by a hash
of the item, each searched in a pass of its own, so what is broadcast has a bound.

Items of fewer than ``LEAST_WORDS`` words are too short for a common subsequence to mean anything:
they are looked for as phrases, exactly.

Defined results: null and empty items match nothing, nor do null or empty texts; an item that stands in a document several times makes one row; repeated rows
are found each; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, merged, slices, texts

#: Words of a window and between the starts of windows.
WINDOW, STRIDE = 32, 16
#: Words of a benchmark passage.
PASSAGE = 24
#: Items of fewer words are looked for as phrases.
LEAST_WORDS = 5
#: Words of the benchmark that are searched for at once: bounds the broadcast vectors (100 MB).
MOST_WORDS = 200_000
#: Passages summed by one task of the SVD.
STEP = 128
RANK = 128
OVERSAMPLE = 16
POWER_ROUNDS = 2
#: Of the cosine that a window holding the whole passage would have.
NEAR = 0.55
#: Share of the item's words in a common subsequence: enough alone, and enough with the answer.
SAME, PARAPHRASE = 0.8, 0.65
#: Words of an answer that is compared by subsequence; a shorter one has to stand there as a phrase.
LEAST_ANSWER = 5
#: Words of a document that are projected at once.
BLOCK_WORDS = 1 << 15

_MARKS = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128))
)


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts them."""
    return text.lower().encode().translate(_MARKS).split()


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & place.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """The benchmark: items, their passages and the vocabulary, bounded by the benchmark's size."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.items, self.answers, self.given = [], [], [], []
        self.rare: list[list[bytes]] = []  # of each item, from the time the weights are known
        self.phrases: dict[bytes, list[tuple[list[bytes], int]]] = {}  # short items by their first word
        self.vocabulary: dict[bytes, int] = {}
        self.passages: list[tuple[int, int, list[int]]] = []  # item, first word, word ids
        for item_id, text, answer in rows:
            item = words(text or "")
            if not item:
                continue
            k = len(self.items)
            self.ids.append(item_id), self.items.append(item)
            if len(item) < LEAST_WORDS:
                self.phrases.setdefault(item[0], []).append((item, k))
                self.answers.append([]), self.given.append(False)
                continue
            told = words(answer) if answer else []
            self.given.append(bool(told))
            self.answers.append(told or words(_last_sentence(text)))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item]
            n = max(1, round(len(ids) / PASSAGE))
            edge = [i * len(ids) // n for i in range(n + 1)]
            self.passages += [(k, lo, ids[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]

    def weigh(self, idf: np.ndarray) -> None:
        """Find each item's rarer half of words, in order."""
        for item in self.items:
            if len(item) < LEAST_WORDS:
                self.rare.append([])
                continue
            weight = idf[[self.vocabulary[w] for w in item]]
            self.rare.append([w for w, x in zip(item, weight >= np.median(weight), strict=True) if x])

    def told(self, k: int, region: list[bytes], around: list[bytes]) -> bool:
        """Whether a place that shares ``PARAPHRASE`` of item ``k`` is a paraphrase of it."""
        answer = self.answers[k]
        if len(answer) >= LEAST_ANSWER and common(answer, region) >= 0.9 * len(answer):
            return True
        if self.given[k]:
            return len(answer) < LEAST_ANSWER and _phrase(answer, around)
        return common(self.rare[k], region) >= PARAPHRASE * len(self.rare[k])

    def short(self, doc: list[bytes]) -> set[int]:
        """The short items that stand in a document as a phrase."""
        found: set[int] = set()
        if self.phrases and not self.phrases.keys().isdisjoint(doc):
            for at, w in enumerate(doc):
                for item, k in self.phrases.get(w, ()):
                    if k not in found and doc[at : at + len(item)] == item:
                        found.add(k)
        return found

    def vectors(self, idf: np.ndarray, which: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The words that the passages have, and the passages' TF-IDF over these words."""
        some = self.passages[which]
        used = np.unique(np.concatenate([ids for _, _, ids in some]))
        x = np.zeros((len(some), len(used)), np.float32)
        for row, (_, _, ids) in enumerate(some):
            np.add.at(x[row], np.searchsorted(used, ids), idf[ids])
        return used, x


def _phrase(short: list[bytes], long: list[bytes]) -> bool:
    return b" " + b" ".join(short) + b" " in b" " + b" ".join(long) + b" "


def _last_sentence(text: str) -> str:
    parts = [p for p in text.replace("\n", " ").split(". ") if p.strip()]
    return parts[-1] if len(parts) > 1 else ""


def _blocks(ids: list[np.ndarray], nothing: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words in rows of ``STRIDE``, an empty row after each; and each one's first row."""
    rows = np.array([-(-len(x) // STRIDE) + 1 for x in ids])
    first = np.concatenate([[0], np.cumsum(rows)])
    flat = np.full(int(first[-1]) * STRIDE, nothing, np.int32)
    for x, r in zip(ids, first[:-1].tolist(), strict=True):
        flat[r * STRIDE : r * STRIDE + len(x)] = x
    return flat.reshape(-1, STRIDE), first


def _ids(vocabulary: dict[bytes, int], found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, found, repeat(len(vocabulary))), np.int32, len(found))


def _sum_arrays(payloads: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p, np.float64) for p in payloads], axis=0).tobytes()


def _part(array: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([array.astype(np.float64).tobytes()], pa.binary())], ["part", "payload"]
    )


def window_frequencies(rows: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many stretches of ``WINDOW`` words of all documents each word stands, and their number."""
    d = len(vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(d + 1, np.float64)
        for b in slices(batches):
            for text in texts(b, "text"):
                ids = _ids(shared.value, words(text))
                place = np.nonzero(ids < d)[0]
                counts[d] += -(-len(ids) // WINDOW)
                pairs = np.unique(place // WINDOW * d + ids[place])
                counts[:d] += np.bincount(pairs % d, minlength=d)
        yield _part(counts)

    sums = merged(rows.mapInArrow(run, "part int, payload binary"), _sum_arrays)
    total = np.frombuffer(_sum_arrays(sums), np.float64) if sums else np.zeros(d + 1)
    return total[:d], int(total[d])


def latent_space(spark: SparkSession, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF matrix, by randomised SVD.

    Tasks hold stretches of passages and send sums of A'(A Y) for the current basis Y.
    """
    n, d = len(items.passages), len(items.vocabulary)
    size = min(rank + OVERSAMPLE, n, d)
    step = STEP
    starts = spark.createDataFrame([(i,) for i in range(0, n, step)], "at int").repartition(max(1, min(64, n // step)))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, size)))[0].astype(np.float32)
    shared = spark.sparkContext.broadcast((items, idf))
    for last in [False] * POWER_ROUNDS + [True]:
        now = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], now=now, last=last) -> Iterator[pa.RecordBatch]:
            held, weights = shared.value
            total = 0.0
            for b in batches:
                for at in b.column("at").to_pylist():
                    used, x = held.vectors(weights, slice(at, at + step))
                    y = x @ now.value[used]
                    if last:
                        total = total + y.T @ y
                    else:
                        total = np.zeros((d, size)) if np.isscalar(total) else total
                        total[used] += x.T @ y
            if not np.isscalar(total):
                yield _part(total)

        sums = merged(starts.mapInArrow(run, "part int, payload binary"), _sum_arrays)
        y = np.frombuffer(_sum_arrays(sums), np.float64).reshape(-1, size)
        if last:
            _, rotation = np.linalg.eigh(y)
            basis = basis @ rotation[:, ::-1][:, :rank].astype(np.float32)
        else:
            basis = np.linalg.qr(y)[0].astype(np.float32)
        now.unpersist()
    return basis


class Searcher:
    """The benchmark in latent space, as it is broadcast: its size is the benchmark's and the rank's."""

    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray):
        self.items = items
        items.weigh(idf)
        self.word_vectors = np.concatenate([idf[:, None] * space, np.zeros((1, space.shape[1]), np.float32)])
        latent = np.zeros((len(items.passages), space.shape[1]), np.float32)
        for at in range(0, len(latent), STEP):
            used, x = items.vectors(idf, slice(at, at + STEP))
            latent[at : at + STEP] = x @ space[used]
        self.norm = np.linalg.norm(latent, axis=1)
        self.unit = (latent / np.maximum(self.norm, 1e-9)[:, None]).T.copy()

    def found(self, texts_: list[str]) -> list[tuple[int, int, float, bool]]:
        """(text's place, item's place, lcs, answer) of every item that a text holds."""
        nothing = len(self.items.vocabulary)
        cut = [words(t) for t in texts_]
        ids, first = _blocks([_ids(self.items.vocabulary, x) for x in cut], nothing)
        hits: dict[tuple[int, int], tuple[float, bool]] = {
            (k, i): (1.0, False) for k, doc in enumerate(cut) for i in self.items.short(doc)
        }
        for at in range(0, len(ids) if nothing else 0, BLOCK_WORDS // STRIDE):
            part = ids[at : at + BLOCK_WORDS // STRIDE + 1]  # one row more: windows are two rows
            sums = _row_sums(part, self.word_vectors, nothing)
            pair = sums[:-1] + sums[1:] if len(sums) > 1 else sums
            length = np.linalg.norm(pair, axis=1)
            cosine_times = pair @ self.unit  # cosine times the window's length
            near = (cosine_times >= NEAR * self.norm[None, :]) | (cosine_times >= NEAR * length[:, None])
            near &= length[:, None] > 1e-6
            row, passage = np.nonzero(near)
            doc = np.searchsorted(first, at + row, "right") - 1
            place = (at + row - first[doc]) * STRIDE
            for k, i, p in zip(doc.tolist(), place.tolist(), passage.tolist(), strict=True):
                _check(self.items, cut[k], i, p, k, hits)
        return [(doc, i, lcs, a) for (doc, i), (lcs, a) in sorted(hits.items()) if lcs >= SAME or a]


def searchers(docs: DataFrame, benchmark: DataFrame, text_col: str, answer_col: str | None) -> Iterator[Searcher]:
    """One for each part of the benchmark, of about ``MOST_WORDS`` words each; none for items that hold no word."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select("item_id", "text", answer.alias("answer"))
    size = F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+")))
    parts = -(-(rows.agg(size).first()[0] or 0) // MOST_WORDS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1)))
    for k in range(parts):
        items = Items([tuple(r) for r in rows.where(part == k).toLocalIterator()])
        if not items.items:
            continue
        if items.vocabulary:
            frequency, windows = window_frequencies(docs.select(F.col(text_col).alias("text")), items.vocabulary)
            idf = np.log((windows + 1) / (frequency + 1)).astype(np.float32) + 1e-3
            yield Searcher(items, idf, latent_space(docs.sparkSession, items, idf))
        else:
            yield Searcher(items, np.zeros(0, np.float32), np.zeros((0, 1), np.float32))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None
) -> DataFrame:
    """(id, item_id, lcs, answer): every document and benchmark item that it holds.

    ``lcs`` is the share of the item's words found in order, ``answer`` whether its answer (the
    column ``answer_col``, else its last sentence or its rarer words) was needed and found.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id {item_type}, lcs double, answer boolean"
    found = docs.sparkSession.createDataFrame([], schema)
    for k, search in enumerate(searchers(docs, benchmark, text_col, answer_col)):
        part = rows.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(search)), schema)
        found = found.unionByName(part) if k else part
    return found


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            if good := shared.value.found(texts(b, "text")):
                doc, item, lcs, a = zip(*good, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(doc)), pa.array([shared.value.items.ids[i] for i in item]), pa.array(lcs), pa.array(a)],
                    ["id", "item_id", "lcs", "answer"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, whole; no shuffle."""
    left = docs
    for search in searchers(docs, benchmark, text_col, answer_col):
        left = left.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(search), text_col), docs.schema)
    return left


def _cleaner(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            stay = np.ones(b.num_rows, bool)
            stay[[doc for doc, *_ in shared.value.found(texts(b, text_col))]] = False
            yield b.filter(pa.array(stay))

    return run


def _row_sums(ids: np.ndarray, vectors: np.ndarray, nothing: int) -> np.ndarray:
    """Sums of the word vectors of each row; words outside the vocabulary cost nothing.

    The k-th known words of all rows that have so many are added at once.
    """
    known = np.sort(ids, axis=1)  # the number for unknown words is the largest
    count = (known != nothing).sum(axis=1)
    order = np.argsort(-count, kind="stable")
    known, rest = known[order], np.searchsorted(-count[order], -np.arange(ids.shape[1]), "left")
    sums = np.zeros((len(ids), vectors.shape[1]), np.float32)
    for k, n in enumerate(rest.tolist()):  # n rows have more than k known words
        if not n:
            break
        sums[:n] += vectors.take(known[:n, k], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _check(items: Items, doc: list[bytes], at: int, passage: int, row: int, hits: dict) -> None:
    """Compare the whole item with the words about the window, once per place."""
    k, offset, _ = items.passages[passage]
    if hits.get((row, k), (0.0, False))[0] >= SAME:
        return
    item = items.items[k]
    lo = max(0, at - offset - PASSAGE)
    region = doc[lo : at + WINDOW - offset + len(item) + PASSAGE]
    # words of the item that stand there at all: a common subsequence has no more
    if sum(map(set(region).__contains__, item)) < PARAPHRASE * len(item):
        return
    lcs = common(item, region) / len(item)
    around = doc[max(0, lo - PASSAGE) : at + WINDOW - offset + len(item) + 2 * PASSAGE]
    told = PARAPHRASE <= lcs < SAME and items.told(k, region, around)
    most, before = hits.get((row, k), (0.0, False))
    hits[(row, k)] = max(most, lcs), before or told  # an answer found at one place holds for the document


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
