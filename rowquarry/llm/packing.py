"""Best-fit packing of tokenized documents by exact-complement hashing (operator 8).

Only a histogram of piece lengths (one count per length up to the capacity) reaches the driver.
There, gaps are filled exactly by single lengths, pairs and triples looked up by their sum, under the
counts still available. The index is addressed by the sum itself (sums are whole numbers up to the
capacity): single lengths are its own entries, pairs the entries of ``PairSums``, and a triple a
single length with the pair of the remaining sum. What is left is packed best fit, longest first. The plan lists patterns of
lengths with their number; each piece finds its place by its length and its rank within the length.

Defined results: a null or empty text is the end id alone, one piece of length 1; repeated rows are
packed each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, one_thread, slices, texts, written
from .tokens import SLOW

CAPACITY = 2048
END_ID = 0
#: Entries of a worker's cache of word ids; beyond it only the first ``KEEP`` stay: what comes first is frequent.
CACHE, KEEP = 600_000, 100_000
#: Characters of texts that are encoded at once; a longer text is cut at white space.
SPAN = 1 << 20
#: The white space that str.split takes and the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SEAM = re.compile("[ \t\n]")
SEPARATOR = "\x01"
MARKS = ".,"


def _stretches(text: str) -> Iterator[str]:
    """The text, cut at white space where it is longer than ``SPAN``."""
    at = 0
    while len(text) - at > SPAN:
        seam = SEAM.search(text, at + SPAN)
        if not seam:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:] if at else text


class WordIds:
    """Ids of whole texts as little-endian bytes, in one worker.

    This tokenizer drops white space, so that the stretches between it are encoded apart from each
    other and cached.
    """

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.cache: dict[str, bytes] = {}
        self.mark = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in MARKS}
        (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids

    def trim(self, most: int) -> None:
        if len(self.cache) > most:
            self.cache = dict(islice(self.cache.items(), min(KEEP, most)))

    def words(self, text: str) -> list[str]:
        if not SLOW.search(text) and "İ" not in text:
            text = text.lower()  # as the tokenizer does; fewer words to encode
        return re.split("[ \t\n\r]+", text) if ODD_SPACE.search(text) else text.split()

    def ids(self, batch: list[str]) -> list[bytes]:
        """The ids of each text; the cache is bounded whatever the texts are."""
        found: list[list[bytes]] = [[] for _ in batch]
        held, owners, size = [], [], 0

        def out():
            for r, ids in zip(owners, self._stretches(held), strict=True):
                found[r].append(ids)

        for r, text in enumerate(batch):
            for part in _stretches(text):
                held.append(part), owners.append(r)
                size += len(part)
                if size > SPAN:
                    out()
                    held, owners, size = [], [], 0
        out()
        return [b"".join(parts) for parts in found]

    def _stretches(self, parts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in parts]
        try:
            return [b"".join(map(self.cache.__getitem__, words)) for words in cut]
        except KeyError:
            self.trim(self.most)
            self.encode(list(set(chain.from_iterable(cut)).difference(self.cache)))
        return [b"".join(map(self.cache.__getitem__, words)) for words in cut]

    def encode(self, missing: list[str]) -> None:
        # a mark after a letter is a token of its own: "word." is "word" and "."
        marked = [m for m in missing if m[-1:] in MARKS and "a" <= m[-2:-1] <= "z"]
        bases = {m[:-1] for m in marked}.difference(self.cache)
        plain = bases.union(missing).difference(marked) if marked else set(missing)
        odd = [m for m in plain if SEPARATOR in m]
        for m in odd:
            self.cache[m] = np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes()
        plain = list(plain.difference(odd))
        groups = [plain[i : i + 128] for i in range(0, len(plain), 128)]
        joined = [f" {SEPARATOR} ".join(g) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            parts = [0, *(np.nonzero(ids == self.separator)[0] + 1).tolist(), len(ids) + 1]
            for m, lo, hi in zip(g, parts[:-1], parts[1:], strict=True):
                self.cache[m] = ids[lo : hi - 1].tobytes()
        self.cache.update((m, self.cache[m[:-1]] + self.mark[m[-1]]) for m in marked)


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This process's encoder for a tokenizer file; its cache outlives the task.

    Looked up by a function of the module: what a shipped closure names itself, it copies.
    """
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, cache: int = CACHE) -> DataFrame:
    """One row per piece, with the task that made it and its number among the task's pieces of that length.

    A smaller ``cache`` than ``CACHE`` is for workers that share their memory with other steps: they keep
    nothing between tasks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        encoder = word_ids(tokenizer) if cache >= CACHE else WordIds(tokenizer, cache)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            row, number, start, length, crc, nth = [], [], [], [], [], []
            for r, ids in enumerate(encoder.ids(texts(b, "text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    row.append(r), number.append(k), start.append(at // 4), length.append(n)
                    crc.append(zlib.crc32(part)), nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc, nth)]
                + [pa.array([task] * len(row), pa.int32())],
                ["id", "piece", "start", "length", "ids_crc32", "nth", "task"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task int"
    )


class PairSums:
    """The lengths that occur, by the sum of two of them."""

    def __init__(self, lengths: np.ndarray, most: int):
        low, high = np.meshgrid(lengths, lengths, indexing="ij")
        total = np.where(low <= high, low + high, most + 1).ravel()
        order = np.argsort(total, kind="stable")
        self.edge = np.searchsorted(total[order], np.arange(most + 2))
        self.low = low.ravel()[order[: self.edge[-1]]]

    def find(self, have: np.ndarray, total: int) -> tuple[int, int] | None:
        """Two available lengths of that sum, the most even counts first."""
        low = self.low[self.edge[total] : self.edge[total + 1]]
        if not len(low):
            return None
        most = np.minimum(have[low], have[total - low])
        if 2 * low[-1] == total:
            most[-1] = have[low[-1]] // 2
        if not most.max():
            return None
        a = int(low[most.argmax()])
        return a, total - a


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each within the capacity, and how many sequences have each."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    pairs = PairSums(np.nonzero(have)[0], capacity)

    def use(pattern: tuple[int, ...]) -> None:
        need = np.bincount(pattern, minlength=capacity + 1)
        n = int((have[need > 0] // need[need > 0]).min())
        have[:] -= n * need
        plan.append((pattern, n))

    def fits(pattern: tuple[int, ...]) -> bool:
        return all(have[x] >= pattern.count(x) for x in set(pattern))

    left: dict[int, int] = {}
    for first in range(capacity, 0, -1):
        while have[first]:
            gap = capacity - first
            if not gap:
                use((first,))
            elif fits((first, gap)):
                use((first, gap))
            elif (two := pairs.find(have, gap)) and fits((first, *two)):
                use((first, *two))
            else:
                for third in np.nonzero(have[1 : max(gap - 1, 1)])[0][::-1] + 1:
                    two = pairs.find(have, gap - int(third))
                    if two and fits((first, int(third), *two)):
                        use((first, int(third), *two))
                        break
                else:
                    left[first], have[first] = int(have[first]), 0
    return plan + _best_fit(left, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for many equal pieces at once."""
    open_by_gap: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, bool)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fit = np.nonzero(gaps[length:])[0]
            if len(fit):
                gap = length + int(fit[0])
                pattern, m = open_by_gap[gap].pop()
                gaps[gap] = bool(open_by_gap[gap])
                used, each = min(n, m), 1
                if m > used:
                    open_by_gap[gap].append([pattern, m - used])
                    gaps[gap] = True
                pattern, gap = (*pattern, length), gap - length
            else:
                # new sequences, each with as many of this length as go in
                each = min(capacity // length, n)
                used, pattern, gap = n // each, (length,) * each, capacity - length * each
            open_by_gap.setdefault(gap, []).append([pattern, used])
            gaps[gap] = True
            n -= used * each
    return [(p, n) for rows in open_by_gap.values() for p, n in rows]


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (length, nth, task, ...) with sequence_id and offset for each row."""
    counts = written(found.groupBy("task", "length").agg(F.count("*").alias("n")), "length_counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    slots, first_sequence = [], 0
    next_rank = dict.fromkeys(histogram, 0)
    for pattern, n in pack(histogram, capacity):
        offset = 0
        for length in pattern:
            slots.append((length, next_rank[length], first_sequence, offset))
            next_rank[length] += n
            offset += length
        first_sequence += n
    if next_rank != histogram:
        raise AssertionError("the plan and the histogram of lengths differ")
    # a slot takes the ranks of its length from its own first to the next slot's
    slots.sort()
    length, rank, sequence, offset = (np.array(x, np.int64) for x in zip(*slots, strict=True)) if slots else (np.empty(0, np.int64),) * 4
    wide = np.int64(1 << 48)
    plan = found.sparkSession.sparkContext.broadcast((length * wide + rank, rank, sequence, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, sequence, offset = plan.value
        for b in batches:
            mine = b.column("rank").to_numpy()
            at = np.searchsorted(key, b.column("length").to_numpy() * wide + mine, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sequence[at] + mine - low[at]), pa.array(offset[at])],
                [*b.schema.names, "sequence_id", "offset"],
            )

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "task")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long").drop("rank")


def packed(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cache: int = CACHE
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    The pieces are written once, so that their numbers within a task hold for all that follows.
    """
    found = written(pieces(docs, tokenizer, id_col, text_col, capacity, cache), "pieces")
    return placed(found, capacity).select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
