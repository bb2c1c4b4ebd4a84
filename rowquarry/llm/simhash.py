"""SimHash near-duplicate groups by deletion-variant signatures (operator 3).

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four bits
differ in at most one bit of some segment (3 * 2 > 4). So each fingerprint is indexed once per
bit: its segment with that bit made a wildcard. Equal keys are candidates, verified bit by bit.

Defined results: a null text is an empty one; a text without words has fingerprint zero and is
linked like any other; repeated rows and ties end in the group of the smallest id; an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, raw_texts, slices, written
from .graph import components, copies, forest, salted

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key from which it is cut further, by groups of the bits outside its segment.
LARGE = 2_048
#: Shingles hashed at once.
BLOCK = 1 << 16
#: Links held before they are contracted to a spanning forest.
LINKS = 1 << 18


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a whole text: a bit is set if it is in over half the shingles' hashes."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.lower().split()  # on bytes: A-Z only, and only the ASCII white space
    n = len(words)
    if not n:
        return 0
    if n < shingle_words:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: n - shingle_words + 1]
    end = end[shingle_words - 1 :]
    del words
    ones = np.zeros(64, np.int64)
    for at in range(0, len(start), BLOCK):
        spans = zip(start[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([h(joined[i:j], SEED) for i, j in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in raw_texts(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def variant_keys(fp):
    """One key per bit: the bit's number above its segment's value with that bit cleared."""
    keys = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append(segment.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((first + bit) << 32)))
    return F.array(*keys)


def _groups_of_bits(key: int, max_bits: int) -> list[np.uint64]:
    """Masks of the bits outside the key's segment, one more than may differ: one of them is equal."""
    bit = key >> 32
    first, width = next(s for s in SEGMENTS if s[0] <= bit < sum(s))
    free = [b for b in range(64) if not first <= b < first + width]
    return [np.uint64(sum(1 << int(b) for b in part)) for part in np.array_split(free, max_bits + 1)]


def _run_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_links``; runs of many fingerprints are compared only where a group of further bits is equal."""
    edge = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
    large = np.nonzero(np.diff(edge) > LARGE)[0]
    if not len(large):
        return _links(key, fp, max_bits)
    small = np.ones(len(key), bool)
    found = []
    for r in large.tolist():
        lo, hi = edge[r], edge[r + 1]
        small[lo:hi] = False
        for mask in _groups_of_bits(int(key[lo]), max_bits):
            part = (fp[lo:hi].view(np.uint64) & mask).view(np.int64)
            order = np.argsort(part, kind="stable")
            found.append(_links(part[order], fp[lo:hi][order], max_bits))
    found.append(_links(key[small], fp[small], max_bits))
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links within runs of equal keys.

    Compares each row with the d-th after it, for growing d, in all runs at once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    at = np.arange(len(key) - 1)
    d = 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= max_bits]
        if len(near):
            found.append((fp[near], fp[near + d]))
            held += len(near)
            if held > LINKS:
                found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                held = len(found[0][0])
        d += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _linker(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k, f = b.column("key").to_numpy(), b.column("fp").to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut or (last is not None and last != k[-1]):
                parts.append((k[:cut], f[:cut]))
                a, c = _run_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])
                parts = []
            parts.append((k[cut:], f[cut:]))
            last = k[-1]
        if parts:
            a, c = _run_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(id, fp long, component_id long) for every row of ``docs``.

    Fingerprints are compared once each; copies only join back. Rows of one key lie sorted in one
    task, which sends on a spanning forest of its links, so a large group of near copies makes no
    more rows than it has members.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"three segments find differences of at most {MAX_BITS + 1} bits; {MAX_BITS} are supported")
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    keyed = distinct.select(F.explode(variant_keys(F.col("fp"))).alias("key"), "fp")
    runs = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = components(runs.mapInArrow(_linker(max_bits), "a long, b long"))
    # fingerprints of a group meet its smallest id in parts, so that a large group is no task's alone
    known = distinct.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left")
    linked = distinct.join(found.select("component").distinct(), distinct.fp == F.col("component"), "left_semi")
    linked = known.where("root is not null").unionByName(linked.withColumn("root", F.col("fp")))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id")).select("*", copies())
    linked = linked.select("fp", "root", salted("fp")).join(least, ["root", "salt"]).select("fp", "component_id")
    whole = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # written, so that the last join is one that Spark may split where copies share a fingerprint
    whole = written(whole, "groups")
    return fps.join(whole, "fp").select("id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
