"""Near copies by the Jaccard similarity of their sets of word shingles, for the pipeline.

MinHash bands find candidates: texts with equal minima in all ``ROWS`` of one of ``BANDS`` bands. A
pair of similarity 0.8 meets in no band with probability 7e-6, a closer pair with less. Every pair
of candidates that is not yet connected is compared on the whole sets, so no link is an estimate.
Texts of one band key are held ``HOLD`` at a time: a larger key is dealt out in blocks, and each block
also meets the texts of the blocks after it.

Defined results: words are those of the SimHash fingerprint; a text of fewer words than a shingle is
one shingle; a null text is an empty one and all empty texts are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, slices, written

SHINGLE_WORDS = 5
LEAST = 0.8
BANDS, ROWS = 30, 5
SEED = 42
#: Texts of a band key that a task holds.
HOLD = 1_024
#: Shingles of held sets that are compared at once.
AT_ONCE = 1 << 18
#: Shingles hashed at once.
BLOCK = 1 << 10

_RANDOM = np.random.default_rng(SEED)
_SALT = _RANDOM.integers(1 << 64, size=BANDS * ROWS, dtype=np.uint64)
_ODD = _RANDOM.integers(1 << 64, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _RANDOM.integers(1 << 64, size=BANDS, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _B
    return x ^ (x >> _SHIFT)


def shingles(text: bytes) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles."""
    import xxhash

    words = text.lower().split()
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(one) - SHINGLE_WORDS + 1
    whole = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        whole = _mix(whole * _A + one[k : k + n])
    return np.unique(whole)


def bands(own: np.ndarray) -> np.ndarray:
    """One key per band for a set of shingles."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), BLOCK):
        x = (own[at : at + BLOCK, None] ^ _SALT) * _ODD
        x ^= x >> _SHIFT
        x *= _B
        np.minimum(least, x.min(axis=0), out=least)
    key = _BAND
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key * _A + column)
    return key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        keys = [bands(shingles(t)) for t in raw_texts(b, "text")]
        if keys:
            node = np.repeat(b.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node)], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [shingles(t).tobytes() for t in raw_texts(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])


class Held:
    """Shingle sets of a block, and the groups that a similarity of ``LEAST`` or more links."""

    def __init__(self):
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.groups: list[np.ndarray] | None = None

    def near(self, own: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those places ``among`` the held ones whose set is similar to ``own``."""
        size = self.size[among]
        among = among[np.minimum(size, len(own)) >= LEAST * np.maximum(size, len(own))]
        if not len(among):
            return among
        size = self.size[among]
        part = np.cumsum(size) // AT_ONCE  # stretches of about as many shingles, so that long texts don't pile up
        found = [self._same(own, x) for x in np.split(among, np.nonzero(np.diff(part))[0] + 1)]
        same = np.concatenate(found)
        return among[same >= LEAST * (len(own) + size - same) - 1e-9]

    def _same(self, own: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Shingles that each of the sets has in common with ``own``."""
        flat = np.concatenate([self.sets[j] for j in among])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        edge = np.concatenate([[0], np.cumsum(self.size[among])[:-1]])
        return np.add.reduceat(own[place] == flat, edge, dtype=np.int64)

    def close(self) -> list[tuple[int, int]]:
        """Compare the held sets with each other: (node, first node of its group).

        Each set meets all later ones that are not in its group yet, at once.
        """
        if self.groups is not None:
            return []
        self.size = np.array(list(map(len, self.sets)))
        label = np.arange(len(self.sets))
        for i in range(len(self.sets) - 1):
            rest = i + 1 + np.nonzero(label[i + 1 :] != label[i])[0]
            joined = np.unique(label[self.near(self.sets[i], rest)])
            if len(joined):
                group = np.append(joined, label[i])
                label[np.isin(label, group)] = group.min()
        self.groups = [np.nonzero(label == k)[0] for k in np.unique(label)]
        return [(self.nodes[j], self.nodes[g[0]]) for g in self.groups for j in g[1:].tolist()]

    def meet(self, node: int, own: np.ndarray) -> list[tuple[int, int]]:
        """Links of a text to the groups that hold a similar one; of each group as many are compared as it takes."""
        found = []
        for group in self.groups or ():
            at, step = 0, 4
            while at < len(group):
                if len(self.near(own, group[at : at + step])):
                    found.append((node, self.nodes[group[0]]))
                    break
                at, step = at + step, 2 * step
        return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, block, guest): a block's own texts are held, then its guests stream past."""
    now, held = None, Held()
    for batch in batches:
        links: list[tuple[int, int]] = []
        columns = (batch.column(c).to_pylist() for c in ("key", "block", "guest", "node", "shingles"))
        for key, block, guest, node, own in zip(*columns, strict=True):
            if (key, block) != now:
                links += held.close()
                now, held = (key, block), Held()
            if guest:
                links += held.close()
                links += held.meet(node, np.frombuffer(own, np.uint64))
            else:
                held.nodes.append(node), held.sets.append(np.frombuffer(own, np.uint64))
        yield _links(links)
    yield _links(held.close())


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar(rows: DataFrame) -> DataFrame:
    """(a long, b long): links that connect every pair of similar texts of ``rows`` (node long, text).

    Equal nodes have equal texts. Keys that the same nodes share are compared once.
    """
    keyed = written(rows.mapInArrow(_keys, "key long, node long").distinct(), "bands")
    met = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("mark")
    )
    once = met.where("n > 1").groupBy("n", "least", "mark").agg(F.min("key").alias("key")).select("key", "n")
    members = written(keyed.join(once, "key").select("key", "node", "n"), "members")
    wanted = rows.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = wanted.select("node", "text").mapInArrow(_sets, "node long, shingles binary")
    blocks = F.ceil(F.col("n") / HOLD).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # each text is held by its own block and a guest of those before it
    to = F.transform(F.sequence(F.lit(0), own), lambda k: F.struct(k.alias("block"), (k != own).alias("guest")))
    runs = members.join(sets, "node").select("key", "node", "shingles", F.explode(to).alias("to"))
    runs = runs.select("key", "node", "shingles", "to.*").repartition("key", "block")
    return runs.sortWithinPartitions("key", "block", "guest", "node").mapInArrow(_verified, "a long, b long")
