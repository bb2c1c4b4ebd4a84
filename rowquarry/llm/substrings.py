"""Substring deduplication over a log-structured fingerprint index (operator 9).

A window is ``WINDOW`` consecutive words of a document. Of the hashes of the shorter word runs in a
window, the smallest is its fingerprint: equal windows have equal fingerprints, and a document has
about one fingerprint per five windows. The index holds immutable runs of (fingerprint, document),
each bucketed and sorted by fingerprint, in as many buckets as the index was made with. A new batch
is written as a run and merge-joined, bucket by bucket and without a shuffle, with itself and with
each run of history; only documents that share a fingerprint are read again. Runs are compacted into
one by merging them two at a time, bucket by bucket as well.

Windows that share a fingerprint are verified by 112 bits of two independent hashes of their whole
word sequences, from independent hashes of the words: among 10^13 windows a wrong match anywhere is
less likely than one in ten million. The words themselves would be five times as much to shuffle.

Whatever many documents hold is combined before it is shuffled: a block of documents sends one row
of a fingerprint or window that several of them hold, so no task receives more rows of a key than
there are blocks.

Defined results: a null or empty text has no words and keeps the empty text; texts of fewer than
``WINDOW`` words lose nothing; a window that repeats within one document alone stays; rows that
repeat an id count as one document of that id, each with its own result (ids are expected to be
unique); rows without an id are not compared and lose nothing; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, raw_texts, shared_path, slices, written

WINDOW = 13
#: Words of the runs whose smallest hash is a window's fingerprint.
RUN = 5
#: Bytes of texts whose words are found and hashed at once (a text is never split): arrays that fit a core's cache.
STRETCH = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
#: Runs of an index before they are compacted.
MOST_RUNS = 8
#: Batches of documents, by id, that the query feeds to its index.
BATCHES = 2
#: Documents of history that are chosen by a broadcast list (8 bytes each), beyond it by a shuffle.
BROADCAST_IDS = 1_000_000
#: Fingerprints or windows that a task holds and combines at once.
BLOCK = 1_500_000

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


_LENGTH = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
_TURN = np.uint64(1), np.uint64(0xE7037ED1A0B428DB)
#: What a word has of the eight bytes that are read, by its bytes from there on.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """The words of texts, found and hashed all at once: the work of a word is a few array operations."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join([b"", *texts, b" " * 8])
        self.bytes = np.frombuffer(self.raw, np.uint8)
        white = (self.bytes == 0x20) | (self.bytes - np.uint8(9) < 5)
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        self.length = self.end - self.start
        #: The number of each text's first word, and of all words.
        self.first = np.searchsorted(self.start, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        self.counts = np.diff(self.first)
        #: The number of each word's text.
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, family: int) -> np.ndarray:
        """64-bit hashes of the words; the two families, 0 and 1, are independent."""
        eight = np.ndarray(len(self.raw) - 7, "<u8", self.raw, 0, (1,))  # at every byte
        h = self.length.astype(np.uint64) * _LENGTH[family]
        h ^= eight[self.start] & _OWN[np.minimum(self.length, 8)]
        h = _mixed(h * _TURN[family])
        done, rest = 8, np.flatnonzero((self.length > 8) & (self.length <= LONG))
        while len(rest):
            part = eight[self.start[rest] + done] & _OWN[np.minimum(self.length[rest] - done, 8)]
            h[rest] = _mixed((h[rest] ^ part) * _TURN[family])
            done += 8
            rest = rest[self.length[rest] > done]
        for n in np.flatnonzero(self.length > LONG).tolist():
            import xxhash

            both = xxhash.xxh3_128_intdigest(self.raw[self.start[n] : self.end[n]], 7)
            h[n] = both >> 64 * family & 0xFFFFFFFFFFFFFFFF
        return h

    def windows(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the windows; which of these begin a row of windows of one text and fingerprint; these fingerprints."""
        fp = window_fingerprints(low)
        at = np.flatnonzero(self.text[WINDOW - 1 :] == self.text[: len(fp)])
        fp, text = fp[at], self.text[at]
        new = np.ones(len(at), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (text[1:] != text[:-1])
        new = np.flatnonzero(new)
        return at, new, fp[new]


def _stretches(texts: list[bytes]) -> Iterator[slice]:
    """Neighbouring texts of about ``STRETCH`` bytes."""
    at = held = 0
    for n, text in enumerate(texts, 1):
        held += len(text) + 1
        if held >= STRETCH or n == len(texts):
            yield slice(at, n)
            at, held = n, 0


class WordHashes:
    """Two independent 64-bit hashes of words."""

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = Words([b" ".join(words)])
        return found.hashes(0), found.hashes(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def _rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes: a polynomial in ``base``, its length doubled by each two operations."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = out = _mixed(h ^ base)
    size = 1
    for bit in f"{n:b}"[1:]:
        power = np.uint64(pow(int(base), size, 1 << 64))
        longer = out[: len(out) - size] * power
        longer += out[size:]
        out, size = longer, 2 * size
        if bit == "1":
            longer = out[:-1] * base
            longer += m[size:]
            out, size = longer, size + 1
    return _mixed(out)


def window_fingerprints(h: np.ndarray) -> np.ndarray:
    """The fingerprint of each window, from the hashes of the words."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64)
    low, size = _rolled(h, RUN, _BASE[0]), 1
    while size < WINDOW - RUN + 1:
        step = min(size, WINDOW - RUN + 1 - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    return low


def _order(key: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """The order by ``key``, then ``rest``: only where keys repeat is the rest looked at."""
    order = np.argsort(key)
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = key[order[1:]] != key[order[:-1]]
    again = ~(new[1:] & new[:-1])
    some = order[again]
    order[again] = some[np.lexsort((*(r[some] for r in reversed(rest)), key[some]))]
    return order


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


#: Columns of a run: a fingerprint, the first document of a block that has it, and the block's others.
COLUMNS = "fp long, id long, others array<long>"


def fingerprints(rows: DataFrame) -> DataFrame:
    """One row for each fingerprint of a block of documents; ``others`` is null if one document has it."""

    def block(fps: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        fp, owner = np.concatenate(fps), np.concatenate(owners)
        order = _order(fp, owner)
        fp, owner = fp[order], owner[order]
        if len(fp):  # rows that repeat an id
            new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])])
            fp, owner = fp[new], owner[new]
        first = np.concatenate([[True], fp[1:] != fp[:-1]]) if len(fp) else np.empty(0, bool)
        more = np.diff(np.append(np.nonzero(first)[0], len(fp))) - 1
        offsets = pa.array(np.concatenate([[0], np.cumsum(more)]).astype(np.int32), mask=np.append(more == 0, False))
        others = pa.ListArray.from_arrays(offsets, pa.array(owner[~first]))
        return pa.RecordBatch.from_arrays([pa.array(fp[first]), pa.array(owner[first]), others], ["fp", "id", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, owners, held = [], [], 0
        for b in slices(batches):
            ids, texts = b.column("id").to_numpy(), raw_texts(b, "text")
            for part in _stretches(texts):
                words = Words(texts[part])
                at, new, fp = words.windows(words.hashes(0))
                fps.append(fp.view(np.int64)), owners.append(ids[part][words.text[at[new]]])
                held += len(fp)
            if held >= BLOCK:
                yield block(fps, owners)
                fps, owners, held = [], [], 0
        if fps:
            yield block(fps, owners)

    return rows.where("id is not null").mapInArrow(run, COLUMNS)


def _members(rows: DataFrame) -> DataFrame:
    """(id, fp) of every document in the rows of a run."""
    others = F.coalesce("others", F.array().cast("array<long>"))
    return rows.select(F.explode(F.concat(F.array("id"), others)).alias("id"), "fp")


class SubstringIndex:
    """Fingerprints of all documents seen, in immutable bucketed and sorted runs under one path.

    A run's folder name ends in its number of buckets; all runs of an index have the same. Runs are
    read as tables at their own path, so an index can be opened by another session.
    """

    KEEP_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        held = [int(r.rpartition("-")[2]) for r in self.runs()]
        self.buckets = held[0] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(self.KEEP_ORDER, "true")  # one file per bucket: scans come sorted

    def _fs(self, path: str):
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def runs(self) -> list[str]:
        """Paths of the whole runs, oldest first; a run that was not finished is not one."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("run-"))
        return [f"{self.path}/{n}" for n in names if fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]

    @staticmethod
    def _name(run: str) -> str:
        return "rowquarry_" + hashlib.md5(run.encode()).hexdigest()

    def open(self, run: str) -> DataFrame:
        name = self._name(run)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY (fp) SORTED BY (fp, id) INTO {self.buckets} BUCKETS LOCATION '{run}'"
        )
        return self.spark.table(name)

    def close(self) -> None:
        """Take the runs' names out of the session; the runs stay."""
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")

    def read(self) -> DataFrame:
        found = self.spark.createDataFrame([], COLUMNS)
        for run in self.runs():
            found = found.union(self.open(run))
        return found

    def _write(self, rows: DataFrame) -> str:
        """``rows``, dealt out by bucket, as a new run."""
        runs = self.runs()
        number = int(runs[-1].split("-")[-2]) + 1 if runs else 0
        run = f"{self.path}/run-{number:06d}-{self.buckets}"
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        writer = rows.write.mode("overwrite").bucketBy(self.buckets, "fp").sortBy("fp", "id")
        writer.option("path", run).option("compression", "zstd").saveAsTable(self._name(run))
        return run

    def append(self, rows: DataFrame) -> str:
        """Write the fingerprints of ``rows`` (id, text) as one run."""
        return self._write(fingerprints(rows).repartition(self.buckets, "fp"))

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        fs, at = self._fs(run)
        fs.delete(at, True)

    def merged(self, one: str, other: str) -> DataFrame:
        """Two runs merged bucket by bucket; no shuffle and no sort but within a bucket."""
        a, b = self.open(one), self.open(other).withColumnRenamed("others", "more")
        both = a.hint("merge").join(b, ["fp", "id"], "full_outer")
        # a document that was fed twice may have others of two blocks
        others = F.when(F.col("others").isNotNull() & F.col("more").isNotNull(), F.array_union("others", "more"))
        return both.select("fp", "id", F.coalesce(others, "others", "more").alias("others"))

    def compact(self) -> None:
        """Merge all runs into one, two at a time; the old ones go when the new one is whole."""
        before = self.spark.conf.get(self.ALL_KEYS)
        self.spark.conf.set(self.ALL_KEYS, "false")  # buckets of fp serve a join on (fp, id)
        try:
            while len(runs := self.runs()) > 1:
                for one, other in zip(runs[::2], runs[1::2], strict=False):
                    self._write(self.merged(one, other))
                    self._drop(one), self._drop(other)
        finally:
            self.spark.conf.set(self.ALL_KEYS, before)

    def deduplicate(
        self, batch: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
    ) -> DataFrame:
        """(id, n_words, n_removed, kept) of every row of ``batch``; its fingerprints join the index.

        ``history`` has the documents that the index already holds; a window counts as seen if it
        starts in a document of a smaller id there or in the batch. The rows are found before the
        index changes again: write them before the next batch.
        """
        before = self.runs()
        if before and history is None:
            raise ValueError("the index holds earlier batches: their documents are needed to verify windows")
        if len(before) >= MOST_RUNS:
            self.compact()
            before = self.runs()
        new = _rows(batch, id_col, text_col)
        run = self.open(self.append(new))
        shared = self.within(run)
        rows = named = _squeezed(new)
        for held in map(self.open, before):
            mine, theirs = self.across(run, held)
            needed = written(theirs, "history_fingerprints")
            shared = shared.unionByName(mine).unionByName(needed)
            rows = rows.unionByName(_squeezed(self.chosen(_rows(history, id_col, text_col), needed)))
        flagged = self.flagged(rows, shared.groupBy("id").agg(F.collect_list("fp").alias("fps")))
        # both joins deal the squeezed texts out by id: without a history Spark shuffles them once
        whole = named.join(flagged, "id", "left").select("id", "z", "start", "starts")
        unnamed = new.where("id is null").mapInArrow(_squeeze, "id long, z binary")
        unnamed = unnamed.select("*", F.lit(None).cast("array<int>").alias("start"), F.lit(None).cast("array<binary>").alias("starts"))
        return whole.unionByName(unnamed).mapInArrow(_cut, "id long, n_words long, n_removed long, kept string")

    def within(self, run: DataFrame) -> DataFrame:
        """(id, fp): fingerprints that another document of the run has too."""
        often = run.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
        alone = run.where("others is null").hint("merge").join(often, "fp", "left_semi").select("id", "fp")
        return _members(run.where("others is not null")).unionByName(alone)

    def across(self, run: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, fp): fingerprints that a new run and an older one share, with the documents of either.

        Of the new run those that ``within`` does not give.
        """
        alone = run.where("others is null")
        one = alone.hint("merge").join(held.select("fp"), "fp", "left_semi").select("id", "fp")
        other = held.hint("merge").join(run.select("fp"), "fp", "left_semi")
        return one, _members(other)

    def chosen(self, history: DataFrame, needed: DataFrame) -> DataFrame:
        """The documents of history that ``needed`` names, by a list as long as it is short."""
        ids = written(needed.select("id").distinct(), "history_ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return history.join(ids, "id", "left_semi")

    def flagged(self, rows: DataFrame, shared: DataFrame) -> DataFrame:
        """(id, start array<int>, starts array<binary>): windows that start in a document of a smaller id.

        Those settled within a block come packed, the others one by one: their number follows the
        text, however many tasks compare them.
        """
        windows = rows.join(shared, "id").select("id", "z", "fps").mapInArrow(
            _windows, "key long, tag long, id long, starts binary"
        )
        later = windows.repartition("key").sortWithinPartitions("key", "id")
        later = later.mapInArrow(_later, "id long, start int, starts binary")
        return later.groupBy("id").agg(F.collect_list("start").alias("start"), F.collect_list("starts").alias("starts"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a shared fingerprint: (key, tag, id) are two hashes, the start and the document.

    Of a window that several documents of a block have, only the smallest document's row is sent on
    as such, once however often the window stands in it; for the others it is settled, and their
    starts travel packed.
    """
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for b in slices(batches, 64):
        ids, texts, fps = b.column("id").to_numpy(), _texts(b), b.column("fps")
        for part in _stretches(texts):
            words = Words(texts[part])
            low = words.hashes(0)
            at, new, fp = words.windows(low)
            if not len(at):
                continue
            # a fingerprint that one of these texts shares is shared by all of them that have it
            wanted = np.unique(fps[part].flatten().to_numpy().view(np.uint64))
            place = np.minimum(np.searchsorted(wanted, fp), len(wanted) - 1)
            at = at[np.repeat(wanted[place] == fp, np.diff(new, append=len(at)))]
            one, two = (_rolled(h, WINDOW, base)[at] for h, base in zip((low, words.hashes(1)), _BASE, strict=True))
            text = words.text[at]
            held.append((one.view(np.int64), two >> np.uint64(48), at - words.first[text], ids[part][text]))
            count += len(at)
        if count >= BLOCK:
            yield _settled(held)
            held, count = [], 0
    if count:
        yield _settled(held)


def _settled(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    one, two, start, owner = (np.concatenate(x) for x in zip(*held, strict=True))
    order = _order(one, two, owner)
    one, two, start, owner = one[order], two[order], start[order], owner[order]
    first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    least = owner[np.maximum.accumulate(np.where(first, np.arange(len(one)), 0))]
    known = owner > least
    # rows are sorted by window, then document; starts of one document follow each other
    again = ~first & (owner == np.concatenate([owner[:1], owner[:-1]]))
    repeated = np.concatenate([again[1:], [False]])
    who, packed = _packed(owner[known], start[known])
    open_ = ~known & ~again
    n, m = int(open_.sum()), len(who)
    tag = (two[open_] << np.uint64(48) | repeated[open_].astype(np.uint64) << np.uint64(47) | start[open_].astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([one[open_], who])),  # settled rows are dealt out by their document
            pa.array(np.concatenate([tag, np.zeros(m, np.int64)])),
            pa.array(np.concatenate([owner[open_], who])),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(packed, pa.binary())]),
        ],
        ["key", "tag", "id", "starts"],
    )


def _packed(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each document once, with its starts as 32-bit integers."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order].astype("<i4")
    edge = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0] if len(owner) else np.empty(0, np.int64)
    return owner[edge], [x.tobytes() for x in np.split(start, edge[1:])] if len(edge) else []


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (key, id): those that a smaller document has as well, and the settled ones.

    The start of a window that stands in its document more than once comes as ``-1 - start``.
    """
    last = None  # key, second hash and document of the first row of the run so far
    for b in batches:
        done = b.filter(b.column("starts").is_valid())
        b = b.filter(b.column("starts").is_null())
        key, tag, owner = (b.column(c).to_numpy() for c in ("key", "tag", "id"))
        two, start = tag.view(np.uint64) >> np.uint64(48), tag & 0xFFFFFFFF
        start = np.where(tag >> 47 & 1, -1 - start, start)
        if last is not None:
            key, two, owner, start = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip((*last, 0), (key, two, owner, start), strict=True))
        if len(key):
            first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
            later = (owner > owner[first]) & (two == two[first])
            last = key[first[-1]], two[first[-1]], owner[first[-1]]
            owner, start = owner[later], start[later]
        n, m = len(owner), done.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(owner, pa.int64()), done.column("id")]),
                pa.concat_arrays([pa.array(start.astype(np.int32)), pa.nulls(m, pa.int32())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), done.column("starts")]),
            ],
            ["id", "start", "starts"],
        )


def _squeezed(rows: DataFrame) -> DataFrame:
    """(id, z): the texts of rows with an id, each compressed by itself, as they are shuffled."""
    squeezed = rows.where("id is not null").mapInArrow(_squeeze, "id long, z binary")
    return squeezed.where("id is not null")  # said again, as an inner join says it: equal plans are shuffled once


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for b in slices(batches, 64):
        z = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw_texts(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(z, pa.binary())], ["id", "z"])


def _texts(b: pa.RecordBatch) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True) for z in b.column("z").to_pylist()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept) with the words of the flagged windows removed."""
    for b in slices(batches, 64):
        n, removed, kept = [], [], []
        texts, start, starts = _texts(b), b.column("start"), b.column("starts").to_pylist()
        for part in _stretches(texts):
            words = Words(texts[part])
            gone = _gone(words, start[part], starts[part])
            n.append(words.counts)
            removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first]))
            kept += _left(words, ~gone)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(removed)), pa.array(kept, pa.binary()).cast(pa.string())],
            ["id", "n_words", "n_removed", "kept"],
        )


def _gone(words: Words, start: pa.Array, starts: list[list[bytes] | None]) -> np.ndarray:
    """The words that a flagged window covers."""
    flags = np.zeros(len(words.text), np.int64)
    one = None
    for text, packed in enumerate(starts):
        first, size = words.first[text], words.counts[text] - WINDOW + 1
        if packed is None or size <= 0:
            continue
        own = flags[first : first + size]
        at = start[text].values.to_numpy()
        if (at < 0).any():
            if one is None:
                one = _rolled(words.hashes(0), WINDOW, _BASE[0])
            windows, repeated = one[first : first + size], -1 - at[at < 0]
            own[np.isin(windows, windows[repeated[repeated < size]])] = 1
        for more in (at[at >= 0], np.frombuffer(b"".join(packed), "<i4")):
            own[more[more < size]] = 1
    seen = np.cumsum(flags)
    return seen > np.concatenate([np.zeros(WINDOW, np.int64), seen])[: len(seen)]


def _left(words: Words, stays: np.ndarray) -> list[bytes]:
    """Each text's words that stay, joined by one space."""
    inside = np.zeros(len(words.bytes), np.int8)
    inside[words.start[stays]] = 1
    inside[words.end[stays] + 1] -= 1  # the white space after a word goes with it, as a space
    text = words.bytes.copy()
    text[words.end] = 0x20
    text = text[np.cumsum(inside, dtype=np.int8).view(bool)].tobytes()
    bounds = np.concatenate([[0], np.cumsum((words.length + 1) * stays)])[words.first].tolist()
    return [text[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in ``BATCHES`` batches of growing ids, each merged with the index of those before."""
    docs = documents(spark, sf_dir)
    index = SubstringIndex(spark, shared_path(spark, "substrings"))
    cuts = docs.approxQuantile("doc_id", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    edges = [None, *sorted({int(c) for c in cuts}), None]
    found = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        named = F.lit(True) if low is None else F.col("doc_id") > low
        part = named if high is None else named & (F.col("doc_id") <= high)
        batch = docs.where(part | F.col("doc_id").isNull() if low is None else part)
        history = None if low is None else docs.where(F.col("doc_id") <= low)
        rows = index.deduplicate(batch, history).select(
            F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
        )
        rows = written(rows, "deduplicated")
        found = rows if found is None else found.unionByName(rows)
    index.compact()  # the next batch finds one run
    index.close()
    return found
