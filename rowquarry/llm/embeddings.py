"""Embedding near-duplicates by spherical k-means cells and blocked cosines (operator 6).

Each label's vectors get their own cells; a label of few vectors is one cell. Every vector has a home
cell, that of its nearest centre. A linked pair x, y with homes a, b obeys x.a >= x.b and
|x - y| <= r, r = sqrt(2 - 2 * threshold), hence y.b - y.a <= r * |b - a|; and the angle between y
and a is at most a's radius (the largest angle of its vectors) and that of the threshold. Of two
cells one is visited from the other: each vector of that other cell for which both hold visits it,
so every pair of vectors meets in one cell and nothing is missed at cell borders.

A large cell is dealt out in blocks of home vectors, each compared with all vectors of the cell.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing and form their own group; a row without an id links
with nothing and has no group (null); vectors of another length do not link. Identical vectors of a label are compared once, with their number as weight. An empty
table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written
from .graph import components, forest

THRESHOLD = 0.98
#: Vectors that the centres are fitted on (every vector is assigned and compared).
SAMPLE = 32_768
#: Most centres of all labels: with the sample it bounds what the driver fits and what is broadcast.
MAX_CELLS = 2_048
#: Vectors of a cell, as far as ``MAX_CELLS`` allows.
CELL = 4_096
#: Home vectors that a task holds, and vectors that it compares with them at once.
BLOCK, CHUNK = 4_096, 512
#: Links held before they are contracted to a spanning forest.
LINKS = 1 << 18
#: Slack for rounding in the border test.
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centres of unit rows; a cell left empty keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # components near the limits of double do not overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Cells:
    """The centres of the labels that have several cells; all others have the one cell 0."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres

    def similarities(self, label: int, x: np.ndarray) -> np.ndarray:
        """Cosines with the label's centres; without centres one column of ones."""
        centres = self.centres.get(label)
        return np.ones((len(x), 1)) if centres is None else x @ centres.T


def _by_label(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(label, rows, vectors) of a batch."""
    label, x = batch.column("label").to_numpy(), _matrix(batch.column("embedding"), dim)
    order = np.argsort(label, kind="stable")
    edge = np.nonzero(np.diff(label[order]))[0] + 1
    for rows in np.split(order, edge) if len(order) else ():
        yield int(label[rows[0]]), rows, x[rows]


def _homes(shared, dim: int):
    """Each vector with its home cell and its cosine with that centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                cell, near = np.zeros(b.num_rows, np.int32), np.ones(b.num_rows)
                for label, rows, x in _by_label(b, dim):
                    sims = shared.value.similarities(label, x)
                    cell[rows] = sims.argmax(axis=1)
                    near[rows] = sims.max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("rep", "label", "w", "embedding")), pa.array(cell), pa.array(near)],
                    ["rep", "label", "w", "embedding", "cell", "near"],
                )

    return run


def _visits(shared, radius_of, dim: int, threshold: float):
    """Rows (label, cell, rep, w, embedding) of each vector for each cell that it visits."""
    r, wide = (2 - 2 * threshold) ** 0.5, np.arccos(threshold) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                home, rows_out, cells_out = b.column("cell").to_numpy(), [], []
                for label, rows, x in _by_label(b, dim):
                    centres = shared.value.centres.get(label)
                    if centres is None:
                        continue
                    own = home[rows]
                    sims = x @ centres.T
                    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
                    other = np.arange(len(centres))
                    # of two cells, one is visited: by turns, so that no cell does all the visiting
                    turn = (own[:, None] < other) == ((own[:, None] + other) % 2 == 1)
                    go = turn & (own[:, None] != other)
                    go &= sims[np.arange(len(rows)), own][:, None] - sims <= r * apart[own] + SLACK
                    go &= np.arccos(np.clip(sims, -1, 1)) <= radius_of.value[label] + wide
                    row, cell = np.nonzero(go)
                    rows_out.append(rows[row]), cells_out.append(cell)
                if rows_out:
                    row, cell = np.concatenate(rows_out), np.concatenate(cells_out).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("label").take(pa.array(row)), pa.array(cell)]
                        + [b.column(c).take(pa.array(row)) for c in ("rep", "w", "embedding")],
                        ["label", "cell", "rep", "w", "embedding"],
                    )

    return run


#: A row's part in a block: one of its home vectors; another home vector of the cell; a visitor.
HELD, HOME, VISITOR = 0, 1, 2


class Block:
    """Home vectors of a block, their counts so far and a spanning forest of the links found."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids = None
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.visitors: list[tuple[np.ndarray, np.ndarray]] = []

    def close(self) -> None:
        """All home vectors are there: compare them with each other."""
        if self.ids is None and self.parts:
            self.ids, self.x, self.w = (np.concatenate(z) for z in zip(*self.parts, strict=True))
            self.counts = np.zeros(len(self.ids), np.int64)
            self.parts = []
            self.meet(self.ids, self.x, self.w, HELD)

    def meet(self, ids: np.ndarray, x: np.ndarray, w: np.ndarray, role: int) -> None:
        for s in range(0, len(ids), CHUNK):
            e = s + CHUNK
            near = self.x @ x[s:e].T >= self.threshold
            self.counts += near @ w[s:e]
            i, j = np.nonzero(near)
            if role == VISITOR:
                count = np.bincount(j, self.w[i], minlength=len(ids[s:e])).astype(np.int64)
                self.visitors.append((ids[s:e][count > 0], count[count > 0]))
            apart = self.ids[i] != ids[s:e][j]
            if apart.any():
                self.links.append((self.ids[i][apart], ids[s:e][j][apart]))
                self.held += int(apart.sum())
                if self.held > LINKS:
                    self.contract()

    def contract(self) -> None:
        if self.links:
            self.links = [forest(*(np.concatenate(z) for z in zip(*self.links, strict=True)))]
            self.held = len(self.links[0][0])

    def out(self) -> pa.RecordBatch | None:
        """Rows (a, a, n) of counts and (a, b, 0) of links."""
        self.close()
        if self.ids is None:
            return None
        self.contract()
        a, b = self.links[0] if self.links else (np.empty(0, np.int64),) * 2
        who, n = (np.concatenate(z) for z in zip((self.ids, self.counts), *self.visitors, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([who, a])), pa.array(np.concatenate([who, b])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))],
            ["a", "b", "n"],
        )


def _compare(threshold: float, dim: int):
    """Rows sorted by (label, cell, block, role): the block's home vectors are held, the others stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, Block(threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "cell", "block", "role")])
            rep, w = batch.column("rep").to_numpy(), batch.column("w").to_numpy()
            vectors = _matrix(batch.column("embedding"), dim)
            edge = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), len(rep)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                now, role = tuple(keys[:3, lo]), keys[3, lo]
                if now != key:
                    if (out := block.out()) is not None:
                        yield out
                    key, block = now, Block(threshold)
                if role == HELD:
                    block.parts.append((rep[lo:hi], vectors[lo:hi], w[lo:hi]))
                else:
                    block.close()
                    if block.ids is not None:
                        block.meet(rep[lo:hi], vectors[lo:hi], w[lo:hi], role)
        if (out := block.out()) is not None:
            yield out

    return run


def _fit(part: DataFrame, vectors: int, sample: int) -> dict[int, np.ndarray]:
    """The centres of the labels that have several cells, from at most ``sample`` of their vectors."""
    size = max(CELL, -(-vectors // MAX_CELLS))
    counts = part.groupBy("label").count().where(F.col("count") > size)  # at most MAX_CELLS rows
    many = {r["label"]: r["count"] for r in counts.toLocalIterator()}
    if not many:
        return {}
    chosen = part.join(F.broadcast(counts.select("label")), "label", "left_semi").orderBy(F.xxhash64("rep"), "rep").limit(sample)
    by_label: dict[int, list] = {}
    for r in chosen.select("label", "embedding").toLocalIterator():
        by_label.setdefault(r[0], []).append(r[1])
    found = {}
    for label, rows in by_label.items():
        cells = min(-(-many[label] // size), len(rows) // 8)
        if cells > 1:
            x = np.array(rows, np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            found[label] = kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), cells)
    return found


def _links(part: DataFrame, vectors: int, dim: int, kind: str, threshold: float, sample: int) -> DataFrame:
    """(a, a, n) and (a, b, 0) of the vectors of one length."""
    context = part.sparkSession.sparkContext
    cells = Cells(_fit(part, vectors, sample))
    shared = context.broadcast(cells)
    homes = part.select("rep", "label", "w", "embedding").mapInArrow(
        _homes(shared, dim), f"rep long, label long, w long, embedding {kind}, cell int, near double"
    )
    homes = written(homes, "homes")
    sizes = homes.groupBy("label", "cell").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("near").alias("near")
    )
    sizes = written(sizes, "sizes")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    held = F.array(F.struct(own.alias("block"), F.lit(HELD).alias("role")))
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.transform(F.array_except(all_blocks, F.array(own)), lambda i: F.struct(i.alias("block"), F.lit(HOME).alias("role")))
    columns = ["label", "cell", "rep", "w", "embedding"]

    def dealt(rows: DataFrame, to) -> DataFrame:
        return rows.join(sizes.select("label", "cell", "blocks"), ["label", "cell"]).select(
            *columns, F.explode(to).alias("to")
        ).select(*columns, "to.block", "to.role")

    rows = dealt(homes.select(*columns), F.concat(held, others))
    if cells.centres:
        radius = {label: np.full(len(c), -np.inf) for label, c in cells.centres.items()}  # of an empty cell: none visits
        wanted = context.broadcast(set(radius))
        labels = sizes.sparkSession.createDataFrame([(k,) for k in wanted.value], "label long")
        for r in sizes.join(F.broadcast(labels), "label", "left_semi").toLocalIterator():
            radius[r.label][r.cell] = np.arccos(np.clip(r.near, -1, 1))
        guests = homes.join(F.broadcast(labels), "label", "left_semi").mapInArrow(
            _visits(shared, context.broadcast(radius), dim, threshold), f"label long, cell int, rep long, w long, embedding {kind}"
        )
        visit = F.transform(all_blocks, lambda i: F.struct(i.alias("block"), F.lit(VISITOR).alias("role")))
        rows = rows.unionByName(dealt(guests, visit))
    runs = rows.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role")
    return runs.mapInArrow(_compare(threshold, dim), "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, n_links long, component_id long) for every row; ids are unique.

    Compares vectors of equal, non-null labels. The centres are fitted on at most ``sample``
    vectors; all are assigned and compared. Only a spanning forest of the links leaves a task.
    """
    v = F.col("embedding")
    source = vectors.schema[vector_col].dataType.simpleString()
    kind = source if source == "array<float>" else "array<double>"  # floats travel as they are, half the bytes
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("embedding"),
        F.col(label_col).alias("label"),
    )
    usable = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
            v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        ) & F.exists(v, lambda c: c != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable")
    distinct = good.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    # labels of any type become dense-free text keys once; vectors of each length are compared apart
    distinct = written(
        distinct.select("rep", "w", "embedding", F.size("embedding").alias("dim"), F.col("label").alias("class"),
                        F.xxhash64(F.col("label").cast("string")).alias("label")), "distinct",
    )
    edges = None
    for dim, n in sorted(tuple(r) for r in distinct.groupBy("dim").count().collect()):
        found = _links(distinct.where(F.col("dim") == dim), n, dim, kind, threshold, sample)
        edges = found if edges is None else edges.union(found)
    if edges is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    edges = written(edges, "links")
    # rows (a, a, n) add up to the weights within a vector's reach, itself and its copies included
    counts = edges.where("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(edges.where("a <> b").select("a", "b"))
    known = (
        distinct.join(counts, distinct.rep == counts.a, "left")
        .join(groups, F.col("rep") == groups.node, "left")
        .select(
            F.col("class").alias("label"), "embedding", (F.coalesce("n", "w") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = good.select("id", "label", "embedding").join(known, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
