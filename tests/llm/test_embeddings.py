"""Embedding links against all cosines in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowquarry.llm import embeddings
from rowquarry.llm.embeddings import near_duplicates, op6_embeddings

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.98):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, np.float64) / np.abs(v).max()
            good[i] = (x / np.linalg.norm(x), label)
    root = {i: i for i, *_ in rows}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, p), (y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                s, t = find(a), find(b)
                root[max(s, t)] = min(s, t)
    return {i: (links[i], find(i)) for i in root}


def found(df):
    return {r.id: (r.n_links, r.component_id) for r in df.collect()}


def cloud(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(30)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12, 1.0])
        rows.append((i, (v * rng.choice([1.0, 3.5])).tolist(), int(rng.integers(2))))
    return rows


def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op6_embeddings(spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_many_cells_blocks_and_few_held_links(spark, monkeypatch):
    rows = cloud()
    for cell, block, links in ((30, 40, 50), (100, 20, 1 << 18), (60, 4096, 1 << 18)):
        monkeypatch.setattr(embeddings, "CELL", cell)
        monkeypatch.setattr(embeddings, "BLOCK", block)
        monkeypatch.setattr(embeddings, "CHUNK", 16)
        monkeypatch.setattr(embeddings, "LINKS", links)
        df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("w", F.lit(None))
        assert found(near_duplicates(df)) == brute(rows)


def test_cells_are_bounded_over_all_labels_and_cells_prune(spark, monkeypatch):
    """Clustered vectors visit few of the cells that a label has."""
    monkeypatch.setattr(embeddings, "CELL", 50)
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(20, 24))
    rows = [(i, (spots[i % 20] + 0.1 * rng.normal(size=24)).tolist(), i % 3 % 2) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(near_duplicates(df)) == brute(rows)
    part = df.select(F.col("vec_id").alias("rep"), F.col("label").cast("long").alias("label"), F.lit(1).cast("long").alias("w"), "embedding")
    centres = embeddings._fit(part, 1500, 1000)
    assert {k: len(c) for k, c in centres.items()} == {0: 20, 1: 10}
    monkeypatch.setattr(embeddings, "MAX_CELLS", 4)
    assert sum(len(c) for c in embeddings._fit(part, 1500, 1000).values()) <= 6
    assert found(near_duplicates(df)) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0)]
    rows += [(7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 0)]
    rows += [(12, [1e300, 1e300], 5), (13, [1e-300, 1e-300], 5), (14, [-1.0, 0.0], 0), (15, [1.0, 0.0], 0)]
    assert found(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).isEmpty()
    odd = near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (None, None, None)], SCHEMA))
    assert sorted((r.id or 0, r.n_links, r.component_id or 0) for r in odd.collect()) == [(0, 0, 0), (0, 0, 0), (3, 0, 3)]


@pytest.mark.parametrize("kind", ["array<float>", "array<int>"])
def test_other_component_types(spark, kind):
    df = spark.createDataFrame([(1, [3, 4], "x"), (2, [6, 8], "x"), (3, [4, 3], "x")], f"vec_id long, embedding {kind.replace('float', 'int')}, label string")
    df = df.withColumn("embedding", F.col("embedding").cast(kind))
    assert found(near_duplicates(df)) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
