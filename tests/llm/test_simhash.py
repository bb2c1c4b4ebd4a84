"""SimHash groups against all pairs of fingerprints computed another way."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rowquarry.llm import simhash
from rowquarry.llm.simhash import near_duplicates, op3_simhash

SCHEMA = "doc_id long, text string"


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, bits=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    fp = np.array(fps, np.uint64)
    for a in range(len(ids)):
        for b in np.nonzero(np.bitwise_count(fp[a] ^ fp[a + 1 :]) <= bits)[0]:
            x, y = find(ids[a]), find(ids[a + 1 + int(b)])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(rows, got):
    ids, fps = [i for i, _ in rows], [fingerprint(t) for _, t in rows]
    want = groups(ids, fps)
    assert {r.id: r.fp % 2**64 for r in got} == dict(zip(ids, fps, strict=True))
    assert {r.id: r.component_id for r in got} == want


def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = groups([i for i, _ in rows], fps := [fingerprint(t) for _, t in rows])
    got = {r.doc_id: r for r in op3_simhash(spark, sf).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{f:016x}", want[i]) for (i, _), f in zip(rows, fps, strict=True)
    }


def test_edges(spark):
    base = [f"word{k}" for k in range(400)]
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "One Two"), (5, "one\ttwo"), (4, "ÉCOLE école"), (3, " ".join(base)), (2, " ".join(base[:-1] + ["x"]))]
    rows += [(20 + k, " ".join(base[: 395 + k])) for k in range(5)] + [(1, "a b c d " * 30_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("id", F.lit(None))
    check(rows, near_duplicates(df).collect())


def test_many_near_copies_in_one_group_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(1 << 62))
    fps = [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(1500)]
    fps += [int(x) for x in rng.integers(1 << 62, size=500)]
    rows = [(i, f) for i, f in enumerate(fps)]
    made = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in rows], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **b: made)
    monkeypatch.setattr(simhash, "LINKS", 100)
    monkeypatch.setattr(simhash, "LARGE", 300)
    want = groups([i for i, _ in rows], fps)
    assert {r.id: r.component_id for r in near_duplicates(made.withColumn("doc_id", F.lit(1))).collect()} == want


def test_repeats_missing_ids_and_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).isEmpty()
    rows = [(5, "same text here now"), (5, "same text here now"), (None, "same text here now"), (None, "alone in the world today")]
    got = sorted(((r.id or 0), r.component_id or 0) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]
    with pytest.raises(ValueError, match="at most"):
        near_duplicates(spark.createDataFrame([], SCHEMA), max_bits=6)


def test_large_runs_cut_by_further_bits_lose_no_link(monkeypatch):
    rng = np.random.default_rng(8)
    key, fp = [], []
    for run in range(6):
        first, width = simhash.SEGMENTS[run % 3]
        fixed = int(rng.integers(1 << width)) << first
        outside = ~(((1 << width) - 1) << first) & (2**64 - 1)
        spots = [int(x) for x in rng.integers(0, 1 << 63, 40)]
        made = {(s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) & outside | fixed for s in spots for _ in range(10)}
        fp.append(sorted(made))
        key += [((first + run) << 32 | run)] * len(made)
    fp = np.array([x for part in fp for x in part], np.uint64).view(np.int64)
    key = np.array(key, np.int64)
    plain = simhash._links(key, fp, 4)
    monkeypatch.setattr(simhash, "LARGE", 50)
    for a, b in zip(plain, simhash._run_links(key, fp, 4), strict=True):
        assert np.array_equal(a, b)
