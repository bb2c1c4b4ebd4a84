"""Substring deduplication against a brute force over word tuples."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from rowquarry.llm import substrings
from rowquarry.llm.substrings import SubstringIndex, op9_substrings

N = 13


def brute(docs):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    least = {}
    for i in sorted(cut):
        for k in range(len(cut[i]) - N + 1):
            least.setdefault(tuple(cut[i][k : k + N]), i)
    out = {}
    for i, w in cut.items():
        gone = set()
        for k in range(len(w) - N + 1):
            if least[tuple(w[k : k + N])] < i:
                gone.update(range(k, k + N))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def found(df):
    return {r.id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


def index(spark, tmp_path, name="index"):
    return SubstringIndex(spark, f"file://{tmp_path}/{name}")


def words(lo, hi):
    return [f"w{k}" for k in range(lo, hi)]


def fixture():
    docs = [(1, " ".join(words(0, 40))), (2, " ".join(words(100, 130) + words(5, 30) + words(140, 150)))]
    docs += [(3, " ".join(words(0, 12))), (4, None), (5, ""), (6, "same " * 60), (7, "same " * 20 + "end")]
    docs += [(8, " ".join(words(0, 40))), (9, "  ".join(words(27, 40)) + " x"), (10, "\n".join(words(200, 3000)))]
    docs += [(11, " ".join(words(2900, 3100) + words(3000, 3050)))]
    return docs


def test_matches_brute_force_on_edges(spark, tmp_path, monkeypatch):
    docs = fixture()
    for block in (substrings.BLOCK, 40):
        monkeypatch.setattr(substrings, "BLOCK", block)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        df = df.withColumn("id", F.lit("clash")).withColumn("fps", F.lit(1))
        assert found(index(spark, tmp_path, f"i{block}").deduplicate(df)) == brute(docs)


def test_matches_brute_force_on_the_table(spark, sf):
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in op9_substrings(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (n, removed, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed) == (n, removed)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_a_second_batch_sees_the_first_and_survives_compaction(spark, tmp_path, monkeypatch):
    docs = fixture()
    one, two = (spark.createDataFrame(x, "doc_id long, text string") for x in (docs[:6], docs[6:]))
    want = brute(docs)
    for most in (8, 1):  # the second index is compacted before it takes the second batch
        monkeypatch.setattr(substrings, "MOST_RUNS", most)
        idx = index(spark, tmp_path, f"two{most}")
        first = found(idx.deduplicate(one))
        second = found(idx.deduplicate(two, history=one))
        assert first | second == want
    assert len(idx.runs()) == 2
    third = [(20, docs[1][1] + " and " + docs[9][1]), (0, docs[0][1])]
    four = spark.createDataFrame(third, "doc_id long, text string")
    got = found(idx.deduplicate(four, history=one.union(two)))
    assert got == {k: v for k, v in brute(docs + third).items() if k in (0, 20)}
    with pytest.raises(ValueError, match="earlier batches"):
        idx.deduplicate(four)
    monkeypatch.setattr(substrings, "BROADCAST_IDS", 0)
    assert found(idx.deduplicate(four, history=one.union(two))) == got
    idx.compact()
    assert len(idx.runs()) == 1 and idx.read().groupBy("fp", "id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("docs", [[], [(5, " ".join(words(0, 30)))], [(1, " ".join(words(0, 30))), (2, " ".join(words(0, 30))), (None, "x")]])
def test_the_query_on_very_small_tables(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_substrings(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == sorted((i or 0, 30 if i == 2 else 0) for i, _ in docs)


def test_empty_table_repeated_rows_and_missing_ids(spark, tmp_path):
    schema = "doc_id long, text string"
    assert index(spark, tmp_path, "e").deduplicate(spark.createDataFrame([], schema)).isEmpty()
    long = " ".join(words(0, 30))
    rows = [(1, long), (1, long), (2, long), (None, long)]
    got = sorted((r.id or 0, r.n_removed) for r in index(spark, tmp_path, "r").deduplicate(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]


def test_runs_are_merged_without_a_shuffle(spark, tmp_path):
    """Neither the joins with the runs of history nor a compaction deal rows out again."""
    idx = index(spark, tmp_path, "plan")
    docs = spark.createDataFrame(fixture(), "doc_id long, text string").repartition(3)
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    one, two = idx.append(rows), idx.append(rows.where("id < 9"))
    spark.conf.set(idx.ALL_KEYS, "false")
    try:
        joined = [*idx.across(idx.open(one), idx.open(two)), idx.within(idx.open(one)), idx.merged(one, two)]
        for k, df in enumerate(joined):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
            assert "Sort [" not in plan or k >= 2, plan  # scans come sorted
    finally:
        spark.conf.unset(idx.ALL_KEYS)
    pairs = lambda df: {(r.fp, r.id) for r in substrings._members(df).collect()}
    want = pairs(idx.read())
    assert want == {(int(f), i) for i, t in fixture() for f in substrings.window_fingerprints(substrings.WordHashes().of((t or "").encode().split())[0]).view("int64")}
    idx.compact()
    again = SubstringIndex(spark, idx.path, buckets=99)
    assert again.buckets == idx.buckets and pairs(again.read()) == want
    idx.close()


def test_a_window_that_repeats_within_documents(spark, tmp_path, monkeypatch):
    line = " ".join(words(0, 13)) + " "
    docs = [(1, line * 40), (2, "start " + line * 60 + "end"), (3, line + "x " + line + "y " + line * 3), (4, line)]
    for block in (substrings.BLOCK, 30):
        monkeypatch.setattr(substrings, "BLOCK", block)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert found(index(spark, tmp_path, f"rep{block}").deduplicate(df)) == brute(docs)


def test_words_are_found_and_told_apart():
    pieces = [b"a", b"a\0", b"\0a", b"\0", b"x" * 8, b"x" * 9, b"x" * 16, b"x" * 64, b"x" * 65, b"x" * 64 + b"y", "é  ".encode(), b"\x1c\x85"]
    long = [b"x" * 7 + c + b"x" * n for n in (0, 1, 8, 56, 57, 300) for c in (b"u", b"v")]
    docs = [b"", b" \t\n\x0b\x0c\r ", b" ".join(pieces), b"\n" + b"\t \r".join(long + pieces) + b"\x0b", b"a", b"", b" a\x0ca"]
    found = substrings.Words(docs)
    cut = [d.split() for d in docs]
    assert found.counts.tolist() == [len(c) for c in cut]
    assert substrings._left(found, found.length > 0) == [b" ".join(c) for c in cut]
    assert substrings._left(found, found.length > 8) == [b" ".join(w for w in c if len(w) > 8) for c in cut]
    for family in (0, 1):
        of = {}
        for word, h in zip([w for c in cut for w in c], found.hashes(family).tolist(), strict=True):
            of.setdefault(word, set()).add(h)
        assert all(len(h) == 1 for h in of.values()) and len(set.union(*of.values())) == len(of) == len(set(pieces + long))
    assert not set(found.hashes(0).tolist()) & set(found.hashes(1).tolist())


def test_hashing_words_costs_little_more_than_finding_them():
    words = [b"word%d" % (k * 7919 % 200_003) for k in range(400_000)]
    text = b" ".join(words)

    def least(work):
        took = []
        for _ in range(3):
            began = time.thread_time()
            work()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: substrings.WordHashes().of(words)) < 6 * least(text.split)
