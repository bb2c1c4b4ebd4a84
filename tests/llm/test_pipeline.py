"""The pipeline's stages, each against a plain computation on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowquarry.llm import decontaminate, quality
from rowquarry.llm.graph import components
from rowquarry.llm.secrets import scan
from rowquarry.llm.simhash import fingerprint

from .test_packing import check
from .test_simhash import groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('p')}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_quality(spark, sf, kept):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    network = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.id: r.score for r in quality.scores(docs, network).collect()}
    assert {r.doc_id for r in kept[1]} == {i for i, s in score.items() if s >= 0.3}
    assert {tuple(r) for r in kept[1]} <= {tuple(r) for r in kept[0]}


def shingles(text):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def test_near_duplicates(kept):
    """Groups by all pairs: fingerprints within four bits, or Jaccard similarity of 0.8 or more."""
    rows = sorted(kept[1], key=lambda r: r.doc_id)
    ids, sets = [r.doc_id for r in rows], [shingles(r.text) for r in rows]
    root = dict(groups(ids, [fingerprint((r.text or "").encode()) for r in rows]))
    for x in range(len(rows)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = root[ids[x]], root[ids[y]]
                root = {i: min(a, b) if c in (a, b) else c for i, c in root.items()} if a != b else root
    assert sorted(r.doc_id for r in kept[2]) == sorted(i for i, c in root.items() if i == c)
    assert {tuple(r) for r in kept[2]} <= {tuple(r) for r in kept[1]}


def test_rows_that_share_an_id_and_clashing_columns(spark, sf):
    text = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(1, text[0]), (1, text[1]), (2, text[2]), (3, text[1]), (3, text[1]), (4, text[2] + " x"), (5, "p q"), (5, "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("before", "_before", "__before", "blob", "__blob", "findings", "node", "n", "group", "least"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.length("text")))
    got = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, text[0]), (1, text[1]), (2, text[2]), (5, "p q")])
    assert all(r["__before"] == f"__before{len(r.text)}" and r["node"] == f"node{len(r.text)}" for r in got)
    secret = docs.withColumn("text", F.concat("text", F.lit(" password=abcdefgh12 end")))
    out = corpus_pipeline.secret_scan(spark, secret, sf).collect()
    assert all(r["text"].endswith(" <assign> end") for r in out)
    assert sorted(r["__blob"] for r in out) == sorted(f"__blob{len(t)}" for _, t in rows)


def test_decontamination(spark, sf, kept):
    docs = spark.createDataFrame(kept[2], spark.read.parquet(f"{sf}/documents.parquet").schema)
    found = {r.id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2]} - found


def test_secrets(kept):
    before = {r.doc_id: r for r in kept[3]}
    assert {r.doc_id for r in kept[4]} == set(before)
    for r in kept[4]:
        old = before[r.doc_id]
        spans = scan(old.text)
        assert (r.text == old.text) == (not spans) and r.n_chars == (len(r.text) if spans else old.n_chars)
        assert not scan(re.sub("<(assign|access|hex)>", "\n", r.text))


def test_packing_and_run(spark, sf, kept):
    texts = {r.doc_id: r.text for r in kept[4]}
    whole = corpus_pipeline.run(spark, sf).withColumnRenamed("doc_id", "id").collect()
    used, least = check(whole, texts, 2048)
    assert used <= 1.05 * least + 1 and len(whole) == len(kept[5])


def test_stages_on_odd_rows(spark, sf):
    text = "A sentence of ordinary words, which nobody would reject for its form or its content. " * 3
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text + "password=abcdefgh12"), (5, "word " * 50_000), (6, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", "id", "blob", "component_id", "score"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name, stage in list(stages.items())[:4]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns
        out[name] = sorted((r.doc_id or 0) for r in found.collect())
    assert out["simhash near-dedup"][:2] == [0, 1] and out["simhash near-dedup"].count(1) == 1 and 6 not in out["simhash near-dedup"]
    assert len(out["secret scans"]) == len(rows) == len(out["benchmark decontamination"])
    assert stages["best-fit packing"](spark, docs, sf).select("doc_id").count() >= len(rows)
    empty = docs.where("false")
    for stage in stages.values():
        assert stage(spark, empty, sf).isEmpty()


def test_similar_texts_of_large_keys_by_all_pairs(spark, monkeypatch):
    from rowquarry.llm import jaccard

    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(25):
            other = list(base)
            for at in rng.sample(range(80), rng.randrange(3)):
                other[at] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    texts = sorted(set(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = root[x], root[y]
                root = [min(a, b) if c in (a, b) else c for c in root]
    for hold, at_once in ((1024, 1 << 18), (5, 200)):
        monkeypatch.setattr(jaccard, "HOLD", hold)
        monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
        got = components(jaccard.similar(rows)).collect()
        assert {r.node: r.component for r in got} == {k: c for k, c in enumerate(root) if k != c}


def test_near_copies_of_similarity_from_0_8(spark, sf):
    rng = random.Random(7)
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rows, want = [], set()
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        other = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) // rng.choice([25, 40, 60]))):
            other[at] = f"w{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want |= {2 * k} if len(a & b) >= 0.8 * len(a | b) else {2 * k, 2 * k + 1}
    assert 70 < len(want) < 110
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    near = {r.doc_id for r in got.collect()}
    assert near <= want
    bits = {i: fingerprint(t.encode()) for i, t in rows}
    assert want - near <= {i for i in want if i % 2 and (bits[i] ^ bits[i - 1]).bit_count() <= 4}
