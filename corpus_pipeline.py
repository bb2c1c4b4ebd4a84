"""The corpus pipeline: from the table ``documents`` to packed training sequences.

Each stage takes what its predecessor kept and returns the columns of ``documents``, but for the
last, which returns the packed pieces. Stages do not copy or drop columns that they do not change.

A row without an id cannot be told from another one: the near-duplicate stage lets it through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowquarry.llm import decontaminate, jaccard, packing, quality, secrets, simhash
from rowquarry.llm.common import documents, shared_path, unused, written
from rowquarry.llm.graph import components


#: Entries of the packing workers' caches: executors hold the workers of other stages as well.
CACHE = 150_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    return quality.kept(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Two texts are near duplicates if their SimHash fingerprints are (at most four bits apart), or if
    their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Rows are told apart by
    id and text: rows that share an id but not a text are compared like any others, and of rows that
    share both one stays.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text.alias("node"), "text")
    close = simhash.near_duplicates(rows, id_col="node").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    found = components(close.union(jaccard.similar(rows.select("node", "text"))))
    ids = rows.where("doc_id is not null").groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    grouped = ids.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "node")).alias("least")).select("least.*")
    least = written(least.join(ids, ["doc_id", "node"]), "least")
    node, number = unused(docs, "node"), unused(docs, "n")
    least = least.select("doc_id", F.col("node").alias(node), F.col("n").alias(number))
    named = docs.withColumn(node, text)
    kept = named.join(least.where(F.col(number) == 1), ["doc_id", node], "left_semi")
    if not (twice := least.where(F.col(number) > 1)).isEmpty():
        kept = kept.unionByName(named.join(twice, ["doc_id", node], "left_semi").dropDuplicates(["doc_id", node]))
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced; a changed text has its length counted again."""
    ledger = secrets.BlobLedger(spark, shared_path(spark, "ledger"))
    ledger.update(docs)
    before = unused(docs, "before")
    found = secrets.redacted(docs.withColumn(before, F.octet_length("text")), ledger)
    changed = F.octet_length("text") != F.col(before)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    import public_tokenizers

    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), cache=CACHE)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", pack),
]
#: Training, k-th differing bits and tokenizers have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written to the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
