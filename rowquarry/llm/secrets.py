"""Secret scans over an incremental blob ledger (operator 2).

Every text (every version of a file, under whatever path) is addressed by the SHA-256 of its
content. A ledger of immutable Parquet runs holds the findings of each (blob, rule version) pair;
a scan reads only the blobs that the ledger lacks and joins the findings back to all rows.

Defined results: a null text is an empty one, without findings; copies of a text share one ledger
entry and each row gets the findings; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path, slices, texts, unused

RULES = "1"
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_SIGN = re.compile(r"""(?:[dDtTnNyY])["']?\x20*[:=]""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so a run of 32 or more is a match of the rule
FINDINGS = "array<struct<kind:string,start:long,end:long>>"


def scan(text: str) -> list[dict]:
    """Findings by start, then kind; positions in code points, end exclusive."""
    found = []
    if _SIGN.search(text):  # no assignment without a key word's last letter before the sign
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return [{"kind": k, "start": s, "end": e} for k, s, e in found]


class BlobLedger:
    """Findings by blob and rule version, in append-only Parquet runs under one path."""

    SCHEMA = f"blob binary, rules string, findings {FINDINGS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, rules: str = RULES) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("rules") == rules)

    def update(self, docs: DataFrame, text_col: str = "text", rules: str = RULES) -> None:
        """Scan the blobs of ``docs`` that have no entry under these rules, each once, and append them."""
        blobs = docs.select(_blob(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        if self._exists():
            unseen = blobs.select("blob").distinct().join(self.read(rules).select("blob"), "blob", "left_anti")
            blobs = blobs.join(unseen, "blob", "left_semi")
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays(
                    [b.column("blob"), pa.array([scan(t) for t in texts(b, "text")], kind)], ["blob", "findings"]
                )

        found = blobs.mapInArrow(run, f"blob binary, findings {FINDINGS}")
        found.select("blob", F.lit(rules).alias("rules"), "findings").write.mode("append").parquet(self.path)

    def findings(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: str = RULES) -> DataFrame:
        """(id, findings) of every row of ``docs``, from the ledger."""
        rows = docs.select(F.col(id_col).alias("id"), _blob(text_col).alias("blob"))
        held = self.read(rules).where(F.size("findings") > 0).select("blob", "findings")
        return rows.join(held, "blob", "left").select("id", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def _blob(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _cut(text: str, findings: list[dict]) -> str:
    """The text with ``<kind>`` for each finding; of overlapping ones the first names what all cover."""
    out, at = [], 0
    for f in findings:
        if f["start"] >= at:
            out += [text[at : f["start"]], f"<{f['kind']}>"]
        at = max(at, f["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: BlobLedger, text_col: str = "text", rules: str = RULES) -> DataFrame:
    """``docs`` with every finding of the ledger replaced by ``<kind>``; overlapping findings become one."""
    blob, findings = unused(docs, "blob"), unused(docs, "findings")
    held = ledger.read(rules).where(F.size("findings") > 0)
    held = held.select(F.col("blob").alias(blob), F.col("findings").alias(findings))
    whole = docs.withColumn(blob, _blob(text_col)).join(held, blob, "left").drop(blob)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, columns = b.column(findings), [b.column(c) for c in names]
            if found.null_count < len(found):
                now = columns[at].to_pylist()
                for k, had in enumerate(found.to_pylist()):
                    if had:
                        now[k] = _cut(now[k], had)
                columns[at] = pa.array(now, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return whole.mapInArrow(run, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger = BlobLedger(spark, shared_path(spark, "ledger"))
    ledger.update(docs)
    found = ledger.findings(docs)
    text = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")

    def number(kind: str):
        return F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *[number(k) for k in KINDS],
        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"),
    )
