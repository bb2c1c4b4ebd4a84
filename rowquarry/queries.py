"""The registered queries of the table engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workload
from .functions.blob import compress, decompress, hash_blob, is_damaged
from .functions.encoding import text_column
from .functions.factors import factor, factor_code, factor_value
from .operators.table import TableRef
from .session import OPTION, scratch_path, threads
from .sources.aliases import table_metadata, table_read, table_write
from .sources.store import metadata, read_table, stored_key, write_table
from .types import ROW_ID, as_difftime, as_idate, as_itime, as_nanotime, as_posixct, as_raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_stores: dict[tuple, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, sort_by: list[str], compress_level: int = 50) -> str:
    """Path of the input table in a store, sorted; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(sort_by), compress_level)
    if key not in _stores:
        path = scratch_path(spark, name)
        write_table(table(spark, sf_dir, name), path, compress=compress_level, sort_by=sort_by)
        _stores[key] = path
    return _stores[key]


def orders(spark: SparkSession, sf_dir: str) -> str:
    return stored(spark, sf_dir, "orders", ["o_orderkey"])


def orders_ref(spark: SparkSession, sf_dir: str) -> TableRef:
    return TableRef(spark, orders(spark, sf_dir))


def kept(spark: SparkSession, df: DataFrame, **how) -> str:
    path = scratch_path(spark, "table")
    write_table(df, path, **how)
    return path


_NUMBERED = "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_id, * FROM orders"

# sources and sinks


@query("SELECT * FROM nation")
def read_full(spark, sf_dir):
    return read_table(spark, stored(spark, sf_dir, "nation", ["n_nationkey"]))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def read_columns(spark, sf_dir):
    return read_table(spark, orders(spark, sf_dir), ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderstatus, o_custkey, o_orderkey FROM orders")
def read_columns_reordered(spark, sf_dir):
    return read_table(spark, orders(spark, sf_dir), ["o_orderstatus", "o_custkey", "o_orderkey"])


@query(f"SELECT * FROM ({_NUMBERED}) WHERE row_id BETWEEN 101 AND 600")
def read_row_range(spark, sf_dir):
    return read_table(spark, orders(spark, sf_dir), from_=101, to=600, row_ids=True).withColumnRenamed(ROW_ID, "row_id")


@query(f"SELECT * EXCLUDE (row_id) FROM ({_NUMBERED}) WHERE row_id >= 1000")
def read_from_only(spark, sf_dir):
    return read_table(spark, orders(spark, sf_dir), from_=1000)


@query(f"SELECT * EXCLUDE (row_id) FROM ({_NUMBERED}) WHERE row_id <= 250")
def read_to_only(spark, sf_dir):
    return read_table(spark, orders(spark, sf_dir), to=250)


@query(f"SELECT * EXCLUDE (row_id) FROM ({_NUMBERED}) WHERE row_id = 77")
def read_single_row(spark, sf_dir):
    return read_table(spark, orders(spark, sf_dir), from_=77, to=77)


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]


@query(
    f"SELECT row_id, l_quantity, l_returnflag FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) AS row_id "
    "FROM lineitem) WHERE row_id BETWEEN 2000 AND 5000"
)
def read_row_range_columns(spark, sf_dir):
    path = stored(spark, sf_dir, "lineitem", _LINE_ORDER)
    found = read_table(spark, path, ["l_quantity", "l_returnflag"], from_=2000, to=5000, row_ids=True)
    return found.withColumnRenamed(ROW_ID, "row_id")


def _round_trip(level: int) -> None:
    @query("SELECT * FROM orders", f"roundtrip_c{level}")
    def round_trip(spark, sf_dir):
        return read_table(spark, stored(spark, sf_dir, "orders", ["o_orderkey"], level))


for _level in (0, 30, 60, 100):
    _round_trip(_level)


@query("SELECT * FROM nation")
def overwrite_then_read(spark, sf_dir):
    path = kept(spark, table(spark, sf_dir, "region"))
    write_table(table(spark, sf_dir, "nation"), path)
    return read_table(spark, path)


@query("SELECT * FROM supplier WHERE s_suppkey % 2 = 0")
def rewrite_from_itself(spark, sf_dir):
    path = kept(spark, table(spark, sf_dir, "supplier"), sort_by=["s_suppkey"])
    write_table(read_table(spark, path).where("s_suppkey % 2 = 0"), path)
    return read_table(spark, path)


@query("SELECT CAST(0 AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_columns")
def zero_row_roundtrip(spark, sf_dir):
    ref = TableRef(spark, kept(spark, table(spark, sf_dir, "orders").where("false")))
    return ref.df().agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(ref.ncol).cast("long"))


# metadata


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a column of every logical type, in the order A to P."""
    df = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    df = df.select(
        k.cast("int").alias("A"), (k % 2 == 0).alias("B"), F.col("o_totalprice").alias("C"),
        F.to_date("o_orderdate").alias("D"), F.col("o_orderpriority").alias("E"), F.col("o_orderstatus").alias("F"),
        F.col("o_orderdate").cast("timestamp").alias("G"), F.col("o_orderdate").cast("timestamp").alias("H"),
        F.to_date("o_orderdate").alias("I"), (k % 256).alias("J"), F.col("o_orderpriority").alias("K"),
        (k % 1000).cast("double").alias("L"), (k % 1000).alias("M"), (k % 86400).cast("int").alias("N"),
        k.cast("long").alias("O"), (k * 1_000_000_007).cast("long").alias("P"),
    )
    df = factor(df, "F", ["F", "O", "P"])
    df = as_posixct(df, "G", "UTC")
    df = as_posixct(df, "H", "UTC", storage="int")
    df = as_raw(as_idate(df, "I"), "J")
    df = factor(df, "K", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"], ordered=True)
    df = as_difftime(as_difftime(df, "L"), "M", storage="int")
    return as_nanotime(as_itime(df, "N"), "P")


def _mixed_store(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, "mixed")
    if key not in _stores:
        _stores[key] = kept(spark, mixed(spark, sf_dir), sort_by=["D", "K", "B"])
    return _stores[key]


# Column, base code, type code, type.
_MIXED = [
    ("A", 4, 5, "integer"), ("B", 6, 15, "logical"), ("C", 5, 10, "double"), ("D", 5, 11, "Date"), ("E", 2, 2, "character"),
    ("F", 3, 3, "factor"), ("G", 5, 12, "POSIXct"), ("H", 4, 6, "POSIXct"), ("I", 4, 8, "IDate"), ("J", 8, 18, "raw"),
    ("K", 3, 4, "ordered factor"), ("L", 5, 13, "difftime"), ("M", 4, 7, "difftime"), ("N", 4, 9, "ITime"),
    ("O", 7, 16, "integer64"), ("P", 7, 17, "nanotime"),
]
_MIXED_KEY = {"D": 1, "K": 2, "B": 3}


@query(
    'SELECT "column", CAST(position AS INT) AS position, CAST(base_code AS INT) AS base_code, CAST(type_code AS INT) AS type_code, '
    "type, CAST(key AS INT) AS key FROM (VALUES "
    + ", ".join(f"('{c}', {i}, {b}, {t}, '{n}', {_MIXED_KEY.get(c, 'NULL')})" for i, (c, b, t, n) in enumerate(_MIXED, 1))
    + ') AS v("column", position, base_code, type_code, type, key)'
)
def meta_columns(spark, sf_dir):
    return metadata(spark, _mixed_store(spark, sf_dir)).to_df(spark)


def _listed_lines() -> list[str]:
    kind = {c: n for c, _, _, n in _MIXED}
    return [f"* '{c}': {kind[c]} (key {k})" for c, k in _MIXED_KEY.items()] + [
        f"* '{c}': {n}" for c, _, _, n in _MIXED if c not in _MIXED_KEY
    ]


@query(
    "SELECT CAST(1 AS INT) AS line_no, '<rowquarry table>' AS line UNION ALL "
    "SELECT 2, count(*) || ' rows, 16 columns (table)' FROM orders UNION ALL SELECT 3, '' UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(_listed_lines(), 4))
    + ")"
)
def meta_print_lines(spark, sf_dir):
    lines = metadata(spark, _mixed_store(spark, sf_dir)).lines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


@query("SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders")
def dim_table(spark, sf_dir):
    return spark.createDataFrame([orders_ref(spark, sf_dir).dim], "n_rows long, n_columns long")


@query("SELECT CAST(row_number() OVER () AS VARCHAR) AS row_name FROM supplier")
def row_names(spark, sf_dir):
    return TableRef(spark, stored(spark, sf_dir, "supplier", ["s_suppkey"])).row_names()


def _key_prefix(name: str, columns: list[str], left: list[str]) -> None:
    values = ", ".join(f"('{c}', {i})" for i, c in enumerate(left, 1)) or "(NULL, 0)"
    sql = f'SELECT CAST(c AS VARCHAR) AS "column", CAST(k AS INT) AS key FROM (VALUES {values}) AS v(c, k) WHERE k > 0'

    @query(sql, name)
    def key_prefix(spark, sf_dir):
        key = stored_key(read_table(spark, _mixed_store(spark, sf_dir), columns, keyed=True)) or []
        return spark.createDataFrame([(c, i) for i, c in enumerate(key, 1)], "column string, key int")


_key_prefix("key_prefix_drop_last", ["A", "K", "D"], ["D", "K"])
_key_prefix("key_prefix_drop_middle", ["B", "D", "E"], ["D"])
_key_prefix("key_prefix_drop_first", ["B", "K"], [])


@query(
    "SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS row_id, c_mktsegment, c_custkey FROM customer"
)
def write_sorted_key(spark, sf_dir):
    path = stored(spark, sf_dir, "customer", ["c_mktsegment", "c_custkey"])
    found = read_table(spark, path, ["c_mktsegment", "c_custkey"], keyed=True, row_ids=True)
    return found.withColumnRenamed(ROW_ID, "row_id")


# column and row selection


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def col_by_position(spark, sf_dir):
    return orders_ref(spark, sf_dir)[[3, 1]]


@query("SELECT o_custkey FROM orders")
def col_fraction(spark, sf_dir):
    return orders_ref(spark, sf_dir)[2.6]


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def col_logical_recycle(spark, sf_dir):
    return orders_ref(spark, sf_dir)[[True, False]]


@query("SELECT o_totalprice FROM orders")
def col_single(spark, sf_dir):
    return orders_ref(spark, sf_dir).column("o_totalprice")


@query(f"SELECT o_totalprice FROM ({_NUMBERED}) WHERE row_id = 321")
def cell(spark, sf_dir):
    return orders_ref(spark, sf_dir).cell(4, 321)


@query("SELECT * FROM orders")
def full_by_bracket(spark, sf_dir):
    return orders_ref(spark, sf_dir)[:, :]


@query(f"SELECT * EXCLUDE (row_id) FROM ({_NUMBERED}) WHERE row_id BETWEEN 10 AND 140")
def rows_slice_all_cols(spark, sf_dir):
    return orders_ref(spark, sf_dir)[range(10, 141), :]


@query(f"SELECT o_orderdate, o_custkey FROM ({_NUMBERED}) WHERE row_id BETWEEN 700 AND 1200")
def rows_slice_cols(spark, sf_dir):
    return orders_ref(spark, sf_dir)[range(700, 1201), ["o_orderdate", "o_custkey"]]


_WANTED = [900, 3, 3, 1499, 12, 900, 1]


@query(
    f"SELECT CAST(pos AS BIGINT) AS pos, o_orderkey, o_totalprice FROM ({_NUMBERED}) JOIN (VALUES "
    + ", ".join(f"({i}, {r})" for i, r in enumerate(_WANTED, 1))
    + ") AS w(pos, row_no) ON row_id = row_no"
)
def rows_gather_dup_order(spark, sf_dir):
    return orders_ref(spark, sf_dir).rows(_WANTED, ["o_orderkey", "o_totalprice"]).withColumnRenamed("__at", "pos")


@query(
    f"SELECT event_id, o_orderkey FROM events JOIN ({_NUMBERED}) ON row_id = event_id % (SELECT count(*) FROM orders) + 1"
)
def rows_gather_listed(spark, sf_dir):
    ref = orders_ref(spark, sf_dir)
    index = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % ref.nrow + 1).alias("row"))
    return ref.gather(index, "row", ["o_orderkey"]).drop("row")


@query(f"SELECT o_orderkey, o_orderstatus FROM ({_NUMBERED}) WHERE row_id IN (2, 5, 8, 11, 14)")
def rows_logical_mask(spark, sf_dir):
    mask = [i % 3 == 2 if i % 5 else None for i in range(1, 15)]
    mask[4] = True
    return orders_ref(spark, sf_dir)[mask, ["o_orderkey", "o_orderstatus"]]


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice > 100000 END")
def rows_mask_expression(spark, sf_dir):
    mask = F.when(F.col("o_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice") > 100000)
    return orders_ref(spark, sf_dir)[mask, ["o_orderkey"]]


@query(
    f"SELECT row_id, o_orderkey, o_orderpriority FROM ({_NUMBERED}) WHERE row_id <= 5 OR row_id > (SELECT count(*) FROM orders) - 5"
)
def preview_head_tail(spark, sf_dir):
    found = orders_ref(spark, sf_dir).preview_rows()
    return found.select(F.col(ROW_ID).alias("row_id"), "o_orderkey", "o_orderpriority")


# types


@query("SELECT CAST(row_number() OVER (ORDER BY event_type) AS INT) AS code, event_type AS level FROM (SELECT DISTINCT event_type FROM events)")
def factor_levels(spark, sf_dir):
    df = factor(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")
    ref = TableRef(spark, kept(spark, df))
    return ref.levels("event_type")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) AS INT) AS code FROM events")
def factor_codes(spark, sf_dir):
    df = factor(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")
    df = read_table(spark, kept(spark, df))
    return df.select("event_id", factor_code(df, "event_type").alias("code"))


_PRIORITY = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "SELECT row_number() OVER (ORDER BY CASE o_orderpriority "
    + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(_PRIORITY))
    + " END NULLS FIRST, o_orderkey) AS row_id, o_orderkey, o_orderpriority FROM orders"
)
def factor_ordered_sort(spark, sf_dir):
    df = factor(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _PRIORITY, ordered=True)
    path = kept(spark, df, sort_by=["o_orderpriority", "o_orderkey"])
    return read_table(spark, path, row_ids=True).withColumnRenamed(ROW_ID, "row_id")


@query(
    "SELECT CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN NULL ELSE NULL END AS VARCHAR) AS value, "
    "CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS INT) AS code, count(*) AS n "
    "FROM events GROUP BY ALL"
)
def factor_na_level(spark, sf_dir):
    named = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "2")
    named = named.when(F.col("event_type") != "purchase", "none of the levels")
    df = factor(table(spark, sf_dir, "events").select(named.alias("f")), "f", ["1", "2"], na_level=True)
    df = read_table(spark, kept(spark, df))
    return df.groupBy(factor_value(df, "f").alias("value"), factor_code(df, "f").alias("code")).agg(F.count("*").alias("n"))


def _events_with(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", value.alias("v"))
    return read_table(spark, kept(spark, df))


def _k():
    return F.col("event_id") % 5


@query("SELECT CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS v, count(*) AS n FROM events GROUP BY 1")
def na_logical(spark, sf_dir):
    df = _events_with(spark, sf_dir, F.when(_k() == 0, True).when(_k() == 1, False))
    return df.groupBy("v").agg(F.count("*").alias("n"))


@query(
    "SELECT CASE event_id % 5 WHEN 0 THEN 'Inf' WHEN 1 THEN '-Inf' WHEN 2 THEN 'NaN' WHEN 3 THEN 'NA' ELSE 'finite' END AS kind, "
    "count(*) AS n FROM events GROUP BY 1"
)
def na_double_nan(spark, sf_dir):
    value = F.when(_k() == 0, float("inf")).when(_k() == 1, float("-inf")).when(_k() == 2, float("nan")).when(_k() == 4, F.col("value"))
    v = F.col("v")
    kind = (
        F.when(v.isNull(), "NA").when(F.isnan(v), "NaN").when(v == float("inf"), "Inf")
        .when(v == float("-inf"), "-Inf").otherwise("finite")
    )
    return _events_with(spark, sf_dir, value).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN event_type END AS v, count(*) AS n FROM events GROUP BY 1")
def na_string_empty(spark, sf_dir):
    df = _events_with(spark, sf_dir, F.when(_k() == 0, "").when(_k() == 1, F.col("event_type")))
    return df.groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN CAST(ts AS DATE) END AS v FROM events")
def date_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(_k() != 3, F.to_date("ts")).alias("v"))
    return read_table(spark, kept(spark, as_idate(df, "v")))


@query("SELECT event_id, epoch_us(ts) + event_id % 1000000 AS us FROM events")
def posixct_micro_roundtrip(spark, sf_dir):
    micros = F.unix_micros(F.expr("to_timestamp(concat(cast(ts as string), ' UTC'))")) + F.col("event_id") % 1_000_000
    df = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(micros).alias("v"))
    df = read_table(spark, kept(spark, as_posixct(df, "v", "UTC")))
    return df.select("event_id", F.unix_micros("v").alias("us"))


@query("SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INT) AS v FROM events")
def itime_seconds(spark, sf_dir):
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    df = table(spark, sf_dir, "events").select("event_id", seconds.cast("int").alias("v"))
    return read_table(spark, kept(spark, as_itime(df, "v")))


@query("SELECT event_id, CAST(event_id % 5000 * 60 AS BIGINT) AS seconds FROM events")
def difftime_seconds(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5000).alias("v"))
    df = read_table(spark, kept(spark, as_difftime(df, "v", "mins", storage="int")))
    return df.select("event_id", F.expr("cast(extract(second from v) as long) + 60 * extract(minute from v) + 3600 * extract(hour from v) + 86400L * extract(day from v)").alias("seconds"))


@query("SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns FROM events")
def nanotime_roundtrip(spark, sf_dir):
    micros = F.unix_micros(F.expr("to_timestamp(concat(cast(ts as string), ' UTC'))"))
    df = table(spark, sf_dir, "events").select("event_id", (micros * 1000 + F.col("event_id") % 1000).alias("ns"))
    return read_table(spark, kept(spark, as_nanotime(df, "ns")))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 2 THEN event_id * 2345612345679 END AS v FROM events")
def int64_roundtrip(spark, sf_dir):
    return _events_with(spark, sf_dir, F.when(_k() != 2, F.col("event_id") * 2345612345679))


@query("SELECT CAST(event_id % 256 AS SMALLINT) AS v, count(*) AS n FROM events GROUP BY 1")
def raw_byte_roundtrip(spark, sf_dir):
    df = as_raw(table(spark, sf_dir, "events").select((F.col("event_id") % 256).alias("v")), "v")
    return read_table(spark, kept(spark, df)).groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, 'Ärende ' || n_name AS v FROM nation")
def latin1_to_utf8(spark, sf_dir):
    name = F.concat(F.lit("Ärende "), F.col("n_name"))
    latin = F.col("n_nationkey") % 2 == 0
    df = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(latin, F.encode(name, "ISO-8859-1")).otherwise(F.encode(name, "UTF-8")).alias("v"),
        F.when(latin, "latin1").otherwise("UTF-8").alias("enc"),
    )
    return read_table(spark, kept(spark, text_column(df, "v", "enc").drop("enc")))


# binary values


def _compressed_round_trip(name: str, **how) -> None:
    @query("SELECT doc_id, text FROM documents WHERE text <> ''", name)
    def round_trip(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").where("text <> ''")
        return docs.select("doc_id", decompress(compress(F.col("text"), **how)).cast("string").alias("text"))


_compressed_round_trip("compress_roundtrip_zstd", compressor="ZSTD", compression=10)
_compressed_round_trip("compress_roundtrip_lz4", compressor="LZ4")
_compressed_round_trip("compress_roundtrip_hash", compressor="ZSTD", compression=50, hash=True)


@query("SELECT true AS smaller, count(*) AS n FROM documents WHERE text <> ''")
def compress_ratio_positive(spark, sf_dir):
    """All texts together take less room compressed."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    sizes = docs.select(F.octet_length("text").alias("raw"), F.octet_length(compress(F.col("text"))).alias("packed"))
    return sizes.agg((F.sum("packed") < F.sum("raw")).alias("smaller"), F.count("*").alias("n"))


@query(
    "SELECT doc_id, damage, true AS detected FROM documents, (VALUES ('header'), ('payload')) AS d(damage) WHERE text <> ''"
)
def corruption_detected(spark, sf_dir):
    """Whether a damaged byte is noticed, for each damaged text by itself."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    packed = docs.select("doc_id", compress(F.col("text"), hash=True).alias("x"))
    last = (F.conv(F.hex(F.expr("substring(x, length(x), 1)")), 16, 10).cast("int") + 1) % 256
    broken = {
        "header": F.concat(F.expr("substring(x, 1, 24)"), F.lit(b"\xff"), F.expr("substring(x, 26)")),
        "payload": F.concat(F.expr("substring(x, 1, length(x) - 1)"), F.unhex(F.lpad(F.hex(last), 2, "0"))),
    }
    damaged = packed.select("doc_id", F.explode(F.create_map(*[v for k, x in broken.items() for v in (F.lit(k), x)])).alias("damage", "x"))
    return damaged.select("doc_id", "damage", is_damaged(F.col("x")).alias("detected"))


@query("SELECT count(DISTINCT text) AS n_hashes FROM documents")
def hash_flat_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.countDistinct(hash_blob(F.col("text"), block_hash=False)).alias("n_hashes"))


@query("SELECT count(DISTINCT text) AS n_hashes FROM documents")
def hash_block_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.countDistinct(hash_blob(F.col("text"))).alias("n_hashes"))


@query("SELECT doc_id, false AS same_seed, strlen(text) <= 16384 AS same_blocks FROM documents")
def hash_seed_differs(spark, sf_dir):
    text = F.col("text")
    flat, block, seeded = hash_blob(text, block_hash=False), hash_blob(text), hash_blob(text, seed=7, block_hash=False)
    return table(spark, sf_dir, "documents").select("doc_id", (flat == seeded).alias("same_seed"), (flat == block).alias("same_blocks"))


# workload


@query(
    "SELECT l_returnflag, l_linestatus, median(l_quantity) AS med_quantity, median(l_discount) AS med_discount, "
    "median(l_tax) AS med_tax, count(*) AS n FROM lineitem GROUP BY 1, 2"
)
def workload_group_median(spark, sf_dir):
    medians = {"med_quantity": "l_quantity", "med_discount": "l_discount", "med_tax": "l_tax"}
    return workload.group_median(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], medians)


@query(
    "SELECT row_number() OVER (ORDER BY status, o_orderkey) AS row_id, status, o_orderkey FROM (SELECT CASE o_orderstatus WHEN 'F' "
    "THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status, o_orderkey FROM orders)"
)
def workload_case_sort(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey")
    df = workload.relabelled(df, "status", {"F": "finished", "O": "open"}, "other")
    return read_table(spark, kept(spark, df, sort_by=["status", "o_orderkey"]), row_ids=True).withColumnRenamed(ROW_ID, "row_id")


@query(
    "SELECT l_returnflag, l_linestatus, l_linenumber, month(l_shipdate) AS ship_month, median(l_extendedprice) AS med_price, "
    "count(*) AS n FROM lineitem GROUP BY ALL"
)
def workload_group4(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("ship_month", F.month("l_shipdate").cast("long"))
    by = ["l_returnflag", "l_linestatus", "l_linenumber", "ship_month"]
    return workload.group_median(df, by, {"med_price": "l_extendedprice"})


@query(
    "SELECT l_returnflag, l_linestatus, median(l_quantity) AS med_quantity, count(*) AS n FROM lineitem "
    "WHERE l_discount > 0.04 AND l_returnflag <> 'N' GROUP BY 1, 2"
)
def workload_keyed_filter(spark, sf_dir):
    """Read a keyed table, filter its rows, then group them."""
    path = stored(spark, sf_dir, "lineitem", _LINE_ORDER)
    rows = read_table(spark, path, ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"], keyed=True)
    rows = rows.where((F.col("l_discount") > 0.04) & (F.col("l_returnflag") != "N"))
    return workload.group_median(rows, ["l_returnflag", "l_linestatus"], {"med_quantity": "l_quantity"})


@query(
    "SELECT * FROM (VALUES ('false', true), ('true', true), ('missing', true), ('integers', true), ('reals', true), ('cities', true)) AS t(share, near)"
)
def workload_sampled_table(spark, sf_dir):
    """The shares of a sampled table are near the weights it is drawn with."""
    n = 200_000
    logical = F.col("Logical")
    got = workload.sampled_table(spark, n).agg(
        F.sum(F.when(~logical, 1).otherwise(0)).alias("false"), F.sum(F.when(logical, 1).otherwise(0)).alias("true"),
        F.sum(F.when(logical.isNull(), 1).otherwise(0)).alias("missing"), F.countDistinct("Integer").alias("integers"),
        F.countDistinct("Real").alias("reals"), F.countDistinct("Factor").alias("cities"),
    )
    wanted = {"false": (0.10 * n, 0.005 * n), "true": (0.85 * n, 0.005 * n), "missing": (0.05 * n, 0.005 * n), "integers": (100, 0.5), "reals": (20, 0.5), "cities": (8, 0.5)}
    pairs = [x for k, (c, d) in wanted.items() for x in (F.lit(k), F.abs(F.col(k) - c) <= d)]
    return got.select(F.explode(F.create_map(*pairs)).alias("share", "near"))


# names, structure, snapshots, session, errors


@query("SELECT o_orderkey, o_custkey FROM orders")
def second_names_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "table")
    table_write(table(spark, sf_dir, "orders"), path, 60)
    if table_metadata(spark, path).rows != metadata(spark, path).rows:
        raise AssertionError("the two names differ")
    return table_read(spark, path, ["o_orderkey", "o_custkey"])


@query("SELECT column_index AS at, column_name AS name FROM duckdb_columns() WHERE table_name = 'orders'")
def names_table(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(orders_ref(spark, sf_dir).names, 1)), "at int, name string")


@query("SELECT count(*) AS n_row, any_value(k) AS n_col FROM nation, (SELECT count(*) AS k FROM duckdb_columns() WHERE table_name = 'nation')")
def dim_of_rows_and_names(spark, sf_dir):
    rows, names = TableRef(spark, stored(spark, sf_dir, "nation", ["n_nationkey"])).dimnames()
    return rows.agg(F.count("*").alias("n_row")).withColumn("n_col", F.lit(len(names)).cast("long"))


_SMALL = "(VALUES (1, 'a', 4.5::DOUBLE), (2, 'b', 5.5), (3, 'c', NULL)) AS t(x, y, z)"


def small(spark: SparkSession) -> str:
    return kept(spark, spark.createDataFrame([(1, "a", 4.5), (2, "b", 5.5), (3, "c", None)], "x int, y string, z double"))


@query("SELECT * FROM (VALUES (1, ' $ x: integer <int>'), (2, ' $ y: character <string>'), (3, ' $ z: double <double>')) AS t(line, said)")
def structure_lines(spark, sf_dir):
    lines = TableRef(spark, small(spark)).structure().split("\n")[1:]
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, said string")


@query("SELECT * FROM (VALUES ('opened', 3), ('still', 3), ('refreshed', 5)) AS t(moment, n)")
def snapshot_and_refresh(spark, sf_dir):
    path = small(spark)
    t = TableRef(spark, path)
    seen = [("opened", len(t))]
    write_table(spark.range(5), path)
    seen += [("still", len(t)), ("refreshed", len(t.refresh()))]
    return spark.createDataFrame(seen, "moment string, n long")


@query(f"SELECT z, x FROM {_SMALL}")
def select_columns_by_one_index(spark, sf_dir):
    return TableRef(spark, small(spark)).select_columns([3, 1]).df


@query(
    "SELECT * FROM (VALUES ('x[j]', false), ('x[, j]', true), ('x[, j, drop = no]', false), ('x[i, j]', true), ('x[i, two]', false), "
    "('x[i, ]', false), ('one column, x[i, ]', true)) AS t(selection, dropped)"
)
def drop_rule(spark, sf_dir):
    t, one = TableRef(spark, small(spark)), TableRef(spark, kept(spark, spark.range(3)))
    found = [
        ("x[j]", t.select_columns("x")), ("x[, j]", t.select(None, "x")), ("x[, j, drop = no]", t.select(None, "x", drop=False)),
        ("x[i, j]", t.select([1, 2], 2)), ("x[i, two]", t.select([1, 2], ["x", "y"])), ("x[i, ]", t.select([1])),
        ("one column, x[i, ]", one.select([1])),
    ]
    return spark.createDataFrame([(k, s.dropped) for k, s in found], "selection string, dropped boolean")


@query("SELECT o_custkey FROM orders")
def one_column_by_position(spark, sf_dir):
    return orders_ref(spark, sf_dir).column(2)


@query("SELECT o_totalprice FROM orders")
def one_column_by_name(spark, sf_dir):
    return orders_ref(spark, sf_dir).col("o_totalprice")


@query("SELECT 'n_nationkey' AS name, CAST(sum(hash_of) AS BIGINT) AS n FROM (SELECT 1 AS hash_of FROM nation) UNION ALL SELECT 'n_name', count(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey) FROM nation")
def list_of_columns(spark, sf_dir):
    """Every column by itself, as a list holds them."""
    found = None
    for name, column in TableRef(spark, stored(spark, sf_dir, "nation", ["n_nationkey"])).as_dict().items():
        part = column.agg(F.count(name).alias("n")).select(F.lit(name).alias("name"), "n")
        found = part if found is None else found.unionByName(part)
    return found


@query("SELECT * FROM (VALUES ('before 3', true), ('before 5', true), ('option 6', true), ('changed later', true)) AS t(step, holds)")
def threads_and_option(spark, sf_dir):
    """Setting the parallelism returns the value before; a session's option is read once."""
    before = threads(spark)
    try:
        steps = [("before 3", threads(spark, 3) == before), ("before 5", threads(spark, 5) == 3)]
    finally:
        threads(spark, before)
    fresh = spark.newSession()
    fresh.conf.set(OPTION, "6")
    steps.append(("option 6", threads(fresh) == 6))
    fresh.conf.set(OPTION, "2")
    steps.append(("changed later", threads(fresh) == 6 and threads(spark) == before))
    return spark.createDataFrame(steps, "step string, holds boolean")


_ERRORS = {
    "path is no text": "Please specify a correct path.",
    "no data frame": "Please make sure 'x' is a data frame.",
    "columns are no names": "Parameter 'columns' should be a character vector of column names.",
    "from below 1": "Parameter 'from' should have a numerical value equal or larger than 1.",
    "to is no number": "Parameter 'to' should have a numerical value larger than 1 (or NULL).",
    "from past the end": "Row selection is out of range",
    "old format": "Parameter old_format is deprecated; tables of that format can't be read.",
    "unknown column": "Undefined columns: q",
    "missing column index": "Subscript out of bounds.",
    "column index too large": "Subscript out of bounds.",
    "column index of zero": "Only positive column indexes supported.",
    "no column": "Please use a length one integer or character vector to specify the column",
    "index of three": "Recursive indexing is currently only supported up to level 1.",
    "a pair of names": "Subscript out of bounds.",
    "row outside": "Second index out of bounds.",
    "index of another type": "Please use a length 1 integer or character vector to specify the column",
    "invalid column": "Invalid column index 9",
    "rows by text": "Row selection should be done using a numeric or logical vector",
    "rows out of range": "Row selection out of range",
    "level outside": "Parameter compress should be a value between 0 and 100.",
    "fork flag": "Parameter reset_after_fork should be set to TRUE or FALSE",
}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS trigger, '{v.replace("'", "''")}' AS message""" for k, v in _ERRORS.items()))
def error_contract(spark, sf_dir):
    """What each wrong call says."""
    path = small(spark)
    t, df = TableRef(spark, path), spark.range(1)
    calls = {
        "path is no text": lambda: write_table(df, 3),
        "no data frame": lambda: write_table([1], path),
        "columns are no names": lambda: read_table(spark, path, [1]),
        "from below 1": lambda: read_table(spark, path, from_=0),
        "to is no number": lambda: read_table(spark, path, to="a"),
        "from past the end": lambda: read_table(spark, path, from_=9),
        "old format": lambda: read_table(spark, path, old_format=True),
        "unknown column": lambda: t["q"],
        "missing column index": lambda: t[[1, None]],
        "column index too large": lambda: t[4],
        "column index of zero": lambda: t[0],
        "no column": lambda: t.column([]),
        "index of three": lambda: t.column([1, 2, 3]),
        "a pair of names": lambda: t.column(["x", "y"]),
        "row outside": lambda: t.column([1, 9]),
        "index of another type": lambda: t.column(2.5j),
        "invalid column": lambda: t.column(9),
        "rows by text": lambda: t[["a"], :],
        "rows out of range": lambda: t[[9], :],
        "level outside": lambda: write_table(df, path, compress=101),
        "fork flag": lambda: threads(spark, reset_after_fork="yes"),
    }
    said = []
    for trigger, call in calls.items():
        try:
            call()
        except (ValueError, TypeError, LookupError) as e:
            said.append((trigger, str(e.args[0])))
    return spark.createDataFrame(said, "trigger string, message string")


@query(
    "SELECT * FROM (VALUES ('nothing there', 'Error opening table for reading'), ('another folder', 'File header information does not contain "
    "the table format marker'), ('plain Parquet', 'File header information does not contain the table format marker')) AS t(place, message)"
)
def format_marker(spark, sf_dir):
    """What opening a place that holds no table says, without the place itself."""
    plain, deep = scratch_path(spark, "plain"), scratch_path(spark, "deep")
    spark.range(3).write.parquet(plain)
    spark.range(3).write.parquet(f"{deep}/rows")
    said = []
    for place, path in {"nothing there": scratch_path(spark, "none"), "another folder": deep, "plain Parquet": plain}.items():
        try:
            read_table(spark, path)
        except (OSError, ValueError) as e:
            said.append((place, str(e).split(": ")[0]))
    return spark.createDataFrame(said, "place string, message string")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: two columns of a row range of a stored table."""
    return read_row_range_columns(spark, "/root/testdata/sf0.001")
