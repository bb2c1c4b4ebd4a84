"""Writing and reading: round trips, ranges, keys, types, errors."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.functions.factors import factor, factor_code, factor_value, levels
from rowquarry.operators.table import TableRef
from rowquarry.sources import store as store_module
from rowquarry.sources.store import codec_options, metadata, open_store, read_table, stored_key, write_table
from rowquarry.types import as_difftime, as_idate, as_itime, as_nanotime, as_posixct, as_raw


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/table"


def rows(df):
    return [tuple(r) for r in df.collect()]


def in_order(df):
    return [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: r[-1])]


def frame(spark, n=10_000, parts=3):
    k = F.col("id")
    return spark.range(1, n + 1, 1, parts).select(
        k.cast("int").alias("Xint"), F.when(k % 3 == 0, None).otherwise(k % 3 == 1).alias("Ylog"),
        (k * 0.1 + 1 / 3).alias("Zdoub"), F.concat(F.lit("s"), k % 17).alias("Qchar"),
        F.when(k % 10 != 0, F.hex(k * 7919)).alias("char_na"), F.date_add(F.lit("2015-01-01").cast("date"), k.cast("int")).alias("Date"),
    )


@pytest.mark.parametrize("level", [0, 30, 60, 100])
@pytest.mark.parametrize("n", [30, 8193])
def test_round_trip_keeps_rows_and_order(spark, path, level, n):
    df = frame(spark, n)
    assert write_table(df, path, compress=level) is df
    assert in_order(read_table(spark, path, row_ids=True)) == rows(df)


def test_levels_choose_codecs(spark, path):
    assert codec_options(0) == {"compression": "uncompressed"}
    assert codec_options(50.9)["compression"] == "lz4_raw"
    assert codec_options(51)["parquet.compression.codec.zstd.level"] == "1"
    assert codec_options(100)["parquet.compression.codec.zstd.level"] == "12"
    for bad in (-1, 101, "40", True):
        with pytest.raises(ValueError):
            codec_options(bad)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_row_numbers_are_1_to_n_and_stable(spark, path, parts):
    df = spark.range(0, 5000, 1, parts).where("id % 7 <> 3 and id > 900")  # leaves empty tasks as well
    write_table(df, path)
    got = sorted(rows(read_table(spark, path, row_ids=True)), key=lambda r: r[1])
    assert [r[1] for r in got] == list(range(1, len(got) + 1))
    assert [r[0] for r in got] == [r[0] for r in rows(df)]


def test_row_numbers_of_many_tasks_come_from_a_table(spark, path, monkeypatch):
    from rowquarry.plans import rowids

    df = spark.range(0, 1000, 1, 20)
    write_table(df, path)
    monkeypatch.setattr(rowids, "LITERAL_TASKS", 2)
    assert in_order(read_table(spark, path, row_ids=True)) == rows(df)


@pytest.mark.parametrize("lo,hi", [(10, None), (1, 8), (4, 13), (4, 7000), (7, 13), (2048, 2049), (4096, 8193), (9990, 20_000), (1.9, 2.9)])
def test_ranges(spark, path, lo, hi):
    df = frame(spark)
    write_table(df, path)
    want = rows(df)[int(lo) - 1 : None if hi is None else int(hi)]
    assert in_order(read_table(spark, path, from_=lo, to=hi, row_ids=True)) == want


def test_a_range_reads_few_rows(spark, path):
    write_table(spark.range(0, 200_000, 1, 1).withColumn("v", F.col("id") * 2), path)
    df = read_table(spark, path, ["v"], from_=50_000, to=50_100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(__pos), GreaterThanOrEqual(__pos" in plan and "id#" not in plan.split("FileScan")[1].split("Batched")[0]
    assert df.count() == 101


def test_columns_come_as_asked(spark, path):
    write_table(frame(spark, 30), path)
    df = read_table(spark, path, ["Zdoub", "Xint"], from_=3, to=4, row_ids=True)
    assert df.columns == ["Zdoub", "Xint", "__row_id"]
    assert [r[1] for r in in_order(df)] == [3, 4]


def test_argument_errors(spark, path, tmp_path):
    df = frame(spark, 30)
    write_table(df, path)
    for bad in (0, -3, "1", None, float("nan"), [1, 2]):
        with pytest.raises(ValueError, match="Parameter 'from'"):
            read_table(spark, path, from_=bad)
    for bad in ("4", 0, [3, 4]):
        with pytest.raises(ValueError, match="Parameter 'to'"):
            read_table(spark, path, to=bad)
    for lo, hi in ((31, None), (9, 4)):
        with pytest.raises(IndexError, match="Row selection is out of range"):
            read_table(spark, path, from_=lo, to=hi)
    with pytest.raises(KeyError, match="Undefined columns: bla, blu"):
        read_table(spark, path, ["bla", "Xint", "blu"])
    with pytest.raises(KeyError):
        read_table(spark, path, ["xINT"])  # names are case-sensitive
    with pytest.raises(TypeError, match="Parameter 'columns'"):
        read_table(spark, path, [1, 2])
    with pytest.raises(ValueError):
        read_table(spark, path, ["Xint", "Xint"])
    with pytest.raises(TypeError, match="correct path"):
        write_table(df, 5)
    with pytest.raises(TypeError, match="data frame"):
        write_table([1, 2], path)
    with pytest.raises(ValueError, match="old_format"):
        read_table(spark, path, old_format=True)
    with pytest.raises(FileNotFoundError, match="Error opening table for reading"):
        read_table(spark, f"{tmp_path}/none")
    df.write.parquet(f"{tmp_path}/plain")
    with pytest.raises(ValueError, match="format marker"):
        read_table(spark, f"{tmp_path}/plain")


@pytest.mark.parametrize("kind", ["array<int>", "map<string,int>", "struct<a:int>", "decimal(10,2)"])
def test_other_types_are_refused(spark, path, kind):
    with pytest.raises(TypeError, match="Unknown type found in column 'v'"):
        write_table(spark.createDataFrame([], f"v {kind}"), path)


def test_reserved_and_repeated_names_are_refused(spark, path):
    for names in ("__pos", "__row_id"):
        with pytest.raises(ValueError, match="Reserved"):
            write_table(spark.range(3).withColumnRenamed("id", names), path)
    with pytest.raises(ValueError, match="repeated"):
        write_table(spark.range(3).select("id", "id"), path)


def test_overwriting_also_from_the_same_table(spark, path):
    write_table(spark.range(10), path)
    write_table(frame(spark, 30), path)
    assert open_store(spark, path).meta.rows == 30
    write_table(read_table(spark, path, ["Xint"]).where("Xint > 20"), path)
    assert sorted(r[0] for r in rows(read_table(spark, path))) == list(range(21, 31))


def test_a_failed_write_leaves_the_old_table(spark, path, tmp_path):
    write_table(spark.range(10), path)
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("int").alias("v"))
    with pytest.raises(Exception, match="no"):
        write_table(bad, path)
    assert read_table(spark, path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


class Folders:
    """A file system whose renames fail or throw when they are told to."""

    def __init__(self, fs, fail, throw):
        self.fs, self.fail, self.throw, self.n = fs, fail, throw, 0

    def rename(self, a, b):
        self.n += 1
        if self.n in self.fail:
            if self.throw:
                return self.fs.rename(self.fs.getUri(), b)  # no such method: an error of the JVM
            return False
        return self.fs.rename(a, b)

    def __getattr__(self, name):
        return getattr(self.fs, name)


@pytest.mark.parametrize("throw", [False, True])
@pytest.mark.parametrize("fail", [{1}, {2}, {2, 3}])
def test_a_failed_rename_loses_no_table(spark, path, tmp_path, monkeypatch, fail, throw):
    from py4j.protocol import Py4JError

    from rowquarry.sources import store

    write_table(spark.range(10), path)
    folders = []

    def hadoop_path(spark, at):
        fs, found = real(spark, at)
        folders[:] = folders or [Folders(fs, fail, throw)]
        return folders[0], found

    real = store.hadoop_path
    monkeypatch.setattr(store, "hadoop_path", hadoop_path)
    monkeypatch.setattr(store, "Py4JJavaError", Py4JError)
    with pytest.raises(OSError, match="for writing") as e:
        write_table(spark.range(5), path)
    monkeypatch.undo()
    if 3 in fail:  # neither could take the place: both are there, and the error says where
        old, new = re.search(r"before is (\S+), the new one (\S+)", str(e.value)).groups()
        assert [read_table(spark, p).count() for p in (old, new)] == [10, 5]
    else:
        assert read_table(spark, path).count() == 10
        assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_empty_tables(spark, path):
    df = frame(spark, 30).where("false")
    write_table(df, path)
    assert read_table(spark, path, from_=1, row_ids=True).count() == 0
    assert metadata(spark, path).column_types == [5, 15, 10, 2, 2, 11]
    with pytest.raises(IndexError):
        read_table(spark, path, from_=2)
    write_table(spark.range(4).select(), path)
    assert open_store(spark, path).meta.column_names == []
    assert TableRef(spark, path).dim == (4, 0)


def test_missing_and_special_values(spark, path):
    data = [(True, math.inf, "a"), (False, -math.inf, ""), (None, math.nan, None), (None, None, None), (True, 1 / 3, "é")]
    write_table(spark.createDataFrame(data, "b boolean, d double, s string").coalesce(1), path)
    got = in_order(read_table(spark, path, row_ids=True))
    assert [r[0] for r in got] == [r[0] for r in data] and [r[2] for r in got] == [r[2] for r in data]
    assert math.isnan(got[2][1]) and [got[i][1] for i in (0, 1, 3, 4)] == [math.inf, -math.inf, None, 1 / 3]


def test_names_of_any_kind(spark, path):
    names = ["Ärende", "a b", "x.y", "tick`tock", "日本"]
    df = spark.createDataFrame([tuple(range(5))], names)
    write_table(df, path)
    assert read_table(spark, path).columns == names
    assert rows(TableRef(spark, path)[["x.y", "tick`tock"]]) == [(2, 3)]


def test_keys_and_their_prefixes(spark, path):
    df = spark.range(1, 11, 1, 1).select(*[(F.col("id") * k).cast("int").alias(c) for k, c in enumerate("ABCDE", 1)])
    write_table(df, path, key=["A", "B", "D"])
    assert metadata(spark, path).keys == ["A", "B", "D"]
    assert metadata(spark, path).key_col_index == [1, 2, 4]
    for columns, key in ((None, ["A", "B", "D"]), (["C", "B", "A"], ["A", "B"]), (["A", "C", "D"], ["A"]), (["B", "C", "D"], None)):
        assert stored_key(read_table(spark, path, columns, keyed=True)) == key
        assert stored_key(read_table(spark, path, columns)) is None
    with pytest.raises(ValueError, match="Undefined columns: Z"):
        write_table(df, path, key=["A", "Z"])
    # a truncated key does not come back when its missing column does
    write_table(read_table(spark, path, ["B", "D"], keyed=True), f"{path}2")
    assert metadata(spark, f"{path}2").keys is None


def test_sort_by_sorts_and_records(spark, path):
    df = spark.createDataFrame([(2, "b"), (None, "c"), (1, "z"), (2, "a")], "k int, v string").repartition(3)
    write_table(df, path, sort_by=["k", "v"])
    assert in_order(read_table(spark, path, row_ids=True)) == [(None, "c"), (1, "z"), (2, "a"), (2, "b")]
    assert metadata(spark, path).keys == ["k", "v"]


def test_pages_are_small(spark, path):
    import glob

    import pyarrow.parquet as pq

    write_table(spark.range(0, 100_000, 1, 1), path)
    (file,) = glob.glob(f"{path}/rows/*.parquet")
    column = pq.ParquetFile(file).metadata.row_group(0).column(1)
    assert column.path_in_schema == "__pos" and column.has_column_index and column.has_offset_index
    assert store_module.PAGE_ROWS == 4096


# types


def sample(spark):
    k = F.col("id")
    df = spark.range(1, 11, 1, 1).select(
        k.cast("int").alias("A"), (k % 2 == 0).alias("B"), (k / 3).alias("C"), F.date_add(F.lit("2010-01-01").cast("date"), k.cast("int")).alias("D"),
        k.cast("string").alias("E"), F.concat(F.lit("f"), k % 3).alias("F"), F.timestamp_micros(k * 1_234_567).alias("G"),
        F.timestamp_micros(k * 1_234_567).alias("H"), F.date_add(F.lit("2010-01-01").cast("date"), k.cast("int")).alias("I"),
        (k * 20).alias("J"), F.concat(F.lit("k"), k % 3).alias("K"), (k / 2).alias("L"), k.alias("M"), (k * 1000).cast("int").alias("N"),
        (k * 2345612345679).alias("O"), (k * 1_000_000_007).alias("P"),
    )
    df = as_raw(as_idate(as_posixct(as_posixct(df, "G", ""), "H", storage="int"), "I"), "J")
    df = factor(factor(df, "F"), "K", ["k2", "k1", "k0", "unused"], ordered=True)
    return as_nanotime(as_itime(as_difftime(as_difftime(df, "L", "mins"), "M", storage="int"), "N"), "P")


def test_type_codes_and_printed_metadata(spark, path):
    write_table(sample(spark), path, compress=100)
    meta = metadata(spark, path)
    assert meta.rows == 10 and meta.keys is None and meta.column_names == list("ABCDEFGHIJKLMNOP")
    assert meta.column_base_types == [4, 6, 5, 5, 2, 3, 5, 4, 4, 8, 3, 5, 4, 4, 7, 7]
    assert meta.column_types == [5, 15, 10, 11, 2, 3, 12, 6, 8, 18, 4, 13, 7, 9, 16, 17]
    assert str(meta).split("\n")[:6] == [
        "<rowquarry table>", "10 rows, 16 columns (table)", "", "* 'A': integer", "* 'B': logical", "* 'C': double",
    ]
    write_table(sample(spark), path, sort_by=["D", "K", "B"])
    lines = str(metadata(spark, path)).split("\n")
    assert lines[3:7] == ["* 'D': Date (key 1)", "* 'K': ordered factor (key 2)", "* 'B': logical (key 3)", "* 'A': integer"]
    assert lines[-1] == "* 'P': nanotime" and len(lines) == 19


def test_names_are_padded_in_printed_metadata(spark, path):
    write_table(spark.createDataFrame([(1, 2)], ["a", "long'name"]), path)
    assert metadata(spark, path).lines()[3:] == ["* 'a'         : integer64", "* 'long\\'name': integer64"]


def test_times_keep_values_and_zones(spark, path):
    times = [dt.datetime(2001, 10, 10, 1, 2, 3, us) for us in range(4)]
    df = spark.createDataFrame([(t, t, t) for t in times], "named timestamp, local timestamp, bare timestamp").coalesce(1)
    df = as_posixct(as_posixct(as_posixct(df, "named", "US/Pacific"), "local", ""), "bare")
    want = rows(df.select(*[F.unix_micros(c) for c in df.columns]))
    write_table(df, path)
    got = read_table(spark, path)
    assert rows(got.select(*[F.unix_micros(c) for c in got.columns])) == want
    zones = [got.schema[c].metadata.get("tzone") for c in got.columns]
    assert zones == ["US/Pacific", "", None]


def test_durations_and_raw_values(spark, path):
    df = spark.createDataFrame([(1.5, 90, 255), (None, None, 0), (-2.0, 1, 7)], "d double, m int, r int").coalesce(1)
    df = as_raw(as_difftime(as_difftime(df, "d", "mins"), "m", "mins", storage="int"), "r")
    write_table(df, path)
    got = in_order(read_table(spark, path, row_ids=True))
    assert got[0] == (dt.timedelta(seconds=90), dt.timedelta(minutes=90), 255)
    assert got[1] == (None, None, 0) and got[2][0] == dt.timedelta(minutes=-2)
    assert read_table(spark, path).schema["r"].dataType == T.ShortType()
    with pytest.raises(Exception, match="byte from 0 to 255"):
        as_raw(spark.createDataFrame([(256,)], "r int"), "r").collect()
    with pytest.raises(TypeError):
        as_nanotime(spark.createDataFrame([(1.0,)], "n double"), "n")


# factors


@pytest.mark.parametrize("n,cut", [(10, 8), (257, 4), (128, 1)])
def test_a_subset_keeps_all_levels(spark, path, n, cut):
    names = [f"X{i}" for i in range(n, 0, -1)]
    df = spark.createDataFrame([(names[i % n],) for i in range(30)], "f string").coalesce(1)
    write_table(factor(df, "f", names), path)
    got = read_table(spark, path, to=cut)
    assert levels(got, "f") == names and [r[0] for r in rows(got)] == [names[i % n] for i in range(cut)]


def test_very_many_levels_live_in_a_table(spark, path):
    n = 12_000
    names = [f"L{i:06d}" for i in range(n)]
    df = spark.createDataFrame([(names[i],) for i in (0, 11_999, 5)] + [("no level",), (None,)], "f string").coalesce(1)
    write_table(factor(df, "f", names, ordered=True), path)
    ref = TableRef(spark, path)
    assert ref.meta.column_types == [4]
    table = ref.levels("f")
    assert table.count() == n and table.where("level = 'L000005'").first().code == 6
    assert sorted(r[0] or "" for r in rows(ref.df())) == ["", "", "L000000", "L000005", "L011999"]
    write_table(read_table(spark, path), f"{path}2")  # levels move along
    assert TableRef(spark, f"{path}2").levels("f").count() == n


def test_many_inline_levels_are_looked_up_by_a_hash(spark, path):
    from rowquarry.functions import factors

    names = [f"level {k % 7}{k}" for k in range(700)] + ["é", ""]
    df = spark.createDataFrame([(x,) for x in [*names[::-1], "none of them", None]], "f string")
    got = df.select("f", factors.code_of(F.col("f"), names).alias("code")).collect()
    assert {r.f: r.code for r in got} == {x: k for k, x in enumerate(names, 1)} | {"none of them": None, None: None}
    few = df.select("f", factors.code_of(F.col("f"), names[:50]).alias("code")).where("code is not null").collect()
    assert {r.f: r.code for r in few} == {x: k for k, x in enumerate(names[:50], 1)}


def test_missing_codes_and_missing_levels_differ(spark, path):
    df = spark.createDataFrame([("abc",), ("def",), (None,), ("other",)], "x string").coalesce(1)
    plain, known = factor(df, "x", ["abc", "def"]), factor(df, "x", ["abc", "def"], na_level=True)
    for f, codes, all_levels in ((plain, [1, 2, None, None], ["abc", "def"]), (known, [1, 2, 3, None], ["abc", "def", None])):
        write_table(f, path)
        got = read_table(spark, path)
        assert [r[0] for r in rows(got.select(factor_code(got, "x")))] == codes and levels(got, "x") == all_levels
        assert [r[0] for r in rows(got.select(factor_value(got, "x")))] == ["abc", "def", None, None]


def test_factors_without_values_or_levels(spark, path):
    df = factor(spark.createDataFrame([(1, None), (2, None)], "a int, b string"), "b")
    write_table(df, path)
    assert levels(read_table(spark, path), "b") == [] and metadata(spark, path).column_types == [5, 3]
    with pytest.raises(ValueError, match="distinct"):
        factor(df, "b", ["x", "x"])
