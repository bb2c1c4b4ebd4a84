"""Positional selection, compared with the same selection on a list of rows, and printing."""

import pytest
from pyspark.sql import functions as F

from rowquarry.functions.factors import factor
from rowquarry.operators.table import TableRef
from rowquarry.sources.store import write_table

LETTERS = [chr(65 + i) for i in range(26)]
DATA = [(i + 1, LETTERS[i], 4 + i / 10) for i in range(26)]


@pytest.fixture(scope="module")
def ref(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('t')}/frame"
    write_table(spark.createDataFrame(DATA, "X int, Y string, Z double").repartition(1).sortWithinPartitions("X"), path)
    return TableRef(spark, path)


@pytest.fixture(scope="module")
def single(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('t')}/one"
    write_table(spark.range(1, 27, 1, 2).select(F.col("id").cast("int").alias("X")), path)
    return TableRef(spark, path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def at(ref, i, j=None):
    return [tuple(r)[1:] for r in sorted(ref.rows(i, j).collect(), key=lambda r: r[0])]


def test_what_is_known_without_reading(ref, spark):
    assert ref.dim == (26, 3) and len(ref) == 26 and ref.names == ["X", "Y", "Z"]
    assert [r[0] for r in ref.row_names().collect()] == [str(i) for i in range(1, 27)]
    assert ref.dimnames()[1] == ["X", "Y", "Z"]
    assert ref.structure().split("\n")[1:] == [" $ X: integer <int>", " $ Y: character <string>", " $ Z: double <double>"]


@pytest.mark.parametrize("j,names", [
    ("Y", "Y"), (["Z", "X"], "ZX"), (2, "Y"), ([3, 1], "ZX"), (2.6, "Y"), ([True, False], "XZ"), (True, "XYZ"), ([False, True, True], "YZ"),
])
def test_columns(ref, j, names):
    want = [tuple(r["XYZ".index(n)] for n in names) for r in DATA]
    assert ref[j].columns == list(names) and rows(ref[j]) == sorted(want)
    assert rows(ref[:, j]) == sorted(want)


def test_all_of_it(ref):
    for df in (ref[:], ref[:, :], ref.df(), ref.select().df):
        assert rows(df) == DATA
    assert {k: rows(v) for k, v in ref.as_dict().items()} == {n: sorted((r[k],) for r in DATA) for k, n in enumerate("XYZ")}


@pytest.mark.parametrize("i", [range(2, 11), [5], 7, [4, 5, 6], [9, 3, 3, 26, 1], range(26, 27), 3.7, [26, 25, 24]])
def test_rows_in_any_order(ref, i):
    numbers = list(i) if isinstance(i, (range, list)) else [int(i)]
    assert at(ref, i) == [DATA[n - 1] for n in numbers]
    assert rows(ref[i, ["Z", "Y"]]) == sorted((DATA[n - 1][2], DATA[n - 1][1]) for n in numbers)


def test_row_masks_are_not_recycled(ref):
    mask = [True, None, False, True]
    assert at(ref, mask) == [DATA[0], DATA[3]]
    assert rows(ref[F.col("Z") > 6.0, "Y"]) == [(r[1],) for r in DATA if r[2] > 6.0]
    missing = F.when(F.col("X") % 2 == 0, F.lit(None)).otherwise(F.col("X") < 6)
    assert rows(ref[missing, "X"]) == [(1,), (3,), (5,)]


def test_empty_selections(ref):
    for i in ([], range(5, 5), [False, False]):
        assert ref[i, :].count() == 0 and ref[i, :].columns == ["X", "Y", "Z"]
    assert ref[[]].columns == []


def test_many_rows_use_a_range_and_a_shuffle(single, monkeypatch):
    from rowquarry.plans import gather

    numbers = [26, 1, 1, 13]
    for few, bound in ((1, 500), (1, 0)):
        monkeypatch.setattr(gather, "FEW", few)
        monkeypatch.setattr(gather, "BROADCAST_ROWS", bound)
        assert at(single, numbers) == [(n,) for n in numbers]


def test_gather_by_a_table_of_numbers(ref, spark):
    index = spark.createDataFrame([(7, "a"), (7, "b"), (26, "c")], "row long, tag string")
    assert rows(ref.gather(index, j="Y").drop("row")) == [("a", "G"), ("b", "G"), ("c", "Z")]
    with pytest.raises(Exception, match="Row selection out of range"):
        ref.gather(spark.createDataFrame([(27,)], "row long")).collect()
    with pytest.raises(ValueError, match="columns of the table: Y"):
        ref.gather(index.withColumnRenamed("tag", "Y"))


def test_dropping(ref, single):
    assert ref.select(j="X").dropped and ref.select([1, 2], 2).dropped
    assert not ref.select(j="X", drop=False).dropped and not ref.select([1, 2]).dropped and not ref.select(j=[1, 2]).dropped
    assert not ref.select_columns("X").dropped
    # all columns of a table of one column
    assert single.select([3, 4], drop=False).dropped and not single.select(j="X", drop=False).dropped


def test_single_columns_and_cells(ref):
    assert rows(ref.column("Y")) == rows(ref.column(2)) == rows(ref.col("Y")) == [(x,) for x in LETTERS]
    assert ref.column("missing") is None and ref.col("x") is None
    assert rows(ref.cell(3, 5)) == rows(ref.column([3, 5])) == [(4.4,)]
    with pytest.warns(UserWarning, match="exact ignored"):
        ref.column("X", exact=False)


@pytest.mark.parametrize("call,error,text", [
    (lambda t: t[["A", "X", "B"]], KeyError, "Undefined columns: A, B"),
    (lambda t: t[4], IndexError, "Subscript out of bounds."),
    (lambda t: t[3.5], IndexError, "Subscript out of bounds."),
    (lambda t: t[0.5], IndexError, "Subscript out of bounds."),
    (lambda t: t[[1, None]], IndexError, "Subscript out of bounds."),
    (lambda t: t[[True, None]], IndexError, "Subscript out of bounds."),
    (lambda t: t[[True] * 4], IndexError, "Subscript out of bounds."),
    (lambda t: t[-1], IndexError, "Only positive column indexes supported."),
    (lambda t: t[0], IndexError, "Only positive column indexes supported."),
    (lambda t: t["a", "X"], TypeError, "Row selection should be done"),
    (lambda t: t[[1, 27], :], IndexError, "Row selection out of range"),
    (lambda t: t[range(20, 30), :], IndexError, "Row selection out of range"),
    (lambda t: t[[-1, 3], :], IndexError, "Row selection out of range"),
    (lambda t: t[[0, 3], :], ValueError, "Parameter 'from'"),
    (lambda t: t[[2, None], :], IndexError, "Subscript out of bounds."),
    (lambda t: t[[False] * 26 + [True], :], IndexError, "Row selection out of range"),
    (lambda t: t.column([]), IndexError, "length one integer"),
    (lambda t: t.column([1, 2, 3]), IndexError, "up to level 1"),
    (lambda t: t.column(["X", "Y"]), IndexError, "Subscript out of bounds."),
    (lambda t: t.column([1, 27]), IndexError, "Second index out of bounds."),
    (lambda t: t.column([9, 1]), IndexError, "Subscript out of bounds."),
    (lambda t: t.column(True), TypeError, "length 1 integer"),
    (lambda t: t.column(4), IndexError, "Invalid column index 4"),
    (lambda t: t.column(-3), IndexError, "Invalid column index -3"),
])
def test_errors(ref, call, error, text):
    with pytest.raises(error, match=text.replace(".", r"\.")):
        call(ref)


def test_a_reference_is_a_snapshot(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_table(spark.range(5), path)
    old = TableRef(spark, path)
    write_table(spark.range(9), path)
    assert old.nrow == 5 and old.refresh().nrow == 9


def printed(spark, tmp_path, df, **how):
    path = f"{tmp_path}/frame"
    write_table(df.coalesce(1), path)
    return TableRef(spark, path).preview(**how).split("\n")


def test_print_one_cell(spark, tmp_path):
    assert printed(spark, tmp_path, spark.createDataFrame([(1.0,)], "X double")) == [
        "<rowquarry table>", "1 rows, 1 columns (frame)", "", "         X", "  <double>", "1        1",
    ]


def test_print_head_and_tail(spark, tmp_path):
    df = factor(spark.createDataFrame([(i + 1, LETTERS[i % 26]) for i in range(104)], "X int, Y string"), "Y")
    assert printed(spark, tmp_path, df) == [
        "<rowquarry table>", "104 rows, 2 columns (frame)", "",
        "            X        Y",
        "    <integer> <factor>",
        *[f"{i}           {i}        {LETTERS[i - 1]}" for i in range(1, 6)],
        "--         --       --",
        *[f"{i}       {i}        {LETTERS[(i - 1) % 26]}" for i in range(100, 105)],
    ]


def test_print_small_and_none(spark, tmp_path):
    df = spark.createDataFrame([(i + 1, LETTERS[i + 9]) for i in range(9)], "X int, Y string")
    lines = printed(spark, tmp_path, df)
    assert lines[3:6] == ["          X           Y", "  <integer> <character>", "1         1           J"] and len(lines) == 14
    assert len(printed(spark, tmp_path, df, number_of_rows=0)) == 3
    assert len(printed(spark, tmp_path, df, number_of_rows=3)) == 14  # up to ten rows are never split
    many = spark.range(60)
    assert len(printed(spark, tmp_path, many, number_of_rows=float("inf"))) == 65
    assert len(printed(spark, tmp_path, many, number_of_rows="x")) == 65


def test_print_values_and_wrapping(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.25, None), (True, 100.0, "a"), (False, None, "bcd")], "L boolean, D double, S string")
    lines = printed(spark, tmp_path, df)
    assert lines[5:] == ["1        NA     1.25        <NA>", "2      TRUE   100.00        a   ", "3     FALSE       NA        bcd "]
    wide = spark.range(1).select(*[F.lit(k).alias(f"column_{k}") for k in range(12)])
    lines = printed(spark, tmp_path, wide)
    assert max(map(len, lines)) <= 80 and sum("column_" in x for x in lines) == 2
