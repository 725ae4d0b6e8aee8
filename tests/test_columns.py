import datetime as dt

import pytest
from pyspark.sql import functions as F

from cleanloom.functions.columns import (
    has_non_ascii, has_outer_space, kinds, nan_to_null, number_without_commas, parse_date, parse_date_as, ref, strip,
    to_number)
from cleanloom.functions.vocab import mentions


def one(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").select("i", expression.alias("v"))
    return [r.v for r in rows.orderBy("i").collect()]


def test_numbers_need_a_number_shape(spark):
    got = one(spark, to_number(F.col("c"), "string"), "12", " 1.5 ", "-3e2", ".5", "12d", "inf", "nan", "0x1", "1,000", "", None)
    assert got == [12.0, 1.5, -300.0, 0.5, None, None, None, None, None, None, None]
    assert one(spark, number_without_commas(F.col("c")), "1,000", "x,1") == [1000.0, None]


D = dt.datetime


@pytest.mark.parametrize("text, parsed, dayfirst", [
    ("2023-1-5", D(2023, 1, 5), D(2023, 1, 5)), ("01/02/2023", D(2023, 1, 2), D(2023, 2, 1)),
    ("13/02/2023", D(2023, 2, 13), D(2023, 2, 13)), ("02/13/2023", D(2023, 2, 13), D(2023, 2, 13)),
    ("02/30/2023", None, None), ("2023.1.2", D(2023, 1, 2), D(2023, 1, 2)), ("13.2.2023", D(2023, 2, 13), D(2023, 2, 13)),
    ("2.13.2023", None, None), ("2023/3/4", D(2023, 3, 4), D(2023, 3, 4)), ("03-02-2023", D(2023, 2, 3), D(2023, 2, 3)),
    ("02-13-2023", D(2023, 2, 13), D(2023, 2, 13)), ("2023-01-02T03:04:05", D(2023, 1, 2, 3, 4, 5), D(2023, 1, 2, 3, 4, 5)),
    ("1/2/2023 03:04", D(2023, 1, 2, 3, 4), D(2023, 2, 1, 3, 4)), ("Jan 5, 2023", D(2023, 1, 5), D(2023, 1, 5)),
    ("5 March 2023", D(2023, 3, 5), D(2023, 3, 5)), ("5-Sep-2023", D(2023, 9, 5), D(2023, 9, 5)),
    ("20230105", D(2023, 1, 5), D(2023, 1, 5)), ("2023-02-30", None, None), ("2023", None, None), ("2023-01", None, None),
    ("2023-01/05", None, None), ("not a date", None, None), ("Janx 5, 2023", None, None), (None, None, None),
    (" 2023-01-01 ", D(2023, 1, 1), D(2023, 1, 1)), ("2023-01-01 " + "x" * 80, None, None)])
def test_date_ladder(spark, text, parsed, dayfirst):
    assert one(spark, parse_date(F.col("c")), text) == [parsed]
    assert one(spark, parse_date(F.col("c"), dayfirst=True), text) == [dayfirst]


def test_one_format_only(spark):
    got = one(spark, parse_date_as(F.col("c"), "dd/MM/yyyy"), "1/2/2023", "13/13/2023", "2023-01-01")
    assert got == [D(2023, 2, 1), None, None]


def test_outer_space_and_non_ascii(spark):
    texts = ["a", " a", "a\n", " a", "a b", "", None]
    assert one(spark, has_outer_space(F.col("c")), *texts) == [False, True, True, True, False, False, None]
    assert one(spark, strip(F.col("c")), *texts) == ["a", "a", "a", "a", "a b", "", None]
    assert one(spark, has_non_ascii(F.col("c")), "abc", "café", "") == [False, True, False]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, y int")
    assert [r.x for r in nan_to_null(df).orderBy("y").collect()] == [None, 2.0]


def test_awkward_names(spark):
    df = spark.createDataFrame([("x",)], ["Actual gross (a.b) `c`"])
    assert df.select(ref(df.columns[0])).first()[0] == "x"
    assert list(kinds(df).values()) == ["string"]


def test_substring_traps():
    assert mentions("average", ("age",)) and mentions("percentage", ("age",)) and mentions("corporate", ("rate",))
    assert mentions("PAID", ("id",)) and mentions("calendar", ("end",)) and not mentions("salary", ("age",))
