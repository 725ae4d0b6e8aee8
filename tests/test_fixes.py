import datetime as dt

import pytest

from cleanloom.operators import fixes
from cleanloom.operators.checks import detect_issues
from cleanloom.operators.fixes import FIXES, apply_fix

from physical import single_partition_exchanges


def values(df, column="c"):
    return [r[column] for r in df.orderBy("k").collect()]


def frame(spark, dtype, *cells):
    return spark.createDataFrame(list(enumerate(cells)), f"k int, c {dtype}")


CASES = [
    ("FIX_MEDIAN_IMPUTE", "double", [1.0, None, 2.0, 9.0], {}, [1.0, 2.0, 2.0, 9.0]),
    ("FIX_MEAN_IMPUTE", "double", [1.0, None, 3.0], {}, [1.0, 2.0, 3.0]),
    ("FIX_MODE_IMPUTE", "string", ["a", "a", "b", "#", "#", "#", "unknown", None], {}, ["a", "a", "b", "#", "#", "#", "unknown", "a"]),
    ("FIX_MODE_IMPUTE", "double", [1.0, None], {}, [1.0, None]),
    ("FIX_EXTRACT_NUMERIC_IMPUTE", "string", ["1[4]", "7[2]", None, "x"], {}, [1, 7, 4, 4]),
    ("FIX_NEGATIVE_TO_ABS", "long", [-5, None, 3], {}, [5, None, 3]),
    ("FIX_NEGATIVE_TO_ABS", "string", ["-5", "x", "3"], {}, [5.0, None, 3.0]),
    ("FIX_NEGATIVE_TO_MEDIAN", "long", [-5, 10, 15, None], {}, [12, 10, 15, None]),
    ("FIX_NEGATIVE_TO_MEDIAN", "double", [-5.0, -1.0], {}, [0.0, 0.0]),
    ("FIX_NEGATIVE_TO_NAN", "long", [-5, 2, None], {}, [None, 2, None]),
    ("FIX_CAP_AT_100", "long", [150, 100, None], {}, [100, 100, None]),
    ("FIX_RANGE_TO_NAN", "double", [150.0, 99.0], {}, [None, 99.0]),
    ("FIX_CLIP_PERCENTAGE", "string", ["-3", "50", "101", "x"], {}, [0.0, 50.0, 100.0, None]),
    ("FIX_SCALE_PERCENTAGE", "double", [0.25, 0.0, 1.0, 30.0, None], {}, [25.0, 0.0, 1.0, 30.0, None]),
    ("FIX_WORD_TO_NUMBER", "string", [" Forty ", "seventy thousand", "12", None], {}, [40.0, None, 12.0, None]),
    ("FIX_TEXT_TO_NAN_IMPUTE", "string", ["1", "3", "x"], {}, [1.0, 3.0, 2.0]),
    ("FIX_CAP_PERCENTILE", "long", [0] + [10] * 98 + [1000], {}, [10] * 99 + [20]),
    ("FIX_IMPOSSIBLE_AGE_TO_MEDIAN", "double", [150.0, -1.0, 20.0, 31.0, None], {}, [26.0, 26.0, 20.0, 31.0, None]),
    ("FIX_IMPOSSIBLE_AGE_TO_MEDIAN", "long", [150, 200], {}, [30, 30]),
    ("FIX_IMPOSSIBLE_AGE_TO_NAN", "long", [150, 20], {}, [None, 20]),
    ("FIX_ZERO_MONETARY_TO_MEDIAN", "string", ["1,000", "0", "3,000", "x"], {}, [1000.0, 2000.0, 3000.0, None]),
    ("FIX_ZERO_MONETARY_TO_NAN", "double", [0.0, -1.0, 2.0], {}, [None, None, 2.0]),
    ("FIX_STRIP_WHITESPACE", "string", [" a b\t", None], {}, ["a b", None]),
    ("FIX_REMOVE_NON_ASCII", "string", ["café", None], {}, ["caf", None]),
    ("FIX_STANDARDIZE_CASE_LOWER", "string", ["ÄB", None], {}, ["äb", None]),
    ("FIX_PROXY_TO_NAN", "string", [" N/A ", "x", None], {}, [None, "x", None]),
    ("FIX_REMOVE_SPECIAL_CHARS", "string", ["a@b#c", None], {}, ["abc", None]),
    ("FIX_REPLACE_SPECIAL_WITH_SPACE", "string", ["a@b#c"], {}, ["a b c"]),
    ("FIX_EMPTY_TEXT_TO_MODE", "string", ["", None, "nan", "x", "x", "y"], {}, ["x", "x", "x", "x", "x", "y"]),
    ("FIX_EMPTY_TEXT_TO_NAN", "string", ["", " nan ", "x", None], {}, [None, None, "x", None]),
    ("FIX_INVALID_EMAIL_TO_NAN", "string", ["a@b.co", "a#b"], {}, ["a@b.co", None]),
    ("FIX_EMAIL_TYPOS", "string", ["u@GNAIL.com", "u@yaho.com", "u@gmial.com", None], {}, ["u@gmail.com", "u@yahoo.com", "u@gmail.com", None]),
    ("FIX_STANDARDIZE_PHONE", "string", ["(555) 1-2", "+1 9", None], {}, ["55512", "19", None]),
    ("FIX_INVALID_DATE_TO_NAN", "string", ["2023-01-01", "soon", None], {}, ["2023-01-01", None, None]),
    ("FIX_INVALID_DATE_DEFAULT", "string", ["soon", "1/2/2023"], {}, ["1900-01-01", "1/2/2023"]),
    ("FIX_INVALID_DATE_IMPUTE_MEDIAN", "string", ["2023-01-01", "2023-01-03", "soon"], {}, ["2023-01-01", "2023-01-03", "2023-01-02"]),
    ("FIX_INVALID_DATE_IMPUTE_MEDIAN", "string", ["soon"], {}, ["soon"]),
    ("FIX_STANDARDIZE_DATE_FORMAT", "string", ["1/2/2023", "2023.3.4", "soon", None], {}, ["2023-01-02", "2023-03-04", "soon", None]),
    ("FIX_FUTURE_DATE_TO_NAN", "string", ["2999-01-01", "2001-01-01", "soon"], {"as_of": dt.datetime(2024, 1, 1)}, [None, "2001-01-01", "soon"]),
    ("FIX_DROP_ROWS", "long", [1, 2, 3, None], {}, [1, 2, 3]),
    ("FIX_DROP_ROWS", "long", [1, None], {}, [1, None]),  # more than 30 percent: refused
    ("FIX_DROP_INVALID_ROWS", "long", [101, 100, None], {}, [100, None]),
    ("FIX_DROP_TEXT_ROWS", "string", ["1", "x", None], {}, ["1", None]),
    ("FIX_DROP_INVALID_DATE_ROWS", "string", ["soon", "2023-01-01", None], {}, ["2023-01-01", None]),
    ("FIX_DROP_IMPOSSIBLE_AGE_ROWS", "long", [121, 120, 0, -1, None], {}, [120, 0, None]),
    ("FIX_DROP_ZERO_MONETARY_ROWS", "double", [0.0, 1.0, None], {}, [1.0, None]),
    ("FIX_REMOVE_OUTLIERS", "double", [1.0] * 20 + [100.0, None], {}, [1.0] * 20),
    ("FIX_REMOVE_OUTLIERS", "double", [1.0, 1.0, 1.0, None], {}, [1.0, 1.0, 1.0, None]),
    ("FIX_KEEP_FIRST_ID", "string", ["a", "b", "a", None, None], {}, ["a", "b", None]),
    ("FIX_FORWARD_FILL", "string", [None, "a", None, "b", None], {}, [None, "a", "a", "b", "b"]),
    ("RESET_ID_COLUMNS", "long", [9, 9, 4], {}, [1, 2, 3]),
]


@pytest.mark.parametrize("fix_id, dtype, cells, params, expected", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_fix(spark, fix_id, dtype, cells, params, expected):
    assert values(apply_fix(frame(spark, dtype, *cells), fix_id, "c", params, ["k"])) == expected


def test_bounds(spark):
    df = frame(spark, "double", *[float(i) for i in range(101)], 1000.0)
    assert max(values(apply_fix(df, "FIX_CAP_IQR", "c"))) == pytest.approx(75.75 + 1.5 * 50.5)
    assert max(values(apply_fix(df, "FIX_WINSORIZE", "c"))) == pytest.approx(95.95)


def test_duplicate_choices(spark):
    rows = [(0, 1, None, "x"), (1, 1, "a", None), (2, 1, "a", "b"), (3, 2, None, None), (4, None, "p", None), (5, None, "p", "q")]
    df = spark.createDataFrame(rows, "k int, c int, a string, b string")
    keys = lambda fix: [r.k for r in apply_fix(df, fix, "c", order_by=["k"]).orderBy("k").collect()]
    assert keys("FIX_KEEP_FIRST_ID") == [0, 3, 4]
    assert keys("FIX_KEEP_LAST_ID") == [2, 3, 5]
    assert keys("FIX_KEEP_COMPLETE") == [2, 3, 5]
    with pytest.raises(ValueError, match="order_by"):
        apply_fix(df, "FIX_KEEP_FIRST_ID", "c")


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "b", 1)], "k int, x string, y int")
    assert apply_fix(df, "FIX_DROP_EXACT_DUPLICATES", "*").count() == 3
    kept = apply_fix(df, "FIX_DROP_EXACT_DUPLICATES", "*", {"ignore": ["k"]})
    assert kept.columns == ["k", "x", "y"] and sorted(r.k for r in kept.collect()) == [0, 2]
    assert apply_fix(df.drop("k"), "FIX_DROP_EXACT_DUPLICATES", "*").count() == 2


def test_swap_reads_the_old_row(spark):
    df = spark.createDataFrame([("2023-01-05", "2023-01-01"), ("2023-01-01", "2023-01-05"), (None, "2023-01-01")], "a string, b string")
    got = apply_fix(df, "FIX_SWAP_LOGICAL_DATES", "a -> b").collect()
    assert [tuple(r) for r in got] == [("2023-01-01", "2023-01-05"), ("2023-01-01", "2023-01-05"), (None, "2023-01-01")]


def test_drop_column_and_unknown_fix(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c"])
    assert apply_fix(df, "FIX_DROP_COLUMN", "a.b").columns == ["c"]
    with pytest.raises(ValueError, match="unknown fix"):
        apply_fix(df, "FIX_NOTHING", "c")


def test_keep_one_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id as k", "id % 3 as c")
    plan = apply_fix(df, "FIX_KEEP_FIRST_ID", "c", order_by=["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "SinglePartition" not in plan


ONE_PASS = {"NEG_AGE": "guest_age", "RANGE_EXCEEDED": "discount_pct", "IMPOSSIBLE_AGE": "guest_age", "WHITESPACE": "email",
            "WORD_AS_NUMBER": "room_price", "PHONE_FORMAT_ISSUE": "phone", "MISSING_VAL": "guest_age", "PERCENT_VIOLATION": "discount_pct"}


def test_recommended_fix_ends_the_issue_and_is_idempotent(guests):
    from cleanloom.operators.recommend import recommend

    issues = [i for i in detect_issues(guests) if ONE_PASS.get(i.issue_id) == i.column]
    assert len(issues) == len(ONE_PASS)
    best = {}
    for option in recommend(guests, issues):
        if option.is_recommended:
            best.setdefault(option.issue_id, option)
    for issue in issues:
        option = best[issue.issue_id]
        fixed = apply_fix(guests, option.fix_id, issue.column, option.params)
        again = detect_issues(fixed, examples=False, duplicates=False)
        assert issue.issue_id not in {i.issue_id for i in again if i.column == issue.column}, issue.issue_id
        twice = apply_fix(fixed, option.fix_id, issue.column, option.params)
        assert fixed.exceptAll(twice).isEmpty() and fixed.count() == guests.count()


def test_every_row_local_fix_is_a_plain_projection_or_filter(guests):
    for fix_id in fixes.ROW_LOCAL:
        column = "order_date" if "DATE" in fix_id else "room_price"
        plan = apply_fix(guests, fix_id, column)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan, fix_id


def test_nan_is_missing_for_every_imputation(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, nan, 3.0, None, 5.0])], "k int, c double")
    for fix_id, filled in (("FIX_MEDIAN_IMPUTE", [1.0, 3.0, 3.0, 3.0, 5.0]), ("FIX_MEAN_IMPUTE", [1.0, 3.0, 3.0, 3.0, 5.0]),
                           ("FIX_FORWARD_FILL", [1.0, 1.0, 3.0, 3.0, 5.0])):
        got = apply_fix(df, fix_id, "c", order_by=["k"]).orderBy("k").collect()
        assert [r.c for r in got] == filled, fix_id
    assert apply_fix(df, "FIX_DROP_ROWS", "c", {"rows": 100, "nulls": 2}).count() == 3
    drawn = [r.c for r in apply_fix(df, "FIX_STOCHASTIC_FILL", "c", order_by=["k"]).collect()]
    assert set(drawn) <= {1.0, 3.0, 5.0} and len(drawn) == 5


def test_decimals_keep_every_digit(spark):
    from decimal import Decimal

    big = Decimal("123456789012345678901234567890.25")
    df = spark.createDataFrame([(1, big), (2, Decimal("-4.00")), (3, Decimal("2.50"))], "k int, net_price decimal(38,2)")
    for fix_id, new in (("FIX_ZERO_MONETARY_TO_NAN", None), ("FIX_NEGATIVE_TO_ABS", Decimal("4.00"))):
        got = apply_fix(df, fix_id, "net_price")
        assert got.schema == df.schema and [r.net_price for r in got.orderBy("k").collect()] == [big, new, Decimal("2.50")]


def test_numbers_beyond_64_bits_are_refused(spark):
    df = frame(spark, "string", "99999999999999999999[4]", "5[1]", None)
    with pytest.raises(ValueError, match="64 bits"):
        apply_fix(df, "FIX_EXTRACT_NUMERIC_IMPUTE", "c")


def test_dates_follow_the_settings_of_the_checks(spark):
    df = frame(spark, "string", "01/02/2023", "13/02/2023", "x")
    for dayfirst, first in ((False, "2023-01-02"), (True, "2023-02-01")):
        got = apply_fix(df, "FIX_STANDARDIZE_DATE_FORMAT", "c", {"dayfirst": dayfirst})
        assert [r.c for r in got.collect()] == [first, "2023-02-13", "x"]
        filled = apply_fix(df, "FIX_INVALID_DATE_IMPUTE_MEDIAN", "c", {"dayfirst": dayfirst})
        assert filled.collect()[2].c == ("2023-02-07" if dayfirst else "2023-01-23")


def test_log_counts(spark):
    df = frame(spark, "string", "1", "x", None)
    touched = fixes.affected(df, "FIX_TEXT_TO_NAN_IMPUTE", "c", {"median_value": 1.0})
    assert df.filter(touched).count() == 1
    ids = frame(spark, "int", 1, 1, None, None, 2)
    assert fixes.rows_removed(ids, "FIX_KEEP_FIRST_ID", "c", {}) == 2
    assert set(FIXES) >= set(fixes.ROW_LOCAL)
    assert single_partition_exchanges(apply_fix(df, "FIX_STRIP_WHITESPACE", "c")) == 0
