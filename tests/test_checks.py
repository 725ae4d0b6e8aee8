import datetime as dt

import pytest
from pyspark.sql import functions as F

from cleanloom.operators import checks
from cleanloom.operators.checks import detect_issues
from cleanloom.operators.roles import detect_roles
from cleanloom.plans.plan import recommended_plan, run_plan

EXPECTED = {
    ("MISSING_VAL", "guest_age"): 3, ("NEG_AGE", "guest_age"): 1, ("RANGE_EXCEEDED", "discount_pct"): 2, ("IMPOSSIBLE_AGE", "guest_age"): 2,
    ("DATE_SEQUENCE_VIOLATION", "order_date -> ship_date"): 2, ("WHITESPACE", "email"): 1, ("WORD_AS_NUMBER", "room_price"): 1,
    ("ID_CLASH", "guest_id"): 2, ("Z_OUTLIER", "discount_pct"): 1, ("EMAIL_FORMAT_ISSUE", "email"): 6,
    ("PHONE_FORMAT_ISSUE", "phone"): 5, ("PERCENT_VIOLATION", "discount_pct"): 3, ("DUPLICATE_ROWS", "*"): 1,
}


def found(issues):
    return {(i.issue_id, i.column): i.n_violations for i in issues}


def test_fixture_counts(guests):
    issues = detect_issues(guests)
    assert found(issues) == EXPECTED
    order = [checks.ORDER.index(i.issue_id) for i in issues]
    assert order == sorted(order)


def test_partitioning_does_not_matter(guests):
    assert found(detect_issues(guests.repartition(7))) == found(detect_issues(guests.coalesce(1))) == EXPECTED


def test_price_outlier_once_numeric(guests):
    df = guests.withColumn("room_price", F.expr("try_cast(room_price as double)"))
    assert found(detect_issues(df))[("Z_OUTLIER", "room_price")] == 1


def test_examples_follow_the_order_key(spark):
    df = spark.createDataFrame([(i, -i) for i in range(1, 9)], "k int, user_age int")
    issue = next(i for i in detect_issues(df, order_by=["k"]) if i.issue_id == "NEG_AGE")
    assert issue.examples == ("-1", "-2", "-3")


def test_roles(spark):
    rows = [(i, f"2023-01-{i:02d}", "10.5" if i % 3 else "x", i * 10, i % 2, 7) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "rec_id int, shipped string, total_cost string, wide_id int, gender int, year int")
    roles = detect_roles(df)
    assert roles.date == ("shipped", "year")  # by content; whole numbers in a date-named column count
    assert roles.identity == ("rec_id",)  # wide_id has gaps of ten
    assert "total_cost" in roles.numeric and "gender" not in roles.numeric
    assert roles.money == ("total_cost",)
    assert detect_roles(df, {"date": ["shipped"]}).date == ("shipped",)
    with pytest.raises(ValueError):
        detect_roles(df, {"dates": []})


def test_repeated_ids_with_nulls_and_text(spark):
    df = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), ("3.0",)], "text_id string")
    roles = detect_roles(df)
    assert roles.identity == ("text_id",) and roles.repeats == {"text_id": 1}


def test_edge_frames(spark):
    empty = spark.createDataFrame([], "age double, email string, order_date string, item_id long")
    assert detect_issues(empty) == []
    nulls = spark.createDataFrame([(None, None)], "age double, note_text string")
    assert found(detect_issues(nulls)) == {("MISSING_VAL", "age"): 1, ("MISSING_VAL", "note_text"): 1, ("EMPTY_TEXT", "note_text"): 1}
    assert ("EMPTY_TEXT", "note_text") not in found(detect_issues(nulls, include_null=False))
    constant = spark.createDataFrame([(5.0,)] * 4, "level double")
    assert ("Z_OUTLIER", "level") not in found(detect_issues(constant))


def test_single_checks(spark):
    df = spark.createDataFrame(
        [("?", "2999-01-01", "LOW", "cafe", "a#"), (" N/A ", "01/05/2020", "low", "café", "b"), ("ok", "soon", "Mid", " x", "c")],
        "token string, event_date string, cased string, word string, odd string")
    got = found(detect_issues(df, as_of=dt.datetime(2024, 1, 1), duplicates=False))
    assert got[("PROXY_MISSING", "token")] == 2
    assert got[("FUTURE_DATE", "event_date")] == 1 and got[("INVALID_DATE_FORMAT", "event_date")] == 1
    assert ("DATE_FORMAT_MIXED", "event_date") in got and got[("CASE_DIVERGE", "cased")] == 2
    assert got[("ENCODING_JUNK", "word")] == 1 and got[("SPECIAL_CHARS", "odd")] == 1 and got[("WHITESPACE", "word")] == 1


def test_pairs_whose_names_hold_the_mark(spark):
    assert checks.split_pair("start w/o tz/end w/o tz", ["start w/o tz", "end w/o tz"]) == ["start w/o tz", "end w/o tz"]
    assert checks.split_pair("a -> b") == ["a", "b"]
    df = spark.createDataFrame([(1, "2024-01-05", "2024-01-01")], "k int, `start w/o tz` string, `end w/o tz` string")
    issues = [i for i in detect_issues(df) if i.issue_id == "SEQ_ERROR"]
    cleaned, log = run_plan(df, issues, recommended_plan(issues), ["k"])
    assert tuple(cleaned.first()) == (1, "2024-01-01", "2024-01-05") and log[0].values_changed == 1


def test_nan_and_padded_dates(spark):
    df = spark.createDataFrame([(1.0, " " * 60 + "2024-01-05"), (float("nan"), "2024-01-06"), (None, "x" * 80)], "level double, event_date string")
    got = found(detect_issues(df, duplicates=False))
    assert got[("MISSING_VAL", "level")] == 2 and got[("INVALID_DATE_FORMAT", "event_date")] == 1


def test_sequence_pairs():
    assert checks.sequence_pairs(["start_day", "end_day"]) == [("SEQ_ERROR", "start_day", "end_day")]
    assert checks.sequence_pairs(["a", "b"], [("a", "b")]) == [("DATE_SEQUENCE_VIOLATION", "a", "b")]
    assert checks.sequence_pairs(["calendar", "start"])[0][2] == "calendar"  # substring match


def test_flag_matches_count(guests):
    ctx = checks.context(guests)
    for issue_id, column in EXPECTED:
        if issue_id in checks.CHECKS:
            flagged = checks.flag(guests, issue_id, column, ["guest_id"], ctx).count()
            assert flagged == EXPECTED[(issue_id, column)]
            summary = {r.column: r.n_violations for r in checks.check_summary(guests, issue_id, ctx).collect()}
            assert summary[column] == flagged


def test_later_duplicates_of_a_hot_key(spark):
    df = spark.range(3000).selectExpr("id as k", "case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as g")
    later = checks.later_duplicates(df, "g", ["k"])
    assert later.count() == 3000 - df.select("g").distinct().count()
    assert later.filter("k in (0, 1)").count() == 0
