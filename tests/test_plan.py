import datetime as dt

import pytest

from cleanloom.functions.columns import kinds
from cleanloom.operators.checks import Issue, detect_issues
from cleanloom.operators.fixes import FIXES, affected
from cleanloom.operators.impact import cells, column_completeness, impact, quality
from cleanloom.operators.recommend import fixes_frame, recommend, recommended_only
from cleanloom.plans.pipeline import EmptyDataset, clean, clean_file
from cleanloom.plans.plan import PlanStep, log_frame, recommended_plan, run_plan
from cleanloom.sources.auto import read_keyed
from cleanloom.sources.csv import read_csv


def issue(issue_id, column):
    return Issue(issue_id, column, "", "", 1, "")


def options(df, *issues):
    return {o.fix_id: o for o in recommend(df, [issue(*i) for i in issues])}


def test_fixture_parameters(guests):
    got = options(guests, ("MISSING_VAL", "guest_age"), ("IMPOSSIBLE_AGE", "guest_age"), ("WORD_AS_NUMBER", "room_price"))
    assert got["FIX_MEDIAN_IMPUTE"].params["median_value"] == 45 and got["FIX_MEDIAN_IMPUTE"].is_recommended
    assert got["FIX_IMPOSSIBLE_AGE_TO_MEDIAN"].params["median_value"] == 45
    assert got["FIX_TEXT_TO_NAN_IMPUTE"].params["median_value"] == 118.0
    assert got["FIX_WORD_TO_NUMBER"].is_recommended and not got["FIX_TEXT_TO_NAN_IMPUTE"].is_recommended
    price = guests.selectExpr("try_cast(room_price as double) as room_price")
    bounds = options(price, ("Z_OUTLIER", "room_price"))["FIX_CAP_PERCENTILE"].params
    assert (round(bounds["p1"], 4), round(bounds["p99"], 4)) == (78.76, 4233.6)


def test_missing_rules(spark):
    rows = [(None if i % 2 else f"{i}[4]", None if i % 2 else "word", float(i % 3) if i % 5 else None, None if i < 3 else "red",
             None if i < 3 else f"v{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "peak string, mostly string, level double, hue string, name_text string")
    assert list(options(df, ("MISSING_VAL", "peak"))) == ["FIX_EXTRACT_NUMERIC_IMPUTE", "FIX_DROP_COLUMN"]
    mostly = options(df, ("MISSING_VAL", "mostly"))
    assert mostly["FIX_DROP_COLUMN"].is_recommended and "FIX_DROP_ROWS" not in mostly
    assert list(options(df, ("MISSING_VAL", "level"))) == ["FIX_MEAN_IMPUTE", "FIX_MEDIAN_IMPUTE", "FIX_STOCHASTIC_FILL", "FIX_DROP_ROWS"]
    assert options(df, ("MISSING_VAL", "hue"))["FIX_MODE_IMPUTE"].is_recommended
    diverse = options(df, ("MISSING_VAL", "name_text"))
    assert not diverse["FIX_MODE_IMPUTE"].is_recommended and diverse["FIX_DROP_ROWS"].is_recommended


def test_unknown_issues_and_columns_get_no_fix(guests):
    assert recommend(guests, [issue("NO_SUCH_ISSUE", "guest_age"), issue("MISSING_VAL", "gone")]) == []
    calm = guests.selectExpr("cast(5 as double) as level")
    assert recommend(calm, [issue("Z_OUTLIER", "level")]) == []


def test_frames(spark, guests):
    found = recommend(guests, detect_issues(guests))
    table = fixes_frame(spark, found)
    assert table.filter("is_recommended").count() == len(recommended_only(found)) > 0
    assert table.filter("requires_user_input").count() == 0


def test_recommended_plan_cleans_the_fixture(spark, guests_csv):
    keyed, key = read_keyed(spark, guests_csv)
    issues = detect_issues(keyed.drop(*key))
    cleaned, log = run_plan(keyed, issues, recommended_plan(issues), key, hidden=tuple(key))
    cleaned = cleaned.drop(*key)
    left = {i.issue_id for i in detect_issues(cleaned)}
    assert left <= {"MISSING_VAL", "EMAIL_FORMAT_ISSUE", "Z_OUTLIER"}
    assert cleaned.count() == 16  # one row per identifier
    by_step = {e.step: e for e in log}
    assert len(by_step) == len(issues) and log_frame(spark, log).count() == len(log)
    dropped = next(e for e in log if e.fix_id == "FIX_KEEP_FIRST_ID")
    assert dropped.rows_removed == 2


def test_later_steps_see_earlier_ones(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, None)], "k int, price double")
    steps = [PlanStep("INVALID_MONETARY", "price", "FIX_DROP_ZERO_MONETARY_ROWS"), PlanStep("MISSING_VAL", "price", "FIX_MEAN_IMPUTE")]
    cleaned, log = run_plan(df, [issue(s.issue_id, s.column) for s in steps], steps)
    assert [r.price for r in cleaned.orderBy("k").collect()] == [10.0, 10.0]
    assert [(e.values_changed, e.rows_removed) for e in log] == [(None, 1), (1, None)]


def test_skips_guards_and_renumbering(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else 1.0, None if i % 2 else 1.0) for i in range(1, 41)], "row_id long, some double, half double")
    steps = [PlanStep("MISSING_VAL", "half", "FIX_DROP_ROWS"), PlanStep("MISSING_VAL", "half", "FIX_DROP_COLUMN"),
             PlanStep("MISSING_VAL", "half", "FIX_MEAN_IMPUTE"), PlanStep("MISSING_VAL", "some", "skip"),
             PlanStep("MISSING_VAL", "some", "FIX_DROP_ROWS")]
    cleaned, log = run_plan(df, [issue(s.issue_id, s.column) for s in steps], steps, ["row_id"], reset_ids=True, checkpoint_stages=1)
    assert [e.fix_applied == "skipped" for e in log] == [True, False, True, True, False, False]
    assert "50.0%" in log[0].details and log[-1].fix_id == "RESET_ID_COLUMNS"
    assert sorted(r.row_id for r in cleaned.collect()) == list(range(1, 37))
    with pytest.raises(ValueError, match="unknown fix"):
        run_plan(df, [], [PlanStep("MISSING_VAL", "some", "FIX_NOTHING")])


def test_quality_of_fixture(guests):
    row = quality(guests).first()
    assert (round(row.completeness, 4), row.duplicate_rows, round(row.quality_score, 4)) == (97.9167, 1, 97.3611)
    shares = {r.column: r.completeness for r in column_completeness(guests).collect()}
    assert round(shares["guest_age"], 4) == 83.3333 and shares["email"] == 100


def test_file_is_cleaned_without_options(spark, guests_csv, tmp_path):
    outcome = clean_file(spark, guests_csv, output=str(tmp_path / "guests"))
    assert outcome.cleaned.columns == outcome.before.columns and outcome.before.count() == 18
    ages = {r.guest_id: r.guest_age for r in outcome.cleaned.collect()}
    assert len(ages) == outcome.cleaned.count() == 16 and ages[104] == 45  # the first row of 104, its age below zero
    written = read_csv(spark, outcome.written[0])
    assert written.count() == 16 and read_csv(spark, outcome.written[1]).count() == len(outcome.log)


def test_settings_reach_the_fixes(spark):
    df = spark.createDataFrame([(i, f"0{i}/02/2023") for i in range(1, 8)] + [(8, "2030-01-01"), (9, "2023.04.05")], "k int, visit_date string")
    outcome = clean(df, as_of=dt.datetime(2025, 1, 1), dayfirst=True, infer=False, order_by=["k"])
    days = {r.k: r.visit_date for r in outcome.cleaned.collect()}
    assert days[3] == "2023-02-03" and days[9] == "2023-04-05" and days[8] is None


def test_half_guard_and_rejected_keys(spark):
    df = spark.createDataFrame([(i, -1.0 if i % 5 < 3 else 9.0, None if i % 10 == 3 else 1.0) for i in range(50)], "k int, price double, seldom double")
    steps = [PlanStep("INVALID_MONETARY", "price", "FIX_DROP_ZERO_MONETARY_ROWS"), PlanStep("MISSING_VAL", "seldom", "FIX_DROP_ROWS")]
    cleaned, log = run_plan(df, [issue(s.issue_id, s.column) for s in steps], steps)
    assert cleaned.count() == 20 and "more than half" in log[1].details
    for key, word in ((["price"], "unique"), (["seldom"], "nulls")):
        with pytest.raises(ValueError, match=word):
            run_plan(df, [issue("MISSING_VAL", "seldom")], [PlanStep("MISSING_VAL", "seldom", "FIX_FORWARD_FILL")], key)


def test_impact_with_dropped_column_and_empty_table(spark, guests):
    report = {(r.metric, r.column): r for r in impact(guests, guests.drop("phone").dropDuplicates()).collect()}
    assert report[("total_columns", None)].delta == -1 and report[("duplicate_rows", None)].delta == -1
    assert report[("column_completeness", "phone")].after is None
    empty = spark.createDataFrame([], "a int")
    assert quality(empty).first().quality_score == 0 and cells(empty).first().completeness == 0


def test_pipeline(spark, guests_csv, tmp_path):
    outcome = clean_file(spark, guests_csv, drop_outliers="isolation_forest")
    assert outcome.outliers.first().total == 18 and outcome.schema.rows == 18 and outcome.profile.count() == 8
    assert outcome.types["room_price"][0] == "numeric"
    assert {r.metric for r in outcome.impact.collect()} >= {"quality_score", "total_rows"}
    after = {r.metric: r.delta for r in outcome.impact.filter("column is null").collect()}
    assert after["missing_values"] <= 0 and outcome.log
    with pytest.raises(EmptyDataset):
        clean(spark.createDataFrame([], "a int"))


def test_counts_of_a_stage_come_with_its_parameters(spark, jobs_of):
    """Fixes that need no fitted parameter cost one pass a stage, and that pass counts the rows as well."""
    rows = [(i, " a " if i % 3 else "b", -1.0 if i % 4 == 0 else 2.0, None if i % 10 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name_text string, price double, level long")
    steps = [PlanStep("WHITESPACE", "name_text", "FIX_STRIP_WHITESPACE"), PlanStep("NEGATIVE_VALUE", "price", "FIX_NEGATIVE_TO_ABS"),
             PlanStep("MISSING_VAL", "level", "FIX_DROP_ROWS")]
    one, _ = jobs_of(lambda: df.agg({"id": "count"}).first())
    jobs, (cleaned, log) = jobs_of(lambda: run_plan(df, [issue(s.issue_id, s.column) for s in steps[:2]], steps[:2], ["id"]))
    assert jobs == one
    assert [e.values_changed for e in log] == [sum(r[1] != "b" for r in rows), sum(r[2] < 0 for r in rows)]
    cleaned, log = run_plan(df, [issue(s.issue_id, s.column) for s in steps], steps, ["id"])
    assert log[2].rows_removed == 20 and cleaned.count() == 180
    jobs, (_, log) = jobs_of(lambda: run_plan(df, [], [PlanStep("WHITESPACE", "gone", "FIX_STRIP_WHITESPACE")], ["id"]))
    assert jobs == 0 and log[0].fix_applied == "skipped"


def test_early_counts_depend_on_no_fitted_parameter(spark):
    """A fix says whether fitted parameters pick its rows; without them the others still have their predicate."""
    df = spark.createDataFrame([(1, "a", 1.0, "2024-01-01")], "n long, t string, x double, d string")
    for fix_id, fix in FIXES.items():
        for column in df.columns:
            if fix.needs and fix.rows_fitted and fix.only(kinds(df)[column]) and fix_id not in ("FIX_DROP_ROWS",):
                with pytest.raises(KeyError):
                    affected(df, fix_id, column, {})
            elif not fix.rows_fitted and fix_id != "FIX_SWAP_LOGICAL_DATES":
                affected(df, fix_id, column, {})
