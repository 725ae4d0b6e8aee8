"""Queries of recommendations, plans and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.functions.stats import adjusted_skewness, aggregate, clean_modes
from cleanloom.operators import impact, recommend
from cleanloom.operators.checks import Issue, detect_issues
from cleanloom.operators.fixes import apply_fix, clean_mode_values, text_mode_values
from cleanloom.plans.pipeline import clean_file
from cleanloom.plans.plan import PlanStep, log_frame, run_plan
from cleanloom.session import scratch_path
from cleanloom.sources.csv import read_csv
from cleanloom.workload import checks as check_queries
from cleanloom.workload import views as v

KEY = "o_orderkey"


def _issue(issue_id, column, n=1):
    return Issue(issue_id, column, "", "", n, "")


def _options(spark, options, **params):
    """(issue_id, column, fix_id, is_recommended) and, per output column, one numeric parameter."""
    rows = [(o.issue_id, o.column, o.fix_id, o.is_recommended,
             *[None if o.params.get(p) is None else round(float(o.params[p]), 4) for p in params.values()])
            for o in options]
    return spark.createDataFrame(rows, "issue_id string, column string, fix_id string, is_recommended boolean"
                                 + "".join(f", {name} double" for name in params))


def _recommended(columns, issues, **params):
    def run(spark, sf_dir):
        df = v.dirty_orders(spark, sf_dir, *columns)
        return _options(spark, recommend.recommend(df, [_issue(i, c) for i, c in issues]), **params)
    return run


# ---------------------------------------------------------------- router
def _routed(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir).drop(KEY)
    return recommend.recommend(df, detect_issues(df, as_of=check_queries.AS_OF, examples=False))


def r1_router(spark, sf_dir):
    return _options(spark, _routed(spark, sf_dir))


def r2_recommended(spark, sf_dir):
    return _options(spark, recommend.recommended_only(_routed(spark, sf_dir))).drop("is_recommended")


# Expected routes: issue -> fixes, the recommended ones first marked True.
_ROUTES = [
    ("EMAIL_FORMAT_ISSUE", "FIX_EMAIL_TYPOS", True), ("EMAIL_FORMAT_ISSUE", "FIX_INVALID_EMAIL_TO_NAN", False),
    ("DATE_SEQUENCE_VIOLATION", "FIX_SWAP_LOGICAL_DATES", True), ("SEQ_ERROR", "FIX_SWAP_LOGICAL_DATES", True),
    ("PROXY_MISSING", "FIX_PROXY_TO_NAN", True), ("EMPTY_TEXT", "FIX_EMPTY_TEXT_TO_MODE", True),
    ("EMPTY_TEXT", "FIX_EMPTY_TEXT_TO_NAN", True), ("NEG_AGE", "FIX_NEGATIVE_TO_ABS", False),
    ("NEG_AGE", "FIX_NEGATIVE_TO_MEDIAN", True), ("NEG_AGE", "FIX_NEGATIVE_TO_NAN", False),
    ("RANGE_EXCEEDED", "FIX_CLIP_PERCENTAGE", True), ("RANGE_EXCEEDED", "FIX_CAP_AT_100", True),
    ("RANGE_EXCEEDED", "FIX_RANGE_TO_NAN", False), ("RANGE_EXCEEDED", "FIX_DROP_INVALID_ROWS", False),
    ("IMPOSSIBLE_AGE", "FIX_IMPOSSIBLE_AGE_TO_MEDIAN", True), ("IMPOSSIBLE_AGE", "FIX_IMPOSSIBLE_AGE_TO_NAN", False),
    ("IMPOSSIBLE_AGE", "FIX_DROP_IMPOSSIBLE_AGE_ROWS", False), ("INVALID_MONETARY", "FIX_ZERO_MONETARY_TO_MEDIAN", True),
    ("INVALID_MONETARY", "FIX_ZERO_MONETARY_TO_NAN", False), ("INVALID_MONETARY", "FIX_DROP_ZERO_MONETARY_ROWS", False),
    ("FUTURE_DATE", "FIX_FUTURE_DATE_TO_NAN", True), ("INVALID_DATE_FORMAT", "FIX_INVALID_DATE_IMPUTE_MEDIAN", True),
    ("INVALID_DATE_FORMAT", "FIX_INVALID_DATE_TO_NAN", False), ("INVALID_DATE_FORMAT", "FIX_DROP_INVALID_DATE_ROWS", False),
    ("INVALID_DATE_FORMAT", "FIX_INVALID_DATE_DEFAULT", False), ("DATE_FORMAT_MIXED", "FIX_STANDARDIZE_DATE_FORMAT", True),
    ("WHITESPACE", "FIX_STRIP_WHITESPACE", True), ("SPECIAL_CHARS", "FIX_REMOVE_SPECIAL_CHARS", True),
    ("SPECIAL_CHARS", "FIX_REPLACE_SPECIAL_WITH_SPACE", False), ("ENCODING_JUNK", "FIX_REMOVE_NON_ASCII", True),
    ("WORD_AS_NUMBER", "FIX_WORD_TO_NUMBER", True), ("WORD_AS_NUMBER", "FIX_TEXT_TO_NAN_IMPUTE", False),
    ("WORD_AS_NUMBER", "FIX_DROP_TEXT_ROWS", False), ("CASE_DIVERGE", "FIX_STANDARDIZE_CASE_LOWER", True),
    ("ID_CLASH", "FIX_KEEP_FIRST_ID", True), ("ID_CLASH", "FIX_KEEP_LAST_ID", False), ("ID_CLASH", "FIX_KEEP_COMPLETE", False),
    ("Z_OUTLIER", "FIX_CAP_PERCENTILE", True), ("Z_OUTLIER", "FIX_CAP_IQR", False), ("Z_OUTLIER", "FIX_REMOVE_OUTLIERS", False),
    ("Z_OUTLIER", "FIX_WINSORIZE", False), ("PHONE_FORMAT_ISSUE", "FIX_STANDARDIZE_PHONE", True),
    ("PERCENT_VIOLATION", "FIX_CLIP_PERCENTAGE", True), ("PERCENT_VIOLATION", "FIX_SCALE_PERCENTAGE", False),
    ("DUPLICATE_ROWS", "FIX_DROP_EXACT_DUPLICATES", True),
]
_ROUTE_TABLE = "(VALUES " + ", ".join(f"('{i}', '{f}', {r})" for i, f, r in _ROUTES) + ") routes(i, fix_id, is_recommended)"
# ---------------------------------------------------------------- missing values
_SPARSE = {
    "customer_age": v.DIRTY_ORDERS["customer_age"],
    "net_price": v.DIRTY_ORDERS["net_price"],
    "priority_text": v.DIRTY_ORDERS["priority_text"],
    "email": v.DIRTY_ORDERS["email"],
    "peak_text": "CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE CAST(o_custkey % 40 AS STRING) || '[4]' END",
    "sparse_text": "CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_orderstatus END",
    "sparse_total": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) * o_custkey * o_custkey END",
    "moment": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END",
}
_SPARSE_CTE = "WITH sparse AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SPARSE.items()) + " FROM orders)"


def r3_missing_strategy(spark, sf_dir):
    df = v.table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _SPARSE.items()])
    options = recommend.recommend(df, [_issue("MISSING_VAL", c) for c in _SPARSE])
    return _options(spark, options, median="median_value", mean="mean_value").drop("issue_id")


def _missing_sql(c, kind, table="sparse"):
    clean = (f"FROM {table} WHERE {c} IS NOT NULL AND NOT regexp_matches({c}, '{v.vocab.SPECIAL_OR_AT_PATTERN}') "
             f"AND lower({v.sql_strip(c)}) NOT IN ({v.sql_strings(v.vocab.UNCLEAN_MODE_TOKENS)})")
    base = f"(SELECT count(*) AS n, count(*) - count({c}) AS miss FROM {table}) f"
    none = "CAST(NULL AS DOUBLE)"

    def offer(fix, recommended, condition="true", median=none, mean=none, source=base):
        return (f"SELECT '{c}' AS \"column\", '{fix}' AS fix_id, {recommended} AS is_recommended, {median} AS median, "
                f"{mean} AS mean FROM {source} WHERE miss > 0 AND ({condition})")
    high = "miss * 100.0 / n > 40"
    drop = "(n - miss) * 100.0 / n >= 60"
    if kind == "digits":
        digits = f"CAST(TRY_CAST(regexp_extract({c}, '([0-9]+)', 1) AS BIGINT) AS DOUBLE)"
        return [offer("FIX_EXTRACT_NUMERIC_IMPUTE", "true", high, f"(SELECT trunc(median({digits})) FROM {table})"),
                offer("FIX_DROP_COLUMN", "false", high)]
    parts = [offer("FIX_DROP_COLUMN", "true", high)]
    if kind == "number":
        rounded = "age" in c
        median, mean = (f"(SELECT {'round_even(' if rounded else 'round('}{f}({c}), {0 if rounded else 4}) FROM {table})"
                        for f in ("median", "avg"))
        skewed = f"((SELECT abs(skewness({c})) > 1 FROM {table}) OR {str(rounded).lower()})"
        parts += [offer("FIX_MEDIAN_IMPUTE", skewed, median=median), offer("FIX_MEAN_IMPUTE", "true", f"NOT {skewed}", mean=mean),
                  offer("FIX_STOCHASTIC_FILL", "true", f"NOT {skewed}"), offer("FIX_DROP_ROWS", "false", drop)]
    elif kind == "text":
        source = (f"{base}, (SELECT max(k) * 1.0 / sum(k) AS freq, count(*) * 1.0 / sum(k) AS diversity "
                  f"FROM (SELECT count(*) AS k {clean} GROUP BY {c})) m")
        good = "coalesce(freq > 0.2 AND diversity < 0.7, false)"
        scattered = "(freq IS NULL OR diversity > 0.5)"
        parts += [offer("FIX_MODE_IMPUTE", good, "freq IS NOT NULL", source=source),
                  offer("FIX_DROP_ROWS", f"CASE WHEN {scattered} THEN NOT {good} ELSE false END",
                        f"{scattered} OR {drop}", source=source)]
    else:
        parts += [offer("FIX_FORWARD_FILL", "true"), offer("FIX_DROP_ROWS", "false", drop)]
    return parts


_MISSING_KINDS = {"customer_age": "number", "net_price": "number", "priority_text": "text", "email": "text",
                  "peak_text": "digits", "sparse_text": "text", "sparse_total": "number", "moment": "time"}


_DIRTY_KINDS = {c: "text" for c in ("amount_text", "email", "phone", "order_date", "ship_date", "priority_text")} | {
    c: "number" for c in ("record_id", "customer_age", "net_price", "discount_pct", "tax_rate")}
_ROUTED_SQL = (f"{v.CTE} SELECT issue_id, \"column\", fix_id, is_recommended FROM ({check_queries._sql_all()}) JOIN {_ROUTE_TABLE} "
               "ON i = issue_id WHERE NOT (fix_id = 'FIX_SCALE_PERCENTAGE' AND \"column\" <> 'tax_rate') UNION ALL "
               "SELECT 'MISSING_VAL', \"column\", fix_id, is_recommended FROM ("
               + " UNION ALL ".join(p for c, k in _DIRTY_KINDS.items() for p in _missing_sql(c, k, "dirty")) + ")")


# ---------------------------------------------------------------- other strategies
def r6_date_strategy(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, "order_date")
    options = recommend.recommend(df, [_issue("INVALID_DATE_FORMAT", "order_date")])
    rows = [(o.fix_id, o.is_recommended, o.params.get("median_date") or o.params.get("default_date")) for o in options]
    return spark.createDataFrame(rows, "fix_id string, is_recommended boolean, day string")


def r8_outlier_strategy(spark, sf_dir):
    df = v.table(spark, sf_dir, "events").select("value")
    options = recommend.recommend(df, [_issue("Z_OUTLIER", "value")])
    params = {k: p for o in options for k, p in o.params.items()}
    return spark.createDataFrame([(k, round(params[k], 6)) for k in sorted(params)], "bound string, value double")


def r9_duplicate_strategy(spark, sf_dir):
    df = v.skewed_orders(spark, sf_dir)
    found = detect_issues(df, roles={"identity": ["hot_id"], "date": [], "numeric": []}, examples=False, duplicates=False)
    clash = [i for i in found if i.issue_id == "ID_CLASH"]
    rows = [(o.fix_id, o.is_recommended, clash[0].n_violations) for o in recommend.recommend(df, clash)]
    return spark.createDataFrame(rows, "fix_id string, is_recommended boolean, repeats long")


def r10_text_strategy(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, "priority_text", "email")
    ids = [("EMPTY_TEXT", "priority_text"), ("PROXY_MISSING", "priority_text"), ("EMPTY_TEXT", "email"), ("WHITESPACE", "email")]
    options = recommend.recommend(df, [_issue(i, c) for i, c in ids])
    rows = [(o.issue_id, o.column, o.fix_id, o.is_recommended, o.params.get("mode_value")) for o in options]
    return spark.createDataFrame(rows, "issue_id string, column string, fix_id string, is_recommended boolean, mode string")


def r11_clean_mode(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, "priority_text", "email")
    modes = clean_modes(df, {
        "strict:priority_text": clean_mode_values(F.col("priority_text"), at_sign=True),
        "text:priority_text": text_mode_values("priority_text"), "text:email": text_mode_values("email")})
    rows = [(c, m["mode"], m["top"], m["total"], m["distinct"]) for c, m in modes.items()]
    return spark.createDataFrame(rows, "rule string, mode string, top long, total long, variety long")


def r12_skewness(spark, sf_dir):
    orders = aggregate(v.dirty_orders(spark, sf_dir, "net_price", "customer_age"),
                       {c: adjusted_skewness(F.col(c)) for c in ("net_price", "customer_age")})
    events = aggregate(v.table(spark, sf_dir, "events"), {"value": adjusted_skewness(F.col("value"))})
    return spark.createDataFrame([(c, round(s, 6)) for c, s in {**orders, **events}.items()], "column string, skewness double")


def _median_of(column, condition):
    return f"(SELECT median({column}) FROM dirty WHERE {condition})"


QUERIES = {
    "r1_router": r1_router, "r2_recommended": r2_recommended, "r3_missing_strategy": r3_missing_strategy,
    "r4_numeric_strategy": _recommended(
        ("customer_age", "discount_pct", "tax_rate"),
        [("NEG_AGE", "customer_age"), ("RANGE_EXCEEDED", "discount_pct"), ("PERCENT_VIOLATION", "tax_rate")], median="median_value"),
    "r5_domain_strategy": _recommended(
        ("customer_age", "net_price"), [("IMPOSSIBLE_AGE", "customer_age"), ("INVALID_MONETARY", "net_price")], median="median_value"),
    "r6_date_strategy": r6_date_strategy,
    "r7_type_mismatch_strategy": _recommended(("amount_text",), [("WORD_AS_NUMBER", "amount_text")], median="median_value"),
    "r8_outlier_strategy": r8_outlier_strategy, "r9_duplicate_strategy": r9_duplicate_strategy,
    "r10_text_strategy": r10_text_strategy, "r11_clean_mode": r11_clean_mode, "r12_skewness": r12_skewness,
}


def _routes_sql(wanted, extra=""):
    """Routes of chosen issues with a parameter: (issue, column, fix, recommended, median SQL or None)."""
    parts = [f"SELECT '{i}' AS issue_id, '{c}' AS \"column\", '{f}' AS fix_id, {str(r).lower()} AS is_recommended, "
             f"CAST({m or 'NULL'} AS DOUBLE) AS median" for i, c, f, r, m in wanted]
    return f"{v.CTE} " + " UNION ALL ".join(parts)


_DAY_MEDIAN = (f"(SELECT strftime(make_timestamp(CAST(floor(quantile_cont(CAST(epoch_us({v.sql_date('order_date')}) AS DOUBLE), 0.5)) "
               "AS BIGINT)), '%Y-%m-%d') FROM dirty)")
_STRICT = (f"NOT regexp_matches(priority_text, '{v.vocab.SPECIAL_OR_AT_PATTERN}') AND lower({v.sql_strip('priority_text')}) "
           f"NOT IN ({v.sql_strings(v.vocab.UNCLEAN_MODE_TOKENS)})")
_TEXT = (f"NOT regexp_matches(priority_text, '{v.vocab.SPECIAL_PATTERN}') AND lower({v.sql_strip('priority_text')}) "
         f"NOT IN ({v.sql_strings(v.vocab.UNCLEAN_TEXT_MODE_TOKENS)})")
_EMAIL = f"lower({v.sql_strip('email')}) NOT IN ({v.sql_strings(v.vocab.UNCLEAN_TEXT_MODE_TOKENS)})"


def _top(column, condition):
    return f"(SELECT {column} FROM dirty WHERE {condition} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _mode_row(rule, column, condition):
    return (f"SELECT '{rule}' AS rule, {_top(column, condition)} AS mode, max(k) AS top, CAST(sum(k) AS BIGINT) AS total, "
            f"count(*) AS variety FROM (SELECT count(*) AS k FROM dirty WHERE {condition} GROUP BY {column})")


_BOUNDS = {"p1": "q(0.01)", "p5": "q(0.05)", "p95": "q(0.95)", "p99": "q(0.99)",
           "lower_bound": "q(0.25) - 1.5 * (q(0.75) - q(0.25))", "upper_bound": "q(0.75) + 1.5 * (q(0.75) - q(0.25))"}
SQL = {
    "r1_router": _ROUTED_SQL,
    "r2_recommended": f"SELECT issue_id, \"column\", fix_id FROM ({_ROUTED_SQL}) WHERE is_recommended",
    "r3_missing_strategy": f"{_SPARSE_CTE} " + " UNION ALL ".join(p for c, k in _MISSING_KINDS.items() for p in _missing_sql(c, k)),
    "r4_numeric_strategy": _routes_sql([
        ("NEG_AGE", "customer_age", "FIX_NEGATIVE_TO_ABS", False, None),
        ("NEG_AGE", "customer_age", "FIX_NEGATIVE_TO_MEDIAN", True, _median_of("customer_age", "customer_age >= 0")),
        ("NEG_AGE", "customer_age", "FIX_NEGATIVE_TO_NAN", False, None),
        ("RANGE_EXCEEDED", "discount_pct", "FIX_CLIP_PERCENTAGE", True, None),
        ("RANGE_EXCEEDED", "discount_pct", "FIX_CAP_AT_100", True, None),
        ("RANGE_EXCEEDED", "discount_pct", "FIX_RANGE_TO_NAN", False, None),
        ("RANGE_EXCEEDED", "discount_pct", "FIX_DROP_INVALID_ROWS", False, None),
        ("PERCENT_VIOLATION", "tax_rate", "FIX_CLIP_PERCENTAGE", True, None),
        ("PERCENT_VIOLATION", "tax_rate", "FIX_SCALE_PERCENTAGE", False, None)]),
    "r5_domain_strategy": _routes_sql([
        ("IMPOSSIBLE_AGE", "customer_age", "FIX_IMPOSSIBLE_AGE_TO_MEDIAN", True,
         f"round_even({_median_of('customer_age', 'customer_age BETWEEN 0 AND 120')}, 0)"),
        ("IMPOSSIBLE_AGE", "customer_age", "FIX_IMPOSSIBLE_AGE_TO_NAN", False, None),
        ("IMPOSSIBLE_AGE", "customer_age", "FIX_DROP_IMPOSSIBLE_AGE_ROWS", False, None),
        ("INVALID_MONETARY", "net_price", "FIX_ZERO_MONETARY_TO_MEDIAN", True,
         f"round({_median_of('net_price', 'net_price > 0')}, 4)"),
        ("INVALID_MONETARY", "net_price", "FIX_ZERO_MONETARY_TO_NAN", False, None),
        ("INVALID_MONETARY", "net_price", "FIX_DROP_ZERO_MONETARY_ROWS", False, None)]),
    "r6_date_strategy": f"{v.CTE} SELECT f AS fix_id, r AS is_recommended, d AS day FROM (VALUES "
                        f"('FIX_INVALID_DATE_IMPUTE_MEDIAN', true, {_DAY_MEDIAN}), ('FIX_INVALID_DATE_TO_NAN', false, NULL), "
                        "('FIX_DROP_INVALID_DATE_ROWS', false, NULL), ('FIX_INVALID_DATE_DEFAULT', false, '1900-01-01')) t(f, r, d)",
    "r7_type_mismatch_strategy": _routes_sql([
        ("WORD_AS_NUMBER", "amount_text", "FIX_WORD_TO_NUMBER", True, None),
        ("WORD_AS_NUMBER", "amount_text", "FIX_TEXT_TO_NAN_IMPUTE", False, f"(SELECT median({v.sql_number('amount_text')}) FROM dirty)"),
        ("WORD_AS_NUMBER", "amount_text", "FIX_DROP_TEXT_ROWS", False, None)]),
    "r8_outlier_strategy": " UNION ALL ".join(
        f"SELECT '{b}' AS bound, round({e.replace('q(', 'quantile_cont(value, ')}, 6) AS value FROM events" for b, e in _BOUNDS.items()),
    "r9_duplicate_strategy": f"{v.SKEWED_CTE} SELECT f AS fix_id, r AS is_recommended, (SELECT count(*) - count(DISTINCT hot_id) FROM skewed) AS repeats "
                             "FROM (VALUES ('FIX_KEEP_FIRST_ID', true), ('FIX_KEEP_LAST_ID', false), ('FIX_KEEP_COMPLETE', false)) t(f, r)",
    "r10_text_strategy": f"{v.CTE} SELECT * FROM (VALUES "
                         f"('EMPTY_TEXT', 'priority_text', 'FIX_EMPTY_TEXT_TO_MODE', true, {_top('priority_text', _TEXT)}), "
                         "('EMPTY_TEXT', 'priority_text', 'FIX_EMPTY_TEXT_TO_NAN', true, NULL), "
                         "('PROXY_MISSING', 'priority_text', 'FIX_PROXY_TO_NAN', true, NULL), "
                         f"('EMPTY_TEXT', 'email', 'FIX_EMPTY_TEXT_TO_MODE', true, {_top('email', _EMAIL)}), "
                         "('EMPTY_TEXT', 'email', 'FIX_EMPTY_TEXT_TO_NAN', true, NULL), "
                         "('WHITESPACE', 'email', 'FIX_STRIP_WHITESPACE', true, NULL)) t(issue_id, \"column\", fix_id, is_recommended, mode)",
    "r11_clean_mode": f"{v.CTE} " + " UNION ALL ".join([
        _mode_row("strict:priority_text", "priority_text", _STRICT), _mode_row("text:priority_text", "priority_text", _TEXT),
        _mode_row("text:email", "email", _EMAIL)]),
    "r12_skewness": f"{v.CTE} SELECT 'net_price' AS \"column\", round(skewness(net_price), 6) AS skewness FROM dirty UNION ALL "
                    "SELECT 'customer_age', round(skewness(customer_age), 6) FROM dirty UNION ALL "
                    "SELECT 'value', round(skewness(value), 6) FROM events",
}

# ---------------------------------------------------------------- plans
# name -> expression over `orders`, for the file that is cleaned without options
_VISITS = {
    "record_id": v.DIRTY_ORDERS["record_id"],
    "visit_date": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "note": "o_orderstatus",
}
_STEPS = [
    PlanStep("WHITESPACE", "email"), PlanStep("EMAIL_FORMAT_ISSUE", "email"), PlanStep("PHONE_FORMAT_ISSUE", "phone"),
    PlanStep("IMPOSSIBLE_AGE", "customer_age"), PlanStep("PERCENT_VIOLATION", "discount_pct", "FIX_CLIP_PERCENTAGE"),
    PlanStep("DATE_FORMAT_MIXED", "order_date", "skip"), PlanStep("INVALID_MONETARY", "net_price", "FIX_DROP_ZERO_MONETARY_ROWS"),
    PlanStep("MISSING_VAL", "net_price", "FIX_MEDIAN_IMPUTE"),
]
_PLAN_COLUMNS = (KEY, "email", "phone", "customer_age", "discount_pct", "net_price", "order_date")


def _planned(spark, sf_dir, steps, columns=_PLAN_COLUMNS):
    df = v.dirty_orders(spark, sf_dir, *columns)
    return run_plan(df, [_issue(s.issue_id, s.column) for s in steps], steps, [KEY])


def a1_run_plan(spark, sf_dir):
    return _planned(spark, sf_dir, _STEPS)[0]


def a2_dropped_column(spark, sf_dir):
    """A later step on a dropped column is skipped; the other steps still apply."""
    cleaned, log = _planned(spark, sf_dir, [
        PlanStep("MISSING_VAL", "email", "FIX_DROP_COLUMN"), PlanStep("EMAIL_FORMAT_ISSUE", "email", "FIX_EMAIL_TYPOS"),
        PlanStep("PHONE_FORMAT_ISSUE", "phone", "FIX_STANDARDIZE_PHONE")], (KEY, "email", "phone"))
    rows = cleaned.agg(F.count("phone").alias("phones"), F.count(F.when(F.col("phone").rlike("[^0-9]"), 1)).alias("bad"))
    return rows.select(F.lit(",".join(cleaned.columns)).alias("columns"), "phones", "bad",
                       F.lit(sum(e.fix_applied == "skipped" for e in log)).cast("long").alias("skipped"))


def a3_row_guard(spark, sf_dir):
    """A drop of more than 30 percent of the rows is refused, a smaller one is not."""
    df = v.table(spark, sf_dir, "orders").selectExpr(
        KEY, "CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_totalprice END AS often",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS seldom")
    steps = [PlanStep("MISSING_VAL", "often", "FIX_DROP_ROWS"), PlanStep("MISSING_VAL", "seldom", "FIX_DROP_ROWS")]
    cleaned, log = run_plan(df, [_issue(s.issue_id, s.column) for s in steps], steps, [KEY])
    removed = {e.column: e.rows_removed for e in log}
    return cleaned.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(removed["often"]).cast("long").alias("often"), F.lit(removed["seldom"]).cast("long").alias("seldom"))


def a3b_half_guard(spark, sf_dir):
    """Once more than half of the rows are gone, a guarded drop is refused however small it is."""
    df = v.table(spark, sf_dir, "orders").selectExpr(
        KEY, "CASE WHEN o_orderkey % 5 < 3 THEN -1.0 ELSE o_totalprice END AS amount",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS seldom")
    steps = [PlanStep("INVALID_MONETARY", "amount", "FIX_DROP_ZERO_MONETARY_ROWS"), PlanStep("MISSING_VAL", "seldom", "FIX_DROP_ROWS")]
    cleaned, log = run_plan(df, [_issue(s.issue_id, s.column) for s in steps], steps, [KEY])
    return cleaned.agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(log[1].fix_applied == "skipped"))


def a4_execution_log(spark, sf_dir):
    log = _planned(spark, sf_dir, _STEPS)[1]
    return log_frame(spark, log).select("step", "column", "fix_id", "values_changed", "rows_removed")


def a5_completeness(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir).drop(KEY)
    return impact.cells(df).select("rows", "columns", "present", F.round("completeness", 8).alias("completeness"))


def a6_column_completeness(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir).drop(KEY)
    return impact.column_completeness(df).select("column", F.round("completeness", 8).alias("completeness"))


def a7_issue_counts(spark, sf_dir):
    df = v.table(spark, sf_dir, "orders").select(*v.COPY_COLUMNS)
    return impact.quality(df).select("rows", "columns", "missing", "duplicate_rows")


def a8_quality_score(spark, sf_dir):
    df = v.skewed_orders(spark, sf_dir).drop(KEY)
    return impact.quality(df).select(F.round("quality_score", 8).alias("quality_score"))


def a9_impact_report(spark, sf_dir):
    df = v.skewed_orders(spark, sf_dir).drop(KEY)
    steps = [PlanStep("DUPLICATE_ROWS", "*", "FIX_DROP_EXACT_DUPLICATES"), PlanStep("MISSING_VAL", "note", "FIX_MODE_IMPUTE")]
    cleaned, _ = run_plan(df, [_issue(s.issue_id, s.column) for s in steps], steps)
    return impact.impact(df, cleaned).select(
        "metric", "column", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


def a10_clean_file(spark, sf_dir):
    """A file with repeated ids and missing dates through the whole pipeline, no option given, and what was written."""
    path = scratch_path(spark, "visits") + ".csv"
    v.table(spark, sf_dir, "orders").orderBy(KEY).selectExpr(*[f"{e} AS {c}" for c, e in _VISITS.items()]).write.option("header", True).csv(path)
    outcome = clean_file(spark, path, output=scratch_path(spark, "visits"))
    written = read_csv(spark, outcome.written[0])
    return written.select("record_id", F.to_date("visit_date").cast("string").alias("visit_date"), "note")


def _again(spark, df, issue_id, column, **settings):
    """Violations before and after the recommended fix, both found with the same settings."""
    def count(frame):
        return sum(i.n_violations for i in detect_issues(frame, examples=False, duplicates=False, **settings)
                   if (i.issue_id, i.column) == (issue_id, column))
    issues = detect_issues(df, examples=False, duplicates=False, **settings)
    steps = [PlanStep(issue_id, column)]
    given = {n: s for n, s in settings.items() if n in ("as_of", "dayfirst")}
    cleaned, _ = run_plan(df, issues, steps, [KEY], **given)
    return spark.createDataFrame([(count(df), count(cleaned))], "before long, after long")


def a11_as_of(spark, sf_dir):
    return _again(spark, v.dirty_orders(spark, sf_dir, KEY, "order_date"), "FUTURE_DATE", "order_date", as_of=check_queries.AS_OF)


def a12_nan(spark, sf_dir):
    df = v.table(spark, sf_dir, "orders").selectExpr(
        KEY, "CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount")
    return _again(spark, df, "MISSING_VAL", "amount")


def a13_dayfirst(spark, sf_dir):
    """Dates that can be read both ways keep their meaning."""
    df = v.table(spark, sf_dir, "orders").select(KEY, F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"))
    steps = [PlanStep("DATE_FORMAT_MIXED", "order_date", "FIX_STANDARDIZE_DATE_FORMAT")]
    return run_plan(df, [_issue(s.issue_id, s.column) for s in steps], steps, [KEY], dayfirst=True)[0]


def a14_exact_decimals(spark, sf_dir):
    """Amounts of 30 digits: no two rows are taken for duplicates, and untouched cells keep every digit."""
    df = v.table(spark, sf_dir, "orders").selectExpr(
        KEY, "CASE WHEN o_orderkey % 9 = 0 THEN CAST(-1 AS DECIMAL(38,2)) ELSE CAST(o_orderkey AS DECIMAL(38,2)) + "
             "CAST('123456789012345678901234567890.25' AS DECIMAL(38,2)) END AS amount")
    steps = [PlanStep("INVALID_MONETARY", "amount", "FIX_ZERO_MONETARY_TO_NAN")]
    cleaned, _ = run_plan(df, [_issue(s.issue_id, s.column) for s in steps], steps, [KEY])
    repeated = impact.quality(df.select("amount").filter("amount > 0")).first()["duplicate_rows"]
    return cleaned.select(KEY, F.col("amount").cast("string").alias("amount"), F.lit(repeated).cast("long").alias("duplicates"))


def a15_key_rejected(spark, sf_dir):
    """A key that repeats is refused where a fix depends on row order."""
    df = v.skewed_orders(spark, sf_dir)
    try:
        apply_fix(df, "FIX_FORWARD_FILL", "note", order_by=["hot_id"])
        refused = False
    except ValueError:
        refused = True
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("hot_id").alias("keys")).withColumn("refused", F.lit(refused))


QUERIES |= {"a3b_half_guard": a3b_half_guard, "a10_clean_file": a10_clean_file, "a11_as_of": a11_as_of, "a12_nan": a12_nan,
            "a13_dayfirst": a13_dayfirst, "a14_exact_decimals": a14_exact_decimals, "a15_key_rejected": a15_key_rejected}
QUERIES |= {"a1_run_plan": a1_run_plan, "a2_dropped_column": a2_dropped_column, "a3_row_guard": a3_row_guard,
            "a4_execution_log": a4_execution_log, "a5_completeness": a5_completeness,
            "a6_column_completeness": a6_column_completeness, "a7_issue_counts": a7_issue_counts,
            "a8_quality_score": a8_quality_score, "a9_impact_report": a9_impact_report}


_AGE_MEDIAN = "(SELECT CAST(round_even(median(customer_age), 0) AS BIGINT) FROM dirty WHERE customer_age BETWEEN 0 AND 120)"
_STRIPPED = v.sql_strip("email")
_STRIP_TOUCHED = f"regexp_matches(email, '{v.vocab.EDGE_SPACE_PATTERN}')"
_ORDERS_N = "(SELECT count(*) FROM dirty)"
_COLUMNS = list(v.DIRTY_ORDERS)[1:]


def _quality_sql(source):
    columns = ("hot_id", "note", "grade")
    present = " + ".join(f"count({c})" for c in columns)
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))"
    return (f"SELECT count(*) AS n, {present} AS present, count(*) * 3 - ({present}) AS missing, count(*) - {distinct} AS dup, "
            f"({present}) * 100.0 / (count(*) * 3) AS complete, greatest(0, least(100, ({present}) * 100.0 / (count(*) * 3) "
            f"- (count(*) - {distinct}) * 10.0 / count(*))) AS score, " + ", ".join(
                f"count({c}) * 100.0 / count(*) AS c_{c}" for c in columns) + f" FROM {source}")


_IMPACT_METRICS = {"total_rows": "n", "total_columns": "3", "missing_values": "missing", "duplicate_rows": "dup",
                   "completeness": "complete", "quality_score": "score"}
_NOTE_MODE = "(SELECT note FROM old WHERE note IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_NOTE_MODE_NEW = _NOTE_MODE.replace("FROM old", "FROM dedup")
SQL |= {
    "a1_run_plan": f"{v.CTE}, kept AS (SELECT *, CASE WHEN NOT (customer_age BETWEEN 0 AND 120) THEN {_AGE_MEDIAN} ELSE customer_age END AS a "
                   "FROM dirty WHERE net_price IS NULL OR net_price > 0) SELECT o_orderkey, "
                   f"{v.sql_domains(_STRIPPED)} AS email, regexp_replace(phone, '[^0-9]', '', 'g') AS phone, a AS customer_age, "
                   "greatest(0, least(100, discount_pct)) AS discount_pct, coalesce(net_price, (SELECT median(net_price) FROM kept)) AS net_price, "
                   "order_date FROM kept",
    "a2_dropped_column": f"{v.CTE} SELECT 'o_orderkey,phone' AS columns, count(phone) AS phones, CAST(0 AS BIGINT) AS bad, "
                         "CAST(1 AS BIGINT) AS skipped FROM dirty",
    "a3_row_guard": "SELECT count(*) FILTER (o_orderkey % 7 <> 0) AS rows, CAST(0 AS BIGINT) AS often, "
                    "count(*) FILTER (o_orderkey % 7 = 0) AS seldom FROM orders",
    "a3b_half_guard": "SELECT count(*) AS rows, true AS refused FROM orders WHERE o_orderkey % 5 >= 3",
    "a10_clean_file": "WITH visits AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in _VISITS.items()) + " FROM orders), "
                      "filled AS (SELECT *, last_value(visit_date IGNORE NULLS) OVER (ORDER BY o_orderkey) AS seen, "
                      "row_number() OVER (PARTITION BY record_id ORDER BY o_orderkey) AS nth FROM visits) "
                      "SELECT record_id, seen AS visit_date, note FROM filled WHERE nth = 1",
    "a11_as_of": f"{v.CTE} SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM dirty WHERE {v.sql_date('order_date')} > TIMESTAMP '2000-01-01'",
    "a12_nan": "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0",
    "a13_dayfirst": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date FROM orders",
    "a14_exact_decimals": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderkey AS DECIMAL(38,2)) + "
                          "CAST('123456789012345678901234567890.25' AS DECIMAL(38,2)) AS VARCHAR) END AS amount, CAST(0 AS BIGINT) AS duplicates FROM orders",
    "a15_key_rejected": f"{v.SKEWED_CTE} SELECT count(*) AS rows, count(DISTINCT hot_id) AS keys, true AS refused FROM skewed",
    "a4_execution_log": f"{v.CTE} SELECT CAST(s AS INTEGER) AS step, c AS \"column\", f AS fix_id, CAST(n AS BIGINT) AS values_changed, "
                        "CAST(r AS BIGINT) AS rows_removed FROM (VALUES "
                        f"(1, 'email', 'FIX_STRIP_WHITESPACE', (SELECT count(*) FROM dirty WHERE {_STRIP_TOUCHED}), NULL), "
                        f"(2, 'email', 'FIX_EMAIL_TYPOS', (SELECT count(*) FROM dirty WHERE {v.sql_typo('email')}), NULL), "
                        "(3, 'phone', 'FIX_STANDARDIZE_PHONE', (SELECT count(*) FROM dirty WHERE regexp_matches(phone, '[^0-9]')), NULL), "
                        "(4, 'customer_age', 'FIX_IMPOSSIBLE_AGE_TO_MEDIAN', (SELECT count(*) FROM dirty WHERE NOT (customer_age BETWEEN 0 AND 120)), NULL), "
                        "(5, 'discount_pct', 'FIX_CLIP_PERCENTAGE', (SELECT count(*) FROM dirty WHERE discount_pct < 0 OR discount_pct > 100), NULL), "
                        "(6, 'order_date', 'skip', NULL, NULL), "
                        "(7, 'net_price', 'FIX_DROP_ZERO_MONETARY_ROWS', NULL, (SELECT count(*) FROM dirty WHERE net_price <= 0)), "
                        "(8, 'net_price', 'FIX_MEDIAN_IMPUTE', (SELECT count(*) FROM dirty WHERE net_price IS NULL), NULL)) t(s, c, f, n, r)",
    "a5_completeness": f"{v.CTE} SELECT count(*) AS rows, CAST({len(_COLUMNS)} AS BIGINT) AS columns, "
                       f"{' + '.join(f'count({c})' for c in _COLUMNS)} AS present, "
                       f"round(({' + '.join(f'count({c})' for c in _COLUMNS)}) / (count(*) * {len(_COLUMNS)}) * 100, 8) AS completeness FROM dirty",
    "a6_column_completeness": f"{v.CTE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(count({c}) / count(*) * 100, 8) AS completeness FROM dirty" for c in _COLUMNS),
    "a7_issue_counts": f"SELECT count(*) AS rows, CAST({len(v.COPY_COLUMNS)} AS BIGINT) AS columns, "
                       f"{' + '.join(f'(count(*) - count({c}))' for c in v.COPY_COLUMNS)} AS missing, count(*) - (SELECT count(*) FROM "
                       f"(SELECT DISTINCT {', '.join(v.COPY_COLUMNS)} FROM orders)) AS duplicate_rows FROM orders",
    "a8_quality_score": f"{v.SKEWED_CTE}, old AS (SELECT hot_id, note, grade FROM skewed), q AS ({_quality_sql('old')}) "
                        "SELECT round(CAST(score AS DOUBLE), 8) AS quality_score FROM q",
    "a9_impact_report": f"{v.SKEWED_CTE}, old AS (SELECT hot_id, note, grade FROM skewed), dedup AS (SELECT DISTINCT * FROM old), "
                        f"new AS (SELECT hot_id, coalesce(note, {_NOTE_MODE_NEW}) AS note, grade FROM dedup), "
                        f"b AS ({_quality_sql('old')}), a AS ({_quality_sql('new')}), r AS (" + " UNION ALL ".join(
                            [f"SELECT '{m}' AS metric, CAST(NULL AS VARCHAR) AS \"column\", (SELECT CAST({e} AS DOUBLE) FROM b) AS before, "
                             f"(SELECT CAST({e} AS DOUBLE) FROM a) AS after" for m, e in _IMPACT_METRICS.items()]
                            + [f"SELECT 'column_completeness', '{c}', (SELECT CAST(c_{c} AS DOUBLE) FROM b), (SELECT CAST(c_{c} AS DOUBLE) FROM a)"
                               for c in ("hot_id", "note", "grade")])
                        + ") SELECT metric, \"column\", round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM r",
}
