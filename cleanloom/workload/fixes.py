"""Queries of the fixes: the rewritten value, or the rows kept, for every fix."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.functions import vocab
from cleanloom.operators.fixes import apply_fix
from cleanloom.workload import views as v

KEY = "o_orderkey"
_WORDS = "CASE " + " ".join(
    f"WHEN lower({v.sql_strip('amount_text')}) = '{w}' THEN {n}" for w, n in vocab.NUMBER_WORDS.items()) + " END"
_AMOUNT = v.sql_number("amount_text")
_DATE = v.sql_date("order_date")
_BAD_DATE = f"(order_date IS NOT NULL AND {_DATE} IS NULL)"


def _clean(c, pattern, tokens):
    return f"NOT regexp_matches({c}, '{pattern}') AND lower({v.sql_strip(c)}) NOT IN ({v.sql_strings(tokens)})"


def _mode(condition):
    return (f"(SELECT priority_text FROM dirty WHERE {condition} GROUP BY 1 ORDER BY count(*) DESC, priority_text LIMIT 1)")


def _domains(c):
    for typo, domain in vocab.EMAIL_TYPOS.items():
        c = f"regexp_replace({c}, '(?i){typo.replace('.', '[.]')}', '{domain}', 'g')"
    return c


def _clip(c, low, high):
    return f"CASE WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} ELSE {c} END"


def _cap(c, low, high):
    bound = f"(SELECT quantile_cont({c}, %s) FROM dirty)"
    return _clip(c, bound % low, bound % high)


_Q1, _Q3 = (f"(SELECT quantile_cont(net_price, {q}) FROM dirty)" for q in (0.25, 0.75))
_MEDIAN = "(SELECT quantile_cont(%s, 0.5) FROM dirty WHERE %s)"
_VALID_AGE = "customer_age BETWEEN 0 AND 120"

# Value fixes: query -> (fix id, column, SQL of the new value).
VALUES = {
    "f1_median_impute": ("FIX_MEDIAN_IMPUTE", "net_price", "coalesce(net_price, (SELECT median(net_price) FROM dirty))"),
    "f2_mean_impute": ("FIX_MEAN_IMPUTE", "customer_age",
                       "coalesce(customer_age, (SELECT CAST(round_even(avg(customer_age), 0) AS BIGINT) FROM dirty))"),
    "f3_mode_impute": ("FIX_MODE_IMPUTE", "priority_text", "coalesce(priority_text, " + _mode(
        _clean("priority_text", vocab.SPECIAL_OR_AT_PATTERN, vocab.UNCLEAN_MODE_TOKENS)) + ")"),
    "f4_extract_numeric_impute": (
        "FIX_EXTRACT_NUMERIC_IMPUTE", "phone",
        "coalesce(TRY_CAST(regexp_extract(phone, '([0-9]+)', 1) AS BIGINT), (SELECT CAST(trunc(quantile_cont("
        "CAST(TRY_CAST(regexp_extract(phone, '([0-9]+)', 1) AS BIGINT) AS DOUBLE), 0.5)) AS BIGINT) FROM dirty))"),
    "f5_forward_fill": ("FIX_FORWARD_FILL", "net_price",
                        "last_value(net_price IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"),
    "f15_negative_to_abs": ("FIX_NEGATIVE_TO_ABS", "net_price", "abs(net_price)"),
    "f16_negative_to_median": (
        "FIX_NEGATIVE_TO_MEDIAN", "customer_age", "CASE WHEN customer_age < 0 THEN (SELECT CAST(round_even("
        "quantile_cont(customer_age, 0.5), 0) AS BIGINT) FROM dirty WHERE customer_age >= 0) ELSE customer_age END"),
    "f17_negative_to_null": ("FIX_NEGATIVE_TO_NAN", "customer_age", "CASE WHEN customer_age >= 0 THEN customer_age END"),
    "f18_cap_at_100": ("FIX_CAP_AT_100", "discount_pct", "CASE WHEN discount_pct > 100 THEN 100 ELSE discount_pct END"),
    "f19_range_to_null": ("FIX_RANGE_TO_NAN", "discount_pct", "CASE WHEN discount_pct <= 100 THEN discount_pct END"),
    "f20_clip_percentage": ("FIX_CLIP_PERCENTAGE", "tax_rate", _clip("tax_rate", "CAST(0 AS DOUBLE)", "CAST(100 AS DOUBLE)")),
    "f21_scale_percentage": ("FIX_SCALE_PERCENTAGE", "tax_rate",
                             "CASE WHEN tax_rate > 0 AND tax_rate < 1 THEN tax_rate * 100 ELSE tax_rate END"),
    "f22_word_to_number": ("FIX_WORD_TO_NUMBER", "amount_text", f"coalesce(CAST({_WORDS} AS DOUBLE), {_AMOUNT})"),
    "f23_text_to_median": ("FIX_TEXT_TO_NAN_IMPUTE", "amount_text",
                           f"coalesce({_AMOUNT}, (SELECT median({_AMOUNT}) FROM dirty))"),
    "f24_cap_percentile": ("FIX_CAP_PERCENTILE", "net_price", _cap("net_price", 0.01, 0.99)),
    "f25_cap_iqr": ("FIX_CAP_IQR", "net_price", _clip(
        "net_price", f"({_Q1} - 1.5 * ({_Q3} - {_Q1}))", f"({_Q3} + 1.5 * ({_Q3} - {_Q1}))")),
    "f26_winsorize": ("FIX_WINSORIZE", "net_price", _cap("net_price", 0.05, 0.95)),
    "f27_impossible_age_to_median": (
        "FIX_IMPOSSIBLE_AGE_TO_MEDIAN", "customer_age", f"CASE WHEN NOT ({_VALID_AGE}) THEN (SELECT CAST(round_even("
        f"quantile_cont(customer_age, 0.5), 0) AS BIGINT) FROM dirty WHERE {_VALID_AGE}) ELSE customer_age END"),
    "f28_impossible_age_to_null": ("FIX_IMPOSSIBLE_AGE_TO_NAN", "customer_age", f"CASE WHEN {_VALID_AGE} THEN customer_age END"),
    "f29_monetary_to_median": ("FIX_ZERO_MONETARY_TO_MEDIAN", "net_price", "CASE WHEN net_price <= 0 THEN "
                               + _MEDIAN % ("net_price", "net_price > 0") + " ELSE net_price END"),
    "f30_monetary_to_null": ("FIX_ZERO_MONETARY_TO_NAN", "net_price", "CASE WHEN net_price > 0 THEN net_price END"),
    "f36_strip_whitespace": ("FIX_STRIP_WHITESPACE", "priority_text", v.sql_strip("priority_text")),
    "f38_lower_case": ("FIX_STANDARDIZE_CASE_LOWER", "priority_text", "lower(priority_text)"),
    "f39_proxy_to_null": ("FIX_PROXY_TO_NAN", "priority_text", f"CASE WHEN NOT {v.sql_proxy('priority_text')} THEN priority_text END"),
    "f40_remove_special": ("FIX_REMOVE_SPECIAL_CHARS", "priority_text",
                           "regexp_replace(priority_text, '[?!@#$%^&*]', '', 'g')"),
    "f41_special_to_space": ("FIX_REPLACE_SPECIAL_WITH_SPACE", "priority_text",
                             "regexp_replace(priority_text, '[?!@#$%^&*]', ' ', 'g')"),
    "f42_empty_to_mode": ("FIX_EMPTY_TEXT_TO_MODE", "priority_text",
                          f"CASE WHEN {v.sql_empty('priority_text')} THEN " + _mode(
                              _clean("priority_text", vocab.SPECIAL_PATTERN, vocab.UNCLEAN_TEXT_MODE_TOKENS))
                          + " ELSE priority_text END"),
    "f43_empty_to_null": ("FIX_EMPTY_TEXT_TO_NAN", "priority_text",
                          f"CASE WHEN NOT {v.sql_empty('priority_text')} THEN priority_text END"),
    "f44_email_typos": ("FIX_EMAIL_TYPOS", "email", _domains("email")),
    "f45_standardize_phone": ("FIX_STANDARDIZE_PHONE", "phone", "regexp_replace(phone, '[^0-9]', '', 'g')"),
    "f46_invalid_date_to_null": ("FIX_INVALID_DATE_TO_NAN", "order_date", f"CASE WHEN NOT {_BAD_DATE} THEN order_date END"),
    "f47_invalid_date_default": ("FIX_INVALID_DATE_DEFAULT", "order_date",
                                 f"CASE WHEN {_BAD_DATE} THEN '1900-01-01' ELSE order_date END"),
    "f48_invalid_date_median": (
        "FIX_INVALID_DATE_IMPUTE_MEDIAN", "order_date", f"CASE WHEN {_BAD_DATE} THEN (SELECT strftime(make_timestamp(CAST(floor("
        f"quantile_cont(CAST(epoch_us({_DATE}) AS DOUBLE), 0.5)) AS BIGINT)), '%Y-%m-%d') FROM dirty) ELSE order_date END"),
    "f49_standardize_date": ("FIX_STANDARDIZE_DATE_FORMAT", "order_date",
                             f"coalesce(strftime({_DATE}, '%Y-%m-%d'), order_date)"),
    "f51_invalid_email_to_null": ("FIX_INVALID_EMAIL_TO_NAN", "email", f"CASE WHEN {v.sql_email_ok('email')} THEN email END"),
}

# Row filters: query -> (fix id, column, SQL condition of the rows kept).
ROWS = {
    "f8_drop_null_rows": ("FIX_DROP_ROWS", "customer_age", "customer_age IS NOT NULL"),
    "f9_drop_invalid_rows": ("FIX_DROP_INVALID_ROWS", "discount_pct", "discount_pct <= 100"),
    "f10_drop_text_rows": ("FIX_DROP_TEXT_ROWS", "amount_text", "amount_text IS NULL OR NOT regexp_matches(amount_text, '[a-zA-Z]')"),
    "f11_drop_invalid_date_rows": ("FIX_DROP_INVALID_DATE_ROWS", "order_date", f"NOT {_BAD_DATE}"),
    "f12_drop_impossible_age_rows": ("FIX_DROP_IMPOSSIBLE_AGE_ROWS", "customer_age", f"customer_age IS NULL OR {_VALID_AGE}"),
    "f13_drop_zero_monetary_rows": ("FIX_DROP_ZERO_MONETARY_ROWS", "net_price", "net_price IS NULL OR net_price > 0"),
    "f14_remove_outliers": ("FIX_REMOVE_OUTLIERS", "net_price", "abs((net_price - (SELECT avg(net_price) FROM dirty)) / "
                            "(SELECT stddev_samp(net_price) FROM dirty)) <= 3"),
}


def _query(fix_id, column):
    def run(spark, sf_dir):
        df = v.dirty_orders(spark, sf_dir, KEY, column)
        return apply_fix(df, fix_id, column, order_by=[KEY]).select(KEY, F.col(column).alias("value"))
    return run


QUERIES = {name: _query(fix_id, column) for name, (fix_id, column, _) in (VALUES | ROWS).items()}
SQL = {name: f"{v.CTE} SELECT o_orderkey, {sql} AS value FROM dirty" for name, (_, _, sql) in VALUES.items()}
SQL |= {name: f"{v.CTE} SELECT o_orderkey, {column} AS value FROM dirty WHERE {keep}" for name, (_, column, keep) in ROWS.items()}


def f6_stochastic_fill(spark, sf_dir):
    """What must hold of a random fill: no nulls, known values unchanged, drawn values known."""
    df = v.dirty_orders(spark, sf_dir, KEY, "net_price")
    filled = apply_fix(df, "FIX_STOCHASTIC_FILL", "net_price", order_by=[KEY])
    both = df.withColumnRenamed("net_price", "old").join(filled, KEY)
    known = df.select(F.col("net_price").alias("known")).filter("known IS NOT NULL").distinct()
    checked = both.join(known, both.net_price == known.known, "left")
    return checked.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("net_price").isNull(), 1)).alias("nulls"),
        F.count(F.when(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("net_price")), 1)).alias("changed"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"))


def f7_drop_column(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, KEY, "email", "phone")
    return apply_fix(df, "FIX_DROP_COLUMN", "email")


def _duplicate_query(fix_id):
    def run(spark, sf_dir):
        return apply_fix(v.skewed_orders(spark, sf_dir), fix_id, "hot_id", order_by=[KEY])
    return run


def f34_drop_exact_duplicates(spark, sf_dir):
    df = v.table(spark, sf_dir, "orders").select(*v.COPY_COLUMNS)
    return apply_fix(df, "FIX_DROP_EXACT_DUPLICATES", "*")


def f35_reset_ids(spark, sf_dir):
    """Identifiers renumbered after rows were dropped."""
    df = v.dirty_orders(spark, sf_dir, KEY, "record_id", "net_price")
    df = apply_fix(df, "FIX_DROP_ZERO_MONETARY_ROWS", "net_price")
    return apply_fix(df, "RESET_ID_COLUMNS", "record_id", order_by=[KEY]).select(KEY, "record_id")


def f37_remove_non_ascii(spark, sf_dir):
    """Digest of each whole cleaned text."""
    df = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_fix(df, "FIX_REMOVE_NON_ASCII", "text").select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


def f50_swap_dates(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, KEY, "order_date", "ship_date")
    return apply_fix(df, "FIX_SWAP_LOGICAL_DATES", "order_date -> ship_date")


def f52_future_date_to_null(spark, sf_dir):
    import datetime as dt

    df = v.dirty_orders(spark, sf_dir, KEY, "order_date")
    return apply_fix(df, "FIX_FUTURE_DATE_TO_NAN", "order_date", {"as_of": dt.datetime(2000, 1, 1)})


QUERIES |= {
    "f6_stochastic_fill": f6_stochastic_fill, "f7_drop_column": f7_drop_column,
    "f31_keep_first": _duplicate_query("FIX_KEEP_FIRST_ID"), "f32_keep_last": _duplicate_query("FIX_KEEP_LAST_ID"),
    "f33_keep_complete": _duplicate_query("FIX_KEEP_COMPLETE"), "f34_drop_exact_duplicates": f34_drop_exact_duplicates,
    "f35_reset_ids": f35_reset_ids, "f37_remove_non_ascii": f37_remove_non_ascii, "f50_swap_dates": f50_swap_dates,
    "f52_future_date_to_null": f52_future_date_to_null,
}


def _keep(order):
    return (f"{v.SKEWED_CTE} SELECT o_orderkey, hot_id, note, grade FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY hot_id ORDER BY {order}) AS r FROM skewed) WHERE r = 1")


_LATE = f"({v.sql_date('ship_date')} < {_DATE})"
SQL |= {
    "f6_stochastic_fill": f"{v.CTE} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS changed, "
                          "CAST(0 AS BIGINT) AS unknown FROM dirty",
    "f7_drop_column": f"{v.CTE} SELECT o_orderkey, phone FROM dirty",
    "f31_keep_first": _keep("o_orderkey"),
    "f32_keep_last": _keep("o_orderkey DESC"),
    "f33_keep_complete": _keep("CAST(note IS NULL AS INT) + CAST(grade IS NULL AS INT), o_orderkey"),
    "f34_drop_exact_duplicates": f"SELECT DISTINCT {', '.join(v.COPY_COLUMNS)} FROM orders",
    "f35_reset_ids": f"{v.CTE} SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS record_id FROM dirty "
                     "WHERE net_price IS NULL OR net_price > 0",
    "f37_remove_non_ascii": r"SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, "
                            r"regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM documents)",
    "f50_swap_dates": f"{v.CTE} SELECT o_orderkey, CASE WHEN {_LATE} THEN ship_date ELSE order_date END AS order_date, "
                      f"CASE WHEN {_LATE} THEN order_date ELSE ship_date END AS ship_date FROM dirty",
    "f52_future_date_to_null": f"{v.CTE} SELECT o_orderkey, CASE WHEN {_DATE} > TIMESTAMP '2000-01-01' THEN NULL "
                               "ELSE order_date END AS order_date FROM dirty",
}
