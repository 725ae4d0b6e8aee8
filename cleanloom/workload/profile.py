"""Queries of schema validation, type inference and profiling."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import functions as F

from cleanloom.functions.stats import distinct_counts, percentiles, top_values
from cleanloom.operators import infer, profile, schema, summary
from cleanloom.session import scratch_path
from cleanloom.sources.csv import raw_header, read_csv
from cleanloom.workload import views as v

KEY = "o_orderkey"
COLUMNS = [c for c in v.DIRTY_ORDERS if c != KEY]
EXPECTED = ["record_id", "customer_age", "no_such_column"]


def _validated(spark, sf_dir, **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return schema.validate_schema(v.dirty_orders(spark, sf_dir), **options)


def p1_shape(spark, sf_dir):
    report = _validated(spark, sf_dir)
    return spark.createDataFrame([(report.rows, report.columns)], "rows long, columns long")


def p2_column_order(spark, sf_dir):
    report = _validated(spark, sf_dir)
    return spark.createDataFrame([(i, c) for i, c in enumerate(report.column_order)], "position long, column string")


HEADER = "key,cust,,cust"


def _headed(spark, sf_dir):
    """Report on orders written as CSV files under a header with a repeated and an empty name."""
    path = scratch_path(spark, "headed") + ".csv"
    lines = v.table(spark, sf_dir, "orders").select(
        F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_custkey").alias("value"))

    def under_header(batches):
        yield pd.DataFrame({"value": [HEADER]})
        yield from batches

    lines.mapInPandas(under_header, "value string").write.text(path)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return schema.validate_schema(read_csv(spark, path), header=raw_header(spark, path))


def p3_duplicate_columns(spark, sf_dir):
    report = _headed(spark, sf_dir)
    return spark.createDataFrame([(c, report.rows) for c in report.duplicate_columns], "column string, rows long")


def p4_empty_columns(spark, sf_dir):
    report = _headed(spark, sf_dir)
    return spark.createDataFrame([(len(report.empty_columns), report.rows)], "empty_names long, rows long")


def p5_expected_columns(spark, sf_dir):
    report = _validated(spark, sf_dir, expected=EXPECTED)
    rows = [(c, "missing") for c in report.missing_columns] + [(c, "extra") for c in report.extra_columns]
    return spark.createDataFrame(rows, "column string, status string")


def p6_strict(spark, sf_dir):
    try:
        _validated(spark, sf_dir, expected=EXPECTED, strict=True)
        raised = False
    except schema.SchemaError:
        raised = True
    accepted = _validated(spark, sf_dir, expected=list(v.DIRTY_ORDERS), strict=True)
    return spark.createDataFrame([(raised, accepted.rows)], "raised boolean, rows long")


def p7_missing_values(spark, sf_dir):
    return _validated(spark, sf_dir).frame(spark).select("column", "nulls")


# ---------------------------------------------------------------- inference
_TYPED = {
    "o_orderkey": "o_orderkey",
    "flag_text": "CASE WHEN o_orderkey % 3 = 0 THEN 'True' WHEN o_orderkey % 3 = 1 THEN '0' ELSE NULL END",
    "flag_number": "o_orderkey % 2",
    "comma_number": "CASE WHEN o_orderkey % 20 = 0 THEN 'none' ELSE CAST(o_custkey % 900 + 1 AS STRING) || ',' || "
                    "CAST(o_orderkey % 900 + 100 AS STRING) END",
    "day_text": f"CASE WHEN o_orderkey % 25 = 0 THEN 'soon' ELSE {v._DAY} || '/' || {v._M} || '/' || {v._Y} END",
    "mixed_day": f"CASE WHEN o_orderkey % 2 = 0 THEN {v._D} ELSE {v._M} || '/' || {v._DAY} || '/' || {v._Y} END",
    "status_text": "o_orderstatus",
    "free_text": "o_orderpriority || CAST(o_orderkey AS STRING)",
    "price": "o_totalprice",
}
_TYPED_CTE = "WITH typed AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _TYPED.items()) + " FROM orders)"


def _typed(spark, sf_dir, *columns):
    return v.table(spark, sf_dir, "orders").selectExpr(*[f"{_TYPED[c]} AS {c}" for c in (columns or _TYPED)])


def _inferred(*columns):
    def run(spark, sf_dir):
        df = _typed(spark, sf_dir, KEY, *columns)
        types = infer.infer_types(df.drop(KEY))
        return infer.apply_types(df, {KEY: ("numeric", None), **types}).select(
            KEY, *[F.date_format(c, "yyyy-MM-dd").alias(c) if types[c][0] == "datetime" else F.col(c) for c in columns])
    return run


def p11_categorical_text(spark, sf_dir):
    types = infer.infer_types(_typed(spark, sf_dir, "status_text", "free_text"))
    return infer.type_report(spark, types)


def p12_type_report(spark, sf_dir):
    return infer.type_report(spark, infer.infer_types(_typed(spark, sf_dir)))


# ---------------------------------------------------------------- profile
def p13_column_profile(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, *COLUMNS)
    return profile.profile(df, "orders").select("column", "rows", "nulls", "distinct")


def p14_first_values(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, KEY, "priority_text", "phone")
    counts = profile.counted_values(df, [KEY], ["priority_text", "phone"])
    return top_values(counts, 5, by_first=True).select("column", "value", F.col("rank").cast("long").alias("rank"))


def p15_numeric_stats(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, "customer_age", "net_price", "discount_pct")
    m = profile.column_measures(df)
    rows = [(c, round(m[(c, "mean")], 6), round(m[(c, "std")], 6), m[(c, "min")], m[(c, "max")]) for c in df.columns]
    return spark.createDataFrame(rows, "column string, mean double, std double, min double, max double")


def p16_date_range(spark, sf_dir):
    m = profile.column_measures(v.table(spark, sf_dir, "orders").select("o_orderdate"))
    e = profile.column_measures(v.table(spark, sf_dir, "events").select("ts"))
    rows = [("o_orderdate", str(m[("o_orderdate", "min_date")]), str(m[("o_orderdate", "max_date")])),
            ("ts", e[("ts", "min_date")].strftime("%Y-%m-%d %H:%M:%S.%f"), e[("ts", "max_date")].strftime("%Y-%m-%d %H:%M:%S.%f"))]
    return spark.createDataFrame(rows, "column string, first string, last string")


def p17_top_values(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, "priority_text", "phone", "email")
    texts = profile._texts(df)
    return top_values(profile.counted_values(df), 5, whole=(df, texts)).select("column", "value", "n", F.col("rank").cast("long").alias("rank"))


def p18_mean_length(spark, sf_dir):
    df = v.table(spark, sf_dir, "documents").select("text", "lang", "source")
    m = profile.column_measures(df)
    return spark.createDataFrame([(c, round(m[(c, "avg_length")], 6)) for c in df.columns], "column string, avg_length double")


def p19_source(spark, sf_dir):
    df = v.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return profile.profile(df, source="orders.parquet").select(
        "column", "source", "rows", F.col("ingested_at").isNotNull().alias("stamped"))


def p17_long_texts(spark, sf_dir):
    """The most frequent whole texts of all documents; nearly all of them tie."""
    df = v.table(spark, sf_dir, "documents").select("text")
    counts = profile.counted_values(df)
    return top_values(counts, 20, whole=(df, {"text": F.col("text")})).select("value", "n", F.col("rank").cast("long").alias("rank"))


_SUMMED = ("customer_age", "net_price", "discount_pct", "tax_rate", "phone", "priority_text", "period_start")
_SUMMED_NUMBERS = _SUMMED[:4]


def p20_appended_profile(spark, sf_dir):
    """Profile of a folder that grew twice: every load is summarised once and merged with what is known.

    The sketched measures are compared with the exact ones of all rows: whether they keep the stated errors.
    """
    df = v.dirty_orders(spark, sf_dir, *_SUMMED)
    data, states = scratch_path(spark, "loads"), scratch_path(spark, "summaries")
    loads = v.table(spark, sf_dir, "orders").selectExpr("o_orderstatus", *[f"{v.DIRTY_ORDERS[c]} AS {c}" for c in _SUMMED])
    for load in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL"):
        loads.filter(load).drop("o_orderstatus").write.mode("append").parquet(data)
        table = summary.refresh(spark, data, states)
    found = summary.described(table).collect()  # a row per column
    distinct = distinct_counts(df, profile._texts(df))
    reach = summary.RANK_ERROR
    edges = percentiles(df, {c: (F.col(c), [p + d for p in summary.QUARTILES for d in (-reach, reach)]) for c in _SUMMED_NUMBERS})
    rows = []
    for r in found:
        near = r.column not in edges or all(
            edges[r.column][2 * i] <= q <= edges[r.column][2 * i + 1] for i, q in enumerate(r.quartiles))
        rows.append((r.column, r.rows, r.nulls, r.mean and round(r.mean, 6), r.std and round(r.std, 6), r.min, r.max, str(r.min_date or ""),
                     str(r.max_date or ""), r.avg_length and round(r.avg_length, 6),
                     abs(r.distinct - distinct[r.column]) <= summary.DISTINCT_ERROR * distinct[r.column], near))
    return spark.createDataFrame(rows, "column string, rows long, nulls long, mean double, std double, min double, max double, first string, "
                                       "last string, avg_length double, distinct_kept boolean, quartiles_kept boolean")


QUERIES = {
    "p20_appended_profile": p20_appended_profile,
    "p1_shape": p1_shape, "p2_column_order": p2_column_order, "p3_duplicate_columns": p3_duplicate_columns,
    "p4_empty_columns": p4_empty_columns, "p5_expected_columns": p5_expected_columns, "p6_strict": p6_strict,
    "p7_missing_values": p7_missing_values, "p8_boolean": _inferred("flag_text", "flag_number"),
    "p9_numeric": _inferred("comma_number"), "p10_datetime": _inferred("day_text", "mixed_day"),
    "p11_categorical_text": p11_categorical_text, "p12_type_report": p12_type_report,
    "p13_column_profile": p13_column_profile, "p14_first_values": p14_first_values,
    "p17_long_texts": p17_long_texts, "p15_numeric_stats": p15_numeric_stats, "p16_date_range": p16_date_range, "p17_top_values": p17_top_values,
    "p18_mean_length": p18_mean_length, "p19_source": p19_source,
}


def _each(columns, select):
    return " UNION ALL ".join(select(c) for c in columns)


def _values(*rows):
    return ", ".join("(" + ", ".join(str(x) for x in r) + ")" for r in rows)


_TYPE_RULES = {
    "o_orderkey": "'numeric'",
    "flag_text": "CASE WHEN bool_and(lower(flag_text) IN ('0', '1', 'true', 'false')) THEN 'boolean' ELSE 'text' END",
    "flag_number": "CASE WHEN bool_and(flag_number IN (0, 1)) THEN 'boolean' ELSE 'numeric' END",
    "comma_number": "CASE WHEN count(TRY_CAST(replace(comma_number, ',', '') AS DOUBLE)) > 0.9 * count(*) THEN 'numeric' ELSE 'text' END",
    "day_text": "CASE WHEN count(try_strptime(day_text, '%d/%m/%Y')) > 0.9 * count(*) THEN 'datetime' ELSE 'text' END",
    "mixed_day": f"CASE WHEN count({v.sql_date('mixed_day')}) > 0.9 * count(*) THEN 'datetime' ELSE 'text' END",
    "status_text": "CASE WHEN count(DISTINCT status_text) <= 0.05 * count(*) THEN 'categorical' ELSE 'text' END",
    "free_text": "CASE WHEN count(DISTINCT free_text) <= 0.05 * count(*) THEN 'categorical' ELSE 'text' END",
    "price": "'numeric'",
}


def _types_sql(columns):
    return _TYPED_CTE + " " + _each(
        columns, lambda c: f"SELECT '{c}' AS \"column\", any_value(t) AS inferred_type FROM (SELECT {_TYPE_RULES[c]} AS t FROM typed)")


SQL = {
    "p1_shape": f"SELECT count(*) AS rows, CAST({len(v.DIRTY_ORDERS)} AS BIGINT) AS columns FROM orders",
    "p2_column_order": "SELECT CAST(p AS BIGINT) AS position, c AS \"column\" FROM (VALUES "
                       + _values(*[(i, f"'{c}'") for i, c in enumerate(v.DIRTY_ORDERS)]) + ") t(p, c)",
    "p3_duplicate_columns": "SELECT 'cust' AS \"column\", count(*) AS rows FROM orders",
    "p4_empty_columns": "SELECT CAST(1 AS BIGINT) AS empty_names, count(*) AS rows FROM orders",
    "p5_expected_columns": "SELECT c AS \"column\", s AS status FROM (VALUES ('no_such_column', 'missing'), " + _values(
        *[(f"'{c}'", "'extra'") for c in v.DIRTY_ORDERS if c not in EXPECTED]) + ") t(c, s)",
    "p6_strict": "SELECT true AS raised, count(*) AS rows FROM orders",
    "p7_missing_values": f"{v.CTE} " + _each(v.DIRTY_ORDERS, lambda c: f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM dirty"),
    "p8_boolean": f"{_TYPED_CTE} SELECT o_orderkey, lower(flag_text) IN ('true', '1') AS flag_text, flag_number = 1 AS flag_number FROM typed",
    "p9_numeric": f"{_TYPED_CTE} SELECT o_orderkey, TRY_CAST(replace(comma_number, ',', '') AS DOUBLE) AS comma_number FROM typed",
    "p10_datetime": f"{_TYPED_CTE} SELECT o_orderkey, strftime(try_strptime(day_text, '%d/%m/%Y'), '%Y-%m-%d') AS day_text, "
                    f"strftime({v.sql_date('mixed_day')}, '%Y-%m-%d') AS mixed_day FROM typed",
    "p11_categorical_text": _types_sql(["status_text", "free_text"]),
    "p12_type_report": _types_sql(list(_TYPED)),
    "p13_column_profile": f"{v.CTE} " + _each(COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", count(*) AS rows, "
                                              f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM dirty"),
    "p14_first_values": f"{v.CTE} SELECT * FROM (" + _each(["priority_text", "phone"], lambda c: (
        f"SELECT '{c}' AS \"column\", {c} AS value, row_number() OVER (ORDER BY min(o_orderkey)) AS rank FROM dirty "
        f"WHERE {c} IS NOT NULL GROUP BY {c}")) + ") WHERE rank <= 5",
    "p15_numeric_stats": f"{v.CTE} " + _each(["customer_age", "net_price", "discount_pct"], lambda c: (
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM dirty")),
    "p16_date_range": "SELECT 'o_orderdate' AS \"column\", CAST(min(o_orderdate) AS VARCHAR) AS first, CAST(max(o_orderdate) AS VARCHAR) AS last "
                      "FROM orders UNION ALL SELECT 'ts', strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events",
    "p17_long_texts": "SELECT * FROM (SELECT text AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, text) AS rank FROM documents "
                      "WHERE text IS NOT NULL GROUP BY text) WHERE rank <= 20",
    "p17_top_values": f"{v.CTE} SELECT * FROM (" + _each(["priority_text", "phone", "email"], lambda c: (
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank "
        f"FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}")) + ") WHERE rank <= 5",
    "p18_mean_length": _each(["text", "lang", "source"], lambda c: f"SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS avg_length FROM documents"),
    "p20_appended_profile": f"{v.CTE} " + _each(_SUMMED, lambda c: (
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
        + (f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
           if c in _SUMMED_NUMBERS else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, "
                                        "CAST(NULL AS DOUBLE) AS max, ")
        + (f"strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS first, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS last, "
           if c == "period_start" else "'' AS first, '' AS last, ")
        + (f"round(avg(length({c})), 6)" if c in ("phone", "priority_text") else "CAST(NULL AS DOUBLE)")
        + " AS avg_length, true AS distinct_kept, true AS quartiles_kept FROM dirty")),
    "p19_source": _each(["o_orderstatus", "o_orderpriority"], lambda c: f"SELECT '{c}' AS \"column\", 'orders.parquet' AS source, count(*) AS rows, true AS stamped FROM orders"),
}
