"""Dirty views of the given tables, written once in SQL both engines read, and SQL helpers.

Every view covers its whole table; dirt is derived from key arithmetic, never from randomness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanloom.functions import vocab

_D = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_Y, _M, _DAY = f"substr({_D}, 1, 4)", f"substr({_D}, 6, 2)", f"substr({_D}, 9, 2)"
_C = "CAST(o_custkey AS STRING)"

# name -> expression over `orders`
DIRTY_ORDERS = {
    "o_orderkey": "o_orderkey",
    "record_id": "CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey END",
    "customer_age": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 150 - 10 END",
    "net_price": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN -o_totalprice "
                 "WHEN o_orderkey % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END",
    "amount_text": "CASE WHEN o_orderkey % 29 = 0 THEN 'Seventy' WHEN o_orderkey % 31 = 0 THEN 'seventy thousand' "
                   f"WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN '-5' ELSE {_C} END",
    "discount_pct": "(o_orderkey * 7) % 140 - 10",
    "tax_rate": "CAST(o_orderkey % 300 - 50 AS DOUBLE) / 2",
    "email": f"CASE o_orderkey % 9 WHEN 0 THEN 'user' || {_C} || '@gnail.com' WHEN 1 THEN 'user' || {_C} || '@GMAL.com' "
             f"WHEN 2 THEN 'user' || {_C} || '@yaho.com' WHEN 3 THEN 'user' || {_C} || '@hotmial.com' "
             f"WHEN 4 THEN 'user' || {_C} || '#example.com' WHEN 5 THEN NULL WHEN 6 THEN ' u' || {_C} || '@gmail.com ' "
             f"ELSE 'user' || {_C} || '@gmail.com' END",
    "phone": f"CASE o_orderkey % 5 WHEN 0 THEN '(555) 000-' || {_C} WHEN 1 THEN '+1999' || {_C} "
             f"WHEN 2 THEN '555.123.' || {_C} WHEN 3 THEN NULL ELSE '5551234' || {_C} END",
    "order_date": f"CASE o_orderkey % 6 WHEN 0 THEN {_M} || '/' || {_DAY} || '/' || {_Y} "
                  f"WHEN 1 THEN {_DAY} || '.' || {_M} || '.' || {_Y} WHEN 2 THEN {_D} WHEN 3 THEN {_D} "
                  f"WHEN 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'not_a_date' ELSE {_D} END "
                  f"ELSE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_D} END END",
    "ship_date": "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 3 AS INTEGER) AS STRING)",
    "period_start": "o_orderdate",
    "period_end": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate - INTERVAL '1' DAY "
                  "ELSE o_orderdate + INTERVAL '2' DAY END",
    "priority_text": "CASE o_orderkey % 13 WHEN 0 THEN '?' WHEN 1 THEN ' Unknown ' WHEN 2 THEN 'N/A' WHEN 3 THEN '' "
                     "WHEN 4 THEN 'nan' WHEN 5 THEN '  ' || o_orderpriority WHEN 6 THEN lower(o_orderpriority) "
                     "WHEN 7 THEN 'café ' || o_orderpriority WHEN 8 THEN NULL WHEN 9 THEN 'a#b@' || o_orderpriority "
                     "ELSE o_orderpriority END",
}
CTE = "WITH dirty AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIRTY_ORDERS.items()) + " FROM orders)"

# Rows with copies for the duplicate operators: about a third of all rows share one identifier.
SKEWED = {
    "o_orderkey": "o_orderkey",
    "hot_id": "CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_orderkey % 1000 END",
    "note": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END",
    "grade": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END",
}
SKEWED_CTE = "WITH skewed AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SKEWED.items()) + " FROM orders)"
COPY_COLUMNS = ("o_custkey", "o_orderstatus", "o_orderpriority")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The JVM never compiles a method over 8000 bytes: let Spark split wide fused aggregates instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark, sf_dir, *columns: str) -> DataFrame:
    wanted = columns or DIRTY_ORDERS
    return table(spark, sf_dir, "orders").selectExpr(*[f"{DIRTY_ORDERS[c]} AS {c}" for c in wanted])


def skewed_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in SKEWED.items()])


# ---------------------------------------------------------------- SQL helpers
def sql_strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_number(column: str) -> str:
    """A number written as text, else null."""
    pattern = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return f"(CASE WHEN regexp_matches({column}, '{pattern}') THEN TRY_CAST(trim({column}) AS DOUBLE) END)"


def sql_date(column: str) -> str:
    formats = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y.%m.%d", "%d.%m.%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y")
    return "coalesce(" + ", ".join(f"try_strptime({column}, '{f}')" for f in formats) + ")"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '{vocab.OUTER_SPACES_PATTERN}', '', 'g')"


def sql_proxy(column: str) -> str:
    return f"lower({sql_strip(column)}) IN ({sql_strings(vocab.PROXY_TOKENS)})"


def sql_empty(column: str) -> str:
    return f"({column} IS NULL OR {sql_strip(column)} IN ({sql_strings(vocab.EMPTY_TOKENS)}))"


def sql_typo(column: str) -> str:
    return f"regexp_matches(lower({column}), '{'|'.join(t.replace('.', '[.]') for t in vocab.EMAIL_TYPOS)}')"


def sql_domains(column: str) -> str:
    """The column with mistyped mail domains corrected."""
    for typo, domain in vocab.EMAIL_TYPOS.items():
        column = f"regexp_replace({column}, '(?i){typo.replace('.', '[.]')}', '{domain}', 'g')"
    return column


def sql_email_ok(column: str) -> str:
    return f"regexp_matches({column}, '{vocab.EMAIL_PATTERN}')"
