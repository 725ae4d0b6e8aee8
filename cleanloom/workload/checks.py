"""Queries of the issue checks: flagged rows per check, all checks at once, roles and examples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cleanloom.functions.columns import is_lower, is_upper, kinds, ref
from cleanloom.functions.stats import count_if
from cleanloom.operators import checks
from cleanloom.operators.roles import Roles, detect_roles, roles_frame
from cleanloom.workload import views as v

AS_OF = dt.datetime(2000, 1, 1)
KEY = "o_orderkey"

# Row-level checks: query -> (issue, column, SQL predicate).
FLAGGED = {
    "d1_missing": ("MISSING_VAL", "net_price", "net_price IS NULL"),
    "d2_proxy_missing": ("PROXY_MISSING", "priority_text", v.sql_proxy("priority_text")),
    "d3_empty_text": ("EMPTY_TEXT", "priority_text", v.sql_empty("priority_text")),
    "d4_negative_age": ("NEG_AGE", "customer_age", "customer_age < 0"),
    "d5_range_exceeded": ("RANGE_EXCEEDED", "discount_pct", "discount_pct > 100"),
    "d6_impossible_age": ("IMPOSSIBLE_AGE", "customer_age", "customer_age < 0 OR customer_age > 120"),
    "d7_invalid_monetary": ("INVALID_MONETARY", "net_price", "net_price <= 0"),
    "d8_future_date": ("FUTURE_DATE", "order_date", f"{v.sql_date('order_date')} > TIMESTAMP '2000-01-01'"),
    "d9_invalid_date": ("INVALID_DATE_FORMAT", "order_date",
                        f"order_date IS NOT NULL AND {v.sql_date('order_date')} IS NULL"),
    "d13_whitespace": ("WHITESPACE", "priority_text",
                       f"regexp_matches(priority_text, '{v.vocab.EDGE_SPACE_PATTERN}')"),
    "d14_special_chars": ("SPECIAL_CHARS", "priority_text", "regexp_matches(priority_text, '[?!#$%^&*]')"),
    "d16_word_as_number": ("WORD_AS_NUMBER", "amount_text", "regexp_matches(amount_text, '[a-zA-Z]')"),
    "d20_email": ("EMAIL_FORMAT_ISSUE", "email", f"NOT {v.sql_email_ok('email')} OR {v.sql_typo('email')}"),
    "d21_phone": ("PHONE_FORMAT_ISSUE", "phone", "regexp_matches(phone, '[-.() +]')"),
    "d22_percent": ("PERCENT_VIOLATION", "discount_pct", "discount_pct < 0 OR discount_pct > 100"),
}


def _declared(df) -> checks.Context:
    """Roles by declaration: a single-check query needs no detection pass."""
    return checks.Context(Roles(
        kinds=kinds(df), date=tuple(c for c in ("order_date", "ship_date") if c in df.columns),
        numeric=tuple(c for c in df.columns if c in ("customer_age", "amount_text")),
        money=tuple(c for c in ("net_price", "amount_text") if c in df.columns),
        age=tuple(c for c in ("customer_age",) if c in df.columns)), as_of=AS_OF)


def _flag(issue_id, column):
    def query(spark, sf_dir):
        df = v.dirty_orders(spark, sf_dir, KEY, column)
        return checks.flag(df, issue_id, column, [KEY], _declared(df))
    return query


def _sql_flag(column, predicate):
    return f"{v.CTE} SELECT o_orderkey, {column} AS value FROM dirty WHERE {predicate}"


QUERIES = {name: _flag(issue, column) for name, (issue, column, _) in FLAGGED.items()}
SQL = {name: _sql_flag(column, predicate) for name, (_, column, predicate) in FLAGGED.items()}


def d10_mixed_dates(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, "order_date", "ship_date")
    rows = []
    for c in df.columns:
        found = checks.separators(ref(c))
        rows.append(F.struct(F.lit(c).alias("column"), found["/"].alias("slash"), found["-"].alias("dash"),
                             found["."].alias("dot"), F.count(ref(c)).alias("present")))
    used = sum((F.when(F.col(m) > 0, 1).otherwise(0) for m in ("slash", "dash", "dot")), F.lit(0))
    return (df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
            .withColumn("mixed", (F.col("present") >= 2) & (used > 1)))


def _sql_d10():
    parts = [f"SELECT '{c}' AS \"column\", {c} AS x FROM dirty" for c in ("order_date", "ship_date")]
    return (f"{v.CTE}, long AS ({' UNION ALL '.join(parts)}), n AS (SELECT \"column\", "
            "count(*) FILTER (contains(x, '/')) AS slash, count(*) FILTER (contains(x, '-')) AS dash, "
            "count(*) FILTER (contains(x, '.')) AS dot, count(x) AS present FROM long GROUP BY 1) "
            "SELECT *, present >= 2 AND (CAST(slash > 0 AS INT) + CAST(dash > 0 AS INT) + CAST(dot > 0 AS INT)) > 1 AS mixed FROM n")


def d11_ship_before_order(spark, sf_dir):
    """Lines shipped before their order date: the pair check over a joined table."""
    lines = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                      F.col("l_shipdate").alias("ship_date"))
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("order_date"))
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    late = checks.out_of_sequence(kinds(df), "order_date", "ship_date")
    return df.groupBy("l_orderkey").agg(count_if(late).alias("violations")).filter("violations > 0")


def d12_sequence_error(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, KEY, "period_start", "period_end")
    _, start, end = checks.sequence_pairs(df.columns)[0]
    return df.filter(checks.out_of_sequence(kinds(df), start, end)).select(
        KEY, F.col(start).cast("string").alias("started"), F.col(end).cast("string").alias("ended"))


def d15_encoding_junk(spark, sf_dir):
    df = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return checks.flag(df, "ENCODING_JUNK", "text", ["doc_id"], _declared(df)).select(
        "doc_id", F.length("value").cast("long").alias("chars"))


def d17_case_divergence(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, "priority_text")
    c = ref("priority_text")
    return df.agg(count_if(is_upper(c)).alias("upper"), count_if(is_lower(c)).alias("lower")).withColumn(
        "diverges", (F.col("upper") > 0) & (F.col("lower") > 0))


def d18_id_clash(spark, sf_dir):
    return checks.later_duplicates(v.skewed_orders(spark, sf_dir), "hot_id", [KEY]).select(KEY, "hot_id")


def d19_z_outlier(spark, sf_dir):
    df = v.table(spark, sf_dir, "events").select("event_id", "value")
    ctx = checks.context(df, {"identity": [], "date": []})
    return checks.flag(df, "Z_OUTLIER", "value", ["event_id"], ctx)


def d23_roles(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir).drop(KEY)
    return roles_frame(spark, detect_roles(df))


def d24_all_checks(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir).drop(KEY)
    found = checks.detect_issues(df, as_of=AS_OF)
    return checks.issues_frame(spark, found).select("issue_id", "column", "severity", "n_violations")


def d25_examples(spark, sf_dir):
    """The first violating values of every issue that shows examples."""
    found = checks.detect_issues(v.dirty_orders(spark, sf_dir), order_by=[KEY], as_of=AS_OF, duplicates=False)
    return checks.issues_frame(spark, found).select("issue_id", "column", F.posexplode("examples").alias("place", "value"))


QUERIES |= {
    "d10_mixed_dates": d10_mixed_dates, "d11_ship_before_order": d11_ship_before_order,
    "d12_sequence_error": d12_sequence_error, "d15_encoding_junk": d15_encoding_junk,
    "d17_case_divergence": d17_case_divergence, "d18_id_clash": d18_id_clash, "d19_z_outlier": d19_z_outlier,
    "d23_roles": d23_roles, "d24_all_checks": d24_all_checks, "d25_examples": d25_examples,
}

_UPPER = "priority_text = upper(priority_text) AND priority_text <> lower(priority_text)"
_LOWER = "priority_text = lower(priority_text) AND priority_text <> upper(priority_text)"
_Z = "abs((x - avg(x) OVER ()) / stddev_samp(x) OVER ()) > 3"


def _sql_roles():
    parts = []
    for c in ("order_date", "ship_date"):
        parts.append(f"SELECT '{c}' AS \"column\", 'date' AS \"role\" FROM dirty HAVING "
                     f"count({v.sql_date(c)}) > 0.3 * count({c})")
    for c in ("customer_age", "net_price", "discount_pct", "tax_rate", "record_id"):
        parts.append(f"SELECT '{c}', 'numeric' FROM dirty HAVING count({c}) > 0")
    parts.append(f"SELECT 'amount_text', 'numeric' FROM dirty HAVING count({v.sql_number('amount_text')}) >= 0.3 * count(*)")
    parts.append("SELECT 'record_id', 'identity' FROM dirty HAVING count(record_id) = count(*) "
                 "AND (max(record_id) - min(record_id)) / (count(DISTINCT record_id) - 1) <= 2")
    parts += [f"SELECT '{c}', 'money' FROM dirty HAVING count(*) > 0" for c in ("net_price", "amount_text")]
    parts.append("SELECT 'customer_age', 'age' FROM dirty HAVING count(*) > 0")
    return f"{v.CTE} " + " UNION ALL ".join(parts)


def _sql_all():
    """One counter per check and column that applies, written out."""
    found = []

    def add(issue, column, severity, predicate):
        found.append(f"SELECT '{issue}' AS issue_id, '{column}' AS \"column\", '{severity}' AS severity, "
                     f"count(*) AS n_violations FROM dirty WHERE {predicate}")
    texts = ("amount_text", "email", "phone", "priority_text")
    add("EMAIL_FORMAT_ISSUE", "email", "Medium", FLAGGED["d20_email"][2])
    add("DATE_SEQUENCE_VIOLATION", "order_date -> ship_date", "High", f"{v.sql_date('ship_date')} < {v.sql_date('order_date')}")
    for c in list(v.DIRTY_ORDERS)[1:]:
        add("MISSING_VAL", c, "High", f"{c} IS NULL")
    for c in texts:
        add("PROXY_MISSING", c, "Medium", v.sql_proxy(c))
        add("EMPTY_TEXT", c, "Medium", v.sql_empty(c))
    add("NEG_AGE", "customer_age", "High", "customer_age < 0")
    add("RANGE_EXCEEDED", "discount_pct", "High", "discount_pct > 100")
    add("IMPOSSIBLE_AGE", "customer_age", "High", "customer_age < 0 OR customer_age > 120")
    add("INVALID_MONETARY", "net_price", "High", "net_price <= 0")
    add("INVALID_MONETARY", "amount_text", "High", f"{v.sql_number('amount_text')} <= 0")
    for c in ("order_date", "ship_date"):
        add("FUTURE_DATE", c, "Medium", f"{v.sql_date(c)} > TIMESTAMP '2000-01-01'")
        add("INVALID_DATE_FORMAT", c, "High", f"{c} IS NOT NULL AND {v.sql_date(c)} IS NULL")
    found.append("SELECT 'DATE_FORMAT_MIXED', 'order_date', 'High', count(order_date) FROM dirty")
    add("SEQ_ERROR", "period_start/period_end", "High", "period_end < period_start")
    for c in (*texts, "order_date", "ship_date"):
        add("WHITESPACE", c, "Low", f"regexp_matches({c}, '{v.vocab.EDGE_SPACE_PATTERN}')")
        add("ENCODING_JUNK", c, "Medium", rf"regexp_matches({c}, '[^\x00-\x7F]')")
    for c in ("amount_text", "priority_text"):
        add("SPECIAL_CHARS", c, "Medium", f"regexp_matches({c}, '[?!#$%^&*]')")
    add("WORD_AS_NUMBER", "amount_text", "High", "regexp_matches(amount_text, '[a-zA-Z]')")
    add("CASE_DIVERGE", "priority_text", "Low", f"({_UPPER}) OR ({_LOWER})")
    found.append("SELECT 'ID_CLASH', 'record_id', 'High', count(*) - count(DISTINCT record_id) FROM dirty")
    for c in ("net_price", "discount_pct", "tax_rate"):
        found.append(f"SELECT 'Z_OUTLIER', '{c}', 'Medium', count(*) FILTER (z) FROM (SELECT {_Z.replace('x', c, 1).replace('avg(x)', f'avg({c})').replace('samp(x)', f'samp({c})')} AS z FROM dirty)")
    add("PHONE_FORMAT_ISSUE", "phone", "Low", "regexp_matches(phone, '[-.() +]')")
    for c in ("discount_pct", "tax_rate"):
        add("PERCENT_VIOLATION", c, "High", f"{c} < 0 OR {c} > 100")
    columns = ", ".join(list(v.DIRTY_ORDERS)[1:])
    found.append("SELECT 'DUPLICATE_ROWS', '*', 'Medium', (SELECT count(*) FROM dirty) - "
                 f"(SELECT count(*) FROM (SELECT DISTINCT {columns} FROM dirty))")
    return f"{v.CTE} SELECT * FROM (" + " UNION ALL ".join(found) + ") WHERE n_violations > 0"


def _sql_examples():
    """First values by key: three of each issue, one of future dates, six of mixed formats, none of missing or edge spaces."""
    parts = []
    for issue, column, value, limit, predicate in _EXAMPLES:
        parts.append(f"SELECT issue_id, \"column\", CAST(place AS INTEGER) AS place, value FROM (SELECT '{issue}' AS issue_id, '{column}' AS \"column\", "
                     f"row_number() OVER (ORDER BY o_orderkey) - 1 AS place, {value} AS value FROM dirty WHERE {predicate}) WHERE place < {limit}")
    return f"{v.CTE} " + " UNION ALL ".join(parts)


def _z(c):
    return (f"abs(({c} - (SELECT avg({c}) FROM dirty)) / (SELECT stddev_samp({c}) FROM dirty)) > 3")


_EXAMPLES = [
    ("EMAIL_FORMAT_ISSUE", "email", "email", 3, FLAGGED["d20_email"][2]),
    ("DATE_SEQUENCE_VIOLATION", "order_date -> ship_date", "order_date || ' -> ' || ship_date", 3,
     f"{v.sql_date('ship_date')} < {v.sql_date('order_date')}"),
    *[("PROXY_MISSING", c, c, 3, v.sql_proxy(c)) for c in ("amount_text", "email", "phone", "priority_text")],
    ("NEG_AGE", "customer_age", "CAST(customer_age AS VARCHAR)", 3, "customer_age < 0"),
    ("RANGE_EXCEEDED", "discount_pct", "CAST(discount_pct AS VARCHAR)", 3, "discount_pct > 100"),
    ("IMPOSSIBLE_AGE", "customer_age", "CAST(customer_age AS VARCHAR)", 3, "customer_age < 0 OR customer_age > 120"),
    ("INVALID_MONETARY", "net_price", "CAST(net_price AS VARCHAR)", 3, "net_price <= 0"),
    ("INVALID_MONETARY", "amount_text", "amount_text", 3, f"{v.sql_number('amount_text')} <= 0"),
    *[("FUTURE_DATE", c, c, 1, f"{v.sql_date(c)} > TIMESTAMP '2000-01-01'") for c in ("order_date", "ship_date")],
    *[("INVALID_DATE_FORMAT", c, c, 3, f"{c} IS NOT NULL AND {v.sql_date(c)} IS NULL") for c in ("order_date", "ship_date")],
    ("DATE_FORMAT_MIXED", "order_date", "order_date", 6, "order_date IS NOT NULL"),
    *[("SPECIAL_CHARS", c, c, 3, f"regexp_matches({c}, '[?!#$%^&*]')") for c in ("amount_text", "priority_text")],
    ("WORD_AS_NUMBER", "amount_text", "amount_text", 3, "regexp_matches(amount_text, '[a-zA-Z]')"),
    *[("Z_OUTLIER", c, f"CAST({c} AS VARCHAR)", 3, _z(c)) for c in ("net_price", "discount_pct", "tax_rate")],
    ("PHONE_FORMAT_ISSUE", "phone", "phone", 3, "regexp_matches(phone, '[-.() +]')"),
    *[("PERCENT_VIOLATION", c, f"CAST({c} AS VARCHAR)", 3, f"{c} < 0 OR {c} > 100") for c in ("discount_pct", "tax_rate")],
]

SQL |= {
    "d10_mixed_dates": _sql_d10(),
    "d11_ship_before_order": "SELECT l_orderkey, count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
                             "WHERE l_shipdate < o_orderdate GROUP BY 1",
    "d12_sequence_error": f"{v.CTE} SELECT o_orderkey, CAST(period_start AS VARCHAR) AS started, "
                          "CAST(period_end AS VARCHAR) AS ended FROM dirty WHERE period_end < period_start",
    "d15_encoding_junk": r"SELECT doc_id, length(text) AS chars FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]')",
    "d17_case_divergence": f"{v.CTE} SELECT *, upper > 0 AND lower > 0 AS diverges FROM (SELECT count(*) FILTER ({_UPPER}) AS upper, "
                           f"count(*) FILTER ({_LOWER}) AS lower FROM dirty)",
    "d18_id_clash": f"{v.SKEWED_CTE} SELECT o_orderkey, hot_id FROM (SELECT *, row_number() OVER "
                    "(PARTITION BY hot_id ORDER BY o_orderkey) AS r FROM skewed) WHERE r > 1",
    "d19_z_outlier": f"SELECT event_id, value FROM (SELECT event_id, x AS value, {_Z} AS z "
                     "FROM (SELECT event_id, value AS x FROM events)) WHERE z",
    "d23_roles": _sql_roles(),
    "d24_all_checks": _sql_all(),
    "d25_examples": _sql_examples(),
}
