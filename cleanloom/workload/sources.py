"""Queries of the readers, writers and streams; every file is derived from a given table by Spark."""

from __future__ import annotations

import io
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.plans.plan import LogEntry, log_frame
from cleanloom.session import scratch_path
from cleanloom.sources.auto import read_auto
from cleanloom.sources.csv import read_csv
from cleanloom.sources.excel import read_excel
from cleanloom.sources.json import read_json
from cleanloom.sources.sinks import write_cleaned, write_log
from cleanloom.streaming.cleaning import clean_stream, flag_stream, stream_context, write_stream
from cleanloom.workload import views as v

KEY = "o_orderkey"
CSV_COLUMNS = (KEY, "customer_age", "net_price", "amount_text", "email", "priority_text")
BOOK_ROWS = 5000


def _csv(spark, sf_dir, name):
    path = scratch_path(spark, name) + ".csv"
    v.dirty_orders(spark, sf_dir, *CSV_COLUMNS).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def s1_csv(spark, sf_dir):
    return read_csv(spark, _csv(spark, sf_dir, "csv"))


# ---------------------------------------------------------------- workbooks
def _sheet_xml(pdf: pd.DataFrame) -> str:
    def cell(value):
        if value is None or pd.isna(value):
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>" if isinstance(value, float) else f"<c><v>{int(value)}</v></c>"

    lines = ["".join(cell(c) for c in pdf.columns)] + ["".join(map(cell, row)) for row in pdf.itertuples(index=False)]
    rows = "".join(f'<row r="{i}">{line}</row>' for i, line in enumerate(lines, start=1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'


def workbook_bytes(pdf: pd.DataFrame) -> bytes:
    """A minimal .xlsx file with one sheet."""
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                           f'xmlns:r="{relation}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      f'<Relationship Id="rId1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": _sheet_xml(pdf),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def workbooks(df, key: str):
    """Rows of a table packed into workbooks of at most ``BOOK_ROWS`` keys each: (path, content)."""
    names = [c for c in df.columns]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        book = int(pdf["book"].iloc[0])
        rows = pdf[names].sort_values(key).astype(object)
        return pd.DataFrame({"path": [f"book-{book}.xlsx"], "content": [workbook_bytes(rows)]})

    return (df.withColumn("book", F.floor(F.col(key) / BOOK_ROWS)).groupBy("book")
            .applyInPandas(pack, "path string, content binary"))


def written_workbooks(df, key: str) -> str:
    """The workbooks as .xlsx files in a shared folder; tasks write them."""
    folder = scratch_path(df.sparkSession, "books")

    def write(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with system.open_output_stream(f"{base}/{path}", compression=None) as file:
                    file.write(content)
            yield pdf[["path"]]

    workbooks(df, key).mapInPandas(write, "path string").count()
    return folder


def s2_excel(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select(KEY, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return read_excel(spark, written_workbooks(orders, KEY), sheet="Data")


# ---------------------------------------------------------------- JSON
def _documents(spark, sf_dir, name):
    """Orders as JSON documents, each an array of at most ``BOOK_ROWS`` records."""
    path = scratch_path(spark, name)
    record = F.to_json(F.struct(KEY, "o_custkey", "o_orderstatus", "o_totalprice"))
    (v.table(spark, sf_dir, "orders").withColumn("doc", F.floor(F.col(KEY) / BOOK_ROWS)).groupBy("doc")
     .agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
     .write.partitionBy("doc").text(path))
    return path


def s3_json_document(spark, sf_dir):
    return read_json(spark, _documents(spark, sf_dir, "documents")).select(KEY, "o_custkey", "o_orderstatus", "o_totalprice")


def _nested(spark, sf_dir):
    return v.table(spark, sf_dir, "orders").select(
        KEY, F.struct("o_custkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("state")).alias("order"))


def s4_json_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    v.table(spark, sf_dir, "orders").select(KEY, "o_custkey", "o_orderstatus", "o_totalprice").write.json(path)
    return read_json(spark, path)


def s5_flatten(spark, sf_dir):
    path = scratch_path(spark, "nested")
    _nested(spark, sf_dir).write.json(path)
    df = read_json(spark, path)
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns])


def s6_auto(spark, sf_dir):
    """Four formats through extension dispatch: rows and key sum."""
    base = scratch_path(spark, "auto")
    orders = v.table(spark, sf_dir, "orders").select(KEY, "o_orderstatus")
    orders.write.option("header", True).csv(f"{base}.csv")
    orders.write.json(f"{base}.json")
    orders.write.parquet(f"{base}/data")
    frames = [(kind, read_auto(spark, path)) for kind, path in
              (("csv", f"{base}.csv"), ("json", f"{base}.json/*"), ("parquet", f"{base}/data"), ("xlsx", written_workbooks(orders, KEY)))]
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.sum(KEY).alias("key_sum")).select(F.lit(kind).alias("format"), "rows", "key_sum")
             for kind, df in frames]
    return reduce(DataFrame.unionByName, parts)


def s7_missing_file(spark, sf_dir):
    """Per given table its rows, and whether a file of that name that is not there raises."""
    rows = []
    for name in TABLES:
        raised = 0
        for ending in ("csv", "json", "parquet", "xlsx"):
            try:
                read_auto(spark, f"{sf_dir}/missing-{name}.{ending}")
            except AnalysisException:
                raised += 1
        rows.append(v.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source"), "rows", F.lit(raised).cast("long").alias("raised")))
    return reduce(DataFrame.unionByName, rows)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def s8_empty_tables(spark, sf_dir):
    """Per given table, whether it is empty, and whether it is after a filter that leaves nothing."""
    rows = []
    for name in TABLES:
        df = v.table(spark, sf_dir, name)
        key = df.columns[0]
        rows.append((name, df.isEmpty(), df.filter(F.col(key).isNull()).isEmpty()))
    return spark.createDataFrame(rows, "source string, is_empty boolean, keys_complete boolean")


def s9_write_cleaned(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, KEY, "customer_age", "email", "priority_text").withColumn("Outlier", F.lit(1))
    path = write_cleaned(df, scratch_path(spark, "cleaned") + ".csv")
    return read_csv(spark, path)


def s10_write_log(spark, sf_dir):
    """The log of one step per null column, written and read back."""
    df = v.dirty_orders(spark, sf_dir)
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns]).first().asDict()
    log = [LogEntry(i, c, "FIX_DROP_ROWS", "drop rows without a value", None, n, "") for i, (c, n) in enumerate(nulls.items()) if n]
    path = write_log(log_frame(spark, log), scratch_path(spark, "log") + ".csv")
    return read_csv(spark, path).select("column", "fix_id", "rows_removed")


# ---------------------------------------------------------------- streams
def _stream(spark, sf_dir, *columns):
    static = v.table(spark, sf_dir, "orders")
    raw = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/orders.parquet*")
    return raw.selectExpr(*[f"{v.DIRTY_ORDERS[c]} AS {c}" for c in columns])


def _finished(spark, stream, name):
    out = scratch_path(spark, name)
    query = write_stream(stream, out, scratch_path(spark, f"{name}-progress"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def st1_clean_stream(spark, sf_dir):
    stream = clean_stream(_stream(spark, sf_dir, KEY, "email", "phone", "discount_pct", "order_date", "customer_age"), [
        ("FIX_STRIP_WHITESPACE", "email", {}), ("FIX_EMAIL_TYPOS", "email", {}), ("FIX_STANDARDIZE_PHONE", "phone", {}),
        ("FIX_CLIP_PERCENTAGE", "discount_pct", {}), ("FIX_STANDARDIZE_DATE_FORMAT", "order_date", {}),
        ("FIX_DROP_IMPOSSIBLE_AGE_ROWS", "customer_age", {}), ("FIX_MEDIAN_IMPUTE", "customer_age", {"median_value": 40})])
    return _finished(spark, stream, "stream-clean")


def st2_flag_stream(spark, sf_dir):
    stream = _stream(spark, sf_dir, KEY, "order_date")
    ctx = stream_context(stream, date=["order_date"])
    return _finished(spark, flag_stream(stream, "INVALID_DATE_FORMAT", "order_date", [KEY], ctx), "stream-flag")


def s4_broken_records(spark, sf_dir):
    """Orders as files with some records broken: a cut line, a second value on a line, a cell too many. Rows of the whole files, whether counting the
    broken ones is refused, and whether reading one column of them is."""
    orders = v.table(spark, sf_dir, "orders").select(KEY, "o_custkey", "o_orderstatus")
    line, hit = F.to_json(F.struct(*orders.columns)), F.col(KEY) % 97 == 0
    cells = F.concat_ws(",", *orders.columns)
    header = ",".join(orders.columns)
    rows = []
    for name, whole, broken in (("cut line", line, F.expr("left(whole, length(whole) - 1)")), ("two values", line, F.concat("whole", F.lit(" "), "whole")),
                                ("a cell too many", cells, F.concat("whole", F.lit(",x")))):
        read, counted, refused = (read_csv if whole is cells else read_json), 0, []
        for damaged in (False, True):
            path = scratch_path(spark, "records") + (".csv" if whole is cells else ".json")
            texts = orders.select(whole.alias("whole"), hit.alias("hit")).select((F.when(F.col("hit"), broken).otherwise(F.col("whole")) if damaged else F.col("whole")).alias("value"))
            if whole is cells:  # every part has the header
                texts = texts.mapInPandas(lambda batches: _with_header(batches, header), "value string")
            texts.write.text(path)
            df = read(spark, path, **({"infer": False} if whole is cells else {"lines": True}))
            if not damaged:
                counted = df.count()
                continue
            for asked in (df.agg(F.count(F.lit(1)).alias("n")), df.agg(F.count("o_custkey").alias("n"))):
                try:
                    asked.collect()
                    refused.append(False)
                except SparkRuntimeException:
                    refused.append(True)
        rows.append((name, counted, *refused))
    return spark.createDataFrame(rows, "broken string, rows long, count_refused boolean, column_refused boolean")


def _with_header(batches, header):
    yield pd.DataFrame({"value": [header]})
    yield from batches


QUERIES = {
    "s1_csv": s1_csv, "s2_excel": s2_excel, "s3_json_document": s3_json_document, "s4_json_lines": s4_json_lines, "s4_broken_records": s4_broken_records,
    "s5_flatten": s5_flatten, "s6_auto": s6_auto, "s7_missing_file": s7_missing_file, "s8_empty_tables": s8_empty_tables, "s9_write_cleaned": s9_write_cleaned,
    "s10_write_log": s10_write_log, "st1_clean_stream": st1_clean_stream, "st2_flag_stream": st2_flag_stream,
}


def _read_back(*columns):
    texts = ("amount_text", "email", "priority_text")
    parts = [f"CASE WHEN {c} NOT IN ({v.sql_strings(v.vocab.CSV_NULL_TOKENS)}) THEN {c} END AS {c}" if c in texts else c for c in columns]
    return f"{v.CTE} SELECT {', '.join(parts)} FROM dirty"


SQL = {
    "s1_csv": _read_back(*CSV_COLUMNS),
    "s2_excel": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "s3_json_document": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "s4_json_lines": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "s4_broken_records": "SELECT b AS broken, count(*) AS rows, count(*) FILTER (o_orderkey % 97 = 0) > 0 AS count_refused, "
                         "count(*) FILTER (o_orderkey % 97 = 0) > 0 AS column_refused FROM orders, "
                         "(VALUES ('cut line'), ('two values'), ('a cell too many')) t(b) GROUP BY b",
    "s5_flatten": "SELECT o_orderkey, o_custkey AS order_o_custkey, o_orderstatus AS order_state_status, o_totalprice AS order_state_price FROM orders",
    "s6_auto": "SELECT f AS format, (SELECT count(*) FROM orders) AS rows, (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders) AS key_sum "
               "FROM (VALUES ('csv'), ('json'), ('parquet'), ('xlsx')) t(f)",
    "s7_missing_file": " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS rows, CAST(4 AS BIGINT) AS raised FROM {t}" for t in TABLES),
    "s8_empty_tables": " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) = 0 AS is_empty, true AS keys_complete FROM {t}" for t in TABLES),
    "s9_write_cleaned": _read_back(KEY, "customer_age", "email", "priority_text"),
    "s10_write_log": f"{v.CTE} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'FIX_DROP_ROWS' AS fix_id, count(*) - count({c}) AS rows_removed FROM dirty" for c in v.DIRTY_ORDERS)
        + ") WHERE rows_removed > 0",
    "st1_clean_stream": f"{v.CTE} SELECT o_orderkey, {v.sql_domains(v.sql_strip('email'))} AS email, regexp_replace(phone, '[^0-9]', '', 'g') AS phone, "
                        f"greatest(0, least(100, discount_pct)) AS discount_pct, coalesce(strftime({v.sql_date('order_date')}, '%Y-%m-%d'), order_date) "
                        "AS order_date, coalesce(customer_age, 40) AS customer_age FROM dirty WHERE customer_age IS NULL OR customer_age BETWEEN 0 AND 120",
    "st2_flag_stream": f"{v.CTE} SELECT o_orderkey, order_date AS value FROM dirty WHERE order_date IS NOT NULL AND {v.sql_date('order_date')} IS NULL",
}
