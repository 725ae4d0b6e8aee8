"""JSON source: documents holding an array of records, or one record per line; nested fields flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.columns import ref
from cleanloom.sources.csv import ROW_KEY, row_key
from cleanloom.sources.records import is_one_value, refuse


def is_json_lines(spark: SparkSession, path) -> bool:
    """Whether the first non-blank line is a complete record; it is judged where it is read, and one boolean comes back."""
    line = F.ltrim(F.regexp_replace("value", "^\ufeff", ""))
    record = line.startswith("{") & F.try_parse_json(line).isNotNull()
    found = spark.read.text(path).filter(F.trim("value") != "").select(record.alias("record")).first()
    return found is None or found["record"]


def read_json(spark: SparkSession, path, lines: bool | None = None, flatten: bool = True,
              schema: T.StructType | None = None, keyed: bool = False) -> DataFrame:
    """Read JSON. JSON Lines files are split across tasks; a document is one task per file.

    ``keyed`` adds the place of each row in the source. A line that is not one whole record, and a document that is not one whole
    value, fail the read.
    """
    lines = is_json_lines(spark, path) if lines is None else lines
    if schema is None:
        found = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != "_corrupt_record"])
        if found.fields and not schema.fields:
            raise ValueError(f"not readable as JSON: {path}")
    raw = spark.read.text(path, wholetext=not lines)
    text = F.btrim(F.regexp_replace("value", "^\ufeff", ""), F.lit(" \t\r\n"))
    raw = raw.select(text.alias("text"), *row_key(raw)).filter("text <> ''")
    one = is_one_value(F.col("text"))
    if lines:
        whole = refuse(raw, ~(one & F.col("text").startswith("{")), "a line is not one JSON record", F.col("text"))
        records = whole.withColumn("record", F.from_json("text", schema))
    else:
        whole = refuse(raw, ~one, "a document is not one JSON value", F.col("text"))
        many = F.col("text").startswith("[")
        found = F.when(many, F.from_json(F.when(many, F.col("text")), T.ArrayType(schema))).otherwise(F.array(F.from_json(F.when(~many, F.col("text")), schema)))
        records = whole.withColumn("record", F.explode(found)).withColumn(ROW_KEY[2], F.monotonically_increasing_id())
    key = [F.col(k) for k in ROW_KEY] if keyed else []
    df = records.select(*[F.col("record").getField(f.name).alias(f.name) for f in schema.fields], *key)
    return flatten_structs(df.select(*[ref(f.name) for f in schema.fields], *key), ROW_KEY if keyed else ()) if flatten else df


def _leaves(column: Column, name: str, dtype: T.DataType) -> list[Column]:
    if isinstance(dtype, T.StructType):
        return [leaf for f in dtype.fields for leaf in _leaves(column.getField(f.name), f"{name}.{f.name}", f.dataType)]
    return [column.alias(name)]


def flatten_structs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested structs become ``parent.child`` columns; arrays stay arrays, and the columns ``keep`` stay last."""
    return df.select(*[leaf for f in df.schema.fields if f.name not in keep for leaf in _leaves(ref(f.name), f.name, f.dataType)], *map(ref, keep))
