"""Small helpers shared by the operators: safe column names, scratch tables, text reading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanloom.session import release, scratch_path  # noqa: F401  (operators take both from here)

#: ASCII white space between words, and the words, as Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SEGMENT = 4096  # numbers of a table that travel in one row


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(ref(name), F.lit(""))


def gathered(df: DataFrame, index: str, value: str, size: int) -> np.ndarray:
    """A numeric table of a fixed size on the driver: position and value of its rows, the rest zero.

    It comes in parts of ``SEGMENT`` numbers each, one row a part.
    """
    def pack(key, pdf):
        part = np.zeros(SEGMENT, np.int64)
        part[pdf[index].to_numpy(np.int64) % SEGMENT] = pdf[value].to_numpy(np.int64)
        return pd.DataFrame({"segment": [key[0]], "numbers": [part.tobytes()]})

    parts = (df.select(F.expr(f"{index} div {SEGMENT}").alias("segment"), index, value).groupBy("segment")
             .applyInPandas(pack, "segment long, numbers binary").collect())
    return joined(parts, size)


def joined(parts, size: int) -> np.ndarray:
    """The table of rows (segment, numbers)."""
    table = np.zeros(-(-size // SEGMENT) * SEGMENT, np.int64)
    for row in parts:
        table[row["segment"] * SEGMENT:(row["segment"] + 1) * SEGMENT] = np.frombuffer(row["numbers"], np.int64)
    return table[:size]


def keep_rows(docs: DataFrame, keys: dict[str, Column], kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are listed in ``kept``, one of those that share them, with all columns.

    ``kept`` has a column for each key, of the same name. The window and the join deal rows by the same
    columns, so texts are shuffled once. Nulls match nulls.
    """
    names, told = [], []
    for name, value in keys.items():
        names += [f"__null_{name}", f"__{name}"]
        kind = kept.schema[name].dataType.simpleString()
        blank = F.lit("" if kind == "string" else 0).cast(kind)
        docs = docs.withColumn(names[-2], value.isNull()).withColumn(names[-1], F.coalesce(value, blank))
        told += [F.col(name).isNull().alias(names[-2]), F.coalesce(F.col(name), blank).alias(names[-1])]
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1)))
    one = docs.withColumn("__nth", nth).filter("__nth = 1")
    return one.join(kept.select(*told).distinct(), names, "left_semi").drop("__nth", *names)
