"""Choose the reader by file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions.columns import ref
from cleanloom.session import scratch_path
from cleanloom.sources.csv import ROW_KEY, read_csv, row_key
from cleanloom.sources.excel import read_excel
from cleanloom.sources.json import read_json

FORMATS = (".csv", ".xls", ".xlsx", ".json", ".jsonl", ".parquet")
PACKED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")


def _ending(name: str) -> str:
    name = name.lower()
    for packed in PACKED:
        if name.endswith(packed) and name.removesuffix(packed).endswith(FORMATS):
            name = name.removesuffix(packed)
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def extension(spark: SparkSession, path: str) -> str:
    """Lower-case extension of a file, or of the first data file that a folder or a glob leads to."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waiting = list(system.globStatus(place) or [])
    while waiting:
        status = waiting.pop(0)
        name = status.getPath().getName()
        if status.isDirectory():
            inner = sorted(system.listStatus(status.getPath()), key=lambda s: (s.isDirectory(), s.getPath().getName()))
            waiting = [s for s in inner if not s.getPath().getName().startswith(("_", "."))] + waiting
        elif _ending(name):
            return _ending(name)
    return _ending(path.rstrip("/").rsplit("/", 1)[-1])  # nothing there: the reader will say so


def read_auto(spark: SparkSession, path: str, excel_sheet: int | str = 0, **options) -> DataFrame:
    """Read CSV, workbooks, JSON or parquet. Missing files and unknown types raise."""
    kind = extension(spark, path)
    if kind == ".csv":
        return read_csv(spark, path, **options)
    if kind == ".xlsx":
        return read_excel(spark, path, sheet=excel_sheet, **options)
    if kind in (".json", ".jsonl"):
        return read_json(spark, path, **options)
    if kind == ".parquet":
        keyed = options.pop("keyed", False)
        df = spark.read.parquet(path)
        return df.select(*[ref(c) for c in df.columns], *(row_key(df) if keyed else []))
    if kind == ".xls":
        raise ValueError("legacy .xls workbooks are not supported: save them as .xlsx")
    raise ValueError(f"unsupported file type: {kind or path}")


def read_keyed(spark: SparkSession, path: str, excel_sheet: int | str = 0, **options) -> tuple[DataFrame, list[str]]:
    """Read a source once, with the place of each row as its key: (frame, key columns).

    The parsed rows are kept in the shared folder: later passes parse nothing again, and the key cannot change.
    """
    df = read_auto(spark, path, excel_sheet, keyed=True, **options)
    stored = scratch_path(spark, "read")
    named = {c: f"c{i}" for i, c in enumerate(df.columns)}  # any name can be written under a plain one
    df.select(*[ref(c).alias(named[c]) for c in df.columns]).write.parquet(stored)
    rows = spark.read.parquet(stored)
    return rows.select(*[F.col(named[c]).alias(c) for c in df.columns]), [c for c in ROW_KEY if c in df.columns]
