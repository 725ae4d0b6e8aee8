"""Write cleaned tables and execution logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from cleanloom.functions.columns import ref

HELPER_COLUMNS = ("Outlier",)
SOURCE_SUFFIXES = (".csv", ".xlsx", ".xls", ".jsonl", ".json", ".parquet")


def timestamped(path: str, label: str, now: dt.datetime | None = None) -> str:
    """``data/in.csv`` becomes ``data/in_<label>_20240131_120000``."""
    base = path.rstrip("/")
    for suffix in SOURCE_SUFFIXES:
        if base.lower().endswith(suffix):
            base = base[: -len(suffix)]
            break
    return f"{base}_{label}_{(now or dt.datetime.now()):%Y%m%d_%H%M%S}"


def _write(df: DataFrame, path: str, fmt: str) -> str:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        # Quotes are doubled and outer spaces kept, so the reader gets the same text back.
        writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_cleaned(df: DataFrame, source_path: str, fmt: str = "csv", now: dt.datetime | None = None) -> str:
    """Write the cleaned table next to its source, in parallel; returns the folder written."""
    kept = df.select(*[ref(c) for c in df.columns if c not in HELPER_COLUMNS])
    return _write(kept, timestamped(source_path, "cleaned", now), fmt)


def write_log(log: DataFrame, source_path: str, fmt: str = "csv", now: dt.datetime | None = None) -> str:
    return _write(log, timestamped(source_path, "log", now), fmt)
