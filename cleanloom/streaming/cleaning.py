"""Checks and fixes on streaming frames.

Fixes that depend on nothing but the row, and fixes whose parameters are given, are column
expressions: they run on a stream unchanged. Fixes that must look at other rows are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cleanloom.functions.columns import kinds
from cleanloom.operators.checks import Context, flag
from cleanloom.operators.fixes import apply_fitted, lookup, swap_dates
from cleanloom.operators.roles import Roles


def clean_stream(stream: DataFrame, steps: list[tuple[str, str, dict]]) -> DataFrame:
    """Apply (fix_id, column, params) steps. Fitted fixes need their parameters given."""
    for fix_id, column, params in steps:
        fix = lookup(fix_id)
        if fix_id == "FIX_SWAP_LOGICAL_DATES":
            stream = swap_dates(stream, column, params)
        elif fix_id == "FIX_DROP_COLUMN":
            stream = stream.drop(column)
        elif fix.frame is not None:
            raise ValueError(f"{fix_id} depends on other rows and cannot run on a stream")
        elif fix.needs is not None and not params:
            raise ValueError(f"{fix_id} needs given parameters on a stream")
        else:
            stream = apply_fitted(stream, [(fix_id, column, params)])
    return stream


def stream_context(stream: DataFrame, **roles) -> Context:
    """Context with declared roles: a stream has no whole to detect them from."""
    return Context(Roles(kinds=kinds(stream), **{k: tuple(v) for k, v in roles.items()}))


def flag_stream(stream: DataFrame, issue_id: str, column: str, key: list[str], ctx: Context) -> DataFrame:
    return flag(stream, issue_id, column, key, ctx)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet, processing what is available; restarts continue from ``checkpoint``."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
