"""End to end: read, validate, infer, profile, optionally drop outliers, detect, clean, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cleanloom.functions.columns import nan_to_null
from cleanloom.operators import checks, impact, outliers, profile, schema
from cleanloom.operators import infer as _infer
from cleanloom.plans.plan import LogEntry, PlanStep, log_frame, recommended_plan, run_plan
from cleanloom.sources.auto import read_keyed
from cleanloom.sources.sinks import write_cleaned, write_log


@dataclass
class Outcome:
    schema: schema.SchemaReport
    types: dict
    profile: DataFrame
    outliers: DataFrame | None
    issues: list[checks.Issue]
    before: DataFrame
    cleaned: DataFrame
    log: list[LogEntry]
    impact: DataFrame
    # Folders of the cleaned table and the log, where they were written.
    written: tuple[str, ...] = ()


class EmptyDataset(ValueError):
    """The source holds no rows."""


def clean(df: DataFrame, source: str | None = None, expected: list[str] | None = None, strict: bool = False,
          infer: bool = True, drop_outliers: str | None = None, contamination: float = 0.05,
          order_by: list[str] | None = None, steps: list[PlanStep] | None = None, roles: dict | None = None,
          as_of=None, dayfirst: bool = False, include_null: bool = True, pairs=None,
          hidden: tuple[str, ...] = (), **plan_options) -> Outcome:
    """Clean one frame. ``drop_outliers`` names a method; by default every row is kept.

    Without ``steps`` each issue gets its recommended fix. ``as_of``, ``dayfirst``, ``include_null`` and ``pairs`` are the
    settings of the checks; inference, recommendations and fixes use the same. ``hidden`` columns, such as the row key
    of a reader, serve as order and are no part of the table.
    """
    order_by = order_by or list(hidden) or None
    df = nan_to_null(df)
    if df.isEmpty():
        raise EmptyDataset(source or "the dataset has no rows")
    report = schema.validate_schema(df.drop(*hidden), expected, strict, source=source)
    types = _infer.infer_types(df.drop(*hidden), dayfirst=dayfirst) if infer else {}
    if infer:
        df = _infer.apply_types(df, types | {c: ("text", None) for c in hidden}, dayfirst)
    table = profile.profile(df.drop(*hidden), source, order_by=[c for c in order_by or () if c not in hidden] or None)
    flagged = None
    if drop_outliers:
        features = outliers.numeric_features(df.drop(*hidden))
        model = outliers.fit(df, key=order_by, method=drop_outliers, contamination=contamination, features=features)
        marked = outliers.detect(df, model, key=order_by)
        flagged, df = outliers.summary(marked), outliers.inliers(marked)
    before = df.drop(*hidden)
    issues = checks.detect_issues(before, roles, [c for c in order_by or () if c not in hidden] or None, as_of, pairs, include_null, dayfirst)
    cleaned, log = run_plan(df, issues, recommended_plan(issues) if steps is None else steps, order_by, as_of=as_of,
                            dayfirst=dayfirst, hidden=tuple(hidden), **plan_options)
    cleaned = cleaned.drop(*hidden)
    return Outcome(report, types, table, flagged, issues, before, cleaned, log, impact.impact(before, cleaned))


def clean_file(spark: SparkSession, path: str, excel_sheet: int | str = 0, output: str | None = None, fmt: str = "csv",
               **options) -> Outcome:
    """Clean a file or folder; its rows keep the order of the source, so no key has to be named.

    With ``output`` the cleaned table and the log are written to new folders whose names begin so.
    """
    df, key = read_keyed(spark, path, excel_sheet)
    outcome = clean(df, source=path, hidden=tuple(key), **options)
    if output:
        outcome.written = (write_cleaned(outcome.cleaned, output, fmt), write_log(log_frame(spark, outcome.log), output, fmt))
    return outcome
