"""Cleaning plans: which fix each issue gets, applied stage by stage with a log.

Steps that do not depend on each other share a stage, and a stage takes all its statistics (fix
parameters and log counts) from the same fused passes. Counts of rows that no fitted parameter picks, and the number of rows,
are taken with the parameters; only the others ask for a pass of their own. They are plain aggregates: observed metrics
add up again what a lost executor has to repeat. A new stage starts when a step touches a column
an earlier step of the stage changed, or follows a step that may remove rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import kinds
from cleanloom.functions.stats import aggregate, count_if
from cleanloom.operators.checks import Issue
from cleanloom.operators.fixes import (
    MAX_DROP_SHARE, affected, apply_fitted, fit_counting, lookup, rows_removed, split_pair)
from cleanloom.operators.recommend import exists, recommend
from cleanloom.operators.roles import detect_roles
from cleanloom.session import cut_lineage

MAX_TOTAL_LOSS = 0.50
SKIP, RECOMMENDED = "skip", "recommended"
# Fixes whose row loss is guarded.
GUARDED = ("FIX_DROP_ROWS",)


@dataclass(frozen=True)
class PlanStep:
    """A choice for one issue: a fix id, ``"recommended"`` or ``"skip"``."""

    issue_id: str
    column: str
    fix_id: str = RECOMMENDED
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class LogEntry:
    step: int
    column: str
    fix_id: str
    fix_applied: str
    values_changed: int | None
    rows_removed: int | None
    details: str = ""


LOG_SCHEMA = ("step int, column string, fix_id string, fix_applied string, values_changed long, "
              "rows_removed long, details string")


def log_frame(spark, log: list[LogEntry]) -> DataFrame:
    return spark.createDataFrame([tuple(e.__dict__.values()) for e in log], LOG_SCHEMA)


def recommended_plan(issues: list[Issue]) -> list[PlanStep]:
    return [PlanStep(i.issue_id, i.column) for i in issues]


def _touches(step: PlanStep, columns) -> set[str]:
    return set(split_pair(step.column, columns)) if step.fix_id == "FIX_SWAP_LOGICAL_DATES" else {step.column}


def _changes_rows(fix_id: str) -> bool:
    return lookup(fix_id).keep is not None or lookup(fix_id).frame is not None


def _stages(steps: list[PlanStep], columns) -> list[list[PlanStep]]:
    stages: list[list[PlanStep]] = []
    used: set[str] = set()
    closed = True
    for step in steps:
        if closed or used & _touches(step, columns) or lookup(step.fix_id).frame is not None:
            stages.append([])
            used = set()
        stages[-1].append(step)
        used |= _touches(step, columns)
        closed = _changes_rows(step.fix_id)
    return stages


def _counters(df: DataFrame, steps: list[PlanStep], params: list[dict], which: list[int]) -> dict:
    """By place in the stage, the number of rows that each of these steps changes or removes."""
    predicates = {i: affected(df, steps[i].fix_id, steps[i].column, params[i]) for i in which}
    return {i: count_if(predicate) for i, predicate in predicates.items() if predicate is not None}


def run_plan(df: DataFrame, issues: list[Issue], steps: list[PlanStep], order_by: list[str] | None = None,
             reset_ids: bool = False, approximate: bool = False, checkpoint_stages: int | None = None,
             as_of=None, dayfirst: bool = False, hidden: tuple[str, ...] = ()) -> tuple[DataFrame, list[LogEntry]]:
    """Apply a plan and return the cleaned frame with its log.

    ``order_by`` is the unique key that fixes depending on row order need. ``reset_ids`` renumbers
    identifier columns after rows were removed. ``checkpoint_stages`` cuts the lineage every so many
    stages, for long plans over expensive sources. ``as_of`` and ``dayfirst`` are the settings the issues
    were found with. ``hidden`` columns, such as a row key of the reader, are no part of the table.
    """
    shown = lambda frame: frame.drop(*hidden)
    settings = {n: value for n, value in (("as_of", as_of), ("dayfirst", dayfirst)) if value}
    if hidden:
        settings["ignore"] = list(hidden)
    steps = [replace(s, params={**settings, **s.params}) for s in steps]
    known = {(i.issue_id, i.column): i for i in issues}
    log: list[LogEntry] = []
    chosen: list[PlanStep] = []
    numbers: dict[int, int] = {}
    # Which fix is recommended depends on the data: asked once, for all steps that want it.
    open_issues = [known[(s.issue_id, s.column)] for s in steps if s.fix_id == RECOMMENDED and (s.issue_id, s.column) in known]
    best = {}
    if open_issues:
        for option in recommend(shown(df), open_issues, approximate, dayfirst):
            if option.is_recommended:
                best.setdefault((option.issue_id, option.column), option)
    for number, step in enumerate(steps, start=1):
        if step.fix_id == SKIP:
            log.append(LogEntry(number, step.column, SKIP, "skipped", None, None, "skipped by plan"))
            continue
        if step.fix_id == RECOMMENDED:
            option = best.get((step.issue_id, step.column))
            if option is None:
                log.append(LogEntry(number, step.column, SKIP, "skipped", None, None, "no fix available"))
                continue
            step = PlanStep(step.issue_id, step.column, option.fix_id, step.params)
        lookup(step.fix_id)
        numbers[id(step)] = number
        chosen.append(step)

    start_rows = rows = None
    identity = detect_roles(shown(df), dayfirst=dayfirst).identity if reset_ids else ()
    for done, stage in enumerate(_stages(chosen, df.columns), start=1):
        live = []
        for step in stage:
            if exists(Issue(step.issue_id, step.column, "", "", 0, ""), df.columns):
                live.append(step)
            else:
                log.append(LogEntry(numbers[id(step)], step.column, step.fix_id, "skipped", None, None,
                                    "column no longer exists"))
        if not live:
            continue
        fixed = [i for i, step in enumerate(live) if not lookup(step.fix_id).rows_fitted]
        early = _counters(df, live, [s.params for s in live], fixed)
        if rows is None:
            early["rows"] = F.count(F.lit(1))
        params, counts = fit_counting(df, [(s.fix_id, s.column) for s in live], [s.params for s in live], approximate, early)
        if rows is None:
            start_rows = rows = counts["rows"]
        counts |= aggregate(df, _counters(df, live, params, [i for i in range(len(live)) if i not in fixed]))
        fitted = []
        for i, step in enumerate(live):
            fix, number = lookup(step.fix_id), numbers[id(step)]
            removed = None
            if step.fix_id in GUARDED:
                nulls = params[i].get("nulls", 0)
                reason = ""
                if start_rows and (start_rows - rows) / start_rows > MAX_TOTAL_LOSS:
                    reason = "more than half of the rows were already removed"
                elif rows and nulls / rows > MAX_DROP_SHARE:
                    reason = f"would remove {nulls / rows:.1%} of the rows"
                if reason:
                    log.append(LogEntry(number, step.column, step.fix_id, "skipped", None, 0, reason))
                    continue
            if fix.frame is not None:
                column = "*" if step.column == "*" else step.column
                removed = rows_removed(df, step.fix_id, column, params[i])
                df = fix.frame(df, column, params[i], order_by)
            else:
                fitted.append((step.fix_id, step.column, params[i]))
                removed = counts.get(i) if fix.keep is not None else None
            changed = None if fix.keep is not None else counts.get(i)
            detail = ", ".join(f"{k}={v}" for k, v in params[i].items() if v is not None and k not in settings)
            log.append(LogEntry(number, step.column, step.fix_id, fix.label, changed, removed, detail))
            if removed:
                rows -= removed
        df = apply_fitted(df, fitted)
        lost = any(e.rows_removed for e in log if e.step in {numbers[id(s)] for s in live})
        if reset_ids and lost:
            for column in identity:
                if column in kinds(df):
                    df = lookup("RESET_ID_COLUMNS").frame(df, column, {}, order_by)
                    log.append(LogEntry(numbers[id(live[-1])], column, "RESET_ID_COLUMNS",
                                        lookup("RESET_ID_COLUMNS").label, rows, None))
        if checkpoint_stages and done % checkpoint_stages == 0:
            df = cut_lineage(df)
    return df, sorted(log, key=lambda e: e.step)
