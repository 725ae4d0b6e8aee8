"""Issue checks. One predicate per check serves the count, the flagged rows and the fix."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions import vocab
from cleanloom.functions.columns import (
    cell_text, has_non_ascii, has_outer_space, is_lower, is_upper, missing, parse_date, ref, strip, to_real)
from cleanloom.functions.stats import aggregate, count_if, duplicate_rows, spread
from cleanloom.operators.roles import Roles, detect_roles


@dataclass(frozen=True)
class Context:
    """What a predicate may depend on besides the row."""

    roles: Roles
    as_of: dt.datetime | None = None
    include_null: bool = True
    dayfirst: bool = False
    # Set when the frame carries the costly readings of a column as columns of their own.
    prepared: bool = False

    def kind(self, column: str) -> str:
        return self.roles.kinds[column]

    def date(self, column: str) -> Column:
        return self._reading("date", column)

    def number(self, column: str) -> Column:
        return self._reading("number", column)

    def stripped(self, column: str) -> Column:
        return self._reading("strip", column)

    def _reading(self, reading: str, column: str) -> Column:
        if self.prepared:
            return ref(f"{reading}:{column}")
        if reading == "date":
            return parse_date(ref(column), self.kind(column), self.dayfirst)
        return to_real(ref(column), self.kind(column)) if reading == "number" else strip(ref(column))

    def prepare(self, df: DataFrame, dates, numbers, texts) -> tuple[DataFrame, Context]:
        """Read every date, number and stripped text once, for all checks that use it."""
        extra = [self._reading(r, c).alias(f"{r}:{c}")
                 for r, names in (("date", dates), ("number", numbers), ("strip", texts)) for c in names]
        return df.select(*[ref(c) for c in df.columns], *extra), replace(self, prepared=True)

    def now(self) -> Column:
        return F.lit(self.as_of) if self.as_of else F.current_timestamp()


@dataclass(frozen=True)
class Check:
    """A row-level check of one column."""

    issue_id: str
    issue_type: str
    severity: str
    applies: Callable[[Context, str], bool]
    predicate: Callable[[Context, str], Column]
    wording: str
    examples: int = 3


@dataclass(frozen=True)
class Issue:
    issue_id: str
    column: str
    issue_type: str
    severity: str
    n_violations: int
    description: str
    examples: tuple[str, ...] = ()


# ---------------------------------------------------------------- shared predicates
def _is_proxy(stripped: Column) -> Column:
    return F.lower(stripped).isin(*vocab.PROXY_TOKENS)


def _is_empty(stripped: Column, include_null: bool) -> Column:
    blank = stripped.isin(*vocab.EMPTY_TOKENS)
    return stripped.isNull() | blank if include_null else blank


def proxy_missing(column: Column) -> Column:
    return _is_proxy(strip(column))


def empty_text(column: Column, include_null: bool = True) -> Column:
    return _is_empty(strip(column), include_null)


def impossible_age(number: Column) -> Column:
    return (number < vocab.AGE_MIN) | (number > vocab.AGE_MAX)


def outside_percent(number: Column) -> Column:
    return (number < 0) | (number > 100)


def invalid_date(column: Column, kind: str, dayfirst: bool = False) -> Column:
    return column.isNotNull() & parse_date(column, kind, dayfirst).isNull()


def invalid_email(column: Column) -> Column:
    return ~column.rlike(vocab.EMAIL_PATTERN)


def email_typo(column: Column) -> Column:
    return F.lower(column).rlike("|".join(t.replace(".", r"\.") for t in vocab.EMAIL_TYPOS))


def has_word(ctx, c):
    return ref(c).cast("string").rlike(vocab.LETTER_PATTERN)


def beyond_three_sigma(number: Column, mean: float, std: float) -> Column:
    return F.abs((number - F.lit(mean)) / F.lit(std)) > 3


def _has_moments(ctx, c):
    n, _, std = ctx.roles.moments.get(c, (0, None, None))
    return n >= 3 and bool(std)


def _is_text(ctx, c):
    return ctx.kind(c) == "string"


def _text_not_date(ctx, c):
    return _is_text(ctx, c) and c not in ctx.roles.date


# Column checks in reporting order; pair, column-wide and key checks are placed by ORDER below.
CHECKS: dict[str, Check] = {check.issue_id: check for check in (
    Check("EMAIL_FORMAT_ISSUE", "Text Cleaning", "Medium",
          lambda ctx, c: "email" in c.lower() and _is_text(ctx, c),
          lambda ctx, c: invalid_email(ref(c)) | email_typo(ref(c)),
          "{n} malformed addresses or mistyped domains."),
    Check("MISSING_VAL", "Missing Data", "High",
          lambda ctx, c: True,
          lambda ctx, c: missing(ref(c), ctx.kind(c)),
          "{n} missing values.", 0),
    Check("PROXY_MISSING", "Proxy Missingness", "Medium", _text_not_date,
          lambda ctx, c: _is_proxy(ctx.stripped(c)),
          "{n} placeholder tokens."),
    Check("EMPTY_TEXT", "Proxy Missingness", "Medium", _text_not_date,
          lambda ctx, c: _is_empty(ctx.stripped(c), ctx.include_null),
          "{n} values that are empty or spell a missing value.", 0),
    Check("NEG_AGE", "Numeric Validity", "High",
          lambda ctx, c: "age" in c.lower() and c in ctx.roles.numeric,
          lambda ctx, c: ctx.number(c) < 0,
          "{n} ages below zero."),
    Check("RANGE_EXCEEDED", "Range Violation", "High",
          lambda ctx, c: vocab.mentions(c, vocab.RANGE_WORDS),
          lambda ctx, c: ctx.number(c) > 100,
          "{n} values above 100 percent."),
    Check("IMPOSSIBLE_AGE", "Domain Constraint Violation", "High",
          lambda ctx, c: c in ctx.roles.age,
          lambda ctx, c: impossible_age(ctx.number(c)),
          "{n} ages outside 0 to 120."),
    Check("INVALID_MONETARY", "Domain Constraint Violation", "High",
          lambda ctx, c: c in ctx.roles.money,
          lambda ctx, c: ctx.number(c) <= 0,
          "{n} amounts that are zero or negative."),
    Check("FUTURE_DATE", "Time-Travel Error", "Medium",
          lambda ctx, c: c in ctx.roles.date,
          lambda ctx, c: ctx.date(c) > ctx.now(),
          "{n} dates in the future.", 1),
    Check("INVALID_DATE_FORMAT", "Invalid Date Format", "High",
          lambda ctx, c: c in ctx.roles.date,
          lambda ctx, c: ref(c).isNotNull() & ctx.date(c).isNull(),
          "{n} values that no date format reads."),
    Check("WHITESPACE", "Structural Noise", "Low", _is_text,
          lambda ctx, c: has_outer_space(ref(c)),
          "{n} values with outer whitespace.", 0),
    Check("SPECIAL_CHARS", "Structural Noise", "Medium",
          lambda ctx, c: _text_not_date(ctx, c) and not vocab.mentions(c, vocab.NO_SPECIAL_CHECK_WORDS),
          lambda ctx, c: ref(c).rlike(vocab.SPECIAL_PATTERN),
          "{n} values with special characters."),
    Check("ENCODING_JUNK", "Encoding Artifact", "Medium", _is_text,
          lambda ctx, c: has_non_ascii(ref(c)),
          "{n} values with non-ASCII characters.", 0),
    Check("WORD_AS_NUMBER", "Type Mismatch", "High",
          lambda ctx, c: c in ctx.roles.numeric and _is_text(ctx, c),
          has_word,
          "{n} text values in a numeric column."),
    Check("Z_OUTLIER", "Extreme Outlier", "Medium",
          lambda ctx, c: (c in ctx.roles.moments and c not in ctx.roles.identity + ctx.roles.age
                          and _has_moments(ctx, c)),
          lambda ctx, c: beyond_three_sigma(ctx.number(c), *ctx.roles.moments[c][1:]),
          "{n} values more than three standard deviations from the mean."),
    Check("PHONE_FORMAT_ISSUE", "Text Cleaning", "Low",
          lambda ctx, c: vocab.mentions(c, vocab.PHONE_WORDS) and _is_text(ctx, c),
          lambda ctx, c: ref(c).rlike(vocab.PHONE_NOISE_PATTERN),
          "{n} phone numbers with symbols or spaces."),
    Check("PERCENT_VIOLATION", "Business Rule Violation", "High",
          lambda ctx, c: vocab.mentions(c, vocab.PERCENT_RULE_WORDS),
          lambda ctx, c: outside_percent(ctx.number(c)),
          "{n} values outside 0 to 100 percent."),
)}

# Reporting order of all issues.
ORDER = ("EMAIL_FORMAT_ISSUE", "DATE_SEQUENCE_VIOLATION", "MISSING_VAL", "PROXY_MISSING", "EMPTY_TEXT",
         "NEG_AGE", "RANGE_EXCEEDED", "IMPOSSIBLE_AGE", "INVALID_MONETARY", "FUTURE_DATE",
         "INVALID_DATE_FORMAT", "DATE_FORMAT_MIXED", "SEQ_ERROR", "WHITESPACE", "SPECIAL_CHARS",
         "ENCODING_JUNK", "WORD_AS_NUMBER", "CASE_DIVERGE", "ID_CLASH", "Z_OUTLIER",
         "PHONE_FORMAT_ISSUE", "PERCENT_VIOLATION", "DUPLICATE_ROWS")
# Issue types whose checks read the column as a number.
NUMBER_TYPES = ("Numeric Validity", "Range Violation", "Domain Constraint Violation", "Extreme Outlier",
                "Business Rule Violation")
PAIR_CHECKS = {"DATE_SEQUENCE_VIOLATION": " -> ", "SEQ_ERROR": "/"}
MIXED_DATE_EXAMPLES = 6


# ---------------------------------------------------------------- row-level use
def context(df: DataFrame, roles=None, as_of=None, include_null=True, dayfirst=False) -> Context:
    found = roles if isinstance(roles, Roles) else detect_roles(df, roles, dayfirst)
    return Context(found, as_of, include_null, dayfirst)


def flag(df: DataFrame, issue_id: str, column: str, key: list[str], ctx: Context) -> DataFrame:
    """Violating rows of a column check as (key columns, value); the filter is the check's predicate."""
    check = CHECKS[issue_id]
    return df.filter(check.predicate(ctx, column)).select(
        *[ref(k) for k in key], ref(column).alias("value"))


def out_of_sequence(df_kinds: dict[str, str], start: str, end: str, dayfirst: bool = False) -> Column:
    """True where the end lies before the start."""
    return parse_date(ref(end), df_kinds[end], dayfirst) < parse_date(ref(start), df_kinds[start], dayfirst)


def sequence_pairs(columns: list[str], pairs=None) -> list[tuple[str, str, str]]:
    """(issue_id, start, end): given pairs, the order/ship pair, and the first start/end columns."""
    found = [("DATE_SEQUENCE_VIOLATION", a, b) for a, b in pairs or ()]
    if "order_date" in columns and "ship_date" in columns and ("order_date", "ship_date") not in (pairs or ()):
        found.append(("DATE_SEQUENCE_VIOLATION", "order_date", "ship_date"))
    starts = [c for c in columns if "start" in c.lower()]
    ends = [c for c in columns if "end" in c.lower()]
    if starts and ends:
        found.append(("SEQ_ERROR", starts[0], ends[0]))
    return found


def split_pair(column: str, columns=None) -> list[str]:
    """The two columns of a pair. Names may hold the mark themselves: both sides must be ``columns``, where given."""
    found = []
    for mark in PAIR_CHECKS.values():
        parts = column.split(mark)
        found += [[mark.join(parts[:i]), mark.join(parts[i:])] for i in range(1, len(parts))]
    known = [pair for pair in found if columns is not None and set(pair) <= set(columns)]
    if not found:
        raise ValueError(f"not a column pair: {column}")
    return (known or found)[0]


def separators(column: Column) -> dict[str, Column]:
    """Values of a date column that use each separator."""
    value = column.cast("string")
    return {mark: count_if(value.contains(mark)) for mark in "/-."}


def later_duplicates(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """Rows whose identifier already occurred earlier in ``order_by`` order (a unique key).

    First keys come from a combined aggregate, and the anti-join hashes (id, key) pairs, so a hot
    identifier is spread over all tasks.
    """
    groups = df.groupBy(ref(column).alias("__id"))
    if len(order_by) == 1:  # a plain minimum aggregates by hash; a struct would have to be sorted
        firsts = groups.agg(F.min(ref(order_by[0])).alias("__k0"))
    else:
        firsts = groups.agg(F.min(F.struct(*[ref(k).alias(f"k{i}") for i, k in enumerate(order_by)])).alias("__k"))
        firsts = firsts.select("__id", *[F.col(f"__k.k{i}").alias(f"__k{i}") for i in range(len(order_by))])
    match = ref(column).eqNullSafe(F.col("__id"))
    for i, k in enumerate(order_by):
        match = match & (ref(k) == F.col(f"__k{i}"))
    return df.join(firsts, match, "left_anti")


# ---------------------------------------------------------------- all checks at once
def detect_issues(df: DataFrame, roles=None, order_by: list[str] | None = None, as_of: dt.datetime | None = None,
                  pairs=None, include_null: bool = True, dayfirst: bool = False, examples: bool = True,
                  duplicates: bool = True) -> list[Issue]:
    """Run every check and return the issues found, in reporting order.

    The jobs are: roles (one pass, plus a distinct count for identifiers), one fused pass for all
    counters, one pass for a bounded number of example values, and the duplicate-row count.
    ``order_by`` names the columns that define "first" for the examples; without it examples are
    the smallest values.
    """
    ctx = context(df, roles, as_of, include_null, dayfirst)
    source, kind = df, ctx.roles.kinds
    df = spread(df)
    paired = sequence_pairs(list(kind), pairs)
    applied = [(check, column) for check in CHECKS.values() for column in kind if check.applies(ctx, column)]
    dated = set(ctx.roles.date) | {c for _, start, end in paired for c in (start, end)}
    numbers = {c for check, c in applied if check.issue_type in NUMBER_TYPES}
    texts = {c for check, c in applied if check.issue_type == "Proxy Missingness"}
    df, ctx = ctx.prepare(df, *[[c for c in kind if c in names] for names in (dated, numbers, texts)])
    predicates: dict[tuple, Column] = {
        (check.issue_id, column): check.predicate(ctx, column) for check, column in applied}
    for issue_id, start, end in paired:
        predicates[(issue_id, start + PAIR_CHECKS[issue_id] + end)] = ctx.date(end) < ctx.date(start)
    asked = {key: count_if(p) for key, p in predicates.items()}
    cased = [c for c in kind if kind[c] == "string" and c not in ctx.roles.date + ctx.roles.identity]
    for column in cased:
        asked[("upper", column)] = count_if(is_upper(ref(column)))
        asked[("lower", column)] = count_if(is_lower(ref(column)))
    for column in ctx.roles.date:
        asked[("dated", column)] = F.count(ref(column))
        for mark, counter in separators(ref(column)).items():
            asked[(mark, column)] = counter
    found = aggregate(df, asked)

    rows: list[Issue] = []
    for key in predicates:
        if found[key]:
            issue_id, column = key
            if issue_id in CHECKS:
                c = CHECKS[issue_id]
                rows.append(Issue(issue_id, column, c.issue_type, c.severity, found[key], c.wording.format(n=found[key])))
            else:
                kind_name = "Logical Error" if issue_id == "DATE_SEQUENCE_VIOLATION" else "Logical Sequence"
                rows.append(Issue(issue_id, column, kind_name, "High", found[key],
                                  f"{found[key]} rows end before they start."))
    for column in ctx.roles.date:
        used = [mark for mark in "/-." if found[(mark, column)]]
        if found[("dated", column)] >= 2 and len(used) > 1:
            rows.append(Issue("DATE_FORMAT_MIXED", column, "Format Divergence", "High", found[("dated", column)],
                              f"separators {', '.join(used)} occur in one date column."))
            predicates[("DATE_FORMAT_MIXED", column)] = ref(column).isNotNull()
    for column in cased:
        upper, lower = found[("upper", column)], found[("lower", column)]
        if upper and lower:
            rows.append(Issue("CASE_DIVERGE", column, "Format Divergence", "Low", upper + lower,
                              f"{upper} all-upper and {lower} all-lower values."))
    for column, repeats in ctx.roles.repeats.items():
        if repeats:
            rows.append(Issue("ID_CLASH", column, "Identity Clash", "High", repeats, f"{repeats} repeated identifiers."))
    if duplicates:
        repeated = duplicate_rows(source).first()["duplicate_rows"]
        if repeated:
            rows.append(Issue("DUPLICATE_ROWS", "*", "Duplicate Rows", "Medium", repeated,
                              f"{repeated} rows repeat an earlier row."))
    if examples:
        rows = _with_examples(df, ctx, rows, predicates, order_by)
    place = {name: i for i, name in enumerate(ORDER)}
    columns = {name: i for i, name in enumerate(kind)}
    return sorted(rows, key=lambda r: (place[r.issue_id], columns.get(r.column, len(columns))))


def _with_examples(df, ctx, rows, predicates, order_by) -> list[Issue]:
    wanted = []
    for i, row in enumerate(rows):
        if row.issue_id in CHECKS:
            limit = CHECKS[row.issue_id].examples
            value = cell_text(ref(row.column), ctx.kind(row.column))
        elif row.issue_id == "DATE_FORMAT_MIXED":
            limit, value = MIXED_DATE_EXAMPLES, cell_text(ref(row.column), ctx.kind(row.column))
        elif row.issue_id == "DATE_SEQUENCE_VIOLATION":
            limit, parts = 3, split_pair(row.column, ctx.roles.kinds)
            value = F.concat_ws(" -> ", *[ref(p).cast("string") for p in parts])
        else:
            continue
        if limit:
            hit = predicates[(row.issue_id, row.column)]
            wanted.append((i, limit, F.when(hit, F.struct(
                F.lit(i).alias("i"), F.lit(limit).alias("limit"), value.alias("value")))))
    if not wanted:
        return rows
    key = [ref(k) for k in order_by] if order_by else []
    hits = df.select(
        F.explode(F.filter(F.array(*[w[2] for w in wanted]), lambda h: h.isNotNull())).alias("h"),
        *([F.struct(*key).alias("k")] if key else [])
    ).select("h.i", "h.limit", "h.value", *(["k"] if key else []))
    order = [F.col("k")] if key else [F.col("value")]
    window = Window.partitionBy("i").orderBy(*order)
    # The rank limit is applied in every task before the shuffle, so a check with many hits stays small.
    picked = (hits.withColumn("rank", F.row_number().over(window))
              .filter((F.col("rank") <= max(w[1] for w in wanted)) & (F.col("rank") <= F.col("limit"))))
    samples: dict[int, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["i"], r["rank"])):
        samples.setdefault(r["i"], []).append(r["value"])
    return [Issue(**{**row.__dict__, "examples": tuple(samples.get(i, ()))}) for i, row in enumerate(rows)]


ISSUE_SCHEMA = ("issue_id string, column string, issue_type string, severity string, n_violations long, "
                "description string, examples array<string>")


def issues_frame(spark, issues: list[Issue]) -> DataFrame:
    return spark.createDataFrame(
        [(i.issue_id, i.column, i.issue_type, i.severity, int(i.n_violations), i.description, list(i.examples))
         for i in issues], ISSUE_SCHEMA)


def check_summary(df: DataFrame, issue_id: str, ctx: Context) -> DataFrame:
    """Lazy one-pass summary (column, n_violations) of one check over all columns it applies to."""
    check = CHECKS[issue_id]
    columns = [c for c in ctx.roles.kinds if check.applies(ctx, c)]
    counters = [count_if(check.predicate(ctx, c)).alias(f"n{i}") for i, c in enumerate(columns)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_violations long")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_violations"))
                      for i, c in enumerate(columns)])
    return df.agg(*counters).select(F.inline(pairs)).filter("n_violations > 0")
