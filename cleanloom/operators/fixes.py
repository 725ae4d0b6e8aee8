"""Fixes: value rewrites, row filters and whole-frame operations, looked up by fix id.

A value rewrite is a column expression and a row filter a predicate, so chains of them collapse into
one projection and one filter and also run on streams. What they need to know about the data (a
median, a mode, percentile bounds) are plain parameters: :func:`fit` finds the parameters of many
fixes together in fused passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import vocab
from cleanloom.functions.columns import (
    has_non_ascii, has_outer_space, is_numeric, kinds, missing, nan_to_null, number_without_commas, parse_date, ref, strip,
    to_number, to_real)
from cleanloom.functions.ordering import dense_numbers, forward_fill, stochastic_fill
from cleanloom.functions.stats import (
    aggregate, clean_modes, count_if, distinct_counts, duplicate_rows, percentiles)
from cleanloom.operators import checks
from cleanloom.operators.checks import split_pair

MAX_DROP_SHARE = 0.30


@dataclass(frozen=True)
class Needs:
    """Statistics that become parameters: plain aggregates, percentiles, and a clean mode."""

    aggregates: dict[str, Column] = field(default_factory=dict)
    percentiles: dict[str, tuple[Column, float]] = field(default_factory=dict)
    mode: Column | None = None
    finish: Callable[[dict], dict] = staticmethod(lambda p: p)


@dataclass(frozen=True)
class Fix:
    """One fix. ``c`` is the column, ``k`` its physical kind, ``p`` the parameters."""

    fix_id: str
    label: str
    value: Callable[[Column, str, dict], Column] | None = None
    keep: Callable[[Column, str, dict], Column] | None = None
    frame: Callable[..., DataFrame] | None = None
    # Counted in the log: rows a value rewrite changes.
    touched: Callable[[Column, str, dict], Column] | None = None
    needs: Callable[[str, str], Needs] | None = None
    only: Callable[[str], bool] = staticmethod(lambda kind: True)
    # Which rows it changes or removes depends on fitted parameters.
    rows_fitted: bool = False

    @property
    def row_local(self) -> bool:
        """Needs nothing but the row, so it may run on a stream."""
        return self.needs is None and (self.value is not None or self.keep is not None)


def whole(number):
    """Nearest whole number, halves to even."""
    return None if number is None else int(round(number))


def is_whole_number_name(name: str) -> bool:
    return "age" in name.lower() or vocab.mentions(name, vocab.WHOLE_NUMBER_WORDS)


def _literal(value, kind: str) -> Column:
    """A number literal in the column's own kind: long columns stay long unless the value is fractional."""
    if kind == "integer" and float(value).is_integer():
        return F.lit(int(value))
    return F.lit(float(value)) if kind in ("integer", "float") else F.lit(value)


# ---------------------------------------------------------------- value helpers
def _fill(c, k, replacement):
    return c if replacement is None else F.when(missing(c, k), _literal(replacement, k)).otherwise(c)


def _swap_where(bad: Column, number: Column, k: str, replacement) -> Column:
    kind = "integer" if k == "integer" else "float"
    new = F.lit(None) if replacement is None else _literal(replacement, kind)
    return F.when(bad, new).otherwise(number)


def _clip(c: Column, k: str, low, high) -> Column:
    if low is None or high is None:
        return c
    if k == "integer":  # whole columns use rounded bounds and stay whole
        low, high = whole(low), whole(high)
    number = to_number(c, k)
    return F.when(number < F.lit(low), F.lit(low)).when(number > F.lit(high), F.lit(high)).otherwise(number)


def _outside(c, k, low, high):
    if low is None or high is None:
        return F.lit(False)
    if k == "integer":
        low, high = whole(low), whole(high)
    number = to_number(c, k)
    return (number < F.lit(low)) | (number > F.lit(high))


def _not(bad: Column) -> Column:
    """Keep rows where the predicate is false or unknown."""
    return ~F.coalesce(bad, F.lit(False))


def first_digits(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("long")


def _digits_needs(name, k):
    """The median of the first numbers; a number beyond 64 bits would be lost, so the fix refuses it."""
    def finish(p):
        if p.pop("beyond"):
            raise ValueError(f"column {name} holds numbers beyond 64 bits: read it as text or decimals")
        return {**p, "median_value": None if p["median_value"] is None else int(p["median_value"])}

    held = F.regexp_extract(ref(name).cast("string"), r"(\d+)", 1) != ""
    return Needs(aggregates={"beyond": count_if(held & first_digits(ref(name)).isNull())},
                 percentiles={"median_value": (first_digits(ref(name)), 0.5)}, finish=finish)


def word_number(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in vocab.NUMBER_WORDS.items() for x in pair])
    return F.try_element_at(words, F.lower(strip(c)))


def correct_domains(c: Column) -> Column:
    for typo, domain in vocab.EMAIL_TYPOS.items():
        c = F.regexp_replace(c, "(?i)" + typo.replace(".", r"\."), domain)
    return c


def _number_of(c, k):
    return to_number(c, k)


def _real_of(name, k):
    return to_real(ref(name), k)


# ---------------------------------------------------------------- parameters
def clean_mode_values(c: Column, at_sign: bool, extra_tokens=()) -> Column:
    """Values that may become a mode: no special characters, no placeholder tokens."""
    pattern = vocab.SPECIAL_OR_AT_PATTERN if at_sign else vocab.SPECIAL_PATTERN
    tokens = extra_tokens or vocab.UNCLEAN_MODE_TOKENS
    return F.when(~c.rlike(pattern) & ~F.lower(strip(c)).isin(*tokens), c)


def text_mode_values(name: str) -> Column:
    """Mode candidates of the empty-text fix; e-mail columns keep their addresses."""
    c = ref(name)
    if "email" in name.lower():
        return F.when(~F.lower(strip(c)).isin(*vocab.UNCLEAN_TEXT_MODE_TOKENS), c)
    return clean_mode_values(c, at_sign=False, extra_tokens=vocab.UNCLEAN_TEXT_MODE_TOKENS)


def _median_needs(number: Callable[[str, str], Column], finish=None):
    def needs(name, k):
        return Needs(percentiles={"median_value": (number(name, k), 0.5)}, finish=finish(name) if finish else (lambda p: p))
    return needs


def _round_if_whole(key):
    def for_name(name):
        return lambda p: {**p, key: whole(p[key])} if is_whole_number_name(name) else p
    return for_name


def _bounds(low, high, names):
    def needs(name, k):
        real = _real_of(name, k)
        return Needs(percentiles={names[0]: (real, low), names[1]: (real, high)})
    return needs


def _iqr_needs(name, k):
    def finish(p):
        q1, q3 = p.pop("q1"), p.pop("q3")
        if q1 is None:
            return {**p, "lower_bound": None, "upper_bound": None}
        return {**p, "lower_bound": q1 - 1.5 * (q3 - q1), "upper_bound": q3 + 1.5 * (q3 - q1)}
    real = _real_of(name, k)
    return Needs(percentiles={"q1": (real, 0.25), "q3": (real, 0.75)}, finish=finish)


def median_day(name: str, k: str, dayfirst: bool = False) -> Needs:
    import datetime as dt

    def finish(p):
        micros = p.pop("micros")
        day = None if micros is None else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(micros))).date()
        return {**p, "median_date": day and day.isoformat()}
    return Needs(percentiles={"micros": (F.unix_micros(parse_date(ref(name), k, dayfirst)), 0.5)}, finish=finish)


def _moments_needs(name, k):
    real = _real_of(name, k)
    return Needs(aggregates={"n": F.count(real), "mean": F.avg(real), "std": F.stddev_samp(real)})


def _z_keep(c, k, p):
    if (p["n"] or 0) < 3 or not p["std"]:
        return F.lit(True)
    return F.coalesce(F.abs((to_real(c, k) - F.lit(p["mean"])) / F.lit(p["std"])) <= 3, F.lit(False))


def _null_share_needs(name, k):
    return Needs(aggregates={"rows": F.count(F.lit(1)), "nulls": count_if(missing(ref(name), k))})


def _drop_null_keep(c, k, p):
    too_many = p.get("rows") and p["nulls"] / p["rows"] > MAX_DROP_SHARE
    return F.lit(True) if too_many else ~missing(c, k)


# ---------------------------------------------------------------- frame operations
def keep_one(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """One row per value of ``column`` (nulls form one group), the first in the given order.

    The rank limit runs in every task before the shuffle, so a hot value sends one row per task.
    """
    window = Window.partitionBy(ref(column)).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def _ordered(order_by):
    if not order_by:
        raise ValueError("this fix depends on row order: pass order_by, a unique key")
    return [ref(k) for k in order_by]


def keep_first(df, column, p, order_by):
    return keep_one(df, column, *[k.asc() for k in _ordered(order_by)])


def keep_last(df, column, p, order_by):
    return keep_one(df, column, *[k.desc() for k in _ordered(order_by)])


def keep_complete(df, column, p, order_by):
    keys = _ordered(order_by)
    nulls = sum((ref(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return keep_one(df, column, nulls.asc(), *[k.asc() for k in keys])


def drop_exact_duplicates(df, column=None, p=None, order_by=None):
    """Distinct rows. Columns listed under ``ignore`` (such as an added row key) do not count."""
    ignored = (p or {}).get("ignore") or []
    compared = [c for c in df.columns if c not in ignored]
    if not ignored:
        return df.dropDuplicates()
    # The kept row is the smallest by the ignored columns: a combined aggregate, no sort of groups.
    kept = df.groupBy(*[ref(c) for c in compared]).agg(
        F.min(F.struct(*[ref(c).alias(f"i{i}") for i, c in enumerate(ignored)])).alias("__k"))
    taken = [F.col(f"__k.i{ignored.index(c)}").alias(c) if c in ignored else ref(c) for c in df.columns]
    return kept.select(*taken)


def reset_ids(df, column, p=None, order_by=None):
    """Rewrite an identifier column to 1..n in key order."""
    _ordered(order_by)
    numbered = dense_numbers(df, order_by, "__id", ranges=(p or {}).get("ranges"))
    return numbered.select(*[F.col("__id").alias(c) if c == column else ref(c) for c in df.columns])


def swap_dates(df, column, p=None, order_by=None):
    """Swap the two dates of a pair where the end precedes the start; both sides read the old row."""
    start, end = (p or {}).get("pair") or split_pair(column, df.columns)
    k = kinds(df)
    bad = F.coalesce(checks.out_of_sequence(k, start, end, _dayfirst(p or {})), F.lit(False))
    swapped = {start: F.when(bad, ref(end)).otherwise(ref(start)), end: F.when(bad, ref(start)).otherwise(ref(end))}
    return df.select(*[swapped[c].alias(c) if c in swapped else ref(c) for c in df.columns])


# ---------------------------------------------------------------- registry
_real = lambda c, k: to_real(c, k)
_null = lambda c, k, p: missing(c, k)
_AGE_OK = lambda n, k: F.when(~checks.impossible_age(_real_of(n, k)), _real_of(n, k))
_letters = lambda c, k, p: c.cast("string").rlike(vocab.LETTER_PATTERN)
_dayfirst = lambda p: bool(p.get("dayfirst"))
_date = lambda c, k, p: parse_date(c, k, _dayfirst(p))
_bad_date = lambda c, k, p: checks.invalid_date(c, k, _dayfirst(p))
_special = lambda c, k, p: c.rlike(vocab.SPECIAL_OR_AT_PATTERN)
_text_only = lambda kind: kind == "string"


def _mode_needs(values):
    return lambda name, k: Needs(mode=values(name))


FIXES: dict[str, Fix] = {fix.fix_id: fix for fix in (
    # imputation
    Fix("FIX_MEDIAN_IMPUTE", "fill with the median",
        value=lambda c, k, p: _fill(c, k, p["median_value"]), touched=_null,
        needs=_median_needs(_real_of, _round_if_whole("median_value")), only=is_numeric),
    Fix("FIX_MEAN_IMPUTE", "fill with the mean",
        value=lambda c, k, p: _fill(c, k, p["mean_value"]), touched=_null, only=is_numeric,
        needs=lambda n, k: Needs(aggregates={"mean_value": F.avg(_real_of(n, k))},
                                 finish=_round_if_whole("mean_value")(n))),
    Fix("FIX_MODE_IMPUTE", "fill with the most frequent clean value",
        value=lambda c, k, p: _fill(c, k, p["mode_value"]), touched=_null, only=_text_only,
        needs=_mode_needs(lambda n: clean_mode_values(ref(n), at_sign=True))),
    Fix("FIX_EXTRACT_NUMERIC_IMPUTE", "extract the first number, fill with its median",
        value=lambda c, k, p: F.coalesce(first_digits(c), F.lit(p["median_value"])), touched=_null,
        needs=_digits_needs),
    Fix("FIX_FORWARD_FILL", "fill with the previous value", touched=_null,
        frame=lambda df, column, p, order_by: forward_fill(nan_to_null(df, [column]), column, order_by, (p or {}).get("ranges"))),
    Fix("FIX_STOCHASTIC_FILL", "fill with random known values", touched=_null,
        frame=lambda df, column, p, order_by: stochastic_fill(
            nan_to_null(df, [column]), column, order_by, (p or {}).get("seed", 42), (p or {}).get("ranges"))),
    # removal
    Fix("FIX_DROP_COLUMN", "drop the column", frame=lambda df, column, p, order_by: df.drop(ref(column))),
    Fix("FIX_DROP_ROWS", "drop rows without a value", keep=_drop_null_keep, needs=_null_share_needs, rows_fitted=True),
    Fix("FIX_DROP_INVALID_ROWS", "drop rows above 100",
        keep=lambda c, k, p: _not(_real(c, k) > 100)),
    Fix("FIX_DROP_TEXT_ROWS", "drop rows with text", keep=lambda c, k, p: _not(_letters(c, k, p))),
    Fix("FIX_DROP_INVALID_DATE_ROWS", "drop rows with unreadable dates",
        keep=lambda c, k, p: _not(_bad_date(c, k, p))),
    Fix("FIX_DROP_IMPOSSIBLE_AGE_ROWS", "drop rows with impossible ages",
        keep=lambda c, k, p: _not(checks.impossible_age(_real(c, k)))),
    Fix("FIX_DROP_ZERO_MONETARY_ROWS", "drop rows with zero or negative amounts",
        keep=lambda c, k, p: _not(_real(c, k) <= 0)),
    Fix("FIX_REMOVE_OUTLIERS", "drop rows beyond three standard deviations", keep=_z_keep, needs=_moments_needs,
        rows_fitted=True),
    # numbers
    Fix("FIX_NEGATIVE_TO_ABS", "absolute value",
        value=lambda c, k, p: F.abs(to_number(c, k)), touched=lambda c, k, p: _real(c, k) < 0),
    Fix("FIX_NEGATIVE_TO_MEDIAN", "negative to the median",
        value=lambda c, k, p: _swap_where(_real(c, k) < 0, to_number(c, k), k, whole(p["median_value"]) or 0),
        touched=lambda c, k, p: _real(c, k) < 0,
        needs=_median_needs(lambda n, k: F.when(_real_of(n, k) >= 0, _real_of(n, k)))),
    Fix("FIX_NEGATIVE_TO_NAN", "negative to missing",
        value=lambda c, k, p: _swap_where(_real(c, k) < 0, to_number(c, k), k, None),
        touched=lambda c, k, p: _real(c, k) < 0),
    Fix("FIX_CAP_AT_100", "cap at 100",
        value=lambda c, k, p: _swap_where(_real(c, k) > 100, to_number(c, k), k, 100),
        touched=lambda c, k, p: _real(c, k) > 100),
    Fix("FIX_RANGE_TO_NAN", "above 100 to missing",
        value=lambda c, k, p: _swap_where(_real(c, k) > 100, to_number(c, k), k, None),
        touched=lambda c, k, p: _real(c, k) > 100),
    Fix("FIX_CLIP_PERCENTAGE", "clip to 0..100",
        value=lambda c, k, p: _clip(c, k, 0, 100) if k == "integer" else _clip(c, k, 0.0, 100.0),
        touched=lambda c, k, p: checks.outside_percent(_real(c, k))),
    Fix("FIX_SCALE_PERCENTAGE", "fractions to percent",
        value=lambda c, k, p: F.when((_real(c, k) > 0) & (_real(c, k) < 1), _real(c, k) * 100).otherwise(to_number(c, k)),
        touched=lambda c, k, p: (_real(c, k) > 0) & (_real(c, k) < 1)),
    Fix("FIX_WORD_TO_NUMBER", "number words to numbers",
        value=lambda c, k, p: F.coalesce(word_number(c).cast("double"), to_number(c, k)) if k == "string" else c,
        touched=_letters),
    Fix("FIX_TEXT_TO_NAN_IMPUTE", "text to the median",
        value=lambda c, k, p: _fill(to_number(c, k), "integer" if k == "integer" else "float", p["median_value"]),
        touched=_letters, needs=_median_needs(_real_of)),
    Fix("FIX_CAP_PERCENTILE", "cap at the 1st and 99th percentile",
        value=lambda c, k, p: _clip(c, k, p["p1"], p["p99"]), touched=lambda c, k, p: _outside(c, k, p["p1"], p["p99"]),
        needs=_bounds(0.01, 0.99, ("p1", "p99")), rows_fitted=True),
    Fix("FIX_CAP_IQR", "cap at the quartile fences",
        value=lambda c, k, p: _clip(c, k, p["lower_bound"], p["upper_bound"]),
        touched=lambda c, k, p: _outside(c, k, p["lower_bound"], p["upper_bound"]), needs=_iqr_needs, rows_fitted=True),
    Fix("FIX_WINSORIZE", "cap at the 5th and 95th percentile",
        value=lambda c, k, p: _clip(c, k, p["p5"], p["p95"]), touched=lambda c, k, p: _outside(c, k, p["p5"], p["p95"]),
        needs=_bounds(0.05, 0.95, ("p5", "p95")), rows_fitted=True),
    Fix("FIX_IMPOSSIBLE_AGE_TO_MEDIAN", "impossible ages to the median",
        value=lambda c, k, p: _swap_where(
            checks.impossible_age(_real(c, k)), to_number(c, k), k,
            vocab.AGE_DEFAULT if p["median_value"] is None else whole(p["median_value"])),
        touched=lambda c, k, p: checks.impossible_age(_real(c, k)), needs=_median_needs(_AGE_OK)),
    Fix("FIX_IMPOSSIBLE_AGE_TO_NAN", "impossible ages to missing",
        value=lambda c, k, p: _swap_where(checks.impossible_age(_real(c, k)), to_number(c, k), k, None),
        touched=lambda c, k, p: checks.impossible_age(_real(c, k))),
    Fix("FIX_ZERO_MONETARY_TO_MEDIAN", "amounts without value to the median",
        value=lambda c, k, p: _swap_where(_money(c, k) <= 0, _money(c, k), "float", p["median_value"]),
        touched=lambda c, k, p: _money(c, k) <= 0,
        needs=_median_needs(lambda n, k: F.when(_money(ref(n), k) > 0, _money(ref(n), k)))),
    Fix("FIX_ZERO_MONETARY_TO_NAN", "amounts without value to missing",
        value=lambda c, k, p: _swap_where(_real(c, k) <= 0, to_number(c, k), k, None),
        touched=lambda c, k, p: _real(c, k) <= 0),
    # duplicates
    Fix("FIX_KEEP_FIRST_ID", "keep the first row of each identifier", frame=keep_first),
    Fix("FIX_KEEP_LAST_ID", "keep the last row of each identifier", frame=keep_last),
    Fix("FIX_KEEP_COMPLETE", "keep the most complete row of each identifier", frame=keep_complete),
    Fix("FIX_DROP_EXACT_DUPLICATES", "drop repeated rows", frame=drop_exact_duplicates),
    Fix("RESET_ID_COLUMNS", "renumber identifiers from 1", frame=reset_ids),
    # text
    Fix("FIX_STRIP_WHITESPACE", "strip outer whitespace", only=_text_only,
        value=lambda c, k, p: strip(c), touched=lambda c, k, p: has_outer_space(c)),
    Fix("FIX_REMOVE_NON_ASCII", "remove non-ASCII characters", only=_text_only,
        value=lambda c, k, p: F.regexp_replace(c, vocab.NON_ASCII_PATTERN, ""),
        touched=lambda c, k, p: has_non_ascii(c)),
    Fix("FIX_STANDARDIZE_CASE_LOWER", "lower-case", only=_text_only,
        value=lambda c, k, p: F.lower(c), touched=lambda c, k, p: c != F.lower(c)),
    Fix("FIX_PROXY_TO_NAN", "placeholders to missing", only=_text_only,
        value=lambda c, k, p: F.when(~checks.proxy_missing(c), c), touched=lambda c, k, p: checks.proxy_missing(c)),
    Fix("FIX_REMOVE_SPECIAL_CHARS", "remove special characters", only=_text_only,
        value=lambda c, k, p: F.regexp_replace(c, vocab.SPECIAL_OR_AT_PATTERN, ""), touched=_special),
    Fix("FIX_REPLACE_SPECIAL_WITH_SPACE", "special characters to spaces", only=_text_only,
        value=lambda c, k, p: F.regexp_replace(c, vocab.SPECIAL_OR_AT_PATTERN, " "), touched=_special),
    Fix("FIX_EMPTY_TEXT_TO_MODE", "empty text to the most frequent clean value", only=_text_only,
        value=lambda c, k, p: c if p["mode_value"] is None else F.when(checks.empty_text(c), F.lit(p["mode_value"])).otherwise(c),
        touched=lambda c, k, p: checks.empty_text(c), needs=_mode_needs(text_mode_values)),
    Fix("FIX_EMPTY_TEXT_TO_NAN", "empty text to missing", only=_text_only,
        value=lambda c, k, p: F.when(~checks.empty_text(c, include_null=False), c),
        touched=lambda c, k, p: checks.empty_text(c, include_null=False)),
    Fix("FIX_INVALID_EMAIL_TO_NAN", "malformed addresses to missing", only=_text_only,
        value=lambda c, k, p: F.when(~checks.invalid_email(c), c), touched=lambda c, k, p: checks.invalid_email(c)),
    Fix("FIX_EMAIL_TYPOS", "correct e-mail domains", only=_text_only,
        value=lambda c, k, p: correct_domains(c), touched=lambda c, k, p: checks.email_typo(c)),
    Fix("FIX_STANDARDIZE_PHONE", "digits only",
        value=lambda c, k, p: F.regexp_replace(c.cast("string"), "[^0-9]", ""),
        touched=lambda c, k, p: c.cast("string").rlike("[^0-9]")),
    # dates
    Fix("FIX_INVALID_DATE_TO_NAN", "unreadable dates to missing",
        value=lambda c, k, p: F.when(_not(_bad_date(c, k, p)), c), touched=_bad_date),
    Fix("FIX_INVALID_DATE_DEFAULT", "unreadable dates to a default",
        value=lambda c, k, p: F.when(_bad_date(c, k, p), F.lit(p.get("default_date", vocab.DATE_DEFAULT))).otherwise(c),
        touched=_bad_date),
    Fix("FIX_INVALID_DATE_IMPUTE_MEDIAN", "unreadable dates to the median",
        value=lambda c, k, p: c if p["median_date"] is None else F.when(_bad_date(c, k, p), F.lit(p["median_date"])).otherwise(c),
        touched=_bad_date, needs=median_day),
    Fix("FIX_STANDARDIZE_DATE_FORMAT", "dates to yyyy-MM-dd",
        value=lambda c, k, p: F.coalesce(F.date_format(_date(c, k, p), "yyyy-MM-dd"), c.cast("string")),
        touched=lambda c, k, p: _date(c, k, p).isNotNull()),
    Fix("FIX_SWAP_LOGICAL_DATES", "swap inverted dates", frame=swap_dates),
    Fix("FIX_FUTURE_DATE_TO_NAN", "future dates to missing",
        value=lambda c, k, p: F.when(_not(_date(c, k, p) > _as_of(p)), c),
        touched=lambda c, k, p: _date(c, k, p) > _as_of(p)),
)}


def _money(c, k):
    return number_without_commas(c) if k == "string" else to_real(c, k)


def _as_of(p):
    return F.lit(p["as_of"]) if p.get("as_of") else F.current_timestamp()


# Row-local fixes, which depend on nothing but the row.
ROW_LOCAL = tuple(fix_id for fix_id, fix in FIXES.items() if fix.row_local)


def lookup(fix_id: str) -> Fix:
    if fix_id not in FIXES:
        raise ValueError(f"unknown fix: {fix_id}")
    return FIXES[fix_id]


def fit(df: DataFrame, targets: list[tuple[str, str]], given: list[dict] | None = None,
        approximate: bool = False) -> list[dict]:
    """Parameters of many fixes on one frame, in fused passes: aggregates, percentiles, modes.

    ``targets`` lists (fix_id, column). ``given`` parameters win over fitted ones and are not computed.
    """
    return fit_counting(df, targets, given, approximate, {})[0]


def fit_counting(df: DataFrame, targets: list[tuple[str, str]], given: list[dict] | None, approximate: bool,
                 counters: dict) -> tuple[list[dict], dict]:
    """:func:`fit`, and the values of further aggregates taken in the same pass."""
    given = given or [{} for _ in targets]
    kind = kinds(df)
    wanted = [None if c not in kind or not lookup(f).needs else
              median_day(c, kind[c], _dayfirst(g)) if lookup(f).needs is median_day else lookup(f).needs(c, kind[c])
              for (f, c), g in zip(targets, given)]
    plain, ranks, modes = {}, {}, {}
    for i, needs in enumerate(wanted):
        if needs is None:
            continue
        plain.update({(i, n): e for n, e in needs.aggregates.items() if n not in given[i]})
        ranks.update({(i, n): (e, [p]) for n, (e, p) in needs.percentiles.items() if n not in given[i]})
        if needs.mode is not None and "mode_value" not in given[i]:
            modes[str(i)] = needs.mode
    found = aggregate(df, {**plain, **{("counter", name): e for name, e in counters.items()}})
    points = percentiles(df, ranks, approximate=approximate)
    top = clean_modes(df, modes)
    result = []
    for i, needs in enumerate(wanted):
        p = {}
        if needs is not None:
            p = {n: found[(i, n)] for n in needs.aggregates if (i, n) in found}
            p.update({n: points[(i, n)][0] for n in needs.percentiles if (i, n) in points})
            if str(i) in top:
                p["mode_value"] = top[str(i)]["mode"]
            if set(p) >= set(needs.percentiles) | set(needs.aggregates):
                p = needs.finish(p)
        result.append({**p, **given[i]})
    return result, {name: found["counter", name] for name in counters}


def apply_fix(df: DataFrame, fix_id: str, column: str, params: dict | None = None,
              order_by: list[str] | None = None) -> DataFrame:
    """Apply one fix; parameters that are not given are fitted on ``df``."""
    fix = lookup(fix_id)
    if fix.frame is not None:
        return fix.frame(df, column, params or {}, order_by)
    kind = kinds(df)[column]
    if not fix.only(kind):
        return df
    p = fit(df, [(fix_id, column)], [params or {}])[0] if fix.needs else dict(params or {})
    return apply_fitted(df, [(fix_id, column, p)])


def apply_fitted(df: DataFrame, steps: list[tuple[str, str, dict]]) -> DataFrame:
    """Apply value rewrites and row filters with known parameters, one after the other."""
    for fix_id, column, p in steps:
        fix = lookup(fix_id)
        kind = kinds(df)[column]
        if not fix.only(kind):
            continue
        if fix.keep is not None:
            df = df.filter(fix.keep(ref(column), kind, p))
        else:
            new = fix.value(ref(column), kind, p)
            exact = df.schema[column].dataType
            if isinstance(exact, T.DecimalType):  # cells the fix does not touch keep every digit
                hit = F.coalesce(fix.touched(ref(column), kind, p), F.lit(False)) if fix.touched else F.lit(True)
                new = F.when(hit, new.try_cast(exact)).otherwise(ref(column))
            df = df.select(*[new.alias(c) if c == column else ref(c) for c in df.columns])
    return df


def affected(df: DataFrame, fix_id: str, column: str, params: dict) -> Column | None:
    """Predicate of the rows a fix changes or removes, or None for whole-frame fixes."""
    fix, kind = lookup(fix_id), kinds(df)
    if fix_id == "FIX_SWAP_LOGICAL_DATES":
        pair = (params or {}).get("pair") or split_pair(column, kind)
        return checks.out_of_sequence(kind, *pair, dayfirst=_dayfirst(params or {}))
    if column not in kind or not fix.only(kind[column]):
        return None
    if fix.keep is not None:
        return ~fix.keep(ref(column), kind[column], params)
    return fix.touched(ref(column), kind[column], params) if fix.touched else None


def rows_removed(df: DataFrame, fix_id: str, column: str, params: dict) -> int:
    """Rows a duplicate fix removes, from counts alone."""
    if fix_id == "FIX_DROP_EXACT_DUPLICATES":
        ignored = (params or {}).get("ignore") or []
        return duplicate_rows(df, [c for c in df.columns if c not in ignored]).first()["duplicate_rows"]
    if fix_id in ("FIX_KEEP_FIRST_ID", "FIX_KEEP_LAST_ID", "FIX_KEEP_COMPLETE"):
        facts = aggregate(df, {"rows": F.count(F.lit(1)), "present": F.count(ref(column))})
        groups = distinct_counts(df, {column: ref(column).cast("string")})[column]
        return facts["rows"] - groups - (1 if facts["present"] < facts["rows"] else 0)
    return 0
