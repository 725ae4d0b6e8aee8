"""Recommendations: candidate fixes with parameters for each detected issue.

Each issue asks for the statistics its fixes need; :func:`recommend` gathers the requests of all issues
and answers them together: one fused aggregate, one percentile request, one value count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions import vocab
from cleanloom.functions.columns import is_numeric, kinds, parse_date, ref, strip, to_real
from cleanloom.functions.stats import (
    adjusted_skewness, aggregate, clean_modes, count_if, percentiles)
from cleanloom.operators import checks
from cleanloom.operators.checks import Issue
from cleanloom.operators.fixes import (
    clean_mode_values, first_digits, is_whole_number_name, median_day, split_pair, text_mode_values, whole)

HIGH_MISSING_PERCENT = 40
MIN_REMAINING_PERCENT = 60


@dataclass(frozen=True)
class FixOption:
    fix_id: str
    issue_id: str
    column: str
    label: str
    description: str
    impact: str
    risk: str
    is_recommended: bool = False
    requires_user_input: bool = False
    params: dict = field(default_factory=dict)


@dataclass
class Request:
    """Statistics one issue needs, by name."""

    aggregates: dict[str, Column] = field(default_factory=dict)
    percentiles: dict[str, tuple[Column, float]] = field(default_factory=dict)
    mode: Column | None = None


FIX_TEXT = {
    # fix id: (what it does, risk)
    "FIX_MEDIAN_IMPUTE": ("fill missing values with the median", "may hide the true distribution"),
    "FIX_MEAN_IMPUTE": ("fill missing values with the mean", "sensitive to outliers"),
    "FIX_STOCHASTIC_FILL": ("fill missing values with known values drawn at random", "adds randomness"),
    "FIX_MODE_IMPUTE": ("fill missing values with the most frequent clean value", "may unbalance classes"),
    "FIX_EXTRACT_NUMERIC_IMPUTE": ("take the first number of each text, fill the rest with its median",
                                   "loses the text around the number"),
    "FIX_FORWARD_FILL": ("fill missing dates with the previous date", "assumes the rows follow in time"),
    "FIX_DROP_COLUMN": ("drop the column", "loses the column"),
    "FIX_DROP_ROWS": ("drop rows without a value", "loses rows"),
    "FIX_NEGATIVE_TO_ABS": ("take the absolute value", "wrong if negatives were meant as markers"),
    "FIX_NEGATIVE_TO_MEDIAN": ("replace negatives by the median of the others", "loses the original pattern"),
    "FIX_NEGATIVE_TO_NAN": ("mark negatives as missing", "more missing values"),
    "FIX_CAP_AT_100": ("cap values at 100", "may distort the distribution"),
    "FIX_RANGE_TO_NAN": ("mark values above 100 as missing", "more missing values"),
    "FIX_DROP_INVALID_ROWS": ("drop rows above 100", "loses rows"),
    "FIX_CLIP_PERCENTAGE": ("clip to 0..100", "low"),
    "FIX_SCALE_PERCENTAGE": ("turn fractions into percent", "assumes 0.1 means 10 percent"),
    "FIX_IMPOSSIBLE_AGE_TO_MEDIAN": ("replace impossible ages by the median of valid ages", "assumes data errors"),
    "FIX_IMPOSSIBLE_AGE_TO_NAN": ("mark impossible ages as missing", "more missing values"),
    "FIX_DROP_IMPOSSIBLE_AGE_ROWS": ("drop rows with impossible ages", "loses rows"),
    "FIX_ZERO_MONETARY_TO_MEDIAN": ("replace amounts without value by the median", "assumes data errors"),
    "FIX_ZERO_MONETARY_TO_NAN": ("mark amounts without value as missing", "more missing values"),
    "FIX_DROP_ZERO_MONETARY_ROWS": ("drop rows with amounts without value", "loses rows"),
    "FIX_STANDARDIZE_DATE_FORMAT": ("write every readable date as yyyy-MM-dd", "none"),
    "FIX_INVALID_DATE_IMPUTE_MEDIAN": ("replace unreadable dates by the median date", "assumes a central date"),
    "FIX_INVALID_DATE_TO_NAN": ("mark unreadable dates as missing", "more missing values"),
    "FIX_DROP_INVALID_DATE_ROWS": ("drop rows with unreadable dates", "loses rows"),
    "FIX_INVALID_DATE_DEFAULT": ("replace unreadable dates by a default date", "misleading if not documented"),
    "FIX_SWAP_LOGICAL_DATES": ("swap inverted dates", "assumes the columns were swapped"),
    "FIX_FUTURE_DATE_TO_NAN": ("mark future dates as missing", "more missing values"),
    "FIX_WORD_TO_NUMBER": ("turn number words into numbers", "knows common English words only"),
    "FIX_TEXT_TO_NAN_IMPUTE": ("replace text by the median", "loses the text"),
    "FIX_DROP_TEXT_ROWS": ("drop rows with text", "loses rows"),
    "FIX_CAP_PERCENTILE": ("cap at the 1st and 99th percentile", "keeps the shape, loses extremes"),
    "FIX_CAP_IQR": ("cap at 1.5 interquartile ranges from the quartiles", "more aggressive than percentiles"),
    "FIX_REMOVE_OUTLIERS": ("drop rows beyond three standard deviations", "loses rows"),
    "FIX_WINSORIZE": ("cap at the 5th and 95th percentile", "may leave outliers"),
    "FIX_KEEP_FIRST_ID": ("keep the first row of each identifier", "may lose newer records"),
    "FIX_KEEP_LAST_ID": ("keep the last row of each identifier", "may lose older records"),
    "FIX_KEEP_COMPLETE": ("keep the row with the fewest missing values", "slower than by position"),
    "FIX_DROP_EXACT_DUPLICATES": ("drop repeated rows", "minimal"),
    "FIX_STRIP_WHITESPACE": ("strip outer whitespace", "none"),
    "FIX_REMOVE_NON_ASCII": ("remove non-ASCII characters", "may remove foreign letters"),
    "FIX_REMOVE_SPECIAL_CHARS": ("remove special characters", "may remove punctuation"),
    "FIX_REPLACE_SPECIAL_WITH_SPACE": ("replace special characters by spaces", "may add spaces"),
    "FIX_STANDARDIZE_CASE_LOWER": ("lower-case all values", "proper nouns lose their form"),
    "FIX_PROXY_TO_NAN": ("mark placeholders as missing", "more missing values"),
    "FIX_EMPTY_TEXT_TO_MODE": ("replace empty text by the most frequent clean value", "may unbalance classes"),
    "FIX_EMPTY_TEXT_TO_NAN": ("mark empty text as missing", "none"),
    "FIX_INVALID_EMAIL_TO_NAN": ("mark malformed addresses as missing", "low"),
    "FIX_EMAIL_TYPOS": ("correct known domain typos", "low"),
    "FIX_STANDARDIZE_PHONE": ("keep the digits only", "low"),
}


def _option(issue: Issue, fix_id: str, recommended: bool = False, n: int | None = None, **params) -> FixOption:
    what, risk = FIX_TEXT[fix_id]
    shown = {k: v for k, v in params.items() if v is not None}
    detail = ", ".join(f"{k}={round(v, 4) if isinstance(v, float) else v}" for k, v in shown.items())
    return FixOption(fix_id, issue.issue_id, issue.column, f"{what} ({detail})" if detail else what, what,
                     f"{issue.n_violations if n is None else n} values", risk, recommended, False, params)


# ---------------------------------------------------------------- what each issue asks for
def _request(issue: Issue, kind: dict[str, str], dayfirst: bool = False) -> Request:
    c, i = issue.column, issue.issue_id
    if c not in kind:
        return Request()
    k = kind[c]
    real = to_real(ref(c), k)
    if i == "MISSING_VAL":
        missing = count_if(ref(c).isNull() | F.isnan(real)) if k == "float" else count_if(ref(c).isNull())
        request = Request({"rows": F.count(F.lit(1)), "missing": missing})
        if is_numeric(k):
            request.aggregates.update({"mean": F.avg(real), "skewness": adjusted_skewness(real)})
            request.percentiles["median"] = (real, 0.5)
        elif k == "string":
            request.aggregates["digits"] = F.count(first_digits(ref(c)))
            request.percentiles["digits_median"] = (first_digits(ref(c)), 0.5)
            request.mode = clean_mode_values(ref(c), at_sign=True)
        return request
    if i in ("NEG_AGE", "RANGE_EXCEEDED", "PERCENT_VIOLATION"):
        return Request(
            {"outside": count_if(checks.outside_percent(real)), "negative": count_if(real < 0),
             "above": count_if(real > 100), "fractions": count_if((real > 0) & (real < 1))},
            {"median": (F.when(real >= 0, real), 0.5)})
    if i == "IMPOSSIBLE_AGE":
        return Request(percentiles={"median": (F.when(~checks.impossible_age(real), real), 0.5)})
    if i == "INVALID_MONETARY":
        return Request(percentiles={"median": (F.when(real > 0, real), 0.5)})
    if i == "INVALID_DATE_FORMAT":
        return Request({"valid": F.count(parse_date(ref(c), k, dayfirst))}, dict(median_day(c, k, dayfirst).percentiles))
    if i == "WORD_AS_NUMBER":
        words = F.lower(strip(ref(c)))
        known = words.isin(*vocab.NUMBER_WORDS)
        return Request({"known": count_if(known)}, {"median": (real, 0.5)})
    if i == "Z_OUTLIER":
        share = {"p1": 0.01, "p5": 0.05, "q1": 0.25, "q3": 0.75, "p95": 0.95, "p99": 0.99}
        return Request({"n": F.count(real), "std": F.stddev_samp(real)}, {n: (real, p) for n, p in share.items()})
    if i == "EMPTY_TEXT":
        return Request(mode=text_mode_values(c))
    return Request()


# ---------------------------------------------------------------- options per issue
def _missing_options(issue, kind, s) -> list[FixOption]:
    k = kind[issue.column]
    rows, missing = s["rows"], s["missing"]
    percent = missing / rows * 100 if rows else 0.0
    options: list[FixOption] = []
    if percent > HIGH_MISSING_PERCENT:
        if k == "string" and s["digits"]:
            return [
                _option(issue, "FIX_EXTRACT_NUMERIC_IMPUTE", True, median_value=int(s["digits_median"])),
                _option(issue, "FIX_DROP_COLUMN", missing_percent=percent),
            ]
        options.append(_option(issue, "FIX_DROP_COLUMN", True, missing_percent=percent))
    if is_numeric(k):
        counted = is_whole_number_name(issue.column)
        median, mean = s["median"], s["mean"]
        if counted:
            median, mean = whole(median), whole(mean)
        skewed = abs(s["skewness"] or 0.0) > 1
        if skewed or "age" in issue.column.lower():
            options.append(_option(issue, "FIX_MEDIAN_IMPUTE", True, median_value=median))
        else:
            options += [
                _option(issue, "FIX_MEAN_IMPUTE", True, mean_value=mean),
                _option(issue, "FIX_MEDIAN_IMPUTE", median_value=median),
                _option(issue, "FIX_STOCHASTIC_FILL", True),
            ]
    elif k == "string":
        total = s["mode_total"]
        diversity = s["mode_distinct"] / total if total else 0.0
        has_mode = s["mode"] is not None
        frequency = s["mode_count"] / total if total else 0.0
        good_mode = has_mode and frequency > 0.2 and diversity < 0.7
        if has_mode:
            options.append(_option(issue, "FIX_MODE_IMPUTE", good_mode, mode_value=s["mode"]))
        if diversity > 0.5 or not has_mode:
            options.append(_option(issue, "FIX_DROP_ROWS", not good_mode))
    elif k == "temporal":
        options.append(_option(issue, "FIX_FORWARD_FILL", True))
    offered = any(o.fix_id == "FIX_DROP_ROWS" for o in options)
    if not offered and rows and (rows - missing) / rows * 100 >= MIN_REMAINING_PERCENT:
        options.append(_option(issue, "FIX_DROP_ROWS"))
    return options


def _numeric_options(issue, kind, s) -> list[FixOption]:
    options = []
    if issue.issue_id == "PERCENT_VIOLATION" or (
            vocab.mentions(issue.column, vocab.PERCENT_FIX_WORDS) and s["outside"]):
        options.append(_option(issue, "FIX_CLIP_PERCENTAGE", True, n=s["outside"]))
    if issue.issue_id == "NEG_AGE" and s["negative"]:
        options += [
            _option(issue, "FIX_NEGATIVE_TO_ABS"),
            _option(issue, "FIX_NEGATIVE_TO_MEDIAN", True, median_value=s["median"]),
            _option(issue, "FIX_NEGATIVE_TO_NAN"),
        ]
    if issue.issue_id == "RANGE_EXCEEDED" and s["above"]:
        options += [
            _option(issue, "FIX_CAP_AT_100", True), _option(issue, "FIX_RANGE_TO_NAN"),
            _option(issue, "FIX_DROP_INVALID_ROWS"),
        ]
    if issue.issue_id == "PERCENT_VIOLATION" and s["fractions"]:
        options.append(_option(issue, "FIX_SCALE_PERCENTAGE", n=s["fractions"]))
    return options


def _age_options(issue, kind, s):
    median = vocab.AGE_DEFAULT if s["median"] is None else whole(s["median"])
    return [_option(issue, "FIX_IMPOSSIBLE_AGE_TO_MEDIAN", True, median_value=median),
            _option(issue, "FIX_IMPOSSIBLE_AGE_TO_NAN"), _option(issue, "FIX_DROP_IMPOSSIBLE_AGE_ROWS")]


def _money_options(issue, kind, s):
    median = vocab.MONEY_DEFAULT if s["median"] is None else s["median"]
    return [_option(issue, "FIX_ZERO_MONETARY_TO_MEDIAN", True, median_value=median),
            _option(issue, "FIX_ZERO_MONETARY_TO_NAN"), _option(issue, "FIX_DROP_ZERO_MONETARY_ROWS")]


def _date_options(issue, kind, s):
    day = median_day(issue.column, kind[issue.column]).finish({"micros": s["micros"]})["median_date"]
    options = [_option(issue, "FIX_INVALID_DATE_IMPUTE_MEDIAN", True, median_date=day)] if s["valid"] else []
    return options + [
        _option(issue, "FIX_INVALID_DATE_TO_NAN", not s["valid"]),
        _option(issue, "FIX_DROP_INVALID_DATE_ROWS"),
        _option(issue, "FIX_INVALID_DATE_DEFAULT", default_date=vocab.DATE_DEFAULT),
    ]


def _word_options(issue, kind, s):
    options = [_option(issue, "FIX_WORD_TO_NUMBER", True)] if s["known"] else []
    return options + [_option(issue, "FIX_TEXT_TO_NAN_IMPUTE", not s["known"], median_value=s["median"]),
                      _option(issue, "FIX_DROP_TEXT_ROWS")]


def _outlier_options(issue, kind, s):
    if s["n"] < 3 or not s["std"]:
        return []
    spread = s["q3"] - s["q1"]
    return [
        _option(issue, "FIX_CAP_PERCENTILE", True, p1=s["p1"], p99=s["p99"]),
        _option(issue, "FIX_CAP_IQR", lower_bound=s["q1"] - 1.5 * spread, upper_bound=s["q3"] + 1.5 * spread),
        _option(issue, "FIX_REMOVE_OUTLIERS"),
        _option(issue, "FIX_WINSORIZE", p5=s["p5"], p95=s["p95"]),
    ]


def _empty_options(issue, kind, s):
    has_mode = s["mode"] is not None
    options = [_option(issue, "FIX_EMPTY_TEXT_TO_MODE", True, mode_value=s["mode"])] if has_mode else []
    return options + [_option(issue, "FIX_EMPTY_TEXT_TO_NAN", has_mode)]


def _fixed(*offers):
    """Options that need no statistics: (fix id, recommended)."""
    return lambda issue, kind, s: [_option(issue, fix_id, best) for fix_id, best in offers]


ROUTES = {
    "MISSING_VAL": _missing_options,
    "NEG_AGE": _numeric_options, "RANGE_EXCEEDED": _numeric_options, "PERCENT_VIOLATION": _numeric_options,
    "IMPOSSIBLE_AGE": _age_options, "INVALID_MONETARY": _money_options,
    "INVALID_DATE_FORMAT": _date_options, "WORD_AS_NUMBER": _word_options, "Z_OUTLIER": _outlier_options,
    "EMPTY_TEXT": _empty_options,
    "EMAIL_FORMAT_ISSUE": _fixed(("FIX_EMAIL_TYPOS", True), ("FIX_INVALID_EMAIL_TO_NAN", False)),
    "PHONE_FORMAT_ISSUE": _fixed(("FIX_STANDARDIZE_PHONE", True)),
    "PROXY_MISSING": _fixed(("FIX_PROXY_TO_NAN", True)),
    "WHITESPACE": _fixed(("FIX_STRIP_WHITESPACE", True)),
    "SPECIAL_CHARS": _fixed(("FIX_REMOVE_SPECIAL_CHARS", True), ("FIX_REPLACE_SPECIAL_WITH_SPACE", False)),
    "ENCODING_JUNK": _fixed(("FIX_REMOVE_NON_ASCII", True)),
    "CASE_DIVERGE": _fixed(("FIX_STANDARDIZE_CASE_LOWER", True)),
    "DATE_FORMAT_MIXED": _fixed(("FIX_STANDARDIZE_DATE_FORMAT", True)),
    "DATE_SEQUENCE_VIOLATION": _fixed(("FIX_SWAP_LOGICAL_DATES", True)),
    "SEQ_ERROR": _fixed(("FIX_SWAP_LOGICAL_DATES", True)),
    "FUTURE_DATE": _fixed(("FIX_FUTURE_DATE_TO_NAN", True)),
    "ID_CLASH": _fixed(("FIX_KEEP_FIRST_ID", True), ("FIX_KEEP_LAST_ID", False), ("FIX_KEEP_COMPLETE", False)),
    "DUPLICATE_ROWS": _fixed(("FIX_DROP_EXACT_DUPLICATES", True)),
}


def exists(issue: Issue, columns) -> bool:
    """Whether the columns of an issue are still there."""
    if issue.column == "*":
        return True
    if issue.issue_id in checks.PAIR_CHECKS:
        return all(c in columns for c in split_pair(issue.column, columns))
    return issue.column in columns


def recommend(df: DataFrame, issues: list[Issue], approximate: bool = False, dayfirst: bool = False) -> list[FixOption]:
    """Candidate fixes of all issues, in issue order; issues of unknown kind get none.

    ``dayfirst`` is the setting the issues were found with.
    """
    kind = kinds(df)
    live = [i for i in issues if i.issue_id in ROUTES and exists(i, kind)]
    requests = [_request(issue, kind, dayfirst) for issue in live]
    plain = {(i, n): e for i, r in enumerate(requests) for n, e in r.aggregates.items()}
    ranks = {(i, n): (e, [p]) for i, r in enumerate(requests) for n, (e, p) in r.percentiles.items()}
    found = aggregate(df, plain)
    points = percentiles(df, ranks, approximate=approximate)
    modes = clean_modes(df, {str(i): r.mode for i, r in enumerate(requests) if r.mode is not None})
    options: list[FixOption] = []
    for i, issue in enumerate(live):
        s = {n: found[(i, n)] for n in requests[i].aggregates}
        s.update({n: points[(i, n)][0] for n in requests[i].percentiles})
        if str(i) in modes:
            m = modes[str(i)]
            s.update(mode=m["mode"], mode_count=m["top"], mode_total=m["total"], mode_distinct=m["distinct"])
        options += ROUTES[issue.issue_id](issue, kind, s)
    return options


def recommended_only(options: list[FixOption]) -> list[FixOption]:
    return [o for o in options if o.is_recommended]


FIX_SCHEMA = ("fix_id string, issue_id string, column string, label string, description string, impact string, "
              "risk string, is_recommended boolean, requires_user_input boolean, metadata map<string,string>")


def fixes_frame(spark, options: list[FixOption]) -> DataFrame:
    return spark.createDataFrame(
        [(o.fix_id, o.issue_id, o.column, o.label, o.description, o.impact, o.risk, o.is_recommended,
          o.requires_user_input, {k: str(v) for k, v in o.params.items() if v is not None}) for o in options],
        FIX_SCHEMA)
