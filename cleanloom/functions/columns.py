"""Column references, physical kinds and value coercion, all as built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.vocab import LADDER_DATE_FORMATS, OUTER_SPACES_PATTERN, SPACE

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"

_CLOCK = r"\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?( ?(Z|[+-]\d{1,2}(:?\d{2})?))?"
_ISO = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}([T ]{_CLOCK})?$"
DAY_SHAPE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
_ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
_DIGITS_FIRST = r"^\s*(\d{1,4}[-/.]\d|\d{8}\s*$)"
_MONTHS = ("jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|"
           "nov(ember)?|dec(ember)?")
_NAMED_MONTH = rf"(?i)^\s*((\d{{1,2}}[ -]({_MONTHS})[ -])|(({_MONTHS})\.? \d{{1,2}},? ))\d{{4}}\s*$"
_MONTH_FIRST = r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$"
_DAY_FIRST = r"^(\d{1,2})[ -]([a-z]{3})[a-z]*[ -](\d{4})$"
MAX_DATE_LENGTH = 64


def ref(name: str) -> Column:
    """Reference a column by its exact name, whatever dots, spaces or quotes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    """Physical kind of every column, in column order."""
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def missing(column: Column, kind: str) -> Column:
    """The one test for a missing value: null, or NaN in a floating column."""
    return column.isNull() | F.isnan(column.cast("double")) if kind == "float" else column.isNull()


def is_numeric(kind: str) -> bool:
    return kind in ("integer", "float")


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One missing value: NaN becomes null in every floating column, or in the given ones."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
              and (columns is None or f.name in columns)}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(ref(c)), ref(c)).alias(c) if c in floats else ref(c) for c in df.columns
    ])


def to_number(column: Column, kind: str) -> Column:
    """Numeric value of a column, null where the text is not a plain number.

    The shape guard matters: a bare cast would accept ``12d`` or ``inf``.
    """
    if kind == "integer":
        return column
    if kind == "float":
        return F.when(~F.isnan(column.cast("double")), column.cast("double"))
    if kind == "boolean":
        return column.cast("int")
    if kind == "string":
        return F.when(column.rlike(NUMBER_PATTERN), F.btrim(column, F.lit(" \t\r\n")).try_cast("double"))
    return F.lit(None).cast("double")


def to_real(column: Column, kind: str) -> Column:
    return to_number(column, kind).cast("double")


def number_without_commas(column: Column) -> Column:
    return to_number(F.regexp_replace(column, ",", ""), "string")


def text(column: Column) -> Column:
    return column.cast("string")


# ---------------------------------------------------------------- dates
def _groups(fmt: str) -> tuple[str, str]:
    """Regex of a day format, and the replacement that rewrites it to year-month-day."""
    separator = next(ch for ch in fmt if not ch.isalpha())
    fields = fmt.split(separator)
    digits = {"yyyy": r"(\d{4})", "MM": r"(\d{1,2})", "dd": r"(\d{1,2})"}
    pattern = re.escape(separator).join(digits[f] for f in fields)
    return f"^{pattern}$", "-".join(f"${fields.index(f) + 1}" for f in ("yyyy", "MM", "dd"))


def parse_date_as(column: Column, fmt: str) -> Column:
    """Timestamp of text in exactly one day format; one-digit days and months are accepted."""
    pattern, ordered = _groups(fmt)
    return F.when(column.rlike(pattern), F.regexp_replace(column, pattern, ordered).try_cast("timestamp"))


def _rewrites(dayfirst: bool) -> list[tuple[str, str]]:
    """Rewrites of the accepted day formats to year-month-day, a clock time after a blank kept.

    Where a mark is used both day-first and month-first, the first order of the ladder wins if its
    month is a month. That is the same as trying both: a day that is wrong for one order (29 or more)
    is no month for the other.
    """
    end, day, month = r"(?=[ T]|$)", r"(\d{1,2})", r"(0?[1-9]|1[0-2])"
    rules = [(rf"^(\d{{4}})([/.]){day}\2{day}{end}", "$1-$3-$4"), (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")]
    for mark in "/.-":
        orders = [f for f in LADDER_DATE_FORMATS if mark in f and not f.startswith("yyyy")]
        if dayfirst:
            orders.sort(key=lambda f: f.startswith("MM"))
        m = re.escape(mark)
        for i, fmt in enumerate(orders):
            only = len(orders) == 1 or i > 0
            if fmt.startswith("MM"):
                rules.append((rf"^{day if only else month}{m}{day}{m}(\d{{4}}){end}", "$3-$1-$2"))
            else:
                rules.append((rf"^{day}{m}{day if only else month}{m}(\d{{4}}){end}", "$3-$2-$1"))
    return rules


def parse_date(column: Column, kind: str = "string", dayfirst: bool = False) -> Column:
    """Timestamp of a value in any accepted format, else null.

    Text is rewritten to year-month-day by a fixed ladder of formats, so that a value parses the same
    way whatever its neighbours are, and cast in a way that yields null on failure: nothing is thrown
    per bad row. The column occurs only a few times in the expression, which keeps generated code small
    when the column is itself a long expression.
    """
    if kind == "temporal":
        return column.cast("timestamp")
    if is_numeric(kind):  # whole numbers count nanoseconds since 1970
        return F.when(column.isNotNull(), F.timestamp_micros((column / 1000).cast("long")))
    if kind != "string":
        return F.lit(None).cast("timestamp")
    blanks = F.lit(" \t\r\n")
    digits = F.btrim(column, blanks)
    for pattern, ordered in _rewrites(dayfirst):
        digits = F.regexp_replace(digits, pattern, ordered)
    digits = F.regexp_extract(digits, _ISO, 0).try_cast("timestamp")
    named = F.lower(F.btrim(column, blanks))
    for pattern, ordered in ((_MONTH_FIRST, "$3 $1 $2"), (_DAY_FIRST, "$3 $2 $1")):
        named = F.regexp_replace(named, pattern, ordered)
    named = F.try_to_timestamp(F.initcap(named), F.lit("yyyy MMM d"))
    # Plain ISO days skip the rewrites. Text that, without outer blanks, is longer than the longest accepted form, or of another
    # make, is ruled out by its length or by one match.
    return F.when(F.length(F.btrim(column, blanks)) <= MAX_DATE_LENGTH,
                  F.when(column.rlike(_ISO_DAY), column.try_cast("timestamp"))
                  .when(column.rlike(_DIGITS_FIRST), digits)
                  .when(column.rlike(_NAMED_MONTH), named))


# ---------------------------------------------------------------- text
def is_upper(column: Column) -> Column:
    return (column == F.upper(column)) & (column != F.lower(column))


def is_lower(column: Column) -> Column:
    return (column == F.lower(column)) & (column != F.upper(column))


def has_outer_space(column: Column) -> Column:
    """Looks at the first and last character only, however long the text is."""
    return F.concat(F.left(column, F.lit(1)), F.right(column, F.lit(1))).rlike(SPACE)


def has_non_ascii(column: Column) -> Column:
    """ASCII text has as many bytes as characters."""
    return F.octet_length(column) != F.char_length(column)


def strip(column: Column) -> Column:
    return F.regexp_replace(column, OUTER_SPACES_PATTERN, "")


def cell_text(column: Column, kind: str) -> Column:
    """Text of a cell for grouping and reports; only types without a text cast go through JSON."""
    return F.to_json(F.struct(column.alias("v"))) if kind == "other" else column.cast("string")
