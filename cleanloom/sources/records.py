"""Strict records: a broken record fails the read, whichever columns are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 200  # characters of a broken record in the message


def refuse(df: DataFrame, broken: Column, why: str, record: Column) -> DataFrame:
    """The rows of ``df``; reading any of them fails if one is ``broken``. A filter, unlike a column, is never pruned away."""
    lost = F.raise_error(F.concat(F.lit(f"{why}: "), F.left(record, F.lit(SHOWN)))).cast("boolean")
    return df.filter(F.when(broken, lost).otherwise(F.lit(True)))


def is_one_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    A parser stops behind the first value. Inside brackets, a second value makes an array of two or an error, and inside braces a second key or an
    error; a text that closes the one bracket early cannot close the other.
    """
    listed = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    keyed = F.json_object_keys(F.concat(F.lit('{"r":'), text, F.lit("}"))) == F.array(F.lit("r"))
    return F.coalesce(listed & keyed, F.lit(False))
