"""Type inference: boolean, numeric, datetime, categorical or text, and the casts that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import (
    DAY_SHAPE, is_numeric, kinds, number_without_commas, parse_date, parse_date_as, ref)
from cleanloom.functions.stats import aggregate, count_if, distinct_counts, spread
from cleanloom.functions.vocab import INFERENCE_DATE_FORMATS

ACCEPT = 0.9
# Texts that make a boolean column.
BOOLEAN_TEXTS = {"true": True, "false": False, "1": True, "0": False}


def infer_types(df: DataFrame, categorical_threshold: float = 0.05,
                approximate_distinct: bool = False, dayfirst: bool = False) -> dict[str, tuple[str, str | None]]:
    """Logical type of every column, with the date format that won: {column: (type, format)}.

    One fused pass decides boolean, numeric and datetime; only the columns left over need a distinct
    count, in one further job.
    """
    kind = kinds(df)
    # Where both orders of day and month fit, the wanted one is tried first.
    formats = sorted(INFERENCE_DATE_FORMATS, key=lambda f: f.startswith("MM")) if dayfirst else list(INFERENCE_DATE_FORMATS)
    asked = {"rows": F.count(F.lit(1))}
    for name, k in kind.items():
        c = ref(name)
        if k in ("string", "integer"):
            asked[("bool", name)] = F.every(F.lower(c.cast("string")).isin(*BOOLEAN_TEXTS))
            asked[("present", name)] = F.count(c)
        elif k == "float":
            asked[("present", name)] = F.count(F.when(~F.isnan(c.cast("double")), c))
        elif k == "other":
            asked[("present", name)] = F.count(c)
        if k == "string":
            asked[("number", name)] = F.count(number_without_commas(c))
            asked[("date", name)] = F.count(parse_date(c, dayfirst=dayfirst))
            for fmt in formats:
                asked[(fmt, name)] = F.count(parse_date_as(ref(f"day:{name}"), fmt))
    # One match per text decides whether any of the formats is worth trying.
    days = [F.when(ref(c).rlike(DAY_SHAPE), ref(c)).alias(f"day:{c}") for c, k in kind.items() if k == "string"]
    found = aggregate(spread(df).select(*[ref(c) for c in kind], *days), asked)
    rows = max(found["rows"], 1)

    decided: dict[str, tuple[str, str | None]] = {}
    for name, k in kind.items():
        present = found.get(("present", name))
        if k == "boolean" or present == 0:
            decided[name] = ("boolean", None)  # a column without values counts as boolean
        elif k == "integer" and found[("bool", name)] and present == found["rows"]:
            decided[name] = ("boolean", None)
        elif is_numeric(k):
            decided[name] = ("numeric", None)
        elif k == "temporal":
            decided[name] = ("datetime", None)
        elif k == "string":
            if found[("bool", name)]:
                decided[name] = ("boolean", None)
            elif found[("number", name)] / rows > ACCEPT:
                decided[name] = ("numeric", None)
            else:
                won = next((f for f in formats if found[(f, name)] / rows > ACCEPT), None)
                if won or found[("date", name)] / rows > ACCEPT:
                    decided[name] = ("datetime", won)
    open_columns = [c for c in kind if c not in decided]
    distinct = distinct_counts(
        df, {c: ref(c) if kind[c] == "string" else F.to_json(F.struct(ref(c).alias("v"))) for c in open_columns},
        approximate_distinct)
    for name in open_columns:
        decided[name] = ("categorical" if distinct[name] / rows <= categorical_threshold else "text", None)
    return {c: decided[c] for c in kind}


def apply_types(df: DataFrame, types: dict[str, tuple[str, str | None]], dayfirst: bool = False) -> DataFrame:
    """Cast columns to their inferred type in one projection; categorical is tagged in field metadata."""
    kind = kinds(df)
    out = []
    for name in df.columns:
        c, (logical, fmt) = ref(name), types[name]
        metadata = {"logical_type": logical}
        if logical == "boolean" and kind[name] != "boolean":
            texts = F.lower(c.cast("string"))
            c = F.when(texts.isin("true", "1"), F.lit(True)).when(texts.isin("false", "0"), F.lit(False))
        elif logical == "numeric" and kind[name] == "string":
            c = number_without_commas(c)
        elif logical == "datetime" and kind[name] == "string":
            c = parse_date_as(c, fmt) if fmt else parse_date(c, dayfirst=dayfirst)
        out.append(c.alias(name, metadata=metadata))
    return df.select(*out)


def type_report(spark, types: dict[str, tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, (t, _) in types.items()], "column string, inferred_type string")


def physical_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Physical type of all-text columns, as a CSV reader would infer them: long, double, boolean, string.

    Whole numbers keep every digit: beyond 64 bits they become decimals of 38 digits, or stay text where
    that does not hold them either or where fractions stand beside them. One fused pass.
    """
    from cleanloom.functions.columns import INTEGER_PATTERN, to_number

    names = [c for c in (columns or df.columns) if kinds(df)[c] == "string"]
    asked = {}
    for name in names:
        c = ref(name)
        asked[("n", name)] = F.count(c)
        whole = F.when(c.rlike(INTEGER_PATTERN), F.btrim(c, F.lit(" \t\r\n")))
        asked[("whole", name)] = F.count(whole)
        asked[("long", name)] = F.count(whole.try_cast("bigint"))
        asked[("decimal", name)] = F.count(whole.try_cast("decimal(38,0)"))
        asked[("double", name)] = F.count(to_number(c, "string"))
        asked[("bool", name)] = count_if(c.isin("True", "TRUE", "true", "False", "FALSE", "false"))
    found = aggregate(spread(df), asked)
    result = {}
    for name in names:
        n = found[("n", name)]
        if found[("whole", name)] > found[("long", name)]:
            result[name] = "decimal" if found[("decimal", name)] == n else "string"
        else:
            result[name] = next((t for t in ("long", "double", "bool") if n and found[(t, name)] == n), "string")
    return result


def cast_physical(df: DataFrame, types: dict[str, str]) -> DataFrame:
    spark_type = {"long": "bigint", "decimal": "decimal(38,0)", "double": "double", "bool": "boolean"}
    trimmed = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    return df.select(*[
        trimmed(ref(c)).try_cast(spark_type[types[c]]).alias(c) if types.get(c) in spark_type else ref(c)
        for c in df.columns])
