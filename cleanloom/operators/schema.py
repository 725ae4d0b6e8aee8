"""Schema validation: shape, column order, duplicate and empty names, expected columns."""

from __future__ import annotations

import warnings
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import ref
from cleanloom.functions.stats import aggregate, count_if


class SchemaError(ValueError):
    """A failed validation in strict mode."""


@dataclass
class SchemaReport:
    source: str | None
    rows: int
    columns: int
    column_order: list[str]
    duplicate_columns: list[str]
    empty_columns: list[str]
    missing_columns: list[str] | None
    extra_columns: list[str] | None
    data_types: dict[str, str]
    missing_values: dict[str, int]
    problems: list[str] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        """Long form (column, position, dtype, nulls)."""
        rows = [(c, i, self.data_types[c], int(self.missing_values[c])) for i, c in enumerate(self.column_order)]
        return spark.createDataFrame(rows, "column string, position int, dtype string, nulls long")


def repeated_names(header: list[str], case_sensitive: bool = True) -> list[str]:
    """Names that occur again after their first use, in header order."""
    seen, repeated = Counter(), []
    for name in header:
        folded = name if case_sensitive else name.lower()
        if seen[folded]:
            repeated.append(name)
        seen[folded] += 1
    return repeated


def empty_names(header: list[str]) -> list[str]:
    return [name for name in header if name is None or name == "" or name.lower() == "nan"]


def missing_value_counts(df: DataFrame) -> dict:
    """Row count and nulls per column, in one pass."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    asked = {None: F.count(F.lit(1))}
    for c in df.columns:
        missing = ref(c).isNull() | F.isnan(ref(c)) if c in floats else ref(c).isNull()
        asked[c] = count_if(missing)
    return aggregate(df, asked)


def validate_schema(df: DataFrame, expected: list[str] | None = None, strict: bool = False, min_columns: int = 1,
                    source: str | None = None, header: list[str] | None = None,
                    case_sensitive: bool = True) -> SchemaReport:
    """Validate a frame; problems warn, or raise :class:`SchemaError` when ``strict``.

    ``header`` is the raw header of the source, where duplicate and empty names are still visible.
    """
    names = header if header is not None else df.columns
    counts = missing_value_counts(df)
    rows = counts.pop(None)
    problems = []
    if rows == 0:
        problems.append("the table has no rows")
    if len(df.columns) < min_columns:
        problems.append(f"the table has fewer than {min_columns} columns")
    repeated = repeated_names(names, case_sensitive)
    if repeated:
        problems.append(f"repeated column names: {repeated}")
    empty = empty_names(names)
    if empty:
        problems.append(f"empty column names: {empty}")
    missing = extra = None
    if expected:
        missing = [c for c in expected if c not in names]
        extra = [c for c in names if c not in expected]
        if missing:
            problems.append(f"missing columns: {missing}")
    for problem in problems:
        if strict:
            raise SchemaError(problem)
        warnings.warn(problem, stacklevel=2)
    return SchemaReport(source, rows, len(df.columns), list(df.columns), repeated, empty, missing, extra,
                        dict(df.dtypes), counts, problems)
