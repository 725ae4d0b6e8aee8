"""CSV source: header row, null tokens, and inferred column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.columns import ref
from cleanloom.functions.vocab import CSV_NULL_TOKENS
from cleanloom.operators.infer import cast_physical, physical_types
from cleanloom.sources.records import refuse


BAD_ROW = "__bad_row"
# File, block of the file, and running number of a row: the order of rows in the source.
ROW_KEY = ("__file", "__block", "__row")


def row_key(df: DataFrame) -> list[Column]:
    """The place of each row of a file source: unique, never null, in file order."""
    meta = F.col("_metadata")
    return [meta["file_path"].alias(ROW_KEY[0]), meta["file_block_start"].alias(ROW_KEY[1]),
            F.monotonically_increasing_id().alias(ROW_KEY[2])]


def _reader(spark, separator, multiline):
    return (spark.read.option("sep", separator).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("mode", "PERMISSIVE"))


def raw_header(spark: SparkSession, path, separator: str = ",", multiline: bool = False) -> list[str]:
    """Header cells as written, before duplicates are renamed; reads the head of one file only."""
    row = _reader(spark, separator, multiline).option("header", False).csv(path).first()
    return ["" if cell is None else cell for cell in row] if row else []


def unique_names(header: list[str]) -> list[str]:
    """Empty names become ``Unnamed: i``; repeated ones, also in another case, get ``.1``, ``.2`` and so on."""
    taken: set[str] = set()
    names = []
    for i, name in enumerate(header):
        base = name if name else f"Unnamed: {i}"
        candidate, n = base, 0
        while candidate.lower() in taken:  # Spark does not tell cases apart
            n += 1
            candidate = f"{base}.{n}"
        taken.add(candidate.lower())
        names.append(candidate)
    return names


def read_csv(spark: SparkSession, path, separator: str = ",", infer: bool = True, multiline: bool = False,
             null_tokens=CSV_NULL_TOKENS, keyed: bool = False) -> DataFrame:
    """Read CSV files. Files stay splittable unless ``multiline`` allows line breaks inside quotes.

    All columns are read as text with null tokens blanked; ``infer`` then finds whole, decimal and
    boolean columns in one fused pass and casts them. ``keyed`` adds the columns of :func:`row_key`.
    """
    header = raw_header(spark, path, separator, multiline)
    names = unique_names(header)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    # A header that repeats names or leaves them empty goes by position. Any other must be the same in all files, or the read fails.
    by_position = names != header
    read_as = [f"c{i}" for i in range(len(names))] if by_position else names
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*read_as, BAD_ROW)])
    raw = (_reader(spark, separator, multiline).option("header", True).option("enforceSchema", by_position)
           .option("columnNameOfCorruptRecord", BAD_ROW).option("columnPruning", False).schema(schema).csv(path))
    # Rows with too few cells are filled with nulls; one with too many fails the read instead of losing cells.
    cells = F.from_csv(ref(BAD_ROW), ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"sep": separator, "quote": '"', "escape": '"'})
    too_many = ref(BAD_ROW).isNotNull() & cells[f"c{len(names)}"].isNotNull()
    # The condition reads a cell as well: Spark refuses to read the raw row alone.
    told = ref(read_as[0]).isNull() | (F.length(ref(read_as[0])) >= 0)
    raw = refuse(raw, told & too_many, f"a row has more cells than the {len(names)} of the header", ref(BAD_ROW))
    value = [F.when(~ref(c).isin(*null_tokens), ref(c)) for c in read_as]
    df = raw.select(*[v.alias(name) for v, name in zip(value, names)], *(row_key(raw) if keyed else []))
    if not infer:
        return df
    return cast_physical(df, physical_types(df, names))


def null_tokens_to_null(df: DataFrame, null_tokens=CSV_NULL_TOKENS) -> DataFrame:
    texts = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.when(~ref(c).isin(*null_tokens), ref(c)).alias(c) if c in texts else ref(c)
                       for c in df.columns])
