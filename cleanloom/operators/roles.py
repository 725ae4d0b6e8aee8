"""Column roles: which columns hold dates, numbers, identifiers, money or ages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions import vocab
from cleanloom.functions.columns import is_numeric, kinds, parse_date, ref, to_number, to_real
from cleanloom.functions.stats import aggregate, spread, value_counts


@dataclass(frozen=True)
class Roles:
    """Roles by content and name, with the table facts gathered on the way."""

    kinds: dict[str, str]
    date: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()
    money: tuple[str, ...] = ()
    age: tuple[str, ...] = ()
    rows: int = 0
    # Per physical numeric column: (values, mean, sample standard deviation).
    moments: dict[str, tuple] = field(default_factory=dict)
    # Per identifier column: rows beyond the first of each value.
    repeats: dict[str, int] = field(default_factory=dict)

    @property
    def text(self) -> tuple[str, ...]:
        return tuple(c for c, k in self.kinds.items() if k == "string")


ROLE_NAMES = ("date", "numeric", "identity", "money", "age")


def detect_roles(df: DataFrame, overrides: dict | None = None, dayfirst: bool = False) -> Roles:
    """Detect roles in one fused pass, plus one distinct count when identifier candidates exist.

    ``overrides`` maps a role name to the exact columns that hold it.
    """
    kind = kinds(df)
    overrides = overrides or {}
    unknown = set(overrides) - set(ROLE_NAMES)
    if unknown:
        raise ValueError(f"unknown roles: {sorted(unknown)}")

    asked = {"rows": F.count(F.lit(1))}
    for name, k in kind.items():
        column = ref(name)
        if "date" not in overrides and k in ("string", "temporal", "integer", "float"):
            named = vocab.mentions(name, vocab.DATE_WORDS)
            if named or k == "string":
                asked[("present", name)] = F.count(column)
                asked[("dates", name)] = F.count(parse_date(column, k, dayfirst))
        if ("numeric" not in overrides and not is_numeric(k) and vocab.mentions(name, vocab.NUMERIC_WORDS)
                and not vocab.mentions(name, vocab.CATEGORY_WORDS)):
            asked[("numbers", name)] = F.count(to_number(column, k))
        if "identity" not in overrides and "id" in name.lower():
            asked[("id", name)] = F.struct(
                F.count(to_number(column, k)).alias("n"),
                F.min(to_number(column, k)).alias("low"), F.max(to_number(column, k)).alias("high"))
        if is_numeric(k):
            real = to_real(column, k)
            asked[("moments", name)] = F.struct(
                F.count(real).alias("n"), F.avg(real).alias("mean"), F.stddev_samp(real).alias("std"))
    found = aggregate(spread(df), asked)
    rows = found["rows"]

    date = []
    for name, k in kind.items():
        present = found.get(("present", name)) or 0
        parsed = found.get(("dates", name)) or 0
        if present and vocab.mentions(name, vocab.DATE_WORDS) and parsed / present > 0.3:
            date.append(name)
        elif present and k == "string" and parsed / rows > 0.3:
            date.append(name)  # the content alone says so, counting nulls against it

    numeric = []
    for name, k in kind.items():
        if vocab.mentions(name, vocab.CATEGORY_WORDS):
            continue
        if is_numeric(k) or k == "boolean":
            numeric.append(name)
        elif rows and (found.get(("numbers", name)) or 0) / rows >= 0.3:
            numeric.append(name)

    candidates = list(overrides.get("identity", ()))
    for name in kind:
        facts = found.get(("id", name))
        # The mean gap is (high - low) / (distinct - 1), so more than 2 per row already rules it out.
        if facts and rows > 1 and facts["n"] == rows and facts["high"] > facts["low"]:
            if (facts["high"] - facts["low"]) / (rows - 1) <= 2:
                candidates.append(name)
    repeats, identity = {}, []
    if candidates:
        raw = value_counts(df, {c: ref(c).cast("string") for c in candidates})
        asked = [F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")]
        written = [c for c in candidates if kind[c] == "string"]
        if written:  # texts may write one number in several ways
            asked.append(F.count_distinct(F.when(
                F.col("column").isin(written), to_number(F.col("value"), "string"))).alias("numbers"))
        for row in raw.groupBy("column").agg(*asked).collect():
            name, facts = row["column"], found.get(("id", row["column"]))
            repeats[name] = row["n"] - row["values"] + max(rows - row["n"] - 1, 0)
            numbers = row["numbers"] if name in written else row["values"]
            if "identity" in overrides or (numbers > 1 and (facts["high"] - facts["low"]) / (numbers - 1) <= 2):
                identity.append(name)
    identity = [c for c in kind if c in identity]

    def pick(role, detected):
        return tuple(overrides.get(role, detected))

    return Roles(
        kinds=kind, rows=rows,
        date=pick("date", date), numeric=pick("numeric", numeric), identity=pick("identity", identity),
        money=pick("money", [c for c in kind if vocab.mentions(c, vocab.MONEY_WORDS)]),
        age=pick("age", [c for c in kind if "age" in c.lower()]),
        moments={name: tuple(found[("moments", name)]) for name, k in kind.items() if is_numeric(k)},
        repeats={c: repeats.get(c, 0) for c in identity},
    )


def roles_frame(spark, roles: Roles) -> DataFrame:
    """Long form (column, role)."""
    pairs = [(c, role) for role in ROLE_NAMES for c in getattr(roles, role)]
    return spark.createDataFrame(pairs, "column string, role string")
