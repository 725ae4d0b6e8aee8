"""Exact deduplication by skew-safe combining of whole texts.

Equal texts are found in three combining stages, and each of them groups by the digest *and* the whole
text, so no stage trusts a digest alone:

1. every task combines the rows it holds (Spark's partial aggregate, before any shuffle),
2. partial groups are merged under a salted digest, so that a text held by a third of all rows is
   spread over ``salts`` tasks,
3. one winner per salt is combined into the winner of the group.

What is shuffled is one copy of a text per task, then one per salt, never one per row. The verdict goes
back to the rows over the 32-byte digest; only a digest shared by different texts would need the text
again, and those rows (none, as long as SHA-256 holds) take a join on the text.

Defined cases: a null text counts as empty; empty texts equal each other. Rows without ``doc_id`` rank
below every other; of a group without any ``doc_id`` one row stays. Rows that repeat both ``doc_id`` and
text are one group, of which exactly one row stays. Empty tables give no rows. Other columns of the
input never clash: they are not carried by :func:`exact_groups` and kept as they are by :func:`deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import keep_rows, ref, stored, whole_text

SALTS = 16


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(ref(id_col).alias("id"), text.alias("body"),
                       F.sha2(text.cast("binary"), 256).alias("digest"))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, body, keep_id, group_size), a row per distinct text."""
    salted = (_digested(docs, id_col, text_col)
              .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
              .groupBy("digest", "body", "salt")
              .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")))
    return (salted.groupBy("digest", "body")
            .agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id")))


def _numbered(rows: DataFrame, *same: str) -> DataFrame:
    """Rows that repeat id and text get a running number, so that one of them can stay."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", *same).orderBy(F.lit(1))))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """A row per input row: id, nth, keep_id, group_size, kept, text_sha256."""
    groups = winners(docs, id_col, text_col, salts)
    verdicts = stored(groups.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").cast("long").alias("group_size"),
        F.count(F.lit(1)).alias("texts")), "digests")
    rows = _digested(docs, id_col, text_col)
    judged = (_numbered(rows.select("id", "digest"), "digest")
              .join(verdicts.filter("texts = 1").drop("texts"), "digest"))
    clashes = verdicts.filter("texts > 1").select("digest")
    if not clashes.isEmpty():  # one digest, several texts: these rows are settled on their text
        judged = judged.unionByName(
            _numbered(rows.join(clashes, "digest", "left_semi"), "digest", "body")
            .join(groups, ["digest", "body"]).select(*judged.columns))
    return judged.select(
        "id", "nth", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col, salts).filter("kept").select("id", "text_sha256")
    digest = F.sha2(whole_text(text_col).cast("binary"), 256)
    return keep_rows(docs, {"id": ref(id_col), "text_sha256": digest}, kept)
