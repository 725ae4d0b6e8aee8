import hashlib

from cleanloom.llm import exactdedup


def test_groups(spark, make_docs):
    docs = make_docs((1, "a"), (4, "a"), (2, "b"), (3, None), (8, ""), (None, "a"), (None, "c"), (None, "c"), (6, "d"), (6, "d"), (6, "e"), (7, "x" * 300000), (9, "x" * 300000))
    rows = exactdedup.exact_groups(docs).collect()
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "b", "", "c", "d", "e", "x" * 300000)}
    got = sorted(((r["text_sha256"], str(r["id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows))
    assert got == sorted([
        (sha["a"], "1", "4", 3, False), (sha["a"], "4", "4", 3, True), (sha["a"], "None", "4", 3, False), (sha["b"], "2", "2", 1, True),
        (sha[""], "3", "8", 2, False), (sha[""], "8", "8", 2, True), (sha["c"], "None", "None", 2, True), (sha["c"], "None", "None", 2, False),
        (sha["d"], "6", "6", 2, True), (sha["d"], "6", "6", 2, False), (sha["e"], "6", "6", 1, True),
        (sha["x" * 300000], "7", "9", 2, False), (sha["x" * 300000], "9", "9", 2, True)])


def test_rows_that_stay_keep_their_columns(spark, make_docs):
    docs = make_docs((1, "a", "en"), (4, "a", "de"), (6, "d"), (6, "d"), (None, "z")).withColumn("digest", exactdedup.F.lit(1)).withColumn("n", exactdedup.F.lit(2))
    kept = exactdedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"], r["lang"]) for r in kept.collect()) == [("4", "a", "de"), ("6", "d", None), ("None", "z", None)]


def test_one_digest_with_two_texts_is_settled_on_the_text(spark, make_docs, monkeypatch):
    """A digest that cannot tell texts apart only costs time."""
    whole = exactdedup._digested
    monkeypatch.setattr(exactdedup, "_digested", lambda *a: whole(*a).withColumn("digest", exactdedup.F.lit("same")))
    rows = exactdedup.exact_groups(make_docs((1, "a"), (2, "b"), (3, "a"))).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


def test_empty_table(spark, make_docs):
    assert exactdedup.exact_groups(make_docs()).count() == 0
    assert exactdedup.deduplicate(make_docs()).count() == 0
