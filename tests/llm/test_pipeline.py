import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


def prose(draw, lang, n):
    parts = {"en": ["the", "ing", "ton", "er"], "de": ["ung", "sch", "über", "en"], "fr": ["eau", "é", "tion", "lle"]}[lang]
    return " ".join("".join(draw.choices(parts, k=draw.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, make_docs):
    draw = random.Random(23)
    rows = []
    for i in range(160):
        lang = ["en", "de", "fr"][i % 3]
        lines = [prose(draw, lang, draw.randint(8, 60)) for _ in range(draw.randint(1, 5))]
        rows.append((i, "\n".join(lines), lang, f"src{i % 4}"))
    rows.append((500, rows[10][1], "de", "src1"))  # a copy: its lines go, and an empty text is left
    rows.append((501, rows[11][1].replace(" ", "  ", 3) + " one more", "fr", None))
    rows += [(502, None, "en", "src0"), (503, "1234 5678 !!!", "en", "src0"), (504, "", None, "src2"), (505, rows[12][1] + "\n" + prose(draw, "en", 50), None, "src3")]
    folder = tmp_path_factory.mktemp("tables")
    make_docs(*rows).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages_keep_the_columns(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder).cache()
        assert after.dtypes == docs.dtypes, name
        kept[name] = after.collect()
        docs = after
    assert {r["doc_id"] for r in kept["language"]} == {r[0] for r in rows} - {502, 503, 504}
    assert {r["doc_id"]: r["lang"] for r in kept["language"]}[505] is not None
    assert len(kept["lines"]) == len(kept["language"])
    lines = {r["doc_id"]: r for r in kept["lines"]}
    assert lines[500]["text"] == "" and lines[500]["n_chars"] == 0 and lines[505]["text"].count("\n") == 0
    assert {r["doc_id"]: r["text"] for r in kept["lines"] if r["doc_id"] < 160} == {r[0]: r[1] for r in rows[:160]}
    near = {r["doc_id"] for r in kept["near_duplicates"]}
    assert set(range(160)) <= near
    counts = {}
    for r in kept["mixing"]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts) <= near and max(counts.values()) <= 3


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(fill.values()) <= 4096


def test_empty_table(spark, tmp_path, make_docs):
    make_docs().write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
