import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pytest

from cleanloom.llm import filteraudit

LABELS = "doc_id long, quality int, toxic int, source string"
FINE = " ".join(f"w{i}" for i in range(200))
TEXTS = [FINE, FINE + " #", FINE.replace("w", "W"), "short", "a " * 300, "A " * 300 + "$", "", None, FINE + "\x0bx\ty\n", " " + FINE + " ", "x" * 300_000, "É" * 60 + " ab",
         FINE + " z"]


def mask_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return sum(1 << i for i, f in enumerate(fails) if f)


def by_hand(docs, labels):
    least = {}
    for id_, text, _ in docs:
        if id_ is not None:
            least[text or ""] = min(id_, least.get(text or "", id_))
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    held = defaultdict(list)
    for id_, text, part in docs:
        fails = {"ABCD"[i] for i in range(4) if mask_of(text) >> i & 1} | ({"E"} if id_ is not None and id_ > least[text or ""] else set())
        held[part or ""].append((fails, id_ in good, id_ in toxic))
    rows = []
    for part, found in held.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                before = set(order[:step - 1])
                lost = [f for f in found if own in f[0] and not f[0] & before]
                removed_by[own] += len(lost)
                rows.append([part, "".join(order), step, sum(not f[0] & (before | {own}) for f in found), len(lost), sum(own in f[0] and bool(f[0] & before) for f in found),
                             sum(f[0] == {own} for f in found), sum(f[1] for f in lost), sum(f[2] for f in lost)])
        for row in rows:
            if row[0] == part:
                row.append(removed_by[row[1][row[2] - 1]])
    return sorted(map(tuple, rows))


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Write documents into one file each batch; later files hold smaller ids, so that masks are retracted."""
    def write(batches):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        for number, rows in enumerate(batches):
            frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, digest string, part string").coalesce(1)
            frame.write.mode("append").parquet(path)
        return path
    return write


def test_masks(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r[0] for r in frame.select(filteraudit.text_mask(filteraudit.whole_text())).collect()]
    assert got == [mask_of(t) for t in TEXTS]


@pytest.mark.parametrize("core_bytes", [1, 1 << 40])
def test_against_whole_table(spark, files, core_bytes):
    draw = random.Random(5)
    docs = [(i, draw.choice(TEXTS), draw.choice(["a", "b", None, ""])) for i in draw.sample(range(1000), 60)]
    docs += [docs[0], docs[1], (None, FINE, "a"), (None, "short", None), (5000, FINE, "only"), (docs[2][0], docs[2][1], "b")]
    docs.sort(key=lambda r: -(r[0] or 0))
    labels = [(i, draw.randrange(2), draw.randrange(2), "z") for i, *_ in docs] + [(None, 1, 1, "z"), (docs[0][0], None, 1, "z"), (77777, 1, 1, "z")]
    path = files([docs[:25], docs[25:40], docs[40:], []])
    got = filteraudit.audit(spark, path, spark.createDataFrame(labels, LABELS), core_bytes=core_bytes)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == by_hand(docs, labels)


def test_smaller_ids_retract_what_was_counted(spark, files, monkeypatch):
    path = files([[(9, FINE, "late")], [(5, FINE, "early"), (7, FINE, "early")], [(5, FINE, "again")]])
    written = []
    monkeypatch.setattr(filteraudit, "scratch_path", lambda spark, name, make=filteraudit.scratch_path: written.append((name, make(spark, name))) or written[-1][1])
    counts = filteraudit.counters(spark, path, spark.createDataFrame([], LABELS), core_bytes=1).collect()
    assert sorted((r["part"], r["mask"], r["n"]) for r in counts) == [("again", 0, 1), ("early", 0, 1), ("early", 16, 1), ("late", 16, 1)]
    changes = spark.read.parquet(dict(written)["audit-changes"])
    assert changes.filter("n < 0").count() >= 1  # files of one age come in any order, but 9 and 5 are never in one batch


def test_one_record_of_a_text_reaches_its_key(spark):
    batch = pd.DataFrame({"digest": ["ff" * 16] * 1000 + ["00" * 16], "id": [*range(1000), 3], "part": "p", "mask": 1})
    [found] = filteraudit._records(iter([batch]))
    assert found["n"].sum() == 1001
    assert sorted(found.loc[found["kind"] == filteraudit.AT_LEAST, ["d1", "id"]].itertuples(index=False, name=None)) == [(-1, 0), (0, 3)]


def test_empty_table(spark, files):
    path = files([[]])
    assert filteraudit.audit(spark, path, spark.createDataFrame([], LABELS)).count() == 0
