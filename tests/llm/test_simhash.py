import random

import numpy as np
import pytest
import xxhash

from cleanloom.llm import simhash

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    """{position: smallest position reachable} by comparing everything with everything."""
    found = list(range(len(fps)))

    def top(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                found[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    draw = random.Random(1)
    texts = [None, "", " \t", "One", "one two", "One two THREE", "É é É é", "a\x0bb\x85c d", "x " * 400]
    texts += [" ".join(draw.choices(WORDS, k=draw.randint(1, 200))) for _ in range(30)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(random.Random(2).choices(WORDS, k=5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 97)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_golay_code_is_perfect():
    """All error patterns have remainders of their own, and two errors or less always share a key."""
    assert len(np.unique(simhash._ERRORS)) == 1 << simhash.GOLAY_CHECKS
    draw = np.random.default_rng(3)
    fps = draw.integers(0, 1 << 63, 400, np.uint64)
    for bits in (0, 1, 2):
        other = fps.copy()
        for i in range(len(fps)):
            for b in draw.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        keys, owners = simhash.golay_keys(np.concatenate([fps, other]))
        for i in range(len(fps)):
            assert set(keys[owners == i]) & set(keys[owners == i + len(fps)])


@pytest.mark.parametrize("bucket", [2, 16])
def test_components_match_brute_force(spark, make_docs, bucket):
    """Also when most keys are too large to pair up."""
    draw = random.Random(4)
    centre = draw.getrandbits(64)
    fps = [centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(150)]
    fps += [draw.getrandbits(64) for _ in range(50)] + [0, 3, 7]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    from cleanloom.llm.components import components

    found = {r["vertex"]: r["root"] for r in components(simhash.links(nodes, bucket=bucket)).collect()}
    label = [signed.index(found.get(f, f)) for f in signed]
    expected = plain_components(fps)
    classes = {}
    assert all(classes.setdefault(e, g) == g for e, g in zip(expected, label))
    assert len(set(label)) == len(set(expected))


def test_keys_that_run_over_batches():
    """A key that fills several batches is large in all of them."""
    import pandas as pd

    keys = np.sort(np.array([1] * 2 + [5] * 40 + [6] * 16 + [7] * 17 + [9]))
    fps = np.arange(len(keys)) * 1024 + 7
    batches = [pd.DataFrame({"key": keys[i:i + 7], "fp": fps[i:i + 7]}) for i in range(0, len(keys), 7)]
    out = pd.concat(simhash._pair_up(2, 16)(iter(batches)))
    assert sorted(out[out.a == out.b].a) == sorted(fps[(keys == 5) | (keys == 7)])
    assert set(zip(out[out.a != out.b].a, out[out.a != out.b].b)) == {
        (fps[i], fps[j]) for i in range(len(fps)) for j in range(i + 1, len(fps))
        if keys[i] == keys[j] and keys[i] not in (5, 7) and int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_groups_and_rows_that_stay(spark, make_docs):
    draw = random.Random(5)
    base = " ".join(draw.choices(WORDS, k=400))
    other = " ".join(draw.choices(WORDS, k=300))
    docs = make_docs((5, base), (3, base), (9, other), (9, other), (9, "one line only"), (7, None), (2, ""), (None, base), (None, "alone here"))
    rows = {(r["id"], r["fp"] & (1 << 64) - 1): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    top = plain_fingerprint(base)
    assert rows[(5, top)] == rows[(3, top)] == rows[(None, top)] == 3
    assert rows[(7, 0)] == rows[(2, 0)] == 2
    assert rows[(None, plain_fingerprint("alone here"))] is None
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [
        (3, base), (9, other), (9, "one line only"), (2, ""), (None, "alone here")]))


def test_empty_table(spark, make_docs):
    assert simhash.near_duplicates(make_docs()).count() == 0
    assert simhash.deduplicate(make_docs()).count() == 0
