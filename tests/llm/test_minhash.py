import random
import re

import numpy as np

from cleanloom.llm import minhash


def set_of(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def by_hand(docs, percent=85):
    sets = [set_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(docs):
        if id_ is not None:
            least[find(i)] = min(id_, least.get(find(i), id_))
    return sorted((str(id_), len(sets[i]), str(least.get(find(i)))) for i, (id_, _) in enumerate(docs))


def got(docs):
    return sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(docs).collect())


def variants(draw, words, count, share):
    for _ in range(count):
        own = list(words)
        for at in draw.sample(range(len(own)), round(share * len(own))):
            own[at] = f"v{draw.randrange(10**9)}"
        yield " ".join(own)


def corpus(seed=1):
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.paretovariate(0.4)) % 3000}"
    docs = [" ".join(word() for _ in range(draw.randrange(1, 200))) for _ in range(80)]
    for share in (0.01, 0.02, 0.03, 0.05, 0.08):  # families on both sides of the threshold
        for _ in range(4):
            docs += variants(draw, [word() for _ in range(150)], 12, share)
    docs += [docs[3], docs[3].upper(), docs[4] + "\x0b", None, "", " \n", "one", "One", "one two", "a b c", "c b a", "É é x y z", "é é x y z"]
    rows = list(enumerate(docs))
    draw.shuffle(rows)
    return rows + [(None, docs[0]), (None, "nothing else is like it"), (None, None), (rows[0][0], "another text of that id"), rows[1]]


def test_against_all_pairs(spark, make_docs):
    docs = corpus()
    assert got(make_docs(*docs)) == by_hand(docs)


def test_crowded_bands_are_compared_in_blocks(spark, make_docs, monkeypatch):
    """A band that many unlinked nodes share loses no pair, however finely it is dealt."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "PART", 8)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(minhash, "SPREAD", 3)
    docs = corpus(2)
    assert got(make_docs(*docs)) == by_hand(docs)


def test_sets(monkeypatch):
    draw = random.Random(3)
    texts = [t for _, t in corpus()] + [" ".join(f"x{draw.randrange(50)}" for _ in range(3000)), "y" * 5000 + " z", "\t".join("ab" for _ in range(4000))]
    whole = [len(s) for s in minhash.shingle_sets(texts)]
    assert whole == [len(set_of(t)) for t in texts]
    monkeypatch.setattr(minhash, "TEXT_BYTES", 100)
    assert [a.tolist() for a in minhash.shingle_sets(texts)] == [s.tolist() for s in minhash.shingle_sets(texts)]
    cut = minhash.shingle_sets(texts)
    monkeypatch.undo()
    assert [a.tolist() for a in cut] == [s.tolist() for s in minhash.shingle_sets(texts)]


def test_estimate_is_near_the_similarity():
    draw = np.random.default_rng(4)
    for wanted in (0.0, 0.3, 0.6, 0.85, 1.0):
        errors = []
        for _ in range(40):
            both = round(wanted * 400)
            a, b = (draw.integers(0, 1 << 63, 400 - both, np.uint64) for _ in range(2))
            same = draw.integers(0, 1 << 63, both, np.uint64)
            low = np.stack([minhash.low_bits(np.concatenate([x, same])) for x in (a, b)])
            packed = minhash.planes(low)
            assert (minhash.band_values(packed)[0] == minhash.band_values(packed[:1])[0]).all()
            errors.append(minhash.estimate(packed[:1], packed[1:])[0] - both / (800 - both))
        assert abs(np.mean(errors)) < 0.02


def test_parts_of_a_set_do_not_matter(monkeypatch):
    values = np.random.default_rng(5).integers(0, 1 << 63, 1000, np.uint64)
    whole = minhash.low_bits(values)
    monkeypatch.setattr(minhash, "SET_ROWS", 7)
    assert (minhash.low_bits(values) == whole).all()


def test_rows_that_stay_keep_their_columns(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(100))
    docs = make_docs((5, text, "en"), (3, text + " x", "de"), (7, "else"), (8, None), (9, ""), (9, "")).withColumn("node", minhash.F.lit(1)).withColumn("n", minhash.F.lit(2))
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9]


def test_empty_table(spark, make_docs):
    assert minhash.near_duplicates(make_docs()).count() == 0
