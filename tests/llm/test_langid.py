import itertools
import random
import zlib

import numpy as np
import pytest

from cleanloom.llm import langid

SYLLABLES = {"aa": ["ka", "ro", "tim", "sel"], "bb": ["öx", "wyn", "gro", "ütz"], "cc": ["ция", "мор", "ва", "лук"]}


def prose(draw, lang, n):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    draw = random.Random(13)
    return langid.fit([(lang, prose(draw, lang, 80)) for lang in SYLLABLES for _ in range(40)])


def test_forward_backward_matches_all_labellings():
    draw = np.random.default_rng(14)
    scores, moves = draw.normal(size=(7, 3)) * 2, draw.normal(size=(3, 3))
    begins = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    expected = np.zeros((7, 3))
    for labels in itertools.product(range(3), repeat=7):
        weight = np.exp(sum(scores[t, j] for t, j in enumerate(labels))
                        + sum(moves[labels[t - 1], labels[t]] for t in range(1, 7) if not begins[t]))
        for t, j in enumerate(labels):
            expected[t, j] += weight
    expected /= expected.sum(axis=1, keepdims=True)
    for piece in (1, 2, 3, 7, 64):
        assert langid.forward_backward(scores, begins, moves, piece) == pytest.approx(expected)


def test_gradient_is_that_of_the_likelihood():
    draw = np.random.default_rng(15)
    emit, moves = draw.normal(size=(2, 5, 3)), draw.normal(size=(3, 3))
    gamma, pairs = langid._expectations(emit, moves)
    for i in range(2):
        assert gamma[i] == pytest.approx(langid.forward_backward(emit[i], np.arange(5) == 0, moves))
    assert pairs.sum() == pytest.approx(2 * 4)
    assert pairs.sum(1) == pytest.approx(gamma[:, :-1].sum((0, 1)))


def test_features_of_a_word_do_not_depend_on_the_others():
    together, starts = langid.features(["abc", "x", "abc", "öx"], {"x": 1})
    groups = np.split(together, starts[1:])
    assert sorted(groups[0]) == sorted(groups[2]) == sorted(langid.features(["abc"], {})[0])
    # ^ a b c $: five single characters, four pairs, three triples, two ends of four, one of five
    assert len(groups[0]) == 5 + 4 + 3 + 2 + 1 and langid.SLOTS + 1 in groups[1]


def test_mixed_text_is_labelled_word_by_word(spark, make_docs, model):
    draw = random.Random(16)
    parts = [("aa", 12), ("cc", 15), ("bb", 9), ("aa", 20)]
    text = " - ".join(prose(draw, lang, n) for lang, n in parts)
    truth = [lang for lang, n in parts for _ in range(n)]
    rows = sorted(langid.word_labels(make_docs((1, text), (2, None), (3, "12 ½")), model).collect(), key=lambda r: r["nth"])
    assert [r["word"] for r in rows] == [w for w in text.split() if w != "-"]
    assert np.mean([r["lang"] == t for r, t in zip(rows, truth)]) > 0.95
    assert all(0 < r["probability"] <= 1 for r in rows)


def test_predictions_do_not_depend_on_the_batch(model, monkeypatch):
    draw = random.Random(17)
    texts = [None, "", "...", "12 ½ ²", "a²b"] + [prose(draw, draw.choice(list(SYLLABLES)), draw.randint(1, 300)) for _ in range(30)]
    one = [model.predict([t]) for t in texts]
    langs, scores = model.predict(texts)
    assert langs == [o[0][0] for o in one] and scores == pytest.approx([o[1][0] for o in one])
    assert langs[:4] == ["und"] * 4 and scores[:4] == [0.0] * 4 and langs[4] != "und"
    monkeypatch.setattr(langid, "CACHED_WORDS", 5)
    assert model.predict(texts)[0] == langs


def test_held_out_accuracy(spark, make_docs):
    draw = random.Random(18)
    rows = [(i, prose(draw, lang, draw.randint(3, 60)), lang) for i in range(600) for lang in [draw.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "77", None), (None, prose(draw, "bb", 20), "aa"), (1003, prose(draw, "cc", 20), None), (5, rows[5][1], rows[5][2])]
    docs = make_docs(*rows).withColumn("score", langid.F.lit(5))
    found = langid.predicted(docs, langid.fit_on(docs)).select("doc_id", "lang", "language", langid.held_out().alias("held_out")).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert not r["held_out"] and r["language"]["lang"] == "bb"
        else:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["language"]["score"] <= 1
    test = [r for r in found if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["language"]["lang"] == r["lang"] for r in test]) > 0.98
    kept = langid.kept(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert not {1000, 1001, 1002} & set(got) and got[1003] == "cc" and sum(i is not None and i < 600 for i in got) == 600


def test_no_labelled_document(spark, make_docs):
    docs = make_docs((1, "ka ro"), (2, None))
    assert [r["language"]["lang"] for r in langid.predicted(docs, langid.fit_on(docs)).collect()] == ["und", "und"]
    assert langid.predicted(make_docs(), langid.fit_on(make_docs())).count() == 0


def test_documents_stay_without_a_model(spark, make_docs):
    docs = make_docs((1, "ka ro"), (2, None), (3, "12 !"), (4, "\u00e9"))
    assert sorted(r["doc_id"] for r in langid.kept(docs).collect()) == [1, 4]


def test_the_filter_labels_each_text_once(spark, make_docs):
    docs = make_docs(*[(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)])
    plan = langid.kept(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
