import random

import numpy as np
import pytest

from cleanloom.llm import license as lic

INDEX = lic.Index(lic.TEMPLATES)


def spans(text, **options):
    return [(t, text[a:b], m) for t, a, b, m, _, _ in lic.scan_text(INDEX, text, **options)]


def test_each_template_is_found_in_itself_and_in_prose():
    for name, text in lic.TEMPLATES.items():
        found = spans(f"é😀 some words before {text} and some after")
        assert [f[0] for f in found] == [name], name
        assert found[0][2] == len(INDEX.words[INDEX.names.index(name)]) and found[0][1].split()[0] in text


def test_variants_and_near_misses():
    assert spans("Licensed UNDER the *Apache* License\n# Version 2.0, see below")[0][:2] == ("apache-2.0-notice", "Licensed UNDER the *Apache* License\n# Version 2.0")
    assert [f[0] for f in spans("licensed under CC BY-NC 4.0 and then licensed under CC BY 4.0")] == ["cc-by-nc-4.0-notice", "cc-by-4.0-notice"]
    assert spans("It is licensed under the sea") == [] and spans("") == [] and spans(None or "") == []
    assert [f[0] for f in spans("All rights reserved. " * 3)] == ["all-rights-reserved"] * 3
    long = lic.TEMPLATES["mit"].split()
    changed = " ".join(w for i, w in enumerate(long) if i % 11)  # every eleventh word lost
    (name, _, matched), = spans(changed)
    assert name == "mit" and matched >= 0.85 * len(long)


def plain_alignment(template, words):
    """Best local alignment score without a band."""
    table = np.zeros((len(template) + 1, len(words) + 1), int)
    for i in range(1, len(template) + 1):
        for j in range(1, len(words) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (lic.MATCH if template[i - 1] == words[j - 1] else lic.MISMATCH),
                              table[i - 1, j] + lic.GAP, table[i, j - 1] + lic.GAP)
    return table.max()


def test_alignment_matches_the_whole_table():
    draw = np.random.default_rng(20)
    for _ in range(60):
        template, words = draw.integers(0, 6, draw.integers(1, 12)).astype(np.uint64), draw.integers(0, 6, draw.integers(1, 25)).astype(np.uint64)
        found = lic.align(template, words, -len(template), len(words))
        score = plain_alignment(template, words)
        assert (found[3] if found else 0) == score
        if found:
            first, last, matched, _ = found
            assert words[first] in template and words[last - 1] in template and 0 < matched <= min(len(template), last - first)


def test_winnowing_keeps_one_of_each_window():
    draw = np.random.default_rng(21)
    for n in (0, 1, 2, 3, 50):
        hashes = draw.integers(0, 1 << 60, n).astype(np.uint64)
        kept = set(lic.winnowed(hashes).tolist())
        assert all(any(p in kept for p in range(i, i + lic.WINDOW)) for i in range(max(0, n - lic.WINDOW + 1)))
        assert bool(kept) == bool(n)


def test_long_texts_are_read_in_parts(monkeypatch):
    draw = random.Random(22)
    filler = [f"w{draw.randrange(9999)}" for _ in range(4000)]
    names = ["mit-notice", "mit", "isc", "gpl-header"]
    for i, name in enumerate(names):
        filler[700 * i + 300] = lic.TEMPLATES[name]
    text = " ".join(filler)
    whole = spans(text)
    assert [f[0] for f in whole] == names
    monkeypatch.setattr(lic, "PART_BYTES", 1500)
    monkeypatch.setattr(lic, "OVERLAP_BYTES", 4000)
    assert spans(text) == whole


def test_scan(spark, make_docs):
    docs = make_docs((1, "Released under the MIT License."), (None, "x\nAll rights reserved."), (2, None), (3, ""), (4, "plain prose"), (1, "Released under the MIT License."),
                     (5, "z " * 700_000 + "Licensed under CC BY 4.0.")).withColumn("id", lic.F.lit("clash")).withColumn("template", lic.F.lit(0))
    rows = sorted((str(r["id"]), r["template"], r["start"], r["end"], r["coverage"]) for r in lic.scan(docs).collect())
    assert rows == [("1", "mit-notice", 0, 30, 1.0)] * 2 + [("5", "cc-by-4.0-notice", 1_400_000, 1_400_024, 1.0), ("None", "all-rights-reserved", 2, 21, 1.0)]
    own = lic.scan(docs, {"house": "plain prose here", "other": "x y z"}, coverage=0.6)
    assert own.count() == 0  # two of three words share no run of three
    assert lic.scan(make_docs()).count() == 0


def test_short_templates_are_refused():
    with pytest.raises(ValueError, match="fewer"):
        lic.Index({"short": "two words"})
