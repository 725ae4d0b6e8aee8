import random

import numpy as np
import pytest

from cleanloom.llm import linededup as ld


def line_set(line):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    for c in "\t\v\f\r":
        words = words.replace(c, " ")
    return frozenset(w for w in words.split(" ") if w)


def plain(rows):
    """{(id, text): (lines, removed, links)} by comparing all lines."""
    documents = {(i, t) for i, t, *_ in rows}
    tags = {}
    occurrences = []
    for i, t in documents:
        for n, line in enumerate((t or "").split("\n")):
            if line_set(line):
                occurrences.append((i is None, i or 0, tags.setdefault(t, t), n, i, t, line_set(line)))
    first = {}
    for o in sorted(occurrences, key=lambda o: o[:4]):
        first.setdefault(o[6], o[:4])
    sets = list(first)
    links, earlier = dict.fromkeys(sets, 0), dict.fromkeys(sets, False)
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
                earlier[a] |= first[b] < first[a]
                earlier[b] |= first[a] < first[b]
    out = {}
    for o in occurrences:
        lines, removed, linked = out.get((o[4], o[5]), (0, [], 0))
        gone = earlier[o[6]] or o[:4] > first[o[6]]
        out[(o[4], o[5])] = (lines + 1, sorted(removed + [o[3]] * gone), linked + links[o[6]])
    return out


def found(docs, **options):
    texts = {r["tag"]: r["text"] for r in ld._texts(docs, "doc_id", "text").collect()}
    return {(r["id"], texts[r["tag"]]): (r["lines"], r["removed"], r["links"]) for r in ld.document_verdicts(docs, **options).collect()}


def corpus(draw, documents=60):
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    lines = [" ".join(draw.choices(words, k=draw.choice([1, 2, 3, 5, 9, 20, 45]))) for _ in range(120)]
    lines += ["", "  ", "the", "the the", "The OF", "\x0bthe\rof"]

    def changed(line):
        parts = line.split(" ")
        for _ in range(draw.randint(0, 3)):
            parts[draw.randrange(len(parts))] = draw.choice(words)
        draw.shuffle(parts)
        return " ".join(parts)

    return ["\n".join(changed(draw.choice(lines)) for _ in range(draw.randint(1, 12))) for _ in range(documents)]


@pytest.mark.parametrize("options", [{}, {"dense": 0, "block": 3}, {"frequent": 2}, {"frequent": 2, "dense": 0.4, "block": 2}, {"frequent": 0, "list_size": 1, "block": 1000}])
def test_matches_brute_force(spark, make_docs, options):
    """Whatever is taken as a frequent word or as a long list."""
    draw = random.Random(19)
    rows = [(i * 7 % 61, t) for i, t in enumerate(corpus(draw))] + [(500, None), (501, ""), (502, "\n\n")]
    assert found(make_docs(*rows), **options) == plain(rows)


def test_large_group_of_variants(spark, make_docs):
    """Each variant of a long line is linked to all others, and only the first stays."""
    base = [f"base{i}" for i in range(60)]
    rows = [(i, "\n".join([" ".join([*base[: i % 50], f"x{i}", *base[i % 50 + 1:]]), f"own line of {i} and {i * i} only"])) for i in range(150)]
    got = found(make_docs(*rows), block=32)
    assert got == plain(rows)
    assert got[rows[0]] == (2, [], 149) and got[rows[99]] == (2, [0], 149)


def test_lists_that_run_over_batches():
    """Copies from several tasks count once, and a long list is long in all its parts."""
    import pandas as pd

    rows = [(1, c) for c in (5, 5, 9)] + [(2, c) for c in range(40) for _ in range(3)] + [(3, 7)] + [(4, c) for c in (1, 2, 3, 4, 4, 4)] + [(5, c) for c in range(5)]
    frame = pd.DataFrame({"k1": [r[0] for r in rows], "k2": 0, "cls": [r[1] for r in rows], "extent": 10 << 32 | 9}).astype("int64")
    frame["more"] = 0
    out = pd.concat(ld._pair_lists(100, 12)(iter(batches_of(frame))))
    crowd, pairs = out[out.crowd], out[~out.crowd]
    assert set(crowd.a) | set(crowd.b) == set(range(40))  # the list of 40 is too long to be looked at
    links = {(min(a, b), max(a, b)) for a, b in zip(crowd.a, crowd.b)}
    groups = {c: c for c in range(40)}
    for a, b in sorted(links):
        old, new = groups[b], groups[a]
        groups = {c: new if g == old else g for c, g in groups.items()}
    assert len(set(groups.values())) == 1  # all tied together, over all batches
    few = {(5, 9)} | {(a, b) for b in range(5) for a in range(b) if (a ^ b).bit_count() <= 2}  # the parity filter drops (3, 4)
    assert set(zip(pairs.a, pairs.b)) == few


def batches_of(frame, size=4):
    return [frame.iloc[i:i + size].reset_index(drop=True) for i in range(0, len(frame), size)]


def test_hashed_words_and_parts(monkeypatch):
    text = "Ab  ab\n\n\x0bAB é\tÉ\n" + "long " * 50 + "\nlast"
    hashes, lines = ld.hashed_words(text.encode())
    assert lines.tolist() == [0, 0, 2, 2, 2] + [3] * 50 + [4]
    assert hashes[0] == hashes[1] == hashes[2] and len(set(hashes.tolist())) == 5
    whole = [(n, d) for n, d in ld._parts(text)]
    monkeypatch.setattr(ld, "PART_BYTES", 4)
    parts = list(ld._parts(text))
    assert len(whole) == 1 and len(parts) > 1 and "\n".join(d.decode() for _, d in parts) == text
    assert [n for n, _ in parts] == [text.encode()[:text.encode().index(d)].count(b"\n") if d else n for n, d in parts]


def test_lines_of_all_lengths_meet_the_parity_filter():
    """Long lines that share their rarest word alone are no candidates, whatever their lengths."""
    import pandas as pd

    rarity = np.full(1 << ld.BUCKET_BITS, 100, np.uint8)
    rarity[ld.hashed_words(b"shared")[0][0] >> np.uint64(64 - ld.BUCKET_BITS)] = 0
    lines = ["shared " + " ".join(f"a{i}x{j}" for j in range(n - 1)) for i, n in enumerate([40, 46, 47, 48, 50, 52, 55])]
    lines.append(lines[-1].replace("a6x0 ", ""))  # one that matches
    batch = pd.DataFrame({"id": 1, "tag": 1, "text": ["\n".join(lines)]})
    held = type("Held", (), {"value": rarity})
    rows = pd.concat(ld._emit_postings(held, 127)([batch]))
    rows = rows.assign(size=rows.extent.to_numpy() >> 32).sort_values(["k1", "k2", "size", "cls"], ignore_index=True)[["k1", "k2", "cls", "parity", "more", "extent"]]
    out = pd.concat(ld._pair_lists(ld.DENSE, ld.LIST)(iter([rows])))
    sets = ld.Sets("\n".join(lines).encode(), rarity)
    assert {(min(a, b), max(a, b)) for a, b in zip(out.a, out.b)} == {(min(sets.cls[-2:]), max(sets.cls[-2:]))}


def test_word_counts_travel_in_small_rows(monkeypatch):
    """A task of few words sends few counts, not the whole table, and of many in bounded rows."""
    import pandas as pd

    monkeypatch.setattr(ld, "COUNTS_IN_ROW", 100, raising=False)
    batch = pd.DataFrame({"id": [1, 2], "tag": 0, "text": [" ".join(f"w{i}" for i in range(250)), "w1 w1\nw1 w2"]})
    sent = [c for out in ld._count([batch]) for c in out["counts"] if c is not None]
    assert len(sent) == 3 and max(map(len, sent)) <= 100 * 12
    table = np.zeros(1 << ld.BUCKET_BITS, np.int64)
    for part in sent:
        table[np.frombuffer(part, ld.COUNTED)["bucket"]] += np.frombuffer(part, ld.COUNTED)["n"]
    bucket = ld.hashed_words(b"w1 w2 w249")[0] >> np.uint64(64 - ld.BUCKET_BITS)
    assert table[bucket].tolist() == [3, 2, 1] and table.sum() == 253


def test_hashes_do_not_depend_on_the_place():
    words = [f"word{i}".encode() for i in range(500)]
    alone = [int(ld.hashed_words(w)[0][0]) for w in words]
    assert ld.hashed_words(b" ".join(words))[0].tolist() == alone and len(set(alone)) == 500


def test_short_lines_have_classes_of_their_own(spark, make_docs):
    """A million lines of one word, and as many of two."""
    for lines in ((f"id{i}" for i in range(1_000_000)), (f"id{i % 1000} of{i // 1000}" for i in range(1_000_000))):
        assert len(np.unique(ld.Sets("\n".join(lines).encode(), None).cls)) == 1_000_000
    # These words once shared their numbers of 64 bits, 40 of them parities.
    assert found(make_docs((1, "id645685\nid617425"), (2, "id1075610\nid1404445"))) == {
        (1, "id645685\nid617425"): (2, [], 0), (2, "id1075610\nid1404445"): (2, [], 0)}


def test_clean_texts(spark, make_docs):
    docs = make_docs((2, "one two three four five\nkeep this", "en"), (1, "ONE two three four five\n\nother words here"), (3, "keep this"), (None, "keep this\nnew line at last"),
                     (4, None), (2, "one two three four five\nkeep this", "en"), (5, "a" * 3_000_000 + " b")).withColumn("tag", ld.F.lit("clash")).withColumn("line", ld.F.lit(1))
    clean = ld.remove_repeats(docs)
    assert clean.columns == docs.columns
    got = sorted(((str(r["doc_id"]), r["text"] and r["text"][:40], r["n_chars"]) for r in clean.collect()), key=str)
    assert got == sorted([("2", "keep this", 9), ("2", "keep this", 9), ("1", "ONE two three four five\n\nother words here"[:40], 41), ("3", "", 0),
                          ("None", "new line at last", 16), ("4", None, None), ("5", "a" * 40, 3_000_002)], key=str)


def test_empty_table(spark, make_docs):
    assert ld.document_verdicts(make_docs()).count() == 0
    assert ld.remove_repeats(make_docs()).count() == 0


def postings_of(lines, frequent_class=127):
    import pandas as pd

    held = type("Held", (), {"value": np.zeros(1 << ld.BUCKET_BITS, np.uint8)})
    return pd.concat(ld._emit_postings(held, frequent_class)([pd.DataFrame({"id": 1, "tag": 1, "text": ["\n".join(lines)]})]), ignore_index=True)


def test_postings_travel_many_in_a_row(monkeypatch):
    """Rows are few, ranges ascend with the keys, and every posting arrives once, those of a key in one range."""
    import pandas as pd

    rows = postings_of([" ".join(f"w{(i * 7 + j * j) % 900}" for j in range(30)) for i in range(500)])
    monkeypatch.setattr(ld, "PACK_ROWS", 1000)
    sent = pd.concat(ld._pack(iter(batches_of(rows, 300)), 8), ignore_index=True)
    assert len(sent) <= 8 * (len(rows) // 1000 + 1) and set(sent.span) == set(range(8))
    sent = sent.sort_values("span", kind="stable", ignore_index=True)
    got = list(ld._unpack(batches_of(sent, 5)))
    spans = [g.span.iloc[0] for g in got]
    assert spans == sorted(spans)
    got = pd.concat(got)
    assert got.groupby("k1").span.nunique().max() == 1
    assert (got.groupby("span").k1.max().to_numpy()[:-1] < got.groupby("span").k1.min().to_numpy()[1:]).all()
    columns = list(rows.columns)
    assert got[columns].sort_values(columns, ignore_index=True).equals(rows.sort_values(columns, ignore_index=True))


def test_lists_of_unordered_parts_of_a_range():
    """Parts of a range come one after the other, each with keys of its own order; a long list spread over them is tied as one."""
    import pandas as pd

    few = [(5, c) for c in (1, 2, 3)] + [(9, c) for c in (4, 5)]
    rows = [(7, 100 + c) for c in range(50)] + few + [(7, 120 + c) for c in range(60)]
    random.Random(3).shuffle(rows)
    frame = pd.DataFrame({"k1": [r[0] for r in rows], "k2": 0, "cls": [r[1] for r in rows], "extent": 10 << 32 | 9}).astype("int64").assign(parity=0, more=0, span=0)
    other = frame.assign(k1=frame.k1 + 10, cls=frame.cls + 1000, span=1)
    out = pd.concat(ld._pair_lists(100, 20)(iter(batches_of(frame, 7) + batches_of(other, 7))))
    crowd, pairs = out[out.crowd], out[~out.crowd]
    base = {(1, 2), (1, 3), (2, 3), (4, 5)}
    assert set(zip(pairs.a, pairs.b)) == base | {(a + 1000, b + 1000) for a, b in base}
    for shift in (0, 1000):
        group, links = {100 + shift}, set(zip(crowd.a, crowd.b))
        for _ in range(len(links)):
            group |= {x for link in links if group & set(link) for x in link}
        assert group == set(range(100 + shift, 180 + shift))


def test_words_of_a_line_stay_once_and_in_order(monkeypatch):
    """Whatever slots they share, and where the beginnings of words are equal."""
    draw = random.Random(8)
    lines = [[f"v{draw.randrange(30)}" for _ in range(draw.randint(1, 25))] for _ in range(300)]
    data = "\n".join(" ".join(line) for line in lines).encode()
    rarity = np.array([i * 37 % 128 for i in range(1 << ld.BUCKET_BITS)], np.uint8)
    whole = ld.Sets(data, rarity)
    for bits in (1, 4, 18):
        monkeypatch.setattr(ld, "SLOT_BITS", bits)
        sets = ld.Sets(data, rarity)
        assert sets.size.tolist() == [len(set(line)) for line in lines]
        assert sets.cls.tolist() == whole.cls.tolist() and sets.words.tolist() == whole.words.tolist()
        for start, size in zip(sets.start, sets.size):
            assert (np.diff(sets.words[start:start + size].astype(np.int64)) > 0).all()
    some = ld.Sets(data)
    some.only(np.arange(300) % 3 == 1)
    some.put_in_order(rarity)
    assert some.cls.tolist() == whole.cls[1::3].tolist()
    assert some.words.tolist() == [w for s, n in zip(whole.start[1::3], whole.size[1::3]) for w in whole.words[s:s + n].tolist()]
    close = ld.Sets(b"a b")
    close.hashes = np.array([5 << 30 | 9 << 8, 5 << 30 | 3 << 8], np.uint64)  # one beginning
    close.put_in_order(np.zeros(1 << ld.BUCKET_BITS, np.uint8))
    assert (np.diff(close.words.astype(np.int64)) > 0).all()
