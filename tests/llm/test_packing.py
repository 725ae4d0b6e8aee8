import random
import zlib

import numpy as np
import pytest

from cleanloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


ODD = [None, "", "  ", "\t\n\r a ", "a~b ~ ~~ c~", "~", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "é̀ x́ ń", "A B\x0bC\x85D E", "it's don't 123 4½ x😀y",
       "İstanbul ΑΣ ΣΑΣ", "H̱ẖ", "中文 字 , . !? ---", "\x00 ퟿ �"]


def prose(draw, topic, n):
    words = [f"{topic}{a}{b}" for a in "bdgkl" for b in "aeiou"] + ["the", "of", "and", "in"] * 8
    return " ".join(draw.choices(words, k=n))


def test_ids_are_those_of_the_tokenizer(tokenizer):
    draw = random.Random(9)
    texts = ODD + [prose(draw, t, 300) for t in ("x", "Yz", "q-")]
    encode = packing.Encoder(packing.tokenizer_path())
    for _ in range(2):  # also from memory
        assert [i.tolist() for i in encode(texts)] == [
            tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_are_cut_as_the_tokenizer_cuts_them(tokenizer):
    draw = random.Random(4)
    signs = "abcXYZ019.,;:!?'\"-_()[]{}<>|/\\~^`@#$%&*+=éÉñÑßŞıİ×÷ǅ½\u0301\u0338\x7f\x01\x1c\u00a0"
    texts = ["".join(draw.choices(signs + " \n", k=draw.randint(1, 60))) for _ in range(3000)]
    texts += ["don't 'sword --'s x'll'd 12.5% (a-b) WORD, word. word", "Ñga,### cióngata&&& ÑGA", "İa ŉx ſt e\u0301, =\u0338", "a" * 5000 + ",", "1" * 3000]
    encode = packing.Encoder(packing.tokenizer_path())
    assert [i.tolist() for i in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    known = len(encode.known)
    encode(["WORD; (word) word?! word..."])  # signs beside a word make no new words of it
    assert len(encode.known) <= known + 4


def test_another_pattern_gets_whole_words(tokenizer, tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(packing.tokenizer_path())
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    encode = packing.Encoder(str(tmp_path / "other.json"))
    texts = ["word, don't 12.5 (word)", "", "a"]
    assert encode.plain is None and [i.tolist() for i in encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 10)
    encode = packing.Encoder(packing.tokenizer_path())
    texts = [f"word{chr(97 + i % 5)}{chr(97 + i // 5)} again" for i in range(50)]  # letters alone: digits are words of their own
    first = [i.tolist() for i in encode(texts)]
    assert [i.tolist() for i in encode(texts)] == first and len(encode.known) == 51


def test_every_id_lies_in_one_piece(spark, make_docs, tokenizer):
    draw = random.Random(10)
    texts = ODD + [prose(draw, "abcdefgh"[i % 8], draw.randint(1, 400)) for i in range(120)] + [prose(draw, "long", 9000)] * 2
    docs = make_docs(*[(None if i == 3 else i, t) for i, t in enumerate(texts)])
    window, shard = 512, 40
    rows = packing.pack(docs, window=window, shard_pieces=shard).collect()
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(parts) == {None if i == 3 else i for i in range(len(texts))}
    for name, own in parts.items():
        ids = tokenizer.encode(texts[3 if name is None else name] or "", add_special_tokens=False).ids + [2]
        joined = []
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == len(joined) and r["doc_tokens"] == len(ids)
            piece = np.frombuffer(r["ids"], "<u4").tolist()
            assert len(piece) == r["length"] > 0
            joined += piece
        assert joined == ids
    short = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        short += at < window
    assert short <= -(-len(texts) // shard)  # one per shard


def test_checksum(spark, make_docs, tokenizer):
    row = packing.pack(make_docs((1, "two words"))).select(packing.F.crc32("ids").alias("c")).first()
    ids = tokenizer.encode("two words", add_special_tokens=False).ids + [2]
    assert row["c"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_neighbours_share_rare_tokens(spark, make_docs):
    """Documents of a topic come together although they are dealt at random."""
    draw = random.Random(11)
    topics = ["zyx", "kwq", "vbn", "jhg"]
    docs = make_docs(*[(i, prose(draw, topics[i % 4], 60)) for i in range(200)])
    together = {}
    for r in packing.pack(docs, window=1024).collect():
        together.setdefault(r["sequence_id"], []).append(r["doc_id"] % 4)
    same = np.mean([max(np.bincount(m)) / len(m) for m in together.values()])
    assert same > 0.8


def test_neighbours_meet_over_many_shards(spark, make_docs):
    """Topics come together whatever the number of shards, and no shard grows with a topic."""
    draw = random.Random(13)
    words = [f"{a}{b}" for a in "bcdfghjkl" for b in ("orn", "ump", "alk", "ist")]
    topics = [draw.choice(words) + w for w in words[:20]]
    common = ["house", "water", "green", "stone", "light"]
    docs = make_docs(*[(i, " ".join(draw.choices([topics[i % 20], *common], k=60))) for i in range(400)])
    together = {}
    for r in packing.pack(docs, window=512, shard_pieces=20).collect():
        together.setdefault(r["sequence_id"], []).append(r["doc_id"] % 20)
    assert np.mean([max(np.bincount(m)) / len(m) for m in together.values()]) > 0.6
    count = np.array([3, 5000, 1, 700])
    first, spread = packing._shards_of(count, 100)
    shards = np.concatenate([(f + np.arange(n) % s) // 100 for f, n, s in zip(first, count, spread)])
    assert np.bincount(shards).max() <= 200 and shards.max() < -(-count.sum() // 100)


def test_scores_match_the_formula():
    draw = np.random.default_rng(12)
    ids = [draw.integers(0, 30, draw.integers(1, 60)) for _ in range(12)]
    idf = draw.random(30)
    index = packing.Index(ids, idf, 20.0)
    for q in range(12):
        for d, score in enumerate(index.scores(q)):
            wanted = 0.0
            for t in set(ids[q].tolist()):
                n = int((ids[d] == t).sum())
                wanted += idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ids[d]) / 20.0))
            assert score == pytest.approx(wanted)


def test_empty_table(spark, make_docs):
    assert packing.pack(make_docs()).count() == 0


def test_terms_and_keys_of_many_pieces_at_once():
    """One sort for all pieces gives what a look at each piece gives."""
    draw = np.random.default_rng(5)
    idf, shared = draw.random(50), draw.random(50) < 0.6
    for kind in ("<u2", "<u4"):
        ids = [draw.integers(0, 50, int(n)).astype(kind) for n in draw.integers(1, 40, 300)]
        owner, token, count = packing._terms(ids)
        keys = packing._keys(ids, idf, shared, 20.0)
        for i, piece in enumerate(ids):
            terms, counts = np.unique(piece, return_counts=True)
            assert token[owner == i].tolist() == terms.tolist() and count[owner == i].tolist() == counts.tolist()
            weight = np.where(shared[terms], packing._weight(idf[terms], counts, len(piece), 20.0), -1.0)
            assert keys[i] == terms[weight.argmax()]
    assert [list(range(*r)) for r in packing._groups([3, 1, 9, 1, 1], 4)] == [[0, 1], [2], [3, 4]]


def test_words_that_share_a_slot(monkeypatch):
    """Words are found whichever of them holds the slot of the table."""
    texts = [" ".join(f"word{i * 7 % 90}x" for i in range(n, n + 60)) for n in range(0, 200, 20)] + [None, "", "  "]
    plain = packing.Encoder(packing.tokenizer_path())
    wanted = [plain.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "SLOT_BITS", 3, raising=False)
    few = packing.Encoder(packing.tokenizer_path())
    for _ in range(2):
        assert [i.tolist() for t in texts for i in few([t])] == wanted
    assert len(few.slots) == 8 < len(few.known)
