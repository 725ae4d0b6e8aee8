import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cleanloom.llm import pii

# The base patterns as the contract states them.
STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def texts():
    draw = random.Random(6)
    parts = ["a@b.c", "@", ".", "-", " ", "  ", "+", "%", "_", "(", ")", "1", "22", "255", "256", "000255", "4111111111111111", "4111 1111-1111 1111",
             "+49 (30) 123.456-78", "+1", "10.0.0.1", "1.2.3.4.5", "x", "mail", "É", "😀", "\n", "me@ex-ample.co.uk", "99999999999999999999.1.1.1", "0"]
    fixed = [None, "", "a@b", "x@y.com_z@w.org", "1.2.3.4@5.6.7.8.9", "+" + "1" * 15, "+" + "1" * 16, "1" * 4000, "a" * 50000, "1-" * 5000, "+1" + " " * 3000 + "2",
             "é😀 a@b.cd 4111111111111111"]
    return fixed + ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(1500)]


def test_base_spans_match_the_stated_patterns(spark, make_docs):
    wanted = texts()
    rows = pii.base_matches(make_docs(*enumerate(wanted))).select("id", pii.spans_text(F.col("found")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in rows} == {i: plain_spans(t) for i, t in enumerate(wanted)}


NAMES = ["quine", "zorbat", "velkin"]


@pytest.fixture(scope="module")
def corpus(make_docs):
    """Three owners whose names stand only near their address, common words everywhere, and plain documents."""
    draw = random.Random(7)
    common = ["the", "water", "house", "green", "stone", "walks", "under", "light"]
    fill = lambda n: " ".join(draw.choices(common, k=n))
    docs, n = [], 0
    for i, name in enumerate(NAMES):
        for _ in range(4):
            docs.append((n, f"{fill(20)} {name.title()} writes from {name}{i}@mail.example.org {fill(20)}"))
            n += 1
    docs += [(n + i, fill(60)) for i in range(300)]
    docs += [(1000, f"{fill(5)} Quine {fill(5)}"), (1001, None), (None, f"once unique@mail.example.org {fill(4)} singular"), (1002, "")]
    docs += [(1003 + i, "copied bytheway rareword at copy@mail.example.org onceonly") for i in range(9)]
    return make_docs(*docs)


def test_telling_terms(spark, corpus):
    rows = {r["id"]: r for r in pii.find(corpus).select(
        "id", pii.spans_text(F.col("base")).alias("base"), pii.spans_text(F.col("spans")).alias("spans"), "tag").collect()}
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for i, r in rows.items():
        marked = {(s.split(":")[0], text[i][int(s.split(":")[1]):int(s.split(":")[2])].lower()) for s in r["spans"].split(",") if s}
        assert r["base"] == plain_spans(text[i])
        if i is not None and i < 12:
            name = NAMES[i // 4]
            # The first name is seen once elsewhere, the others nowhere else. "writes" and "from" tell less than half.
            assert {m for m in marked if m[0] in ("term", "secret")} == {("term" if name == "quine" else "secret", name)}
        else:
            assert not {m for m in marked if m[0] in ("term", "secret")}  # plain documents, one context, copies of one context


def brute_force(rows):
    """{(entity, term): disclosure} by reading every text."""
    import math

    words = [m[0].lower() for r in rows for m in re.finditer(r"(?<!\S)[^\W\d_]{3,}(?=[.,;:!?]?(?:\s|$))", r["text"] or "")]
    seen, joint = {}, {}
    for r in rows:
        text = r["text"] or ""
        for m in re.finditer(STATED["email"], text):
            before, after = text[max(0, m.start() - 64):m.start()], text[m.end():m.end() + 64]
            seen.setdefault(m[0].lower(), set()).add((before, after))
            near = [x for x in re.finditer(r"(?<!\S)[^\W\d_]{3,}(?=[.,;:!?]?(?:\s|$))", before) if x.end() < len(before) and (x.start() or len(before) < 64)]
            near += [x for x in re.finditer(r"(?<!\S)[^\W\d_]{3,}(?=[.,;:!?]?(?:\s|$))", after) if x.start() and (x.end() < 63 or len(after) < 64)]
            for x in near:
                joint.setdefault((m[0].lower(), x[0].lower()), set()).add((before, after))
    total = len(words)
    return {("email:" + e, t): math.log2(len(c) * total / (len(seen[e]) * words.count(t))) / math.log2(total / len(seen[e]))
            for (e, t), c in joint.items() if len(c) >= 3}


def test_disclosure_matches_brute_force(spark, corpus):
    base = pii.base_matches(corpus)
    contexts = base.select("id", "tag", F.explode("found").alias("f")).select("id", "tag", "f.*").withColumn("context", F.xxhash64("before", "after"))
    got = pii.disclosures(pii._context_terms(contexts), contexts, pii.term_counts(corpus), threshold=-99.0).collect()
    assert {(r["entity"], r["term"]): r["disclosure"] for r in got} == pytest.approx(brute_force(corpus.collect()))


def test_sanitise(spark, make_docs, corpus):
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(corpus.withColumn("tag", F.lit(1)).withColumn("spans", F.lit(2))).collect()}
    assert clean[1001] is None and clean[1002] == "" and "[TERM] writes from [EMAIL]" in clean[0] and "  writes from [EMAIL]" in clean[5]
    assert clean[1000] == {r["doc_id"]: r["text"] for r in corpus.collect()}[1000]
    one = pii.sanitise(make_docs((1, "é +4915112345678, 4111111111111111, 10.0.0.1 end"), (1, "é +4915112345678, 4111111111111111, 10.0.0.1 end"))).collect()
    assert [r["text"] for r in one] == ["é [PHONE], [CARD], [IP] end"] * 2


def _spans(docs):
    return {r["id"]: r["s"] for r in pii.find(docs).select("id", pii.spans_text(F.col("spans")).alias("s")).collect()}


def test_copies_change_nothing(spark, corpus):
    """Every document ten times over discloses the same."""
    copies = corpus.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9)))).drop("n")
    once = _spans(corpus)
    assert any("secret" in s for s in once.values()) and any("term" in s for s in once.values())
    assert _spans(copies) == once


def test_terms_in_the_whole_text(spark, make_docs):
    """A telling name far from the address, more than once and in other cases, goes everywhere in texts that hold the address."""
    draw = random.Random(8)
    fill = lambda n: " ".join(draw.choices(["the", "water", "house", "green", "stone", "walks", "under", "light"], k=n))
    docs = [(i, f"{fill(30)} Zorbat, {fill(30)} ZORBAT {fill(10)} \u0130stvan {fill(30)} zorbat@mail.example.org {fill(3)}") for i in range(4)]
    docs += [(i + 10, f"{fill(5)} Quine {fill(40)} Quine {fill(3)} quine@mail.example.org Quine {fill(20)}") for i in range(4)]
    docs += [(20, f"{fill(5)} Quine {fill(5)}")] + [(100 + i, fill(60)) for i in range(300)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make_docs(*docs)).collect()}
    assert not any(w in clean[i].lower() for i in range(4) for w in ("zorbat", "stvan"))
    assert all("quine" not in clean[i + 10].lower() and clean[i + 10].count("[TERM]") == 3 for i in range(4))
    assert clean[20] == docs[8][1]


WORD = r"(?<!\S)[^\W\d_]{3,}(?=[.,;:!?]?(?:\s|$))"


def class_of(kind, value):
    part = {"email": value.rsplit("@")[-1], "ip": value.rpartition(".")[0], "card": value[:6], "phone": value[:-4]}[kind]
    return f"class {kind}:{part}"


def plain_sparse(rows, threshold=pii.THRESHOLD, support=pii.SUPPORT):
    """{id: places} that stand near an entity and tell of it or its class, by reading every text; ids and texts are different."""
    import math

    words, near = [], []
    for r in rows:
        text = r["text"] or ""
        words += [m[0].lower() for m in re.finditer(WORD, text)]
        for span in filter(None, plain_spans(text).split(",")):
            kind, start, end = span.split(":")[0], int(span.split(":")[1]), int(span.split(":")[2])
            digits = re.sub("[^0-9]", "", text[start:end])
            value = {"email": text[start:end].lower(), "ip": text[start:end]}.get(kind, digits)
            # The window reaches to the neighbouring match of the kind, valid or not.
            matches = [m for m in re.finditer(STATED[kind], text)]
            at = [m.start() for m in matches].index(start)
            before = text[max(matches[at - 1].end() if at else 0, start - 64):start]
            after = text[end:min(matches[at + 1].start() if at + 1 < len(matches) else len(text), end + 64)]
            found = [(x, start - len(before)) for x in re.finditer(WORD, before) if x.end() < len(before) and (x.start() or len(before) < 64)]
            found += [(x, end) for x in re.finditer(WORD, after) if x.start() and (x.end() < 63 or len(after) < 64)]
            for owner in (f"{kind}:{value}", class_of(kind, value)):
                near.append((r["doc_id"], owner, (before, after), [(x[0].lower(), x.start() + o, x.end() + o) for x, o in found]))
    total, out = len(words), {}
    seen, different, joint, apart = {}, {}, {}, {}
    for i, owner, context, found in near:
        seen.setdefault(owner, set()).add((i, context))
        different.setdefault(owner, set()).add(context)
        for term, _, _ in found:
            joint.setdefault((owner, term), set()).add((i, context))
            apart.setdefault((owner, term), set()).add(context)
    for i, owner, _, found in near:
        for term, start, end in found:
            c, e, n = len(joint[owner, term]), len(seen[owner]), words.count(term)
            share = math.log2(c * total / (e * n)) / math.log2(total / e)
            if len(apart[owner, term]) >= min(support, len(different[owner])) and share >= threshold:
                place = out.setdefault(i, {})
                place[start, end] = min("secret" if c >= n else "term", place.get((start, end), "term"))
    return {i: {f"{kind}:{a}:{b}" for (a, b), kind in places.items()} for i, places in out.items()}


def sparse_spans(docs, **options):
    rows = pii.find(docs, sparse=True, **options).select("id", pii.spans_text(F.col("spans")).alias("s"), pii.spans_text(F.col("base")).alias("b"))
    return {r["id"]: (r["b"], {s for s in r["s"].split(",") if s.startswith(("term", "secret"))}) for r in rows.collect()}


def test_sparse_entities_match_brute_force(spark, make_docs):
    """Entities seen once, classes of such entities, and copies of a text, against a reading of every text."""
    draw = random.Random(9)
    fill = lambda n: " ".join(draw.choices(["the", "water", "house", "green", "stone", "walks", "under", "light"], k=n))
    docs = [(i, f"{fill(30)} acmeworks {fill(2)} p{i}@acme.example.org {fill(3)} nick{chr(97 + i)}. {fill(20)}") for i in range(5)]
    docs += [(10 + i, f"{fill(9)} netname 10.1.7.{i} {fill(4)} callers +49 30 5550 {1000 + i} {fill(9)}") for i in range(6)]
    docs += [(20, f"{fill(9)} Solo {fill(2)} 4111111111111111, Paul \U0001f600 x@y.org Petra, {fill(9)}"), (21, fill(7) + " Paul"), (22, None), (23, "")]
    docs += [(24, "word q@w.org wordy e@r.org, q@w.org"), (25, "x@y.org")]
    docs += [(100 + i, fill(60)) for i in range(200)]
    rows = make_docs(*docs).collect()
    wanted = plain_sparse(rows)
    got = sparse_spans(make_docs(*docs))
    assert {i: places for i, (_, places) in got.items() if places} == wanted
    assert {i: base for i, (base, _) in got.items()} == {r["doc_id"]: plain_spans(r["text"]) for r in rows}
    marked = {rows[i]["text"][int(s.split(":")[1]):int(s.split(":")[2])] for i in range(5) for s in wanted[i]}
    assert marked == {"acmeworks", *(f"nick{c}" for c in "abcde")}
    assert not any(i >= 100 or i in (21, 22, 23) for i in wanted)
    copies = make_docs(*docs).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3)))).drop("n")
    assert sparse_spans(copies) == got
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make_docs(*docs), sparse=True).collect()}
    assert "acmeworks" not in clean[0] and "nicka" not in clean[0] and clean[100] == rows[[r["doc_id"] for r in rows].index(100)]["text"]


def test_empty_table(spark, make_docs):
    assert pii.find(make_docs(), sparse=True).count() == 0
    assert pii.find(make_docs()).count() == 0
    assert pii.sanitise(make_docs()).count() == 0
