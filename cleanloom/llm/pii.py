"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give them away.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers, found by pattern, leftmost and
without overlap within a kind; a match that fails its test (range, length, check digit) is dropped.

The method then asks which terms of the text reveal a protected entity, that is a base value. The corpus of distinct texts
answers, so copies of a text change nothing:

    PMI(e; t) = log2(c(e, t) * N / (c(e) * c(t)))        how much t tells about e, in bits
    IC(e)     = log2(N / c(e))                           how much there is to tell

It is asked twice. *Near:* c(e) counts contexts of e (``WINDOW`` characters on either side, in each text), c(e, t) those that hold t, c(t)
the occurrences of t, N all of them. *In the text:* c(e), c(t) and c(e, t) count texts that hold e, t and both, N is the sum of c(t),
so neither the distance nor how often a text repeats a word matters.

A term discloses e when in one of them PMI reaches the share ``THRESHOLD`` of IC and c(e, t) rests on ``SUPPORT`` distinct contexts, or
texts. With ``sparse=True`` the near question is also asked for entities of too few contexts, and for the class of every entity (mail domain,
/24 network, issuer of a card, block of telephone numbers). An entity or class of fewer contexts than ``SUPPORT`` has no better estimate than
those: a term counts if it stands in all of them, so for an entity seen once PMI is log2(N / c(t)) and only terms with c(t) <= N^(1 - ``THRESHOLD``)
tell. The terms found this way are marked where they stand near the entity, whose places are known; the others become spans wherever they stand in a text that holds e: ``term`` if the word also occurs elsewhere (it is
generalised to a placeholder), ``secret`` if not (it is removed). Terms are words of three letters or more
that stand alone between white space and punctuation; texts without base spans get no spans at all.

Only DataFrame functions are used. Positions come from splitting the text at the matches and adding up lengths.
The patterns are those of the contract, with possessive repeats and a test of the character before, which finds the
same matches in linear time and without recursion. Counts are combined before every shuffle. Of the texts, only those that
are copied, hold an entity of many texts or a term to be marked are shuffled (and some whose hash falls in the same of ``SLOTS`` slots).

Defined cases: null text counts as empty; rows without id are kept; repeated rows get the same spans; positions
are code points, ends exclusive; an empty table gives no rows; other columns are ignored by :func:`find`, and kept by
:func:`sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import ref, release, stored, whole_text

KINDS = ("email", "ip", "card", "phone")
# The patterns of each kind.
_LOCAL, _DIGIT = r"[A-Za-z0-9._%+-]", "[0-9]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}  # a text without this character has no match
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
TERM = r"(?<!\S)\p{L}{3,}+(?=[.,;:!?]?(?:\s|$))"
WINDOW = 64
THRESHOLD = 0.95
SUPPORT = 3
SLOTS = 1 << 20  # of the filters that travel to the tasks
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "secret": ""}
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
_FOUND = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def located(text: Column, pattern: str | Column) -> Column:
    """All matches with their places and up to ``WINDOW`` characters on either side, one pass over the pieces."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.zip_with(F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), p.alias("p"))), F.slice(pieces, 2, F.size(pieces)),
                      lambda x, q: F.struct(x["m"].alias("m"), x["p"].alias("p"), q.alias("q")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(state, x):
        begin = state["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        found = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value"), F.right(x["p"], F.lit(WINDOW)).alias("before"),
                         F.left(x["q"], F.lit(WINDOW)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(F.filter(rows, lambda x: x["m"].isNotNull()), start, step)["out"]).otherwise(
        F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit: every second digit from the right counts double, with 9 taken off above 9."""
    backwards = F.reverse(digits)
    doubled = F.translate(backwards, "0123456789", "0246813579")
    place = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(place, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.substr(backwards, i, F.lit(1)))
                        .otherwise(F.substr(doubled, i, F.lit(1))).cast("int"))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """The protected value in one spelling."""
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _kept(rank: int, kind: str) -> Column:
    """The valid matches of a kind (a column of that name)."""
    valid = F.filter(F.coalesce(F.col(kind), F.array().cast(_FOUND)), lambda x: _valid(kind, x["value"]))
    return F.transform(valid, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"),
        _entity(kind, x["value"]).alias("entity"), x["before"].alias("before"), x["after"].alias("after")))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, found): the valid base matches of a text; tag is a hash of the text."""
    text = F.col("body")
    rows = docs.select(ref(id_col).alias("id"), whole_text(text_col).alias("body")).withColumn("tag", F.xxhash64("body"))
    for kind in KINDS:
        hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike(_DIGIT)
        rows = rows.withColumn(kind, F.when(hint, located(text, PATTERNS[kind])))
    found = [_kept(rank, kind) for rank, kind in enumerate(KINDS)]
    return rows.select("id", "tag", F.array_sort(F.concat(*found)).alias("found"))


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): occurrences of every term in all texts."""
    return (docs.select(F.explode(F.regexp_extract_all(whole_text(text_col), F.lit(TERM), F.lit(0))).alias("word"))
            .groupBy(F.lower("word").alias("term")).agg(F.count(F.lit(1)).alias("n")))


def _context_terms(contexts: DataFrame) -> DataFrame:
    """(id, tag, entity, context, term, start, end): the terms near each base match.

    Words that the window cuts, or that touch the match itself, are left out.
    """
    before = F.transform(F.filter(located(F.col("before"), TERM), lambda x: (x["end"] < F.length("before")) & (
        (x["start"] > 0) | (F.length("before") < WINDOW))), lambda x: F.struct(
            F.lower(x["value"]).alias("term"), (F.col("start") - F.length("before") + x["start"]).alias("start"),
            (F.col("start") - F.length("before") + x["end"]).alias("end")))
    after = F.transform(F.filter(located(F.col("after"), TERM), lambda x: (x["start"] > 0) & (
        (x["end"] < WINDOW - 1) | (F.length("after") < WINDOW))), lambda x: F.struct(
            F.lower(x["value"]).alias("term"), (F.col("end") + x["start"]).alias("start"), (F.col("end") + x["end"]).alias("end")))
    return contexts.select("id", "tag", "entity", "context", F.explode(F.concat(before, after)).alias("t")).select(
        "id", "tag", "entity", "context", "t.*")


def _class_of(entity: Column) -> Column:
    """What an entity belongs to: mail domain, /24 network, issuer (six digits), block of ten thousand telephone numbers."""
    value = F.substring_index(entity, ":", -1)
    part = (F.when(entity.startswith("email:"), F.substring_index(value, "@", -1)).when(entity.startswith("ip:"), F.substring_index(value, ".", 3))
            .when(entity.startswith("card:"), F.left(value, F.lit(6))).otherwise(F.left(value, F.length(value) - 4)))
    return F.concat(F.lit("class "), F.substring_index(entity, ":", 1), F.lit(":"), part)


def _telling(joint: DataFrame, counts: DataFrame, entities: DataFrame, threshold: float, where: Column | None = None) -> DataFrame:
    """(entity, term, disclosure, everywhere) from (entity, term, joint), (term, n) and (entity, seen)."""
    total = counts.agg(F.sum("n").alias("total"))
    rows = joint.join(entities, "entity")
    joined = (rows if where is None else rows.filter(where)).join(counts, "term").crossJoin(F.broadcast(total))  # one row
    pmi = F.log2(F.col("joint") * F.col("total") / (F.col("seen") * F.col("n")))
    whole = F.log2(F.col("total") / F.col("seen"))
    return joined.withColumn("disclosure", pmi / whole).filter(F.col("disclosure") >= threshold).select(
        "entity", "term", "disclosure", (F.col("joint") >= F.col("n")).alias("everywhere"))


def disclosures(terms: DataFrame, contexts: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT,
                sparse: bool = False) -> DataFrame:
    """(entity, term, disclosure, everywhere): terms near an entity that tell enough about it.

    A context counts in each text that holds it, as words do; the support counts different contexts. With ``sparse``
    all contexts of an entity are support enough where it has fewer.
    """
    joint = (terms.select("entity", "term", "context", "tag").distinct().groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("texts"))
             .groupBy("entity", "term").agg(F.sum("texts").alias("joint"), F.count(F.lit(1)).alias("different")))
    if not sparse:
        joint = joint.filter(F.col("different") >= support).drop("different")
        entities = contexts.select("entity", "context", "tag").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("seen"))
        return _telling(joint, counts, entities, threshold)
    entities = (contexts.select("entity", "context", "tag").distinct().groupBy("entity", "context").agg(F.count(F.lit(1)).alias("texts"))
                .groupBy("entity").agg(F.sum("texts").alias("seen"), F.least(F.count(F.lit(1)), F.lit(support)).alias("needed")))
    return _telling(joint, counts, entities, threshold, F.col("different") >= F.col("needed"))


def text_counts(texts: DataFrame) -> DataFrame:
    """(term, n): in how many texts (tag, body) a term occurs."""
    return texts.select(F.explode(_terms_of(F.col("body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _terms_of(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def text_disclosures(texts: DataFrame, contexts: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure, everywhere): terms anywhere in the texts of an entity that tell enough about it.

    Entities of too few texts, and terms too frequent to tell of any entity of a text, are left out before they meet.
    """
    held = contexts.select("entity", "tag").distinct()
    entities = stored(held.groupBy("entity").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= support), "entities")
    pairs = held.join(entities, "entity")
    most = stored(pairs.groupBy("tag").agg(F.max("seen").alias("most")), "most")
    total = counts.agg(F.sum("n").alias("total"))

    def may_tell(seen):  # with every text of the entity in common; a hair is left for rounding
        return F.log2(F.col("total") / F.col("n")) >= threshold * F.log2(F.col("total") / F.col(seen)) - 1e-9

    words = (_among(texts, most, "tag").join(most, "tag").select("tag", "most", F.explode(_terms_of(F.col("body"))).alias("term"))
             .join(counts.filter(F.col("n") >= support).crossJoin(F.broadcast(total)), "term").filter(may_tell("most")))  # one row
    joint = (words.join(pairs, "tag").filter(may_tell("seen")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint"))
             .filter(F.col("joint") >= support))
    return _telling(joint, counts, entities, threshold)


def _among(rows: DataFrame, keys: DataFrame, *columns: str, how: str = "left_semi") -> DataFrame:
    """The rows whose columns fall in the slots of the keys; the slots have a bounded number."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).alias("slot")
    return rows.withColumn("slot", slot).join(F.broadcast(keys.select(slot).distinct()), "slot", how).drop("slot")


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(body, tag): every different text once."""
    rows = docs.select(whole_text(text_col).alias("body")).withColumn("tag", F.xxhash64("body"))
    repeated = stored(rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tag"), "repeated")
    return _among(rows, repeated, "tag", how="left_anti").union(_among(rows, repeated, "tag").distinct())


def _marked(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, added): the places of the terms in ``wanted``, (id, tag, term, everywhere), in whole texts."""
    asked = stored(wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("term", "everywhere")).alias("asked")), "asked")
    rows = docs.select(ref(id_col).alias("id"), whole_text(text_col).alias("body")).withColumn("tag", F.xxhash64("body"))
    rows = _among(rows, asked, "id", "tag")
    asked = asked.withColumnsRenamed({"id": "asked_id", "tag": "asked_tag"})
    # Terms are matched whatever their case, and kept where their lower case is the term's. One letter has two in lower case.
    either = F.array_join(F.transform("asked", lambda x: F.replace(x["term"], F.lit("i\u0307"), F.lit("(?:i\u0307|\u0130)"))), "|")
    pattern = F.concat(F.lit(r"(?<!\S)(?iu:"), either, F.lit(r")(?=[.,;:!?]?(?:\s|$))"))
    found = rows.join(asked, F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("tag") == F.col("asked_tag")))
    kind = F.map_from_entries(F.transform("asked", lambda x: F.struct(
        x["term"], F.when(x["everywhere"], "secret").otherwise("term"))))
    places = F.filter(located(F.col("body"), pattern), lambda x: F.map_contains_key(F.col("kinds"), F.lower(x["value"])))
    return found.withColumn("kinds", kind).select(F.col("id").alias("added_id"), F.col("tag").alias("added_tag"), F.transform(places, lambda x: F.struct(
        x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"), F.element_at("kinds", F.lower(x["value"])).alias("kind"))).alias("added")).dropDuplicates(
            ["added_id", "added_tag"])


def _beside(terms: DataFrame, contexts: DataFrame, counts: DataFrame, threshold: float, support: int) -> DataFrame:
    """(id, tag, start, end, kind): the places of terms near an entity that tell of it or of its class, few contexts or many.

    Places come from the terms themselves, so no text is read again, and a frequent class meets only the terms that stand near it.
    """
    owners = F.explode(F.array("entity", _class_of(F.col("entity")))).alias("entity")
    terms = terms.select("id", "tag", "context", "term", "start", "end", owners)
    telling = disclosures(terms, contexts.select("context", "tag", owners), counts, threshold, support, sparse=True)
    return terms.join(telling.select("entity", "term", "everywhere"), ["entity", "term"]).select(
        "id", "tag", "start", "end", F.when(F.col("everywhere"), "secret").otherwise("term").alias("kind"))


def _united(added: DataFrame, beside: DataFrame) -> DataFrame:
    """(added_id, added_tag, added): the places of both, each once; "secret" goes before "term"."""
    places = added.select(F.col("added_id").alias("id"), F.col("added_tag").alias("tag"), F.explode("added").alias("x")).select(
        "id", "tag", "x.start", "x.end", "x.kind").union(beside)
    each = places.groupBy("id", "tag", "start", "end").agg(F.min("kind").alias("kind"))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", "kind")
    return each.groupBy(F.col("id").alias("added_id"), F.col("tag").alias("added_tag")).agg(F.collect_list(span).cast(_SPAN).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT,
         sparse: bool = False) -> DataFrame:
    """(id, tag, base, spans): spans are (start, rank, end, kind), sorted; ``spans`` holds those of the method as well."""
    base = stored(base_matches(docs, id_col, text_col), "base")
    contexts = base.select("id", "tag", F.explode("found").alias("f")).select("id", "tag", "f.*").withColumn(
        "context", F.xxhash64("before", "after"))
    texts = stored(distinct_texts(docs, text_col), "texts")
    terms = stored(_context_terms(contexts), "terms")
    counts = stored(term_counts(texts, "body"), "counts")
    near = disclosures(terms, contexts, counts, threshold, support)
    wide = text_disclosures(texts, contexts, stored(text_counts(texts), "text-counts"), threshold, support)
    telling = stored(near.union(wide).groupBy("entity", "term").agg(F.max("everywhere").alias("everywhere")), "telling")
    release(docs.sparkSession)
    wanted = (contexts.select("id", "tag", "entity").distinct().join(telling, "entity")
              .groupBy("id", "tag", "term").agg(F.max("everywhere").alias("everywhere")))
    added = _marked(docs, wanted, id_col, text_col)
    if sparse:
        added = _united(added, _beside(terms, contexts, counts, threshold, support))
    spans = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    joined = base.join(added, F.col("id").eqNullSafe(F.col("added_id")) & (F.col("tag") == F.col("added_tag")), "left")
    return joined.select("id", "tag", spans.alias("base"),
                         F.array_sort(F.concat(spans, F.coalesce("added", F.array().cast(_SPAN)))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with every span replaced: base values and terms by their kind, secrets by nothing."""
    found = find(docs, id_col, text_col, **options).filter(F.size("spans") > 0).select("id", "tag", "spans").dropDuplicates(["id", "tag"])
    text = whole_text(text_col)
    marks = F.create_map(*[F.lit(x) for pair in REPLACEMENTS.items() for x in pair])

    def step(state, x):
        gap = F.substr(F.col("__text"), (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        return F.when(x["start"] < state["at"], state).otherwise(F.struct(
            x["end"].alias("at"), F.concat(state["out"], gap, F.element_at(marks, x["kind"])).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.col("__spans"), start, step)
    rest = F.substr(F.col("__text"), (F.col("__done.at") + 1).cast("int"), F.length("__text"))
    found = found.withColumnsRenamed({"id": "__id", "tag": "__tag", "spans": "__spans"})
    joined = docs.withColumn("__text", text).join(
        found, ref(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("__tag")), "left").withColumn("__done", done)
    clean = F.when(F.col("__spans").isNotNull(), F.concat(F.col("__done.out"), rest)).otherwise(ref(text_col))
    return joined.select(*[clean.alias(c) if c == text_col else ref(c) for c in docs.columns])
