"""The registered query of each operator, with production parameters over whole tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.llm import ann, exactdedup, filteraudit, langid, license, linededup, minhash, mixing, packing, pii, simhash, trie, warc
from cleanloom.llm.common import table


def op1_nearest(spark, sf_dir):
    """The 20 nearest rows found for every row whose vec_id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_language(spark, sf_dir):
    """The language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predicted(docs, langid.fit_on(docs)).select(
        "doc_id", langid.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op3_line_dedup(spark, sf_dir):
    """Lines of whole texts that match an earlier line, and the number of links of each document's lines."""
    rows = linededup.document_verdicts(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("lines").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
                       F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.col("links").alias("n_links"))


def op4_license(spark, sf_dir):
    """License notices and texts in whole documents, with coverage and spans."""
    return license.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_mixing(spark, sf_dir):
    """Systematic sampling of all documents to the source targets."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


def op6_warc(spark, sf_dir):
    """All pages written to seekable archives; what the archives hold when read back."""
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages"))).drop("payload", "url")


def op7_exact_dedup(spark, sf_dir):
    """Groups of equal whole texts; the largest doc_id of each stays."""
    return exactdedup.exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark, sf_dir):
    """All documents in windows of 4096 tokens, next to documents that share their rare tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_pii(spark, sf_dir):
    """Personal data in whole texts: base spans, and the terms that give them away."""
    rows = pii.find(table(spark, sf_dir, "documents"), sparse=True)
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       pii.spans_text(F.col("spans")).alias("spans"))


def op10_simhash(spark, sf_dir):
    """Fingerprints of whole texts and the components of those at most two bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_minhash(spark, sf_dir):
    """Components of whole texts at a Jaccard similarity of 0.85 or more on three-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op12_audit(spark, sf_dir):
    """What every filter removes in every order of the filters, by source."""
    return filteraudit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {query.__name__: query for query in (
    op1_nearest, op2_language, op3_line_dedup, op4_license, op5_mixing, op6_warc, op7_exact_dedup, op8_packing, op9_pii, op10_simhash,
    op11_minhash, op12_audit, op13_trie)}

_ROUNDS = 6  # rounds of resharing written out below; the given tables settle in fewer

# The CRC-32 of a decimal number: its digits, each followed by eight shifts.
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# 40 hex digits are 8 groups of 20 bits, each of them 4 letters.
_LETTERS = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(sha1(html), {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)"
                       for g in range(8) for s in (15, 10, 5, 0))

SQL = {
    "op6_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_mixing": f"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
                 coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, source_size, [{', '.join(map(str, mixing.WEIGHTS))}][(place % {len(mixing.WEIGHTS)} + 1)::INT] AS weight FROM (
          SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
          FROM d GROUP BY source)),
        r(n, rate) AS (
          SELECT 0, 0.0::DOUBLE
          UNION ALL
          SELECT n + 1, (SELECT (sum(source_size) - coalesce(sum({mixing.MOST} * source_size) FILTER (weight * r.rate > {mixing.MOST} * source_size), 0))::DOUBLE
                                / sum(weight) FILTER (weight * r.rate <= {mixing.MOST} * source_size) FROM s)
          FROM r WHERE n < {_ROUNDS}),
        t AS (SELECT source AS s, source_size, least(weight * (SELECT max(rate) FROM r), ({mixing.MOST} * source_size)::DOUBLE) AS target,
                     ('0x' || substr(md5('{mixing.OFFSET_SEED}' || coalesce(source, '')), 1, {mixing.UNIT_BITS // 4}))::BIGINT AS u FROM s),
        p AS (SELECT d.*, source_size, target, u,
                CASE WHEN source_size > 0 THEN least(floor(target / source_size * {1 << mixing.UNIT_BITS}), {mixing.MOST << mixing.UNIT_BITS})::BIGINT ELSE 0 END AS step,
                row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), h, doc_id) AS nth
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.s)
        SELECT doc_id, source, size, source_size, target,
               (((step * nth + u) >> {mixing.UNIT_BITS}) - ((step * (nth - 1) + u) >> {mixing.UNIT_BITS})) * size AS taken
        FROM p""",
    "op12_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
                   FROM documents),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                       + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
                       + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
                     coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM m GROUP BY part, mask),
        f AS (SELECT chr(65 + i::INT) AS letter, 1 << i::INT AS bit FROM range(5) r(i)),
        o AS (SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
              FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND len(list_distinct([a.bit, b.bit, x.bit, y.bit, z.bit])) = 5),
        s AS (SELECT filter_order, i::INT AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
        e AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                     sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                     sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                     sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
                     sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
                     sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, own)
        SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM e""",
    "op13_trie": f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, md5(coalesce(text, '')) AS body, length(coalesce(text, '')) AS chars,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT conv_id, {_CRC32} % {trie.MOST_HEAD + 1} AS h,
                     list(length(role) || ':' || role || body ORDER BY pos) AS turns, list(chars ORDER BY pos) AS chars FROM t GROUP BY conv_id),
        r AS (SELECT p.conv_id, coalesce(q.turns[1:p.h], []) || p.turns[p.h + 1:] AS turns, coalesce(q.chars[1:p.h], []) || p.chars[p.h + 1:] AS chars
              FROM p LEFT JOIN p q ON q.conv_id = p.conv_id - p.conv_id % {trie.FAMILY}),
        m AS (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r),
        n AS (SELECT md5(array_to_string(turns[1:d], ',')) AS node, d, any_value(turns[1:d]) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
                     any_value(CASE WHEN d > 0 THEN chars[d] ELSE 0 END) AS chars,
                     coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = d), '') AS ends
              FROM m GROUP BY md5(array_to_string(turns[1:d], ',')), d),
        u AS (SELECT *, md5(array_to_string(path[1:d - 1], ',')) AS above FROM n),
        c AS (SELECT above, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY above, d),
        w AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM u n LEFT JOIN c ON c.above = n.node AND c.d = n.d),
        e AS (SELECT path, n_children, (n_convs - 1) * chars AS saved, unnest(range(0, d + 1)) AS k FROM w),
        s AS (SELECT md5(array_to_string(path[1:k], ',')) AS node, k AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
              FROM e GROUP BY 1, 2)
        SELECT w.conv_id, w.d::BIGINT AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens,
               sha256(w.ends) AS ends_sha256
        FROM w JOIN s ON s.node = w.node AND s.d = w.d LEFT JOIN n o ON o.node = w.above AND o.d = w.d - 1""",
}
