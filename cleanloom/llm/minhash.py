"""MinHash near-duplicates with b-bit signatures.

A document's set: its text in lower case (A-Z only) is cut into words, and the set holds the distinct runs of ``SHINGLE`` words, each as a 64-bit
hash; a text with fewer words has one, its whole word sequence; a text without words has none and is linked with nothing. Documents are
linked when the Jaccard similarity of their sets is at least ``PERCENT``, in whole numbers, confirmed on the full sets.

1. Equal sets (128 bits of hash) are one node from here on; its copies never meet one by one.
2. ``BANDS * ROWS`` random functions give each node the minima of its set. Only the low 8 bits of each minimum are kept, packed as bit planes: 192
   minima are eight planes of 192 bits. A band is six of these bytes; nodes that share a band are candidates. Two sets at similarity 0.85 share none of the 32
   bands with probability 3e-7, at 0.9 with 1e-11.
3. The estimate: planes are compared by exclusive or, joined by or, and the zero bits counted; that many minima agree. Of minima that differ, one in 256
   agrees in 8 bits by chance, and the estimate is corrected for it. Candidates more than ``SIGMAS`` standard deviations below the threshold go, and
   those whose set sizes alone rule the similarity out.
4. Stars: in each band the members are compared with one hub only, the member with the most company in all its bands, which stands
   in the middle of a family of variants. Confirmed links give components.
5. Only bands whose members lie in several components are looked at again. Members outside the band's largest component are compared with all members, in
   blocks of ``BLOCK`` against ``PART`` dealt over the tasks; pairs inside one component, and pairs that an earlier band compares, are
   passed over. What passes the estimate is confirmed on the full sets at the place, and only links that tie two components leave the task. So every
   candidate pair between different components is compared, whatever the size of its band, and no group's pairs are listed.

Sets are not stored: what is stored of a document is its signature. Where links are confirmed, the texts of the nodes in question meet and their sets are
made again; a hub's text comes first and its candidates stream past it. It is dealt in as many copies as its candidates need (one for each ``SPREAD``), so
that a hub with a third of all nodes is no hot key.

Defined cases: null text counts as empty; rows without id get their component's smallest id, null if no member has one; a row of such a component
without any id stays; rows that repeat an id are documents of their own; a very long text is hashed in parts; an empty table gives no
rows; other columns are not read, and :func:`deduplicate` keeps them as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm import bytewords
from cleanloom.llm.common import keep_rows, ref, shuffle_partitions, stored
from cleanloom.llm.components import components

SHINGLE, PERCENT = 3, 85
BANDS, ROWS, BITS = 32, 6, 8
MINIMA = BANDS * ROWS
SIGMAS = 6
BLOCK, PART = 256, 1024  # members
BLOCK_SHINGLES = 1 << 19
SPREAD = 256  # candidates of a node that meet one copy of its set
TEXT_BYTES = 1 << 20  # of text hashed at a time
SET_ROWS = 1 << 13  # shingles whose functions are worked out at a time
SEED = 42

_draw = np.random.default_rng(SEED)
_FACTOR = _draw.integers(0, 1 << 63, MINIMA, np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFT = _draw.integers(0, 1 << 63, MINIMA, np.uint64)
_ORDER = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


# ---------------------------------------------------------------- sets
def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text); long texts are cut at white space, and only a part is worked on at a time."""
    counts = np.zeros(len(texts), np.int64)
    found, joined, owners, size = [], [], [], 0

    def flush():
        nonlocal joined, owners, size
        if joined:
            codes = np.frombuffer(b" ".join(joined), np.uint8)
            ends = np.cumsum([len(p) + 1 for p in joined])
            first, last = bytewords.edges(codes)
            found.append(bytewords.hashes(bytewords.LOWER[codes], first, last))
            np.add.at(counts, np.asarray(owners)[np.searchsorted(ends, first, side="right")], 1)
        joined, owners, size = [], [], 0

    for i, text in enumerate(texts):
        data, at = (text or "").encode("utf-8", "surrogatepass"), 0
        while at < len(data):
            end = len(data)
            if end - at > TEXT_BYTES:
                cut = max(data.rfind(space, at, at + TEXT_BYTES) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut > at:
                    end = cut
                else:  # one word of more than a part; it ends at the next white space
                    cuts = [c for c in (data.find(space, at + 1) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if c > 0]
                    end = min(cuts, default=end)
            joined.append(data[at:end])
            owners.append(i)
            size += end - at
            at = end
            if size >= TEXT_BYTES:
                flush()
    flush()
    return np.concatenate([np.zeros(0, np.uint64), *found]), counts


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text: distinct shingle hashes in order."""
    words, counts = _word_hashes(texts)
    sets, at = [], 0
    for count in counts.tolist():
        own = words[at:at + count]
        at += count
        width = min(shingle, count)
        if not width:
            sets.append(own)
            continue
        mixed = own[:count - width + 1] * _ORDER[0]
        for i in range(1, width):
            mixed = bytewords.mixed(mixed) + own[i:count - width + 1 + i] * _ORDER[i % len(_ORDER)]
        sets.append(np.unique(bytewords.mixed(mixed + np.uint64(width))))
    return sets


# ---------------------------------------------------------------- signatures
def low_bits(values: np.ndarray) -> np.ndarray:
    """The low 8 bits of the minima of a set, one for each function; a set is worked on in parts."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), SET_ROWS):
        np.minimum(least, (values[at:at + SET_ROWS, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return (bytewords.mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def planes(low: np.ndarray) -> np.ndarray:
    """Bit planes of (n, MINIMA) bytes as (n, BITS, MINIMA / 64) words."""
    bits = np.unpackbits(low[:, :, None], axis=2, bitorder="little")  # (n, minima, 8)
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)


def band_values(packed: np.ndarray) -> np.ndarray:
    """(n, BANDS): the low bits of each band's minima as one number, from bit planes."""
    bits = np.unpackbits(packed.view(np.uint8).reshape(len(packed), BITS, MINIMA // 8), axis=2, bitorder="little")
    low = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(len(packed), BANDS, ROWS).astype(np.uint64)
    return (low << (np.arange(ROWS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures by counting bits, corrected for minima that agree by chance."""
    differ = np.bitwise_or.reduce(a ^ b, axis=-2)
    agree = 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / MINIMA
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    threshold = percent / 100
    return threshold - SIGMAS * (threshold * (1 - threshold) / MINIMA) ** 0.5


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), BITS, MINIMA // 64)


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def document_signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, tag, d1, d2, n, signature): a row per input row; d1, d2 tell sets apart."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), shingle)
            place = np.arange(1, max(map(len, sets), default=0) + 1, dtype=np.uint64)
            digests = [(bytewords.mixed(s ^ np.uint64(SEED)).sum(dtype=np.uint64), (bytewords.mixed(s) * place[:len(s)]).sum(dtype=np.uint64)) for s in sets]
            low = np.stack([low_bits(s) for s in sets]) if sets else np.zeros((0, MINIMA), np.uint8)
            pair = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "tag": batch["tag"], "d1": pair[:, 0], "d2": pair[:, 1], "n": [len(s) for s in sets],
                                "signature": [p.tobytes() for p in planes(low)]})

    rows = docs.select(ref(id_col).cast("long").alias("id"), F.xxhash64(ref(text_col)).alias("tag"), ref(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, tag long, d1 long, d2 long, n long, signature binary")


# ---------------------------------------------------------------- candidates
def _band_rows(batches):
    for batch in batches:
        values = band_values(_unpacked(batch["signature"])).view(np.int64)
        nodes = np.repeat(batch["node"].to_numpy(np.int64), BANDS)
        yield pd.DataFrame({"band": np.tile(np.arange(BANDS, dtype=np.int32), len(batch)), "value": values.ravel(), "node": nodes})


def _likely(percent: int):
    """Pairs that pass the sizes and the estimate."""
    least = least_estimate(percent)

    def run(batches):
        for batch in batches:
            good = _sizes_fit(batch["na"].to_numpy(np.int64), batch["nb"].to_numpy(np.int64), percent)
            batch = batch[good]
            if len(batch):
                batch = batch[estimate(_unpacked(batch["sa"]), _unpacked(batch["sb"])) >= least]
            yield batch[["a", "b"]]

    return run


def _block_links(percent: int, shingle: int):
    """Links between one block of members and one part of all members of a band; a batch gives fewer links than it has nodes."""
    least = least_estimate(percent)

    def compared(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        """Whole groups of rows, parted at ``cuts``."""
        packed = _unpacked(rows["signature"])
        values = band_values(packed)
        node, root, n, band, block = (rows[c].to_numpy() for c in ("node", "root", "n", "band", "block"))
        likely = []
        for start, end in zip(cuts[:-1], cuts[1:]):
            inside = np.arange(start, end)
            left, right = inside[block[start:end]], inside[~block[start:end]]
            for i in left:
                at = right[root[right] != root[i]]
                at = at[_sizes_fit(n[at], n[i], percent)]
                at = at[~(values[at, :band[i]] == values[i, :band[i]]).any(axis=1)]  # an earlier band compares these
                at = at[estimate(packed[i], packed[at]) >= least]
                if len(at):
                    likely.append((i, at))
        needed = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.append(at, i) for i, at in likely)]))
        sets = dict(zip(needed.tolist(), shingle_sets(rows["text"].iloc[needed].tolist(), shingle)))
        joined: dict[int, int] = {}  # components that a link of this batch has tied to another one

        def top(at):
            while at in joined:
                at = joined[at]
            return at

        found = []
        for i, others in likely:
            for j in others.tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x == y:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    joined[x] = y
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def runs(batches):
        """Rows come in order of their group; the last group of a batch goes on in the next one."""
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = np.zeros(max(len(held) - 1, 0), bool)
            for c in ("band", "value", "part", "at"):
                new |= held[c].to_numpy()[1:] != held[c].to_numpy()[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
            if len(cuts) > 1:
                yield compared(held.iloc[:cuts[-1]], cuts)
                held = held.iloc[cuts[-1]:]
        if held is not None and len(held):
            yield compared(held, np.array([0, len(held)]))

    return runs


def _hub_links(percent: int, shingle: int):
    def run(batches):
        """Rows come in order of (hub, copy), the hub's own text before those of its candidates."""
        own = None
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (member, found) in enumerate(zip(batch["member"], shingle_sets(batch["text"].tolist(), shingle))):
                if not member:
                    own = found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                good[i] = 100 * both >= percent * (len(own) + len(found) - both)
            yield batch.loc[good, ["a", "b"]]

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a is the hub. ``texts`` has node and text."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies"))
    hubs = texts.join(copies.withColumnRenamed("a", "node"), "node").select(
        F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).cast("long").alias("b"),
        F.lit(False).alias("member"), "text")
    members = (pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
               .join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", F.lit(True).alias("member"), "text"))
    return (hubs.unionByName(members).repartition(shuffle_partitions(texts.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member")
            .mapInPandas(_hub_links(percent, shingle), "a long, b long"))


def node_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in ``wanted`` (node, id, tag), one text each; all texts are shuffled once."""
    key = ["none", "own", "tag"]
    named = lambda id_, tag: [id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("own"), tag.alias("tag")]
    rows = docs.select(*named(ref(id_col).cast("long"), F.xxhash64(ref(text_col))), ref(text_col).alias("text"))
    one = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))).filter("nth = 1").drop("nth")
    return one.join(wanted.select("node", *named(F.col("id"), F.col("tag"))), key).select("node", "text")


def links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links that connect just the components of all similar nodes. ``nodes`` has node, n, signature, and id and tag of a row of ``docs``."""
    partitions = shuffle_partitions(nodes.sparkSession)
    bands = nodes.select("node", "signature").mapInPandas(_band_rows, "band int, value long, node long")
    key = ["band", "value"]
    shared = stored(bands.join(bands.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), key), "shared-bands")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = shared.join(company, "node").groupBy(*key).agg(F.max(F.struct("company", "node"))["node"].alias("hub"))
    stars = shared.join(hubs, key).filter("node <> hub").select(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y"), "hub").distinct()
    # a is the hub, which may have very many candidates
    stars = stars.groupBy("x", "y").agg(F.max("hub").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))
    seen = nodes.select("node", "n", "signature")
    left = seen.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = seen.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    likely = stored(stars.join(right, "b").join(left, "a").mapInPandas(_likely(percent), "a long, b long"), "likely")
    wanted = shared.select("node").distinct().join(nodes.select("node", "id", "tag"), "node")
    texts = stored(node_texts(docs, wanted, id_col, text_col), "node-texts")
    first = stored(_confirmed(likely, texts, percent, shingle), "star-links")

    roots = components(first)
    held = (shared.select(*key, "node").join(roots.withColumnRenamed("vertex", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
            .join(seen, "node"))
    sized = held.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    core = F.max(F.struct("size", "root", "weight"))
    several = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("roots"), core.alias("core"), F.sum("size").alias("size"),
                                      F.sum("weight").alias("weight")).filter("roots > 1")
    # Long texts fill a block sooner: a block is bounded by members and by their shingles.
    blocks = F.ceil((F.col("size") - F.col("core.size")) / BLOCK + (F.col("weight") - F.col("core.weight")) / BLOCK_SHINGLES).cast("int")
    parts = F.ceil(F.col("size") / PART + F.col("weight") / (BLOCK_SHINGLES * PART // BLOCK)).cast("int")
    several = several.select(*key, F.col("core.root").alias("core"), blocks.alias("blocks"), parts.alias("parts"))
    members = stored(held.join(several, key), "members")
    spread = lambda count: F.pmod(F.xxhash64("node", *key), F.col(count)).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    carried = [*key, "node", "root", "n", "signature", "text"]
    told = members.join(texts, "node")
    outside = told.filter("root <> core").select(*carried, F.lit(True).alias("block"), spread("blocks").alias("at"), upto("parts").alias("part"))
    everyone = told.select(*carried, F.lit(False).alias("block"), upto("blocks").alias("at"), spread("parts").alias("part"))
    met = (outside.unionByName(everyone).repartition(partitions, *key, "part", "at").sortWithinPartitions(*key, "part", "at")
           .mapInPandas(_block_links(percent, shingle), "a long, b long"))
    return first.unionByName(stored(met, "crossing"))


# ---------------------------------------------------------------- documents
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, tag, n_shingles, root, component_id, kept): a row per input row; ``kept`` is true for those with their component's smallest id."""
    rows = stored(document_signatures(docs, id_col, text_col, shingle), "signatures")
    same = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.min("signature").alias("signature"),
                                                        F.min(F.struct("id", "tag")).alias("row"))
    nodes = stored(same.select("*", "row.*", F.monotonically_increasing_id().alias("node")).drop("row"), "set-nodes")
    roots = components(links(nodes, docs, id_col, text_col, percent, shingle))
    linked = nodes.select("node", "first").join(roots.withColumnRenamed("vertex", "node"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    settled = linked.join(least, "root").select("node", "root", "least")
    classes = stored(nodes.select("d1", "d2", "node", "first").join(settled, "node", "left").select(
        "d1", "d2", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "classes")
    light = rows.select("id", "tag", "d1", "d2", "n")
    joined = light.filter("n > 0").join(classes, ["d1", "d2"]).select("id", "tag", "n", "root", "component_id")
    alone = light.filter("n = 0").select("id", "tag", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select("id", "tag", F.col("n").alias("n_shingles"), "root", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component stays, one with the smallest id, with all its columns; texts without words all stay, those that repeat
    id and text once."""
    best = near_duplicates(docs, id_col, text_col, **options).filter("kept")
    first = F.row_number().over(Window.partitionBy("root", F.when(F.col("root").isNull(), F.struct("id", "tag"))).orderBy("tag"))
    kept = best.withColumn("nth", first).filter("nth = 1").select("id", "tag")
    return keep_rows(docs, {"id": ref(id_col).cast("long"), "tag": F.xxhash64(ref(text_col))}, kept)
