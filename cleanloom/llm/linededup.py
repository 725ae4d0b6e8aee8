"""Line deduplication by an exact set-similarity join.

A line is the set of its words (white space parts them, A-Z in lower case). Two lines match when the Jaccard similarity of
their sets is at least ``NUMERATOR`` / ``DENOMINATOR``; a line is removed when it matches an earlier line, in the order of documents (by id) and of
lines in a document. Whether the earlier line was removed itself does not matter, so the result does not depend on how the work is cut up.

1. Words are counted into a table of fixed size. A word is held as its rarity class and 56 bits of its hash, so numeric order is
   rarity order, the same for all lines. Lines with equal sets are one class, whose number is a 64-bit hash of the set, from
   all 64 bits of its words' hashes.
2. Prefix filter: two matching sets share a word among the first (rarest) |x| - ceil(t |x|) + 1 of each. Each of them
   is a key. Where the word is frequent, keys are pairs of it with each further word of a prefix longer by one: matching sets of two
   words or more share two words there. Lists under a key stay short as the corpus grows. A pair of words travels as one 64-bit hash;
   pairs that share it only share a list.
3. Keys are hashes, dealt to tasks by ranges, many postings packed in a row. A task holds one range at a time and sorts it, the lines of a
   key by length; a range that grows long sheds the members of its long lists, tied to one that stays. The length filter (t |y| <= |x| <= |y| / t), the positional filter (words in
   common so far and the words left behind the key bound the overlap) and a parity filter (each of 128 bits, for lines of every length,
   says whether an odd number of words falls on it; differing bits are differing words) leave the candidate pairs.
4. Candidates get their word sets back and are verified. Where a list has many candidates for its members (variants of one line), they never
   become pairs: those members that are candidates of each other are only tied together, and everything that is tied together directly or through others is a crowd. A crowd's members come
   with their sets once, in blocks, and each pair of blocks is verified in one matrix product that returns one row per line, its
   number of links and whether one of them is earlier. Pairs inside a crowd are left to the crowd, so no link counts twice.

Defined cases: null and empty texts have no lines; lines without a word are never removed nor matched; rows without id come after the
others, in the order of a hash of their text; rows that repeat id and text are the same document and get the same verdict; a text that loses all
lines becomes empty and its row stays; an empty table gives no rows; other columns are kept.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import bytewords
from cleanloom.llm.common import SEGMENT, gathered, joined, ref, release, shuffle_partitions, stored
from cleanloom.llm.components import components

NUMERATOR, DENOMINATOR = 4, 5  # the similarity 0.8 as a fraction: all tests are in whole numbers
BUCKET_BITS = 20  # size of the count table
FREQUENT = 5_000  # words counted more often make keys of two
DENSE = 4  # candidates per member beyond which a list makes a crowd
LIST = 200_000  # longer lists are taken for crowds unseen
BLOCK = 1024
PART_BYTES = 1 << 18  # read together: the arrays of a part stay in the cache
SLOT_BITS = 18  # slots in which equal words of a line meet
SEEN_LINES = 1_000_000
FILTER_BITS = 24
COUNTS_AT_ONCE = 1 << 20  # words whose buckets are held before they are counted
COUNTED = np.dtype([("bucket", "<u4"), ("n", "<i8")])  # word counts travel as these, so many buckets in a row:
COUNTS_IN_ROW = 1 << 16

LINES = "id long, tag long, line long, cls long, size int, counts binary"
#: k2: 0 for keys of one word, 1 for pairs; parity, more: 64 bits each; extent: size of the set and words behind the key
POSTING = np.dtype([("k1", "<i8"), ("k2", "i1"), ("cls", "<i8"), ("parity", "<i8"), ("more", "<i8"), ("extent", "<i8")])
PACKED = "span int, postings binary"  # many postings of one range of keys in a row
PACK_ROWS = 1 << 18  # postings a task holds before it packs them
RANGES = 8  # ranges of keys for each shuffle partition
PAIRS = "a long, b long, crowd boolean"
SETS = "cls long, id long, tag long, line long, words binary"
VERDICT = "cls long, links long, earlier boolean"

# ---------------------------------------------------------------- words
def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line number) of all words of some lines, by one running sum over the bytes."""
    codes = np.frombuffer(data, np.uint8)
    first, last = bytewords.edges(codes)
    hashes = bytewords.hashes(bytewords.lowered(codes), first, last)
    before = np.searchsorted(first, np.flatnonzero(codes == 10))  # words before each line end
    return hashes, np.repeat(np.arange(len(before) + 1), np.diff(before, prepend=0, append=len(first)))


def _once(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks one of the equal words of each line, without sorting: the last one of a slot drops its equals, the others go on."""
    slot = ((words * np.uint64(bytewords.FACTOR) ^ owner.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
    once = np.ones(len(words), bool)
    last = np.empty(1 << SLOT_BITS, np.int64)  # read only where it was written
    at = np.arange(len(words))
    while len(at):
        last[slot[at]] = at
        other = last[slot[at]]
        apart = other != at
        at, other = at[apart], other[apart]
        same = (words[at] == words[other]) & (owner[at] == owner[other])
        once[at[same]] = False
        at = at[~same]
    return once


class Sets:
    """The word sets of some lines, one set after the other; words in the order of the text, or of rarity where that is given."""

    def __init__(self, data: bytes, rarity: np.ndarray | None = None):
        hashes, lines = hashed_words(data)
        fresh = np.concatenate([[True], lines[1:] != lines[:-1]]) if len(lines) else np.zeros(0, bool)
        owner = np.cumsum(fresh) - 1
        once = _once(hashes >> np.uint64(8), owner)
        self.hashes, self.owner = hashes[once], owner[once]
        self.line = lines[fresh]
        self._places(np.bincount(self.owner, minlength=len(self.line)))
        total = self._over_lines(np.add, bytewords.mixed(self.hashes + np.uint64(bytewords.FACTOR)))
        self.cls = bytewords.mixed(total + self.size.astype(np.uint64)).view(np.int64)
        self.words = self.hashes >> np.uint64(8)
        if rarity is not None:
            self.put_in_order(rarity)

    def _places(self, size: np.ndarray):
        self.size, self.start = size, np.cumsum(size) - size

    def _over_lines(self, operation, values: np.ndarray) -> np.ndarray:
        return operation.reduceat(values, self.start) if len(self.start) else np.zeros(0, np.uint64)

    def only(self, which: np.ndarray):
        """Leaves the marked lines."""
        use = which[self.owner]
        self.hashes, self.words, self.owner = self.hashes[use], self.words[use], (np.cumsum(which) - 1)[self.owner[use]]
        self.line, self.cls = self.line[which], self.cls[which]
        self._places(self.size[which])

    def put_in_order(self, rarity: np.ndarray):
        """Words in rarity order within their lines."""
        kind = rarity[self.hashes >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64)
        self.words = kind << np.uint64(56) | self.hashes >> np.uint64(8)
        order = None
        if len(self.line) <= 1 << 16:  # line and beginning of the word in one number; the class of a word is below 128
            near = self.owner.astype(np.uint64) << np.uint64(48) | self.words >> np.uint64(15)
            order = np.argsort(near)
            near = near[order]
            if (near[1:] == near[:-1]).any():
                order = None
        if order is None:
            order = np.lexsort((self.words, self.owner))
        self.words, self.hashes = self.words[order], self.hashes[order]  # lines stay where they are, and so do owners

    def parities(self) -> list[np.ndarray]:
        """Each word falls on one of 128 bits, in two numbers."""
        fall = bytewords.mixed((self.hashes >> np.uint64(8)) + np.uint64(bytewords.FACTOR)) >> np.uint64(57)
        bit, near = np.uint64(1) << (fall & np.uint64(63)), fall < 64
        return [self._over_lines(np.bitwise_xor, np.where(side, bit, np.uint64(0))).view(np.int64) for side in (near, ~near)]


def _parts(text: str | None):
    """(number of the first line, bytes) of a text, cut at line ends where it is long."""
    data = (text or "").encode("utf-8", "surrogatepass")
    line = start = 0
    while len(data) - start > PART_BYTES:
        end = data.find(b"\n", start + PART_BYTES)
        if end < 0:
            break
        yield line, data[start:end]
        line += data.count(b"\n", start, end + 1)
        start = end + 1
    yield line, data[start:]


def _sets_of(batches):
    """(sets, row of each line, number of each line in its text, ids, tags), several texts at a time."""
    for batch in batches:
        held, size = [], 0
        for row, text in enumerate(batch["text"]):
            for line, data in _parts(text):
                held.append((row, line, data))
                size += len(data)
                if size >= PART_BYTES:
                    yield _gathered(batch, held)
                    held, size = [], 0
        if held:
            yield _gathered(batch, held)


def _gathered(batch, held):
    sets = Sets(b"\n".join(data for _, _, data in held))
    begins = np.cumsum([0] + [data.count(b"\n") + 1 for _, _, data in held[:-1]])
    part = np.searchsorted(begins, sets.line, side="right") - 1
    row = np.array([row for row, _, _ in held])[part]
    number = sets.line - begins[part] + np.array([line for _, line, _ in held])[part]
    return sets, number, batch["id"].iloc[row].reset_index(drop=True), batch["tag"].iloc[row].reset_index(drop=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(ref(id_col).cast("long").alias("id"), F.xxhash64(ref(text_col)).alias("tag"), ref(text_col).alias("text"))


# ---------------------------------------------------------------- passes over the texts
def _count(batches):
    """A row per line that has words; the last rows of a task hold its word counts, only those of buckets that have words."""
    counts, held, waiting = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
    for sets, number, ids, tags in _sets_of(batches):
        held.append((sets.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        waiting += len(held[-1])
        if waiting >= COUNTS_AT_ONCE:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, waiting = [], 0
        yield pd.DataFrame({"id": ids.astype("Int64"), "tag": tags, "line": number, "cls": sets.cls, "size": sets.size.astype(np.int32), "counts": None})
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    some = np.flatnonzero(counts)
    for at in range(0, len(some), COUNTS_IN_ROW):
        part = np.empty(len(some[at:at + COUNTS_IN_ROW]), COUNTED)
        part["bucket"] = some[at:at + COUNTS_IN_ROW]
        part["n"] = counts[part["bucket"]]
        yield pd.DataFrame({"id": pd.array([None], "Int64"), "tag": [0], "line": [-1], "cls": [0], "size": [0], "counts": [part.tobytes()]})


def _word_counts(lines: DataFrame) -> np.ndarray:
    """The whole count table: a number for each of its fixed number of buckets."""
    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                part = np.frombuffer(counts, COUNTED)
                total[part["bucket"]] += part["n"]  # each bucket once
        some = np.flatnonzero(total)
        part = np.empty(len(some), COUNTED)
        part["bucket"], part["n"] = some, total[some]
        for cut in np.split(part, np.flatnonzero(np.diff(some // SEGMENT)) + 1):
            if len(cut):
                yield pd.DataFrame({"segment": [int(cut["bucket"][0]) // SEGMENT], "counts": [cut.tobytes()]})

    def add(key, pdf):
        total = np.zeros(SEGMENT, np.int64)
        for counts in pdf["counts"]:
            part = np.frombuffer(counts, COUNTED)
            total[part["bucket"] % SEGMENT] += part["n"]
        return pd.DataFrame({"segment": [key[0]], "numbers": [total.tobytes()]})

    found = lines.filter("counts IS NOT NULL").select("counts").mapInPandas(run, "segment long, counts binary")
    return joined(found.groupBy("segment").applyInPandas(add, "segment long, numbers binary").collect(), 1 << BUCKET_BITS)


def _rarity(counts: np.ndarray) -> np.ndarray:
    return np.minimum(127, 4 * np.log2(counts + 1.0)).astype(np.uint8)


def prefix_length(size):
    return size - (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR + 1


def keys_of(sets: Sets, frequent_class: int) -> list[np.ndarray]:
    """(k1, k2, line, words behind the key) of all lines; k2 is 0 in keys of one word.

    Words of the rarity class ``frequent_class`` and above make keys of two.
    """
    place = np.arange(len(sets.words)) - sets.start[sets.owner]
    size = sets.size[sets.owner]
    prefix = prefix_length(size)
    frequent = (sets.words >> np.uint64(56) >= frequent_class) & (size > 1)
    one = np.flatnonzero((place < prefix) & ~frequent)
    found = [(sets.words[one], np.zeros(len(one), np.uint64), sets.owner[one], size[one] - place[one] - 1)]
    first = np.flatnonzero((place < prefix) & frequent)
    for step in range(1, int(prefix.max(initial=0)) + 1):
        first = first[place[first] + step <= np.minimum(prefix[first], size[first] - 1)]
        if not len(first):
            break
        found.append((sets.words[first], sets.words[first + step], sets.owner[first], size[first] - place[first] - step - 1))
    return [np.concatenate(c) for c in zip(*found)]


class _New:
    """Classes a task has not met yet; when the memory is full it starts again, and some lines come twice."""

    def __init__(self):
        self.seen = np.zeros(0, np.uint64)  # in order

    def __call__(self, cls: np.ndarray) -> np.ndarray:
        if len(self.seen) > SEEN_LINES:
            self.seen = self.seen[:0]
        values, first = np.unique(cls.astype(np.uint64), return_index=True)
        at = np.searchsorted(self.seen, values)
        fresh = np.ones(len(values), bool)
        inside = at < len(self.seen)
        fresh[inside] = self.seen[at[inside]] != values[inside]
        self.seen = np.insert(self.seen, at[fresh], values[fresh])
        new = np.zeros(len(cls), bool)
        new[first[fresh]] = True
        return new


def _emit_postings(held, frequent_class: int):
    def run(batches):
        is_new = _New()
        for sets, *_ in _sets_of(batches):
            sets.only(is_new(sets.cls))
            sets.put_in_order(held.value)
            k1, k2, owner, rest = keys_of(sets, frequent_class)
            parity, more = sets.parities()
            two = k2 != 0
            key = bytewords.mixed(np.where(two, k1 * np.uint64(bytewords.FACTOR) + k2, k1))
            yield pd.DataFrame({"k1": key.view(np.int64), "k2": two.astype(np.int8), "cls": sets.cls[owner],
                                "parity": parity[owner], "more": more[owner], "extent": sets.size[owner].astype(np.int64) << 32 | rest})

    return run


def _range_of(k1: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a key; keys are hashes, so ranges of equal width hold as many. They ascend with the keys."""
    return ((k1 >> 32) + (1 << 31)) * ranges >> 32


def _pack(batches, ranges: int):
    """Postings by ranges of keys, in order within a row."""
    def packed():
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        order = np.argsort(rows["k1"].to_numpy())
        table = np.empty(len(rows), POSTING)
        for name in POSTING.names:
            table[name] = rows[name].to_numpy()[order]
        place = _range_of(table["k1"], ranges)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        cuts = [*first.tolist(), len(table)]
        return pd.DataFrame({"span": place[first].astype(np.int32), "postings": [table[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    held, waiting = [], 0
    for rows in batches:
        if len(rows):
            held.append(rows)
            waiting += len(rows)
        if waiting >= PACK_ROWS:
            yield packed()
            held, waiting = [], 0
    if held:
        yield packed()


def _unpack(batches):
    """(range, postings) as frames, those of a range one after the other."""
    for batch in batches:
        number = batch["span"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                table = np.frombuffer(b"".join(batch["postings"].iloc[a:b]), POSTING)
                yield pd.DataFrame({"span": number[a]} | {name: np.ascontiguousarray(table[name]) for name in POSTING.names})


def _pair_lists(dense: float, list_size: int):
    """Candidate pairs of the lists of all keys; of crowded lists only links from the first member to the others."""
    def cut(rows, long):
        """Rows of keys that are long, or have been, and the others."""
        k1 = rows["k1"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], k1[1:] != k1[:-1]]))
        length = np.diff(np.append(first, len(k1)))
        over = length > list_size
        if long:
            over |= np.isin(k1[first], list(long))
        long.update(k1[first[over]].tolist())
        mark = np.repeat(over, length)
        return rows[mark], rows[~mark]

    def run(batches):
        held, waiting, at, limit, long = [], 0, None, list_size, set()
        for batch in batches:
            if not len(batch):
                continue
            number = batch["span"].iloc[0] if "span" in batch else 0
            if held and number != at:
                yield from ended(held, long)
                held, waiting, limit, long = [], 0, list_size, set()
            at = number
            held.append(batch)
            waiting += len(batch)
            if waiting > limit:  # members of long lists go, tied to one that stays
                over, rest = cut(_in_order(pd.concat(held, ignore_index=True)), long)
                last = _last_of_lists(over["k1"].to_numpy())
                yield _ties(over["cls"].to_numpy(), last)
                held = [over.iloc[np.unique(last)], rest]
                waiting = sum(map(len, held))
                limit = max(list_size, 2 * waiting)
        if held:
            yield from ended(held, long)

    def ended(held, long):
        over, rest = cut(_in_order(pd.concat(held, ignore_index=True)), long)
        if len(over):
            yield _ties(over["cls"].to_numpy(), _last_of_lists(over["k1"].to_numpy()))
        if len(rest):
            yield from _pairs_of(rest, dense)

    return run


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows by key and size; a line that several tasks have met comes several times and stays once."""
    k1, k2, cls, size = rows["k1"].to_numpy(), rows["k2"].to_numpy(), rows["cls"].to_numpy(), rows["extent"].to_numpy() >> 32
    order = np.argsort(k1)
    k1, k2, size = k1[order], k2[order], size[order]
    fresh = (k1[1:] != k1[:-1]).cumsum()
    group = np.concatenate([[0], fresh]) if len(rows) else fresh
    if len(rows) and int(group[-1]) < 1 << 31 and int(size.max()) < 1 << 31 and not k2[1:][(k1[1:] == k1[:-1]) & (k2[1:] != k2[:-1])].size:
        inner = np.argsort(group << 32 | size)
    else:
        inner = np.lexsort((size, k2, k1))
    order = order[inner]
    k1, k2, cls = k1[inner].view(np.uint64), k2[inner], cls[order].view(np.uint64)
    return rows.iloc[order[_once(k1 + k2.astype(np.uint64), cls)]]


def _last_of_lists(k1: np.ndarray) -> np.ndarray:
    """For each row of keys in order the place of the last row of its key."""
    return np.searchsorted(k1, k1, side="right") - 1


def _ties(cls: np.ndarray, to: np.ndarray) -> pd.DataFrame:
    """Members tied to the ones at the given places, but for those that stand there."""
    others = to != np.arange(len(cls))
    return pd.DataFrame({"a": cls[to[others]], "b": cls[others], "crowd": True})


def _top(root: np.ndarray) -> np.ndarray:
    """Every member's root, in place."""
    while True:
        higher = root[root]
        if (higher == root).all():
            return root
        root[:] = higher


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of a and b; only pairs that still stand apart are looped over."""
    apart = root[a] != root[b]
    if not apart.any():
        return
    _top(root)
    a, b = a[apart], b[apart]
    apart = root[a] != root[b]
    for i, j in zip(a[apart].tolist(), b[apart].tolist()):
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        root[max(i, j)] = min(i, j)


def _pairs_of(rows: pd.DataFrame, dense: float):
    k1, k2, cls, more, extent = (rows[c].to_numpy(np.int64) for c in ("k1", "k2", "cls", "more", "extent"))
    parity = rows["parity"].to_numpy(np.int64) if "parity" in rows else cls  # rows without one: their numbers are parities
    start = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    length = np.diff(np.append(start, len(k1)))
    list_of = np.repeat(np.arange(len(start)), length)
    size, rest = extent >> 32, extent & 0xFFFFFFFF
    left = (start + length)[list_of] - np.arange(len(k1)) - 1  # members behind each one in its list
    at = np.flatnonzero(left > 0)
    crowded, count = np.zeros(len(start), bool), np.zeros(len(start), np.int64)
    involved = np.zeros(len(k1), bool)
    root = np.arange(len(k1))  # members tied by candidates, within their list
    pairs = []
    step = 1
    while len(at):
        other = at + step
        near = size[at] * DENOMINATOR >= size[other] * NUMERATOR  # lists are sorted by size
        at, other = at[near], other[near]
        both = size[at] + size[other]
        reached = np.where(k2[at] == 0, 1, 2) + np.minimum(rest[at], rest[other])
        apart = sum(np.bitwise_count((bits[at] ^ bits[other]).view(np.uint64)).astype(np.int64) for bits in (parity, more))
        hit = _is_similar(reached, both) & _is_similar((both - apart) // 2, both)
        a, b = at[hit], other[hit]
        involved[a] = involved[b] = True
        _unite(root, a, b)
        open_ = ~crowded[list_of[a]]
        pairs.append((a[open_], b[open_]))
        count += np.bincount(list_of[a], minlength=len(start))
        # A list is crowded once it has many candidates for each member that has any.
        if step % 8 == 0 or step < 16:
            crowded |= count > dense * np.maximum(1, np.bincount(list_of[involved], minlength=len(start)))
        step += 1
        at = at[left[at] >= step]
    crowded |= count > dense * np.maximum(1, np.bincount(list_of[involved], minlength=len(start)))
    tied = np.flatnonzero(crowded[list_of] & (_top(root) != np.arange(len(k1))))  # families of one list stay apart
    if len(tied):
        yield pd.DataFrame({"a": cls[root[tied]], "b": cls[tied], "crowd": True})
    a, b = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    open_ = ~crowded[list_of[a]]
    a, b = cls[a[open_]], cls[b[open_]]
    if len(a):
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "crowd": False}).drop_duplicates()


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & ((1 << FILTER_BITS) - 1)
    return (bits[slot >> 6] >> (slot & 63) & 1).astype(bool)


def _emit_sets(wanted_lines, wanted_texts):
    """The word sets of the classes the filter lets through, from the texts the filter lets through."""
    def run(batches):
        texts = (batch[_passes(wanted_texts.value, batch["place"].to_numpy(np.int64))].reset_index(drop=True) for batch in batches)
        for sets, number, ids, tags in _sets_of(texts):
            use = np.flatnonzero(_passes(wanted_lines.value, sets.cls))
            yield pd.DataFrame({"cls": sets.cls[use], "id": ids.iloc[use].astype("Int64"), "tag": tags.iloc[use], "line": number[use],
                                "words": [sets.words[sets.start[i]:sets.start[i] + sets.size[i]].tobytes() for i in use]})

    return run


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes (column h) in a filter of fixed size; a bit that is set for others as well only costs work."""
    slot = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return gathered(found, "word", "bits", 1 << (FILTER_BITS - 6))


# ---------------------------------------------------------------- verification
def _is_similar(overlap, sizes):
    return overlap * (NUMERATOR + DENOMINATOR) >= NUMERATOR * sizes


def _verify(batches):
    """Keep the pairs that are similar."""
    for batch in batches:
        sides = [[np.frombuffer(w, np.uint64) for w in batch[c]] for c in ("words_a", "words_b")]
        sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
        pair = np.concatenate([np.repeat(np.arange(len(batch)), size) for size in sizes])
        words = np.concatenate([x for side in sides for x in side])
        order = np.lexsort((words, pair))
        pair, words = pair[order], words[order]
        both = (pair[1:] == pair[:-1]) & (words[1:] == words[:-1])
        overlap = np.bincount(pair[1:][both], minlength=len(batch))
        yield batch.loc[_is_similar(overlap, sizes[0] + sizes[1]), ["a", "b", "later"]]


def _block_links(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the lines of two blocks of a crowd."""
    _, low, high = (int(k) for k in key)
    words = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
    size = np.array([len(w) for w in words])
    flat, owner = np.concatenate(words), np.repeat(np.arange(len(words)), size)
    _, column, held_by = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held_by[column] > 1
    columns = np.cumsum(held_by > 1) - 1
    table = np.zeros((len(words), max(1, int((held_by > 1).sum()))), np.float32)
    table[owner[shared], columns[column[shared]]] = 1
    left, right = (np.flatnonzero(pdf["block"] == b) for b in (low, high))
    linked = _is_similar(table[left] @ table[right].T, size[left][:, None] + size[right][None, :])
    if low == high:
        np.fill_diagonal(linked, False)
    occurrence = np.lexsort((pdf["line"], pdf["tag"], pdf["id"].fillna(0), pdf["id"].isna()))
    rank = np.empty(len(pdf), np.int64)
    rank[occurrence] = np.arange(len(pdf))
    out = [(left, linked, rank[right][None, :] < rank[left][:, None])]
    if low != high:
        out.append((right, linked.T, rank[left][None, :] < rank[right][:, None]))
    rows = [pd.DataFrame({"cls": pdf["cls"].to_numpy()[side], "links": hits.sum(1).astype(np.int64), "earlier": (hits & sooner).any(1)})
            for side, hits, sooner in out]
    return pd.concat(rows).query("links > 0")


# ---------------------------------------------------------------- the join
def _earliest() -> Column:
    """The first occurrence of a class as a struct that sorts by document and line."""
    return F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("tag"), F.col("line")))


def similar_lines(texts: DataFrame, firsts: DataFrame, rarity: np.ndarray, frequent: int = FREQUENT, dense: float = DENSE,
                  list_size: int = LIST, block: int = BLOCK) -> DataFrame:
    """(cls, links, earlier): how many other classes match a class, and whether one of them is earlier.

    ``firsts`` holds the first place of each class, (cls, first).
    """
    spark = texts.sparkSession
    frequent_class = int(_rarity(np.array([frequent]))[0])
    held = spark.sparkContext.broadcast(rarity)  # a byte for each bucket
    # A range of keys is dealt whole; its lists pass by, and only candidates or ties come out. Postings travel many in a row: a row each
    # costs the JVM more than the join.
    parts = shuffle_partitions(spark)
    emit, lists = _emit_postings(held, frequent_class), _pair_lists(dense, list_size)
    keyed = (texts.mapInPandas(lambda batches: _pack(emit(batches), RANGES * parts), PACKED).repartition(parts, "span")
             .sortWithinPartitions("span"))
    found = stored(keyed.mapInPandas(lambda batches: lists(_unpack(batches)), PAIRS).groupBy("a", "b").agg(F.max("crowd").alias("crowd")), "candidates")
    release(spark)
    crowds = stored(components(found.filter("crowd").select("a", "b")), "crowds")
    # Pairs of one crowd are left to it.
    of = [crowds.select(F.col("vertex").alias(c), F.col("root").alias(f"crowd_{c}")) for c in "ab"]
    pairs = stored(found.filter("NOT crowd").drop("crowd").join(of[0], "a", "left").join(of[1], "b", "left").filter(
        "crowd_a IS NULL OR crowd_b IS NULL OR crowd_a <> crowd_b").select("a", "b"), "pairs")
    # The sets of the lines in question are read from the texts where they stand first; both filters have a fixed number of bits.
    paired = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().withColumn("paired", F.lit(True))
    asked = crowds.withColumnRenamed("vertex", "cls").join(paired, "cls", "full_outer")
    places = stored(asked.join(firsts, "cls").select("cls", "root", "paired", F.col("first").alias("at")), "places")
    lines_filter = spark.sparkContext.broadcast(_filter_of(places.select(F.col("cls").alias("h"))))
    texts_filter = spark.sparkContext.broadcast(_filter_of(places.select(F.xxhash64("at.id", "at.tag").alias("h"))))
    read = texts.withColumn("place", F.xxhash64("id", "tag")).mapInPandas(_emit_sets(lines_filter, texts_filter), SETS)
    here = F.col("id").eqNullSafe(F.col("at.id")) & (F.col("tag") == F.col("at.tag")) & (F.col("line") == F.col("at.line"))
    sets = stored(read.join(places, "cls").filter(here).select("cls", "root", "paired", "at", "words").dropDuplicates(["cls"]), "sets")
    release(spark)
    side = [sets.filter("paired").select(F.col("cls").alias(c), F.col("at").alias(f"at_{c}"), F.col("words").alias(f"words_{c}")) for c in "ab"]
    checked = pairs.join(side[0], "a").join(side[1], "b").select(
        "a", "b", "words_a", "words_b", (F.col("at_a") < F.col("at_b")).alias("later")).mapInPandas(
        _verify, "a long, b long, later boolean")  # later: b comes after a
    links = stored(checked, "links")
    linked = links.select(F.col("a").alias("cls"), F.lit(1).cast("long").alias("links"), (~F.col("later")).alias("earlier")).union(
        links.select("b", F.lit(1).cast("long"), "later"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    sized = crowds.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    dealt = (sets.filter("root IS NOT NULL").join(stored(sized, "sizes"), "root").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls",
                     "at.id", "at.tag", "at.line", "words"))
    many = dealt.groupBy("root", "low", "high").applyInPandas(_block_links, VERDICT)
    return linked.union(many).groupBy("cls").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, tag, line, size, links, removed): a row per line that has words; tag is a hash of the text."""
    texts = _texts(docs, id_col, text_col)
    counted = stored(texts.mapInPandas(_count, LINES), "lines")
    rarity = _rarity(_word_counts(counted))
    lines = counted.filter("counts IS NULL").drop("counts")
    firsts = stored(lines.groupBy("cls").agg(_earliest().alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    matches = similar_lines(texts, firsts.select("cls", "first"), rarity, **options)
    # Most lines stand once and match nothing: only the others need a verdict.
    verdicts = stored(firsts.join(matches, "cls", "left").filter("n > 1 OR links > 0").select(
        "cls", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("earlier", F.lit(False)).alias("earlier")), "verdicts")
    own = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("tag"), F.col("line"))
    return lines.join(verdicts, "cls", "left").select(
        "id", "tag", "line", "size", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce(F.col("earlier") | (own > F.col("first")), F.lit(False)).alias("removed"))


def document_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, tag, lines, removed, links) of each document that has lines; ``removed`` lists line numbers, from 0."""
    parts = shuffle_partitions(docs.sparkSession)
    lines = line_verdicts(docs, id_col, text_col, **options).repartition(parts, "id", "tag").dropDuplicates(["id", "tag", "line"])
    return lines.groupBy("id", "tag").agg(
        F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed"), F.sum("links").alias("links"))


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers."""
    def left(text, numbers):
        lines, gone = (text or "").split("\n"), set() if numbers is None else set(numbers)
        return "\n".join(line for i, line in enumerate(lines) if i not in gone)

    return pd.Series([left(t, n) for t, n in zip(texts, removed)], dtype=object)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents without the lines that match earlier ones; the length column follows."""
    found = document_verdicts(docs, id_col, text_col).filter(F.size("removed") > 0).select(
        F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("removed").alias("__removed"))
    joined = docs.withColumn("__own", F.xxhash64(ref(text_col))).join(
        found, ref(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tag")), "left")
    text = F.when(F.col("__removed").isNull(), ref(text_col)).otherwise(F.pandas_udf(_without, "string")(ref(text_col), F.col("__removed")))
    joined = joined.withColumn("__clean", text)
    new = {text_col: F.col("__clean")} | ({length_col: F.length("__clean").cast("long")} if length_col in docs.columns else {})
    return joined.select(*[new.get(c, ref(c)).alias(c) for c in docs.columns])
