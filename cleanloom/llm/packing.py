"""Lexical retrieval packing: documents that share rare tokens fill a training window together.

1. Documents become token ids with the end mark appended. What fills whole windows is cut off and is a
   sequence of its own; the rest, less than a window, is a piece that has to be packed. The pass also counts in how
   many pieces each token occurs. The vocabulary is fixed, so these counts have a bounded size.
2. Pieces are dealt by content into shards of about ``SHARD_PIECES``: the key of a piece is the token of greatest BM25 weight among those
   that other pieces hold as well. Pieces of one key share a shard; a key of more pieces than a shard holds is spread evenly
   over as many shards as it needs. A shard builds an inverted index with BM25 weights (corpus-wide
   document frequencies and mean length) over the tokens of its pieces. The longest unused piece is the seed of a
   window; its distinct tokens are the query; the unused pieces follow in the order of their scores until the window is
   full. The last of them is cut where the window ends, and its rest stays unused.

A seed so meets the pieces of its key (of a spread key, those in its shard) and of the keys beside it, not the whole corpus.
So only the last window of a shard has room left. A shard holds at most a few megabytes, whatever the documents are like.

Defined cases: a null or empty text is just the end mark; rows without id and repeated rows are packed like any
other; a text of any length is encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import bytewords
from cleanloom.llm.common import ref, stored

WINDOW = 4096
END = 2
SHARD_PIECES = 1024
K1, B = 1.2, 0.75
CHARS_AT_ONCE = BYTES_AT_ONCE = 1 << 20
WORDS_AT_ONCE = 512
MARK = "~"
WORD_END = "</w>"
#: How the tokenizer cuts a text into the parts it encodes one by one, as its file states it (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHED_WORDS = 1_000_000
RUN_BITS = 32
SLOT_BITS = 21  # of the table in which most known words are found
IDS_AT_ONCE = 1 << 20

BLANK, LETTER, DIGIT, OTHER, ODD = range(5)
#: Kinds of bytes to :data:`SPLIT`. Odd ones need the pattern itself: apostrophes, the mark of a special token, control bytes, and
#: characters but ASCII and the letters from U+00C0 to U+017F, which are two bytes after one of LATIN.
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = OTHER
KIND[bytewords.SPACE] = BLANK
KIND[[ord("'"), ord("<")]] = ODD
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
LATIN = (0xC3, 0xC4, 0xC5)
#: Of these, two are no letters and one has no single lower-case letter.
NOT_LATIN = (0xC397, 0xC3B7, 0xC4B0)

PLACE_BITS = 33  # rows a task may emit
SHARD_BITS = 24  # windows a shard may have
WINDOWS_FROM = 1 << 62  # numbers of the sequences cut from one document

PIECE = "doc_id long, place long, start long, doc_tokens long, whole boolean, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- tokens
class Encoder:
    """Ids of texts, word by word: the tokenizer never joins what white space parts, so words can be remembered.

    Plain ASCII words are cut further, as the tokenizer's own pattern does it (a run of letters, a digit, a run of other signs), so that
    a word is learned once, whatever signs stand beside it. A tokenizer with another pattern gets whole words.
    Words are found and looked up as 64-bit hashes, many texts at a time; A-Z count as a-z where the tokenizer cannot tell them
    apart (plain ASCII, and no mark of a special token). New plain words are encoded together by the tokenizer's model alone, as nothing
    is left to normalise or cut; others by the whole tokenizer, parted by a mark that is one token.
    The memory is bounded: when full it starts again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.ends = np.zeros(self.vocabulary, bool)  # tokens that end a run of letters
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.plain = self._model_alone(path)
        self._forget()

    def _model_alone(self, path: str):
        """The tokenizer without its normaliser and pattern; None if these are not the ones :meth:`_edges` knows."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        stated = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (stated["normalizer"] or {}).get("normalizers", [])]
        cuts = (stated["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["pattern"] != {"Regex": SPLIT}:
            return None
        if stated["model"].get("end_of_word_suffix") != WORD_END:
            return None
        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def _forget(self) -> None:
        self.known, self.runs = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # a run of ids: first place, number (low half)
        self.ids, self.filled = np.zeros(1 << 16, self.kind), 0
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)  # place in ``known`` of one of the words whose hashes begin alike

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each) of plain words in lower case."""
        ids, lengths = [], []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at:at + WORDS_AT_ONCE]
            found = self._ids(" ".join(part), self.plain)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) != len(part):
                each = [self._ids(w, self.plain) for w in part]
                found, ends = np.concatenate(each), np.cumsum([len(i) for i in each])
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word. Words of letters alone show where they end, others are parted by the mark."""
        out: list = [None] * len(words)
        letters = [w.isalpha() for w in words]
        for alone in (True, False):
            group = [i for i, plain in enumerate(letters) if plain is alone]
            for at in range(0, len(group), WORDS_AT_ONCE):
                part = group[at:at + WORDS_AT_ONCE]
                for i, ids in zip(part, self._parted([words[i] for i in part], alone), strict=True):
                    out[i] = ids
        return out

    def _parted(self, words: list[str], letters: bool) -> list[np.ndarray]:
        if letters:
            ids = self._ids(" ".join(words))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words):
                return np.split(ids, ends[:-1])
        elif self.mark is not None and not any(MARK in w for w in words):
            ids = self._ids(f" {MARK} ".join(words))
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words) - 1:
                return [ids[a:b] for a, b in zip([0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)])]
        return [self._ids(w) for w in words]

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each) of any words."""
        odd = [MARK in w for w in words]
        order = sorted(range(len(words)), key=odd.__getitem__)  # words that hold the mark last, so that they spoil few parts
        encoded: list = [None] * len(words)
        for i, ids in zip(order, self._encoded([words[i] for i in order])):
            encoded[i] = ids
        return np.concatenate(encoded), np.array([len(i) for i in encoded], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[bytes], plain: np.ndarray) -> None:
        """Add words by their (sorted) hashes."""
        runs = np.empty(len(words), np.int64)
        for which, encode in ((plain, self._together), (~plain, self._whole)):
            at = np.flatnonzero(which)
            if not len(at):
                continue
            ids, size = encode([words[i].decode().lower() if encode == self._together else words[i].decode() for i in at.tolist()])
            runs[at] = self.filled + np.cumsum(size) - size << RUN_BITS | size
            while self.filled + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.filled:self.filled + len(ids)] = ids
            self.filled += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.runs = np.insert(self.known, at, hashes), np.insert(self.runs, at, runs)
        self.slots[self.known >> np.uint64(64 - SLOT_BITS)] = np.arange(len(self.known))

    def _edges(self, codes: np.ndarray):
        """(first byte, byte after the last, whether cut as the pattern does) of all words."""
        first, last = bytewords.edges(codes)
        if self.plain is None or not len(first):
            return first, last, np.zeros(len(first), bool)
        kind = KIND[codes]
        lead = np.flatnonzero((codes >= LATIN[0]) & (codes <= LATIN[-1]))
        lead = lead[~np.isin(codes[lead].astype(np.int64) << 8 | codes[lead + 1], NOT_LATIN)]
        kind[lead] = kind[lead + 1] = LETTER
        odd = _holding(kind == ODD, first)
        begins = kind == DIGIT
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != BLANK)
        if odd.any():
            begins[_within(len(codes), first[odd], last[odd])] = False
        begins[first] = True
        begin = np.flatnonzero(begins)
        heads = np.zeros(len(codes), bool)
        heads[first] = True
        word = np.cumsum(heads[begin], dtype=np.int32) - 1
        return begin, np.minimum(np.append(begin[1:], len(codes)), last[word]), ~odd[word]

    def _hashed(self, data: bytes):
        codes = np.frombuffer(data, np.uint8)
        first, last, plain = self._edges(codes)
        told_apart = _holding((codes > 127) | (codes == ord("<")), first)
        values = bytewords.LOWER[codes]
        if told_apart.any():
            whole = _within(len(codes), first[told_apart], last[told_apart])
            values[whole] = codes[whole] + np.uint64(256)  # never like a folded byte
        return bytewords.hashes(values, first, last), first, last, plain

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; long ones are read in parts, cut at white space."""
        parts = [(i, part) for i, text in enumerate(texts) for part in _cut((text or "").encode())]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0
        for i, part in parts:
            if held and size + len(part) > BYTES_AT_ONCE:
                self._read(held, out)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
        if held:
            self._read(held, out)
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) for ids in out]

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where in ``known`` each word may be."""
        return self.slots[hashes >> np.uint64(64 - SLOT_BITS)].astype(np.int64)

    def _read(self, parts: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        if len(self.known) > CACHED_WORDS:
            self._forget()
        raw = [part for _, part in parts]
        data = b"\n".join(raw)
        begins = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
        hashes, first, last, plain = self._hashed(data)
        word = self._places(hashes)
        away = np.flatnonzero(self.known[word] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(away):  # new words, and those whose slot another one holds
            distinct, example, which = np.unique(hashes[away], return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, distinct)
            new = (self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.ones(len(distinct), bool)
            if new.any():
                at = away[example[new]]
                self._learn(distinct[new], [data[a:b] for a, b in zip(first[at].tolist(), last[at].tolist())], plain[at])
                at, word = np.searchsorted(self.known, distinct), self._places(hashes)
            word[away] = at[which]
            if new.any():  # learning moved words, and may have taken a slot
                moved = np.flatnonzero(self.known[word] != hashes)
                word[moved] = np.searchsorted(self.known, hashes[moved])
        runs = self.runs[word]
        lengths = runs & (1 << RUN_BITS) - 1
        ids = self.ids[_spans(runs >> RUN_BITS, lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])  # ids before each word
        for (i, _), piece in zip(parts, np.split(ids, before[np.searchsorted(first, begins[1:])])):
            out[i].append(piece)


def _holding(marked: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words hold a marked byte; only bytes of words are marked."""
    held = np.zeros(len(first), bool)
    held[np.searchsorted(first, np.flatnonzero(marked), side="right") - 1] = True
    return held


def _within(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which bytes lie in one of these words, no two of which touch."""
    turns = np.zeros(size + 1, np.int8)
    turns[first] = 1
    turns[last] = -1
    return np.cumsum(turns[:-1], dtype=np.int8).view(bool)


def _cut(data: bytes):
    start = 0
    while len(data) - start > BYTES_AT_ONCE:
        end = data.find(b" ", start + BYTES_AT_ONCE)
        if end < 0:
            break
        yield data[start:end]
        start = end + 1
    yield data[start:]


_encoders: dict[str, Encoder] = {}  # one per worker process, used by all its tasks


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(texts: pd.Series):
    """A few texts at a time, up to a number of characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= CHARS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Whole windows and rests of all documents.

    A row without ids closes each task's output: how many rests it had (start), their tokens (doc_tokens), and
    in ``ids`` the number of them that hold each token.
    """
    def run(batches):
        encode = encoder(path or tokenizer_path())
        task = TaskContext.get()
        place = (task.partitionId() if task else 0) << PLACE_BITS
        frequency, rests, tokens = np.zeros(encode.vocabulary, np.int64), 0, 0
        last, places = np.zeros(encode.vocabulary, np.int32), np.arange(window, dtype=np.int32)
        for batch in batches:
            at = 0
            for texts in _slices(batch["text"]):
                names, rows = batch["doc_id"].iloc[at:at + len(texts)], []
                at += len(texts)
                for name, ids in zip(names, encode(texts)):
                    ids = np.append(ids, encode.kind.type(end))
                    for start in range(0, len(ids), window):
                        piece = ids[start:start + window]
                        rows.append((name, place, start, len(ids), len(piece) == window, piece.tobytes()))
                        place += 1
                    if len(piece) < window:
                        last[piece] = places[:len(piece)]
                        frequency[piece[last[piece] == places[:len(piece)]]] += 1  # each token once, where it stands last
                        rests, tokens = rests + 1, tokens + len(piece)
                yield _table(rows)
        if rests:
            yield _table([(None, None, rests, tokens, None, frequency.astype("<i8").tobytes())])

    rows = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).alias("text"))
    return rows.mapInPandas(run, PIECE)


def _table(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "place", "start", "doc_tokens", "whole", "ids"]).astype(
        {"doc_id": "Int64", "place": "Int64", "whole": "boolean"})


# ---------------------------------------------------------------- retrieval and packing of one shard
def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of several runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, token, count) of the distinct tokens of some pieces, by piece and token."""
    flat = np.concatenate(ids)
    shift, kind = (16, np.uint32) if flat.dtype.itemsize == 2 and len(ids) <= 1 << 16 else (32, np.uint64)
    keys = np.sort(np.repeat(np.arange(len(ids), dtype=kind), [len(i) for i in ids]) << kind(shift) | flat.astype(kind))
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(heads, append=len(keys))
    keys = keys[heads]
    return (keys >> kind(shift)).astype(np.int64), (keys & kind((1 << shift) - 1)).astype(np.int64), count


def _groups(sizes: list[int], at_once: int):
    """Ranges of neighbours of about so many ids together."""
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= at_once:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _weight(idf, count, length, mean_length: float):
    return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean_length))


class Index:
    """Inverted index of a shard: for each token the pieces that hold it and its BM25 weight there."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        owner, token, count = _terms(ids)
        self.tokens, self.first = token, np.searchsorted(owner, np.arange(len(ids) + 1))
        order = np.argsort(token.astype(ids[0].dtype), kind="stable")
        lengths = np.array([len(i) for i in ids])[owner]
        weight = _weight(idf[token], count, lengths, mean_length)
        self.pieces, self.weights = owner[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(idf)))])
        self.size = len(ids)

    def scores(self, piece: int) -> np.ndarray:
        terms = self.tokens[self.first[piece]:self.first[piece + 1]]
        at = _spans(self.starts[terms], self.starts[terms + 1] - self.starts[terms])
        return np.bincount(self.pieces[at], self.weights[at], self.size)


def fill(lengths: np.ndarray, scores, window: int):
    """Windows as lists of (piece, start inside it, length). ``scores(piece)`` rates all pieces as neighbours."""
    left = lengths.copy()
    windows = []
    for seed in np.argsort(-lengths, kind="stable"):
        while left[seed]:  # a rest of a cut piece is a seed of its own
            windows.append([(int(seed), int(lengths[seed] - left[seed]), int(left[seed]))])
            room = window - left[seed]
            left[seed] = 0
            unused = np.flatnonzero(left)
            if not room or not len(unused):
                continue
            rated = scores(seed)[unused]
            for piece in unused[np.argsort(-rated, kind="stable")]:
                taken = min(room, left[piece])
                windows[-1].append((int(piece), int(lengths[piece] - left[piece]), int(taken)))
                left[piece] -= taken
                room -= taken
                if not room:
                    break
    return windows


def _pack_shard(idf: np.ndarray, mean_length: float, window: int, kind: np.dtype):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        ids = [np.frombuffer(i, kind) for i in pdf["ids"]]
        index = Index(ids, idf, mean_length)
        names, starts, totals = pdf["doc_id"].tolist(), pdf["start"].tolist(), pdf["doc_tokens"].tolist()
        out = []
        for number, members in enumerate(fill(np.array([len(i) for i in ids]), index.scores, window)):
            offset, sequence = 0, (int(key[0]) << SHARD_BITS) + number
            for piece, start, length in members:
                out.append((names[piece], starts[piece] + start, length, totals[piece], sequence, offset,
                            ids[piece][start:start + length].astype("<u4").tobytes()))
                offset += length
        return pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")]).astype({"doc_id": "Int64"})

    return run


def _as_sequences(kind: np.dtype):
    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(i, kind).astype("<u4") for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "start": batch["start"], "length": np.array([len(i) for i in ids], np.int64),
                                "doc_tokens": batch["doc_tokens"], "sequence_id": WINDOWS_FROM + batch["place"], "offset": np.zeros(len(ids), np.int64),
                                "ids": [i.tobytes() for i in ids]})

    return run


def _frequencies(closing: DataFrame) -> np.ndarray:
    """Number of rests that hold each token: one row per token of the vocabulary reaches the driver."""
    def run(batches):
        for batch in batches:
            total = sum(np.frombuffer(i, "<i8") for i in batch["ids"])
            token = np.flatnonzero(total)
            yield pd.DataFrame({"token": token, "n": total[token], "size": len(total)})

    found = closing.select("ids").mapInPandas(run, "token long, n long, size long").groupBy("token").agg(
        F.sum("n").alias("n"), F.max("size").alias("size")).toPandas()
    frequency = np.zeros(int(found["size"].max()) if len(found) else 1, np.int64)
    frequency[found["token"]] = found["n"]
    return frequency


def _keys(ids: list[np.ndarray], idf, shared, mean_length: float) -> list[int]:
    """Of each piece the token of greatest weight among the shared ones, the smallest of equals."""
    owner, token, count = _terms(ids)
    lengths = np.array([len(i) for i in ids])
    weight = np.where(shared[token], _weight(idf[token], count, lengths[owner], mean_length), -1.0)
    best = np.flatnonzero(weight == np.maximum.reduceat(weight, np.searchsorted(owner, np.arange(len(ids))))[owner])
    return token[best[np.searchsorted(owner[best], np.arange(len(ids)))]].tolist()


def _emit_keys(idf, shared, mean_length: float, kind: np.dtype):
    """The rests with their keys."""
    def run(batches):
        for batch in batches:
            keys, held = [], [np.frombuffer(i, kind) for i in batch["ids"]]
            for start, end in _groups([len(i) for i in held], IDS_AT_ONCE):
                keys += _keys(held[start:end], idf.value, shared.value, mean_length)
            yield batch.assign(key=np.array(keys, np.int64))

    return run


def _shards_of(count: np.ndarray, shard_pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of its first piece, number of pieces it is spread over) of each key, in the order of the keys."""
    first = np.cumsum(count) - count
    return first, np.where(count > shard_pieces, count, 1)


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit numbers)."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, id_col, text_col, window, end), "pieces")
    closing = cut.filter("whole IS NULL")
    seen = closing.agg(F.coalesce(F.sum("start"), F.lit(0)).alias("rests"), F.coalesce(F.sum("doc_tokens"), F.lit(0)).alias("tokens")).first()
    frequency = _frequencies(closing)
    kind = np.dtype("<u2") if len(frequency) <= 1 << 16 else np.dtype("<u4")
    idf = np.log1p((seen["rests"] - frequency + 0.5) / (frequency + 0.5)).astype(np.float64)
    mean = max(1.0, seen["tokens"] / max(1, seen["rests"]))
    held = spark.sparkContext.broadcast(idf)  # a number per token of the vocabulary
    whole = cut.filter("whole").mapInPandas(_as_sequences(kind), PACKED)
    shared = spark.sparkContext.broadcast(frequency > 1)
    keyed = stored(cut.filter("NOT whole").mapInPandas(_emit_keys(held, shared, mean, kind), PIECE + ", key long"), "keyed")
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key").toPandas()  # a row per token of the vocabulary at most
    first, spread = _shards_of(counted["n"].to_numpy(np.int64), shard_pieces)
    places = spark.createDataFrame(list(zip(counted["key"].tolist(), first.tolist(), spread.tolist())), "key long, first long, spread long")
    shard = F.expr(f"(first + pmod(xxhash64(place), spread)) div {int(shard_pieces)}")
    dealt = keyed.join(F.broadcast(places), "key").withColumn("shard", shard).drop("key", "first", "spread")
    packed = dealt.groupBy("shard").applyInPandas(_bound(held, mean, window, kind), PACKED)
    return whole.unionByName(packed)


def _bound(held, mean: float, window: int, kind: np.dtype):
    def run(key, pdf):
        return _pack_shard(held.value, mean, window, kind)(key, pdf)

    return run
