"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language. The score of a labelling is the sum of word scores and of learned scores for going
from one label to the next; word scores come from character n-grams, from affixes (n-grams that hold the beginning or the
end of the word) and from a lexicon (the most frequent words of each language in the sample). Forward-backward
gives each word's probabilities with the whole text around it, so mixed text is labelled word by word. A document's
language is the one with the largest mean probability over its words, and that mean is its score.

The field is fitted on a bounded sample: for each language the ``FIT_DOCS`` labelled documents that come first by a hash of
their identifier (whole ones of up to ``FIT_CHARS`` characters before parts of that length of longer ones), and ``FIT_WORDS`` words of them. Their words are cut
into runs, and runs of different languages are put behind each other, so that transitions are learned too. Feature
weights have a fixed number of slots. Everything else reads every word of every text.

Forward-backward runs over many documents at once: a batch of texts is one chain that forgets its past where a document begins. The chain is
cut into pieces of equal length; the pieces' transfer matrices are multiplied step by step for all pieces side by side, the
pieces are joined, and the vectors inside follow the same way.

Defined cases: null texts and texts without a letter get ``und`` with score 0, and so does every text if no labelled document was
given; labelled rows without identifier are not learned from; ties go to the first language in code point order; repeated rows get equal
results; an empty table gives no rows; other columns are kept.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import ref

UNKNOWN = "und"
FIT_DOCS, FIT_CHARS, FIT_WORDS = 400, 20_000, 30_000
SPARE = 4  # candidates per document of the sample
LEXICON = 2_000  # words a language
SLOTS = 1 << 16
GRAMS, AFFIXES = (1, 2, 3), (4, 5)  # lengths; word ends count as characters
RUN_WORDS = (3, 30)  # shortest and longest run of one language in a spliced text
SEQUENCE = 64
STEPS, RATE, DECAY = 40, 0.15, 1e-4
PIECE = 64
TEXTS_AT_ONCE, CHARS_AT_ONCE = 64, 1 << 20
CACHED_WORDS = 400_000
REJECT_BELOW = 0.4
_WORDS = re.compile(r"[^\W\d_]+").findall
_BEGIN, _END = 2, 3


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


# ---------------------------------------------------------------- features
def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, starts): feature slots of all words, one after the other, and where each word's begin."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    codes = np.empty(ends[-1], np.uint64)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = inner[ends - lengths] = False
    codes[ends - lengths], codes[ends - 1] = _BEGIN, _END
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(words)), lengths)
    slots, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(AFFIXES) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        whole = owner[:len(rolled)] == owner[n - 1:]
        if n in AFFIXES:
            whole &= (codes[:len(rolled)] == _BEGIN) | (codes[n - 1:] == _END)
        mixed = (rolled[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        slots.append((mixed >> np.uint64(48)).astype(np.int64) % SLOTS)
        owners.append(owner[:len(rolled)][whole])
    listed = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if listed:
        owners.append(np.array([i for i, _ in listed]))
        slots.append(SLOTS + np.array([s for _, s in listed]))
    owners, slots = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.searchsorted(owners[order], np.arange(len(words)))


# ---------------------------------------------------------------- the field
@dataclass
class Field:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # (SLOTS + lexicon, labels)
    moves: np.ndarray  # (labels, labels), from row to column
    known: dict[str, int] = field(default_factory=dict)  # word -> row of ``rows``, -1 without a letter
    rows: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        slots, starts = features(words, self.lexicon)
        counts = np.diff(np.append(starts, len(slots)))
        return np.add.reduceat(self.weights[slots], starts) / np.sqrt(counts)[:, None]

    def _learn(self, words: list[str]) -> None:
        alpha = [w for w in words if any(map(str.isalpha, w))]
        size = 0 if self.rows is None else len(self.rows)
        if alpha:
            scores = self.word_scores(alpha).astype(np.float32)
            self.rows = scores if self.rows is None else np.concatenate([self.rows, scores])
        self.known.update(dict.fromkeys(words, -1))
        self.known.update(zip(alpha, range(size, size + len(alpha))))

    def marginals(self, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
        """The words of each text and their label probabilities."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.rows = {}, None
        parted = [words_of(t) for t in texts]
        found = [list(map(self.known.get, words)) for words in parted]
        new = {w for words, at in zip(parted, found) if None in at for w, i in zip(words, at) if i is None}
        if new:
            self._learn(sorted(new))
            found = [list(map(self.known.__getitem__, words)) if None in at else at for words, at in zip(parted, found)]
        at = [np.array(i, np.int64) for i in found]
        parted = [words if (i >= 0).all() else [w for w, k in zip(words, i) if k >= 0] for words, i in zip(parted, at)]
        at = [i[i >= 0] for i in at]
        lengths = np.array([len(i) for i in at])
        ends = np.cumsum(lengths)
        if not ends[-1]:
            return parted, [np.zeros((0, len(self.labels)))] * len(texts)
        begins = np.zeros(ends[-1], bool)
        begins[(ends - lengths)[lengths > 0]] = True
        gamma = forward_backward(self.rows[np.concatenate(at)].astype(np.float64), begins, self.moves)
        return parted, np.split(gamma, ends[:-1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text."""
        if not self.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        means = [g.mean(axis=0) if len(g) else None for g in self.marginals(texts)[1]]
        return ([UNKNOWN if m is None else self.labels[int(m.argmax())] for m in means],
                [0.0 if m is None else float(min(1.0, m.max())) for m in means])


def forward_backward(scores: np.ndarray, begins: np.ndarray, moves: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Label probabilities of all words of a chain; the chain forgets its past where ``begins`` is set."""
    n, k = scores.shape
    pieces = -(-n // piece)
    emit = np.ones((pieces * piece, k))
    emit[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    fresh = np.ones(pieces * piece, bool)  # what pads the last piece tells nothing about the words before
    fresh[:n] = begins
    fresh[0] = True
    emit, fresh = emit.reshape(pieces, piece, k), fresh.reshape(pieces, piece)
    go = np.exp(moves - moves.max())

    def step(state, at):
        """One word on, for states of shape (pieces, rows, labels)."""
        moved = (state.reshape(-1, k) @ go).reshape(state.shape)
        if fresh[:, at].any():
            moved = np.where(fresh[:, at, None, None], state.sum(axis=2, keepdims=True), moved)
        moved *= emit[:, at, None, :]
        return moved / moved.max(axis=(1, 2), keepdims=True)

    whole = np.broadcast_to(np.eye(k), (pieces, k, k))
    for at in range(piece):
        whole = step(whole, at)
    enter, leave = np.ones((pieces, 1, k)), np.ones((pieces, 1, k))
    for i in range(1, pieces):
        vector = enter[i - 1] @ whole[i - 1]
        enter[i] = vector / vector.max()
    for i in range(pieces - 2, -1, -1):
        vector = whole[i + 1] @ leave[i + 1, 0]
        leave[i, 0] = vector / vector.max()
    ahead = np.empty((pieces, piece, k))
    state = enter
    for at in range(piece):
        state = step(state, at)
        ahead[:, at] = state[:, 0]
    behind = leave[:, 0]
    for at in range(piece - 1, -1, -1):
        ahead[:, at] *= behind
        weighted = behind * emit[:, at]
        moved = weighted @ go.T
        if fresh[:, at].any():
            moved = np.where(fresh[:, at, None], weighted.sum(axis=1, keepdims=True), moved)
        behind = moved / moved.max(axis=1, keepdims=True)
    gamma = ahead.reshape(-1, k)[:n]
    return gamma / gamma.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- fitting
def _spliced(texts: dict[str, list[list[str]]], labels: list[str], draw) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of ``SEQUENCE`` words made of runs of one language each, and their labels."""
    runs = []
    for number, label in enumerate(labels):
        for words in texts[label]:
            at = 0
            while at < len(words):
                size = int(draw.integers(*RUN_WORDS))
                runs.append([(w, number) for w in words[at:at + size]])
                at += size
    order = draw.permutation(len(runs))
    # Half of the runs follow the run they followed in their text, so that long stretches are seen as well.
    order = np.sort(order[: len(order) // 2]).tolist() + order[len(order) // 2:].tolist()
    flat = [pair for i in order for pair in runs[i]]
    flat += flat[: -len(flat) % SEQUENCE]
    flat += flat * (-(-SEQUENCE // len(flat)) - 1) if len(flat) < SEQUENCE else []
    flat = flat[: len(flat) // SEQUENCE * SEQUENCE]
    return [w for w, _ in flat], np.array([n for _, n in flat]).reshape(-1, SEQUENCE)


def _expectations(emit: np.ndarray, moves: np.ndarray):
    """Label probabilities and summed transition probabilities of sequences of equal length."""
    count, length, k = emit.shape
    emit = np.exp(emit - emit.max(axis=2, keepdims=True))
    go = np.exp(moves)
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    ahead[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        state = (ahead[:, t - 1] @ go) * emit[:, t]
        ahead[:, t] = state / state.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        state = (behind[:, t + 1] * emit[:, t + 1]) @ go.T
        behind[:, t] = state / state.sum(1, keepdims=True)
    gamma = ahead * behind
    gamma /= gamma.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(1, length):
        joint = ahead[:, t - 1, :, None] * go * (emit[:, t] * behind[:, t])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
    return gamma, pairs


def fit(rows: list[tuple[str, str]], seed: int = 3) -> Field:
    """Fit on (language, text) rows by gradient steps on the likelihood of spliced sequences."""
    draw = np.random.default_rng(seed)
    labels = sorted({label for label, _ in rows}, key=lambda x: x.encode())
    texts: dict[str, list[list[str]]] = {label: [] for label in labels}
    left = dict.fromkeys(labels, FIT_WORDS)
    for label, text in rows:
        words = [w for w in words_of(text) if any(map(str.isalpha, w))][:left[label]]
        left[label] -= len(words)
        if words:
            texts[label].append(words)
    labels = [label for label in labels if texts[label]]
    if not labels:
        return Field([], {}, np.zeros((SLOTS, 0)), np.zeros((0, 0)))
    frequent = sorted({w for label in labels for w, _ in sorted(
        Counter(w for words in texts[label] for w in words).items(), key=lambda x: (-x[1], x[0]))[:LEXICON]})
    lexicon = {w: i for i, w in enumerate(frequent)}
    k = len(labels)
    model = Field(labels, lexicon, np.zeros((SLOTS + len(lexicon), k)), np.zeros((k, k)))
    words, gold = _spliced(texts, labels, draw)
    types = sorted(set(words))
    place = {w: i for i, w in enumerate(types)}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words)).reshape(gold.shape)
    slots, starts = features(types, lexicon)
    counts = np.diff(np.append(starts, len(slots)))
    scale = 1 / np.sqrt(counts)[:, None]
    owner = np.repeat(np.arange(len(types)), counts)
    wanted = np.zeros((k, k))
    np.add.at(wanted, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.moves)]
    for turn in range(1, STEPS + 1):
        emit = (np.add.reduceat(model.weights[slots], starts) * scale)[at]
        gamma, pairs = _expectations(emit, model.moves)
        error = np.eye(k)[gold] - gamma
        by_type = np.stack([np.bincount(at.ravel(), error[:, :, j].ravel(), len(types)) for j in range(k)], axis=1) * scale
        ascent = np.stack([np.bincount(slots, by_type[owner, j], len(model.weights)) for j in range(k)], axis=1) / gold.size
        for value, gradient, (first, second) in zip((model.weights, model.moves), (ascent, (wanted - pairs) / gold.size), state):
            gradient = gradient - DECAY * value
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient ** 2 - second)
            value += RATE * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-8)
    return model


# ---------------------------------------------------------------- Spark jobs
def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept for testing; rows without identifier are not."""
    return F.coalesce(F.crc32(ref(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    labelled = (docs.filter(~held_out(id_col) & ref(id_col).isNotNull() & ref(lang_col).isNotNull() & ref(text_col).isNotNull())
                .select(ref(lang_col).cast("string").alias("label"), ref(id_col).alias("id"), ref(text_col).alias("text"),
                        (F.length(ref(text_col)) > FIT_CHARS).alias("long"), F.xxhash64(ref(id_col)).alias("h")))
    # Rows are thinned out by their hash where they are read, to a few times the sample, so that no language is one task's load.
    # One row per language comes back, as many as the field has labels.
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("long"), 1)).alias("short")).collect()
    enough = {r["label"]: r["short"] >= FIT_DOCS for r in sizes}
    share = {r["label"]: SPARE * FIT_DOCS / (r["short"] if enough[r["label"]] else r["n"]) for r in sizes}
    of_label = lambda known, other: F.try_element_at(F.create_map(
        *[F.lit(x) for pair in known.items() for x in pair]), F.col("label")) if known else F.lit(other)
    thin = labelled.filter((~F.col("long") | ~of_label(enough, False))
                           & ((F.col("h").cast("double") + float(1 << 63)) / float(1 << 64) <= of_label(share, 1.0)))
    first = Window.partitionBy("label").orderBy("long", "h", "id", "text")
    rows = (thin.withColumn("text", F.left("text", F.lit(FIT_CHARS))).withColumn("nth", F.row_number().over(first))
            .filter(F.col("nth") <= FIT_DOCS).select("label", "nth", "text").collect())
    return fit([(r["label"], r["text"]) for r in sorted(rows, key=lambda r: (r["label"].encode(), r["nth"]))])


def _slices(texts: pd.Series):
    """A few texts at a time, by number and by characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if len(part) >= TEXTS_AT_ONCE or size >= CHARS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def predicted(docs: DataFrame, model: Field, text_col: str = "text", name: str = "language") -> DataFrame:
    """The documents with a further column, a struct of ``lang`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each language

    @F.pandas_udf("struct<lang: string, score: double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = [], []
            for part in _slices(texts):
                found = held.value.predict(part)
                langs += found[0]
                scores += found[1]
            yield pd.DataFrame({"lang": langs, "score": scores})

    # Marked so, it is never copied into each place that reads the column: a text is labelled once.
    return docs.withColumn(name, label.asNondeterministic()(ref(text_col)))


def word_labels(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nth, word, lang, probability): the label of every word of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = 0
            for part in _slices(batch["text"]):
                names = batch["id"].iloc[at:at + len(part)]
                at += len(part)
                if not held.value.labels:
                    continue
                for name, words, gamma in zip(names, *held.value.marginals(part)):
                    if len(words):
                        yield pd.DataFrame({"id": pd.array([name] * len(words), "Int64"), "nth": range(len(words)), "word": words,
                                            "lang": [held.value.labels[i] for i in gamma.argmax(1)], "probability": gamma.max(1)})

    return docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text")).mapInPandas(
        run, "id long, nth long, word string, lang string, probability double")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject_below: float = REJECT_BELOW) -> DataFrame:
    """The documents in which one language prevails; a missing language is filled in.

    Without a labelled document to learn from, all documents that have a letter stay as they are.
    """
    model = fit_on(docs, id_col, text_col, lang_col)
    if not model.labels:
        return docs.filter(ref(text_col).rlike(r"\p{L}"))
    named = predicted(docs, model, text_col, "__language")
    good = named.filter((F.col("__language.lang") != UNKNOWN) & (F.col("__language.score") >= reject_below))
    filled = F.coalesce(ref(lang_col), F.col("__language.lang"))
    return good.select(*[filled.alias(c) if c == lang_col else ref(c) for c in docs.columns])
