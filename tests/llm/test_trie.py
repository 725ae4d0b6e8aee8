import hashlib
import zlib
from collections import defaultdict

import pytest

from cleanloom.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, block string, n1 long"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def by_hand(rows):
    """The contract, word by word, on whole sequences."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", md5(text or ""), text or ""))
    plain = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in convs.items()}
    whole = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = plain.get(int(c - c % 100 if c >= 0 else -(-c - -c % 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        cost = (len(held) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += cost
    return sorted((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), children[path], leaves[path], saved[path],
                   hashlib.sha256(",".join(map(str, sorted(c for c in held if len(whole[c]) == len(path)))).encode()).hexdigest())
                  for path, held in members.items())


def got(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)
    return sorted(tuple(r) for r in trie.prefix_trie(table).collect())


CASES = {
    "nulls, ties, repeats": [(0, 1, "user", "a"), (0, None, "system", "s"), (0, 1, "assistant", "a"), (0, 1, "user", "a"), (1, 0, None, None),
                             (1, 0, "", ""), (None, 0, "user", "lost"), (2, 5, "user", "b" * 100_000), (-5, 0, "user", "a"), (-105, 0, "user", "ü€")],
    "turnless": [(c, 0, "user", "a") for c in range(301, 310)],
    "long": [(c, t, "user", f"turn {t}" if t < 30 or c % 3 == 0 else f"own {c % 7} {t}") for c in (0, 3, 6, 100, 101, 205, 206, 207) for t in range(20 + 7 * (c % 9))],
    "growing": [(c, t, "user", f"t{t}") for c in range(400, 425) for t in range(c - 398)],
    "hot": [(c, t, "user", f"t{t}") for c in range(200) for t in range(3)] + [(c, 3, "user", str(c)) for c in range(0, 200, 2)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_whole_sequences(spark, name):
    assert got(spark, CASES[name]) == by_hand(CASES[name])


def test_pieces_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "STRETCH", 2)
    for name in ("hot", "long"):
        assert got(spark, CASES[name]) == by_hand(CASES[name])


def test_one_plan_for_all_lengths(spark):
    """The prefixes of all blocks come from one ROLLUP."""
    table = spark.createDataFrame([(*r, "x", 1) for r in CASES["long"]], COLUMNS)
    nodes = trie.trie_nodes(trie.blocks(trie.rebuilt(trie.numbered_turns(table))))
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1
