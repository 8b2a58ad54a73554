import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.prefix_trie import SEGMENT, numbered_turns, prefix_trie, rebuilt, trees, whole
from lectern.llm.radix import Direct, Indexed, RadixTree, Sorted, common

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent string, key string, segment string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def chats(spark, docs):
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def tid(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[:16]


def sequences(rows):
    """Conversations as lists of (role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, tid((role or "", text or "")), (role or "", text or "")))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}


def exchanged(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], digest))
    return Counter(out)


def told(df):
    return Counter(tuple(r[c] for c in NAMES) for r in df.select(*NAMES).collect())


def log_of(convs):
    return [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)]


def test_odd_rows(chats):
    rows = [
        (0, None, "user", "first"), (0, 3, "user", "é" * 9), (0, 3, "bot", "tie"), (0, 3, "bot", "tie"), (0, 2, None, None),
        (1, 1, "user", "first"), (1, 1, "user", "first"), (2, 0, "", ""), (None, 1, "user", "no conversation"),
        (-3, 0, "user", "below zero"), (-5, 0, "user", "base"), (-5, None, "user", "base"), (7, 0, "a", "bc"), (8, 0, "ab", "c"),
        (10**15 + 2, 5, "user", "far"),
    ]
    turns = numbered_turns(chats(rows))
    assert told(prefix_trie(turns, whole(turns))) == brute(sequences(rows))
    assert told(prefix_trie(*rebuilt(turns))) == brute(exchanged(sequences(rows)))


def test_long_conversations_share_and_end_anywhere(chats):
    """Around the ends of segments, with copies, beginnings of others and late branches."""
    rng = random.Random(2)
    long = [(rng.choice(["user", "bot"]), f"turn {i}") for i in range(5 * SEGMENT)]
    lengths = [0, 1, SEGMENT - 1, SEGMENT, SEGMENT + 1, 2 * SEGMENT, 2 * SEGMENT + 3, 5 * SEGMENT]
    convs, c = {}, 100
    for n in lengths[1:]:
        for extra in ([], [], [("user", "else")], [("user", f"other {c}")] * (SEGMENT + 2)):
            convs[c] = long[:n] + extra
            c -= 1
    rows = log_of(convs)
    rng.shuffle(rows)
    turns = numbered_turns(chats(rows))
    assert told(prefix_trie(turns, whole(turns))) == brute(convs)
    assert told(prefix_trie(*rebuilt(turns))) == brute(exchanged(convs))


def test_a_conversation_of_a_third_of_all_rows_and_a_common_beginning(chats):
    convs = {c: [("user", "hello")] * (c % 3) + [("bot", f"{c % 11}")] for c in range(400)}
    convs[5] = [("user", "hello")] * 600
    turns = numbered_turns(chats(log_of(convs)))
    assert told(prefix_trie(turns, whole(turns))) == brute(convs)


def test_random_conversations(chats):
    rng = random.Random(9)
    turn = lambda: (rng.choice(["u", "b"]), rng.choice(["x", "yy", "zzz", "ü"]))
    convs = {rng.randrange(-50, 500): [turn() for _ in range(rng.randint(1, 14))] for _ in range(150)}
    turns = numbered_turns(chats(log_of(convs)))
    assert told(prefix_trie(*rebuilt(turns))) == brute(exchanged(convs))


def test_empty_tables(chats):
    turns = numbered_turns(chats([]))
    assert prefix_trie(*rebuilt(turns)).count() == 0
    turns = numbered_turns(chats([(None, 1, "user", "x")]))
    assert prefix_trie(turns, whole(turns)).count() == 0
    # Left without turns: a root alone.
    rows = [(3, 0, "user", "gone")]
    assert exchanged(sequences(rows)) == {3: []}
    assert told(prefix_trie(*rebuilt(numbered_turns(chats(rows))))) == brute({3: []})


@settings(deadline=None, max_examples=200)
@given(st.lists(st.binary(max_size=6), max_size=60))
def test_trees_hold_every_key(keys):
    tree = RadixTree()
    for key in keys:
        tree.at(key, list).append(key)
    for key in keys:
        assert tree.at(key, list) == [key] * keys.count(key)
    below = Counter()
    for parent, node, start, end in tree.walk():
        assert end - start == len(node.path) + (parent is not None)
        below[id(node)] += len(node.value or [])
        if node.value:
            assert len(node.value[0]) == end
        if parent is not None:
            below[id(parent)] += below[id(node)]
            # Paths are compressed: what neither ends nor branches is no node.
            assert node.value is not None or len(list(node.branches.items())) > 1
    assert below[id(tree.root)] == len(keys)


def test_layouts_grow_with_the_branches():
    tree, kinds = RadixTree(), []
    for n in range(1, 257):
        tree.at(bytes([n * 7 % 256, 1]), list)
        kinds.append((type(tree.root.branches), getattr(tree.root.branches, "room", None)))
    assert kinds == [(Sorted, 4)] * 4 + [(Sorted, 16)] * 12 + [(Indexed, None)] * 32 + [(Direct, None)] * 208
    assert [b for b, _ in tree.root.branches.items()] == list(range(256))
    assert common(b"abcd", b"abxd") == 2 and common(b"", b"a") == 0 and common(b"ab", b"abc") == 2


def test_small_trees_give_the_same_sums(spark, chats):
    """However many segments a tree holds, its rows add up to the same."""
    import pyarrow as pa

    rows = [(c, 0, b"s" * 16, b"k" * 16 * (c % 4), [5] * (c % 4), None) for c in range(40)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()])],
        ["conv_id", "segment", "start", "key", "sizes", "stop"],
    )
    sums = []
    for most in (1, 7, 1_000):
        total = Counter()
        for out in trees(False, most)(iter([batch])):
            for r in out.to_pylist():
                total[r["node"], r["parent"], r["depth"], r["size"]] += r["n_convs"]
        sums.append(total)
    assert sums[0] == sums[1] == sums[2]
