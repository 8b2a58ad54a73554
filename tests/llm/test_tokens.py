import os

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm.packing import TIERS, Piece, encoding, pack, pack_tails, power_cuts, step_groups, token_ids
from lectern.llm.token_counts import Counter, Merges, every_other, token_counts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [
    None, "", " ", "hello world", "a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "it's  we'll \n\n x", "a" * 5000,
    " " * 3000, "\u00e9t\u00e9 na\u00efve 12345", "\u4f60\u597d \u0440\u0443\u0441", "\U0001f600 \u0915\u094d\u0937", "\u0558\ua7cetext",
    "word " * 3000, "x" * 100_000, "\x00\x1f\x85\u2028",
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a b")]
    got = token_counts(docs(rows), PATH).collect()
    want = [(k, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for k, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_counts_of_nothing(docs):
    assert token_counts(docs([]), PATH).collect() == []


COUNTER = Counter(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab '\n.1\u00e9", max_size=80))
def test_counts_as_the_library(text):
    assert COUNTER.count([text]) == [len(ids(text))]
    assert encoding(PATH).encode(text, allowed_special="all") == ids(text)


def test_merges_of_many_sequences_at_once():
    words = [b"aaaa", b"a", b"hello", b" the", b"\xff\xfe", b"abababab" * 50]
    single = [Merges(PATH).count([w])[0] for w in words]
    assert Merges(PATH).count(words).tolist() == single
    assert every_other(np.array([1, 1, 1, 0, 1, 1, 0, 1], bool)).tolist() == [1, 0, 1, 0, 1, 0, 0, 1]


def check_pieces(rows, docs_in):
    whole, sequences = {}, {}
    for r in rows:
        cut = np.frombuffer(r["ids"], "<u4")
        assert len(cut) == r["length"]
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], cut))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"], r["step_group"]))
    wanted = {}
    for key, text in docs_in:
        all_ids = ids(text) + [1]
        wanted.setdefault((key, len(all_ids)), []).append(all_ids)
    for key, cuts in whole.items():
        joined = np.concatenate([c for _, c in sorted(cuts, key=lambda c: c[0])]).tolist()
        assert len(joined) == sum(map(len, wanted[key]))
        if len(wanted[key]) == 1:
            assert joined == wanted[key][0]
    assert whole.keys() == wanted.keys()
    for parts in sequences.values():
        at = 0
        for offset, length, size, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] <= 2048 and at & (at - 1) == 0
        assert len({(p[2], p[3]) for p in parts}) == 1


@pytest.mark.parametrize("pool", [500, 2_000_000])
def test_packing(docs, pool):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a b")]
    check_pieces(pack(docs(rows), PATH, pool_tokens=pool).collect(), rows)


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", " \t"])
def test_long_white_space(blank):
    for n in (99_999, 1_200_000):
        text = "x" + blank * (n // len(blank)) + "y<|endoftext|>z"
        assert token_ids(PATH, text) == ids(text)


def test_packing_long_white_space(docs):
    rows = [(1, "x" + " " * 1_000_500 + "y"), (2, "x" + "\n" * 1_200_000), (3, "a b")]
    check_pieces(pack(docs(rows), PATH).collect(), rows)


def test_packing_nothing(docs):
    assert pack(docs([]), PATH).collect() == []
    with pytest.raises(ValueError):
        pack(docs([]), PATH, tiers=(100, 2048))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=60))
def test_windows_are_full(lengths):
    windows, rest = pack_tails([Piece(i, 0, n) for i, n in enumerate(lengths)], TIERS)
    assert all(sum(p.length for p in w) in TIERS for w in windows)
    cuts = power_cuts(rest)
    seen = {}
    for p in (p for w in windows + cuts for p in w):
        seen.setdefault(p.row, []).append((p.start, p.length))
    for row, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[row]
    assert len(seen) == len(lengths)
    groups = step_groups(windows, 4096)
    for g in set(groups):
        assert sum(sum(p.length for p in w) for w, h in zip(windows, groups) if h == g) <= 4096
