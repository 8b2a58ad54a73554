import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm.alignment import Aligned, Names, align_tokens, most_pairs, terminals, with_link_counts
from lectern.llm.queries import PIECES, VOCABULARY
from lectern.llm.token_counts import byte_letters

LIBRARY = Tokenizer.from_file(VOCABULARY)
LIBRARY.encode_special_tokens = True
LETTERS = byte_letters()
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain(text):
    """(id, bytes) of both kinds by the libraries, or nothing."""
    if not text:
        return [], []
    ids = LIBRARY.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(LETTERS[c] for c in LIBRARY.id_to_token(i))) for i in ids]
    b = []
    for i in MODEL.encode(text):
        piece = MODEL.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if MODEL.is_byte(i) else piece.replace("\u2581", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    return a, b


def cut(a, b):
    """Groups and links, byte by byte."""
    ends = []
    for kind in (a, b):
        at, of = 0, {}
        for i, x in kind:
            at += len(x)
            of[at] = i
        ends.append(of)
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, start = [], 0
    for end in common:
        groups.append(tuple([of[e] for e in sorted(of) if start < e <= end] for of in ends))
        start = end
    return groups, [(ends[0][e], ends[1][e]) for e in common]


def brute(texts):
    rows = [(a, b, *cut(a, b)) for a, b in map(plain, texts)]
    count = Counter(link for *_, links in rows for link in links)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for a, b, groups, links in rows:
        listed = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        best = sum(count[x] == highest[x[1]] for x in links)
        out.append((len(a), len(b), len(groups), listed, len(links), best, sum(count[x] for x in links)))
    return out


TEXTS = [
    "The tokens of both kinds.", "", None, " ", "x", "  two  blanks ", "line\nline\ttab", "<|endoftext|> inside <s> and <unk>",
    "naïve café 北京 🙂🙂", "Ａ full width letter", "e\u0301 combined", "the the the the the", "<0x41> byte-like", "\u2581 sign",
    "\x00 null byte", "zero\u200bwidth", "The tokens of both kinds.",
]


def test_all_columns_equal_the_libraries_cut_byte_by_byte(spark, docs):
    rng = random.Random(4)
    letters = "aeb tion  the,.\n012é北🙂"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(60)]
    texts += ["word " * 2_000 + "end", "x" * 3_000, " " * 120_000 + "late"]
    table = docs([(i if i % 7 else None, t) for i, t in enumerate(texts)]).withColumnRenamed("key", "groups")
    rows = with_link_counts(align_tokens(table, VOCABULARY, PIECES), VOCABULARY, PIECES)
    names = ["n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    got = Counter((r["doc_id"], *[r[c] for c in names]) for r in rows.collect())
    want = Counter((i if i % 7 else None, *row) for i, row in enumerate(brute(texts)))
    assert got == want


def test_empty_tables(docs):
    rows = with_link_counts(align_tokens(docs([]), VOCABULARY, PIECES), VOCABULARY, PIECES)
    assert rows.count() == 0
    rows = with_link_counts(align_tokens(docs([(1, None), (2, "")]), VOCABULARY, PIECES), VOCABULARY, PIECES)
    assert {tuple(r) for r in rows.collect()} == {(i, 0, 0, 0, "", 0, 0, 0) for i in (1, 2)}


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.integers(1, 4), st.booleans(), st.booleans()), max_size=60))
def test_pointers_end_at_the_cuts(steps):
    """Random cuts of the same bytes: labels are constant within a group and differ between."""
    at, a_ends, b_ends = 0, [], []
    for step, in_a, in_b in steps:
        at += step
        if in_a:
            a_ends.append(at)
        if in_b:
            b_ends.append(at)
    a_ends, b_ends = a_ends + [at + 1], b_ends + [at + 1]
    last = terminals(np.array(a_ends), np.array(b_ends))
    cuts = sorted(set(a_ends) & set(b_ends))
    for place, end in enumerate([*a_ends, *b_ends]):
        assert last[place] == len(a_ends) + b_ends.index(next(c for c in cuts if c >= end))


def test_long_groups_take_few_jumps():
    """One group over all bytes: tokens of A end at odd places, those of B at even ones."""
    n = 100_000
    a = np.r_[np.arange(1, 2 * n, 2), 2 * n + 2]
    b = np.r_[np.arange(2, 2 * n + 2, 2), 2 * n + 2]
    assert set(terminals(a, b).tolist()) == {len(a) + len(b) - 1}
    groups = Aligned.of(np.array([0, 1]), np.array([2]), np.array([1, 2, 3]), np.array([1, 2, 3]))
    assert "".join(groups.texts(Names(3))) == "0,1|2;"


def test_the_bound_of_pairs():
    a, b = [b"a", b"ba", b"cba"], [b"a", b"ba", b"ba"]
    ends = sum(x.endswith(y) or y.endswith(x) for x in a for y in b)
    assert most_pairs(a, b) == ends


@pytest.mark.parametrize("n", [1, 3])
def test_rows_equal_in_id_and_text_are_kept(docs, n):
    rows = with_link_counts(align_tokens(docs([(1, "same text")] * n), VOCABULARY, PIECES), VOCABULARY, PIECES)
    (counts,) = {tuple(r) for r in rows.collect()}
    assert counts[-1] == n * counts[-3] and rows.count() == n
