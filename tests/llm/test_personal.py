import random
import sys
import time

import pytest

from lectern.llm.personal import INVISIBLE, disguised, find_personal, lookalike, plain, redact, redacted, spans, unmasked
from tests.llm import brute

DISGUISED = [
    ("write john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john(at)example.com", "email", "john(at)example.com"),
    ("john.smith at example dot co dot uk!", "email", "john.smith at example dot co dot uk"),
    ("j\u043ehn@ex\u0430mple.com", "email", "j\u043ehn@ex\u0430mple.com"),
    ("j\u200bohn@exam\u200bple.com", "email", "j\u200bohn@exam\u200bple.com"),
    ("x \uff4a\uff20\uff45\uff0e\uff43\uff4f y", "email", "\uff4a\uff20\uff45\uff0e\uff43\uff4f"),
    ("call plus one five five five two three four five six seven eight", "phone", "plus one five five five two three four five six seven eight"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("\uff14\uff19\uff12\uff13\uff14\uff13\uff17\uff18\uff12\uff17\uff10\uff17\uff11\uff19\uff11\uff11", "card", "\uff14\uff19\uff12\uff13\uff14\uff13\uff17\uff18\uff12\uff17\uff10\uff17\uff11\uff19\uff11\uff11"),
]

CLEAN = [
    "look at the dot com boom", "I am at home", "one two three four", "see you at seven", "\u041f\u0440\u0438\u0432\u0435\u0442 at work",
    "one of the two or three", "a [at] b", "version 1.2.3 at 10.30", "caf\u00e9 at noon dot",
]


@pytest.mark.parametrize("text, kind, part", DISGUISED)
def test_disguises(text, kind, part):
    at = text.index(part)
    assert spans(text) == [(kind, at, at + len(part), False)]
    assert redact(text) == text.replace(part, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert spans(text) == [] and redact(text) is text


def test_plain_as_the_patterns_say():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.-_+ 0123(2) 1.1\u00e9") for _ in range(rng.randint(0, 60)))
        assert plain(text) == brute.personal(text)
        assert [s[:3] for s in spans(text) if s[3]] == brute.personal(text)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "+1 ", "@", "a@", "one ", " at ", " dot ", "\u0430", "[at]", "@a dot ", " "])
def test_long_texts_take_their_length(unit):
    text = unit * (200_000 // len(unit))
    start = time.process_time()
    plain(text)
    spans(text)
    assert time.process_time() - start < 5


def test_table(docs):
    rows = [(1, None), (2, ""), (3, "a@b.co 10.0.0.1"), (3, "a@b.co 10.0.0.1"), (None, "a@b.co"), (4, "x [at] y.com a@b.co")]
    got = {(r["doc_id"], i): [tuple(s) for s in r["spans"]] for i, r in enumerate(find_personal(docs(rows)).collect())}
    assert sorted(got.values(), key=str) == sorted((spans(t) for _, t in rows), key=str)
    assert find_personal(docs([])).collect() == []
    texts = docs(rows).select(redacted("text").alias("t")).collect()
    assert sorted(str(r["t"]) for r in texts) == sorted(str(redact(t)) for _, t in rows)
    assert "[EMAIL] [IP]" in [r["t"] for r in texts]


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write john at example\ndot com now", "email", "john at example\ndot com"),
        ("write john at example\tdot\tcom now", "email", "john at example\tdot\tcom"),
        ("four,one,five,five,five,two,six,seven,one,nine", "phone", "four,one,five,five,five,two,six,seven,one,nine"),
        ("x_fouronefivefivefivetwosixsevenonenine", "phone", "fouronefivefivefivetwosixsevenonenine"),
        ("jo\u0261@a.com", "email", "jo\u0261@a.com"),
    ],
)
def test_disguises_the_gate_must_let_through(text, kind, part):
    at = text.index(part)
    assert spans(text) == [(kind, at, at + len(part), False)]


def test_the_gate_lets_all_stand_ins_through():
    for c in map(chr, range(sys.maxunicode + 1)):
        if lookalike(c) != c or c in INVISIBLE:
            assert disguised(c), hex(ord(c))


def test_spans_with_and_without_the_gate_agree():
    rng = random.Random(5)
    words = (
        "john at AT dot DOT [at] (dot) example com co.uk zero one two three four FIVE six seven Eight nine oh 1 55 double "
        "triple plus + point \u0261 \u017fix f\u0131ve a@b \u00e9 _"
    ).split()
    marks = [" ", " ", " ", "", ",", ", ", "-", ".", "\n", "\t", "  "]
    found = 0
    for _ in range(30_000):
        kinds = rng.choice([words, words[:9], words[9:26]])
        some = rng.choice([marks, marks[:3], ["\n", " "], [","]])
        text = "".join(rng.choice(kinds) + rng.choice(some) for _ in range(rng.randint(4, 16)))
        more = unmasked(text, plain(text))
        found += bool(more)
        assert disguised(text) or not more, text
    assert found > 300
