"""Personal data in texts, with offset-preserving deobfuscation.

Plain identifiers are found by fixed patterns. Then the text goes through transducers that
undo disguises and keep, for every character they write, the span of characters it was read
from: look-alike characters and invisible ones, "at" and "dot" written out, and digits
spelled as words. The same patterns run over the result, and what they find beyond the plain
identifiers is mapped back to spans of the text as it is.

Patterns run in time proportional to the text: each run of characters is entered once.

Plain identifiers have no limits beyond their formats. What is written out in words is taken
for an address only within the limits that mail addresses and host names have anyway: local
parts of up to 64 characters, labels of up to 63, and at most five labels behind the sign, the
last one of two to 24 letters; beyond them plain prose would be rewritten. Dots written out
behind an address sign belong to one label of up to 80 characters each, and up to three
white-space characters may stand around a word or bracket, so that a wrapped line still counts
but not words paragraphs apart. A disguise beyond these limits is not found.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

# The possessive local part is entered at its first character only; after a match the next
# search may start inside a run, which AT_ONCE tries first.
_ADDRESS = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_ADDRESS}")
AT_ONCE = re.compile(_ADDRESS)
DOTTED = re.compile(r"[0-9]\.[0-9]")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    if "@" not in text:
        return
    while found := AT_ONCE.match(text, at) or EMAIL.search(text, at):
        yield found.span()
        at = found.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    if not DOTTED.search(text):
        return
    for found in IP.finditer(text):
        parts = [p.lstrip("0") for p in found.groups()]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield found.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in CARD.finditer(text):
        if found.end() - found.start() < 16:
            continue
        digits = digits_of(found.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for found in PHONE.finditer(text):
        if 8 <= len(digits_of(found.group())) <= 15:
            yield found.span()


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(
    zip(KINDS, (emails, ips, cards, phones))
)


def plain(text: str) -> list[Span]:
    """Identifiers as they stand, by kind, then place."""
    return [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](text)]


class Tape:
    """A rewritten text; character i was read from ``start[i]:end[i]`` of the original."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.touched = np.zeros(len(text), bool)

    def translate(self, table: dict[int, str]) -> None:
        """Replace single characters."""
        before, self.text = self.text, self.text.translate(table)
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (before, self.text)]
        self.touched |= codes[0] != codes[1]

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace spans of the tape, given in order and apart from each other; what is
        written for a span stands for all of it."""
        if not changes:
            return
        texts, starts, ends, touched, at = [], [], [], [], 0
        for a, b, new in changes:
            texts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            touched += [self.touched[at:a], np.ones(len(new), bool)]
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])
        self.touched = np.concatenate([*touched, self.touched[at:]])


# Letters of other scripts that look like a Latin letter, and that letter.
LOOKALIKES = dict(
    zip(
        "асеорхуіјѕԁɡһոԛԝАВСЕНІЈКМОРЅТХУαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aceopxyijsdghnqwABCEHIJKMOPSTXYaovptuikABEZHIKMNOPTYX",
        strict=True,
    )
)
# Characters that stand for a mark.
MARKS = {"\u2024": ".", "\u3002": ".", "\uff61": ".", "\u00b7": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\ufe6b": "@"}
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


@functools.cache
def lookalike(char: str) -> str:
    """What a character stands for; itself if it stands for nothing else."""
    if char in INVISIBLE:
        return ""
    if found := LOOKALIKES.get(char) or MARKS.get(char):
        return found
    if "！" <= char <= "～":  # full-width forms follow ASCII
        return chr(ord(char) - ord("！") + ord("!"))
    digit = unicodedata.decimal(char, None)
    return str(digit) if digit is not None else char


# All decimal digits beyond ASCII, by rule.
_DIGITS = "".join(c for c in map(chr, range(128, 0x20000)) if unicodedata.decimal(c, None) is not None)
_SEEN = "".join(map(re.escape, [*LOOKALIKES, *MARKS, *INVISIBLE])) + "！-～" + _DIGITS
CHARACTER = re.compile(f"[{_SEEN}]")
HIDDEN = re.compile(f"[{INVISIBLE}]+")
# What most texts lack, as quick tests ahead of the costlier patterns.
BEYOND_LATIN = re.compile("[\u00a0\u00ad\u00b7\u0261\u0370-\U0010ffff]")
BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|AT|At|@|dot|DOT|Dot|\.)\s{0,3}[\])}>]")
DOT_WORD = re.compile(r"\s(?:dot|DOT)\s")


class Lookalikes(dict):
    """Characters and what they stand for, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        self[code] = lookalike(chr(code)) or chr(code)
        return self[code]


STAND_FOR = Lookalikes()

AT_SIGN = re.compile(r"(?<=[A-Za-z0-9])\s{0,3}[\[({<]\s{0,3}(?:at|AT|At|@)\s{0,3}[\])}>]\s{0,3}(?=[A-Za-z0-9])")
DOT_SIGN = re.compile(
    r"(?<=[A-Za-z0-9])\s{0,3}[\[({<]\s{0,3}(?:dot|DOT|Dot|\.)\s{0,3}[\])}>]\s{0,3}(?=[A-Za-z0-9])"
)
# Words that follow "at" in plain prose.
_ARTICLES = "a|an|the|this|that|my|your|his|her|our|their|its|least|all|any"
# Written without brackets, both words must be there, in this order, around plain names.
SPOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?P<at>\s{1,3}(?:at|AT)\s{1,3})"
    rf"(?!(?:{_ARTICLES})\s)[A-Za-z0-9-]{{1,63}}"
    r"(?:(?:\s{1,3}(?:dot|DOT)\s{1,3}|\.)[A-Za-z0-9-]{1,63}){0,4}?\s{1,3}(?:dot|DOT)\s{1,3}[A-Za-z]{2,24}(?![A-Za-z0-9])"
)
SPOKEN_DOT = re.compile(r"\s{1,3}(?:dot|DOT)\s{1,3}")
# A local part may hold dots written out too.
LOCAL_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}(?:dot|DOT)\s{1,3}(?=[A-Za-z0-9._%+-]{1,64}@)")

# Words for digits.
DIGIT_WORDS = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890"))
_DIGIT = "|".join(DIGIT_WORDS)
_ONE = rf"(?:(?:double|triple)[ -])?(?:{_DIGIT}|[0-9])"
SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[ -]{{0,2}}|\+ ?)?{_ONE}(?:(?:,? |[-.,]| ?(?:dot|point) )?{_ONE})++(?![A-Za-z])", re.IGNORECASE
)
SPELLED_PART = re.compile(rf"plus|\+|dot|point|\.|double|triple|{_DIGIT}|[0-9]", re.IGNORECASE)
# Two neighbours of a run in a lower-cased text, and letters that a pattern without case takes
# for an "i" or "s" but ``lower`` doesn't.
HAS_SPELLED = re.compile(rf"(?:{_DIGIT})(?:,? |[-.,]| ?(?:dot|point) )?{_ONE}")
ODD_CASE = re.compile("[\u0130\u0131\u017f]")


def signs(text: str) -> list[tuple[int, int, str]]:
    changes = [(*m.span(), "@") for m in AT_SIGN.finditer(text)]
    changes += [(*m.span(), ".") for m in DOT_SIGN.finditer(text)]
    for m in SPOKEN.finditer(text):
        a, b = m.span("at")
        changes.append((a, b, "@"))
        changes += [(*d.span(), ".") for d in SPOKEN_DOT.finditer(text, b, m.end())]
    return apart(changes)


def dots(text: str) -> list[tuple[int, int, str]]:
    """Dots written out around an address sign that is there by now."""
    changes = [(*m.span(), ".") for m in LOCAL_DOT.finditer(text)]
    for m in re.finditer(r"@[A-Za-z0-9.-]{1,80}", text):
        at = m.end()
        while d := re.compile(r"\s{1,3}(?:dot|DOT)\s{1,3}(?=[A-Za-z0-9])").match(text, at):
            changes.append((*d.span(), "."))
            name = re.compile(r"[A-Za-z0-9.-]{1,80}").match(text, d.end())
            at = name.end()
    return apart(changes)


def apart(changes: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for change in sorted(changes):
        if not out or change[0] >= out[-1][1]:
            out.append(change)
    return out


def numbers(text: str) -> list[tuple[int, int, str]]:
    """Runs with at least four digits spelled as words. A run of 10 to 15 digits without
    dots or a sign is taken for a phone number."""
    changes = []
    for m in SPELLED.finditer(text):
        out, times, spelled = [], 1, 0
        for part in SPELLED_PART.findall(m.group()):
            part = part.lower()
            if part in ("double", "triple"):
                times = 2 if part == "double" else 3
            elif part in ("plus", "+"):
                out.append("+")
            elif part in ("dot", "point", "."):
                out.append(".")
            else:
                spelled += part in DIGIT_WORDS
                out.append(DIGIT_WORDS.get(part, part) * times)
                times = 1
        new = "".join(out)
        if spelled < 4:
            continue
        if new.isdigit() and 10 <= len(new) <= 15:
            new = "+" + new
        changes.append((*m.span(), new))
    return changes


def disguised(text: str) -> bool:
    """Whether a transducer may change the text: true for every text that one does change."""
    return bool(
        (BEYOND_LATIN.search(text) and CHARACTER.search(text))
        or BRACKETED.search(text)
        or (("dot" in text or "DOT" in text) and DOT_WORD.search(text))
        or HAS_SPELLED.search(text.lower())
        or (not text.isascii() and ODD_CASE.search(text))
    )


def unmasked(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only show once disguises are undone, none over one of ``base``."""
    tape = Tape(text)
    if not text.isascii():
        tape.translate(STAND_FOR)
        tape.rewrite([(*m.span(), "") for m in HIDDEN.finditer(tape.text)])
    for step in (signs, dots, numbers):
        tape.rewrite(step(tape.text))
    if tape.text == text:
        return []
    taken = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    out: list[Span] = []
    for kind, a, b in plain(tape.text):
        start, end = int(tape.start[a]), int(tape.end[b - 1])
        if end - start == b - a and not tape.touched[a:b].any():
            continue
        if all(end <= x or y <= start for x, y in taken[kind]):
            taken[kind].append((start, end))
            out.append((kind, start, end))
    return out


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, base`` by kind, then place."""
    if not text:
        return []
    base = plain(text)
    more = unmasked(text, base) if disguised(text) else []
    rows = [(*s, True) for s in base] + [(*s, False) for s in more]
    return sorted(rows, key=lambda r: (KINDS.index(r[0]), r[1]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` per row of ``docs``: spans of code points, end exclusive, by kind
    (email, ip, card, phone), then start; ``base`` marks those that stand there plainly.

    A null or empty text has none. Repeated rows, and rows with a null id, have their own.
    Other columns of ``docs`` are left out. An empty table gives no rows. The module says how
    far disguises are followed.
    """
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t.as_py())] for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], ["key", "spans"])

    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"key {key_type}, spans {SPANS}").withColumnRenamed("key", id_col)


def redact(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind; of overlapping ones, by that of
    the first."""
    found = sorted((a, -b, kind) for kind, a, b, _ in spans(text))
    if not found:
        return text
    parts, at = [], 0
    for a, minus_b, kind in found:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -minus_b)
    return "".join([*parts, text[at:]])


def redacted(text: Column | str) -> Column:
    """A text without its personal data; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py()) for t in texts], pa.string())

    return run(text)


def span_list(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
