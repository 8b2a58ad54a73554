"""Plain answers to compare with, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re


def components(rows, percent=75, n_words=5):
    """``(n, component)`` per row of ``(id, text)``, by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        if len(words) < n_words:
            sets.append(frozenset([tuple(words)]) if words else frozenset())
        else:
            sets.append(frozenset(tuple(words[i : i + n_words]) for i in range(len(words) - n_words + 1)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        known = [k for k in least[root(i)] if k is not None]
        out.append((len(sets[i]), (min(known) if known else None) if sets[i] else key))
    return out


def repeats(texts, length):
    """Spans of bytes covered by strings that start at two places or more, per text."""
    raws = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        spans = []
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        out.append(spans)
    return out


def water_fill(sizes, weights, cap):
    """Targets by sharing excess again and again; ``sizes`` by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    capped = set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        targets = {s: cap * sizes[s] if s in capped else left * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and targets[s] > cap * sizes[s]}
        if not over:
            return targets
        capped |= over


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """Base spans by the patterns as they are given."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
