"""Adaptive radix trees over keys of fixed-width ids.

An inner node branches on one byte. Its layout grows with its branches: 4 or 16 sorted bytes
beside their children, 48 children behind an index of 256 bytes, or 256 children. Bytes
that don't branch are kept as a path in the node below them, so a tree has no more inner
nodes than keys. A key may end where others go on.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

NONE = 255


class Sorted:
    """Up to ``room`` branches: their bytes in order beside the children."""

    __slots__ = ("bytes", "children", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.children, self.room = bytearray(), [], room

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, child: Node) -> Sorted | Indexed:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = child
            return self
        if len(self.bytes) == self.room:
            grown = Sorted(16) if self.room == 4 else Indexed()
            for b, c in self.items():
                grown.put(b, c)
            return grown.put(byte, child)
        self.bytes.insert(at, byte)
        self.children.insert(at, child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.children)


class Indexed:
    """Up to 48 branches: an index by byte of places among the children."""

    __slots__ = ("places", "children")

    def __init__(self):
        self.places, self.children = bytearray([NONE]) * 256, []

    def get(self, byte: int) -> Node | None:
        place = self.places[byte]
        return None if place == NONE else self.children[place]

    def put(self, byte: int, child: Node) -> Indexed | Direct:
        if self.places[byte] != NONE:
            self.children[self.places[byte]] = child
            return self
        if len(self.children) == 48:
            grown = Direct()
            for b, c in self.items():
                grown.put(b, c)
            return grown.put(byte, child)
        self.places[byte] = len(self.children)
        self.children.append(child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.children[p]) for b, p in enumerate(self.places) if p != NONE)


class Direct:
    """A child for each byte."""

    __slots__ = ("children",)

    def __init__(self):
        self.children: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.children[byte]

    def put(self, byte: int, child: Node) -> Direct:
        self.children[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, c) for b, c in enumerate(self.children) if c is not None)


class Node:
    """The bytes that lead here from the branch above, what ends here, and the branches."""

    __slots__ = ("path", "value", "branches")

    def __init__(self, path: bytes, value: Any = None, branches: Sorted | Indexed | Direct | None = None):
        self.path, self.value, self.branches = path, value, branches


def common(a: bytes, b: bytes) -> int:
    """How many bytes both begin with."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    """Values by key; ``first()`` makes the value of a key that is new."""

    def __init__(self):
        self.root = Node(b"")

    def at(self, key: bytes, first: Any) -> Any:
        """The value of ``key``."""
        node, at = self.root, 0
        while True:
            same = common(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                # The path splits: what follows the common part becomes a branch.
                rest = Node(node.path[same + 1 :], node.value, node.branches)
                byte = node.path[same]
                node.path, node.value, node.branches = node.path[:same], None, Sorted().put(byte, rest)
            at += same
            if at == len(key):
                if node.value is None:
                    node.value = first()
                return node.value
            child = node.branches.get(key[at]) if node.branches else None
            if child is None:
                leaf = Node(key[at + 1 :], first())
                node.branches = (node.branches or Sorted()).put(key[at], leaf)
                return leaf.value
            node, at = child, at + 1

    def walk(self) -> Iterator[tuple[Node | None, Node, int, int]]:
        """Every node after those below it: its parent, the node, and the depths in bytes at
        which its parent's bytes and its own end."""
        stack: list[tuple[Node | None, Node, int, bool]] = [(None, self.root, 0, False)]
        while stack:
            parent, node, start, done = stack.pop()
            # A branch's byte counts as the first of the child's own.
            end = start + len(node.path) + (parent is not None)
            if done or node.branches is None:
                yield parent, node, start, end
                continue
            stack.append((parent, node, start, True))
            stack.extend((node, child, end, False) for _, child in node.branches.items())
