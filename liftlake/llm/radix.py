"""Adaptive radix tree over byte keys: path compression and node layouts that grow from 4 to 16, 48 and 256 children.

Keys need not be prefix-free. Every node sums the measures of the keys at or
below it, so a walk reads a subtree's totals off its top.
"""

from __future__ import annotations

from collections.abc import Iterator


class _Sorted:
    """Up to 4 or 16 children: their bytes in order beside their nodes."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node) -> "_Sorted | _Indexed":
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            wider = _Sorted(16) if self.room == 4 else _Indexed()
            for b, n in self.items():
                wider.put(b, n)
            return wider.put(byte, node)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator:
        return zip(self.bytes, self.nodes)


class _Indexed:
    """Up to 48 children: a table of 256 slots into a short list."""

    __slots__ = ("slot", "nodes")

    def __init__(self):
        self.slot, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.slot[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> "_Indexed | _Full":
        if self.slot[byte]:
            self.nodes[self.slot[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            wider = _Full()
            for b, n in self.items():
                wider.put(b, n)
            return wider.put(byte, node)
        self.nodes.append(node)
        self.slot[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator:
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.slot) if at)


class _Full:
    """A node for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> "_Full":
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class _Node:
    __slots__ = ("path", "children", "least", "sums")

    def __init__(self, path: bytes, least: tuple, sums: tuple):
        self.path, self.children, self.least, self.sums = path, None, least, sums

    def link(self, byte: int, node: "_Node") -> None:
        self.children = (self.children or _Sorted()).put(byte, node)

    def add(self, least: tuple, sums: tuple) -> None:
        self.least = min(self.least, least)
        self.sums = tuple(a + b for a, b in zip(self.sums, sums))


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class RadixTree:
    """``add`` puts a key with its measures in; ``walk`` yields every compressed node with its totals."""

    def __init__(self):
        self.top: _Node | None = None

    def add(self, key: bytes, least: tuple, sums: tuple) -> None:
        if self.top is None:
            self.top = _Node(key, least, sums)
            return
        above, edge, node = None, 0, self.top
        while True:
            n = _shared(node.path, key)
            if n < len(node.path):      # the key leaves inside the compressed path: split it
                fork = _Node(node.path[:n], node.least, node.sums)
                fork.link(node.path[n], node)
                node.path = node.path[n + 1:]
                if above is None:
                    self.top = fork
                else:
                    above.link(edge, fork)
                node = fork
            node.add(least, sums)
            if n == len(key):
                return
            above, edge, key = node, key[n], key[n + 1:]
            node = above.children.get(edge) if above.children else None
            if node is None:
                above.link(edge, _Node(key, least, sums))
                return

    def walk(self) -> Iterator[tuple[bytes, int, tuple, tuple]]:
        """(bytes from the top, where the parent's ended, least, sums) of each node, parents first."""
        stack = [(self.top, b"", -1)] if self.top else []
        while stack:
            node, before, start = stack.pop()
            path = before + node.path
            yield path, start, node.least, node.sums
            for byte, child in node.children.items() if node.children else ():
                stack.append((child, path + bytes((byte,)), len(path)))
