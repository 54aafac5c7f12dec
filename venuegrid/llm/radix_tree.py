"""An adaptive radix tree over byte strings of whole fixed-width symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

#: The children that each node layout holds at most; a full node takes the next one.
LAYOUTS = (4, 16, 48, 256)


class _Node:
    """An inner node or a leaf: the bytes below its parent (``path``, compressed), what the
    keys that end here carry, and children by their next byte.

    Layouts 4 and 16 keep sorted bytes beside their children; 48 keeps a table from byte to
    place; 256 has a place for every byte.
    """

    __slots__ = ("path", "value", "layout", "bytes", "children", "used")

    def __init__(self, path: bytes, value: Any = None) -> None:
        self.path, self.value = path, value
        self.layout, self.used = LAYOUTS[0], 0
        self.bytes: Any = bytearray()
        self.children: list[_Node | None] = []

    def child(self, byte: int) -> _Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: _Node) -> None:
        """Add a child, or replace the one of this byte."""
        if self.layout <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = node
                return
            if self.used == self.layout:
                self._grow()
                self.put(byte, node)
                return
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.layout == 48:
            if at := self.bytes[byte]:
                self.children[at - 1] = node
                return
            if self.used == self.layout:
                self._grow()
                self.put(byte, node)
                return
            self.children.append(node)
            self.bytes[byte] = len(self.children)
        else:
            self.used += self.children[byte] is None
            self.children[byte] = node
            return
        self.used += 1

    def _grow(self) -> None:
        known = list(self)
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 16:
            return
        if self.layout == 48:
            self.bytes, self.children = bytearray(256), [node for _, node in known]
            for place, (byte, _) in enumerate(known, 1):
                self.bytes[byte] = place
        else:
            self.bytes, self.children = bytearray(), [None] * 256
            for byte, node in known:
                self.children[byte] = node

    def __iter__(self) -> Iterator[tuple[int, _Node]]:
        """Children by byte, ascending."""
        if self.layout <= 16:
            yield from zip(self.bytes, self.children, strict=True)
        elif self.layout == 48:
            yield from ((b, self.children[p - 1]) for b, p in enumerate(self.bytes) if p)
        else:
            yield from ((b, c) for b, c in enumerate(self.children) if c is not None)


class RadixTree:
    """Keys of whole symbols of ``width`` bytes, each with a value."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.root = _Node(b"")

    def insert(self, key: bytes, value: Any) -> None:
        """Add a key that is not there yet."""
        if len(key) % self.width:
            raise ValueError("a key has to consist of whole symbols")
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                node.put(key[at], _Node(key[at:], value))
                return
            path = below.path
            if not key.startswith(path, at):
                same = _common(path, key, at)
                fork = _Node(path[:same])
                node.put(key[at], fork)
                below.path = path[same:]
                fork.put(path[same], below)
                below = fork
            node, at = below, at + len(below.path)
        node.value = value

    def layouts(self) -> dict[int, int]:
        """How many nodes have each layout."""
        found, todo = dict.fromkeys(LAYOUTS, 0), [self.root]
        while todo:
            node = todo.pop()
            found[node.layout] += 1
            todo.extend(below for _, below in node)
        return found

    def walk(self) -> Iterator[tuple[bool, int, bytes, bytes, Any]]:
        """Depth first, each symbol-aligned depth on a path as a node: (True, depth, digest of
        the prefix, its last symbol, value of the key that ends there) on entry and
        (False, depth, digest, symbol, None) when all below it has been seen.

        Digests are MD5 of the prefix, carried on from the parent's, so a path costs its length.
        """
        width = self.width
        start = hashlib.md5()
        yield True, 0, start.digest(), b"", self.root.value
        # Frames: children left, unaligned bytes so far, state and depth there, nodes to leave.
        frames = [(iter(self.root), b"", start, 0, [])]
        while frames:
            below, rest, state, depth, entered = frames[-1]
            found = next(below, None)
            if found is None:
                frames.pop()
                for leave in reversed(entered):
                    yield False, *leave, None
                continue
            node = found[1]
            bytes_ = rest + node.path
            whole = len(bytes_) // width
            entered = []
            for k in range(whole):
                symbol = bytes_[k * width : (k + 1) * width]
                state = state.copy()
                state.update(symbol)
                depth += 1
                entered.append((depth, state.digest(), symbol))
                ends = node.value if (k + 1) * width == len(bytes_) else None
                yield True, *entered[-1], ends
            frames.append((iter(node), bytes_[whole * width :], state, depth, entered))
        yield False, 0, start.digest(), b"", None


def _common(path: bytes, key: bytes, at: int) -> int:
    """Leading bytes that ``path`` shares with ``key`` from ``at`` on."""
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if path[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low
