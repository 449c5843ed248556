"""Adaptive radix tree over byte strings, with node layouts that grow and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

# Children of the four layouts; a full node moves to the next.
SMALL, MEDIUM, LARGE, FULL = 4, 16, 48, 256


class Sorted:
    """Few children: key bytes in order beside their nodes."""

    __slots__ = ("keys", "nodes", "limit")

    def __init__(self, limit: int, keys: bytearray | None = None, nodes: list | None = None):
        self.limit, self.keys, self.nodes = limit, keys or bytearray(), nodes or []

    def find(self, byte: int):
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node) -> "Sorted | Indexed":
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.limit:
            larger = Sorted(MEDIUM, self.keys, self.nodes) if self.limit == SMALL else Indexed(self)
            return larger.put(byte, node)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def all(self) -> Iterator:
        return iter(self.nodes)

    def __len__(self) -> int:
        return len(self.keys)


class Indexed:
    """Up to 48 children: one index byte for every key byte."""

    __slots__ = ("places", "nodes")

    def __init__(self, other: Sorted):
        self.places, self.nodes = bytearray([FULL - 1]) * FULL, list(other.nodes)
        for at, byte in enumerate(other.keys):
            self.places[byte] = at

    def find(self, byte: int):
        at = self.places[byte]
        return self.nodes[at] if at < LARGE else None

    def put(self, byte: int, node) -> "Indexed | Direct":
        at = self.places[byte]
        if at < LARGE:
            self.nodes[at] = node
            return self
        if len(self.nodes) == LARGE:
            return Direct(self).put(byte, node)
        self.places[byte] = len(self.nodes)
        self.nodes.append(node)
        return self

    def all(self) -> Iterator:
        return (self.nodes[at] for at in self.places if at < LARGE)

    def __len__(self) -> int:
        return len(self.nodes)


class Direct:
    """More children: one place for every key byte."""

    __slots__ = ("nodes",)

    def __init__(self, other: Indexed):
        self.nodes = [other.find(byte) for byte in range(FULL)]

    def find(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> "Direct":
        self.nodes[byte] = node
        return self

    def all(self) -> Iterator:
        return (node for node in self.nodes if node is not None)

    def __len__(self) -> int:
        return sum(node is not None for node in self.nodes)


class Node:
    """``path`` holds the bytes between the parent's branch byte and this node; ``held`` is a key's value that ends here."""

    __slots__ = ("path", "held", "children", "sums")

    def __init__(self, path: bytes, held=None):
        self.path, self.held, self.children, self.sums = path, held, None, None

    def put(self, byte: int, node: "Node") -> None:
        self.children = (self.children or Sorted(SMALL)).put(byte, node)

    def below(self) -> Iterator["Node"]:
        return self.children.all() if self.children else iter(())


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, held) -> None:
        """Add a key; ``held`` must not be None. A key that is there already gets the new value."""
        node, at, parent, branch = self.root, 0, None, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = shared(path, key[at : at + len(path)])
                above = Node(path[:same])
                above.put(path[same], node)
                node.path = path[same + 1 :]
                if parent is None:
                    self.root = above
                else:
                    parent.put(branch, above)
                node, path = above, above.path
            at += len(path)
            if at == len(key):
                node.held = held
                return
            child = node.children.find(key[at]) if node.children else None
            if child is None:
                node.put(key[at], Node(key[at + 1 :], held))
                return
            node, parent, branch, at = child, node, key[at], at + 1
