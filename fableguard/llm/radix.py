"""An adaptive radix tree in memory: byte strings with what is summed over all keys below a node.

A node holds a compressed path and one of four layouts of children, which grow with their number: 4 and 16 sorted-by-arrival
key bytes, an index of 256 bytes into 48 places, and 256 places by byte. No key is copied but for the paths.
"""

from __future__ import annotations

from collections.abc import Iterator


class Keys:
    """Up to ``room`` children (4, then 16), found by a search among their key bytes."""

    def __init__(self, room: int = 4) -> None:
        self.room, self.bytes, self.kids = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: Node) -> Layout:
        at = self.bytes.find(byte)
        if at >= 0:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.room:
            larger = Keys(16) if self.room == 4 else Index()
            for b, k in self.items():
                larger.put(b, k)
            return larger.put(byte, kid)
        self.bytes.append(byte)
        self.kids.append(kid)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.kids, strict=True)


class Index:
    """Up to 48 children: a byte's place among them, counted from one, stands in an index of 256 bytes."""

    def __init__(self) -> None:
        self.place, self.kids = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        return self.kids[self.place[byte] - 1] if self.place[byte] else None

    def put(self, byte: int, kid: Node) -> Layout:
        if self.place[byte]:
            self.kids[self.place[byte] - 1] = kid
            return self
        if len(self.kids) == 48:
            larger = Direct()
            for b, k in self.items():
                larger.put(b, k)
            return larger.put(byte, kid)
        self.kids.append(kid)
        self.place[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.place) if at)


class Direct:
    """A place for every byte."""

    def __init__(self) -> None:
        self.kids: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> Layout:
        self.kids[byte] = kid
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, k) for b, k in enumerate(self.kids) if k)


Layout = Keys | Index | Direct


class Node:
    """The keys that start with the bytes down to the end of ``path``: how many, the least owner and what it brings, sums.

    ``sample`` is what came with one of the keys.
    """

    __slots__ = ("path", "layout", "n", "least", "own", "given", "leaves", "sample")

    def __init__(self, path: bytes, n: int, least: int, own: int, given: int, leaves: int, sample: object) -> None:
        self.path, self.layout = path, Keys()
        self.n, self.least, self.own, self.given, self.leaves, self.sample = n, least, own, given, leaves, sample

    def add(self, owner: int, given: int, leaves: int) -> None:
        self.n += 1
        self.given += given
        self.leaves += leaves
        if owner < self.least:
            self.least, self.own = owner, given


def common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes path and key[at:] share at their start."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, len(path)  # the first low bytes are shared, the first high are not
    while high - low > 1:
        mid = (low + high) // 2
        if key.startswith(path[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


class Tree:
    """The radix tree of the keys inserted so far."""

    def __init__(self) -> None:
        self.top: Layout = Keys()

    def insert(self, key: bytes, owner: int, given: int, leaves: int, sample: object) -> None:
        """key isn't empty. It may be a prefix of others, and may come again."""
        above, at = None, 0
        while True:
            layout = above.layout if above else self.top
            node = layout.get(key[at])
            if node is None:
                new = Node(key[at:], 1, owner, given, given, leaves, sample)
            else:
                shared = common(node.path, key, at)
                if shared == len(node.path):
                    new = None
                else:  # the path splits, or the key ends within it
                    new = Node(node.path[:shared], node.n, node.least, node.own, node.given, node.leaves, node.sample)
                    node.path = node.path[shared:]
                    new.layout.put(node.path[0], node)
                    new.add(owner, given, leaves)
            if new:
                grown = layout.put(key[at], new)
                if above:
                    above.layout = grown
                else:
                    self.top = grown
                if node is None:
                    return
                node = new
            else:
                node.add(owner, given, leaves)
            at += len(node.path)
            if at == len(key):
                return
            above = node

    def nodes(self) -> Iterator[tuple[Node, int, int]]:
        """Each node with the byte depths where its path starts and ends."""
        left = [(kid, 0) for _, kid in self.top.items()]
        while left:
            node, start = left.pop()
            end = start + len(node.path)
            yield node, start, end
            left.extend((kid, end) for _, kid in node.layout.items())
