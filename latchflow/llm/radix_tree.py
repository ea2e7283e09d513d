"""Adaptive radix tree over byte keys: four node layouts that grow, and path compression.

A node stands for a run of key bytes [start, end) of its `row`, the first key that came through it.
Its children differ in the byte at `end`. Nodes hold up to 4 or 16 children in sorted lists, up to 48
behind an index of 256 bytes, or 256 slots. Keys that are beginnings of others end at inner nodes.
"""

from bisect import bisect_left, insort

LAYOUTS = (4, 16, 48, 256)


class Node:
    __slots__ = ("row", "start", "end", "last", "layout", "bytes", "slots")

    def __init__(self, row: int, start: int, end: int, last: int = -1):
        self.row, self.start, self.end = row, start, end
        #: Row of the key that ends here, or -1.
        self.last = last
        self.layout, self.bytes, self.slots = 4, bytearray(), []

    def child(self, byte: int) -> "Node | None":
        if self.layout == 256:
            return self.slots[byte]
        if self.layout == 48:
            place = self.bytes[byte]
            return self.slots[place - 1] if place else None
        place = bisect_left(self.bytes, byte)
        return self.slots[place] if place < len(self.bytes) and self.bytes[place] == byte else None

    def put(self, byte: int, node: "Node") -> None:
        """Add a child, or replace the one at this byte."""
        if self.layout == 256:
            self.slots[byte] = node
            return
        if self.layout == 48:
            if self.bytes[byte]:
                self.slots[self.bytes[byte] - 1] = node
                return
        else:
            place = bisect_left(self.bytes, byte)
            if place < len(self.bytes) and self.bytes[place] == byte:
                self.slots[place] = node
                return
        if len(self.slots) == self.layout:
            self._grow()
            self.put(byte, node)
        elif self.layout == 48:
            self.slots.append(node)
            self.bytes[byte] = len(self.slots)
        else:
            insort(self.bytes, byte)
            self.slots.insert(place, node)

    def _grow(self) -> None:
        pairs = list(self.items())
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 48:
            self.bytes, self.slots = bytearray(256), [n for _, n in pairs]
            for place, (byte, _) in enumerate(pairs, 1):
                self.bytes[byte] = place
        elif self.layout == 256:
            self.bytes, self.slots = bytearray(), [None] * 256
            for byte, node in pairs:
                self.slots[byte] = node

    def items(self):
        """(byte, child) in the order of bytes."""
        if self.layout == 256:
            return [(b, n) for b, n in enumerate(self.slots) if n is not None]
        if self.layout == 48:
            return [(b, self.slots[p - 1]) for b, p in enumerate(self.bytes) if p]
        return list(zip(self.bytes, self.slots, strict=True))


def common(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common beginning of two keys that agree in the first `low` bytes."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def grown(keys: list[bytes]) -> Node:
    """The tree of distinct keys; its root stands for the empty beginning."""
    root = Node(0, 0, 0)
    for row, key in enumerate(keys):
        node = root
        while True:
            at = node.end
            if at == len(key):
                node.last = row
                break
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(row, at, len(key), row))
                break
            same = min(common(key, keys[below.row], at), below.end)
            if same < below.end:
                fork = Node(below.row, at, same)
                below.start = same
                fork.put(keys[below.row][same], below)
                node.put(key[at], fork)
                below = fork
            node = below
    return root


def preorder(root: Node) -> list[tuple[Node, int]]:
    """All nodes, parents before children, each with its parent's place in the list (-1 for the root)."""
    out, open_ = [], [(root, -1)]
    while open_:
        node, above = open_.pop()
        open_ += [(child, len(out)) for _, child in reversed(node.items())]
        out.append((node, above))
    return out
