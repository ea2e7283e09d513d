"""Signature trees: pairs of sets above a Jaccard limit by traversing two trees at once.

Leaves hold one set's bitmap of hashed tokens and its size. Nodes hold the OR of their children's
bitmaps and the range of their sizes. Two nodes can hold a linked pair only if some overlap is both
possible (tokens fall on bits that both bitmaps have) and enough (for the smallest sizes below them);
other node pairs are pruned, as are pairs whose sets are all connected already. What reaches two
leaves is compared exactly. All functions are plain numpy over the sets of one or two blocks.
"""

import numpy as np

from latchflow.llm.common import U64, mix

FAN = 8
#: Bitmap words looked at in one step of the traversal.
STEP_WORDS = 1 << 20


class Tree:
    """Levels of nodes over sets in an order that keeps like sets close."""

    def __init__(self, sets: list[np.ndarray], bits: int, share: float):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        lows = np.array([s[0] for s in sets], dtype=np.uint64)
        band = np.floor(np.log(sizes) / -np.log(share)).astype(np.int64)
        self.order = np.lexsort((lows, band))
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, at in enumerate(self.order):
            place = mix(sets[at]) & U64(bits - 1)
            np.bitwise_or.at(maps[i], (place >> U64(6)).astype(np.int64), U64(1) << (place & U64(63)))
        sizes = sizes[self.order]
        self.maps, self.low, self.high = [maps], [sizes], [sizes]
        self.extra = [sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)]
        self.starts: list[np.ndarray] = []
        while len(self.low[-1]) > 1:
            starts = np.arange(0, len(self.low[-1]), FAN)
            self.starts.append(starts)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], starts))
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            self.extra.append(np.maximum.reduceat(self.extra[-1], starts))

    def raise_to(self, level: int) -> None:
        """Repeat the root until the tree has the given level."""
        while len(self.low) <= level:
            self.starts.append(np.zeros(1, dtype=np.int64))
            for part in (self.maps, self.low, self.high, self.extra):
                part.append(part[-1])


class Linked:
    """Labels of sets that are connected; nodes with one label throughout need no visit together."""

    def __init__(self, labels: np.ndarray):
        self.of = labels
        self.dirty = True

    def join(self, a: int, b: int) -> None:
        keep, gone = sorted((self.of[a], self.of[b]))
        self.of[self.of == gone] = keep
        self.dirty = True

    def spans(self, tree: Tree, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest label below each node, per level; `at` are the tree's sets."""
        low = high = self.of[at]
        out = [(low, high)]
        for starts in tree.starts:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append((low, high))
        return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def width(sets: list[np.ndarray]) -> int:
    """Bits of a bitmap: four times the largest set, less where that would take over 32 MB."""
    bits = 64
    while bits < 4 * max(map(len, sets)) and bits * len(sets) < 1 << 28:
        bits *= 2
    return bits


def link(sets: list[np.ndarray], labels: np.ndarray, percent: int, split: int | None = None) -> np.ndarray:
    """Labels after joining all sets linked by chains of pairs at or above `percent`.

    With `split`, only pairs of a set before it and a set from it on are looked at; pairs inside a
    side are those of other calls.
    """
    linked = Linked(labels.copy())
    bits, share = width(sets), percent / 100
    if split is None:
        left = right = Tree(sets, bits, share)
        left_at = right_at = left.order
    else:
        left, right = Tree(sets[:split], bits, share), Tree(sets[split:], bits, share)
        top = max(len(left.low), len(right.low)) - 1
        left.raise_to(top)
        right.raise_to(top)
        left_at, right_at = left.order, right.order + split
    words, same = bits // 64, split is None
    limit = max(1, STEP_WORDS // (words * FAN * FAN))
    zero = np.zeros(1, dtype=np.int64)
    stack = [(len(left.low) - 1, zero, zero)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > limit:
            stack.append((level, a[limit:], b[limit:]))
            a, b = a[:limit], b[:limit]
        if linked.dirty:
            spans_a = linked.spans(left, left_at)
            spans_b = spans_a if same else linked.spans(right, right_at)
            linked.dirty = False
        a, b = _possible(left, right, level, a, b, percent, spans_a[level], spans_b[level], same)
        if not len(a):
            continue
        if level:
            stack.append((level - 1, *_children(left, right, level, a, b, same)))
            continue
        for i, j in zip(left_at[a].tolist(), right_at[b].tolist(), strict=True):
            if linked.of[i] != linked.of[j] and similar(sets[i], sets[j], percent):
                linked.join(i, j)
    return linked.of


def _possible(left, right, level, a, b, percent, spans_a, spans_b, same):
    """Node pairs that are not wholly connected and whose largest possible overlap is enough."""
    one = (spans_a[0][a] == spans_a[1][a]) & (spans_b[0][b] == spans_b[1][b]) & (spans_a[0][a] == spans_b[0][b])
    low_a, low_b, high_a, high_b = left.low[level][a], right.low[level][b], left.high[level][a], right.high[level][b]
    near = (high_a * 100 >= percent * low_b) & (high_b * 100 >= percent * low_a) & ~one
    if same and not level:
        near &= a != b
    a, b, low_a, low_b, high_a, high_b = (x[near] for x in (a, b, low_a, low_b, high_a, high_b))
    shared = np.bitwise_count(left.maps[level][a] & right.maps[level][b]).sum(axis=1).astype(np.int64)
    most = shared + np.minimum(left.extra[level][a], right.extra[level][b])
    most = np.minimum(most, np.minimum(high_a, high_b))
    # overlap o is enough if 100 * o >= percent * (|a| + |b| - o)
    keep = most * (100 + percent) >= percent * (low_a + low_b)
    return a[keep], b[keep]


def _children(left, right, level, a, b, same):
    """All pairs of children; of a node with itself, each pair once. Equal places come first."""
    below_a, below_b = len(left.low[level - 1]), len(right.low[level - 1])
    step_a = FAN if len(left.starts[level - 1]) > 1 or below_a > 1 else 1
    step_b = FAN if len(right.starts[level - 1]) > 1 or below_b > 1 else 1
    i, j = np.divmod(np.arange(step_a * step_b), step_b)
    first = np.argsort(np.abs(i - j), kind="stable")
    child_a = (a[:, None] * step_a + i[first]).ravel()
    child_b = (b[:, None] * step_b + j[first]).ravel()
    keep = (child_a < below_a) & (child_b < below_b)
    if same:
        keep &= child_a <= child_b
    return child_a[keep], child_b[keep]
