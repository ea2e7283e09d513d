"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A frame holds the ids of whole documents, cut into blocks of equally many ids. A block's model starts
anew and adapts to its own ids:

- order 2 and order 1 predict the id that followed the same two ids, or the same id, last time, with
  a confidence of 0 to 3;
- order 0 counts, adaptively, in which of CLASSES ranges of ids the ids fall, and inside a range has the
  frame's shares, which are written once in the frame's head;
- the mixture is w2 * [order 2's id] + w1 * [order 1's id] + w0 * order 0, with weights learnt for each
  state of both confidences and of their agreement.

The mixture drives a range coder with a 64-bit interval that sends 32-bit words. All blocks of a frame are coded
in step, one id of every block at a time, with numpy; each block can be decoded alone.

Frame: magic, block size, number of ids, documents and blocks, length and crc of the packed head (document ids,
lengths, order-0 shares), words and crc of each block, then the blocks' words. Integers are
little-endian.
"""

import struct
import zlib

import numpy as np

from latchflow.llm.common import U64

MAGIC = b"LFCM"
BLOCK = 2048
CLASSES = 16
#: Contexts remembered for each order, in slots that later contexts take over.
SLOTS = 1024
#: Ids inside a class share this many parts; a vocabulary must have no more ids than that.
PARTS = 1 << 16
_HEAD = "<4sIQIIII"
_TOP = U64(1 << 32)
_W, _HALF, _ONE, _LAST = U64(32), U64(16), U64(1), U64(PARTS - 1)


class Model:
    """The adaptive state of `lanes` blocks; ids go by their places among the frame's different ids.

    A slot holds four times the place predicted, plus the confidence, so that each step reaches for it once.
    """

    def __init__(self, lanes: int):
        self.row = np.arange(lanes, dtype=np.int64)
        self.slot, self.cell = self.row * SLOTS, self.row * 32
        self.at = [self.slot, self.slot]
        self.last = [np.full(lanes * SLOTS, -4, dtype=np.int32) for _ in range(2)]
        self.weights = [np.full(lanes * 32, 1 << 14, dtype=np.int32) for _ in range(2)]
        self.counts = np.full((CLASSES, lanes), 16, dtype=np.int32)
        self.flat = self.counts.reshape(-1)
        self.totals = np.empty_like(self.counts)
        self.steps = 0
        self.before = np.zeros(lanes, dtype=np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Widths of the parts of orders 2 and 1, of 65,536; the places they predict are p2 and p1 (none: -1)."""
        self.held = self.last[0].take(self.at[0]), self.last[1].take(self.at[1])
        self.p2, self.p1 = (held >> 2 for held in self.held)
        self.sure = tuple(held & 3 for held in self.held)
        self.state = self.cell + ((self.sure[0] * 8 + self.sure[1] * 2) + (self.p2 == self.p1))
        self.w2, self.v1 = self.weights[0].take(self.state), self.weights[1].take(self.state)
        self.w1 = ((65536 - self.w2) * self.v1.astype(np.int64)) >> 16
        return self.w2, self.w1

    def running(self) -> np.ndarray:
        """Running sums of the class counts of each block."""
        out, counts = self.totals, self.counts
        out[0] = counts[0]
        for k in range(1, CLASSES):
            np.add(out[k - 1], counts[k], out=out[k])
        return out

    def learn(self, x: np.ndarray, wide: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Take in the place of the next id of each block (x, and in 64 bits), and which order coded it (neither: order 0)."""
        self.weights[0][self.state] = self.w2 + ((hit2 * 63488 + 1024 - self.w2) >> 4)
        self.weights[1][self.state] = self.v1 + (((hit1 * 63488 + 1024 - self.v1) >> 4) & (hit2 - 1))
        fresh = x << 2
        for last, at, held, sure in zip(self.last, self.at, self.held, self.sure, strict=True):
            hit = (held ^ fresh) < 4  # the same place, whatever the confidence
            hit &= held >= 0
            # one surer, at most 3; else half as sure, or from 0 and 1 the new place
            last[at] = np.where(hit, held + (sure < 3), np.where(sure < 2, fresh, held - sure + 1))
        self.at = [
            self.slot + ((((self.before * 50021 + wide) * 2654435761) >> 12) & (SLOTS - 1)),
            self.slot + (((wide * 2654435761) >> 12) & (SLOTS - 1)),
        ]
        self.before = wide

    def count(self, where: np.ndarray, plain: np.ndarray) -> None:
        """Add to the classes (places in `flat`) of the blocks whose id order 0 coded."""
        self.flat[where] += plain.astype(np.int32) * 24
        self.steps += 1
        if not self.steps % 32:
            full = self.counts.sum(axis=0) > 2500
            self.counts[:, full] = (self.counts[:, full] >> 1) | 1


class Shares:
    """Order 0 of a frame: classes of about equal mass, and each id's part of its class."""

    def __init__(self, names: np.ndarray, parts: np.ndarray, kinds: np.ndarray):
        self.names, self.parts, self.kinds = names, parts, kinds
        first = np.searchsorted(kinds, np.arange(CLASSES + 1))
        total = np.concatenate([[0], np.cumsum(parts)])
        self.start = total[:-1] - total[first[kinds]]
        self.first = first

    @classmethod
    def of(cls, ids: np.ndarray) -> "Shares":
        names, counts = np.unique(ids, return_counts=True)
        if len(names) > PARTS:
            raise ValueError(f"a frame may hold {PARTS} different ids, not {len(names)}")
        mass = np.cumsum(counts) - counts
        kinds = mass * CLASSES // max(1, int(counts.sum()))
        parts = np.ones(len(names), dtype=np.int64)
        for k in range(CLASSES):
            own = kinds == k
            if own.any():
                c = counts[own]
                spare = PARTS - len(c)
                p = 1 + c * spare // c.sum()
                p[np.argmax(c)] += PARTS - p.sum()
                parts[own] = p
        return cls(names, parts, kinds)

    def places(self) -> np.ndarray:
        """Index of the id at each part of each class."""
        out = np.zeros((CLASSES, PARTS), dtype=np.int32)
        for k in range(CLASSES):
            lo, hi = self.first[k], self.first[k + 1]
            if hi > lo:
                out[k] = np.repeat(np.arange(lo, hi), self.parts[lo:hi])
        return out


class Encoder:
    """Range coder of `lanes` blocks: interval `low`, `width`; words so far. Carries are added to the last
    word sent and spread when a block ends."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.words = np.zeros((lanes, steps * 2 + 4), dtype=np.uint64)
        self.sent = np.zeros(lanes, dtype=np.int64)

    def narrow(self, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        low = self.low + unit * start
        carry = np.flatnonzero(low < self.low)
        if len(carry):
            self.words[carry, self.sent[carry] - 1] += _ONE
        self.low, self.width = low, unit * size

    def send(self) -> None:
        small = np.flatnonzero(self.width < _TOP)
        if len(small):
            low = self.low[small]
            self.words[small, self.sent[small]] = low >> _W
            self.sent[small] += 1
            self.low[small] = low << _W
            self.width[small] <<= _W

    def finish(self) -> list[np.ndarray]:
        for _ in range(2):
            self.words[np.arange(len(self.low)), self.sent] = self.low >> _W
            self.sent += 1
            self.low <<= _W
        sent = np.ascontiguousarray(self.words[:, : int(self.sent.max())].T)
        for at in range(len(sent) - 1, 0, -1):
            sent[at - 1] += sent[at] >> _W
        words = sent.T.astype(np.uint32)
        return [words[i, :n] for i, n in enumerate(self.sent)]


def encode_blocks(ids: np.ndarray, shares: Shares, block: int) -> list[np.ndarray]:
    """The words of each block of `block` ids; the last one is filled up with its first known id."""
    lanes = -(-len(ids) // block)
    place = np.zeros(lanes * block, dtype=np.int32)
    index = np.zeros(int(shares.names[-1]) + 1, dtype=np.int32)
    index[shares.names] = np.arange(len(shares.names))
    place[: len(ids)] = index[ids]
    place = np.ascontiguousarray(place.reshape(lanes, block).T)
    model, coder = Model(lanes), Encoder(lanes, block)
    starts, parts, kind_of = shares.start.astype(np.uint64), shares.parts.astype(np.uint64), shares.kinds * lanes
    for x in place:
        now = x.astype(np.int64)
        w2, w1 = model.predict()
        hit2 = model.p2 == x
        hit1 = (model.p1 == x) & ~hit2
        plain = ~(hit2 | hit1)
        both = w2 + w1
        start = np.where(plain, both, w2 * hit1)
        size = np.where(hit2, w2, np.where(hit1, w1, 65536 - both))
        coder.narrow(coder.width >> _HALF, start.astype(np.uint64), size.astype(np.uint64))
        cell = kind_of.take(now) + model.row
        total = model.running()
        size = model.flat.take(cell) * plain
        start = (total.reshape(-1).take(cell) - size) * plain
        whole = np.where(plain, total[-1], 1)
        coder.narrow(coder.width // whole.astype(np.uint64), start.astype(np.uint64), (size + ~plain).astype(np.uint64))
        coder.send()
        unit = np.where(plain, coder.width >> _HALF, coder.width)
        coder.narrow(unit, starts.take(now) * plain, np.where(plain, parts.take(now), _ONE))
        coder.send()
        model.count(cell, plain)
        model.learn(x, now, hit2, hit1)
    return coder.finish()


def decode_blocks(blocks: list[np.ndarray], shares: Shares, block: int) -> np.ndarray:
    """The ids of each block, one row per block."""
    lanes = len(blocks)
    words = np.zeros((lanes, max(map(len, blocks)) + 2), dtype=np.uint64)
    for i, w in enumerate(blocks):
        words[i, : len(w)] = w
    row, at = np.arange(lanes), np.full(lanes, 2)
    code = (words[:, 0] << _W) | words[:, 1]
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    model, places = Model(lanes), shares.places()
    out = np.zeros((block, lanes), dtype=np.int32)

    def fetch():
        small = np.flatnonzero(width < _TOP)
        if len(small):
            code[small] = (code[small] << _W) | words[small, at[small]]
            width[small] <<= _W
            at[small] += 1

    starts, parts = shares.start.astype(np.uint64), shares.parts.astype(np.uint64)
    places = places.reshape(-1)
    for step in range(block):
        w2, w1 = model.predict()
        unit = width >> _HALF
        value = (code // unit).astype(np.int64)
        both = w2 + w1
        hit2, plain = value < w2, value >= both
        hit1 = ~(hit2 | plain)
        start = np.where(plain, both, w2 * hit1)
        size = np.where(hit2, w2, np.where(hit1, w1, 65536 - both))
        code -= unit * start.astype(np.uint64)
        width = unit * size.astype(np.uint64)
        total = model.running()
        unit = width // np.where(plain, total[-1], 1).astype(np.uint64)
        value = (code // unit).astype(np.int32)
        kinds = np.minimum((total <= value).sum(axis=0, dtype=np.int8), CLASSES - 1).astype(np.int64)
        cell = kinds * lanes + row
        size = model.flat.take(cell) * plain
        start = (total.reshape(-1).take(cell) - size) * plain
        code -= unit * start.astype(np.uint64)
        width = unit * (size + ~plain).astype(np.uint64)
        fetch()
        unit = np.where(plain, width >> _HALF, width)
        value = np.minimum(code // unit, _LAST).astype(np.int64)
        found = places.take(kinds * PARTS + value)
        code -= unit * (starts.take(found) * plain)
        width = unit * np.where(plain, parts.take(found), _ONE)
        fetch()
        now = np.where(plain, found, np.where(hit2, model.p2, model.p1)).astype(np.int64)
        out[step] = now
        model.count(cell, plain)
        model.learn(out[step], now, hit2, hit1)
    return shares.names.astype(np.uint32).take(out.T)


def write_frame(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One frame of whole documents; a null doc_id is None."""
    shares = Shares.of(ids)
    words = encode_blocks(ids, shares, block) if len(ids) else []
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    parts = (known, names, lengths.astype("<u4"), shares.names.astype("<u4"), shares.parts.astype("<u4"), shares.kinds.astype("u1"))
    sizes = struct.pack("<I", len(shares.names))
    head = zlib.compress(sizes + b"".join(p.tobytes() for p in parts), 1)
    crcs = [zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(len(words))]
    index = np.array([[len(w), c] for w, c in zip(words, crcs, strict=True)], dtype="<u4").reshape(-1, 2)
    fixed = struct.pack(_HEAD, MAGIC, block, len(ids), len(doc_ids), len(words), len(head), zlib.crc32(head))
    return b"".join([fixed, head, index.tobytes(), *(w.astype("<u4").tobytes() for w in words)])


def _open(frame: bytes):
    magic, block, n_ids, n_docs, n_blocks, size, crc = struct.unpack_from(_HEAD, frame)
    head = frame[struct.calcsize(_HEAD) : struct.calcsize(_HEAD) + size]
    if magic != MAGIC or zlib.crc32(head) != crc:
        raise ValueError("not a frame, or its head is damaged")
    data = zlib.decompress(head)
    (n,) = struct.unpack_from("<I", data)
    at, parts = 4, []
    for kind, count in (("u1", n_docs), ("<i8", n_docs), ("<u4", n_docs), ("<u4", n), ("<u4", n), ("u1", n)):
        parts.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
        at += parts[-1].nbytes
    known, names, lengths, ids, shares, kinds = parts
    at = struct.calcsize(_HEAD) + size
    index = np.frombuffer(frame, dtype="<u4", count=2 * n_blocks, offset=at).reshape(-1, 2)
    starts = at + index.nbytes + 4 * np.concatenate([[0], np.cumsum(index[:, 0], dtype=np.int64)])
    blocks = [np.frombuffer(frame, dtype="<u4", count=int(index[i, 0]), offset=int(starts[i])) for i in range(n_blocks)]
    doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]
    model = Shares(ids.astype(np.int64), shares.astype(np.int64), kinds.astype(np.int64))
    return block, n_ids, doc_ids, lengths, model, blocks, index[:, 1]


def read_block(frame: bytes, number: int) -> np.ndarray:
    """The ids of one block, checked, without the others."""
    block, n_ids, _, _, shares, blocks, crcs = _open(frame)
    ids = decode_blocks([blocks[number]], shares, block)[0][: n_ids - number * block]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crcs[number]:
        raise ValueError(f"block {number} is damaged")
    return ids


def read_frame(frame: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids, with every block's checksum compared."""
    block, n_ids, doc_ids, lengths, shares, blocks, crcs = _open(frame)
    if not blocks:
        return doc_ids, lengths, np.zeros(0, dtype=np.uint32)
    rows = decode_blocks(blocks, shares, block)
    ids = rows.ravel()[:n_ids]
    for i, crc in enumerate(crcs):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return doc_ids, lengths, ids
