"""Adaptive context-mixing range coder for token ids, many blocks at a time.

Each block of ``BLOCK`` ids starts from a reset model, has its own words and crc32, and can
be decoded alone with the frame's header. All blocks of a frame are coded in step, one numpy
lane for each block.

Model of a block. Order 1 and order 2 each predict one id: the one that last followed the last
id, or the last two; an entry holds an id and how often in a row it was right, 0 to 3. Each
order learns how often its predictions of each such standing come true. These rates are the
weights of the mixture: order 2 takes its rate of the interval, order 1 its rate of what is
left, and where both predict the same id their shares are one. The remainder goes to order 0,
which spreads it over all ids by the frame's id counts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, AHEAD = 2048, 32
MAGIC = b"SKRC0001"
HEAD = struct.Struct("<8sQIIIII")  # magic, ids, ids in a block, blocks, bytes of counts, of index, of documents
WHOLE, SPREAD = 16, 19  # bits of the mixture's and of the spread's total
# A lane's interval lies in 63 bits and is widened by a word while it is under 2**47.
FULL, LEAST, BELOW = np.uint64((1 << 63) - 1), np.uint64(1 << 47), np.uint64((1 << 47) - 1)
KEPT, WORD = np.uint64(47), np.uint64(16)
ONE_BITS, TWO_BITS, FACTOR = 10, 12, np.uint32(2654435761)
FEWEST, MOST = np.int32(64), np.int32(62000)  # bounds of a rate, of 2**WHOLE
START = np.array([[600, 6000, 14000, 24000], [2000, 20000, 40000, 50000]], np.int32)  # rates of order 1 and 2


class BadBlock(ValueError):
    """A block's words do not give the ids that its checksum stands for."""


def spread(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and their shares of 2**SPREAD, each 1 or more."""
    found, n = np.unique(ids, return_counts=True)
    if len(found) >= 1 << (SPREAD - 1):
        raise ValueError("too many different ids")
    if not len(found):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    total = 1 << SPREAD
    share = 1 + n * (total - len(found)) // max(1, n.sum())
    share[np.argmax(share)] += total - share.sum()
    return found.astype(np.uint32), share.astype(np.int64)


class Model:
    """The adaptive state of all lanes. ``predict`` gives the mixture, ``learn`` takes the ids coded.

    Row 0 of its arrays is order 1, row 1 order 2; both are taken and learned in one pass.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.lane = np.stack([lane << ONE_BITS, (lanes << ONE_BITS) + (lane << TWO_BITS)])
        self.table = np.full((lanes << ONE_BITS) + (lanes << TWO_BITS), -4, np.int32)
        self.rates = np.concatenate([np.tile(START[0], lanes), np.tile(START[1], lanes)])
        self.rate_at = np.stack([lane << 2, (lane + lanes) << 2])

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Table places of the contexts (last id; last two ids) of the first lanes, at one step or at several."""
        h, g = last * FACTOR, before * FACTOR
        g >>= np.uint32(7)
        g += h
        g >>= np.uint32(32 - TWO_BITS)
        h >>= np.uint32(32 - ONE_BITS)
        out = np.empty((*h.shape[:-1], 2, h.shape[-1]), np.int64)
        out[..., 0, :], out[..., 1, :] = h, g
        out += self.lane[:, : h.shape[-1]]
        return out

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids predicted by order 2 and order 1 from their tables' places, and the ends of their shares."""
        self.at = at
        self.entry = self.table.take(at)
        self.sure = self.entry & 3
        self.where = self.rate_at[:, : at.shape[1]] + self.sure
        self.rate = self.rates.take(self.where)
        self.guess = self.entry >> 2
        (r1, r2), (p1, p2) = self.rate, self.guess
        m1 = (1 << WHOLE) - r2
        m1 *= r1 >> 1
        m1 >>= WHOLE - 1
        m1 += 1
        end1 = r2 + m1
        m1 *= p1 == p2  # what order 1 would take goes to the same id of order 2
        m1 += r2
        return p2, p1, np.minimum(m1, end1, out=m1), end1

    def learn(self, ids: np.ndarray) -> None:
        hit = self.guess == ids
        self.entry += self.sure < 3
        self.table[self.at] = np.where(hit, self.entry, ids << 2)
        goal = np.where(hit, MOST, FEWEST)
        goal -= self.rate
        goal >>= 5
        goal += self.rate
        self.rates[self.where] = goal


class Writer:
    """The arithmetic coder of all lanes: ``low`` and ``range`` of 63 bits, words of 16."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, FULL)
        self.width = 4 * steps + 8
        self.words = np.zeros(lanes * self.width, np.uint16)
        self.at = np.arange(lanes, dtype=np.int64) * self.width

    def settle(self) -> None:
        todo = np.flatnonzero(self.range < LEAST)
        while len(todo):
            low, size = self.low[todo], self.range[todo]
            size = np.minimum(size, LEAST - (low & BELOW))
            at = self.at[todo]
            self.words[at] = low >> KEPT
            self.at[todo] = at + 1
            self.low[todo] = (low & BELOW) << WORD
            size <<= WORD
            self.range[todo] = size
            todo = todo[size < LEAST]

    def finish(self) -> list[np.ndarray]:
        for shift in (47, 31, 15):
            self.words[self.at] = (self.low >> np.uint64(shift)) & np.uint64(0xFFFF)
            self.at += 1
        self.words[self.at] = (self.low << np.uint64(1)) & np.uint64(0xFFFF)
        self.at += 1
        begin = np.arange(len(self.at)) * self.width
        return [self.words[a:b] for a, b in zip(begin.tolist(), self.at.tolist())]


def encode_ids(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """The ids that occur and their shares, each block's words and crc32."""
    lanes = -(-len(ids) // block)
    found, share = spread(ids)
    size = int(found[-1]) + 1 if len(found) else 1
    shares, cums = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    shares[found] = share
    cums[found] = np.cumsum(share) - share
    grid = np.zeros(lanes * block, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    tail = len(ids) - (lanes - 1) * block
    model, out = Model(lanes), Writer(lanes, min(block, len(ids)))
    whole, fine = np.uint64(WHOLE), np.uint64(SPREAD)
    past = np.concatenate([np.zeros((2, lanes), np.uint32), grid.view(np.uint32)])
    for t in range(min(block, len(ids))):
        n = lanes if t < tail else lanes - 1
        x = grid[t, :n]
        # The ids are all known, so contexts are looked up for many steps at once.
        if t % AHEAD == 0:
            m = min(AHEAD, block - t)
            at = model.places(past[t + 1 : t + 1 + m], past[t : t + m])
        p2, p1, c2, c1 = model.predict(at[t % AHEAD, :, :n])
        is2, is1 = x == p2, x == p1
        cum = np.where(is1, c2, c1)
        cum[is2] = 0
        part = np.where(is1, c1, 1 << WHOLE)
        np.copyto(part, c2, where=is2)
        part -= cum
        unit = out.range[:n] >> whole
        out.low[:n] += unit * cum.astype(np.uint64)
        unit *= part.astype(np.uint64)
        out.range[:n] = unit
        is2 |= is1
        rest = np.flatnonzero(~is2)
        if len(rest):
            y = x[rest]
            unit = unit[rest] >> fine
            out.low[rest] += unit * cums.take(y)
            unit *= shares.take(y)
            out.range[rest] = unit
        out.settle()
        model.learn(x)
    crcs = [zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)]
    return found, share, out.finish() if lanes else [], crcs


def decode_ids(n_ids: int, block: int, found: np.ndarray, share: np.ndarray, words: np.ndarray, n_words: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """The ids of blocks that lie one after the other; only the last may be short. Raises BadBlock."""
    lanes = len(n_words)
    if not lanes:
        return np.zeros(0, np.uint32)
    cums = (np.cumsum(share) - share).astype(np.uint64)
    of = np.repeat(np.arange(len(found), dtype=np.int32), share)
    found, share = found.astype(np.int32), share.astype(np.uint64)
    words = np.concatenate([words, np.zeros(8, np.uint16)]).astype(np.uint64)
    at = np.cumsum(n_words) - n_words
    end = len(words) - 1
    low = np.zeros(lanes, np.uint64)
    size = np.full(lanes, FULL)
    gap = np.zeros(lanes, np.uint64)  # the code's value less low
    for shift in (47, 31, 15):
        gap |= words[at] << np.uint64(shift)
        at += 1
    # The code has 15 bits more than three words; they lead the fourth.
    gap |= words[np.minimum(at, end)] >> np.uint64(1)
    tail = n_ids - (lanes - 1) * block
    grid = np.zeros((block, lanes), np.int32)
    last = before = np.zeros(lanes, np.uint32)
    model = Model(lanes)
    top, spread_top = np.uint64((1 << WHOLE) - 1), np.uint64((1 << SPREAD) - 1)
    whole, fine, one, low_bit = np.uint64(WHOLE), np.uint64(SPREAD), np.uint64(1), np.uint64(15)
    for t in range(min(block, n_ids)):
        n = lanes if t < tail else lanes - 1
        p2, p1, c2, c1 = model.predict(model.places(last[:n], before[:n]))
        unit = size[:n] >> whole
        v = np.minimum(gap[:n] // unit, top).astype(np.int32)
        is2, in1 = v < c2, v < c1
        cum = np.where(in1, c2, c1)
        cum[is2] = 0
        part = np.where(in1, c1, 1 << WHOLE)
        np.copyto(part, c2, where=is2)
        part -= cum
        x = np.where(is2, p2, p1)
        step = unit * cum.astype(np.uint64)
        low[:n] += step
        gap[:n] -= step
        unit *= part.astype(np.uint64)
        size[:n] = unit
        rest = np.flatnonzero(~in1)
        if len(rest):
            unit = unit[rest] >> fine
            i = of.take(np.minimum(gap[rest] // unit, spread_top).view(np.int64))
            step = unit * cums.take(i)
            low[rest] += step
            gap[rest] -= step
            unit *= share.take(i)
            size[rest] = unit
            x[rest] = found.take(i)
        todo = np.flatnonzero(size < LEAST)
        while len(todo):
            lo = low[todo]
            s = np.minimum(size[todo], LEAST - (lo & BELOW))
            low[todo] = (lo & BELOW) << WORD
            k = at[todo]
            # 16 new bits: the last bit of the word begun before and 15 of the next.
            new = ((words[np.minimum(k, end)] & one) << low_bit) | (words[np.minimum(k + 1, end)] >> one)
            gap[todo] = (gap[todo] << WORD) | new
            at[todo] = k + 1
            s <<= WORD
            size[todo] = s
            todo = todo[s < LEAST]
        grid[t, :n] = x
        before, last = last, grid[t].view(np.uint32)
        model.learn(x)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n_ids].view(np.uint32)
    for k, crc in enumerate(crcs.tolist()):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != crc:
            raise BadBlock(f"block {k}")
    return ids


def pack_frame(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A frame: whole documents (id, whether the id is known, number of ids) and all their ids."""
    found, share, words, crcs = encode_ids(ids, block)
    counts = zlib.compress(np.diff(found, prepend=0).astype("<u4").tobytes() + share.astype("<u4").tobytes(), 1)
    index = zlib.compress(np.array([len(w) for w in words], "<u4").tobytes() + np.array(crcs, "<u4").tobytes(), 1)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + known.astype("u1").tobytes(), 1)
    head = HEAD.pack(MAGIC, len(ids), block, len(words), len(counts), len(index), len(docs))
    check = struct.pack("<I", zlib.crc32(head + counts + index + docs))
    return b"".join([head, check, counts, index, docs, *(w.astype("<u2").tobytes() for w in words)])


def _sections(frame: bytes):
    magic, n_ids, block, lanes, a, b, c = HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise BadBlock("not a frame")
    at = HEAD.size + 4
    head = frame[: HEAD.size] + frame[at : at + a + b + c]
    if zlib.crc32(head) != struct.unpack_from("<I", frame, HEAD.size)[0]:
        raise BadBlock("frame header")
    counts = np.frombuffer(zlib.decompress(frame[at : at + a]), "<u4")
    index = np.frombuffer(zlib.decompress(frame[at + a : at + a + b]), "<u4")
    docs = zlib.decompress(frame[at + a + b : at + a + b + c])
    half = len(counts) // 2
    found, share = np.cumsum(counts[:half], dtype=np.int64), counts[half:].astype(np.int64)
    n = len(docs) // 17
    table = np.frombuffer(docs, "<i8", 2 * n)
    return n_ids, block, found, share, index[:lanes].astype(np.int64), index[lanes:], table[:n], np.frombuffer(docs, "u1", n, 16 * n).astype(bool), table[n:], at + a + b + c


def unpack_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, whether known, lengths, all ids. Raises BadBlock if anything was altered."""
    n_ids, block, found, share, n_words, crcs, docs, known, lengths, at = _sections(frame)
    words = np.frombuffer(frame, "<u2", int(n_words.sum()), at)
    return docs, known, lengths, decode_ids(n_ids, block, found, share, words, n_words, crcs)


def unpack_block(frame: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` alone, read without the other blocks."""
    n_ids, block, found, share, n_words, crcs, _, _, _, at = _sections(frame)
    words = np.frombuffer(frame, "<u2", int(n_words[k]), at + 2 * int(n_words[:k].sum()))
    return decode_ids(min(block, n_ids - k * block), block, found, share, words, n_words[k : k + 1], crcs[k : k + 1])
