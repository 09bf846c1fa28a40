"""Exact byte-level BPE ids for batches of whole texts.

The tokenizers library spends most of its time cutting a text into pieces and on pieces it
has met before. Here the cut is one vector pass over all code points of a batch, and the
library's model encodes each distinct piece once for each Python worker.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

PIECE = 64
LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPLIT = re.compile(r"(?<=\S) ")


def char_classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kind[c] = LETTER if k == "L" else NUMBER
    kind[WHITE] = SPACE
    return kind


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Tokens:
    """``encode(texts)`` gives all ids in one array and each text's place in it.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)`` with
    ``encode_special_tokens`` on, so strings of special tokens are ordinary text. A hash only
    says where a piece may be remembered: its code points are compared before its ids are taken.
    At most ``max_pieces`` distinct pieces of up to ``PIECE`` code points are remembered; then
    the memory starts afresh.
    """

    def __init__(self, path: str, max_pieces: int = 1 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        # The library's model on pieces that are cut already: byte 255, which is in no UTF-8 text, parts them.
        self.pieces = Tokenizer(Tokenizer.from_file(path).model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(byte_alphabet()[255])
        vocabulary = self.pieces.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        self.kind = char_classes()
        self.alphabet = np.array([ord(c) for _, c in sorted(byte_alphabet().items())], np.uint32)
        self.max_pieces, self.bits = max_pieces, max_pieces.bit_length()
        rng = np.random.default_rng(7)
        self.base = np.uint64(int(rng.integers(1 << 62)) | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.n, self.n_ids, self.n_chars = 0, 0, 0
        self.start, self.count, self.spelt = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids, self.chars = np.zeros(1 << 14, np.uint32), np.zeros(1 << 15, np.uint32)

    def cuts(self, c: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Starts of pieces in code points ``c``; positions ``edges`` separate texts."""
        k = self.kind.take(c)
        k[edges] = EDGE
        start = np.ones(len(c), bool)
        start[1:] = k[1:] != k[:-1]
        white = k == SPACE
        blank = white & (c == 32)
        solid = k < EDGE
        solid &= ~white
        start[1:] &= ~(blank[:-1] & solid[1:])  # a blank before a word belongs to it
        start[:-1] |= white[:-1] & solid[1:]  # of several white characters the last stands alone
        start[edges] = True
        after = edges[edges + 1 < len(c)] + 1
        start[after] = True
        quotes = np.flatnonzero((c == 39) & start)
        quotes = quotes[quotes + 1 < len(c)]
        if len(quotes):
            one = c[quotes + 1]
            two = c[np.minimum(quotes + 2, len(c) - 1)]
            in_text = (quotes + 2 < len(c)) & (k[np.minimum(quotes + 2, len(c) - 1)] != EDGE)
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = in_text & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            edge_next = k[quotes + 1] == EDGE
            for at, width in ((quotes[short & ~edge_next], 2), (quotes[long & ~edge_next], 3)):
                start[at + 1] = False
                start[at[at + width < len(c)] + width] = True
        return np.flatnonzero(start)

    def hashes(self, c: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(c)
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            self.powers = np.full(size, self.base, np.uint64)
            self.inverses = np.full(size, self.inverse, np.uint64)
            self.powers[0] = self.inverses[0] = 1
            np.cumprod(self.powers, out=self.powers)
            np.cumprod(self.inverses, out=self.inverses)
        v = c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(31)
        v *= self.powers[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        h = (total[end] - total[cut]) * self.inverses[cut]
        h ^= (end - cut).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h[h == 0] = 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            s = (slot[todo] + 1) & mask
            slot[todo] = s
            key[todo] = k = self.keys[s]
            out[todo] = self.values[s]
            todo = todo[(k != h[todo]) & (k != 0)]
        out[key != h] = -1
        return out

    def keep(self, texts: list[str], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Encodes pieces by the library's model; the places of their ids and of their ``codes``, as many as ``lengths`` says."""
        raw = np.frombuffer("\udcff".join(texts).encode("utf-8", "surrogateescape"), np.uint8)
        found = np.array(self.pieces.encode_batch_fast([self.alphabet.take(raw).tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.int64)
        # Tokens are whole bytes of their piece, so their lengths tell where the pieces end.
        parts = np.append(np.flatnonzero(raw == 255), len(raw))
        count = np.diff(np.searchsorted(np.cumsum(self.bytes_of[found]), parts - np.arange(len(parts))) + 1, prepend=0)
        n, n_ids, n_chars = self.n + len(texts), self.n_ids + len(found), self.n_chars + len(codes)
        while n > len(self.start):
            self.start, self.count, self.spelt = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.spelt))
        while n_ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n_chars > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.start[self.n : n], self.count[self.n : n] = self.n_ids + np.cumsum(count) - count, count
        self.spelt[self.n : n] = self.n_chars + np.cumsum(lengths) - lengths
        self.ids[self.n_ids : n_ids], self.chars[self.n_chars : n_chars] = found, codes
        first, self.n, self.n_ids, self.n_chars = self.n, n, n_ids, n_chars
        return np.arange(first, n)

    def learn(self, h: np.ndarray, places: np.ndarray) -> None:
        """Enters different hashes that are not in the table."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.values[slot[won]] = places[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & mask

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts) + "\n"
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edges = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))) - 1
        cut = self.cuts(c, edges)
        end = np.append(cut[1:], len(c))
        h = self.hashes(c, cut, end)
        # An edge is a piece without ids: only a text's own pieces are looked up.
        is_edge = np.zeros(len(c), bool)
        is_edge[edges] = True
        is_edge = is_edge[cut]
        rare = is_edge | (end - cut > PIECE)
        piece = self.find(h)
        unknown = np.flatnonzero((piece < 0) & ~rare)
        if len(unknown):
            _, first = np.unique(h[unknown], return_index=True)
            if self.n + len(first) > self.max_pieces:
                self.clear()
                unknown = np.flatnonzero(~rare)
                _, first = np.unique(h[unknown], return_index=True)
                while len(first) > self.max_pieces:
                    self.max_pieces, self.bits = self.max_pieces * 2, self.bits + 1
                    self.clear()
            new = np.sort(unknown[first])
            length = end[new] - cut[new]
            codes = c[np.repeat(cut[new] - np.cumsum(length) + length, length) + np.arange(length.sum())]
            self.learn(h[new], self.keep([joined[a:b] for a, b in zip(cut[new].tolist(), end[new].tolist())], codes, length))
            piece[unknown] = self.find(h[unknown])
        mark = self.n, self.n_ids, self.n_chars
        # Pieces that only share a hash with a remembered one, and long ones, are encoded for this batch alone.
        if self.n_chars:
            at = np.repeat((self.spelt[piece] - cut).astype(np.int32), end - cut)
            at += np.arange(len(c), dtype=np.int32)
            other = self.chars.take(at, mode="clip") != c
            rare = rare | np.logical_or.reduceat(other, cut)
        rare = np.flatnonzero(rare & ~is_edge)
        if len(rare):
            found = [joined[a:b] for a, b in zip(cut[rare].tolist(), end[rare].tolist())]
            different = {text: k for k, text in enumerate(dict.fromkeys(found))}
            places = self.keep(list(different), c[:0], np.zeros(len(different), np.int64))
            piece[rare] = places[[different[x] for x in found]]
        piece[is_edge] = 0
        n = np.where(is_edge, 0, self.count[piece] if self.n else 0)
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        at = np.repeat((self.start[piece] if self.n else 0) - total[:-1], n) + np.arange(total[-1])
        ends = total[np.flatnonzero(is_edge)]
        out = self.ids[at]
        self.n, self.n_ids, self.n_chars = mark
        return out, np.append(0, ends)

    def encode(self, texts: list[str], chars: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > 2 * chars and (m := _SPLIT.search(text, at + chars)):
                parts.append(text[at : m.start()])
                owner.append(i)
                at = m.start()
            parts.append(text[at:] if at else text)
            owner.append(i)
        ids, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0
        for j in range(len(parts) + 1):
            if group and (j == len(parts) or size + len(parts[j]) > chars):
                got, ends = self.batch([parts[g] for g in group])
                ids.append(got)
                np.add.at(counts, [owner[g] for g in group], np.diff(ends))
                group, size = [], 0
            if j < len(parts):
                group.append(j)
                size += len(parts[j])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.append(0, np.cumsum(counts))


_made: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The worker's own encoder for a vocabulary file."""
    if path not in _made:
        _made[path] = Tokens(path)
    return _made[path]
