"""Bit-plane coding of one code-block (T.800 Annex D): three passes a plane, stripes of four rows.

One set of passes serves both directions, see ``mq``. A decoded coefficient comes as twice its value
with the middle of what is still unknown: 2 m + 2^p, where p is the last plane that was seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from . import mq

#: Bits of the code-block style.
BYPASS, RESET, TERMINATE, CAUSAL, PREDICTABLE, SEGMENT = 1, 2, 4, 8, 16, 32
LL, HL, LH, HH = range(4)
SIGNIFICANCE, REFINEMENT, CLEANUP = range(3)


@lru_cache(None)
def zero_contexts(band: int) -> tuple[int, ...]:
    """Context of a coefficient that isn't significant yet, at 15 h + 5 v + d significant neighbours."""

    def one(h: int, v: int, d: int) -> int:
        if band == HH:
            hv = h + v
            return (min(hv, 2), min(3 + hv, 5), min(6 + hv, 7), 8, 8)[d]
        a, b = (v, h) if band == HL else (h, v)
        if a == 2:
            return 8
        if a == 1:
            return 7 if b else 6 if d else 5
        return b + 2 if b else min(d, 2)

    return tuple(one(h, v, d) for h in range(3) for v in range(3) for d in range(5))


def sign_context(h: int, v: int) -> tuple[int, int]:
    """Context and flip bit from the sums of the neighbours' signs."""
    h, v = max(-1, min(1, h)), max(-1, min(1, v))
    flip = int(h < 0 or h == 0 and v < 0)
    if flip:
        h, v = -h, -v
    return (12 if h else 9) + v, flip


def passes_of(planes: int) -> int:
    return max(3 * planes - 2, 0)


def pass_kind(index: int) -> int:
    return (index + 2) % 3


def pass_plane(index: int, planes: int) -> int:
    return planes - 1 - (index + 2) // 3


def is_raw(index: int, style: int) -> bool:
    """The first four planes are always coded."""
    return bool(style & BYPASS) and index >= 10 and pass_kind(index) != CLEANUP


def ends_segment(index: int, style: int) -> bool:
    """Whether a codeword ends with this pass, whatever follows."""
    if style & TERMINATE:
        return True
    return bool(style & BYPASS) and index >= 9 and pass_kind(index) != SIGNIFICANCE


def segments(first: int, count: int, style: int) -> list[int]:
    """How the passes first .. first + count - 1 fall into codewords."""
    out, run = [], 0
    for index in range(first, first + count):
        run += 1
        if ends_segment(index, style):
            out.append(run)
            run = 0
    return out + [run] * (run > 0)


class Block:
    """The state of a block between passes. All arrays have a border of one."""

    def __init__(self, width: int, height: int, band: int, style: int = 0):
        self.width, self.height, self.style, self.wide = width, height, style, width + 2
        cells = self.wide * (height + 2)
        self.sig, self.neg, self.seen, self.old = (bytearray(cells) for _ in range(4))
        self.mag, self.last = [0] * cells, [0] * cells
        self.zero = zero_contexts(band)
        self.gain = 0.0  # squared error that the passes have taken away, where magnitudes are known

    def load(self, values: list[int]) -> int:
        """Sets all coefficients, row by row; the number of planes."""
        for y in range(self.height):
            for x in range(self.width):
                v, p = values[y * self.width + x], (y + 1) * self.wide + x + 1
                self.mag[p], self.neg[p] = abs(v), int(v < 0)
        return max(self.mag).bit_length()

    def doubled(self) -> list[int]:
        out = []
        for y in range(self.height):
            for p in range((y + 1) * self.wide + 1, (y + 1) * self.wide + 1 + self.width):
                v = 2 * self.mag[p] + (1 << self.last[p]) if self.sig[p] else 0
                out.append(-v if self.neg[p] else v)
        return out

    def _context(self, p: int, causal: bool) -> int:
        s, w = self.sig, self.wide
        below, diagonal = (0, 0) if causal else (s[p + w], s[p + w - 1] + s[p + w + 1])
        return self.zero[15 * (s[p - 1] + s[p + 1]) + 5 * (s[p - w] + below) + s[p - w - 1] + s[p - w + 1] + diagonal]

    def _columns(self):
        """Places of each stripe's columns, top to bottom."""
        for y in range(0, self.height, 4):
            tall = min(4, self.height - y)
            for x in range(self.width):
                p = (y + 1) * self.wide + x + 1
                yield range(p, p + tall * self.wide, self.wide)

    def _become(self, p: int, plane: int, code, causal: bool, raw: bool) -> None:
        if raw:
            self.neg[p] = code(self.neg[p], 0)
        else:
            s, n, w = self.sig, self.neg, self.wide
            side = lambda q: s[q] * (1 - 2 * n[q])
            context, flip = sign_context(side(p - 1) + side(p + 1), side(p - w) + (0 if causal else side(p + w)))
            n[p] = code(n[p] ^ flip, context) ^ flip
        self.sig[p], self.last[p] = 1, plane
        m = self.mag[p]
        self.gain += m * m - (m - 1.5 * (1 << plane)) ** 2
        self.mag[p] = m | 1 << plane

    def run(self, kind: int, plane: int, code, raw: bool = False) -> None:
        (self._significance, self._refinement, self._cleanup)[kind](plane, code, raw)

    def _significance(self, plane: int, code, raw: bool) -> None:
        causal = bool(self.style & CAUSAL)
        for column in self._columns():
            for i, p in enumerate(column):
                below = causal and i == 3
                if self.sig[p] or not (context := self._context(p, below)):
                    continue
                self.seen[p] = 1
                if code(self.mag[p] >> plane & 1, context):
                    self._become(p, plane, code, below, raw)

    def _refinement(self, plane: int, code, raw: bool) -> None:
        causal = bool(self.style & CAUSAL)
        for column in self._columns():
            for i, p in enumerate(column):
                if not self.sig[p] or self.seen[p]:
                    continue
                context = 16 if self.old[p] else 15 if self._context(p, causal and i == 3) else 14
                bit = code(self.mag[p] >> plane & 1, context)
                m, known = self.mag[p], self.mag[p] >> plane + 1 << plane + 1
                self.gain += (m - known - (1 << plane)) ** 2 - (m - known - (bit + 0.5) * (1 << plane)) ** 2
                self.mag[p] = m | bit << plane
                self.old[p], self.last[p] = 1, plane

    def _cleanup(self, plane: int, code, raw: bool) -> None:
        causal = bool(self.style & CAUSAL)
        for column in self._columns():
            begin = 0
            if len(column) == 4 and not any(self.sig[p] or self.seen[p] or self._context(p, causal and i == 3) for i, p in enumerate(column)):
                bits = [self.mag[p] >> plane & 1 for p in column]
                if not code(int(any(bits)), mq.RUN):
                    continue
                at = bits.index(1) if any(bits) else 0
                at = code(at >> 1, mq.UNIFORM) << 1 | code(at & 1, mq.UNIFORM)
                self._become(column[at], plane, code, causal and at == 3, False)
                begin = at + 1
            for i in range(begin, len(column)):
                p, below = column[i], causal and i == 3
                if not self.sig[p] and not self.seen[p] and code(self.mag[p] >> plane & 1, self._context(p, below)):
                    self._become(p, plane, code, below, False)
        self.seen = bytearray(len(self.seen))
        if self.style & SEGMENT:
            for bit in (1, 0, 1, 0):
                code(bit, mq.UNIFORM)


@dataclass
class Coded:
    """A coded block: planes; the bytes that each pass ends at and the squared error gone by then; data."""

    planes: int
    ends: list[int]
    gains: list[float]
    data: bytes


def encode(values: list[int], width: int, height: int, band: int, style: int = 0) -> Coded:
    block = Block(width, height, band, style)
    planes = block.load(values)
    total = passes_of(planes)
    coder, data, ends, gains, pending = None, b"", [], [], []
    state = mq.contexts()
    for index in range(total):
        raw = is_raw(index, style)
        if coder is None:
            coder = mq.RawEncoder() if raw else mq.Encoder(state)
        block.run(pass_kind(index), pass_plane(index, planes), coder.code, raw)
        gains.append(block.gain)
        if ends_segment(index, style) or index == total - 1:
            word = coder.finish()
            ends += [min(len(data) + e, len(data) + len(word)) for e in pending] + [len(data) + len(word)]
            data, coder, pending = data + word, None, []
        else:
            pending.append(len(coder.out) + 1 if raw else coder.enough())
        if style & RESET:
            state[:] = mq.contexts()
    return Coded(planes, ends, gains, data)


def decode(words: list[tuple[int, bytes]], planes: int, width: int, height: int, band: int, style: int = 0) -> list[int]:
    """Doubled coefficients from codewords (passes, bytes)."""
    block, index, state = Block(width, height, band, style), 0, mq.contexts()
    for count, word in words:
        coder = mq.RawDecoder(word) if is_raw(index, style) else mq.Decoder(word, state)
        for _ in range(count):
            plane = pass_plane(index, planes)
            if plane < 0:
                break
            block.run(pass_kind(index), plane, coder.code, is_raw(index, style))
            if style & RESET:
                state[:] = mq.contexts()
            index += 1
    return block.doubled()
