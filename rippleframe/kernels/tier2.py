"""Packets (T.800 Annex B): what each layer adds to the blocks of a precinct."""

from __future__ import annotations

import struct

from . import tier1
from .bitio import BitReader, BitWriter
from .markers import EPH, SOP
from .structure import BlockPlace, Precinct

#: A block's limits; beyond them the stream is broken.
MOST_PASSES, MOST_BITS = 164, 32


class BadPacket(ValueError):
    pass


def write_passes(w: BitWriter, n: int) -> None:
    for base, top, lead in ((1, 1, "0"), (2, 2, "10"), (3, 5, "11"), (6, 36, "1111"), (37, MOST_PASSES, "111111111")):
        if n <= top:
            for b in lead:
                w.bit(int(b))
            w.bits(n - base, (top - base).bit_length())
            return
    raise BadPacket("too many passes")


def read_passes(r: BitReader) -> int:
    if not r.bit():
        return 1
    if not r.bit():
        return 2
    if (n := r.bits(2)) < 3:
        return 3 + n
    if (n := r.bits(5)) < 31:
        return 6 + n
    return 37 + r.bits(7)


def _cells(precinct: Precinct):
    for cells in precinct.cells:
        for k, block in enumerate(cells.blocks):
            yield cells, k % cells.across, k // cells.across, block


def prepare(precinct: Precinct, planes_of: dict[int, int], layers: int) -> None:
    """Fills the tag trees from the coded blocks; planes_of: the planes that each band's steps allow."""
    for cells in precinct.cells:
        if cells.blocks:
            cells.inclusion.fill([next((n for n, p in enumerate(b.upto) if p), layers) for b in cells.blocks])
            cells.planes.fill([planes_of[cells.band] - b.coded.planes for b in cells.blocks])


def encode(precinct: Precinct, layer: int, style: int, number: int, sop: bool, eph: bool) -> bytes:
    w, body = BitWriter(), b""
    w.bit(1)
    for cells, x, y, block in _cells(precinct):
        before, after = block.passes, block.upto[layer]
        if block.included:
            w.bit(int(after > before))
        else:
            cells.inclusion.code(x, y, layer + 1, w.bit)
        if after == before:
            continue
        if not block.included:
            cells.planes.exact(x, y, w.bit)
            block.included = True
        write_passes(w, after - before)
        pieces, at = [], before
        for n in tier1.segments(before, after - before, style):
            begin = block.coded.ends[at - 1] if at else 0
            pieces.append((n, block.coded.data[begin : block.coded.ends[at + n - 1]]))
            at += n
        more = max(0, max(len(p).bit_length() - block.length_bits - n.bit_length() + 1 for n, p in pieces))
        for _ in range(more):
            w.bit(1)
        w.bit(0)
        block.length_bits += more
        for n, p in pieces:
            w.bits(len(p), block.length_bits + n.bit_length() - 1)
            body += p
        block.passes = after
    head = struct.pack(">HHH", SOP, 4, number & 0xFFFF) if sop else b""
    return head + w.flush() + (struct.pack(">H", EPH) if eph else b"") + body


def decode(data: bytes, at: int, precinct: Precinct, layer: int, style: int, packed: bytes | None = None, packed_at: int = 0) -> tuple[int, int]:
    """Reads one packet; the places after it in the data and in the packed headers. Markers are found where they stand."""
    if data[at : at + 2] == b"\xff\x91":
        at += 6
    heads, head_at = (data, at) if packed is None else (packed, packed_at)
    r = BitReader(heads, head_at)
    found: list[tuple[BlockPlace, int, int]] = []
    if r.bit():
        for cells, x, y, block in _cells(precinct):
            read = lambda _: r.bit()
            if not (r.bit() if block.included else cells.inclusion.code(x, y, layer + 1, read)):
                continue
            if not block.included:
                block.missing, block.included = cells.planes.exact(x, y, read), True
            n = read_passes(r)
            while r.bit():
                block.length_bits += 1
                if block.length_bits > MOST_BITS:
                    raise BadPacket("a length of too many bits")
            for k in tier1.segments(block.passes, n, style):
                found.append((block, k, r.bits(block.length_bits + k.bit_length() - 1)))
                block.passes += k
    head_at = r.align()
    if heads[head_at : head_at + 2] == b"\xff\x92":
        head_at += 2
    if packed is None:
        at = head_at
    seen: dict[int, int] = {}
    for block, n, size in found:
        first = seen.get(id(block), sum(w[0] for w in block.words))
        piece = data[at : at + size]
        at += size
        if len(piece) < size:
            raise BadPacket("the data end early")
        if block.words and not tier1.ends_segment(first - 1, style):
            block.words[-1][0] += n
            block.words[-1][1] += piece
        else:
            block.words.append([n, piece])
        seen[id(block)] = first + n
    return at, head_at
