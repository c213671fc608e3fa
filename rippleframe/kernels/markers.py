"""Codestream headers (T.800 Annex A): marker segments to plain records, and back."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Marker codes.
SOC, SOT, SOD, EOC, SIZ, COD, COC, RGN, QCD, QCC, POC, TLM, PLM, PLT, PPM, PPT, SOP, EPH, CRG, COM = (
    0xFF4F, 0xFF90, 0xFF93, 0xFFD9, 0xFF51, 0xFF52, 0xFF53, 0xFF5E, 0xFF5C, 0xFF5D, 0xFF5F, 0xFF55, 0xFF57, 0xFF58, 0xFF60, 0xFF61, 0xFF91, 0xFF92, 0xFF63, 0xFF64,
)
NAMES = {SOC: "SOC", SOT: "SOT", SOD: "SOD", EOC: "EOC", SIZ: "SIZ", COD: "COD", COC: "COC", RGN: "RGN", QCD: "QCD", QCC: "QCC", POC: "POC", TLM: "TLM", PLM: "PLM", PLT: "PLT", PPM: "PPM", PPT: "PPT", SOP: "SOP", EPH: "EPH", CRG: "CRG", COM: "COM"}
ORDERS = ("lrcp", "rlcp", "rpcl", "pcrl", "cprl")
REVERSIBLE = 1


class BadStream(ValueError):
    pass


@dataclass
class Component:
    depth: int
    signed: bool = False
    dx: int = 1
    dy: int = 1


@dataclass
class Style:
    """How a component is transformed and cut into blocks; sizes are exponents of two."""

    levels: int = 5
    block_w: int = 6
    block_h: int = 6
    flags: int = 0
    wavelet: int = REVERSIBLE
    precincts: list[tuple[int, int]] = field(default_factory=list)  # by resolution; empty: 15, 15

    def precinct(self, res: int) -> tuple[int, int]:
        return self.precincts[min(res, len(self.precincts) - 1)] if self.precincts else (15, 15)


@dataclass
class Quant:
    kind: int = 0  # 0 none, 1 derived from the first step, 2 a step for each band
    guard: int = 2
    steps: list[tuple[int, int]] = field(default_factory=list)  # exponent, mantissa

    def step(self, band: int) -> tuple[int, int]:
        if self.kind == 1:
            e, m = self.steps[0]
            return e - max(0, (band - 1) // 3), m
        return self.steps[min(band, len(self.steps) - 1)] if self.steps else (0, 0)


@dataclass
class Progression:
    res0: int
    comp0: int
    layer1: int
    res1: int
    comp1: int
    order: int


@dataclass
class Coding:
    """What the main header sets and a tile's own header may set anew."""

    order: int = 0
    layers: int = 1
    mct: int = 0
    sop: bool = False
    eph: bool = False
    cod: Style | None = None
    qcd: Quant | None = None
    coc: dict[int, Style] = field(default_factory=dict)
    qcc: dict[int, Quant] = field(default_factory=dict)
    roi: dict[int, int] = field(default_factory=dict)
    poc: list[Progression] = field(default_factory=list)


@dataclass
class TilePart:
    tile: int
    part: int
    length: int
    data: bytes = b""
    packed: bytes = b""  # packet headers that PPM gives this part


@dataclass
class Header:
    width: int = 0
    height: int = 0
    x: int = 0
    y: int = 0
    tile_w: int = 0
    tile_h: int = 0
    tile_x: int = 0
    tile_y: int = 0
    capabilities: int = 0
    comps: list[Component] = field(default_factory=list)
    main: Coding = field(default_factory=Coding)
    tiles: dict[int, Coding] = field(default_factory=dict)
    parts: list[TilePart] = field(default_factory=list)
    tlm: list[tuple[int, int]] = field(default_factory=list)
    ppm: list[tuple[int, bytes]] = field(default_factory=list)
    ppt: dict[int, list[tuple[int, bytes]]] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    @property
    def across(self) -> int:
        return -(-(self.width - self.tile_x) // self.tile_w)

    @property
    def down(self) -> int:
        return -(-(self.height - self.tile_y) // self.tile_h)

    def style_of(self, tile: int, comp: int) -> Style:
        """A tile's own component, then tile, then main component, then main."""
        t, m = self.tiles.get(tile, Coding()), self.main
        return t.coc.get(comp) or t.cod or m.coc.get(comp) or m.cod

    def quant_of(self, tile: int, comp: int) -> Quant:
        t, m = self.tiles.get(tile, Coding()), self.main
        return t.qcc.get(comp) or t.qcd or m.qcc.get(comp) or m.qcd

    def roi_of(self, tile: int, comp: int) -> int:
        t = self.tiles.get(tile, Coding())
        return t.roi.get(comp, self.main.roi.get(comp, 0))

    def coding_of(self, tile: int) -> Coding:
        t = self.tiles.get(tile)
        return t if t and t.cod else self.main


def _style(body: bytes, has_precincts: bool) -> Style:
    levels, w, h, flags, wavelet = body[:5]
    if levels > 32:
        raise BadStream("too many levels")
    sizes = [(b & 15, b >> 4) for b in body[5 : 6 + levels]] if has_precincts else []
    return Style(levels, (w & 15) + 2, (h & 15) + 2, flags, wavelet, sizes)


def _quant(body: bytes) -> Quant:
    kind, guard = body[0] & 31, body[0] >> 5
    if kind == 0:
        return Quant(kind, guard, [(b >> 3, 0) for b in body[1:]])
    values = struct.unpack(f">{len(body[1:]) // 2}H", body[1 : 1 + len(body[1:]) // 2 * 2])
    return Quant(kind, guard, [(v >> 11, v & 2047) for v in values[: 1 if kind == 1 else None]])


def _siz(body: bytes, h: Header) -> None:
    h.capabilities, h.width, h.height, h.x, h.y, h.tile_w, h.tile_h, h.tile_x, h.tile_y, n = struct.unpack(">H8IH", body[:36])
    if not (h.tile_w and h.tile_h and h.width > h.x and h.height > h.y and n and len(body) >= 36 + 3 * n):
        raise BadStream("impossible sizes")
    h.comps = [Component((d & 127) + 1, d > 127, dx, dy) for d, dx, dy in struct.iter_unpack("3B", body[36 : 36 + 3 * n])]
    if any(c.dx == 0 or c.dy == 0 for c in h.comps):
        raise BadStream("impossible sampling")


def _tlm(body: bytes, seen: int) -> list[tuple[int, int]]:
    index, wide = body[1] >> 4 & 3, 4 if body[1] & 0x40 else 2
    if index == 3:
        return []
    step, out = index + wide, []
    for at in range(2, len(body) - step + 1, step):
        tile = int.from_bytes(body[at : at + index], "big") if index else seen + len(out)
        out.append((tile, int.from_bytes(body[at + index : at + step], "big")))
    return out


def _segment(code: int, body: bytes, h: Header, into: Coding, tile: int | None) -> None:
    many = len(h.comps) > 256
    n = 2 if many else 1
    comp = int.from_bytes(body[:n], "big")
    if code == SIZ:
        _siz(body, h)
    elif code == COD:
        if body[1] > 4:
            raise BadStream("no such progression order")
        into.order, into.layers, into.mct = body[1], struct.unpack(">H", body[2:4])[0], body[4]
        into.sop, into.eph = bool(body[0] & 2), bool(body[0] & 4)
        into.cod = _style(body[5:], bool(body[0] & 1))
    elif code == COC:
        into.coc[comp] = _style(body[n + 1 :], bool(body[n] & 1))
    elif code == QCD:
        into.qcd = _quant(body)
    elif code == QCC:
        into.qcc[comp] = _quant(body[n:])
    elif code == RGN:
        if body[n] == 0:
            into.roi[comp] = body[n + 1]
    elif code == POC:
        form = ">BHHBHB" if many else ">BBHBBB"
        size = struct.calcsize(form)
        into.poc += [Progression(*struct.unpack(form, body[at : at + size])) for at in range(0, len(body) - size + 1, size)]
    elif code == TLM:
        h.tlm += _tlm(body, len(h.tlm))
    elif code == PPM:
        h.ppm.append((body[0], body[1:]))
    elif code == PPT and tile is not None:
        h.ppt.setdefault(tile, []).append((body[0], body[1:]))
    elif code == COM:
        h.comments.append(body[2:])


def walk(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, marker, bytes) of the segments of all headers; tile data is passed over."""
    if data[:2] != b"\xff\x4f":
        raise BadStream("no start of codestream")
    out, at, end_of_part = [(0, SOC, 2)], 2, None
    while at + 2 <= len(data):
        code = data[at] << 8 | data[at + 1]
        if code == EOC:
            out.append((at, code, 2))
            break
        if code == SOD:
            out.append((at, code, 2))
            at = end_of_part if end_of_part is not None and end_of_part > at else len(data) - (2 if data.endswith(b"\xff\xd9") else 0)
            continue
        if code >> 8 != 0xFF:
            raise BadStream(f"no marker at {at}")
        if 0xFF30 <= code <= 0xFF3F:
            out.append((at, code, 2))
            at += 2
            continue
        if at + 4 > len(data):
            raise BadStream("a segment is cut short")
        size = data[at + 2] << 8 | data[at + 3]
        if size < 2 or at + 2 + size > len(data):
            raise BadStream("a segment is cut short")
        out.append((at, code, 2 + size))
        if code == SOT:
            if size != 10:
                raise BadStream("a tile-part header of another size")
            length = int.from_bytes(data[at + 6 : at + 10], "big")
            end_of_part = at + length if length else None
        at += 2 + size
    return out


def parse(data: bytes) -> Header:
    h, tile, part = Header(), None, None
    segments = walk(data)
    if len(segments) < 2 or segments[1][1] != SIZ:
        raise BadStream("no sizes")
    for k, (at, code, size) in enumerate(segments):
        if code == SOT:
            tile, length, number, _ = struct.unpack(">HIBB", data[at + 4 : at + 12])
            part = TilePart(tile, number, length)
        elif code == SOD and part is not None:
            end = segments[k + 1][0] if k + 1 < len(segments) else len(data) - (2 if data.endswith(b"\xff\xd9") else 0)
            part.data = data[at + 2 : end]
            h.parts.append(part)
        elif size > 2:
            into = h.main if tile is None else h.tiles.setdefault(tile, Coding())
            try:
                _segment(code, data[at + 4 : at + size], h, into, tile)
            except BadStream:
                raise
            except (IndexError, ValueError, struct.error) as error:
                if tile is None:
                    raise BadStream(f"bad {NAMES.get(code, hex(code))}") from error
                h.problems.append(f"bad {NAMES.get(code, hex(code))} of tile {tile}")
    if not h.main.cod or not h.main.qcd:
        h.problems.append("no coding style or quantisation")
    hand_out(h)
    return h


def hand_out(h: Header) -> None:
    """Gives the packed headers of the main header (length, bytes; in order of their index) to the tile-parts in order."""
    packed, at = b"".join(b for _, b in sorted(h.ppm, key=lambda x: x[0])), 0
    for part in h.parts:
        if at + 4 > len(packed):
            break
        n = int.from_bytes(packed[at : at + 4], "big")
        part.packed, at = packed[at + 4 : at + 4 + n], at + 4 + n


def segment(code: int, body: bytes = b"") -> bytes:
    return struct.pack(">HH", code, len(body) + 2) + body


def _style_bytes(s: Style) -> bytes:
    return bytes([s.levels, s.block_w - 2, s.block_h - 2, s.flags, s.wavelet]) + bytes(x | y << 4 for x, y in s.precincts)


def _quant_bytes(q: Quant) -> bytes:
    first = bytes([q.kind | q.guard << 5])
    return first + (bytes(e << 3 for e, _ in q.steps) if q.kind == 0 else struct.pack(f">{len(q.steps)}H", *[e << 11 | m for e, m in q.steps]))


def main_header(h: Header) -> bytes:
    m, c = h.main, len(h.comps)
    n = 2 if c > 256 else 1
    sizes = struct.pack(">H8IH", h.capabilities, h.width, h.height, h.x, h.y, h.tile_w, h.tile_h, h.tile_x, h.tile_y, c)
    sizes += b"".join(bytes([k.depth - 1 | k.signed << 7, k.dx, k.dy]) for k in h.comps)
    out = struct.pack(">H", SOC) + segment(SIZ, sizes)
    flags = bool(m.cod.precincts) | m.sop << 1 | m.eph << 2
    out += segment(COD, bytes([flags, m.order]) + struct.pack(">HB", m.layers, m.mct) + _style_bytes(m.cod))
    out += b"".join(segment(COC, k.to_bytes(n, "big") + bytes([bool(s.precincts)]) + _style_bytes(s)) for k, s in m.coc.items())
    out += segment(QCD, _quant_bytes(m.qcd))
    out += b"".join(segment(QCC, k.to_bytes(n, "big") + _quant_bytes(q)) for k, q in m.qcc.items())
    out += b"".join(segment(RGN, k.to_bytes(n, "big") + bytes([0, s])) for k, s in m.roi.items())
    if m.poc:
        form = ">BHHBHB" if c > 256 else ">BBHBBB"
        out += segment(POC, b"".join(struct.pack(form, p.res0, p.comp0, p.layer1, p.res1, p.comp1, p.order) for p in m.poc))
    return out + b"".join(segment(COM, b"\0\1" + t) for t in h.comments)


def write(h: Header, tiles: list[bytes]) -> bytes:
    """The whole codestream, a part for each tile."""
    out = [main_header(h)]
    for number, data in enumerate(tiles):
        out.append(segment(SOT, struct.pack(">HIBB", number, 14 + len(data), 0, 1)) + struct.pack(">H", SOD) + data)
    return b"".join(out) + struct.pack(">H", EOC)


def only_tile(data: bytes, h: Header, tile: int) -> bytes:
    """A codestream of the main header and one tile's parts; packed headers of the main header come along for these parts."""
    segments = walk(data)
    first = next((at for at, code, _ in segments if code == SOT), len(data))
    main = b"".join(data[at : at + size] for at, code, size in segments if at < first and code not in (PPM, TLM))
    packed = b"".join(len(p.packed).to_bytes(4, "big") + p.packed for p in h.parts if p.tile == tile) if h.ppm else b""
    main += b"".join(segment(PPM, bytes([k]) + packed[at : at + 65000]) for k, at in enumerate(range(0, len(packed), 65000)))
    ends = [at for at, code, _ in segments if code in (SOT, EOC)] + [len(data)]
    for at, code, _ in segments:
        if code == SOT and data[at + 4] << 8 | data[at + 5] == tile:
            main += data[at : next(e for e in ends if e > at)]
    return main + struct.pack(">H", EOC)
