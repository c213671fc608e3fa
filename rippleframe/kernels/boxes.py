"""The box container: walking, the header's boxes, and writing."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .markers import Header

MAGIC = bytes.fromhex("0000000C6A5020200D0A870A")
#: Enumerated colour spaces.
YCC, GRAY, RGB = (3, 4, 5, 18, 24, 9, 22, 23), (17, 1, 15), (16, 20)


@dataclass
class Meta:
    """What the container says about its image; parts that are absent or cut short stay None."""

    image: tuple | None = None  # height, width, comps, depth, signed, compression, unknown colour, rights
    method: int | None = None
    colour: int | None = None
    profile: bytes | None = None
    capture: tuple[float, float] | None = None  # vertical, horizontal, a metre
    display: tuple[float, float] | None = None
    palette: list[list[int]] | None = None
    palette_depths: list[tuple[int, bool]] | None = None
    mapping: list[tuple[int, int, int]] = field(default_factory=list)  # component, kind, palette column
    channels: list[tuple[int, int, int]] = field(default_factory=list)  # channel, kind, association
    depths: list[tuple[int, bool]] = field(default_factory=list)
    xml: list[bytes] = field(default_factory=list)
    uuid: list[bytes] = field(default_factory=list)

    def is_ycc(self) -> bool:
        return self.method == 1 and self.colour in YCC

    def is_gray(self) -> bool:
        return self.method == 1 and self.colour in GRAY

    def is_rgb(self) -> bool:
        return self.method == 1 and self.colour in RGB

    def needs_reorder(self) -> bool:
        return any(kind == 0 and channel != at - 1 for channel, kind, at in self.channels if 0 < at < 65535)

    def order(self, n: int) -> list[int]:
        """Which channel stands in each colour's place; channels of no colour are left out once some are named."""
        named = {at - 1: channel for channel, kind, at in self.channels if kind == 0 and 0 < at < 65535}
        return [named.get(k, k) for k in range(max(named) + 1)] if named else list(range(n))


def walk(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, str, int, int]]:
    """(offset, kind, header bytes, whole length) of the boxes; stops where a length is impossible."""
    end, out = len(data) if end is None else end, []
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            if at + 16 > end:
                break
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            break
        out.append((at, data[at + 4 : at + 8].decode("latin-1"), head, size))
        at += size
    return out


def sniff(data: bytes) -> str | None:
    return "j2c" if data[:4] == b"\xff\x4f\xff\x51" else "jp2" if data[:12] == MAGIC else None


def _depth(b: int) -> tuple[int, bool]:
    return (b & 127) + 1, b > 127


def _resolution(body: bytes) -> tuple[float, float] | None:
    vn, vd, hn, hd, ve, he = struct.unpack(">4H2b", body[:10])
    return (vn / vd * 10.0**ve, hn / hd * 10.0**he) if vd and hd else None


def _palette(body: bytes, m: Meta) -> None:
    entries, columns = struct.unpack(">HB", body[:3])
    depths = [_depth(b) for b in body[3 : 3 + columns]]
    at, rows = 3 + columns, []
    for _ in range(entries):
        row = []
        for depth, signed in depths:
            n = 1 if depth <= 8 else 2
            if at + n > len(body):
                return  # cut short
            v = int.from_bytes(body[at : at + n], "big")
            row.append(v - (1 << depth) if signed and v >> depth - 1 else v)
            at += n
        rows.append(row)
    m.palette, m.palette_depths = rows, depths


def _header(data: bytes, at: int, end: int, m: Meta) -> None:
    for start, kind, head, size in walk(data, at, end):
        body = data[start + head : start + size]
        try:
            if kind == "ihdr":
                h, w, n, bits, c, unknown, rights = struct.unpack(">IIH4B", body[:14])
                m.image = (h, w, n, *_depth(bits), c, unknown, rights)
            elif kind == "bpcc":
                m.depths = [_depth(b) for b in body]
            elif kind == "colr" and m.method is None:
                m.method = body[0]
                if m.method == 1:
                    m.colour = struct.unpack(">I", body[3:7])[0]
                elif m.method == 2:
                    m.profile = body[3:]
            elif kind == "res ":
                for s, k, hd, n in walk(data, start + head, start + size):
                    if k in ("resc", "resd"):
                        setattr(m, "capture" if k == "resc" else "display", _resolution(data[s + hd : s + n]))
            elif kind == "pclr":
                _palette(body, m)
            elif kind == "cmap":
                m.mapping = list(struct.iter_unpack(">HBB", body[: len(body) // 4 * 4]))
            elif kind == "cdef":
                n = struct.unpack(">H", body[:2])[0]
                m.channels = list(struct.iter_unpack(">3H", body[2 : 2 + 6 * min(n, (len(body) - 2) // 6)]))
        except (struct.error, IndexError):
            continue


def unwrap(data: bytes) -> tuple[Meta | None, bytes | None]:
    """The container's records and its codestream; a bare codestream has no records; neither: (None, None)."""
    if data[:2] == b"\xff\x4f":
        return None, data
    if len(data) < 12:
        return None, None
    m, stream = Meta(), None
    for at, kind, head, size in walk(data):
        body = data[at + head : at + size]
        if kind == "jp2h":
            _header(data, at + head, at + size, m)
        elif kind == "jp2c":
            stream = body
        elif kind == "xml ":
            m.xml.append(body)
        elif kind == "uuid":
            m.uuid.append(body)
    return (m, stream) if stream is not None else (None, None)


def box(kind: str, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind.encode("latin-1")) + body


def wrap(stream: bytes, h: Header, extra: bytes = b"") -> bytes:
    """The container of a codestream; extra boxes go into its header box."""
    kinds = {(c.depth, c.signed) for c in h.comps}
    bits = 255 if len(kinds) > 1 else h.comps[0].depth - 1 | h.comps[0].signed << 7
    image = box("ihdr", struct.pack(">IIH4B", h.height - h.y, h.width - h.x, len(h.comps), bits, 7, 1, 0))
    if bits == 255:
        image += box("bpcc", bytes(c.depth - 1 | c.signed << 7 for c in h.comps))
    colour = box("colr", bytes([1, 0, 0]) + struct.pack(">I", 16 if len(h.comps) >= 3 else 17))
    return MAGIC + box("ftyp", b"jp2 " + bytes(4) + b"jp2 ") + box("jp2h", image + colour + extra) + box("jp2c", stream)
