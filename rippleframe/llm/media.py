"""Media columns: baseline JPEG as the lossless store of a payload, and features of the stored image.

A payload of a positive multiple of 64 bytes becomes one grey 8x8 block for each 64 bytes, byte b as the
quantised coefficient b, in zigzag order. Coefficients are Huffman-coded by one fixed pair of tables that has
short codes for the sizes that text has (LENGTHS) and holds every run and size of a byte; a restart after
each block keeps the DC prediction at 0. The blocks fill a nearly square grid, what is left of it with
blocks of zeros, and a comment segment holds the payload's length.

``decode`` reads any baseline (SOF0, 8 bit) image with a grey or an interleaved first scan: it parses
the markers, Huffman-decodes the scan and gives the coefficients of the first (luminance) component.
Where each block ends in a restart, as here, the blocks of many images are decoded in step: one look-up in the
table of all 16-bit prefixes gives each block's next symbol, in numpy. Others are decoded symbol by symbol.
The thumbnail has one sample for each block, from its DC alone. Work is cut into slices of SLICE blocks,
so a text's length bounds neither the arrays nor their number.

A null or empty text is one block of zero bytes. Equal texts give equal values. Columns other than the
id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

BLOCK = 64
#: Most blocks in a row or column (16-bit sizes in samples).
SIDE = 8191
#: Blocks that are coded or decoded at once.
SLICE = 1 << 14
#: The quantiser: DC values are eight times the level, so the thumbnail's samples are 128 + their byte.
STEP = 8
EOB, ZRL = 0x00, 0xF0
#: Code lengths: of DC sizes, and of AC symbols (run and size); other runs and sizes of a byte have the longest.
DC_LENGTHS = {7: 1, 6: 2, 8: 3, **{s: 6 for s in range(6)}}
AC_LENGTHS = {0x07: 1, 0x06: 2, 0x08: 3, EOB: 5, 0x04: 5, 0x05: 7, 0x03: 7, 0x02: 7, 0x01: 7, ZRL: 8}
LONGEST = 14


class BadImage(ValueError):
    pass


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _grid(blocks: int) -> tuple[int, int]:
    wide = min(SIDE, max(int(np.ceil(np.sqrt(blocks))), -(-blocks // SIDE)))
    high = -(-blocks // wide)
    if high > SIDE:
        raise BadImage("payload too large for one image")
    return wide, high


def _table(lengths: dict[int, int]) -> tuple[list[int], bytes]:
    """Counts of codes by length, and the symbols in their order."""
    counts = [0] * 16
    for n in lengths.values():
        counts[n - 1] += 1
    return counts, bytes(sorted(lengths, key=lambda s: (lengths[s], s)))


DC = _table(DC_LENGTHS)
AC = _table({r << 4 | s: LONGEST for r in range(16) for s in range(1, 9)} | AC_LENGTHS)


def _codes(table: tuple[list[int], bytes]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(1)
def _writing() -> tuple[np.ndarray, ...]:
    """Codes and lengths by symbol (DC at 256 + size), sizes of bytes, and up to three ZRLs as one code."""
    code, length = np.zeros(512, np.uint64), np.zeros(512, np.int64)
    for table, base in ((AC, 0), (DC, 256)):
        for (n, c), symbol in _codes(table).items():
            code[base + symbol], length[base + symbol] = c, n
    size = np.array([b.bit_length() for b in range(256)], np.int64)
    runs = [0]
    for _ in range(3):
        runs.append(runs[-1] << int(length[ZRL]) | int(code[ZRL]))
    return code, length, size, np.array(runs, np.uint64)


def _scan(cells: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (rows of 64), each followed by its restart marker (0 to 7; below 0: none); where each ends."""
    code, length, size, runs = _writing()
    n = len(cells)
    some = np.ones((n, BLOCK + 1), bool)  # the last column stands for the end of the block
    some[:, 1:BLOCK] = cells[:, 1:] != 0
    row, col = np.nonzero(some)
    end = col == BLOCK
    value = np.where(end, 0, cells[row, np.minimum(col, BLOCK - 1)]).astype(np.int64)
    before = np.concatenate([[0], col[:-1]])
    run = np.where(col == 0, 0, col - before - 1)
    bits = size[value]
    symbol = np.where(col == 0, 256 + bits, (run & 15) << 4 | bits)
    coded, used = (code[symbol] << bits.astype(np.uint64)) | value.astype(np.uint64), length[symbol] + bits
    skipped = np.where(end, 0, run >> 4)
    coded |= runs[skipped] << used.astype(np.uint64)
    used = used + skipped * length[ZRL]
    # A block that ends in zeros ends with EOB; then ones fill its last byte.
    coded, used = np.where(end, np.where(run > 0, code[EOB], 0), coded), np.where(end, np.where(run > 0, length[EOB], 0), used)
    ends = np.flatnonzero(end)
    total = np.add.reduceat(used, np.concatenate([[0], ends[:-1] + 1]))
    pad = -total % 8
    coded[ends] = coded[ends] << pad.astype(np.uint64) | (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)
    used[ends] += pad
    at = np.cumsum(used) - used
    raw = np.zeros((int(at[-1] + used[-1]) >> 3) + 8, np.uint8)
    word = coded << (64 - used - (at & 7)).clip(0, 63).astype(np.uint64)
    word[used == 0] = 0
    place, j = at >> 3, 0
    while len(word):
        # Bits of neighbours in a byte never meet, so adding is joining.
        raw += np.bincount(place + j, (word >> np.uint64(56)).astype(np.float64), len(raw)).astype(np.uint8)
        word = word << np.uint64(8)
        left = word != 0
        word, place, j = word[left], place[left], j + 1
    raw = raw[:-8]
    stop = np.cumsum(total + pad) >> 3
    stuffed = raw == 0xFF
    extra = stuffed.astype(np.int64)
    extra[stop - 1] += 2 * (restart >= 0)
    to = np.arange(len(raw)) + np.cumsum(extra) - extra
    out = np.zeros(len(raw) + int(extra.sum()), np.uint8)
    out[to] = raw
    last = to[stop - 1] + stuffed[stop - 1]
    marked = restart >= 0
    out[last[marked] + 1], out[last[marked] + 2] = 0xFF, 0xD0 + restart[marked]
    return out, last + 1 + 2 * marked


def _cells(payloads: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the blocks of payloads: cells, restart markers and whose they are."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for k, payload in enumerate(payloads):
        wide, high = _grid(len(payload) // BLOCK)
        for lo in range(0, wide * high, SLICE):
            size = min(SLICE, wide * high - lo)
            cells = np.zeros((size, BLOCK), np.uint8)
            part = payload[lo * BLOCK : (lo + size) * BLOCK]
            cells.reshape(-1)[: len(part)] = np.frombuffer(part, np.uint8)
            at = np.arange(lo, lo + size)
            held.append((cells, np.where(at == wide * high - 1, -1, at % 8), np.full(size, k)))
            n += size
            if n >= SLICE:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _frame(blocks: int, size: int) -> bytes:
    wide, high = _grid(blocks)
    table = lambda kind, t: bytes([kind, *t[0]]) + t[1]
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">Q", size)),
        _segment(0xDB, bytes([0] + [STEP] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, table(0x00, DC) + table(0x10, AC)),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """The images of payloads, whose lengths are positive multiples of 64."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise BadImage("a payload must be a positive multiple of 64 bytes")
    scans: list[list[bytes]] = [[] for _ in payloads]
    for cells, restart, owner in _cells(payloads):
        data, ends = _scan(cells, restart)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        begin = 0
        for i in last.tolist():
            scans[owner[i]].append(data[begin : ends[i]].tobytes())
            begin = int(ends[i])
    return [b"".join((_frame(len(p) // BLOCK, len(p)), *scan, b"\xff\xd9")) for p, scan in zip(payloads, scans, strict=True)]


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def parse(image: bytes) -> dict:
    """Sizes, components, tables, comment and the bytes of the first scan."""
    if image[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    at, found = 2, {"quant": {}, "huffman": {}, "restart": 0, "comment": b""}
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise BadImage("a marker is missing")
        marker, size = image[at + 1], struct.unpack(">H", image[at + 2 : at + 4])[0]
        body, at = image[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise BadImage("a segment is cut short")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(int)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                found["huffman"][body[0] >> 4, body[0] & 15] = (list(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, high, wide, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise BadImage("only 8-bit baseline images are read")
            found |= {"width": wide, "height": high, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise BadImage("not a baseline image")
        elif marker == 0xDD:
            found["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            found["comment"] = body
        elif marker == 0xDA:
            found["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            found["data"] = image[at:]
            return found


@lru_cache(16)
def _look_up(counts: tuple[int, ...], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that begins each 16-bit number; length 0 where none does."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for (n, code), s in _codes((list(counts), symbols)).items():
        length[code << 16 - n : code + 1 << 16 - n], symbol[code << 16 - n : code + 1 << 16 - n] = n, s
    return length, symbol


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A scan's bytes without stuffing and markers, and where its restart intervals begin."""
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if len(stop):
        raw, ff = raw[: stop[0]], ff[ff < stop[0]]
        after = after[: len(ff)]
    marker = (after >= 0xD0) & (after <= 0xD7)
    keep = np.ones(len(raw), bool)
    keep[ff[(after == 0) & (ff + 1 < len(raw))] + 1] = False
    keep[ff[marker]] = False
    keep[ff[marker] + 1] = False
    place = np.cumsum(keep) - keep
    return raw[keep], np.concatenate([[0], place[ff[marker]]])


def _in_step(raw: np.ndarray, starts: np.ndarray, dc: tuple[np.ndarray, np.ndarray], ac: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Coefficients of blocks that begin at these bytes, all with a prediction of 0: one symbol of each at a time."""
    first, last = int(starts[0]), len(raw)
    data = np.concatenate([raw[first:last], np.full(16, 0xFF, np.uint8)]).astype(np.uint64)
    n = len(data) - 8
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word |= data[j : j + n] << np.uint64(56 - 8 * j)
    most = (n - 1) * 8
    out = np.zeros((len(starts), BLOCK), np.int32)
    at, row = (starts - first) * 8, np.arange(len(starts))
    place = np.zeros(len(starts), np.int64)
    tables = dc
    while len(row):
        x = word[at >> 3] << (at & 7).astype(np.uint64)
        look = (x >> np.uint64(48)).astype(np.int64)
        used, symbol = tables[0][look].astype(np.int64), tables[1][look].astype(np.int64)
        if not used.all():
            raise BadImage("no such code")
        size = symbol & 15
        bits = ((x << used.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(bits >> np.maximum(size - 1, 0) | (size == 0), bits, bits - (1 << size) + 1)
        at = at + used + size
        if (at > most).any():
            raise BadImage("the scan ends early")
        if tables is dc:
            out[:, 0], place, tables = value, place + 1, ac
            continue
        run = symbol >> 4
        goes = (size > 0) | (run == 15)
        at, row, place, value, size = at[goes], row[goes], place[goes] + run[goes], value[goes], size[goes]
        if (place >= BLOCK).any():
            raise BadImage("a run leaves the block")
        out[row, place] = value
        place = place + 1
        goes = place < BLOCK
        at, row, place = at[goes], row[goes], place[goes]
    return out


def _stepwise(info: dict) -> bool:
    return len(info["parts"]) == 1 and info["restart"] == 1


def decode_many(images: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Headers and first components of images. Those whose blocks all end in a restart are decoded together, by their tables."""
    out: list = [None] * len(images)
    held: dict[tuple, list] = {}

    def flush(key: tuple) -> None:
        group, base, raws, starts = held.pop(key), 0, [], []
        for _, raw, begin in group:
            raws.append(raw)
            starts.append(begin + base)
            base += len(raw)
        # Within the slice a block can't read on into the next one's bytes unnoticed: its payload's checks would differ.
        cells, at = _in_step(np.concatenate(raws), np.concatenate(starts), _look_up(*key[0]), _look_up(*key[1])), 0
        for k, _, begin in group:
            out[k][1].append(cells[at : at + len(begin)])
            at += len(begin)

    sizes: dict[tuple, int] = {}
    for k, image in enumerate(images):
        info = parse(image)
        if not _stepwise(info):
            out[k] = (info, [_general(info)])
            continue
        n = -(-info["width"] // 8) * -(-info["height"] // 8)
        raw, starts = _split(info.pop("data"))
        if len(starts) != n:
            raise BadImage("restarts are missing")
        out[k] = (info, [])
        tables = [info["huffman"][kind, t] for kind, t in ((0, info["scan"][0][1]), (1, info["scan"][0][2]))]
        key = tuple((tuple(c), s) for c, s in tables)
        for lo in range(0, n, SLICE):
            part = starts[lo : lo + SLICE]
            stop = starts[lo + SLICE] if lo + SLICE < n else len(raw)
            held.setdefault(key, []).append((k, raw[part[0] : stop], part - part[0]))
            sizes[key] = sizes.get(key, 0) + len(part)
            if sizes[key] >= SLICE:
                flush(key)
                sizes[key] = 0
    for key in list(held):
        flush(key)
    return [(info, parts[0] if len(parts) == 1 else np.concatenate(parts)) for info, parts in out]


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def bit(self) -> int:
        if not self.n:
            b = self.data[self.at] if self.at < len(self.data) else 0
            if b == 0xFF:
                if self.data[self.at + 1 : self.at + 2] == b"\0":
                    self.at += 1
                else:
                    raise BadImage("the scan ends early")
            self.at += 1
            self.hold, self.n = b, 8
        self.n -= 1
        return self.hold >> self.n & 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (s := codes.get((length, code))) is not None:
                return s
        raise BadImage("no such code")

    def value(self, size: int) -> int:
        v = self.bits(size)
        return v if not size or v >> size - 1 else v - (1 << size) + 1

    def restart(self) -> None:
        self.n = 0
        if self.at + 1 < len(self.data) and self.data[self.at] == 0xFF and 0xD0 <= self.data[self.at + 1] <= 0xD7:
            self.at += 2


def decode(image: bytes) -> tuple[dict, np.ndarray]:
    """The parsed header, and the first component's quantised coefficients: blocks in scan order x 64, zigzag."""
    return decode_many([image])[0]


def _general(info: dict) -> np.ndarray:
    """Any grey or interleaved scan, symbol by symbol."""
    parts = {p[0]: p for p in info["parts"]}
    scan = [(parts[c], _codes(info["huffman"][0, dc]), _codes(info["huffman"][1, ac])) for c, dc, ac in info["scan"]]
    top_h, top_v = max(p[1] for p in info["parts"]), max(p[2] for p in info["parts"])
    if len(scan) == 1:
        units = -(-(-(-info["width"] * scan[0][0][1] // top_h)) // 8) * -(-(-(-info["height"] * scan[0][0][2] // top_v)) // 8)
        each = [1]
    else:
        units = -(-info["width"] // (8 * top_h)) * -(-info["height"] // (8 * top_v))
        each = [p[1] * p[2] for p, _, _ in scan]
    bits, last, out = _Bits(info["data"]), [0] * len(scan), []
    for unit in range(units):
        if info["restart"] and unit and unit % info["restart"] == 0:
            bits.restart()
            last = [0] * len(scan)
        for k, (_, dc, ac) in enumerate(scan):
            for _ in range(each[k]):
                block = [0] * 64
                last[k] = block[0] = last[k] + bits.value(bits.symbol(dc))
                i = 1
                while i < 64:
                    s = bits.symbol(ac)
                    if s & 15 == 0 and s != 0xF0:
                        break
                    i += s >> 4
                    if s & 15:
                        if i > 63:
                            raise BadImage("a run leaves the block")
                        block[i] = bits.value(s & 15)
                    i += 1
                if k == 0:
                    out.append(block)
    return np.array(out, np.int32).reshape(-1, 64)


def payload_of(info: dict, cells: np.ndarray) -> bytes:
    n = struct.unpack(">Q", info["comment"])[0]
    if n > cells.size or ((cells < 0) | (cells > 255)).any():
        raise BadImage("no payload of bytes")
    return cells.astype(np.uint8).tobytes()[:n]


def read_payload(image: bytes) -> tuple[bytes, dict, np.ndarray]:
    info, cells = decode(image)
    return payload_of(info, cells), info, cells


def thumbnail(info: dict, cells: np.ndarray) -> np.ndarray:
    """One luminance sample for each block, from its DC: level 128, an eighth of the dequantised value, clamped."""
    quant = int(info["quant"][info["parts"][0][3]][0])
    part, top_h = info["parts"][0], max(p[1] for p in info["parts"])
    dc = np.clip((cells[:, 0] * quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    wide = -(-(-(-info["width"] * part[1] // top_h)) // 8)
    if len(info["scan"]) > 1 and part[1] * part[2] > 1:  # blocks lie unit by unit
        h, v = part[1], part[2]
        across = -(-info["width"] // (8 * top_h))
        dc = dc.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)[:, :wide]
        return dc
    return dc.reshape(-1, wide)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: the mean of each of 8x8 cells of the thumbnail against the mean of all, in hex."""
    h, w = thumb.shape
    rows, cols = np.arange(9) * h // 8, np.arange(9) * w // 8
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    r1, c1 = np.maximum(rows[1:], rows[:-1] + 1), np.maximum(cols[1:], cols[:-1] + 1)
    r0, c0 = rows[:-1], cols[:-1]
    cell = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    area = np.outer(r1 - r0, c1 - c0)
    bits = cell * (h * w) >= sums[-1, -1] * area
    return np.packbits(bits.ravel()).tobytes().hex()


def media_rows(texts: list[str]) -> list[tuple]:
    raws = [t.encode() for t in texts]
    payloads = [raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)) for raw in raws]
    images, out = encode_many(payloads), []
    for raw, image, (info, cells) in zip(raws, images, decode_many(images), strict=True):
        back = payload_of(info, cells)
        feature = f"{info['width']}x{info['height']}:{thumbnail_hash(thumbnail(info, cells))}"
        out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(image), hashlib.sha256(image).hexdigest(), feature, image))
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a slice of blocks each."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t) // BLOCK + 1
        if held >= SLICE:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_ROW = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_image: bool = False) -> DataFrame:
    """The digest of each row's image; with_image adds the image itself as a binary column."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _ROW.split(", ")] + ["image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _groups(texts):
                cols = list(zip(*media_rows(texts[lo:hi]), strict=True))
                arrays = [b.column("doc_id").slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                n = 9 if with_image else 8
                yield pa.RecordBatch.from_arrays(arrays[:n], names[:n])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _ROW + (", image binary" if with_image else ""))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
