"""Whole images: planes of integers to a codestream, and back."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import boxes, markers, structure, tier1, tier2, wavelet
from .bitio import OutOfBits
from .markers import REVERSIBLE, Coding, Component, Header, Quant, Style


@dataclass
class Options:
    lossless: bool = True
    quality: float = 0.8
    layers: int = 1
    levels: int = 5
    block: tuple[int, int] = (64, 64)
    order: str = "lrcp"
    tile: tuple[int, int] | None = None
    flags: int = 0
    sop: bool = False
    eph: bool = False
    precincts: list[tuple[int, int]] = field(default_factory=list)  # exponents, by resolution
    target_bytes: int | None = None  # of all packets together
    depth: int = 8
    signed: bool = False
    colour: bool | None = None  # None: where there are three planes of a size
    sampling: list[tuple[int, int]] | None = None
    origin: tuple[int, int] = (0, 0)
    roi: dict[int, int] = field(default_factory=dict)
    container: bool = False


def exponent_mantissa(step: float, bits: int) -> tuple[int, int]:
    """The nearest step size that a header can hold."""
    e = min(31, max(0, bits - int(np.floor(np.log2(step)))))
    return e, int(min(2047, max(0, round((step / 2.0 ** (bits - e) - 1) * 2048))))


def step_size(e: int, m: int, bits: int) -> float:
    return (1 + m / 2048) * 2.0 ** (bits - e)


def default_steps(levels: int, quality: float, bits: int) -> list[float]:
    """A step for each band, LL first, then HL, LH, HH of each resolution; finer for the coarser ones' energy."""
    base = 2.0**bits * 10.0 ** (-4 * quality)
    out = [base / 2.0 ** max(levels - 1, 0)]
    for level in range(levels, 0, -1):
        out += [base * f / 2.0 ** (level - 1) for f in (2, 2, 4)]
    return out


# --- colour -----------------------------------------------------------------------------------

#: Fixed values of the irreversible transform.
ICT = np.array([[0.299, 0.587, 0.114], [-0.16875, -0.33126, 0.5], [0.5, -0.41869, -0.08131]])
ICT_BACK = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])


def colour_forward(p: list[np.ndarray], reversible: bool) -> list[np.ndarray]:
    r, g, b = p[:3]
    if reversible:
        return [r + 2 * g + b >> 2, b - g, r - g, *p[3:]]
    return [*(row[0] * r + row[1] * g + row[2] * b for row in ICT), *p[3:]]


def colour_back(p: list[np.ndarray], reversible: bool) -> list[np.ndarray]:
    y, cb, cr = p[:3]
    if reversible:
        g = y - (cb + cr >> 2)
        return [cr + g, g, cb + g, *p[3:]]
    return [*(row[0] * y + row[1] * cb + row[2] * cr for row in ICT_BACK), *p[3:]]


# --- rate -------------------------------------------------------------------------------------


def hull(ends: list[int], gains: list[float]) -> list[tuple[float, int]]:
    """(slope, passes) of the points worth stopping at, slopes falling."""
    out: list[tuple[float, int, int, float]] = []
    for n, (e, g) in enumerate(zip(ends, gains, strict=True), 1):
        while True:
            _, _, e0, g0 = out[-1] if out else (0, 0, 0, 0.0)
            if g <= g0 and out or g <= 0:
                break
            slope = (g - g0) / (e - e0) if e > e0 else float("inf")
            if out and slope >= out[-1][0]:
                out.pop()
                continue
            out.append((slope, n, e, g))
            break
    return [(s, n) for s, n, _, _ in out]


def allocate(blocks: list[tuple[tier1.Coded, float]], targets: list[int | None]) -> list[list[int]]:
    """Passes of each block by the end of each layer: the smallest slope whose bytes fit; None takes all."""
    hulls = [hull(c.ends, [g * w for g in c.gains]) for c, w in blocks]
    slopes = sorted({s for h in hulls for s, _ in h}, reverse=True)
    out = [[0] * len(targets) for _ in blocks]

    def cut(least: float) -> list[int]:
        return [max((n for s, n in h if s >= least), default=0) for h in hulls]

    for layer, target in enumerate(targets):
        if target is None:
            taken = [tier1.passes_of(c.planes) for c, _ in blocks]
        else:
            lo, hi = 0, len(slopes)  # how many of the slopes fit
            while lo < hi:
                mid = (lo + hi + 1) // 2
                size = sum(c.ends[n - 1] for (c, _), n in zip(blocks, cut(slopes[mid - 1]), strict=True) if n)
                lo, hi = (mid, hi) if size <= target else (lo, mid - 1)
            taken = cut(slopes[lo - 1]) if lo else [0] * len(blocks)
        for k, n in enumerate(taken):
            out[k][layer] = max(n, out[k][layer - 1] if layer else 0)
    return out


# --- encoding ---------------------------------------------------------------------------------


def _header(planes: list[np.ndarray], o: Options) -> Header:
    sampling = o.sampling or [(1, 1)] * len(planes)
    x, y = o.origin
    wide = max(structure.up(x, dx) * dx + p.shape[1] * dx if dx > 1 else x + p.shape[1] for p, (dx, _) in zip(planes, sampling, strict=True))
    high = max(structure.up(y, dy) * dy + p.shape[0] * dy if dy > 1 else y + p.shape[0] for p, (_, dy) in zip(planes, sampling, strict=True))
    if o.sampling:  # the first component has the whole size
        wide, high = x + planes[0].shape[1], y + planes[0].shape[0]
    tw, th = o.tile or (wide, high)
    h = Header(wide, high, x, y, tw, th, comps=[Component(o.depth, o.signed, dx, dy) for dx, dy in sampling])
    same = len(planes) >= 3 and len({p.shape for p in planes[:3]}) == 1
    colour = same if o.colour is None else o.colour and same
    style = Style(o.levels, o.block[0].bit_length() - 1, o.block[1].bit_length() - 1, o.flags, REVERSIBLE if o.lossless else 0, list(o.precincts))
    if o.lossless:
        quant = Quant(0, 2, [(o.depth + colour + g, 0) for g in [0, *[1, 1, 2] * o.levels]])
    else:
        quant = Quant(2, 3, [exponent_mantissa(s, o.depth) for s in default_steps(o.levels, o.quality, o.depth)])
    h.main = Coding(markers.ORDERS.index(o.order), o.layers, int(colour), o.sop, o.eph, style, quant, roi=dict(o.roi))
    return h


def quantise(a: np.ndarray, step: float) -> np.ndarray:
    return (np.sign(a) * np.floor(np.abs(a) / step)).astype(np.int64)


def _corner(res: list[structure.Resolution], r: int, kind: int) -> tuple[int, int]:
    """Where a band lies in the array of all coefficients: x, y."""
    if r == 0:
        return 0, 0
    below = res[r - 1]
    return (below.x1 - below.x0) * (kind & 1), (below.y1 - below.y0) * (kind >> 1)


def encode_tile(h: Header, tile: int, planes: list[np.ndarray], o: Options, target: int | None) -> bytes:
    """The packets of one tile."""
    reversible = o.lossless
    comps = [structure.component(h, tile, c) for c in range(len(h.comps))]
    some: list[np.ndarray] = []
    for c, (p, k) in enumerate(zip(planes, h.comps, strict=True)):
        top, ox, oy = comps[c][-1], structure.up(h.x, k.dx), structure.up(h.y, k.dy)
        part = p[top.y0 - oy : top.y1 - oy, top.x0 - ox : top.x1 - ox].astype(np.int64)
        some.append(part if k.signed else part - (1 << k.depth - 1))
    if h.main.mct:
        some = colour_forward(some, reversible)
    blocks, places = [], []
    for c, (p, res) in enumerate(zip(some, comps, strict=True)):
        style, quant = h.style_of(tile, c), h.quant_of(tile, c)
        cells = wavelet.analyse2d(p, res[-1].x0, res[-1].y0, style.levels, style.wavelet)
        for r, level in enumerate(res):
            for b in level.bands:
                x, y = _corner(res, r, b.kind)
                band = cells[y : y + b.y1 - b.y0, x : x + b.x1 - b.x0]
                step = 1.0 if reversible else step_size(*quant.step(b.index), h.comps[c].depth)
                q = band.astype(np.int64) if reversible else quantise(band, step)
                weight = (step * wavelet.norm(style.wavelet, max(style.levels - r + (r > 0), 1), b.kind)) ** 2 if style.levels else step * step
                shift = h.roi_of(tile, c)
                for place in (k for pr in level.precincts for cs in pr.cells if cs.band == b.index for k in cs.blocks):
                    part = q[place.y0 - b.y0 : place.y1 - b.y0, place.x0 - b.x0 : place.x1 - b.x0]
                    if shift:
                        part = part << shift
                    place.coded = tier1.encode(part.ravel().tolist(), part.shape[1], part.shape[0], b.kind, style.flags)
                    blocks.append((place.coded, weight))
                    places.append(place)
    layers = h.main.layers
    whole = sum(len(c.data) for c, _ in blocks)
    end = None if target is None or target >= whole else target
    total = whole if end is None else end
    targets = [total >> layers - 1 - n for n in range(layers - 1)] + [end]
    for place, upto in zip(places, allocate(blocks, targets), strict=True):
        place.upto = upto
    limits = {c: {b.index: h.quant_of(tile, c).guard + h.quant_of(tile, c).step(b.index)[0] - 1 + h.roi_of(tile, c) for r in res for b in r.bands} for c, res in enumerate(comps)}
    for c, res in enumerate(comps):
        for r in res:
            for p in r.precincts:
                tier2.prepare(p, limits[c], layers)
    out = []
    for number, (layer, _, c, p) in enumerate(structure.packet_order(comps, layers, h.main.order, h.main.poc)):
        out.append(tier2.encode(p, layer, h.style_of(tile, c).flags, number, o.sop, o.eph))
    return b"".join(out)


def encode(planes: list[np.ndarray], options: Options | None = None) -> bytes:
    o = options or Options()
    h = _header(planes, o)
    n = h.across * h.down
    area = [max(0, x1 - x0) * max(0, y1 - y0) for x0, y0, x1, y1 in (structure.tile_rect(h, t) for t in range(n))]
    share = [None if o.target_bytes is None else o.target_bytes * a // max(1, sum(area)) for a in area]
    stream = markers.write(h, [encode_tile(h, t, planes, o, share[t]) for t in range(n)])
    return boxes.wrap(stream, h) if o.container else stream


# --- decoding ---------------------------------------------------------------------------------


@dataclass
class Image:
    header: Header
    meta: boxes.Meta | None
    planes: list[np.ndarray]
    depths: list[tuple[int, bool]]
    problems: list[str]


def read_packets(h: Header, tile: int, comps: list[list[structure.Resolution]]) -> str | None:
    """Lets the blocks collect their bytes; what was wrong, if the data end early."""
    coding, parts = h.coding_of(tile), [p for p in h.parts if p.tile == tile]
    data = b"".join(p.data for p in parts)
    packed = b"".join(p.packed for p in parts) or b"".join(b for _, b in sorted(h.ppt.get(tile, []), key=lambda x: x[0])) or None
    at = head = 0
    changes = h.tiles[tile].poc if tile in h.tiles and h.tiles[tile].poc else h.main.poc
    try:
        for layer, _, c, p in structure.packet_order(comps, coding.layers, coding.order, changes):
            if at >= len(data) and packed is None:
                return None if at == len(data) else "the data end early"
            at, head = tier2.decode(data, at, p, layer, h.style_of(tile, c).flags, packed, head)
    except (OutOfBits, ValueError, IndexError) as error:
        return str(error)
    return None


def unshift(v: np.ndarray, shift: int) -> np.ndarray:
    """Takes the region of interest back down; v holds doubled values."""
    return np.where(np.abs(v) >= 2 << shift, np.sign(v) * (np.abs(v) >> shift), v) if shift else v


def within(block: structure.BlockPlace, flags: int, passes: int) -> list[tuple[int, bytes]]:
    """The codewords of a block's first passes."""
    out = []
    for n, word in block.words:
        if passes <= 0:
            break
        out.append((min(n, passes), bytes(word)))
        passes -= n
    return out


def decode_component(h: Header, tile: int, c: int, res: list[structure.Resolution], reduce: int, problems: list[str]) -> np.ndarray:
    style, quant, shift = h.style_of(tile, c), h.quant_of(tile, c), h.roi_of(tile, c)
    res = res[: max(1, len(res) - reduce)]
    top = res[-1]
    cells = np.zeros((top.y1 - top.y0, top.x1 - top.x0), np.int64 if style.wavelet == REVERSIBLE else np.float64)
    for r, level in enumerate(res):
        for b in level.bands:
            x, y = _corner(res, r, b.kind)
            e, m = quant.step(b.index)
            most = quant.guard + e - 1 + shift
            gain = (0, 1, 1, 2)[b.kind] if style.wavelet == REVERSIBLE else 0
            for place in (k for pr in level.precincts for cs in pr.cells if cs.band == b.index for k in cs.blocks if k.words):
                wide, high = place.x1 - place.x0, place.y1 - place.y0
                try:
                    v = tier1.decode(within(place, style.flags, place.passes), most - place.missing, wide, high, b.kind, style.flags)
                except (IndexError, ValueError) as error:
                    problems.append(f"a block of tile {tile}: {error}")
                    continue
                v = unshift(np.array(v, np.int64).reshape(high, wide), shift)
                if style.wavelet == REVERSIBLE and quant.kind == 0:
                    v = np.sign(v) * (np.abs(v) >> 1)
                else:
                    v = v * (step_size(e, m, h.comps[c].depth + gain) / 2 if quant.kind else 0.5)
                    v = v if style.wavelet != REVERSIBLE else np.rint(v).astype(np.int64)
                cells[y + place.y0 - b.y0 : y + place.y1 - b.y0, x + place.x0 - b.x0 : x + place.x1 - b.x0] = v
    return wavelet.synthesise2d(cells, [(r.x0, r.y0, r.x1, r.y1) for r in res], style.wavelet)


def decode_tile(h: Header, tile: int, max_layers: int = 0, reduce: int = 0) -> tuple[list[tuple[int, int, np.ndarray]], list[str]]:
    """(x, y, samples) of each component on its own grid, and what was wrong."""
    comps = [structure.component(h, tile, c) for c in range(len(h.comps))]
    problems = []
    if max_layers:
        # All packets are read, but only the first layers' passes are kept.
        kept: dict[int, int] = {}
        coding = h.coding_of(tile)
        problem = _read_layers(h, tile, comps, min(max_layers, coding.layers), kept)
    else:
        problem = read_packets(h, tile, comps)
    if problem:
        problems.append(f"tile {tile}: {problem}")
    planes = [decode_component(h, tile, c, res, reduce, problems) for c, res in enumerate(comps)]
    reversible = h.style_of(tile, 0).wavelet == REVERSIBLE
    if h.coding_of(tile).mct and len(planes) >= 3 and len({p.shape for p in planes[:3]}) == 1:
        planes = colour_back(planes, reversible)
    out = []
    for c, (p, res) in enumerate(zip(planes, comps, strict=True)):
        k, level = h.comps[c], res[max(0, len(res) - 1 - reduce)]
        p = np.rint(p).astype(np.int64) + (0 if k.signed else 1 << k.depth - 1)
        low = -(1 << k.depth - 1) if k.signed else 0
        out.append((level.x0, level.y0, np.clip(p, low, low + (1 << k.depth) - 1)))
    return out, problems


def _read_layers(h: Header, tile: int, comps, layers: int, kept: dict[int, int]) -> str | None:
    """Reads all packets, then drops the passes that later layers brought."""
    coding, parts = h.coding_of(tile), [p for p in h.parts if p.tile == tile]
    data = b"".join(p.data for p in parts)
    packed = b"".join(p.packed for p in parts) or b"".join(b for _, b in sorted(h.ppt.get(tile, []), key=lambda x: x[0])) or None
    at = head = 0
    problem = None
    changes = h.tiles[tile].poc if tile in h.tiles and h.tiles[tile].poc else h.main.poc
    blocks = lambda p: [b for cs in p.cells for b in cs.blocks]
    early: dict[int, tuple[int, list]] = {}
    every = []
    try:
        for layer, _, c, p in structure.packet_order(comps, coding.layers, coding.order, changes):
            if at >= len(data) and packed is None:
                break
            at, head = tier2.decode(data, at, p, layer, h.style_of(tile, c).flags, packed, head)
            for b in blocks(p):
                if layer < layers:
                    early[id(b)] = (b.passes, [list(w) for w in b.words])
                every.append(b)
    except (OutOfBits, ValueError, IndexError) as error:
        problem = str(error)
    for b in every:
        b.passes, b.words = early.get(id(b), (0, []))
    return problem


def compose(h: Header, tiles: dict[int, list[tuple[int, int, np.ndarray]]], reduce: int = 0) -> list[np.ndarray]:
    """Puts the tiles' samples into whole planes."""
    out = []
    for c, k in enumerate(h.comps):
        scale = lambda v, d: structure.up(structure.up(v, d), 1 << reduce)
        x0, y0, x1, y1 = scale(h.x, k.dx), scale(h.y, k.dy), scale(h.width, k.dx), scale(h.height, k.dy)
        plane = np.zeros((y1 - y0, x1 - x0), np.int64)
        for parts in tiles.values():
            x, y, p = parts[c]
            at = plane[max(0, y - y0) : y - y0 + p.shape[0], max(0, x - x0) : x - x0 + p.shape[1]]
            at[:] = p[: at.shape[0], : at.shape[1]]
        out.append(plane)
    return out


def decode(data: bytes, max_layers: int = 0, reduce: int = 0) -> Image:
    """Planes as they stand in the codestream; palette and channel order are applied by ``shown``."""
    meta, stream = boxes.unwrap(data)
    if stream is None:
        raise markers.BadStream("neither a codestream nor its container")
    h = markers.parse(stream)
    if not h.main.cod or not h.main.qcd:
        raise markers.BadStream("no coding style or quantisation")
    reduce = max(0, min(reduce, min(h.style_of(0, c).levels for c in range(len(h.comps)))))
    max_layers = 0 if max_layers <= 0 or max_layers >= h.main.layers else max_layers
    tiles, problems = {}, list(h.problems)
    for tile in sorted({p.tile for p in h.parts if p.tile < h.across * h.down}):
        tiles[tile], wrong = decode_tile(h, tile, max_layers, reduce)
        problems += wrong
    return Image(h, meta, compose(h, tiles, reduce), [(k.depth, k.signed) for k in h.comps], problems)


# --- showing ----------------------------------------------------------------------------------


def upsample(plane: np.ndarray, height: int, width: int, dx: int, dy: int) -> np.ndarray:
    """The nearest sample to the left and above, on the whole grid."""
    y, x = np.minimum(np.arange(height) // dy, plane.shape[0] - 1), np.minimum(np.arange(width) // dx, plane.shape[1] - 1)
    return plane[y[:, None], x[None, :]]


def with_palette(image: Image) -> Image:
    """Maps components through the container's palette, where it has one."""
    m = image.meta
    if not m or not m.palette or not m.mapping:
        return image
    table = np.array(m.palette, np.int64)
    planes, depths = [], []
    for comp, kind, column in m.mapping:
        p, depth = image.planes[comp], image.depths[comp]
        if kind == 1:
            p, depth = table[np.clip(p, 0, len(table) - 1), column], m.palette_depths[column]
        planes.append(p)
        depths.append(depth)
    return Image(image.header, m, planes, depths, image.problems)


def in_order(image: Image) -> Image:
    """Channels where their associations say; the number of planes follows."""
    if not image.meta or not image.meta.needs_reorder():
        return image
    take = [c for c in image.meta.order(len(image.planes)) if c < len(image.planes)]
    return Image(image.header, image.meta, [image.planes[c] for c in take], [image.depths[c] for c in take], image.problems)


def shown(image: Image, upsampled: bool = True) -> np.ndarray:
    """Height x width x 4 bytes: palette and order applied, colour as the container says, eight bits."""
    image = in_order(with_palette(image))
    h, planes = image.header, image.planes
    high, wide = planes[0].shape
    comps = h.comps if len(h.comps) == len(planes) else [Component(8)] * len(planes)
    if upsampled and any(p.shape != planes[0].shape for p in planes):
        high, wide = max(p.shape[0] for p in planes), max(p.shape[1] for p in planes)
        planes = [upsample(p, high, wide, max(1, k.dx), max(1, k.dy)) for p, k in zip(planes, comps, strict=True)]
    levels = []
    for p, (depth, signed) in zip(planes, image.depths, strict=True):
        v, top = p + (1 << depth - 1 if signed else 0), (1 << depth) - 1
        levels.append(np.clip(v if depth == 8 else (v * 255 + top // 2) // top, 0, 255))
    if image.meta and image.meta.is_ycc() and not h.main.mct and len(levels) >= 3:
        y, cb, cr = levels[0].astype(float), levels[1] - 128.0, levels[2] - 128.0
        levels = [np.clip(np.floor(v + 0.5), 0, 255).astype(np.int64) for v in colour_back([y, cb, cr], False)]
    colours = levels[:3] if len(levels) >= 3 else [levels[0]] * 3
    return np.stack([*colours, np.full((high, wide), 255)], -1).astype(np.uint8)


def config(data: bytes) -> dict:
    """The header only: sizes of the first component and whether it is grey."""
    meta, stream = boxes.unwrap(data)
    if stream is None:
        raise markers.BadStream("neither a codestream nor its container")
    h = markers.parse(stream)
    k = h.comps[0]
    wide, high = structure.up(h.width, k.dx) - structure.up(h.x, k.dx), structure.up(h.height, k.dy) - structure.up(h.y, k.dy)
    return {"width": wide, "height": high, "comps": len(h.comps), "model": "gray" if len(h.comps) == 1 else "rgba", "container": meta is not None, "layers": h.main.layers, "tiles": h.across * h.down}
