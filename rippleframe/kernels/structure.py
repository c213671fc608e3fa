"""Tiles, resolutions, bands, precincts and blocks of a codestream, and the order of its packets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from ..operators.order import KEYS
from . import tier1
from .markers import ORDERS, Header, Progression
from .tagtree import TagTree


def up(a: int, b: int) -> int:
    return -(-a // b)


@dataclass
class BlockPlace:
    """A block within its band (x0.. are the band's own coordinates), and what packets have told of it."""

    x0: int
    y0: int
    x1: int
    y1: int
    included: bool = False
    missing: int = 0  # planes that are all zero
    length_bits: int = 3
    passes: int = 0
    words: list[list] = field(default_factory=list)  # [passes, bytes], the last perhaps still open
    coded: tier1.Coded | None = None
    upto: list[int] = field(default_factory=list)  # passes by the end of each layer


@dataclass
class Cells:
    """A band's blocks in a precinct, row by row, with its two tag trees."""

    band: int
    across: int
    blocks: list[BlockPlace]
    inclusion: TagTree
    planes: TagTree


@dataclass
class Band:
    kind: int
    index: int  # 0 LL, then three for each resolution
    x0: int
    y0: int
    x1: int
    y1: int


@dataclass
class Precinct:
    px: int
    py: int
    ref_x: int
    ref_y: int
    cells: list[Cells]


@dataclass
class Resolution:
    x0: int
    y0: int
    x1: int
    y1: int
    bands: list[Band]
    precincts: list[Precinct]


def tile_rect(h: Header, tile: int) -> tuple[int, int, int, int]:
    p, q = tile % h.across, tile // h.across
    x0, y0 = max(h.tile_x + p * h.tile_w, h.x), max(h.tile_y + q * h.tile_h, h.y)
    return x0, y0, min(h.tile_x + (p + 1) * h.tile_w, h.width), min(h.tile_y + (q + 1) * h.tile_h, h.height)


def band_rect(rect: tuple[int, int, int, int], depth: int, kind: int) -> tuple[int, int, int, int]:
    """A band after depth levels; kind 0 LL, 1 HL, 2 LH, 3 HH."""
    size = 1 << depth
    dx, dy = (size >> 1) * (kind & 1), (size >> 1) * (kind >> 1)
    return up(rect[0] - dx, size), up(rect[1] - dy, size), up(rect[2] - dx, size), up(rect[3] - dy, size)


def component(h: Header, tile: int, comp: int) -> list[Resolution]:
    """The resolutions of a tile's component, from the coarsest on."""
    style, c, whole = h.style_of(tile, comp), h.comps[comp], tile_rect(h, tile)
    rect = up(whole[0], c.dx), up(whole[1], c.dy), up(whole[2], c.dx), up(whole[3], c.dy)
    out = []
    for res in range(style.levels + 1):
        below = style.levels - res
        x0, y0, x1, y1 = band_rect(rect, below, 0)
        kinds = (0,) if res == 0 else (1, 2, 3)
        depth = below if res == 0 else below + 1
        bands = [Band(k, 0 if res == 0 else 3 * res - 3 + k, *band_rect(rect, depth, k)) for k in kinds]
        out.append(Resolution(x0, y0, x1, y1, bands, _precincts(style, res, below, (x0, y0, x1, y1), bands, whole, c)))
    return out


def _precincts(style, res, below, area, bands, whole, c) -> list[Precinct]:
    ppx, ppy = style.precinct(res)
    x0, y0, x1, y1 = area
    if x1 <= x0 or y1 <= y0:
        return []
    less = 0 if res == 0 else 1  # bands are half as wide as their resolution
    cw, ch = min(style.block_w, ppx - less), min(style.block_h, ppy - less)
    out = []
    for py in range(y0 >> ppy, up(y1, 1 << ppy)):
        for px in range(x0 >> ppx, up(x1, 1 << ppx)):
            cells = []
            for b in bands:
                left, top = max(b.x0, px << ppx - less), max(b.y0, py << ppy - less)
                right, low = min(b.x1, px + 1 << ppx - less), min(b.y1, py + 1 << ppy - less)
                blocks, across, down = [], 0, 0
                if right > left and low > top:
                    across, down = up(right, 1 << cw) - (left >> cw), up(low, 1 << ch) - (top >> ch)
                    for by in range(top >> ch, up(low, 1 << ch)):
                        for bx in range(left >> cw, up(right, 1 << cw)):
                            blocks.append(BlockPlace(max(left, bx << cw), max(top, by << ch), min(right, bx + 1 << cw), min(low, by + 1 << ch)))
                cells.append(Cells(b.index, across, blocks, TagTree(across, down), TagTree(across, down)))
            ref_x, ref_y = max(whole[0], (px << ppx + below) * c.dx), max(whole[1], (py << ppy + below) * c.dy)
            out.append(Precinct(px, py, ref_x, ref_y, cells))
    return out


def packet_order(comps: list[list[Resolution]], layers: int, order: int, changes: list[Progression] | None = None) -> Iterator[tuple[int, int, int, Precinct]]:
    """(layer, resolution, component, precinct) of a tile; with changes, each range in turn without what came before."""
    every = [{"res": r, "comp": c, "py": p.py, "px": p.px, "ref_y": p.ref_y, "ref_x": p.ref_x, "at": p} for c, rs in enumerate(comps) for r, res in enumerate(rs) for p in res.precincts]
    last = max((len(rs) for rs in comps), default=0)
    done: set[tuple] = set()
    for change in changes or [Progression(0, 0, layers, last, len(comps), order)]:
        some = [
            e | {"layer": n}
            for e in every
            if change.res0 <= e["res"] < change.res1 and change.comp0 <= e["comp"] < (change.comp1 or 256)
            for n in range(min(layers, change.layer1))
        ]
        # Within a place, a component's precincts come row by row.
        keys = (*KEYS[ORDERS[change.order]], "py", "px")
        for e in sorted(some, key=lambda e: [e[k] for k in keys]):
            name = (e["layer"], e["res"], e["comp"], e["py"], e["px"])
            if name not in done:
                done.add(name)
                yield e["layer"], e["res"], e["comp"], e["at"]
