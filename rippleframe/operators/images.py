"""Images as tables: headers, tiles, blocks and samples of coded images, and coded images from samples.

Files are rows (image_id, content). Decoding cuts each file into its tiles, deals the tiles out and decodes
each in an Arrow batch; so a large image is as parallel as it has tiles. A broken file or tile gives a row with
its problem and never fails the job. Encoding takes one image, or one tile of it, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import boxes, codec, markers, structure, tier1


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the path) and content of all files below a path, through Spark's own reader."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("image_id"), "content")


def sniff(content: Column) -> Column:
    """j2c, jp2 or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FF4FFF51"), "j2c").when(head == boxes.MAGIC.hex().upper(), "jp2")


def be(content: Column, at: Column, size: int) -> Column:
    """An unsigned big-endian number; at is from 1. Null past the end."""
    part = F.hex(F.substring(content, at, F.lit(size)))
    return F.when(F.length(part) == 2 * size, F.conv(part, 16, 10).cast("decimal(20,0)").cast("long"))


_HEADER = """image_id string, container string, width int, height int, x_off int, y_off int, tile_w int, tile_h int, tile_x_off int, tile_y_off int, layers int, progression int, mct int,
sop boolean, eph boolean, levels int, cb_w int, cb_h int, cb_style int, wavelet string, quant_style int, guard_bits int, tiles_x int, tiles_y int,
components array<struct<comp:int,bit_depth:int,signed:boolean,dx:int,dy:int,levels:int,cb_style:int,width:int,height:int>>,
steps array<struct<comp:int,band:int,exponent:int,mantissa:int>>, precincts array<struct<res:int,ppx:int,ppy:int>>,
tile_parts array<struct<tile:int,part:int,length:long,bytes:long>>, poc array<struct<tile:int,rs:int,cs:int,lye:int,re:int,ce:int,order:int>>,
tlm array<struct<tile:int,length:long>>, roi array<struct<tile:int,comp:int,shift:int>>, comments array<binary>, problem string"""


def _header_row(name: str, data: bytes) -> dict:
    row: dict = {"image_id": name, "container": boxes.sniff(data)}
    try:
        _, stream = boxes.unwrap(data)
        if stream is None:
            raise markers.BadStream("neither a codestream nor its container")
        h = markers.parse(stream)
        m = h.main
        if not m.cod or not m.qcd:
            raise markers.BadStream("no coding style or quantisation")
    except markers.BadStream as error:
        return row | {"problem": str(error)}
    every = [(None, m), *h.tiles.items()]
    comps = [
        {"comp": c, "bit_depth": k.depth, "signed": k.signed, "dx": k.dx, "dy": k.dy, "levels": h.style_of(-1, c).levels, "cb_style": h.style_of(-1, c).flags,
         "width": structure.up(h.width, k.dx) - structure.up(h.x, k.dx), "height": structure.up(h.height, k.dy) - structure.up(h.y, k.dy)}
        for c, k in enumerate(h.comps)
    ]
    return row | {
        "width": h.width - h.x, "height": h.height - h.y, "x_off": h.x, "y_off": h.y, "tile_w": h.tile_w, "tile_h": h.tile_h, "tile_x_off": h.tile_x, "tile_y_off": h.tile_y,
        "layers": m.layers, "progression": m.order, "mct": m.mct, "sop": m.sop, "eph": m.eph, "levels": m.cod.levels, "cb_w": 1 << m.cod.block_w, "cb_h": 1 << m.cod.block_h, "cb_style": m.cod.flags,
        "wavelet": "5/3" if m.cod.wavelet == markers.REVERSIBLE else "9/7", "quant_style": m.qcd.kind, "guard_bits": m.qcd.guard, "tiles_x": h.across, "tiles_y": h.down, "components": comps,
        "steps": [{"comp": c, "band": b, "exponent": q.step(b)[0], "mantissa": q.step(b)[1]} for c, q in [(None, m.qcd), *m.qcc.items()] for b in range(3 * m.cod.levels + 1)],
        "precincts": [{"res": r, "ppx": m.cod.precinct(r)[0], "ppy": m.cod.precinct(r)[1]} for r in range(m.cod.levels + 1)],
        "tile_parts": [{"tile": p.tile, "part": p.part, "length": p.length, "bytes": len(p.data)} for p in h.parts],
        "poc": [{"tile": t, "rs": p.res0, "cs": p.comp0, "lye": p.layer1, "re": p.res1, "ce": p.comp1, "order": p.order} for t, c in every for p in c.poc],
        "tlm": [{"tile": t, "length": n} for t, n in h.tlm], "roi": [{"tile": t, "comp": c, "shift": s} for t, k in every for c, s in k.roi.items()],
        "comments": h.comments, "problem": "; ".join(h.problems) or None,
    }


def _rows(schema: str):
    """An Arrow function from a function of one file (name, bytes) to rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def wrap(one):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, data in zip(b.column("image_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                    rows = one(name, data or b"")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        arrow = to_arrow_schema(_parse_datatype_string(schema))
        return run

    return wrap


def _named(files: DataFrame) -> DataFrame:
    return files.select(F.col("image_id").cast("string").alias("image_id"), "content")


def headers(files: DataFrame) -> DataFrame:
    """One row per file with its header; tables of components, steps, tile-parts and the like are its arrays."""
    return _named(files).mapInArrow(_rows(_HEADER)(lambda n, d: [_header_row(n, d)]), _HEADER)


def segments(files: DataFrame) -> DataFrame:
    """image_id, ord, offset, marker, name, length of all header segments."""
    schema = "image_id string, ord int, offset long, marker int, name string, length long"

    def one(name: str, data: bytes) -> list[dict]:
        _, stream = boxes.unwrap(data)
        try:
            found = markers.walk(stream or b"")
        except markers.BadStream:
            return []
        return [{"image_id": name, "ord": i, "offset": at, "marker": code, "name": markers.NAMES.get(code), "length": n} for i, (at, code, n) in enumerate(found)]

    return _named(files).mapInArrow(_rows(schema)(one), schema)


def box_rows(files: DataFrame) -> DataFrame:
    """image_id, ord, parent, kind, offset, length, payload of a container's boxes and of its header box's."""
    schema = "image_id string, ord int, parent string, kind string, offset long, length long, payload binary"

    def one(name: str, data: bytes) -> list[dict]:
        out = []
        for at, kind, head, size in boxes.walk(data) if boxes.sniff(data) == "jp2" else []:
            out.append((None, kind, at, size, None if kind == "jp2c" else data[at + head : at + size]))
            if kind == "jp2h":
                out += [(kind, k, a, n, data[a + hd : a + n]) for a, k, hd, n in boxes.walk(data, at + head, at + size)]
        return [{"image_id": name, "ord": i, "parent": p, "kind": k, "offset": a, "length": n, "payload": b} for i, (p, k, a, n, b) in enumerate(out)]

    return _named(files).mapInArrow(_rows(schema)(one), schema)


_TILES = "image_id string, tile int, stream binary, problem string"
_PLANES = "image_id string, tile int, comp int, x int, y int, width int, height int, data array<int>, problem string"


def tiles(files: DataFrame) -> DataFrame:
    """One row per tile, with a codestream of its own."""

    def one(name: str, data: bytes) -> list[dict]:
        try:
            _, stream = boxes.unwrap(data)
            if stream is None:
                raise markers.BadStream("neither a codestream nor its container")
            h = markers.parse(stream)
            if not h.main.cod or not h.main.qcd:
                raise markers.BadStream("no coding style or quantisation")
        except markers.BadStream as error:
            return [{"image_id": name, "problem": str(error)}]
        return [{"image_id": name, "tile": t, "stream": markers.only_tile(stream, h, t)} for t in sorted({p.tile for p in h.parts if p.tile < h.across * h.down})]

    return _named(files).mapInArrow(_rows(_TILES)(one), _TILES)


def planes(files: DataFrame, max_layers: int = 0, reduce: int = 0, parts: int | None = None) -> DataFrame:
    """A row per tile and component: its place and samples, row by row. parts: tasks that tiles are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                base = {"image_id": r["image_id"], "tile": r["tile"], "problem": r["problem"]}
                rows = [base]
                if r["stream"] is not None:
                    try:
                        h = markers.parse(r["stream"])
                        less = max(0, min(reduce, min(h.style_of(r["tile"], c).levels for c in range(len(h.comps)))))
                        most = 0 if max_layers >= h.coding_of(r["tile"]).layers else max(0, max_layers)
                        got, problems = codec.decode_tile(h, r["tile"], most, less)
                        said = "; ".join(problems) or None
                        rows = [base | {"comp": c, "x": x, "y": y, "width": p.shape[1], "height": p.shape[0], "data": p.ravel().tolist(), "problem": said} for c, (x, y, p) in enumerate(got)]
                    except (ValueError, IndexError) as error:
                        rows = [base | {"problem": str(error)}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_PLANES))
    rows = tiles(files)
    rows = rows.repartition(parts, "image_id", "tile") if parts else rows.repartition("image_id", "tile")
    return rows.mapInArrow(run, _PLANES)


def samples(rows: DataFrame) -> DataFrame:
    """image_id, comp, y, x, v of planes; x and y on the component's own grid."""
    long = rows.where("data is not null").select("image_id", "comp", "x", "y", "width", F.posexplode("data").alias("i", "v"))
    return long.select("image_id", "comp", (F.col("y") + F.call_function("div", F.col("i"), F.col("width"))).cast("int").alias("y"), (F.col("x") + F.pmod("i", "width")).alias("x"), "v")


def dense(long: DataFrame) -> DataFrame:
    """image_id, comp, width, height, data of samples whose first row and column are 0."""
    cell = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    out = long.groupBy("image_id", "comp").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), cell.alias("cells"))
    return out.select("image_id", "comp", "width", "height", F.transform("cells", lambda c: c["v"]).alias("data"))


def encode(rows: DataFrame, options: codec.Options | None = None) -> DataFrame:
    """image_id, content of dense planes (image_id, comp, width, height, data)."""
    o = options or codec.Options()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("comp")
        made = [np.array(r.data, np.int64).reshape(r.height, r.width) for r in frame.itertuples(index=False)]
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "content": [codec.encode(made, o)]})

    kind = dict(rows.dtypes)["image_id"]
    return rows.groupBy("image_id").applyInPandas(run, f"image_id {kind}, content binary")


def shown(files: DataFrame, max_layers: int = 0, reduce: int = 0) -> DataFrame:
    """image_id, width, height, rgba (bytes): palette, channel order and colour applied; or the problem."""
    schema = "image_id string, width int, height int, rgba binary, problem string"

    def one(name: str, data: bytes) -> list[dict]:
        try:
            image = codec.decode(data, max_layers, reduce)
            out = codec.shown(image)
        except (ValueError, IndexError) as error:
            return [{"image_id": name, "problem": str(error)}]
        return [{"image_id": name, "width": out.shape[1], "height": out.shape[0], "rgba": out.tobytes(), "problem": "; ".join(image.problems) or None}]

    return _named(files).mapInArrow(_rows(schema)(one), schema)


def encode_blocks(rows: DataFrame, style: int = 0) -> DataFrame:
    """Adds planes, passes, ends (bytes by each pass) and coded to blocks (id, width, height, kind, data)."""
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, width int, height int, kind int, planes int, passes int, ends array<int>, gains array<double>, coded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [tier1.encode(d, w, h, k, style) for d, w, h, k in zip(*(b.column(c).to_pylist() for c in ("data", "width", "height", "kind")), strict=True)]
            more = [pa.array([c.planes for c in out], pa.int32()), pa.array([tier1.passes_of(c.planes) for c in out], pa.int32()), pa.array([c.ends for c in out], pa.list_(pa.int32()))]
            more += [pa.array([c.gains for c in out], pa.list_(pa.float64())), pa.array([c.data for c in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "width", "height", "kind")] + more, ["id", "width", "height", "kind", "planes", "passes", "ends", "gains", "coded"])

    return rows.select("id", F.col("width").cast("int"), F.col("height").cast("int"), F.col("kind").cast("int"), F.col("data").cast("array<int>")).mapInArrow(run, schema)


def decode_blocks(rows: DataFrame, style: int = 0) -> DataFrame:
    """id and doubled coefficients (twice the value and its middle) of coded blocks."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, k, planes_, passes, ends, coded in zip(*(b.column(c).to_pylist() for c in ("width", "height", "kind", "planes", "passes", "ends", "coded")), strict=True):
                words, at, start = [], 0, 0
                for n in tier1.segments(0, passes, style):
                    at += n
                    words.append((n, coded[start : ends[at - 1]]))
                    start = ends[at - 1]
                out.append(tier1.decode(words, planes_, w, h, k, style))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int32()))], ["id", "doubled"])

    return rows.mapInArrow(run, f"id {kind}, doubled array<int>")
