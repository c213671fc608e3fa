"""Round trips through the bit-serial kernels and the whole codec; each gives its mismatches by unit."""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.kernels import boxes, lanes, mq, structure, tagtree, tier1, tier2
from rippleframe.kernels.codec import Options
from rippleframe.operators import images, metrics

from .catalogue import emb_grid, emb_row, query, table


def _each(df: DataFrame, key: str, value: str, wrong) -> DataFrame:
    """key, mismatches by a function of one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wrong(v) for v in b.column(1).to_pylist()], pa.int64())], [key, "mismatches"])

    return df.select(key, value).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, mismatches long")


#: The contexts of three bytes: bit i of byte k has i + k % 3.
_THREE = [i + k for k in range(3) for i in range(7, -1, -1)]


#: Bytes of text that a task's coders take together.
TOGETHER = 48 << 20


def _unlike(data: bytes, back: bytes) -> int:
    """Bits of two words of one length that differ."""
    return 0 if data == back else int(np.unpackbits(np.frombuffer(data, np.uint8) ^ np.frombuffer(back, np.uint8)).sum())


def raw_mismatches(data: bytes) -> int:
    r, bits = mq.RawEncoder(), np.unpackbits(np.frombuffer(data, np.uint8)).tobytes()
    r.write(bits)
    back = mq.RawDecoder(r.finish()).read(len(bits))
    return 0 if bits == back else sum(map(ne, bits, back))


def coder_mismatches(words: list[bytes]) -> list[int]:
    """Bits of each word that come back otherwise: bit i of each byte in context i, and in raw form."""
    back = lanes.decode(lanes.encode(words, _THREE), [len(w) for w in words], _THREE)
    return [_unlike(w, b) + raw_mismatches(w) for w, b in zip(words, back, strict=True)]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """coder_mismatches of rows' words, in parts of TOGETHER bytes and the row that goes beyond."""
    keys, words, size = [], [], 0

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(coder_mismatches(words), pa.int64())], [name, "mismatches"])

    for b in batches:
        name, lo = b.schema.names[0], 0
        for n, word in enumerate(b.column(1).to_pylist(), 1):
            words.append(word)
            size += len(word)
            if size >= TOGETHER or n == b.num_rows:
                keys.append(b.column(0).slice(lo, n - lo))
                lo = n
            if size >= TOGETHER:
                yield part()
                keys, words, size = [], [], 0
    if words:
        yield part()


@query("select doc_id, cast(0 as bigint) as mismatches from documents")
def mq_roundtrip(spark, sf):
    """Texts are dealt over all cores, a file of them may be one task; few tasks, as coders run faster over many texts together."""
    t = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    return t.repartition(3 * spark.sparkContext.defaultParallelism).mapInArrow(_coded, f"doc_id {dict(t.dtypes)['doc_id']}, mismatches long")


def _blocks(spark, sf) -> DataFrame:
    t = emb_row(spark, sf).groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("data"))
    return t.select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), (F.col("label") % 4).alias("kind"), "data")


@query("select vec_id, style, cast(0 as bigint) as mismatches from embeddings, (select unnest([0, 1, 4, 42]) as style)")
def tier1_roundtrip(spark, sf):
    """Blocks coded plainly, with bypass, with a codeword for each pass, and with reset, causal contexts and segment symbols."""
    out, blocks = None, _blocks(spark, sf)
    for style in (0, 1, 4, 42):
        back = images.decode_blocks(images.encode_blocks(blocks, style), style)
        both = blocks.select("id", "data").join(back, "id", "left")
        # Twice the value and its middle: a half towards zero is the value.
        got = F.transform("doubled", lambda v: F.call_function("div", v, F.lit(2)).cast("int"))
        wrong = F.size(F.filter(F.arrays_zip(F.col("data").alias("a"), got.alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"])))
        one = both.select(F.col("id").alias("vec_id"), F.lit(style).alias("style"), wrong.cast("long").alias("mismatches"))
        out = one if out is None else out.unionByName(one)
    return out


def packet_mismatches(rows: list[dict], layers: int = 3) -> int:
    """Blocks in a row of a precinct, their passes dealt over layers, through packets with markers around them."""

    def precinct() -> structure.Precinct:
        places = [structure.BlockPlace(8 * k, 0, 8 * k + 8, 8) for k in range(len(rows))]
        n = len(places)
        return structure.Precinct(0, 0, 0, 0, [structure.Cells(0, n, places, tagtree.TagTree(n, 1), tagtree.TagTree(n, 1))])

    one, two, most = precinct(), precinct(), 12
    for r, b in zip(rows, one.cells[0].blocks, strict=True):
        b.coded = tier1.encode(r["data"], 8, 8, r["kind"])
        total = tier1.passes_of(b.coded.planes)
        b.upto = [total * (n + 1) // layers if r["kind"] else total for n in range(layers)]
    tier2.prepare(one, {0: most}, layers)
    data, at = b"".join(tier2.encode(one, n, 0, n, True, True) for n in range(layers)), 0
    for n in range(layers):
        at, _ = tier2.decode(data, at, two, n, 0)
    wrong = int(at != len(data))
    for r, b in zip(rows, two.cells[0].blocks, strict=True):
        got = tier1.decode([(n, bytes(w)) for n, w in b.words], most - b.missing, 8, 8, r["kind"]) if b.words else [0] * 64
        wrong += sum((abs(g) >> 1) * (-1 if g < 0 else 1) != v for g, v in zip(got, r["data"], strict=True))
    return wrong


@query("select vec_id // 25 as tile, cast(0 as bigint) as mismatches from embeddings group by 1")
def packet_roundtrip(spark, sf):
    t = _blocks(spark, sf).groupBy(F.call_function("div", F.col("id"), F.lit(25)).alias("tile")).agg(F.collect_list(F.struct("kind", "data")).alias("blocks"))
    return _each(t, "tile", "blocks", packet_mismatches)


def _through(long: DataFrame, o: Options) -> DataFrame:
    """image_id, a (the sample) and b (the decoded one) of images given as samples."""
    files = images.encode(images.dense(long), o)
    back = images.samples(images.planes(files)).select(F.col("image_id").cast("long").alias("image_id"), "comp", "y", "x", F.col("v").alias("b"))
    return long.select("image_id", "comp", "y", "x", F.col("v").alias("a")).join(back, ["image_id", "comp", "y", "x"], "full")


@query("select vec_id as image_id, cast(0 as bigint) as mismatches from embeddings")
def codec_lossless(spark, sf):
    """8 x 8 images in tiles of 5 x 6 with two levels, from an odd origin."""
    t = emb_grid(spark, sf).select(F.col("vec_id").alias("image_id"), F.lit(0).alias("comp"), "y", "x", "v")
    placed = Options(levels=2, signed=True, tile=(5, 6), block=(4, 4), order="rpcl", layers=2, sop=True, eph=True)
    return metrics.mismatches(_through(t, placed), "image_id", "a", "b")


def _pictures(spark, sf) -> DataFrame:
    """64 samples wide, a row for each vector, three components that differ."""
    t = emb_row(spark, sf).select(F.call_function("div", F.col("vec_id"), F.lit(64)).alias("image_id"), (F.col("vec_id") % 64).cast("int").alias("y"), F.col("i").cast("int").alias("x"), "v")
    comps = F.array(*[F.struct(F.lit(c).alias("comp"), F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int").alias("v")) for c, v in enumerate((F.col("v") + 128, 128 - F.col("v"), F.call_function("div", F.col("v"), F.lit(2)) + 100))])
    return t.select("image_id", "y", "x", F.explode(comps).alias("s")).select("image_id", "s.comp", "y", "x", "s.v")


@query("select vec_id // 64 as image_id, true as close from embeddings group by 1")
def codec_lossy(spark, sf):
    """Colour pictures by the irreversible path at quality 0.9: at least 20 dB each."""
    both = _through(_pictures(spark, sf), Options(lossless=False, quality=0.9, levels=3, block=(32, 32)))
    mse = F.avg(F.pow(F.col("a") - F.coalesce("b", F.lit(100_000)), F.lit(2)))
    return both.groupBy("image_id").agg((mse <= 65025 / 100).alias("close"))


def box_mismatches(content: bytes) -> int:
    meta, stream = boxes.unwrap(content)
    return int(meta is None or stream is None or boxes.unwrap(stream) != (None, stream) or meta.image[:3] != (8, 8, 1) or not meta.is_gray() or not content.endswith(stream))


@query("select vec_id as image_id, cast(0 as bigint) as mismatches from embeddings")
def box_roundtrip(spark, sf):
    t = emb_grid(spark, sf).select(F.col("vec_id").alias("image_id"), F.lit(0).alias("comp"), "y", "x", (F.col("v") + 128).alias("v"))
    return _each(images.encode(images.dense(t), Options(levels=1, container=True)), "image_id", "content", box_mismatches)


@query("select vec_id as image_id, 'jp2' as container, 8 as width, 8 as height, 1 as levels, '5/3' as wavelet, 1 as comps, 4 as bands, true as sound from embeddings")
def header_rows(spark, sf):
    """Headers of coded images as rows, and their first bytes as a format."""
    t = emb_grid(spark, sf).select(F.col("vec_id").alias("image_id"), F.lit(0).alias("comp"), "y", "x", (F.col("v") + 128).alias("v"))
    files = images.encode(images.dense(t), Options(levels=1, container=True)).withColumn("image_id", F.col("image_id").cast("string"))
    h = images.headers(files.where(images.sniff(F.col("content")) == "jp2"))
    return h.select(F.col("image_id").cast("long").alias("image_id"), "container", "width", "height", "levels", "wavelet", F.size("components").alias("comps"), F.size("steps").alias("bands"), F.col("problem").isNull().alias("sound"))


@query("select vec_id as image_id, cast(8 >> reduce as int) as side, reduce from embeddings, (select cast(unnest([0, 1, 2]) as int) as reduce)")
def codec_reduced(spark, sf):
    """Images decoded to fewer resolutions."""
    t = emb_grid(spark, sf).select(F.col("vec_id").alias("image_id"), F.lit(0).alias("comp"), "y", "x", (F.col("v") + 128).alias("v"))
    files, out = images.encode(images.dense(t), Options(levels=2)), None
    for reduce in (0, 1, 2):
        one = images.planes(files, reduce=reduce).where(F.size("data") == F.col("width") * F.col("height"))
        one = one.select(F.col("image_id").cast("long").alias("image_id"), F.col("width").alias("side"), F.lit(reduce).alias("reduce"))
        out = one if out is None else out.unionByName(one)
    return out
