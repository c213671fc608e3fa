"""Queries of geometry, rate control, look-ups and bytes beyond the first catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import color, quant
from rippleframe.operators import blocks, geometry, joins, lifting, order, rate

from .catalogue import EMB, GRID, LI, PACKETS, PASSES, PREC, RES, TILES, emb_grid, emb_row, ev_pass, gappy, img_dim, li_rgb, query, table, GAPS, _sql53

# --- quantisation -----------------------------------------------------------------------------


@query("""with q as (select distinct cast(round(l_discount * 100) as int) as tenths from lineitem), b as (select * from (values (0, 4, 0), (1, 3, 1), (2, 3, 2), (3, 3, 3), (4, 2, 1), (5, 2, 2), (6, 2, 3), (7, 1, 1), (8, 1, 2), (9, 1, 3)) t(band, level, kind))
select tenths, band, round(256.0::double * pow(10.0::double, -4 * (tenths / 10.0::double)) * case when kind = 0 then 0.25::double when kind = 3 then 4.0::double / pow(2.0::double, level - 1) else 2.0::double / pow(2.0::double, level - 1) end, 9) as step from q, b""")
def default_step_table(spark, sf):
    q = table(spark, sf, "lineitem").select(F.round(F.col("l_discount") * 100).cast("int").alias("tenths")).distinct()
    every = [(0, 4, 0)] + [(1 + 3 * (3 - level) + kind - 1, level, kind) for level in (3, 2, 1) for kind in (1, 2, 3)]
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(n).alias("level"), F.lit(k).alias("kind")) for b, n, k in every])
    t = q.select("tenths", F.explode(bands).alias("b")).select("tenths", "b.*")
    return t.select("tenths", "band", F.round(quant.default_step(F.col("tenths") / 10.0, F.col("level"), F.col("kind"), 3), 9).alias("step"))


@query("select p_partkey, cast(p_size % 32 as int) as eps, r as res, cast(p_size % 32 - greatest(r - 1, 0) as int) as exponent, cast([0, 1, 1, 2][p_size % 4 + 1] as int) as gain from part, (select cast(unnest(range(6)) as int) as r)")
def derived_steps(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_size") % 32).cast("int").alias("eps"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("res"))
    return t.select("p_partkey", "eps", "res", quant.derived(F.col("eps"), F.col("res")).alias("exponent"), quant.gain53(F.col("p_size") % 4).alias("gain"))


@query(f"with {EMB} select vec_id, i, round((2 * v + 1) * 0.3125::double / 2, 6) as v, cast(round_even((2 * v + 1) * 0.3125::double / 2, 0) as int) as whole from emb")
def dequant_step(spark, sf):
    v = F.col("v") * 2 + 1
    return emb_row(spark, sf).select("vec_id", "i", F.round(quant.dequantised(v, F.lit(0.3125)), 6).alias("v"), quant.dequantised_whole(v, F.lit(0.3125)).alias("whole"))


# --- colour -----------------------------------------------------------------------------------


@query(f"""with {LI}, c as (select r, g, b, r - 128 as x, g - 128 as y, b - 128 as z from li), w as (select r, g, b, greatest(0, least(255, r)) as red, greatest(0, least(255, g)) as green, greatest(0, least(255, b)) as blue,
greatest(0, least(255, (r * 255 + 2047) // 4095)) as deep, greatest(0, least(255, (r % 16 * 255 + 7) // 15)) as thin from c) select r, g, b, cast(red as int) as red, cast(green as int) as green, cast(blue as int) as blue, cast(deep as int) as deep, cast(thin as int) as thin, 255 as alpha from w""")
def rgba_rows(spark, sf):
    t = li_rgb(spark, sf)
    red, green, blue, alpha = color.rgba8([F.col(c) - 128 for c in "rgb"], [8, 8, 8])
    deep, thin = color.rgba8([F.col("r") - 2048], [12])[0], color.rgba8([F.col("r") % 16 - 8, F.col("g")], [4, 8])[1]
    return t.select("r", "g", "b", red.alias("red"), green.alias("green"), blue.alias("blue"), deep.alias("deep"), thin.alias("thin"), alpha.alias("alpha"))


@query(f"with {LI} select cast(greatest(0, least(255, floor((r - 128 + 128 + b * 1.402::double) * 1.0::double + 0.5::double))) as int) as red, cast(greatest(0, least(255, floor((r - 128 + 128 - g * 0.344136::double - b * 0.714136::double) + 0.5::double))) as int) as green, cast(greatest(0, least(255, floor((r - 128 + 128 + g * 1.772::double) + 0.5::double))) as int) as blue, 255 as alpha from li")
def rgba_float_rows(spark, sf):
    names = ("red", "green", "blue", "alpha")
    return li_rgb(spark, sf).select(*[c.alias(n) for c, n in zip(color.rgba8_float(F.col("r") - 128, F.col("g"), F.col("b")), names, strict=True)])


@query(f"with {LI}, f as (select r * 0.299::double + g * 0.587::double + b * 0.114::double as y, r * -0.16875::double + g * -0.33126::double + b * 0.5::double as cb, r * 0.5::double + g * -0.41869::double + b * -0.08131::double as cr from li) select cast(round(y) as int) as y, cast(round(cb) as int) as cb, cast(round(cr) as int) as cr from f")
def ict_whole(spark, sf):
    return li_rgb(spark, sf).select(*[c.alias(n) for c, n in zip(color.ict_rounded(F.col("r"), F.col("g"), F.col("b")), ("y", "cb", "cr"), strict=True)])


@query("""select n_nationkey, method, comps, mct, reversible, method = 1 and n_nationkey in (3, 4, 5, 18, 24, 9, 22, 23) as ycc, method = 1 and n_nationkey in (17, 1, 15) as gray, method = 1 and n_nationkey in (16, 20) as rgb,
mct or (method = 1 and n_nationkey in (3, 4, 5, 18, 24, 9, 22, 23) and comps >= 3) as transform,
(mct or (method = 1 and n_nationkey in (3, 4, 5, 18, 24, 9, 22, 23) and comps >= 3)) and (not reversible or (not mct and method = 1 and n_nationkey in (3, 4, 5, 18, 24, 9, 22, 23))) as ict
from nation, (select unnest([1, 2]) as method), (select unnest([1, 3]) as comps), (select unnest([true, false]) as mct), (select unnest([true, false]) as reversible)""")
def colour_predicates(spark, sf):
    t, space = table(spark, sf, "nation").select("n_nationkey"), F.col("n_nationkey")
    for name, values in (("method", (1, 2)), ("comps", (1, 3)), ("mct", (True, False)), ("reversible", (True, False))):
        t = t.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    ycc = color.is_ycc(F.col("method"), space)
    return t.select(
        "*", ycc.alias("ycc"), color.is_gray(F.col("method"), space).alias("gray"), color.is_rgb(F.col("method"), space).alias("rgb"),
        color.needs_transform(F.col("mct"), ycc, F.col("comps")).alias("transform"), color.uses_ict(F.col("mct"), ycc, F.col("comps"), F.col("reversible")).alias("ict"),
    )


# --- lifting ----------------------------------------------------------------------------------


@query("select vec_id, cast(0 as bigint) as mismatches from embeddings")
def dwt53_odd_origin(spark, sf):
    """1-D round trips of cut signals (1 to 64 samples) with odd origins."""
    t = emb_row(spark, sf).where((F.col("i") <= F.col("vec_id") % 64)).withColumn("was", F.col("v"))
    back = lifting.synthesise53(lifting.analyse53(t.withColumn("at", F.col("i")), ["vec_id"], "i", origin=1), ["vec_id"], "i", origin=1)
    return back.groupBy("vec_id").agg(F.count_if((F.col("v") != F.col("was")) | (F.col("i") != F.col("at"))).alias("mismatches"))


@query("select vec_id, cast(0 as bigint) as mismatches from embeddings")
def dwt53_2d_roundtrip(spark, sf):
    """Synthesis from explicit bounds: origin (3, 5), three levels."""
    t = emb_grid(spark, sf).withColumns({"was": F.col("v"), "ax": F.col("x"), "ay": F.col("y")})
    back = lifting.synthesise_2d(lifting.analyse_2d(t, "vec_id", 3, 8, 8, 3, 5), "vec_id", 3, 8, 8, 3, 5)
    return back.groupBy("vec_id").agg(F.count_if((F.col("v") != F.col("was")) | (F.col("x") != F.col("ax")) | (F.col("y") != F.col("ay"))).alias("mismatches"))


@query("select vec_id, true as close from embeddings")
def dwt97_2d_roundtrip(spark, sf):
    t = emb_grid(spark, sf).withColumns({"v": F.col("v").cast("double"), "was": F.col("v").cast("double"), "ax": F.col("x"), "ay": F.col("y")})
    back = lifting.synthesise_2d(lifting.analyse_2d(t, "vec_id", 3, 8, 8, 1, 2, "97"), "vec_id", 3, 8, 8, 1, 2, "97")
    close = (F.max(F.abs(F.col("v") - F.col("was"))) < 1e-9) & (F.max(F.abs(F.col("x") - F.col("ax")) + F.abs(F.col("y") - F.col("ay"))) == 0)
    return back.groupBy("vec_id").agg(close.alias("close"))


_ODD = f"""over (partition by vec_id order by i)"""


@query(f"""with {EMB}, d as (select *, case when i % 2 = 0 then v - ((coalesce(lag(v) {_ODD}, lead(v) {_ODD}) + coalesce(lead(v) {_ODD}, lag(v) {_ODD})) >> 1) else v end as h from emb),
s as (select *, case when i % 2 = 1 then h + ((coalesce(lag(h) {_ODD}, lead(h) {_ODD}) + coalesce(lead(h) {_ODD}, lag(h) {_ODD}) + 2) >> 2) else h end as w from d)
select vec_id, cast(case when i % 2 = 1 then i // 2 else 32 + i // 2 end as int) as i, w as v from s""")
def dwt53_odd_forward(spark, sf):
    return lifting.analyse53(emb_row(spark, sf), ["vec_id"], "i", origin=1).select("vec_id", "i", "v")


# --- geometry ---------------------------------------------------------------------------------

BANDS = f"""{RES.replace("select image_id, tile, x0, y0, res,", "select image_id, tile, x0, y0, x1, y1, res,")}, bk as (select *, cast(unnest(case when res = 0 then [0] else [1, 2, 3] end) as int) as band, levels - res + cast(res > 0 as int) as nb from res),
bands as (select *, (x0 - (case when band & 1 = 1 then (1 << nb) >> 1 else 0 end) + (1 << nb) - 1) >> nb as bx0, (y0 - (case when band >= 2 then (1 << nb) >> 1 else 0 end) + (1 << nb) - 1) >> nb as by0,
(x1 - (case when band & 1 = 1 then (1 << nb) >> 1 else 0 end) + (1 << nb) - 1) >> nb as bx1, (y1 - (case when band >= 2 then (1 << nb) >> 1 else 0 end) + (1 << nb) - 1) >> nb as by1 from bk)"""


def _bands(spark, sf, images=None):
    return geometry.bands(geometry.resolutions(geometry.tiles(img_dim(spark, sf) if images is None else images)))


def _dealt(spark, sf):
    """The images, dealt over all cores: their file is small, and each becomes some hundreds of rows."""
    images = img_dim(spark, sf)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return images.repartition(tasks, "image_id")


@query(f"with {BANDS} select image_id, tile, res, band, ['LL', 'HL', 'LH', 'HH'][band + 1] as name, cast(bx0 as int) as x0, cast(by0 as int) as y0, cast(bx1 - bx0 as int) as w, cast(by1 - by0 as int) as h from bands")
def subband_bounds(spark, sf):
    name = F.element_at(F.lit(["LL", "HL", "LH", "HH"]), F.col("band") + 1)
    return _bands(spark, sf).select("image_id", "tile", "res", "band", name.alias("name"), F.col("bx0").alias("x0"), F.col("by0").alias("y0"), (F.col("bx1") - F.col("bx0")).alias("w"), (F.col("by1") - F.col("by0")).alias("h"))


CELLS = f"{BANDS}, cells as (select *, least(4, ppx - cast(res > 0 as int)) as cw, least(4, ppy - cast(res > 0 as int)) as ch, cast(res > 0 as int) as less from bands)"


@query(f"""with {CELLS}, k as (select *, unnest(range(bx0 >> cw, ((bx1 - 1) >> cw) + 1)) as cbx from (select *, unnest(range(by0 >> ch, ((by1 - 1) >> ch) + 1)) as cby from cells where bx1 > bx0 and by1 > by0))
select image_id, tile, res, band, cast(cbx as int) as cbx, cast(cby as int) as cby, cast(greatest(bx0, cbx << cw) as int) as x0, cast(greatest(by0, cby << ch) as int) as y0, cast(least(bx1, (cbx + 1) << cw) as int) as x1, cast(least(by1, (cby + 1) << ch) as int) as y1 from k""")
def codeblock_grid(spark, sf):
    t = geometry.code_blocks(_bands(spark, sf, _dealt(spark, sf)))
    return t.select("image_id", "tile", "res", "band", "cbx", "cby", *[F.col(f"c{c}").cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""with {CELLS}, p as (select *, unnest(range(((trx1 + (1 << ppx) - 1) >> ppx) - (trx0 >> ppx))) as px from (select *, unnest(range(((try1 + (1 << ppy) - 1) >> ppy) - (try0 >> ppy))) as py from cells where trx1 > trx0 and try1 > try0)),
r as (select *, greatest(bx0, ((trx0 >> ppx) + px) << (ppx - less)) as l, least(bx1, ((trx0 >> ppx) + px + 1) << (ppx - less)) as e, greatest(by0, ((try0 >> ppy) + py) << (ppy - less)) as t, least(by1, ((try0 >> ppy) + py + 1) << (ppy - less)) as f from p)
select image_id, tile, res, band, cast(px as int) as px, cast(py as int) as py, cast(l >> cw as int) as kx0, cast(case when e > l then (e + (1 << cw) - 1) >> cw else l >> cw end as int) as kx1, cast(t >> ch as int) as ky0, cast(case when f > t then (f + (1 << ch) - 1) >> ch else t >> ch end as int) as ky1 from r""")
def precinct_block_range(spark, sf):
    return geometry.precinct_blocks(_bands(spark, sf)).select("image_id", "tile", "res", "band", "px", "py", "kx0", "kx1", "ky0", "ky1")


@query(f"with {TILES} select image_id, tile, greatest(x0, 50) as x0, greatest(y0, 40) as y0, greatest(greatest(x0, 50), least(x1, 150)) as x1, greatest(greatest(y0, 40), least(y1, 120)) as y1 from tile")
def tile_window(spark, sf):
    """What a window of the image shares with each tile."""
    shared = geometry.rectangle(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.lit(v) for v in (50, 40, 150, 120)))
    return geometry.tiles(img_dim(spark, sf)).select("image_id", "tile", *[c.cast("int").alias(n) for c, n in zip(shared, ("x0", "y0", "x1", "y1"), strict=True)])


# --- blocks -----------------------------------------------------------------------------------


@query(f"""with {PASSES}, n as (select *, greatest(3, max(length(bin(bytes))) over (partition by block order by pass rows unbounded preceding)) as lblock from passes)
select block, pass, cast(lblock as int) as lblock, cast(lblock - coalesce(lag(lblock) over (partition by block order by pass), 3) + 1 as int) as told, cast(lblock as int) as bits from n""")
def length_bits(spark, sf):
    return blocks.length_bits(ev_pass(spark, sf), "block", "pass", "bytes", F.lit(1)).select("block", "pass", "lblock", "told", "bits")


@query("""select cast(n as int) as pass, cast(case when n < 10 then 0 else 1 + 2 * ((n - 10) // 3) + cast((n - 10) % 3 = 2 as int) end as int) as segment, n >= 10 and (n - 10) % 3 < 2 as raw, cast(n as int) as ended
from (select unnest(range(40)) as n)""")
def bypass_segments(spark, sf):
    n = F.col("id").cast("int")
    joint, raw = blocks.segment_of(n, F.lit(False))
    return spark.range(40).select(n.alias("pass"), joint.alias("segment"), raw.alias("raw"), blocks.segment_of(n, F.lit(True))[0].alias("ended"))


@query("""select p_partkey, s & 1 <> 0 as bypass, s & 2 <> 0 as reset, s & 4 <> 0 as terminate, s & 8 <> 0 as causal, s & 16 <> 0 as predictable, s & 32 <> 0 as segment, s & 1 <> 0 and k <> 2 and plane <= planes - 5 as raw
from (select p_partkey, cast(p_partkey % 64 as int) as s, p_size % 3 as k, p_size % 12 as plane, 12 as planes from part)""")
def style_flags(spark, sf):
    style, size = (F.col("p_partkey") % 64).cast("int"), F.col("p_size")
    flags = blocks.style_flags(style)
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in flags.items()], blocks.raw_mode(style, size % 3, size % 12, F.lit(12)).alias("raw"))


@query(f"with {PASSES} select block, pass, not (pass between 1 and 50 and bytes * 5000 <= 100000 and pass % 20 <= 16 and pass % 40 <= 32) as quarantine from passes")
def corruption_guards(spark, sf):
    p = F.col("pass")
    return ev_pass(spark, sf).select("block", "pass", (~blocks.sound(p, F.col("bytes") * 5000, p % 20, p % 40)).alias("quarantine"))


@query(f"with {EMB} select vec_id, i, cast(case when abs(v) <= 1 then 0 else length(bin(abs(v))) - 1 end as int) as power from emb")
def ilog2(spark, sf):
    return emb_row(spark, sf).select("vec_id", "i", geometry.ilog2(F.abs("v")).cast("int").alias("power"))


# --- orders -----------------------------------------------------------------------------------


@query(f"""with {PACKETS}, numbered as (select image_id, tile, layer, res, comp, py, px, row_number() over (partition by image_id, tile order by layer, res, comp, py, px) - 1 as one, row_number() over (partition by image_id, tile order by res, ref_y, ref_x, comp, layer) - 1 as two from pk)
select image_id, tile, cast(layer as int) as layer, res, cast(comp as int) as comp, cast(py as int) as py, cast(px as int) as px, case when res < 2 and layer < 1 then 0 else 1 end as owner, case when res < 2 and layer < 1 then one else two end as number from numbered where (res < 2 and layer < 1) or res < 4""")
def poc_dedup(spark, sf):
    """Two ranges that overlap: the first resolutions of a layer by LRCP, then more of them by RPCL."""
    t = geometry.precincts(geometry.resolutions(geometry.tiles(img_dim(spark, sf))))
    one = order.packets(t, 2, 2, "lrcp")
    base, per_layer, per_comp = order.strides("rpcl", F.lit(2), F.lit(2))
    two = base + F.col("layer") * per_layer + F.col("comp") * per_comp
    t = order.owners(one, [((F.col("res") < 2) & (F.col("layer") < 1), F.col("seq")), (F.col("res") < 4, two.cast("long"))])
    return t.select("image_id", "tile", "layer", "res", "comp", "py", "px", "owner", "number")


# --- rate -------------------------------------------------------------------------------------

LEAST = f"{PASSES}, least as (select *, min(distortion / bytes) over (partition by block order by pass rows unbounded preceding) as slope from passes), held as (select *, sum(bytes) over (order by slope desc) as upto, sum(bytes) over () as whole from least)"


@query(f"with {LEAST} select block, cast(coalesce(max(case when upto <= floor(whole * 0.5::double) then pass end), 0) as int) as passes from held group by 1")
def rate_lambda(spark, sf):
    return rate.layered(rate.simple_slopes(ev_pass(spark, sf)), [0.5]).select("block", "passes")


@query(f"""with {LEAST}, l as (select block, layer, cast(coalesce(max(case when upto <= floor(whole * part) then pass end), 0) as int) as passes from held, (select unnest([0, 1, 2]) as layer, unnest([0.25::double, 0.5::double, 1.0::double]) as part) group by 1, 2)
select block, layer, passes, passes - coalesce(lag(passes) over (partition by block order by layer), 0) as fresh from l""")
def rate_layers(spark, sf):
    return rate.layered(rate.simple_slopes(ev_pass(spark, sf)), [0.25, 0.5, 1.0])


@query(f"""with {LEAST}, l as (select block, layer, coalesce(max(case when upto <= floor(whole * part) then pass end), 0) as passes from held, (select unnest([0, 1, 2]) as layer, unnest([0.25::double, 0.5::double, 0.75::double]) as part) group by 1, 2)
select block, cast(coalesce(min(case when passes > 0 then layer end), -1) as int) as first from l group by 1""")
def first_layer(spark, sf):
    t = rate.first_layers(rate.layered(rate.simple_slopes(ev_pass(spark, sf)), [0.25, 0.5, 0.75]))
    return t.select("block", F.coalesce("first", F.lit(-1)).alias("first"))


@query(f"with {GAPS} select cast(sum(bytes) as bigint) as bytes, min(case when bytes > 0 then distortion / bytes end) as low, max(case when bytes > 0 then distortion / bytes end) as high, bool_or(distortion <> 0) as known from gaps")
def slope_summary(spark, sf):
    return rate.summary(gappy(spark, sf))


# --- joins ------------------------------------------------------------------------------------


@query(f"""with {GRID}, pal as (select n_nationkey as entry, n_regionkey * 40 as c0, 200 - n_nationkey * 3 as c1 from nation), s as (select vec_id, x, y, v, greatest(0, least(24, v + 128 - 116)) as entry from grid)
select vec_id, x, y, 0 as channel, cast(c0 - 128 as int) as v from s join pal using (entry) union all select vec_id, x, y, 1, cast(c1 - 128 as int) from s join pal using (entry) union all select vec_id, x, y, 2, cast(v - 116 as int) from s""")
def palette_channels(spark, sf):
    """Two channels through a palette and one as it is, by a component mapping."""
    nation = table(spark, sf, "nation")
    col = lambda c, v: nation.select(F.col("n_nationkey").cast("int").alias("entry"), F.lit(c).alias("col"), v.cast("int").alias("value"))
    entries = col(0, F.col("n_regionkey") * 40).unionByName(col(1, 200 - F.col("n_nationkey") * 3))
    mapping = spark.createDataFrame([(0, 0, 1, 0), (1, 0, 1, 1), (2, 0, 0, 0)], "channel int, comp int, kind int, col int")
    t = emb_grid(spark, sf).select("vec_id", "x", "y", (F.col("v") - 116).cast("int").alias("v"), F.lit(0).alias("comp"))
    return joins.palette(t, mapping, entries, entry_count=25).select("vec_id", "x", "y", "channel", F.col("v").cast("int").alias("v"))


@query(f"with {LI}, c as (select unnest([0, 1, 2]) as place, unnest([r, g, b]) as v from li) select cast(place as int) as place, v, count(*) as n from c group by 1, 2")
def channel_reorder(spark, sf):
    """Blue, green and red as channels 0, 1, 2, and a fourth without a colour, back in order."""
    defs = spark.createDataFrame([(0, 0, 3), (1, 0, 2), (2, 0, 1), (3, 1, 0)], "channel int, kind int, association int")
    each = F.array(*[F.struct(F.lit(i).alias("channel"), c.alias("v")) for i, c in enumerate((F.col("b"), F.col("g"), F.col("r"), F.lit(255)))])
    t = li_rgb(spark, sf).select(F.explode(each).alias("s")).select("s.channel", "s.v")
    return joins.reorder(t, defs, 4).groupBy("place", "v").agg(F.count(F.lit(1)).alias("n"))


@query("select true as reorder, cast(3 as bigint) as places from region limit 1")
def channel_order_check(spark, sf):
    defs = spark.createDataFrame([(0, 0, 3), (1, 0, 2), (2, 0, 1), (3, 1, 0)], "channel int, kind int, association int")
    return joins.needs_reorder(defs).join(joins.channel_order(defs, 4).agg(F.count(F.lit(1)).alias("places")))


@query("""select p_partkey as image_id, comp, cast(coalesce(case when p_partkey % 7 = 0 and comp = 1 then p_partkey % 4 end, case when p_partkey % 5 = 0 then p_partkey % 3 end, case when p_partkey % 3 = 0 and comp = 0 then p_partkey % 6 end, p_size % 6) as int) as levels
from part, (select cast(unnest([0, 1]) as int) as comp)""")
def override_resolution(spark, sf):
    """Levels by precedence: the tile's component, the tile, the main header's component, the main header."""
    base = img_dim(spark, sf).select("image_id", "levels", F.explode(F.array(F.lit(0), F.lit(1))).alias("comp"))
    at = lambda every, v, comp: base.where((F.col("image_id") % every == 0) & comp).select("image_id", "comp", (F.col("image_id") % v).cast("int").alias("levels"))
    layers = [at(7, 4, F.col("comp") == 1), at(5, 3, F.lit(True)), at(3, 6, F.col("comp") == 0)]
    return joins.overridden(base, ["image_id", "comp"], layers, "levels").select("image_id", "comp", "levels")


@query(f"with {GRID} select cast(vec_id % 25 * 8 + x - 3 as bigint) as x, cast(vec_id // 25 * 8 + y - 5 as bigint) as y, v from grid where vec_id % 25 * 8 + x >= 3 and vec_id // 25 * 8 + y >= 5 and vec_id % 25 * 8 + x < 193 and vec_id // 25 * 8 + y < 125")
def tile_compose_clipped(spark, sf):
    """Tiles put into an image whose origin is (3, 5), clipped to 190 x 120."""
    t = emb_grid(spark, sf).select((F.col("vec_id") % 25 * 8 + F.col("x")).alias("x"), (F.call_function("div", F.col("vec_id"), F.lit(25)) * 8 + F.col("y")).alias("y"), "v")
    return joins.compose(t, F.lit(3), F.lit(5), F.lit(190), F.lit(120)).select("x", "y", "v")


# --- bytes ------------------------------------------------------------------------------------


@query("select source, doc_id, sum(4 + n) over w - (4 + n) as offset, row_number() over w - 1 as owner from (select source, doc_id, octet_length(encode(coalesce(text, ''))) as n from documents) window w as (partition by source order by doc_id rows unbounded preceding)".replace("sum(4 + n) over w - (4 + n)", "cast(sum(4 + n) over w - (4 + n) as bigint)"))
def ppm_distribute(spark, sf):
    """Packed headers (a length and its bytes), one after another, go to the tile-parts in order."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 4
    t = table(spark, sf, "documents").select("source", "doc_id", size.alias("size"))
    return joins.chain(t, ["source"], ["doc_id"], F.col("size")).select("source", "doc_id", "offset", F.col("nth").alias("owner"))


@query("select lang, doc_id, cast(sum(8 + n) over w - (8 + n) as bigint) as offset, cast(8 + n as bigint) as length from (select lang, doc_id, octet_length(encode(coalesce(text, ''))) as n from documents) window w as (partition by lang order by doc_id rows unbounded preceding)")
def box_walk(spark, sf):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    t = table(spark, sf, "documents").select("lang", "doc_id", size.cast("long").alias("length"))
    return joins.chain(t, ["lang"], ["doc_id"], F.col("length")).select("lang", "doc_id", "offset", "length")


@query("""with d as (select doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as b from documents), p as (select doc_id, b[i] as one, b[i + 1] as two, i - 1 as place from (select doc_id, b, unnest(range(1, len(b))) as i from d))
select doc_id, count(*) as n, cast(sum(place) as bigint) as places, min(place) as first from p where one = '65' and two >= '90' group by 1""")
def marker_scan(spark, sf):
    """Offsets of what would be markers if the byte of "e" were 0xFF: it and a byte from 0x90 on."""
    # Each part before such a byte adds its bytes; every first byte of what isn't ASCII is from 0xC2 on.
    parts = F.split(F.coalesce("text", F.lit("")), "e(?=[^\\x00-\\x7f])", -1)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("places"), F.lit(None).cast("long").alias("first"))

    def step(a, part):
        at = a["at"] + F.octet_length(part)
        return F.struct((at + 1).alias("at"), (a["n"] + 1).alias("n"), (a["places"] + at).alias("places"), F.coalesce(a["first"], at).alias("first"))

    t = table(spark, sf, "documents").select("doc_id", F.aggregate(F.slice(parts, 1, F.size(parts) - 1), begin, step).alias("s"))
    return t.select("doc_id", "s.n", "s.places", "s.first").where("n > 0")


@query("""with recursive d as (select doc_id, 'ff' || md5(coalesce(text, '')) || 'ffff' as h from documents), bits as (select doc_id, list_reduce(list_transform(range(1, length(h) + 1), lambda i: bits[strpos('0123456789abcdef', substr(h, i, 1))]), lambda a, b: a || b) as s
from d, (select ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'] as bits)),
walk as (select doc_id, s, 0 as place, 8 as room, 0 as stuffed from bits union all select doc_id, s, place + room, case when substr(s, place + 1, room) = '11111111' then 7 else 8 end, stuffed + cast(substr(s, place + 1, room) = '11111111' as int) from walk where place + room <= length(s))
select doc_id, max(stuffed) as stuffed from walk group by 1""")
def bit_stuffing(spark, sf):
    """Zeros that a writer puts after each 0xFF: a fold over bytes of eight or, after 0xFF, seven bits."""
    h = F.concat(F.lit("ff"), F.md5(F.coalesce("text", F.lit(""))), F.lit("ffff"))
    s = F.array_join(F.transform(F.regexp_extract_all(h, F.lit("."), F.lit(0)), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    state = F.struct(F.lit(0).alias("at"), F.lit(8).alias("room"), F.lit(0).alias("stuffed"))

    def step(a, _):
        full = F.col("s").substr(a["at"] + 1, a["room"]) == "11111111"
        goes = a["at"] + a["room"] <= F.length("s")
        return F.struct(F.when(goes, a["at"] + a["room"]).otherwise(a["at"]).alias("at"), F.when(goes & full, 7).when(goes, 8).otherwise(a["room"]).alias("room"), (a["stuffed"] + F.when(goes & full, 1).otherwise(0)).alias("stuffed"))

    t = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return t.select("doc_id", F.aggregate(F.sequence(F.lit(1), F.lit(25)), state, step)["stuffed"].alias("stuffed"))


@query("select doc_id, cast(('0x' || substr(h, 1, 4)) as bigint) as u16, cast(('0x' || substr(h, 5, 8)) as bigint) as u32 from (select doc_id, md5(coalesce(text, '')) as h from documents)")
def be_reads(spark, sf):
    from rippleframe.operators import images

    raw = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    t = table(spark, sf, "documents").select("doc_id", raw.alias("b"))
    return t.select("doc_id", images.be(F.col("b"), F.lit(1), 2).alias("u16"), images.be(F.col("b"), F.lit(3), 4).alias("u32"))


@query("select p_brand, count(distinct p_size % 16 + 1) = 1 as same, case when count(distinct p_size % 16 + 1) = 1 then max(p_size % 16) else 255 end as bpc from part group by 1")
def container_depth(spark, sf):
    """The container's depth byte: that of all components, or 255 where they differ."""
    depth = F.col("p_size") % 16 + 1
    return table(spark, sf, "part").groupBy("p_brand").agg((F.count_distinct(depth) == 1).alias("same"), F.when(F.count_distinct(depth) == 1, F.max(depth) - 1).otherwise(255).alias("bpc"))
