"""The catalogue's queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.functions import color, quant
from rippleframe.operators import blocks, geometry, joins, lifting, metrics, order, rate

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- inputs -----------------------------------------------------------------------------------

LI = "li as (select cast(floor(l_quantity * 5) as int) as r, cast(round(l_discount * 1000) as int) as g, cast(round(l_tax * 1000) as int) as b from lineitem)"
EMB = "emb as (select vec_id, label, i, cast(floor(cast(e as double) * 127) as int) as v from (select vec_id, label, cast(unnest(range(64)) as int) as i, unnest(embedding) as e from embeddings))"
GRID = f"{EMB}, grid as (select vec_id, label, i % 8 as x, i // 8 as y, v from emb)"
DIM = "dim as (select p_partkey as image_id, cast(64 + p_partkey % 449 as int) as w, cast(64 + (7 * p_partkey) % 321 as int) as h, cast(p_partkey % 5 as int) as xo, cast(p_partkey % 3 as int) as yo, cast(32 + p_partkey % 97 as int) as tw, cast(32 + p_partkey % 61 as int) as th, cast(p_size % 6 as int) as levels, cast(1 + p_partkey % 2 as int) as dx, cast(1 + p_partkey % 3 as int) as dy, cast(4 + p_partkey % 4 as int) as ppx, cast(4 + p_partkey % 3 as int) as ppy from part)"
TILES = f"""{DIM}, tile as (select image_id, tile, levels, ppx, ppy, greatest((tile % tx) * tw, xo) as x0, greatest((tile // tx) * th, yo) as y0,
  least((tile % tx + 1) * tw, w) as x1, least((tile // tx + 1) * th, h) as y1
  from (select *, cast(unnest(range(tx * ty)) as int) as tile from (select *, (w + tw - 1) // tw as tx, (h + th - 1) // th as ty from dim)))"""
RES = f"""{TILES}, sc as (select *, cast(unnest(range(levels + 1)) as int) as res from tile), res as (select image_id, tile, x0, y0, res, levels, ppx, ppy,
  (x0 + (1 << (levels - res)) - 1) >> (levels - res) as trx0, (y0 + (1 << (levels - res)) - 1) >> (levels - res) as try0,
  (x1 + (1 << (levels - res)) - 1) >> (levels - res) as trx1, (y1 + (1 << (levels - res)) - 1) >> (levels - res) as try1 from sc)"""
PREC = f"""{RES}, prec as (select *, case when trx1 > trx0 then ((trx1 + (1 << ppx) - 1) >> ppx) - (trx0 >> ppx) else 0 end as nx,
  case when try1 > try0 then ((try1 + (1 << ppy) - 1) >> ppy) - (try0 >> ppy) else 0 end as ny from res)"""
PASSES = "passes as (select user_id as block, row_number() over (partition by user_id order by ts, event_id) as pass, length(props) + 1 as bytes, value as distortion from events)"


def li_rgb(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select(F.floor(F.col("l_quantity") * 5).cast("int").alias("r"), F.round(F.col("l_discount") * 1000).cast("int").alias("g"), F.round(F.col("l_tax") * 1000).cast("int").alias("b"))


def emb_row(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return t.select("vec_id", "label", "i", F.floor(F.col("e").cast("double") * 127).cast("int").alias("v"))


def emb_grid(spark: SparkSession, sf: str) -> DataFrame:
    return emb_row(spark, sf).select("vec_id", "label", F.pmod("i", F.lit(8)).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "v")


def img_dim(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select(
        k.alias("image_id"), 64 + k % 449, 64 + (7 * k) % 321, k % 5, k % 3, 32 + k % 97, 32 + k % 61, F.col("p_size") % 6, 1 + k % 2, 1 + k % 3, 4 + k % 4, 4 + k % 3
    ).toDF("image_id", "w", "h", "xo", "yo", "tw", "th", "levels", "dx", "dy", "ppx", "ppy")
    return t.select("image_id", *[F.col(c).cast("int") for c in t.columns[1:]])


def ev_pass(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.select(F.col("user_id").alias("block"), n.alias("pass"), (F.length("props") + 1).alias("bytes"), F.col("value").alias("distortion"))


# --- projections ------------------------------------------------------------------------------


@query(f"with {LI} select r - 128 as r, g - 128 as g, b - 128 as b from li")
def dc_shift(spark, sf):
    return li_rgb(spark, sf).select(*[color.level_shift(F.col(c)).alias(c) for c in "rgb"])


@query(f"with {LI} select (r + 2 * g + b) >> 2 as y, b - g as cb, r - g as cr from li")
def rct_forward(spark, sf):
    y, cb, cr = color.rct(F.col("r"), F.col("g"), F.col("b"))
    return li_rgb(spark, sf).select(y.alias("y"), cb.alias("cb"), cr.alias("cr"))


@query(f"with {LI} select b + r - ((g + b) >> 2) as red, r - ((g + b) >> 2) as green, g + r - ((g + b) >> 2) as blue from li")
def rct_inverse(spark, sf):
    r, g, b = color.rct_inverse(F.col("r"), F.col("g"), F.col("b"))
    return li_rgb(spark, sf).select(r.alias("red"), g.alias("green"), b.alias("blue"))


@query("select count(*) as n, cast(0 as bigint) as mismatches from lineitem")
def rct_roundtrip(spark, sf):
    t = li_rgb(spark, sf).withColumns(dict(zip(("y", "cb", "cr"), color.rct(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    r, g, b = color.rct_inverse(F.col("y"), F.col("cb"), F.col("cr"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if((r != F.col("r")) | (g != F.col("g")) | (b != F.col("b"))).alias("mismatches"))


@query(f"with {LI} select round(r * 0.299::double + g * 0.587::double + b * 0.114::double, 6) + 0.0 as y, round(r * -0.16875::double + g * -0.33126::double + b * 0.5::double, 6) + 0.0 as cb, round(r * 0.5::double + g * -0.41869::double + b * -0.08131::double, 6) + 0.0 as cr from li")
def ict_forward(spark, sf):
    return li_rgb(spark, sf).select(*[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(color.ict(F.col("r"), F.col("g"), F.col("b")), ("y", "cb", "cr"), strict=True)])


@query(f"with {LI} select round(r + b * 1.402::double, 6) as red, round(r - g * 0.344136::double - b * 0.714136::double, 6) as green, round(r + g * 1.772::double, 6) as blue from li")
def ict_inverse(spark, sf):
    return li_rgb(spark, sf).select(*[F.round(c, 6).alias(n) for c, n in zip(color.ict_inverse(F.col("r"), F.col("g"), F.col("b")), ("red", "green", "blue"), strict=True)])


@query(f"with {LI} select cast(greatest(0, least(255, floor(r + b * 1.402::double + 0.5::double))) as int) as red, cast(greatest(0, least(255, floor(r - g * 0.344136::double - b * 0.714136::double + 0.5::double))) as int) as green, cast(greatest(0, least(255, floor(r + g * 1.772::double + 0.5::double))) as int) as blue from li")
def clamp_rgba8(spark, sf):
    return li_rgb(spark, sf).select(*[color.clamp8_float(c).alias(n) for c, n in zip(color.ict_inverse(F.col("r"), F.col("g"), F.col("b")), ("red", "green", "blue"), strict=True)])


@query(f"with {LI} select (r % 16 * 255 + 7) // 15 as d4, (r * 255 + 511) // 1023 as d10, (r * 255 + 2047) // 4095 as d12 from li")
def bitdepth_rescale(spark, sf):
    r = F.col("r")
    return li_rgb(spark, sf).select(color.rescale8(r % 16, 4).alias("d4"), color.rescale8(r, 10).alias("d10"), color.rescale8(r, 12).alias("d12"))


@query(f"with {EMB} select vec_id, i, cast(trunc((2 * v + 1) / 2.0::double) as int) as v from emb")
def dequant_halving(spark, sf):
    return emb_row(spark, sf).select("vec_id", "i", quant.halved(F.col("v") * 2 + 1).alias("v"))


@query("select p_partkey, p_size % 32 as eps, cast(p_partkey % 2048 as int) as mu, round((1 + (p_partkey % 2048) / 2048.0::double) * pow(2.0::double, 8 - p_size % 32), 9) as step from part")
def step_from_exp_mant(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 32).alias("eps"), (F.col("p_partkey") % 2048).cast("int").alias("mu"))
    return t.select("*", F.round(quant.step_of(F.col("eps"), F.col("mu"), 8), 9).alias("step"))


@query("select p_partkey, p_size % 32 as eps, cast(p_partkey % 2048 as int) as mu from part")
def exp_mant_from_step(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 32).alias("e"), (F.col("p_partkey") % 2048).alias("m"))
    eps, mu = quant.exponent_mantissa(quant.step_of(F.col("e"), F.col("m"), 8), 8)
    return t.select("p_partkey", eps.alias("eps"), mu.alias("mu"))


@query(f"with {EMB} select vec_id, i, case when s > 0 and abs(v) >= (1 << s) then cast(sign(v) as int) * (abs(v) >> s) else v end as v from (select *, label % 5 as s from emb)")
def roi_deshift(spark, sf):
    return emb_row(spark, sf).select("vec_id", "i", quant.roi_deshift(F.col("v"), F.col("label") % 5).alias("v"))


# --- lifting ----------------------------------------------------------------------------------


def _sql53(source: str, keys: str, axis: str, name: str, extra: str = "") -> str:
    """SQL for one 5/3 analysis pass of a table with columns keys, axis, v."""
    over = f"over (partition by {keys} order by {axis})"
    return f"""{name}_d as (select *, case when {axis} % 2 = 1 then v - ((lag(v) {over} + coalesce(lead(v) {over}, lag(v) {over})) >> 1) else v end as d from {source}),
{name}_s as (select *, case when {axis} % 2 = 0 then d + ((coalesce(lag(d) {over}, lead(d) {over}) + coalesce(lead(d) {over}, lag(d) {over}) + 2) >> 2) else d end as s, max({axis}) over (partition by {keys}) + 1 as n from {name}_d),
{name} as (select {keys}{extra}, cast(case when {axis} % 2 = 0 then {axis} // 2 else (n + 1) // 2 + {axis} // 2 end as int) as {axis}, s as v from {name}_s)"""


D2 = f"{GRID}, {_sql53('grid', 'vec_id, x', 'y', 'c', ', label')}, {_sql53('c', 'vec_id, y', 'x', 'b1', ', label')}"


@query(f"with {EMB}, {_sql53('emb', 'vec_id', 'i', 'a')} select * from a")
def dwt53_forward_1d(spark, sf):
    return lifting.analyse53(emb_row(spark, sf), ["vec_id"], "i").select("vec_id", "i", "v")


@query("select cast(64 * count(*) as bigint) as n, cast(0 as bigint) as mismatches from embeddings")
def dwt53_roundtrip_1d(spark, sf):
    t = lifting.analyse53(emb_row(spark, sf).withColumn("was", F.col("v")).withColumn("at", F.col("i")), ["vec_id"], "i")
    back = lifting.synthesise53(t.select("vec_id", "i", "v"), ["vec_id"], "i")
    both = emb_row(spark, sf).join(back.select("vec_id", "i", F.col("v").alias("w")), ["vec_id", "i"], "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("v").eqNullSafe(F.col("w"))).alias("mismatches"))


@query(f"with {D2} select vec_id, x, y, v from b1")
def dwt53_2d(spark, sf):
    return lifting.analyse53_2d(emb_grid(spark, sf)).select("vec_id", "x", "y", "v")


@query(f"""with {D2}, low as (select * from b1 where x < 4 and y < 4), {_sql53('low', 'vec_id, x', 'y', 'c2', ', label')}, {_sql53('c2', 'vec_id, y', 'x', 'b2', ', label')},
low2 as (select * from b2 where x < 2 and y < 2), {_sql53('low2', 'vec_id, x', 'y', 'c3', ', label')}, {_sql53('c3', 'vec_id, y', 'x', 'b3', ', label')}
select vec_id, x, y, v from b3 union all select vec_id, x, y, v from b2 where x >= 2 or y >= 2 union all select vec_id, x, y, v from b1 where x >= 4 or y >= 4""")
def dwt53_multilevel(spark, sf):
    return lifting.analyse53_2d(emb_grid(spark, sf), levels=3).select("vec_id", "x", "y", "v")


@query(f"with {D2} select label, case when x < 4 and y < 4 then 'LL' when y < 4 then 'HL' when x < 4 then 'LH' else 'HH' end as band, cast(sum(v * v) as bigint) as energy from b1 group by 1, 2")
def subband_energy_by_label(spark, sf):
    t = lifting.analyse53_2d(emb_grid(spark, sf))
    return t.groupBy("label", lifting.band(F.col("x"), F.col("y"), 4).alias("band")).agg(F.sum(F.col("v").cast("long") * F.col("v")).alias("energy"))


def _sql97() -> str:
    out, last = [], "emb0"
    over = "over (partition by vec_id order by i)"
    for k, (odd, f) in enumerate(((1, lifting.ALPHA), (0, lifting.BETA), (1, lifting.GAMMA), (0, lifting.DELTA)), 1):
        out.append(f"emb{k} as (select vec_id, i, case when i % 2 = {odd} then v + (coalesce(lag(v) {over}, lead(v) {over}) + coalesce(lead(v) {over}, lag(v) {over})) * ({f!r}::double) else v end as v from {last})")
        last = f"emb{k}"
    return f"{EMB}, emb0 as (select vec_id, i, cast(v as double) as v from emb), " + ", ".join(out)


@query(f"with {_sql97()} select vec_id, cast(case when i % 2 = 0 then i // 2 else 32 + i // 2 end as int) as i, round(case when i % 2 = 0 then v / {lifting.K!r}::double else v * {lifting.K / 2!r}::double end, 6) + 0.0 as v from emb4")
def dwt97_forward_1d(spark, sf):
    t = emb_row(spark, sf).withColumn("v", F.col("v").cast("double"))
    return lifting.analyse97(t, ["vec_id"], "i").select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


COEFFICIENTS = f"{_sql97()}, co as (select vec_id, cast(case when i % 2 = 0 then i // 2 else 32 + i // 2 end as int) as i, round(case when i % 2 = 0 then v / {lifting.K!r}::double else v * {lifting.K / 2!r}::double end, 6) as v from emb4)"


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    t = emb_row(spark, sf).withColumn("v", F.col("v").cast("double"))
    return lifting.analyse97(t, ["vec_id"], "i").select("vec_id", "i", F.round("v", 6).alias("v"))


@query(f"with {COEFFICIENTS} select vec_id, i, cast(sign(v) * floor(abs(v) / 2.5::double) as int) as q from co")
def quant_deadzone(spark, sf):
    return coefficients(spark, sf).select("vec_id", "i", quant.deadzone(F.col("v"), F.lit(2.5)).alias("q"))


@query(f"with {COEFFICIENTS} select vec_id, i, case when abs(v) < 2.5::double then 0.0::double else round(sign(v) * (floor(abs(v) / 2.5::double) + 0.5::double) * 2.5::double, 6) end as v from co")
def dequant_midpoint(spark, sf):
    q = quant.deadzone(F.col("v"), F.lit(2.5))
    return coefficients(spark, sf).select("vec_id", "i", F.round(quant.midpoint(q, F.lit(2.5)), 6).alias("v"))


@query("select vec_id, true as close from embeddings")
def dwt97_roundtrip(spark, sf):
    t = emb_row(spark, sf).select("vec_id", "i", F.col("v").cast("double").alias("v"))
    back = lifting.synthesise97(lifting.analyse97(t, ["vec_id"], "i"), ["vec_id"], "i")
    both = t.join(back.select("vec_id", "i", F.col("v").alias("w")), ["vec_id", "i"])
    return both.groupBy("vec_id").agg((F.max(F.abs(F.col("v") - F.col("w"))) < 1e-9).alias("close"))


# --- geometry ---------------------------------------------------------------------------------


@query(f"with {DIM} select image_id, cast((w + dx - 1) // dx - (xo + dx - 1) // dx as int) as width, cast((h + dy - 1) // dy - (yo + dy - 1) // dy as int) as height from dim")
def component_dims(spark, sf):
    return geometry.component_dims(img_dim(spark, sf))


@query(f"with {TILES} select image_id, cast(tile as int) as tile, x0, y0, x1, y1 from tile")
def tile_grid(spark, sf):
    return geometry.tiles(img_dim(spark, sf)).select("image_id", "tile", "x0", "y0", "x1", "y1")


@query(f"with {RES} select image_id, tile, res, trx0, try0, trx1, try1 from res")
def resolution_bounds(spark, sf):
    return geometry.resolutions(geometry.tiles(img_dim(spark, sf))).select("image_id", "tile", "res", "trx0", "try0", "trx1", "try1")


@query(f"with {PREC} select image_id, tile, res, nx, ny from prec")
def precinct_counts(spark, sf):
    return geometry.precincts(geometry.resolutions(geometry.tiles(img_dim(spark, sf)))).select("image_id", "tile", "res", "nx", "ny")


# --- code-blocks ------------------------------------------------------------------------------


@query(f"with {EMB}, m as (select vec_id, max(abs(v)) as m from emb group by 1), p as (select vec_id, case when m = 0 then 0 else length(bin(m)) end as planes from m) select vec_id, cast(planes as int) as planes, cast(greatest(9 - planes, 0) as int) as zbp, cast(greatest(3 * planes - 2, 0) as int) as passes from p")
def block_planes(spark, sf):
    return blocks.block_planes(emb_row(spark, sf), ["vec_id"])


SIG = f"{GRID}, sig as (select vec_id, label, x, y, v, cast(abs(v) >= 16 as int) as s from grid)"
NEAR = f"""{SIG}, near as (select vec_id, x, y, max(label) as label, max(v) as v, cast(sum(h) as int) as h, cast(sum(vv) as int) as vv, cast(sum(d) as int) as d from (
  select a.vec_id, a.x, a.y, a.label, a.v, case when b.y = a.y and b.x <> a.x then b.s else 0 end as h, case when b.x = a.x and b.y <> a.y then b.s else 0 end as vv,
  case when b.x <> a.x and b.y <> a.y then b.s else 0 end as d from sig a join sig b on a.vec_id = b.vec_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1) group by 1, 2, 3)"""


def significant(spark, sf) -> DataFrame:
    return emb_grid(spark, sf).withColumn("s", (F.abs("v") >= 16).cast("int"))


@query(f"with {NEAR} select vec_id, x, y, h, vv as v, d from near")
def neighbor_counts(spark, sf):
    return blocks.neighbours(significant(spark, sf).drop("v"), "vec_id", "s").select("vec_id", "x", "y", "h", "v", "d")


ZC = """case when band = 3 then (case when d >= 3 then 8 when d = 2 and h + vv >= 1 then 7 when d = 2 then 6 when d = 1 and h + vv >= 2 then 5 when d = 1 and h + vv = 1 then 4 when d = 1 then 3 when h + vv >= 2 then 2 else h + vv end)
  else (case when a = 2 then 8 when a = 1 and b >= 1 then 7 when a = 1 and d >= 1 then 6 when a = 1 then 5 when b = 2 then 4 when b = 1 then 3 when d >= 2 then 2 else d end) end"""


@query(f"with {NEAR} select vec_id, x, y, cast({ZC} as int) as ctx from (select *, case when band = 1 then vv else h end as a, case when band = 1 then h else vv end as b from (select *, label % 4 as band from near))")
def zero_coding_context(spark, sf):
    t = blocks.neighbours(significant(spark, sf).drop("v"), "vec_id", "s")
    return t.select("vec_id", "x", "y", blocks.zero_context(F.col("h"), F.col("v"), F.col("d"), F.col("label") % 4).alias("ctx"))


@query(NEAR.join(("with ", "")).replace("cast(abs(v) >= 16 as int) as s", "case when abs(v) >= 16 then cast(sign(v) as int) else 0 end as s") + """ select vec_id, x, y,
cast(case when f = 1 then (case when h = 0 then 9 - v else 12 - v end) else (case when h = 1 then 12 + v else 9 + v end) end as int) as ctx, f as flip
from (select vec_id, x, y, h, v, cast(h < 0 or (h = 0 and v < 0) as int) as f from (select vec_id, x, y, greatest(-1, least(1, h)) as h, greatest(-1, least(1, vv)) as v from near))""")
def sign_context(spark, sf):
    t = emb_grid(spark, sf).withColumn("s", F.when(F.abs("v") >= 16, F.signum("v").cast("int")).otherwise(0))
    ctx, flip = blocks.sign_context(F.col("h"), F.col("v"))
    return blocks.neighbours(t.drop("v"), "vec_id", "s").select("vec_id", "x", "y", ctx.alias("ctx"), flip.alias("flip"))


@query(f"with {NEAR} select vec_id, x, y, case when not (abs(v) >= 16 and abs(v) < 32) then 16 when h + vv + d > 0 then 15 else 14 end as ctx from near")
def magnitude_context(spark, sf):
    t = blocks.neighbours(significant(spark, sf).withColumnRenamed("v", "value"), "vec_id", "s")
    first = (F.abs("value") >= 16) & (F.abs("value") < 32)
    return t.select("vec_id", "x", "y", blocks.magnitude_context(first, F.col("h") + F.col("v") + F.col("d")).alias("ctx"))


@query(f"""with recursive {EMB}, m as (select vec_id, max(abs(v)) as m from emb group by 1), leaf as (select cast(vec_id % 25 as int) as x, cast(vec_id // 25 as int) as y, cast(greatest(9 - case when m = 0 then 0 else length(bin(m)) end, 0) as int) as z from m)
select l as level, cast(x >> l as int) as x, cast(y >> l as int) as y, min(z) as least from leaf, (select cast(unnest(range(6)) as int) as l) group by 1, 2, 3""")
def tagtree_rollup(spark, sf):
    t = blocks.block_planes(emb_row(spark, sf), ["vec_id"]).select((F.col("vec_id") % 25).cast("int").alias("x"), F.floor(F.col("vec_id") / 25).cast("int").alias("y"), "zbp")
    return blocks.tag_tree(t, "zbp", 5)


@query("""select n, case when n = 1 then '0' when n = 2 then '10' when n <= 5 then '11' || lpad(bin(n - 3), 2, '0') when n <= 36 then '1111' || lpad(bin(n - 6), 5, '0') else '111111111' || lpad(bin(n - 37), 7, '0') end as code
from (select cast(unnest(range(1, 165)) as bigint) as n)""")
def pass_count_code(spark, sf):
    return spark.range(1, 165).select(F.col("id").alias("n"), blocks.pass_count_code(F.col("id")).alias("code"))


# --- orders -----------------------------------------------------------------------------------

PACKETS = f"""{PREC}, pk as (select *, greatest(((trx0 >> ppx) + px) * (1 << ppx) * (1 << (levels - res)), x0) as ref_x, greatest(((try0 >> ppy) + py) * (1 << ppy) * (1 << (levels - res)), y0) as ref_y
  from (select *, unnest(range(2)) as layer from (select *, unnest(range(2)) as comp from (select *, unnest(range(nx)) as px from (select *, unnest(range(ny)) as py from prec where nx > 0 and ny > 0)))))"""


def _order(kind: str):
    def run(spark, sf):
        t = geometry.precincts(geometry.resolutions(geometry.tiles(img_dim(spark, sf))))
        return order.packets(t, 2, 2, kind).select("image_id", "tile", "layer", "res", "comp", "py", "px", "seq")

    run.__name__ = f"order_{kind}"
    keys = ", ".join(order.KEYS[kind])
    query(f"""with {PACKETS} select image_id, tile, layer, res, comp, py, px, row_number() over (partition by image_id, tile order by {keys}) - 1 as seq
from (select image_id, tile, cast(layer as int) as layer, res, cast(comp as int) as comp, cast(py as int) as py, cast(px as int) as px, ref_x, ref_y from pk)""")(run)


for _kind in order.KEYS:
    _order(_kind)


@query(f"with {PACKETS} select image_id, tile, cast(layer as int) as layer, res, cast(comp as int) as comp, cast(py as int) as py, cast(px as int) as px from pk where layer < 1 and res <= 2")
def layer_res_limit(spark, sf):
    t = order.packets(geometry.precincts(geometry.resolutions(geometry.tiles(img_dim(spark, sf)))), 2, 2)
    return t.where("layer < 1 and res <= 2").select("image_id", "tile", "layer", "res", "comp", "py", "px")


# --- rate -------------------------------------------------------------------------------------


@query(f"with {PASSES} select block, pass, round(distortion / bytes, 6) as slope from passes")
def rd_slopes(spark, sf):
    return rate.slopes(ev_pass(spark, sf)).select("block", "pass", F.round("slope", 6).alias("slope"))


#: Passes of which every fourth has no bytes.
GAPS = f"{PASSES}, gaps as (select block, pass, case when pass % 4 = 0 then 0 else bytes end as bytes, distortion from passes)"


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return ev_pass(spark, sf).withColumn("bytes", F.when(F.col("pass") % 4 == 0, 0).otherwise(F.col("bytes")))


@query(f"with {GAPS} select block, cast(coalesce(max(case when ok = 1 and bytes > 0 then pass end), 0) as int) as passes from (select *, min(case when bytes > 0 then cast(distortion / bytes >= 1.0 as int) end) over (partition by block order by pass rows unbounded preceding) as ok from gaps) group by 1")
def rate_prefix(spark, sf):
    return rate.prefixes(rate.simple_slopes(gappy(spark, sf)), F.lit(1.0))


@query(f"with {GAPS} select block, cast(coalesce(max(case when ok then pass end), 0) as int) as passes from (select block, pass, sum(bytes) over (partition by block order by pass rows unbounded preceding) <= floor(sum(bytes) over (partition by block) * 0.5::double) as ok from gaps) group by 1")
def rate_uniform(spark, sf):
    return rate.uniform(gappy(spark, sf), 0.5)


# --- joins ------------------------------------------------------------------------------------


@query(f"with {GRID} select vec_id, x, y, n_name as entry from grid left join nation on n_nationkey = greatest(0, least(24, v + 12))")
def palette_lookup(spark, sf):
    pal = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("entry"))
    t = emb_grid(spark, sf).withColumn("k", F.greatest(F.lit(0), F.least(F.lit(24), F.col("v") + 12)))
    return t.join(pal, "k", "left").select("vec_id", "x", "y", "entry")


@query(f"with {GRID}, f as (select vec_id, x, y, v, cast(unnest([2, 3]) as int) as factor from grid) select vec_id, factor, cast(tx as int) as x, cast(ty as int) as y, v from (select *, unnest(case when x = 7 then range(factor * x, 23) else range(factor * x, factor * x + factor) end) as tx from (select *, unnest(case when y = 7 then range(factor * y, 23) else range(factor * y, factor * y + factor) end) as ty from f))")
def upsample_nearest(spark, sf):
    t = emb_grid(spark, sf).select("vec_id", "x", "y", "v", F.explode(F.array(F.lit(2), F.lit(3))).alias("factor"))
    return joins.upsample(t, F.lit(8), F.lit(8), F.lit(23), F.lit(23), F.col("factor"), F.col("factor")).select("vec_id", "factor", "x", "y", "v")


@query(f"with {GRID} select cast(vec_id % 25 * 8 + x as bigint) as x, cast(vec_id // 25 * 8 + y as bigint) as y, v from grid")
def tile_compose(spark, sf):
    return emb_grid(spark, sf).select((F.col("vec_id") % 25 * 8 + F.col("x")).alias("x"), (F.floor(F.col("vec_id") / 25) * 8 + F.col("y")).cast("long").alias("y"), "v")


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as tile_index from orders")
def tlm_index(spark, sf):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return table(spark, sf, "orders").select("o_orderkey", n.cast("long").alias("tile_index"))


# --- metrics ----------------------------------------------------------------------------------


#: Samples of all channels beside quantised ones.
PAIRED = f"{LI}, pair as (select unnest([r, g, b]) as a, unnest([r // 4 * 4, g // 8 * 8, b]) as z from li)"


def paired(spark: SparkSession, sf: str) -> DataFrame:
    t = li_rgb(spark, sf)
    low = lambda c, n: F.col(c) - F.col(c) % n
    both = F.array(*[F.struct(F.col(c).alias("a"), z.alias("z")) for c, z in (("r", low("r", 4)), ("g", low("g", 8)), ("b", F.col("b")))])
    return t.select(F.explode(both).alias("p")).select("p.a", "p.z")


@query(f"with {PAIRED}, m as (select avg(pow(a - z, 2)) as mse from pair) select round(case when mse is null then null when mse = 0 then 'infinity'::double else 10 * log10(65025 / mse) end, 6) as psnr from m")
def psnr(spark, sf):
    return metrics.psnr(paired(spark, sf), "a", "z")


@query(f"with {PAIRED} select count(*) as n, cast(coalesce(sum(cast(abs(a - z) > 1 as int)), 0) as bigint) as differ, max(abs(a - z)) as most, case when count(*) > 0 then round(100.0::double * sum(cast(abs(a - z) > 1 as int)) / count(*), 6) end as percent, case when max(abs(a - z)) > 10 or 100.0 * sum(cast(abs(a - z) > 1 as int)) / count(*) > 5 then 'fail' when 100.0 * sum(cast(abs(a - z) > 1 as int)) / count(*) > 0.1 then 'close' else 'pass' end as verdict from pair")
def conformance_metrics(spark, sf):
    return metrics.conformance(paired(spark, sf), "a", "z")
