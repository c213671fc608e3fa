"""Every catalogue query against its SQL in DuckDB, and laws of the operators."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rippleframe import plans
from rippleframe.functions import color, quant
from rippleframe.operators import blocks, geometry, lifting

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = plans.every()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9])
def test_lifting_inverts(spark, n):
    t = spark.range(n).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("i"), ((F.col("id") * 37) % 101).cast("int").alias("v"))
    want = sorted((r.i, r.v) for r in t.collect())
    back = lifting.synthesise53(lifting.analyse53(t, ["k"], "i"), ["k"], "i")
    assert sorted((r.i, r.v) for r in back.collect()) == want


def test_worked_colours(spark):
    t = spark.createDataFrame([(191, -128, 127), (100, 10, 5), (150, -10, -5)], "y int, cb int, cr int")
    got = t.select(*color.rct_inverse(F.col("y"), F.col("cb"), F.col("cr"))).collect()
    assert [tuple(r) for r in got] == [(319, 192, 64), (102, 97, 107), (149, 154, 144)]


def test_pass_codes_are_prefix_free(spark):
    codes = [r.c for r in spark.range(1, 165).select(blocks.pass_count_code(F.col("id")).alias("c")).collect()]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_deadzone_guards_its_step(spark):
    t = spark.createDataFrame([(-7, 2.0), (7, 0.0)], "v int, s double")
    assert [r[0] for r in t.select(quant.deadzone(F.col("v"), F.col("s"))).collect()] == [-3, 7]


def test_code_blocks_are_one_list_of_dealt_images(spark):
    """A list within the blocks' list isn't compiled; and blocks as rectangles of a grid, by brute force."""
    plan = QUERIES["codeblock_grid"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 4 and "REPARTITION_BY_NUM" in plan  # tiles, resolutions, bands, blocks
    bounds = [(0, 0, 1, 1), (-5, -9, 20, 3), (3, 5, 3, 9), (7, 1, 40, 33)]
    t = spark.createDataFrame([(i, 0, 15, 15, *b) for i, b in enumerate(bounds)], "id int, res int, ppx int, ppy int, bx0 int, by0 int, bx1 int, by1 int")
    got = sorted(map(tuple, geometry.code_blocks(t, 3).select("id", "cbx", "cby", "cx0", "cy0", "cx1", "cy1").collect()))
    want = []
    for i, (x0, y0, x1, y1) in enumerate(bounds):
        cells = {(x // 8, y // 8) for x in range(x0, x1) for y in range(y0, y1)}
        want += [(i, x, y, max(x0, 8 * x), max(y0, 8 * y), min(x1, 8 * x + 8), min(y1, 8 * y + 8)) for x, y in cells]
    assert got == sorted(want)
