"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines (cut at \\n, outer blanks trimmed) of at least MIN_CHARS characters are linked when their edit distance
is at most THRESHOLD. Each distinct line is split into threshold + 1 segments, of which a line within
the threshold keeps at least one whole; a line probes the segments of lines of its own and of shorter
lengths with its substrings at the places that the multi-match rule leaves. Candidates are verified by
a banded bit-parallel edit distance: the band's columns are the bits of one long.

A key that g lines share does not give g*g pairs. Lines first meet only the key's head; those found
alike join components. The lines of keys that still hold several components meet those of others under
finer keys: a matching segment leaves a rest with the same edits, which is split and probed again, so no
link between components is missed.

Of each component the line that comes first (smallest doc_id, then place) stays; all others are
dropped, with their later copies. Of equal shorter lines the first stays; empty lines always stay. Null texts count as empty;
a null doc_id comes first. Distinct lines are named by 64-bit hashes. Columns other than the id and the
text are ignored; an empty table gives an empty result. Repeated rows hold copies of the same lines at
the same places; both keep what is first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Members, cut, discard, partitions, table, text_of
from .graph import components

THRESHOLD = 1
MIN_CHARS = 16
#: Segments that must match, one in what the others leave, before lines of different components are compared.
DEPTH = 3


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text_of(text_col), "\n")).alias("place", "line"))
    return rows.select("doc_id", "place", F.btrim("line", F.lit(" \t\r\x0b\x0c")).alias("line"))


def _segments(length: Column, k: int, i: int) -> tuple[Column, Column]:
    """Start (1-based) and length of segment i (0-based) of k: the last ones are longer by one."""
    short = F.floor(length / k).cast("int")
    longer = length - short * k
    begin = short * i + F.greatest(F.lit(0), F.lit(i - k) + longer) + 1
    return begin, short + F.when(F.lit(i) >= F.lit(k) - longer, 1).otherwise(0)


def join_keys(line: Column, length: Column, threshold: int) -> tuple[Column, Column]:
    """Two arrays: the segments that a line is indexed by, which are also what it probes lines of its own
    length with, and the other substrings that can equal a segment of a line of this or a shorter length."""
    k, own, other = threshold + 1, [], []
    for delta in range(threshold + 1):
        for i in range(k):
            begin, size = _segments(length - delta, k, i)
            low = max(-i, delta - (threshold - i))
            high = min(i, delta + (threshold - i))
            for shift in range(low, high + 1):
                key = F.xxhash64(length - delta, F.lit(i), F.substring(line, begin + shift, size))
                (other if delta or shift else own).append(key)
    return F.array(*own), F.array(*other)


def _rest(line: Column, begin: Column, size: Column) -> Column:
    return F.concat(F.substring(line, F.lit(1), begin - 1), F.substring(line, begin + size, F.char_length(line)))


def deep_keys(lines: DataFrame, threshold: int, delta: int | None, depth: int = DEPTH) -> DataFrame:
    """id, label, key of lines (id, label, line): keys of several segments.

    What a matching segment leaves holds the same edits, so it is split again, depth times. Without delta
    the keys that a line is indexed by; else those that it probes lines shorter by delta with.
    """
    k, less = threshold + 1, delta or 0
    out = lines.select("id", "label", F.xxhash64(F.char_length("line") - less).alias("key"), F.col("line").alias("rest"))
    for _ in range(depth):
        rest, parts = F.col("rest"), []
        for i in range(k):
            begin, size = _segments(F.char_length(rest) - less, k, i)
            low, high = (0, 0) if delta is None else (max(-i, delta - (threshold - i)), min(i, delta + (threshold - i)))
            for shift in range(low, high + 1):
                parts.append(F.struct(F.xxhash64("key", F.lit(i), F.substring(rest, begin + shift, size)).alias("key"), _rest(rest, begin + shift, size).alias("rest")))
        out = out.select("id", "label", F.explode(F.array(*parts)).alias("part")).select("id", "label", "part.key", "part.rest")
    return out.select("id", "label", "key")


def edit_within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of a and b is at most threshold, in a bit-parallel band of 2 t + 1 diagonals.

    State e of row j is a long whose bit d + t says that column j + d is reached with at most e edits. A row
    needs one mask of the columns that match its character; a row less, a column more or another
    character in the same place cost an edit, which are a shift right, a shift left and no shift.
    """
    t = threshold
    x, y = F.split(a, ""), F.split(b, "")
    m, n = F.char_length(a), F.char_length(b)
    band = F.lit((1 << (2 * t + 1)) - 1).cast("long")
    begin = F.struct(*[F.lit(sum(1 << (d + t) for d in range(e + 1))).cast("long").alias(f"r{e}") for e in range(t + 1)])
    # Row j comes with its character and the band's: the texts are cut up once, not in every step.
    none = F.lit(None).cast("string")
    shifted = [F.concat(F.array_repeat(none, -d), y) if d < 0 else F.slice(y, d + 1, F.greatest(n, F.lit(1))) for d in range(-t, t + 1)]
    size = F.greatest(m, F.lit(1))
    turns = F.when(m > 0, F.arrays_zip(*[F.slice(c, 1, size).alias(f"c{i}") for i, c in enumerate([x, *shifted])]))

    def step(state: Column, row: Column) -> Column:
        match = F.lit(0).cast("long")
        for i in range(2 * t + 1):
            match = match.bitwiseOR(F.when(row["c0"] == row[f"c{i + 1}"], 1 << i).otherwise(0).cast("long"))
        rows: list[Column] = []
        for e in range(t + 1):
            row = state[f"r{e}"].bitwiseAND(match)
            if e:
                less = state[f"r{e - 1}"]
                row = row.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(rows[-1], 1)).bitwiseAND(band)
            rows.append(row)
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(rows)])

    # A text without characters has no rows: its state is the first.
    last = F.coalesce(F.aggregate(turns, begin, step), begin)[f"r{t}"]
    at = F.greatest(F.least(n - m + t, F.lit(2 * t)), F.lit(0))
    return (F.abs(n - m) <= t) & (F.getbit(last, at) == 1)


def _linked(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.where(edit_within(F.col("x"), F.col("y"), threshold)).select("a", "b")


def _candidates(distinct: DataFrame) -> DataFrame:
    """id, key, own, head of the keys that a line is indexed by and another line shares; head is the smallest line indexed.

    Keys are counted before they meet (partial sums), and those of one line alone never reach the join.
    """
    marked = lambda c, own: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(own).alias("own")))
    keys = distinct.select("id", F.explode(F.concat(marked("index", True), marked("probe", False))).alias("k")).select("id", "k.key", "k.own")
    heads = keys.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("id"))).alias("head"), F.min("id").alias("low"), F.max("id").alias("high"))
    heads = cut(heads.where("head is not null and low < high").select("key", "head"), "heads")
    out = cut(Members(heads, "key").keep(keys, "key").join(heads, "key").select("id", "key", "own", "head"), "keys")
    discard(heads)
    return out


def line_classes(lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """id (hash of a distinct line), first (doc_id, place) of its component and n (its own rows), where the component has two rows or more."""
    length = F.char_length("line")
    full = lines.where("line <> ''").withColumn("id", F.xxhash64("line"))
    index, probe = (F.when(length >= min_chars, keys) for keys in join_keys(F.col("line"), length, threshold))
    distinct = full.select("id", F.struct("doc_id", "place").alias("at"), index.alias("index"), probe.alias("probe"))
    distinct = cut(distinct.groupBy("id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.first("index").alias("index"), F.first("probe").alias("probe")), "lines")

    keys = _candidates(distinct)
    named = keys.select("id").distinct()
    # An inner join, as a semi-join would be moved below the filter and shuffle every line.
    texts = Members(named, "id").keep(full.select("id", "line"), "id").join(named, "id")
    texts = cut(texts.groupBy("id").agg(F.first("line").alias("line")), "texts")

    tried = keys.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    tried = cut(tried, "tried")
    links = cut(_linked(tried, texts, threshold), "links")
    label = components(links).withColumnRenamed("node", "id")
    named = keys.select("id", "key").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = cut(named, "named")
    mixed = named.groupBy("key").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("key")
    named = named.join(mixed, "key").groupBy("id").agg(F.first("label").alias("label"))
    named = cut(named.join(texts, "id"), "mixed")
    one = deep_keys(named, threshold, None).toDF("u", "lu", "key")
    two = reduce(DataFrame.unionByName, [deep_keys(named, threshold, d) for d in range(threshold + 1)]).toDF("v", "lv", "probe")
    more = one.join(two, (F.col("key") == F.col("probe")) & (F.col("lu") != F.col("lv"))).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    more = more.join(tried, ["a", "b"], "left_anti")
    links = cut(links.unionByName(_linked(more, texts, threshold)), "links")
    label = components(links).withColumnRenamed("node", "id")
    for done in (texts, keys, tried):
        discard(done)
    # Lines without a link are classes of their own rows; the others' classes are few and small rows.
    linked = distinct.select("id", "first", "n").join(label, "id")
    top = linked.groupBy("label").agg(F.min("first").alias("first"))
    linked = linked.select("id", "label", "n").join(top, "label").select("id", "first", "n")
    alone = distinct.where("n > 1").select("id", "first", "n").join(label, "id", "left_anti")
    return linked.unionByName(alone)


def _with_first(lines: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """doc_id, place, first of lines; the rows of a line with many of them are dealt over several salts."""
    spark = lines.sparkSession
    share = max(1, (classes.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(spark)))
    hot = classes.where(F.col("n") > share).select("id", F.ceil(F.col("n") / share).cast("int").alias("salts"))  # at most 4 a partition
    rows = lines.select("doc_id", "place", F.when(F.col("line") != "", F.xxhash64("line")).alias("id"))
    if how == "inner":
        rows = Members(classes, "id").keep(rows, "id")
    rows = rows.join(F.broadcast(hot), "id", "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), "salts").cast("int"), F.lit(0)))
    spread = classes.join(F.broadcast(hot), "id", "left").select("id", "first", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return rows.join(spread, ["id", "salt"], how).select("doc_id", "place", "first")


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, place (from 0), kept: one row per line of each text."""
    lines = lines_of(docs, id_col, text_col)
    rows = _with_first(lines, cut(line_classes(lines, threshold, min_chars), "line-classes"), "left")
    return rows.select("doc_id", "place", (F.col("first").isNull() | F.struct("doc_id", "place").eqNullSafe(F.col("first"))).alias("kept"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, place of the lines that go."""
    lines = lines_of(docs, id_col, text_col)
    rows = _with_first(lines, cut(line_classes(lines, threshold, min_chars), "line-classes"), "inner")
    return rows.where(~F.struct("doc_id", "place").eqNullSafe(F.col("first"))).select("doc_id", "place")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the dropped lines taken out of the text."""
    gone = dropped_lines(docs, id_col, text_col, threshold, min_chars).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("place").alias("_gone"))
    rows = docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("_id")), "left")
    parts = F.transform(F.split(text_col, "\n"), lambda line, i: F.when(~F.coalesce(F.array_contains("_gone", i), F.lit(False)), line))
    return rows.select(*[(F.array_join(parts, "\n") if c == text_col else docs[c]).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped (places of the dropped lines, in order, joined by commas)."""
    docs = table(spark, sf_dir, "documents")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(text_of(), "\n")).cast("long").alias("n"), F.lit(None).cast("int").alias("place"))
    rows = every.unionByName(dropped_lines(docs).select("doc_id", F.lit(0).cast("long").alias("n"), "place"))
    rows = rows.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.count("place").alias("n_gone"), F.array_sort(F.collect_list("place")).alias("gone"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_gone")).alias("n_kept"), F.array_join(F.transform("gone", lambda p: p.cast("string")), ",").alias("dropped"))
