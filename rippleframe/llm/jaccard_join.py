"""N-gram Jaccard join by vertical partitioning.

Shingles have a global order: by how many texts hold them, then by hash. The order is cut into fragments of
about the same number of shingles. Twice, what texts hold in a fragment is compared there and the counts are summed per pair:

* Candidates. In each fragment the texts that share a shingle of their prefixes (the first n - ceil(t n) + 1
  in the order) meet and their partial overlaps are counted. Length and position filters drop pairs that can't
  reach the threshold; no pair at or above it is lost. The sums choose whom a text is tried with first.
* Links. For the pairs to be tried, the partial overlaps of the whole sets are counted fragment by fragment, and
  the sum of a pair decides whether it is a link.

A shingle that the counts show in one text only can't be common to two; it keeps its place in the order but
isn't sent. Texts with the same set are one class from the start. A group of g texts that share a shingle does not
give g*g pairs: each text first meets only the group's heads (the one whose shingles are the most common, which
has the fewest edits of its own, and the smallest by a hash), and those found alike join components. Only where a
group still holds several components are the pairs between different components compared, in blocks of at
most BLOCK texts of neighbouring sizes, so a large group is many tasks and no link between components is missed.

The counts behind the order cover all texts in a sketch of fixed size (SKETCH places, a byte each when
collected); shingles that share a place share a count, which changes the cost, never the result. Null and empty
texts have no shingles and are linked with nothing. Repeated rows are a class. Sets are named by 64-bit hashes.
Columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, partitions, salted_join, table, text_of
from .graph import components
from .shingles import mix, shingle_sets, signature

#: Similarity in percent.
THRESHOLD = 80
#: Places of the sketch of counts, the rows that it travels in, and the shingles that a task holds before it adds them.
SKETCH, CHUNKS, HELD = 1 << 22, 64, 1_000_000
#: Sets that a task remembers, so as not to send them again; one that is sent twice counts once.
REMEMBERED = 500_000
#: Prefix entries that a fragment holds on average.
FRAGMENT = 600_000
#: Fragments of whole sets.
VERTICAL = 8
#: Texts of a group that are compared in one task.
BLOCK = 1024
#: The level of a shingle that was counted once.
ONCE = 8
_DESCRIBED = ["doc_id", "n", "sig", "chunk", "counts"]
_ENTRY = np.dtype([("token", "u1", 5), ("sig", "<i8"), ("n", "<u4"), ("place", "u1"), ("centre", "<u2")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for lo in range(0, len(ids), 256):
            yield ids[lo : lo + 256], shingle_sets(texts[lo : lo + 256])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts: doc_id, n, sig. Rows of the sketch: chunk, counts of its places."""
    seen: set[int] = set()
    counts = np.zeros(SKETCH, np.uint32)
    parts: list[np.ndarray] = []
    held = 0

    def add() -> None:
        place = np.concatenate(parts) & np.uint64(SKETCH - 1)
        np.add(counts, np.bincount(place.astype(np.int64), minlength=SKETCH).astype(np.uint32), out=counts)

    for ids, sets in _sets(batches):
        sigs = [signature(s) if len(s) else None for s in sets]
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], _DESCRIBED)
        for s, x in zip(sigs, sets, strict=True):
            if s is not None and s not in seen:
                seen.add(s)
                parts.append(x)
                held += len(x)
        if held >= HELD:
            add()
            parts, held = [], 0
            seen.clear()
    if parts:
        add()
    if counts.any():
        rows = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, -1)]
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(CHUNKS), pa.int64()), pa.array(rows, pa.binary())], _DESCRIBED)


def _levels(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of a chunk's counts as levels of an eighth of an octave, and how many shingles each level has."""
    total = np.zeros(SKETCH // CHUNKS, np.uint64)
    for c in rows["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.uint32)
    level = np.minimum(8 * np.log2(1 + total.astype(np.float64)), 255).astype(np.uint8)
    mass = np.bincount(level, total.astype(np.float64), 256)
    return pd.DataFrame({"chunk": [key[0]], "levels": [level.tobytes()], "mass": [mass.tobytes()]})


class Order:
    """The global order of shingles: levels of the sketch's places, and where each level begins, as a share of all."""

    def __init__(self, levels: np.ndarray, mass: np.ndarray):
        self.levels = levels
        mass = np.where(np.arange(256) > ONCE, mass, 0.0)  # others are never sent
        self.width = mass / max(mass.sum(), 1.0)
        self.begin = np.cumsum(self.width) - self.width

    def level(self, x: np.ndarray) -> np.ndarray:
        return self.levels[x & np.uint64(SKETCH - 1)]

    def fragment(self, x: np.ndarray, level: np.ndarray, fragments: int) -> np.ndarray:
        """Within a level by the hash's high half."""
        place = self.begin[level] + self.width[level] * ((x >> np.uint64(32)).astype(np.float64) / 2.0**32)
        return np.minimum((place * fragments).astype(np.int64), fragments - 1)


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n + (-n * threshold // 100) + 1


def _fits(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sizes and the places of the first common shingle (lower bounds) leave room for the threshold."""
    least = -(-threshold * (na + nb) // (100 + threshold))
    return (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) >= least)


def _prefixes(order: Order, fragments: int, threshold: int):
    """Rows (fragment, entries): the prefix entries of distinct sets, by fragment of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, int, int, int]] = []
        size = 0

        def give() -> pa.RecordBatch:
            lengths = [len(h[0]) for h in held]
            token = np.concatenate([h[0] for h in held])
            entry = np.zeros(len(token), _ENTRY)
            for k, name in enumerate(("sig", "n", "centre"), 2):
                entry[name] = np.repeat([h[k] for h in held], lengths)
            entry["place"] = np.concatenate([h[1] for h in held]) * 255 // np.maximum(entry["n"], 1)
            # Within a fragment the low 40 bits name a shingle; others that share them only cost a comparison.
            entry["token"] = token.view(np.uint8).reshape(-1, 8)[:, :5]
            # A range of the order, and within it a slice by hash: hot shingles that are neighbours in the order part.
            part = order.fragment(token, order.level(token), VERTICAL) * fragments + ((token >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by])) + 1
            rows = [(int(part[o[0]]), entry[o].tobytes()) for o in np.split(by, cuts)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["fragment", "entries"])

        for _, sets in _sets(batches):
            for x in sets:
                if not len(x) or (s := signature(x)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(s)
                level = order.level(x)
                by = np.argsort(level, kind="stable")[: prefix_length(len(x), threshold)]
                at = np.flatnonzero(level[by] > ONCE)
                if len(at):
                    held.append((x[by[at]], at, s, len(x), int(256 * level.mean())))
                    size += len(at)
            if size >= 1_000_000:
                yield give()
                held, size = [], 0
        if held:
            yield give()

    return run


_PAIRS = "a long, b long, overlap long, run long, sig long, n long, place double"


def _meet(threshold: int):
    """In a fragment: pairs of texts with the heads of their groups, and the groups of three and more."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        entry = np.frombuffer(b"".join(rows["entries"]), _ENTRY)
        token = np.zeros((len(entry), 8), np.uint8)
        token[:, :5] = entry["token"]
        token = token.view(np.uint64).ravel()
        sig, n = entry["sig"].astype(np.int64), entry["n"].astype(np.int64)
        place, centre = entry["place"].astype(np.int64) * n // 255, entry["centre"].astype(np.int64)
        order = np.lexsort((sig, token))
        token, sig, n, place, centre = token[order], sig[order], n[order], place[order], centre[order]
        keep = np.concatenate([[True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])])
        token, sig, n, place, centre = token[keep], sig[keep], n[keep], place[keep], centre[keep]
        first = np.concatenate([[True], token[1:] != token[:-1]])
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        some = size[group] > 1
        token, sig, n, place, group, centre = token[some], sig[some], n[some], place[some], group[some], centre[some]
        if not len(token):
            return pd.DataFrame(columns=["a", "b", "overlap", "run", "sig", "n", "place"])
        _, group = np.unique(group, return_inverse=True)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        size = np.diff(np.concatenate([begin, [len(group)]]))
        pairs = []
        with np.errstate(over="ignore"):
            h = mix(sig.astype(np.uint64) ^ np.uint64(0x1234567))
            for by in (np.lexsort((h, -centre, group)), np.lexsort((h, group))):
                head = by[begin][group]
                ok = (sig[head] != sig) & _fits(n, place, n[head], place[head], threshold)
                pairs.append(np.stack([np.minimum(sig[ok], sig[head][ok]), np.maximum(sig[ok], sig[head][ok])], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
        out["overlap"] = _overlaps(pairs, sig, token)
        out = out.assign(run=pd.NA, sig=pd.NA, n=pd.NA, place=np.nan)
        # Groups of three and more, those with the same members once (at their earliest places).
        with np.errstate(over="ignore"):
            name = np.add.reduceat(mix(sig.astype(np.uint64) * np.uint64(3)), begin).astype(np.int64)
        large = size[group] > 2
        runs = pd.DataFrame({"run": name[group][large], "sig": sig[large], "n": n[large], "place": place[large] / n[large]})
        runs = runs.groupby(["run", "sig"], as_index=False).agg(n=("n", "first"), place=("place", "min"))
        runs = runs.assign(a=pd.NA, b=pd.NA, overlap=pd.NA)
        return pd.concat([out, runs], ignore_index=True)[["a", "b", "overlap", "run", "sig", "n", "place"]]

    return run


def _overlaps(pairs: np.ndarray, sig: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Common shingles of each pair among the entries (sig, token) of one fragment."""
    order = np.lexsort((token, sig))
    sig, token = sig[order], token[order]
    names, begin = np.unique(sig, return_index=True)
    end = np.append(begin[1:], len(sig))
    out = np.zeros(len(pairs), np.int64)
    left, right = np.searchsorted(names, pairs[:, 0]), np.searchsorted(names, pairs[:, 1])
    for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[i] = len(np.intersect1d(token[begin[x] : end[x]], token[begin[y] : end[y]], assume_unique=True))
    return out


def _pieces(order: Order):
    """Rows (sig, n, pieces): what the sets that are asked for hold in each fragment of the order, once for each set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sigs, texts, rows = b.column("sig").to_pylist(), b.column("text").to_pylist(), []
            for lo in range(0, len(sigs), 256):
                for s, x in zip(sigs[lo : lo + 256], shingle_sets(texts[lo : lo + 256]), strict=True):
                    # An id may stand on several texts, and a set on several rows.
                    if not len(x) or s in seen or signature(x) != s:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(s)
                    level = order.level(x)
                    y = x[level > ONCE]
                    part = order.fragment(y, level[level > ONCE], VERTICAL)
                    rows.append((s, len(x), [y[part == f].tobytes() for f in range(VERTICAL)]))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.binary())), strict=True)], ["sig", "n", "pieces"])

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The common shingles of a pair, counted in each fragment by itself."""
    for b in batches:
        common = [
            [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) if p and q else 0 for p, q in zip(x, y, strict=True)]
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(common, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "parts"])


def _block_pairs(mixed: DataFrame, threshold: int) -> DataFrame:
    """Members of runs (run, sig, n, place, label, tried), once for each pair of blocks that they are in: with pair (its name) and part.

    A run of at most BLOCK members is one block. Larger ones are parted by size into bands, of which only neighbours can
    hold links, and bands by hash into blocks.
    """
    base = F.log(F.lit(100.0 / threshold))
    mixed = mixed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / base + 1e-9).cast("long"))
    sizes = mixed.groupBy("run", "band").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.groupBy("run").agg(F.sum("members").alias("all")).where(F.col("all") > BLOCK).select("run")
    small = mixed.join(large, "run", "left_anti").select("sig", "n", "place", "label", "tried", F.col("run").alias("pair"), F.lit(0).cast("long").alias("part"))
    sizes = sizes.join(large, "run").select("run", "band", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    around = sizes.select("run", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("band").alias("other"), "blocks")
    around = around.groupBy("run", "band").agg(F.collect_list(F.struct("other", "blocks")).alias("near"))  # at most three
    rows = mixed.join(around, ["run", "band"]).withColumn("mine", F.expr("filter(near, x -> x.other = band)[0].blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("mine")).cast("int"))
    rows = rows.select("*", F.explode("near").alias("o")).select("*", F.explode(F.sequence(F.lit(0), F.col("o.blocks") - 1)).alias("with"))
    # A pair of blocks is named by its lower one first; in a block with itself all have the same part.
    here, there = F.struct("band", "block"), F.struct(F.col("o.other").alias("band"), F.col("with").alias("block"))
    low, high = F.least(here, there), F.greatest(here, there)
    pair = F.xxhash64("run", low["band"], low["block"], high["band"], high["block"])
    part = F.when((F.col("band") == F.col("o.other")) & (F.col("block") == F.col("with")), 0).when(low["band"] * 1_000_000 + low["block"] == F.col("band") * 1_000_000 + F.col("block"), 1).otherwise(2)
    return small.unionByName(rows.select("sig", "n", "place", "label", "tried", pair.alias("pair"), part.cast("long").alias("part")))


def _cross(members: DataFrame, threshold: int) -> DataFrame:
    """a, b: the pairs of a block, or of two, between different components that the filters leave and that weren't tried yet.

    Blocks are bounded, so a key has few rows; keys are dealt over all tasks, however few bytes they are.
    """
    members = members.withColumn("left", F.col("n") - F.floor(F.col("place") * F.col("n") + 1e-9))
    members = members.repartition(partitions(members.sparkSession), "pair")
    x, y = members.alias("x"), members.alias("y")
    v = lambda side, c: F.col(f"{side}.{c}")
    order = F.when(v("x", "part") == 0, v("x", "sig") < v("y", "sig")).otherwise(v("x", "part") < v("y", "part"))
    sizes = (100 * F.least(v("x", "n"), v("y", "n"))) >= (threshold * F.greatest(v("x", "n"), v("y", "n")))
    room = (100 + threshold) * F.least(v("x", "left"), v("y", "left")) >= threshold * (v("x", "n") + v("y", "n"))
    new = ~F.array_contains(v("x", "tried"), v("y", "sig")) & ~F.array_contains(v("y", "tried"), v("x", "sig"))
    on = (v("x", "pair") == v("y", "pair")) & (v("x", "label") != v("y", "label")) & order & sizes & room & new
    both = x.join(y.hint("shuffle_hash"), on)
    return both.select(F.least(v("x", "sig"), v("y", "sig")).alias("a"), F.greatest(v("x", "sig"), v("y", "sig")).alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id among all texts reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    seen = cut(rows.mapInArrow(_describe, "doc_id long, n long, sig long, chunk long, counts binary"), "sets")
    texts = seen.where("chunk is null").select("doc_id", "n", "sig")
    sketch = seen.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(_levels, "chunk long, levels binary, mass binary")
    levels, mass = np.zeros((CHUNKS, SKETCH // CHUNKS), np.uint8), np.zeros(256)
    for row in sketch.collect():  # at most CHUNKS rows
        levels[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
        mass += np.frombuffer(row["mass"])
    order = Order(levels.ravel(), mass)

    sets = texts.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    sets = cut(sets, "classes")
    held = sets.agg(F.sum("n")).first()[0] or 0
    fragments = max(1, partitions(spark), int(held * (100 - threshold) // 100 // FRAGMENT))
    entries = rows.select("doc_id", "text").mapInArrow(_prefixes(order, fragments, threshold), "fragment long, entries binary")
    met = cut(entries.groupBy("fragment").applyInPandas(_meet(threshold), _PAIRS), "met")

    pairs = met.where("a is not null").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    best = sides.groupBy("a").agg(
        F.min_by("b", F.xxhash64("b")).alias("x"), F.max_by("b", F.struct("overlap", F.xxhash64("b"))).alias("y"), F.min_by("b", F.xxhash64("b", F.lit(1))).alias("z")
    )
    best = cut(best.select(F.col("a").alias("sig"), F.array("x", "y", "z").alias("tried")), "best")
    chosen = best.select(F.col("sig").alias("a"), F.explode("tried").alias("b"))
    chosen = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def linked(chosen: DataFrame, name: str) -> DataFrame:
        chosen = cut(chosen, f"{name}-pairs")
        need = chosen.select("a").union(chosen.select("b")).distinct().join(sets.select(F.col("sig").alias("a"), "doc_id"), "a")
        got = rows.join(need, rows["doc_id"].eqNullSafe(need["doc_id"])).select(F.col("a").alias("sig"), "text")
        # A set that several tasks sent must stand once.
        got = got.mapInArrow(_pieces(order), "sig long, n long, pieces array<binary>").dropDuplicates(["sig"])
        got = cut(got, f"{name}-pieces")
        both = chosen.join(got.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("pieces").alias("x")), "a")
        both = both.join(got.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pieces").alias("y")), "b")
        sums = both.select("a", "b", "na", "nb", "x", "y").mapInArrow(_partial, "a long, b long, na long, nb long, parts array<long>")
        sums = sums.withColumn("overlap", F.aggregate("parts", F.lit(0).cast("long"), lambda t, n: t + n))
        enough = 100 * F.col("overlap") >= threshold * (F.col("na") + F.col("nb") - F.col("overlap"))
        out = cut(sums.where(enough).select("a", "b"), f"{name}-links")
        discard(got)
        return out

    links = linked(chosen, "heads")
    label = components(links)
    runs = met.where("run is not null").groupBy("run", "sig").agg(F.first("n").alias("n"), F.min("place").alias("place"))
    runs = runs.join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    runs = runs.join(best, "sig", "left").withColumn("tried", F.coalesce("tried", F.array().cast("array<long>")))
    runs = cut(runs, "runs")
    mixed = runs.groupBy("run").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("run")
    cross = _cross(cut(_block_pairs(cut(runs.join(mixed, "run"), "mixed"), threshold), "blocks"), threshold)
    # Pairs of two are tried already, and so are those with a head; groups of two hold just such a pair.
    small = pairs.select("a", "b").join(label.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a", "left")
    small = small.join(label.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b", "left")
    small = small.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    more = cross.unionByName(small).distinct().join(chosen, ["a", "b"], "left_anti")
    links = links.unionByName(linked(more, "rest"))
    label = components(links)

    named = sets.join(label.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("label", "sig").alias("label"))
    named = cut(named, "named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = salted_join(named.select("sig", "label"), least, "label").select("sig", "component_id")
    out = salted_join(texts, named, "sig")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
