"""Byte-level BPE encoding and decoding.

Three steps:

* ``distinct_words`` counts the words (matches of the pattern) of all texts, map-side first.
* ``fold_merges`` folds the ranked merges over the byte arrays of the distinct words that are broadcast in Spark's higher-order
  functions: the state is an array of binary pieces, a step joins the leftmost pair of the smallest rank, and
  ranks come from a literal map (small maps found by a checksum). Decoding concatenates the binary pieces.
* ``encode_texts`` gives every worker the folded words, by a broadcast of at most MOST_WORDS, and puts texts
  together from them: a text is cut at single spaces, and the ids of each distinct chunk are looked up once.

Words over LONG bytes, whose fold would take the square of their length, and words that are rarer than what
the broadcast holds are folded where they occur, by the same rule (``merge``); results don't depend on it.

A null text is empty: no ids, and the digests of nothing. A null word has no ids. Repeated rows are encoded row by
row. The id keeps its type. Columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, partitions, table, text_of

#: Distinct chunks, and distinct words, that a worker keeps; only its memory and time depend on them.
CHUNKS, WORDS = 300_000, 1_000_000
#: Words that are broadcast, the most frequent ones (some 100 bytes each), and the longest that Spark folds.
MOST_WORDS, LONG = 200_000, 96
#: Characters of a plan's description while the literal is in it: Spark keeps the descriptions of past queries on the driver.
PLAN_TEXT = 5_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of one word: the pair of the smallest rank is merged, leftmost first, until none has a rank."""
    if word in ranks:
        return [word]
    n = len(word)
    if n > 64:
        return _merge_long([word[i : i + 1] for i in range(n)], ranks)
    get, none = ranks.get, 1 << 60
    at = list(range(n + 1))  # where pieces begin, and the end
    pair = [get(word[i : i + 2], none) for i in range(n - 1)]
    while pair and (best := min(pair)) != none:
        i = pair.index(best)
        del pair[i], at[i + 1]
        if i:
            pair[i - 1] = get(word[at[i - 1] : at[i + 1]], none)
        if i < len(pair):
            pair[i] = get(word[at[i] : at[i + 2]], none)
    return [word[a:b] for a, b in pairwise(at)]


def _merge_long(pieces: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The same for long words: a heap of pairs over a linked list, n log n."""
    import heapq

    n = len(pieces)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(r, i, pieces[i], pieces[i + 1]) for i in range(n - 1) if (r := ranks.get(pieces[i] + pieces[i + 1])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if i >= 0 and (j := right[i]) >= 0 and (r := ranks.get(pieces[i] + pieces[j])) is not None:
            heapq.heappush(heap, (r, i, pieces[i], pieces[j]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or pieces[i] != a or pieces[j] != b:
            continue
        pieces[i], alive[j], right[i] = a + b, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        push(left[i])
        push(i)
    return [p for p, ok in zip(pieces, alive, strict=True) if ok]


_TWO = re.compile(r"\s\s").search
#: ASCII marks: one of the pattern's matches if nothing else stands among them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _edge(text: str) -> bool:
    """Whether white space stands beside white space or at an end."""
    return text[:1].isspace() or text[-1:].isspace() or _TWO(text) is not None


def chunks_of(text: str) -> list[str]:
    """Cuts text before single spaces that stand between other characters than white space. No match
    of the pattern crosses such a cut, so the chunks can be encoded one by one."""
    parts = text.split(" ")
    out = parts[:1]
    for p in parts[1:]:
        last = out[-1]
        if not p or p[0].isspace() or not last or last[-1].isspace():
            out[-1] = f"{last} {p}"
        else:
            out.append(f" {p}")
    return out


class Table(dict):
    """Values of short strings, made when first asked for; the older half goes when the table is full."""

    def __init__(self, make: Callable[[str], object], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> object:
        value = self.make(key)
        if len(key) <= 64 and len(self) < self.most:
            self[key] = value
        else:
            keep(self, key, value, self.most)
        return value


def keep(cache: dict, key: str, value: object, most: int) -> None:
    if len(key) <= 64:
        if len(cache) >= most:
            for old in list(islice(cache, most // 2)):
                del cache[old]
        cache[key] = value


class Chunks:
    """Values of all chunks of a text in order, by way of tables of distinct chunks and words."""

    def __init__(self, word: Callable[[str], object], chunk: Callable[[str], object]):
        self.words, self.chunks = Table(word, WORDS), Table(chunk, CHUNKS)
        #: Chunks by what follows their space.
        self.spaced = Table(lambda rest: self.words[" " + rest] if rest.isalpha() else chunk(" " + rest), CHUNKS)

    def of(self, text: str) -> list:
        if _edge(text):
            return list(map(self.chunks.__getitem__, chunks_of(text)))
        first, *rest = text.split(" ")  # every space stands alone
        return [self.chunks[first], *map(self.spaced.__getitem__, rest)]


def matches(chunk: str, find: Callable[[str], list[str]]) -> list[str]:
    """The pattern's matches in a chunk; letters with marks after them are seen without the pattern."""
    bare = chunk.rstrip(_MARKS)
    if bare.removeprefix(" ").isalpha():
        return [bare, chunk[len(bare) :]] if len(bare) < len(chunk) else [bare]
    return find(chunk)


def _finder():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


class Encoder:
    """Ids, and the bytes that they decode to, of whole texts; known words are (ids joined by commas, bytes)."""

    def __init__(self, path: str, known: dict[str, tuple[str, bytes]]):
        self.ranks, self.known, self.find = load_ranks(path), known, _finder()
        self.names = {b: str(i) for b, i in self.ranks.items()}
        self.pieces = {i: b for b, i in self.names.items()}
        self.chunks = Chunks(self.word, self.chunk)

    def word(self, word: str) -> tuple[str, bytes]:
        if (got := self.known.get(word)) is not None:
            return got
        ids = [self.names[p] for p in merge(word.encode(), self.ranks)]
        return ",".join(ids), b"".join([self.pieces[i] for i in ids])

    def chunk(self, chunk: str) -> tuple[str, bytes]:
        parts = [self.chunks.words[m] for m in matches(chunk, self.find)]
        if len(parts) == 2:
            (a, x), (b, y) = parts
            return f"{a},{b}", x + y
        return ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def text(self, text: str) -> tuple[int, str, str]:
        if not text:
            return 0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest()
        got = self.chunks.of(text)
        ids = ",".join([g[0] for g in got]).encode()
        return ids.count(b",") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join([g[1] for g in got])).hexdigest()


def _count_words(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of up to LONG bytes that a task has so often, added up over the task while they fit."""
    find, chunks, spaced, words = _finder(), Counter(), Counter(), Counter()

    def add() -> None:
        for chunk, n in chunks.items():
            if n >= least:  # words of rarer chunks aren't frequent, or are so in others
                for w in matches(chunk, find):
                    words[w] += n
        chunks.clear()

    def give() -> pa.RecordBatch:
        some = {w: n for w, n in words.items() if n >= least and len(w) <= LONG and len(w.encode()) <= LONG}
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(some.keys(), pa.string()), pa.array(some.values(), pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column("text").to_pylist():
            if _edge(text):
                chunks.update(chunks_of(text))
            else:
                first, *rest = text.split(" ")  # every space stands alone
                chunks[first] += 1
                spaced.update(rest)
            if len(chunks) + len(spaced) >= CHUNKS:
                chunks.update({f" {c}": n for c, n in spaced.items()})
                spaced.clear()
                add()
        if len(words) >= WORDS:
            yield give()
    chunks.update({f" {c}": n for c, n in spaced.items()})
    add()
    if words:
        yield give()


def distinct_words(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """word, n of all words of up to LONG bytes; with least, of those that some task has so often, counted there."""
    return docs.select(text_of(text_col).alias("text")).mapInArrow(lambda b: _count_words(b, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rank_literal(path: str, buckets: int) -> Column:
    """The rank map as one literal: an array of small maps from bytes in hex to rank, found by checksum. The optimizer folds it into a constant."""
    slots: list[dict[str, int]] = [{} for _ in range(buckets)]
    for word, i in load_ranks(path).items():
        slots[zlib.crc32(word) % buckets][word.hex().upper()] = i
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def fold_merges(words: DataFrame, path: str, word_col: str = "word", buckets: int = 1 << 13) -> DataFrame:
    """word, ids (array<int>), decoded (binary) of a table of distinct words, in higher-order functions.

    The state is the array of binary pieces; each step merges the leftmost pair of the smallest rank.
    """
    ranks = rank_literal(path, buckets)
    rank = lambda p: F.try_element_at(F.get(ranks, (F.crc32(p) % buckets).cast("int")), F.hex(p))
    raw = F.col(word_col).cast("binary")

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: F.struct(rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        merged = lambda i: F.concat(F.slice(pieces, 1, i), F.array(F.concat(F.get(pieces, i), F.get(pieces, i + 1))), F.slice(pieces, i + 3, F.size(pieces)))
        return F.when(F.size(pieces) < 2, pieces).otherwise(F.coalesce(merged(best["i"]), pieces))

    size = F.octet_length(word_col)
    single = F.when(size == 0, F.array().cast("array<binary>")).otherwise(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(raw, i, F.lit(1))))
    # Most words are pieces themselves; others need fewer merges than they have bytes.
    turns = F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
    pieces = F.when(rank(raw).isNotNull(), F.array(raw)).otherwise(F.aggregate(turns, single, step))
    out = words.select(word_col, pieces.alias("pieces"))
    decoded = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p))
    return out.select(word_col, F.transform("pieces", rank).alias("ids"), decoded.alias("decoded"))


def folded_words(docs: DataFrame, path: str, text_col: str = "text", most: int = MOST_WORDS) -> dict[str, tuple[str, bytes]]:
    """The ids and bytes of the most frequent words of docs, at most about most of them, on the driver."""
    # A word that no task has twice isn't among the frequent ones.
    words = cut(distinct_words(docs, text_col, 2), "words")
    n = words.count()
    if n > most:
        least = words.agg(F.percentile_approx("n", 1 - most / n, 100_000)).first()[0]
        frequent = words.where(F.col("n") > least)
    else:
        frequent = words
    # The rows are few and their work is much: they are dealt over all tasks.
    conf, name = docs.sparkSession.conf, "spark.sql.maxPlanStringLength"
    before = conf.get(name)
    conf.set(name, str(PLAN_TEXT))
    try:
        folded = cut(fold_merges(frequent.repartition(partitions(docs.sparkSession)).select("word"), path), "folded")
    finally:
        conf.set(name, before)
    got = folded.select("word", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "decoded").toArrow()
    discard(words)
    discard(folded)
    return dict(zip(got["word"].to_pylist(), zip(got["ids"].to_pylist(), got["decoded"].to_pylist(), strict=True), strict=True))


_ENCODERS: dict[tuple, Encoder] = {}


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(folded_words(docs, path, text_col, most))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One for each Python worker and call: workers live longer than tasks.
        e = _ENCODERS.get((name,))
        if e is None:
            _ENCODERS.clear()
            e = _ENCODERS[(name,)] = Encoder(path, sent.value)
        for b in batches:
            found = [e.text(t) for t in b.column("text").to_pylist()]
            n, ids, back = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary())
