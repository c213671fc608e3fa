"""Packing of tokenised documents into windows of at most 2048 tokens.

Whole windows are cut off the front of long documents. What remains of each is cut into pieces of at
most 512 ids, since small pieces balance better, and packed in batches by Karmarkar-Karp multiway differencing: every item starts as a partial partition that holds it in one
window and nothing in the others, and the two partitions with the largest imbalance are merged,
largest windows against smallest, until one is left. If a window exceeds the capacity, the number of
windows rises and the batch is packed again. Batches lie within one partition of the input: nothing
is shuffled, and a task that is run again gives its whole partition again.

A null or empty text is the closing id alone. Repeated rows are packed as documents of their own;
an empty table gives no pieces. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

CAPACITY = 2048
#: The id after each document.
CLOSING = 1
#: Longest piece of what is packed in batches.
PIECE = 512
#: Items of a batch; a batch is closed when it has so many.
BATCH = 1024


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Characters whose classes (letter, number, white space) every version of the Unicode tables agrees on:
#: ASCII without rare controls, Latin, Cyrillic, usual punctuation, common Han characters.
_AGREED = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u4e00-\u9fa5]").search

_CONTROL = re.compile("[^\t\n\r\x20-\x7e]").search


class Ids:
    """Little-endian ids of whole texts as the tokenizers library gives them.

    A text goes whole through tiktoken with the ranks of the same file (its ids are in the order of its
    merges), which gives the same ids in less time, where the two libraries' pattern matchers can't
    differ; all else goes through tokenizers itself, as do texts that may hold a special token's string.
    """

    SPECIAL = "<|"

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte = {c: b for b, c in _byte_names().items()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def text(self, text: str) -> bytes:
        if self.SPECIAL in text or not text.isascii() and _AGREED(text) or text.isascii() and _CONTROL(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.quick(text)).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        return [self.text(t) if t else b"" for t in texts]


@lru_cache(2)
def ids_by(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of k windows of nearly equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, s in enumerate(sizes):
        # Only the windows that hold something are stored: (sum, items), largest first.
        heap.append((-s, i, [(s, [i])]))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= k:
            both = a + b
        else:
            # a's largest meet b's smallest; windows that are not stored are empty.
            over = len(a) + len(b) - k
            both = a[: len(a) - over] + b[: len(b) - over]
            both += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        both.sort(key=lambda w: -w[0])
        least = both[-1][0] if len(both) == k else 0
        base = [(s - least, items) for s, items in both] if least else both
        # Sums are kept relative to the smallest window; the imbalance is what orders the heap.
        heapq.heappush(heap, (-base[0][0], turn, base))
        turn += 1
    return [items for _, items in heap[0][2]]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of item numbers, none above the capacity; their number rises until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = [w for w in differencing(sizes, k) if w]
        most = max((sum(sizes[i] for i in w) for w in windows), default=0)
        if most <= capacity:
            return windows
        k += max(1, k // 100)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    closing = np.asarray([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        seq = TaskContext.get().partitionId() << 36
        rest: list[tuple[int | None, int, bytes, int]] = []

        def close() -> list[tuple]:
            nonlocal seq
            out = []
            for w in pack([len(r[2]) // 4 for r in rest], capacity):
                at = 0
                for i in w:
                    doc, start, ids, total = rest[i]
                    out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, at))
                    at += len(ids) // 4
                seq += 1
            rest.clear()
            return out

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for b in batches:
            ids_of = ids_by(path)
            ids_col, texts, out = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), []
            for lo in range(0, len(texts), 512):
                for doc, ids in zip(ids_col[lo : lo + 512], ids_of.texts(texts[lo : lo + 512]), strict=True):
                    ids += closing
                    total, start = len(ids) // 4, 0
                    while total - start >= capacity:
                        piece = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc, start, capacity, zlib.crc32(piece), total, seq, 0))
                        seq += 1
                        start += capacity
                    for at in range(start, total, PIECE):
                        rest.append((doc, at, ids[4 * at : 4 * (at + PIECE)], total))
                    if len(rest) >= batch:
                        out += close()
            if out:
                yield give(out)
        if rest:
            yield give(close())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
