"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words counts their common subsequences of three characters, each weighted by
DECAY to the length that it spans (up to SPAN), and is divided by a norm for each word's length, so gaps
and inserted characters lower it only gradually. Landmarks are words of both classes; the Nyström
map K(w, L) K(L, L)^-1/2 turns words into vectors for a linear machine with squared hinge loss.

Labels belong to whole texts, so the machine learns from their words, the windows of their sentences that an insult
fills. Every word of a clean text is a negative example; of a toxic text the
word that scores highest stands for it, and is chosen anew in each round. A text's evidence are its TOP highest
words and its number of distinct words, which logistic regression on the labelled texts turns into a probability.
Fitting uses at most TRAIN_TOXIC toxic and TRAIN_CLEAN clean labelled texts (those with the smallest id hashes), of
which the driver gets at most TRAIN_WORDS distinct words each. Every text is scored whole: the weights are one table of
subsequences, so a word costs one pass over its own.

A text that is null, or has no word of three characters, scores as a text without any toxic word. Without
labels of both classes every text scores 0. Null labels and repeated labels of an id are allowed (any
toxic one makes the text toxic). Columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import keep
from .common import table, text_of

#: Bounds of the sample that the classifier is fitted on.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 5000
#: Distinct words of a text that it is fitted on.
TRAIN_WORDS = 2000
LANDMARKS = 160
DECAY, SPAN = 0.6, 8
#: Longer words are taken in overlapping windows of this length.
WIDTH = 24
SYMBOLS = 64
ROUNDS = 3
#: Words of a text that its probability rests on, and the least value of one.
TOP, LOW = 4, -3.0
#: Scores of words that a worker keeps.
KNOWN = 500_000
RIDGE = 1.0

#: Single characters set apart, such as "a b.c-d": their letters make one word more.
_APART = re.compile(r"(?<!\w)\w(?:[\s.*_~+-]{1,2}\w){2,}(?!\w)")


def words_of(text: str) -> set[str]:
    """Distinct raw words in lower case, with the words that set-apart characters spell."""
    low = text.lower()
    out = set(low.split())
    out.update("".join(c for c in m.group() if c.isalnum()) for m in _APART.finditer(low))
    return out


@lru_cache(1)
def _symbols() -> np.ndarray:
    at = 37 + np.arange(1 << 16) % (SYMBOLS - 37)
    at[97:123] = np.arange(1, 27)
    at[48:58] = np.arange(27, 37)
    return at.astype(np.int64)


@lru_cache(64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k within SPAN, and their weights over the norm of the length."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = np.array(found, np.int64).reshape(-1, 3).T
    g = DECAY ** (k - i + 1.0)
    return i, j, k, g / np.sqrt((g * g).sum()) if len(g) else g


def variants(word: str) -> list[str]:
    """What of a raw word is scored: without outer marks, and its letters and digits alone if it has inner marks."""
    if word.isalnum():
        bare, only = word, word
    else:
        only = "".join(c for c in word if c.isalnum())
        bare = word.strip("".join({c for c in word if not c.isalnum()}))
    out = []
    for w in {bare, only}:
        out += [w] if len(w) <= WIDTH else [w[a : a + WIDTH] for a in range(0, len(w) - WIDTH // 2, WIDTH // 2)]
    return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: rows of words, their subsequences (rows x triples) and the weights."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[lengths >= 3]):
        rows = np.flatnonzero(lengths == n)
        for lo in range(0, len(rows), 20_000):
            part = rows[lo : lo + 20_000]
            code = np.frombuffer("".join([words[r] for r in part]).encode("utf-32-le", "replace"), "<u4").reshape(len(part), n)
            sym = _symbols()[code & 0xFFFF]
            i, j, k, g = _triples(int(n))
            yield part, (sym[:, i] * SYMBOLS + sym[:, j]) * SYMBOLS + sym[:, k], g


def raw_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The machine's value of each word: the weighted sum of its subsequences, without the bias."""
    out = np.zeros(len(words))
    for rows, idx, g in by_length(words):
        out[rows] = weights[idx] @ g
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    dims: dict[int, int] = {}
    feats = []
    for rows, idx, g in by_length(landmarks):
        for r, ids in zip(rows, idx, strict=True):
            feats.append((r, ids, g))
            for u in ids.tolist():
                dims.setdefault(u, len(dims))
    at = np.full(SYMBOLS**3, len(dims), np.int64)
    at[list(dims)] = list(dims.values())
    d = len(dims) + 1
    phi = np.zeros((d, len(landmarks)))
    for r, ids, g in feats:
        np.add.at(phi[:, r], at[ids], g)
    phi[-1] = 0
    out = np.zeros((len(words), len(landmarks)))
    for rows, idx, g in by_length(words):
        some = max(1, 4_000_000 // d)
        for lo in range(0, len(rows), some):
            ids = at[idx[lo : lo + some]]
            flat = (np.arange(len(ids))[:, None] * d + ids).ravel()
            x = np.bincount(flat, np.broadcast_to(g, ids.shape).ravel(), len(ids) * d).reshape(len(ids), d)
            out[rows[lo : lo + some]] = x @ phi
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Linear machine, squared hinge loss, by Newton steps; the last coordinate of x is the bias."""
    v = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(30):
        on = y * (x @ v) < 1
        xs, ws = x[on], weight[on]
        new = np.linalg.solve(xs.T @ (xs * ws[:, None]) + np.diag(reg), xs.T @ (ws * y[on]))
        if np.abs(new - v).max() < 1e-8:
            break
        v = new
    return v


def fit(texts: Iterable[tuple[str, int]]) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Table of subsequence weights, bias, and the weights of a text's evidence."""
    toxic: list[list[str]] = []
    clean: list[list[str]] = []
    same: dict[str, str] = {}  # one object for each distinct word
    for text, y in texts:
        words = sorted({same.setdefault(v, v) for w in text.split() for v in variants(w) if len(v) >= 3})
        (toxic if y else clean).append(words)
    if not toxic or not clean:
        return None
    in_t, in_c = Counter(w for ws in toxic for w in ws), Counter(w for ws in clean for w in ws)
    odds = lambda w: np.log((in_t[w] + 0.1) / (len(toxic) + 1)) - np.log((in_c[w] + 0.5) / (len(clean) + 1))
    rank = {w: odds(w) * np.log1p(in_t[w]) for w in in_t}
    order = sorted(rank, key=lambda w: (-rank[w], w))
    landmarks: list[str] = []
    likely = [w for w in order if in_c[w] * 20 <= in_t[w]][: 8 * LANDMARKS]
    if likely:
        taken: list[int] = []
        near = np.zeros(len(likely))
        for i, w in enumerate(likely):
            if len(taken) < LANDMARKS // 2 and near[i] < 0.8 * kernel([w], [w])[0, 0]:
                taken.append(i)
                near = np.maximum(near, kernel(likely, [w])[:, 0])
        landmarks = [likely[i] for i in taken]
    usual = [w for w, _ in sorted(in_c.items(), key=lambda x: (-x[1], x[0])) if len(w) > 3 and w not in landmarks]
    landmarks += usual[: LANDMARKS - len(landmarks)]
    if not landmarks:
        return None
    kll = kernel(landmarks, landmarks)
    val, vec = np.linalg.eigh((kll + kll.T) / 2)
    root = vec / np.sqrt(np.maximum(val, 1e-6)) @ vec.T

    negatives = {w for w in in_c if zlib_bucket(w) < 12_000 * 1000 // max(len(in_c), 1)} | set(usual[:3000])
    every = sorted(in_t.keys() | in_c.keys())
    place = {w: i for i, w in enumerate(every)}
    stand = {max(ws, key=lambda w: (rank[w], w)) for ws in toxic if ws}
    stand = {w for w in stand if in_t[w] > 1 and odds(w) > 1}
    for _ in range(ROUNDS):
        if not stand:
            return None
        negatives -= {w for w in stand if not in_c[w]}
        # Each stands with a copy that has a character put in, so that such spellings stay on its side.
        pos = sorted(stand)
        pos += sorted({w[:a] + c + w[a:] for w in pos for a, c in ((len(w) // 3, "x"), (len(w) // 2, "e"), (2 * len(w) // 3, "a")) if len(w) >= 5} - in_c.keys())
        neg = sorted(negatives - stand)
        x = kernel(pos + neg, landmarks) @ root
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        weight = np.where(y > 0, max(1.0, 0.2 * len(neg) / len(pos)), 1.0)
        v = svm(x, y, weight)
        beta, bias = root @ v[:-1], v[-1]
        weights = np.zeros(SYMBOLS**3)
        for rows, idx, g in by_length(landmarks):
            for r, ids in zip(rows, idx, strict=True):
                np.add.at(weights, ids, beta[r] * g)
        value = raw_scores(every, weights) + bias
        hard = [w for w in in_c if value[place[w]] > -0.6]
        negatives |= set(sorted(hard, key=lambda w: (-value[place[w]], w))[:6000])
        stand = {max(ws, key=lambda w: (value[place[w]], w)) for ws in toxic if ws}
        stand = {w for w in stand if value[place[w]] > 0 and in_c[w] * 20 <= in_t[w]}
    x = np.array([evidence([value[place[w]] for w in ws]) for ws in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    return weights.astype(np.float32), float(bias), logistic(x, y)


def evidence(values: list[float]) -> list[float]:
    """What a text's probability rests on: its TOP highest words, and how many words it has, as many words reach high by chance."""
    top = heapq.nlargest(TOP, values)
    top += [LOW] * (TOP - len(top))
    return [max(v, LOW) for v in top] + [float(np.log1p(len(values)))]


def zlib_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % 1000


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the evidence and the offset of P(y) = 1 / (1 + exp(-z)), slightly ridged, by Newton steps; each word's weight is at least 0."""
    x = np.hstack([x, np.ones((len(x), 1))])
    free, v = np.ones(x.shape[1], bool), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = x.T @ (y - p) - 1e-1 * v
        hess = (x.T * w) @ x + 1e-1 * np.eye(len(v))
        step = np.zeros(len(v))
        step[free] = np.clip(np.linalg.solve(hess[np.ix_(free, free)], grad[free]), -2, 2)
        v = v + step
        v[:TOP] = np.maximum(v[:TOP], 0.0)
        if np.abs(step).max() < 1e-9:
            break
    return v


class Scorer:
    def __init__(self, model: tuple[np.ndarray, float, np.ndarray]):
        self.weights, self.bias, self.final = model
        self.known: dict[str, float] = {}

    def texts(self, texts: list[str]) -> list[float]:
        sets = [words_of(t) for t in texts]
        new = list({w for ws in sets for w in ws if w not in self.known})
        parts, owner = [], []
        for i, w in enumerate(new):
            for v in variants(w):
                if len(v) >= 3:
                    parts.append(v)
                    owner.append(i)
        best = np.zeros(len(new))
        if parts:
            best[:] = -np.inf
            np.maximum.at(best, owner, raw_scores(parts, self.weights))
            best[np.isinf(best)] = 0
        fresh = dict(zip(new, best.tolist(), strict=True))
        known = self.known
        x = np.array([evidence([(fresh[w] if w in fresh else known[w]) + self.bias for w in ws]) for ws in sets]).reshape(len(sets), TOP + 1)
        for w, f in fresh.items():
            keep(known, w, f, KNOWN)
        z = x @ self.final[:-1] + self.final[-1]
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple | None:
    """Learns from labelled rows that are not held out; None without examples of both classes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [words_of(t) for t in b.column("text").to_pylist()]
            # A longer text is learnt from by a sample of its words, so that the driver's share is bounded.
            words = [" ".join(sorted(ws if len(ws) <= TRAIN_WORDS else sorted(ws, key=lambda w: zlib.crc32(w.encode("utf-8", "replace")))[:TRAIN_WORDS])) for ws in sets]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), b.column("y")], ["words", "y"])

    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, TRAIN_TOXIC).unionByName(pick(0, TRAIN_CLEAN))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.select("text", "y").mapInArrow(split, "words string, y int").collect()
    return fit([(r["words"], r["y"]) for r in sorted(got, key=lambda r: (r["y"], r["words"]))])


def score(docs: DataFrame, model: tuple | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = spark.sparkContext.broadcast(model)  # a fixed size: 64^3 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for lo in range(0, len(texts), 512):
                out += s.texts(texts[lo : lo + 512])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
