"""Secret scans through an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger, a Parquet table in
the shared folder, holds the pairs (blob, rule version) that were scanned already with what was found. A run
hashes all rows, scans only the pairs that the ledger lacks, appends their findings and joins the
ledger's findings back to all rows that hold the blob. The rule version is a checksum of the rules, so that a
changed rule is scanned anew. A ledger belongs to a corpus (its path); the second run over it scans nothing.

Texts are scanned where they are read: on an empty ledger no text is shuffled, and copies within a task are
scanned once; otherwise a bounded broadcast filter and a join leave the unseen blobs' rows alone. Findings join
by blob; those of a blob with many rows are dealt over salts, and blobs without findings need no join.

A null text is the empty blob. Repeated rows and copies share one entry. Columns other than the id
and the text are ignored; an empty table gives an empty result and leaves the ledger as it is.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Members, exists, salted_join, shared_dir, table, text_of

#: The base kinds in their order, pattern, group that is measured, least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 18),
    ("hex", r"[0-9a-f]+", re.ASCII, 0, 16),
)
#: Spans that the method adds to them.
MORE = (
    ("bearer", r"\bBearer\x20+([A-Za-z0-9+/_.=~-]+)", re.ASCII, 1, 20),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.ASCII, 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.ASCII, 0, 27),
    ("forge", r"\b(?:gh[pousr]_|glpat-|xox[abprs]-)[A-Za-z0-9_-]+", re.ASCII, 0, 20),
    ("url", r"\b[a-z][a-z0-9+.]*://[^\s:/@]+:([^\s:/@]+)@", re.ASCII, 1, 4),
)
#: The pair's second half: a checksum of the rules and of the number of how they are applied.
RULE_VERSION = zlib.crc32(repr((1, BASE, MORE)).encode())
_RULES = [(kind, re.compile(pattern, flags), group, least) for kind, pattern, flags, group, least in BASE + MORE]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    found = []
    for rank, (kind, rule, group, least) in enumerate(_RULES):
        found += [(m.start(), rank, kind, m.end()) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _digest(spans: list[tuple[str, int, int]]) -> tuple[int, int, int, str, str]:
    join = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
    base = [x for x in spans if x[0] in ("assign", "access", "hex")]
    n = [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
    return *n, hashlib.sha256(join(base).encode()).hexdigest(), join(spans)


_FOUND = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
LEDGER = f"{_FOUND}, rule_version long"
#: Blobs that a task remembers as scanned.
REMEMBERED = 500_000


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for b in batches:
        blobs, rows = b.column("blob"), []
        for blob, text in zip(blobs.to_pylist(), b.column("text").to_pylist(), strict=True):
            if blob not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(blob)
                rows.append((blob, *_digest(find_secrets(text))))
        if rows:
            kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


class Ledger:
    """What was scanned already, as a table that is only appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        """Its rows for the rules as they are; None while there is no table. A run that died may have left a pair twice."""
        if not exists(self.spark, self.path):
            return None
        rows = self.spark.read.schema(LEDGER).parquet(self.path).where(F.col("rule_version") == RULE_VERSION)
        return rows.dropDuplicates(["blob"])

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def ledger_of(spark: SparkSession, corpus: str) -> Ledger:
    """The ledger of a corpus in the shared folder."""
    return Ledger(spark, f"{shared_dir(spark)}/rippleframe-secret-ledger/{hashlib.sha256(corpus.encode()).hexdigest()[:24]}")


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.withColumn("blob", F.sha2("text", 256))


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows: the findings of each blob of docs that the ledger lacks for the rules as they are."""
    rows = addressed(docs, id_col, text_col).select("blob", "text")
    if ledger is not None:
        unseen = rows.select("blob").distinct().join(ledger.select("blob"), "blob", "left_anti").withColumn("h", F.xxhash64("blob"))
        rows = Members(unseen, "h").keep(rows.withColumn("h", F.xxhash64("blob")), "h").drop("h").join(unseen.drop("h"), "blob").select("blob", "text")
    return rows.mapInArrow(_scan, _FOUND).dropDuplicates(["blob"]).withColumn("rule_version", F.lit(RULE_VERSION).cast("long"))


def findings(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with its blob and the digest of the blob's findings; the ledger is brought up to date first."""
    ledger.append(scan_blobs(docs, ledger.read(), id_col, text_col))
    found = ledger.read().where("spans <> ''").drop("rule_version")
    rows = addressed(docs, id_col, text_col).select("doc_id", "blob")
    none = dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans"), _digest([]), strict=True))
    out = salted_join(rows, found, "blob")
    return out.select("doc_id", "blob", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with the union of its spans (kind:start:end, by start) replaced; text itself where spans is null."""
    parts = F.transform(F.split(spans, ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(state: Column, p: Column) -> Column:
        new = p["a"] >= F.greatest(state["at"], state["end"])
        out = F.when(new, F.concat(state["out"], text.substr(state["at"] + 1, p["a"] - state["at"]), F.lit(mask))).otherwise(state["out"])
        at = F.greatest(state["at"], p["b"])
        return F.struct(out.alias("out"), at.alias("at"), F.greatest(state["end"], p["b"]).alias("end"))

    end = F.aggregate(parts, empty, step)
    done = F.concat(end["out"], text.substr(end["at"] + 1, F.char_length(text)))
    return F.when(spans.isNull() | (spans == ""), text).otherwise(done)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(table(spark, sf_dir, "documents"), ledger_of(spark, sf_dir))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
