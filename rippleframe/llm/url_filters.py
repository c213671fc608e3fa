"""URL filters by association rules, in DataFrame operations only.

Explicit rules (host suffix and path prefix, longest wins) judge the urls that they fit, and label them. The
other urls are judged by association rules that are mined from these labels, level by level: combinations of url tokens
that go with "block". Tokens are the words of the host's labels but the public suffix, of the path and of the
query; the suffix itself, which explicit rules name, is none. A share of the labelled urls (HELD_OUT) is kept
from mining, so that precision and recall can be measured on it.

Mined rules are pruned by support (a share of the labelled urls) and by confidence, corrected for small counts:
(hits + 1) / (urls + 2). A rule goes when a more general one is kept. All tokens of a url are mined, and rules of all
lengths. A combination is extended only while a longer one can be a new rule: while it has the support, holds
no rule, and fits fewer urls than each of its parts (else the part decides the same urls). So the tokens of a
template, which stand on the same urls, end at pairs. Many independent tokens on the same urls
give many combinations; nothing bounds them but the support.
Rules are matched through an inverted index: a rule is listed under its rarest token, the urls that hold it are
looked up, and the rule's other tokens are compared.

Matching works on distinct token sets (numbers are left out), so hot hosts and repeated urls cost one row
each there; sets with many urls are dealt over salts when verdicts go back to the urls.

A url that is null or has no "://" has an empty host and path; no explicit rule fits it, and without
tokens it is allowed. Without labelled urls, or without rules, all others are allowed. Repeated rows are judged row
by row. Columns other than the id and the url are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, salted_join, table

#: (verdict, host, path) — fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second-level labels that are part of the public suffix before a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ltd", "ne", "net", "or", "org")
#: A rule, with its label, holds in this share of the labelled urls, and its label in this share of those that it fits.
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
#: One labelled url in so many is kept from mining.
HELD_OUT = 5


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule's name and verdict; the longest rule (host and path together) that fits comes first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: words of the host's labels but the public suffix (h:), of the path (p:) and of the query (q:)."""
    # The port, the user and a final dot aren't part of the name; a name of one label has no suffix.
    named = F.filter(F.split(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\."), lambda w: w != "")
    n = F.size(named)
    pair = (n > 2) & (F.length(F.element_at(named, -1)) == 2) & F.element_at(named, F.when(n > 1, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    suffix = F.when(n < 2, 0).when(pair, 2).otherwise(1)
    words = lambda c, kind: F.transform(F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda w: F.length(w) > 1), lambda w: F.concat(F.lit(kind), w))
    own = F.concat_ws(".", F.when(n > 0, F.slice(named, 1, n - suffix)).otherwise(named))
    return F.array_sort(F.array_distinct(F.concat(words(own, "h:"), words(path, "p:"), words(query, "q:"))))


def mine_rules(sets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule (sorted tokens), hits, urls from labelled sets (tokens, blocked, n): n urls with each set of tokens.

    All rules that have the support and the confidence and hold no shorter one.
    """
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = spark.createDataFrame([], "rule array<string>, hits long, urls long")
    if not total:
        return found
    floor = max(1, int(-(-min_support * total // 1)))
    while floor < total and (floor + 1) / (floor + 2) < min_confidence:  # with fewer hits no rule has the confidence
        floor += 1
    sure = (F.col("hits") + 1) / (F.col("urls") + 2) >= min_confidence
    baskets = cut(sets.select(F.monotonically_increasing_id().alias("basket"), "blocked", "n", "tokens"), "url-baskets")
    # Where combinations of k tokens stand: the first k - 1 and the last one, in order.
    there = baskets.select("basket", "blocked", "n", F.array().cast("array<string>").alias("first"), F.explode("tokens").alias("last"))
    k, shorter = 1, None
    while True:
        there = cut(there.withColumn("rule", F.concat("first", F.array("last"))), "url-there")
        # One that stands on the same urls as a part of it decides nothing new; a single token's part is the empty one.
        counted = there.groupBy("rule").agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("urls")).where(F.col("hits") >= floor)
        if shorter is None:
            counted = counted.where(sure | (F.col("urls") < total))
        else:
            parts = counted.select("*", F.explode(F.transform("rule", lambda t: F.array_remove(F.col("rule"), t))).alias("part"))
            parts = parts.join(shorter.select(F.col("rule").alias("part"), F.col("urls").alias("of")), "part")
            whole = parts.groupBy("rule", "hits", "urls").agg(F.count(F.lit(1)).alias("parts"), F.min("of").alias("of"))
            counted = whole.where((F.col("parts") == k) & (F.col("of") > F.col("urls"))).drop("parts", "of")
        counted = cut(counted, "url-rules")
        found = found.unionByName(counted.where(sure))
        shorter = counted.where(~sure)
        held = shorter.select("rule")
        if len(held.take(2)) < 2:  # a longer one has two parts at least
            break
        before, there = there, cut(salted_join(there, held, "rule", "inner").drop("rule"), "url-held")
        discard(before)
        x, y = there.alias("x"), there.alias("y")
        both = x.join(y, (F.col("x.basket") == F.col("y.basket")) & (F.col("x.first") == F.col("y.first")) & (F.col("x.last") < F.col("y.last")))
        there, k = both.select("x.basket", "x.blocked", "x.n", F.concat("x.first", F.array("x.last")).alias("first"), F.col("y.last").alias("last")), k + 1
    discard(there)
    discard(baskets)
    return found


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The sets (column tokens, distinct) that some rule fits, by an inverted index of the rules' rarest tokens."""
    named = rules.select("rule", F.explode("rule").alias("token"))
    counts = sets.select(F.explode("tokens").alias("token")).join(named.select("token").distinct(), "token").groupBy("token").count()
    index = named.join(counts, "token").groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("token"), F.count(F.lit(1)).alias("there")).where(F.col("there") == F.size("rule"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index.select("token", "rule"), "token")
    return hits.where(F.size(F.array_except("rule", "tokens")) == 0).select("tokens").distinct()


def held_out(url: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(HELD_OUT)) == 0


def _described(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": name, "given": verdict, "tokens": tokens(F.col("host"), F.col("path"), query_of(F.col("url"))), "held_out": held_out(F.col("url"))})


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule fits), held_out."""
    rows = _described(pages, id_col, url_col, rules)
    label = F.when(~F.col("held_out"), F.col("given") == "block")
    sets = cut(rows.groupBy("tokens", label.alias("blocked")).agg(F.count(F.lit(1)).alias("n")), "url-sets")
    blocked = match_rules(sets.select("tokens").distinct(), mine_rules(sets.where("blocked is not null"))).withColumn("mined", F.lit(True))
    out = salted_join(rows, blocked, "tokens")
    mined = F.coalesce("mined", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(mined, "block").otherwise("allow")).alias("verdict"), mined.alias("mined"), "held_out")


def quality(judged: DataFrame) -> DataFrame:
    """One row: precision and recall of the mined rules on the labelled urls that were kept from mining."""
    rows = judged.where("held_out and rule is not null")
    right = F.count_if(F.col("mined") & (F.col("verdict") == "block"))
    return rows.agg((right / F.count_if("mined")).alias("precision"), (right / F.count_if(F.col("verdict") == "block")).alias("recall"), F.count(F.lit(1)).alias("urls"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
