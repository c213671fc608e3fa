"""Main text of pages by wrappers: union-free regular expressions that are inferred from the pages of each host.

A page is a tree of block elements with text slots between them; inline elements are part of the text. Adjacent
groups of siblings with the same labels (tag and classes) are folded into one repeated group. The trees of a
host are aligned one after another, level by level: siblings with the same label stay one part of the wrapper,
what one side lacks becomes an optional part in its place. So a part of the wrapper is a position that the
host's pages share, repeated or optional or both, and there are no alternatives.

Every page is matched against its host's wrapper, which gives each text its slot. Over the host's pages a slot
is template text where it says the same on all of them, of three at least, while others vary; it is a list of links
where half of its characters are links. Main text are the slots that are neither, nor lie in a menu, header,
footer, sidebar, notice, advert, form or comment part; on a page with an article element only those within it,
and there lists of links too. A header within an article is the article's own and stays.
Texts whose part the wrapper lacks (it holds MOST_PARTS parts, the rarest optional ones go first) are kept unless they
lie in a part of that kind.

Trees and slots are added up before they meet: within a batch, then by host. The wrapper of a
host is built from its distinct trees in up to SALTS parts first, so that no task sees all pages, and
slots are counted by batches too. Pages meet their wrapper by a join whose hot hosts are dealt over salts.

A null html is an empty page. A null url belongs to the host "". Repeated rows are extracted row by
row. Columns other than the id, url and html are ignored; an empty table gives an empty result. Time is linear
in a page's length; elements nested deeper than DEPTH lie beside each other.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted_join, table

SALTS = 16
#: Longest repeated group, in parts, and deepest element.
PERIOD, DEPTH = 6, 120
#: Parts of a wrapper.
MOST_PARTS = 20_000
#: Bytes of wrappers that are broadcast.
BROADCAST = 32 << 20
#: Trees whose match a worker remembers.
REMEMBERED = 50_000

#: Elements of HTML by their role here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea title".split())
APART = frozenset("nav header footer aside form button select dialog menu head".split())
#: Words of class, id or role that name what isn't the article, alone or with words of place and shape.
APART_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header hidden masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search".split())
NEUTRAL_WORDS = frozenset("area bar block body bottom box column container content first footer form group header inner item items last left link links list main menu nav outer overlay panel right row section site slot text thread title top unit widget wrap wrapper".split())
#: A start tag of the first kind ends an open element of the second.
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSES = {t: ("p",) for t in _BLOCKS} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: Elements that an implied end doesn't cross.
SCOPE = frozenset("ul ol dl table article section div main body nav aside header footer form td th blockquote figure".split())

# A quote counts only where a value begins. Nothing is tried twice, so a tag without an end costs one pass.
_TAG = re.compile(r"""<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)>""")
_ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(?=[\s/]|$))""", re.I)
_WORDS = re.compile(r"[a-z]+")


def is_apart_name(name: str) -> bool:
    """Whether a class, id or role names a part beside the article: social, ad-slot, sidebar_left, not social-life."""
    words = _WORDS.findall(name.lower())
    return any(w in APART_WORDS for w in words) and all(w in APART_WORDS or w in NEUTRAL_WORDS for w in words)


@lru_cache(20_000)
def label_of(tag: str, attrs: str) -> tuple[str, bool]:
    """The tag with its classes, "!" in front where it stands apart from the article; and that again."""
    if "=" not in attrs and "hidden" not in attrs:
        return ("!" + tag if tag in APART else tag), tag in APART
    apart, classes = tag in APART, []
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "style":
            apart |= "display:none" in value.replace(" ", "")
        elif name == "aria-hidden":
            apart |= value == "true"
        elif name == "hidden":
            apart = True
        else:
            names = value.split()
            if tag not in ("html", "body", "article", "main"):
                apart |= any(map(is_apart_name, names))
            if name == "class":
                classes += [re.sub("[0-9]+", "", n) for n in names]
    return ("!" if apart else "") + ".".join([tag, *dict.fromkeys(classes)]), apart


class Part:
    """An element, or a text slot ("#"), of a page or a wrapper."""

    __slots__ = ("label", "kids", "optional", "repeated", "into", "at", "pages")

    def __init__(self, label: str):
        self.label, self.kids, self.optional, self.repeated, self.into, self.at, self.pages = label, [], False, False, None, -1, 1

    def end(self) -> Part:
        p = self
        while p.into is not None:
            p = p.into
        return p


class Page:
    """The tree of a page and its texts, (slot, text, characters in links) in page order."""

    def __init__(self, source: str):
        self.root = Part("")
        self.texts: list[tuple[Part, str, int]] = []
        stack: list[tuple[str, Part]] = []
        self._text: list[str] = []
        self._links = 0
        inline: list[tuple[str, bool]] = []
        at, end = 0, len(source)

        def flush() -> None:
            if self._text:
                text = " ".join("".join(self._text).split())
                if text:
                    slot = Part("#")
                    (stack[-1][1] if stack else self.root).kids.append(slot)
                    self.texts.append((slot, text, min(self._links, len(text))))
                self._text, self._links = [], 0

        def add(raw: str) -> None:
            if raw and not any(x[1] for x in inline):
                text = entities.unescape(raw)
                self._text.append(text)
                if any(x[0] == "a" for x in inline):
                    self._links += len(text.strip())

        def pop(n: int) -> None:
            flush()
            inline.clear()
            del stack[n:]

        while at < end:
            begin = source.find("<", at)
            if begin < 0:
                add(source[at:])
                break
            add(source[at:begin])
            if source.startswith("<!--", begin):
                close = source.find("-->", begin + 4)
                at = close + 3 if close >= 0 else end
                continue
            if source.startswith("<![CDATA[", begin):
                close = source.find("]]>", begin)
                self._text.append(source[begin + 9 : close if close >= 0 else end])
                at = close + 3 if close >= 0 else end
                continue
            after = source[begin + 1 : begin + 3]
            if after[:1] in ("!", "?"):
                close = source.find(">", begin)
                at = close + 1 if close >= 0 else end
                continue
            if not (after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()):
                add("<")
                at = begin + 1
                continue
            m = _TAG.match(source, begin)
            if not m:
                break  # the page ends within a tag
            at = m.end()
            tag = m["tag"].lower()
            if m["end"]:
                if tag in INLINE:
                    for i in range(len(inline) - 1, -1, -1):
                        if inline[i][0] == tag:
                            del inline[i]
                            break
                    if tag == "br":
                        self._text.append(" ")
                    continue
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                else:
                    flush()
            elif tag in RAW:
                if not m["attrs"].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                    close = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*+>?", re.I).search(source, at)
                    at = close.end() if close else end
            elif tag in VOID:
                if tag == "br":
                    self._text.append(" ")
                elif tag not in INLINE:
                    flush()
            elif tag in INLINE:
                inline.append((tag, label_of(tag, m["attrs"])[1]))
                if len(inline) > DEPTH:
                    del inline[0]
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES.get(tag, ()):
                        pop(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
                flush()
                inline.clear()
                if len(stack) >= DEPTH:
                    del stack[DEPTH - 1 :]
                part = Part(label_of(tag, m["attrs"])[0])
                (stack[-1][1] if stack else self.root).kids.append(part)
                stack.append((tag, part))
        flush()
        fold(self.root)

    def tree(self) -> str:
        """The folded tree as JSON; numbers its parts."""
        return dump(self.root)


def merge(one: Part, two: Part) -> None:
    """Aligns two into one: parts of both stay, others become optional in their places."""
    two.into = one
    one.pages += two.pages
    one.optional |= two.optional
    one.repeated |= two.repeated
    a, b = one.kids, two.kids
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b, strict=True)):
        for x, y in zip(a, b, strict=True):
            merge(x, y)
        return
    out: list[Part] = []
    for what, a0, a1, b0, b1 in difflib.SequenceMatcher(None, [x.label for x in a], [y.label for y in b], autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[a0:a1], b[b0:b1], strict=True):
                merge(x, y)
                out.append(x)
        else:
            for x in a[a0:a1] + b[b0:b1]:
                x.optional = True
                out.append(x)
    one.kids = out


def fold(part: Part) -> None:
    """Adjacent groups of parts with the same labels become one repeated group; short groups first."""
    for kid in part.kids:
        fold(kid)
    kids = part.kids
    for period in range(1, PERIOD + 1):
        if len(kids) < 2 * period:
            break
        labels = [k.label for k in kids]
        if period > 1 and len(set(labels)) == len(labels):
            break
        out, i = [], 0
        while i < len(kids):
            j, group = i + period, kids[i : i + period]
            if labels[i:j] == labels[j : j + period]:
                while labels[i : i + period] == labels[j : j + period]:
                    for x, y in zip(group, kids[j : j + period], strict=True):
                        pages = x.pages
                        merge(x, y)
                        x.repeated, x.pages = True, pages
                    j += period
                out += group
                i = j
            else:
                out.append(kids[i])
                i += 1
        kids = out
    part.kids = kids


def dump(root: Part) -> str:
    """[label, marks, pages, parts] from the root on; numbers the parts in this order."""
    count = 0

    def one(part: Part) -> list:
        nonlocal count
        part.at, count = count, count + 1
        return [part.label, ("?" if part.optional else "") + ("+" if part.repeated else ""), part.pages, [one(k) for k in part.kids]]

    return json.dumps(one(root), separators=(",", ":"))


def load(tree: str) -> Part:
    count = 0

    def one(given: list) -> Part:
        nonlocal count
        part = Part(given[0])
        part.optional, part.repeated, part.pages, part.at, count = "?" in given[1], "+" in given[1], given[2], count, count + 1
        part.kids = [one(k) for k in given[3]]
        return part

    return one(json.loads(tree))


def parts_of(root: Part) -> list[Part]:
    out = [root]
    for p in out:  # grows as it goes
        out += p.kids
    return out


def prune(root: Part, most: int = MOST_PARTS) -> Part:
    """Takes the rarest optional parts away until few enough are left."""
    every = parts_of(root)
    if len(every) > most:
        counts = sorted((p.pages for p in every), reverse=True)
        least = counts[most]
        for p in every:
            p.kids = [k for k in p.kids if not (k.optional and k.pages <= least)]
    return root


def wrapper_of(trees: list[tuple[str, int]]) -> str:
    """The wrapper of (tree, pages), the most frequent first."""
    made: Part | None = None
    for k, (tree, pages) in enumerate(sorted(trees, key=lambda t: (-t[1], t[0]))):
        new = load(tree)
        if pages > 1:
            for p in parts_of(new):
                p.pages *= pages
        if made is None:
            made = new
        else:
            merge(made, new)
            if k % 64 == 0:
                prune(made)
    return dump(prune(made)) if made else dump(Part(""))


def match(wrapper: Part, page: Part) -> dict[int, int]:
    """The wrapper's part of each part of a page; what it lacks is missing."""
    out, todo = {page.at: wrapper.at}, [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        pairs: list[tuple[Part, Part]] = []
        if len(w.kids) == len(p.kids) and all(x.label == y.label for x, y in zip(w.kids, p.kids, strict=True)):
            pairs = list(zip(w.kids, p.kids, strict=True))
        elif p.kids:
            blocks = difflib.SequenceMatcher(None, [x.label for x in w.kids], [y.label for y in p.kids], autojunk=False).get_matching_blocks()
            pairs = [(w.kids[i + k], p.kids[j + k]) for i, j, n in blocks for k in range(n)]
            if len(pairs) < len(p.kids):
                got, first = {id(y) for _, y in pairs}, {}
                for x in w.kids:
                    first.setdefault(x.label, x)
                pairs += [(first[y.label], y) for y in p.kids if id(y) not in got and y.label in first]
        for x, y in pairs:
            out[y.at] = x.at
            todo.append((x, y))
    return out


def places(root: Part) -> dict[int, tuple[bool, bool]]:
    """Of each text slot: whether it stands apart, and whether it lies in an article."""
    out, todo = {}, [(root, False, False)]
    while todo:
        part, apart, article = todo.pop()
        bare = part.label.lstrip("!")
        names = bare.split(".")
        if part.label.startswith("!") and not (article and bare == "header"):
            apart = True
        if names[0] in ("article", "main") or names[0] in ("div", "section") and {"article", "post"} & set(names[1:]):
            article = True
        if part.label == "#":
            out[part.at] = (apart, article)
        todo += [(k, apart, article) for k in part.kids]
    return out


def choose_slots(slots: list[tuple[int, int, int, int, int, int]], where: dict[int, tuple[bool, bool]]) -> list[int]:
    """Main slots of a host, of (slot, pages, chars, links, low, high): low and high are digests of the slot's text over pages."""
    varies = any(s[4] != s[5] for s in slots)
    out = []
    for at, pages, chars, links, low, high in slots:
        apart, article = where.get(at, (True, False))
        template = varies and pages >= 3 and low == high
        if not apart and not template and (article or links * 2 < chars):
            out.append(at)
    return out


class Wrapper:
    """A host's wrapper in use: matches pages, remembering trees."""

    def __init__(self, tree: str):
        self.root = load(tree)
        self.where = places(self.root)
        self.known: dict[str, tuple[dict[int, int], dict[int, tuple[bool, bool]]]] = {}

    def slots(self, page: Page) -> list[tuple[int | None, tuple[bool, bool], str, int]]:
        """(the wrapper's slot, where it lies, text, characters in links) of each text."""
        tree = page.tree()
        if tree not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[tree] = match(self.root, page.root), places(page.root)
        to, own = self.known[tree]
        return [(to.get(at := slot.end().at), own[at], text, links) for slot, text, links in page.texts]


def main_text(wrapper: Wrapper, chosen: frozenset[int], page: Page) -> str:
    found = wrapper.slots(page)
    article = any(inside and not apart for _, (apart, inside), _, _ in found)
    return "\n".join(t for at, (apart, inside), t, _ in found if not apart and (inside or not article) and (at is None or at in chosen))


def host_of(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    host = re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)})


def host_column(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"://([^/?#]*)", 1)).otherwise(F.lit(""))
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_TREES = "host string, tree string, pages long, slots array<struct<at:int,pages:long,chars:long,links:long,low:long,high:long>>"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a host with what their slots held, added up within a batch."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("at", pa.int32()), *[(c, pa.int64()) for c in ("pages", "chars", "links", "low", "high")]]))]
    for b in batches:
        seen: dict[tuple[str, str], list] = {}
        for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = Page(source)
            got = seen.setdefault((host, page.tree()), [0, {}])
            got[0] += 1
            mine: dict[int, list[int]] = {}
            for slot, text, links in page.texts:
                one = mine.setdefault(slot.end().at, [0, 0, 0])
                one[0] += len(text)
                one[1] += links
                one[2] = zlib.crc32(text.encode("utf-8", "replace"), one[2])
            for at, (chars, links, digest) in mine.items():
                s = got[1].get(at)
                got[1][at] = [s[0] + 1, s[1] + chars, s[2] + links, min(s[3], digest), max(s[4], digest)] if s else [1, chars, links, digest, digest]
        names = ("at", "pages", "chars", "links", "low", "high")
        rows = [(h, t, n, [dict(zip(names, (at, *v), strict=True)) for at, v in slots.items()]) for (h, t), (n, slots) in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "tree", "pages", "slots"])


def _join_trees(rows: pd.DataFrame) -> pd.DataFrame:
    made = wrapper_of(list(zip(rows["tree"], map(int, rows["pages"]), strict=True)))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "tree": [made], "pages": [1]})


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees' slots as slots of their host's wrapper."""
    known: dict[str, Wrapper] = {}
    names = ("host", "at", "pages", "chars", "links", "low", "high")
    for b in batches:
        total: dict[tuple[str, int], list[int]] = {}
        for host, tree, slots, wrapper in zip(*(b.column(c).to_pylist() for c in ("host", "tree", "slots", "wrapper")), strict=True):
            if wrapper not in known:
                if len(known) >= 1000:
                    known.clear()
                known[wrapper] = Wrapper(wrapper)
            to = match(known[wrapper].root, load(tree))
            for s in slots:
                if (at := to.get(s["at"])) is not None:
                    t = total.get((host, at))
                    new = [s["pages"], s["chars"], s["links"], s["low"], s["high"]]
                    total[host, at] = [t[0] + new[0], t[1] + new[1], t[2] + new[2], min(t[3], new[3]), max(t[4], new[4])] if t else new
        rows = [(h, at, *v) for (h, at), v in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), *[pa.int64()] * 6], strict=True)], names)


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    slots = [tuple(int(v) for v in r) for r in rows[["at", "pages", "chars", "links", "low", "high"]].itertuples(index=False)]
    chosen = choose_slots(slots, places(load(rows["wrapper"].iloc[0])))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "slots": [sorted(chosen)]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON: label, "?" optional and "+" repeated, pages, parts; "#" is a text slot), slots (numbers of the main ones)."""
    rows = pages.select(host_column(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    seen = cut(rows.mapInArrow(_observe, _TREES), "trees")
    distinct = seen.groupBy("host", "tree").agg(F.sum("pages").alias("pages"))
    some = distinct.withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(_join_trees, "host string, tree string, pages long")
    wrappers = cut(some.groupBy("host").applyInPandas(_join_trees, "host string, tree string, pages long").select("host", F.col("tree").alias("wrapper")), "wrappers")
    placed = salted_join(seen, wrappers, "host", "inner").mapInArrow(_place, "host string, at long, pages long, chars long, links long, low long, high long")
    slots = placed.groupBy("host", "at").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.min("low").alias("low"), F.max("high").alias("high"))
    chosen = slots.join(wrappers, "host").groupBy("host").applyInPandas(_choose, "host string, slots array<int>")
    return wrappers.join(chosen, "host", "left").select("host", "wrapper", F.coalesce("slots", F.array().cast("array<int>")).alias("slots"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    wrappers = cut(infer_wrappers(pages, url_col, html_col), "host-wrappers")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_column(F.col(url_col)).alias("host"))
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + 8 * F.size("slots")), F.lit(0))).first()[0]
    # Few hosts' wrappers go to every task; many are joined, the rows of hot hosts being dealt out.
    rows = rows.join(F.broadcast(wrappers), "host", "left") if size <= BROADCAST else salted_join(rows, wrappers, "host")
    rows = rows.select("page_id", "url", "html", "wrapper", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Wrapper, frozenset[int]]] = {}
        for b in batches:
            texts = []
            for source, wrapper, slots in zip(*(b.column(c).to_pylist() for c in ("html", "wrapper", "slots")), strict=True):
                if wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = Wrapper(wrapper), frozenset(slots)
                texts.append(main_text(*known[wrapper], Page(source)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
