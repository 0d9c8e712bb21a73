"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes, keyed by the path of tags and classes from the root.
For each style node two entropies over the m pages that have it are taken, both scaled to 0..1 by log m: of the
sequences of child tags (presentation) and of the texts below it (content). Their mean, drawn towards a half as
if SHRUNK pages more had that, is its importance: a bar that looks and reads the same on every page has hardly any,
one whose text changes in a fixed frame has half, an article close to one. Style nodes inside a declared article
are weighed over the host's distinct articles, since copies of one article would look like furniture.

A page drops every branch whose importance is below LOW. Names, and standing outside an article that the page
declares, are evidence against a branch, worth HINT of importance: nav, footer, class="ad" and their like go unless
the tree shows that they vary nearly as much as can be; they never go by their names alone where the tree says so.
What is no text (scripts, styles, controls, hidden elements) goes in any case. On a host with fewer than PAGES pages
the tree says nothing, and every branch counts as of half importance.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import from_blob, packed, prepare, to_blob, trimmed

#: Text bytes in a block; importance that is low, and that names and places take away; fewest pages to judge by; pages' worth of doubt.
BLOCK, LOW, HINT, PAGES, SHRUNK = 8 << 20, 0.3, 0.65, 4, 4
MASK = (1 << 64) - 1
#: Odd: the base of the hash of a sequence of texts.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)

#: Names of HTML elements and of the classes and roles that mark furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption colgroup tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SCOPES = frozenset("html table td th caption button object template article aside body div section main nav header footer form li ul ol dl dd dt blockquote fieldset figure details".split())
NO_TEXT = frozenset("head script style noscript template button select textarea iframe svg canvas object title xmp noembed noframes".split())
HINT_TAGS = frozenset("nav aside footer form dialog menu search".split())
HINT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice newsletter subscribe signup login modal popup overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social related recommended widget pagination pager toolbar skip contentinfo complementary search form dialog alert".split())
OUTER_WORDS = frozenset("header banner masthead".split())
NEUTRAL_WORDS = frozenset("site page main top bottom left right box bar block container wrapper wrap inner outer area section list links link module item group column col row panel primary secondary global js is has".split())
SIBLINGS = {"li": "ul ol menu dir", "dd": "dl", "dt": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select", "tbody": "table", "thead": "table", "tfoot": "table"}

#: A comment, a declaration, a tag, or the start of one that never ends; in BLIND quotes don't count, NEVER has no tags.
TOKEN, BLIND = (re.compile(rf"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)({inner})>|<(?=[!?]|/?[a-zA-Z])", re.S) for inner in (r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", "[^>]*+"))
NEVER = re.compile(r"(?!)")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[a-z]+")


def hinted(tokens: list[str], words: frozenset[str]) -> bool:
    """Does one of the names consist of furniture words, at least one, and neutral ones? cookie-notice does, notice-period doesn't."""
    for token in tokens:
        parts = PARTS.findall(token)
        if not words.isdisjoint(parts) and all(x in words or x in NEUTRAL_WORDS for x in parts):
            return True
    return False


class Node:
    """An element: its style node's key, whether it is no text or hinted at, and its texts, which are first to last of the page's."""

    __slots__ = ("empty", "first", "hint", "inside", "key", "kids", "last", "main", "p", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None, first: int) -> None:
        self.tag, self.parent, self.kids, self.first, self.last = tag, parent, [], first, -1
        name, hidden, tokens = "", False, []
        if attributes.strip():
            for m in ATTRIBUTE.finditer(attributes):
                kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if kind == "hidden" or kind == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
                elif kind != "style":
                    tokens += value.split()
                    if kind == "class":
                        name = ".".join(sorted(re.sub(r"\d{2,}", "", value).split()))
        # a path is known by a hash chained from the root, so deep pages take no more room than flat ones
        self.key = xxhash.xxh3_64_intdigest(f"{tag}.{name}", parent.key if parent else 0)
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.empty = hidden or tag in NO_TEXT
        outer = not self.inside and (tag == "header" or hinted(tokens, OUTER_WORDS | HINT_WORDS))
        self.hint = tag not in ("html", "body", "main") and (tag in HINT_TAGS or outer or hinted(tokens, HINT_WORDS))
        self.main = "main" in tokens and tag in ("div", "section")
        self.p = None


def parse(page: str) -> tuple[list[Node], list[tuple[Node, int, str]]]:
    """The nodes of a page in order, and its texts as (node, number of its block, raw text).

    From a tag on whose quotes never close quotes don't count, and one that never ends is text, as is all behind it.
    """
    token = TOKEN
    root = Node("html", "", None, 0)
    nodes, stack, texts, block, at = [root], [root], [], 0, 0
    open_: Counter[str] = Counter()

    def pop_to(index: int) -> None:
        nonlocal block
        if any(x.tag in BLOCKS for x in stack[index:]):
            block += 1
        for x in stack[index:]:
            x.last = len(texts)
            open_[x.tag] -= 1
        del stack[index:]

    while True:
        m = token.search(page, at)
        if m and m.end() == m.start() + 1:
            token = BLIND if token is TOKEN else NEVER
            continue
        end = m.start() if m else len(page)
        if end > at:
            texts.append((stack[-1], block, page[at:end]))
        if not m:
            for x in nodes:
                if x.last < 0:
                    x.last = len(texts)
            return nodes, texts
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            else:
                block += tag in BLOCKS
            continue
        if tag == "html":
            continue
        if tag == "br":
            texts.append((stack[-1], block, " "))
            continue
        if tag in CLOSES_P:
            if stack[-1].p is not None:
                pop_to(stack[-1].p)
        elif tag in SIBLINGS:
            same = ("dd", "dt") if tag in ("dd", "dt") else (tag,)
            if any(open_[x] for x in same):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in same:
                        pop_to(k)
                        break
                    if stack[k].tag in SIBLINGS[tag].split():
                        break
        elif tag == "body" and stack[-1].tag == "head":
            pop_to(len(stack) - 1)
        block += tag in BLOCKS
        node = Node(tag, m[3], stack[-1], len(texts))
        stack[-1].kids.append(tag)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            node.last = len(texts)
        elif tag not in VOID and not m[3].endswith("/"):
            node.p = len(stack) if tag == "p" else None if tag in SCOPES else stack[-1].p
            stack.append(node)
            open_[tag] += 1
        else:
            node.last = len(texts)


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return found[1].lower().rpartition("@")[2].split(":")[0] if found else ""


def key_of(host: str, key: int) -> int:
    return xxhash.xxh3_64_intdigest(host, key) - (1 << 63)


def declared(nodes: list[Node]) -> tuple[set[int], set[int]]:
    """The outermost nodes declared to hold the main text (none if the page declares none), and all above them, by identity."""
    out: set[int] = set()
    found: list[Node] = []
    mains: list[Node] = []
    for x in nodes:
        if x.empty or x.hint or x.parent is not None and id(x.parent) in out:
            out.add(id(x))
        elif x.tag == "article":
            found.append(x)
        elif x.tag == "main" or x.main:
            mains.append(x)
    found = found or mains[:1]
    roots: set[int] = {id(x) for x in found}
    below: set[int] = set()
    for x in nodes:
        if x.parent is not None and (id(x.parent) in roots or id(x.parent) in below):
            below.add(id(x))
    above: set[int] = set()
    for x in found:
        while x.parent is not None and id(x.parent) not in above and id(x) not in below:
            x = x.parent
            above.add(id(x))
    return roots - below, above


def within(nodes: list[Node], roots: set[int]) -> set[int]:
    """The roots and all below them."""
    out = set(roots)
    for x in nodes:
        if x.parent is not None and id(x.parent) in out:
            out.add(id(x))
    return out


def contents(texts: list[tuple[Node, int, str]]) -> tuple[list[int], list[int]]:
    """Running sums by which the texts a to b of a page hash to (sum[b] - sum[a]) * unit[a], and unit."""
    total, power, inverse = [0], 1, [1]
    for _, _, text in texts:
        total.append(total[-1] if text.isspace() else (total[-1] + (xxhash.xxh3_64_intdigest(text) | 1) * power) & MASK)
        if not text.isspace():
            power = power * BASE & MASK
        inverse.append(inverse[-1] if text.isspace() else inverse[-1] * INVERSE & MASK)
    return total, inverse


def styles(page: str | None, url: str | None) -> list[tuple[int, int, int, int]]:
    """(style node, presentation, content, article) of a page, as hashes, for all its style nodes that have text below.

    article is 0 outside the declared articles, else that of the text of all of them, by which their copies are known.
    """
    host, (nodes, texts) = host_of(url), parse(page or "")
    roots, _ = declared(nodes)
    inside = within(nodes, roots)
    total, unit = contents(texts)
    found: dict[tuple[int, bool], tuple[list[str], list[int]]] = {}
    gone: set[int] = set()
    article: list[int] = []
    for x in nodes:
        if x.empty or x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))
            continue
        if total[x.first] == total[x.last] or x.parent is None:
            continue
        content = (total[x.last] - total[x.first]) * unit[x.first] & MASK
        if id(x) in roots:
            article.append(content)
        kids, below = found.setdefault((x.key, id(x) in inside), ([], []))
        kids.append(" ".join(x.kids))
        below.append(content)
    whole = xxhash.xxh3_64_intdigest(repr(article)) - (1 << 63) or 1
    return [(key_of(host, key), xxhash.xxh3_64_intdigest("|".join(kids)) - (1 << 63), xxhash.xxh3_64_intdigest(repr(below)) - (1 << 63), whole if held else 0) for (key, held), (kids, below) in found.items()]


def extract(page: str | None, url: str | None, known: dict[int, bool]) -> str:
    """The main text of a page. known has the style nodes whose importance is low (False) or so high that hints don't count (True).

    A page of which nothing would be left, like one of a host that holds copies of a single page, is read without the low ones.
    """
    host, (nodes, texts) = host_of(url), parse(page or "")
    roots, above = declared(nodes)
    use: dict[int, bool] = {}
    for x in nodes:
        if x.parent is None or id(x) in above:
            use[id(x)] = not x.empty
            continue
        keep = use[id(x.parent)] and not x.empty
        if keep and id(x) not in roots:
            told = known.get(key_of(host, x.key))
            against = x.hint or id(x.parent) in above
            keep = told is True if against else told is not False
        use[id(x)] = keep
    out: dict[int, list[str]] = {}
    for node, block, text in texts:
        if use[id(node)] and id(node) not in above:
            out.setdefault(block, []).append(entities.unescape(text))
    lines = [y for x in out.values() if (y := " ".join("".join(x).split()))]
    if not lines and False in known.values():
        return extract(page, url, {k: v for k, v in known.items() if v})
    return "\n".join(lines)


def _block_styles(rows: pa.Table) -> dict[str, bytes]:
    count: Counter[tuple[int, int, int, int]] = Counter()
    for url, page in zip(rows["url"].to_pylist(), rows["text"].to_pylist(), strict=True):
        count.update(styles(page, url))
    columns = zip(*count, strict=True) if count else ((), (), (), ())
    names = ("key", "presentation", "content", "article")
    return {"styles": to_blob(pa.table({x: pa.array(c, pa.int64()) for x, c in zip(names, columns, strict=True)} | {"n": pa.array(count.values(), pa.int64())}))}


def _unpack(batches):
    for batch in batches:
        for block, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for part in from_blob(blob).to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block, dtype=np.int64)), *part.columns], names=["block", "key", "presentation", "content", "article", "n"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", low: float = LOW, least_pages: int = PAGES) -> DataFrame:
    """One row per row of pages: key, url, text and n_chars.

    Blocks are joined by line feeds in page order, with white space inside a block turned into one space. A null or
    empty page has an empty text. Pages without a host share one tree. Style nodes seen on fewer than least_pages
    pages (inside a declared article: in fewer distinct articles) of a host are neither of low nor of high importance.
    Repeated rows count as often as they stand outside an article, and once inside.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("text"))
    blocks = packed(rows, BLOCK, _block_styles, ["styles"], "html")
    seen = blocks.select("block", "styles").mapInArrow(_unpack, "block bigint, key bigint, presentation bigint, content bigint, article bigint, n bigint")
    once = seen.where("article != 0").groupBy("key", "article").agg(F.min(F.struct("presentation", "content")).alias("s")).select("key", "s.presentation", "s.content", F.lit(1).cast("bigint").alias("n"))
    counted = seen.where("article = 0").select("key", "presentation", "content", "n").unionAll(once)
    counted = counted.select("key", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("presentation").alias("sign")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("sign")))).alias("x"), "n").select("key", "x.kind", "x.sign", "n")
    entropy = counted.groupBy("key", "kind", "sign").agg(F.sum("n").alias("n")).groupBy("key", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("t"))
    entropy = entropy.select("key", "m", F.when(F.col("m") > 1, 1 - F.col("t") / (F.col("m") * F.log("m"))).otherwise(0.5).alias("part"))
    weighed = entropy.groupBy("key").agg(F.avg("part").alias("mean"), F.max("m").alias("m")).where(F.col("m") >= least_pages)
    weighed = weighed.withColumn("importance", (F.col("mean") * F.col("m") + 0.5 * SHRUNK) / (F.col("m") + SHRUNK))
    told = weighed.where((F.col("importance") < low) | (F.col("importance") >= low + HINT)).select("key", (F.col("importance") >= low).alias("high"))
    asked = seen.select("block", "key").distinct().join(told, "key").select("block", "key", "high")

    def texts(held: pa.Table, told: pa.Table) -> pa.Table:
        docs, known = from_blob(held["docs"][0].as_py()), dict(zip(told["key"].to_pylist(), told["high"].to_pylist(), strict=True))
        out = [extract(p, u, known) for p, u in zip(docs["text"].to_pylist(), docs["url"].to_pylist(), strict=True)]
        return pa.table({key: docs["key"], "url": docs["url"], "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    return blocks.select("block", "docs").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(trimmed(texts), f"{key} bigint, url string, text string, n_chars bigint")
