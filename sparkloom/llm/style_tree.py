"""Main text of web pages by site style trees.

The DOMs of a site's pages are merged: an element node has, for every sequence of
children that occurs under it, a style node, whose element nodes are merged in
turn; runs of equal children count as one. The presentation of an element is
important if its styles differ from page to page (entropy to the base of the
number of its pages); the content of a leaf (a text or a reference) is important
if what it holds differs (one minus the mean entropy of its values over the
pages). As a site with few pages shows little repetition, a node's own importance
is drawn towards that of all nodes, of any site, on the same path of tags and
classes, as if the site had POOLED more pages like them: templates that sites
share are known by what they repeat everywhere. A node's composite importance adds to its own that of its styles, damped
by GAMMA to the power of their number. A node is noise if neither it nor anything
below reaches LEAST; every page loses the branches that are mapped to noise.

A site is the host of the URL. Its tree, that is its distinct nodes and not its
pages, is weighed by one task. The nodes found to be noise are sent to all
workers if they are few (BROADCAST_NODES), else joined with the pages.

Defined cases: a page whose URL has no host is a site of its own. Nodes that one
page of a site has are as important as those on their path elsewhere, and a path
that one page has is important. Null,
empty and text-free pages give an empty text. Scripts, styles, comments and
titles are no text. Elements nested deeper than DEPTH belong to their ancestor
there. Pages of any length are parsed whole. Repeated rows count as pages each
and get the same result. An empty table gives no rows. Other columns are neither
read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

GAMMA = 0.9
#: Texts drawn from 60 variants on 350 pages have an importance of 0.7; those that seldom recur have 0.98.
LEAST = 0.8
#: Elements nested deeper belong to the ancestor there, so that closing tags search no further; no text is lost.
DEPTH = 256
POOLED = 100
BROADCAST_NODES = 1_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-z][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IGNORED = frozenset("html head body br wbr meta link base".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul #root".split())
_CLOSES_P = _BLOCK - {"dd", "dt", "li", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SAME = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_TEXT, _REF = "#text", "#ref"
_LEAVES = frozenset((_TEXT, _REF))


class Page:
    """Nodes in document order: tag, key (tag and class), parent, children, and the value of leaves."""

    def __init__(self, html: str | None):
        self.tags, self.keys, self.parents, self.children, self.values = ["#root"], ["#root"], [-1], [[]], [""]
        if html:
            self._read(html)

    def _add(self, parent: int, tag: str, key: str, value: str = "") -> int:
        n = len(self.tags)
        self.tags.append(tag)
        self.keys.append(key)
        self.parents.append(parent)
        self.children.append([])
        self.values.append(value)
        self.children[parent].append(n)
        return n

    def _read(self, html: str) -> None:
        stack, tags, at = [0], self.tags, 0

        def shut(names, stop) -> None:
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t in names:
                    del stack[k:]
                    return
                if t in stop:
                    return

        def text(piece: str) -> None:
            if "&" in piece:
                piece = unescape(piece)
            piece = " ".join(piece.split())
            if piece:
                self._add(stack[-1], _TEXT, _TEXT, piece)

        for m in _TOKEN.finditer(html):
            a = m.start()
            if a > at:
                text(html[at:a])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in _IGNORED:
                continue
            if m["end"]:
                shut((tag,), ())
                continue
            if tag in _CLOSES_P:
                shut(("p",), ("table", "td", "th", "li", "div", "article", "section"))
            elif tag in _SAME:
                shut(*_SAME[tag])
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["rest"])} if m["rest"] else {}
            if len(stack) > DEPTH:
                parent = stack[-1]
            else:
                parent = self._add(stack[-1], tag, f"{tag}.{' '.join(sorted(found['class'].split()))}" if "class" in found else tag)
                if tag not in _VOID and not m["rest"].endswith("/"):
                    stack.append(parent)
            ref = found.get("href") or found.get("src")
            if ref:
                self._add(parent, _REF, _REF, ref)
        if at < len(html):
            text(html[at:])

    def text(self, without: set[int] = frozenset()) -> str:
        """The texts in order, a line for each block; ``without`` has the nodes whose branches are left out."""
        lines: list[list[str]] = [[]]
        gone = [False] * len(self.tags)
        block = [0] * len(self.tags)
        last = 0
        for i, tag in enumerate(self.tags):
            p = self.parents[i]
            gone[i] = i in without or p >= 0 and gone[p]
            block[i] = i if tag in _BLOCK else block[p]
            if tag == _TEXT and not gone[i]:
                if block[i] != last and lines[-1]:
                    lines.append([])
                last = block[i]
                lines[-1].append(self.values[i])
        return "\n".join(" ".join(x) for x in lines if x)


_M = (1 << 64) - 1
_ids: dict[str, int] = {}


def _id(text: str) -> int:
    found = _ids.get(text)
    if found is None:
        if len(_ids) > 300_000:
            _ids.clear()
        found = _ids[text] = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)
    return found


def _child(style: int, place: int) -> int:
    x = ((style & _M) ^ place * 0x9E3779B97F4A7C15 & _M) * 0xBF58476D1CE4E5B9 & _M
    return ((x ^ x >> 29) * 0x94D049BB133111EB & _M) - (1 << 63)


def mapped(page: Page, site: str) -> tuple[list[int], list[int], list[int]]:
    """(site node, its style, style that it belongs to) of each node of the page; leaves have style 0."""
    n = len(page.tags)
    node, style, above = [0] * n, [0] * n, [0] * n
    node[0] = _id(f"site|{site}")
    for i in range(n):
        kids = page.children[i]
        if not kids and page.tags[i] in _LEAVES:
            continue
        run, place = [], []
        for k in kids:
            if not run or run[-1] != page.keys[k]:
                run.append(page.keys[k])
            place.append(len(run))
        style[i] = s = _id(f"{node[i]}|{'|'.join(run)}")
        for k, at in zip(kids, place):
            node[k], above[k] = _child(s, at), s
    return node, style, above


_ROWS = "site string, node long, above long, leaf boolean, depth int, path long, item long, shared long, n long, first int"


def _observe(batches):
    """For each page, node and value (a style, or what a leaf holds): how often it occurs."""
    for batch in batches:
        rows = []
        for site, html in zip(batch.column("site").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            node, style, above = mapped(page, site)
            tags, values, parents = page.tags, page.values, page.parents
            depth, path = [0] * len(node), paths(page)
            about: dict[int, tuple[int, bool, int, int]] = {}
            seen: dict[tuple[int, int], int] = {}
            like: dict[int, int] = {}
            for i, k in enumerate(node):
                if i:
                    depth[i] = depth[parents[i]] + 1
                about[k] = (above[i], tags[i] in _LEAVES, depth[i], path[i])
                if tags[i] in _LEAVES:
                    item = xxhash.xxh64_intdigest(values[i].encode("utf-8", "replace")) - (1 << 63)
                    like[item] = item
                else:
                    item = style[i]
                    like[item] = _id("|".join(run_of(page, i)))
                seen[k, item] = seen.get((k, item), 0) + 1
            fresh = set(about)
            for (k, item), c in seen.items():
                first = k in fresh
                fresh.discard(k)
                rows.append((site, k, *about[k], item, like[item], c, int(first)))
        out = list(zip(*rows)) if rows else [[]] * 10
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["site", "node", "above", "leaf", "depth", "path", "item", "shared", "n", "first"])


def run_of(page: Page, i: int) -> list[str]:
    """Keys of a node's children, runs of equal ones once."""
    run: list[str] = []
    for k in page.children[i]:
        if not run or run[-1] != page.keys[k]:
            run.append(page.keys[k])
    return run


def paths(page: Page) -> list[int]:
    """Of each node, the path of tags and classes from the root, hashed: the same on all sites."""
    out = [_id("path")] * len(page.tags)
    for i in range(1, len(out)):
        out[i] = _child(out[page.parents[i]], _id(page.keys[i]))
    return out


def site_of(pages: DataFrame) -> DataFrame:
    """(page_id, site, html)."""
    html = F.col("html").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    alone = F.concat_ws("|", F.lit("page"), F.md5(F.coalesce(html, F.lit("")).cast("binary")), F.col("page_id").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(host != "", host).otherwise(alone).alias("site"), html.alias("html"))


def weigh(nodes: list[tuple[int, int, int, float]], styles: list[tuple[int, int, int]], gamma: float = GAMMA, least: float = LEAST) -> tuple[dict[int, float], set[int]]:
    """Composite importance of (node, style above, depth, own importance), and the topmost noise.

    ``styles`` has (node, style, times). Both are one site's.
    """
    below: dict[int, list[int]] = defaultdict(list)
    for node, above, _, _ in nodes:
        below[above].append(node)
    own_styles: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for node, style, times in styles:
        own_styles[node].append((style, times))
    value: dict[int, float] = {}
    best: dict[int, float] = {}
    for node, _, _, own in sorted(nodes, key=lambda x: -x[2]):
        mine = own_styles.get(node, [])
        kids = [(times, below[s]) for s, times in mine if below.get(s)]
        if kids:
            whole = sum(t for t, _ in kids)
            mean = sum(t / whole * sum(value[k] for k in ks) / len(ks) for t, ks in kids)
            damp = gamma ** len(mine)
            value[node] = (1 - damp) * own + damp * mean
            best[node] = max(value[node], max(best[k] for _, ks in kids for k in ks))
        else:
            value[node] = best[node] = own
    noise = {node for node in best if best[node] < least}
    of_style = {s: node for node, s, _ in styles}
    return value, {node for node, above, _, _ in nodes if node in noise and of_style.get(above) not in noise}


def importances(observed: DataFrame) -> DataFrame:
    """(site, node, above, depth, own, styles) of each node of the merged trees."""
    n = F.col("n").cast("double")
    keys = ["site", "node", "above", "leaf", "depth", "path"]
    sums = [F.sum("c").alias("c"), F.sum("cl").alias("cl"), F.sum("m").alias("m")]
    items = cut(observed.groupBy(*keys, "item", "shared").agg(F.sum(n).alias("c"), F.sum(n * F.log(n)).alias("cl"), F.sum("first").alias("m")))
    style = F.when(~F.col("leaf"), F.struct("item", F.col("c").cast("long").alias("times")))
    nodes = _own(items.groupBy(*keys), [F.collect_list(style).alias("styles")])
    shared = _own(items.groupBy("path", "leaf", "shared").agg(*sums).groupBy("path", "leaf"), []).select("path", "leaf", F.col("own").alias("pooled"))
    seen = F.col("m") - 1
    own = F.round((seen * F.col("own") + POOLED * F.col("pooled")) / (seen + POOLED), 9)
    return nodes.join(shared, ["path", "leaf"]).select("site", "node", "above", "depth", own.alias("own"), "styles")


def _own(groups, more: list) -> DataFrame:
    """Importance of each group by the entropies of its items(c, cl, m) over the pages; 1 for what one page has."""
    found = groups.agg(F.sum("m").alias("m"), F.count("*").alias("l"), F.sum("c").alias("all"), F.sum(F.col("c") * F.log("c")).alias("styled"), F.sum(F.log("c") - F.col("cl") / F.col("c")).alias("spread"), *more)
    leaf = 1 - F.col("spread") / F.col("l") / F.log(F.col("m").cast("double"))
    inner = (F.log("all") - F.col("styled") / F.col("all")) / F.log(F.col("m").cast("double"))
    return found.withColumn("own", F.when(F.col("m") < 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.when(F.col("leaf"), leaf).otherwise(inner), 9)))))


def _weigh(tree: pa.Table) -> pa.Table:
    rows = list(zip(*(tree.column(c).to_pylist() for c in ("node", "above", "depth", "own"))))
    styles = [(node, s["item"], s["times"]) for node, ss in zip(tree.column("node").to_pylist(), tree.column("styles").to_pylist()) for s in ss]
    _, noise = weigh(rows, styles)
    return pa.table({"node": pa.array(sorted(noise), pa.int64())})


def noise_nodes(pages: DataFrame) -> DataFrame:
    """(node): topmost noise of every site's tree; ``pages`` from site_of."""
    observed = pages.select("site", "html").mapInArrow(_observe, _ROWS)
    return importances(observed).groupBy("site").applyInArrow(_weigh, "node long")


_OUT = "page_id long, site string, text string, n_nodes int, n_removed int"


def _clean(batches, sent=None):
    for batch in batches:
        ids = batch.column("page_id")
        texts, counts, gone = [], [], []
        own = batch.column("noise").to_pylist() if sent is None else [None] * batch.num_rows
        for site, html, noise in zip(batch.column("site").to_pylist(), batch.column("html").to_pylist(), own):
            page = Page(html)
            node = mapped(page, site)[0]
            if sent is None:
                held = set(noise or ())
                drop = {i for i, k in enumerate(node) if k in held}
            else:
                drop = set(np.flatnonzero(_among(np.array(node, np.int64), sent.value)).tolist())
            texts.append(page.text(drop))
            counts.append(len(node) - 1)
            gone.append(len(drop))
        yield pa.RecordBatch.from_arrays([ids, batch.column("site"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, pa.int32())], ["page_id", "site", "text", "n_nodes", "n_removed"])


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def _page_nodes(batches):
    for batch in batches:
        keys, nodes = [], []
        for key, site, html in zip(batch.column("key").to_pylist(), batch.column("site").to_pylist(), batch.column("html").to_pylist()):
            for k in set(mapped(Page(html), site)[0]):
                keys.append(key)
                nodes.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], ["key", "node"])


def _narrow(batches):
    """Batches of at most 64 rows, as pages may be long."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield batch.slice(i, 64)


def extract(pages: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(page_id, site, text, n_nodes, n_removed): the page's text without its noisy branches."""
    spark = pages.sparkSession
    sited = site_of(pages)
    noise = cut(noise_nodes(sited))
    if noise.count() <= broadcast_nodes:
        sent = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in noise.collect()), np.int64))
        return sited.mapInArrow(lambda it: _clean(_narrow(it), sent), _OUT)
    keyed = sited.withColumn("key", F.xxhash64("site", "html"))
    there = keyed.select("key", "site", "html").mapInArrow(_page_nodes, "key long, node long").distinct()
    lists = there.join(noise, "node", "left_semi").groupBy("key").agg(F.collect_list("node").alias("noise"))
    return keyed.join(lists, "key", "left").select("page_id", "site", "html", "noise").mapInArrow(lambda it: _clean(_narrow(it)), _OUT)


def text_of(html: str | None) -> str:
    """All the text of a page, nothing removed."""
    return Page(html).text()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_style_tree_text": op5}
SQL: dict[str, str] = {}
