"""Main text of web pages by site style trees.

The pages of one host are merged into a tree whose nodes are element paths (tags with
their classes).  For each node, over the host's different pages, two entropies are
taken: of its presentation (the sequence of its children's names) and of its content
(all that lies below it).  Scaled to 0..1 they add up to the node's importance; menus and
notices that look and read the same everywhere come out near 0, articles near 1.

One score decides on every branch of every page: its importance times two priors.  The
first is what the element says about itself: ``STRONG`` marks (navigation, footers,
forms, adverts, reader comments) leave a quarter, ``WEAK`` ones (widget, notice, related)
a half.  The second is where it stands: inside an article or main element, or around one, 1,
outside of it 0.4, on a page that marks none 0.8.  Branches below the
threshold go; a main element stands for itself, whatever is around it.  A host with
fewer than ``min_pages`` different pages has no tree, and the importance ``UNKNOWN``.

Entropies need only counts, so the tree is built by partial aggregation: no host,
however large, meets in one task.  Importances below ``SURE`` go to the tasks while they
number at most ``max_keys``; above that they are joined to the pages by host.

Cases: null pages are empty; a page that is all noise has the empty text; a null url is
a host of its own; copies of a page count once in the tree; repeated rows are each
extracted; tags may be unclosed, nested wrongly or cut off; very long and deeply nested
pages take linear time; equal importances need no order; further columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .scratch import Scratch

#: Elements that hold no article text, whatever is in them.
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe object embed svg canvas audio video button select option textarea input label fieldset dialog menu map applet".split())
#: Words in a class or id that say what an element surely is, and what it may be.
STRONG_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer bottombar sidebar "
    "cookie cookies consent gdpr popup modal comment comments commentlist disqus replies respond sharing newsletter subscribe signup pagination pager toolbar".split()
)
WEAK_NAMES = frozenset("promo promotion banner rail widget widgets notice notices alert overlay sidebox reply share social follow related recommended login search".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: An opening tag ends an open element of these kinds, up to the nearest list or table.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu"}

PLAIN, WEAK, STRONG = 0, 1, 2
#: What a mark leaves of an importance; and a place: inside an article, outside of one, on a page without.
MARKS, INSIDE, OUTSIDE, OPEN = (1.0, 0.5, 0.25), 1.0, 0.4, 0.8
#: Importance of all nodes of hosts without a tree; importances from which on no prior but STRONG's removes a branch of an open place.
UNKNOWN, SURE = 0.7, 0.76


@dataclass(slots=True, eq=False)
class Node:
    """An element path of a page; elements with equal paths are one node."""

    above: Node | None
    name: str
    mark: int = PLAIN
    inside: bool = False  # of an article or main element
    main: bool = False
    holds: bool = False  # has an article or main element below
    key: int = 0
    children: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)  # texts and nodes, in order
    kept: bool | None = None

    def child(self, name: str, mark: int, inside: bool, main: bool) -> Node:
        found = self.children.get(name)
        if found is None:
            found = self.children[name] = Node(self, name, mark, inside, main, key=_hash(f"{self.key}/{name}"))
            self.parts.append(found)
            above = self if inside else None
            while above is not None and not above.holds:
                above.holds, above = True, above.above
        return found


def _named(attributes: str) -> tuple[str, int, bool]:
    """Name for the path, what it marks, whether it names the main part."""
    label, mark, main = [], PLAIN, False
    for kind, a, b, c in _NAMED.findall(attributes):
        value, kind = a or b or c, kind.lower()
        if kind == "role":
            mark = STRONG if value.strip().lower() in _ROLES else mark
            main |= value.strip().lower() == "main"
            continue
        words = _WORD.findall(_CAMEL.sub(" ", value).lower())
        mark = max(mark, STRONG if not STRONG_NAMES.isdisjoint(words) else WEAK if not WEAK_NAMES.isdisjoint(words) else PLAIN)
        label += words
    return ".".join(label), mark, main


def blocks(html: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """The page's tree, and (node, text) of every block with text in page order."""
    html = html or ""
    root = Node(None, "")
    out: list[tuple[Node, str]] = []
    stack: list[tuple[str, Node, bool]] = []  # tag, node, whether it breaks the text
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                node = stack[-1][1] if stack else root
                node.parts.append(text)
                out.append((node, text))

    def close(depth: int) -> None:
        if any(x[2] for x in stack[depth:]):
            flush()
        del stack[depth:]

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        said = html[at : found.start()] if found else html[at:]
        if said:
            parts.append(unescape(said) if "&" in said else said)
        if not found:
            break
        at = max(found.end(), at + 1)
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            else:
                if tag in BLOCK_TAGS:
                    flush()
            continue
        if tag in RAW_TAGS:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else end
            if tag in BLOCK_TAGS:
                flush()
            continue
        if tag in VOID_TAGS:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        # Classes of the whole page say nothing about its parts.
        label, mark, main = _named(attributes) if attributes and tag not in ("html", "body") else ("", PLAIN, False)
        mark = STRONG if tag in NOISE_TAGS else mark
        if tag == "body":  # whatever came before it is over
            close(0)
        if tag in BLOCK_TAGS:
            if tag in _ENDS:
                ends, bounds = _ENDS[tag]
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in bounds:
                        break
                    if stack[depth][0] in ends:
                        close(depth)
                        break
            else:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][0] in BLOCK_TAGS:
                        break
            flush()
        elif mark == PLAIN:
            continue  # plain inline elements are part of their block
        else:
            flush()
        above = stack[-1][1] if stack else root
        if (tag == "header" or "header" in label.split(".")) and not above.inside:  # a heading of the article is part of it
            mark = STRONG
        main |= tag == "main"
        node = above.child(f"{tag}.{label}" if label else tag, mark, above.inside or main or tag == "article", main)
        stack.append((tag, node, tag in BLOCK_TAGS or mark > PLAIN))
    flush()
    return root, out


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


#: Stands among a host's importances if the host has a tree.
_TREE = _hash("")


def main_text(html: str | None, low: Mapping[int, float] | None = None, threshold: float = 0.3) -> str:
    """The kept blocks; ``low`` has the host's importances below ``SURE`` by node, and ``_TREE`` if it has a tree."""
    _, found = blocks(html)
    low = low or {}
    other = 1.0 if _TREE in low else UNKNOWN
    away = OUTSIDE if any(node.inside for node, _ in found) else OPEN

    def stays(node: Node) -> bool:
        path = []
        while node.above is not None and node.kept is None:
            path.append(node)
            node = node.above
        kept = True if node.above is None else node.kept
        for node in reversed(path):
            score = low.get(node.key, other) * MARKS[node.mark] * (INSIDE if node.inside or node.holds else away)
            kept = node.kept = (node.main or kept) and score >= threshold
        return kept

    return "\n".join(text for node, text in found if stays(node))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def digests(root: Node) -> list[tuple[int, int, int]]:
    """(key, content, shape) of the root and all nodes with text below, parents first."""
    order = [root]
    for node in order:
        order += node.children.values()
    known: dict[Node, tuple[int, int]] = {}
    for node in reversed(order):  # children before their parents
        there = [p for p in node.parts if isinstance(p, str) or p in known]
        if there or node is root:
            content = _hash("\n".join(f"={p}" if isinstance(p, str) else f"+{known[p][0]}" for p in there))
            known[node] = content, _hash("/".join("#" if isinstance(p, str) else p.name for p in there))
    return [(node.key, *known[node]) for node in order if node in known]


def branch_counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, page, content, shape), all hashes but host, once for every different page of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int, int, int]] = []
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes = digests(blocks(value.as_py())[0])
                page = nodes[0][1]
                rows += [(host, key, page, content, shape) for key, content, shape in nodes[1:]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] + [pa.int64()] * 4, strict=True)], ["host", "path", "page", "content", "shape"])

    named = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col))
    return named.mapInArrow(run, "host string, path long, page long, content long, shape long").distinct()


def importance(counts: DataFrame, weight: float = 0.9) -> DataFrame:
    """(host, path, pages, importance) of every node of every host's tree."""

    def entropy(column: str) -> DataFrame:
        c = counts.groupBy("host", "path", column).agg(F.count(F.lit(1)).alias("c"))
        m = F.sum("c").cast("double")
        h = F.log(m) - F.sum(F.col("c") * F.log(F.col("c").cast("double"))) / m
        return c.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.when(m > 1, h / F.log(m)).otherwise(1.0).alias(f"h_{column}"))

    both = entropy("content").join(entropy("shape").drop("pages"), ["host", "path"])
    return both.select("host", "path", "pages", (F.lit(weight) * F.col("h_content") + F.lit(1 - weight) * F.col("h_shape")).alias("importance"))


def extract(
    pages: DataFrame,
    threshold: float = 0.3,
    min_pages: int = 4,
    max_keys: int = 200_000,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "site-tree")
    counts = scratch.save(branch_counts(pages, url_col, html_col))
    low = importance(counts).where((F.col("pages") >= min_pages) & (F.col("importance") < SURE))
    trees = counts.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    low = scratch.save(low.select("host", "path", "importance").unionByName(trees.select("host", F.lit(_TREE).alias("path"), F.lit(1.0).alias("importance"))))
    wanted = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if low.count() <= max_keys:
        by_host = {host: (part["path"].to_numpy(), part["importance"].to_numpy()) for host, part in low.toPandas().groupby("host")}
        shared = spark.sparkContext.broadcast(by_host)
        held = wanted.withColumn("low", F.lit(None).cast("array<struct<path:long,importance:double>>"))
    else:  # joined by host; adaptive execution splits a large one
        shared = None
        held = wanted.join(low.groupBy("host").agg(F.collect_set(F.struct("path", "importance")).alias("low")), "host", "left").select("page_id", "url", "html", "host", "low")
    ids = held.schema["page_id"]
    schema = StructType([StructField("page_id", ids.dataType), StructField("url", held.schema["url"].dataType), StructField("text", StringType(), False)])
    none = (np.zeros(0, np.int64), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, dict[int, float]] = {}
        for batch in batches:
            texts = []
            for html, host, own in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if shared is None:
                    mine = {x["path"]: x["importance"] for x in own.as_py() or ()}
                elif (mine := trees.get(host)) is None:
                    mine = trees[host] = dict(zip(*(x.tolist() for x in shared.value.get(host, none)), strict=True))
                texts.append(main_text(html.as_py(), mine, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return held.mapInArrow(run, schema).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
