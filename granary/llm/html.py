"""HTML extraction with a site style tree.

Every page becomes a tree of elements. Elements of one host's pages that share a style path (tags with their classes,
from the root) are merged into one node of the host's style tree: menus, adverts and footers as well as articles. A node
has two entropies over the host's distinct pages, each divided by the logarithm of the number of pages: of its
presentation (the child elements) and of its content (the text below it). Two rules remove the branches of nodes on
MIN_PAGES pages or more from each page:

- a node whose larger entropy is under LOW_IMPORTANCE repeats across the site;
- the children of a node are slots of a template if its presentation varies less than theirs. Where the best slot's
  presentation has an entropy of MIN_VARIETY (nats, whatever the number of pages), slots with less than SLOT_SHARE of it
  go, if their parent has less too: a menu, an advert, a footer beside an article, even where all their texts differ.
  Only slots on half of their parent's pages set the bar.

The second rule leaves alone plain text elements, elements that hold an article or main element, and all inside of these.
Plain text elements of an article stay even where all pages of a host repeat them. After the tree, fixed lists remove what
it has left: elements and class words that mark menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, as on hosts of a few pages, or where comments vary as articles do. Where a page has an article or main element,
only its text counts.

The style tree is two aggregations with map-side combining, so a host with a third of all pages is no hot task. The low
nodes of a host are one row, joined back to its pages by host; that table is written first, so Spark broadcasts it only
if its known size is under spark.sql.autoBroadcastJoinThreshold and sorts and merges (with skewed hosts split) beyond.
Nothing is collected. Pages are parsed twice, for the tree and for the text, which costs less disk than keeping their
blocks. Pages of a host with equal html count once.

Null and empty html give an empty text, an empty table no rows. Repeated rows get equal results. A url without a host is a
host of its own. Very long pages are parsed alone, whole. Other columns are ignored, whatever their names. Where the two
entropies tie, either is the importance; equally varied slots all stay.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import by_bytes, written

MIN_PAGES = 8
LOW_IMPORTANCE = 0.2
MIN_VARIETY = 2.0
SLOT_SHARE = 0.5

#: Which rules may remove a node: both, the first only, none.
SLOT, REPEATED, STAYS = 0, 1, 2

# How HTML groups its elements, and the words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset("head nav footer aside form menu dialog button input".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert banner newsletter subscribe popup modal overlay comment comments disqus respond widget pagination pager login signup skip toolbar masthead topbar".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table thead tbody tr td th dl dt dd figure figcaption b i em strong a span code br".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s>/]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
#: The host of a url, for Spark's regexp_extract.
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class _Element:
    __slots__ = ("tag", "path", "dropped", "mute", "main", "chain")

    def __init__(self, tag, path, dropped, mute, main, chain):
        self.tag, self.path, self.dropped, self.mute, self.main, self.chain = tag, path, dropped, mute, main, chain


class _Node:
    """A style node of one page: its parent, the rules it is under, styles of its child elements, hashes of its texts."""

    __slots__ = ("parent", "rule", "children", "texts")

    def __init__(self, parent, rule):
        self.parent, self.rule, self.children, self.texts = parent, rule, [], []


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def parse(html: str) -> tuple[list[tuple[str, tuple[int, ...]]], list[tuple[int, int, int, int, int]]]:
    """Text blocks of a page with the style nodes above each, and the page's style nodes: path, parent, rule, presentation, content.

    Blocks are those that the fixed lists leave. Plain elements of an article are no style nodes.
    """
    root = _hash("")
    nodes = {root: _Node(root, STAYS)}
    stack = [_Element("", "", False, False, False, (root,))]
    blocks: list[tuple[str, tuple[int, ...], bool, bool]] = []
    held: list[str] = []
    any_main = False

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                blocks.append((text, top.chain, top.dropped, top.main))
                mark = str(_hash(text))
                for node in top.chain:
                    nodes[node].texts.append(mark)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        top = stack[-1]
        if m is None:
            if not top.mute:
                held.append(html[at:])
            break
        if m.start() > at and not top.mute:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        closing = m.group(1) or m.group(4)
        if closing:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if top.dropped and not top.mute and not stack[k - 1].dropped:
                        flush()  # an inline end that closes a dropped block
                    del stack[k:]
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph; an item ends the item before it
                if stack[k].tag == "p" or stack[k].tag == tag and tag in ("li", "dt", "dd", "tr", "option"):
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
            top = stack[-1]
        elif tag in ("td", "th"):
            held.append(" ")
        if tag in VOID:
            continue
        marks, role, hidden, prop = "", "", False, ""
        attributes = m.group(3) or m.group(6)
        if attributes and attributes.strip(" /"):
            for a in _ATTRIBUTE.finditer(attributes):
                name, value = a.group(1).lower(), (a.group(2) or a.group(3) or a.group(4) or "").lower()
                if name in ("class", "id"):
                    marks += " " + value
                elif name == "role":
                    role = value
                elif name == "itemprop":
                    prop = value
                else:
                    hidden = hidden or name == "hidden" or value == "true"
        main = top.main or (not top.dropped and (tag in ("article", "main") or role == "main" or prop == "articlebody"))
        words = set(_WORD.findall(marks))
        dropped = top.dropped or hidden or tag in DROPPED or role in DROPPED_ROLES or bool(words & DROPPED_WORDS) or ("header" in words or tag == "header") and not top.main
        if tag in ("html", "body"):
            dropped = False
        mute = dropped and (top.mute or not top.dropped and tag not in BLOCK)
        main = main and not dropped
        any_main = any_main or main
        path, chain = top.path, top.chain
        if not mute and tag != "head":
            style = tag + "." + ".".join(sorted(re.sub(r"[^a-z]+", "", w) for w in marks.split()))
            path = f"{path}/{style}"
            nodes[chain[-1]].children.append(style)
            plain = tag in PLAIN and not marks
            if not (main and plain):
                node = _hash(path)
                rule = STAYS if tag in ("html", "body") or main and not top.main else REPEATED if main or plain else SLOT
                if node not in nodes:
                    nodes[node] = _Node(chain[-1], rule)
                nodes[node].rule = max(nodes[node].rule, rule)
                chain = (*chain, node)
            if main and not top.main:
                for node in chain:
                    nodes[node].rule = STAYS
        stack.append(_Element(tag, path, dropped, mute, main, chain))
    flush()
    kept = [(text, chain) for text, chain, dropped, main in blocks if not dropped and (main or not any_main)]
    return kept, [(k, x.parent, x.rule, _hash("\1".join(x.children)), _hash(" ".join(x.texts))) for k, x in nodes.items()]


_NODES = "host string, html_key long, nodes array<struct<path: bigint, parent: bigint, rule: int, presentation: bigint, content: bigint>>"
_NODE = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("rule", pa.int32()), ("presentation", pa.int64()), ("content", pa.int64())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.name for field in _NODE]
    for batch in by_bytes(batches, "html"):
        nodes = pa.array([[dict(zip(names, x)) for x in parse(h or "")[1]] for h in batch.column("html").to_pylist()], pa.list_(_NODE))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("html_key"), nodes], ["host", "html_key", "nodes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html"):
        texts = []
        for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist()):
            gone = frozenset(low or ())
            texts.append("\n\n".join(t for t, chain in parse(page or "")[0] if gone.isdisjoint(chain)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def parsed_pages(rows: DataFrame) -> DataFrame:
    """host, html_key and style nodes of each page (host, html)."""
    return rows.select("host", F.xxhash64("html").alias("html_key"), "html").mapInArrow(_nodes, _NODES)


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, path, node, above (the parent's node), rule, pages, presentation and content of each node of the hosts' style trees."""
    distinct = parsed.groupBy("host", "html_key").agg(F.first("nodes").alias("nodes"))
    nodes = distinct.select("host", F.explode("nodes").alias("n")).select(F.xxhash64("host", "n.path").alias("node"), "host", "n.*")
    # a node of 64 bits for host and path keeps the rows of the larger shuffle short
    values = nodes.select("node", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("presentation").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("v"))
    counts = values.groupBy("node", "v.kind", "v.value").agg(F.count("*").alias("c"))
    of = {k: F.sum(F.when(F.col("kind") == k, F.col("c") * F.log("c")).otherwise(0.0)) for k in (0, 1)}
    sums = counts.groupBy("node").agg(F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"), of[0].alias("s0"), of[1].alias("s1"))

    def entropy(s: str):
        return F.when(F.col("pages") > 1, F.round(1 - F.col(s) / F.col("pages") / F.log("pages"), 9)).otherwise(1.0)

    named = nodes.groupBy("node").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("parent").alias("parent"), F.max("rule").alias("rule"))
    return sums.join(named, "node").select("host", "path", "node", F.xxhash64("host", "parent").alias("above"), "rule", "pages", entropy("s0").alias("presentation"), entropy("s1").alias("content"))


def low_nodes(tree: DataFrame) -> DataFrame:
    """host, path of the nodes of a style tree whose branches are removed from the host's pages."""
    varied = tree.withColumn("variety", F.col("presentation") * F.log("pages"))
    parents = varied.select(F.col("node").alias("above"), F.col("pages").alias("above_pages"), F.col("variety").alias("above_variety"))
    slots = varied.where("node <> above").join(parents, "above")
    best = slots.where("2 * pages >= above_pages").groupBy("above").agg(F.max("variety").alias("best"))
    repeated = F.greatest("presentation", "content") < LOW_IMPORTANCE
    slot = (F.col("rule") == SLOT) & (F.col("best") >= MIN_VARIETY) & (F.greatest("variety", "above_variety") < SLOT_SHARE * F.col("best"))
    return slots.join(best, "above", "left").where((F.col("rule") < STAYS) & (F.col("pages") >= MIN_PAGES) & (repeated | F.coalesce(slot, F.lit(False)))).select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    tree = written(style_tree(written(parsed_pages(rows))))
    low = written(low_nodes(tree).groupBy("host").agg(F.collect_set("path").alias("low")))
    out = rows.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
