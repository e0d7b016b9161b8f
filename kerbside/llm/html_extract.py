"""Main text of web pages by a site style tree.

All pages of a host are merged into one style tree: a node is a path of
elements with their presentation (tag, class, id, role).  Text is measured by
units: blocks, and inline elements with a name of their own; other inline
elements belong to the unit they stand in.  Each page contributes to each node
on it how the node is laid out (the sequence of its units) and what it says (the
text of each of its units).  A node's composite importance weighs the entropy of
its layouts and the importance of its contents: a text that all of the host's
pages have in a node counts 0, one that a single page has counts 1, by its
entropy over the pages; texts weigh by their length.

What tags and names mean comes in twice.  It is evidence beside the pages, worth
PRIOR_PAGES of them, so that it matters on small sites and fades on large ones.
And it tells where each host's nodes part: of the cuts between two importances
that follow each other it is one that is wide and that most of it agrees with
(or THRESHOLD, which is the least).  Text of nodes under the cut is removed from
each page, whatever their tags and names; that of nodes over it stays.

Nodes on fewer than MIN_PAGES different pages are decided by tags and names
alone, text beside an article counting less there; copies of a page count once.
Scripts, styles and hidden elements are no text at all.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

MIN_PAGES = 8
#: What tags and names say of an element: 1 for it, SUSPECT against it, OUTSIDE as much where the page has an article elsewhere; up to PLAUSIBLE is against.
SUSPECT, OUTSIDE, PLAUSIBLE = 0.3, 0.5, 0.5
#: Tags and names weigh as much as this number of pages.
PRIOR_PAGES = 8.0
#: Power of the share of a host's pages on which tags and names agree with a cut.
CONSENT = 4.0
#: The least cut of a host; the cut where tags and names speak against no node.
THRESHOLD = 0.35
#: Weight of the layout against the contents falls with this power of the number of children.
DAMPING = 0.9
#: Branches that a broadcast may hold; with more, pages are joined by a shuffle.
BROADCAST_BRANCHES = 1_000_000

# Elements without content, elements whose text is not markup, and what each tag means.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption".split())
_UNWANTED = frozenset("head script style textarea title xmp iframe noembed noframes noscript template button select svg object canvas audio video math datalist".split())
_SUSPECT = frozenset("nav aside footer form dialog menu".split())
_ENDS_P = _BLOCKS - frozenset("body html head option optgroup caption tbody td tfoot th thead tr legend summary".split())
# An opening tag ends an open element of these tags, up to one of those.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
# Words of class, id and role that name what is not the article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices alert alerts overlay pager pagination popup popups privacy promo promos promotion related recommended recommendations replies reply respond search share sharing sidebar sidebars signup skip skiplink social sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar trending warning widget widgets".split()
)
_SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_GAP = re.compile(r"\s+")


class Node:
    """An element: its tag, presentation, path key, children (nodes and texts), prior (its own or its parent's, if less), and whether it is part of an article."""

    __slots__ = ("tag", "look", "key", "items", "prior", "named", "inside")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.items = tag, []
        own, self.named, self.look = 1.0, False, tag
        article = tag in ("article", "main")
        if "=" in attributes or "hidden" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            look = [f"{k}={found[k]}" for k in ("class", "id", "role") if k in found]
            if look:
                self.look, self.named = f"{tag} {' '.join(look)}", not article
                words = {w.lower() for k in ("class", "id", "role") if k in found for w in _SPLIT_NAME.split(found[k])}
                if tag not in ("html", "body") and not article and not words.isdisjoint(_NAMES) or "comment" in words or "comments" in words:
                    own = SUSPECT
            if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
                own = 0.0
        if tag in _UNWANTED:
            own = 0.0
        elif tag in _SUSPECT or tag == "header" and not (parent and parent.inside):
            own = min(own, SUSPECT)
        self.prior = min(own, parent.prior) if parent else own
        self.inside = bool(parent and parent.inside) or article and self.prior == 1.0
        self.key = xxhash.xxh3_64_intdigest(self.look, parent.key if parent else 0)


def parse(source: str) -> Node:
    """The tree of a page; missing end tags are supplied, stray ones ignored."""
    root = Node("#page", "", None)
    stack = [root]
    open_: Counter[str] = Counter()  # open elements by tag: what isn't open isn't looked for

    def shut(k: int) -> None:
        open_.subtract(n.tag for n in stack[k:])
        del stack[k:]

    at, low = 0, None
    while at < len(source):
        opening = source.find("<", at)
        if opening < 0:
            stack[-1].items.append(source[at:])
            break
        m = _TOKEN.match(source, opening)
        if m is None:
            stack[-1].items.append(source[at : opening + 1])
            at = opening + 1
            continue
        if opening > at:
            stack[-1].items.append(source[at:opening])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    shut(k)
                    break
                if tag == "p" and stack[k].tag in _BLOCKS:
                    break
            continue
        if tag in _ENDS_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag in _BLOCKS:
                    break
        if tag in _IMPLIED:
            ends, until = _IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1) if any(open_[e] for e in ends) else ():
                if stack[k].tag in until:
                    break
                if stack[k].tag in ends:
                    shut(k)
                    if tag in ("li", "dt", "dd", "td", "th", "option", "body"):
                        break
        node = Node(tag, m[3], stack[-1])
        stack[-1].items.append(node)
        if tag in _RAW:
            low = source.lower() if low is None else low
            if len(low) != len(source):  # a character whose lower case is longer
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in source)
            end = low.find("</" + tag, at)
            end = len(source) if end < 0 else end
            close = source.find(">", end)
            at = len(source) if close < 0 else close + 1
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def _unit(node: Node) -> bool:
    return node.named or node.tag in _BLOCKS


def features(root: Node) -> tuple[int, list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """(page, nodes, texts): a digest of the whole page; (path, layout, units, prior in thousandths) of each node that has text; (path, text, length) of the text of each of its units.

    Elements of one path are one node; each element is looked at once.
    """
    page = xxhash.xxh3_64()
    own: list[tuple[Node, list[str]]] = []
    todo: list[tuple[Node | str, list[str]]] = [(root, [])]
    while todo:
        item, said = todo.pop()
        if isinstance(item, str):
            said.append(item)
            page.update(item)
            continue
        page.update(f"<{item.look}>")
        if not item.prior or item.tag in _RAW:
            continue
        if item.tag == "br":
            said.append(" ")
        if item is root or _unit(item):
            said = []
            own.append((item, said))
        todo += [(x, said) for x in reversed(item.items)]
    layout: dict[int, xxhash.xxh3_64] = {}
    units: dict[int, int] = {}
    prior: dict[int, float] = {}
    texts: list[tuple[int, int, int]] = []
    for node, said in own:
        text = _GAP.sub(" ", html.unescape("".join(said))).strip()
        if not text:
            continue
        if node.key not in layout:
            layout[node.key], units[node.key], prior[node.key] = xxhash.xxh3_64(), 0, 0.0
        below = [x.look for x in node.items if isinstance(x, Node) and _unit(x)]
        layout[node.key].update("|".join(below) + ";")
        units[node.key] = max(units[node.key], len(below))
        prior[node.key] = max(prior[node.key], node.prior)
        texts.append((node.key, xxhash.xxh3_64_intdigest(text), len(text)))
    return page.intdigest(), [(k, layout[k].intdigest(), units[k], round(1000 * prior[k])) for k in layout], texts


def stays(node: Node, measured: dict[int, bool], outside: bool) -> bool:
    """Whether the text of a unit stays; `measured` says so for the host's nodes, `outside` that the page has an article, which matters where a node is not among them."""
    if not node.prior:
        return False
    known = measured.get(node.key)
    return node.prior * (OUTSIDE if outside and not node.inside else 1.0) > PLAUSIBLE if known is None else known


def blocks(root: Node, measured: dict[int, bool] | None = None) -> list[str]:
    """The text blocks of the page; each unit's own text stays or goes with its node, and what is below it with its own."""
    measured = measured or {}
    outside, todo_ = False, [root]
    while todo_ and not outside:
        n = todo_.pop()
        outside = n.inside and n.tag in ("article", "main")
        todo_ += [x for x in n.items if isinstance(x, Node)]
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = _GAP.sub(" ", html.unescape("".join(part))).strip()
        part.clear()
        if text:
            out.append(text)

    # (node or text, whether the unit around it stays), or None for the end of a block
    todo: list[tuple[Node | str, bool] | None] = [(root, stays(root, measured, outside))]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        what, keep = item
        if isinstance(what, str):
            if keep:
                part.append(what)
        elif what.tag == "br":
            part.append(" ")
        else:
            if what.tag in _BLOCKS:
                flush()
            if not what.prior:
                continue
            if what.tag in _BLOCKS:
                todo.append(None)
            if _unit(what):
                keep = stays(what, measured, outside)
            todo += [(x, keep) for x in reversed(what.items)]
    flush()
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_tree(pages: DataFrame, url: str, source: str, min_pages: int = MIN_PAGES, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """Rows (host, path, pages, prior, importance, cut): the merged tree of every host over its different pages, nodes on `min_pages` of them or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = [features(parse(s or "")) for s in batch.column("html").to_pylist()]
        lists = [pa.array([[_signed(f[k]) for f in page[part]] for page in seen], pa.list_(pa.int64())) for part, n in ((1, 4), (2, 3)) for k in range(n)]
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array([_signed(page[0]) for page in seen], pa.int64()), *lists], names=["host", "page", "path", "layout", "units", "prior", "at", "said", "length"])

    fields = ", ".join(f"{c} array<long>" for c in ("path", "layout", "units", "prior", "at", "said", "length"))
    seen = map_arrow(pages.select(host_key(url).alias("host"), F.col(source).alias("html")), run, f"host string, page long, {fields}", "html")
    seen = materialize(seen.dropDuplicates(["host", "page"]), "seen")  # read twice below
    nodes = seen.select("host", F.inline(F.arrays_zip("path", "layout", "units", "prior")))
    texts = seen.select("host", "page", F.inline(F.arrays_zip(F.col("at").alias("path"), F.col("said").alias("said"), F.col("length").alias("length"))))

    counts = nodes.groupBy("host", "path", "layout").agg(F.count(F.lit(1)).alias("n"), F.max("units").alias("units"), F.max("prior").alias("prior"))
    layouts = counts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.max("units").alias("units"), (F.max("prior") / 1000).alias("prior"))
    # 0 where all pages agree, 1 where no two do
    layouts = layouts.where(F.col("pages") >= min_pages).withColumn("layout", F.when(F.col("pages") > 1, 1 - F.col("s") / F.col("pages") / F.log2("pages")).otherwise(1.0))

    # how evenly a text is spread over the pages: n of them, s = sum of n log n over pages
    each = texts.groupBy("host", "path", "said", "page").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    spread = each.groupBy("host", "path", "said").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.max("length").alias("length"))
    bits = F.log2("n") - F.col("s") / F.col("n")
    weighed = spread.groupBy("host", "path").agg(F.sum(F.col("n") * F.col("length")).alias("size"), F.sum(F.col("n") * F.col("length") * bits).alias("bits"))

    share = F.pow(F.lit(DAMPING), F.col("units"))
    contents = F.when(F.col("pages") > 1, 1 - F.col("bits") / F.col("size") / F.log2("pages")).otherwise(1.0)
    composite = (1 - share) * F.col("layout") + share * contents
    tree = layouts.join(weighed, ["host", "path"]).select("host", "path", "pages", "prior", ((F.col("pages") * composite + prior_pages * F.col("prior")) / (F.col("pages") + prior_pages)).alias("importance"))
    return with_cut(tree)


def with_cut(tree: DataFrame) -> DataFrame:
    """`tree` (host, path, pages, prior, importance) with each host's cut: nodes of at least that importance stay.

    A cut lies in the middle of two importances that follow each other, at
    THRESHOLD or more.  It counts by their distance times the share of pages,
    to the power of CONSENT, of nodes that tags and names speak for above it and
    against below it.
    """
    falling = Window.partitionBy("host").orderBy(F.desc("importance"), "path")
    to_here, within = falling.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("host")
    against = F.when(F.col("prior") <= PLAUSIBLE, F.col("pages")).otherwise(0)
    for_ = F.col("pages") - against
    agreed = (F.sum(for_).over(to_here) + F.sum(against).over(within) - F.sum(against).over(to_here)) / F.sum("pages").over(within)
    rows = tree.withColumns({"_next": F.lead("importance").over(falling), "_agreed": agreed, "_against": F.sum(against).over(within)}).where("_next is not null")
    worth = (F.col("importance") - F.col("_next")) * F.pow(F.col("_agreed"), F.lit(CONSENT))
    cuts = rows.where("_against > 0").groupBy("host").agg(F.max_by((F.col("importance") + F.col("_next")) / 2, F.struct(worth, "importance")).alias("_cut"))
    return tree.join(cuts, "host", "left").withColumn("cut", F.greatest(F.coalesce("_cut", F.lit(THRESHOLD)), F.lit(THRESHOLD))).drop("_cut")


def host_key(url: str) -> F.Column:
    """The host with A-Z lower-cased; empty for a null url or one without `://`."""
    found = F.regexp_extract(F.col(url), r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html", *, min_pages: int = MIN_PAGES, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """Rows (id_col, url, text, n_chars), one for each row of `pages`.

    Character references are decoded, white space within a block is one space,
    blocks are joined by an empty line.  Null or empty html gives an empty
    text; ids may be null or repeated (a repeated page is one page of the tree);
    very long and very deep pages are walked once, stray end tags included;
    other columns are ignored.  An empty table gives no rows.
    """
    tree = style_tree(pages, url, source, min_pages, prior_pages)
    tree = materialize(tree.groupBy("host").agg(F.collect_list(F.struct("path", (F.col("importance") >= F.col("cut")).alias("stays"))).alias("nodes"), F.count(F.lit(1)).alias("n")), "tree")
    size = tree.agg(F.sum("n")).first()[0] or 0
    branches = tree.select("host", F.col("nodes.path").alias("path"), F.col("nodes.stays").alias("stays"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"), host_key(url).alias("host"))
    joined = rows.join(F.broadcast(branches) if size <= BROADCAST_BRANCHES else branches, "host", "left").select("id", "url", "path", "stays", "html")
    kinds = f"id {pages.schema[id_col].dataType.simpleString()}, url string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for page, path, keep in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "stays")), strict=True):
            measured = {k & (1 << 64) - 1: v for k, v in zip(path or (), keep or (), strict=True)}
            texts.append("\n\n".join(blocks(parse(page or ""), measured)))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = map_arrow(joined, run, f"{kinds}, text string", "html")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
