"""Main text of web pages with the help of site style trees.

Pages become trees of block elements. All pages of a host are merged: nodes
with the same path of tags and classes are one node of the site's tree. How
evenly a node's texts are spread over the pages tells its content importance
(the same texts on many pages: little), how its children's layouts vary its
presentation importance; branches of low importance are removed from each
page. A node that too few pages of the host have is judged by the tree of
the domain above it, or else by that of all sites.

What a page declares an article or main part has a prior of importance by
that declaration, what lies outside of it a prior against it; menus, adverts,
forms and the like are noise by theirs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import map_arrow
from gridloom.plans.durable import cut

#: Pages with a node from which on a site can tell texts drawn from a small stock from texts of one page only, and the limit then.
MANY_PAGES, LEAST_OF_MANY = 64, 0.95
#: The limit of a composite importance elsewhere, and the pages that any judgement needs.
LEAST_IMPORTANCE, LEAST_PAGES = 0.35, 5
#: Weight of a page's declaration of an article against the importance, and the limit that follows inside of it.
PRIOR = 0.3
LEAST_INSIDE = (LEAST_IMPORTANCE - PRIOR) / (1 - PRIOR)
#: The limit outside of a declared article: next to no text on two pages.
LEAST_OUTSIDE = 0.99
#: Weight of what lies below a node against its own presentation, per child.
DAMPING = 0.9
#: Bytes of judged branches of all hosts that may be broadcast.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z|([^<]+|<)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is markup of another kind, up to the end tag; without one, those of the first kind reach to the end of the page, others are empty.
RAW_TO_END = frozenset("script style".split())
RAW = RAW_TO_END | frozenset("title textarea noscript iframe noembed noframes template xmp svg".split())
#: Elements that are never main text.
NOISE_TAGS = frozenset("head nav aside footer form menu dialog select button fieldset object canvas audio video map".split())
#: Words of which a name in class, id or role is made that marks noise anywhere, and those that do so outside the article.
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies dialog disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices
    notification pagination pager popup promo promoted promotion related reply replies respond share sharing sidebar signup
    social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search""".split()
)
OUTER_NOISE_WORDS = frozenset("header masthead top topbar".split())
#: Start tags that end an open element of the first kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class Element:
    tag: str
    node: int
    inside: bool
    noise: bool
    children: dict[str, None] = field(default_factory=dict)
    at: int = -1
    hard: bool = False
    article: bool = False
    gone: bool = False


@dataclass
class Block:
    node: int
    text: str
    inside: bool
    gone: bool
    headline: bool


@dataclass(frozen=True)
class Verdicts:
    """Nodes of a site's tree, by what follows for their text."""

    low: frozenset[int] = frozenset()
    repeated: frozenset[int] = frozenset()
    own: frozenset[int] = frozenset()


def _signed(value: int) -> int:
    return value - ((value >> 63) << 64)


def node_below(parent: int, key: str) -> int:
    """A node of the tree: the hash of the node above it and the element's own key, so that depth costs nothing."""
    return _signed(xxhash.xxh3_64_intdigest(key.encode(errors="replace"), seed=parent & (2**64 - 1)))


def _made_of(names: list[str], words: frozenset[str]) -> bool:
    """Whether all parts of one of the names are such words: ``cookie-notice``, but not ``no-sidebar`` or ``has-comments``."""
    return any(parts and words.issuperset(parts) for parts in (re.findall(r"[^\W_]+", name) for name in names))


def parse_page(
    source: str, spared: frozenset[int] = frozenset(), low: frozenset[int] = frozenset()
) -> tuple[list[Block], list[tuple[int, str]], bool]:
    """Blocks that no declaration marks as noise, (node, layout) of their elements, and whether an article with text is declared.

    Names do not count on html and body. Where they would leave a page
    without its articles, they do not count on these and on what holds them
    (``spared``, by the places of the tags). Blocks below a node in ``low``
    are marked as gone. Time and memory grow with the page, not its depth.
    """
    blocks: list[Block] = []
    layouts: list[tuple[int, str]] = []
    root = Element("", 0, False, False)
    stack, buffer = [root], []
    open_tags: Counter = Counter()
    holders: set[int] = set()

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            top = next(e for e in reversed(stack) if e.tag not in INLINE)
            blocks.append(Block(top.node, text, top.inside, top.gone, top.tag == "h1"))

    def push(element: Element) -> None:
        stack.append(element)
        open_tags[element.tag] += 1

    def close_down_to(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            open_tags[element.tag] -= 1
            if not element.noise and element.tag not in INLINE:
                layouts.append((element.node, ",".join(element.children)))

    def nearest(tag: str, through: frozenset[str] | None = None) -> int:
        """Depth of the innermost open element of that tag, looked for through elements of these tags only; 0 if there is none."""
        if not open_tags[tag]:
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == tag:
                return depth
            if through is not None and stack[depth].tag not in through:
                return 0
        return 0

    at, size = 0, len(source)
    while at < size:
        match = _TOKEN.match(source, at)
        start, at = at, match.end()
        text = match[7]
        if text is not None:
            if not stack[-1].noise:
                buffer.append(html.unescape(text))
            continue
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        attributes = match[3] or match[6] or ""
        if match[1] or match[4]:
            depth = nearest(tag, INLINE if tag in INLINE else None)
            if tag not in INLINE:
                flush()
            if depth:
                close_down_to(depth)
            continue
        if tag in RAW:
            end = None
            if not (tag == "svg" and attributes.endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else size if tag in RAW_TO_END else at
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ") if tag == "br" else flush()
            continue
        names: set[str] = set()
        whole: list[str] = []
        if attributes:
            for groups in _NAMES.findall(attributes):
                whole += "".join(groups).lower().split()
            for name in whole:
                names.update(re.split(r"[^a-z0-9]+", name))
        named = bool(whole) and start not in spared and tag not in ("html", "body") and _made_of(whole, NOISE_WORDS)
        above = stack[-1]
        if tag in INLINE:
            if named and not above.noise:
                push(Element(tag, above.node, above.inside, True, at=start, hard=above.hard, article=above.article, gone=above.gone))
            continue
        flush()
        if above.tag == "p" or tag == "p":
            depth = nearest("p", INLINE)
            if depth:
                close_down_to(depth)
        if tag in _CLOSES and stack[-1].tag in _CLOSES[tag]:
            close_down_to(len(stack) - 1)
        parent = stack[-1]
        article = tag in ("article", "main") or "main" in names and "role" in attributes.lower()
        hard = parent.hard or tag in NOISE_TAGS or (tag == "header" and not parent.inside and not article)
        noise = parent.noise or hard or named
        if not parent.inside and not article and tag not in ("html", "body") and start not in spared and _made_of(whole, OUTER_NOISE_WORDS):
            noise = True
        if article and not hard and not parent.article:
            holders.update(e.at for e in stack)
            holders.add(start)
        inside = parent.inside or (article and not noise)
        key = tag + "".join(f".{n}" for n in sorted(names) if n)
        parent.children[key] = None
        node = node_below(parent.node, key)
        push(Element(tag, node, inside, noise, at=start, hard=hard, article=parent.article or article, gone=parent.gone or node in low))
    flush()
    close_down_to(0)
    declared = any(b.inside for b in blocks)
    if holders and not spared and not declared:
        return parse_page(source, frozenset(holders), low)
    return blocks, layouts, declared


def extract(source: str, verdicts: Verdicts = Verdicts()) -> str:
    """Main text of a page, without the branches of low importance.

    On a page that declares an article, its text without the nodes
    ``repeated`` on the site, and outside of it the nodes whose texts are the
    page's ``own`` and a headline before an article without one. An article
    of repeated nodes only is kept.
    """
    blocks, _, declared = parse_page(source, low=verdicts.low)
    if not declared:
        return " ".join(b.text for b in blocks if not b.gone)
    first = next(i for i, b in enumerate(blocks) if b.inside)
    headless = not any(b.inside and b.headline for b in blocks)
    whole = not any(b.inside and b.node not in verdicts.repeated for b in blocks)

    def stays(at: int, block: Block) -> bool:
        if block.inside:
            return whole or block.node not in verdicts.repeated
        return block.node in verdicts.own or (headless and block.headline and at < first)

    return " ".join(b.text for i, b in enumerate(blocks) if stays(i, b))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    """The last two labels of a host's name."""
    return F.substring_index(host, ".", -2)


def page_features(pages: DataFrame) -> DataFrame:
    """``host, path, kind, key, n`` of ``host, html``: on how many different pages of the host a node has a text or layout.

    Kinds are 0 for texts outside of declared articles, 1 for layouts, 2 for
    texts inside.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, kinds, keys, pages = [], [], [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, layouts, _ = parse_page(source or "")
                page = _signed(xxhash.xxh3_64_intdigest((source or "").encode(errors="replace")))
                found = {(b.node, 2 if b.inside else 0, xxhash.xxh3_64_intdigest(b.text.encode(errors="replace"))) for b in blocks}
                found |= {(node, 1, xxhash.xxh3_64_intdigest(x.encode(errors="replace"))) for node, x in layouts}
                for node, kind, key in found:
                    hosts.append(host)
                    paths.append(node)
                    kinds.append(kind)
                    keys.append(_signed(key))
                    pages.append(page)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()), *(pa.array(x, pa.int64()) for x in (keys, pages))],
                ["host", "path", "kind", "key", "page"],
            )

    seen = map_arrow(pages, features, "host string, path long, kind int, key long, page long")
    return seen.groupBy("host", "path", "kind", "key").agg(F.count_distinct("page").alias("n"))


def style_tree(counts: DataFrame, *scope: str) -> DataFrame:
    """``*scope, path, importance, pages, has_text, outside`` of the nodes of each scope's tree, from its features.

    For a node on m > 1 pages, an entropy H is taken to base m: over its
    texts it is 0 for texts of one page only and 1 for those of all pages,
    and 1 less their mean is the content importance; over its layouts it is
    the presentation importance. A node's composite is its content where it
    has text, else its presentation, which counts the less the fewer
    different layouts there are. Equal pages of a host count once. ``outside``
    nodes have text outside of declared articles.
    """
    text, layout = F.col("kind") != 1, F.col("kind") == 1
    nodes = counts.groupBy(*scope, "path").agg(
        F.sum(F.when(layout, F.col("n"))).alias("pages"),
        F.sum(F.when(text, F.lit(1))).alias("texts"),
        F.sum(F.when(text, F.log("n"))).alias("log_n"),
        F.sum(F.when(layout, F.lit(1))).alias("layouts"),
        F.sum(F.when(layout, F.col("n") * F.log("n"))).alias("n_log_n"),
        F.max(F.col("kind") == 0).alias("outside"),
    )
    m = F.greatest(F.coalesce("pages", F.lit(1)), F.lit(2))
    content = 1 - F.col("log_n") / F.col("texts") / F.log(m)
    presentation = (F.log("pages") - F.col("n_log_n") / F.col("pages")) / F.log(m)
    weight = F.pow(F.lit(DAMPING), F.col("layouts"))
    composite = F.when(F.col("texts") > 0, content).otherwise((1 - weight) * presentation + weight)
    importance, pages_seen = F.greatest(composite, F.lit(0.0)), F.coalesce("pages", F.lit(0))
    has_text = F.coalesce(F.col("texts") > 0, F.lit(False))
    return nodes.select(*scope, "path", importance.alias("importance"), pages_seen.alias("pages"), has_text.alias("has_text"), "outside")


_JUDGED = ("low", "repeated", "own")


def judged_nodes(counts: DataFrame) -> DataFrame:
    """``host, low, repeated, own``: arrays of the nodes of each host about which its tree, or that of a wider scope, says something.

    A node is judged in the narrowest scope (host, domain, all sites) in
    which MANY_PAGES have it, or else in the narrowest with LEAST_PAGES.
    What is declared an article is judged by the host's own tree alone.
    """
    counts = cut(counts.withColumn("domain", domain_of(F.col("host"))))
    wider = cut(counts.groupBy("domain", "path", "kind", "key").agg(F.sum("n").alias("n")))
    whole = wider.groupBy("path", "kind", "key").agg(F.sum("n").alias("n"))
    tree = style_tree(counts, "host", "domain")
    found = ["importance", "pages", "has_text", "outside"]
    for frame, scope, name in ((style_tree(wider, "domain"), ["domain"], "wide"), (style_tree(whole), [], "whole")):
        judging = frame.where(F.col("pages") >= LEAST_PAGES).select(*scope, "path", F.struct(*found).alias(name))
        tree = tree.join(judging, [*scope, "path"], "left")
    scopes = [F.when(F.col("pages") >= LEAST_PAGES, F.struct(*found)), F.col("wide"), F.col("whole")]
    best = F.coalesce(*(F.when(s["pages"] >= MANY_PAGES, s) for s in scopes), *scopes)
    judged = tree.select("host", "path", scopes[0].alias("own_site"), best.alias("b")).where("b IS NOT NULL")
    importance, many = F.col("b.importance"), (F.col("b.pages") >= MANY_PAGES) & F.col("b.has_text")
    flags = {
        "low": importance < F.when(many, F.lit(LEAST_OF_MANY)).otherwise(F.lit(LEAST_IMPORTANCE)),
        "repeated": F.coalesce(F.col("own_site.has_text") & (F.col("own_site.importance") < LEAST_INSIDE), F.lit(False)),
        "own": F.col("b.outside") & F.col("b.has_text") & (importance >= LEAST_OUTSIDE),
    }
    said = judged.where(flags["low"] | flags["repeated"] | flags["own"])
    return said.groupBy("host").agg(*(F.collect_list(F.when(flags[c], F.col("path"))).alias(c) for c in _JUDGED))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, <url_col>, text, n_chars`` for every row: the main text of the whole page.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space. Null pages have an empty text; a
    null or odd url belongs to a site without a name. Where no article is
    declared, branches of low importance are left out; where one is, nodes
    with text inside it below LEAST_INSIDE are, and those outside from
    LEAST_OUTSIDE on are taken in. Repeated rows are extracted alike, further
    columns ignored; an empty table gives an empty result.
    """
    source = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    judged = cut(judged_nodes(page_features(source.select("host", "html"))))
    size = judged.agg(F.coalesce(F.sum(sum((F.size(c) * 8 for c in _JUDGED), F.lit(64))), F.lit(0))).first()[0]
    joined = source.join(F.broadcast(judged) if size <= BROADCAST_BYTES else judged, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in range(2, 6))
            texts = [extract(h or "", Verdicts(*(frozenset(p or ()) for p in sets))) for h, *sets in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_arrow(joined.select("id", "url", "html", *_JUDGED), run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
