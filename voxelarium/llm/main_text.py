"""Main text of web pages with site style trees.

The pages of a host are merged into one tree: pages share a node if tags and classes agree
from the root down.  A node's presentation counts the orders of children it has, its
content counts its blocks of text, each once a page.  With ``m`` pages at a node, the
presentation importance is the entropy of the orders to base ``m``; the content importance
is one less the mean entropy of its texts, where a text on ``n`` pages has ``log n / log
m``.  A node that always looks alike and always says the same is of low importance, and
its branch is removed from each page of the host.  Importance is shrunk towards one where
a node is seen on few pages.

What is the same on no two pages but is no article either goes by structure: navigation,
footers, sidebars, adverts, forms, notices and comments by element, role, class or id,
hidden elements, and blocks that consist of links.  If a page has an ``article`` or
``main`` element, only what is inside counts.  There a word marks furniture only as a whole
class or on a node of low importance, since ids and hyphenated names are often slugs of
headings; and links make a menu only in lists of low importance.  If everything would go, the removal by
importance is taken back for that page.  Copies of a page count once a host, so that a page
captured many times does not make its own text look like furniture.

Counts are grouped by host, node and text, so that a large host spreads over many groups.
Pages are joined with the short list of their host's low nodes; they are not grouped.

Defined results: null html is empty; a page without text gives the empty string; a null
or odd url belongs to no host and its page is judged by structure alone; repeated rows
each get their row and count as one page; result columns replace input columns
of the same name, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Set

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.llm.common import carries, free_name, sha256, text_or_empty, with_result
from voxelarium.llm.html_tree import Block, Node, parse
from voxelarium.storage import materialise

#: Nodes below this importance go; pages for which a node's importance counts half.
MIN_IMPORTANCE = 0.3
HALF_PAGES = 6
#: Share of a block's characters inside links from which it is a menu.
LINK_SHARE = 0.8

PAGE, ORDER, TEXT = 0, 1, 2

#: Elements and roles that are no article, and words in class or id that mark such parts.
SKIP_TAGS = frozenset("nav footer aside form dialog menu select button fieldset legend object svg canvas head".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disclaimer disqus gdpr login menu nav navbar navigation newsletter notice notices notification "
    "notifications pagination pager popup promo promotion promoted recommended related replies reply respond share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: These mark page furniture only outside an article.
OUTER_TAGS = frozenset(["header"])
OUTER_WORDS = frozenset("footer header masthead copyright".split())
LISTS = frozenset("ul ol dl".split())


def _skipped(node: Node, inside: bool, low: bool) -> bool:
    """Whether an element is no part of an article, by its own marks; ``low`` if its host's style tree agrees."""
    if node.tag in SKIP_TAGS or not inside and node.tag in OUTER_TAGS:
        return True
    own = node.attributes
    if not own or node.tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in SKIP_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    if inside and not low:
        return not SKIP_WORDS.isdisjoint(own.get("class", "").lower().split())
    words = set(re.split(r"[^a-z0-9]+", f"{own.get('class', '')} {own.get('id', '')}".lower()))
    return not words.isdisjoint(SKIP_WORDS) or not inside and not words.isdisjoint(OUTER_WORDS)


def _judged(blocks: list[Block], unimportant: Set[int] = frozenset()) -> tuple[list[Block], bool]:
    """Blocks that structure leaves, and whether the page has an article."""
    seen: dict[int, tuple[bool, bool, bool]] = {0: (False, False, False)}

    def marks(node: Node | None) -> tuple[bool, bool, bool]:
        """Whether it is inside an article, whether it or an element around it is skipped, and whether it is a low list."""
        chain, node_of = [], node
        while node is not None and id(node) not in seen:
            chain.append(node)
            node = node.parent
        inside, skipped, listed = seen[id(node) if node is not None else 0]
        for n in reversed(chain):
            inside = inside or n.tag in ("article", "main") or n.attributes.get("role", "").lower() == "main"
            low = _signed(n.path) in unimportant
            skipped = skipped or _skipped(n, inside, low)
            listed = listed or n.tag in LISTS
            seen[id(n)] = inside, skipped, listed
        return inside, skipped, listed and _signed(node_of.path) in unimportant

    judged = [(b, *marks(b.node)) for b in blocks]
    kept = [
        (b, inside)
        for b, inside, skipped, low_list in judged
        if not skipped and (b.link_chars < LINK_SHARE * b.chars or inside and not low_list)
    ]
    article = any(inside for _, inside in kept)
    return [b for b, inside in kept if inside or not article], article


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def extract(source: str, low: Iterable[int]) -> str:
    """Main text of a page, given the paths of its host's unimportant nodes."""
    unimportant = set(low)
    blocks, _ = _judged(parse(source), unimportant)

    known: dict[int, bool] = {}

    def stays(node: Node) -> bool:
        """Whether no element from here to the root is unimportant; each is looked at once."""
        chain = []
        while node is not None and id(node) not in known:
            chain.append(node)
            node = node.parent
        good = node is None or known[id(node)]
        for n in reversed(chain):
            good = known[id(n)] = good and _signed(n.path) not in unimportant
        return good

    texts = [(b, t) for b in blocks if (t := b.text())]
    important = [t for b, t in texts if stays(b.node)] if unimportant else []
    return "\n".join(important or [t for _, t in texts])


def observations(source: str) -> list[dict[str, int]]:
    """What a page adds to its host's style tree, once each: nodes with text, child orders, texts."""
    found = set()
    for block in parse(source):
        path = _signed(block.node.path)
        found.add((path, PAGE, 0))
        found.add((path, ORDER, _signed(block.node.style)))
        found.add((path, TEXT, _signed(xxhash.xxh64_intdigest(block.text()))))
    return [{"path": p, "kind": k, "value": v} for p, k, v in sorted(found)]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def node_importance(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``host, path, pages, presentation, content, importance`` of each node that holds text."""

    @F.pandas_udf("array<struct<path: long, kind: int, value: long>>")
    def seen(sources: pd.Series) -> pd.Series:
        return pd.Series([observations(s) for s in sources], dtype=object)

    rows = (
        # Pages of the same content count once: what they add moves by digest, not their source.
        pages.select(host_of(F.col(url_column)).alias("host"), text_or_empty(html_column).alias("source"))
        .filter("host <> ''")
        .select("host", sha256(F.col("source")).alias("digest"), seen("source").alias("seen"))
        .groupBy("host", "digest")
        .agg(F.first("seen").alias("seen"))
        .select("host", F.explode("seen").alias("o"))
        .select("host", "o.*")
    )
    counted = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))

    def total(kind: int, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    n, pages_log = F.col("n"), F.log2("pages")
    node = counted.groupBy("host", "path").agg(
        total(PAGE, n).alias("pages"),
        total(ORDER, n * F.log2(n)).alias("order_log"),
        total(TEXT, n).alias("texts"),
        total(TEXT, n * F.log2(n)).alias("text_log"),
    )
    several = F.col("pages") > 1
    presentation = F.when(several, 1 - F.col("order_log") / F.col("pages") / pages_log).otherwise(1.0)
    content = F.when(several, 1 - F.col("text_log") / F.col("texts") / pages_log).otherwise(1.0)
    trust = F.col("pages") / (F.col("pages") + HALF_PAGES)
    return node.select("host", "path", "pages", presentation.alias("presentation"), content.alias("content")).withColumn(
        "importance", 1 - trust * (1 - F.greatest("presentation", "content"))
    )


@carries("url_column", "html_column")
def main_text(
    pages: DataFrame, url_column: str = "url", html_column: str = "html", min_importance: float = MIN_IMPORTANCE
) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""

    @F.pandas_udf("string")
    def extracted(sources: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([extract(s, () if x is None else x) for s, x in zip(sources, low)], dtype=object)

    host, low = free_name(pages.columns, "host_name"), free_name(pages.columns, "low_nodes")
    unimportant = materialise(
        node_importance(pages, url_column, html_column)
        .filter(F.col("importance") < min_importance)
        .groupBy(F.col("host").alias(host))
        .agg(F.collect_list("path").alias(low)),
        "style-trees",
    )
    joined = pages.withColumn(host, host_of(F.col(url_column))).join(unimportant, host, "left")
    out = with_result(joined, text=extracted(text_or_empty(html_column), F.col(low))).drop(host, low)
    return with_result(out, n_chars=F.char_length("text").cast("long"))


def page_texts(pages: DataFrame) -> DataFrame:
    """The registered form."""
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
