"""Main text of web pages with a site style tree.

The DOMs of a host's pages merge into one tree of style nodes, each the path of tags and classes from the root. For a
node two distributions over its occurrences count: how its children look (presentation), and what text it holds
(content). Their entropies, normalised by the number of occurrences, give the composite importance: the node's own
presentation and the mean content importance of the leaves below, with weight on the leaves falling with the number of
styles. Branches of low importance, which the host repeats alike, are cut out of every page.

Marked roles are decided before: navigation, footers, forms, scripts, and elements whose role or a whole class name or
identifier says that they are an advert, a menu, a cookie notice, comments and the like never count; class names and
identifiers of article and main say nothing. The tree decides on everything else, inside
article and main elements too, where they are a prior: there a branch goes only if its text itself is repeated (parts
of a sentence or of a table row stay with the rest), and of what the tree leaves, the text outside them goes unless it
is PRIOR times as long as theirs (of several articles, as list pages and teaser cards have them, as the longest).

The statistics are sums by host and path over the distinct pages of a host, combined in each task before they are
shuffled. Pages of equal text are one page, so copies say nothing about what a host repeats. A page counts once for a
path, with the texts of all its elements there.

Defined results: a missing or empty page has an empty text; a page without a host is a host of its own kind with the
others; repeated rows are all returned; an unclosed or wrongly nested element ends with its parent; an empty table
gives an empty result; further columns may have any names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payouts.llm.common import cut

#: A node needs so many pages of a host before it can be found repeated.
OCCURRENCES = 3
THRESHOLD = 0.2
SALTS = 64
DECAY = 0.9
#: Text outside article and main needs so many times their words to count.
PRIOR = 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|[^<]++|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_NOISE = frozenset("nav footer aside form header menu button select option dialog head object audio video canvas map".split())
_MAIN = frozenset(("article", "main"))
_IN_MAIN = r"/(article|main)[./]"
#: Inside article and main these are not cut out of what they are part of.
_PARTS = _INLINE | frozenset("td th tr tbody thead tfoot dt dd".split())
#: Whole class names and identifiers that name the role of their own element.
_NAMES = frozenset((
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle ad-banner ad-container ad-slot ad-unit ad-wrapper sponsor sponsors sponsored sponsored-content "
    "cookie cookies cookie-bar cookie-banner cookie-consent cookie-notice cookie-popup consent gdpr gdpr-notice popup modal newsletter newsletter-signup subscribe subscription sidebar side-bar widget widgets widget-area "
    "menu menus main-menu nav-menu nav navbar nav-bar navigation main-navigation site-navigation post-navigation breadcrumb breadcrumbs footer site-footer page-footer "
    "comments comment-list commentlist comments-area comment-form comment-respond disqus disqus_thread replies share sharing share-buttons share-links social-share social-links login login-form signup signup-form search-form search-box pagination pager").split())
#: As these, but not inside article and main, where they are a headline's.
_HEADS = frozenset("header site-header masthead banner".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: An element of the key closes open elements of the value.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class _Element:
    __slots__ = ("children", "main", "noise", "path", "tag", "texts")

    def __init__(self, tag: str, path: str, noise: bool, main: int):
        self.tag, self.path, self.noise, self.main = tag, path, noise, main
        self.children: list[str] = []
        self.texts: list[str] = []


def _hidden(attributes: str) -> tuple[bool, set[str], str]:
    """Whether the attributes mark noise, the class names and identifiers, and the class."""
    noise, names, kind = False, set(), ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "class":
            kind = value
        if name in ("class", "id"):
            names.update(value.lower().split())
        elif name == "role":
            noise |= value.strip().lower() in _ROLES
        elif name == "hidden":
            noise = True
        elif name == "aria-hidden":
            noise |= value.lower() == "true"
        else:
            noise |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return noise, names, kind


def walk_page(page: str, removed: frozenset[str] = frozenset()) -> tuple[str, list[_Element]]:
    """The main text of the page without removed paths, and its undecided elements."""
    root = _Element("", "", False, 0)
    stack, elements = [root], []
    blocks: list[tuple[int, str]] = []  # number of the outermost article or main element around it, or 0
    mains: list[str] = []
    open_block: list[str] = []

    def finish() -> None:
        if open_block:
            if text := " ".join("".join(open_block).split()):
                blocks.append((stack[-1].main, text))
            open_block.clear()

    def close(depth: int) -> None:
        for element in stack[depth:]:
            if element.tag not in _INLINE:
                finish()
                break
        del stack[depth:]

    for token in _TOKEN.finditer(page):
        raw, (_, slash, tag, attributes) = token.group(), token.groups()
        if tag is None:
            if raw[0] != "<" or raw == "<":
                here = stack[-1]
                text = entities.unescape(raw)
                if not here.noise:
                    open_block.append(text)
                    for element in stack:
                        element.texts.append(text)
            continue
        tag = tag.lower()
        if slash:
            if tag == "p" and all(e.tag != "p" for e in stack):
                finish()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if stack[depth].tag in _MAIN and tag in _INLINE:
                    break
            continue
        if tag == "br":
            if not stack[-1].noise:
                open_block.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                finish()
            continue
        if tag not in _INLINE:
            shut = ("p", *_CLOSES.get(tag, ()))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in shut:
                    close(depth)
                    break
                if stack[depth].tag not in _INLINE and stack[depth].tag not in ("p", "td", "th", "tr") and tag not in ("tr", "td", "th") or stack[depth].tag == "table":
                    break
            finish()
        above = stack[-1]
        noise, names, kind = _hidden(attributes) if attributes else (False, (), "")
        if tag not in _MAIN:
            noise |= not _NAMES.isdisjoint(names) or not (above.main or _HEADS.isdisjoint(names))
        name = tag + "".join(f".{c}" for c in kind.split())
        path = f"{above.path}/{name}"
        whole = tag in ("html", "body")
        element = _Element(tag, path, above.noise or (noise and not whole) or (tag in _NOISE and not (tag == "header" and above.main)) or path in removed, above.main)
        above.children.append(name)
        if tag in _MAIN and not element.main:
            mains.append(tag)
            element.main = len(mains)
        if not (element.noise or whole or tag in _MAIN or (above.main and tag in _PARTS)):
            elements.append(element)
        stack.append(element)
    close(1)
    finish()
    words = [0] * (len(mains) + 1)
    for main, text in blocks:
        words[main] += len(text.split())
    most = max(words[1:], default=0)
    wanted = most > 0 and most * (PRIOR if "main" in mains or len(mains) == 1 else 1) >= words[0]
    return "\n".join(text for main, text in blocks if main or not wanted), elements


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"], strict=True):
            nodes: dict[str, list[tuple[str, str]]] = {}
            for e in walk_page(page)[1]:
                if content := " ".join("".join(e.texts).split()):
                    nodes.setdefault(e.path, []).append((" ".join(e.children), content))
            whole = "\n".join(content for some in nodes.values() for _, content in some)
            for path, some in nodes.items():
                styles = sorted({style for style, _ in some})
                rows.append((host, whole, path, "\n".join(styles), "\n".join(content for _, content in some), styles == [""]))
        frame = pd.DataFrame(rows, columns=["host", "page", "path", "style", "content", "leaf"])
        for c in ("page", "style", "content"):
            frame[c] = pd.util.hash_array(frame[c].to_numpy(object), categorize=False).view("int64") if len(frame) else frame[c].astype("int64")
        yield frame.drop_duplicates()


def _entropy(counts: DataFrame, by: str, name: str) -> DataFrame:
    """Normalised entropy of the column over the occurrences of each node; 1 for a single occurrence."""
    one = counts.groupBy("host", "path", by).agg(F.sum("n").alias("k"))
    total = one.groupBy("host", "path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"), F.count("*").alias("kinds"))
    return total.select("host", "path", "n", "kinds", F.when(F.col("n") > 1, 1 - F.col("s") / (F.col("n") * F.log2("n"))).otherwise(1.0).alias(name))


def importance(pages: DataFrame) -> DataFrame:
    """`host`, `path`, `n` occurrences and composite `importance` of the undecided nodes. Pages have `host` and `html`."""
    nodes = pages.select("host", "html").mapInPandas(_nodes, "host string, page long, path string, style long, content long, leaf boolean").distinct()
    counts = cut(nodes.groupBy("host", "path", "style", "content", "leaf").agg(F.count("*").alias("n")))
    look = _entropy(counts, "style", "look")
    said = _entropy(counts, "content", "said").select("host", "path", "said")
    leaves = _entropy(counts.filter("leaf"), "content", "said").select("host", "path", "said")
    # Every leaf counts for all nodes above it.
    steps = F.split(F.substring("path", 2, 1_000_000), "/")
    above = leaves.select("host", "said", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).alias("path"))
    below = above.groupBy("host", "path").agg(F.avg("said").alias("below"))
    joined = look.join(said, ["host", "path"]).join(below, ["host", "path"], "left")
    weight = F.pow(F.lit(DECAY), F.col("kinds"))
    score = (1 - weight) * F.col("look") + weight * F.least(F.coalesce("below", "said"), "said")
    return joined.select("host", "path", "n", F.when(F.col("path").rlike(_IN_MAIN), F.greatest(score, "said")).otherwise(score).alias("importance"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [walk_page(page, frozenset(low if low is not None else ()))[0] for page, low in zip(batch["html"], batch["low"], strict=True)]
        yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts})


def extracted(pages: DataFrame, identifier: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: its identifier, `url`, and the main `text`."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    source = pages.select(F.col(identifier).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"))
    low = importance(source).filter((F.col("n") >= OCCURRENCES) & (F.col("importance") < threshold))
    by_host = low.groupBy("host").agg(F.collect_set("path").alias("low"))  # a host's repeated paths, not its pages
    # A host may have a third of all pages: its pages are dealt over SALTS keys, each with a copy of the paths.
    salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    source = source.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    kind = pages.schema[identifier].dataType.simpleString()
    found = source.join(salted, ["host", "salt"], "left").select("id", "url", "html", "low").mapInPandas(_texts, f"id {kind}, url string, text string")
    return found.withColumnRenamed("id", identifier)
