"""Main-text extraction by site style trees.

The DOMs of a host are merged: elements are one node when their chains of tags and classes are. Over
the host's pages a node has

* a presentation importance: how much the sequences of its child elements differ from page to page;
* a content importance: how much its texts differ, and, where no name says that it is the article, how
  much their first and last words do, since furniture tends to carry a fixed phrase.

What stands on many pages tells little: a value on c of m pages has the importance 1 - log(c) / log(m),
and a node the mean over its values' pages. The two are put together, rare nodes lean on the branch
they stand in, and the tree's evidence meets the prior of tag and class names as odds. Variation speaks
weakly for a node (reader comments differ from page to page, too), sameness strongly against it. Both
are bounded and reached within a few pages, so the verdict does not turn with a host's size. Branches
all of whose texts are of low importance go from every page.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import Scratch

#: Elements of the HTML standard by what they mean for a text.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video")
#: Of these, those that run to the page's end if nothing closes them; the others are only their tag then.
TO_THE_END = frozenset(("script", "style", "noscript", "template"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_ITSELF = frozenset("li option tr td th dt dd".split())
#: What no browser shows as part of a page's body.
UNSEEN = frozenset("head title option select textarea".split())
#: Elements and words of a class or id that say what a branch is.
OUTSIDE_TAGS = frozenset("nav footer header aside form menu dialog button fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer header login menu navbar navigation nav newsletter notice notices overlay pagination "
    "popup promo promoted recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN_TAGS = frozenset(("article", "main"))

#: States of a block by its names: nothing told, inside the article, outside it, not shown at all.
UNTOLD, INSIDE, OUTSIDE, HIDDEN = 0, 1, 2, 3
#: Their log odds of being main text.
PRIOR = {UNTOLD: 0.0, INSIDE: 2.2, OUTSIDE: -2.2, HIDDEN: -99.0}
#: Log odds of a node whose values are all alike and all different, and the importance in the middle.
ALIKE, DIFFERENT, MIDDLE = -3.4, 0.9, 0.35
#: The share of the content in a node's importance, and the pages from which on its evidence is whole.
CONTENT, WHOLE = 0.75, 7

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def _names(attributes: str) -> tuple[str, bool]:
    """(the classes and telling words of an element, whether they put it outside the main text).

    Numbers are left out of classes and ids are not part of the name: both may be a page's own.
    """
    found, told = set(), False
    for kind, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        telling = OUTSIDE_WORDS.intersection(_WORDS.findall(value))
        told = told or bool(telling)
        found.update(telling if kind.lower() == "id" else _DIGITS.sub("", value).split())
    return " ".join(sorted(found)), told


class Element:
    """An open element: its node in the merged tree, its state, and the chain of its children so far."""

    __slots__ = ("tag", "key", "state", "children")

    def __init__(self, tag: str, key: int, state: int) -> None:
        self.tag, self.key, self.state, self.children = tag, key, state, 0


def walk(page: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int]]]:
    """The text blocks of a page in order, (node, parent node, state, text), and its elements, (node, children).

    One pass, whose time is in proportion to the page's length. A tag that is cut off by the page's end
    is no text; a "<" before no tag name is text.
    """
    blocks: list[tuple[int, int, int, str]] = []
    elements: list[tuple[int, int]] = []
    stack = [Element("", 0, UNTOLD)]
    text: list[str] = []
    unclosed: set[str] = set()
    quotes = True  # whether quoted attributes close; after one that does not, tags end at the next ">"

    def flush() -> None:
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                top = stack[-1]
                blocks.append((top.key, stack[-2].key if len(stack) > 1 else 0, top.state, block))
            text.clear()

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            gone = stack.pop()
            elements.append((gone.key, gone.children))

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        if start > at:
            text.append(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        name = _NAME.match(page, start + 1)
        if not name:
            text.append("<")
            at = start + 1
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        if rest:
            at = rest.end()
        else:
            quotes = False
            stop = page.find(">", name.end())
            if stop < 0:
                break
            at = stop + 1
        tag, closing, attributes = name[1].lower(), page[start + 1] == "/", page[name.end() : at - 1]
        if tag in _CLOSED and not closing:
            flush()
            if tag in unclosed or tag in ("svg", "math") and attributes.endswith("/"):
                continue
            if closed := _CLOSED[tag].search(page, at):
                at = closed.end()
            elif tag in TO_THE_END:
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1].tag == "p" or tag in CLOSES_ITSELF and stack[-1].tag == tag:
            close(len(stack) - 1)
        parent = stack[-1]
        names, told = _names(attributes) if attributes else ("", False)
        state = parent.state
        if tag in UNSEEN:
            state = HIDDEN
        elif state in (UNTOLD, INSIDE) and (told and tag not in ("html", "body") or tag in OUTSIDE_TAGS and not (tag == "header" and state == INSIDE)):
            state = OUTSIDE
        elif state == UNTOLD and tag in MAIN_TAGS:
            state = INSIDE
        label = f"{tag}.{names}".encode("utf-8", "surrogatepass")
        parent.children = zlib.crc32(label, parent.children)
        stack.append(Element(tag, xxhash.xxh64_intdigest(label, parent.key), state))
    flush()
    close(1)
    return blocks, elements


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _value(*parts) -> int:
    return _signed(xxhash.xxh64_intdigest(" ".join(map(str, parts)).encode("utf-8", "surrogatepass")))


#: Kinds of values: whole texts, first words, last words, child sequences.
TEXT, FIRST, LAST, STYLE = range(4)


def page_values(page: str) -> tuple[int, dict[tuple, None]]:
    """A page's key, and its distinct values (node, parent, state, kind, value) in the merged tree.

    Pages with one key hold the same texts but for those that are outside the article by name: copies.
    """
    blocks, elements = walk(page)
    whole, found = xxhash.xxh64(), {}
    for node, parent, state, text in blocks:
        if state == HIDDEN:
            continue
        if state != OUTSIDE:
            whole.update(f"{node} {text}\n".encode("utf-8", "surrogatepass"))
        words = text.split()
        place = (_signed(node), _signed(parent), state)
        found[*place, TEXT, _value(text)] = None
        found[*place, FIRST, _value(*words[:2])] = None
        found[*place, LAST, _value(*words[-2:])] = None
    for node, children in elements:
        found[_signed(node), 0, UNTOLD, STYLE, children] = None
    return _signed(whole.intdigest()), found


def style_tree(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """The merged trees' text nodes: (host, node, state, pages, presentation, content, odds).

    odds are the log odds that the node's texts are main text; presentation and content importances
    are null where fewer than two pages have the node. Copies of a page count once.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for site, page in zip(batch["host"], batch["html"]):
                key, found = page_values(page)
                rows.append((site, key, *map(list, zip(*found))) if found else (site, key, [], [], [], [], []))
            yield pd.DataFrame(rows, columns=["host", "page", "node", "parent", "state", "kind", "value"])

    schema = "host string, page long, node array<long>, parent array<long>, state array<int>, kind array<int>, value array<long>"
    once = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInPandas(read, schema).dropDuplicates(["host", "page"])
    values = once.select("host", F.explode(F.arrays_zip("node", "parent", "state", "kind", "value")).alias("v")).select("host", "v.*")
    counts = values.groupBy("host", "node", "parent", "state", "kind", "value").agg(F.count("*").alias("c"))
    # A page has a node once, its values may be many: the pages of a node are those of its commonest kind of value at least.
    present = once.select("host", F.explode(F.array_distinct("node")).alias("node")).groupBy("host", "node").agg(F.count("*").alias("pages"))
    weighed = counts.join(present, ["host", "node"]).withColumn("tells", F.when(F.col("pages") > 1, 1 - F.log("c") / F.log("pages")))
    mean = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("tells") * F.col("c"))) / F.sum(F.when(F.col("kind") == kind, F.col("c")))
    styles = weighed.where(F.col("kind") == STYLE).groupBy("host", "node").agg(mean(STYLE).alias("presentation")).withColumnRenamed("node", "parent")
    nodes = weighed.where(F.col("kind") != STYLE).groupBy("host", "node", "parent", "state").agg(F.max("pages").alias("pages"), *[mean(k).alias(n) for k, n in ((TEXT, "text"), (FIRST, "first"), (LAST, "last"))])
    content = F.when(F.col("state") == INSIDE, F.col("text")).otherwise(F.least("text", "first", "last"))
    nodes = nodes.withColumn("content", content).join(styles, ["host", "parent"], "left")
    importance = CONTENT * F.col("content") + (1 - CONTENT) * F.coalesce("presentation", "content")
    nodes = nodes.withColumns({"importance": importance, "share": F.least(F.lit(1.0), (F.col("pages") - 1) / (WHOLE - 1))})
    branch = nodes.groupBy("host", "parent").agg((F.sum(F.col("importance") * F.col("pages")) / F.sum(F.when(F.col("importance").isNotNull(), F.col("pages")))).alias("branch"), F.max("share").alias("branch_share"))
    nodes = nodes.join(branch, ["host", "parent"])
    prior = F.coalesce(*[F.when(F.col("state") == s, F.lit(p)) for s, p in PRIOR.items()])
    evidence = F.col("share") * F.coalesce(_evidence(F.col("importance")), F.lit(0.0)) + (F.col("branch_share") - F.col("share")) * F.coalesce(_evidence(F.col("branch")), F.lit(0.0))
    return nodes.select("host", "node", "state", "pages", "presentation", "content", (prior + evidence).alias("odds"))


def _evidence(importance: Column) -> Column:
    """The log odds of an importance: 0 in the middle, ALIKE at 0, DIFFERENT from twice the middle on."""
    below = ALIKE * (MIDDLE - importance) / MIDDLE
    above = DIFFERENT * F.least((importance - MIDDLE) / MIDDLE, F.lit(1.0))
    return F.when(importance < MIDDLE, below).otherwise(above)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with their main text in a column _sst_text, html_col left out.

    Blocks that the style tree keeps, in page order: references decoded, white space made one space,
    trimmed, joined by one space. A null or empty page gives an empty text; a null or odd url belongs
    to the host ''. Every page is judged with its host's merged tree; the whole page is read. Repeated
    rows are judged alike; an empty table gives an empty result; other columns stay as they are.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rest = [c for c in pages.columns if c != html_col]
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_sst_row"), host.alias("_sst_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_sst_html"))
    tree = scratch.save(style_tree(held, "_sst_host", "_sst_html"))
    # Only the nodes for which the tree overrules the names go to the pages: few for each template.
    turned = tree.where((F.col("odds") >= 0) != F.col("state").isin(UNTOLD, INSIDE))
    turned = turned.groupBy("host").agg(F.collect_set("node").alias("_sst_turned")).withColumnRenamed("host", "_sst_site")
    joined = held.join(scratch.save(turned), F.col("_sst_host") == F.col("_sst_site"), "left").select("_sst_row", "_sst_html", "_sst_turned")

    def main_text(html: pd.Series, turned: pd.Series) -> pd.Series:
        out = []
        for page, nodes in zip(html, turned):
            other = frozenset() if nodes is None else frozenset(nodes.tolist())
            out.append(" ".join(text for node, _, state, text in walk(page)[0] if state != HIDDEN and (state in (UNTOLD, INSIDE)) != (_signed(node) in other)))
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(main_text, T.StringType())
    return joined.select("_sst_row.*", udf("_sst_html", "_sst_turned").alias("_sst_text"))
