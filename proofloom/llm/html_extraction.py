"""Main text of web pages by a site style tree.

The pages of a host are merged: an element is known by its path of tags, classes and roles from the root.  Pages with
the same blocks and elements are copies and count as one page.  Over all pages of the host a path has
  * content: the texts of the blocks below it; a text on n of the path's m pages has the entropy log n / log m, and
    the content importance is 1 minus the mean entropy,
  * presentation: the sequences of child styles; their entropy over the pages, to base m, is the presentation importance.
Importance = (1 - GAMMA^l) * presentation + GAMMA^l * content, l the number of child styles seen.  Branches below
``LEAST_IMPORTANCE`` on hosts with ``MIN_PAGES`` or more are removed.

Entropy alone cannot tell a menu of ever-changing links from an article, so what the markup declares comes first:
navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments have importance 0, and
a page that declares an article or main part has its text there.  The style tree judges that text too: a block whose
innermost element is of low importance goes, but only where the declared texts around it differ between the pages that
have it.  On pages that are near copies of each other (mean entropy of those texts, weighted by their pages, of
``NEAR_COPIES`` or more) a heading or list that all share is of the article and stays.  A page that would lose
everything to the style tree keeps what was not declared.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bounds import broadcast_if_small
from ..plans.lineage import delete_table, written_table
from .common import KERNEL_ROWS, map_batches, record

GAMMA = 0.9
LEAST_IMPORTANCE = 0.2
MIN_PAGES = 5
#: Pages whose declared texts are repeated so much are near copies; their shared elements tell nothing.
NEAR_COPIES = 0.25
#: A block outside any declared article is a menu when links hold more than this share of it.
LINK_SHARE = 0.5
#: Hosts with removed branches are dealt over so many parts when they are too many to broadcast.
HOST_PARTS = 64

#: Elements nested deeper count as their parent, as in browsers.
MAX_DEPTH = 512

RAW = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME_TAGS = frozenset("aside button dialog fieldset footer form head label menu nav object option script select style svg".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer"
    " discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup"
    " promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " toolbar widget widgets".split()
)
#: Names that stay chrome on an article of their own and around one.
HARD_NAMES = frozenset("ad ads advert advertisement comment comments commentlist discussion disqus promo promoted recommended related replies reply respond sponsored".split())
MAIN_NAMES = frozenset(("articlebody", "main"))
#: Classes such as "has-sidebar" speak of something else on the page.
LAYOUT_NAMES = frozenset(("has", "no", "with", "without", "wrapper", "layout"))
#: Declared chrome by a name may hold the article all the same; other declarations may not.
SOFT, HARD = 1, 2
#: What opening one of these tags closes first.
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
#: Kinds of what is counted of a path.
CONTENT, SHAPE, PAGE, DECLARED = 0, 1, 2, 3


class Element:
    __slots__ = ("tag", "path", "chrome", "main", "link", "styles")

    def __init__(self, tag: str, path: int, chrome: int, main: bool, link: bool):
        self.tag, self.path, self.chrome, self.main, self.link = tag, path, chrome, main, link
        self.styles: list[str] = []


class Block:
    """A run of text between block-level tags, with the paths it stands in."""

    __slots__ = ("paths", "main", "text", "link_chars")

    def __init__(self, paths: tuple[int, ...], main: bool, text: str, link_chars: int):
        self.paths, self.main, self.text, self.link_chars = paths, main, text, link_chars


_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, style: str) -> int:
    """Number of a path, the same on every machine."""
    held = _paths.get((parent, style))
    if held is None:
        if len(_paths) > 100_000:
            _paths.clear()
        held = _paths[parent, style] = xxhash.xxh3_64_intdigest(f"{parent}/{style}") - (1 << 63)
    return held


def _described(tag: str, raw: str, in_main: bool) -> tuple[str, int, bool]:
    """Style of an element, how firmly it is declared not to be content, whether it is declared the main part."""
    own = tag in ("article", "main")
    style, chrome, main = tag, HARD if tag in CHROME_TAGS or (tag == "header" and not in_main) else 0, own
    if raw and raw != "/" and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id", "itemprop"):
                if name != "id":
                    style += f".{value}"
                for word in value.split():
                    names = set(_NAME.findall(word))
                    if names & HARD_NAMES and not names & LAYOUT_NAMES:
                        chrome = HARD
                    elif names & CHROME_NAMES and not names & LAYOUT_NAMES and not own:
                        chrome = max(chrome, SOFT)
                    main = main or (bool(names & MAIN_NAMES) and not names & LAYOUT_NAMES)
            elif name == "role":
                style += f".{value}"
                chrome, main = HARD if value in CHROME_ROLES else chrome, main or value == "main"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                chrome = HARD
    return style, chrome, main and not chrome


def blocks_of(html: str | None) -> tuple[list[Block], list[tuple[int, tuple[str, ...]]]]:
    """Blocks of a page in order, without declared chrome, and (path, child styles) of its other elements."""
    blocks: list[Block] = []
    shapes: list[tuple[int, tuple[str, ...]]] = []
    if not html:
        return blocks, shapes
    root = Element("", 0, 0, False, False)
    stack, parts, at, link_chars = [root], [], 0, 0
    opened: Counter = Counter()

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            top = stack[-1]
            text = " ".join("".join(parts).split())
            if text and not top.chrome:
                paths = tuple(e.path for e in stack[1:] if e.tag not in INLINE)
                blocks.append(Block(paths, top.main, text, link_chars))
            parts, link_chars = [], 0

    def add(raw: str) -> None:
        nonlocal link_chars
        top = stack[-1]
        if top.chrome:
            return
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if top.link:
            link_chars += len(text.strip())

    def pop() -> None:
        gone = stack.pop()
        opened[gone.tag] -= 1
        if not gone.chrome and gone.styles:
            shapes.append((gone.path, tuple(s for i, s in enumerate(gone.styles) if not i or s != gone.styles[i - 1])))

    def close(tags: frozenset[str], within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of these tags, unless one of ``within`` is nearer."""
        if not any(map(opened.__getitem__, tags)):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if any(e.tag not in INLINE for e in stack[i:]):
                    flush()
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in within:
                return

    size = len(html)
    while at < size:
        found = _TAG.search(html, at)
        if not found:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            if tag == "br" or tag == "p" and not opened["p"]:
                parts.append(" ")
            else:
                close(frozenset((tag,)))
            continue
        raw = found[3] if found[2] else found[6]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            if not end:
                break
            rest = html.find(">", end.start())
            at = size if rest < 0 else rest + 1
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            if tag in CLOSES:
                close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
            close(frozenset(("p",)), frozenset(("button", "td", "th", "table", "object")))
        if tag in VOID:
            continue
        parent = stack[-1]
        style, chrome, main = _described(tag, raw, parent.main)
        if chrome and inline and not parent.chrome:
            flush()
        if not inline:
            parent.styles.append(style)
        if tag not in ("article", "main") or chrome or parent.chrome != SOFT:
            chrome = max(chrome, parent.chrome)
        element = Element(tag, parent.path if inline else _path(parent.path, style), chrome, parent.main or main, parent.link or tag == "a")
        if raw.endswith("/") and tag in ("svg", "path") or len(stack) > MAX_DEPTH:
            continue
        stack.append(element)
        opened[tag] += 1
    flush()
    while len(stack) > 1:
        pop()
    return blocks, shapes


def host_of(url: str | None) -> str:
    """Host of a URL, lower case; empty for a null or one without a host."""
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def packed_page(html: str | None) -> np.ndarray:
    """What the style tree sees of a page: kind, feature, number of paths and the paths, for every block and shape."""
    blocks, shapes = blocks_of(html)
    held: list[int] = []
    for b in blocks:
        held += (DECLARED if b.main else CONTENT, _hash(b.text), len(b.paths), *b.paths)
    for path, styles in shapes:
        held += (SHAPE, _hash("\n".join(styles)), 1, path)
    return np.array(held, dtype=np.int64)


def _features(packed: bytes) -> Iterator[tuple[int, int, list[int]]]:
    """Kind, feature and paths of everything in a packed page."""
    held, at = np.frombuffer(packed, dtype=np.int64).tolist(), 0
    while at < len(held):
        kind, feature, many = held[at : at + 3]
        yield kind, feature, held[at + 3 : at + 3 + many]
        at += 3 + many


def _among_copies(contents: DataFrame, asked: DataFrame) -> DataFrame:
    """host and path, of the asked ones, where the declared texts beside the path are near copies, or there are none."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                declared = [(feature, paths[-1] if paths else 0) for kind, feature, paths in _features(packed) if kind == DECLARED]
                for path in {p for _, p in declared}.intersection(wanted):
                    found[host, path, PAGE, 0] += 1
                    found.update({(host, path, CONTENT, feature) for feature, p in declared if p != path})
            columns = list(zip(*found)) or [(), (), (), ()]
            yield record(
                host=(columns[0], pa.string()), path=(columns[1], pa.int64()), kind=(columns[2], pa.int32()),
                feature=(columns[3], pa.int64()), n=(list(found.values()), pa.int64()),
            )

    met = contents.join(broadcast_if_small(asked.groupBy("host").agg(F.collect_set("path").alias("wanted"))), "host").select("host", "packed", "wanted")
    counted = met.mapInArrow(beside, "host string, path bigint, kind int, feature bigint, n bigint")
    features = counted.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    n, text = F.col("n").cast("double"), F.col("kind") == CONTENT
    sums = features.groupBy("host", "path").agg(
        F.sum(F.when(~text, n)).alias("pages"), F.sum(F.when(text, n)).alias("texts"), F.sum(F.when(text, n * F.log(n))).alias("repeated")
    )
    differ = F.col("repeated") < NEAR_COPIES * F.col("texts") * F.log("pages")
    return sums.where(~F.coalesce(differ, F.lit(False))).select("host", "path")


def low_branches(pages: DataFrame, *, url: str = "url", html: str = "html", least: float = LEAST_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and the paths of its branches of low importance; hosts without any are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, KERNEL_ROWS) for b in batches for i in range(0, b.num_rows, KERNEL_ROWS)):
            own: dict[tuple[str, int], bytes] = {}
            for address, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(held := packed_page(text)):
                    own.setdefault((host_of(address), xxhash.xxh3_64_intdigest(held.tobytes()) - (1 << 63)), held.tobytes())
            yield record(host=([h for h, _ in own], pa.string()), page=([d for _, d in own], pa.int64()), packed=(list(own.values()), pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for kind, feature, paths in _features(packed):
                    for path in paths:
                        own.add((host, path, CONTENT if kind == DECLARED else kind, feature))
                        if kind != SHAPE:
                            own.add((host, path, PAGE, 0))
                    if kind == DECLARED and paths:
                        own.add((host, paths[-1], DECLARED, 0))
                found.update(own)
            columns = list(zip(*found)) or [(), (), (), ()]
            yield record(
                host=(columns[0], pa.string()), path=(columns[1], pa.int64()), kind=(columns[2], pa.int32()),
                feature=(columns[3], pa.int64()), n=(list(found.values()), pa.int64()),
            )

    packed = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(pack, "host string, page bigint, packed binary")
    contents = packed.dropDuplicates(["host", "page"]).select("host", "packed")
    counted = contents.mapInArrow(count, "host string, path bigint, kind int, feature bigint, n bigint")
    features = counted.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")

    def over(kind: int, value):
        return F.sum(F.when(F.col("kind") == kind, value))

    sums = features.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == PAGE, F.col("n"))).alias("pages"),
        (F.max("kind") == DECLARED).alias("declared"), over(CONTENT, F.log(n)).alias("entropy"), over(CONTENT, F.lit(1)).alias("texts"),
        over(SHAPE, n).alias("shaped"), over(SHAPE, n * F.log(n)).alias("shape_log"), F.coalesce(over(SHAPE, F.lit(1)), F.lit(0)).alias("shapes"),
    ).where(F.col("pages") >= min_pages)
    base = F.log("pages")
    content_importance = 1 - F.col("entropy") / F.col("texts") / base
    presentation = F.coalesce(F.greatest(F.lit(0.0), (F.log("shaped") - F.col("shape_log") / F.col("shaped")) / base), F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), F.col("shapes"))
    importance = F.when(F.col("shapes") == 0, content_importance).otherwise((1 - weight) * presentation + weight * content_importance)
    low, low_path = written_table(sums.withColumn("importance", importance).where(F.col("importance") < least).select("host", "path", "declared"))
    noise, declared = low, low.where("declared")
    if not declared.isEmpty():
        noise = low.join(broadcast_if_small(_among_copies(contents, declared)), ["host", "path"], "left_anti")
    lists, _ = written_table(noise.groupBy("host").agg(F.collect_set("path").alias("low")))
    delete_table(pages.sparkSession, low_path)
    return lists


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text joined by an empty line."""
    blocks, _ = blocks_of(html)
    if declared := [b for b in blocks if b.main]:
        kept = [b.text for b in declared if not b.paths or b.paths[-1] not in low]
        return "\n\n".join(kept or [b.text for b in declared])
    blocks = [b for b in blocks if b.link_chars <= LINK_SHARE * len(b.text)]
    kept = [b.text for b in blocks if low.isdisjoint(b.paths)] if low else [b.text for b in blocks]
    return "\n\n".join(kept or [b.text for b in blocks])


def extract_main_text(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: float = LEAST_IMPORTANCE, min_pages: int = MIN_PAGES
) -> DataFrame:
    """One row per page: key, url and text (empty if there is none).

    A null html is an empty page; a page whose URL is null or without a host belongs to the host of no name.
    Repeated rows give a row each; an empty table none; other columns are not read.
    """
    lists = low_branches(pages, url=url, html=html, least=least, min_pages=min_pages)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    # Every page finds its host's list; a hot host is dealt over parts, each of which holds the list.
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HOST_PARTS - 1).cast("bigint")))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(HOST_PARTS))
    small = broadcast_if_small(lists)
    if small is lists:
        met = rows.withColumn("host", host).withColumn("part", part).join(lists.withColumn("part", parts), ["host", "part"], "left")
    else:
        met = rows.withColumn("host", host).join(small, "host", "left")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html, frozenset(low or ())) for html, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return record(page_id=batch.column(0), url=batch.column(1), text=(texts, pa.string()))

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_batches(met.select("page_id", "url", "html", "low"), extract, f"page_id {kind}, url string, text string")
