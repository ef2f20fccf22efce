"""Operator 10, main text of web pages by inferred wrappers.

A page is a stream of tokens: tags and texts; a block of text has a labelled path (elements with their first class). The
streams of one host are aligned on these paths into the host's wrapper, a union-free expression whose parts are paths: where
pages differ in a part's text it is a slot, a part that some pages lack is optional, one that a page has several times is a
repeated group, and a text that most pages have at one path is fixed, however long. Alignment is sums and counts by host,
path and text, so it has one result in any order of the pages, and a host with a third of all pages meets in no task. Pages
that agree in their longest text are copies of one page and count once.

The wrapper decides what is read: its main region is the deepest element that holds ``REGION_SHARE`` of the text in the host's
slots, and of a page's blocks in that region the fixed ones go. Elements and class, id or role words that mark page furniture
(menus, adverts, comments) take blocks out beforehand, and the region goes no deeper than an article or main element. A page
with nothing in its host's region is read by the wrapper of that page alone.

Defined cases: a null or empty html gives an empty text, a null url a host of its own (the empty one). Broken mark-up is
read as it stands: open elements end with the page, quotes that never close end with their tag. Repeated rows are pages of
their own. An empty table gives an empty result. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

FIXED_SHARE = 0.6  # of a host's pages that have a text at a path for it to be fixed
LEAST_PAGES = 8  # of a host for it to have fixed texts
REGION_SHARE = 0.75  # of the text in slots that the main region holds
MAIN_WEIGHT = 3  # of text in article or main elements in that share

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[\"'])*+)(?:>|\Z|(?=<))|<[!?][^>]*(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
RAW = {"script", "style", "textarea", "xmp", "noframes"}  # their content is text up to their end tag
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: Elements that hold no article text.
FURNITURE = {
    "nav", "footer", "aside", "form", "script", "style", "noscript", "head", "button", "select", "textarea", "template", "iframe", "object",
    "svg", "canvas", "menu", "dialog", "input", "option", "xmp", "noframes", "audio", "video", "map", "fieldset", "title",
}
#: Words in a class, id or role that mark page furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|rail|complementary|contentinfo|"
    r"ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promoted|promotion|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"comments?|commentlist|disqus|replies|reply|respond|discussion|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|"
    r"share|sharing|social|toolbar|pagination|pager|tags|widget|skip|hidden|toc)(?:$|[\s_-])",
    re.IGNORECASE,
)
MAIN = {"article", "main"}
MAIN_MARKS = re.compile(r"(?:^|\s)(?:article|main|articlebody|article-body|post-content|entry-content|article-content|main-content)(?:$|\s)", re.IGNORECASE)
DIGITS = re.compile(r"[\d/]+")
#: A start tag of the key ends an open element of the value.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {t: {"p"} for t in ("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "div", "section", "table", "blockquote", "pre", "hr", "figure", "dl", "address")}
ENDS |= {t: {"p", "nav", "header", "aside", "form", "footer"} for t in ("article", "main")} | {"footer": {"p"}, "header": {"p"}, "nav": {"p"}, "aside": {"p"}, "form": {"p"}}
#: Elements that no class makes page furniture.
UNMARKED = {"html", "body", "h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = {"article", "main", "section", "div", "td", "ul", "ol", "table", "body", "blockquote", "aside", "nav", "header", "footer", "form"}


def blocks(page: str | None) -> list[tuple[str, str, int, bool]]:
    """(labelled path, text, depth of the innermost main element or 0, in furniture) of the page's blocks of text, in order; white space is single."""
    page = page or ""
    stack: list[tuple[str, int, bool, str]] = []  # (element, depth of the main element, furniture from here on, label)
    out: list[tuple[str, str, int, bool]] = []
    words: list[str] = []
    at = 0

    def flush() -> None:
        if words:
            text = "".join(words)
            words.clear()
            if "&" in text:
                text = htmllib.unescape(text)
            if text := " ".join(text.split()):
                main, furniture = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                out.append(("/".join(s[3] for s in stack if s[0] not in INLINE), text, main, furniture))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                flush()
                del stack[k:]
                return

    while m := TOKEN.search(page, at):
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            else:
                close(name)
            continue
        if name in INLINE:
            attributes = m[3]
            if name not in VOID and is_furniture(attributes):
                flush()
                stack.append((name, stack[-1][1] if stack else 0, True, name))
            continue
        flush()
        for other in ENDS.get(name, ()):  # what this tag ends, up to the next scope
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == other:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE and name not in MAIN:
                    break
        if name in VOID:
            continue
        main, furniture = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        attributes = m[3] or ""
        own = name in MAIN or is_main(attributes)
        bad = name in FURNITURE or (name == "header" and not main) or (name not in UNMARKED and not own and is_furniture(attributes))
        if attributes.rstrip().endswith("/") and name not in RAW and name in ("svg", "iframe", "object", "script"):
            continue
        depth = 1 + sum(s[0] not in INLINE for s in stack)
        stack.append((name, depth if own and not furniture else main, furniture or bad, label(name, attributes)))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()
    if at < len(page):
        words.append(page[at:])
    flush()
    return out


def label(name: str, attributes: str) -> str:
    """The element with its first class, without digits (which number things)."""
    if "class" in attributes or "CLASS" in attributes:
        for k, v in _named(attributes):
            if k == "class" and v.split():
                return f"{name}.{DIGITS.sub('', v.split()[0])}"
    return name


def _named(attributes: str) -> list[tuple[str, str]]:
    return [(k.lower(), (v or "").strip("\"'")) for k, v in NAMED.findall(attributes)] if attributes else []


def is_furniture(attributes: str) -> bool:
    return any(k in ("class", "id", "role") and MARKS.search(v) or k == "hidden" or k == "aria-hidden" and v == "true" for k, v in _named(attributes))


def is_main(attributes: str) -> bool:
    return any(k in ("class", "id", "role", "itemprop") and MAIN_MARKS.search(v) for k, v in _named(attributes))


def key(text: str) -> int:
    """A text's hash, as a signed number."""
    return xxhash.xxh64_intdigest(text.encode(errors="replace")) - (1 << 63)


def regions(path: str, main: int) -> list[str]:
    """The elements of a path that may be a main region: those around the block's own, none inside the innermost main element."""
    around = list(accumulate(path.split("/"), lambda a, b: f"{a}/{b}"))[: main or -1]
    return around if path else []


def region_of(found: Iterable[tuple[str, str, int, bool]]) -> str | None:
    """The main region of one page's slots."""
    mass: Counter = Counter()
    total = 0
    for path, text, main, _ in found:
        weight = len(text) * (MAIN_WEIGHT if main else 1)
        total += weight
        for r in regions(path, main):
            mass[r] += weight
    return max(((r.count("/"), m, r) for r, m in mass.items() if m >= REGION_SHARE * total), default=(0, 0, None))[2]


def inside(found: list[tuple[str, str, int, bool]], region: str | None) -> list[tuple[str, str, int, bool]]:
    return [b for b in found if region is None or b[0] == region or b[0].startswith(f"{region}/")]


def main_text(page: str | None, region: str | None = None, fixed: set[tuple[str, int]] = frozenset()) -> str:
    """The text of a page read against its host's wrapper: the main region, without the fixed (path, key of text)."""
    found = [b for b in blocks(page) if not b[3] and (not fixed or (b[0], key(b[1])) not in fixed)]
    own = inside(found, region) if region else []
    if not own:
        own = inside(found, region_of(found))
    if any(b[2] for b in own):  # a region around several main elements, or around one in some pages
        own = [b for b in own if b[2]]
    return " ".join(b[1] for b in own)


def host_of(url: Column) -> Column:
    """Lower-cased host of a url; empty for null or without ://."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


PARTS = "host string, page long, path string, main int, text long, chars long, at int, times int, furniture boolean"


def parts_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """PARTS: of each page, by a key of its longest text, the blocks of one path and text: where the first stands, how often, characters of one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = blocks(page)
                if not found:
                    continue
                whose, own = key(max((x[1] for x in found), key=len)), {}
                for at, x in enumerate(found):
                    own.setdefault(x, [at, 0])[1] += 1
                out += [(host, whose, path, main, key(text), len(text), at, times, bad) for (path, text, main, bad), (at, times) in own.items()]
            names = [x.split()[0] for x in PARTS.split(", ")]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return pages.select(host_of(F.col(url)).alias("host"), html).mapInArrow(work, PARTS)


def fixed_texts(parts: DataFrame, least: int = LEAST_PAGES, share: float = FIXED_SHARE) -> DataFrame:
    """(host, path, text): texts, by key, that stand at a path in that share of the host's pages, of hosts of at least so many."""
    sizes = parts.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    seen = parts.select("host", "path", "text", "page").distinct().groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    return seen.filter(F.col("n") >= F.ceil(F.lit(share * least))).join(sizes, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "path", "text")


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, at, path, optional, repeated, slot): the parts of each host's wrapper, in page order by at, their mean place."""
    parts = settle(parts_of(pages, url, html))
    sizes = parts.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    on_page = parts.groupBy("host", "path", "page").agg(F.min("at").alias("at"), F.sum("times").alias("times"), F.min("text").alias("lo"), F.max("text").alias("hi"))
    found = on_page.groupBy("host", "path").agg(F.count("*").alias("n"), F.avg("at").alias("at"), F.max("times").alias("times"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.join(sizes, "host").select("host", "at", "path", (F.col("n") < F.col("pages")).alias("optional"), (F.col("times") > 1).alias("repeated"), (F.col("lo") != F.col("hi")).alias("slot"))


def main_regions(parts: DataFrame, fixed: DataFrame) -> DataFrame:
    """(host, region): the deepest element that holds enough of the text in a host's slots."""
    slots = parts.filter("not furniture").join(fixed, ["host", "path", "text"], "left_anti")
    by_path = slots.groupBy("host", "path", "main").agg(F.sum(F.col("chars") * F.col("times") * F.when(F.col("main") > 0, MAIN_WEIGHT).otherwise(1)).alias("mass"))
    total = by_path.groupBy("host").agg(F.sum("mass").alias("total"))
    names = F.split("path", "/")
    depth = F.when(F.col("main") > 0, F.col("main")).otherwise(F.size(names) - 1)
    around = F.when((depth > 0) & (F.col("path") != ""), F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.array_join(F.slice(names, 1, k), "/")))
    mass = by_path.select("host", "mass", F.explode(around).alias("region")).groupBy("host", "region").agg(F.sum("mass").alias("mass"))
    held = mass.join(total, "host").filter(F.col("mass") >= REGION_SHARE * F.col("total"))
    best = F.max(F.struct(F.size(F.split("region", "/")).alias("depth"), "mass", "region")).alias("best")
    return held.groupBy("host").agg(best).select("host", F.col("best.region").alias("region"))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, region, fixed): what reading a page takes of its host's wrapper; a page has few fixed texts, so a host has."""
    parts = settle(parts_of(pages, url, html))
    fixed = settle(fixed_texts(parts, least_pages))
    by_host = fixed.groupBy("host").agg(F.collect_list(F.struct("path", "text")).alias("fixed"))
    return main_regions(parts, fixed).join(by_host, "host", "full")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a host has fixed texts from least_pages pages on."""
    known = settle(wrappers(pages, url, html, least_pages))
    kind = pages.schema[page_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple[str | None, set]] = {}
        for b in batches:
            texts = []
            for page, host, region, fixed in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = region, {(x["path"], x["text"]) for x in fixed or ()}
                texts.append(main_text(page, *sets[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    return own.join(known, "host", "left").select("page_id", "url", "html", "host", "region", "fixed").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
