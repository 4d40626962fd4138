"""The main text of web pages, without what the pages of a host have in common.

Pages are parsed to trees of elements. Every element has the hash of its subtree: name, class,
id and role, its words, its children. Spark counts, per host, in how many different pages each
subtree stands; subtrees that recur across many pages of the host are its templates and are
deleted. Pages whose article is the same byte for byte count once, since a copied page says
nothing about the host's template. How often is often: of ``LEAST_PAGES`` different pages at
least ``SHARE``. Where a page marks its article (article, main), paragraphs, headings and list items
in it are the author's words, though many pages may quote the same ones: those are templates only
from ``SURE_PAGES`` pages and ``SURE_SHARE`` on. Elements inside a line are words of their block.

What never is main text goes by name, role, class or id (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments, scripts, styles), also on hosts with few pages. A heading
in the header of an article stays. The main text is what is left of the outermost articles;
without one, of the main element, of an element named content or so, or of the body.

Character references are decoded, white space in a block becomes one space, blocks are joined in
page order by two line feeds. ``br`` and table cells are white space in a block. Nothing else is
dropped or capped, whatever a text's length. A null html is empty; a page without words has an
empty text. A url that is null or has no host belongs to the host "". Rows are told apart by
place, so null and repeated page_ids and repeated rows are pages of their own. An empty table
gives no rows. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ready, written

LEAST_PAGES, SHARE = 5, 0.5
SURE_PAGES, SURE_SHARE = 20, 0.8
# The pages of a host meet its templates in so many tasks.
SALTS = 8

# Names of the markup language: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = HEADINGS | frozenset("p li dt dd blockquote pre figcaption tr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
# Elements that an opening tag ends if they are open, within the elements of the third column.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
# What is never main text.
NEVER = frozenset(
    "head script style template noscript iframe noembed noframes object embed applet svg math canvas audio video "
    "nav menu footer aside form button select textarea input dialog title xmp".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
)
LABELS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|adunit|sponsor(?:ed|s)?|promo|promotion|"
    r"banner|cookies?|cookiebar|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|signup|paywall|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|copyright|disclaimer|comments?|commentlist|disqus|respond|replies|share|sharing|"
    r"social|related|recommended|recommendations|widget|pagination|pager|toolbar|toc|hidden)\d*(?=$|[\s_-])"
)
TOP = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])")
# Names of a layout, not of what is in it.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[_-]\S*")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story|main)(?=$|[\s_-]|body)")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = frozenset(("br", "td", "th"))
READ = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))


class Element:
    __slots__ = ("name", "marks", "label", "never", "top", "children", "hash")

    def __init__(self, name: str, attributes: str) -> None:
        self.name = name
        self.marks, self.label, self.never, self.top = "", "", name in NEVER, name == "header"
        self.children: list[Element | str] = []
        self.hash = 0
        if attributes and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        found: dict[str, str] = {}
        for key, *values in ATTRIBUTE.findall(attributes):
            if key.lower() in READ:
                found.setdefault(key.lower(), unescape(values[0] or values[1] or values[2]))
        if not found:
            return
        role = found.get("role", "").strip().lower()
        named = f"{found.get('class', '')} {found.get('id', '')}".strip()
        self.marks = f"{named}|{role}"
        self.label = LAYOUT.sub("", HUMP.sub("-", named).lower())
        hiding = (
            "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or HIDING.search(found.get("style", "")) is not None
        )
        whole = self.name in ("html", "body", "main", "article") and LABELS.search(self.label) is not None
        whole = whole and not re.search(r"(?:^|\s)(?:comment|ad|related|promo)", self.label)
        labelled = not whole and LABELS.search(self.label) is not None
        self.never = self.never or hiding or role in ROLES or labelled
        self.top = self.top or (self.name not in ("html", "body", "main", "article") and TOP.search(self.label) is not None)
        if role == "main" and not self.never:
            self.name = "main"


def parsed(html: str) -> Element:
    """The tree of a page; end tags that the language leaves out are put in."""
    root = Element("html", "")
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        low = html.find("<", at)
        match = TOKEN.match(html, low) if low >= 0 else None
        while low >= 0 and match is None:
            low = html.find("<", low + 1)
            match = TOKEN.match(html, low) if low >= 0 else None
        stop = low if low >= 0 else end
        if stop > at:
            stack[-1].children.append(unescape(html[at:stop]))
        if match is None:
            break
        at = match.end()
        name = match[2]
        if name is None:
            if match[0].startswith("<![CDATA["):
                stack[-1].children.append(match[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if match[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                # An end tag inside an element that it cannot end is a mistake of the page.
                if name not in BLOCKS and stack[k].name in BLOCKS:
                    break
            continue
        if name in ("html", "body") and len(stack) > 1 and any(e.name == name for e in stack):
            continue
        if stack[-1].name == "head" and name not in HEAD:
            stack.pop()
        if name in BLOCKS and name not in ("html", "body"):
            _end(stack, {"p"}, {"table", "td", "th", "button", "object", "caption"})
        if name == "body":
            del stack[1:]
        if name in HEADINGS and stack[-1].name in HEADINGS:
            stack.pop()
        if name in ENDS:
            _end(stack, *ENDS[name])
        one = Element(name, match[3].rstrip("/"))
        stack[-1].children.append(one)
        if name in VOID:
            continue
        if name in RAW:
            # Their content is no markup; it ends with their end tag.
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            one.children.append(html[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        if name == "html":
            stack[0].children.pop()
            continue
        stack.append(one)
    return root


def _end(stack: list[Element], names: set[str], within: set[str]) -> None:
    """End the outermost open element of ``names`` inside the innermost of ``within``."""
    cut = None
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in within:
            break
        if stack[k].name in names:
            cut = k
    if cut is not None:
        del stack[cut:]


def below(root: Element) -> list[Element]:
    """All elements, every one after those that hold it; no recursion, pages may nest deep."""
    out = [root]
    for one in out:
        out += [c for c in one.children if isinstance(c, Element)]
    return out


def hash_subtrees(root: Element) -> list[Element]:
    """Give every element the hash of its subtree; returns all of them."""
    from xxhash import xxh3_64_intdigest

    every = below(root)
    for one in reversed(every):
        parts = [one.name, one.marks]
        for child in one.children:
            parts.append(f"\x01{child.hash:x}" if isinstance(child, Element) else " ".join(child.split()))
        h = xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        one.hash = h - (1 << 64) if h >> 63 else h
    return every


def main_elements(root: Element) -> tuple[list[Element], bool]:
    """The elements that hold the main text, and whether the page marks them as its article."""
    found: dict[str, list[Element]] = {"article": [], "main": [], "content": []}
    todo = [root]
    while todo:
        one = todo.pop()
        if one.never or one.top:
            continue
        if one.name == "article":
            found["article"].append(one)
            continue
        if one.name == "main":
            found["main"].append(one)
        elif one.name in ("div", "section") and one.label and CONTENT.search(one.label):
            found["content"].append(one)
        todo += [c for c in reversed(one.children) if isinstance(c, Element)]
    if found["article"]:
        return found["article"], True
    if found["main"]:
        return found["main"][:1], True
    if found["content"]:
        # The first one; those inside of it come later.
        return found["content"][:1], False
    return [root], False


def blocks(tops: list[Element], deleted: set[int], sure: set[int], marked: bool) -> list[str]:
    """The texts of the blocks in page order, without the subtrees that are deleted."""
    out: list[str] = []
    words: list[str] = []

    def close() -> None:
        text = " ".join("".join(words).split())
        if text:
            out.append(text)
        words.clear()

    for top in tops:
        # (element, place of its next child, whether only the headings in it count)
        todo = [(top, 0, False)]
        while todo:
            one, k, headings = todo.pop()
            if k == 0 and one.name in BLOCKS:
                close()
            if k == len(one.children):
                if one.name in BLOCKS:
                    close()
                continue
            todo.append((one, k + 1, headings))
            child = one.children[k]
            if isinstance(child, str):
                if not headings:
                    words.append(child)
                continue
            if child.name in SPACES:
                words.append(" ")
            own = marked and child.name in WORDS
            template = child.name in BLOCKS and (
                child.hash in sure or (child.hash in deleted and not own)
            )
            if template or child.never or (child.top and not marked):
                continue
            todo.append((child, 0, (headings or child.top) and child.name not in HEADINGS))
        close()
    return out


def host(url):
    """The host of a url column, lower-cased, without a user or a port; "" if there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def hashed_pages(pages: DataFrame) -> DataFrame:
    """row, host, page (hash of the article), subtrees (the distinct hashes of all blocks)."""
    ready(pages.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            articles, trees = [], []
            for html in batch.column("html").to_pylist():
                root = parsed(html or "")
                every = hash_subtrees(root)
                tops, _ = main_elements(root)
                articles.append(hash(tuple(t.hash for t in tops)))
                trees.append(sorted({e.hash for e in every if e.name in BLOCKS}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("host"), pa.array(articles, pa.int64()),
                    pa.array(trees, pa.list_(pa.int64())),
                ],
                ["row", "host", "page", "subtrees"],
            )

    return pages.select("row", "host", "html").mapInArrow(
        hashed, "row long, host string, page long, subtrees array<long>"
    )


def templates(hashed: DataFrame) -> DataFrame:
    """host, deleted and sure: the subtrees that recur on it. A host with a template has one row.

    A host has few of them: each stands in half of its pages at least.
    """
    # Copies of a page count once; both counts are added up per task before they move.
    copies = hashed.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees"))
    different = written(copies, "different-pages")
    pages = different.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    counted = (
        different.select("host", F.explode("subtrees").alias("subtree"))
        .groupBy("host", "subtree")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= LEAST_PAGES * SHARE)
    )
    often = counted.join(pages, "host").filter(F.col("n") >= SHARE * F.col("pages"))
    sure = (F.col("pages") >= SURE_PAGES) & (F.col("n") >= SURE_SHARE * F.col("pages"))
    return often.groupBy("host").agg(
        F.collect_list(F.when(~sure, F.col("subtree"))).alias("deleted"),
        F.collect_list(F.when(sure, F.col("subtree"))).alias("sure"),
    )


def found_templates(hashed: DataFrame) -> DataFrame:
    """row, deleted and sure of the pages that hold a template of their host."""
    spread = templates(hashed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hashed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    return (
        salted.join(spread, ["host", "salt"])
        .select(
            "row",
            F.array_intersect("subtrees", "deleted").alias("deleted"),
            F.array_intersect("subtrees", "sure").alias("sure"),
        )
        .filter((F.size("deleted") > 0) | (F.size("sure") > 0))
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html", host(F.col("url")).alias("host"))
    hashed = written(hashed_pages(rows), "page-subtrees")
    gone = written(found_templates(hashed), "page-templates")
    ready(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            columns = (batch.column(c).to_pylist() for c in ("html", "deleted", "sure"))
            for html, deleted, sure in zip(*columns):
                root = parsed(html or "")
                if deleted or sure:
                    hash_subtrees(root)
                tops, marked = main_elements(root)
                texts.append("\n\n".join(blocks(tops, set(deleted or ()), set(sure or ()), marked)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    # Spark decides by the written size whether the templates go to the pages or both are shuffled.
    return (
        rows.select("row", "page_id", "url", "html")
        .join(gone, "row", "left")
        .select("page_id", "url", "html", "deleted", "sure")
        .mapInArrow(extracted, f"page_id {kind}, url string, text string")
    )


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return main_texts(pages).withColumn("n_chars", F.length("text").cast("long"))
