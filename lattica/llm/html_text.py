"""Main text of web pages, with removal of site templates.

1. Each page is parsed to a tree: tags by one regular expression, raw-text elements skipped, void
   elements and implied end tags as HTML has them, stray end tags ignored.
2. Elements are hashed with all they contain (tags, class and id, text). For each host Spark counts
   in how many different contents each hash of a container (``div``, ``section``, ``ul`` ..) occurs.
   Containers in at least ``TEMPLATE_SHARE`` of a host's contents, and in ``TEMPLATE_PAGES``, are its
   template and are deleted wherever they stand, whatever their names. Headings and paragraphs of
   their own are never template: a phrase that several articles share stays. A page's content is the
   text of step 3 without template removal, so copies of a page count once. (Edited copies do not: a
   list or section of an article goes too if such copies of it are half of a host's contents.)
3. Text is taken from ``article`` elements if there are any, else from ``main``, else the body.
   What HTML itself declares to be no article text goes: by tag (``nav``, ``aside``, ``form``,
   ``footer``, ..) or role, and containers whose class or id name one of ``MARK``'s kinds. Of a
   ``header`` in an article its headings stay.

Character references are decoded. White space within a block becomes one space, blocks are
stripped, empty ones dropped, and the rest joined by newlines in page order. A null or empty html
has an empty text; a url without host counts under the host "". Repeated rows are extracted alike.
Other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.hot import join_groups
from lattica.session import materialize

TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.5

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - set("caption dd dt html body li legend optgroup option summary tbody td tfoot th thead tr".split())
# An opening tag closes an open element of these, not beyond these limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
P_LIMIT = {"article", "section", "div", "td", "th", "li", "blockquote", "body", "main", "aside", "figure", "dd", "button"}

HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())

# What never is article text: by tag, by role, and containers by words in class or id.
DROPPED_TAGS = set(
    "head nav header footer aside form script style noscript template iframe object embed applet canvas audio video "
    "select textarea input dialog menu search datalist noembed noframes title link meta "
    "annotation annotation-xml desc metadata defs symbol".split()  # of math and svg, which show their other text
)
DROPPED_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split()
)
MARK = re.compile(
    r"(?:(?:site|page|global|top|bottom|main|side|reader|user)[-_])*"
    r"(?:(?:ad|advert|advertisement|sponsored|cookie|consent|notice|newsletter|menu|nav|navbar|navigation|breadcrumb|sidebar|footer|comment)s?"
    r"|(?<=site[-_])header|(?<=page[-_])header|(?<=global[-_])header)"
    r"(?:[-_](?:ads?|bar|banner|box|slot|wrapper|container|block|list|area|section|notice|popup|menu|form|widget|[0-9]+))*"
)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTAINERS = set("div section aside nav header footer form ul ol dl menu table figure details".split())


class Element:
    __slots__ = ("tag", "name", "children", "dropped", "marked")

    def __init__(self, tag: str, name: str, marked: bool):
        self.tag, self.name, self.children, self.marked = tag, name, [], marked
        self.dropped = marked or tag in DROPPED_TAGS


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(ATTRIBUTE.findall(raw))}


def _marked(marks: str) -> bool:
    """Whether class or id name a kind of ``MARK``."""
    return any(MARK.fullmatch(w) for w in re.sub(r"([a-z])([A-Z])", r"\1-\2", marks).lower().split())


def _element(tag: str, raw: str) -> Element:
    marked, name = False, tag
    if raw and raw.strip(" /"):
        found = _attributes(raw)
        marks = f"{found.get('class', '')} {found.get('id', '')}".strip()
        if marks:
            name = f"{tag} {marks}"
        if tag not in ("html", "body", "main"):
            marked = (
                bool(marks and (tag in CONTAINERS or tag == "article") and _marked(marks))
                or found.get("role", "").lower() in DROPPED_ROLES
                or "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or bool(HIDDEN_STYLE.search(found.get("style", "")))
            )
    return Element(tag, name, marked)


def parse(html: str) -> Element:
    """The page's tree; children are elements and strings."""
    root = Element("#root", "#root", False)
    stack = [root]
    at = 0

    def close(tags, limits):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return True
            if stack[k].tag in limits:
                return False
        return False

    search = TAG.search
    while m := search(html, at):
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                stack[-1].children.append(" ")
            elif tag not in ("html", "body"):
                close({tag}, {"article", "main", "table"} - {tag} if tag not in ("div", "section", "main") else {"article"})
            continue
        raw = m[3] if m[2] else m[6]
        if tag in CLOSES_P:
            close({"p"}, P_LIMIT)
        if tag in IMPLIED:
            while close(*IMPLIED[tag]):
                pass
        if tag in ("html", "body"):
            if any(x.tag == tag for x in stack):
                continue
            if tag == "body":
                close({"head"}, set())
        element = _element(tag, raw)
        stack[-1].children.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if not element.dropped:
                element.children.append(unescape(html[at:stop]))
            at = end.end() if end else len(html)
            continue
        if not raw.endswith("/") or tag in BLOCKS:
            stack.append(element)
    if at < len(html):
        stack[-1].children.append(unescape(html[at:]))
    return root


def _find(root: Element, tag: str, gone: frozenset[int], hashes: dict[int, int]) -> list[Element]:
    """Outermost elements of a tag that no dropped element encloses."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.dropped or hashes.get(id(e)) in gone:
            continue
        if e.tag == tag:
            out.append(e)
        else:
            todo += [c for c in reversed(e.children) if not isinstance(c, str)]
    return out


def main_elements(root: Element, gone: frozenset[int] = frozenset(), hashes: dict[int, int] | None = None) -> list[Element]:
    for tag in ("article", "main", "body"):
        if found := _find(root, tag, gone, hashes or {}):
            return found
    return [root]


def subtree_hashes(root: Element) -> dict[int, int]:
    """id(element) to a hash of its tags, marks and text, children first; an explicit stack bears any depth."""
    out: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        e, ready = todo.pop()
        if not ready:
            todo.append((e, True))
            todo += [(c, False) for c in e.children if not isinstance(c, str)]
            continue
        parts = [e.name.encode()]
        for c in e.children:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    parts.append(b"t" + text.encode())
            else:
                parts.append(b"e%x" % out[id(c)])
        out[id(e)] = xxhash.xxh64_intdigest(b"\0".join(parts)) >> 1
    return out


def _headings(header: Element) -> list[Element]:
    """The outermost headings of a header, in order."""
    out, todo = [], [header]
    while todo:
        e = todo.pop()
        if e.tag in HEADINGS:
            out.append(e)
        elif e is header or not e.dropped:
            todo += [c for c in reversed(e.children) if not isinstance(c, str)]
    return out


def text_of(elements: list[Element], gone: frozenset[int] = frozenset(), hashes: dict[int, int] | None = None) -> str:
    blocks, current = [], []

    def flush():
        if current:
            if text := " ".join("".join(current).split()):
                blocks.append(text)
            current.clear()

    todo = list(reversed(elements))
    flush_mark = object()
    inside = {id(e) for e in elements}
    whole = not elements or elements[0].tag not in ("article", "main")
    while todo:
        e = todo.pop()
        if e is flush_mark:
            flush()
        elif isinstance(e, str):
            current.append(e)
        elif e.tag == "br":
            current.append(" ")
        elif gone and id(e) not in inside and e.tag in CONTAINERS and hashes[id(e)] in gone:
            flush()
        elif not e.dropped:
            if e.tag in BLOCKS or e.tag == "#root":
                flush()
                todo.append(flush_mark)
            todo += reversed(e.children)
        elif e.tag == "header" and not e.marked and not whole:
            flush()
            todo += reversed(_headings(e))
        elif e.tag in BLOCKS or e.tag in RAW:
            flush()
    flush()
    return "\n".join(blocks)


def extract(html: str | None, template: list[int] | None = None) -> str:
    """Main text of one page; ``template``: hashes of subtrees to delete."""
    if not html:
        return ""
    root = parse(html)
    if not template:
        return text_of(main_elements(root))
    hashes, gone = subtree_hashes(root), frozenset(template)
    return text_of(main_elements(root, gone, hashes), gone, hashes)


def candidates(html: str | None) -> tuple[int, set[int]]:
    """The hash of the page's content, and the hashes of the containers that may be template and would not go anyway."""
    if not html:
        return 0, set()
    root = parse(html)
    hashes = subtree_hashes(root)
    main = main_elements(root)
    mains = {id(e) for e in main}
    found, todo = set(), [root]
    while todo:
        e = todo.pop()
        if e.dropped:
            continue
        if e.tag in CONTAINERS and e.children and id(e) not in mains:
            found.add(hashes[id(e)])
        todo += [c for c in e.children if not isinstance(c, str)]
    return xxhash.xxh64_intdigest(text_of(main)) >> 1, found


def _candidate_rows(batches):
    for batch in batches:
        out = {"row": [], "host": [], "content": [], "subtree": []}
        for row, host, html in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            content, found = candidates(html)
            for subtree in [*found, *([None] if html else [])]:  # None is the page itself
                for name, value in zip(out, (row, host, content, subtree)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(
            out, pa.schema([("row", pa.int64()), ("host", pa.string()), ("content", pa.int64()), ("subtree", pa.int64())])
        )


def _texts(batches):
    for batch in batches:
        texts = [extract(h, t) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _prepared(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.select(
        F.xxhash64("page_id", "url", "html").alias("row"),
        host.alias("host"),
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.col("html").cast("string"),
    )


def template_subtrees(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """``(row, subtree)``: the template subtrees of each page, row a hash of the page's row."""
    found = _prepared(pages).select("row", "host", "html").mapInArrow(_candidate_rows, "row long, host string, content long, subtree long")
    found = materialize(found, "subtrees")
    counted = found.groupBy("host", "subtree", "content").agg(F.count("*").alias("rows"))
    counted = counted.groupBy("host", "subtree").agg(F.count("*").alias("contents"), F.sum("rows").alias("rows"))
    counted = materialize(counted.filter(F.col("contents") >= least), "counted")
    every = counted.filter("subtree IS NULL").select("host", F.col("contents").alias("every"))
    common = counted.filter("subtree IS NOT NULL").join(every, "host").filter(F.col("contents") >= share * F.col("every"))
    common = materialize(common.select("host", "subtree", "rows"), "template")
    return join_groups(found, common, ["host", "subtree"]).select("row", "subtree")


def extract_pages(pages: DataFrame, least: int = TEMPLATE_PAGES) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages(page_id, url, html)``."""
    gone = template_subtrees(pages, least).groupBy("row").agg(F.collect_set("subtree").alias("template"))
    joined = _prepared(pages).join(gone, "row", "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id long, url string, text string")
