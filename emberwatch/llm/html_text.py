"""Main text of web pages by removal of site templates.

Each page is cut into elements; every element's subtree gets a hash of its tags and text. Spark counts, per host, in
how many different pages a subtree occurs (copies of a whole page count once), and subtrees found in many pages of
the host are deleted: menus, headers, footers, sidebars, notices and adverts are what a site repeats.

Where a page has an article (or main) element, the text is taken from inside it; where it has none, from all of the body.
By tag go head, forms, menus, asides, footers, scripts, styles and what is not shown (the hidden attribute, aria-hidden,
display:none). By name go elements of which a whole class token, the whole id or a role names a part: anywhere outside an
article (there the last word of a token counts too: site-footer), but inside one only div, section and aside elements named
as adverts, comments, notices or sharing; headings, paragraphs, lists, tables and figures of an article never go by name.
A name says nothing of an element with an article or most of the page's text inside, which is a wrapper, and if all
articles of a page lie in parts named by their tag (a form around the page), these are no parts.

Recurring containers go from min_pages on; prose inside an article, and what holds more than half of a page's text, needs
more pages. A page of which nothing would be left is left as it is. The pages that make a template grow with the host only
up to a fixed number.

Tags are read as browsers do: a quote counts only after an equals sign, an unquoted value ends at white space or ">". A
quoted value or a tag that never ends is read without its quote, or as text, and swallows nothing. The parser is linear in
the length of a page, however deep, and keeps per block of text only the element it stands in.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by two line feeds. Null or empty html gives an empty text. Rows are told apart by their content, so repeated
rows and null ids are no matter. Pages without a url share one nameless host. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

OPENER = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<other>[!?]|/[^a-zA-Z])|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*))", re.S)
PLAIN_END = re.compile(r"\s*+/?>")
NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)")
EQUALS = re.compile(r"\s*+=\s*+")
UNQUOTED = re.compile(r"[^\s>]*+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand inside a line of text.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr br img".split())
#: Prose, which inside an article needs more evidence to be taken for a template.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption tr".split()) | INLINE
NOT_TEXT = set("head title script style noscript template iframe object svg canvas nav footer aside form button select "
               "textarea input dialog menu noembed noframes audio video map".split())
#: Those of them that may stand around the article of a page.
AROUND = set("nav header footer aside form dialog menu".split())
#: Names of parts beside the article.
PARTS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
            "navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr "
            "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share "
            "sharing social related recommended recommendations comment comments disqus respond pagination pager toolbar "
            "search complementary contentinfo".split())
#: Names that delete a container inside an article too, and those that delete an article.
BESIDE = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
             "consent gdpr newsletter subscribe subscription signup share sharing comment comments disqus respond "
             "navigation complementary contentinfo".split())
CONTAINERS = {"div", "section", "aside"}
OTHER = {"ad", "ads", "advert", "comment", "comments", "sponsored", "related", "promo"}
#: Elements whose start ends an open paragraph, and those that end their own kind, as far as an open list or table.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
WORD = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")
FOLDS = 65536


class Element:
    """An open or closed element. What it needs of its ancestors it takes from its parent when it is made."""

    __slots__ = ("tag", "parent", "depth", "dropped", "named", "at", "holds", "hash", "chars", "block", "article", "in_tag",
                 "unseen", "number")

    def __init__(self, tag: str, parent: Element | None, named: str = "", at: int = -1) -> None:
        self.tag, self.parent, self.named, self.at, self.holds, self.number = tag, parent, named, at, False, -1
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = named != "" or parent is not None and parent.dropped
        self.in_tag = named == "tag" or parent is not None and parent.in_tag
        self.unseen = named == "unseen" or parent is not None and parent.unseen
        self.article: Element | None = parent.article if parent else None
        self.block = parent.block if tag in INLINE and parent else self
        self.hash, self.chars = xxhash.xxh64(tag), 0


def tag_end(page: str, at: int, last: int, quotes: dict[str, int]) -> tuple[int, dict[str, str]]:
    """Where the tag whose name ends at ``at`` ends, and its attributes (the first of each name). ``last`` is the page's last
    ">" and ``quotes`` has the last of each quote before it, so that no search runs to the end in vain."""
    m = PLAIN_END.match(page, at)
    if m:
        return m.end(), {}
    attrs: dict[str, str] = {}
    while True:
        m = NAME.match(page, at)
        name, at = m[1].lower(), m.end()
        if not name and page[at] == ">":
            return at + 1, attrs
        value, m = "", EQUALS.match(page, at)
        if m:
            at = m.end()
            quote = page[at]
            if quote in quotes and quotes[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1:end], end + 1
            else:
                m = UNQUOTED.match(page, at)
                value, at = m[0], m.end()
        attrs.setdefault(name, value)


def names_part(tag: str, attrs: dict[str, str], in_article: bool) -> str:
    """What names a part that is not article text: its tag, a name among its attributes, or that it is not shown."""
    if tag in NOT_TEXT or tag == "header" and not in_article:
        return "tag" if tag in AROUND else "unseen"
    if not attrs:
        return ""
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or re.search(
            r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return "unseen"
    if tag in ("html", "body") or in_article and tag not in CONTAINERS:
        return ""
    tokens = {*attrs.get("class", "").lower().split(), attrs.get("id", "").lower(), *attrs.get("role", "").lower().split()}
    if tag in ("article", "main"):
        return "name" if tokens & OTHER else ""
    if in_article:
        return "name" if tokens & BESIDE else ""
    return "name" if any(t in PARTS or (WORD.findall(t) or [""])[-1] in PARTS for t in tokens) else ""


class Parsed:
    """A page's blocks of text in order, each with the number of its element; of the elements that can be deleted their
    subtree hash (odd where more pages are needed) and the nearest such element around (-1: none), outer ones first."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inside: list[int] = []
        self.up: list[int] = []
        self.trees: list[int] = []

    def held(self) -> set[int]:
        """Hashes of elements around a block."""
        seen = [False] * len(self.up)
        for n in self.inside:
            while n >= 0 and not seen[n]:
                seen[n] = True
                n = self.up[n]
        return {t for t, yes in zip(self.trees, seen) if yes}


def kept_lines(lines: list[str], inside: list[int], up: list[int], trees: list[int], cut: set[int]) -> list[str]:
    """The lines in no element whose hash is cut, or all of them if none is left."""
    gone: list[bool] = []
    for tree, around in zip(trees, up):
        gone.append(tree in cut or around >= 0 and gone[around])
    left = [line for line, n in zip(lines, inside) if n < 0 or not gone[n]]
    return left or lines


def parse(page: str, spared: frozenset[int] = frozenset()) -> Parsed:
    """spared: where elements start that are no parts, whatever their name."""
    top = Element("", None)
    at, pos, n_roots = top, 0, 0
    made: list[tuple[str, Element]] = []
    text: list[tuple[str, Element]] = []
    elements: list[Element] = []
    marked: list[Element] = []  # elements with a name of a part
    opened: dict[str, list[Element]] = defaultdict(list)  # open elements by tag, outer ones first
    free = False  # whether an article is outside of all parts named by their tag
    last = page.rfind(">")
    quotes = {q: page.rfind(q, 0, last) for q in "\"'"} if last > 0 else {}

    def flush() -> None:
        if text:
            line = SPACE.sub(" ", "".join(t for t, _ in text)).strip()
            if line:
                made.append((line, text[0][1].block))
            text.clear()

    def said(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            if not at.dropped:
                if text and text[-1][1] is not at and text[-1][1].block is not at.block:
                    flush()
                text.append((plain, at))
            if not raw.isspace():
                at.hash.update(plain.encode("utf-8", "surrogatepass"))
                at.chars += len(plain)

    def leave() -> None:
        """Close the innermost element: its hash and size go to its parent."""
        nonlocal at
        if at.tag not in INLINE:
            flush()
        opened[at.tag].pop()
        at.parent.hash.update(b"<" + at.hash.digest())
        at.parent.chars += at.chars
        at = at.parent

    def leave_to(e: Element) -> None:
        while at is not e:
            leave()
        leave()

    while last >= pos:
        m = OPENER.search(page, pos)
        if m is None or m.start() > last:
            break
        start = m.start()
        said(page[pos:start])
        if m["tag"] is None:
            mark, back = ("-->", 2) if m["comment"] else ("]]>", 0) if m["cdata"] else (">", 1)
            end = page.find(mark, m.end() - back)
            pos = len(page) if end < 0 else end + len(mark)
            continue
        tag = m["tag"].lower()
        pos, attrs = tag_end(page, m.end(), last, quotes)
        if m["close"]:
            if opened[tag]:
                leave_to(opened[tag][-1])
            continue
        if tag in ENDS_P:
            if at.block.tag == "p":
                leave_to(at.block)
        elif tag in ENDS_OWN:
            nearest = max((opened[t][-1] for t in (*ENDS_OWN[tag], *SCOPE.get(tag, ())) if opened[t]), key=lambda e: e.depth, default=None)
            if nearest is not None and nearest.tag in ENDS_OWN[tag]:
                leave_to(nearest)
        if tag not in INLINE:
            flush()
        if tag == "br":
            said(" ")
        if tag in VOID:
            at.hash.update(b"<" + tag.encode())
            continue
        named = "" if start in spared else names_part(tag, attrs, at.article is not None)
        new = Element(tag, at, named, start)
        if named and named != "unseen":
            marked.append(new)
        if tag in ("article", "main"):
            if not new.dropped:
                n_roots += 1
                new.article = new
            if not named and not at.unseen:
                free |= not at.in_tag
                up = at
                while up is not top and not up.holds:
                    up.holds = True
                    up = up.parent
        opened[tag].append(new)
        at = new
        if tag not in INLINE:
            elements.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![\w-])", re.I).search(page, pos)
            stop = page.find(">", end.end()) if end else -1
            pos = len(page) if stop < 0 else stop + 1
            leave()
    said(page[pos:])
    while at is not top:
        leave()
    flush()

    if marked and not spared:
        # In a page with an article, only what is in the article is measured against it.
        article = any(x.holds for x in marked) or any(x.tag in ("article", "main") for x in elements)

        def wraps(e: Element) -> bool:
            if e.named == "tag":
                return e.holds and not free
            if e.tag in ("article", "main"):
                return False
            if e.holds:
                return True
            around = e.article or top
            return (around is not top or not article) and 2 * e.chars > around.chars

        again = frozenset(e.at for e in marked if wraps(e))
        if again:
            return parse(page, again)

    inside = n_roots > 0
    whole = sum(len(line) for line, e in made if e.article or not inside)
    out = Parsed()
    for e in elements:
        # A page is never its own template.
        e.number = e.parent.block.number
        if e.chars and e.tag not in ("html", "body", "article", "main"):
            more = 2 * e.chars > whole or inside and e.article is not None and e.tag in PROSE
            out.up.append(e.number)
            out.trees.append((e.hash.intdigest() - (1 << 63)) & ~1 | more)
            e.number = len(out.up) - 1
    for line, e in made:
        if e.article or not inside:
            out.lines.append(line)
            out.inside.append(e.number)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = 5, min_share: float = 0.05, enough: int = 50, prose_pages: int = 20, prose_share: float = 0.5,
            prose_enough: int = 1000) -> DataFrame:
    """One row per page: id, url, text, n_chars. A subtree is a template when it is in at least min_pages different
    pages of its host, and in at least min_share of them or in `enough`; prose inside articles, and what is most of a page,
    when it is in at least prose_pages, and in at least prose_share of them or in prose_enough."""
    kind = pages.schema[id_col].dataType.simpleString()
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse(x.as_py() or "") for x in batch.column("html")]
            held = [p.held() for p in made]
            seen = pa.array([[{"tree": t, "held": t in own} for t in sorted(set(p.trees))] for p, own in zip(made, held)],
                            pa.list_(pa.struct([("tree", pa.int64()), ("held", pa.bool_())])))
            keep = [batch.column(c) for c in ("id", "url", "host", "page")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([p.lines for p in made], pa.list_(pa.string())), pa.array([p.inside for p in made], ints),
                 pa.array([p.up for p in made], ints), pa.array([p.trees for p in made], longs), seen],
                names=["id", "url", "host", "page", "lines", "inside", "up", "trees", "seen"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lines", "inside", "up", "trees", "cut")]
            left = [kept_lines(lines, inside, up, trees, set(cut or ())) for lines, inside, up, trees, cut in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(left, pa.list_(pa.string()))],
                                             names=["id", "url", "lines"])

    url = pages[url_col].cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    body = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), url.alias("url"), host.alias("host"), F.xxhash64(body).alias("page"), body.alias("html"))
    schema = (f"id {kind}, url string, host string, page long, lines array<string>, inside array<int>, up array<int>, "
              "trees array<bigint>, seen array<struct<tree: bigint, held: boolean>>")
    parsed = stored(rows.mapInArrow(run, schema), "pages")
    once = parsed.select("host", "page", F.explode("seen").alias("t")).select("host", "page", "t.tree", "t.held").distinct()
    seen = once.groupBy("host", "tree").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    sizes = parsed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all_pages"))
    prose = F.col("tree").bitwiseAND(F.lit(1)) == 1
    bar = F.when(prose, F.greatest(F.lit(prose_pages), F.least(F.lit(prose_enough), prose_share * F.col("all_pages")))).otherwise(
        F.least(F.lit(enough), min_share * F.col("all_pages")))
    recurring = seen.join(sizes, "host").where(F.col("pages") >= bar).select("host", "tree")
    recurring = stored(recurring, "templates")
    cut = once.where("held").join(recurring, ["host", "tree"]).groupBy("host", "page").agg(F.collect_set("tree").alias("cut"))
    cut = stored(cut, "cuts")
    # Only pages with a cut are shuffled to it, and the few that share a folded key with them; the folded keys are
    # broadcast, 65,536 at most.
    folded = F.pmod(F.xxhash64("host", "page"), F.lit(FOLDS)).alias("fold")
    folds = F.broadcast(cut.select(folded).distinct())
    parsed = parsed.select("id", "url", "host", "page", "lines", "inside", "up", "trees", folded)
    rest = parsed.join(folds, "fold", "left_semi").join(cut, ["host", "page"], "left")
    left = rest.select("id", "url", "lines", "inside", "up", "trees", "cut").mapInArrow(drop, f"id {kind}, url string, lines array<string>")
    out = left.unionByName(parsed.join(folds, "fold", "left_anti").select("id", "url", "lines"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join("lines", "\n\n").alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))
