"""The main text of pages against a slow version: characters one by one, a tree, and plain counts per host."""

import html
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from emberwatch.llm import html_text as fast


def slow_tokens(page):
    """("text", raw), ("open", tag, attrs, start) and ("close", tag)."""
    i, out, text = 0, [], ""
    while i < len(page):
        rest = page[i:]
        if page[i] != "<" or ">" not in rest or not re.match(r"<[!?a-zA-Z]|</[a-zA-Z]|</[^a-zA-Z]", rest):
            text += page[i]
            i += 1
            continue
        out.append(("text", text))
        text = ""
        ends = "-->" if rest.startswith("<!--") else "]]>" if rest.startswith("<![CDATA[") else None
        if ends or not re.match(r"</?[a-zA-Z]", rest):
            at = page.find(ends or ">", i + (2 if ends == "-->" else 9 if ends else 1))
            i = len(page) if at < 0 else at + len(ends or ">")
            continue
        start, close = i, page[i + 1] == "/"
        i += 1 + close
        tag = ""
        while page[i] not in " \t\n\r\f\v/>" and not page[i].isspace():
            tag += page[i].lower()
            i += 1
        attrs = {}
        while True:
            while page[i].isspace() or page[i] == "/":
                i += 1
            if page[i] == ">":
                i += 1
                break
            name = page[i]
            i += 1
            while not page[i].isspace() and page[i] not in "/>=":
                name += page[i]
                i += 1
            j = i
            while page[j].isspace():
                j += 1
            value = ""
            if page[j] == "=" :
                i = j + 1
                while page[i].isspace():
                    i += 1
                close_at = page.find(page[i], i + 1) if page[i] in "\"'" else -1
                if close_at >= 0 and ">" in page[close_at:]:
                    value, i = page[i + 1:close_at], close_at + 1
                else:
                    while not page[i].isspace() and page[i] != ">":
                        value += page[i]
                        i += 1
            attrs.setdefault(name.lower(), value)
        out.append(("close", tag) if close else ("open", tag, attrs, start))
        if not close and tag in fast.RAW:
            m = re.search(rf"(?i)</{tag}(?![\w-])", page[i:])
            at = page.find(">", i + m.end()) if m else -1
            i = len(page) if at < 0 else at + 1
            out.append(("close", tag))
    return out + [("text", text)]


class Node:
    def __init__(self, tag, parent, attrs=None, start=-1):
        self.tag, self.parent, self.attrs, self.start, self.kids = tag, parent, attrs or {}, start, []

    def chain(self):
        node = self
        while node is not None:
            yield node
            node = node.parent

    def size(self):
        return sum(k.size() if isinstance(k, Node) else 0 if k.isspace() else len(html.unescape(k)) for k in self.kids)

    def shape(self):
        return (self.tag, *(k.shape() if isinstance(k, Node) else html.unescape(k) for k in self.kids if isinstance(k, Node) or not k.isspace()))

    def nodes(self):
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.nodes()


def slow_tree(page):
    top = at = Node("", None)

    def leave(tags, scope=()):
        """The innermost open element of these tags and all in it are closed, unless a scope comes first."""
        nonlocal at
        for node in at.chain():
            if node.tag in tags:
                at = node.parent
                return
            if node.tag in scope:
                return

    for token in slow_tokens(page):
        if token[0] == "text":
            if token[1]:
                at.kids.append(token[1])
        elif token[0] == "close":
            leave({token[1]})
        else:
            _, tag, attrs, start = token
            if tag in fast.ENDS_P:
                block = next(n for n in at.chain() if n.tag not in fast.INLINE)
                if block.tag == "p":
                    at = block.parent
            elif tag in fast.ENDS_OWN:
                leave(fast.ENDS_OWN[tag], fast.SCOPE.get(tag, ()))
            new = Node(tag, at, attrs, start)
            at.kids.append(new)
            if tag == "br":
                at.kids.insert(-1, " ")
            if tag not in fast.VOID:
                at = new
    return top


def slow_names(top, spared):
    """What names each element a part, from the outside in, and the article that each stands in."""
    named, article, dropped = {top: ""}, {top: None}, {top: False}
    for node in top.nodes():
        if node is top:
            continue
        up = node.parent
        named[node] = "" if node.start in spared or node.tag in fast.VOID else fast.names_part(node.tag, node.attrs, article[up] is not None)
        dropped[node] = dropped[up] or named[node] != ""
        article[node] = node if node.tag in ("article", "main") and not dropped[node] else article[up]
    return named, article, dropped


def slow_page(page):
    """(blocks as (line, elements around, innermost first), elements that can be deleted with their shape and bar)."""
    top = slow_tree(page)
    named, article, dropped = slow_names(top, frozenset())
    roots = [n for n in named if n.tag in ("article", "main")]
    seen = [n for n in roots if not named[n] and not any(named[a] == "unseen" for a in n.parent.chain())]
    holds = {a for n in seen for a in n.parent.chain()}
    free = any(not any(named[a] == "tag" for a in n.parent.chain()) for n in seen)
    marked = [n for n in named if named[n] in ("tag", "name")]

    def wraps(n):
        if named[n] == "tag":
            return n in holds and not free
        if n.tag in ("article", "main"):
            return False
        if n in holds:
            return True
        around = article[n] or top
        return (around is not top or not (roots or any(m in holds for m in marked))) and 2 * n.size() > around.size()

    named, article, dropped = slow_names(top, frozenset(n.start for n in marked if wraps(n)))
    inside = any(article[n] is n for n in named)
    blocks, text, last = [], "", None

    def block(n):
        return next(a for a in n.chain() if a.tag not in fast.INLINE)

    def flush():
        nonlocal text, last
        line = re.sub(r"\s+", " ", text).strip()
        if line and last is not None and (article[last] is not None or not inside):
            blocks.append((line, [a for a in last.chain() if a.tag not in fast.INLINE]))
        text, last = "", None

    def walk(node):
        nonlocal text, last
        for kid in node.kids:
            if isinstance(kid, Node):
                if kid.tag not in fast.INLINE:
                    flush()
                walk(kid)
                if kid.tag not in fast.INLINE and kid.tag not in fast.VOID:
                    flush()
            elif not dropped[node]:
                if last is not None and last is not block(node):
                    flush()
                text, last = text + html.unescape(kid), last or block(node)

    walk(top)
    flush()
    whole = sum(len(line) for line, _ in blocks)
    cuttable = {n: (n.shape(), 2 * n.size() > whole or inside and article[n] is not None and n.tag in fast.PROSE) for n in named
                if n is not top and n.size() and n.tag not in fast.INLINE | fast.VOID | {"html", "body", "article", "main"}}
    return blocks, cuttable


def slow_site(pages):
    """Texts of the pages of one host, with the default numbers of pages."""
    made = {p: slow_page(p) for p in set(pages)}
    count = Counter(key for _, cuttable in made.values() for key in set(cuttable.values()))

    def cut(key):
        n = count[key]
        return n >= 5 and n >= (max(20, min(1000, 0.5 * len(made))) if key[1] else min(50, 0.05 * len(made)))

    out = {}
    for p, (blocks, cuttable) in made.items():
        left = [line for line, around in blocks if not any(n in cuttable and cut(cuttable[n]) for n in around)]
        out[p] = "\n\n".join(left or [line for line, _ in blocks])
    return [out[p] for p in pages]


BITS = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<ul><li>", "<li>", "</ul>", "<table><tr><td>", "<td>", "</table>", "<br>", "<hr>",
        "<article>", "</article>", "<main>", "<form>", "</form>", "<nav>", "</nav>", "<div class=ad>", "<div class='ad-hoc'>",
        "<section id=comments>", "</section>", "<p class=hidden>", "<p hidden>", "<div style='display:none'>", "<div class='site-footer'>",
        "<!-- x -->", "<!-->", "<![CDATA[y]]>", "<script>var a='</p>'</script>", "<script", "</script>", "<a b=\"", "<a b=", "<a b='>", "'", "\"", ">", "<", "</",
        "</>", "<p title=it's>", "<p data-x='a'b'>", "<dl><dt>", "<dd>", "&amp;", "&lt;", "<header>", "</header>", "<span id=share>", "</span>", "<aside>"]


@pytest.mark.parametrize("seed", range(6))
def test_random_broken_pages(seed):
    rng = random.Random(seed)
    for _ in range(400):
        bits = rng.choices(BITS, k=rng.randint(1, 25))
        page = "".join(b + rng.choice(["", " ", f"w{rng.randrange(9)} ", "some longer words "]) for b in bits)
        blocks, cuttable = slow_page(page)
        got = fast.parse(page)
        assert got.lines == [line for line, _ in blocks], page
        around = []
        for n in got.inside:
            own = []
            while n >= 0:
                own.append(got.trees[n])
                n = got.up[n]
            around.append(own)
        names = {}  # hash for shape: one to one
        for own, (_, nodes) in zip(around, blocks):
            keys = [cuttable[n] for n in nodes if n in cuttable]
            assert [t & 1 for t in own] == [int(bar) for _, bar in keys], page
            for t, key in zip(own, keys):
                assert names.setdefault(t, key) == key, page
        assert len(set(names.values())) == len(names)


def test_sites_against_plain_counts(spark):
    rng = random.Random(8)
    shared = ["<div>Follow us here</div>", "<p>We use what we like on every page of this site, and a lot of it, so much that it is long.</p>",
              "<section><h2>News</h2><p>Buy the paper</p></section>", "<ul><li>One<li>Two</ul>", "<div class=menu><a>Go</a></div>"]
    rows = []
    for host, n in (("a", 30), ("b", 70), ("c", 4)):
        for i in range(n):
            body = [f"<p>Own words {rng.randrange(10**6)} of {host}{i}</p>", *rng.sample(shared, rng.randint(1, 5))]
            rng.shuffle(body)
            inner = "".join(body)
            rows.append((len(rows), f"http://{host}.example/{i}", f"<body><nav>x</nav><article>{inner}</article>" if i % 3 else f"<body>{inner}"))
    rows += [(1000 + i, "http://d.example/", "<article><p>Same text everywhere, nothing else.</p></article>" + f"<div>{i}</div>") for i in range(40)]
    got = {r.page_id: r.text for r in fast.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    by_host = defaultdict(list)
    for i, url, page in rows:
        by_host[url.split("/")[2]].append((i, page))
    for own in by_host.values():
        assert {i: got[i] for i, _ in own} == dict(zip([i for i, _ in own], slow_site([p for _, p in own])))
    assert set(got[i] for i in range(1000, 1040)) == {"Same text everywhere, nothing else."}


@pytest.mark.parametrize(("inner", "said"), [
    ('<h2 id="related-work">Related work</h2>', "Related work"), ('<section id="search-trees">Trees</section>', "Trees"),
    ('<p title="the hidden truth">x</p>', "x"), ('<p data-id="comment">x</p>', "x"), ('<p class="hidden-gem">x</p>', "x"),
    ('<div class="ad-hoc"><p>x</p></div>', "x"), ('<figure class="social-history">x</figure>', "x"), ('<ul class="menu"><li>soup</li></ul>', "soup"),
    ('<p><a class="share-price">12.5</a> euro</p>', "12.5 euro"), ("<p title=it's>Text lost", "Text lost"),
    ("<p data-x='a'b'>broken</p><p>don't</p>", "broken\n\ndon't"), ("<header><h1>Its title</h1></header>", "Its title"),
    ('<section id="comments"><p>Nice!</p></section>', ""), ('<div class="x ad">Buy</div>', ""), ("<p hidden>no</p>", ""), ('<aside>no</aside>', "")])
def test_article_text_is_kept(inner, said):
    page = f"<article><p>A first paragraph that is longer than the rest of the page.</p>{inner}</article>"
    assert fast.parse(page).lines[1:] == ([x for x in said.split("\n\n")] if said else [])


def test_long_notice_in_short_articles_goes(spark):
    notice = "<div><p>" + "We value your privacy and so do our partners. " * 20 + "</p></div>"
    rows = [(i, "http://n.example/", f"<article><p>Short note {i}.</p>{notice}</article>") for i in range(30)]
    got = fast.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Short note {i}." for i in range(30)}


@pytest.mark.parametrize("bit", ["<div>x ", '<a b="', "<a b=", "<a b=\">x", "<b>x<hr>", "<div><li>x", "</x>y<div>", "<article>x", "<", "</script", "<script>x</script", "<p class='ad'>x",
                                 "<td>x", "<!--", "<![CDATA[", "<p a='"])
def test_a_megabyte_of_broken_tags_is_quick(bit):
    start = time.process_time()
    fast.parse(bit * (1_000_000 // len(bit)))
    assert time.process_time() - start < 15
