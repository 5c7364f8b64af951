"""Main-text extraction from HTML by tree scoring.

A page is read into a tree of its block elements.  Each block of text passes points to the elements
above it: one, one more for each comma and for each hundred characters up to three (a block of under 25
characters only its hundredths), the whole to its container and to ``article`` and ``main`` above it, half to
the next, less above.  An element's points are discounted by its link density.  The best element is kept with
those siblings, of its own and of the elements above it up to the page or the article, that score alike, look alike or read like prose, and with the headings
before them, without the lists that are links almost throughout (those under a heading of an ``article`` stay).  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out
wherever they stand, told by element, role or class; classes that only hint at such (``related``, ``social``)
leave out what is short or full of links; so do words that name a section (``id``), stand beside words that no layout uses (``login-guide``) or
name what a paragraph can't be.  A button or picture inside a sentence doesn't part it.  All passes are linear in the page.

Defined cases: null or empty html gives an empty text; a page without markup is its own text; unclosed and
stray tags are repaired as browsers do for paragraphs, list items and table cells; repeated rows are
extracted each by itself; other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>|<[!?][^>]*>""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_S = lambda s: frozenset(s.split())
VOID = _S("area base br col embed hr img input link meta param source track wbr")
RAW = _S("script style textarea title xmp iframe noembed noframes")
BLOCK = _S(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul "
    "noscript template svg canvas object audio video map button select optgroup option datalist search"
)
DROP = _S(
    "head nav footer aside form noscript template svg canvas object audio video map button select optgroup option datalist dialog menu "
    "search fieldset"
)
ROLES = _S("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist status")
#: Words of class and id that mark what is not the article.
WORDS = _S(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored promo promos promotion popup modal overlay "
    "cookie cookies consent gdpr notice notices notification alert banner disclaimer sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead newsletter signup signin login pagination pager toolbar paywall topbar bottombar"
)
#: Words that only hint at it: prose of the article under them stays.
HINTS = _S("side share sharing social related recommended recommendations widget widgets subscribe subscription skip")
#: Words that name layout: beside them a word of WORDS keeps its meaning, beside others it only hints.
LAYOUT = _S(
    "box bar container wrapper wrap block top bottom left right main inner outer slot unit text form list link links item items area zone site page global web "
    "content section module panel row col column group holder body title label button btn image img large small mobile desktop fixed sticky native inline in the my js"
)
#: Words of WORDS that name what a paragraph can't be.
STRUCTURES = _S(
    "sidebar sidebars menu menus nav navbar navigation breadcrumbs footer header masthead signup signin login pagination pager toolbar topbar bottombar modal popup overlay"
)
ANCHORED = _S("section p h1 h2 h3 h4 h5 h6 dt dd")  # their ids name places in the text
INLINE = _S("button svg canvas select datalist")  # left out of a sentence without parting it
_ENDS = (".", "!", "?", "…", "\"", "”", "»", ")", ":", ";", "。")
COMMENTS = _S("comment comments commentlist disqus respond replies")
_CLOSES_P = BLOCK - _S("button option optgroup select datalist map object")
_SAME = {
    "li": (_S("li"), _S("ul ol menu dir")), "dt": (_S("dt dd"), _S("dl")), "dd": (_S("dt dd"), _S("dl")),
    "tr": (_S("tr td th"), _S("table tbody thead tfoot")), "td": (_S("td th"), _S("tr table")), "th": (_S("td th"), _S("tr table")),
    "option": (_S("option"), _S("select datalist optgroup")),
    "tbody": (_S("tr td th tbody thead tfoot"), _S("table")), "tfoot": (_S("tr td th tbody thead tfoot"), _S("table")), "thead": (_S("tr td th tbody thead tfoot"), _S("table")),
}
LEVELS = 5  # ancestors that a block passes points to
LISTS = _S("ul ol dl div section table menu")
_FENCE = _S("article section div main body html td th table button li")
_OWN = _S("div section article main body html td")  # containers that keep the points of their own text
_PARTS = _S("ul ol dl table pre blockquote figure h3 h4 h5 h6")
_OPEN = (("<!--", "-->"), ("<![CDATA[", "]]>"))
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class _Node:
    __slots__ = ("tag", "up", "off", "soft", "hint", "score", "chars", "links", "blocks", "prose", "holds", "depth", "around", "points", "mark", "closed")

    def __init__(self, tag: str, up: "_Node | None", off: bool, soft: bool, hint: bool) -> None:
        self.tag, self.up, self.off, self.soft, self.hint = tag, up, off, soft, hint
        self.score = self.points = 0.0
        self.mark = ""  # its class
        self.closed = False  # its last block ends like a sentence
        self.chars = self.links = self.blocks = 0
        self.prose = 0  # characters of its own and of paragraphs right below
        self.holds = False  # an article, main or h1 stands below
        self.depth = up.depth + 1 if up else 0
        self.around = None if up is None else up if up.tag in ("article", "main") else up.around

    def density(self) -> float:
        return self.links / max(1, self.chars)


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """(left out in any case, left out unless it wraps the article, left out unless it is prose of the article)."""
    if tag in DROP:
        return (tag not in ("form", "fieldset", "aside"), True, False)
    if not attrs.strip():
        return False, tag == "header", False
    off = soft = hint = False
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        value = value.strip("\"'")
        if name in ("class", "id"):
            for token in value.split():
                w = {x.lower() for x in _NAME.findall(token)}
                if w & COMMENTS:
                    off = True
                elif w & WORDS:
                    other = any(len(x) > 1 and not x.isdigit() for x in w - WORDS - HINTS - LAYOUT)
                    if other or name == "id" and tag in ANCHORED or tag == "p" and w & WORDS <= STRUCTURES:
                        hint = True
                    else:
                        soft = True
                elif w & HINTS:
                    hint = True
        elif name == "role" and value.lower() in ROLES:
            soft = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            off = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            off = True
    if tag in ("html", "body", "main"):
        off = soft = hint = False
    if tag == "article":
        soft = hint = False
    return off, soft or tag == "header", hint


def _class_of(attrs: str) -> str:
    return next((v.strip("\"'").strip() for k, v in _ATTR.findall(attrs) if k.lower() == "class"), "") if attrs.strip() else ""


@functools.cache
def _ends_inline(tag: str) -> re.Pattern:
    """The element's end, or what shows that it wasn't closed in its sentence."""
    return re.compile(rf"</?{tag}(?=[\s/>])[^>]*>|</?(?:p|div|article|section|main|body|ul|ol|li|table|td|h[1-6])(?=[\s/>])", re.I)


def _read(page: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """Blocks of text (element, text, characters in links), in page order, and all elements."""
    root = _Node("html", None, False, False, False)
    stack, nodes, blocks = [root], [root], []
    places: dict[str, list[int]] = {"html": [0]}  # where each tag stands in the stack
    run: list[tuple[str, bool]] = []
    link = 0
    own = root

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join(_html.unescape("".join(t for t, _ in run)).split())
            if text:
                in_links = sum(len(" ".join(_html.unescape(t).split())) for t, a in run if a)
                blocks.append((own, text, min(in_links, len(text))))
            run = []

    def push(node: _Node) -> None:
        nonlocal own
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)
        nodes.append(node)
        own = node

    def pop_to(k: int) -> None:
        nonlocal own
        flush()
        while len(stack) > k:
            places[stack.pop().tag].pop()
        own = stack[-1]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def first_after(tags, k: int) -> int:
        found = [at[i] for at in (places.get(t) for t in tags) if at and (i := bisect.bisect_right(at, k)) < len(at)]
        return min(found, default=-1)

    pos, end = 0, page.rfind(">") + 1  # no tag stands behind the last bracket
    while pos < end:
        m = _TAG.search(page, pos, end)
        if m is None:
            break
        if m.start() > pos:
            run.append((page[pos : m.start()], link > 0))
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            for head, tail in _OPEN:
                if page.startswith(head, m.start()) and not page.startswith(tail, max(m.start() + len(head), pos - len(tail))):
                    pos = len(page)  # never closed
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if closing:
            if tag == "a":
                link = max(0, link - 1)
            elif tag == "br":
                run.append((" ", False))
            elif tag in BLOCK or places.get(tag):
                k = last(_HEADINGS) if tag in _HEADINGS else last((tag,))
                if k > 0 and not (tag in ("p", "li", "dd", "dt") and last(_FENCE - {tag}) > k):
                    pop_to(k)
                if tag == "p":
                    flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, pos, end)
            pos = stop.end() if stop[0] else len(page)
            continue
        if tag == "br":
            run.append((" ", False))
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag == "a":
            link = 1
            continue
        if tag in INLINE and run:
            m = _ends_inline(tag).search(page, pos, end)
            if m and m[0].lower().startswith(f"</{tag}"):
                pos = m.end()
                continue
        if tag not in BLOCK:
            marks = _marks(tag, attrs) if attrs else (False, False, False)
            if any(marks):
                flush()
                push(_Node(tag, stack[-1], *marks))
            continue
        if tag in _CLOSES_P and last(("p",)) > last(_FENCE):
            pop_to(last(("p",)))
        if tag in _SAME:
            same, fence = _SAME[tag]
            k = first_after(same, last(fence))
            if k > 0:
                pop_to(k)
        flush()
        if tag == "html":
            continue
        if tag == "body" and places.get("head"):
            pop_to(places["head"][0])
        node = _Node(tag, stack[-1], *_marks(tag, attrs))
        node.mark = _class_of(attrs)
        if tag in ("article", "main", "h1"):
            up = node.up
            while up is not None and not up.holds:
                up.holds = True
                up = up.up
        if attrs.rstrip().endswith("/") and tag in ("svg", "object", "canvas"):
            continue
        push(node)
        if tag in ("article", "body", "main"):
            link = 0
    rest = page[pos:]
    run.append((rest[: min((i for i in (rest.find(head) for head, _ in _OPEN) if i >= 0), default=len(rest))], link > 0))
    flush()
    return blocks, nodes


def _weigh(blocks: list[tuple[_Node, str, int]], nodes: list[_Node]) -> None:
    """Give each element its score and its numbers of characters, characters in links and blocks; parents come before children in
    ``nodes``."""
    for n in nodes:
        n.score, n.points, n.chars, n.links, n.blocks, n.prose, n.closed = 0.0, 0.0, 0, 0, 0, 0, False
    for node, text, links in blocks:
        node.chars += len(text)
        node.links += links
        node.blocks += 1
        node.prose += len(text)
        if node.tag == "p" and node.up is not None:
            node.up.prose += len(text)
        points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else len(text) / 100
        node.points += points
        node.closed = text.endswith(_ENDS)
        up = first = node if node.tag in _OWN or node.up is None else node.up
        level = 0
        while up is not None and level < LEVELS:
            if level == 0 or up.tag not in ("article", "main"):
                up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.up, level + 1
        up, level = first.around, 0
        while up is not None and level < LEVELS:
            up.score += points
            up, level = up.around, level + 1
    for n in reversed(nodes):
        if n.up is not None:
            n.up.closed = n.up.closed or n.closed
            n.up.points += n.points
            n.up.chars += n.chars
            n.up.links += n.links
            n.up.blocks += n.blocks


def _left_out(nodes: list[_Node], strict: bool) -> set[int]:
    """Elements that are not the article, with all below them; parents come before children in ``nodes``."""
    out: set[int] = set()
    for node in nodes:
        own = node.off or node.soft and strict and not (node.holds and node.tag != "nav")
        if node.hint and strict and not node.holds:
            own = own or node.around is None or node.chars < 60 or node.density() >= 0.25
        if node.tag == "header" and node.holds and strict and not node.off:
            # a header beside the prose of its article keeps its heading; the page's header goes
            own = node.around is None and (node.up is None or node.up.tag in ("html", "body") or node.up.prose < 25)
        if own or node.up is not None and id(node.up) in out:
            out.add(id(node))
    return out


def _beside(best: _Node, nodes: list[_Node]) -> set[int]:
    """The best element and what stands beside it, or beside an element around it, and belongs to the text."""
    path = [best]
    while path[-1].up is not None and path[-1].tag not in ("article", "main"):
        path.append(path[-1].up)
    children: dict[int, list[_Node]] = {id(up): [] for up in path[1:]}
    for n in nodes:
        if n.up is not None and n.chars and id(n.up) in children:
            children[id(n.up)].append(n)
    keep = {id(best)}
    bar = 0.2 * best.points * (1 - best.density())
    for level, (on, up) in enumerate(zip(path, path[1:])):
        page = up.tag in ("html", "body")
        follows = False  # what comes next belongs to the text
        for n in reversed(children[id(up)]):
            density = n.density()
            alike = n.points * (1 - density) >= bar or n.tag == on.tag and n.mark != "" and n.mark == on.mark
            if n is on:
                kept = True
            elif n.tag in _HEADINGS:
                kept = density < 0.5 and (n.tag == "h1" or level == 0 and (n.tag == "h2" or not page and density < 0.25) or follows)
            elif n.tag == "header":
                kept = level == 0 or follows
            elif n.tag == "p":
                kept = (level == 0 or not page) and (n.chars > 80 and density < 0.25 or level == 0 and density == 0)
            elif level == 0 and n.tag in _PARTS and not page:
                kept = density < 0.25
            else:
                kept = alike and density < 0.33 or not page and density == 0 and n.closed
            if kept and n is not on:
                keep.add(id(n))
            follows = kept
    return keep


def _choose(blocks: list[tuple[_Node, str, int]], nodes: list[_Node]) -> list[str]:
    _weigh(blocks, nodes)
    rank = lambda n: n.score * (1 - n.density())
    best = max(nodes, key=lambda n: (rank(n), n.tag in ("article", "main"), n.depth))
    keep = {id(n) for n in nodes} if rank(best) <= 0 else _beside(best, nodes)
    headed: set[int] = set()  # lists of an article that follow or begin with a heading
    last: dict[int, str] = {}
    for n in nodes:
        if n.up is not None and n.chars:
            if n.around is not None and n.around.tag == "article":
                if last.get(id(n.up)) in _HEADINGS:
                    headed.add(id(n))
                if n.tag in _HEADINGS and id(n.up) not in last:
                    headed.add(id(n.up))
            last[id(n.up)] = n.tag
    inside: set[int] = set()
    for n in nodes:
        if (id(n) in keep or n.up is not None and id(n.up) in inside) and not (n.tag in LISTS and n.blocks > 2 and n.density() >= 0.9 and id(n) not in headed):
            inside.add(id(n))
    return [t for n, t, _ in blocks if id(n) in inside]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, nodes = _read(page)
    _weigh(blocks, nodes)
    for strict in (True, False):
        out = _left_out(nodes, strict)
        rest = [b for b in blocks if id(b[0]) not in out]
        if rest:
            return "\n".join(_choose(rest, [n for n in nodes if id(n) not in out]))
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    ident, url = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {ident}, url {url}, text string, n_chars long")
