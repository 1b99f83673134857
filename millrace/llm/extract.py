"""Main text of web pages by composite text density.

Of every DOM node: density = characters per tag, corrected for links. The subtree whose children's densities have the
largest sum is the core of the content; the smallest density on the path from it to body is the threshold. Every other
part of the page that reaches it is content too, and so is what lies between, down from their common ancestor.
Elements that are never shown as text are cut before, and so are those that by name, role or class are seldom main text,
whatever their length; they are taken back, the largest first, only where the rest of the page has no text block to speak of.
"""

from __future__ import annotations

import heapq
import html as entities
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)")
#: Elements whose content is text without markup; they end at their end tag only.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes an open element of these, up to the nearest one of the second set.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Never text of the page.
_NO_TEXT = frozenset("script style noscript iframe template svg select textarea input title head object embed canvas audio video map".split())
#: Seldom main text.
_CUT = frozenset("nav header footer aside form button menu dialog".split())
#: A text block of so many characters outside links, or of half the longest one of a cut, is worth a page; shorter lines of a menu never are.
BLOCK_CHARS, LINE_CHARS = 80, 25
#: Blocks that are text though they are linked; a list of links has this many.
_TEXT = frozenset("p blockquote h1 h2 h3 h4 h5 h6 figure figcaption pre address dd dt li td th caption".split())
LIST_LINKS = 3
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A class or id that names such a part as a whole: words before, the part, words after.
_BEFORE = "site page main global top bottom left right primary secondary post entry article blog single mobile desktop sticky fixed js c l u the".split()
_PART = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer foot sidebar side-bar aside widget widgets related related-posts related-articles related-links recommended recommendations "
    "share-buttons share-bar sharing social social-links social-share share comment comments commentlist comment-list respond replies disqus "
    "cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice newsletter subscribe signup sign-up login popup modal overlay "
    "toolbar pagination pager copyright skip skip-link hidden"
).split()
_AFTER = "list section area wrapper wrap container content box block bar inner outer row col column group thread form links menu widget holder region zone unit slot thread buttons bottom top left right".split()
_CUT_NAME = re.compile(rf"(?:(?:{'|'.join(_BEFORE)})[_-]+)*(?:{'|'.join(sorted(_PART, key=len, reverse=True))})(?:[_-]+(?:{'|'.join(_AFTER)}|\d+))*\d*", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "own", "longest", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", cut: bool) -> None:
        self.tag, self.parent, self.cut = tag, parent, cut
        self.children: list[Node | str] = []  # text is a str
        self.own = self.longest = 0  # characters of its own texts, in sum and of the longest
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(value: str) -> bool:
    return any(_CUT_NAME.fullmatch(v.replace("__", "-")) for v in value.split())


def _is_cut(tag: str, attributes: str) -> bool:
    if tag in _CUT or tag in _NO_TEXT:
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in _CUT_ROLE or name in ("class", "id") and tag not in ("article", "main") and _named(value):
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:$|[\s=])", _QUOTED.sub("''", attributes)))


def parse(html: str) -> Node:
    """The DOM of a page that need not be well formed, without recursion."""
    root = node = Node("html", None, False)
    at, end = 0, len(html)
    opened: dict[str, int] = {}  # elements that are open, by tag

    def text(a: int, b: int) -> None:
        if b > a:
            node.children.append(html[a:b])

    def leave(n: Node) -> None:
        nonlocal node
        while node is not n.parent:
            opened[node.tag] -= 1
            node = node.parent

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        while any(opened.get(x) for x in names):
            n = node
            while n is not root and n.tag not in stops and n.tag not in names:
                n = n.parent
            if n.tag not in names:
                return
            leave(n)

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                n = node
                while n.tag != tag:
                    n = n.parent
                leave(n)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not any(isinstance(c, Node) and c.tag == "body" for c in root.children):
                node = Node("body", root, False)
                root.children.append(node)
                opened["body"] = 1
            continue
        if tag in _BLOCK:
            close(("p",), ("table", "td", "th", "li", "article", "section", "div", "body"))
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        # the header of an article is part of it
        new = Node(tag, node, _is_cut(tag, m[3]) and not (tag == "header" and (opened.get("article") or opened.get("main"))))
        node.children.append(new)
        if tag in _RAW:
            stop = _RAW[tag].search(html, at)
            at = stop.end() if stop else end
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            node = new
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _take_back(root: Node) -> None:
    """Fills own and longest, and takes back cuts, the largest first, while nothing else on the page is a text block."""
    order, stack, cuts, tie = [], [root], [], itertools.count()
    while stack:
        n = stack.pop()
        order.append(n)
        cuts.append(n.cut)
        stack += [c for c in n.children if not isinstance(c, str) and c.tag not in _NO_TEXT]
    flow: dict[int, int] = {}  # characters outside links of a block's own lines
    plain: dict[int, int] = {}  # and of all that is in an element
    longest: dict[int, int] = {}  # the longest block in an element, whether cut or not
    for n in reversed(order):
        for c in n.children:
            if isinstance(c, str):
                size = len(entities.unescape(c).strip())
                n.own, n.longest = n.own + size, max(n.longest, size)
        inner = [c for c in n.children if not isinstance(c, str) and c.tag not in _NO_TEXT]
        flow[id(n)] = 0 if n.tag == "a" else n.own + sum(flow[id(c)] for c in inner if c.tag not in _BLOCK)
        plain[id(n)] = 0 if n.tag == "a" else n.own + sum(plain[id(c)] for c in inner)
        longest[id(n)] = max([flow[id(n)], *(longest[id(c)] for c in inner)])
    if not any(cuts):
        return

    def outermost(top: Node) -> tuple[list[tuple[int, int, Node]], int]:
        """The cuts right below what is shown of an element, and the longest block that it shows; any one in an article or main will do."""
        found, most, stack = [], 0, [(top, False)]
        while stack:
            n, marked = stack.pop()
            marked = marked or n.tag in ("article", "main")
            most = max(most, BLOCK_CHARS if marked and flow.get(id(n), 0) else flow.get(id(n), 0))
            for c in n.children:
                if not isinstance(c, str):
                    if not c.cut:
                        stack.append((c, marked))
                    elif plain.get(id(c), 0) and (c.tag not in ("nav", "menu") or longest[id(c)] >= LINE_CHARS):
                        found.append((-plain[id(c)], next(tie), c))
        return found, most

    heap, shown = outermost(root)
    heapq.heapify(heap)
    last = 0
    while heap and (heap[0][0] == last or shown < min(BLOCK_CHARS, longest[id(heap[0][2])] / 2)):
        last, _, n = heapq.heappop(heap)  # equally large ones are taken back together
        n.cut = False
        inner, most = outermost(n)
        shown = max(shown, most)
        for x in inner:
            heapq.heappush(heap, x)


def _measure(root: Node) -> tuple[Node, list[Node]]:
    """Fills counts and densities, bottom up; returns body and all nodes in page order."""
    _take_back(root)
    order, stack, body = [], [root], root
    while stack:
        n = stack.pop()
        order.append(n)
        if n.tag == "body" and body is root:
            body = n
        stack += [c for c in reversed(n.children) if not isinstance(c, str) and not c.cut]
    for n in reversed(order):
        n.chars = n.own
        for c in n.children:
            if not isinstance(c, str) and not c.cut:
                n.chars, n.tags = n.chars + c.chars, n.tags + c.tags + 1
                n.link_chars, n.link_tags = n.link_chars + c.link_chars, n.link_tags + c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    whole = max(1, body.chars)
    ratio = body.link_chars / whole
    for n in order:
        if n.chars:
            tags, links = max(1, n.tags), max(1, n.link_tags)
            plain = n.chars - n.link_chars
            base = math.log(n.chars / max(1, plain) * n.link_chars + ratio * n.chars + math.e)
            weight = math.log(max(math.e, n.chars / max(1, n.link_chars) * tags / links), max(base, 1.0001)) if n.link_chars else 1.0
            n.density = n.chars / tags * weight
    for n in order:
        n.total = sum(c.density for c in n.children if not isinstance(c, str) and not c.cut and c.tag in _BLOCK)  # inline elements are part of their block
    return body, order


def _content(best: Node, body: Node) -> tuple[Node, float, set[int], bool]:
    """The lowest node with all content, the threshold, ids of the parts that reach it, and whether page parts lie around."""
    path, n = [best], best
    while n is not body and n.parent is not None:
        n = n.parent
        path.append(n)
    threshold = min(n.density for n in path)
    place = {id(n): k for k, n in enumerate(path)}
    sure, top = {id(best)}, 0
    stack = [(path[-1], len(path) - 1)]
    while stack:
        n, k = stack.pop()
        if n is best or not n.chars:
            continue
        on_path = id(n) in place
        k = place.get(id(n), k)
        if not on_path and n.density >= threshold and n.link_chars <= 0.5 * n.chars:
            sure.add(id(n))
            top = max(top, k)
            continue
        if n.longest >= threshold and n.tag != "a":
            top = max(top, k)
        stack += [(c, k) for c in n.children if not isinstance(c, str) and not c.cut]
    return path[top], threshold, sure, top > 0 and path[top].tag in ("body", "html")


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, two line feeds between."""
    if not html:
        return ""
    body, order = _measure(parse(html))
    best = max(order, key=lambda n: n.total)
    if not best.total:
        best = body
    top, threshold, sure, around = _content(best, body)
    blocks: list[str] = []
    kinds: list[str] = []
    parts: list[str] = []
    inside, seen = 0, False

    def flush(tag: str = "") -> None:
        nonlocal seen
        if parts:
            block = _SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if block:
                blocks.append(block)
                kinds.append("sure" if seen or len(block) >= threshold else "heading" if tag in _HEADING else "")
            parts.clear()
        seen = False

    # iterative walk; a mark ends an element
    stack: list[Node | str | tuple[Node]] = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            if x[0].tag in _BLOCK:
                flush(x[0].tag)
            inside -= id(x[0]) in sure
        elif isinstance(x, str):
            parts.append(x)
            seen = seen or inside > 0
        elif x.cut:
            parts.append(" " if x.tag not in _BLOCK else "")
        elif x.tag == "br":
            parts.append(" ")
        else:
            if x is not top and x.tag in _BLOCK - _TEXT and x.link_tags >= LIST_LINKS and x.link_chars > 0.5 * x.chars and x.density < threshold:
                flush()  # a list of links inside the content
                continue
            if x.tag in _BLOCK:
                flush()
            if x.tag in _BLOCK or id(x) in sure:
                stack.append((x,))
                inside += id(x) in sure
            stack += reversed(x.children)
    flush()
    if around and "sure" in kinds:
        # short lines at either end of body are the site's; a heading and what follows it are the content's
        first, last = kinds.index("sure"), len(kinds) - kinds[::-1].index("sure")
        at = first - 1
        while at >= 0 and kinds[at] != "heading":
            at -= 1
        while at > 0 and kinds[at - 1] == "heading":
            at -= 1
        blocks = blocks[at if at >= 0 else first : last]
    return "\n\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html; others are ignored).

    Null, empty and text-free html gives an empty text; null ids and urls stay null; repeated rows give repeated rows.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
