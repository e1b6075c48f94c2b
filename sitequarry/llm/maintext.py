"""Main text of web pages by tree scoring.

The page is parsed to a tree that forgives broken markup, in time that grows with its length.  Each paragraph gives
points (one at most for being there, one for each comma, up to three for its
length) to its parent, half of them to the grandparent, and ever less further up.
An element's points are multiplied by one minus the share of its text that lies
in links.  The element with most points is kept; of an element in an article or main,
that article or main; else with all its siblings that aren't mostly links.

What is no part of an article (menus, page headers and footers, sidebars, notices, adverts, forms, reader comments,
scripts, styles) gives no points and no text.  It is told by its element, or by a class, id or role all of whose words say so
("comment-list", not "search-results-explained").  Words that an article may use as well ("related", "share", "legal") count
only if the element is mostly links or holds no sentence.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import as_batch

# Element names of HTML.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROPPED = RAW | set("head nav header footer aside form button select option input label fieldset menu dialog object embed applet canvas audio video map datalist".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPES = set("table td th caption button object template body html article section div main aside nav header footer blockquote form li dd".split())
# Opening the first closes an open element of the second, within the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
# Words of class, id and role that mark what is no article, alone or with the words after them.
UNWANTED = set(
    "ad ads adbox adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal "
    "nav navbar navbox navigation newsletter notice notices pager pagination paywall popup promo promoted promotion respond replies shoutbox sidebar sidenav signup sponsor sponsored sponsors "
    "subscribe subscription tagcloud toolbar widget widgets contentinfo complementary".split()
)
# Words that mark it only where the element is mostly links or holds no sentence.
DOUBTFUL = set("alert banner billboard copyright dialog disclaimer discussion legal overlay rail recommended related responses search share sharing skip social".split())
NEUTRAL = set("area bar block body box bottom button buttons container content entry form group holder inner item items left links list main page panel post posts right section site slot sub text thread title to top wrap wrapper".split())
WANTED = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "dialog footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices alert overlay pager pagination paywall popup promo promoted promotion "
    "rail recommended related replies respond responses search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription tagcloud toolbar widget widgets "
    "contentinfo complementary navigation discussion".split()
)
WANTED = set("article body content entry main page post story text blog column hentry prose".split())
NEVER_UNWANTED = {"html", "body", "article", "main"}
PARAGRAPHS = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body figcaption".split())

#: Attributes end at an unquoted < as well, so no byte is looked at again; a quote that is never closed is a character.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|(?=<)|\Z)")
CLASSES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
TWO_WORDS = re.compile(r"\w\W++\w")
#: Elements below this depth are read as part of the one there, as browsers do.
DEEPEST = 512


def _judged(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role say that an element is unwanted, may be, or is wanted."""
    unwanted = doubtful = wanted = False
    for m in CLASSES.findall(attributes):
        for token in "".join(m).split():
            words = {w.lower() for w in SPLIT.split(token) if w}
            wanted |= bool(words & WANTED)
            if words <= UNWANTED | DOUBTFUL | NEUTRAL:
                unwanted |= bool(words & UNWANTED)
                doubtful |= bool(words & DOUBTFUL)
    return unwanted, doubtful, wanted


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "wanted", "dropped", "doubtful", "points")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.points = 0.0
        self.wanted, self.dropped, self.doubtful = 0, tag in DROPPED, False
        if attributes and not self.dropped and tag not in NEVER_UNWANTED:
            unwanted, self.doubtful, wanted = _judged(attributes)
            self.dropped = unwanted or bool(HIDDEN.search(attributes))
            self.wanted = 25 if wanted else 0
        if tag in ("article", "main"):
            self.wanted = 50


def _marks(html: str):
    """Of a page (text before, tag match or None, CDATA) in order; comments and declarations are passed over."""
    at, start, size = 0, 0, len(html)
    open_cdata = True  # whether a CDATA section may still be closed
    while (at := html.find("<", at)) >= 0:
        after = html[at + 1 : at + 2]
        m, inside = None, ""
        if after.isascii() and after.isalpha() or after == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha():
            m = TAG.match(html, at)
            end = m.end()
        elif html.startswith("!--", at + 1):
            end = html.find("-->", at + 2)
            end = size if end < 0 else end + 3
        elif open_cdata and html.startswith("![CDATA[", at + 1) and (end := html.find("]]>", at)) >= 0:
            inside, end = html[at + 9 : end], end + 3
        elif after in ("!", "?", "/") and after:
            open_cdata = open_cdata and not html.startswith("![CDATA[", at + 1)
            end = html.find(">", at)
            end = size if end < 0 else end + 1
        else:
            at += 1
            continue
        skipped = yield html[start:at], m, inside
        at = start = skipped if skipped is not None else end
    yield html[start:], None, ""


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings, with character references decoded."""
    here = root = Node("#root", None)
    held: Counter = Counter()  # open elements by name, so that an end without a beginning costs nothing

    def leave(up: Node | None) -> Node:
        """up is where to go on: the elements left for it are closed."""
        nonlocal here
        while here is not up:
            held[here.tag] -= 1
            here = here.parent
        return here

    marks, to = _marks(html), None
    while True:
        try:
            text, m, inside = marks.send(to)
        except StopIteration:
            return root
        to = None
        if text:
            here.children.append(references.unescape(text))
        if inside:
            here.children.append(inside)
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if held[tag] > 0:
                leave(_close(here, tag))
            continue
        if tag in CLOSES_P and held["p"] > 0:
            leave(_close_p(here))
        if tag in IMPLIED:
            closed, within = IMPLIED[tag]
            if any(held[t] > 0 for t in closed):
                up = here
                while up.parent is not None and up.tag not in within and up.tag not in closed:
                    up = up.parent
                if up.tag in closed:
                    leave(up.parent)
        node = Node(tag, here, m[3])
        here.children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            if tag not in ("svg", "math", "template", "noscript"):
                end = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(html, m.end())
                to = end.end() if end else len(html)
                continue
        elif tag in VOID:
            continue
        if here.depth < DEEPEST:
            here = node
            held[tag] += 1


def _close_p(here: Node) -> Node:
    up = here
    while up.parent is not None and up.tag != "p":
        if up.tag in SCOPES:
            return here
        up = up.parent
    return up.parent if up.tag == "p" else here


def _close(here: Node, tag: str) -> Node:
    up = here
    while up.parent is not None and up.tag != tag:
        if up.tag in BLOCK and tag not in BLOCK or up.tag in ("table", "article", "main", "body") and tag in ("p", "li", "div", "span"):
            return here
        up = up.parent
    return up.parent if up.parent is not None else here


def _says(text: str) -> bool:
    """Whether a text has a sentence: two words with an end after them."""
    last = max(text.rfind(c) for c in ".!?…。！？")
    return last > 0 and TWO_WORDS.search(text, 0, last) is not None


def _measure(root: Node) -> list[tuple[Node, int, int]]:
    """Every kept element in page order, with the lengths of its text and of its text in links; doubtful ones are decided."""
    seen: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        seen.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    length: dict[int, tuple[int, int]] = {}
    said: set[int] = set()  # elements that hold a sentence
    asked = any(node.doubtful for node in seen)
    for node in reversed(seen):
        n = linked = 0
        sentence, own = False, []
        for c in node.children:
            if isinstance(c, str):
                n += len(c.strip())
                own.append(c)
            elif not c.dropped:
                a, b = length[id(c)]
                n, linked = n + a, linked + b
                sentence = sentence or id(c) in said
                if asked and node.tag in BLOCK:
                    own.append(_inline(c))
        if asked and (sentence or _says("".join(own))):
            said.add(id(node))
        if node.doubtful and (id(node) not in said or 2 * linked >= n):
            node.dropped = True
        length[id(node)] = (n, n if node.tag == "a" else linked)
    gone: set[int] = set()
    out = []
    for node in seen:
        if node.dropped or id(node.parent) in gone:
            gone.add(id(node))
        else:
            out.append((node, *length[id(node)]))
    return out


def best(root: Node) -> list[Node]:
    """The best container, or the article around it, and those of its siblings that belong to it, in page order."""
    measured = _measure(root)
    sizes = {id(node): (n, linked) for node, n, linked in measured}
    scored: set[int] = set()
    for node, n, _ in measured:
        if node.tag not in PARAGRAPHS:
            continue
        own = SPACE.sub(" ", "".join(c if isinstance(c, str) else _inline(c) for c in node.children)).strip()
        if not own:
            continue
        points = min(1.0, len(own) / 25) + own.count(",") + own.count("、") + own.count("，") + min(len(own) / 100, 3.0)
        direct = node.tag in ("p", "pre", "blockquote", "td", "li", "dd", "figcaption") or node.tag[:1] == "h" and node.tag[1:].isdigit()
        up, share = (node.parent if direct else node), 1.0
        depth = 0
        while up is not None and up.tag != "#root" and depth < 8:
            up.points += points * share
            scored.add(id(up))
            depth += 1
            share = 0.5 if depth == 1 else 1 / (3 * depth)
            up = up.parent
    top, most = None, -1.0
    for node, n, linked in measured:
        if id(node) not in scored or node.tag in ("p", "a", "span"):
            continue
        score = (node.points + (node.wanted if node.points else 0)) * (1 - linked / n if n else 0)
        if score > most:
            top, most = node, score
    if top is None:
        return [root]
    if top.parent is None or top.tag in ("body", "html"):
        return [top]
    if top.tag not in ("article", "main"):
        up = top.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        if up is not None:
            return [up]
    # Text and inline elements that follow one another are one sibling.
    groups: list[list] = []
    for c in top.parent.children:
        if groups and not _is_block(c) and not _is_block(groups[-1][-1]):
            groups[-1].append(c)
        else:
            groups.append([c])
    kept = []
    for group in groups:
        measures = [(len(c.strip()), 0) if isinstance(c, str) else sizes.get(id(c), (0, 0)) for c in group]
        n, linked = (sum(x) for x in zip(*measures, strict=True))
        density = linked / n if n else 0
        well = any(isinstance(c, Node) and c.tag == top.tag and id(c) in scored and c.points * (1 - density) >= max(10, 0.2 * most) for c in group)
        if any(c is top for c in group) or well or n and density < 0.25:
            kept += group
    return kept


def _is_block(c) -> bool:
    return isinstance(c, Node) and c.tag in BLOCK


def _inline(node: Node) -> str:
    """The text of an inline element, without blocks in it; nothing of a block."""
    out, stack = [], [node]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif not node.dropped and node.tag not in BLOCK:
            stack.extend(reversed(node.children))
    return "".join(out)


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks of these elements, white space collapsed; a line break counts as white space."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    stack: list = [("open", n) for n in reversed(nodes)]
    while stack:
        what, node = stack.pop()
        if what == "close":
            end()
            continue
        if isinstance(node, str):
            run.append(node)
            continue
        if node.dropped:
            if node.tag in BLOCK:
                end()
            continue
        if node.tag == "br":
            run.append(" ")
            continue
        if node.tag in BLOCK:
            end()
            stack.append(("close", node))
        stack.extend(("open", c) for c in reversed(node.children))
    end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(blocks(best(parse(html))))


def extract(pages: DataFrame) -> DataFrame:
    """Per page its main text and its length in code points.

    A null or empty page, or one without text, has the empty text.  Repeated rows are kept as they are.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                ids, urls, pages_ = (c.to_pylist() for c in b.slice(at, 128).columns)
                texts = [main_text(h) for h in pages_]
                yield as_batch([ids, urls, texts, [len(t) for t in texts]], [pa.int64(), pa.string(), pa.string(), pa.int64()], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
