"""What an audit reads of a page that only a parser finds: one pass of Python over each page.

`extract` gives the columns that rules read; `details` the rows behind them (links, images, assets, alternates, headings,
questions, findings of structured data, the clean text), as arrays to explode.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import url as u
from sitequarry.functions.common import let
from sitequarry.operators.dom import Node, by_path, compiled

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript svg template".split())
#: Elements below this depth are read as part of the one there, as browsers do, so that no walk up costs more.
DEEPEST = 512


# Elements that an opening one ends, where they are the innermost.
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDED = {"li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, **dict.fromkeys(_BLOCKS, {"p"})}
# Link texts that say nothing.
GENERIC = {"click here", "read more", "learn more", "here", "more", "this page", "link", "continue reading", "details", "view more", "go here"}


class Reader(HTMLParser):
    """Counts and texts of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = self.h1 = self.description = self.canonical = self.robots = self.lang = ""
        self.n = dict.fromkeys("title h1 h2 img img_no_alt img_no_size iframe form input_no_label link nofollow empty_anchor table list title_outside description description_outside button_no_name unsized deprecated inline_event blocking tabindex dom max_depth twitter favicon charset refresh iframe_no_title legacy_img long_alt active_http passive_http form_http generic_anchor skip_link zoom_blocked doctype input link_img_no_text".split(), 0)
        self.levels: list[int] = []
        self.ld: list[str] = []
        self.text: list[str] = []
        self.ids: dict[str, int] = {}
        self.viewport = self.og = self.hreflang = 0
        self.languages: list[str] = []
        self.root = self._node = Node("#root", {}, None)
        self._in: list[str] = []
        self._buffer: list[str] = []
        self._anchor: list[str] | None = None

    def handle_decl(self, decl):
        self.n["doctype"] += decl.lower().startswith("doctype")

    def _resources(self, tag, a):
        """What a tag loads or sends over plain HTTP."""
        n = self.n
        source = a.get("src") or ""
        n["active_http"] += tag == "script" and source.startswith("http://") or tag == "link" and a.get("href", "").startswith("http://")
        n["passive_http"] += tag in ("img", "video", "audio", "iframe") and source.startswith("http://")
        n["form_http"] += tag == "form" and a.get("action", "").startswith("http://")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        n = self.n
        self._resources(tag, a)
        while self._in and self._in[-1] in ENDED.get(tag, ()):
            self._in.pop()
            self._node = self._node.parent
        node = Node(tag, a, self._node)
        self._node.children.append(node)
        n["dom"] += 1
        if tag not in VOID and len(self._in) < DEEPEST:
            self._node = node
            self._in.append(tag)
            n["max_depth"] = max(n["max_depth"], len(self._in))
        if "id" in a:
            self.ids[a["id"]] = self.ids.get(a["id"], 0) + 1
        n["inline_event"] += any(k.startswith("on") for k in a)
        n["tabindex"] += a.get("tabindex", "").lstrip("+").isdigit() and int(a["tabindex"]) > 0
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag in ("title", "h1", "h2"):
            n[tag] += 1
            n["title_outside"] += tag == "title" and "head" not in self._in
            self._buffer = []
        elif tag == "img":
            n["img"] += 1
            n["img_no_alt"] += "alt" not in a
            n["img_no_size"] += not (a.get("width") and a.get("height"))
            n["unsized"] += not (a.get("width") and a.get("height")) and "aspect-ratio" not in a.get("style", "")
            n["long_alt"] += len(a.get("alt", "").split()) > 12
            n["legacy_img"] += bool(re.search(r"\.(?:png|jpe?g|gif|bmp)(?:$|[?#])", a.get("src", ""), re.I))
            n["link_img_no_text"] += self._anchor is not None and not a.get("alt")
        elif tag == "a" and "href" in a:
            n["link"] += 1
            n["nofollow"] += any(x in a.get("rel", "") for x in ("nofollow", "sponsored", "ugc"))
            n["skip_link"] += n["link"] == 1 and a["href"].startswith("#")
            self._anchor = [a.get("aria-label", "")]
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name == "description":
                self.description = a.get("content", "")
                n["description"] += 1
                n["description_outside"] += "head" not in self._in
            elif name == "robots":
                self.robots = a.get("content", "").lower()
            self.viewport += name == "viewport"
            self.og += name.startswith("og:")
            n["twitter"] += name.startswith("twitter:")
            n["charset"] += "charset" in a or "charset=" in a.get("content", "").lower()
            n["refresh"] += a.get("http-equiv", "").lower() == "refresh"
            n["zoom_blocked"] += name == "viewport" and bool(re.search(r"user-scalable\s*=\s*(?:no|0)|maximum-scale\s*=\s*1(?:\.0)?\b", a.get("content", "")))
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if rel == "canonical":
                self.canonical = a.get("href", "")
            self.hreflang += "hreflang" in a
            if "hreflang" in a:
                self.languages.append(a["hreflang"].strip())
            n["favicon"] += "icon" in rel.split()
            n["blocking"] += rel == "stylesheet" and a.get("media", "") in ("all", "screen", "") and "head" in self._in and bool(a.get("href"))
        elif tag == "script":
            n["blocking"] += bool(a.get("src")) and "async" not in a and "defer" not in a and a.get("type") != "module" and "head" in self._in
            if a.get("type") == "application/ld+json":
                self.ld.append("")
        elif tag in ("iframe", "form", "table", "input"):
            n[tag] += 1
            n["iframe_no_title"] += tag == "iframe" and not a.get("title")
            n["unsized"] += tag == "iframe" and not (a.get("width") and a.get("height"))
        elif tag in ("ul", "ol"):
            n["list"] += 1
        elif tag in ("font", "center", "marquee", "blink", "strike", "big", "tt"):
            n["deprecated"] += 1
        if re.fullmatch("h[1-6]", tag):
            self.levels.append(int(tag[1]))

    def handle_endtag(self, tag):
        if tag in self._in:
            while self._in:
                self._node = self._node.parent
                if self._in.pop() == tag:
                    break
        if tag in ("title", "h1"):
            text = " ".join("".join(self._buffer).split())
            if not getattr(self, tag):
                setattr(self, tag, text)
        if tag == "a" and self._anchor is not None:
            said = " ".join("".join(self._anchor).split()).lower()
            self.n["empty_anchor"] += not said
            self.n["generic_anchor"] += said in GENERIC
            self._anchor = None

    def handle_data(self, data):
        self._node.children.append(data)
        tag = self._in[-1] if self._in else ""
        if tag == "script" and self.ld and not self.ld[-1]:
            self.ld[-1] = data
        if HIDDEN & set(self._in):
            return
        self._buffer.append(data)
        if self._anchor is not None:
            self._anchor.append(data)
        if "head" not in self._in:
            self.text.append(data)

    def types(self) -> list[str]:
        out = set()
        for block in self.ld:
            try:
                found = json.loads(block)
            except ValueError:
                continue
            stack = [found]
            while stack:
                x = stack.pop()
                if isinstance(x, list):
                    stack.extend(x)
                elif isinstance(x, dict):
                    kind = x.get("@type")
                    out.update([kind] if isinstance(kind, str) else kind or [])
                    stack.extend(x.get("@graph", []))
        return sorted(out)


def read(html: str | None) -> Reader:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return reader


class _After:
    """The elements after one, of the same parent; places among siblings are found once for each parent."""

    def __init__(self):
        self._held: dict[int, tuple[list[Node], dict[int, int]]] = {}

    def __call__(self, node: Node, most: int) -> list[Node]:
        parent = node.parent
        if id(parent) not in self._held:
            siblings = [c for c in parent.children if isinstance(c, Node)]
            self._held[id(parent)] = siblings, {id(c): i for i, c in enumerate(siblings)}
        siblings, places = self._held[id(parent)]
        at = places[id(node)] + 1
        return siblings[at : at + most]


def answer(root: Node) -> str:
    """The first paragraph of 25 to 75 words that stands directly below an h1 or h2, past up to two wrappers; empty if there is none."""
    after = _After()
    for heading in root.walk():
        if heading.tag not in ("h1", "h2"):
            continue
        text, here = "", heading
        for _ in range(3):
            if text or here.parent is None:
                break
            for c in after(here, 3):
                if c.tag in ("h1", "h2", "h3"):
                    break
                first = c if c.tag == "p" else next((x for x in c.walk() if x.tag == "p"), None)
                if first is not None and (text := first.text()):
                    break
            here = here.parent
        if 25 <= len(text.split()) <= 75:
            return text
    return ""


def answer_score(r: Reader) -> int:
    """0 to 100: headings, a paragraph that answers, a table, question schema."""
    kinds = r.types()
    return (
        (15 if r.n["h1"] == 1 else 8 if r.n["h1"] else 0)
        + (10 if r.n["h2"] >= 2 else 5 if r.n["h2"] else 0)
        + (30 if answer(r.root) else 10)
        + (20 if r.n["table"] else 5)
        + (25 if "FAQPage" in kinds else 15 if {"Person", "SoftwareApplication"} & set(kinds) else 0)
    )


def speed_score(counts, ttfb_ms):
    """10 to 100, less for a late first byte, many or deep elements, files that block the first paint, and images and frames without a size."""
    n = lambda name: counts[name]
    minus = (
        F.when(ttfb_ms > 800, 20).when(ttfb_ms > 400, 10).otherwise(0)
        + F.when(n("dom") > 1400, 25).when(n("dom") > 800, 15).otherwise(0)
        + F.when(n("max_depth") > 32, 10).otherwise(0)
        + F.least(F.lit(30), n("blocking") * 8)
        + F.least(F.lit(20), n("unsized") * 4)
    )
    return F.greatest(F.lit(10), F.least(F.lit(100), 100 - minus))


def unlabelled(root: Node) -> tuple[int, int]:
    """Buttons without a name, and fields without a label."""
    said = lambda x: bool(x.attributes.get("aria-label", "").strip() or x.attributes.get("title", "").strip() or x.attributes.get("aria-labelledby"))
    labelled = {x.attributes["for"] for x in root.walk() if x.tag == "label" and "for" in x.attributes}
    buttons = fields = 0
    for x in root.walk():
        kind = x.attributes.get("type", "text").lower()
        if x.tag == "button":
            named = x.text() or any(i.tag == "img" and i.attributes.get("alt") for i in x.walk())
            buttons += not (named or said(x))
        elif x.tag in ("select", "textarea") or x.tag == "input" and kind not in ("hidden", "submit", "button", "reset", "image"):
            fields += not (said(x) or x.attributes.get("id") in labelled or any(p.tag == "label" for p in x.above()))
    return buttons, fields


# What entities of structured data must have to be shown as rich results, and what schema.org asks of them; | stands for any of several.
RICH = {
    "SoftwareApplication": "name offers|review|aggregateRating", "WebApplication": "name offers|review|aggregateRating", "Person": "name", "WebSite": "url name", "Organization": "name",
    "Article": "headline author datePublished", "NewsArticle": "headline author datePublished", "BlogPosting": "headline author datePublished", "Product": "name offers|aggregateRating",
    "Event": "name startDate location", "LocalBusiness": "name address", "HowTo": "step", "Review": "reviewRating author", "VideoObject": "name thumbnailUrl uploadDate",
}
EXPECTED = {
    "SoftwareApplication": "operatingSystem", "WebApplication": "operatingSystem", "Person": "url|@id", "Organization": "url|@id", "Offer": "price priceCurrency|priceSpecification",
    "HowTo": "totalTime|estimatedCost", "Rating": "ratingValue bestRating", "Dataset": "name description",
}
# Properties that must be entities, not plain texts.
STRUCTURED = {"Person": "alumniOf worksFor", "Organization": "contactPoint", "Article": "author", "NewsArticle": "author", "BlogPosting": "author", "Product": "offers"}


def _lacks(node: dict, wanted: str) -> list[str]:
    present = lambda k: node.get(k) not in (None, "", []) or k in ("price", "ratingValue", "bestRating") and node.get(k) == 0
    return [w for w in wanted.split() if not any(present(k) for k in w.split("|"))]


def structured_data(blocks: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(types in order, findings (kind, message)) of JSON-LD blocks; kinds are malformed, rich and schema."""
    types: list[str] = []
    out: list[tuple[str, str]] = []
    for block in blocks:
        if not block.strip():
            continue
        try:
            found = json.loads(block)
        except ValueError as e:
            out.append(("malformed", f"JSON-LD cannot be read: {e}"))
            continue
        context = None
        if isinstance(found, list):
            nodes = found
        elif isinstance(found, dict) and isinstance(found.get("@graph"), list):
            nodes, context = found["@graph"], found.get("@context")
        elif isinstance(found, dict) and found.get("@type"):
            nodes = [found]
        else:
            out.append(("schema", "top level has neither @type nor @graph"))
            continue
        for node in (n for n in nodes if isinstance(n, dict)):
            own = node.get("@context", context)
            if not own or isinstance(own, str) and "schema.org" not in own:
                out.append(("schema", f"context is {own!r}, not schema.org"))
            kinds = node.get("@type")
            if not kinds:
                out.append(("schema", "entity without @type"))
                continue
            kinds = kinds if isinstance(kinds, list) else [kinds]
            types += kinds
            for kind in dict.fromkeys("SoftwareApplication" if k == "WebApplication" else "Article" if k in ("NewsArticle", "BlogPosting") else k for k in kinds):
                out += [("rich", f"{kind} lacks {w}") for w in _lacks(node, RICH.get(kind, ""))]
                out += [("schema", f"{kind} lacks {w}") for w in _lacks(node, EXPECTED.get(kind, ""))]
                out += [("schema", f"{kind}.{w} is a plain text") for w in STRUCTURED.get(kind, "").split() if isinstance(node.get(w), str) and node[w]]
                out += [("rich", x) for x in _members(kind, node)]
    return types, out


def _members(kind: str, node: dict) -> list[str]:
    """What the members of lists of questions and of places lack."""
    name, wanted = {"FAQPage": ("mainEntity", "name"), "BreadcrumbList": ("itemListElement", "position name")}.get(kind, ("", ""))
    if not name:
        return []
    members = node.get(name)
    if not isinstance(members, list):
        return [f"{kind} lacks a list {name}"]
    out = []
    for i, x in enumerate(members):
        x = x if isinstance(x, dict) else {}
        out += [f"{kind} member {i} lacks {w}" for w in _lacks(x, wanted)]
        reply = x.get("acceptedAnswer")
        if kind == "FAQPage" and not (isinstance(reply, dict) and reply.get("text")):
            out.append(f"{kind} member {i} lacks acceptedAnswer.text")
    return out


COLUMNS = [
    ("title", pa.string()), ("h1", pa.string()), ("lang", pa.string()), ("description", pa.string()), ("canonical", pa.string()), ("robots", pa.string()), ("types", pa.list_(pa.string())), ("levels", pa.list_(pa.int32())), ("counts", pa.map_(pa.string(), pa.int64())), ("viewport", pa.int64()), ("og", pa.int64()), ("hreflang", pa.int64()), ("duplicate_ids", pa.int64()), ("n_words", pa.int64()), ("aeo", pa.int64()), ("answer", pa.string()), ("languages", pa.list_(pa.string())), ("schema_types", pa.list_(pa.string())), ("schema_findings", pa.list_(pa.struct([("kind", pa.string()), ("message", pa.string())]))), ("clean", pa.string()),
]
SCHEMA = "page_id long, url string, title string, h1 string, lang string, description string, canonical string, robots string, types array<string>, levels array<int>, counts map<string,bigint>, viewport long, og long, hreflang long, duplicate_ids long, n_words long, aeo long, answer string, languages array<string>, schema_types array<string>, schema_findings array<struct<kind:string,message:string>>, clean string"


def extract(pages: DataFrame) -> DataFrame:
    """One row per page; a null or empty page has empty texts and zero counts."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                piece = b.slice(at, 128)
                rows = []
                for html in piece.column(2).to_pylist():
                    r = read(html)
                    r.n["button_no_name"], r.n["input_no_label"] = unlabelled(r.root)
                    kinds, found = structured_data(r.ld)
                    rows.append((r.title, r.h1, r.lang, r.description, r.canonical, r.robots, r.types(), r.levels, [(k, int(v)) for k, v in r.n.items()], r.viewport, r.og, r.hreflang, sum(v > 1 for v in r.ids.values()), len("".join(r.text).split()), answer_score(r), answer(r.root), r.languages, kinds, [{"kind": k, "message": m} for k, m in found], clean_text(r.root)))
                cols = [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), COLUMNS, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *cols], ["page_id", "url", *[n for n, _ in COLUMNS]])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


CLUTTER = frozenset("script style noscript svg nav header footer iframe template head".split())


def clean_text(root: Node) -> str:
    """The text of the page without scripts, menus, headers, footers and frames."""
    return root.text(CLUTTER, " ")


def questions(root: Node, most: int = 10) -> list[dict]:
    """Questions and answers: of details with a summary, and of headings that end in a question mark with the paragraph after them."""
    out, after = [], _After()
    for x in root.walk():
        if x.tag == "details" and (head := next((c for c in x.walk() if c.tag == "summary"), None)) is not None:
            out.append({"question": head.text(), "answer": x.text(frozenset({"summary"}))})
        elif re.fullmatch("h[2-6]", x.tag) and x.text().endswith("?"):
            following = after(x, 1)
            if following and following[0].tag == "p":
                out.append({"question": x.text(), "answer": following[0].text()})
    return [q for q in out if q["question"] and q["answer"]][:most]


def _number(text: str | None) -> int | None:
    m = re.match(r"\s*(\d+)", text or "")
    return int(m[1]) if m else None


def _details(html: str | None) -> dict:
    root = read(html).root
    base = next((x.attributes.get("href", "") for x in root.walk() if x.tag == "base"), "")
    links, images, assets, alternates, headings = [], [], [], [], []
    silent: dict[int, bool] = {}  # links without a text
    for x in root.walk():
        a = x.attributes
        if x.tag == "a" and a.get("href", "").strip():
            rel = a.get("rel", "").lower()
            links.append({"href": a["href"].strip(), "anchor": x.text(), "rel": rel, "nofollow": any(k in rel for k in ("nofollow", "sponsored", "ugc"))})
        elif x.tag == "img" and (src := a.get("src", "").strip() or a.get("data-src", "").strip()):
            link = next((p for p in x.above() if p.tag == "a"), None)
            if link is not None and id(link) not in silent:
                silent[id(link)] = not link.text()
            images.append({"src": src, "alt": a.get("alt"), "width": _number(a.get("width")), "height": _number(a.get("height")), "in_link": link is not None and silent[id(link)]})
        elif x.tag == "link" and a.get("hreflang", "").strip() and a.get("href", "").strip() and "alternate" in a.get("rel", "").lower().split():
            alternates.append({"lang": a["hreflang"].strip(), "href": a["href"].strip()})
        elif re.fullmatch("h[1-6]", x.tag):
            headings.append({"level": int(x.tag[1]), "text": x.text()})
        kind = {"img": "image", "script": "script", "iframe": "iframe"}.get(x.tag) or ("stylesheet" if x.tag == "link" and "stylesheet" in a.get("rel", "").lower().split() else None)
        source = a.get("href" if kind == "stylesheet" else "src", "").strip()
        if kind and source:
            assets.append({"url": source, "kind": kind})
    return {"base": base, "links": links, "images": images, "assets": assets, "alternates": alternates, "headings": headings, "questions": questions(root), "answer": answer(root), "clean": clean_text(root)}


DETAILS = (
    "base string, links array<struct<href:string,anchor:string,rel:string,nofollow:boolean>>, images array<struct<src:string,alt:string,width:long,height:long,in_link:boolean>>, assets array<struct<url:string,kind:string>>, "
    "alternates array<struct<lang:string,href:string>>, headings array<struct<level:int,text:string>>, questions array<struct<question:string,answer:string>>, answer string, clean string"
)


def details(pages: DataFrame) -> DataFrame:
    """(page_id, url, base, links, images, assets, alternates, headings, questions, answer, clean) of each page; null or empty pages have empty ones."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"page_id long, url string, {DETAILS}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                piece = b.slice(at, 64)
                rows = [_details(x) for x in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *[pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[2:]]], schema=arrow)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


# Schemes that lead to no page.
SKIPPED = "(?i)^(?:javascript|mailto|tel|data|blob|vbscript):"


def _resolved(base, href):
    """u.resolve, bound within a function: where it stands in a filter and in a column, generated code would grow beyond what the JVM takes."""
    return let(F.struct(base.alias("b"), href.alias("h")), lambda x: u.resolve(x["b"], x["h"]))


def _home(url, base):
    """What relative addresses of a page start from."""
    return F.when(base != "", F.coalesce(_resolved(url, base), url)).otherwise(url)


def _same_origin(a, b):
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: u.same_origin(x["a"], x["b"]))


def links(found: DataFrame) -> DataFrame:
    """(page_id, pos, source, target, href, anchor, rel, nofollow, internal) of details, without fragments and schemes that lead to no page."""
    e = found.select("page_id", "url", "base", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", "url", "base", "l.*")
    e = e.where(~F.col("href").startswith("#") & ~F.col("href").rlike(SKIPPED)).withColumn("target", _resolved(_home(F.col("url"), F.col("base")), F.col("href"))).where("target is not null")
    return e.select("page_id", "pos", F.col("url").alias("source"), "target", "href", "anchor", "rel", "nofollow", _same_origin(F.col("url"), F.col("target")).alias("internal"))


def images(found: DataFrame) -> DataFrame:
    """(page_id, pos, url, src, alt, width, height, sized, in_link) of details."""
    e = found.select("page_id", F.col("url").alias("page"), "base", F.posexplode("images").alias("pos", "i")).select("page_id", "pos", "page", "base", "i.*").where(~F.col("src").rlike(SKIPPED))
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    return e.select("page_id", "pos", _resolved(_home(F.col("page"), F.col("base")), F.col("src")).alias("url"), "src", "alt", "width", "height", sized.alias("sized"), "in_link").where("url is not null")


def assets(found: DataFrame) -> DataFrame:
    """(page_id, page, url, kind) of the files of the page's own origin that it loads."""
    e = found.select("page_id", F.col("url").alias("page"), F.explode("assets").alias("a")).where(~F.col("a.url").rlike(SKIPPED))
    return e.select("page_id", "page", _resolved(F.col("page"), F.col("a.url")).alias("url"), "a.kind").where(F.coalesce(_same_origin(F.col("page"), F.col("url")), F.lit(False)))


def verified_assets(found: DataFrame, fetched: DataFrame) -> DataFrame:
    """assets with the status of (url, status), 0 where nothing answered, and whether they are broken."""
    status = fetched.groupBy("url").agg(F.max("status").alias("status"))
    out = found.join(status, "url", "left").withColumn("status", F.coalesce("status", F.lit(0)))
    return out.select("page_id", "page", "url", "kind", "status", ((F.col("status") >= 400) | (F.col("status") == 0)).alias("broken"))


def alternates(found: DataFrame) -> DataFrame:
    """(url, lang, href, target) of details; target is the address in full."""
    e = found.select("url", "base", F.explode("alternates").alias("a"))
    return e.select("url", "a.lang", "a.href", F.coalesce(_resolved(_home(F.col("url"), F.col("base")), F.col("a.href")), F.col("a.href")).alias("target"))


def outline(found: DataFrame) -> DataFrame:
    """(page_id, pos, level, text, skips): headings in order; skips: more than one level below the one before."""
    e = found.select("page_id", "headings", F.posexplode("headings").alias("pos", "h"))
    before = F.when(F.col("pos") > 0, F.get("headings", F.col("pos") - 1)["level"])
    return e.select("page_id", "pos", "h.level", "h.text", F.coalesce(F.col("h.level") > before + 1, F.lit(False)).alias("skips"))


def custom_fields(pages: DataFrame, rules: dict, text: str = "html") -> DataFrame:
    """A column, a list of texts, for each named rule; one that cannot be read gives an empty list.

    A rule is a pattern (its first group, if it has one), or a dict with `type` (regex, css or xpath), `selector`, and, if wanted, `attribute`
    and `all` (true; false keeps the first match).
    """
    out, parsed = pages, {}
    for name, rule in rules.items():
        rule = {"type": "regex", "selector": rule} if isinstance(rule, str) else rule
        empty = F.array().cast("array<string>")
        if rule["type"] != "regex":
            parsed[name] = rule
            continue
        try:
            groups = re.compile(rule["selector"]).groups
            found = F.coalesce(F.regexp_extract_all(text, F.lit(f"(?i){rule['selector']}"), 1 if groups else 0), empty)
        except re.error:
            found = empty
        out = out.withColumn(name, found if rule.get("all", True) else F.slice(found, 1, 1))
    if not parsed:
        return out

    @F.pandas_udf(", ".join(f"`{name}` array<string>" for name in parsed))
    def run(htmls):
        import pandas as pd

        roots = [read(x).root for x in htmls]
        return pd.DataFrame({name: [_selected(r, rule) for r in roots] for name, rule in parsed.items()})

    out = out.withColumn("__parsed", run(F.col(text)))
    return out.withColumns({name: F.col("__parsed")[name] for name in parsed}).drop("__parsed")


def _selected(root: Node, rule: dict) -> list[str]:
    try:
        if rule["type"] == "css":
            test = compiled(rule["selector"])
            found = [x for x in root.walk() if test(x)]
        else:
            found = by_path(root, rule["selector"])
    except (ValueError, KeyError):
        return []
    name = rule.get("attribute")
    texts = [x if isinstance(x, str) else x.attributes.get(name, "") if name else x.text() for x in found]
    texts = [x for x in texts if x]
    return texts if rule.get("all", True) else texts[:1]
