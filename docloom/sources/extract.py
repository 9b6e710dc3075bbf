"""Reading files by route: HTML, Markdown, plain text, Word and, where its library is installed, PDF.

Each format becomes (path, title, breadcrumbs, blocks, links, images, error), blocks as the chunker takes them. A file that
can't be read has an ``error`` and no blocks; it doesn't touch other files.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.chunking import BLOCK, text_blocks
from docloom.sources import markdown

LINK = "struct<href:string,text:string>"
IMAGE = "struct<src:string,filename:string,alt:string,title:string>"
#: What every format becomes; ``assets`` are the style sheets and scripts of a page, ``properties`` those of a Word file.
EXTRACTED = f"path string, title string, breadcrumbs array<string>, blocks array<{BLOCK}>, links array<{LINK}>, images array<{IMAGE}>, assets array<string>, properties map<string,string>, error string"
NOTHING = {"title": None, "breadcrumbs": [], "blocks": [], "links": [], "images": [], "assets": [], "properties": {}}
#: Parts of a page that are no content, by tag, class and id; words of links that print or send a page.
CHROME_TAGS = set("script style nav footer iframe object embed form".split())
CHROME_CLASSES = set("footer navigation nav print email printButton emailButton noprint button".split())
CHROME_IDS = set("footer navigation nav".split())
PAGE_TOOLS = ("print", "email", "e-mail")
#: Elements whose text is a block, those that may only hold others, and headings among them.
BLOCK_TAGS = set("h1 h2 h3 h4 p li table div span".split())
CONTAINERS = {"div", "span"}
HEADINGS = set("h1 h2 h3 h4".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements that close an open one of the same kind.
CLOSING = set("p li dt dd tr td th option".split())
#: Elements that close an open paragraph.
CLOSING_P = set("div ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 hr section article form".split())
#: Names of the properties of a Word file.
CORE = {"creator": "author", "category": "category", "description": "comments", "created": "created", "identifier": "identifier", "keywords": "keywords", "language": "language", "lastModifiedBy": "last_modified_by", "modified": "modified", "subject": "subject", "title": "title", "version": "version"}
_SPACE = re.compile(r"[\s\x00-\x1f]+")


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class Node:
    """An element of a page."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attr(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def classes(self) -> set[str]:
        return set(self.attr("class").split())

    def walk(self) -> Iterator[Node]:
        """The elements below, in the order of the page."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, linked: bool = False) -> list[str]:
        """The texts below, in order, without blank ones; with ``linked`` a link is its label and where it leads to."""
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(squeezed(c))
            elif linked and c.tag == "a" and leads(c.attr("href")) and c.text():
                out.append(f"{c.text()} ({c.attr('href')})")
            else:
                stack += reversed(c.children)
        return [x for x in out if x]

    def text(self, linked: bool = False) -> str:
        return " ".join(self.strings(linked))


def leads(href: str) -> bool:
    return bool(href) and not href.startswith(("javascript:", "mailto:"))


class Tree(HTMLParser):
    """A page as nodes; unclosed paragraphs and items end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self._open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSING:
            at = max((i for i, n in enumerate(self._open) if n.tag == tag), default=0)
            if at and not any(n.tag in ("table", "ul", "ol", "dl") for n in self._open[at + 1 :]):
                del self._open[at:]
        elif tag in CLOSING_P:
            at = max((i for i, n in enumerate(self._open) if n.tag == "p"), default=0)
            if at:
                del self._open[at:]
        node = Node(tag, dict(attrs))
        self._open[-1].children.append(node)
        if tag not in VOID:
            self._open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        at = max((i for i, n in enumerate(self._open) if n.tag == tag), default=0)
        if at:
            del self._open[at:]

    def handle_data(self, data):
        self._open[-1].children.append(data)


def is_chrome(node: Node) -> bool:
    """Whether an element serves the page: by tag, class or id, or as a link or button that prints or sends it."""
    if node.tag in CHROME_TAGS or node.classes() & CHROME_CLASSES or node.attr("id") in CHROME_IDS:
        return True
    said = f"{node.text()} {node.attr('value')} {node.attr('href')}".lower() if node.tag in ("a", "button", "input") else ""
    return any(x in said for x in PAGE_TOOLS)


def without_chrome(node: Node) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not is_chrome(c)]
        stack += [c for c in n.children if isinstance(c, Node)]


def block_text(node: Node) -> str:
    """The text of a block: an item with a dash, a table as rows of cells parted by bars."""
    if node.tag == "table":
        rows = [[x for x in (c.text(True) for c in r.walk() if c.tag in ("th", "td")) if x] for r in node.walk() if r.tag == "tr"]
        return "\n".join(" | ".join(r) for r in rows if r)
    text = node.text(True)
    return f"- {text}" if node.tag == "li" else text


def page_blocks(root: Node, title: str | None) -> list[dict]:
    """The blocks of a page below ``root``: first its main heading, then each different text once, under the last heading.

    A ``div`` or ``span`` that directly holds other blocks is none itself. A page without any block but its heading is one
    block of all its text.
    """
    named = next((n for n in root.walk() if n.tag == "p" and "heading1" in n.classes()), None) or next((n for n in root.walk() if n.tag == "h1"), None)
    heading = (named.text() if named is not None else None) or title
    out = [{"text": heading, "heading": heading, "style": "heading 1", "html_tag": None}] if heading else []
    seen: set[str] = set()
    for n in root.walk():
        if n.tag not in BLOCK_TAGS or (n.tag in CONTAINERS and any(isinstance(c, Node) and c.tag in BLOCK_TAGS for c in n.children)):
            continue
        text = block_text(n)
        if not text or text in seen:
            continue
        seen.add(text)
        if n.tag in HEADINGS or "heading1" in {c.lower() for c in n.classes()}:
            heading = text
            out.append({"text": text, "heading": text, "style": n.tag, "html_tag": None})
        else:
            out.append({"text": text, "heading": heading, "style": None, "html_tag": n.tag})
    rest = "\n\n".join(root.strings(True))
    if len(out) <= 1 and rest and rest != heading:
        out.append({"text": rest, "heading": heading, "style": None, "html_tag": "body"})
    return out


def read_html(content: bytes, path: str, main_id: str = "Layer1") -> dict:
    """A page without its chrome, read below ``div#main_id`` if that has any text, else below its body."""
    base, tree = posixpath.basename(path), Tree()
    tree.feed(content.decode("utf-8", errors="replace"))
    tree.close()
    page = tree.root
    first = lambda test: next((n for n in page.walk() if test(n)), None)
    title_node, crumbs = first(lambda n: n.tag == "title"), first(lambda n: n.tag == "div" and "breadcrumbs" in n.classes())
    title = title_node.text() or None if title_node is not None else None
    assets = {urljoin(base, ref) for n in page.walk() for tag, name, end in (("link", "href", ".css"), ("script", "src", ".js")) if n.tag == tag and (ref := n.attr(name)).lower().endswith(end)}
    trail = [x for part in crumbs.strings() for x in re.split(r"\s*[>»|]\s*|\s/\s|^/$", part) if x] if crumbs is not None else []
    without_chrome(page)
    body = first(lambda n: n.tag == "body") or page
    main = next((n for n in body.walk() if n.tag == "div" and n.attr("id") == main_id and n.text()), body)
    blocks = page_blocks(main, title)
    if not blocks and main is not body:
        main, blocks = body, page_blocks(body, title)
    links = {(n.text(), urljoin(base, n.attr("href"))): None for n in main.walk() if n.tag == "a" and leads(n.attr("href"))}
    images: dict[str, dict] = {}
    for n in main.walk():
        if n.tag == "img" and n.attr("src"):
            src = urljoin(base, n.attr("src"))
            images.setdefault(src, {"src": src, "filename": posixpath.basename(src), "alt": squeezed(n.attr("alt")), "title": squeezed(n.attr("title"))})
    return {**NOTHING, "title": title, "breadcrumbs": trail, "blocks": blocks, "links": [{"href": h, "text": t} for t, h in links], "images": list(images.values()), "assets": sorted(assets)}


def read_docx(content: bytes, path: str) -> dict:
    """The paragraphs of the body itself (not those within tables) and the file's core properties."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    blocks = []
    paragraphs = [] if body is None else body.findall(f"{w}p")
    for p in paragraphs:
        text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
        style = p.find(f"{w}pPr/{w}pStyle")
        name = re.sub(r"^heading\s*", "heading ", (style.get(f"{w}val") if style is not None else "") or "", flags=re.I)
        if text:
            blocks.append({"text": text, "heading": text if name.lower().startswith("heading") else None, "style": name or None, "html_tag": None})
    given = {CORE[name]: e.text for e in core if (name := e.tag.rpartition("}")[2]) in CORE and e.text}
    return {**NOTHING, "title": given.get("title"), "blocks": blocks, "properties": {**given, "paragraph_count": str(len(paragraphs))}}


def read_doc(content: bytes, path: str) -> dict:
    text = re.sub(r"[^\S\n]+", " ", "".join(c if c.isprintable() or c == "\n" else "\n" for c in content.decode("latin-1").replace("\r", "\n")))
    lines = [x.strip() for x in text.split("\n")]
    return {**NOTHING, "blocks": [{"text": x, "heading": None, "style": None, "html_tag": None} for x in lines if len(x) > 2]}


def read_pdf(content: bytes, path: str) -> dict:
    from pypdf import PdfReader  # optional

    reader = PdfReader(io.BytesIO(content))
    parts = [p.strip() for page in reader.pages for p in (page.extract_text() or "").split("\n\n")]
    title = (reader.metadata or {}).get("/Title")
    return {**NOTHING, "title": title, "blocks": [{"text": p, "heading": None, "style": None, "html_tag": None} for p in parts if p]}


def read(content: bytes, path: str, route: str) -> dict:
    """One file by its route; the Word route tells old and new files apart by their first bytes."""
    if route == "html":
        return read_html(content, path)
    if route == "pdf":
        return read_pdf(content, path)
    return read_docx(content, path) if content[:2] == b"PK" else read_doc(content, path)


def _parsed(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, route, content in zip(pdf["path"], pdf["route"], pdf["content"]):
                try:
                    rows.append({"path": path, "error": None, **read(bytes(content), path, route)})
                except Exception as e:  # noqa: BLE001 - one file's failure is its own row
                    rows.append({"path": path, **NOTHING, "error": f"{type(e).__name__}: {e}"[:1024]})
            yield pd.DataFrame(rows, columns=["path", *NOTHING, "error"])

    return files.select("path", "route", "content").mapInPandas(run, EXTRACTED)


def decoded(content):
    """Bytes as text: UTF-8, or Latin-1 where that isn't valid."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def extracted(files: DataFrame) -> DataFrame:
    """EXTRACTED of files (path, content, route); routes without text are left out."""
    none = F.lit(None).cast("string")
    rest = [F.array().cast("array<string>").alias("assets"), F.create_map().cast("map<string,string>").alias("properties")]
    plain = files.where("route = 'text' AND NOT lower(path) LIKE '%.md'").select(
        "path", none.alias("title"), F.array().cast("array<string>").alias("breadcrumbs"), text_blocks(decoded(F.col("content"))).alias("blocks"), F.array().cast(f"array<{LINK}>").alias("links"), F.array().cast(f"array<{IMAGE}>").alias("images"), *rest, none.alias("error")
    )
    md = files.where("route = 'text' AND lower(path) LIKE '%.md'").select("path", decoded(F.col("content")).alias("text")).withColumn("fields", markdown.front_matter_fields(F.col("text")))
    stem = F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    md = md.withColumn("title", F.coalesce(F.nullif(T.sanitize(F.get(F.col("fields")["title"], F.lit(0))), F.lit("")), stem))
    md = md.join(markdown.as_chunk_blocks(markdown.block_lists(md, "path"), "path"), "path", "left").select(
        "path", "title", markdown.breadcrumbs(F.col("fields")).alias("breadcrumbs"), F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"), F.array().cast(f"array<{LINK}>").alias("links"), F.array().cast(f"array<{IMAGE}>").alias("images"), *rest, none.alias("error")
    )
    return reduce(DataFrame.unionByName, [plain, md, _parsed(files.where("route IN ('html', 'word', 'pdf')"))])
