"""Readers of local or remote files: one row for each source with its kind, title and pages.

Files are read by Spark's own binary source, so any store that Spark knows will do.  A file
that cannot be read as its kind becomes a row with an error and no pages; it never fails the
job.  Kinds that need a model (audio, video, image) go through a reader that the caller puts in.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import SIZE_ERROR
from marginalia.functions import checks
from marginalia.functions.text import cleaned
from marginalia.sources.pdf import pdf_pages

PAGES = "array<struct<page:int,text:string>>"
TIMES = "array<struct<char_start:int,char_end:int,t_start:double,t_end:double>>"
BOXES = "array<struct<char_start:int,char_end:int,x:double,y:double,w:double,h:double>>"
Pages = list[tuple[int | None, str]]
#: A reader gives pages, or (a recogniser of speech or writing) a dict of pages and where their
#: characters are in time (``times``) or on the picture (``boxes``), rows as in TIMES and BOXES.
Reader = Callable[[bytes], Pages | dict]
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_pages(raw: bytes) -> list[tuple[int | None, str]]:
    """A whole text or Markdown file as one page without a number; bytes that are no UTF-8 are replaced."""
    return [(None, raw.decode("utf-8-sig", errors="replace"))]


def docx_pages(raw: bytes) -> list[tuple[int | None, str]]:
    """Paragraphs of a word-processor file, an empty line between, as one page without a number."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{_WORD}p"):
        parts = []
        for x in p.iter():
            if x.tag == f"{_WORD}t":
                parts.append(x.text or "")
            elif x.tag == f"{_WORD}tab":
                parts.append("\t")
            elif x.tag in (f"{_WORD}br", f"{_WORD}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return [(None, "\n\n".join(out))]


READERS: dict[str, Reader] = {"txt": text_pages, "md": text_pages, "docx": docx_pages, "pdf": pdf_pages}


def read_pages(content: Column, kind: Column, readers: dict[str, Reader] | None = None) -> Column:
    """struct<pages,times,boxes,failed> of raw files; ``readers`` adds or replaces readers by kind."""
    known = READERS | (readers or {})
    span = [("char_start", pa.int32()), ("char_end", pa.int32())]
    places = {"times": ("t_start", "t_end"), "boxes": ("x", "y", "w", "h")}
    kinds_of = {k: [*span, *((c, pa.float64()) for c in names)] for k, names in places.items()}
    schema = pa.struct([("pages", pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))), *((k, pa.list_(pa.struct(f))) for k, f in kinds_of.items()), ("failed", pa.bool_())])

    @F.arrow_udf(f"struct<pages:{PAGES},times:{TIMES},boxes:{BOXES},failed:boolean>")
    def read(contents: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for raw, k in zip(contents, kinds.to_pylist(), strict=True):
            try:
                told = known[k](raw.as_py())
                told = told if isinstance(told, dict) else {"pages": told}
                row = {"pages": [{"page": p, "text": t} for p, t in told["pages"]], "failed": False}
                row |= {c: [dict(zip((n for n, _ in f), x, strict=True)) for x in told.get(c) or ()] for c, f in kinds_of.items()}
                pa.array([row], schema)  # what is no such row fails here
                out.append(row)
            except Exception:  # whatever a file holds, only its own row fails
                out.append({"pages": [], "times": [], "boxes": [], "failed": True})
        return pa.array(out, schema)

    return read(content, kind)


#: Columns of files as Spark's binary source gives them, for streams of files.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, path: str | list[str], readers: dict[str, Reader] | None = None) -> DataFrame:
    """``parsed`` of every file below a path or some paths."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), readers)


def arriving(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None, per_batch: int = 1000) -> DataFrame:
    """``parsed`` of the files that come into a folder, as a stream."""
    return parsed(spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path), readers)


def parsed(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """origin, kind, title, size, modified, content_hash, page_count, pages, times, boxes, error_label of each file.

    Pages are cleaned and empty ones dropped.  A kind without a reader, a file beyond the
    limit of its kind, and one without text (unless a video or image) have an error and no
    pages; too large files are not read.  Files without any byte are not listed by Spark.
    """
    known = files.select(F.col("path").alias("origin"), checks.kind_of(F.col("path")).alias("kind"), checks.title_of(F.col("path")).alias("title"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    fits = F.coalesce(checks.within_limit(F.col("kind"), F.col("size")), F.lit(False))
    read = known.withColumn("fits", fits).withColumn("read", F.when(F.col("fits"), read_pages(F.col("content"), F.col("kind"), readers)))
    clean = F.filter(F.transform("read.pages", lambda p: F.struct(p["page"].alias("page"), cleaned(p["text"]).alias("text"))), lambda p: F.length(p["text"]) > 0)
    failed = F.coalesce(F.col("read.failed"), F.lit(False))
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    places = {c: F.coalesce(F.col(f"read.{c}"), none(kind)) for c, kind in (("times", TIMES), ("boxes", BOXES))}
    listed = read.withColumns({"pages": F.coalesce(F.when(~F.col("read.failed"), clean), none(PAGES)), **places})
    empty = (F.size("pages") == 0) & ~F.coalesce(F.col("kind").isin("video", "image"), F.lit(False))
    error = F.when(F.col("kind").isNotNull() & ~F.col("fits"), SIZE_ERROR).when(F.col("kind").isNull() | failed | empty, checks.error_label(F.lit("parse"), F.col("kind")))
    count = F.when((F.col("kind") == "pdf") & ~failed, F.size("read.pages"))
    return listed.select("origin", "kind", "title", "size", "modified", F.sha2("content", 256).alias("content_hash"), count.alias("page_count"), "pages", "times", "boxes", error.alias("error_label"))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """bytes and files below a folder, listed without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


class _Markdown(HTMLParser):
    """A page's text as Markdown, and its title; scripts, styles and page furniture are left out."""

    # HTML elements.
    SKIPPED = frozenset("script style noscript template svg nav footer aside form button iframe head".split())
    BLOCKS = frozenset("p div section article main header ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6 li figure figcaption".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title, self.in_title, self.skip, self.lists, self.link = "", False, 0, [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in self.SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in self.BLOCKS:
            self.parts.append("\n\n" if tag != "li" else "\n")
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            self.parts.append(f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- ")
        if tag[0] == "h" and tag[1:].isdigit():
            self.parts.append("#" * int(tag[1:]) + " ")
        if tag == "blockquote":
            self.parts.append("> ")
        if tag in ("b", "strong"):
            self.parts.append("**")
        if tag in ("i", "em"):
            self.parts.append("_")
        if tag == "br":
            self.parts.append("\n")
        if tag == "a":
            self.link = dict(attrs).get("href") or ""
            self.parts.append("[" if self.link else "")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("b", "strong"):
            self.parts.append("**")
        if tag in ("i", "em"):
            self.parts.append("_")
        if tag == "a" and self.link:
            self.parts.append(f"]({self.link})")
            self.link = ""
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in self.BLOCKS and tag != "li":
            self.parts.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(re.sub(r"\s+", " ", data))


class _Node:
    """An element of a page: where it is in the source, and what speaks for it being the main content."""

    __slots__ = ("tag", "start", "end", "parent", "kids", "own", "commas", "text", "links", "score")

    def __init__(self, tag: str, start: int, parent: _Node | None):
        self.tag, self.start, self.end, self.parent, self.kids = tag, start, start, parent, []
        self.own = self.commas = self.text = self.links = 0
        self.score = 0.0


class _Tree(HTMLParser):
    """Block elements of a page with the size of their text, its commas and links; skipped elements count nothing."""

    # HTML elements.
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    BLOCKS = _Markdown.BLOCKS | frozenset("body td th tr dl dt dd details address fieldset center".split())

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.root = self.at = _Node("", 0, None)
        self.page, self.nodes, self.skip, self.link = page, [], [], 0
        self.feed(page)
        self.close()
        self.root.end = len(page)
        while self.at is not self.root:
            self._shut(len(page))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, end: int) -> None:
        self.at.end, self.at = end, self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in _Markdown.SKIPPED and tag != "head":
            self.skip.append(tag)
        elif tag == "a":
            self.link += 1
        elif tag in self.BLOCKS and not self.skip:
            at = self._offset()
            if tag in self.BLOCKS and self.at.tag == "p":  # a block ends a paragraph
                self._shut(at)
            if tag == "li" and self.at.tag == "li":
                self._shut(at)
            node = _Node(tag, at, self.at)
            self.at.kids.append(node)
            self.nodes.append(node)
            self.at = node

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in self.BLOCKS and not self.skip:
            node = self.at
            while node is not self.root and node.tag != tag:
                node = node.parent
            if node is not self.root:
                at = self._offset()
                while self.at is not node:
                    self._shut(at)
                close = self.page.find(">", at)
                self._shut(close + 1 if close >= 0 else len(self.page))

    def handle_data(self, data):
        if not self.skip:
            n = len(" ".join(data.split()))
            self.at.own += n
            self.at.commas += data.count(",") + data.count("，")
            self.at.links += n * (self.link > 0)


def main_content(page: str) -> list[str]:
    """The parts of a page's source that hold its main content, in order; all of it if nothing stands out.

    A block with text of its own gives its parent a score that grows with its length and its
    commas, and half of it to its grandparent; an element's score is lessened by the share of
    its text that lies in links.  What scores highest is taken with those of its siblings
    that come near it or are plain paragraphs.
    """
    tree = _Tree(page)
    for node in reversed(tree.nodes):  # children before parents
        node.text += node.own
        node.parent.text += node.text
        node.parent.links += node.links
    for node in tree.nodes:
        if node.own >= 25:
            points = 1 + node.commas + min(node.own // 100, 3)
            node.parent.score += points
            if node.parent.parent is not None:
                node.parent.parent.score += points / 2
    share = lambda n: n.links / n.text if n.text else 1.0
    worth = {n: n.score * (1 - share(n)) for n in tree.nodes if n.score > 0}
    if not worth:
        return [page]
    best = max(worth, key=worth.get)
    least = max(10.0, 0.2 * worth[best])

    def beside(n: _Node) -> bool:
        plain = n.tag == "p" and (n.own > 80 and share(n) < 0.25 or 0 < n.own <= 80 and not n.links and page[n.start : n.end].rstrip("</p> \n").endswith((".", "!", "?")))
        return n is best or worth.get(n, 0) >= least or plain or n.tag in ("h1", "h2", "h3") and n.own > 0 and share(n) < 0.25

    if best.parent is tree.root:
        return [page[best.start : best.end]]
    return [page[n.start : n.end] for n in best.parent.kids if beside(n)]


def markdown(html: Column) -> Column:
    """struct<title,text> of web pages: the main content as Markdown; text null where nothing is left."""

    @F.arrow_udf("struct<title:string,text:string>")
    def converted(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page or "")
            body = re.search(r"(?is)<body\b.*", page or "")
            parts = []
            for part in main_content(body[0] if body else page or ""):
                p = _Markdown()
                p.feed(part)
                p.close()
                parts.append("".join(p.parts))
            text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "\n\n".join(parts))).strip()
            out.append({"title": _unescaped(title[1]) if title else None, "text": text or None})
        return pa.array(out, pa.struct([("title", pa.string()), ("text", pa.string())]))

    return converted(html)


def _unescaped(text: str) -> str:
    import html

    return re.sub(r"\s+", " ", html.unescape(text)).strip()


def web_sources(pages: DataFrame) -> DataFrame:
    """Stored pages (url, html) as sources: origin, title (the address if a page has none), text, error_label."""
    read = pages.select(F.col("url").alias("origin"), markdown(F.col("html")).alias("r"))
    return read.select("origin", F.coalesce(F.nullif("r.title", F.lit("")), "origin").alias("title"), F.col("r.text").alias("text"), F.when(F.col("r.text").isNull(), checks.error_label(F.lit("parse"), F.lit("url"))).alias("error_label"))
