"""Files of a folder into pages of blocks: text, Markdown, HTML, DOCX, RTF, EPUB. PDF needs a reader that is plugged in."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.passages import Block, _Outline, markdown_blocks
from tessera.sources import html

MAX_BYTES = 512 << 20
Pages = list[tuple[int, list[Block]]]
# Kinds by file name.
KINDS = {"pdf": "pdf", "docx": "docx", "rtf": "rtf", "epub": "epub", "html": "html", "htm": "html", "xhtml": "html", "md": "text", "markdown": "text", "txt": "text", "text": "text"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def kind_of(path: Column, content: Column) -> Column:
    """By the name's ending, else by the first bytes; null where neither tells."""
    ending = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    named = F.coalesce(*[F.when(ending == e, F.lit(k)) for e, k in KINDS.items()])
    head = F.hex(F.substring(content, 1, 5))
    magic = F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "docx").when(head.startswith("7B5C727466"), "rtf")
    return F.coalesce(named, magic)


def decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def read_text(raw: bytes) -> Pages:
    return [(0, markdown_blocks(decoded(raw)))]


def read_html(raw: bytes) -> Pages:
    return [(0, html.extract(decoded(raw)).blocks)]


def read_docx(raw: bytes) -> Pages:
    """Headings by style or outline level, list items, paragraphs, then tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    value = lambda e, path: found.get(f"{_W}val") if (found := e.find(path)) is not None else None
    out, tables, outline = [], [], _Outline()
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            rows = [" | ".join(filter(None, (words(c) for c in r.iter(f"{_W}tc")))) for r in e.iter(f"{_W}tr")]
            tables.append("\n".join(filter(None, rows)))
        elif e.tag == f"{_W}p" and (text := words(e)):
            style = (value(e, f"{_W}pPr/{_W}pStyle") or "").lower()
            level = value(e, f"{_W}pPr/{_W}outlineLvl")
            depth = int(level) + 1 if level else 1 if style == "title" else int(m[1]) if (m := re.fullmatch(r"heading\s*(\d)", style)) else 0
            if not out and not depth and value(e, f"{_W}pPr/{_W}jc") == "center":
                depth = 1
            if depth:
                out.append(Block("heading", text, depth, outline.enter(depth, text)))
            else:
                listed = e.find(f"{_W}pPr/{_W}numPr") is not None
                out.append(Block("list_item" if listed else "paragraph", text, 0, outline.path))
    return [(0, out + [Block("table", t, 0, outline.path) for t in tables if t])]


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)
_RTF_AWAY = frozenset("fonttbl colortbl stylesheet info pict header footer footnote themedata generator listtable".split())


def read_rtf(raw: bytes) -> Pages:
    """Text of the control stream: groups for fonts, pictures and the like are passed over."""
    out, stack, away, skip = [], [], False, 0
    for word, number, code, sign, brace, text in _RTF.findall(raw.decode("latin-1")):
        if brace == "{":
            stack.append(away)
        elif brace == "}":
            away = stack.pop() if stack else False
        elif word in _RTF_AWAY or sign == "*":
            away = True
        elif not away:
            if word in ("par", "line", "page"):
                out.append("\n\n" if word == "par" else "\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u":
                out.append(chr(int(number) % 65536))
                skip = 1
            elif code:
                out.append("" if skip else bytes.fromhex(code).decode("cp1252", "replace"))
                skip = 0
            elif sign in ("\\", "{", "}", "~"):
                out.append(" " if sign == "~" else sign)
            elif text:
                out.append(text[skip:])
                skip = 0
    return [(0, markdown_blocks("".join(out)))]


def read_epub(raw: bytes) -> Pages:
    """Chapters in the package's spine order, or else by name; a chapter is a page."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = book.namelist()
    order = sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
    if package := next((n for n in names if n.endswith(".opf")), None):
        root = ElementTree.fromstring(book.read(package))
        items = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), e.get("href", ""))) for e in root.iter() if e.tag.endswith("}item")}
        spine = [items[e.get("idref")] for e in root.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        order = [n for n in spine if n in names] or order
    return [(i, html.extract(decoded(book.read(n)), 0).blocks) for i, n in enumerate(order, 1)]


READERS: dict[str, Callable[[bytes], Pages]] = {"text": read_text, "html": read_html, "docx": read_docx, "rtf": read_rtf, "epub": read_epub}
SCHEMA = "path string, kind string, error string, blocks array<struct<page:int,kind:string,text:string,level:int,heading_path:string>>"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, length, content) of the files that have a known kind, hidden ones left out."""
    return known(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def known(files: DataFrame) -> DataFrame:
    """The files (path, length, content) that have a known kind, hidden ones left out."""
    shown = files.where(~F.col("path").rlike("/\\.[^/]*(/|$)"))
    return shown.select("path", kind_of(F.col("path"), F.col("content")).alias("kind"), "length", "content").where("kind is not null")


def read(files: DataFrame, readers: dict[str, Callable[[bytes], Pages]] | None = None) -> DataFrame:
    """Blocks of each file, or the error that it gave: empty, too large, no reader, unreadable."""
    known = READERS | (readers or {})
    kind = pa.list_(pa.struct([("page", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("heading_path", pa.string())]))

    def one(name: str, content: bytes | None) -> tuple[str | None, list[dict]]:
        if not content:
            return "empty file", []
        if name not in known:
            return f"no reader for {name}", []
        try:
            return None, [{"page": n, **vars(b)} for n, blocks in known[name](content) for b in blocks]
        except Exception as e:  # noqa: BLE001 - a broken file is a row with an error, not a failed job
            return f"unreadable: {type(e).__name__}", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                error, blocks = one(row.column("kind")[0].as_py(), row.column("content")[0].as_py())
                yield pa.RecordBatch.from_arrays([row.column("path"), row.column("kind"), pa.array([error], pa.string()), pa.array([blocks], kind)], names=["path", "kind", "error", "blocks"])

    small = files.where(F.col("length") <= MAX_BYTES).select("path", "kind", "content").mapInArrow(run, SCHEMA)
    large = files.where(F.col("length") > MAX_BYTES).select("path", "kind", F.lit("larger than 512 MB").alias("error"), F.array().cast(small.schema["blocks"].dataType).alias("blocks"))
    return small.unionByName(large)
