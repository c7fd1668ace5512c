"""Files as DataFrames: any kind by suffix, Markdown headings, HTML pages, Word documents, PDF pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import base_name, file_type, heading_level
from folioscope.operators.blocks import lines


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_name, file_type, content of the files below path; an unknown suffix raises when the row is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", base_name(F.col("path")).alias("doc_name"), file_type(F.col("path")).alias("file_type"), "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_name, text: a document per file."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("doc_name", base_name(F.col("path")))


def markdown_headings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_num, level, title of headings outside fences.

    A line that starts with three backticks, leading white space aside, opens or closes a fence. Headings are one to six #
    and white space; closing # stay in the title. Indented headings count as headings without a level, which have no node.
    """
    by = Window.partitionBy(doc).orderBy("line_num")
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    marked = lines(docs, doc, text).withColumn("bare", bare).withColumn("fences", F.sum(F.when(F.col("bare").startswith("```"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    heads = marked.filter((F.col("fences") % 2 == 0) & ~F.col("bare").startswith("```") & F.col("bare").rlike(r"^#{1,6}\s+.+$"))
    level = F.nullif(F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)), F.lit(0))
    return heads.select(doc, "line_num", level.alias("level"), F.regexp_extract("bare", r"^#{1,6}\s+(.+)$", 1).alias("title"))


def markdown_nodes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, pos, level, title, line_num, end_line: headings with a level and the lines up to the next of them."""
    heads = markdown_headings(docs, doc, text).filter("level IS NOT NULL")
    last = docs.select(doc, F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_n"))
    by = Window.partitionBy(doc).orderBy("line_num")
    return heads.join(last, doc).select(doc, F.row_number().over(by).alias("pos"), "level", "title", "line_num", F.coalesce(F.lead("line_num").over(by) - 1, F.col("_n")).alias("end_line"))


def html_items(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """doc, item_no, kind (heading or text), level, text of h1-h6, p, li and td elements in order, tags and entities undone; raw as it stands."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    pattern = r"(?is)<(h[1-6]|p|li|td|title)\b[^>]*>(.*?)(?=</\1>|<(?:h[1-6]|p|li|td|/ul|/body|/article)\b)"
    tags, texts = F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    plain = F.regexp_replace(F.col("z.t"), r"(?s)<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    rows = pages.select(doc, F.posexplode(F.arrays_zip(tags.alias("g"), texts.alias("t"))).alias("item_no", "z"))
    tag = F.lower("z.g")
    head = tag.rlike("^h[1-6]$")
    return rows.select(doc, (F.col("item_no") + 1).alias("item_no"), F.when(tag == "title", "title").when(head, "heading").otherwise("text").alias("kind"), F.when(head, F.substring(tag, 2, 1).cast("int")).alias("level"), F.regexp_replace(plain, r"(?U)^\s+|\s+$", "").alias("text"), F.col("z.t").alias("raw"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_FIELD = re.compile(r'HYPERLINK\s+"([^"]+)"')


def _paragraph(p: ElementTree.Element, links: dict[str, str]) -> str:
    """Text of runs, links as [text](target), images as ![image]()."""
    out, field, shown, depth = [], None, [], 0
    for e in p.iter():
        if e.tag == f"{_W}fldChar":
            kind = e.get(f"{_W}fldCharType")
            depth += {"begin": 1, "end": -1}.get(kind, 0)
            if kind == "end" and field:
                out.append(f"[{''.join(shown)}]({field})")
                field, shown = None, []
        elif e.tag == f"{_W}instrText" and (m := _FIELD.search(e.text or "")):
            field = m[1]
        elif e.tag == f"{_W}hyperlink" and (target := links.get(e.get(f"{_R}id", ""))):
            text = "".join(t.text or "" for t in e.iter(f"{_W}t"))
            out.append(f"[{text}]({target})")
            for t in e.iter(f"{_W}t"):
                t.text = ""
        elif e.tag == f"{_W}t":
            (shown if field else out).append(e.text or "")
        elif e.tag in (f"{_W}tab", f"{_W}br"):
            out.append("\t" if e.tag.endswith("tab") else "\n")
        elif e.tag.endswith("}blip"):
            out.append("![image]()")
    return "".join(out).strip()


def _table(t: ElementTree.Element, links: dict[str, str]) -> list[list[str]]:
    """Cells; the paragraphs and tables of a cell, each once, parted by spaces."""
    rows = []
    for tr in t.findall(f"{_W}tr"):
        cells = []
        for tc in tr.findall(f"{_W}tc"):
            parts = []
            for e in tc:
                if e.tag == f"{_W}p":
                    parts.append(_paragraph(e, links))
                elif e.tag == f"{_W}tbl":
                    parts.append("\n".join(" | ".join(r) for r in _table(e, links)))
            cells.append(" ".join(dict.fromkeys(x for x in parts if x)))
        rows.append(cells)
    return rows


def docx_items(content: bytes) -> list[tuple[int, str, str, str, str, list[list[str]] | None]]:
    """(item_no, kind, source, style, text, cells) of the body of a Word document; blank paragraphs are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = set(z.namelist())
        rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
        links = {r.get("Id"): r.get("Target") for r in rels}
        styles = {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out = []
    for e in body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            name = styles.get(key) or re.sub(r"(?i)^(heading)(\d)", r"\1 \2", key or "")
            if text := _paragraph(e, links):
                out.append((len(out) + 1, "heading" if re.search(r"(?i)heading\s+\d+", name) else "text", "paragraph", name, text, None))
        elif e.tag == f"{_W}tbl":
            cells = _table(e, links)
            if text := "\n".join(" | ".join(r) for r in cells).strip():
                out.append((len(out) + 1, "text", "table", "", text, cells))
    return out


def word_items(files: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, item_no, kind, source, level, text, cells of Word files (doc, content); a file that cannot be read has an error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, c in zip(f[doc], f["content"], strict=True):
                try:
                    rows += [(d, *x, None) for x in docx_items(c)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((d, 0, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[doc, "item_no", "kind", "source", "style", "text", "cells", "error"])

    kind = files.schema[doc].dataType.simpleString()
    items = files.select(doc, "content").mapInPandas(run, f"{doc} {kind}, item_no int, kind string, source string, style string, text string, cells array<array<string>>, error string")
    return items.withColumn("level", F.when(F.col("kind") == "heading", heading_level(F.col("style")))).drop("style")


def pdf_pages(files: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page_no, text of PDF files (doc, content), by PyMuPDF or pypdf, whichever the executors have; raises without either."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import fitz

            read = lambda c: [p.get_text() for p in fitz.open(stream=c, filetype="pdf")]
        except ImportError:
            try:
                from pypdf import PdfReader
            except ImportError as e:
                raise RuntimeError("reading PDF files needs PyMuPDF or pypdf on the executors") from e
            read = lambda c: [p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages]
        for f in frames:
            rows = [(d, i + 1, t) for d, c in zip(f[doc], f["content"], strict=True) for i, t in enumerate(read(c))]
            yield pd.DataFrame(rows, columns=[doc, "page_no", "text"])

    return files.select(doc, "content").mapInPandas(run, f"{doc} {files.schema[doc].dataType.simpleString()}, page_no int, text string")


def converted(files: DataFrame, command: str = "soffice", timeout_s: int = 120, doc: str = "doc_id") -> DataFrame:
    """Legacy .doc files as .docx content, by an office command on the executors; error holds what went wrong."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess
        import tempfile
        from pathlib import Path

        for f in frames:
            rows = []
            for d, c in zip(f[doc], f["content"], strict=True):
                with tempfile.TemporaryDirectory() as at:  # a task's own scratch space, gone before the row is sent
                    source = Path(at, "in.doc")
                    source.write_bytes(c)
                    try:
                        subprocess.run([command, "--headless", "--convert-to", "docx", "--outdir", at, str(source)], check=True, capture_output=True, timeout=timeout_s)
                        rows.append((d, Path(at, "in.docx").read_bytes(), None))
                    except (OSError, subprocess.SubprocessError) as e:
                        rows.append((d, None, str(e)))
            yield pd.DataFrame(rows, columns=[doc, "content", "error"])

    return files.select(doc, "content").mapInPandas(run, f"{doc} {files.schema[doc].dataType.simpleString()}, content binary, error string")
