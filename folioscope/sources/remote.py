"""Remote files, attachments, PDF tables and page previews: work with side effects, one request per row, on executors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import header_file_name

#: Seconds that a fetch may take, and dots per inch of a preview.
FETCH_S, PREVIEW_DPI = 60, 144


def fetched(requests: DataFrame, open_url: Callable | None = None, timeout_s: float = FETCH_S) -> DataFrame:
    """requests (task_id, remote_url, headers map) with content, file_name and error.

    The name is that of the Content-Disposition header, else of the URL, else remote-file.bin.
    """

    def get(url: str, headers: dict) -> tuple[bytes, str | None]:
        import urllib.request

        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout_s) as got:
            return got.read(), got.headers.get("Content-Disposition")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for task, url, headers in zip(f["task_id"], f["remote_url"], f["headers"], strict=True):
                try:
                    content, named = (open_url or get)(url, dict(headers or {}))
                    rows.append((task, url, content, named, None))
                except Exception as e:  # noqa: BLE001  whatever the network raises
                    rows.append((task, url, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["task_id", "remote_url", "content", "disposition", "error"])

    got = requests.select("task_id", "remote_url", "headers").mapInPandas(run, "task_id string, remote_url string, content binary, disposition string, error string")
    return got.withColumn("file_name", header_file_name(F.coalesce("disposition", F.lit("")), F.col("remote_url"))).drop("disposition")


def uploaded(files: DataFrame, url: str, send: Callable | None = None, timeout_s: float = FETCH_S) -> DataFrame:
    """files (content, file_name, content_type) with attachment_id; each different content is sent once, null where that fails."""

    def post(name: str, kind: str, content: bytes) -> str | None:
        import urllib.request

        edge = uuid.uuid4().hex
        head = f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: {kind}\r\n\r\n'
        body = head.encode() + content + f"\r\n--{edge}--\r\n".encode()
        ask = urllib.request.Request(url, body, {"Content-Type": f"multipart/form-data; boundary={edge}"})
        with urllib.request.urlopen(ask, timeout=timeout_s) as got:
            return (json.load(got).get("data") or {}).get("uuid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for h, name, kind, content in zip(f["_h"], f["file_name"], f["content_type"], f["content"], strict=True):
                try:
                    rows.append((h, (send or post)(name, kind or "application/octet-stream", content)))
                except Exception:  # noqa: BLE001  a failed upload leaves the image out
                    rows.append((h, None))
            yield pd.DataFrame(rows, columns=["_h", "attachment_id"])

    keyed = files.withColumn("_h", F.sha2("content", 256))
    once = keyed.filter("octet_length(content) > 0").groupBy("_h").agg(F.first("file_name").alias("file_name"), F.first("content_type").alias("content_type"), F.first("content").alias("content"))
    return keyed.join(once.mapInPandas(run, "_h string, attachment_id string"), "_h", "left").drop("_h")


def pdf_tables(files: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page_no, table_index, bbox, page_height, cells of ruled tables in PDF files (doc, content); needs pdfplumber."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("reading PDF tables needs pdfplumber on the executors") from e
        for f in frames:
            rows = []
            for d, content in zip(f[doc], f["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for page in pdf.pages:
                        for i, t in enumerate(page.find_tables({"vertical_strategy": "lines", "horizontal_strategy": "lines"}), 1):
                            rows.append((d, page.page_number, i, [float(x) for x in t.bbox], float(page.height), t.extract()))
            yield pd.DataFrame(rows, columns=[doc, "page_no", "table_index", "bbox", "page_height", "cells"])

    kind = files.schema[doc].dataType.simpleString()
    return files.select(doc, "content").mapInPandas(run, f"{doc} {kind}, page_no int, table_index int, bbox array<double>, page_height double, cells array<array<string>>")


def preferred(first: DataFrame, second: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Tables of the first reader, and of the second for the pages on which the first has none, one for each page there."""
    missing = second.join(first.select(doc, "page_no").distinct(), [doc, "page_no"], "left_anti")
    one = missing.groupBy(doc, "page_no").agg(F.min_by(F.struct(*(c for c in missing.columns if c not in (doc, "page_no"))), "table_index").alias("t"))
    return first.unionByName(one.select(doc, "page_no", "t.*"), allowMissingColumns=True)


def previews(files: DataFrame, dpi: int = PREVIEW_DPI, doc: str = "doc_id") -> DataFrame:
    """doc, page_no, file_name, content_type, content: a PNG of each page of PDF files (doc, doc_name, content); needs PyMuPDF."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import fitz
        except ImportError as e:
            raise RuntimeError("page previews need PyMuPDF on the executors") from e
        for f in frames:
            for d, name, content in zip(f[doc], f["doc_name"], f["content"], strict=True):
                rows = [(d, i + 1, f"{name}-page-{i + 1}.png", "image/png", p.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72)).tobytes("png")) for i, p in enumerate(fitz.open(stream=content, filetype="pdf"))]
                yield pd.DataFrame(rows, columns=[doc, "page_no", "file_name", "content_type", "content"])

    kind = files.schema[doc].dataType.simpleString()
    return files.filter(F.lower("doc_name").endswith(".pdf")).select(doc, "doc_name", "content").mapInPandas(run, f"{doc} {kind}, page_no int, file_name string, content_type string, content binary")
