"""Office documents as rows of page texts, from ``binaryFile`` rows.

DOCX and XLSX are zip archives of XML and are read with the standard library.
A table repeats its header in every line, so that a chunk of it still says what
its numbers mean. PDF needs a backend that the caller passes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from tessella.sources.web import parse_html

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

Page = tuple[int | None, str, bool]
MIN_PAGE_CHARS = 40


def _clean(text: str) -> str:
    return " ".join(text.split())


def _runs(node: ElementTree.Element) -> str:
    return "".join(t.text or "" if t.tag == f"{_W}t" else " " for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))


def _labelled(header: list[str], row: list[str], mark: str) -> str:
    return mark.join(f"{h}: {v}" if h else v for h, v in zip(header + [""] * (len(row) - len(header)), row) if v)


#: Characters below which a page of a PDF is taken for a scan.
LEAST_TEXT = 40


def _clean_lines(text: str) -> str:
    return "\n".join(x for x in map(_clean, text.split("\n")) if x)


def parse_docx(content: bytes) -> list[Page]:
    """One page without number: paragraphs and tables in body order, rows as ``H: v | H: v``, a single row as it is."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines: list[str] = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            lines.append(_clean(_runs(node)))
        elif node.tag == f"{_W}tbl":
            rows = [[_clean(" ".join(_runs(p) for p in cell.iter(f"{_W}p"))) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            rows = [row for row in rows if any(row)]
            if len(rows) == 1:
                lines.append(" | ".join(c for c in rows[0] if c))
            lines += [_labelled(rows[0], row, " | ") for row in rows[1:]]
    text = "\n".join(x for x in lines if x)
    return [(None, text, False)] if text else []


def _number(value: str) -> str:
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def parse_xlsx(content: bytes) -> list[Page]:
    """A page per sheet: the first row with text is the header, others are ``H: v; H: v``; empty rows and sheets go; formulas give their stored value."""
    pages: list[Page] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for number, sheet in enumerate(book.iter(f"{_S}sheet"), 1):
            target = links.get(sheet.get(_R), "")
            target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if target not in names:
                continue
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(target)).iter(f"{_S}row"):
                cells: list[str] = []
                for cell in row.findall(f"{_S}c"):
                    column = 0
                    for c in (cell.get("r") or "").rstrip("0123456789"):
                        column = column * 26 + ord(c.upper()) - 64
                    cells += [""] * (max(column, len(cells) + 1) - 1 - len(cells))
                    value, kind = cell.findtext(f"{_S}v") or "", cell.get("t")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                    elif kind in (None, "n"):
                        value = _number(value)
                    cells.append(_clean(value))
                if any(cells):
                    rows.append(cells)
            lines = [_labelled(rows[0], row, "; ") for row in rows[1:]] if len(rows) > 1 else ["; ".join(c for c in r if c) for r in rows]
            text = "\n".join(x for x in lines if x)
            if text:
                pages.append((number, text, False))
    return pages


Pdf = Callable[[bytes], list[str]]
Ocr = Callable[[bytes, int], str]


def parse_pdf(content: bytes, pdf: Pdf, ocr: Ocr | None = None) -> list[Page]:
    """Pages numbered from 1 with the backend's text; those with hardly any are scans, which ``ocr`` (content, page) reads."""
    pages: list[Page] = []
    for number, raw in enumerate(pdf(content), 1):
        text, scanned = _clean_lines(raw), False
        if len(text) < LEAST_TEXT and ocr is not None:
            text, scanned = _clean_lines(ocr(content, number)), True
        if text:
            pages.append((number, text, scanned))
    return pages


def parse_file(path: str, content: bytes, pdf: Pdf | None = None, ocr: Ocr | None = None) -> tuple[list[Page], str | None]:
    """Pages by suffix, and an error for what can't be read: nothing else stops a batch."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if suffix in ("docx", "xlsx"):
            if not zipfile.is_zipfile(io.BytesIO(content)):
                return [], f"not a {suffix} file"
            return (parse_docx if suffix == "docx" else parse_xlsx)(content), None
        if suffix in ("html", "htm"):
            title, text = parse_html(content.decode("utf-8", "replace"))
            return [(None, f"{title}\n{text}".strip(), False)] if text else [], None
        if suffix == "pdf":
            return ([], "PDF needs a backend") if pdf is None else (parse_pdf(content, pdf, ocr), None)
        return [], f"unsupported: {suffix}"
    except Exception as e:  # a damaged file is a row with an error, not a failed job
        return [], f"{type(e).__name__}: {e}"[:500]


def read_pages(files: DataFrame, pdf: Pdf | None = None, ocr: Ocr | None = None) -> DataFrame:
    """``binaryFile`` rows (``path``, ``content``) as ``path, page, text, ocr, error``; a file without pages has one row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                pages, error = parse_file(path, bytes(content), pdf, ocr)
                rows += [(path, page, text, ocr, None) for page, text, ocr in pages] or [(path, None, None, False, error or "no text")]
            frame = pd.DataFrame(rows, columns=["path", "page", "text", "ocr", "error"])
            frame["page"] = frame["page"].astype("Int32")
            yield frame

    return files.select("path", "content").mapInPandas(parse, "path string, page int, text string, ocr boolean, error string")
