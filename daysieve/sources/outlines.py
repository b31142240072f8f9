"""Outlines of office documents and PDFs, by the public definitions of the formats (ECMA-376, ISO 32000). A document's bytes are read in a task; all else is expressions (see logs.with_outlines)."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import base_name, extension

MOST_ITEMS, MOST_SLIDES, LONGEST = 10, 40, 60
SUFFIXES = ["docx", "xlsx", "pptx", "pdf"]
#: Headings down to this outline level (from 0) are taken.
DEEPEST = 2

# Namespaces of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DUBLIN_CORE = "{http://purl.org/dc/elements/1.1/}"


def _ended(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """The elements of a tag in a part of a package, one at a time; what was read is let go."""
    if name not in z.namelist():
        return
    with z.open(name) as part:
        for _, element in ET.iterparse(part):
            if element.tag == tag:
                yield element
                element.clear()


def _heading_levels(z: zipfile.ZipFile) -> dict[str, int]:
    """Outline levels of the paragraph styles that have one, by themselves, by a built-in name or through the style that they are based on."""
    own: dict[str, int] = {}
    based: dict[str, str] = {}
    for style in _ended(z, "word/styles.xml", f"{WORD}style"):
        key = style.get(f"{WORD}styleId", "")
        name = (style.find(f"{WORD}name").get(f"{WORD}val", "") if style.find(f"{WORD}name") is not None else "").lower()
        kind, _, number = name.partition(" ")
        level = style.find(f"{WORD}pPr/{WORD}outlineLvl")
        if level is not None:
            own[key] = int(level.get(f"{WORD}val", "9"))
        elif name in ("title", "subtitle"):
            own[key] = 0
        elif kind == "heading" and number.isdigit():
            own[key] = int(number) - 1
        if (parent := style.find(f"{WORD}basedOn")) is not None:
            based[key] = parent.get(f"{WORD}val", "")
    levels = {}
    for key in {*own, *based}:
        at, seen = key, set()
        while at not in own and at in based and at not in seen:
            seen.add(at)
            at = based[at]
        if at in own:
            levels[key] = own[at]
    return levels


def _built_in(style: str) -> int:
    """The level of a style that the document only names: Title, Heading1, or a bare number as some writers use."""
    name = style.lower()
    number = name.removeprefix("heading")
    return 0 if name == "title" else int(number) - 1 if number.isdigit() else 9


def _words(element: ET.Element, tag: str) -> str:
    return " ".join("".join(t.text or "" for t in element.iter(tag)).split())


def _document(z: zipfile.ZipFile) -> tuple[str, list[str]] | None:
    levels, headings, first = _heading_levels(z), [], ""
    for paragraph in _ended(z, "word/document.xml", f"{WORD}p"):
        text = _words(paragraph, f"{WORD}t")
        if not text:
            continue
        style, level = paragraph.find(f"{WORD}pPr/{WORD}pStyle"), paragraph.find(f"{WORD}pPr/{WORD}outlineLvl")
        depth = 9
        if level is not None:
            depth = int(level.get(f"{WORD}val", "9"))
        elif style is not None:
            name = style.get(f"{WORD}val", "")
            depth = levels.get(name, _built_in(name))
        if 0 <= depth <= DEEPEST:
            headings.append(text)
        first = first or text
    return ("headings", headings) if headings else ("title", [first]) if first else None


def _workbook(z: zipfile.ZipFile) -> tuple[str, list[str]] | None:
    names = [sheet.get("name", "") for sheet in _ended(z, "xl/workbook.xml", f"{SHEET}sheet")]
    return ("sheets", names) if names else None


def _presentation(z: zipfile.ZipFile) -> tuple[str, list[str]] | None:
    """Titles in the order that the presentation lists its slides in, which their file names need not follow."""
    main = "ppt/presentation.xml"
    targets = {r.get("Id"): posixpath.normpath(posixpath.join("ppt", r.get("Target", ""))).lstrip("/") for r in _ended(z, "ppt/_rels/presentation.xml.rels", f"{PACKAGE}Relationship")}
    slides = [targets.get(s.get(f"{RELATION}id")) for s in _ended(z, main, f"{SLIDE}sldId")]
    titles = []
    for name in [s for s in slides if s][:MOST_SLIDES]:
        for shape in _ended(z, name, f"{SLIDE}sp"):
            holder = shape.find(f"{SLIDE}nvSpPr/{SLIDE}nvPr/{SLIDE}ph")
            if holder is not None and holder.get("type") in ("title", "ctrTitle"):
                titles += [t] if (t := _words(shape, f"{DRAWING}t")) else []
                break
    return ("slides", titles or [f"{len(slides)} 页"]) if slides else None


def decode_text(raw: bytes) -> str:
    """UTF-16 by its mark, UTF-8 if it is valid, else GB18030."""
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "replace")


_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def pdf_string(data: bytes, at: int) -> bytes | None:
    """The string object that starts at a place: in parentheses, which may nest, with escapes, or hexadecimal in angle brackets."""
    if data[at : at + 1] == b"<" and data[at + 1 : at + 2] != b"<":
        digits = bytes(c for c in data[at + 1 : data.find(b">", at)] if chr(c) in "0123456789abcdefABCDEF")
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if data[at : at + 1] != b"(":
        return None
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i]
        if c == 0x5C and i + 1 < len(data):  # a backslash
            octal = data[i + 1 : i + 4]
            octal = octal[: next((k for k, x in enumerate(octal) if not 0x30 <= x <= 0x37), len(octal))]
            if octal:
                out.append(int(octal, 8) & 255)
                i += 1 + len(octal)
                continue
            if data[i + 1] not in b"\r\n":  # else the line goes on
                out.append(_ESCAPES.get(data[i + 1], data[i + 1]))
            i += 2
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            return bytes(out)
        out.append(c)
        i += 1
    return None


def _pdf(data: bytes) -> tuple[str, list[str]] | None:
    """The title of the information dictionary, else that of the metadata packet."""
    at = data.find(b"/Title")
    while at >= 0:
        start = at + len(b"/Title")
        while data[start : start + 1].isspace():
            start += 1
        raw = pdf_string(data, start)
        if raw and (title := decode_text(raw).strip()):
            return "title", [title]
        at = data.find(b"/Title", start)
    begin, end = data.find(b"<x:xmpmeta"), data.find(b"</x:xmpmeta>")
    if 0 <= begin < end:
        for title in ET.fromstring(data[begin : end + len(b"</x:xmpmeta>")]).iter(f"{DUBLIN_CORE}title"):
            if text := " ".join("".join(title.itertext()).split()):
                return "title", [text]
    return None


def outline_of(suffix: str, data: bytes) -> tuple[str, list[str]] | None:
    """(kind, up to MOST_ITEMS distinct items) of a document's bytes; None if they tell nothing or are broken."""
    try:
        if suffix == "pdf":
            found = _pdf(data)
        else:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                found = {"docx": _document, "xlsx": _workbook, "pptx": _presentation}[suffix](z)
    except (ET.ParseError, KeyError, ValueError, OSError, zipfile.BadZipFile):
        return None
    return found and (found[0], [*dict.fromkeys(x if len(x) <= LONGEST else f"{x[:LONGEST]}…" for x in found[1])][:MOST_ITEMS])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the office documents and PDFs below path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx,pptx,pdf}").load(path)
    return rows.select("path", "content")


def document_outlines(documents: DataFrame) -> DataFrame:
    """(path, outline, outline_kind) of documents (path, content)."""

    @F.pandas_udf("struct<outline_kind: string, outline: array<string>>")
    def read(suffix: pd.Series, data: pd.Series) -> pd.DataFrame:
        found = [outline_of(s, d) or (None, None) for s, d in zip(suffix, data)]
        return pd.DataFrame({"outline_kind": [k for k, _ in found], "outline": [v for _, v in found]})

    suffix = extension(base_name(F.col("path")))
    return documents.where(suffix.isin(SUFFIXES)).select("path", read(suffix, F.col("content")).alias("o")).select("path", "o.outline", "o.outline_kind")
