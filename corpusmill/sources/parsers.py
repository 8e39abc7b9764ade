"""Parsers of file contents with the standard library: HTML, CSV, office files, plain markup and, where a library is missing, simple PDF."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.out.append("\n")
            if tag[0] == "h" and tag[1:].isdigit():
                self.out.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("- ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(content: bytes | str | None) -> str | None:
    """Text of an HTML page with headings and list items as in Markdown; null stays null."""
    if content is None:
        return None
    p = _Text()
    p.feed(content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content)
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return "\n".join(x for x in lines if x)


def _table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table, the first one as its head."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*(c.replace("|", "\\|").replace("\n", " ") for c in r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def csv_text(content: bytes) -> str:
    """A CSV file as a Markdown table."""
    return _table([r for r in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))) if r])


def plain_text(content: bytes) -> str:
    """A text file as it is."""
    return content.decode("utf-8", "replace")


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    """Names of a package's parts that match, by their number."""
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_text(content: bytes) -> str:
    """Paragraphs of a word document, headings by their style as in Markdown, tables as rows."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for p in body.iter():
        if _name(p.tag) != "p":
            continue
        text = "".join(e.text or "" if _name(e.tag) == "t" else "\t" if _name(e.tag) == "tab" else "" for e in p.iter())
        style = next((v for e in p.iter() if _name(e.tag) == "pStyle" for k, v in e.attrib.items() if _name(k) == "val"), "")
        if text.strip():
            level = re.fullmatch(r"[Hh]eading([1-6])", style)
            out.append(("#" * int(level[1]) + " " if level else "") + text.strip())
    return "\n\n".join(out)


def pptx_text(content: bytes) -> str:
    """Paragraphs of a presentation, slide by slide."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in _parts(z, r"ppt/slides/slide(\d+)\.xml"):
            lines = ["".join(e.text or "" for e in p.iter() if _name(e.tag) == "t").strip() for p in ElementTree.fromstring(z.read(name)).iter() if _name(p.tag) == "p"]
            out.append("\n".join(x for x in lines if x))
    return "\n\n".join(x for x in out if x)


def xlsx_text(content: bytes) -> str:
    """The sheets of a workbook as Markdown tables."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(e.text or "" for e in s.iter() if _name(e.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _name(s.tag) == "si"]
        for name in _parts(z, r"xl/worksheets/sheet(\d+)\.xml"):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _name(e.tag) == "row"):
                cells = []
                for c in row:
                    value = "".join(e.text or "" for e in c.iter() if _name(e.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if any(cells):
                    rows.append(cells)
            out.append(_table(rows))
    return "\n\n".join(x for x in out if x)


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\bT(?:\*|[dDm]\b)|'|\bET\b", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _unescaped(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.DOTALL).decode("latin-1")


def pdf_text(content: bytes) -> str:
    """Text of a PDF: by the Markdown library for PDF where it is installed, else the strings its page streams show.

    Without the library only uncompressed and deflated streams with single-byte fonts are read; a file that shows no text is an error.
    """
    try:
        import pymupdf
        import pymupdf4llm
    except ImportError:
        pass
    else:
        return pymupdf4llm.to_markdown(pymupdf.open(stream=content, filetype="pdf"))
    out = []
    for m in _STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        page = []
        for s in _SHOWN.findall(data):
            if s[:1] == b"(":
                page.append(_unescaped(s))
            elif s[:1] == b"<":
                page.append(bytes.fromhex(re.sub(rb"\s", b"", s[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", s[1:-1])) % 2)).decode("latin-1"))
            else:
                page.append("\n")
        lines = ["".join(c for c in x if c.isprintable()).strip() for x in "".join(page).split("\n")]
        out.append("\n".join(x for x in lines if x))
    text = "\n\n".join(x for x in out if x)
    if not text:
        raise ValueError("the file shows no text")
    return text


# by extension
OFFICE = {
    ".pdf": pdf_text, ".docx": docx_text, ".xlsx": xlsx_text, ".pptx": pptx_text, ".html": html_text, ".xhtml": html_text, ".csv": csv_text,
    ".adoc": plain_text, ".asciidoc": plain_text,
}


def office_text(content: bytes, extension: str) -> str | None:
    """Text of a file of many formats; an image, which needs a recogniser, is an error."""
    if extension not in OFFICE:
        raise ValueError(f"no reader of {extension} files is installed")
    return OFFICE[extension](content)
