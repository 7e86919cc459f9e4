"""Text of version files with the standard library alone: RTF, DOCX with its tracked changes, and the text layer of simple PDFs."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from dataclasses import dataclass, field
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.IGNORECASE | re.DOTALL)
_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr generator listtable listoverridetable rsidtbl themedata colorschememapping datastore xmlnstbl latentstyles".split())
_MARKS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": "\xa0", "_": "-"}


class ParseError(ValueError):
    """A file can't be read as what its name says."""


def rtf_text(data: bytes) -> str:
    """Plain text of an RTF file: groups of tables and pictures left out, code page 1252 and Unicode escapes decoded."""
    source = data.decode("cp1252", errors="replace")
    if not source.lstrip().startswith("{\\rtf"):
        raise ParseError("no RTF header")
    out: list[str] = []
    groups: list[tuple[bool, int]] = []
    hidden, after, skip = False, 1, 0
    starred = False
    for m in _RTF.finditer(source):
        word, number, code, symbol, brace, char = m.groups()
        if brace == "{":
            groups.append((hidden, after))
            starred = False
        elif brace == "}":
            if groups:
                hidden, after = groups.pop()
            skip = 0
        elif word:
            word = word.lower()
            if starred or word in _SKIPPED:
                hidden = True
            elif word == "uc":
                after = int(number or 1)
            elif word == "u" and number:
                if not hidden:
                    out.append(chr(int(number) % 65536))
                skip = after
            elif word in _MARKS and not hidden:
                out.append(_MARKS[word])
            starred = False
        elif symbol:
            starred = symbol == "*"
            if symbol in "\\{}" and not hidden:
                out.append(symbol)
            elif symbol in _MARKS and not hidden:
                out.append(_MARKS[symbol])
        elif code or char:
            if skip:
                skip -= 1
            elif not hidden:
                out.append(bytes([int(code, 16)]).decode("cp1252", errors="replace") if code else char)
    return "".join(out)


@dataclass
class Docx:
    """Lines with heading levels (0 for none), tracked changes, and the creation date."""

    lines: list[tuple[str, int]] = field(default_factory=list)
    changes: list[dict] = field(default_factory=list)
    created: str | None = None


def docx(data: bytes) -> Docx:
    """Body paragraphs and tables in order; insertions are text and recorded, deletions are recorded alone; cells are parted by bars."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ParseError(f"no DOCX: {e}") from e
    found = Docx()
    if "docProps/core.xml" in archive.namelist():
        made = re.search(rb"<dcterms:created[^>]*>(\d{4}-\d{2}-\d{2})", archive.read("docProps/core.xml"))
        found.created = made[1].decode() if made else None
    at = 0

    def words(node) -> str:
        parts: list[str] = []
        for x in node:
            if x.tag == f"{W}del" or x.tag == f"{W}ins":
                kind = "deletion" if x.tag == f"{W}del" else "insertion"
                text = "".join(t.text or "" for t in x.iter(f"{W}delText" if kind == "deletion" else f"{W}t"))
                if text:
                    found.changes.append({"change_type": kind, "author": x.get(f"{W}author", ""), "date": x.get(f"{W}date"), "text": text, "line": at})
                if kind == "insertion":
                    parts.append(text)
            elif x.tag == f"{W}t":
                parts.append(x.text or "")
            elif x.tag in (f"{W}tab", f"{W}br"):
                parts.append(" ")
            elif x.tag != f"{W}pPr":
                parts.append(words(x))
        return "".join(parts)

    def level(p) -> int:
        style = p.find(f"{W}pPr/{W}pStyle")
        m = re.search(r"(?i)heading\s*(\d)", style.get(f"{W}val", "")) if style is not None else None
        if m:
            return int(m[1])
        outline = p.find(f"{W}pPr/{W}outlineLvl")
        return int(outline.get(f"{W}val")) + 1 if outline is not None else 0

    def blocks(node) -> None:
        nonlocal at
        for x in node:
            if x.tag == f"{W}p":
                text = words(x).strip()
                if text:
                    found.lines.append((text, level(x)))
                    at += 1
            elif x.tag == f"{W}tbl":
                for row in x.iter(f"{W}tr"):
                    cells = [" ".join(filter(None, (words(p).strip() for p in cell.iter(f"{W}p")))) for cell in row.findall(f"{W}tc")]
                    if any(cells):
                        found.lines.append((" | ".join(cells), 0))
                        at += 1
            elif x.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}body"):
                blocks(x)

    blocks(root)
    return found


def accepted(data: bytes) -> bytes:
    """A DOCX with all changes accepted: deletions and comment marks gone, insertions unwrapped."""
    source = zipfile.ZipFile(io.BytesIO(data))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in source.infolist():
            body = source.read(item.filename)
            if item.filename == "word/document.xml":
                root = ElementTree.fromstring(body)
                drop = {f"{W}{t}" for t in ("del", "moveFrom", "commentRangeStart", "commentRangeEnd", "commentReference")}
                for parent in list(root.iter()):
                    kept = []
                    for child in list(parent):
                        if child.tag not in drop:
                            kept += list(child) if child.tag in (f"{W}ins", f"{W}moveTo") else [child]
                    parent[:] = kept
                body = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            target.writestr(item, body)
    return out.getvalue()


_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|Td|TD|Tj|TJ|'|\"|ET")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_pages(data: bytes) -> list[str]:
    """The text that content streams show, a string a stream; files without a text layer give empty ones."""
    if not data.startswith(b"%PDF"):
        raise ParseError("no PDF header")
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.DOTALL):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        out: list[str] = []
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.DOTALL):
            for token in _PDF_TEXT.findall(block):
                if token[:1] == b"(":
                    raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1][:1].isdigit() else _ESCAPES.get(x[1], x[1]), token[1:-1], flags=re.DOTALL)
                    out.append(raw.decode("cp1252", errors="replace"))
                elif token[:1] == b"<":
                    digits = re.sub(rb"\s", b"", token[1:-1])
                    out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", errors="replace"))
                elif token in (b"T*", b"Td", b"TD", b"'", b'"'):
                    out.append("\n")
            out.append("\n")
        pages.append(re.sub(r"\n{2,}", "\n", "".join(out)).strip())
    return pages


def markdown_lines(text: str) -> list[tuple[str, int]]:
    """(line, heading level) without comments, images, separators and emphasis; table rows with bars between cells."""
    out = []
    for raw in re.sub(r"<!--.*?-->", "", text, flags=re.DOTALL).split("\n"):
        line, level = raw.strip(), 0
        if not line or line.startswith("![") or re.fullmatch(r"[|:\-\s]+", line):
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            line, level = m[2], len(m[1])
        elif line.startswith("|"):
            line = " | ".join(c.strip() for c in line.strip("|").split("|"))
        line = re.sub(r"^(?:[-*+]|\d+\\?\.)\s+(?=\S)", lambda m: m[0] if m[0][0].isdigit() else "", line)
        line = re.sub(r"(\*\*|__|`)(.+?)\1", r"\2", line).strip()
        if line:
            out.append((line, level))
    return out
