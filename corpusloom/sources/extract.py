"""Text of documents, by format. Everything here is the standard library; PDF has its own module and path
(``readers.extract_all``), and OCR needs native libraries: its pages are an input."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

from . import formats


class ExtractionError(Exception):
    """code: corrupt, protected or unsupported."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(detail or code)
        self.code = code


@dataclass
class Extraction:
    text: str
    pages_total: int | None = None
    pages_without_text: int | None = None
    page_texts: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


_readers: dict[str, Callable[[bytes], Extraction]] = {}


def register(*extensions: str):
    def add(reader: Callable[[bytes], Extraction]):
        for ext in extensions:
            _readers[ext] = reader
        return reader

    return add


def extract(content: bytes, ext: str) -> Extraction:
    reader = _readers.get(ext)
    if reader is None:
        raise ExtractionError("unsupported", ext)
    if not formats.matches(content, ext):
        raise ExtractionError("corrupt", f"not {ext}")
    return reader(content)


def decode(content: bytes) -> str:
    """UTF-8 if it is; else the likeliest charset, or UTF-8 with replacements."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(content).best()
        if best is not None:
            return str(best)
    except ImportError:
        pass
    return content.decode("utf-8", "replace")


@register("txt", "md")
def read_text(content: bytes) -> Extraction:
    return Extraction(decode(content))


# ------------------------------------------------------------------ HTML

# Elements without text, headings, and elements that end a paragraph.
SKIPPED = frozenset("script style nav header footer noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("p div li section article blockquote pre tr dd dt figcaption table ul ol body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[str] = []
        self.open: list[str] = []
        self.skipping: str | None = None
        self.depth = 0
        self.heading: str | None = None
        self.in_head = False

    def flush(self) -> None:
        lines = (re.sub("[ \t\u00a0]+", " ", line).strip() for line in "".join(self.open).split("\n"))
        self.open.clear()
        paragraph = "\n".join(filter(None, lines))
        if paragraph:
            self.done.append(paragraph)

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            self.depth += tag == self.skipping
        elif tag in SKIPPED:
            self.skipping, self.depth = tag, 1
        elif tag == "head":
            self.in_head = True
        elif self.heading:
            self.open.append(" ")
        elif tag in HEADINGS:
            self.flush()
            self.heading = tag
        elif tag == "br":
            self.open.append("\n")
        elif tag in BLOCKS:
            if tag == "body":
                self.in_head = False
                self.done.clear()
                self.open.clear()
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            self.depth -= tag == self.skipping
            if not self.depth:
                self.skipping = None
        elif tag == "head":
            self.in_head = False
        elif self.heading:
            if tag == self.heading:
                title = re.sub("[ \t\u00a0]+", " ", "".join(self.open)).strip()
                self.open.clear()
                self.heading = None
                if title:
                    self.done.append(title)
            else:
                self.open.append(" ")
        elif tag in ("td", "th"):
            self.open.append(" ")
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skipping:
            self.open.append(data)


def html_to_text(markup: str | None) -> str:
    """Paragraphs joined by a blank line: headings stand alone, cells of a row are parted by a space."""
    parser = _Paragraphs()
    parser.feed(markup or "")
    parser.close()
    parser.flush()
    return "\n\n".join(parser.done)


@register("html")
def read_html(content: bytes) -> Extraction:
    return Extraction(html_to_text(decode(content)))


# ------------------------------------------------------------------ zipped XML

_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_OPF = "{http://www.idpf.org/2007/opf}"
_ENC = "{http://www.w3.org/2001/04/xmlenc#}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ODT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
# Obfuscation of embedded fonts, which protects no text.
FONT_OBFUSCATION = frozenset({"http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"})


def _archive(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ExtractionError("corrupt", str(e)) from e


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(z.read(name))
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile) as e:
        raise ExtractionError("corrupt", f"{name}: {e}") from e


@register("epub")
def read_epub(content: bytes) -> Extraction:
    """Spine items in order; items that are missing are left out; encryption of anything but fonts is protection."""
    with _archive(content) as z:
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names:
            methods = {m.get("Algorithm") for m in _xml(z, "META-INF/encryption.xml").iter(f"{_ENC}EncryptionMethod")}
            if methods - FONT_OBFUSCATION:
                raise ExtractionError("protected")
        root = _xml(z, "META-INF/container.xml").find(f".//{_CONTAINER}rootfile")
        if root is None:
            raise ExtractionError("corrupt", "no rootfile")
        opf = root.get("full-path", "")
        package, folder = _xml(z, opf), opf.rpartition("/")[0]
        hrefs = {i.get("id"): i.get("href", "") for i in package.iter(f"{_OPF}item")}
        parts = []
        for ref in package.iter(f"{_OPF}itemref"):
            href = unquote((hrefs.get(ref.get("idref")) or "").partition("#")[0])
            member = posixpath.normpath(posixpath.join(folder, href)).lstrip("/") if href else ""
            if member in names:
                parts.append(html_to_text(decode(z.read(member))))
        return Extraction("\n\n".join(filter(None, parts)))


@register("docx")
def read_docx(content: bytes) -> Extraction:
    """Paragraphs and tables in order; a table row is its filled cells, parted by spaces, a cell its
    paragraphs on lines of their own."""
    if content[:4] == formats.OLE:
        raise ExtractionError("protected")
    with _archive(content) as z:
        body = _xml(z, "word/document.xml").find(f"{_WORD}body")

    def words(node) -> str:
        marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{_WORD}t" else marks.get(x.tag, "") for x in node.iter()).strip()

    parts = []
    for node in () if body is None else body:
        if node.tag == f"{_WORD}p":
            parts.append(words(node))
        elif node.tag == f"{_WORD}tbl":
            cells = lambda row: ("\n".join(filter(None, map(words, cell.iter(f"{_WORD}p")))) for cell in row.findall(f"{_WORD}tc"))
            rows = (" ".join(filter(None, cells(row))) for row in node.findall(f"{_WORD}tr"))
            parts.append("\n".join(filter(None, rows)))
    return Extraction("\n\n".join(filter(None, parts)))


@register("odt")
def read_odt(content: bytes) -> Extraction:
    """Headings and paragraphs in document order."""
    with _archive(content) as z:
        root = _xml(z, "content.xml")

    def words(node) -> str:
        out = [node.text or ""]
        for child in node:
            if child.tag == f"{_ODT}s":
                out.append(" " * int(child.get(f"{_ODT}c", "1")))
            elif child.tag in (f"{_ODT}tab", f"{_ODT}line-break"):
                out.append("\t" if child.tag == f"{_ODT}tab" else "\n")
            else:
                out.append(words(child))
            out.append(child.tail or "")
        return "".join(out)

    def blocks(node):
        for child in node:
            if child.tag in (f"{_ODT}h", f"{_ODT}p"):
                yield words(child).strip()
            else:
                yield from blocks(child)

    return Extraction("\n\n".join(filter(None, blocks(root))))


# ------------------------------------------------------------------ RTF

# Groups without document text, and control words that stand for characters.
RTF_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr headerf footerl footerr footerf generator themedata colorschememapping latentstyles datastore xmlnstbl listtable listoverridetable rsidtbl".split())
RTF_CHARACTERS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "row": "\n", "tab": "\t", "cell": " ", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


@register("rtf")
def read_rtf(content: bytes) -> Extraction:
    try:
        markup = content.decode("cp1252")
    except UnicodeDecodeError:
        markup = content.decode("latin-1")
    out: list[str] = []
    hidden, skip, stack, to_skip = False, 1, [], 0
    for word, number, code, symbol, brace, text in _RTF.findall(markup):
        if brace == "{":
            stack.append((hidden, skip))
        elif brace == "}":
            if stack:
                hidden, skip = stack.pop()
        elif symbol == "*":
            hidden = True
        elif word:
            word = word.lower()
            if word in RTF_HIDDEN:
                hidden = True
            elif word == "uc":
                skip = int(number or 1)
            elif word == "u" and not hidden:
                out.append(chr(int(number or 63) % 65536))
                to_skip = skip
                continue
            elif word in RTF_CHARACTERS and not hidden:
                out.append(RTF_CHARACTERS[word])
        elif not hidden:
            plain = bytes.fromhex(code).decode("cp1252", "replace") if code else {"~": "\u00a0", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else "") if symbol else text
            if to_skip and plain:
                to_skip, plain = max(0, to_skip - len(plain)), plain[to_skip:]
            out.append(plain)
        if brace or word:
            to_skip = 0
    return Extraction("".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
