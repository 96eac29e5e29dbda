"""Text of office files, by the standard library alone: zipped XML (documents and sheets) and rich text."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

# Names of the formats' XML.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# What elements of a document stand for besides text.
WORD_MARKS = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n", f"{WORD}p": "\n\n"}
# Number formats of sheets that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def load_docx(content: bytes) -> str | None:
    """Headers, body and footers; a paragraph begins with an empty line, tabs and breaks are kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        names = parts.namelist()
        edges = {kind: [n for n in names if re.fullmatch(rf"word/{kind}[0-9]*\.xml", n)] for kind in ("header", "footer")}
        order = [*edges["header"], "word/document.xml", *edges["footer"]]
        text = "".join(_document_text(parts.open(name)) for name in order)
    return text.strip() or None


def _document_text(part: io.IOBase) -> str:
    out: list[str] = []
    for event, element in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            out.append(WORD_MARKS.get(element.tag, ""))
        elif element.tag == f"{WORD}t":
            out.append(element.text or "")
    return "".join(out)


def load_xlsx(content: bytes) -> str | None:
    """Every sheet in order: values of cells that aren't blank, parted by blanks, one row a line; formulas by their stored values."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        names = set(parts.namelist())
        shared = _shared_strings(parts.open("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(parts.open("xl/styles.xml")) if "xl/styles.xml" in names else []
        book = ElementTree.parse(parts.open("xl/workbook.xml")).getroot()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(parts.open("xl/_rels/workbook.xml.rels")).getroot()}
        epoch = datetime.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{SHEET}workbookPr")) else datetime.datetime(1899, 12, 30)
        rows: list[str] = []
        for sheet in book.iter(f"{SHEET}sheet"):
            target = targets[sheet.get(RELATION)]
            with parts.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                rows += (" ".join(cells) for cells in _sheet_rows(part, shared, dates, epoch) if cells)
    return "\n".join(rows) or None


def _shared_strings(part: io.IOBase) -> list[str]:
    """Texts that cells refer to; phonetic hints are no part of them."""
    out = []
    for item in ElementTree.parse(part).getroot().iter(f"{SHEET}si"):
        runs = [item, *item.findall(f"{SHEET}r")]
        out.append("".join(t.text or "" for run in runs for t in run.findall(f"{SHEET}t")))
    return out


def _date_styles(part: io.IOBase) -> list[bool]:
    """Whether each cell style shows a date or time."""
    root = ElementTree.parse(part).getroot()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{SHEET}numFmt")}
    shows = lambda code: re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())) is not None
    styles = root.find(f"{SHEET}cellXfs")
    return [int(x.get("numFmtId", 0)) in DATE_FORMATS or shows(own.get(int(x.get("numFmtId", 0)), "")) for x in (styles if styles is not None else [])]


def _sheet_rows(part: io.IOBase, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> Iterator[list[str]]:
    for _, row in ElementTree.iterparse(part):
        if row.tag == f"{SHEET}row":
            values = (_cell(c, shared, dates, epoch) for c in row.findall(f"{SHEET}c"))
            yield [v for v in values if v.strip()]
            row.clear()


def _cell(cell: ElementTree.Element, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> str:
    kind, style = cell.get("t", "n"), int(cell.get("s", 0))
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    value = cell.findtext(f"{SHEET}v") or ""
    if not value or kind in ("str", "e", "d"):
        return value
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    number = float(value) if re.search(r"[.eE]", value) else int(value)
    if style < len(dates) and dates[style]:
        moment = epoch + datetime.timedelta(milliseconds=round(number * 86_400_000))
        return str(moment.time() if number < 1 else moment)
    return str(number)


# Groups of rich text that hold no text of the document, and what control words stand for.
RTF_SILENT = {
    "fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "footnote", "annotation",
    "generator", "listtable", "listoverridetable", "rsidtbl", "themedata", "colorschememapping", "datastore", "latentstyles", "fldinst", "xmlnstbl", "filetbl", "revtbl", "bkmkstart", "bkmkend",
}
RTF_WORDS = {
    "par": "\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "row": "\n", "cell": "|", "nestcell": "|", "tab": "\t", "emdash": "—", "endash": "–", "emspace": "\u2003", "enspace": "\u2002", "qmspace": "\u2005",
    "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”",
}
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


def load_rtf(content: bytes) -> str | None:
    """Text of a rich text file: its code page and Unicode escapes decoded, groups of settings left out."""
    source = content.decode("latin-1")
    page, out, pending = "cp1252", [], bytearray()
    # State of a group: silent or not, and how many characters stand in for a Unicode one.
    silent, stand_in, skip = False, 1, 0
    groups: list[tuple[bool, int]] = []

    def flush() -> None:
        if pending:
            out.append(bytes(pending).decode(page, "replace"))
            pending.clear()

    for found in _RTF.finditer(source):
        word, number, code, sign, brace, plain = found.groups()
        if brace == "{":
            groups.append((silent, stand_in))
            skip = 0
        elif brace:
            silent, stand_in = groups.pop() if groups else (False, 1)
            skip = 0
        elif code is not None or plain is not None:
            raw = bytes([int(code, 16)]) if code is not None else plain.encode("latin-1")
            raw, skip = raw[skip:], max(0, skip - len(raw))
            if not silent:
                pending += raw
        elif word is not None:
            if word == "ansicpg" and number:
                page = f"cp{number}" if number != "65001" else "utf-8"
            elif word == "uc":
                stand_in = int(number or 1)
            elif word in RTF_SILENT:
                silent = True
            elif not silent and word == "u" and number:
                flush()
                out.append(chr(int(number) % 0x10000))
                skip = stand_in
            elif not silent and word in RTF_WORDS:
                flush()
                out.append(RTF_WORDS[word])
        elif sign == "*":
            silent = True
        elif sign is not None and not silent:
            flush()
            out.append({"~": "\xa0", "-": "", "_": "\u2011", "\n": "\n", "\r": "\n"}.get(sign, sign))
    flush()
    # Pairs of escapes beyond the basic plane become one character.
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text if text.strip() else None
