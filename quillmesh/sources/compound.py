"""Text of files kept in compound storage: mail messages (.msg) and binary sheets (.xls), by the standard library alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# The storage's signature, and sector numbers that end a chain or name nothing.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST = 0xFFFFFFFA


class Storage:
    """Reads the streams on the top level of a compound file. Chains that run in a circle or out of the file are errors."""

    def __init__(self, content: bytes):
        if content[:8] != SIGNATURE:
            raise ValueError("no compound storage")
        self.content = content
        self.size, self.small = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
        directory, self.cutoff, small_table, _, more, _ = struct.unpack_from("<I4xIIIII", content, 48)
        table = list(struct.unpack_from("<109I", content, 76))
        while more < LAST:  # where further parts of the table are listed
            part = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            table += part[:-1]
            more = part[-1]
        self.next = [n for at in table if at < LAST for n in struct.unpack(f"<{self.size // 4}I", self._sector(at))]
        entries = self._chain(directory)
        self.entries = [entries[k : k + 128] for k in range(0, len(entries) - 127, 128)]
        self.small_next = [n for (n,) in struct.iter_unpack("<I", self._chain(small_table))] if small_table < LAST else []
        start, length = struct.unpack_from("<IQ", self.entries[0], 116)
        self.small_sectors = self._chain(start)[:length] if start < LAST else b""

    def _sector(self, number: int) -> bytes:
        found = self.content[(number + 1) * self.size : (number + 2) * self.size]
        if not found:
            raise ValueError("sector beyond the file")
        return found.ljust(self.size, b"\0")

    def _numbers(self, start: int, following: list[int]) -> Iterator[int]:
        seen = 0
        while start < LAST:
            if seen > len(following) or start >= len(following):
                raise ValueError("broken chain")
            yield start
            start, seen = following[start], seen + 1

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._numbers(start, self.next)))

    def streams(self) -> dict[str, bytes]:
        """Name -> content of the streams right below the root."""
        found, waiting, seen = {}, [struct.unpack_from("<I", self.entries[0], 76)[0]], set()
        while waiting:
            at = waiting.pop()
            if at >= len(self.entries) or at in seen:
                continue
            seen.add(at)
            entry = self.entries[at]
            length, kind, left, right = struct.unpack_from("<HBxII", entry, 64)
            waiting += [left, right]
            if kind == 2:
                start, size = struct.unpack_from("<IQ", entry, 116)
                size &= 0xFFFFFFFF
                if size < self.cutoff:
                    small = self.small
                    data = b"".join(self.small_sectors[n * small : (n + 1) * small] for n in self._numbers(start, self.small_next)) if size else b""
                else:
                    data = self._chain(start)
                found[entry[: max(length - 2, 0)].decode("utf-16-le")] = data[:size]
        return found


# Streams of a message that hold its subject and text, as Unicode and as bytes.
SUBJECT, BODY = "0037", "1000"


def load_msg(content: bytes) -> str | None:
    """Subject and text of a stored mail message, one below the other."""
    streams = Storage(content).streams()

    def value(name: str) -> str:
        if (wide := streams.get(f"__substg1.0_{name}001F")) is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        return streams.get(f"__substg1.0_{name}001E", b"").decode("cp1252", "replace").rstrip("\0")

    subject, body = value(SUBJECT), value(BODY)
    parts = [f"Subject: {subject}"] * bool(subject) + [body] * bool(body)
    return "\n".join(parts) or None


# Kinds of records in a binary sheet.
SHEET, SHARED, CONTINUED, END, PASSWORD = 0x85, 0xFC, 0x3C, 0x0A, 0x2F
NUMBER, SHORT, SHORTS, TEXT, RICH, SHARED_TEXT, FORMULA, RESULT, TRUTH = 0x203, 0x27E, 0xBD, 0x204, 0xD6, 0xFD, 0x06, 0x207, 0x205


def load_xls(content: bytes) -> str | None:
    """Every sheet in order: values of cells that aren't blank, parted by blanks, one row a line; numbers as decimals, truth values and errors by number."""
    streams = Storage(content).streams()
    book = streams.get("Workbook", streams.get("Book"))
    if book is None:
        raise ValueError("no sheets")
    sheets, shared, parts = [], [], []
    for kind, record, _ in _records(book, 0):
        if kind == PASSWORD:
            raise ValueError("encrypted")
        if kind == SHEET and record[5] == 0:
            sheets.append(struct.unpack_from("<I", record)[0])
        if kind == SHARED:
            parts = [record]
        elif kind == CONTINUED and parts:
            parts.append(record)
        elif parts:
            shared, parts = _shared_texts(parts), []
    shared = _shared_texts(parts) if parts else shared
    rows = [line for at in sheets for line in _lines(book, at, shared)]
    return "\n".join(rows) or None


def _records(book: bytes, at: int) -> Iterator[tuple[int, bytes, int]]:
    """(kind, content, version of the book) of the records from an offset to the end of their part."""
    version = 0x600
    while at + 4 <= len(book):
        kind, length = struct.unpack_from("<HH", book, at)
        record = book[at + 4 : at + 4 + length]
        if kind == 0x809 and length >= 2:
            version = struct.unpack_from("<H", record)[0]
        yield kind, record, version
        if kind == END:
            return
        at += 4 + length


def _shared_texts(parts: list[bytes]) -> list[str]:
    """The table of texts; one may go on in the next record, which then says anew how wide its characters are."""
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        out = b""
        while len(out) < n and part < len(parts):
            piece = parts[part][at : at + n - len(out)]
            out, at = out + piece, at + len(piece)
            if len(out) < n:
                part, at = part + 1, 0
        return out

    def characters(n: int, wide: int) -> str:
        nonlocal part, at
        out = ""
        while n > 0 and part < len(parts):
            if at >= len(parts[part]):
                part, at = part + 1, 0
                wide, at = (parts[part][0] & 1 if part < len(parts) and parts[part] else 0), 1
                continue
            piece = parts[part][at : at + n * (1 + wide)]
            out += piece.decode("utf-16-le" if wide else "latin-1", "surrogatepass" if wide else "strict")
            n, at = n - len(piece) // (1 + wide), at + len(piece)
        return out

    found = []
    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        head = take(3)
        if len(head) < 3:
            break
        length, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        found.append(characters(length, flags & 1))
        take(4 * runs + extra)
    return found


def _short_number(value: int) -> float:
    """A number in four bytes: an integer or the upper half of a double, perhaps in hundredths."""
    number = float(value >> 2 if value < 1 << 31 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & ~3) << 32))[0]
    return number / 100 if value & 1 else number


def _text(record: bytes, at: int, version: int) -> str:
    (length,) = struct.unpack_from("<H", record, at)
    if version < 0x600:
        return record[at + 2 : at + 2 + length].decode("cp1252", "replace")
    wide = record[at + 2] & 1
    return record[at + 3 : at + 3 + length * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")


def _lines(book: bytes, at: int, shared: list[str]) -> list[str]:
    rows: dict[int, dict[int, str]] = {}
    formula: tuple[int, int] | None = None
    for kind, record, version in _records(book, at):
        if kind == RESULT and formula:
            rows.setdefault(formula[0], {})[formula[1]] = _text(record, 0, version)
            formula = None
        if kind not in (NUMBER, SHORT, SHORTS, TEXT, RICH, SHARED_TEXT, FORMULA, TRUTH):
            continue
        row, column = struct.unpack_from("<HH", record)
        cells = rows.setdefault(row, {})
        if kind == NUMBER:
            cells[column] = str(struct.unpack_from("<d", record, 6)[0])
        elif kind == SHORT:
            cells[column] = str(_short_number(struct.unpack_from("<I", record, 6)[0]))
        elif kind == SHORTS:
            for k, (_, value) in enumerate(struct.iter_unpack("<HI", record[4:-2])):
                cells[column + k] = str(_short_number(value))
        elif kind == SHARED_TEXT:
            cells[column] = shared[struct.unpack_from("<I", record, 6)[0]]
        elif kind == TRUTH:
            cells[column] = str(record[6])
        elif kind in (TEXT, RICH):
            cells[column] = _text(record, 6, version)
        elif record[12:14] != b"\xff\xff":
            cells[column] = str(struct.unpack_from("<d", record, 6)[0])
        elif record[6] == 0:
            formula = (row, column)  # its text follows
        elif record[6] in (1, 2):
            cells[column] = str(record[8])
    kept = ([value for _, value in sorted(cells.items()) if value.strip()] for _, cells in sorted(rows.items()))
    return [" ".join(values) for values in kept if values]
