"""Problem 2: find text decoded with the wrong encoding and restore it.

Method: the garbled sequences of all encoding pairs are precomputed and matched
with one multi-pattern automaton; only matched spans are replaced. Its patterns
are what UTF-8 read as a single-byte encoding makes of an alphabet of written
characters (once and twice garbled, two characters and more), and what each pair
of single-byte encodings makes of a byte (one character for another). Each
pattern knows the pairs it belongs to and what was written.

Sequences of two or more characters are replaced where they match. Where one byte
became one other character the same character may be ordinary writing, so the
spans of a word are replaced only if that removes breaks no writing has (letters
of two scripts in one word, a capital after a small letter, symbols or control
characters inside a word, digits against accented letters). Words that read
naturally either way follow the words around them, so a stretch is restored as a
stretch and correct text between is left alone.

Defined results: null, empty and plain ASCII texts are never garbled; a
replacement character (U+FFFD) marks a text as garbled that cannot be restored
there; line ends and blanks stay as they are, so line numbers hold.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accented letters of German, French, Spanish, Portuguese and Polish.
SMALL = set("äöüßàâçéèêëîïôœùûáíñóúãõąćęłńśźż")
LARGE = set("ÄÖÜÀÂÇÉÈÊËÎÏÔŒÙÛÁÍÑÓÚÃÕĄĆĘŁŃŚŹŻ")
CYRILLIC = set(map(chr, range(0x410, 0x450))) | set("ёЁ")
GREEK = set("αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ")
#: Symbols and marks of ordinary writing.
MARKS = set("¡¿§°±£€©½¼¾«»“”‘’„–—…·•®™²³ªº№µ\xa0\xad‐×")
#: Letters that stand alone as words.
LONE = set("àÀáÁéÉêÊóÓíúôœвВсСиИоОкКуУаАяЯέΈήΉηΗοΟόΌ")

#: Encodings a text may have been written in, and read in by mistake.
WRITTEN = ["cp1252", "mac_roman", "iso8859-15", "cp1250", "iso8859-2", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7"]
READ = ["cp1252", "latin-1", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-7", "iso8859-15"]
#: Multi-byte encodings in which UTF-8 bytes happen to be valid.
READ_WIDE = ["gbk", "shift_jis", "big5", "euc_kr"]

_SPACES = re.compile(r"([ \t\r\n\f]+)")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,9}|#\d{2,5}|#x[0-9A-Fa-f]{2,4});")


@lru_cache(maxsize=None)
def _upper_half(encoding: str) -> tuple[str, ...]:
    """The characters of bytes 128..255; an undefined byte is read as the control character of its number."""
    out = []
    for byte in range(128, 256):
        try:
            out.append(bytes([byte]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return tuple(out)


@lru_cache(maxsize=1)
def pairs() -> list[tuple[str, str]]:
    """(written in, read in) of every pair of encodings; UTF-8 is written first, in the order of READ."""
    return [("utf-8", read) for read in READ] + [(written, read) for written in WRITTEN for read in READ if written != read and _upper_half(written) != _upper_half(read)]


@lru_cache(maxsize=1)
def garbled_sequences() -> dict[str, dict[int, str]]:
    """Garbled sequence -> {number of the pair: what was written} over all pairs."""
    found: dict[str, dict[int, str]] = {}
    written_characters = sorted(SMALL | LARGE | CYRILLIC | GREEK | MARKS)
    for number, (written, read) in enumerate(pairs()):
        half = _upper_half(read)
        if written == "utf-8":
            wrong = lambda s, half=half: "".join(half[b - 128] if b > 127 else chr(b) for b in s.encode())
            for c in written_characters:
                once = wrong(c)
                for sequence in (once, wrong(once)):
                    if len(sequence) > 1:
                        found.setdefault(sequence, {}).setdefault(number, c)
        else:
            for r, w in zip(half, _upper_half(written)):
                if r != w:
                    found.setdefault(r, {})[number] = w
    return found


@lru_cache(maxsize=1)
def _automaton():
    """The garbled sequences as patterns: (length, {pair: written}, whether it could be writing)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for sequence, by_pair in garbled_sequences().items():
        machine.add_word(sequence, (len(sequence), by_pair, _weak(sequence)))
    machine.make_automaton()
    return machine


def _matches(word: str) -> tuple[dict[int, list[tuple[int, dict[int, str], bool]]], list[tuple[int, dict[int, str]]]]:
    """Matched spans of a word: those of several characters by their start, and (place, {pair: written}) of single ones."""
    several: dict[int, list] = {}
    single = []
    for end, hit in _automaton().iter(word):
        if hit[0] > 1:
            several.setdefault(end - hit[0] + 1, []).append(hit)
        else:
            single.append((end, hit[1]))
    return several, single


def _exchanged(word: str, single: list[tuple[int, dict[int, str]]], pair: int) -> str:
    """A word with the matched spans of one single-byte pair replaced."""
    out = list(word)
    for at, by_pair in single:
        out[at] = by_pair.get(pair, out[at])
    return "".join(out)


def _as_written(word: str, pair: int) -> str:
    return _exchanged(word, _matches(word)[1], pair)


def _weak(sequence: str) -> bool:
    """Whether a garbled sequence could also be a piece of a written word: letters of one script in a usual order of cases."""
    return all(c in CYRILLIC for c in sequence) and not any(a.islower() and b.isupper() for a, b in zip(sequence, sequence[1:]))


def _kind(c: str) -> str:
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "."
    if c in SMALL:
        return "l"
    if c in LARGE:
        return "L"
    if c in CYRILLIC:
        return "c" if c.islower() else "C"
    if c in GREEK:
        return "g" if c.islower() else "G"
    if c in "“„«‘":
        return "("
    if c in "”»":
        return ")"
    if c == "’" or c in "\xad‐¬…" or c == "\xa0":
        return "'"
    if c in "–—":
        return "-"
    if c in "¡¿":
        return "!"
    if c in MARKS or c in "¹¢¥¦¨¯´¶¸÷≤≥≈≠∞√∑∏∂∫":
        return "$"
    code = ord(c)
    if code > 0xFFFF or 0x2190 <= code <= 0x21FF or 0x2600 <= code <= 0x27BF:
        return "e"
    if 0x3040 <= code <= 0xD7A3 or 0xF900 <= code <= 0xFAFF:
        return "h"
    if unicodedata.category(c) in ("Mn", "Lo") or 0x0530 <= code <= 0x1DFF:
        return "o"
    return "?"


#: What no Russian word has: hard and soft signs or ы at its start, a hard sign but before е, ё, ю, я, й after a consonant.
_NO_CYRILLIC = re.compile(r"^[ъьы]|ъ(?![еёюя])|(?<=[бвгджзклмнпрстфхцчшщ])й")
_SMALL_KINDS, _LARGE_KINDS = set("alcg"), set("ALCG")
_LETTERS = set("aAlLcCgG")
_SCRIPT = {k: s for s, ks in {"latin": "aAlL", "cyrillic": "cC", "greek": "gG", "han": "h"}.items() for k in ks}


def breaks(word: str) -> float:
    """How far a word departs from any writing: 0 for natural words, 2 and more for clear breaks."""
    kinds = [_kind(c) for c in word]
    n, total = len(kinds), 0.0
    accents = 0
    for i, (c, k) in enumerate(zip(word, kinds)):
        before, after = kinds[i - 1] if i else " ", kinds[i + 1] if i + 1 < n else " "
        if k == "?":
            total += 3 if "\x80" <= c < "\xa0" else 2
        elif k == "$":
            if before in _LETTERS or after in _LETTERS:
                fine = (c == "°" and before not in _LETTERS and word[i + 1] in "CFc") or (c in "®™" and after not in _LETTERS) or (c in "²³" and word[i - 1] == "m" and after not in _LETTERS) or (c in "ªº" and before == "0")
                total += (1 if c == "®" else 0) if fine else 2
            elif c in "¦¨¯´¶¸¹÷≤≥≈≠∞√∑∏∂∫":
                total += 1
        elif k == "(" and before in _LETTERS or k == ")" and after in _LETTERS or k == "!" and before in _LETTERS:
            total += 2
        elif k == "'" and c == "¬" and after != " ":
            total += 2
        elif k == "'" and c == "…" and after in _LETTERS and before in _LETTERS:
            total += 2
        elif k == "-" and before in _LETTERS and after in _LETTERS:
            total += 1
        if k in _SCRIPT and before in _SCRIPT and _SCRIPT[k] != _SCRIPT[before]:
            total += 2
        if k in "LCG" and before in _SMALL_KINDS:
            total += 2
        if k == "L" and before in _LARGE_KINDS and after in _SMALL_KINDS or k == "l" and before in "A" and i > 1 and kinds[i - 2] in "AL":
            total += 2
        if k in "lL":
            accents += 1
            if accents == 3:
                total += 2
            elif accents > 3:
                total += 1
        else:
            accents = 0
    letters = [c for c, k in zip(word, kinds) if k in _LETTERS]
    if len(letters) == 1 and letters[0] > "\x7f" and "0" in kinds:
        total += 2  # one accented letter before or after a number
    if len(letters) == 1 and _SCRIPT[_kind(letters[0])] == "latin" and letters[0] > "\x7f" and letters[0] not in LONE and not any(k in "'(0" for k in kinds):
        total += 2
    elif len(letters) > 1 and all(c > "\x7f" and _SCRIPT[_kind(c)] == "latin" for c in letters):
        total += 2
    elif len(letters) > 1 and all(c in CYRILLIC for c in letters):
        # Small and capital letters exchanged: the mark of Cyrillic read in another Cyrillic encoding.
        if letters[0].islower() and all(c.isupper() for c in letters[1:]):
            total += 2
        if _NO_CYRILLIC.search("".join(letters).lower()):
            total += 2
    return total


# Letters by falling frequency, for telling pairs apart that all give natural words.
_FREQUENT = ["оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", "αοιετσνηυρπκμλωςάόίδγέήχθύώφβξζψ", "éäüöàóíáèçßãêłęąśżñúôâîćńûùœïëźõ"]
_WEIGHT = {c: 0.4 for c in MARKS} | {c: 1 / (1 + rank / 4) for order in _FREQUENT for rank, c in enumerate(order)}


def _likely(word: str) -> float:
    """How usual the non-ASCII characters of a word are; small letters before capitals."""
    odd = [c for c in word if c > "\x7f"]
    return sum(_WEIGHT.get(c, 0.5 * _WEIGHT.get(c.lower(), 0.0)) for c in odd) / max(1, len(odd))


def _symbols(word: str) -> bool:
    return not any(c.isalnum() for c in word)


class _Words(dict):
    """Word -> (restored word, pairs that do best or None, improvement); starts afresh beyond a size."""

    def __missing__(self, word: str) -> tuple[str, tuple | None, float]:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = _restore_word(word)
        return value


def _decoded(word: str, number: int, best: dict[int, list]) -> str | None:
    """The matched sequences of one reading encoding replaced, longest first from the left; None if there are none."""
    at, out, places = 0, [], 0
    while at < len(word):
        hits = [h for h in best.get(at, ()) if number in h[1]]
        if hits:
            length, by_read, weak = max(hits, key=lambda h: h[0])
            if not (weak and len(best) == 1 and breaks(word) < 2):
                out.append(by_read[number])
                at += length
                places += 1
                continue
        out.append(word[at])
        at += 1
    return "".join(out) if places else None


def _sequences(word: str, votes: dict[int, int] | None = None) -> tuple[str, tuple[int, ...]]:
    """(word with its multi-character sequences replaced, the reading encodings that do so equally well).

    All sequences of a word are of one reading encoding: the one that leaves the
    fewest breaks, among equals the one that most words of the record agree with
    (``votes``) or the one with the most usual letters. Text garbled twice is taken
    in two rounds.
    """
    votes = votes or {}
    reads: tuple[int, ...] = ()
    for turn in range(3):
        best, _ = _matches(word)
        if not best:
            break
        options = []
        for number in sorted({n for hits in best.values() for _, by_read, _ in hits for n in by_read}):
            new = _decoded(word, number, best)
            if new is not None:
                options.append((breaks(new), -votes.get(number, 0), -_likely(new), number, new))
        if not options or min(options)[0] > breaks(word):
            break
        if not turn:
            reads = tuple(o[3] for o in options if o[0] == min(options)[0])
        word = min(options)[4]
    return word, reads


def _wide(word: str) -> str | None:
    """UTF-8 read as an East Asian encoding: the bytes of the word, decoded again."""
    if not any(_kind(c) == "h" or _kind(c) == "?" for c in word):
        return None
    for read in READ_WIDE:
        try:
            out = word.encode(read).decode("utf-8")
        except UnicodeError:
            continue
        if out != word and breaks(out) == 0 and all(c < "\x80" or c in SMALL or c in LARGE or c in CYRILLIC or c in GREEK or c in MARKS for c in out):
            return out
    return None


#: The first half of a garbled letter whose second half, a control character, was dropped: found, and restored where only one letter fits.
_HALF = re.compile(r"[a-zà-ÿ]Ã|Ã[a-z]")


def _restore_word(word: str) -> tuple[str, tuple | None, float]:
    """(restored, ("sequences", pairs...) or the best single-byte pairs, None if neither; improvement: 2 and more is beyond doubt)."""
    if "&" in word and _ENTITY.search(word):
        fixed, reads = _sequences(html.unescape(word))
        if reads:
            return fixed, None, 4.0
    bad = breaks(word)
    fixed, reads = _sequences(word)
    left = breaks(fixed) if reads else bad
    if reads and not left:
        return fixed, ("sequences", *reads), 4.0
    wide = _wide(word)
    if wide is not None:
        return wide, None, 4.0
    best, numbers, least = word, (), bad
    if bad >= 1:
        _, single = _matches(word)
        for number in sorted({n for _, by_pair in single for n in by_pair}):
            new = _exchanged(word, single, number)
            rest = breaks(new)
            if rest < least:
                best, numbers, least = new, (number,), rest
            elif rest == least and numbers:
                numbers += (number,)
                if (_symbols(new) == _symbols(word), _likely(new)) > (_symbols(best) == _symbols(word), _likely(best)):
                    best = new
    if reads and left <= least:
        return fixed, ("sequences", *reads), 4.0
    if bad - least < 2 and _HALF.search(word):
        # Of the letters whose second half is a control character only ß is small; à ends in a no-break space.
        return re.sub(r"(?<=[a-zà-ÿ])Ã(?=\W*$)", "à", re.sub(r"(?<=[a-zà-ÿ])Ã(?=[a-zß-ÿ])", "ß", word)), None, 2.0
    return best, numbers, bad - least


_MEMO = _Words()


#: What an encoder without the letter left of it: question marks inside words, or pairs of them in place of a word.
_LOSSY = re.compile(r"\w\?\?+\w|(?<!\S)\?\?+(?=[\w\s°])|(?<!\S)[^\W\d_]+\?[a-zß-ÿ]+(?=[\s,.;:!?)]|$)")


def is_garbled(text: str | None) -> bool:
    """Whether at least one character of the text comes from a wrong decoding."""
    if not text or (text.isascii() and "&" not in text and "?" not in text):
        return False
    if "�" in text or ("?" in text and _LOSSY.search(text) is not None):
        return True
    # A letter alone at a line's end may be what cutting a title left of a word.
    return any(_MEMO[w][2] >= 2 and (len(w) > 2 or re.search(rf"(?<!\S){re.escape(w)}[ \t]+\S", text) is not None) for w in _suspects(text))


#: Longest piece judged as one word; text without blanks is judged piece by piece.
LONGEST = 200


def _pieces(word: str) -> list[str]:
    """A word in pieces of at most LONGEST characters, parted behind a plain character where one is near."""
    if len(word) <= LONGEST:
        return [word]
    out, at = [], 0
    while at < len(word):
        end = min(at + LONGEST, len(word))
        if end < len(word):
            end = next((k for k in range(end, end - 40, -1) if word[k - 1] < "\x80"), end)
        out.append(word[at:end])
        at = end
    return out


def _suspects(text: str) -> list[str]:
    """Words as blanks part them (a no-break space may be part of a garbled sequence)."""
    words = (w for w in _SPACES.split(text) if not w.isascii() or ("&" in w and ";" in w))
    return [p for w in words for p in _pieces(w)]


def restore(text: str | None) -> str | None:
    """The text with its garbled stretches restored; the same object if nothing is garbled."""
    if not is_garbled(text):
        return text
    parts = [p for part in _SPACES.split(text) for p in _pieces(part)]
    words = [k for k, part in enumerate(parts) if not part.isascii() or "&" in part]
    results = [_MEMO[parts[k]] for k in words]
    # Words of multi-character sequences agree on a reading encoding.
    reads = Counter(number for _, numbers, _ in results if numbers and numbers[0] == "sequences" for number in numbers[1:])
    # Each clear word votes for every single-byte pair that repairs it; the most usual letters decide among equals.
    votes = Counter(number for _, numbers, gain in results if gain >= 2 and numbers and numbers[0] != "sequences" for number in numbers)
    if votes:
        clear = {parts[k] for k, (_, numbers, gain) in zip(words, results) if gain >= 2 and numbers and numbers[0] != "sequences"}
        most = max(votes.values())
        best = max((number for number, n in votes.items() if n >= 0.9 * most), key=lambda number: (sum(_likely(_as_written(w, number)) for w in clear), -number))
    state = []
    for k, (new, numbers, gain) in zip(words, results):
        if gain >= 2 and (numbers is None or numbers[0] == "sequences"):
            if numbers and len(numbers) > 2:
                new = _sequences(parts[k], reads)[0]
            parts[k], kind = new, 0
        elif votes and gain > 0:
            own = _as_written(parts[k], best)
            parts[k], kind = (own if breaks(own) <= breaks(new) else new), 2
        else:
            kind = 1
        state.append(kind)
    if votes:
        # Words natural either way follow the garbled ones next to them, from both sides, where the change makes them no less usual.
        for order in (range(len(words)), range(len(words) - 1, -1, -1)):
            near = 0
            for i in order:
                if state[i] == 1:
                    k = words[i]
                    new = _as_written(parts[k], best)
                    if near > 0 and new != parts[k] and breaks(new) <= breaks(parts[k]) and _likely(new) >= _likely(parts[k]):
                        parts[k], state[i] = new, 2
                near = 4 if state[i] == 2 else near - 1
    return "".join(parts)


#: Rows that can't be garbled never reach Python.
_MAYBE = r"[^\x00-\x7F]|&[A-Za-z#]|\?[?a-z]"


def garbled(records: DataFrame, id_col: str = "id", text_col: str = "page_content") -> DataFrame:
    """(``id_col``) of the records with garbled text; one pass, no shuffle."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k, t in enumerate(batch.column(1)) if is_garbled(t.as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], names=[id_col])

    return records.where(F.col(text_col).rlike(_MAYBE)).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}")


def restored(records: DataFrame, id_col: str = "id", text_col: str = "page_content") -> DataFrame:
    """(``id_col``, restored STRING) of the garbled records."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [k for k, t in enumerate(texts) if is_garbled(t)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([restore(texts[k]) for k in keep], pa.string())], names=[id_col, "restored"])

    return records.where(F.col(text_col).rlike(_MAYBE)).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, restored string")
