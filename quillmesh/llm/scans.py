"""Problem 4: repair text extracted from scanned pages.

Method: an averaged-perceptron character editor. It scores edit operations on
words (keep, replace, delete, insert) and at line ends (hold the hyphen, or drop
it and join the lines) by features of the operation, its neighbours, and how
often the forms before and after it occur in the whole collection. The editor is
trained here, on words of the collection itself: damaged by a table of usual
misreadings, divided at random, or parted at a hyphen of their own spelling
(``sample`` words of either kind at most, a parameter); the word statistics
cover all records. Page furniture is found by position on the page: lines at its
edges that repeat from page to page, number the pages in order, or stand apart
from the wrapped text around them.

A word counts as known if it occurs twice or more in the collection. Up to
``LEXICON`` known words are broadcast; of larger collections the frequent ones are,
and the counts of the others that a record asks for reach it by a join on the
word (``_answered``), with the same results.

A record counts as scanned if its lines are hard-wrapped and it is no email.
Garbled records are restored before, line by line. Defined results: null, empty,
blank and unwrapped texts give no line; lines are parted by ``\\n`` and numbered
from 1; repeated rows give the same lines each.
"""

from __future__ import annotations

import difflib
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint, is_email
from quillmesh.llm.garbled import restore

#: Known words that are broadcast; beyond, those of at least 1 / LEXICON (or RARE / 4) of all occurrences, so no more than LEXICON (or 4 / RARE), and a join for the rest.
LEXICON = 300_000
#: Words up to this share of all occurrences are rare enough to be misreadings of others.
RARE = 2e-5
#: Characters that the printed lines of a page hold at least and at most; a longer one is no printed line, whatever stands around it.
NARROW, MEASURE = 20, 130
#: Share of lines longer than the width, beyond which a text is a list or has paragraphs in one line.
BEYOND = 0.15
#: Lines of furniture that lie between two pages at most: three at the foot, three at the head, and the text goes on in the next.
FURNITURE = 7
#: Words the editor is trained on at most, a parameter of both operators, and how often.
SAMPLE, EPOCHS = 3000, 3

# Usual misreadings, printed form -> read form.
MISREADINGS = [
    ("l", "1"), ("l", "I"), ("l", "|"), ("l", "i"), ("i", "l"), ("i", "1"), ("i", "j"), ("I", "l"), ("I", "1"), ("I", "|"),
    ("o", "0"), ("O", "0"), ("o", "c"), ("s", "5"), ("S", "5"), ("b", "6"), ("g", "9"), ("q", "9"), ("B", "8"), ("Z", "2"), ("z", "2"), ("G", "6"),
    ("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("c", "("), ("C", "("), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("v", "y"), ("y", "v"), ("u", "v"), ("n", "u"), ("u", "n"),
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("n", "ri"), ("ri", "n"), ("in", "m"), ("li", "h"), ("h", "li"), ("r", "i~"), ("u", "ii"), ("ü", "ii"), ("w", "vv"), ("vv", "w"), ("fi", "fl"), ("ß", "B"), ("ö", "6"), ("ö", "o"), ("ä", "a"), ("ü", "u"),
    ("à", "a"), ("á", "a"), ("â", "a"), ("ã", "a"), ("é", "e"), ("è", "e"), ("ê", "e"), ("í", "i"), ("î", "i"), ("ó", "o"), ("ô", "o"), ("õ", "o"), ("ú", "u"), ("û", "u"), ("ñ", "n"), ("ç", "c"), ("é", "c"), ("è", "c"), ("ê", "c"), ("é", "6"), ("è", "6"), ("ê", "6"), ("t", "i"),
    ("ł", "l"), ("ą", "a"), ("ę", "e"), ("ś", "s"), ("ż", "z"), ("ź", "z"), ("ć", "c"), ("ń", "n"), ("fi", "ﬁ"), ("fl", "ﬂ"),
]

_HYPHENS = "-‐‑\u00ad¬"
_DIVIDED = re.compile(rf"[^\W\d_][{re.escape(_HYPHENS)}]\s?$")
_MARKER = re.compile(r"\[\[page\d+\]\]|\f")
_TRIM = ".,;:!?\"'“”‘’„«»[]{}…·¿¡"
_CODE = re.compile(r"^[A-ZÀ-Þ]{2}[-/]?\d*$|^\W*\d[\d.,:/%-]*\W*$")


def core(token: str) -> str:
    """A token without the punctuation around it; a bracket is kept where it may be a misread letter."""
    token = token.strip(_TRIM)
    if token.startswith("(") and (token.endswith(")") or "(" not in token[1:] and ")" not in token):
        token = token[1:]
    return token.rstrip(")").strip(_TRIM) if "(" not in token else token.strip(_TRIM)


@dataclass
class Lexicon:
    """Counts of known words. ``extra`` holds those that a record asked for; ``asked`` collects what it asks."""

    counts: dict[str, int]
    total: int
    extra: dict[str, int] = field(default_factory=dict)
    asked: set[str] | None = None

    def __post_init__(self) -> None:
        self.rare = max(3.0, self.total * RARE)
        self.first_parts = {w.split("-")[0] for w, n in self.counts.items() if "-" in w and n > self.rare}

    def occurrences(self, word: str) -> int:
        n = self.counts.get(word)
        if n is None:
            n = self.extra.get(word, 0)
            if self.asked is not None:
                self.asked.add(word)
        return n

    def count(self, word: str) -> int:
        n = self.occurrences(word.lower())
        if not n and "'" in word:  # elided articles and genitives: the word itself decides
            head, _, tail = word.partition("'")
            n = self.occurrences((tail if len(tail) > len(head) else head).lower())
        return n

    def _scale(self, n: int) -> int:
        return 0 if not n else max(1, min(12, 6 + int(math.log2(n / self.rare))))

    def level(self, word: str) -> int:
        """Occurrences on a logarithmic scale relative to the collection, 0 for unknown words."""
        return self._scale(self.count(word))

    def usual(self, word: str) -> int:
        """The level of a word that is no rare one, else 0; all such words are broadcast."""
        level = self._scale(self.counts.get(word.lower(), 0))
        return level if level > 4 else 0


def edits(word: str) -> Iterator[tuple[str, str, int]]:
    """(operation, edited word, position) of every single edit that undoes a usual misreading."""
    for printed, read in MISREADINGS:
        at = word.find(read)
        while at >= 0:
            yield f"{read}>{printed}", word[:at] + printed + word[at + len(read) :], at
            at = word.find(read, at + 1)


def _features(op: str, before: int, after: int, word: str, at: int) -> list[str]:
    kind = "replace" if len(op) == 3 else "delete" if op == "blank" else "merge" if op.index(">") > len(op) - op.index(">") - 1 else "insert"
    left = "^" if at == 0 else "d" if word[at - 1].isdigit() else "a" if word[at - 1].isalpha() else "."
    odd = any(not c.isalpha() and c not in "-'’." for c in word)
    return [kind, f"op {op}", f"{kind} to {after}", f"{kind} from {before}", f"{kind} {before}>{after}", f"{kind} left {left}", f"{kind} odd {odd} {min(after, 3)}", f"{kind} size {min(len(word), 8)} {after > 5}"]


class Editor:
    """Averaged perceptron over the edits of a word; keeping it scores by its own features."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def _keep(self, before: int, word: str) -> list[str]:
        odd = any(not c.isalpha() and c not in "-'’." for c in word)
        return ["keep", f"keep {before}", f"keep odd {odd}", f"keep size {min(len(word), 8)}"]

    def options(self, word: str, lexicon: Lexicon, before: int | None = None) -> list[tuple[list[str], str, int]]:
        """(features, edited word, position; -1 for keeping)."""
        before = lexicon.level(word) if before is None else before
        out = [(self._keep(before, word), word, -1)]
        seen = set()
        for op, new, at in edits(word):
            after = lexicon.level(new)
            if after and after > before and (op, new) not in seen:
                seen.add((op, new))
                out.append((_features(op, before, after, word, at), new, at))
        if len(out) == 1 and 4 < len(word) < 40:
            # Two misreadings in one word: the second edit must reach the lexicon.
            for op, new, at in edits(word):
                for op2, new2, at2 in edits(new):
                    after = lexicon.usual(new2)
                    if after and new2 != word:
                        out.append((_features(op, before, after, word, at) + ["second", f"second {op2}"], new2, at))
        return out

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def best(self, options: list[tuple[list[str], str, int]]) -> int:
        scores = [self.score(f) for f, _, _ in options]
        return max(range(len(options)), key=lambda k: (scores[k], -k))

    def cases(self, lexicon: Lexicon, draw: random.Random, sample: int = SAMPLE) -> list[tuple[list[tuple[list[str], str, int]], str]]:
        """What the editor learns from: at most ``sample`` words of the lexicon, damaged by the table of misreadings or kept."""
        usual = sorted(w for w, n in lexicon.counts.items() if n > lexicon.rare and len(w) > 2 and w.replace("-", "").replace("'", "").isalpha())
        words = draw.sample(usual, min(sample, len(usual)))
        cases = []
        for word in words:
            shaped = word.capitalize() if draw.random() < 0.15 else word
            # Kept: as it is with its own count, or as a word of the lexicon that it doesn't know.
            cases.append((self.options(shaped, lexicon), shaped))
            hidden = Lexicon({w: n for w, n in ((w, lexicon.occurrences(w)) for _, w, _ in ((o, n.lower(), a) for o, n, a in edits(shaped)) if w != word) if n}, lexicon.total)
            cases.append((self.options(shaped, hidden, 0), shaped))
            damages = [(shaped[:k] + read + shaped[k + len(printed) :]) for printed, read in MISREADINGS for k in range(len(shaped)) if shaped.startswith(printed, k)]
            if damages:
                for damaged in draw.sample(damages, min(6, len(damages))):
                    if lexicon.count(damaged) <= lexicon.rare:
                        cases.append((self.options(damaged, lexicon), shaped))
            if len(word) > 3:
                cut = draw.randrange(1, len(word))
                cases.append((self.blank_options(shaped[:cut], shaped[cut:], lexicon), shaped))
                other = draw.choice(words)
                cases.append((self.blank_options(shaped, other, lexicon), shaped))
        return cases + self._join_cases(lexicon, words, draw, sample)

    def train(self, lexicon: Lexicon, seed: int = 7, sample: int = SAMPLE) -> Editor:
        """Fit on the cases of a lexicon."""
        draw = random.Random(seed)
        cases = self.cases(lexicon, draw, sample)
        total: dict[str, float] = defaultdict(float)
        step = 1
        for _ in range(EPOCHS):
            draw.shuffle(cases)
            for options, truth in cases:
                guess = self.best(options)
                right = next((k for k, (_, new, at) in enumerate(options) if new == truth and (at >= 0 or truth == options[0][1])), 0)
                if guess != right:
                    for features, sign in ((options[right][0], 1.0), (options[guess][0], -1.0)):
                        for f in features:
                            self.weights[f] = self.weights.get(f, 0.0) + sign
                            total[f] += sign * step
                step += 1
        self.weights = {f: w - total[f] / step for f, w in self.weights.items()}
        return self

    def join_options(self, left: str, right: str, mark: str, lexicon: Lexicon, known: bool = True) -> list[tuple[list[str], str, int]]:
        """Keep the hyphen between the two parts of a line end, or drop it and join them; with ``known`` False as if neither form were known."""
        joined, kept = (lexicon.count(left + right), lexicon.count(f"{left}-{right}")) if known else (0, 0)
        a, b = lexicon.level(left), lexicon.level(right)
        against = "neither" if not joined and not kept else "joined" if joined > kept else "kept" if kept > joined else "even"
        soft, parts = mark != "-", f"{a > 6 and len(left) > 2} {b > 6 and len(right) > 2}"
        repaired = against == "neither" and not (a and b) and any(lexicon.usual(new) for _, new, _ in edits(left + right))
        inner = "-" in left and bool(lexicon.count(left.replace("-", "") + right))
        capital = right[:1].isupper() and not left.isupper()
        first = left.lower() in lexicon.first_parts and b > 6
        facts = [
            "bias", against, f"{against} soft {soft}", f"{against} parts {parts}", f"{against} first {first}", f"{against} capital {capital}", f"{against} inner {inner}", f"{against} repaired {repaired}",
            f"{against} {soft} {parts} {first} {capital}", f"{against} parts {min(a, 7)} {min(b, 7)}",
        ]
        return [([f"hold {f}" for f in facts], f"{left}-{right}", -1), ([f"join {f}" for f in facts], left + right, len(left))]

    def _join_cases(self, lexicon: Lexicon, words: list[str], draw: random.Random, sample: int) -> list[tuple[list[tuple[list[str], str, int]], str]]:
        """Line ends to learn from: words divided anywhere, known and unknown, and words parted at a hyphen of their own spelling."""
        cases = []

        def add(left: str, right: str, mark: str, truth: str) -> None:
            for known in (True, False):
                cases.append((self.join_options(left, right, mark, lexicon, known), truth))

        for word in words:
            if len(word) > 3 and word.isalpha():
                cut = draw.randrange(2, len(word) - 1)
                left, right = word[:cut], word[cut:]
                if draw.random() < 0.1:
                    left, right = left.upper(), right.upper()
                add(left, right, draw.choice("---" + _HYPHENS), left + right)
        own = sorted(w for w, n in lexicon.counts.items() if w.count("-") and n > lexicon.rare and all(p.isalpha() for p in w.split("-")))
        for word in draw.sample(own, min(sample, len(own))):
            for at in (k for k, c in enumerate(word) if c == "-"):
                add(word[:at], word[at + 1 :], "-", word)
                if "-" not in word[:at]:
                    other = draw.choice(words)
                    add(word[:at].capitalize(), other.capitalize(), "-", f"{word[:at].capitalize()}-{other.capitalize()}")
        return cases

    def blank_options(self, left: str, right: str, lexicon: Lexicon) -> list[tuple[list[str], str, int]]:
        """Keep the blank between two tokens, or delete it."""
        before, after = min(lexicon.level(left), lexicon.level(right)), lexicon.usual(left + right)
        pair = f"{left} {right}"
        out = [(["keep blank", f"keep blank {before}", f"keep blank {before} {after}"], pair, -1)]
        if after:
            out.append((_features("blank", before, after, left + right, len(left)), left + right, len(left)))
        return out


@dataclass
class Repairer:
    """Lexicon and trained editor, with memos per worker."""

    lexicon: Lexicon
    editor: Editor

    def __post_init__(self) -> None:
        self._memo: dict[str, tuple[str, int]] = {}
        self._left: dict[str, tuple[str, bool]] = {}
        self._right: dict[str, tuple[str, bool]] = {}

    def word(self, token: str) -> tuple[str, int]:
        """(repaired word, position of its first misread character or -1)."""
        word = core(token)
        if self.lexicon.asked is not None:
            self._word(word)
            return word, -1
        known = self._memo.get(word)
        if known is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            known = self._memo[word] = self._word(word)
        return known

    def fixed(self, token: str) -> str:
        """A token with its misreadings undone, punctuation and case pattern kept."""
        word = core(token)
        new, place = self.word(token)
        if place < 0 or new == word:
            return token
        letters = [c for c in word[1:] if c.isalpha()]
        if letters and sum(c.islower() for c in letters) > len(letters) / 2:
            new = new[:1] + new[1:].lower()
        elif letters and word[:1].isupper():
            new = new.upper()
        return token.replace(word, new, 1)

    def _word(self, word: str) -> tuple[str, int]:
        if len(word) < 2 or _CODE.match(word) or self.lexicon.count(word) > self.lexicon.rare:
            return word, -1
        if any(c.isdigit() for c in word) and re.fullmatch(r"[\dlIOoS|]{2,4}", word) and re.search(r"\d\D|\D\d", word):
            return word, next(k for k, c in enumerate(word) if not c.isdigit())  # a number with a letter read into it
        if not any(c.isalpha() for c in word) or len(word) > 40:
            return word, -1
        if "-" in word:
            at = 0
            for part in word.split("-"):
                new, place = self.word(part) if len(part) > 2 else (part, -1)
                if place >= 0:
                    return word[:at] + new + word[at + len(part) :], at + place
                at += len(part) + 1
            return word, -1
        prefix = re.match(r"^[^\W\d_]{1,2}['’](?=\w{2})", word)
        if prefix:
            new, place = self.word(word[prefix.end() :])
            return word[: prefix.end()] + new, place + prefix.end() if place >= 0 else -1
        tail = re.search(r"['’]s$", word)
        if tail:
            new, place = self.word(word[: tail.start()])
            return new + tail[0], place
        options = self.editor.options(word, self.lexicon)
        if len(options) == 1:
            return word, -1
        best = self.editor.best(options)
        return options[best][1], options[best][2]

    def _first(self, token: str) -> tuple[str, bool]:
        """(word that may go on behind the blank, empty if none can; whether it is a usual one)."""
        a = token.lstrip(_TRIM + "(")
        return (a, self.lexicon.count(a) > self.lexicon.rare) if a.isalpha() else ("", False)

    def _second(self, token: str) -> tuple[str, bool]:
        """The same for what stands behind the blank."""
        b = token.rstrip(_TRIM + ")")
        return (b, self.lexicon.count(b) > self.lexicon.rare) if b.replace("-", "").replace("'", "").isalpha() else ("", False)

    def blank_inside(self, left: str, right: str) -> bool:
        """Whether two tokens are one word that the reader parted."""
        if self.lexicon.asked is not None:
            (a, usual), (b, also) = self._first(left), self._second(right)
        else:
            if len(self._left) + len(self._right) > 400_000:
                self._left.clear()
                self._right.clear()
            known = self._left.get(left)
            a, usual = known if known is not None else self._left.setdefault(left, self._first(left))
            known = self._right.get(right)
            b, also = known if known is not None else self._right.setdefault(right, self._second(right))
        if not a or not b or usual and also or b[:1].isupper() and not a.isupper():
            return False
        options = self.editor.blank_options(a, b, self.lexicon)
        return len(options) > 1 and self.editor.best(options) > 0

    def divided(self, left: str, right: str, mark: str) -> bool:
        """Whether the hyphen at a line's end only divides a word."""
        a, b = left.lstrip(_TRIM + "("), right.rstrip(_TRIM + ")")
        if not b or not b[:1].isalpha():
            return False
        return self.editor.best(self.editor.join_options(a, b, mark, self.lexicon)) > 0


# Words before a page number.
_PAGE_WORDS = r"page|pages|p\.|pg\.?|seite|s\.|página|pagina|pág\.?|strona|str\.|страница|стр\.?|с\.|σελίδα|σελ\.?|folio|blatt"
_DIGIT = r"[\dlI|OoJjSBZi]"
_NUMBER = re.compile(rf"^[\s\[(~—–·|*-]*(?:(?:{_PAGE_WORDS})\s*)?({_DIGIT}{{1,4}}|[ivxlc]{{1,6}})(?:\s*(?:/|of|von|de|sur|z|из|από|-)\s*{_DIGIT}{{1,4}})?[\s\])~—–·|*-]*$", re.I)


_ROMAN = re.compile(r"^(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?[il]{0,3})$", re.I)


def _canonical(line: str) -> str:
    """A line's form for comparison from page to page: case, digits and what misreading changes dropped."""
    s = re.sub(r"\s+", "", line).lower()
    s = s.replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w").replace("i~", "r")
    return re.sub(r"[0-9]", "#", s)


def _alike(a: str, b: str) -> bool:
    if not a or not b or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)) + 1:
        return False
    return a == b or difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.8


def _bare(line: str) -> str:
    return _MARKER.sub("", line)


def wrapped_width(lines: list[str]) -> int:
    """The width that a text is hard-wrapped at; 0 if it isn't.

    A line and the first word of the next bound the width between them. The width
    is the widest of those that nearly as many lines agree on as on any. Lines
    beyond it (a long title, a line of another origin) are no hindrance while they
    are one or few (``BEYOND``).
    """
    bare = [_bare(x).rstrip() for x in lines]
    lengths, reaches = [], []
    for a, b in zip(bare, bare[1:]):
        if a.strip() and b.strip() and not _NUMBER.match(a) and not _NUMBER.match(b):
            lengths.append(len(a))
            reaches.append(len(a) + 1 + len(b.split()[0]))
    candidates = sorted({len(x) for x in bare if NARROW <= len(x) <= MEASURE})
    if not lengths or not candidates:
        return 0
    ended, reached = sorted(lengths), sorted(reaches)
    wraps = [bisect_right(ended, w) - bisect_right(reached, w - 2) for w in candidates]
    k = max(k for k, n in enumerate(wraps) if n >= 0.9 * max(wraps))
    width = candidates[k]
    filled = [len(x) for x in bare if x.strip()]
    beyond = sum(n > width for n in filled)
    paged = any(_MARKER.search(x) for x in lines)
    return width if wraps[k] >= (1 if paged else 3) and wraps[k] >= 0.6 * len(lengths) and beyond <= max(1, BEYOND * len(filled)) else 0


#: Page numbers that can't be a line of text: with a word, in brackets or between dashes.
_SURE_NUMBER = re.compile(rf"^\s*(?:(?:{_PAGE_WORDS})\s*{_DIGIT}{{1,4}}(?:\s*/\s*{_DIGIT}{{1,4}})?|\[\s?{_DIGIT}{{1,4}}\s?\]|[-–—]\s?{_DIGIT}{{1,4}}\s?[-–—])\s*$", re.I)


_CODED = re.compile(r"\s[·|•©]\s")


def _page_breaks(lines: list[str], width: int) -> set[int]:
    """Where pages begin without a mark: around a page number, before a line that interrupts a sentence."""
    marks = [_MARKER.search(x) is not None for x in lines]
    lines = [_bare(x) for x in lines]
    filled = [k for k in range(len(lines)) if lines[k].strip()]
    breaks: set[int] = set()
    on_page, numbers_on_top, first_page = 0, False, True

    def unfinished(s: str) -> bool:
        return not re.search(r"[.!?:…][\"'”’»)]*$", s.strip())

    for place, k in enumerate(filled):
        before, after = filled[place - 1] if place else -1, filled[place + 1] if place + 1 < len(filled) else len(lines)
        if k in breaks or any(marks[before + 1 : k + 1]):
            first_page = first_page and on_page == 0
            on_page = 0
        on_page += 1
        s = lines[k].strip()
        centred = len(lines[k]) - len(lines[k].lstrip()) >= 8
        numbered = _SURE_NUMBER.match(s) or _NUMBER.match(s) and (centred or on_page <= 3 or place and unfinished(lines[before]) and len(s) <= 4 and k == before + 1)
        if on_page <= 3:
            numbers_on_top = numbers_on_top or bool(numbered) and first_page
            continue
        if after == len(lines) or any(marks[k + 1 : after + 1]):
            continue
        if numbered and numbers_on_top:
            title = lines[before].strip()
            breaks.add(before if unfinished(title) and (title.isupper() or len(lines[before].rstrip()) < 0.8 * width and not title[:1].islower()) else k)
            on_page = 1
        elif numbered:
            while after < len(lines) and _CODED.search(lines[after]) and len(lines[after].strip()) < 60:
                after = next((j for j in filled if j > after), len(lines))
            if after < len(lines):
                breaks.add(after)
        elif before == k - 1 and unfinished(lines[before]) and unfinished(s) and not s[:1].islower() and not _DIVIDED.search(s):
            # A capital line, or one too short to have been wrapped, with the sentence going on below it.
            goes_on = lines[after].strip()[:1].islower() or _DIVIDED.search(lines[before].rstrip()) is not None
            short = after == k + 1 and len(lines[k].rstrip()) + 1 + len(lines[after].split()[0]) < 0.8 * width
            if goes_on and (s.isupper() and len(s) > 5 or short or after > k + 1):
                breaks.add(k)
                on_page = 1
    return breaks


class _Running:
    """Edge lines of all pages by canonical form: whether a line's like stands on another page, however far.

    Equal forms are found in a dictionary. For alike ones the forms are compared
    by counts of letters and of letter pairs first, which bound the matched
    letters from above; few pass on to the exact comparison.
    """

    def __init__(self, canon: dict[int, str], zones: list[list[int]]) -> None:
        self.canon = canon
        self.pages: dict[str, set[int]] = {}
        for n, zone in enumerate(zones):
            for k in zone:
                self.pages.setdefault(canon[k], set()).add(n)
        self._counts: tuple | None = None

    @staticmethod
    def _count(form: str) -> np.ndarray:
        out = np.zeros(64 + 256, np.int16)
        for a in form:
            out[ord(a) % 64] += 1
        for a, b in zip(form, form[1:]):
            out[64 + (ord(a) * 31 + ord(b)) % 256] += 1
        return out

    def repeated(self, k: int, own: int) -> bool:
        form = self.canon[k]
        if len(form) <= 2:
            return False
        if len(self.pages[form]) > 1:
            return True
        if self._counts is None:
            forms = list(self.pages)
            self._counts = forms, np.array([len(f) for f in forms]), np.array([self._count(f) for f in forms])
        forms, sizes, counts = self._counts
        both, mine = sizes + len(form), self._count(form)
        # A ratio above 0.8 matches more than 0.4 of both lengths, in blocks parted by unmatched letters: so many pairs of letters are shared.
        near = np.flatnonzero((np.abs(sizes - len(form)) <= 0.25 * np.maximum(sizes, len(form)) + 1) & (np.minimum(counts[:, :64], mine[:64]).sum(1) > 0.4 * both))
        near = near[np.minimum(counts[near, 64:], mine[64:]).sum(1) > 0.2 * both[near] - 1]
        return any(self.pages[forms[j]] != {own} and _alike(form, forms[j]) for j in near)


def furniture(lines: list[str], width: int | None = None) -> set[int]:
    """Indexes of running headers, footers and page numbers, by position on the page; ``width`` is that of the lines, if known."""
    width = width or wrapped_width(lines) or max((len(_bare(x).rstrip()) for x in lines), default=0)
    starts = _page_breaks(lines, width)
    pages: list[list[int]] = [[]]
    for k, line in enumerate(lines):
        if (k in starts or _MARKER.match(line.lstrip(" \r"))) and pages[-1]:
            pages.append([])
        pages[-1].append(k)
        if line.rstrip(" \r").endswith("\f") and _bare(line).strip():
            pages.append([])
    pages = [p for p in ([k for k in page if _bare(lines[k]).strip()] for page in pages) if p]
    bare = {k: _bare(lines[k]).strip() for page in pages for k in page}
    found: set[int] = set()

    def apart(k: int, after: int | None) -> bool:
        """A line that wrapping can't have ended: short, without the end of a sentence."""
        s = bare[k]
        if re.search(r"[.!?:;,)]$", s) or _DIVIDED.search(s):
            return False
        return after is None or after != k + 1 or len(_bare(lines[k]).rstrip()) + 1 + len(bare[after].split()[0]) < width - 1

    tops = [page[:3] for page in pages]
    bottoms = [page[-3:] for page in pages]
    canon = {k: _canonical(_strip_number(bare[k])) for zone in (*tops, *bottoms) for k in zone}

    on_tops, on_bottoms = _Running(canon, tops), _Running(canon, bottoms)

    for n, page in enumerate(pages):
        # From the top edge inwards.
        texts_seen = 0
        for place, k in enumerate(page[:3]):
            after = page[place + 1] if place + 1 < len(page) else None
            s = bare[k]
            if _NUMBER.match(s) and len(page) > 1:
                found.add(k)
                continue
            if _numbered(s) and (texts_seen == 0 or n > 0):
                found.add(k)
                texts_seen += 1
                continue
            plain = s.isupper() and len(s) > 5 or n > 0 and on_tops.repeated(k, n)
            if texts_seen or s[:1].islower() or not (apart(k, after) or plain) or len(page) == 1 and len(pages) == 1:
                break
            texts_seen += 1
            if n > 0:
                found.add(k)
                continue
            # First page: a header if another stand-alone line (the title) follows, if later pages repeat it in
            # the same letter case, or if the text follows at once; a title stands apart from the text.
            second = after is not None and apart(after, page[place + 2] if place + 2 < len(page) else None) and not bare[after][:1].islower() and not _NUMBER.match(bare[after])
            same = [j for m, zone in enumerate(tops) if m != n for j in zone[:2] if _alike(canon[k], canon[j])]
            if not (second or after == k + 1 and not _NUMBER.match(bare[after]) or any(bare[j].isupper() == s.isupper() for j in same)):
                break
            found.add(k)
        # From the bottom edge inwards.
        rest = [k for k in page if k not in found]
        number_below = False
        for place, k in enumerate(reversed(rest[-3:])):
            s = bare[k]
            if len(page) - len(found & set(page)) <= 1 and not _NUMBER.match(s) and not on_bottoms.repeated(k, n):
                break
            if _NUMBER.match(s) and (not s.isalpha() or len(s) <= 2 or _ROMAN.match(s)):
                found.add(k)
                number_below = True
                continue
            above_is_number = place + 1 < len(rest) and _NUMBER.match(bare[rest[-place - 2]]) is not None
            coded = re.search(r"\s[·|•©]\s", s) is not None and len(s) < 60
            if not re.search(r"[.!?;,]$", s) and not s[:1].islower() and (coded or above_is_number and len(s) < 0.8 * width or on_bottoms.repeated(k, n) and len(s) < 0.9 * width and len(s) < 60):
                found.add(k)
                continue
            break
    return found


def _strip_number(s: str) -> str:
    return re.sub(rf"^\W*{_DIGIT}{{1,4}}\s{{2,}}|\s{{2,}}\W*{_DIGIT}{{1,4}}\W*$", "", s).strip()


def _numbered(s: str) -> bool:
    """A running header with the page number beside it."""
    return re.search(rf"^\W*{_DIGIT}{{1,4}}\s{{3,}}\S|\S\s{{3,}}\W*{_DIGIT}{{1,4}}\W*$", s) is not None


def found_lines(text: str | None, repairer: Repairer) -> list[tuple[int, str]]:
    """(line number from 1, kind) of a scanned text; nothing for other texts."""
    if not text or "\n" not in text:
        return []
    lines = [x.rstrip("\r") for x in restore(text).split("\n")]
    width = wrapped_width(lines)
    if not width:
        return []
    edge = furniture(lines, width)
    out = [(k + 1, "furniture") for k in sorted(edge)]
    body = [k for k in range(len(lines)) if k not in edge and _bare(lines[k]).strip()]
    skip_first, misread = False, set()
    for place, k in enumerate(body):
        tokens = _bare(lines[k]).split()
        after = body[place + 1] if place + 1 < len(body) else None
        follow = _bare(lines[after]).split() if after is not None else []
        last = len(tokens)
        start = 1 if skip_first else 0
        skip_first = False
        line = _bare(lines[k]).rstrip()
        if follow and tokens and line[-1:] in _HYPHENS and len(tokens[-1]) > 1:
            head, mark, rest = tokens[-1].rstrip(_HYPHENS), line[-1], follow[0]
            if head[-1:].isalpha():
                if repairer.divided(head, rest, mark):
                    out.append((k + 1, "hyphen"))
                    whole = head.lstrip(_TRIM + "(") + rest
                    if repairer.lexicon.count(core(whole)) <= repairer.lexicon.rare:
                        _, at = repairer.word(whole)
                        if at >= 0:
                            misread.add(k if at < len(head) else after)
                        elif len(follow) > 1 and repairer.blank_inside(core(whole), follow[1]):
                            misread.add(after)
                    last -= 1
                    skip_first = True
                elif re.search(r"[^\W\d_]", rest):
                    last -= 1
                    for part, where in ((head, k), (rest, after)):
                        if repairer.word(part)[1] >= 0:
                            misread.add(where)
                    skip_first = True
        if k in misread:
            continue
        for j in range(start, last):
            if repairer.word(tokens[j])[1] >= 0 or j + 1 < last and repairer.blank_inside(tokens[j], tokens[j + 1]):
                misread.add(k)
                break
    return out + [(k + 1, "misread") for k in sorted(misread)]


def repaired_text(text: str | None, repairer: Repairer) -> str | None:
    """A scanned text as continuous paragraphs, one per line group, parted by blank lines; None for other texts.

    Furniture and page markers are dropped, divided words joined, misread words
    replaced where the editor is sure; genuine hyphens and numbers stay.
    """
    if not text or "\n" not in text:
        return None
    lines = [x.rstrip("\r") for x in restore(text).split("\n")]
    width = wrapped_width(lines)
    if not width:
        return None
    edge = furniture(lines, width)
    body = [k for k in range(len(lines)) if k not in edge and _bare(lines[k]).strip()]
    paragraphs: list[str] = []
    current, before, join = "", None, None
    for k in body:
        raw = _bare(lines[k]).rstrip()
        tokens = raw.split()
        if current:
            between = range(before + 1, k)
            page_turn = any(j in edge for j in between) or _MARKER.search(lines[k]) is not None
            last = _bare(lines[before]).rstrip()
            ended = re.search(r"[.!?:…][\"'”’»)]*$", last) is not None
            short = len(last) + 1 + len(tokens[0]) < width - 1
            indented = len(raw) - len(raw.lstrip()) >= 2 and len(_bare(lines[before])) - len(_bare(lines[before]).lstrip()) < 2
            if join is None and (len(between) > 0 and not page_turn or indented or short and (ended or not page_turn) or page_turn and ended and tokens[0][:1].isupper() and short):
                paragraphs.append(current)
                current = ""
        if current and join is not None:
            head, mark = join
            if repairer.divided(head, tokens[0], mark):
                current = current[: len(current) - len(head)] + repairer.fixed(head + tokens[0])
            else:
                current = current + "-" + repairer.fixed(tokens[0])
            tokens = tokens[1:]
        fixed, j = [], 0
        while j < len(tokens):
            if j + 1 < len(tokens) and repairer.blank_inside(tokens[j], tokens[j + 1]):
                tokens[j + 1] = tokens[j] + tokens[j + 1]
            else:
                fixed.append(repairer.fixed(tokens[j]))
            j += 1
        join = None
        if raw[-1:] in _HYPHENS and tokens and len(tokens[-1]) > 1 and tokens[-1].rstrip(_HYPHENS)[-1:].isalpha():
            head = tokens[-1].rstrip(_HYPHENS)
            join, fixed = (head, raw[-1]), [*fixed[:-1], head]
        current = " ".join([*([current] if current else []), *fixed])
        before = k
    if current:
        paragraphs.append(current + ("-" if join else ""))
    return "\n\n".join(paragraphs)


def word_counts(records: DataFrame, text_col: str = "page_content") -> DataFrame:
    """(word, n) over all words of all records, counted per partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            merged: Counter[str] = Counter()
            for token, n in counts.items():
                word = core(_MARKER.sub("", token)).lower()
                if word and not word.isdigit():
                    merged[word] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").split())
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    return records.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(records: DataFrame, text_col: str = "page_content", sample: int = SAMPLE) -> tuple[Repairer, DataFrame | None]:
    """(repairer, other words): the editor trained on the word statistics of all records, and (word, n) of the known words that it doesn't hold; None if it holds all."""
    known = checkpoint(word_counts(records, text_col).where(F.col("n") > 1))
    words, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most max(LEXICON, 4 / RARE) words reach the driver: there are no more of that share.
    least = 2.0 if words <= LEXICON else max(2.0, min(total / LEXICON, total * RARE / 4))
    kept = known.where(F.col("n") >= least).toPandas()
    lexicon = Lexicon(dict(zip(kept["word"], (int(n) for n in kept["n"]))), int(total))
    others = None if len(kept) == words else known.where(F.col("n") < least)
    if others is not None:  # the counts that training asks for, bounded by the sample
        lexicon.asked = set()
        Editor().cases(lexicon, random.Random(7), sample)
        asked = records.sparkSession.createDataFrame([(w,) for w in lexicon.asked], "word string")
        lexicon.extra, lexicon.asked = {r.word: r.n for r in others.join(F.broadcast(asked), "word").collect()}, None
    editor = Editor().train(lexicon, sample=sample)
    lexicon.extra = {}
    return Repairer(lexicon, editor), others


def asked_words(text: str | None, repairer: Repairer) -> set[str]:
    """All words whose counts the repair of a text may need and the lexicon doesn't hold: every token and every line end is tried, whatever comes of it."""
    lexicon = repairer.lexicon
    lexicon.asked = set()
    lines = [_bare(x.rstrip("\r")).rstrip() for x in restore(text).split("\n")] if text and "\n" in text else []
    if not wrapped_width(lines):
        return lexicon.asked
    tokens = [x.split() for x in lines]
    for own in tokens:
        for k, token in enumerate(own):
            repairer.word(token)
            if k + 1 < len(own):
                repairer.blank_inside(token, own[k + 1])
    for k, own in enumerate(tokens):
        if own and own[-1][-1:] in _HYPHENS:
            head, mark = own[-1].rstrip(_HYPHENS), own[-1][-1]
            # Furniture may lie between the parts of a word: a few lines below are tried.
            for follow in [x for x in tokens[k + 1 :] if x][:FURNITURE]:
                whole = head.lstrip(_TRIM + "(") + follow[0]
                repairer.divided(head, follow[0], mark)
                for word in (head, whole, head + follow[0]):
                    repairer.word(word)
                lexicon.count(core(whole))
                if len(follow) > 1:
                    repairer.blank_inside(core(whole), follow[1])
    return lexicon.asked


Work = Callable[[str | None, Repairer], object]


def _answered(scanned: DataFrame, others: DataFrame, shared: Broadcast) -> DataFrame:
    """``scanned`` (id, text) plus ``known MAP<STRING, BIGINT>``: the counts of the words outside the lexicon that the record's repair asks for.

    A record's map is bounded by its own words; each word's count is one row, so a
    word that many records ask for may be split over tasks.
    """
    kind = scanned.schema["id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = shared.value
        asking = Repairer(Lexicon(repairer.lexicon.counts, repairer.lexicon.total), repairer.editor)
        asking.lexicon.rare = repairer.lexicon.rare
        for batch in batches:
            at, words = [], []
            for k, text in enumerate(batch.column(1)):
                asked = asked_words(text.as_py(), asking)
                at += [k] * len(asked)
                words += asked
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string())], names=["id", "word"])

    asked = scanned.mapInArrow(ask, f"id {kind}, word string").join(others, "word")
    answers = asked.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("known"))
    return scanned.join(answers, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "text", "known")


def _repair(records: DataFrame, id_col: str, text_col: str, name_col: str, sample: int, work: Work, emit: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on every scanned record; ``emit`` makes rows of a batch and its results."""
    repairer, others = fit(records, text_col, sample)
    shared = records.sparkSession.sparkContext.broadcast(repairer)
    scanned = records.where(~is_email(records[name_col]) & F.col(text_col).contains("\n")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if others is not None:
        scanned = _answered(scanned, others, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = shared.value
        for batch in batches:
            known = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            results = []
            for text, extra in zip(batch.column(1), known):
                repairer.lexicon.extra = dict(extra or ())
                results.append(work(text.as_py(), repairer))
            yield emit(batch, results)

    kind = records.schema[id_col].dataType.simpleString()
    return scanned.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def repaired(records: DataFrame, id_col: str = "id", text_col: str = "page_content", name_col: str = "file_name", sample: int = SAMPLE) -> DataFrame:
    """(``id_col``, repaired STRING) of the scanned records; the editor is trained on ``sample`` words of either kind at most."""

    def emit(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        keep = [k for k, t in enumerate(texts) if t is not None]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([texts[k] for k in keep], pa.string())], names=[id_col, "repaired"])

    return _repair(records, id_col, text_col, name_col, sample, repaired_text, emit, "repaired string")


def scan_lines(records: DataFrame, id_col: str = "id", text_col: str = "page_content", name_col: str = "file_name", sample: int = SAMPLE) -> DataFrame:
    """(``id_col``, line_no INT, kind STRING): furniture, hyphen and misread lines of scanned records; ``sample`` as for ``repaired``."""

    def emit(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        at = [k for k, rows in enumerate(found) for _ in rows]
        flat = [row for rows in found for row in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string())], names=[id_col, "line_no", "kind"]
        )

    return _repair(records, id_col, text_col, name_col, sample, found_lines, emit, "line_no int, kind string")
