"""Problem 3: the lines an email's sender newly wrote.

Method: a recursive layout grammar. The lines of a body are parsed into a tree

    body      := (authored | quote | forward)*
    quote     := introduction? (marked line | line that lost its mark | blank)+     its content, a mark less, is a body
    forward   := (separator | header block | introduction without marks) body       up to the end
    authored  := paragraph* closing? signature? notice*

down to the innermost quote, and only the paragraphs of ``authored`` nodes at depth
0 are serialised: ``newly_written``. ``structure`` serialises the whole tree, one row
a line. Bodies wait on a stack instead of the call stack, and the marks that all
lines of a quote share are taken off at once, so neither deep nor long quotes
exceed any limit.

A garbled email is restored for parsing; restoring keeps line ends, so line
numbers hold. Defined results: null, empty and blank texts give no line; lines
are parted by ``\\n`` and numbered from 1; a carriage return belongs to no line;
repeated rows give the same lines each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmesh.llm.common import is_email
from quillmesh.llm.garbled import LARGE, SMALL, restore


@dataclass
class Node:
    """``kind``: authored, closing, notice, quote, forward; ``lines`` are indexes into the lines of the email; the first ``lead`` of them introduce a quote or forward."""

    kind: str
    lines: Sequence[int]
    depth: int = 0
    lead: int = 0
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """The node and all below it, parents first."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += reversed(node.children)


def _lenient(words: str) -> str:
    """A pattern in which an accented letter may also be what a lossy decoding left of it."""
    return "".join(rf"(?:{c}|[?\ufffd]{{1,4}}|[^\s\w]{{1,2}})" if c in SMALL or c in LARGE else c for c in words)


# Words of reply headers, closings and notices, by language.
_VERBS = "wrote|writes|schrieb|schreibt|escribió|escribe|a écrit|écrit|escreveu|napisał|napisała|napisał\\(a\\)|pisze|написал|написала|пишет|έγραψε"
_FIELDS = "From|Sent|Date|To|Cc|Bcc|Subject|Reply-To|Importance|Von|Gesendet|Datum|An|Betreff|De|Envoyé|Envoyé le|À|A|Objet|Enviado|Enviado el|Enviada em|Fecha|Para|Asunto|Assunto|Data|Od|Wysłano|Do|DW|Temat|От|Отправлено|Дата|Кому|Тема|Από|Στάλθηκε|Προς|Θέμα"
_CLOSINGS = (
    "regards|kind regards|best regards|warm regards|best|best wishes|all the best|cheers|thanks|thank you|many thanks|many thanks in advance|thanks in advance|thx|rgds|br|sincerely|yours sincerely|sincerely yours|yours faithfully|yours truly|yours|take care|talk soon"
    "|mit freundlichen grüßen|mit freundlichem gruß|freundliche grüße|beste grüße|viele grüße|liebe grüße|herzliche grüße|schöne grüße|mit besten grüßen|gruß|grüße|mfg|vg|lg|hochachtungsvoll|vielen dank|danke|besten dank|vielen dank im voraus"
    "|cordialement|bien cordialement|très cordialement|bien à vous|salutations|meilleures salutations|sincères salutations|salutations distinguées|amicalement|cdlt|merci|merci d'avance|merci beaucoup|bonne journée"
    "|saludos|saludos cordiales|un saludo|un cordial saludo|atentamente|cordialmente|gracias|muchas gracias|gracias de antemano|un abrazo"
    "|atenciosamente|cumprimentos|melhores cumprimentos|com os melhores cumprimentos|saudações|obrigado|obrigada|abraço|abraços|att"
    "|pozdrawiam|serdecznie pozdrawiam|z poważaniem|pozdrowienia|dziękuję|dzięki|с уважением|с наилучшими пожеланиями|спасибо|заранее спасибо|всего доброго|με εκτίμηση|με φιλικούς χαιρετισμούς|φιλικά|ευχαριστώ"
)
_PROGRAM_NOTICES = r"sent from my|sent via|sent with|get the \S+ app|get \S+ for|von meine\w* \S+.* gesendet|gesendet (?:von|mit|über)|diese nachricht wurde von mein|enviado desde mi|enviado desde|envoyé (?:de|depuis)|enviado do meu|wysłane z|wysłano z|отправлено с|στάλθηκε από|this e-?mail was scanned|diese e-?mail wurde .* geprüft|ce courriel a été|ce message a été analysé|este correo ha sido"
_HEADINGS = "confidentiality notice|confidentiality|disclaimer|legal notice|legal disclaimer|notice|privacy notice|important notice|haftungsausschluss|vertraulichkeitshinweis|rechtlicher hinweis|rechtliche hinweise|hinweis|wichtiger hinweis|avis de confidentialité|avertissement|avis juridique|mention légale|mentions légales|clause de confidentialité|aviso legal|aviso de confidencialidad|cláusula de confidencialidad|aviso|nota legal"
_LEGAL = (
    r"(?:is|are|be|strictly|legally|and) confidential|confidentiality|confidential (?:and|information)|privileged|intended (?:solely |only )?for the (?:addressee|recipient|use)|intended recipient|unauthori[sz]ed|disclosure|\bliability|\bliable|received this .{0,40}in error|e-?mail traffic|monitored and|do(?:es)? not bind|concluded by electronic|before printing|opinions expressed|legally binding|malware|virus|is registered under|registered office"
    r"|nachricht ist vertraulich|vertraulich und|vorgesehene\w* empfänger|genannten empfänger|löschen sie|verständigen sie|haftung|haftet|irrtümlich|rechtsverbindlich|unbefugt|weitergabe|vor dem ausdruck|überwacht|schriftliche\w* vereinbarung|registernummer|gerichtsstand"
    r"|est confidentiel|confidentiel et|destinataire|par erreur|décline|avant d'imprimer|toute diffusion|divulgation|surveillé|opinions exprimées|n'engage|immatriculée?|siège social"
    r"|es confidencial|confidencial y|destinatari|por error|no se hace responsable|antes de imprimir|divulgación|no autorizad|elimine y|no vincula|opiniones expresadas|inscrita en"
    r"|são confidenciais|por engano|poufn|adresat|конфиденциальн|адресат|εμπιστευτικ|παραλήπτη"
)

_MARK = re.compile(r"^\s{0,3}(?:>|\|(?=\s|$)|[A-Z]{1,3}>)")
_VERB_END = re.compile(rf"(?:\b|\s)(?:{_lenient(_VERBS)})\b.{{0,90}}[:：]\s*$|(?:{_lenient(_VERBS)})\s*[:：]\s*$", re.I)
_EVIDENCE = re.compile(r"@|<[^>]+>|\b\d{1,2}[./:]\d{1,2}\b|\b\d{4}\b")
_NAMED_VERB = re.compile(rf"^[\w.'-]+(?: [\w.'-]+){{0,2}} (?:{_lenient(_VERBS)})\s*:\s*$")
_STAMPED = re.compile(r"^\d{4}-\d\d-\d\d \d{1,2}:\d\d.*:\s*$", re.S)
_QUOTING = re.compile(r"^(?:Quoting|Zitat von|Zitiere|Citando a?|Citation de|Quote from|Cytowanie)\b.*:\s*$", re.I)
_INTRO_START = re.compile(r"^(?:(?:On|Am|El|Le|Em|W dniu|Dnia|Στις|Quoting|Zitat)\b|\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|[^\s<>@:]+(?: [^\s<>@:]+){0,3} <[^<>\s]+@)")
_FORWARD_START = re.compile(_lenient(r"^(?:begin forwarded message|anfang der weitergeleiteten (?:nachricht|e-mail)|début du (?:message|courriel) (?:transféré|réexpédié)|inicio del mensaje reenviado|início da mensagem (?:encaminhada|reencaminhada)|początek przekazywanej wiadomości|начало переадресованного сообщения)") + r"\s*:\s*$", re.I)
_SEPARATOR = re.compile(r"^[-_=*]{4,}\s?[^\W\d_].*?\s?[-_=*]{4,}\s*$")
_FIELD = re.compile(rf"^\*?({_lenient(_FIELDS)})\s?:\*?(?:\s|$)")
_RULE = re.compile(r"^(?:(?:[-_=*~#—–]\s?){3,}|([^\W\d_])\1{2,})$")
_CLOSING = re.compile(rf"^(?:{_lenient(_CLOSINGS)})\s*[,.!:–-]*$", re.I)
_PROGRAM = re.compile(rf"^(?:{_lenient(_PROGRAM_NOTICES)})\b", re.I)
_HEADING = re.compile(rf"^\W*(?:{_lenient(_HEADINGS)})\s*[:.]?\W*$", re.I)
_LEGAL_WORDS = re.compile(_lenient(_LEGAL), re.I)
_CONTACT = re.compile(r"@|www\.|https?://|^\s*(?:T|Tel|Tel\.|Phone|Mobile|Fax|Fon|Mob)\b[ .:]*\+?\d|^\+?\d[\d ()/-]{6,}$", re.I)
_SENTENCE_END = re.compile(r"[.!?…:;,)][\"'”’»]*$")


def _intro(lines: list[str], at: int) -> int:
    """How many lines from ``at`` introduce a quoted message; 0 if none does."""
    text = ""
    for n in (1, 2, 3):
        if at + n > len(lines) or not lines[at + n - 1].strip() or _MARK.match(lines[at + n - 1]):
            return 0
        text = f"{text} {lines[at + n - 1].strip()}".strip()
        if n > 1 and not _INTRO_START.match(text):
            return 0
        if text[-1] not in ":：":
            continue  # every introduction ends in a colon
        if _QUOTING.match(text) or (_STAMPED.match(text) and _EVIDENCE.search(text)):
            return n
        if _VERB_END.search(text) and len(text) < 200 and (_EVIDENCE.search(text) and _starts_like_intro(text) or _NAMED_VERB.match(text)):
            return n
    return 0


def _starts_like_intro(text: str) -> bool:
    return bool(_INTRO_START.match(text)) or "@" in text


def _header_block(lines: list[str], at: int) -> int:
    """How many lines from ``at`` form a block of header fields; 0 unless two different fields meet."""
    seen, n = set(), 0
    while at + n < len(lines) and lines[at + n].strip():
        field_name = _FIELD.match(lines[at + n].strip()) if ":" in lines[at + n] else None
        if field_name:
            seen.add(field_name[1])
        elif not (len(seen) > 1 and n < 9 and lines[at + n].startswith((" ", "\t"))):
            break
        n += 1
    return n if len(seen) > 1 else 0


def parse(lines: list[str]) -> list[Node]:
    """The tree of an email's lines."""
    root = Node("body", list(range(len(lines))))
    waiting = [(root, lines, root.lines, 0)]
    while waiting:
        parent, content, where, depth = waiting.pop()
        for node, marks in _body(content):
            node.depth = depth
            if marks is not None:
                start, end = node.lines[0] + node.lead, node.lines[-1] + 1
                if marks or end - start < len(content):
                    inner = content[start:end]
                    waiting.append((node, [_unmarked(line, marks) for line in inner] if marks else inner, where[start:end], depth + max(marks, 1)))
                node.lines = where[node.lines[0] : end]
            else:
                node.lines = [where[k] for k in node.lines]
            parent.children.append(node)
    return root.children


def _unmarked(line: str, marks: int) -> str:
    """A line without its first ``marks`` marks; one that lost its mark stays as it is."""
    at = 0
    for _ in range(marks):
        mark = _MARK.match(line[at : at + 8])
        if mark is None:
            break
        at += mark.end()
    return line[at:].removeprefix(" ") if at else line


def _shared_marks(lines: list[str]) -> int:
    """The marks that all marked ones of these lines begin with; 0 if none is marked."""
    least = None
    for line in lines:
        if _MARK.match(line):
            n = at = 0
            while (least is None or n < least) and (mark := _MARK.match(line[at : at + 8])):
                n, at = n + 1, at + mark.end()
            least = n if least is None else min(least, n)
    return least or 0


def _body(lines: list[str]) -> list[tuple[Node, int | None]]:
    """The nodes of one body, with the marks to take off the content of those that hold a body again, None for the others."""
    nodes: list[tuple[Node, int | None]] = []
    own: list[int] = []

    def close() -> None:
        if own:
            nodes.extend((node, None) for node in _authored(lines, own[:], first=not nodes))
            own.clear()

    def nested(kind: str, start: int, end: int, lead: int = 0) -> None:
        close()
        nodes.append((Node(kind, range(start, end), lead=lead), _shared_marks(lines[start + lead : end]) if kind == "quote" else 0))

    at, n = 0, len(lines)
    while at < n:
        s = lines[at].strip()
        if not s:
            own.append(at)
            at += 1
            continue
        lead, rest_is_theirs = _introduction(lines, at)
        if lead:
            first = _next(lines, at + lead)
            if first < n and _MARK.match(lines[first]):
                end = _quote_end(lines, first)
            elif first < n and _indented(lines[first]):
                end = _indented_end(lines, first)
            elif rest_is_theirs:
                nested("forward", at, n, first + block - at if first < n and (block := _header_block(lines, first)) else lead)
                break
            else:
                end = at
            if end > at:
                nested("quote", at, end, lead)
                at = end
                continue
        if _MARK.match(lines[at]):
            end = _quote_end(lines, at)
            marked = sum(1 for k in range(at, end) if _MARK.match(lines[k]))
            if own and own[-1] == at - 1 and lines[at - 1].rstrip().endswith(":") and marked <= 2 and end - at <= 2:
                own.extend(range(at, end))  # an example within the sender's own paragraph
            else:
                nested("quote", at, end)
            at = end
            continue
        own.append(at)
        at += 1
    close()
    return nodes


def _introduction(lines: list[str], at: int) -> tuple[int, bool]:
    """(lines from ``at`` that introduce somebody else's text, whether all below is theirs); 0 if none does."""
    s = lines[at].strip()
    if _FORWARD_START.match(s) or _SEPARATOR.match(s):
        return 1, True
    if _RULE.match(s) and at + 1 < len(lines) and (block := _header_block(lines, _next(lines, at + 1))):
        return _next(lines, at + 1) + block - at, True
    count = _header_block(lines, at) or _intro(lines, at)
    return count, count > 0


def _indented(line: str) -> bool:
    return line[:2] in ("  ", " \t") or line[:1] == "\t"


def _next(lines: list[str], at: int) -> int:
    while at < len(lines) and not lines[at].strip():
        at += 1
    return at


def _quote_end(lines: list[str], at: int) -> int:
    """End of a run of marked lines, with the lines in it that lost their mark."""
    n = len(lines)
    while at < n:
        if _MARK.match(lines[at]):
            at += 1
            continue
        if not lines[at].strip():
            after = _next(lines, at)
            if after < n and _MARK.match(lines[after]):
                at = after
                continue
            return at
        # Unmarked and no blank line before: lost its mark if marked lines follow at once or the sentence runs on.
        k = at
        while k < n and lines[k].strip() and not _MARK.match(lines[k]):
            k += 1
        if k < n and lines[k].strip() and k - at <= 2 and not _is_reply(lines, at, k):
            at = k
            continue
        if k - at == 1 and _runs_on(lines[at - 1], lines[at]):
            return k
        return at
    return n


def _is_reply(lines: list[str], at: int, end: int) -> bool:
    """Whether the unmarked lines at..end between marked ones are a reply: whole sentences that don't fit in there."""
    first, last = lines[at].strip(), lines[end - 1].strip()
    if last.endswith(":"):
        return True
    if not first[:1].isupper() or not re.search(r"[.!?…][\"'”’»)]*$", last):
        return False
    before = _MARK.sub("", lines[at - 1]).strip(" >|")
    after = _MARK.sub("", lines[end]).strip(" >|")
    fits_before = not before or bool(re.search(r"[.!?…:][\"'”’»)]*$", before))
    return not (fits_before and not after[:1].islower()) or end - at > 1


def _runs_on(before: str, line: str) -> bool:
    content = _MARK.sub("", before).strip(" >|")
    fragment = len(line.split()) <= 3 and re.search(r"[\d.]\s", line) is not None and line.rstrip()[-1:].isalnum()
    return bool(content) and not _SENTENCE_END.search(content) and (line[:1].islower() or fragment)


def _indented_end(lines: list[str], at: int) -> int:
    n = len(lines)
    last = at
    while at < n and (not lines[at].strip() or _indented(lines[at])):
        if lines[at].strip():
            last = at + 1
        at += 1
    return last


def _name_like(s: str) -> bool:
    if " | " in s:
        return all(_signature_line(piece.strip()) for piece in s.split(" | "))
    words = s.rstrip(",").split()
    return 0 < len(words) <= 5 and not re.search(r"[.!?;:]$", s.rstrip(",")) and sum(w[:1].isupper() or w[:1].isdigit() or not w[:1].isalpha() for w in words) >= len(words) - 1


def _signature_line(s: str) -> bool:
    return bool(_CONTACT.search(s)) or _name_like(s)


def _authored(lines: list[str], part: list[int], first: bool = True) -> list[Node]:
    """Part a stretch of unquoted lines into paragraphs, closing with signature, and notices."""
    texts = {k: lines[k].strip() for k in part}
    filled = [k for k in part if texts[k]]
    cut, kind = len(filled), "closing"
    notices = _Notices(texts, filled)
    for p, k in enumerate(filled):
        s = texts[k]
        following = filled[p + 1 : p + 4]
        short = all(_signature_line(texts[j]) for j in following[:1])
        delimiter = lines[k].rstrip() in ("--", "—", "–") or _RULE.match(s)
        if delimiter and (not following or short or notices.from_line(p + 1)):
            cut = p
            break
        if _CLOSING.match(s) and short:
            cut = p
            break
        if _PROGRAM.match(s) and len(s) < 90:
            cut, kind = p, "notice"
            break
        if _HEADING.match(s) and following and (s.isupper() or s.endswith(":") or notices.from_line(p + 1)):
            cut, kind = p, "notice"
            break
        if _RULE.match(s) and (not following or notices.from_line(p + 1) or _HEADING.match(texts[following[0]])):
            cut, kind = p, "notice"
            break
        if (p == 0 or filled[p - 1] != k - 1) and notices.from_line(p):
            cut, kind = p, "notice"
            break
    kept = filled[:cut]
    # A signature without a closing: a last paragraph of names and contact lines only.
    last = len(kept)
    while last > 0 and (last == len(kept) or kept[last] == kept[last - 1] + 1):
        last -= 1
    tail = kept[last:]
    if last > 0 and tail and len(tail) > 1 and all(_signature_line(texts[j]) for j in tail) and any(_CONTACT.search(texts[j]) for j in tail):
        kept = kept[:last]
    elif last > 0 and len(tail) == 1 and len(texts[tail[0]].split()) <= 3 and _name_like(texts[tail[0]]) and texts[tail[0]].replace(" ", "").isalpha():
        kept = kept[:last]  # the sender's name alone
    elif len(kept) > 1 and kept[-1] == kept[-2] + 1 and re.search(r"[.!?…]$", texts[kept[-2]]) and re.fullmatch(r"[^\W\d_a-z][^\W\d_]+(?: [^\W\d_a-z][^\W\d_]+)?", texts[kept[-1]]):
        kept = kept[:-1]  # the same right below the text
    if len(kept) == 1 == len(filled) and not first and re.fullmatch(r"[^\W\d_a-z][^\W\d_]+", texts[kept[0]]):
        kept = []  # nothing but the sender's name below a quote
    nodes = [Node("authored", kept)] if kept else []
    if len(kept) < len(filled):
        nodes.append(Node(kind, filled[len(kept) :]))
    return nodes


class _Notices:
    """Answers whether everything from a filled line on reads as notices; each paragraph is judged once."""

    def __init__(self, texts: dict[int, str], filled: list[int]):
        self.texts, self.filled = texts, filled
        self.paragraph, starts = [], []
        for p, k in enumerate(filled):
            if not p or filled[p - 1] != k - 1:
                starts.append(p)
            self.paragraph.append(len(starts) - 1)
        ends = [*starts[1:], len(filled)]
        self.ends = ends
        #: The first paragraph from which on all are notices.
        self.tail = len(starts)
        while self.tail and self._notice(starts[self.tail - 1], ends[self.tail - 1]):
            self.tail -= 1

    def _notice(self, a: int, b: int) -> bool:
        text = " ".join(self.texts[k] for k in self.filled[a:b])
        return any(pattern.search(text) for pattern in (_RULE, _HEADING, _PROGRAM, _LEGAL_WORDS))

    def from_line(self, p: int) -> bool:
        if p >= len(self.filled):
            return False
        own = self.paragraph[p]
        if own + 1 < self.tail or not self._notice(p, self.ends[own]):
            return False
        rest = " ".join(self.texts[k] for k in self.filled[p:])
        words = len(_LEGAL_WORDS.findall(rest))
        return words >= 2 or words == 1 and len(rest) < 160


def tree(text: str | None) -> tuple[list[Node], int]:
    """(nodes, lines before them) of an email's text; a leading ``Subject:`` line is no part of the body."""
    if not text or not text.strip():
        return [], 0
    lines = [line.rstrip("\r") for line in restore(text).split("\n")]
    skip = 1 if re.match(r"\s*Subject:", lines[0], re.I) else 0
    return parse(lines[skip:]), skip


def authored_lines(text: str | None) -> list[int]:
    """Numbers (from 1) of the lines of an email's text that its sender newly wrote: the authored nodes at depth 0."""
    nodes, skip = tree(text)
    return [k + skip + 1 for node in nodes if node.kind == "authored" for k in node.lines]


def line_kinds(text: str | None) -> list[tuple[int, str, int]]:
    """(number from 1, kind, depth) of every line that isn't blank, in order: what the innermost node it lies in makes of it, ``introduction`` for what leads a quote or forward in."""
    nodes, skip = tree(text)
    lines = (text or "").split("\n")
    found: dict[int, tuple[str, int]] = {}
    for top in nodes:
        for node in top.walk():
            for place, k in enumerate(node.lines):
                found[k] = ("introduction" if place < node.lead else node.kind, node.depth)
    return [(k + skip + 1, *found[k]) for k in sorted(found) if lines[k + skip].strip()]


def _emails(records: DataFrame, id_col: str, text_col: str, name_col: str, rows_of: Callable[[str | None], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """One row for each tuple that ``rows_of`` gives for an email; no shuffle."""
    kind = records.schema[id_col].dataType.simpleString()
    types = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows_of(t.as_py()) for t in batch.column(1)]
            at = [k for k, rows in enumerate(found) for _ in rows]
            flat = [row for rows in found for row in rows]
            cells = [pa.array([row[c] for row in flat], types[t]) for c, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cells], names=[id_col, *columns])

    schema = ", ".join(f"`{name}` {t}" for name, t in ({id_col: kind} | columns).items())
    return records.where(is_email(records[name_col])).select(id_col, text_col).mapInArrow(run, schema)


def newly_written(records: DataFrame, id_col: str = "id", text_col: str = "page_content", name_col: str = "file_name") -> DataFrame:
    """(``id_col``, line_no INT): one row for each line that an email's sender newly wrote; no shuffle."""
    return _emails(records, id_col, text_col, name_col, lambda t: [(k,) for k in authored_lines(t)], {"line_no": "int"})


def structure(records: DataFrame, id_col: str = "id", text_col: str = "page_content", name_col: str = "file_name") -> DataFrame:
    """(``id_col``, line_no INT, kind STRING, depth INT): every line of an email that isn't blank, with its place in the tree; no shuffle."""
    return _emails(records, id_col, text_col, name_col, line_kinds, {"line_no": "int", "kind": "string", "depth": "int"})
