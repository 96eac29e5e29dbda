"""Problem 8: one form for texts that look alike.

Method: DuckDB inside the Arrow partitions. Each Arrow batch is registered with
a worker's DuckDB connection and one embedded SQL statement brings it to the
common form with ``nfc_normalize``, ``translate`` and regular expressions:

1. line ends to ``\\n``; blanks of any width to one space;
2. invisible characters removed (zero-width, direction marks, soft hyphens,
   controls), but for joiners between emoji, which change the picture;
3. compatibility forms that look like their letters (full-width and half-width,
   ligatures, Roman numerals, contextual forms, radicals) to those letters;
   forms that look different (superscripts, fractions, circled, styled
   mathematical letters, long s) are kept;
4. look-alike letters of other scripts to one representative;
5. NFC before and after, so that combining accents and composed letters agree;
6. runs of blanks to one, none at line ends or at the ends of the text.

Defined results: null stays null; a text without a visible character becomes
the empty text and is in no pair; repeated equal texts are no pair of each other
but each pairs with every differing text of the same look.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint

# Letters of other scripts whose usual glyph is that of the letter given.
LOOK_ALIKES = {
    # Cyrillic and Latin
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Ӏ": "I", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v", "Ѵ": "V", "ѐ": "è", "Ѐ": "È", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
    "ӓ": "ä", "Ӓ": "Ä", "ӧ": "ö", "Ӧ": "Ö", "ӑ": "ă", "Ӑ": "Ă", "ӗ": "ĕ", "Ӗ": "Ĕ", "ӱ": "ÿ", "Ӱ": "Ÿ", "ә": "ə", "ӕ": "æ", "Ӕ": "Æ",
    # Greek and Latin
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ό": "ó", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϊ": "Ï", "Ϋ": "Ÿ",
    # Greek and Cyrillic
    "Γ": "Г", "Π": "П", "Φ": "Ф", "ϕ": "ф",
    # Latin, letters with another code only
    "ɡ": "g", "ɑ": "a", "ǀ": "|", "Ɩ": "I", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "Ð": "Đ", "Ɖ": "Đ",
    "µ": "μ",
    # Armenian, Cherokee, Lisu and Latin
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Տ": "S", "Օ": "O", "Լ": "L", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E",
    "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Marks
    "‐": "-", "‑": "-", "﹣": "-", "⁃": "-", "ʼ": "’", "ʹ": "′", "‧": "·", "∙": "·", "⋅": "·", "·": "·", "ꞏ": "·", "∶": ":", "꞉": ":",
    "∕": "/", "⁄": "/", "∣": "|", "․": ".", "٫": ",", "‚": ",", "∗": "*", "⁎": "*", "ǃ": "!",
}

# One-to-many compatibility forms of the same look that the tagged ranges don't cover.
_SAME_LOOK_RANGES = [(0x0132, 0x0133), (0x013F, 0x0140), (0x0149, 0x0149), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0587, 0x0587), (0x2025, 0x2026), (0x2033, 0x2034), (0x2036, 0x2037), (0x203C, 0x203C), (0x2047, 0x2049), (0x2103, 0x2103), (0x2109, 0x2109), (0x2160, 0x217F), (0x2E9F, 0x2FD5), (0xFB00, 0xFB17), (0xFB4F, 0xFB4F)]
_SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"}

#: Blanks of any width, without line ends.
BLANKS = "\t\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
#: Line ends other than ``\n``.
LINE_ENDS = "\x0b\x0c\x85  "
_INVISIBLE = r"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}\x{200c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}]"
_PICTURE = r"[\x{2190}-\x{21ff}\x{2300}-\x{27bf}\x{2b00}-\x{2bff}\x{1f000}-\x{1faff}]"
#: Kept for the time of the statement in place of a joiner between emoji: a noncharacter.
_HELD = "﷐"


@lru_cache(maxsize=1)
def mappings() -> tuple[dict[str, str], dict[str, str]]:
    """(one-to-one, one-to-many) compatibility forms of the same look, by rule from the character database."""
    single, several = {}, {}
    for code in range(0x80, 0x110000):
        decomposition = unicodedata.decomposition(chr(code))
        if not decomposition.startswith("<"):
            continue
        tag, *_ = decomposition.split()
        if tag not in _SAME_LOOK_TAGS and not any(a <= code <= b for a, b in _SAME_LOOK_RANGES):
            continue
        form = unicodedata.normalize("NFKC", chr(code))
        if len(form) == 1:
            single[chr(code)] = form
        elif " " not in form and tag not in ("<isolated>", "<initial>", "<medial>", "<final>"):  # those are ligatures()
            several[chr(code)] = form
    return single, several


@lru_cache(maxsize=1)
def ligatures() -> dict[int, str]:
    """Contextual forms of several letters (Arabic ligatures) to their letters; spacing marks and whole phrases, whose forms have a blank, are kept."""
    codes = [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD)]
    forms = {c: unicodedata.normalize("NFKC", chr(c)) for c in codes if unicodedata.decomposition(chr(c)).startswith(("<isolated>", "<initial>", "<medial>", "<final>"))}
    return {c: form for c, form in forms.items() if len(form) > 1 and " " not in form}


def _letters(texts: pa.ChunkedArray) -> pa.ChunkedArray:
    """Texts with ligatures replaced by their letters; texts without presentation forms cost one search."""
    if not pc.any(pc.match_substring_regex(texts, r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}]")).as_py():
        return texts
    return pa.chunked_array([pa.array([t and t.translate(ligatures()) for t in texts.to_pylist()], texts.type)])


@lru_cache(maxsize=1)
def statement() -> str:
    """The embedded SQL: from table ``batch(id, text)`` to (id, look)."""
    single, several = mappings()
    table = {c: LOOK_ALIKES.get(form, form) for c, form in single.items()}
    table |= LOOK_ALIKES
    for code in range(0x80, 0x20000):  # composed letters on a look-alike base, which NFC puts together
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in LOOK_ALIKES and chr(code) not in table:
            form = unicodedata.normalize("NFC", LOOK_ALIKES[base] + "".join(marks))
            if len(form) == 1:
                table[chr(code)] = form
    table |= {c: " " for c in BLANKS if c != " "} | {c: "\n" for c in LINE_ENDS}
    table = {a: b for a, b in table.items() if a != b}
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    translate = lambda expr: f"translate({expr}, {quote(''.join(table))}, {quote(''.join(table.values()))})"
    text = "text"
    # Joiners between pictures are held back; twice, for neighbours in a chain share a picture.
    hold = lambda expr: rf"regexp_replace({expr}, '({_PICTURE}[\x{{fe0f}}\x{{1f3fb}}-\x{{1f3ff}}]*)\x{{200d}}({_PICTURE})', '\1{_HELD}\2', 'g')"
    joiner = "\u200d"
    text = f"CASE WHEN contains({text}, '{joiner}') THEN replace(replace({hold(hold(text))}, '{joiner}', ''), '{_HELD}', '{joiner}') ELSE {text} END"
    text = f"regexp_replace({text}, '{_INVISIBLE}', '', 'g')"
    for form, letters in several.items():
        text = f"replace({text}, {quote(form)}, {quote(letters)})"
    text = f"nfc_normalize({translate(f'nfc_normalize({text})')})"
    text = rf"regexp_replace(regexp_replace({text}, '\r\n?', E'\n', 'g'), ' +', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?\n ?', E'\n', 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    # Plain ASCII needs the last two steps only, but takes the same way: one form, one path.
    return f"SELECT id, {text} AS look FROM batch"


@lru_cache(maxsize=1)
def _connection():
    import duckdb

    connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
    return connection


def _looks(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.Table]:
    connection = _connection()
    table = pa.Table.from_arrays(batch.columns, names=["id", "text"])
    for start in range(0, table.num_rows, rows):
        part = table.slice(start, rows)
        connection.register("batch", part.set_column(1, "text", _letters(part.column(1))))
        yield connection.sql(statement()).to_arrow_table()
        connection.unregister("batch")


def common_form(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, look STRING): the common form of every text; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in _looks(batch):
                for out in table.to_batches():
                    yield pa.RecordBatch.from_arrays([out.column(0), out.column(1).cast(pa.string())], names=[id_col, "look"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, look string")


def same_look(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, class_id BINARY, text_id BINARY): digests of the look and of the text itself.

    Rows of one class look alike; rows of one text_id are exact copies. Texts
    without a visible character have no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            texts, at = batch.column(1), 0
            for table in _looks(batch):
                ids, looks = table.column(0).combine_chunks(), table.column(1).to_pylist()
                own = texts.slice(at, len(looks)).to_pylist()
                at += len(looks)
                digest = lambda s: blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                keep = [k for k, s in enumerate(looks) if s]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(keep, pa.int64())), pa.array([digest(looks[k]) for k in keep], pa.binary()), pa.array([digest(own[k]) for k in keep], pa.binary())],
                    names=[id_col, "class_id", "text_id"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, class_id binary, text_id binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, class_id BINARY, copies BIGINT, others BIGINT): one row for each text with a visible character.

    ``copies`` counts the rows of exactly this text, ``others`` those of the class whose
    texts differ from it: the partners it has in ``look_alike_pairs``.
    """
    rows = checkpoint(same_look(docs, id_col, text_col))
    texts = rows.groupBy("class_id", "text_id").agg(F.count(F.lit(1)).alias("copies"))
    sizes = texts.groupBy("class_id").agg(F.sum("copies").alias("_all"))
    return rows.join(texts, ["class_id", "text_id"]).join(sizes, "class_id").select(id_col, "class_id", "copies", (F.col("_all") - F.col("copies")).alias("others"))


#: Different texts of one class, and rows of one text, that meet as one unit.
UNIT = 1000


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: rows whose texts differ but look the same.

    Pairs are formed between the different texts of a class and expanded to rows
    only at the end, by joins; a class of exact copies forms none. Both sides of a
    large class, and the rows of a text with many copies, are parted into units, so
    no task holds a whole class. ``classes`` has the same groups with one row per text.
    """
    rows = checkpoint(same_look(docs, id_col, text_col).withColumnRenamed(id_col, "doc"))
    # Different texts of one look first: a class of copies, however large, is one text here.
    counted = rows.groupBy("class_id", "text_id").agg(F.count(F.lit(1)).alias("copies"))
    several = counted.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("units"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    texts = checkpoint(counted.join(several, "class_id").withColumn("unit", F.pmod(F.xxhash64("text_id"), F.col("units")).cast("int")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = texts.select("class_id", F.col("unit").alias("unit_a"), F.col("text_id").alias("text_a"), F.col("copies").alias("copies_a"), every("units").alias("unit_b"))
    b = texts.select("class_id", F.col("unit").alias("unit_b"), F.col("text_id").alias("text_b"), F.col("copies").alias("copies_b"), every("units").alias("unit_a"))
    pairs = a.join(b, ["class_id", "unit_a", "unit_b"]).where(F.col("text_a") < F.col("text_b"))
    for side in ("a", "b"):
        pairs = pairs.withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.floor((F.col(f"copies_{side}") - 1) / UNIT).cast("int"))))
    # Rows of a text with a unit number of their own; only texts that are in a pair have rows here.
    parted = rows.join(texts.select("text_id", F.ceil(F.col("copies") / UNIT).alias("parts")), "text_id").select("text_id", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc")
    left = parted.select(F.col("text_id").alias("text_a"), F.col("part").alias("part_a"), F.col("doc").alias("x"))
    right = parted.select(F.col("text_id").alias("text_b"), F.col("part").alias("part_b"), F.col("doc").alias("y"))
    found = pairs.select("text_a", "part_a", "text_b", "part_b").join(left, ["text_a", "part_a"]).join(right, ["text_b", "part_b"])
    return found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
