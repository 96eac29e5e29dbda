"""Problem 5: cut oversized items into overlapping pieces at natural boundaries.

Method: recursive bisection. A span that exceeds the limit less the overlap is
cut at the strongest boundary near its midpoint (paragraph, then line, sentence,
clause, word), and both halves are treated alike until they fit. Overlaps are
attached afterwards: a piece begins up to ``overlap`` characters before its own
span, at the start of a sentence or word if one lies there, and at least one
character before.

Defined results: a null or empty text gives no piece; a text within the limit
gives one piece, the text itself; nothing is trimmed and page markers count.
Characters are Unicode code points. A cut with no boundary near falls in the
middle, but never between a letter and its combining marks. Repeated rows give
the same pieces each.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 250

#: Boundaries from strong to weak; a cut falls at the end of the match.
_KINDS = [
    re.compile(r"\n[^\S\n]*\n\s*|(?=\[\[page\d+\]\])"),
    re.compile(r"\n"),
    re.compile(r"[.!?…;·][\"'”’»)\]]*\s+"),
    re.compile(r"[,:–—]\s+"),
    re.compile(r"\s+"),
]


class _Boundaries:
    def __init__(self, text: str):
        self.text = text
        self.at = [[m.end() for m in kind.finditer(text)] for kind in _KINDS]

    def between(self, kind: int, low: int, high: int) -> list[int]:
        """Boundaries of one kind with low <= position <= high."""
        at = self.at[kind]
        return at[bisect_left(at, low) : bisect_right(at, high)]

    def near(self, middle: int, low: int, high: int) -> int:
        """The strongest boundary in [low, high], the nearest to the middle among equals."""
        for kind in range(len(_KINDS)):
            at = self.at[kind]
            k = bisect_left(at, middle)
            found = [p for p in at[max(0, k - 1) : k + 1] if low <= p <= high]
            if found:
                return min(found, key=lambda p: (abs(p - middle), p))
        return self.whole(middle, low)

    def whole(self, at: int, low: int) -> int:
        """The nearest place at or before ``at`` that doesn't part a character from its marks."""
        k = at
        while k > low and _joined(self.text, k):
            k -= 1
        return k if k > low else at


def _joined(text: str, at: int) -> bool:
    if not at:
        return False
    here = text[at]
    return unicodedata.combining(here) != 0 or here in "‍︎️" or text[at - 1] == "‍" or "\U0001f3fb" <= here <= "\U0001f3ff"


def bisect_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, overlaps attached."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    bounds, most = _Boundaries(text), limit - overlap
    cores, open_spans = [], [(0, len(text))]
    while open_spans:
        start, end = open_spans.pop()
        if end - start <= most:
            cores.append((start, end))
            continue
        quarter = (end - start) // 4
        cut = bounds.near((start + end) // 2, start + quarter, end - quarter)
        open_spans += [(cut, end), (start, cut)]
    return [cores[0], *((_overlap_start(bounds, a, overlap), b) for a, b in cores[1:])]


def _overlap_start(bounds: _Boundaries, cut: int, overlap: int) -> int:
    """Where a piece whose own span starts at ``cut`` begins: within the last ``overlap`` characters before it."""
    low = max(0, cut - overlap)
    for kinds in ((0, 1, 2), (4,)):
        found = [p[0] for kind in kinds if (p := bounds.between(kind, low, cut - 1))]
        if found:
            return min(found)
    while low < cut - 1 and _joined(bounds.text, low):
        low += 1
    return low


def split_spans(items: DataFrame, text_col: str = "page_content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``items`` plus ``spans ARRAY<STRUCT<start INT, stop INT>>`` of the operator's pieces; no shuffle.

    ``limit`` must exceed ``2 * overlap``, so that every piece adds text of its own.
    """
    if not 0 < 2 * overlap < limit:
        raise ValueError("limit must exceed twice the overlap, and the overlap 0")
    items = items.drop("spans")  # a column of that name is replaced
    struct = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    columns = items.columns
    where = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "stop": b} for a, b in bisect_spans(t, limit, overlap)] if t else [] for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(struct))], names=[*columns, "spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "spans array<struct<start:int,stop:int>>"])
    return items.mapInArrow(run, schema)


def pieces(spans: DataFrame, text_col: str = "page_content") -> DataFrame:
    """One row per piece: the other columns (those named like a new one are replaced), ``piece_no`` from 0, ``start``, ``stop`` and ``piece``; cut JVM-side."""
    rest = [F.col(f"`{c}`") for c in spans.columns if c not in (text_col, "spans", "piece_no", "start", "stop", "piece")]
    return spans.select(*rest, F.col(text_col).alias("_text"), F.posexplode("spans").alias("piece_no", "_span")).select(
        *rest, "piece_no", F.col("_span.start").alias("start"), F.col("_span.stop").alias("stop"), _slice("_text", "_span").alias("piece")
    )


def checked(spans: DataFrame, text_col: str = "page_content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, items, characters, whole, cut, too_long, without_overlap): what the pieces of all items amount to, counted by source.

    ``whole`` counts the items whose pieces, overlaps left out, are the text again;
    ``too_long`` pieces beyond the limit, ``without_overlap`` pieces but the first
    that begin with no or with more than ``overlap`` characters of the one before.
    """
    text, first = F.col(text_col), F.col("spans")[0]
    ends = F.transform("spans", lambda s: s.stop)
    # Each piece from where the one before it ended.
    own = F.transform("spans", lambda s, k: F.substring(text, F.coalesce(F.get(ends, k - 1), first.start) + 1, s.stop - F.coalesce(F.get(ends, k - 1), first.start)))
    common = F.transform(F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0))), lambda s, k: F.get(ends, k) - s.start)
    sizes = spans.select(
        "src",
        F.length(text).alias("n"),
        (F.array_join(own, "") == text).alias("again"),
        F.size("spans").alias("pieces"),
        F.size(F.filter("spans", lambda s: s.stop - s.start > limit)).alias("long"),
        F.size(F.filter(common, lambda n: (n < 1) | (n > overlap))).alias("bare"),
    )
    return sizes.groupBy("src").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("n").alias("characters"),
        F.count_if(F.col("again") & (F.col("pieces") > 0)).alias("whole"),
        F.count_if(F.col("pieces") > 1).alias("cut"),
        F.coalesce(F.sum("long"), F.lit(0)).cast("int").alias("too_long"),
        F.coalesce(F.sum("bare"), F.lit(0)).cast("int").alias("without_overlap"),
    )


def _slice(text: str, span: str) -> Column:
    return F.substring(F.col(text), F.col(f"{span}.start") + 1, F.col(f"{span}.stop") - F.col(f"{span}.start"))


def all_items(metadata: DataFrame, records: DataFrame) -> DataFrame:
    """(src, item_key, page_content) of both tables' items."""
    return metadata.select(F.lit("document_metadata").alias("src"), F.col("id").cast("string").alias("item_key"), "page_content").unionAll(
        records.select(F.lit("document_records").alias("src"), F.col("file_path").alias("item_key"), "page_content")
    )


def oversized(metadata: DataFrame, records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, item_key) of the items that the operator cuts; once for each key. A record without a path has no key and is left out."""
    # Only an item beyond the limit can have two pieces, so shorter texts need not reach Python.
    long_items = all_items(metadata, records).where((F.length("page_content") > limit) & F.col("item_key").isNotNull())
    return split_spans(long_items, limit=limit, overlap=overlap).where(F.size("spans") > 1).select("src", "item_key").distinct()
