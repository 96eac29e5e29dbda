"""Table-generating operators that cut documents into chunks. None of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillmesh.functions.text import flatten_texts, normalize, strip

MARKER = r"\[\[page(\d+)\]\]"


def check_sizes(size: int, overlap: int) -> None:
    """Sizes a splitter accepts; an overlap as large as the chunk would never end."""
    if not 0 < size <= 100_000:
        raise ValueError("chunk size must be in 1..100000")
    if not 0 <= overlap < size:
        raise ValueError("chunk overlap must be at least 0 and below the chunk size")


def _as_text(docs: DataFrame, text_col: str) -> Column:
    """The text of a column: lists of texts joined by blanks without their empty items, other values as they are written, null as null."""
    kind = docs.schema[text_col].dataType
    column = F.col(f"`{text_col}`")
    if isinstance(kind, ArrayType):
        return flatten_texts(column.cast("array<string>"))
    return column if isinstance(kind, StringType) else column.cast("string")


def _starts(text: Column, step: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))


def _rest(df: DataFrame, *drop: str) -> list[Column]:
    """All other columns; those named like a new one are replaced by it."""
    drop = (*drop, "chunk_idx", "chunk_start", "chunk", "page_number", "heading")
    return [F.col(f"`{c}`") for c in df.columns if c not in drop]


def fixed(docs: DataFrame, text_col: str = "text", size: int = 700, overlap: int = 250) -> DataFrame:
    """Overlapping windows of ``size`` characters over the stripped text.

    Adds chunk_idx, chunk_start and chunk; the text column is dropped. A window
    wholly inside the one before is still emitted, an empty one is not. Null and
    blank texts give no row. Here an overlap of the size or more steps by 1.
    """
    if size < 1 or overlap < 0:
        raise ValueError("chunk size must be positive and the overlap not negative")
    step = max(size - overlap, 1)
    rest = _rest(docs, text_col)
    stripped = docs.select(*rest, strip(_as_text(docs, text_col)).alias("_text")).where(F.length("_text") > 0)
    parts = F.transform(_starts(F.col("_text"), step), lambda p: F.struct(p.alias("start"), strip(F.substring(F.col("_text"), p + 1, F.lit(size))).alias("chunk")))
    kept = F.filter(parts, lambda c: c.chunk != "")
    return stripped.select(*rest, F.posexplode(kept).alias("chunk_idx", "_c")).select(*rest, "chunk_idx", F.col("_c.start").alias("chunk_start"), F.col("_c.chunk").alias("chunk"))


def page_markers(text: Column) -> Column:
    """ARRAY<STRUCT<pos, page>> of the markers, positions counted in the text without markers."""
    pieces = F.split(text, r"\[\[page\d+\]\]")
    pages = F.regexp_extract_all(text, F.lit(MARKER), 1)
    ends = F.aggregate(
        pieces,
        F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at")),
        lambda s, p: F.struct(F.concat(s.ends, F.array(s.at + F.length(p))).alias("ends"), (s.at + F.length(p)).alias("at")),
        lambda s: s.ends,
    )
    return F.transform(pages, lambda p, k: F.struct(F.get(ends, k).alias("pos"), p.cast("int").alias("page")))


def paged(docs: DataFrame, text_col: str = "text", size: int = 700, overlap: int = 250) -> DataFrame:
    """Windows over the text without its page markers, each with the page it starts on.

    The page is that of the last marker at or before the window's start, 1 before
    the first. The document itself isn't stripped.
    """
    check_sizes(size, overlap)
    rest = _rest(docs, text_col)
    text = _as_text(docs, text_col)
    prepared = docs.select(*rest, page_markers(text).alias("_marks"), F.regexp_replace(text, MARKER, "").alias("_text")).where(F.length("_text") > 0)
    parts = F.transform(_starts(F.col("_text"), size - overlap), lambda p: F.struct(p.alias("start"), strip(F.substring(F.col("_text"), p + 1, F.lit(size))).alias("chunk")))
    kept = F.filter(parts, lambda c: c.chunk != "")
    cut = prepared.select(*rest, "_marks", F.posexplode(kept).alias("chunk_idx", "_c"))
    page = F.coalesce(F.get(F.filter("_marks", lambda m: m.pos <= F.col("_c.start")), F.size(F.filter("_marks", lambda m: m.pos <= F.col("_c.start"))) - 1).page, F.lit(1))
    return cut.select(*rest, "chunk_idx", F.col("_c.start").alias("chunk_start"), F.col("_c.chunk").alias("chunk"), page.alias("page_number"))


def split_documents(docs: DataFrame, text_col: str = "page_content", type_col: str = "file_type", size: int = 700, overlap: int = 250) -> DataFrame:
    """Paged splitting for .pdf, fixed for all others (null types too); chunks normalised after the cut.

    Chunks of which normalising leaves nothing are dropped. ``page_number`` is null
    for other types.
    """
    return _cut_documents(docs, text_col, type_col, size, overlap).where(F.col("chunk").isNotNull())


def _cut_documents(docs: DataFrame, text_col: str, type_col: str, size: int, overlap: int) -> DataFrame:
    """All chunks, normalised; null where nothing is left."""
    is_pdf = F.coalesce(F.col(type_col) == ".pdf", F.lit(False))
    cut = paged(docs.where(is_pdf), text_col, size, overlap).unionByName(fixed(docs.where(~is_pdf), text_col, size, overlap).withColumn("page_number", F.lit(None).cast("int")))
    return cut.withColumn("chunk", normalize(F.col("chunk")))


def split_counts(docs: DataFrame, text_col: str = "page_content", type_col: str = "file_type", size: int = 700, overlap: int = 250) -> DataFrame:
    """(file_type, documents, chunks, skipped, characters): what splitting makes of the documents of each type.

    ``skipped`` counts the chunks of which normalising leaves nothing; documents
    without text count as documents only.
    """
    cut = _cut_documents(docs.select(type_col, text_col), text_col, type_col, size, overlap)
    chunks = cut.select(F.col(type_col).alias("_type"), F.lit(0).alias("_document"), F.length("chunk").alias("_n"), F.lit(1).alias("_chunk"))
    every = docs.select(F.col(type_col).alias("_type"), F.lit(1).alias("_document"), F.lit(None).cast("int").alias("_n"), F.lit(0).alias("_chunk")).unionAll(chunks)
    kept = F.col("_n").isNotNull()
    return every.groupBy(F.col("_type").alias(type_col)).agg(
        F.sum("_document").alias("documents"), F.count_if(kept).alias("chunks"), F.count_if((F.col("_chunk") == 1) & ~kept).alias("skipped"), F.coalesce(F.sum("_n"), F.lit(0)).alias("characters")
    )


def headings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One chunk per heading: a line whose stripped form starts with ``###``, up to the next.

    Text before the first heading is dropped; blank lines too, but for the one
    right below the heading. Adds chunk_idx, heading and chunk.
    """
    rest = _rest(docs, text_col)
    lines = F.split(F.col(text_col), "\n")
    step = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("fresh")),
        lambda s, line: F.when(
            F.startswith(strip(line), F.lit("###")),
            F.struct(F.when(s.now.isNull(), s.done).otherwise(F.concat(s.done, F.array(s.now))).alias("done"), line.alias("now"), F.lit(True).alias("fresh")),
        )
        .when(s.now.isNull() | ((strip(line) == "") & ~s.fresh), F.struct(s.done.alias("done"), s.now.alias("now"), F.lit(False).alias("fresh")))
        .otherwise(F.struct(s.done.alias("done"), F.concat(s.now, F.lit("\n"), line).alias("now"), F.lit(False).alias("fresh"))),
        lambda s: F.when(s.now.isNull(), s.done).otherwise(F.concat(s.done, F.array(s.now))),
    )
    cut = docs.select(*rest, F.posexplode(F.transform(step, strip)).alias("chunk_idx", "chunk"))
    return cut.withColumn("heading", strip(F.regexp_replace(F.substring_index("chunk", "\n", 1), "^#+", "")))


def length_stats(chunks: DataFrame, text_col: str = "chunk", id_cols: tuple[str, ...] = ("doc_id", "chunk_idx")) -> DataFrame:
    """One row: number of chunks, shortest, longest and mean length, and the first chunk of either length."""
    length = F.length(text_col)
    key = F.struct(*id_cols)
    return chunks.agg(
        F.count(text_col).alias("chunks"),
        F.min(length).alias("shortest"),
        F.max(length).alias("longest"),
        F.avg(length).alias("mean_length"),
        F.min_by(key, F.struct(length, key)).alias("_short"),
        F.min_by(key, F.struct(-length, key)).alias("_long"),
    ).select("chunks", "shortest", "longest", "mean_length", *(F.col(f"_short.{c}").alias(f"shortest_{c}") for c in id_cols), *(F.col(f"_long.{c}").alias(f"longest_{c}") for c in id_cols))


def oversize(chunks: DataFrame, text_col: str = "chunk", tokens: int = 512, chars_per_token: int = 4) -> DataFrame:
    """Chunks that exceed a model's tokens, by characters."""
    return chunks.where(F.length(text_col) > tokens * chars_per_token)


def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(doc, text): pages in order, each non-blank one behind its marker, blank ones left out."""
    marked = F.when(strip(F.col(text_col)) != "", F.concat(F.lit("[[page"), F.col(page_col), F.lit("]]"), F.col(text_col)))
    return (
        pages.groupBy(doc_col)
        .agg(F.array_sort(F.collect_list(F.when(marked.isNotNull(), F.struct(F.col(page_col).alias("p"), marked.alias("t"))))).alias("_pages"))
        .select(doc_col, F.array_join(F.transform("_pages", lambda x: x.t), "").alias(text_col))
    )
