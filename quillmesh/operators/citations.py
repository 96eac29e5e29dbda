"""Sources of an answer: scores and pages by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import escape_html


def score_range(low: Column, high: Column) -> Column:
    """One score, or least and greatest, with four decimals."""
    a, b = F.format_string("%.4f", F.bround(low, 4)), F.format_string("%.4f", F.bround(high, 4))
    return F.when(low == high, a).otherwise(F.concat(a, F.lit("-"), b))


def page_ranges(pages: DataFrame, keys: list[str], page_col: str = "page_number") -> DataFrame:
    """(keys, pages): runs of consecutive pages as 1-3, 7; nulls skipped. Gaps and islands, in two aggregations."""
    distinct = pages.where(F.col(page_col).isNotNull()).select(*keys, page_col).distinct()
    island = F.col(page_col) - F.row_number().over(Window.partitionBy(*keys).orderBy(page_col))
    runs = distinct.withColumn("_run", island).groupBy(*keys, "_run").agg(F.min(page_col).alias("_a"), F.max(page_col).alias("_b"))
    label = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", "_a", "_b"))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_a").alias("a"), label.alias("l")))), lambda x: x.l), ", ").alias("pages"))


def page_ranges_of(pages: Column) -> Column:
    """The same for an array column."""
    ordered = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    start = F.array().cast("array<struct<a:int,b:int>>")
    grown = lambda s, p: F.when(
        (F.size(s) > 0) & (F.get(s, F.size(s) - 1).b == p - 1), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.get(s, F.size(s) - 1).a.alias("a"), p.alias("b"))))
    ).otherwise(F.concat(s, F.array(F.struct(p.alias("a"), p.alias("b")))))
    runs = F.aggregate(ordered, start, grown)
    return F.array_join(F.transform(runs, lambda r: F.when(r.a == r.b, r.a.cast("string")).otherwise(F.concat(r.a.cast("string"), F.lit("-"), r.b.cast("string")))), ", ")


def citations(hits: DataFrame, score_col: str = "similarity_score") -> DataFrame:
    """One row per file_path: file_name, min_score, max_score, scores, pages; pages only for PDF files.

    Expects file_path, file_name, file_type, page_number, a score and rank. The
    name and type are those of the best-ranked hit. Least score first, then path.
    """
    pdf = F.lower("file_type") == ".pdf"
    grouped = hits.groupBy("file_path").agg(
        F.min_by("file_name", "rank").alias("file_name"),
        F.min_by("file_type", "rank").alias("file_type"),
        F.min(score_col).alias("min_score"),
        F.max(score_col).alias("max_score"),
        F.collect_set(F.when(pdf, F.col("page_number"))).alias("_pages"),
    )
    return grouped.select(
        "file_path",
        "file_name",
        "min_score",
        "max_score",
        score_range(F.col("min_score"), F.col("max_score")).alias("scores"),
        F.when(F.col("file_type") == ".pdf", F.nullif(page_ranges_of(F.col("_pages")), F.lit(""))).alias("pages"),
    ).orderBy("min_score", "file_path")


def citation_list(cited: DataFrame) -> DataFrame:
    """One row: the citations as an ordered HTML list."""
    item = F.concat(
        F.lit('<li><a href="file:'), escape_html(F.col("file_path")), F.lit('">'), escape_html(F.coalesce(F.col("file_name"), F.lit("Unknown"))), F.lit("</a> ["), F.col("scores"), F.lit("]"),
        F.when(F.col("pages").isNotNull(), F.concat(F.lit(" Pages: "), F.col("pages"))).otherwise(""), F.lit("</li>"),
    )
    rows = F.array_sort(F.collect_list(F.struct(F.col("min_score").alias("s"), item.alias("i"))))
    return cited.agg(F.concat(F.lit("<ol>"), F.array_join(F.transform(rows, lambda x: x.i), ""), F.lit("</ol>")).alias("html"))


def dump(hits: DataFrame, columns: list[str], folder: str) -> None:
    """One line of JSON per hit, in rank order: the record of an answer's sources. A result is bounded by k, so it is one file."""
    hits.orderBy("rank").select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(folder)
