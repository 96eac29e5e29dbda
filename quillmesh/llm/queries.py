"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import encode, garbled, looks, mail, near, pack, scans, split
from quillmesh.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near.similar_pairs(table(spark, d, "document_metadata"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.groups(table(spark, d, "document_metadata"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "document_metadata"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "document_metadata"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mail.newly_written(table(spark, d, "document_metadata"))


def p3_structure(spark: SparkSession, d: str) -> DataFrame:
    return mail.structure(table(spark, d, "document_metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_lines(table(spark, d, "document_metadata"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "document_metadata"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "document_metadata"), table(spark, d, "document_records"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = split.all_items(table(spark, d, "document_metadata"), table(spark, d, "document_records"))
    return split.pieces(split.split_spans(items))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    items = split.all_items(table(spark, d, "document_metadata"), table(spark, d, "document_records"))
    return split.checked(split.split_spans(items))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_alike_pairs(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return looks.classes(table(spark, d, "documents")).select("doc_id", "copies", "others")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return looks.common_form(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_restored, p3_found, p3_structure, p4_found, p4_repaired, p5_found, p5_pieces, p5_checked, p6_ids, p7_containers, p8_found, p8_classes, p8_forms)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_checked": """
            SELECT src, count(*) AS items, CAST(sum(length(page_content)) AS BIGINT) AS characters, count(*) FILTER (WHERE length(page_content) > 0) AS whole, count(*) FILTER (WHERE length(page_content) > 2000) AS cut, 0 AS too_long, 0 AS without_overlap
            FROM (SELECT 'document_metadata' AS src, page_content FROM document_metadata UNION ALL SELECT 'document_records', page_content FROM document_records) GROUP BY src
        """,
        "p1_found": r"""
            WITH texts AS (SELECT id, list_filter(string_split_regex(lower(page_content), '[ \t\r\n\f]+'), lambda x: x <> '') AS w FROM document_metadata),
            sets AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs FROM texts WHERE len(w) >= 30),
            runs AS (SELECT id, len(runs) AS n, unnest(runs) AS run FROM sets),
            shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS n_a, any_value(b.n) AS n_b FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
            SELECT id_a, id_b FROM shared WHERE c >= 0.6 * (n_a + n_b - c)
        """,
        "p5_found": """
            SELECT DISTINCT src, item_key FROM (
                SELECT 'document_metadata' AS src, CAST(id AS VARCHAR) AS item_key, page_content FROM document_metadata
                UNION ALL SELECT 'document_records', file_path, page_content FROM document_records)
            WHERE length(page_content) > 2000 AND item_key IS NOT NULL
        """,
    }
