"""Exact nearest-neighbour search and what is built from its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import clean_context
from quillmesh.functions.vectors import cosine, similarity
from quillmesh.plans.config import QueryConfig

#: Bytes of query vectors that are held at once: up to them all queries are broadcast; beyond, blocks of so many bytes meet blocks of the corpus.
QUERY_BYTES = 64 << 20
#: Rows of a block of the corpus, and queries that are multiplied at a time.
BLOCK, SLICE = 4096, 512

# The instruction before the contexts, the advice when nothing is found, and what parts the contexts.
RAG_INSTRUCTION = "Here are the contexts to base your answer on.  However, I need to reiterate that I only want you to base your response on these contexts and do not use outside knowledge that you may have been trained with."
NO_RESULT = "No chunks passed the similarity threshold.\n\nTry lowering the 'Similarity' setting in the Database Query settings tab (e.g. from 0.7 to 0.4) and run the query again."
SEPARATOR = "\n\n---\n\n"

Encoder = Callable[[str], list[float]]


def topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, similarity_score, distance, rank): the k nearest by cosine, ties by id.

    Only id and vector are read; each task keeps its k best, so k rows per task
    reach the last one. Vectors without a direction (null, zero, other length) take no part.
    """
    cos = cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query)))
    best = vectors.select(F.col(id_col), cos.alias("_cos")).where(F.col("_cos").isNotNull()).orderBy(F.desc("_cos"), id_col).limit(k)
    return best.select(
        id_col,
        similarity(F.col("_cos")).alias("similarity_score"),
        (1 - F.col("_cos")).alias("distance"),
        F.row_number().over(Window.orderBy(F.desc("_cos"), id_col)).alias("rank"),
    )


def topk_of(vectors: DataFrame, query_id: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", asked: DataFrame | None = None) -> DataFrame:
    """``topk`` for a vector of the table itself (or of ``asked``), which stays on the executors."""
    query = (vectors if asked is None else asked).where(F.col(id_col) == query_id).select(F.col(vector_col).alias("_query")).limit(1)
    best = (
        vectors.select(id_col, vector_col).crossJoin(F.broadcast(query)).select(id_col, cosine(F.col(vector_col), F.col("_query")).alias("_cos")).where(F.col("_cos").isNotNull()).orderBy(F.desc("_cos"), id_col).limit(k)
    )
    return best.select(id_col, similarity(F.col("_cos")).alias("similarity_score"), (1 - F.col("_cos")).alias("distance"), F.row_number().over(Window.orderBy(F.desc("_cos"), id_col)).alias("rank"))


def _best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of one block for each query."""
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, np.nan, n)
    scores = unit(queries) @ unit(vectors).T
    scores = np.where(np.isnan(scores), -np.inf, scores)
    out = []
    for q, row in zip(query_ids, scores):
        if len(row) > k:
            edge = np.partition(row, -k)[-k]
            kept = np.flatnonzero(row >= edge)  # ties at the edge stay, the final rank decides
        else:
            kept = np.arange(len(row))
        kept = kept[np.isfinite(row[kept])]
        kept = kept[np.lexsort((ids[kept], -row[kept]))][:k]
        out.append(pd.DataFrame({"query_id": q, "id": ids[kept], "cos": row[kept]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "cos": []})


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _slices(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(query_ids), SLICE):
        yield _best(ids, vectors, query_ids[start : start + SLICE], queries[start : start + SLICE], k)


def topk_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity_score, rank): the k nearest for every query row, as blocked matrix products.

    ``queries`` has the columns of ``vectors``. Queries of up to ``QUERY_BYTES`` (counted
    first) are broadcast; more are met in blocks of that size: a block of queries is
    sent to each block of the corpus, which is shuffled as many times as there are
    blocks of queries, and no side is ever whole in one place. Each block keeps k rows
    per query before the last ranking.
    """
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    corpus = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(usable).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("q"))
    schema = "query_id long, id long, cos double"
    count, length = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    held = max(1, QUERY_BYTES // (8 * length))
    if count <= held:
        rows = asked.toPandas().sort_values("query_id")
        shared = corpus.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(np.int64), _matrix(rows["q"]) if count else np.zeros((0, 1))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, matrix = shared.value
            for batch in batches:
                if len(batch) and len(query_ids):
                    yield from _slices(batch["id"].to_numpy(), _matrix(batch["v"]), query_ids, matrix, k)

        partial = corpus.mapInPandas(scan, schema)
    else:
        blocks = -(-count // held)
        parts = max(1, -(-vectors.count() // BLOCK))
        left = corpus.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "id": [], "cos": []})
            return pd.concat(_slices(a["id"].to_numpy(), _matrix(a["v"]), b["query_id"].to_numpy(), _matrix(b["q"]), k))

        partial = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", similarity(F.col("cos")).alias("similarity_score"), "rank")


def attach_payload(hits: DataFrame, store: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    """Fetch the payload of the hits only, which are at most k (``QueryConfig`` allows 1,000) and so broadcast; a hit without a row is dropped."""
    return F.broadcast(hits).join(store.select(id_col, *payload), id_col)


def realigned(chunks: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """The chunks that were embedded; those of failed batches are left out."""
    return chunks.join(survivors.select(key), key, "left_semi")


def post_filter(hits: DataFrame, config: QueryConfig, text_col: str = "text", type_col: str = "document_type") -> DataFrame:
    """Threshold, search term and document type, applied after the k nearest are chosen; so fewer may remain.

    The term is a substring in any letter case (no pattern); an empty term or type keeps all.
    """
    kept = hits.where(F.col("similarity_score") >= config.similarity)
    if config.search_term:
        kept = kept.where(F.contains(F.lower(F.col(text_col)), F.lit(config.search_term.lower())))
    if config.document_types:
        kept = kept.where(F.col(type_col) == config.document_types)
    return kept


def search(vectors: DataFrame, store: DataFrame, query_id: int, config: QueryConfig, store_id: str = "doc_id", text_col: str = "text", type_col: str = "document_type", prefilter: bool = False) -> DataFrame:
    """Nearest chunks of a query vector with their payload, filtered, in rank order.

    With ``prefilter`` term and type are asked of the store first, and the k nearest
    are chosen among the chunks that pass: k rows come out if so many pass.
    """
    among = _allowed(vectors, store, config, store_id, text_col, type_col) if prefilter else vectors
    hits = topk_of(among, query_id, config.contexts, asked=vectors).withColumnRenamed("vec_id", store_id)
    return _with_payload(hits, store, config, store_id, text_col, type_col)


def search_text(vectors: DataFrame, store: DataFrame, question: str, config: QueryConfig, encode: Encoder, store_id: str = "doc_id", text_col: str = "text", type_col: str = "document_type") -> DataFrame:
    """``search`` for a question in words: ``encode`` gives its vector, which must be what encoded the stored chunks."""
    hits = topk(vectors, encode(question), config.contexts).withColumnRenamed("vec_id", store_id)
    return _with_payload(hits, store, config, store_id, text_col, type_col)


def _with_payload(hits: DataFrame, store: DataFrame, config: QueryConfig, store_id: str, text_col: str, type_col: str) -> DataFrame:
    return post_filter(attach_payload(hits, store, store_id, [c for c in store.columns if c != store_id]), config, text_col, type_col)


def _allowed(vectors: DataFrame, store: DataFrame, config: QueryConfig, store_id: str, text_col: str, type_col: str) -> DataFrame:
    """The vectors of the chunks that pass term and type."""
    every = store.withColumn("similarity_score", F.lit(1.0))
    passed = post_filter(every, config, text_col, type_col).select(F.col(store_id).alias("vec_id"))
    return vectors.join(passed, "vec_id", "left_semi")


def context_block(rank: Column, name: Column, text: Column) -> Column:
    """A chunk under a ruled heading."""
    rule = "-" * 80
    return F.concat(F.lit(f"{rule}\nCONTEXT "), rank.cast("string"), F.lit(" | "), F.coalesce(name, F.lit("Unknown")), F.lit(f"\n{rule}\n"), clean_context(text), F.lit("\n"))


def contexts(hits: DataFrame, name_col: str, text_col: str = "text") -> DataFrame:
    """(position, block): hits numbered anew in rank order, each formatted."""
    position = F.row_number().over(Window.orderBy("rank"))
    return hits.select(position.alias("position"), F.col(name_col).alias("_n"), F.col(text_col).alias("_t")).select("position", context_block(F.col("position"), F.col("_n"), F.col("_t")).alias("block"))


def joined_in_order(rows: DataFrame, text: Column, order: str, separator: str, name: str) -> DataFrame:
    """One row: texts joined in order. For the few rows of a result, bounded by k."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x.t), separator).alias(name))


def chunks_only(hits: DataFrame, name_col: str, text_col: str = "text") -> DataFrame:
    """One row: the formatted contexts, or the advice when none passed."""
    blocks = contexts(hits, name_col, text_col)
    return joined_in_order(blocks, F.col("block"), "position", "\n", "_all").select(F.when(F.col("_all") == "", NO_RESULT).otherwise(F.col("_all")).alias("response"))


def prompt(hits: DataFrame, question: str, text_col: str = "text") -> DataFrame:
    """One row: instruction, contexts and question."""
    return joined_in_order(hits, F.col(text_col), "rank", SEPARATOR, "_ctx").select(F.concat(F.lit(RAG_INSTRUCTION + SEPARATOR), F.col("_ctx"), F.lit("\n\n-----\n\n" + question)).alias("prompt"))


def token_budget(hits: DataFrame, question: str, max_length: int, response: str = "", text_col: str = "text", chars_per_token: float = 4.0) -> DataFrame:
    """One row of token counts by characters, with whether the contexts fit (100 tokens are kept free)."""
    tokens = lambda n: F.ceil(n / F.lit(chars_per_token)).cast("int")
    total = joined_in_order(hits, F.col(text_col), "rank", SEPARATOR, "_ctx").select(tokens(F.length("_ctx")).alias("context_tokens"))
    return total.select(
        "context_tokens",
        tokens(F.lit(len(RAG_INSTRUCTION))).alias("rag_tokens"),
        tokens(F.lit(len(question))).alias("query_tokens"),
        tokens(F.lit(len(response))).alias("response_tokens"),
        (F.col("context_tokens") <= max_length - 100).alias("fits"),
        (F.lit(max_length) - F.col("context_tokens") - tokens(F.lit(len(RAG_INSTRUCTION))) - tokens(F.lit(len(question))) - tokens(F.lit(len(response)))).alias("remaining_tokens"),
    )


def distance_stats(hits: DataFrame) -> DataFrame:
    """Least, greatest and mean distance of a result."""
    return hits.agg(F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.avg("distance").alias("mean_distance"))
