"""Unions, differences, look-ups with a fallback and rankings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a registry that is broadcast.
REGISTRY = 10_000


def union_sources(*sources: DataFrame) -> DataFrame:
    """Documents, transcripts and captions in one table, with the number of their source; missing columns null."""
    tagged = [s.withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def first_of_content(docs: DataFrame, hash_col: str = "hash", order_col: str = "id") -> DataFrame:
    """One row per content hash, the least id; rows without a hash all stay. Map-side combined, so hot hashes are harmless."""
    key = (F.col(hash_col).isNotNull()) & (F.col(hash_col) != "")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.where(key).groupBy(F.lower(hash_col).alias("_h")).agg(F.min_by(F.struct(*columns), order_col).alias("r")).select("r.*")
    return once.unionByName(docs.where(~key | F.col(hash_col).isNull()))


def set_difference(current: DataFrame, latest: DataFrame, column: str) -> DataFrame:
    """(value, change): added or removed values, each once."""
    now, then = latest.select(column), current.select(column)
    added = now.distinct().join(then.distinct(), column, "left_anti").withColumn("change", F.lit("added"))
    return added.unionAll(then.distinct().join(now.distinct(), column, "left_anti").withColumn("change", F.lit("removed")))


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, table_name: str, value: str, default: str) -> DataFrame:
    """``rows`` plus ``value``: by equal key, else by the first name the key contains, else the default.

    ``table`` is a registry that is broadcast; one of more than ``REGISTRY`` rows is an error.
    """
    if table.limit(REGISTRY + 1).count() > REGISTRY:
        raise ValueError(f"a registry has at most {REGISTRY} rows")
    registry = F.broadcast(table.select(F.col(table_key).alias("_k"), F.col(table_name).alias("_n"), F.col(value).alias("_v")))
    keys = rows.select(key).distinct()
    found = keys.join(registry, (F.col("_k") == F.col(key)) | F.contains(F.col(key), F.col("_n")), "left")
    best = found.groupBy(key).agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct(F.when(F.col("_k") == F.col(key), 0).otherwise(1), "_n"))).alias(value))
    return rows.join(best.withColumn(value, F.coalesce(value, F.lit(default))), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def glob_pattern(glob: str) -> str:
    """A shell pattern as an anchored regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def kept_by_globs(name: Column, allow: list[str], ignore: list[str]) -> Column:
    """Whether a name matches no ignored pattern and, if any is allowed, one of those."""
    def hit(globs: list[str]) -> Column:
        return F.lit(False) if not globs else name.rlike("|".join(map(glob_pattern, globs)))

    return ~hit(ignore) & (hit(allow) if allow else F.lit(True))


def percent_of_max(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` plus a column's share of its greatest value in percent; the greatest is one aggregated row."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(column).alias("_max")))).withColumn(name, F.col(column) / F.col("_max") * 100).drop("_max")


def ranked_between(rows: DataFrame, range_col: str, low: float, high: float, by: str, tie: str) -> DataFrame:
    """Rows whose ``range_col`` lies in a closed range, with rank by another column, greatest first."""
    return rows.where(F.col(range_col).between(low, high)).orderBy(F.desc(by), tie)


def running_total(rows: DataFrame, key: list[str], order: list[str], by: Column, value: Column, name: str) -> DataFrame:
    """``rows`` plus the running sum of ``value`` within a key, in order; ``by`` parts a key's rows into slices that keep the order.

    The sums of the slices are combined before the shuffle and added up over the
    few slices; within a slice rows are added up alone. So a key with a large share
    of all rows is worked on by as many tasks as it has slices.
    """
    # Key and slice as one struct, in which nulls are equal: rows are shuffled by it once, for their sums and for the join.
    sliced = rows.select("*", F.struct(*key, by.alias("_slice")).alias("_key_slice"), value.alias("_value"))
    totals = sliced.groupBy("_key_slice").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*(F.col(f"_key_slice.`{c}`") for c in key)).orderBy("_key_slice._slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_key_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_key_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sliced.withColumn("_own", F.sum("_value").over(within)).join(before, "_key_slice")
    return summed.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), (F.col("_own") + F.col("_before")).alias(name))


def children_by_hash(chunks: DataFrame, docs: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Chunks with the id of their document: a join on content hash that survives a hot hash.

    The documents are first reduced to one row per hash; a chunk of a hash without
    a document (deleted since) has a null id. The small side of a hot hash is one
    row, so splitting the hot partition (adaptive skew join) loses nothing.
    """
    owner = docs.where(F.col(hash_col).isNotNull() & (F.col(hash_col) != "")).groupBy(F.lower(hash_col).alias("_h")).agg(F.min("id").alias("document_id"), F.count(F.lit(1)).alias("copies"))
    return chunks.withColumn("_h", F.lower(hash_col)).join(owner, "_h", "left").drop("_h")


def consecutive_runs(rows: DataFrame, partition: str, order: str, value: Column) -> DataFrame:
    """``rows`` plus whether the value repeats that of the row before."""
    return rows.withColumn("repeats", F.coalesce(value.eqNullSafe(F.lag(value).over(Window.partitionBy(partition).orderBy(order))), F.lit(False)))
