"""Length-sorted batches for an encoder, padding, and restoring the order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The default tokenizer: words parted by white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokenize(docs: DataFrame, id_col: str, text_col: str, max_length: int = 512, vocabulary: int = 30_000) -> DataFrame:
    """(id, input_ids, attention_mask): hashed words, truncated; a text without words has no row."""
    ids = F.transform(F.slice(words(F.col(text_col)), 1, max_length), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(vocabulary)).cast("int"))
    return docs.select(F.col(id_col), ids.alias("input_ids")).where(F.size("input_ids") > 0).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def tokenize_with(docs: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[list[str]], list[list[int]]], max_length: int = 512, batch_size: int = 100) -> DataFrame:
    """(id, input_ids, error): a tokenizer of one's own over batches of texts, truncated; null texts count as empty.

    A batch that fails gives rows with ``error`` and no ids; keep ``error IS NULL`` as
    tokens, and pair what survives with its chunks by ``realigned``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, errors = [t or "" for t in batch.column(1).to_pylist()], [], []
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                try:
                    found = [list(x)[:max_length] for x in tokenizer(part)]
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} results for {len(part)} texts")
                    ids, errors = ids + found, errors + [None] * len(part)
                except Exception as problem:  # noqa: BLE001 - the rows carry it
                    ids, errors = ids + [None] * len(part), errors + [f"{type(problem).__name__}: {problem}"] * len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(errors, pa.string())], names=[id_col, "input_ids", "error"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, input_ids array<int>, error string")


def still_to_do(docs: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """The documents that an interrupted run hasn't written yet: what a resumed one starts from."""
    return docs.join(done.select(id_col).distinct(), id_col, "left_anti")


def length_sorted(rows: DataFrame, length: Column, seq_col: str, shard_size: int = 60_000, batch_size: int = 100) -> DataFrame:
    """``rows`` plus shard, position and batch_id: within a shard the longest first, ties by sequence.

    Shards are ranges of the sequence number, so the sort never spans more than
    ``shard_size`` rows, whatever their lengths.
    """
    sharded = rows.withColumn("n_tokens", length).withColumn("shard", F.floor(F.col(seq_col) / shard_size).cast("long"))
    position = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("n_tokens"), seq_col)) - 1
    return sharded.withColumn("position", position).withColumn("batch_id", F.floor(F.col("position") / batch_size).cast("int"))


def batch_stats(batched: DataFrame) -> DataFrame:
    """(shard, batch_id, rows, longest, real_tokens, pad_tokens)."""
    return (
        batched.groupBy("shard", "batch_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("real_tokens"))
        .withColumn("pad_tokens", F.col("rows") * F.col("longest") - F.col("real_tokens"))
    )


def padding_efficiency(stats: DataFrame) -> DataFrame:
    """One row: real and padding tokens, and the share of real ones in percent (100 if there are none)."""
    total = stats.agg(F.coalesce(F.sum("real_tokens"), F.lit(0)).alias("real_tokens"), F.coalesce(F.sum("pad_tokens"), F.lit(0)).alias("pad_tokens"))
    every = F.col("real_tokens") + F.col("pad_tokens")
    return total.withColumn("efficiency", F.when(every == 0, 100.0).otherwise(F.col("real_tokens") / every * 100))


def pad(ids: Column, length: Column, pad_id: int = 0, left: bool = False) -> Column:
    """Ids padded to a length, at either side."""
    fill = F.array_repeat(F.lit(pad_id), (length - F.size(ids)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def padded_batches(tokens: DataFrame, seq_col: str, pad_id: int = 0, left: bool = False, **sizes: int) -> DataFrame:
    """Rows with input_ids and attention_mask padded to their batch's longest."""
    batched = length_sorted(tokens, F.size("input_ids"), seq_col, **sizes)
    longest = F.max("n_tokens").over(Window.partitionBy("shard", "batch_id"))
    return batched.withColumn("_to", longest).withColumn("input_ids", pad(F.col("input_ids"), F.col("_to"), pad_id, left)).withColumn("attention_mask", pad(F.col("attention_mask"), F.col("_to"), 0, left)).drop("_to")


def restore_order(encoded: DataFrame, seq_col: str) -> DataFrame:
    return encoded.orderBy(seq_col)


def word_place(word: str, dimensions: int) -> tuple[int, int]:
    """(dimension, sign) of a word by its md5: the first 28 bits and the one after."""
    digest = md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return int(digest[:7], 16) % dimensions, 1 if digest[7] < "8" else -1


class WordEncoder:
    """Feature hashing of words with signs, to unit length: the stand-in where no model is installed.

    One object encodes stored chunks and questions alike. Words are what white space
    parts in the lower-cased text; a null text and one without words give zeros.
    """

    def __init__(self, dimensions: int = 64):
        self.dimensions, self._known = dimensions, {}

    def _row(self, text: str | None, row: np.ndarray) -> None:
        for word in (text or "").lower().split():
            place = self._known.get(word)
            if place is None:
                if len(self._known) > 200_000:
                    self._known.clear()
                place = self._known[word] = word_place(word, self.dimensions)
            row[place[0]] += place[1]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for text, row in zip(texts, out):
            self._row(text, row)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).astype(np.float32)

    def __call__(self, question: str) -> list[float]:
        """The vector of one question."""
        return self.matrix([question])[0].astype(float).tolist()


class EncoderRegistry:
    """Encoders by model family: the first registered name that a model's path contains gives the encoder, ``WordEncoder`` if none does."""

    def __init__(self) -> None:
        self._families: dict[str, Callable[[str], Callable[[str], list[float]]]] = {}

    def register(self, family: str, factory: Callable[[str], Callable[[str], list[float]]]) -> None:
        """``factory`` makes an encoder (question -> vector) of a model's path."""
        self._families[family.lower()] = factory

    def encoder(self, model: str | None) -> Callable[[str], list[float]]:
        name = (model or "").lower()
        return next((factory(model) for family, factory in self._families.items() if family in name), WordEncoder())


def hashed_embedding(docs: DataFrame, id_col: str, text_col: str, dimensions: int = 64) -> DataFrame:
    """(id, embedding ARRAY<FLOAT>): every text through ``WordEncoder``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(dimensions)
        for batch in batches:
            flat = encoder.matrix(batch.column(1).to_pylist()).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "embedding"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")
