"""Problem 1: near-duplicate records, by tiled comparison of bit fingerprints.

Method: each record's set of word runs (shingles) is hashed into a bitmap of
``BITS`` bits. Two sets of n and m shingles with a similarity of at least t
differ in at most ``r = (1 - t) / (1 + t) * (n + m)`` shingles, and the exclusive
or of their bitmaps has at most as many bits set. So tiles of fingerprints are
compared exactly, with numpy exclusive-or and bit counts against that radius,
and tile pairs whose population counts differ by more than the radius are
skipped. No pair within the radius is lost by the comparison.

Comparing every tile with every other is quadratic in the collection, so the
tiles are formed inside buckets: records that agree in a band of minimum hashes.
``banding`` takes rows and bands from the similarity asked for, so that a pair
right at it shares no bucket with probability ``MISSED`` at most (4 rows, 56 bands
at 0.6; a pair of 0.7 is lost with 0.00002 %). ``exact=True`` compares all tiles of the
whole collection instead and loses none, at quadratic cost. The buckets are the
one addition to the method named; the README gives the reason.

* Exact copies (equal shingle sets) are one class before any comparison, so a
  group of copies of any size costs one row here.
* A bucket beyond ``TILE`` records is parted into tiles by size class and salt;
  only tiles whose sizes a similar pair may have meet, each pair of tiles as a unit
  of its own. Buckets are counted by an aggregation that combines before the
  shuffle. No bucket is capped and none is gathered in one task; a record goes to
  as many units as there are tiles within reach of its size.
* What passes is verified on the shingle sets themselves.

Defined results: records of fewer than ``min_words`` words (null, empty and
blank texts among them) take no part; repeated rows are pairs of similarity 1;
ids must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint

BITS = 1024
#: Share of the pairs right at the similarity asked for that may meet in no bucket, and the bands that are spent on it.
MISSED, MOST_BANDS = 4.3e-4, 64
#: Records of a tile; a unit of comparison holds two tiles at most.
TILE = 8192
#: Size classes to the ratio that parts the sizes of a similar pair at most.
CLASSES = 4
#: Copies of a class that are expanded into pairs as one unit.
COPIES = 2000
#: Candidate pairs up to which the ids to verify are broadcast (16 bytes each); beyond, a shuffle join is used.
BROADCAST_PAIRS = 1_000_000


class _Words(dict):
    """Word to 64-bit hash; starts afresh beyond a size, which bounds memory only."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int, min_words: int) -> np.ndarray | None:
    """Sorted 64-bit hashes of the distinct runs of ``size`` words; None below ``min_words`` words."""
    if not text:
        return None
    text = text.lower()
    for blank in "\t\r\n\f":
        text = text.replace(blank, " ")
    words = list(filter(None, text.split(" ")))
    if len(words) < max(min_words, size):
        return None
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    last = len(h) - size + 1
    run = np.zeros(last, np.uint64)
    for k in range(size):
        run = _mix(run + h[k : k + last] + np.uint64(k + 1))
    run.sort()
    first = np.ones(last, bool)
    np.not_equal(run[1:], run[:-1], out=first[1:])
    return run[first]


def banding(least: float) -> tuple[int, int]:
    """(rows, bands): as many rows as ``MOST_BANDS`` bands allow at ``MISSED``; one row and more bands where none do."""
    needed = lambda rows: math.ceil(math.log(MISSED) / math.log1p(-(least**rows))) if least < 1 else 1
    rows = next((r for r in range(16, 0, -1) if needed(r) <= MOST_BANDS), 1)
    return rows, needed(rows)


@lru_cache(maxsize=4)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240301)
    return draw.integers(1, 2**32, count, dtype=np.uint32) | np.uint32(1), draw.integers(0, 2**32, count, dtype=np.uint32)


def _bands(sh: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 32-bit hash of each band of minimum hashes."""
    a, b = _functions(rows * bands)
    h = (sh >> np.uint64(32)).astype(np.uint32)
    low = np.full(rows * bands, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 4096):
        low = np.minimum(low, (h[k : k + 4096, None] * a + b).min(axis=0))
    parts = low.reshape(bands, rows).astype(np.uint64)
    out = np.zeros(bands, np.uint64)
    for k in range(rows):
        out = _mix(out + parts[:, k] + np.uint64(k + 1))
    return out.astype(np.uint32).view(np.int32)


def _bitmap(sh: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(sh & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def sketch(records: DataFrame, id_col: str, text_col: str, size: int, min_words: int, rows: int, bands: int) -> DataFrame:
    """(id, set_key BINARY, n INT, bands ARRAY<INT>, bits BINARY) of every record that takes part."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, keys, ns, bits, sign = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                sh = shingles(text.as_py(), size, min_words)
                if sh is not None:
                    keep.append(k)
                    keys.append(blake2b(sh.tobytes(), digest_size=16).digest())
                    ns.append(len(sh))
                    bits.append(_bitmap(sh))
                    sign.append(_bands(sh, rows, bands))
            flat = np.concatenate(sign) if sign else np.empty(0, np.int32)
            offsets = np.arange(len(keep) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array(keys, pa.binary()),
                    pa.array(ns, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(bits, pa.binary()),
                ],
                names=["id", "set_key", "n", "bands", "bits"],
            )

    return records.select(id_col, text_col).mapInArrow(run, f"id {kind}, set_key binary, n int, bands array<int>, bits binary")


def _within(bits: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, share: float, least: float) -> np.ndarray:
    """Mask of the pairs whose exclusive or lies within the radius."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = small >= least * large - 1e-9
    at = np.flatnonzero(ok)
    if len(at):
        apart = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1, dtype=np.int64)
        ok[at] = apart <= share * (small[at] + large[at]) + 1e-9
    return ok


def compare_units(unit: np.ndarray, side: np.ndarray, ids: np.ndarray, n: np.ndarray, bits: np.ndarray, least: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs within the radius, for rows sorted by unit.

    ``side`` 0/1: the two tiles of a unit that compares two tiles; 2: a unit that
    is one tile compared with itself.
    """
    share = (1 - least) / (1 + least)
    found_a, found_b = [], []

    def test(i: np.ndarray, j: np.ndarray) -> None:
        use = (side[i] == 2) | (side[i] != side[j])
        i, j = i[use], j[use]
        if len(i):
            ok = _within(bits, n, i, j, share, least)
            found_a.append(ids[i[ok]])
            found_b.append(ids[j[ok]])

    edge = np.flatnonzero(np.diff(unit)) + 1
    start = np.concatenate(([0], edge))
    length = np.diff(np.concatenate((start, [len(unit)])))
    # Short units all at once: the row d places further on, if it is of the same unit.
    short = np.repeat(length <= 16, length)
    for d in range(1, int(length[length <= 16].max(initial=0))):
        i = np.flatnonzero(short[:-d] & (unit[:-d] == unit[d:]))
        test(i, i + d)
    # Long units in tiles of ``block``, in the order of their population counts.
    for a, size in zip(start[length > 16], length[length > 16]):
        rows = np.arange(a, a + size)
        pops = np.bitwise_count(bits[rows]).sum(axis=1, dtype=np.int64)
        order = np.argsort(pops, kind="stable")
        rows, pops = rows[order], pops[order]
        blocks = [slice(k, min(k + block, size)) for k in range(0, size, block)]
        most = [int(n[rows[x]].max()) for x in blocks]
        for p, x in enumerate(blocks):
            for q in range(p, len(blocks)):
                y = blocks[q]
                if pops[y.start] - pops[x.stop - 1] > share * (most[p] + most[q]):
                    continue  # their population counts differ beyond the radius
                i, j = np.meshgrid(rows[x], rows[y], indexing="ij")
                i, j = i.ravel(), j.ravel()
                if p == q:
                    upper = np.arange(len(rows[x]))
                    use = (upper[:, None] < upper[None, :]).ravel()
                    i, j = i[use], j[use]
                test(i, j)
    if not found_a:
        return ids[:0], ids[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return np.minimum(a, b), np.maximum(a, b)


def candidates(reps: DataFrame, least: float, tile: int = TILE, exact: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of representatives of one bucket within the radius of each other.

    With ``exact`` the whole collection is one bucket: the tiled comparison alone.
    """
    kind = reps.schema["id"].dataType.simpleString()
    if exact:
        spread = reps.select("id", F.lit(0).cast("long").alias("bucket"))
    else:
        spread = reps.select("id", F.posexplode("bands").alias("band", "hash")).select("id", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("hash").cast("long") + F.lit(2**31)).alias("bucket"))
    # Counted before the shuffle, then joined back: one row per bucket meets its members, so a hot bucket's side can be split.
    several = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = spread.join(several, "bucket").join(reps.select("id", "n", "bits"), "id")
    small = rows.where(F.col("members") <= tile).select("bucket", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(2).alias("side"), "id", "n", "bits")
    # Hot buckets: a tile is a size class and a salt; sizes of a similar pair lie CLASSES classes apart at most.
    hot_rows = rows.where(F.col("members") > tile).withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) * ((CLASSES - 1e-6) / math.log(1 / least) if least < 1 else 1e6)).cast("int"))
    salts = hot_rows.groupBy("bucket", "size_class").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("salts"))
    tiles = salts.groupBy("bucket").agg(F.collect_list(F.struct("size_class", "salts")).alias("tiles"))  # as many as there are size classes
    own_salts = F.filter("tiles", lambda t: t.size_class == F.col("size_class"))[0].salts
    near = F.filter("tiles", lambda t: F.abs(t.size_class - F.col("size_class")) <= CLASSES)
    other = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t.salts - 1), lambda s: t.size_class.cast("long") * 1_000_000 + s)))
    hot = (
        hot_rows.join(tiles, "bucket")
        .withColumn("own", F.col("size_class").cast("long") * 1_000_000 + F.pmod(F.xxhash64("id"), own_salts))
        .withColumn("other", F.explode(other))
        .select(
            "bucket",
            F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
            "id",
            "n",
            "bits",
        )
    )
    units = small.unionAll(hot).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(part: pa.Table) -> pa.RecordBatch:
            bucket, lo, hi, side, ids, n = (part.column(k).to_numpy() for k in range(6))
            new = np.ones(len(ids), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            bits = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint64).reshape(len(ids), BITS // 64)
            a, b = compare_units(np.cumsum(new), side, ids, n, bits, least)
            pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.stack([a, b])
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        def last_unit(batch: pa.RecordBatch) -> int:
            """First row of the batch's last unit."""
            same = np.ones(batch.num_rows, bool)
            for k in range(3):
                column = batch.column(k).to_numpy()
                same &= column == column[-1]
            return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

        def unit(batch: pa.RecordBatch, k: int) -> tuple:
            return tuple(batch.column(c)[k].as_py() for c in range(3))

        for batch in batches:
            if not batch.num_rows:
                continue
            cut = last_unit(batch)
            if cut or (held and unit(batch, 0) != unit(held[-1], held[-1].num_rows - 1)):
                yield compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compare(pa.Table.from_batches(held))

    return units.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def verify(pairs: DataFrame, records: DataFrame, id_col: str, text_col: str, size: int, min_words: int, least: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs that reach ``least`` on their shingle sets.

    ``pairs`` is a checkpoint: it is counted, and only the records it names are
    read into shingle sets. Their ids are broadcast up to ``BROADCAST_PAIRS``
    pairs, joined by a shuffle beyond.
    """
    kind = records.schema[id_col].dataType.simpleString()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("_needed")).distinct()
    if pairs.count() <= BROADCAST_PAIRS:
        needed = F.broadcast(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size, min_words) for t in batch.column(1)]
            offsets = np.concatenate(([0], np.cumsum([0 if s is None else len(s) for s in sets]))).astype(np.int32)
            # 32 of the 64 bits: two different shingles of a pair agree by chance in one pair of a hundred thousand.
            flat = np.concatenate([np.empty(0, np.uint64), *(s for s in sets if s is not None)]).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "sh"])

    named = records.select(id_col, text_col).join(needed, F.col(id_col) == F.col("_needed"), "left_semi")
    sets = named.mapInArrow(run, f"id {kind}, sh array<int>")
    both = F.size(F.array_intersect("sh_a", "sh_b")).cast("double")
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sh_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sh_b")), "b")
        .withColumn("similarity", both / (F.size("sh_a") + F.size("sh_b") - both))
        .where(F.col("similarity") >= least)
        .select("a", "b", "similarity")
    )


def links(records: DataFrame, id_col: str = "id", text_col: str = "page_content", size: int = 3, min_words: int = 30, least: float = 0.6, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, class_id) of every record that takes part, and (a, b, similarity) between classes.

    A class holds the records with equal shingle sets; ``class_id`` is its least id.
    """
    sketches = checkpoint(sketch(records, id_col, text_col, size, min_words, *((1, 1) if exact else banding(least))))
    classes = sketches.groupBy("set_key").agg(F.min("id").alias("class_id"))
    members = sketches.select("id", "set_key").join(classes, "set_key").select("id", "class_id")
    firsts = sketches.groupBy("set_key").agg(F.min_by(F.struct("id", "n", "bands", "bits"), "id").alias("r")).select("r.*")
    pairs = checkpoint(candidates(firsts, least, exact=exact))
    return members, verify(pairs, records, id_col, text_col, size, min_words, least)


def similar_pairs(records: DataFrame, id_col: str = "id", text_col: str = "page_content", size: int = 3, min_words: int = 30, least: float = 0.6, exact: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records, copies expanded.

    A class of many copies is expanded in units of ``COPIES`` by ``COPIES`` records.
    ``groups`` has the same links with one row per record.
    """
    members, pairs = links(records, id_col, text_col, size, min_words, least, exact)
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = sizes.where(F.col("n") > COPIES).select("class_id", F.ceil(F.col("n") / COPIES).cast("int").alias("salts"))
    classes = pairs.select("a", "b").unionAll(sizes.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    for side in ("a", "b"):
        salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        classes = classes.join(hot.withColumnRenamed("class_id", side), side, "left").withColumn(f"salt_{side}", F.explode(salts)).drop("salts")
    salted = members.join(hot, "class_id", "left").select("class_id", "id", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    left = salted.select(F.col("class_id").alias("a"), F.col("salt").alias("salt_a"), F.col("id").alias("x"))
    right = salted.select(F.col("class_id").alias("b"), F.col("salt").alias("salt_b"), F.col("id").alias("y"))
    return (
        classes.join(left, ["a", "salt_a"])
        .join(right, ["b", "salt_b"])
        .where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): alternating large-star and small-star steps.

    The component's name is its least node. Every round cuts its lineage in the
    checkpoint folder, until a round changes nothing; the number of rounds grows
    with the logarithm of the largest component.
    """
    pairs = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        pairs = checkpoint(small)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def groups(records: DataFrame, id_col: str = "id", text_col: str = "page_content", size: int = 3, min_words: int = 30, least: float = 0.6, exact: bool = False) -> DataFrame:
    """(id, class_id, group_id, links BIGINT): one row per record that takes part.

    ``links`` counts the other classes that the record's class is similar to;
    ``group_id`` is the least id of all records reachable over such links.
    """
    members, pairs = links(records, id_col, text_col, size, min_words, least, exact)
    kept = checkpoint(pairs.select("a", "b"))
    degree = kept.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    named = components(kept).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    return members.join(degree, "class_id", "left").join(named, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
