"""Problem 7: fill containers of fixed capacity with whole items.

Method: a linear grouping scheme over the histogram of sizes. Items of one size
are interchangeable, so the plan needs only how often each size occurs (at most
``capacity`` different sizes, a fixed bound) and is made on the driver:

1. items above the capacity are cut into full containers and a remainder;
2. the large sizes are split into groups of equal cardinality and rounded up to
   the largest of their group;
3. the few rounded sizes are packed by configurations (column generation: an LP
   whose pricing step is a knapsack over the capacity), rounded down to whole
   containers, the rest first-fit decreasing;
4. the actual sizes are substituted slot by slot, which leaves more room than
   planned, and the small sizes are placed best-fit into what is left.

The plan is a list of runs (size, ranks from..to, first container, items per
container), bounded by the number of sizes and configurations, whatever the
number of items. Items then take their place by their rank among the items of
their size, which is counted in two levels (size and salt); a size has a salt for
every ``PER_SALT`` of its items, so one that holds a third of all rows is never
gathered in one task, however many there are.

Defined results: an item of no tokens (null or empty text) is in no container;
an item above the capacity is cut every ``capacity`` tokens; all others come out
whole; ties are broken by id and repeated rows need different ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import TOKENIZERS, checkpoint
from quillmesh.llm.encode import count_tokens

CAPACITY = 2048
GROUPS = 48
#: Sizes above this share of the capacity count as large.
LARGE = 1 / 12
#: Items of one size that are ranked in one task.
PER_SALT = 200_000


@dataclass
class Plan:
    """Runs of equal placements; container numbers start at 0."""

    containers: int = 0
    #: (size, first rank, items, first container, items per container)
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)

    def place(self, size: int, items: int, container: int, per: int) -> None:
        self.runs.append((size, self.used.get(size, 0), items, container, per))
        self.used[size] = self.used.get(size, 0) + items


class _Rooms:
    """Open containers by room left: runs of neighbouring containers with equal room."""

    def __init__(self, capacity: int):
        self.by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        if count > 0:
            self.by_room[room].append((first, count))


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Place all items of a histogram of sizes (1..capacity): by linear grouping, or best-fit decreasing alone where that needs fewer."""
    counts = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    return min((_plan(counts, capacity, g) for g in (groups, 0)), key=lambda p: p.containers)


def _plan(counts: dict[int, int], capacity: int, groups: int) -> Plan:
    plan, rooms = Plan(), _Rooms(capacity)
    large = sorted((s for s in counts if s > capacity * LARGE), reverse=True) if groups else []
    grouped = _groups([(s, counts[s]) for s in large], groups)
    rounded = [g[0][0] for g in grouped]
    demand = np.array([sum(n for _, n in g) for g in grouped], float)
    queues = [list(map(list, g)) for g in grouped]
    for pattern, times in _configurations(rounded, demand, capacity):
        _substitute(plan, rooms, queues, pattern, times, capacity)
    # What rounding down left over, and then the small sizes: best fit, largest first.
    rest = {s: n for s, n in counts.items() if s not in set(large)}
    for queue in queues:
        for size, n in queue:
            rest[size] = rest.get(size, 0) + n
    for size in sorted(rest, reverse=True):
        _best_fit(plan, rooms, size, rest[size], capacity)
    return plan


def _groups(sizes: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut descending (size, count) into groups of equal cardinality; a size may lie in two groups."""
    total = sum(n for _, n in sizes)
    if not total:
        return []
    share, out, room = -(-total // groups), [[]], -(-total // groups)
    for size, n in sizes:
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((size, take))
            n, room = n - take, room - take
    return out


def _configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 400) -> Iterator[tuple[np.ndarray, int]]:
    """(items of each group in a container, whole number of such containers) by column generation."""
    k = len(sizes)
    if not k:
        return
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        level = inverse @ demand
        price = inverse.sum(axis=0)
        entering, worth = _knapsack(sizes, price, capacity)
        # The LP can't fall below its value over the worth of the best configuration.
        if worth <= 1 + 2e-4:
            break
        direction = inverse @ entering
        ratio = np.where(direction > 1e-9, np.maximum(level, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = entering
    level = np.linalg.inv(columns) @ demand
    left = demand.copy()
    for j in np.argsort(-level, kind="stable"):
        pattern = columns[:, j].astype(int)
        times = int(level[j] + 1e-6)
        for g in np.flatnonzero(pattern):
            times = min(times, int(left[g] // pattern[g]))
        if times > 0:
            left -= pattern * times
            yield pattern, times


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the highest price: unbounded knapsack."""
    used = np.flatnonzero(price > 1e-12)
    widths, worths = np.array(sizes)[used], price[used]
    floor = int(widths.max(initial=1))
    best = np.zeros(floor + capacity + 1)  # the first ``floor`` places stand for negative room
    best[:floor] = -np.inf
    last = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        gain = best[floor + room - widths] + worths
        g = int(np.argmax(gain)) if len(gain) else -1
        if g >= 0 and gain[g] > best[floor + room - 1] + 1e-12:
            best[floor + room], last[room] = gain[g], used[g]
        else:
            best[floor + room] = best[floor + room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        g = int(last[room])
        if g < 0:
            room -= 1
        else:
            pattern[g] += 1
            room -= sizes[g]
    return pattern, float(best[floor + capacity])


def _substitute(plan: Plan, rooms: _Rooms, queues: list[list[list[int]]], pattern: np.ndarray, times: int, capacity: int) -> None:
    """Put actual sizes into ``times`` containers of one configuration, run by run."""
    slots = []
    for g in np.flatnonzero(pattern):
        for _ in range(int(pattern[g])):
            taken, need = [], times
            while need:
                head = queues[g][0]
                n = min(need, head[1])
                taken.append([head[0], n])
                head[1] -= n
                need -= n
                if not head[1]:
                    queues[g].pop(0)
            slots.append(taken)
    first = plan.containers
    plan.containers += times
    done = 0
    while done < times:
        n = min(slot[0][1] for slot in slots)
        room = capacity
        for slot in slots:
            plan.place(slot[0][0], n, first + done, 1)
            room -= slot[0][0]
            slot[0][1] -= n
            if not slot[0][1]:
                slot.pop(0)
        rooms.add(room, first + done, n)
        done += n


def _best_fit(plan: Plan, rooms: _Rooms, size: int, items: int, capacity: int) -> None:
    """Place items of one size where the least room is left; open containers when none has room."""
    for room in range(size, capacity + 1):
        per = room // size
        while items and rooms.by_room[room]:
            first, count = rooms.by_room[room].pop()
            full = min(count, items // per)
            if full:
                plan.place(size, full * per, first, per)
                rooms.add(room - per * size, first, full)
                items -= full * per
            if full < count:
                if 0 < items < per:
                    plan.place(size, items, first + full, items)
                    rooms.add(room - items * size, first + full, 1)
                    items, full = 0, full + 1
                rooms.add(room, first + full, count - full)
        if not items:
            return
    per = capacity // size
    full, rest = divmod(items, per)
    if full:
        plan.place(size, full * per, plan.containers, per)
        rooms.add(capacity - per * size, plan.containers, full)
    if rest:
        plan.place(size, rest, plan.containers + full, rest)
        rooms.add(capacity - rest * size, plan.containers + full, 1)
    plan.containers += full + (rest > 0)


def pack_sizes(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(container BIGINT, id, piece_no INT, first_token INT, n_tokens INT): one row per placed piece.

    ``sizes`` is read twice; give a table or a checkpoint. Containers of the
    planned items come first, those filled by one piece of a cut item after them.
    """
    whole = sizes.where(F.col(size_col) > 0).select(F.col(id_col).alias("_id"), F.col(size_col).cast("int").alias("_size"))
    item = whole.withColumn("_full", F.floor(F.col("_size") / capacity).cast("int")).withColumn("_rest", F.col("_size") % capacity)
    # A full container needs no plan: only remainders (1..capacity-1) are placed by size. At most ``capacity`` rows:
    amounts = {int(r["_rest"]): int(r["n"]) for r in item.groupBy("_rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = np.array([-(-amounts.get(rest, 0) // PER_SALT) or 1 for rest in range(capacity)], np.int64)
    first_cell = np.concatenate(([0], np.cumsum(salts)))
    # Most sizes have one salt; only the others are looked up.
    many = {rest: int(n) for rest, n in enumerate(salts) if n > 1}
    salt_count = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in many.items() for x in pair)), F.col("_rest")), F.lit(1)) if many else F.lit(1)
    salted = item.withColumn("_salt", F.pmod(F.xxhash64("_id"), salt_count).cast("int"))
    counted = salted.groupBy("_rest", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("_full").alias("_fulls"))
    # At most capacity + items / PER_SALT rows.
    table = counted.toPandas().sort_values(["_rest", "_salt"], kind="stable")
    plan = make_plan({int(s): int(n) for s, n in table.groupby("_rest")["_n"].sum().items()}, capacity)
    base = (table.groupby("_rest")["_n"].cumsum() - table["_n"]).to_numpy(np.int64)
    full_base = (table["_fulls"].cumsum() - table["_fulls"]).to_numpy(np.int64) + plan.containers
    cell = (first_cell[table["_rest"].to_numpy(np.int64)] + table["_salt"].to_numpy(np.int64))
    runs = sorted(plan.runs)
    key = np.array([(r[0] << 40) + r[1] for r in runs], np.int64)
    start, container, per = (np.array([r[k] for r in runs], np.int64) for k in (1, 3, 4))
    shared = sizes.sparkSession.sparkContext.broadcast((first_cell, cell, base, full_base, key, start, container, per))

    by_cell = Window.partitionBy("_rest", "_salt").orderBy("_id")
    ranked = salted.select(
        "_id",
        "_rest",
        "_full",
        "_salt",
        (F.row_number().over(by_cell) - 1).cast("long").alias("_rank"),
        (F.sum("_full").over(by_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_full")).cast("long").alias("_before"),
    )
    kind = sizes.schema[id_col].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_cell, cell, base, full_base, key, start, container, per = shared.value
        for batch in batches:
            rest, full, salt, rank, before = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 6))
            at = np.searchsorted(cell, first_cell[rest] + salt)
            place = base[at] + rank
            run = np.searchsorted(key, (rest << 40) + place, side="right") - 1
            if len(key):
                rest_in = np.where(rest > 0, container[run] + (place - start[run]) // np.maximum(per[run], 1), -1)
            else:
                rest_in = np.full(len(rest), -1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(full_base[at] + before), pa.array(rest_in)], names=["_id", "_full", "_rest", "_own", "_in"])

    placed = ranked.select("_id", "_rest", "_full", "_salt", "_rank", "_before").mapInArrow(assign, f"_id {kind}, _full int, _rest int, _own long, _in long")
    # Pieces of one item: its full containers, then the remainder.
    last = F.col("_full") + F.when(F.col("_rest") > 0, 1).otherwise(0) - 1
    return placed.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        F.when(F.col("piece_no") < F.col("_full"), F.col("_own") + F.col("piece_no")).otherwise(F.col("_in")).alias("container"),
        F.col("_id").alias(id_col),
        "piece_no",
        (F.col("piece_no") * capacity).alias("first_token"),
        F.when(F.col("piece_no") < F.col("_full"), F.lit(capacity)).otherwise(F.col("_rest")).alias(size_col),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """Pack the texts of ``docs``, measured in ``byte_bpe_50k`` tokens."""
    return pack_sizes(checkpoint(count_tokens(docs, folder=folder)), capacity=capacity)
