"""The order in which the lines of a page are read, from their boxes alone.

A page is a set of boxes with two partial orders: above, among boxes that share a
column, and left of, among boxes at one height that share none. What a line has to
wait for is one integer, a bit for each line before it; reading is a walk that
takes, of the lines that wait for nothing, the one that best continues the last.
Pages whose gutters don't part them into sound columns keep their given order.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Thresholds of the reading order, as shares of the page's or column's extent unless stated.
SAME_COLUMN, SAME_LINE = 0.2, 0.5
LEAST_ANGLE, MOST_ANGLE = 1, 45  # degrees
SPANNING, MARGIN, GUTTER = 0.5, 0.125, 0.015
BODY_BOXES, COLUMN_BOXES, MOST_COLUMNS = 8, 4, 3  # numbers of boxes and columns
COLUMN_SPAN, COLUMN_FILL, COLUMN_HEIGHT = 0.22, 0.55, 0.4


class Page:
    """Geometry of one page: ``corners`` of all its lines in a row, ``sizes`` how many each line has."""

    def __init__(self, corners: np.ndarray, sizes: np.ndarray):
        self.corners, self.sizes = corners, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)

    @cached_property
    def angle(self) -> float:
        """Median slope of the lines in degrees; 0 unless all are four-cornered."""
        if not (self.sizes == 4).all():
            return 0.0
        quads = self.corners.reshape(-1, 4, 2)
        # From the middle of the left side to the middle of the right one; y grows downwards.
        run, fall = (quads[:, [1, 2]].sum(axis=1) - quads[:, [0, 3]].sum(axis=1)).T
        slanted = run != 0
        return float(np.median(np.degrees(np.arctan(-fall[slanted] / run[slanted])))) if slanted.any() else 0.0

    @cached_property
    def boxes(self) -> np.ndarray:
        """(left, top, right, bottom) of every line, the page turned upright first if it was scanned askew."""
        points = self.corners
        if LEAST_ANGLE <= abs(self.angle) < MOST_ANGLE:
            middle, (cos, sin) = points.mean(axis=0), (np.cos(np.radians(self.angle)), np.sin(np.radians(self.angle)))
            points = (points - middle) @ np.array([[cos, sin], [-sin, cos]]) + middle
        return np.concatenate([np.minimum.reduceat(points, self.starts), np.maximum.reduceat(points, self.starts)], axis=1)

    @cached_property
    def extent(self) -> np.ndarray:
        """Width and height of all boxes together."""
        return self.boxes[:, 2:].max(axis=0) - self.boxes[:, :2].min(axis=0)

    def is_sound(self) -> bool:
        """Whether the page is one column, or gutters part the narrow boxes of its body into a few columns that are wide, full and long enough."""
        (wide, high), top = self.extent, self.boxes[:, 1].min()
        if wide <= 0 or high <= 0:
            return False
        left, upper, right, lower = self.boxes.T
        height = ((upper + lower) / 2 - top) / high
        body = np.flatnonzero((right - left <= SPANNING * wide) & (height >= MARGIN) & (height <= 1 - MARGIN))
        if len(body) < BODY_BOXES:
            return True
        # A gutter is a stretch that no box of the body covers: where starts meet ends with nothing open.
        columns: list[list[int]] = []
        reach = -np.inf
        for k in body[np.argsort(left[body], kind="stable")]:
            if not columns or left[k] - reach >= GUTTER * wide:
                columns.append([])
            columns[-1].append(k)
            reach = max(reach, right[k])
        if len(columns) == 1:
            return True

        def sound(c: list[int]) -> bool:
            span = right[c].max() - left[c].min()
            return len(c) >= COLUMN_BOXES and span >= COLUMN_SPAN * wide and np.median(right[c] - left[c]) >= COLUMN_FILL * span and lower[c].max() - upper[c].min() >= COLUMN_HEIGHT * high

        return len(columns) <= MOST_COLUMNS and all(map(sound, columns))

    def order(self) -> list[int] | None:
        """Lines in reading order; None where the layout doesn't tell, or there is nothing to order."""
        n = len(self.sizes)
        if n < 2 or not self.is_sound():
            return None
        low, high = self.boxes[:, :2], self.boxes[:, 2:]
        # For all pairs and both axes: the common stretch as a share of the shorter one.
        common = np.maximum(np.minimum(high[:, None], high) - np.maximum(low[:, None], low), 0)
        shares = common / np.maximum(np.minimum((high - low)[:, None], high - low), 1e-9)
        stacked, level = shares[..., 0] > SAME_COLUMN, shares[..., 1] > SAME_LINE
        place = np.empty((2, n), int)
        for axis in (0, 1):
            place[axis, np.lexsort((np.arange(n), high[:, axis], low[:, axis]))] = np.arange(n)
        earlier = place[:, :, None] < place[:, None, :]
        waits = np.where(stacked, earlier[1], level & earlier[0])  # [i, j]: j waits for i
        np.fill_diagonal(waits, False)
        spanning = (high - low)[:, 0] > SPANNING * (self.extent[0] or 1.0)
        column = self._connected(stacked & ~spanning & ~spanning[:, None])
        open_for = [int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little") for row in waits.T]
        top, left = low[:, 1].tolist(), low[:, 0].tolist()
        unread, waiting, out = set(range(n)), (1 << n) - 1, []
        while unread:
            ready = [k for k in unread if not open_for[k] & waiting] or unread
            last = out[-1] if out else None

            def rank(k: int) -> int:
                """0: below the last line, 1: beside it, 2: in its column, 3: elsewhere."""
                if last is None:
                    return 3
                if stacked[last, k] and top[k] >= top[last]:
                    return 0
                return 1 if level[last, k] else 2 if not spanning[last] and column[k] == column[last] else 3

            pick = min(ready, key=lambda k: (rank(k), top[k], left[k]))
            out.append(pick)
            unread.remove(pick)
            waiting &= ~(1 << pick)
        return out

    @staticmethod
    def _connected(linked: np.ndarray) -> list[int]:
        """A name for the connected set of each line."""
        name = [-1] * len(linked)
        for k in range(len(linked)):
            todo = [k] if name[k] < 0 else []
            while todo:
                at = todo.pop()
                if name[at] < 0:
                    name[at] = k
                    todo += [j for j in np.flatnonzero(linked[at]).tolist() if name[j] < 0]
        return name


def reading_order(polygons: list) -> list[int] | None:
    """Order in which lines (their polygons) are read; None where the layout doesn't tell (the given order stays)."""
    if not len(polygons):
        return None
    points = [np.asarray(p, float).reshape(-1, 2) for p in polygons]
    return Page(np.concatenate(points), np.array([len(p) for p in points])).order()


@F.arrow_udf(ArrayType(IntegerType()))
def line_positions(pages: pa.Array) -> pa.Array:
    """Position of every line of a page (array of polygons) in reading order; pages of the same polygons are ordered once."""
    lines, points = pages.flatten(), pages.flatten().flatten()
    coordinates = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    counts = lines.value_lengths().to_numpy(zero_copy_only=False)
    of_page = np.concatenate(([0], np.cumsum(pages.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    of_line = np.concatenate(([0], np.cumsum(counts)))
    known: dict[tuple[bytes, bytes], np.ndarray] = {}
    out = [np.empty(0, int)]
    for a, b in zip(of_page[:-1], of_page[1:]):
        corners = coordinates[of_line[a] : of_line[b]]
        key = counts[a:b].tobytes(), corners.tobytes()
        if key not in known:
            order = Page(corners, counts[a:b]).order() if b > a else None
            known[key] = np.arange(b - a) if order is None else np.argsort(order)
        out.append(known[key])
    return pa.ListArray.from_arrays(pa.array(of_page, pa.int32()), pa.array(np.concatenate(out), pa.int32()))


def in_reading_order(lines: DataFrame, page_cols: list[str], order_col: str = "line_no") -> DataFrame:
    """Lines (polygon ARRAY<ARRAY<DOUBLE>>) plus ``position``; a page's lines are one array, bounded by what a page holds."""
    rest = [c for c in lines.columns if c not in page_cols and c != "position"]
    line = F.struct(F.col(order_col).alias("_order"), *(F.col(f"`{c}`") for c in rest))
    pages = lines.groupBy(*page_cols).agg(F.array_sort(F.collect_list(line)).alias("_lines")).withColumn("_at", line_positions(F.transform("_lines", lambda x: x.polygon)))
    each = pages.select(*page_cols, F.explode(F.arrays_zip("_lines", "_at")).alias("_l"))
    return each.select(*page_cols, *(F.col(f"_l._lines.`{c}`").alias(c) for c in rest), F.col("_l._at").cast("long").alias("position"))
