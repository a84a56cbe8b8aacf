"""Covers of polygons by square cells of several sizes: large ones inside, small ones along the border.

A cell of level k has the side cell * 2**k. Cells are divided until they lie inside as a whole, outside, or are of level 0, so
that their number follows the border's length and not the area. What decides in a border cell is kept with it, and passed from parent
to child: the edges that come into it, whether a ray to the right from its lower side crosses an odd number of the edges beyond its right side (base),
and at which heights within it that number changes (flips).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that a round of refinement goes down; then the cells are dealt anew.
ROUND = 4
#: Up to this level whole cells are cut into cells of level 0 (64 at most).
SMALL = 3


class Cell(NamedTuple):
    k: int
    cx: int
    cy: int
    edges: np.ndarray  # ax, ay, bx, by of each
    base: bool
    flips: np.ndarray

    def child(self, k: int, cx: int, cy: int, cell: int) -> Cell:
        """What this cell knows for a cell within it."""
        side = float(cell << k)
        left, low = cx * side, cy * side
        ax, ay, bx, by = self.edges.T
        band = (np.maximum(ay, by) >= low) & (np.minimum(ay, by) <= low + side)
        beyond = np.minimum(ax, bx) > left + side
        # an edge counts from its lower end, included, to its upper end: two changes of parity
        ends = self.edges[beyond][:, [1, 3]].ravel()
        base = bool(self.base ^ (np.count_nonzero(self.flips <= low) + np.count_nonzero(ends <= low)) & 1)
        heights, times = np.unique(np.concatenate([self.flips, ends]), return_counts=True)
        flips = heights[(times % 2 == 1) & (heights > low) & (heights < low + side)]
        return Cell(k, cx, cy, self.edges[band & ~beyond & (np.maximum(ax, bx) >= left)], base, flips)

    def refined(self, down: int, cell: int) -> Iterator[Cell]:
        """The cells that lie inside as a whole, and the undecided ones `down` levels below or of level 0; none that lie outside."""
        todo = [self]
        while todo:
            at = todo.pop()
            if not len(at.edges) and not len(at.flips):
                if at.base:
                    yield at
            elif at.k == 0 or at.k <= self.k - down:
                yield at
            else:
                todo += [at.child(at.k - 1, 2 * at.cx + i, 2 * at.cy + j, cell) for i in (0, 1) for j in (0, 1)]


def _whole(c: Cell) -> bool:
    return not len(c.edges) and not len(c.flips)


def bounded(zones: DataFrame, edges: Column, cell: int) -> DataFrame:
    """zones with `_edges`, without those along x, which no ray crosses, and the level `_k` at which two cells each way hold the zone."""
    made = zones.withColumn("_edges", F.filter(edges, lambda e: e["ay"] != e["by"])).where(F.size("_edges") > 0)
    bound = lambda pick, a, b: pick(F.concat(F.transform("_edges", lambda e: e[a]), F.transform("_edges", lambda e: e[b])))
    made = made.withColumns({"_w": bound(F.array_min, "ax", "bx"), "_e": bound(F.array_max, "ax", "bx"), "_s": bound(F.array_min, "ay", "by"), "_n": bound(F.array_max, "ay", "by")})
    extent = F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"))
    return made.withColumn("_k", F.greatest(F.lit(0), F.ceil(F.log2(extent / cell)).cast("int")))


def cover(zones: DataFrame, edges: Column, cell: int) -> tuple[DataFrame, int]:
    """The cells of all zones, with the columns of zones but `geom`, and the highest level.

    _k, _cx, _cy; _whole: true, or null with _edges, _base and _flips for inside(). Each place of a zone lies in one cell of it. Zones are refined by tasks, a few
    levels a round, dealt by cell in between, so that a large zone isn't one task's work.
    """
    rest = [c for c in zones.columns if c != "geom"]
    start = bounded(zones, edges, cell).select(*rest, "_k", "_edges", "_w", "_e", "_s", "_n")
    top = start.agg(F.max("_k")).first()[0] or 0
    made = zones.select(*rest).withColumns({"_k": F.lit(0), "_cx": F.lit(0), "_cy": F.lit(0), "_whole": F.lit(True), "_base": F.lit(True), "_flips": F.array(F.lit(0.0)), "_edges": F.array(F.struct(*(F.lit(0.0).alias(c) for c in ("ax", "ay", "bx", "by"))))})
    schema = made.schema
    for f in schema.fields:
        f.nullable = True

    def rows(batch: pa.RecordBatch, of: list[int], cells: list[Cell]) -> pa.RecordBatch:
        each = lambda kind, values: pa.array(values, kind)
        sizes = np.cumsum([0, *(len(c.edges) for c in cells)])
        all_edges = np.concatenate([c.edges for c in cells]) if cells else np.zeros((0, 4))
        struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_edges[:, i])) for i in range(4)], names=["ax", "ay", "bx", "by"])
        kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in rest]
        whole = [True if _whole(c) else None for c in cells]
        flips = pa.array([c.flips for c in cells], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*kept, *(each(pa.int32(), [c[i] for c in cells]) for i in range(3)), each(pa.bool_(), whole), each(pa.bool_(), [c.base for c in cells]), flips, pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), struct)], names=schema.names)

    def matrix(lists: pa.ListArray, i: int) -> np.ndarray:
        held = lists[i].values
        return np.stack([held.field(c).to_numpy() for c in ("ax", "ay", "bx", "by")], axis=1)

    def sent(batch: pa.RecordBatch, found: Iterator[tuple[int, Cell]]) -> Iterator[pa.RecordBatch]:
        of, cells, size = [], [], 0
        for i, c in found:
            of.append(i)
            cells.append(c)
            size += len(c.edges) + 8
            if size > 100_000:
                yield rows(batch, of, cells)
                of, cells, size = [], [], 0
        yield rows(batch, of, cells)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def found(batch: pa.RecordBatch = batch) -> Iterator[tuple[int, Cell]]:
                for i, (k, w, e, s, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_k", "_w", "_e", "_s", "_n")), strict=True)):
                    side, whole = float(cell << k), Cell(k, 0, 0, matrix(batch.column("_edges"), i), False, np.zeros(0))
                    for cx in range(int(w // side), int(e // side) + 1):
                        for cy in range(int(s // side), int(n // side) + 1):
                            yield from ((i, c) for c in whole.child(k, cx, cy, cell).refined(ROUND, cell))

            yield from sent(batch, found())

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def found(batch: pa.RecordBatch = batch) -> Iterator[tuple[int, Cell]]:
                for i, (k, cx, cy, base, flips) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_k", "_cx", "_cy", "_base", "_flips")), strict=True)):
                    yield from ((i, c) for c in Cell(k, cx, cy, matrix(batch.column("_edges"), i), base, np.array(flips)).refined(ROUND, cell))

            yield from sent(batch, found())

    cells = start.mapInArrow(roots, schema)
    for _ in range(-(-top // ROUND) - 1):
        cells = cells.repartition("_k", "_cx", "_cy").mapInArrow(deeper, schema)
    return cells, top


def cut_small(cells: DataFrame) -> DataFrame:
    """All cells as cells of level 0."""
    along = lambda c: F.explode(F.expr(f"transform(sequence(0, shiftleft(1, _k) - 1), i -> {c} * shiftleft(1, _k) + i)"))
    return cells.withColumn("_cx", along("_cx")).withColumn("_cy", along("_cy")).drop("_k")


def at_cells(cells: DataFrame, occupied: DataFrame, top: int) -> DataFrame:
    """The cells of level 0 among `occupied` (_cx, _cy) that the cover reaches: each looks its cells of all levels up by an equi-join."""
    keys = occupied.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(top)))).selectExpr("_cx AS _px", "_cy AS _py", "_k", "shiftright(_cx, _k) AS _cx", "shiftright(_cy, _k) AS _cy")
    return keys.join(cells, ["_k", "_cx", "_cy"]).drop("_k", "_cx", "_cy").withColumnsRenamed({"_px": "_cx", "_py": "_cy"})


def inside(x: Column, y: Column) -> Column:
    """Whether a place of the cell lies in the zone: the even-odd rule with what the cell keeps."""

    def crosses(e: Column) -> Column:
        at = e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])
        return F.when(((e["ay"] > y) != (e["by"] > y)) & (x < at), F.lit(1)).otherwise(F.lit(0))

    odd = F.aggregate("_edges", F.col("_base").cast("int") + F.size(F.filter("_flips", lambda f: f <= y)), lambda n, e: n + crosses(e)) % 2 == 1
    return F.coalesce(F.col("_whole"), odd)
