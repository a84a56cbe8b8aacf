"""Rasters by blocks: a block is tiles of one date each, with the pixels around them, as matrices in one task.

Each pixel goes to its own tile and to those that need it in their margin, four at most, in one exchange. What is done to the
matrices (sums, distances, several steps one after the other) stays inside the block. Tiles with few pixels share a matrix: empty rows and
columns beyond the reach are left out and the tiles lie side by side, further apart than the reach, so that work follows the pixels and not the area that they span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import dims

#: Side of a tile in pixels, at least; a margin is half a tile at most.
SIDE = 256
#: Places of a matrix that tiles share, some; and rows that a task holds at once (a whole tile at least).
PLACES, ROWS = 1 << 17, 1 << 17


class Block:
    """The pixels that a block holds, in the rectangle that they span. Matrices are (rows, columns)."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        left, low = int(x.min()), int(y.min())
        self.shape = int(y.max()) - low + 1, int(x.max()) - left + 1
        self.at = (y - low) * self.shape[1] + (x - left)

    @cached_property
    def present(self) -> np.ndarray:
        return self._filled(np.ones(len(self.at))) > 0

    def _filled(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values, self.shape[0] * self.shape[1]).reshape(self.shape)

    def matrix(self, values: np.ndarray) -> np.ndarray:
        """The values in their places, added up where a place has several; 0 elsewhere and for what isn't a finite number."""
        return self._filled(np.where(np.isfinite(values), values, 0.0))

    def known(self, values: np.ndarray) -> np.ndarray:
        """How many finite values each place has."""
        return self._filled(np.isfinite(values).astype(float))

    def rows(self, matrix: np.ndarray) -> np.ndarray:
        return matrix.reshape(-1)[self.at]


def box_sums(m: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Sums of the (2ry+1) x (2rx+1) places around each; outside is 0. Nothing is subtracted, so that large values elsewhere cost no digits."""
    padded = np.pad(m, ((ry, ry), (rx, rx)))
    return _run_sums(_run_sums(padded, 2 * ry + 1).T, 2 * rx + 1).T


def _run_sums(m: np.ndarray, n: int) -> np.ndarray:
    """Sums of n rows that follow each other, put together from sums of 1, 2, 4, ... rows."""
    out, done, size, length = 0.0, 0, 1, len(m) - n + 1
    while True:
        if n & size:
            out = out + m[done : done + length]
            done += size
        if 2 * size > n:
            return out
        m = m[:-size] + m[size:]
        size *= 2


def weighted_sums(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The kernel's weighted sums around each place; outside is 0."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    p, out = np.pad(m, ((ry, ry), (rx, rx))), np.zeros(m.shape)
    for i, j in np.argwhere(kernel):
        out += kernel[i, j] * p[i : i + m.shape[0], j : j + m.shape[1]]
    return out


def city_block(seeds: np.ndarray) -> np.ndarray:
    """The distance |dx| + |dy| of each place to the nearest seed, infinite without one: two running minima along each side."""
    d = np.where(seeds, 0.0, np.inf)
    for axis in (1, 0):
        place = np.arange(d.shape[axis], dtype=float)
        place = place if axis else place[:, None]
        before = np.minimum.accumulate(d - place, axis) + place
        after = np.flip(np.minimum.accumulate(np.flip(d + place, axis), axis), axis) - place
        d = np.minimum(before, after)
    return d


def _closed_up(tile: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places along one side, from 0 within each tile, gaps beyond the reach closed to reach + 1; and the length of each tile's side."""
    order = np.lexsort((at, tile))
    first = np.flatnonzero(np.diff(tile[order], prepend=-1))
    step = np.minimum(np.diff(at[order], prepend=0), reach + 1)
    step[first] = 0
    place = np.cumsum(step)
    place -= place[first][tile[order]]
    out = np.empty_like(place)
    out[order] = place
    return out, place[np.append(first[1:], len(place)) - 1] + 1


def laid_apart(tile: np.ndarray, x: np.ndarray, y: np.ndarray, reach: int, places: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, x, y): the tiles (0, 1, ... in order) in common rectangles of some `places`, or of one tile.

    Two pixels of a tile within the reach keep their offset; all others are further apart than the reach, along x or along y.
    """
    x, width = _closed_up(tile, x, reach)
    y, height = _closed_up(tile, y, reach)
    level = np.ceil(2 * np.log2(height))  # those of like height share a rectangle
    order = np.argsort(level, kind="stable")
    ends = np.cumsum(width[order] + reach)
    share = np.cumsum((width + reach)[order] * 2.0 ** (level[order] / 2)) // places
    new = (np.diff(level[order], prepend=-1) != 0) | (np.diff(share, prepend=-1) != 0)
    begins = ends - (width[order] + reach)
    left, of = np.empty_like(ends), np.empty_like(ends)
    of[order] = np.cumsum(new) - 1
    left[order] = begins - begins[new][of[order]]
    x = x + left[tile]
    rows = np.argsort(of[tile], kind="stable")
    for part in np.split(rows, np.flatnonzero(np.diff(of[tile][rows])) + 1):
        yield part, x[part], y[part]


def tiles_of(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The number of each row's tile: 0, 1, ... in the table's order."""
    new = np.zeros(max(len(table) - 1, 0), bool)
    for k in keys:
        column = table.column(k)
        a, b = column.slice(1), column.slice(0, len(new))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (a.is_null().to_numpy() != b.is_null().to_numpy())
    return np.concatenate([np.zeros(min(len(table), 1), np.int64), np.cumsum(new)])


def whole_tiles(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int = ROWS) -> Iterator[pa.Table]:
    """Batches in order of the keys as tables of some `rows`, each of whole tiles."""
    held, n, enough = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        tile = tiles_of(table, keys)
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, n = table.slice(cut).to_batches(), len(table) - cut
        enough = max(rows, 2 * n)  # a tile that goes on
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def by_tiles(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a tile after each other in one task; a task holds many tiles."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def in_blocks(df: DataFrame, work: Callable[[Block, dict[str, np.ndarray]], dict[str, np.ndarray]], reach: int, reads: Sequence[str], makes: Mapping[str, str] | None = None, size: int = SIDE) -> DataFrame:
    """df with the columns that `work` makes of a block, for each pixel from what lies within `reach` of it.

    work gets the block and the columns `reads` as numbers (NaN: nodata), and gives a number for each of the block's rows. New columns
    (makes: their types, double if none are given) replace those of the same name. Rows without x or y are left out; other columns pass
    through. A tile is twice the reach at least, so that a pixel goes to four tiles at most. A block may hold several tiles (`laid_apart`).
    """
    size, reach = max(size, 2 * reach), max(reach, 0)
    makes = dict(makes or {c: "double" for c in reads})
    keys = ["_tx", "_ty", *(c for c in dims(df) if c == "t")]
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    sent = df.withColumn("_tx", tiles("x")).withColumn("_ty", tiles("y"))
    made = df.select(*(F.lit(None).cast(makes[c]).alias(c) if c in makes else F.col(c) for c in df.columns), *(F.lit(None).cast(k).alias(c) for c, k in makes.items() if c not in df.columns))
    schema = made.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches, keys):
            types = to_arrow(table, schema.names, makes)
            table, tile, own, x, y = owned(table, keys, size)
            if not len(table):
                continue
            values, found = {c: _numbers(table.column(c)) for c in reads}, {c: np.empty(len(table)) for c in makes}
            for rows, px, py in laid_apart(tile, x, y, reach):
                for c, v in work(Block(px, py), {c: v[rows] for c, v in values.items()}).items():
                    found[c][rows] = v
            kept = table.filter(pa.array(own))
            columns = [pa.array(found[f.name][own], from_pandas=True).cast(f.type) if f.name in makes else kept.column(f.name) for f in types]
            yield from pa.Table.from_arrays(columns, schema=types).combine_chunks().to_batches()

    return by_tiles(sent, keys).mapInArrow(run, schema)


def owned(table: pa.Table, keys: Sequence[str], size: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Without the margins that have no tile: the rows, the number of each one's tile, whether it is the tile's own pixel, x and y."""
    x, y, tx, ty = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "_tx", "_ty"))
    tile, own = tiles_of(table, keys), (x // size == tx) & (y // size == ty)
    held = np.bincount(tile, own)[tile] > 0
    return table.filter(pa.array(held)), np.unique(tile[held], return_inverse=True)[1], own[held], x[held], y[held]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As doubles, NaN for null; flags as 0 and 1, decimals rounded."""
    column = column.cast(pa.int8()) if pa.types.is_boolean(column.type) else column
    return column.cast(pa.float64()).to_numpy()


_ARROW = {"double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}


def to_arrow(table: pa.Table, names: Sequence[str], makes: Mapping[str, str]) -> pa.Schema:
    return pa.schema([pa.field(c, _ARROW[makes[c]]) if c in makes else table.schema.field(c) for c in names])
