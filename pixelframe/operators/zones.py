"""Polygons over pixels: containment, zonal joins and statistics.

Zones are rows (feature_index, geom): geom is an array of rings, each an array of struct<x, y>; a point lies inside if a
ray to the right crosses an odd number of edges, so that inner rings are holes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import bands, dims
from ..sources.shared import checkpoint
from . import cover as cv
from .cube import reducer
from .selection import quantiles_of_groups

#: Cells of the equi-join key in pixels.
CELL = 64


def edges(geom: Column) -> Column:
    """The edges of all rings as array<struct<ax, ay, bx, by>>, each ring closed."""

    def of(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.flatten(F.transform(geom, of))


def inside(lines: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of the edges; lower and left edges belong to the polygon."""

    def crosses(e: Column) -> Column:
        at = e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])
        return F.when(((e["ay"] > y) != (e["by"] > y)) & (x < at), F.lit(1)).otherwise(F.lit(0))

    return F.aggregate(lines, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def contains(geom: Column, x: Column, y: Column) -> Column:
    return inside(edges(geom), x, y)


def is_box(geom: Column) -> Column:
    return (F.size(geom) == 1) & (F.size(F.get(geom, F.lit(0))) <= 5)


def _meeting(df: DataFrame, zones: DataFrame, cell: int, centre: float) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Pixels and zones with their cells, and the conditions under which they meet.

    Zones of a few cells are cut into cells of one size. Of larger ones only those cells that hold pixels are looked up, in all sizes of the
    cover, so that each pixel is shuffled once and zones as often as their borders are long.
    """
    px, py = F.col("x") + centre, F.col("y") + centre
    keyed = df.withColumn("_px", F.floor(px / cell).cast("int")).withColumn("_py", F.floor(py / cell).cast("int"))
    cells, top = cv.cover(zones, edges(F.col("geom")), cell)
    if top <= cv.SMALL:
        cells = cv.cut_small(cells)
    else:
        cells = cv.at_cells(cells, keyed.select(F.col("_px").alias("_cx"), F.col("_py").alias("_cy")).distinct(), top)
    return keyed, cells, [F.col("_px") == F.col("_cx"), F.col("_py") == F.col("_cy"), cv.inside(px, py)]


def zonal_join(df: DataFrame, zones: DataFrame, cell: int = CELL, keep: Sequence[str] = ("feature_index",), centre: float = 0.5) -> DataFrame:
    """Each pixel with each feature that holds its centre: an equi-join on cells of the zones' covers, then the edges that come into the cell.

    Spark may broadcast the cells if they are small; with many they are shuffled like the pixels.
    """
    keyed, cells, meet = _meeting(df, zones.select(*keep, "geom"), cell, centre)
    return keyed.join(cells, meet).select(*df.columns, *keep)


def filter_spatial(df: DataFrame, zones: DataFrame, cell: int = CELL) -> DataFrame:
    """Pixels whose centre lies in any zone, each once: a semi-join."""
    keyed, cells, meet = _meeting(df, zones.select("geom"), cell, 0.5)
    return keyed.join(cells, meet, "left_semi").select(*df.columns)


def mask_polygon(df: DataFrame, zones: DataFrame, inside: bool = False, cell: int = CELL) -> DataFrame:
    """Nodata outside (or inside) the zones."""
    hits = zonal_join(df.select("x", "y").distinct(), zones, cell).select("x", "y").distinct().withColumn("_hit", F.lit(True))
    joined = df.join(hits, ["x", "y"], "left")
    keep = F.col("_hit").isNull() if inside else F.col("_hit").isNotNull()
    return joined.withColumns({b: F.when(keep, F.col(b)) for b in bands(df)}).drop("_hit")


def aggregate_spatial(df: DataFrame, zones: DataFrame, name: str = "mean", cell: int = CELL) -> DataFrame:
    """One row for each feature (and time), with one value for each band; nodata is ignored. Medians of large features are selected, not buffered."""
    keys = ["feature_index", *(c for c in dims(df) if c == "t")]
    if name != "median":
        return zonal_join(df, zones, cell).groupBy(*keys).agg(*(reducer(name, b).alias(b) for b in bands(df)))
    joined = checkpoint(zonal_join(df, zones, cell))
    out = joined.select(*keys).distinct()
    for b in bands(df):
        out = out.join(quantiles_of_groups(joined, keys, b, [0.5]).withColumnRenamed("q0", b), keys, "left")
    return out


def vector_to_raster(stats: DataFrame, zones: DataFrame, target: DataFrame, cell: int = CELL) -> DataFrame:
    """Each feature's values on the target's pixels; where features overlap that of the smallest index."""
    values = [c for c in stats.columns if c not in ("feature_index", "t")]
    grid = target.select("x", "y").distinct()
    own = zonal_join(grid, zones, cell).groupBy("x", "y").agg(F.min("feature_index").alias("feature_index"))
    return grid.join(own.join(stats, "feature_index"), ["x", "y"], "left").select("x", "y", *(c for c in ("t",) if c in stats.columns), *values)


def variability_classes(df: DataFrame, zones: DataFrame, value: str = "value", raw: bool = False, cell: int = CELL) -> DataFrame:
    """Each pixel against its zone's median on the same date in percent, as classes 1 to 5 (or raw percent); clamped to 0..100 at the end."""
    joined = checkpoint(zonal_join(df.select(*dims(df), value), zones, cell))
    keys = ["feature_index", *(c for c in dims(df) if c == "t")]
    middle = quantiles_of_groups(joined, keys, value, [0.5]).withColumnRenamed("q0", "_median")
    out = joined.join(middle, keys).withColumn("_share", F.try_divide(F.col(value).cast("double"), F.col("_median")) * 100)
    s = F.col("_share")
    classed = F.when(s < 85, 1).when(s < 95, 2).when(s < 105, 3).when(s < 115, 4).when(s.isNotNull(), 5)
    made = (s if raw else classed).cast("double")
    return out.select("feature_index", *dims(df), F.when(made.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), made))).alias("variability"))
