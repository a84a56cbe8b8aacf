"""Cube algebra on wide pixel tables: one row for each (x, y[, t]), one column for each band."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import bands, dims, one_of, require

# --- shape -----------------------------------------------------------------------------------------


def filter_bands(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    require(df, labels)
    return df.select(*dims(df), *labels)


def band(df: DataFrame, label: str) -> DataFrame:
    """One band as `value`; the band dimension is gone."""
    return df.select(*dims(df), F.col(label).alias("value"))


def rename_labels(df: DataFrame, target: Sequence[str], source: Sequence[str] | None = None) -> DataFrame:
    """New labels for the source bands, or for all bands in order."""
    source = list(source) if source is not None else bands(df)
    if len(source) != len(target):
        raise ValueError(f"{len(target)} labels for {len(source)} bands")
    return df.withColumnsRenamed(dict(zip(source, target, strict=True)))


def suffix_labels(df: DataFrame, suffix: str, separator: str = "_") -> DataFrame:
    return df.withColumnsRenamed({b: f"{b}{separator}{suffix}" for b in bands(df)})


def add_dimension(df: DataFrame, name: str, label: str, kind: str = "other") -> DataFrame:
    """A bands dimension labels the single `value`; any other one becomes a constant column."""
    if kind == "bands":
        return df.withColumnRenamed("value", label)
    return df.withColumn(name, F.lit(label))


def drop_dimension(df: DataFrame, name: str) -> DataFrame:
    """Removes a dimension with one label; more labels fail when the result is computed, without an extra job."""
    require(df, [name])
    keys = [c for c in dims(df) if c != name]
    if name not in dims(df):
        if len(bands(df)) != 1:
            raise ValueError(f"{name} has more than one label")
        return df.withColumnRenamed(bands(df)[0], "value")
    limits = df.agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    checked = df.crossJoin(F.broadcast(limits))  # one row
    same = checked.where(F.when(F.col("_low") == F.col("_high"), F.lit(True)).otherwise(F.raise_error(F.lit(f"{name} has more than one label")).cast("boolean")))
    return same.select(*keys, *bands(df))


def apply(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({b: fn(F.col(b)) for b in bands(df)})


def apply_bands(df: DataFrame, fn: Callable[[dict[str, Column]], Mapping[str, Column]]) -> DataFrame:
    """New bands from all bands of a pixel."""
    made = fn({b: F.col(b) for b in bands(df)})
    return df.select(*dims(df), *(c.alias(k) for k, c in made.items()))


def reduce_bands(df: DataFrame, fn: Callable[[dict[str, Column]], Column], name: str = "value") -> DataFrame:
    return df.select(*dims(df), fn({b: F.col(b) for b in bands(df)}).alias(name))


def bands_to_rows(df: DataFrame, label: str = "band", value: str = "value") -> DataFrame:
    return df.select(*dims(df), *(F.col(b).cast("double").alias(b) for b in bands(df))).unpivot(dims(df), bands(df), label, value)


def rows_to_bands(df: DataFrame, labels: Sequence[str], label: str = "band", value: str = "value") -> DataFrame:
    """The labels are given, so that no job has to look for them."""
    return df.groupBy(*dims(df)).pivot(label, list(labels)).agg(F.first(value))


def one_hot(df: DataFrame, of: str, classes: Sequence[int], labels: Sequence[str] | None = None) -> DataFrame:
    labels = labels or [f"class_{c}" for c in classes]
    return df.select(*dims(df), *((F.col(of) == c).cast("int").alias(n) for c, n in zip(classes, labels, strict=True)))


# --- filters and masks --------------------------------------------------------------------------------


def filter_bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.where(F.col("x").between(west, east) & F.col("y").between(south, north))


def filter_temporal(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """start <= t < end; either end may be open."""
    if start is not None:
        df = df.where(F.col("t") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("t") < F.lit(end).cast("timestamp"))
    return df


def filter_properties(df: DataFrame, scenes: DataFrame, condition: Column, on: str = "t") -> DataFrame:
    """Observations of the scenes that meet a condition."""
    return df.join(scenes.where(condition).select(on).distinct(), on, "left_semi")


def scl_mask(classes: Sequence[int], band: str = "SCL") -> Column:
    return F.col(band).isin(*classes)


def mask_where(df: DataFrame, condition: Column, replacement: float | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """A mask from the same rows: no join. A null condition keeps the values."""
    hide = F.coalesce(condition.cast("boolean"), F.lit(False))
    return df.withColumns({b: F.when(hide, F.lit(replacement)).otherwise(F.col(b)) for b in (only or bands(df))})


def mask(df: DataFrame, by: DataFrame, replacement: float | None = None) -> DataFrame:
    """Hides all bands where the mask cube's first band is true or not 0; a mask without t holds for all t."""
    keys = [c for c in dims(by) if c in dims(df)]
    flag = bands(by)[0]
    joined = df.join(by.select(*keys, (F.col(flag).cast("double") != 0).alias("_mask")), keys, "left")
    return mask_where(joined, F.col("_mask"), replacement, bands(df)).drop("_mask")


def mask_values(df: DataFrame, values: Sequence[float], only: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({b: F.when(~F.col(b).isin(*values), F.col(b)) for b in (only or bands(df))})


def fill_nodata(df: DataFrame, value: float) -> DataFrame:
    return df.withColumns({b: F.coalesce(F.col(b), F.lit(value)) for b in bands(df)})


# --- reductions ------------------------------------------------------------------------------------------

_SIMPLE = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sd": F.stddev_samp, "count": F.count, "sum": F.sum, "any": F.bool_or, "all": F.bool_and}


def reducer(name: str, c: str, time: str = "t") -> Column:
    """An aggregate that ignores nodata; first and last go by time."""
    if name in ("first", "last"):
        when = F.when(F.col(c).isNotNull(), F.col(time))
        return (F.min_by if name == "first" else F.max_by)(F.col(c), when)
    one_of("reducer", name, list(_SIMPLE))
    value = F.col(c).cast("boolean") if name in ("any", "all") else F.col(c)
    return _SIMPLE[name](value)


def reduce_time(df: DataFrame, name: str) -> DataFrame:
    keys = [c for c in dims(df) if c != "t"]
    return df.groupBy(*keys).agg(*(reducer(name, b).alias(b) for b in bands(df)))


def max_strict(c: str) -> Column:
    """Maximum that any nodata turns into nodata."""
    return F.when(F.count(F.col(c)) == F.count(F.lit(1)), F.max(c))


def quantiles(df: DataFrame, probs: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Exact quantiles over time as bands, band-major."""
    every = df.groupBy("x", "y").agg(*(F.percentile(b, F.array(*map(F.lit, probs))).alias(b) for b in bands(df)))
    return every.select("x", "y", *(F.get(b, F.lit(i)).alias(f"{b}_{n}") for b in bands(df) for i, n in enumerate(labels)))


STATISTICS = ("min", "max", "mean", "sd", "q10", "q50", "q90")


def statistics_of(df: DataFrame, keys: Sequence[str], names: Sequence[str] = STATISTICS) -> DataFrame:
    """{band}_{name} of each band by the keys, band-major; all quantiles of a band come from one sorted buffer."""
    probs = [n for n in names if n[0] == "q" and n[1:].isdigit()]
    made = []
    for b in bands(df):
        made += [reducer(n, b).alias(f"{b}_{n}") for n in names if n not in probs]
        if probs:
            made.append(F.percentile(b, F.array(*(F.lit(int(n[1:]) / 100) for n in probs))).alias(f"_q_{b}"))
    agg = df.groupBy(*keys).agg(*made)
    return agg.select(*keys, *((F.get(f"_q_{b}", F.lit(probs.index(n))) if n in probs else F.col(f"{b}_{n}")).alias(f"{b}_{n}") for b in bands(df) for n in names))


def time_to_bands(df: DataFrame, statistics: Sequence[str] = STATISTICS) -> DataFrame:
    """All statistics of all bands over time in one aggregation; labels are band-major."""
    return statistics_of(df, ["x", "y"], statistics)



def pick_reducer(name: str | None) -> str:
    """median, mean or max whatever the case, else min."""
    return next((n for n in ("median", "mean", "max") if name is not None and name.lower() == n), "min")


PERIODS = ("day", "week", "dekad", "month", "season", "year")


def period_start(period: str, t: str = "t") -> Column:
    """First day of the period that a time lies in; a season starts in December, March, June or September."""
    one_of("period", period, PERIODS)
    month = F.date_trunc("month", F.col(t))
    if period == "dekad":
        return F.date_add(month.cast("date"), F.least(F.floor((F.dayofmonth(t) - 1) / 10), F.lit(2)).cast("int") * 10).cast("timestamp")
    if period == "season":
        return F.add_months(month.cast("date"), -(F.month(t) % 3)).cast("timestamp")
    return F.date_trunc(period, F.col(t))


def aggregate_temporal_period(df: DataFrame, period: str, name: str = "mean") -> DataFrame:
    keys = [c for c in dims(df) if c != "t"]
    grouped = df.groupBy(*keys, period_start(period).alias("_period"))
    return grouped.agg(*(reducer(name, b).alias(b) for b in bands(df))).select(*keys, F.col("_period").alias("t"), *bands(df))


def aggregate_temporal(df: DataFrame, intervals: Sequence[tuple[str, str]], name: str = "mean") -> DataFrame:
    """One row for each pixel and interval (start <= t < end) that has observations; `t` is the interval's start.

    The intervals are arguments, so that each row finds its own by an expression; those that overlap each get it.
    """
    ends = [(F.lit(s).cast("timestamp"), F.lit(e).cast("timestamp")) for s, e in intervals]
    hits = F.filter(F.array(*(F.when((F.col("t") >= s) & (F.col("t") < e), s) for s, e in ends)), lambda v: v.isNotNull())
    keys = [c for c in dims(df) if c != "t"]
    return df.withColumn("_start", F.explode(hits)).groupBy(*keys, "_start").agg(*(reducer(name, b).alias(b) for b in bands(df))).select(*keys, F.col("_start").alias("t"), *bands(df))


# --- joins of cubes ------------------------------------------------------------------------------------------


def merge_cubes(a: DataFrame, b: DataFrame, resolver: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Union of bands on equal dimensions; bands that both have are combined where both have a value, else passed through."""
    shared = [c for c in bands(a) if c in bands(b)]
    if shared and resolver is None:
        raise ValueError(f"both cubes have {', '.join(shared)}: give a resolver")
    keys = [c for c in dims(a) if c in dims(b)]
    right = b.withColumnsRenamed({c: f"_{c}" for c in shared})
    how = "full_outer" if dims(a) == dims(b) else "left"
    joined = a.join(right, keys, how)
    both = lambda c: F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNotNull(), resolver(F.col(c), F.col(f"_{c}"))).otherwise(F.coalesce(c, f"_{c}"))
    return joined.select(*dims(a), *((both(c).alias(c) if c in shared else F.col(c)) for c in [*bands(a), *(c for c in bands(b) if c not in shared)]))


def merge_static(cube: DataFrame, static: DataFrame) -> DataFrame:
    """A cube without time beside one with it, for every time. Spark broadcasts the static side if its measured size allows."""
    return cube.join(static, ["x", "y"], "left")


def resample_grid(df: DataFrame, factor: int, method: str = "near", align: str | None = None) -> DataFrame:
    """Coarser cells of factor x factor pixels: `near` takes the upper-left pixel's values, nodata or not, `average` the mean.

    Cells begin at multiples of the factor, or with align at a corner of the cube's extent: upper-left, upper-right, lower-left or
    lower-right (y grows downwards). The extent is four numbers of one aggregation.
    """
    one_of("method", method, ("near", "average"))
    keys = [c for c in dims(df) if c not in ("x", "y")]
    start = {"x": 0, "y": 0}
    if align is not None:
        one_of("align", align, ("upper-left", "upper-right", "lower-left", "lower-right"))
        left, right, top, bottom = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if left is not None:
            start = {"x": (left if align.endswith("left") else right + 1) % factor, "y": (top if align.startswith("upper") else bottom + 1) % factor}
    cell = [F.floor((F.col(c) - start[c]) / factor).cast("int").alias(c) for c in ("x", "y")]
    if method == "average":
        made = [F.avg(b).alias(b) for b in bands(df)]
    else:
        first = F.min_by(F.struct(*bands(df)), F.struct("y", "x"))
        made = [first[b].alias(b) for b in bands(df)]
    source = df.select("*", *(c.alias(f"_{n}") for c, n in zip(cell, ("x", "y"), strict=True)))
    return source.groupBy("_x", "_y", *keys).agg(*made).select(F.col("_x").alias("x"), F.col("_y").alias("y"), *keys, *bands(df))


class Grid(NamedTuple):
    """Cell (i, j) covers x + i * step to x + (i + 1) * step, and y likewise."""

    x: float
    y: float
    step: float


def resample_between(df: DataFrame, source: Grid, target: Grid, method: str = "average") -> DataFrame:
    """A cube of one grid's cells in the cells of another, of any origin and step.

    `average` weighs the source cells by the area that they share with a target cell; nodata is left out and the other weights
    scaled up. `near` takes the cell that holds the target's centre. Each source cell goes to the target cells that it touches: one shuffle with
    partial sums, and no join.
    """
    one_of("method", method, ("near", "average"))
    rest = [c for c in dims(df) if c not in ("x", "y")]

    def touched(c: str, s0: float, t0: float) -> Column:
        """Target cells along one side, and how much of the side they share with the source cell."""
        low, high = s0 + F.col(c) * F.lit(source.step), s0 + (F.col(c) + 1) * F.lit(source.step)
        at = lambda v: (v - t0) / F.lit(target.step)
        if method == "near":  # cells whose centre lies in it
            cells = F.sequence(F.ceil(at(low) - 0.5), F.ceil(at(high) - 0.5) - 1)
            cells = F.when(F.ceil(at(high) - 0.5) - 1 >= F.ceil(at(low) - 0.5), cells)
            return F.transform(cells, lambda i: F.struct(i.cast("int").alias("i"), F.lit(1.0).alias("w")))
        cells = F.sequence(F.floor(at(low)), F.greatest(F.floor(at(low)), F.ceil(at(high)) - 1))
        return F.transform(cells, lambda i: F.struct(i.cast("int").alias("i"), (F.least(high, t0 + (i + 1) * F.lit(target.step)) - F.greatest(low, t0 + i * F.lit(target.step))).alias("w")))

    sent = df.withColumn("_i", F.explode(touched("x", source.x, target.x))).withColumn("_j", F.explode(touched("y", source.y, target.y)))
    sent = sent.withColumn("_w", F.col("_i.w") * F.col("_j.w")).where("_w > 0")
    made = [F.try_divide(F.sum(F.col(b) * F.col("_w")), F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))).alias(b) if method == "average" else F.max(b).alias(b) for b in bands(df)]
    out = sent.groupBy(F.col("_i.i").alias("_x"), F.col("_j.i").alias("_y"), *rest).agg(*made)
    return out.select(F.col("_x").alias("x"), F.col("_y").alias("y"), *rest, *bands(df))


def resample_to(df: DataFrame, target: DataFrame, factor: int, method: str = "near") -> DataFrame:
    """A coarse cube (cells of factor x factor target pixels) on a finer cube's pixels: near, average (each pixel lies in one cell, so that this is its value too) or bilinear. resample_between() takes grids of any origin and step.

    Bilinear weighs the four cells around a pixel's centre by distance; cells without a value are left out and the
    weights of the others scaled up.
    """
    one_of("method", method, ("near", "average", "bilinear"))
    rest = [c for c in dims(df) if c not in ("x", "y")]
    grid = target.select("x", "y").distinct()
    if method != "bilinear":
        cells = df.withColumnsRenamed({"x": "_cx", "y": "_cy"})
        keyed = grid.withColumn("_cx", F.floor(F.col("x") / factor).cast("int")).withColumn("_cy", F.floor(F.col("y") / factor).cast("int"))
        return keyed.join(cells, ["_cx", "_cy"]).select("x", "y", *rest, *bands(df))
    place = lambda c: (F.col(c) + 0.5) / factor - 0.5
    corners = F.array(*(F.struct((F.floor(place("x")) + i).cast("int").alias("_cx"), (F.floor(place("y")) + j).cast("int").alias("_cy"), ((1 - F.abs(place("x") - F.floor(place("x")) - i)) * (1 - F.abs(place("y") - F.floor(place("y")) - j))).alias("_w")) for i in (0, 1) for j in (0, 1)))
    spread = grid.select("x", "y", F.explode(corners).alias("_c")).select("x", "y", "_c.*")
    joined = spread.join(df.withColumnsRenamed({"x": "_cx", "y": "_cy"}), ["_cx", "_cy"])
    weight = lambda b: F.when(F.col(b).isNotNull(), F.col("_w"))
    return joined.groupBy("x", "y", *rest).agg(*(F.try_divide(F.sum(F.col(b) * F.col("_w")), F.sum(weight(b))).alias(b) for b in bands(df)))
