"""Operators over a pixel's series, as Spark windows, and over its neighbourhood, by blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide
from ..meta import bands, dims, one_of
from .blocks import Block, box_sums, city_block, in_blocks, weighted_sums

#: Scales a median absolute deviation to a normal standard deviation (fixed value).
MAD_SCALE = 1.4826


def _pixel():
    return Window.partitionBy("x", "y")


def _series():
    return _pixel().orderBy("t")


def apply_time(df: DataFrame, fn) -> DataFrame:
    """Each band's series by a function of (column, window of the pixel in order of time)."""
    return df.withColumns({b: fn(F.col(b), _series()) for b in bands(df)})


def rank_mask(value: Column) -> Column:
    """True where a value isn't its pixel's largest over time; equal ones all survive, nodata gives nodata."""
    return value != F.max(value).over(_pixel())


def nmad_outliers(df: DataFrame, band: str = "B02", sigma: float = 3.0, min_offset: float = 80.0, only: Sequence[str] | None = None) -> DataFrame:
    """Hides all bands where the band lies above its pixel's median by sigma scaled deviations and by min_offset."""
    with_median = df.withColumn("_med", F.median(band).over(_pixel()))
    with_mad = with_median.withColumn("_mad", F.median(F.abs(F.col(band) - F.col("_med"))).over(_pixel()))
    out = (F.col(band) > F.col("_med") + sigma * MAD_SCALE * F.col("_mad")) & (F.col(band) > F.col("_med") + min_offset)
    hide = F.coalesce(out, F.lit(False))
    flagged = with_mad.withColumn("_out", hide)
    return flagged.withColumns({b: F.when(~F.col("_out"), F.col(b)) for b in (only or bands(df))}).drop("_med", "_mad", "_out")


def interpolate_linear(df: DataFrame, by: str = "position") -> DataFrame:
    """Fills gaps between two observations of a pixel linearly, by position or by time; both ends stay nodata."""
    one_of("by", by, ("position", "time"))
    place = F.row_number().over(_series()).cast("double") if by == "position" else F.unix_micros("t").cast("double")
    df_ = df.withColumn("_i", place)
    back = _series().rowsBetween(Window.unboundedPreceding, 0)
    ahead = _series().rowsBetween(0, Window.unboundedFollowing)
    made = {}
    for b in bands(df):
        known = F.when(F.col(b).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(b).cast("double").alias("v")))
        low, high = F.last(known, True).over(back), F.first(known, True).over(ahead)
        share = divide(F.col("_i") - low["i"], high["i"] - low["i"])
        made[b] = F.when(F.col(b).isNotNull(), F.col(b).cast("double")).otherwise(low["v"] + share * (high["v"] - low["v"]))
    return df_.withColumns(made).drop("_i")


# --- neighbourhoods -------------------------------------------------------------------------------------


def moving_sum(df: DataFrame, radius: int, only: Sequence[str] | None = None) -> DataFrame:
    """Sums of the (2r+1) x (2r+1) pixels around each, by blocks with a margin: linear whatever the radius.

    Missing pixels and nodata count 0; all sums are of the rows of one date. Other columns stay as they are.
    """
    names = list(only or bands(df))
    return in_blocks(df, lambda block, v: {b: block.rows(box_sums(block.matrix(v[b]), radius, radius)) for b in names}, radius, names)


def apply_kernel(df: DataFrame, kernel: Sequence[Sequence[float]], factor: float = 1.0, border: float = 0.0, replace_invalid: float = 0.0) -> DataFrame:
    """Weighted moving sums with any kernel of odd size; pixels outside have `border`, nodata `replace_invalid`.

    Flat kernels (all weights equal) are sums of a rectangle, others are added up weight by weight, inside the blocks.
    """
    weights, names = np.array(kernel, float), bands(df)
    ry, rx = weights.shape[0] // 2, weights.shape[1] // 2

    def work(block: Block, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for b in names:  # what lies outside differs from the border by 0
            m = block.matrix(np.where(np.isfinite(v[b]), v[b], replace_invalid) - border)
            summed = weights[0, 0] * box_sums(m, ry, rx) if (weights == weights[0, 0]).all() else weighted_sums(m, weights)
            out[b] = block.rows(summed + border * weights.sum()) * factor
        return out

    return in_blocks(df, work, max(ry, rx), names)


def _full(m: np.ndarray, present: np.ndarray, size: int) -> np.ndarray:
    return (present & (box_sums(m, size // 2, size // 2) >= size * size)).astype(float)


def _touched(m: np.ndarray, size: int) -> np.ndarray:
    return (box_sums(m, size // 2, size // 2) > 0).astype(float)


def erode(df: DataFrame, size: int = 3) -> DataFrame:
    """1 where all pixels of the window are set, else 0 (a window cut by the border is not full)."""
    return in_blocks(df, lambda k, v: {b: k.rows(_full(k.matrix(v[b]), k.present, size)) for b in v}, size // 2, bands(df))


def dilate(df: DataFrame, size: int = 3) -> DataFrame:
    return in_blocks(df, lambda k, v: {b: k.rows(_touched(k.matrix(v[b]), size)) for b in v}, size // 2, bands(df))


def opening(df: DataFrame, size: int = 3) -> DataFrame:
    """Both steps inside one block."""
    return in_blocks(df, lambda k, v: {b: k.rows(_touched(_full(k.matrix(v[b]), k.present, size), size)) for b in v}, 2 * (size // 2), bands(df))


def scl_dilation_mask(df: DataFrame, band: str = "SCL", kernel1_size: int = 17, kernel2_size: int = 77, mask1_values: Sequence[int] = (2, 4, 5, 6, 7), mask2_values: Sequence[int] = (3, 8, 9, 10, 11), erosion_kernel_size: int = 3) -> DataFrame:
    """`mask` (true: hide): what is none of mask1_values, and mask2_values, each eroded, then dilated with its kernel.

    mask1_values are read as the classes to keep, so that the first mask is their complement; nodata is in neither. All steps stay in one block.
    """
    keep, hide = np.array(mask1_values, float), np.array(mask2_values, float)
    shrink = erosion_kernel_size if erosion_kernel_size > 1 else 1

    def work(block: Block, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        c = v[band]
        out = np.zeros(len(c), bool)
        for hit, size in ((np.isfinite(c) & ~np.isin(c, keep), kernel1_size), (np.isin(c, hide), kernel2_size)):
            m = block.matrix(hit.astype(float))
            out |= block.rows(_touched(_full(m, block.present, shrink) if shrink > 1 else m, size)) > 0
        return {"mask": out}

    return in_blocks(df.select(*dims(df), band), work, shrink // 2 + max(kernel1_size, kernel2_size) // 2, [band], {"mask": "boolean"}).drop(band)


def cloud_distance_score(df: DataFrame, cloud: str, limit: int = 150, sigma: float = 50.0) -> DataFrame:
    """`score`: 0 on cloud, 1 from `limit` pixels away, between them 1 - exp(-d^2 / (2 sigma^2)) of the city-block distance d.

    The distance is exact: clouds beyond the limit don't matter, and a block has a margin of it.
    """

    def work(block: Block, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        d = block.rows(city_block(block.matrix(v[cloud]) > 0))
        near = np.minimum(d, limit)
        return {"score": np.where(d > limit, 1.0, np.where(d == 0, 0.0, 1 - np.exp(-near * near / (2.0 * sigma * sigma))))}

    return in_blocks(df, work, limit, [cloud], {"score": "double"})


def date_score(sigma: float = 10.0, t: str = "t") -> Column:
    """A Gaussian around the middle of the month."""
    d = (F.dayofmonth(t) - 15).cast("double")
    return F.exp(-d * d / F.lit(2.0 * sigma * sigma))


def coverage_score(df: DataFrame, cloud: Column) -> DataFrame:
    """For each date 1 minus the share of cloudy pixels."""
    return df.groupBy("t").agg((1 - F.avg(cloud.cast("double"))).alias("coverage"))


def rank_composite(df: DataFrame, score: str, keys: Sequence[str] = ("x", "y"), only: Sequence[str] | None = None) -> DataFrame:
    """All bands of the observation with the best score of each pixel (and other keys); the earliest of equal ones."""
    names = list(only or [b for b in bands(df) if b != score and b not in keys])
    best = F.max_by(F.struct("t", *names), F.when(F.col(score).isNotNull(), F.struct(F.col(score), -F.unix_micros("t"))))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.t", *(F.col(f"_b.{n}").alias(n) for n in names))


def peak_valley(df: DataFrame, band: str, drop_threshold: float = 0.15, recovery_ratio: float = 1.0, slope_threshold: float = 0.007) -> DataFrame:
    """`turn`: -1 for a valley, 1 for a peak, 0 else, by drop, recovery and slope of a pixel's series.

    A valley is a local minimum at least drop_threshold below the highest value before it, that a later value
    makes up for by recovery_ratio of the drop, with a slope into it of slope_threshold a day or more. A peak is a local maximum
    with a later value at least drop_threshold lower.
    """
    v = F.col(band).cast("double")
    prior, after = F.lag(v).over(_series()), F.lead(v).over(_series())
    high = F.max(v).over(_series().rowsBetween(Window.unboundedPreceding, -1))
    later_high = F.max(v).over(_series().rowsBetween(1, Window.unboundedFollowing))
    later_low = F.min(v).over(_series().rowsBetween(1, Window.unboundedFollowing))
    days = (F.unix_micros("t") - F.lag(F.unix_micros("t")).over(_series())) / F.lit(86_400_000_000.0)
    marked = df.withColumns({"_p": prior, "_n": after, "_h": high, "_lh": later_high, "_ll": later_low, "_s": divide(prior - v, days)})
    drop = F.col("_h") - v
    valley = (v < F.col("_p")) & (v <= F.col("_n")) & (drop >= drop_threshold) & (F.col("_lh") - v >= recovery_ratio * drop) & (F.col("_s") >= slope_threshold)
    peak = (v > F.col("_p")) & (v >= F.col("_n")) & (v - F.col("_ll") >= drop_threshold)
    return marked.withColumn("turn", F.when(valley, -1).when(peak, 1).otherwise(0)).drop("_p", "_n", "_h", "_lh", "_ll", "_s")
