"""Whole workflows over cubes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions.scalar import clip, divide, linear_scale, num
from ..meta import bands
from ..operators import cube as cb
from ..operators import udf
from ..operators import windows as wn
from ..operators import zones as zn

#: Scene classes that hide a pixel in composites (fixed values): no data, saturated, shadow, water, cloud and snow classes.
COMPOSITE_MASK = (3, 8, 9, 10, 1, 6, 11, 0)
MONTHLY_MASK = (3, 8, 9, 10, 11)


def max_ndvi(df: DataFrame) -> DataFrame:
    """The largest vegetation index of each pixel over time."""
    return df.groupBy("x", "y").agg(F.round(F.max(ix.ndvi()), 6).alias("max_ndvi"))


def _best_by(df: DataFrame, value: Column, shown: Sequence[str], hidden: Column, strict: bool) -> DataFrame:
    """Bands of the dates with a pixel's largest value; of several such dates the largest of each band, or with strict the first date's."""
    scored = df.where(~hidden).withColumn("_v", value)
    if strict:
        return wn.rank_composite(scored, "_v", only=shown).drop("t")
    top = lambda b: F.max(F.struct("_v", F.col(b).alias("b")))["b"]
    unknown = lambda b: F.max(F.when(F.col("_v").isNull(), F.col(b)))  # noqa: E731  dates without a value aren't hidden either
    return scored.groupBy("x", "y").agg(*(F.greatest(top(b), unknown(b)).alias(b) for b in shown))


def max_ndvi_composite(df: DataFrame, scenes: DataFrame | None = None, shown: Sequence[str] = ("B04", "B03", "B02"), max_cloud_cover: float = 75, strict: bool = False) -> DataFrame:
    """For each pixel the bands of its greenest clear date; one scan, one aggregation.

    Pixels that are never clear are absent. With equal indices on several dates each band's maximum is taken.
    """
    if scenes is not None:
        df = cb.filter_properties(df, scenes, F.col("cloud_cover") <= max_cloud_cover)
    return _best_by(df, ix.ndvi(), shown, F.coalesce(cb.scl_mask(COMPOSITE_MASK), F.lit(False)), strict)


def monthly_composite(df: DataFrame) -> DataFrame:
    """Natural colours of the clear date with the best ratio of near infrared to green."""
    coloured = df.withColumns(ix.natural_colour()).withColumn("_ratio", divide("B08", "B03"))
    return _best_by(coloured, F.col("_ratio"), ("red", "green", "blue"), F.coalesce(cb.scl_mask(MONTHLY_MASK), F.lit(False)), False)


def cloudless_mosaic(df: DataFrame, valid: Column, shown: Sequence[str]) -> DataFrame:
    """Each band's median over the valid dates, or over the others where none is valid."""
    return df.groupBy("x", "y").agg(*(F.coalesce(F.median(F.when(valid, F.col(b))), F.median(F.when(~valid, F.col(b)))).alias(b) for b in shown))


def bap_composite(df: DataFrame, shown: Sequence[str], cloud_classes: Sequence[int] = (3, 8, 9, 10), weights: Sequence[float] = (1.0, 0.5, 0.1), limit: int = 150) -> DataFrame:
    """Best available pixel of each month: distance to cloud, coverage of the date and closeness to mid-month, averaged by weight.

    Cloudy observations don't take part.
    """
    cloud = F.coalesce(cb.scl_mask(cloud_classes), F.lit(False))
    near = wn.cloud_distance_score(df.withColumn("_cloud", cloud), "_cloud", limit)
    dates = wn.coverage_score(df, cloud)
    w = [float(v) for v in weights]
    scored = near.join(dates, "t").withColumn("_score", F.round((w[0] * F.col("score") + w[1] * F.col("coverage") + w[2] * wn.date_score()) / sum(w), 9)).where(~F.col("_cloud"))
    return wn.rank_composite(scored.withColumn("month", F.date_trunc("month", "t")), "_score", ("x", "y", "month"), shown)


def soil_moisture(df: DataFrame, band: str, reference: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """Where the latest backscatter lies between the reference period's extremes; nodata where the mean level is above -6 or below -17 dB."""
    inside = lambda span: (F.col("t") >= F.lit(span[0]).cast("timestamp")) & (F.col("t") < F.lit(span[1]).cast("timestamp"))
    ref, cur = F.when(inside(reference), num(band)), F.when(inside(current), num(band))
    agg = df.groupBy("x", "y").agg(F.min(ref).alias("low"), F.max(ref).alias("high"), F.avg(ref).alias("mean"), F.max_by(cur, F.when(cur.isNotNull(), F.col("t"))).alias("last"))
    level = ix.decibel("mean")
    ssm = divide(F.col("last") - F.col("low"), F.col("high") - F.col("low"))
    return agg.select("x", "y", F.when((level <= -6) & (level >= -17), ssm).alias("SSM"))


def sar_stats(df: DataFrame, labels: Sequence[str] = ("VH", "VV")) -> DataFrame:
    return cb.time_to_bands(cb.filter_bands(df, labels))


def bare_surface_composite(df: DataFrame, threshold: float, land_cover: DataFrame, shown: Sequence[str] = ("B02", "B04", "B08", "B12"), nmad_sigma: float = 3.0, max_sza: float = 70, cloud_classes: Sequence[int] = (3, 8, 9, 10), hidden_classes: Sequence[int] = (0, 1, 2, 6, 11), dilation: int = 11, least: int = 3, mref: bool = False, mref_sigma: float = 4.0, mask: bool = False) -> DataFrame:
    """Mean and deviation of bare soil reflectance: low sun, scene classes and dilated clouds out; index below the
    threshold; no built-up or water cover; outliers of the blue band out; three observations at least.

    Bands: {band}_mean, {band}_sd, valid_count, bare_count, frequency; with mref {band}_mref over all clear dates;
    with mask `class`: 1 bare, 2 vegetated, 3 other (built-up or water).
    """
    cloud = wn.moving_sum(df.withColumn("_near", F.coalesce(cb.scl_mask(cloud_classes), F.lit(False)).cast("int")), dilation // 2, ["_near"])
    clear = cloud.where((F.col("_near") == 0) & (F.col("sza") <= max_sza) & ~F.coalesce(cb.scl_mask(hidden_classes), F.lit(False)))
    clear = clear.withColumn("_index", ix.pvir2()).drop("_near")
    covered = F.coalesce(F.col("MAP").isin(50, 80), F.lit(False))
    joined = clear.join(land_cover, ["x", "y"], "left").withColumn("_other", covered)
    bare = F.coalesce((F.col("_index") <= threshold) & ~F.col("_other"), F.lit(False))
    soil = joined.withColumns({b: F.when(bare, F.col(b)) for b in shown}).withColumn("_bare", bare)
    kept = wn.nmad_outliers(soil, "B02", nmad_sigma, only=shown)
    made = []
    for b in shown:
        made += [F.avg(b).alias(f"{b}_mean"), F.stddev_samp(b).alias(f"{b}_sd")]
    count = F.count("B02")
    out = kept.groupBy("x", "y").agg(*made, F.count("*").alias("valid_count"), count.alias("bare_count"), F.max("_other").alias("_o"))
    enough = F.col("bare_count") >= least
    out = out.withColumns({f"{b}_{s}": F.when(enough, F.col(f"{b}_{s}")) for b in shown for s in ("mean", "sd")}).withColumn("frequency", divide("bare_count", "valid_count"))
    if mask:
        out = out.withColumn("class", F.when(F.col("_o"), 3).when(enough, 1).otherwise(2))
    out = out.drop("_o")
    if mref:
        ref = wn.nmad_outliers(clear.select("x", "y", "t", *shown), "B02", mref_sigma, only=shown)
        out = out.join(ref.groupBy("x", "y").agg(*(F.avg(b).alias(f"{b}_mref") for b in shown)), ["x", "y"], "left")
    return out


def ci95(df: DataFrame, shown: Sequence[str], count: str = "bare_count") -> DataFrame:
    """Lower and upper 95 % limits of each band's mean."""
    half = lambda b: 1.96 * divide(F.col(f"{b}_sd"), F.sqrt(F.col(count).cast("double")))
    return df.withColumns({f"{b}_{n}": F.col(f"{b}_mean") + s * half(b) for b in shown for n, s in (("low", -1), ("high", 1))})


def urban_heat_island(thermal: DataFrame, land_cover: DataFrame, band: str = "B10", urban_class: int = 50, kernel: int = 51, years: Sequence[int] = range(1985, 2036), reference_class: str = "rural") -> DataFrame:
    """How much warmer urban pixels are than the rural ones (all that aren't urban) around them, in summer, over years.

    reference_class='urban' takes the urban pixels as the surroundings instead.
    """
    spans = [(f"{y}-06-01", f"{y}-09-01") for y in years]
    lst = thermal.select("x", "y", "t", ix.lst_celsius(band).alias("lst"))
    summers = cb.aggregate_temporal(lst, spans, "mean")
    mean = cb.reduce_time(summers, "mean").join(land_cover, ["x", "y"], "left")
    urban = F.coalesce(F.col("MAP") == urban_class, F.lit(False))
    around = ~urban if reference_class == "rural" else urban
    work = mean.select("x", "y", "lst", urban.alias("_urban"), F.when(around, F.col("lst")).alias("_sum"), F.when(around & F.col("lst").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("_n"))
    moved = wn.moving_sum(work, kernel // 2, ["_sum", "_n"])
    return moved.where("_urban").select("x", "y", (F.col("lst") - divide("_sum", "_n")).alias("uhi"))


def lai_period(df: DataFrame, land_cover: DataFrame, period: str = "month", name: str = "mean", zones: DataFrame | None = None, keep_class: int = 10) -> DataFrame:
    """Leaf area index 0 to 7.5 of one land cover by period, scaled to 0..240; a missing value is absent."""
    lai = df.select("x", "y", "t", ix.evi_lai().alias("lai")).where("lai >= 0 AND lai <= 7.5")
    out = cb.aggregate_temporal_period(lai, period, cb.pick_reducer(name))
    out = out.join(land_cover.where(F.col("MAP") == keep_class).select("x", "y"), ["x", "y"], "left_semi")
    if zones is not None:
        out = zn.mask_polygon(out, zones)
    return out.withColumn("lai", linear_scale("lai", 0, 7.5, 0, 240))


def fill_and_median(df: DataFrame) -> DataFrame:
    """Weekly means, gaps filled, median over time."""
    weekly = cb.aggregate_temporal_period(df, "week", "mean")
    return cb.reduce_time(wn.interpolate_linear(weekly), "median")


def ndfi(df: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Burn index of swir and near infrared against their averages within the given groups (no keys: over all rows, by one aggregate)."""
    if not keys:
        means = df.agg(F.avg("B12").alias("_b12"), F.avg("B08").alias("_b08"))
        a, b = divide("B12", F.col("_b12")), divide("B08", F.col("_b08"))
        return df.crossJoin(F.broadcast(means)).withColumn("ndfi", divide(a - b, b)).drop("_b12", "_b08")
    means = df.groupBy(*keys).agg(F.avg("B12").alias("_b12"), F.avg("B08").alias("_b08"))
    a, b = divide("B12", F.col("_b12")), divide("B08", F.col("_b08"))
    return df.join(means, list(keys)).withColumn("ndfi", divide(a - b, b)).select(*df.columns, "ndfi")


def fire_features(sar: DataFrame, optical: DataFrame, hidden: Sequence[int] = COMPOSITE_MASK, dilation: Mapping[str, object] | None = None, context: Mapping[str, object] | None = None, size: int = 128, overlap: int = 32) -> DataFrame:
    """Medians of scaled radar levels and of clear optical bands; burn indices and texture of these medians; all side by side.

    dilation: arguments of scl_dilation_mask(), which then hides pixels in place of the classes `hidden`. context goes to the texture.
    """
    scaled = lambda c: F.floor(linear_scale(c, 0, 30, 0, 30_000))
    s1 = sar.select("x", "y", "t", scaled(ix.sar_ratio()).alias("ratio"), scaled(ix.sar_level("VV")).alias("VV_db"), scaled(ix.sar_level("VH")).alias("VH_db"))
    if dilation is None:
        clear = optical.where(~F.coalesce(cb.scl_mask(hidden), F.lit(False)))
    else:
        clear = optical.join(wn.scl_dilation_mask(optical, **dilation).where("NOT mask"), ["x", "y", "t"], "left_semi")
    medians = cb.reduce_time(clear.select("x", "y", "t", "B04", "B08", "B12"), "median")
    texture = udf.burn_texture(medians, dict(context or {}), size, overlap)
    s2 = cb.merge_cubes(medians.withColumns({"nbr": ix.nbr(), "bai": ix.bai()}), texture)
    return cb.merge_cubes(cb.reduce_time(s1, "median"), s2)


def country_extract(items: DataFrame, zones: DataFrame, band: str, year: int, month: int, low: float = -10, high: float = 31_000) -> DataFrame:
    """One day's pixels (the month's first) inside the zones, clamped."""
    day = f"{year:04d}-{month:02d}-01"
    one = items.where((F.col("t") >= F.lit(day).cast("timestamp")) & (F.col("t") < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp")))
    return zn.filter_spatial(one, zones).withColumn(band, clip(num(band), float(low), float(high)))


def burn_severity(pre: DataFrame, post: DataFrame) -> DataFrame:
    """How far the burn ratio fell between two dates."""
    a, b = (d.select("x", "y", ix.nbr().alias("nbr")) for d in (pre, post))
    return cb.merge_cubes(a, b, lambda x, y: x - y).withColumnRenamed("nbr", "dnbr")


def parcel_heterogeneity(df: DataFrame, parcels: DataFrame) -> DataFrame:
    """Coefficient of variation of each band within each parcel (and date)."""
    keys = ["feature_index", *(["t"] if "t" in df.columns else [])]
    return zn.zonal_join(df, parcels).groupBy(*keys).agg(*(divide(F.stddev_samp(b), F.avg(b)).alias(b) for b in bands(df)))


def parcel_markers(df: DataFrame, parcels: DataFrame) -> DataFrame:
    """Mean, deviation and count of each band within each parcel and date."""
    made = [f(b).alias(f"{b}_{n}") for b in bands(df) for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("count", F.count))]
    return zn.zonal_join(df, parcels).groupBy("feature_index", "t").agg(*made)


def parcel_moments(df: DataFrame, parcels: DataFrame) -> DataFrame:
    """Number of values, mean and sum of squared deviations of each band within each parcel and date: what can be merged with that of other pixels."""
    made = [f.alias(f"{b}_{n}") for b in bands(df) for n, f in (("n", F.count(b)), ("mean", F.avg(b)), ("m2", F.var_pop(b) * F.count(b)))]
    return zn.zonal_join(df, parcels).groupBy("feature_index", "t").agg(*made)


def merged_moments(moments: DataFrame) -> DataFrame:
    """One row for each parcel and date of any number of rows of parcel_moments(); the merged mean comes first, so that no large squares cancel. One exchange."""
    keys = ["feature_index", "t"]
    names = [n.removesuffix("_m2") for n in moments.columns if n.endswith("_m2")]
    own = Window.partitionBy(*keys)
    mean = lambda b: divide(F.sum(F.col(f"{b}_n") * F.col(f"{b}_mean")).over(own), F.sum(f"{b}_n").over(own))
    rows = moments.select(*keys, *(c for b in names for c in (F.col(f"{b}_n"), F.col(f"{b}_m2"), F.col(f"{b}_mean").alias(f"_{b}"), mean(b).alias(f"{b}_mean"))))
    square = lambda b: F.pow(F.col(f"_{b}") - F.col(f"{b}_mean"), 2)
    made = [f.alias(f"{b}_{n}") for b in names for n, f in (("n", F.sum(f"{b}_n")), ("mean", F.max(f"{b}_mean")), ("m2", F.sum(F.col(f"{b}_m2") + F.col(f"{b}_n") * square(b))))]
    return rows.groupBy(*keys).agg(*made)


def append_markers(df: DataFrame, parcels: DataFrame, path: str, batch: str) -> None:
    """Adds the pixels of one delivery to the markers stored at path. A delivery written again under its name replaces itself, so that a repeated job counts nothing twice."""
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"batch must be of letters, digits, _ and -, not {batch!r}")
    parcel_moments(df, parcels).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """parcel_markers() of all pixels that append_markers() has been given."""
    merged = merged_moments(spark.read.parquet(path).drop("batch"))
    names = [n.removesuffix("_m2") for n in merged.columns if n.endswith("_m2")]
    deviation = lambda b: F.when(F.col(f"{b}_n") > 1, F.sqrt(F.col(f"{b}_m2") / (F.col(f"{b}_n") - 1)))
    return merged.select("feature_index", "t", *(c.alias(f"{b}_{n}") for b in names for n, c in (("mean", F.col(f"{b}_mean")), ("sd", deviation(b)), ("count", F.col(f"{b}_n")))))


def timeseries_statistics(df: DataFrame, zones: DataFrame, labels: Sequence[str], period: str | None = None) -> DataFrame:
    """Seven statistics of each pixel over time (all of it, or each period), then the mean of each over every feature's pixels."""
    cube = cb.filter_bands(df, labels)
    if period is None:
        stats = cb.time_to_bands(cube)
    else:
        keyed = cube.withColumn("t", cb.period_start(period))
        stats = cb.statistics_of(keyed.select("x", "y", "t", *labels), ["x", "y", "t"])
    return zn.aggregate_spatial(stats, zones, "mean")


#: Land cover codes and their labels (fixed values).
LAND_COVER = {10: "tree", 20: "shrub", 30: "grass", 40: "crop", 50: "built_up", 60: "bare", 70: "snow", 80: "water", 90: "wetland", 95: "mangrove", 100: "moss"}


def worldcover_fractions(land_cover: DataFrame, zones: DataFrame) -> DataFrame:
    hot = cb.one_hot(land_cover, "MAP", list(LAND_COVER), list(LAND_COVER.values()))
    return zn.aggregate_spatial(hot, zones, "mean")


def plant_phenology(df: DataFrame, limits: DataFrame, zones: DataFrame) -> DataFrame:
    """Plant phenology index of each observation: limits (x, y, dvi_max, dvi_soil); dvi_max is raised to the zone's largest dvi_soil."""
    top = zn.aggregate_spatial(limits.select("x", "y", "dvi_soil"), zones, "max").withColumnRenamed("dvi_soil", "_top")
    raised = cb.merge_static(limits, zn.vector_to_raster(top, zones, limits)).withColumn("dvi_max", F.greatest("dvi_max", "_top"))
    joined = cb.merge_static(df.select("x", "y", "t", (ix.dn("B08") - ix.dn("B04")).alias("dvi"), "sza"), raised.drop("_top"))
    return joined.select("x", "y", "t", ix.ppi(F.col("dvi"), ix.dn("dvi_max"), ix.dn("dvi_soil"), F.col("sza")).alias("ppi"))


def ndvi_stack(df: DataFrame, value: str = "ndvi", high: float = 0.92, low: float = -0.08, shift: float = 0.08) -> DataFrame:
    """Index scenes for segmentation: clamped above, nodata below, shifted to start at 0."""
    v = num(value)
    return df.withColumn(value, F.when(v <= low, None).otherwise(F.least(v, F.lit(high)) + shift))


def scene_quality(df: DataFrame, value: str = "ndvi", least: int = 5) -> DataFrame:
    """Invalid pixels of each scene, and whether the tile has enough scenes with data."""
    scenes = df.groupBy("t").agg(F.count_if(F.col(value).isNull()).alias("invalid"), F.count(value).alias("_valid"))
    return scenes.crossJoin(F.broadcast(scenes.agg((F.count_if(F.col("_valid") > 0) >= least).alias("tile_valid")))).drop("_valid")


def zscore(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Bands as deviations from a one-row table of {band}_mean and {band}_sd."""
    joined = df.crossJoin(F.broadcast(stats.limit(1)))
    return joined.withColumns({b: divide(F.col(b) - F.col(f"{b}_mean"), F.col(f"{b}_sd")) for b in bands(df)}).select(*df.columns)
