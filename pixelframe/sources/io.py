"""Readers and writers of cubes, histories, reports and catalogues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import nodata
from ..meta import one_of
from ..operators import catalog
from ..operators.cube import filter_bbox, filter_properties, filter_temporal
from ..operators.metrics import c, filter_outcome

#: Columns of a merged metrics history (fixed names and types).
HISTORY = (
    "`suite:run_id` string, `test:nodeid` string, `test:outcome` string, `test:start` double, `test:start:YYYYMM` string, `test:start:datetime` string, "
    "`test:duration` double, `test:phase:start` string, `test:phase:exception` string, `test:phase:end` string, scenario_id string, job_id string, costs double, "
    "`usage:cpu:cpu-seconds` double, `usage:memory:mb-seconds` double, `usage:input_pixel:mega-pixel` double, `usage:duration:seconds` double, "
    "`usage:max_executor_memory:gb` double, `usage:network_received:b` double, `results:proj:shape:area:megapixel` double, `results:proj:bbox:area:utm:km2` double"
)
MONTH = "test:start:YYYYMM"
RUN_REPORT = "nodeid string, report struct<outcome string, duration double, start double, stop double>, metrics array<array<string>>"
ITEM = "id string, properties struct<datetime string, `eo:cloud_cover` double>, assets map<string, struct<href string, `eo:bands` array<struct<name string>>>>"


def load_collection(spark: SparkSession, path: str, bands: Sequence[str], bbox: tuple[float, float, float, float] | None = None, interval: tuple[str | None, str | None] | None = None, scenes: DataFrame | None = None, condition=None) -> DataFrame:
    """Chosen bands of a Parquet cube within a box, an interval and the scenes that meet a condition; the filters reach the scan."""
    df = spark.read.parquet(path)
    df = df.select("x", "y", "t", *bands)
    if bbox is not None:
        df = filter_bbox(df, *bbox)
    if interval is not None:
        df = filter_temporal(df, *interval)
    if scenes is not None and condition is not None:
        df = filter_properties(df, scenes, condition)
    return df.withColumns({b: nodata(b) for b in bands})


def z_order(x, y, bits: int = 21):
    """The place of a cell on a Z-shaped curve: the bits of both numbers in turn, from -2**(bits - 1) on. Cells near each other on the curve are near in both directions."""
    half = 1 << (bits - 1)
    bit = lambda v, i, to: F.shiftleft(F.shiftright(v + F.lit(half), i).bitwiseAND(F.lit(1)).cast("long"), to)
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(v, i, 2 * i + k) for i in range(bits) for k, v in enumerate((x, y))])


def write_cube(df: DataFrame, path: str, tile: int = 1024) -> None:
    """In files of tiles that are neighbours in both directions (along a Z-shaped curve), sorted by time within a tile, so that boxes and intervals skip row groups.

    A tile with very many dates is divided over several files by time.
    """
    z = z_order(F.floor(F.col("x") / tile), F.floor(F.col("y") / tile))
    df.repartitionByRange(z, "t").sortWithinPartitions(z, "t").write.mode("overwrite").parquet(path)


def load_items(spark: SparkSession, path: str, bands: Sequence[str] | None = None, interval: tuple[str, str] | None = None, max_cloud_cover: float | None = None, multi_line: bool = True) -> DataFrame:
    """(item, t, cloud_cover, asset, href, band) of item JSON files; multi_line=False reads files with an item on each line."""
    items = spark.read.schema(ITEM).option("multiLine", multi_line).json(path)
    rows = items.select("id", F.to_timestamp("properties.datetime").alias("t"), F.col("properties.`eo:cloud_cover`").alias("cloud_cover"), F.explode("assets").alias("asset", "_a"))
    rows = rows.select(F.col("id").alias("item"), "t", "cloud_cover", "asset", F.col("_a.href").alias("href"), F.explode(F.transform(F.col("_a.`eo:bands`"), lambda b: b["name"])).alias("band"))
    if bands is not None:
        rows = rows.where(F.col("band").isin(*bands))
    if interval is not None:
        rows = filter_temporal(rows, *interval)
    return rows.where(F.col("cloud_cover") <= max_cloud_cover) if max_cloud_cover is not None else rows


def load_geojson(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(feature_index, geom, props, parts) of a FeatureCollection or a single geometry file, as rings of points.

    Coordinates stay text until the type of the geometry is known. A MultiPolygon's rings are taken together, parts has the number of
    each ring's polygon (all 0 in a Polygon); a Point is a ring of one point. multi_line=False reads files with a feature on each line.
    """
    geometry = "struct<type string, coordinates string>"
    schema = f"type string, coordinates string, geometry {geometry}, properties map<string, string>, features array<struct<geometry {geometry}, properties map<string, string>>>"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    one = F.when(F.col("features").isNotNull(), F.col("features")).when(F.col("geometry").isNotNull(), F.array(F.struct("geometry", "properties"))).otherwise(F.array(F.struct(F.struct("type", "coordinates").alias("geometry"), F.col("properties").alias("properties"))))
    rows = raw.select(F.posexplode(one).alias("feature_index", "_f")).select("feature_index", F.col("_f.geometry.type").alias("_type"), F.col("_f.geometry.coordinates").alias("_c"), F.col("_f.properties").alias("props"))
    polygon = F.from_json("_c", "array<array<array<double>>>")
    islands = F.from_json("_c", "array<array<array<array<double>>>>")
    multi = F.flatten(islands)
    point = F.array(F.array(F.from_json("_c", "array<double>")))
    rings = F.when(F.col("_type") == "MultiPolygon", multi).when(F.col("_type") == "Point", point).otherwise(polygon)
    geom = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    numbered = F.flatten(F.transform(islands, lambda part, i: F.transform(part, lambda _: i)))
    parts = F.when(F.col("_type") == "MultiPolygon", numbered).otherwise(F.transform(rings, lambda _: F.lit(0)))
    return rows.select("feature_index", geom.alias("geom"), "props", parts.alias("parts"))


def read_metrics_history(spark: SparkSession, path: str, metric_names: Sequence[str] | None = None, outcome: str | None = "passed") -> DataFrame:
    """Node id, start and metrics of a history, of runs with the outcome; without the node id or a metric asked for an empty table.

    By default the metrics are costs and all usage columns, sorted.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    names = list(metric_names) if metric_names is not None else sorted([n for n in df.columns if n.startswith("usage:") or n == "costs"])
    if any(n not in df.columns for n in ["test:nodeid", *names]):
        schema = T.StructType([T.StructField("test:nodeid", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names)])
        return spark.createDataFrame([], schema)
    keep = [n for n in ("test:nodeid", "test:start", "test:start:datetime", MONTH, "scenario_id", "test:outcome") if n in df.columns]
    return filter_outcome(df, outcome).select(*(c(n) for n in dict.fromkeys([*keep, *names])))


def read_positional_partitions(spark: SparkSession, path: str, field: str = MONTH, pattern: str = r"/(\d{4}-\d{2})/[^/]+$", schema: str | None = None) -> DataFrame:
    """A dataset whose folders are plain values: the field is taken from each file's path."""
    reader = spark.read.option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema else reader).parquet(path)
    return df.withColumn(field, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_with_schema(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """Missing columns are null, others are dropped."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def merge_metrics(spark: SparkSession, in_path: str, out_path: str, schema: str = HISTORY) -> None:
    """Rewrites a history as one dataset by month; months that it holds replace those of the output.

    Small months go to one task and file; a large one is divided over several (adaptive execution splits what exceeds its advisory size).
    """
    df = read_with_schema(spark, in_path, schema)
    month = F.coalesce(c(MONTH), F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2})/[^/]+$", 1), F.lit("")))
    df = df.withColumn(MONTH, month)
    df.hint("rebalance", c(MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(out_path)


def write_metrics(df: DataFrame, path: str, partitioning: str = "false") -> None:
    """`false` replaces the dataset, `simple` appends to it, `YYYYMM` appends by month."""
    one_of("partitioning", partitioning, ("false", "simple", "YYYYMM"))
    if partitioning == "YYYYMM":
        df.write.mode("append").partitionBy(MONTH).parquet(path)
    else:
        df.write.mode("overwrite" if partitioning == "false" else "append").parquet(path)


def read_run_report(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(nodeid, outcome, duration, start, stop, metrics map) of JSON run reports; what is missing is null."""
    df = spark.read.schema(RUN_REPORT).option("multiLine", multi_line).json(path)
    pairs = F.map_from_entries(F.transform("metrics", lambda m: F.struct(m[0], m[1])))
    return df.select("nodeid", "report.*", pairs.alias("metrics"))


def write_run_report(df: DataFrame, path: str) -> None:
    rows = df.select("nodeid", F.struct("outcome", "duration", "start", "stop").alias("report"), F.transform(F.map_entries("metrics"), lambda e: F.array(e["key"], e["value"])).alias("metrics"))
    rows.write.mode("overwrite").json(path)


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of text files of any size, as failure_sections() takes them; lines are numbered from 1 within a file.

    A file may be read in several splits, by different tasks: lines are numbered within their split, and the counts of the splits before it are added.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("text"))
    before = raw.groupBy("file", "_at").agg(F.count("*").alias("_c"))
    before = before.select("file", "_at", F.coalesce(F.sum("_c").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # within a split the ids rise with the lines
    own = F.row_number().over(Window.partitionBy("file", "_at").orderBy("_i"))
    lines = raw.withColumn("_i", F.monotonically_increasing_id()).withColumn("_n", own)
    return lines.join(before, ["file", "_at"]).select("file", (F.col("_before") + F.col("_n")).alias("line_no"), "text")


def read_records(spark: SparkSession, root: str, schema: str = catalog.RECORD, multi_line: bool = True) -> DataFrame:
    """All JSON records under a folder, each with its path."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", multi_line).json(root)
    return df.withColumn("path", F.col("_metadata.file_path"))


def read_scenarios(spark: SparkSession, root: str, schema: str = catalog.SCENARIO, multi_line: bool = True) -> DataFrame:
    """One row for each scenario of the JSON arrays in benchmark scenario folders; broken files have _corrupt_record."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", multi_line).json(root)
    return df.withColumn("path", F.col("_metadata.file_path")).where(F.col("path").rlike(r"/[^/]*benchmark[-_]scenarios?[^/]*/[^/]+\.json$"))


def features(df: DataFrame, geom: str = "geom", parts: str = "parts") -> DataFrame:
    """(type, geometry, properties): each row as a GeoJSON feature; a null geometry stays null.

    The rings (array<array<struct<x, y>>>) are a polygon; where df has the number of each ring's polygon in `parts`, a MultiPolygon of these.
    """
    rings = F.transform(geom, lambda ring: F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    kind, made = "Polygon", rings
    if parts in df.columns:
        of = lambda part: F.transform(F.filter(F.arrays_zip(rings.alias("ring"), F.col(parts).alias("part")), lambda z: z["part"] == part), lambda z: z["ring"])
        kind, made = "MultiPolygon", F.transform(F.array_sort(F.array_distinct(parts)), of)
    shape = F.when(F.col(geom).isNotNull(), F.struct(F.lit(kind).alias("type"), made.alias("coordinates")))
    return df.select(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*(n for n in df.columns if n not in (geom, parts))).alias("properties"))


def save_result(df: DataFrame, path: str, format: str = "parquet", band_meta: dict[str, dict] | None = None) -> None:
    """CSV, JSON, GeoJSON (a feature a line, of the column `geom`) or Parquet; scale, unit or nodata of a band go with its column (Parquet keeps them)."""
    one_of("format", format, ("csv", "json", "geojson", "parquet"))
    for band, meta in (band_meta or {}).items():
        df = df.withColumn(band, F.col(band).alias(band, metadata=meta))
    if format == "geojson":
        df = features(df)
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if format == "csv" else writer).format("json" if format == "geojson" else format).save(path)


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """A job tracker's CSV whose cells hold literal dictionaries and lists."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    literal = lambda name, kind: F.from_json(F.translate(name, "'", '"'), kind)
    box = literal("bbox", "struct<west double, south double, east double, north double>")
    span = literal("temporal_extent", "array<string>")
    out = df.withColumn("_b", box).withColumn("_t", span)
    return out.select(*(n for n in df.columns if n not in ("bbox", "temporal_extent", "cost")), F.col("cost").cast("double").alias("cost"), "_b.*", F.col("_t")[0].cast("date").alias("start"), F.col("_t")[1].cast("date").alias("end"))
