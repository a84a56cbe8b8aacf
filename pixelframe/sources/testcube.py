"""Cubes, zones, scenes and runs as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: band: (Spark SQL, DuckDB SQL) over lineitem.
BANDS = {
    "B02": ("1 + l_orderkey % 2000", "1 + l_orderkey % 2000"),
    "B03": ("1 + l_orderkey % 2500", "1 + l_orderkey % 2500"),
    "B04": ("1 + floor(l_extendedprice) % 3000", "1 + floor(l_extendedprice)::BIGINT % 3000"),
    "B05": ("1 + l_orderkey % 1800", "1 + l_orderkey % 1800"),
    "B06": ("1 + l_orderkey % 2700", "1 + l_orderkey % 2700"),
    "B07": ("1 + l_partkey * 3 % 3100", "1 + l_partkey * 3 % 3100"),
    "B08": ("1 + floor(l_extendedprice) % 5000", "1 + floor(l_extendedprice)::BIGINT % 5000"),
    "B8A": ("1 + floor(l_extendedprice) % 4500", "1 + floor(l_extendedprice)::BIGINT % 4500"),
    "B11": ("1 + l_orderkey % 3500", "1 + l_orderkey % 3500"),
    "B12": ("1 + l_partkey * 7 % 3000", "1 + l_partkey * 7 % 3000"),
    "SCL": ("(l_orderkey + l_linenumber) % 12", "(l_orderkey + l_linenumber) % 12"),
    "sza": ("20 + floor(l_quantity)", "20 + floor(l_quantity)::BIGINT"),
    "VV": ("1 + l_partkey % 900", "1 + l_partkey % 900"),
    "VH": ("1 + l_suppkey * 13 % 400", "1 + l_suppkey * 13 % 400"),
}
CODES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)


def pixels(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(BANDS)) -> DataFrame:
    """One row for each (x, y, t) of lineitem, integer bands by maximum."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cols = [F.expr(f"cast({BANDS[b][0]} as int)").alias(b) for b in labels]
    keys = [F.expr("cast(l_partkey % 40 as int)").alias("x"), F.expr("cast(l_suppkey % 25 as int)").alias("y"), F.col("l_shipdate").cast("timestamp").alias("t")]
    return li.select(*keys, *cols).groupBy("x", "y", "t").agg(*(F.max(b).alias(b) for b in labels))


def radar(df: DataFrame) -> DataFrame:
    """Backscatter bands as fractions."""
    return df.select("x", "y", "t", (F.col("VV") / 997).alias("VV"), (F.col("VH") / 997).alias("VH"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rectangles of 8 x 5 pixels over the grid."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("feature_index"))
    w, s = F.expr("(feature_index % 5) * 8.0D"), F.expr("floor(feature_index / 5) * 5.0D")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return n.select("feature_index", F.array(F.array(p(w, s), p(w + 8, s), p(w + 8, s + 5), p(w, s + 5))).alias("geom"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower left triangle of each zone."""
    return zones(spark, sf_dir).withColumn("geom", F.expr("transform(geom, r -> array(r[0], r[1], r[3]))"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("timestamp").alias("t")).distinct()
    return t.withColumn("cloud_cover", F.expr("datediff(t, date'1995-01-01') % 101"))


def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr("cast(l_partkey % 40 as int)").alias("x"), F.expr("cast(l_suppkey % 25 as int)").alias("y")).distinct()
    return grid.withColumn("MAP", F.element_at(F.array(*map(F.lit, CODES)), F.expr("(x * 7 + y) % 11 + 1").cast("int")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 50 scenarios from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(
        F.concat(F.lit("tests/test_benchmarks.py::test_run_benchmark["), "event_type", F.lit("-"), (F.col("user_id") % 10).cast("string"), F.lit("]")).alias("test:nodeid"),
        F.when(F.col("event_id") % 7 == 0, "failed").otherwise("passed").alias("test:outcome"), start.alias("test:start"), F.col("value").alias("costs"), "event_id",
    )


AS_OF = 1706659200.0

#: The same views in DuckDB, as the start of a WITH clause.
SQL = (
    "px AS (SELECT (l_partkey % 40)::INT AS x, (l_suppkey % 25)::INT AS y, l_shipdate::TIMESTAMP AS t, "
    + ", ".join(f"max({sql})::INT AS {b}" for b, (_, sql) in BANDS.items())
    + " FROM lineitem GROUP BY ALL), "
    "rd AS (SELECT x, y, t, VV / 997.0::DOUBLE AS VV, VH / 997.0::DOUBLE AS VH FROM px), "
    "zn AS (SELECT n_nationkey::INT AS feature_index, (n_nationkey % 5) * 8 AS w, (n_nationkey // 5) * 5 AS s FROM nation), "
    "pz AS (SELECT px.*, zn.feature_index FROM px JOIN zn ON px.x >= w AND px.x < w + 8 AND px.y >= s AND px.y < s + 5), "
    "gr AS (SELECT DISTINCT x, y FROM px), "
    "sc AS (SELECT DISTINCT t, date_diff('day', DATE '1995-01-01', t::DATE) % 101 AS cloud_cover FROM px), "
    f"lc AS (SELECT x, y, {list(CODES)}[((x * 7 + y) % 11 + 1)::INT] AS MAP FROM gr), "
    "rn AS (SELECT 'tests/test_benchmarks.py::test_run_benchmark[' || event_type || '-' || (user_id % 10) || ']' AS node, event_type || '-' || (user_id % 10) AS scenario_id, "
    "CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'passed' END AS outcome, epoch(ts) AS start, value AS costs, event_id FROM events)"
)
