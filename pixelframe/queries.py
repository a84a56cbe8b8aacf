"""The registered queries of the cube, metrics and catalogue operators, each with its SQL.

Every query reads the driver's tables through the views of sources/testcube.py; sums and means of doubles are rounded
to six decimals at the end, so that the order of additions doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indices as ix
from .functions import scalar as sc
from .operators import catalog as cat
from .operators import cube as cb
from .operators import metrics as mt
from .operators import udf
from .operators import windows as wn
from .operators import zones as zn
from .operators.selection import quantiles_of_groups
from .plans import pipelines as pl
from .sources import testcube as tc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.max_ndvi(tc.pixels(spark, sf_dir, ("B04", "B08")))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n, kind in df.dtypes if kind == "double"})


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable:
    """Registers a query; sql may use the views of testcube.SQL and the given ones."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {tc.SQL}{', ' + ctes if ctes else ''} {sql}"
        return fn

    return add


def cube_query(name: str, sql: str, fn: Callable[[DataFrame], DataFrame], labels: tuple[str, ...], ctes: str = "") -> None:
    query(name, sql, ctes)(lambda spark, d: fn(tc.pixels(spark, d, labels)))


query("max_ndvi", "SELECT x, y, round(max((B08 - B04)::DOUBLE / nullif(B08 + B04, 0)), 6) AS max_ndvi FROM px GROUP BY ALL")(flagship)

# --- 2.2 shape ---------------------------------------------------------------------------------------------

cube_query("b1_filter_bands", "SELECT x, y, t, B08, B04 FROM px", lambda d: cb.filter_bands(d, ["B08", "B04"]), ("B04", "B08", "SCL"))
cube_query("b2_band", "SELECT x, y, t, B04 AS value FROM px", lambda d: cb.band(d, "B04"), ("B04", "B08"))
cube_query("b3_rename_labels", "SELECT x, y, t, B04 AS red, B08 AS nir FROM px", lambda d: cb.rename_labels(d, ["red", "nir"]), ("B04", "B08"))
cube_query("b3_rename_one", "SELECT x, y, t, B04, B08 AS nir FROM px", lambda d: cb.rename_labels(d, ["nir"], ["B08"]), ("B04", "B08"))
cube_query("b4_suffix_labels", "SELECT x, y, t, B04 AS B04_max, B08 AS B08_max FROM px", lambda d: cb.suffix_labels(d, "max"), ("B04", "B08"))
cube_query("b5_add_dimension", "SELECT x, y, t, B04 AS red, 'a' AS source FROM px", lambda d: cb.add_dimension(cb.add_dimension(cb.band(d, "B04"), "bands", "red", "bands"), "source", "a"), ("B04",))
cube_query("b6_drop_dimension", "SELECT x, y, B04 FROM px WHERE t = (SELECT min(t) FROM px)", lambda d: cb.drop_dimension(d.join(F.broadcast(d.agg(F.min("t").alias("t"))), "t"), "t"), ("B04",))
cube_query("b7_apply", "SELECT x, y, t, round(B04 / 10000.0::DOUBLE, 6) AS B04, round(B08 / 10000.0::DOUBLE, 6) AS B08 FROM px", lambda d: cb.apply(d, ix.dn), ("B04", "B08"))
cube_query("b8_apply_bands", "SELECT x, y, t, B08 - B04 AS dvi, B08 + B04 AS total FROM px", lambda d: cb.apply_bands(d, lambda b: {"dvi": b["B08"] - b["B04"], "total": b["B08"] + b["B04"]}), ("B04", "B08"))
cube_query("b9_reduce_bands", "SELECT x, y, t, greatest(B02, B03, B04) AS value FROM px", lambda d: cb.reduce_bands(d, lambda b: F.greatest(*b.values())), ("B02", "B03", "B04"))
cube_query("b10_apply_time", "SELECT x, y, t, B04 - lag(B04) OVER (PARTITION BY x, y ORDER BY t) AS B04 FROM px", lambda d: wn.apply_time(d, lambda c, w: c - F.lag(c).over(w)), ("B04",))
_STATS = lambda bands: ", ".join(f"min({b}) AS {b}_min, max({b}) AS {b}_max, round(avg({b}), 6) AS {b}_mean, round(stddev_samp({b}), 6) AS {b}_sd, round(quantile_cont({b}, 0.1), 6) AS {b}_q10, round(quantile_cont({b}, 0.5), 6) AS {b}_q50, round(quantile_cont({b}, 0.9), 6) AS {b}_q90" for b in bands)
cube_query("b11_time_to_bands", f"SELECT x, y, {_STATS(['B04', 'B08'])} FROM px GROUP BY ALL", cb.time_to_bands, ("B04", "B08"))
cube_query("b12_bands_to_rows", "SELECT x, y, t, band, value::DOUBLE AS value FROM (UNPIVOT (SELECT x, y, t, B04, B08 FROM px) ON B04, B08 INTO NAME band VALUE value)", cb.bands_to_rows, ("B04", "B08"))
cube_query("b12_rows_to_bands", "SELECT x, y, t, B04::DOUBLE AS B04, B08::DOUBLE AS B08 FROM px", lambda d: cb.rows_to_bands(cb.bands_to_rows(d), ["B04", "B08"]), ("B04", "B08"))
query("b13_one_hot", "SELECT x, y, (MAP = 10)::INT AS tree, (MAP = 50)::INT AS built FROM lc")(lambda s, d: cb.one_hot(tc.land_cover(s, d), "MAP", [10, 50], ["tree", "built"]))

# --- 2.3 filters ----------------------------------------------------------------------------------------------

cube_query("c1_filter_bbox", "SELECT x, y, t, B04 FROM px WHERE x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 9", lambda d: cb.filter_bbox(d, 3, 2, 11, 9), ("B04",))
cube_query("c2_filter_temporal", "SELECT x, y, t, B04 FROM px WHERE t >= TIMESTAMP '1996-03-01' AND t < TIMESTAMP '1997-03-01'", lambda d: cb.filter_temporal(d, "1996-03-01", "1997-03-01"), ("B04",))
query("c3_filter_spatial", "SELECT x, y, t, B04 FROM pz WHERE feature_index IN (3, 7, 11)")(lambda s, d: zn.filter_spatial(tc.pixels(s, d, ("B04",)), tc.zones(s, d).where("feature_index IN (3, 7, 11)")))
_TRI = "tz AS (SELECT px.*, feature_index FROM px JOIN zn ON px.x >= w AND px.x < w + 8 AND px.y >= s AND px.y < s + 5 AND (px.x + 0.5 - w) < 8 * (1 - (px.y + 0.5 - s) / 5))"
query("c3_filter_triangles", "SELECT x, y, t, B04 FROM tz", _TRI)(lambda s, d: zn.filter_spatial(tc.pixels(s, d, ("B04",)), tc.triangles(s, d)))
query("c4_mask_polygon", "SELECT px.x, px.y, px.t, CASE WHEN feature_index IS NOT NULL THEN px.B04 END AS B04 FROM px LEFT JOIN (SELECT DISTINCT x, y, feature_index FROM pz WHERE feature_index IN (3, 7)) z ON px.x = z.x AND px.y = z.y")(lambda s, d: zn.mask_polygon(tc.pixels(s, d, ("B04",)), tc.zones(s, d).where("feature_index IN (3, 7)")))
query("c4_mask_polygon_inside", "SELECT px.x, px.y, px.t, CASE WHEN feature_index IS NULL THEN px.B04 END AS B04 FROM px LEFT JOIN (SELECT DISTINCT x, y, feature_index FROM pz WHERE feature_index IN (3, 7)) z ON px.x = z.x AND px.y = z.y")(lambda s, d: zn.mask_polygon(tc.pixels(s, d, ("B04",)), tc.zones(s, d).where("feature_index IN (3, 7)"), inside=True))
query("c5_filter_properties", "SELECT x, y, t, B04 FROM px WHERE t IN (SELECT t FROM sc WHERE cloud_cover <= 20)")(lambda s, d: cb.filter_properties(tc.pixels(s, d, ("B04",)), tc.scenes(s, d), F.col("cloud_cover") <= 20))
cube_query("c6_mask", "SELECT x, y, t, CASE WHEN NOT SCL IN (3, 8, 9) THEN B04 END AS B04, CASE WHEN NOT SCL IN (3, 8, 9) THEN SCL END AS SCL FROM px", lambda d: cb.mask(d, d.select("x", "y", "t", cb.scl_mask((3, 8, 9)).cast("int").alias("m"))), ("B04", "SCL"))
cube_query("c6_mask_replacement", "SELECT x, y, t, CASE WHEN SCL IN (3, 8, 9) THEN -1 ELSE B04 END AS B04 FROM px", lambda d: cb.mask_where(d, cb.scl_mask((3, 8, 9)), -1, ["B04"]).drop("SCL"), ("B04", "SCL"))
query("c6_mask_static", "SELECT px.x, px.y, px.t, CASE WHEN NOT coalesce(MAP = 10, FALSE) THEN B04 END AS B04 FROM px LEFT JOIN lc ON px.x = lc.x AND px.y = lc.y")(lambda s, d: cb.mask(tc.pixels(s, d, ("B04",)), tc.land_cover(s, d).select("x", "y", (F.col("MAP") == 10).cast("int").alias("m"))))
cube_query("c7_mask_values", "SELECT x, y, t, CASE WHEN SCL NOT IN (0, 11) THEN SCL END AS SCL FROM px", lambda d: cb.mask_values(d, [0, 11]), ("SCL",))
cube_query("c7_fill_nodata", "SELECT x, y, t, CASE WHEN SCL NOT IN (0, 11) THEN SCL ELSE 99 END AS SCL FROM px", lambda d: cb.fill_nodata(cb.mask_values(d, [0, 11]), 99), ("SCL",))
cube_query("c8_scl_mask", "SELECT x, y, t, SCL IN (3, 8, 9, 10, 1, 6, 11, 0) AS hidden FROM px", lambda d: d.select("x", "y", "t", cb.scl_mask(pl.COMPOSITE_MASK).alias("hidden")), ("SCL",))
query("c9_filter_outcome", "SELECT event_id, costs FROM rn WHERE outcome = 'passed'")(lambda s, d: mt.filter_outcome(tc.runs(s, d)).select("event_id", "costs"))
query("c10_filter_recent", f"SELECT event_id, costs FROM rn WHERE start >= {tc.AS_OF} - 10 * 86400")(lambda s, d: mt.filter_recent(tc.runs(s, d), 10, tc.AS_OF).select("event_id", "costs"))
query("c11_filter_regex", "SELECT event_id, scenario_id FROM rn WHERE regexp_matches(scenario_id, '^(?:click|view)')")(lambda s, d: mt.filter_regex(mt.with_scenario(tc.runs(s, d)), "scenario_id", "click|view").select("event_id", "scenario_id"))
query("c12_sample_half", "SELECT event_id, round(costs, 6) AS costs FROM rn QUALIFY row_number() OVER (ORDER BY md5('7|' || event_id), event_id) <= 250")(lambda s, d: mt.sample_n(tc.runs(s, d).select("event_id", "costs"), 250, 7, ["event_id"], most_sorted=10))
query("c12_sample_n", "SELECT event_id, round(costs, 6) AS costs FROM rn ORDER BY md5('7|' || event_id), event_id LIMIT 100")(lambda s, d: mt.sample_n(tc.runs(s, d).select("event_id", "costs"), 100, 7, ["event_id"]))

# --- 2.4 joins ----------------------------------------------------------------------------------------------------

query("d1_merge_disjoint", "SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.t, b.t) AS t, B04, B08 FROM (SELECT x, y, t, B04 FROM px WHERE B04 > 500) a FULL JOIN (SELECT x, y, t, B08 FROM px WHERE B08 > 1500) b USING (x, y, t)".replace("coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.t, b.t) AS t", "x, y, t"))(lambda s, d: cb.merge_cubes(tc.pixels(s, d, ("B04",)).where("B04 > 500"), tc.pixels(s, d, ("B08",)).where("B08 > 1500")))
query("d2_merge_resolver", "SELECT x, y, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN a.v - b.v ELSE coalesce(a.v, b.v) END AS v FROM (SELECT x, y, max(B04) AS v FROM px WHERE t < TIMESTAMP '1997-01-01' AND B04 > 2600 GROUP BY ALL) a FULL JOIN (SELECT x, y, max(B04) AS v FROM px WHERE t >= TIMESTAMP '1997-01-01' AND B04 > 2600 GROUP BY ALL) b USING (x, y)")(
    lambda s, d: cb.merge_cubes(*(tc.pixels(s, d, ("B04",)).where(w).where("B04 > 2600").groupBy("x", "y").agg(F.max("B04").alias("v")) for w in ("t < timestamp'1997-01-01'", "t >= timestamp'1997-01-01'")), lambda a, b: a - b)
)
query("d3_merge_static", "SELECT px.x, px.y, t, B04, MAP FROM px LEFT JOIN lc USING (x, y)")(lambda s, d: cb.merge_static(tc.pixels(s, d, ("B04",)), tc.land_cover(s, d)))
query("d4_zonal_join", "SELECT x, y, t, B04, feature_index FROM pz")(lambda s, d: zn.zonal_join(tc.pixels(s, d, ("B04",)), tc.zones(s, d)))
query("d4_zonal_join_triangles", "SELECT x, y, t, B04, feature_index FROM tz", _TRI)(lambda s, d: zn.zonal_join(tc.pixels(s, d, ("B04",)), tc.triangles(s, d)))
query("d5_vector_to_raster", "SELECT gr.x, gr.y, v FROM gr LEFT JOIN (SELECT z.x, z.y, m.v FROM (SELECT DISTINCT x, y, feature_index FROM pz) z JOIN (SELECT feature_index, max(B04) AS v FROM pz GROUP BY ALL) m USING (feature_index)) USING (x, y)")(lambda s, d: zn.vector_to_raster(zn.aggregate_spatial(tc.pixels(s, d, ("B04",)).select("x", "y", F.col("B04").alias("v")), tc.zones(s, d), "max"), tc.zones(s, d), tc.pixels(s, d, ("B04",))))
_COARSE = "co AS (SELECT (x // 4)::INT AS cx, (y // 4)::INT AS cy, round(avg(B04), 6) AS v FROM px GROUP BY ALL)"


def _coarse(s: SparkSession, d: str) -> DataFrame:
    return rounded(cb.resample_grid(tc.pixels(s, d, ("B04",)).select("x", "y", F.col("B04").alias("v")), 4, "average"))


query("d6_resample_near", "SELECT x, y, v FROM gr JOIN co ON cx = x // 4 AND cy = y // 4", _COARSE)(lambda s, d: cb.resample_to(_coarse(s, d), tc.land_cover(s, d), 4))
query("d6_resample_bilinear", "SELECT x, y, round(sum(v * w) / sum(w) + 1e-9, 6) AS v FROM (SELECT x, y, floor((x + 0.5) / 4 - 0.5) + i AS kx, floor((y + 0.5) / 4 - 0.5) + j AS ky, (1 - abs((x + 0.5) / 4 - 0.5 - floor((x + 0.5) / 4 - 0.5) - i)) * (1 - abs((y + 0.5) / 4 - 0.5 - floor((y + 0.5) / 4 - 0.5) - j)) AS w FROM gr, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) JOIN co ON cx = kx AND cy = ky GROUP BY x, y", _COARSE)(lambda s, d: cb.resample_to(_coarse(s, d), tc.land_cover(s, d), 4, "bilinear").withColumn("v", F.col("v") + 1e-9))
cube_query("d7_resample_average", "SELECT (x // 4)::INT AS x, (y // 4)::INT AS y, t, round(avg(B04), 6) AS B04 FROM px GROUP BY ALL", lambda d: cb.resample_grid(d, 4, "average"), ("B04",))
cube_query("d7_resample_near_nodata", "SELECT (x // 4)::INT AS x, (y // 4)::INT AS y, t, nullif(min(struct_pack(k := y * 1000 + x, v := coalesce(CASE WHEN B04 % 3 > 0 THEN B04 END, -1))).v, -1) AS B04 FROM px GROUP BY x // 4, y // 4, t", lambda d: cb.resample_grid(d.withColumn("B04", F.when(F.col("B04") % 3 > 0, F.col("B04"))), 4), ("B04",))
cube_query("d7_resample_aligned", "SELECT floor((x - (hx + 1) % 3) / 3)::INT AS x, floor((y - (hy + 1) % 3) / 3)::INT AS y, t, round(avg(B04), 6) AS B04 FROM px, (SELECT max(x) AS hx, max(y) AS hy FROM px) GROUP BY ALL", lambda d: cb.resample_grid(d, 3, "average", "lower-right"), ("B04",))
# cells of 1 from (0, 0) in cells of 2.5 from (0.3, -1.2)
_SHARED = "greatest(0, least({0} + 1, {1} + 2.5 * (k{0} + 1)) - greatest({0}, {1} + 2.5 * k{0}))::DOUBLE"
query("d6_resample_between_average", f"SELECT kx::INT AS x, ky::INT AS y, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 6) AS v FROM (SELECT kx, ky, v, {_SHARED.format('x', 0.3)} * {_SHARED.format('y', -1.2)} AS w FROM (SELECT x, y, CASE WHEN MAP <> 50 THEN MAP END AS v FROM lc), (SELECT unnest(range(-3, 60)) AS kx), (SELECT unnest(range(-3, 60)) AS ky)) WHERE w > 0 GROUP BY kx, ky")(lambda s, d: cb.resample_between(tc.land_cover(s, d).select("x", "y", F.when(F.col("MAP") != 50, F.col("MAP")).alias("v")), cb.Grid(0, 0, 1), cb.Grid(0.3, -1.2, 2.5)).withColumn("v", F.round("v", 6)))
query("d6_resample_between_near", "SELECT kx::INT AS x, ky::INT AS y, MAP AS v FROM lc, (SELECT unnest(range(-3, 60)) AS kx), (SELECT unnest(range(-3, 60)) AS ky) WHERE 0.3 + 2.5 * (kx + 0.5) >= x AND 0.3 + 2.5 * (kx + 0.5) < x + 1 AND -1.2 + 2.5 * (ky + 0.5) >= y AND -1.2 + 2.5 * (ky + 0.5) < y + 1")(lambda s, d: cb.resample_between(tc.land_cover(s, d).select("x", "y", F.col("MAP").alias("v")), cb.Grid(0, 0, 1), cb.Grid(0.3, -1.2, 2.5), "near"))
cube_query("d7_resample_near", "SELECT (x // 4)::INT AS x, (y // 4)::INT AS y, t, arg_min(B04, y * 1000 + x) AS B04 FROM px GROUP BY x // 4, y // 4, t", lambda d: cb.resample_grid(d, 4), ("B04",))
query("d8_compare_cubes", "SELECT count(*) AS pixels, count(*) FILTER (a.v IS NULL) AS missing, count(*) FILTER (b.v IS NULL) AS extra, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL AND abs(a.v - b.v) > 1 + 0.001 * abs(b.v)) AS bad, round(100.0 * count(*) FILTER (a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1 + 0.001 * abs(b.v)) / count(*), 6) AS bad_percent, 100.0 * count(*) FILTER (a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1 + 0.001 * abs(b.v)) / count(*) <= 1 AS passed FROM (SELECT x, y, max(B04) AS v FROM px WHERE x > 1 GROUP BY ALL) a FULL JOIN (SELECT x, y, max(B04) + (x % 3) * 2 AS v FROM px WHERE y > 1 GROUP BY x, y) b USING (x, y)")(
    lambda s, d: mt.compare_cubes(tc.pixels(s, d, ("B04",)).where("x > 1").groupBy("x", "y").agg(F.max("B04").alias("v")), tc.pixels(s, d, ("B04",)).where("y > 1").groupBy("x", "y").agg((F.max("B04") + F.col("x") % 3 * 2).alias("v")), ["v"])
)
query("d9_diff_links", "SELECT href, side, 'derived_from-change' AS kind FROM ((SELECT DISTINCT 'p' || (event_id % 700) AS href, 'actual' AS side FROM events WHERE event_id % 3 = 0 AND 'p' || (event_id % 700) NOT IN (SELECT 'p' || (event_id % 700) FROM events WHERE event_id % 5 = 1)) UNION ALL (SELECT DISTINCT 'p' || (event_id % 700), 'expected' FROM events WHERE event_id % 5 = 1 AND 'p' || (event_id % 700) NOT IN (SELECT 'p' || (event_id % 700) FROM events WHERE event_id % 3 = 0)))")(
    lambda s, d: mt.diff_links(*(s.read.parquet(f"{d}/events.parquet").where(w).select(F.lit("derived_from").alias("rel"), F.expr("concat('p', event_id % 700)").alias("href")) for w in ("event_id % 3 = 0", "event_id % 5 = 1")))
)
query("d10_compare_files", "SELECT file, printf('%.1f', coalesce(e, a) / 1024.0) AS kb, CASE WHEN a IS NULL THEN '(missing in actual)' WHEN e IS NULL THEN '(missing in reference)' WHEN a <> e THEN '(actual: ' || printf('%.1f', a / 1024.0) || ' kb)' END AS note FROM (SELECT 'f' || p_partkey AS file, p_partkey * 1000.37::DOUBLE AS a FROM part WHERE p_partkey % 3 > 0) FULL JOIN (SELECT 'f' || p_partkey AS file, p_partkey * 1000.37::DOUBLE + p_partkey % 2 * 512 AS e FROM part WHERE p_partkey % 4 > 0) USING (file)")(
    lambda s, d: mt.compare_files(*(s.read.parquet(f"{d}/part.parquet").where(w).select(F.expr("concat('f', p_partkey)").alias("file"), F.expr(e).cast("double").alias("size")) for w, e in (("p_partkey % 3 > 0", "p_partkey * 1000.37D"), ("p_partkey % 4 > 0", "p_partkey * 1000.37D + p_partkey % 2 * 512"))))
)

# --- 2.5 aggregations --------------------------------------------------------------------------------------------------

for _n, _sql in (("min", "min({0})"), ("max", "max({0})"), ("mean", "round(avg({0}), 6)"), ("median", "round(median({0}), 6)"), ("sd", "round(stddev_samp({0}), 6)"), ("count", "count({0})"), ("first", "arg_min({0}, t)"), ("last", "arg_max({0}, t)"), ("any", "bool_or({0} > 2990)"), ("all", "bool_and({0} > 5)")):
    _flag = {"any": "B04 > 2990", "all": "B04 > 5"}.get(_n)
    cube_query(f"{'e2' if _n in ('first', 'last') else 'e3' if _flag else 'e1'}_reduce_{_n}", f"SELECT x, y, {_sql.format('B04')} AS B04 FROM px GROUP BY ALL", lambda d, n=_n, f=_flag: cb.reduce_time(d.withColumn("B04", F.expr(f)) if f else d, n), ("B04",))
cube_query("e2_first_valid", "SELECT x, y, arg_min(B04, t) FILTER (SCL <> 3) AS B04 FROM px GROUP BY ALL", lambda d: cb.reduce_time(cb.mask_where(d, F.col("SCL") == 3).select("x", "y", "t", "B04"), "first"), ("B04", "SCL"))
cube_query("e4_quantiles", "SELECT x, y, round(quantile_cont(B04, 0.1), 6) AS B04_q10, round(quantile_cont(B04, 0.5), 6) AS B04_q50, round(quantile_cont(B04, 0.9), 6) AS B04_q90 FROM px GROUP BY ALL", lambda d: cb.quantiles(d, [0.1, 0.5, 0.9], ["q10", "q50", "q90"]), ("B04",))
cube_query("e5_max_strict", "SELECT x, y, CASE WHEN count(*) FILTER (SCL = 3) = 0 THEN max(B04) END AS B04 FROM px GROUP BY ALL", lambda d: cb.mask_where(d, F.col("SCL") == 3).groupBy("x", "y").agg(cb.max_strict("B04").alias("B04")), ("B04", "SCL"))
_SPANS = [("1996-06-01", "1996-09-01"), ("1997-06-01", "1997-09-01"), ("1997-08-01", "1998-02-01")]
cube_query("e6_aggregate_temporal", f"SELECT x, y, s::TIMESTAMP AS t, round(avg(B04), 6) AS B04 FROM px JOIN (VALUES {', '.join(f'''('{a}', '{b}')''' for a, b in _SPANS)}) i(s, e) ON px.t >= s::TIMESTAMP AND px.t < e::TIMESTAMP GROUP BY x, y, s", lambda d: cb.aggregate_temporal(d, _SPANS, "mean"), ("B04",))
_PERIOD = {"day": "date_trunc('day', t)", "week": "date_trunc('week', t)", "month": "date_trunc('month', t)", "year": "date_trunc('year', t)", "dekad": "(date_trunc('month', t)::DATE + least((day(t) - 1) // 10, 2)::INT * 10)", "season": "(date_trunc('month', t)::DATE - to_months((month(t) % 3)::INT))"}
for _n, _sql in _PERIOD.items():
    cube_query(f"e7_period_{_n}", f"SELECT x, y, p::TIMESTAMP AS t, round(avg(B04), 6) AS B04 FROM (SELECT x, y, B04, {_sql} AS p FROM px) GROUP BY x, y, p", lambda d, n=_n: cb.aggregate_temporal_period(d, n), ("B04",))
cube_query("e8_pick_reducer", "SELECT x, y, round(median(B04), 6) AS a, min(B04) AS b FROM px GROUP BY ALL", lambda d: d.groupBy("x", "y").agg(cb.reducer(cb.pick_reducer("MeDian"), "B04").alias("a"), cb.reducer(cb.pick_reducer("other"), "B04").alias("b")), ("B04",))
query("e9_aggregate_spatial", "SELECT feature_index, t, round(avg(B04), 6) AS B04 FROM pz GROUP BY ALL")(lambda s, d: zn.aggregate_spatial(tc.pixels(s, d, ("B04",)), tc.zones(s, d)))
query("e9_aggregate_spatial_max", "SELECT feature_index, t, max(B04) AS B04 FROM tz GROUP BY ALL", _TRI)(lambda s, d: zn.aggregate_spatial(tc.pixels(s, d, ("B04",)), tc.triangles(s, d), "max"))
_MEANS = ", ".join(f"round(avg(B04_{n}), 6) AS B04_{n}" for n in cb.STATISTICS)
_PIX = "min(B04) AS B04_min, max(B04) AS B04_max, avg(B04) AS B04_mean, stddev_samp(B04) AS B04_sd, quantile_cont(B04, 0.1) AS B04_q10, quantile_cont(B04, 0.5) AS B04_q50, quantile_cont(B04, 0.9) AS B04_q90"
query("e10_timeseries_statistics", f"SELECT feature_index, {_MEANS} FROM (SELECT feature_index, x, y, {_PIX} FROM pz GROUP BY ALL) GROUP BY ALL")(lambda s, d: pl.timeseries_statistics(tc.pixels(s, d, ("B04",)), tc.zones(s, d), ["B04"]))
query("e10_timeseries_by_year", f"SELECT feature_index, p AS t, {_MEANS} FROM (SELECT feature_index, x, y, date_trunc('year', t)::TIMESTAMP AS p, {_PIX} FROM pz GROUP BY ALL) GROUP BY ALL")(lambda s, d: pl.timeseries_statistics(tc.pixels(s, d, ("B04",)), tc.zones(s, d), ["B04"], "year"))
query("e11_worldcover_fractions", "SELECT feature_index, " + ", ".join(f"round(avg((MAP = {c})::INT), 6) AS {n}" for c, n in pl.LAND_COVER.items()) + " FROM lc JOIN zn ON x >= w AND x < w + 8 AND y >= s AND y < s + 5 GROUP BY ALL")(lambda s, d: pl.worldcover_fractions(tc.land_cover(s, d), tc.zones(s, d)))
query("e12_parcel_markers", "SELECT feature_index, t, round(avg(B04), 6) AS B04_mean, round(stddev_samp(B04), 6) AS B04_sd, count(B04) AS B04_count FROM pz GROUP BY ALL")(lambda s, d: pl.parcel_markers(tc.pixels(s, d, ("B04",)), tc.zones(s, d)))


def _two(df: DataFrame) -> DataFrame:
    """Limits with two decimals: half a unit of the fourth one lies on either side in another engine."""
    return df.withColumns({n: F.round(n, 2) for n in ("upper_limit", "lower_limit")})


_MAD = "me AS (SELECT scenario_id, median(costs) AS median, count(*) AS n FROM rn GROUP BY ALL), md AS (SELECT scenario_id, median(abs(costs - median)) AS mad FROM rn JOIN me USING (scenario_id) GROUP BY ALL)"
query("e13_mad_threshold", "SELECT scenario_id, n, round(median, 6) AS median, round(mad, 6) AS mad, round(greatest(2.0, 3 * 1.4826 * mad), 6) AS margin, round(median + greatest(2.0, 3 * 1.4826 * mad), 2) AS upper_limit, round(greatest(0, median - greatest(2.0, 3 * 1.4826 * mad)), 2) AS lower_limit FROM me JOIN md USING (scenario_id)", _MAD)(lambda s, d: _two(mt.mad_threshold(mt.with_scenario(tc.runs(s, d)), ["scenario_id"], "costs")))
_BASE = (
    "rk AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY start DESC, node DESC) AS k FROM rn WHERE outcome = 'passed'), "
    "hi AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY start DESC, node DESC) AS j FROM rk WHERE k > 1 AND costs IS NOT NULL), "
    "la AS (SELECT * FROM hi WHERE j <= 20), me AS (SELECT scenario_id, median(costs) AS median, count(*) AS n FROM la GROUP BY ALL), "
    "md AS (SELECT scenario_id, median(abs(costs - median)) AS mad FROM la JOIN me USING (scenario_id) GROUP BY ALL), "
    "ba AS (SELECT scenario_id, n, median, mad, greatest(2.0, 3 * 1.4826 * mad) AS margin, round_even(median + greatest(2.0, 3 * 1.4826 * mad), 4) AS upper_limit, greatest(0, round_even(median - greatest(2.0, 3 * 1.4826 * mad), 4)) AS lower_limit FROM me JOIN md USING (scenario_id) WHERE n >= 3)"
)


def _history(s: SparkSession, d: str) -> DataFrame:
    return mt.with_scenario(mt.filter_outcome(tc.runs(s, d)))


query("e14_compute_baselines", "SELECT scenario_id, n, round(median, 6) AS median, round(mad, 6) AS mad, round(margin, 6) AS margin, round(upper_limit, 2) AS upper_limit, round(lower_limit, 2) AS lower_limit FROM ba", _BASE)(lambda s, d: _two(mt.compute_baselines(mt.previous_runs(_history(s, d)))))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    asset = lambda k: F.expr(f"named_struct('proj:shape', array(cast(100 + o_orderkey % {k} as int), 800), 'proj:epsg', cast(32600 + o_orderkey % 65 as int), 'proj:bbox', array(500000d, 5645000d, 500000d + o_orderkey % {k}, 5657000d))")
    usage = F.expr("array(named_struct('name', 'cpu', 'unit', 'cpu-seconds', 'value', cast(o_orderkey % 50 as double)), named_struct('name', 'memory', 'unit', if(o_orderkey % 4 = 0, null, 'mb-seconds'), 'value', if(o_orderkey % 5 = 0, null, 2.0d)))")
    return o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("cost"), usage.alias("usage"), F.create_map(F.lit("a"), asset(700), F.lit("b"), asset(900)).alias("assets"))


query("e15_asset_areas", "SELECT o_orderkey AS job_id, round(greatest((100 + o_orderkey % 700) * 800 / 1e6, (100 + o_orderkey % 900) * 800 / 1e6), 6) AS megapixel, CASE WHEN o_orderkey % 65 BETWEEN 1 AND 59 THEN round(greatest((o_orderkey % 700) * 12000 / 1e6, (o_orderkey % 900) * 12000 / 1e6), 6) END AS km2 FROM orders")(lambda s, d: mt.asset_areas(_jobs(s, d)))
query("e16_usage_metrics", "SELECT o_orderkey AS job_id, 'costs' AS name, round(o_totalprice, 6) AS value FROM orders WHERE o_orderkey % 7 > 0 UNION ALL SELECT o_orderkey, 'usage:cpu:cpu-seconds', (o_orderkey % 50)::DOUBLE FROM orders UNION ALL SELECT o_orderkey, 'usage:memory:mb-seconds', 2.0 FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 5 > 0")(lambda s, d: mt.usage_metrics(_jobs(s, d)))
query("e17_pivot_metrics", "SELECT job_id, max(value) FILTER (name = 'costs') AS costs, max(value) FILTER (name = 'usage:cpu:cpu-seconds') AS cpu, max(value) FILTER (name = 'usage:memory:mb-seconds') AS memory FROM (SELECT o_orderkey AS job_id, 'costs' AS name, round(o_totalprice, 6) AS value FROM orders WHERE o_orderkey % 7 > 0 UNION ALL SELECT o_orderkey, 'usage:cpu:cpu-seconds', (o_orderkey % 50)::DOUBLE FROM orders UNION ALL SELECT o_orderkey, 'usage:memory:mb-seconds', 2.0 FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 5 > 0) GROUP BY job_id")(
    lambda s, d: mt.pivot_metrics(mt.usage_metrics(_jobs(s, d)), ["costs", "usage:cpu:cpu-seconds", "usage:memory:mb-seconds"], "job_id").toDF("job_id", "costs", "cpu", "memory")
)
query("e18_cost_pivot", "SELECT km, round(avg(cost) FILTER (m = 1), 6) AS m1, round(avg(cost) FILTER (m = 2), 6) AS m2, round(avg(cost) FILTER (m = 3), 6) AS m3 FROM (SELECT round((1 + o_orderkey % 4) * 0.5 * 108)::INT AS km, 1 + o_orderkey % 3 AS m, o_totalprice AS cost FROM orders) GROUP BY km")(
    lambda s, d: mt.cost_pivot(s.read.parquet(f"{d}/orders.parquet").select(F.lit(50.0).alias("south"), F.expr("50.0D + (1 + o_orderkey % 4) * 0.5D").alias("north"), F.lit("2024-01-01").cast("date").alias("start"), F.expr("date_add(date'2024-01-01', cast(30 * (1 + o_orderkey % 3) as int))").alias("end"), F.col("o_totalprice").alias("cost")), [1, 2, 3]).toDF("km", "m1", "m2", "m3")
)
_STATUS = "SELECT c.scenario_id, c.runs, CASE WHEN c.runs < 3 THEN 'insufficient' WHEN upper_limit IS NULL THEN 'no baseline' WHEN costs > upper_limit OR costs < lower_limit THEN 'regression' ELSE 'ok' END AS status, CASE WHEN c.runs < 3 THEN 'insufficient history (' || c.runs || ' runs)' WHEN upper_limit IS NULL THEN 'no costs baseline' WHEN costs > upper_limit THEN '[' || c.scenario_id || '] regression in ''costs'': actual=' || costs || ' exceeds upper_limit=' || upper_limit WHEN costs < lower_limit THEN '[' || c.scenario_id || '] regression in ''costs'': actual=' || costs || ' below lower_limit=' || lower_limit ELSE 'ok' END AS message FROM (SELECT scenario_id, count(*) AS runs FROM rk GROUP BY ALL) c JOIN (SELECT * FROM rk WHERE k = 1) l USING (scenario_id) LEFT JOIN ba USING (scenario_id)"
query("m18_performance_regressions", _STATUS, _BASE)(lambda s, d: mt.performance_regressions(tc.runs(s, d), tc.AS_OF))
query("e19_outcome_counts", "SELECT status, count(*) AS n FROM st GROUP BY ALL", f"{_BASE}, st AS ({_STATUS})")(lambda s, d: mt.outcome_counts(mt.performance_regressions(tc.runs(s, d), tc.AS_OF)))
query("m19_check_limits", "SELECT scenario_id, round(costs, 6) AS costs, coalesce(costs > upper_limit OR costs < lower_limit, FALSE) AS bad FROM rk LEFT JOIN ba USING (scenario_id) WHERE k = 1", _BASE)(lambda s, d: mt.check_limits(mt.latest_run(_history(s, d)), mt.compute_baselines(mt.previous_runs(_history(s, d)))).select("scenario_id", "costs", F.col("violation").isNotNull().alias("bad")))
cube_query("e20_coverage_score", "SELECT t, round(1 - avg((SCL IN (3, 8, 9, 10))::INT), 6) AS coverage FROM px GROUP BY ALL", lambda d: wn.coverage_score(d, cb.scl_mask((3, 8, 9, 10))), ("SCL",))

# --- 2.6 windows ----------------------------------------------------------------------------------------------------------

cube_query("f1_rank_mask", "SELECT x, y, t, B08 <> max(B08) OVER (PARTITION BY x, y) AS hide FROM px", lambda d: d.select("x", "y", "t", wn.rank_mask(F.col("B08")).alias("hide")), ("B08",))
cube_query("f2_nmad_outliers", "SELECT x, y, t, CASE WHEN NOT (B02 > med + 1.4826 * mad AND B02 > med + 80) THEN B02 END AS B02, CASE WHEN NOT (B02 > med + 1.4826 * mad AND B02 > med + 80) THEN B04 END AS B04 FROM (SELECT *, median(abs(B02 - med)) OVER (PARTITION BY x, y) AS mad FROM (SELECT x, y, t, B02, B04, median(B02) OVER (PARTITION BY x, y) AS med FROM px))", lambda d: wn.nmad_outliers(d, "B02", 1.0), ("B02", "B04"))
_GAP = "gp AS (SELECT x, y, t, CASE WHEN SCL NOT IN (3, 8, 9) THEN B04 END AS v, row_number() OVER (PARTITION BY x, y ORDER BY t) AS i FROM px), gq AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS i0, last_value(v IGNORE NULLS) OVER w AS v0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS i1, first_value(v IGNORE NULLS) OVER z AS v1 FROM gp WINDOW w AS (PARTITION BY x, y ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY x, y ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
cube_query("f3_interpolate_linear", "SELECT x, y, t, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (i - i0)::DOUBLE / (i1 - i0) * (v1 - v0) END, 6) AS B04 FROM gq", lambda d: wn.interpolate_linear(cb.mask_where(d, cb.scl_mask((3, 8, 9))).select("x", "y", "t", "B04")), ("B04", "SCL"), _GAP)
_RUNS = "rr AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY start DESC, node DESC) AS k FROM rn)"
query("f4_latest_run", "SELECT scenario_id, round(start, 6) AS start, round(costs, 6) AS costs FROM rr WHERE k = 1", _RUNS)(lambda s, d: mt.latest_run(mt.with_scenario(tc.runs(s, d))).select("scenario_id", F.col("_timestamp").alias("start"), "costs"))
query("f4_previous_runs", "SELECT scenario_id, count(*) AS n, round(sum(costs), 6) AS total FROM rr WHERE k > 1 GROUP BY ALL", _RUNS)(lambda s, d: mt.previous_runs(mt.with_scenario(tc.runs(s, d))).groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("costs").alias("total")))
query("f5_last_n_valid", "SELECT scenario_id, event_id FROM rr WHERE k <= 5", _RUNS)(lambda s, d: mt.last_n_valid(mt.with_scenario(tc.runs(s, d)), "costs", 5).select("scenario_id", "event_id"))
query("f6_group_history", "SELECT scenario_id, count(*) AS runs, strftime(to_timestamp(min(start)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(to_timestamp(floor(max(start))::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS last FROM (SELECT scenario_id, floor(start) AS start FROM rn) GROUP BY ALL")(lambda s, d: mt.group_history(mt.with_scenario(tc.runs(s, d)), "costs").select("scenario_id", F.col("runs").cast("long").alias("runs"), F.col("times")[0].alias("first"), F.element_at("times", -1).alias("last")))
query("f7_track_update", "SELECT user_id AS test, event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY ALL".replace("arg_max(value, event_id)", "round(arg_max(value, event_id), 6)"))(lambda s, d: mt.track_update(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("test"), F.col("event_type").alias("name"), "value", F.col("event_id").alias("seq"))).drop("seq"))
_KIND = "CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE 'exception' END"
query("f8_phase_state", "SELECT test, arg_max(phase, seq) FILTER (kind = 'start') AS phase_start, arg_max(phase, seq) FILTER (kind = 'end') AS phase_end, arg_max(phase, seq) FILTER (kind = 'exception') AS phase_exception, split_part(arg_max(phase, seq) FILTER (kind = 'exception'), ':', 1) AS failed_phase FROM ev GROUP BY ALL", f"ev AS (SELECT user_id AS test, event_id AS seq, {_KIND} AS kind, event_type || ':' || (event_id % 4) AS phase FROM events)")(lambda s, d: mt.phase_state(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("test"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), F.expr("concat(event_type, ':', event_id % 4)").alias("phase"))))
_LINE = "CASE event_id % 50 WHEN 0 THEN '==== test session ====' WHEN 10 THEN '==== FAILURES ====' WHEN 11 THEN '____ test_a ____' WHEN 20 THEN '____ test_b ____' WHEN 30 THEN '==== summary ====' ELSE {0} END"
query("f9_failure_sections", "SELECT file, section, string_agg(text, chr(10) ORDER BY n) AS body FROM (SELECT event_id // 50 AS file, event_id AS n, event_type AS text, CASE WHEN event_id % 50 < 20 THEN 'test_a' ELSE 'test_b' END AS section FROM events WHERE event_id % 50 BETWEEN 12 AND 29 AND event_id % 50 <> 20 AND (event_id // 50) * 50 + 11 >= (SELECT min(event_id) FROM events)) GROUP BY file, section")(lambda s, d: mt.failure_sections(s.read.parquet(f"{d}/events.parquet").select(F.expr("event_id div 50").alias("file"), F.col("event_id").alias("line_no"), F.expr(_LINE.format("event_type")).alias("text"))))
_RAST = "ra AS (SELECT gr.x, gr.y, (arg_max(SCL, t) IN (3, 8))::INT AS m, max(B04) AS v FROM gr JOIN px USING (x, y) GROUP BY ALL)"


def _raster(s: SparkSession, d: str) -> DataFrame:
    """Each pixel's largest red value over all dates, and whether its latest date is cloudy."""
    px = tc.pixels(s, d, ("B04", "SCL"))
    return px.groupBy("x", "y").agg(F.max_by("SCL", "t").isin(3, 8).cast("int").alias("m"), F.max("B04").alias("v"))


_AROUND = "SELECT a.x, a.y, {what} FROM ra a JOIN ra b ON abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} GROUP BY a.x, a.y"
query("f10_flat_kernel", _AROUND.format(what="round(sum(b.v)::DOUBLE, 6) AS v", r=2), _RAST)(lambda s, d: wn.apply_kernel(_raster(s, d).select("x", "y", "v"), [[1] * 5] * 5))
query("f10_kernel", "SELECT a.x, a.y, round(sum(b.v * w)::DOUBLE / 16, 6) AS v FROM ra a JOIN ra b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 JOIN (VALUES (0, 4), (1, 2), (2, 1)) k(dist, w) ON abs(a.x - b.x) + abs(a.y - b.y) = dist GROUP BY a.x, a.y", _RAST)(lambda s, d: wn.apply_kernel(_raster(s, d).select("x", "y", "v"), [[1, 2, 1], [2, 4, 2], [1, 2, 1]], 1 / 16))
query("f11_erode", _AROUND.format(what="(sum(b.m) >= 9)::INT::DOUBLE AS m", r=1), _RAST)(lambda s, d: wn.erode(_raster(s, d).select("x", "y", "m")))
query("f11_dilate", _AROUND.format(what="(sum(b.m) > 0)::INT::DOUBLE AS m", r=1), _RAST)(lambda s, d: wn.dilate(_raster(s, d).select("x", "y", "m")))
query("f11_opening", "SELECT a.x, a.y, (sum(b.m) > 0)::INT::DOUBLE AS m FROM er a JOIN er b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL", f"{_RAST}, er AS (SELECT a.x, a.y, (sum(1 - b.m) >= 9)::INT AS m FROM ra a JOIN ra b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)")(lambda s, d: wn.opening(_raster(s, d).select("x", "y", (1 - F.col("m")).alias("m"))))
query("f12_scl_dilation", "SELECT a.x, a.y, max(b.m1) + 0 > 0 OR max(CASE WHEN abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 THEN b.m2 ELSE 0 END) > 0 AS mask FROM cl a JOIN cl b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.x, a.y", "cl AS (SELECT x, y, (NOT c IN (2, 4, 5, 6, 7, 8, 9, 10))::INT AS m1, (c IN (3, 8))::INT AS m2 FROM (SELECT x, y, arg_max(SCL, t) AS c FROM px GROUP BY ALL))")(
    lambda s, d: wn.scl_dilation_mask(tc.pixels(s, d, ("SCL",)).groupBy("x", "y").agg(F.max_by("SCL", "t").alias("SCL")), kernel1_size=5, kernel2_size=3, mask1_values=(2, 4, 5, 6, 7, 8, 9, 10), mask2_values=(3, 8), erosion_kernel_size=1)
)
query("f13_cloud_distance", "SELECT a.x, a.y, round(CASE WHEN d IS NULL OR d > 6 THEN 1 WHEN d = 0 THEN 0 ELSE 1 - exp(-(d * d) / 18.0) END, 6) AS score FROM (SELECT a.x, a.y, min(abs(a.x - b.x) + abs(a.y - b.y)) AS d FROM ra a LEFT JOIN (SELECT * FROM ra WHERE m > 0 AND x % 5 = 0) b ON TRUE GROUP BY ALL) a", _RAST)(lambda s, d: wn.cloud_distance_score(_raster(s, d).select("x", "y", ((F.col("m") > 0) & (F.col("x") % 5 == 0)).alias("cloud")), "cloud", 6, 3.0).drop("cloud"))
cube_query("f14_date_score", "SELECT x, y, t, round(exp(-((day(t) - 15) * (day(t) - 15)) / 200.0), 6) AS score FROM px", lambda d: d.select("x", "y", "t", wn.date_score().alias("score")), ("SCL",))
cube_query("f15_rank_composite", "SELECT x, y, t, B04 FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY B08 DESC, t) AS k FROM px) WHERE k = 1", lambda d: wn.rank_composite(d, "B08"), ("B04", "B08"))
_PV = "pv AS (SELECT x, y, t, v, lag(v) OVER s AS p, lead(v) OVER s AS n, lag(t) OVER s AS tp, max(v) OVER (PARTITION BY x, y ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, max(v) OVER (PARTITION BY x, y ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lh, min(v) OVER (PARTITION BY x, y ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ll FROM (SELECT x, y, t, B08 / 5000.0::DOUBLE AS v FROM px) WINDOW s AS (PARTITION BY x, y ORDER BY t))"
cube_query("f16_peak_valley", "SELECT x, y, t, CASE WHEN v < p AND v <= n AND h - v >= 0.15 AND lh - v >= h - v AND (p - v) / (epoch_us(t) - epoch_us(tp)) * 86400e6 >= 0.007 THEN -1 WHEN v > p AND v >= n AND v - ll >= 0.15 THEN 1 ELSE 0 END AS turn FROM pv", lambda d: wn.peak_valley(d.select("x", "y", "t", (F.col("B08") / 5000.0).alias("v")), "v").drop("v"), ("B08",), _PV)

# --- 2.7, 2.8 order and sets ----------------------------------------------------------------------------------------------------

query("g1_sort_by_time", "SELECT event_id, round(start, 6) AS start FROM rn ORDER BY start")(lambda s, d: mt.sort_by_time(mt.with_scenario(tc.runs(s, d))).select("event_id", F.col("_timestamp").alias("start")))
query("g2_order_groups", "SELECT scenario_id, count(*) AS runs FROM rn GROUP BY ALL ORDER BY scenario_id")(lambda s, d: mt.order_groups(mt.with_scenario(tc.runs(s, d)).groupBy("scenario_id").agg(F.count("*").alias("runs"))))
cube_query("g3_best_scenes", "SELECT t, invalid FROM (SELECT *, sum((invalid = 0)::INT) OVER () AS clean, row_number() OVER (ORDER BY invalid, t) AS k FROM (SELECT t, count(*) FILTER (SCL < 4) AS invalid FROM px GROUP BY ALL)) WHERE CASE WHEN clean >= 4 THEN invalid = 0 ELSE k <= 4 END", lambda d: mt.best_scenes(d.groupBy("t").agg(F.count_if(F.col("SCL") < 4).alias("invalid"))), ("SCL",))
query("g4_ordered_shares", "SELECT feature_index, label, round(share, 6) AS share, round(100 * share / sum(share) OVER (PARTITION BY feature_index), 6) AS percent, row_number() OVER (PARTITION BY feature_index ORDER BY share DESC, label) AS place FROM (SELECT feature_index, unnest(['crop', 'tree', 'water']) AS label, unnest([avg((MAP = 40)::INT), avg((MAP = 10)::INT), avg((MAP = 80)::INT)]) AS share FROM lc JOIN zn ON x >= w AND x < w + 8 AND y >= s AND y < s + 5 GROUP BY feature_index)")(lambda s, d: mt.ordered_shares(pl.worldcover_fractions(tc.land_cover(s, d), tc.zones(s, d)).select("feature_index", "tree", "crop", "water")))
query("h1_union_runs", "SELECT event_id, round(value, 6) AS value, NULL::VARCHAR AS event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 2 = 1")(lambda s, d: mt.union_runs([s.read.parquet(f"{d}/events.parquet").where("event_id % 2 = 0").select("event_id", "value"), s.read.parquet(f"{d}/events.parquet").where("event_id % 2 = 1").select("event_id", "event_type")]))
query("h2_missing_columns", "SELECT event_id FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id") if mt.missing_columns(s.read.parquet(f"{d}/events.parquet"), ["event_id", "no_such"]) == ["no_such"] else s.createDataFrame([], "event_id long"))
query("h3_duplicates", "SELECT user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")(lambda s, d: mt.duplicates(s.read.parquet(f"{d}/events.parquet"), "user_id"))

# --- grids that grow with the tables: many zonal cells, tiles and lines ------------------------------------------------------------------

_WIDE = "wd AS (SELECT l_partkey::INT AS x, (l_suppkey * 7)::INT AS y, max(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL), wz AS (SELECT s_suppkey::INT AS feature_index, 13.0 * s_suppkey AS w, 5.0 * s_suppkey AS s FROM supplier)"


def _wide(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").cast("int").alias("x"), (F.col("l_suppkey") * 7).cast("int").alias("y")).agg(F.max("l_quantity").cast("double").alias("v"))


def _wide_zones(s: SparkSession, d: str) -> DataFrame:
    """A rectangle of 150 x 90 pixels for each supplier; they overlap."""
    corner = lambda x, y: f"struct(13D * s_suppkey + {x} AS x, 5D * s_suppkey + {y} AS y)"
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr("cast(s_suppkey as int) AS feature_index", f"array(array({corner(0, 0)}, {corner(150, 0)}, {corner(150, 90)}, {corner(0, 90)})) AS geom")


_HOLDS = "x >= w AND x < w + 150 AND y >= s AND y < s + 90"
query("c3_filter_spatial_wide", f"SELECT x, y, v FROM wd SEMI JOIN wz ON {_HOLDS}", _WIDE)(lambda s, d: zn.filter_spatial(_wide(s, d), _wide_zones(s, d)))
query("d4_zonal_join_wide", f"SELECT x, y, v, feature_index FROM wd JOIN wz ON {_HOLDS}", _WIDE)(lambda s, d: zn.zonal_join(_wide(s, d), _wide_zones(s, d)))
query("e9_aggregate_spatial_wide", f"SELECT feature_index, round(avg(v), 6) AS v FROM wd JOIN wz ON {_HOLDS} GROUP BY ALL", _WIDE)(lambda s, d: zn.aggregate_spatial(_wide(s, d), _wide_zones(s, d)))
query("e9_aggregate_spatial_median_wide", f"SELECT feature_index, round(median(v), 6) AS v FROM wd JOIN wz ON {_HOLDS} GROUP BY ALL", _WIDE)(lambda s, d: zn.aggregate_spatial(_wide(s, d), _wide_zones(s, d), "median"))
# groups beyond the given buffer, so that ranks are selected by histograms
query("e4_quantiles_of_groups", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.999), 6) AS q2 FROM lineitem GROUP BY ALL")(lambda s, d: quantiles_of_groups(s.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.999], buffer=1000, few=20))
query("f10_flat_kernel_wide", "SELECT a.x, a.y, sum(b.v) AS v FROM wd a JOIN wd b ON a.x - b.x BETWEEN -10 AND 10 AND a.y - b.y BETWEEN -10 AND 10 GROUP BY ALL", _WIDE)(lambda s, d: wn.apply_kernel(_wide(s, d), [[1] * 21] * 21))
query("n3_apply_neighborhood_wide", "SELECT a.x, a.y, count(b.v)::DOUBLE AS value FROM wd a JOIN wd b ON a.x - b.x BETWEEN -8 AND 8 AND a.y - b.y BETWEEN -8 AND 8 GROUP BY ALL", _WIDE)(lambda s, d: udf.apply_neighborhood(_wide(s, d), _neighbours, 64, 8, "x int, y int, value double", local=True))

# --- 2.9 scalars ------------------------------------------------------------------------------------------------------------------

cube_query("k1_k6_arithmetic", "SELECT x, y, t, B04 + B08 AS s, B04 - B08 AS d, B04 * SCL AS p, round(B04 / nullif(SCL, 0)::DOUBLE, 6) AS q, round(pow(B04, 0.5), 6) AS w, CASE WHEN B04 >= B08 THEN round(sqrt(B04 - B08), 6) END AS r, CASE WHEN SCL > 0 THEN round(ln(SCL), 6) END AS l, CASE WHEN SCL > 0 THEN round(log10(SCL), 6) END AS g, CASE WHEN SCL > 0 THEN round(ln(SCL) / ln(2.0), 6) END AS b, round(cos(sza * (3.14159265 / 180)), 6) AS c, abs(B04 - B08) AS a FROM px", lambda d: d.select("x", "y", "t", (F.col("B04") + F.col("B08")).alias("s"), (F.col("B04") - F.col("B08")).alias("d"), (F.col("B04") * F.col("SCL")).alias("p"), sc.divide("B04", "SCL").alias("q"), sc.power("B04", 0.5).alias("w"), sc.sqrt(F.col("B04") - F.col("B08")).alias("r"), sc.ln("SCL").alias("l"), sc.log("SCL", 10).alias("g"), sc.log("SCL", 2).alias("b"), sc.cos_degrees("sza").alias("c"), F.abs(F.col("B04") - F.col("B08")).alias("a")), ("B04", "B08", "SCL", "sza"))
cube_query("k7_k10_ranges", "SELECT x, y, t, round(round_even(B04 / 8.0::DOUBLE, 1), 6) AS r, greatest(100, least(2000, B04)) AS c, round(greatest(0, least(5000, B08)) / 5000.0::DOUBLE * 255, 6) AS s, B04 = B08 AS e, B04 <> B08 AS n, B04 < B08 AS lt, B04 <= B08 AS le, B04 > B08 AS gt, B04 >= B08 AS ge FROM px", lambda d: d.select("x", "y", "t", sc.round_half_even(F.col("B04") / 8.0, 1).alias("r"), sc.clip("B04", 100, 2000).alias("c"), sc.linear_scale("B08", 0, 5000, 0, 255).alias("s"), (F.col("B04") == F.col("B08")).alias("e"), (F.col("B04") != F.col("B08")).alias("n"), (F.col("B04") < F.col("B08")).alias("lt"), (F.col("B04") <= F.col("B08")).alias("le"), (F.col("B04") > F.col("B08")).alias("gt"), (F.col("B04") >= F.col("B08")).alias("ge")), ("B04", "B08"))
query("k11_k14_logic", "SELECT event_id, lower(event_type) = lower('CLICK') AS e, NOT (value > 50) AND event_id % 2 = 0 OR user_id > 100 AS l, CASE WHEN CASE WHEN event_id % 3 > 0 THEN value > 50 END THEN 1 ELSE 2 END AS i, event_id % 3 > 0 AS v FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", sc.eq_text("event_type", F.lit("CLICK"), False).alias("e"), ((~(F.col("value") > 50) & (F.col("event_id") % 2 == 0)) | (F.col("user_id") > 100)).alias("l"), sc.choose(F.when(F.col("event_id") % 3 > 0, F.col("value") > 50), F.lit(1), F.lit(2)).alias("i"), sc.is_valid(F.when(F.col("event_id") % 3 > 0, F.lit(1))).alias("v"))
)
cube_query("k15_k18_arrays", "SELECT x, y, t, [B02, B03, B04][2] AS e, greatest(B02, B03) AS g, CASE WHEN SCL <> 3 THEN greatest(B02, B03) END AS st, least(B02, B04) AS mi, B02 > 1990 OR B03 > 2490 AS an, list_max(list_transform([B02, B03], lambda v: v * 2)) AS tr FROM px", lambda d: d.select("x", "y", "t", sc.element(F.array("B02", "B03", "B04"), 1).alias("e"), sc.array_max(["B02", "B03"]).alias("g"), sc.array_max(["B02", F.when(F.col("SCL") != 3, F.col("B03"))], False).alias("st"), sc.array_min(["B02", "B04"]).alias("mi"), sc.array_any([F.col("B02") > 1990, F.col("B03") > 2490]).alias("an"), F.array_max(F.transform(F.array("B02", "B03"), lambda v: v * 2)).alias("tr")), ("B02", "B03", "B04", "SCL"))
query("k19_k24_text_time", "SELECT event_id, event_type || '/' || user_id AS tx, (ts::DATE + 3)::DATE AS d3, (ts::DATE + INTERVAL 1 MONTH)::DATE AS m1, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m') AS mo, strftime(ts, '%Y-%m-%d') AS da, event_type || '-' || (user_id % 10) AS sid, regexp_replace(node, '[^a-zA-Z0-9_.-]', '_', 'g') AS safe FROM events JOIN rn USING (event_id)")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").join(tc.runs(s, d).select("event_id", "test:nodeid", "test:start"), "event_id").select("event_id", sc.text_concat(["event_type", "user_id"], "/").alias("tx"), sc.date_shift("ts", 3, "day").alias("d3"), sc.date_shift("ts", 1, "month").alias("m1"), sc.iso_time("test:start").alias("iso"), sc.month_of("test:start").alias("mo"), sc.day_of("test:start").alias("da"), sc.scenario_id("test:nodeid").alias("sid"), sc.safe_node_id("test:nodeid").alias("safe"))
)
query("k25_k30_formats", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE regexp_replace(regexp_replace(printf('%.4f', event_id / 8.0), '0+$', ''), '\\.$', '') END AS f, (value >= 10)::INT + (value >= 50)::INT + (value >= 90)::INT AS b, week(ts) AS w, regexp_extract(props, '(\\d+)', 1) AS k, CAST(props->>'$.k' AS INT) AS j, list_filter([event_id, user_id], lambda v: v % 2 = 0)[1] AS fi FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", sc.format_number(F.when(F.col("event_id") % 9 != 0, F.col("event_id") / 8.0)).alias("f"), sc.digitize("value", [10, 50, 90]).alias("b"), sc.iso_week("ts").alias("w"), F.regexp_extract("props", r"(\d+)", 1).alias("k"), F.get_json_object("props", "$.k").cast("int").alias("j"), sc.first_where(F.array("event_id", "user_id"), lambda v: v % 2 == 0).alias("fi"))
)
query("k24_k29_keys_urls_json", "SELECT event_id, 'run1!' || regexp_replace(node, '[^a-zA-Z0-9_.-]', '_', 'g') || '!' || event_type AS asset, regexp_full_match(event_type, '[a-m].*') AS fm, 'h' || user_id || '.example' AS host, '/p/' || event_id AS path, coalesce(props->>'$.k', 'none') AS k, coalesce(props->>'$.missing', 'none') AS mi FROM events JOIN rn USING (event_id)")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").join(tc.runs(s, d).select("event_id", "test:nodeid"), "event_id").withColumn("url", F.expr("concat('https://h', user_id, '.example/p/', event_id, '?q=1#r')")).select("event_id", sc.asset_key(F.lit("run1"), "test:nodeid", "event_type").alias("asset"), sc.full_match("event_type", "[a-m].*").alias("fm"), sc.url_part("url", "HOST").alias("host"), sc.url_part("url", "PATH").alias("path"), sc.json_field("props", "$.k", F.lit("none")).alias("k"), sc.json_field("props", "$.missing", F.lit("none")).alias("mi"))
)
query("k31_sar_levels", "SELECT x, y, t, round(30 * VH / nullif(VV, 0), 6) AS ratio, round(30 + 10 * log10(VV), 6) AS level FROM rd")(lambda s, d: tc.radar(tc.pixels(s, d, ("VV", "VH"))).select("x", "y", "t", ix.sar_ratio().alias("ratio"), ix.sar_level("VV").alias("level")))

# --- 2.10 indices -------------------------------------------------------------------------------------------------------------------

_DN = {b: f"({b} / 10000.0::DOUBLE)" for b in tc.BANDS}
_ND = lambda a, b: f"(({a} - {b})::DOUBLE / nullif({a} + {b}, 0))"


def index_query(name: str, shown: dict, sqls: dict[str, str], labels: tuple[str, ...], make: Callable | None = None, digits: int = 6) -> None:
    """Columns of an index against SQL, both rounded; halves of the last decimal are lifted a little, as engines differ on them."""
    cols = ", ".join(f"round(({q}) + 1e-9, {digits}) + 0.0::DOUBLE AS {k}" for k, q in sqls.items())
    cube_query(name, f"SELECT x, y, t, {cols} FROM px", lambda d: d.select("x", "y", "t", *(F.round(c.cast("double") + 1e-9, digits).alias(k) for k, c in (make() if make else shown).items())), labels)


_LIN = lambda v: f"(greatest(0, least(1, {v})) * 255)::DOUBLE"
B = _DN


def _when(v: str, of: str) -> str:
    return f"CASE WHEN ({v}) IS NOT NULL THEN {of} END"


def _bytes(v: str) -> str:
    return _when(v, _LIN(f"({v})"))


index_query("l1_ndvi", {}, {"ndvi": _ND("B08", "B04")}, ("B04", "B08"), lambda: {"ndvi": ix.ndvi()})
index_query("l2_nbr_pvir2", {}, {"nbr": _ND("B08", "B12"), "pvir2": f"{_ND('B08', 'B04')} + {_ND('B08', 'B12')}", "bai": f"1 / ((0.1 - {B['B04']}) * (0.1 - {B['B04']}) + (0.06 - {B['B08']}) * (0.06 - {B['B08']}))"}, ("B04", "B08", "B12"), lambda: {"nbr": ix.nbr(), "pvir2": ix.pvir2(), "bai": ix.bai()})
_EVI = f"(2.5 * ({B['B08']} - {B['B04']}) / nullif({B['B08']} + 6 * {B['B04']} - 7.5 * {B['B02']} + 1, 0))"
index_query("l3_evi", {}, {"evi": _EVI, "lai": f"4.0543 * {_EVI} + 1.7901"}, ("B02", "B04", "B08"), lambda: {"evi": ix.evi(), "lai": ix.evi_lai()})
_EVI2 = f"(2.4 * ({B['B08']} - {B['B04']}) / ({B['B08']} + {B['B04']} + 1))"
_RAMP = lambda i: "CASE " + " ".join(f"WHEN {_EVI2} < {b} THEN {c[i]}" for b, c in ix.EVI2_RAMP[:-1]) + f" ELSE {ix.EVI2_RAMP[-1][1][i]} END::DOUBLE"
index_query("l4_evi2", {}, {"evi2": _EVI2, "red": f"({_RAMP(0)})", "green": f"({_RAMP(1)})", "blue": f"({_RAMP(2)})"}, ("B04", "B08"), lambda: {"evi2": ix.evi2(), **ix.evi2_colours()})
_G = f"(0.106 * ({B['B04']} - {B['B02']}))"
index_query("l5_arvi", {}, {"arvi": f"(({B['B8A']} - {B['B04']}) - {_G}) / nullif(({B['B8A']} + {B['B04']}) - {_G}, 0)"}, ("B02", "B04", "B8A"), lambda: {"arvi": ix.arvi()})
_BA = f"((1 - sqrt({B['B06']} * {B['B07']} * {B['B8A']} / nullif({B['B04']}, 0))) * (({B['B12']} - {B['B8A']}) / nullif(sqrt({B['B12']} + {B['B8A']}), 0) + 1))"
index_query("l6_bais2", {}, {"bais2": _BA, "red": _LIN(f"CASE WHEN {_BA} < 0 THEN 1 WHEN {_BA} < 0.5 THEN 0.9803921569 * {_BA} / 0.5 WHEN {_BA} <= 0.99 THEN 0.9803921569 + (1 - 0.9803921569) * ({_BA} - 0.5) / 0.49 ELSE 1 END"), "green": _LIN(f"CASE WHEN {_BA} < 0 THEN 1 WHEN {_BA} < 0.5 THEN {_BA} / 0.5 WHEN {_BA} <= 0.99 THEN 1 + (0.0784313725 - 1) * ({_BA} - 0.5) / 0.49 ELSE 0 END"), "blue": _LIN(f"CASE WHEN {_BA} < 0 THEN 1 WHEN {_BA} < 0.5 THEN 1 + (0.0392156863 - 1) * {_BA} / 0.5 WHEN {_BA} <= 0.99 THEN 0.0392156863 + (0.0784313725 - 0.0392156863) * ({_BA} - 0.5) / 0.49 ELSE 1 END")}, ("B04", "B06", "B07", "B8A", "B12"), lambda: {"bais2": ix.bais2(), **ix.bais2_colours()}, 4)
_BSI = f"((({B['B11']} + {B['B04']}) - ({B['B08']} + {B['B02']})) / nullif(({B['B11']} + {B['B04']}) + ({B['B08']} + {B['B02']}), 0))"
index_query("l7_barren_soil", {}, {"bsi": _BSI, "red": f"2.5 * {_BSI}", "green": B["B08"], "blue": B["B11"]}, ("B02", "B04", "B08", "B11"), lambda: {"bsi": ix.bsi(), **ix.barren_soil()})
_BR, _NG = f"(({B['B03']} - 0.175) / 0.215::DOUBLE)", _ND("B03", "B04")
_THICK, _THIN = f"({B['B11']} > 0.1 AND {_BR} > 1)", f"({B['B11']} > 0.1 AND {_BR} > 0 AND {_NG} > 0)"
_C1 = lambda v: f"greatest(0, least(1, {v}))"
index_query("l8_cloud_bcy", {}, {"red": _C1(f"CASE WHEN {_THICK} THEN 0.5 * {B['B04']} WHEN {_THIN} THEN 0.5 * {B['B04']} + 5 * sqrt(greatest(0, {_BR} * {_NG})) ELSE 2.5 * {B['B04']} END"), "green": _C1(f"CASE WHEN {_THICK} OR {_THIN} THEN 0.5 * {B['B03']} ELSE 2.5 * {B['B03']} END"), "blue": _C1(f"CASE WHEN {_THICK} THEN 0.5 * {B['B02']} + 0.5 * ({_BR} - 1) WHEN {_THIN} THEN 0.5 * {B['B02']} ELSE 2.5 * {B['B02']} END")}, ("B02", "B03", "B04", "B11"), lambda: ix.cloud_bcy())
_NW, _MO = _ND("B03", "B08"), _ND("B8A", "B11")
_PLAIN = f"({_THICK} OR {_THIN} OR ({_NW} < 0 AND coalesce(({_NW} - {_MO}) / nullif({_NW} + {_MO}, 0) > 0, FALSE)))"
_FAI = f"({B['B08']} - ({B['B04']} + ({B['B11']} - {B['B04']}) * {ix.FAI_SLOPE}))"
index_query("l9_aquatic_plants", {}, {k: _bytes(f"CASE WHEN {_PLAIN} THEN 3 * {B[b]} ELSE {v} END") for k, b, v in (("red", "B04", f"8.5 * {_FAI}"), ("green", "B03", f"5.5 * {_ND('B05', 'B04')}"), ("blue", "B02", _NW))}, ("B02", "B03", "B04", "B05", "B08", "B8A", "B11"), lambda: ix.aquatic_plants())
_FB = f"(8.5 * ({B['B12']} - {B['B11']}) / ({B['B12']} + {B['B11']} + 0.25))"
index_query("l10_fire_boundary", {}, {"fire": _LIN(f"CASE WHEN {_FB} <= -1 THEN 0 WHEN {_FB} <= 1 THEN 0.46295 * ({_FB} + 1) WHEN {_FB} <= 3 THEN 0.9259 + 0.03705 * ({_FB} - 1) ELSE 1 END")}, ("B11", "B12"), lambda: {"fire": ix.fire_boundary()})
index_query("l11_wildfire", {}, {k: (f"sqrt({B[b]})" + (f" + CASE WHEN {_ND('B08', 'B12')} < -0.25 THEN 0.3 ELSE 0 END" if k != "blue" else "")) for k, b in (("red", "B04"), ("green", "B03"), ("blue", "B02"))}, ("B02", "B03", "B04", "B08", "B12"), lambda: ix.wildfire_highlight())
index_query("l12_ndsi_snow", {}, {k: _LIN(f"CASE WHEN {_ND('B03', 'B11')} > 0.42 THEN {v} ELSE 2.5 * {B[b]} END") for k, v, b in (("red", 0, "B04"), ("green", 0.8, "B03"), ("blue", 1, "B02"))}, ("B02", "B03", "B04", "B11"), lambda: ix.ndsi_snow())
index_query("l13_snow_classifier", {}, {k: _LIN(f"CASE WHEN ({_ND('B03', 'B11')} >= 0.4 OR abs({_ND('B08', 'B04')} - 0.1) <= 0.025) AND {B['B03']} > 0.3 THEN {v} ELSE 2.5 * {B[b]} END") for k, v, b in (("red", 1, "B04"), ("green", 0.8, "B03"), ("blue", 0.4, "B02"))}, ("B02", "B03", "B04", "B08", "B11"), lambda: ix.snow_classifier())
_WATER = f"({_ND('B03', 'B11')} > 0.1 OR {_ND('B03', 'B08')} > 0.2 OR (B02 > B11 AND 1 / sqrt(greatest(B02 - B11, 1) / 10000.0::DOUBLE) > 0.03))"
index_query("l14_surface_water", {}, {k: _LIN(f"CASE WHEN {_WATER} THEN {v} ELSE 2 * {B[b]} END") for k, v, b in (("red", 0, "B04"), ("green", 0, "B03"), ("blue", 1, "B02"))}, ("B02", "B03", "B04", "B08", "B11"), lambda: ix.surface_water())
_PS = f"(({B['B04']} - {B['B02']}) / {B['B06']})"
index_query("l15_psri", {}, {"psri": _PS, "ramp": f"CASE WHEN {_PS} <= -0.2 THEN 0 WHEN {_PS} <= 0.4 THEN 0.9259 / 0.6 * ({_PS} + 0.2) WHEN {_PS} <= 1 THEN 0.9259 + 0.0741 / 0.6 * ({_PS} - 0.4) ELSE 1 END"}, ("B02", "B04", "B06"), lambda: {"psri": ix.psri(), "ramp": ix.psri_ramp()})
query("l16_urban_sar", f"SELECT x, y, t, CASE WHEN 5.5 * VH > 0.5 THEN 255.0 ELSE 0 END::DOUBLE AS red, round({_LIN('VV')}, 6) AS green, round({_LIN('8 * VH')}, 6) AS blue FROM rd")(lambda s, d: tc.radar(tc.pixels(s, d, ("VV", "VH"))).select("x", "y", "t", *(c.alias(k) for k, c in ix.urban_sar().items())))
index_query("l17_natural_colour", {}, {"red": f"2.8 * {B['B04']} + 0.1 * {B['B05']}", "green": f"2.8 * {B['B03']} + 0.15 * {B['B08']}", "blue": f"2.8 * {B['B02']}"}, ("B02", "B03", "B04", "B05", "B08"), lambda: ix.natural_colour())
cube_query("l18_ndfi", "SELECT x, y, t, round((B12 / a - B08 / b) / nullif(B08 / b, 0), 6) AS ndfi FROM (SELECT x, y, t, B12, B08, avg(B12) OVER (PARTITION BY t) AS a, avg(B08) OVER (PARTITION BY t) AS b FROM px)", lambda d: pl.ndfi(d).select("x", "y", "t", "ndfi"), ("B08", "B12"))
_PPI = "ps AS (SELECT x, y, 3500 + x * 20 AS dvi_max0, 100 + y * 5 AS dvi_soil FROM gr), pt AS (SELECT ps.*, greatest(dvi_max0, max(dvi_soil) OVER (PARTITION BY x // 8, y // 5)) AS dvi_max FROM ps), pq AS (SELECT px.x, px.y, t, (B08 - B04) / 10000.0::DOUBLE AS dvi, least(dvi_max / 10000.0::DOUBLE, 0.8) AS mx, dvi_soil / 10000.0::DOUBLE AS so, cos(sza * (3.14159265 / 180)) AS c FROM px JOIN pt USING (x, y)), pr AS (SELECT *, least(0.0336 + 0.0477 / c, 1) AS dc FROM pq), pu AS (SELECT *, 1 / (4 * (dc + (1 - dc) * 0.5 / c)) * (1 + mx) / (1 - mx) AS k FROM pr)"
query("l19_ppi", "SELECT x, y, t, round(CASE WHEN dvi < so THEN 0 WHEN mx <= dvi THEN 3 ELSE greatest(0, least(3, -k * ln(CASE WHEN dvi < mx THEN (mx - dvi) / (mx - so) END))) END, 6) AS ppi FROM pu", _PPI)(lambda s, d: pl.plant_phenology(tc.pixels(s, d, ("B04", "B08", "sza")), tc.land_cover(s, d).select("x", "y", (3500 + F.col("x") * 20).alias("dvi_max"), (100 + F.col("y") * 5).alias("dvi_soil")), tc.zones(s, d)))
index_query("l20_l24_others", {}, {"lst": "B11 * 0.00341802::DOUBLE + 149.0 - 273.15", "db": "10 * log10(B04)", "kndvi": f"tanh({_ND('B08', 'B04')} * {_ND('B08', 'B04')})", "amwi": _ND("B04", "B02"), "ndci": f"CASE WHEN {_ND('B03', 'B08')} >= 0 THEN {_ND('B05', 'B04')} END"}, ("B02", "B03", "B04", "B05", "B08", "B11"), lambda: {"lst": ix.lst_celsius("B11"), "db": ix.decibel("B04"), "kndvi": ix.kndvi(), "amwi": ix.amwi(), "ndci": ix.ndci()})

# --- 2.10 workflows -------------------------------------------------------------------------------------------------------------------

query("m2_max_ndvi_composite", "SELECT x, y, max(B04) FILTER (v = m) AS B04, max(B03) FILTER (v = m) AS B03, max(B02) FILTER (v = m) AS B02 FROM (SELECT *, max(v) OVER (PARTITION BY x, y) AS m FROM (SELECT px.*, (B08 - B04)::DOUBLE / nullif(B08 + B04, 0) AS v FROM px JOIN sc USING (t) WHERE cloud_cover <= 75 AND SCL NOT IN (3, 8, 9, 10, 1, 6, 11, 0))) GROUP BY ALL")(lambda s, d: pl.max_ndvi_composite(tc.pixels(s, d, ("B02", "B03", "B04", "B08", "SCL")), tc.scenes(s, d)))
cube_query("m3_monthly_composite", f"SELECT x, y, round(max(r) FILTER (v = m), 6) AS red, round(max(g) FILTER (v = m), 6) AS green, round(max(b) FILTER (v = m), 6) AS blue FROM (SELECT *, max(v) OVER (PARTITION BY x, y) AS m FROM (SELECT x, y, 2.8 * {B['B04']} + 0.1 * {B['B05']} AS r, 2.8 * {B['B03']} + 0.15 * {B['B08']} AS g, 2.8 * {B['B02']} AS b, B08::DOUBLE / B03 AS v FROM px WHERE SCL NOT IN (3, 8, 9, 10, 11))) GROUP BY ALL", pl.monthly_composite, ("B02", "B03", "B04", "B05", "B08", "SCL"))
cube_query("m4_cloudless_mosaic", "SELECT x, y, round(coalesce(median(B04) FILTER (SCL = 4), median(B04) FILTER (SCL <> 4)), 6) AS B04 FROM px GROUP BY ALL", lambda d: pl.cloudless_mosaic(d, F.col("SCL") == 4, ["B04"]), ("B04", "SCL"))
cube_query("m5_bap_composite", "SELECT x, y, month, t, B04 FROM (SELECT *, row_number() OVER (PARTITION BY x, y, month ORDER BY s DESC, t) AS k FROM (SELECT x, y, p.t, B04, date_trunc('month', p.t)::TIMESTAMP AS month, round((CASE WHEN d IS NULL OR d > 150 THEN 1 WHEN d = 0 THEN 0 ELSE 1 - exp(-(d * d) / 5000.0) END + 0.5 * cv + 0.1 * exp(-((day(p.t) - 15) * (day(p.t) - 15)) / 200.0)) / 1.6, 9) AS s, cl FROM (SELECT a.x, a.y, a.t, any_value(a.B04) AS B04, any_value(a.cl) AS cl, min(abs(a.x - b.x) + abs(a.y - b.y)) AS d FROM cc a LEFT JOIN (SELECT * FROM cc WHERE cl) b ON a.t = b.t GROUP BY a.x, a.y, a.t) p JOIN (SELECT t, 1 - avg(cl::INT) AS cv FROM cc GROUP BY ALL) USING (t)) WHERE NOT cl) WHERE k = 1", lambda d: pl.bap_composite(d, ["B04"]), ("B04", "SCL"), "cc AS (SELECT x, y, t, B04, SCL IN (3, 8, 9, 10) AS cl FROM px)")
query("m6_soil_moisture", "SELECT x, y, CASE WHEN 10 * log10(me) BETWEEN -17 AND -6 THEN round((la - lo) / nullif(hi - lo, 0), 6) END AS SSM FROM (SELECT x, y, min(VH) FILTER (t < TIMESTAMP '1998-01-01') AS lo, max(VH) FILTER (t < TIMESTAMP '1998-01-01') AS hi, avg(VH) FILTER (t < TIMESTAMP '1998-01-01') AS me, arg_max(VH, t) FILTER (t >= TIMESTAMP '1998-01-01') AS la FROM rd GROUP BY ALL)")(lambda s, d: pl.soil_moisture(tc.radar(tc.pixels(s, d, ("VV", "VH"))), "VH", ("1990-01-01", "1998-01-01"), ("1998-01-01", "2010-01-01")))
query("m7_sar_stats", f"SELECT x, y, {_STATS(['VH', 'VV'])} FROM rd GROUP BY ALL")(lambda s, d: pl.sar_stats(tc.radar(tc.pixels(s, d, ("VV", "VH")))))
_BARE = (
    "nc AS (SELECT a.x, a.y, a.t FROM px a JOIN px b ON a.t = b.t AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL HAVING bool_or(b.SCL IN (3, 8, 9, 10))), "
    "cr AS (SELECT px.*, (B08 - B04)::DOUBLE / nullif(B08 + B04, 0) + (B08 - B12)::DOUBLE / nullif(B08 + B12, 0) AS v FROM px ANTI JOIN nc USING (x, y, t) WHERE sza <= 60 AND SCL NOT IN (0, 1, 2, 6, 11)), "
    "so AS (SELECT x, y, t, MAP IN (50, 80) AS other, v <= 0.3 AND NOT MAP IN (50, 80) AS bare, CASE WHEN v <= 0.3 AND NOT MAP IN (50, 80) THEN B02 END AS B02, CASE WHEN v <= 0.3 AND NOT MAP IN (50, 80) THEN B04 END AS B04 FROM cr JOIN lc USING (x, y)), "
    "s1 AS (SELECT *, median(B02) OVER (PARTITION BY x, y) AS med FROM so), s2 AS (SELECT *, median(abs(B02 - med)) OVER (PARTITION BY x, y) AS mad FROM s1), "
    "s3 AS (SELECT x, y, other, CASE WHEN NOT coalesce(B02 > med + 3 * 1.4826 * mad AND B02 > med + 80, FALSE) THEN B02 END AS B02, CASE WHEN NOT coalesce(B02 > med + 3 * 1.4826 * mad AND B02 > med + 80, FALSE) THEN B04 END AS B04 FROM s2), "
    "s4 AS (SELECT x, y, avg(B02) AS a, stddev_samp(B02) AS b, avg(B04) AS c, stddev_samp(B04) AS d, count(*) AS valid_count, count(B02) AS bare_count, bool_or(other) AS o FROM s3 GROUP BY ALL), "
    "s5 AS (SELECT x, y, CASE WHEN bare_count >= 3 THEN a END AS B02_mean, CASE WHEN bare_count >= 3 THEN b END AS B02_sd, CASE WHEN bare_count >= 3 THEN c END AS B04_mean, CASE WHEN bare_count >= 3 THEN d END AS B04_sd, valid_count, bare_count, bare_count / valid_count AS frequency, CASE WHEN o THEN 3 WHEN bare_count >= 3 THEN 1 ELSE 2 END AS class FROM s4)"
)


def _bare(s: SparkSession, d: str) -> DataFrame:
    return pl.bare_surface_composite(tc.pixels(s, d, ("B02", "B04", "B08", "B12", "SCL", "sza")), 0.3, tc.land_cover(s, d), ("B02", "B04"), max_sza=60, dilation=3, mask=True)


_R6 = lambda *n: ", ".join(f"round({c}, 6) AS {c}" for c in n)
query("m8_bare_surface", f"SELECT x, y, {_R6('B02_mean', 'B02_sd', 'B04_mean', 'B04_sd')}, valid_count, bare_count, round(frequency, 6) AS frequency, class FROM s5", _BARE)(_bare)
query("m9_ci95", "SELECT x, y, round(B04_mean - 1.96 * B04_sd / sqrt(nullif(bare_count, 0)), 6) AS low, round(B04_mean + 1.96 * B04_sd / sqrt(nullif(bare_count, 0)), 6) AS high FROM s5", _BARE)(lambda s, d: pl.ci95(_bare(s, d), ["B04"]).select("x", "y", F.col("B04_low").alias("low"), F.col("B04_high").alias("high")))
_UHI = "su AS (SELECT x, y, avg(v) AS v FROM (SELECT x, y, year(t) AS j, avg(B11 * 0.00341802::DOUBLE + 149.0 - 273.15) AS v FROM px WHERE month(t) IN (6, 7, 8) GROUP BY ALL) GROUP BY ALL), ul AS (SELECT x, y, v, MAP = 50 AS urban FROM su JOIN lc USING (x, y))"
query("m10_urban_heat_island", "SELECT a.x, a.y, round(any_value(a.v) - sum(b.v) FILTER (NOT b.urban) / nullif(count(*) FILTER (NOT b.urban), 0), 6) AS uhi FROM ul a JOIN ul b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 WHERE a.urban GROUP BY a.x, a.y", _UHI)(lambda s, d: pl.urban_heat_island(tc.pixels(s, d, ("B11",)), tc.land_cover(s, d), "B11", kernel=7))
query("m11_lai_period", "SELECT x, y, p::TIMESTAMP AS t, round(greatest(0, least(7.5, median(lai))) / 7.5 * 240, 6) AS lai FROM (SELECT x, y, date_trunc('month', t) AS p, 4.0543 * 2.5 * (B08 - B04) / 10000.0 / ((B08 + 6 * B04 - 7.5 * B02) / 10000.0 + 1) + 1.7901 AS lai FROM px JOIN lc USING (x, y) WHERE MAP = 10) WHERE lai BETWEEN 0 AND 7.5 GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY x, y, p"))(lambda s, d: pl.lai_period(tc.pixels(s, d, ("B02", "B04", "B08")), tc.land_cover(s, d), name="median"))
query("m12_variability_map", "SELECT feature_index, x, y, t, CASE WHEN r < 85 THEN 1 WHEN r < 95 THEN 2 WHEN r < 105 THEN 3 WHEN r < 115 THEN 4 ELSE 5 END::DOUBLE AS variability FROM (SELECT *, B04 / nullif(median(B04) OVER (PARTITION BY feature_index, t), 0) * 100 AS r FROM pz)")(lambda s, d: zn.variability_classes(tc.pixels(s, d, ("B04",)).select("x", "y", "t", F.col("B04").alias("value")), tc.zones(s, d)))
query("m12_variability_raw", "SELECT feature_index, x, y, t, round(greatest(0, least(100, B04 / nullif(median(B04) OVER (PARTITION BY feature_index, t), 0) * 100)), 6) AS variability FROM pz")(lambda s, d: zn.variability_classes(tc.pixels(s, d, ("B04",)).select("x", "y", "t", F.col("B04").alias("value")), tc.zones(s, d), raw=True))
_WEEK = "gp AS (SELECT x, y, t, v, row_number() OVER (PARTITION BY x, y ORDER BY t) AS i FROM (SELECT x, y, date_trunc('week', t) AS t, avg(CASE WHEN SCL NOT IN (3, 8, 9) THEN B04 END) AS v FROM px GROUP BY ALL)), gq AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS i0, last_value(v IGNORE NULLS) OVER w AS v0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS i1, first_value(v IGNORE NULLS) OVER z AS v1 FROM gp WINDOW w AS (PARTITION BY x, y ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY x, y ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
cube_query("m13_fill_and_median", "SELECT x, y, round(median(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (i - i0)::DOUBLE / (i1 - i0) * (v1 - v0) END), 6) AS B04 FROM gq GROUP BY ALL", lambda d: pl.fill_and_median(cb.mask_where(d, cb.scl_mask((3, 8, 9))).select("x", "y", "t", "B04")), ("B04", "SCL"), _WEEK)
_MIRRORED = "CASE WHEN {0} + {1} < {2} THEN 2 * {2} - ({0} + {1}) WHEN {0} + {1} > {3} THEN 2 * {3} - ({0} + {1}) ELSE {0} + {1} END"
# medians first; indices of them; texture in windows of 9 of bytes between the extrema of the one chunk that holds the grid
_FIRE = f"""f1 AS (SELECT x, y, median(floor(greatest(0, least(30, 30 * VH / nullif(VV, 0))) * 1000)) AS ratio, median(floor(greatest(0, least(30, 30 + 10 * log10(VV))) * 1000)) AS VV_db FROM rd GROUP BY ALL), f2 AS (SELECT x, y, median(B04) AS B04, median(B08) AS B08, median(B12) AS B12 FROM px WHERE SCL NOT IN (3, 8, 9, 10, 1, 6, 11, 0) GROUP BY ALL),
f3 AS (SELECT *, (B08 - B12) / nullif(B08 + B12, 0) AS nbr, 1 / ((0.1::DOUBLE - B04 / 10000) ** 2 + (0.06::DOUBLE - B08 / 10000) ** 2) AS bai, (B12 / avg(B12) OVER () - B08 / avg(B08) OVER ()) / nullif(B08 / avg(B08) OVER (), 0) AS ndfi FROM f2),
fx AS (SELECT min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy, min(B12) AS lo, max(B12) AS hi FROM f2), fi AS (SELECT x, y, floor((B12 - lo) / (hi - lo) * 255) AS g FROM f2, fx),
fn AS (SELECT a.x, a.y, dx, dy, coalesce(b.g, 0) AS v FROM fi a CROSS JOIN fx CROSS JOIN (SELECT unnest(range(-4, 5)) AS dx) CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy) LEFT JOIN fi b ON b.x = {_MIRRORED.format("a.x", "dx", "lox", "hix")} AND b.y = {_MIRRORED.format("a.y", "dy", "loy", "hiy")}),
ft AS (SELECT x, y, var_pop(v) AS variance, avg((w - v) * (w - v)) AS contrast FROM (SELECT *, max(v) OVER (PARTITION BY x, y, dy ORDER BY dx RANGE BETWEEN 5 FOLLOWING AND 5 FOLLOWING) AS w FROM fn) GROUP BY x, y)"""
query("m14_fire_features", "SELECT x, y, round(VV_db, -1) AS VV_db, round(B04, 6) AS B04, round(nbr, 6) AS nbr, round(bai, 6) AS bai, round(ndfi, 6) AS ndfi, round(variance, 6) AS variance, round(contrast, 6) AS contrast FROM f1 FULL JOIN (SELECT * FROM f3 JOIN ft USING (x, y)) USING (x, y)", _FIRE)(lambda s, d: pl.fire_features(tc.radar(tc.pixels(s, d, ("VV", "VH"))), tc.pixels(s, d, ("B04", "B08", "B12", "SCL")), context={"padding_window_size": 9}).select("x", "y", F.round("VV_db", -1).alias("VV_db"), "B04", "nbr", "bai", "ndfi", "variance", "contrast"))
query("m15_country_extract", "SELECT x, y, t, greatest(-10, least(2000, B04))::DOUBLE AS B04 FROM pz WHERE t >= TIMESTAMP '1996-05-01' AND t < TIMESTAMP '1996-05-02' AND feature_index IN (2, 3, 9)")(lambda s, d: pl.country_extract(tc.pixels(s, d, ("B04",)), tc.zones(s, d).where("feature_index IN (2, 3, 9)"), "B04", 1996, 5, high=2000))
query("m16_burn_severity", "SELECT x, y, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN a.v - b.v ELSE coalesce(a.v, b.v) END, 6) AS dnbr FROM (SELECT x, y, (max(B08) - max(B12))::DOUBLE / (max(B08) + max(B12)) AS v FROM px WHERE t < TIMESTAMP '1996-01-01' GROUP BY ALL) a FULL JOIN (SELECT x, y, (max(B08) - max(B12))::DOUBLE / (max(B08) + max(B12)) AS v FROM px WHERE t >= TIMESTAMP '2001-01-01' GROUP BY ALL) b USING (x, y)")(lambda s, d: pl.burn_severity(*(tc.pixels(s, d, ("B08", "B12")).where(w).groupBy("x", "y").agg(F.max("B08").alias("B08"), F.max("B12").alias("B12")) for w in ("t < timestamp'1996-01-01'", "t >= timestamp'2001-01-01'"))))
query("m17_parcel_heterogeneity", "SELECT feature_index, t, round(stddev_samp(B04) / avg(B04), 6) AS B04 FROM pz GROUP BY ALL")(lambda s, d: pl.parcel_heterogeneity(tc.pixels(s, d, ("B04",)), tc.zones(s, d)))
query("m20_trend_series", "SELECT scenario_id, n AS runs, round(mx, 6) AS top, round(median + greatest(2.0, 3 * 1.4826 * mad), 2) AS upper FROM me JOIN md USING (scenario_id) JOIN (SELECT scenario_id, max(costs) AS mx FROM rn GROUP BY ALL) USING (scenario_id)", _MAD)(lambda s, d: mt.trend_series(tc.runs(s, d)).select("scenario_id", F.size("values").cast("long").alias("runs"), F.array_max("values").alias("top"), F.round(F.element_at("upper_limit", 1), 2).alias("upper")))
cube_query("n9_ndvi_stack", "SELECT x, y, t, CASE WHEN v > -0.08 THEN round(least(v, 0.92) + 0.08, 6) END AS ndvi FROM (SELECT x, y, t, (B08 - B04)::DOUBLE / nullif(B08 + B04, 0) AS v FROM px)", lambda d: pl.ndvi_stack(d.select("x", "y", "t", ix.ndvi().alias("ndvi"))), ("B04", "B08"))
cube_query("n9_scene_quality", "SELECT t, count(*) FILTER (v IS NULL OR v <= -0.08) AS invalid, TRUE AS tile_valid FROM (SELECT t, (B08 - B04)::DOUBLE / nullif(B08 + B04, 0) AS v FROM px) GROUP BY ALL", lambda d: pl.scene_quality(pl.ndvi_stack(d.select("x", "y", "t", ix.ndvi().alias("ndvi")))), ("B04", "B08"))
cube_query("n10_zscore", "SELECT x, y, t, round((B04 - (SELECT avg(B04) FROM px)) / (SELECT stddev_samp(B04) FROM px), 6) AS B04 FROM px", lambda d: pl.zscore(d, d.agg(F.avg("B04").alias("B04_mean"), F.stddev_samp("B04").alias("B04_sd"))), ("B04",))

# --- 2.12 user functions: no SQL, checked in the tests ---------------------------------------------------------------------------------


def _neighbours(rows):
    image, y, x = udf.grid_of(rows, "v")
    held = __import__("numpy").pad((image == image).astype(float), 8)
    total = __import__("numpy").pad(held.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return rows[["x", "y"]].assign(value=total[y + 17, x + 17] - total[y, x + 17] - total[y + 17, x] + total[y, x])


def _ratio(rows, context):
    return rows[["x", "y", "t"]].assign(value=rows["B08"] * context["gain"] / rows["B04"])


def _span(rows):
    return rows[["x", "y"]].head(1).assign(days=float((rows["t"].max() - rows["t"].min()).days))


def _box(rows):
    image, y, x = udf.grid_of(rows, "v")
    padded = __import__("numpy").pad(image, 1, mode="edge")
    total = sum(padded[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3))
    return rows[["x", "y"]].assign(value=total[y, x] / 9)


def _spread_by_date(rows):
    return rows[["feature_index", "t"]].head(1).assign(spread=float(rows["B04"].max() - rows["B04"].min()))


def _spread(rows):
    return rows[["feature_index"]].head(1).assign(spread=float(rows["B04"].max() - rows["B04"].min()))


query("n1_apply_pixels", "SELECT x, y, t, round(B08 * 2.0::DOUBLE / B04, 6) AS value FROM px")(lambda s, d: udf.apply_pixels(tc.pixels(s, d, ("B04", "B08")), _ratio, "x int, y int, t timestamp, value double", {"gain": 2.0}))
query("n2_apply_series", "SELECT x, y, date_diff('day', min(t)::DATE, max(t)::DATE)::DOUBLE AS days FROM px GROUP BY ALL")(lambda s, d: udf.apply_series(tc.pixels(s, d, ("B04",)), _span, "x int, y int, days double"))
_CLAMP = "least(greatest(a.{c} + {d}, (SELECT min({c}) FROM ra)), (SELECT max({c}) FROM ra))"
query("n3_apply_neighborhood", f"SELECT a.x, a.y, round(sum(b.v) / 9.0::DOUBLE, 6) AS value FROM ra a, (VALUES (-1), (0), (1)) i(dx), (VALUES (-1), (0), (1)) j(dy), ra b WHERE b.x = {_CLAMP.format(c='x', d='dx')} AND b.y = {_CLAMP.format(c='y', d='dy')} GROUP BY a.x, a.y", _RAST)(lambda s, d: udf.apply_neighborhood(_raster(s, d).select("x", "y", "v"), _box, 8, 2, "x int, y int, value double"))
query("n4_apply_polygon", "SELECT feature_index, (max(B04) - min(B04))::DOUBLE AS spread FROM pz GROUP BY ALL")(lambda s, d: udf.apply_polygon(tc.pixels(s, d, ("B04",)), tc.zones(s, d), _spread, "feature_index int, spread double"))
query("n4_apply_polygon_per_date", "SELECT feature_index, date_trunc('year', t) AS t, (max(B04) - min(B04))::DOUBLE AS spread FROM pz GROUP BY ALL")(lambda s, d: udf.apply_polygon(tc.pixels(s, d, ("B04",)).withColumn("t", F.date_trunc("year", "t")), tc.zones(s, d), _spread_by_date, "feature_index int, t timestamp, spread double", per_date=True))
# chunks of 16 pixels with 8 around: their extent, bytes between their extrema, and windows of 9 mirrored at the chunk's border
_NEAR = f"""ch AS (SELECT DISTINCT x // 16 AS i, y // 16 AS j FROM ra), ck AS (SELECT i, j, x, y, v, min(v) OVER w AS lo, max(v) OVER w AS hi, min(x) OVER w AS lox, max(x) OVER w AS hix, min(y) OVER w AS loy, max(y) OVER w AS hiy FROM ch JOIN ra ON x >= 16 * i - 8 AND x < 16 * i + 24 AND y >= 16 * j - 8 AND y < 16 * j + 24 WINDOW w AS (PARTITION BY i, j)),
im AS (SELECT *, CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo)::DOUBLE * 255) ELSE 0 END AS g FROM ck),
ne AS (SELECT a.x, a.y, dx, dy, coalesce(b.g, 0) AS v FROM im a CROSS JOIN (SELECT unnest(range(-4, 5)) AS dx) CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy) LEFT JOIN im b ON b.i = a.i AND b.j = a.j AND b.x = {_MIRRORED.format("a.x", "dx", "a.lox", "a.hix")} AND b.y = {_MIRRORED.format("a.y", "dy", "a.loy", "a.hiy")} WHERE a.x // 16 = a.i AND a.y // 16 = a.j)"""
query("n5_glcm_texture", "SELECT x, y, round(var_pop(v), 6) AS variance, round(avg((w - v) * (w - v)), 6) AS contrast FROM (SELECT *, max(v) OVER (PARTITION BY x, y, dy ORDER BY dx RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) AS w FROM ne) GROUP BY x, y", f"{_RAST}, {_NEAR}")(lambda s, d: udf.glcm_texture(_raster(s, d).select("x", "y", "v"), "v", 9, 2, 16, 8))
query("n11_whittaker")(lambda s, d: udf.whittaker(cb.mask_where(tc.pixels(s, d, ("B04", "SCL")), cb.scl_mask((3, 8, 9))).select("x", "y", "t", "B04"), 100.0))


def _weights():
    return (1.0, 2.0)


def _weighted(model, x):
    return x @ model


@query("n6_predict_forest")
def _(s: SparkSession, d: str) -> DataFrame:
    px = tc.pixels(s, d, ("B04", "B08")).withColumn("label", (F.col("B08") > F.col("B04")).cast("double"))
    model = udf.train_forest(px, ["B04", "B08"], "label", 5, 4)
    return udf.predict_forest(px.drop("label"), model, ["B04", "B08"])


query("n7_predict_batch", "SELECT x, y, t, (coalesce(CASE WHEN SCL <> 3 THEN B04 END, -1) + 2 * coalesce(CASE WHEN SCL <> 3 THEN B08 END, -1))::DOUBLE AS prediction FROM px")(lambda s, d: udf.predict_batch(cb.mask_where(tc.pixels(s, d, ("B04", "B08", "SCL")), F.col("SCL") == 3), _weights, _weighted, ["B04", "B08"], -1))
query("n8_ensemble_of_all_scenes", "SELECT x, y, median(v) AS prediction FROM (SELECT x, y, unnest([max(v), max(v), avg(v)]) AS v FROM (SELECT x, y, date_trunc('year', t) AS t, max(B04)::DOUBLE AS v FROM px GROUP BY ALL) GROUP BY x, y) GROUP BY x, y")(
    lambda s, d: udf.ensemble_median(tc.pixels(s, d, ("B04",)).withColumn("t", F.date_trunc("year", "t")).groupBy("x", "y", "t").agg(F.max("B04").cast("double").alias("v")), "v", [_first_max, _first_max, _first_mean], 2, 1000, 16, 4)
)
_DRAWN = """yv AS (SELECT x, y, date_trunc('year', t)::TIMESTAMP AS t, max(B04)::DOUBLE AS v FROM px GROUP BY ALL), tl AS (SELECT DISTINCT i, j, t FROM yv, (SELECT unnest(range(-1, 4)) AS i), (SELECT unnest(range(-1, 4)) AS j) WHERE x >= 16 * i - 4 AND x < 16 * i + 20 AND y >= 16 * j - 4 AND y < 16 * j + 20),
pk AS (SELECT * FROM tl, (SELECT unnest(range(4)) AS seed) QUALIFY row_number() OVER (PARTITION BY i, j, seed ORDER BY md5(seed || '|' || epoch_us(t)), t) <= 3),
dm AS (SELECT g.x, g.y, seed, max(coalesce(v, 0)) AS a, avg(coalesce(v, 0)) AS b FROM (SELECT DISTINCT x, y FROM yv) g JOIN pk ON i = g.x // 16 AND j = g.y // 16 LEFT JOIN yv ON yv.x = g.x AND yv.y = g.y AND yv.t = pk.t GROUP BY g.x, g.y, seed)"""
query("n8_ensemble_median", "SELECT x, y, round(median(u), 6) AS prediction FROM (SELECT x, y, unnest([a, b]) AS u FROM dm) GROUP BY x, y", _DRAWN)(lambda s, d: udf.ensemble_median(tc.pixels(s, d, ("B04",)).withColumn("t", F.date_trunc("year", "t")).groupBy("x", "y", "t").agg(F.max("B04").cast("double").alias("v")), "v", [_first_max, _first_mean], 4, 3, 16, 4))


def _outside(rows, context):
    """Pixels of the window, those outside, and the sum of those inside."""
    out = rows["B04"] == context["mask_value"]
    return rows[["feature_index", "t"]].head(1).assign(pixels=len(rows), outside=int(out.sum()), total=float(rows["B04"][~out].sum()))


query("n4_apply_polygon_masked", "SELECT feature_index, t, 40::BIGINT AS pixels, 40 - inside AS outside, coalesce(total, 0) AS total FROM (SELECT n_nationkey::INT AS feature_index, count(*) AS inside FROM nation, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(5)) AS j) WHERE (i + 0.5) / 8 + (j + 0.5) / 5 < 1 GROUP BY ALL) JOIN (SELECT feature_index, date_trunc('year', t)::TIMESTAMP AS t, sum(B04)::DOUBLE AS total FROM (SELECT feature_index, x, y, date_trunc('year', t) AS t, max(B04) AS B04 FROM pz JOIN zn USING (feature_index) WHERE (x - w + 0.5) / 8 + (y - s + 0.5) / 5 < 1 GROUP BY ALL) GROUP BY ALL) USING (feature_index)")(
    lambda s, d: udf.apply_polygon(tc.pixels(s, d, ("B04",)).withColumn("t", F.date_trunc("year", "t")).groupBy("x", "y", "t").agg(F.max("B04").alias("B04")), tc.triangles(s, d), _outside, "feature_index int, t timestamp, pixels long, outside long, total double", per_date=True, mask_value=-9999.0, context={"mask_value": -9999.0})
)


def _first_max(stack):
    return stack.max(0)


def _first_mean(stack):
    return stack.mean(0)
