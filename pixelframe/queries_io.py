"""Queries of sources, sinks and the catalogue: what they read is derived from the driver's tables by Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as cat
from .operators import metrics as mt
from .plans import pipelines as pl
from .queries import query
from .sources import io
from .sources import testcube as tc


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir, or in tests a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/pixelframe-{uuid.uuid4().hex}"


# --- 2.1 sources and sinks ------------------------------------------------------------------------------------


@query("a1_load_collection", "SELECT x, y, t, B04, B08 FROM px JOIN sc USING (t) WHERE x BETWEEN 2 AND 20 AND y BETWEEN 3 AND 12 AND t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1998-01-01' AND cloud_cover <= 50")
def _(s: SparkSession, d: str) -> DataFrame:
    io.write_cube(tc.pixels(s, d, ("B04", "B08", "SCL")), path := scratch(s), 16)
    return io.load_collection(s, path, ["B04", "B08"], (2, 3, 20, 12), ("1996-01-01", "1998-01-01"), tc.scenes(s, d), F.col("cloud_cover") <= 50)


@query("a2_load_items", "SELECT 'i' || o_orderkey AS item, o_orderdate::TIMESTAMP AS t, (o_orderkey % 100)::DOUBLE AS cloud_cover, unnest(['r', 'n']) AS asset, 's3://b/' || o_orderkey || unnest(['/r', '/n']) AS href, unnest(['B04', 'B08']) AS band FROM orders WHERE o_orderkey % 100 <= 40 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def _(s: SparkSession, d: str) -> DataFrame:
    asset = lambda k, b: f"named_struct('href', concat('s3://b/', o_orderkey, '/{k}'), 'eo:bands', array(named_struct('name', '{b}')))"
    s.read.parquet(f"{d}/orders.parquet").select(F.expr("concat('i', o_orderkey)").alias("id"), F.expr("named_struct('datetime', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), 'eo:cloud_cover', cast(o_orderkey % 100 as double))").alias("properties"), F.expr(f"map('r', {asset('r', 'B04')}, 'n', {asset('n', 'B08')})").alias("assets")).write.json(path := scratch(s))
    return io.load_items(s, path, ["B04", "B08"], ("1996-01-01", "1997-01-01"), 40, multi_line=False)


@query("a3_load_geojson", "SELECT feature_index, 1 AS rings, 5 AS points, w::DOUBLE AS west, s::DOUBLE AS south FROM zn")
def _(s: SparkSession, d: str) -> DataFrame:
    ring = F.transform(F.get("geom", F.lit(0)), lambda p: F.array(p["x"], p["y"]))
    closed = F.array(F.concat(ring, F.array(F.get(ring, F.lit(0)))))
    feature = F.struct(F.col("feature_index"), F.struct(F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates")).alias("geometry"), F.struct(F.col("feature_index").cast("string").alias("name")).alias("properties")).alias("f"))
    whole = tc.zones(s, d).agg(F.sort_array(F.collect_list(feature)).alias("_l")).select(F.lit("FeatureCollection").alias("type"), F.transform("_l", lambda v: v["f"]).alias("features"))
    whole.write.json(path := scratch(s))
    return io.load_geojson(s, path).select("feature_index", F.size("geom").alias("rings"), F.size(F.get("geom", F.lit(0))).alias("points"), F.col("geom")[0][0]["x"].alias("west"), F.col("geom")[0][0]["y"].alias("south"))


def _history(s: SparkSession, d: str) -> DataFrame:
    runs = tc.runs(s, d).withColumn(io.MONTH, F.date_format(F.timestamp_seconds(mt.c("test:start")), "yyyy-MM"))
    return runs.withColumn("usage:cpu:cpu-seconds", F.col("event_id").cast("double")).drop("event_id")


@query("a4_read_metrics_history", "SELECT node, round(costs, 6) AS costs, event_id::DOUBLE AS cpu FROM rn WHERE outcome = 'passed'")
def _(s: SparkSession, d: str) -> DataFrame:
    io.write_metrics(_history(s, d), path := scratch(s), "YYYYMM")
    return io.read_metrics_history(s, path).select(mt.c("test:nodeid").alias("node"), "costs", mt.c("usage:cpu:cpu-seconds").alias("cpu"))


@query("a4_missing_metric", "SELECT node, costs AS no_such FROM rn WHERE FALSE")
def _(s: SparkSession, d: str) -> DataFrame:
    io.write_metrics(_history(s, d), path := scratch(s))
    return io.read_metrics_history(s, path, ["no_such"]).select(mt.c("test:nodeid").alias("node"), "no_such")


@query("a5_positional_partitions", "SELECT event_id, '2023-' || CASE WHEN event_id % 2 = 0 THEN '10' ELSE '11' END AS month FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    path, e = scratch(s), s.read.parquet(f"{d}/events.parquet").select("event_id")
    for k, month in enumerate(("2023-10", "2023-11")):
        e.where(f"event_id % 2 = {k}").write.parquet(f"{path}/{month}")
    return io.read_positional_partitions(s, path, "month")


@query("a6_read_with_schema", "SELECT event_id, round(value, 6) AS value, NULL::VARCHAR AS other FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/events.parquet").write.parquet(path := scratch(s))
    return io.read_with_schema(s, path, "event_id bigint, value double, other string")


@query("a7_merge_metrics", "SELECT strftime(to_timestamp(start::BIGINT) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n, round(sum(costs), 4) AS costs FROM rn GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    io.write_metrics(_history(s, d), a := scratch(s), "simple")
    io.merge_metrics(s, a, b := scratch(s))
    return s.read.parquet(b).groupBy(mt.c(io.MONTH).alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("costs"), 4).alias("costs"))


@query("a8_write_metrics", "SELECT outcome, 2 * count(*) AS n FROM rn GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    for mode in ("false", "simple"):
        io.write_metrics(_history(s, d), path, mode)
    return s.read.parquet(path).groupBy(mt.c("test:outcome").alias("outcome")).agg(F.count("*").alias("n"))


@query("a9_run_report", "SELECT node AS nodeid, outcome, round(start, 3) AS start, costs::VARCHAR AS costs FROM rn")
def _(s: SparkSession, d: str) -> DataFrame:
    r = tc.runs(s, d)
    rows = r.select(mt.c("test:nodeid").alias("nodeid"), mt.c("test:outcome").alias("outcome"), F.lit(1.0).alias("duration"), mt.c("test:start").alias("start"), (mt.c("test:start") + 1).alias("stop"), F.create_map(F.lit("costs"), F.col("costs").cast("string")).alias("metrics"))
    io.write_run_report(rows, path := scratch(s))
    back = io.read_run_report(s, path, multi_line=False)
    return back.select("nodeid", "outcome", F.round("start", 3).alias("start"), F.col("metrics.costs").alias("costs"))


def _records(s: SparkSession, d: str) -> DataFrame:
    """Records of all suppliers, some with faults by their key."""
    k = "s_suppkey"
    link = lambda rel, href: f"named_struct('rel', '{rel}', 'type', '{cat.PROCESS_LINK if rel == 'application' else 'x'}', 'title', 'x', 'href', {href})"
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr(
        f"concat('alg', {k}) AS id", f"if({k} % 11 = 0, 'Thing', 'Feature') AS type",
        f"if({k} % 7 = 0, array('p'), array('https://www.opengis.net/spec/ogcapi-records-1/1.0/req/record-core', 'https://profiles.example/udp')) AS conformsTo",
        f"named_struct('type', if({k} % 5 = 0, 'platform', 'service'), 'title', s_name, 'description', if({k} % 13 = 0, '', 'text'), 'visibility', if({k} % 4 = 0, 'private', null), 'cost_estimate', s_acctbal, 'cost_unit', 'credits', "
        f"'keywords', array('a', 'b'), 'created', '2024', 'updated', '2024', 'formats', array(named_struct('name', 'CSV')), "
        f"'contacts', if({k} % 3 = 0, null, array(named_struct('name', 'n', 'organization', concat('org', {k} % 4), 'roles', array('principal investigator'), 'links', cast(null as array<struct<rel string, type string, title string, href string>>))))) AS properties",
        f"if({k} % 2 = 0, null, 'MIT') AS license", f"array({link('application', f'''concat('https://x.example/', {k})''')}, {link('service', f'''if({k} % 9 = 0, 'http://s.example', 'https://s.example')''')}, {link('license', '''concat('https://l.example/', s_suppkey)''')}) AS links",
        f"concat('/c/org', {k} % 4, '/alg', {k}, '/records/', if({k} % 6 = 0, 'other', concat('alg', {k})), '.json') AS path", k,
    )


@query("a10_read_records", "SELECT 'alg' || s_suppkey AS id, s_name AS title, 3 AS links FROM supplier")
def _(s: SparkSession, d: str) -> DataFrame:
    _records(s, d).drop("path", "s_suppkey").write.json(path := scratch(s))
    back = io.read_records(s, path, multi_line=False)
    return back.select("id", F.col("properties.title").alias("title"), F.size("links").alias("links"))


def _scenarios(s: SparkSession, d: str) -> DataFrame:
    k = "p_partkey"
    return s.read.parquet(f"{d}/part.parquet").selectExpr(
        f"if({k} % 8 = 0, concat('bad id ', {k}), concat('s', {k})) AS id", f"if({k} % 25 = 0, 'other', if({k} % 5 = 0, 'ogc_api_process', 'openeo')) AS type", "'d' AS description",
        f"if({k} % 7 = 0, 'nowhere.example', 'https://back.example/v1') AS backend", f"if({k} % 10 = 0, 'ftp://x', 'https://e.example') AS endpoint", f"if({k} % 15 = 0, null, 'app') AS application", "cast(null as string) AS namespace", f"if({k} % 20 = 0, null, map('a', '1')) AS parameters",
        f"if({k} % 9 = 0, map(), map('n', named_struct('process_id', if({k} % 11 = 0, 'bad id', 'good-id'), 'namespace', if({k} % 6 = 0, if({k} % 4 = 0, 'https://GitHub.com/a/b/blob/x', 'https://raw.githubusercontent.com/a/b/refs/heads/dev/x'), if({k} % 4 = 0, 'https://n.example', 'a name')), 'arguments', if({k} % 13 = 0, null, '{{}}')))) AS process_graph",
        "cast(null as map<string, string>) AS reference_data", "cast(null as struct<rtol double, atol double, pixel_tolerance double>) AS reference_options", f"concat('/c/org/alg', {k} % 50, '/benchmark_scenarios/s', {k}, '.json') AS path", k,
    )


@query("a11_read_scenarios", "SELECT CASE WHEN p_partkey % 8 = 0 THEN 'bad id ' || p_partkey ELSE 's' || p_partkey END AS id, CASE WHEN p_partkey % 25 = 0 THEN 'other' WHEN p_partkey % 5 = 0 THEN 'ogc_api_process' ELSE 'openeo' END AS type FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    root = scratch(s)
    _scenarios(s, d).select("id", "type", "backend").write.json(f"{root}/org/benchmark_scenarios")
    return io.read_scenarios(s, root, multi_line=False).select("id", "type")


@query("a12_save_result_csv", "SELECT feature_index, round(avg(B04), 3) AS mean FROM pz GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    from .operators.zones import aggregate_spatial

    stats = aggregate_spatial(tc.pixels(s, d, ("B04",)).select("x", "y", "B04"), tc.zones(s, d)).select("feature_index", F.round("B04", 3).alias("mean"))
    io.save_result(stats, path := scratch(s), "csv")
    return s.read.option("header", True).schema("feature_index int, mean double").csv(path)


@query("a12_save_result_json", "SELECT event_id, round(value, 6) AS value, event_type FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    io.save_result(s.read.parquet(f"{d}/events.parquet").select("event_id", F.round("value", 6).alias("value"), "event_type"), path := scratch(s), "json")
    return s.read.schema("event_id long, value double, event_type string").json(path)


@query("a12_save_result_geojson", "SELECT event_id, 'Feature' AS kind, 'Polygon' AS shape, round((user_id % 10)::DOUBLE, 3) AS west, round(value, 6) AS value FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    at = lambda x, y: f"struct(user_id % 10 + {x}D AS x, {y}D AS y)"
    rows = s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "round(value, 6) AS value", f"array(array({at(0, 0)}, {at(1, 0)}, {at(1, 1)}, {at(0, 0)})) AS geom")
    io.save_result(rows, path := scratch(s), "geojson")
    back = s.read.schema("type string, geometry struct<type string, coordinates array<array<array<double>>>>, properties struct<event_id long, value double>").json(path)
    return back.select("properties.event_id", F.col("type").alias("kind"), F.col("geometry.type").alias("shape"), F.col("geometry.coordinates")[0][0][0].alias("west"), "properties.value")


@query("a12_save_result_multipolygon", "SELECT n_nationkey::INT AS feature_index, n_nationkey % 2 AS parted, CASE WHEN n_nationkey % 2 = 1 THEN 3 ELSE 1 END AS rings, CASE WHEN n_nationkey % 2 = 1 THEN 2 ELSE 1 END AS parts FROM nation")
def _(s: SparkSession, d: str) -> DataFrame:
    """Two islands, one with a lake, or one island: written, read again, written and read."""
    at = lambda *xy: ", ".join(f"array({x}D, {y}D)" for x, y in xy)
    box = lambda a, b: f"array({at((a, a), (b, a), (b, b), (a, b), (a, a))})"
    islands = f"if(n_nationkey % 2 = 1, array(array({box(0, 9)}, {box(2, 4)}), array({box(20, 30)})), array(array({box(0, 9)})))"
    made = s.read.parquet(f"{d}/nation.parquet").selectExpr("'Feature' AS type", f"named_struct('type', 'MultiPolygon', 'coordinates', {islands}) AS geometry", "named_struct('key', n_nationkey) AS properties")
    made.write.json(path := scratch(s))
    first = io.load_geojson(s, path, multi_line=False).selectExpr("cast(props['key'] AS int) AS feature_index", "geom", "parts")
    io.save_result(first, again := scratch(s), "geojson")
    back = io.load_geojson(s, again, multi_line=False)
    return back.select(F.expr("cast(props['feature_index'] AS int)").alias("feature_index"), F.expr("cast(props['feature_index'] AS int) % 2").alias("parted"), F.size("geom").alias("rings"), F.size(F.array_distinct("parts")).alias("parts"))


@query("a12_save_result_parquet", "SELECT x, y, max(B04) AS B04, 0.0001::DOUBLE AS scale FROM px GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    io.save_result(tc.pixels(s, d, ("B04",)).groupBy("x", "y").agg(F.max("B04").alias("B04")), path := scratch(s), "parquet", {"B04": {"scale": 0.0001, "nodata": -9999}})
    back = s.read.parquet(path)
    return back.withColumn("scale", F.lit(back.schema["B04"].metadata["scale"]))


@query("a13_read_job_log", "SELECT o_orderkey::VARCHAR AS id, round(o_totalprice, 6) AS cost, 1.0::DOUBLE AS west, 2.0::DOUBLE AS south, 3.5::DOUBLE AS east, (o_orderkey % 9)::DOUBLE AS north, DATE '2024-01-01' AS start, DATE '2024-03-01' AS \"end\" FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet").selectExpr("cast(o_orderkey as string) AS id", "o_totalprice AS cost", "concat(\"{'west': 1.0, 'south': 2.0, 'east': 3.5, 'north': \", o_orderkey % 9, '}') AS bbox", "\"['2024-01-01', '2024-03-01']\" AS temporal_extent")
    o.write.option("header", True).option("quote", '"').option("escape", '"').csv(path := scratch(s))
    return io.read_job_log(s, path)


# --- joins and rules of the catalogue --------------------------------------------------------------------------------

_K = "s_suppkey"


@query("d11_attach_contacts", "SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN 'org' || (s_suppkey % 4) END AS organization FROM supplier")
def _(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    scenarios = r.select(F.expr("concat('s', s_suppkey)").alias("id"), F.regexp_replace("path", "/records/.*$", "/benchmark_scenarios/a.json").alias("path"))
    return cat.attach_contacts(scenarios, r).select("id", F.col("contacts")[0]["organization"].alias("organization"))


@query("d12_attach_failure_logs", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'log of ' || user_id END AS log FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    logs = e.select("user_id").distinct().where("user_id % 3 = 0").select(F.expr("concat('test_', user_id)").alias("section"), F.expr("concat('log of ', user_id)").alias("body"))
    return cat.attach_failure_logs(e.select("event_id", F.expr("concat('a/b.py::test_', user_id)").alias("nodeid")), logs).select("event_id", "log")


@query("d13_triage", "SELECT scenario_id, outcome, number, CASE WHEN number IS NOT NULL THEN 'comment' WHEN outcome = 'failed' THEN 'create' ELSE 'none' END AS action FROM (SELECT DISTINCT scenario_id, outcome FROM rn WHERE scenario_id NOT LIKE '%-3') LEFT JOIN (SELECT DISTINCT scenario_id, 1 AS number FROM rn WHERE scenario_id LIKE '%-5') USING (scenario_id)")
def _(s: SparkSession, d: str) -> DataFrame:
    r = mt.with_scenario(tc.runs(s, d)).select("scenario_id", mt.c("test:outcome").alias("outcome")).distinct()
    names = r.select("scenario_id").distinct()
    issues = names.where("scenario_id LIKE '%-5'").select(F.expr("concat('Scenario ', scenario_id, ' failed')").alias("title"), F.lit(1).alias("number"))
    return cat.triage(r, names.where("scenario_id NOT LIKE '%-3'").select(F.col("scenario_id").alias("id")), issues)


@query("d14_job_grid", "SELECT 'n' || n_nationkey AS name, n_nationkey::DOUBLE AS west, m AS months, DATE '2024-01-31' AS start, (DATE '2024-01-31' + to_months(m))::DATE AS \"end\" FROM nation, (VALUES (1), (3)) v(m)")
def _(s: SparkSession, d: str) -> DataFrame:
    boxes = s.read.parquet(f"{d}/nation.parquet").selectExpr("concat('n', n_nationkey) AS name", "cast(n_nationkey AS double) AS west", "0D AS south", "n_nationkey + 1D AS east", "1D AS north")
    return mt.job_grid(boxes, [1, 3], "2024-01-31").select("name", "west", "months", "start", "end")


@query("d15_provider_coverage", "SELECT 'org' || n_nationkey AS provider FROM nation WHERE n_nationkey % 3 > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    n = s.read.parquet(f"{d}/nation.parquet")
    return cat.provider_coverage(n.select(F.expr("concat('org', n_nationkey)").alias("provider")), n.where("n_nationkey % 3 = 0").select(F.expr("concat('/c/org', n_nationkey, '/record.json')").alias("path")))


@query("m21_list_algorithms", f"SELECT 'org' || ({_K} % 4) AS organisation, 'alg' || {_K} AS algorithm FROM supplier")
def _(s: SparkSession, d: str) -> DataFrame:
    return cat.list_algorithms(_records(s, d))


@query("m22_get_algorithm", f"""SELECT 'alg' || {_K} AS name, CASE WHEN {_K} % 10 = 0 OR {_K} % 6 = 0 THEN NULL ELSE s_name END AS title, CASE WHEN {_K} % 10 = 0 OR {_K} % 6 = 0 THEN NULL ELSE 'https://x.example/' || {_K} END AS udp_href,
CASE WHEN {_K} % 2 = 1 THEN 'MIT' END AS license, CASE WHEN {_K} % 3 > 0 AND {_K} % 10 > 0 THEN 'org' || ({_K} % 4) END AS organization,
CASE WHEN {_K} % 10 = 0 THEN 'not an algorithm of exactly one organisation' WHEN {_K} % 6 = 0 THEN 'no record' WHEN {_K} % 11 = 0 THEN 'not a GeoJSON feature' WHEN {_K} % 7 = 0 THEN 'does not conform to the record core' WHEN {_K} % 5 = 0 THEN 'not a service' END AS error FROM supplier
UNION ALL SELECT 'missing', NULL, NULL, NULL, NULL, 'not an algorithm of exactly one organisation'""")
def _(s: SparkSession, d: str) -> DataFrame:
    """All names of the table and one that isn't there; every tenth algorithm is that of a second organisation too, and its own record is gone."""
    r = _records(s, d)
    again = r.where(f"{_K} % 10 = 0").select(F.expr(f"concat('/c/other/alg', {_K}, '/records/readme.json')").alias("path"))
    own = r.withColumn("path", F.when(F.col(_K) % 10 == 0, F.regexp_replace("path", "[^/]*$", "gone.json")).otherwise(F.col("path")))
    names = r.select(F.col("id").alias("name")).union(s.createDataFrame([("missing",)], "name string"))
    return cat.get_algorithms(own.unionByName(again, allowMissingColumns=True), names).select("name", "title", "udp_href", "license", "organization", "error")


_SERVICE = f"{_K} % 5 > 0"
_RULES = "UNION ALL ".join(f"SELECT 'alg' || {_K} AS id, '{n}' AS rule FROM supplier WHERE {w} " for n, w in (("type", f"{_K} % 11 = 0"), ("conforms to core", f"{_K} % 7 = 0"), ("description", f"{_K} % 13 = 0"), ("https", f"{_K} % 9 = 0"), ("id is the file''s name", f"{_K} % 6 = 0"), ("platform place", f"{_SERVICE} AND {_K} % 8 = 0"), ("platform link", f"{_SERVICE} AND {_K} % 17 = 0 AND {_K} % 8 > 0"), ("provider link", f"{_SERVICE} AND {_K} % 19 = 0"), ("link fields", f"{_SERVICE} AND {_K} % 23 = 0"), ("notebook type", f"{_K} % 29 = 0")))


@query("m23_lint_records", _RULES)
def _(s: SparkSession, d: str) -> DataFrame:
    """Beside the records' faults: a platform elsewhere, none, no provider, a link without title, a notebook of another type."""
    link = lambda rel, href, kind="'x'", title="'x'": f"named_struct('rel', '{rel}', 'type', {kind}, 'title', {title}, 'href', {href})"
    more = [
        link("platform", f"if({_K} % 8 = 0, 'https://p.example/a.json', '../../../../platform_catalog/a.json')").replace("'rel', 'platform'", f"'rel', if({_K} % 17 = 0 AND {_K} % 8 > 0, 'about', 'platform')"),
        link("provider", "'../../record.json'").replace("'rel', 'provider'", f"'rel', if({_K} % 19 = 0, 'about', 'provider')"),
        link("thumbnail", "'./thumbnail.png'", title=f"if({_K} % 23 = 0, null, 'x')"),
        link("notebook", "'https://n.example/n.ipynb'", kind=f"if({_K} % 29 = 0, 'text/html', '{cat.NOTEBOOK}')"),
    ]
    return cat.lint_records(_records(s, d).withColumn("links", F.expr(f"concat(links, array({', '.join(more)}))")))


_P, _OE = "p_partkey", "p_partkey % 5 > 0"
_SID = f"CASE WHEN {_P} % 8 = 0 THEN 'bad id ' || {_P} ELSE 's' || {_P} END"
_RULES2 = "UNION ALL ".join(f"SELECT {_SID} AS id, '{n}' AS rule FROM part WHERE {w} " for n, w in (("id", f"{_P} % 8 = 0"), ("backend", f"{_OE} AND {_P} % 7 = 0"), ("process graph", f"{_OE} AND {_P} % 9 = 0"), ("type", f"{_P} % 25 = 0"), ("process id", f"{_OE} AND {_P} % 9 > 0 AND {_P} % 11 = 0"), ("arguments", f"{_OE} AND {_P} % 9 > 0 AND {_P} % 13 = 0"), ("namespace", f"{_OE} AND {_P} % 9 > 0 AND {_P} % 6 = 0"), ("endpoint", f"{_P} % 10 = 0 AND {_P} % 25 > 0"), ("application", f"{_P} % 15 = 0 AND {_P} % 25 > 0"), ("parameters", f"{_P} % 20 = 0 AND {_P} % 25 > 0")))
query("m24_lint_scenarios", _RULES2)(lambda s, d: cat.lint_scenarios(_scenarios(s, d), [r"(https://)?back\.example(/.*)?"]))
_HREF = ("https://github.com/a/b/blob/topic", "https://raw.githubusercontent.com/a/b/refs/heads/dev/", "https://raw.githubusercontent.com/a/b/dev/", "https://raw.githubusercontent.com/c/d/dev/", "https://raw.githubusercontent.com/a/b/0a1b2c/", "https://raw.githubusercontent.com/a/b/refs/heads/main/")
query("m25_lint_links", " UNION ALL ".join(f"SELECT '{_HREF[k]}' || user_id || '/f' AS href, '{rule}' AS rule FROM events WHERE event_id % 6 = {k}" for k, rule in ((0, "no file page"), (1, "no feature branch"), (2, "no feature branch"))))(
    lambda s, d: cat.lint_links(s.read.parquet(f"{d}/events.parquet").select(F.concat(F.element_at(F.array(*map(F.lit, _HREF)), (F.col("event_id") % 6 + 1).cast("int")), F.col("user_id").cast("string"), F.lit("/f")).alias("href")), own=["a/b"])
)


@query("m26_lint_process_defs", "SELECT 'p' || p_partkey AS id, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['parameters', 'parameter name', 'parameter description', 'parameter schema'] WHEN p_partkey % 5 = 0 THEN ['parameter schema'] ELSE []::VARCHAR[] END) AS rule FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    defs = s.read.parquet(f"{d}/part.parquet").selectExpr("concat('p', p_partkey) AS id", "'d' AS description", "if(p_partkey % 3 = 0, null, array(named_struct('name', 'a', 'description', 'b', 'schema', if(p_partkey % 5 = 0, '{}', '{\"type\": \"number\"}')))) AS parameters", "'{}' AS process_graph", "concat('/c/p', p_partkey, '.json') AS path")
    return cat.lint_process_defs(defs)


@query("m27_catalogue_cards", f"SELECT 'alg' || {_K} AS id, s_name AS title, 'a, b' AS keywords, CASE WHEN {_K} % 7 = 0 THEN 'p' ELSE 'https://profiles.example/udp' END AS profile, 'https://l.example/' || {_K} AS license, round(s_acctbal, 6) AS cost_estimate, 'CSV' AS formats FROM supplier WHERE {_K} % 4 > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return cat.catalogue_cards(_records(s, d)).select("id", "title", "keywords", "profile", "license", "cost_estimate", "formats")


@query("m28_issue_labels", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'benchmark,benchmark-phase:' || event_type ELSE 'benchmark' END AS labels FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("failed_phase"))
    return cat.issue_labels(r).select("event_id", F.array_join("labels", ",").alias("labels"))


@query("f9_report_files", "SELECT event_id // 5000 AS file, 'test_' || (event_id // 50) AS section, string_agg(event_type, chr(10) ORDER BY event_id) AS body FROM events WHERE event_id % 50 BETWEEN 12 AND 29 GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    """Reports of 5000 lines as text files, each of many parts, read back line by line."""
    line = "CASE event_id % 50 WHEN 10 THEN '==== FAILURES ====' WHEN 11 THEN concat('____ test_', event_id div 50, ' ____') WHEN 30 THEN '==== summary ====' ELSE event_type END"
    reports = s.read.parquet(f"{d}/events.parquet").select(F.expr("event_id div 5000").alias("file"), "event_id", F.expr(line).alias("text"))
    reports.repartition("file").sortWithinPartitions("file", "event_id").select("file", "text").write.partitionBy("file").text(path := scratch(s))
    found = mt.failure_sections(io.read_report_lines(s, path))
    return found.withColumn("file", F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long"))


@query("e12_markers_appended", "SELECT feature_index, t, round(avg(B04), 6) AS B04_mean, round(stddev_samp(B04), 6) AS B04_sd, count(B04) AS B04_count FROM pz GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    """Three deliveries of pixels that share parcels and dates, one of them sent twice."""
    px, zones, path = tc.pixels(s, d, ("B04",)), tc.zones(s, d), scratch(s)
    for name, part in (("west", "x < 13"), ("south", "x >= 13 AND y < 12"), ("west", "x < 13"), ("north", "x >= 13 AND y >= 12")):
        pl.append_markers(px.where(part), zones, path, name)
    found = pl.read_markers(s, path)
    return found.withColumns({n: F.round(n, 6) for n in ("B04_mean", "B04_sd")})
