"""Literal cases of baselines, limits, histories, reports and metadata."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pixelframe.functions import scalar as sc
from pixelframe.operators import catalog as cat
from pixelframe.operators import metrics as mt
from pixelframe.plans import pipelines as pl
from pixelframe.sources import io


def runs(spark, rows):
    return spark.createDataFrame(rows, "scenario_id string, `test:nodeid` string, `test:start` double, costs double").withColumn("_timestamp", F.col("`test:start`"))


def test_mad_threshold(spark):
    row = mt.mad_threshold(spark.createDataFrame([("s", 10.0)] * 3, "scenario_id string, costs double"), ["scenario_id"], "costs").first()
    assert (row.n, row.margin, row.upper_limit, row.lower_limit) == (3, 2.0, 12.0, 8.0)


def test_baseline_skips_nan(spark):
    df = runs(spark, [("s", f"n{i}", float(i), v) for i, v in enumerate((1.0, 2.0, math.nan, 3.0, 4.0))])
    row = mt.compute_baselines(df, "costs", 3, 3).first()
    assert (row["n"], row["median"]) == (3, 3.0)


@pytest.mark.parametrize(("lower", "upper", "actual", "message"), [
    (0.0, 10.0, 12.0, "[s1] regression in 'costs': actual=12.0 exceeds upper_limit=10.0"),
    (5.0, 10.0, 4.0, "[s1] regression in 'costs': actual=4.0 below lower_limit=5.0"),
    (5.0, 10.0, 8.0, None), (5.0, 10.0, math.nan, None), (5.0, 10.0, None, None),
])
def test_check_limits(spark, lower, upper, actual, message):
    latest = spark.createDataFrame([("s1", actual)], "scenario_id string, costs double")
    limits = spark.createDataFrame([("s1", lower, upper)], "scenario_id string, lower_limit double, upper_limit double")
    assert mt.check_limits(latest, limits).first().violation == message


def test_regression_states(spark):
    rows = [("few", f"t[{i}]", float(i), 1.0) for i in range(2)] + [("none", f"t[{i}]", float(i), None if i < 3 else 1.0) for i in range(4)]
    rows += [("low", f"t[{i}]", float(i), 50.0 if i < 4 else 1.0) for i in range(5)]
    out = {r.scenario_id: (r.status, r.message) for r in mt.performance_regressions(runs(spark, rows), 10.0).collect()}
    assert out["few"] == ("insufficient", "insufficient history (2 runs)")
    assert out["none"] == ("no baseline", "no costs baseline")
    assert out["low"] == ("regression", "[low] regression in 'costs': actual=1.0 below lower_limit=48.0")


def test_scenario_ids(spark):
    df = spark.createDataFrame([("a.py::t[x-1]",), ("a.py::t",), ("plain",), ("a::b[c]d",)], "n string")
    assert [r[0] for r in df.select(sc.scenario_id("n")).collect()] == ["x-1", "t", "plain", "b[c]d"]


def test_number_format(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (0.12345,), (None,), (math.nan,)], "v double")
    assert [r[0] for r in df.select(sc.format_number("v")).collect()] == ["1.5", "2", "0.1235", "n/a", "n/a"]


def test_decimals_round_by_the_exact_value(spark):
    values = [15005.55, 25009.25, 25009.75, 0.05, 0.25, 0.35, -0.25, -0.05, 0.0, 1e12 + 0.25, 1e300, *((p * 1000.37 + p % 2 * 512) / 1024 for p in range(0, 120000, 512))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sc.fixed("v", 1).alias("a"), sc.fixed(F.col("v") / 1000, 4).alias("b")).collect()
    got = [r for r in got if r.v < 1e15]  # beyond 2**53 format_string pads with zeros
    assert [(r.a, r.b) for r in got] == [(f"{r.v:.1f}", f"{r.v / 1000:.4f}") for r in got]
    empty = spark.createDataFrame([(None,), (math.inf,)], "v double").select(sc.fixed("v", 1)).collect()
    assert [r[0] for r in empty] == [None, "Infinity"]
    sizes = spark.createDataFrame([("a", 15005.55 * 1024)], "file string, size double")
    assert mt.compare_files(sizes, sizes).first().kb == "15005.5"


def test_metadata(spark):
    schema = "job_id string, cost double, usage array<struct<name string, unit string, value double>>, assets map<string, struct<`proj:shape` array<int>, `proj:epsg` int, `proj:bbox` array<double>>>"
    jobs = spark.createDataFrame([("j", 42.0, [("cpu", "cpu-seconds", 123.0), ("memory", "mb-seconds", 345.0), ("x", None, 1.0)], {"a": ([1200, 800], 32631, [500000.0, 5645000.0, 508000.0, 5657000.0])})], schema)
    assert {r.name: r.value for r in mt.usage_metrics(jobs).collect()} == {"costs": 42.0, "usage:cpu:cpu-seconds": 123.0, "usage:memory:mb-seconds": 345.0}
    row = mt.asset_areas(jobs).first()
    assert (row.megapixel, row.km2) == (0.96, 96.0)


def test_link_changes(spark):
    a, e = (spark.createDataFrame([("derived_from", h), ("self", "s")], "rel string, href string") for h in ("V1", "V2"))
    assert sorted((r.href, r.kind) for r in mt.diff_links(a, e).collect()) == [("V1", "derived_from-change"), ("V2", "derived_from-change")]


def test_duplicate_metric_fails(spark):
    rows = spark.createDataFrame([("n", "costs", 1.0), ("n", "costs", 2.0)], "node string, name string, value double")
    with pytest.raises(Exception, match="duplicate metric"):
        mt.pivot_metrics(rows, ["costs"], "node").collect()


def test_failure_sections(spark):
    text = ["==== start ====", "x", "==== FAILURES ====", "____ test_one ____", "line 1", "_ _ _ _", "line 2", "____ test_two ____", "", "b", "==== info ====", "____ not ____", "z"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, text string")
    assert {r.section: r.body for r in mt.failure_sections(df).collect()} == {"test_one": "line 1\n_ _ _ _\nline 2", "test_two": "b"}


def test_report_files_in_splits(spark, tmp_path):
    """Numbered lines of files that several tasks read, and their sections: titles with wide marks, empty and repeated sections."""
    text = ["x", "____ early ____", "=====  FAILURES =====", "_____ \t a b _____", "one  ", "", " two", "___ no ___", "____ gone ____", "first", "____ empty ____", "____ gone ____", "last", "==== end ====", "____ not ____", "z"]
    long = ["==== FAILURES ====", "____ many ____", *(f"line {i}" for i in range(2000))]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.txt").write_text("\n".join(text) + "\n")
    (tmp_path / "long.txt").write_text("\n".join(long))
    (tmp_path / "none.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        lines = io.read_report_lines(spark, str(tmp_path))
        got = {name: [r.text for r in sorted(lines.where(F.col("file").endswith(name)).collect(), key=lambda r: r.line_no)] for name in ("r.txt", "long.txt")}
        assert got == {"r.txt": text, "long.txt": long}
        assert lines.where(F.col("file").endswith("long.txt")).agg(F.min("line_no"), F.max("line_no"), F.countDistinct("line_no")).first()[:] == (1, 2002, 2002)
        found = {r.section: r.body for r in mt.failure_sections(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {"a b": "one\n\n two\n___ no ___", "gone": "last", "empty": "", "many": "\n".join(long[2:])}


def test_markers_appended(spark, tmp_path):
    """Moments of deliveries merge to those of all pixels, far from zero too; a delivery sent again replaces itself."""
    p = lambda x, y: {"x": float(x), "y": float(y)}
    parcels = spark.createDataFrame([(0, [[p(0, 0), p(20, 0), p(20, 20), p(0, 20)]])], "feature_index int, geom array<array<struct<x double, y double>>>")
    day = datetime(2024, 5, 1)
    values = [(x, y, day, None if x == 3 else 1e8 + x * 0.5 + y) for x in range(10) for y in range(10)] + [(1, 1, datetime(2024, 5, 2), 4.0), (2, 2, datetime(2024, 5, 3), None)]
    px = spark.createDataFrame(values, "x int, y int, t timestamp, v double")
    for name, part in (("a", "x < 3"), ("b", "x BETWEEN 3 AND 6"), ("a", "x < 3"), ("c", "x > 6")):
        pl.append_markers(px.where(part), parcels, f"{tmp_path}/m", name)
    key = lambda r: r.t
    got, want = (sorted(d.collect(), key=key) for d in (pl.read_markers(spark, f"{tmp_path}/m"), pl.parcel_markers(px, parcels)))
    assert [(r.t, r.v_count) for r in got] == [(r.t, r.v_count) for r in want] and [r.v_count for r in got] == [90, 1, 0]
    for r, w in zip(got, want, strict=True):
        assert r.v_mean == (w.v_mean if w.v_mean is None else pytest.approx(w.v_mean)) and r.v_sd == (w.v_sd if w.v_sd is None else pytest.approx(w.v_sd, rel=1e-6))
    with pytest.raises(ValueError):
        pl.append_markers(px, parcels, f"{tmp_path}/m", "../x")


def test_positional_months(spark, tmp_path):
    for month, cost in (("2023-10", 1.0), ("2023-11", 2.0)):
        spark.createDataFrame([("n", cost)], "`test:nodeid` string, costs double").write.parquet(f"{tmp_path}/in/{month}")
    io.merge_metrics(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert sorted((r[0], r.costs) for r in spark.read.parquet(f"{tmp_path}/out").select(mt.c(io.MONTH), "costs").collect()) == [("2023-10", 1.0), ("2023-11", 2.0)]
    with pytest.raises(ValueError):
        io.write_metrics(spark.range(1), f"{tmp_path}/x", "weekly")


def test_a_large_month_is_divided(spark, tmp_path):
    month = F.when(F.col("id") < 100, "2023-10").otherwise("2023-11")
    spark.range(0, 40000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("test:nodeid"), month.alias(io.MONTH), F.col("id").cast("double").alias("costs")).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256KB")
    try:
        io.merge_metrics(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    back = spark.read.parquet(f"{tmp_path}/out").withColumn("file", F.input_file_name()).groupBy(mt.c(io.MONTH).alias("month")).agg(F.count("*").alias("n"), F.sum("costs").alias("costs"), F.countDistinct("file").alias("files"))
    first, second = back.orderBy("month").collect()
    assert (first.n, first.costs, first.files) == (100, 4950.0, 1)
    assert (second.n, second.costs) == (39900, 799975050.0)
    assert second.files > 2


def test_links(spark):
    raw, branch = "https://raw.githubusercontent.com", ["no feature branch"]
    cases = {
        "https://github.com/a/b/blob/main/f": ["no file page"], "https://github.com/a/b/tree/topic/f": [], f"{raw}/a/b/main/f": [], f"{raw}/a/b/topic/f": branch, f"{raw}/a/b/0123456789abcdef/f": [], f"{raw}/a/b/3b5a0/f": [],
        f"{raw}/a/b/refs/heads/main/f": [], f"{raw}/a/b/refs/heads/topic/f": branch, f"{raw}/c/d/topic/f": [], f"{raw}/c/d/refs/heads/topic/f": branch, "https://example.com/foo/bar": [],
    }
    found = cat.lint_links(spark.createDataFrame([(h,) for h in cases], "href string"), own=["a/b"]).collect()
    assert {h: [r.rule for r in found if r.href == h] for h in cases} == cases


CORE = "https://www.opengis.net/spec/ogcapi-records-1/1.0/req/record-core"


@pytest.mark.parametrize(("record", "error"), [
    ({"id": "minimal", "type": "Feature", "conformsTo": [CORE], "properties": {"type": "service"}, "links": [{"rel": "service", "href": "https://s.test/"}]}, None),
    ({"id": "wrong", "type": "other", "conformsTo": [CORE]}, "not a GeoJSON feature"),
    ({"id": "wrong", "type": "Feature", "conformsTo": ["http://nope.test/"], "properties": {"type": "service"}}, "does not conform to the record core"),
    ({"id": "wrong", "type": "Feature", "conformsTo": [CORE], "properties": {"type": "udp"}}, "not a service"),
    ({"id": "bare", "type": "Feature", "conformsTo": [CORE], "properties": {"type": "service"}}, "no service link"),
    ({"id": "media", "type": "Feature", "conformsTo": [CORE], "properties": {"type": "service"}, "links": [{"rel": "application", "type": "application/xml", "href": "https://s.test/u"}]}, "process link of another media type"),
])
def test_get_algorithm(spark, tmp_path, record, error):
    folder = tmp_path / "org" / record["id"] / "records"
    folder.mkdir(parents=True)
    (folder / f"{record['id']}.json").write_text(json.dumps(record))
    records = io.read_records(spark, str(tmp_path))
    if error is None:
        got = cat.get_algorithm(records, record["id"]).first()
        assert (got.id, got.udp_href, got.service_hrefs, got.license) == ("minimal", None, ["https://s.test/"], None)
    else:
        with pytest.raises(Exception, match=error):
            cat.get_algorithm(records, record["id"]).collect()
    with pytest.raises(Exception, match="exactly one organisation"):
        cat.get_algorithm(records, "nothing").collect()


def test_rules_accept_what_is_published(spark):
    kind = "application/json"
    links = [("service", kind, "s", "https://s.test/"), ("application", cat.PROCESS_LINK, "u", "oci://s.test/u"), ("platform", kind, "p", "../../../../platform_catalog/p.json"), ("provider", kind, "q", "../../record.json"), ("thumbnail", "image/png", "t", "./thumbnail_1.png")]
    link = lambda *x: dict(zip(("rel", "type", "title", "href"), x, strict=True))
    row = {"id": "a-b_1", "type": "Feature", "conformsTo": [CORE, "https://profile.test/udp"], "properties": {"type": "service", "title": "t", "description": "d", "created": "2024", "updated": "2024"}, "links": [link(*x) for x in links]}
    assert cat.lint_records(spark.createDataFrame([row], cat.RECORD)).count() == 0
    broken = lambda more: {r.rule for r in cat.lint_records(spark.createDataFrame([row | more], cat.RECORD)).collect()}
    for i, rel in enumerate(("service", "application", "platform", "provider")):
        assert broken({"links": row["links"][:i] + row["links"][i + 1 :]}) == {f"{rel} link"}
    wrong = [link("platform", kind, "p", "../platform_catalog/p.json"), link("provider", kind, "q", "https://q.test/record.json"), link("about", None, "a", "http://a.test"), link("notebook", "text/html", "n", "https://n.test")]
    assert broken({"links": row["links"] + wrong}) == {"platform place", "provider place", "link fields", "https", "notebook type"}
    at = lambda path: {r.rule for r in cat.lint_records(spark.createDataFrame([row], cat.RECORD).selectExpr("*", f"'{path}' AS path")).collect()}
    assert at("x/a-b_1/records/a-b_1.json") == set() and at("x/other/records/a-b_1.json") == at("x/a-b_1/a-b_1.json") == at("x/a-b_1/records/b.json") == {"id is the file's name"}
    assert {r.rule for r in cat.lint_records(spark.createDataFrame([row | {"conformsTo": [CORE]}], cat.RECORD)).collect()} == {"exactly one profile"}
    node = {"process_id": "a-process", "namespace": "backend", "arguments": "{}"}
    good = {"id": "max-ndvi_1", "type": "openeo", "backend": "https://back.test", "process_graph": {"n": node}}
    http = {"id": "h", "type": "ogc_api_process", "endpoint": "https://e.test", "application": "a", "parameters": {"a": "1"}}
    rules = lambda *rows: {(r.id, r.rule) for r in cat.lint_scenarios(spark.createDataFrame(list(rows), cat.SCENARIO), [r"(https://)?back\.test(/.*)?"]).collect()}
    assert rules(good, http) == set()
    bad = good | {"id": "bad", "process_graph": {"n": node | {"namespace": "https://raw.githubusercontent.com/a/b/refs/heads/dev/x.json"}}}
    assert rules(bad, http | {"parameters": None}, good | {"id": "k", "type": "new"}) == {("bad", "namespace"), ("h", "parameters"), ("k", "type")}


def test_triage_duplicate_scenario(spark):
    r = spark.createDataFrame([("a", "failed")], "scenario_id string, outcome string")
    s = spark.createDataFrame([("a",), ("a",)], "id string")
    i = spark.createDataFrame([], "title string, number int")
    with pytest.raises(Exception, match="duplicate scenario"):
        cat.triage(r, s, i).collect()
