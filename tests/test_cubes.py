"""Nodata rules, sparse cubes and user functions against numpy."""

import hashlib
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelframe.functions import scalar as sc
from pixelframe.operators import cube as cb
from pixelframe.operators import udf
from pixelframe.operators import windows as wn
from pixelframe.operators import zones as zn
from pixelframe.operators.blocks import box_sums, city_block, in_blocks, laid_apart, whole_tiles


def raster(spark, values, name="v"):
    rows = [(x, y, None if np.isnan(v) else float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"x int, y int, {name} double")


def grid(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[name] is None else r[name]
    return out


def test_nodata_wins(spark):
    df = spark.createDataFrame([(None, 1.0), (-1.0, 0.0), (4.0, 2.0)], "a double, b double")
    got = df.select(sc.clip("a", 0.0, 1.0).alias("c"), sc.divide("a", "b").alias("d"), sc.sqrt("a").alias("s"), sc.ln("a").alias("l"), sc.array_max(["a", "b"], False).alias("m")).collect()
    assert [tuple(r) for r in got][:2] == [(None, None, None, None, None), (0.0, None, None, None, 0.0)]


def test_choose_null_condition(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "c boolean")
    assert [r[0] for r in df.select(sc.choose(F.col("c"), F.lit(1), F.lit(2))).collect()] == [2, 1, 2]


def test_drop_dimension_guards(spark):
    df = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 2, 6)], "x int, y int, t int, v int")
    with pytest.raises(Exception, match="more than one label"):
        cb.drop_dimension(df, "t").collect()


def test_kernels_on_sparse_cubes(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, (12, 15)).astype(float)
    values[rng.random(values.shape) < 0.4] = np.nan
    df = raster(spark, values).where("v IS NOT NULL")
    padded = np.pad(np.nan_to_num(values), 2)
    want = sum(padded[i : i + 12, j : j + 15] for i in range(5) for j in range(5))
    got = grid(wn.moving_sum(df, 2), "v", values.shape)
    assert np.allclose(got[~np.isnan(values)], want[~np.isnan(values)])
    kernel = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
    p = np.pad(np.nan_to_num(values), 1)
    want = sum(kernel[i][j] * p[i : i + 12, j : j + 15] for i in range(3) for j in range(3))
    got = grid(wn.apply_kernel(df, kernel), "v", values.shape)
    assert np.allclose(got[~np.isnan(values)], want[~np.isnan(values)])


def test_cloud_distance(spark):
    values = np.zeros((7, 9))
    values[2, 3] = values[6, 8] = 1
    df = raster(spark, values).select("x", "y", (F.col("v") > 0).alias("cloud")).where("x <> 4 OR y <> 4")
    d = np.array([[min(abs(x - 3) + abs(y - 2), abs(x - 8) + abs(y - 6)) for x in range(9)] for y in range(7)])
    want = np.where(d > 4, 1, np.where(d == 0, 0, 1 - np.exp(-(d**2) / 8)))
    got = grid(wn.cloud_distance_score(df, "cloud", 4, 2.0), "score", values.shape)
    assert np.isnan(got[4, 4])
    want[4, 4] = np.nan
    assert np.allclose(got, want, equal_nan=True)


def test_polygon_with_hole(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    zones = spark.createDataFrame([(1, [ring(0.0, 10.0), ring(3.0, 6.0)])], "feature_index int, geom array<array<struct<x double, y double>>>")
    df = raster(spark, np.ones((12, 12)))
    hit = {(r.x, r.y) for r in zn.zonal_join(df, zones, 4).collect()}
    assert hit == {(x, y) for x in range(10) for y in range(10) if not (3 <= x < 6 and 3 <= y < 6)}


def test_neighborhood_tiles(spark):
    rng = np.random.default_rng(1)
    values = rng.random((20, 23))

    def box(rows):
        image, y, x = udf.grid_of(rows, "v")
        p = np.pad(image, 1, constant_values=0)
        total = sum(p[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3))
        return rows[["x", "y"]].assign(v=total[y, x])

    p = np.pad(values, 1)
    want = sum(p[i : i + 20, j : j + 23] for i in range(3) for j in range(3))
    got = udf.apply_neighborhood(raster(spark, values), box, 8, 2, "x int, y int, v double")
    assert got.count() == values.size
    assert np.allclose(grid(got, "v", values.shape), want)


def sparse(spark, rng):
    """Lone pixels and small groups of them over a wide area, negative places too, of two dates."""
    near = rng.integers(-5, 6, (60, 3, 2)) + rng.integers(-3000, 3000, (60, 1, 2))
    places = sorted({(x, y, day) for day in (1, 2) for x, y in map(tuple, near.reshape(-1, 2).tolist()) if rng.random() < 0.8})
    return places, spark.createDataFrame([(x, y, datetime(2024, 1, day), float(x % 7)) for x, y, day in places], "x int, y int, t timestamp, v double")


def test_neighborhood_tiles_together(spark):
    """Far tiles share a call where the function is local; the rows are those of a call for each tile."""
    places, df = sparse(spark, np.random.default_rng(5))
    calls = spark.sparkContext.accumulator(0)

    def total(rows):
        calls.add(1)
        image, y, x = udf.grid_of(rows, "v")
        p = np.pad(np.nan_to_num(image), 3)
        sums = sum(p[i : i + image.shape[0], j : j + image.shape[1]] for i in range(7) for j in range(7))
        return rows[["x", "y", "t"]].assign(v=sums[y, x])

    def box(local):
        before = calls.value
        found = udf.apply_neighborhood(df, total, 8, 3, "x int, y int, t timestamp, v double", local=local).collect()
        return sorted((r.x, r.y, r.t.day, r.v) for r in found), calls.value - before

    (got, few), (want, many) = box(True), box(False)
    assert got == want
    assert got == [(x, y, d, sum(float(a % 7) for a, b, e in places if e == d and abs(a - x) <= 3 and abs(b - y) <= 3)) for x, y, d in places]
    assert few < many / 4


def test_far_tiles_share_a_block(spark):
    places, df = sparse(spark, np.random.default_rng(6))
    blocks = spark.sparkContext.accumulator(0)

    def work(block, v):
        blocks.add(1)
        return {"v": block.rows(box_sums(block.matrix(v["v"]), 4, 4)), "d": block.rows(city_block(block.matrix(v["v"]) == 3))}

    got = sorted((r.x, r.y, r.t.day, r.v, min(r.d, 5.0)) for r in in_blocks(df, work, 4, ["v"], {"v": "double", "d": "double"}, 16).collect())
    near = lambda x, y, d: [(a, b) for a, b, e in places if e == d and abs(a - x) <= 4 and abs(b - y) <= 4]
    assert got == [(x, y, d, sum(float(a % 7) for a, _ in near(x, y, d)), min([5.0, *(abs(a - x) + abs(b - y) + 0.0 for a, b in near(x, y, d) if a % 7 == 3)])) for x, y, d in places]
    assert blocks.value < 60


def test_tiles_stay_whole_and_apart():
    rng = np.random.default_rng(7)
    tile = np.sort(rng.integers(0, 50, 400))
    tile = np.unique(tile, return_inverse=True)[1]
    x, y = rng.integers(-40, 40, (2, 400))
    seen = []
    for rows, px, py in laid_apart(tile, x, y, 3, 2000):
        seen += rows.tolist()
        dx, dy = (np.abs(v[:, None] - v) for v in (px, py))
        ox, oy = (np.abs(v[:, None] - v) for v in (x[rows], y[rows]))
        same = tile[rows][:, None] == tile[rows]
        near = same & (ox <= 3) & (oy <= 3)
        assert (near == ((dx <= 3) & (dy <= 3))).all()
        assert (dx == ox)[near].all() and (dy == oy)[near].all()
    assert sorted(seen) == list(range(400))
    keys = pa.table({"k": pa.array([None, None, 1, 1, 1, 2, 3, 3]), "v": range(8)})
    assert [t["v"].to_pylist() for t in whole_tiles(keys.to_batches(2), ["k"], 3)] == [[0, 1], [2, 3, 4], [5], [6, 7]]


def test_sums_keep_digits_beside_large_values():
    m = np.zeros((1, 40))
    m[0, 0], m[0, 30] = 1e18, 0.1
    assert box_sums(m, 1, 1)[0, 30] == 0.1


def test_texture_is_brute_force():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (14, 14)).astype(float)
    variance, contrast = udf.window_texture(image, 5, 2)
    p = np.pad(image, 2, mode="reflect")
    for y in (0, 6, 13):
        for x in (0, 7, 13):
            w = p[y : y + 5, x : x + 5]
            assert np.isclose(variance[y, x], w.var())
            assert np.isclose(contrast[y, x], ((w[:, 2:] - w[:, :-2]) ** 2).mean())


def cooccurrence(window, distance):
    """Contrast of the symmetric, normalised co-occurrence matrix of bytes at a distance along x."""
    m = np.zeros((256, 256))
    for line in window.astype(int):
        for a, b in zip(line[:-distance], line[distance:], strict=True):
            m[a, b] += 1
            m[b, a] += 1
    i, j = np.indices(m.shape)
    return (m / m.sum() * (i - j) ** 2).sum()


def test_texture_of_chunks_beyond_bytes(spark):
    rng = np.random.default_rng(8)
    values = rng.integers(1000, 3001, (21, 30)).astype(float)
    values[4, 7] = np.nan
    got = udf.glcm_texture(raster(spark, values), "v", 5, 2, size=12, overlap=4)
    contrast, variance = grid(got, "contrast", values.shape), grid(got, "variance", values.shape)
    for y, x in ((0, 0), (4, 7), (6, 11), (6, 12), (11, 24), (20, 29), (13, 3)):
        low, left = max(0, y // 12 * 12 - 4), max(0, x // 12 * 12 - 4)
        chunk = values[low : y // 12 * 12 + 16, left : x // 12 * 12 + 16]
        scaled = np.nan_to_num(np.floor((chunk - np.nanmin(chunk)) / (np.nanmax(chunk) - np.nanmin(chunk)) * 255))
        w = np.pad(scaled, 2, mode="reflect")[y - low : y - low + 5, x - left : x - left + 5]
        assert np.isclose(contrast[y, x], cooccurrence(w, 2)) and np.isclose(variance[y, x], w.var()) and w.max() > 0
    flat = udf.glcm_texture(raster(spark, np.full((9, 9), 2500.0)), "v", 5, 2)
    assert {(r.contrast, r.variance) for r in flat.collect()} == {(0.0, 0.0)}


def test_burn_texture_takes_context_and_labels(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(500, 4000, (2, 20, 24)).astype(float)
    df = raster(spark, a, "B08").join(raster(spark, b, "B12"), ["x", "y"])
    got = udf.burn_texture(df, {"padding_window_size": 7}, labels=("c", "v", "n"))
    assert got.columns == ["x", "y", "c", "v", "n"]
    scaled = np.floor((b - b.min()) / (b.max() - b.min()) * 255)
    p = np.pad(scaled, 3, mode="reflect")
    c, v, n = (grid(got, name, a.shape) for name in "cvn")
    for y, x in ((0, 0), (10, 12), (19, 23)):
        assert np.isclose(c[y, x], cooccurrence(p[y : y + 7, x : x + 7], 5)) and np.isclose(v[y, x], p[y : y + 7, x : x + 7].var())
    assert np.allclose(n, (b / b.mean() - a / a.mean()) / (a / a.mean()))


def test_whittaker_is_least_squares(spark):
    rng = np.random.default_rng(5)
    v = rng.random(30)
    w = (rng.random(30) > 0.2).astype(float)
    d = np.diff(np.eye(30), 2, axis=0)
    assert np.allclose(udf.smooth(v, w, 7.0), np.linalg.solve(np.diag(w) + 7.0 * d.T @ d, w * v))
    rows = [(x, y, f"2024-01-{t:02d}", None if (x + y + t) % 4 == 0 or x == 9 and t > 1 else float((x * 7 + t * t) % 11)) for x in range(10) for y in range(2) for t in range(1, 8 + x % 3)]
    df = spark.createDataFrame(rows, "x int, y int, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = {(r.x, r.y, r.t.day): r.v for r in udf.whittaker(df, 3.0).collect()}
    assert len(got) == len(rows)
    for x in range(10):
        v = np.array([np.nan if r[3] is None else r[3] for r in rows if r[:2] == (x, 1)])
        w, m = (~np.isnan(v)).astype(float), np.diff(np.eye(len(v)), 2, axis=0)
        want = np.linalg.solve(np.diag(w) + 3.0 * m.T @ m, np.where(w > 0, v, 0)) if w.sum() > 1 else v
        assert np.allclose([np.nan if got[x, 1, t + 1] is None else got[x, 1, t + 1] for t in range(len(v))], want, equal_nan=True)


def test_sparse_scenes_and_far_pixels(spark):
    """Windows over a few pixels far apart, and zones over many cells, against brute force."""
    rng = np.random.default_rng(11)
    at = {(int(x), int(y)) for x, y in rng.integers(0, 90, (400, 2))} | {(1_000_000, 5), (40, 2_000_000)}
    v = {p: float(rng.integers(0, 9)) for p in at}
    df = spark.createDataFrame([(x, y, v[x, y]) for x, y in at], "x int, y int, v double")
    got = {(r.x, r.y): r.v for r in wn.moving_sum(df, 20).collect()}
    assert got == {p: sum(w for q, w in v.items() if abs(p[0] - q[0]) <= 20 and abs(p[1] - q[1]) <= 20) for p in at}
    clouds = [p for p in at if v[p] == 8.0]
    far = {(r.x, r.y): r.score for r in wn.cloud_distance_score(df.withColumn("c", F.col("v") == 8), "c", 30, 9.0).collect()}
    for p in at:
        d = min(abs(p[0] - q[0]) + abs(p[1] - q[1]) for q in clouds)
        assert far[p] == pytest.approx(1 if d > 30 else 0 if d == 0 else 1 - np.exp(-d * d / 162))


def test_zones_over_many_cells(spark):
    pixels = spark.range(200 * 150).selectExpr("cast(id % 200 as int) AS x", "cast(id div 200 as int) AS y")
    point = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    shapes = {1: [point([(3, 4), (190, 10), (150, 140), (20, 120)]), point([(60, 40), (120, 45), (90, 100)])], 2: [point([(100, 0), (199, 75), (100, 149), (1, 75)])], 3: [point([(70, 70), (73, 70), (73, 74), (70, 74)])]}
    zones = spark.createDataFrame(list(shapes.items()), "feature_index int, geom array<array<struct<x double, y double>>>")

    def holds(rings, x, y):
        n = 0
        for ring in rings:
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                if (a["y"] > y) != (b["y"] > y) and x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]):
                    n += 1
        return n % 2 == 1

    want = {(x, y, k) for k, rings in shapes.items() for x in range(200) for y in range(150) if holds(rings, x + 0.5, y + 0.5)}
    got = [(r.x, r.y, r.feature_index) for r in zn.zonal_join(pixels, zones, cell=16).collect()]
    assert len(got) == len(want) and set(got) == want
    inside = [(r.x, r.y) for r in zn.filter_spatial(pixels, zones, cell=16).collect()]
    assert len(inside) == len(set(inside)) and set(inside) == {w[:2] for w in want}


def even_odd(points, rings):
    """Even-odd rule for many points at once, edge by edge."""
    x, y = points.T
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return odd


def test_large_polygons(spark):
    """A border of 100,000 vertices around 200,000 x 200,000 pixels with a hole, and a comb of vertices on cell borders."""
    from pixelframe.operators import cover as cv

    rng = np.random.default_rng(4)
    angle = np.sort(rng.random(100_000)) * 2 * np.pi
    far = 100_000 * (0.6 + 0.3 * np.sin(5 * angle) + 0.0001 * rng.random(len(angle)))
    star = np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1)
    hole = np.array([[-9000.0, -9000], [9000, -9000], [9000, 9000], [-9000, 9000]])
    comb = np.array([[0, 0], *([p for i in range(8) for p in ([64 * i, 640], [64 * i + 32, 64])]), [512, 0]], float)
    shapes = {1: [star, hole], 2: [comb], 3: [hole * 2, hole / 90]}
    point = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    zones = spark.createDataFrame([(k, [point(r) for r in rings]) for k, rings in shapes.items()], "feature_index int, geom array<array<struct<x double, y double>>>")
    near = star[rng.integers(0, len(star), 600)] + rng.integers(-60, 61, (600, 2))
    at = np.unique(np.concatenate([near, rng.integers(-100_000, 100_000, (800, 2)), rng.integers(-20, 660, (1500, 2)), np.stack([np.arange(-10, 640), np.full(650, 64)], 1), np.stack([np.full(650, 63), np.arange(-10, 640)], 1)]).astype(int), axis=0)
    centre = at + 0.5
    want = {(int(x), int(y), k) for k, rings in shapes.items() for (x, y), hit in zip(at, even_odd(centre, rings) if k > 1 else even_odd_many(centre, rings), strict=True) if hit}
    df = spark.createDataFrame([(int(x), int(y)) for x, y in at], "x int, y int")
    got = [(r.x, r.y, r.feature_index) for r in zn.zonal_join(df, zones).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    inside = [(r.x, r.y) for r in zn.filter_spatial(df, zones).collect()]
    assert len(inside) == len(set(inside)) and set(inside) == {w[:2] for w in want}
    cells, top = cv.cover(zones.where("feature_index = 1"), zn.edges(F.col("geom")), 64)
    length = np.abs(np.diff(np.concatenate([star, star[:1]]), axis=0)).sum() + 72_000
    assert top == 12 and cells.count() < 4 * length / 64 < (200_000 / 64) ** 2 / 8


def even_odd_many(points, rings):
    """even_odd() by blocks of points against all edges."""
    out = []
    for part in np.array_split(points, 40):
        x, y = part[:, :1], part[:, 1:]
        n = np.zeros(len(part), int)
        for ring in rings:
            (ax, ay), (bx, by) = ring.T, np.roll(ring, -1, axis=0).T
            with np.errstate(divide="ignore", invalid="ignore"):
                n += (((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))).sum(1)
        out.append(n % 2 == 1)
    return np.concatenate(out)


def test_quantiles_by_selection(spark):
    from pyspark.sql import types as T

    from pixelframe.operators.selection import quantiles_of_groups

    rng = np.random.default_rng(6)
    groups = {"ties": np.repeat([3.0, 3.0, 7.0], 400), "wide": np.r_[rng.random(900), 1e300, -1e300, 1e-300], "huge": np.array([-1.7e308, 1.7e308] * 300), "one": np.array([5.0]), "geometric": 2.0 ** np.arange(-500, 500), "normal": rng.normal(size=3000)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("normal", None), ("normal", float("nan")), ("ties", float("inf")), ("empty", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(5)] for r in quantiles_of_groups(df, ["k"], "v", probs, buffer=10, few=5).collect()}
    usual = {r.k: [r[f"q{i}"] for i in range(5)] for r in quantiles_of_groups(df, ["k"], "v", probs).collect()}
    assert got == usual and got.pop("empty") == [None] * 5 and set(got) == set(groups)
    for k in ("ties", "one", "normal", "wide"):
        assert np.allclose(got[k], np.quantile(groups[k], probs))
    n = 10_000_000
    large = spark.range(n).select(((F.col("id") * 7919) % n).cast(T.DoubleType()).alias("v"))
    assert tuple(quantiles_of_groups(large, [], "v", [0.5, 0.25]).first()) == ((n - 1) / 2, (n - 1) / 4)


def test_forest_and_batch_models(spark):
    df = spark.range(200).selectExpr("cast(id % 20 as int) AS x", "cast(id div 20 as int) AS y", "cast(id % 20 as double) AS a", "cast(id % 7 as double) AS b").withColumn("label", (F.col("a") > 9).cast("double"))
    model = udf.train_forest(df, ["a", "b"], "label", 5, 3)
    assert udf.predict_forest(df, model, ["a", "b"]).where("class <> label").count() == 0
    got = udf.predict_batch(df.withColumn("b", F.when(F.col("b") > 0, F.col("b"))), lambda: 2.0, lambda m, x: m * x.sum(1), ["a", "b"], fill=0.0)
    assert got.count() == 200


def test_ensemble_median(spark):
    rows = [(x, y, f"2024-01-{t:02d}", float(t)) for x in range(6) for y in range(5) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "x int, y int, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = udf.ensemble_median(df, "v", [lambda s: s.max(0), lambda s: s.min(0)], draws=2, k=3, size=4, overlap=2)
    assert got.count() == 30
    micros = {t: int(datetime(2024, 1, t, tzinfo=timezone.utc).timestamp()) * 1_000_000 for t in range(1, 6)}
    picks = [np.array(sorted(micros, key=lambda t: hashlib.md5(f"{i}|{micros[t]}".encode()).hexdigest())[:3]) for i in range(2)]  # noqa: B023
    want = np.median([p.max() for p in picks] + [p.min() for p in picks])
    assert {r.prediction for r in got.collect()} == {want}


def test_polygon_windows(spark):
    rng = np.random.default_rng(12)
    values = rng.integers(1, 9, (30, 34)).astype(float)
    values[5, 6] = np.nan
    df = raster(spark, values).where("x <> 9 OR y <> 9").withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    rings = [np.array([[2.2, 3.1], [29.7, 5.4], [20.0, 27.9]]), np.array([[12.0, 8.0], [20.0, 8.0], [18.0, 14.0]])]
    zones = spark.createDataFrame([(3, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings])], "feature_index int, geom array<array<struct<x double, y double>>>")
    schema = "feature_index int, t timestamp, x int, y int, v double, rows long"
    fn = lambda rows, c: rows.assign(rows=len(rows) + c["more"])
    ys, xs = np.mgrid[3:28, 2:30]
    odd = even_odd(np.stack([xs.ravel(), ys.ravel()], 1) + 0.5, rings).reshape(xs.shape)
    want = {(int(x), int(y)): (None if np.isnan(values[y, x]) or (x, y) == (9, 9) else values[y, x]) if hit else 99.0 for x, y, hit in zip(xs.ravel(), ys.ravel(), odd.ravel(), strict=True)}
    for tile in (None, 8):
        got = udf.apply_polygon(df, zones, fn, schema, tile=tile, mask_value=99.0, context={"more": 1}, per_date=tile is None).collect()
        inside = {(r.x, r.y): r.v for r in got}
        assert len(got) == len(inside)
        if tile is None:
            assert inside == want and {r.rows for r in got} == {len(want) + 1}
        else:  # tiles without a pixel of the polygon aren't given
            full = {(x // 8, y // 8) for (x, y), v in want.items() if v is not None and v != 99.0}
            assert inside == {p: v for p, v in want.items() if (p[0] // 8, p[1] // 8) in full} and max(r.rows for r in got) == 65


def test_burn_index_over_all_rows_needs_no_window(spark):
    from pixelframe.plans import pipelines as pl

    df = spark.createDataFrame([(i, 10.0 + i, 20.0 - i) for i in range(9)] + [(9, None, 3.0)], "x int, B12 double, B08 double")
    got = pl.ndfi(df, ())
    want = {r.x: r.ndfi for r in pl.ndfi(df.withColumn("one", df.x * 0), ["one"]).collect()}
    assert {r.x: r.ndfi for r in got.collect()} == want and got.columns == ["x", "B12", "B08", "ndfi"]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_cube_files_are_compact(spark, tmp_path):
    """Boxes along either direction, as small as a sixteenth of the grid, meet about as many files; nothing is lost, below zero neither."""
    from pixelframe.sources import io

    px = spark.range(64 * 64).selectExpr("cast(id % 64 - 32 as int) AS x", "cast(id div 64 - 32 as int) AS y", "timestamp '2024-05-01' AS t", "id AS v")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_cube(px, str(tmp_path / "c"), 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    cube = spark.read.parquet(str(tmp_path / "c"))
    extents = cube.groupBy("_metadata.file_path").agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n")).collect()
    met = lambda w, s, e, n: sum(r.w <= e and r.e >= w and r.s <= n and r.n >= s for r in extents)
    assert len(extents) == 16
    for lo in range(-32, 32, 16):
        assert met(lo, -32, lo + 15, 31) <= 8 and met(-32, lo, 31, lo + 15) <= 8 and met(lo, lo, lo + 15, lo + 15) <= 5
    assert io.load_collection(spark, str(tmp_path / "c"), ["v"], (-5, 3, 10, 20)).count() == 16 * 18
    assert cube.agg(F.countDistinct("x", "y"), F.sum("v")).first()[:] == (4096, 4096 * 4095 // 2)


def test_z_order(spark):
    cells = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (-1, -1), (-7, 5), (1000, 999)]
    plain = lambda x, y: sum(((v + (1 << 20) >> i) & 1) << 2 * i + k for i in range(21) for k, v in enumerate((x, y)))
    from pixelframe.sources import io

    got = spark.createDataFrame(cells, "x long, y long").select("x", "y", io.z_order(F.col("x"), F.col("y")).alias("z")).collect()
    assert all(r.z == plain(r.x, r.y) for r in got)
