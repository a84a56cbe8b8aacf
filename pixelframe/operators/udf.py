"""User functions over pixels, series, tiles and polygons: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..meta import bands, dims
from . import cover as cv
from .blocks import by_tiles, laid_apart, owned, whole_tiles
from .cube import rename_labels
from .zones import edges, zonal_join


def apply_pixels(df: DataFrame, fn: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str, context: dict | None = None) -> DataFrame:
    """A vectorised function of all bands of a batch of pixels."""
    given = dict(context or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch, given)

    return df.mapInPandas(run, schema)


def apply_series(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of each pixel's series in order of time."""
    return df.groupBy("x", "y").applyInPandas(lambda rows: fn(rows.sort_values("t")), schema)


def apply_neighborhood(df: DataFrame, fn: Callable[..., pd.DataFrame], size: int, overlap: int, schema: str, context: dict | None = None, labels: Sequence[str] | None = None, local: bool = False) -> DataFrame:
    """A function of tiles of size x size pixels with `overlap` pixels around; only the tile's own pixels are kept.

    Halo rows are sent to the neighbouring tiles, so that a call holds one tile (of one date) at a time. fn gets the tile's rows in
    order of y and x, and the context where one is given; labels are the names of its bands, in order, in place of the schema's.
    local: what fn gives for a pixel of its rows follows from the pixels within `overlap` around alone, wherever they lie. Then a call holds many
    tiles side by side, further apart than that (`laid_apart`; x and y are places there, put back afterwards), so that calls follow the pixels and not the tiles.
    """
    keys = ["_tx", "_ty", *(c for c in dims(df) if c == "t")]
    reach = lambda c: F.sequence(F.floor((F.col(c) - overlap) / size).cast("int"), F.floor((F.col(c) + overlap) / size).cast("int"))
    sent = df.withColumn("_tx", F.explode(reach("x"))).withColumn("_ty", F.explode(reach("y")))
    given = () if context is None else (dict(context),)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = rows["_tx"].iloc[0], rows["_ty"].iloc[0]
        own = (rows["x"] // size == tx) & (rows["y"] // size == ty)
        if not own.any():  # a halo without a tile
            return rows.iloc[:0].reindex(columns=names)
        out = fn(rows.drop(columns=["_tx", "_ty"]).sort_values(["y", "x"]), *given)
        return out[(out["x"] // size == tx) & (out["y"] // size == ty)]

    def run_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches, keys):
            table, tile, own, x, y = owned(table, keys, size)
            if not len(table):
                continue
            frame = table.drop_columns(["_tx", "_ty"]).to_pandas()
            frame = frame.assign(**{c: frame[c].dt.tz_localize(None) for c in frame.select_dtypes("datetimetz")})
            for rows, px, py in laid_apart(tile, x, y, overlap):
                order = np.lexsort((px, py))
                rows, px, py = rows[order], px[order], py[order]
                out = fn(frame.iloc[rows].assign(x=px, y=py), *given)
                wide = int(px.max()) + 1
                row = rows[np.searchsorted(py * wide + px, out["y"].to_numpy() * wide + out["x"].to_numpy())]
                out = out.assign(x=x[row], y=y[row], **{c: out[c].dt.tz_localize(zone, ambiguous=False) for c in times})[own[row]]
                yield from pa.Table.from_pandas(out[names], types, preserve_index=False).combine_chunks().to_batches()

    empty = df.sparkSession.createDataFrame([], schema)
    names = empty.columns
    types, times, zone = to_arrow_schema(empty.schema), [c for c, kind in empty.dtypes if kind == "timestamp"], df.sparkSession.conf.get("spark.sql.session.timeZone")
    made = by_tiles(sent, keys).mapInArrow(run_many, schema) if local else sent.groupBy(*keys).applyInPandas(run, schema)
    return made if labels is None else rename_labels(made, labels)


def apply_polygon(df: DataFrame, zones: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, per_date: bool = False, mask_value: float | None = None, context: dict | None = None, tile: int | None = None) -> DataFrame:
    """A function of each polygon's pixels; fn gets the context too where one is given.

    Without mask_value the rest is absent. With it fn gets rectangular windows, in order of (t,) y and x: the pixels whose centres lie in the polygon's bounds, mask_value
    in all bands outside the polygon, and nodata for the pixels inside that the cube lacks. per_date: of each date by itself; tile: of each tile of
    so many pixels by itself, with the part of the window in it; that is all that a task then holds. Only dates and tiles that hold a pixel of the polygon are given.
    """
    given = () if context is None else (dict(context),)
    keys = ["feature_index", *(c for c in dims(df) if c == "t" and per_date)]
    if mask_value is None:
        held = zonal_join(df, zones).withColumns({} if tile is None else {"_cx": F.floor(F.col("x") / tile), "_cy": F.floor(F.col("y") / tile)})
        keys += [] if tile is None else ["_cx", "_cy"]
        return held.groupBy(*keys).applyInPandas(lambda rows: fn(rows.drop(columns=["_cx", "_cy"], errors="ignore"), *given), schema)
    names = bands(df)
    held = zonal_join(df, zones)
    if tile is not None:
        keys += ["_cx", "_cy"]
        held = held.withColumns({"_cx": F.floor((F.col("x") + 0.5) / tile).cast("int"), "_cy": F.floor((F.col("y") + 0.5) / tile).cast("int")})
    # each window once, with its polygon's edges
    shapes = cv.bounded(zones.select("feature_index", "geom"), edges(F.col("geom")), tile or 1).select("feature_index", "_edges", "_w", "_e", "_s", "_n")
    windows = held.select(*keys).distinct().join(shapes, "feature_index").select(*(F.col(c).alias(f"_of{c}") for c in keys), "_edges", "_w", "_e", "_s", "_n", *(F.col(c).alias(f"_at{c}") for c in keys if c in ("_cx", "_cy")))

    def run(rows: pd.DataFrame, window: pd.DataFrame) -> pd.DataFrame:
        if not len(window) or not len(rows):
            return rows.iloc[:0].reindex(columns=out)
        w = window.iloc[0]
        ends = np.array([[e[c] for c in ("ax", "ay", "bx", "by")] for e in w["_edges"]])
        x0, x1, y0, y1 = (int(np.ceil(v - 0.5)) for v in (w["_w"], w["_e"], w["_s"], w["_n"]))
        if tile is not None:
            x0, x1 = max(x0, int(w["_at_cx"]) * tile), min(x1, int(w["_at_cx"]) * tile + tile)
            y0, y1 = max(y0, int(w["_at_cy"]) * tile), min(y1, int(w["_at_cy"]) * tile + tile)
        inside = inside_window(ends, x0, x1, y0, y1)
        y, x = (v.ravel() for v in np.mgrid[y0:y1, x0:x1])
        grid = pd.DataFrame({"x": x, "y": y, "_in": inside.ravel()})
        made = []
        for _, scene in rows.groupby("t", sort=True) if "t" in rows else [(None, rows)]:
            full = grid.merge(scene.drop(columns=["_cx", "_cy"], errors="ignore"), "left", ["x", "y"])
            full[names] = full[names].astype(float).where(full["_in"], mask_value)
            for c in ("feature_index", *(c for c in ("t",) if c in rows)):
                full[c] = scene[c].iloc[0]
            made.append(full.drop(columns="_in"))
        return fn(pd.concat(made, ignore_index=True), *given)

    out = df.sparkSession.createDataFrame([], schema).columns
    return held.groupBy(*keys).cogroup(windows.groupBy(*(f"_of{c}" for c in keys))).applyInPandas(run, schema)


def inside_window(ends: np.ndarray, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Whether the centres of the pixels of a window (rows y0 to y1, columns x0 to x1, ends excluded) lie in a polygon, line by line.

    An edge crosses the lines between its ends; what lies left of a crossing changes sides there, so that a line's crossings pair to spans.
    """
    turns = np.zeros((max(y1 - y0, 0), max(x1 - x0, 0) + 1), np.int64)
    ax, ay, bx, by = ends.T
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    first = np.clip(np.ceil(low - 0.5), y0, y1).astype(int)
    last = np.clip(np.ceil(high - 0.5), y0, y1).astype(int)
    edge = np.repeat(np.arange(len(ends)), last - first)
    line = np.arange(len(edge)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[edge]
    at = ax[edge] + (line + 0.5 - ay[edge]) * (bx[edge] - ax[edge]) / (by[edge] - ay[edge])
    np.add.at(turns, (line - y0, np.clip(np.ceil(at - 0.5), x0, x1).astype(int) - x0), 1)
    return turns[:, ::-1].cumsum(1)[:, ::-1][:, 1:] % 2 == 1


def grid_of(rows: pd.DataFrame, band: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's band as a matrix (NaN where no pixel is), and each row's place in it."""
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    out = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), np.nan)
    out[y - y.min(), x - x.min()] = rows[band].to_numpy(float)
    return out, y - y.min(), x - x.min()


def window_texture(image: np.ndarray, window: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Variance within, and mean squared difference of pairs `distance` apart along x within, the window around each pixel.

    The second is the contrast of the symmetric, normalised co-occurrence matrix; both by summed-area tables; borders are mirrored.
    """
    r = window // 2
    p = np.pad(image, r, mode="reflect") if min(image.shape) > r else np.pad(image, r, mode="symmetric")

    def box(a: np.ndarray, h: int, w: int) -> np.ndarray:
        s = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    n = window * window
    mean = box(p, window, window) / n
    variance = np.maximum(box(p * p, window, window) / n - mean**2, 0)
    d2 = (p[:, distance:] - p[:, :-distance]) ** 2
    contrast = box(d2, window, window - distance) / (window * (window - distance))
    return variance, contrast[: image.shape[0], : image.shape[1]]


def scaled_bytes(image: np.ndarray) -> np.ndarray:
    """0 to 255 from the chunk's smallest to its largest value, fractions cut off. Nodata counts 0, as does a chunk of one value."""
    known = image[np.isfinite(image)]
    low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
    if high == low:
        return np.zeros(image.shape)
    return np.where(np.isfinite(image), np.floor((image - low) / (high - low) * 255), 0.0)


def chunk_texture(rows: pd.DataFrame, band: str, window: int, distance: int) -> pd.DataFrame:
    """The rows' dimensions with `contrast` and `variance` of a band around each: the chunk's extrema (its halo included; mirrored borders add none) scale it first."""
    image, y, x = grid_of(rows, band)
    variance, contrast = window_texture(scaled_bytes(image), window, distance)
    return rows[dims_of(rows)].assign(contrast=contrast[y, x], variance=variance[y, x])


def glcm_texture(df: DataFrame, band: str, window: int = 33, distance: int = 5, size: int = 128, overlap: int = 32) -> DataFrame:
    """`contrast` and `variance` of a band around each pixel, of values scaled to bytes chunk by chunk (a tile with its halo)."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in dims(df))
    return apply_neighborhood(df.select(*dims(df), band), lambda rows: chunk_texture(rows, band, window, distance), size, overlap, f"{kinds}, contrast double, variance double")


def burn_texture(df: DataFrame, context: dict | None = None, size: int = 128, overlap: int = 32, labels: Sequence[str] = ("contrast", "variance", "ndfi")) -> DataFrame:
    """Texture of B12, and the burn index of B12 and B08 against their averages in the chunk.

    context: padding_window_size (33), the side of the texture's window; pairs are 5 apart. A pixel without either band has no index.
    """

    def run(rows: pd.DataFrame, given: dict) -> pd.DataFrame:
        out = chunk_texture(rows, "B12", int(given.get("padding_window_size", 33)), 5)
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (rows[c].to_numpy(float) / rows[c].mean() for c in ("B12", "B08"))
            index = (a - b) / b
        return out.assign(ndfi=np.where(np.isfinite(index), index, np.nan))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in dims(df))
    return apply_neighborhood(df.select(*dims(df), "B08", "B12"), run, size, overlap, f"{kinds}, contrast double, variance double, ndfi double", context or {}, labels)


def dims_of(rows: pd.DataFrame) -> list[str]:
    return [c for c in ("x", "y", "t") if c in rows.columns]


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 6, seed: int = 1):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(df)
    return RandomForestClassifier(featuresCol="_f", labelCol=label, predictionCol="class", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def predict_forest(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """`class` of each pixel; pixels with nodata in a feature are left out."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(df)
    return model.transform(rows).drop("_f", "rawPrediction", "probability")


@lru_cache(maxsize=4)
def _loaded(load: Callable[[], object]) -> object:
    return load()


def predict_batch(df: DataFrame, load: Callable[[], object], predict: Callable[[object, np.ndarray], np.ndarray], features: Sequence[str], fill: float = -999_999) -> DataFrame:
    """`prediction` by a model that each worker loads once; nodata is filled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(load)
        for rows in batches:
            x = rows[list(features)].to_numpy(float)
            yield rows[dims_of(rows)].assign(prediction=np.asarray(predict(model, np.where(np.isnan(x), fill, x)), float))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in dims(df))
    return df.select(*dims(df), *features).mapInPandas(run, f"{kinds}, prediction double")


def ensemble_median(df: DataFrame, value: str, models: Sequence[Callable[[np.ndarray], np.ndarray]], draws: int = 4, k: int = 3, size: int = 64, overlap: int = 32) -> DataFrame:
    """`prediction`: the median over all models and over `draws` choices (seeds 0, 1, ...) of k scenes of a tile.

    A model takes k images (k, rows, columns) in order of time and returns one image; pixels without a value are 0. A choice is the k dates with the
    smallest hash of seed and date. Dates are chosen before their pixels are sent, so that a task holds draws * k scenes of a tile at most, however long the series.
    """
    reach = lambda c: F.sequence(F.floor((F.col(c) - overlap) / size).cast("int"), F.floor((F.col(c) + overlap) / size).cast("int"))
    sent = df.select("x", "y", "t", value).withColumn("_tx", F.explode(reach("x"))).withColumn("_ty", F.explode(reach("y")))
    seeds = sent.select("_tx", "_ty", "t").distinct().withColumn("_seed", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = Window.partitionBy("_tx", "_ty", "_seed").orderBy(F.md5(F.concat_ws("|", F.col("_seed").cast("string"), F.unix_micros("t").cast("string"))), "t")
    chosen = seeds.withColumn("_k", F.row_number().over(drawn)).where(F.col("_k") <= k).groupBy("_tx", "_ty", "t").agg(F.collect_list("_seed").alias("_seeds"))
    places = sent.select("x", "y", "_tx", "_ty").distinct()  # pixels of other dates have a prediction too

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = rows["_tx"].iloc[0], rows["_ty"].iloc[0]
        cells = rows[["x", "y"]].drop_duplicates().sort_values(["y", "x"])
        own = (cells["x"] // size == tx) & (cells["y"] // size == ty)
        if not own.any():
            return cells.iloc[:0].assign(prediction=0.0)
        _, y, x = grid_of(cells.assign(v=0.0), "v")
        shape, left, low = (y.max() + 1, x.max() + 1), cells["x"].min(), cells["y"].min()
        images, seeds = [], []
        for _, scene in rows[rows["t"].notna()].groupby("t", sort=True):
            image = np.zeros(shape)
            image[scene["y"] - low, scene["x"] - left] = np.nan_to_num(scene[value].to_numpy(float))
            images.append(image)
            seeds.append(set(scene["_seeds"].iloc[0]))
        picks = [np.stack([m for m, s in zip(images, seeds, strict=True) if seed in s]) for seed in range(draws)]
        made = [model(pick) for model in models for pick in picks]
        return cells.assign(prediction=np.median(np.stack(made), axis=0)[y, x])[own]

    kept = sent.join(chosen, ["_tx", "_ty", "t"]).unionByName(places, allowMissingColumns=True)
    return kept.groupBy("_tx", "_ty").applyInPandas(tile, "x int, y int, prediction double")


def smooth(values: np.ndarray, weights: np.ndarray, lam: float) -> np.ndarray:
    """Least squares with a penalty on second differences along the last axis: a banded system, solved for all rows at once without filling the matrix."""
    n = values.shape[-1]
    if n < 3:
        return values
    d0 = np.zeros(n)
    d1 = np.zeros(n - 1)
    d0[:-2] += 1
    d0[1:-1] += 4
    d0[2:] += 1
    d1[:-1] -= 2
    d1[1:] -= 2
    # LDL' of a five-banded matrix, whose outer band is lam
    diag, low1, low2 = (np.zeros((n, *values.shape[:-1])) for _ in range(3))
    w, z = np.moveaxis(weights, -1, 0), np.moveaxis(weights * values, -1, 0).copy()
    for i in range(n):
        diag[i] = w[i] + lam * d0[i]
        if i:
            diag[i] -= low1[i - 1] ** 2 * diag[i - 1]
            z[i] -= low1[i - 1] * z[i - 1]
        if i > 1:
            diag[i] -= low2[i - 2] ** 2 * diag[i - 2]
            z[i] -= low2[i - 2] * z[i - 2]
        if i < n - 1:
            low1[i] = (lam * d1[i] - (low1[i - 1] * low2[i - 1] * diag[i - 1] if i else 0)) / diag[i]
        if i < n - 2:
            low2[i] = lam / diag[i]
    z /= diag
    for i in range(n - 2, -1, -1):
        z[i] -= low1[i] * z[i + 1]
        if i < n - 2:
            z[i] -= low2[i] * z[i + 2]
    return np.moveaxis(z, 0, -1)


def whittaker(df: DataFrame, lam: float = 10_000.0, tile: int = 8) -> DataFrame:
    """Each pixel's bands smoothed; nodata has no weight and gets the smooth value; a band with fewer than two values stays so.

    A task holds the series of a tile (tile x tile pixels); those of one length are solved together.
    """
    names = bands(df)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=["_tx", "_ty"]).sort_values(["y", "x", "t"], ignore_index=True)
        size = rows.groupby(["y", "x"], sort=False)["t"].transform("size").to_numpy()
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n).reshape(-1, n)
            for b in names:
                v = rows[b].to_numpy(float)[at]
                known = ~np.isnan(v)
                some = known.sum(1) >= 2
                if some.any():
                    rows.loc[at[some].ravel(), b] = smooth(np.where(known, v, 0.0)[some], known[some].astype(float), lam).ravel()
        return rows

    wide = df.select(*dims(df), *(F.col(b).cast("double").alias(b) for b in names))
    sent = wide.withColumn("_tx", F.floor(F.col("x") / tile)).withColumn("_ty", F.floor(F.col("y") / tile))
    return sent.groupBy("_tx", "_ty").applyInPandas(run, wide.schema)
