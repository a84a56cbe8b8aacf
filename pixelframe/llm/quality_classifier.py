"""Operator 9: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, checkpoint, lean_batches, slices, span_hashes, words

STATISTICS = (
    "log_bytes", "log_words", "mean_word_bytes", "sd_word_bytes", "upper_share", "digit_share", "symbol_share", "bang_share",
    "stop_share", "comma_share", "other_share", "distinct_share", "top_word_share", "line_words", "repeat_line_share", "symbol_word_share",
)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_OTHER = np.isin(np.arange(256), np.frombuffer(b"@/\\=+_~^`\"'{}[]();:-", np.uint8))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.maximum(offsets[1:] - offsets[:-1], 1)
    starts, ends, row = words(data, offsets)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / some
    sd = np.sqrt(np.maximum(np.bincount(row, length**2, n) / some - mean**2, 0))
    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(h)])
    distinct = np.bincount(r[new], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, r[new], times)
    symbol = _SYMBOLS[data]
    has_symbol = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol, out=has_symbol[1:])
    marked = np.bincount(row, (has_symbol[ends] > has_symbol[starts]).astype(float), n) / some
    breaks = np.flatnonzero(data == 10)
    from_, to = np.unique(np.r_[offsets[:-1], breaks + 1, offsets[-1:]]), None
    from_, to = from_[:-1], from_[1:]
    line_row = np.searchsorted(offsets, from_, "right") - 1
    lines = np.bincount(line_row, minlength=n)[:n]
    line_hash = span_hashes(data, from_, to - (data[np.maximum(to - 1, 0)] == 10) if len(from_) else to)
    pairs = np.lexsort((line_hash, line_row))
    lh, lr = line_hash[pairs], line_row[pairs]
    again = np.r_[False, (lh[1:] == lh[:-1]) & (lr[1:] == lr[:-1])] if len(lh) else np.zeros(0, bool)
    repeats = np.bincount(lr, again.astype(float), n)[:n]
    share = lambda flags: _sums(flags, offsets) / size
    root = np.sqrt
    return np.column_stack([
        np.log1p(offsets[1:] - offsets[:-1]), np.log1p(count), np.log1p(mean), np.log1p(sd),
        root(share((data >= 65) & (data <= 90))), root(share((data >= 48) & (data <= 57))), root(share(symbol)), root(share((data == 33) | (data == 63))),
        root(share(data == 46)), root(share(data == 44)), root(share(_OTHER[data])), distinct / some, root(top / some),
        np.log1p(count / np.maximum(lines, 1)), root(repeats / np.maximum(lines, 1)), root(marked),
    ])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs other than the text, and `x`, an array of STATISTICS; null texts count as empty."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            for lo, hi in slices(buffers(column)[1]):
                x = statistics(*buffers(column.slice(lo, hi - lo)))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in rest), values], names=[*rest, "x"])

    return docs.select(*rest, text).mapInArrow(lean_batches(run), schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log priors of the two classes; a plain value that tasks get with their code."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        side = []
        for c in (0, 1):
            y, low = (z - self.mean[c]).T, self.factor[c]
            for i in range(len(y)):  # forward substitution
                y[i] = (y[i] - low[i, :i] @ y[:i]) / low[i, i]
            side.append(-0.5 * (y * y).sum(0) - 0.5 * self.log_det[c] + self.log_prior[c])
        return side[1] - side[0]


def fit(labelled: DataFrame, label: str = "quality", shrinkage: float = 0.1, ridge: float = 1e-3) -> Discriminant | None:
    """Fit on all rows of labelled (x array<double>, label 0/1); None where a class has no row.

    Only the counts, sums and cross products of the two classes reach the driver: 2 * (1 + d + d*d) numbers.
    shrinkage: share of the pooled covariance in each class's own; ridge: added to its diagonal.
    """
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            y = np.asarray(batch.column("y"))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_pydict({"c": pa.array([0, 1], pa.int32()), "m": pa.array(list(total), pa.list_(pa.float64()))})

    rows = labelled.where(F.col(label).isin(0, 1)).select("x", F.col(label).cast("int").alias("y")).mapInArrow(moments, "c int, m array<double>")
    parts = rows.select("c", F.posexplode("m").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for p in parts:
        total[p.c, p.i] = p.v
    count = total[:, 0]
    if not count.all():
        return None
    all_mean = total[:, 1 : d + 1].sum(0) / count.sum()
    all_cov = total[:, d + 1 :].sum(0).reshape(d, d) / count.sum() - np.outer(all_mean, all_mean)
    scale = np.sqrt(np.maximum(np.diag(all_cov), 1e-12))
    mean = total[:, 1 : d + 1] / count[:, None]
    own = np.stack([total[c, d + 1 :].reshape(d, d) / count[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]) / np.outer(scale, scale)
    pooled = (own * count[:, None, None]).sum(0) / count.sum()
    factor = np.stack([np.linalg.cholesky((1 - shrinkage) * own[c] + shrinkage * pooled + ridge * np.eye(d)) for c in (0, 1)])
    log_det = 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1)
    return Discriminant((mean - all_mean) / scale, factor, log_det, np.log(count / count.sum()), all_mean, scale)


def score(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """stats without x, with score (0 to 1) and predicted (score >= 0.5); without a model every score is 0.5.

    The score is the logistic of the log-density difference divided by the number of statistics: the same
    order and the same side of 0.5 as the posterior, without saturating at 0 and 1.
    """
    rest = [c for c in stats.columns if c != "x"]
    schema = stats.select(*rest).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            odds = model.log_odds(x) if model is not None and len(x) else np.zeros(len(x))
            s = logistic(odds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*rest, "score", "predicted"])

    return stats.mapInArrow(lean_batches(run), schema)


def classify(docs: DataFrame, model: Discriminant | None, text: str = "text") -> DataFrame:
    """docs, whole, with score and predicted (columns of these names are replaced), in one pass over the texts."""
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*rest).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            for lo, hi in slices(buffers(column)[1]):
                x = statistics(*buffers(column.slice(lo, hi - lo)))
                s = logistic(model.log_odds(x) if model is not None else np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in rest), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*rest).mapInArrow(lean_batches(run), schema)


#: Labelled rows that learn() reads when no statistics are given.
MOST_LABELLED = 50_000


def learn(docs: DataFrame, labels: DataFrame, stats: DataFrame | None = None, shrinkage: float = 0.1, most: int = MOST_LABELLED) -> Discriminant | None:
    """The model of the labelled documents that aren't held out; of an id's several labels the largest counts.

    Without statistics at hand, those of `most` labelled ids at most are computed, the first by a hash of the id: so many ids and
    labels are sent to all tasks (a megabyte), and no text moves.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out())
    if stats is None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        return fit(with_statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")), shrinkage=shrinkage)
    return fit(stats.join(known, "doc_id"), shrinkage=shrinkage)


def logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds / len(STATISTICS), -36, 36)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels are learned from rows that aren't held out; the class of an id with several labels is that of
    its largest one. Null, empty and very long texts are scored like others (an empty text by its zeros);
    rows with a null id are scored and never learned from; repeated rows each get their row; other columns
    are ignored; without usable labels each score is 0.5.
    """
    stats = checkpoint(with_statistics(docs.select("doc_id", "text")))
    model = learn(docs, labels, stats, shrinkage)
    return score(stats, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
