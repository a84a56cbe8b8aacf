"""Operator 4: near-duplicate vectors by counting collisions in sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, unite
from .components import components

#: Rows of one side of a block of pairs that a task holds at once.
BLOCK = 1024


@dataclass(frozen=True)
class Calibration:
    """How many projections divide the space, how many counts decide, set from the wanted recall at the threshold.

    Projections of two unit vectors at cosine c differ by a normal deviate of deviation sqrt(2 - 2c); a
    window of two deviations on either side so holds a fraction p of the true pairs in each projection. It holds four tenths of all
    other pairs too (at cosine 0.93), in every projection: counting alone over a whole label would look at a share of all its pairs. So sign bits
    of `leads` projections first divide a label into cells of some 128 vectors, in as many tables as the recall asks.
    """

    leads: int
    tables: int
    counted: int
    window: float
    least: int

    @staticmethod
    def of(rows: int, cosine: float = 0.93, recall: float = 0.99, counted: int = 24, cell: int = 128) -> Calibration:
        leads = min(62, max(2, math.ceil(math.log2(rows / cell)))) if rows > cell else 0
        same_side = (1 - math.acos(cosine) / math.pi) ** leads
        miss = (1 - recall) / 2
        tables = 1 if leads == 0 else math.ceil(math.log(miss) / math.log(1 - same_side))
        p, least, tail = math.erf(2 / math.sqrt(2)), counted, 0.0
        while least > 0:
            tail += math.comb(counted, least) * p**least * (1 - p) ** (counted - least)
            if tail >= 1 - miss:
                break
            least -= 1
        return Calibration(leads, tables, counted, 2 * math.sqrt(2 - 2 * cosine), least)


def _unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one; others are zero or not finite."""
    x = raw.astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(axis=1, initial=0.0)
        good = (scale > 0) & np.isfinite(x).all(1)
        x = x[good] / scale[good, None]
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None], good


@lru_cache(maxsize=8)
def projections(size: int, c: Calibration, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions that divide (tables, leads, size) and that count (counted, size), the same in every task."""
    draw = np.random.default_rng((seed, size))
    return draw.standard_normal((c.tables, max(c.leads, 1), size)), draw.standard_normal((c.counted, size))


def codes_of(x: np.ndarray, c: Calibration, seed: int) -> np.ndarray:
    """The cell of each row in each table."""
    if not c.leads:
        return np.zeros((len(x), c.tables), np.int64)
    lead, _ = projections(x.shape[1], c, seed)
    return ((np.einsum("tld,nd->ntl", lead, x, optimize=True) >= 0) * (1 << np.arange(c.leads, dtype=np.int64))).sum(2)


def collisions(a: np.ndarray, b: np.ndarray, window: float) -> np.ndarray:
    """For each row of a, how many projections have each row of b within its window: b is sorted by each projection, and each query's window is a run of that order."""
    count = np.zeros((len(a), len(b)), np.int16)
    rows = np.arange(len(a))
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        line = b[order, j]
        edge = np.zeros((len(a), len(b) + 1), np.int16)
        np.add.at(edge, (rows, np.searchsorted(line, a[:, j] - window, "left")), 1)
        np.add.at(edge, (rows, np.searchsorted(line, a[:, j] + window, "right")), -1)
        count[:, order] += np.cumsum(edge[:, :-1], axis=1, dtype=np.int16)
    return count


def near_links(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """(vec_id, other, n): for each vector and block of candidates, the smallest id that the block's links reach from it and the number of links first met there.

    vectors: vec_id, label, embedding, weight (how many vectors a row stands for, each a link). Pairs are of one label and length, and no pair is
    ever a row: a task holds a block of a cell against another and sends one row for each vector. A pair that meets in several tables counts
    in the first of them only. A vector goes to its cells as it came, once for each table; all else is computed there.
    """
    spark = vectors.sparkSession
    most = vectors.where("label IS NOT NULL AND size(embedding) > 0").groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0]
    if not most:
        return spark.createDataFrame([], "vec_id long, other long, n long")
    c = Calibration.of(most, cosine, recall)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                column = part.column("embedding")
                length, edge = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy()
                whole = np.asarray(pc.fill_null(column.values, np.nan), kind)  # a null component isn't finite
                for size in np.unique(length).tolist():
                    own = np.flatnonzero(length == size)
                    x, good = _unit(whole[edge[own][:, None] + np.arange(size)])
                    own = own[good]
                    raw = pa.array([whole[a : a + size].tobytes() for a in edge[own].tolist()], pa.binary())
                    ids, label, weight = (part.column(n).take(pa.array(own)) for n in ("vec_id", "label", "weight"))
                    for t, code in enumerate(codes_of(x, c, seed).T):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t), pa.int32()), label, pa.array(np.full(len(own), size), pa.int32()), pa.array(code), ids, weight, raw], names=["t", "label", "size", "code", "vec_id", "weight", "x"])

    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").select("vec_id", "label", "embedding", "weight")
    rows = rows.mapInArrow(project, f"t int, label {label}, size int, code long, vec_id long, weight long, x binary")
    cell = ["t", "label", "size", "code"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.join(sizes.select(*cell, chunks.alias("chunks")), cell)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(pairs))

    def match(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, own, weight = (np.asarray(table.column(n)) for n in ("vec_id", "own", "weight"))
        pair = table.column("pair")[0].as_py()
        t = table.column("t")[0].as_py()
        x, _ = _unit(np.frombuffer(b"".join(table.column("x").to_pylist()), kind).reshape(len(ids), -1))
        p = x @ projections(x.shape[1], c, seed)[1].T
        a = np.flatnonzero(own == pair["i"])
        b = np.flatnonzero(own == pair["j"])
        same = pair["i"] == pair["j"]
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(a), 256):
            q = a[at : at + 256]
            i, j = np.nonzero(collisions(p[q], p[b], c.window) >= c.least)
            i, j = q[i], b[j]
            keep = ids[i] < ids[j] if same else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            for lo in range(0, len(i), 1 << 16):
                ii, jj = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                near = np.einsum("nd,nd->n", x[ii], x[jj]) >= cosine
                ii, jj = ii[near], jj[near]
                if t and len(ii):
                    back = np.unique(np.r_[ii, jj])
                    codes = codes_of(x[back], c, seed)[:, :t]
                    new = (codes[np.searchsorted(back, ii)] != codes[np.searchsorted(back, jj)]).all(1)
                    ii, jj = ii[new], jj[new]
                np.add.at(n, ii, weight[jj])
                np.add.at(n, jj, weight[ii])
                unite(root, ii, jj)
        some = n > 0
        return pa.table({"vec_id": pa.array(ids[some]), "other": pa.array(ids[root[some]]), "n": pa.array(n[some])})

    return dealt.groupBy(*cell, "pair").applyInArrow(match, "vec_id long, other long, n long")


def embedding_dedup(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.99) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Links join vectors of one not null label and of one length at the given cosine or above, in double precision; vectors that
    are null, empty, zero, or hold a null or a component that isn't finite link with nothing, and so do rows with a null id.
    Equal vectors of a label are one class, of its smallest id, whatever its size: only classes are compared, and each link of a class counts
    for all its vectors. Every row of a repeated id takes part: its vectors' links are all the id's, whose rows give one result; n_links then adds
    up over its different vectors, so that an id met by two of them counts twice, and its own vectors count where they link each other. Other columns aren't read. The links
    within a block come as trees (each vector with its root), so that components need no pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    good = F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False))).distinct()
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))
    alone = classes.where("weight = 1").select(F.col("first").alias("vec_id"), "rep", "weight")
    member = alone.unionByName(usable.join(classes.where("weight > 1").drop("first"), ["label", "embedding"]).select("vec_id", "rep", "weight"))
    met = checkpoint(near_links(classes.select(F.col("rep").alias("vec_id"), "label", "embedding", "weight"), cosine, recall))
    several = member.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")  # one id, several vectors
    bridges = member.join(several.select("vec_id", "a"), "vec_id").select("a", F.col("rep").alias("b"))
    joined = components(met.select(F.col("vec_id").alias("a"), F.col("other").alias("b")).unionByName(bridges)).withColumnRenamed("id", "rep")
    links = met.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n"))
    placed = member.join(links, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = placed.groupBy("vec_id").agg(F.sum(F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.min("component").alias("component"))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("least"))
    out = rows.select("vec_id").join(ids.join(least, "component"), "vec_id", "left")
    own = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
