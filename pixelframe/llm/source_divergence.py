"""Operator 11: how the sources of a language differ in their words, from bitmaps of term ids by (group, count)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, checkpoint, lean, lean_batches, slices
from .terms import byte_class, distinct, runs, strings

_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
COUNTS = "lang string, source string, term string, n long, docs long"

#: Bits of a bitmap (what bitmap_construct_agg makes), terms dealt to a chunk on average, and terms from which a count has a bitmap and not a list of ids.
BITS, CHUNK, DENSE = 32768, 16384, 256
#: Sources of a tile's side: a task holds two sides of one chunk, so that its memory doesn't grow with the number of sources.
SIDE = 32


def _slice_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a slice's rows; group: a code for each row."""
    data = LOWER[data]
    starts, ends, row = runs(_LETTER[data], offsets)
    codes, first = distinct(data, starts, ends)
    size = max(len(first), 1)
    seen, times = np.unique(row * size + codes, return_counts=True)
    key, back = np.unique(group[seen // size] * size + seen % size, return_inverse=True)
    n = np.bincount(back, times, len(key)).astype(np.int64)
    docs = np.bincount(back, minlength=len(key)).astype(np.int64)
    rep = first[key % size] if len(key) else np.zeros(0, np.int64)
    return key // size, strings(data, starts[rep], ends[rep]), n, docs


def _filled(column: pa.Array) -> pa.DictionaryArray:
    return column.cast(pa.string()).fill_null("").dictionary_encode()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and rows that hold it; each group also has a row of the null term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = _filled(batch.column("lang")), _filled(batch.column("source"))
            names = [(a, b) for a in lang.dictionary.to_pylist() for b in source.dictionary.to_pylist()]
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            column = batch.column("text")
            parts = [(np.unique(group), None, None, None)]
            parts += [_slice_counts(*buffers(column.slice(lo, hi - lo)), group[lo:hi]) for lo, hi in slices(buffers(column)[1])]
            for at, term, n, held in parts:
                a, b = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
                zero = np.zeros(len(at), np.int64)
                term = pa.nulls(len(at), pa.string()) if term is None else term
                yield pa.RecordBatch.from_arrays([a.take(pa.array(at)), b.take(pa.array(at)), term, pa.array(zero if n is None else n), pa.array(zero if held is None else held)], names=["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(lean_batches(count), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """The counts of terms that at least least_docs of their language's documents hold, and the rows of the null term.

    lang_n: the term's occurrences in the language; lead: 1 in one row of each (lang, term).
    """
    same = Window.partitionBy("lang", "term")
    whole = counts.withColumns({"lang_docs": F.sum("docs").over(same), "lang_n": F.sum("n").over(same), "lead": F.when(F.row_number().over(same.orderBy("source")) == 1, 1).otherwise(0)})
    return whole.where(f"term IS NULL OR lang_docs >= {int(least_docs)}").drop("docs", "lang_docs")


def share(n: str, total: str) -> F.Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * v)), exactly: products beyond 64 bits are decimals."""
    return F.expr(f"1 + CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 5 AS DECIMAL(19,0)) DIV CAST({total} + 5 * v AS DECIMAL(19,0))")


def group_totals(kept: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_lang, v): kept occurrences in the group and in its language, and the language's number of kept terms."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum(F.when(F.col("term").isNotNull(), F.col("lead")).otherwise(0)).alias("leads"))
    langs = groups.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("leads").alias("v"), F.count("*").alias("sources"))
    return groups.drop("leads").join(langs, "lang")


def count_bitmaps(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, chunk, part, source, n, p, ids, bits, terms): the terms that a group has n times, as a bitmap or, of fewer than DENSE, as ids.

    Terms are numbered within chunks of their language, to which a hash deals them. Each group has a row of n = 0 for each chunk,
    with neither: those terms are the complement of all its others among the chunk's `terms`.
    """
    terms = kept.where("term IS NOT NULL").join(totals, ["lang", "source"]).withColumn("p", share("n", "n_group"))
    numbered = terms.withColumn("chunk", F.expr(f"CAST(pmod(xxhash64(term), CAST(ceil(v / {CHUNK}) AS BIGINT)) AS INT)"))
    numbered = numbered.withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    numbered = numbered.withColumns({"part": F.expr(f"CAST(at DIV {BITS} AS INT)"), "id": F.expr(f"CAST(at % {BITS} AS INT)")})
    levels = numbered.groupBy("lang", "chunk", "part", "source", "n", "p").agg(F.collect_list("id").alias("ids"), F.expr("bitmap_construct_agg(id)").alias("bits"))
    few = F.size("ids") < DENSE
    levels = levels.select("lang", "chunk", "part", "source", "n", "p", F.when(few, F.col("ids")).alias("ids"), F.when(~few, F.col("bits")).alias("bits"), F.lit(None).cast("int").alias("terms"))
    sizes = numbered.groupBy("lang", "chunk", "part").agg((F.max("id") + 1).alias("terms"))
    zero = totals.where("v > 0").withColumn("n", F.lit(0).cast("long")).withColumn("p", share("n", "n_group")).join(sizes, "lang")
    return levels.unionByName(zero.select("lang", "chunk", "part", "source", "n", "p", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("binary").alias("bits"), "terms"))


class Levels:
    """The counts of one source in a chunk: p of each level (0: the count 0), the level of each term, and the bitmaps of the large ones."""

    def __init__(self, terms: int) -> None:
        self.p, self.level = [0], np.zeros(terms, np.int32)
        self.dense, self.bits, self.sparse = [], [], []

    def add(self, p: int, ids: np.ndarray | None, bits: bytes | None) -> None:
        k = len(self.p)
        self.p.append(p)
        if ids is not None:
            self.sparse.append(ids)
        else:
            self.dense.append(k)
            self.bits.append(np.frombuffer(bits, np.uint64))
            ids = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
        self.level[ids] = k

    def close(self) -> Levels:
        self.p = np.array(self.p, np.int64)
        self.bits = np.array(self.bits, np.uint64).reshape(len(self.dense), BITS // 64)
        self.size = np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.dense = np.array(self.dense, np.int64)
        self.sparse = np.concatenate(self.sparse) if self.sparse else np.zeros(0, np.int64)
        self.is_dense = np.zeros(len(self.p), bool)
        self.is_dense[self.dense] = True
        return self


def joint(a: Levels, b: Levels) -> int:
    """Sum of |p - q| over a chunk's terms: the number of terms in each cell of (count in a, count in b), times the cell's difference.

    Cells of two bitmaps by AND and population count; those with a short list by looking its ids up; what is left of each bitmap,
    and of the chunk, has the count 0 on the other side, or on both.
    """
    both = np.array([np.bitwise_count(row & b.bits).sum(1) for row in a.bits], np.int64).reshape(len(a.dense), len(b.dense))
    value = int((both * np.abs(a.p[a.dense][:, None] - b.p[b.dense][None, :])).sum())
    x, y = a.level[a.sparse], b.level[a.sparse]
    value += int(np.abs(a.p[x] - b.p[y]).sum())
    rest = b.sparse[a.is_dense[a.level[b.sparse]] | (a.level[b.sparse] == 0)]
    u, w = a.level[rest], b.level[rest]
    value += int(np.abs(a.p[u] - b.p[w]).sum())
    only_a = a.size - both.sum(1) - np.bincount(u, minlength=len(a.p))[a.dense]
    only_b = b.size - both.sum(0) - np.bincount(y, minlength=len(b.p))[b.dense]
    value += int((only_a * np.abs(a.p[a.dense] - b.p[0])).sum()) + int((only_b * np.abs(b.p[b.dense] - a.p[0])).sum())
    none = len(a.level) - int(both.sum()) - len(x) - len(u) - int(only_a.sum()) - int(only_b.sum())
    return value + none * abs(int(a.p[0]) - int(b.p[0]))


def _tile(table: pa.Table) -> pa.Table:
    """Partial sums of all pairs of a tile of sources in one chunk."""
    one, other = table.column("one")[0].as_py(), table.column("other")[0].as_py()
    sides: dict[str, tuple[int, Levels]] = {}
    zero = table.filter(table.column("terms").is_valid())
    for source, side, p, terms in zip(*(zero.column(c).to_pylist() for c in ("source", "side", "p", "terms")), strict=True):
        sides[source] = side, Levels(terms)
        sides[source][1].p[0] = p
    for batch in table.filter(table.column("terms").is_null()).to_batches(max_chunksize=1024):
        lists = batch.column("ids")
        for i, (source, p, bits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "p", "bits")), strict=True)):
            sides[source][1].add(p, lists[i].values.to_numpy() if lists[i].is_valid else None, bits)
    held = sorted((s, name, x.close()) for name, (s, x) in sides.items())
    pairs = [(a, b, joint(x, y)) for i, (s, a, x) in enumerate(held) for t, b, y in held[i + 1 :] if {s, t} == {one, other}]
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "a": pa.array([x for x, _, _ in pairs], pa.string()), "b": pa.array([x for _, x, _ in pairs], pa.string()), "value": pa.array([x for *_, x in pairs], pa.int64())})


def pair_divergence(bitmaps: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of each pair of sources of a language, both ways."""
    sides = F.expr(f"CAST(ceil(sources / {SIDE}) AS INT)")
    where = totals.select("lang", "source", sides.alias("sides")).withColumn("side", F.expr("CAST(pmod(xxhash64(source), sides) AS INT)"))
    tiles = bitmaps.join(where, ["lang", "source"]).withColumn("with_side", F.explode(F.expr("sequence(0, sides - 1)")))
    tiles = tiles.withColumns({"one": F.least("side", "with_side"), "other": F.greatest("side", "with_side")}).drop("sides", "with_side")
    sums = tiles.groupBy("lang", "chunk", "part", "one", "other").applyInArrow(lean(_tile), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    found = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))
    named = totals.select("lang", "source")
    none = totals.where("v = 0").select("lang", "source").join(named.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return found.unionByName(none)


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language lies from the others, and by which terms from the language.

    Null text, lang and source are ''. Each row is a document, whatever its id, so that repeated rows count again; other columns
    aren't read. Sources without terms have p of count 0 throughout; a language without kept terms gives pairs of value 0 and no
    terms; an empty table gives no rows. Long texts are counted whole. Ties of a value go by the item.
    """
    kept = checkpoint(kept_terms(term_counts(docs), least_docs))
    totals = checkpoint(group_totals(kept))
    pairs = pair_divergence(count_bitmaps(kept, totals), totals)
    terms = kept.where("term IS NOT NULL").join(totals, ["lang", "source"]).withColumn("value", share("n", "n_group") - share("lang_n", "n_lang")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").union(ranked(terms.withColumnRenamed("term", "item"), "term").where(F.col("rank") <= int(top)))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT i, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(s.n, 0)::HUGEINT AS gn, coalesce(l.n, 0)::HUGEINT AS ln, coalesce(l.v, 0)::HUGEINT AS v FROM g
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN (SELECT lang, sum(ln) AS n, count(*) AS v FROM k GROUP BY ALL) l ON l.lang = g.lang),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.gn + 5 * t.v) AS p, 1 + (1000000000::HUGEINT * (k.ln + 5)) // (t.ln + 5 * t.v) AS q
      FROM t JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
e AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM b
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM e) WHERE rank <= 50"""
