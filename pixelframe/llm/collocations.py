"""Operator 13: collocations of two and three words, mined by dynamic itemset counting over shards of the corpus."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, by_place, checkpoint, discard, lean_batches, lean_pair, mix, partitions, scratch, slices, span_hashes
from .terms import byte_class, distinct, runs, strings

_BLANK = byte_class((0x09, 0x09), (0x20, 0x20))
_CUT = byte_class((0x0A, 0x0D)) | np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_U = np.uint64

#: Shards of a cycle, cells (a byte each, 2**TABLE) that tell the workers from which step on a phrase is taken up, and distinct keys after which a worker sends its counts.
SHARDS, TABLE, HELD = 4, 23, 1 << 21
#: The last circle has so many more bits of cells, a bit each.
FINER = 3
#: Keys are these bits: enough to tell nearly all phrases apart, while the last circle counts texts.
_KEY = _U(0xFFFFFFFFFFFF0000)
NEVER = 255
COUNTED = "bucket int, words int, n_keys int, keys binary, counts binary, steps binary"


class Grams:
    """The words of a slice's rows, and which neighbours stand in one piece. Keys are of the language and the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> None:
        self.data = LOWER[data]
        cut = _CUT[self.data]
        self.starts, self.ends, self.row = runs(~(cut | _BLANK[self.data]), offsets)
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(cut, out=before[1:])
        piece = before[self.starts]
        self.joined = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        self.one = mix(span_hashes(self.data, self.starts, self.ends) + mix(lang[self.row])) & _KEY
        self.two = mix(self.one[:-1] * _U(0x9E3779B97F4A7C15) + self.one[1:]) & _KEY  # of the word and the next, where joined
        self.three = mix(self.two[:-1] * _U(0xC2B2AE3D27D4EB4F) + self.one[2:]) & _KEY
        self.joined3 = self.joined[:-1] & self.joined[1:]


def cells(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Cells of a table, a power of two long: by the keys' leading bits, so that a range of keys has a range of cells."""
    return (keys >> _U(65 - len(table).bit_length())).astype(np.int64)


def flagged(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the keys' cells, here bits of a row of bytes, are set."""
    at = (keys >> _U(62 - len(bits).bit_length())).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def lang_keys(column: pa.Array) -> np.ndarray:
    """A key of each row's language; null is `und`."""
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    data, offsets = buffers(coded.dictionary)
    return span_hashes(data, offsets[:-1], offsets[1:])[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)


def _active(since: np.ndarray, step: int, shards: int) -> np.ndarray:
    """Whether phrases that are taken up at the steps `since` are counted at this one: for a full cycle."""
    return (since <= step) & (step < since.astype(np.int64) + shards)


def _counts(g: Grams, step: int, shards: int, ready: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, keys, counts, steps) of the phrases that are active at the step: a phrase starts when both its parts are ready."""
    if step < shards:
        keys, n = np.unique(g.one, return_counts=True)
        yield 1, keys, n, np.zeros(len(keys), np.uint8)
    for words, keys, joined, parts in ((2, g.two, g.joined, g.one), (3, g.three, g.joined3, g.two)):
        if not len(keys):
            continue
        at = ready[words - 1][cells(parts, ready[words - 1])]
        since = np.maximum(at[:-1], at[1:])
        on = joined & _active(since, step, shards)
        keys, first, n = np.unique(keys[on], return_index=True, return_counts=True)
        yield words, keys, n, since[on][first]


def _packed(keys: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Sorted keys and their counts, bytes of one weight together, compressed."""
    flat = lambda x, kind: pa.compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)
    return len(keys), flat(np.diff(keys, prepend=_U(0)), ">u8"), flat(counts, ">u8"), flat(steps, np.uint8)


def _unpacked(n: int, keys: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    back = lambda raw, size: np.ascontiguousarray(np.frombuffer(pa.decompress(raw, size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T).reshape(-1)
    return np.cumsum(back(keys, 8).view(">u8").astype(np.uint64), dtype=np.uint64), back(counts, 8).view(">u8").astype(np.int64), back(steps, 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts, steps = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else counts, steps[order][first]


def scan(shard: DataFrame, step: int, shards: int, ready: Broadcast, buckets: int) -> DataFrame:
    """The active phrases of a shard and their counts, a row for each task and bucket of keys (and for each HELD distinct ones)."""

    def sent(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        out = []
        for words, parts in held.items():
            keys, counts, steps = _summed(parts)
            edges = np.searchsorted((keys >> _U(32)) * _U(buckets) >> _U(32), np.arange(buckets + 1).astype(np.uint64))
            out += [(b, words, *_packed(keys[lo:hi], counts[lo:hi], steps[lo:hi])) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if hi > lo]
        yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = ready.value, defaultdict(list), 0
        for batch in batches:
            column, lang = batch.column("text"), lang_keys(batch.column("lang"))
            for lo, hi in slices(buffers(column)[1]):
                for words, *found in _counts(Grams(*buffers(column.slice(lo, hi - lo)), lang[lo:hi]), step, shards, tables):
                    held[words].append(tuple(found))
                    size += len(found[0])
                if size > HELD:
                    held = defaultdict(list, {w: [_summed(parts)] for w, parts in held.items()})
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if 2 * size > HELD:
                        yield from sent(held)
                        held, size = defaultdict(list), 0
        yield from sent(held)

    return shard.select("lang", "text").mapInArrow(lean_batches(run), COUNTED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "words", "n_keys", "keys", "counts", "steps"])


def merged(state: DataFrame | None, counted: DataFrame, step: int, shards: int, least: int) -> DataFrame:
    """The counters with a step's counts added. Those that have completed their cycle below `least` are dropped."""

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        held, out = defaultdict(list), []
        for table in (left, right):
            for bucket, words, *raw in zip(*(table.column(c).to_pylist() for c in ("bucket", "words", "n_keys", "keys", "counts", "steps")), strict=True):
                held[words].append(_unpacked(*raw))
                at = bucket
        for words, parts in held.items():
            keys, counts, steps = _summed(parts)
            stay = (counts >= least) | (step + 1 < steps.astype(np.int64) + shards)
            if stay.any():
                out.append((at, words, *_packed(keys[stay], counts[stay], steps[stay])))
        return pa.Table.from_batches([_rows(out)])

    counted = by_place(counted, "bucket")
    before = by_place(state, "bucket") if state is not None else counted.where("false")
    return checkpoint(before.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(lean_pair(merge), COUNTED))


def reached(state: DataFrame, words: list[int], least: int, table: int) -> dict[int, np.ndarray]:
    """For each number of words, a bit for each cell: whether a key in it is counted `least` times. Each bucket sends the bits of its own range, 2**table in all."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, *raw in zip(*(batch.column(c).to_pylist() for c in ("words", "n_keys", "keys", "counts", "steps")), strict=True):
                keys, counts, _ = _unpacked(*raw)
                at = (keys[counts >= least] >> _U(64 - table)).astype(np.int64)
                if len(at):
                    low = int(at[0]) >> 3
                    own = np.zeros((int(at[-1]) >> 3) - low + 1 << 3, bool)
                    own[at - (low << 3)] = True
                    out.append((n, low, pa.compress(np.packbits(own).tobytes(), codec="zstd", asbytes=True), len(own) >> 3))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.int32()))], names=["words", "low", "bits", "size"])

    flags = {n: np.zeros(1 << table - 3, np.uint8) for n in words}
    for r in state.where(F.col("words").isin(words)).mapInArrow(mark, "words int, low long, bits binary, size int").collect():  # bounded by the table, whatever the corpus
        flags[r.words][r.low : r.low + r.size] |= np.frombuffer(pa.decompress(bytes(r.bits), r.size, codec="zstd", asbytes=True), np.uint8)
    return flags


def named(docs: DataFrame, frequent: Broadcast, least: int) -> DataFrame:
    """(lang, words, phrase, f): the phrases whose cells are flagged, counted as texts; 0 words: all of a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = frequent.value
        for batch in batches:
            column, coded = batch.column("text"), batch.column("lang").cast(pa.string()).fill_null("und").dictionary_encode()
            keys, lang = lang_keys(batch.column("lang")), coded.indices.to_numpy().astype(np.int64)
            for lo, hi in slices(buffers(column)[1]):
                yield from _named(Grams(*buffers(column.slice(lo, hi - lo)), keys[lo:hi]), lang[lo:hi], coded.dictionary, flags)

    counts = docs.select("lang", "text").mapInArrow(lean_batches(run), "lang string, words int, phrase string, f long")
    return counts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("words") > 0, int(least)).otherwise(0))


def _named(g: Grams, lang: np.ndarray, langs: pa.Array, flags: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    codes, first = distinct(g.data, g.starts, g.ends)
    words, size, of = strings(g.data, g.starts[first], g.ends[first]), max(len(first), 1), lang[g.row]
    at, n = np.unique(of, return_counts=True)
    yield _phrases(langs, at, 0, pa.nulls(len(at), pa.string()), n)
    parts_on = np.ones(len(codes) + 1, bool)
    for k, keys, joined in ((1, g.one, np.ones(len(codes), bool)), (2, g.two, g.joined), (3, g.three, g.joined3)):
        # a phrase is as frequent as its parts at most: both must be flagged too
        parts_on = joined & parts_on[:-1] & parts_on[1:] & flagged(keys, flags[k]) if len(keys) else np.zeros(0, bool)
        on = np.flatnonzero(parts_on)
        code = of[on]
        if len(langs) * size**k < 1 << 62:  # the phrase as one number
            for i in range(k):
                code = code * size + codes[on + i]
            _, at, n = np.unique(code, return_index=True, return_counts=True)
        else:
            _, at, n = np.unique(np.stack([code, *(codes[on + i] for i in range(k))]), axis=1, return_index=True, return_counts=True)
        at = on[at]
        parts = [words.take(pa.array(codes[at + i])) for i in range(k)]
        yield _phrases(langs, of[at], k, parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " "), n)


def _phrases(langs: pa.Array, at: np.ndarray, words: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.take(pa.array(at)), pa.array(np.full(len(at), words, np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "f"])


def phrase_counts(docs: DataFrame, least: int = 10, shards: int = SHARDS, table: int = TABLE) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of one to three words that stands `least` times or more in its language, and of 0 words the language's words.

    The rows are written to `shards` shards, which are scanned in a circle. Words are counted from the first step on; a longer
    phrase is taken up at the step after both its parts (without the last word, and without the first) have reached `least`, and
    counted for one full circle, so that short and long phrases are counted in the same scans. The counters are 64-bit keys in
    buckets, each a row, merged with each step's counts; what ends its circle below `least` goes. Workers learn what is
    ready from a table of 2**table cells, whatever the size of the corpus: a cell that several keys share is ready with the first, which
    takes phrases up too early, never too late, and the same for all workers. A last circle counts what remains as texts, so that
    neither shared cells nor equal keys of different phrases are left in the result.
    """
    spark, buckets = docs.sparkSession, 2 * partitions(docs.sparkSession)
    place = scratch(docs, "shards")
    dealt = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text", F.expr(f"CAST(pmod(monotonically_increasing_id(), {int(shards)}) AS INT)").alias("shard"))
    dealt.where("text IS NOT NULL").write.option("compression", "zstd").partitionBy("shard").parquet(place)
    corpus = spark.read.schema("lang string, text string, shard int").parquet(place)
    ready = {n: np.full(1 << table, NEVER, np.uint8) for n in (1, 2)}
    state, step, last = None, 0, shards
    while step < last:
        tables = spark.sparkContext.broadcast(ready)
        state = merged(state, scan(corpus.where(F.col("shard") == step % shards), step, shards, tables, buckets), step, shards, least)
        step += 1
        for n, flags in reached(state, [1, 2], least, table).items():
            if (new := np.unpackbits(flags).astype(bool) & (ready[n] == NEVER)).any():
                ready[n] = np.where(new, np.uint8(step), ready[n])
                last = max(last, step + shards)
        tables.destroy()
    frequent = spark.sparkContext.broadcast(reached(state, [1, 2, 3], least, table + FINER))
    counts = checkpoint(named(corpus, frequent, least))
    frequent.destroy()
    discard(spark, place)
    return counts


def score(a: str, first: str, rest: str) -> F.Column:
    """floor(10**6 * a * a / (first * rest)), in decimals: the products pass 64 bits."""
    d = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    return F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * ({d(a)} * {d(a)}) DIV ({d(first)} * {d(rest)})")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """Each language's phrases of two and three words by how closely their parts go together: lang, rank, phrase, a, l, r, n, score.

    Null lang is `und` and null text empty; each row is a document whatever its id, repeated rows count again; very long texts are
    read whole; other columns aren't read; an empty table gives no rows. A phrase goes if a longer one around it has half of its occurrences.
    Of cuts with one score the first counts; ties of phrases go by a and then by the phrase's bytes.
    """
    counts = phrase_counts(docs, least, shards)
    long = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cut = long.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumns({"first": F.expr("array_join(slice(w, 1, k), ' ')"), "rest": F.expr("array_join(slice(w, k + 1, words - k), ' ')")})
    part = lambda name, as_: counts.where("words IN (1, 2)").select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn("score", score("f", "l", "r"))
    best = cut.groupBy("lang", "words", "phrase", F.col("f").alias("a")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = counts.where("words = 3").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(F.expr("array(array_join(slice(w, 1, 2), ' '), array_join(slice(w, 2, 2), ' '))")).alias("phrase"), F.col("f").alias("around"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    free = best.join(inside, ["lang", "phrase"], "left").where("around IS NULL OR 100 * around < 50 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= int(top))
    all_words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS i, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece
      FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, (len(ws) - k + 2)::BIGINT)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY ALL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
u AS (SELECT lang, k AS m, phrase, f AS a, unnest(range(1, k)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
c AS (SELECT u.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f)) AS score FROM u
      JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[:u.k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[u.k + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM u WHERE m = 3) GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
