"""Operator 12: benchmark passages in documents, found by a generalised suffix automaton of the benchmark's items."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, buffers, checkpoint, lean, lean_batches, slices, span_hashes
from .terms import byte_class, runs

_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

#: Words of an automaton, about: what is broadcast and what a worker holds is bounded by it (some 400 bytes a word).
#: A larger benchmark is divided over several automata, each of which reads the documents once.
MOST_WORDS = 250_000


def item_words(text: str | None) -> list[bytes]:
    """The words of an item, as of a document."""
    data, offsets = buffers(pa.array([text or ""], pa.string()))
    data = LOWER[data]
    starts, ends, _ = runs(_WORD[data], offsets)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """The suffix automaton of several word sequences, that says which windows of them end at a place of another sequence.

    A window is `window` words in a row, or all words of a shorter sequence. Each state stands for the word runs with the same ends
    in the sequences; those are the suffixes of its longest run that are longer than its link's.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary = sorted({w for _, words in items for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        coded = [(name, [number[w] for w in words]) for name, words in items if words]
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        for _, codes in coded:
            state = 0
            for c in codes:
                state = self._extend(state, c)
        # the state at which a run's last `window` words are found, and the nearest on the way up that ends a short sequence
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.whole = [-1] * len(self.length)
        for v in order:
            if self.length[v] >= window:
                self.whole[v] = v if self.length[self.link[v]] < window else self.whole[self.link[v]]
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, dict[int, set[str | None]]] = {}
        for name, codes in coded:
            v = 0
            for i, c in enumerate(codes):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.items.setdefault(self.whole[v], set()).add(name)
            if len(codes) < window:
                self.short.setdefault(v, {}).setdefault(len(codes), set()).add(name)
        self.near = [-1] * len(self.length)
        for v in order:
            self.near[v] = v if v in self.short else self.near[self.link[v]]
        self.least = min([window, *(m for ends in self.short.values() for m in ends)])
        size = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * size + b for _, codes in coded for a, b in zip(codes, codes[1:], strict=False)], np.int64))
        data = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in self.vocabulary], dtype=np.int64)
        hashes = span_hashes(data, np.r_[np.zeros(1, np.int64), ends[:-1]], ends) if size else np.zeros(0, np.uint64)
        by_hash = np.argsort(hashes)
        self.hashes, self.code_of = hashes[by_hash], by_hash
        if len(np.unique(hashes)) < size:
            raise ValueError("two benchmark words share a hash")

    def _new(self, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(out)
        return len(self.length) - 1

    def _divided(self, p: int, c: int) -> int:
        """The state for the runs that p's longest run followed by c ends: q itself, or what q is divided into."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._divided(last, c)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        self.link[state] = self._divided(p, c) if p >= 0 else 0
        return state

    def ends(self, codes: list[int]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(place, words, items) of every window that ends in the sequence; a code below 0 is no benchmark word."""
        v = length = 0
        for i, c in enumerate(codes):
            while v and c not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            if c not in self.next[v]:
                length = 0
                continue
            v = self.next[v][c]
            length += 1
            if length >= self.window:
                yield i, self.window, self.items[self.whole[v]]
            at = self.near[v]
            while at > 0:
                for m, names in self.short[at].items():
                    if m <= length:
                        yield i, m, names
                at = self.near[self.link[at]]

    def coded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of the words by their hashes, -1 where none fits; the bytes are compared for what may hold a window."""
        if not len(starts) or not len(self.hashes):
            return np.full(len(starts), -1)
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.code_of[at], -1)

    def stretches(self, codes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where words of one row follow each other as some item has them, for as many words as the shortest window at least."""
        known = codes >= 0
        joined = np.zeros(len(codes), bool)
        if len(self.pairs) and len(codes):
            key = codes[:-1] * len(self.vocabulary) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == key) & known[1:] & known[:-1] & (row[1:] == row[:-1])
        begins = np.flatnonzero(known & ~joined)
        stops = np.flatnonzero(known & ~np.r_[joined[1:], False][: len(known)]) + 1
        long = stops - begins >= self.least
        return zip(begins[long].tolist(), stops[long].tolist(), strict=True)


def benchmark_parts(benchmark: DataFrame, window: int, most_words: int) -> list[Broadcast]:
    """The automata, each built by a task from about most_words words at most. An item beyond 10,000 words is dealt in pieces that overlap by window - 1."""
    piece = 10_000

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w.decode() for w in item_words(text)]
                cuts = range(0, max(1, len(words) - window + 1), piece) if words else ()
                parts = [words[a : a + piece + window - 1] for a in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(parts, pa.list_(pa.string()))], names=["item", "words"])

    def build(table: pa.Table) -> pa.Table:
        items = [(name, [w.encode() for w in words]) for name, words in zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True)]
        return pa.table({"part": table.column("part").slice(0, 1), "automaton": pa.array([pickle.dumps(Automaton(items, window))], pa.binary())})

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "item string, words array<string>").distinct()
    named = checkpoint(named)
    total = named.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // most_words)
    if not n:
        return []
    parts = named.withColumn("part", F.expr(f"CAST(pmod(xxhash64(item, words), {n}) AS INT)")).groupBy("part").applyInArrow(lean(build), "part int, automaton binary")
    parts = checkpoint(parts)
    spark = benchmark.sparkSession
    return [spark.sparkContext.broadcast(r.automaton) for k in range(n) for r in parts.where(F.col("part") == k).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """docs with `spans` and `items`: the runs of words that lie in windows of benchmark items, and the items' ids in order of strings.

    A span has the numbers of its first word and of the one after its last, and its first byte and the one after its last in the
    text. n_words counts the text's words. Null and empty texts have no words, an item without words no window; an item without
    an id matches but isn't named; repeated items and items of one id count once. Longest matching lengths are followed word by word
    through the automaton; only where neighbouring words follow each other in some item at all. Ids of documents may be null
    or repeated, other columns pass through, those named like a result are replaced; very long texts are handled whole.
    """
    results = ("n_words", "spans", "items")
    docs = docs.drop(*results)
    parts = benchmark_parts(benchmark, window, most_words)
    found = [_matches(docs, part, text, window) for part in parts[:1] or [None]]
    if len(parts) > 1:
        docs = checkpoint(docs.withColumn("_row", F.monotonically_increasing_id()))
        found = [_matches(docs, part, text, window) for part in parts]
        some = found[0]
        for other in found[1:]:
            some = some.unionByName(other)
        merged = some.where("size(spans) > 0").groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("more"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("names"))
        joined = found[0].join(merged, "_row", "left")
        spans = F.expr(
            "aggregate(array_sort(more), CAST(array() AS array<struct<first:long,after:long,from:long,to:long>>), (a, s) -> CASE WHEN size(a) > 0 AND element_at(a, -1).after >= s.first "
            "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'after', greatest(element_at(a, -1).after, s.after), 'from', element_at(a, -1).from, 'to', greatest(element_at(a, -1).to, s.to)))) ELSE concat(a, array(s)) END)"
        )
        return joined.withColumns({"spans": F.when(F.col("more").isNull(), F.col("spans")).otherwise(spans), "items": F.coalesce("names", "items")}).drop("more", "names", "_row").select(*(c for c in docs.columns if c != "_row"), *results)
    return found[0]


def _matches(docs: DataFrame, part: Broadcast | None, text: str, window: int) -> DataFrame:
    schema = docs.select("*").schema
    span = "array<struct<first:long,after:long,from:long,to:long>>"
    made = docs.sparkSession.createDataFrame([], f"n_words long, spans {span}, items array<string>").schema
    for f in made:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([], window) if part is None else pickle.loads(part.value)
        for batch in batches:
            column = batch.column(text)
            for lo, hi in slices(buffers(column)[1]):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *_found(automaton, *buffers(column.slice(lo, hi - lo)))], names=schema.names)

    return docs.mapInArrow(lean_batches(run), schema)


def _found(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    data, n = LOWER[data], len(offsets) - 1
    starts, ends, row = runs(_WORD[data], offsets)
    codes = automaton.coded(data, starts, ends)
    edge = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for lo, hi in automaton.stretches(codes, row):
        own = [c if data[a:b].tobytes() == automaton.vocabulary[c] else -1 for c, a, b in zip(codes[lo:hi].tolist(), starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
        for i, m, names in automaton.ends(own):
            edge[lo + i + 1 - m] += 1
            edge[lo + i + 1] -= 1
            items.setdefault(int(row[lo]), set()).update(names)
    first_word = np.searchsorted(row, np.arange(n + 1))
    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])][: len(hit)]
    begin, stop = hit[new], hit[np.r_[new[1:], True][: len(hit)]] + 1
    of = row[begin]
    at = [begin - first_word[of], stop - first_word[of], starts[begin] - offsets[of], ends[stop - 1] - offsets[of]]
    struct = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in at], names=["first", "after", "from", "to"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), struct)
    named = pa.array([sorted(x for x in items.get(i, ()) if x is not None) for i in range(n)], pa.list_(pa.string()))
    return [pa.array(np.diff(first_word).astype(np.int64)), spans, named]


def n_hit(spans: str = "spans") -> F.Column:
    return F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.after - s.first)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, least_span: int = 10, most_covered: float = 0.5, most_words: int = MOST_WORDS) -> DataFrame:
    """docs with spans of at least least_span words cut out of the text, `kept`, and contamination()'s columns.

    kept is false, and the text as it was, where more than most_covered of the words lie in windows. Items of fewer words than
    least_span are cut out only within longer spans, or with a smaller least_span. Texts without a span to cut stay as they are,
    null texts null; a byte before or after a span stays.
    """
    found = contamination(docs.drop("kept"), benchmark, text, window, most_words)
    found = found.withColumn("kept", n_hit() <= F.col("n_words") * F.lit(most_covered)).withColumn("_long", F.expr(f"filter(spans, s -> s.after - s.first >= {int(least_span)})"))
    binary = f"CAST(`{text}` AS BINARY)"
    # what lies between the spans: from the end of the one before to the start of the next
    clean = f"decode(unhex(array_join(transform(sequence(0, size(_long)), i -> hex(substring({binary}, CAST(IF(i = 0, 0, _long[greatest(i - 1, 0)].to) AS INT) + 1, CAST(IF(i = size(_long), octet_length(`{text}`), _long[least(i, size(_long) - 1)].from) - IF(i = 0, 0, _long[greatest(i - 1, 0)].to) AS INT)))), '')), 'UTF-8')"
    return found.withColumn(text, F.when(F.col("kept") & (F.size("_long") > 0), F.expr(clean)).otherwise(F.col(text))).drop("_long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
m AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, (len(ws) - least(len(ws), 10) + 2)::BIGINT)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT DISTINCT m FROM m),
g AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM (SELECT doc_id, ws, m, unnest(range(1, (len(ws) - m + 2)::BIGINT)) AS i FROM d, s WHERE len(ws) >= m)),
h AS (SELECT doc_id, i, g.m, item_id FROM g JOIN m ON m.m = g.m AND m.w = g.w),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY ALL)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
