"""Operator 8: packing by non-negative least squares over length combinations."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import LOWER, buffers, checkpoint, lean_batches, partitions, slices, span_hashes, words

#: White space beyond ASCII as the tokenizer drops it (Unicode White_Space), in UTF-8: no token spans it.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Units that a worker keeps; beyond that it starts anew.
CACHE = 1_000_000
#: Rows of one length that are numbered together.
PART_ROWS = 500_000

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())])


#: The vocabulary's own split of a word into pieces (fixed value).
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Letters that normalisation leaves alone but for their case.
PLAIN = re.compile("[\x21-\xff]*")
#: Kinds of bytes: 0 other signs, 1 letters, 2 digits, 3 the first byte of a two-byte letter or sign, 4 what a word is handled whole for (an apostrophe, control characters, the first byte of a character beyond U+00FF).
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[[0xC2, 0xC3]] = 3
KIND[[*range(9), *range(14, 32), 0x27, 0x7F, *range(0xC4, 256)]] = 4
#: By the second byte after C3: the signs; after C2: all but the signs are handled whole.
SIGNS_C3 = np.isin(np.arange(256), [0x97, 0xB7])
WHOLE_C2 = np.isin(np.arange(256), [*range(0x80, 0xA1), 0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the vocabulary encodes by itself: (bytes in lower case, starts, ends, word, plain) of each unit.

    A word of signs, Latin letters and digits falls into runs of letters, runs of signs and single digits; another word is a unit as it stands.
    """
    kind, low = KIND[data], LOWER[data]
    lead = np.flatnonzero(kind == 3)
    second = data[lead + 1]
    is_c3 = data[lead] == 0xC3
    kind[lead] = kind[lead + 1] = np.where(is_c3, ~SIGNS_C3[second], np.where(WHOLE_C2[second], 4, 0)).astype(np.uint8)
    low[lead + 1] += np.where(is_c3 & (second >= 0x80) & (second <= 0x9E) & (second != 0x97), 32, 0).astype(np.uint8)
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == 4, out=odd[1:])
    odd = odd[ends] > odd[starts]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[odd]] += 1
    edge[ends[odd]] -= 1
    whole = np.cumsum(edge[:-1]).astype(bool)
    low[whole] = data[whole]
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inner = (data & 0xC0) == 0x80  # never between the bytes of a letter
    begins &= ~whole & ~inner
    begins[starts] = True
    edge[:] = 0
    edge[starts] += 1
    edge[ends] -= 1
    at = np.flatnonzero(begins & np.cumsum(edge[:-1]).astype(bool))
    word = np.searchsorted(starts, at, "right") - 1
    return low, at, np.minimum(np.r_[at[1:], len(data)], ends[word]), word, ~odd[word]


class WordEncoder:
    """Ids of whole texts; the library encodes each new unit (see units()) once, many at a time.

    Units are known by their 64-bit hashes in an open table of numpy arrays (some 60 bytes a unit), so that those of a slice are
    looked up all at once.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear(CACHE)

    def _clear(self, most: int) -> None:
        self.most, self.n = most, 0
        self.mask = (1 << (4 * most - 1).bit_length()) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        self.hash, self.start, self.size = np.zeros(most, np.uint64), np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.flat, self.used = np.zeros(4 * most, np.uint32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's word, -1 if it is new."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        found = self.slot[at]
        rest = np.flatnonzero((found >= 0) & (self.hash[found] != h))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found[rest] = self.slot[at[rest]]
            rest = rest[(found[rest] >= 0) & (self.hash[found[rest]] != h[rest])]
        return found

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(end, len(self.flat)), np.uint32)])
        self.flat[self.used : end] = ids
        own = slice(self.n, self.n + len(hashes))
        self.hash[own], self.size[own] = hashes, sizes
        self.start[own] = self.used + np.cumsum(sizes) - sizes
        slot, mask = self.slot, self.mask
        for i, at in enumerate((hashes & np.uint64(mask)).tolist(), self.n):
            while slot[at] >= 0:
                at = (at + 1) & mask
            slot[at] = i
        self.n, self.used = self.n + len(hashes), end

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8), and how many each text has.

        Special strings are cut out before anything else, wherever they stand: texts with one go to the library whole.
        """
        raw = data.tobytes()
        whole = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for s in self.special for m in re.finditer(re.escape(s), raw)}
        if WIDE_SPACE.search(raw):
            data = np.frombuffer(WIDE_SPACE.sub(lambda m: b" " * len(m[0]), raw), np.uint8)
        starts, ends, row = words(data, offsets)
        if whole:
            keep = ~np.isin(row, list(whole))
            starts, ends, row = starts[keep], ends[keep], row[keep]
        low, starts, ends, word, plain = units(data, starts, ends)
        row = row[word]
        h = span_hashes(low, starts, ends)
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            lost, first = np.unique(h[new], return_index=True)
            first = new[first]
            if self.n + len(lost) > self.most:
                lost, first = np.unique(h, return_index=True)
                self._clear(max(CACHE, len(lost)))
            text = low.tobytes()
            for kind, learn in ((True, self._learn_plain), (False, self._learn)):
                own = plain[first] == kind
                if own.any():
                    self._add(lost[own], *learn([text[a:b].decode() for a, b in zip(starts[first[own]].tolist(), ends[first[own]].tolist(), strict=True)]))
            at = self._find(h)
        size = self.size[at]
        place = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids, count = self.flat[place], np.bincount(row, size, len(offsets) - 1).astype(np.int64)
        for r in sorted(whole):
            own = np.asarray(self.tokenizer.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            before = int(count[:r].sum())
            ids, count[r] = np.concatenate([ids[:before], own, ids[before:]]), len(own)
        return ids, count

    def _learn_plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of units of Latin text, many in one text for the library."""
        sizes, ids = [], []
        for at in range(0, len(parts), 2000):
            part = parts[at : at + 2000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            edges = np.r_[np.flatnonzero(np.diff(np.asarray(e.word_ids), prepend=-1)), len(e.ids)]
            if len(edges) != len(part) + 1:
                raise ValueError("the vocabulary splits words in another way than expected")
            sizes.append(np.diff(edges))
            ids.append(np.asarray(e.ids, np.uint32))
        return np.concatenate(sizes), np.concatenate(ids)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words as they stand."""
        split = {w: PIECE.findall(w.lower()) for w in words if PLAIN.fullmatch(w)}
        parts = list({p for ps in split.values() for p in ps})
        pieces: dict[str, np.ndarray] = {}
        if parts:
            sizes, flat = self._learn_plain(parts)
            pieces = dict(zip(parts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True))
        none = np.zeros(0, np.uint32)
        own = [np.concatenate([none, *(pieces[p] for p in split[w])]) if w in split else np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in words]
        return np.array([len(x) for x in own]), np.concatenate(own)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(docs: DataFrame, window: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) of each text's ids and the end id: whole windows, then what is left.

    Null and empty texts have the end id alone. Texts are encoded whole, row by row; ids may be null or repeated.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in slices(buffers(column)[1]):
                ids, count = encoder(path).encode(*buffers(column.slice(lo, hi - lo)))
                ids = np.insert(ids, np.cumsum(count), end_id).astype("<u4").tobytes()
                count += 1
                begin = 4 * (np.cumsum(count) - count)
                out: list[tuple] = []
                for doc, n, b in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), count.tolist(), begin.tolist(), strict=True):
                    out += ((doc, at, min(window, n - at), zlib.crc32(ids[b + 4 * at : b + 4 * min(at + window, n)]), n) for at in range(0, n, window))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean_batches(run), PIECES)


def combinations(have: np.ndarray, window: int, partners: int = 12) -> list[tuple[int, ...]]:
    """Shallow combinations (two to four lengths) that fill the window, for lengths that occur.

    Each length is completed by its exact partner, by one of `partners` lengths spread over those that occur and
    the length then missing, and by two of a third of these; so there are some 28 combinations for each length at most, however many rows the input has.
    """
    lengths = np.flatnonzero(have)
    lengths = lengths[(lengths > 0) & (lengths < window)]
    if not len(lengths):
        return []
    occurs = have > 0
    spread = lengths[np.unique(np.linspace(0, len(lengths) - 1, min(len(lengths), partners)).astype(int))].tolist()
    found: set[tuple[int, ...]] = set()
    for other in [(), *((b,) for b in spread), *((b, c) for b in spread[::3] for c in spread[::3])]:
        rest = window - sum(other) - lengths
        good = rest > 0
        good[good] = occurs[rest[good]]
        found.update(tuple(sorted((a, *other, last))) for a, last in zip(lengths[good].tolist(), rest[good].tolist(), strict=True))
    return sorted(found, key=lambda c: (len(c), c))


def least_squares(combos: list[tuple[int, ...]], have: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeats x >= 0 of the combinations that come nearest to the histogram: accelerated projected gradient."""
    depth = max(map(len, combos))
    size = len(have)
    index = np.full((len(combos), depth), size)  # one row past the histogram takes the padding
    for i, c in enumerate(combos):
        index[i, : len(c)] = c
    h = np.r_[have.astype(float), 0.0]
    real = (index < size).astype(float)
    # a bound of the largest eigenvalue: rows and columns of the 0/1 matrix
    used = np.bincount(index.ravel(), real.ravel(), size + 1)
    step = 1.0 / max(1.0, float((used[index] * real).sum(1).max()))
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        gap = np.bincount(index.ravel(), (y[:, None] * real).ravel(), size + 1) - h
        new = np.maximum(0, y - step * (gap[index] * real).sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(have: np.ndarray, window: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and their repeats that use up the histogram: rounded least squares, then greedy ones for the rest.

    The greedy ones take the longest length left and add the longest that fit, as often as the lengths last.
    """
    left = have.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(left, window)
    if combos:
        x = least_squares(combos, left)
        for i in np.argsort(-x, kind="stable").tolist():
            c = combos[i]
            n = min(int(np.floor(x[i] + 0.5)), *(int(left[v]) // c.count(v) for v in c))
            if n > 0:
                out.append((c, n))
                for v in c:
                    left[v] -= n
    while left.any():
        chosen: list[int] = []
        room, free = window, left.copy()
        while room > 0 and (fits := np.flatnonzero(free[: room + 1])).size:
            v = int(fits[-1])
            k = min(int(free[v]), room // v)
            chosen += [v] * k
            free[v] -= k
            room -= v * k
        n = min(int(left[v]) // chosen.count(v) for v in set(chosen))
        out.append((tuple(chosen), n))
        for v in chosen:
            left[v] -= n
    return out


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """pieces (any columns with doc_id, start, length <= window and ids_crc32) with sequence_id and offset.

    Only the histogram of lengths (window numbers) reaches the driver, and only the plan goes back. Its
    rows depend on the window and not on the input: at most five slots for each combination of a bounded
    list and one run for each greedy pattern's length. Pieces of a length are numbered in parts of PART_ROWS rows at most on average (a common length in as many parts as there are partitions), whose
    sizes give each part its first number.
    """
    spark = pieces.sparkSession
    have = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        have[r["length"]] = r["count"]
    shares = spark.createDataFrame([(int(v), max(1, int(-(-have[v] // PART_ROWS)), min(partitions(spark), int(have[v]) // 64))) for v in np.flatnonzero(have)], "length long, _parts int")
    pieces = pieces.join(F.broadcast(shares), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), "_parts").cast("int")).select(*pieces.columns, "_part")
    sizes = pieces.groupBy("length", "_part").agg(F.count("*").alias("_size"))
    slots, used, sequence = [], np.zeros(window + 1, np.int64), 0
    for combo, n in plan(have, window):
        at = 0
        i = 0
        while i < len(combo):
            v = combo[i]
            k = 1
            while i + k < len(combo) and combo[i + k] == v:
                k += 1
            slots.append((v, int(used[v]), n * k, k, sequence, at))
            used[v] += n * k
            at += v * k
            i += k
        sequence += n
    table = spark.createDataFrame(slots, "length long, _from long, _count long, _each long, _sequence long, _at long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_own", F.row_number().over(own) - 1).join(first, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_own"))
    runs = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_count", "_each", "_sequence", "_at"))).alias("_runs"))
    found = ranked.join(F.broadcast(runs), "length").withColumn("_run", F.expr("filter(_runs, r -> _rank >= r._from AND _rank < r._from + r._count)[0]"))
    place = F.col("_rank") - F.col("_run._from")
    return found.select(
        *(c for c in pieces.columns if c not in ("_part", "sequence_id", "offset")),
        (F.col("_run._sequence") + F.floor(place / F.col("_run._each"))).cast("long").alias("sequence_id"),
        (F.col("_run._at") + (place % F.col("_run._each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, window: int = 2048) -> DataFrame:
    """The pieces of all texts in sequences; see cut() and pack()."""
    return pack(checkpoint(cut(docs, window)), window)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
