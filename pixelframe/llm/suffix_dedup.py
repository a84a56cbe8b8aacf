"""Operator 10: exact removal of repeated byte strings by a distributed merge sort of suffixes that keeps common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCKS_EACH, PACKED, block_of, buffers, by_place, checkpoint, lean, lean_pair, mix, pack_keys, packed_table, partitions, read_replies, replies_in, shared_keys, slices, slots_of, window_hashes

_U = np.uint64
#: Bytes of the anchors; any string of the least length holds anchors at LEAST - ANCHOR + 1 places.
ANCHOR = 24

RUNS = "block int, bucket int, prefix binary, tails binary, before binary, near binary, far binary, low binary"
FOUND = "block int, bucket int, hits binary"
#: Bytes of which anchors are chosen at once: the place within them takes the low bits of what is compared, the same everywhere.
STRETCH = 1 << 23


# --- anchors -----------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, key): each text's anchors and the strings of `least` bytes that they stand for.

    A string's anchor is the smallest hash among its ANCHOR-byte windows, the leftmost of equal ones: it depends on
    the string alone, so that equal strings have equal anchors at the same place. An anchor stands for a run
    of neighbouring starts, first to last; about one byte in fourteen is an anchor.
    """
    span = least - ANCHOR + 1
    if len(data) < least:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    parts = [_places(data[lo : lo + STRETCH + least - 1], span) for lo in range(0, len(data) - least + 1, STRETCH)]
    place = np.concatenate([p + i * STRETCH for i, (p, _) in enumerate(parts)])
    chosen = np.concatenate([h for _, h in parts])
    start = np.arange(len(place))
    row = np.searchsorted(offsets, start, "right") - 1
    valid = start + least <= offsets[row + 1]
    start, row, place = start[valid], row[valid], place[valid]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]) if len(start) else np.zeros(0, np.int64)
    last = start[np.r_[new[1:], len(start)] - 1] if len(new) else new
    return row[new], place[new], start[new], last, mix(chosen[valid][new])


def _places(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the place of the smallest of the `span` hashes from it on, and that hash."""
    hashes = window_hashes(data.astype(np.uint64) + _U(1), ANCHOR)
    low = _U((1 << 24) - 1)
    best, width = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    place = (best & low).astype(np.int64)
    return place, hashes[place]


# --- the loser tree ----------------------------------------------------------------------------


class LoserTree:
    """Merges sorted runs of fixed-width strings without looking again at prefixes known to agree.

    Each run is a list of strings (as rows of big-endian 64-bit words) with the length of the prefix that each
    shares with the one before it. A contender carries the length it shares with the last winner: the longer
    one is smaller, and only equal lengths are compared, from the word where the known prefix ends.
    """

    def __init__(self, runs: list[tuple[list[list[int]], list[int]]]) -> None:
        self.words = [r[0] for r in runs]
        self.shares = [r[1] for r in runs]
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.at = [0] * self.leaves
        self.share = [0 if i < len(runs) and runs[i][0] else -1 for i in range(self.leaves)]
        self.losers = [0] * self.leaves
        self.width = 8 * len(self.words[0][0]) if runs and runs[0][0] else 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share is then with the winner."""
        sa, sb = self.share[a], self.share[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        if sa < 0:
            return a, b
        x, y = self.words[a][self.at[a]], self.words[b][self.at[b]]
        n = len(x)
        i = sa >> 3
        while i < n and x[i] == y[i]:
            i += 1
        if i == n:
            if a > b:
                a, b = b, a
            self.share[b] = 8 * n
            return a, b
        u, v = x[i], y[i]
        if u > v:
            a, b = b, a
        self.share[b] = 8 * i + ((64 - (u ^ v).bit_length()) >> 3)
        return a, b

    def merge(self) -> tuple[list[int], list[int], list[int]]:
        """(run, place, share) in order; share: the prefix shared with the one before."""
        winners = list(range(self.leaves)) * 2
        for i in range(self.leaves - 1, 0, -1):
            left, right = (winners[2 * i], winners[2 * i + 1]) if 2 * i < self.leaves else (2 * i - self.leaves, 2 * i + 1 - self.leaves)
            winners[i], self.losers[i] = self.play(left, right)
        top = winners[1] if self.leaves > 1 else 0
        runs, places, shares = [], [], []
        at, share, losers, leaves, play = self.at, self.share, self.losers, self.leaves, self.play
        while share[top] >= 0:
            runs.append(top)
            places.append(at[top])
            shares.append(share[top])
            k = at[top] = at[top] + 1
            share[top] = self.shares[top][k] if k < len(self.shares[top]) else -1
            i = (top + leaves) >> 1
            while i:
                top, losers[i] = play(top, losers[i])
                i >>= 1
        return runs, places, shares


def shares_of(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted byte matrix shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def in_order(rows: np.ndarray) -> np.ndarray:
    """Sorting order of a byte matrix (its width a multiple of 8)."""
    return np.lexsort(np.ascontiguousarray(rows).view(">u8").astype(np.uint64).T[::-1])


def padded(width: int) -> int:
    return -(-width // 8) * 8


# --- runs ----------------------------------------------------------------------------------------


def records(data: np.ndarray, row: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: the bytes from it on (as far as its strings reach), those before it (nearest first), and the least and largest distance to a string's start."""
    near, far = place - last, place - first
    right, left = np.zeros((len(place), padded(least)), np.uint8), np.zeros((len(place), padded(least - ANCHOR)), np.uint8)
    at = np.arange(least)
    inside = at[None] < (least - near)[:, None]
    right[:, :least][inside] = data[(place[:, None] + at)[inside]]
    at = np.arange(least - ANCHOR)
    inside = at[None] < far[:, None]
    left[:, : least - ANCHOR][inside] = data[(place[:, None] - 1 - at)[inside]]
    return right, left, near, far


def in_runs(bucket: np.ndarray, right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """A block's anchors in the order of bucket and bytes; equal ones are one record, with the smallest id of its holders.

    order: the anchors' order; record: each one's record in that order; head: each record's first; low: its smallest id; bucket: its bucket.
    """
    whole = np.concatenate([right, left, np.zeros((len(right), 6), np.uint8), near[:, None].astype(np.uint8), far[:, None].astype(np.uint8)], axis=1)
    order = np.lexsort([*np.ascontiguousarray(whole).view(">u8").astype(np.uint64).T[::-1], bucket])
    whole, bucket, ids = whole[order], bucket[order], ids[order]
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (whole[1:] != whole[:-1]).any(1)] if len(whole) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return {"order": order, "record": np.cumsum(new) - 1, "head": head, "low": np.minimum.reduceat(ids, head) if len(head) else ids, "bucket": bucket[head]}


def coded(block: int, runs: dict[str, np.ndarray], right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple]:
    """A front-coded sorted run of records for each bucket. Their holders stay in the block."""
    first, bucket = runs["order"][runs["head"]], runs["bucket"]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        own = first[a:b]
        r = right[own]
        share = shares_of(r)
        keep = np.arange(r.shape[1])[None] >= share[:, None]
        yield block, int(bucket[a]), share.astype(np.uint8).tobytes(), r[keep].tobytes(), left[own].tobytes(), near[own].astype(np.uint8).tobytes(), far[own].astype(np.uint8).tobytes(), runs["low"][a:b].astype("<i8").tobytes()


def marks(runs: dict[str, np.ndarray], hits: dict[int, bytes], near: np.ndarray, far: np.ndarray, ids: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, end) of what is to go, from the bits that repeated() gives each record.

    The bits tell which strings of the record's smallest holder a still smaller id has; its other holders lose all, as that one has them too.
    """
    bits = np.zeros(len(runs["head"]), np.uint32)
    edges = np.searchsorted(runs["bucket"], np.array(list(hits), np.int64)), np.searchsorted(runs["bucket"], np.array(list(hits), np.int64), "right")
    for a, b, raw in zip(*edges, hits.values(), strict=True):
        bits[a:b] = np.frombuffer(raw, "<u4")
    own = np.empty(len(runs["order"]), np.uint32)
    later = np.empty(len(runs["order"]), bool)
    own[runs["order"]] = bits[runs["record"]]
    later[runs["order"]] = ids[runs["order"]] > runs["low"][runs["record"]]
    every = np.flatnonzero(later)
    some = np.flatnonzero(~later & (own > 0))
    flags = (own[some][:, None] >> np.arange(32, dtype=np.uint32)) & _U(1).astype(np.uint32)
    edge = np.diff(np.concatenate([np.zeros((len(some), 1), np.int8), flags.astype(np.int8), np.zeros((len(some), 1), np.int8)], axis=1), axis=1)
    holder, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)  # of each run one past its largest distance
    at, anchor = some[holder], begin + far
    return np.r_[every, at], np.r_[begin[every], anchor[at] - (hi - 1)], np.r_[anchor[every] - near[every] + least, anchor[at] - lo + least]


def decode(share: np.ndarray, tails: np.ndarray, width: int) -> np.ndarray:
    """The byte matrix of a front-coded run."""
    out = np.zeros((len(share), width), np.uint8)
    own = np.arange(width)[None] >= share[:, None]
    out[own] = tails
    # a byte that isn't a row's own is that of the last row above it whose own it is
    source = np.maximum.accumulate(np.where(own, np.arange(len(share))[:, None], 0), axis=0)
    return out[source, np.arange(width)[None]]


def repeated(table: pa.Table, least: int) -> list[tuple]:
    """Merges a bucket's runs; a bit for each record and distance: whether a smaller id than the record's smallest has that string too."""
    rows = {c: table.column(c).to_pylist() for c in table.column_names}
    width, side = padded(least), padded(least - ANCHOR)
    get = lambda name, kind, i: np.frombuffer(rows[name][i], kind)
    count, runs = [], []
    for i in range(table.num_rows):
        share = get("prefix", np.uint8, i).astype(np.int64)
        runs.append((decode(share, get("tails", np.uint8, i), width).view(">u8").astype(np.uint64).tolist(), share.tolist()))
        count.append(len(share))
    run, place, shares = LoserTree(runs).merge()
    del runs
    start = np.cumsum([0, *count])
    order = start[np.asarray(run)] + np.asarray(place)
    n = len(order)
    together = lambda name, kind: np.concatenate([get(name, kind, i) for i in range(table.num_rows)])
    before = together("before", np.uint8).reshape(n, side)[order]
    near, far, low = (together(c, k)[order].astype(np.int64) for c, k in (("near", np.uint8), ("far", np.uint8), ("low", "<i8")))
    shares = np.asarray(shares)
    back = in_order(before)
    left_share = np.zeros(n, np.int64)
    left_share[1:] = shares_of(before[back])[1:]
    left_rank = np.empty(n, np.int64)
    left_rank[back] = np.arange(n)
    bits = np.zeros(n, np.uint32)
    for back_by in range(least - ANCHOR + 1):
        live = np.flatnonzero((near <= back_by) & (far >= back_by))
        if len(live) < 2:
            continue
        right_class = np.cumsum(shares < least - back_by)[live]
        left_class = np.cumsum(left_share < back_by)[left_rank[live]] if back_by else np.zeros(len(live), np.int64)
        key = right_class * (n + 1) + left_class
        by = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        smallest = np.repeat(np.minimum.reduceat(low[live][by], head), np.diff(np.r_[head, len(by)]))
        bits[live[by]] |= (smallest < low[live[by]]).astype(np.uint32) << np.uint32(back_by)
    out = np.empty(n, "<u4")
    out[order] = bits
    return [(rows["block"][i], rows["bucket"][i], out[a:b].tobytes()) for i, (a, b) in enumerate(zip(start[:-1], start[1:], strict=True)) if out[a:b].any()]


# --- the operator ----------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, least: int = 50, keep_text: bool = False) -> DataFrame:
    """The columns of docs other than the text, with n_bytes, n_removed, n_spans, kept_sha256 (and the remaining text).

    Removed is each byte covered by a string of `least` bytes that starts in a document of a smaller doc_id too;
    strings are judged on the input and never cross documents. Null and empty texts have no bytes; texts
    shorter than `least` lose nothing; rows that repeat an id are documents of equal rank, so that none
    removes from another; rows with a null id neither lose bytes nor take any away. With keep_text the rest is
    returned as `text`, without the bytes of characters that a removal cut. Columns named like a result are replaced.

    Documents are dealt over blocks. A text that a smaller id has whole is settled at once. The others send the
    hashes of their anchors to find those that several texts hold (once for each block), then sorted runs of
    the suffixes at these, front-coded and with equal ones joined, to be merged bucket by bucket. What comes back are bits for each record.
    Buckets are hashes of the anchor, so that a common passage spreads over many of them, and it comes to each from
    a block once, however many texts of the block hold it: these stay there.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    slots = slots_of(buckets)
    blocks = BLOCKS_EACH * buckets
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rest = [c for c in docs.columns if c not in (*made, "text", "_block", "_tie")]
    dealt = by_place(docs.select(block_of("doc_id", blocks).alias("_block"), F.xxhash64("text").alias("_tie"), *rest, "text"), "_block")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.xxhash64("text").alias("_tie"))
    # a table of its own, so that Spark can split the rows of a text with very many copies
    first = checkpoint(texts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = texts.join(first.select("sha", "first"), "sha").where("doc_id > first").select(block_of("doc_id", blocks).alias("block"), "doc_id", "_tie").distinct()

    def ranked(left: pa.Table, right: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The block in a fixed order, its ids, and which rows are to be looked at: not copies, and with an id."""
        left = left.sort_by([("doc_id", "ascending"), ("_tie", "ascending")]) if left.num_rows else left
        copy = set(zip(right.column("doc_id").to_pylist(), right.column("_tie").to_pylist(), strict=True))
        ids = left.column("doc_id").to_pylist()
        live = np.array([d is not None and (d, t) not in copy for d, t in zip(ids, left.column("_tie").to_pylist(), strict=True)], bool)
        return left, np.array([-1 if d is None else d for d in ids], np.int64), live

    def marked(left: pa.Table, live: np.ndarray) -> Iterator[tuple]:
        for lo, hi in slices(buffers(left.column("text"))[1]):
            data, offsets = buffers(left.column("text").slice(lo, hi - lo))
            found = anchors(data, offsets, least)
            good = live[lo:hi][found[0]]
            yield lo, data, offsets, [x[good] for x in found]

    def keys_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return packed_table({"block": [], "slot": [], "keys": [], "times": []})
        left, _, live = ranked(left, right)
        parts = [(lo + f[0], f[4]) for lo, _, _, f in marked(left, live)]
        return packed_table(pack_keys(left.column("_block")[0].as_py(), np.concatenate([k for _, k in parts]), np.concatenate([r for r, _ in parts]), slots))

    answers = shared_keys(dealt.groupBy("_block").cogroup(by_place(copies, "block").groupBy("block")).applyInArrow(lean_pair(keys_of), PACKED), slots)
    replies = copies.unionByName(answers, allowMissingColumns=True)

    def common(left: pa.Table, right: pa.Table) -> tuple:
        """The block in order, its ids, its live rows; and of the anchors that other texts have too: runs, records, rows and starts."""
        left, ids, live = ranked(left, right.filter(right.column("doc_id").is_valid()))
        reply = right.filter(right.column("mask").is_valid())
        if not reply.num_rows:
            return left, ids, live, None
        found = list(marked(left, live))
        hit = read_replies(np.concatenate([f[4] for *_, f in found]), slots, replies_in(reply)) > 0
        parts, at = [], 0
        for lo, data, offsets, (row, place, begin, last, key) in found:
            own = hit[at : at + len(key)]
            at += len(key)
            row, place, begin, last, key = (x[own] for x in (row, place, begin, last, key))
            parts.append((*records(data, row, place, begin, last, least), ((key >> _U(32)) % _U(buckets)).astype(np.int64), row + lo, begin - offsets[row]))
        right_, left_, near, far, bucket, row, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
        return left, ids, live, (in_runs(bucket, right_, left_, near, far, ids[row]), right_, left_, near, far, row, begin)

    def runs_of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in RUNS.split(", ")]
        out: list[tuple] = []
        if left.num_rows:
            left, _, _, held = common(left, right)
            if held is not None and len(held[5]):
                out = list(coded(left.column("_block")[0].as_py(), *held[:5]))
        return pa.table({c: pa.array([o[i] for o in out], pa.binary() if i > 1 else pa.int32()) for i, c in enumerate(names)})

    runs = dealt.groupBy("_block").cogroup(by_place(replies, "block").groupBy("block")).applyInArrow(lean_pair(runs_of), RUNS)

    def merge(table: pa.Table) -> pa.Table:
        out = repeated(table, least)
        return pa.table({c: pa.array([o[i] for o in out], pa.binary() if i > 1 else pa.int32()) for i, c in enumerate(("block", "bucket", "hits"))})

    found = replies.unionByName(by_place(runs, "bucket").groupBy("bucket").applyInArrow(lean(merge), FOUND), allowMissingColumns=True)
    fields = [*docs.select(*rest).schema, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField("text", T.StringType()))
    schema = T.StructType(fields)

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], left.column(f.name).type if f.name in rest else pa.string() if f.dataType == T.StringType() else pa.int64()) for f in fields})
        told = right.filter(right.column("hits").is_valid())
        left, ids, live, held = common(left, right)
        row = start = end = np.zeros(0, np.int64)
        if held is not None:
            record, _, _, near, far, of, begin = held
            at, start, end = marks(record, dict(zip(told.column("bucket").to_pylist(), told.column("hits").to_pylist(), strict=True)), near, far, ids[of], begin, least)
            row = of[at]
            del held, record
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        texts = left.column("text").to_pylist()
        out: dict[str, list] = {c: [] for c in (*made, "text")}
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            n = len(raw)
            if not live[i] and left.column("doc_id")[i].is_valid and n >= least:
                kept, gone, runs_n = b"", n, 1
            else:
                a, b = np.searchsorted(row, [i, i + 1])
                kept, gone, runs_n = raw, 0, 0
                if a < b:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, start[a:b], 1)
                    np.add.at(edge, end[a:b], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                    gone, runs_n = int(cover.sum()), int((cover & ~np.r_[False, cover[:-1]]).sum())
            out["n_bytes"].append(n)
            out["n_removed"].append(gone)
            out["n_spans"].append(runs_n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["text"].append(None if text is None else kept.decode(errors="ignore"))
        columns = {c: left.column(c) for c in rest} | {c: pa.array(out[c], pa.int64()) for c in made[:3]} | {"kept_sha256": pa.array(out["kept_sha256"])}
        if keep_text:
            columns["text"] = pa.array(out["text"], pa.string())
        return pa.table(columns)

    return dealt.groupBy("_block").cogroup(by_place(found, "block").groupBy("block")).applyInArrow(lean_pair(removed), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
