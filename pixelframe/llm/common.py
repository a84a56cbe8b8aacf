"""What several operators share: checkpoints, raw text buffers, rolling hashes and block exchange."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a worker handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that spark.checkpoint.dir names; where it is unset a local session (tests) sets a temporary one, and a cluster fails."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns the memory that a worker has freed to the system: workers live on between stages, several for each core."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that gives back its memory at the end."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            give_back()

    return run


def lean_pair(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """lean() for two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return fn(left, right)
        finally:
            give_back()

    return run


def lean_batches(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lean() for a function of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


#: Blocks of documents for each shuffle partition: a task holds one at a time.
BLOCKS_EACH = 2


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- text as bytes -----------------------------------------------------------------------------


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, without copying, and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks keeps several when one would be too long
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to
        at = to


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = is_space()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs of bytes other than 20 and 09-0D) of each row."""
    inside = ~SPACE[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    starts_of_rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_rows] = inside[starts_of_rows]
    ends_of_rows = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends_of_rows] = inside[ends_of_rows]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [_power_row(_BASE, size), _power_row(pow(_BASE, -1, 1 << 64), size)]
    return _powers[0][:n], _powers[1][:n]


_PRIME = (1 << 31) - 1
_prime_powers: list[np.ndarray] = []


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and its inverse modulo a prime for exponents below n."""
    if not _prime_powers or len(_prime_powers[0]) < n:
        size, base = max(n, SLICE_BYTES + 1), 0x2545F491
        rows = []
        for b in (base, pow(base, -1, _PRIME)):
            row = np.ones(1, np.int64)
            while len(row) < size:
                row = np.concatenate([row, row * pow(b, len(row), _PRIME) % _PRIME])
            rows.append(row[:size])
        _prime_powers[:] = rows
    return _prime_powers[0][:n], _prime_powers[1][:n]


def _power_row(base: int, n: int) -> np.ndarray:
    row = np.ones(1, np.uint64)
    while len(row) < n:
        row = np.concatenate([row, row * _U(pow(base, len(row), 1 << 64))])
    return row[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: differences of prefix polynomials, shifted to start at 0.

    Modulo 2**64 alone any base has words that collide by their build (Thue and Morse); the second polynomial is modulo a prime.
    """
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=prefix[1:])
    whole = (prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407)
    up, down = prime_powers(len(data) + 1)
    other, carry = np.zeros(len(data) + 1, np.int64), 0
    for lo in range(0, len(data), 1 << 20):  # sums of a block stay below 2**60
        part = other[lo + 1 : lo + 1 + (1 << 20)]
        np.cumsum((data[lo : lo + (1 << 20)].astype(np.int64) + 1) * up[lo : lo + len(part)], out=part)
        part += carry
        carry = int(part[-1]) % _PRIME
    rest = (other[ends] - other[starts]) % _PRIME * down[starts] % _PRIME
    return mix(whole ^ mix(rest.astype(np.uint64) + _U(0x51ED270B)))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbours of a 64-bit row, by doubling; shorter by k - 1."""
    out, length = values.copy(), 1
    for bit in bin(k)[3:]:
        out = out[:-length] * _U(pow(_BASE, length, 1 << 64)) + out[length:]
        length *= 2
        if bit == "1":
            out = out[:-1] * _U(_BASE) + values[length : length + len(out) - 1]
            length += 1
    return mix(out)


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j pairwise in place; parent holds each row's root, the smallest row of its tree."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


# --- keys that more than one document has --------------------------------------------------------


def block_of(column: str, n: int) -> F.Column:
    """Documents are dealt over n blocks by id; a null id goes to the first one."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(column)), F.lit(n)), F.lit(0)).cast("int")


def by_place(df: DataFrame, place: str) -> DataFrame:
    """One partition for each place modulo the number of shuffle partitions: hashes of as many keys as partitions would crowd some and leave others empty."""
    return df.repartitionById(partitions(df.sparkSession), F.col(place))


#: Messages that a block sends at most, and blocks whose messages are joined where there are more buckets than that.
FAN = 4096


def pack_keys(block: int, keys: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> dict[str, list]:
    """Rows (block, slot, keys, times) for shared_keys(): the block's distinct keys, sorted by bucket and low half.

    rows: the document of each key; `times` is a byte for each key: how many of the block's documents hold it, 1 if only one does.
    A slot (see slots_of()) is a bucket, or of more than FAN buckets a range of them: a block sends FAN messages at most.
    """
    order, place, first, last = _by_bucket(keys, int(slots[-1]))
    owners = rows[order]
    many = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first) if len(first) else np.zeros(0, bool)
    return _messages(block, place, np.where(many, np.minimum(last - first, 255), 1).astype(np.uint8), slots)


def slots_of(buckets: int) -> np.ndarray:
    """Where each slot begins among the buckets, and their number: a slot for each bucket, or FAN slots of neighbouring ones."""
    n = min(buckets, FAN)
    return -(-np.arange(n + 1) * buckets // n)


def _messages(block: int, place: np.ndarray, times: np.ndarray, bounds: np.ndarray, lowest: int = 0) -> dict[str, list]:
    """Sorted places (bucket and low half in one number) as a row for each slot that has some; the slots are numbered from `lowest` on."""
    out: dict[str, list] = {"block": [], "slot": [], "keys": [], "times": []}
    edges = _edges(place, bounds)
    for i in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        lo, hi = edges[i], edges[i + 1]
        out["block"].append(block)
        out["slot"].append(lowest + i)
        out["keys"].append(_planes(place[lo:hi]))
        out["times"].append(times[lo:hi].tobytes())
    return out


def _edges(place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the sorted places of each slot begin."""
    return np.searchsorted(place >> _U(32), bounds.astype(np.uint64))


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, first, last): the order of the keys by bucket and low half; of the distinct ones their places and where they begin and end in that order."""
    value = (((keys >> _U(32)) % _U(buckets)) << _U(32)) | (keys & _U(0xFFFFFFFF))
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    return order, value[first], first, np.r_[first[1:], len(value)] if len(first) else first


def read_replies(keys: np.ndarray, slots: np.ndarray, replies: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
    """How many documents hold each of the keys, given as to pack_keys(), by the replies of shared_keys(): 0 where one alone does, at most 255."""
    order, place, first, last = _by_bucket(keys, int(slots[-1]))
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.repeat(_read(place, _edges(place, slots), 0, replies), last - first)
    return out


def _read(place: np.ndarray, edges: np.ndarray, lowest: int, replies: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
    found = np.zeros(len(place), np.uint8)
    for slot, (mask, times) in replies.items():
        lo, hi = edges[slot - lowest], edges[slot - lowest + 1]
        found[lo:hi][np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo).astype(bool)] = np.frombuffer(times, np.uint8)
    return found


def replies_in(table: pa.Table) -> dict[int, tuple[bytes, bytes]]:
    return dict(zip(table.column("slot").to_pylist(), zip(table.column("mask").to_pylist(), table.column("times").to_pylist(), strict=True), strict=True))


def _planes(place: np.ndarray) -> bytes:
    """The bucket of the first place, then the sorted places, high bytes first: these repeat, so that the shuffle's compression removes them. Four bytes a place where all are of one bucket."""
    wide = place[0] >> _U(32) != place[-1] >> _U(32)
    raw = (place if wide else place.astype(np.uint32)).astype(">u8" if wide else ">u4")
    return int(place[0] >> _U(32)).to_bytes(4, "big") + bytes([int(wide)]) + np.ascontiguousarray(raw.view(np.uint8).reshape(len(place), -1).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    size = 8 if raw[4] else 4
    place = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=5).reshape(size, -1).T).reshape(-1).view(f">u{size}").astype(np.uint64)
    return place if raw[4] else place | _U(int.from_bytes(raw[:4], "big") << 32)


PACKED = "block int, slot int, keys binary, times binary"
REPLIES = "block int, slot int, mask binary, times binary"


def packed_table(out: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(v, pa.binary() if c in ("keys", "times", "mask") else pa.int32()) for c, v in out.items()})


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts' places; the order of all of them, the distinct ones' begins in it, the distinct ones, and their times summed up."""
    parts = [_from_planes(raw) for raw in table.column("keys").to_pylist()]
    values, own = np.concatenate(parts), np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8)
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    total = np.minimum(np.add.reduceat(own[order].astype(np.int64), first), 255).astype(np.uint8)
    return parts, order, first, values[first], total


def _replies(table: pa.Table, parts: list[np.ndarray], times: np.ndarray) -> dict[str, list]:
    """What each row of the table is told about its keys; times: those of all keys in order of rows."""
    out: dict[str, list] = {"block": [], "slot": [], "mask": [], "times": []}
    ends = np.cumsum([len(p) for p in parts])
    for block, slot, t in zip(table.column("block").to_pylist(), table.column("slot").to_pylist(), np.split(times, ends[:-1]), strict=True):
        if (hit := t > 1).any():
            for c, v in zip(out, (block, slot, np.packbits(hit).tobytes(), t[hit].tobytes()), strict=True):
                out[c].append(v)
    return out


def shared_keys(packed: DataFrame, slots: np.ndarray) -> DataFrame:
    """(block, slot, mask, times): a bit for each of a block's keys that another document has too, and how many have it (255 at most).

    A key comes once from each block however many of its documents hold it, so that a key of a third of
    all documents sends no more rows to its bucket than there are blocks. The 32 bits compared within a
    bucket make a few chance hits, the same for every holder; callers compare the real values later.
    Beyond FAN buckets there is a stop between: a relay joins the messages of FAN blocks for a range of buckets, asks as a block
    itself, and hands the answers on, so that messages grow with blocks times FAN and not with blocks times buckets.
    """

    def mark(table: pa.Table) -> pa.Table:
        parts, order, first, _, total = _summed(table)
        times = np.empty(len(order), np.uint8)
        times[order] = np.repeat(total, np.diff(np.r_[first, len(order)]))
        return packed_table(_replies(table, parts, times))

    fan = len(slots) - 1
    if slots[-1] == fan:
        return by_place(packed, "slot").groupBy("slot").applyInArrow(lean(mark), REPLIES)
    sent = by_place(packed.withColumn("relay", (F.floor(F.col("block") / fan) * fan + F.col("slot")).cast("int")), "relay")
    own = lambda slot: np.arange(slots[slot], slots[slot + 1] + 1)  # noqa: E731  a relay's slots are the buckets of its range

    def join(table: pa.Table) -> pa.Table:
        _, _, _, place, total = _summed(table)
        of = own(table.column("slot")[0].as_py())
        return packed_table(_messages(table.column("relay")[0].as_py(), place, total, of, int(of[0])))

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return packed_table({"block": [], "slot": [], "mask": [], "times": []})
        parts, order, first, place, _ = _summed(left)
        of = own(left.column("slot")[0].as_py())
        told = _read(place, _edges(place, of), int(of[0]), replies_in(right))
        times = np.empty(len(order), np.uint8)
        times[order] = np.repeat(told, np.diff(np.r_[first, len(order)]))
        return packed_table(_replies(left, parts, times))

    asked = by_place(sent.groupBy("relay").applyInArrow(lean(join), PACKED), "slot")
    answers = by_place(asked.groupBy("slot").applyInArrow(lean(mark), REPLIES).withColumnRenamed("block", "relay"), "relay")
    return sent.groupBy("relay").cogroup(answers.groupBy("relay")).applyInArrow(lean_pair(hand_on), REPLIES)


# --- tables of a job's own ----------------------------------------------------------------------


def scratch(df: DataFrame, name: str) -> str:
    """A new path in the folder that checkpoints go to, shared by all executors."""
    checkpoint(df.sparkSession.range(1))  # sets the folder where a local session has none
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a path of scratch()."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
