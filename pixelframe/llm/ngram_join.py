"""Operator 1: n-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections of sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCKS_EACH, LOWER, PACKED, block_of, buffers, by_place, checkpoint, lean, lean_batches, lean_pair, mix, pack_keys, packed_table, partitions, read_replies, replies_in, shared_keys, slices, slots_of, span_hashes, unite, window_hashes, words
from .components import components

_U = np.uint64
#: A tile's sets that a task holds on one side: so many, of so many bytes together.
TILE, TILE_BYTES = 1024, 16 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (A-Z lower-cased), and where each text's begin.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    n = len(offsets) - 1
    lower = LOWER[data]
    starts, ends, row = words(lower, offsets)
    token = span_hashes(lower, starts, ends)
    count = np.bincount(row, minlength=n)
    full = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) if len(row) >= k else np.zeros(0, np.int64)
    hashes = window_hashes(token, k)[full] if len(full) else np.zeros(0, np.uint64)
    owner = row[full]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(row, few)
        whole = np.zeros(len(few), np.uint64)
        for i in range(k - 1):
            here = i < count[few]
            whole[here] = mix(whole[here] + token[first[here] + i] + _U(i + 1))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def fingerprints(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two halves."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=total[1:])
    other = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(mix(hashes) + _U(0x9E3779B97F4A7C15)), out=other[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64), (other[at[1:]] - other[at[:-1]]).view(np.int64)


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets at the similarity share one of so many first elements, whatever the common order."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """How many elements a set has in common with any similar one at least."""
    return np.maximum(1, -(-percent * n // 100))


# --- inside a tile ---------------------------------------------------------------------------------


def bitmaps(items: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, a bit for each element's hash; the width, a power of two, follows the largest set."""
    width = 1 << max(6, min(15, (4 * max(map(len, items), default=1) - 1).bit_length()))
    bits = np.zeros((len(items), width), np.uint8)
    for row, values in zip(bits, items, strict=True):
        row[(mix(values) & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, known_a: np.ndarray, known_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bit counts leave room for the similarity of sets of na and nb elements, known_a and known_b of them in the bitmaps: each bit of one side alone is an element outside the overlap."""
    alone_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    alone_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    most = np.minimum(known_a - alone_a, known_b - alone_b)
    return (100 + percent) * most >= percent * (na + nb)


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others."""
    ends = np.cumsum([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    total = np.r_[0, np.cumsum(one[at] == every)]
    return total[ends] - total[np.r_[0, ends[:-1]]]


def links_of(n: np.ndarray, items: list[np.ndarray], root: np.ndarray, query: np.ndarray, percent: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows, of which one at least is a query: every pair, or only those that join rows of different roots.

    n: sizes of the sets, ascending; items: their elements that other sets have too, sorted; root: each row's tree so far
    (rows of one number are joined). Only sizes within the similarity of each other meet; then bitmaps bound the
    overlap, then the arrays are intersected.
    """
    known = np.array([len(x) for x in items])
    maps = bitmaps(items)
    root = np.unique(root, return_inverse=True)[1]
    first = np.searchsorted(n, -(-percent * n // 100))
    last = np.searchsorted(n, n * 100 // percent, "right")
    left, right = [], []
    for i in np.flatnonzero(query).tolist():
        j = np.arange(first[i], last[i])
        j = j[(~query[j] | (j > i)) & (j != i)]
        if not every:
            j = j[root[j] != root[i]]
        for lo in range(0, len(j), TILE):
            part = j[lo : lo + TILE]
            if not every:
                part = part[root[part] != root[i]]
            part = part[may_reach(maps[i], maps[part], n[i], n[part], known[i], known[part], percent)]
            if not len(part):
                continue
            both = overlaps(items[i], [items[x] for x in part.tolist()])
            part = part[100 * both >= percent * (n[i] + n[part] - both)]
            if not every:  # one link to each tree
                part = part[np.unique(root[part], return_index=True)[1]]
                gone = root[part]
                root[np.isin(root, gone)] = root[i]
            left.append(np.full(len(part), i))
            right.append(part)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id of its tree) that join what the links (a, b) join."""
    node, back = np.unique(np.r_[a, b], return_inverse=True)
    parent = np.arange(len(node))
    unite(parent, back[: len(a)], back[len(a) :])
    moved = parent != np.arange(len(node))
    return node[moved], node[parent[moved]]


def tile_links(table: pa.Table, percent: int, every: bool) -> pa.Table:
    """links_of() for one tile: columns doc_id, n, items; optionally comp (trees so far) and query."""
    n = np.asarray(table.column("n"))
    order = np.argsort(n, kind="stable")
    ids = np.asarray(table.column("doc_id"))[order]
    raw = table.column("items")
    items = [np.frombuffer(raw[i].as_py(), np.uint64) for i in order.tolist()]
    names = table.column_names
    root = np.asarray(table.column("comp"))[order] if "comp" in names else ids
    query = np.asarray(table.column("query").combine_chunks().to_numpy(zero_copy_only=False))[order].astype(bool) if "query" in names else np.ones(len(ids), bool)
    a, b = links_of(n[order], items, root, query, percent, every)
    a, b = ids[a], ids[b]
    if not every:
        a, b = stars(a, b)
    keep = a != b
    return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})


def linked(sets: DataFrame, groups: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links (a, b) among sets (doc_id, n, items), those of one group (doc_id, grp) compared: every link, or as many as join the same components.

    A group beyond a tile's size is divided by id. For every link each pair of parts meets. For components alone the
    parts are first joined within; then, as long as that joins more, one leader of each component that is left meets those of
    other parts; at last the members outside their group's largest component meet all parts, so that no link between components is missed:
    rows grow with the group times the parts only for what isn't joined. Only ids move until it is known where a set is needed.
    """
    schema = "a long, b long"

    def parted(rows: DataFrame) -> DataFrame:
        size = rows.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("parts"))
        return rows.join(checkpoint(size), "grp").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))

    def compared(places: DataFrame, *by: str) -> DataFrame:
        return sets.join(places, "doc_id").groupBy(*by).applyInArrow(lean(lambda t: tile_links(t, percent, every)), schema)

    slim = sets.groupBy("doc_id").agg(F.sum("n").alias("n")).join(groups, "doc_id")
    dealt = checkpoint(parted(slim))
    if every:
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j")))
        pairs = dealt.withColumn("pair", F.explode(meets)).withColumn("query", F.col("part") == F.col("pair.i"))
        return compared(pairs.select("doc_id", "grp", "pair", "query"), "grp", "pair")
    found = checkpoint(compared(dealt.select("doc_id", "grp", "part"), "grp", "part"))
    large = dealt.where("parts > 1").select("grp", "doc_id", "n")
    before = large.count()
    if not before:
        return found
    own = found.join(large.select(F.col("doc_id").alias("a")), "a", "left_semi")
    more = None
    while True:
        joined = checkpoint(components(own))
        leaders = checkpoint(parted(with_component(large, joined).where("doc_id = comp").select("grp", "doc_id", "n")))
        left, parts = leaders.agg(F.count("*"), F.max("parts")).first()
        more = checkpoint(compared(leaders.select("doc_id", "grp", "part"), "grp", "part"))
        own = own.unionByName(more)
        if parts <= 1 or left > 0.8 * before:
            break
        before = left
    state = with_component(large, checkpoint(components(own)))
    largest = state.groupBy("grp", "comp").agg(F.count("*").alias("size")).groupBy("grp").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    state = checkpoint(parted(state.join(checkpoint(largest), "grp")))
    outside = state.where("comp <> main")
    sides = checkpoint(outside.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("sides")))
    queries = outside.join(sides, "grp").withColumn("side", F.pmod(F.xxhash64("doc_id", F.lit(1)), "sides").cast("int"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(True))
    rest = state.join(sides, "grp").withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).withColumn("query", F.lit(False))
    what = ["doc_id", "grp", "part", "side", "comp", "query"]
    across = compared(queries.select(*what).unionByName(rest.select(*what)), "grp", "part", "side")
    return found.unionByName(own).unionByName(across)


# --- the corpus ------------------------------------------------------------------------------------


def _rows_of(table: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, hashes and starts of a block's sets, slice by slice."""
    column = table.column("text")
    for lo, hi in slices(buffers(column)[1]):
        yield np.arange(lo, hi), *shingle_sets(*buffers(column.slice(lo, hi - lo)), k)


def set_facts(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2) for each document: the size of its set and the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in slices(buffers(column)[1]):
                h, at = shingle_sets(*buffers(column.slice(lo, hi - lo)), k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), *map(pa.array, fingerprints(h, at))], names=["doc_id", "n", "s1", "s2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean_batches(run), "doc_id long, n long, s1 long, s2 long")


def with_component(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """Adds `comp`: the component of doc_id, itself where it has no link."""
    found = rows.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def forest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, a, b): the first row of each key in the order of key and id, and links (a, b) that join the ids of one key as far as no others do."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    return order[new], *stars(d[1:][~new[1:]], d[:-1][~new[1:]])


ACTIVE = "doc_id long, n long, items binary, a long, b long, bucket int, keys binary, docs binary"


def _joined(docs: DataFrame, k: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of the rows, classes (s1, s2, rep) and links (a, b) between representatives: every one, or as many as join the components."""
    spark = docs.sparkSession
    ratio = math.log(1.3) if percent == 80 else math.log(1.05 * 100 / percent)
    buckets = partitions(spark)
    slots = slots_of(buckets)
    blocks = BLOCKS_EACH * buckets
    # tokens are far fewer than shingles: in fewer places more of what joins the same sets is one link
    meeting = max(1, buckets // 8)
    facts = checkpoint(set_facts(docs, k))
    classes = checkpoint(facts.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    picked = classes.select(block_of("rep", blocks).alias("block"), F.col("rep").alias("doc_id"), "s1")
    dealt = by_place(docs.select(block_of("doc_id", blocks).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "block")

    def chosen(left: pa.Table, right: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        """Ids and sets of the block's classes; each class once."""
        want = set(zip(right.column("doc_id").to_pylist(), right.column("s1").to_pylist(), strict=True))
        of, ids, sets = left.column("doc_id").to_pylist(), [], []
        for rows, h, at in _rows_of(left, k):
            s1 = fingerprints(h, at)[0].tolist()
            for i, r in enumerate(rows.tolist()):
                if (of[r], s1[i]) in want and at[i + 1] > at[i]:
                    want.discard((of[r], s1[i]))
                    ids.append(of[r])
                    sets.append(h[at[i] : at[i + 1]].copy())
        return ids, sets

    def keys_of(left: pa.Table, right: pa.Table) -> pa.Table:
        block = (left if left.num_rows else right).column("block")[0].as_py()
        _, sets = chosen(left, right)
        size = [len(x) for x in sets]
        return packed_table(pack_keys(block, mix(np.concatenate(sets)) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), size).astype(np.int64), slots))

    answers = shared_keys(dealt.groupBy("block").cogroup(by_place(picked, "block").groupBy("block")).applyInArrow(lean_pair(keys_of), PACKED), slots)
    replies = by_place(picked.unionByName(answers, allowMissingColumns=True), "block")

    def active(left: pa.Table, right: pa.Table) -> pa.Table:
        reply = right.filter(right.column("slot").is_valid())
        ids, sets = chosen(left, right.filter(right.column("slot").is_null()))
        rows, token, place, holder = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
        if sets and reply.num_rows:
            every_key = mix(np.concatenate(sets))
            times = read_replies(every_key, slots, replies_in(reply))
            ends = np.cumsum([len(x) for x in sets])
            for d, v, key, t in zip(ids, sets, np.split(every_key, ends[:-1]), np.split(times, ends[:-1]), strict=True):
                n = len(v)
                if np.count_nonzero(t) < least_shared(np.array(n), percent):
                    continue
                # rare elements first, in an order that is the same for all: those that no other set has come before them
                alone = n - np.count_nonzero(t)
                room = int(prefix_lengths(np.array(n), percent)) - alone
                if room <= 0:
                    continue
                common = np.flatnonzero(t)
                head = common[np.lexsort((key[common], t[common]))][:room]
                bands = mix(np.array([1, 2], np.uint64) + _U(int(math.log(n) / ratio)))
                rows.append((d, n, v[common].tobytes()))
                token += [mix(key[head] + b) for b in bands]
                place += [key[head]] * 2
                holder += [d] * (2 * len(head))
        token, place, holder = np.concatenate(token), np.concatenate(place), np.array(holder, np.int64)
        first, a, b = forest(token, holder)
        token, holder = token[first], holder[first]
        to = ((place[first] >> _U(32)) % _U(meeting)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(meeting + 1))
        sent = [(x, token[o].tobytes(), holder[o].tobytes()) for x in np.flatnonzero(edges[1:] > edges[:-1]).tolist() if len(o := order[edges[x] : edges[x + 1]])]
        blank = lambda n, kind: pa.nulls(n, kind)
        size = (len(rows), len(a), len(sent))
        column = lambda at, values, kind: pa.chunked_array([pa.array(values, kind) if i == at else blank(m, kind) for i, m in enumerate(size)], kind)
        return pa.table({
            "doc_id": column(0, [r[0] for r in rows], pa.int64()), "n": column(0, [r[1] for r in rows], pa.int64()), "items": column(0, [r[2] for r in rows], pa.binary()),
            "a": column(1, a, pa.int64()), "b": column(1, b, pa.int64()),
            "bucket": column(2, [x[0] for x in sent], pa.int32()), "keys": column(2, [x[1] for x in sent], pa.binary()), "docs": column(2, [x[2] for x in sent], pa.binary()),
        })

    def meet(table: pa.Table) -> pa.Table:
        """Joins the holders of a bucket's tokens, which come once from each block."""
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        _, a, b = forest(read("keys", np.uint64), read("docs", np.int64))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    known = checkpoint(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lean_pair(active), ACTIVE))
    tokens = by_place(known.where("bucket IS NOT NULL").select("bucket", "keys", "docs"), "bucket")
    near = known.where("a IS NOT NULL").select("a", "b").unionByName(tokens.groupBy("bucket").applyInArrow(lean(meet), "a long, b long"))
    groups = components(near).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "grp")
    sets = known.where("items IS NOT NULL").select("doc_id", "n", "items")
    return facts, classes, linked(sets, checkpoint(groups), percent, every)


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two documents link at Jaccard similarity percent/100 or above of their k-word shingle sets; component_id is
    the smallest doc_id that links reach. Texts without words (null, empty, white space) have no shingles and
    are linked with nothing; a row with a null id has a null component and links nothing; rows that repeat an id
    are one document for linking, which joins what each of them links. No two components are left apart (ngram_links gives every link):

    1. Equal sets (128-bit fingerprints) are one class, of its smallest id, whatever its size.
    2. An exchange to which a shingle comes once from each block tells how many sets hold it. A set that shares fewer
       shingles than the similarity asks with all others together has no link.
    3. Of the rest, the shingles of the prefix that any link must share, rarest first, with the set's size band make
       tiles. Sets that tiles join form groups, and each set goes to its group once.
    4. In a group each set meets those of a similar size and another component: bitmaps first, then the sorted arrays. A group beyond TILE sets is
       divided (see linked()). What comes out are the links that join components, no more than sets.
    """
    facts, classes, links = _joined(docs, k, percent, False)
    full = facts.join(classes, ["s1", "s2"], "left")
    several = full.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.collect_set("rep").alias("reps")).where("x <> y")
    same = several.select(F.col("doc_id").alias("a"), F.explode("reps").alias("b"))
    joined = checkpoint(components(links.unionByName(same)))
    out = full.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def ngram_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every link, as (a, b) with a < b between class representatives, and the members (doc_id, rep) of the classes.

    Documents of one class have equal sets and link with each other; two of different classes link if their representatives
    do. Here nothing is left out for being joined already: tiles compare all their pairs, so that m differing near copies
    give up to m * (m - 1) / 2 rows. Rows without shingles or id are in neither table; repeated ids are one document.
    """
    facts, classes, links = _joined(docs, k, percent, True)
    members = facts.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["s1", "s2"]).select("doc_id", "rep").distinct()
    return members, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_links) of each member, from ngram_links: the other documents of its class and those of linked classes."""
    size = members.groupBy("rep").agg(F.count("*").alias("_size"))
    ways = links.select("a", "b").union(links.select("b", "a")).join(size, F.col("b") == F.col("rep")).groupBy(F.col("a").alias("rep")).agg(F.sum("_size").alias("_far"))
    per = size.join(ways, "rep", "left").select("rep", (F.col("_size") - 1 + F.coalesce("_far", F.lit(0))).alias("n_links"))
    return members.join(per, "rep").select("doc_id", "n_links")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
