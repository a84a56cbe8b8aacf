"""Operators 1, 4 and 10 and the components against brute force."""

import hashlib
import re

import numpy as np
import pytest

from pixelframe.llm import common, components, embedding_dedup, ngram_join, suffix_dedup


class Trees(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    t = Trees()
    for a, b in pairs:
        t.join(a, b)
    got = dict(components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect())
    assert got == {x: t.find(x) for x in list(t)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join(docs, rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    t = Trees()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                t.join(a, b)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = sorted(((d, len(s), t.find(d) if d is not None and s else d) for d, s in sets), key=key)
    got = sorted((tuple(r) for r in ngram_join.ngram_components(docs).collect()), key=key)
    # an id with several texts is one document for linking
    assert got == want


def test_ngram_links_are_all_there(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if j != 11 * i % 120 else f"x{i}" for j, w in enumerate(base)) for i in range(30)]
    texts += texts[:3] + [" ".join(base[: 120 - 8 * i]) for i in range(6)] + ["", "one two"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    members, links = ngram_join.ngram_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets = {d: shingles(t) for d, t in rows if d is not None}
    want = {d: sum(100 * len(x & y) >= 80 * len(x | y) for e, y in sets.items() if e != d and y) for d, x in sets.items() if x}
    assert max(want.values()) > 30
    assert {r.doc_id: r.n_links for r in ngram_join.link_counts(members, links).collect()} == want
    reps = dict(members.collect())
    near = {(reps[a], reps[b]) for a, x in sets.items() for b, y in sets.items() if x and y and reps[a] < reps[b] and 100 * len(x & y) >= 80 * len(x | y)}
    assert {tuple(r) for r in links.collect()} == near and links.count() == len(near)


def test_ngram_join_of_nothing(none):
    assert ngram_join.ngram_components(none).count() == 0


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 60, int(rng.integers(1, 400)), dtype=np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 60, 20, dtype=np.uint64)])
        n = np.array([len(x), len(y)])
        both = ngram_join.overlaps(x, [y])[0]
        assert both == len(np.intersect1d(x, y))
        maps = ngram_join.bitmaps([x, y])
        assert ngram_join.may_reach(maps[0], maps[1], n[0], n[1], n[0], n[1], 80) or 100 * both < 80 * (n.sum() - both)


@pytest.mark.parametrize("every", [False, True])
def test_divided_groups_lose_no_link(spark, every, monkeypatch):
    """A large group, of which some are linked through chains only, in parts of 16 sets."""
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = np.random.default_rng(8)
    base = np.arange(100, dtype=np.uint64)
    sets = []
    for i in range(90):
        s = base.copy()
        s[rng.permutation(100)[: int(rng.integers(0, 14))]] = 1000 + 100 * i + np.arange(100)[: len(s)][0]
        s = np.unique(s)
        sets.append(s)
    sets += [np.arange(9 * i, 9 * i + 100, dtype=np.uint64) + np.uint64(50_000) for i in range(20)]
    rows = [(0 if i < 100 else 1, i, len(s), s.tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "grp long, doc_id long, n long, items binary")
    got = ngram_join.linked(df.drop("grp"), df.select("doc_id", "grp"), 80, every).collect()
    near = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if rows[i][0] == rows[j][0] and near(sets[i], sets[j])}
    if every:
        assert {(max(r.a, r.b), min(r.a, r.b)) for r in got} == want
    t, u = Trees(), Trees()
    for i, j in want:
        t.join(i, j)
    for r in got:
        u.join(r.a, r.b)
    assert [t.find(i) for i in range(len(sets))] == [u.find(i) for i in range(len(sets))]


def test_sets_of_one_id_join_their_links(spark):
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(3, x), (5, x), (5, y), (7, y + " end"), (9, "other words altogether " * 3)]
    got = dict(r[::2] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {3: 3, 5: 3, 7: 3, 9: 9}


def test_words_that_collide_by_their_build_stay_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


@pytest.mark.parametrize(("size", "buckets", "fan"), [(0, 3, 4096), (7, 3, 4096), (7, 50, 6), (9, 41, 7), (200, 500, 16)])
def test_shared_keys_counts_documents(spark, size, buckets, fan, monkeypatch):
    """Directly, and with relays where there are more buckets than messages allowed: no block sends more than these."""
    monkeypatch.setattr(common, "FAN", fan)
    slots = common.slots_of(buckets)
    rng = np.random.default_rng(size)
    held = {d: {int(x) for x in rng.integers(0, 40 * max(1, size // 8), size)} for d in range(90)}
    rows, asked = [], {}
    for block in range(30):
        own = [(k, d) for d, ks in held.items() if d % 30 == block for k in ks]
        keys = common.mix(np.array([k for k, _ in own], np.uint64))
        asked[block] = keys, own
        out = common.pack_keys(block, keys, np.array([d for _, d in own], np.int64), slots)
        assert len(out["block"]) <= fan
        rows += zip(*(out[c] for c in ("block", "slot", "keys", "times")), strict=True)
    got = common.shared_keys(spark.createDataFrame(rows, common.PACKED), slots).collect()
    for block, (keys, own) in asked.items():
        times = common.read_replies(keys, slots, {r.slot: (r.mask, r.times) for r in got if r.block == block})
        for (k, _), t in zip(own, times.tolist(), strict=True):
            n = sum(k in ks for ks in held.values())
            assert t == (min(n, 255) if n > 1 else 0)


def test_many_partitions(spark, docs, monkeypatch):
    """Far more buckets and blocks than messages allowed, through relays: the same results."""
    few = ngram_join.ngram_components(docs).collect(), suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed", "kept_sha256").collect()
    monkeypatch.setattr(common, "FAN", 6)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        many = ngram_join.ngram_components(docs.limit(60)).count(), suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed", "kept_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert many[0] == 60
    assert sorted(map(str, many[1])) == sorted(map(str, few[1]))


def removed(rows, least=50):
    owner, out = {}, []
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for d, text, *_ in ordered:
        raw = (text or "").encode()
        for p in range(len(raw) - least + 1):
            owner.setdefault(raw[p : p + least], d)
    for d, text, *_ in rows:
        raw = (text or "").encode()
        cover = np.zeros(len(raw), bool)
        if d is not None:
            for p in range(len(raw) - least + 1):
                if owner[raw[p : p + least]] < d:
                    cover[p : p + least] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~cover])
        out.append((d, len(raw), int(cover.sum()), int((cover & ~np.r_[False, cover[:-1]]).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, rows):
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == removed(rows)


def test_stretches_choose_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 700, 700, 730, 5000])
    whole = suffix_dedup.anchors(data, offsets, 50)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 333)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(data, offsets, 50), strict=True))


@pytest.mark.parametrize("blocks", [1, 4])
def test_suffix_dedup_of_passages_in_many_documents(spark, blocks):
    """Passages that overlap, begin or end texts, and repeat within one; many holders of one id or of several."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abé"), n))
    passages = [word(70), word(130), word(51)]
    passages.append(passages[0][20:] + passages[2])
    rows = []
    for i in range(160):
        parts = [word(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [passages[int(rng.integers(0, 4))], word(int(rng.integers(0, 30)))]
        rows.append((int(rng.integers(0, 120)), "".join(parts)))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(blocks)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == removed(rows)


def test_suffix_dedup_keeps_columns_and_text(docs):
    out = suffix_dedup.remove_repeats(docs, keep_text=True)
    assert {"lang", "source", "score", "kept", "text"} <= set(out.columns)
    assert out.where("n_removed = 0 AND n_bytes > 0 AND length(text) = 0").count() == 0


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 7):
        runs, every = [], []
        for _ in range(k):
            m = rng.integers(0, 3, (int(rng.integers(0, 40)), 16)).astype(np.uint8)
            m = m[suffix_dedup.in_order(m)]
            every.append(m)
            runs.append((m.view(">u8").astype(np.uint64).tolist(), suffix_dedup.shares_of(m).tolist()))
        run, place, share = suffix_dedup.LoserTree(runs).merge()
        merged = np.array([every[r][p] for r, p in zip(run, place, strict=True)], np.uint8).reshape(-1, 16)
        assert [bytes(x) for x in merged] == sorted(bytes(x) for m in every for x in m)
        assert share == suffix_dedup.shares_of(merged).tolist()


def vectors(spark, n, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 24))
    near = base[: n // 4] + 0.08 * rng.standard_normal((n // 4, 24))
    x = np.concatenate([base, near, np.repeat(base[:1], 30, axis=0) + 0.02 * rng.standard_normal((30, 24))])
    rows = [(i, v.astype(np.float32).tolist(), int(i % n) % labels) for i, v in enumerate(x)]
    rows += [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, rows[0][1], None), (9004, rows[0][1][:5], 0), (9005, [None] * 24, 0), (None, rows[0][1], 0), rows[1], (9006, [float("inf")] * 24, 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def by_force(rows):
    """Links of the usable vectors of one id each: {id: set of ids}."""
    first = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and None not in v and np.isfinite(v).all() and any(v):
            first.setdefault(i, (np.array(v, float) / np.linalg.norm(np.array(v, float)), label))
    out = {i: set() for i in first}
    for i, (x, k) in first.items():
        for j, (y, m) in first.items():
            if i < j and k == m and len(x) == len(y) and x @ y >= 0.93:
                out[i].add(j)
                out[j].add(i)
    return out


@pytest.mark.parametrize("n", [300, 1200])
def test_embedding_dedup(spark, n):
    """Both with one cell a label and with many; other lengths and equal vectors are linked like all others."""
    rows, df = vectors(spark, n)
    rng = np.random.default_rng(4)
    short = rng.standard_normal((4, 7)).astype(np.float32)
    more = [(8000 + i, v.tolist(), 0) for i, v in enumerate(np.concatenate([short, short, short[:1] * 3]))] + [(8100 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows = rows + more
    want = by_force(rows)
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, df.schema)).collect()}
    found, true = sum(got[i].n_links for i in want), sum(map(len, want.values()))
    assert all(got[i].n_links <= len(want[i]) for i in want)
    assert found >= 0.95 * true > 0
    t = Trees()
    for i, js in want.items():
        for j in js:
            t.join(i, j)
    assert sum(got[i].component_id == t.find(i) for i in want) >= 0.99 * len(want)
    assert all(got[i].component_id >= t.find(i) and got[i].kept == (got[i].component_id == i) for i in want)
    assert all(got[8000 + i].n_links == len(want[8000 + i]) >= 1 for i in range(9) if i % 4 == 0)
    assert got[8100].n_links >= 40 and len({got[8100 + i].component_id for i in range(40)} | {got[5].component_id}) == 1
    assert all(r.n_links == 0 and r.kept for i, r in got.items() if i not in want)


def test_embedding_dedup_of_repeated_ids(spark):
    """Every row of an id takes part, beside null labels and a column named like one of the operator's own."""
    rng = np.random.default_rng(21)
    a, b, c, d = rng.normal(size=(4, 16))
    near = lambda v: v + 0.01 * rng.normal(size=16)
    rows = [(1, a, 0), (2, a, 0), (2, a, None), (3, b, 0), (3, c, 0), (4, near(b), 0), (5, near(c), 0), (6, c, 1), (7, d, 0), (7, d, 0), (8, d, None), (None, a, 0), (9, near(a), 0)]
    df = spark.createDataFrame([(i, [float(x) for x in v], label, "w") for i, v, label in rows], "vec_id long, embedding array<double>, label int, weight string")
    got = sorted({(r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()})
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 3, True), (4, 1, 3, False), (5, 1, 3, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 1, False)]
    assert embedding_dedup.embedding_dedup(df).count() == len(rows)


def test_embedding_dedup_of_nothing(spark):
    _, df = vectors(spark, 8)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0
    assert embedding_dedup.embedding_dedup(df.where("label IS NULL")).count() == 1


def test_collisions_are_counted():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((9, 5)), rng.standard_normal((30, 5))
    assert (embedding_dedup.collisions(a, b, 0.4) == (np.abs(a[:, None] - b[None]) <= 0.4).sum(2)).all()
