"""Operators 11 to 13 against brute force, on the shared rows and on built cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelframe.llm import collocations, decontamination, source_divergence, terms

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- terms


def test_distinct_is_exact(monkeypatch):
    raw = np.frombuffer(b"one two one three  two on", np.uint8)
    starts, ends, _ = terms.runs(raw != 32, np.array([0, len(raw)]))
    for hashes in (terms.span_hashes, lambda d, s, e: np.zeros(len(s), np.uint64)):  # also where all hashes are equal
        monkeypatch.setattr(terms, "span_hashes", hashes)
        codes, first = terms.distinct(raw, starts, ends)
        words = [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        assert [words[first[c]] for c in codes] == words and len(first) == 4
    assert terms.strings(raw, starts, ends).to_pylist() == [w.decode() for w in words]


# --- 11


def divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))) for text, lang, source in rows]
    held, count, groups = Counter(), Counter(), sorted({(a, b) for a, b, _ in docs})
    for lang, source, ws in docs:
        held.update((lang, w) for w in set(ws))
        count.update((lang, source, w) for w in ws)
    out = []
    for lang, source in groups:
        kept = [w for a, w in held if a == lang and held[a, w] >= least]
        own = [s for a, s in groups if a == lang]
        n = {s: sum(count[lang, s, w] for w in kept) for s in own}
        p = lambda s, w: 1 + 10**9 * (count[lang, s, w] + 5) // (n[s] + 5 * len(kept))  # noqa: B023, E731
        q = lambda w: 1 + 10**9 * (sum(count[lang, s, w] for s in own) + 5) // (sum(n.values()) + 5 * len(kept))  # noqa: B023, E731
        pairs = sorted((-sum(abs(p(source, w) - p(s, w)) for w in kept), s.encode()) for s in own if s != source)
        found = sorted((q(w) - p(source, w), w.encode()) for w in kept if count[lang, source, w] and p(source, w) > q(w))[:top]
        for part, items in (("pair", pairs), ("term", found)):
            out += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [None, (64, 16, 4)])
def test_source_divergence(spark, docs, rows, none, monkeypatch, sizes):
    if sizes:  # many chunks, bitmaps for few terms, tiles of few sources
        for name, size in zip(("CHUNK", "DENSE", "SIDE"), sizes, strict=True):
            monkeypatch.setattr(source_divergence, name, size)
    plain = [(r[1], r[2], r[3]) for r in rows]
    least, top = (5, 3) if sizes else (4, 50)
    got = source_divergence.source_divergence(docs, least, top).collect()
    assert sorted(map(tuple, got)) == divergence(plain, least, top)
    assert source_divergence.source_divergence(none).count() == 0
    assert {(r.part, r.value) for r in source_divergence.source_divergence(docs, 10**6).collect()} == {("pair", 0)}


def test_joint_cells():
    rng = np.random.default_rng(3)
    for terms_ in (1, 40, 300):
        sides = []
        for _ in range(2):
            level = rng.integers(0, 5, terms_) * rng.integers(0, 2, terms_)
            x = source_divergence.Levels(terms_)
            x.p[0] = 7
            for k in sorted(set(level.tolist()) - {0}):
                ids = np.flatnonzero(level == k)
                bits = np.zeros(source_divergence.BITS, np.uint8)
                bits[ids] = 1
                dense = k % 2 == 0
                x.add(int(100 * k + len(sides)), None if dense else ids, np.packbits(bits, bitorder="little").tobytes() if dense else None)
            sides.append((np.where(level > 0, 100 * level + len(sides), 7), x.close()))
        assert source_divergence.joint(sides[0][1], sides[1][1]) == np.abs(sides[0][0] - sides[1][0]).sum()


def test_shares_beyond_64_bits(spark):
    n, total, v = 3 * 10**17, 4 * 10**18, 10**6
    df = spark.createDataFrame([(n, total, v)], "n long, t long, v long")
    assert df.select(source_divergence.share("n", "t")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


# --- 12


def contamination(texts, items, window):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for name, text in items:
        ws = word(text)
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            windows[tuple(ws[i : i + m])].add(name)
    out = []
    for text in texts:
        ws, hit, names = word(text), set(), set()
        for m in {len(w) for w in windows}:
            for i in range(len(ws) - m + 1):
                if (w := tuple(ws[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    names |= windows[w] - {None}
        out.append((len(ws), sorted(hit), sorted(names)))
    return out


@pytest.mark.parametrize("most", [decontamination.MOST_WORDS, 60])
def test_contamination(spark, docs, rows, none, most):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    text = next(r[1] for r in rows if r[1] and len(r[1].split()) > 80).split()
    items += [(900, " ".join(text[5:30])), (900, " ".join(text[40:52])), (901, " ".join(text[10:14])), (902, "one, TWO three"), (903, None), (904, " . "), (None, " ".join(text[60:75])), (905, " ".join(text[5:30])), (906, "é 日本"), (907, "short short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination([r[1] for r in rows], [(None if i is None else str(i), t) for i, t in items], 10)
    got = decontamination.contamination(docs.withColumnRenamed("score", "items"), bench, most_words=most).collect()
    assert Counter((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.first, s.after)), tuple(r["items"])) for r in got) == Counter((r[0], n, tuple(hit), tuple(names)) for r, (n, hit, names) in zip(rows, want, strict=True))
    for r in got:
        raw = (r.text or "").encode()
        assert [len(decontamination.item_words(raw[s["from"] : s.to].decode())) for s in r.spans] == [s.after - s.first for s in r.spans]
    assert decontamination.contamination(none, bench).count() == 0
    assert {r.n_words for r in decontamination.contamination(docs, bench.where("false")).where("size(spans) > 0").collect()} == set()


def test_long_items_in_pieces(spark):
    words = [f"w{i}" for i in range(25_000)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[a:b])) for i, (a, b) in enumerate(((9_990, 10_010), (19_995, 20_015), (5, 14), (24_990, 25_000)))], "doc_id long, text string")
    assert {r.doc_id: [(s.first, s.after) for s in r.spans] for r in decontamination.contamination(docs, bench, most_words=8_000).collect()} == {0: [(0, 20)], 1: [(0, 20)], 2: [], 3: [(0, 10)]}


def test_automaton_against_search():
    rng = np.random.default_rng(5)
    for trial in range(60):
        letters = [b"a", b"b", b"c"][: 2 + trial % 2]
        items = [(str(k), [letters[i] for i in rng.integers(0, len(letters), rng.integers(0, 14))]) for k in range(6)]
        automaton = decontamination.Automaton(items, 4)
        text = [letters[i] for i in rng.integers(0, len(letters), 60)]
        code = {w: i for i, w in enumerate(automaton.vocabulary)}
        found = defaultdict(set)
        for i, m, names in automaton.ends([code.get(w, -1) for w in text]):
            found[i + 1 - m, m] |= names
        want = defaultdict(set)
        for name, ws in items:
            m = min(4, len(ws))
            for w in {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)} if m else ():
                for i in range(len(text) - m + 1):
                    if tuple(text[i : i + m]) == w:
                        want[i, m].add(name)
        assert found == want


def test_decontaminate(spark):
    item = " ".join(f"q{i}" for i in range(12))
    clean = " ".join(f"c{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"é {clean}. {item.upper()}! {clean}"), (2, item), (3, clean), (4, None), (5, ""), (6, f"{clean} {item}, x {item}")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert got[1].text == f"é {clean}. ! {clean}" and got[1].kept and got[1]["items"] == ["a"]
    assert not got[2].kept and got[2].text == item
    assert got[3].text == clean and got[4].text is None and got[5].text == "" and all(got[i].kept for i in (3, 4, 5, 6))
    assert got[6].text == f"{clean} , x "
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


# --- 13


def counted(rows):
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und", 0, None] += len(ws)
            f.update((lang or "und", k, " ".join(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    return f


def mined(f, least, top):
    out = []
    for lang in {a for a, *_ in f}:
        cand = {w: n for (a, k, w), n in f.items() if a == lang and k > 1 and n >= least}
        scored = []
        for phrase, a in cand.items():
            ws = phrase.split(" ")
            cut = []
            for k in range(1, len(ws)):
                x, y = f[lang, k, " ".join(ws[:k])], f[lang, len(ws) - k, " ".join(ws[k:])]
                cut.append((10**6 * a * a // (x * y), k, x, y))
            if not any(f" {phrase} " in f" {other} " and other != phrase and 100 * n >= 50 * a for other, n in cand.items()):
                scored.append((-min(cut)[0], -a, phrase.encode(), min(cut)))
        out += [(lang, i + 1, p.decode(), -a, x, y, f[lang, 0, None], s) for i, (_, a, p, (s, _, x, y)) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,shards", [(10, 4), (3, 1), (4, 5)])
def test_collocations(spark, docs, rows, none, least, shards):
    f = counted([(r[1], r[2]) for r in rows])
    got = collocations.phrase_counts(docs, least, shards)
    want = {k: n for k, n in f.items() if n >= least or not k[1] and n}
    assert {(r.lang, r.words, r.phrase): r.f for r in got.collect()} == want
    assert sorted(map(tuple, collocations.collocations(docs, least, 40, shards).collect())) == mined(f, least, 40)
    if shards == 1:
        assert collocations.collocations(none, least).count() == 0


def test_each_phrase_is_counted_for_one_cycle(spark, rows, docs, monkeypatch):
    """The counters of the mining themselves, before the circle that counts texts, are the phrases' counts."""
    seen = []
    inner = collocations.merged
    monkeypatch.setattr(collocations, "merged", lambda *a: seen.append(inner(*a)) or seen[-1])
    monkeypatch.setattr(collocations, "HELD", 100)  # workers send in between
    f = counted([(r[1], r[2]) for r in rows])
    collocations.phrase_counts(docs, 6, 3).count()
    assert 3 < len(seen) <= 9
    got = defaultdict(Counter)
    for r in seen[-1].collect():
        keys, counts, steps = collocations._unpacked(r.n_keys, bytes(r["keys"]), bytes(r.counts), bytes(r.steps))
        assert len(np.unique(keys)) == len(keys)
        got[r.words].update(Counter(counts.tolist()))
    for k in (1, 2, 3):  # what ended below the threshold is gone, at the latest with the last step
        assert got[k] == Counter(n for (_, w, _), n in f.items() if w == k and n >= 6)


def test_phrases_of_one_cell_are_kept_apart(docs, rows):
    want = {k: n for k, n in counted([(r[1], r[2]) for r in rows]).items() if n >= 10 or not k[1] and n}
    assert {(r.lang, r.words, r.phrase): r.f for r in collocations.phrase_counts(docs, 10, 2, table=5).collect()} == want
