"""The stages one after the other, each on what its predecessor kept."""

import re

import pytest

import corpus_pipeline
from pixelframe.llm import quality_classifier, quality_rules


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, kept):
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(d.columns == first.columns for d in kept[:4])
    model = quality_classifier.learn(first, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in quality_classifier.classify(first, model).collect() if r.predicted}
    assert {r.doc_id for r in kept[0].collect()} == want
    ruled = {r.doc_id for r in quality_rules.quality_rules(kept[0]).collect() if r.kept}
    assert {r.doc_id for r in kept[1].collect()} == ruled

    def sets(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = {r.doc_id: sets(r.text) for r in kept[1].collect()}
    root = {d: d for d in own}
    for _ in range(8):
        for a, x in own.items():
            for b, y in own.items():
                if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id for r in kept[2].collect()} == {d for d, r in root.items() if d == r}
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    assert set(texts) == {r.doc_id for r in kept[2].collect()}
    assert {r.doc_id for r in kept[4].collect()} == set(texts)
    assert kept[3].where("n_chars <> length(text)").count() == 0


CLASHING = ("doc_id", "text", "n_chars", "kept", "score", "predicted", "n_words", "n_bytes", "n_removed", "_block", "component_id", "sequence_id", "x")


def test_odd_rows_and_clashing_columns(spark, rows, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts; columns named like the stages' results keep their values."""
    sf, schema = "/root/testdata/sf0.001", "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHING[3:])
    mine = [(r[0], r[1], None if i % 7 == 0 else -1, *(f"{c}{r[0]}" if i % 5 else None for c in CLASHING[3:])) for i, r in enumerate(rows)]
    mine += mine[5:8]
    docs = spark.createDataFrame(mine, schema).repartition(2)
    given = {}
    for r in mine:
        given.setdefault(r[0], set()).add(r[3:])
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert tuple(docs.columns) == CLASHING
            got = docs.collect()
            assert 0 < len(got) <= len(mine)
            assert all(tuple(r)[3:] in given[r.doc_id] for r in got)
    assert docs.where("offset < 0 OR length < 1").count() == 0


def test_stages_of_nothing(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame([], out.schema)
