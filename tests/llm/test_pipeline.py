"""The pipeline's stages on the smallest tables: columns, and what each decides."""

import os
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from fieldmill.llm import common, jaccard, toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.staged(stage(spark, docs, sf), "test")
        assert docs.columns == before.columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    assert jaccard.components(docs).where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_line_stage_drops_all_near_copies(spark):
    """Documents of one line go whose line is another's but for three words, though all of its runs are in thirty lines or more."""
    rng = random.Random(61)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    first, second = ([[word() for _ in range(12)] for _ in range(30)] for _ in range(2))
    first += [[*p[:9], word(), word(), word()] for p in first[:3]]
    said = [" ".join(p + q) for p in first for q in second]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(said)], "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(900))


def test_texts_go_to_workers_in_small_batches(spark):
    """After a stage that runs Python, no batch that a worker gets has over a thousand rows."""
    sf = "/root/testdata/sf0.001"
    corpus_pipeline.drop_leaks(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    got = [r["n"] for r in spark.range(0, 3500, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 3500 and max(got) <= 1000


def test_numbers_and_groups(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id as k")
    got = common.numbered(df, ["g"], ["k"], "slot", 1000, per_part=50).collect()
    for g in range(3):
        assert sorted(r["slot"] for r in got if r["g"] == g) == list(range(len([r for r in got if r["g"] == g])))
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (3, 1)], "a long, b long")
    assert {(r["node"], r["component"]) for r in common.connected(edges).collect()} == {(5, 1), (4, 1), (3, 1), (1, 1), (9, 8), (8, 8)}


def test_groups_settle_without_a_round_more(spark, monkeypatch):
    """Stars take no round, each of which writes a table, and drawn graphs get the components of brute force."""
    names, staged = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: names.append(name) or staged(df, name))
    stars = spark.createDataFrame([(9, 2), (2, 8), (7, 2), (7, 2), (5, 3)], "a long, b long")
    assert {(r["node"], r["component"]) for r in common.connected(stars).collect()} == {(9, 2), (8, 2), (7, 2), (2, 2), (5, 3), (3, 3)}
    assert names == ["edges"]
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(least)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert {(r["node"], r["component"]) for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()} == set(least.items())


def test_toxic_model_is_trained_away_from_the_driver(spark, monkeypatch):
    """The driver's process neither holds the training texts nor fits; the model is that of fit() on the same documents, in order, but for rounding."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    real, driver = toxicity.fit, os.getpid()

    def elsewhere(documents, share):
        assert os.getpid() != driver
        return real(documents, share)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    model = toxicity.trained(docs, labels, 800, 800)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    rows, share = toxicity.training_documents(docs, labels, 800, 800)
    want = real([(r["text"] or "", r["toxic"]) for r in rows.orderBy("toxic", "doc_id", "text").collect()], share)
    # workers sum products with one thread
    assert np.allclose(model.weights, want.weights, rtol=0, atol=1e-4 * np.abs(want.weights).max())
    assert np.allclose([*model.slopes, model.shift], [*want.slopes, want.shift], rtol=1e-3)
    one = docs.where("text is not null").orderBy("doc_id").first()
    assert abs(scores[one["doc_id"]] - want.score(*toxicity._joined([one["text"]]))[0]) < 1e-3
