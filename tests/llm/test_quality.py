from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliant.llm.quality import THRESHOLD, TRAINING_ROWS, _sample, features, fit_label_model, fit_quality, op5_quality_classifier, self_score, train_scorer, votes
from tests.llm.helpers import TROUBLED, documents, prose


def test_accuracies_are_recovered():
    draw = np.random.default_rng(1)
    low = draw.random(20_000) < 0.25
    sensitivity, alarm = np.linspace(0.2, 0.6, 8), np.full(8, 0.005)
    cried = draw.random((20_000, 8)) < np.where(low[:, None], sensitivity, alarm)
    silent = draw.random((20_000, 8)) < 0.1
    cast = np.where(silent, 0, np.where(cried, 1, 2))
    patterns: dict[str, int] = {}
    for row in cast:
        key = "".join(map(str, row))
        patterns[key] = patterns.get(key, 0) + 1
    model = fit_label_model(patterns)
    assert abs(model.low - 0.25) < 0.03
    assert np.abs(model.alarm[1] - sensitivity).max() < 0.05
    right = np.mean([(model.posterior("".join(map(str, r))) > 0.5) == is_low for r, is_low in zip(cast, low)])
    assert right > 0.93


def test_votes():
    assert votes(prose(1, 200)).count("1") == 0
    assert votes("BUY NOW!! CHEAP!! " * 20).count("1") >= 2
    assert votes("spam " * 100).count("1") >= 2


def test_held_out_labels(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    found = op5_quality_classifier(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").select("keep", "quality").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in rows]) > 0.98


def test_troubled_rows(spark):
    rows = TROUBLED + [(100 + i, prose(i, 80)) for i in range(60)] + [(500 + i, "WIN!! CASH!! NOW!! " * 30) for i in range(15)]
    frame = documents(spark, rows)
    model = fit_quality(frame)
    judged = frame.select("doc_id", model.judge(frame["text"]).alias("j")).select("doc_id", "j.score").collect()
    assert len(judged) == len(rows)
    by_id = {r["doc_id"]: r["score"] for r in judged}
    assert by_id[1] == by_id[2] == by_id[3] == 1.0
    assert all(by_id[100 + i] < THRESHOLD for i in range(60)) and all(by_id[500 + i] >= THRESHOLD for i in range(15))


def test_the_sample_is_of_distinct_texts(spark):
    # Where the repeated text hashes low it is drawn, but once; the rest is drawn whatever the partitions.
    texts = [(prose(i, 20),) for i in range(100)]
    frame = spark.createDataFrame(texts, "text string").withColumn("h", F.xxhash64("text"))
    hashed = [r["text"] for r in frame.orderBy("h").collect()]
    rows = texts + [(hashed[0],)] * 500
    for n in (1, 7):
        drawn = [r["text"] for r in _sample(spark.createDataFrame(rows, "text string").repartition(n), 30).collect()]
        assert sorted(drawn) == sorted(hashed[:30])


def test_the_query_equals_a_plain_pass(spark, small):
    """Votes, expectation-maximisation, training and scores once more, without Spark."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    texts = [t for _, t in rows if t.strip(" ")]
    labels = fit_label_model(dict(sorted(Counter(map(votes, texts)).items())))
    data = [(*features(t, {}), labels.posterior(votes(t))) for t in set(texts)]
    weights = train_scorer(sorted(data, key=lambda r: (r[0].tobytes(), r[1].tobytes())))
    found = op5_quality_classifier(spark, small).collect()
    assert len(found) == len(rows) and len({t for t in texts}) <= TRAINING_ROWS
    by_id = {r["doc_id"]: r for r in found}
    for key, text in rows:
        own = by_id[key]
        score = self_score(text, weights, {})
        assert own["votes"] == votes(text) and abs(own["score"] - score) < 1e-9 and own["keep"] == (own["score"] < THRESHOLD)
        assert abs(own["posterior"] - labels.posterior(votes(text))) < 1e-9


def test_no_texts(spark):
    model = fit_quality(documents(spark, []))
    assert documents(spark, []).select(model.score(F.col("text"))).isEmpty()
    assert fit_quality(documents(spark, [(1, None), (2, "")])).labels.low == 0.2
