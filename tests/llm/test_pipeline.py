"""Stages of the corpus pipeline, each on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from foliant.llm.common import scratch, written
from tests.llm.helpers import TROUBLED, documents, prose
from tests.llm.test_neardup import edited

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, prose(500 + i, 30)) for i in range(3)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(100 + i, prose(i, 120)) for i in range(40)]
    rows += [(200 + i, prose(0, 120)) for i in range(5)] + [(300 + i, edited(prose(1, 120), i, 1)) for i in range(5)]
    rows += [(400 + i, "WIN!! CASH!! NOW!! " * 40) for i in range(10)]
    rows += [(500, prose(60, 50) + " " + prose(501, 30)), (501, "mail me: a.b@c.example.com " + prose(61, 60)), (None, prose(62, 50)), (None, prose(62, 50)), (7, prose(63, 50)), (7, prose(64, 50))]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = written(STAGES["quality"](spark, docs, sf_dir), "t")
    assert kept.columns == columns and kept.count() == docs.count() - 10 and kept.where("doc_id between 400 and 409").isEmpty()
    single = written(STAGES["near_duplicate"](spark, kept, sf_dir), "t")
    assert single.columns == columns
    assert single.where("doc_id = 100 or doc_id between 200 and 204").count() == 1
    assert single.where("doc_id = 101 or doc_id between 300 and 304").count() == 1
    # Of two equal rows without id one stays, and so do two texts under one id.
    assert single.where("doc_id is null").count() == 1 and single.where("doc_id = 7").count() == 2
    assert single.count() == kept.count() - 11
    clean = written(STAGES["decontamination"](spark, single, sf_dir), "t")
    assert clean.columns == columns and clean.where("doc_id = 500").isEmpty() and clean.count() == single.count() - 1
    private = written(STAGES["personal_data"](spark, clean, sf_dir), "t")
    assert private.columns == columns and private.count() == clean.count()
    row = private.where("doc_id = 501").first()
    assert row["text"].startswith("mail me: [EMAIL] ") and row["n_chars"] == len(row["text"])
    assert private.exceptAll(clean).count() == 1
    packed = STAGES["packing"](spark, private, sf_dir)
    assert packed.where("piece = 0").count() == private.count()


def test_troubled_rows_and_empty_tables(spark, sf_dir):
    for rows in (TROUBLED, []):
        docs = written(documents(spark, rows), "t")
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), name)


def test_run(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.where("piece = 0 and doc_id between 400 and 409").isEmpty()
    assert packed.where("doc_id = 102").count() == 1


def test_the_same_rows_stay_in_every_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for n in (1, 5):
        stage = written(docs.repartition(n, "text"), "t")
        for name in ("quality", "near_duplicate", "decontamination", "personal_data"):
            stage = written(STAGES[name](spark, stage, sf_dir), name)
        kept.append(sorted(map(str, stage.collect())))
    assert kept[0] == kept[1]
    ids = {r["doc_id"] for r in stage.collect()}
    assert {100, 101} <= ids and not ids & {*range(200, 205), *range(300, 305)}


def test_columns_named_like_the_stages_own(spark, sf_dir):
    rows = [(1, prose(1, 60), "a", "b"), (2, prose(1, 60), "c", "d"), (3, "mail a.b@c.example.com " + prose(3, 60), "e", "f")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, row_key string, before string"), "t")
    for name in ("near_duplicate", "decontamination", "personal_data"):
        docs = written(STAGES[name](spark, docs, sf_dir), name)
    assert sorted((r["doc_id"], r["row_key"], r["before"]) for r in docs.collect()) == [(1, "a", "b"), (3, "e", "f")]


def test_scratch_removes_what_is_not_kept(spark):
    with scratch() as keep:
        gone, stays = written(spark.range(3), "t"), keep(written(spark.range(4), "t"))
    assert stays.count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        gone.count()


def test_stages_take_frames_that_are_no_files(spark, sf_dir):
    docs = documents(spark, [(1, prose(1, 50)), (2, prose(1, 50))])
    assert STAGES["near_duplicate"](spark, docs, sf_dir).count() == 1
