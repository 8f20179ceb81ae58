"""File sources, whole runs, results and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foliant.operators import output, ranking
from foliant.plans import pipeline
from foliant.sources import collections, documents, providers
from foliant.streaming.collections import collection_stream, run_stream


def collection(folder, name, body):
    path = folder / name
    path.mkdir()
    (path / "trip_input.json").write_text(body if isinstance(body, str) else json.dumps(body))
    return path


GOOD = {
    "challenge_info": {"challenge_id": "c", "test_case_name": "t", "description": "d"},
    "documents": [{"filename": "a.txt", "title": "A"}, {"filename": "b.txt", "title": "B"}],
    "persona": {"role": "Travel Planner"},
    "job_to_be_done": {"task": "Plan a trip"},
}


def test_broken_collections_are_rows(spark, tmp_path):
    collection(tmp_path, "Collection 1", GOOD)
    collection(tmp_path, "Collection 2", "{not json")
    collection(tmp_path, "Collection 3", {k: v for k, v in GOOD.items() if k != "persona"})
    collection(tmp_path, "Other", GOOD)
    rows = {r["collection"]: r for r in collections.discover(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Collection 1", "Collection 2", "Collection 3"}
    assert rows["Collection 1"]["errors"] == []
    assert rows["Collection 2"]["errors"] == ["not valid JSON"]
    assert rows["Collection 3"]["errors"] == ["missing key: persona"]


def test_files_are_bound_and_parsed(spark, tmp_path):
    folder = collection(tmp_path, "Collection 1", GOOD)
    (folder / "PDFs").mkdir()
    (folder / "PDFs" / "a.txt").write_bytes("Título\nLine two\fPage two".encode("latin-1"))
    (folder / "a.txt").write_text("the wrong one")
    wanted = collections.wanted_files(collections.discover(spark, str(tmp_path)))
    files = documents.read_binary(spark, f"{tmp_path}/*/*")
    found, missing = collections.bound_files(wanted, files)
    assert [r["filename"] for r in missing.collect()] == ["b.txt"]
    blocks = providers.parsed_files(files.join(found.select("path"), "path"), "text", None).orderBy("block_no").collect()
    assert [(b["page_number"], b["text"]) for b in blocks] == [(1, "Título"), (1, "Line two"), (2, "Page two")]


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"no pdf")
    rows = providers.parsed_files(documents.read_binary(spark, str(tmp_path))).collect()
    assert len(rows) == 1 and rows[0]["status"].startswith("pdf_layout: ") and rows[0]["text"] is None


def test_dates_and_decoding(spark):
    frame = spark.createDataFrame([(bytearray("é".encode()), "D:20240115"), (bytearray("é".encode("latin-1")), "2024")], "b binary, d string")
    rows = frame.select(documents.decoded(F.col("b")).alias("t"), documents.pdf_date(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("é", "2024-01-15"), ("é", None)]


def test_run_is_the_same_for_any_partitioning(spark, small):
    from foliant.plans.layout_queries import blocks

    found = []
    for n in (1, 7):
        own = blocks(spark, small).repartition(n)
        result = pipeline.run(own, "Travel Planner", "Plan a trip of 4 days for a group of 10 college friends.")
        assert result.select(output.fulfils_contract().alias("ok")).where("not ok").isEmpty()
        found.append(sorted(map(str, result.collect())))
    assert found[0] == found[1]


def test_title_ties_and_caps(spark):
    rows = [("c", d, 0, f"doc-{d}", "Same Title Here", 1, "text " * 40) for d in range(5)] + [("c", 9, 0, "doc-9", "", 1, "")]
    frame = spark.createDataFrame(rows, "collection string, doc_ord long, section_no int, document string, title string, page_number int, content string")
    kept = {r["doc_ord"] for r in ranking.distinct_collection_titles(frame).collect()}
    assert kept == {0, 9}
    assert ranking.ranked(frame.limit(0), "p", "j").isEmpty()


def test_vegetarian_filter_wants_the_word(spark):
    rows = [("Soup", "beef broth"), ("Salad", "green leaves")]
    frame = spark.createDataFrame(rows, "title string, content string")
    assert ranking.dietary_filter(frame, "Cook", "vegetarian menu").count() == 1
    assert ranking.dietary_filter(frame, "Cook", "vegan menu").count() == 2
    assert ranking.dietary_filter_passages(frame, "vegan menu").count() == 1


def test_stream_of_collections(spark, tmp_path):
    inputs = tmp_path / "in"
    inputs.mkdir()
    collection(inputs, "Collection 1", GOOD)
    run = lambda batch: batch.select(collections.persona_text().alias("persona"))
    run_stream(collection_stream(spark, str(inputs)), run, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["persona"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["Travel Planner"]


def test_schema_messages(spark):
    frame = spark.createDataFrame([('{"a": 1}',), ('{"b": 1}',), ("nope",)], "j string")
    rules = {"$.a: required": lambda p: p["a"].isNotNull()}
    assert [r[0] for r in frame.select(output.schema_messages(F.col("j"), "a int", rules)).collect()][:2] == [[], ["$.a: required"]]
