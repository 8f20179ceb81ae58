"""Repair of fragments, titles from pieces, and what a run keeps beside its data."""

from __future__ import annotations

import json
import logging
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from foliant import config, runtime
from foliant.operators import embed, fragments, output, titles
from foliant.operators.layout import scanned_documents
from foliant.operators.vectors import nearest
from foliant.plans import catalog
from foliant.sources import providers
from foliant.sources.documents import envelope
from foliant.sources.work import scratch, written

SMALL = "/root/testdata/sf0.001"


def block(n, text, x, y, size=16.0, page=1, width=None, doc=1):
    return (doc, page, n, text, float(x), float(y), float(width if width is not None else 10 * len(text)), 12.0, "Head", float(size), 20)


SCHEMA = "doc_id long, page_number int, block_no int, text string, x double, y double, width double, height double, font_name string, font_size double, font_flags int"


def texts(frame):
    return [r["text"] for r in frame.orderBy("doc_id", "page_number", "block_no").collect()]


def test_lines_in_pieces_become_one_block(spark):
    rows = [
        block(0, "Foundation", 0, 100), block(1, "Level", 105, 100), block(2, "Extensions", 160, 101),  # three words of a heading
        block(3, "T", 0, 200, width=10), block(4, "HERE", 10, 200),  # a letter that touches a word
        block(5, "body text", 0, 300, 9.0), block(6, "in small print", 92, 300, 9.0),  # too small for a heading
        block(7, "Left", 0, 400), block(8, "Right", 300, 400),  # too far apart
    ]
    found = fragments.reconstructed_lines(spark.createDataFrame(rows, SCHEMA))
    assert texts(found) == ["Foundation Level Extensions", "THERE", "body text", "in small print", "Left", "Right"]
    first = found.where("block_no = 0").first()
    assert (first["n_merged"], first["x"], first["width"], first["font_size"]) == (3, 0.0, 260.0, 16.0)


def plain_lines(rows):
    """The islands once more, block by block."""
    by_line = {}
    for r in rows:
        by_line.setdefault((r[0], r[1], round(r[5] / 2) * 2), []).append(r)
    out = []
    for line in by_line.values():
        line.sort(key=lambda r: (r[4], r[2]))
        runs = [[line[0]]]
        for before, r in zip(line, line[1:]):
            near = r[4] - (before[4] + before[6]) < before[9] * (1.0 if before[9] > 15 else 0.8)
            if near and abs(r[9] - before[9]) < 5:
                runs[-1].append(r)
            else:
                runs.append([r])
        out += [len(run) for run in runs]
    return sorted(out)


def test_runs_equal_a_plain_pass(spark):
    draw = random.Random(2)
    rows = [block(i, "Word" * draw.randrange(1, 4), draw.randrange(0, 300), 20 * draw.randrange(1, 12), draw.choice((16, 18, 9)), 1, 30, draw.randrange(3)) for i in range(150)]
    found = fragments.reconstructed_lines(spark.createDataFrame(rows, SCHEMA))
    # Put back together, merged and other blocks are all blocks.
    assert found.agg(F.sum("n_merged")).first()[0] == len(rows)
    merged = [r["n_merged"] for r in found.collect()]
    runs = plain_lines(rows)
    for n in {m for m in merged if m > 1}:
        assert merged.count(n) <= runs.count(n)


def test_the_two_statements_of_a_merge_agree(spark):
    draw = random.Random(5)
    words = ["Foundation", "level", "of", "THE", "Annual", "report.", "Why?", "and", "Overview:", "it is a long text that goes on", "x" * 60]
    pairs = []
    for i in range(400):
        a, b = (" ".join(draw.choice(words) for _ in range(draw.randrange(1, 5))) for _ in range(2))
        pairs.append((i, a, b, draw.choice((11.0, 12.0, 16.0)), draw.choice((11.0, 12.0, 16.0, 18.0)), float(draw.randrange(0, 200, 10)), float(draw.randrange(0, 40, 4))))
    frame = spark.createDataFrame(pairs, "i int, a string, b string, s double, t double, x double, y double")
    make = lambda text, size, x, y: F.struct(F.col(text).alias("text"), F.col(size).alias("font_size"), x.alias("x"), y.alias("y"), F.lit(1).alias("page_number"))
    both = frame.select("i", fragments.same_heading(make("a", "s", F.lit(0.0), F.lit(0.0)), make("b", "t", F.col("x"), F.col("y"))).alias("m")).collect()
    plain = {i: fragments._same_heading({"text": a, "font_size": s, "x": 0.0, "y": 0.0}, {"text": b, "font_size": t, "x": x, "y": y}) for i, a, b, s, t, x, y in pairs}
    assert {r["i"]: r["m"] for r in both} == plain and {True, False} == set(plain.values())


def test_groups_and_strict_reconstruction(spark):
    rows = [
        block(0, "Foundation Level", 0, 300), block(1, "Extensions", 0, 280),  # two lines of one heading
        block(2, "An unrelated line of body text that is far below the heading", 0, 100, 11.0),
        block(3, "1.", 0, 500, 11.0, 2), block(4, "Name of the", 20, 505, 11.0, 2), block(5, "applicant", 20, 510, 11.0, 2), block(6, "Signature", 300, 515, 11.0, 2),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert texts(fragments.grouped_fragments(frame).where("page_number = 1")) == ["Foundation Level Extensions", rows[2][3]]
    strict = fragments.reconstructed_text(frame.where("page_number = 2"))
    assert texts(strict) == ["1. Name of the", "applicant", "Signature"]  # a number with ten characters is complete
    assert strict.agg(F.sum("n_merged")).first()[0] == 4
    assert fragments.grouped_fragments(frame.limit(0)).isEmpty() and fragments.reconstructed_text(frame.limit(0)).isEmpty()


def test_a_block_stops_taking_followers_when_complete():
    rows = [dict(zip(fragments.COLUMNS, (1, 1, i, t, 0.0, 10.0 * i, 5.0, 12.0, "", 11.0, 0))) for i, t in enumerate(["Details of", "the applicant", "and of the", "service", "Other"])]
    found = fragments.reconstruct_page(rows)
    assert [(b["text"], b["n_merged"]) for b in found] == [("Details of the applicant", 2), ("and of the service", 2), ("Other", 1)]
    assert fragments.is_complete("Done.") and fragments.is_complete("2. a longer description") and not fragments.is_complete("one two")
    assert fragments.mended("a  ( b ) , c") == "a (b), c"


def test_pages_and_order(spark):
    frame = spark.createDataFrame([(1, 3, 9), (2, None, 9), (3, None, None)], "k int, page_number int, page int")
    assert [r["p"] for r in frame.orderBy("k").select(fragments.page_of(frame).alias("p")).collect()] == [3, 9, 1]
    assert [r["p"] for r in frame.drop("page").orderBy("k").select(fragments.page_of(frame.drop("page")).alias("p")).collect()] == [3, 1, 1]


@pytest.mark.parametrize(
    ("title", "clean"),
    [
        ("  Annual report , ", "Annual report"),
        ("Annual Annual report", "Annual report"),
        ("Report of report", "Report of"),
        ("RFP: R RFP: R to develop", "RFP: o develop"),  # the mending of repeated prefixes takes a letter
        ("Overview :Foundation-Level", "Overview: Foundation - Level"),
        ("quest f oposal", "Request for Proposal"),
        ("", ""),
    ],
)
def test_clean_titles(title, clean):
    assert titles.cleaned_title(title) == clean


def test_titles_from_pieces():
    pieces = [("Overview", 200, 0.0, 700.0), ("Foundation", 200, 0.0, 650.0), ("Level Extensions", 200, 120.0, 652.0)]
    assert [[p[0] for p in line] for line in titles.lines_of(pieces, 5.0)] == [["Overview"], ["Foundation", "Level Extensions"]]
    assert titles.line_text([("RFP: R", 1, 0.0, 0.0), ("RFP: R", 1, 5.0, 0.0), ("to develop", 1, 9.0, 0.0)]) == "RFP: Request to develop"
    assert ("Overview Foundation Level Extensions", 280) in titles.compound_titles(pieces, 5.0)
    assert titles.best_title(pieces, 5.0) == "Foundation Level Extensions"
    assert titles.best_title([], 5.0) == "" and titles.best_title([("SHORT", 500, 0.0, 0.0)], 5.0) == ""
    assert not titles.accepted("Draft of the annual report") and titles.accepted("Report on the state of libraries")


def test_titles_of_documents(spark):
    rows = [block(0, "Report on the State", 0, 100, 24.0), block(1, "of Digital Libraries", 0, 80, 24.0), block(2, "body text of the first page", 0, 300, 11.0)]
    found = titles.reconstructed_titles(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["doc_id"] for r in found] == [1] and "Digital Libraries" in found[0]["title"] and "Report" in found[0]["title"]


def test_lru_cache(spark, tmp_path):
    cache = runtime.LruCache(2)
    cache.put("a", 1), cache.put("b", [2]), cache.get("a"), cache.put("c", {"x": 3})
    assert (cache.get("a"), cache.get("b"), cache.get("c"), len(cache)) == (1, None, {"x": 3}, 2)
    cache.persist(spark, str(tmp_path / "c"))
    other = runtime.LruCache(5)
    other.load(spark, str(tmp_path / "c"))
    assert other.get("c") == {"x": 3} and other.get("a") == 1
    other.invalidate("a")
    assert other.get("a") is None
    other.clear()
    assert len(other) == 0


def test_monitor_and_report(spark, tmp_path):
    monitor = runtime.Monitor(limit=100)
    with monitor.stage("one"), monitor.stage("two"):
        pass
    report = monitor.report()
    assert report["status"] == "pass" and abs(sum(s["percent"] for s in report["stages"].values()) - 100) < 1e-6
    with pytest.raises(ValueError), monitor.stage("three"):
        raise ValueError("no")
    assert monitor.report()["status"] == "fail" and monitor.errors == ["three: no"]
    monitor.save(spark, str(tmp_path / "r"))
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()))["status"] == "fail"


def test_logs_are_json_lines(tmp_path):
    log = runtime.logger("foliant.test", str(tmp_path / "log"))
    assert runtime.logger("foliant.test") is log
    log.info("done", extra={"fields": {"n": 3}})
    logging.shutdown()
    line = json.loads((tmp_path / "log").read_text().splitlines()[0])
    assert (line["message"], line["n"], line["level"]) == ("done", 3, "INFO")


def test_models_load_once_and_may_be_missing():
    loads = []

    def absent():
        raise ImportError("no library")

    models = runtime.ModelManager({"here": lambda: loads.append(1) or object(), "absent": absent})
    assert models.get("here") is models.get("here") and len(loads) == 1
    first = models.get("here")
    assert models.reload("here") is not first
    assert models.validate() == {"absent": False, "here": True} and not models.is_available("unknown")


def test_embedding_by_configuration(spark):
    class Model:
        def encode(self, texts, batch_size):
            import numpy as np

            return np.array([[len(t), t.count("a")] for t in texts])

    frame = spark.createDataFrame([("aa",), ("aa",), ("b",), (None,)], "t string")
    own = embed.embedded(frame, "t", replace(config.DEFAULT, embedding_model_path="/models/own"), load=lambda path: Model())
    assert sorted(r["embedding"] for r in own.collect()) == [[0.0, 0.0], [1.0, 0.0], [2.0, 2.0], [2.0, 2.0]]
    assert len(embed.embedded(frame, "t").first()["embedding"]) == config.DEFAULT.dimensions


def test_images_are_read_by_the_recogniser(spark):
    def read(content, language):
        if not content:
            raise ValueError("no image")
        return f" {language}　{content.decode()}。 "

    frame = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b""))], "path string, content binary")
    found = {r["path"]: (r["status"], r["text"]) for r in providers.recognised_images(frame, "ja", read).collect()}
    assert found == {"a": ("ok", "ja x."), "b": ("ValueError: no image", None)}
    assert len(providers.OCR_LANGUAGES) == 22


def test_character_runs_of_a_line():
    line = [("B", "Arial-Bold", 0.0, 10.0, 5.0, 12.0), ("o", "Arial-Bold", 5.0, 10.0, 5.0, 12.0), (" ", "Arial-Bold", 10.0, 10.0, 0.0, 12.0), ("x", "Arial", 12.0, 10.0, 5.0, 12.0)]
    assert providers.character_runs(line) == [("Bo", 0.0, 10.0, 10.0, 12.0, "Arial-Bold", 12.0, 16), ("x", 12.0, 10.0, 5.0, 12.0, "Arial", 12.0, 0)]


def test_schema_errors():
    schema = {
        "type": "object", "required": ["persona", "documents"], "additionalProperties": False,
        "properties": {
            "persona": {"type": "object", "required": ["role"], "properties": {"role": {"type": "string", "minLength": 1}}},
            "documents": {"type": "array", "minItems": 1, "items": {"type": "object", "properties": {"page": {"type": "integer", "minimum": 1}}}},
            "kind": {"enum": ["a", "b"]}, "either": {"anyOf": [{"type": "string"}, {"type": "null"}]},
        },
    }
    good = {"persona": {"role": "x"}, "documents": [{"page": 1}], "kind": "a", "either": None}
    assert output.schema_errors(good, schema) == []
    bad = {"persona": {"role": ""}, "documents": [{"page": 0}, 3], "kind": "c", "either": 1, "more": 1}
    assert output.schema_errors(bad, schema) == [
        "$.persona.role: is too short", "$.documents[0].page: is too small", "$.documents[1]: is not of type object", "$.kind: is none of the allowed values",
        "$.either: fits none of the alternatives", "$.more: nothing is allowed here",
    ]
    assert output.schema_errors(True, {"type": "integer"}) and not output.schema_errors(2.0, {"type": "integer"})


def test_schema_report_and_named_files(spark, tmp_path):
    frame = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": "x"}'), (3, "{"), (4, None)], "i int, j string")
    found = {r["i"]: (r["r"]["ok"], r["r"]["messages"]) for r in frame.select("i", output.schema_report("j", '{"properties": {"a": {"type": "integer"}}}').alias("r")).collect()}
    assert found == {1: (True, []), 2: (False, ["$.a: is not of type integer"]), 3: (False, ["$: not valid JSON"]), 4: (False, ["$: not valid JSON"])}
    results = catalog.QUERIES["full_run"](spark, SMALL).limit(2)
    files = output.named_json(results, str(tmp_path / "out")).collect()
    for row in files:
        text = open(row["path"], encoding="utf-8").read()
        assert set(json.loads(text)) == {"metadata", "extracted_sections", "subsection_analysis"} and "\n" in text


def test_nearest_equals_brute_force(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(60)] + [(60, [0.0] * 5), (61, None), (62, [1.0, None, 0.0, 0.0, 0.0]), (63, [1.0])]
    found = nearest(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", F.col("k") % 10 == 0, 4, block=7)
    usable = {k: np.array(v) for k, v in rows if v and None not in v and len(v) == 5}
    wanted = set()
    for q in (k for k in usable if k % 10 == 0):
        def cosine(a, b):
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            return float(np.round(a @ b / norm, 6)) if norm else 0.0

        best = sorted((-cosine(usable[q], v), k) for k, v in usable.items() if k != q)[:4]
        wanted |= {(q, k, -s + 0.0, n) for n, (s, k) in enumerate(best, 1)}
    assert {(r[0], r[1], r[2] + 0.0, r[3]) for r in found.collect()} == wanted


def test_scanned_and_enveloped(spark):
    blocks = spark.createDataFrame([(1, n, 1, "a longer text", "text") for n in range(6)], "doc_id long, block_no int, page_number int, text string, parser_used string")
    documents = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {r["doc_id"]: r["is_scanned"] for r in scanned_documents(blocks, documents=documents).collect()} == {1: False, 2: True}
    assert envelope(blocks).first()["parser_used"] == "text" and "parser_used" not in envelope(blocks.drop("parser_used")).columns


def test_scratch(spark):
    with scratch() as keep:
        gone, kept = written(spark.range(2), "a"), keep(written(spark.range(3), "b"))
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_eviction_table_equals_the_cache(spark):
    draw = random.Random(1)
    uses = [(f"k{draw.randrange(30)}", i) for i in range(200)]
    cache = runtime.LruCache(10)
    for key, _ in uses:
        cache.put(key, None) if cache.get(key, "none") == "none" else None
    kept = {r["key"] for r in runtime.evicted(spark.createDataFrame(uses, "key string, used_at int"), 10).where("stays").collect()}
    assert kept == set(cache._entries)




def test_metadata_of_files(spark):
    def read(content):
        if not content:
            raise ValueError("no document")
        return {"title": " ", "author": " A. Writer ", "creation_date": "D:20240131120000", "modification_date": "D:2024"}

    frame = spark.createDataFrame([("/x/annual_report.pdf", bytearray(b"x")), ("/x/b.pdf", bytearray(b""))], "path string, content binary")
    found = {r["path"]: r for r in providers.file_metadata(frame, read).collect()}
    own = found["/x/annual_report.pdf"]
    assert (own["status"], own["title"], own["author"], own["subject"], own["creation_date"], own["modification_date"]) == ("ok", "Annual Report", "A. Writer", None, "2024-01-31", None)
    assert found["/x/b.pdf"]["status"] == "ValueError: no document" and found["/x/b.pdf"]["title"] == "B"
