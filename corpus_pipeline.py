"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All stages but the last return the columns of ``docs``, whatever
their names.  Rows are told apart by id, content and, where these are equal, by
their place in the stage's files: rows that repeat an id, or have none, are
judged one by one, and every run keeps the same ones.  Null texts are empty,
whole texts are read, and an empty table stays empty.

1. quality: documents that the weak-label classifier rejects go;
2. near duplicates: of each group linked by the n-gram Jaccard join one document
   stays, that with the smallest id;
3. decontamination: documents that hold a benchmark item go;
4. personal data: spans are replaced by their kind, ``n_chars`` follows the text;
5. packing: best-fit packing into sequences of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, text_or_empty, unused, with_row_keys, written
from foliant.llm.decontam import without_contamination
from foliant.llm.neardup import near_duplicates
from foliant.llm.packing import pack
from foliant.llm.pii import redact
from foliant.llm.quality import THRESHOLD, fit_quality

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs)
    return docs.where(model.score(text_or_empty("text")) < THRESHOLD)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = unused(docs, "row_key")
    keyed = with_row_keys(docs, key, "doc_id")
    groups = near_duplicates(keyed, key, "text", count_links=False)
    dropped = written(groups.where(F.col(key) != F.col("class_id")).select(key), "dropped")
    # Merged at every size: what is dropped grows with the documents and is not to be broadcast.
    return keyed.join(dropped.hint("merge"), key, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contamination(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = unused(docs, "before")
    after = redact(docs.withColumn(before, F.col("text")), "text")
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        after = after.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(size))
    return after.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, "doc_id", "text", str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models and alignments are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
