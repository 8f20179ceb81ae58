"""Tokenizers and the token-count operator with its digest cache.

Counting: every text is named by the digest of its normalised content and every
tokenizer by the digest of its file.  Counts already in the cache are joined,
only distinct texts without a count are encoded (in map tasks, each text once
however many copies it has), and their counts are appended to the cache.

The normalisation is one the tokenizer itself ignores: runs of white space
become one space where the tokenizer's own normaliser does the same, and
nothing changes otherwise, so equal digests mean equal counts.

Defined results: a null text counts as empty (0 tokens); repeated rows and ids
each get their row; an empty table gives no rows; whole texts are encoded,
however long, without begin, end or added special tokens, truncation or padding.
Only the id and text columns are read, so others may have any name.  The cache
lasts as long as its folder: the query takes the folder that the session names
in ``foliant.token.cache``, and a new one where it names none.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, text_or_empty, with_text_batches, work_path, written

#: A text with more tokens is over the limit.
TOKEN_LIMIT = 2048
#: Texts handed to the library at a time.
CHUNK = 64
#: Characters of white space in a row that tiktoken is not given.
LONG_SPACE = 10_000
#: Session setting: a folder that keeps the counts from one run to the next.
CACHE_SETTING = "foliant.token.cache"
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")
_CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level vocabulary whose merges stand in the order of their ids; else None."""
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None
        and model.get("type") == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not model.get("ignore_merges")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ()))
    )
    if not plain:
        return None
    vocab, alphabet = model["vocab"], _byte_alphabet()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in merged]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        return None
    added = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in vocab.items() if token not in added}
    return ranks if all(bytes((b,)) in ranks for b in range(256)) else None


# Fixed value: how a byte-level vocabulary splits a text into words.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str, pattern: str = BYTE_LEVEL_PATTERN) -> Callable[[list[str]], list]:
    """Texts to id lists by the vocabulary file's library, special tokens not added.

    A byte-level .json vocabulary is run by tiktoken, which gives the same ids
    in a fifth of the time; any other .json by tokenizers.  So are texts with
    very long runs of white space, on which tiktoken's patterns run out of stack.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1)
    import tiktoken

    if path.endswith(".tiktoken"):
        split = (line.split() for line in Path(path).read_bytes().splitlines())
        ranks, special = {base64.b64decode(a): int(b) for a, b in split}, {}
    else:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ranks = _byte_level_ranks(spec)
        if ranks is None:
            return _by_tokenizers(path)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    spare: list[Callable] = []

    def ids(text: str) -> list[int]:
        if len(text) >= LONG_SPACE and _LONG_SPACE.search(text) and path.endswith(".json"):
            if not spare:
                spare.append(_by_tokenizers(path))
            return list(spare[0]([text])[0])
        return encoding.encode(text, allowed_special="all") if any(s in text for s in special) else encoding.encode_ordinary(text)

    return lambda texts: [ids(text) for text in texts]


def _by_tokenizers(path: str) -> Callable[[list[str]], list]:
    from os import environ

    environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores each have a task already
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()

    class _Ids:
        """The ids of an encoding; its length needs no list."""

        def __init__(self, found):
            self.found = found

        def __len__(self):
            return len(self.found)

        def __iter__(self):
            return iter(self.found.ids)

    return lambda texts: [_Ids(x) for x in loaded.encode_batch_fast(texts, add_special_tokens=False)]  # without places in the text


def worker_encoder(path: str) -> Callable[[list[str]], list]:
    """The encoder of this Python worker, loaded once for all its tasks."""
    kept = pyspark.__dict__.setdefault("_foliant_encoders", {})
    if path not in kept:
        kept[path] = encoder(path)
    return kept[path]


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def ignores_space_runs(path: str) -> bool:
    """True if the tokenizer's own normaliser turns every run of white space into one space."""
    if not path.endswith(".json"):
        return False
    normalizer = json.loads(Path(path).read_text(encoding="utf-8")).get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    return any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)


def count_tokens(
    documents: DataFrame, id_col: str, text_col: str, tokenizer_path: str, cache_dir: str, limit: int = TOKEN_LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, through the cache at ``cache_dir``."""
    spark = documents.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = text_or_empty(text_col)
    content = F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ") if ignores_space_runs(tokenizer_path) else text
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    cache = read_cache(spark, cache_dir).where(F.col("version") == version).select("digest", "n_tokens")
    # One text for each distinct digest; copies meet in the map tasks first.
    distinct = with_text_batches(documents).select(digest, content.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(cache, "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = worker_encoder(tokenizer_path)
        for batch in batches:
            texts = batch["text"].tolist()
            counts = [len(x) for at in range(0, len(texts), CHUNK) for x in run(texts[at : at + CHUNK])]
            yield pd.DataFrame({"version": version, "digest": batch["digest"], "n_tokens": counts})

    misses.mapInPandas(encode, _CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    # Two runs at once may both have appended a text's count; a written table keeps the join below free to split hot digests.
    known = read_cache(spark, cache_dir).where(F.col("version") == version)
    counts = written(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    rows = documents.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest)
    return rows.join(counts, "digest", "left").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """(version, digest, n_tokens) of the cache; a cache that is not there yet is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE_SCHEMA)
    return spark.read.schema(_CACHE_SCHEMA).parquet(cache_dir)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    documents = table(spark, sf_dir, "documents")
    return count_tokens(documents, "doc_id", "text", path, spark.conf.get(CACHE_SETTING, None) or work_path(spark, "token-cache"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict = {}
