"""Results as nested documents: assembly, contract, fallback, sinks, summary."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.work import written

SECTION = "array<struct<document:string,section_title:string,importance_rank:int,page_number:int>>"
PASSAGE = "array<struct<document:string,refined_text:string,page_number:int>>"


def assembled(collections: DataFrame, ranked_sections: DataFrame, passages: DataFrame) -> DataFrame:
    """(collection, metadata, extracted_sections, subsection_analysis), one row per collection.

    ``collections`` is (collection, input_documents, persona, job_to_be_done).
    Collections without results keep empty arrays.
    """
    listed = lambda order, *fields: F.transform(
        F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("v")))), lambda x: x["v"]
    )
    sections = ranked_sections.groupBy("collection").agg(
        listed("importance_rank", "document", F.col("title").alias("section_title"), F.col("importance_rank").cast("int").alias("importance_rank"), F.col("page_number").cast("int").alias("page_number")).alias("s")
    )
    texts = passages.groupBy("collection").agg(
        listed("passage_rank", "document", F.col("passage").alias("refined_text"), F.col("page_number").cast("int").alias("page_number")).alias("p")
    )
    joined = collections.join(sections, "collection", "left").join(texts, "collection", "left")
    return joined.select(
        "collection",
        F.struct("input_documents", "persona", "job_to_be_done").alias("metadata"),
        F.coalesce("s", F.array().cast(SECTION)).alias("extracted_sections"),
        F.coalesce("p", F.array().cast(PASSAGE)).alias("subsection_analysis"),
    )


def fulfils_contract() -> Column:
    """True where every required field of a result is there."""
    m = F.col("metadata")
    full = lambda x, *names: ~sum(((x[n].isNull()).cast("int") for n in names), F.lit(0)).cast("boolean")
    return (
        full(m, "input_documents", "persona", "job_to_be_done")
        & F.forall("extracted_sections", lambda s: full(s, "document", "section_title", "importance_rank", "page_number"))
        & F.forall("subsection_analysis", lambda s: full(s, "document", "refined_text", "page_number"))
    )


def written_json(results: DataFrame, path: str) -> None:
    """A JSON line per collection, in a folder per collection."""
    results.withColumn("folder", F.col("collection")).write.mode("overwrite").partitionBy("folder").json(path)


def named_json(results: DataFrame, folder: str) -> DataFrame:
    """A pretty JSON file ``<collection>.json`` for each collection; returns (collection, path).

    ``folder`` is a URI that all executors reach.  A file is written under
    another name and moved, so a task that runs again replaces its own files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            paths = []
            for name, text in zip(batch["collection"], batch["text"], strict=True):
                path = f"{base}/{re.sub(r'[^0-9A-Za-z._-]', '_', str(name))}.json"
                system.create_dir(base, recursive=True)
                with system.open_output_stream(hidden := f"{base}/.{uuid.uuid4().hex}", compression=None) as out:
                    out.write(text.encode())
                system.move(hidden, path)
                paths.append(path)
            yield pd.DataFrame({"collection": batch["collection"], "path": paths})

    rows = results.select(F.col("collection").cast("string").alias("collection"), pretty_json().alias("text"))
    return written(rows.mapInPandas(write, "collection string, path string"), "json-files")


def pretty_json() -> Column:
    return F.to_json(F.struct("metadata", "extracted_sections", "subsection_analysis"), {"pretty": "true", "ignoreNullFields": "false"})


def run_summary(results: DataFrame) -> DataFrame:
    """(status, n): collections with and without results."""
    status = F.when(F.size("extracted_sections") > 0, "ok").otherwise("empty")
    return results.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def schema_messages(json_col: str, schema: str, rules: dict[str, Column]) -> Column:
    """Array of messages of a JSON text: not parsable, or the rules (message: must hold on ``parsed``) that fail."""
    parsed = F.from_json(json_col, schema)
    broken = F.when(parsed.isNull(), F.lit("$: not valid JSON"))
    return F.array_compact(F.array(broken, *[F.when(parsed.isNotNull() & ~F.coalesce(rule(parsed), F.lit(False)), F.lit(message)) for message, rule in rules.items()]))


_TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def _is_type(value: object, name: str) -> bool:
    if isinstance(value, bool):
        return name == "boolean"
    return isinstance(value, _TYPES[name]) or (name == "integer" and isinstance(value, float) and value.is_integer())


def schema_errors(value: object, schema: dict | bool, path: str = "$") -> list[str]:
    """Where a value breaks a JSON Schema (Draft 7 without references and formats), as ``path: message``."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: nothing is allowed here"]
    found: list[str] = []
    say = lambda broken, message: found.append(f"{path}: {message}") if broken else None
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        say(not any(_is_type(value, k) for k in kinds), f"is not of type {' or '.join(kinds)}")
    say("enum" in schema and value not in schema["enum"], "is none of the allowed values")
    say("const" in schema and value != schema["const"], "is not the required value")
    if isinstance(value, str):
        say(len(value) < schema.get("minLength", 0), "is too short")
        say(len(value) > schema.get("maxLength", len(value)), "is too long")
        say("pattern" in schema and not re.search(schema.get("pattern", ""), value), "does not match the pattern")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        say(value < schema.get("minimum", value), "is too small")
        say(value > schema.get("maximum", value), "is too large")
        say("exclusiveMinimum" in schema and value <= schema.get("exclusiveMinimum", value), "is too small")
        say("exclusiveMaximum" in schema and value >= schema.get("exclusiveMaximum", value), "is too large")
        say("multipleOf" in schema and value % schema.get("multipleOf", 1) != 0, "is no multiple")
    if isinstance(value, list):
        say(len(value) < schema.get("minItems", 0), "has too few items")
        say(len(value) > schema.get("maxItems", len(value)), "has too many items")
        say(schema.get("uniqueItems", False) and len({json.dumps(v, sort_keys=True) for v in value}) < len(value), "has repeated items")
        items = schema.get("items", True)
        for i, v in enumerate(value):
            own = items if not isinstance(items, list) else items[i] if i < len(items) else schema.get("additionalItems", True)
            found += schema_errors(v, own, f"{path}[{i}]")
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            say(name not in value, f"lacks {name}")
        say(len(value) < schema.get("minProperties", 0), "has too few properties")
        say(len(value) > schema.get("maxProperties", len(value)), "has too many properties")
        known = schema.get("properties", {})
        patterns = schema.get("patternProperties", {})
        for name, v in value.items():
            rules = [known[name]] if name in known else []
            rules += [rule for pattern, rule in patterns.items() if re.search(pattern, name)]
            for rule in rules or [schema.get("additionalProperties", True)]:
                found += schema_errors(v, rule, f"{path}.{name}")
    every = [schema_errors(value, s, path) for s in schema.get("allOf", ())]
    found += [m for messages in every for m in messages]
    fits = lambda key: sum(not schema_errors(value, s, path) for s in schema[key])
    say("anyOf" in schema and not fits("anyOf"), "fits none of the alternatives") if "anyOf" in schema else None
    say(fits("oneOf") != 1, "does not fit exactly one alternative") if "oneOf" in schema else None
    say(not schema_errors(value, schema["not"], path), "is what is ruled out") if "not" in schema else None
    if "if" in schema:
        found += schema_errors(value, schema.get("else" if schema_errors(value, schema["if"], path) else "then", True), path)
    return found


def schema_report(json_col: str, schema: str) -> Column:
    """struct(ok, messages) of a JSON text against a JSON Schema text; text that is no JSON has that message."""
    rules = json.loads(schema)

    @F.pandas_udf("ok boolean, messages array<string>")
    def checked(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                messages = schema_errors(json.loads(text or ""), rules)
            except json.JSONDecodeError:
                messages = ["$: not valid JSON"]
            rows.append((not messages, messages))
        return pd.DataFrame(rows, columns=["ok", "messages"])

    return checked(F.col(json_col))
