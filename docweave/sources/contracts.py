"""JSON contracts: reading lines of JSON and reporting what breaks a JSON Schema (the subset that fixed contracts need)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def _resolve(schema: dict, root: dict) -> dict | None:
    """What a reference stands for; None if it leads nowhere."""
    seen = 0
    while "$ref" in schema and seen < 32:
        at = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            at = at.get(part) if isinstance(at, dict) else None
        if not isinstance(at, dict):
            return None
        schema, seen = at, seen + 1
    return schema


def errors_of(value, schema: dict, root: dict | None = None, at: str = "$") -> list[tuple[str, str]]:
    """(code, JSON path) of every fault of a parsed value; a value of the wrong type is not looked into. A schema whose reference leads nowhere is a fault
    of the value (unknown_reference). Key words beside $ref are not judged; those beside oneOf and anyOf are."""
    root = root or schema
    schema = _resolve(schema, root)
    if schema is None:
        return [("unknown_reference", at)]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [("type", at)]
    out = []
    if "const" in schema and (value != schema["const"] or isinstance(value, bool) != isinstance(schema["const"], bool)):
        out.append(("const", at))
    if "enum" in schema and value not in schema["enum"]:
        out.append(("enum", at))
    if isinstance(value, str):
        out += [("minLength", at)] * (len(value) < schema.get("minLength", 0)) + [("maxLength", at)] * (len(value) > schema.get("maxLength", len(value)))
        out += [("pattern", at)] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if _is(value, "number"):
        out += [("minimum", at)] * (value < schema.get("minimum", value)) + [("maximum", at)] * (value > schema.get("maximum", value))
    if isinstance(value, list):
        out += [("minItems", at)] * (len(value) < schema.get("minItems", 0)) + [("maxItems", at)] * (len(value) > schema.get("maxItems", len(value)))
        out += [("uniqueItems", at)] * bool(schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value))
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(value):
                out += errors_of(v, schema["items"], root, f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [("required", f"{at}.{k}") for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in known:
                out += errors_of(v, known[k], root, f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(("additionalProperties", f"{at}.{k}"))
            elif isinstance(schema.get("additionalProperties"), dict):
                out += errors_of(v, schema["additionalProperties"], root, f"{at}.{k}")
    for word, fits in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if word in schema and not fits(sum(not errors_of(value, s, root, at) for s in schema[word])):
            out.append((word, at))
    for s in schema.get("allOf", ()):
        out += errors_of(value, s, root, at)
    return out


def faults_of(text: str | None, schema: dict) -> list[tuple[str, str]]:
    """errors_of for JSON text; what is no JSON has the one fault invalid_json."""
    try:
        return errors_of(json.loads(text if text is not None else ""), schema)
    except ValueError:
        return [("invalid_json", "$")]


def validate_contract(rows: DataFrame, schema: dict) -> DataFrame:
    """row_id, code, path of every fault of the JSON texts (row_id long, json); what is no JSON has the code invalid_json. Texts without fault have no row. One Arrow batch at a time, nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, text in zip(b["row_id"], b["json"]):
                out += [(id_, c, p) for c, p in faults_of(text, schema)]
            yield pd.DataFrame(out, columns=["row_id", "code", "path"])

    return rows.select("row_id", "json").mapInPandas(run, "row_id long, code string, path string")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """line id within the file set (not stable between runs of other file sets) and text of JSON lines, for validate_contract and from_json."""
    from pyspark.sql import functions as F

    return spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("row_id"), F.col("value").alias("json"))
