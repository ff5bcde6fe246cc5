"""Tolerant JSON and the checks on a structured answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusatlas.functions.binding import bind

# Allowed tags, and the sub-records with the fields each must have.
TAGS = ["ui", "dataAccess", "utility", "feature"]
SUB_RECORDS = {
    "algorithmicLogic": {"description": "string", "rationale": "string"},
    "businessLogic": {"rules": "string", "workflows": "string"},
    "flowDescription": {"initialization": "string", "processingSteps": "strings"},
}


def tolerant(text: Column) -> Column:
    """The parsed text, or an empty object when it is no JSON."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _kind(answer: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(answer, path, "variant"))


def _is_string(answer: Column, path: str) -> Column:
    return F.coalesce(_kind(answer, path) == "STRING", F.lit(False))


def _is_string_list(answer: Column, path: str) -> Column:
    empty = F.to_json(F.try_variant_get(answer, path, "variant")) == "[]"
    return F.coalesce((_kind(answer, path) == "ARRAY<STRING>") | empty, F.lit(False))


def _unless(ok: Column, error: str) -> Column:
    return F.when(~ok, F.lit(error))


def errors(text: Column) -> Column:
    """Every rule the answer breaks, as an array of short names; empty when valid."""
    return bind(F.try_parse_json(text), _broken_rules)


def _broken_rules(answer: Column) -> Column:
    is_object = F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False))
    found = [
        _unless(_is_string(answer, "$.fileDescription"), "fileDescription"),
        _unless(
            F.coalesce(
                F.try_variant_get(answer, "$.tag", "string").isin(*TAGS)
                & _is_string(answer, "$.tag"),
                F.lit(False),
            ),
            "tag",
        ),
    ]
    for record, fields in SUB_RECORDS.items():
        given = F.try_variant_get(answer, f"$.{record}", "variant").isNotNull()
        for field, kind in fields.items():
            path = f"$.{record}.{field}"
            check = _is_string if kind == "string" else _is_string_list
            found.append(F.when(given & ~check(answer, path), F.lit(f"{record}.{field}")))
    return (
        F.when(answer.isNull(), F.array(F.lit("json")))
        .when(~is_object, F.array(F.lit("object")))
        .otherwise(F.array_compact(F.array(*found)))
    )


def repaired(text: Column) -> Column:
    """From the first opening to the last closing brace; fences and chatter go."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
