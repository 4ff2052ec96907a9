"""Strict JSON objects and verdict validation as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V
from quillframe.functions.text import once, strip_text

_STRICT = {"allowSingleQuotes": "false"}


def json_object(raw: Column, fields: str) -> Column:
    """``raw`` as a struct when it is exactly one JSON object, else NULL.

    Spark's parser stops after the first value, so text behind it would pass.
    Reading the text once inside ``[ ]`` and once inside ``{"x": }`` rules that
    out: no tail can close both wrappings. The last of repeated keys is kept.
    """
    wrapped = F.struct(
        F.from_json(
            F.concat(F.lit("["), raw, F.lit("]")), f"array<struct<{fields}>>", _STRICT
        ).alias("listed"),
        F.from_json(
            F.concat(F.lit('{"x":'), raw, F.lit("}")), f"x struct<{fields}>", _STRICT
        ).alias("held"),
    )

    def sole_object(w: Column) -> Column:
        is_one = (F.size(w["listed"]) == 1) & w["held"]["x"].isNotNull()
        return F.when(is_one, F.get(w["listed"], F.lit(0)))

    return F.when(raw.rlike(r"\A[ \t\r\n]*\{"), once(wrapped, sole_object))


def tool_code(arguments: Column) -> Column:
    """The ``code`` text of a call's JSON arguments; empty when there is none."""
    def text_only(found: Column) -> Column:
        is_text = F.schema_of_variant(found["code"]) == "STRING"
        return F.when(is_text, found["code"].cast("string"))

    return F.coalesce(once(json_object(arguments, "code variant"), text_only), F.lit(""))


def validate_verdict(raw: Column) -> Column:
    """struct(verdict, reason) or NULL when the answer breaks the schema.

    A reason that is not text is written as Python writes it for null, booleans
    and whole numbers; fractions and nested values keep their JSON text.
    """
    def checked(answer: Column) -> Column:
        verdict = F.lower(strip_text(answer["verdict"]))
        kind = F.schema_of_variant(answer["reason"])
        as_text = answer["reason"].cast("string")
        reason = (
            F.when(kind.isNull(), F.lit(""))
            .when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(as_text))
            .when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(answer["reason"]))
            .otherwise(as_text)
        )
        return F.when(
            verdict.isin(*V.VERDICTS),
            F.struct(verdict.alias("verdict"), reason.alias("reason")),
        )

    return once(json_object(raw, "verdict string, reason variant"), checked)


def is_json(raw: Column) -> Column:
    """Whether ``raw`` is exactly one JSON value."""
    listed = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<variant>", _STRICT)
    held = F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), "x variant", _STRICT)
    return F.coalesce((F.size(listed) == 1) & held["x"].isNotNull(), F.lit(False))
