"""Versioned JSON payloads and proposal text as columns.

Fields are read from a variant with their JSON type checked, because a typed
JSON read turns the number 5 into the text "5".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.fixed_values import PAYLOAD_VERSION
from hindcast.functions.clocks import iso_utc
from hindcast.functions.text import strip

NUMBER = r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"

_BROKEN = "_broken"
_JSON_OPTIONS = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": _BROKEN}


def json_fields(text: Column, names: Sequence[str]) -> Column:
    """Named top-level values of a JSON object as variants, in one parse."""
    return F.from_json(text, ", ".join(f"{n} variant" for n in (*names,)) + f", {_BROKEN} string", _JSON_OPTIONS)


def is_json_object(text: Column, fields: Column) -> Column:
    """True for exactly one well-formed object and nothing after it.

    `fields` is the parsed struct of the same text. The parser stops at the end
    of the first value; text whose first closing brace is its last character
    has nothing behind it, any other text is counted as a list of values.
    """
    bare = F.btrim(text, F.lit(" \t\r\n"))
    alone = (F.instr(bare, "}") == F.length(bare)) | (
        F.json_array_length(F.concat(F.lit("["), bare, F.lit("]"))) == 1
    )
    # The usual text is known by its bytes; WHEN keeps the rest from being computed for it.
    before = F.substring(text.cast("binary"), F.lit(1), F.octet_length(text) - 1).cast("string")
    one = text.startswith("{") & text.endswith("}") & ~F.contains(before, F.lit("}"))
    object_ = F.when(one, F.lit(True)).otherwise(bare.startswith("{") & alone)
    return F.coalesce(fields[_BROKEN].isNull() & object_, F.lit(False))


def is_json_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def json_text(value: Column) -> Column:
    """A variant as text, only if it is a JSON string."""
    return F.when(is_json_text(value), value.cast("string"))


def json_number(value: Column) -> Column:
    """A variant as double, only if it is a JSON number."""
    return F.when(F.schema_of_variant(value).rlike(NUMBER), F.try_variant_get(value, "$", "double"))


def is_absent(value: Column) -> Column:
    """No such key, or null."""
    return F.coalesce(F.schema_of_variant(value) == "VOID", F.lit(True))


def encode_payload(event_id: Column, headline: Column, ticker: Column, source: Column, published_at: Column, url: Column) -> Column:
    """Flat JSON, version first; a null url is left out."""
    return F.to_json(
        F.struct(
            F.lit(PAYLOAD_VERSION).alias("payload_version"),
            event_id.alias("event_id"),
            headline.alias("headline"),
            ticker.alias("ticker"),
            source.alias("source"),
            iso_utc(published_at).alias("published_at"),
            url.alias("url"),
        )
    )


def strip_fences(text: Column) -> Column:
    """Take the JSON body out of a fenced answer. Text from brace to brace has no fence, nor white space at its ends."""
    clean = strip(text)
    body = F.regexp_replace(clean, r"^`+|`+\z", "")
    body = F.when(body.startswith("json"), strip(F.substring(body, F.lit(5), F.length(body)))).otherwise(body)
    bare = text.startswith("{") & text.endswith("}")
    return F.when(bare, text).when(clean.startswith("```"), body).otherwise(clean)


def repair_route(is_valid: Column, attempt: Column) -> Column:
    """ok, or one retry, then fail."""
    return F.when(is_valid, F.lit("ok")).when(attempt >= 1, F.lit("fail")).otherwise(F.lit("retry"))
