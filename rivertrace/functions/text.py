"""Text forms: indicator lists, message guard, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivertrace.schemas import MESSAGE_TYPES


def parse_indicators(text: Column) -> Column:
    """A JSON array, a JSON string, or bare text as a list; null becomes an empty list."""
    as_list = F.from_json(text, "array<string>")
    bare = F.array(F.coalesce(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"], text))
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(F.ltrim(text).startswith("[") & as_list.isNotNull(), as_list)
        .otherwise(bare)
    )


def guarded_type(raw: Column) -> Column:
    """The message type, or null for control messages, unknown types and text that is not JSON."""
    kind = F.get_json_object(raw, "$.type")
    return F.when(F.try_parse_json(raw).isNotNull() & kind.isin(*MESSAGE_TYPES), kind)
