"""JSON that may be wrapped, partial or wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfence(text: Column) -> Column:
    """Without a surrounding code fence."""
    return F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")


def parse_object(text: Column) -> Column:
    """A JSON object as variant: the unfenced text, else its outermost braces; null otherwise."""
    whole = F.try_parse_json(unfence(text))
    inner = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    value = F.coalesce(F.when(is_object(whole), whole), F.when(is_object(inner), inner))
    return value


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def numbers(text: Column) -> Column:
    """Numeric members of a flat JSON object, as a map."""
    return F.map_filter(F.from_json(text, "map<string,double>"), lambda _, v: v.isNotNull())
