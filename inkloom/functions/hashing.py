"""Content hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_parts(*parts: Column) -> Column:
    """SHA-256 over several parts, each followed by a NUL."""
    return F.sha2(F.concat(*(x for p in parts for x in (p.cast("binary"), F.lit(b"\0")))), 256)


def hash_text(text: Column) -> Column:
    """SHA-256 of the text itself."""
    return F.sha2(text, 256)


def hash_joined(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL, none at the end."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def accepted_hashes(text: Column) -> Column:
    """Both hashes under which a recorded value counts as the text's own."""
    return F.array(hash_text(text), hash_parts(text))


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """A JSON text with sorted keys, no blanks and characters kept; null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return value.map(one)


def hash_json(value: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text."""
    return F.sha2(canonical_json(value), 256)


def hash_of(value: object) -> str:
    """The same for a Python value, for configuration held by the driver."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def book_key(isbn: Column, edition: Column, source_hash: Column, locale: Column) -> Column:
    """Stable id of a book from its identity fields."""
    fields = F.to_json(F.struct(edition.alias("edition"), isbn.alias("isbn"), locale.alias("locale"), source_hash.alias("source_sha256")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("book-v1-"), F.substring(F.sha2(fields, 256), 1, 32))


def json_text(value: Column) -> Column:
    """A string as a JSON string; null as empty, as a registry file has it."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def json_line(*columns: str) -> Column:
    """String columns as one JSON line with sorted names and a blank after each mark."""
    parts = [F.concat(F.lit(f'"{c}": '), json_text(F.col(c))) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
