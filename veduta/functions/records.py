"""Fallbacks between columns, raw records and answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_value(column: Column, raw: Column, field: str) -> Column:
    """A row's column, or the field of its raw JSON record where the column is null."""
    return F.coalesce(column, F.get_json_object(raw, f"$.{field}"))


def preference(flag: Column, legacy: Column) -> Column:
    """A flag of three states: itself if set, else the legacy flag, else false."""
    return F.coalesce(flag, legacy, F.lit(False))


def canonical_json(*columns: str) -> Column:
    """The columns as one JSON object with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def fenced_json(answer: Column, fallback: Column, field: str) -> Column:
    """A field of a JSON object in an answer, with or without a code fence; ``fallback`` if it is missing,
    blank or no JSON."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```json", ""), r"```$", ""))
    value = F.trim(F.get_json_object(plain, f"$.{field}"))
    return F.coalesce(F.when(value != "", value), fallback)


def first_value(record: Column, *keys: str) -> Column:
    """The first value that is not empty under ``keys`` of a JSON record, and then of its ``raw_data``."""
    found = [F.get_json_object(record, f"$.{path}{k}") for path in ("", "raw_data.") for k in keys]
    return F.coalesce(*[F.when(~v.isin("", "{}"), v) for v in found])


def json_object(record: Column, key: str) -> Column:
    """The object under ``key`` of a JSON record if it has any field, else that of its ``raw_data``, else
    an empty one."""
    return F.coalesce(first_value(record, key), F.lit("{}"))
