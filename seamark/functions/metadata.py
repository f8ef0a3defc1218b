"""Typed metadata: MAP<STRING,STRING> whose values are canonical JSON literals, so 1 and "1" stay different."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

MAX_METADATA_CHARS = 16384  # fixed value: the bound on a file's metadata


def literal(value: str | int | float | bool) -> str:
    """Canonical JSON literal of a scalar (1.0 is written 1)."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def typed_metadata(json_text: Column) -> Column:
    """JSON object text to the typed map; numbers take one spelling."""
    return F.transform_values(F.from_json(json_text, "map<string,variant>"), lambda _, v: F.to_json(v))


def contains(metadata: Column, wanted: dict | Column) -> Column:
    """True if every wanted (key, literal) is in ``metadata``. ``wanted``: Python dict of scalars, or a map column."""
    if isinstance(wanted, dict):
        found = F.lit(True)
        for key, value in wanted.items():
            found = found & F.coalesce(F.try_element_at(metadata, F.lit(key)) == F.lit(literal(value)), F.lit(False))
        return found
    pairs = F.map_entries(F.coalesce(wanted, F.create_map().cast("map<string,string>")))
    return F.forall(pairs, lambda e: F.coalesce(F.try_element_at(metadata, e["key"]) == e["value"], F.lit(False)))


def is_scalar(value: Column) -> Column:
    """A string, number or boolean literal (not null, array or object)."""
    return value.isNotNull() & ~value.rlike(r"^(null$|\[|\{)")


def display(value: Column) -> Column:
    """Text of a scalar literal: strings lose their quotes and escapes."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
                  ).otherwise(value)


def _pair_chars(metadata: Column, size) -> Column:
    return F.aggregate(F.map_entries(metadata), F.lit(0),
                       lambda acc, e: acc + size(F.concat(F.to_json(F.array(e["key"])), e["value"])) - F.lit(2))


def compact_chars(metadata: Column) -> Column:
    """Length of the object written without blanks."""
    n = F.size(metadata)
    return F.lit(2) + _pair_chars(metadata, F.length) + n + F.greatest(n - 1, F.lit(0))


def stored_bytes(metadata: Column) -> Column:
    """Bytes of the object written with one blank after ':' and ','."""
    n = F.size(metadata)
    return F.lit(2) + _pair_chars(metadata, F.octet_length) + 2 * n + 2 * F.greatest(n - 1, F.lit(0))


def merge_patch(metadata: Column, patch: Column) -> Column:
    """Patched map: a JSON null in the patch removes the key, anything else sets it."""
    zipped = F.map_zip_with(metadata, patch, lambda _, old, new: F.coalesce(new, old))
    return F.map_filter(zipped, lambda _, v: v != "null")
