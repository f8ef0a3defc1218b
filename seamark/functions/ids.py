"""Deterministic identifiers."""

from pyspark.sql import Column, functions as F

# Fixed value: the name space of segment ids.
SEGMENT_NAMESPACE = "6f1d3c52-7f0e-4a51-9a39-3f2f4c1b8e01"


def uuid5(name: Column, namespace: str) -> Column:
    """RFC 4122 version-5 UUID of ``name``, in plain SQL functions (no Python per row)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.concat(F.lit("5"), F.substring(digest, 14, 3)),
                       F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def segment_id(version: Column, profile: Column, ordinal: Column, namespace: str = SEGMENT_NAMESPACE) -> Column:
    """Id of the n-th segment of a (version, profile); the same inputs always give the same id."""
    return uuid5(F.concat_ws(":", version, profile, ordinal.cast("string")), namespace)
