"""Annotation types: short names and namespaces of type URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_type(uri: Column, mode: str = "fixed") -> Column:
    """A type's short name.

    'legacy': the last segment cut at its first 'v', so a versioned URI (.../Name/v1) gives '' and 'Interval' gives
    'Inter'. 'fixed': a trailing version segment is ignored and nothing is cut.
    """
    last = F.element_at(F.split(uri, "/"), -1)
    if mode == "legacy":
        return F.substring_index(last, "v", 1)
    if mode != "fixed":
        raise ValueError(mode)
    return F.element_at(F.split(F.regexp_replace(uri, r"/v[0-9]+(\.[0-9]+)*$", ""), "/"), -1)


def short_types(slots: Column, mode: str = "fixed") -> Column:
    """Short names of plain slots (arrays of one type); slots of alternatives and empty names are skipped."""
    plain = F.filter(slots, lambda s: F.size(s) == 1)
    return F.filter(F.transform(plain, lambda s: short_type(s[0]["type"], mode)), lambda t: t != "")


def namespace(uri: Column) -> Column:
    """Everything before the last segment; '' if there is one segment only."""
    parts = F.split(uri, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def slots_match(outputs: Column, inputs: Column) -> Column:
    """Whether any output type shares its namespace with any alternative of any input slot."""
    left = F.transform(outputs, lambda o: namespace(o["type"]))
    right = F.transform(F.flatten(inputs), lambda i: namespace(i["type"]))
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))
