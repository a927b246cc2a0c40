"""Column expressions on attribute maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_attr(attrs: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(attrs, lambda k, _: k != key), F.create_map(key, value))


def get_attr(attrs: Column, key: str) -> Column:
    return F.try_element_at(attrs, F.lit(key))


def rendered(attrs: Column) -> Column:
    """key=value pairs in key order, as text."""
    entries = F.array_sort(F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.concat_ws(",", entries)
