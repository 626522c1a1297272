"""Array expressions that Spark lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_key(entries: Column, append: bool) -> Column:
    """entries, an array of (key, value), with each key once, at the place of its first entry.

    The value is that of the last entry, or, if values are lists to append, all of them in order. Keys may be null, lists
    or structs. Entries are sorted by key once, so the cost is n log n for n entries.
    """

    def grouped(entries: Column) -> Column:
        ordered = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), i.alias("i"))))
        return F.when(F.size(entries) > 0, let(ordered, lambda s: groups(entries, s))).otherwise(F.filter(entries, lambda e: F.lit(False)))

    def groups(entries: Column, s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | ~F.get(s, j)["k"].eqNullSafe(F.get(s, j - 1)["k"]))

        def bounds(b: Column) -> Column:
            spans = F.transform(b, lambda j, g: F.struct(F.get(s, j)["i"].alias("first"), j.alias("lo"), F.coalesce(F.get(b, g + 1), F.size(s)).alias("hi")))
            return F.transform(F.array_sort(spans), lambda p: F.struct(F.get(entries, p["first"])["key"].alias("key"), value(p).alias("value")))

        def value(p: Column) -> Column:
            if append:
                return F.flatten(F.transform(F.slice(s, p["lo"] + 1, p["hi"] - p["lo"]), lambda e: F.get(entries, e["i"])["value"]))
            return F.get(entries, F.get(s, p["hi"] - 1)["i"])["value"]

        return let(begins, bounds)

    # Entries may be an expression themselves: read by name in each group, they would be made anew for each.
    return let(entries, grouped)
