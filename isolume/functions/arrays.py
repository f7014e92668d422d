"""Order-aware aggregates over arrays: modes, first per key, picks. All keep the array's order as the tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isolume.functions.kernels import bound


def _runs(keyed: Column) -> Column:
    """array<struct<k, i, n>> of an array<struct<k, i>>: each key with its first i and how often it occurs, by key. Sorting brings keys together."""

    def of(xs: Column) -> Column:
        begins = F.transform(xs, lambda x, p: F.when((p == 0) | ~F.get(xs, p - 1)["k"].eqNullSafe(x["k"]), F.struct(x["k"].alias("k"), x["i"].alias("i"), p.alias("p"))))
        return bound(F.array_compact(begins), lambda bs: F.transform(bs, lambda b, j: F.struct(b["k"].alias("k"), b["i"].alias("i"), (F.coalesce(F.get(bs, j + 1)["p"], F.size(xs)) - b["p"]).alias("n"))))

    return bound(F.sort_array(keyed), of)


def first_mode(values: Column) -> Column:
    """The most frequent value, of several the one met first; null for an empty array."""
    runs = _runs(F.transform(values, lambda v, i: F.struct(v.alias("k"), i.alias("i"))))
    return F.array_max(F.transform(runs, lambda r: F.struct(r["n"].alias("n"), (-r["i"]).alias("early"), r["k"].alias("v"))))["v"]


def first_per(items: Column, field: str) -> Column:
    """Structs that are the first with their value of the field, in the array's order."""
    runs = _runs(F.transform(items, lambda x, i: F.struct(x[field].alias("k"), i.alias("i"))))
    return F.transform(F.sort_array(F.transform(runs, lambda r: r["i"])), lambda i: F.get(items, i))


def first_least(items: Column, field: str) -> Column:
    """The first struct with the least value of the field."""
    return F.element_at(items, F.array_min(F.transform(items, lambda x, i: F.struct(x[field].alias("v"), (i + 1).alias("i"))))["i"])


def first_most(items: Column, key) -> Column:
    """The first struct with the greatest key(struct)."""
    return F.element_at(items, -F.array_max(F.transform(items, lambda x, i: F.struct(key(x).alias("v"), (-(i + 1)).alias("i"))))["i"])
