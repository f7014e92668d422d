"""Interval joins and islands.

All joins keep the chromosome as an equi-key. The binned form cuts both sides
into bins of equal width and joins on (chromosome, bin); a pair is kept in the
bin where the later of its starts lies, so no pair comes twice and nothing has
to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isolume.storage import stored

#: Width of a bin: longer than most intervals, so that few are cut.
BIN = 1 << 17
#: Length of the stretches in which islands are found.
STRETCH = 1 << 22


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bin_width: int | None = BIN) -> DataFrame:
    """Pairs of rows whose [start, end) overlap and whose keys are equal; columns are prefixed a_ and b_.

    Empty intervals overlap nothing. bin_width None joins on the keys alone, for a small side that Spark broadcasts.
    """
    a = a.filter("start < end").select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    b = b.filter("start < end").select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    on = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    for k in keys:
        on &= F.col(f"a_{k}") == F.col(f"b_{k}")
    if bin_width is None:
        return a.join(b, on)
    cut = lambda side: F.explode(F.sequence(F.floor(F.col(f"{side}_start") / bin_width), F.floor((F.col(f"{side}_end") - 1) / bin_width)))
    a, b = a.withColumn("__bin_a", cut("a")), b.withColumn("__bin_b", cut("b"))
    later = F.floor(F.greatest("a_start", "b_start") / bin_width)
    return a.join(b, on & (F.col("__bin_a") == F.col("__bin_b")) & (F.col("__bin_a") == later)).drop("__bin_a", "__bin_b")


def self_overlap(t: DataFrame, keys: list[str], ident: str, bin_width: int | None = BIN) -> DataFrame:
    """Ordered pairs of different rows that overlap."""
    return overlap_join(t, t, keys, bin_width).filter(F.col(f"a_{ident}") != F.col(f"b_{ident}"))


def islands(t: DataFrame, keys: list[str], low: Column, high: Column, tol: int = 0, tie: str = "ord", stretch: int = STRETCH) -> DataFrame:
    """Adds island, the low of the first interval of the island of [low, high) within its keys; tie identifies a row.

    A new island begins where low passes all earlier highs by more than tol, so nothing within tol of each other is
    parted and islands can be worked on apart. The running maximum is made in two levels, over stretches of the axis
    and within one, so that no key's rows lie in one task; only four narrow columns are sorted.
    """
    narrow = t.select(*keys, F.col(tie).alias("__tie"), low.alias("__low"), high.alias("__high")).withColumn("__stretch", F.floor(F.col("__low") / stretch))
    narrow = stored(narrow, "islands")
    place = [*keys, "__stretch"]
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = narrow.groupBy(*place).agg(F.max("__high").alias("__top")).withColumn("__before", F.max("__top").over(earlier)).drop("__top")
    order = Window.partitionBy(*place).orderBy("__low", "__tie")
    inside = F.max("__high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = narrow.join(tops, place).withColumn("__so_far", F.greatest("__before", inside))
    marked = marked.withColumn("__begin", F.when(F.col("__so_far").isNull() | (F.col("__low") > F.col("__so_far") + tol), F.col("__low")))
    marked = stored(marked.select(*place, "__tie", "__low", "__begin"), "islands")
    firsts = marked.groupBy(*place).agg(F.max("__begin").alias("__last")).withColumn("__open", F.max("__last").over(earlier)).drop("__last")
    here = F.max("__begin").over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = marked.withColumn("__here", here).join(firsts, place).select("__tie", F.coalesce("__here", "__open").alias("island"))
    return t.join(found, t[tie] == found["__tie"]).drop("__tie")


def transcript_islands(t: DataFrame, tol: int = 0) -> DataFrame:
    """Islands of transcripts in (chrom, strand), over their spans and all their exons."""
    low = F.least("start", F.array_min(F.transform("exons", lambda e: e["start"])))
    high = F.greatest("end", F.array_max(F.transform("exons", lambda e: e["end"])))
    return islands(t, ["chrom", "strand"], low, high, tol)
