"""Mixing sources to target weights by weighted fair queueing.

Every document enters its source's queue in shuffled order, once for each pass.
Its virtual finish time is the source's cumulative words up to its end divided
by the source's weight. The queues are merged in order of finish time and cut
at the budget; a document that stands on the cut is taken in part. A source
whose passes are used up stops, so that its share goes to the others by weight.

Cumulative sums are made in two levels (sums of hash buckets, then running sums
within one), so that no source and no stretch of the merged order lies in one
task.

Defined results: a null text has size 0; a null source is a source of its own,
the last; documents of size 0 are taken 0; rows that repeat a doc_id are
separate documents; an empty table gives an empty table; where all sizes are 0
targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isolume.llm.common import fingerprint, stored, unused

#: Rows of a bucket or a range, about, and the fewest ranges. One task sorts a range; their number grows with the rows.
SORTED, RANGES = 1 << 18, 2048


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, repeat: int) -> DataFrame:
    """One row for each source of (source, source_size): its weight, and its target by water filling.

    A source is full at repeat times its size. In order of the level at which each is full, the water
    level with the first k full is (budget - what those hold) / (the others' weight); the first level that
    does not pass the next source's own is where the queues stop. One row for each source is sorted in one task.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * repeat)
    src = src.withColumn("full_at", F.col("full") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    src = src.withColumn("place", F.row_number().over(by_level))
    everything = Window.partitionBy()
    src = src.withColumn("total", F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level_here", (F.lit(budget) * F.col("total") - before) / weight_left)
    stops = F.when(F.col("level_here") <= F.col("full_at"), F.struct("place", "level_here"))
    src = src.withColumn("level", F.min(stops).over(everything)["level_here"])
    target = F.when(F.col("full_at") < F.col("level"), F.col("full").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return src.withColumn("target", F.coalesce(target, F.col("full").cast("double"))).select("source", "source_size", "weight", "target", "level", "total")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, repeat: int = 2, seed: str = "mix") -> DataFrame:
    """Returns for every row of docs: doc_id, source, fp (of its text), size, source_size, target, taken.

    budget: times the words of all documents; repeat: the most passes over a document. The shuffle is an md5
    of the seed and doc_id (of the text, where that is null), so reruns agree.
    """
    rows = docs.select(
        "doc_id",
        "source",
        fingerprint(F.col("text")).alias("fp"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))).alias("at"),
    )
    rows = stored(rows, "mix_sizes")
    ranges_ = max(RANGES, rows.count() // SORTED)
    digits = len(f"{ranges_:x}")  # at least 4,096 buckets a source
    rows = rows.withColumn("bucket", F.substring("at", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = stored(sums, "mix_buckets")
    src = stored(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, repeat), "mix_sources")
    known = src.select("level", "total").first()
    if known is None:
        return rows.select("doc_id", "source", "fp", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    words = int(budget * known["total"])
    level = known["level"] or 1.0

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    offsets = offsets.join(src, offsets["source"].eqNullSafe(src["source"])).select(offsets["source"], "bucket", "before", "weight", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", "fp")
    queued = rows.withColumn("n", F.row_number().over(within)).withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    queued = queued.join(offsets, rows["source"].eqNullSafe(offsets["source"]) & (rows["bucket"] == offsets["bucket"]))
    queued = queued.select("doc_id", rows["source"], rows["bucket"], "n", "fp", "size", "at", "source_size", "weight", "target", (F.col("before") + F.col("upto")).alias("upto"))
    items = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    items = items.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("upto")) / F.col("weight"))
    items = items.withColumn("range", F.least(F.floor(F.col("finish") / F.lit(level) * ranges_), F.lit(16 * ranges_)))
    items = stored(items.select("doc_id", "source", "bucket", "n", "fp", "size", "at", "source_size", "target", "round", "finish", "range"), "mix_items")

    before_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = items.groupBy("range").agg(F.sum("size").alias("words"))  # a row for each SORTED rows, times 16 at most
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("words").over(before_range), F.lit(0))).drop("words")
    placed = items.join(F.broadcast(ranges), "range")
    in_order = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "round", "at", "n").rowsBetween(Window.unboundedPreceding, -1)
    reached = placed.filter(F.col("ahead") < words).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    reached = reached.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(words) - F.col("ahead"))))
    taken = reached.unionByName(placed.filter(F.col("ahead") >= words).withColumn("taken", F.lit(0).cast("long")))
    out = taken.groupBy("source", "bucket", "n").agg(*[F.first(c).alias(c) for c in ("doc_id", "fp", "size", "source_size", "target")], F.sum("taken").alias("taken"))
    return out.select("doc_id", "source", "fp", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, repeat: int = 2, seed: str = "mix") -> DataFrame:
    """docs with each row as often as the mix takes it whole; what the cut leaves of a document is left out.

    Rows that are equal in doc_id, source and text share what they are taken, the first of them one more.
    """
    taken = mix(docs, weights, budget, repeat, seed)
    id_, src, of, times, copies, own, turn, n, pass_ = (unused(x, docs.columns) for x in ("__id", "__source", "__of", "__times", "__copies", "__fp", "__turn", "__n", "__pass"))
    each = taken.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(src), F.col("fp").alias(of)).agg(
        F.sum(F.expr("if(size > 0, taken div size, 0)")).alias(times), F.count(F.lit(1)).alias(copies)
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(src)) & (F.col(own) == F.col(of))
    joined = docs.withColumn(own, fingerprint(F.col("text"))).join(each.filter(F.col(times) > 0), same)
    every = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])
    joined = joined.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", "source", own).orderBy(every)))
    share = F.floor(F.col(times) / F.col(copies)).cast("int") + (F.col(turn) <= F.col(times) % F.col(copies)).cast("int")
    joined = joined.withColumn(n, share).filter(F.col(n) > 0)
    return joined.withColumn(pass_, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
