"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
lower-cased. Keys are held as 128-bit hashes in sorted runs. Every batch of
documents is counted, merge-anti-joined with the runs (keys that already are
frequent need no more counting) and added as a run of its own; when a level has
``fanout`` runs they are merged into one run of the next level. A run is one
sorted file for each bucket of hashes, and joins of runs read that order: they
neither shuffle nor sort. Spark knows a file's buckets from its catalog only, so
runs are registered there while the operator works and always dropped.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; every row counts as a document, so
rows that repeat a doc_id count apart; null doc_ids are kept; an empty table
gives an empty table. Columns other than doc_id and text pass through; their
names may be any that do not start with two underscores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isolume.functions.kernels import bound
from isolume.llm.common import BLANKS, ascii_lower, fingerprint, scratch_path, stored

#: At most this many frequent keys (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.trim(ascii_lower(line), F.lit(BLANKS))


def key_hash(key: Column) -> Column:
    """128 bits: two hashes of the key under different seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


#: Lets a scan of one sorted file a bucket keep that order, so that merge joins don't sort it again.
_IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_IN_ORDER)
    spark.conf.set(_IN_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(_IN_ORDER, before)


class LineRuns:
    """Levelled sorted runs (h1, h2, n_docs), each a table bucketed and sorted by the hash, in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def _write(self, run: DataFrame) -> str:
        """A run is dealt out by its buckets already, so each bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.made.append(name)
        with _sorted_scans(self.spark):
            (run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
                .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        return name

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch: one row (h1, h2) for each document and key."""
        batch = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        for name in self.runs():
            known = self._table(name).filter(F.col("n_docs") >= self.min_docs)
            batch = batch.join(known, ["h1", "h2"], "left_anti")
        self._push(self._write(batch), 0)

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._compacted(self.levels[level]), []
            self._push(merged, level + 1)

    def _pair(self, a: str, b: str) -> DataFrame:
        """A full outer merge join: both runs share buckets and order, so nothing is shuffled or sorted."""
        more = self._table(b).withColumnRenamed("n_docs", "n_more")
        total = F.coalesce(F.col("n_docs"), F.lit(0)) + F.coalesce(F.col("n_more"), F.lit(0))
        return self._table(a).join(more, ["h1", "h2"], "full_outer").select("h1", "h2", total.alias("n_docs"))

    def _compacted(self, names: list[str]) -> str:
        """One run of several, two at a time: what a merge join puts out is written, since its order is lost to Spark otherwise."""
        out = names[0]
        for name in names[1:]:
            out = self._write(self._pair(out, name))
        return out

    def frequent(self) -> DataFrame:
        """Hashes of the keys in at least min_docs documents, stored apart from the runs."""
        whole = self.spark.table(self._compacted(self.runs()))
        return stored(whole.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2"), "frequent_lines")

    def drop(self) -> None:
        """Takes all runs out of the catalog; their files lie in the shared folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made, self.levels = [], []


def placed_hashes(text: Column, min_chars: int) -> Column:
    """array<struct<h1, h2, pos, first>> of a text's lines whose keys are long enough; first marks one line of each key.

    Sorting by hash brings a key's lines together, so the work is about linear in the lines.
    """
    hashes = F.transform(lines_of(text), lambda line, i: bound(key_of(line), lambda k: F.struct((F.length(k) >= min_chars).alias("counts"), key_hash(k).alias("h"), i.alias("pos"))))
    ordered = F.sort_array(F.transform(F.filter(hashes, lambda x: x["counts"]), lambda x: F.struct(x["h"]["h1"].alias("h1"), x["h"]["h2"].alias("h2"), x["pos"].alias("pos"))))

    def mark(all_: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            before = F.get(all_, i - 1)
            first = (i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), first.alias("first"))

        return F.transform(all_, of)

    return bound(ordered, mark)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Returns docs with __n_lines, __n_dropped and __kept, the text without its frequent lines.

    Batches stand for arrivals; the result does not depend on their number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("__id"), "text", fingerprint(F.col("text")).alias("__fp"))
    hashed = rows.select("__id", "__fp", F.explode(placed_hashes(F.col("text"), min_chars)).alias("h"))
    hashed = hashed.select("__id", "__fp", "h.*", F.pmod(F.xxhash64("__id", "__fp"), F.lit(batches)).cast("int").alias("batch"))
    hashed = stored(hashed, "line_hashes", "batch")

    with LineRuns(spark, min_docs) as runs:
        for batch in range(batches):
            runs.add(hashed.filter((F.col("batch") == batch) & F.col("first")).select("h1", "h2"))
        frequent = runs.frequent()
    few = frequent.count() <= BROADCAST_KEYS

    hits = hashed.join(F.broadcast(frequent) if few else frequent, ["h1", "h2"], "left_semi")
    hits = hits.groupBy("__id", "__fp").agg(F.collect_set("pos").alias("__gone"))
    hits = hits.withColumnRenamed("__fp", "__of").hint("shuffle_hash")
    joined = docs.withColumn("__fp", fingerprint(F.col("text")))
    joined = joined.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__of")), "left")
    joined = joined.withColumn("__lines", lines_of(F.col("text")))

    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))  # in order
    stay = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda i: F.get("__lines", i)))
    return joined.withColumn("__stay", stay).select(
        *docs.columns,
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size("__stay")).cast("long").alias("__n_dropped"),
        F.array_join("__stay", "\n").alias("__kept"),
    )
