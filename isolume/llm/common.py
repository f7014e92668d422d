"""What the operators of this subpackage share: row identity, folds and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isolume.functions.kernels import bound
from isolume.storage import scratch_path, shared_dir, stored  # noqa: F401

#: The white space that the contracts name: space, and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fingerprint(text: Column) -> Column:
    """With doc_id it names a row's content, so that rows that repeat a doc_id keep results of their own."""
    return F.xxhash64(text)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["fp"] == b["fp"])


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: a known doc_id outside the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(name: str, *taken: list[str]) -> str:
    """The name, with underscores in front until no column has it (Spark's names ignore case)."""
    low = {c.lower() for columns in taken for c in columns}
    while name.lower() in low:
        name = "_" + name
    return name


#: Bytes of input for each core below which rows are dealt out; files of one row group can't be split otherwise.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of less than SMALL bytes for each core, dealt out to all cores; larger ones as they are.

    At most SMALL bytes a core are shuffled, so this never grows with the data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * SMALL else df


def running_sums(values: Column, chunk: int = 64) -> Column:
    """array<bigint> of the sums up to each element. Sums of chunks first, so the work grows with chunk times the elements."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda n, x: n + x)

    def of(vs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(vs) - 1, F.lit(0)), F.lit(chunk)), lambda i: F.slice(vs, i + 1, chunk))

        def joined(sums: Column) -> Column:
            before = F.zip_with(parts, F.transform(sums, lambda _, i: total(F.slice(sums, 1, i))), lambda p, n: F.struct(p.alias("p"), n.alias("n")))
            return F.flatten(F.transform(before, lambda b: F.transform(b["p"], lambda _, j: b["n"] + total(F.slice(b["p"], 1, j + 1)))))

        return bound(F.transform(parts, total), joined)

    return bound(values, of)
