"""Samples that arrive one by one: a file stream of GTF lines, assembled and staged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isolume.sources import gtf
from isolume.sources.manifest import stem


def stream_transcripts(spark: SparkSession, folder: str, staged: str, checkpoint: str, files_at_once: int = 16) -> StreamingQuery:
    """Starts a stream that takes each new *.gtf file of a folder as one sample and appends its transcripts to staged.

    A file is read whole in one batch; a batch that is repeated after a failure replaces what it wrote before.
    """
    names = spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.gtf*").load(folder)
    names = names.select(F.col("_metadata.file_path").alias("path"))

    def batch(df: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in df.distinct().collect())  # files_at_once at most
        rows = [(number * files_at_once + i, p, stem(p), "no_cap", 1, "") for i, p in enumerate(paths)]
        if rows:
            samples = spark.createDataFrame(rows, "sample_ord int, gtf_path string, sample_id string, cap_status string, priority int, metadata string")
            gtf.read_transcripts(spark, samples).write.mode("overwrite").parquet(f"{staged}/batch={number}")

    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staged_transcripts(spark: SparkSession, staged: str) -> DataFrame:
    return spark.read.parquet(staged).drop("batch")
