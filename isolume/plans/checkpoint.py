"""Resume points: a marker for each chromosome whose results are staged.

Results and markers lie in one folder, which is reached through Hadoop's file
systems, so the driver and all executors see the same. A marker holds a digest
of the settings; those of other settings don't count.
"""

from __future__ import annotations

import hashlib
import json
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from isolume.storage import file_system


class Staged:
    """Merged results by chromosome in <folder>/merged, and markers in <folder>/done."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.digest = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()

    @property
    def results(self) -> str:
        return f"{self.folder}/merged"

    def _marker(self, chrom: str) -> str:
        return f"{self.folder}/done/{quote(chrom, safe='')}.{self.digest[:16]}"

    def done(self) -> set[str]:
        """Chromosomes whose results under these settings are staged."""
        files, at = file_system(self.spark, f"{self.folder}/done")
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return {unquote(n.rsplit(".", 1)[0]) for n in names if n.endswith(f".{self.digest[:16]}")}

    def write(self, merged: DataFrame, chroms: list[str]) -> None:
        """Stages the results of these chromosomes in place of older ones, then marks each."""
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom").parquet(self.results)
        for c in chroms:
            files, at = file_system(self.spark, self._marker(c))
            files.create(at, True).close()

    def read(self, schema: StructType, chroms: list[str]) -> DataFrame:
        """What is staged of these chromosomes; one without results may be among them."""
        files, at = file_system(self.spark, self.results)
        if not files.exists(at):
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(self.results)
        return out.filter(out["chrom"].isin(*chroms)) if chroms else out.limit(0)

    def clear(self) -> None:
        files, at = file_system(self.spark, self.folder)
        files.delete(at, True)
