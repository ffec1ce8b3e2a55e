"""Where results, checkpoints and scratch files go."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

OUTPUT_VARIABLE = "ASSAYER_OUTPUT_ROOT"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one that ``spark.checkpoint.dir`` names.

    Only where that is unset and the session runs in one process does a temporary folder take its place; on a cluster
    a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="assayer-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def output_path(spark: SparkSession, *parts: str, root: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """Where a result goes: below ``root``, else the folder that ``ASSAYER_OUTPUT_ROOT`` names, else the shared folder."""
    named = (os.environ if env is None else env).get(OUTPUT_VARIABLE, "").strip()
    base = root or named or f"{shared_folder(spark)}/output"
    return "/".join([base.rstrip("/"), *parts])


class Cuts:
    """Cuts the lineage of an iteration: rows are written as Parquet to the shared folder and read again.

    A checkpoint would do, but keeps its plan's size estimate, and estimates multiply with every join of every round.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, last: int, first: int = 0) -> None:
        """Deletes what was written but for the ``first`` and the ``last`` tables."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths[first : len(self.paths) - last]:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths = self.paths[:first] + self.paths[max(first, len(self.paths) - last) :]
