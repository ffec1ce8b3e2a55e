"""Shared helpers: reading tables, worker paths, checkpoints, word arrays and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch where the cluster sets no number: texts are long, and a task holds several batches.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, bounds Arrow batches and gives the session a checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names.  Only where that is unset and the session runs in one
    process (master ``local``), a temporary folder takes its place; on a cluster a missing setting is an error.
    """
    context, root = spark.sparkContext, str(Path(__file__).resolve().parents[2])
    paths = [x for x in context.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not context.getConf().contains(rows):
        spark.conf.set(rows, str(ARROW_ROWS))
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="assayer-checkpoint-"))
    return spark


def words(text: Column) -> Column:
    """array<string> of the runs between blanks; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to at most ``rows`` rows, else as it is.

    ``df`` should be checkpointed, since it is counted here.  Without the hint Spark shuffles both sides
    and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (names compare without regard to case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


def rows_of(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that working columns beside it clash with no input column.

    Columns are read as ``F.col("row")[name]``; ``select("row.*")`` gives the input's columns back.  The optimizer
    reads through the struct, so columns that aren't used are still pruned from the scan.
    """
    return df.select(F.struct("*").alias("row"))


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id's text isn't 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def labels_of(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(doc_id, y): one row per id that may be learnt from; of several labels the largest counts."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(column).cast("int").alias("y"))
    return rows.where(in_training(F.col("doc_id")) & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))


def by_hash(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, y) per label, the first by a hash of the id."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [ids.where(F.col("y") == y).orderBy(*order).limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` passed through a generator of one row each.

    Filters and projections above it are not pushed into the expressions below, which would copy them into
    the lambdas that use them and evaluate them once per element.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))
