"""Idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.sources.folders import Cuts


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON (keys in order, nulls left out) of a frozen list of columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def converge(existing: DataFrame, proposed: DataFrame, keys: list[str], columns: list[str], replace: bool = False, version: bool = False) -> DataFrame:
    """Proposed rows with ``status``: created, unchanged, replaced, versioned or refused, by fingerprint."""
    old = existing.select(*keys, fingerprint(columns).alias("_old")).groupBy(*keys).agg(F.max("_old").alias("_old"))
    rows = proposed.withColumn("fingerprint", fingerprint(columns)).join(old, keys, "left")
    changed = "replaced" if replace else "versioned" if version else "refused"
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("fingerprint"), "unchanged").otherwise(changed)
    return rows.withColumn("status", status).drop("_old")


def rebuild(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Partial rebuild: keys that were built anew replace the old ones, the others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def images(rows: DataFrame, payload: str, ref: str, recorded: str) -> DataFrame:
    """Adds ``bytes``, ``digest``, ``file`` and ``state``: saved, changed (the digest isn't the recorded one) or skipped.

    ``file`` is the last part of the reference, so no path leads out of the folder.  Payloads that aren't base64 or
    decode to nothing are skipped.
    """
    data = F.try_to_binary(F.col(payload), F.lit("base64"))
    rows = rows.withColumn("bytes", F.when(F.length(data) > 0, data))
    rows = rows.withColumn("digest", F.sha2("bytes", 256)).withColumn("file", F.element_at(F.split(ref, r"[/\\\\]"), -1))
    state = F.when(F.col("bytes").isNull(), "skipped").when(F.col("digest") != F.col(recorded), "changed").otherwise("saved")
    return rows.withColumn("state", state)


class Refused(Exception):
    """A write that would change rows which must not change."""


def converge_or_refuse(existing: DataFrame, proposed: DataFrame, keys: list[str], columns: list[str], replace: bool = False, version: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, ledger) after a convergent write, or ``Refused`` if a row would change and neither way is allowed.

    ``replace`` overwrites changed rows; ``version`` keeps them with their old ``version`` number in the ledger and
    writes the new ones with the next.  Proposed rows that are there already change nothing.
    """
    found = converge(existing, proposed, keys, columns, replace, version)
    refused = found.where("status = 'refused'").limit(1).collect()
    if refused:
        raise Refused(", ".join(f"{k}={refused[0][k]}" for k in keys))
    if "version" not in existing.columns:
        existing = existing.withColumn("version", F.lit(1))
    old = existing.groupBy(*keys).agg(F.max("version").alias("_version"))
    written = found.where("status <> 'unchanged'").join(old, keys, "left")
    number = F.when(F.col("status") == "versioned", F.col("_version") + 1).otherwise(F.coalesce("_version", F.lit(1)))
    written = written.withColumn("version", number)
    gone = written.where("status in ('replaced', 'versioned')").select(*keys)
    table = existing.join(gone, keys, "left_anti").unionByName(written.select(*existing.columns))
    ledger = existing.join(written.where("status = 'versioned'").select(*keys), keys, "left_semi").withColumn("superseded", F.lit(True))
    return table, ledger


def report(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_no, line): a Markdown table, header first; bars in cells are escaped, nulls are empty.

    Lines are numbered by a sort over ranges, so a report of any size is written by many tasks.
    """
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    lines = rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line")).orderBy(*order)
    lines = lines.withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}).select("_part", "_n", "line")
    lines = Cuts(rows.sparkSession, "report")(lines)
    sizes = lines.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_n"))
    body = lines.join(F.broadcast(before), "_part").select((place + F.col("_before") + 1).cast("long").alias("line_no"), "line")
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return rows.sparkSession.createDataFrame(list(enumerate(head)), "line_no long, line string").unionByName(body)
