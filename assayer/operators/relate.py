"""Joins and set operations of the evidence model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted to at most so many rows.
BROADCAST_ROWS = 100_000


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else Spark picks a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def any_of(left: DataFrame, right: DataFrame, conditions: list[list[str]]) -> DataFrame:
    """Rows that agree on all columns of one of the lists: a union of equi-joins, each pair once.

    An OR in one join would force a nested loop.
    """
    parts = [left.join(right, names) .select(*left.columns, *[c for c in right.columns if c not in left.columns]) for names in conditions]
    return reduce(DataFrame.unionByName, parts).distinct()


def missing(child: DataFrame, key: str, parent: DataFrame, parent_key: str, code: str, record: str | None = None) -> DataFrame:
    """Findings (code, record) for child rows whose key, null excepted, has no parent; ``record``: key if not named."""
    keys = parent.select(F.col(parent_key).alias("_k"))
    rows = child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_k"), "left_anti")
    return rows.select(F.lit(code).alias("code"), F.col(record or key).cast("string").alias("record"))


def first_unused(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, first_unused): the smallest number from 0 on that none of the group's rows has."""
    used = rows.select(group, F.col(number).cast("long").alias("_k")).distinct().where("_k >= 0")
    place = F.row_number().over(Window.partitionBy(group).orderBy("_k")) - 1
    found = used.withColumn("_n", place).groupBy(group).agg(F.min(F.when(F.col("_k") != F.col("_n"), F.col("_n"))).alias("gap"), F.count("*").alias("n"))
    return found.select(group, F.coalesce("gap", "n").cast("long").alias("first_unused"))


def first_wins(parts: list[tuple[str, DataFrame]], keys: list[str], order: list[str], place: str | None = None) -> DataFrame:
    """Ordered union: of equal keys the earliest part's first row stays; adds ``source_run`` and, in ``place``, its number."""
    rows = reduce(DataFrame.unionByName, [df.withColumns({"source_run": F.lit(n), "_part": F.lit(i)}) for i, (n, df) in enumerate(parts)])
    w = Window.partitionBy(*keys).orderBy("_part", *order)
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.withColumnRenamed("_part", place) if place else rows.drop("_part")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: old rows whose key is written anew go, new rows come."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def divide(rows: DataFrame, group: str, member: str, allowed: DataFrame) -> DataFrame:
    """Groups all of whose members are allowed (relational division)."""
    known = allowed.select(F.col(allowed.columns[0]).alias(member)).distinct().withColumn("_ok", F.lit(1))
    joined = rows.join(known, member, "left")
    return joined.groupBy(group).agg(F.count("*").alias("members"), F.count("_ok").alias("_n")).where("members = _n").drop("_n")


def neighbours(rows: DataFrame, group: str, position: str, reach: int = 1) -> DataFrame:
    """(group, position, offset, neighbour): rows up to ``reach`` positions away in the same group.

    Each row is sent to the positions near it, so the band join is an equi-join.
    """
    spread = rows.select(group, F.col(position).alias("neighbour"), F.explode(F.expr(f"sequence(-{reach}, {reach})")).alias("offset")).where("offset <> 0")
    spread = spread.withColumn(position, F.col("neighbour") - F.col("offset"))
    return rows.select(group, position).join(spread, [group, position]).select(group, position, F.col("offset").cast("long").alias("offset"), "neighbour")


def slots(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): missing, unexpected or answered, by a full outer join of key sets."""
    a, b = expected.select(*keys).distinct().withColumn("_a", F.lit(1)), present.select(*keys).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").otherwise("answered")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def unique_or_reason(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, reason): the group's only distinct value, or why there is none."""
    found = rows.groupBy(*group).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v"))
    reason = F.when(F.col("n") == 0, "no source").when(F.col("n") > 1, "ambiguous source").otherwise("resolved")
    return found.select(*group, F.when(F.col("n") == 1, F.col("v")).alias(value), reason.alias("reason"))


def token_cost(input_: str, cached: str, written: str, output: str, prices: dict[str, float]) -> Column:
    """Cost of one call at prices per million tokens: input that was neither cached nor written, cached, written, output."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    regular = F.greatest(F.lit(0), n(input_) - n(cached) - n(written))
    return (regular * prices["input"] + n(cached) * prices["cached"] + n(written) * prices["written"] + n(output) * prices["output"]) / 1e6
