"""Selection under budgets and per-group caps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def prefix_budget(df: DataFrame, group: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Rows that start within the budget; ``granted`` is what of a row's cost still fits."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("_before", before).where(F.col("_before") < budget)
    return rows.withColumn("granted", F.least(F.col(cost), F.lit(budget) - F.col("_before"))).drop("_before")


def walked(rows: DataFrame, group: str, order: list, columns: list[str], schema: str, step: Callable[[], Callable]) -> DataFrame:
    """Rows that a walk takes: groups are dealt to tasks, sorted there and streamed through, one row at a time.

    A task holds the state of one group and one Arrow batch, whatever the group's size.  ``step()`` starts a group and
    gives a function from a row's values to whether it is taken.
    """
    dealt = rows.repartition(group).sortWithinPartitions(group, *order).select(group, *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, take = object(), None
        for batch in batches:
            keep = []
            for key, *values in batch.itertuples(index=False):
                if key != now and not (key is None and now is None):
                    now, take = key, step()
                keep.append(take(*values))
            yield batch[keep]

    return dealt.mapInPandas(run, schema)


def greedy_budget(df: DataFrame, group: str, key: str, priority: str, cost: str, budget: int, always: str | None = None) -> DataFrame:
    """(group, key, cost) of rows taken by descending priority, then key, whenever they still fit.

    Rows marked by the boolean column ``always`` are taken first, whatever they cost.  A row that doesn't fit is
    skipped and the walk goes on; rows that are dearer than the budget never enter it.
    """
    kinds = dict(df.dtypes)
    kept = F.coalesce(F.col(always), F.lit(False)) if always else F.lit(False)
    rows = df.select(group, key, F.col(priority).alias("_p"), F.col(cost).cast("long").alias(cost), kept.alias("_kept")).where(F.col("_kept") | (F.col(cost) <= budget))

    def step() -> Callable:
        used = 0

        def take(_key: object, price: int, always_: bool) -> bool:
            nonlocal used
            fits = bool(always_) or used + price <= budget
            used += price if fits else 0
            return fits

        return take

    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, {cost} long, _kept boolean"
    return walked(rows, group, [F.desc("_kept"), F.desc("_p"), key], [key, cost, "_kept"], schema, step).drop("_kept")


def payload_budget(df: DataFrame, group: str, key: str, priority: str, parts: str, budget: int, base: int = 0) -> DataFrame:
    """(group, key) of rows taken by descending priority, then key, where a row's cost is that of its payload.

    ``parts``: array of (id, cost) of everything that the row brings along: itself, its context rows and the sources
    that they cite.  A part that is in the payload already is paid; a row that brings nothing new is not taken.
    ``base`` is what an empty payload costs.
    """
    kinds = dict(df.dtypes)
    rows = df.select(group, key, F.col(priority).alias("_p"), F.col(parts).alias("_parts"))

    def step() -> Callable:
        paid: set = set()
        used = base

        def take(_key: object, bring: list) -> bool:
            nonlocal used
            new = {x["id"]: x["cost"] for x in bring if x["id"] not in paid}
            price = sum(new.values())
            if not new or used + price > budget:
                return False
            paid.update(new)
            used += price
            return True

        return take

    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, _parts {kinds[parts]}"
    return walked(rows, group, [F.desc("_p"), key], [key, "_parts"], schema, step).drop("_parts")


def closure_budget(df: DataFrame, group: str, key: str, priority: str, cost: str, parent: str, budget: int) -> DataFrame:
    """(group, key): rows by priority, each with the row it depends on; a shared dependency is paid once.

    A dependency that is no row of the group costs nothing and isn't listed.
    """
    known = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(cost).cast("long").alias("_c"))
    rows = df.join(known, F.col(group).eqNullSafe(F.col("_g")) & (F.col(parent) == F.col("_k")), "left")
    own = F.struct(F.col(key).alias("id"), F.col(cost).cast("long").alias("cost"))
    rows = rows.withColumn("_parts", F.when(F.col("_k").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_k").alias("id"), F.col("_c").alias("cost")))))
    taken = payload_budget(rows, group, key, priority, "_parts", budget)
    back = rows.select(group, key, F.col("_k").alias("_parent")).join(taken, [group, key], "left_semi")
    return back.select(group, F.explode(F.array_compact(F.array(key, "_parent"))).alias(key)).distinct()


def bundles(df: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    """Adds ``bundle`` from 0: rows of a group in fixed-size chunks."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("bundle", F.floor((n - 1) / size).cast("long"))
