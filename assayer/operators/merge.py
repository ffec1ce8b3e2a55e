"""Merges of several extraction results of one paper.

Outcomes: paper, outcome_id, ord (place in its run's result), endpoint, value_text, unit and further columns;
experiments: paper, experiment_id, ord and further columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import relate

KEY = ("endpoint", "value_text", "unit")


def _plain(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def rename_collisions(rows: DataFrame, group: str, name: str, order: list[str]) -> DataFrame:
    """Adds ``new_id``: a name that an earlier row of the group has gets -2, -3 and so on, passing over taken ones.

    What a row is called depends on the names given before it, so groups are streamed through in order; a task holds
    the names of one group.
    """
    dealt = rows.withColumn("new_id", F.col(name).cast("string")).repartition(group).sortWithinPartitions(group, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, given, following = object(), set(), {}
        for batch in batches:
            out = []
            for key, old in zip(batch[group], batch["new_id"]):
                if key != now:
                    now, given, following = key, set(), {}
                new = old
                while new in given:
                    following[old] = n = following.get(old, 1) + 1
                    new = f"{old}-{n}"
                given.add(new)
                out.append(new)
            yield batch.assign(new_id=out)

    return dealt.mapInPandas(run, dealt.schema)


def union_runs(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Outcomes of several runs, the earliest of equal (paper, endpoint, value, unit) but for case and blanks, with
    ``source_run``; names that collide are renamed and keep their own in ``source_outcome_id``."""
    named = [(n, df.withColumns({f"_{k}": _plain(k) for k in KEY})) for n, df in runs]
    rows = relate.first_wins(named, ["paper", *(f"_{k}" for k in KEY)], ["ord"], place="_run").drop(*(f"_{k}" for k in KEY))
    rows = rename_collisions(rows, "paper", "outcome_id", ["_run", "ord"])
    changed = F.when(F.col("new_id") != F.col("outcome_id"), F.col("outcome_id"))
    return rows.withColumns({"source_outcome_id": changed, "outcome_id": F.col("new_id")}).drop("new_id", "_run")


def union_experiments(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Experiments of several runs; the earliest of equal ids stays."""
    return relate.first_wins(runs, ["paper", "experiment_id"], ["ord"])


def second_pass(baselines: list[tuple[str, DataFrame]], later: tuple[str, DataFrame], reports: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(outcomes, papers): each paper's first baseline that has it, merged with the second pass.

    ``papers`` counts outcomes by stage and says whether the baseline's merge report (``reports``: paper by root) is
    carried forward.
    """
    first = relate.first_wins([(n, df.select("paper").distinct()) for n, df in baselines], ["paper"], ["paper"])
    chosen = [(n, df.join(first.where(F.col("source_run") == n), "paper", "left_semi")) for n, df in baselines]
    merged = union_runs([*chosen, later])
    stage = merged.groupBy("paper").agg(F.count("*").alias("outcomes"), F.count_if(F.col("source_run") == later[0]).alias("added"))
    told = None
    for n, df in reports:
        part = df.select("paper", F.lit(n).alias("baseline"))
        told = part if told is None else told.unionByName(part)
    papers = stage.join(first.withColumnRenamed("source_run", "baseline"), "paper", "left")
    carried = papers.join(told.distinct().withColumn("carried", F.lit(True)), ["paper", "baseline"], "left") if told is not None else papers.withColumn("carried", F.lit(None).cast("boolean"))
    return merged, carried.withColumn("carried", F.coalesce("carried", F.lit(False)))


def observations(outcomes: DataFrame, seen: DataFrame, experiments: DataFrame) -> DataFrame:
    """``outcomes`` with a row for each resolved observation, under the first names ``V1``, ``V2`` ... that are free.

    seen: paper, ord, disposition, endpoint, value_text, unit; it goes to the paper's first experiment, or to E1.
    """
    numbers = F.expr("cast(regexp_extract(outcome_id, '^V([1-9][0-9]{0,8})$', 1) as int)")
    used = outcomes.where(F.col("outcome_id").rlike("^V[1-9][0-9]{0,8}$")).groupBy("paper").agg(F.collect_set(numbers).alias("used"))
    rows = seen.where("disposition = 'resolved'").withColumn("n", F.row_number().over(Window.partitionBy("paper").orderBy("ord")))
    rows = rows.join(used, "paper", "left").withColumn("used", F.coalesce("used", F.expr("cast(array() as array<int>)")))
    free = F.array_except(F.sequence(F.lit(1), F.col("n") + F.size("used")), "used")
    home = experiments.groupBy("paper").agg(F.min_by("experiment_id", "ord").alias("experiment_id"))
    rows = rows.withColumn("outcome_id", F.concat(F.lit("V"), F.element_at(free, F.col("n")))).join(home, "paper", "left")
    new = {"experiment_id": F.coalesce("experiment_id", F.lit("E1")), "source_run": F.lit("vision")}
    rows = rows.withColumns(new)
    missing = [c for c in outcomes.columns if c not in rows.columns]
    kinds = dict(outcomes.dtypes)
    rows = rows.withColumns({c: F.lit(None).cast(kinds[c]) for c in missing}) if missing else rows
    return outcomes.unionByName(rows.select(*outcomes.columns))


def overlay(base: tuple[str, DataFrame], salvage: tuple[str, DataFrame], papers: DataFrame, seen: DataFrame, experiments: DataFrame) -> DataFrame:
    """The base with the listed papers unioned with their salvage, and observations merged in."""
    some = base[1].join(papers.select("paper").distinct(), "paper", "left_semi")
    rest = base[1].join(papers.select("paper").distinct(), "paper", "left_anti").withColumns({"source_run": F.lit(base[0]), "source_outcome_id": F.lit(None).cast("string")})
    merged = union_runs([(base[0], some), (salvage[0], salvage[1].join(papers.select("paper").distinct(), "paper", "left_semi"))])
    return observations(rest.unionByName(merged.select(*rest.columns)), seen, experiments)
