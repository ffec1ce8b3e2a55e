"""Record contracts: findings, salvage, guarded merges and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as T


def findings(rows: DataFrame, record: Column, rules: dict[str, Column]) -> DataFrame:
    """(finding_id, code, record): one row per broken rule; a rule that gives null isn't broken.

    All rules are looked at in one pass over the rows.
    """
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    out = rows.select(record.cast("string").alias("record"), F.explode(codes).alias("code"))
    return out.select(T.short_id("F-", F.col("code"), F.col("record"), length=12).alias("finding_id"), "code", "record")


def reported(value: Column, status: Column, reason: Column, evidence: Column) -> Column:
    """True where a reported field breaks the rule: a reported value has a value and no reason; a missing one has
    a reason, no value and cites nothing."""
    ok = F.when(status == "reported", value.isNotNull() & reason.isNull()).when(status == "missing", value.isNull() & reason.isNotNull() & (F.size(evidence) == 0)).otherwise(False)
    return ~F.coalesce(ok, F.lit(False))


def literal_support(quote: Column, value: Column, source: Column) -> Column:
    """``literal`` if the source holds the quote and the quote the value, ``semantic_review`` if only the former, else
    ``bad_quote``; empty and null ones are held by nothing."""
    quoted = (quote != "") & source.contains(quote)
    return F.when(quoted & (value != "") & quote.contains(value), "literal").when(quoted, "semantic_review").otherwise("bad_quote")


def repaired_quote(quote: Column, clause: Column) -> tuple[Column, Column]:
    """(state, quote): a quote that the cited clause holds stays ``verbatim``, another is ``replaced`` by the clause, and
    without a clause it is ``dropped``."""
    held = F.coalesce((quote != "") & clause.contains(quote), F.lit(False))
    return F.when(clause.isNull(), "dropped").when(held, "verbatim").otherwise("replaced"), F.when(held, quote).otherwise(clause)


def salvage(rows: DataFrame, key: str, citations: str, known: DataFrame) -> DataFrame:
    """Adds ``salvage``: kept, dropped_unknown_citation or dropped_uncited; a row stays whole or goes whole."""
    ids = known.select(F.col(known.columns[0]).alias("_id")).distinct()
    cited = rows.select(key, F.explode_outer(citations).alias("_id"))
    state = cited.join(ids.withColumn("_known", F.lit(True)), "_id", "left").groupBy(key).agg(F.count("_id").alias("n"), F.count("_known").alias("k"))
    kind = F.when(F.col("n") == 0, "dropped_uncited").when(F.col("k") < F.col("n"), "dropped_unknown_citation").otherwise("kept")
    return rows.join(state.select(key, kind.alias("salvage")), key)


def guarded_patch(base: DataFrame, patches: DataFrame, keys: list[str], digest: str, column: str) -> DataFrame:
    """Applies one field of each patch whose digest still equals the row's; adds ``patch``: applied, stale or none.

    ``patches``: keys, ``digest`` and ``new_value``.
    """
    p = patches.select(*keys, F.col(digest).alias("_d"), F.col("new_value").alias("_v"), F.lit(True).alias("_p"))
    rows = base.join(p, keys, "left")
    fits = F.col("_p").isNotNull() & (F.col(digest) == F.col("_d"))
    state = F.when(F.col("_p").isNull(), "none").when(fits, "applied").otherwise("stale")
    return rows.withColumns({column: F.when(fits, F.col("_v")).otherwise(F.col(column)), "patch": state}).drop("_d", "_v", "_p")


def dispositions(candidates: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """(key, decisions, ok): every candidate has exactly one decision."""
    n = decided.groupBy(key).agg(F.count("*").alias("decisions"))
    rows = candidates.select(key).join(n, key, "left").withColumn("decisions", F.coalesce("decisions", F.lit(0)).cast("long"))
    return rows.withColumn("ok", F.col("decisions") == 1)


def apply_patch(graph: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Additive all-or-nothing patch: nothing is added if any of its keys is null, repeated or known already."""
    bad = reduce(
        DataFrame.unionByName,
        [
            patch.where(F.col(key).isNull()).select(F.lit(1).alias("x")),
            patch.groupBy(key).count().where("count > 1").select(F.lit(1).alias("x")),
            patch.join(graph.select(key), key, "left_semi").select(F.lit(1).alias("x")),
        ],
    ).agg(F.count("*").alias("_bad"))
    return graph.unionByName(patch.join(F.broadcast(bad)).where("_bad = 0").drop("_bad"))
