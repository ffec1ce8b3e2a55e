"""Similarity of gold rows and extracted outcomes, with the gates that a pair has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import signals as S
from assayer.operators.relate import checked


def rare_tokens(gold: DataFrame, most: int = 2) -> DataFrame:
    """(token): endpoint tokens of ``most`` gold rows at most."""
    rows = gold.select("paper", "gold_id", F.explode(S.claim_tokens(F.col("endpoint"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("token")


def gold_scores(gold: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(paper, gold_id, outcome_id, score, endpoint_gate, polarity_gate, numeric_gate) of pairs of one paper that share
    an endpoint token; every other pair scores 0.

    gold: paper, gold_id, endpoint, basis, qualitative, evidence_text, value, value_text, value_status; outcomes: paper,
    outcome_id, endpoint, assay, text (of all its fields), context (text of its experiment), value, relationship.
    ``value_text`` is the gold value as it is written.

    The score adds the shared share of the smaller token set, 0.55 for the exact value or 0.4 for its mention, 0.2 for a
    qualitative claim with three shared tokens, and up to 0.2 for the endpoint's own fields; 1 at most, and 0 if a gate
    fails.  Pairs meet on endpoint tokens, without which the endpoint gate is shut.
    """
    whole = F.concat_ws(" ", "endpoint", "basis", "qualitative", "evidence_text")
    rare = rare_tokens(gold).withColumn("_rare", F.lit(True))
    g = gold.select(
        "paper", "gold_id", S.claim_tokens(whole).alias("g"), S.claim_tokens(F.col("endpoint")).alias("ge"), S.claim_tokens(F.col("qualitative")).alias("gq"),
        F.coalesce(F.trim("qualitative") != "", F.lit(False)).alias("told"), F.col("value").alias("gv"), "value_text", "value_status",
    )
    few = g.select("paper", "gold_id", F.explode("ge").alias("token")).join(checked(rare), "token", "left")
    few = few.groupBy("paper", "gold_id").agg(F.collect_set(F.when(F.col("_rare"), F.col("token"))).alias("gr"))
    g = g.join(few, ["paper", "gold_id"])
    o = outcomes.select(
        "paper", "outcome_id", S.claim_tokens(F.concat_ws(" ", "text", "context")).alias("o"), S.claim_tokens(F.col("text")).alias("own"), S.claim_tokens(F.concat_ws(" ", "endpoint", "assay")).alias("oe"),
        S.fused(F.concat_ws(" ", "text", "context")).alias("words"), F.col("value").alias("ov"), "relationship",
    )
    keys = g.select("paper", "gold_id", F.explode("ge").alias("token")).join(o.select("paper", "outcome_id", F.explode("own").alias("token")), ["paper", "token"])
    rows = keys.select("paper", "gold_id", "outcome_id").distinct().join(g, ["paper", "gold_id"]).join(o, ["paper", "outcome_id"])
    size = lambda a, b: F.size(F.array_intersect(a, b))
    rows = rows.withColumns(
        {
            "shared": size("g", "o"), "ends": size("ge", "own"), "fields": size("ge", "oe"), "scarce": size("gr", "own"), "quality": size("gq", "own"),
            "exact": F.coalesce(F.abs(F.col("ov") - F.col("gv")) <= 1e-9, F.lit(False)),
            "told_value": F.coalesce(F.col("gv").isNotNull() & F.regexp_like("words", F.concat(F.lit(r"(?<!\d)\Q"), "value_text", F.lit(r"\E(?!\d)"))), F.lit(False)),
            "sharp": F.array_intersect("gq", F.array(*map(F.lit, S.DISTINCTIVE))),
        }
    )
    lexical = F.col("shared") / F.greatest(F.lit(1), F.least(F.size("g"), F.size("o")))
    bonus = F.when(F.col("exact"), 0.55).when(F.col("told_value"), 0.4).otherwise(0.0)
    said = F.when(F.col("told") & (F.col("shared") >= 3), 0.2).otherwise(0.0)
    score = F.least(F.lit(1.0), lexical + bonus + said + 0.2 * F.col("fields") / F.greatest(F.lit(1), F.size("ge")))
    endpoint = (F.col("ends") > 0) & (F.col("exact") | F.col("told_value") | ((F.col("scarce") > 0) & (F.col("ends") >= 2)) | (F.col("quality") >= 3))
    base, affirmed = S.polarity(F.col("relationship"))
    echoed = lambda terms: (F.size(terms) == 0) | F.arrays_overlap(terms, "own")
    declared = F.coalesce(F.array_contains("sharp", base), F.lit(False))
    polarity = F.when(~declared, echoed(F.col("sharp"))).when(~affirmed, False).otherwise(echoed(F.array_except("sharp", F.array(base))))
    numeric = F.col("gv").isNull() | ~F.coalesce(F.col("value_status") == "reported", F.lit(False)) | F.col("exact") | F.col("told_value")
    rows = rows.select("paper", "gold_id", "outcome_id", score.alias("score"), endpoint.alias("endpoint_gate"), F.coalesce(polarity, F.lit(False)).alias("polarity_gate"), numeric.alias("numeric_gate"))
    return rows.withColumn("score", F.round(F.when(F.col("endpoint_gate") & F.col("polarity_gate") & F.col("numeric_gate"), F.col("score")).otherwise(0.0), 6))
