"""Outcome candidates of evidence, and the census of signals that tells complex papers from simple ones.

Tables: evidence (paper, evidence_id, ord, text, tags, source_ids), sources (paper, source_id, section, location).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import signals as S
from assayer.functions import text as T


def _named(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(S.has(text, p), F.lit(n)) for n, p in patterns.items()]))


def labels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(S.VISUAL_REFERENCE), F.lit(1))


def _labelled(signature: Column, found: Column) -> Column:
    """The label that a signature prefers, else the first, else an empty text."""
    ends = F.create_map(*[F.lit(x) for kv in S.PREFERRED_LABEL.items() for x in kv])
    preferred = F.filter(found, lambda x: F.coalesce(F.regexp_replace(F.lower(x), "[^a-z0-9]", "").endswith(F.try_element_at(ends, signature)), F.lit(False)))
    return F.coalesce(F.get(preferred, 0), F.get(found, 0), F.lit(""))


def admitted(evidence: DataFrame) -> DataFrame:
    """Evidence that states an outcome, with its endpoint ``families``."""
    t = F.col("text")
    rows = evidence.withColumn("families", _named(t, S.ENDPOINTS))
    method = S.has(t, S.METHOD_ONLY) & ~(S.has(t, S.OUTCOME_VALUE) | S.has(t, S.RESULT_SIGNAL))
    context = S.has(t, S.TARGET_CONTEXT)
    stated = F.coalesce(F.array_contains("tags", "outcomes"), F.lit(False)) | (context & (S.has(t, S.QUANTITATIVE_RESULT) | S.has(t, S.QUALITATIVE_RESULT)))
    return rows.where(S.has(t, S.DIRECT_SIGNAL) & ~method & (F.size("families") > 0) & stated)


def build(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(paper, candidate_id, family, signature, source_id, evidence_ids, source_ids, text, signals, figure, route_hint,
    confidence, reasons): evidence grouped by endpoint family, signature, figure or table, and source.

    Lists keep the order in which the paper states things; a group's rows are gathered in one row, as its text is.
    """
    rows = admitted(evidence).withColumn("cites", F.col("source_ids")).withColumn("source_id", F.explode("source_ids"))
    rows = rows.join(sources.select("paper", "source_id", F.lower(F.coalesce("section", F.lit(""))).alias("_section"), "location"), ["paper", "source_id"], "left")
    rows = rows.where(~F.coalesce(F.col("_section").isin("introduction", "background"), F.lit(False)))
    signatures = _named(F.col("text"), S.SIGNATURES)
    rows = rows.withColumn("signature", F.explode(F.when(F.size(signatures) > 0, signatures).otherwise(F.array(F.lit("general")))))
    family = F.try_element_at(F.create_map(*[F.lit(x) for kv in S.SIGNATURE_FAMILY.items() for x in kv]), F.col("signature"))
    rows = rows.withColumn("family", F.when(F.coalesce(F.array_contains("families", family), F.lit(False)), family).otherwise(F.get("families", 0)))
    rows = rows.withColumn("visual", F.lower(F.coalesce(F.nullif("location", F.lit("")), _labelled(F.col("signature"), labels(F.col("text"))))))
    key = ["paper", "family", "signature", "visual", "source_id"]
    rows = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "evidence_id", "cites", F.trim("text").alias("text")))).alias("x"))
    each = lambda name: F.transform("x", lambda r: r[name])
    rows = rows.select(
        *key, F.array_distinct(each("evidence_id")).alias("evidence_ids"), F.array_distinct(F.flatten(each("cites"))).alias("source_ids"), F.array_join(F.array_distinct(each("text")), " ").alias("text")
    )
    t = F.col("text")
    figure = F.when(F.col("visual") != "", F.col("visual")).otherwise(F.get(labels(t), 0))
    rows = rows.withColumn("figure", figure).withColumn("route_hint", F.when(F.col("figure").isNotNull() & ~S.has(t, S.EXPLICIT_VALUE), "vision").otherwise("text"))
    near = S.has(t, S.TARGET_CONTEXT) | F.col("family").isin("gene_editing", "therapeutic_function")
    acted = S.has(t, S.INTERVENTION)
    reasons = F.array_compact(
        F.array(
            F.when(S.has(t, S.QUANTITATIVE_RESULT) & near, "explicit_numeric_result"),
            F.when(S.has(t, S.RESULT_SIGNAL) & acted & near, "explicit_result_language"),
            F.when((F.col("route_hint") == "vision") & S.has(t, S.VISUAL_OUTCOME) & (acted | (F.col("family") == "gene_editing")) & near, "visual_result_location"),
        )
    )
    rows = rows.withColumn("reasons", reasons)
    found = F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(S.DIRECT_SIGNAL), F.lit(0))), 1, 12)
    ident = T.short_id("OC-", *[F.col(k).cast("string") for k in key])
    return rows.select(
        "paper", ident.alias("candidate_id"), "family", "signature", "source_id", "evidence_ids", "source_ids", "text", found.alias("signals"), "figure", "route_hint",
        F.when(F.size("reasons") > 0, "high").otherwise("medium").alias("confidence"), "reasons",
    )


@dataclass(frozen=True)
class Thresholds:
    """Counts from which a paper scores points; passages that only the corpus view has weigh ``corpus_weight``."""

    many_groups: int = 8
    some_groups: int = 4
    many_families: int = 4
    some_families: int = 2
    visuals: int = 2
    many_contextual: int = 4
    contextual_families: int = 2
    many_tagged: int = 60
    corpus_weight: float = 1.0


#: The two views: the corpus view holds some three times the passages, and those it alone has count half.
COMPACT = Thresholds()
FULL = Thresholds(many_groups=24, some_groups=12, many_contextual=12, many_tagged=180, corpus_weight=0.5)


def census(evidence: DataFrame, sources: DataFrame, limits: Thresholds = COMPACT) -> DataFrame:
    """(paper, groups, families, visuals, score, route): additive points of a paper's signals; 4 make it complex."""
    t = F.col("text")
    place = evidence.select("paper", "evidence_id", F.explode("source_ids").alias("source_id")).join(sources.select("paper", "source_id", F.lower("location").alias("v")), ["paper", "source_id"])
    place = place.where("v <> ''").groupBy("paper", "evidence_id").agg(F.collect_set("v").alias("places"))
    empty = F.expr("cast(array() as array<string>)")
    tags = F.coalesce("tags", empty)
    rows = evidence.join(place, ["paper", "evidence_id"], "left").withColumns({"families": _named(t, S.ENDPOINTS), "tagged": F.array_contains(tags, "outcomes"), "acted": S.has(t, S.INTERVENTION), "seen": labels(t)})
    result, visual = S.has(t, S.RESULT_SIGNAL), F.size("seen") > 0
    shown = visual & S.has(t, S.VISUAL_OUTCOME)
    robust = S.has(t, S.QUANTITATIVE_RESULT) | (result & F.col("acted") & S.has(t, S.TARGET_CONTEXT)) | shown
    counts = (F.col("tagged") | robust) & S.has(t, S.DIRECT_SIGNAL) & (F.size("families") > 0)
    strong = counts & (S.has(t, S.OUTCOME_VALUE) | (result & F.col("acted")) | (shown & (F.col("acted") | F.array_contains("families", "gene_editing"))))
    weight = F.when((F.size(F.array_distinct(tags)) == 1) & F.array_contains(tags, "full_corpus"), limits.corpus_weight).otherwise(1.0)
    rows = rows.withColumns({"counts": counts, "strong": strong, "weight": weight})
    spots = F.array_distinct(F.concat(F.coalesce("places", empty), F.when(F.size("seen") > 0, F.array(F.lower(F.get("seen", 0)))).otherwise(empty)))
    kinds = lambda when, what: F.size(F.array_distinct(F.flatten(F.collect_set(F.when(when, what)))))
    both = F.col("counts") & F.col("acted")
    g = rows.groupBy("paper").agg(
        F.count_if("strong").alias("groups"), F.sum(F.when(F.col("strong"), F.col("weight")).otherwise(0.0)).alias("volume"), kinds(F.col("strong"), F.col("families")).alias("families"),
        kinds(F.col("strong"), spots).alias("visuals"), F.sum(F.when(both, F.col("weight")).otherwise(0.0)).alias("contextual"), kinds(both, F.col("families")).alias("contextual_families"), F.count_if("tagged").alias("tagged"),
    )
    c = F.col
    points = [
        F.when(c("volume") >= limits.many_groups, 2).when(c("volume") >= limits.some_groups, 1).otherwise(0), F.when(c("families") >= limits.many_families, 2).when(c("families") >= limits.some_families, 1).otherwise(0),
        F.when(c("visuals") > 0, 2).otherwise(0), F.when(c("visuals") >= limits.visuals, 1).otherwise(0), F.when(c("contextual") >= limits.many_contextual, 2).otherwise(0),
        F.when(c("contextual_families") >= limits.contextual_families, 2).otherwise(0), F.when(c("tagged") >= limits.many_tagged, 2).otherwise(0),
    ]
    score = sum(points, F.lit(0)).cast("long")
    return g.select("paper", "groups", c("families").cast("long").alias("families"), c("visuals").cast("long").alias("visuals"), score.alias("score"), F.when(score >= 4, "complex").otherwise("simple").alias("route"))
