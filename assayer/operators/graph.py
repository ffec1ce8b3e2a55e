"""Audit of evidence graphs: entities and claims against the clauses that they cite.

entities: paper, entity_id, entity_type, name; claims: paper, claim_id, subject_id, predicate, object_id, experiment_id;
spans: paper, owner, clause_id, quote of entities and claims; clauses: paper, clause_id, text; scopes: paper,
experiment_id, clause_ids; predicates: predicate, subject_type, object_type that may stand together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators.relate import checked

SHARED = "SHARED"
# Names that are no disease, and words of payloads.
HEALTHY = ("healthy", "homeostasis", "healthy liver")
PAYLOAD = r"(?i)\b(mrna|sirna|sgrna|rna)\b"
SEVERAL = r"(?i),|;|\band\b|\bor\b"


def audit(entities: DataFrame, claims: DataFrame, spans: DataFrame, clauses: DataFrame, scopes: DataFrame, predicates: DataFrame) -> DataFrame:
    """(paper, owner, issue) of everything that is wrong with a graph; each pair once.

    Quotes must stand in their clause but for blanks and case; predicates bind their types; evidence stays in its
    experiment's scope; subject, object and claim share a clause; one cell entity is one cell.
    """
    issue = lambda rows, name, owner: rows.select("paper", F.col(owner).cast("string").alias("owner"), F.lit(name).alias("issue"))
    cited = spans.join(clauses.select("paper", "clause_id", F.col("text").alias("_t")), ["paper", "clause_id"], "left")
    name = F.col("name")
    types = entities.select("paper", F.col("entity_id").alias("_e"), F.col("entity_type").alias("_type"))
    side = lambda rows, key, out: rows.join(types.select("paper", F.col("_e").alias(key), F.col("_type").alias(out)), ["paper", key], "left")
    typed = side(side(claims, "subject_id", "subject_type"), "object_id", "object_type")
    allowed = typed.join(checked(predicates.distinct()), ["predicate", "subject_type", "object_type"], "left_anti")
    used = spans.groupBy("paper", "owner").agg(F.collect_set("clause_id").alias("_c"))
    held = lambda key, out: used.select("paper", F.col("owner").alias(key), F.col("_c").alias(out))
    rows = claims.join(held("claim_id", "_own"), ["paper", "claim_id"], "left").join(held("subject_id", "_s"), ["paper", "subject_id"], "left").join(held("object_id", "_o"), ["paper", "object_id"], "left")
    empty = F.expr("cast(array() as array<string>)")
    both = F.array_intersect(F.array_intersect(F.coalesce("_own", empty), F.coalesce("_s", empty)), F.coalesce("_o", empty))
    scoped = rows.where(F.col("experiment_id") != SHARED).join(scopes.select("paper", "experiment_id", F.col("clause_ids").alias("_scope")), ["paper", "experiment_id"], "left")
    found = [
        issue(cited.where("_t is null"), "unknown_clause", "owner"),
        issue(cited.where(~T.normalise(F.col("_t")).contains(T.normalise(F.col("quote")))), "non_verbatim_quote", "owner"),
        issue(entities.where((F.col("entity_type") == "lnp_component") & name.rlike(PAYLOAD)), "payload_as_component", "entity_id"),
        issue(entities.where((F.col("entity_type") == "disease") & F.lower(F.trim(name)).isin(*HEALTHY)), "physiology_as_disease", "entity_id"),
        issue(entities.where((F.col("entity_type") == "cell") & name.rlike(SEVERAL)), "merged_cell_entity", "entity_id"),
        issue(allowed, "predicate_type_violation", "claim_id"),
        issue(scoped.where(F.size(F.array_except(F.coalesce("_own", empty), F.coalesce("_scope", empty))) > 0), "evidence_outside_experiment_scope", "claim_id"),
        issue(rows.where(F.size(both) == 0), "relation_entities_not_co_supported", "claim_id"),
        issue(scopes.where(F.col("experiment_id") == SHARED), "reserved_shared_id_used_as_experiment", "experiment_id"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def appended(base: DataFrame, fragments: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(records, refused): fragments' records appended to the results that they were made for.

    base: paper, key, digest and further columns; fragments: the same columns, where ``digest`` is that of the result
    which the task was built from.  A paper's fragments are taken all or none: none if any was made for another result,
    or gives a key that the paper has or that they give twice.
    """
    now = base.groupBy("paper").agg(F.max(digest).alias("_now"))
    rows = fragments.join(now, "paper", "left")
    stale = rows.where(~F.col(digest).eqNullSafe(F.col("_now"))).select("paper", F.lit("stale_result").alias("reason"))
    taken = fragments.join(base.select("paper", key), ["paper", key], "left_semi").select("paper", F.lit("known_id").alias("reason"))
    twice = fragments.groupBy("paper", key).count().where("count > 1").select("paper", F.lit("repeated_id").alias("reason"))
    refused = stale.unionByName(taken).unionByName(twice).distinct()
    good = fragments.join(checked(refused.select("paper").distinct()), "paper", "left_anti")
    return base.unionByName(good.select(*base.columns)), refused


def hierarchy(hits: DataFrame, blocks: DataFrame, seeds: int = 3, reach: int = 1, most: int = 10, share: float = 0.18) -> DataFrame:
    """(query_id, block_id, score, place): hits, then neighbours of the first ``seeds``, up to ``most`` in all.

    hits: query_id, block_id, rank, score; blocks: block_id, paper, path, kind, section, page, ord.  A neighbour is at
    most ``reach`` places away in the same file: for pages (kind pdf or uniparse) at most a page away, else in the same
    section.  Nearer ones come first, the one before ahead of the one after; a block is listed once.
    """
    b = blocks.select("block_id", "paper", "path", "kind", "section", "page", "ord")
    seed = hits.where(F.col("rank") <= seeds).join(b, "block_id")
    steps = F.explode(F.array(*[F.struct(F.lit(2 * d + (s > 0)).alias("near"), F.lit(s * d).alias("step")) for d in range(1, reach + 1) for s in (-1, 1)]))
    spread = seed.select("query_id", F.col("rank").alias("of"), F.col("score").alias("_score"), "paper", "path", F.col("kind").alias("_kind"), F.col("section").alias("_section"), F.col("page").alias("_page"), "ord", steps.alias("x"))
    spread = spread.withColumn("ord", F.col("ord") + F.col("x.step"))
    near = spread.join(b, ["paper", "path", "ord"])
    paged = F.col("_kind").isin("pdf", "uniparse")
    fits: Column = F.when(paged, F.abs(F.col("page") - F.col("_page")) <= 1).otherwise(F.col("section").eqNullSafe(F.col("_section")))
    near = near.where(F.coalesce(fits, F.lit(False))).join(hits.select("query_id", "block_id"), ["query_id", "block_id"], "left_anti")
    first = near.groupBy("query_id", "block_id").agg(F.min(F.struct("of", "x.near", F.col("_score").alias("score"))).alias("m"))
    more = first.select("query_id", "block_id", (F.col("m.score") * share).alias("score"), F.struct(F.lit(1).alias("late"), F.col("m.of").alias("of"), F.col("m.near").alias("near")).alias("_at"))
    rows = hits.select("query_id", "block_id", "score", F.struct(F.lit(0).alias("late"), F.col("rank").cast(dict(hits.dtypes)["rank"]).alias("of"), F.lit(0).alias("near")).alias("_at")).unionByName(more)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "block_id"))
    rows = rows.withColumn("place", place.cast("long"))
    return rows.where((F.col("_at.late") == 0) | (F.col("place") <= most)).select("query_id", "block_id", F.round("score", 8).alias("score"), "place")
