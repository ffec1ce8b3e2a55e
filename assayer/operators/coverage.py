"""Coverage of candidate outcomes by extracted ones, inventories, and recall against gold rows.

Tables: candidates (paper, candidate_id, ord, family, evidence_ids, source_ids, text, figure, confidence, route_hint),
outcomes (paper, outcome_id, ord, text, evidence_ids, value, value_text), sources (paper, source_id, section, block_type).
``ord`` is a row's place in its paper.  Nulls in arrays and texts count as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import signals as S
from assayer.functions import text as T
from assayer.operators import match
from assayer.operators.relate import checked

EMPTY = "cast(array() as array<string>)"


def _ids(column: str) -> Column:
    return F.coalesce(F.col(column), F.expr(EMPTY))


def structured(evidence: DataFrame, sources: DataFrame, blocks: tuple[str, ...] = S.STRUCTURED_BLOCKS) -> DataFrame:
    """Adds ``structured``: some cited source is a block of these types."""
    wanted = sources.where(F.col("block_type").isin(*blocks)).select("paper", "source_id").distinct()
    hit = evidence.select("paper", "evidence_id", F.explode("source_ids").alias("source_id")).join(wanted, ["paper", "source_id"], "left_semi")
    hit = hit.select("paper", "evidence_id").distinct().withColumn("_hit", F.lit(True))
    return evidence.join(hit, ["paper", "evidence_id"], "left").withColumn("structured", F.coalesce("_hit", F.lit(False))).drop("_hit")


def scores(candidates: DataFrame, outcomes: DataFrame, families: dict[str, str]) -> DataFrame:
    """(paper, candidate_id, c_ord, outcome_id, o_ord, score) of pairs of one paper and family; all others score 0.

    ``families``: patterns that tell which families an outcome's text is about.  Shared evidence scores 1 unless the
    candidate's numbers rule the outcome's value out; else the share of the outcome's tokens, and a bonus for its value.
    Pairs meet on (paper, family), so a paper's pairs of different families are never made.
    """
    about = F.array_compact(F.array(*[F.when(S.has(F.col("text"), p), F.lit(n)) for n, p in families.items()]))
    o = outcomes.select(
        "paper", "outcome_id", F.col("ord").alias("o_ord"), F.explode(about).alias("family"), _ids("evidence_ids").alias("o_evidence"), "value", "value_text", T.tokens(F.col("text")).alias("o")
    )
    c = candidates.select("paper", "candidate_id", F.col("ord").alias("c_ord"), "family", _ids("evidence_ids").alias("c_evidence"), "text", T.tokens(F.col("text")).alias("c"), T.numbers(F.col("text")).alias("numbers"))
    pairs = c.join(o, ["paper", "family"])
    shared = F.coalesce(F.arrays_overlap("c_evidence", "o_evidence"), F.lit(False))
    ruled_out = F.col("value").isNotNull() & (F.size("numbers") > 0) & ~F.exists("numbers", lambda n: F.abs(n - F.col("value")) <= 1e-9)
    lexical = F.size(F.array_intersect("c", "o")) / F.greatest(F.lit(1), F.size("o"))
    bonus = F.when(F.coalesce(F.col("value").isNotNull() & F.col("text").contains(F.col("value_text")), F.lit(False)), 0.35).otherwise(0.0)
    score = F.when(shared, F.when(ruled_out, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), lexical + bonus))
    return pairs.select("paper", "candidate_id", "c_ord", "outcome_id", "o_ord", score.alias("score"))


def matches(scored: DataFrame, least: float = 0.30) -> DataFrame:
    """(paper, candidate_id, outcome_id, score): greedy one-to-one matches by score, ties by candidate, then outcome order."""
    taken = match.greedy(scored, "paper", "c_ord", "o_ord", "score", least)
    names = scored.select("paper", "c_ord", "o_ord", "candidate_id", "outcome_id").distinct()
    return taken.join(names, ["paper", "c_ord", "o_ord"]).select("paper", "candidate_id", "outcome_id", F.round("score", 4).alias("score"))


def residue(candidates: DataFrame, matched: DataFrame, outcomes: DataFrame, allowed: tuple[str, ...] = ("high",), partial: bool = True) -> DataFrame:
    """(paper, candidate_id, target, reason) of candidates that the matches leave open.

    ``partial``: a matched candidate with evidence that no outcome cites is still open.  Open candidates of an allowed
    confidence go to ``repair``, unless an earlier one of their family that does shares evidence with them; these, and
    those of lower confidence, go to ``review``.
    """
    rows = candidates.select("paper", "candidate_id", "ord", "family", _ids("evidence_ids").alias("evidence_ids"), "confidence")
    done = matched.select("paper", "candidate_id").distinct().withColumn("_done", F.lit(True))
    cited = outcomes.select("paper", F.explode("evidence_ids").alias("e")).distinct()
    uncited = rows.select("paper", "candidate_id", F.explode("evidence_ids").alias("e")).join(cited, ["paper", "e"], "left_anti").select("paper", "candidate_id").distinct()
    rows = rows.join(done, ["paper", "candidate_id"], "left").join(uncited.withColumn("_uncited", F.lit(True)), ["paper", "candidate_id"], "left")
    rows = rows.withColumn("partly", F.lit(partial) & F.coalesce(F.col("_done") & F.col("_uncited"), F.lit(False)))
    rows = rows.where(F.col("_done").isNull() | F.col("partly")).drop("_done", "_uncited")
    sure = F.coalesce(F.col("confidence").isin(*allowed), F.lit(False))
    weak = rows.where(~sure).select("paper", "candidate_id", F.lit("review").alias("target"), F.when(F.col("partly"), "partially_covered_group_below_repair_threshold").otherwise("confidence_below_repair_threshold").alias("reason"))
    kinds = dict(rows.dtypes)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        held: set[str] = set()
        out = []
        for row in part.sort_values("ord").itertuples(index=False):
            again = not held.isdisjoint(row.evidence_ids)
            held |= set() if again else set(row.evidence_ids)
            out.append((row.paper, row.candidate_id, "review" if again else "repair", "duplicate_or_overlapping_high_confidence_group" if again else "unmatched"))
        return pd.DataFrame(out, columns=["paper", "candidate_id", "target", "reason"])

    strong = rows.where(sure).groupBy("paper", "family").applyInPandas(walk, f"paper {kinds['paper']}, candidate_id {kinds['candidate_id']}, target string, reason string")
    return strong.unionByName(weak)


def consolidate(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(paper, candidate_id, decision, canonical): formulas, methods and background are rejected, near duplicates merged
    into the first retained candidate they are similar to, which takes over their evidence and sources.

    Similar: one family, no two different figures, and shared evidence, or nearly all of the smaller text's tokens
    (0.92), or a shared source and most of them (0.72).  Rejections are looked at row by row; only what remains is
    walked, one paper and family at a time, since families never merge.
    """
    place = candidates.select("paper", "candidate_id", F.explode("source_ids").alias("source_id")).join(sources.select("paper", "source_id", "section"), ["paper", "source_id"])
    place = place.groupBy("paper", "candidate_id").agg(F.array_join(F.array_sort(F.collect_set("section")), " ").alias("sections"))
    rows = candidates.join(place, ["paper", "candidate_id"], "left").withColumn("sections", F.coalesce("sections", F.lit("")))
    text = F.coalesce(F.col("text"), F.lit(""))
    why = (
        F.when(S.has(text, S.FORMULA_ONLY) & ~S.has(text, S.FORMULA_RESCUE), "rejected_formula")
        .when(S.has(F.col("sections"), S.METHOD_SECTION) & ~S.has(text, S.BIOLOGICAL_RESULT), "rejected_method")
        .when(S.has(F.col("sections"), S.BACKGROUND_ONLY), "rejected_background")
    )
    rows = rows.withColumn("why", why)
    rejected = rows.where("why is not null").select("paper", "candidate_id", F.col("why").alias("decision"), F.lit(None).cast("string").alias("canonical"))
    rest = rows.where("why is null").select(
        "paper", "candidate_id", "ord", F.coalesce("family", F.lit("")).alias("family"), F.lower(F.coalesce("figure", F.lit(""))).alias("figure"), _ids("evidence_ids").alias("evidence_ids"),
        _ids("source_ids").alias("source_ids"), T.tokens(text).alias("tokens"), "confidence",
    )

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        out = []
        for row in part.sort_values("ord").itertuples(index=False):
            evidence, origin, words = set(row.evidence_ids), set(row.source_ids), set(row.tokens)
            for name, figure, held, origins, terms in kept:
                if figure and row.figure and figure != row.figure:
                    continue
                share = len(words & terms) / max(1, min(len(words), len(terms)))
                if evidence & held or share >= 0.92 or (share >= 0.72 and origin & origins):
                    held |= evidence
                    origins |= origin
                    out.append((row.paper, row.candidate_id, "merged_duplicate", str(name)))
                    break
            else:
                kept.append((row.candidate_id, row.figure, evidence, origin, words))
                out.append((row.paper, row.candidate_id, "retained_unique" if row.confidence == "high" else "needs_human_review", str(row.candidate_id)))
        return pd.DataFrame(out, columns=["paper", "candidate_id", "decision", "canonical"])

    kinds = dict(candidates.dtypes)
    walked = rest.groupBy("paper", "family").applyInPandas(walk, f"paper {kinds['paper']}, candidate_id {kinds['candidate_id']}, decision string, canonical string")
    return walked.unionByName(rejected)


def same_location(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(paper, gold_id, found_id): rows at one place.

    Both sides: paper, an id, path, page, element.  They agree on the element, or on the file and the page (a gold row
    without page and element agrees with the whole file).  Files agree by path, by name, or, for XML, by their PMC id.
    Every way is an equi-join within the paper; the union's repeats go.
    """
    name = lambda c: F.nullif(F.element_at(F.split(c, "/"), -1), F.lit(""))
    pmc = lambda c: F.when(F.lower(c).rlike(r"\.n?xml$"), F.nullif(F.regexp_extract(c, r"(PMC\d+)", 1), F.lit("")))
    files = lambda rows: F.array_distinct(F.array_compact(F.array(F.concat(F.lit("p:"), "path"), F.concat(F.lit("n:"), name(F.col("path"))), F.concat(F.lit("x:"), pmc(F.col("path"))))))
    g = gold.select("paper", "gold_id", "page", "element", files(gold).alias("files"))
    f = found.select("paper", "found_id", F.col("page").alias("f_page"), F.col("element").alias("f_element"), files(found).alias("f_files"))
    keys = ["paper", "gold_id", "found_id"]
    by_element = g.join(f, (g["paper"] == f["paper"]) & (F.col("element") == F.col("f_element"))).select(g["paper"], "gold_id", "found_id")
    g_files, f_files = g.withColumn("file", F.explode("files")), f.withColumn("file", F.explode("f_files"))
    by_page = g_files.join(f_files, (g_files["paper"] == f_files["paper"]) & (g_files["file"] == f_files["file"]) & (F.col("page") == F.col("f_page"))).select(g_files["paper"], "gold_id", "found_id")
    whole = g_files.where("page is null and element is null")
    by_file = whole.join(f_files, ["paper", "file"]).select(*keys)
    return by_element.unionByName(by_page).unionByName(by_file).distinct()


def inventory_recall(gold: DataFrame, candidates: DataFrame, located: DataFrame) -> DataFrame:
    """(paper, gold_id, recalled, candidates): gold rows that an inventory holds.

    A candidate recalls a gold row at its place (``located``: paper, gold_id, candidate_id) if they share two tokens, or
    anywhere in the paper if they share four and all tokens of the gold value (``value_text``).  The latter meet on a
    token of the value, so no paper's pairs are all made.
    """
    g = gold.select("paper", "gold_id", T.tokens(F.col("text")).alias("g"), T.tokens(F.coalesce(F.col("value_text"), F.lit(""))).alias("v"))
    c = candidates.select("paper", "candidate_id", T.tokens(F.col("text")).alias("c"))
    near = located.join(g, ["paper", "gold_id"]).join(c, ["paper", "candidate_id"])
    near = near.where(F.size(F.array_intersect("g", "c")) >= 2).select("paper", "gold_id", "candidate_id")
    key = F.array_max(F.transform("v", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    # Tokens meet alone: a row for each token that carried the whole list would grow with the square of the text.
    told = g.where(F.size("v") > 0).select("paper", "gold_id", key.alias("t")).distinct()
    met = told.join(c.select("paper", "candidate_id", F.explode("c").alias("t")), ["paper", "t"]).select("paper", "gold_id", "candidate_id").distinct()
    far = met.join(g, ["paper", "gold_id"]).join(c, ["paper", "candidate_id"])
    far = far.where((F.size(F.array_intersect("g", "c")) >= 4) & (F.size(F.array_except("v", F.array_intersect("g", "c"))) == 0)).select("paper", "gold_id", "candidate_id")
    hits = near.unionByName(far).distinct().groupBy("paper", "gold_id").agg(F.count("*").alias("candidates"))
    rows = gold.select("paper", "gold_id").join(hits, ["paper", "gold_id"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("long"))
    return rows.select("paper", "gold_id", (F.col("candidates") > 0).alias("recalled"), "candidates")


def numeric_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(paper, gold_id, recalled): the paper's numbers hold the gold value, but for 1e-9.

    Values meet in cells of 1e-8 and their neighbours.
    """
    cell = F.floor(F.col("value") * 1e8)
    spread = found.select("paper", F.col("value").alias("v"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
    hits = gold.withColumn("cell", cell).join(spread, ["paper", "cell"]).where("abs(value - v) <= 1e-9").select("paper", "gold_id").distinct().withColumn("_hit", F.lit(True))
    return gold.select("paper", "gold_id").join(hits, ["paper", "gold_id"], "left").select("paper", "gold_id", F.coalesce("_hit", F.lit(False)).alias("recalled"))


def evaluation(recalled: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper, gold, recalled, recall, eligibility_match, needs_review, reasons), one row per paper and one overall.

    ``papers``: paper, expected, actual, unresolved, current.  Papers that expect ``manual_review`` have no match.
    """
    counts = recalled.groupBy("paper").agg(F.count("*").alias("gold"), F.count_if(F.col("recalled")).alias("recalled"))
    manual = F.col("expected") == "manual_review"
    rows = papers.withColumns(
        {"match": F.when(~manual, F.col("actual") == F.col("expected")), "review": (F.col("unresolved") > 0) | ~F.col("current") | manual}
    ).join(counts, "paper", "left")
    total = F.sum(F.coalesce("gold", F.lit(0)))
    hit = F.sum(F.coalesce("recalled", F.lit(0)))
    out = rows.rollup("paper").agg(
        F.grouping("paper").alias("all"), total.cast("long").alias("gold"), hit.cast("long").alias("recalled"), F.round(hit / F.greatest(F.lit(1), total), 4).alias("recall"),
        F.count_if(F.col("match")).alias("eligibility_match"), F.count_if("review").alias("needs_review"),
    )
    reasons = F.concat_ws(",", F.when(F.col("recalled") < F.col("gold"), "numeric_recall"), F.when(F.col("needs_review") > 0, "human_review"))
    return out.select(F.when(F.col("all") == 1, "all").otherwise(F.col("paper").cast("string")).alias("paper"), "gold", "recalled", "recall", "eligibility_match", "needs_review", reasons.alias("reasons"))


def routes(findings: DataFrame, unmatched: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(paper, route_id, source, source_id, route) of everything that is still to be done for a paper.

    ``findings``: paper, finding_id, code, message, repairable; ``unmatched``: paper, candidate_id, target, route_hint;
    ``dispositions``: paper, candidate_id, decision.  An inventory's doubt is routed only where coverage has no route.
    """
    f = findings.select("paper", F.lit("ordinary_validation").alias("source"), F.col("finding_id").alias("source_id"),
                        F.when(~F.col("repairable"), "first_call_required").when(S.has(F.concat_ws(" ", "code", "message"), S.VISUAL), "selective_vision").otherwise("narrow_field_repair").alias("route"))
    text = F.when(F.col("target") == "review", "human_review").when(F.col("route_hint") == "vision", "selective_vision").otherwise("missing_record_text")
    c = unmatched.select("paper", F.lit("outcome_coverage").alias("source"), F.col("candidate_id").cast("string").alias("source_id"), text.alias("route"))
    d = dispositions.where("decision = 'needs_human_review'").select("paper", F.lit("inventory").alias("source"), F.col("candidate_id").cast("string").alias("source_id"), F.lit("human_review").alias("route"))
    d = d.join(c.select("paper", "source_id"), ["paper", "source_id"], "left_anti")
    rows = f.unionByName(c).unionByName(d)
    return rows.withColumn("route_id", T.short_id("RT-", F.col("paper").cast("string"), F.col("source"), F.col("source_id"), length=12))


def decisions(papers: DataFrame, routed: DataFrame) -> DataFrame:
    """(paper, routes, finalization_allowed, blockers): ``papers`` has paper, valid, complex and covered."""
    found = routed.groupBy("paper").agg(F.count("*").alias("routes"), F.bool_or(F.col("route") == "human_review").alias("human"), F.bool_or(F.col("route") != "human_review").alias("pending"))
    rows = papers.join(checked(found), "paper", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    blockers = F.concat_ws(
        ",", F.when(~yes(F.col("valid")), "ordinary_validation_invalid"), F.when(yes(F.col("complex")) & ~yes(F.col("covered")), "complex_outcome_coverage_incomplete"),
        F.when(yes(F.col("human")), "candidate_adjudication_incomplete"), F.when(yes(F.col("pending")), "repair_or_vision_routes_pending"),
    )
    return rows.select("paper", F.coalesce("routes", F.lit(0)).cast("long").alias("routes"), (blockers == "").alias("finalization_allowed"), blockers.alias("blockers"))
