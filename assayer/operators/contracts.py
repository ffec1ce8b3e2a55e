"""Contracts of extracted records: links, documents, vision responses, grounding, support, boundaries and tasks.

Every check gives rows (paper, code, record) of what is broken; a paper without any is valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import signals as S
from assayer.functions import text as T
from assayer.operators.relate import checked

FINDING = ("paper", "code", "record")


def _row(rows: DataFrame, code: str, record: Column | None = None) -> DataFrame:
    return rows.select(F.col("paper"), F.lit(code).alias("code"), (F.lit("") if record is None else record.cast("string")).alias("record"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def record_links(papers: DataFrame, formulations: DataFrame, components: DataFrame, experiments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Broken links of records: emptiness by eligibility, unique ids, and references that lead nowhere.

    papers (paper, decision), formulations (paper, formulation_id), components (paper, formulation_id), experiments
    (paper, experiment_id, formulation_id), outcomes (paper, experiment_id).  Records are counted per paper before they
    meet the papers.
    """
    tables = {"formulations": formulations, "components": components, "experiments": experiments, "outcomes": outcomes}
    counts = _all([rows.select("paper", F.lit(name).alias("kind")) for name, rows in tables.items()]).groupBy("paper").agg(
        *[F.count_if(F.col("kind") == name).alias(name) for name in tables]
    )
    rows = papers.join(counts, "paper", "left").fillna(0, list(tables))
    eligible, some = F.coalesce(F.col("decision") == "eligible", F.lit(False)), sum((F.col(n) for n in tables), F.lit(0)) > 0
    lacking = (F.col("formulations") == 0) | (F.col("experiments") == 0) | (F.col("outcomes") == 0)
    twice = lambda table, key: table.groupBy("paper", key).count().where("count > 1")
    lost = lambda child, key, parent, to: child.where(F.col(key).isNotNull()).join(parent.select("paper", F.col(to).alias(key)).distinct(), ["paper", key], "left_anti")
    return _all(
        [
            _row(rows.where(~eligible & some), "records_of_ineligible_paper"),
            _row(rows.where(eligible & lacking), "eligible_without_records"),
            _row(twice(formulations, "formulation_id"), "repeated_formulation_id", F.col("formulation_id")),
            _row(twice(experiments, "experiment_id"), "repeated_experiment_id", F.col("experiment_id")),
            _row(lost(components, "formulation_id", formulations, "formulation_id"), "component_of_unknown_formulation", F.col("formulation_id")),
            _row(lost(experiments, "formulation_id", formulations, "formulation_id"), "experiment_of_unknown_formulation", F.col("formulation_id")),
            _row(lost(outcomes, "experiment_id", experiments, "experiment_id"), "outcome_of_unknown_experiment", F.col("experiment_id")),
        ]
    )


def documents(papers: DataFrame, fields: DataFrame, evidence: DataFrame, links: DataFrame | None = None, slots: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Everything that is wrong with whole responses, as (paper, code, record, repairable).

    papers: paper, answered_as (the id that the response names) and evidence_ids of its eligibility; fields: paper,
    collection, place, field and evidence_ids of every reported field; evidence: paper, evidence_id that may be cited;
    links: findings of ``record_links``; slots: paper, candidate_id, evidence_ids that were sent; answers: paper,
    candidate_id, disposition that came back.  A finding is repairable if it names a collection, a place and a field.
    """
    known = evidence.select("paper", "evidence_id").distinct()
    cited = lambda rows, *keys: rows.select("paper", *keys, F.explode("evidence_ids").alias("evidence_id")).join(known, ["paper", "evidence_id"], "left_anti")
    place = F.concat_ws("/", "collection", "place", "field")
    parts = [
        _row(papers.where(~F.col("answered_as").eqNullSafe(F.col("paper").cast("string"))), "paper_id_mismatch"),
        _row(cited(papers).select("paper").distinct(), "unknown_evidence_id", F.lit("eligibility/evidence_ids")),
        _row(cited(fields, "collection", "place", "field").select("paper", "collection", "place", "field").distinct(), "unknown_evidence_id", place),
    ]
    parts += [links] if links is not None else []
    if slots is not None and answers is not None:
        sent, given = slots.select("paper", "candidate_id").distinct(), answers.select("paper", "candidate_id").distinct()
        used = fields.where("collection = 'outcomes'").select("paper", F.explode("evidence_ids").alias("e")).distinct()
        claimed = answers.where("disposition = 'extracted'").join(slots, ["paper", "candidate_id"]).where(F.size("evidence_ids") > 0)
        backed = claimed.select("paper", "candidate_id", F.explode("evidence_ids").alias("e")).join(used, ["paper", "e"], "left_semi").select("paper", "candidate_id").distinct()
        parts += [
            _row(sent.join(given, ["paper", "candidate_id"], "left_anti"), "missing_candidate_disposition", F.col("candidate_id")),
            _row(given.join(sent, ["paper", "candidate_id"], "left_anti"), "unknown_candidate_id", F.col("candidate_id")),
            _row(claimed.select("paper", "candidate_id").distinct().join(backed, ["paper", "candidate_id"], "left_anti"), "unsupported_extracted_disposition", F.col("candidate_id")),
        ]
    found = _all([p.select(*FINDING) for p in parts])
    fixable = (F.col("code") == "unknown_evidence_id") & (F.col("record") != "eligibility/evidence_ids")
    return found.withColumn("repairable", fixable).withColumn("finding_id", T.short_id("F-", F.col("paper").cast("string"), F.col("code"), F.col("record"), length=12))


def status(papers: DataFrame, findings: DataFrame) -> DataFrame:
    """(paper, findings, status): a paper is valid, whole, only without any finding."""
    n = findings.groupBy("paper").agg(F.count("*").alias("findings"))
    rows = papers.select("paper").distinct().join(n, "paper", "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("long"))
    return rows.withColumn("status", F.when(F.col("findings") == 0, "valid").otherwise("invalid"))


def vision_problems(strict: bool = True) -> list[tuple[str, Column]]:
    """(code, condition) of responses about images: what is only seen needs a person, what is resolved needs its place.

    Columns: value_status, disposition, requires_human_review, panel, fragment, derivation, printed_labels.  ``strict``
    also wants the printed labels of exact values.
    """
    c, none = F.col, lambda x: F.coalesce(F.trim(F.col(x)) == "", F.lit(True))
    yes = lambda x: F.coalesce(x, F.lit(False))
    labels = F.coalesce(c("printed_labels"), F.expr("cast(array() as array<string>)"))
    rules = [
        ("estimate_without_review", (c("value_status") == "visually_estimated") & ~(yes(c("disposition") == "human_review") & yes(c("requires_human_review")))),
        ("estimate_without_panel", (c("value_status") == "visually_estimated") & none("panel")),
        ("resolved_without_fragment", (c("disposition") == "resolved") & c("fragment").isNull()),
        ("resolved_status", (c("disposition") == "resolved") & ~yes(c("value_status").isin("exact_reported", "derived"))),
        ("resolved_without_panel", (c("disposition") == "resolved") & none("panel")),
        ("unresolved_with_fragment", c("disposition").isin("missing", "ambiguous") & c("fragment").isNotNull()),
        ("unresolved_status", c("disposition").isin("missing", "ambiguous") & ~yes(c("value_status") == "not_resolved")),
        ("derived_without_derivation", (c("value_status") == "derived") & none("derivation")),
        ("review_not_required", (c("disposition") == "human_review") & ~yes(c("requires_human_review"))),
    ]
    if strict:
        rules += [
            ("exact_without_labels", (c("value_status") == "exact_reported") & (F.size(labels) == 0)),
            ("blank_label", F.exists(labels, lambda x: F.trim(x) == "")),
        ]
    return [(code, yes(rule)) for code, rule in rules]


def vision_findings(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(paper, code, record): all rules in one pass; ``rows`` also has paper and record."""
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in vision_problems(strict)]))
    return rows.select("paper", F.explode(codes).alias("code"), F.col("record").cast("string").alias("record"))


def ground(mappings: DataFrame, evidence: DataFrame, fields: tuple[str, ...] = ("population", "state", "species"), needed: tuple[str, ...] = ("population", "state")) -> DataFrame:
    """(paper, mapping_id, name, fields, reason, dropped): entity mappings as far as the cited texts bear them out.

    A mapping goes if it cites nothing, cites an unknown id, or names what the cited text doesn't hold, word by word and
    as one string.  A field with a word that the text lacks becomes null and is listed in ``dropped``; without any of
    ``needed`` the mapping goes.  A word counts as held in the singular or the plural.
    """
    grammar = F.array(*map(F.lit, ("the", "a", "an", "of", "and", "or", "in", "from", "with", "to", "for", "by", "on", "at")))
    words = lambda x: F.array_except(F.filter(T.tokens(T.normalise(F.coalesce(x, F.lit("")))), lambda t: F.length(t) > 1), grammar)
    cites = mappings.select("paper", "mapping_id", F.posexplode(F.array_distinct("evidence_ids")).alias("i", "evidence_id"))
    texts = cites.join(evidence.select("paper", "evidence_id", F.col("text").alias("_t")), ["paper", "evidence_id"], "left")
    line = F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("_t", F.lit("")).alias("t")))), lambda x: x["t"])
    texts = texts.groupBy("paper", "mapping_id").agg(F.count("*").alias("_n"), F.count("_t").alias("_known"), T.normalise(F.array_join(line, " ")).alias("_source"))
    rows = mappings.join(texts, ["paper", "mapping_id"], "left")
    found = T.tokens(F.coalesce("_source", F.lit("")))
    plural, single = F.transform(found, lambda t: F.concat(t, F.lit("s"))), F.transform(F.filter(found, lambda t: t.endswith("s") & (F.length(t) > 2)), lambda t: F.left(t, F.length(t) - 1))
    rows = rows.withColumn("_hay", F.concat(found, plural, single))
    lacks = lambda x: F.size(F.array_except(words(x), "_hay")) > 0
    filled = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    named = ~lacks(F.col("name")) & F.col("_source").contains(T.normalise(F.col("name")))
    kept = {f: F.when(filled(F.col(f)) & ~lacks(F.col(f)), F.col(f)) for f in fields}
    dropped = F.array_compact(F.array(*[F.when(filled(F.col(f)) & lacks(F.col(f)), F.lit(f)) for f in fields]))
    reason = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "no_evidence_cited").when(F.col("_known") < F.col("_n"), "cited_evidence_id_not_in_packet")
        .when(~F.coalesce(named, F.lit(False)), "line_name_not_in_cited_evidence").when(F.coalesce(*[kept[f] for f in needed]).isNull(), "nothing_grounded_beyond_the_line_name").otherwise("kept")
    )
    out = rows.select("paper", "mapping_id", "name", *[k.alias(f) for f, k in kept.items()], reason.alias("reason"), F.array_join(dropped, ",").alias("dropped"))
    judged = F.col("reason").isin("kept", "nothing_grounded_beyond_the_line_name")
    return out.withColumns({f: F.when(F.col("reason") == "kept", F.col(f)) for f in fields}).withColumn("dropped", F.when(judged, F.col("dropped")).otherwise(""))


def supports(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(paper, claim_id, kind, checked, supported, missing): what a claim asserts, against the texts that it cites.

    claims: paper, claim_id, number, words, qualitative, evidence_ids.  A number must stand in the text; words must stand
    there as they are, or all their terms must; without either a qualitative statement's terms must.  Claims that assert
    nothing, or cite no known text, aren't checked.
    """
    cites = claims.select("paper", "claim_id", F.explode(F.array_sort(F.array_distinct("evidence_ids"))).alias("evidence_id"))
    source = cites.join(evidence.select("paper", "evidence_id", F.col("text").alias("_t")), ["paper", "evidence_id"])
    source = source.groupBy("paper", "claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "_t"))), lambda x: x["_t"]), " ").alias("source"))
    rows = claims.join(source, ["paper", "claim_id"], "left")
    full = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    kind = F.when(F.col("number").isNotNull(), "numeric").when(full(F.col("words")), "text").when(full(F.col("qualitative")), "qualitative").otherwise("none")
    rows = rows.withColumn("kind", kind).withColumn("checked", (F.col("kind") != "none") & F.col("source").isNotNull())
    claim = F.when(F.col("kind") == "text", F.col("words")).otherwise(F.col("qualitative"))
    bare = T.alphanumeric(claim)
    literal = (F.col("kind") == "text") & (bare != "") & T.alphanumeric(F.col("source")).contains(bare)
    lacking = F.array_sort(F.array_except(S.claim_terms(claim), S.claim_terms(F.col("source"))))
    missing = F.when(F.col("checked") & F.col("kind").isin("text", "qualitative") & ~F.coalesce(literal, F.lit(False)), lacking).otherwise(F.expr("cast(array() as array<string>)"))
    rows = rows.withColumn("missing", missing)
    right = F.when(F.col("kind") == "numeric", S.number_in(F.col("number"), F.col("source"))).otherwise(F.size("missing") == 0)
    return rows.select("paper", "claim_id", "kind", "checked", (F.col("checked") & F.coalesce(right, F.lit(False))).alias("supported"), F.array_join("missing", ",").alias("missing"))


def boundaries(maps: DataFrame, experiments: DataFrame) -> DataFrame:
    """Experiment maps against their lists: the presence flag must agree, and entries need sentences and a quote.

    maps: paper, reader, present; experiments: paper, reader, key, sentence_ids, quote.
    """
    n = experiments.groupBy("paper", "reader").agg(F.count("*").alias("n"))
    rows = maps.join(n, ["paper", "reader"], "left").withColumn("some", F.coalesce("n", F.lit(0)) > 0)
    empty = lambda c: F.coalesce(c, F.lit(True))
    known = maps.select("paper", "reader").distinct()
    return _all(
        [
            _row(rows.where(~F.col("present").eqNullSafe(F.col("some"))), "presence_differs_from_list", F.col("reader")),
            _row(maps.where(~F.coalesce(F.col("reader").isin("reader_a", "reader_b"), F.lit(False))), "unknown_reader", F.col("reader")),
            _row(experiments.where(empty(F.size("sentence_ids") <= 0)), "no_sentence", F.concat_ws("/", "reader", "key")),
            _row(experiments.where(empty(F.col("quote") == "")), "no_quote", F.concat_ws("/", "reader", "key")),
            _row(experiments.join(known, ["paper", "reader"], "left_anti"), "list_without_map", F.concat_ws("/", "reader", "key")),
        ]
    )


def missing_record_tasks(referrals: DataFrame, evidence: DataFrame, cited: int = 12, outcomes: int = 8) -> tuple[DataFrame, DataFrame]:
    """(tasks, refused): signed tasks of referrals all of whose evidence is known, and the others with what is unknown.

    referrals: paper, referral_id, candidate_ids, evidence_ids, result_sha256.  A task carries the first ``cited`` evidence
    texts and allows twice as many new outcomes as candidates, one at least and ``outcomes`` at most.
    """
    cites = referrals.select("paper", "referral_id", F.posexplode("evidence_ids").alias("i", "evidence_id"))
    rows = cites.join(evidence.select("paper", "evidence_id", F.col("text").alias("t"), F.lit(True).alias("known")), ["paper", "evidence_id"], "left")
    lost = rows.where("known is null").groupBy("paper", "referral_id").agg(T.joined_set(F.collect_set("evidence_id")).alias("unknown"))
    held = rows.where(F.col("i") < cited).groupBy("paper", "referral_id").agg(F.array_sort(F.collect_list(F.struct("i", "evidence_id", "t"))).alias("x"))
    held = held.select("paper", "referral_id", F.transform("x", lambda e: F.struct(e["evidence_id"].alias("evidence_id"), e["t"].alias("text"))).alias("evidence"))
    good = referrals.join(checked(lost.select("paper", "referral_id")), ["paper", "referral_id"], "left_anti").join(held, ["paper", "referral_id"], "left")
    permitted = F.least(F.lit(outcomes), F.greatest(F.lit(1), F.size("candidate_ids") * 2))
    tasks = good.select("paper", "referral_id", "candidate_ids", "evidence", permitted.alias("permitted_new_outcomes"), F.lit(1).alias("permitted_new_experiments"), "result_sha256")
    return tasks.withColumn("task_checksum", F.sha2(T.canonical_json(*tasks.columns), 256)), lost


def find_field(bundle: Column, collections: tuple[str, ...], entity: Column, field: str) -> tuple[Column, Column]:
    """(value, quote) of a field of the record that has the entity among its ids, in the first collection that has both.

    ``bundle`` is JSON: collections of records whose ids end with ``_id``; a field is a plain value, or an object with
    ``value`` and ``evidence_quote``.
    """
    records = F.concat(*[F.coalesce(F.from_json(F.get_json_object(bundle, f"$.{c}"), "array<map<string,string>>"), F.expr("cast(array() as array<map<string,string>>)")) for c in collections])
    holds = lambda r: F.exists(F.map_entries(r), lambda e: e["key"].endswith("_id") & (e["value"] == entity)) & F.map_contains_key(r, field)
    found = F.try_element_at(F.get(F.filter(records, holds), 0), F.lit(field))
    nested = found.startswith("{")
    return F.when(nested, F.get_json_object(found, "$.value")).otherwise(found), F.when(nested, F.get_json_object(found, "$.evidence_quote"))


def negative_control(left: Column, right: Column) -> Column:
    """Both sides are empty."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return empty(left) & empty(right)


def full_text_status(pmcid: Column) -> Column:
    return F.when(F.coalesce(pmcid != "", F.lit(False)), "potentially_available").otherwise("unknown")


def publication_year(article: Column, issue: Column, completed: Column, revised: Column, medline: Column) -> Column:
    """The first year that is given, else the first token of four digits of a free date."""
    given = [F.when(c != "", F.trim(c)) for c in (article, issue, completed, revised)]
    free = F.nullif(F.regexp_extract(medline, r"(?:^|\s)([0-9]{4})(?=\s|$)", 1), F.lit(""))
    return F.coalesce(*given, free)


def cards(rows: DataFrame, key: str, validated: str, corrected: str) -> DataFrame:
    """(key, origin, card): an HTML card of each result; the corrected one is shown where there is one."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shown = F.coalesce(corrected, validated, F.lit(""))
    origin = F.when(F.col(corrected).isNotNull(), "corrected").when(F.col(validated).isNotNull(), "validated").otherwise("none")
    card = F.concat(F.lit('<article class="'), origin, F.lit('"><h2>'), safe(F.col(key).cast("string")), F.lit("</h2><p>"), safe(shown), F.lit("</p></article>"))
    return rows.select(key, origin.alias("origin"), card.alias("card"))


# Reason codes of eligibility decisions.
POSITIVE = ("ORIGINAL_EXPERIMENT", "IDENTIFIABLE_LNP", "SUPPORTED_PAYLOAD", "TARGET_CELL_EVIDENCE", "USABLE_FORMULATION_OUTCOME_LINKAGE")
EXCLUSIONS = (
    "NOT_ORIGINAL_RESEARCH", "NOT_ELIGIBLE_LNP", "UNSUPPORTED_PAYLOAD", "NO_TARGET_CELL_EVIDENCE", "NO_FORMULATION_OUTCOME_LINKAGE", "DUPLICATE_SCIENTIFIC_REPORT", "RETRACTED_OR_INVALID",
)
OPEN_QUESTIONS = (
    "FULL_TEXT_REQUIRED", "PUBLICATION_TYPE_AMBIGUOUS", "LNP_IDENTITY_AMBIGUOUS", "PAYLOAD_AMBIGUOUS", "TARGET_CELL_AMBIGUOUS", "FORMULATION_INCOMPLETE", "OUTCOME_LINKAGE_AMBIGUOUS",
    "CHEMISTRY_AMBIGUOUS",
)


def eligibility_findings(rows: DataFrame) -> DataFrame:
    """(paper, code, record): decisions whose reasons or evidence don't bear them out.

    rows: paper, decision, reason_codes, evidence_ids, explanation.
    """
    c = F.col
    empty = F.expr("cast(array() as array<string>)")
    why, cited = F.coalesce(c("reason_codes"), empty), F.coalesce(c("evidence_ids"), empty)
    listed = lambda names: F.array(*map(F.lit, names))
    rules = {
        "no_reason": F.size(why) == 0,
        "repeated_reason": F.size(F.array_distinct(why)) < F.size(why),
        "unknown_reason": F.size(F.array_except(why, listed((*POSITIVE, *EXCLUSIONS, *OPEN_QUESTIONS)))) > 0,
        "unknown_decision": ~F.coalesce(c("decision").isin("eligible", "ineligible", "uncertain"), F.lit(False)),
        "eligible_without_all_reasons": (c("decision") == "eligible") & (F.size(F.array_except(listed(POSITIVE), why)) > 0),
        "ineligible_without_exclusion": (c("decision") == "ineligible") & ~F.arrays_overlap(why, listed(EXCLUSIONS)),
        "uncertain_without_question": (c("decision") == "uncertain") & ~F.arrays_overlap(why, listed(OPEN_QUESTIONS)),
        "decided_without_evidence": c("decision").isin("eligible", "ineligible") & (F.size(cited) == 0),
        "explanation_length": ~F.coalesce(F.length("explanation").between(1, 500), F.lit(False)),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return rows.select("paper", F.explode(codes).alias("code"), F.coalesce("decision", F.lit("")).alias("record"))


def evidence_gate(hits: DataFrame, queries: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, passed, needs_review, reasons) of retrieved hits.

    queries: query_id, paper, field_group, required; hits: query_id, block_id, paper, text, entity_types.  Too few hits,
    hits of another paper, required types that none has, formulation questions without formulation types, and repeated
    blocks keep a query from passing; mixed polarity only asks for review.
    """
    empty = F.expr("cast(array() as array<string>)")
    rows = hits.join(queries.select("query_id", F.col("paper").alias("_p")), "query_id").groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_distinct("block_id").alias("d"), F.bool_or(~F.col("paper").eqNullSafe(F.col("_p"))).alias("leak"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("entity_types", empty)))).alias("types"), F.count_distinct(F.col("text").rlike(S.bounded(S.NEGATION))).alias("signs"),
    )
    rows = queries.join(rows, "query_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "types": F.coalesce("types", empty), "required": F.coalesce("required", empty)})
    lacking = F.size(F.array_except("required", "types")) > 0
    unsure = (F.col("field_group") == "formulation") & ~F.arrays_overlap("types", F.array(*map(F.lit, S.FORMULATION_TYPES)))
    bad = [(F.col("n") < least, "few_hits"), (F.col("leak"), "other_paper"), (lacking, "types"), (unsure, "formulation_signal"), (F.col("d") < F.col("n"), "duplicates")]
    reasons = F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), name) for c, name in bad])
    return rows.select("query_id", (reasons == "").alias("passed"), F.coalesce(F.col("signs") > 1, F.lit(False)).alias("needs_review"), reasons.alias("reasons"))


def caption_candidate(text: Column) -> Column:
    """A block that begins with a figure or table label is its caption if a point follows the label, or if it is long
    and names no other figure or table near its start; null if it begins with no label."""
    label = r"(?i)^\s*(?:fig(?:ure)?|table)\s*\.?\s*[A-Za-z0-9][A-Za-z0-9.-]*"
    head = F.regexp_extract(text, label, 0)
    rest = F.ltrim(F.substr(text, F.length(head) + 1))
    another = F.substring(rest, 1, 90).rlike(r"(?i)\b(?:fig(?:ure)?|table)\s*\.?\s*[A-Za-z0-9]")
    found = head.endswith(".") | rest.startswith(".") | ((F.length(text) >= 120) & ~another)
    return F.when(head != "", found)


def main_article(files: DataFrame) -> DataFrame:
    """(paper, file): the file of fewest pages that isn't named like a supplement, or of all if every file is.

    files: paper, file, pages; ties go to the smaller name.
    """
    supplement = F.lower("file").rlike("supp|sapp|mmc|moesm|esm")
    best = F.min(F.struct(supplement.alias("s"), "pages", "file"))
    return files.groupBy("paper").agg(best["file"].alias("file"))


def safe_member(name: Column) -> Column:
    """Whether an archive's member stays inside the folder it is unpacked to."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce((F.trim(name) != "") & ~name.rlike(r"^(?:[/\\]|[A-Za-z]:)") & ~F.array_contains(parts, ".."), F.lit(False))
