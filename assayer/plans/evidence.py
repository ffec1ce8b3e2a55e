"""Evidence queries: coverage, contracts, merges and similarity over evidence tables made from whole conversations,
orders and events.

A conversation is a paper and its turns are passages; what the model needs beyond their text (families, declared
values, broken references) is set by running numbers, so that every rule meets rows that keep it and rows that break it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import signals as S
from assayer.functions import text as T
from assayer.functions import atoms
from assayer.operators import candidates as found_by
from assayer.operators import contracts, coverage, dedup, graph, match, merge, pack, relate, similarity
from assayer.registry import query
from assayer.sources import corpus, sinks
from assayer.sources.tables import read

BLOCKS = ("paragraph", "table_row", "figure_caption", "table")
SAID = (" Uptake increased to 12.5 % of cells.", " It was not observed.", " See Table S2 for 7-fold editing.", " The formulation was prepared by protocol.", "")
P = f"""p AS (SELECT conv_id AS paper, conv_id || '-' || turn AS evidence_id, turn AS pos, turn // 2 AS page, ['{"', '".join(BLOCKS)}'][(turn % 4 + 1)::INT] AS block_type,
  CASE WHEN role = 'user' THEN 'Methods' ELSE 'Results' END AS section, role, text || ['{"', '".join(SAID)}'][(turn % 5 + 1)::INT] AS text FROM conversations)"""
CELLS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _pick(choices: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, choices)), n.cast("int"))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """(paper, evidence_id, pos, page, block_type, section, role, text)."""
    turn = F.col("turn")
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("paper"), F.concat_ws("-", "conv_id", "turn").alias("evidence_id"), turn.alias("pos"), F.floor(turn / 2).alias("page"), _pick(BLOCKS, turn % 4).alias("block_type"),
        F.when(F.col("role") == "user", "Methods").otherwise("Results").alias("section"), "role", F.concat("text", _pick(SAID, turn % 5)).alias("text"),
    )


def _id(step: int) -> Column:
    return F.concat_ws("-", "paper", (F.col("pos") + step).cast("string"))


@query(
    f"""WITH {P}, x AS (SELECT *, regexp_matches(text, '{S.CORPUS_OUTCOME}') AND (regexp_matches(section, '{S.RESULT_SECTION}') OR block_type IN {S.RESULT_BLOCKS}) AS tagged,
  regexp_matches(text, '{S.DIRECT_EVIDENCE}') AS direct, regexp_matches(text, '{S.QUANTITATIVE_OUTCOME}') AND (pos % 3 = 0 OR regexp_matches(text, '{S.BIOLOGICAL_OUTCOME}')) AS quant,
  block_type IN {S.STRUCTURED_BLOCKS} AS own, EXISTS (SELECT 1 FROM p s WHERE s.paper = p.paper AND (s.pos = p.pos OR (p.pos % 2 = 1 AND s.pos = p.pos - 1)) AND s.block_type IN {S.STRUCTURED_BLOCKS}) AS structured FROM p)
SELECT paper, evidence_id, CASE WHEN tagged THEN 'outcomes' ELSE 'full_corpus' END AS tag, structured, (30 * tagged::INT + 5 * (pos % 4 = 0)::INT)::BIGINT AS rank,
  (60 * direct::INT + 120 * quant::INT + 30 * (pos % 4 = 0)::INT + 20 * (pos % 3 = 0)::INT + 15 * own::INT + 10)::BIGINT AS priority,
  concat_ws(',', CASE WHEN direct THEN 'direct_scientific_signal' END, CASE WHEN quant THEN 'direct_quantitative_outcome' END, CASE WHEN pos % 4 = 0 THEN 'experiment_anchor' END,
    CASE WHEN pos % 3 = 0 THEN 'priority_retrieval_group' END, CASE WHEN own THEN 'structured_or_caption_evidence' END, 'methods_or_results') AS reasons FROM x"""
)
def evidence_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus tags, structured sources, retrieval ranks and evidence priorities."""
    rows = passages(spark, sf)
    sources = rows.select("paper", F.col("evidence_id").alias("source_id"), "block_type")
    cites = F.when(F.col("pos") % 2 == 1, F.array("evidence_id", _id(-1))).otherwise(F.array("evidence_id"))
    rows = coverage.structured(rows.withColumn("source_ids", cites), sources)
    tag = S.outcome_tag(F.col("text"), F.col("section"), F.col("block_type"))
    anchors = F.when(F.col("pos") % 4 == 0, F.array("evidence_id")).otherwise(_none())
    groups = F.when(F.col("pos") % 3 == 0, F.array(F.lit("outcome"))).otherwise(F.array(F.lit("other")))
    score, reasons = S.priority(F.col("text"), F.col("section"), groups, anchors, F.array("block_type"))
    return rows.select("paper", "evidence_id", tag.alias("tag"), "structured", S.retrieval_rank(F.array(tag), anchors).alias("rank"), score.alias("priority"), F.array_join(reasons, ",").alias("reasons"))


@query(
    f"""WITH {P}, r AS (SELECT paper, pos, ceil(strlen('{{"evidence_id":"' || evidence_id || '","text":' || to_json(text)::VARCHAR || '}}') / 4.0)::BIGINT AS cost, block_type = 'table' AS always, pos % 3 AS rank FROM p),
w AS (SELECT paper, coalesce(sum(cost) FILTER (always), 0)::BIGINT AS base, coalesce(list(struct_pack(used := cost, got := [pos]) ORDER BY rank DESC, pos) FILTER (NOT always), []) AS items FROM r GROUP BY paper),
f AS (SELECT paper, list_reduce(list_prepend(struct_pack(used := base, got := []::BIGINT[]), items), lambda a, x: CASE WHEN a.used + x.used <= 500 THEN struct_pack(used := a.used + x.used, got := list_concat(a.got, x.got)) ELSE a END) AS s FROM w)
SELECT r.paper, r.pos, r.cost FROM r LEFT JOIN (SELECT paper, unnest(s.got) AS pos, true AS taken FROM f) g USING (paper, pos) WHERE always OR taken"""
)
def structured_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Packing that keeps all structured rows and fills the rest of the budget by rank; costs are those of the rows' JSON."""
    rows = passages(spark, sf).withColumn("cost", T.token_estimate(T.canonical_json("evidence_id", "text")))
    rows = rows.select("paper", "pos", "cost", (F.col("block_type") == "table").alias("always"), (F.col("pos") % 3).alias("rank"))
    return pack.greedy_budget(rows, "paper", "pos", "rank", "cost", 500, always="always")


@query(
    f"""WITH {P}, c AS (SELECT paper, pos, ceil(strlen(text) / 4.0)::BIGINT AS cost, length(text) AS size FROM p), s AS (SELECT paper, pos, 20 + pos % 3 AS price FROM p),
i AS (SELECT c.paper, c.pos, list_filter([struct_pack(k := 'E' || c.pos, v := c.cost), CASE WHEN b.pos IS NOT NULL THEN struct_pack(k := 'E' || b.pos, v := b.cost) END, struct_pack(k := 'S' || (c.pos // 3), v := 25::BIGINT)], lambda x: x IS NOT NULL) AS parts, c.size
  FROM c LEFT JOIN c b ON b.paper = c.paper AND b.pos = c.pos - 1),
w AS (SELECT paper, list(struct_pack(used := 0::BIGINT, got := [pos], paid := parts) ORDER BY size DESC, pos) AS items FROM i GROUP BY paper),
f AS (SELECT paper, list_reduce(list_prepend(struct_pack(used := 30::BIGINT, got := []::BIGINT[], paid := []::STRUCT(k VARCHAR, v BIGINT)[]), items), lambda a, x:
  CASE WHEN len(list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k))) > 0
        AND a.used + list_sum(list_transform(list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k)), lambda y: y.v)) <= 450
    THEN struct_pack(used := (a.used + list_sum(list_transform(list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k)), lambda y: y.v)))::BIGINT, got := list_concat(a.got, x.got), paid := list_concat(a.paid, list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k))))
    ELSE a END) AS s FROM w)
SELECT paper, unnest(s.got) AS pos FROM f"""
)
def payload_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Packing whose costs are those of the payload: a row brings its context row and a source, each paid once."""
    rows = passages(spark, sf).select("paper", "pos", T.token_estimate(F.col("text")).alias("cost"), F.length("text").alias("size"))
    before = rows.select("paper", (F.col("pos") + 1).alias("pos"), F.struct(F.concat(F.lit("E"), F.col("pos")).alias("id"), F.col("cost").alias("cost")).alias("b"))
    rows = rows.join(before, ["paper", "pos"], "left")
    own = F.struct(F.concat(F.lit("E"), F.col("pos")).alias("id"), "cost")
    source = F.struct(F.concat(F.lit("S"), F.floor(F.col("pos") / 3)).alias("id"), F.lit(25).cast("long").alias("cost"))
    return pack.payload_budget(rows.withColumn("parts", F.array_compact(F.array(own, "b", source))), "paper", "pos", "size", "parts", 450, base=30)


FAMILIES = {"editing": "th", "delivery": "an", "toxicity": "[0-9]"}
C = f"""c AS (SELECT paper, 'C' || pos AS candidate_id, pos AS ord, ['{"', '".join(FAMILIES)}'][(pos % 3 + 1)::INT] AS family, [evidence_id, paper || '-' || (pos - 1)] AS evidence_ids, text FROM p WHERE role = 'assistant'),
o AS (SELECT paper, 'O' || pos AS outcome_id, pos AS ord, text, CASE WHEN pos % 4 = 0 THEN [evidence_id] ELSE [] END AS evidence_ids, CASE pos % 6 WHEN 0 THEN 12.5 WHEN 2 THEN 7.0 END::DOUBLE AS value,
  CASE pos % 6 WHEN 0 THEN '12.5' WHEN 2 THEN '7' END AS value_text FROM p WHERE role = 'user')"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = passages(spark, sf).where("role = 'assistant'")
    return rows.select(
        "paper", F.concat(F.lit("C"), "pos").alias("candidate_id"), F.col("pos").alias("ord"), _pick(tuple(FAMILIES), F.col("pos") % 3).alias("family"), F.array("evidence_id", _id(-1)).alias("evidence_ids"),
        F.array(F.concat(F.lit("S"), F.col("paper"), F.lit("-"), F.floor(F.col("pos") / 6))).alias("source_ids"), "text", F.when(F.col("pos") % 8 == 1, "Table S2").when(F.col("pos") % 8 == 5, "Figure 1").alias("figure"),
        F.when(F.col("pos") % 5 < 3, "high").otherwise("medium").alias("confidence"), F.when(F.col("pos") % 8 == 1, "vision").otherwise("text").alias("route_hint"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows, six = passages(spark, sf).where("role = 'user'"), F.col("pos") % 6
    return rows.select(
        "paper", F.concat(F.lit("O"), "pos").alias("outcome_id"), F.col("pos").alias("ord"), "text", F.when(F.col("pos") % 4 == 0, F.array("evidence_id")).otherwise(_none()).alias("evidence_ids"),
        F.when(six == 0, 12.5).when(six == 2, 7.0).alias("value"), F.when(six == 0, "12.5").when(six == 2, "7").alias("value_text"),
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = passages(spark, sf).select("paper", F.floor(F.col("pos") / 6).alias("n")).distinct()
    return rows.select("paper", F.concat(F.lit("S"), F.col("paper"), F.lit("-"), F.col("n")).alias("source_id"), _pick(("Results", "Materials and Methods", "Introduction", "Results > Uptake"), F.col("n") % 4).alias("section"))


PAIRS = f"""pairs AS (SELECT c.paper, c.ord AS gold, o.ord AS outcome, c.candidate_id, o.outcome_id,
  CASE WHEN list_has_any(c.evidence_ids, o.evidence_ids) THEN CASE WHEN o.value IS NOT NULL AND len(n) > 0 AND len(list_filter(n, lambda x: abs(x - o.value) <= 1e-9)) = 0 THEN 0.0 ELSE 1.0 END
    ELSE least(1.0, len(list_intersect(ct, ot)) / greatest(1, len(ot)) + CASE WHEN o.value IS NOT NULL AND contains(c.text, o.value_text) THEN 0.35 ELSE 0.0 END) END::DOUBLE AS score
  FROM (SELECT *, list_distinct({CELLS.format('text')}) AS ct, list_transform(regexp_extract_all(text, '-?[0-9]+(?:[.][0-9]+)?'), lambda x: x::DOUBLE) AS n FROM c) c
  JOIN (SELECT *, list_distinct({CELLS.format('text')}) AS ot FROM o) o ON o.paper = c.paper AND regexp_matches(o.text, CASE c.family WHEN 'editing' THEN 'th' WHEN 'delivery' THEN 'an' ELSE '[0-9]' END))"""
WALK = """
r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC, gold, outcome) AS i FROM pairs WHERE score >= 0.3),
walk AS (
  SELECT paper, 0::BIGINT AS i, []::BIGINT[] AS g, []::BIGINT[] AS o FROM (SELECT DISTINCT paper FROM r)
  UNION ALL
  SELECT w.paper, r.i, CASE WHEN list_contains(g, r.gold) OR list_contains(o, r.outcome) THEN g ELSE list_append(g, r.gold) END,
         CASE WHEN list_contains(g, r.gold) OR list_contains(o, r.outcome) THEN o ELSE list_append(o, r.outcome) END
  FROM walk w JOIN r ON r.paper = w.paper AND r.i = w.i + 1),
last AS (SELECT paper, arg_max(g, i) AS g, arg_max(o, i) AS o FROM walk GROUP BY paper)"""


@query(f"WITH {P}, {C}, {PAIRS} SELECT paper, candidate_id, outcome_id, round(score, 6) AS score FROM pairs")
def coverage_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all candidates and outcomes of one paper and family."""
    rows = coverage.scores(candidates(spark, sf), outcomes(spark, sf), FAMILIES)
    return rows.select("paper", "candidate_id", "outcome_id", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {P}, {C}, {PAIRS}, {WALK} SELECT p.paper, p.candidate_id, p.outcome_id, round(p.score, 4) AS score FROM (SELECT paper, unnest(g) AS gold, unnest(o) AS outcome FROM last) JOIN pairs p USING (paper, gold, outcome)")
def greedy_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy one-to-one matching of candidates and outcomes per paper by descending score."""
    return coverage.matches(coverage.scores(candidates(spark, sf), outcomes(spark, sf), FAMILIES))


@query()
def optimal_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Assignment of greatest total score per paper among pairs of 0.42 at least, with the tie rule."""
    pairs = coverage.scores(candidates(spark, sf), outcomes(spark, sf), FAMILIES).withColumn("score", F.round("score", 6))
    return match.optimal(pairs, "paper", "c_ord", "o_ord", "score", 0.42)


@query()
def residue_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What the matches leave open: repair targets, duplicates and reviews with their reasons."""
    c, o = candidates(spark, sf), outcomes(spark, sf)
    return coverage.residue(c, coverage.matches(coverage.scores(c, o, FAMILIES)), o)


@query()
def consolidated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Rejections, near-duplicate merges and retained candidates."""
    return coverage.consolidate(candidates(spark, sf), sources(spark, sf))


@query()
def repair_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes from findings, coverage and inventory, over all papers."""
    return coverage.routes(_findings(spark, sf).withColumn("message", F.col("record")), residue_targets(spark, sf).join(candidates(spark, sf).select("paper", "candidate_id", "route_hint"), ["paper", "candidate_id"]), consolidated_candidates(spark, sf))


@query()
def finalization(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a paper may be finalised, and what stands in the way."""
    valid = contracts.status(passages(spark, sf), _findings(spark, sf)).select("paper", (F.col("status") == "valid").alias("valid"))
    open_ = residue_targets(spark, sf).select("paper").distinct().withColumn("open", F.lit(True))
    papers = valid.join(open_, "paper", "left").select("paper", "valid", (F.col("paper") % 2 == 0).alias("complex"), F.col("open").isNull().alias("covered"))
    return coverage.decisions(papers, repair_routes(spark, sf))


GOLD_PATH, FOUND_PATH = ("data/PMC{}.xml", "data/a{}.pdf", "x/PMC{}.nxml"), ("other/PMC{}_main.xml", "b/a{}.pdf", "x/PMC{}.pdf")
PLACES = """g AS (SELECT paper, pos AS gold_id, ['data/PMC' || paper || '.xml', 'data/a' || paper || '.pdf', 'x/PMC' || paper || '.nxml'][(paper % 3 + 1)::INT] AS path, CASE WHEN pos % 5 > 0 THEN page END AS page, CASE WHEN pos % 6 = 4 THEN 'e' || pos END AS element, text,
  CASE WHEN pos % 4 = 2 THEN '7' END AS value_text FROM p WHERE role = 'user'),
f AS (SELECT paper, pos AS found_id, ['other/PMC' || paper || '_main.xml', 'b/a' || paper || '.pdf', 'x/PMC' || paper || '.pdf'][(paper % 3 + 1)::INT] AS path, page, 'e' || (pos + 1) AS element, text FROM p WHERE role = 'assistant'),
l AS (SELECT g.paper, gold_id, found_id FROM g JOIN f ON g.paper = f.paper AND (g.element = f.element OR ((g.path = f.path OR regexp_extract(g.path, '[^/]*$') = regexp_extract(f.path, '[^/]*$') OR
  (regexp_extract(g.path, 'PMC[0-9]+') <> '' AND regexp_extract(g.path, 'PMC[0-9]+') = regexp_extract(f.path, 'PMC[0-9]+') AND regexp_matches(lower(g.path), '[.]n?xml$') AND regexp_matches(lower(f.path), '[.]n?xml$')))
  AND (g.page = f.page OR (g.page IS NULL AND g.element IS NULL)))))"""


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = passages(spark, sf)
    path = lambda names: F.get(F.array(*[F.concat(F.lit(n.split("{}")[0]), F.col("paper"), F.lit(n.split("{}")[1])) for n in names]), (F.col("paper") % 3).cast("int")).alias("path")
    gold = rows.where("role = 'user'").select("paper", F.col("pos").alias("gold_id"), path(GOLD_PATH), F.when(F.col("pos") % 5 > 0, F.col("page")).alias("page"), F.when(F.col("pos") % 6 == 4, F.concat(F.lit("e"), F.col("pos"))).alias("element"), "text", F.when(F.col("pos") % 4 == 2, "7").alias("value_text"))
    found = rows.where("role = 'assistant'").select("paper", F.col("pos").alias("found_id"), path(FOUND_PATH), "page", F.concat(F.lit("e"), F.col("pos") + 1).alias("element"), "text")
    return gold, found


@query(f"WITH {P}, {PLACES} SELECT DISTINCT * FROM l")
def location_match(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at one place: by element, or by file (path, name or PMC id) and page."""
    return coverage.same_location(*_places(spark, sf))


@query(
    f"""WITH {P}, {PLACES}, gt AS (SELECT *, list_distinct({CELLS.format('text')}) AS t, list_distinct({CELLS.format("coalesce(value_text, '')")}) AS v FROM g), ft AS (SELECT *, list_distinct({CELLS.format('text')}) AS t FROM f),
m AS (SELECT gt.paper, gt.gold_id, ft.found_id FROM gt JOIN ft USING (paper) LEFT JOIN (SELECT DISTINCT * FROM l) l ON l.paper = gt.paper AND l.gold_id = gt.gold_id AND l.found_id = ft.found_id
  WHERE (l.paper IS NOT NULL AND len(list_intersect(gt.t, ft.t)) >= 2) OR (len(list_intersect(gt.t, ft.t)) >= 4 AND len(v) > 0 AND list_has_all(list_intersect(gt.t, ft.t), v)))
SELECT g.paper, g.gold_id, count(m.found_id) > 0 AS recalled, count(m.found_id)::BIGINT AS candidates FROM g LEFT JOIN m USING (paper, gold_id) GROUP BY g.paper, g.gold_id"""
)
def inventory_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Gold rows that the inventory holds, by place or by strong text."""
    gold, found = _places(spark, sf)
    located = coverage.same_location(gold, found).withColumnRenamed("found_id", "candidate_id")
    return coverage.inventory_recall(gold, found.withColumnRenamed("found_id", "candidate_id"), located)


@query(
    """WITH h AS (SELECT DISTINCT a.l_orderkey AS paper, a.l_linenumber AS gold_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_quantity + 0.125 - (b.l_quantity + 0.125 + CASE b.l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1e-10 ELSE 1.5 END)) <= 1e-9),
c AS (SELECT l_orderkey AS paper, count(*) AS gold, count(h.paper) AS recalled FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l LEFT JOIN h ON h.paper = l_orderkey AND h.gold_id = l_linenumber GROUP BY 1),
q AS (SELECT o_orderkey AS paper, CASE o_orderstatus WHEN 'F' THEN 'eligible' WHEN 'O' THEN 'ineligible' ELSE 'manual_review' END AS expected, CASE WHEN o_orderkey % 2 = 0 THEN 'eligible' ELSE 'ineligible' END AS actual, o_orderkey % 5 = 0 AS unresolved, o_orderkey % 7 <> 0 AS current_ FROM orders),
x AS (SELECT q.*, coalesce(gold, 0) AS gold, coalesce(recalled, 0) AS recalled, expected <> 'manual_review' AND expected = actual AS m, unresolved OR NOT current_ OR expected = 'manual_review' AS r FROM q LEFT JOIN c USING (paper)),
y AS (SELECT CASE WHEN grouping(paper) = 1 THEN 'all' ELSE paper::VARCHAR END AS paper, sum(gold)::BIGINT AS gold, sum(recalled)::BIGINT AS recalled, round(sum(recalled) / greatest(1, sum(gold)), 4) AS recall, count(*) FILTER (m)::BIGINT AS eligibility_match, count(*) FILTER (r)::BIGINT AS needs_review FROM x GROUP BY ROLLUP (paper))
SELECT *, concat_ws(',', CASE WHEN recalled < gold THEN 'numeric_recall' END, CASE WHEN needs_review > 0 THEN 'human_review' END) AS reasons FROM y"""
)
def gold_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Exact numeric recall, eligibility and reviews, per paper and overall."""
    lines, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    value = F.col("l_quantity") + 0.125
    gold = lines.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("gold_id"), value.alias("value"))
    off = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1e-10).otherwise(1.5)
    recalled = coverage.numeric_recall(gold, lines.select(F.col("l_orderkey").alias("paper"), (value + off).alias("value")))
    recalled = recalled.groupBy("paper", "gold_id").agg(F.bool_or("recalled").alias("recalled"))
    key = F.col("o_orderkey")
    expected = F.when(F.col("o_orderstatus") == "F", "eligible").when(F.col("o_orderstatus") == "O", "ineligible").otherwise("manual_review")
    papers = orders.select(key.alias("paper"), expected.alias("expected"), F.when(key % 2 == 0, "eligible").otherwise("ineligible").alias("actual"), F.when(key % 5 == 0, 1).otherwise(0).alias("unresolved"), (key % 7 != 0).alias("current"))
    return coverage.evaluation(recalled, papers)


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Responses of all papers: their records, reported fields, slots and answers."""
    rows, n = passages(spark, sf), F.col("pos")
    tag = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    part = lambda k: rows.where(n % 4 == k)
    paper = F.col("paper")
    ghost = F.array(F.lit("ghost"))
    heads = rows.select("paper").distinct()
    cited = F.when(n % 5 == 0, F.concat(F.array("evidence_id"), ghost)).otherwise(F.array("evidence_id"))
    sent = rows.where("role = 'assistant'").select("paper", tag("C", n).alias("candidate_id"), F.array("evidence_id").alias("evidence_ids"), "pos")
    given = sent.where("pos % 3 <> 0").select("paper", "candidate_id", F.when(n % 4 == 1, "extracted").otherwise("not_an_outcome").alias("disposition"))
    stray = heads.where(paper % 9 == 0).select("paper", F.lit("C999").alias("candidate_id"), F.lit("extracted").alias("disposition"))
    return {
        "papers": heads.select(
            "paper", F.when(paper % 4 == 0, "ineligible").otherwise("eligible").alias("decision"), F.when(paper % 6 == 0, "x").otherwise(paper.cast("string")).alias("answered_as"),
            F.when(paper % 5 == 0, F.concat(F.array(F.concat("paper", F.lit("-0"))), ghost)).otherwise(F.array(F.concat("paper", F.lit("-0")))).alias("evidence_ids"),
        ),
        "formulations": part(0).select("paper", tag("F", F.when(n % 16 == 8, 0).otherwise(n)).alias("formulation_id")),
        "components": part(1).select("paper", tag("F", n - 1).alias("formulation_id")),
        "experiments": part(2).select("paper", tag("E", n).alias("experiment_id"), tag("F", n - 2).alias("formulation_id")),
        "outcomes": part(3).select("paper", F.when(paper % 7 == 0, "E999").otherwise(tag("E", n - 1)).alias("experiment_id")),
        "fields": part(3).select("paper", F.lit("outcomes").alias("collection"), F.floor(n / 4).alias("place"), F.lit("endpoint").alias("field"), cited.alias("evidence_ids")),
        "evidence": rows.select("paper", "evidence_id"),
        "slots": sent.drop("pos"),
        "answers": given.unionByName(stray),
    }


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    links = contracts.record_links(t["papers"], t["formulations"], t["components"], t["experiments"], t["outcomes"])
    return contracts.documents(t["papers"], t["fields"], t["evidence"], links, t["slots"], t["answers"])


FINDINGS = f"""{P}, h AS (SELECT DISTINCT paper FROM p), fo AS (SELECT paper, 'F' || CASE WHEN pos % 16 = 8 THEN 0 ELSE pos END AS k FROM p WHERE pos % 4 = 0), co AS (SELECT paper, 'F' || (pos - 1) AS k FROM p WHERE pos % 4 = 1),
ex AS (SELECT paper, 'E' || pos AS e, 'F' || (pos - 2) AS k FROM p WHERE pos % 4 = 2), ou AS (SELECT paper, CASE WHEN paper % 7 = 0 THEN 'E999' ELSE 'E' || (pos - 1) END AS e, pos, evidence_id FROM p WHERE pos % 4 = 3),
sl AS (SELECT paper, 'C' || pos AS c, pos, evidence_id FROM p WHERE role = 'assistant'), an AS (SELECT paper, c, pos % 4 = 1 AS x FROM sl WHERE pos % 3 <> 0 UNION ALL SELECT paper, 'C999', true FROM h WHERE paper % 9 = 0),
z AS (
SELECT paper, 'records_of_ineligible_paper' AS code, '' AS record FROM h WHERE paper % 4 = 0 AND paper IN (SELECT paper FROM p)
UNION ALL SELECT paper, 'eligible_without_records', '' FROM h WHERE paper % 4 <> 0 AND (paper NOT IN (SELECT paper FROM fo) OR paper NOT IN (SELECT paper FROM ex) OR paper NOT IN (SELECT paper FROM ou))
UNION ALL SELECT paper, 'repeated_formulation_id', k FROM fo GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT paper, 'repeated_experiment_id', e FROM ex GROUP BY paper, e HAVING count(*) > 1
UNION ALL SELECT paper, 'component_of_unknown_formulation', k FROM co WHERE (paper, k) NOT IN (SELECT (paper, k) FROM fo) UNION ALL SELECT paper, 'experiment_of_unknown_formulation', k FROM ex WHERE (paper, k) NOT IN (SELECT (paper, k) FROM fo)
UNION ALL SELECT paper, 'outcome_of_unknown_experiment', e FROM ou WHERE (paper, e) NOT IN (SELECT (paper, e) FROM ex)
UNION ALL SELECT paper, 'paper_id_mismatch', '' FROM h WHERE paper % 6 = 0
UNION ALL SELECT paper, 'unknown_evidence_id', 'eligibility/evidence_ids' FROM h WHERE paper % 5 = 0 OR (paper || '-0') NOT IN (SELECT evidence_id FROM p)
UNION ALL SELECT DISTINCT paper, 'unknown_evidence_id', 'outcomes/' || (pos // 4) || '/endpoint' FROM ou WHERE pos % 5 = 0
UNION ALL SELECT DISTINCT paper, 'missing_candidate_disposition', c FROM sl WHERE (paper, c) NOT IN (SELECT (paper, c) FROM an) UNION ALL SELECT DISTINCT paper, 'unknown_candidate_id', c FROM an WHERE (paper, c) NOT IN (SELECT (paper, c) FROM sl)
UNION ALL SELECT DISTINCT sl.paper, 'unsupported_extracted_disposition', sl.c FROM sl JOIN an ON sl.paper = an.paper AND sl.c = an.c AND x WHERE evidence_id NOT IN (SELECT evidence_id FROM ou))"""


@query(f"WITH {FINDINGS} SELECT paper, code, record, code = 'unknown_evidence_id' AND record <> 'eligibility/evidence_ids' AS repairable, 'F-' || substr(sha256(paper || ':' || code || ':' || record), 1, 12) AS finding_id FROM z")
def document_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Whole responses: ids, evidence, record links and candidate slots."""
    return _findings(spark, sf)


@query(f"WITH {FINDINGS} SELECT h.paper, count(z.code)::BIGINT AS findings, CASE WHEN count(z.code) = 0 THEN 'valid' ELSE 'invalid' END AS status FROM h LEFT JOIN z USING (paper) GROUP BY h.paper")
def document_status(spark: SparkSession, sf: str) -> DataFrame:
    """A response is valid only whole."""
    return contracts.status(passages(spark, sf), _findings(spark, sf))


VALUES, DISPOSITIONS = ("visually_estimated", "exact_reported", "derived", "not_resolved"), ("resolved", "missing", "human_review", "ambiguous", "resolved")


@query(
    """WITH r AS (SELECT user_id AS paper, event_id AS n, ['visually_estimated', 'exact_reported', 'derived', 'not_resolved'][(event_id % 4 + 1)::INT] AS v, ['resolved', 'missing', 'human_review', 'ambiguous', 'resolved'][(event_id % 5 + 1)::INT] AS d,
  event_id % 3 = 0 AS h, CASE WHEN event_id % 7 > 0 THEN 'panel' END AS panel, CASE WHEN event_id % 2 = 0 THEN '{}' END AS fragment, CASE event_id % 11 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'sum' END AS derivation, CASE event_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['a', ' '] ELSE ['a'] END AS labels FROM events),
f AS (SELECT paper, n, unnest(list_filter([
  CASE WHEN v = 'visually_estimated' AND NOT (d = 'human_review' AND h) THEN 'estimate_without_review' END, CASE WHEN v = 'visually_estimated' AND panel IS NULL THEN 'estimate_without_panel' END,
  CASE WHEN d = 'resolved' AND fragment IS NULL THEN 'resolved_without_fragment' END, CASE WHEN d = 'resolved' AND v NOT IN ('exact_reported', 'derived') THEN 'resolved_status' END, CASE WHEN d = 'resolved' AND panel IS NULL THEN 'resolved_without_panel' END,
  CASE WHEN d IN ('missing', 'ambiguous') AND fragment IS NOT NULL THEN 'unresolved_with_fragment' END, CASE WHEN d IN ('missing', 'ambiguous') AND v <> 'not_resolved' THEN 'unresolved_status' END,
  CASE WHEN v = 'derived' AND coalesce(trim(derivation), '') = '' THEN 'derived_without_derivation' END, CASE WHEN d = 'human_review' AND NOT h THEN 'review_not_required' END,
  CASE WHEN v = 'exact_reported' AND len(labels) = 0 THEN 'exact_without_labels' END, CASE WHEN list_contains(labels, ' ') THEN 'blank_label' END], lambda x: x IS NOT NULL)) AS code FROM r)
SELECT paper, code, n::VARCHAR AS record FROM f"""
)
def vision_safety(spark: SparkSession, sf: str) -> DataFrame:
    """Safety rules of responses about images."""
    n = F.col("event_id")
    labels = F.when(n % 6 == 0, _none()).when(n % 6 == 1, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a")))
    rows = read(spark, sf, "events").select(
        F.col("user_id").alias("paper"), n.alias("record"), _pick(VALUES, n % 4).alias("value_status"), _pick(DISPOSITIONS, n % 5).alias("disposition"), (n % 3 == 0).alias("requires_human_review"),
        F.when(n % 7 > 0, "panel").alias("panel"), F.when(n % 2 == 0, "{}").alias("fragment"), F.when(n % 11 == 0, " ").when(n % 11 != 1, "sum").alias("derivation"), labels.alias("printed_labels"),
    )
    return contracts.vision_findings(rows)


GRAMMAR = "['the', 'a', 'an', 'of', 'and', 'or', 'in', 'from', 'with', 'to', 'for', 'by', 'on', 'at']"
NORM = "lower(trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'), ' '))"
WORDS = "list_filter(list_distinct(" + CELLS.format("coalesce({}, '')") + f"), lambda t: length(t) > 1 AND NOT list_contains({GRAMMAR}, t))"


@query(
    f"""WITH {P}, w AS (SELECT a.paper, a.pos, b.text AS src, {NORM.format('b.text')} AS source, {CELLS.format('b.text')} AS w FROM p a LEFT JOIN p b ON b.paper = a.paper AND b.pos = a.pos - 1),
m AS (SELECT paper, pos, src, source, w, CASE WHEN pos % 7 = 6 THEN 'none' WHEN src IS NULL OR pos % 11 = 3 THEN 'unknown' ELSE 'known' END AS cited, CASE WHEN pos % 4 = 3 THEN 'zzqx' ELSE w[2] END AS name,
  CASE pos % 3 WHEN 0 THEN w[3] || 's' WHEN 1 THEN 'unseen thing' END AS population, CASE WHEN pos % 2 = 1 THEN w[4] END AS state, CASE WHEN pos % 5 = 0 THEN 'zz top' ELSE ' ' END AS species FROM w),
y AS (SELECT *, list_concat(list_distinct(w), list_transform(w, lambda t: t || 's'), list_transform(list_filter(w, lambda t: ends_with(t, 's') AND length(t) > 2), lambda t: t[1:length(t) - 1])) AS hay FROM m),
l AS (SELECT *, len(list_filter({WORDS.format('name')}, lambda t: NOT list_contains(hay, t))) = 0 AND contains(source, name) AS named, len(list_filter({WORDS.format('population')}, lambda t: NOT list_contains(hay, t))) > 0 AS lp,
  len(list_filter({WORDS.format('state')}, lambda t: NOT list_contains(hay, t))) > 0 AS ls, len(list_filter({WORDS.format('species')}, lambda t: NOT list_contains(hay, t))) > 0 AS lx FROM y),
r AS (SELECT *, CASE WHEN cited = 'none' THEN 'no_evidence_cited' WHEN cited = 'unknown' THEN 'cited_evidence_id_not_in_packet' WHEN NOT coalesce(named, false) THEN 'line_name_not_in_cited_evidence'
  WHEN (population IS NULL OR lp) AND (state IS NULL OR ls) THEN 'nothing_grounded_beyond_the_line_name' ELSE 'kept' END AS reason FROM l)
SELECT paper, pos AS mapping_id, reason, CASE WHEN reason = 'kept' AND NOT lp THEN population END AS population, CASE WHEN reason = 'kept' AND NOT ls THEN state END AS state,
  CASE WHEN reason IN ('kept', 'nothing_grounded_beyond_the_line_name') THEN concat_ws(',', CASE WHEN population IS NOT NULL AND lp THEN 'population' END, CASE WHEN state IS NOT NULL AND ls THEN 'state' END, CASE WHEN pos % 5 = 0 AND lx THEN 'species' END) ELSE '' END AS dropped FROM r"""
)
def entity_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Entity mappings as far as the texts that they cite bear them out."""
    rows, n = passages(spark, sf), F.col("pos")
    before = rows.select("paper", (n + 1).alias("pos"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    cites = F.when(n % 7 == 6, _none()).when(n % 11 == 3, F.array(_id(-1), F.lit("ghost"))).otherwise(F.array(_id(-1)))
    maps = rows.join(before, ["paper", "pos"], "left").select(
        "paper", n.alias("mapping_id"), F.when(n % 4 == 3, "zzqx").otherwise(F.get("w", 1)).alias("name"), cites.alias("evidence_ids"),
        F.when(n % 3 == 0, F.concat(F.get("w", 2), F.lit("s"))).when(n % 3 == 1, "unseen thing").alias("population"), F.when(n % 2 == 1, F.get("w", 3)).alias("state"), F.when(n % 5 == 0, "zz top").otherwise(" ").alias("species"),
    )
    return contracts.ground(maps, rows).select("paper", "mapping_id", "reason", "population", "state", "dropped")


@query()
def support_check(spark: SparkSession, sf: str) -> DataFrame:
    """What claims assert, against the texts that they cite."""
    rows, n = passages(spark, sf), F.col("pos")
    before = rows.select("paper", (n + 1).alias("pos"), F.col("text").alias("b"))
    rows = rows.join(before, ["paper", "pos"], "left")
    claims = rows.select(
        "paper", n.alias("claim_id"), F.when(n % 3 == 0, 12.5).alias("number"), F.when(n % 3 == 1, F.substring("b", 2, 30)).alias("words"), F.when(n % 2 == 0, F.substring("b", 4, 60)).otherwise(F.col("text")).alias("qualitative"),
        F.when(n % 5 == 4, _none()).otherwise(F.array(_id(-1), F.lit("ghost"))).alias("evidence_ids"),
    )
    return contracts.supports(claims, rows)


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, n = passages(spark, sf).where("role = 'user'"), F.col("pos")
    words = F.split("text", " ")
    join = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    return rows.select(
        "paper", n.alias("gold_id"), join(1, 3).alias("endpoint"), F.lit("per cell").alias("basis"), F.when(n % 3 > 0, F.concat_ws(" ", join(4, 5), F.when(n % 6 == 4, "reduced").when(n % 6 == 2, "colocalized"))).alias("qualitative"),
        F.col("text").alias("evidence_text"), F.when(n % 4 == 0, 12.5).alias("value"), F.when(n % 4 == 0, "12.5").alias("value_text"), F.when(n % 8 == 0, "reported").otherwise("estimated").alias("value_status"),
    )


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, n = passages(spark, sf).where("role = 'assistant'"), F.col("pos")
    six = n % 6
    return rows.select(
        "paper", n.alias("outcome_id"), F.substring("text", 1, 40).alias("endpoint"), F.lit("assay").alias("assay"), F.concat("text", F.when(six == 3, " was reduced").when(six == 1, " not colocalized").otherwise("")).alias("text"),
        F.lit("F4/80 cells").alias("context"), F.when(n % 5 == 0, 12.5).alias("value"), F.when(six == 1, "not_colocalized").when(six == 5, "colocalized").alias("relationship"),
    )


@query()
def gated_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of gold rows and results with the endpoint, polarity and numeric gates."""
    return similarity.gold_scores(gold_rows(spark, sf), result_rows(spark, sf))


RELATIONS = (*S.POLARITY, "unclear")


POLARITY_SQL = " ".join(f"WHEN '{k}' THEN '{b}'" for k, (b, _) in S.POLARITY.items()), " ".join(f"WHEN '{k}' THEN {a}" for k, (_, a) in S.POLARITY.items())


@query(f"SELECT event_id, CASE r {POLARITY_SQL[0]} END AS base, CASE r {POLARITY_SQL[1]} END AS affirmed FROM (SELECT event_id, {list(RELATIONS)}[(event_id % 8 + 1)::INT] AS r FROM events)")
def declared_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """The closed relationship vocabulary as (base, affirmed); other words declare nothing."""
    base, affirmed = S.polarity(_pick(RELATIONS, F.col("event_id") % 8))
    return read(spark, sf, "events").select("event_id", base.alias("base"), affirmed.alias("affirmed"))


def _run(spark: SparkSession, sf: str, condition: str) -> DataFrame:
    """Outcomes of a run: order lines that fit a condition, numbered per order."""
    from pyspark.sql import Window

    rows = read(spark, sf, "lineitem").where(condition)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = rows.withColumn("ord", F.row_number().over(order))
    return rows.select(
        F.col("l_orderkey").alias("paper"), F.concat(F.lit("O"), "ord").alias("outcome_id"), "ord", F.concat(F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""), "l_returnflag", (F.col("l_partkey") % 3).cast("string")).alias("endpoint"),
        F.col("l_quantity").cast("int").cast("string").alias("value_text"), F.col("l_linestatus").alias("unit"),
    )


def _run_sql(name: str, condition: str, place: int) -> str:
    return f"""{name} AS (SELECT *, 'O' || ord AS outcome_id, '{name}' AS run, {place} AS place FROM (SELECT l_orderkey AS paper, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord,
  lower(l_returnflag || (l_partkey % 3)) AS e, l_quantity::INT::VARCHAR AS v, lower(l_linestatus) AS u FROM lineitem WHERE {condition}))"""


RUNS = ", ".join([_run_sql("a", "l_orderkey % 2 = 0 AND l_linenumber % 2 = 1", 0), _run_sql("b", "l_orderkey % 3 > 0 AND l_linenumber < 5", 1), _run_sql("second", "l_orderkey % 5 > 0", 2)])
UNION = "k AS (SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY paper, e, v, u ORDER BY place, ord) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY paper, outcome_id ORDER BY place, ord) AS c FROM k)"


@query(
    f"""WITH {RUNS}, base AS (SELECT paper, min(place) AS place FROM (SELECT paper, place FROM a UNION ALL SELECT paper, place FROM b) GROUP BY paper),
u AS (SELECT * FROM a UNION ALL SELECT b.* FROM b JOIN base USING (paper, place) UNION ALL SELECT * FROM second), {UNION.format('u')}
SELECT paper, CASE WHEN c = 1 THEN outcome_id ELSE outcome_id || '-' || c END AS outcome_id, CASE WHEN c > 1 THEN outcome_id END AS source_outcome_id, run AS source_run, v AS value_text FROM n"""
)
def second_pass_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Each paper's first baseline merged with a second pass."""
    runs = [("a", _run(spark, sf, "l_orderkey % 2 = 0 and l_linenumber % 2 = 1")), ("b", _run(spark, sf, "l_orderkey % 3 > 0 and l_linenumber < 5"))]
    rows, _ = merge.second_pass(runs, ("second", _run(spark, sf, "l_orderkey % 5 > 0")), [])
    return rows.select("paper", "outcome_id", "source_outcome_id", "source_run", "value_text")


@query(
    f"""WITH {_run_sql('base', 'l_linenumber % 2 = 1', 0)}, {_run_sql('salvage', 'l_linenumber > 2', 1)}, u AS (SELECT * FROM base WHERE paper % 4 = 0 UNION ALL SELECT * FROM salvage WHERE paper % 4 = 0), {UNION.format('u')}
SELECT paper, CASE WHEN c = 1 THEN outcome_id ELSE outcome_id || '-' || c END AS outcome_id, run AS source_run, v AS value_text FROM n UNION ALL SELECT paper, outcome_id, run, v FROM base WHERE paper % 4 > 0
UNION ALL SELECT o_orderkey, 'V1', 'vision', o_totalprice::INT::VARCHAR FROM orders WHERE o_orderstatus = 'F'"""
)
def overlay_union(spark: SparkSession, sf: str) -> DataFrame:
    """A base with some papers unioned with their salvage, and resolved observations appended."""
    orders = read(spark, sf, "orders")
    papers = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("paper"))
    seen = orders.select(
        F.col("o_orderkey").alias("paper"), F.lit(1).alias("ord"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("missing").alias("disposition"), F.lit("panel").alias("endpoint"),
        F.rint("o_totalprice").cast("int").cast("string").alias("value_text"), F.lit("%").alias("unit"),
    )
    experiments = orders.select(F.col("o_orderkey").alias("paper"), F.lit("E7").alias("experiment_id"), F.lit(1).alias("ord"))
    rows = merge.overlay(("base", _run(spark, sf, "l_linenumber % 2 = 1")), ("salvage", _run(spark, sf, "l_linenumber > 2")), papers, seen, experiments)
    return rows.select("paper", "outcome_id", "source_run", "value_text")


@query(
    """WITH m AS (SELECT o_orderkey AS paper, CASE o_orderkey % 10 WHEN 9 THEN 'reader_c' WHEN 8 THEN 'reader_b' ELSE 'reader_a' END AS reader, o_orderstatus <> 'P' AS present FROM orders),
e AS (SELECT l_orderkey AS paper, CASE l_orderkey % 10 WHEN 9 THEN 'reader_c' WHEN 8 THEN 'reader_b' ELSE 'reader_a' END AS reader, l_linenumber::VARCHAR AS k, l_discount > 0.01 AS sentences, l_tax > 0.01 AS quoted FROM lineitem)
SELECT paper, 'presence_differs_from_list' AS code, reader AS record FROM m WHERE present <> (paper IN (SELECT paper FROM e)) UNION ALL SELECT paper, 'unknown_reader', reader FROM m WHERE reader = 'reader_c'
UNION ALL SELECT paper, 'no_sentence', reader || '/' || k FROM e WHERE NOT sentences UNION ALL SELECT paper, 'no_quote', reader || '/' || k FROM e WHERE NOT quoted UNION ALL SELECT paper, 'list_without_map', reader || '/' || k FROM e WHERE paper NOT IN (SELECT paper FROM m)"""
)
def boundary_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment maps against their lists."""
    reader = lambda c: F.when(c % 10 == 9, "reader_c").when(c % 10 == 8, "reader_b").otherwise("reader_a").alias("reader")
    maps = read(spark, sf, "orders").select(F.col("o_orderkey").alias("paper"), reader(F.col("o_orderkey")), (F.col("o_orderstatus") != "P").alias("present"))
    lines = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("paper"), reader(F.col("l_orderkey")), F.col("l_linenumber").cast("string").alias("key"), F.when(F.col("l_discount") > 0.01, F.array(F.lit("s1"))).otherwise(_none()).alias("sentence_ids"),
        F.when(F.col("l_tax") > 0.01, "quote").otherwise("").alias("quote"),
    )
    return contracts.boundaries(maps, lines)


@query(
    f"""WITH {P} SELECT paper, least(12, count(*))::BIGINT AS evidence, least(8, greatest(1, 2 * count(*) FILTER (role = 'assistant')))::BIGINT AS permitted, string_agg(text, '|' ORDER BY pos) FILTER (pos < 12) IS NOT NULL AS texts FROM p WHERE paper % 8 > 0 GROUP BY paper"""
)
def record_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Signed tasks of referrals whose evidence is all known."""
    rows = passages(spark, sf)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"])
    some = F.array_compact(F.collect_list(F.when(F.col("role") == "assistant", F.concat(F.lit("C"), "pos"))))
    refs = rows.groupBy("paper").agg(listed.alias("e"), some.alias("candidate_ids"))
    ghost = F.when(F.col("paper") % 8 == 0, F.array(F.lit("ghost"))).otherwise(_none())
    refs = refs.select("paper", F.col("paper").alias("referral_id"), "candidate_ids", F.concat("e", ghost).alias("evidence_ids"), F.lit("0").alias("result_sha256"))
    tasks, _ = contracts.missing_record_tasks(refs, rows)
    return tasks.select("paper", F.size("evidence").cast("long").alias("evidence"), F.col("permitted_new_outcomes").cast("long").alias("permitted"), (F.length("task_checksum") == 64).alias("texts"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_custkey::VARCHAR ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'quote ' || o_orderkey END AS quote FROM orders"""
)
def field_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A field of the record that an entity id names, somewhere in a nested bundle."""
    key = F.col("o_orderkey").cast("string")
    nested = F.struct(F.col("o_orderstatus").alias("value"), F.concat(F.lit("quote "), key).alias("evidence_quote"))
    record = lambda name, status, subject: F.struct(name.alias("experiment_id"), status.alias("status"), subject.alias("subject"))
    none = lambda kind: F.lit(None).cast(kind)
    bundle = F.to_json(
        F.struct(
            F.array(F.struct(F.concat(F.lit("F"), key).alias("formulation_id"), F.lit("other").alias("dose"))).alias("formulations"),
            F.array(record(F.lit("E"), none("struct<value: string, evidence_quote: string>"), none("bigint")), record(F.concat(F.lit("E"), key), nested, F.col("o_custkey"))).alias("experiments"),
        )
    )
    rows = read(spark, sf, "orders").withColumn("bundle", bundle)
    names, entity = ("formulations", "experiments"), F.concat(F.lit("E"), key)
    status, quote = contracts.find_field(F.col("bundle"), names, entity, "status")
    subject, _ = contracts.find_field(F.col("bundle"), names, entity, "subject")
    missing, _ = contracts.find_field(F.col("bundle"), names, entity, "dose")
    three = F.col("o_orderkey") % 3
    return rows.select("o_orderkey", F.when(three == 0, status).when(three == 1, subject).otherwise(missing).alias("value"), F.when(three == 0, quote).alias("quote"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN (year(o_orderdate) + 1)::VARCHAR WHEN 2 THEN '2001' WHEN 3 THEN year(o_orderdate)::VARCHAR END AS year,
CASE WHEN o_orderkey % 2 = 0 THEN 'potentially_available' ELSE 'unknown' END AS full_text_status, o_orderkey % 6 = 0 AS control FROM orders"""
)
def publication_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years by their order of preference, full-text status and the negative control."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    five = key % 5
    article, issue = F.when(five == 0, F.concat(F.lit(" "), year)), F.when(five == 1, (F.year("o_orderdate") + 1).cast("string")).when(five == 0, "1900")
    free = F.when(five == 3, F.concat(F.lit("Winter 12345 "), year, F.lit(" Jan-Feb"))).when(five == 4, "Spring 20001")
    found = contracts.publication_year(article, issue, F.when(five == 2, "2001"), F.lit(None).cast("string"), free)
    some = lambda n: F.when(key % n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return read(spark, sf, "orders").select(
        "o_orderkey", found.alias("year"), contracts.full_text_status(F.when(key % 2 == 0, "PMC1")).alias("full_text_status"), contracts.negative_control(some(2), some(3)).alias("control")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'corrected' ELSE 'validated' END AS origin, '<article class="' || CASE WHEN p_partkey % 3 = 0 THEN 'corrected' ELSE 'validated' END || '"><h2>' || p_partkey || '</h2><p>' || CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' &lt;b&gt;' ELSE p_name || ' &amp; co' END || '</p></article>' AS card FROM part"""
)
def result_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of results; the corrected one is shown where there is one."""
    rows = read(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" & co")).alias("v"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(" <b>"))).alias("c"))
    return contracts.cards(rows, "p_partkey", "v", "c")


@query(
    """WITH s AS (SELECT user_id AS w, max(event_id) AS n, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id)
SELECT w AS workload, CASE WHEN t = 'error' OR (t = 'purchase' AND n % 3 = 0) THEN 'archive_and_submit' ELSE 'refuse' END AS action, CASE WHEN t = 'error' OR (t = 'purchase' AND n % 3 = 0) THEN n END AS archived FROM s UNION ALL SELECT -1, 'submit', NULL"""
)
def workload_states(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of requests to submit workloads again."""
    events = read(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    states = events.select(F.col("user_id").alias("workload"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("event_id") % 3).alias("completed"))
    return corpus.workloads(states, states.select("workload").unionByName(spark.range(-1, 0).select(F.col("id").alias("workload"))))


@query(
    """WITH RECURSIVE k AS (SELECT c_custkey AS n, c_nationkey * 1000 + floor(c_acctbal / 50)::BIGINT AS a, c_nationkey * 1000 + c_custkey % 100 AS b FROM customer),
u AS (SELECT x.n AS f, y.n AS t FROM k x JOIN k y ON x.a = y.a OR x.b = y.b), r AS (SELECT n AS node, n AS reach FROM k UNION SELECT r.node, u.t FROM r JOIN u ON r.reach = u.f)
SELECT node, min(reach) AS component FROM r GROUP BY node"""
)
def shared_source_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of records that share one of their sources."""
    n, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long") * 1000
    rows = read(spark, sf, "customer").select(n.alias("b"), F.explode(F.array(F.concat(F.lit("a"), nation + F.floor(F.col("c_acctbal") / 50)), F.concat(F.lit("b"), nation + n % 100))).alias("source"))
    first = rows.groupBy("source").agg(F.min("b").alias("a"))
    return dedup.components(rows.join(first, "source").select("a", "b"))


@query()
def multi_key_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Strict streaming record dedup by alternative keys: a customer's name on some records, a price on all."""
    key = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(key.alias("n"), F.when(key % 4 == 0, F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 3))).alias("k1"), F.when(key % 7 > 0, F.concat(F.lit("t"), F.floor("o_totalprice"))).alias("k2"))
    return dedup.ordered_groups(rows, ["k1", "k2"], "n").drop("_block")


@query(
    """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3)) AS t FROM conversations),
w AS (SELECT conv_id, list([struct_pack(place := turn, held := t, took := [turn])] ORDER BY turn) AS items FROM t GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_prepend([]::STRUCT(place BIGINT, held VARCHAR[], took BIGINT[])[], items), lambda a, x:
  CASE WHEN len(list_filter(a, lambda y: least(len(y.held), len(x[1].held)) > 0 AND len(list_intersect(y.held, x[1].held)) / least(len(y.held), len(x[1].held)) >= 0.72)) = 0 THEN list_concat(a, x)
  ELSE list_transform(a, lambda y: CASE WHEN y.place = list_min(list_transform(list_filter(a, lambda z: least(len(z.held), len(x[1].held)) > 0 AND len(list_intersect(z.held, x[1].held)) / least(len(z.held), len(x[1].held)) >= 0.72), lambda z: z.place))
    THEN struct_pack(place := y.place, held := list_distinct(list_concat(y.held, x[1].held)), took := list_concat(y.took, x[1].took)) ELSE y END) END) AS s FROM w)
SELECT conv_id::VARCHAR AS block, unnest(r.took) AS turn, r.place AS survivor FROM (SELECT conv_id, unnest(s) AS r FROM f)"""
)
def near_duplicate_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy first-match merge of similar turns within a conversation."""
    rows = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("block"), "turn", T.tokens(F.col("text"), 3).alias("terms"))
    return dedup.greedy_near(rows, "block", "turn", "terms", 0.72)


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0)
SELECT l_orderkey, l_linenumber, CASE WHEN s_nationkey IS NULL THEN 'no_subject' WHEN s_nationkey = c_nationkey THEN 'co_supported' WHEN s_nationkey % 5 = c_nationkey % 5 THEN 'same_block' ELSE 'unsupported' END AS audit
FROM l LEFT JOIN s ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey"""
)
def co_support(spark: SparkSession, sf: str) -> DataFrame:
    """Claims whose subject and object share support, or at least a block of it."""
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(relate.checked(read(spark, sf, "supplier").where("s_acctbal > 0")), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    a, b = F.col("s_nationkey"), F.col("c_nationkey")
    state = F.when(a.isNull(), "no_subject").when(a == b, "co_supported").when(a % 5 == b % 5, "same_block").otherwise("unsupported")
    return rows.select("l_orderkey", "l_linenumber", state.alias("audit"))


STATED = (
    " Uptake increased to 12.5 % in hepatocytes after LNP mRNA.", " Editing was observed, see Table S2: insertion frequency 5 % in liver.", " Cells were seeded by protocol; no increase was found.",
    " GFP expression was reduced in macrophages (Figure 3), while activity improved 2 fold versus controls.", " Few Kupffer cells expressed eGFP.", " Knockdown reached 7 fold and 80 ± 5 % with siRNA in HSCs.",
    " The deletion frequency is shown in Table S1 and Table S2.", " HepG2 and JS-1 cells were purchased from a cell bank.", " Expression in LSECs was higher compared with HSCs; no detectable uptake.",
)
SECTIONS = ("Results", "Introduction", "Materials and Methods", "Results > Uptake", "Key resources")


def stated_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """(paper, evidence_id, ord, text, tags, source_ids, block_type): passages that state results, methods or neither."""
    rows, n = passages(spark, sf), F.col("pos")
    tags = F.when(n % 3 == 0, F.array(F.lit("outcomes"))).when(n % 3 == 1, F.array(F.lit("full_corpus"))).otherwise(F.array(F.lit("full_corpus"), F.lit("methods")))
    own = F.concat(F.lit("S"), "evidence_id")
    cites = F.when(n % 2 == 1, F.array(own, F.concat(F.lit("S"), _id(-1)))).otherwise(F.array(own))
    text = F.concat(F.col("text"), _pick(STATED, F.pmod(n + F.col("paper"), F.lit(len(STATED)))))
    return rows.select("paper", "evidence_id", n.alias("ord"), text.alias("text"), tags.alias("tags"), cites.alias("source_ids"), "block_type")


def stated_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows, n = passages(spark, sf), F.col("pos")
    return rows.select("paper", F.concat(F.lit("S"), "evidence_id").alias("source_id"), _pick(SECTIONS, n % 5).alias("section"), F.when(n % 7 == 0, "Table 2").when(n % 7 == 1, "").alias("location"))


@query()
def outcome_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome candidates grouped by family, signature, figure or table, and source."""
    rows = found_by.build(stated_evidence(spark, sf), stated_sources(spark, sf))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("evidence_ids", "source_ids", "signals", "reasons")})


@query()
def complexity_census(spark: SparkSession, sf: str) -> DataFrame:
    """The census of signals under the thresholds of both views."""
    rows, places = stated_evidence(spark, sf), stated_sources(spark, sf)
    views = [found_by.census(rows, places, limits).withColumn("view", F.lit(name)) for name, limits in (("compact", found_by.COMPACT), ("full_corpus", found_by.FULL))]
    return views[0].unionByName(views[1])


@query()
def identity_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of what an entity is: the first 260 of each paper by score, then id."""
    rows = stated_evidence(spark, sf).withColumn("source_id", F.get("source_ids", 0)).join(stated_sources(spark, sf), ["paper", "source_id"])
    score, reasons = S.identity_score(F.col("text"), F.array("block_type"), F.col("section"))
    rows = rows.select("paper", "evidence_id", score.alias("score"), reasons.alias("reasons")).where("score > 0")
    return pack.top(rows, ["paper"], [F.desc("score"), "evidence_id"], 260)


def stated_clauses(spark: SparkSession, sf: str) -> DataFrame:
    rows = stated_evidence(spark, sf).select("paper", "ord", "evidence_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "text"))
    return rows.select("paper", "ord", "i", F.concat_ws("-", "evidence_id", T.numbered("C", F.col("i") + 1)).alias("clause_id"), "text")


@query()
def result_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each value that a clause states, with its type, polarity, detection, comparison and population."""
    return atoms.atoms(stated_clauses(spark, sf), "paper", ["ord", "i"], "clause_id", "text")


@query()
def atom_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses with more numbers than numeric statements, where those of every fourth paper were lost."""
    stated = result_atoms(spark, sf).where("paper % 4 > 0")
    return atoms.cardinality(stated_clauses(spark, sf), stated, "clause_id", "text")


@query()
def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Exact title keys of the first lines of documents, for whose folding there is no built-in function."""
    first = F.element_at(F.split("text", "\n"), 1)
    return read(spark, sf, "documents").select("doc_id", F.sha2(T.title_fold(first), 256).alias("key"))


QUESTIONS = (*S.EXPANSIONS, "Composition and manufacturing", "dose")


@query(
    f"""WITH q AS (SELECT event_id, {list(QUESTIONS)}[(event_id % {len(QUESTIONS)} + 1)::INT] || ' of ' || event_type AS question FROM events)
SELECT event_id, concat_ws(' ', question, {', '.join(f"CASE WHEN contains(lower(question), '{k}') THEN '{v}' END" for k, v in S.EXPANSIONS.items())}) AS expanded FROM q"""
)
def question_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with the fixed expansions of their triggers."""
    question = F.concat_ws(" of ", _pick(QUESTIONS, F.col("event_id") % len(QUESTIONS)), F.col("event_type"))
    return read(spark, sf, "events").select("event_id", S.expanded(question).alias("expanded"))


@query(
    f"""WITH {P}, h AS (SELECT paper AS query_id, CASE WHEN pos % 9 = 8 THEN '0' ELSE evidence_id END AS block_id, CASE WHEN paper % 6 = 0 AND pos = 1 THEN -1 ELSE paper END AS paper, text, CASE pos % 4 WHEN 0 THEN ['lipid_or_material'] WHEN 1 THEN ['cell', 'assay'] ELSE [] END AS types FROM p WHERE paper % 5 > 0 OR pos = 0),
g AS (SELECT query_id, count(*) AS n, count(DISTINCT block_id) AS d, bool_or(paper <> query_id) AS leak, list_distinct(flatten(list(types))) AS types, count(DISTINCT regexp_matches(text, '{S.NEGATION}')) AS signs FROM h GROUP BY query_id),
q AS (SELECT DISTINCT conv_id AS query_id, CASE WHEN conv_id % 2 = 0 THEN 'formulation' ELSE 'outcome' END AS field_group, CASE WHEN conv_id % 3 = 0 THEN ['cell'] ELSE [] END AS required FROM conversations),
r AS (SELECT q.query_id, coalesce(signs > 1, false) AS needs_review, concat_ws(',', CASE WHEN coalesce(n, 0) < 2 THEN 'few_hits' END, CASE WHEN leak THEN 'other_paper' END, CASE WHEN NOT list_has_all(coalesce(types, []), required) THEN 'types' END,
  CASE WHEN field_group = 'formulation' AND NOT list_contains(coalesce(types, []), 'lipid_or_material') THEN 'formulation_signal' END, CASE WHEN d < n THEN 'duplicates' END) AS reasons FROM q LEFT JOIN g USING (query_id))
SELECT query_id, reasons = '' AS passed, needs_review, reasons FROM r"""
)
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate over retrieved hits: enough, of the paper, all types, formulation signal, no repeats; mixed polarity for review."""
    rows, n, paper = passages(spark, sf), F.col("pos"), F.col("paper")
    hits = rows.where((paper % 5 > 0) | (n == 0)).select(
        paper.alias("query_id"), F.when(n % 9 == 8, "0").otherwise(F.col("evidence_id")).alias("block_id"), F.when((paper % 6 == 0) & (n == 1), -1).otherwise(paper).alias("paper"), "text",
        F.when(n % 4 == 0, F.array(F.lit("lipid_or_material"))).when(n % 4 == 1, F.array(F.lit("cell"), F.lit("assay"))).otherwise(_none()).alias("entity_types"),
    )
    asked = rows.select("paper").distinct().select(
        paper.alias("query_id"), "paper", F.when(paper % 2 == 0, "formulation").otherwise("outcome").alias("field_group"), F.when(paper % 3 == 0, F.array(F.lit("cell"))).otherwise(_none()).alias("required")
    )
    return contracts.evidence_gate(hits, asked)


@query(
    f"""WITH r AS (SELECT event_id, ['eligible', 'ineligible', 'uncertain', 'maybe'][(event_id % 4 + 1)::INT] AS d, CASE event_id % 5 WHEN 0 THEN {list(contracts.POSITIVE)} WHEN 1 THEN ['RETRACTED_OR_INVALID'] WHEN 2 THEN ['PAYLOAD_AMBIGUOUS', 'PAYLOAD_AMBIGUOUS'] WHEN 3 THEN [] ELSE ['NEW_REASON'] END AS w,
  event_id % 3 > 0 AS cited, event_id % 7 AS x FROM events),
f AS (SELECT event_id, d, unnest(list_filter([CASE WHEN len(w) = 0 THEN 'no_reason' END, CASE WHEN len(list_distinct(w)) < len(w) THEN 'repeated_reason' END, CASE WHEN list_contains(w, 'NEW_REASON') THEN 'unknown_reason' END, CASE WHEN d = 'maybe' THEN 'unknown_decision' END,
  CASE WHEN d = 'eligible' AND len(w) < 5 THEN 'eligible_without_all_reasons' END, CASE WHEN d = 'ineligible' AND NOT list_contains(w, 'RETRACTED_OR_INVALID') THEN 'ineligible_without_exclusion' END, CASE WHEN d = 'uncertain' AND NOT list_contains(w, 'PAYLOAD_AMBIGUOUS') THEN 'uncertain_without_question' END,
  CASE WHEN d IN ('eligible', 'ineligible') AND NOT cited THEN 'decided_without_evidence' END, CASE WHEN x IN (0, 1) THEN 'explanation_length' END], lambda c: c IS NOT NULL)) AS code FROM r)
SELECT event_id AS paper, code, d AS record FROM f"""
)
def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Eligibility decisions whose reasons or evidence don't bear them out."""
    n = F.col("event_id")
    five, listed = n % 5, lambda *names: F.array(*map(F.lit, names))
    why = F.when(five == 0, listed(*contracts.POSITIVE)).when(five == 1, listed("RETRACTED_OR_INVALID")).when(five == 2, listed("PAYLOAD_AMBIGUOUS", "PAYLOAD_AMBIGUOUS")).when(five == 3, _none()).otherwise(listed("NEW_REASON"))
    told = F.when(n % 7 == 0, "").when(n % 7 == 1, F.repeat(F.lit("x"), F.lit(501))).otherwise("because")
    rows = read(spark, sf, "events").select(
        n.alias("paper"), _pick(("eligible", "ineligible", "uncertain", "maybe"), n % 4).alias("decision"), why.alias("reason_codes"), F.when(n % 3 > 0, listed("e1")).otherwise(_none()).alias("evidence_ids"), told.alias("explanation")
    )
    return contracts.eligibility_findings(rows)


@query(
    """WITH u AS (SELECT user_id, event_type, 1000 + event_id % 500 AS i, event_id % 300 AS c, event_id % 90 AS w, event_id % 41 AS o FROM events)
SELECT user_id, round(sum(greatest(0, i - c - w) * 3.0 + c * 0.3 + w * 3.75 + o * 15.0) / 1e6, 9) AS cost, sum(i + o)::BIGINT AS tokens, count(*) FILTER (event_type = 'purchase')::BIGINT AS accepted,
round(sum(greatest(0, i - c - w) * 3.0 + c * 0.3 + w * 3.75 + o * 15.0) / 1e6 / nullif(count(*) FILTER (event_type = 'purchase'), 0), 12) AS cost_per_accepted FROM u GROUP BY user_id"""
)
def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of regular, cached and written input tokens and of output, per paper and per accepted outcome, null-safe."""
    n = F.col("event_id")
    usage = read(spark, sf, "events").select("user_id", "event_type", (1000 + n % 500).alias("input"), (n % 300).alias("cached"), (n % 90).alias("written"), (n % 41).alias("output"))
    price = relate.token_cost("input", "cached", "written", "output", {"input": 3.0, "cached": 0.3, "written": 3.75, "output": 15.0})
    accepted = F.count_if(F.col("event_type") == "purchase")
    return usage.groupBy("user_id").agg(
        F.round(F.sum(price), 9).alias("cost"), F.sum(F.col("input") + F.col("output")).alias("tokens"), accepted.alias("accepted"), F.round(F.sum(price) / F.nullif(accepted, F.lit(0)), 12).alias("cost_per_accepted")
    )


@query(
    """SELECT line_no, line FROM (SELECT 0 AS line_no, '| p_partkey | p_name | p_type |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY p_partkey), '| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || '\\|x |' FROM part)"""
)
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table as numbered lines of a Markdown report."""
    rows = read(spark, sf, "part").withColumn("p_type", F.concat("p_type", F.lit("|x")))
    return sinks.report(rows, ["p_partkey", "p_name", "p_type"], ["p_partkey"])


@query(
    r"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Figure ' || turn || '. ' || text WHEN 1 THEN 'fig.S' || turn || ' ' || text WHEN 2 THEN 'Table 2 shows, as Table 3 does, ' || text ELSE text END AS text FROM conversations),
h AS (SELECT *, regexp_extract(text, '(?i)^\s*(?:fig(?:ure)?|table)\s*\.?\s*[A-Za-z0-9][A-Za-z0-9.-]*') AS head FROM t), r AS (SELECT *, ltrim(substr(text, length(head) + 1), ' ') AS rest FROM h)
SELECT conv_id, turn, CASE WHEN head <> '' THEN ends_with(head, '.') OR starts_with(rest, '.') OR (length(text) >= 120 AND NOT regexp_matches(substr(rest, 1, 90), '(?i)\b(?:fig(?:ure)?|table)\s*\.?\s*[A-Za-z0-9]')) END AS caption FROM r"""
)
def caption_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that begin with a figure or table label: captions, or texts that only refer to one."""
    turn, text = F.col("turn"), F.col("text")
    four = turn % 4
    shown = F.when(four == 0, F.concat(F.lit("Figure "), turn, F.lit(". "), text)).when(four == 1, F.concat(F.lit("fig.S"), turn, F.lit(" "), text)).when(four == 2, F.concat(F.lit("Table 2 shows, as Table 3 does, "), text)).otherwise(text)
    return read(spark, sf, "conversations").select("conv_id", "turn", contracts.caption_candidate(shown).alias("caption"))


@query(
    """WITH f AS (SELECT o_custkey AS paper, CASE o_orderkey % 3 WHEN 0 THEN 'Supp_' WHEN 1 THEN 'mmc' ELSE 'paper' END || o_orderkey || '.pdf' AS file, o_orderkey % 3 < 2 AS s, floor(o_totalprice / 10000)::BIGINT AS pages FROM orders)
SELECT paper, arg_min(file, (s, pages, file)) AS file FROM f GROUP BY paper"""
)
def main_article(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest file of a paper that isn't a supplement, if there is one."""
    three = F.col("o_orderkey") % 3
    name = F.concat(F.when(three == 0, "Supp_").when(three == 1, "mmc").otherwise("paper"), "o_orderkey", F.lit(".pdf"))
    return contracts.main_article(read(spark, sf, "orders").select(F.col("o_custkey").alias("paper"), name.alias("file"), F.floor(F.col("o_totalprice") / 10000).alias("pages")))


@query()
def neighbour_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbour bonus as a sequence: an earlier seed's bonus raises a later seed before its own turn."""
    from assayer.operators import retrieve
    from assayer.plans.matching import _fused

    return retrieve.neighbour_rounds(_fused(spark, sf), read(spark, sf, "embeddings").select("vec_id"), "query_id", "vec_id", 8)


TYPES, NAMES = ("cell", "lnp_component", "disease", "outcome"), ("hepatocytes", "ionizable lipid", "fibrosis", "uptake", "T and B cells", "mRNA lipid", "Healthy liver ", "a, b")
ALLOWED = (("expresses", "cell", "lnp_component"), ("treats", "lnp_component", "disease"), ("expresses", "disease", "outcome"), ("shows", "outcome", "cell"))
GRAPH = f"""{P}, e AS (SELECT paper, pos, 'N' || pos AS id, {list(TYPES)}[(pos % 4 + 1)::INT] AS type, {list(NAMES)}[(pos % 8 + 1)::INT] AS name FROM p),
k AS (SELECT paper, pos, 'K' || pos AS id, 'N' || (pos - 1) AS s, 'N' || pos AS o, ['expresses', 'treats', 'shows'][(pos % 3 + 1)::INT] AS predicate, CASE WHEN pos % 5 = 0 THEN 'SHARED' ELSE 'E' || (pos // 4) END AS x FROM p WHERE pos > 0),
s AS (SELECT paper, 'N' || pos AS owner, CASE WHEN pos % 11 = 10 THEN 'ghost' ELSE evidence_id END AS c, CASE WHEN pos % 7 = 6 THEN 'zq zq' ELSE '  ' || substr(text, 1, 12) END AS quote FROM p
  UNION ALL SELECT paper, 'N' || pos, paper || '-' || (pos + 1), '' FROM p WHERE pos % 2 = 0 AND (paper, pos + 1) IN (SELECT (paper, pos) FROM p) UNION ALL SELECT paper, 'K' || pos, evidence_id, '' FROM p WHERE pos > 0)"""


@query(
    f"""WITH {GRAPH}, t AS (SELECT s.*, p.text FROM s LEFT JOIN p ON p.paper = s.paper AND p.evidence_id = s.c),
u AS (SELECT k.*, a.type AS st, b.type AS ot FROM k LEFT JOIN e a ON a.paper = k.paper AND a.id = k.s LEFT JOIN e b ON b.paper = k.paper AND b.id = k.o)
SELECT DISTINCT * FROM (SELECT paper, owner, 'unknown_clause' AS issue FROM t WHERE text IS NULL UNION ALL SELECT paper, owner, 'non_verbatim_quote' FROM t WHERE NOT contains({NORM.format('text')}, {NORM.format('quote')})
UNION ALL SELECT paper, id, 'payload_as_component' FROM e WHERE type = 'lnp_component' AND name = 'mRNA lipid' UNION ALL SELECT paper, id, 'physiology_as_disease' FROM e WHERE type = 'disease' AND name = 'Healthy liver '
UNION ALL SELECT paper, id, 'merged_cell_entity' FROM e WHERE type = 'cell' AND name = 'T and B cells' UNION ALL SELECT paper, id, 'predicate_type_violation' FROM u WHERE coalesce((predicate, st, ot) NOT IN {ALLOWED}, true)
UNION ALL SELECT k.paper, k.id, 'evidence_outside_experiment_scope' FROM k WHERE x <> 'SHARED' AND pos % 4 = 3
UNION ALL SELECT k.paper, k.id, 'relation_entities_not_co_supported' FROM k WHERE NOT EXISTS (SELECT 1 FROM s a JOIN s b ON a.paper = b.paper AND a.c = b.c JOIN s d ON d.paper = a.paper AND d.c = a.c WHERE a.paper = k.paper AND a.owner = k.id AND b.owner = k.s AND d.owner = k.o)
UNION ALL SELECT DISTINCT paper, 'SHARED', 'reserved_shared_id_used_as_experiment' FROM p WHERE paper % 9 = 0)"""
)
def graph_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence graphs against the clauses that they cite."""
    rows, n = passages(spark, sf), F.col("pos")
    tag = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    entities = rows.select("paper", tag("N", n).alias("entity_id"), _pick(TYPES, n % 4).alias("entity_type"), _pick(NAMES, n % 8).alias("name"))
    claims = rows.where("pos > 0").select(
        "paper", tag("K", n).alias("claim_id"), tag("N", n - 1).alias("subject_id"), _pick(("expresses", "treats", "shows"), n % 3).alias("predicate"), tag("N", n).alias("object_id"),
        F.when(n % 5 == 0, "SHARED").otherwise(tag("E", F.floor(n / 4))).alias("experiment_id"),
    )
    quote = F.when(n % 7 == 6, "zq zq").otherwise(F.concat(F.lit("  "), F.substring("text", 1, 12)))
    own = rows.select("paper", tag("N", n).alias("owner"), F.when(n % 11 == 10, "ghost").otherwise(F.col("evidence_id")).alias("clause_id"), quote.alias("quote"))
    after = rows.select("paper", (n - 1).alias("pos"), "evidence_id").where("pos % 2 = 0").select("paper", tag("N", n).alias("owner"), F.col("evidence_id").alias("clause_id"), F.lit("").alias("quote"))
    said = rows.where("pos > 0").select("paper", tag("K", n).alias("owner"), F.col("evidence_id").alias("clause_id"), F.lit("").alias("quote"))
    scopes = rows.where("pos % 4 < 3").groupBy("paper", tag("E", F.floor(n / 4)).alias("experiment_id")).agg(F.collect_set("evidence_id").alias("clause_ids"))
    stray = rows.where("paper % 9 = 0").select("paper", F.lit("SHARED").alias("experiment_id"), _none().alias("clause_ids")).distinct()
    types = spark.createDataFrame(list(ALLOWED), "predicate string, subject_type string, object_type string")
    return graph.audit(entities, claims, own.unionByName(after).unionByName(said), rows.select("paper", F.col("evidence_id").alias("clause_id"), "text"), scopes.unionByName(stray), types)


@query(
    """WITH f AS (SELECT l_orderkey AS paper, CASE WHEN l_orderkey % 5 = 0 THEN 'O1' ELSE 'N' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) END AS k, l_orderkey % 3 = 0 AS stale FROM lineitem)
SELECT o_orderkey AS paper, 'O1' AS k FROM orders UNION ALL SELECT paper, k FROM f WHERE NOT stale AND paper % 5 > 0 AND paper IN (SELECT o_orderkey FROM orders)"""
)
def appended_records(spark: SparkSession, sf: str) -> DataFrame:
    """Recovered records appended to the results that they were made for."""
    from pyspark.sql import Window

    base = read(spark, sf, "orders").select(F.col("o_orderkey").alias("paper"), F.lit("O1").alias("k"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    paper = F.col("l_orderkey")
    rows = read(spark, sf, "lineitem").withColumn("n", F.row_number().over(order))
    rows = rows.select(paper.alias("paper"), F.when(paper % 5 == 0, "O1").otherwise(F.concat(F.lit("N"), "n")).alias("k"), F.when(paper % 3 == 0, "old").otherwise(F.sha2(paper.cast("string"), 256)).alias("digest"))
    return graph.appended(base, rows, "k", "digest")[0].select("paper", "k")
