"""Record-level queries: filters, enrichment, overlays, gates, freezes and reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import text as T
from assayer.operators import pack, relate, validate
from assayer.registry import query
from assayer.sources import sinks
from assayer.sources.tables import read


@query(
    """WITH bad AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.08), kept AS (SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM bad))
SELECT l_orderkey, count(*)::BIGINT AS claims, min(l_linenumber)::BIGINT AS first_claim FROM kept GROUP BY l_orderkey"""
)
def prune_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Unsupported relations go, and with them experiments that are left without any."""
    lines, keys = read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]
    kept = lines.join(lines.where("l_discount > 0.08").select(*keys), keys, "left_anti")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("claims"), F.min("l_linenumber").cast("long").alias("first_claim"))


@query("""SELECT page_id, regexp_extract(url, '[^/?#]+(?:[?#].*)?$') AS file, regexp_matches(url, 'html$') AND NOT regexp_matches(url, 'utm|ref') AS wanted FROM pages WHERE NOT regexp_matches(url, '/$')""")
def supplement_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Files chosen by name patterns."""
    url = F.col("url")
    return read(spark, sf, "pages").where(~url.rlike("/$")).select("page_id", F.regexp_extract(url, "[^/?#]+(?:[?#].*)?$", 0).alias("file"), (url.rlike("html$") & ~url.rlike("utm|ref")).alias("wanted"))


@query("""SELECT p_partkey, array_to_string(list_filter([p_name, p_size::VARCHAR, p_brand, p_partkey::VARCHAR], lambda x: NOT regexp_matches(x, '^[0-9]+$')), '; ') AS labels FROM part""")
def descriptive_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels without bare numbers."""
    labels = F.array("p_name", F.col("p_size").cast("string"), "p_brand", F.col("p_partkey").cast("string"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.filter(labels, lambda x: ~x.rlike("^[0-9]+$")), "; ").alias("labels"))


@query("""SELECT user_id, arg_min(event_type, r) AS strategy, min(r)::BIGINT AS rank FROM (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END AS r, value FROM events) WHERE r < 9 GROUP BY user_id""")
def first_successful_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """The first of ordered fallback strategies that worked."""
    r = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(9)
    rows = read(spark, sf, "events").withColumn("r", r).where("r < 9")
    return rows.groupBy("user_id").agg(F.min_by("event_type", "r").alias("strategy"), F.min("r").cast("long").alias("rank"))


@query(
    """WITH c AS (SELECT o_orderkey, c_custkey, pos, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS n FROM (
  SELECT DISTINCT o_orderkey, c_custkey, c_custkey AS pos FROM orders JOIN customer ON (o_custkey = c_custkey OR o_orderkey % 1000 = c_custkey)))
SELECT o_orderkey, c_custkey FROM c WHERE n = 1"""
)
def first_match(spark: SparkSession, sf: str) -> DataFrame:
    """Match on one key or another; the first item in order wins."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf, "customer").select("c_custkey")
    pairs = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey").unionByName(
        orders.join(customers, F.col("o_orderkey") % 1000 == F.col("c_custkey")).select("o_orderkey", "c_custkey")
    )
    return pairs.groupBy("o_orderkey").agg(F.min("c_custkey").alias("c_custkey"))


@query(
    """SELECT p_partkey, coalesce(a.v, b.v, p_name) AS title, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'base' END AS origin FROM part
LEFT JOIN (SELECT l_partkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a ON a.k = p_partkey LEFT JOIN (SELECT l_partkey AS k, max(l_linestatus) AS v FROM lineitem WHERE l_quantity < 3 GROUP BY 1) b ON b.k = p_partkey"""
)
def metadata_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Preferred source, then the second, then the base."""
    lines = read(spark, sf, "lineitem")
    side = lambda c, v, n: lines.where(c).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(v).alias(n))
    rows = read(spark, sf, "part").join(side("l_quantity > 49", "l_returnflag", "a"), "p_partkey", "left").join(side("l_quantity < 3", "l_linestatus", "b"), "p_partkey", "left")
    return rows.select("p_partkey", F.coalesce("a", "b", "p_name").alias("title"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("base").alias("origin"))


@query("""SELECT c.conv_id, c.turn, m.evidence FROM conversations c LEFT JOIN (SELECT lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS k, max(conv_id * 1000 + turn) AS evidence FROM conversations WHERE role = 'user' GROUP BY 1) m ON lower(trim(regexp_replace(c.text, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) = m.k""")
def context_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour text to evidence id by normalised text; the last of equal keys counts."""
    rows = read(spark, sf, "conversations").withColumn("k", T.normalise(F.col("text")))
    keys = rows.where("role = 'user'").groupBy("k").agg(F.max(F.col("conv_id") * 1000 + F.col("turn")).alias("evidence"))
    return rows.join(keys, "k", "left").select("conv_id", "turn", "evidence")


@query("""SELECT doc_id, 'corrected' AS origin FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'validated' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def corrected_override(spark: SparkSession, sf: str) -> DataFrame:
    """A corrected file suppresses the validated one."""
    corrected = read(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("corrected").alias("origin"))
    return relate.replace_rows(read(spark, sf, "documents").select("doc_id", F.lit("validated").alias("origin")), corrected, ["doc_id"])


@query(
    """WITH e AS (SELECT user_id, event_type = 'error' AS missed, value > 20 AS retrieved FROM events)
SELECT CASE WHEN NOT missed THEN 'recovered' WHEN retrieved THEN 'retrieved_but_missed' ELSE 'not_retrieved' END AS class, count(*)::BIGINT AS n,
round((SELECT count(*) FILTER (NOT missed) / greatest(1, count(*) FILTER (NOT missed OR retrieved)) FROM e), 4) AS conditional_recall FROM e GROUP BY 1"""
)
def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Error classes and recall given retrieval."""
    missed, retrieved = F.col("event_type") == "error", F.col("value") > 20
    kind = F.when(~missed, "recovered").when(retrieved, "retrieved_but_missed").otherwise("not_retrieved").alias("class")
    rows = read(spark, sf, "events").groupBy(kind).agg(F.count("*").alias("n"))
    total = rows.agg((F.sum(F.when(F.col("class") == "recovered", F.col("n"))) / F.greatest(F.lit(1), F.sum(F.when(F.col("class") != "not_retrieved", F.col("n"))))).alias("r"))
    return rows.join(F.broadcast(total)).select("class", "n", F.round("r", 4).alias("conditional_recall"))


@query(
    """WITH g AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS v FROM part), x AS (SELECT l_partkey, l_orderkey, l_linenumber,
  regexp_replace(lower(CASE l_linenumber % 3 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN substr(p_name, 3) ELSE p_brand END), '[^a-z0-9]', '', 'g') AS v FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT p_partkey, count(DISTINCT l_orderkey || '-' || l_linenumber) FILTER (g.v <> '' AND x.v <> '' AND (contains(x.v, g.v) OR contains(g.v, x.v)))::BIGINT AS correct, count(x.l_orderkey)::BIGINT AS records, bool_or(g.v <> '' AND x.v <> '' AND (contains(x.v, g.v) OR contains(g.v, x.v))) IS TRUE AS found
FROM g LEFT JOIN x ON p_partkey = l_partkey GROUP BY p_partkey"""
)
def containment_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Values match if either whole normalised string contains the other."""
    part = read(spark, sf, "part")
    gold = part.select("p_partkey", T.alphanumeric(F.col("p_name")).alias("g"))
    three = F.col("l_linenumber") % 3
    value = F.when(three == 0, F.concat_ws(" ", "p_name", "p_brand")).when(three == 1, F.expr("substring(p_name, 3)")).otherwise(F.col("p_brand"))
    found = read(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record"), T.alphanumeric(value).alias("v"))
    rows = gold.join(found, "p_partkey", "left")
    hit = (F.col("g") != "") & (F.col("v") != "") & (F.col("v").contains(F.col("g")) | F.col("g").contains(F.col("v")))
    return rows.groupBy("p_partkey").agg(F.count_distinct(F.when(hit, F.col("record"))).alias("correct"), F.count("record").alias("records"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


@query(
    """SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F') / greatest(1, count(*) FILTER (o_orderstatus IN ('F', 'O'))), 4) AS precision_, round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 4) AS coverage FROM orders GROUP BY 1"""
)
def graph_review_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Precision over decided claims and coverage of the review."""
    s = F.col("o_orderstatus")
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.round(F.count_if(s == "F") / F.greatest(F.lit(1), F.count_if(s.isin("F", "O"))), 4).alias("precision_"), F.round(F.count_if(s != "P") / F.count("*"), 4).alias("coverage")
    )


@query("""SELECT n_name || '@a' AS id, n_regionkey::BIGINT AS region FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_name || '@b', n_regionkey FROM nation WHERE n_nationkey >= 10""")
def namespaced_union(spark: SparkSession, sf: str) -> DataFrame:
    """Ids get their run's suffix before the union, so that none collide."""
    part = lambda c, n: read(spark, sf, "nation").where(c).select(F.concat("n_name", F.lit("@" + n)).alias("id"), F.col("n_regionkey").cast("long").alias("region"))
    return part("n_nationkey < 15", "a").unionByName(part("n_nationkey >= 10", "b"))


@query(
    """SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v) AS n FROM (SELECT 's' || s_suppkey AS k, s_name AS v, 0 AS p FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 's' || s_suppkey, 'corpus', 1 FROM supplier
UNION ALL SELECT 's' || (s_suppkey + 5), 'alias', 2 FROM supplier)) WHERE n = 1"""
)
def alias_map(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence texts by priority; aliases never displace a real id."""
    s = read(spark, sf, "supplier")
    key = lambda c: F.concat(F.lit("s"), c).alias("k")
    parts = [("0", s.where("s_suppkey % 2 = 0").select(key(F.col("s_suppkey")), F.col("s_name").alias("v"))), ("1", s.select(key(F.col("s_suppkey")), F.lit("corpus").alias("v"))), ("2", s.select(key(F.col("s_suppkey") + 5), F.lit("alias").alias("v")))]
    return relate.first_wins(parts, ["k"], ["v"]).select("k", "v")


@query("""SELECT o_orderkey, 'E' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS frozen_id FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def boundary_freeze(spark: SparkSession, sf: str) -> DataFrame:
    """Ids renumbered under the chosen reader of each paper."""
    chosen = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, sf, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey", T.numbered("E", n).alias("frozen_id"))


@query("""SELECT conv_id, 'V' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS outcome_id, turn FROM conversations WHERE role = 'assistant' AND NOT contains(text, '?')""")
def observation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved observations become rows with fresh ids."""
    rows = read(spark, sf, "conversations").where((F.col("role") == "assistant") & ~F.col("text").contains("?"))
    return rows.select("conv_id", F.concat(F.lit("V"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("outcome_id"), "turn")


@query(
    """WITH c AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN substr(text, 3, 50) WHEN 1 THEN 'q' || substr(text, 3, 50) WHEN 2 THEN text || '!' ELSE '' END AS quote, CASE WHEN turn % 8 <> 1 THEN text END AS clause FROM conversations)
SELECT conv_id, turn, CASE WHEN clause IS NULL THEN 'dropped' WHEN quote <> '' AND contains(clause, quote) THEN 'verbatim' ELSE 'replaced' END AS quote_state, CASE WHEN clause IS NULL THEN NULL WHEN quote <> '' AND contains(clause, quote) THEN sha256(quote) ELSE sha256(clause) END AS digest FROM c"""
)
def quote_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Whole quotes that are verbatim stay, others are replaced by the cited clause, or dropped without one."""
    text, four = F.col("text"), F.col("turn") % 4
    quote = F.when(four == 0, F.substring(text, 3, 50)).when(four == 1, F.concat(F.lit("q"), F.substring(text, 3, 50))).when(four == 2, F.concat(text, F.lit("!"))).otherwise("")
    rows = read(spark, sf, "conversations").select("conv_id", "turn", quote.alias("quote"), F.when(F.col("turn") % 8 != 1, text).alias("clause"))
    state, kept = validate.repaired_quote(F.col("quote"), F.col("clause"))
    return rows.select("conv_id", "turn", state.alias("quote_state"), F.sha2(kept, 256).alias("digest"))


@query("""SELECT 'outcome_value' AS rule, l_orderkey AS k FROM lineitem WHERE l_tax IS NULL OR l_tax > 0.07 UNION ALL SELECT 'status_enum', o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'percent_range', l_orderkey FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09""")
def check_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """CHECK rules as assertions."""
    lines, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    row = lambda df, c, n, k: df.where(c).select(F.lit(n).alias("rule"), F.col(k).alias("k"))
    return row(lines, "l_tax is null or l_tax > 0.07", "outcome_value", "l_orderkey").unionByName(row(orders, "o_orderstatus not in ('F', 'O')", "status_enum", "o_orderkey")).unionByName(
        row(lines, "not l_discount between 0 and 0.09", "percent_range", "l_orderkey")
    )


@query("""SELECT source, count(*)::BIGINT AS full_rows, count(*) FILTER (n_chars < 2000)::BIGINT AS compact_rows, round(sum(n_chars) / greatest(1, sum(n_chars) FILTER (n_chars < 2000)), 4) AS ratio FROM documents GROUP BY source""")
def packet_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Full against budgeted views."""
    short = F.col("n_chars") < 2000
    return read(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("full_rows"), F.count_if(short).alias("compact_rows"), F.round(F.sum("n_chars") / F.greatest(F.lit(1), F.sum(F.when(short, F.col("n_chars")))), 4).alias("ratio")
    )


@query(
    """WITH m AS (SELECT item_id, item_id % 50 AS p FROM benchmark WHERE item_id NOT IN (SELECT b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))) SELECT DISTINCT page FROM (SELECT unnest(range(p - 1, p + 2)) AS page FROM m) WHERE page >= 0"""
)
def focused_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages around missed gold rows."""
    from assayer.plans.relational import anchor_containment

    missed = read(spark, sf, "benchmark").join(anchor_containment(spark, sf).select("item_id").distinct(), "item_id", "left_anti").select((F.col("item_id") % 50).alias("p"))
    return missed.select(F.explode(F.sequence(F.col("p") - 1, F.col("p") + 1)).alias("page")).where("page >= 0").distinct()


@query("""SELECT source, list_aggregate(list_sort(list(doc_id)), 'string_agg', ',') AS closest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(n_chars - 1000), doc_id) AS n FROM documents) WHERE n <= 5 GROUP BY source""")
def capped_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The five closest rows of a group as one list."""
    best = pack.top(read(spark, sf, "documents").withColumn("far", F.abs(F.col("n_chars") - 1000)), ["source"], ["far", "doc_id"], 5)
    return best.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("closest"))


@query("""SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'skipped' WHEN item_id % 3 = 0 THEN 'changed' ELSE 'saved' END AS state, CASE WHEN item_id % 5 <> 0 THEN sha256(text) END AS digest, 'img_' || item_id || '.png' AS file FROM benchmark""")
def content_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads in base64, saved under flat names with their digest; undecodable ones are skipped, others re-checked."""
    payload = F.when(F.col("item_id") % 5 == 0, "not base64!").otherwise(F.base64(F.encode("text", "utf-8")))
    recorded = F.sha2(F.when(F.col("item_id") % 3 == 0, F.lower("text")).otherwise(F.col("text")), 256)
    recorded = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("0"), recorded)).otherwise(recorded)
    rows = read(spark, sf, "benchmark").select("item_id", payload.alias("payload"), recorded.alias("recorded"), F.concat(F.lit("images/page/img_"), "item_id", F.lit(".png")).alias("ref"))
    return sinks.images(rows, "payload", "ref", "recorded").select("item_id", "state", "digest", "file")
