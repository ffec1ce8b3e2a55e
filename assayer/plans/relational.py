"""Joins, aggregations, windows and set operations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import text as T
from assayer.operators import contain, dedup, merge, pack, relate
from assayer.registry import query
from assayer.sources import sinks
from assayer.sources.tables import read


@query(
    """SELECT n_name, count(*)::BIGINT AS records, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def outcome_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Equi chain outcome to experiment to paper."""
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(relate.checked(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("records"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("value"))


@query("""SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, CASE WHEN l.doc_id IS NULL THEN 'not_run' WHEN l.toxic = 1 THEN 'failed' ELSE 'passed' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def hit_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Left join with reconstruction; not run differs from passed."""
    labels = read(spark, sf, "labels").withColumn("_seen", F.lit(True))
    state = F.when(F.col("_seen").isNull(), "not_run").when(F.col("toxic") == 1, "failed").otherwise("passed")
    return read(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), state.alias("state"))


@query("""SELECT DISTINCT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''""")
def anchor_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Whole anchors contained in whole passages, by equi-joins on runs of words."""
    return contain.containing(read(spark, sf, "documents"), "doc_id", "text", read(spark, sf, "benchmark"), "item_id", "text")


@query(
    """SELECT 'order_customer' AS code, o_orderkey::VARCHAR AS record FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'line_part', l_orderkey::VARCHAR FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)"""
)
def reference_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Foreign-key findings: anti joins over several tables in one list."""
    customers = read(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    orders = relate.missing(read(spark, sf, "orders"), "o_custkey", customers, "c_custkey", "order_customer", "o_orderkey")
    parts = read(spark, sf, "part").where("p_size > 5").select("p_partkey")
    return orders.unionByName(relate.missing(read(spark, sf, "lineitem"), "l_partkey", parts, "p_partkey", "line_part", "l_orderkey"))


@query("""SELECT l_orderkey, count(*)::BIGINT AS members FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(*) FILTER (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000))""")
def relational_division(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that cite allowed members only."""
    return relate.divide(read(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", read(spark, sf, "supplier").where("s_acctbal > 2000").select("s_suppkey"))


@query(
    """SELECT a.conv_id, a.turn, (b.turn - a.turn)::BIGINT AS "offset", b.turn AS neighbour FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND a.turn <> b.turn"""
)
def neighbour_band(spark: SparkSession, sf: str) -> DataFrame:
    """Positional band join within a conversation, spread to an equi-join."""
    return relate.neighbours(read(spark, sf, "conversations"), "conv_id", "turn", 2)


@query(
    """WITH e AS (SELECT DISTINCT o_orderkey AS k, i AS slot FROM orders, (SELECT unnest(range(1, 8)) AS i)), a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber::BIGINT AS slot FROM lineitem)
SELECT coalesce(e.k, a.k) AS k, coalesce(e.slot, a.slot) AS slot, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'answered' END AS state FROM e FULL JOIN a ON e.k = a.k AND e.slot = a.slot"""
)
def slot_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Expected against present slots: every order has seven line numbers."""
    expected = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("slot"))
    present = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("slot"))
    return relate.slots(expected, present, ["k", "slot"])


@query(
    """SELECT event_type, user_id, CASE WHEN count(DISTINCT b) = 1 THEN min(b) END AS b, CASE count(DISTINCT b) WHEN 0 THEN 'no source' WHEN 1 THEN 'resolved' ELSE 'ambiguous source' END AS reason
FROM (SELECT event_type, user_id, CASE WHEN value > 50 THEN event_type || (user_id % 2) || (event_id % 3 = 0)::INT END AS b FROM events) GROUP BY ALL"""
)
def unique_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A group resolves if it has exactly one distinct source; otherwise the reason is told."""
    b = F.when(F.col("value") > 50, F.concat("event_type", F.col("user_id") % 2, (F.col("event_id") % 3 == 0).cast("int")))
    rows = read(spark, sf, "events").withColumn("b", b)
    return relate.unique_or_reason(rows, ["event_type", "user_id"], "b")


@query(
    """SELECT source, CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'source' END AS grain, count(*)::BIGINT AS passages, count(l.doc_id)::BIGINT AS labelled,
round(count(*) FILTER (quality = 1) / greatest(1, count(l.doc_id)), 4) AS rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (source)"""
)
def conditional_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Guarded rates per source and overall in one pass."""
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels").withColumn("_l", F.lit(1)), "doc_id", "left")
    labelled = F.count("_l")
    return rows.rollup("source").agg(
        F.when(F.grouping("source") == 1, "all").otherwise("source").alias("grain"), F.count("*").alias("passages"), labelled.alias("labelled"),
        F.round(F.count_if(F.col("quality") == 1) / F.greatest(F.lit(1), labelled), 4).alias("rate"),
    )


@query(
    """WITH e AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT event_type, count(*)::BIGINT AS members, count(*) FILTER (n > 1)::BIGINT AS in_several FROM e JOIN (SELECT user_id, count(*) AS n FROM e GROUP BY user_id) USING (user_id) GROUP BY event_type"""
)
def search_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Members per category, and those in several."""
    per = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return per.select(F.size("s").alias("n"), F.explode("s").alias("event_type")).groupBy("event_type").agg(F.count("*").alias("members"), F.count_if(F.col("n") > 1).alias("in_several"))


@query("""SELECT o_custkey, count(*)::BIGINT AS copies FROM orders GROUP BY o_custkey HAVING count(*) > 12""")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that occur too often."""
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("copies")).where("copies > 12")


@query(
    """SELECT l_orderkey, CASE WHEN max(l_returnflag) <> 'N' THEN true WHEN count(*) FILTER (l_quantity IS NULL) > 0 THEN false ELSE sum(l_quantity) BETWEEN 98 AND 102 END AS passes, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY l_orderkey"""
)
def composition_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Composition totals: only complete percentage compositions are held to about 100."""
    total = F.sum("l_quantity")
    passes = F.when(F.max("l_returnflag") != "N", True).when(F.count_if(F.col("l_quantity").isNull()) > 0, False).otherwise(total.between(98, 102))
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(passes.alias("passes"), F.round(total, 4).alias("total"))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) SELECT token, count(*)::BIGINT AS documents, count(*) <= 2 AS rare FROM t GROUP BY token""")
def token_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per token; tokens of one or two documents are rare."""
    rows = read(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("documents")).withColumn("rare", F.col("documents") <= 2)


@query(
    """SELECT o_custkey, o_orderpriority, CASE WHEN count(*) = 1 THEN 'single_source' WHEN count(DISTINCT o_orderstatus) > 1 THEN 'conflict' ELSE 'complementary' END AS merge_class, count(*)::BIGINT AS records,
count(DISTINCT o_orderstatus) > 1 OR count(*) > 3 AS needs_review FROM orders GROUP BY ALL"""
)
def conflict_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Merge of several sources by a composite key, classified."""
    kinds = F.count_distinct("o_orderstatus")
    state = F.when(F.count("*") == 1, "single_source").when(kinds > 1, "conflict").otherwise("complementary")
    return read(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(state.alias("merge_class"), F.count("*").alias("records"), ((kinds > 1) | (F.count("*") > 3)).alias("needs_review"))


@query(
    """SELECT user_id, CASE WHEN bool_or(event_type = 'error') AND count(DISTINCT event_type) < 5 THEN 'contradicted' WHEN count(DISTINCT event_type) >= 4 THEN 'verified' ELSE 'unverified' END AS verdict, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS readers FROM events GROUP BY user_id"""
)
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict from the set of corroborating readers."""
    n = F.count_distinct("event_type")
    verdict = F.when(F.bool_or(F.col("event_type") == "error") & (n < 5), "contradicted").when(n >= 4, "verified").otherwise("unverified")
    return read(spark, sf, "events").groupBy("user_id").agg(verdict.alias("verdict"), T.joined_set(F.collect_set("event_type")).alias("readers"))


@query(
    """WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority[1:1]) AS have FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_sort(list_filter(['1', '2', '3', '4', '5'], lambda x: NOT list_contains(have, x))), ',') AS missing FROM s WHERE NOT list_has_all(have, ['1', '2', '3', '4', '5'])"""
)
def incomplete_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups without all required labels."""
    rows = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("have"))
    lack = F.array_except(F.array(*map(F.lit, "12345")), "have")
    return rows.where(F.size(lack) > 0).select("o_custkey", F.array_join(F.array_sort(lack), ",").alias("missing"))


@query(
    """WITH d AS (SELECT doc_id, source, text, n_chars, lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS norm FROM documents), f AS (SELECT min(doc_id) AS doc_id FROM d GROUP BY norm),
k AS (SELECT doc_id FROM (SELECT doc_id, sum(ceil(strlen(text) / 4.0)) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS used FROM d WHERE doc_id IN (SELECT doc_id FROM f)) WHERE used <= 16000),
h AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN d ON contains(d.text, b.text))
SELECT b.item_id, count(h.doc_id) > 0 AS before, count(f.doc_id) > 0 AS after_dedup, count(k.doc_id) > 0 AS in_budget
FROM benchmark b LEFT JOIN h USING (item_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY b.item_id"""
)
def preservation_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Gold passages before dedup, after it, and in each source's budget, which the shortest texts fill."""
    docs = read(spark, sf, "documents")
    firsts = dedup.exact(docs, T.normalise(F.col("text")), ["doc_id"], {}, ["doc_id"]).select(F.col("first_doc_id").alias("doc_id"))
    rows = docs.select("doc_id", "source", (-F.col("n_chars")).alias("short"), T.token_estimate(F.col("text")).alias("cost")).join(firsts, "doc_id", "left_semi")
    packed = pack.greedy_budget(rows, "source", "doc_id", "short", "cost", 16000).select("doc_id", F.lit(True).alias("k"))
    hits = anchor_containment(spark, sf).join(firsts.withColumn("d", F.lit(True)), "doc_id", "left").join(packed, "doc_id", "left")
    found = hits.groupBy("item_id").agg(F.lit(True).alias("b"), F.bool_or("d").alias("d"), F.bool_or("k").alias("k"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return read(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left").select("item_id", yes("b").alias("before"), yes("d").alias("after_dedup"), yes("k").alias("in_budget"))


@query(
    """WITH h AS (SELECT DISTINCT b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT CASE WHEN grouping(s) = 1 THEN 'all' ELSE s END AS split, count(*)::BIGINT AS gold, count(h.item_id)::BIGINT AS found, round(count(h.item_id) / count(*), 4) AS recall
FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'development' ELSE 'holdout' END AS s FROM benchmark) LEFT JOIN h USING (item_id) GROUP BY ROLLUP (s)"""
)
def recall_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Recall overall and by split."""
    gold = read(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "development").otherwise("holdout").alias("s"))
    rows = gold.join(anchor_containment(spark, sf).select("item_id", F.lit(1).alias("hit")).distinct(), "item_id", "left")
    out = rows.rollup("s").agg(F.grouping("s").alias("g"), F.count("*").alias("gold"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("s")).alias("split"), "gold", "found", "recall")


@query("""SELECT o_orderkey, o_custkey || '-' || o_orderstatus || CASE WHEN n > 1 THEN 'x' || n ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)""")
def ordinal_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Minted anchors with a suffix from the second occurrence on."""
    n = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    rows = read(spark, sf, "orders").withColumn("n", n)
    return rows.select("o_orderkey", F.concat("o_custkey", F.lit("-"), "o_orderstatus", F.when(F.col("n") > 1, F.concat(F.lit("x"), "n")).otherwise("")).alias("anchor"))


@query(
    """SELECT conv_id, turn, least(length(text), 1500 - before)::BIGINT AS granted FROM (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 1500"""
)
def char_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Turns within a character budget, the last one cut."""
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return pack.prefix_budget(rows, ["conv_id"], ["turn"], "n", 1500).select("conv_id", "turn", F.col("granted").cast("long").alias("granted"))


@query(
    """WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations)
SELECT DISTINCT conv_id, p AS page FROM (SELECT conv_id, unnest(range(turn - 1, turn + 2)) AS p FROM s WHERE r <= 2) WHERE p >= 0"""
)
def page_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Pages around the best ones of each group."""
    best = pack.top(read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n")), ["conv_id"], [F.desc("n"), "turn"], 2)
    return best.select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("page")).where("page >= 0").distinct()


@query("""SELECT o_orderkey, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) / 4)::BIGINT AS bundle FROM orders""")
def task_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-size bundles per group."""
    return pack.bundles(read(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "bundle")


@query(
    """WITH u AS (SELECT DISTINCT user_id, event_id % 31 AS k FROM events), r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS n FROM u)
SELECT user_id, coalesce(min(n) FILTER (k <> n), count(*))::BIGINT AS first_unused FROM r GROUP BY user_id"""
)
def unused_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest number from 0 on that a group hasn't used, whatever the numbers' range."""
    return relate.first_unused(read(spark, sf, "events").withColumn("k", F.col("event_id") % 31), "user_id", "k")


@query(
    """WITH r AS (SELECT doc_id, source, n_chars, ceil(strlen(text) / 4.0)::BIGINT AS c, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents),
w AS (SELECT source, list(struct_pack(k := doc_id, c := c) ORDER BY i) AS items FROM r GROUP BY source),
f AS (SELECT source, list_reduce(list_prepend(struct_pack(used := 0::BIGINT, got := []::BIGINT[]), list_transform(items, lambda x: struct_pack(used := x.c, got := [x.k]))),
  lambda a, x: CASE WHEN a.used + x.used <= 16000 THEN struct_pack(used := a.used + x.used, got := list_concat(a.got, x.got)) ELSE a END) AS s FROM w)
SELECT source, doc_id, cost FROM (SELECT source, unnest(s.got) AS doc_id FROM f) JOIN (SELECT doc_id, c AS cost FROM r) USING (doc_id)"""
)
def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy selection under a token budget that skips what doesn't fit."""
    rows = read(spark, sf, "documents").select("source", "doc_id", "n_chars", T.token_estimate(F.col("text")).alias("cost"))
    return pack.greedy_budget(rows, "source", "doc_id", "n_chars", "cost", 16000)


@query(
    """WITH c AS (SELECT conv_id, turn, length(text) AS n, ceil(length(text) / 4.0)::BIGINT AS cost FROM conversations),
i AS (SELECT c.conv_id, c.turn, c.n, CASE WHEN b.turn IS NULL THEN [struct_pack(k := c.turn, v := c.cost)] ELSE [struct_pack(k := c.turn, v := c.cost), struct_pack(k := b.turn, v := b.cost)] END AS parts FROM c LEFT JOIN c b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1),
w AS (SELECT conv_id, list(struct_pack(used := 0::BIGINT, paid := parts) ORDER BY n DESC, turn) AS items FROM i GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_prepend(struct_pack(used := 0::BIGINT, paid := []::STRUCT(k BIGINT, v BIGINT)[]), items), lambda a, x:
  CASE WHEN len(list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k))) > 0
        AND a.used + list_sum(list_transform(list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k)), lambda y: y.v)) <= 400
    THEN struct_pack(used := (a.used + list_sum(list_transform(list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k)), lambda y: y.v)))::BIGINT, paid := list_concat(a.paid, list_filter(x.paid, lambda y: NOT list_contains(list_transform(a.paid, lambda z: z.k), y.k))))
    ELSE a END) AS s FROM w)
SELECT conv_id, unnest(list_transform(s.paid, lambda z: z.k)) AS turn FROM f"""
)
def closure_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy selection whose cost includes shared context rows, paid once."""
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.ceil(F.length("text") / 4).cast("long").alias("cost"), (F.col("turn") - 1).alias("parent"))
    return pack.closure_budget(rows, "conv_id", "turn", "n", "cost", "parent", 400)


@query("""SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (contains(text, 'the'))::INT + (contains(text, 'and'))::INT + (contains(text, 'ing'))::INT DESC, turn DESC)::BIGINT AS rank FROM conversations) WHERE rank <= 3""")
def visual_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Objects by the number of query terms they contain; ties by descending id."""
    n = sum((F.col("text").contains(t).cast("int") for t in ("the", "and", "ing")), F.lit(0))
    return pack.top(read(spark, sf, "conversations").withColumn("n", n), ["conv_id"], [F.desc("n"), F.desc("turn")], 3).select("conv_id", "turn", "rank")


@query(
    """WITH u AS (SELECT *, 'a' AS source_run, 0 AS p FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, 'b', 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, o_custkey, o_orderpriority, source_run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY p, o_orderkey) AS n FROM u) WHERE n = 1"""
)
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union distinct of runs; the first run wins and is named."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return relate.first_wins([("a", orders.where("o_orderkey % 2 = 0")), ("b", orders.where("o_orderkey % 3 = 0"))], ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query(
    """WITH u AS (SELECT o_custkey || ':' || o_orderpriority AS id, 0 AS p, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey || ':' || o_orderpriority, 1, o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
SELECT CASE WHEN n = 1 THEN id ELSE id || '-' || n END AS new_id, o_orderkey, p::BIGINT AS run FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, o_orderkey) AS n FROM u)"""
)
def collision_rename(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that collide get -2, -3 and so on, in run order."""
    part = lambda m, p: read(spark, sf, "orders").where(f"o_orderkey % {m} = 0").select(F.concat_ws(":", "o_custkey", "o_orderpriority").alias("id"), F.lit(p).cast("long").alias("run"), "o_orderkey")
    rows = part(2, 0).unionByName(part(3, 1)).withColumn("paper", F.substring_index("id", ":", 1))
    return merge.rename_collisions(rows, "paper", "id", ["run", "o_orderkey"]).select("new_id", "o_orderkey", "run")


@query("""(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT c_custkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT o_custkey FROM orders)""")
def set_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Except and intersect."""
    customers, used = read(spark, sf, "customer"), read(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    key = F.col("c_custkey").alias("k")
    return customers.select(key).subtract(used).unionAll(customers.where("c_acctbal > 9000").select(key).intersect(used))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM documents""")
def crop_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First row with the same content digest."""
    rows = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedup.canonical_first(rows, ["digest"], "doc_id").select("doc_id", "canonical")


@query("""SELECT doc_id, 'retrieval' AS tag FROM labels UNION ALL SELECT doc_id, 'full_corpus' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def view_union(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved rows, then the rest of the corpus."""
    hits = read(spark, sf, "labels").select("doc_id", F.lit("retrieval").alias("tag"))
    return hits.unionByName(read(spark, sf, "documents").select("doc_id", F.lit("full_corpus").alias("tag")).join(hits.select("doc_id"), "doc_id", "left_anti"))


@query(
    """WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS s, o_totalprice AS v FROM orders)
SELECT new.k, CASE WHEN old.k IS NULL THEN 'created' WHEN old.s = new.s AND old.v = new.v THEN 'unchanged' ELSE 'versioned' END AS status FROM new LEFT JOIN old USING (k)"""
)
def converge_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Status of proposed rows against what exists, by fingerprint."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    new = rows.withColumn("s", F.when(F.col("k") % 5 == 0, "Z").otherwise(F.col("s")))
    return sinks.converge(rows.where("k % 2 = 0"), new, ["k"], ["s", "v"], version=True).select("k", "status")


@query(
    """SELECT o_orderkey, o_orderstatus, 'old' AS origin FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 UNION ALL SELECT o_orderkey, 'N', 'new' FROM orders WHERE o_orderkey % 3 = 0"""
)
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key is written anew are replaced."""
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit("old").alias("origin"))
    new = rows.where("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("N"), "origin": F.lit("new")})
    return relate.replace_rows(rows.where("o_orderkey % 2 = 0"), new, ["o_orderkey"])


@query(
    """WITH h AS (SELECT user_id, date_trunc('day', ts) AS day, count(*)::BIGINT AS attempts, count(*) FILTER (event_type = 'error')::BIGINT AS failures, min(event_id)::BIGINT AS first_event FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, attempts, failures, first_event FROM h"""
)
def attempt_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts and failures per user and day."""
    return read(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"), F.min("event_id").alias("first_event")
    )


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert of run results by key; the last write wins."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id", "value")


@query(
    """SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY f) AS first_seen FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY ALL) GROUP BY o_custkey"""
)
def grouped_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values of a group in the order they were first seen."""
    rows = read(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("f"))
    seen = F.transform(F.sort_array(F.collect_list(F.struct("f", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return rows.groupBy("o_custkey").agg(F.array_join(seen, "|").alias("first_seen"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS rows FROM {t}" for t in ("orders", "lineitem", "documents", "pages")))
def table_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Tables and their row counts."""
    from assayer.sources.tables import inspect

    return inspect(spark, sf, ("orders", "lineitem", "documents", "pages"))
