"""Validation, review, consensus and migration queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assayer.functions import text as X
from assayer.operators import contain, validate
from assayer.registry import query
from assayer.sources import tables
from assayer.sources.tables import read


@query(
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS v, CASE WHEN event_id % 7 = 0 THEN 'missing' ELSE 'reported' END AS status, CASE WHEN event_id % 14 = 0 THEN 'not stated' END AS reason FROM events),
b AS (SELECT event_id, NOT coalesce(CASE WHEN status = 'reported' THEN v IS NOT NULL AND reason IS NULL ELSE v IS NULL AND reason IS NOT NULL END, false) AS bad, v < 0 OR v > 100 AS range_ FROM r),
f AS (SELECT event_id, 'reported_missing' AS code FROM b WHERE bad UNION ALL SELECT event_id, 'out_of_range' FROM b WHERE range_)
SELECT 'F-' || substr(sha256(code || ':' || event_id), 1, 12) AS finding_id, code, event_id::VARCHAR AS record FROM f"""
)
def contract_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the reported-or-missing rule and of value ranges, with hash ids."""
    n = F.col("event_id")
    v = F.when(n % 11 != 0, F.col("value"))
    status, reason = F.when(n % 7 == 0, "missing").otherwise("reported"), F.when(n % 14 == 0, "not stated")
    rules = {"reported_missing": validate.reported(v, status, reason, F.array()), "out_of_range": (v < 0) | (v > 100)}
    return validate.findings(read(spark, sf, "events"), n, rules)


@query(
    """WITH g AS (SELECT o_custkey, bool_and(o_totalprice > 0) AS positive, count(*) FILTER (o_orderstatus = 'F') AS excluded, count(*) FILTER (o_orderstatus = 'P') AS uncertain FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN NOT positive THEN 'invalid' WHEN excluded > 5 THEN 'exclude' WHEN uncertain > 0 THEN 'manual_review' ELSE 'include' END AS decision FROM g"""
)
def screening_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered screening precedence."""
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.bool_and(F.col("o_totalprice") > 0).alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("x"), F.count_if(F.col("o_orderstatus") == "P").alias("u")
    )
    return g.select("o_custkey", F.when(~F.col("p"), "invalid").when(F.col("x") > 5, "exclude").when(F.col("u") > 0, "manual_review").otherwise("include").alias("decision"))


@query(
    """WITH k AS (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0), c AS (SELECT l_orderkey, count(*) AS n, count(k.p_partkey) AS m FROM lineitem LEFT JOIN k ON l_partkey = k.p_partkey GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN c.n IS NULL THEN 'dropped_uncited' WHEN m < n THEN 'dropped_unknown_citation' ELSE 'kept' END AS salvage FROM orders LEFT JOIN c ON o_orderkey = l_orderkey"""
)
def record_salvage(spark: SparkSession, sf: str) -> DataFrame:
    """Valid records stay, records with unknown citations go whole."""
    cites = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("cites"))
    rows = read(spark, sf, "orders").select("o_orderkey").join(cites, "o_orderkey", "left")
    return validate.salvage(rows, "o_orderkey", "cites", read(spark, sf, "part").where("p_partkey % 9 <> 0").select("p_partkey")).select("o_orderkey", "salvage")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN 'none' WHEN o_orderkey % 8 = 0 THEN 'applied' ELSE 'stale' END AS patch FROM orders"""
)
def guarded_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Field patches guarded by the digest of what they were made for."""
    base = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.sha2(F.concat_ws(":", "o_orderkey", "o_totalprice"), 256).alias("digest"))
    patches = base.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, F.col("digest")).otherwise("old").alias("digest"), F.lit("X").alias("new_value"))
    return validate.guarded_patch(base, patches, ["o_orderkey"], "digest", "o_orderstatus").select("o_orderkey", "o_orderstatus", "patch")


@query("""SELECT d.doc_id, coalesce(n, 0)::BIGINT AS decisions, coalesce(n, 0) = 1 AS ok FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id) USING (doc_id)""")
def dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate needs exactly one disposition."""
    labels = read(spark, sf, "labels")
    return validate.dispositions(read(spark, sf, "documents"), labels.select("doc_id").unionAll(labels.where("toxic = 1").select("doc_id")), "doc_id")


@query("""SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region""")
def graph_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Additive patch of a graph, all or nothing."""
    graph = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    region = read(spark, sf, "region")
    good = validate.apply_patch(graph, region.select((100 + F.col("r_regionkey")).cast("long").alias("k"), F.col("r_name").alias("v")), "k")
    return validate.apply_patch(good, region.select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("v")), "k")


@query(
    """WITH q AS (SELECT conv_id, turn, role, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS source FROM conversations),
c AS (SELECT conv_id, turn, source, CASE turn % 3 WHEN 0 THEN substr(source, 5, 40) WHEN 1 THEN substr(source, 5, 40) ELSE 'x' || substr(source, 5, 40) END AS quote, CASE WHEN turn % 3 = 0 THEN substr(source, 10, 6) ELSE 'zqx' END AS value FROM q)
SELECT conv_id, turn, CASE WHEN contains(source, quote) AND quote <> '' AND contains(quote, value) AND value <> '' THEN 'literal' WHEN contains(source, quote) AND quote <> '' THEN 'semantic_review' ELSE 'bad_quote' END AS support FROM c"""
)
def literal_support(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that hold the value and stand in the source, that only stand there, or that don't."""
    rows = read(spark, sf, "conversations").withColumn("source", X.alphanumeric(F.col("text"))).withColumn("q", F.substring("source", 5, 40))
    quote = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("x"), "q")).otherwise(F.col("q"))
    value = F.when(F.col("turn") % 3 == 0, F.substring("source", 10, 6)).otherwise("zqx")
    return rows.select("conv_id", "turn", validate.literal_support(quote, value, F.col("source")).alias("support"))


@query(
    """SELECT b.item_id, count(d.doc_id)::BIGINT AS documents, count(d.doc_id) > 0 AS verbatim FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) AND b.text <> '' GROUP BY b.item_id"""
)
def quote_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Whole quotes against whole source texts."""
    hits = contain.containing(read(spark, sf, "documents"), "doc_id", "text", read(spark, sf, "benchmark"), "item_id", "text").groupBy("item_id").agg(F.count("*").alias("documents"))
    rows = read(spark, sf, "benchmark").select("item_id").join(hits, "item_id", "left")
    return rows.select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), (F.coalesce("documents", F.lit(0)) > 0).alias("verbatim"))


@query(
    """WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT c_custkey, CASE WHEN a.s IS NULL AND b.s IS NULL THEN 'expected_zero' WHEN a.s = b.s THEN 'auto_frozen' ELSE 'review' END AS consensus FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey"""
)
def reader_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Two readers' scopes: equal ones freeze, different ones go to review."""
    orders = read(spark, sf, "orders")
    side = lambda m, n: orders.where(f"o_orderkey % 2 = {m}").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias(n))
    rows = read(spark, sf, "customer").select("c_custkey").join(side(0, "a"), "c_custkey", "left").join(side(1, "b"), "c_custkey", "left")
    return rows.select("c_custkey", F.when(F.col("a").isNull() & F.col("b").isNull(), "expected_zero").when(F.col("a") == F.col("b"), "auto_frozen").otherwise("review").alias("consensus"))


@query(
    """SELECT o_custkey, o_orderpriority, coalesce(max(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END), 'pending') AS decision FROM orders GROUP BY o_custkey, o_orderpriority"""
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Queue rows once per key, with decisions carried over."""
    orders = read(spark, sf, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    prior = orders.where("o_orderkey % 5 = 0").groupBy(*keys).agg(F.max("o_orderstatus").alias("d"))
    return orders.select(*keys).distinct().join(prior, keys, "left").select(*keys, F.coalesce("d", F.lit("pending")).alias("decision"))


@query(
    """SELECT doc_id, CASE WHEN source = 'src0' THEN 'skipped_legacy' WHEN n_chars < 100 THEN 'skipped_invalid' WHEN n_chars > 5000 AND quality IS NULL THEN 'skipped_incomplete' ELSE 'merged' END AS status FROM documents LEFT JOIN labels USING (doc_id)"""
)
def batch_finalise(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered skip reasons of a batch."""
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    state = F.when(F.col("source") == "src0", "skipped_legacy").when(F.col("n_chars") < 100, "skipped_invalid").when((F.col("n_chars") > 5000) & F.col("quality").isNull(), "skipped_incomplete")
    return rows.select("doc_id", F.coalesce(state, F.lit("merged")).alias("status"))


@query(
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'unknown' WHEN b.n IS NULL THEN 'lost' WHEN b.n > 1 THEN 'twice' ELSE 'once' END AS state
FROM (SELECT item_id AS k FROM benchmark) a FULL JOIN (SELECT k, count(*) AS n FROM (SELECT item_id AS k FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 100000) GROUP BY k) b USING (k)"""
)
def partition_assertion(spark: SparkSession, sf: str) -> DataFrame:
    """Recovered and residual ids must partition the gold ids."""
    gold = read(spark, sf, "benchmark").select(F.col("item_id").alias("k"))
    parts = gold.where("k % 2 = 0").unionAll(gold.where("k % 3 = 0")).unionAll(spark.range(100000, 100001).toDF("k")).groupBy("k").agg(F.count("*").alias("n"))
    rows = gold.withColumn("g", F.lit(1)).join(parts, "k", "full")
    return rows.select("k", F.when(F.col("g").isNull(), "unknown").when(F.col("n").isNull(), "lost").when(F.col("n") > 1, "twice").otherwise("once").alias("state"))


@query("""SELECT event_id, user_id, NULL::VARCHAR AS reader, CASE WHEN value >= 50 THEN '>=' ELSE '<' END AS comparator, '1.2' AS contract_version FROM events""")
def schema_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Additive migration to a newer contract."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("reader", T.StringType()), T.StructField("comparator", T.StringType()), T.StructField("contract_version", T.StringType())])
    rows = read(spark, sf, "events").withColumns({"comparator": F.when(F.col("value") >= 50, ">=").otherwise("<"), "contract_version": F.lit("1.2")})
    return tables.with_defaults(rows, schema)


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95))
SELECT event_type, count(*)::BIGINT AS verified, round(sum(value), 4) AS tokens, count(DISTINCT user_id)::BIGINT AS papers FROM s GROUP BY event_type"""
)
def verification_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Roll-up without superseded rows."""
    events = read(spark, sf, "events")
    gone = events.where("event_type = 'error' and value > 95").select("user_id").distinct()
    rows = events.join(gone, "user_id", "left_anti")
    return rows.groupBy("event_type").agg(F.count("*").alias("verified"), F.round(F.sum("value"), 4).alias("tokens"), F.count_distinct("user_id").alias("papers"))


@query(
    """SELECT user_id, event_id, round(value * 1.0, 3) AS before, round(CASE WHEN n = 1 THEN value + 1 ELSE value END, 3) AS after FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 2"""
)
def decision_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Before and after of applied decisions."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    rows = read(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 2")
    return rows.select("user_id", "event_id", F.round("value", 3).alias("before"), F.round(F.when(F.col("n") == 1, F.col("value") + 1).otherwise(F.col("value")), 3).alias("after"))


@query(
    """WITH p AS (SELECT d.doc_id, l.quality, (d.n_chars > 400)::INT AS predicted FROM documents d JOIN labels l USING (doc_id))
SELECT CASE WHEN grouping(s) = 1 THEN 'all' ELSE s END AS split, count(*) FILTER (predicted = 1 AND quality = 1)::BIGINT AS hits, round(count(*) FILTER (predicted = 1 AND quality = 1) / greatest(1, count(*) FILTER (predicted = 1)), 4) AS precision_,
round(count(*) FILTER (predicted = 1 AND quality = 1) / greatest(1, count(*) FILTER (quality = 1)), 4) AS recall_ FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'development' ELSE 'holdout' END AS s FROM p) GROUP BY ROLLUP (s)"""
)
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall, overall and by split."""
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    p, q = F.col("n_chars") > 400, F.col("quality") == 1
    s = F.when(F.col("doc_id") % 2 == 0, "development").otherwise("holdout")
    hits = F.count_if(p & q)
    out = rows.withColumn("s", s).rollup("s").agg(
        F.grouping("s").alias("g"), hits.alias("hits"), F.round(hits / F.greatest(F.lit(1), F.count_if(p)), 4).alias("precision_"), F.round(hits / F.greatest(F.lit(1), F.count_if(q)), 4).alias("recall_")
    )
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("s")).alias("split"), "hits", "precision_", "recall_")


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over events; the streaming form has the same shape."""
    from assayer.streaming import windows

    return windows.tumbling(read(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))
