"""Matching, entity resolution, retrieval and graph queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import text as T
from assayer.operators import pack, relate, retrieve
from assayer.registry import query
from assayer.sources import folders
from assayer.sources.tables import read

@query(
    """SELECT 'visual' AS route, doc_id, substr(sha256('visual:' || doc_id), 1, 12) AS task_id FROM documents WHERE contains(text, '|') UNION ALL
SELECT 'text', doc_id, substr(sha256('text:' || doc_id), 1, 12) FROM documents WHERE NOT contains(text, '|') AND n_chars > 3000 UNION ALL
SELECT 'blocked', doc_id, substr(sha256('blocked:' || doc_id), 1, 12) FROM documents WHERE NOT contains(text, '|') AND n_chars <= 100"""
)
def routing(spark: SparkSession, sf: str) -> DataFrame:
    """Routes with their task ids; rows without a route are left."""
    table = F.col("text").contains("|")
    route = F.when(table, "visual").when(F.col("n_chars") > 3000, "text").when(F.col("n_chars") <= 100, "blocked")
    rows = read(spark, sf, "documents").select("doc_id", route.alias("route")).where("route is not null")
    return rows.select("route", "doc_id", T.short_id("", F.col("route"), F.col("doc_id"), length=12).alias("task_id"))


@query("""SELECT item_id, CASE WHEN sha256('a' || item_id) < sha256('b' || item_id) THEN 'a' ELSE 'b' END AS first_side FROM benchmark""")
def blinded_order(spark: SparkSession, sf: str) -> DataFrame:
    """Blinded order of a pair's sides by hash."""
    side = F.when(F.sha2(F.concat(F.lit("a"), "item_id"), 256) < F.sha2(F.concat(F.lit("b"), "item_id"), 256), "a").otherwise("b")
    return read(spark, sf, "benchmark").select("item_id", side.alias("first_side"))


TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


BM25 = f"""WITH d AS (SELECT doc_id, list_filter({TERMS}, lambda x: length(x) >= 3) AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(list_filter({TERMS}, lambda x: length(x) >= 3)) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM s) WHERE rank <= 10"""


@query(BM25)
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical search of passages for each gold text."""
    return retrieve.bm25(read(spark, sf, "documents"), read(spark, sf, "benchmark"), "doc_id", "item_id", "text", 10)


@query(BM25)
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same search from an index that is written to the shared folder and read again."""
    found = retrieve.IndexBackend(folders.scratch(spark, "index"), "doc_id", "item_id", stem=False)
    found.build(read(spark, sf, "documents"))
    return found.search(read(spark, sf, "benchmark"), 10).withColumnRenamed("doc", "doc_id")


@query()
def stemmed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical search by Porter stems."""
    return retrieve.bm25(read(spark, sf, "documents"), read(spark, sf, "benchmark"), "doc_id", "item_id", "text", 10, stem=True)


GRAMS = """SELECT {k}, term, 1 + ln(count(*)) AS tf FROM (SELECT {k}, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term
  FROM (SELECT {k}, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9]+') AS w FROM {t})) GROUP BY ALL"""


@query(
    f"""WITH turns AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations), p AS ({GRAMS.format(k='turn_id', t='turns')}), n AS (SELECT count(*) AS n FROM turns),
i AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM p GROUP BY term), w AS (SELECT turn_id, term, tf * idf AS w FROM p JOIN i USING (term)),
nd AS (SELECT turn_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY turn_id), g AS ({GRAMS.format(k='item_id', t='benchmark')}), q AS (SELECT item_id, term, tf * idf AS q FROM g JOIN i USING (term)),
nq AS (SELECT item_id, sqrt(sum(q * q)) AS qn FROM q GROUP BY item_id),
s AS (SELECT item_id, turn_id, round(sum(w * q) / (norm * qn), 6) AS score FROM w JOIN q USING (term) JOIN nd USING (turn_id) JOIN nq USING (item_id) GROUP BY item_id, turn_id, norm, qn)
SELECT * FROM (SELECT item_id, turn_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, turn_id)::BIGINT AS rank FROM s WHERE score > 0) WHERE rank <= 5"""
)
def tfidf_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vector-space search over unigrams and bigrams."""
    turns = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return retrieve.tfidf(turns, read(spark, sf, "benchmark"), "turn_id", "item_id", "text", 5)


DENSE = """
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
    / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 12)
"""


def _dense(spark: SparkSession, sf: str, k: int = 12) -> DataFrame:
    rows = read(spark, sf, "embeddings")
    return retrieve.dense(rows, rows.where("vec_id % 100 = 0"), "vec_id", "query_id", "embedding", k)


@query("WITH " + DENSE + "SELECT query_id, vec_id, score, rank FROM dense")
def dense_search(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cosine search for the queries among the vectors."""
    return _dense(spark, sf)


LEX = "lex AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(e.embedding[1] - q.embedding[1]), e.vec_id)::BIGINT AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND e.label = q.label QUALIFY rank <= 12)"
RRF = DENSE + ", " + LEX + """, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM (
  SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT query_id, vec_id, rank FROM dense UNION ALL SELECT query_id, vec_id, rank FROM lex) GROUP BY ALL) QUALIFY rank <= 6)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings")
    asked = relate.checked(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("_l"), F.element_at("embedding", 1).alias("_x")), 10_000)
    near = rows.join(asked, (F.col("label") == F.col("_l")) & (F.col("vec_id") != F.col("query_id"))).select("query_id", "vec_id", (-F.abs(F.element_at("embedding", 1) - F.col("_x"))).alias("score"))
    return retrieve.fuse([_dense(spark, sf), retrieve.ranked(near, "query_id", "vec_id", 12)], "query_id", "vec_id", 6)


@query("WITH " + RRF + " SELECT query_id, vec_id, score, rank FROM fused")
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists."""
    return _fused(spark, sf)


@query(
    "WITH " + RRF + """, seeds AS (SELECT query_id, vec_id, score FROM fused WHERE rank <= 4), b AS (SELECT query_id, vec_id + o AS vec_id, score * 0.18 AS score FROM seeds, (SELECT unnest([-1, 1]) AS o)),
a AS (SELECT query_id, vec_id, score FROM fused UNION ALL SELECT query_id, vec_id, score FROM b WHERE vec_id IN (SELECT vec_id FROM embeddings))
SELECT * FROM (SELECT query_id, vec_id, round(sum(score), 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 8) DESC, vec_id)::BIGINT AS rank FROM a GROUP BY query_id, vec_id) WHERE rank <= 8"""
)
def neighbour_bonus(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the best hits get a share of their score, in a single pass."""
    fused = _fused(spark, sf)
    bonus = fused.where("rank <= 4").select("query_id", F.explode(F.array(F.col("vec_id") - 1, F.col("vec_id") + 1)).alias("vec_id"), (F.col("score") * 0.18).alias("score"))
    bonus = bonus.join(read(spark, sf, "embeddings").select("vec_id"), "vec_id", "left_semi")
    rows = fused.select("query_id", "vec_id", "score").unionByName(bonus).groupBy("query_id", "vec_id").agg(F.round(F.sum("score"), 8).alias("score"))
    return retrieve.ranked(rows, "query_id", "vec_id", 8)


@query(
    "WITH " + RRF + """, r AS (SELECT f.*, e.label, e.label = q.label AS wanted, row_number() OVER (PARTITION BY f.query_id ORDER BY (e.label = q.label) DESC, f.score DESC, f.vec_id)::BIGINT AS new_rank
  FROM fused f JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = f.query_id)
SELECT query_id, vec_id, wanted, new_rank FROM r"""
)
def entity_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that hold a required type come first."""
    kinds = read(spark, sf, "embeddings").select("vec_id", "label")
    rows = _fused(spark, sf).join(kinds, "vec_id").join(kinds.select(F.col("vec_id").alias("query_id"), F.col("label").alias("need")), "query_id")
    rows = rows.withColumn("wanted", F.col("label") == F.col("need"))
    w = Window.partitionBy("query_id").orderBy(F.desc("wanted"), F.desc("score"), "vec_id")
    return rows.select("query_id", "vec_id", "wanted", F.row_number().over(w).cast("long").alias("new_rank"))


@query(
    "WITH " + RRF + """, k AS (SELECT f.query_id, f.vec_id, f.rank, e.vec_id % 3 AS kind FROM fused f JOIN embeddings e USING (vec_id)), need AS (
SELECT d.query_id, d.vec_id, 6::BIGINT AS rank, row_number() OVER (PARTITION BY d.query_id ORDER BY d.rank) AS n FROM dense d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = d.query_id AND k.rank < 6 AND k.kind = d.vec_id % 3) AND NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = d.query_id AND k.vec_id = d.vec_id))
SELECT query_id, vec_id, rank FROM k WHERE rank < 6 OR query_id NOT IN (SELECT query_id FROM need) UNION ALL SELECT query_id, vec_id, rank FROM need WHERE n = 1"""
)
def diversify_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The last slot goes to the best hit of a source kind that the list lacks."""
    fused, ranked = _fused(spark, sf).select("query_id", "vec_id", "rank"), _dense(spark, sf).select("query_id", "vec_id", "rank")
    kind = (F.col("vec_id") % 3).alias("kind")
    have = fused.where("rank < 6").select("query_id", kind).distinct()
    lacking = ranked.withColumn("kind", kind).join(have, ["query_id", "kind"], "left_anti").join(fused.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    best = pack.top(lacking, ["query_id"], ["rank"], 1, "n").select("query_id", "vec_id", F.lit(6).cast("long").alias("rank"))
    kept = fused.join(best.select("query_id", F.lit(6).cast("long").alias("rank")), ["query_id", "rank"], "left_anti")
    return kept.select("query_id", "vec_id", "rank").unionByName(best)


@query(
    """WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations), x AS (SELECT DISTINCT c.conv_id, c.turn FROM s JOIN conversations c ON s.r <= 3 AND c.conv_id = s.conv_id AND c.turn BETWEEN s.turn - 1 AND s.turn + 1 AND (c.turn = s.turn OR c.role <> s.role))
SELECT conv_id, turn, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS rank FROM x) WHERE rank <= 10"""
)
def hierarchy_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds and their neighbours of one section, capped."""
    turns = read(spark, sf, "conversations")
    seeds = pack.top(turns.select("conv_id", "turn", "role", F.length("text").alias("n")), ["conv_id"], [F.desc("n"), "turn"], 3)
    spread = seeds.select("conv_id", F.col("role").alias("r"), F.col("turn").alias("t"), F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    rows = turns.select("conv_id", "turn", "role").join(spread, ["conv_id", "turn"]).where("turn = t or role <> r").select("conv_id", "turn").distinct()
    return pack.top(rows, ["conv_id"], ["turn"], 10)


@query(
    """WITH f AS (SELECT unnest(['dose', 'size', 'outcome', 'model']) AS field), q AS (SELECT source, field, 'Q-' || source || '-' || field AS query_id, CASE WHEN field IN ('dose', 'size') THEN field || ' mg nm' ELSE field END AS question FROM (SELECT DISTINCT source FROM documents), f)
SELECT * FROM q"""
)
def query_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Field questions per paper, with expansion terms."""
    field = F.explode(F.array(*map(F.lit, ("dose", "size", "outcome", "model")))).alias("field")
    rows = read(spark, sf, "documents").select("source").distinct().select("source", field)
    question = F.when(F.col("field").isin("dose", "size"), F.concat("field", F.lit(" mg nm"))).otherwise(F.col("field"))
    return rows.select("source", "field", F.concat_ws("-", F.lit("Q"), "source", "field").alias("query_id"), question.alias("question"))


@query("""SELECT conv_id, sha256(string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn)) AS prompt_digest, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def prompt_serialisation(spark: SparkSession, sf: str) -> DataFrame:
    """Gated evidence as one ordered text."""
    line = F.concat(F.lit("["), "role", F.lit("] "), "text")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("prompt_digest"), F.sum(F.length("text")).alias("chars"))
