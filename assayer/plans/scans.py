"""Queries of the file scans, parsers, sinks and streams: whole tables are written to the shared folder in a source's
format, or built into its payloads, and read back by the engine's own readers."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.registry import query
from assayer.sources import corpus, folders, parse, sinks, tables
from assayer.sources.tables import read
from assayer.streaming import windows


def _xml(value: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, sha256(text) AS digest FROM conversations")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with a header, quotes and line breaks; all columns come back as text."""
    path = folders.scratch(spark, "csv")
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.base64(F.encode("text", "utf-8")).alias("code"), F.concat(F.lit('say "'), "role", F.lit('",\nthen')).alias("odd"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = tables.csv(spark, path, ["conv_id", "turn", "role", "code", "odd"]).where(F.col("odd") == F.concat(F.lit('say "'), "role", F.lit('",\nthen')))
    return found.select("conv_id", "turn", "role", F.sha2(F.unbase64("code"), 256).alias("digest"))


@query("SELECT doc_id, lang, source, sha256(text) AS digest, ['extra'] [1] AS unknown FROM documents")
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of a fixed schema; keys that the schema doesn't know are findings."""
    path = folders.scratch(spark, "jsonl")
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", "text", F.lit(1).alias("extra"))
    docs.write.json(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("lang", "source", "text"))])
    rows = tables.jsonl(spark, path, schema).where("source_file <> ''")
    raw = spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "value")
    unknown = tables.unknown_keys(raw, "value", [f.name for f in schema]).select("doc_id", F.array_join("unknown", ",").alias("unknown"))
    return rows.join(unknown, "doc_id").select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"), "unknown")


@query("""SELECT p_partkey::VARCHAR AS pmid, p_name || ' & <' || p_type || '>' AS title, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN 'PMC' || p_partkey END AS pmcid FROM part""")
def pubmed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bibliographic XML pages to records."""
    path, key = folders.scratch(spark, "pubmed"), F.col("p_partkey").cast("string")
    ids = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<ArticleId IdType="doi">10.1/'), key, F.lit("</ArticleId>"))).otherwise(""), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<ArticleId IdType="pmc">PMC'), key, F.lit("</ArticleId>"))).otherwise(""))
    title = _xml(F.concat("p_name", F.lit(" & <"), "p_type", F.lit(">")))
    record = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), key, F.lit("</PMID><Article><ArticleTitle>"), title, F.lit("</ArticleTitle></Article></MedlineCitation><PubmedData><ArticleIdList>"),
        F.lit('<ArticleId IdType="pubmed">'), key, F.lit("</ArticleId>"), ids, F.lit("</ArticleIdList></PubmedData></PubmedArticle>"),
    )
    pages = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 500).alias("page"), record.alias("x")).groupBy("page").agg(F.array_join(F.collect_list("x"), "\n").alias("x"))
    pages.select("page", F.concat(F.lit("<PubmedArticleSet>"), "x", F.lit("</PubmedArticleSet>"))).write.partitionBy("page").text(path)
    return tables.pubmed(spark, path)


@query("""SELECT 'MED' AS source, o_orderkey::VARCHAR AS id, 'PMC' || o_orderkey AS pmcid, CASE WHEN o_orderkey % 2 = 0 THEN '10.5/' || o_orderkey END AS doi,
CASE WHEN o_orderkey % 2 = 0 THEN 'https://doi.org/10.5/' || o_orderkey ELSE 'https://europepmc.org/article/MED/' || o_orderkey END AS url FROM orders""")
def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of search results in JSON to records; urls fall back from the DOI."""
    key = F.col("o_orderkey").cast("string")
    result = F.struct(F.lit("MED").alias("source"), key.alias("id"), F.concat(F.lit("PMC"), key).alias("pmcid"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10.5/"), key)).alias("doi"))
    pages = read(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(result).alias("result")).alias("resultList"))).alias("payload"))
    return tables.europe_pmc(pages, "payload").select("source", "id", "pmcid", "doi", "url")


LINE = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {LINE.format("regexp_replace(text, '[\\x00-\\x1F]', ' ', 'g')")} AS line FROM conversations),
b AS (SELECT DISTINCT conv_id, 'title' AS block_type, '' AS section_path, 'Talk ' || conv_id AS text FROM t UNION SELECT conv_id, 'paragraph', 'Abstract', line FROM t WHERE turn % 4 = 0 UNION SELECT conv_id, 'paragraph', 'Part ' || (turn % 3), line FROM t WHERE turn % 4 IN (1, 2)
UNION SELECT conv_id, 'paragraph', 'Part ' || (turn % 3) || ' > Notes', line FROM t WHERE turn % 4 = 3 UNION SELECT conv_id, 'caption', 'Part ' || (turn % 3) || ' > Notes', 'Table ' || turn FROM t WHERE turn % 4 = 3 UNION SELECT conv_id, 'table_row', 'Part ' || (turn % 3) || ' > Notes', turn || ' | b' FROM t WHERE turn % 4 = 3)
SELECT conv_id, block_type, section_path, sha256(text) AS digest FROM b WHERE text <> ''"""
)
def article_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Article XML to blocks: title, abstract, nested sections, tables and captions; equal blocks are kept once."""
    turn, line = F.col("turn"), _xml(F.regexp_replace("text", r"[\x00-\x1F]", " "))
    head, n = F.concat(F.lit("<title>Part "), turn % 3, F.lit("</title>")), turn.cast("string")
    table = F.concat(F.lit("<table-wrap><caption>Table "), n, F.lit("</caption><table><tr><td>"), n, F.lit("</td><td>b</td></tr><tr><td/></tr></table></table-wrap>"))
    part = F.when(turn % 4 == 3, F.concat(F.lit("<sec>"), head, F.lit("<sec><title>Notes</title><p>"), line, F.lit("</p>"), table, F.lit("</sec></sec>"))).otherwise(F.concat(F.lit("<sec>"), head, F.lit("<p>"), line, F.lit("</p></sec>")))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("x")))), lambda x: x["x"]), "")
    rows = read(spark, sf, "conversations").withColumns({"abstract": F.when(turn % 4 == 0, F.concat(F.lit("<p>"), line, F.lit("</p>"))).otherwise(""), "part": F.when(turn % 4 > 0, part).otherwise("")})
    rows = rows.groupBy("conv_id").agg(ordered(F.col("abstract")).alias("a"), ordered(F.col("part")).alias("b"))
    xml = F.concat(F.lit("<article><front><article-title>Talk "), "conv_id", F.lit("</article-title><abstract>"), "a", F.lit("</abstract></front><body>"), "b", F.lit("</body></article>"))
    found = parse.article_blocks(rows.select("conv_id", xml.alias("xml")), "conv_id", "xml")
    return found.select("conv_id", "block_type", "section_path", F.sha2("text", 256).alias("digest"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, turn // 8 + 1 AS page, turn // 4 AS h, {LINE.format('text')} AS line FROM conversations),
s AS (SELECT *, list_transform(range(h - h % 3, h + 1), lambda i: 'Section ' || i) AS path FROM t),
b AS (SELECT conv_id, turn, 0 AS k, page, 'heading' AS block_type, array_to_string(list_prepend('Supplement', path[1:len(path) - 1]), ' > ') AS section_path, 'Section ' || h AS text FROM s WHERE turn % 4 = 0
UNION ALL SELECT conv_id, turn, 0, page, 'paragraph', array_to_string(list_prepend('Supplement', path), ' > '), line FROM s WHERE turn % 4 = 1
UNION ALL SELECT conv_id, turn, k, page, ['table', 'table_row', 'caption'][k + 1], array_to_string(list_prepend('Supplement', path), ' > '), [turn || ' | b c', turn || ' | b c', 'Cap ' || turn][k + 1] FROM s, (SELECT unnest(range(0, 3)) AS k) WHERE turn % 4 = 2
UNION ALL SELECT conv_id, turn, 0, page, 'figure', array_to_string(list_prepend('Supplement', path), ' > '), 'Fig ' || turn FROM s WHERE turn % 4 = 3),
d AS (SELECT * FROM b WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, page, block_type, text ORDER BY turn, k) = 1)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS block_no, block_type, section_path, page AS page_number, sha256(text) AS digest FROM d"""
)
def structured_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A structured parser's JSON to blocks: heading stack, table rows, captions, figures."""
    turn = F.col("turn")
    four, n = turn % 4, turn.cast("string")
    kind = F.when(four == 0, "Heading").when(four == 1, "text").when(four == 2, "table").otherwise("image")
    text = F.when(four == 0, F.concat(F.lit("Section "), F.floor(turn / 4))).when(four == 1, F.col("text")).when(four == 2, F.concat(F.lit("<table><TR><td>"), n, F.lit("</td><td class='x'><b>b</b>\n c</td></tr><tr><td> </td></tr></table>")))
    note = F.when(four == 2, F.array(F.struct(F.concat(F.lit("Cap "), n).alias("text")))).when(four == 3, F.array(F.struct(F.concat(F.lit("Fig  "), n).alias("text"))))
    element = F.struct(kind.alias("type"), text.alias("text"), F.when(four == 0, F.floor(turn / 4) % 3 + 1).alias("heading_level"), F.when(four == 2, "HTML").alias("text_format"), note.alias("annotations"))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.floor(turn / 8).alias("page_id"), element.alias("e"))
    pages = rows.groupBy("conv_id", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]).alias("content"))
    docs = pages.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("page_id", "content"))).alias("pages"))).alias("payload"))
    found = parse.element_blocks(docs, "conv_id", "payload")
    return found.select("conv_id", "block_no", "block_type", "section_path", "page_number", F.sha2("text", 256).alias("digest"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'first' WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'third' END AS origin FROM orders"""
)
def prioritised_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Results of several roots; of each paper the earliest root's counts."""
    rows = read(spark, sf, "orders").select("o_orderkey")
    part = lambda c, n: rows.where(c).withColumn("origin", F.lit(n))
    return tables.first_root([part("o_orderkey % 2 = 0", "first"), part("o_orderkey % 3 = 0", "second"), part("true", "third")], "o_orderkey")


@query(
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'structured' WHEN d.doc_id % 5 > 0 THEN 'page dump' ELSE 'none' END AS origin, CASE WHEN d.doc_id % 3 > 0 THEN CASE WHEN d.doc_id % 5 > 0 THEN 'page dump used' ELSE 'no text' END END AS warning FROM documents d"""
)
def parse_degradation(spark: SparkSession, sf: str) -> DataFrame:
    """Structured blocks where there are any, else the page dump, with a warning."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    blocks, warnings = corpus.degrade(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 5 > 0"), docs, "doc_id")
    origin = F.when(F.col("degraded"), "page dump").when(~F.col("degraded"), "structured").otherwise("none")
    return docs.select("doc_id").join(blocks.select("doc_id", "degraded"), "doc_id", "left").join(warnings, "doc_id", "left").select("doc_id", origin.alias("origin"), "warning")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS build FROM orders""")
def partial_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that were built anew replace their old rows, the others stay."""
    rows = read(spark, sf, "orders").select("o_orderkey")
    return sinks.rebuild(rows.withColumn("build", F.lit("old")), rows.where("o_orderkey % 5 = 0").withColumn("build", F.lit("new")), "o_orderkey")


@query(
    """SELECT user_id, event_type, count(DISTINCT event_id)::BIGINT AS pages, count(*) FILTER (event_id % 17 = 0)::BIGINT AS bad, count(*) FILTER (event_id % 17 = 0) = 0 AND count(DISTINCT event_id) = count(*) - (user_id % 4 = 0)::INT AS complete FROM events GROUP BY user_id, event_type"""
)
def fetch_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages per query: complete only with all pages and matching checksums."""
    events = read(spark, sf, "events").withColumns({"digest": F.sha2(F.col("event_id").cast("string"), 256)})
    total = events.groupBy("user_id", "event_type").agg((F.count("*") - (F.col("user_id") % 4 == 0).cast("int")).alias("expected"))
    rows = events.join(total, ["user_id", "event_type"]).withColumn("recorded", F.when(F.col("event_id") % 17 == 0, "old").otherwise(F.col("digest")))
    return corpus.fetch_ledger(rows, ["user_id", "event_type"], "event_id", "digest", "recorded", "expected")


@query(
    """WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS s, 1 AS version FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders)
SELECT new.k, new.s, CASE WHEN old.k IS NOT NULL AND old.s <> new.s THEN 2 ELSE 1 END AS version, false AS superseded FROM new LEFT JOIN old USING (k) UNION ALL SELECT old.k, old.s, 1, true FROM old JOIN new USING (k) WHERE old.s <> new.s"""
)
def versioned_write(spark: SparkSession, sf: str) -> DataFrame:
    """A convergent write that keeps superseded versions in a ledger."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = rows.withColumn("s", F.when(F.col("k") % 10 == 0, "Z").otherwise(F.col("s")))
    table, ledger = sinks.converge_or_refuse(rows.where("k % 2 = 0"), new, ["k"], ["s"], version=True)
    return table.withColumn("superseded", F.lit(False)).unionByName(ledger.select(*table.columns, "superseded"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over a stream of all events, run to its end."""
    rows = windows.drained(windows.tumbling(_stream(spark, sf)), windows.overwrite, folders.scratch(spark, "windows"), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS stop, count(*)::BIGINT AS events FROM s GROUP BY user_id, n"""
)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user: runs of events with no gap of half an hour."""
    rows = windows.sessions(read(spark, sf, "events"))
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("user_id", form("start").alias("start"), form("stop").alias("stop"), "events")


@query("SELECT DISTINCT user_id, event_type FROM events")
def request_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a stream that were not seen before, by fingerprint; equal ones are served from the cache."""
    fresh = windows.once(_stream(spark, sf), ["user_id", "event_type"], late="20000 days")
    return windows.drained(fresh, windows.overwrite, folders.scratch(spark, "requests")).select("user_id", "event_type")
