"""Clause, signal and parsing queries over documents, conversations, pages and parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators import dedup
from assayer.registry import query
from assayer.sources import parse
from assayer.sources.tables import read

SENT = r"""
clauses AS (
  SELECT doc_id, source, i AS position, list_extract(parts, i) AS clause FROM (
    SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id, source, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' '), '([.!?]) ', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s, ' ') <> '') AS parts
      FROM documents)))
"""


@query(
    "WITH " + SENT + """
SELECT substr(sha256(norm), 1, 16) AS clause_id, count(*)::BIGINT AS members, count(DISTINCT doc_id)::BIGINT AS documents,
       array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(doc_id)::BIGINT AS first_doc, arg_min(position, (doc_id, position))::BIGINT AS first_position
FROM (SELECT *, lower(trim(regexp_replace(clause, '[ \t\n\r]+', ' ', 'g'), ' ')) AS norm FROM clauses) GROUP BY norm"""
)
def dedup_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Exact clause dedup: hash id, counts, set of sources, first document and its context, the clause's first place."""
    return dedup.clause_groups(read(spark, sf, "documents"), "doc_id", "text", "source")


@query(
    """WITH d AS (SELECT doc_id, source, lang, n_chars, lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS norm FROM documents)
SELECT sha256(norm) AS digest, count(*)::BIGINT AS members, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(doc_id)::BIGINT AS first_doc_id
FROM d GROUP BY norm"""
)
def exact_text_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Passage dedup on normalised text with set union of tags and the first row kept."""
    return dedup.exact(read(spark, sf, "documents"), T.normalise(F.col("text")), ["doc_id"], {"sources": "source"}, ["doc_id"])


@query(
    """WITH d AS (SELECT lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS norm FROM documents)
SELECT count(*)::BIGINT AS passages, count(DISTINCT norm)::BIGINT AS kept, (count(*) - count(DISTINCT norm))::BIGINT AS removed FROM d"""
)
def dedup_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a dedup pass."""
    found = dedup.exact(read(spark, sf, "documents"), T.normalise(F.col("text")), ["doc_id"], {}, [])
    return found.agg(F.sum("members").alias("passages"), F.count("*").alias("kept"), F.sum(F.col("members") - 1).alias("removed"))


#: A clause that is nothing but a label (fixed value).
LABEL = r"(?i)^(?:Table|Fig(?:ure)?\.?)\s+[A-Za-z0-9.-]+\.$"


@query(
    "WITH " + SENT.replace("trim(regexp_replace(text,", "trim(regexp_replace('Table S' || (doc_id % 9) || '. ' || text,") + """
SELECT doc_id, position::BIGINT AS position, 'C' || lpad(position::VARCHAR, greatest(3, length(position::VARCHAR))::INT, '0') AS clause_no,
       CASE WHEN regexp_full_match(lag(clause) OVER w, '(?i)(?:Table|Fig(?:ure)?\\.?)\\s+[A-Za-z0-9.-]+\\.') THEN lag(clause) OVER w || ' ' || clause ELSE clause END AS carried
FROM clauses WINDOW w AS (PARTITION BY doc_id ORDER BY position)"""
)
def caption_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Clause numbers; a clause that is only the label of a table or figure is carried into the next one, inside the row."""
    labelled = F.concat(F.lit("Table S"), F.col("doc_id") % 9, F.lit(". "), "text")
    rows = read(spark, sf, "documents").select("doc_id", F.inline(F.array(F.struct(T.sentences(labelled).alias("s")))))
    carried = F.transform("s", lambda x, i: F.when((i > 0) & F.get("s", i - 1).rlike(LABEL), F.concat_ws(" ", F.get("s", i - 1), x)).otherwise(x))
    rows = rows.select("doc_id", F.posexplode(carried).alias("i", "carried")).withColumn("position", (F.col("i") + 1).cast("long"))
    return rows.select("doc_id", "position", T.numbered("C", F.col("position")).alias("clause_no"), "carried")


@query(
    "WITH " + SENT + """, t AS (
  SELECT doc_id, position, list_filter(list_distinct(regexp_extract_all(lower(clause), '[a-z0-9]+')), lambda x: length(x) >= 4) AS terms FROM clauses),
p AS (SELECT doc_id, position, terms, lag(terms) OVER (PARTITION BY doc_id ORDER BY position) AS prev FROM t),
r AS (SELECT doc_id, position, coalesce(len(list_intersect(terms, prev)) >= 2 AND len(list_intersect(terms, prev)) * 2 >= least(len(terms), len(prev)), false) AS before FROM p),
n AS (SELECT *, coalesce(lead(before) OVER (PARTITION BY doc_id ORDER BY position), false) AS after FROM r)
SELECT doc_id, count(*)::BIGINT AS clauses, count(*) FILTER (before)::BIGINT AS related, count(*) FILTER (NOT before AND NOT after)::BIGINT AS alone FROM n GROUP BY doc_id"""
)
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent sentences that travel together: two shared terms and half of the smaller set; looked at inside the row."""
    rows = read(spark, sf, "documents").select("doc_id", F.inline(F.array(F.struct(F.transform(T.sentences(F.col("text")), lambda s: T.tokens(s, 4)).alias("t")))))
    rows = rows.where(F.size("t") > 0)
    shared = "size(array_intersect(t[i], t[i + 1]))"
    related = F.expr(f"if(size(t) < 2, cast(array() as array<boolean>), transform(sequence(0, size(t) - 2), i -> {shared} >= 2 and {shared} * 2 >= least(size(t[i]), size(t[i + 1]))))")
    rows = rows.select("doc_id", F.size("t").cast("long").alias("clauses"), F.inline(F.array(F.struct(related.alias("r")))))
    alone = F.expr("size(filter(sequence(0, cast(clauses as int) - 1), i -> not coalesce(get(r, i), false) and not coalesce(get(r, i - 1), false)))")
    return rows.select("doc_id", "clauses", F.size(F.filter("r", lambda x: x)).cast("long").alias("related"), alone.cast("long").alias("alone"))


SIGNALS = {"quantity": "[0-9]", "contact": "@", "heading": "(^|\\n)[A-Z][a-z]+[.]", "license": "licen[sc]e", "junk": "[*#$%&]{3}"}


def _signals_sql(column: str = "text") -> str:
    return ", ".join(f"regexp_matches({column}, '{p}') AS {n}" for n, p in SIGNALS.items()).replace("\\n", "\\n")


def _signals(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.col("text").rlike(p) for n, p in SIGNALS.items()})


@query(
    f"""WITH s AS (SELECT doc_id, source, lang, n_chars, {_signals_sql()} FROM documents)
SELECT source, count(*)::BIGINT AS passages, sum(quantity::INT)::BIGINT AS quantity, sum(contact::INT)::BIGINT AS contact, sum(license::INT)::BIGINT AS license, sum(junk::INT)::BIGINT AS junk,
       count(DISTINCT lang)::BIGINT AS families,
       CASE WHEN (CASE WHEN sum(quantity::INT) >= 8 THEN 2 WHEN sum(quantity::INT) >= 4 THEN 1 ELSE 0 END) + (CASE WHEN count(DISTINCT lang) >= 4 THEN 2 WHEN count(DISTINCT lang) >= 2 THEN 1 ELSE 0 END)
            + (CASE WHEN sum(license::INT) >= 2 THEN 1 ELSE 0 END) >= 4 THEN 'complex' ELSE 'simple' END AS route
FROM s GROUP BY source"""
)
def signal_census(spark: SparkSession, sf: str) -> DataFrame:
    """Complexity census per source: counts of signals, additive score, route."""
    n = {k: F.sum(F.col(k).cast("int")) for k in SIGNALS}
    families = F.count_distinct("lang")
    step = lambda c, many, some: F.when(c >= many, 2).when(c >= some, 1).otherwise(0)
    score = step(n["quantity"], 8, 4) + step(families, 4, 2) + F.when(n["license"] >= 2, 1).otherwise(0)
    counts = [n[k].alias(k) for k in ("quantity", "contact", "license", "junk")]
    return _signals(read(spark, sf, "documents")).groupBy("source").agg(F.count("*").alias("passages"), *counts, families.alias("families"), F.when(score >= 4, "complex").otherwise("simple").alias("route"))


@query(
    """WITH v AS (SELECT o_orderkey, o_custkey, [' https://doi.org/10.1/', 'doi:10.2/', 'HTTP://DOI.ORG/', 'https://doi.org/doi:10.3/', ''][(o_orderkey % 5 + 1)::INT] AS p FROM orders)
, w AS (SELECT o_orderkey, CASE WHEN p = '' THEN ' ' ELSE p || o_custkey END AS raw, CASE o_orderkey % 3 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN ' pmc' || o_custkey ELSE '' END AS pm FROM v)
SELECT o_orderkey, nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^https://doi[.]org/', ''), '^http://doi[.]org/', ''), '^doi:', '')), '') AS doi,
       CASE WHEN regexp_matches(upper(trim(pm)), '^[0-9]+$') THEN 'PMC' || upper(trim(pm)) ELSE nullif(upper(trim(pm)), '') END AS pmcid FROM w"""
)
def normalise_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """DOI and PMC id normalisation over constructed spellings."""
    spell = F.array(*map(F.lit, (" https://doi.org/10.1/", "doi:10.2/", "HTTP://DOI.ORG/", "https://doi.org/doi:10.3/", "")))
    head = F.get(spell, (F.col("o_orderkey") % 5).cast("int"))
    raw = F.when(head == "", " ").otherwise(F.concat(head, F.col("o_custkey").cast("string")))
    three = F.col("o_orderkey") % 3
    pm = F.when(three == 0, F.col("o_custkey").cast("string")).when(three == 1, F.concat(F.lit(" pmc"), F.col("o_custkey").cast("string"))).otherwise("")
    return read(spark, sf, "orders").select("o_orderkey", T.doi(raw).alias("doi"), T.pmcid(pm).alias("pmcid"))


@query(
    """SELECT p_partkey, nullif(trim(regexp_replace(lower(p_name || ': ' || p_type), '[^a-z0-9]+', ' ', 'g')), '') AS title_key, trim(p_brand) AS head,
       CASE WHEN p_partkey % 2 = 0 THEN p_type || ' > ' || p_name END AS rest FROM part"""
)
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Title keys and the split of section paths into head and rest."""
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(">", F.concat(F.col("p_brand"), F.lit(" ")), F.concat(F.lit(" "), "p_type"), F.col("p_name"))).otherwise(F.col("p_brand"))
    title = T.title_key(F.concat_ws(": ", "p_name", "p_type"))
    return read(spark, sf, "part").select("p_partkey", title.alias("title_key"), T.section_head(path).alias("head"), T.section_rest(path).alias("rest"))


@query("""SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS token_estimate, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS shown, sha256(text) AS digest FROM documents""")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Budget estimate, shortened display text and content digest."""
    text = F.col("text")
    return read(spark, sf, "documents").select("doc_id", T.token_estimate(text).alias("token_estimate"), T.clip(text, 40).alias("shown"), F.sha2(text, 256).alias("digest"))


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="'))::BIGINT AS links, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs,
       array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))), ' ') AS assets FROM pages"""
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Title, counts and the sorted distinct links of a page."""
    html = F.col("html")
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))))
    return read(spark, sf, "pages").select(
        "page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(html, F.lit('<a href="')).cast("long").alias("links"),
        F.regexp_count(html, F.lit("<p>")).cast("long").alias("paragraphs"), F.array_join(links, " ").alias("assets"),
    )


@query()
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Typed blocks of pages by a tolerant HTML parser (heading stack, paragraphs, table rows, captions)."""
    return parse.html_blocks(read(spark, sf, "pages"), "page_id", "html").select("page_id", "block_no", "block_type", "section_path", "block_id")


@query()
def folded_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Exact compatibility folding of whole texts, for which there is no built-in function."""
    return read(spark, sf, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("key"))


@query(
    """SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS block_type, count(*)::BIGINT AS blocks, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL"""
)
def block_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Block-type histogram with character totals."""
    kind = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return read(spark, sf, "documents").groupBy("lang", kind.alias("block_type")).agg(F.count("*").alias("blocks"), F.sum("n_chars").alias("chars"))
