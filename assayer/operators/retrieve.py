"""Lexical, vector and fused retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.stem import porter
from assayer.operators.dedup import _cut
from assayer.operators.relate import checked


def words_of(text: Column, least: int = 3) -> Column:
    """[a-z0-9]+ runs of at least ``least`` letters, in order, repeats included."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least)


def terms(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, term, tf): counts of the text's words."""
    return df.select(F.col(key), F.explode(words_of(F.col(text), least)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _stems(rows: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms; each is stemmed once."""
    return rows.select("term").distinct().withColumn("stem", porter("term"))


def _asked(queries: DataFrame, query: str, text: str, stem: bool) -> DataFrame:
    asked = terms(queries, query, text).select(query, "term")
    if stem:
        asked = asked.join(_stems(asked), "term").select(query, F.col("stem").alias("term"))
    return asked.distinct()


def _scored(post: DataFrame, asked: DataFrame, n: int, mean: float, doc: str, query: str, k: int, k1: float, b: float) -> DataFrame:
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / (mean or 1.0)))
    scored = post.join(df, "term").select(doc, "term", part.alias("part")).join(asked, "term").groupBy(query, doc).agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scored, query, doc, k)


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int, k1: float = 1.2, b: float = 0.75, stem: bool = False) -> DataFrame:
    """(query, doc, score, rank): Okapi scores over whole tables; ids break ties.

    Texts are read once: words that no query asks for fall together per document, and each document has one such row,
    from which the number and mean length of documents are taken.  ``stem`` compares words by their Porter stems.
    """
    asked = _cut(_asked(queries, query, text, stem))
    rows = docs.select(F.col(doc), words_of(F.col(text)).alias("w")).select(doc, F.size("w").alias("size"), F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    wanted = asked.select(F.col("term").alias("want")).distinct()
    if stem:
        rows = rows.join(_stems(rows.where("term is not null")), "term", "left").select(doc, "size", F.col("stem").alias("term"))
    rows = rows.join(checked(wanted), F.col("term") == F.col("want"), "left").groupBy(doc, "size", F.col("want").alias("term")).agg(F.count("*").alias("tf"))
    rows = _cut(rows)
    total = rows.where("term is null").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    return _scored(rows.where("term is not null"), asked, total["n"], total["mean"], doc, query, k, k1, b)


def build_index(docs: DataFrame, doc: str, text: str, path: str, stem: bool = True) -> None:
    """Writes postings (term, doc, tf, size) by term and the table's totals below ``path``, replacing what is there.

    Postings are dealt by ranges of terms and sorted, so a search reads only the row groups that can hold its terms.
    """
    rows = docs.select(F.col(doc).alias("doc"), words_of(F.col(text)).alias("w")).select("doc", F.size("w").alias("size"), F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    if stem:
        rows = rows.join(_stems(rows.where("term is not null")), "term", "left").select("doc", "size", F.col("stem").alias("term"))
    rows = _cut(rows.groupBy("doc", "size", "term").agg(F.count("*").alias("tf")))
    rows.where("term is null").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).withColumn("stem", F.lit(stem)).write.mode("overwrite").parquet(f"{path}/totals")
    rows.where("term is not null").repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")


def search_index(queries: DataFrame, query: str, text: str, path: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank) from a written index."""
    spark = queries.sparkSession
    total = spark.read.parquet(f"{path}/totals").first()
    asked = _cut(_asked(queries, query, text, total["stem"]))
    post = spark.read.parquet(f"{path}/postings").join(checked(asked.select("term").distinct()), "term")
    return _scored(_cut(post), asked, total["n"], total["mean"], "doc", query, k, k1, b)


def tfidf(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int) -> DataFrame:
    """(query, doc, score, rank): cosine of sublinear tf times smoothed idf, unigrams and bigrams."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        w = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9][a-z0-9]+"), F.lit(0))
        rows = df.select(F.col(key), w.alias("w"))
        pairs = F.expr("if(size(w) > 1, zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b)), cast(array() as array<string>))")
        return rows.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count("*"))).alias("tf"))

    n = docs.count()
    post = grams(docs, doc)
    idf = post.groupBy("term").agg((F.log((1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    weight = post.join(idf, "term").select(doc, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weight.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = grams(queries, query).join(idf, "term").select(query, "term", (F.col("tf") * F.col("idf")).alias("q"))
    qnorm = asked.groupBy(query).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    dots = weight.join(checked(asked), "term").groupBy(query, doc).agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    scored = dots.join(norm, doc).join(checked(qnorm), query).select(query, doc, F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))
    return ranked(scored.where("score > 0"), query, doc, k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Measures of a pair of vectors, larger is nearer.
MEASURES = {"cosine": cosine, "inner": lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)}
#: Queries that are held against all rows at a time.
QUERY_BLOCK = 500


def dense(base: DataFrame, queries: DataFrame, key: str, query: str, vector: str, k: int, measure: str = "cosine") -> DataFrame:
    """(query, key, score, rank): exact scores of a stated query set against all rows, in blocks of ``QUERY_BLOCK``.

    A block of queries is one broadcast row, so every row of ``base`` is read once per block and keeps no more than
    its scores; the k best of each query are taken partition by partition before the shuffle.  Rows without a vector
    have no score.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias(query), F.col(vector).alias("_q"))
    place = F.row_number().over(Window.orderBy(query)) - 1
    blocks = _cut(asked.withColumn("_block", F.floor(place / QUERY_BLOCK)).groupBy("_block").agg(F.collect_list(F.struct(query, "_q")).alias("_asked")))
    found = None
    rows = base.where(F.col(vector).isNotNull())
    for r in blocks.select("_block").orderBy("_block").collect():
        block = blocks.where(F.col("_block") == r["_block"]).select("_asked")
        part = rows.join(F.broadcast(block)).select(key, vector, F.inline("_asked")).where(F.col(key) != F.col(query))
        part = ranked(part.select(query, key, F.round(MEASURES[measure](F.col(vector), F.col("_q")), 6).alias("score")), query, key, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select(F.col(key).alias(query), key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).where("false")
    return found


class Backend(Protocol):
    """What a vector search is made of: ``build`` takes (key, text or vector) rows, ``search`` gives scored keys."""

    def build(self, rows: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass
class DenseBackend:
    """Exact search over all rows: ``cosine`` or ``inner`` products; ``distance`` gives one minus the cosine distance."""

    key: str = "vec_id"
    query: str = "query_id"
    vector: str = "embedding"
    measure: str = "cosine"
    rows: DataFrame | None = None

    def build(self, rows: DataFrame) -> None:
        self.rows = rows

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return dense(self.rows, queries, self.key, self.query, self.vector, k, "cosine" if self.measure == "distance" else self.measure)


@dataclass
class TfidfBackend:
    """Lexical vectors of one and two words."""

    key: str
    query: str
    text: str = "text"
    rows: DataFrame | None = None

    def build(self, rows: DataFrame) -> None:
        self.rows = rows

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return tfidf(self.rows, queries, self.key, self.query, self.text, k)


@dataclass
class IndexBackend:
    """BM25 over an index that is written below a path and stays there."""

    path: str
    key: str
    query: str
    text: str = "text"
    stem: bool = True

    def build(self, rows: DataFrame) -> None:
        build_index(rows, self.key, self.text, self.path, self.stem)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search_index(queries, self.query, self.text, self.path, k)


def ranked(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def fuse(lists: Sequence[DataFrame], query: str, key: str, k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists."""
    rows = None
    for x in lists:
        part = x.select(query, key, (1.0 / (c + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return ranked(rows.groupBy(query, key).agg(F.round(F.sum("part"), 8).alias("score")), query, key, k)


def neighbour_rounds(fused: DataFrame, known: DataFrame, query: str, key: str, k: int, seeds: int = 4, share: float = 0.18) -> DataFrame:
    """(query, key, score, rank): the neighbours (key - 1 and key + 1, if known) of a query's first ``seeds`` hits get a
    share of their score, hit after hit, so that a bonus counts for the hits after it.

    A query's list is short, and its walk is one small grouped task.
    """
    kinds = dict(fused.dtypes)
    near = fused.where(F.col("rank") <= seeds).select(F.explode(F.array(F.col(key) - 1, F.col(key) + 1)).alias(key)).distinct()
    there = near.join(known.select(key), key, "left_semi").select(F.col(key).alias("_near"))
    rows = fused.select(query, key, "score", "rank")
    sides = rows.select(query, F.explode(F.array(F.col(key) - 1, F.col(key) + 1)).alias("_near")).distinct().join(checked(_cut(there)), "_near", "left_semi")
    lists = rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k"), "score"))).alias("hits"))
    lists = lists.join(sides.groupBy(query).agg(F.collect_set("_near").alias("near")), query, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, hits, near in zip(batch[query], batch["hits"], batch["near"]):
                scores, allowed = {h["k"]: h["score"] for h in hits}, set(near) if near is not None else set()
                for h in hits[:seeds]:
                    for side in (h["k"] - 1, h["k"] + 1):
                        if side in allowed:
                            scores[side] = scores.get(side, 0.0) + scores[h["k"]] * share
                out += [(q, i, s) for i, s in scores.items()]
            yield pd.DataFrame(out, columns=[query, key, "score"])

    scored = lists.mapInPandas(run, f"{query} {kinds[query]}, {key} {kinds[key]}, score double")
    return ranked(scored.withColumn("score", F.round("score", 8)), query, key, k)
