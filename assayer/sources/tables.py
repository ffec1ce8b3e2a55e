"""Table scans and typed file scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header; every column is text, as declared; malformed rows fail."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", multiLine=True, escape='"')


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines of a fixed schema with their file; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).json(path, mode="FAILFAST").withColumn("source_file", F.input_file_name())


def unknown_keys(rows: DataFrame, raw: str, known: Sequence[str]) -> DataFrame:
    """Adds ``unknown``: top-level keys of a JSON text that the schema doesn't know."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return rows.withColumn("unknown", F.array_except(keys, F.lit(list(known))))


def first_root(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Documents of several result roots; of equal keys the earliest root's stays."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("_root", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_root")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_root")


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, doi, pmcid) of bibliographic XML pages."""
    schema = "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string>>, PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>"
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    pick = lambda kind: F.get(F.filter(ids, lambda x: x["_IdType"] == kind), 0)["_VALUE"]
    return rows.select(F.col("MedlineCitation.PMID").alias("pmid"), F.col("MedlineCitation.Article.ArticleTitle").alias("title"), pick("doi").alias("doi"), pick("pmc").alias("pmcid"))


def europe_pmc(pages: DataFrame, payload: str) -> DataFrame:
    """(source, id, pmid, pmcid, doi, title, url) of result pages; the url falls back from DOI to source and id."""
    schema = "struct<resultList: struct<result: array<struct<source: string, id: string, pmid: string, pmcid: string, doi: string, title: string>>>>"
    rows = pages.select(F.explode(F.from_json(payload, schema)["resultList"]["result"]).alias("r")).select("r.*")
    return rows.withColumn("url", F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), F.concat_ws("/", F.lit("https://europepmc.org/article"), "source", "id")))


def with_defaults(df: DataFrame, schema: StructType) -> DataFrame:
    """Additive migration: columns that the schema has and ``df`` lacks come as nulls, in the schema's order."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def inspect(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> DataFrame:
    """(table_name, rows) of the named tables."""
    rows = None
    for name in names:
        part = read(spark, sf_dir, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        rows = part if rows is None else rows.unionByName(part)
    return rows
