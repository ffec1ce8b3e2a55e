"""The corpus pipeline: quality classifier, SimHash near-dedup, secret scan, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` has the columns of ``documents``.
Between stages the rows are written as Parquet and read again, by whoever runs ``STAGES`` or by ``run``.

* quality: rows stay whose posterior, from the document model and its host and path, reaches one half.
* dedup: the row with the smallest doc_id of each group of similar texts stays.
* secrets: secrets are replaced in the texts; all rows stay.
* mixing: rows stay as often as the shards draw them, not at all, once or twice, and stand by shard, shuffled in each.
* packing: the pieces of all documents with their ids (little-endian 32 bit).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import mixing, packing, quality_model, secrets, simhash
from assayer.llm.common import labels_of, ready, table

#: Vocabulary file of the packing stage; None takes the public tokenizer of that name.
TOKENIZER: str | None = None
VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, labels_of(ready(spark), sf_dir, "quality"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.example_findings(ready(spark))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ready(spark)
    return packing.pack(docs, TOKENIZER or public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", secret_scan), ("mixing", mix), ("packing", pack)]
#: Fingerprints, the forest and the tokenizer have no SQL form; tests check every stage's result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    A stage's rows are deleted once the next stage's are written; the last stage's stay for the result.
    """
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
