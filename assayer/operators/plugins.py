"""Places where a caller's own functions come in: page readers, OCR engines, entity finders, answerers, runners.

A plug-in is a factory that is called once per task on the executors and gives a function from a payload to rows.  A
factory that raises ImportError (its library isn't there) gives no rows, so plans that use it still run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.folders import Cuts

#: From a payload to rows of values.
Reader = Callable[[object], Sequence[tuple]]


def applied(rows: DataFrame, key: str, payload: str, factory: Callable[[], Reader], schema: str) -> DataFrame:
    """(key, ordinal, the reader's columns): the rows that a plug-in reads off each payload, numbered from 0.

    ``schema`` is that of the reader's rows.  A payload that the reader fails on (ValueError) gives none, nor does a null.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            read = factory()
        except ImportError:
            read = None
        for batch in batches:
            out = []
            for k, value in zip(batch[key], batch[payload]) if read else ():
                try:
                    found = read(value) if value is not None else ()
                except ValueError:
                    found = ()
                out += [(k, n, *row) for n, row in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "ordinal", *names])

    return rows.select(key, payload).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, ordinal long, {schema}")


def page_texts(spark: SparkSession, path: str, factory: Callable[[], Callable[[bytes], Sequence[str]]]) -> DataFrame:
    """(path, page_number, text): one row per non-empty page of the files below a path.

    ``factory`` gives a function from a file's bytes to its pages' texts; which library reads them is the caller's choice.
    """

    def pages() -> Reader:
        read = factory()
        return lambda data: [(text,) for text in read(bytes(data))]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = applied(files, "path", "content", pages, "text string")
    return rows.where("trim(text) <> ''").select("path", (F.col("ordinal") + 1).alias("page_number"), "text")


def form_feeds() -> Callable[[bytes], Sequence[str]]:
    """Reader of page dumps in plain text: pages end at form feeds."""
    return lambda data: data.decode("utf-8", "replace").split("\f")


def ocr(rows: DataFrame, key: str, image: str, engines: Sequence[Callable[[], Reader]]) -> DataFrame:
    """(key, ordinal, text, confidence, engine) of the first engine that is there; without any there are no rows.

    The choice is made on the executors, where the libraries have to be.
    """

    def first() -> Reader:
        for n, factory in enumerate(engines):
            try:
                read = factory()
            except ImportError:
                continue
            return lambda data, read=read, n=n: [(text, float(sure), n) for text, sure in read(data)]
        raise ImportError("no engine")

    return applied(rows, key, image, first, "text string, confidence double, engine int")


def entities(rows: DataFrame, key: str, text: str, factory: Callable[[], Reader]) -> DataFrame:
    """(key, ordinal, entity_type, start, stop, span) that a finder marks in the texts; none where it isn't there."""
    return applied(rows, key, text, factory, "entity_type string, start int, stop int, span string")


def patterns(found: dict[str, str]) -> Callable[[], Reader]:
    """A finder by regular expressions (type to pattern), with the spans that Spark's functions don't give."""

    def factory() -> Reader:
        import re

        compiled = {name: re.compile(p) for name, p in found.items()}
        return lambda text: sorted(((name, m.start(), m.end(), m.group()) for name, p in compiled.items() for m in p.finditer(text)), key=lambda x: (x[1], x[2], x[0]))

    return factory


def answered(questions: DataFrame, answerer: Callable[[DataFrame], DataFrame], gold: DataFrame) -> DataFrame:
    """(question_id, answered, correct, cited): answers of a caller's system against gold answers and evidence.

    questions: question_id, question; the answerer adds answer and evidence_ids; gold: question_id, answer, evidence_ids.
    An answer is correct if it or the gold answer contains the other, letters and digits alone; cited if it names any
    gold evidence.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    given = answerer(questions).select("question_id", F.col("answer").alias("_a"), F.col("evidence_ids").alias("_e"))
    rows = questions.select("question_id").join(given, "question_id", "left").join(gold, "question_id", "left")
    a, b = plain(F.col("_a")), plain(F.col("answer"))
    correct = (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    return rows.select("question_id", (a != "").alias("answered"), correct.alias("correct"), F.coalesce(F.arrays_overlap("_e", "evidence_ids"), F.lit(False)).alias("cited"))


def retried(tasks: DataFrame, key: str, run: Callable[[DataFrame, int], DataFrame], most: int = 3) -> DataFrame:
    """(key, ok, attempts): tasks handed to ``run(tasks, attempt)`` again and again until they succeed.

    ``run`` gives (key, ok) rows; tasks that it doesn't answer count as failed.  ``most`` bounds the attempts; what
    fails then stays failed and doesn't stop the others.
    """
    cut = Cuts(tasks.sparkSession, "retries")
    left, done = cut(tasks), None
    for attempt in range(1, most + 1):
        ok = run(left, attempt).groupBy(key).agg(F.bool_or("ok").alias("ok"))
        state = cut(left.join(ok, key, "left").withColumn("ok", F.coalesce("ok", F.lit(False))))
        part = state.where("ok" if attempt < most else "true").select(key, "ok", F.lit(attempt).alias("attempts"))
        done = part if done is None else done.unionByName(part)
        left = state.where("not ok").drop("ok")
        if attempt == most or left.isEmpty():
            return done
    return done
