"""Result statements of clauses, one row per value that is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of result statements, and phrases in the order in which they count.
NUMERIC = r"(?i)(?:approximately\s+|about\s+|over\s+|fewer than\s+|less than\s+)?\d+(?:\.\d+)?(?:\s*[±+/-]\s*\d+(?:\.\d+)?)?\s*(?:%|percent|fold)"
CUE = (
    r"(?i)\b(express|detect|observ|show|found|result|increase|decrease|reduce|improv|ameliorat|eliminat|phagocyt|colocali[sz]|uptake|translation|knockdown|activity|frequency)\w*"
)
NEGATIVE = r"(?i)\b(no|not|none|without|absent|solely|few|fewer than|less than|below|undetect|exclusive(?:ly)?|did not|was not|were not)\b"
BELOW_DETECTION = r"(?i)\b(no obvious|no detectable|undetect|below detection)\b"
NOT_DETECTED = r"(?i)\b(no|none|absent|did not)\b"
COMPARISON = r"(?i)\b(compared with|versus|vs\.?|than|in contrast)\b"
SPLIT = r"(?i)\s*(?:;|\bwhile\b|\bwhereas\b|\bin contrast\b)\s*"
POPULATIONS = (
    r"(?i)\b(?:CD11b|CD45|CD31|F4/80|LYVE-?1|HNF4α|Desmin|ALB)\+?\s*(?:positive\s*)?cells?\b",
    r"(?i)\b(?:Kupffer cells?|hepatocytes?|LSECs?|HSCs?|BMDMs?|macrophages?|JS-1 cells?|LX-2 cells?)\b",
)
PHRASES = (
    "no obvious", "no detectable", "few", "solely", "exclusively", "exclusive", "absent", "significantly eliminated", "eliminated", "colocalized", "significantly reduced",
    "significantly increased", "improved", "ameliorated",
)


def numeric_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def atoms(clauses: DataFrame, paper: str, order: list[str], clause: str, text: str) -> DataFrame:
    """(paper, clause, candidate_id, raw_text, value_text, value_type, polarity, detection_status, comparison, population,
    endpoint_hint) of every value that a clause states.

    Clauses without a number or a result word state nothing.  A clause falls into segments at connectives; a segment gives
    a row for each of its numbers, else one for its qualitative phrase.  Numbers in ids run through a paper.
    """
    rows = clauses.where(F.col(text).rlike(CUE) | F.col(text).rlike(NUMERIC))
    segments = F.transform(F.filter(F.split(text, SPLIT), lambda s: F.trim(s) != ""), lambda s: F.btrim(s, F.lit(" ,.")))
    rows = rows.select(paper, *[c for c in dict.fromkeys([*order, clause]) if c != paper], F.posexplode(segments).alias("_s", "raw_text"))
    raw = F.col("raw_text")
    told = F.coalesce(*[F.when(F.lower(raw).contains(p), F.lit(p)) for p in PHRASES], F.trim(raw))
    rows = rows.withColumn("_numbers", numeric_values(raw))
    values = F.when(F.size("_numbers") > 0, F.col("_numbers")).when(raw.rlike(CUE), F.array(told)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("*", F.posexplode(values).alias("_v", "value_text"))
    place = Window.partitionBy(paper).orderBy(*order, "_s", "_v")
    number = F.row_number().over(place).cast("string")
    digest = F.substring(F.sha1(F.concat(raw, F.col("value_text"))), 1, 8)
    ident = F.concat_ws("-", F.lit("RC"), F.col(clause).cast("string"), F.lpad(number, F.greatest(F.length(number), F.lit(2)), F.lit("0")), digest)
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), F.lit(-1))
    kind = F.when(F.size("_numbers") > 0, "numeric").when(raw.rlike(COMPARISON), "comparative").otherwise("qualitative")
    detection = F.when(raw.rlike(BELOW_DETECTION), "below_detection").when(raw.rlike(NOT_DETECTED), "not_detected").otherwise("detected")
    return rows.select(
        paper, clause, ident.alias("candidate_id"), "raw_text", "value_text", kind.alias("value_type"), F.when(raw.rlike(NEGATIVE), "negative").otherwise("positive").alias("polarity"),
        detection.alias("detection_status"), _first(raw, COMPARISON).alias("comparison"), F.coalesce(*[last(p) for p in reversed(POPULATIONS)]).alias("population"), _first(raw, CUE).alias("endpoint_hint"),
    )


def cardinality(clauses: DataFrame, stated: DataFrame, clause: str, text: str) -> DataFrame:
    """(clause, expected, found): clauses with more numbers than numeric statements."""
    found = stated.where("value_type = 'numeric'").groupBy(clause).agg(F.count("*").alias("found"))
    rows = clauses.select(clause, F.size(numeric_values(F.col(text))).cast("long").alias("expected")).join(found, clause, "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(0)).cast("long")).where("found < expected")
