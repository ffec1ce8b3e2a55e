"""Containment join: which texts hold which anchors, as exact substrings, by equi-joins alone.

An anchor of five words or more has three neighbouring words that stand whole in every text which holds it; one of
three or four words has one.  Such a probe of every anchor is looked up among the texts' windows of words.  Shorter
anchors are looked up by their first characters among the texts' runs of up to three characters.  What is found is
then tested with the whole anchor and the whole text, so probes only decide how much is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probes that are looked up inside the row; beyond that, windows are joined to them by a shuffle.
INLINE = 2000
_GAP = "[ \\t\\n\\r]+"


def _runs(words: str, n: int) -> str:
    """SQL of the hashes of all runs of ``n`` entries of an array."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(n))
    return f"if(size({words}) < {n}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {n}), i -> xxhash64('{words}', {n}, {parts})))"


def _probe() -> Column:
    """(kind, hash) of an anchor: kind 3 and 1 for runs of whole words, else minus the number of characters."""
    longest = "aggregate(sequence(0, size(x) - {n}), named_struct('n', -1, 'h', 0L), (a, i) -> if(length(x[i]) > a.n, named_struct('n', length(x[i]), 'h', xxhash64('w', {n}, {parts})), a)).h"
    words = lambda n: longest.format(n=n, parts=", ".join(f"x[i + {k}]" for k in range(n)))
    head = "xxhash64('c', least(length(anchor), 3), " + ", ".join(f"if(length(anchor) > {k}, substring(anchor, {k + 1}, 1), null)" for k in range(3)) + ")"
    return F.expr(
        "element_at(transform(array(slice(w, 2, greatest(size(w) - 2, 0))), x -> case"
        f" when size(x) >= 3 then named_struct('kind', 3, 'hash', {words(3)})"
        f" when size(x) >= 1 then named_struct('kind', 1, 'hash', {words(1)})"
        f" else named_struct('kind', -least(length(anchor), 3), 'hash', {head}) end), 1)"
    )


def _windows(kind: int) -> str:
    if kind > 0:
        return _runs("w", kind)
    n = -kind
    parts = ", ".join(f"c[i + {k}]" if k < n else "cast(null as string)" for k in range(3))
    return f"if(size(c) < {n}, cast(array() as array<bigint>), transform(sequence(0, size(c) - {n}), i -> xxhash64('c', {n}, {parts})))"


def containing(texts: DataFrame, key: str, text: str, anchors: DataFrame, anchor_key: str, anchor: str) -> DataFrame:
    """(anchor_key, key): each pair of which the text holds the whole anchor, once.

    Null and empty anchors are held by no text, null texts hold none.  Repeated keys count once.
    """
    rows = anchors.select(F.col(anchor_key).alias("anchor_id"), F.col(anchor).alias("anchor")).where("anchor <> ''").distinct()
    rows = rows.withColumn("w", F.split("anchor", _GAP)).withColumn("p", _probe())
    rows = rows.select("anchor_id", "anchor", F.col("p.kind").alias("kind"), F.col("p.hash").alias("hash"))
    kinds = sorted(r["kind"] for r in rows.select("kind").distinct().collect())
    if not kinds:
        return texts.select(F.lit(None).cast(dict(anchors.dtypes)[anchor_key]).alias(anchor_key), F.col(key)).where("false")
    docs = texts.select(F.col(key).alias("doc"), F.col(text).alias("body")).where("body is not null")
    split = {"w": F.split("body", _GAP)} if kinds[-1] > 0 else {}
    split |= {"c": F.split("body", "")} if kinds[0] < 0 else {}
    found = F.array_distinct(F.flatten(F.array(*[F.expr(_windows(k)) for k in kinds])))
    docs = docs.withColumns(split)
    probes = rows.select("hash").distinct().limit(INLINE + 1).collect()
    if len(probes) <= INLINE:
        hits = docs.withColumn("hit", F.explode(F.array_intersect(found, F.lit([r["hash"] for r in probes])))).select("doc", "body", "hit")
        pairs = hits.join(F.broadcast(rows), F.col("hit") == F.col("hash"))
    else:
        narrow = docs.withColumn("hit", F.explode(found)).select("doc", "hit").join(rows, F.col("hit") == F.col("hash")).select("doc", "anchor_id", "anchor").distinct()
        body = texts.select(F.col(key).alias("d"), F.col(text).alias("body"))
        pairs = narrow.join(body, F.col("doc").eqNullSafe(F.col("d")))
    return pairs.where(F.col("body").contains(F.col("anchor"))).select(F.col("anchor_id").alias(anchor_key), F.col("doc").alias(key)).distinct()
