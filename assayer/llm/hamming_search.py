"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is above 0.  Codes are cut into segments of 8 or
16 bits, each an index (segment, value) to distinct codes.  A query probes all segments with every value within
radius r of its own; whatever isn't found then differs in more than r bits of each of m segments, so its
distance is m * (r + 1) at least.  The radius grows by one until a query's k-th verified distance is below
that.  From the second round on, probes only pass on codes that aren't farther than the k-th distance so far.

Equal codes are one entry with its smallest k + 1 ids (the rest can't be among k neighbours, ties going to the
smaller id), so a vector that a third of all rows share costs one row.  Rows without a vector have no code:
they are no neighbours, and as queries have none.  A row is no neighbour of its own id.  Null elements give
bit 0, longer vectors more segments, shorter ones than the longest are padded with 0 bits.  Repeated rows count
once per id and code.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.sources.folders import Cuts

#: Bits of a segment: near the logarithm of the number of codes, and a divisor of 64.
WIDE, NARROW, FEW_CODES = 16, 8, 4096


def code_of(vector: Column, words: int) -> Column:
    """array<bigint> of ``words`` 64-bit words, the first dimension lowest."""
    word = lambda w: F.aggregate(
        F.transform(F.slice(vector, 64 * w + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(x),
    )
    return F.when(vector.isNotNull(), F.array(*[word(w) for w in range(words)]))


def distance(a: str, b: str, words: int) -> str:
    return "(" + " + ".join(f"bit_count({a}[{w}] ^ {b}[{w}])" for w in range(words)) + ")"


def segments_of(code: str, segments: int, bits: int) -> Column:
    """array of (segment, value) of a code."""
    at = [divmod(bits * s, 64) for s in range(segments)]
    parts = [f"struct({s} as segment, cast(shiftrightunsigned({code}[{w}], {b}) & {(1 << bits) - 1} as int) as value)" for s, (w, b) in enumerate(at)]
    return F.expr(f"array({', '.join(parts)})")


def masks(radius: int, bits: int) -> list[int]:
    """Values of ``bits`` bits of which ``radius`` are set."""
    return [x for x in range(1 << bits) if x.bit_count() == radius]


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest rows of each query, ties by the smaller id."""
    dims = base.agg(F.max(F.size(vector))).first()[0]
    words = max(1, -(-max(dims or 0, 0) // 64))
    coded = lambda df: df.select(F.col(id_column).alias("id"), code_of(F.col(vector), words).alias("code")).where("code is not null and id is not null")

    order = Window.partitionBy("code").orderBy("id")
    ids = coded(base).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).checkpoint()
    sizes = ids.groupBy("code").agg(F.count("*").alias("n")).checkpoint()
    bits = WIDE if sizes.count() >= FEW_CODES else NARROW
    segments = max(1, -(-max(dims or 1, 1) // bits))
    index = sizes.select("code", F.explode(segments_of("code", segments, bits)).alias("x")).select(F.col("x.segment"), F.col("x.value"), "code").checkpoint()

    asked = coded(queries)
    pending = asked.select("code").distinct().select(F.col("code").alias("q"), F.lit(None).cast("int").alias("bound")).checkpoint()
    spark = ids.sparkSession
    found, done = spark.createDataFrame([], "q array<bigint>, code array<bigint>, far int"), []
    near_, state_, done_ = Cuts(spark, "near"), Cuts(spark, "state"), Cuts(spark, "done")
    for radius in range(bits + 1):
        probe = pending.select("q", "bound", F.explode(segments_of("q", segments, bits)).alias("x"))
        probe = probe.select("q", "bound", F.col("x.segment").alias("segment"), F.explode(F.transform(F.lit(masks(radius, bits)), lambda m: F.col("x.value").bitwiseXOR(m))).alias("value"))
        near = F.expr(f"bound is null or {distance('q', 'code', words)} <= bound")
        # A few queries make very many probes, so they are never the side to broadcast.
        new = probe.hint("merge").join(index, ["segment", "value"]).where(near).select("q", "code", F.expr(distance("q", "code", words)).cast("int").alias("far"))
        found = found.unionByName(new).distinct()
        sized = found.join(sizes, "code")
        running = Window.partitionBy("q").orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sized = sized.withColumn("upto", F.sum("n").over(running))
        # The codes up to the distance at which k + 1 ids are reached.
        reached = Window.partitionBy("q")
        sized = sized.withColumn("kth", F.min(F.when(F.col("upto") >= k + 1, F.col("far"))).over(reached))
        found = sized.where("kth is null or far <= kth").select("q", "code", "far", "kth")
        found = near_(found)
        state = pending.join(found.groupBy("q").agg(F.max("kth").alias("kth")), "q", "left")
        last = radius == bits
        covered = F.lit(True) if last else F.coalesce(F.col("kth") < segments * (radius + 1), F.lit(False))
        settled = state_(state.withColumn("over", covered).select("q", "kth", "over"))
        done.append(done_(found.join(settled.where("over").select("q"), "q").select("q", "code", "far")))
        pending = settled.where("not over").select("q", F.col("kth").alias("bound"))
        near_.keep(1)
        state_.keep(1)
        found = found.join(pending.select("q"), "q").select("q", "code", "far")
        if pending.isEmpty():
            break
    rows = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct().join(reduce(DataFrame.unionByName, done), "q").join(ids.select("code", "id"), "code").where("id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy("far", "id")
    rows = rows.select("query_id", "id", "far").distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", F.col("id").alias("neighbour_id"), F.col("far").cast("long").alias("distance"))
