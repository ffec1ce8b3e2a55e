"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of documents by a hash, and its blocks stand in an order permuted by another
hash.  A source's target is whole passes over all its blocks plus a rest; the rest takes blocks in their order
until the target is reached, and inside the last one documents in hashed order.  That gives each source a number
of block draws.  A binary tree over the output shards splits the vector of these numbers by
multivariate-hypergeometric samples, down to one exact quota of each source for every shard.  A shard then draws
its quota: the next blocks of each source's permuted list that no other shard has drawn.  Which shards hold a
document, and how often it is taken, is read off these draws alone.  Rows are dealt to their shards and shuffled
locally by a hash within them.

The driver holds one row per source (``MOST_SOURCES`` at most, counted, else an error: sources beyond that should
be grouped first) and one small number per block draw (``MOST_BLOCKS`` blocks plus one per source at most, since
blocks get larger in larger corpora), never documents.  Tables that are broadcast have these bounds.

Hashes of id and text alone decide, so reruns agree on any cluster.  A null source is a source of its own and
sorts last.  Empty and null texts have size 0, weigh nothing and are in no shard.  Rows with equal id and text can't be
told apart: they share a block and are taken alike, as one document of their joint size, so a source ends within half of
that of its target.  An empty table gives an empty result; columns of the input never clash with working columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import BLANK_RUN, BLANKS, free_name, rows_of, small

WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: Words of a block at least, blocks of all sources (plus one per source) at most, and sources at most.
BLOCK_WORDS, MOST_BLOCKS, MOST_SOURCES = 20_000, 1 << 18, 100_000
#: Words of a shard where the number of shards is not given; SHARDS is then the least number.  Shards of small mixes
#: share partitions of about so many words, one after the other.
SHARDS, SHARD_WORDS, SEED = 16, 2_000_000, 11


def size_of(text: Column) -> Column:
    """Number of words between blanks as long; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[float]:
    """Targets of sources in order: shares by repeating weights, stopped at ``most`` times the size, the excess shared anew."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    result = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] > most * sizes[i] * total]
        if not over:
            for i in open_:
                result[i] = left * weight[i] / total
            break
        for i in over:
            result[i] = Fraction(most * sizes[i])
        left -= sum(result[i] for i in over)
        open_ -= set(over)
    return [float(x) for x in result]


def split_tree(draws: Sequence[int], shards: int, seed: int = SEED) -> list[list[tuple[int, int]]]:
    """For each source its quotas (shard, draws) in order of shards, zeros left out.

    Every node splits its counts in halves by a multivariate-hypergeometric sample, so a source's quotas add up to
    its draws and shards differ by one draw at most.  Nodes hold only sources that still have draws.
    """
    quotas: list[list[tuple[int, int]]] = [[] for _ in draws]
    counts = np.asarray(draws, np.int64).reshape(-1)
    nodes = [(np.flatnonzero(counts), counts[counts > 0], 0, shards)]
    while nodes:
        which, n, first, last = nodes.pop()
        if not len(which):
            continue
        if last - first == 1:
            for i, k in zip(which.tolist(), n.tolist()):
                quotas[i].append((first, k))
            continue
        middle = (first + last) // 2
        size = int(n.sum()) * (middle - first) // (last - first)
        left = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(n, size, method="marginals")
        right = n - left
        nodes.append((which[right > 0], right[right > 0], middle, last))
        nodes.append((which[left > 0], left[left > 0], first, middle))
    return quotas


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _sources(narrow: DataFrame, block_words: int, most_blocks: int) -> DataFrame:
    """Size, target, whole passes, rest and number of blocks of each source."""
    sums = narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them before mixing")
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    words = max(block_words, -(-sum(r["n"] for r in sums) // most_blocks))
    rows = []
    for r, goal in zip(sums, targets([r["n"] for r in sums])):
        passes = int(goal // r["n"]) if r["n"] else 0
        rest = goal - passes * r["n"] if r["n"] else 0.0
        rows.append((r["source"], r["n"], goal, passes, rest, max(1, -(-r["n"] // words))))
    return narrow.sparkSession.createDataFrame(rows, "s string, source_size long, target double, passes int, rest double, blocks long")


def _blocks(narrow: DataFrame, sources: DataFrame, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """(bs, b, dealt, partly, last) of each block, and the number of partitions for the shards.

    ``dealt``: the shards that draw the block, one per draw.  The last draw of a ``partly`` drawn block takes only
    documents whose key is ``last`` at most.
    """
    sums = _placed(narrow, sources).groupBy("s", "block", "passes", "rest").agg(F.sum("size").alias("words")).checkpoint()
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "s", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"place": F.row_number().over(order) - 1, "left": F.col("rest") - before})
    sums = sums.withColumn("whole", F.col("left") >= F.col("words")).withColumn("partly", (F.col("left") > 0) & ~F.col("whole"))
    blocks = sums.select("s", F.col("block").alias("b"), "place", "left", "whole", "partly", "passes").checkpoint()

    # One block of each source at most is partly taken: its documents by key, while their middle lies within what is left.
    part = blocks.where("partly").select(F.col("s").alias("ps"), F.col("b").alias("pb"), "left")
    inner = _placed(narrow, sources).join(F.broadcast(part), _same(F.col("s"), F.col("ps")) & (F.col("block") == F.col("pb")))
    inner = inner.groupBy("ps", "pb", "left", "key").agg(F.sum("size").alias("words"))
    ranked = Window.partitionBy("ps", "pb").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("before", F.coalesce(F.sum("words").over(ranked), F.lit(0)))
    cut = inner.where("before + words / 2.0 <= left").groupBy("ps", "pb").agg(F.max("key").alias("last"))
    blocks = blocks.join(F.broadcast(cut), _same(F.col("s"), F.col("ps")) & (F.col("b") == F.col("pb")), "left").drop("ps", "pb").checkpoint()

    # Whole passes draw every block; the rest draws its first blocks once more.
    extra = F.count_if(F.col("whole") | F.col("last").isNotNull())
    drawn = blocks.groupBy("s").agg(F.count("*").alias("n"), (F.first("passes") * F.count("*") + extra).alias("draws")).collect()
    drawn.sort(key=lambda r: (r["s"] is None, (r["s"] or "").encode("utf-32-be")))
    goal = sources.agg(F.sum("target")).first()[0] or 0
    parts = shards or max(1, min(int(goal // SHARD_WORDS) + 1, sum(r["draws"] for r in drawn)))
    quotas = split_tree([r["draws"] for r in drawn], shards or max(SHARDS, parts), seed)
    # A source's draws in permuted order go to shard after shard, to each as many as its quota.
    lists = [(r["s"], r["n"], [k for k, n in quota for _ in range(n)]) for r, quota in zip(drawn, quotas)]
    lists = narrow.sparkSession.createDataFrame(lists, "ds string, n long, draws array<int>")
    blocks = blocks.join(F.broadcast(lists), _same(F.col("s"), F.col("ds")))
    dealt = F.expr("filter(transform(sequence(0, passes), c -> get(draws, cast(place + c * n as int))), x -> x is not null)")
    return blocks.select(F.col("s").alias("bs"), "b", dealt.alias("dealt"), (F.col("partly") & F.col("last").isNotNull()).alias("partly"), "last").checkpoint(), parts


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    joined = rows.join(F.broadcast(sources), _same(F.col("source"), F.col("s"))).drop("source")
    return joined.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))


def _dealt(
    df: DataFrame, id_column: str, text: str, source: str, shards: int | None, block_words: int, most_blocks: int, seed: int
) -> tuple[DataFrame, int]:
    """(row, size, source_size, target, shards, order) and the number of partitions for its shards.

    Texts aren't shuffled: sizes are taken beside the rows, and only tables per source and per block are joined to
    them.
    """
    row = F.col("row")
    key = F.xxhash64(F.lit(seed), row[id_column].cast("string"), row[text])
    docs = rows_of(df).withColumns({"size": size_of(row[text]), "source": row[source].cast("string"), "key": key})
    narrow = docs.select("source", "size", "key").checkpoint()
    sources = _sources(narrow, block_words, most_blocks)
    blocks, parts = _blocks(narrow, sources, shards, seed)
    rows = _placed(docs, sources).join(small(blocks), _same(F.col("s"), F.col("bs")) & (F.col("block") == F.col("b")))
    drawn = F.when(F.col("partly") & (F.col("key") > F.col("last")), F.expr("slice(dealt, 1, greatest(size(dealt) - 1, 0))")).otherwise(F.col("dealt"))
    drawn = F.when(F.col("size") > 0, drawn).otherwise(F.array().cast("array<int>"))
    return rows.select("row", "size", "source_size", "target", drawn.alias("shards"), F.xxhash64(F.lit(seed + 2), "key").alias("order")), parts


def mix(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None,
    block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS, seed: int = SEED,
) -> DataFrame:
    """(row, size, source_size, target, shards, order) of every row: ``shards`` has one entry for each time it is drawn."""
    return _dealt(df, id_column, text, source, shards, block_words, most_blocks, seed)[0]


def taken(df: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every document.

    ``taken``: words that the shards' draws hold of it; ``shards``: those shards, joined by commas.
    """
    rows = mix(df.select("doc_id", "text", "source"), seed=seed)
    words = F.aggregate("shards", F.lit(0).cast("long"), lambda a, _: a + F.col("size"))
    return rows.select(
        F.col("row")["doc_id"].alias("doc_id"), "size", "source_size", "target", words.alias("taken"), F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards")
    )


def sharded(df: DataFrame, shards: int | None = None, seed: int = SEED, name: str = "_shard") -> DataFrame:
    """The mix, dealt by shard and shuffled within it, and the shard in ``name``.

    A document stands once for each draw; copies in one shard have places of their own.
    """
    rows, parts = _dealt(df, "doc_id", "text", "source", shards, BLOCK_WORDS, MOST_BLOCKS, seed)
    rows = rows.select("row", "order", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.select("row", "shard", F.xxhash64("order", "copy").alias("order"))
    rows = rows.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "order")
    return rows.select("row.*", F.col("shard").alias(name))


def mixed(df: DataFrame) -> DataFrame:
    """The mix itself with the columns of ``df``: rows stand by shard, shuffled in each."""
    shard = free_name(df, "_shard")
    return sharded(df, name=shard).drop(shard)
