"""Deduplication and entity resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators.relate import checked
from assayer.sources.folders import Cuts, shared_folder


def exact(df: DataFrame, key: Column, order: list[str], sets: dict[str, str], first: list[str]) -> DataFrame:
    """One row per key: ``digest`` (SHA-256 of the key), counts, sorted sets of columns (``sets``: output to column) and
    the first row's columns.

    Rows are grouped by the digest, so long keys are never shuffled; grouping is one hash aggregation with partial sums.
    """
    place = F.struct(*order)
    aggs = [F.count("*").alias("members")]
    aggs += [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name) for name, c in sets.items()]
    aggs += [F.min_by(c, place).alias(f"first_{c}") for c in first]
    digest = F.unhex(F.sha2(key, 256))
    found = df.select(digest.alias("_d"), *dict.fromkeys([*order, *sets.values(), *first])).groupBy("_d").agg(*aggs)
    return found.select(F.lower(F.hex("_d")).alias("digest"), *[c for c in found.columns if c != "_d"])


def clauses(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, position from 1, clause, norm): one row per sentence."""
    rows = df.select(id_column, F.posexplode(T.sentences(F.col(text))).alias("p", "clause"))
    return rows.select(id_column, (F.col("p") + 1).alias("position"), "clause", T.normalise(F.col("clause")).alias("norm"))


def clause_groups(df: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    """(clause_id, members, documents, sources, first_doc, first_position): sentences equal but for blanks and case.

    ``documents`` counts rows of ``df`` that hold the sentence.  A row marks the first of equal sentences itself, by
    sorting their digests, so one aggregation with partial sums is the only shuffle, and it moves digests, not texts.
    """
    norms = F.transform(T.sentences(F.col(text)), lambda s: F.substring(F.sha2(T.normalise(s), 256), 1, 32))
    rows = df.select(F.col(id_column).alias("doc"), F.col(source).alias("source"), F.expr("0").alias("z"), norms.alias("h"))
    rows = rows.select("doc", "source", F.inline(F.array(F.struct(F.expr("sort_array(transform(h, (x, i) -> struct(x as h, i as i)))").alias("s")))))
    marked = F.expr("transform(s, (x, k) -> struct(x.h as h, x.i as i, k = 0 or s[k - 1].h <> x.h as first))")
    rows = rows.select("doc", "source", F.inline(marked))
    found = rows.groupBy("h").agg(
        F.count("*").alias("members"), F.count_if(F.col("first")).alias("documents"), T.joined_set(F.collect_set("source")).alias("sources"),
        F.min("doc").alias("first_doc"), F.min(F.struct("doc", "i"))["i"].alias("first_position"),
    )
    return found.select(F.substring("h", 1, 16).alias("clause_id"), "members", "documents", "sources", "first_doc", (F.col("first_position") + 1).cast("long").alias("first_position"))


def canonical_first(df: DataFrame, digest: list[str], order: str, name: str = "canonical") -> DataFrame:
    """Adds the smallest ``order`` among rows of equal digest.

    Only digests of several rows are joined back, so copies of one row, however many, don't meet in one task.
    """
    least = df.groupBy(*digest).agg(F.min(order).alias("_least"), F.count("*").alias("_n")).where("_n > 1").select(*digest, "_least")
    return df.join(checked(_cut(least)), digest, "left").withColumn(name, F.coalesce("_least", order)).drop("_least")


#: Edges that one task joins by itself; more are joined in rounds.
SMALL_EDGES = 500_000


def _joined(edges: pd.DataFrame) -> pd.DataFrame:
    """Components of edges between numbers, by minima and shortcuts over arrays."""
    nodes, places = np.unique(edges[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = places.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return pd.DataFrame({"node": nodes, "component": nodes[label]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over edges (a, b) between numbers.

    Up to ``SMALL_EDGES`` edges, counted, are joined in one task.  More are joined by repeated minima and shortcuts in
    rounds that go on until no label changes, so chains of any length settle; a shortcut halves what is left of a chain.
    """
    edges = _cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    if edges.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        return edges.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_joined, "node long, component long")
    cut = Cuts(edges.sparkSession, "components")
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("a").alias("new"), F.col("label").alias("far"))
        new = cut(step.join(jump, "new").select("a", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")))
        labels = new.select("a", "label")
        if new.where("moved").isEmpty():
            cut.keep(1)
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
        cut.keep(1, first=1)


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _blocked(df: DataFrame, keys: list[str], block: str | None) -> DataFrame:
    """Adds ``part``: rows that share a key of a block, directly or through others, have the same part.

    Parts are what has to be walked in order together; they are as large as the groups that keys join, however few
    blocks there are.
    """
    place = F.lit("") if block is None else F.coalesce(F.col(block).cast("string"), F.lit(""))
    marked = df.withColumn("_marks", F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), place, F.col(k).cast("string"))) for k in keys])))
    least = F.array_min("_marks")
    edges = marked.where(F.size("_marks") > 1).select(F.explode("_marks").alias("a"), least.alias("b")).where("a <> b").distinct()
    joined = components(edges).select(F.col("node").alias("_first"), F.col("component").alias("_part"))
    return marked.withColumn("_first", least).join(joined, "_first", "left").withColumn("part", F.coalesce("_part", "_first")).drop("_first", "_part", "_marks")


def ordered_groups(df: DataFrame, keys: list[str], order: str, block: str | None = None) -> DataFrame:
    """(block, order, group_id): strict multi-key record dedup within a block, as a stream would do it.

    A record joins the earliest group that one of its keys points to, and its keys then point to that group; bridged
    groups stay apart.  A group is named by the ``order`` of its first record.  Records that share no key, directly or
    through others, can't meet, so parts are dealt to tasks and streamed through in order; a task holds the keys of one
    part, which is the unit that is sequential by definition.  Records without any key are groups of their own.
    """
    name = block or "_block"
    rows = df.withColumn("_block", F.lit("")) if block is None else df
    rows = _blocked(rows.select(F.col(name).cast("string").alias(name), F.col(order).cast("long").alias(order), *keys), keys, name)
    alone = rows.where("part is null").select(name, order, F.col(order).alias("group_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, owner = object(), {}
        for batch in batches:
            groups = []
            for part, place, *values in batch[["part", order, *keys]].itertuples(index=False):
                if part != now:
                    now, owner = part, {}
                marks = [(k, v) for k, v in zip(keys, values) if v is not None and v == v]
                group = min((owner[m] for m in marks if m in owner), default=place)
                owner.update(dict.fromkeys(marks, group))
                groups.append(group)
            yield pd.DataFrame({name: batch[name], order: batch[order], "group_id": groups})

    dealt = rows.where("part is not null").repartition("part").sortWithinPartitions("part", order)
    return dealt.mapInPandas(run, f"{name} string, {order} long, group_id long").unionByName(alone)


def greedy_near(df: DataFrame, block: str, order: str, terms: str, threshold: float = 0.92) -> DataFrame:
    """(block, order, survivor): first-match merge of rows whose term sets overlap; a survivor absorbs the terms
    of what it takes in, which changes later matches, so each block is folded in order in one grouped task.

    A row is compared only with survivors that share a term with it, found by an index of the survivors' terms.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, set]] = []
        holders: dict[str, set[int]] = {}
        out = []
        for key, place, words in part.sort_values(order)[[block, order, terms]].itertuples(index=False):
            mine = set(words)
            for i in sorted(set().union(*(holders.get(w, ()) for w in mine))):
                survivor, held = kept[i]
                if len(mine & held) / min(len(mine), len(held)) >= threshold:
                    break
            else:
                i, (survivor, held) = len(kept), (place, set())
                kept.append((survivor, held))
            for w in mine - held:
                holders.setdefault(w, set()).add(i)
            held |= mine
            out.append((key, place, survivor))
        return pd.DataFrame(out, columns=[block, order, "survivor"])

    return df.select(block, order, terms).groupBy(block).applyInPandas(run, f"{block} string, {order} long, survivor long")
