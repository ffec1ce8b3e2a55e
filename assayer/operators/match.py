"""One-to-one matching and support checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.dedup import _cut, components
from assayer.operators.pack import walked
from assayer.operators.relate import checked
from assayer.sources.folders import Cuts


#: Pairs of a group that one task walks; larger groups are matched by rounds or in components.
SMALL = 20_000


def _sized(pairs: DataFrame, group: str) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of groups of up to ``SMALL`` pairs, and those of larger groups, if there are any."""
    large = pairs.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select(F.col(group).alias("_large"))
    large = _cut(large)
    if large.isEmpty():
        return pairs, None
    here = F.col(group).eqNullSafe(F.col("_large"))
    return pairs.join(checked(large), here, "left_anti"), pairs.join(checked(large), here, "left_semi")


def greedy(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """(group, left, right, score): pairs by descending score, then left and right, whose sides are both free.

    Groups of up to ``SMALL`` pairs are streamed through in that order; a task holds the sides that one group has used.
    In larger ones, rounds take every pair that comes first among the pairs of its left side and among those of its
    right side, which the walk would take as well, and drop what touches them, until no pair is left.
    """
    kinds = dict(pairs.dtypes)
    schema = f"{group} {kinds[group]}, {left} {kinds[left]}, {right} {kinds[right]}, {score} double"
    rows = pairs.where(F.col(score) >= least).select(group, left, right, F.col(score).cast("double").alias(score))

    def step() -> Callable:
        lefts: set = set()
        rights: set = set()

        def take(a: object, b: object, _score: float) -> bool:
            if a in lefts or b in rights:
                return False
            lefts.add(a)
            rights.add(b)
            return True

        return take

    small, large = _sized(rows, group)
    found = walked(small, group, [F.desc(score), left, right], [left, right, score], schema, step)
    return found if large is None else found.unionByName(_rounds(large, group, left, right, score))


def _rounds(pairs: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    place = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    cut, done = Cuts(pairs.sparkSession, "matching"), []
    rest = cut(pairs.withColumn("_place", place))
    taken = Cuts(pairs.sparkSession, "matched")
    while not rest.isEmpty():
        first = lambda side: rest.groupBy(group, side).agg(F.min("_place").alias("_place"))  # noqa: E731, B023
        both = taken(rest.join(first(left), [group, left, "_place"], "left_semi").join(first(right), [group, right, "_place"], "left_semi").select(*pairs.columns))
        done.append(both)
        rest = cut(rest.join(both.select(group, left), [group, left], "left_anti").join(both.select(group, right), [group, right], "left_anti"))
        cut.keep(1)
    return reduce(DataFrame.unionByName, done, pairs.where("false")).select(group, left, right, score)


def assign(weight: np.ndarray) -> list[int]:
    """For each row the column of a matching of greatest total weight, or -1; weights are above 0 where allowed.

    Shortest augmenting paths with potentials; each row also has a private column of weight 0.
    """
    n, m = weight.shape
    cost = np.full((n, m + n), 1e9)
    cost[:, :m] = np.where(weight > 0, -weight, 1e9)
    cost[np.arange(n), m + np.arange(n)] = 0.0
    u, v, owner = np.zeros(n + 1), np.zeros(m + n + 1), np.full(m + n + 1, -1)
    for row in range(n):
        owner[-1], at = row, m + n
        best, back, seen = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n + 1, bool)
        while owner[at] != -1:
            seen[at] = True
            i = owner[at]
            free = ~seen[:-1]
            reach = cost[i] - u[i] - v[:-1]
            better = free & (reach < best)
            best[better], back[better] = reach[better], at
            step = np.where(free, best, np.inf).argmin()
            delta = best[step]
            u[owner[seen]] += delta
            v[seen] -= delta
            best[free] -= delta
            at = step
        while at != m + n:
            owner[at] = owner[back[at]]
            at = back[at]
        owner[-1] = -1
    found = [-1] * n
    for j in range(m):
        if owner[j] >= 0:
            found[owner[j]] = j
    return found


def parts_of(edges: list[tuple[int, int]], rows: int) -> list[list[int]]:
    """Numbers of edges by connected part; rows and columns have numbers of their own."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in edges:
        a, b = find(i), find(rows + j)
        root[max(a, b)] = min(a, b)
    found: dict[int, list[int]] = {}
    for n, (i, _) in enumerate(edges):
        found.setdefault(find(i), []).append(n)
    return list(found.values())


#: Parts with so many cells at most are solved with the tie rule.
TIED_CELLS = 400


def assign_first(weight: np.ndarray) -> list[int]:
    """As ``assign``; of several matchings of greatest weight the one that leaves the first row unmatched if it can, else
    gives it the lowest column, then so for the next rows.  Parts over ``TIED_CELLS`` cells take any of them."""
    best = assign(weight)
    if weight.size > TIED_CELLS:
        return best
    value = lambda w, got: sum(w[i, j] for i, j in enumerate(got) if j >= 0)
    total, w = value(weight, best), weight.copy()
    for i in range(len(w)):
        for j in [-1, *np.flatnonzero(w[i] > 0)]:
            kept = w.copy()
            kept[i] = 0
            if j >= 0:
                kept[:, j] = 0
                kept[i, j] = w[i, j]
            if abs(value(kept, assign(kept)) - total) < 1e-9:
                w = kept
                break
    return assign(w)


def optimal(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """(group, left, right, score) of a matching of greatest total score among pairs of at least ``least``.

    A group falls into connected parts, which are solved one by one; groups of over ``SMALL`` pairs are cut into their
    parts before they are dealt to tasks.
    """
    kinds = dict(pairs.dtypes)
    schema = f"{group} {kinds[group]}, {left} {kinds[left]}, {right} {kinds[right]}, {score} double"
    rows = pairs.where(F.col(score) >= least).select(group, left, right, F.col(score).cast("double").alias(score))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        lefts, rights = sorted(part[left].unique()), sorted(part[right].unique())
        row, column = {x: i for i, x in enumerate(lefts)}, {x: i for i, x in enumerate(rights)}
        edges = [(row[a], column[b]) for a, b in zip(part[left], part[right])]
        scores, got = part[score].to_numpy(), []
        for numbers in parts_of(edges, len(lefts)):
            i, j = sorted({edges[n][0] for n in numbers}), sorted({edges[n][1] for n in numbers})
            weight = np.zeros((len(i), len(j)))
            for n in numbers:
                weight[i.index(edges[n][0]), j.index(edges[n][1])] = scores[n]
            got += [(part[group].iloc[0], lefts[i[a]], rights[j[b]], weight[a, b]) for a, b in enumerate(assign_first(weight)) if b >= 0]
        return pd.DataFrame(got, columns=[group, left, right, score])

    small, large = _sized(rows, group)
    found = small.groupBy(group).applyInPandas(run, schema)
    if large is None:
        return found
    node = lambda side, c: F.xxhash64(F.lit(side), group, c)
    parts = components(large.select(node(0, left).alias("a"), node(1, right).alias("b")))
    large = large.withColumn("node", node(0, left)).join(parts, "node")
    return found.unionByName(large.groupBy("component").applyInPandas(run, schema))
