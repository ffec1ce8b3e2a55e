"""SimHash near-duplicates with BK-trees.

A fingerprint bit is set if it is set in over half of the 64-bit hashes of a text's shingles.  Equal
fingerprints are one node.  Two fingerprints within two bits agree on at least two of their four 16-bit
blocks, so each fingerprint is put in six buckets, one for each pair of blocks; a bucket over
``bucket_rows`` is divided once more by three parts of its other 32 bits, of which one must agree.  Buckets
are dealt over shards; a shard's task builds one BK-tree per bucket (children keyed by their distance to
the parent) and searches it with the bucket's own members, following only edges within the radius.  Trees
are shipped to the tasks that need them by the shuffle on buckets, not to every executor: a broadcast of all
trees would grow with the corpus.  A bucket's links come back as a star to its smallest member; alternating
large-star and small-star steps join the stars to components.

That is the contract of the op8 query (``similarity=None``).  By default texts are linked whose sets of five-word
shingles have a Jaccard similarity of 0.8 at least.  Two fingerprints then differ in about a bit in seven, too many for
blocks of bits, so each text has ``CODES`` fingerprints of its set under different mixes.  Tables deal the nodes to
buckets by some of all bits (more bits and more tables the more nodes there are, so that buckets stay small and a pair at
the limit misses them all with ``MISSED``), and a BK-tree on a fingerprint of the table is searched in each bucket.
All fingerprints, then the whole sets decide.  A first pass proposes each node's ``FIRST`` nearest of all tables and needs
no sketches for it; a second one proposes all others that the trees find, but for pairs that the first has joined to one
component, and so loses no link whatever a group's size.  Texts equal but for blanks and the case of ASCII letters are one node.

Null or blank texts have fingerprint 0 and link like any other.  Rows with a null id take part and never name
a component unless all its ids are null.  Repeated rows keep one row each in ``near_duplicates``;
``keep_one`` keeps one row per component.  Only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import BLANK_RUN, BLANKS, BROADCAST_ROWS, rows_of, small
from assayer.sources.folders import Cuts

SEED, RADIUS = 42, 2
#: Rows of a shard of buckets, and of a bucket before it is divided once more.
SHARD_ROWS, BUCKET_ROWS = 100_000, 20_000
#: Copies of a component's smallest id where components are too many to be broadcast.
SALTS = 16
#: Nodes that may be joined by a broadcast because their rows are very many.
MOST_HOT = 1000
#: Jaccard similarity that links texts, words of its shingles, 64-bit fingerprints of a text.
SIMILAR, WORDS, CODES = 0.8, 5, 16
#: Nodes of a bucket, as its key's bits are chosen, and the chance that a pair at the limit meets in no bucket.
BUCKET, MISSED = 64, 0.005
#: Neighbours that a node proposes in a bucket and, of these, first of all tables; nodes of a part of a bucket.
NEAREST, FIRST, PART = 2, 16, 1000
#: Pairs that a tree's finds are expanded to at once.
EXPANDED = 1 << 18
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 63, (2, CODES)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def hashes_of(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of a text's shingles in order; a shorter text is one shingle, a blank one has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = zip(*(found[i:] for i in range(shingle))) if len(found) >= shingle else [found] if found else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(x), SEED) for x in parts], "<u8")


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one whole text."""
    hashes = hashes_of(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprints as signed 64-bit values."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint_of(x, shingle) for x in batch], np.uint64).view(np.int64))

    return run(text)


class Trees:
    """A BK-tree for each group of distinct fingerprints, built and searched level by level."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        order = np.lexsort((codes, groups))
        self.codes, self.groups = codes[order], groups[order]
        first = np.r_[True, self.groups[1:] != self.groups[:-1]]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        edges, item, at = [], np.flatnonzero(~first), self.root[~first]
        while len(item):
            key = at * 65 + np.bitwise_count(self.codes[item] ^ self.codes[at])
            _, new, back = np.unique(key, return_index=True, return_inverse=True)
            edges.append((key[new], item[new]))
            rest = np.ones(len(item), bool)
            rest[new] = False
            item, at = item[rest], item[new][back][rest]
        keys = np.concatenate([k for k, _ in edges]) if edges else np.zeros(0, np.int64)
        nodes = np.concatenate([n for _, n in edges]) if edges else np.zeros(0, np.int64)
        by = np.argsort(keys)
        self.keys, self.nodes = keys[by], nodes[by]

    def links(self, radius: int, block: int = 2048, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of one group within the radius, in blocks of queries (all nodes, if none are given)."""
        queries = np.arange(len(self.codes)) if queries is None else queries
        for start in range(0, len(queries), block):
            query = queries[start : start + block]
            at = self.root[query]
            while len(query):
                far = np.bitwise_count(self.codes[query] ^ self.codes[at]).astype(np.int64)
                hit = (far <= radius) & (query != at)
                yield query[hit], at[hit]
                low = np.searchsorted(self.keys, at * 65 + np.maximum(far - radius, 1))
                high = np.searchsorted(self.keys, at * 65 + np.minimum(far + radius, 64), side="right")
                many = np.maximum(high - low, 0)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query, at = np.repeat(query, many), self.nodes[np.repeat(low, many) + step]


def stars(codes: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(code, smallest code of its component within its group) where the two differ."""
    trees = Trees(codes, groups)
    label = np.arange(len(codes))
    for a, b in trees.links(radius):
        while len(a):
            a, b = label[a], label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, label[label]):
                label = label[label]
    own = label != np.arange(len(codes))
    return trees.codes[own], trees.codes[label[own]]


def bucketed(codes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, code) for buckets of two and more members."""
    blocks = [f"(shiftrightunsigned(code, {16 * i}) & 65535)" for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    rest = [[k for k in range(4) if k not in p] for p in pairs]
    entries = ", ".join(
        f"struct({n} as pair, {blocks[i]} * 65536 + {blocks[j]} as key, {blocks[k]} * 65536 + {blocks[m]} as other)"
        for n, ((i, j), (k, m)) in enumerate(zip(pairs, rest))
    )
    keyed = codes.select("code", F.explode(F.expr(f"array({entries})")).alias("x")).select("code", "x.*")
    counts = keyed.groupBy("pair", "key").agg(F.count("*").alias("members")).where("members > 1")
    found = keyed.join(counts, ["pair", "key"])
    parts = "array(struct(1 as part, other & 2047 as bits), struct(2 as part, shiftright(other, 11) & 2047 as bits), struct(3 as part, shiftright(other, 22) as bits))"
    found = found.select("code", "pair", "key", F.explode(F.expr(f"case when members <= {bucket_rows} then array(struct(0 as part, 0L as bits)) else {parts} end")).alias("x"))
    return found.select(F.xxhash64("pair", "key", "x.part", "x.bits").alias("bucket"), "code")


def links(codes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Stars (a, b) with a > b (as unsigned codes) that join what is linked within a bucket."""
    if radius > 2:
        raise ValueError("six pairs of four blocks cover two differing bits")
    shards = max(32, 1 + codes.count() * 6 // shard_rows)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = stars(rows["code"].to_numpy().view(np.uint64), rows["bucket"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    shard = F.pmod(F.xxhash64("bucket"), F.lit(shards)).alias("shard")
    return bucketed(codes, bucket_rows).select("bucket", "code", shard).groupBy("shard").applyInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest node.

    Large-star then small-star steps until nothing changes; every step is two grouped minima and joins, and
    each round is cut off by a written table.
    """
    cut = Cuts(edges.sparkSession, "stars")
    now, before = cut(edges.where("a <> b")), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        close = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = cut(close.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        cut.keep(1)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            return now
        before = sums
    raise RuntimeError("components did not settle")


def sketch_of(text: str | None) -> bytes:
    """``CODES`` fingerprints of a text's set of shingles, eight bytes each; empty for a blank text."""
    hashes = np.unique(hashes_of(text, WORDS))
    if not len(hashes):
        return b""
    counts = np.zeros(64 * CODES, np.int64)
    for at in range(0, len(hashes), 255):
        mixed = hashes[at : at + 255, None] * _ODD[0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[1]
        mixed = mixed ^ (mixed >> np.uint64(29))
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def jaccard_of(a: str | None, b: str | None) -> float:
    """Similarity of the whole sets of two texts."""
    return _overlap(np.unique(hashes_of(a, WORDS)), np.unique(hashes_of(b, WORDS)))


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def sketch(text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sketch_of(x) for x in batch], dtype=object)

    return run(text)


def content(text: Column) -> Column:
    """One key for texts equal but for blanks and the case of A-Z."""
    bare = F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), BLANK_RUN, " ")
    return F.xxhash64(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def differing(similarity: float, bits: int, deviations: float) -> int:
    """Bits of ``bits`` that texts of a similarity differ in at most, but for so many standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + deviations * np.sqrt(bits * share * (1 - share))))


def tables(nodes: int, similarity: float = SIMILAR) -> list[np.ndarray]:
    """The bits of the sketch that make each table's key."""
    bits = max(0, int(np.ceil(np.log2(max(nodes, 1) / BUCKET))))
    meet = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** bits
    many = max(8, int(np.ceil(np.log(MISSED) / np.log1p(-meet)))) if meet < 1 else 8
    rng = np.random.default_rng(SEED)
    return [rng.choice(64 * (CODES - 1), bits, replace=False) for _ in range(many)]


def placed(sketches: pd.Series, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the code of each sketch in each table; a key has no bit of its table's code."""
    codes = np.frombuffer(b"".join(sketches), "<i8").reshape(-1, CODES)
    bits, own = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little"), np.arange(len(keys)) % CODES
    buckets = [(n << 48) + bits[:, k + 64 * (k >= 64 * c)].astype(np.int64) @ (np.int64(1) << np.arange(len(k))) for n, (k, c) in enumerate(zip(keys, own))]
    return np.stack(buckets, axis=1), codes[:, own]


def dealt(nodes: DataFrame, keys: list[np.ndarray], names: list[str]) -> DataFrame:
    """``names`` of ``nodes`` with a sketch, a row for each table with its ``bucket`` and ``code``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buckets, codes = placed(batch["sketch"], keys)
            for n in range(len(keys)):
                yield batch[names].assign(bucket=buckets[:, n], code=codes[:, n])

    kinds = ", ".join(f"{n} {k}" for n, k in nodes.select(names).dtypes)
    return nodes.where("length(sketch) > 0").mapInPandas(run, f"{kinds}, bucket long, code long")


def nearest(rows: pd.DataFrame, radius: int, most: int = NEAREST, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, differing bits) of (node, bucket, code): each node's nearest within the radius, in parts of its
    bucket in order of codes.  Nodes of divided buckets stand beside themselves too, since they may have others elsewhere."""
    rows = rows.sort_values(["bucket", "code", "node"])
    _, start, group, size = np.unique(rows["bucket"], return_index=True, return_inverse=True, return_counts=True)
    node = rows["node"].to_numpy()[size[group] > part]
    group = group * (1 << 24) + (np.arange(len(rows)) - start[group]) // part
    a, b, far = _found(rows, group, radius, None, most)
    return np.r_[a, node], np.r_[b, node], np.r_[far, np.full(len(node), 64)]


def apart(rows: pd.DataFrame, radius: int, keys: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (node, label, sketch, bucket, code) within the radius whose labels differ and whose sketches differ in
    ``most`` bits at most, in the first table that they meet in."""
    rows = rows.sort_values(["bucket", "label"])
    bucket, label = rows["bucket"].to_numpy(), rows["label"].to_numpy()
    first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (label[1:] != label[:-1])])
    size = np.diff(np.r_[first, len(rows)])
    # Nodes of a bucket's most frequent label are found, but needn't search.
    order = np.lexsort((-size, bucket[first]))
    major = order[np.r_[True, bucket[first][order][1:] != bucket[first][order][:-1]]]
    asks = ~np.isin(np.repeat(np.arange(len(first)), size), major)
    alone = np.isin(bucket, np.unique(bucket[asks]))
    rows, bucket, asks = rows[alone], bucket[alone], asks[alone]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
    sketches, table = np.frombuffer(b"".join(rows["sketch"]), "<u8").reshape(-1, CODES), bucket >> 48
    buckets, codes = placed(rows["sketch"], keys)
    codes = codes.view(np.uint64)

    def fits(q: np.ndarray, n: np.ndarray) -> np.ndarray:
        # Of two that both search, the larger does.
        ok = np.flatnonzero(asks[q] & (label[q] != label[n]) & (~asks[n] | (node[q] > node[n])))
        ok = ok[np.bitwise_count(sketches[q[ok]] ^ sketches[n[ok]]).sum(axis=1, dtype=np.int32) <= most]
        for t in range(len(keys) - 1):
            x, y = q[ok], n[ok]
            ok = ok[(table[x] <= t) | (buckets[x, t] != buckets[y, t]) | (np.bitwise_count(codes[x, t] ^ codes[y, t]) > radius)]
        return ok

    a, b, _ = _found(rows, bucket, radius, asks, None, fits)
    return np.maximum(a, b), np.minimum(a, b)


def _found(rows: pd.DataFrame, group: np.ndarray, radius: int, asks: np.ndarray | None, most: int | None, fits=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, node found, differing bits) within the radius, of groups' trees of distinct codes: each node's ``most``
    nearest, or all that fit."""
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none
    order = np.lexsort((rows["code"].to_numpy().view(np.uint64), group))
    group, code, node = group[order], rows["code"].to_numpy().view(np.uint64)[order], rows["node"].to_numpy()[order]
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])])
    size = np.diff(np.r_[start, len(code)])
    trees = Trees(code[start], np.unique(group[start], return_inverse=True)[1])
    queries = np.arange(len(start)) if asks is None else np.flatnonzero(np.add.reduceat(asks[order], start))
    several = np.flatnonzero(size > 1)
    held, many = [], 0

    def least() -> list[tuple[np.ndarray, np.ndarray]]:
        q, n = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((node[n], np.bitwise_count(code[q] ^ code[n]), q))
        q, n = q[by], n[by]
        new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        near = np.arange(len(q)) - np.repeat(new, np.diff(np.r_[new, len(q)])) < most
        return [(q[near], n[near])]

    for x, y in itertools.chain([(several, several)], trees.links(radius, 256, queries)):
        ends = np.cumsum(size[x] * size[y])
        # Nodes of equal codes may be very many; their pairs are made in blocks.
        for low in range(0, int(ends[-1]) if len(ends) else 0, EXPANDED):
            at = np.arange(low, min(low + EXPANDED, ends[-1]))
            of = np.searchsorted(ends, at, side="right")
            at -= ends[of] - size[x[of]] * size[y[of]]
            wide = size[y[of]]
            q, n = start[x[of]] + at // wide, start[y[of]] + at % wide
            ok = np.flatnonzero(q != n) if fits is None else fits(order[q], order[n])
            if len(ok):
                held.append((q[ok], n[ok]))
                many += len(ok)
            if most and many > 1 << 19:
                held = least()
                many = len(held[0][0])
    if not held:
        return none, none, none
    q, n = (np.concatenate(x) for x in zip(*(least() if most else held)))
    return node[q], node[n], np.bitwise_count(code[q] ^ code[n]).astype(np.int64)


def _by_node(pairs: DataFrame, side: str, rows: DataFrame, column: str) -> DataFrame:
    """``pairs`` with a column of the nodes on one side; nodes of more than a thousandth of all pairs are joined by a broadcast."""
    rows = rows.select(F.col("node").alias(side), F.col(column).alias(f"{side}_{column}"))
    hot = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > max(100, pairs.count() / MOST_HOT)).select(side).checkpoint()
    if hot.isEmpty():
        return pairs.join(rows, side)
    there = pairs.join(F.broadcast(rows.join(F.broadcast(hot), side, "left_semi")), side)
    return there.unionByName(pairs.join(F.broadcast(hot), side, "left_anti").join(rows, side))


def similar_links(texts: DataFrame, nodes: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(a, b) of nodes whose texts are similar; ``texts`` has (node, text), ``nodes`` one (node, sketch) each.

    Similar pairs that other links join already may be left out.
    """
    radius, most = differing(similarity, 64, 2.2), differing(similarity, 64 * CODES, 2.6)
    cut = Cuts(nodes.sparkSession, "similar")
    keys = tables(nodes.count(), similarity)

    @F.pandas_udf("int")
    def far(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(i), "<u8").reshape(-1, CODES) for i in (x, y))
        return pd.Series(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32))

    @F.pandas_udf("binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(hashes_of(x, WORDS)).tobytes() for x in batch], dtype=object)

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_overlap(np.frombuffer(i, "<u8"), np.frombuffer(j, "<u8")) for i, j in zip(x, y)], dtype=float)

    def proposed(nodes: DataFrame, names: list[str], shard_rows: int, search, kinds: str) -> DataFrame:
        columns = [x.split()[0] for x in kinds.split(", ")]

        def run(x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(columns, search(x)))).drop_duplicates()

        shards = max(32, 1 + nodes.count() * len(keys) // shard_rows)
        shard = F.pmod(F.xxhash64("bucket"), F.lit(shards)).alias("shard")
        return dealt(nodes, keys, names).select("*", shard).groupBy("shard").applyInPandas(run, kinds)

    def decided(pairs: DataFrame) -> DataFrame:
        # Sets are made once for each text, not for each pair.
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().checkpoint()
        held = texts.join(small(needed), "node", "left_semi").dropDuplicates(["node"])
        held = cut(held.select("node", whole("text").alias("set")))
        pairs = _by_node(_by_node(pairs, "a", held, "set"), "b", held, "set")
        return cut(pairs.where(jaccard("a_set", "b_set") >= similarity).select("a", "b"))

    near = proposed(nodes.select("node", "sketch"), ["node"], SHARD_ROWS // 4, lambda x: nearest(x, radius), "node long, other long, far long")
    near = near.groupBy("node").agg(F.collect_set(F.struct("far", "other")).alias("found"))
    near = cut(near.select("node", F.expr(f"slice(array_except(transform(array_sort(found), x -> x.other), array(node)), 1, {FIRST})").alias("found")))
    close = near.select("node", F.explode("found").alias("other")).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    close = cut(close.distinct())
    first = _by_node(_by_node(close, "a", nodes, "sketch"), "b", nodes, "sketch")
    first = cut(first.where(far("a_sketch", "b_sketch") <= most).select("a", "b"))
    linked = decided(first)
    # Only nodes that have a neighbour within the radius can have others.
    labels = components(linked).select(F.col("a").alias("node"), F.col("b").alias("label"))
    some = near.select("node").join(labels, "node", "left")
    some = cut(some.select("node", F.coalesce("label", "node").alias("label")).join(nodes.select("node", "sketch"), "node"))
    rest = proposed(some, some.columns, SHARD_ROWS // 12, lambda x: apart(x, radius, keys, most), "a long, b long")
    rest = cut(rest.join(first, ["a", "b"], "left_anti"))
    return linked if rest.isEmpty() else linked.unionByName(decided(rest))


def _classes(docs: DataFrame, firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """``docs`` with the root and the component_id of each row's node.

    Only components of several nodes are joined by their root, with a broadcast where they are few enough and
    otherwise over ``SALTS`` copies of each, since one component may hold a third of all nodes.
    """
    joined = components(edges)
    named = firsts.join(joined.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    named = named.select("node", "first", F.coalesce("root", "node").alias("root")).checkpoint()
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least").checkpoint()
    if least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = named.join(F.broadcast(least), "root", "left")
    else:
        copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = named.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(copies, ["root", "salt"], "left")
    named = named.select("node", "root", F.coalesce("least", "first").alias("component_id")).checkpoint()
    # Nodes of more than a thousandth of all rows, a thousand at most, are joined by a broadcast, the others by a shuffle.
    counts = docs.groupBy("node").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > docs.count() / MOST_HOT).select("node").checkpoint()
    if hot.isEmpty():
        return docs.join(named, "node")
    there = docs.join(F.broadcast(named.join(F.broadcast(hot), "node", "left_semi")), "node")
    rest = docs.join(F.broadcast(hot), "node", "left_anti").join(named, "node")
    return there.unionByName(rest)


def _similar(df: DataFrame, id_column: str, text: str, similarity: float, *more: Column) -> DataFrame:
    node, t = content(F.col(text)).alias("node"), F.col(text)
    docs = df.select(F.col(id_column).alias("doc_id"), node, sketch(t).alias("sketch"), *more).checkpoint()
    firsts = docs.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch")).checkpoint()
    return _classes(docs.drop("sketch"), firsts.drop("sketch"), similar_links(df.select(node, t.alias("text")), firsts, similarity))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, similarity: float | None = SIMILAR) -> DataFrame:
    """(doc_id, code, component_id) of every row; ``code`` is the signed fingerprint of three-word shingles.

    Components join texts of the given similarity or, without one, fingerprints within the radius.
    """
    code = fingerprint(F.col(text))
    if similarity is not None:
        return _similar(df, id_column, text, similarity, code.alias("code")).select("doc_id", "code", "component_id")
    docs = df.select(F.col(id_column).alias("doc_id"), code.alias("node")).checkpoint()
    firsts = docs.groupBy("node").agg(F.min("doc_id").alias("first")).checkpoint()
    edges = links(firsts.select(F.col("node").alias("code")), radius)
    return _classes(docs, firsts, edges).select("doc_id", F.col("node").alias("code"), "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: the fingerprint as 16 lowercase hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILAR) -> DataFrame:
    """The rows of ``df`` that stand for their component: those with its smallest id, one for each of its texts' keys.

    Rows are told apart by id and text, so rows of one id with different texts are decided one by one; of several
    texts of a component under its smallest id, that with the smallest key stays.  Rows with a null id all stay.
    Repeats of a row (equal id and text) are kept once.  Only keys of rows that go are joined to the texts.
    """
    found = _similar(df, id_column, text, similarity).where("doc_id is not null")
    each = found.groupBy("doc_id", "node", "root", "component_id").agg(F.count("*").alias("n")).checkpoint()
    gone = each.where("doc_id <> component_id").select("doc_id", "node", F.lit(0).alias("kept"))
    first = each.where("doc_id = component_id")
    least = first.groupBy("root").agg(F.min("node").alias("stays"))
    first = first.join(least, "root").where("node <> stays or n > 1")
    each = gone.unionByName(first.select("doc_id", "node", F.expr("int(node = stays)").alias("kept")))
    each = each.select(F.col("doc_id").alias("id"), F.col("node").alias("key"), "kept").checkpoint()
    rows = rows_of(df)
    row = F.col("row")
    rows = rows.withColumn("node", content(row[text]))
    rows = rows.join(small(each), (row[id_column] == F.col("id")) & (F.col("node") == F.col("key")), "left")
    stay = rows.where("kept is null").select("row.*")
    if each.where("kept = 1").isEmpty():
        return stay
    repeated = rows.where("kept = 1").dropDuplicates(["id", "key"]).select("row.*")
    return stay.unionByName(repeated)
