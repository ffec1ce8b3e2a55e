"""URL filters: a blocked Bloom filter in front of an exact hash join.

Two lists are looked up the same way: rules (host, path, verdict), which fit a host with all its subdomains
where the path starts with the rule's, and listed canonical URLs.  Every url gives its possible keys; the
filter, a relation of 512-bit blocks of fixed number, drops nearly all that aren't listed; what passes goes to an
exact join on the key's text, which removes false positives.  The longest fitting rule wins (of equal length
block before allow); without one, a listed canonical URL has ``listed``'s verdict and others
are allowed.

The filter has one block of 64 bytes for ``KEYS_PER_BLOCK`` keys.  Up to ``MOST_BLOCKS`` blocks it is broadcast; larger
ones are joined by a shuffle on the block, so the share of false positives stays the same at any length of the lists.

A canonical URL is the host without a leading ``www.`` or ``m.``, then the path without a final slash.  Null
urls, and urls without ``://``, have an empty host and path, no rule and no listed URL.  Repeated rows get equal
verdicts, empty tables and empty lists work, and no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BLOCKS, KEYS_PER_BLOCK, PROBES = 1 << 16, 40, 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, with A-Z lower-cased; empty if there is none."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Key of a canonical URL; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, "/$", "")))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and its bits: (word of 8, mask) for each probe."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), [F.pmod(F.xxhash64(F.lit(i), key), F.lit(64)).cast("int") for i in range(PROBES)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7): one 64-bit word per probe."""
    block, bits = _place(F.col("key"), blocks)
    rows = keys.select(block, *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(PROBES)])


def passing(probes: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``probes`` whose ``key`` the filter may hold; filters of up to ``MOST_BLOCKS`` blocks are broadcast."""
    block, bits = _place(F.col("key"), blocks)
    rows = probes.select("*", block, *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    test = F.expr(" and ".join(f"(shiftright(w{i}, b{i}) & 1L) = 1L" for i in range(PROBES)))
    return rows.join(F.broadcast(filter_) if blocks <= MOST_BLOCKS else filter_, "block").where(test).select(*probes.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, is_listed) of every row of ``pages``.

    ``rules``: (host, path, verdict); ``listed``: (key, verdict) of canonical URLs.  Distinct (host, path) are
    looked up once; their results are checkpointed, so that a (host, path) of very many rows is split in the last
    join.  Rules' distinct path lengths decide which beginnings of a path are keys.
    """
    # One column per part, taken once; a null url has empty parts.
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    rule = F.concat(F.col("host"), F.col("path"))
    ruled = rules.select(F.concat(F.lit("r:"), "host", F.lit("|"), "path").alias("key"), rule.alias("rule"), "verdict")
    exact = listed.select(F.concat(F.lit("u:"), "key").alias("key"), F.lit(None).cast("string").alias("rule"), "verdict")
    entries = ruled.unionByName(exact).where("key is not null").groupBy("key", "rule").agg(F.max("verdict").alias("verdict")).checkpoint()
    blocks = entries.count() // KEYS_PER_BLOCK + 1
    lengths = rules.select(F.length("path").alias("n")).distinct().agg(F.array_sort(F.collect_set("n")).alias("n")).first()["n"] or []

    urls = rows.where("host <> ''").select("host", "path").distinct()
    hosts = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    beginnings = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    rule_keys = F.flatten(F.transform(hosts, lambda h: F.transform(F.col("_n"), lambda n: F.concat(F.lit("r:"), h, F.lit("|"), F.left("path", n)))))
    probes = urls.withColumn("_n", beginnings).withColumn("key", F.explode(F.concat(rule_keys, F.array(F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path"))))))).drop("_n")
    hits = passing(probes, bloom(entries.select("key"), blocks), blocks).join(entries.hint("shuffle_hash"), "key")
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("verdict"), "rule"))).alias("r"),
        F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("listed"),
    ).checkpoint()
    found = rows.join(best, ["host", "path"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.col("listed"), F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.col("listed").isNotNull().alias("is_listed"))
