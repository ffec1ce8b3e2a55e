"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A sample tells what each rule costs and which share of texts it rejects.  Rules then run in the order of
rejections per cost, and a rule's measures are only computed for texts that all earlier rules let pass.
The order changes the work, never the verdict: a text is kept if no rule rejects it.

Null and empty texts have no words; all their counts are 0.  Repeated rows get equal verdicts, an empty
table gives an empty result, and columns of the input that share a name with a result column are replaced.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import BLANKS, settled, words


@dataclass(frozen=True)
class Rule:
    """``measures``: (name, SQL over ``text`` and earlier measures); ``fails``: SQL over the measures."""

    name: str
    fails: str
    measures: tuple[tuple[str, str], ...] = ()


#: Documented thresholds of the production cascade, beyond the base counts of ``base_counts``.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words * 3"),
    Rule("duplicate_lines", "n_dup_lines * 10 > n_lines * 5", (("n_lines", "size(split(text, '\\n'))"),)),
    Rule("word_length", "word_chars > 24 * n_words or word_chars < 2 * n_words"),
    Rule("exclamations", "n_bangs * 10 > n_words * 5", (("n_bangs", "regexp_count(text, '!')"),)),
    Rule("digits", "n_digits * 2 > word_chars", (("n_digits", "regexp_count(text, '[0-9]')"),)),
    Rule("capitals", "n_upper * 2 > word_chars", (("n_upper", "regexp_count(text, '[A-Z]')"),)),
    Rule("variety", "n_words > 200 and n_distinct * 20 < n_words", (("n_distinct", "size(array_distinct(_words))"),)),
)


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_words`` and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Three-word windows are compared by a 64-bit hash.  Positions of windows whose hash occurs again are
    found by sorting; each covers up to three words not covered by the one before it.  What is sorted are plain
    numbers, the position in the lowest bits and the hash, as far as it fits, above them; neighbours that agree there
    are compared by their whole hashes.  All steps are linear or n log n in the words of one text.
    """
    df = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", words(F.col(text)))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(F.col(text), F.lit("[#*$%&|<>]")).cast("long"),
            "_lines": lines,
            "_windows": F.expr(
                "case when size(_words) < 3 then cast(array() as array<bigint>)"
                " else transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) end"
            ),
        }
    )
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_bits": F.expr("length(bin(size(_windows)))"),
        }
    )
    df = df.withColumn(
        "_sorted",
        F.expr("case when size(array_distinct(_windows)) < size(_windows) then sort_array(transform(_windows, (h, i) -> shiftleft(h, _bits) | cast(i as bigint))) end"),
    )
    place = "cast({} & (shiftleft(1L, _bits) - 1) as int)"
    same = "(k {0} and shiftrightunsigned(_sorted[k {1} 1], _bits) = shiftrightunsigned(s, _bits) and _windows[" + place.format("_sorted[k {1} 1]") + "] = _windows[" + place.format("s") + "])"
    df = df.withColumn(
        "_again",
        F.expr(
            f"case when _sorted is not null then sort_array(filter(transform(_sorted, (s, k) -> if({same.format('> 0', '-')} or {same.format('< size(_sorted) - 1', '+')},"
            f" {place.format('s')}, -1)), p -> p >= 0)) end"
        ),
    )
    covered = "aggregate(transform(_again, (p, k) -> if(k = 0, 3, least(3, p - _again[k - 1]))), 0L, (a, x) -> a + x)"
    df = df.withColumn("n_repeat_words", F.expr(f"case when _again is null then 0L else {covered} end"))
    df = df.drop("_lines", "_windows", "_bits", "_sorted", "_again")
    return settled(df, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def bounded_sample(df: DataFrame, rows: int, id_column: str = "doc_id") -> DataFrame:
    """About ``rows`` rows of ``df``, or all if it has fewer: those whose id has one remainder of a hash.

    They come from all partitions, whatever order the table has, and stay on the executors, in one partition.
    Repeats of an id share their fate; a null id counts as one id.
    """
    parts = max(1, df.count() // max(rows, 1))
    return df.where(F.pmod(F.xxhash64(F.lit(5), id_column), F.lit(parts)) == 0).limit(4 * rows).checkpoint()


def seconds(sample: DataFrame, value: str, repeats: int, runs: int = 2) -> float:
    """Seconds in which one task evaluates ``value`` ``repeats`` times for every row of ``sample``."""
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).select(F.max(F.hash(F.expr(value))))
    taken = []
    for _ in range(runs):
        began = time.perf_counter()
        many.collect()
        taken.append(time.perf_counter() - began)
    return min(taken)


def plan(sample: DataFrame, rules: tuple[Rule, ...] = RULES, repeats: int = 16) -> list[tuple[Rule, float, float]]:
    """(rule, cost, share rejected) of each rule on a sample, most rejections per cost first.

    ``sample`` has the measures that every text needs anyway; it should be bounded and checkpointed.  A rule's cost is
    the time that its measures and test take over the repeated sample, less that of a run which computes nothing.
    Shares are smoothed by half a rejection, so that rules which reject none of the sample stand by their cost.
    """
    tests = []
    for rule in rules:
        test = rule.fails
        for name, sql in reversed(rule.measures):
            test = re.sub(rf"\b{name}\b", f"({sql})", test)
        tests.append(test)
    counts = sample.agg(F.count("*").alias("n"), *[F.count_if(F.expr(test)).alias(f"r{i}") for i, test in enumerate(tests)]).first()
    n, idle = counts["n"], seconds(sample, "1", repeats)
    rows = [
        (rule, max(seconds(sample, test, repeats) - idle, 1e-4), counts[f"r{i}"] / n if n else 0.0) for i, (rule, test) in enumerate(zip(rules, tests))
    ]
    return sorted(rows, key=lambda x: (-(x[2] * n + 0.5) / (n + 1) / x[1], x[0].name))


def cascade(df: DataFrame, rules: list[Rule], alive: Column, kept: str = "kept") -> DataFrame:
    """Adds ``kept``: ``alive`` and no rule rejects.  Later measures are null once a rule has rejected."""
    df = df.withColumn(kept, F.coalesce(alive, F.lit(False)))
    for rule in rules:
        for name, sql in rule.measures:
            df = df.withColumn(name, F.expr(f"case when {kept} then {sql} end"))
        df = df.withColumn(kept, F.expr(f"{kept} and not coalesce({rule.fails}, false)"))
    return settled(df, [kept])


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 300, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    ``sample_rows``: texts, about, on which costs and selectivities are estimated.  They only order the rules.
    """
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    sample = base_counts(bounded_sample(docs, sample_rows)).where(~failed).checkpoint()
    order = [rule for rule, _, _ in plan(sample, rules)]
    done = cascade(base_counts(docs).withColumn("base_failed", failed), order, ~F.col("base_failed"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
