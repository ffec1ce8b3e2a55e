"""License scans in DataFrame functions alone: phrase places and an exact set-similarity join with templates.

Blocks are sentences, ended by . ! ? before a blank or by an empty line; single line breaks don't end them, so wrapped
notices stay whole.  Sentences of over ``BLOCK`` words are covered by overlapping blocks of ``BLOCK`` words, one every
``STEP``.  Blocks' sets of words are joined with
the templates' sets under a containment threshold: at least ``threshold`` of a template's words.  Words of all
templates are ordered by the number of documents that hold them, rarest first.  For a template of n words of
which c must be shared, a qualifying block shares one of the first n - c + 1 (prefix filter), has c template
words (length filter) and, from the first shared word on, leaves room for c on both sides (positional filter).
The filters only spare work: every pair that meets the threshold is found.  Templates are a table of
``MOST_TEMPLATES`` rows at most; with its index from prefix words to templates it rides along as one constant, so
plans don't grow with it and texts are never shuffled.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased.  Null and empty texts have
none: counts are 0, first and last words null, labels empty, score 0.  Repeated rows get equal results, an empty
table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import settled

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and their labels (fixed values).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
#: Words of a block at most, and words from one block of a longer sentence to the next.
BLOCK, STEP = 64, 32
MOST_TEMPLATES = 10_000
SENTENCE_END = r"[.!?]+[\x20\x09-\x0D]|\n[\x20\x09\x0B-\x0D]*\n"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Words of a text; pieces between gaps that are empty don't count."""
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def frequencies(df: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Number of documents that hold each template word, over all documents; one row per template word."""
    held = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _GAP), F.lit(vocabulary))
    rows = df.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in rows}


def _constant(templates: list[tuple[str, list[str]]], order: list[str], threshold: float) -> Column:
    """Templates, and the index from prefix words to their numbers, as one constant."""
    rank = {w: i for i, w in enumerate(order)}
    rows, index = [], {}
    for i, (label, t) in enumerate(templates):
        held, least = sorted(t, key=rank.__getitem__), math.ceil(threshold * len(t) - 1e-9)
        prefix = held[: len(held) - least + 1]
        rows.append({"label": label, "words": held, "prefix": prefix, "n": len(held), "least": least})
        for w in prefix:
            index.setdefault(w, []).append(i)
    first = sorted(index)
    value = json.dumps({"words": order, "first": first, "at": [index[w] for w in first], "rows": rows})
    kind = "words array<string>, first array<string>, at array<array<int>>, rows array<struct<label: string, words: array<string>, prefix: array<string>, n: int, least: int>>"
    return F.from_json(F.lit(value), kind)


def scan(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Iterable[tuple[str, str]] | DataFrame = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, n_words, places (array of (word, label)) and matches (array of (block, label, score)) of every row.

    ``templates``: (label, notice) in lower case; templates without words are left out.
    """
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.limit(MOST_TEMPLATES + 1).collect()]
    sets = [(label, sorted(set(t.split()))) for label, t in templates if t.split()]
    if len(sets) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    vocabulary = sorted({w for _, t in sets for w in t})
    seen = frequencies(df, vocabulary, text)
    order = sorted(vocabulary, key=lambda w: (seen[w], w))
    made = _constant(sets, order, threshold)
    rank = {w: i for i, w in enumerate(order)}
    first = {w for _, t in sets for w in sorted(t, key=rank.__getitem__)[: len(t) - math.ceil(threshold * len(t) - 1e-9) + 1]}

    t = F.coalesce(F.col(text), F.lit(""))
    gate = "|".join(re.escape(w) for w in sorted({*first, *(p.split()[-1] for p in PHRASES)}))
    rows = df.select(F.col(id_column).alias("doc_id"), t.alias("_t"), F.size(_split(t)).cast("long").alias("n_words"))
    edge = r"(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    rows = rows.withColumn("_low", F.when(F.col("_t").rlike(f"(?i){edge}(?:{gate})(?:$|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])"), F.translate("_t", _UPPER, _LOWER)))
    rows = rows.withColumn("_w", F.when(F.col("_low").isNotNull(), _split(F.col("_low"))))
    rows = rows.withColumn("_sentences", F.when(F.arrays_overlap("_w", made["first"]), F.transform(F.split("_low", SENTENCE_END), _split)))
    rows = settled(rows.drop("_t", "_low"), ["n_words", "_w", "_sentences"])
    windows = f"transform(sequence(0, greatest(0, cast(ceil((size(s) - {BLOCK}) / {STEP}) as int))), i -> slice(s, i * {STEP} + 1, {BLOCK}))"
    blocks = F.transform(F.expr(f"flatten(transform(_sentences, s -> if(size(s) <= {BLOCK}, array(s), {windows})))"), lambda b: F.array_intersect(made["words"], b))
    rows = settled(rows.withColumn("_blocks", blocks).drop("_sentences"), ["n_words", "_w", "_blocks"])

    case = " ".join(
        "when " + " and ".join(f"get(_w, i + {k}) = '{w}'" if k else f"x = '{w}'" for k, w in enumerate(p.split())) + f" then '{label}'" for p, label in PHRASES.items()
    )
    places = F.expr(f"filter(transform(_w, (x, i) -> struct(i as word, case {case} end as label)), p -> p.label is not null)")

    def matched(b: Column, k: Column) -> Column:
        """Matches of a block: templates that one of its words is a prefix word of, then the filters, then the count."""
        near = F.array_distinct(F.flatten(F.transform(F.array_intersect(made["first"], b), lambda w: F.get(made["at"], F.array_position(made["first"], w).cast("int") - 1))))

        def verified(i: Column) -> Column:
            t = F.get(made["rows"], i)
            inner = F.slice(b, F.lit(1), F.greatest(F.lit(0), F.size(b) - t["least"] + 1))
            room = lambda y: F.least(t["n"] - F.array_position(t["words"], y), F.size(b) - F.array_position(b, y)) + 1 >= t["least"]
            hopeful = (F.size(b) >= t["least"]) & F.exists(F.slice(F.array_intersect(t["prefix"], inner), 1, 1), room)
            return F.struct(k.alias("block"), t["label"].alias("label"), F.when(hopeful, F.size(F.array_intersect(t["words"], b)) / t["n"]).alias("score"))

        return F.filter(F.transform(near, verified), lambda m: m["score"] >= threshold)

    matches = F.flatten(F.transform("_blocks", matched))
    none = "cast(array() as array<struct<{}>>)"
    rows = rows.withColumns(
        {
            "places": F.coalesce(places, F.expr(none.format("word: int, label: string"))),
            "matches": F.coalesce(matches, F.expr(none.format("block: int, label: string, score: double"))),
        }
    )
    return settled(rows.drop("_w", "_blocks"), ["places", "matches"])


def digest(rows: DataFrame) -> DataFrame:
    """The query's columns."""
    spots = F.transform("places", lambda p: p["word"].cast("long"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"]))))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(spots).alias("first_word"), F.array_max(spots).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
