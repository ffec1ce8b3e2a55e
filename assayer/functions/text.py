"""Column to Column text functions.  Classes are explicit, so results don't depend on a regex dialect."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = "[ \\t\\n\\r]+"
MARK = "\x1f"


def normalise(text: Column) -> Column:
    """Blank runs to one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


@F.pandas_udf(StringType())
def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, blanks collapsed, case-folded: the exact rule, which no built-in function covers."""
    import unicodedata

    for batch in texts:
        yield batch.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


@F.pandas_udf(StringType())
def title_fold(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The exact title key: NFKD, lower case, what is neither word character nor blank to a space, blanks collapsed."""
    import re
    import unicodedata

    def key(x: str | None) -> str | None:
        return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", x or "").lower()).split()) or None

    for batch in titles:
        yield batch.map(key)


def alphanumeric(text: Column) -> Column:
    """Lower case with everything but a-z and 0-9 taken out."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def doi(value: Column) -> Column:
    """Lower-cased DOI without resolver or scheme; stacked prefixes peel in a fixed order; empty gives null."""
    value = F.lower(F.trim(value))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        value = F.regexp_replace(value, "^" + prefix.replace(".", "[.]"), "")
    return F.nullif(F.trim(value), F.lit(""))


def pmcid(value: Column) -> Column:
    """Upper-cased id; bare digits get the prefix; empty gives null."""
    value = F.nullif(F.upper(F.trim(value)), F.lit(""))
    return F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), value)).otherwise(value)


def title_key(value: Column) -> Column:
    """Lower case, punctuation to spaces, blanks collapsed; empty gives null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " ")), F.lit(""))


def sentences(text: Column) -> Column:
    """array<string>: split after . ! ? before blanks; blanks collapsed; empty ones dropped."""
    one_line = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.filter(F.split(F.regexp_replace(one_line, "([.!?]) ", "$1" + MARK), MARK), lambda s: F.trim(s) != "")


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct [a-z0-9]+ runs of the lower-cased text, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def numbers(text: Column) -> Column:
    """array<double> of all decimal numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit("-?[0-9]+(?:[.][0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct entries over the smaller list's size; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def short_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """Prefix and the first hex digits of the parts' SHA-256, joined by a zero-width-free separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length))


def numbered(prefix: str, n: Column, width: int = 3) -> Column:
    """Prefix and number with leading zeros up to ``width`` digits; longer numbers keep all their digits."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def canonical_json(*columns: str) -> Column:
    """JSON text of the columns in the order of their names, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis if cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def section_head(path: Column) -> Column:
    return F.trim(F.element_at(F.split(path, ">"), 1))


def section_rest(path: Column) -> Column:
    """What follows the first ``>``, parts trimmed and joined anew; null without any."""
    parts = F.split(path, ">")
    rest = F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: F.trim(x)), " > ")
    return F.when(F.size(parts) > 1, rest)


def joined_set(values: Column) -> Column:
    """Sorted distinct values in one string."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")
