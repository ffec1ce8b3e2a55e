"""Secret scans in DataFrame functions alone.

A pattern finds candidates: runs of twelve key characters with a digit, keys with a known prefix, and whatever
stands, up to a blank or a quote, after a naming word and ``=``, ``:`` or ``is``.  A random forest drops false
positives.  It sees a candidate's length, its character transitions (how much likelier its pairs of neighbouring
character classes are among secrets than among other findings), its dictionary coverage, the path of its file if
there is one, and the words before and after it.  The forest and the table of transitions are trained on labelled
findings and then written as one SQL expression, so a scan is a map over the texts: no join, no shuffle and no Python.

Positions count code points from 0.  Null and empty texts have no candidates, a null path is an empty one.  Repeated
rows are scanned each by itself, an empty table gives an empty result, and columns of the input keep their values
whatever their names (``redact`` replaces the text column alone).
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import rows_of, settled

#: Words before a value, by number of characters; ``key`` stands alone or in a longer name of these.
NAMES = {
    3: "pwd|(?<![a-z])key", 5: "token", 6: "passwd|secret|apikey|bearer", 7: "api[_ -]key", 8: "password", 9: "accesskey|secretkey",
    10: "access[_ -]key|secret[_ -]key|passphrase|credential|privatekey", 11: "private[_ -]key",
}
#: Keys that their beginning gives away.
KNOWN = "AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[bp]-[A-Za-z0-9-]{10,}"
_B, _Q = r"[\x20\x09-\x0D]", "[\"']"


def _named() -> str:
    """A place right after a naming word and a separator; lookbehinds of one width each, as Python wants them too."""
    by: dict[int, list[str]] = {}
    signs = [(n + len(pre) + len(post) + len(end), "".join([*pre, sign, *post, *end])) for n, sign in ((1, "[:=]"), (2, "(?:[:=]=|=>)"))
             for pre in ([], [_Q], [_B], [_Q, _B]) for post in ([], [_B], [_B, _B]) for end in ([], [_Q])]
    signs += [(4, f"{_B}is{_B}"), (5, f"{_B}is{_B}{_Q}")]
    for n, name in NAMES.items():
        for m, sign in signs:
            by.setdefault(n + m, []).append(f"(?:{name}){sign}")
    by.setdefault(7, []).append(f"bearer{_B}")
    soon = f"(?<=[:=>])|(?<=[:=>]{_B})|(?<=[:=>]{_Q})|(?<=[:=>]{_B}{_B})|(?<=[:=>]{_B}{_Q})|(?<=[:=>]{_B}{_B}{_Q})|(?<=(?i:is){_B})|(?<=(?i:is){_B}{_Q})|(?<=(?i:bearer){_B})"
    return f"(?:{soon})(?i:" + "|".join(f"(?<={'|'.join(x)})" for _, x in sorted(by.items())) + ")"


#: Values after a naming word without the punctuation that closes a phrase, runs of key characters that hold a digit, known keys.
CANDIDATE = (
    _named() + "[^\\x20\\x09-\\x0D\"'`=:>][^\\x20\\x09-\\x0D\"'`]*?(?=[.,;:)\\]}>]{0,8}(?:[\\x20\\x09-\\x0D\"'`]|(?![\\s\\S])))"
    r"|(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}" + f"|(?:{KNOWN})(?![A-Za-z0-9_+/-]))"
)
#: Texts without any of these have no candidate.
GATE = "[0-9]|AKIA|gh[pousr]_|sk-|xox|(?i:pwd|key|token|passwd|secret|bearer|password|passphrase|credential)"
#: Words that call what follows a secret, and words that call it something else.
KEYS = "password|passphrase|passwd|pwd|secret|token|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|\\bkey|credential|bearer|authorization|auth"
OTHERS = "commit|checksum|sha1|sha256|md5|digest|uuid|version|build|isbn|phone|tel|order|invoice|card|account|article|page|id"
#: Common parts of names and placeholders; their share of a candidate is its dictionary coverage.
DICTIONARY = (
    "example", "sample", "placeholder", "password", "secret", "token", "test", "dummy", "change", "your", "here", "insert",
    "user", "name", "admin", "key", "value", "default", "null", "none", "true", "false", "data", "file", "image", "index",
    "page", "article", "section", "chapter", "version", "release", "build", "python", "java", "linux", "windows", "node",
    "http", "https", "www", "html", "json", "xml", "photo", "report", "draft", "final", "copy", "paragraph", "figure", "table",
    "xxxx", "1234", "0000", "abcd", "abc123",
)
#: What prose says of a secret.
PROSE = (
    "required", "optional", "string", "integer", "field", "reset", "expired", "invalid", "missing", "needed", "hidden", "unknown", "empty", "protected",
    "encrypted", "changed", "stored", "the", "that", "this", "not", "very", "out", "under", "to", "a", "an", "in", "of", "for", "why", "how", "what",
    "important", "simple", "safe", "used", "set", "given", "known", "always", "never", "good", "patience",
)
#: Words of made-up pass phrases.
NOUNS = (
    "correct", "horse", "battery", "staple", "river", "copper", "violet", "hunter", "dragon", "monkey", "summer", "winter", "orange", "silver",
    "falcon", "garden", "planet", "rocket", "thunder", "wizard", "marble", "canyon", "hammer", "lantern", "pepper", "tiger", "velvet", "window",
)
TEST_PATH = r"(?i)(?:^|[/._-])(?:tests?|spec|examples?|samples?|fixtures?|mocks?|docs?|readme)(?:[/._-]|$)"
CONFIG_PATH = r"(?i)(?:\.env|config|settings|credentials|secrets)|\.(?:ya?ml|pem|ini|properties|tfvars|conf)$"
FEATURES = (
    "length", "digits", "upper", "lower", "transitions", "runs", "distinct", "coverage", "hex", "keyed", "key_near", "other_near", "path", "test_path", "config_path",
    "separators", "known", "assigned", "quoted", "symbols", "prose", "filled", "after_word", "after_end",
)
#: Classes of characters between which transitions are counted: vowel, consonant, capital, digit, joint, other.
CLASSES = "vcUdjo"
_MEMBERS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "_-./+=")


def classes(value: Column) -> Column:
    """The class of each character, as an array of numbers from 0."""
    named = F.translate(value, "".join(_MEMBERS), "".join(c * len(m) for c, m in zip(CLASSES, _MEMBERS)))
    return F.transform(F.split(F.regexp_replace(named, f"[^{CLASSES}]", "o"), ""), lambda c: F.instr(F.lit(CLASSES), c) - 1)


def pairs(value: Column) -> Column:
    """Numbers of the transitions between neighbouring characters; empty for a single character."""
    kinds = classes(value)
    return F.zip_with(F.slice(kinds, F.lit(1), F.size(kinds) - 1), F.slice(kinds, F.lit(2), F.size(kinds)), lambda a, b: a * len(CLASSES) + b)


@dataclass(frozen=True)
class Forest:
    """The trees as SQL over a struct ``f`` of features, and the log odds of each transition."""

    trees: str
    transitions: tuple[float, ...]


def features(x: Column, transitions: Sequence[float], dictionary: Sequence[str] = DICTIONARY) -> Column:
    """Struct of the features of a candidate struct (value, before, after, path)."""
    v, before, after, path = x["value"], x["before"], x["after"], F.coalesce(x["path"], F.lit(""))
    n = F.length(v).cast("double")
    without = lambda pattern: 1 - F.length(F.regexp_replace(v, pattern, "")) / n
    runs = v
    for kind, letter in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A")):
        runs = F.regexp_replace(runs, kind, letter)
    yes = lambda c: c.cast("double")
    table = F.array(*[F.lit(float(t)) for t in transitions])
    found = {
        "length": F.least(n, F.lit(200.0)),
        "digits": without("[0-9]"),
        "upper": without("[A-Z]"),
        "lower": without("[a-z]"),
        "transitions": F.aggregate(pairs(v), F.lit(0.0), lambda a, i: a + F.get(table, i)) / F.greatest(n - 1, F.lit(1.0)),
        "runs": F.length(runs) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(36.0)),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(dictionary), "")) / n,
        "hex": yes(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "keyed": yes(before.rlike(f"(?i)(?:{KEYS})[\"']?\\s*(?:[:=]+>?|\\bis)\\s*[\"']?$")),
        "key_near": yes(before.rlike(f"(?i)(?:{KEYS})")),
        "other_near": yes(before.rlike(f"(?i)\\b(?:{OTHERS})\\b[^A-Za-z]*$")),
        "path": yes(v.contains("/") | before.rlike(r"(?:://\S*|[/.\\@])$")),
        "test_path": yes(path.rlike(TEST_PATH)),
        "config_path": yes(path.rlike(CONFIG_PATH)),
        "separators": without("[_/-]"),
        "known": yes(v.rlike(f"^(?:{KNOWN})$")),
        "assigned": yes(before.rlike("[:=]>?\\s*[\"']?$")),
        "quoted": yes(before.rlike("[\"']$")),
        "symbols": without("[^A-Za-z0-9]"),
        "prose": yes(v.rlike(f"(?i)^(?:{'|'.join(PROSE)})$")),
        "filled": yes(v.rlike(r"^(?:[<$%{\[(].*|[*xX.]+|-+)$")),
        "after_word": yes(after.rlike("^ +[a-z]+")),
        "after_end": yes(after.rlike("^[\"'.,;)]*(?:\\s*$|\\s*\\n|[\"'])")),
    }
    return F.struct(*[c.cast("double").alias(k) for k, c in found.items()])


class _Draw:
    """Choices that the digest of a name and a running number decides."""

    def __init__(self, name: str):
        self.name, self.n = name, 0

    def bits(self) -> int:
        self.n += 1
        return int.from_bytes(hashlib.sha256(f"{self.name}:{self.n}".encode()).digest(), "big")

    def pick(self, choices: Sequence[str]) -> str:
        return choices[self.bits() % len(choices)]

    def run(self, letters: str, least: int, most: int | None = None) -> str:
        bits, n = self.bits(), least + self.bits() % ((most or least) - least + 1)
        out = []
        for _ in range(n):
            bits, i = divmod(bits, len(letters)) if bits > 1 << 16 else divmod(self.bits(), len(letters))
            out.append(letters[i])
        return "".join(out)


def _shapes(x: _Draw) -> list[tuple[str, str, int]]:
    """(what stands before, value, whether it is a secret) of one finding of every shape."""
    named, said, bare, others, counted, places = "named", "said", "bare", "others", "counted", "places"
    hex_, low, digits, up32 = "0123456789abcdef", string.ascii_lowercase, string.digits, string.ascii_uppercase + "234567"
    mixed = string.ascii_letters + digits
    run, noun, word, prose = x.run, lambda: x.pick(NOUNS), lambda: x.pick(DICTIONARY), lambda: x.pick(PROSE)
    uuid = lambda: "-".join(run(hex_, n) for n in (8, 4, 4, 4, 12))
    return [
        # Keys and pass words after a naming word.
        (named, run(hex_, 16, 20), 1), (named, run(hex_, 32), 1), (named, run(hex_, 40), 1), (named, run(hex_, 64), 1), (named, uuid(), 1),
        (named, run(mixed, 20, 28), 1), (named, run(mixed, 30, 44), 1), (named, run(mixed, 40, 42) + "==", 1), (named, run(mixed, 8, 12), 1), (named, run(up32, 16, 32), 1),
        (named, run(low, 4, 10) + run(digits, 2), 1), (named, run(low, 8, 14), 1), (named, run(low, 16, 32), 1), (named, run(low, 7, 12).capitalize(), 1), (named, run(low, 4, 7) + "_" + run(low, 4, 7), 1),
        (named, "".join(noun().capitalize() for _ in range(4)), 1), (named, noun() + noun() + noun(), 1), (named, "-".join([noun(), noun(), noun(), run(digits, 2)]), 1),
        (named, "_".join([noun(), noun(), run(digits, 2)]), 1), (named, ".".join([noun(), noun(), run(digits, 2)]), 1), (named, noun() + run(digits, 1, 3), 1), (named, noun().capitalize() + run(digits, 2) + "!", 1),
        (named, "P@" + run(low, 4, 9) + "!" + run(digits, 2), 1), (named, run(mixed, 4, 8) + "#$" + run(low, 3, 8), 1), (named, "Tr0ub" + run(low, 2, 5) + "&" + run(digits, 1), 1),
        (named, "eyJ" + ".".join(run(mixed, 8, 30) for _ in range(3)), 1), (named, ".".join(run(mixed, 3, 6) for _ in range(3)), 1), (named, "-".join(run(up32, 4) for _ in range(3)), 1), (named, "sk_live_" + run(mixed, 20, 24), 1),
        (said, run(low, 4, 9) + run(digits, 2), 1), (said, noun() + run(digits, 2), 1),
        # Known keys, wherever they stand.
        (x.pick((bare, named)), "AKIA" + run(up32, 16), 1), (x.pick((bare, others)), "AKIA" + run(string.ascii_uppercase, 16), 1), (x.pick((bare, said)), "ghp_" + run(mixed, 36), 1),
        (x.pick((bare, named)), "sk-" + run(mixed, 32), 1), (bare, "xoxb-" + run(digits, 11) + "-" + run(mixed, 20, 24), 1),
        # Numbers, checksums, identifiers, pages and files.
        (counted, run(digits, 16), 0), (counted, "+1-555-" + run(digits, 8), 0), (x.pick((bare, counted)), run(digits, 13), 0), (counted, "978-" + run(digits, 9) + "-" + run(digits, 1), 0),
        (others, run(hex_, 40), 0), (others, run(hex_, 32), 0), (others, run(hex_, 64), 0), (others, uuid(), 0), (x.pick((bare, others)), "2024-" + run(digits, 2) + "-" + run(hex_, 6, 8), 0),
        (places, "-".join([word(), run(digits, 1, 5), "section"]), 0), (places, "image_" + run(digits, 8), 0), (places, word() + "/page" + run(digits, 1, 5) + "/" + word(), 0),
        (places, "release-version-" + run(digits, 1, 5), 0), (places, "-".join([noun(), noun(), noun(), run(digits, 1, 5)]), 0), (places, "_".join([noun(), word(), run(digits, 2), "final"]), 0),
        # Placeholders, prose, references and masks after a naming word.
        (named, "example_token_" + run(digits, 1, 5), 0), (named, "your_password_" + run(digits, 1, 5), 0), (named, "changeme" + run(digits, 1, 3), 0), (named, word() + "_" + word(), 0), (named, word(), 0),
        (said, prose(), 0), (named, prose(), 0), (said, noun(), 0), (said, "".join(run("bcdfglmnprst", 1) + run("aeiou", 1) for _ in range(2 + x.bits() % 3)), 0), ("called", noun(), 0),
        (named, "$(" + noun().upper() + ")", 0), (named, "[" + run(low, 4, 10).upper() + "]", 0), (named, "${" + run(low, 4, 10).upper() + "}", 0), (named, "<" + word() + "_" + run(low, 3, 8) + ">", 0),
        (named, "%(" + noun() + ")s", 0), (named, "*" * (4 + x.bits() % 9), 0), (named, "x" * (4 + x.bits() % 9), 0), (named, "{{" + noun() + "}}", 0),
    ]


#: What stands before a finding, by kind.
_BEFORE = {
    "named": ("with password=", 'see token = "', "api_key: ", "the secret = '", "auth_token=", "pwd=", "passwd: ", "DB_PASSWORD=", 'set "secret_key": "', "access_key = ", "password: ", "secret: ",
              "export API_TOKEN=", "credential: ", "the passphrase: "),
    "said": ("my password is ", "the secret is ", "the key is ", "his token is "),
    "called": ("the key: ", "The secret: ", "a token: "),
    "bare": ("and some other words ", "the key was ", "we saw ", "", "then came\n"),
    "others": ("in commit ", "md5: ", "sha256 ", "checksum: ", "build ", "version: ", "uuid ", "order id: ", "invoice ", "page "),
    "counted": ("and paid by card ", "some other words ", "call phone ", "order ", "isbn ", "account ", "tel: ", "id "),
    "places": ("https://www.site.org/", "read /", "the file ", "and then ", "see http://host/a/", "import ", "in "),
}
_ENDS, _MORE = ("\n", "", '"', " and", ".", "'", ", then"), (" and", " of the", "", ".", " to all", "\n")
_SECRET_PATHS, _OTHER_PATHS = ("", "", "src/app.py", "config/settings.yml", ".env"), ("", "", "src/app.py", "docs/readme.md", "tests/test_login.py")


def example_findings(spark: SparkSession, each: int = 100) -> DataFrame:
    """Labelled findings (shape, value, before, after, path, y): ``each`` of every shape, drawn by digests.

    A shape fixes how a value is built; what stands around it, and its path, are drawn from lists.  Keys come after
    naming words, known keys anywhere; what scanners mistake for keys comes after other words (numbers, checksums,
    identifiers, page and file names) and after naming words too (prose, placeholders, references, masks).
    """
    rows = []
    for i in range(each):
        x = _Draw(f"finding {i}")
        for shape, (kind, value, y) in enumerate(_shapes(x)):
            ends = _ENDS if y or kind == "named" else _MORE
            rows.append((shape, value, x.pick(_BEFORE[kind]), x.pick(ends), x.pick(_SECRET_PATHS if y else _OTHER_PATHS), y))
    return spark.createDataFrame(rows, "shape int, value string, before string, after string, path string, y int")


def train(findings: DataFrame, trees: int = 16, depth: int = 7, seed: int = 7) -> Forest:
    """Transitions' log odds and the forest, whose value is the mean of its trees' shares of true secrets."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    pair_rows = findings.select("y", F.explode(pairs(F.col("value"))).alias("pair")).groupBy("y", "pair").agg(F.count("*").alias("n")).collect()
    counts = [[1.0] * len(CLASSES) ** 2 for _ in range(2)]
    for r in pair_rows:
        counts[int(r["y"])][r["pair"]] += r["n"]
    odds = tuple(round(math.log(a / sum(counts[1])) - math.log(b / sum(counts[0])), 4) for b, a in zip(*counts))
    rows = findings.select(F.struct("value", "before", "after", "path").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.select(features(F.col("x"), odds).alias("f"), "y").select("f.*", "y")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(rows).select("v", "y")
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)

    def sql(node) -> str:
        if node.numDescendants() == 0:
            stats = node.impurityStats()
            share = stats.stats()[1] / max(sum(stats.stats()), 1e-9)
            return f"{share:.6f}D"
        split = node.split()
        return f"if(f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    parts = [sql(tree._java_obj.rootNode()) for tree in forest.trees]
    return Forest(f"({' + '.join(parts)}) / {len(parts)}D", odds)


def scan(df: DataFrame, forest: Forest, text: str = "text", path: str | None = None) -> DataFrame:
    """(row, findings, between): ``findings`` is an array of (start, length, value, probability), in order.

    ``between`` holds the text around the candidates, from which ``redact`` builds texts anew; ``path`` names the
    column of the file's path.  Work is linear in the text: a candidate's start is its block's start and what stands
    before it in a block of 64 candidates.
    """
    row = F.col("row")
    t = F.coalesce(row[text], F.lit(""))
    none = F.array().cast("array<string>")
    rows = rows_of(df).withColumn("hits", F.when(t.rlike(GATE), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    rows = rows.withColumn("between", F.when(F.size("hits") > 0, F.split(t, CANDIDATE, -1)).otherwise(none))
    rows = rows.withColumn("path", F.coalesce(row[path].cast("string"), F.lit("")) if path else F.lit(""))
    rows = settled(rows, ["hits", "between", "path"])
    cands = F.expr("transform(hits, (h, k) -> struct(h as value, right(between[k], 60) as before, left(between[k + 1], 30) as after, path as path, length(between[k]) as gap))")
    rows = rows.withColumn("found", F.transform(cands, lambda x: F.struct(x["value"].alias("value"), x["gap"].alias("gap"), features(x, forest.transitions).alias("f"))))
    rows = settled(rows.drop("hits", "path"), ["found", "between"])
    scored = f"transform(found, x -> named_struct('value', x.value, 'gap', x.gap, 'p', {forest.trees.replace('f.', 'x.f.')}))"
    rows = settled(rows.withColumn("found", F.expr(scored)).withColumn("sizes", F.expr("transform(found, x -> x.gap + length(x.value))")), ["found", "sizes", "between"])
    blocks = "transform(sequence(0, (size(sizes) - 1) div 64), b -> aggregate(slice(sizes, cast(b * 64 + 1 as int), 64), 0, (a, x) -> a + x))"
    starts = f"aggregate({blocks}, array(0), (a, x) -> array_append(a, element_at(a, -1) + x))"
    rows = settled(rows.withColumn("starts", F.expr(f"case when size(sizes) > 0 then {starts} end")), ["found", "sizes", "between", "starts"])
    done = (
        "transform(found, (x, k) -> named_struct('start', starts[k div 64] + aggregate(slice(sizes, cast(k - k % 64 + 1 as int), k % 64), 0, (a, y) -> a + y) + x.gap,"
        " 'length', length(x.value), 'value', x.value, 'probability', x.p))"
    )
    return settled(rows.withColumn("findings", F.expr(done)).drop("found", "sizes", "starts"), ["findings", "between"])


def findings(df: DataFrame, forest: Forest, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5, path: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, length, value_sha256, probability and is_secret."""
    rows = scan(df, forest, text, path)
    rows = rows.select(F.col("row")[id_column].alias("doc_id"), F.explode("findings").alias("x")).select("doc_id", "x.*")
    return rows.select(
        "doc_id", F.col("start").cast("long"), F.col("length").cast("long"), F.sha2("value", 256).alias("value_sha256"),
        "probability", (F.col("probability") >= threshold).alias("is_secret"),
    )


def redact(df: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.5, mark: str = "<secret>", path: str | None = None) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mark``; texts without one keep their value, null included."""
    joined = F.expr(
        f"concat(array_join(transform(findings, (x, k) -> concat(between[k], if(x.probability >= {threshold}, '{mark}', x.value))), ''),"
        " between[size(findings)])"
    )
    safe = F.when(F.size("findings") > 0, joined).otherwise(F.col("row")[text])
    return scan(df, forest, text, path).select(*[safe.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
