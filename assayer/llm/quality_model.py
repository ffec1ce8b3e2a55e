"""Quality classifier: a document model whose evidence is combined with host and path posteriors.

A logistic model over cheap text measures is fitted on a bounded sample of labelled rows.  Its probabilities,
summed by host and by (host, path) over all documents, update beta priors: the global share of good
documents is the prior of a host, and what a host's other paths say is the prior of a path, so that no evidence
counts twice.  Prior strengths come from the spread between hosts and between paths (method of moments), so that
sparse sites shrink to what stands above them.  A document's posterior odds are its own likelihood ratio times the
odds of its path, from which its own probability is left out.

Null or empty texts have measures of 0 words and are judged by the same model.  Null hosts and paths are
sites of their own.  Repeated rows count each; an empty table, or one without labels of both kinds, gives a
model that keeps everything.  Other columns pass through ``keep_good`` unchanged, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import by_hash, rows_of, small, words

#: Labelled rows of each label on which the document model is fitted, at most.
FIT_ROWS = 5000
MEASURES = ("log_words", "symbols", "upper", "bangs", "digits", "variety", "dup_lines", "word_length", "bars")


def measures(df: DataFrame, text: Column, prefix: str = "_m_") -> DataFrame:
    """Adds the measures of ``text`` as doubles, named by ``prefix``; ``df`` must not have such columns."""
    t = F.coalesce(text, F.lit(""))
    df = df.withColumn(f"{prefix}w", words(t))
    n = F.greatest(F.size(f"{prefix}w"), F.lit(1))
    chars = F.greatest(F.length(F.array_join(f"{prefix}w", "")), F.lit(1))
    lines = F.split(t, "\n")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    found = {
        "log_words": F.log1p(F.size(f"{prefix}w")) / 10,
        "symbols": count("[#*$%&|<>]") / n,
        "upper": count("[A-Z]") / chars,
        "bangs": count("!") / n,
        "digits": count("[0-9]") / chars,
        "variety": F.size(F.array_distinct(f"{prefix}w")) / n * F.log1p(n) / 10,
        "dup_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "word_length": chars / n / 10,
        "bars": count("[|]") / n,
    }
    caps = {"symbols": 3.0, "bangs": 3.0, "bars": 3.0, "word_length": 5.0}
    df = df.withColumns({f"{prefix}{k}": F.least(v.cast("double"), F.lit(caps.get(k, 1e9))) for k, v in found.items()})
    return df.drop(f"{prefix}w")


@dataclass(frozen=True)
class Model:
    """Weights of the measures, intercept and the fitted share of good documents."""

    weights: tuple[float, ...]
    intercept: float
    prior: float

    def logit(self, prefix: str = "_m_") -> Column:
        total = F.lit(self.intercept)
        for name, w in zip(MEASURES, self.weights):
            total = total + F.col(f"{prefix}{name}") * w
        return F.greatest(F.least(total, F.lit(12.0)), F.lit(-12.0))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last entry is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    penalty = np.diag(np.r_[np.full(x.shape[1] - 1, ridge), 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * w[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, id_column: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most ``most`` rows of each label (y of 1 is good), taken by a hash of the id.

    The sample is weighted back to the shares of all labels.  Only its numeric measures reach the driver.
    """
    shares = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Model((0.0,) * len(MEASURES), 12.0, 0.999)
    chosen = F.broadcast(by_hash(labels.select("doc_id", "y"), most))
    key, y = "_label_id", "_label_y"
    rows = docs.select(F.col(id_column).alias(key), F.col(text).alias("text"))
    rows = measures(rows.join(chosen.select(F.col("doc_id").alias(key), F.col("y").alias(y)), key), F.col("text"))
    rows = rows.select(y, *[f"_m_{m}" for m in MEASURES]).toPandas().to_numpy(float)
    if len(rows) == 0 or len(set(rows[:, 0])) < 2:
        return Model((0.0,) * len(MEASURES), 12.0, 0.999)
    rows = rows[np.lexsort(rows.T)]
    target, x = rows[:, 0], rows[:, 1:]
    prior = shares[1] / (shares[0] + shares[1])
    weight = np.where(target == 1, prior / (target == 1).mean(), (1 - prior) / (target == 0).mean())
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    beta = logistic((x - mean) / spread, target, weight)
    scaled = beta[:-1] / spread
    return Model(tuple(map(float, scaled)), float(beta[-1] - scaled @ mean), float(prior))


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, host_n, host_s, path_n, path_s) from rows (host, path, p), by partial sums."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_s")).checkpoint()
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    return paths.join(hosts, "host")


def host_prior(mean: float, strength: float) -> Column:
    """What the host's other paths say of a path: its prior."""
    others, n = F.col("host_s") - F.col("path_s"), F.col("host_n") - F.col("path_n")
    return (strength * F.lit(mean) + others) / (strength + n)


def strengths(found: DataFrame) -> tuple[float, float, float]:
    """Global mean and the prior strengths of hosts and of paths; one row a step reaches the driver.

    Hosts spread around the global mean, paths around the prior that their host gives them.
    """
    total = found.agg(F.sum("path_s").alias("s"), F.sum("path_n").alias("n")).first()
    if not total["n"]:
        return 0.5, 10.0, 10.0
    mean = min(max(total["s"] / total["n"], 1e-4), 1 - 1e-4)
    strength = lambda v: min(max(mean * (1 - mean) / max(v, 1e-9) - 1, 2.0), 1000.0)
    spread = lambda rate, around: found.agg(F.sum(F.pow(rate - around, 2) * F.col("path_n")) / F.sum("path_n")).first()[0]
    host = strength(spread(F.col("host_s") / F.col("host_n"), F.lit(mean)))
    return mean, host, strength(spread(F.col("path_s") / F.col("path_n"), host_prior(mean, host)))


def _key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def score(df: DataFrame, model: Model, host: str, path: str, text: str = "text") -> DataFrame:
    """(row, _logit, _host, _path): the rows of ``df`` as structs, and beside them what the posterior needs."""
    row = F.col("row")
    rows = measures(rows_of(df), row[text]).withColumns({"_logit": model.logit(), "_host": _key(row[host]), "_path": _key(row[path])})
    return rows.drop(*[f"_m_{m}" for m in MEASURES])


def posterior(scored: DataFrame, found: DataFrame, model: Model) -> DataFrame:
    """Adds host_posterior, path_posterior and posterior to rows with _logit, _host and _path.

    The host's posterior is that without the row's own path, whose prior it is; the path's is that without the row.
    """
    mean, k_host, k_path = strengths(found)
    p = F.lit(1.0) / (1 + F.exp(-F.col("_logit")))
    rows = scored.join(small(found.withColumnsRenamed({"host": "_host", "path": "_path"})), ["_host", "_path"])
    rows = rows.withColumn("host_posterior", host_prior(mean, k_host))
    rows = rows.withColumn("path_posterior", (k_path * F.col("host_posterior") + F.col("path_s") - p) / (k_path + F.col("path_n") - 1))
    clipped = F.greatest(F.least(F.col("path_posterior"), F.lit(1 - 1e-4)), F.lit(1e-4))
    odds = F.col("_logit") - math.log(model.prior / (1 - model.prior)) + F.log(clipped / (1 - clipped))
    return rows.withColumn("posterior", 1 / (1 + F.exp(-odds))).drop("host_n", "host_s", "path_n", "path_s")


def quality(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, most: int = FIT_ROWS,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, document_score, host_posterior, path_posterior, posterior, kept) of every document."""
    model = fit(docs, labels, most, id_column, text)
    row = F.col("row")
    narrow = score(docs, model, host, path, text).select(row[id_column].alias("doc_id"), "_logit", "_host", "_path").checkpoint()
    p = 1 / (1 + F.exp(-F.col("_logit")))
    found = sites(narrow.select(F.col("_host").alias("host"), F.col("_path").alias("path"), p.alias("p"))).checkpoint()
    rows = posterior(narrow, found, model)
    return rows.select("doc_id", p.alias("document_score"), "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep_good(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, most: int = FIT_ROWS,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches the threshold, with the columns of ``docs``.

    Texts are measured twice, once for the sites' sums and once beside the rows, and never shuffled.
    """
    model = fit(docs, labels, most, id_column, text)
    p = 1 / (1 + F.exp(-F.col("_logit")))
    scored = score(docs, model, host, path, text)
    found = sites(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), p.alias("p"))).checkpoint()
    return posterior(scored, found, model).where(F.col("posterior") >= threshold).select("row.*")
