"""Corpus building: parsing with degradation, manifests and feature flags."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrade(structured: DataFrame, dump: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings): structured blocks, page-dump blocks of documents without any, and what was degraded.

    Documents with neither are warned about as empty.
    """
    lacking = wanted.select(key).distinct().join(structured.select(key).distinct(), key, "left_anti")
    spare = dump.join(lacking, key, "left_semi")
    blocks = structured.withColumn("degraded", F.lit(False)).unionByName(spare.withColumn("degraded", F.lit(True)), allowMissingColumns=True)
    have = dump.select(key).distinct().withColumn("_have", F.lit(True))
    warning = F.when(F.col("_have"), "page dump used").otherwise("no text")
    return blocks, lacking.join(have, key, "left").select(key, warning.alias("warning"))


def fetch_ledger(pages: DataFrame, group: Sequence[str], page: str, digest: str, recorded: str, expected: str) -> DataFrame:
    """(group, pages, bad, complete): a group is complete if all its pages are there and match their recorded digests."""
    found = pages.groupBy(*group).agg(
        F.count_distinct(page).alias("pages"), F.count_if(~F.col(digest).eqNullSafe(F.col(recorded))).alias("bad"), F.max(expected).alias("_expected")
    )
    return found.withColumn("complete", (F.col("bad") == 0) & (F.col("pages") == F.col("_expected"))).drop("_expected")


def manifest_problems(manifest: Mapping, required: Sequence[str]) -> list[str]:
    """What is wrong with a query manifest: key sets, empty queries, page sizes that aren't positive."""
    problems = [f"missing {k}" for k in required if k not in manifest] + [f"unknown {k}" for k in manifest if k not in required]
    for name, text in dict(manifest.get("queries") or {}).items():
        if not str(text or "").strip():
            problems.append(f"empty query {name}")
    size = manifest.get("page_size")
    if "page_size" in manifest and not (isinstance(size, int) and not isinstance(size, bool) and size > 0):
        problems.append("page_size is not positive")
    return problems


#: What counts as on and off, in any case.
SWITCH = dict.fromkeys(("1", "true", "yes", "on"), True) | dict.fromkeys(("0", "false", "no", "off"), False)


def switch(value: object) -> bool | None:
    """On, off, or None for a blank; anything else is an error."""
    word = str(value).strip().lower() if value is not None else ""
    if word and word not in SWITCH:
        raise ValueError(f"neither on nor off: {value!r}")
    return SWITCH.get(word)


class Flags:
    """Feature flags as layers of settings, of which the first that says anything about a flag decides.

    Layers, in order: the environment (a flag's variable, then its aliases' variables), a settings file, and the
    defaults.  A layer is a mapping from names to values; blank values say nothing.  ``registry`` maps a flag's name to
    its default; ``variables`` maps variables to flags, in the order in which they count.
    """

    def __init__(self, registry: Mapping[str, bool], variables: Sequence[tuple[str, str]] = (), file: Mapping[str, object] | None = None):
        self.registry, self.variables, self.file = dict(registry), tuple(variables), dict(file or {})
        unknown = ({flag for _, flag in self.variables} | set(self.file)) - set(self.registry)
        if unknown:
            raise KeyError(f"unknown flags {sorted(unknown)}")

    def resolve(self, name: str, env: Mapping[str, str] | None = None) -> tuple[bool, str]:
        """(value, layer that decided)."""
        if name not in self.registry:
            raise KeyError(name)
        env = os.environ if env is None else env
        said = [("environment", env.get(variable)) for variable, flag in self.variables if flag == name]
        said += [("file", self.file.get(name)), ("default", self.registry[name])]
        return next((value, layer) for layer, raw in said if (value := switch(raw)) is not None)

    def contract(self, choices: Sequence[tuple[str, str]], otherwise: str, env: Mapping[str, str] | None = None) -> str:
        """The contract of the first (flag, contract) whose flag is on."""
        return next((contract for flag, contract in choices if self.resolve(flag, env)[0]), otherwise)


def settings(text: str) -> dict[str, str]:
    """Name and value of each ``name: value`` line of a settings file; comments and blank lines are skipped."""
    found = {}
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if colon and name.strip():
            found[name.strip()] = value.strip().strip("\"'")
    return found


def workloads(states: DataFrame, asked: DataFrame) -> DataFrame:
    """(workload, action, archived): what becomes of a request to submit a workload again.

    states: workload, seq, status, completed.  Its last state decides: without one it is submitted; a failed one, or one
    that completed nothing, is archived first; any other is active, and the request is refused.
    """
    last = states.groupBy("workload").agg(F.max_by(F.struct("seq", "status", "completed"), "seq").alias("s"))
    rows = asked.select("workload").distinct().join(last, "workload", "left")
    spent = (F.col("s.status") == "failed") | ((F.col("s.status") == "completed") & (F.coalesce("s.completed", F.lit(0)) == 0))
    action = F.when(F.col("s").isNull(), "submit").when(F.coalesce(spent, F.lit(False)), "archive_and_submit").otherwise("refuse")
    return rows.select("workload", action.alias("action"), F.when(action == "archive_and_submit", F.col("s.seq")).alias("archived"))
