"""Named query plans over the tables, one module per family of operators."""

from importlib import import_module

FAMILIES = ("text", "relational", "matching", "evidence", "review", "records", "scans")


def load() -> None:
    for name in FAMILIES:
        import_module(f"assayer.plans.{name}")
