import pytest

from assayer.llm.common import ready

LONG = "alpha beta gamma delta. " * 20000


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls in every column, empty, blank and very long texts, repeats and columns with clashing names."""
    rows = [
        (1, "one two three four", "en", "a", 18, 7, 1.0),
        (2, "", "en", "a", 0, 7, 1.0),
        (3, " \t\n\r ", None, "a", 5, 7, 1.0),
        (4, None, "en", None, None, None, None),
        (None, "a text without an id", None, None, None, None, None),
        (5, LONG, "de", "b", len(LONG), 7, 1.0),
        (6, LONG, "de", "b", len(LONG), 7, 1.0),
        (6, LONG, "de", "b", len(LONG), 7, 1.0),
        (7, "Ünï cödé　wörds \U0001f600 and\x0bmore\x0cwords here", "fr", "c", 40, 7, 1.0),
        (8, "one two three four", "en", "a", 18, 7, 1.0),
    ]
    clash = {
        "row": "string", "_source": "string", "_key": "long", "_block": "int", "_size": "long", "size": "long", "key": "string", "shard": "int", "shards": "string", "order": "long",
        "posterior": "double", "path_posterior": "double", "_host": "string", "_logit": "double", "host_n": "long", "gone": "long", "again": "long", "node": "string", "id": "string",
        "component_id": "long", "_findings_between": "string", "findings": "string", "between": "string", "path": "string", "score": "string", "_shard": "string",
    }
    values = {"string": "x", "long": 3, "int": 4, "double": 0.5}
    more = [values[k] for k in clash.values()]
    rows = [(*r, *(more if i % 3 else [None] * len(more))) for i, r in enumerate(rows)]
    names = ", ".join(f"{n} {k}" for n, k in clash.items())
    return llm.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, code long, kept double, {names}")
