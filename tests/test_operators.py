"""Operators on small inline rows, against brute force where there is one."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import text
from assayer.operators import dedup, match, pack, relate, retrieve, validate
from assayer.sources import corpus, parse, schemas, sinks, tables
from assayer.streaming import windows


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "column, value, want",
    [
        (text.doi, " HTTPS://doi.org/10.1/A ", "10.1/a"),
        (text.doi, "https://doi.org/doi:10.2", "10.2"),
        (text.doi, "doi:https://doi.org/10.2", "https://doi.org/10.2"),
        (text.doi, "  ", None),
        (text.doi, None, None),
        (text.pmcid, " 123 ", "PMC123"),
        (text.pmcid, "pmc9", "PMC9"),
        (text.pmcid, "", None),
        (text.title_key, "A  Study: of X!", "a study of x"),
        (text.sentences, "One.  Two? Three 3.5 end", ["One.", "Two?", "Three 3.5 end"]),
        (text.sentences, "", []),
        (text.numbers, "a -1.5 and 20", [-1.5, 20.0]),
        (text.section_head, "Results > Table 1 > Row", "Results"),
        (text.section_rest, "Results > Table 1>Row", "Table 1 > Row"),
        (text.section_rest, "Results", None),
        (text.token_estimate, "äöü", 2),
        (lambda c: text.clip(c, 4), "abcdef", "abc…"),
        (text.fold, "Straße  ﬁx", "strasse fix"),
    ],
)
def test_text_functions(spark, column, value, want):
    assert one(spark, column, value) == want


def test_strict_dedup_does_not_merge_bridged_groups(spark):
    rows = spark.createDataFrame([(0, "a", None), (1, None, "t"), (2, "a", "t"), (3, None, "t")], "n long, k1 string, k2 string")
    got = {r["n"]: r["group_id"] for r in dedup.ordered_groups(rows, ["k1", "k2"], "n").collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, dedup.components(edges).collect()))
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_greedy_near_survivor_absorbs(spark):
    rows = spark.createDataFrame([("p", 0, ["a", "b"]), ("p", 1, ["b", "a", "c"]), ("p", 2, ["c", "d"]), ("q", 0, ["a", "b"])], "block string, n long, terms array<string>")
    got = {(r["block"], r["n"]): r["survivor"] for r in dedup.greedy_near(rows, "block", "n", "terms", 0.9).collect()}
    assert got == {("p", 0): 0, ("p", 1): 0, ("p", 2): 2, ("q", 0): 0}


def best_total(w):
    n, m = w.shape
    best = 0.0
    for columns in itertools.permutations([*range(m), *[-1] * n], n):
        best = max(best, sum(w[i, j] for i, j in enumerate(columns) if j >= 0))
    return best


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        w = np.round(rng.random((rng.integers(1, 4), rng.integers(1, 4))), 2) * (rng.random() < 2)
        w[w < 0.4] = 0
        got = match.assign(w)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) and all(w[i, j] > 0 for i, j in enumerate(got) if j >= 0)
        assert sum(w[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best_total(w))


def test_optimal_beats_greedy(spark):
    pairs = spark.createDataFrame([("p", 1, 1, 0.9), ("p", 1, 2, 0.8), ("p", 2, 1, 0.8), ("p", 2, 2, 0.1)], "g string, l long, r long, s double")
    greedy = {tuple(r) for r in match.greedy(pairs, "g", "l", "r", "s", 0.3).collect()}
    optimal = {tuple(r) for r in match.optimal(pairs, "g", "l", "r", "s", 0.3).collect()}
    assert greedy == {("p", 1, 1, 0.9)} and optimal == {("p", 1, 2, 0.8), ("p", 2, 1, 0.8)}


def test_matching_ignores_row_order(spark):
    rng = np.random.default_rng(1)
    rows = [("g", int(a), int(b), float(np.round(s, 1))) for a, b, s in zip(rng.integers(0, 9, 60), rng.integers(0, 9, 60), rng.random(60))]
    rows = list({(g, a, b): (g, a, b, s) for g, a, b, s in rows}.values())
    results = set()
    for seed in range(3):
        np.random.default_rng(seed).shuffle(rows)
        df = spark.createDataFrame([tuple(r) for r in map(list, rows)], "g string, l string, r string, s double").repartition(seed + 1)
        results.add(frozenset(map(tuple, match.greedy(df, "g", "l", "r", "s", 0.2).collect())))
    assert len(results) == 1


def test_budgets(spark):
    rows = spark.createDataFrame([("a", 1, 9.0, 6), ("a", 2, 8.0, 7), ("a", 3, 7.0, 4)], "g string, k long, p double, c long")
    assert {tuple(r) for r in pack.greedy_budget(rows, "g", "k", "p", "c", 10).collect()} == {("a", 1, 6), ("a", 3, 4)}
    rows = spark.createDataFrame([("a", 1, 9, 4, 3), ("a", 2, 8, 4, 3), ("a", 3, 0, 2, None), ("a", 4, 7, 1, None)], "g string, k long, p long, c long, up long")
    assert sorted(r["k"] for r in pack.closure_budget(rows, "g", "k", "p", "c", "up", 10).collect()) == [1, 2, 3]
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 5)], "g string, k long, c long")
    assert [r["granted"] for r in pack.prefix_budget(rows, ["g"], ["k"], "c", 7).orderBy("k").collect()] == [5, 2]


def test_relations(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "i long, u string, v string")
    b = spark.createDataFrame([("x", "q", 7), ("x", "p", 8)], "u string, v string, j long")
    assert {(r["i"], r["j"]) for r in relate.any_of(a, b.select("u", "j"), [["u"]]).collect()} == {(1, 7), (1, 8)}
    runs = [("r1", a), ("r2", spark.createDataFrame([(9, "x", "p"), (3, "z", "q")], a.schema))]
    assert {(r["i"], r["source_run"]) for r in relate.first_wins(runs, ["u"], ["i"]).collect()} == {(1, "r1"), (2, "r1"), (3, "r2")}
    assert relate.missing(a, "u", b, "u", "fk").collect()[0]["record"] == "y"


def test_contracts(spark):
    rows = spark.createDataFrame([(1, 5.0, "reported", None, ["E"]), (2, None, "missing", "not stated", []), (3, 1.0, "missing", None, []), (4, None, "reported", None, []), (5, None, None, None, [])],
                                 "i long, v double, s string, r string, e array<string>")
    bad = validate.findings(rows, F.col("i"), {"x": validate.reported(F.col("v"), F.col("s"), F.col("r"), F.col("e"))})
    assert {r["record"] for r in bad.collect()} == {"3", "4", "5"}
    graph = spark.createDataFrame([(1,), (2,)], "k long")
    assert validate.apply_patch(graph, spark.createDataFrame([(3,)], "k long"), "k").count() == 3
    for patch in ([(3,), (3,)], [(2,), (4,)], [(None,)]):
        assert validate.apply_patch(graph, spark.createDataFrame(patch, "k long"), "k").count() == 2


def test_converging_sink(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "k long, v string")
    state = lambda **o: {r["k"]: r["status"] for r in sinks.converge(old, new, ["k"], ["v"], **o).collect()}
    assert state() == {1: "unchanged", 2: "refused", 3: "created"}
    assert state(replace=True)[2] == "replaced" and state(version=True)[2] == "versioned"


def test_html_parser_keeps_heading_stack():
    page = "<title>t</title><h1>A<p>one</p><h2>B</h2><p>two<table><tr><td>x</td><td>1</td></tr></table><script>var p='<p>no</p>'</script><h1>C</h1><li>three"
    assert parse.html(page) == [
        ("heading", "A", "A"), ("paragraph", "A", "one"), ("heading", "A > B", "B"), ("paragraph", "A > B", "two"),
        ("table_row", "A > B", "x | 1"), ("heading", "C", "C"), ("list_item", "C", "three"),
    ]
    assert parse.html(None) == [] and parse.html("<<<>>") is not None


def test_article_xml():
    xml = """<article><front><article-title>T</article-title><abstract><p>Abs</p></abstract></front><body><sec><title>Results</title><p>R1</p><p>R1</p>
    <sec><title>Sub</title><p>S1</p><table-wrap><caption>Cap</caption><table><tr><td>a</td><td>b</td></tr></table></table-wrap></sec></sec></body></article>"""
    assert parse.article(xml) == [("title", "", "T"), ("paragraph", "Abstract", "Abs"), ("paragraph", "Results", "R1"), ("paragraph", "Results > Sub", "S1"),
                                  ("caption", "Results > Sub", "Cap"), ("table_row", "Results > Sub", "a | b")]
    assert parse.article("<broken") == [] and parse.article(None) == []


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n01,"x, y"\n02,\n')
    assert [tuple(r) for r in tables.csv(spark, str(tmp_path / "a.csv"), ["id", "name"]).collect()] == [("01", "x, y"), ("02", None)]
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert sorted(r["a"] for r in tables.jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    raw = spark.createDataFrame([('{"a": 1, "zz": 2}',), ("broken",)], "j string")
    assert [r["unknown"] for r in tables.unknown_keys(raw, "j", ["a"]).collect()] == [["zz"], []]
    (tmp_path / "p.xml").write_text(
        "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation><PubmedData><ArticleIdList>"
        '<ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC1</ArticleId></ArticleIdList></PubmedData></PubmedArticle></Set>'
    )
    assert tuple(tables.pubmed(spark, str(tmp_path / "p.xml")).first()) == ("7", "T", "10.1/x", "PMC1")
    page = json.dumps({"resultList": {"result": [{"source": "MED", "id": "1", "doi": "10.1/x"}, {"source": "PPR", "id": "2"}]}})
    got = tables.europe_pmc(spark.createDataFrame([(page,)], "p string"), "p").collect()
    assert [r["url"] for r in got] == ["https://doi.org/10.1/x", "https://europepmc.org/article/PPR/2"]


def test_first_root_and_migration(spark):
    a, b = spark.createDataFrame([("p", 1)], "k string, v long"), spark.createDataFrame([("p", 2), ("q", 3)], "k string, v long")
    assert {tuple(r) for r in tables.first_root([a, b], "k").collect()} == {("p", 1), ("q", 3)}
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("w", T.DoubleType())])
    assert tuple(tables.with_defaults(a, schema).first()) == ("p", None)


def test_fusion_ties_go_to_smaller_ids(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q long, d long, rank long")
    b = spark.createDataFrame([(1, 6, 1), (1, 5, 2)], "q long, d long, rank long")
    assert [r["d"] for r in retrieve.fuse([a, b], "q", "d", 2).orderBy("rank").collect()] == [5, 6]


def test_streams(spark, tmp_path, sf):
    source = str(tmp_path / "in")
    tables.read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").repartition(2).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    out = str(tmp_path / "out")
    query = windows.once(stream, ["event_id"]).writeStream.foreachBatch(windows.idempotent(windows.overwrite, out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(source).select("event_id").distinct().count()
    query = windows.tumbling(stream, late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("w").select("start", "event_type", "events").collect()} == {tuple(r) for r in windows.tumbling(spark.read.parquet(source)).select("start", "event_type", "events").collect()}
    assert windows.sessions(spark.read.parquet(source)).agg(F.sum("events")).first()[0] == spark.read.parquet(source).count()


def test_structured_elements(spark):
    page = {"pages": [{"page_id": 0, "others": ["7"], "content": [
        {"type": "heading", "text": "A", "heading_level": 1}, {"type": "text", "text": "one"}, {"type": "text", "text": "one"}, {"type": "heading", "text": "B", "heading_level": 2},
        {"type": "table", "text": "<table><tr><td>x</td><td>1</td></tr></table>", "text_format": "html", "annotations": [{"text": "Table 1"}]},
        {"type": "heading", "text": "C", "heading_level": 1}, {"type": "image", "annotations": [{"text": "Figure 1"}]}]}]}
    rows = spark.createDataFrame([("d", json.dumps(page)), ("none", None), ("broken", "[1"), ("list", "[]")], "k string, j string")
    blocks = parse.element_blocks(rows, "k", "j", "S").orderBy("block_no").collect()
    assert [(r["block_type"], r["section_path"], r["text"]) for r in blocks] == [
        ("heading", "S", "A"), ("paragraph", "S > A", "one"), ("heading", "S > A", "B"), ("table", "S > A > B", "x | 1"), ("table_row", "S > A > B", "x | 1"),
        ("caption", "S > A > B", "Table 1"), ("heading", "S", "C"), ("figure", "S > C", "Figure 1"),
    ]


def test_degradation_and_ledger(spark):
    structured, dump = spark.createDataFrame([("a", "x")], "k string, t string"), spark.createDataFrame([("a", "d"), ("b", "e")], "k string, t string")
    blocks, warnings = corpus.degrade(structured, dump, spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k")
    assert {tuple(r) for r in blocks.collect()} == {("a", "x", False), ("b", "e", True)}
    assert {tuple(r) for r in warnings.collect()} == {("b", "page dump used"), ("c", "no text")}
    pages = spark.createDataFrame([("q", 1, "d", "d", 2), ("q", 2, "e", "e", 2), ("r", 1, "d", None, 1), ("s", 1, "d", "d", 2)], "g string, p long, d string, m string, n long")
    got = {r["g"]: r["complete"] for r in corpus.fetch_ledger(pages, ["g"], "p", "d", "m", "n").collect()}
    assert got == {"q": True, "r": False, "s": False}


def test_manifest_flags_and_schemas():
    assert corpus.manifest_problems({"queries": {"a": "x"}, "page_size": 10}, ["queries", "page_size"]) == []
    assert corpus.manifest_problems({"queries": {"a": " "}, "page_size": 0, "zz": 1}, ["queries", "page_size", "cap"]) == ["missing cap", "unknown zz", "empty query a", "page_size is not positive"]
    flags = corpus.Flags({"ids": False}, [("IDS", "ids"), ("OLD_IDS", "ids")])
    assert not flags.resolve("ids", {})[0] and flags.resolve("ids", {"OLD_IDS": "on"})[0] and not flags.resolve("ids", {"IDS": "0", "OLD_IDS": "1"})[0]
    with pytest.raises(KeyError):
        flags.resolve("other", {})
    with pytest.raises(ValueError):
        flags.resolve("ids", {"IDS": "maybe"})
    assert all(T.StructType.fromJson(json.loads(s)) == schemas.ALL[n] for n, s in schemas.export().items())
