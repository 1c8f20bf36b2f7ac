import pytest
from pyspark.sql import functions as F

from factloom.operators import discover, graph, graphquery
from factloom.sources import readers, writers


@pytest.fixture(scope="module")
def built(spark, facts):
    f = facts({"r": ['["A","x"]', '["B","x","y"]', '["CAUSE",["A","x"],["B","x","y"]]'], "s": ['["A","u"]']})
    results = spark.createDataFrame([("r", "text r", "d1"), ("s", "text s", "")], "name string, text string, domain string")
    nodes, edges = graph.reify(f)
    nodes = nodes.unionByName(graph.result_nodes(results, f)).cache()
    return nodes, edges.cache()


def test_counts_and_validity(built):
    nodes, edges = built
    kinds = {(r["what"], r["name"]): r["count"] for r in graph.stats(nodes, edges).collect()}
    assert kinds == {("node", "entity"): 3, ("node", "fact"): 6, ("node", "functor"): 3, ("node", "result"): 2, ("edge", "instance_of"): 6, ("edge", "arg:0"): 6, ("edge", "arg:1"): 3, ("edge", "asserts"): 4, ("edge", "in"): 4}
    assert graph.validate(nodes, edges).count() == 0


def test_reification_is_lossless(built):
    nodes, edges = built
    texts = {r["id"]: r["text"] for r in graphquery.expr_strings(nodes, edges).collect()}
    assert texts["r::fact::3::CAUSE"] == "CAUSE(A(x), B(x, y))" and texts["r::fact::5::B"] == "B(x, y)"
    assert graphquery.expr_string(nodes, edges, "r::fact::3::CAUSE") == "CAUSE(A(x), B(x, y))"
    assert graphquery.reasoning_subgraph(edges, "r::fact::3::CAUSE").count() == 5
    with pytest.raises(ValueError):
        graphquery.expr_string(nodes, edges, "functor::A")


def test_negatives(spark, built):
    nodes, edges = built
    bad_nodes = nodes.unionByName(spark.createDataFrame([("n1", 1, "alien", "", {}, "p"), ("n2", 2, "fact", "F", {"functor": '"F"', "arity": "true"}, "p"), ("n3", 3, "result", "r", {"text": '"t"'}, None)], nodes.schema))
    bad_edges = edges.unionByName(spark.createDataFrame([(1, "n1", "nowhere", "likes", {}, "p"), (2, "n2", "n1", "arg:1", {}, "p")], edges.schema))
    got = {(r["subject"], r["error"]) for r in graph.validate(bad_nodes, bad_edges).collect()}
    assert {("n1", "unknown kind"), ("n1", "label must be a non-empty string"), ("n2", "attr arity must be int"), ("n3", "missing required attr n_facts"), ("n3", "provenance must be a string"), ("n1 likes nowhere", "unknown relation"), ("n1 likes nowhere", "dst is not a node"), ("n2", "arg indices are not 0 to arity - 1")} == got


def test_merging(spark):
    n = spark.createDataFrame([("a", 1, "functor", "A", {"k": "1", "m": "1"}, ""), ("a", 2, "functor", "A", {"k": "2"}, ""), ("b", 3, "functor", "B", {}, ""), ("b", 4, "entity", "B", {}, "")], graph.NODES)
    merged, clash = graph.merge_nodes(n)
    assert [(r["id"], r["attrs"]) for r in merged.collect()] == [("a", {"k": "2", "m": "1"})] and [r["id"] for r in clash.collect()] == ["b"]
    e = spark.createDataFrame([(1, "a", "a", "in", {}, ""), (2, "a", "a", "in", {}, ""), (3, "a", "a", "extends", {}, ""), (4, "a", "a", "extends", {"x": "1"}, ""), (5, "a", "z", "in", {}, "")], graph.EDGES)
    kept, errors = graph.merge_edges(e, merged)
    assert [(r["seq"], r["relation"]) for r in kept.collect()] == [(1, "in")] and {r["error"] for r in errors.collect()} == {"conflict", "no such node"}


def test_queries(spark, built):
    nodes, edges = built
    assert [r["result"] for r in graphquery.results_using_functor(edges, "A").collect()] == ["r", "s"]
    assert [r["label"] for r in graphquery.entities_of(nodes, "r").collect()] == ["x", "y"]
    assert graphquery.facts_of(edges, "r").count() == 3 and graphquery.find(nodes, "CAU", "functor").count() == 1
    steps = graphquery.shortest_path(nodes, edges, "result::r", "result::s")
    assert len(steps) == 4 and steps[0][0] == "result::r" and steps[-1][2] == "result::s"
    assert graphquery.shortest_path(nodes, edges, "result::r", "gone") is None and graphquery.shortest_path(nodes, edges, "result::r", "result::r") == []
    assert graphquery.fmt_path(steps).startswith("result::r -[")


def test_chains(spark):
    e = spark.createDataFrame([(1, "result::c", "result::b", "extends", {}, ""), (2, "result::b", "result::a", "extends", {}, ""), (3, "result::d", "result::a", "extends", {}, ""), (4, "result::x", "result::y", "extends", {}, ""), (5, "result::y", "result::x", "extends", {}, "")], graph.EDGES)
    n = spark.createDataFrame([(f"result::{x}", 0, "result", x, {"novelty": v}, "") for x, v in zip("abcdxy", ("0.5", "0.9", "0.1", "0.9", "0.2", "0.3"), strict=True)], graph.NODES)
    assert graphquery.extends_chain(e, "c") == ["b", "a"] and graphquery.extends_chain(e, "x") == ["y", "x"]
    assert graphquery.shared_ancestor(n, e, "c", "d") == "a" and graphquery.shared_ancestor(n, e, "c", "zz") is None
    assert [r["result"] for r in graphquery.most_novel(n, 2).collect()] == ["b", "d"] and graphquery.novelty_of(n, "a") == 0.5
    both = e.unionByName(spark.createDataFrame([(6, "result::c", "result::a", "extends", {}, "")], graph.EDGES))
    with pytest.raises(ValueError):
        graphquery.extends_chain(both, "c")


def test_roles_and_control(facts):
    f = facts({"r": ['["CAUSE",["P","x"],["Q","x","y"]]', '["CAUSE",["Q","a","b"],["CAUSE",["P","x"],["P","y"]]]'], "twin": ['["P","x"]', '["Q","x","y"]']})
    assert {r["functor"]: r["role"] for r in discover.discover_roles(f).collect()} == {"P": "ROLE::P::1", "Q": "ROLE::PC::2"}
    assert discover.discover_roles(f.filter("name = 'twin'")).count() == 0
    a, b = facts({"a": ['["CAUSE",["P","x"],["Q","x"]]']}), facts({"b": ['["CAUSE",["R","u"],["S","u"]]']})
    roles = discover.discover_roles(a.unionByName(b))
    got = discover.analogies(a, b, roles).collect()
    assert len(got) == 1 and got[0]["score"] == 3.0 and discover.analogies(a, b).count() == 0


def test_verdict_checks(spark):
    d = "id string, source_base string, source_target string, projection string, verdict string, reasoning string, related_known_work string"
    e = spark.createDataFrame([("1", "a", "b", "P(x)", "uncertain", "why", "work"), ("2", "a", "b", "Q(x)", "maybe", " ", None)], d)
    pairs = spark.createDataFrame([("b", "a")], "a string, b string")
    conj = spark.createDataFrame([("a", "b", '["P","x"]')], "base string, target string, projection string")
    assert {(r["id"], r["error"]) for r in discover.check_evaluations(e, pairs, conj).collect()} == {("2", "unknown verdict"), ("2", "no reasoning"), ("2", "no related work"), ("2", "no such projection")}
    good = ("1", "s", "s", "s", "s", "narrow")
    dirs = spark.createDataFrame([good, ("9", "s", "", "s", "s", "wide")], "id string, precise_statement string, whats_established string, open_question string, next_step string, scope_verdict string")
    assert {(r["id"], r["error"]) for r in discover.check_directions(dirs, e).collect()} == {("9", "not an uncertain evaluation"), ("9", "unknown scope"), ("9", "no whats_established")}


def test_round_trip(spark, built, tmp_path):
    nodes, edges = built
    writers.save_graph(nodes, edges, str(tmp_path / "n"), str(tmp_path / "e"))
    n, e, errors = readers.property_graph(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert errors.count() == 0 and n.count() == nodes.count() and e.count() == edges.count()
    same = n.select("id", "kind", "label", F.sort_array(F.map_entries("attrs")).alias("a")).exceptAll(nodes.select("id", "kind", "label", F.sort_array(F.map_entries("attrs")).alias("a")))
    assert same.count() == 0


def test_corpus_reader(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"_provenance": 1, "k1": {"name": "first-result", "text": "a map", "groundings": {"m": "a map"}, "facts": [["P", "m"], ["CAUSE", ["P", "m"], ["Q", "m", "n"]]]}, "k2": {"text": "t", "groundings": {}, "facts": []}}')
    results, f = readers.corpora(spark, [("d", str(path)), ("e", str(path))])
    assert [(r["name"], r["fact_pos"], r["expr"]) for r in f.filter("result_pos < 100000").orderBy("fact_pos").collect()] == [("first-result", 0, '["P","m"]'), ("first-result", 1, '["CAUSE",["P","m"],["Q","m","n"]]')]
    assert {r["name"] for r in results.collect()} == {"first-result", "k2"} and results.count() == 4
