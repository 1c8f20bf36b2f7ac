import json

import pytest
from pyspark.sql import functions as F

from factloom import gates
from factloom.operators import checks, pipeline, retrieve
from factloom.sources import writers

#: Two fields with the same shape of reasoning, and a result that adds to one of them.
CORPUS = {
    "conformal": ["a", ['["EXCHANGEABLE","scores"]', '["COVERAGE","set"]', '["CAUSE",["EXCHANGEABLE","scores"],["COVERAGE","set"]]']],
    "weighted": ["a", ['["EXCHANGEABLE","scores"]', '["COVERAGE","set"]', '["CAUSE",["EXCHANGEABLE","scores"],["COVERAGE","set"]]', '["SHIFT","law"]', '["KNOWN","ratio"]']],
    "banach": ["b", ['["CONTRACTION","map"]', '["LIMIT","point"]', '["CAUSE",["CONTRACTION","map"],["LIMIT","point"]]', '["COMPLETE","map"]']],
}


@pytest.fixture(scope="module")
def corpus(spark):
    facts = spark.createDataFrame([(n, i, e) for n, (_, es) in CORPUS.items() for i, e in enumerate(es)], "name string, fact_pos int, expr string")
    results = spark.createDataFrame([(n, i, f"about {n}", d, "ab".index(d)) for i, (n, (d, _)) in enumerate(CORPUS.items())], "name string, pos int, text string, domain string, domain_pos int")
    return facts, results


@pytest.fixture(scope="module")
def whole(corpus):
    return gates.whole(*corpus)


def test_whole_pipeline(whole, corpus, spark):
    assert {(r["a"], r["b"], r["score"]) for r in whole["analogies"].collect()} == {("conformal", "banach", 7.0), ("weighted", "banach", 7.0)}
    conjectures = {(r["base"], r["target"], r["projection"]) for r in whole["conjectures"].collect()}
    assert ("banach", "conformal", '["COMPLETE","scores"]') in conjectures and not any(t == "banach" and b == "conformal" for b, t, _ in conjectures)
    edges = {(r["relation"], r["src"], r["dst"]) for r in whole["edges"].collect()}
    assert ("extends", "result::weighted", "result::conformal") in edges and sum(r == "analogous_to" for r, _, _ in edges) == 2
    novelty = {r["result"]: (r["novelty"], r["nearest_prior"]) for r in whole["novelty"].collect()}
    assert novelty["weighted"] == (0.4, "conformal") and novelty["conformal"][0] == 1.0
    node = whole["nodes"].filter("id = 'result::weighted'").first()
    assert json.loads(node["attrs"]["novelty"]) == 0.4
    judged = spark.createDataFrame([("banach", "conformal", "COMPLETE(scores)", "plausible", "full sets are complete", 1)], "source_base string, source_target string, projection string, verdict string, reasoning string, seq int")
    again = pipeline.run(*corpus, judged)
    assert again["nodes"].filter("kind = 'conjecture' and element_at(attrs, 'verdict') is not null").count() == 1 and again["errors"].count() == 0


def test_declared_lattice(corpus):
    """Without the discovered roles only the declared ones ascend."""
    facts, results = corpus
    got = pipeline.run(facts, results, ascension=pipeline.ROLE_ASCENSION)
    assert got["analogies"].count() == 0  # LIMIT has no declared role, so that CAUSE facts don't match


def test_dashboard(whole, corpus):
    model = writers.dashboard_model(whole, corpus[1])
    assert [r["result"] for r in model["results"]] == ["conformal", "weighted", "banach"] and model["results"][1]["parent"] == "conformal" and model["counts"]["edges:extends"] == 1
    page = writers.dashboard_page(model, "A & B")
    assert "<h1>A &amp; B</h1>" in page and "banach" in page and page.count("<table>") == 3


def test_paper_run(corpus):
    facts, _ = corpus
    target, library = facts.filter("name = 'weighted'"), facts.filter("name <> 'weighted'")
    places = library.select(F.col("name").alias("id")).distinct().withColumn("pos", F.when(F.col("id") == "banach", 1).otherwise(0))
    ranked, cover = retrieve.paper_run(target, library, places)
    assert [(r["prior"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [("conformal", 1), ("banach", 2)]
    assert cover["covering_priors"] == ["conformal"] and cover["residual_facts"] == ["KNOWN(ratio)", "SHIFT(law)"]


def test_gates_raise(corpus, spark):
    facts, results = corpus
    with pytest.raises(gates.Violation, match="graph"):
        nodes = spark.createDataFrame([("x", 1, "thing", "", {}, "p")], "id string, seq bigint, kind string, label string, attrs map<string,string>, provenance string")
        gates.property_graph(nodes, spark.createDataFrame([], "seq bigint, src string, dst string, relation string, attrs map<string,string>, provenance string"))
    assert gates.lineage(facts).count() == 1
    with pytest.raises(gates.Violation, match="ungrounded"):
        gates.sections(spark.createDataFrame([("s", "text", {"a": "no such words"}, ['["P","a"]'])], "name string, text string, groundings map<string,string>, facts array<string>"))
    target = facts.filter("name = 'weighted'")
    library = facts.filter("name <> 'weighted'")
    places = library.select(F.col("name").alias("id")).distinct().withColumn("pos", F.lit(0))
    assert gates.retrieval(target, library, places).count() == 2


def test_gates_of_experiments_and_commands(spark, tmp_path, capsys):
    gates.games(spark)
    gates.regret(spark)
    (tmp_path / "a.md").write_text("# Title\n\nwords here\n\n- one\n- two\n")
    assert gates.main(["documents", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["passed"]
    (tmp_path / "corpus.json").write_text(json.dumps({"x": {"name": "x", "text": "t", "groundings": {}, "facts": [["P", "a"]]}}))
    assert gates.main(["corpus", str(tmp_path)]) == 0


def test_principles(spark):
    rows = checks.principles(spark, "latex").collect()
    assert [r["principle"] for r in rows] == ["P1", "P2", "P3", "P4", "P5"] and rows[4] != checks.principles(spark, "markdown").collect()[4]


def test_run_and_views(spark, tmp_path):
    from factloom.functions.text import normalize_markdown
    from factloom.operators import markdown, runs

    texts = spark.createDataFrame([("a", "# One\r\n\r\nwords <!-- gone -->\n\n- x\n- **Key:** y\n"), ("b", None)], "slug string, text string")
    done = markdown.decompose(texts).checkpoint()
    steps = {(r["slug"], r["id"]): r for r in runs.trajectory(texts, done, "markdown", normalize_markdown).collect()}
    assert len(steps) == 12 and {r["status"] for r in steps.values()} == {"ok"}
    assert steps["a", "20"]["metrics"]["removed_chars"] > 10 and steps["a", "30"]["metrics"]["n_nodes"] == 6 and steps["a", "00"]["metrics"]["n_principles"] == 5
    runs.write_views(markdown.node_rows(done), markdown.edge_rows(done), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"concepts", "relations", "triples", "graph", "dgroup", "content_vector", "ntriples", "metrics", "verification"}
    assert spark.read.json(str(tmp_path / "verification")).filter("not passed").count() == 0
    assert spark.read.json(str(tmp_path / "relations")).filter("slug = 'a' and predicate = 'contains'").count() == 5
