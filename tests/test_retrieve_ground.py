from pyspark.sql import functions as F

from factloom.operators import ground, retrieve


def test_cosine_and_ranks(spark):
    v = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 2), ("b", "y", 1), ("c", "z", 1)], "id string, feature string, cnt long")
    pos = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos int")
    got = retrieve.rank_against(v.filter("id = 'a'"), v, pos).orderBy("rank").collect()
    assert [(r["b"], r["score"]) for r in got] == [("b", 5.0), ("c", 0.0)]
    sim = {(r["a"], r["b"]): r["similarity"] for r in retrieve.similarity_matrix(v).collect()}
    assert sim["a", "b"] == 1.0 and sim["a", "c"] == 0.0 and sim["c", "c"] == 1.0 and len(sim) == 9


def test_lineage_and_residual(facts):
    f = facts({"parent": ['["P","x","y"]'], "child": ['["P","x","y"]', '["P","x","y"]', '["Q","x","y"]'], "other": ['["Z","a"]']})
    ancestors, edges = retrieve.lineage(f)
    row = edges.collect()
    assert len(row) == 1 and row[0]["parent"] == "parent" and row[0]["residual"] == ["P(x, y)", "Q(x, y)"] and row[0]["parent_reuse"] == 1.0
    assert [(r["result"], r["ancestor"]) for r in ancestors.collect()] == [("child", "parent")]


def test_novelty_direction(spark, facts):
    f = facts({"p": ['["REL","a","b"]'], "r": ['["REL","x","y"]', '["OTHER","x","y"]']})
    pos = spark.createDataFrame([("p", 0), ("r", 1)], "id string, pos int")
    got = {r["result"]: r for r in retrieve.result_novelty(f, pos).collect()}
    assert (got["r"]["coverage"], got["r"]["nearest_prior"], got["p"]["novelty"], got["p"]["nearest_prior"]) == (0.5, "p", 1.0, None)


def test_cover_takes_the_first_of_equals(spark, facts):
    lib = facts({"one": ['["A","x"]', '["B","x"]'], "two": ['["B","x"]', '["A","x"]'], "three": ['["C","x"]']})
    pos = spark.createDataFrame([("one", 0), ("two", 1), ("three", 2)], "id string, pos int")
    got = retrieve.decompose(facts({"t": ['["A","u"]', '["B","u"]', '["C","u"]', '["D","u"]', '["CAUSE",["A","u"],["D","u"]]']}), lib, pos)
    assert got["covering_priors"] == ["one", "three"] and got["coverage_fraction"] == 0.6
    assert got["novel_contributions"] == ["D(u)"] and got["residual_facts"] == ["CAUSE(A(u), D(u))", "D(u)"]


def test_retrieve_ranks_by_novelty(spark, facts):
    lib = facts({"near": ['["A","x"]', '["B","x"]'], "far": ['["Z","x"]']})
    pos = spark.createDataFrame([("near", 0), ("far", 1)], "id string, pos int")
    got = retrieve.retrieve(facts({"t": ['["A","u"]', '["B","u"]']}), lib, pos).orderBy("rank").collect()
    assert got[0]["prior"] == "near" and got[0]["novelty"] == 0.0 and got[0]["cosine"] == 1.0 and got[1]["coverage"] == 0.0


def test_index_finds_the_exact_nearest(spark):
    v = retrieve.synthetic_vectors(spark, 120)
    q = v.filter("id in ('syn3', 'syn77')").withColumn("id", F.concat(F.lit("q"), F.col("id")))
    index = retrieve.SignIndex(v)
    got = {r["a"]: r for r in index.query(q, top_k=1).collect()}
    exact = {r["a"]: r for r in retrieve.linear_top_k(q, v, 1).collect()}
    assert {a: r["b"] for a, r in got.items()} == {a: r["b"] for a, r in exact.items()} == {"qsyn3": "syn3", "qsyn77": "syn77"}
    assert all(r["fraction"] < 0.5 for r in got.values())


def test_grounding_negatives(spark):
    rows = [("ok", "the map is tight", {"m": "the map"}, ['["P","m"]']), ("gone", "text", {"m": "absent"}, ['["P","m"]']), ("blank", "text", {"m": " "}, ['["P","m"]']), ("lost", "text", {"m": "text"}, ['["P","m","k"]'])]
    df = spark.createDataFrame(rows, "name string, text string, groundings map<string,string>, facts array<string>")
    got = {r["name"]: (r["ok"], r["ungrounded"], r["missing"]) for r in ground.check_sections(df).collect()}
    assert got == {"ok": (True, [], []), "gone": (False, ["m"], []), "blank": (False, ["m"], []), "lost": (False, [], ["k"])}
    assert not ground.all_grounded(df) and ground.all_grounded(df.filter("name = 'ok'"))


def test_riddle(spark, facts):
    s = facts({"s": ['["TOTAL","all"]', '["DIVIDES","all","n","each"]']})
    t = facts({"t": ['["TOTAL","whole"]', '["DIVIDES","whole","k","blank"]']})
    r = spark.createDataFrame([("s", "t", "each", "blank", {"whole": "3 hours", "k": "3 people"})], "base string, target string, answer_symbol string, blank_symbol string, groundings map<string,string>")
    row = ground.solve(r, s, t).first()
    assert row["numeric_answer"] == "1 hour" and row["answer_maps_to_blank"] and row["structural_answer"] == "blank = whole ÷ k"
    e = ground.solve(r, facts({"s": ['["EQUALS","each","all"]']}), facts({"t": ['["EQUALS","blank","whole"]']})).first()
    assert e["numeric_answer"] == "3 hours"
