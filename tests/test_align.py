import pytest
from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.operators import align as A

SOLAR = ['["GREATER",["MASS","sun"],["MASS","planet"]]', '["ATTRACTS","sun","planet"]', '["REVOLVES","planet","sun"]', '["CAUSE",["AND",["GREATER",["MASS","sun"],["MASS","planet"]],["ATTRACTS","sun","planet"]],["REVOLVES","planet","sun"]]', '["GREATER",["TEMPERATURE","sun"],["TEMPERATURE","planet"]]']
ATOM = ['["GREATER",["MASS","nucleus"],["MASS","electron"]]', '["ATTRACTS","nucleus","electron"]', '["REVOLVES","electron","nucleus"]']
OPT_A = ['["OBJECTIVE","loss"]', '["MINIMIZE","agent","loss"]', '["CAUSE",["MINIMIZE","agent","loss"],["DECREASES","loss","time"]]']
OPT_B = ['["OBJECTIVE","cost"]', '["OPTIMIZE","system","cost"]', '["CAUSE",["OPTIMIZE","system","cost"],["CHANGES","cost","step"]]']
LATTICE = {"MINIMIZE": "OBJECTIVE_OP", "MAXIMIZE": "OBJECTIVE_OP", "OPTIMIZE": "OBJECTIVE_OP", "DECREASES": "MONOTONE", "INCREASES": "MONOTONE", "CHANGES": "MONOTONE"}


def one(maps):
    row = maps.first()
    return row["score"], {c["b"]: c["t"] for c in row["corrs"]}


def test_solar_atom(facts):
    b, t = facts({"solar": SOLAR}), facts({"atom": ATOM})
    maps = A.align(b, t).cache()
    assert one(maps) == (7.0, {"sun": "nucleus", "planet": "electron"})
    got = A.inferences(maps, b).orderBy(F.desc("score")).collect()
    assert [(r["score"], r["base_fact"][2:5]) for r in got] == [(8.0, "CAU"), (2.0, "GRE")]
    report = A.novelty_report(maps, t).first()
    assert (report["novelty"], report["coverage"], report["shortcut"]) == (0.0, 1.0, 0.6)


def test_ascension(facts):
    b, t = facts({"a": OPT_A}), facts({"b": OPT_B})
    assert one(A.align(b, t))[1] == {"loss": "cost"}
    assert one(A.align(b, t, LATTICE))[1] == {"loss": "cost", "agent": "system", "time": "step"}


def test_skolem_penalty(facts):
    b, t = facts({"b": ['["REL","a","b"]', '["CAUSE",["REL","a","b"],["PROP","c"]]']}), facts({"t": ['["REL","x","y"]']})
    maps = A.align(b, t)
    assert A.inferences(maps, b).first()["score"] == 4.0
    assert A.inferences(maps, b, 1.0).first()["score"] == 3.0


def test_collapsing_hypothesis_is_rejected(facts):
    b = facts({"b": ['["REL","a","b"]']})
    assert A.match_hypotheses(b, facts({"t": ['["REL","x","x"]']})).count() == 0
    assert A.match_hypotheses(b, facts({"t": ['["REL","x","y"]']})).count() == 1
    assert A.match_hypotheses(b, facts({"t": ['["REL","x",["P","y"]]']})).count() == 0


def test_trickle(facts):
    deep = lambda a, b: ['["ATTRACTS","%s","%s"]' % (a, b), '["REVOLVES","%s","%s"]' % (b, a), '["CAUSE",["ATTRACTS","%s","%s"],["REVOLVES","%s","%s"]]' % (a, b, b, a)]
    b, t = facts({"b": deep("s", "p")}), facts({"t": deep("n", "e")})
    plain, more = one(A.align(b, t))[0], one(A.align(b, t, trickle=0.5))[0]
    assert (plain, more) == (7.0, 9.0)


def test_confirmation(facts):
    b = facts({"b": ['["ANCHOR","a","b"]', '["REL","a","c"]']})
    t = facts({"t": ['["ANCHOR","x","y"]', '["REL","x","y"]']})
    row = A.transfer(b, t).first()
    assert (row["status"], row["projection"], row["confidence"]) == ("confirmed", '["REL","x","skolem:c"]', 0.0)
    lone = facts({"t": ['["ANCHOR","x","y"]', '["REL","z","y"]']})
    assert A.transfer(b, lone).first()["status"] == "novel"


def test_expression_columns(spark):
    e = '["CAUSE",["P","x"],["Q","x","y"]]'
    c = F.col("e")
    row = spark.createDataFrame([(e,)], "e string").select(
        X.order(c).alias("o"), X.functor(c).alias("f"), X.leaves(c).alias("l"), X.entities(c).alias("n"), X.functors(c).alias("fs"), X.skeleton(c).alias("s"), X.subexprs(c).alias("sub"),
        X.fmt_expr(c).alias("fmt"), X.arg_list(c).alias("args"), X.project(c, F.create_map(F.lit("x"), F.lit("u"))).alias("p")).first()
    assert (row["o"], row["f"], row["l"], row["n"], row["fs"]) == (2, "CAUSE", ["x", "x", "y"], ["x", "y"], ["CAUSE", "P", "Q"])
    assert row["sub"] == [e, '["P","x"]', '["Q","x","y"]'] and row["args"] == ['["P","x"]', '["Q","x","y"]']
    assert row["fmt"] == "CAUSE(P(x), Q(x, y))" and row["p"] == '["CAUSE",["P","u"],["Q","u","skolem:y"]]' and row["s"] == '["CAUSE",["P",_],["Q",_,_]]'


def test_entities_and_empty_predicates(spark):
    rows = spark.createDataFrame([('"x"',), ('["F"]',)], "e string").select(X.order(F.col("e")).alias("o"), X.leaves(F.col("e")).alias("l"), X.arg_list(F.col("e")).alias("a"), X.functor(F.col("e")).alias("f")).collect()
    assert [(r["o"], r["l"], r["a"], r["f"]) for r in rows] == [(0, ["x"], [], None), (1, [], [], "F")]


@pytest.mark.parametrize("bad", ["[]", "3", '[["F"],"x"]', '["F",{"a":1}]'])
def test_canonical_refuses(spark, bad):
    with pytest.raises(Exception, match="not an expression"):
        spark.createDataFrame([(bad,)], "e string").select(X.canonical(F.col("e"))).collect()
    assert spark.createDataFrame([(' ["F", "x" ]',)], "e string").select(X.canonical(F.col("e"))).first()[0] == '["F","x"]'
