"""Gates: each raises Violation if an invariant is broken, and can be run as `python -m factloom.gates <gate> <folder>`."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import checks, discover, graph, ground, latex, lift, markdown, numeric, pipeline, retrieve
from factloom.operators import html as html_
from factloom.sources import readers


class Violation(RuntimeError):
    """An invariant does not hold; the message names the first few cases."""


def require(bad: DataFrame, what: str, shown: int = 5) -> None:
    """Raise if there are rows."""
    rows = bad.limit(shown).collect()
    if rows:
        raise Violation(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def documents(nodes: DataFrame, edges: DataFrame, lengths: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """The checks of decomposed documents, all of which must pass."""
    found = checks.run_all(nodes, edges, lengths, min_ratio).checkpoint()
    require(found.filter("not passed"), "documents")
    return found


def concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The checks of the concept graph lifted from documents, and that renaming changes nothing."""
    concept, relation = lift.concepts(nodes), lift.relations(nodes, edges).checkpoint()
    found = checks.run_concept_checks(concept, relation, edges).checkpoint()
    require(found.filter("not passed"), "concepts")
    if not lift.renaming_invariant(concept, relation):
        raise Violation("concepts: renaming changes the content vector")
    return found


def sections(rows: DataFrame) -> DataFrame:
    found = ground.check_sections(rows).checkpoint()
    require(found.filter("not ok"), "ungrounded")
    return found


def told_apart(base: DataFrame, instance: DataFrame, distinct: DataFrame) -> dict:
    """A known instance must have little novelty against the base, a distinct result much."""
    got = ground.discrimination(base, instance, distinct)
    if not got["discriminates"]:
        raise Violation(f"not told apart: {got}")
    return got


def retrieval(target: DataFrame, library: DataFrame, positions: DataFrame, mac_k: int = 2) -> DataFrame:
    """Novelty and coverage add up to 1, ranks count from 1, and no prior of the short list is less novel than the first."""
    found = retrieve.retrieve(target, library, positions, mac_k).checkpoint()
    require(found.filter("abs(novelty + coverage - 1) > 1e-3 or novelty < 0 or novelty > 1"), "novelty")
    first = found.groupBy("target").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count("*").alias("n"), F.min("novelty").alias("least"), F.min_by("novelty", "rank").alias("first"))
    require(first.filter("low <> 1 or high <> n or first > least"), "ranks")
    return found


def index(vectors: DataFrame, queries: DataFrame, most: float = 0.1) -> DataFrame:
    """The sign index examines less than `most` of the library on average and finds each query's exact best."""
    got = retrieve.SignIndex(vectors).query(queries, top_k=1).checkpoint()
    exact = retrieve.linear_top_k(queries, vectors, 1).select("a", F.col("cosine").alias("best"))
    require(got.join(exact, "a").filter("cosine < best"), "not the nearest")
    require(got.agg(F.avg("fraction").alias("fraction")).filter(F.col("fraction") >= most), "examined")
    return got


def lineage(facts: DataFrame, tau: float = 0.5) -> DataFrame:
    """Reuse is tau to 1, novelty 0 to 1, and each result has one parent, of fewer facts."""
    _, edges = retrieve.lineage(facts, tau)
    edges = edges.checkpoint()
    require(edges.filter(f"parent_reuse < {tau} or parent_reuse > 1 or novelty < 0 or novelty > 1"), "reuse")
    require(edges.groupBy("child").count().filter("count > 1"), "parents")
    n = facts.groupBy("name").agg(F.count("*").alias("n"))
    sized = edges.join(n.select(F.col("name").alias("child"), F.col("n").alias("cn")), "child").join(n.select(F.col("name").alias("parent"), F.col("n").alias("pn")), "parent")
    require(sized.filter("pn >= cn"), "a parent is no smaller")
    return edges


def property_graph(nodes: DataFrame, edges: DataFrame) -> None:
    require(graph.validate(nodes, edges), "graph")


def whole(facts: DataFrame, results: DataFrame, evaluations: DataFrame | None = None, min_score: float = 3.0) -> dict[str, DataFrame]:
    """The whole pipeline: a valid graph, analogies that reach the score, and a novelty from 0 to 1 for each result."""
    got = pipeline.run(facts, results, evaluations, min_score=min_score)
    require(got["errors"], "graph")
    require(got["analogies"].filter(F.col("score") < min_score), "analogies")
    require(got["novelty"].filter("novelty < 0 or novelty > 1"), "novelty")
    require(results.select(F.col("name").alias("result")).join(got["novelty"], "result", "left_anti"), "no novelty")
    return got


def judgements(evaluations: DataFrame, analogies: DataFrame, conjectures: DataFrame, directions: DataFrame) -> None:
    require(discover.check_evaluations(evaluations, analogies, conjectures), "evaluations")
    require(discover.check_directions(directions, evaluations), "directions")


def markov(spark: SparkSession, gamma: float = 0.9) -> DataFrame:
    """The modulus is gamma where the weights are stationary, and never falls as the mismatch grows."""
    rows = numeric.markov_experiment(spark, gamma=gamma).checkpoint()
    require(rows.filter(F.col("t") == 0).filter(F.abs(F.col("modulus") - gamma) > 1e-3), "modulus at the stationary weights")
    a, b = rows.alias("a"), rows.alias("b")
    falls = a.join(b, F.expr("a.trial = b.trial and a.t < b.t")).filter("b.modulus < a.modulus - 1e-4 or b.chi2 < a.chi2 - 1e-4")
    require(falls.select("a.trial", "a.t"), "modulus falls")
    return rows


def em(spark: SparkSession, **more) -> dict:
    got = numeric.em_experiment(spark, **more)
    if abs(got["fixed_point"] - more.get("theta", 3.0)) > 1e-3 or got["kappa"] >= 1 or any(x["fp_err"] > x["bound"] for x in got["levels"]):
        raise Violation(f"em: {got}")
    return got


def games(spark: SparkSession) -> DataFrame:
    """Rates are the radius, ends are as it says, the condition is the radius below 1, growth shrinks with the square."""
    rows = numeric.game_experiment(spark).checkpoint()
    ratio = F.col("d_last") / F.col("d0")
    near = ratio.between(F.pow("rho", F.lit(2000)) / 2, F.pow("rho", F.lit(2000)) * 2)
    ends = F.when(F.col("phase") == "converge", ratio < 0.01).when(F.col("phase") == "diverge", ratio > 10).otherwise(near)
    require(rows.filter((F.abs(F.col("empirical_rate") - F.col("rho")) > 0.02) | ~ends), "games")
    require(numeric.game_identities(spark).filter("contracts <> condition or gap > 1e-12"), "identities")
    excess = [r["excess"] for r in numeric.game_scaling(spark).orderBy(F.desc("eta")).collect()]
    if not all(3 < a / b < 5 for a, b in zip(excess, excess[1:], strict=False)):
        raise Violation(f"scaling: {excess}")
    early, late = numeric.averaged_play(spark).orderBy("t").collect()
    if late["last"] <= 1.5 * early["last"] or late["averaged"] >= 0.1 * late["last"]:
        raise Violation(f"averaged play: {early}, {late}")
    return rows


def regret(spark: SparkSession, horizon: int = 4000) -> DataFrame:
    """The informed step's rate is 1 - 1 / kappa, the robust one's exponent -1, and tracking is drift times kappa - 1."""
    rows = numeric.regret_experiment(spark, horizon).checkpoint()
    above = rows.filter("kappa > 1")
    require(above.filter(F.abs(F.col("geometric_rate") - (1 - 1 / F.col("kappa"))) > 0.02), "rate")
    require(above.filter(F.abs(F.col("poly_exponent") + 1) > 0.15), "exponent")
    require(above.filter(F.abs(F.col("tracking_001") / (0.001 * (F.col("kappa") - 1)) - 1) > 0.05), "tracking")
    return rows


def _documents(spark: SparkSession, folder: str) -> None:
    """Decompose the folder's Markdown, HTML and LaTeX files, write their nodes, and check documents and concepts."""
    for suffix, decompose in (("md", markdown.decompose), ("html", html_.decompose), ("tex", latex.decompose)):
        if not any(name.endswith("." + suffix) for name in os.listdir(folder)):
            continue
        files = spark.read.text(f"{folder}/*.{suffix}", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[a-z]+$", 1).alias("slug"), F.col("value").alias("text"))
        done = decompose(files).checkpoint()
        nodes, edges = markdown.node_rows(done), markdown.edge_rows(done)
        nodes.write.mode("overwrite").json(f"{folder}/nodes-{suffix}")
        documents(nodes, edges, done.select("slug", F.col("n_chars").alias("length")), 0.0)
        concepts(nodes, edges)


def _corpus(spark: SparkSession, folder: str) -> None:
    """Gate the lineage of a corpus file of results."""
    lineage(readers.corpus(spark, f"{folder}/corpus.json")[1].select("name", "fact_pos", "expr"))


GATES = {"documents": _documents, "corpus": _corpus, "markov": lambda s, _: markov(s), "em": lambda s, _: em(s), "games": lambda s, _: games(s), "regret": lambda s, _: regret(s)}


def main(argv: list[str] | None = None) -> int:
    from factloom.session import checkpoints, local_session

    parse = argparse.ArgumentParser(prog="factloom.gates")
    parse.add_argument("gate", choices=sorted(GATES))
    parse.add_argument("folder", nargs="?", default=".")
    given = parse.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    checkpoints(spark)
    try:
        GATES[given.gate](spark, given.folder)
    except Violation as e:
        print(json.dumps({"gate": given.gate, "passed": False, "why": str(e)}))
        return 1
    print(json.dumps({"gate": given.gate, "passed": True}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
