"""Roles, cross-domain analogies, and the checks of recorded verdicts and directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.operators import align as A

#: Fixed values.
VERDICTS, SCOPES = ("plausible", "uncertain", "implausible"), ("promising", "narrow", "ill_posed")


def discover_roles(facts: DataFrame) -> DataFrame:
    """functor, role: whether a functor is ever premise (P) or conclusion (C) of a top-level CAUSE, with its arity as
    last seen. CAUSE itself has no role; a CAUSE without exactly two arguments is an error."""
    # the error is tied to the functor, as conditions may be evaluated in any order
    parsed = X.once(facts.filter(F.col("expr").startswith('["CAUSE"')), a=X.arg_list(F.col("expr")))
    checked = F.when(F.size("a") != 2, F.raise_error(F.lit("CAUSE needs two arguments")).cast("array<string>")).otherwise(F.col("a"))
    sides = parsed.select("name", "fact_pos", F.posexplode(checked).alias("side", "e")).filter(~X.is_entity(F.col("e")))
    sides = X.once(sides, functor=X.functor(F.col("e")), size=F.size(X.arg_list(F.col("e")))).filter("functor <> 'CAUSE'")
    # arities are counted before any order is asked for, which only functors of more than one need
    by = sides.groupBy("functor", "size").agg(F.max((F.col("side") == 0).cast("int")).alias("p"), F.max((F.col("side") == 1).cast("int")).alias("c")).checkpoint()
    seen = by.groupBy("functor").agg((F.max("p") == 1).alias("p"), (F.max("c") == 1).alias("c"), F.max("size").alias("arity"), F.count("*").alias("arities"))
    several = seen.filter("arities > 1").select("functor")
    if several.limit(1).count():
        last = sides.join(several, "functor", "left_semi").groupBy("functor").agg(F.max_by("size", F.struct("name", "fact_pos", "side")).alias("last"))
        seen = seen.join(last, "functor", "left").withColumn("arity", F.coalesce("last", "arity"))
    return seen.select("functor", F.concat(F.lit("ROLE::"), F.when(F.col("p"), "P").otherwise(""), F.when(F.col("c"), "C").otherwise(""), F.lit("::"), F.col("arity").cast("string")).alias("role"))


def analogies(a: DataFrame, b: DataFrame, ascension=None, min_score: float = 3.0) -> DataFrame:
    """a, b, score, corrs, shared: pairs of results that align to at least min_score with a map, best first."""
    maps = A.align(a, b, ascension)
    shared = A.matched_facts(maps, a, "base").groupBy("base", "target").agg(F.array_sort(F.collect_list(X.fmt_expr(F.col("expr")))).alias("shared"))
    good = maps.filter((F.col("score") >= min_score) & (F.size("corrs") > 0)).join(shared, ["base", "target"])
    return good.select(F.col("base").alias("a"), F.col("target").alias("b"), "score", F.array_sort("corrs").alias("corrs"), "shared").orderBy(F.desc("score"), "a", "b")


def multidomain_analogies(facts: DataFrame, domains: DataFrame, ascension=None, min_score: float = 3.0) -> DataFrame:
    """Analogies between results of different domains, each pair of domains once, for domains (name, domain_pos)."""
    d = domains.select("name", "domain_pos")
    pairs = d.select(F.col("name").alias("base"), F.col("domain_pos").alias("x")).join(d.select(F.col("name").alias("target"), F.col("domain_pos").alias("y")), F.col("x") < F.col("y")).select("base", "target")
    lattice = ascension if ascension is not None else discover_roles(facts)
    maps = A.align(facts, facts, lattice, pairs=pairs)
    return maps.filter((F.col("score") >= min_score) & (F.size("corrs") > 0)).select(F.col("base").alias("a"), F.col("target").alias("b"), "score", F.array_sort("corrs").alias("corrs")).orderBy(F.desc("score"), "a", "b")


def attach_verdicts(conjectures: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Conjecture nodes with the verdict and reasoning of the last evaluation (in the order of seq) of the same base,
    target (after -> in the provenance) and projection."""
    key = ["source_base", "source_target", "projection"]
    last = evaluations.groupBy(*key).agg(F.max_by(F.struct("verdict", "reasoning"), "seq").alias("v"))

    def plain(k):
        return F.regexp_replace(F.element_at("attrs", k), '^"|"$', "")

    rows = conjectures.withColumn("source_base", plain("source_base")).withColumn("projection", plain("projection")).withColumn("source_target", F.substring_index("provenance", "->", -1))
    rows = rows.join(last, key, "left")
    more = F.create_map(F.lit("verdict"), F.concat(F.lit('"'), F.col("v.verdict"), F.lit('"')), F.lit("reasoning"), F.concat(F.lit('"'), F.col("v.reasoning"), F.lit('"')))
    kept = F.map_filter("attrs", lambda k, v: ~k.isin("verdict", "reasoning"))
    return rows.withColumn("attrs", F.when(F.col("v").isNotNull(), F.map_concat(kept, more)).otherwise(F.col("attrs"))).drop("v", *key)


def check_evaluations(evaluations: DataFrame, analogy_pairs: DataFrame, conjectures: DataFrame) -> DataFrame:
    """id, error of evaluations: verdict, reasoning, related work, an analogy (a, b) either way, and a projection that
    transfer gives for the pair."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    either = analogy_pairs.select("a", "b").unionByName(analogy_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    known = conjectures.select(F.col("base").alias("source_base"), F.col("target").alias("source_target"), X.fmt_expr(F.col("projection")).alias("projection")).distinct()
    e = evaluations
    found = [
        e.filter(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).select("id", F.lit("unknown verdict").alias("error")),
        e.filter(blank("reasoning")).select("id", F.lit("no reasoning").alias("error")),
        e.filter(blank("related_known_work")).select("id", F.lit("no related work").alias("error")),
        e.join(either, (e.source_base == either.a) & (e.source_target == either.b), "left_anti").select("id", F.lit("no such analogy").alias("error")),
        e.join(known, ["source_base", "source_target", "projection"], "left_anti").select("id", F.lit("no such projection").alias("error")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def check_directions(directions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """id, error: directions must be the uncertain evaluations, each once, with all fields and a known scope."""
    want = evaluations.filter("verdict = 'uncertain'").select("id").distinct()
    fields = ("precise_statement", "whats_established", "open_question", "next_step")
    found = [
        want.join(directions, "id", "left_anti").select("id", F.lit("missing").alias("error")),
        directions.join(want, "id", "left_anti").select("id", F.lit("not an uncertain evaluation").alias("error")),
        directions.groupBy("id").count().filter("count > 1").select("id", F.lit("more than once").alias("error")),
        directions.filter(~F.coalesce(F.col("scope_verdict").isin(*SCOPES), F.lit(False))).select("id", F.lit("unknown scope").alias("error")),
        *[directions.filter(F.coalesce(F.trim(f), F.lit("")) == "").select("id", F.lit(f"no {f}").alias("error")) for f in fields],
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
