"""Structural alignment of results: match hypotheses by equi-join, a greedy ordered fold, projected inferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from factloom.functions import expressions as X
from factloom.operators import fold

#: FACTS is (name, fact_pos, expr in canonical JSON); the order of facts breaks ties.
PAIR = ["base", "target"]


def lattice_of(ascension: DataFrame | dict[str, str] | None) -> dict[str, str] | None:
    """A lattice (functor, role) as a dictionary. A DataFrame's rows are collected: a lattice lists functors, not data."""
    if ascension is None or isinstance(ascension, dict):
        return ascension
    return {r["functor"]: r["role"] for r in ascension.select("functor", "role").collect()}


def ascension_map(ascension: DataFrame | dict[str, str] | None) -> Column | None:
    found = lattice_of(ascension)
    if found is None:
        return None
    if not found:
        return F.expr("cast(map() as map<string,string>)")
    return F.create_map(*[F.lit(x) for kv in sorted(found.items()) for x in kv])


def _sides(facts: DataFrame, ascension: Column | None, side: str) -> DataFrame:
    return facts.select(F.col("name").alias(side), F.col("fact_pos").alias(f"{side[0]}pos"), F.col("expr").alias(f"{side}_expr"), X.match_key(F.col("expr"), ascension).alias("key"))


def match_hypotheses(base: DataFrame, target: DataFrame, ascension=None, pairs: DataFrame | None = None) -> DataFrame:
    """base, target, bpos, tpos, ord, corrs: each pair of facts that match and map entities one to one.

    All results of one side meet all of the other, except themselves, or only those of pairs. Matching is a hash
    join on the match key, so that facts without a counterpart cost nothing.
    """
    lattice = ascension_map(ascension)
    b, t = _sides(base, lattice, "base"), _sides(target, lattice, "target")
    both = b.join(pairs, "base").join(t, ["target", "key"]) if pairs is not None else b.join(t, "key").filter("base <> target")
    both = both.withColumn("corrs", X.pairs_of(F.col("base_expr"), F.col("target_expr"))).filter(X.bijective(F.col("corrs")))
    return both.select(*PAIR, "bpos", "tpos", X.order(F.col("base_expr")).alias("ord"), "corrs")


def _beside(base: DataFrame, target: DataFrame, lattice: dict[str, str] | None, pairs: DataFrame | None) -> DataFrame:
    """base, target, times, and the facts of both as texts: a row for each pair. Without pairs, those of
    which any facts match.

    A result's facts travel as one row, so that a pair costs no more than its facts, whatever they match.
    """
    def held(facts: DataFrame) -> DataFrame:
        one = F.concat_ws(fold.PART, F.col("fact_pos").cast("string"), "expr", X.match_key(F.col("expr"), ascension_map(lattice)))
        return facts.filter("expr is not null").select("name", one.alias("f")).groupBy("name").agg(F.array_join(F.collect_list("f"), fold.ROW).alias("f"))

    b, t = held(base), held(target)
    if pairs is None:
        keys = lambda facts, side: _sides(facts, ascension_map(lattice), side).select(side, "key").distinct()
        pairs = keys(base, "base").join(keys(target, "target"), "key").filter("base <> target")
        pairs = pairs.select(*PAIR).distinct().withColumn("times", F.lit(1).cast("long"))
    else:
        pairs = pairs.groupBy(*PAIR).agg(F.count("*").alias("times"))
    return pairs.join(b.select(F.col("name").alias("base"), F.col("f").alias("b")), "base").join(t.select(F.col("name").alias("target"), F.col("f").alias("t")), "target")


def _run(rows: DataFrame, kernel, *args, schema: str) -> DataFrame:
    return rows.mapInArrow(kernel(*args, to_arrow_schema(_parse_datatype_string(schema))), schema)


MAPS = "base string, target string, score double, corrs array<struct<b:string,t:string>>, matched array<struct<bpos:int,tpos:int>>"


def align(base: DataFrame, target: DataFrame, ascension=None, pairs: DataFrame | None = None, trickle: float = 0.0) -> DataFrame:
    """base, target, score, corrs, matched: the greedy merge of the hypotheses of each pair.

    Hypotheses are taken by falling order, then base position, then target position, if they keep the map one to
    one; each adds 1 + its order. With trickle, every matched base fact adds trickle * (1 + order) for each
    strict part that is matched itself. Pairs without any hypothesis have no row.
    """
    lattice = lattice_of(ascension)
    maps = _run(_beside(base, target, lattice, pairs), fold.maps, schema=MAPS)
    if trickle <= 0:
        return maps
    hits = matched_facts(maps, base, "base").select(*PAIR, "fact_pos", "expr")
    parts = hits.select(*PAIR, F.posexplode(X.subexprs(F.col("expr"))).alias("i", "part")).filter("i > 0")
    known = hits.select(*PAIR, F.col("expr").alias("part")).distinct()
    bonus = parts.join(known, [*PAIR, "part"]).groupBy(*PAIR).agg(F.sum(F.lit(trickle) * (1 + X.order(F.col("part")))).alias("bonus"))
    return maps.join(bonus, PAIR, "left").withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 3)).drop("bonus")


def matched_facts(maps: DataFrame, facts: DataFrame, side: str) -> DataFrame:
    """base, target, fact_pos, expr: matched facts of one side, once for each match."""
    at = maps.select(*PAIR, F.explode("matched").alias("m")).select(*PAIR, F.col(f"m.{side[0]}pos").alias("fact_pos"))
    named = facts.select(F.col("name").alias(side), F.col("fact_pos").cast("int").alias("fact_pos"), "expr")
    return at.join(named, [side, "fact_pos"])


def _mapping(corrs: Column) -> Column:
    return F.map_from_entries(F.transform(corrs, lambda c: F.struct(c["b"], c["t"])))


def inferences(maps: DataFrame, base: DataFrame, skolem_penalty: float = 0.0) -> DataFrame:
    """Base facts that are not matched but tied to the map, projected onto the target.

    anchored counts parts that are matched (with repeats), entity_overlap the distinct entities with an image and
    n_skolems those without one; score is 2 anchored + entity_overlap - skolem_penalty n_skolems.
    """
    known = matched_facts(maps, base, "base").groupBy(*PAIR).agg(F.collect_set("expr").alias("known"))
    facts = base.select(F.col("name").alias("base"), F.col("fact_pos").alias("bpos"), "expr")
    rows = maps.select(*PAIR, _mapping(F.col("corrs")).alias("map")).join(known, PAIR).join(facts, "base").filter(~F.array_contains("known", F.col("expr")))
    parts = F.filter(X.subexprs(F.col("expr")), lambda x, i: i > 0)
    rows = rows.withColumn("anchored", F.size(F.filter(parts, lambda x: F.array_contains("known", x))))
    rows = rows.withColumn("entity_overlap", F.size(F.filter(X.entities(F.col("expr")), lambda x: F.map_contains_key("map", x))))
    rows = rows.filter("anchored > 0 or entity_overlap > 0").withColumn("projection", X.project(F.col("expr"), F.col("map")))
    rows = rows.withColumn("n_skolems", F.size(F.filter(X.entities(F.col("projection")), lambda x: x.startswith("skolem:"))))
    return rows.select(*PAIR, "bpos", F.col("expr").alias("base_fact"), "projection", "anchored", "entity_overlap", "n_skolems", F.round(F.lit(2.0) * F.col("anchored") + F.col("entity_overlap") - F.lit(float(skolem_penalty)) * F.col("n_skolems"), 3).alias("score"))


def confirmed(projected: DataFrame, target: DataFrame, ascension=None) -> DataFrame:
    """Add status: confirmed if a fact of the target matches the projection, with invented entities as wildcards for
    entities and functors under the lattice, else novel."""
    lattice = ascension_map(ascension)
    facts = target.select(F.col("name").alias("target"), X.match_key(F.col("expr"), lattice).alias("key"), X.leaves(F.col("expr")).alias("seen")).distinct()
    keyed = projected.withColumn("key", X.match_key(F.col("projection"), lattice)).withColumn("wanted", X.leaves(F.col("projection")))
    fits = F.forall(F.zip_with("wanted", "seen", lambda w, s: w.startswith("skolem:") | (w == s)), lambda x: x)
    hits = keyed.join(facts, ["target", "key"]).filter(fits).select(*PAIR, "bpos").distinct().withColumn("hit", F.lit(True))
    return keyed.drop("key", "wanted").join(hits, [*PAIR, "bpos"], "left").withColumn("status", F.when(F.col("hit"), "confirmed").otherwise("novel")).drop("hit")


def conjectures(base: DataFrame, target: DataFrame, ascension=None, pairs: DataFrame | None = None, skolem_penalty: float = 0.0) -> DataFrame:
    """inferences() of align(), confirmed(), in one pass over each pair, with ordinal i by falling score, text and position."""
    lattice, pos = lattice_of(ascension), base.schema["fact_pos"].dataType.simpleString()
    schema = f"base string, target string, bpos {pos}, base_fact string, projection string, anchored int, entity_overlap int, n_skolems int, score double, status string, i int"
    return _run(_beside(base, target, lattice, pairs), fold.conjectures, float(skolem_penalty), schema=schema)


def transfer(base: DataFrame, target: DataFrame, ascension=None, pairs: DataFrame | None = None) -> DataFrame:
    """Conjectures for each pair, with confidence (invented entities always count against it), status and ordinal i."""
    return conjectures(base, target, ascension, pairs, 1.0).withColumnRenamed("score", "confidence")


def novelty_report(maps: DataFrame, target: DataFrame) -> DataFrame:
    """coverage of the target's facts (one match covers all equal ones), novelty = 1 - coverage, and shortcut =
    coverage * matches / (mapped entities + matches), for each aligned pair."""
    held = target.filter("expr is not null").groupBy(F.col("name").alias("target")).agg(F.collect_list(F.struct("fact_pos", "expr")).alias("facts"))
    rows = maps.select(*PAIR, F.size("corrs").alias("m"), F.size("matched").alias("n"), F.col("matched.tpos").alias("hit")).join(held, "target")
    rows = rows.withColumn("known", F.transform(F.filter("facts", lambda f: F.array_contains("hit", f["fact_pos"].cast("int"))), lambda f: f["expr"]))
    out = rows.select(*PAIR, "m", "n", (F.size(F.filter("facts", lambda f: F.array_contains("known", f["expr"]))) / F.size("facts")).alias("cov"))
    return out.select(*PAIR, F.round("cov", 4).alias("coverage"), F.round(1 - F.col("cov"), 4).alias("novelty"), F.round(F.col("cov") * F.col("n") / (F.col("m") + F.col("n")), 4).alias("shortcut"))


def pair_coverage(maps: DataFrame, facts: DataFrame, of: str) -> DataFrame:
    """cov: the share of the facts of one side ("base" or "target") that are matched, each fact counted as often as
    it is both matched and stated."""
    matched = matched_facts(maps, facts, of).groupBy(*PAIR, "expr").count()
    stated = facts.groupBy(F.col("name").alias(of), "expr").agg(F.count("*").alias("times"))
    total = facts.groupBy(F.col("name").alias(of)).agg(F.count("*").alias("n"))
    hit = matched.join(stated, [of, "expr"]).groupBy(*PAIR).agg(F.sum(F.least("count", "times")).alias("hit"))
    return hit.join(total, of).select(*PAIR, "n", "hit", (F.col("hit") / F.col("n")).alias("cov"))


def residual(matched: DataFrame, facts: DataFrame, key: str = "target") -> DataFrame:
    """Facts left when each (key, expr, times) of matched takes that many equal facts away, first ones first."""
    from pyspark.sql import Window

    own = facts.select(F.col("name").alias(key), "fact_pos", "expr")
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(key, "expr").orderBy("fact_pos")))
    return own.join(matched, [key, "expr"], "left").filter("nth > coalesce(times, 0)").select(key, "fact_pos", "expr")
