"""Retrieval of priors: sparse vectors, cosine and dot ranks, set cover, lineage, novelty, sign-hash index."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.operators import align as A


def functor_vectors(facts: DataFrame) -> DataFrame:
    """id, feature, cnt: how often each functor occurs in a result, nested ones counted again."""
    return facts.select(F.col("name").alias("id"), F.explode(X.functors(F.col("expr"))).alias("feature")).groupBy("id", "feature").agg(F.count("*").alias("cnt"))


def dots(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, dot of sparse vectors (id, feature, cnt) that share a feature."""
    l, r = left.select(F.col("id").alias("a"), "feature", F.col("cnt").alias("x")), right.select(F.col("id").alias("b"), "feature", F.col("cnt").alias("y"))
    return l.join(r, "feature").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("norm"))


def cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, cosine of those that share a feature; any other pair's cosine is 0."""
    n = dots(left, right).join(norms(left).select(F.col("id").alias("a"), F.col("norm").alias("na")), "a").join(norms(right).select(F.col("id").alias("b"), F.col("norm").alias("nb")), "b")
    return n.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def similarity_matrix(vectors: DataFrame) -> DataFrame:
    """a, b, similarity rounded to 4 places for all ordered pairs of ids, 0 where nothing is shared."""
    ids = vectors.select("id").distinct()
    every = ids.select(F.col("id").alias("a")).crossJoin(ids.select(F.col("id").alias("b")))  # a matrix over ids has all cells
    return every.join(cosines(vectors, vectors), ["a", "b"], "left").select("a", "b", F.round(F.coalesce("cosine", F.lit(0.0)), 4).alias("similarity"))


def rank_against(query: DataFrame, vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """a, b, score, rank: the other vectors by rounded dot product, ties by position (id, pos)."""
    every = query.select(F.col("id").alias("a")).distinct().join(positions.select(F.col("id").alias("b"), "pos"), F.lit(True)).filter("a <> b")
    scored = every.join(dots(query, vectors), ["a", "b"], "left").withColumn("score", F.round(F.coalesce("dot", F.lit(0)).cast("double"), 4))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "pos"))).select("a", "b", "score", "rank")


def verdict(novelty, coverage, prior, known: float = 0.15, extends: float = 0.6):
    """How a result stands to its nearest prior. The thresholds of a case study are 0.15 and 0.5."""
    return (
        F.when(coverage == 0, "distinct: no prior shares its structure")
        .when(novelty <= known, F.concat(F.lit("instance of "), prior))
        .when(novelty <= extends, F.concat(F.lit("extension of "), prior))
        .otherwise(F.concat(F.lit("largely novel; nearest is "), prior))
    )


def retrieve(target: DataFrame, library: DataFrame, positions: DataFrame, mac_k: int = 2) -> DataFrame:
    """target, prior, cosine, score, coverage, novelty, rank: the mac_k priors of highest cosine, aligned, by novelty.

    positions (id, pos) holds the order of the library, which breaks ties. Only the short list is aligned, so the
    first stage is a heuristic: a prior that shares no functor is ranked last. An empty library gives no rows.
    """
    ids = target.select(F.col("name").alias("target")).distinct()
    shown = cosines(functor_vectors(target), functor_vectors(library)).select(F.col("a").alias("target"), F.col("b").alias("base"), "cosine")
    place = positions.select(F.col("id").alias("base"), "pos")
    # priors that share nothing come in only where fewer than mac_k share something: the first 2 mac_k by position suffice
    few = ids.crossJoin(F.broadcast(place.orderBy("pos").limit(2 * mac_k))).join(shown, ["target", "base"], "left_anti")
    short = shown.join(place, "base").select("target", "base", "pos", "cosine").unionByName(few.select("target", "base", "pos", F.lit(0.0).alias("cosine")))
    short = short.withColumn("at", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("cosine"), "pos"))).filter(F.col("at") <= mac_k)
    maps = A.align(library, target, pairs=short.select("base", "target"))
    known = A.matched_facts(maps, target, "target").groupBy("base", "target").agg(F.collect_set("expr").alias("known"))
    facts = target.select(F.col("name").alias("target"), "expr")
    cov = known.join(facts, "target").groupBy("base", "target").agg(F.avg(F.array_contains("known", F.col("expr")).cast("double")).alias("coverage"))
    out = short.join(maps.select("base", "target", "score"), ["base", "target"], "left").join(cov, ["base", "target"], "left")
    out = out.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("novelty", 1 - F.col("coverage"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("novelty", "at"))
    return out.select("target", F.col("base").alias("prior"), F.round("cosine", 4).alias("cosine"), F.coalesce("score", F.lit(0.0)).alias("score"), F.round("coverage", 4).alias("coverage"), F.round("novelty", 4).alias("novelty"), rank.alias("rank"), verdict(F.col("novelty"), F.col("coverage"), F.col("base")).alias("verdict"))


def greedy_cover(covers: DataFrame, items: DataFrame, positions: DataFrame) -> tuple[list[tuple[str, int]], DataFrame]:
    """Priors picked one by one, each covering most of what is left (ties: first by position), and the items left.

    covers is (prior, item), items (item). The loop ends after as many rounds as priors are picked; each round is a
    join and a grouped count.
    """
    left, picked = items, []
    while True:
        gain = covers.join(left, "item").groupBy("prior").agg(F.countDistinct("item").alias("n")).join(positions.select(F.col("id").alias("prior"), "pos"), "prior")
        best = gain.orderBy(F.desc("n"), "pos").first()
        if best is None:
            return picked, left
        picked.append((best["prior"], best["n"]))
        left = left.join(covers.filter(F.col("prior") == best["prior"]).select("item"), "item", "left_anti")
        if len(picked) % 4 == 0:
            left = left.checkpoint()


def decompose(target: DataFrame, library: DataFrame, positions: DataFrame) -> dict:
    """The set cover of one target's facts (by position) by the priors that match them, and what no prior covers."""
    n = target.count()
    maps = A.align(library, target)
    known = A.matched_facts(maps, target, "target").select("base", "target", "expr").distinct()
    covers = known.join(target.select(F.col("name").alias("target"), "expr", F.col("fact_pos").alias("item")), ["target", "expr"]).select(F.col("base").alias("prior"), "item")
    picked, left = greedy_cover(covers, target.select(F.col("fact_pos").alias("item")), positions)
    rest = sorted(r[0] for r in left.join(target, F.col("item") == F.col("fact_pos")).select(X.fmt_expr(F.col("expr"))).collect())  # facts of one target
    return {
        "n_facts": n, "covering_priors": [p for p, _ in picked], "covers_n": [c for _, c in picked], "covered_facts": n - len(rest),
        "coverage_fraction": round((n - len(rest)) / n, 4) if n else 0.0, "residual_facts": rest, "novel_contributions": [r for r in rest if not r.startswith("CAUSE(")],
    }


def paper_run(target: DataFrame, library: DataFrame, positions: DataFrame) -> tuple[DataFrame, dict]:
    """One result against the whole library: all priors ranked, and its set cover."""
    return retrieve(target, library, positions, max(1, positions.count())), decompose(target, library, positions)


def lineage(facts: DataFrame, tau: float = 0.5, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ancestors, edges) among all results, or only for pairs (base, target). An ancestor has strictly fewer facts, of which at least tau recur in the child. The parent
    is the one with most facts, then highest reuse, then first name; a residual fact is one that the parent's matches,
    capped by how often the parent states a fact, leave over."""
    sizes = facts.groupBy("name").agg(F.count("*").alias("n_facts"))
    maps = A.align(facts, facts, pairs=pairs)
    cov = A.pair_coverage(maps, facts, "base").join(sizes.select(F.col("name").alias("target"), F.col("n_facts").alias("n_target")), "target")
    ancestors = cov.filter((F.col("n") < F.col("n_target")) & (F.col("cov") >= tau)).withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), F.desc("cov"), "base")))
    parent = ancestors.filter("rank = 1").select("base", "target", "cov", "n_target")
    stated = facts.groupBy(F.col("name").alias("base"), "expr").agg(F.count("*").alias("cap"))
    raw = A.matched_facts(maps.join(parent.select("base", "target"), ["base", "target"]), facts, "target").groupBy("base", "target", "expr").agg(F.count("*").alias("raw"))
    took = raw.join(stated, ["base", "expr"], "left").select("target", "expr", F.least("raw", F.coalesce("cap", F.lit(0))).alias("times"))
    left = A.residual(took, facts).join(parent.select("target"), "target").groupBy("target").agg(F.array_sort(F.collect_list(X.fmt_expr(F.col("expr")))).alias("residual"))
    edges = parent.join(left, "target", "left").withColumn("residual", F.coalesce("residual", F.expr("cast(array() as array<string>)")))
    edges = edges.select(
        F.col("target").alias("child"), F.col("base").alias("parent"), F.round("cov", 4).alias("parent_reuse"), F.round(F.size("residual") / F.col("n_target"), 4).alias("novelty"),
        "residual", F.filter("residual", lambda r: ~r.startswith("CAUSE(")).alias("novel_contributions"))
    return ancestors.select(F.col("target").alias("result"), F.col("base").alias("ancestor"), F.round("cov", 4).alias("reuse"), "rank"), edges


def lineage_order(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, depth: roots first, then by depth and name (order by these)."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_lineage_edges")
    names.createOrReplaceTempView("_lineage_names")
    return spark.sql("""with recursive d(name, depth) as (
        select name, 0 from _lineage_names where name not in (select child from _lineage_edges)
        union all select e.child, d.depth + 1 from d join _lineage_edges e on e.parent = d.name)
        select name, depth from d""")


def result_novelty(facts: DataFrame, positions: DataFrame) -> DataFrame:
    """result, nearest_prior, coverage, novelty, residual: the prior, of no more facts, that explains most; first by
    position among equals. Without one the result is a root of novelty 1. Matches take facts away uncapped."""
    sizes = facts.groupBy("name").agg(F.count("*").alias("n_facts"))
    maps = A.align(facts, facts)
    cov = A.pair_coverage(maps, facts, "target").join(sizes.select(F.col("name").alias("base"), F.col("n_facts").alias("n_base")), "base").join(positions.select(F.col("id").alias("base"), "pos"), "base")
    best = cov.filter("n_base <= n and cov > 0").withColumn("at", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("cov"), "pos"))).filter("at = 1").select("base", "target", "cov")
    took = A.matched_facts(maps.join(best.select("base", "target"), ["base", "target"]), facts, "target").groupBy("target", "expr").agg(F.count("*").alias("times"))
    left = A.residual(took, facts).groupBy("target").agg(F.array_sort(F.collect_list(X.fmt_expr(F.col("expr")))).alias("residual"))
    out = sizes.select(F.col("name").alias("target")).join(best, "target", "left").join(left, "target", "left")
    return out.select(F.col("target").alias("result"), F.col("base").alias("nearest_prior"), F.round(F.coalesce("cov", F.lit(0.0)), 4).alias("coverage"), F.round(1 - F.coalesce("cov", F.lit(0.0)), 4).alias("novelty"), F.coalesce("residual", F.expr("cast(array() as array<string>)")).alias("residual"))


class SignIndex:
    """Signs of products with random +-1 planes as a bit signature; near signatures are candidates, then exact cosine."""

    def __init__(self, vectors: DataFrame, n_planes: int = 16, seed: int = 0, features: list[str] | None = None) -> None:
        """features: the vocabulary, sorted; by default that of vectors, which is a set of names and fits the driver."""
        vocab = features or sorted(r["feature"] for r in vectors.select("feature").distinct().collect())
        draw = random.Random(seed)
        self.n_planes = n_planes
        rows = [(p, f, draw.choice((-1, 1))) for p in range(n_planes) for f in vocab]
        self.planes = vectors.sparkSession.createDataFrame(rows, "plane int, feature string, sign int")
        self.vectors = vectors
        self.signed = self.signatures(vectors)

    def signatures(self, vectors: DataFrame) -> DataFrame:
        """id, sig: bit p is set if the product with plane p is not negative; unknown features count nothing."""
        ids = vectors.select("id").distinct()
        planes = self.planes.select("plane").distinct()
        sums = vectors.join(self.planes, "feature").groupBy("id", "plane").agg(F.sum(F.col("cnt") * F.col("sign")).alias("s"))
        every = ids.join(planes, F.lit(True)).join(sums, ["id", "plane"], "left")
        return every.groupBy("id").agg(F.sum(F.when(F.coalesce("s", F.lit(0)) >= 0, F.expr("shiftleft(1L, plane)")).otherwise(F.lit(0))).alias("sig"))

    def query(self, queries: DataFrame, top_k: int = 2, max_hamming: int = 2) -> DataFrame:
        """a, b, cosine, rank and the fraction of the library examined. A query without any candidate is held against
        the whole library. Masks of up to max_hamming bits make the neighbourhood an equi-join."""
        masks, level = {0}, {0}
        for _ in range(max_hamming):
            level = {m | 1 << p for m in level for p in range(self.n_planes) if not m >> p & 1}
            masks |= level
        flips = F.explode(F.array(*[F.lit(m).cast("long") for m in sorted(masks)]))
        q = self.signatures(queries).select(F.col("id").alias("a"), "sig", flips.alias("m")).select("a", F.expr("sig ^ m").alias("sig"))
        own = self.signed.select(F.col("id").alias("b"), "sig")
        near = q.join(own, "sig").select("a", "b")
        lone = queries.select(F.col("id").alias("a")).distinct().join(near, "a", "left_anti")
        near = near.unionByName(lone.join(own.select("b"), F.lit(True)))
        total = self.vectors.select("id").distinct().count()
        seen = near.groupBy("a").agg(F.round(F.count("*") / max(1, total), 4).alias("fraction"))
        scored = near.join(cosines(queries, self.vectors), ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= top_k).join(seen, "a").select("a", "b", F.round("cosine", 4).alias("cosine"), "rank", "fraction")


def linear_top_k(queries: DataFrame, vectors: DataFrame, top_k: int = 2) -> DataFrame:
    """The exact baseline: a, b, cosine, rank over all vectors that share a feature with the query."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return cosines(queries, vectors).withColumn("rank", rank).filter(F.col("rank") <= top_k).select("a", "b", F.round("cosine", 4).alias("cosine"), "rank")


def synthetic_vectors(spark, n: int, seed: int = 1) -> DataFrame:
    """id, feature, cnt: n vectors over 40 features with 3 to 8 draws of counts 1 to 4."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        v: dict[str, int] = {}
        for _ in range(draw.randint(3, 8)):
            v[f"F{draw.randint(0, 39)}"] = draw.randint(1, 4)
        rows += [(f"syn{i}", f, c) for f, c in sorted(v.items())]
    return spark.createDataFrame(rows, "id string, feature string, cnt long")
