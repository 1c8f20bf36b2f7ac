"""Grounding of symbols in text, and solving a blank by analogy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.functions import text as T
from factloom.operators import align as A
from factloom.operators import retrieve as R


def check_sections(sections: DataFrame) -> DataFrame:
    """name, ok, ungrounded, missing for sections (name, text, groundings, facts): groundings that are blank or not a
    part of the text, and entities in facts without one, sorted."""
    bad = F.map_keys(F.map_filter("groundings", lambda k, v: (F.coalesce(F.trim(v), F.lit("")) == "") | ~F.contains("text", v)))
    used = F.array_distinct(F.flatten(F.transform("facts", X.entities)))
    missing = F.array_except(used, F.map_keys("groundings"))
    out = sections.select("name", F.array_sort(bad).alias("ungrounded"), F.array_sort(missing).alias("missing"))
    return out.select("name", ((F.size("ungrounded") == 0) & (F.size("missing") == 0)).alias("ok"), "ungrounded", "missing")


def all_grounded(sections: DataFrame) -> bool:
    return bool(check_sections(sections).agg(F.coalesce(F.bool_and("ok"), F.lit(True))).first()[0])


def entities_in_facts(facts: DataFrame) -> DataFrame:
    return facts.select("name", F.explode(X.entities(F.col("expr"))).alias("entity")).distinct()


def solve(riddles: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The blank of each target, for riddles (base, target, answer_symbol, blank_symbol, groundings of the target).

    The first DIVIDES or EQUALS fact of the target that holds the blank defines it: total by count, as a whole number
    where that is exact, or the other side. The map must take the answer's symbol to the blank.
    """
    maps = A.align(source, target, pairs=riddles.select("base", "target")).select("base", "target", "score", "corrs")
    facts = target.select(F.col("name").alias("target"), "fact_pos", "expr").join(riddles.select("target", "blank_symbol"), "target")
    rel = X.functor(F.col("expr"))
    facts = facts.filter(rel.isin("DIVIDES", "EQUALS") & F.array_contains(X.leaves(F.col("expr")), F.col("blank_symbol")))
    first = facts.withColumn("at", F.row_number().over(Window.partitionBy("target").orderBy("fact_pos"))).filter("at = 1").select("target", rel.alias("relation"), X.leaves(F.col("expr")).alias("l"))
    rows = riddles.join(maps, ["base", "target"], "left").join(first, "target", "left")
    other = F.when(F.col("l")[0] == F.col("blank_symbol"), F.col("l")[1]).otherwise(F.col("l")[0])
    total = F.when(F.col("relation") == "DIVIDES", F.col("l")[0]).otherwise(other)
    rows = rows.withColumn("total", total).withColumn("tg", F.element_at("groundings", F.col("total"))).withColumn("cg", F.element_at("groundings", F.element_at("l", 2)))
    n, c = T.first_int(F.col("tg")), T.first_int(F.col("cg"))
    value = F.when((F.col("relation") == "DIVIDES") & (c != 0), n.cast("double") / c).when(F.col("relation") == "EQUALS", n.cast("double"))
    mapped = F.element_at(F.filter("corrs", lambda p: p["b"] == F.col("answer_symbol")), 1)["t"]
    divides = F.concat(F.col("blank_symbol"), F.lit(" = "), F.col("l")[0], F.lit(" ÷ "), F.col("l")[1])
    equals = F.concat(F.col("blank_symbol"), F.lit(" = "), F.col("total"), F.lit(" (the whole total, undivided)"))
    rows = rows.withColumn("mapped_to", F.when(F.size("corrs") > 0, F.get(F.filter("corrs", lambda p: p["b"] == F.col("answer_symbol")), F.lit(0))["t"])).withColumn("value", value)
    return rows.select(
        "base", "target", F.coalesce("score", F.lit(0.0)).alias("structural_score"), "mapped_to", F.coalesce(F.col("mapped_to") == F.col("blank_symbol"), F.lit(False)).alias("answer_maps_to_blank"),
        F.col("relation").alias("blank_defining_relation"), F.when(F.col("relation") == "DIVIDES", divides).when(F.col("relation") == "EQUALS", equals).alias("structural_answer"),
        F.when(F.col("value").isNotNull(), T.fmt_quantity(F.col("value"), T.unit_of(F.col("tg")))).alias("numeric_answer"))


def run_case(base: DataFrame, target: DataFrame) -> DataFrame:
    """Score, coverage, novelty, shortcut, verdict and novel facts of targets against one base."""
    maps = A.align(base, target)
    report = A.novelty_report(maps, target)
    known = A.matched_facts(maps, target, "target").groupBy("base", "target").agg(F.collect_set("expr").alias("known"))
    novel = known.join(target.select(F.col("name").alias("target"), "fact_pos", "expr"), "target").filter(~F.array_contains("known", F.col("expr")))
    novel = novel.groupBy("base", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_pos", X.fmt_expr(F.col("expr")).alias("e")))), lambda x: x["e"]).alias("novel_facts"))
    out = maps.select("base", "target", "score").join(report, ["base", "target"]).join(novel, ["base", "target"], "left")
    return out.withColumn("verdict", R.verdict(F.col("novelty"), F.col("coverage"), F.col("base"), extends=0.5))


def discrimination(base: DataFrame, instance: DataFrame, distinct: DataFrame) -> dict:
    """Novelty of a known instance and of a distinct result against a base, and whether they are told apart."""
    def novelty(target: DataFrame) -> float:
        row = A.novelty_report(A.align(base, target), target).first()
        return row["novelty"] if row else 1.0

    low, high = novelty(instance), novelty(distinct)
    return {"instance_novelty": low, "distinct_novelty": high, "margin": round(high - low, 4), "discriminates": low <= 0.15 and high >= 0.6}
