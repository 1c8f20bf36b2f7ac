"""A run over documents as one job: what each step did with each document, and the views of the concept graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import checks, lift, markdown

STEP = ["slug", "id", "name", "principle", "status", "metrics"]


def _step(rows: DataFrame, number: str, name: str, principle: str, ok: Column, metrics: dict[str, Column]) -> DataFrame:
    m = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))])
    return rows.select("slug", F.lit(number).alias("id"), F.lit(name).alias("name"), F.lit(principle).alias("principle"), F.when(ok, "ok").otherwise("warn").alias("status"), m.alias("metrics"))


def trajectory(texts: DataFrame, decomposed: DataFrame, adapter: str, normalize: Callable[[Column], Column], min_ratio: float = 0.0) -> DataFrame:
    """slug, id, name, principle, status, metrics: the steps of each document, for texts (slug, text) and their decomposition.

    Normalization warns if a second pass changes its result, verification if a check fails. Documents are rows, so a null
    text counts as empty and an empty table has no steps."""
    n = checks.principles(texts.sparkSession, adapter).count()
    raw = texts.select("slug", F.coalesce("text", F.lit("")).alias("raw")).withColumn("once", normalize(F.col("raw")))
    found = checks.run_all(markdown.node_rows(decomposed), markdown.edge_rows(decomposed), decomposed.select("slug", F.col("n_chars").alias("length")), min_ratio)
    passed = found.groupBy(F.col("scope").alias("slug")).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))
    run = markdown.run_metrics(decomposed)
    yes = F.lit(True)
    out = _step(raw, "00", "extract_principles", "meta", yes, {"n_principles": F.lit(n)})
    out = out.unionByName(_step(raw, "10", "ingest", "P1", yes, {"bytes": F.octet_length("raw")}))
    idempotent = normalize(F.col("once")) == F.col("once")
    out = out.unionByName(_step(raw, "20", "normalize", "P2", idempotent, {"raw_chars": F.length("raw"), "normalized_chars": F.length("once"), "removed_chars": F.length("raw") - F.length("once")}))
    out = out.unionByName(_step(run, "30", "classify", "P3", yes, {"n_nodes": F.col("n_nodes"), "classified_ratio": F.col("classified_ratio")}))
    out = out.unionByName(_step(run, "40", "hierarchy", "P4", yes, {"max_depth": F.col("max_depth"), "n_edges": F.col("n_edges"), "n_edges_resolved": F.col("n_edges_resolved")}))
    return out.unionByName(_step(passed, "50", "verify", "P1-P5", F.col("n") == F.col("passed"), {"n_checks": F.col("n"), "n_passed": F.col("passed")}))


def views(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The nine views of the concept graphs lifted from documents, each with a slug."""
    concept, relation = lift.concepts(nodes).checkpoint(), lift.relations(nodes, edges).checkpoint()
    vector = lift.content_vector(concept, relation).withColumnRenamed("id", "slug")
    members = concept.groupBy("slug").agg(F.array_sort(F.collect_list("id")).alias("concepts")).join(relation.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("seq", "subject", "predicate", "object"))).alias("relations")), "slug", "left")
    return {
        "concepts": concept, "relations": relation, "triples": lift.triples(relation), "graph": members, "dgroup": lift.dgroup(concept, relation), "content_vector": vector,
        "ntriples": lift.ntriples(concept, relation), "metrics": lift.metrics(concept, relation), "verification": checks.run_concept_checks(concept, relation, edges).withColumnRenamed("scope", "slug"),
    }


def write_views(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Each view as JSON lines in a folder of its own, a part of it for each document."""
    for name, view in views(nodes, edges).items():
        view.write.mode("overwrite").partitionBy("slug").json(f"{folder}/{name}")
