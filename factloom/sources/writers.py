"""Writers of document bundles, property graphs, triples and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with sorted keys and without null fields."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))


def write_lines(df: DataFrame, line: Column, order: list, path: str) -> None:
    """One text line a row in the given order; a sort by range keeps the order over the files of a large table."""
    df.select(*[F.col(o) if isinstance(o, str) else o for o in order], line.alias("_line")).orderBy(*order).select("_line").write.mode("overwrite").text(path)


def write_bundle(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, folder: str) -> None:
    """nodes.jsonl in pre-order, edges.jsonl and metrics.json."""
    write_lines(nodes, canonical_json(nodes.drop("seq")), ["slug", "seq"], f"{folder}/nodes.jsonl")
    write_lines(edges, canonical_json(edges.drop("seq")), ["slug", "seq"], f"{folder}/edges.jsonl")
    write_lines(metrics, canonical_json(metrics), ["slug"], f"{folder}/metrics.json")


def save_graph(nodes: DataFrame, edges: DataFrame, nodes_path: str, edges_path: str) -> None:
    """Nodes by id and edges by key, so that equal graphs give equal files."""
    n, e = (d.drop("seq").withColumn("attrs", F.map_from_entries(F.array_sort(F.map_entries("attrs")))) for d in (nodes, edges))
    write_lines(n, canonical_json(n), ["id"], nodes_path)
    write_lines(e, canonical_json(e), ["src", "dst", "relation"], edges_path)


def write_ntriples(lines: DataFrame, path: str) -> None:
    """Lines of lift.ntriples in their order."""
    write_lines(lines, F.col("line"), ["slug", "part", "k1", "k2", "k3"], path)


def write_by_document(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("slug").json(path)


def json_schema(df: DataFrame) -> dict:
    return json.loads(df.schema.json())


def analogy_report(analogies: DataFrame, k: int = 12) -> DataFrame:
    """The k best analogies, each unordered pair once."""
    pair = analogies.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    best = pair.groupBy("lo", "hi").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "lo", "hi").limit(k)


def field_report(scores: DataFrame) -> DataFrame:
    """domain, n, mean and most novelty, and the most novel result, for (domain, result, novelty)."""
    return scores.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("novelty"), 4).alias("mean_novelty"), F.max("novelty").alias("max_novelty"), F.max_by("result", F.struct("novelty", "result")).alias("most_novel"))


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    rows = [df.columns, ["---"] * len(df.columns), *[[str(x) for x in r] for r in df.limit(limit).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def dashboard_model(got: dict[str, DataFrame], results: DataFrame, evaluations: DataFrame | None = None, shown: int = 200) -> dict:
    """What a page shows of pipeline.run: results by domain and size with novelty and parent, each unordered analogy once,
    counts of nodes and edges, verdicts. Results of a library are few; `shown` bounds each list."""
    parents = got["edges"].filter("relation = 'extends'").select(F.regexp_replace("src", "^result::", "").alias("result"), F.regexp_replace("dst", "^result::", "").alias("parent"))
    facts = got["edges"].filter("relation = 'asserts'").groupBy(F.regexp_replace("src", "^result::", "").alias("result")).agg(F.count("*").alias("n_facts"))
    rows = got["novelty"].join(results.select(F.col("name").alias("result"), "domain", F.substring("text", 1, 240).alias("text")), "result").join(parents, "result", "left").join(facts, "result", "left")
    rows = rows.select("result", "domain", "n_facts", "novelty", "nearest_prior", "parent", "text").orderBy("domain", "n_facts", "result").limit(shown)
    listed = lambda df: [r.asDict(recursive=True) for r in df.limit(shown).collect()]
    counts = {f"{k}:{r['name']}": r["n"] for k, col in (("nodes", "kind"), ("edges", "relation")) for r in got[k].groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n")).collect()}
    return {"results": listed(rows), "analogies": listed(analogy_report(got["analogies"], shown)), "counts": dict(sorted(counts.items())), "evaluations": listed(evaluations) if evaluations is not None else []}


def dashboard_page(model: dict, title: str = "Results and analogies") -> str:
    """The model as one HTML page of tables."""
    def cells(tag: str, values) -> str:
        return "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"

    def rows(items: list[dict]) -> str:
        return "<table>" + cells("th", items[0]) + "".join(cells("td", x.values()) for x in items) + "</table>" if items else "<p>none</p>"

    parts = [f"<h2>{name}</h2>" + rows(model[name]) for name in ("results", "analogies", "evaluations")]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>" + rows([{"what": k, "n": v} for k, v in model["counts"].items()]) + "".join(parts) + "</body></html>"
