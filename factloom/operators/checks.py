"""Invariant checks: each gives rows (scope, name, passed, metrics, detail), none raises."""

from __future__ import annotations

import difflib
import html as _html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import ROLES

#: Predicates of concept relations.
PREDICATES = ("contains", "cites", "refers_to", "proves", "derives_from")
CHECK = "scope string, name string, passed boolean, metrics map<string,double>, detail string"


def _row(df: DataFrame, name: str, passed: Column, metrics: dict[str, Column], detail: Column | None = None) -> DataFrame:
    m = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]) if metrics else F.expr("cast(map() as map<string,double>)")
    return df.select(F.col("slug").alias("scope"), F.lit(name).alias("name"), passed.alias("passed"), m.alias("metrics"), (detail if detail is not None else F.lit("")).alias("detail"))


def _none_left(every: DataFrame, bad: DataFrame, name: str, what: Column) -> DataFrame:
    """Passed for each slug of every that has no row in bad."""
    counted = bad.groupBy("slug").agg(F.count("*").alias("bad"), F.min(what).alias("example"))
    rows = every.select("slug").distinct().join(counted, "slug", "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    return _row(rows, name, F.col("bad") == 0, {"violations": F.col("bad")}, F.coalesce("example", F.lit("")))


def schema_valid(nodes: DataFrame) -> DataFrame:
    """Ids, known types and roles, depth and order not negative."""
    types = [t for v in ROLES.values() for t in v]
    ok = F.col("id").isNotNull() & F.col("type").isin(types) & F.col("role").isin(list(ROLES)) & (F.col("depth") >= 0) & (F.col("ord") >= 0)
    return _none_left(nodes, nodes.filter(~F.coalesce(ok, F.lit(False))), "schema_valid", F.col("id"))


def unique_ids(nodes: DataFrame) -> DataFrame:
    return _none_left(nodes, nodes.groupBy("slug", "id").count().filter("count > 1"), "unique_ids", F.col("id"))


def acyclic_tree(nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """Every node is reached once from the roots (no parent). Levels go down one a round until nothing is new."""
    own = nodes.select("slug", "id", "parent_id")
    twice = own.groupBy("slug", "id").agg(F.count_distinct("parent_id").alias("p"), F.count("*").alias("c")).filter("p > 1 or c > 1").select("slug", "id")
    seen = own.filter("parent_id is null").select("slug", "id").distinct()
    level = seen
    for _ in range(rounds):
        level = own.join(level.select("slug", F.col("id").alias("parent_id")), ["slug", "parent_id"]).select("slug", "id").distinct().join(seen, ["slug", "id"], "left_anti").checkpoint()
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    else:
        raise ValueError(f"acyclic_tree: not settled in {rounds} rounds")
    lost = own.select("slug", "id").distinct().join(seen, ["slug", "id"], "left_anti")
    return _none_left(nodes, lost.unionByName(twice), "acyclic_tree", F.col("id"))


def leaf_spans(nodes: DataFrame) -> DataFrame:
    """slug, id, start, end of nodes that no node has as its parent and whose span isn't empty."""
    parents = nodes.select("slug", F.col("parent_id").alias("id")).filter("id is not null").distinct()
    return nodes.join(parents, ["slug", "id"], "left_anti").filter("span.end > span.start").select("slug", "id", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def sweep(spans: DataFrame, by: list[str]) -> DataFrame:
    """by, covered, overlap: spans in order of start, each against the furthest end before it."""
    before = Window.partitionBy(*by).orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("prev", F.coalesce(F.max("end").over(before), F.lit(0)))
    return rows.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "prev"))).alias("covered"), F.sum(F.greatest(F.lit(0), F.least("end", "prev") - F.col("start"))).alias("overlap"))


def character_coverage(nodes: DataFrame, lengths: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Leaves must not overlap and cover at least min_ratio of the text, for lengths (slug, length)."""
    rows = lengths.join(sweep(leaf_spans(nodes), ["slug"]), "slug", "left").fillna(0, ["covered", "overlap"])
    ratio = F.coalesce(F.col("covered") / F.nullif("length", F.lit(0)), F.lit(0.0))
    return _row(rows, "character_coverage", (F.col("overlap") == 0) & (ratio >= min_ratio), {"covered": F.col("covered"), "overlap": F.col("overlap"), "ratio": F.round(ratio, 4)})


def reference_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets of edges that aren't external are ids or labels of nodes."""
    inner = edges.filter(F.coalesce(F.element_at("attrs", "external"), F.lit("false")) != "true")
    known = nodes.select("slug", F.col("id").alias("target")).unionByName(nodes.filter("label is not null").select("slug", F.col("label").alias("target"))).distinct()
    return _none_left(nodes, inner.join(known, ["slug", "target"], "left_anti"), "reference_integrity", F.col("target"))


def idempotent(texts: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """slug, passed: normalizing a second time changes nothing, for texts (slug, text)."""
    rows = texts.withColumn("once", normalize(F.col("text")))
    return _row(rows, "idempotent", normalize(F.col("once")).eqNullSafe(F.col("once")), {"length": F.length("once")})


def edge_conservation(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Each citing or referring edge of the document is the provenance of a relation."""
    own = edges.filter(F.col("relation").isin("cites", "refers_to"))
    return _none_left(edges, own.join(relations.select("slug", F.col("provenance").alias("id")), ["slug", "id"], "left_anti"), "edge_conservation", F.col("id"))


def traceability(concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """Subjects are concepts; objects are concepts or external."""
    ids = concepts.select("slug", F.col("id").alias("x")).distinct()
    subj = relations.join(ids.withColumnRenamed("x", "subject"), ["slug", "subject"], "left_anti").select("slug", "id")
    inner = relations.filter(F.coalesce(F.element_at("attributes", "external"), F.lit("false")) != "true")
    obj = inner.join(ids.withColumnRenamed("x", "object"), ["slug", "object"], "left_anti").select("slug", "id")
    return _none_left(concepts, subj.unionByName(obj), "traceability", F.col("id"))


def reasoning_acyclic(relations: DataFrame, rounds: int = 500) -> DataFrame:
    """Higher-order relations have no cycle: nodes without outgoing ones are stripped until nothing changes."""
    left = relations.filter("higher_order").select("slug", "subject", "object").distinct()
    n = left.count()
    for _ in range(rounds):
        left = left.join(left.select("slug", F.col("subject").alias("object")).distinct(), ["slug", "object"], "left_semi").checkpoint()
        m = left.count()
        if m == n or not m:
            break
        n = m
    else:
        raise ValueError(f"reasoning_acyclic: not settled in {rounds} rounds")
    return _none_left(relations, left, "reasoning_dag_acyclic", F.col("subject"))


def concept_schema_valid(concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """Concepts have an id, a known kind and role and a source, relations an id, both ends and a known predicate."""
    types = [t for v in ROLES.values() for t in v]
    known = F.col("id").isNotNull() & F.col("kind").isin(types) & F.col("role").isin(list(ROLES)) & F.col("source_node").isNotNull()
    said = F.col("id").isNotNull() & F.col("subject").isNotNull() & F.col("object").isNotNull() & F.col("predicate").isin(list(PREDICATES))
    bad = concepts.filter(~F.coalesce(known, F.lit(False))).select("slug", "id").unionByName(relations.filter(~F.coalesce(said, F.lit(False))).select("slug", "id"))
    return _none_left(concepts, bad, "concept_schema_valid", F.col("id"))


def run_all(nodes: DataFrame, edges: DataFrame, lengths: DataFrame, min_ratio: float = 0.5, texts: DataFrame | None = None, normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """All checks of documents; with their texts (slug, text) and normalization also that a second pass changes nothing."""
    out = schema_valid(nodes)
    for x in (unique_ids(nodes), acyclic_tree(nodes), character_coverage(nodes, lengths, min_ratio), reference_integrity(nodes, edges)):
        out = out.unionByName(x)
    return out.unionByName(idempotent(texts, normalize)) if texts is not None and normalize is not None else out


def run_concept_checks(concepts: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    out = concept_schema_valid(concepts, relations)
    for x in (edge_conservation(relations, edges), traceability(concepts, relations), reasoning_acyclic(relations)):
        out = out.unionByName(x)
    return out


def principles(spark: SparkSession, adapter: str) -> DataFrame:
    """principle, question, conserved, target, verifier: what is to be conserved by a decomposition, and which check sees to
    it. The last row is that of the adapter's kind of document."""
    rows = [
        ("P1", "what must be conserved?", "characters of the normalized text", "each belongs to one leaf, none to two", "character_coverage"),
        ("P2", "what is redundant?", "content up to presentation", "what goes is logged, a second pass changes nothing", "idempotent"),
        ("P3", "which classes recur?", "the inventory of types and roles", "few plain blocks are left", "schema_valid"),
        ("P4", "what is the hierarchy?", "containment and references", "one tree without cycles, no dangling reference", "acyclic_tree, unique_ids, reference_integrity"),
    ]
    papers = ("P5", "papers and exams", "statements apart from answers, entries of the bibliography", "subtrees of their own, one node for each entry", "compare_sections")
    prose = ("P5", "prose and forms", "fields of forms, source and target of analogies", "one metadata field for each key, both analogs in an example", "run_metrics")
    return spark.createDataFrame([*rows, papers if adapter in ("latex", "html") else prose], "principle string, question string, conserved string, target string, verifier string")


_HEADING = re.compile(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>")
_TAGGED = re.compile(r'(?is)<span\b[^>]*class="[^"]*\bltx_tag\b[^"]*"[^>]*>.*?</span>')


def section_titles(page: str | None) -> list[str]:
    """Visible titles of a page's headings, without number tags and without reporting links."""
    found = []
    for m in _HEADING.finditer(page or ""):
        t = re.sub(r"\s+", " ", _html.unescape(re.sub(r"<[^>]*>", "", _TAGGED.sub("", m[1])))).strip()
        if t and not t.lower().startswith("report issue"):
            found.append(t)
    return found


def theorem_count(page: str | None) -> int:
    return len(re.findall(r'(?i)class="[^"]*\bltx_theorem\b', page or ""))


def same_title(a: str, b: str, ratio: float = 0.8) -> bool:
    a, b = (re.sub(r"[^a-z0-9]+", " ", x.lower()).strip() for x in (a, b))
    return difflib.SequenceMatcher(None, a, b).ratio() > ratio


def compare_sections(titles: DataFrame) -> DataFrame:
    """slug, n, matched, recall for (slug, ours, theirs): the share of our titles like any of theirs. One document's
    titles are compared pairwise, so rows are independent."""
    def run(batches):
        for pdf in batches:
            hit = [sum(any(same_title(x, y) for y in b) for x in a) for a, b in zip(pdf["ours"], pdf["theirs"], strict=True)]
            n = [len(a) for a in pdf["ours"]]
            yield pd.DataFrame({"slug": pdf["slug"], "n": n, "matched": hit, "recall": [round(h / k, 4) if k else 1.0 for h, k in zip(hit, n, strict=True)]})

    empty = F.expr("cast(array() as array<string>)")
    return titles.select("slug", F.coalesce("ours", empty).alias("ours"), F.coalesce("theirs", empty).alias("theirs")).mapInPandas(run, "slug string, n long, matched long, recall double")
