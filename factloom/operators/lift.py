"""Document structure to a concept graph: concepts, relations, exports and renaming invariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that a proof can prove or that a reference can rest on.
ASSERTED = ("theorem", "definition", "assumption", "remark", "problem_statement")
FORMAL = ("equation",)
NONE = "cast(map() as map<string,string>)"


def parent_id(node_id: Column) -> Column:
    return F.when(node_id.contains("/"), F.regexp_replace(node_id, "/[^/]+$", ""))


def concepts(nodes: DataFrame) -> DataFrame:
    """slug, id, kind, role, name, label, attributes, source_node for document nodes; a name is the first of title,
    label and the text's first 160 characters that isn't empty."""
    name = F.coalesce(F.nullif("title", F.lit("")), F.nullif("label", F.lit("")), F.nullif(F.substring("text", 1, 160), F.lit("")))
    attrs = F.transform_keys(F.coalesce("attrs", F.expr(NONE)), lambda k, v: F.concat(F.lit("x_"), k))
    return nodes.select("slug", "id", F.col("type").alias("kind"), "role", name.alias("name"), "label", attrs.alias("attributes"), F.col("id").alias("source_node"))


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """slug, seq, id, subject, predicate, object, resolved, higher_order, attributes, provenance.

    contains from each parent that is a concept; cites and refers_to with resolved recomputed against the concepts;
    proves from a proof to the nearest preceding sibling that asserts something; derives_from for each refers_to
    to a formal or asserted node. They are numbered in this order, within each in that of their source.
    """
    own = nodes.select("slug", "id", "seq", "type", "ord", parent_id(F.col("id")).alias("parent"))
    ids = nodes.select("slug", F.col("id").alias("cid"), F.col("type").alias("ctype"))
    none, yes = F.expr(NONE), F.lit(True)
    contains = own.join(ids, (own.slug == ids.slug) & (own.parent == ids.cid)).select(own.slug, F.lit(1).alias("phase"), "seq", F.lit("").alias("sub"), F.col("parent").alias("subject"), F.lit("contains").alias("predicate"), F.col("id").alias("object"), yes.alias("resolved"), F.lit(False).alias("higher_order"), none.alias("attributes"), F.col("id").alias("provenance"))
    refs = edges.filter(F.col("relation").isin("cites", "refers_to"))
    known = refs.join(ids, (refs.slug == ids.slug) & (refs.target == ids.cid), "left").withColumn("ok", F.coalesce(F.col("resolved"), F.lit(False)) & F.col("cid").isNotNull())
    attrs = F.map_concat(F.map_filter(F.coalesce("attrs", none), lambda k, v: k != "external"), F.create_map(F.lit("external"), F.when(F.col("ok"), "false").otherwise("true")))
    structural = known.select(refs.slug, F.lit(2).alias("phase"), "seq", F.lit("").alias("sub"), F.col("source").alias("subject"), F.col("relation").alias("predicate"), F.col("target").alias("object"), F.col("ok").alias("resolved"), F.lit(False).alias("higher_order"), attrs.alias("attributes"), refs.id.alias("provenance"))
    before = Window.partitionBy("slug", "parent").orderBy("ord", "seq").rowsBetween(Window.unboundedPreceding, -1)
    proofs = own.withColumn("proved", F.last(F.when(F.col("type").isin(*ASSERTED), F.col("id")), ignorenulls=True).over(before)).filter("type = 'proof' and proved is not null")
    proves = proofs.select("slug", F.lit(3).alias("phase"), "seq", F.coalesce("parent", F.lit("")).alias("sub"), F.col("id").alias("subject"), F.lit("proves").alias("predicate"), F.col("proved").alias("object"), yes.alias("resolved"), yes.alias("higher_order"), none.alias("attributes"), F.col("id").alias("provenance"))
    src = nodes.select(F.col("slug").alias("s2"), F.col("id").alias("sid"))
    rests = refs.filter("relation = 'refers_to'").join(ids.filter(F.col("ctype").isin(*ASSERTED, *FORMAL)), (refs.slug == ids.slug) & (refs.target == ids.cid)).drop(ids.slug).join(src, (F.col("slug") == F.col("s2")) & (F.col("source") == F.col("sid")), "left_semi")
    derives = rests.select("slug", F.lit(4).alias("phase"), "seq", F.lit("").alias("sub"), F.col("source").alias("subject"), F.lit("derives_from").alias("predicate"), F.col("target").alias("object"), yes.alias("resolved"), yes.alias("higher_order"), none.alias("attributes"), F.col("id").alias("provenance"))
    every = contains.unionByName(structural).unionByName(proves).unionByName(derives)
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("phase", "seq", "sub"))
    return every.withColumn("n", nth).select("slug", F.col("n").cast("long").alias("seq"), F.concat(F.lit("r."), F.col("n").cast("string")).alias("id"), "subject", "predicate", "object", "resolved", "higher_order", "attributes", "provenance")


def metrics(concept: DataFrame, relation: DataFrame) -> DataFrame:
    """slug, n_concepts, n_relations, n_reasoning_edges, n_resolved, predicate_counts, concept_kind_counts."""
    c = concept.groupBy("slug", "kind").count().groupBy("slug").agg(F.sum("count").alias("n_concepts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("concept_kind_counts"))
    r = relation.groupBy("slug", "predicate").agg(F.count("*").alias("count"), F.count_if("resolved").alias("res")).groupBy("slug").agg(F.sum("count").alias("n_relations"), F.sum(F.when(F.col("predicate").isin("derives_from", "proves"), F.col("count")).otherwise(0)).alias("n_reasoning_edges"), F.sum("res").alias("n_resolved"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "count")))).alias("predicate_counts"))
    return c.join(r, "slug", "left").fillna(0, ["n_relations", "n_reasoning_edges", "n_resolved"])


def dgroup(concept: DataFrame, relation: DataFrame) -> DataFrame:
    """slug, part (attribute, relation or higher_order), pred, args: the concept graph as predicates."""
    kind = F.regexp_replace(F.element_at("attributes", "x_kind"), '^"|"$', "")
    attr = F.explode(F.array_compact(F.array(F.col("kind"), F.concat(F.lit("role:"), F.col("role")), F.nullif(kind, F.lit("")))))
    a = concept.select("slug", F.lit("attribute").alias("part"), attr.alias("pred"), F.array("id").alias("args"))
    return a.unionByName(relation.select("slug", F.when(F.col("higher_order"), "higher_order").otherwise("relation").alias("part"), F.col("predicate").alias("pred"), F.array("subject", "object").alias("args")))


def content_vector(concept: DataFrame, relation: DataFrame) -> DataFrame:
    """id (slug), feature, cnt of attr:<kind>, role:<role> and rel:<predicate>."""
    c = concept.select("slug", F.explode(F.array(F.concat(F.lit("attr:"), F.col("kind")), F.concat(F.lit("role:"), F.col("role")))).alias("feature"))
    r = relation.select("slug", F.concat(F.lit("rel:"), F.col("predicate")).alias("feature"))
    return c.unionByName(r).groupBy(F.col("slug").alias("id"), "feature").agg(F.count("*").alias("cnt"))


def triples(relation: DataFrame) -> DataFrame:
    return relation.select("slug", "subject", "predicate", "object")


def ntriples(concept: DataFrame, relation: DataFrame, base: str = "op:") -> DataFrame:
    """slug, part, k1, k2, k3, line; ordered by these keys the lines are the export. Nothing is escaped."""
    def uri(c):
        return F.concat(F.lit(f"<{base}"), c, F.lit(">"))

    two = F.posexplode(F.array(F.concat(uri(F.col("id")), F.lit(f' <{base}kind> "'), F.col("kind"), F.lit('" .')), F.concat(uri(F.col("id")), F.lit(f' <{base}role> "'), F.col("role"), F.lit('" .')))).alias("at", "line")
    a = concept.select("slug", "id", two).select("slug", F.lit(0).alias("part"), F.col("id").alias("k1"), F.col("at").cast("string").alias("k2"), F.lit("").alias("k3"), "line")
    obj = F.when(F.col("resolved"), uri(F.col("object"))).otherwise(F.concat(F.lit('"'), F.col("object"), F.lit('"')))
    b = relation.select("slug", F.lit(1).alias("part"), F.col("subject").alias("k1"), F.col("predicate").alias("k2"), F.col("object").alias("k3"), F.concat(uri(F.col("subject")), F.lit(" "), uri(F.col("predicate")), F.lit(" "), obj, F.lit(" .")).alias("line"))
    return a.unionByName(b)


def canonical_names(concept: DataFrame) -> DataFrame:
    """slug, id, new: E0, E1, ... in the order of ids."""
    return concept.select("slug", "id").distinct().withColumn("new", F.concat(F.lit("E"), (F.row_number().over(Window.partitionBy("slug").orderBy("id")) - 1).cast("string")))


def relabel(concept: DataFrame, relation: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations with ids renamed by mapping (slug, id, new); others keep theirs."""
    c = concept.join(mapping, ["slug", "id"], "left").withColumn("id", F.coalesce("new", "id")).drop("new")
    r = relation
    for end in ("subject", "object"):
        r = r.join(mapping.select("slug", F.col("id").alias(end), "new"), ["slug", end], "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return c, r


def renaming_invariant(concept: DataFrame, relation: DataFrame) -> bool:
    """The content vector and the predicate multiset stay the same under canonical names."""
    c, r = relabel(concept, relation, canonical_names(concept))
    a, b = content_vector(concept, relation), content_vector(c, r)
    p, q = relation.groupBy("slug", "predicate").count(), r.groupBy("slug", "predicate").count()
    return not any(x.exceptAll(y).limit(1).count() for x, y in ((a, b), (b, a), (p, q), (q, p)))


def systematicity(relation: DataFrame, rounds: int = 200) -> DataFrame:
    """slug, n_higher_order_relations, max_reasoning_depth, systematicity_score = n * (1 + depth) of higher-order
    relations, which must have no cycle (checks.reasoning_acyclic). Depths grow by a step a round until none does."""
    ho = relation.filter("higher_order").select("slug", "subject", "object")
    n = ho.groupBy("slug").agg(F.count("*").alias("n"))
    depth = ho.select("slug", F.col("subject").alias("id")).distinct().withColumn("d", F.lit(1))
    last = None
    for _ in range(rounds):
        step = ho.join(depth.select("slug", F.col("id").alias("object"), "d"), ["slug", "object"]).groupBy("slug", F.col("subject").alias("id")).agg((F.max("d") + 1).alias("e"))
        depth = depth.join(step, ["slug", "id"], "left").select("slug", "id", F.greatest("d", F.coalesce("e", F.lit(0))).alias("d")).checkpoint()
        total = depth.agg(F.sum("d")).first()[0]
        if total == last:
            break
        last = total
    else:
        raise ValueError(f"systematicity: not settled in {rounds} rounds")
    deepest = depth.groupBy("slug").agg(F.max("d").alias("m"))
    return relation.select("slug").distinct().join(n, "slug", "left").join(deepest, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n_higher_order_relations"), F.coalesce("m", F.lit(0)).alias("max_reasoning_depth"), (F.coalesce("n", F.lit(0)) * (1 + F.coalesce("m", F.lit(0)))).alias("systematicity_score"))
