"""The whole way from grounded results to one graph: lineage, analogies, conjectures, verdicts and novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import align as A
from factloom.operators import discover as D
from factloom.operators import graph as G
from factloom.operators import retrieve as R

#: The declared lattice of two literatures, where it isn't discovered.
ROLE_ASCENSION = {
    "EXCHANGEABLE": "STRUCTURAL_PREMISE", "WEIGHTED_EXCHANGEABLE": "STRUCTURAL_PREMISE", "COVERAGE": "GUARANTEE",
    "CONTRACTION": "STRUCTURAL_PREMISE", "STRONG_CONVEXITY_BOUND": "STRUCTURAL_PREMISE", "LINEAR_CONVERGENCE": "GUARANTEE",
}


def build(facts: DataFrame, results: DataFrame, groundings: DataFrame | None = None, lineage: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of results (name, text, domain) and their facts, with extends edges if lineage edges are given."""
    nodes, edges = G.reify(facts, groundings)
    nodes = nodes.unionByName(G.result_nodes(results, facts))
    if lineage is not None:
        edges = edges.unionByName(G.add_lineage(nodes, lineage))
    return nodes, edges


def within(results: DataFrame) -> DataFrame:
    """base, target: the pairs of different results of a domain."""
    d = results.select("name", "domain")
    both = d.select(F.col("name").alias("base"), "domain").join(d.select(F.col("name").alias("target"), "domain"), "domain")
    return both.filter("base <> target").select("base", "target")


def run(facts: DataFrame, results: DataFrame, evaluations: DataFrame | None = None, ascension=None, min_score: float = 3.0, tau: float = 0.5) -> dict[str, DataFrame]:
    """nodes, edges, analogies, conjectures, novelty and errors of results (name, pos, text, domain, domain_pos).

    Each domain's lineage becomes extends edges. Results of different domains are aligned under the lattice, by default
    the roles that CAUSE facts show; what either side of an analogy leaves over is projected onto the other as
    conjectures. Evaluations (source_base, source_target, projection, verdict, reasoning, seq) are written onto them,
    and the novelty against the best prior of all domains onto the results. errors are the violations of the schema.
    """
    facts, results = facts.checkpoint(), results.checkpoint()
    lattice = ascension if ascension is not None else D.discover_roles(facts)
    _, lineage = R.lineage(facts, tau, within(results))
    nodes, edges = build(facts, results, lineage=lineage)
    analogies = D.multidomain_analogies(facts, results, lattice, min_score).checkpoint()
    edges = edges.unionByName(G.add_analogies(nodes, analogies))
    ways = analogies.select(F.col("a").alias("base"), F.col("b").alias("target"))
    ways = ways.unionByName(ways.select(F.col("target").alias("base"), F.col("base").alias("target")))
    conjectures = A.transfer(facts, facts, lattice, ways).checkpoint()
    more, stated = G.add_conjectures(conjectures)
    if evaluations is not None:
        more = D.attach_verdicts(more, evaluations)
    novelty = R.result_novelty(facts, results.select(F.col("name").alias("id"), "pos")).checkpoint()
    nodes = G.annotate_novelty(nodes.unionByName(more.select(nodes.columns)), novelty).checkpoint()
    edges = edges.unionByName(stated).checkpoint()
    return {"nodes": nodes, "edges": edges, "analogies": analogies, "conjectures": conjectures, "novelty": novelty, "errors": G.validate(nodes, edges)}
