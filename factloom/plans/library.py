"""Queries that run the retrieval, grounding, discovery and graph operators over nations as results.

A nation's result states the types of the parts that it ships (S) or orders (C) in undiscounted lines of quantity 50: one fact
["<type>","<nation>"] for each type. Facts of two results match where the types are equal, and the map always takes
one nation to the other, so that shared types give all scores in SQL.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import checks as K
from factloom.operators import discover as D
from factloom.operators import graph as G
from factloom.operators import graphquery as GQ
from factloom.operators import ground, pipeline
from factloom.operators import lift as L
from factloom.operators import retrieve as R
from factloom.plans.common import table

Q, SQL = {}, {}
#: The vocabulary of part types.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _stated(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """id, nation, pos, region, feature for each line of a side's results."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_discount = 0").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    if side == "S":
        at = lines.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).withColumnRenamed("s_nationkey", "n_nationkey")
    else:
        orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        at = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).withColumnRenamed("c_nationkey", "n_nationkey")
    named = at.join(F.broadcast(table(spark, sf_dir, "nation")), "n_nationkey")
    return named.select(F.concat(F.lit(f"{side}:"), F.col("n_name")).alias("id"), F.col("n_name").alias("nation"), F.col("n_nationkey").alias("pos"), F.col("n_regionkey").alias("region"), F.col("p_type").alias("feature"))


def _facts(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """name, fact_pos, expr; a few facts for each of the nations."""
    rows = _stated(spark, sf_dir, side).distinct().withColumn("fact_pos", F.row_number().over(Window.partitionBy("id").orderBy("feature")) - 1)
    expr = F.concat(F.lit('["'), F.col("feature"), F.lit('","'), F.col("nation"), F.lit('"]'))
    return rows.select(F.col("id").alias("name"), "fact_pos", expr.alias("expr")).checkpoint()


def _vectors(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """How often a side's results state each type, with repeats."""
    expr = F.concat(F.lit('["'), F.col("feature"), F.lit('","'), F.col("nation"), F.lit('"]'))
    return R.functor_vectors(_stated(spark, sf_dir, side).select(F.col("id").alias("name"), expr.alias("expr"))).checkpoint()


def _positions(spark: SparkSession, sf_dir: str, side: str = "S") -> DataFrame:
    return _stated(spark, sf_dir, side).select("id", "pos").distinct()


NATIONS = """big as (select l_orderkey, l_suppkey, p_type as f from lineitem join part on p_partkey = l_partkey where l_quantity = 50 and l_discount = 0),
sl as (select 'S:' || n_name as id, n_name as e, n_nationkey as pos, n_regionkey as region, f from big join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
cl as (select 'C:' || n_name as id, n_name as e, n_nationkey as pos, n_regionkey as region, f from big join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
s as (select id, e, pos, region, list(distinct f order by f) as fs, count(distinct f) as n from sl group by all), c as (select id, e, pos, region, list(distinct f order by f) as fs, count(distinct f) as n from cl group by all),
sv as (select id, f, count(*) as x from sl group by all), cv as (select id, f, count(*) as x from cl group by all)"""


def _verdict_sql(extends: float) -> str:
    return f"case when coverage = 0 then 'distinct: no prior shares its structure' when novelty <= 0.15 then 'instance of ' || prior when novelty <= {extends} then 'extension of ' || prior else 'largely novel; nearest is ' || prior end"


@query(f"with {NATIONS} select id, f as feature, x as cnt from sv union all select id, f, x from cv")
def nation_functors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each result states each functor."""
    return _vectors(spark, sf_dir, "S").unionByName(_vectors(spark, sf_dir, "C"))


@query(f"""with {NATIONS}, p as (select distinct id, pos from sl), d as (select a.id as a, b.id as b, sum(a.x * b.x) as dot from sv a join sv b using (f) group by all)
select p.id as a, q.id as b, coalesce(dot, 0)::double as score, row_number() over (partition by p.id order by coalesce(dot, 0) desc, q.pos)::int as rank from p join p q on p.id <> q.id left join d on d.a = p.id and d.b = q.id""")
def nation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipping results by dot product with each of them."""
    v = _vectors(spark, sf_dir, "S")
    return R.rank_against(v, v, _positions(spark, sf_dir))


@query(f"""with {NATIONS}, sh as (select c.id as target, s.id as prior, s.pos, len(list_intersect(c.fs, s.fs)) as k, c.n as cn, s.n as sn from c, s),
r as (select *, k / (sqrt(cn) * sqrt(sn)) as cosine, row_number() over (partition by target order by k / (sqrt(cn) * sqrt(sn)) desc, pos) as nth from sh),
t as (select *, k / cn as coverage, 1 - k / cn as novelty from r where nth <= 2)
select target, prior, round(cosine, 4) as cosine, 2.0::double * k as score, round(coverage, 4) as coverage, round(novelty, 4) as novelty, row_number() over (partition by target order by novelty, nth)::int as rank, {_verdict_sql(0.6)} as verdict from t""")
def nation_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each ordering result the two shipping results of highest cosine, aligned, by novelty."""
    return R.retrieve(_facts(spark, sf_dir, "C"), _facts(spark, sf_dir, "S"), _positions(spark, sf_dir))


@query(f"""with {NATIONS}, sh as (select s.id as base, c.id as target, c.e, len(list_intersect(c.fs, s.fs)) as k, c.n as cn, list_filter(c.fs, lambda f: not list_contains(s.fs, f)) as rest from c, s),
t as (select *, base as prior, round(k / cn, 4) as coverage, round(1 - k / cn, 4) as novelty from sh where k > 0)
select base, target, 2.0::double * k as score, coverage, novelty, round(k / cn * k / (1 + k), 4) as shortcut, {_verdict_sql(0.5)} as verdict, array_to_string(list_transform(rest, lambda f: f || '(' || e || ')'), '; ') as novel_facts from t""")
def nation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipping result against every ordering one as a case study."""
    out = ground.run_case(_facts(spark, sf_dir, "S"), _facts(spark, sf_dir, "C"))
    return out.select("base", "target", "score", "coverage", "novelty", "shortcut", "verdict", F.coalesce(F.array_join("novel_facts", "; "), F.lit("")).alias("novel_facts"))


def _decompose_sql() -> str:
    parts = [f"with {NATIONS}, q0 as (select list(distinct f order by f) as left_ from cl)"]
    for i in range(1, len(TYPES) + 1):
        parts.append(f"k{i} as (select id, fs, len(list_intersect(fs, left_)) as n from s, q{i - 1} where len(list_intersect(fs, left_)) > 0 order by n desc, pos limit 1)")
        parts.append(f"q{i} as (select list_filter(left_, lambda f: not list_contains(coalesce(k{i}.fs, []), f)) as left_ from q{i - 1} left join k{i} on true)")
    return ",\n".join(parts) + " " + " union all ".join(f"select {i}::int as round, id as prior, n::bigint as n_covered from k{i}" for i in range(1, len(TYPES) + 1))


def nation_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy cover of all types that are ordered by the results that ship them."""
    every = _stated(spark, sf_dir, "C").select("feature").distinct().withColumn("fact_pos", F.row_number().over(Window.partitionBy(F.length("feature") * 0).orderBy("feature")) - 1)  # a few types
    target = every.select(F.lit("all").alias("name"), "fact_pos", F.concat(F.lit('["'), F.col("feature"), F.lit('","all"]')).alias("expr")).checkpoint()
    got = R.decompose(target, _facts(spark, sf_dir, "S"), _positions(spark, sf_dir))
    rows = [(i, p, n) for i, (p, n) in enumerate(zip(got["covering_priors"], got["covers_n"], strict=True), 1)]
    return spark.createDataFrame(rows, "round int, prior string, n_covered long")


Q["nation_decompose"], SQL["nation_decompose"] = nation_decompose, _decompose_sql()

LINEAGE = """pr as (select t.id as child, b.id as parent, t.e, b.e as be, t.fs, b.fs as bfs, t.n as tn, b.n as bn, len(list_intersect(t.fs, b.fs)) as k, t.region, b.region as bregion from s t join s b on b.id <> t.id),
anc as (select *, row_number() over (partition by child order by bn desc, k / bn desc, parent) as rank from pr where bn < tn and k / bn >= 0.5),
lin as (select child, parent, round(k / bn, 4) as parent_reuse, round(len(list_filter(fs, lambda f: not (list_contains(bfs, f) and e = be))) / tn, 4) as novelty, array_to_string(list_transform(list_filter(fs, lambda f: not (list_contains(bfs, f) and e = be)), lambda f: f || '(' || e || ')'), '; ') as residual from anc where rank = 1)"""


@query(f"with {NATIONS}, {LINEAGE} select * from lin")
def nation_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipping result with the largest smaller one of which at least half recurs in it. What is left over counts equal
    facts only, and the parent's are about another nation."""
    return R.lineage(_facts(spark, sf_dir, "S"))[1].select("child", "parent", "parent_reuse", "novelty", F.array_join("residual", "; ").alias("residual"))


@query(f"with {NATIONS}, {LINEAGE} select child as result, parent as ancestor, round(k / bn, 4) as reuse, rank::int as rank from anc")
def nation_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each shipping result in their order."""
    return R.lineage(_facts(spark, sf_dir, "S"))[0]


@query(f"with recursive {NATIONS}, {LINEAGE}, d(name, depth) as (select id, 0 from s where id not in (select child from lin) union all select child, depth + 1 from d join lin on parent = name) select name, depth from d")
def nation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each shipping result below its lineage's root."""
    facts = _facts(spark, sf_dir, "S")
    return R.lineage_order(R.lineage(facts)[1].checkpoint(), facts.select("name").distinct())


NOVELTY = """pc as (select t.id as result, b.id as prior, b.pos, t.e, t.fs, b.fs as bfs, t.n as tn, len(list_intersect(t.fs, b.fs)) as k from s t join s b on b.id <> t.id and b.n <= t.n),
np as (select * from (select *, row_number() over (partition by result order by k / tn desc, pos) as nth from pc where k > 0) where nth = 1),
nov as (select s.id as result, prior as nearest_prior, round(coalesce(k / tn, 0), 4) as coverage, round(1 - coalesce(k / tn, 0), 4) as novelty, array_to_string(list_transform(list_filter(s.fs, lambda f: not list_contains(coalesce(bfs, []), f)), lambda f: f || '(' || s.e || ')'), '; ') as residual from s left join np on np.result = s.id)"""


@query(f"with {NATIONS}, {NOVELTY} select result, nearest_prior, coverage, novelty, case when nearest_prior is not null then residual else '' end as residual from nov")
def nation_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipping result against the prior that explains most of it."""
    out = R.result_novelty(_facts(spark, sf_dir, "S"), _positions(spark, sf_dir))
    return out.withColumn("residual", F.when(F.col("nearest_prior").isNotNull(), F.array_join("residual", "; ")).otherwise(""))


def _planes(seed: int = 0, n: int = 16) -> list[tuple[int, str, int]]:
    draw = random.Random(seed)
    return [(p, f, draw.choice((-1, 1))) for p in range(n) for f in TYPES]


INDEX = f"""pl as (select unnest({[p for p, _, _ in _planes()]}::int[]) as p, unnest({[f for _, f, _ in _planes()]}::varchar[]) as f, unnest({[s for _, _, s in _planes()]}::int[]) as sign),
ev as (select id, f, x from sv union all select id, f, x from cv), bits as (select id, p, sum(x * sign) as v from ev join pl using (f) group by all),
sig as (select id, sum(case when v >= 0 then 1::bigint << p else 0 end)::bigint as sig from bits group by id),
norm as (select id, sqrt(sum(x * x)) as m from ev group by id), dots as (select a.id as a, b.id as b, sum(a.x * b.x) as dot from cv a join sv b using (f) group by all),
cos as (select a, b, dot / (u.m * w.m) as cosine from dots join norm u on u.id = a join norm w on w.id = b),
near as (select a.id as a, b.id as b from sig a join sig b on starts_with(a.id, 'C') and starts_with(b.id, 'S') and bit_count(xor(a.sig, b.sig)) <= 2),
cand as (select * from near union all select a.id, b.id from c a, s b where a.id not in (select a from near)),
fr as (select a, round(count(*) / (select count(*) from s), 4) as fraction from cand group by a)"""


@query(f"with {NATIONS}, {INDEX} select id, sig from sig")
def nation_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of all results by the signs of products with random planes."""
    s, c = _vectors(spark, sf_dir, "S"), _vectors(spark, sf_dir, "C")
    index = R.SignIndex(s, features=TYPES)
    return index.signed.unionByName(index.signatures(c)).select("id", "sig")


@query(f"with {NATIONS}, {INDEX}, r as (select cand.a, cand.b, coalesce(cosine, 0) as cosine, row_number() over (partition by cand.a order by coalesce(cosine, 0) desc, cand.b)::int as rank from cand left join cos using (a, b)) select a, b, round(cosine, 4) as cosine, rank, fraction from r join fr using (a) where rank <= 2")
def nation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best shipping results for each ordering one among those of near signatures, and the share examined."""
    return R.SignIndex(_vectors(spark, sf_dir, "S"), features=TYPES).query(_vectors(spark, sf_dir, "C"))


@query(f"with {NATIONS}, {INDEX}, r as (select a, b, cosine, row_number() over (partition by a order by cosine desc, b)::int as rank from cos) select a, b, round(cosine, 4) as cosine, rank from r where rank <= 2")
def nation_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among all that share a type."""
    return R.linear_top_k(_vectors(spark, sf_dir, "C"), _vectors(spark, sf_dir, "S"))


@query(f"""with {NATIONS} select s.id as a, c.id as b, 2.0::double * len(list_intersect(s.fs, c.fs)) as score, s.e || '>' || c.e as corrs, array_to_string(list_transform(list_sort(list_intersect(s.fs, c.fs)), lambda f: f || '(' || s.e || ')'), '; ') as shared
from s, c where len(list_intersect(s.fs, c.fs)) >= 2""")
def nation_analogies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogies between shipping and ordering results."""
    pair = lambda x: F.concat(x["b"], F.lit(">"), x["t"])
    out = D.analogies(_facts(spark, sf_dir, "S"), _facts(spark, sf_dir, "C"))
    return out.select("a", "b", "score", F.array_join(F.transform("corrs", pair), ";").alias("corrs"), F.array_join("shared", "; ").alias("shared"))


# The whole graph over the shipping results, regions as domains.


def _run(spark: SparkSession, sf_dir: str, evaluations: DataFrame | None = None) -> dict[str, DataFrame]:
    named = _stated(spark, sf_dir, "S").select("id", "nation", "pos", "region").distinct()
    results = named.select(F.col("id").alias("name"), "pos", F.col("nation").alias("text"), F.col("region").cast("string").alias("domain"), F.col("region").alias("domain_pos"))
    return pipeline.run(_facts(spark, sf_dir, "S"), results, evaluations)


GRAPH = f"""{NATIONS}, {LINEAGE}, {NOVELTY},
an as (select a.id as a, b.id as b, a.e as ae, b.e as be, a.fs as afs, b.fs as bfs, len(list_intersect(a.fs, b.fs)) as k from s a join s b on a.region < b.region where len(list_intersect(a.fs, b.fs)) >= 2),
wy as (select a as base, b as target, afs as fs, bfs as tfs, be as te from an union all select b, a, bfs, afs, ae from an),
cj as (select base, target, te, unnest(list_filter(fs, lambda f: not list_contains(tfs, f))) as f from wy),
own as (select * from (select *, row_number() over (partition by child order by bn desc, k / bn desc, parent) as nth from pr where bn < tn and k / bn >= 0.5 and region = bregion) where nth = 1),
fc as (select distinct id, f from sl)"""


@query(f"""with {GRAPH} select 'node' as what, 'fact' as name, count(*) as count from fc union all select 'node', 'entity', count(*) from s union all select 'node', 'functor', count(distinct f) from fc union all select 'node', 'result', count(*) from s union all select 'node', 'conjecture', count(*) from cj having count(*) > 0
union all select 'edge', r, count(*) from fc, (select unnest(['instance_of', 'asserts', 'in', 'arg:0']) as r) group by r union all select 'edge', 'extends', count(*) from own having count(*) > 0 union all select 'edge', 'analogous_to', count(*) from an having count(*) > 0 union all select 'edge', 'conjectures', count(*) from cj having count(*) > 0""")
def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the whole graph by kind and relation."""
    got = _run(spark, sf_dir)
    return G.stats(got["nodes"], got["edges"])


@query(f"with {GRAPH} select base, target, f || '(' || te || ')' as projection, 1::int as overlap, 'novel' as status, (row_number() over (partition by base, target order by f) - 1)::int as i from cj")
def nation_conjectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each side of an analogy between regions leaves over, projected onto the other."""
    from factloom.functions.expressions import fmt_expr

    got = _run(spark, sf_dir)["conjectures"]
    return got.select("base", "target", fmt_expr(F.col("projection")).alias("projection"), F.col("entity_overlap").alias("overlap"), "status", "i")


@query(f"with {GRAPH}, v as (select base, target, f, case when f = 'LARGE' then 'plausible' when f = 'PROMO' then 'uncertain' end as verdict from cj) select coalesce(verdict, 'none') as verdict, count(*) as n from v group by all")
def nation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjectures by the verdict of the last evaluation of their base, target and projection."""
    conjectures = _run(spark, sf_dir)["conjectures"]
    nodes, _ = G.add_conjectures(conjectures)
    text = F.col("label")
    judged = nodes.filter(text.startswith("LARGE(") | text.startswith("PROMO(")).select(F.regexp_replace(F.element_at("attrs", "source_base"), '"', "").alias("source_base"), F.substring_index("provenance", "->", -1).alias("source_target"), text.alias("projection"))
    last = judged.withColumn("verdict", F.when(F.col("projection").startswith("LARGE("), "plausible").otherwise("uncertain")).withColumn("seq", F.lit(2))
    evaluations = last.unionByName(last.withColumn("verdict", F.lit("implausible")).withColumn("seq", F.lit(1))).withColumn("reasoning", F.lit("as the type says"))
    out = D.attach_verdicts(nodes, evaluations)
    verdict = F.regexp_replace(F.element_at("attrs", "verdict"), '"', "")
    return out.groupBy(F.coalesce(verdict, F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"with {GRAPH} select result, novelty from nov order by novelty desc, result limit 3")
def nation_most_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most novel results of the graph."""
    return GQ.most_novel(_run(spark, sf_dir)["nodes"])


@query(f"with {GRAPH}, m as (select a from (select a from an union all select b from an) group by a order by count(*) desc, a limit 1) select case when an.a = m.a then b else an.a end as other, 2.0::double * k as score from an, m where m.a in (an.a, an.b)")
def nation_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analogies, either way round, of the result that has most."""
    edges = _run(spark, sf_dir)["edges"]
    ends = edges.filter("relation = 'analogous_to'").select(F.explode(F.array("src", "dst")).alias("id"))
    top = ends.groupBy("id").count().orderBy(F.desc("count"), "id").first()
    return GQ.analogies_of(edges, top["id"].removeprefix("result::") if top else "")


@query(f"with {NATIONS} select id as result from s where list_contains(fs, 'LARGE')")
def nation_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with a fact of one functor, by the edges of the graph."""
    return GQ.results_using_functor(G.reify(_facts(spark, sf_dir, "S"))[1], "LARGE")


@query(f"with {NATIONS}, x as (select id, unnest(fs) as f, e from s) select f || '(' || e || ')' as text, count(*) as n from x group by all union all select e, count(*) from s group by e")
def nation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and entities rebuilt as text from the edges of the graph."""
    return GQ.expr_strings(*G.reify(_facts(spark, sf_dir, "S"))).groupBy("text").agg(F.count("*").alias("n"))


@query(f"with {NATIONS}, f as (select distinct id, f from sl) select 'arg indices are not 0 to arity - 1' as error, count(*) as n from f where f = 'LARGE' having count(*) > 0 union all select 'label must be a non-empty string', 1 from f where f = 'PROMO' group by 1 union all select 'dst is not a node', count(*) from f where f = 'SMALL' having count(*) > 0 union all select 'unknown relation', count(*) from f where f = 'MEDIUM' having count(*) > 0")
def nation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the schema's check finds in a graph with faults put into it."""
    nodes, edges = G.reify(_facts(spark, sf_dir, "S"))
    src = F.col("src")
    edges = edges.filter(~(src.endswith("::LARGE") & (F.col("relation") == "arg:0")))
    edges = edges.withColumn("dst", F.when(src.endswith("::SMALL") & (F.col("relation") == "in"), "result::nowhere").otherwise(F.col("dst")))
    edges = edges.withColumn("relation", F.when(src.endswith("::MEDIUM") & (F.col("relation") == "in"), "inside").otherwise(F.col("relation")))
    nodes = nodes.withColumn("label", F.when(F.col("id") == "functor::PROMO", "").otherwise(F.col("label")))
    results = _stated(spark, sf_dir, "S").select(F.col("id").alias("name"), F.col("nation").alias("text"), F.lit("").alias("domain")).distinct()
    nodes = nodes.unionByName(G.result_nodes(results, _facts(spark, sf_dir, "S")))
    return G.validate(nodes, edges).groupBy("error").agg(F.count("*").alias("n"))


# The star schema as documents: a region is one, its nations are definitions, customers paragraphs that refer to their nation,
# suppliers list items that refer to the nation of their key.


def _document(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("region."), F.col("n_regionkey").cast("string")).alias("slug"))
    n = n.withColumn("nid", F.concat("slug", F.lit("/nation."), F.col("n_nationkey").cast("string")))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("slug"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("title"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))

    def rows(df, ident, kind, key, title):
        return df.select("slug", ident.alias("id"), L.parent_id(ident).alias("parent_id"), kind.alias("type"), title.alias("title"), F.col(key).cast("long").alias("seq"), F.col(key).cast("int").alias("ord"))

    below = lambda name, key: F.concat("nid", F.lit(f"/{name}."), F.col(key).cast("string"))
    nodes = rows(r, F.col("slug"), F.lit("section"), "k", F.col("title")).unionByName(rows(n, F.col("nid"), F.lit("definition"), "n_nationkey", F.col("n_name")))
    nodes = nodes.unionByName(rows(c, below("customer", "c_custkey"), F.when(F.col("c_acctbal") < 0, "debtor").otherwise("paragraph"), "c_custkey", F.col("c_name")))
    twice = s.filter("s_acctbal > 9000")
    nodes = nodes.unionByName(rows(s.unionByName(twice), below("supplier", "s_suppkey"), F.lit("list_item"), "s_suppkey", F.col("s_name")))
    from factloom.functions.text import role_for

    nodes = nodes.withColumn("role", role_for(F.col("type"))).withColumn("depth", F.size(F.split("id", "/")) - 1).withColumn("label", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string")).withColumn("attrs", F.expr("cast(map() as map<string,string>)"))
    none = F.expr("cast(map() as map<string,string>)")
    to_own = c.select("slug", F.col("c_custkey").alias("seq"), F.concat(F.lit("e.c"), F.col("c_custkey").cast("string")).alias("id"), below("customer", "c_custkey").alias("source"), F.col("nid").alias("target"), F.lit("refers_to").alias("relation"), F.lit(True).alias("resolved"), none.alias("attrs"))
    other = n.select(F.col("n_nationkey").alias("ok"), F.col("nid").alias("oid"))
    far = s.join(F.broadcast(other), F.pmod(F.col("s_suppkey"), F.lit(25)) == F.col("ok"))
    to_far = far.select("slug", (F.col("s_suppkey") + 10_000_000_000).alias("seq"), F.concat(F.lit("e.s"), F.col("s_suppkey").cast("string")).alias("id"), below("supplier", "s_suppkey").alias("source"), F.col("oid").alias("target"), F.lit("cites").alias("relation"), F.lit(True).alias("resolved"), none.alias("attrs"))
    return nodes, to_own.unionByName(to_far)


DOC = """nt as (select n_nationkey, n_name, 'region.' || n_regionkey as slug, 'region.' || n_regionkey || '/nation.' || n_nationkey as nid from nation),
cu as (select *, nid || '/customer.' || c_custkey as id, case when c_acctbal < 0 then 'debtor' else 'paragraph' end as type from customer join nt on n_nationkey = c_nationkey),
su as (select *, nid || '/supplier.' || s_suppkey as id, s_acctbal > 9000 as twice from supplier join nt on n_nationkey = s_nationkey),
fa as (select su.*, o.nid as target, o.slug as oslug from su join nt o on o.n_nationkey = s_suppkey % 25),
dn as (select 'region.' || r_regionkey as slug, 'region.' || r_regionkey as id, 'section' as type, 'segment' as role from region union all select slug, nid, 'definition', 'assert' from nt union all select slug, id, type, 'narrate' from cu
  union all select slug, id, 'list_item', 'narrate' from su union all select slug, id, 'list_item', 'narrate' from su where twice)"""


def _unique(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _document(spark, sf_dir)
    return nodes.dropDuplicates(["slug", "id"]), edges


@query(f"""with {DOC}, u as (select distinct * from dn), ct as (select slug, count(*) as c from u group by slug), rc as (select slug, count(*) as n from (select slug, id from nt) group by slug)
select ct.slug, c as n_concepts, ((select count(*) from nt where nt.slug = ct.slug) + 3 * (select count(*) from cu where cu.slug = ct.slug) + 2 * (select count(*) from su where su.slug = ct.slug))::bigint as n_relations, (select count(*) from cu where cu.slug = ct.slug) as n_reasoning_edges,
((select count(*) from nt where nt.slug = ct.slug) + 3 * (select count(*) from cu where cu.slug = ct.slug) + (select count(*) from su where su.slug = ct.slug) + (select count(*) from fa where fa.slug = ct.slug and oslug = ct.slug))::bigint as n_resolved from ct""".replace("rc as (select slug, count(*) as n from (select slug, id from nt) group by slug)", "one as (select 1)"))
def star_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts and relations of each region's document, counted."""
    nodes, edges = _unique(spark, sf_dir)
    return L.metrics(L.concepts(nodes), L.relations(nodes, edges)).select("slug", "n_concepts", "n_relations", "n_reasoning_edges", "n_resolved")


@query(f"""with {DOC} select slug, 'contains' as predicate, regexp_replace(id, '/[^/]+$', '') as subject, id as object, true as resolved, false as higher_order from (select distinct slug, id from dn) where contains(id, '/') union all select slug, 'refers_to', id, nid, true, false from cu union all select slug, 'derives_from', id, nid, true, true from cu union all select slug, 'cites', id, target, slug = oslug, false from fa""")
def star_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of the regions' documents."""
    nodes, edges = _unique(spark, sf_dir)
    return L.relations(nodes, edges).select("slug", "predicate", "subject", "object", "resolved", "higher_order")


@query(f"""with {DOC}, u as (select distinct * from dn) select slug, 'attribute' as part, type as pred, count(*) as n from u group by all union all select slug, 'attribute', 'role:' || role, count(*) from u group by all union all select slug, 'relation', 'contains', count(*) from u where contains(id, '/') group by all
union all select slug, 'relation', 'refers_to', count(*) from cu group by slug union all select slug, 'higher_order', 'derives_from', count(*) from cu group by slug union all select slug, 'relation', 'cites', count(*) from fa group by slug""")
def star_dgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as predicates, counted by part and predicate."""
    nodes, edges = _unique(spark, sf_dir)
    return L.dgroup(L.concepts(nodes), L.relations(nodes, edges)).groupBy("slug", "part", "pred").agg(F.count("*").alias("n"))


@query(f"""with {DOC}, u as (select distinct * from dn) select slug as id, 'attr:' || type as feature, count(*) as cnt from u group by all union all select slug, 'role:' || role, count(*) from u group by all union all select slug, 'rel:contains', count(*) from u where contains(id, '/') group by all
union all select slug, 'rel:refers_to', count(*) from cu group by slug union all select slug, 'rel:derives_from', count(*) from cu group by slug union all select slug, 'rel:cites', count(*) from fa group by slug""")
def star_renamed_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content vectors after all concepts have got canonical names."""
    nodes, edges = _unique(spark, sf_dir)
    concept, relation = L.concepts(nodes), L.relations(nodes, edges)
    return L.content_vector(*L.relabel(concept, relation, L.canonical_names(concept)))


@query(f"with {DOC}, u as (select distinct slug, id from dn), e as (select *, 'E' || (row_number() over (partition by slug order by id) - 1) as new from u) select a.slug, a.new as subject, 'contains' as predicate, b.new as object from e b join e a on a.slug = b.slug and a.id = regexp_replace(b.id, '/[^/]+$', '') and contains(b.id, '/')")
def star_renamed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment triples under the canonical names."""
    nodes, edges = _unique(spark, sf_dir)
    concept = L.concepts(nodes)
    return L.triples(L.relabel(concept, L.relations(nodes, edges), L.canonical_names(concept))[1]).filter("predicate = 'contains'")


@query(f"""with {DOC}, sl as (select 'region.' || r_regionkey as slug from region), oc as (select slug, count(*) as n from orders join cu on c_custkey = o_custkey group by slug), cc as (select slug, count(*) as n from cu group by slug), x as (select sl.slug, coalesce(oc.n, 0) as o, coalesce(cc.n, 0) as c from sl left join oc using (slug) left join cc using (slug))
select slug, (o + c)::bigint as n_higher_order_relations, (case when o > 0 then 2 when c > 0 then 1 else 0 end)::int as max_reasoning_depth, ((o + c) * (1 + case when o > 0 then 2 when c > 0 then 1 else 0 end))::bigint as systematicity_score from x""")
def star_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and systematicity of each region's chains from orders over customers to nations."""
    nodes, edges = _unique(spark, sf_dir)
    own = L.relations(nodes, edges)
    at = edges.filter("relation = 'refers_to'").select("slug", "source", F.col("seq").alias("c"))
    orders = table(spark, sf_dir, "orders").join(at, F.col("c") == F.col("o_custkey")).select("slug", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("subject"), F.col("source").alias("object"), F.lit(True).alias("higher_order"))
    return L.systematicity(own.select("slug", "subject", "object", "higher_order").unionByName(orders))


@query(f"""with {DOC}, sl as (select distinct slug from dn), bad as (select slug, 'schema_valid' as name, count(*) as n from cu where type = 'debtor' group by slug union all select slug, 'unique_ids', count(*) from su where twice group by slug union all select slug, 'acyclic_tree', count(*) from su where twice group by slug union all select slug, 'reference_integrity', count(*) from fa where slug <> oslug group by slug
union all select slug, 'traceability', 0 from sl union all select slug, 'edge_conservation', 0 from sl union all select slug, 'reasoning_dag_acyclic', 0 from sl)
select sl.slug as scope, names.name, coalesce(n, 0) = 0 as passed, coalesce(n, 0)::double as violations from sl cross join (select distinct unnest(['schema_valid', 'unique_ids', 'acyclic_tree', 'reference_integrity', 'traceability', 'edge_conservation', 'reasoning_dag_acyclic']) as name) names left join bad on bad.slug = sl.slug and bad.name = names.name""")
def star_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariants of the regions' documents: some nodes have no known type, some come twice, some references leave."""
    nodes, edges = _document(spark, sf_dir)
    nodes = nodes.checkpoint()
    one = nodes.dropDuplicates(["slug", "id"])
    concept, relation = L.concepts(one), L.relations(one, edges).checkpoint()
    out = K.schema_valid(nodes)
    for x in (K.unique_ids(nodes), K.acyclic_tree(nodes), K.reference_integrity(nodes, edges), K.traceability(concept, relation), K.edge_conservation(relation, edges), K.reasoning_acyclic(relation)):
        out = out.unionByName(x)
    return out.select("scope", "name", "passed", F.element_at("metrics", "violations").alias("violations"))


@query("""with t as (select doc_id::varchar as name, coalesce(text, '') as text, map {'lang': coalesce(lang, ''), 'source': coalesce(source, ''), 'start': coalesce(text, '')[1:5]} as g from documents),
b as (select name, list_sort(list_filter(['lang', 'source', 'start'], lambda k: trim(g[k]) = '' or not contains(text, g[k]))) as ungrounded from t) select name, false as ok, array_to_string(ungrounded, ',') as ungrounded, 'nowhere' as missing from b""")
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: which of their symbols the text doesn't hold, and which entity has no grounding."""
    text, lang, source = (F.coalesce(c, F.lit("")) for c in ("text", "lang", "source"))
    groundings = F.create_map(F.lit("lang"), lang, F.lit("source"), source, F.lit("start"), F.substring(text, 1, 5))
    facts = F.array(F.lit('["IN","lang","source"]'), F.lit('["OPENS","start",["AT","nowhere"]]'))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), text.alias("text"), groundings.alias("groundings"), facts.alias("facts"))
    return ground.check_sections(rows).select("name", "ok", F.array_join("ungrounded", ",").alias("ungrounded"), F.array_join("missing", ",").alias("missing"))
