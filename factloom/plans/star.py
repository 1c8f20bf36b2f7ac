"""Queries over the star schema: orders as results with facts, and the schema as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import align as A
from factloom.operators import discover as D
from factloom.operators import graph as G
from factloom.operators import graphquery as GQ
from factloom.operators import lift as L
from factloom.plans.common import best, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# An order is a result. Its facts are ["<flag><status>","p<part>","s<supplier>"] for each line, in the order of line
# number, part, supplier and price, and ["CAUSE", line, next line].


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by name from the start, so that facts of an order are together for all that follows
    order = Window.partitionBy("name").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    fact = F.concat(F.lit('["'), F.col("l_returnflag"), F.col("l_linestatus"), F.lit('","p'), F.col("l_partkey").cast("string"), F.lit('","s'), F.col("l_suppkey").cast("string"), F.lit('"]'))
    lines = table(spark, sf_dir, "lineitem").withColumn("name", F.col("l_orderkey").cast("string")).select("name", F.row_number().over(order).alias("n"), fact.alias("f"), F.lead(fact).over(order).alias("g"))
    cause = F.concat(F.lit('["CAUSE",'), F.col("f"), F.lit(","), F.col("g"), F.lit("]"))
    both = F.explode(F.array_compact(F.array(F.struct((2 * F.col("n") - 2).alias("pos"), F.col("f").alias("e")), F.when(F.col("g").isNotNull(), F.struct((2 * F.col("n") - 1).alias("pos"), cause.alias("e"))))))
    return lines.select("name", both.alias("x")).select("name", F.col("x.pos").alias("fact_pos"), F.col("x.e").alias("expr"))


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order (target) with its customer's order before it (base)."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.lag("o_orderkey").over(order).cast("string").alias("base"), F.col("o_orderkey").cast("string").alias("target"))
    return o.filter("base is not null")


FACTS_SQL = """l as (select l_orderkey, row_number() over w as n, l_returnflag || l_linestatus as f, 'p' || l_partkey as p, 's' || l_suppkey as s, lead(l_returnflag || l_linestatus) over w as f2, lead('p' || l_partkey) over w as p2, lead('s' || l_suppkey) over w as s2
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
facts as (select l_orderkey::varchar as name, 2 * n - 2 as pos, f as skel, 1 as ord, [p, s] as leaves from l union all select l_orderkey::varchar, 2 * n - 1, 'CAUSE ' || f || ' ' || f2, 2, [p, s, p2, s2] from l where f2 is not null),
op as (select lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)::varchar as base, o_orderkey::varchar as target from orders),
mh as (select op.base, op.target, b.pos as bpos, t.pos as tpos, b.ord, list_distinct(list_transform(range(1, len(b.leaves) + 1), lambda i: {'b': b.leaves[i], 't': t.leaves[i]})) as c
  from op join facts b on b.name = op.base join facts t on t.name = op.target and t.skel = b.skel),
ok as (select * from mh where len(c) = len(list_distinct(list_transform(c, lambda x: x.b))) and len(c) = len(list_distinct(list_transform(c, lambda x: x.t)))),
folded as (select base, target, list_reduce(list({'s': 1.0::double + ord, 'c': c, 'm': [{'bpos': bpos, 'tpos': tpos}]} order by -ord, bpos, tpos),
  lambda a, x: case when len(list_filter(x.c, lambda n: len(list_filter(a.c, lambda k: (k.b = n.b) <> (k.t = n.t))) > 0)) = 0 then {'s': a.s + x.s, 'c': list_distinct(list_concat(a.c, x.c)), 'm': list_concat(a.m, x.m)} else a end) as g from ok group by base, target)"""


@query(f"with {FACTS_SQL} select base, target, round(g.s, 3) as score, len(g.c)::int as n_mapped, len(g.m)::int as n_matched from folded")
def order_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural alignment of every order with the one before it."""
    f = order_facts(spark, sf_dir)
    return A.align(f, f, pairs=order_pairs(spark, sf_dir)).select("base", "target", "score", F.size("corrs").alias("n_mapped"), F.size("matched").alias("n_matched"))


INFER_SQL = FACTS_SQL + """,
mk as (select base, target, list_distinct(list_transform(g.m, lambda x: x.bpos)) as hit, g.c as c from folded),
known as (select mk.base, mk.target, list(distinct f.skel || array_to_string(f.leaves, ' ')) as known from mk join facts f on f.name = mk.base and list_contains(mk.hit, f.pos) group by all),
cand as (select mk.base, mk.target, f.pos as bpos, f.skel, f.ord, f.leaves, mk.c, k.known from mk join known k using (base, target) join facts f on f.name = mk.base where not list_contains(k.known, f.skel || array_to_string(f.leaves, ' '))),
inf as (select *, case when ord = 2 then list_contains(known, string_split(skel, ' ')[2] || leaves[1] || ' ' || leaves[2])::int + list_contains(known, string_split(skel, ' ')[3] || leaves[3] || ' ' || leaves[4])::int else 0 end as anchored,
  len(list_filter(list_distinct(leaves), lambda e: list_contains(list_transform(c, lambda x: x.b), e))) as overlap,
  list_transform(leaves, lambda e: coalesce(list_filter(c, lambda x: x.b = e)[1].t, 'skolem:' || e)) as image from cand),
good as (select *, len(list_filter(list_distinct(image), lambda x: starts_with(x, 'skolem:'))) as n_skolems from inf where anchored > 0 or overlap > 0)"""


@query(f"with {INFER_SQL} select base, target, bpos::int as bpos, anchored::int as anchored, overlap::int as entity_overlap, n_skolems::int as n_skolems, round(2.0 * anchored + overlap, 3)::double as score from good")
def order_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the order before that the alignment leaves over, projected onto the order."""
    f = order_facts(spark, sf_dir)
    return A.conjectures(f, f, pairs=order_pairs(spark, sf_dir)).select("base", "target", F.col("bpos").cast("int").alias("bpos"), "anchored", "entity_overlap", "n_skolems", "score")


@query(f"""with {INFER_SQL}, conf as (select g.base, g.target, g.bpos, bool_or(coalesce(t.name is not null and len(list_filter(range(1, len(g.image) + 1), lambda i: not (starts_with(g.image[i], 'skolem:') or g.image[i] = t.leaves[i]))) = 0, false)) as hit
  from good g left join facts t on t.name = g.target and t.skel = g.skel group by all)
select base, target, case when hit then 'confirmed' else 'novel' end as status, count(*) as n from conf group by all""")
def order_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many projected facts of each pair the order states itself, invented entities matching any."""
    f = order_facts(spark, sf_dir)
    return A.conjectures(f, f, pairs=order_pairs(spark, sf_dir)).groupBy("base", "target", "status").agg(F.count("*").alias("n"))


@query(f"""with {INFER_SQL}, conf as (select g.base, g.target, g.bpos, bool_or(coalesce(t.name is not null and len(list_filter(range(1, len(g.image) + 1), lambda i: not (starts_with(g.image[i], 'skolem:') or g.image[i] = t.leaves[i]))) = 0, false)) as hit
  from good g left join facts t on t.name = g.target and t.skel = g.skel group by all),
tx as (select g.*, hit, 2.0 * anchored + overlap - n_skolems as confidence, case when ord = 1 then skel || '(' || image[1] || ', ' || image[2] || ')' else 'CAUSE(' || string_split(skel, ' ')[2] || '(' || image[1] || ', ' || image[2] || '), ' || string_split(skel, ' ')[3] || '(' || image[3] || ', ' || image[4] || '))' end as projection from good g join conf using (base, target, bpos))
select base, target, (row_number() over (partition by base, target order by confidence desc, projection, bpos) - 1)::int as i, projection, round(confidence, 3)::double as confidence, case when hit then 'confirmed' else 'novel' end as status from tx""")
def order_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjectures about each order from the one before it, best first."""
    from factloom.functions.expressions import fmt_expr

    f = order_facts(spark, sf_dir)
    return A.transfer(f, f, pairs=order_pairs(spark, sf_dir)).select("base", "target", "i", fmt_expr(F.col("projection")).alias("projection"), "confidence", "status")


@query(f"""with {FACTS_SQL}, t as (select f.name, len(f.leaves) as d from facts f) , n as (select name, count(*) as n from facts group by name),
hitb as (select distinct base, target, x.tpos as tpos from (select base, target, unnest(g.m) as x from folded)),
known as (select distinct h.base, h.target, f.skel, f.leaves from hitb h join facts f on f.name = h.target and f.pos = h.tpos),
cov as (select k.base, k.target, count(*) as hit from known k join facts f on f.name = k.target and f.skel = k.skel and f.leaves = k.leaves group by all)
select base, target, round(hit / n, 4) as coverage, round(1 - hit / n, 4) as novelty from cov join n on n.name = target""")
def order_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each order's facts that the order before it explains."""
    f = order_facts(spark, sf_dir)
    return A.novelty_report(A.align(f, f, pairs=order_pairs(spark, sf_dir)), f).select("base", "target", "coverage", "novelty")


@query("""with l as (select l_returnflag || l_linestatus as f, lead(l_returnflag || l_linestatus) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as g from lineitem),
s as (select f as functor, 1 as p, 0 as c from l where g is not null union all select g, 0, 1 from l where g is not null)
select functor, 'ROLE::' || case when max(p) = 1 then 'P' else '' end || case when max(c) = 1 then 'C' else '' end || '::2' as role from s group by functor""")
def order_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that functors play in the CAUSE facts of all orders."""
    return D.discover_roles(order_facts(spark, sf_dir))


# The schema as a graph: region/<k>, its nations, their customers and suppliers.


def _concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a document tree and the relations between them."""
    text = lambda c: F.col(c).cast("string")
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("root/region."), text("r_regionkey")).alias("id"), F.lit("section").alias("type"), F.col("r_name").alias("title"))
    n0 = table(spark, sf_dir, "nation")
    n = n0.select(F.concat(F.lit("root/region."), text("n_regionkey"), F.lit("/nation."), text("n_nationkey")).alias("id"), F.lit("definition").alias("type"), F.col("n_name").alias("title"))
    nid = n0.select("n_nationkey", F.concat(F.lit("root/region."), text("n_regionkey"), F.lit("/nation."), text("n_nationkey")).alias("nid"))
    c = table(spark, sf_dir, "customer").join(nid, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("nid", F.lit("/customer."), text("c_custkey")).alias("id"), F.lit("paragraph").alias("type"), F.col("c_name").alias("title"))
    s = table(spark, sf_dir, "supplier").join(nid, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("nid", F.lit("/supplier."), text("s_suppkey")).alias("id"), F.lit("list_item").alias("type"), F.col("s_name").alias("title"))
    nodes = r.unionByName(n).unionByName(c).unionByName(s)
    return nodes, nodes.select("id", L.parent_id(F.col("id")).alias("parent"))


TREE_SQL = """r as (select 'root/region.' || r_regionkey as id, 'section' as type, r_name as title from region), n as (select n_nationkey, 'root/region.' || n_regionkey || '/nation.' || n_nationkey as id, 'definition' as type, n_name as title from nation),
tree as (select * from r union all select id, type, title from n union all select n.id || '/customer.' || c_custkey, 'paragraph', c_name from customer join n on n_nationkey = c_nationkey union all select n.id || '/supplier.' || s_suppkey, 'list_item', s_name from supplier join n on n_nationkey = s_nationkey)"""


@query(f"with {TREE_SQL} select regexp_replace(c.id, '/[^/]+$', '') as subject, 'contains' as predicate, c.id as object, (len(string_split(c.id, '/')) - 1)::int as depth from tree c join tree p on p.id = regexp_replace(c.id, '/[^/]+$', '')")
def star_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations from each node to the parent that its id names."""
    nodes, edges = _concepts(spark, sf_dir)
    ids = nodes.select(F.col("id").alias("parent"))
    return edges.join(ids, "parent").select(F.col("parent").alias("subject"), F.lit("contains").alias("predicate"), F.col("id").alias("object"), (F.size(F.split("id", "/")) - 1).alias("depth"))


@query(f"""with {TREE_SQL}, c as (select id, regexp_extract(id, 'customer.([0-9]+)$', 1)::bigint as k from tree where type = 'paragraph'), p as (select id, lead(id) over (order by k) as other, k from c),
a as (select id, other, unnest(range(1, len(string_split(id, '/')) + 1)) as d from p where other is not null),
s as (select id, other, max(d) as d from a where string_split(id, '/')[1:d] = string_split(other, '/')[1:d] group by all)
select id as a, other as b, array_to_string(string_split(id, '/')[1:d], '/') as ancestor from s""")
def star_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest shared ancestor of each customer and the next one by key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    path = F.concat(F.lit("root/region."), F.col("n_regionkey").cast("string"), F.lit("/nation."), F.col("c_nationkey").cast("string"), F.lit("/customer."), F.col("c_custkey").cast("string"))
    own = c.join(n, "c_nationkey").select("c_custkey", path.alias("id"))
    keys = c.select("c_custkey")
    # the next key without one window over all customers: ranges of keys are numbered, gaps between ranges are joined
    span = 4096
    part = keys.withColumn("r", F.floor(F.col("c_custkey") / span))
    inner = part.withColumn("next", F.lead("c_custkey").over(Window.partitionBy("r").orderBy("c_custkey")))
    firsts = part.groupBy("r").agg(F.min("c_custkey").alias("first"))
    after = firsts.withColumn("next_first", F.lead("first").over(Window.orderBy("r"))).select("r", "next_first")  # one row for 4,096 keys
    step = inner.join(after, "r").select("c_custkey", F.coalesce("next", "next_first").alias("next")).filter("next is not null")
    both = step.join(own, "c_custkey").join(own.select(F.col("c_custkey").alias("next"), F.col("id").alias("other")), "next")
    a, b = F.split("id", "/"), F.split("other", "/")
    shared = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda d: F.slice(a, F.lit(1), d) == F.slice(b, F.lit(1), d))
    return both.select(F.col("id").alias("a"), F.col("other").alias("b"), F.array_join(F.slice(a, F.lit(1), F.array_max(shared)), "/").alias("ancestor"))


def _undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _concepts(spark, sf_dir)
    e = edges.filter("parent is not null")
    return e.select(F.col("id").alias("x"), F.col("parent").alias("y")).unionByName(e.select(F.col("parent").alias("x"), F.col("id").alias("y")))


@query(f"""with recursive {TREE_SQL}, e as (select id as x, regexp_replace(id, '/[^/]+$', '') as y from tree), u as (select x, y from e union all select y, x from e),
start as (select id from tree where type = 'paragraph' order by length(id), id limit 1), b(id, d) as (select id, 0 from start union select u.y, b.d + 1 from b join u on u.x = b.id where b.d < 8)
select id, min(d)::int as distance from b group by id""")
def star_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from one customer to every node over containment, breadth first: a level is a join with the edges."""
    u = _undirected(spark, sf_dir)
    start = _concepts(spark, sf_dir)[0].filter("type = 'paragraph'").orderBy(F.length("id"), "id").limit(1)
    seen = start.select("id", F.lit(0).alias("distance")).checkpoint()
    level, d = seen, 0
    while True:
        d += 1
        level = u.join(level.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(d).alias("distance")).checkpoint()
        if not level.limit(1).count():
            return seen
        seen = seen.unionByName(level)


@query(f"""with recursive {TREE_SQL}, e as (select regexp_replace(id, '/[^/]+$', '') as p, id from tree), b(top, id) as (select id, id from tree where type = 'section' union all select b.top, e.id from b join e on e.p = b.id)
select top, count(*) as n from b group by top""")
def star_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that can be reached from each region, itself included."""
    nodes, edges = _concepts(spark, sf_dir)
    level = nodes.filter("type = 'section'").select(F.col("id").alias("top"), "id")
    every = level
    while level.limit(1).count():
        level = level.select("top", F.col("id").alias("parent")).join(edges, "parent").select("top", "id").checkpoint()
        every = every.unionByName(level)
    return every.groupBy("top").agg(F.count("*").alias("n"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every line as a reified fact SHIP(order, part, supplier) of its order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    expr = F.concat(F.lit('["SHIP","o'), F.col("l_orderkey").cast("string"), F.lit('","p'), F.col("l_partkey").cast("string"), F.lit('","s'), F.col("l_suppkey").cast("string"), F.lit('"]'))
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("name"), (F.row_number().over(order) - 1).alias("fact_pos"), expr.alias("expr"))
    return G.reify(facts)


@query("""with f as (select count(*) as n from lineitem), e as (select count(*) as n from (select l_orderkey, 'o' || l_orderkey as s from lineitem union select l_orderkey, 'p' || l_partkey from lineitem union select l_orderkey, 's' || l_suppkey from lineitem))
select 'node' as what, 'fact' as name, n as count from f union all select 'node', 'entity', n from e union all select 'node', 'functor', 1 union all select 'edge', r, n from f, (select unnest(['instance_of', 'asserts', 'in', 'arg:0', 'arg:1', 'arg:2']) as r)""")
def star_reify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the reified lines by kind and relation."""
    return G.stats(*_graph(spark, sf_dir))


@query("select 'SHIP(o' || l_orderkey || ', p' || l_partkey || ', s' || l_suppkey || ')' as text, count(*) as n from lineitem group by all")
def star_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions rebuilt from the edges of the graph."""
    texts = GQ.expr_strings(*_graph(spark, sf_dir))
    return texts.filter(F.col("id").contains("::fact::")).groupBy("text").agg(F.count("*").alias("n"))


@query("""select o_custkey as custkey, l_returnflag as functor, count(*) as n from lineitem join orders on o_orderkey = l_orderkey group by all""")
def star_functor_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each customer's orders state a fact of each return flag."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("custkey"), F.col("l_returnflag").alias("functor")).agg(F.count("*").alias("n"))


@query("""with i as (select l_orderkey, list(l_linenumber order by l_linenumber) as idx from lineitem group by l_orderkey)
select 'argument indices are not contiguous' as error, count(*) as n from i where idx <> list_transform(range(1, len(idx) + 1), lambda x: x::int)
union all select 'no such order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'no such part', count(*) from lineitem where l_partkey not in (select p_partkey from part)
union all select 'no such customer', count(*) from orders where o_custkey not in (select c_custkey from customer) union all select 'order stated twice', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)""")
def star_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of contiguity, referential integrity and uniqueness, counted."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    idx = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("idx"))
    found = [
        ("argument indices are not contiguous", idx.filter(F.col("idx") != F.sequence(F.lit(1), F.size("idx")))),
        ("no such order", l.join(o, l.l_orderkey == o.o_orderkey, "left_anti")),
        ("no such part", l.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")),
        ("no such customer", o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("order stated twice", o.groupBy("o_orderkey").count().filter("count > 1")),
    ]
    out = None
    for name, bad in found:
        row = bad.agg(F.lit(name).alias("error"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {TREE_SQL} select 'node' as what, type as name, count(*) as count from tree group by type union all select 'edge', 'contains', count(*) from tree c join tree p on p.id = regexp_replace(c.id, '/[^/]+$', '')")
def star_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _concepts(spark, sf_dir)
    edges = star_containment(spark, sf_dir)
    return G.stats(nodes.withColumn("kind", F.col("type")), edges.withColumn("relation", F.col("predicate")))


@query(f"with {TREE_SQL} select id, title from tree where contains(lower(title), 'ica') or contains(lower(title), '#000000000')")
def star_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose title holds either of two needles, whatever the case."""
    nodes = _concepts(spark, sf_dir)[0].withColumn("label", F.col("title"))
    return GQ.find(nodes, "ICA").unionByName(GQ.find(nodes, "#000000000")).select("id", "title")


@query(f"""with recursive {TREE_SQL}, c as (select id, row_number() over (order by length(id), id) as a, row_number() over (order by length(id) desc, id desc) as z from tree where type = 'paragraph'),
f as (select string_split(id, '/') as p from c where a = 1), x as (select p, string_split((select id from c, f where string_split(id, '/')[2] = p[2] order by length(id) desc, id desc limit 1), '/') as q from f), d as (select p, q, len(list_filter(range(1, least(len(p), len(q)) + 1), lambda i: p[1:i] = q[1:i])) as k from x),
up as (select unnest(range(len(p), k, -1)) as i, p, k, len(p) as n from d), down as (select unnest(range(k + 1, len(q) + 1)) as i, q, k, (select len(p) from x) as n from d)
select (n - i + 1)::int as step, array_to_string(p[1:i], '/') as src, 'in' as direction, array_to_string(p[1:i - 1], '/') as dst from up union all select (n - k + i - k)::int, array_to_string(q[1:i - 1], '/'), 'out', array_to_string(q[1:i], '/') from down""")
def star_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path between the first and the last customer of a region over containment, step by step."""
    nodes, edges = _concepts(spark, sf_dir)
    own = edges.filter(F.col("parent").startswith("root/")).select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation"), F.xxhash64("id").alias("seq"))
    customers = nodes.filter("type = 'paragraph'")
    first = customers.orderBy(F.length("id"), "id").first()["id"]
    last = customers.filter(F.col("id").startswith("/".join(first.split("/")[:2]) + "/")).orderBy(F.desc(F.length("id")), F.desc("id")).first()["id"]
    steps = GQ.shortest_path(nodes, own.checkpoint(), first, last) or []
    return spark.createDataFrame([(i, a, d, b) for i, (a, _, b, d) in enumerate(steps, 1)], "step int, src string, direction string, dst string")


@query(f"""with {TREE_SQL}, c as (select id, row_number() over (order by length(id), id) as a from tree where type = 'paragraph'), x as (select string_split(id, '/') as p from c where a = 1)
select (len(p) - i)::int as depth, array_to_string(p[1:i], '/') as ancestor from (select p, unnest(range(2, len(p) + 1)) as i from x)""")
def star_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer and what contains it, upwards, as a chain of extends edges."""
    nodes, edges = _concepts(spark, sf_dir)
    own = edges.filter(F.col("parent").startswith("root/")).select(F.concat(F.lit("result::"), F.col("id")).alias("src"), F.concat(F.lit("result::"), F.col("parent")).alias("dst"), F.lit("extends").alias("relation"))
    first = nodes.filter("type = 'paragraph'").orderBy(F.length("id"), "id").first()["id"]
    return spark.createDataFrame(list(enumerate(GQ.ancestors(own, first))), "depth int, ancestor string")


@query(f"""with recursive {TREE_SQL}, e as (select regexp_replace(id, '/[^/]+$', '') as p, id from tree), b(id) as (select min(id) from tree where type = 'section' union select e.id from b join e on e.p = b.id) select id from b""")
def star_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that can be reached from the first region over numbered argument edges."""
    nodes, edges = _concepts(spark, sf_dir)
    own = edges.filter(F.col("parent").startswith("root/")).select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.concat(F.lit("arg:"), F.regexp_extract("id", "([0-9]+)$", 1)).alias("relation"))
    return GQ.reasoning_subgraph(own, nodes.filter("type = 'section'").agg(F.min("id")).first()[0])


@query("select c_mktsegment as segment, o_orderkey as orderkey, o_totalprice as price, rank from (select c_mktsegment, o_orderkey, o_totalprice, row_number() over (partition by c_mktsegment order by o_totalprice desc, o_orderkey)::int as rank from orders join customer on c_custkey = o_custkey) where rank <= 5")
def star_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest orders of each market segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return best(o, ["c_mktsegment"], F.desc("o_totalprice"), "o_orderkey", k=5).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"), "rank")


@query("""select '<op:region.' || r_regionkey || '> <op:kind> "section" .' as line from region union all select '<op:region.' || r_regionkey || '> <op:role> "segment" .' from region
union all select '<op:nation.' || n_nationkey || '> <op:kind> "definition" .' from nation union all select '<op:nation.' || n_nationkey || '> <op:role> "assert" .' from nation union all select '<op:region.' || n_regionkey || '> <op:contains> <op:nation.' || n_nationkey || '> .' from nation""")
def star_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as N-Triples."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("id"), F.lit("section").alias("kind"), F.lit("segment").alias("role"))
    n = table(spark, sf_dir, "nation")
    m = n.select(F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("id"), F.lit("definition").alias("kind"), F.lit("assert").alias("role"))
    rel = n.select(F.lit("star").alias("slug"), F.concat(F.lit("region."), F.col("n_regionkey").cast("string")).alias("subject"), F.lit("contains").alias("predicate"), F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("object"), F.lit(True).alias("resolved"))
    return L.ntriples(r.unionByName(m).withColumn("slug", F.lit("star")), rel).select("line")
