"""Queries over documents, pages, conversations and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import content_hash, normalize_markdown
from factloom.operators import checks, html, markdown
from factloom.plans.common import SHINGLE, SQL_SHINGLES, SQL_WORDS, best, kept, shingles, small, table, words

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select b.item_id, count(d.doc_id) as n_docs, min(d.doc_id) as first_doc from benchmark b
left join documents d on contains(d.text, b.text) group by b.item_id""")
def bench_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each benchmark item verbatim, the predicate by which symbols are grounded."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = d.join(small(b.select("item_id", F.col("text").alias("needle"))), F.contains("text", "needle")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc")


WORDS_SQL = f"""dw as (select doc_id, unnest({SQL_WORDS}) as w from documents), d as (select doc_id, w, count(*) as x from dw group by all),
bw as (select item_id, unnest({SQL_WORDS}) as w from benchmark), b as (select item_id, w, count(*) as y from bw group by all)"""


def _dots(spark: SparkSession, sf_dir: str, norms: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, item_id, dot; and item_id, m, the norm of each item. With norms, a document's product with itself as well, own.

    Texts are shuffled once, by document; all counts of a document are then made where it is, as each word's items come
    as one array.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("y"))
    items = b.groupBy("w").agg(F.collect_list(F.struct(F.lit(False).alias("own"), "item_id", "y")).alias("items"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    d = texts.select("doc_id", F.explode(words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("x"))
    met = d.join(small(items, 200_000), "w", "left" if norms else "inner")
    if norms:
        own = F.array(F.struct(F.lit(True).alias("own"), F.lit(None).cast(b.schema["item_id"].dataType).alias("item_id"), F.col("x").alias("y")))
        met = met.withColumn("items", F.when(F.col("items").isNull(), own).otherwise(F.concat(own, "items")))
    dots = met.select("doc_id", "x", F.explode("items").alias("i")).groupBy("doc_id", "i.own", "i.item_id").agg(F.sum(F.col("x") * F.col("i.y")).alias("dot"))
    return dots, b.groupBy("item_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("m"))


@query(f"""with w as (select lang, unnest({SQL_WORDS}) as word from documents), c as (select lang, word, count(*) as cnt from w group by all)
select lang, word, cnt, rank from (select *, row_number() over (partition by lang order by cnt desc, word)::int as rank from c) where rank <= 20""")
def doc_content_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent words of each language."""
    w = table(spark, sf_dir, "documents").select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("cnt"))
    return best(w, ["lang"], F.desc("cnt"), "word", k=20)


@query(f"""with {WORDS_SQL}, dots as (select doc_id, item_id, sum(x * y) as dot from d join b using (w) group by all),
dn as (select doc_id, sqrt(sum(x * x)) as n from d group by all), bn as (select item_id, sqrt(sum(y * y)) as m from b group by all),
c as (select doc_id, item_id, dot / (n * m) as cosine from dots join dn using (doc_id) join bn using (item_id)),
r as (select *, row_number() over (partition by doc_id order by round(cosine, 12) desc, item_id) as k from c)
select documents.doc_id, r.item_id as prior, round(coalesce(cosine, 0), 6) as cosine, case when cosine is null then 'no prior' when cosine >= 0.8 then 'near' when cosine >= 0.4 then 'related' else 'distinct' end as verdict
from documents left join (select * from r where k = 1) r using (doc_id)""")
def doc_nearest_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the benchmark item of highest cosine of word counts; ties go to the smaller item."""
    dots, m = _dots(spark, sf_dir, norms=True)
    n = F.sqrt(F.max(F.when(F.col("own"), F.col("dot"))).over(Window.partitionBy("doc_id")))
    c = dots.withColumn("n", n).filter("not own").join(small(m), "item_id").withColumn("cosine", F.col("dot") / (F.col("n") * F.col("m")))
    top = best(c, ["doc_id"], F.desc(F.round("cosine", 12)), "item_id").select("doc_id", F.col("item_id").alias("prior"), "cosine")
    verdict = F.when(F.col("cosine").isNull(), "no prior").when(F.col("cosine") >= 0.8, "near").when(F.col("cosine") >= 0.4, "related").otherwise("distinct")
    return table(spark, sf_dir, "documents").select("doc_id").join(top, "doc_id", "left").select("doc_id", "prior", F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"), verdict.alias("verdict"))


@query(f"""with {WORDS_SQL}, dots as (select doc_id, item_id, sum(x * y)::bigint as dot from d join b using (w) group by all)
select item_id, doc_id, dot, rank from (select *, row_number() over (partition by item_id order by dot desc, doc_id)::int as rank from dots) where rank <= 3""")
def doc_rank_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents of highest dot product for each benchmark item."""
    return best(_dots(spark, sf_dir)[0].select("item_id", "doc_id", "dot"), ["item_id"], F.desc("dot"), "doc_id", k=3)


@query(f"""with w as (select lang, unnest({SQL_WORDS}) as w from documents), v as (select lang, w, count(*)::bigint as x from w group by all),
n as (select lang, sqrt(sum(x::double * x)) as n from v group by lang), dots as (select a.lang as a, b.lang as b, sum(a.x::double * b.x) as dot from v a join v b using (w) group by all)
select x.lang as a, y.lang as b, round(coalesce(dot / (x.n * y.n), 0), 4) as similarity from n x, n y left join dots on dots.a = x.lang and dots.b = y.lang""")
def lang_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine matrix of the languages' word counts."""
    v = table(spark, sf_dir, "documents").select(F.col("lang").alias("id"), F.explode(words(F.col("text"))).alias("feature")).groupBy("id", "feature").agg(F.count("*").cast("double").alias("cnt"))
    from factloom.operators.retrieve import similarity_matrix

    return similarity_matrix(v)


SHINGLE_SQL = f"""dw as (select doc_id, {SQL_WORDS} as ws from documents), ds as (select doc_id, unnest({SQL_SHINGLES}) as s from dw),
bw as (select item_id, {SQL_WORDS} as ws from benchmark), bs as (select item_id, unnest({SQL_SHINGLES}) as s from bw),
dc as (select doc_id, s, count(*) as x from ds group by all), bc as (select item_id, s, count(*) as y from bs group by all),
dn as (select doc_id, sum(x) as n from dc group by all), bn as (select item_id, sum(y) as m from bc group by all),
cov as (select doc_id, item_id, sum(least(x, y))::bigint as hit from dc join bc using (s) group by all),
ranked as (select doc_id, item_id, hit, n, row_number() over (partition by doc_id order by hit desc, item_id) as k from cov join dn using (doc_id) join bn using (item_id) where m <= n),
prior as (select * from ranked where k = 1)"""


def _shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, item_id, s, x, y of shingles that a document and an item both have, n of each document and m of each item.

    Only what items have is counted by document: shingles meet those of the items, which are few, before anything is
    shuffled.
    """
    b = _shingle_rows(table(spark, sf_dir, "benchmark"), "item_id").groupBy("item_id", "s").agg(F.count("*").alias("y"))
    d = _shingle_rows(table(spark, sf_dir, "documents"), "doc_id").join(small(b, 200_000), "s")
    size = F.greatest(F.size(words(F.col("text"))) - (SHINGLE - 1), F.lit(0))
    n = table(spark, sf_dir, "documents").select("doc_id", size.alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    return d.groupBy("doc_id", "item_id", "s", "y").agg(F.count("*").alias("x")), n, b.groupBy("item_id").agg(F.sum("y").alias("m"))


def _shingle_rows(texts: DataFrame, key: str, distinct: bool = False) -> DataFrame:
    """key, s: the words are a column of their own, as an expression inside the lambda would run for every shingle."""
    found = shingles(F.col("ws"))
    return texts.select(key, words(F.col("text")).alias("ws")).select(key, F.explode(F.array_distinct(found) if distinct else found).alias("s"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared, n, m = _shared(spark, sf_dir)
    cov = shared.groupBy("doc_id", "item_id").agg(F.sum(F.least("x", "y")).alias("hit")).join(n, "doc_id").join(small(m), "item_id").filter("m <= n")
    return best(cov, ["doc_id"], F.desc("hit"), "item_id")


@query(f"""with {SHINGLE_SQL} select documents.doc_id, item_id as nearest_prior, round(coalesce(hit / n, 0), 4) as coverage, round(1 - coalesce(hit / n, 0), 4) as novelty
from documents left join prior using (doc_id)""")
def doc_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One less the largest share of a document's shingles that a benchmark item of no more shingles explains."""
    prior = _nearest(spark, sf_dir)
    cov = F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0))
    return table(spark, sf_dir, "documents").select("doc_id").join(prior, "doc_id", "left").select("doc_id", F.col("item_id").alias("nearest_prior"), F.round(cov, 4).alias("coverage"), F.round(1 - cov, 4).alias("novelty"))


@query(f"""with {SHINGLE_SQL}, left_over as (select p.doc_id, sum(greatest(0, x - coalesce(y, 0)))::bigint as residual, any_value(n)::bigint as n from prior p join dc using (doc_id) left join bc on bc.item_id = p.item_id and bc.s = dc.s group by p.doc_id)
select doc_id, residual, n from left_over""")
def doc_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of a document that its nearest prior leaves over, each taken away as often as the prior states it: all but
    those that the two share."""
    return _nearest(spark, sf_dir).select("doc_id", (F.col("n") - F.col("hit")).alias("residual"), "n")


def _cover_sql() -> str:
    rounds = [f"with {SHINGLE_SQL}, c0 as (select distinct doc_id, item_id, s from dc join bc using (s))"]
    for i in range(1, 9):
        rounds.append(f"p{i} as (select doc_id, item_id, n from (select doc_id, item_id, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, item_id) as k from c{i - 1} group by doc_id, item_id) where k = 1)")
        rounds.append(f"c{i} as (select c.* from c{i - 1} c where not exists (select 1 from p{i} p join c{i - 1} t on t.doc_id = p.doc_id and t.item_id = p.item_id where p.doc_id = c.doc_id and t.s = c.s))")
    picks = " union all ".join(f"select doc_id, {i} as round, item_id, n::bigint as n_covered from p{i}" for i in range(1, 9))
    return ",\n".join(rounds) + f"\n{picks}"


def doc_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cover of each document's shingles by benchmark items, until nothing more is covered."""
    left, picked, n = _shared(spark, sf_dir)[0].select("doc_id", "item_id", "s").checkpoint(), [], 0
    while left.limit(1).count():
        n += 1
        gain = left.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_covered"))
        pick = best(gain, ["doc_id"], F.desc("n_covered"), "item_id").select("doc_id", F.lit(n).alias("round"), "item_id", "n_covered").checkpoint()
        picked.append(pick)
        gone = left.join(pick.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").select("doc_id", "s")
        left = left.join(gone, ["doc_id", "s"], "left_anti").checkpoint()
    out = spark.createDataFrame([], "doc_id long, round int, item_id long, n_covered long")
    for p in picked:
        out = out.unionByName(p)
    return out


Q["doc_cover"], SQL["doc_cover"] = doc_cover, _cover_sql()


@query(f"""with dw as (select doc_id, {SQL_WORDS} as ws from documents), ds as (select distinct doc_id, unnest({SQL_SHINGLES}) as s from dw), n as (select doc_id, count(*) as n from ds group by all),
pairs as (select a.doc_id as child, b.doc_id as parent, count(*) as hit from ds a join ds b using (s) where a.doc_id <> b.doc_id group by all),
r as (select child, parent, hit / p.n as cov, row_number() over (partition by child order by p.n desc, hit / p.n desc, parent) as k from pairs join n c on c.doc_id = child join n p on p.doc_id = parent where p.n < c.n and 2 * hit >= p.n)
select child, parent, round(cov, 4) as parent_reuse from r where k = 1""")
def doc_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the largest document with strictly fewer shingles of which at least half recur in it.

    Documents with equal sets are of one size, so none is another's parent, and they have the same parents: the one of
    smallest id stands for them all. A shingle of one document only matches nothing, so all shingles are shuffled once, to
    keep those that several have. A parent must share one of its rarest shingles, all but half of them less one, so only
    these are joined to find pairs; the kept sets of a pair are then intersected.
    """
    texts = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", "text")
    again = texts.groupBy("doc_id").count().filter("count > 1").limit(1).count()

    def hashed(docs: DataFrame) -> DataFrame:
        rows = _shingle_rows(docs, "doc_id", distinct=True)
        return rows.distinct() if again else rows

    wide = "decimal(38,0)"
    s = hashed(texts).select("doc_id", F.xxhash64("s").alias("s"), F.crc32(F.col("s").cast("binary")).alias("c"))
    sets = s.groupBy("doc_id").agg(F.count("*").alias("n"), F.bit_xor("s").alias("x"), F.sum(F.col("s").cast(wide)).alias("y"), F.sum("c").alias("z"))
    same = ["n", "x", "y", "z"]
    sets = sets.checkpoint()
    members = sets.join(sets.groupBy(*same).agg(F.min("doc_id").alias("rep")), same).select("doc_id", "rep", "n").checkpoint()
    n = members.filter("doc_id = rep").select("doc_id", "n")
    own = hashed(texts.join(small(n.select("doc_id"), 1_000_000), "doc_id", "left_semi")).select("doc_id", F.xxhash64("s").alias("s"))
    # hashes that meet by chance only add to what is compared in full
    shared = kept(own.withColumn("df", F.count("*").over(Window.partitionBy("s"))).filter("df > 1"))
    every = Window.partitionBy("doc_id")
    ranked = shared.withColumn("at", F.row_number().over(every.orderBy("df", "s"))).withColumn("shared", F.count("*").over(every))
    # those of the document only stand first among the rarest
    rare = ranked.join(n, "doc_id").filter("at + n - shared <= n - ceil(n / 2) + 1").select(F.col("doc_id").alias("parent"), "s", F.col("n").alias("pn"))
    pairs = kept(rare.join(shared.join(n, "doc_id").select(F.col("doc_id").alias("child"), "s", F.col("n").alias("cn")), "s").filter("pn < cn").select("parent", "child", "pn").distinct())
    held = shared.groupBy("doc_id").agg(F.collect_list("s").alias("held"))
    both = pairs.join(held.select(F.col("doc_id").alias("parent"), F.col("held").alias("p")), "parent").join(held.select(F.col("doc_id").alias("child"), F.col("held").alias("c")), "child")
    hit = both.select("parent", "child", "pn", F.size(F.array_intersect("p", "c")).alias("hit"))
    good = hit.filter("2 * hit >= pn").withColumn("cov", F.col("hit") / F.col("pn"))
    parents = best(good, ["child"], F.desc("pn"), F.desc("cov"), "parent").select(F.col("child").alias("rep"), "parent", F.round("cov", 4).alias("parent_reuse"))
    return members.join(parents, "rep").select(F.col("doc_id").alias("child"), "parent", "parent_reuse")


@query("""select 'sha256:' || sha256(coalesce(text, ''))[1:16] as content_hash, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1""")
def doc_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


SPACE = "[\\t\\x0b\\f\\r\\x{85}\\p{Z}]"
SQL_NORMAL = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '(?s)<!--.*?-->', '', 'g'), '{SPACE}+(\\n|\\z)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\n\\t\\x0b\\f\\r\\x{{85}}\\p{{Z}}]+|[\\n\\t\\x0b\\f\\r\\x{{85}}\\p{{Z}}]+\\z', '', 'g')"


@query(f"""with a as (select doc_id, text, {SQL_NORMAL} as once from documents), b as (select doc_id, once, length(coalesce(text, '')) as before, {SQL_NORMAL.replace("coalesce(text, '')", "once")} as twice from a)
select doc_id, length(once)::int as normalized, (before - length(once))::int as removed, once = twice as idempotent from b""")
def doc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each normalized document, characters removed, and whether a second pass changes nothing."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), normalize_markdown(text).alias("once"))
    return d.select("doc_id", F.length("once").alias("normalized"), (F.length("t") - F.length("once")).alias("removed"), (F.col("once") == normalize_markdown(F.col("once"))).alias("idempotent"))


LINES_SQL = f"""with t as (select doc_id, string_split({SQL_NORMAL}, chr(10)) as ls from documents), l as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from t),
p as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start, line = '' as blank from l),
g as (select *, sum(blank::int) over (partition by doc_id order by i) as island from p),
b as (select doc_id, island, min(start)::bigint as start, max(start + length(line))::bigint as stop from g where not blank group by all)"""


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, id, start, end of runs of lines between blank ones; islands are numbered by the blank lines before."""
    lines = F.posexplode(F.split(normalize_markdown(F.coalesce("text", F.lit(""))), "\n", -1)).alias("i", "line")
    order = Window.partitionBy("doc_id").orderBy("i")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines).withColumn("start", F.sum(F.length("line") + 1).over(order) - F.length("line") - 1)
    rows = rows.withColumn("id", F.sum((F.col("line") == "").cast("int")).over(order)).filter("line <> ''")
    return rows.groupBy("doc_id", "id").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("end"))


@query(LINES_SQL + " select doc_id, count(*) as n_blocks, min(start) as first_start, max(stop) as last_end, max(stop - start) as longest from b group by doc_id")
def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _paragraphs(spark, sf_dir)
    return b.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.max(F.col("end") - F.col("start")).alias("longest"))


@query(LINES_SQL + """, pr as (select *, coalesce(max(stop) over (partition by doc_id order by start, stop, island rows between unbounded preceding and 1 preceding), 0) as prev from b),
n as (select doc_id, sum(length(line) + 1) - 1 as n from l group by doc_id)
select doc_id, sum(greatest(0, stop - greatest(start, prev)))::bigint as covered, sum(greatest(0, least(stop, prev) - start))::bigint as overlap, round(sum(greatest(0, stop - greatest(start, prev))) / any_value(n), 4) as ratio from pr join n using (doc_id) group by doc_id""")
def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a normalized document its blocks cover, and how far they overlap."""
    swept = checks.sweep(_paragraphs(spark, sf_dir), ["doc_id"])
    n = table(spark, sf_dir, "documents").select("doc_id", F.length(normalize_markdown(F.coalesce("text", F.lit("")))).alias("n"))
    return swept.join(n, "doc_id").select("doc_id", "covered", "overlap", F.round(F.col("covered") / F.col("n"), 4).alias("ratio"))


@query()
def doc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown structure of every document: nodes, deepest level and classified share."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("slug"), "text")
    return markdown.run_metrics(markdown.decompose(d))


@query("""with t as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages) select page_id, translate(tag, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as tag, count(*) as n from t group by all""")
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", tags.alias("t")).groupBy("page_id", F.lower("t").alias("tag")).agg(F.count("*").alias("n"))


@query()
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and items of every page as nodes with path ids."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("slug"), F.col("html").alias("text"))
    return markdown.node_rows(html.decompose(p, plain=True)).select("slug", "seq", "id", "type", "title", "depth", "ord")


HREF = "href=\"([^\"]*)\""


@query("""with h as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) as href from pages), p as (select distinct regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, count(*) as n_links, count(p.path) as resolved, count(*) - count(p.path) as external from h left join p on p.path = regexp_extract(h.href, '^([^?#]*)', 1) group by page_id""")
def page_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page, resolved if another page has that path, else external."""
    p = table(spark, sf_dir, "pages")
    h = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href")).withColumn("path", F.regexp_extract("href", "^([^?#]*)", 1))
    known = p.select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path")).distinct().withColumn("hit", F.lit(1))
    return h.join(known, "path", "left").groupBy("page_id").agg(F.count("*").alias("n_links"), F.count("hit").alias("resolved"), (F.count("*") - F.count("hit")).alias("external"))


@query("""with t as (select *, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role rows between unbounded preceding and 1 preceding) as asked from conversations)
select conv_id, turn, asked from t where role = 'assistant'""")
def conv_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest user turn before each assistant turn."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return c.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before)).filter("role = 'assistant'").select("conv_id", "turn", "asked")


@query("""select 'conv' || conv_id as subject, 'contains' as predicate, 'conv' || conv_id || '/' || role || '.' || row_number() over (partition by conv_id, role order by turn) as object from conversations""")
def conv_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of turns, with ids counted by role."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    top = F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    return c.withColumn("n", n).select(top.alias("subject"), F.lit("contains").alias("predicate"), F.concat(top, F.lit("/"), F.col("role"), F.lit("."), F.col("n").cast("string")).alias("object"))


@query("""select 'unknown label' as error, count(*) as n from labels where not coalesce(quality in (0, 1) and toxic in (0, 1), false)
union all select 'labelled twice', count(*) from (select doc_id from labels group by doc_id having count(*) > 1)
union all select 'no such document', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'not labelled', count(*) from documents where doc_id not in (select doc_id from labels)""")
def label_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the labels' vocabulary, uniqueness and exact match with the documents, counted."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id")
    known = F.coalesce(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1), F.lit(False))
    found = [("unknown label", l.filter(~known)), ("labelled twice", l.groupBy("doc_id").count().filter("count > 1")), ("no such document", l.join(d, "doc_id", "left_anti")), ("not labelled", d.join(l, "doc_id", "left_anti"))]
    out = None
    for name, bad in found:
        row = bad.agg(F.lit(name).alias("error"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""select lang, case when l.doc_id is null then 'none' when toxic = 1 then 'implausible' when quality = 1 then 'plausible' else 'uncertain' end as verdict, count(*) as n
from documents d left join labels l using (doc_id) group by all""")
def label_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts attached to documents, counted by language."""
    l = table(spark, sf_dir, "labels").withColumn("hit", F.lit(1))
    v = F.when(F.col("hit").isNull(), "none").when(F.col("toxic") == 1, "implausible").when(F.col("quality") == 1, "plausible").otherwise("uncertain")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(l, "doc_id", "left").groupBy("lang", v.alias("verdict")).agg(F.count("*").alias("n"))

