"""Mixing sources to target weights: a token budget goes down a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

LEVELS = ("domain", "lang", "source")
#: Weights of names among their siblings; any other name has weight 1.
WEIGHTS = {"domain": {"web": 3, "reference": 4, "forum": 2}, "lang": {"en": 4, "de": 2}, "source": {}}
#: Sources of each domain; any other source is of the domain forum.
DOMAINS = {"web": ("src0", "src1", "src2"), "reference": ("src3", "src4", "src5", "src6", "src7")}
#: Rows of a leaf that share a bucket at most on average; a bucket is one to five hexadecimal digits, three at least.
BUCKET_ROWS = 4_000
#: A leaf table of more rows than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 20_000


def domain_of(source: Column, domains=DOMAINS) -> Column:
    out = F.lit("forum")
    for name, members in domains.items():
        out = F.when(source.isin(list(members)), name).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long")


def _weight(level: str, weights) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def _fill(nodes: DataFrame, parent: list[str], level: str, weights) -> DataFrame:
    """Split each parent's budget among its children by weight, none over its capacity. What a child cannot take
    goes to its siblings by weight. Exact: whole tokens, and the rest by rounding goes to the first."""
    nodes = nodes.withColumn("w", _weight(level, weights))
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.nullif("w", F.lit(0).cast("decimal(38,0)"))).otherwise(0), level)
    nodes = nodes.withColumn("before", F.sum("cap").over(order) - F.col("cap"))
    nodes = nodes.withColumn("left", F.sum("w").over(Window.partitionBy(*parent)) - F.sum("w").over(order) + F.col("w"))
    nodes = nodes.withColumn("full", F.expr("cap * left <= w * (budget - before)"))
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("over", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    nodes = nodes.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    share = F.expr("w * over div open").cast("decimal(38,0)")
    nodes = nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(share))
    rest = F.col("budget") - F.sum("share").over(whole)
    nth = F.sum(F.when(~F.col("full"), 1)).over(order)
    nodes = nodes.withColumn("share", F.when(~F.col("full") & (nth <= rest), F.col("share") + 1).otherwise(F.col("share")))
    return nodes.withColumn("budget", F.col("share").cast("decimal(38,0)")).drop("w", "before", "left", "full", "over", "open", "share")


def budgets(leaves: DataFrame, share: tuple[int, int], max_epochs: int, weights=WEIGHTS, levels=LEVELS) -> DataFrame:
    """leaves (the levels, tokens) with budget: how many tokens each gives, at most max_epochs times its own. What lies below a
    weight of 0 gives none, and its share goes to the others."""
    open_ = F.lit(True)
    for level in levels:
        open_ = open_ & (_weight(level, weights) > 0)
    cap = leaves.withColumn("cap", F.when(open_, F.col("tokens") * max_epochs).otherwise(0).cast("decimal(38,0)"))
    total = F.expr(f"cast(least(sum(tokens) * {share[0]} div {share[1]}, sum(tokens) * {max_epochs}) as decimal(38,0))")
    above, parent = leaves.agg(total.alias("budget")), []
    for i, level in enumerate(levels):
        nodes = cap.groupBy(*levels[: i + 1]).agg(F.sum("cap").cast("decimal(38,0)").alias("cap"))
        nodes = nodes.crossJoin(F.broadcast(above)) if not parent else nodes.join(above, parent)  # one row above the first level
        above = _fill(nodes, parent, level, weights).select(*levels[: i + 1], "budget")
        parent = list(levels[: i + 1])
    return leaves.join(above, parent).withColumn("budget", F.col("budget").cast("long"))


def mix(docs: DataFrame, share: tuple[int, int] = (1, 2), max_epochs: int = 4, seed: int = 17, weights=WEIGHTS, domains=DOMAINS) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and repeats for every row of docs; repeats tells how often it is taken.

    The budget is share of all tokens (words). A leaf with budget b and t tokens gives each document b div t
    times; in the next epoch it gives the prefix, in the order of the hash of seed, epoch and doc_id, that b mod t
    tokens hold. The prefix is found from sums over hash buckets, more of them the more rows the largest leaf has; only
    rows of the one bucket where it ends are sorted. A weight of 0 takes nothing. Null lang or source counts as ''. Texts without words have 0 tokens and cost nothing. A leaf without
    tokens has no budget, and its documents are not taken. Repeated ids sit next to each other in the order.
    """
    rows = docs.select("doc_id", domain_of(F.coalesce("source", F.lit("")), domains).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), word_count(F.col("text")).alias("n_tokens"))
    rows = cut(rows)
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    most = leaves.agg(F.max("rows")).first()[0] or 0
    digits = next((d for d in (3, 4) if 16**d * BUCKET_ROWS >= most), 5)
    plan = budgets(leaves.drop("rows"), share, max_epochs, weights)
    plan = cut(plan.withColumn("whole", F.expr("coalesce(budget div nullif(tokens, 0), 0)")).withColumn("rest", F.expr("budget - whole * tokens")))
    n_leaves = plan.count()

    def with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan) if n_leaves <= BROADCAST_ROWS else plan, list(LEVELS))

    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    drawn = with_plan(rows, plan).withColumn("draw", draw).withColumn("bucket", F.conv(F.substring("draw", 1, digits), 16, 10).cast("int"))
    sums = drawn.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    end = sums.filter("upto > rest").groupBy(*LEVELS).agg(F.min("bucket").alias("last"), F.min(F.expr("upto - n")).alias("taken"))
    end = cut(end)
    drawn = drawn.join(F.broadcast(end) if n_leaves <= BROADCAST_ROWS else end, list(LEVELS), "left")
    out = ["doc_id", *LEVELS, "n_tokens"]
    sure = drawn.filter("last is null or bucket <> last").withColumn("repeats", F.expr("whole + if(rest > 0 and bucket < last, 1, 0)"))
    edge = drawn.filter("bucket = last").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("repeats", F.expr("whole + if(rest > 0 and taken + upto <= rest, 1, 0)"))
    return sure.select(*out, "repeats").unionByName(edge.select(*out, "repeats"))
