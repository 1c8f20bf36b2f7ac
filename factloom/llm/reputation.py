"""URL filtering: rules on hosts and paths, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: (verdict, host and path). A rule fits its host and all its subdomains if the path starts with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels by default, a few common ones; any other suffix is the last label. A public suffix list can be
#: given in their place.
SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = "^(?s).*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where there is no `://`."""
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, PATTERN, 1), UPPER, LOWER), F.regexp_extract(whole, PATTERN, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def site_of(host: Column) -> Column:
    """The host that has a reputation: without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _levels(site: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (suffix and one label) and suffix of a site. An address is a domain of its own under the suffix
    `address`."""
    two = F.substring_index(site, ".", -2)
    long, address = two.isin(list(suffixes)), site.rlike("^[0-9.]+$|^\\[")
    domain = F.when(address, site).when(long, F.substring_index(site, ".", -3)).otherwise(two)
    return domain, F.when(address, "address").when(long, two).otherwise(F.substring_index(site, ".", -1))


def _strength(units: DataFrame) -> float:
    """The prior's weight in observations, by the method of moments over units with k of n good and prior mean m. Units that
    vary no more than chance get a strong prior, a single unit, which tells nothing, a weak one."""
    got = units.filter("n > 0").agg(
        F.sum(F.expr("n * pow(k / n - m, 2)")).alias("q"), F.sum(F.expr("m * (1 - m)")).alias("v"), F.sum("n").alias("t"),
        F.sum(F.expr("cast(n as double) * n")).alias("t2"), F.avg(F.expr("m * (1 - m)")).alias("a"), F.count("*").alias("j"))
    between = F.expr("(q - v * (j - 1) / j) / nullif(t - t2 / t, 0)")
    s = F.when(between > 0, F.col("a") / between - 1).when(between <= 0, F.lit(1e4)).otherwise(F.lit(1.0))
    return got.select(F.round(F.greatest(F.lit(1.0), F.least(F.lit(1e4), s)), 6).alias("s")).first()["s"]


def host_reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, n, k, posterior mean and sd, for outcomes (host, good) with good 1, 0 or null (not labelled).

    Each level's rate is shrunk to that of the level above it: all (with a uniform prior), suffix, registered
    domain, host. A host without labels has its domain's rate. Without any label every rate is 1/2. The hosts and each
    level's rates are written once; a level's prior weight is one number on the driver.
    """
    domain, suffix = _levels(F.col("host"), suffixes)
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
    hosts = cut(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    above, total = "top", [F.sum("n").alias("n"), F.sum("k").alias("k")]
    means = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).withColumn("top", F.lit(0))
    for name, by in (("suffix", ["suffix"]), ("domain", ["domain", "suffix"]), ("host", None)):
        level = hosts if by is None else hosts.groupBy(*by).agg(*total)
        level = level.withColumn("top", F.lit(0)) if above == "top" else level
        units = cut(level.join(F.broadcast(means) if above == "top" else means, above))  # at the top: one row
        units = units.withColumn("s", F.lit(_strength(units))).withColumn("p", F.expr("(k + s * m) / (n + s)"))
        means, above = units.select(name, F.col("p").alias("m")), name
    return units.select("host", "n", "k", F.col("p").alias("mean"), F.expr("sqrt(p * (1 - p) / (n + s + 1))").alias("sd"))


def judge(pages: DataFrame, labels: DataFrame, floor: float = 0.7, z: float = 1.645, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior mean and upper bound, for every row of pages.

    labels holds (page_id, good). A page that a rule fits has the rule's verdict. Any other is blocked if even
    the upper posterior bound (mean + z sd) of its host's rate of good pages is below floor, so hosts with few
    labels are not blocked on these alone. Null urls and urls without `://` have an empty host, judged like any
    other. The reputation is that of the host without user and port. If an id is labelled more than once, its
    smallest label counts. Null ids have no label. Rows that repeat an id are judged each by its own url, and the id's
    label counts for each of them. An empty table gives no rows.
    """
    host, path = split_url(F.col(url_col))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("says", says).withColumn("site", site_of(F.col("host")))
    one = labels.groupBy("page_id").agg(F.min("good").alias("good"))
    known = host_reputation(urls.select("page_id", F.col("site").alias("host")).join(one, "page_id", "left")).withColumnRenamed("host", "site")
    bound = F.expr(f"mean + {z} * sd")
    out = urls.join(known, "site", "left").withColumn("bound", bound)
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("bound") < floor, "block").otherwise("allow")).alias("verdict"), F.round("mean", 6).alias("host_rate"), F.round("bound", 6).alias("host_bound"))
