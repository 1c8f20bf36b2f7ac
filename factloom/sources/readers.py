"""Readers of manifests, document sources, corpora of results, concept graphs and property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.operators import graph as G

MANIFEST = "slug string, adapter string, origin string, formats array<string>, main string, bbl string, html string, external_ids map<string,string>, source_files array<string>, min_coverage double"
NODE_JSON = "id string, type string, role string, label string, title string, text string, depth int, `order` int, span struct<start:int,end:int>, content_sha256 string, attrs map<string,string>"
EDGE_JSON = "id string, source string, target string, relation string, resolved boolean, attrs map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def sources(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a missing file has none. Fields that hold objects where the schema says text keep their
    JSON."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def bundle(spark: SparkSession, folder: str, slug: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a written document, with seq in file order."""
    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn("seq", F.monotonically_increasing_id()).withColumn("slug", F.lit(slug))

    nodes = ordered(jsonl(spark, f"{folder}/nodes.jsonl", NODE_JSON)).withColumnRenamed("order", "ord")
    return nodes.withColumn("parent_id", F.when(F.col("id").contains("/"), F.regexp_replace("id", "/[^/]+$", ""))), ordered(jsonl(spark, f"{folder}/edges.jsonl", EDGE_JSON))


def corpus(spark: SparkSession, path: str, domain: str = "", domain_pos: int = 0) -> tuple[DataFrame, DataFrame]:
    """(results, facts) of a JSON object of results {key: {name, text, groundings, facts}}; keys that begin with an
    underscore are no results. result_pos and fact_pos keep the order of the file; expressions become canonical."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    raw.createOrReplaceTempView("_corpus")
    rows = spark.sql("select e.pos as result_pos, e.key as key, e.value as value from _corpus, lateral variant_explode(v) as e where e.key not like '\\_%'")
    keyed = rows.selectExpr("cast(result_pos as int) result_pos", "key", "variant_get(value, '$.name', 'string') name", "variant_get(value, '$.text', 'string') text", "cast(variant_get(value, '$.groundings') as map<string,string>) groundings", "variant_get(value, '$.facts') facts")
    keyed = keyed.withColumn("name", F.coalesce("name", "key"))
    keyed.createOrReplaceTempView("_results")
    facts = spark.sql("select name, result_pos, cast(f.pos as int) fact_pos, to_json(f.value) expr from _results, lateral variant_explode(facts) as f")
    facts = facts.withColumn("expr", X.canonical(F.col("expr")))
    results = keyed.select(F.lit(domain).alias("domain"), F.lit(domain_pos).alias("domain_pos"), "result_pos", "key", "name", "text", "groundings")
    return results, facts


def corpora(spark: SparkSession, registry: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Results and facts of several (domain, path), in this order; result_pos counts through all of them."""
    results = facts = None
    for pos, (domain, path) in enumerate(registry):
        r, f = corpus(spark, path, domain, pos)
        shift = F.col("result_pos") + F.lit(pos << 32)  # a corpus may have as many results as an int counts
        r, f = r.withColumn("result_pos", shift), f.withColumn("result_pos", shift)
        results, facts = (r, f) if results is None else (results.unionByName(r), facts.unionByName(f))
    return results, facts


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results and facts of a file of pairs: {base, target}, or {key: {source, target}}; name is key and side."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    raw.createOrReplaceTempView("_cases")
    one = spark.sql("select e.key as side, e.value as value, '' as key from _cases, lateral variant_explode(v) as e where e.key in ('base', 'target')")
    many = spark.sql("select s.key as side, s.value as value, e.key as key from _cases, lateral variant_explode(v) as e, lateral variant_explode(e.value) as s where e.key not like '\\_%' and s.key in ('source', 'target') and variant_get(e.value, '$.source') is not null")
    rows = one.unionByName(many).selectExpr("key", "side", "coalesce(variant_get(value, '$.name', 'string'), concat_ws(':', nullif(key, ''), side)) name", "variant_get(value, '$.text', 'string') text", "cast(variant_get(value, '$.groundings') as map<string,string>) groundings", "variant_get(value, '$.answer_symbol', 'string') answer_symbol", "variant_get(value, '$.blank_symbol', 'string') blank_symbol", "variant_get(value, '$.facts') facts")
    rows.createOrReplaceTempView("_sides")
    facts = spark.sql("select name, cast(f.pos as int) fact_pos, to_json(f.value) expr from _sides, lateral variant_explode(facts) as f").withColumn("expr", X.canonical(F.col("expr")))
    return rows.drop("facts"), facts


def from_dgroup(dgroup: DataFrame) -> DataFrame:
    """Facts of a concept graph's predicates (slug, part, pred, args): attributes, then relations, then higher order."""
    from pyspark.sql import Window

    place = F.when(F.col("part") == "attribute", 0).when(F.col("part") == "relation", 1).otherwise(2)
    expr = F.to_json(F.concat(F.array("pred"), "args"))
    at = F.row_number().over(Window.partitionBy("slug").orderBy(place, "pred", "args")) - 1
    return dgroup.select(F.col("slug").alias("name"), at.alias("fact_pos"), expr.alias("expr"))


def property_graph(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of a saved graph, checked as insertions are; missing attrs and provenance are empty."""
    none = F.expr("cast(map() as map<string,string>)")
    nodes = jsonl(spark, nodes_path, "id string, kind string, label string, attrs map<string,string>, provenance string").withColumn("seq", F.monotonically_increasing_id())
    edges = jsonl(spark, edges_path, "src string, dst string, relation string, attrs map<string,string>, provenance string").withColumn("seq", F.monotonically_increasing_id())
    nodes, edges = (d.withColumn("attrs", F.coalesce("attrs", none)).withColumn("provenance", F.coalesce("provenance", F.lit(""))) for d in (nodes, edges))
    merged, conflicts = G.merge_nodes(nodes)
    kept, errors = G.merge_edges(edges, merged)
    return merged, kept, errors.unionByName(conflicts.select(F.col("id").alias("src"), F.lit("").alias("dst"), F.lit("").alias("relation"), F.lit("conflict").alias("error")))
