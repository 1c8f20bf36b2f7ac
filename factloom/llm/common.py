"""Shared pieces: reading tables, cutting lineage and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Links that one task may hold.
SMALL = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local folder only where that is unset and all runs on one machine, as in
    tests. Anywhere else an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _stored(spark: SparkSession, path: str):
    """The file system and path object of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage. The table goes when
    the application ends, or when it is released."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _stored(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of cut that nothing reads any more; what was made from them must have been cut itself."""
    for df in tables:
        fs, at = _stored(df.sparkSession, df.cut_path)
        fs.delete(at, True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked with it) for the links a[i]-b[i], without the smallest nodes themselves."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.fromiter((root(x) for x in range(len(ids))), dtype=np.int64, count=len(ids))
    other = roots != np.arange(len(ids))
    return ids[other], ids[roots[other]]


def _contract(batches):
    """Within a partition, replace links by one link from each node to the smallest node it reaches."""
    parts = [(p["a"].to_numpy(), p["b"].to_numpy()) for p in batches if len(p)]
    if parts:
        a, b = forest(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each node of links (a, b) that is not the smallest of its component.

    Links are contracted within partitions first; then large-star and small-star steps alternate until
    nothing changes. A step is a grouped minimum, combined before the shuffle, and a join, which AQE splits
    if a node is hot. Where no more than SMALL links are left (counted; 16 bytes each), one task joins them all
    instead, with the same result. No links gives no rows.
    """

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum("a"), F.sum("b"), F.bit_xor(F.xxhash64("a", "b"))).first()

    links = links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = held = cut(links.mapInPandas(_contract, "a long, b long").distinct())
    if links.count() <= SMALL:
        return cut(links.coalesce(1).mapInPandas(_contract, "a long, b long")).select(F.col("a").alias("id"), F.col("b").alias("component"))
    before = signature(links)
    while before[0]:
        for small in (False, True):
            both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            if small:  # each node with its neighbours below it
                both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
            new = both.join(low, both.a == low.n)
            new = new.select("b", "m") if small else new.filter("b > a").select("b", "m")
            if small:
                new = new.unionByName(low.select(F.col("n").alias("b"), "m"))
            links = new.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        new = cut(links)
        release(held)
        links = held = new
        after = signature(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
