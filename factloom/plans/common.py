"""Tables, word and shingle columns, and joins that broadcast only what is small."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5
#: Rows up to which small() lets a table be broadcast.
SMALL_ROWS = 20_000

#: DuckDB's forms of words() and shingles().
SQL_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> '')"
SQL_SHINGLES = f"list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' '))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """Runs of SHINGLE words in order; none for a shorter text."""
    none = F.expr("cast(array() as array<string>)")
    at = F.sequence(F.lit(1), F.greatest(F.size(ws) - (SHINGLE - 1), F.lit(1)))
    return F.when(F.size(ws) >= SHINGLE, F.transform(at, lambda i: F.array_join(F.slice(ws, i, F.lit(SHINGLE)), " "))).otherwise(none)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has few rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def best(df: DataFrame, by: list[str], *order: Column | str, k: int = 1) -> DataFrame:
    """The first k rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def kept(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table in the checkpoint folder and read back, which is smaller than a checkpoint. What was
    shuffled to make it goes with the driver's garbage, which is collected here, as it may fill the disk before."""
    sc = df.sparkSession.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc._jvm.System.gc()
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)
