"""From raw documents to token ids in five stages; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import minhash, mixing, pii, sentencepiece_codec, toxicity
from factloom.llm.common import cut, release, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts stay, as do null ids; repeated rows share their fate. An empty
    table stays empty, and without labels of both kinds all stay whose rate is below a half."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, of least text."""
    columns = rows.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five-word shingles, 0.8) stays.

    Rows that repeat an id are one document, and that of least text stays. Of rows without an id one of each text
    stays, if no row with an id has it. Texts without words are no copies of each other. An empty table stays empty.
    """
    found = minhash.near_duplicates(docs, size=5)
    kept = docs.filter("doc_id is not null").join(found.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").select("doc_id")
    again = cut(again)
    if again.isEmpty():
        return kept
    out = kept.join(again, "doc_id", "left_anti").unionByName(_one_each(kept.join(again, "doc_id", "left_semi"), "doc_id").select(*docs.columns)).select(*docs.columns)
    nameless = docs.filter("doc_id is null").withColumn("_text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x09-\\x0D]", " ")) == ""
    known = docs.filter("doc_id is not null").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_text")).distinct()
    single = _one_each(nameless.filter(~blank).join(known, "_text", "left_anti"), "_text")
    return out.unionByName(single.select(*docs.columns)).unionByName(nameless.filter(blank).select(*docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with each private span replaced by its kind and n_chars, if there is such a column, counted
    anew. A null text counts as empty. Rows are independent: null and repeated ids stay as they are."""
    found = pii.detect(docs, carry=True)
    text = pii.redact(F.coalesce(F.col("row.text"), F.lit("")), F.col("spans"))
    fresh = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[fresh.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens by the target weights; no document twice, as copies have just been removed. Null lang or
    source counts as '', texts without words cost nothing. An empty table stays empty."""
    taken = mixing.mix(docs, share=(9, 10), max_epochs=1).filter("repeats > 0").select("doc_id").distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["doc_id"]), "left_semi")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document; null and empty texts have none."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", duplicates), ("personal_data", private), ("mixing", mixed), ("sentencepiece", encoded)]
#: Fitted models, sketches and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
