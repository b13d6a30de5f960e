"""From raw documents to token ids: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, jaccard, langid, mixing, pii
from quantloom.llm.shared import repeated, small, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of removed or repeated documents: up to so many are broadcast, beyond it a shuffle joins them.
IDS_BROADCAST = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a null lang is filled in. Rejected ones go, null texts and those of no letter too."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _content(docs: DataFrame) -> F.Column:
    """A 64-bit hash of all of a row: rows with an equal one are equal."""
    return F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: the first by doc_id (null last), then by a hash of the row.

    Rows that share a doc_id but not their text are judged each by its text; of rows equal in all columns one stays, rows
    of null or empty texts, which are linked with nothing, included. An empty table gives no rows; other columns go.
    """
    docs = docs.select(*COLUMNS).withColumn("row", _content(docs))
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    found = jaccard.join(docs.select(name.alias("doc_id"), "text"))
    found = found.groupBy("doc_id").agg(F.first("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = stash(found.select("doc_id.row", (F.col("doc_id.row") == F.col("first.row")).alias("stays"), "n"), "pipeline_groups")
    kept = docs.join(small(found.where("not stays").select("row"), IDS_BROADCAST), "row", "left_anti")
    again = found.where("stays and n > 1").select("row")
    if not again.limit(1).count():
        return kept.select(*COLUMNS)
    again = small(again, IDS_BROADCAST)
    once = kept.join(again, "row", "left_semi").groupBy("row").agg(F.first(F.struct(*COLUMNS)).alias("doc")).select("doc.*")
    return kept.join(again, "row", "left_anti").select(*COLUMNS).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data is replaced by its kind, and n_chars follows the text.

    A null text stays null and its n_chars as it is; an empty one stays empty; repeated rows and repeated doc_ids are each
    redacted for itself; very long texts are searched whole; an empty table gives no rows; other columns go.
    """
    done = pii.redacted(docs.select(*COLUMNS), pii.learn(docs))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    Rows are told apart by a hash of all columns. Rows equal in all of them are rounded each for itself and come as often
    as all of them are taken, from one of them. A null source is a source; texts of no words, null ones included, are taken
    0 times; an empty table gives no rows; other columns go.
    """
    docs = docs.select(*COLUMNS).withColumn("row", _content(docs))
    taken = mixing.mix(docs.select(F.col("row").alias("doc_id"), "source", mixing.words(F.col("text")).alias("size")))
    taken = taken.groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0").withColumnRenamed("doc_id", "row")
    taken = stash(taken, "pipeline_taken")
    out = docs.join(small(taken.where("n = 1").select("row", "copies"), IDS_BROADCAST), "row")
    again = taken.where("n > 1").select("row", "copies")
    if again.limit(1).count():
        ids = small(again.select("row"), IDS_BROADCAST)
        once = docs.join(ids, "row", "left_semi").groupBy("row").agg(F.first(F.struct(*COLUMNS)).alias("doc")).select("row", "doc.*")
        out = out.unionByName(once.join(small(again, IDS_BROADCAST), "row"))
    return repeated(out, "copies", "copy", run=100).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and the decoded text of each row.

    Null and empty texts have no tokens; repeated rows come repeated; very long texts are encoded by pieces and whole; an
    empty table gives no rows; other columns are not looked at.
    """
    return bpe.encode(docs, bpe.tokenizer_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("token_ids", token_ids)]

#: Two of the stages are models, so SQL can't tell the rows; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stash(stage(spark, out, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, out, sf_dir)
