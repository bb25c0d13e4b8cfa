"""A corpus pipeline: toxicity, exact dedup, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, minhash, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't mark as toxic. Fitted on the labels of sf_dir and the texts at hand.

    A null or empty text has no evidence and stays; repeated rows are all kept or all dropped; an empty table gives none.
    """
    common.prepare(spark)
    model = toxicity.fit(common.id_text(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one stays, the one with the greatest id; a row without an id only where no equal text has one."""
    keepers = common.save(exact_dedup.dedup(docs).select("keep_id", F.col("text_sha256").alias("keep_sha")).distinct(), "keepers")
    marked = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = marked.join(keepers, marked["doc_id"].eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
    return kept.dropDuplicates(["doc_id", "sha"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more), the documents with the least id. Rows without an id stay.

    Texts without words, null ones among them, are linked with nothing and stay. Repeated rows of a kept id stay; an empty table gives none.
    """
    gone = common.save(minhash.near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct(), "near")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that aren't widely copied examples masked. Null texts stay null, repeated rows are masked alike, an empty table gives none."""
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets. Null and empty texts are a piece of the end mark alone, repeated rows are packed as often as they stand there, an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The classifier, MinHash and the tokenizer can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
