"""From raw documents to packed batches: quality rules, near-dedup, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of their input, whatever those are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.llm import mixing, near_dedup, packing, quality_hosts, suffix_dedup
from offersieve.llm.common import fresh, read, row_hash, same_row, write_table


#: A passage of over 50 words goes if it repeats.
WORDS = 51

#: Of 100: the Jaccard similarity of word shingles from which documents are near copies; 85 is op3's.
SIMILAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source")
    return quality_hosts.judge(whole, keep=("doc",)).filter("q_kept").select("doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; repeated rows count as one."""
    lead = near_dedup.near_duplicates(docs, per_hundred=SIMILAR).filter("row = lead_row AND kept").select("row", "doc_id").distinct()
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), row_hash("doc_id", "text").alias("h"))
    return whole.join(lead, same_row(whole, lead, "h", "row", left_id="id")).dropDuplicates(["id", "h"]).select("doc.*")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of over 50 words; a document of which nothing is left goes."""
    had = fresh(docs, "had")
    marked = docs.withColumn(had, F.trim(F.coalesce("text", F.lit(""))) != "")
    cut = suffix_dedup.cut_texts(marked, unit="word", width=WORDS, keep_first=True)
    kept = cut.filter(~F.col(had) | (F.trim("text") != "")).drop(had)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that it takes a document, by output shard."""
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source")
    return mixing.write_order(mixing.mix(whole, keep=("doc",))).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row of the mix."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: MinHash, the splitting tree and the packing program have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs)
    return docs
