"""A corpus from documents to packed token sequences, in five stages.

Each stage takes the documents that the one before it kept, written as Parquet. All but the last give back the columns
of documents; the last gives the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.common import durable, table
from tessera.llm.exact_dedup import DigestIndex, deduplicate, survivors
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.queries_packing import digest, tokenizer_path
from tessera.llm.queries_toxicity import CATEGORIES, THRESHOLD, chain_of
from tessera.llm.toxicity import score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go; the others stay as they are, null texts too."""
    chain = chain_of(docs, table(spark, sf_dir, "labels"))
    at = f"probabilities of {', '.join(docs.columns)}"  # no column has this name
    toxic = F.get(F.col(f"`{at}`"), list(CATEGORIES).index("toxic")) >= THRESHOLD
    return score(docs, chain, out_col=at).filter(~toxic).drop(at)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    with DigestIndex(spark, id_type=dict(docs.dtypes)["doc_id"]) as index:
        return survivors(deduplicate(docs, index, batch="documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more) the document with the smallest doc_id stays."""
    gone = near_duplicates(docs, percent=80).filter("not kept").select(F.col("id").alias("gone")).distinct()
    return docs.join(durable(gone, "gone"), F.col("doc_id") == F.col("gone"), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target shares: documents repeat, go, or are cut as their source's blocks are drawn."""
    return mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as query op2 gives them."""
    return digest(pack(docs, tokenizer_path()))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("packing", packing)]

#: A trained classifier and a tokenizer are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
