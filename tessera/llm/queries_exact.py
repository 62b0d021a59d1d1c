"""Query op3: exact deduplication of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, table
from tessera.llm.exact_dedup import DigestIndex, deduplicate

SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches against one index, the larger ids first, so that of equal texts in both the largest id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    later = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    with DigestIndex(spark, id_type=dict(docs.dtypes)["doc_id"]) as index:
        judged = [deduplicate(docs.filter(half), index, batch=name).drop("row") for name, half in (("later", later), ("earlier", ~later))]
    judged = durable(judged[0].unionByName(judged[1]), "batches")
    # A text of both batches has a size in each.
    sizes = judged.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    met = judged.drop("group_size").join(sizes.hint("merge"), "digest")
    return met.selectExpr("id AS doc_id", "keep_id", "group_size", "kept", "digest AS text_sha256")
