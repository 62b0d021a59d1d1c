"""Query op4: toxicity of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of
from tessera.llm.toxicity import Chain, score, train

#: The categories that ``labels`` has, in the chain's order.
CATEGORIES = {"junk": "1 - quality", "toxic": "toxic"}
#: On held-out rows nearly all clean documents stay below 0.2, and toxic ones that hold a telling word reach 0.4.
THRESHOLD = 0.4


def chain_of(docs: DataFrame, labels: DataFrame) -> Chain:
    return train(docs, labels, CATEGORIES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = chain_of(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", text_of("text").alias("text")), chain)
    out = scored.select("doc_id", F.col("probabilities")[0].alias("p_junk"), F.col("probabilities")[1].alias("p_toxic"))
    return out.withColumn("toxic", F.col("p_toxic") >= THRESHOLD).withColumn("kept", ~F.col("toxic"))
