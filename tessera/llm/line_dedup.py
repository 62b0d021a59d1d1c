"""Line deduplication over a whole corpus.

Every line's normalised key is hashed to 128 bits and reduced, map-side first, to the smallest and largest id of the
documents that hold it. Keys of two or more documents meet the lines again in a join whose hot keys Spark splits;
each document then gets back the positions it loses, and is put together from the others in order.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys shorter than
``min_chars`` code points never drop. A key of ``threshold`` or more documents loses all its lines outside the
document with the smallest id.

Defined results: a null or empty text is one empty line; rows that share an id count as one document, and each of
them is put together from its own text; a null id is the largest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WS_CHARS, ascii_lower, durable, packed, text_of


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(WS_CHARS)))


def _hash(text: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, threshold: int = 2) -> DataFrame:
    """One row per input row: ``row`` (the input row), ``n_lines``, ``n_dropped`` and ``kept`` (the text that stays)."""
    base = docs.select(packed(docs).alias("row"), F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id")).alias("id"), text_of(text_col).alias("text"))
    base = base.withColumn("of", _hash(F.col("text")))
    lines = base.select("id", "of", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("line", line_key(F.col("line")))
    lines = lines.filter(F.length("line") >= min_chars).select("id", "of", "at", _hash(F.col("line")).alias("key"))
    if threshold == 2:
        spread = lines.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last")
    else:
        per_doc = lines.groupBy("key", "id").agg(F.lit(1).alias("one"))
        spread = per_doc.groupBy("key").agg(F.min("id").alias("first"), F.sum("one").alias("n")).filter(F.col("n") >= threshold)
    repeated = durable(spread.select("key", "first"), "lines")
    hit = lines.join(repeated.hint("merge"), "key").filter("id <> first")
    lost = hit.groupBy("id", "of").agg(F.collect_set("at").alias("lost"))
    # One pass binds the lines once: they are not split again for every position.
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1), "lost")
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda whole: F.array_join(F.transform(kept_at, lambda i: F.get(whole, i)), "\n"))
    met = base.join(lost, ["id", "of"], "left")
    return met.select(
        "row", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.get(kept, F.lit(0))).alias("kept"),
    )
