"""Fingerprints of whole documents, and of documents against the one that follows them.

See :mod:`tessera.llm.sketch` for the sketch. ``fingerprint`` is the operator; ``with_next`` deals documents out in
ascending id, so that each meets the next one while texts are shuffled just once: ranges of ids start at ids of the
table, found by approximate quantiles, and the first document of a range also goes to the range before it.

Defined results: a null text is empty; a null id sorts first; rows that share an id follow each other in the order
of their texts' hashes; the last document is followed by the first, a single one by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import sketch as S
from tessera.llm.common import text_of


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = S.SCALE) -> DataFrame:
    """``id`` and ``fingerprint`` of each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    out = T.StructType([rows.schema["id"], T.StructField("fingerprint", T.StringType())])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [S.written(S.sketch(t.as_py(), scale)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "fingerprint"])

    return rows.mapInArrow(written, out)


def _range_of(key: Column, starts: list[int]) -> Column:
    """How many of the ascending ``starts`` are at most ``key``, by halving."""
    if not starts:
        return F.lit(0)
    at, size = F.array(*[F.lit(s) for s in starts]), len(starts)
    steps = [1 << b for b in range(size.bit_length() - 1, -1, -1)]

    def halve(n: Column, step: Column) -> Column:
        return F.when((n + step <= size) & (F.get(at, n + step - 1) <= key), n + step).otherwise(n)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def with_next(docs: DataFrame, made: Callable[[Iterator[tuple]], Iterator[tuple]], out: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``made`` sees (id, text, next text, same) of each document in ascending id within a task, ``same`` being true
    if this document was the next one of the document before, and yields rows of ``out``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n) if n > 1 else F.array().cast("array<bigint>")
    least, nulls, cuts = rows.select("id").agg(F.min("id"), F.count(F.when(F.col("id").isNull(), 1)), cuts).first()
    starts = sorted({c for c in cuts or [] if nulls or c > least})
    place = F.when(F.col("id").isNull(), 0).otherwise(_range_of(F.col("id"), starts))
    is_start = F.col("id").isin(starts) if len(starts) < 10 else F.get(F.array(*[F.lit(s) for s in starts]), F.col("place") - 1) == F.col("id")
    is_first = F.col("id").isNull() if nulls else F.col("id") == F.lit(least)
    to = F.array(
        F.struct(F.col("place").alias("part"), F.lit(0).alias("turn"), F.lit(True).alias("own")),
        F.when((F.col("place") > 0) & is_start, F.struct((F.col("place") - 1).alias("part"), F.lit(0).alias("turn"), F.lit(False).alias("own"))),
        F.when(is_first, F.struct(F.lit(len(starts)).alias("part"), F.lit(1).alias("turn"), F.lit(False).alias("own"))),
    )
    dealt = rows.withColumn("place", place).withColumn("to", F.explode(F.filter(to, lambda t: t.isNotNull())))
    dealt = dealt.select("to.part", "to.turn", "to.own", "id", "text", F.xxhash64("text").alias("h"))
    # One range for each partition: hashed, some partitions would hold several ranges and others none.
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "turn", "id", "h").select("part", "own", "id", "text")
    arrow = to_arrow_schema(out)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, follows = None, False
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                if last is not None and last[1] and last[0] == row[0]:
                    yield last[2], last[3].as_py(), row[3].as_py(), follows
                    follows = True
                else:
                    follows = False
                last = row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

        for row in made(pairs(batches)):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if size > 4_000_000:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return dealt.mapInArrow(run, out)
