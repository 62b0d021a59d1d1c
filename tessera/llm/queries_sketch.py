"""Query op8: fingerprints of all documents and of their edited texts."""

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm import sketch as S
from tessera.llm.common import table
from tessera.llm.fingerprints import with_next


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
    following = None
    for id_, text, next_text, same in pairs:
        own = following if same else S.sketch(text)
        following = S.sketch(next_text)
        other = edited(text, next_text)
        changed = S.sketch(other)
        yield id_, len(text), hashlib.sha256(other.encode()).hexdigest(), S.written(own), S.written(changed), S.containment(own, changed), S.containment(own, following)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    strings = ("edited_sha256", "fingerprint", "edited_fingerprint")
    out = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in strings]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )
    return with_next(docs, _rows, out)
