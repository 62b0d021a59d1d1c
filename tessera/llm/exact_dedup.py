"""Exact deduplication against a persistent digest index.

The index is a folder of tables bucketed and sorted by digest, beside a note of their layout. A batch is reduced to one
row per digest, met with the index in a sort-merge anti-join that moves no index row, and what is new is appended in
the same layout. Each append adds a file to each bucket; ``compact`` brings a bucket back to one sorted file.

Rows of the index carry the name of their batch. A batch that is judged again under the same name, as after a failure,
doesn't meet its own rows: it gets the result it got before, and appends nothing twice.

Defined results: a null text counts as empty; of equal texts the largest id stays (null is the smallest id);
rows repeated with that id leave one row in ``survivors``; an empty batch gives an empty result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint_dir, durable, packed, read_note, text_of, write_note


class DigestIndex:
    """A table (digest, keep_id, batch) bucketed and sorted by digest, below ``path``, which outlives the session: opened
    again it finds the digests that earlier sessions appended. The number of buckets and the type of the ids are fixed
    when it is made; asking for others later is a ValueError. ``close`` takes the table out of the session's catalogue."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str | None = None):
        self.spark = spark
        self.path = (path or f"{checkpoint_dir(spark).rstrip('/')}/digest_index_{uuid.uuid4().hex}").rstrip("/")
        layout = json.loads(read_note(spark, f"{self.path}/layout.json") or "{}")
        for what, asked in (("buckets", buckets), ("id_type", id_type)):
            if layout and asked is not None and asked != layout[what]:
                raise ValueError(f"the index at {self.path} has {what} {layout[what]}, not {asked}")
        self.layout = layout or {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "id_type": id_type or "bigint", "version": 0}
        if not layout:
            self._note()
        self._open()

    def _note(self) -> None:
        write_note(self.spark, f"{self.path}/layout.json", json.dumps(self.layout))

    def _open(self) -> None:
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {self.layout['id_type']}, batch STRING) USING parquet LOCATION '{self._at()}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.layout['buckets']} BUCKETS"
        )

    def _at(self) -> str:
        return f"{self.path}/v{self.layout['version']}"

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """The files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def known(self, but: str | None = None) -> DataFrame:
        """What the index holds, but for the rows of one batch."""
        found = self.spark.table(self.name)
        return found if but is None else found.filter(F.col("batch") != but)

    def _write(self, rows: DataFrame, name: str, at: str) -> None:
        n = self.layout["buckets"]
        rows.repartition(n, "digest").write.format("parquet").mode("append").bucketBy(n, "digest").sortBy("digest").saveAsTable(name, path=at)

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Add the digests (``digest``, ``keep_id``) that the index doesn't hold."""
        new = fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).join(self.known().select("digest").hint("merge"), "digest", "left_anti")
        # Written before the index changes: it must not be read while it is appended to.
        self._write(durable(new, "append"), self.name, self._at())

    def compact(self) -> None:
        """One sorted file for each bucket, in a new version of the folder; the note is switched last."""
        old, name, at = self.name, f"digest_index_{uuid.uuid4().hex}", f"{self.path}/v{self.layout['version'] + 1}"
        # By way of a plain table: dealing out a bucketed one is planned away, and files would not follow the buckets.
        self._write(durable(self.known(), "compact"), name, at)
        self.layout["version"] += 1
        self._note()
        self.name = name
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per input row: ``row`` (the input row), ``id``, ``digest``, ``keep_id``, ``group_size``, ``kept``,
    ``ties`` (rows of the group with the id that stays). Digests that are new are appended to the index.

    ``keep_id`` is the batch's largest id for a new digest and the index's id for a known one, of which no row stays.
    ``group_size`` counts the batch's rows. ``batch`` names the batch, so that it can be run again; a batch without a
    name is one of its own each time. The ids must have the index's type.
    """
    batch = batch or uuid.uuid4().hex
    if (given := dict(docs.dtypes)[id_col]) != index.layout["id_type"]:
        raise ValueError(f"{id_col} is {given}; the index holds {index.layout['id_type']}")
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(text_of(text_col), 256).alias("digest"))
    per_id = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("id"), F.col("n")))
    groups = durable(per_id.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("group_size")), "digests")
    groups = groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.n").alias("ties"), "group_size")
    fresh = durable(groups.join(index.known(batch).select("digest").hint("merge"), "digest", "left_anti"), "fresh")
    known = index.known(batch).select("digest", F.col("keep_id").alias("known_id"))
    old = groups.hint("merge").join(known, "digest").select("digest", F.col("known_id").alias("keep_id"), F.lit(0).cast("bigint").alias("ties"), "group_size")
    judged = durable(fresh.select(*old.columns).unionByName(old), "judged")
    index.append(fresh, batch)
    # Both sides of this join are shuffled for it alone, so that Spark splits the partition of a hot digest.
    met = rows.join(judged.hint("merge"), "digest")
    kept = (F.col("ties") > 0) & F.col("id").eqNullSafe(F.col("keep_id"))
    return met.select("row", "id", "digest", "keep_id", "group_size", kept.alias("kept"), "ties")


def survivors(judged: DataFrame) -> DataFrame:
    """The input rows that stay, one for each new text."""
    stay = judged.filter("kept")
    once = stay.filter("ties = 1").select("row.*")
    tied = stay.filter("ties > 1").dropDuplicates(["digest"]).select("row.*")
    return once.unionByName(tied)
