"""Near-duplicate detection by MinHash with tensored banding, every link confirmed on whole shingle sets.

A document's set is its distinct shingles of five words. Documents with equal sets are one class; one of each class
goes on. Its minhashes form two collections of ``halves`` short keys of ``rows`` minhashes each; the keys of the
tables are all pairs of a key of the first and one of the second collection: 2 * halves * rows minhashes serve
halves ** 2 tables. A pair with Jaccard similarity J shares a table unless a whole collection disagrees, with a
probability of at most 2 * (1 - J ** rows) ** halves: 7e-5 at 0.85 and 1e-8 at 0.93 with the given numbers. Short keys
that only one class has are dropped before keys are paired, so that documents without a relative cost little.

Links inside a bucket are found without making all pairs of a large one:

1. Every class is compared with the bucket's centre, the one whose short keys are the most common.
2. Buckets of at most ``small`` classes whose members are not yet connected compare those pairs.
3. The members of larger ones that are not yet connected are joined by prefix filtering on their whole sets: in the
   order of how many of them hold a shingle, two sets that are linked have one in common among the first of both, at
   places that leave room for as many common ones as a link needs. Each member's set is opened once, whatever the
   number and size of its buckets; shingles that one component holds alone make no pair and are only counted.

Defined results: A-Z are lower-cased; a text of fewer words is one shingle, null and empty texts have an empty set
and are linked with nothing; rows that share an id are one node, whatever their texts; a row without id is linked with
nothing and stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, lean, text_of
from tessera.llm.components import components
from tessera.llm.sketch import finish, text_shingles

#: Shingles that are hashed at a time.
SLICE = 1 << 18


def _multipliers(n: int) -> np.ndarray:
    return finish(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row of ``n`` minhashes for each set, none of them empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    return np.stack([np.minimum.reduceat(flat * m, starts) for m in _multipliers(n)], axis=1)


def short_keys(sets: list[np.ndarray], halves: int, rows: int) -> np.ndarray:
    """A row of 2 * ``halves`` short keys for each set; the key's place is part of it."""
    least = minhashes(sets, 2 * halves * rows).reshape(len(sets), 2 * halves, rows)
    key = np.broadcast_to(np.arange(2 * halves, dtype=np.uint64), least.shape[:2]).copy()
    for i in range(rows):
        key = finish(key * np.uint64(0x9E3779B97F4A7C15) + least[:, :, i])
    # The lowest bit says which collection a key belongs to.
    first = np.arange(2 * halves) < halves
    return (key & ~np.uint64(1)) | first.astype(np.uint64)


def signatures(docs: DataFrame, halves: int, rows: int) -> DataFrame:
    """``id``, ``h``, ``n`` (the size of its set), ``digest`` (of the set) and ``keys`` of each row (``id``, ``h``, ``text``)."""
    out = T.StructType([docs.schema["id"], T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(ids: list, hs: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            some = [s for s in sets if len(s)]
            keys = iter(short_keys(some, halves, rows).view(np.int64)) if some else iter(())
            made = [next(keys) if len(s) else None for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(hs, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(made, pa.list_(pa.int64()))], names=out.names)

        for batch in batches:
            id_type, ids, hs, sets, size = batch.column(0).type, [], [], [], 0
            for id_, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(id_)
                hs.append(h)
                sets.append(text_shingles(text.as_py()))
                size += len(sets[-1])
                if size > SLICE:
                    yield batch_of(ids, hs, sets)
                    ids, hs, sets, size = [], [], [], 0
            if ids:
                yield batch_of(ids, hs, sets)
        lean("near_dedup")

    return docs.select("id", "h", "text").mapInArrow(signed, out)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep`` and ``shingles`` (ascending, eight bytes each) of each class of ``wanted`` (``rep``, and ``id`` and ``h``
    of a row of it)."""
    out = T.StructType([wanted.schema["rep"], T.StructField("shingles", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("near_dedup")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=out.names)

    few = docs.join(wanted.hint("merge"), ["id", "h"]).dropDuplicates(["id", "h", "rep"])
    return durable(few.select("rep", "text").mapInArrow(cut, out), "sets")


def _linked(common: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * common >= percent * (n_a + n_b - common)


def _fits(p: str, q: str, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return (F.col(p) * 100 >= F.col(q) * percent) & (F.col(q) * 100 >= F.col(p) * percent)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b`` and ``linked`` of each pair, by whole sets."""
    id_type = pairs.schema["a"].dataType
    out = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("linked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                said.append(_linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(said, pa.bool_())], names=out.names)
        lean("near_dedup")

    met = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
    met = met.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")).hint("merge"), "b")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(run, out)


def _opened(sets: DataFrame) -> DataFrame:
    """``rep``, ``n``, ``component`` and ``elements`` of sets as bytes (``shingles``)."""
    out = T.StructType([sets.schema["rep"], sets.schema["n"], sets.schema["component"], T.StructField("elements", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("component"), pa.array(elements, pa.list_(pa.int64()))], names=out.names)
        lean("near_dedup")

    return sets.select("rep", "n", "component", "shingles").mapInArrow(read, out)


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a`` < ``b``) of ``members`` (``rep``, ``n``, ``component``) of different components, every linked one
    among them."""
    d = _opened(members.join(sets.hint("merge"), "rep")).select("rep", "n", "component", F.explode("elements").alias("element"))
    d = durable(d, "elements")
    uses = d.groupBy("element").agg(F.count(F.lit(1)).alias("uses"), F.min("component").alias("low"), F.max("component").alias("high"))
    uses = durable(uses.filter("low <> high").select("element", "uses"), "uses")
    own = Window.partitionBy("rep")
    d = d.join(uses.hint("merge"), "element")
    # Elements that only one component holds come first in the order; they take a place each.
    d = d.withColumn("at", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("uses", "element")) - 1)
    d = durable(d.filter((F.col("at") * 100 <= F.col("n") * (100 - percent))), "prefixes")
    left = d.toDF(*[f"l_{c}" for c in d.columns])
    need = F.ceil((F.col("l_n") + F.col("n")) * percent / (100 + percent) - F.lit(1e-6))
    on = (F.col("l_element") == F.col("element")) & (F.col("l_rep") < F.col("rep")) & (F.col("l_component") != F.col("component"))
    on = on & (F.col("l_at") + need <= F.col("l_n")) & (F.col("at") + need <= F.col("n")) & _fits("l_n", "n", percent)
    return left.join(d.hint("merge"), on).select(F.col("l_rep").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, halves: int = 14, rows: int = 4, small: int = 8) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` (the smallest id that links lead to) and
    ``kept`` (whether that is its own). Two sets link if 100 * common >= ``percent`` * union."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    signed = durable(signatures(base, halves, rows), "signatures")
    real = signed.filter("n > 0 and id is not null")
    classes = real.groupBy("digest").agg(F.min(F.struct("id", "h")).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    # Classes that share an id are linked by it.
    digest = F.xxhash64("digest")
    many = durable(signed.filter("id is not null").groupBy("id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select("id"), "many")
    holders = real.select("id", "digest").join(many.hint("merge"), "id", "left_semi").join(classes.select("digest", "rep").hint("merge"), "digest")
    holders = durable(holders.select("id", "rep").distinct(), "holders")
    firsts = durable(holders.groupBy("id").agg(F.min("rep").alias("a")), "firsts")
    by_id = holders.join(firsts.hint("merge"), "id").filter("a <> rep").select("a", F.col("rep").alias("b"))

    # Short keys that two classes share, by class; the centre of a bucket has the most common ones.
    each = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = durable(each.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1"), "keys")
    owned = each.join(shared.hint("merge"), "key").groupBy("rep", "n").agg(F.collect_list("key").alias("keys"), F.sum("uses").alias("score"))
    is_first = lambda k: k.bitwiseAND(1) == 1
    tables = owned.select("rep", "n", "score", F.explode(F.filter("keys", is_first)).alias("x"), F.filter("keys", lambda k: ~is_first(k)).alias("ys"))
    tables = tables.select("rep", "n", "score", "x", F.explode("ys").alias("y"))
    tables = durable(tables.select("rep", "n", "score", F.xxhash64("x", "y").alias("bucket")), "tables")
    best = F.max(F.struct(F.col("score"), (-F.col("rep")).alias("low"), F.col("n").alias("n"))).alias("best")
    buckets = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), best).filter("members > 1")
    buckets = durable(buckets.select("bucket", "members", (-F.col("best.low")).alias("centre"), F.col("best.n").alias("n_centre")), "buckets")
    inside = durable(tables.join(buckets.hint("merge"), "bucket").select("bucket", "members", "centre", "n_centre", "rep", "n"), "inside")

    stars = inside.filter("rep <> centre").filter(_fits("n", "n_centre", percent)).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    stars = durable(stars, "stars")
    wanted = inside.select("rep").distinct().join(classes.select("rep", "row.id", "row.h").hint("merge"), "rep")
    sets = _sets(base, wanted)
    links = durable(compared(stars, sets, percent).filter("linked").select("a", "b").unionByName(by_id), "starred")
    found = durable(components(links), "stars_found")

    # Members of buckets that are not yet connected: pairs of small ones, prefixes of large ones.
    where = F.coalesce("component", "rep")
    placed = inside.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("bucket", "members", "rep", "n", where.alias("component"))
    split = placed.filter(F.col("members") <= small).groupBy("bucket").agg(F.collect_set("component").alias("cs"), F.collect_list(F.struct("rep", "n", "component")).alias("ms")).filter("size(cs) > 1")
    pairs = split.select("ms", F.explode("ms").alias("p")).select("p", F.explode("ms").alias("q")).filter("p.rep < q.rep and p.component <> q.component")
    pairs = pairs.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m")).filter(_fits("n", "m", percent)).select("a", "b").distinct()
    large = durable(placed.filter(F.col("members") > small), "large")
    apart = large.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    wide = prefix_pairs(large.join(durable(apart, "apart").hint("merge"), "bucket", "left_semi").select("rep", "n", "component").distinct(), sets, percent)

    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = durable(pairs.unionByName(wide).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    more = durable(compared(rest, sets, percent).filter("linked").select("a", "b"), "links")
    found = durable(components(links.unionByName(more)), "components") if not more.isEmpty() else found

    # Every row's component, by way of its class and named by its smallest id; an empty row's by way of its id.
    placed = durable(found.withColumnRenamed("node", "rep").join(classes.select("rep", "row.id").hint("merge"), "rep"), "placed")
    least = durable(placed.groupBy("component").agg(F.min("id").alias("least")), "least_ids")
    placed = placed.join(least.hint("merge"), "component").select("rep", "least")
    named = classes.select("digest", "rep", "row.id").join(placed.hint("merge"), "rep", "left").select("digest", "rep", F.coalesce("least", "id").alias("component"))
    named = durable(named, "named")
    held = durable(firsts.join(named.select(F.col("rep").alias("a"), "component").hint("merge"), "a").select("id", "component"), "held")
    alone = signed.filter("n = 0 or id is null").join(held.hint("merge"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("component_id"))
    rest = signed.filter("n > 0 and id is not null").join(named.hint("merge"), "digest").select("id", "n", F.col("component").alias("component_id"))
    return rest.unionByName(alone).select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
