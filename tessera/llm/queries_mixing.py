"""Query op6: all documents mixed to target weights of their sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.common import durable, table

BLOCK, SEED = 128, 17


def _hash(x: str, key: str) -> str:
    a = f"(((({x}) % {mixing.P}) * 1664525 + ({key}) * 22695477 + 1013904223) % {mixing.P})"
    b = f"list_transform([{a}], lambda h: (h * 69069 + (h >> 15)) % {mixing.P})"
    return f"list_transform({b}, lambda h: (h * 1103515 + (h >> 13)) % {mixing.P})[1]"


def _permutation(source: str, name: str, col: str, length: str, key: str) -> str:
    a, b, c = mixing.STEPS
    steps = [f"{name}0 AS (SELECT * REPLACE (({col} * (CASE WHEN {length} % {a} <> 0 THEN {a} WHEN {length} % {b} <> 0 THEN {b} ELSE {c} END) + {_hash(key, '0')}) % {length} AS {col}) FROM {source})"]
    for r in range(1, mixing.ROUNDS + 1):
        steps.append(f"{name}{r}p AS MATERIALIZED (SELECT *, ({_hash(key, str(r))} % {length} - {col} + {length}) % {length} AS partner FROM {name}{r - 1})")
        steps.append(f"{name}{r} AS MATERIALIZED (SELECT * EXCLUDE (partner) REPLACE (CASE WHEN ({_hash(f'greatest({col}, partner)', f'({key}) + {r}')} >> 16) & 1 = 1 THEN partner ELSE {col} END AS {col}) FROM {name}{r}p)")
    return ", ".join(steps)


SQL = rf"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sizes GROUP BY source),
s2 AS (SELECT *, [5, 2, 1][sid % 3 + 1] AS w FROM s1),
s3 AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  sum(w) OVER (ORDER BY source_size::DOUBLE / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest_w, sum(source_size) OVER ()::BIGINT AS total FROM s2),
s4 AS (SELECT *, 3 * source_size * rest_w <= (total - before) * w AS isfull FROM s3),
s5 AS (SELECT *, coalesce(sum(3 * source_size) FILTER (isfull) OVER (), 0)::BIGINT AS full_cap, (sum(w) FILTER (NOT isfull) OVER ())::BIGINT AS open_w FROM s4),
s6 AS (SELECT source, sid, source_size, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks,
  CASE WHEN isfull THEN (3 * source_size)::DOUBLE ELSE ((total - full_cap) * w)::DOUBLE / open_w END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN (floor(target / source_size) * blocks + floor((target - floor(target / source_size) * source_size) * blocks / source_size + 0.5))::BIGINT ELSE 0 END AS slots FROM s6),
sources AS MATERIALIZED (SELECT *, sum(slots) OVER ()::BIGINT AS all_slots, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot FROM s7),
places AS (SELECT i // {mixing.SHARD} AS shard, i % {mixing.SHARD} AS pos, n FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT max(all_slots) AS n FROM sources))),
powers AS (SELECT shard, pos, n, {_hash("pos", f"shard * 31 + {SEED}")} % {mixing.Q - 1} + 1 AS x FROM places),
chances AS (SELECT shard, pos, floor(((x * x % {mixing.Q}) * (x * x % {mixing.Q}) % {mixing.Q} * x % {mixing.Q})::DOUBLE / {mixing.Q} * n)::BIGINT AS u FROM powers),
hits AS MATERIALIZED (SELECT shard, pos, sid, slots, blocks, row_number() OVER (PARTITION BY sid ORDER BY shard, pos) - 1 AS own FROM chances JOIN sources ON first_slot <= u AND u < first_slot + slots),
surplus AS (SELECT shard, pos, row_number() OVER (ORDER BY shard % {mixing.SURPLUS}, shard, pos) AS g FROM hits WHERE own >= slots),
lacking AS (SELECT sid, blocks, own, row_number() OVER (ORDER BY sid, own) AS g FROM (SELECT sid, blocks, unnest(range(slots)) AS own FROM sources) ANTI JOIN hits USING (sid, own)),
dealt AS (SELECT shard, sid, blocks, own // blocks AS epoch, own % blocks AS block FROM (
  SELECT shard, sid, blocks, own FROM hits WHERE own < slots UNION ALL SELECT shard, sid, blocks, own FROM surplus JOIN lacking USING (g))),
{_permutation("dealt", "d", "block", "blocks", f"sid * 31 + epoch + {SEED}")},
drawn AS (SELECT sid, block, count(*) AS times, min(shard) AS first_shard, max(shard) AS last_shard FROM d{mixing.ROUNDS} GROUP BY sid, block),
met AS (SELECT sizes.*, sid, source_size, target, {_hash(f"abs(doc_id % {mixing.P})", "size + 1")} % {mixing.BUCKETS} AS bucket FROM sizes JOIN sources ON sizes.source IS NOT DISTINCT FROM sources.source),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM met),
each AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1) ELSE [-1] END) AS block FROM placed)
SELECT doc_id, size, source_size, target, coalesce(sum(times * (least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}))), 0)::BIGINT AS taken,
  coalesce(min(first_shard), -1) AS first_shard, coalesce(max(last_shard), -1) AS last_shard
FROM each LEFT JOIN drawn USING (sid, block) GROUP BY doc_id, size, source_size, target
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sizes = durable(sizes.withColumn("n", F.monotonically_increasing_id()), "sizes")
    taken = mixing.plan(sizes, block=BLOCK, seed=SEED)
    shards = {"first_shard": F.array_min("places"), "last_shard": F.col("last_place")}
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", *[F.coalesce(F.floor(p / mixing.SHARD).cast("bigint"), F.lit(-1)).alias(k) for k, p in shards.items()])
