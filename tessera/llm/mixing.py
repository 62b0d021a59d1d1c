"""Mixing sources to target weights at the level of fixed-length blocks of words.

The words of a source, its documents in a fixed pseudorandom order, are packed into blocks of ``block`` words. A
source's target gives it a quota of slots: whole epochs over its blocks and a part of one more. Output shards have
``shard`` slots each. Every slot draws a source with the quotas as weights, so a shard's counts by source are a
multinomial draw. A source's draws are numbered along the shards. Totals of such draws miss the quotas by about the
square root of a quota, which would be per cents of a small source, so they are corrected: draws beyond a source's
quota are surplus, numbered along the shards as well, and go one by one to the sources whose draws are too few. A
source's slots then have the numbers from 0 to its quota, each of which finds its block through the source's own
permutation of block indexes, one for each epoch, and blocks join documents by index.

A document's offset in its source is the sum of two prefix sums: over hashed buckets of a source, a fixed number,
and within a bucket. No source's documents are ever gathered in one task; the table of sources, a row each, is. The
permutations, the draws and the hash are plain 64-bit arithmetic, so runs agree on any cluster.

Defined results: a null text has size 0; a null source is a source of its own, sorted last; a document without words
takes none; a source without words has target 0; repeated rows each have their own place in the source; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, durable, packed, text_of

P = 4294967291  # the largest prime below 2**32
Q = 2147483647  # 2**31 - 1, a prime; Q - 1 has no factor 5
STEPS = (1000003, 999983, 999979)  # primes; the first that does not divide the length is used
ROUNDS = 8
BUCKETS = 65536
SHARD = 1024
#: Shards whose counts are added up together, before those sums are.
GROUP = 1024
#: Ranges that the draws are looked up by.
RANGES = 65536
#: Groups that surplus draws are numbered by.
SURPLUS = 64


def mixed(x: Column, key: Column) -> Column:
    """A hash of (x, key) below 2**32 in integer arithmetic that any SQL engine does alike."""
    h = ((x % P) * 1664525 + key * 22695477 + 1013904223) % P
    h = (h * 69069 + F.shiftright(h, 15)) % P
    return (h * 1103515 + F.shiftright(h, 13)) % P


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of ``x``, an index below ``n``, in a pseudorandom permutation: an affine step, then swap-or-not
    rounds, in each of which x and its partner swap or stay together.

    The rounds are folded rather than stacked as projections: a filter that Spark pushes down would otherwise
    repeat every round's expression inside the next.
    """
    step = F.when(n % STEPS[0] != 0, STEPS[0]).when(n % STEPS[1] != 0, STEPS[1]).otherwise(STEPS[2])

    def swap_or_not(x: Column, r: Column) -> Column:
        partner = (mixed(key, r) % n - x + n) % n

        def choose(p: Column) -> Column:
            coin = F.shiftright(mixed(F.greatest(x, p), key + r), 16).bitwiseAND(1)
            return F.when(coin == 1, p).otherwise(x)

        return F.get(F.transform(F.array(partner), choose), F.lit(0))

    rounds = F.sequence(F.lit(1).cast("bigint"), F.lit(ROUNDS).cast("bigint"))
    return F.aggregate(rounds, (x * step + mixed(key, F.lit(0))) % n, swap_or_not)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 128) -> DataFrame:
    """One row per source: ``source``, ``sid`` (its rank by code point, null last), ``source_size``, ``target``,
    ``blocks`` and ``slots``, with ``first_slot`` and ``all_slots``.

    Targets share all words by weight, none above ``most`` times its source: sources in the order in which a rising
    level would fill them are full as long as their cap is at most their share of what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", (F.row_number().over(every) - 1).cast("bigint"))
    per = per.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights)).cast("int")).cast("bigint"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "sid")
    cap = F.col("source_size") * most
    per = per.withColumn("before", F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("rest_w", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    per = per.withColumn("full", cap * F.col("rest_w") <= (F.col("total") - F.col("before")) * F.col("w"))
    per = per.withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), cap)).over(Window.partitionBy()), F.lit(0)))
    per = per.withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(Window.partitionBy()))
    share = ((F.col("total") - F.col("full_cap")) * F.col("w")).cast("double") / F.col("open_w")
    per = per.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(share))
    per = per.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    size = F.nullif(F.col("source_size"), F.lit(0))
    epochs = F.floor(F.col("target") / size)
    part = F.floor((F.col("target") - epochs * F.col("source_size")) * F.col("blocks") / size + 0.5)
    per = per.withColumn("slots", F.when(F.col("source_size") > 0, (epochs * F.col("blocks") + part).cast("bigint")).otherwise(0))
    per = per.withColumn("first_slot", F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    return durable(per.select("source", "sid", "source_size", "target", "blocks", "slots", "first_slot", "all_slots"), "targets")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def draws(sources: DataFrame, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """One row per slot: ``shard`` and ``at`` (its place there), the ``sid`` it drew, with ``slots`` and ``blocks`` of
    that source, and ``own``, the draw's number among the source's along the shards."""
    spark, every = sources.sparkSession, sources.agg(F.max("all_slots")).first()[0] or 0  # one number
    width = max(1, every // RANGES)
    slot = spark.range(every).select(F.expr(f"id div {shard}").alias("shard"), (F.col("id") % shard).alias("at"))
    # A fifth power is a permutation modulo Q; without it the draws of a shard would lie on a lattice, too evenly.
    slot = slot.withColumn("x", mixed(F.col("at"), F.col("shard") * 31 + seed) % (Q - 1) + 1).withColumn("x2", F.col("x") * F.col("x") % Q)
    slot = slot.withColumn("x5", F.col("x2") * F.col("x2") % Q * F.col("x") % Q)
    slot = slot.select("shard", "at", F.floor(F.col("x5").cast("double") / Q * every).alias("u")).withColumn("r", F.expr(f"u div {width}"))
    some = sources.filter("slots > 0").select("sid", "slots", "blocks", "first_slot")
    ranges = some.withColumn("r", F.explode(F.expr(f"sequence(first_slot div {width}, (first_slot + slots - 1) div {width})")))
    # A fixed number of tasks here and below: by their few bytes, Spark would put all slots into one.
    drawn = slot.join(ranges, "r").filter("first_slot <= u and u < first_slot + slots").repartition(_tasks(spark), "shard")
    each = Window.partitionBy("shard", "sid")
    drawn = drawn.withColumn("k", (F.row_number().over(each.orderBy("at")) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(each))
    drawn = durable(drawn.select("shard", "at", "sid", "slots", "blocks", "k", "n"), "draws")
    counts = drawn.filter("k = 0").select("shard", "sid", "n", F.expr(f"shard div {GROUP}").alias("group"))
    sums = counts.groupBy("sid", "group").agg(F.sum("n").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("sid", "group", before("sid", "group").alias("base"))
    base = counts.withColumn("within", before("sid", "group", "shard")).join(sums, ["sid", "group"]).select("shard", "sid", (F.col("base") + F.col("within")).alias("base"))
    return drawn.join(base, ["shard", "sid"]).select("shard", "at", "sid", "slots", "blocks", (F.col("base") + F.col("k")).alias("own"))


def slots(sources: DataFrame, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """One row per slot of the mix: ``shard`` and ``at`` (its place there), ``sid``, ``epoch`` and ``block``."""
    drawn = durable(draws(sources, shard, seed), "numbered")
    over = drawn.filter("own >= slots").select("shard", "at", (F.col("shard") % SURPLUS).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of a fixed number of parts
    base = over.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    over = over.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("shard", "at")) - 1).join(base, "part")
    over = over.select("shard", "at", (F.col("base") + F.col("k")).alias("g"))
    have = drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("have"))
    short = sources.filter("slots > 0").join(have, "sid", "left").select("sid", "blocks", "slots", F.coalesce("have", F.lit(0)).alias("have")).filter("have < slots")
    lacking = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("first", F.coalesce(F.sum(F.col("slots") - F.col("have")).over(lacking), F.lit(0)))
    short = short.withColumn("own", F.explode(F.expr("sequence(have, slots - 1)"))).select((F.col("first") + F.col("own") - F.col("have")).alias("g"), "sid", "blocks", "own")
    filled = over.join(short, "g").select("shard", "at", "sid", "blocks", "own")
    dealt = drawn.filter("own < slots").select("shard", "at", "sid", "blocks", "own").unionByName(filled)
    dealt = dealt.repartition(_tasks(sources.sparkSession), "shard", "at").withColumn("epoch", F.expr("own div blocks"))
    block = permuted(F.col("own") % F.col("blocks"), F.col("blocks"), F.col("sid") * 31 + F.col("epoch") + seed)
    # Never null, and said to be so: else a join on it would test that, before the slots are dealt out to tasks.
    return dealt.select("shard", "at", "sid", "epoch", F.coalesce(block, F.lit(0).cast("bigint")).alias("block"))


def placed(sizes: DataFrame, sources: DataFrame, block: int = 128) -> DataFrame:
    """One row per document and block that it has words in, and one for a document without words: ``n``, ``id``,
    ``size``, ``sid``, ``source_size``, ``target``, ``block`` and the document's words there, ``lo`` to ``hi``."""
    met = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("n", "id", "size", "sid", "source_size", "target")
    number = F.coalesce("id", F.lit(0)) if dict(sizes.dtypes)["id"] == "bigint" else F.xxhash64("id")
    met = met.withColumn("bucket", mixed(F.abs(number % P), F.col("size") + 1) % BUCKETS)
    sums = met.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["sid", "bucket"])
    met = met.withColumn("begin", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")
    last = F.expr(f"(begin + size - 1) div {block}")
    met = met.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"begin div {block}"), last))))
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("block") * block - F.col("begin"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("begin"))
    return met.withColumn("lo", lo).withColumn("hi", hi).drop("begin")


def plan(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 128, seed: int = 17, shard: int = SHARD) -> DataFrame:
    """One row per row of ``sizes`` (``n``, a number of its own; ``id``, ``source``, ``size``): ``n``, ``id``, ``size``,
    ``source_size``, ``target``, ``taken``, ``parts``, the word ranges that a part of an epoch takes, ``places``, for
    each epoch the first slot that holds words of it, counted along the shards, and ``last_place``, the last of all."""
    sources = targets(sizes, weights, most, block)
    drawn = slots(sources, shard, seed).join(sources.select("sid", F.expr("slots div nullif(blocks, 0)").alias("whole")), "sid")
    # A block has a slot for each epoch, most + 1 at the most.
    place = F.col("shard") * shard + F.col("at")
    firsts = [F.min(F.when(F.col("epoch") == e, place)).alias(f"place{e}") for e in range(most + 1)]
    drawn = drawn.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("epoch") >= F.col("whole")).alias("part"), F.max(place).alias("last_place"), *firsts)
    met = placed(sizes, sources, block).join(drawn, ["sid", "block"], "left")
    part = F.when(F.col("part"), F.struct(F.col("lo"), F.col("hi")))
    out = met.groupBy("n", "id", "size", "sid", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))), F.lit(0)).cast("bigint").alias("taken"), F.array_sort(F.collect_list(part)).alias("parts"),
        F.max("last_place").alias("last_place"), *[F.min(f"place{e}").alias(f"place{e}") for e in range(most + 1)],
    )
    return out.withColumn("places", F.array(*[f"place{e}" for e in range(most + 1)])).drop(*[f"place{e}" for e in range(most + 1)])


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 128, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard: int = SHARD, slot_col: str | None = None) -> DataFrame:
    """The mix as rows of ``docs``: a document comes once for each whole epoch, and once more with the words that the
    part of an epoch takes of it, if it takes any. A part's words are joined by single spaces unless it is the whole.
    The rows of a partition come in the order of the first slots that hold them, which ``slot_col`` names (``shard``
    and ``at``)."""
    base = durable(docs.select(F.monotonically_increasing_id().alias("n"), packed(docs).alias("row"), text_of(text_col).alias("text")), "mixing")
    sizes = base.select("n", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{source_col}`").alias("source"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("size"))
    chosen = plan(sizes, weights, most, block, seed, shard)
    part_words = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["hi"] - p["lo"])
    chosen = chosen.select("n", "size", "taken", "parts", "places", part_words.alias("part_words"))
    met = base.join(chosen, "n").filter("taken > 0 or part_words > 0")
    whole = F.expr("(taken - part_words) div size + if(part_words = size, 1, 0)").cast("int")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " "))
    copies = F.array_repeat(F.col("text"), whole)
    texts = F.when((F.col("part_words") > 0) & (F.col("part_words") < F.col("size")), F.concat(copies, cut)).otherwise(copies)
    out = met.select("row", "places", F.posexplode(texts).alias("epoch", "text"))
    out = out.select("row", "text", F.get("places", "epoch").alias("place")).sortWithinPartitions("place")
    named = [F.struct(F.expr(f"place div {shard}").alias("shard"), (F.col("place") % shard).alias("at")).alias(slot_col)] if slot_col else []
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *named)
