"""Secret scans with corpus-wide ownership frequency.

Base findings are three kinds of pattern matches. Beyond them, long tokens that mix letters and digits are
candidates. Every finding's value is hashed, and hashes are counted by distinct repositories and distinct owners
over the whole corpus: a value of many owners, or of very many repositories of one, is a widely copied example; a
value of one owner in a few repositories looks like a live credential. Such candidates are added to the findings as
kind ``token``; base findings always stay. How many owners and repositories have a value is given for each finding.
A table of documents has no column for repositories: there each document counts as one.

Defined results: a null text is empty; a null owner or repository is one of its own; repositories of different owners
are different; an empty table gives an empty result; repeated rows are scanned and counted like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, packed, text_of

# Fixed values of the contract. The bounded forms match what the open forms match and then keep.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "token"]

SPAN = "array<struct<start bigint, rank int, stop bigint, digest bigint>>"
COUNTS = "array<struct<start bigint, rank int, n_owners bigint, n_repos bigint, n_uses bigint>>"


def _matches(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has at least ``least`` code points.

    The pieces between the matches give the positions; texts without a match skip all of it.
    """
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["gap"])
        end = begin + F.length(m["all"])
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("stop"), F.xxhash64(m["value"]).alias("digest"))
        more = F.when(F.length(m["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("bigint").alias("at"), more.cast(SPAN).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(found, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide_owners: int = 3, wide_repos: int = 32) -> DataFrame:
    """One row per input row: ``id``; ``base`` and ``added`` spans (start, rank in KINDS, stop, digest of the value);
    ``n_wide``, its findings whose value has at least ``wide_owners`` owners or ``wide_repos`` repositories, and
    ``n_live``, those of one owner that are not wide; and ``counts``
    (start, rank, n_owners, n_repos, n_uses) of each finding's value, those of candidates that are not added too."""
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{owner_col}`").alias("owner"), F.col(f"`{repo_col}`").alias("repo"), text_of(text_col).alias("text"))
    base = F.concat(_matches(text, ASSIGN, 0, 2, ASSIGN_MIN), _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    found = rows.select("id", "owner", "repo", base.alias("base"), _matches(text, TOKEN, 3).alias("tokens"), F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")).alias("mixed"))
    mixed = F.transform("mixed", lambda t: F.xxhash64(t))
    free = F.filter("tokens", lambda t: F.array_contains(mixed, t["digest"]) & ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    # Written once: the scan is the dear part, and the row number must not change when a task runs again.
    found = durable(found.select(F.monotonically_increasing_id().alias("n"), "id", "owner", "repo", "base", free.alias("more")), "secrets")

    each = found.select("n", "owner", "repo", F.explode(F.concat("base", "more")).alias("span"))
    by_repo = each.groupBy(F.col("span.digest").alias("digest"), "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    counted = durable(by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("uses").alias("n_uses")), "owners")

    met = each.select("n", "span", F.col("span.digest").alias("digest")).join(counted.hint("merge"), "digest")
    wide = (F.col("n_owners") >= wide_owners) | (F.col("n_repos") >= wide_repos)
    live = (F.col("n_owners") == 1) & ~wide
    judged = met.groupBy("n").agg(
        F.collect_list(F.when((F.col("span.rank") == 3) & live, F.col("span"))).alias("added"),
        F.count(F.when(wide, 1)).alias("n_wide"), F.count(F.when(live, 1)).alias("n_live"),
        F.array_sort(F.collect_list(F.struct("span.start", "span.rank", "n_owners", "n_repos", "n_uses"))).alias("counts"),
    )
    out = found.join(judged, "n", "left")
    return out.select("id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), F.coalesce("n_wide", F.lit(0)).cast("bigint").alias("n_wide"), F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("counts", F.array().cast(COUNTS)).alias("counts"))
