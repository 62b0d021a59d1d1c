"""URL filters: a trie over reversed host labels and path segments, the longest match deciding.

A rule is (verdict, host, path). It fits its host and every subdomain when the url's path starts with the rule's
path as a string; a rule's last path segment may therefore be a part of a segment. Of the rules that fit, the one
with the most host labels wins, then the longest path; a block wins over an allow of the same host and path.

Defined results: the host of a null url, or one without ``://``, is empty, and so is its path; such urls, and those
that no rule fits, get the default verdict.
"""

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, packed


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, entry: str) -> "Rule":
        host, slash, path = entry.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def entry(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    """``below``: by next label or segment. ``ends``: rules whose last, perhaps partial, segment starts here."""

    below: dict[str, "_Node"] = field(default_factory=dict)
    paths: "_Node | None" = None
    ends: dict[str, Rule] = field(default_factory=dict)


class UrlTrie:
    def __init__(self, rules: list[Rule]):
        self.root = _Node()
        for rule in sorted(rules, key=lambda r: r.verdict != "block"):
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            node.ends.setdefault(last, rule)

    def match(self, host: str, path: str) -> Rule | None:
        best, node, segments = None, self.root, None
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None:
                segments = segments or path.split("/")
                best = self._path(node.paths, segments) or best
        return best

    @staticmethod
    def _path(node: _Node, segments: list[str]) -> Rule | None:
        best = None
        for at, segment in enumerate(segments):
            if node.ends:
                lengths = sorted({len(e) for e in node.ends})
                for n in reversed(lengths[: bisect.bisect_right(lengths, len(segment))]):
                    if (rule := node.ends.get(segment[:n])) is not None:
                        best = rule
                        break
            if at == len(segments) - 1 or (node := node.below.get(segment)) is None:
                break
        return best


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", max_broadcast: int = 50_000_000) -> DataFrame:
    """One row per page: ``row`` (the input row), ``host``, ``path``, ``rule`` and ``verdict``.

    The trie goes to every executor if the rules' text is at most ``max_broadcast`` bytes; a longer list is met by
    :func:`judge_by_join`, which broadcasts nothing of its own.
    """
    if sum(len(r.host) + len(r.path) for r in rules) > max_broadcast:
        spark = pages.sparkSession
        return judge_by_join(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), url_col, default)
    url = F.col(f"`{url_col}`")
    parts = pages.select(packed(pages).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    trie = pages.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("struct<rule string, verdict string>")
    def matched(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        built = UrlTrie(trie.value)
        for host, path in batches:
            found = [built.match(h, p) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame({"rule": [r and r.entry for r in found], "verdict": [r.verdict if r else default for r in found]})

    return parts.withColumn("m", matched("host", "path")).select("row", "host", "path", "m.rule", "m.verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """As :func:`judge`, for rule lists of any size. Each distinct (host, path) meets the lengths that the paths of its
    host's rules have, and of its parents' rules; each prefix of such a length meets the one rule that has it, in an
    equi-join. So a host with many rules and many urls meets no pairs of them. The longest rule that fits stays."""
    url = F.col(f"`{url_col}`")
    parts = pages.select(packed(pages).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = parts.select("host", "path").distinct().withColumn("parent", F.explode(parents))
    r = rules.select(F.col("host").alias("parent"), F.col("path").alias("prefix"), F.col("verdict").alias("v")).groupBy("parent", "prefix").agg(F.max(F.struct((F.col("v") == "block").cast("int"), "v")).alias("v"))
    lengths = r.groupBy("parent").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = asked.join(lengths, "parent").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    asked = asked.select("host", "path", "parent", F.substring("path", F.lit(1), F.col("n")).alias("prefix"))
    rank = F.struct(F.size(F.split("parent", r"\.", -1)), F.length("prefix"), F.concat("parent", "prefix").alias("rule"), F.col("v.v"))
    best = asked.join(r, ["parent", "prefix"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
