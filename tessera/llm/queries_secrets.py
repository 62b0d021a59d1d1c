"""Query op1: secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.secrets import joined, scan

_KINDS = [
    ("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 2, r"[0-9a-f]+", 0, 16),
    ("token", 3, r"[A-Za-z0-9+/_-]{20,}", 0, 20),
]
_FOUND = """
SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, pos + off AS start, pos + off + length(hit) AS stop, value FROM (
  SELECT doc_id, source, unnest(hits) AS hit, unnest(vals) AS value, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(pieces[:i], lambda p: length(p)))))::BIGINT AS pos,
         unnest(list_transform(range(1, len(hits) + 1), lambda i: coalesce(list_sum(list_transform(hits[:i - 1], lambda p: length(p))), 0)))::BIGINT AS off
  FROM (SELECT doc_id, source, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals FROM texts WHERE regexp_matches(t, '{pattern}')))
WHERE length(value) >= {least}
"""
SQL = (
    "WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), found AS ("
    + " UNION ALL ".join(_FOUND.format(kind=k, rank=r, pattern=p, group=g, least=n) for k, r, p, g, n in _KINDS)
    + """), base AS (SELECT * FROM found WHERE rank < 3),
more AS (
  SELECT * FROM found f WHERE rank = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.stop AND f.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
owners AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners, count(DISTINCT coalesce(source, chr(0)) || chr(1) || doc_id) AS n_repos FROM every GROUP BY value),
judged AS (SELECT every.*, n_owners, n_repos, n_owners >= 3 OR n_repos >= 32 AS wide FROM every JOIN owners USING (value)),
docs AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3 OR n_owners = 1 AND NOT wide) AS spans,
    count(*) FILTER (wide) AS n_wide, count(*) FILTER (n_owners = 1 AND NOT wide) AS n_live, max(n_owners) AS owners, max(n_repos) AS repos
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_wide, 0) AS n_wide, coalesce(n_live, 0) AS n_live,
  coalesce(owners, 0) AS owners, coalesce(repos, 0) AS repos
FROM texts LEFT JOIN docs USING (doc_id)
"""
)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")

    def most(of: str):
        return F.coalesce(F.array_max(F.transform("counts", lambda c: c[of])), F.lit(0))

    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), "n_wide", "n_live",
        most("n_owners").alias("owners"), most("n_repos").alias("repos"),
    )
