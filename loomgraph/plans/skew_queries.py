"""Queries of problem 6."""

from loomgraph.operators import skew
from loomgraph.session import table


def p6_found(spark, sf_dir):
    return skew.heavy_keys(table(spark, sf_dir, "predictions"))


def p6_per_key(spark, sf_dir):
    return skew.per_key(table(spark, sf_dir, "predictions"))


_KEYED = """
WITH k AS (
  SELECT 'repo_url' AS key_field, repo_url AS key_value, repo_url, filepath, confidence FROM predictions WHERE repo_url IS NOT NULL
  UNION ALL
  SELECT 'predicted_label', predicted_label, repo_url, filepath, confidence FROM predictions WHERE predicted_label IS NOT NULL)
"""

QUERIES = {"p6_found": p6_found, "p6_per_key": p6_per_key}
SQL = {
    "p6_found": _KEYED + "SELECT key_field, key_value FROM k GROUP BY 1, 2 HAVING count(*) * 20 >= (SELECT count(*) FROM predictions)",
    "p6_per_key": _KEYED
    + """, f AS (SELECT *, CASE WHEN filepath IS NOT NULL THEN coalesce(repo_url, '~null') || chr(1) || filepath END AS ent,
         CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS m FROM k)
    SELECT key_field, key_value, count(*)::BIGINT AS n_rows, count(DISTINCT ent)::BIGINT AS n_files,
      count(m)::BIGINT AS n_usable, round(avg(m), 6) AS mean_confidence FROM f GROUP BY 1, 2""",
}
