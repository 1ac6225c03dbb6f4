"""Queries of problem 7."""

from loomgraph.llm import group_split
from loomgraph.session import table


def _in(spark, d):
    return table(spark, d, "examples"), table(spark, d, "predictions")


def p7_found(spark, d):
    return group_split.torn(*_in(spark, d)).select("owner")


def p7_torn(spark, d):
    return group_split.torn(*_in(spark, d))


def p7_assign(spark, d):
    return group_split.assign(*_in(spark, d))


_TORN = r"""
WITH b AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(repo_url)), '[/\s]+$', ''), '(\.git)?/*$', '') AS u FROM predictions),
 o AS (SELECT DISTINCT regexp_extract(u, '([^/:]+)/([^/:]+)$', 1) AS owner, regexp_extract(u, '([^/:]+)/([^/:]+)$', 2) AS name FROM b WHERE u IS NOT NULL),
 e AS (SELECT lower(trim(split_part(filepath, '/', 1))) AS name, split FROM examples WHERE split IS NOT NULL),
 t AS (SELECT owner, count(*) FILTER (split = 'train')::BIGINT AS n_train, count(*) FILTER (split = 'val')::BIGINT AS n_val,
         count(*) FILTER (split = 'test')::BIGINT AS n_test FROM e JOIN o USING (name) WHERE owner <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1)
"""
QUERIES = {"p7_found": p7_found, "p7_torn": p7_torn, "p7_assign": p7_assign}
SQL = {"p7_found": _TORN + "SELECT owner FROM t", "p7_torn": _TORN + "SELECT * FROM t"}
