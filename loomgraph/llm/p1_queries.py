"""Queries of problem 1."""

from loomgraph.llm import sampling
from loomgraph.session import table


def _in(spark, d):
    return table(spark, d, "predictions"), table(spark, d, "label_targets")


def p1_found(spark, d):
    return sampling.report(*_in(spark, d)).where("short").select("profile", "label")


def p1_plan(spark, d):
    return sampling.plan(*_in(spark, d)).drop("target_pct", "min_rows")


def p1_sample(spark, d):
    return sampling.draw(*_in(spark, d)).withColumnRenamed("id", "ord")


_USABLE = r"""
WITH u AS (SELECT ord, lower(regexp_replace(predicted_label, '^\s+|\s+$', '', 'g')) AS label FROM predictions WHERE confidence BETWEEN 0 AND 1),
 rows_ AS (SELECT * FROM u WHERE label IN (SELECT label FROM label_targets)),
 size_ AS (SELECT count(*) // 5 AS size FROM rows_),
 n AS (SELECT label, count(*) AS usable FROM rows_ GROUP BY 1),
 t AS (SELECT profile, label, target_pct, min_rows, coalesce(usable, 0)::BIGINT AS usable, size::BIGINT AS size,
         greatest(min_rows, (size * target_pct + 99) // 100)::BIGINT AS wanted FROM label_targets LEFT JOIN n USING (label), size_)
"""
_SAMPLE = (
    _USABLE
    + """, r AS (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY md5('seat:' || ord::VARCHAR), ord) AS rank FROM rows_),
 p AS (SELECT profile, t.label, ord, rank, size, rank <= min_rows AS floor_,
   CASE WHEN target_pct > 0 THEN (2 * rank - 1)::DOUBLE / target_pct END AS pri FROM r JOIN t USING (label) WHERE rank <= min_rows OR target_pct > 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY floor_ DESC, pri NULLS LAST, label) AS place FROM p),
 drawn AS (SELECT profile, label, ord, rank FROM o WHERE place <= size)
"""
)
QUERIES = {"p1_found": p1_found, "p1_plan": p1_plan, "p1_sample": p1_sample}
SQL = {
    "p1_found": _USABLE + "SELECT profile, label FROM t WHERE usable < wanted",
    "p1_plan": _SAMPLE
    + """SELECT profile, label, usable, size, coalesce(seats, 0)::BIGINT AS seats, wanted, usable < wanted AS short
      FROM t LEFT JOIN (SELECT profile, label, count(*) AS seats FROM drawn GROUP BY 1, 2) USING (profile, label)""",
    "p1_sample": _SAMPLE + "SELECT profile, label, ord, rank::BIGINT AS rank FROM drawn",
}
