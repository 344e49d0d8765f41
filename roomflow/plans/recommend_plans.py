"""Recommendation queries: low-use room clusters (ML1) and upsell rules (ML2).

Oracles are restatements in plain SQL: the best cuts by one ordered window over
the rooms (and every pair of places for two cuts), and itemsets of every size by recursion over bit strings
of tenants (checking only, never on the Spark side).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.recommend import ml_product_upsell, ml_underutilized_rooms
from ..operators.utilization import utilization_metrics
from .catalog import bookings, register
from .utilization_plans import _util_sql

UPSELL_SUPPORT = 0.05  # the default; these baskets have ~0.5 M itemsets at sf0.01
UPSELL_CONFIDENCE = 0.3


_RUNNING_SQL = f"""
WITH util AS ({_util_sql(['room_id'])}),
room AS (SELECT room_id, AVG(utilization_pct) AS avg_utilization
         FROM util WHERE room_id IS NOT NULL GROUP BY room_id),
pts AS (SELECT room_id, avg_utilization, COALESCE(avg_utilization, 0.0) AS v FROM room),
tot AS (SELECT AVG(v) AS mean, COUNT(*) AS n FROM pts),
run AS (SELECT DISTINCT v, n, COUNT(*) OVER w AS n1, SUM(v - mean) OVER w AS s1
        FROM pts, tot WINDOW w AS (ORDER BY v RANGE UNBOUNDED PRECEDING)),"""
_LOWEST_SQL = """
SELECT room_id, avg_utilization, 0 AS cluster, TRUE AS ml_underutilized
FROM pts WHERE v <= (SELECT cut FROM best)"""


@register("ml_underutilized_rooms", f"""{_RUNNING_SQL}
best AS (SELECT v AS cut FROM run WHERE n1 < n ORDER BY s1 * s1 / (n1 * (n - n1)) DESC, v ASC LIMIT 1){_LOWEST_SQL}""",
          rounded=("avg_utilization",))
def ml_underutilized_rooms_q(spark, sf_dir):
    return ml_underutilized_rooms(utilization_metrics(bookings(spark, sf_dir)), n_clusters=2)


# The optimum over every pair of cuts (checking only: the Spark side takes linear passes).
@register("ml_room_clusters_k3", f"""{_RUNNING_SQL}
best AS (SELECT a.v AS cut FROM run a JOIN run b ON a.v < b.v WHERE b.n1 < b.n
         ORDER BY a.s1 * a.s1 / a.n1 + (b.s1 - a.s1) * (b.s1 - a.s1) / (b.n1 - a.n1)
                  + b.s1 * b.s1 / (b.n - b.n1) DESC, a.v ASC, b.v ASC LIMIT 1){_LOWEST_SQL}""",
          rounded=("avg_utilization",))
def ml_room_clusters_k3(spark, sf_dir):
    return ml_underutilized_rooms(utilization_metrics(bookings(spark, sf_dir)), n_clusters=3)


def _upsell_sql(support: float, max_size: int = 99) -> str:
    """Itemsets of every size as bit strings of tenants, extended by larger items."""
    return f"""
WITH RECURSIVE b AS (SELECT DISTINCT enterprise_name AS t, product_name AS i FROM bookings
           WHERE enterprise_name IS NOT NULL AND product_name IS NOT NULL),
nb AS (SELECT CAST(COUNT(DISTINCT enterprise_name) AS DOUBLE) AS n FROM bookings
       WHERE enterprise_name IS NOT NULL),
one AS (
  SELECT i, CAST(string_agg(CASE WHEN b.t IS NULL THEN '0' ELSE '1' END, '' ORDER BY u.t) AS BIT) AS ts
  FROM (SELECT DISTINCT t FROM b) u CROSS JOIN (SELECT DISTINCT i FROM b) p LEFT JOIN b USING (t, i) GROUP BY i
  HAVING CAST(COUNT(b.t) AS DOUBLE) / (SELECT n FROM nb) >= {support}),
s AS (
  SELECT [i] AS items, i AS last, ts, bit_count(ts) AS c FROM one
  UNION ALL
  SELECT list_append(s.items, one.i), one.i, s.ts & one.ts, bit_count(s.ts & one.ts)
  FROM s JOIN one ON one.i > s.last
  WHERE len(s.items) < {max_size}
    AND CAST(bit_count(s.ts & one.ts) AS DOUBLE) / (SELECT n FROM nb) >= {support}),
f AS (SELECT items, CAST(c AS DOUBLE) AS f FROM s),
c AS (SELECT f, items, unnest(items) AS a FROM f WHERE len(items) >= 2),
r AS (SELECT a, c.f, x.f AS fa, list_filter(c.items, lambda x: x <> a) AS cs
      FROM c JOIN f x ON x.items = [a] WHERE c.f / x.f >= {UPSELL_CONFIDENCE}),
m AS (SELECT a AS antecedent, cs, r.f / n AS support, r.f / fa AS confidence, y.f AS fc, n
      FROM r JOIN f y ON y.items = cs, nb)
SELECT antecedent, cs[1] AS consequent, array_to_string(cs, ', ') AS consequent_set,
       support, confidence, confidence / (fc / n) AS lift
FROM m"""


def _flat(rules):
    return rules.select("antecedent", "consequent",
                        F.array_join("consequents", ", ").alias("consequent_set"),
                        "support", "confidence", "lift")


@register("upsell_rules", _upsell_sql(UPSELL_SUPPORT))
def upsell_rules(spark, sf_dir):
    return _flat(ml_product_upsell(bookings(spark, sf_dir), min_support=UPSELL_SUPPORT,
                                   min_confidence=UPSELL_CONFIDENCE))


@register("upsell_pairs", _upsell_sql(UPSELL_SUPPORT, 2))
def upsell_pairs(spark, sf_dir):
    return _flat(ml_product_upsell(bookings(spark, sf_dir), min_support=UPSELL_SUPPORT,
                                   min_confidence=UPSELL_CONFIDENCE, max_consequents=1))
