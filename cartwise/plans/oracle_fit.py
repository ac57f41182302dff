"""Logistic regression in plain SQL: the maximum-likelihood fit by Newton
steps, as an oracle for fitted models.

The optimum of the likelihood doesn't depend on how it is found, so scores of
a converged model can be compared row for row with these. One class is the
baseline; the others have a coefficient per feature. Each step solves a
linear system by elimination; features that depend on others (their pivot is
nothing) get coefficient 0, which leaves the fitted probabilities as they
are. The text is generated, its steps one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 12


def design(source: str, numeric: Sequence[str], categories: Sequence[str]) -> str:
    """CTEs from ``source`` (id, is_train, k: class number, features): lx (id,
    j, v) with the scaled non-zero features of all rows, ly (id, k) of the
    training rows, size (d features, n training rows)."""
    parts = [f"SELECT id, is_train, '{c}' AS f, CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} <> 0" for c in numeric]
    parts += [f"SELECT id, is_train, '{c}=' || CAST({c} AS VARCHAR), 1.0 FROM {source} WHERE {c} IS NOT NULL"
              for c in categories]
    entries = "\n  UNION ALL ".join(parts)
    return f"""
ly AS MATERIALIZED (SELECT id, k FROM {source} WHERE is_train),
entries AS MATERIALIZED (
  {entries}),
spread AS (
  SELECT f, sqrt((sum(v * v) - sum(v) * sum(v) / (SELECT count(*) FROM ly)) / ((SELECT count(*) FROM ly) - 1)) AS sd
  FROM entries WHERE is_train GROUP BY f),
numbered AS MATERIALIZED (SELECT f, sd, 1 + row_number() OVER (ORDER BY f) AS j FROM spread WHERE sd > 0),
lx AS MATERIALIZED (
  SELECT id, is_train, j, v / sd AS v FROM entries JOIN numbered USING (f)
  UNION ALL SELECT id, is_train, 1, 1.0 FROM {source}),
size AS MATERIALIZED (SELECT (SELECT 1 + count(*) FROM numbered) AS d, (SELECT count(*) FROM ly) AS n)"""


def _step(t: int, others: int) -> str:
    return f"""
margin{t} AS (
  SELECT id, k, sum(v * b[(k - 1) * d + j]) AS m
  FROM lx, size, (SELECT unnest(range(1, {others + 1})) AS k), beta{t} WHERE is_train GROUP BY id, k),
p{t} AS MATERIALIZED (
  SELECT id, k, exp(least(m, 30)) / (1 + sum(exp(least(m, 30))) OVER (PARTITION BY id)) AS p FROM margin{t}),
system{t} AS (
  SELECT (x.k - 1) * d + j AS r, {others} * d + 1 AS c, sum((CASE WHEN ly.k = x.k THEN 1 ELSE 0 END - p) * v) AS a
  FROM (SELECT * FROM p{t} JOIN lx USING (id)) x JOIN ly ON ly.id = x.id, size
  GROUP BY ALL
  UNION ALL
  SELECT (p.k - 1) * d + e.j, (q.k - 1) * d + f.j,
         sum(p.p * (CASE WHEN p.k = q.k THEN 1 ELSE 0 END - q.p) * e.v * f.v)
  FROM p{t} p JOIN p{t} q USING (id) JOIN lx e USING (id) JOIN lx f USING (id), size GROUP BY ALL),
matrix{t} AS (
  SELECT list(cells ORDER BY r) AS m FROM (
    SELECT r, list(coalesce(a, 0.0) ORDER BY c) AS cells
    FROM (SELECT unnest(range(1, {others} * d + 1)) AS r FROM size)
    CROSS JOIN (SELECT unnest(range(1, {others} * d + 2)) AS c FROM size)
    LEFT JOIN system{t} USING (r, c) GROUP BY r)),
solved{t}(s, m) AS (
  SELECT CAST(1 AS BIGINT), m FROM matrix{t}
  UNION ALL
  SELECT s + 1, CASE WHEN m[s][s] <= 1e-8 * (SELECT n FROM size)
    THEN list_transform(m, lambda cells, i: CASE WHEN i = s THEN list_transform(cells, lambda x: 0.0) ELSE cells END)
    ELSE list_transform(m, lambda cells, i: list_transform(cells, lambda x, c:
      CASE WHEN i = s THEN x / m[s][s] ELSE x - cells[s] / m[s][s] * m[s][c] END)) END
  FROM solved{t} WHERE s <= len(m)),
beta{t + 1} AS MATERIALIZED (
  SELECT list_transform(b, lambda x, i: x + m[i][len(m) + 1]) AS b
  FROM solved{t}, beta{t} WHERE s = len(m) + 1)"""


def fitted(classes: int, steps: int = STEPS) -> str:
    """CTEs on top of ``design``: scored (id, k, p), the probability of every
    class of every row."""
    others = classes - 1
    last = f"beta{steps}"
    return f"""
beta0 AS (SELECT list_transform(range({others} * d), lambda i: 0.0) AS b FROM size),""" \
        + ",".join(_step(t, others) for t in range(steps)) + f""",
margins AS (
  SELECT id, k, sum(v * b[(k - 1) * d + j]) AS m
  FROM lx, size, (SELECT unnest(range(1, {others + 1})) AS k), {last} GROUP BY id, k),
scored AS MATERIALIZED (
  SELECT id, k, exp(m) / (1 + sum(exp(m)) OVER (PARTITION BY id)) AS p FROM margins
  UNION ALL SELECT id, 0, 1 / (1 + sum(exp(m))) FROM margins GROUP BY id)"""
