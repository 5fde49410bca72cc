"""The exact null distributions, bands and pooled cells in DuckDB SQL, by closed forms and joins of their own."""

from __future__ import annotations

from subsetlab.model import K, LOW, N


def comb(n: object, k: object) -> str:
    """Return n choose k as a double, 0 outside 0 <= k <= n."""
    return f"(CASE WHEN ({k}) < 0 OR ({n}) < ({k}) THEN 0 ELSE round(exp(lgamma(({n}) + 1.0e0) - lgamma(greatest(({k}), 0) + 1.0e0) - lgamma(greatest(({n}) - ({k}), 0) + 1.0e0))) END)"


ALL = comb(N, K)
_ODD = (N + 1) // 2
#: Values with their weights, by metric. Sums join three small numbers and three larger ones; largest gaps go by inclusion and exclusion.
_SIMPLE = {
    "min": (f"range(1, {N - K + 2})", comb(f"{N} - v", K - 1)),
    "max": (f"range({K}, {N + 1})", comb("v - 1", K - 1)),
    "range": (f"range({K - 1}, {N})", f"({N} - v) * {comb('v - 1', K - 2)}"),
    "odd": (f"range(0, {K + 1})", f"{comb(_ODD, 'v')} * {comb(N - _ODD, f'{K} - v')}"),
    "low": (f"range(0, {K + 1})", f"{comb(LOW, 'v')} * {comb(N - LOW, f'{K} - v')}"),
    "consecutive": (f"range(0, {K})", f"{comb(K - 1, 'v')} * {comb(N - K + 1, f'{K} - v')}"),
    "gap": (f"range(1, {N - K + 2})", comb(f"{N} - v", K - 1)),
    "min_gap": (f"range(1, {(N - 1) // (K - 1) + 1})", f"{comb(f'{N} - {K - 1} * (v - 1)', K)} - {comb(f'{N} - {K - 1} * v', K)}"),
}
_WITHIN = f"""SELECT v, sum(({N} - w) * sign * {comb(K - 1, 'j')} * {comb('w - j * v - 1', K - 2)}) AS c FROM (SELECT v, w, j, CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM (SELECT unnest(range(0, {N - K + 2})) AS v), (SELECT unnest(range({K - 1}, {N})) AS w), (SELECT unnest(range(0, {K})) AS j)) GROUP BY 1"""
PMF = f"""
nn AS (SELECT unnest(range(1, {N + 1})) AS x),
three AS (SELECT a.x + b.x + c.x AS s, a.x AS lo, c.x AS hi FROM nn a, nn b, nn c WHERE a.x < b.x AND b.x < c.x),
sums AS (SELECT l.s + u.s AS v, CAST(sum(l.w * u.w) AS DOUBLE) AS w FROM (SELECT hi, s, count(*) AS w FROM three GROUP BY 1, 2) l JOIN (SELECT lo, s, count(*) AS w FROM three GROUP BY 1, 2) u ON l.hi < u.lo GROUP BY 1),
within AS ({_WITHIN}),
pmf AS (SELECT 'sum' AS metric, CAST(v AS BIGINT) AS value, w / {ALL} AS prob FROM sums
  {"".join(f" UNION ALL SELECT '{m}', v, ({w}) / {ALL} FROM (SELECT unnest({r}) AS v)" for m, (r, w) in _SIMPLE.items())}
  UNION ALL SELECT 'max_gap', a.v, (a.c - b.c) / {ALL} FROM within a JOIN within b ON b.v = a.v - 1),
cum AS (SELECT metric, value, prob, sum(prob) OVER (PARTITION BY metric ORDER BY value) AS f, sum(prob) OVER (PARTITION BY metric ORDER BY value DESC) AS g FROM pmf)
"""


def binomial(x: str, n: str, p: str) -> str:
    """Return the chance of ``x`` out of ``n``."""
    return f"exp(lgamma({n} + 1.0e0) - lgamma({x} + 1.0e0) - lgamma({n} - {x} + 1.0e0) + {x} * ln({p}) + ({n} - {x}) * ln(1 - {p}))"


def band(cells: str, key: str) -> str:
    """Return (key, lo, hi): central 95 % quantiles of Binomial(n, p) for rows (key, n, p) of ``cells``."""
    return f"""SELECT {key}, min(x) FILTER (WHERE c >= 0.025e0) AS lo, coalesce(min(x) FILTER (WHERE c >= 0.975e0), any_value(n)) AS hi FROM (
  SELECT {key}, n, x, sum({binomial("x", "n", "p")}) OVER (PARTITION BY {key} ORDER BY x) AS c FROM (SELECT {key}, n, p, unnest(range(0, n + 1)) AS x FROM ({cells}) WHERE p < 1)) GROUP BY 1"""


#: Cells of the tests: outer values join their neighbour from either end until five are expected.
def test_cells(metric: str) -> str:
    own = f"SELECT value, prob, f, g, n FROM cum, total WHERE metric = '{metric}'"
    ends = f"SELECT min(value) FILTER (WHERE n * f >= 5) AS a, max(value) FILTER (WHERE n * g >= 5) AS b FROM ({own})"
    return f"""SELECT lo, hi, expected, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) WHEN hi = a THEN '<=' || hi ELSE '>=' || lo END AS cell FROM (
  SELECT least(greatest(value, a), b) AS k, min(value) AS lo, max(value) AS hi, sum(n * prob) AS expected, any_value(a) AS a FROM ({own}), ({ends}) GROUP BY 1)"""


#: Cells of the tables (label, first and last value, chance): units that are short of five expected form tails, which take in one more unit
#: if they are short as a whole. Sums are in bins of ten; consecutive pairs have fixed cells.
TABLE_CELLS = """
unit AS (SELECT metric, lo, hi, sum(prob) AS prob, any_value(trials) AS trials, row_number() OVER (PARTITION BY metric ORDER BY lo) AS i, count(*) OVER (PARTITION BY metric) AS m
  FROM (SELECT metric, prob, CASE WHEN metric = 'gap' THEN 5 * n ELSE n END AS trials, CASE WHEN metric = 'sum' THEN (value - 1) // 10 * 10 + 1 ELSE value END AS lo,
    CASE WHEN metric = 'sum' THEN least((value - 1) // 10 * 10 + 10, top) ELSE value END AS hi FROM pmf, total, (SELECT max(value) AS top FROM pmf WHERE metric = 'sum') WHERE metric <> 'consecutive') GROUP BY 1, 2, 3),
single AS (SELECT metric, min(i) FILTER (WHERE trials * prob >= 5) AS l, max(i) FILTER (WHERE trials * prob >= 5) AS r FROM unit GROUP BY 1),
tail AS (SELECT metric, l, r, coalesce(sum(trials * prob) FILTER (WHERE i < l), 0) AS below, coalesce(sum(trials * prob) FILTER (WHERE i > r), 0) AS above, any_value(m) AS m FROM unit JOIN single USING (metric) GROUP BY 1, 2, 3),
inner_part AS (SELECT metric, l + CASE WHEN l > 1 AND below < 5 THEN 1 ELSE 0 END AS l, r - CASE WHEN r < m AND above < 5 THEN 1 ELSE 0 END AS r FROM tail),
cell AS (SELECT metric, min(lo) AS lo, max(hi) AS hi, sum(prob) AS prob, any_value(trials) AS trials,
    CASE WHEN count(*) = 1 THEN CASE WHEN min(lo) = max(hi) THEN CAST(min(lo) AS VARCHAR) ELSE min(lo) || '-' || max(hi) END WHEN k < any_value(l) THEN '<=' || max(hi) ELSE '>=' || min(lo) END AS cell
    FROM (SELECT *, greatest(least(i, r + 1), l - 1) AS k FROM unit JOIN inner_part USING (metric)) GROUP BY metric, k
  UNION ALL SELECT 'consecutive', min(value), max(value), sum(prob), any_value(n), CASE WHEN min(value) < 3 THEN CAST(min(value) AS VARCHAR) ELSE '>=3' END FROM pmf, total WHERE metric = 'consecutive' GROUP BY least(value, 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY lo) - 1 AS place, metric || lo AS key FROM cell)
"""
