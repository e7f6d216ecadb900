"""SQL that several queries' definitions share."""

IMAGES = """raw AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings),
  ends AS (SELECT vec_id, min(x) AS low, max(x) AS high FROM raw GROUP BY vec_id),
  px AS (SELECT vec_id, k, k // 8 AS i, k % 8 AS j, CASE WHEN high > low THEN (x - low) / (high - low) ELSE 0 END AS v FROM raw JOIN ends USING (vec_id))"""


def _stencil(name: str, kernel: dict[tuple[int, int], float]) -> str:
    rows = ", ".join(f"({di}, {dj}, {w!r}::DOUBLE)" for (di, dj), w in kernel.items())
    return f"""{name} AS (SELECT p.vec_id, p.k, sum(q.v * w.w) AS v FROM px p CROSS JOIN (VALUES {rows}) AS w(di, dj, w)
  JOIN px q ON q.vec_id = p.vec_id AND q.i = 7 - abs(7 - abs(p.i + w.di)) AND q.j = 7 - abs(7 - abs(p.j + w.dj)) GROUP BY p.vec_id, p.k)"""


_X = {(-1, -1): -1, (0, -1): -2, (1, -1): -1, (-1, 1): 1, (0, 1): 2, (1, 1): 1}
_Y = {(b, a): w for (a, b), w in _X.items()}
_L = {(0, 0): -4, (-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1}
_B = (1, 4, 6, 4, 1)
_G = {(a - 2, b - 2): _B[a] * _B[b] / 256 for a in range(5) for b in range(5)}

F4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = "long AS (SELECT l_returnflag, feature, v FROM (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"
PAIRS = [(a, b) for k, a in enumerate(F4) for b in F4[k + 1 :]]
SERIES = "s AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"

CHART = f"""WITH RECURSIVE {SERIES}, m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events),
z AS (SELECT user_id, t, (value - m.m) / m.s AS z FROM s, m),
c AS (SELECT user_id, t, z, 0.2 * z AS ewma, greatest(0, z - 0.5) AS p, least(0, z + 0.5) AS n,
    CASE WHEN abs(z) >= 3 OR abs(0.2 * z) >= 3 * sqrt(0.2 / 1.8) OR greatest(0, z - 0.5) >= 5 OR abs(least(0, z + 0.5)) >= 5 THEN 1 ELSE 0 END AS run FROM z WHERE t = 0
  UNION ALL
  SELECT user_id, t, z, e, p, n, CASE WHEN abs(z) >= 3 OR abs(e) >= 3 * sqrt(0.2 / 1.8) OR p >= 5 OR abs(n) >= 5 THEN run + 1 ELSE 0 END
  FROM (SELECT z.user_id, z.t, z.z, 0.2 * z.z + 0.8 * c.ewma AS e, greatest(0, c.p + z.z - 0.5) AS p, least(0, c.n + z.z + 0.5) AS n, c.run FROM c JOIN z ON z.user_id = c.user_id AND z.t = c.t + 1)),
chart AS (SELECT user_id, t, round(ewma, 6) AS ewma, round(p, 6) AS cusum_pos, round(n, 6) AS cusum_neg, round(z, 6) AS z, CAST(run AS BIGINT) AS run,
  CASE WHEN run >= 3 THEN 'PERSISTENT_DRIFT' WHEN run > 0 THEN 'DRIFT_SIGNAL' ELSE 'STABLE' END AS status FROM c)"""

FORECASTS = f"""WITH RECURSIVE {SERIES}, l AS (SELECT user_id, t, value AS level FROM s WHERE t = 0 UNION ALL SELECT s.user_id, s.t, 0.3 * s.value + 0.7 * l.level FROM l JOIN s ON s.user_id = l.user_id AND s.t = l.t + 1),
d AS (SELECT user_id, avg(abs(value - b)) AS scale FROM (SELECT user_id, t, value, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS b FROM s) WHERE t BETWEEN 1 AND 9 GROUP BY user_id),
f AS (SELECT user_id, t, value AS actual, lag(value) OVER w AS persistence,
    avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS moving_average,
    regr_slope(value, t) OVER b * t + regr_intercept(value, t) OVER b AS linear_trend FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
made AS (SELECT f.*, l.level AS exponential_smoothing, d.scale FROM f JOIN l ON l.user_id = f.user_id AND l.t = f.t - 1 JOIN d ON d.user_id = f.user_id WHERE f.t >= 10)"""

TURNS = "e AS (SELECT DISTINCT conv_id * 1000 + turn AS id, conv_id * 1000 + greatest(turn - 1, 0) AS parent FROM conversations)"
ROOTS = f"""{TURNS}, walk AS (SELECT id, id AS here, parent AS nxt FROM e
  UNION ALL SELECT w.id, w.nxt, p.parent FROM walk w LEFT JOIN e p ON p.id = w.nxt WHERE w.nxt IS NOT NULL AND w.nxt <> w.here),
roots AS (SELECT id, here AS root FROM walk WHERE nxt IS NULL OR nxt = here)"""
