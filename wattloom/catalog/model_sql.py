"""SQL texts of ridge fits, bias gates and training tables, for the checks of everything that is fitted."""

from __future__ import annotations

from wattloom.catalog.views import weather_at

def ridge_ctes(rows: str, keys: list[str], features: list[str], y: str, keep: int, ridge: float = 0.01, min_rows: int = 30, name: str = "fit", level: bool = False) -> str:
    """CTEs ending in ``name`` (keys, n, kept, coef): forward selection by elimination on the correlations of each key.

    The matrix is a list of lists, features first and the target last; each recursive step eliminates the feature that
    takes most from the residual.  Keys of fewer rows have no row.  With ``level`` the first of the features within a millionth
    of the best is taken, so that rounding does not choose between multiples of one feature, and covariances are summed around means.
    """
    k, by = len(features), ", ".join(keys)
    cols = [f"coalesce(CAST({f} AS DOUBLE), 0.0)" for f in features] + [f"CAST({y} AS DOUBLE)"]
    c = [f"c{i}" for i in range(1, k + 2)]
    pair = "covar_pop({}, {})" if level else "sum({} * {})"
    cross = ", ".join("[" + ", ".join(pair.format(c[min(i, j)], c[max(i, j)]) for j in range(k + 1)) + "]" for i in range(k + 1))
    end, all_, some = k + 1, f"range(1, {k + 2})", f"range(1, {k + 1})"
    live = "sd[{i}] > 1e-9"
    first = "list_position(list_transform(g, lambda x: x >= list_max(g) * (1.0 - 1e-6)), true)" if level else "list_position(g, list_max(g))"
    cell = (f"CASE WHEN j = {end} THEN CASE WHEN i = {end} THEN v[i][j] WHEN {live.format(i='i')} THEN v[i][j] / sd[i] ELSE 0.0 END WHEN i = {end} THEN 0.0 "
            f"WHEN {live.format(i='i')} AND {live.format(i='j')} THEN v[i][j] / (sd[i] * sd[j]) + CASE WHEN i = j THEN {ridge} ELSE 0.0 END WHEN i = j THEN 1.0 ELSE 0.0 END")
    return f"""{name}_x AS (SELECT {by}, {', '.join(f'{e} AS {n}' for e, n in zip(cols, c))} FROM {rows} WHERE {y} IS NOT NULL),
    {name}_s AS (SELECT {by}, count(*) AS n, [{', '.join(f'avg({x})' for x in c)}] AS mean, [{cross}] AS p FROM {name}_x GROUP BY {by} HAVING count(*) >= {min_rows}),
    {name}_v AS (SELECT {by}, n, mean, list_transform({all_}, lambda i: list_transform({all_}, lambda j: {'p[i][j]' if level else 'p[i][j] / n - mean[i] * mean[j]'})) AS v FROM {name}_s),
    {name}_d AS (SELECT *, list_transform({all_}, lambda i: sqrt(greatest(v[i][i], 0.0))) AS sd FROM {name}_v),
    {name}_e AS (
        SELECT {by}, n, mean, sd, 0 AS step, CAST([] AS BIGINT[]) AS chosen, list_transform({all_}, lambda i: list_transform({all_}, lambda j: {cell})) AS a, v[{end}][{end}] AS vy FROM {name}_d
        UNION ALL
        SELECT {by}, n, mean, sd, step + 1, list_append(chosen, b), list_transform({all_}, lambda i: list_transform({all_}, lambda j: CASE WHEN i = b THEN a[b][j] / a[b][b] ELSE a[i][j] - a[i][b] * a[b][j] / a[b][b] END)), vy
        FROM (SELECT *, {first} AS b, list_max(g) AS best FROM (
            SELECT *, list_transform({some}, lambda i: CASE WHEN {live.format(i='i')} AND NOT list_contains(chosen, i) THEN a[i][{end}] * a[i][{end}] / a[i][i] ELSE -1.0 END) AS g FROM {name}_e)
            WHERE step < {keep}) WHERE best > 1e-12 * vy AND sd[{end}] > 1e-9),
    {name}_b AS (SELECT *, list_transform({some}, lambda i: CASE WHEN list_contains(chosen, i) THEN a[i][{end}] / sd[i] ELSE 0.0 END) AS slope FROM {name}_e QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY step DESC) = 1),
    {name} AS (SELECT {by}, n, chosen AS kept, list_prepend(mean[{end}] - list_sum(list_transform({some}, lambda i: slope[i] * mean[i])), slope) AS coef FROM {name}_b)"""


def linear(features: list[str], coef: str = "coef") -> str:
    """Score, not below 0."""
    return f"greatest({coef}[1] + " + " + ".join(f"{coef}[{i}] * coalesce(CAST({f} AS DOUBLE), 0.0)" for i, f in enumerate(features, 2)) + ", 0.0)"


FILLED = """(SELECT meter_id, ts, coalesce(last_value(demand_kwh IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS UNBOUNDED PRECEDING),
    first_value(demand_kwh IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS demand_kwh FROM grid)"""


def steps_ctes(rows: str, name: str = "steps") -> str:
    """The features a step-by-step forecast can rebuild."""
    w = "(PARTITION BY meter_id ORDER BY ts)"
    return f"""{name} AS (SELECT *, {', '.join(f'lag(demand_kwh, {n}) OVER {w} AS lag_{n}' for n in (1, 2, 24, 48, 168))},
        avg(demand_kwh) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rmean_24,
        sin(hour(ts) * 2.0 * pi() / 24.0) AS hour_sin, cos(hour(ts) * 2.0 * pi() / 24.0) AS hour_cos, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM {rows})"""


TABLE = f"""filled AS MATERIALIZED {FILLED}, {steps_ctes('filled')},
    tbl AS MATERIALIZED (SELECT s.*, temperature, greatest(temperature - 25.0, 0.0) AS cooling_deg FROM steps s
        LEFT JOIN weather wx ON {weather_at('s')} WHERE lag_168 IS NOT NULL)"""


def gate_ctes(rows: str, y: str, p: str, min_rows: int, min_scored: int, val_share: float = 0.15, name: str = "gate") -> str:
    """CTEs ending in ``name`` (meter_id, trail_mbe_raw, trail_mbe_capped, bias_gate) for predictions that are not below 0."""
    return f"""{name}_d AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) > floor(count(*) OVER (PARTITION BY meter_id) * (1.0 - {val_share})) AS _v,
        ts > max(ts) OVER (PARTITION BY meter_id) - INTERVAL 21 DAYS AS _t FROM {rows}),
    {name}_s AS (SELECT meter_id, avg({y}) AS mean, avg({p} - {y}) FILTER (_t) AS raw, count(*) FILTER (_t) AS nt, count(*) FILTER (_v) AS nv FROM {name}_d GROUP BY 1),
    {name}_c AS (SELECT *, greatest(least(raw * 0.5, mean * 0.3), -mean * 0.3) AS cand FROM {name}_s),
    {name}_e AS (SELECT meter_id, count(*) AS ns, avg(abs({y} - {p}) / {y} * 100.0) AS mr, avg(abs({y} - greatest({p} - cand, 0.0)) / {y} * 100.0) AS mc FROM {name}_d JOIN {name}_c USING (meter_id) WHERE _v AND {y} > 0.5 GROUP BY 1),
    {name}_g AS (SELECT c.*, CASE WHEN nt >= {min_rows} AND nv >= {min_rows} AND abs(cand) > 0.5 AND ns >= {min_scored} THEN CASE WHEN mc + 0.1 < mr THEN 'applied' ELSE 'gated_out' END ELSE 'below_threshold' END AS bias_gate
        FROM {name}_c c LEFT JOIN {name}_e USING (meter_id)),
    {name} AS (SELECT meter_id, CASE WHEN nt >= {min_rows} THEN raw ELSE 0.0 END AS trail_mbe_raw, CASE WHEN bias_gate = 'applied' THEN cand ELSE 0.0 END AS trail_mbe_capped, bias_gate FROM {name}_g)"""


def metrics(y: str, p: str, low: str = "NULL", high: str = "NULL") -> str:
    """Point metrics as one struct literal."""
    err = f"CASE WHEN {y} > 0.5 THEN abs({y} - {p}) / {y} * 100.0 END"
    return (f"coalesce(avg({err}), 0.0) AS mape, avg(abs({y} - {p})) AS mae, avg({p} - {y}) AS mbe, sqrt(avg(({y} - {p}) * ({y} - {p}))) AS rmse, "
            f"CASE WHEN var_pop({y}) * count(*) > 1e-12 THEN 1.0 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*)) ELSE 0.0 END AS r2, "
            f"coalesce(100.0 * count(*) FILTER ({err} <= 5) / nullif(count({err}), 0), 0.0) AS within5, coalesce(100.0 * count(*) FILTER ({err} <= 10) / nullif(count({err}), 0), 0.0) AS within10, "
            f"100.0 * avg(CAST({y} BETWEEN {low} AND {high} AS INTEGER)) AS coverage_80")


def training_ctes(features: list[str], keep: int, cutoff: str, min_rows: int, min_scored: int, val_share: float = 0.15, level: bool = False) -> str:
    """CTEs of ``plans.training.train`` on the training table: fit, gate, band, shifted, held, errors."""
    p = "predicted_kwh"
    return f"""{TABLE}, past AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY meter_id ORDER BY ts) > floor(count(*) OVER (PARTITION BY meter_id) * (1.0 - {val_share})) THEN 'test' ELSE 'train' END AS split FROM tbl WHERE ts <= TIMESTAMP '{cutoff}'),
    train AS (SELECT * FROM past WHERE split = 'train'), {ridge_ctes('train', ['meter_id'], features, 'demand_kwh', keep, level=level)},
    raw AS MATERIALIZED (SELECT past.*, {linear(features)} AS {p} FROM past JOIN fit USING (meter_id)), {gate_ctes('raw', 'demand_kwh', p, min_rows, min_scored, val_share)},
    shifted AS MATERIALIZED (SELECT raw.* EXCLUDE ({p}), greatest({p} - trail_mbe_capped, 0.0) AS {p} FROM raw JOIN gate USING (meter_id)),
    band AS (SELECT meter_id, quantile_cont(demand_kwh - {p}, 0.1) AS r10, quantile_cont(demand_kwh - {p}, 0.9) AS r90 FROM shifted WHERE split = 'train' GROUP BY 1),
    held AS (SELECT s.*, least(greatest({p} + r10, 0.0), {p}) AS q10_kwh, greatest({p} + r90, 0.0, {p}) AS q90_kwh FROM shifted s JOIN band USING (meter_id) WHERE split = 'test'),
    errors AS (SELECT meter_id, {metrics('demand_kwh', p, 'q10_kwh', 'q90_kwh')} FROM held GROUP BY 1),
    zeros AS (SELECT meter_id, 100.0 * avg(CAST(demand_kwh < 0.5 AS INTEGER)) AS zero_pct, count(*) AS n_train FROM train GROUP BY 1),
    span AS (SELECT meter_id, min(ts) AS train_start, max(ts) AS train_end FROM past GROUP BY 1)"""


STEP_FEATURES = ["lag_1", "lag_24", "lag_168", "rmean_24", "hour_sin", "hour_cos", "is_weekend"]


def recursive_ctes(rows: str, steps: int = 168) -> str:
    """CTEs ending in ``path`` (meter_id, ts, step, predicted_kwh): the forecast that feeds itself, one recursive step an hour."""
    at = f"(e + to_hours(CAST(step + 1 AS BIGINT)))"
    lag = lambda n: f"past[len(past) - {n - 1}]"
    x = [lag(1), lag(24), lag(168), "list_avg(past[len(past) - 23:len(past)])", f"sin(hour({at}) * 2.0 * pi() / 24.0)", f"cos(hour({at}) * 2.0 * pi() / 24.0)", f"CAST(isodow({at}) >= 6 AS INTEGER)"]
    return f"""{steps_ctes(rows)}, known AS (SELECT * FROM steps WHERE lag_168 IS NOT NULL), {ridge_ctes('known', ['meter_id'], STEP_FEATURES, 'demand_kwh', 7)},
    tail AS (SELECT meter_id, max(ts) AS e, list(demand_kwh ORDER BY ts)[-168:] AS past FROM {rows} GROUP BY 1),
    walk AS (SELECT meter_id, e, past, coef, 0 AS step, CAST(NULL AS DOUBLE) AS p FROM tail JOIN fit USING (meter_id) WHERE len(past) = 168
        UNION ALL SELECT meter_id, e, list_append(past, q), coef, step + 1, q FROM (SELECT *, {linear(x)} AS q FROM walk WHERE step < {steps})),
    path AS (SELECT meter_id, e + to_hours(CAST(step AS BIGINT)) AS ts, step, p AS predicted_kwh FROM walk WHERE step > 0)"""


WINDOW_AT = "2024-01-23 00:00:00"
WINDOW_BACKTEST = f"""WITH RECURSIVE filled AS MATERIALIZED {FILLED}, past AS (SELECT * FROM filled WHERE ts < TIMESTAMP '{WINDOW_AT}'),
    latest AS (SELECT meter_id, arg_max(demand_kwh, ts) AS v FROM past GROUP BY 1),
    ahead AS (SELECT h.meter_id, h.ts, coalesce(a.demand_kwh, b.demand_kwh, c.demand_kwh, d.demand_kwh, v) AS demand_kwh FROM filled h JOIN latest l ON l.meter_id = h.meter_id
        {' '.join(f"LEFT JOIN past {n} ON {n}.meter_id = h.meter_id AND {n}.ts = h.ts - INTERVAL {7 * k} DAYS" for k, n in enumerate('abcd', 1))} WHERE h.ts >= TIMESTAMP '{WINDOW_AT}'),
    {steps_ctes('past', 'seen')}, known AS (SELECT * FROM seen WHERE lag_168 IS NOT NULL), {ridge_ctes('known', ['meter_id'], STEP_FEATURES, 'demand_kwh', 7)},
    both_ AS (SELECT *, false AS is_ahead FROM past UNION ALL SELECT *, true FROM ahead), {steps_ctes('both_', 'primed')},
    sc AS (SELECT x.meter_id, s.demand_kwh AS actual_kwh, {linear(STEP_FEATURES)} AS p FROM primed x JOIN fit USING (meter_id) JOIN sites s ON s.meter_id = x.meter_id AND s.ts = x.ts WHERE is_ahead)
    SELECT meter_id, {metrics('actual_kwh', 'p')}, count(*) AS n FROM sc GROUP BY 1"""


def strategies_sql(profile: str) -> str:
    """Seasonal anchor, model on a primed context, recursive model; ``profile`` is the anchor's SQL over readings."""
    anchor = profile.replace("readings", "filled")
    return f"""WITH RECURSIVE filled AS MATERIALIZED {FILLED}, {recursive_ctes('filled')}, anchor AS MATERIALIZED ({anchor}),
    ends AS (SELECT meter_id, max(ts) AS e FROM filled GROUP BY 1),
    both_ AS (SELECT meter_id, ts, demand_kwh, false AS is_ahead FROM filled JOIN ends USING (meter_id) WHERE ts >= e - INTERVAL 14 DAYS UNION ALL SELECT meter_id, ts, mean_kwh, true FROM anchor), {steps_ctes('both_', 'primed')}
    SELECT 'A' AS strategy, meter_id, ts, mean_kwh AS predicted_kwh FROM anchor UNION ALL SELECT 'C', meter_id, ts, predicted_kwh FROM path
    UNION ALL SELECT 'B', meter_id, ts, {linear(STEP_FEATURES)} FROM primed JOIN fit USING (meter_id) WHERE is_ahead"""


def multistep_sql(sets: dict[str, list[str]], y: str) -> str:
    parts = ", ".join(f"""{ridge_ctes('tr', ['meter_id'], f, y, len(f), name=name)}, m_{name} AS (SELECT meter_id, avg(abs({y} - {linear(f)}) / {y} * 100.0) AS {name} FROM r JOIN {name} USING (meter_id) WHERE NOT train AND {y} > 0.5 GROUP BY 1)""" for name, f in sets.items())
    return f"""WITH RECURSIVE {TABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) <= floor(count(*) OVER (PARTITION BY meter_id) * 0.8) AS train FROM tbl), tr AS (SELECT * FROM r WHERE train), {parts}
    SELECT *, (mape_base - mape_weather) / nullif(mape_base, 0) * 100.0 AS gain_pct FROM {' JOIN '.join(f'm_{n}' + (' USING (meter_id)' if i else '') for i, n in enumerate(sets))}"""


def _least_squares(name: str, src: str, k: int, weight: str, y: str, q: float) -> str:
    """CTEs ending in ``name`` (meter_id, b): weighted least squares on 1, x1 .. xk with (2q - 1) X'1 added, by elimination."""
    c = ["1.0"] + [f"x{i}" for i in range(1, k + 1)]
    rows = ", ".join("[" + ", ".join(f"sum(_w * {a} * {b})" + (" + 1e-6 * sum(_w)" if i == j and i else "") for j, b in enumerate(c)) + f", sum(_w * {a} * _y) + ({2 * q - 1!r}) * sum({a})]" for i, a in enumerate(c))
    n = k + 1
    cell = "CASE WHEN i = step + 1 THEN m[step + 1][j] / m[step + 1][step + 1] ELSE m[i][j] - m[i][step + 1] * m[step + 1][j] / m[step + 1][step + 1] END"
    return f"""{name}_e AS (SELECT meter_id, 0 AS step, [{rows}] AS m FROM (SELECT *, {weight} AS _w, {y} AS _y FROM {src}) GROUP BY meter_id
        UNION ALL SELECT meter_id, step + 1, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j: {cell})) FROM {name}_e WHERE step < {n}),
    {name} AS (SELECT meter_id, list_transform(range(1, {n + 1}), lambda i: m[i][{n + 1}]) AS b FROM {name}_e WHERE step = {n})"""


def heads_sql(features: list[str], y: str, cutoff: str, rounds: int = 6, eps: float = 1e-3) -> str:
    """Ten and ninety percent heads learned up to the cutoff, over the rows of the training table after it."""
    from statistics import NormalDist

    k = len(features)
    f = [f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in features]
    line = lambda b: f"({b}[1] + " + " + ".join(f"{b}[{i + 1}] * x{i}" for i in range(1, k + 1)) + ")"
    each = range(1, k + 1)
    out = f"""WITH RECURSIVE {TABLE}, h AS (SELECT meter_id, CAST({y} AS DOUBLE) AS y, {', '.join(f'{e} AS f{i}' for i, e in enumerate(f, 1))} FROM tbl WHERE ts <= TIMESTAMP '{cutoff}'),
    hs AS (SELECT meter_id, [{', '.join(f'avg(f{i})' for i in each)}] AS mean, [{', '.join(f'greatest(stddev_pop(f{i}), 1e-9)' for i in each)}] AS sd FROM h GROUP BY 1),
    z AS MATERIALIZED (SELECT meter_id, y, {', '.join(f'(f{i} - mean[{i}]) / sd[{i}] AS x{i}' for i in each)} FROM h JOIN hs USING (meter_id)),
    {_least_squares('mid', 'z', k, '1.0', 'y', 0.5)}, {_least_squares('far', '(SELECT z.*, b FROM z JOIN mid USING (meter_id))', k, '1.0', f"abs(y - {line('b')})", 0.5)}"""
    for q in (0.1, 0.9):
        n, move = f"h{round(q * 100)}", NormalDist().inv_cdf(q) * 1.2533141373155001
        out += f""", {n}_0 AS (SELECT meter_id, list_transform(range(1, {k + 2}), lambda i: mid.b[i] + ({move!r}) * far.b[i]) AS b, greatest(far.b[1], 1e-9) AS w0 FROM mid JOIN far USING (meter_id))"""
        for r in range(1, rounds + 1):
            out += ", " + _least_squares(f"{n}_s{r}", f"(SELECT z.*, b, w0 FROM z JOIN {n}_{r - 1} USING (meter_id))", k, f"1.0 / (abs(y - {line('b')}) + w0 * {eps})", "y", q)
            out += f", {n}_{r} AS MATERIALIZED (SELECT s.meter_id, s.b, w0 FROM {n}_s{r} s JOIN {n}_0 o ON o.meter_id = s.meter_id)"
        out += f""", {n}_d AS (SELECT meter_id, quantile_cont(y - {line('b')}, {q}) AS d FROM z JOIN {n}_{rounds} USING (meter_id) GROUP BY 1),
    {n} AS (SELECT meter_id, list_transform(range(1, {k + 1}), lambda i: b[i + 1] / sd[i]) AS slope, b[1] + d AS base, mean FROM {n}_{rounds} JOIN {n}_d USING (meter_id) JOIN hs USING (meter_id))"""
    value = lambda n: f"greatest({n}.base + " + " + ".join(f"{n}.slope[{i}] * ({e} - {n}.mean[{i}])" for i, e in enumerate(f, 1)) + ", 0.0)"
    return out + f""" SELECT t.meter_id, ts, {y}, least({value('h10')}, {value('h90')}) AS q10_kwh, greatest({value('h10')}, {value('h90')}) AS q90_kwh
    FROM tbl t LEFT JOIN h10 ON h10.meter_id = t.meter_id LEFT JOIN h90 ON h90.meter_id = t.meter_id WHERE ts > TIMESTAMP '{cutoff}'"""
