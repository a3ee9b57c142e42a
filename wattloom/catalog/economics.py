"""Dispatch, economics and network."""

from pyspark.sql import functions as F

from wattloom.catalog.registry import query
from wattloom.catalog.scalars import AUDIT_SQL, audited
from wattloom.functions import calendar as cal, money
from wattloom.operators import dispatch, economics, network, table_functions

HOURLY = """SELECT meter_id AS site_id, date_trunc('day', ts) AS day, hour(ts) AS h, sum(demand_kwh) AS d, sum(CASE WHEN hour(ts) BETWEEN 7 AND 17 THEN 40.0 + tag % 50 ELSE 0.0 END) AS s, avg(2.0 + (tag % 70) * 0.1) AS p FROM sites GROUP BY 1, 2, 3"""


def site_days(t):
    sun = F.when(F.hour("ts").between(7, 17), 40.0 + F.col("tag") % 50).otherwise(0.0)
    df = t.sites.select(F.col("meter_id").alias("site_id"), F.date_trunc("day", "ts").alias("day"), F.hour("ts").alias("h"), F.col("demand_kwh").alias("demand"), sun.alias("solar"), (2.0 + (F.col("tag") % 70) * 0.1).alias("price"))
    return dispatch.day_vectors(df, ["site_id", "day"], "h", ["demand", "solar", "price"])


def one_battery(t, strategy="cheap_grid"):
    return site_days(t).withColumns({"capacity_kwh": F.lit(200.0), "power_kw": F.lit(50.0), "strategy": F.lit(strategy)})


ONE_BATTERY = "SELECT site_id, 'x' AS battery, 200.0 AS cap, 50.0 AS kw, '{}' AS strategy FROM (SELECT DISTINCT meter_id AS site_id FROM sites)"


def greedy_sql(strategy="cheap_grid", batteries=None):
    """Hour-by-hour recursion over the days of every battery row (site_id, battery, cap, kw, strategy)."""
    return f"""WITH RECURSIVE hourly AS MATERIALIZED ({HOURLY}), days AS (SELECT d.site_id, d.day, c.* EXCLUDE (site_id) FROM (SELECT DISTINCT site_id, day FROM hourly) d JOIN ({batteries or ONE_BATTERY.format(strategy)}) c ON c.site_id = d.site_id),
    g AS MATERIALIZED (SELECT x.site_id, x.day, x.battery, x.strategy, x.h, coalesce(y.d, 0.0) AS d, coalesce(y.s, 0.0) AS s, coalesce(y.p, 0.0) / (0.961 * 0.9725 * 0.9728) + 1.19 AS l, cap, kw,
        row_number() OVER (PARTITION BY x.site_id, x.day, x.battery, x.strategy ORDER BY coalesce(y.p, 0.0) DESC, x.h DESC) <= floor(cap / greatest(kw, 1.0)) AS pk
        FROM (SELECT *, unnest(range(24)) AS h FROM days) x LEFT JOIN hourly y ON y.site_id = x.site_id AND y.day = x.day AND y.h = x.h),
    f AS (SELECT site_id, day, battery, strategy, -1::BIGINT AS h, cap * 0.5 AS soc, 0.0 AS solar_direct, 0.0 AS charge, 0.0 AS discharge, 0.0 AS grid, 0.0 AS iex, 0.0 AS landed, 0.0 AS d, cap, kw FROM days UNION ALL
        SELECT site_id, day, battery, strategy, h, level - drawn, direct, sun + gc, drawn * sqrt(0.88), CASE WHEN rest - drawn * sqrt(0.88) > 0 AND l >= 6.5 THEN rest - drawn * sqrt(0.88) ELSE 0.0 END,
        gc + CASE WHEN rest - drawn * sqrt(0.88) > 0 AND l < 6.5 THEN rest - drawn * sqrt(0.88) ELSE 0.0 END, l, d, cap, kw FROM (
        SELECT *, CASE WHEN rest > 0 AND pk AND level > cap * 0.1 THEN least(level - cap * 0.1, kw, rest) ELSE 0.0 END AS drawn FROM (
        SELECT *, soc + (sun + gc) * sqrt(0.88) AS level FROM (SELECT *, CASE WHEN strategy = 'cheap_grid' AND l < 6.5 AND sun < room THEN least(room - sun, kw - sun) ELSE 0.0 END AS gc FROM (
        SELECT *, CASE WHEN strategy = 'full_solar' THEN least(s, room) ELSE least(greatest(s - direct, 0.0), room) END AS sun FROM (
        SELECT g.*, f.soc, least(g.s, g.d) AS direct, g.d - least(g.s, g.d) AS rest, CASE WHEN f.soc < g.cap * 0.9 THEN least(g.cap * 0.9 - f.soc, g.kw) ELSE 0.0 END AS room
        FROM f JOIN g ON g.site_id = f.site_id AND g.day = f.day AND g.battery = f.battery AND g.strategy = f.strategy AND g.h = f.h + 1))))))
    SELECT *, h AS hour FROM f WHERE h >= 0"""


def costs_sql(batteries=None):
    return f"""SELECT site_id, day, battery, strategy, any_value(cap) AS cap, any_value(kw) AS kw, sum(grid) * 6.5 + sum(iex * landed) AS c, sum(solar_direct) * 6.5 AS ss, sum(d) * 6.5 AS base,
        avg(least((solar_direct + discharge + grid + iex) / greatest(d, 0.001), 1.0)) AS r FROM ({greedy_sql(batteries=batteries)}) GROUP BY 1, 2, 3, 4"""


HOUR_COLS = "site_id:s day:d hour:i solar_direct:4 charge:4 discharge:4 soc:4 grid:4 iex:4 landed:4"


@query("dsp_greedy_day", HOUR_COLS, greedy_sql("cheap_grid"))
def _(t):
    return dispatch.hourly_rows(dispatch.greedy_day(one_battery(t)), ["site_id", "day"])


@query("dsp_schedule_table", HOUR_COLS, greedy_sql("cheap_grid"))
def _(t):
    """The same schedules by the table function, from SQL."""
    table_functions.register(t.spark)
    hours = t.sites.select(F.col("meter_id").alias("site_id"), F.date_trunc("day", "ts").alias("day"), F.hour("ts").alias("hour"), "demand_kwh", "tag")
    hours = hours.groupBy("site_id", "day", "hour").agg(F.sum("demand_kwh").alias("demand"), F.sum(F.when(F.col("hour").between(7, 17), 40.0 + F.col("tag") % 50).otherwise(0.0)).alias("solar"), money.landed_cost(F.avg(2.0 + (F.col("tag") % 70) * 0.1)).alias("landed"))
    hours.createOrReplaceTempView("wattloom_hours")
    return t.spark.sql(f"select * from battery_day(table(wattloom_hours) partition by (site_id, day) order by (hour), 200, 50, 'cheap_grid', 6.5, {table_functions.idle_cost(t.spark)})")


@query("dsp_greedy_full_solar", HOUR_COLS, greedy_sql("full_solar"))
def _(t):
    return dispatch.hourly_rows(dispatch.greedy_day(one_battery(t, "full_solar")), ["site_id", "day"])


@query("dsp_greedy_week", "site_id:s week:d total_cost_inr:2 solar_savings_inr:2 bess_savings_inr:2 n_days:i reliability:5", f"""SELECT site_id, date_trunc('week', day) AS week, sum(c) AS total_cost_inr, sum(ss) AS solar_savings_inr, sum(base - c - ss) AS bess_savings_inr, count(*) AS n_days, avg(r) AS reliability
    FROM ({costs_sql()}) GROUP BY 1, 2""")
def _(t):
    d = dispatch.day_costs(one_battery(t))
    return d.groupBy("site_id", F.date_trunc("week", "day").alias("week")).agg(*[F.sum(c).alias(c) for c in ("total_cost_inr", "solar_savings_inr", "bess_savings_inr")], F.count("*").alias("n_days"), F.avg("reliability").alias("reliability"))


def sweep(t):
    base = t.sites.groupBy(F.col("meter_id").alias("site_id")).agg(F.avg("demand_kwh").alias("base_kwh"))
    grid = economics.battery_grid(base, [1.0, 2.0, 4.0], [2, 4, 6], ["cheap_grid", "full_solar", "solar_surplus"])
    return dispatch.size_sweep(site_days(t), grid, "site_id")


SWEEP_SQL = """SELECT site_id, s || 'x' || d AS battery, m * s AS cap, m * s / d AS kw, g AS strategy FROM (SELECT meter_id AS site_id, avg(demand_kwh) AS m FROM sites GROUP BY 1), (VALUES (1), (2), (4)) a(s), (VALUES (2), (4), (6)) b(d), (VALUES ('cheap_grid'), ('full_solar'), ('solar_surplus')) c(g)"""


@query("dsp_size_sweep", "site_id:s capacity_kwh:3 duration_h:i strategy:s power_kw:3 annual_savings_inr:1 capex_inr:1 payback_years:1 irr:4 n_days:i", f"""SELECT *, capex_inr / greatest(annual_savings_inr, 1.0) AS payback_years, CASE WHEN annual_savings_inr > 0 THEN annual_savings_inr / capex_inr ELSE -1.0 END AS irr FROM (
    SELECT site_id, any_value(cap) AS capacity_kwh, CAST(split_part(battery, 'x', 2) AS INT) AS duration_h, strategy, any_value(kw) AS power_kw, sum(base - c) * 365.0 / count(*) AS annual_savings_inr, any_value(cap) * 15000.0 AS capex_inr, count(*) AS n_days FROM ({costs_sql(SWEEP_SQL)}) GROUP BY site_id, battery, strategy)""")
def _(t):
    return sweep(t)


COMPARE_SQL = "SELECT site_id, b AS battery, cap, kw, 'cheap_grid' AS strategy FROM (SELECT DISTINCT meter_id AS site_id FROM sites), (VALUES ('none', 0.0, 0.0), ('small', 200.0, 50.0), ('large', 500.0, 125.0)) v(b, cap, kw)"


@query("dsp_compare_scenarios", "site_id:s battery:s annual_savings_inr:1 capex_inr:1 payback_years:2 n_days:i", f"""WITH c AS MATERIALIZED ({costs_sql(COMPARE_SQL)}), s AS (SELECT x.site_id, x.battery, sum(n.c - x.c) * 365.0 / count(*) AS annual_savings_inr, any_value(x.cap) * 15000.0 AS capex_inr, count(*) AS n_days FROM c x JOIN c n ON n.site_id = x.site_id AND n.day = x.day AND n.battery = 'none' WHERE x.battery <> 'none' GROUP BY 1, 2)
    SELECT *, CASE WHEN annual_savings_inr > 0 THEN capex_inr / annual_savings_inr END AS payback_years FROM s""")
def _(t):
    return dispatch.compare_batteries(site_days(t), ["site_id", "day"], [("small", 200.0, 50.0), ("large", 500.0, 125.0)], "site_id")


@query("dsp_schedule_kpis", "site_id:s revenue_inr:2 cost_inr:2 net_benefit_inr:2 cycles:4 peak_grid_kwh:4", """SELECT site_id, sum(iex_price * discharge_kwh) AS revenue_inr, sum(landed_cost * grid_kwh) + sum(iex_price * charge_kwh) AS cost_inr,
    sum(iex_price * discharge_kwh) - sum(landed_cost * grid_kwh) - sum(iex_price * charge_kwh) AS net_benefit_inr, (sum(charge_kwh) + sum(discharge_kwh)) / 400.0 AS cycles, max(grid_kwh) AS peak_grid_kwh FROM schedule GROUP BY 1""")
def _(t):
    return dispatch.schedule_kpis(t.schedule, "site_id", 200.0)


@query("dsp_inputs_align", "meter_id:s ts:t demand_kwh:5 price:2 landed_cost:2 block_label:s confidence_weight:4", """WITH f AS (SELECT meter_id, ts, predicted_kwh, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) < 10 THEN 'morning' WHEN hour(ts) < 18 THEN 'solar' ELSE 'peak' END AS lab, hour(ts) * 1.5 AS mape FROM fc30),
    g AS (SELECT meter_id, unnest(generate_series(min(ts), min(ts) + INTERVAL '2865 minutes', INTERVAL 15 MINUTES)) AS ts FROM fc30 GROUP BY 1),
    h AS (SELECT g.meter_id, g.ts, last_value(predicted_kwh IGNORE NULLS) OVER w AS e, last_value(lab IGNORE NULLS) OVER w AS block_label, last_value(mape IGNORE NULLS) OVER w AS m FROM g LEFT JOIN f ON f.meter_id = g.meter_id AND f.ts = g.ts WINDOW w AS (PARTITION BY g.meter_id ORDER BY g.ts ROWS UNBOUNDED PRECEDING))
    SELECT h.meter_id, h.ts, e / 2.0 AS demand_kwh, p.price, 8.2 AS landed_cost, block_label, greatest(least(1.0 - greatest(m - 15.0, 0.0) / 15.0, 1.0), 0.5) AS confidence_weight FROM h ASOF LEFT JOIN price_series p ON h.ts >= p.ts""")
def _(t):
    f = t.fc30.withColumns({"block_label": cal.day_block(F.hour("ts")), "mape": F.hour("ts") * 1.5})
    return dispatch.align_inputs(f, t.price_series, "meter_id", "predicted_kwh", "block_label", "mape")


@query("agg_monthly_economics", "site_id:s year:i month:i total_consumption_kwh:2 peak_demand_kw:4 energy_charge_inr:2 market_cost_inr:2 demand_charge_inr:2 demand_charge_savings_inr:2 solar_savings_inr:2 bess_savings_inr:2 co2_avoided_kg:2 total_bill_inr:1 total_savings_inr:1", """SELECT *, energy_charge_inr + market_cost_inr + demand_charge_inr AS total_bill_inr, solar_savings_inr + bess_savings_inr + demand_charge_savings_inr AS total_savings_inr FROM (
    SELECT site_id, year(ts) AS year, month(ts) AS month, sum(demand_kwh) AS total_consumption_kwh, max(demand_kwh) AS peak_demand_kw, sum(grid_kwh) * 6.5 AS energy_charge_inr, sum(iex_kwh * (iex_price / (0.961 * 0.9725 * 0.9728) + 1.19)) AS market_cost_inr,
    greatest(max(demand_kwh) / 0.95, 100.0) * 475.0 AS demand_charge_inr, greatest((max(demand_kwh) / 0.95 - max(greatest(demand_kwh - discharge_kwh, 0.0)) / 0.95) * 475.0, 0.0) AS demand_charge_savings_inr, sum(least(solar_kwh, demand_kwh)) * 6.5 AS solar_savings_inr,
    sum(discharge_kwh) * 6.5 - sum(discharge_kwh) * avg(iex_price) * 0.5 AS bess_savings_inr, sum(least(solar_kwh, demand_kwh)) * 0.77 + sum(discharge_kwh) * 0.9 AS co2_avoided_kg FROM schedule GROUP BY 1, 2, 3)""")
def _(t):
    return economics.monthly_economics(t.schedule, "site_id")


@query("agg_month_spread", "month:i avg_charge:4 avg_discharge:4 spread:4 avg_charge_landed:4 avg_discharge_landed:4 landed_spread:4 cheapest_hours:s expensive_hours:s", """SELECT *, avg_discharge - avg_charge AS spread, avg_discharge_landed - avg_charge_landed AS landed_spread FROM (SELECT month, avg(price) FILTER (a <= 4) AS avg_charge, avg(price) FILTER (d <= 4) AS avg_discharge,
    avg(l) FILTER (a <= 4) AS avg_charge_landed, avg(l) FILTER (d <= 4) AS avg_discharge_landed, string_agg(hour, ',' ORDER BY a) FILTER (a <= 4) AS cheapest_hours, string_agg(hour, ',' ORDER BY d) FILTER (d <= 4) AS expensive_hours FROM (
    SELECT *, price / (0.961 * 0.9725 * 0.9728) + 1.19 AS l, row_number() OVER (PARTITION BY month ORDER BY price, hour) AS a, row_number() OVER (PARTITION BY month ORDER BY price DESC, hour DESC) AS d FROM prices) GROUP BY 1)""")
def _(t):
    return economics.month_spread(t.prices)


def irr_sql(src, keys):
    """``src`` yields the keys, ``capex`` and ``annual``."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, list_concat([-capex], list_transform(range(1, 11), lambda y: annual * pow(0.975, y) / pow(1.02, y))) AS f FROM ({src})),
    b AS (SELECT {keys}, f, 0 AS i, -0.99 AS lo, 1.0 AS hi, list_sum(list_transform(f, lambda x, t: x / pow(0.01, t - 1))) AS al, CAST(NULL AS DOUBLE) AS root, 0.0 AS mid FROM p WHERE capex > 0
    UNION ALL SELECT {keys}, f, i + 1, CASE WHEN al * v < 0 THEN lo ELSE m END, CASE WHEN al * v < 0 THEN m ELSE hi END, CASE WHEN al * v < 0 THEN al ELSE v END, CASE WHEN abs(v) < 1e-2 THEN m END, m FROM (
        SELECT *, (lo + hi) / 2.0 AS m, list_sum(list_transform(f, lambda x, t: x / pow(1 + (lo + hi) / 2.0, t - 1))) AS v FROM b WHERE i < 100 AND root IS NULL)),
    z AS (SELECT {keys}, arg_max(coalesce(root, mid), i) AS r FROM b GROUP BY ALL)
    SELECT p.* EXCLUDE (f), r * 100 AS irr_pct, list_sum(list_transform(f, lambda x, t: x / pow(1.1, t - 1))) AS npv_inr,
    list_min(list_filter(range(1, 11), lambda y: list_sum(f[1:y + 1]) >= 0)) AS payback_years FROM p LEFT JOIN z USING ({keys})"""


PROJECT_SQL = "SELECT k, 1000000.0 + k * 1000.0 AS capex, mean_wh * 60.0 AS annual FROM registry"


def projects(t):
    return t.registry.select("k", (1000000.0 + F.col("k") * 1000.0).alias("capex"), (F.col("mean_wh") * 60.0).alias("annual"))


@query("eco_irr", "k:i irr_pct:4 npv_inr:2 payback_years:1", irr_sql(PROJECT_SQL, "k"))
def _(t):
    return economics.project_irr(projects(t), "capex", "annual")


NET_SQL = "SELECT site_id, greatest(sum(iex_price * discharge_kwh) - sum(iex_price * charge_kwh) * 0.5, 0.0) * 40.0 AS daily FROM schedule GROUP BY 1"


def site_net(t):
    gain = F.sum(F.col("iex_price") * F.col("discharge_kwh")) - F.sum(F.col("iex_price") * F.col("charge_kwh")) * 0.5
    return t.schedule.groupBy("site_id").agg((F.greatest(gain, F.lit(0.0)) * 40.0).alias("daily"))


@query("eco_irr_heatmap", "site_id:s capacity_mwh:2 duration_h:i irr_pct:3 payback_years:1", irr_sql(f"""SELECT site_id, c AS capacity_mwh, d AS duration_h, c * 1000 * 25000.0 AS capex, daily * 365 * c * (1.0 + 0.05 * (d - 4)) AS annual FROM ({NET_SQL}), (VALUES (0.5), (1.0), (2.0), (4.0)) x(c), (VALUES (2), (4), (8)) y(d)""", "site_id, capacity_mwh, duration_h"))
def _(t):
    return economics.irr_heatmap(site_net(t), "daily", [0.5, 1.0, 2.0, 4.0], [2, 4, 8])


CASES = ", ".join(f"('{k}', {v!r})" for k, vs in economics.SENSITIVITY.items() for v in vs)


@query("eco_sensitivity", "k:i factor:s delta_pct:3 irr_pct:3 payback_years:1", irr_sql(f"""SELECT k, factor, dl * 100 AS delta_pct, capex * CASE WHEN factor = 'capex' THEN 1 + dl ELSE 1 END AS capex, annual * CASE WHEN factor = 'capex' THEN 1 ELSE 1 + dl END AS annual
    FROM ({PROJECT_SQL}), (SELECT factor, CAST(dl AS DOUBLE) AS dl FROM (VALUES {CASES}) v(factor, dl))""", "k, factor, delta_pct"))
def _(t):
    return economics.sensitivity(projects(t), "capex", "annual")


@query("eco_brief", "site_id:s saved_today_inr:2 projected_annual_inr:1 peak_block_mape:4 mape_health:s highlights:s", f"""WITH s AS (SELECT site_id, ts, charge_kwh, discharge_kwh * 10.0 AS discharge_kwh, curtail_kwh, grid_kwh, iex_price, landed_cost, block_mape, audit FROM ({AUDIT_SQL})),
    n AS (SELECT site_id, greatest(sum(discharge_kwh * iex_price - grid_kwh * landed_cost - charge_kwh * iex_price), 0.0) AS v FROM (SELECT *, min(ts) OVER (PARTITION BY site_id) AS t0 FROM s) WHERE ts < t0 + INTERVAL 24 HOUR GROUP BY 1),
    p AS (SELECT site_id, avg(block_mape) AS m FROM s WHERE hour(ts) BETWEEN 18 AND 21 GROUP BY 1),
    r AS (SELECT site_id, audit, row_number() OVER (PARTITION BY site_id ORDER BY greatest(charge_kwh, discharge_kwh, curtail_kwh) DESC, ts) AS rk FROM s WHERE greatest(charge_kwh, discharge_kwh, curtail_kwh) > 0.001),
    h AS (SELECT site_id, string_agg(audit, ' ' ORDER BY rk) AS highlights FROM r WHERE rk <= 3 GROUP BY 1)
    SELECT site_id, v AS saved_today_inr, v * 365 AS projected_annual_inr, m AS peak_block_mape, CASE WHEN m < 4 THEN 'green' WHEN m < 8 THEN 'amber' ELSE 'red' END AS mape_health, highlights FROM n LEFT JOIN p USING (site_id) LEFT JOIN h USING (site_id)""")
def _(t):
    return economics.site_brief(audited(t).withColumn("discharge_kwh", F.col("discharge_kwh") * 10.0), "site_id")


@query("eco_site_commercial", "site_id:s daily:2 capex:1 annual:1 irr_pct:3 npv_inr:1 payback_years:1 firmness_pct:3 offered_price:4", f"""SELECT s.*, firmness_pct, greatest(8.20 - 1.30 + (95.0 - firmness_pct) / 5.0 * 0.40, 4.0) AS offered_price FROM ({irr_sql(f"SELECT site_id, daily / 2.0 AS daily, 25000000.0 AS capex, daily / 2.0 * 365 AS annual FROM ({NET_SQL})", "site_id")}) s
    JOIN (SELECT site_id, greatest(least(95.0, 100.0 - min(block_mape)), 70.0) AS firmness_pct FROM schedule GROUP BY 1) q ON q.site_id = s.site_id""")
def _(t):
    net = site_net(t).select("site_id", (F.col("daily") / 2.0).alias("daily")).withColumns({"capex": F.lit(25_000_000.0), "annual": F.col("daily") * 365.0})
    best = t.schedule.groupBy("site_id").agg(F.min("block_mape").alias("m")).withColumn("kw", F.lit(100.0))
    return economics.project_irr(net, "capex", "annual").join(money.add_firm_quote(best, "m", "kw"), "site_id")


@query("net_nodes_edges", "node_id:s problem:s", """WITH n AS (SELECT * FROM nodes UNION ALL SELECT * FROM nodes WHERE node_id LIKE 'F1%'), e AS (SELECT src, dst FROM edges UNION ALL SELECT 'X' || src, dst FROM edges WHERE edge_type = 'fed_by')
    SELECT node_id, 'duplicate_node' AS problem FROM n GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'dangling_endpoint' FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) WHERE id NOT IN (SELECT node_id FROM n)""")
def _(t):
    n = t.nodes.unionByName(t.nodes.filter("node_id like 'F1%'"))
    e = t.edges.unionByName(t.edges.filter("edge_type = 'fed_by'").withColumn("src", F.concat(F.lit("X"), "src")))
    return network.integrity(n, e)


@query("net_filter", "item:s what:s", """SELECT node_id AS item, 'meter_of_R1' AS what FROM nodes WHERE kind = 'meter' AND substation_id = 'R1' UNION ALL SELECT node_id, 'bess_of_R1' FROM nodes WHERE kind = 'bess' AND substation_id = 'R1'
    UNION ALL SELECT src || '>' || dst, 'edge_of_F3' FROM edges WHERE src = 'F3' OR dst = 'F3' UNION ALL SELECT src || '>' || dst, 'fed_by' FROM edges WHERE edge_type = 'fed_by'""")
def _(t):
    edge = F.concat_ws(">", "src", "dst")
    parts = [
        network.members(t.nodes, "R1", "meter").select(F.col("node_id").alias("item"), F.lit("meter_of_R1").alias("what")),
        network.members(t.nodes, "R1", "bess").select(F.col("node_id").alias("item"), F.lit("bess_of_R1").alias("what")),
        network.edges_of(t.edges, "F3").select(edge.alias("item"), F.lit("edge_of_F3").alias("what")),
        t.edges.filter("edge_type = 'fed_by'").select(edge.alias("item"), F.lit("fed_by").alias("what")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("net_neighborhood", "node_id:s hops:i", """WITH RECURSIVE a AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 'F3' AS node_id, 0 AS hops UNION SELECT a.dst, w.hops + 1 FROM w JOIN a ON a.src = w.node_id WHERE w.hops < 3)
    SELECT node_id, min(hops) AS hops FROM w GROUP BY 1""")
def _(t):
    return network.neighborhood(t.edges, "F3", 3)


@query("net_portfolio", "substation_id:s n_meters:i n_bess:i n_feeders:i n_green:i n_amber:i n_red:i", """SELECT substation_id, count(*) FILTER (kind = 'meter') AS n_meters, count(*) FILTER (kind = 'bess') AS n_bess, count(*) FILTER (kind = 'feeder') AS n_feeders, count(*) FILTER (kind = 'meter' AND mape < 8) AS n_green,
    count(*) FILTER (kind = 'meter' AND mape >= 8 AND mape < 12) AS n_amber, count(*) FILTER (kind = 'meter' AND mape >= 12) AS n_red FROM nodes GROUP BY 1""")
def _(t):
    return network.portfolio(t.nodes)
