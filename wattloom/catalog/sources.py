"""Sources and sinks over files that Spark derives from the supplied tables."""

from pyspark.sql import functions as F

from wattloom.catalog.registry import query
from wattloom.operators import grids
from wattloom.session import scratch_path
from wattloom.sources import readers, writers

TYPES = ["click", "error", "purchase", "signup", "view"]


def saved(t, df, name, fmt="parquet", **options):
    path = scratch_path(t.spark, name)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("src_meter_union", "msn:s ts:t demand_wh:4 voltage:3 phase:s tier:s", """SELECT meter_id AS msn, ts, demand_kwh * 1000 AS demand_wh, voltage, CASE WHEN tag % 2 = 0 THEN '1PH' ELSE '3PH' END AS phase, CASE WHEN CAST(meter_id AS INT) % 3 = 0 THEN 'large' ELSE 'small' END AS tier FROM readings WHERE tag % 31 <> 0""")
def _(t):
    base = t.readings.withColumn("demand_wh", F.when(F.col("tag") % 31 != 0, F.col("demand_kwh") * 1000)).withColumnRenamed("meter_id", "msn")
    one = saved(t, base.filter("tag % 2 = 0").select("ts", "demand_wh", F.col("voltage").alias("v_ave"), "msn"), "single")
    three = saved(t, base.filter("tag % 2 = 1").select("ts", "demand_wh", F.col("voltage").alias("v_avg"), "msn"), "three")
    profile = base.select("msn").distinct().withColumn("tier", F.when(F.col("msn").cast("int") % 3 == 0, "large").otherwise("small"))
    return readers.meters(t.spark.read.parquet(one), t.spark.read.parquet(three), profile)


@query("src_meter_normalise", "msn:s ts:t demand_wh:2 voltage:3 phase_type:s", """WITH r AS (SELECT user_id, date_trunc('hour', ts) AS ts, event_id, CASE WHEN event_id % 29 <> 0 THEN round(value * 1000) END AS wh, CASE WHEN event_id % 5 <> 0 THEN 1200 + event_id % 40 END AS a, 1210 + event_id % 30 AS b, CASE WHEN event_id % 7 <> 0 THEN 1190 + event_id % 20 END AS c FROM events)
    SELECT CAST(user_id AS VARCHAR) AS msn, ts, wh AS demand_wh, list_avg(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS voltage, CASE WHEN user_id % 2 = 0 THEN '1PH' END AS phase_type FROM r QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1 AND wh IS NOT NULL""")
def _(t):
    e = F.col("event_id")
    raw = t.events.select(
        F.col("user_id").cast("string").alias("msn"), F.date_trunc("hour", "ts").alias("ts"), e, F.when(e % 29 != 0, F.format_number(F.col("value") * 1000, 0)).otherwise("n/a").alias("wh_imp"),
        F.when(e % 5 != 0, F.format_number(1200 + e % 40, 0)).alias("v_r"), F.format_number(1210 + e % 30, 0).alias("v_y"), F.when(e % 7 != 0, F.format_number(1190 + e % 20, 0)).otherwise("-").alias("v_b"))
    vendor = raw.select("msn").distinct().filter(F.col("msn").cast("int") % 2 == 0).withColumn("phase_type", F.lit("1PH"))
    return readers.raw_meters(t.spark.read.parquet(saved(t, raw, "raw")), "event_id", vendor=vendor)


@query("src_wide_to_long", "timestamp:t consumer_id:s demand_vah:3 max_demand_vah:3 demand_kwh:6 region:s", """WITH g AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events), w AS (SELECT g.ts AS timestamp, c AS consumer_id FROM g, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(c)),
    s AS (SELECT date_trunc('hour', ts) AS ts, event_type, sum(value) AS a, max(value) AS m FROM events GROUP BY 1, 2)
    SELECT timestamp, consumer_id, a AS demand_vah, m AS max_demand_vah, a / 1000.0 AS demand_kwh, CASE WHEN consumer_id IN ('click', 'view') THEN 'North' ELSE 'Unknown' END AS region FROM w LEFT JOIN s ON s.ts = timestamp AND event_type = consumer_id""")
def _(t):
    wide = t.events.groupBy(F.date_trunc("hour", "ts").alias("timestamp")).pivot("event_type", TYPES).agg(F.sum("value").alias("act"), F.max("value").alias("max"))
    path = saved(t, wide, "wide", "csv", header=True)
    schema = "timestamp timestamp, " + ", ".join(f"{i}_act double, {i}_max double" for i in TYPES)
    regions = t.events.select(F.col("event_type").alias("consumer_id")).distinct().filter(F.col("consumer_id").isin("click", "view")).withColumn("region", F.lit("North"))
    return readers.wide_to_long(t.spark.read.csv(path, schema=schema, header=True), TYPES, regions=regions)


@query("src_month_block_unpivot", "month:i hour:i consumer_id:s max_demand_vah:2", """WITH h AS (SELECT unnest(range(24)) AS hour), g AS (SELECT month, hour, consumer_id FROM h, range(1, 13) m(month), (VALUES ('F'), ('O'), ('P')) v(consumer_id)),
    s AS (SELECT month(o_orderdate) AS month, o_orderkey % 24 AS hour, o_orderstatus AS consumer_id, max(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
    SELECT g.*, coalesce(CASE WHEN g.hour <> 5 THEN v END, 0.0) AS max_demand_vah FROM g LEFT JOIN s ON s.month = g.month AND s.hour = g.hour AND s.consumer_id = g.consumer_id""")
def _(t):
    o = t.read("orders").withColumns({"hour": (F.col("o_orderkey") % 24).cast("int"), "cell": F.concat_ws("_", F.month("o_orderdate").cast("string"), "o_orderstatus")})
    cells = [f"{m}_{c}" for m in range(1, 13) for c in "FOP"]
    wide = o.groupBy("hour").pivot("cell", cells).agg(F.max("o_totalprice"))
    wide = wide.select("hour", *[F.when(F.col("hour") == 5, "bad").otherwise(F.format_number(F.col(f"`{c}`"), 2)).alias(c) for c in cells])
    path = saved(t, wide, "months", "csv", header=True)
    df = t.spark.read.csv(path, schema="hour int, " + ", ".join(f"`{c}` string" for c in cells), header=True)
    return readers.month_blocks(df, list(range(1, 13)), list("FOP"))


@query("src_quality_tables", "consumer_id:s gap_start:t gap_end:t gap_hours:2", """SELECT meter_id AS consumer_id, CASE WHEN epoch(ts) % 7 <> 0 THEN ts + INTERVAL 1 HOUR END AS gap_start, nx - INTERVAL 1 HOUR AS gap_end, (epoch(nx) - epoch(ts)) / 3600 - 1 AS gap_hours FROM (
    SELECT meter_id, ts, lead(ts) OVER (PARTITION BY meter_id ORDER BY ts) AS nx FROM sites) WHERE nx > ts + INTERVAL 1 HOUR""")
def _(t):
    gaps = grids.detect_gaps(t.sites, ["meter_id"], "ts", 60)
    start = F.when((F.unix_seconds("gap_start") - 3600) % 7 != 0, F.date_format("gap_start", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    table = gaps.select(F.col("meter_id").alias("consumer_id"), start.alias("gap_start"), F.date_format("gap_end", "yyyy-MM-dd HH:mm:ss").alias("gap_end"), F.col("gap_intervals").cast("double").alias("gap_hours"))
    return readers.quality_tables(t.spark, {"gaps": saved(t, table, "gaps", "csv", header=True)})["gaps"]


@query("src_clean_csv", "meter_id:s ts:t demand_kw:4", "SELECT meter_id, ts, demand_kwh AS demand_kw FROM readings")
def _(t):
    df = t.readings.select("meter_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("demand_kwh").alias("demand_kw"))
    return readers.clean_csv(t.spark, saved(t, df, "clean", "csv", header=True))


def price_file(t, df, name, header=("Delivery Date", "Time Block", "MCP (Rs/MWh)")):
    mwh = F.when(F.col("ts").cast("long") % 11 == 0, "-").otherwise(F.format_number(F.col("price") * 1000, 2))
    block = F.concat(F.date_format("ts", "HH:mm"), F.lit(" - "), F.date_format(F.col("ts") + F.expr("interval 1 hour"), "HH:mm"))
    out = df.select(F.date_format("ts", "dd-MM-yyyy").alias(header[0]), block.alias(header[1]), mwh.alias(header[2]))
    return saved(t, out, name, "csv", header=True)


@query("src_price_csv", "timestamp:t mcp_inr_mwh:2 mcp_inr_kwh:5", "SELECT ts AS timestamp, CASE WHEN CAST(epoch(ts) AS BIGINT) % 11 <> 0 THEN price * 1000 END AS mcp_inr_mwh, CASE WHEN CAST(epoch(ts) AS BIGINT) % 11 <> 0 THEN price END AS mcp_inr_kwh FROM price_series")
def _(t):
    return readers.price_csv(t.spark, price_file(t, t.price_series, "prices"))


@query("src_price_resolution", "resolution:s", "SELECT CASE WHEN count(*) < 2 THEN 'unknown' WHEN epoch(max(ts)) - epoch(min(ts)) <= 900 THEN '15min' ELSE '1h' END AS resolution FROM (SELECT DISTINCT ts FROM price_series ORDER BY ts LIMIT 2)")
def _(t):
    return readers.price_resolution(readers.price_csv(t.spark, price_file(t, t.price_series, "prices")))


@query("src_price_merge", "timestamp:t mcp_inr_kwh:5", """SELECT ts AS timestamp, CASE WHEN CAST(epoch(ts) AS BIGINT) % 11 <> 0 THEN CASE WHEN hour(ts) < 12 THEN price + 1.0 ELSE price END END AS mcp_inr_kwh FROM price_series WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'""")
def _(t):
    """The second export repeats the mornings at a changed price; exports are partitions in their order."""
    root = scratch_path(t.spark, "exports")
    for name, df in (("a", t.price_series), ("b", t.price_series.filter(F.hour("ts") < 12).withColumn("price", F.col("price") + 1.0))):
        text = t.spark.read.text(price_file(t, df.coalesce(1), name))
        text.coalesce(1).withColumn("export", F.lit(name)).write.mode("append").partitionBy("export").text(root)
    return readers.merge_prices(readers.price_csv(t.spark, root), ("export", "file", "block", "line"), start="2024-01-05")


@query("src_weather_json", "location_id:s ts:t latitude:3 longitude:3 temperature:4 humidity:4 ghi:4", "SELECT location_id, ts, 17.0 AS latitude, 81.8 AS longitude, temperature, humidity, ghi FROM weather")
def _(t):
    names = ["temperature", "humidity", "ghi"]
    hours = F.array_sort(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *names)))
    days = t.weather.groupBy("location_id", F.to_date("ts").alias("d")).agg(hours.alias("h"))
    block = F.struct(F.col("h.time").alias("time"), *[F.col(f"h.{n}").alias(n) for n in names])
    doc = F.to_json(F.struct("location_id", F.lit(17.0).alias("latitude"), F.lit(81.8).alias("longitude"), block.alias("hourly")))
    return readers.weather_json(t.spark.read.text(saved(t, days.select(doc.alias("value")), "weather", "text")), names)


@query("src_power_json", "location_id:s ts:t T2M:4 RH2M:4", "SELECT location_id, ts, CASE WHEN hour(ts) <> 4 THEN temperature END AS T2M, humidity AS RH2M FROM weather")
def _(t):
    key = F.date_format("ts", "yyyyMMddHH")
    t2m = F.when(F.hour("ts") == 4, -999.0).otherwise(F.col("temperature"))
    days = t.weather.groupBy("location_id", F.to_date("ts").alias("d")).agg(F.map_from_entries(F.collect_list(F.struct(key, t2m))).alias("a"), F.map_from_entries(F.collect_list(F.struct(key, F.col("humidity")))).alias("b"))
    doc = F.to_json(F.struct("location_id", F.create_map(F.lit("T2M"), "a", F.lit("RH2M"), F.map_concat("b", F.create_map(F.lit("bad"), F.lit(1.0)))).alias("parameter")))
    return readers.power_json(t.spark.read.text(saved(t, days.select(doc.alias("value")), "power", "text")), ["T2M", "RH2M"])


@query("src_locations_combine", "location_id:s ts:t temperature:4 pm2_5:4", "SELECT location_id, ts, temperature, CASE WHEN location_id = 'L1' THEN pm2_5 END AS pm2_5 FROM weather")
def _(t):
    a = saved(t, t.weather.filter("location_id = 'L0'").select("location_id", "ts", "temperature"), "l0")
    b = saved(t, t.weather.filter("location_id = 'L1'").select("location_id", "ts", "temperature", "pm2_5"), "l1")
    return readers.combine_locations([t.spark.read.parquet(a), t.spark.read.parquet(b)])


@query("snk_forecast_tables", "strategy:s meter_id:s ts:t predicted_kwh:4", "SELECT strategy, meter_id, ts, predicted_kwh FROM strategies")
def _(t):
    path, text = scratch_path(t.spark, "forecasts"), scratch_path(t.spark, "forecasts-csv")
    writers.write_forecasts(t.strategies, path, text)
    return writers.read_forecasts(t.spark, path)


@query("src_resume_skip", "strategy:s meter_id:s ts:t predicted_kwh:4", "SELECT strategy, meter_id, ts, predicted_kwh FROM strategies")
def _(t):
    """A first run stops after one strategy; the second run adds only what is missing."""
    path = scratch_path(t.spark, "resume")
    writers.append_rows(t.strategies.filter("strategy = 'A'"), path, "strategy")
    done = t.spark.read.parquet(path).select("strategy", "meter_id")
    writers.append_rows(writers.pending(t.strategies, done, ["strategy", "meter_id"]), path, "strategy")
    return t.spark.read.parquet(path)
