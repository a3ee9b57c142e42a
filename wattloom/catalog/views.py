"""Meter, weather, price, forecast and network views over the supplied tables, in Spark and in SQL.

Every meter view holds one row per meter and slot.  Raw events are reduced to that shape by a hash aggregate with
map-side combine, so a hot key shrinks before the shuffle and a later per-meter window is bounded by the calendar.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattloom.operators.grids import reindex, split_slots


def q(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def located(df: DataFrame) -> DataFrame:
    """The location of each meter: L0 or L1 by the last digit of its name."""
    return df.withColumn("location_id", F.concat(F.lit("L"), (F.right("meter_id", F.lit(1)).cast("int") % 2).cast("string")))


#: SQL of the same for a table alias with a dot, or none.
LOCATION = "'L' || (CAST(right({m}meter_id, 1) AS INTEGER) % 2)"


def weather_at(table: str) -> str:
    """Join condition of weather ``wx`` with the meters of a table alias."""
    return f"wx.ts = {table}.ts AND wx.location_id = {LOCATION.format(m=table + '.')}"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str, between: tuple[str, str, str] | None = None) -> DataFrame:
        """A supplied table with wall-clock times; ``between`` (column, from, before) filters the stored column, so it reaches the scan."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if between:
            c, start, end = between
            kind = df.schema[c].dataType
            df = df.filter((F.col(c) >= F.lit(start).cast(kind)) & (F.col(c) < F.lit(end).cast(kind)))
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df

    @cached_property
    def events(self):
        return self.read("events")

    @cached_property
    def readings(self):
        return self.hourly_readings(self.events)

    @staticmethod
    def hourly_readings(events: DataFrame) -> DataFrame:
        return (
            events.groupBy(F.col("user_id").cast("string").alias("meter_id"), F.date_trunc("hour", "ts").alias("ts"))
            .agg(q(F.sum("value"), 4).alias("demand_kwh"), F.count("*").alias("n_events"), F.sum("event_id").alias("tag"))
            .withColumn("voltage", 220.0 + (F.col("tag") % 41) * 0.5)
        )

    @cached_property
    def sites(self):
        meter = F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))
        return (
            self.events.groupBy(meter.alias("meter_id"), F.date_trunc("hour", "ts").alias("ts"))
            .agg(q(F.sum("value"), 4).alias("demand_kwh"), F.sum("event_id").alias("tag"))
        )

    @cached_property
    def grid(self):
        return reindex(self.sites.select("meter_id", "ts", "demand_kwh"), ["meter_id"], "ts", "1 hour")

    @cached_property
    def halves(self):
        """Sites at half hours, so that a month of a meter is longer than the longest row window."""
        part = F.explode(F.array(F.lit(0), F.lit(1)))
        return self.sites.select("meter_id", "ts", "demand_kwh", part.alias("p")).select("meter_id", F.timestamp_micros(F.unix_micros("ts") + F.col("p") * 1_800_000_000).alias("ts"), (F.col("demand_kwh") * (0.4 + 0.2 * F.col("p"))).alias("demand_kwh"))

    @cached_property
    def channels(self):
        tag, kw = F.col("tag"), F.col("kw")
        return (
            self.sites.withColumnRenamed("demand_kwh", "kw")
            .withColumn("pf", 0.8 + (tag % 21) * 0.01)
            .withColumn("kva", q(kw / F.col("pf"), 4))
            .withColumn("kvar", q(F.sqrt(F.greatest(F.col("kva") * F.col("kva") - kw * kw, F.lit(0.0))), 4))
            .withColumn("voltage", 380.0 + (tag % 70))
            .withColumn("frequency", 49.0 + (tag % 25) * 0.1)
            .withColumn("grid_import", F.when(tag % 13 == 0, kw * 0.01).otherwise(kw))
            .withColumn("soc", (tag % 101).cast("double"))
            .withColumn("current", ((tag * 7) % 200 - 100).cast("double"))
        )

    @cached_property
    def packets(self):
        ev = self.events.select(
            F.col("user_id").cast("string").alias("meter_id"),
            F.date_trunc("hour", "ts").alias("ts"),
            (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 200 as int), 0)")).alias("arrival_ts"),
            F.col("value").alias("kw"),
            "event_id",
        )
        resent = ev.filter("event_id % 10 = 0").withColumn("arrival_ts", F.col("arrival_ts") + F.expr("interval 5 minutes")).withColumn("kw", F.col("kw") + 1.0)
        return ev.unionByName(resent)

    @cached_property
    def lines(self):
        """One packet per order line with six electrical channels; some values are missing or out of range."""
        li = self.read("lineitem")
        qty = F.col("l_quantity")
        pf = 0.8 + F.col("l_discount") * 2.0
        return li.select(
            F.col("l_orderkey").alias("packet_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_suppkey").cast("string").alias("meter_id"),
            F.when(F.col("l_partkey") % 19 != 0, qty * 10.0).alias("kw"),
            q(qty * 10.0 / pf, 4).alias("kva"),
            q(qty * 10.0 / pf * F.sqrt(F.greatest(1.0 - pf * pf, F.lit(0.0))), 4).alias("kvar"),
            (280.0 + F.col("l_tax") * 2000.0).alias("voltage"),
            F.when(F.col("l_partkey") % 23 != 0, pf + F.when(F.col("l_partkey") % 7 == 0, 0.3).otherwise(0.0)).alias("pf"),
            (F.col("l_partkey") % 150).cast("double").alias("delay_min"),
        )

    @cached_property
    def weather(self):
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        slot = F.timestamp_seconds(1704067200 + (key % 720) * 3600)
        base = (
            self.read("orders")
            .groupBy(F.concat(F.lit("L"), (cust % 2).cast("string")).alias("location_id"), slot.alias("ts"))
            .agg(
                q(F.avg("o_totalprice") / 9000.0 - 2.0, 4).alias("temperature"),
                q(40.0 + F.avg(cust % 60), 4).alias("humidity"),
                q(1000.0 + F.avg(key % 17), 4).alias("pressure"),
                q(F.avg(cust % 101), 4).alias("cloud_cover"),
                q(F.greatest(F.avg(cust % 7) - 3.2, F.lit(0.0)), 4).alias("precipitation"),
                q(F.avg(cust % 12), 4).alias("wind_speed"),
                q(F.avg(key % 900), 4).alias("light"),
                q(F.avg(cust % 90), 4).alias("pm2_5"),
                q(F.avg(cust % 80) / 100.0, 4).alias("aod"),
                q(F.avg(cust % 110), 4).alias("dust"),
            )
        )
        return (
            base.withColumn("ghi", F.when(F.hour("ts").between(6, 18), F.col("light")).otherwise(0.0))
            .drop("light")
            .withColumn("dni", q(F.col("ghi") * 0.7, 4))
            .withColumn("dhi", q(F.col("ghi") * (0.1 + F.col("cloud_cover") / 250.0), 4))
            .withColumn("clear_sky", q(F.col("ghi") * 1.2, 4))
        )

    @cached_property
    def prices(self):
        """288 rows at any scale: 12 months by 24 hours."""
        return (
            self.read("orders")
            .groupBy(F.month("o_orderdate").alias("month"), (F.col("o_orderkey") % 24).cast("int").alias("hour"))
            .agg(q(2.0 + F.avg("o_totalprice") / 60000.0, 2).alias("price"))
        )

    @cached_property
    def price_series(self):
        slot = F.timestamp_seconds(1704067200 + (F.col("o_orderkey") % 240) * 10800)
        return self.read("orders").groupBy(slot.alias("ts")).agg(q(2.0 + F.avg("o_totalprice") / 60000.0, 2).alias("price"))

    @cached_property
    def fc(self):
        past = self.sites.select("meter_id", (F.col("ts") + F.expr("interval 7 days")).alias("ts"), F.col("demand_kwh").alias("predicted_kwh"))
        actual = self.sites.select("meter_id", "ts", F.col("demand_kwh").alias("actual_kwh"))
        return (
            past.join(actual, ["meter_id", "ts"])
            .withColumn("q10_kwh", F.col("predicted_kwh") * 0.8)
            .withColumn("q90_kwh", F.col("predicted_kwh") * 1.2)
        )

    @cached_property
    def fc30(self):
        return split_slots(self.fc, minutes=30)

    @cached_property
    def strategies(self):
        """Three forecasts of one window: one week, one day and two days back."""
        shifts = F.array(
            *[F.struct(F.lit(s).alias("strategy"), F.lit(h).alias("hours")) for s, h in (("A", 168), ("B", 24), ("C", 48))]
        )
        return (
            self.sites.select("meter_id", "ts", "demand_kwh", F.explode(shifts).alias("s"))
            .select(
                "s.strategy",
                "meter_id",
                F.timestamp_micros(F.unix_micros("ts") + F.col("s.hours").cast("bigint") * 3600000000).alias("ts"),
                F.col("demand_kwh").alias("predicted_kwh"),
            )
            .filter("ts >= timestamp'2024-01-08 00:00:00'")
        )

    @cached_property
    def registry(self):
        key = F.col("c_custkey")
        seg = F.col("c_mktsegment")
        tier = (
            F.when(seg == "BUILDING", "HT (>5kWh)").when(seg == "MACHINERY", "Large (1.5-5k)")
            .when(seg == "FURNITURE", "Medium (0.5-1.5k)").otherwise("Small (<500)")
        )
        return self.read("customer").select(
            F.concat(F.lit("M"), key.cast("string")).alias("msn"),
            key.alias("k"),
            tier.alias("tier"),
            q(F.abs("c_acctbal") / 350.0, 2).alias("mape"),
            ((key * 7) % 25).cast("double").alias("peak_mape"),
            q(F.abs("c_acctbal") * 0.9, 2).alias("mean_wh"),
            "c_nationkey",
        )

    @cached_property
    def nodes(self):
        c = self.registry.join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("msn").alias("node_id"), F.lit("meter").alias("kind"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("substation_id"), F.col("mape"),
        )
        n = self.read("nation").select(
            F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("node_id"), F.lit("feeder").alias("kind"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("substation_id"), F.lit(None).cast("double").alias("mape"),
        )
        r = self.read("region").select(
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("substation").alias("kind"),
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("substation_id"), F.lit(None).cast("double").alias("mape"),
        )
        s = self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("bess").alias("kind"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("substation_id"), F.lit(None).cast("double").alias("mape"),
        )
        return c.unionByName(n).unionByName(r).unionByName(s)

    @cached_property
    def edges(self):
        c = self.read("customer").select(
            F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("F"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("connected_to").alias("edge_type"))
        n = self.read("nation").select(
            F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("fed_by").alias("edge_type"))
        s = self.read("supplier").select(
            F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("located_at").alias("edge_type"))
        return c.unionByName(n).unionByName(s)

    @cached_property
    def schedule(self):
        tag, kw = F.col("tag"), F.col("demand_kwh")
        return self.sites.select(
            F.col("meter_id").alias("site_id"), "ts", "tag", kw.alias("demand_kwh"),
            F.when(tag % 5 == 0, kw * 0.5).otherwise(0.0).alias("charge_kwh"),
            F.when(tag % 5 == 1, kw * 0.4).otherwise(0.0).alias("discharge_kwh"),
            F.when(tag % 5 == 2, kw * 0.25).otherwise(0.0).alias("curtail_kwh"),
            F.when(tag % 5 == 1, kw * 0.6).otherwise(kw).alias("grid_kwh"),
            F.when(tag % 3 == 0, kw * 0.3).otherwise(0.0).alias("solar_kwh"),
            F.when(tag % 2 == 0, kw * 0.2).otherwise(0.0).alias("iex_kwh"),
            (3.0 + (tag % 60) * 0.1).alias("iex_price"),
            F.lit(6.5).alias("landed_cost"),
            (tag % 23).cast("double").alias("block_mape"),
            (tag % 11).cast("double").alias("kva_shaved"),
        )


def _q(expr: str, digits: int) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


SQL_VIEWS = {
    "readings": f"""SELECT *, 220.0 + (tag % 41) * 0.5 AS voltage FROM (
        SELECT CAST(user_id AS VARCHAR) AS meter_id, date_trunc('hour', ts) AS ts, {_q('sum(value)', 4)} AS demand_kwh,
        count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS tag FROM events GROUP BY 1, 2)""",
    "sites": f"""SELECT event_type || '-' || (user_id % 4) AS meter_id, date_trunc('hour', ts) AS ts,
        {_q('sum(value)', 4)} AS demand_kwh, CAST(sum(event_id) AS BIGINT) AS tag FROM events GROUP BY 1, 2""",
    "grid": """SELECT g.meter_id, g.ts, s.demand_kwh FROM (
        SELECT meter_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM sites GROUP BY 1) g
        LEFT JOIN sites s ON s.meter_id = g.meter_id AND s.ts = g.ts""",
    "halves": "SELECT meter_id, ts + to_minutes(30 * p) AS ts, demand_kwh * (0.4 + 0.2 * p) AS demand_kwh FROM sites, (VALUES (0), (1)) parts(p)",
    "channels": f"""SELECT *, {_q('sqrt(greatest(kva * kva - kw * kw, 0.0))', 4)} AS kvar FROM (
        SELECT *, {_q('kw / pf', 4)} AS kva FROM (
        SELECT meter_id, ts, tag, demand_kwh AS kw, 0.8 + (tag % 21) * 0.01 AS pf, 380.0 + (tag % 70) AS voltage,
        49.0 + (tag % 25) * 0.1 AS frequency, CASE WHEN tag % 13 = 0 THEN demand_kwh * 0.01 ELSE demand_kwh END AS grid_import,
        CAST(tag % 101 AS DOUBLE) AS soc, CAST((tag * 7) % 200 - 100 AS DOUBLE) AS current FROM sites))""",
    "packets": """SELECT CAST(user_id AS VARCHAR) AS meter_id, date_trunc('hour', ts) AS ts,
        ts + to_minutes(event_id % 200) AS arrival_ts, value AS kw, event_id FROM events
        UNION ALL SELECT CAST(user_id AS VARCHAR), date_trunc('hour', ts), ts + to_minutes(event_id % 200) + INTERVAL 5 MINUTES,
        value + 1.0, event_id FROM events WHERE event_id % 10 = 0""",
    "lines": f"""SELECT l_orderkey AS packet_id, l_linenumber AS line, CAST(l_suppkey AS VARCHAR) AS meter_id,
        CASE WHEN l_partkey % 19 <> 0 THEN l_quantity * 10.0 END AS kw,
        {_q('l_quantity * 10.0 / (0.8 + l_discount * 2.0)', 4)} AS kva,
        {_q('l_quantity * 10.0 / (0.8 + l_discount * 2.0) * sqrt(greatest(1.0 - (0.8 + l_discount * 2.0) * (0.8 + l_discount * 2.0), 0.0))', 4)} AS kvar,
        280.0 + l_tax * 2000.0 AS voltage,
        CASE WHEN l_partkey % 23 <> 0 THEN 0.8 + l_discount * 2.0 + CASE WHEN l_partkey % 7 = 0 THEN 0.3 ELSE 0.0 END END AS pf,
        CAST(l_partkey % 150 AS DOUBLE) AS delay_min FROM lineitem""",
    "weather": f"""SELECT *, {_q('ghi * 0.7', 4)} AS dni, {_q('ghi * (0.1 + cloud_cover / 250.0)', 4)} AS dhi, {_q('ghi * 1.2', 4)} AS clear_sky FROM (
        SELECT * EXCLUDE (light), CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN light ELSE 0.0 END AS ghi FROM (
        SELECT 'L' || (o_custkey % 2) AS location_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(o_orderkey % 720) AS ts,
        {_q('avg(o_totalprice) / 9000.0 - 2.0', 4)} AS temperature, {_q('40.0 + avg(o_custkey % 60)', 4)} AS humidity,
        {_q('1000.0 + avg(o_orderkey % 17)', 4)} AS pressure, {_q('avg(o_custkey % 101)', 4)} AS cloud_cover,
        {_q('greatest(avg(o_custkey % 7) - 3.2, 0.0)', 4)} AS precipitation, {_q('avg(o_custkey % 12)', 4)} AS wind_speed,
        {_q('avg(o_orderkey % 900)', 4)} AS light, {_q('avg(o_custkey % 90)', 4)} AS pm2_5, {_q('avg(o_custkey % 80) / 100.0', 4)} AS aod,
        {_q('avg(o_custkey % 110)', 4)} AS dust FROM orders GROUP BY 1, 2))""",
    "prices": f"""SELECT month(o_orderdate) AS month, CAST(o_orderkey % 24 AS INTEGER) AS hour,
        {_q('2.0 + avg(o_totalprice) / 60000.0', 2)} AS price FROM orders GROUP BY 1, 2""",
    "price_series": f"""SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(3 * (o_orderkey % 240)) AS ts,
        {_q('2.0 + avg(o_totalprice) / 60000.0', 2)} AS price FROM orders GROUP BY 1""",
    "fc": """SELECT a.meter_id, a.ts, b.demand_kwh AS predicted_kwh, a.demand_kwh AS actual_kwh, b.demand_kwh * 0.8 AS q10_kwh,
        b.demand_kwh * 1.2 AS q90_kwh FROM sites a JOIN sites b ON a.meter_id = b.meter_id AND a.ts = b.ts + INTERVAL 7 DAYS""",
    "fc30": """SELECT meter_id, ts + to_minutes(30 * p) AS ts, predicted_kwh / 2.0 AS predicted_kwh, actual_kwh / 2.0 AS actual_kwh,
        q10_kwh / 2.0 AS q10_kwh, q90_kwh / 2.0 AS q90_kwh FROM fc, (VALUES (0), (1)) parts(p)""",
    "strategies": """SELECT * FROM (
        SELECT 'A' AS strategy, meter_id, ts + INTERVAL 168 HOURS AS ts, demand_kwh AS predicted_kwh FROM sites
        UNION ALL SELECT 'B', meter_id, ts + INTERVAL 24 HOURS, demand_kwh FROM sites
        UNION ALL SELECT 'C', meter_id, ts + INTERVAL 48 HOURS, demand_kwh FROM sites) WHERE ts >= TIMESTAMP '2024-01-08 00:00:00'""",
    "registry": f"""SELECT 'M' || c_custkey AS msn, c_custkey AS k,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'HT (>5kWh)' WHEN 'MACHINERY' THEN 'Large (1.5-5k)' WHEN 'FURNITURE' THEN 'Medium (0.5-1.5k)' ELSE 'Small (<500)' END AS tier,
        {_q('abs(c_acctbal) / 350.0', 2)} AS mape, CAST((c_custkey * 7) % 25 AS DOUBLE) AS peak_mape,
        {_q('abs(c_acctbal) * 0.9', 2)} AS mean_wh, c_nationkey FROM customer""",
    "nodes": """SELECT msn AS node_id, 'meter' AS kind, 'R' || n_regionkey AS substation_id, mape FROM registry JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'F' || n_nationkey, 'feeder', 'R' || n_regionkey, NULL FROM nation
        UNION ALL SELECT 'R' || r_regionkey, 'substation', 'R' || r_regionkey, NULL FROM region
        UNION ALL SELECT 'B' || s_suppkey, 'bess', 'R' || n_regionkey, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "edges": """SELECT 'M' || c_custkey AS src, 'F' || c_nationkey AS dst, 'connected_to' AS edge_type FROM customer
        UNION ALL SELECT 'F' || n_nationkey, 'R' || n_regionkey, 'fed_by' FROM nation
        UNION ALL SELECT 'B' || s_suppkey, 'F' || s_nationkey, 'located_at' FROM supplier""",
    "schedule": """SELECT meter_id AS site_id, ts, tag, demand_kwh,
        CASE WHEN tag % 5 = 0 THEN demand_kwh * 0.5 ELSE 0.0 END AS charge_kwh, CASE WHEN tag % 5 = 1 THEN demand_kwh * 0.4 ELSE 0.0 END AS discharge_kwh,
        CASE WHEN tag % 5 = 2 THEN demand_kwh * 0.25 ELSE 0.0 END AS curtail_kwh, CASE WHEN tag % 5 = 1 THEN demand_kwh * 0.6 ELSE demand_kwh END AS grid_kwh,
        CASE WHEN tag % 3 = 0 THEN demand_kwh * 0.3 ELSE 0.0 END AS solar_kwh, CASE WHEN tag % 2 = 0 THEN demand_kwh * 0.2 ELSE 0.0 END AS iex_kwh,
        3.0 + (tag % 60) * 0.1 AS iex_price, 6.5 AS landed_cost, CAST(tag % 23 AS DOUBLE) AS block_mape, CAST(tag % 11 AS DOUBLE) AS kva_shaved FROM sites""",
}
