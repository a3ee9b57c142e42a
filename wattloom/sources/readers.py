"""Readers of meter, price, weather and quality files.  Schemas are declared; no reader infers or collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattloom.operators.grids import one_per_slot


def number(c: str | Column) -> Column:
    """Text with thousands separators to a double; anything else becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, ",", "")).try_cast("double")


def row_mean(columns: list[Column]) -> Column:
    """Mean of the present values of a row."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.when(F.size(present) > 0, total / F.nullif(F.size(present), F.lit(0)))


def meters(single: DataFrame, three: DataFrame, profile: DataFrame) -> DataFrame:
    """One- and three-phase readings in one schema, without null demand, with the tier of the meter profile."""
    a = single.select("ts", "demand_wh", F.col("v_ave").alias("voltage"), F.col("msn").cast("string").alias("msn"), F.lit("1PH").alias("phase"))
    b = three.select("ts", "demand_wh", F.col("v_avg").alias("voltage"), F.col("msn").cast("string").alias("msn"), F.lit("3PH").alias("phase"))
    rows = a.unionByName(b).filter(F.col("demand_wh").isNotNull() & ~F.isnan("demand_wh"))
    return rows.join(profile.select(F.col("msn").cast("string").alias("msn"), "tier"), "msn", "left")


def raw_meters(df: DataFrame, order: str, energy: str = "wh_imp", voltages: tuple[str, ...] = ("v_r", "v_y", "v_b"), vendor: DataFrame | None = None) -> DataFrame:
    """Text readings to numbers, the first copy of each (meter, time) kept, phases averaged, vendor columns attached."""
    out = df.select("msn", "ts", F.col(order).alias("_o"), number(energy).alias("demand_wh"), row_mean([number(v) for v in voltages]).alias("voltage"))
    out = one_per_slot(out, ["msn", "ts"], prefer="_o", earliest=True).drop("_o").filter("demand_wh is not null")
    return out if vendor is None else out.join(vendor, "msn", "left")


def wide_to_long(df: DataFrame, ids: list[str], actual: str = "{}_act", peak: str = "{}_max", ts: str = "timestamp", regions: DataFrame | None = None) -> DataFrame:
    """One column per consumer to one row per consumer and time."""
    items = F.array(*[F.struct(F.lit(i).alias("consumer_id"), F.col(f"`{actual.format(i)}`").cast("double").alias("demand_vah"), F.col(f"`{peak.format(i)}`").cast("double").alias("max_demand_vah")) for i in ids])
    out = df.filter(F.col(ts).isNotNull()).select(ts, F.explode(items).alias("_i")).select(ts, "_i.*")
    out = out.withColumn("demand_kwh", F.col("demand_vah") / 1000.0).withColumn("demand_kw", F.col("demand_kwh"))
    if regions is None:
        return out
    return out.join(regions, "consumer_id", "left").withColumn("region", F.coalesce("region", F.lit("Unknown")))


def month_blocks(df: DataFrame, months: list[int], ids: list[str], column: str = "{}_{}", hour: str = "hour") -> DataFrame:
    """Side-by-side month blocks to rows; unreadable or empty cells become 0."""
    cells = [F.struct(F.lit(m).alias("month"), F.lit(i).alias("consumer_id"), F.coalesce(number(F.col(f"`{column.format(m, i)}`")), F.lit(0.0)).alias("max_demand_vah")) for m in months for i in ids]
    return df.select(hour, F.explode(F.array(*cells)).alias("_c")).select("_c.month", hour, "_c.consumer_id", "_c.max_demand_vah")


QUALITY_SCHEMAS = {
    "gaps": "consumer_id string, gap_start string, gap_end string, gap_hours double",
    "frozen": "consumer_id string, run_start string, run_end string, run_length int",
    "outliers": "consumer_id string, timestamp string, value double",
    "summary": "consumer_id string, completeness double",
    "duplicates": "consumer_id string, timestamp string, copies int",
}


def quality_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The five quality tables with bounds as timestamps; a table without a path is empty."""
    out = {}
    for name, schema in QUALITY_SCHEMAS.items():
        df = spark.read.csv(paths[name], schema=schema, header=True) if name in paths else spark.createDataFrame([], schema)
        bounds = [c for c in df.columns if c.endswith(("_start", "_end")) or c == "timestamp"]
        out[name] = df.withColumns({c: F.try_to_timestamp(c) for c in bounds}) if bounds else df
    return out


def clean_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="meter_id string, ts timestamp, demand_kw double", header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


# Header fragments of day-ahead price exports, checked in this order.
PRICE_HEADERS = [("date", "date_str"), ("time block", "time_block"), ("mcp", "mcp_inr_mwh"), ("mcv", "mcv_mw"), ("purchase", "purchase_bid_mw"), ("sell", "sell_bid_mw"), ("scheduled", "scheduled_volume_mw")]


# Date forms of price exports, day first.
PRICE_DATES = ["dd-MM-yyyy", "d-M-yyyy", "d-MMM-yyyy", "yyyy-MM-dd"]


def price_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Day-ahead export: columns found by header fragment in each file, block start plus day-first date, price per MWh and kWh.

    Files may name and order their columns differently; their first lines are read as data and joined back by file.
    """
    width = spark.read.text(paths).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1  # no line has more cells
    raw = spark.read.csv(paths, header=False, schema=", ".join(f"_c{i} string" for i in range(width)))
    raw = raw.select(F.array(*[c for c in raw.columns if c.startswith("_c")]).alias("cells"), *[c for c in raw.columns if not c.startswith("_c")], F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    head = raw.groupBy("file").agg(F.min_by(F.struct("block", "line", "cells"), F.struct("block", "line")).alias("h"))
    place = {new: F.expr(f"aggregate(sequence(0, size(h.cells) - 1), -1, (a, i) -> CASE WHEN a < 0 AND contains(lower(trim(h.cells[i])), '{part}') THEN i ELSE a END)") for part, new in PRICE_HEADERS}
    head = head.select("file", F.col("h.block").alias("_block"), F.col("h.line").alias("_line"), *[p.alias(f"_at_{new}") for new, p in place.items()])
    df = raw.join(head, "file").filter("block <> _block or line <> _line")
    df = df.select(*[c for c in raw.columns if c != "cells"], *[F.when(F.col(f"_at_{new}") >= 0, F.get("cells", F.col(f"_at_{new}"))).alias(new) for _, new in PRICE_HEADERS])
    start = F.coalesce(F.trim(F.split("time_block", "-")[0]), F.lit("00:00"))
    text = F.concat_ws(" ", F.trim(F.regexp_replace("date_str", "/", "-")), start)
    df = df.withColumns({"timestamp": F.coalesce(*[F.try_to_timestamp(text, F.lit(f"{form} HH:mm")) for form in PRICE_DATES]), "mcp_inr_mwh": number("mcp_inr_mwh")})
    return df.withColumn("mcp_inr_kwh", F.col("mcp_inr_mwh") / 1000.0)


def price_resolution(df: DataFrame) -> DataFrame:
    """Step of a price table from its two earliest times: 15min, 1h or unknown."""
    first = df.filter("timestamp is not null").select("timestamp").distinct().orderBy("timestamp").limit(2).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n"))
    step = F.unix_seconds("b") - F.unix_seconds("a")
    return first.select(F.when(F.col("n") < 2, "unknown").when(step <= 900, "15min").otherwise("1h").alias("resolution"))


def merge_prices(df: DataFrame, order: tuple[str, ...] = ("file", "block", "line"), start: str | None = None, end: str | None = None) -> DataFrame:
    """Many price files as one series; the last row in ``order`` wins a repeated time."""
    df = df.filter("timestamp is not null")
    if start:
        df = df.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    df = df.select("timestamp", F.struct(*order).alias("_o"), "mcp_inr_mwh", "mcp_inr_kwh")
    return one_per_slot(df, ["timestamp"], prefer="_o").drop("_o")


def weather_json(df: DataFrame, variables: list[str], text: str = "value", location: str = "location_id") -> DataFrame:
    """Columnar weather JSON (parallel arrays under ``hourly``) to one row per time."""
    arrays = ", ".join(f"{v}: array<double>" for v in variables)
    doc = F.from_json(text, f"{location} string, latitude double, longitude double, hourly struct<time: array<string>, {arrays}>")
    flat = df.select(doc.alias("d")).select(f"d.{location}", "d.latitude", "d.longitude", F.explode(F.arrays_zip("d.hourly.time", *[f"d.hourly.{v}" for v in variables])).alias("r"))
    return flat.select(location, "latitude", "longitude", F.try_to_timestamp("r.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"), *[F.col(f"r.{v}") for v in variables])


def power_json(df: DataFrame, parameters: list[str], text: str = "value", location: str = "location_id", missing: float = -999.0) -> DataFrame:
    """Map-of-maps JSON (parameter to hour key to value) to one row per hour; fill values become null, bad keys drop."""
    doc = F.from_json(text, f"{location} string, parameter map<string, map<string, double>>")
    long = df.select(doc.alias("d")).select(f"d.{location}", F.explode("d.parameter").alias("name", "hours"))
    long = long.select(location, "name", F.explode("hours").alias("key", "v")).withColumn("ts", F.try_to_timestamp("key", F.lit("yyyyMMddHH")))
    value = F.nullif(F.col("v"), F.lit(missing))
    return long.filter("ts is not null").groupBy(location, "ts").pivot("name", parameters).agg(F.max(value))


def combine_locations(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
