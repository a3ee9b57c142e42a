"""What the fourth round of findings was about: correlations that are level, zero or of values that do not vary."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from check import compare, duck
from test_round_three import small_tables
from wattloom.catalog import ORACLES, QUERIES

DAYS = 40
HOURS = sorted(f"h{h}" for h in range(24))


def readings(spark, meters):
    """One event per meter, day and hour; ``meters`` maps the meter to a function of hour and day."""
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(days=d, hours=h), m, value(h, d)) for m, value in meters.items() for d in range(DAYS) for h in range(24)]
    df = pd.DataFrame(rows, columns=["ts", "user_id", "value"]).sample(frac=1, random_state=4)
    df = spark.createDataFrame(df.assign(value=df["value"].astype("object").where(df["value"].notna(), None)), "ts timestamp_ntz, user_id long, value double")
    return df.selectExpr("monotonically_increasing_id() as event_id", "ts", "user_id", "'view' as event_type", "value", "'{\"k\": 1}' as props")


@pytest.fixture(params=[True, False], ids=["one part", "many parts"])
def selected(spark, tmp_path, request):
    """Chosen features of each meter, compared with the SQL; sums of a group come from one part of the table or from many."""

    def run(meters, without_time=()):
        events = readings(spark, meters).withColumn("ts", F.when(~F.hour("ts").isin(*without_time), F.col("ts")))
        folder = small_tables(spark, tmp_path, events=events)
        name = "spark.sql.adaptive.coalescePartitions.enabled"
        before = spark.conf.get(name)
        spark.conf.set(name, str(request.param).lower())
        try:
            got = QUERIES["top_feature_select"](spark, folder).toPandas()
        finally:
            spark.conf.set(name, before)
        assert compare(got.copy(), duck(folder).execute(ORACLES["top_feature_select"]).df()) == ""
        return {m: sorted(g.feature) for m, g in got.groupby("meter_id")}, got.set_index(["meter_id", "feature"]).gain

    return run


def test_level_gains_are_taken_by_name(selected):
    """Demands of all hours are multiples of one series, so that no hour is ahead of another."""
    features, gain = selected({1: lambda h, d: round((d * 37 % 101 + d) * (h + 1) * 0.17, 2)})
    assert features == {"1": HOURS[:13]} and gain.nunique() == 1


def test_a_covariance_of_zero_is_no_gain(selected):
    """Nine hours rise; the others are the same forwards and backwards in time."""
    features, _ = selected({1: lambda h, d: 3.3 + d * h * 0.11 + d % 3 if 0 < h < 10 else round((d * (DAYS - 1 - d) * 29 + h) % 83 * 0.37, 2)})
    assert features == {"1": [f"h{h}" for h in range(1, 10)]}


def test_hours_that_do_not_vary_have_no_number(selected):
    """All hours of one meter stand still, five of the other; readings that are missing are no pairs."""
    still = lambda h, d: 22.19 + h / 100
    some = lambda h, d: still(h, d) if h < 5 else None if h == 5 or h == 6 and d else 3.3 + d * h * 0.11 + d % 3
    features, gain = selected({1: still, 2: some})
    assert features["1"] == HOURS[:13] and gain["1"].isna().all()
    assert len(features["2"]) == 13 and sorted(gain["2"][gain["2"].isna()].index) == ["h0", "h1", "h2", "h3", "h4", "h6"]


def test_readings_without_time_come_last(selected):
    """Hours 1 to 3 rise and the others fall, so that ten are filled up by name; the events of hour 23 have lost their times."""
    features, _ = selected({1: lambda h, d: 400 + (d if 0 < h < 4 else -d) * 1.1 + d % 3 * h}, without_time=[23])
    assert features == {"1": sorted(["h1", "h2", "h3", *[h for h in HOURS if h not in ("h1", "h2", "h3")][:7]])}


def test_an_infinite_reading_stops_nothing(selected):
    """One of hour 4 and, below zero, one of hour 5 leave their hours without a number; a large one of hour 6 does not."""
    odd = {(4, 7): float("inf"), (5, 9): float("-inf"), (6, 3): 9e10}
    features, gain = selected({1: lambda h, d: odd.get((h, d), 3.3 + d * h * 0.11 + d % 3)})
    assert len(features["1"]) == 13 and sorted(gain["1"][gain["1"].isna()].index) == ["h4", "h5"]
