"""Table functions for SQL: schedules as rows of a partitioned, ordered table argument."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from wattloom.functions.money import landed_cost
from wattloom.operators.dispatch import HOUR_FIELDS, run_days
from wattloom.session import ship_package

HOURS = 24


@udtf(returnType="site_id string, day timestamp, hour int, " + ", ".join(f"{f} double" for f in HOUR_FIELDS))
class BatteryDay:
    """Greedy battery schedule of one site and day.

    Rows of the partition carry site_id, day, hour, demand, solar and landed (the cost of a bought unit); hours that are
    missing have neither demand nor sun and the landed cost of a price of 0.  Several rows of an hour add up, their landed
    costs are averaged.  One row per hour comes back.
    """

    def __init__(self):
        self.at = None
        self.demand, self.solar, self.landed, self.rows = (np.zeros(HOURS) for _ in range(4))

    def eval(self, row: Row, capacity_kwh: float, power_kw: float, strategy: str, tariff: float, idle_cost: float):
        self.at, self.plan = (row["site_id"], row["day"]), (float(capacity_kwh), float(power_kw), strategy, float(tariff), float(idle_cost))
        h = row["hour"]
        self.demand[h] += row["demand"] or 0.0
        self.solar[h] += row["solar"] or 0.0
        self.landed[h] += row["landed"] or 0.0
        self.rows[h] += 1

    def terminate(self):
        if self.at is None:
            return
        capacity, power, strategy, tariff, idle = self.plan
        landed = np.where(self.rows > 0, self.landed / np.maximum(self.rows, 1), idle)
        out = run_days(self.demand[None], self.solar[None], landed[None], np.array([capacity]), np.array([power]), np.array([strategy]), tariff)
        for h in range(HOURS):
            yield (*self.at, h, *(float(out[f][0, h]) for f in HOUR_FIELDS))


def register(spark: SparkSession) -> None:
    """Make ``battery_day`` known to SQL.

    ``select * from battery_day(table(hours) partition by (site_id, day) order by (hour), 200, 50, 'cheap_grid', 6.5, idle)``
    """
    ship_package(spark)
    spark.udtf.register("battery_day", BatteryDay)


def idle_cost(spark: SparkSession) -> float:
    """Landed cost of a price of 0."""
    from pyspark.sql import functions as F

    return float(spark.range(1).select(landed_cost(F.lit(0.0))).first()[0])
