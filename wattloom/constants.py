"""Fixed values of the domain: tariff, loss, calendar and channel limits."""

# Physical limits per meter channel.
CHANNEL_LIMITS = {
    "kw": (0.0, 50000.0),
    "kvar": (-20000.0, 20000.0),
    "kva": (0.0, 50000.0),
    "voltage": (300.0, 500.0),
    "current": (0.0, 5000.0),
    "pf": (0.0, 1.0),
}
CHANNELS = ("kw", "kvar", "kva", "voltage", "current", "pf")

# Weights and delay ramp of the interval quality score.
SCORE_WEIGHTS = {"completeness": 0.4, "timeliness": 0.3, "validity": 0.2, "consistency": 0.1}
LATE_RAMP_START_MIN = 30.0
LATE_RAMP_END_MIN = 120.0
LATE_RAMP_FLOOR = 0.5

# Grid loss factors, per-kWh charges and the monthly demand charge.
CTU_LOSS = 0.039
STU_LOSS = 0.0275
DISTRIBUTION_LOSS = 0.0272
SLDC_CHARGE = 0.41
CROSS_SUBSIDY = 0.31
ADDITIONAL_SURCHARGE = 0.47
DEMAND_CHARGE = 475.0

# Named day blocks, hours in [start, end).
DAY_BLOCKS = {"morning": (6, 10), "solar": (10, 18), "peak": (18, 22)}
NIGHT_BLOCK = "night"

# Recurring public holidays as (month, day).
HOLIDAYS_MONTH_DAY = [
    (1, 14), (1, 26), (3, 14), (4, 6), (4, 14), (5, 1), (8, 15),
    (8, 27), (9, 5), (10, 2), (10, 12), (10, 20), (11, 1), (12, 25),
]

# Loads and limits used by several operators.
NOMINAL_VOLTAGE = 415.0
FREQUENCY_BAND = (49.5, 50.5)
ZERO_LOAD_KWH = 0.0005
WH_PER_HALF_HOUR_TO_KW = 2.0 / 1000.0
MICROS_PER_HOUR = 3_600_000_000
