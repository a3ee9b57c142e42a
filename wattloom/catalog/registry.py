"""Registry that pairs every Spark query with its SQL check and one output contract.

``cols`` lists the output as ``name:code`` where the code is ``s`` string, ``t`` timestamp, ``d`` date,
``i`` integer, ``b`` boolean or a digit (decimals kept of a double).  The same contract is applied to both sides,
so a comparison sees equal types and equal rounding.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.catalog.views import SQL_VIEWS, Tables
from wattloom.session import ship_package

# Both engines round down after this shift; it is off one half because means of short decimals often fall on exact halves.
ROUND_AT = 0.49371

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _contract(cols: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in cols.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    """Project a frame onto its output contract."""
    out = []
    for name, code in _contract(cols):
        c = F.col(name)
        if code == "s":
            c = c.cast("string")
        elif code == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif code == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif code == "i":
            c = c.cast("bigint")
        elif code == "b":
            c = c.cast("boolean")
        else:
            scale = float(10 ** int(code))
            c = c.cast("double")
            c = F.when(~F.isnan(c), F.floor(c * scale + ROUND_AT) / scale)
        out.append(c.alias(name))
    return df.select(*out)


def _shape_sql(cols: str) -> str:
    out = []
    for name, code in _contract(cols):
        if code == "s":
            e = f"CAST({name} AS VARCHAR)"
        elif code == "t":
            e = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
        elif code == "d":
            e = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d')"
        elif code == "i":
            e = f"CAST({name} AS BIGINT)"
        elif code == "b":
            e = f"CAST({name} AS BOOLEAN)"
        else:
            scale = f"1e{code}"
            e = f"floor(CAST({name} AS DOUBLE) * {scale} + {ROUND_AT}) / {scale}"
        out.append(f"{e} AS {name}")
    return ", ".join(out)


def _needed_views(text: str) -> list[str]:
    order: list[str] = []

    def visit(body: str) -> None:
        for name, view in SQL_VIEWS.items():
            if name not in order and re.search(rf"\b{name}\b", body):
                visit(view)
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def _doubles(sql: str) -> str:
    """Write decimal literals as doubles, outside quoted text."""
    parts = sql.split("'")
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", parts[i])
    return "'".join(parts)


def oracle(sql: str, cols: str) -> str:
    names = _needed_views(sql)
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in names] + [f"body AS ({sql})"]
    return _doubles("WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT {_shape_sql(cols)} FROM body")


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return shape(fn(Tables(spark, sf_dir)), cols)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, cols)
        return fn

    return wrap
