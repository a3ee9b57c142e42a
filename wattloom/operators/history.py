"""Rolling medians and exponential means of past rows, on blocks of rows.

The rows of a key are numbered through row counts of time chunks and packed into blocks of ``BLOCK`` rows; a key of any length
is many blocks, dealt over all tasks.  What a block needs from before it is a few blocks (medians) or one state (exponential
means), so no task holds a key, and everything is array functions in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.operators.frames import MICROS

#: Rows in a block; medians up to this width sort their own rows, wider ones share the sorted rows of a block.
BLOCK = 48
#: Blocks that stay together; the first few blocks before them are repeated.
GROUP = 64


def number_rows(df: DataFrame, keys: list[str], ts: str = "ts", chunk_us: int = 28 * MICROS["day"], out: str = "_rn") -> DataFrame:
    """Number the rows of each key from 0 in time order; windows hold one time chunk of a key, or one row per chunk."""
    rows = df.withColumn("_chunk", F.floor(F.unix_micros(ts) / F.lit(chunk_us)))
    w = Window.partitionBy(*keys, "_chunk")
    rows = rows.withColumns({"_in": F.row_number().over(w.orderBy(ts)) - 1, "_of": F.count("*").over(w)})
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.filter("_in = 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_of").over(before), F.lit(0)).alias("_start"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_chunk").eqNullSafe(F.col("_c"))])
    return rows.join(chunks, same).withColumn(out, F.col("_in") + F.col("_start")).select(*df.columns, out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _part(values: Column, start: Column, end: Column) -> Column:
    """Elements from ``start`` (counted from 0) to before ``end``; bounds outside the array are cut to it."""
    low = F.greatest(start, F.lit(0))
    return F.slice(values, low + 1, F.greatest(F.least(end, F.size(values)) - low, F.lit(0)))


def _middle(ranked: Column, count: Column, skipped: Column | int = 0) -> Column:
    """Median of ``count`` values of which ``ranked`` holds, in order, those around the middle; ``skipped`` lie before it."""
    low, high = F.floor((count - 1) / F.lit(2)), F.floor(count / F.lit(2))
    return F.when(count > 0, (F.get(ranked, (low - skipped).cast("int")) + F.get(ranked, (high - skipped).cast("int"))) / 2.0)


def median_before(past: Column, values: Column, shared: Column | None, i: Column, n: int) -> Column:
    """Median of the ``n`` rows before row ``i`` of a block.

    ``past`` are the rows before the block and ``shared`` those of them, in order, that lie in the frame of every row of the
    block.  A frame is the shared rows and fewer than ``BLOCK`` others, so its middle lies among as many shared rows around
    theirs; only those and the others are sorted.
    """
    p = F.size(past)
    if shared is None:
        frame = F.concat(_part(past, p + i - n, p), _part(values, i - n, i))
        return let(F.sort_array(F.array_compact(frame)), lambda s: _middle(s, F.size(s)))
    others = F.array_compact(F.concat(_part(past, p + i - n, p + BLOCK - 1 - n), _part(values, F.lit(0), i)))

    def pick(o: Column) -> Column:
        count = F.size(shared) + F.size(o)
        start = F.greatest(F.floor((count - 1) / F.lit(2)) - F.size(o), F.lit(0)).cast("int")
        near = _part(shared, start, F.floor(count / F.lit(2)).cast("int") + 1)
        return _middle(F.sort_array(F.concat(near, o)), count, start)

    return let(others, pick)


def _weight(beta: float, alpha: float, gap: Column) -> Column:
    """Share that the mean so far keeps when the next value comes after ``gap`` rows."""
    old = F.pow(F.lit(beta), gap)
    return old / (old + alpha)


def _summary(values: Column, alpha: float, beta: float) -> Column:
    """What a block does to a mean: rows before its first value, that value, a line for the values after it, rows after its last."""
    start = F.struct(F.lit(0).alias("lead"), F.lit(None).cast("double").alias("first"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("trail"))

    def step(s: Column, x: Column) -> Column:
        empty, seen = s["first"].isNull(), x.isNotNull()
        keep = _weight(beta, alpha, (s["trail"] + 1).cast("double"))
        return F.struct(
            F.when(empty & ~seen, s["lead"] + 1).otherwise(s["lead"]).alias("lead"), F.coalesce(s["first"], x).alias("first"),
            F.when(empty | ~seen, s["a"]).otherwise(s["a"] * keep).alias("a"), F.when(empty | ~seen, s["b"]).otherwise(s["b"] * keep + (1.0 - keep) * x).alias("b"),
            F.when(seen | empty, 0).otherwise(s["trail"] + 1).alias("trail"))

    return F.aggregate(values, start, step)


def _state(y: Column, gap: Column) -> Column:
    return F.struct(y.alias("y"), gap.alias("gap"))


def _carried(blocks: Column, alpha: float, beta: float) -> Column:
    """State (mean, rows since its last value) before each block of a key and after the last, from the blocks' summaries."""

    def step(states: Column, b: Column) -> Column:
        s = F.element_at(states, -1)
        keep = _weight(beta, alpha, (s["gap"] + b["s"]["lead"] + 1).cast("double"))
        first = F.when(s["y"].isNull(), b["s"]["first"]).otherwise(keep * s["y"] + (1.0 - keep) * b["s"]["first"])
        new = F.when(b["s"]["first"].isNull(), _state(s["y"], s["gap"] + b["rows"])).otherwise(_state(b["s"]["a"] * first + b["s"]["b"], b["s"]["trail"]))
        return F.concat(states, F.array(new))

    return F.aggregate(blocks, F.array(_state(F.lit(None).cast("double"), F.lit(0))), step)


def _means(values: Column, before: Column, alpha: float, beta: float) -> Column:
    """The mean before each row of a block."""
    start = F.struct(_state(before["y"], before["gap"]).alias("s"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"]
        keep = _weight(beta, alpha, (s["gap"] + 1).cast("double"))
        y = F.when(x.isNull(), s["y"]).when(s["y"].isNull(), x).otherwise(keep * s["y"] + (1.0 - keep) * x)
        return F.struct(_state(y, F.when(x.isNull() & s["y"].isNotNull(), s["gap"] + 1).otherwise(0)).alias("s"), F.concat(acc["out"], F.array(s["y"])).alias("out"))

    return F.aggregate(values, start, step)["out"]


def add_history(df: DataFrame, keys: list[str], value: str, medians: list[int], spans: list[int], ts: str = "ts") -> DataFrame:
    """Rolling medians over the ``n`` rows before each row and exponential means of all rows before it.

    Missing values take part in neither: a median is of the present values of its frame, a mean keeps its value and the next
    one weighs as if the gap had decayed.  Without any value before a row both are null.
    """
    reach = -(-max(medians, default=1) // BLOCK)
    rest = [c for c in df.columns if c not in keys]
    rows = number_rows(df, keys, ts).withColumn("_block", F.floor(F.col("_rn") / BLOCK))
    blocks = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_rn", *rest))).alias("_rows"))
    blocks = blocks.withColumn("_v", F.transform("_rows", lambda r: r[value].cast("double")))
    rates = {s: (2.0 / (s + 1.0), 1.0 - 2.0 / (s + 1.0)) for s in spans}
    if spans:
        each = blocks.select(*keys, "_block", F.size("_v").alias("rows"), *[_summary(F.col("_v"), *rates[s]).alias(f"s{s}") for s in spans])
        lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "rows", *[f"s{s}" for s in spans]))).alias("_b"))
        states = lists.select(*keys, F.col("_b._block").alias("_blocks"), *[_carried(F.arrays_zip(F.col(f"_b.s{s}").alias("s"), F.col("_b.rows").alias("rows")), *rates[s]).alias(f"_c{s}") for s in spans])
        states = states.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.posexplode("_blocks").alias("_at", "_bl"), *[f"_c{s}" for s in spans])
        states = states.select("*", *[F.get(f"_c{s}", F.col("_at")).alias(f"_s{s}") for s in spans]).drop("_at", *[f"_c{s}" for s in spans])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block") == F.col("_bl")])
        blocks = blocks.join(states, same).drop("_bl", *[f"_k{i}" for i in range(len(keys))])
    own = F.floor(F.col("_block") / F.lit(GROUP))
    if medians:
        homes = F.array_compact(F.array(own, F.when(F.col("_block") % GROUP >= GROUP - reach, own + 1)))
        near = Window.partitionBy(*keys, "_home").orderBy("_block").rowsBetween(-reach, -1)
        blocks = blocks.withColumn("_home", F.explode(homes)).withColumn("_past", F.flatten(F.collect_list("_v").over(near))).filter(F.col("_home") == own)
        past = F.col("_past")
    fixed = {"past": past} if medians else {}
    fixed |= {f"w{n}": F.sort_array(F.array_compact(_part(past, F.size(past) + BLOCK - 1 - n, F.size(past)))) for n in medians if n > BLOCK}
    fixed |= {f"e{s}": _means(F.col("_v"), F.col(f"_s{s}"), *rates[s]) for s in spans}

    def block_rows(b: Column) -> Column:
        def row(r: Column, i: Column) -> Column:
            found = [median_before(b["past"], b["v"], b[f"w{n}"] if n > BLOCK else None, i, n).alias(f"rmedian_{n}") for n in medians]
            return F.struct(*[r[c].alias(c) for c in rest], *found, *[F.get(b[f"e{s}"], i).alias(f"ema_{s}") for s in spans])

        return F.transform(b["rows"], row)

    names = [*rest, *[f"rmedian_{n}" for n in medians], *[f"ema_{s}" for s in spans]]
    # one struct, bound once: a column of its own would be computed again inside the lambda of every row
    bound = F.struct(F.col("_rows").alias("rows"), F.col("_v").alias("v"), *[c.alias(name) for name, c in fixed.items()])
    out = blocks.select(*keys, F.explode(let(bound, block_rows)).alias("_r"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns], *[F.col(f"_r.{c}").alias(c) for c in names[len(rest):]])
