"""Exact interpolated quantiles per group that never gather a group.

Groups of up to ``SMALL`` rows, by count, are ranked whole from their distinct values and counts (a few megabytes a task). Beyond
that a mergeable sketch brackets each quantile; only the distinct values inside the bracket (a few per mille of a large group)
are ranked, each with its count, so a tie as large as a group is one row; the values below are counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL, MARGIN, ACCURACY = 200_000, 0.002, 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """(keys, n, q0, q1, ...): linear interpolation between the neighbouring values. Null values are left out; groups
    without a value give no row; a null key is a key."""
    data = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    largest = data.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= SMALL:  # a proven bound: every group fits a task
        direct = data.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_x", F.array(*[F.lit(float(q)) for q in qs])).alias("_q"))
        return direct.filter("n > 0").select(*keys, "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(qs))])
    marks = [F.lit(min(1.0, max(0.0, q + s))) for q in qs for s in (-MARGIN, MARGIN)]
    bounds = data.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_x", F.array(*marks), ACCURACY).alias("_b"))
    spans = bounds.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col("_b")[2 * i].alias("lo"), F.col("_b")[2 * i + 1].alias("hi")) for i, q in enumerate(qs)])).alias("s"),
    ).select(*[f"_k{i}" for i in range(len(keys))], "n", "s.i", "s.q", F.when(F.col("n") > SMALL, F.col("s.lo")).alias("lo"), F.when(F.col("n") > SMALL, F.col("s.hi")).alias("hi"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    by = [f"_k{i}" for i in range(len(keys))] + ["n", "i", "q"]
    wide = data.join(spans, same) if keys else data.crossJoin(F.broadcast(spans))  # without keys the bracket is one row per q
    # one row per value inside the bracket and one (null) for all below it
    counted = wide.filter("hi IS NULL OR _x <= hi").groupBy(*by, F.when(F.col("lo").isNull() | (F.col("_x") >= F.col("lo")), F.col("_x")).alias("_x")).agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    both = counted.withColumn("upto", run).filter("_x IS NOT NULL")
    place = (F.col("n") - 1) * F.col("q")
    holds = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)
    low = F.max(F.when(holds(F.floor(place)), F.col("_x")))
    high = F.max(F.when(holds(F.ceil(place)), F.col("_x")))
    each = both.groupBy(*by).agg((low + (high - low) * F.max(place - F.floor(place))).alias("v"))
    return each.groupBy(*by[: len(keys)]).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(len(qs))]).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", *[f"q{i}" for i in range(len(qs))]
    )
