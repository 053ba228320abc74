"""Percentiles of very large numeric columns per group, by distributed multi-select, over raw rows or over summaries.

``summarise`` turns rows into a summary per group and part (a file, a day): logarithmic bins of relative width
``2 * ERROR``, each with its count, least and greatest value. Its size is bounded by the bins, not by the rows; summaries of
any parts are put together by adding the counts of equal bins, in any order (``combine``).

``select`` finds the value of a rank per group among weighted values. Each round, every partition proposes the weighted
median of its values still in the race; the median of those, weighted by what they stand for, becomes the pivot; the values
below, at and above it are counted; ranges that cannot hold the rank are ruled out. That repeats, for all groups and ranks at
once, until the rank falls on a pivot or at most ``FINISH`` rows are left, which are sorted. No more than that is ever
gathered; a round moves one row per partition, group and rank, and one row of counts. ``rounds`` lists the groups and ranks
that went into each round.

The rank of percentile q among n values is ceil(q * n / 100) (nearest rank). Over raw rows the result is exact; over a
summary it lies in the bin of the exact value and thus within the relative error ``ERROR`` of it.

Defined results: null and NaN values are left out, infinities count; groups without a value give no row; a null group is a
group of its own; zero has a bin of its own; ties and repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import BROADCAST_ROWS, materialize

ERROR = 0.001
#: Rows of a group that may be gathered and sorted.
FINISH = 512


def _values(df: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(F.col(group).alias("g"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def summarise(df: DataFrame, group: str, value: str, part: str | None = None, error: float = ERROR) -> DataFrame:
    """(g, part, bin, n, lo, hi): the mergeable summary of each group and part."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), (F.col(part) if part else F.lit(None).cast("string")).alias("part"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    size = F.abs("v")
    step = F.when(size == 0, 0).when(size == float("inf"), 1 << 40).otherwise(F.floor(F.log(size) / F.lit(2 * error)) + (1 << 30))
    bins = (F.signum("v") * step).cast("long")
    return rows.groupBy("g", "part", bins.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def combine(summary: DataFrame) -> DataFrame:
    """Summaries of any parts put together: (g, bin, n, lo, hi)."""
    return summary.groupBy("g", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _at_ranks(sorted_values: Column, ranks: Column) -> Column:
    """Of (v, w) in order, the first value whose running weight reaches each rank."""
    walk = lambda rank: F.aggregate(
        sorted_values,
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v")),
        lambda a, x: F.struct((a["seen"] + x["w"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["w"] >= rank), x["v"]).otherwise(a["v"]).alias("v")),
    )["v"]
    return F.transform(ranks, walk)


def select(values: DataFrame, percents: Sequence[int], finish: int = FINISH, rounds: list | None = None) -> DataFrame:
    """(g, total, percent, v) of weighted values (g, v, w): the value at rank ceil(percent * total / 100) of each group."""
    values = values.select("g", F.col("v").cast("double"), F.col("w").cast("long"))
    percents = [int(p) for p in percents]
    totals = materialize(values.groupBy("g").agg(F.sum("w").alias("total"), F.count("*").alias("rows")), "totals")
    wanted = F.array(*[F.lit(p) for p in percents])
    rank_of = lambda p: F.greatest(F.lit(1).cast("long"), F.ceil((p * F.col("total")).cast("decimal(38,0)") / F.lit(100)).cast("long"))
    large = totals.filter(F.col("rows") > finish)
    n_large = large.count()
    hinted = F.broadcast if n_large * len(percents) <= BROADCAST_ROWS else lambda df: df  # the sides below have at most so many rows
    hot = hinted(large.select(F.col("g").alias("h")))
    inside = F.col("g").eqNullSafe(F.col("h"))
    # small groups: all ranks from one gathering
    few = values.join(hot, inside, "left_anti").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("xs"), F.sum("w").alias("total"))
    ranked = few.select("g", "total", F.arrays_zip(wanted.alias("percent"), _at_ranks(F.col("xs"), F.transform(wanted, rank_of)).alias("v")).alias("z"))
    found = ranked.select("g", "total", F.explode("z").alias("z")).select("g", "total", "z.percent", "z.v")
    if not n_large:
        return found
    values = materialize(values.join(hot, inside, "left_semi"), "large")
    state = large.select("g", "total", F.explode(wanted).alias("percent"), F.lit(None).cast("double").alias("above"), F.lit(None).cast("double").alias("below"))
    state = state.withColumn("rank", rank_of(F.col("percent")))
    keys = ["g", "percent", "total", "above", "below", "rank"]
    while True:
        if rounds is not None:
            rounds.append([(r["g"], r["percent"]) for r in state.select("g", "percent").limit(10_000).collect()])
        in_race = (F.col("s.above").isNull() | (F.col("x.v") > F.col("s.above"))) & (F.col("s.below").isNull() | (F.col("x.v") < F.col("s.below")))
        race = values.alias("x").join(hinted(state).alias("s"), F.col("x.g").eqNullSafe(F.col("s.g")) & in_race).select("s.g", "s.percent", "s.total", "s.above", "s.below", "s.rank", "x.v", "x.w")
        local = race.groupBy(*keys, F.spark_partition_id().alias("p")).agg(F.expr("percentile(v, 0.5, w)").alias("m"), F.sum("w").alias("w"))
        # the middle of the proposals may lie between two values: then it rules out ranges all the same, and no value is at it
        held = hinted(local.groupBy(keys).agg(F.expr("percentile(m, 0.5, w)").alias("pivot"))).alias("f")
        here = F.col("x.g").eqNullSafe(F.col("f.g")) & (F.col("f.above").isNull() | (F.col("x.v") > F.col("f.above"))) & (F.col("f.below").isNull() | (F.col("x.v") < F.col("f.below")))
        side = lambda test, c: F.coalesce(F.sum(F.when(test, c)), F.lit(0))
        under, over, one = F.col("v") < F.col("pivot"), F.col("v") > F.col("pivot"), F.lit(1)
        three = values.alias("x").join(held, here).select(*[f"f.{k}" for k in keys], "f.pivot", "x.v", "x.w").groupBy(*keys, "pivot").agg(
            side(under, F.col("w")).alias("under"), side(F.col("v") == F.col("pivot"), F.col("w")).alias("at"), side(under, one).alias("rows_under"), side(over, one).alias("rows_over")
        )
        three = materialize(three, "counts")
        found = found.unionByName(three.filter("rank > under AND rank <= under + at").select("g", "total", "percent", F.col("pivot").alias("v")))
        low, high = F.col("rank") <= F.col("under"), F.col("rank") > F.col("under") + F.col("at")
        state = three.filter(low | high).select(
            "g", "total", "percent", F.when(high, F.col("pivot")).otherwise(F.col("above")).alias("above"), F.when(low, F.col("pivot")).otherwise(F.col("below")).alias("below"),
            F.when(high, F.col("rank") - F.col("under") - F.col("at")).otherwise(F.col("rank")).alias("rank"), F.when(high, F.col("rows_over")).otherwise(F.col("rows_under")).alias("rows"),
        )
        # few rows left: they are sorted, one rank's at most ``finish`` at a time
        last = state.filter(F.col("rows") <= finish).drop("rows")
        rest = values.alias("x").join(hinted(last).alias("s"), F.col("x.g").eqNullSafe(F.col("s.g")) & in_race).select("s.g", "s.percent", "s.total", "s.rank", "x.v", "x.w")
        sums = rest.groupBy("g", "percent", "total", "rank").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("xs"))
        found = found.unionByName(sums.select("g", "total", "percent", _at_ranks(F.col("xs"), F.array("rank"))[0].alias("v")))
        state = state.filter(F.col("rows") > finish).drop("rows")
        if state.isEmpty():
            return found


def percentiles(df: DataFrame, group: str | Sequence[str], value: str, percents: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """Exact (group, n, p..) over raw rows; several group columns make one group each combination."""
    if isinstance(group, str):
        return _wide(select(_values(df, group, value).withColumn("w", F.lit(1)), percents), group, percents)
    rows = df.select(F.struct(*group).alias("g"), F.col(value).alias("v"))
    wide = _wide(select(_values(rows, "g", "v").withColumn("w", F.lit(1)), percents), "g", percents)
    return wide.select(*[F.col("g")[c].alias(c) for c in group], *[c for c in wide.columns if c != "g"])


def percentiles_of_summary(summary: DataFrame, group: str, percents: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """(group, n, p..) from summaries, each within the relative error of the bins."""
    bins = materialize(combine(summary), "combined")
    middle = F.when(F.col("lo") * F.col("hi") > 0, F.signum("lo") * F.sqrt(F.abs("lo")) * F.sqrt(F.abs("hi"))).otherwise(F.col("lo"))
    return _wide(select(bins.select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(middle).alias("v"), F.col("n").alias("w")), percents), group, percents)


def _wide(found: DataFrame, group: str, percents: Sequence[int]) -> DataFrame:
    cells = [F.max(F.when(F.col("percent") == p, F.col("v"))).alias(f"p{p}") for p in percents]
    return found.groupBy(F.col("g").alias(group)).agg(F.max("total").alias("n"), *cells)
