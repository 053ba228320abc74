"""Screens over bids, market concentration, bursts in time, and rank-aggregated scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.anomaly import percentile_rank

TENDER = ("buyer_id", "tender_publications_firstcallfortenderdate", "main_cpv_4")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def tender_screens(bids: DataFrame) -> DataFrame:
    """Per tender: number of bids, moments (sample skewness and kurtosis), the two lowest bids, and the screens cv, diffp, rd,
    spd and range ratio; null where a tender cannot support one. The spread of the losers comes from sums about the lowest
    bid, so no bid is ranked and no tender gathered."""
    price = F.when(F.col("bid_price") > 0, F.col("bid_price"))
    t = bids.select(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("None")) for c in TENDER]).alias("tender"), price.alias("p"))
    moments = t.groupBy("tender").agg(
        F.count("*").alias("bids"), F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"), F.min("p").alias("low"), F.max("p").alias("high"),
        F.skewness("p").alias("g1"), F.kurtosis("p").alias("g2"), F.var_pop("p").alias("v"),
    )
    # the lowest two: equal prices are counted first, so that a tie for the lowest is seen
    prices = t.filter("p IS NOT NULL").groupBy("tender", "p").agg(F.count("*").alias("c"))
    first = prices.groupBy("tender").agg(F.min(F.struct("p", "c")).alias("f"))
    second = prices.join(first, "tender").groupBy("tender").agg(F.min(F.when((F.col("p") > F.col("f.p")) | (F.col("f.c") > 1), F.col("p"))).alias("p2"))
    agg = moments.join(second, "tender", "left")
    n, p1 = F.col("n").cast("double"), F.col("low")
    p2 = F.col("p2")
    # without its lowest member, n values of mean m and variance v have sum n m - p1 and square sum n (v + m^2) - p1^2
    rest_mean = (n * F.col("mean") - p1) / (n - 1)
    rest_square = n * (F.col("v") + F.col("mean") * F.col("mean")) - p1 * p1
    loser = F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), (rest_square - (n - 1) * rest_mean * rest_mean) / (n - 2))))
    skew = F.when((F.col("n") > 2) & (F.col("v") > 0), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((F.col("n") > 3) & (F.col("v") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    gap = p2 - p1
    return agg.select(
        "tender", "bids", "n", "mean", "std", p1.alias("p1"), p2.alias("p2"), skew.alias("skew"), kurt.alias("kurt"), loser.alias("loser_std"), ratio(F.col("std"), F.col("mean")).alias("cv"),
        ratio(gap, p1).alias("diffp"), ratio(gap, F.col("std")).alias("rd"), ratio(gap, loser).alias("spd"), ratio(F.col("high") - p1, F.col("mean")).alias("range_ratio"),
    )


def activity(bids: DataFrame, column: str) -> DataFrame:
    return bids.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("bids"), F.sum(F.col("bid_iswinning").cast("long")).alias("wins"))


def concentration(df: DataFrame, market: Sequence[str], actor: str, amount: str) -> DataFrame:
    """Herfindahl index per market: the sum of squared shares of its actors' positive amounts."""
    each = df.filter(F.col(amount) > 0).groupBy(*market, actor).agg(F.sum(amount).alias("a"))
    return each.groupBy(*market).agg(F.count("*").alias("actors"), (F.sum(F.col("a") * F.col("a")) / (F.sum("a") * F.sum("a"))).alias("hhi"))


def bursts(df: DataFrame, place: str, day: str, alpha: float = 1.0) -> DataFrame:
    """ln((n + alpha) / (mean + alpha)) per place and month; the mean goes over the place's months with records."""
    monthly = df.filter(F.col(place).isNotNull() & F.col(day).isNotNull()).groupBy(place, F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy(place))  # one row per month of a place
    return monthly.select(place, "month", "n", F.ln((F.col("n") + alpha) / (mean + alpha)).alias("burst"))


def rank_aggregate(df: DataFrame, values: Sequence[str], key: str = "record_id") -> DataFrame:
    """The mean percentile of a record over the values it has."""
    out = df.select(key, *values)
    for v in values:
        out = percentile_rank(out, v, f"_p_{v}")
    ranks = F.array_compact(F.array(*[F.col(f"_p_{v}") for v in values]))
    mean = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(ranks), F.lit(0))
    return out.select(key, mean.alias("score"))
