"""Signals, kinds of anomaly, severity, and a risk gated by confidence, as column expressions over deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAG, GATE, FULL = 3.0, 0.5, 5.0
SEVERITY_WEIGHTS = {"z_cost": 0.45, "z_spend": 0.30, "z_duration": 0.15}


def with_signals(df: DataFrame) -> DataFrame:
    out = df.withColumn("z_cost", F.coalesce("z_cell_cost", "z_kind_cost"))
    return out.withColumn("valid_signals", sum(F.col(c).isNotNull().cast("int") for c in SEVERITY_WEIGHTS))


def with_types(df: DataFrame) -> DataFrame:
    z = F.col
    trusted = F.coalesce("confidence", F.lit(0.0)) >= GATE
    types = [
        F.when(F.abs(z("z_cost")) >= FLAG, "cost_outlier"), F.when(z("z_spend") >= FLAG, "overspend"),
        F.when((z("z_spend") <= -FLAG) & (z("lifecycle_state") == "terminal"), "underspend"), F.when(F.abs(z("z_duration")) >= FLAG, "duration_outlier"),
        F.when(~trusted, "low_confidence"), F.when((z("valid_signals") == 0) | ~z("cell_stable") | ~z("has_norm"), "insufficient_context"),
    ]
    return df.withColumn("anomaly_types", F.array_compact(F.array(*types)))


def with_severity(df: DataFrame) -> DataFrame:
    part = lambda c, w: F.coalesce(w * F.least(F.abs(F.col(c)) / FULL, F.lit(1.0)), F.lit(0.0))
    have = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    items = SEVERITY_WEIGHTS.items()
    return df.withColumn("severity", F.try_divide(sum(part(c, w) for c, w in items), F.nullif(sum(have(c, w) for c, w in items), F.lit(0.0))))


def risk_parts(df: DataFrame) -> dict[str, Column]:
    peak = F.greatest(*[F.abs(F.col(c)) for c in SEVERITY_WEIGHTS])
    extra = 0.2 * F.least(F.size(F.array_except("anomaly_types", F.array(F.lit("low_confidence"), F.lit("insufficient_context")))) / 3, F.lit(1.0))
    extra = extra + 0.3 * F.when(peak >= 20, 1.0).when(peak >= 5, 0.5).otherwise(0.0)
    least = F.least("confidence", "completeness", F.when(F.col("temporal_defined"), F.col("temporal")), F.when(F.col("reconciliation_defined"), F.col("reconciliation")))
    quality = F.when(F.col("temporal_hard_fail"), F.least(least, F.lit(0.05))).otherwise(least) * F.when(F.col("confidence") < GATE, 0.25).otherwise(1.0)
    doubt = F.when(F.col("severity").isNull(), 1.0).otherwise(0.0) + F.when(~F.col("has_norm"), 0.6).otherwise(0.0) + F.when(~F.col("cell_stable"), 0.25).otherwise(0.0) + 0.3 * (1 - F.col("valid_signals") / 3)
    return {"strength": F.col("severity") + (1 - F.col("severity")) * extra, "quality": quality, "uncertainty": F.least(F.lit(1.0), doubt)}


def with_risk(df: DataFrame) -> DataFrame:
    """``risk`` = strength x quality x (1 - uncertainty), null with a reason where it cannot be had."""
    out = df.withColumns(risk_parts(df))
    reason = F.when(F.coalesce("confidence", F.lit(0.0)) < GATE, "confidence_below_gate").when(F.col("severity").isNull(), "severity_undefined").when(~F.col("has_norm"), "no_peer_norm").otherwise("ok")
    return out.withColumn("risk_reason", reason).withColumn("risk", F.when(F.col("risk_reason") == "ok", F.col("strength") * F.col("quality") * (1 - F.col("uncertainty"))))


def percentile_rank(df: DataFrame, value: str, out: str = "percentile") -> DataFrame:
    """Average rank over the rows with a value, in percent. Ranks come from counts per distinct value, so the running sum
    goes over distinct values and the rows themselves are never put in one order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    return df.join(_average_ranks(counts, value), value, "left").withColumn(out, F.col("_rank") * 100 / F.col("_n")).drop("_rank", "_n")


def _average_ranks(counts: DataFrame, value: str, slices: int = 64) -> DataFrame:
    """(value, _rank, _n) from (value, _c): running sums within ranges of the value, plus the sums of the ranges before."""
    marks = counts.agg(F.percentile_approx(value, F.array(*[F.lit(i / slices) for i in range(1, slices)]), 1000).alias("_m"))
    sliced = counts.crossJoin(F.broadcast(marks)).withColumn("_s", F.size(F.filter("_m", lambda m: m < F.col(value)))).drop("_m")  # marks is one row
    heads = sliced.groupBy("_s").agg(F.sum("_c").alias("_t"))
    before = heads.select("_s", F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(F.lit(0))).alias("_n"))
    run = F.sum("_c").over(Window.partitionBy("_s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return sliced.withColumn("_run", run).join(F.broadcast(before), "_s").select(value, (F.col("_before") + F.col("_run") - (F.col("_c") - 1) / 2).alias("_rank"), "_n")  # at most ``slices`` rows


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks: (positives, negatives, auc)."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    by = known.groupBy(score).agg(F.count("*").alias("_c"), F.sum(F.col(label).cast("long")).alias("_p"))
    ranked = by.join(_average_ranks(by.select(score, "_c"), score), score)
    sums = ranked.agg(F.sum(F.col("_p") * F.col("_rank")).alias("r"), F.sum("_p").alias("positives"), (F.sum("_c") - F.sum("_p")).alias("negatives"))
    return sums.select("positives", "negatives", F.try_divide(F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2, F.col("positives") * F.col("negatives")).alias("auc"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of the rows with both values."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    a = _average_ranks(known.groupBy("x").agg(F.count("*").alias("_c")), "x").select("x", F.col("_rank").alias("rx"))
    b = _average_ranks(known.groupBy("y").agg(F.count("*").alias("_c")), "y").select("y", F.col("_rank").alias("ry"))
    return known.join(a, "x").join(b, "y").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))
