"""How far a record's own evidence can be trusted: completeness, date coherence, financial plausibility, and their mean."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.cleaning import DATES, FIELDS, LARGEST, SCHEME_START, cells

# The weight of each field, the credit of a cell by reason, and the fields that carry the evidence.
CRITICALITY = {
    "work_id": 0.05, "work_name": 0.05, "district": 0.05, "state": 0.05, "sanction_amount": 0.20, "amount_spent": 0.15,
    "date_proposal": 0.20, "date_approval": 0.20, "date_completion": 0.15, "implementing_agency": 0.05, "vendor_name": 0.05, "status": 0.05,
}
CREDIT = {"present": 1.0, "missing": 0.2, "placeholder": 0.08, "unparseable": 0.0}
CRITICAL = ("date_proposal", "date_approval", "date_completion", "sanction_amount", "amount_spent")
MIN_COVERAGE = 0.02
DEFICIT_RATE, ORDER_RATE = 0.35, 0.01
OVER_RATE, OVER_FROM, UNDER_RATE, UNDER_FROM = 2.0, 1.05, 6.0, 0.2
WEIGHTS = (0.4, 0.4, 0.2)


def field_entropy(cleaned: DataFrame) -> DataFrame:
    """Per field: coverage, entropy of being null, distinct values, and entropy of the values in [0, 1]."""
    present = cells(cleaned).filter("reason = 'present'").groupBy("field", "value").agg(F.count("*").alias("c"))
    # with n values, -sum(p log p) = log n - sum(c log c) / n: one more aggregation, no join back
    stats = present.groupBy("field").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    total = cleaned.agg(F.count("*").alias("total"), *[F.lit(f).alias(f"_{f}") for f in FIELDS])
    fields = total.select("total", F.explode(F.array(*[F.col(f"_{f}") for f in FIELDS])).alias("field"))
    out = fields.join(stats, "field", "left").select("field", F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), "total"), F.lit(0.0)).alias("coverage"), F.coalesce("k", F.lit(0)).alias("n_distinct"), "n", "s")
    p = F.col("coverage")
    null = F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    value = F.when(F.col("n_distinct") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log2("n") - F.col("s") / F.col("n")) / F.log2("n_distinct")))).otherwise(0.0)
    return out.select("field", "coverage", "n_distinct", null.alias("h_null"), value.alias("h_value"))


def field_weights(cleaned: DataFrame) -> dict[str, float]:
    """Criticality times entropy; rare fields weigh nothing; if nothing varies all weigh 1. Twelve numbers for the driver."""
    rows = {r["field"]: r for r in field_entropy(cleaned).collect()}
    weights = {f: CRITICALITY[f] * rows[f]["h_value"] if rows[f]["coverage"] >= MIN_COVERAGE else 0.0 for f in FIELDS}
    return weights if sum(weights.values()) > 0 else dict.fromkeys(FIELDS, 1.0)


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def completeness(weights: dict[str, float]) -> dict[str, Column]:
    table = F.create_map(*[x for k, v in CREDIT.items() for x in (F.lit(k), F.lit(v))])
    credit = {f: table[F.col(f"null_reason__{f}")] for f in FIELDS}
    deficit = _sum([1 - credit[f] for f in CRITICAL])
    valid = _sum([(F.col(f"null_reason__{f}") == "present").cast("int") for f in FIELDS])
    mean = _sum([credit[f] * F.lit(weights[f]) for f in FIELDS]) / F.lit(sum(weights.values()))
    score = F.when(valid > 0, mean * F.exp(-DEFICIT_RATE * F.greatest(F.lit(0.0), deficit - 1))).otherwise(0.0)
    return {"completeness": score, "critical_deficit": deficit, "n_valid_fields": valid.cast("long")}


def temporal() -> dict[str, Column]:
    inverted = [F.when(F.col(a) > F.col(b), F.exp(-ORDER_RATE * F.datediff(a, b))).otherwise(1.0) for a, b in zip(DATES, DATES[1:])]
    pairs = _sum([(F.col(a).isNotNull() & F.col(b).isNotNull()).cast("int") for a, b in zip(DATES, DATES[1:])])
    fail = reduce(lambda x, y: x | y, [(F.col(f"null_reason__{d}") == "unparseable") | F.coalesce(F.col(d) < F.lit(SCHEME_START), F.lit(False)) for d in DATES])
    return {"temporal": F.when(fail, 0.0).otherwise(inverted[0] * inverted[1]), "temporal_pairs": pairs.cast("long"), "temporal_hard_fail": fail, "temporal_defined": (pairs > 0) | fail}


def reconciliation() -> dict[str, Column]:
    s, x = F.col("sanction_amount"), F.col("amount_spent")
    big = lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False))
    huge = lambda v: F.coalesce(F.abs(v) > LARGEST, F.lit(False))
    state = F.when(F.col("status").isin("proposed", "approved", "pending"), "pre_completion").when(F.col("status").isin("completed", "closed"), "terminal").otherwise("unknown")
    branch = (
        F.when(s.isNull() & x.isNull(), "both_null").when(big(s) | big(x), "non_finite").when(huge(s) | huge(x), "implausible_magnitude")
        .when(s.isNull() | x.isNull(), "one_null").when(s <= 0, "non_positive_sanction").otherwise("both_present")
    )
    scale = F.when(state == "pre_completion", 0.0).when(state == "terminal", 1.0).otherwise(0.5)
    r = x / (s + 1e-6)
    score = F.exp(-OVER_RATE * F.greatest(F.lit(0.0), r - OVER_FROM)) * F.exp(-UNDER_RATE * scale * F.greatest(F.lit(0.0), UNDER_FROM - r))
    fixed = F.when(branch == "both_null", 1.0).when(branch == "one_null", 0.7).when(branch.isin("non_finite", "implausible_magnitude"), 0.0).when(branch == "non_positive_sanction", 0.25)
    return {
        "reconciliation": F.when(branch == "both_present", score).otherwise(fixed), "reconciliation_branch": branch, "reconciliation_defined": branch != "both_null",
        "lifecycle_state": state, "spend_ratio": F.when(branch == "both_present", r),
    }


def geometric_mean(parts: list[tuple[Column, Column, float]]) -> Column:
    """exp of the weighted mean of logs over the defined parts (value, defined, weight); 0 if one of them is 0 or none is defined."""
    zero = reduce(lambda a, b: a | b, [d & (v <= 0) for v, d, _ in parts])
    weight = _sum([F.when(d, w).otherwise(0.0) for _, d, w in parts])
    logs = _sum([F.when(d & (v > 0), w * F.ln(v)).otherwise(0.0) for v, d, w in parts])
    return F.when(zero | (weight <= 0), 0.0).otherwise(F.exp(logs / weight))


def score(cleaned: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The cleaned records with all components and ``confidence``."""
    weights = weights or field_weights(cleaned)
    out = cleaned.withColumns(completeness(weights) | temporal() | reconciliation())
    c = F.col
    mean = geometric_mean([(c("completeness"), F.lit(True), WEIGHTS[0]), (c("temporal"), c("temporal_defined"), WEIGHTS[1]), (c("reconciliation"), c("reconciliation_defined"), WEIGHTS[2])])
    return out.withColumn("confidence", mean)


def verdict(confidence: Column) -> Column:
    return F.when(confidence <= 0, "none").when(confidence < 0.2, "low").when(confidence <= 0.8, "moderate").otherwise("high")


def report(scored: DataFrame) -> DataFrame:
    """Records and mean confidence by verdict."""
    return scored.groupBy(verdict(F.col("confidence")).alias("verdict")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def histogram(scored: DataFrame, bins: int = 10) -> DataFrame:
    return scored.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
