"""Peers of a work: kind of work by frequent normal text, cost strata, cells, robust norms, and deviations from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import LOCALITY_DELIMITERS, work_text
from tallymark.operators.quantile import exact_quantiles
from tallymark.runtime import materialize, small_side

# What else begins a location in this register, and the actions that do not change the kind of work.
PLACES = (*LOCALITY_DELIMITERS, " for ", " between ", " from ", " beside ", " serving ", " along ")
ACTIONS = ("renewal", "restoration", "widening", "laying", "completion", "maintenance", "rebuilding", "relaying", "erection", "extn", "constr")
MIN_CLUSTER, MIN_CELL, MIN_NORM, STRATA = 30, 15, 8, 5
MAD_SCALE, HIGH, EXTREME, GATE = 1.4826, 5.0, 20.0, 0.5


def with_text(df: DataFrame) -> DataFrame:
    """``_text``: the normal text of the work's name."""
    return df.withColumn("_text", work_text(F.col("work_name"), delimiters=PLACES, extra=ACTIONS))


def with_kind(scored: DataFrame, min_records: int = MIN_CLUSTER) -> DataFrame:
    """``kind``: the normal text of the work's name if enough records share it, else null (noise). A deterministic stand-in
    for density clustering of the distinct texts; it needs one aggregation and no text ever meets another."""
    texts = scored if "_text" in scored.columns else with_text(scored)
    common = texts.filter("_text != ''").groupBy("_text").agg(F.count("*").alias("_c")).filter(F.col("_c") >= min_records).select("_text", F.col("_text").alias("kind"))
    return texts.join(small_side(common), "_text", "left").drop("_text")


def reference(df: DataFrame) -> Column:
    """Records whose evidence may shape a norm; an absent amount does not exclude."""
    fine = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0.0))) <= 1e15
    return (F.coalesce("confidence", F.lit(0.0)) >= GATE) & ~F.col("reconciliation_branch").isin("non_finite", "implausible_magnitude") & fine("sanction_amount") & fine("amount_spent")


def with_stratum(df: DataFrame, strata: int = STRATA) -> tuple[DataFrame, list[float]]:
    """``log_cost`` and ``stratum`` (number of edges at or below it, -1 without an amount); edges: quantiles of the gated logs."""
    logged = df.withColumn("log_cost", F.when((F.col("sanction_amount") > 0) & (F.col("sanction_amount") < float("inf")), F.log1p("sanction_amount")))
    qs = [i / strata for i in range(1, strata)]
    row = exact_quantiles(logged.filter(reference(df)), [], "log_cost", qs).collect()
    edges = sorted({row[0][f"q{i}"] for i in range(len(qs))}) if row else []
    count = sum((F.col("log_cost") >= F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    return logged.withColumn("stratum", F.when(F.col("log_cost").isNull(), -1).otherwise(count)), edges


def with_cells(df: DataFrame) -> DataFrame:
    """``cell_size`` and ``cell_stable``."""
    sizes = df.filter("kind IS NOT NULL").groupBy("kind", "stratum").agg(F.count("*").alias("cell_size"))
    out = df.join(small_side(sizes), ["kind", "stratum"], "left")
    return out.withColumn("cell_stable", F.coalesce((F.col("cell_size") >= MIN_CELL) & (F.col("stratum") >= 0), F.lit(False)))


def with_features(df: DataFrame) -> DataFrame:
    days = F.datediff("date_completion", "date_proposal")
    return df.withColumn("duration_days", F.when((days >= 0) & ~F.col("temporal_hard_fail"), days.cast("double"))).withColumn("is_reference", reference(df))


def norms(df: DataFrame, keys: list[str], features: list[str], where: Column) -> DataFrame:
    """(keys, feature, n, median, mad): scaled median absolute deviation; only with enough values; a zero one is null."""
    long = df.filter(where).select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("c")).select(*keys, "c.feature", "c.x").filter("x IS NOT NULL")
    by = [*keys, "feature"]
    middle = exact_quantiles(long, by, "x", [0.5]).filter(F.col("n") >= MIN_NORM).withColumnRenamed("q0", "median")
    middle = small_side(materialize(middle, "medians"))
    away = long.join(middle, by).withColumn("d", F.abs(F.col("x") - F.col("median")))
    spread = exact_quantiles(away, by, "d", [0.5]).select(*by, (F.col("q0") * MAD_SCALE).alias("mad"))
    return middle.join(spread, by).select(*by, "n", "median", F.nullif("mad", F.lit(0.0)).alias("mad"))


def structure(scored: DataFrame, min_records: int = MIN_CLUSTER) -> DataFrame:
    """The scored records with kind, stratum, cell and features, written once: the norms look at them several times."""
    texts = scored if "_text" in scored.columns else materialize(with_text(scored), "texts")
    return materialize(with_features(with_cells(with_stratum(with_kind(texts, min_records))[0])), "structure")


def deviations(structured: DataFrame) -> DataFrame:
    """Robust z of cost in cell and kind, of spend ratio and duration in cell, each with the reason of its absence."""
    known = F.col("kind").isNotNull()
    cell = norms(structured, ["kind", "stratum"], ["sanction_amount", "spend_ratio", "duration_days"], F.col("is_reference") & F.col("cell_stable"))
    kind = norms(structured, ["kind"], ["sanction_amount"], F.col("is_reference") & known)
    pick = lambda f: [F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}") for c in ("median", "mad")]
    cells = small_side(materialize(cell.groupBy("kind", "stratum").agg(*[x for f in ("sanction_amount", "spend_ratio", "duration_days") for x in pick(f)]), "cell-norms"))
    kinds = small_side(materialize(kind.groupBy("kind").agg(F.max("median").alias("median_kind"), F.max("mad").alias("mad_kind")), "kind-norms"))
    out = structured.join(cells, ["kind", "stratum"], "left").join(kinds, "kind", "left")
    specs = {
        "z_cell_cost": ("sanction_amount", "median_sanction_amount", "mad_sanction_amount", True), "z_kind_cost": ("sanction_amount", "median_kind", "mad_kind", False),
        "z_spend": ("spend_ratio", "median_spend_ratio", "mad_spend_ratio", True), "z_duration": ("duration_days", "median_duration_days", "mad_duration_days", True),
    }
    columns = {}
    for name, (x, median, mad, in_cell) in specs.items():
        reason = F.when(F.col(x).isNull() | (F.abs(F.col(x)) == float("inf")), "feature_missing").when(~known, "cluster_noise")
        if in_cell:
            reason = reason.when(~F.col("cell_stable"), "cell_unstable")
        reason = reason.when(F.col(median).isNull(), "no_peer_norm").when(F.col(mad).isNull(), "zero_dispersion").otherwise("defined")
        columns[f"{name}_reason"] = reason
        columns[name] = F.when(reason == "defined", (F.col(x) - F.col(median)) / F.col(mad))
    return out.withColumns(columns).withColumn("has_norm", known & (F.col("median_kind").isNotNull() | F.col("median_sanction_amount").isNotNull()))


def bucket(z: Column) -> Column:
    return F.when(z.isNull(), "undefined").when(F.abs(z) >= EXTREME, "extreme").when(F.abs(z) >= HIGH, "high").otherwise("normal")


def total_variation(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Half the sum of differences between the shares of a column's values in two tables."""
    share = lambda d, n: d.groupBy(column).agg(F.count("*").alias(n))
    both = share(left, "a").join(share(right, "b"), column, "full")
    sums = both.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    p, q = F.coalesce("a", F.lit(0)) / F.col("sa"), F.coalesce("b", F.lit(0)) / F.col("sb")
    return both.crossJoin(F.broadcast(sums)).agg((F.sum(F.abs(p - q)) / 2).alias("drift"))  # sums is one row
