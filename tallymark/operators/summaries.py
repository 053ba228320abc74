"""Descriptions, explanations and summaries of the stages, each a few aggregations over columns that are there already."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallymark.functions.dates import parse_squeezed
from tallymark.functions.text import number, squeeze
from tallymark.operators.anomaly import _average_ranks, percentile_rank
from tallymark.operators.cleaning import AMOUNTS, DATES, FIELDS, cells
from tallymark.operators.confidence import WEIGHTS
from tallymark.operators.quantile import exact_quantiles
from tallymark.runtime import materialize

# Names and percentile floors of the bands of a risk, and its levels with their limits.
BAND_FLOORS = (("TOP_1_PERCENT", 99.0), ("TOP_5_PERCENT", 95.0), ("HIGH", 75.0), ("MEDIUM", 25.0), ("LOW", 0.0))
LEVELS = (("high_risk", 0.5), ("moderate_risk", 0.2))
COMPONENTS = ("completeness", "temporal", "reconciliation")


def head(df: DataFrame, n: int, columns: Sequence[str] = (), key: str = "record_id") -> DataFrame:
    """The first n records by key, with the columns asked for."""
    return (df.select(key, *columns) if columns else df).orderBy(key).limit(n)


def of_class(df: DataFrame, column: str, value: str, vocabulary: Sequence[str]) -> DataFrame:
    """The records of one class; a class that is not in the vocabulary is an error, not an empty result."""
    if value not in vocabulary:
        raise ValueError(f"{value!r} is none of {sorted(vocabulary)}")
    return df.filter(F.col(column) == value)


def records(df: DataFrame) -> Iterator[Row]:
    """The rows one after the other; the driver holds one partition at a time."""
    return df.toLocalIterator(prefetchPartitions=False)


def describe_fields(cleaned: DataFrame) -> DataFrame:
    """Per field: cells present and null, distinct values, the commonest value (of equals the least) and how often it stands."""
    counted = cells(cleaned).groupBy("field", F.when(F.col("reason") == "present", F.col("value")).alias("value")).agg(F.count("*").alias("c"))
    have = F.col("value").isNotNull()
    top = counted.groupBy("field").agg(F.max(F.when(have, F.col("c"))).alias("most"))
    out = counted.join(F.broadcast(top), "field")  # a row per field
    return out.groupBy("field").agg(
        F.coalesce(F.sum(F.when(have, F.col("c"))), F.lit(0)).alias("present"), F.coalesce(F.sum(F.when(~have, F.col("c"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"),
        F.min(F.when(have & (F.col("c") == F.col("most")), F.col("value"))).alias("top"), F.max("most").alias("top_freq"),
    )


def date_ranges(cleaned: DataFrame) -> DataFrame:
    """Per date field: how many, the first, the last, and the median day."""
    long = cleaned.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.unix_date(f).alias("x")) for f in DATES])).alias("c")).select("c.*").filter("x IS NOT NULL")
    base = long.groupBy("field").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    day = lambda c: F.date_from_unix_date(c.cast("int")).cast("string")
    return base.join(exact_quantiles(long, ["field"], "x", [0.5]), "field").select("field", "n", day(F.col("lo")).alias("first"), day(F.col("hi")).alias("last"), F.col("q0").alias("median_day"))


def corpus_summary(cleaned: DataFrame) -> DataFrame:
    """(metric, value): records, totals and means of amounts, records by status, and the share of names that are repeated."""
    finite = lambda f: F.when(F.abs(f) < float("inf"), F.col(f))
    one = cleaned.agg(F.count("*").cast("double").alias("records"), *[x for f in AMOUNTS for x in (F.sum(finite(f)).alias(f"total_{f}"), F.avg(finite(f)).alias(f"mean_{f}"))])
    names = cleaned.filter("work_name IS NOT NULL").groupBy("work_name").agg(F.count("*").alias("c")).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("d")
    ).select(F.lit("repeated_names_pct").alias("metric"), F.coalesce(F.try_divide(F.col("d") * 100.0, F.col("n")), F.lit(0.0)).alias("value"))
    metrics = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])).alias("m")).select("m.*")
    status = cleaned.groupBy(F.concat(F.lit("status_"), F.coalesce("status", F.lit("none"))).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return metrics.unionByName(names).unionByName(status)


def metric_summary(scored: DataFrame, metrics: Sequence[str] = ("confidence", *COMPONENTS)) -> DataFrame:
    """Per metric: count, mean, median, deviation of the population, extremes, 5th and 95th percentile, and the shares below
    0.2, above 0.8 and at 0, in percent."""
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("c")).select("c.*").filter("x IS NOT NULL")
    pct = lambda test: F.count_if(test) * 100.0 / F.count("*")
    x = F.col("x")
    base = long.groupBy("metric").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), pct(x < 0.2).alias("low_pct"), pct(x > 0.8).alias("high_pct"), pct(x == 0).alias("zero_pct"))
    return base.join(exact_quantiles(long, ["metric"], "x", [0.05, 0.5, 0.95]).withColumnsRenamed({"q0": "p05", "q1": "median", "q2": "p95"}), "metric")


def explain_confidence(scored: DataFrame) -> DataFrame:
    """Per record: what each component takes from the confidence, in nats (its weight among the defined ones times -ln of its
    score; null if undefined or refused), its share of all that is taken, and the component that decides: the first refused
    one, else the one that takes most."""
    defined = {"completeness": F.lit(True), "temporal": F.col("temporal_defined"), "reconciliation": F.col("reconciliation_defined")}
    live = reduce(lambda a, b: a + b, [F.when(defined[c], w).otherwise(0.0) for c, w in zip(COMPONENTS, WEIGHTS)])
    nats = {c: F.when(defined[c] & (F.col(c) > 0), -F.ln(c) * w / live) for c, w in zip(COMPONENTS, WEIGHTS)}
    refused = {c: defined[c] & (F.col(c) <= 0) for c in COMPONENTS}
    out = scored.withColumns({f"nats_{c}": nats[c] for c in COMPONENTS})
    total = reduce(lambda a, b: a + b, [F.coalesce(f"nats_{c}", F.lit(0.0)) for c in COMPONENTS])
    taken = {c: F.round(f"nats_{c}", 9) for c in COMPONENTS}  # of equals the first
    most = F.greatest(*taken.values())
    driver = F.coalesce(*[F.when(refused[c], c) for c in COMPONENTS], *[F.when(taken[c] == most, c) for c in COMPONENTS])
    shares = {f"share_{c}": F.when(F.col(f"nats_{c}").isNotNull(), F.when(total > 0, F.col(f"nats_{c}") / total).otherwise(0.0)) for c in COMPONENTS}
    return out.withColumns({**shares, "primary_driver": driver})


def severity_reason(risky: DataFrame) -> Column:
    """Why a severity is there or not: ok, cluster_noise, insufficient_features, no_peer_norm, no_valid_deviation."""
    reasons = [F.col(f"{z}_reason") for z in ("z_cell_cost", "z_kind_cost", "z_spend", "z_duration")]
    missing = reduce(lambda a, b: a & b, [r.isin("feature_missing", "defined") for r in reasons]) & reduce(lambda a, b: a | b, [r != "defined" for r in reasons])
    no_norm = reduce(lambda a, b: a | b, [r == "no_peer_norm" for r in reasons])
    return F.when(F.col("severity").isNotNull(), "ok").when(~F.col("has_norm"), "cluster_noise").when(missing, "insufficient_features").when(no_norm, "no_peer_norm").otherwise("no_valid_deviation")


def risk_level(risk: Column) -> Column:
    level = F.when(risk.isNull(), "insufficient_data")
    for name, limit in LEVELS:
        level = level.when(risk >= limit, name)
    return level.otherwise("low_risk")


def risk_bands(risky: DataFrame) -> DataFrame:
    """``percentile`` among the records with a risk, and its ``band``; both null without one."""
    ranked = percentile_rank(risky, "risk")
    band = F.when(F.col("percentile").isNull(), F.lit(None).cast("string"))
    for name, floor in BAND_FLOORS:
        band = band.when(F.col("percentile") >= floor, name)
    return ranked.withColumn("band", band)


def type_rates(risky: DataFrame) -> DataFrame:
    """Per kind of anomaly: records, share of all in percent, mean severity and median risk."""
    n = risky.agg(F.count("*").alias("all"))
    each = risky.select(F.explode("anomaly_types").alias("anomaly"), "severity", "risk")
    base = each.groupBy("anomaly").agg(F.count("*").alias("records"), F.avg("severity").alias("mean_severity")).crossJoin(F.broadcast(n))  # n is one row
    risks = exact_quantiles(each.filter("risk IS NOT NULL"), ["anomaly"], "risk", [0.5, 0.95]).select("anomaly", F.col("q0").alias("median_risk"), F.col("q1").alias("p95_risk"))
    return base.join(risks, "anomaly", "left").select("anomaly", "records", (F.col("records") * 100.0 / F.col("all")).alias("pct"), "mean_severity", "median_risk", "p95_risk")


def contributions(risky: DataFrame) -> DataFrame:
    """The share of the variance of ln(risk) that each factor carries: cov(ln x, ln risk) / var(ln risk) over positive risks."""
    factors = {"strength": F.col("strength"), "quality": F.col("quality"), "certainty": 1 - F.col("uncertainty")}
    known = risky.filter("risk > 0").select(F.ln("risk").alias("r"), *[F.ln(c).alias(n) for n, c in factors.items()])
    one = known.agg(*[F.try_divide(F.covar_pop(n, "r"), F.var_pop("r")).alias(n) for n in factors])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("share")) for n in factors])).alias("f")).select("f.*")


def cell_sizes(structured: DataFrame) -> DataFrame:
    """Peer cells: how many there are and are stable, records in stable ones, and quantiles of their sizes."""
    sizes = structured.filter("kind IS NOT NULL").groupBy("kind", "stratum").agg(F.count("*").alias("size"), F.max("cell_stable").alias("stable"))
    base = sizes.agg(F.count("*").alias("cells"), F.count_if("stable").alias("stable_cells"), F.coalesce(F.sum(F.when(F.col("stable"), F.col("size"))), F.lit(0)).alias("in_stable"))
    q = exact_quantiles(sizes, [], "size", [0.5, 0.9, 0.95, 0.99]).drop("n").withColumnsRenamed({"q0": "p50", "q1": "p90", "q2": "p95", "q3": "p99"})
    return base.join(F.broadcast(q), F.lit(True), "left")  # one row, or none without cells


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """(positives, ap): the mean precision at each positive, by falling score; equal scores count as one step."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    by = known.groupBy((-F.col(score)).alias("s")).agg(F.count("*").alias("_c"), F.sum(F.col(label).cast("long")).alias("p"))
    n = _average_ranks(by.select("s", "_c"), "s").join(by, "s").select("s", "p", (F.col("_rank") + (F.col("_c") - 1) / 2).alias("upto"))  # rows at or above the score
    hits = by.groupBy("s").agg(F.max("p").alias("_c")).filter("_c > 0")
    tp = _average_ranks(hits, "s").join(hits, "s").select("s", (F.col("_rank") + (F.col("_c") - 1) / 2).alias("tp"))
    return n.join(tp, "s").agg(F.sum("p").alias("positives"), F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("upto")), F.sum("p")).alias("ap"))


def auc_interval(found: DataFrame, z: float = 1.96) -> DataFrame:
    """The analytic interval of an area under the curve, from (positives, negatives, auc)."""
    a, p, n = F.col("auc"), F.col("positives"), F.col("negatives")
    variance = (a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n)
    half = z * F.sqrt(F.greatest(variance, F.lit(0.0)))
    return found.withColumns({"low": F.greatest(F.lit(0.0), a - half), "high": F.least(F.lit(1.0), a + half)})


def price_screens(bids: DataFrame, screens: DataFrame, tender: Column) -> DataFrame:
    """Each bid with its price held against the estimate and the tender's mean, the activity of bidder and buyer, and for every
    screen whether it could be had (``_ok``); what could not is 0."""
    price, estimate = F.when(F.col("bid_price") > 0, F.col("bid_price")), F.when(F.col("lot_estimatedprice") > 0, F.col("lot_estimatedprice"))
    rows = bids.select("bid_id", tender.alias("tender"), price.alias("price"), estimate.alias("estimate"), "bidder_id", "buyer_id")
    out = rows.join(screens.select("tender", "mean", "cv", "diffp", "rd"), "tender", "left")
    for who in ("bidder", "buyer"):  # null keys are no actor and meet nobody
        activity = bids.filter(F.col(f"{who}_id").isNotNull()).groupBy(f"{who}_id").agg(F.count("*").alias(f"{who}_freq"))
        out = out.join(activity, f"{who}_id", "left")
    out = out.withColumns({"price_to_est": F.try_divide("price", "estimate"), "price_to_tender_mean": F.try_divide(F.col("price"), F.nullif("mean", F.lit(0.0)))})
    names = ("cv", "diffp", "rd", "price_to_est", "price_to_tender_mean", "bidder_freq", "buyer_freq")
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    return out.select("bid_id", *[F.when(fine(c), F.col(c)).otherwise(0).cast("double").alias(c) for c in names], *[fine(c).cast("int").alias(f"{c}_ok") for c in names])


def cell_states(df: DataFrame, amounts: Sequence[str], days: Sequence[str]) -> DataFrame:
    """(field, state, n) of text cells: EMPTY, CANONICAL (a plain number, an ISO day), RECOVERABLE (readable otherwise), GARBAGE."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")).alias("t"), F.lit(f in amounts).alias("money")) for f in (*amounts, *days)])).alias("c")).select("c.*")
    iso = F.col("t").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    plain = F.col("t").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    good = F.when(F.col("money"), plain & finite(F.col("t").try_cast("double"))).otherwise(iso & F.col("t").try_cast("date").isNotNull())
    other = F.when(F.col("money"), ~plain & finite(number(F.col("t")))).otherwise(~iso & parse_squeezed(squeeze(F.col("t"))).isNotNull())
    state = F.when(F.col("t") == "", "EMPTY").when(good, "CANONICAL").when(other, "RECOVERABLE").otherwise("GARBAGE")
    return long.groupBy("field", state.alias("state")).agg(F.count("*").alias("n"))


def missing_bucket(cleaned: DataFrame) -> Column:
    """none, 1-2, 3-5 or 6+ by the number of null fields."""
    n = reduce(lambda a, b: a + b, [F.col(f).isNull().cast("int") for f in FIELDS])
    return F.when(n == 0, "none").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+")


def tiered_reference(df: DataFrame, value: str, tiers: Sequence[str], least: int = 8) -> DataFrame:
    """Each record's median of ``value`` from the first tier whose group has enough values, else from all: ``reference``, ``tier``."""
    out = df
    for t in tiers:
        known = df.filter(F.col(t).isNotNull())
        found = exact_quantiles(known, [t], value, [0.5]).filter(F.col("n") >= least).select(t, F.col("q0").alias(f"_m_{t}"))
        out = out.join(found, t, "left")
    everything = exact_quantiles(df, [], value, [0.5]).select(F.col("q0").alias("_m_all"))
    out = out.crossJoin(F.broadcast(everything))  # one row
    tier = F.coalesce(*[F.when(F.col(f"_m_{t}").isNotNull(), t) for t in tiers], F.lit("all"))
    return out.withColumns({"reference": F.coalesce(*[F.col(f"_m_{t}") for t in tiers], F.col("_m_all")), "tier": tier}).drop(*[f"_m_{t}" for t in tiers], "_m_all")


def baselines(cleaned: DataFrame, labels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(field, measure, value): how often the commonest value is right, and the mean distance from the median."""
    out = None
    for f in labels:
        counts = cleaned.filter(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("c"))
        one = counts.agg(F.try_divide(F.max("c").cast("double"), F.sum("c")).alias("value")).select(F.lit(f).alias("field"), F.lit("mode_accuracy").alias("measure"), "value")
        out = one if out is None else out.unionByName(one)
    for f in numbers:
        known = cleaned.select(F.col(f).alias("x")).filter("abs(x) < double('infinity')")
        middle = exact_quantiles(known, [], "x", [0.5]).select("q0")
        one = known.crossJoin(F.broadcast(middle)).agg(F.avg(F.abs(F.col("x") - F.col("q0"))).alias("value")).select(F.lit(f).alias("field"), F.lit("median_error").alias("measure"), "value")  # one row
        out = one if out is None else out.unionByName(one)
    return out


def top_terms(vectors: DataFrame, groups: DataFrame, k: int = 4) -> DataFrame:
    """(grp, place, term, weight): the k terms of greatest mean weight of each group of texts; (text, term, weight), (text, grp)."""
    size = groups.groupBy("grp").agg(F.count("*").alias("_n"))
    mean = vectors.join(groups, "text").groupBy("grp", "term").agg(F.sum("weight").alias("w")).join(size, "grp").select("grp", "term", (F.col("w") / F.col("_n")).alias("weight")).filter("weight > 0")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), 1, k)
    # first the k best of each part of a group's terms, then of those: no group is gathered whole
    parts = mean.groupBy("grp", F.pmod(F.xxhash64("term"), F.lit(64)).alias("p")).agg(best.alias("b"))
    joined = parts.groupBy("grp").agg(F.slice(F.sort_array(F.flatten(F.collect_list("b"))), 1, k).alias("b"))
    return joined.select("grp", F.posexplode("b").alias("at", "b")).select("grp", (F.col("at") + 1).alias("place"), "b.term", (-F.col("b.w")).alias("weight"))


def pair_counts(pairs: DataFrame, cosine: str = "cosine", score: str = "score", limits: Sequence[float] = (0.85, 0.9, 0.95, 0.99)) -> DataFrame:
    """Diagnostics of scored pairs: how many reach each limit of cosine, the best one, and what distance in time takes away."""
    return pairs.agg(*[F.count_if(F.col(cosine) >= x).alias(f"at_{int(round(x * 100))}") for x in limits], F.max(cosine).alias("best"), F.avg(F.col(score) / F.nullif(F.col(cosine), F.lit(0.0))).alias("kept_by_time"))


def evaluate_pairs(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of predicted against actual pairs; the order within a pair and repeats do not matter."""
    tidy = lambda d: d.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = tidy(predicted).withColumn("p", F.lit(1)).join(tidy(actual).withColumn("t", F.lit(1)), ["a", "b"], "full")
    n = both.agg(F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def places_named(documents: DataFrame, places: DataFrame, doc: str = "doc_id", text: str = "text", place: str = "place", least: int = 3) -> DataFrame:
    """(doc, place, mentions): the one-word places a document names, whole words, at least ``least`` times."""
    words = documents.select(doc, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("w")).filter("w != ''").groupBy(doc, "w").agg(F.count("*").alias("mentions")).filter(F.col("mentions") >= least)
    known = places.select(F.lower(F.trim(place)).alias("w")).filter("w IS NOT NULL AND w != ''").distinct()
    return words.join(known, "w").select(doc, F.col("w").alias("place"), "mentions")


def work_group_context(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, group_size, conflict): records of each key and whether they differ in ``value``; null keys are one group."""
    return df.groupBy(key).agg(F.count("*").alias("group_size"), (F.count_distinct(value) > 1).alias("conflict"))


def conflicting_records(df: DataFrame, key: str, value: str) -> DataFrame:
    """The records whose key stands with different values, by a semi join; null keys do not conflict."""
    clash = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("_d")).filter("_d > 1").select(key)
    return df.join(clash, key, "left_semi")


def usable_channels(labels: DataFrame, label: str, total: int, least: int = 50, most: float = 0.5) -> DataFrame:
    """(label, n): the classes with enough members that do not make up more than ``most`` of all."""
    return labels.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") <= most * F.lit(total)))


def character_terms(text: Column) -> Column:
    """Runs of two to four characters inside words that have a blank put on either side; a shorter word counts once whole."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))
    each = lambda w: F.concat(runs(w, 2), F.when(F.length(w) >= 3, runs(w, 3)).otherwise(F.array().cast("array<string>")), F.when(F.length(w) >= 4, runs(w, 4)).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(words, each))


def character_tfidf(texts: DataFrame, text: str, least: int = 2, most: int = 20_000) -> DataFrame:
    """(text, term, weight) over the ``most`` commonest character runs held by ``least`` texts or more, as ``duplicates.tfidf``."""
    whole = texts.select(F.col(text).alias("text")).filter("trim(text) != ''").distinct()
    tf = whole.select("text", F.explode(character_terms(F.col("text"))).alias("term")).groupBy("text", "term").agg(F.count("*").alias("c"))
    tf = materialize(tf, "character-runs")
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("total")).filter(F.col("df") >= least).orderBy(F.desc("total"), "term").limit(most)  # the vocabulary: a fixed size
    n = whole.agg(F.count("*").alias("n"))
    raw = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(n)).select("text", "term", (F.col("c") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # n is one row
    norm = raw.groupBy("text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "text").select("text", "term", (F.col("w") / F.col("norm")).alias("weight"))


def decision_json(risky: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, body): what is known of a record as one nested JSON text with fixed names; nulls are kept."""
    body = F.struct(
        F.struct("confidence", *COMPONENTS).alias("confidence"), F.struct("severity", "anomaly_types").alias("findings"), F.col(key).alias("record_id"), F.struct("risk", "risk_reason").alias("risk"),
    )
    return risky.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
