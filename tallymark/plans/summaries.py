"""Queries that describe, explain and sum up the stages, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import anomaly, cleaning, duplicates, screens, summaries
from tallymark.plans import works as w
from tallymark.plans.works import CELLS, CLEAN, PEERS, TO_RISK, TO_SCORED, cleaned, query, risky, scored, structured
from tallymark.runtime import materialize, table

DATES, AMOUNTS = cleaning.DATES, cleaning.AMOUNTS


def _round(df, places: int, *columns: str):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"""WITH {CLEAN}, {CELLS}, c AS (SELECT field, value, count(*) AS c FROM cells WHERE reason = 'present' GROUP BY ALL), m AS (SELECT field, max(c) AS most, count(*) AS d, sum(c) AS p FROM c GROUP BY field),
    a AS (SELECT field, count(*) AS n FROM cells GROUP BY field)
    SELECT a.field, coalesce(p, 0)::BIGINT AS present, (n - coalesce(p, 0))::BIGINT AS nulls, coalesce(d, 0) AS distinct_values, most AS top_freq FROM a LEFT JOIN m USING (field)""")
def describe_fields(spark, sf_dir):
    return summaries.describe_fields(cleaned(spark, sf_dir)).drop("top")  # numbers as text differ between engines


@query(f"""WITH {CLEAN}, {CELLS}, c AS (SELECT field, value, count(*) AS c FROM cells WHERE reason = 'present' AND field IN ('district', 'state', 'status', 'vendor_name', 'implementing_agency') GROUP BY ALL)
    SELECT field, arg_min(value, (-c, value)) AS top FROM c GROUP BY field""")
def commonest_values(spark, sf_dir):
    return summaries.describe_fields(cleaned(spark, sf_dir)).filter(F.col("field").isin("district", "state", "status", "vendor_name", "implementing_agency")).select("field", "top")


@query(f"""WITH {CLEAN}, l AS ({" UNION ALL ".join(f"SELECT '{d}' AS field, {d} AS d FROM clean WHERE {d} IS NOT NULL" for d in DATES)})
    SELECT field, count(*) AS n, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last, quantile_cont((d - DATE '1970-01-01')::BIGINT, 0.5) AS median_day FROM l GROUP BY field""")
def date_ranges(spark, sf_dir):
    return summaries.date_ranges(cleaned(spark, sf_dir))


@query(f"""WITH {CLEAN}, f AS (SELECT CASE WHEN NOT isinf(sanction_amount) THEN sanction_amount END AS a, CASE WHEN NOT isinf(amount_spent) THEN amount_spent END AS b FROM clean),
    nm AS (SELECT count(*) AS c FROM clean WHERE work_name IS NOT NULL GROUP BY work_name)
    SELECT 'records' AS metric, count(*)::DOUBLE AS value FROM f UNION ALL SELECT 'total_sanction_amount', round(sum(a), 2) FROM f UNION ALL SELECT 'mean_sanction_amount', round(avg(a), 2) FROM f
    UNION ALL SELECT 'total_amount_spent', round(sum(b), 2) FROM f UNION ALL SELECT 'mean_amount_spent', round(avg(b), 2) FROM f
    UNION ALL SELECT 'repeated_names_pct', round(coalesce(sum(c) FILTER (c > 1), 0) * 100 / sum(c), 2) FROM nm
    UNION ALL SELECT 'status_' || coalesce(status, 'none'), count(*) FROM clean GROUP BY 1""")
def corpus_summary(spark, sf_dir):
    return _round(summaries.corpus_summary(cleaned(spark, sf_dir)), 2, "value")


_METRICS = ("confidence", *summaries.COMPONENTS)


@query(f"""{TO_SCORED}, l AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS x FROM scored WHERE {m} IS NOT NULL" for m in _METRICS)})
    SELECT metric, count(*) AS n, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std, round(min(x), 7) AS min, round(max(x), 7) AS max, round(median(x), 7) AS median, round(quantile_cont(x, 0.05), 7) AS p05,
        round(quantile_cont(x, 0.95), 7) AS p95, round(100 * count(*) FILTER (x < 0.2) / count(*), 6) AS low_pct, round(100 * count(*) FILTER (x > 0.8) / count(*), 6) AS high_pct,
        round(100 * count(*) FILTER (x = 0) / count(*), 6) AS zero_pct FROM l GROUP BY metric""")
def confidence_metrics(spark, sf_dir):
    s = summaries.metric_summary(materialize(scored(spark, sf_dir).select("record_id", *_METRICS), "scored"))
    return _round(_round(s, 7, "mean", "std", "min", "max", "median", "p05", "p95"), 6, "low_pct", "high_pct", "zero_pct")


@query(f"""{TO_SCORED}, x AS (SELECT record_id, completeness AS c, temporal AS t, reconciliation AS r, temporal_defined AS dt, branch <> 'both_null' AS dr,
        0.4 + CASE WHEN temporal_defined THEN 0.4 ELSE 0 END + CASE WHEN branch <> 'both_null' THEN 0.2 ELSE 0 END AS live FROM scored),
    n AS (SELECT *, CASE WHEN c > 0 THEN -ln(CASE WHEN c > 0 THEN c END) * 0.4 / live END AS nc, CASE WHEN dt AND t > 0 THEN -ln(CASE WHEN t > 0 THEN t END) * 0.4 / live END AS nt,
        CASE WHEN dr AND r > 0 THEN -ln(CASE WHEN r > 0 THEN r END) * 0.2 / live END AS nr FROM x),
    s AS (SELECT *, coalesce(nc, 0) + coalesce(nt, 0) + coalesce(nr, 0) AS total FROM n)
    SELECT record_id, round(nc, 6) + 0.0 AS nats_completeness, round(nt, 6) + 0.0 AS nats_temporal, round(nr, 6) + 0.0 AS nats_reconciliation,
        CASE WHEN c <= 0 THEN 'completeness' WHEN dt AND t <= 0 THEN 'temporal' WHEN dr AND r <= 0 THEN 'reconciliation' WHEN round(nc, 9) >= greatest(round(nt, 9), round(nr, 9)) OR (nt IS NULL AND nr IS NULL) THEN 'completeness'
            WHEN round(nt, 9) >= round(nr, 9) OR nr IS NULL THEN 'temporal' WHEN nr IS NOT NULL THEN 'reconciliation' END AS primary_driver FROM s""")
def confidence_explained(spark, sf_dir):
    s = scored(spark, sf_dir).withColumns({c: F.col(c) for c in summaries.COMPONENTS})
    e = summaries.explain_confidence(s)
    return _round(e, 6, *[f"nats_{c}" for c in summaries.COMPONENTS]).select("record_id", *[(F.col(f"nats_{c}") + 0.0).alias(f"nats_{c}") for c in summaries.COMPONENTS], "primary_driver")


_REASONS = ("z_cell_cost", "z_kind_cost", "z_spend", "z_duration")


@query(f"""{TO_RISK} SELECT CASE WHEN severity IS NOT NULL THEN 'ok' WHEN NOT has_norm THEN 'cluster_noise'
        WHEN {" AND ".join(f"{z}_reason IN ('feature_missing', 'defined')" for z in _REASONS)} AND ({" OR ".join(f"{z}_reason <> 'defined'" for z in _REASONS)}) THEN 'insufficient_features'
        WHEN {" OR ".join(f"{z}_reason = 'no_peer_norm'" for z in _REASONS)} THEN 'no_peer_norm' ELSE 'no_valid_deviation' END AS reason, count(*) AS n FROM rr GROUP BY 1""")
def severity_reasons(spark, sf_dir):
    r = risky(spark, sf_dir)
    return r.groupBy(summaries.severity_reason(r).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{TO_RISK}, x AS (SELECT record_id, round(risk, 6) AS risk FROM rr), p AS (SELECT record_id, (rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2) * 100 / count(*) OVER () AS p FROM x WHERE risk IS NOT NULL)
    SELECT record_id, CASE WHEN risk IS NULL THEN 'insufficient_data' WHEN risk >= 0.5 THEN 'high_risk' WHEN risk >= 0.2 THEN 'moderate_risk' ELSE 'low_risk' END AS level,
        CASE WHEN p >= 99 THEN 'TOP_1_PERCENT' WHEN p >= 95 THEN 'TOP_5_PERCENT' WHEN p >= 75 THEN 'HIGH' WHEN p >= 25 THEN 'MEDIUM' WHEN p >= 0 THEN 'LOW' END AS band FROM x LEFT JOIN p USING (record_id)""")
def risk_bands(spark, sf_dir):
    r = materialize(risky(spark, sf_dir).select("record_id", F.round("risk", 6).alias("risk")), "risk")
    return summaries.risk_bands(r).select("record_id", summaries.risk_level(F.col("risk")).alias("level"), "band")


@query(f"""{TO_RISK}, e AS (SELECT unnest(anomaly_types) AS anomaly, severity, risk FROM rr)
    SELECT anomaly, count(*) AS records, round(count(*) * 100 / (SELECT count(*) FROM rr), 6) AS pct, round(avg(severity), 6) AS mean_severity, round(median(risk), 6) AS median_risk, round(quantile_cont(risk, 0.95), 6) AS p95_risk
    FROM e GROUP BY anomaly""")
def anomaly_rates(spark, sf_dir):
    r = materialize(risky(spark, sf_dir).select("record_id", "anomaly_types", "severity", "risk"), "risk")
    return _round(summaries.type_rates(r), 6, "pct", "mean_severity", "median_risk", "p95_risk")


@query(f"""{TO_RISK}, l AS (SELECT ln(risk) AS r, ln(strength) AS s, ln(quality) AS q, ln(1 - uncertainty) AS c FROM rr WHERE risk > 0)
    SELECT 'strength' AS factor, round(covar_pop(s, r) / var_pop(r), 6) AS share FROM l UNION ALL SELECT 'quality', round(covar_pop(q, r) / var_pop(r), 6) FROM l UNION ALL SELECT 'certainty', round(covar_pop(c, r) / var_pop(r), 6) FROM l""")
def risk_contributions(spark, sf_dir):
    return _round(summaries.contributions(risky(spark, sf_dir)), 6, "share")


@query(f"""{TO_SCORED}, {PEERS}, c AS (SELECT kind, stratum, count(*) AS size, bool_or(cell_stable) AS stable FROM st WHERE kind IS NOT NULL GROUP BY ALL)
    SELECT count(*) AS cells, count(*) FILTER (stable) AS stable_cells, coalesce(sum(size) FILTER (stable), 0)::BIGINT AS in_stable, quantile_cont(size, 0.5) AS p50, round(quantile_cont(size, 0.9), 6) AS p90,
        round(quantile_cont(size, 0.95), 6) AS p95, round(quantile_cont(size, 0.99), 6) AS p99 FROM c""")
def peer_cell_sizes(spark, sf_dir):
    return _round(summaries.cell_sizes(structured(spark, sf_dir)), 6, "p90", "p95", "p99")


@query("""WITH x AS (SELECT score, (verdict = 'same')::INT AS y FROM work_matches WHERE score IS NOT NULL AND verdict IS NOT NULL),
    g AS (SELECT score, sum(y) AS p, count(*) AS c FROM x GROUP BY score), r AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS n FROM g)
    SELECT sum(p)::BIGINT AS positives, round(sum(p * tp / n) / sum(p), 7) AS ap FROM r""")
def match_average_precision(spark, sf_dir):
    m = table(spark, sf_dir, "work_matches").select("score", (F.col("verdict") == "same").alias("y"))
    return _round(summaries.average_precision(m, "score", "y"), 7, "ap")


@query("""WITH x AS (SELECT score, (verdict = 'same')::INT AS y FROM work_matches WHERE score IS NOT NULL AND verdict IS NOT NULL),
    r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM x),
    a AS (SELECT sum(y) AS p, count(*) - sum(y) AS n, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r),
    v AS (SELECT auc, sqrt((auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (n - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (p * n)) AS s FROM a)
    SELECT round(auc, 6) AS auc, round(greatest(0, auc - 1.96 * s), 6) AS low, round(least(1, auc + 1.96 * s), 6) AS high FROM v""")
def match_auc_interval(spark, sf_dir):
    m = table(spark, sf_dir, "work_matches").select("score", (F.col("verdict") == "same").alias("y"))
    return _round(summaries.auc_interval(anomaly.auc(m, "score", "y")), 6, "auc", "low", "high").select("auc", "low", "high")


@query("""WITH t AS (SELECT *, concat_ws('|', coalesce(buyer_id, 'None'), coalesce(tender_publications_firstcallfortenderdate, 'None'), coalesce(main_cpv_4, 'None')) AS tender, CASE WHEN bid_price > 0 THEN bid_price END AS p,
        CASE WHEN lot_estimatedprice > 0 THEN lot_estimatedprice END AS e FROM bids), m AS (SELECT tender, avg(p) AS mean FROM t GROUP BY tender),
    b AS (SELECT bidder_id, count(*) AS bf FROM bids WHERE bidder_id IS NOT NULL GROUP BY 1), y AS (SELECT buyer_id, count(*) AS yf FROM bids WHERE buyer_id IS NOT NULL GROUP BY 1)
    SELECT bid_id, round(coalesce(p / e, 0), 6) AS price_to_est, (p / e IS NOT NULL)::INT AS price_to_est_ok, round(coalesce(p / mean, 0), 6) AS price_to_tender_mean, (p / mean IS NOT NULL)::INT AS price_to_tender_mean_ok,
        coalesce(bf, 0)::DOUBLE AS bidder_freq, coalesce(yf, 0)::DOUBLE AS buyer_freq FROM t JOIN m USING (tender) LEFT JOIN b USING (bidder_id) LEFT JOIN y USING (buyer_id)""")
def bid_price_screens(spark, sf_dir):
    bids = table(spark, sf_dir, "bids")
    tender = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("None")) for c in screens.TENDER])
    s = summaries.price_screens(bids, screens.tender_screens(bids), tender)
    s = s.select("bid_id", "price_to_est", "price_to_est_ok", "price_to_tender_mean", "price_to_tender_mean_ok", "bidder_freq", "buyer_freq")
    return _round(s, 6, "price_to_est", "price_to_tender_mean")


_DAY = lambda c: w._date(w._squeeze(c))


@query(f"""WITH l AS ({" UNION ALL ".join(f"SELECT '{d}' AS field, coalesce(trim({d}), '') AS t FROM synthetic_dataset" for d in DATES)}),
    s AS (SELECT field, CASE WHEN t = '' THEN 'EMPTY' WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CASE WHEN try_cast(t AS DATE) IS NOT NULL THEN 'CANONICAL' ELSE 'GARBAGE' END
        WHEN {_DAY("t")} IS NOT NULL THEN 'RECOVERABLE' ELSE 'GARBAGE' END AS state FROM l) SELECT field, state, count(*) AS n FROM s GROUP BY ALL""")
def date_cell_states(spark, sf_dir):
    return summaries.cell_states(table(spark, sf_dir, "synthetic_dataset", *DATES), (), DATES)


@query(f"""WITH {CLEAN}, n AS (SELECT {" + ".join(f"({f} IS NULL)::INT" for f in cleaning.FIELDS)} AS k FROM clean)
    SELECT CASE WHEN k = 0 THEN 'none' WHEN k <= 2 THEN '1-2' WHEN k <= 5 THEN '3-5' ELSE '6+' END AS bucket, count(*) AS n FROM n GROUP BY 1""")
def missing_buckets(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.groupBy(summaries.missing_bucket(c).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {CLEAN}, a AS (SELECT implementing_agency, median(sanction_amount) AS m FROM clean WHERE implementing_agency IS NOT NULL AND sanction_amount IS NOT NULL GROUP BY 1 HAVING count(*) >= 8),
    d AS (SELECT district, median(sanction_amount) AS m FROM clean WHERE district IS NOT NULL AND sanction_amount IS NOT NULL GROUP BY 1 HAVING count(*) >= 8)
    SELECT record_id, CASE WHEN a.m IS NOT NULL THEN 'implementing_agency' WHEN d.m IS NOT NULL THEN 'district' ELSE 'all' END AS tier,
        round(coalesce(a.m, d.m, (SELECT median(sanction_amount) FROM clean)), 4) AS reference FROM clean LEFT JOIN a USING (implementing_agency) LEFT JOIN d USING (district)""")
def tiered_reference(spark, sf_dir):
    c = materialize(cleaned(spark, sf_dir).select("record_id", "implementing_agency", "district", "sanction_amount"), "amounts")
    return _round(summaries.tiered_reference(c, "sanction_amount", ("implementing_agency", "district")), 4, "reference").select("record_id", "tier", "reference")


@query(f"""WITH {CLEAN}, m AS (SELECT 'district' AS field, district AS v, count(*) AS c FROM clean WHERE district IS NOT NULL GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM clean WHERE status IS NOT NULL GROUP BY 2)
    SELECT field, 'mode_accuracy' AS measure, round(max(c) / sum(c), 7) AS value FROM m GROUP BY field
    UNION ALL SELECT 'sanction_amount', 'median_error', round(avg(abs(sanction_amount - (SELECT median(sanction_amount) FROM clean WHERE NOT isinf(sanction_amount)))), 7) FROM clean WHERE NOT isinf(sanction_amount)""")
def baselines(spark, sf_dir):
    c = materialize(cleaned(spark, sf_dir).select("district", "status", "sanction_amount"), "baseline")
    return _round(summaries.baselines(c, ("district", "status"), ("sanction_amount",)), 7, "value")


@query(rf"""WITH {CLEAN}, k0 AS (SELECT *, {w._KIND_TEXT} AS ktext FROM clean), {w._TERMS}, g AS (SELECT DISTINCT ktext AS t, district AS grp FROM k0 WHERE ktext <> '' AND district IS NOT NULL),
    z AS (SELECT grp, count(*) AS n FROM g GROUP BY grp), m AS (SELECT grp, term, sum(weight) / any_value(n) AS weight FROM vec JOIN g USING (t) JOIN z USING (grp) GROUP BY ALL)
    SELECT grp, count(*) AS terms, round(max(weight), 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, term) AS r FROM m) WHERE r <= 4 GROUP BY grp""")
def district_terms(spark, sf_dir):
    texts = w._texts(spark, sf_dir)
    groups = texts.filter("text != '' AND district IS NOT NULL").select("text", F.col("district").alias("grp")).distinct()
    best = summaries.top_terms(duplicates.tfidf(texts, "text"), groups)
    return best.groupBy("grp").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("best"))


@query(rf"""WITH {CLEAN}, k0 AS (SELECT record_id, district, date_approval AS day, {w._FULL_TEXT} AS ktext FROM clean), {w._TERMS},
    x AS (SELECT record_id, district, day, term, weight FROM k0 JOIN vec ON ktext = t WHERE district IS NOT NULL AND day IS NOT NULL),
    p AS (SELECT a.record_id AS a, b.record_id AS b, sum(a.weight * b.weight) AS c, any_value(abs(a.day - b.day)) AS days FROM x a JOIN x b ON a.district = b.district AND a.term = b.term AND a.record_id < b.record_id GROUP BY 1, 2),
    s AS (SELECT round(c, 6) AS c, round(c * exp(-days / 180), 6) AS score FROM p WHERE c * exp(-days / 180) >= 0.85)
    SELECT count(*) FILTER (c >= 0.85) AS at_85, count(*) FILTER (c >= 0.9) AS at_90, count(*) FILTER (c >= 0.95) AS at_95, count(*) FILTER (c >= 0.99) AS at_99, max(c) AS best, round(avg(score / c), 5) AS kept_by_time FROM s""")
def duplicate_diagnostics(spark, sf_dir):
    pairs = w._duplicate_scores(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("cosine", "score")})
    return _round(summaries.pair_counts(pairs), 5, "kept_by_time")


@query("""WITH p AS (SELECT DISTINCT least(record_a, record_b) AS a, greatest(record_a, record_b) AS b FROM work_matches WHERE score >= 0.8 AND record_a <> record_b),
    t AS (SELECT DISTINCT least(record_a, record_b) AS a, greatest(record_a, record_b) AS b FROM work_matches WHERE verdict = 'same' AND record_a <> record_b),
    n AS (SELECT count(*) FILTER (p.a IS NOT NULL AND t.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*) FILTER (p.a IS NULL) AS fn FROM p FULL JOIN t ON p.a = t.a AND p.b = t.b)
    SELECT tp, fp, fn, round(tp / (tp + fp), 7) AS precision, round(tp / (tp + fn), 7) AS recall, round(2 * tp / (2 * tp + fp + fn), 7) AS f1 FROM n""")
def match_evaluation(spark, sf_dir):
    m = table(spark, sf_dir, "work_matches").withColumnsRenamed({"record_a": "a", "record_b": "b"}).filter("a IS NOT NULL AND b IS NOT NULL")
    return _round(summaries.evaluate_pairs(m.filter("score >= 0.8").select("a", "b"), m.filter("verdict = 'same'").select("a", "b")), 7, "precision", "recall", "f1")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS mentions FROM w GROUP BY ALL HAVING count(*) >= 3)
    SELECT doc_id, w AS place, mentions FROM c JOIN (SELECT DISTINCT lower(trim(district)) AS w FROM synthetic_dataset WHERE district IS NOT NULL) USING (w) WHERE w <> ''""")
def places_named(spark, sf_dir):
    return summaries.places_named(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "synthetic_dataset", "district"), place="district")


@query(f"WITH {CLEAN} SELECT work_id, count(*) AS group_size, count(DISTINCT status) > 1 AS conflict FROM clean GROUP BY work_id")
def work_group_context(spark, sf_dir):
    return summaries.work_group_context(cleaned(spark, sf_dir), "work_id", "status")


@query(f"WITH {CLEAN} SELECT record_id, district, status FROM clean ORDER BY record_id LIMIT 20")
def head(spark, sf_dir):
    return summaries.head(cleaned(spark, sf_dir), 20, ("district", "status"))


@query(f"{TO_RISK} SELECT record_id, risk_reason FROM rr WHERE risk_reason = 'no_peer_norm'")
def records_without_norm(spark, sf_dir):
    r = summaries.of_class(risky(spark, sf_dir), "risk_reason", "no_peer_norm", ("ok", "confidence_below_gate", "severity_undefined", "no_peer_norm"))
    return r.select("record_id", "risk_reason")


@query(f"""WITH {CLEAN}, x AS (SELECT work_id FROM clean WHERE work_id IS NOT NULL GROUP BY work_id HAVING count(DISTINCT district) > 1) SELECT record_id, work_id, district FROM clean WHERE work_id IN (SELECT work_id FROM x)""")
def conflicting_works(spark, sf_dir):
    return summaries.conflicting_records(cleaned(spark, sf_dir).select("record_id", "work_id", "district"), "work_id", "district")


@query("""SELECT issue_type, count(*) AS n FROM audit_findings WHERE issue_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 50 AND count(*) <= 0.5 * (SELECT count(*) FROM audit_findings)""")
def usable_channels(spark, sf_dir):
    f = table(spark, sf_dir, "audit_findings", "issue_type")
    return summaries.usable_channels(f, "issue_type", f.count())


@query(f"""{TO_SCORED} SELECT record_id, round(completeness, 7) AS completeness, round(temporal, 7) AS temporal, round(reconciliation, 7) AS reconciliation, temporal_defined, branch <> 'both_null' AS reconciliation_defined,
    1 + temporal_defined::INT + (branch <> 'both_null')::INT AS n_components_used, pairs AS temporal_pairs, hard_fail AS temporal_hard_fail, branch AS reconciliation_branch, lifecycle_state, round(spend_ratio, 6) AS spend_ratio,
    {" + ".join(f"(null_reason__{f} = 'present')::INT" for f in cleaning.FIELDS)} AS n_valid_fields, {" + ".join(f"(null_reason__{f} <> 'present')::INT" for f in w.confidence.CRITICAL)} AS critical_missing_count,
    round(({" + ".join(f"1 - ({w._CREDIT(f)})" for f in w.confidence.CRITICAL)})::DOUBLE, 6) AS critical_deficit, round(exp(-0.35 * greatest(0, {" + ".join(f"1 - ({w._CREDIT(f)})" for f in w.confidence.CRITICAL)} - 1)), 6) AS cluster_penalty_factor FROM scored""")
def confidence_breakdown(spark, sf_dir):
    s = scored(spark, sf_dir)
    missing = sum((F.col(f"null_reason__{f}") != "present").cast("int") for f in w.confidence.CRITICAL)
    used = 1 + F.col("temporal_defined").cast("int") + F.col("reconciliation_defined").cast("int")
    factor = F.exp(-w.confidence.DEFICIT_RATE * F.greatest(F.lit(0.0), F.col("critical_deficit") - 1))
    return s.select(
        "record_id", *[F.round(c, 7).alias(c) for c in summaries.COMPONENTS], "temporal_defined", "reconciliation_defined", used.alias("n_components_used"), "temporal_pairs", "temporal_hard_fail", "reconciliation_branch",
        "lifecycle_state", F.round("spend_ratio", 6).alias("spend_ratio"), "n_valid_fields", missing.alias("critical_missing_count"), F.round("critical_deficit", 6).alias("critical_deficit"), F.round(factor, 6).alias("cluster_penalty_factor"),
    )


@query("""WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS t FROM entity_register), w AS (SELECT t, ' ' || unnest(string_split(t, ' ')) || ' ' AS w FROM t WHERE t <> ''),
    g AS (SELECT t, w[i : i + n - 1] AS term FROM w, unnest([2, 3, 4]) k(n), unnest(range(1, greatest(2, length(w) - n + 2))) u(i) WHERE n = 2 OR length(w) >= n),
    c AS (SELECT t, term, count(*) AS c FROM g GROUP BY ALL), d AS (SELECT term, count(*) AS df, sum(c) AS total FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 20000),
    r AS (SELECT t, term, c * (ln((1 + (SELECT count(*) FROM t WHERE t <> '')) / (1 + df)) + 1) AS w FROM c JOIN d USING (term)), v AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS weight FROM r)
    SELECT t AS text, term, round(weight, 7) AS weight FROM v""")
def character_tfidf(spark, sf_dir):
    names = table(spark, sf_dir, "entity_register", "name").select(F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " ")).alias("t"))
    return _round(summaries.character_tfidf(names, "t"), 7, "weight")


@query()
def decision_bodies(spark, sf_dir):
    return summaries.decision_json(risky(spark, sf_dir))
