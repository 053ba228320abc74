"""Queries over the works register and its side tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import dates, text
from tallymark.operators import anomaly, cleaning, confidence, duplicates, entities, groups, matching, peers, reports, screens
from tallymark.operators.quantile import exact_quantiles
from tallymark.runtime import PLACEHOLDERS, materialize, spread, table
from tallymark.streaming import windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "synthetic_dataset")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(spread(works(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.score(materialize(cleaned(spark, sf_dir), "cleaned"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.structure(confidence.score(materialize(peers.with_text(cleaned(spark, sf_dir)), "cleaned")))


def risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.with_risk(anomaly.with_severity(anomaly.with_types(anomaly.with_signals(peers.deviations(structured(spark, sf_dir))))))


# ---- SQL of the stages -------------------------------------------------------------------------------------------------
_PH = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
_MON = "(jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|september|oct|october|nov|november|dec|december)"
_CLOCK = "([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?"


def _squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _date(t: str) -> str:
    iso, dn, nd = f"([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_CLOCK}", f"([0-9]{{1,2}}) {_MON} ([0-9]{{4}})", f"{_MON} ([0-9]{{1,2}}), ([0-9]{{4}})"
    month = lambda x: f"((strpos('janfebmaraprmayjunjulaugsepoctnovdec', left({x}, 3)) + 2) // 3)"
    g = lambda p, i: f"regexp_extract(lower({t}), '{p}', {i})"
    last = [rf"WHEN regexp_full_match({t}, '([0-9]{{1,2}}){s}([0-9]{{1,2}}){s}([0-9]{{4}})') THEN regexp_replace({t}, '([0-9]{{1,2}}){s}([0-9]{{1,2}}){s}([0-9]{{4}})', '\3-\2-\1')" for s in ("-", "/", "[.]")]
    return rf"""try_cast(CASE WHEN regexp_full_match({t}, '{iso}') THEN regexp_replace({t}, '{iso}', '\1-\2-\3') {" ".join(last)}
        WHEN regexp_full_match({t}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN replace({t}, '/', '-')
        WHEN regexp_full_match(lower({t}), '{dn}') THEN {g(dn, 3)} || '-' || {month(g(dn, 2))} || '-' || {g(dn, 1)}
        WHEN regexp_full_match(lower({t}), '{nd}') THEN {g(nd, 3)} || '-' || {month(g(nd, 1))} || '-' || {g(nd, 2)}
        WHEN regexp_full_match({t}, '[0-9]{{8}}') THEN left({t}, 4) || '-' || substr({t}, 5, 2) || '-' || right({t}, 2) END AS DATE)"""


def _clean_sql() -> str:
    values, reasons = [], []
    for f in cleaning.FIELDS:
        if f in cleaning.AMOUNTS:
            values.append(f"CASE WHEN NOT isnan({f}) THEN {f} END AS {f}")
            reasons.append(f"CASE WHEN {f} IS NULL OR isnan({f}) THEN 'missing' ELSE 'present' END AS null_reason__{f}")
            continue
        t = _squeeze(f)
        v = _date(t) if f in cleaning.DATES else f"lower({t})"
        values.append(f"CASE WHEN lower({t}) NOT IN ({_PH}) THEN {v} END AS {f}")
        bad = f"WHEN {v} IS NULL THEN 'unparseable'" if f in cleaning.DATES else ""
        reasons.append(f"CASE WHEN {f} IS NULL OR {t} = '' THEN 'missing' WHEN lower({t}) IN ({_PH}) THEN 'placeholder' {bad} ELSE 'present' END AS null_reason__{f}")
    return f"clean AS MATERIALIZED (SELECT record_id, {', '.join(values)}, {', '.join(reasons)} FROM synthetic_dataset)"


CLEAN = _clean_sql()
CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT record_id, '{f}' AS field, null_reason__{f} AS reason, CAST({f} AS VARCHAR) AS value FROM clean" for f in cleaning.FIELDS) + ")"
ENTROPY = """counts AS (SELECT field, value, count(*) AS c FROM cells WHERE reason = 'present' GROUP BY ALL),
    tot AS (SELECT field, sum(c) AS n, count(*) AS k FROM counts GROUP BY field),
    fields AS (SELECT field, count(*) AS total FROM cells GROUP BY field),
    entropy AS (SELECT f.field, coalesce(t.n, 0) / f.total AS coverage, coalesce(t.k, 0) AS n_distinct,
        CASE WHEN coalesce(t.n, 0) IN (0, f.total) THEN 0 ELSE -(t.n / f.total) * log2(t.n / f.total) - (1 - t.n / f.total) * log2(1 - t.n / f.total) END AS h_null,
        CASE WHEN t.k > 1 THEN least(1, greatest(0, (SELECT -sum(c / t.n * log2(c / t.n)) FROM counts c2 WHERE c2.field = f.field) / log2(t.k))) ELSE 0 END AS h_value
        FROM fields f LEFT JOIN tot t USING (field))"""
_CRIT = ", ".join(f"('{f}', {w})" for f, w in confidence.CRITICALITY.items())
_CREDIT = lambda f: f"CASE null_reason__{f} WHEN 'present' THEN 1.0 WHEN 'missing' THEN 0.2 WHEN 'placeholder' THEN 0.08 ELSE 0.0 END"
SCORES = f"""w0 AS (SELECT field, CASE WHEN coverage >= 0.02 THEN crit * h_value ELSE 0 END AS v FROM entropy JOIN (VALUES {_CRIT}) x(field, crit) USING (field)),
    w AS (SELECT field, CASE WHEN (SELECT sum(v) FROM w0) > 0 THEN v ELSE 1 END AS v FROM w0),
    wide AS (SELECT {", ".join(f"max(v) FILTER (field = '{f}') AS w_{f}" for f in cleaning.FIELDS)}, sum(v) AS w_all FROM w),
    parts AS (SELECT clean.*,
        CASE WHEN {" OR ".join(f"null_reason__{f} = 'present'" for f in cleaning.FIELDS)} THEN ({" + ".join(f"({_CREDIT(f)}) * w_{f}" for f in cleaning.FIELDS)}) / w_all
            * exp(-0.35 * greatest(0, {" + ".join(f"1 - ({_CREDIT(f)})" for f in confidence.CRITICAL)} - 1)) ELSE 0 END AS completeness,
        (date_proposal IS NOT NULL AND date_approval IS NOT NULL)::INT + (date_approval IS NOT NULL AND date_completion IS NOT NULL)::INT AS pairs,
        ({" OR ".join(f"null_reason__{d} = 'unparseable' OR coalesce({d} < DATE '1993-01-01', false)" for d in cleaning.DATES)}) AS hard_fail,
        CASE WHEN date_proposal > date_approval THEN exp(-0.01 * (date_proposal - date_approval)) ELSE 1 END
            * CASE WHEN date_approval > date_completion THEN exp(-0.01 * (date_approval - date_completion)) ELSE 1 END AS orderly,
        CASE WHEN status IN ('proposed', 'approved', 'pending') THEN 'pre_completion' WHEN status IN ('completed', 'closed') THEN 'terminal' ELSE 'unknown' END AS lifecycle_state,
        CASE WHEN sanction_amount IS NULL AND amount_spent IS NULL THEN 'both_null'
            WHEN coalesce(isinf(sanction_amount), false) OR coalesce(isinf(amount_spent), false) THEN 'non_finite'
            WHEN coalesce(abs(sanction_amount) > 1e15, false) OR coalesce(abs(amount_spent) > 1e15, false) THEN 'implausible_magnitude'
            WHEN sanction_amount IS NULL OR amount_spent IS NULL THEN 'one_null' WHEN sanction_amount <= 0 THEN 'non_positive_sanction' ELSE 'both_present' END AS branch,
        amount_spent / (sanction_amount + 1e-6) AS ratio FROM clean, wide),
    comps AS (SELECT *, CASE WHEN hard_fail THEN 0 ELSE orderly END AS temporal, pairs > 0 OR hard_fail AS temporal_defined,
        CASE branch WHEN 'both_null' THEN 1 WHEN 'one_null' THEN 0.7 WHEN 'non_finite' THEN 0 WHEN 'implausible_magnitude' THEN 0 WHEN 'non_positive_sanction' THEN 0.25
            ELSE exp(-2 * greatest(0, ratio - 1.05)) * exp(-6 * CASE lifecycle_state WHEN 'pre_completion' THEN 0 WHEN 'terminal' THEN 1 ELSE 0.5 END * greatest(0, 0.2 - ratio)) END AS reconciliation,
        CASE WHEN branch = 'both_present' THEN ratio END AS spend_ratio FROM parts),
    scored AS MATERIALIZED (SELECT *, CASE WHEN completeness <= 0 OR (temporal_defined AND temporal <= 0) OR (branch <> 'both_null' AND reconciliation <= 0) THEN 0 ELSE
        exp((0.4 * ln(CASE WHEN completeness > 0 THEN completeness END) + CASE WHEN temporal_defined THEN 0.4 * ln(CASE WHEN temporal > 0 THEN temporal END) ELSE 0 END
            + CASE WHEN branch <> 'both_null' THEN 0.2 * ln(CASE WHEN reconciliation > 0 THEN reconciliation END) ELSE 0 END)
            / (0.4 + CASE WHEN temporal_defined THEN 0.4 ELSE 0 END + CASE WHEN branch <> 'both_null' THEN 0.2 ELSE 0 END)) END AS confidence FROM comps)"""
TO_SCORED = f"WITH {CLEAN}, {CELLS}, {ENTROPY}, {SCORES}"
_STOP = ", ".join(f"'{x}'" for x in (*text.BOILERPLATE, *text.LOCALITY, *peers.ACTIONS, ""))
_DELIMITERS = "|".join(d.strip() for d in peers.PLACES)
_KIND_TEXT = rf"""array_to_string(list_filter(string_split(regexp_replace(regexp_replace(coalesce(work_name, ''), ' ({_DELIMITERS}) .*$', '', 's'), '[^a-z0-9]+', ' ', 'g'), ' '),
    lambda t: t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '[0-9]+')), ' ')"""
PEERS = f"""k0 AS (SELECT *, {_KIND_TEXT} AS ktext FROM scored),
    kk AS (SELECT ktext FROM k0 WHERE ktext <> '' GROUP BY ktext HAVING count(*) >= {peers.MIN_CLUSTER}),
    k1 AS (SELECT k0.*, kk.ktext AS kind, CASE WHEN sanction_amount > 0 AND NOT isinf(sanction_amount) THEN ln(1 + sanction_amount) END AS log_cost,
        coalesce(confidence, 0) >= 0.5 AND branch NOT IN ('non_finite', 'implausible_magnitude') AND abs(coalesce(sanction_amount, 0)) <= 1e15 AND abs(coalesce(amount_spent, 0)) <= 1e15 AS is_reference
        FROM k0 LEFT JOIN kk USING (ktext)),
    ed AS (SELECT DISTINCT unnest(quantile_cont(log_cost, [0.2, 0.4, 0.6, 0.8])) AS e FROM k1 WHERE is_reference),
    k2 AS (SELECT *, CASE WHEN log_cost IS NULL THEN -1 ELSE (SELECT count(*) FROM ed WHERE e <= log_cost) END AS stratum FROM k1),
    k3 AS (SELECT *, CASE WHEN kind IS NOT NULL THEN count(*) OVER (PARTITION BY kind, stratum) END AS cell_size FROM k2),
    st AS MATERIALIZED (SELECT *, coalesce(cell_size >= {peers.MIN_CELL} AND stratum >= 0, false) AS cell_stable,
        CASE WHEN date_completion - date_proposal >= 0 AND NOT hard_fail THEN (date_completion - date_proposal)::DOUBLE END AS duration_days FROM k3),
    lng AS (SELECT kind, stratum, 'sanction_amount' AS feature, sanction_amount AS x, cell_stable, is_reference FROM st UNION ALL SELECT kind, stratum, 'spend_ratio', spend_ratio, cell_stable, is_reference FROM st
        UNION ALL SELECT kind, stratum, 'duration_days', duration_days, cell_stable, is_reference FROM st),
    cm AS (SELECT kind, stratum, feature, count(*) AS n, median(x) AS median FROM lng WHERE is_reference AND cell_stable AND x IS NOT NULL GROUP BY ALL HAVING count(*) >= {peers.MIN_NORM}),
    cn AS (SELECT kind, stratum, feature, any_value(cm.n) AS n, any_value(cm.median) AS median, nullif({peers.MAD_SCALE} * median(abs(x - cm.median)), 0) AS mad FROM lng JOIN cm USING (kind, stratum, feature)
        WHERE is_reference AND cell_stable AND x IS NOT NULL GROUP BY ALL),
    km AS (SELECT kind, count(*) AS n, median(sanction_amount) AS median FROM st WHERE is_reference AND kind IS NOT NULL AND sanction_amount IS NOT NULL GROUP BY kind HAVING count(*) >= {peers.MIN_NORM}),
    kn AS (SELECT kind, any_value(km.median) AS kmed, nullif({peers.MAD_SCALE} * median(abs(sanction_amount - km.median)), 0) AS kmad FROM st JOIN km USING (kind) WHERE is_reference AND sanction_amount IS NOT NULL GROUP BY kind)"""


def _reason(x: str, med: str, mad: str, cell: bool) -> str:
    return f"""CASE WHEN {x} IS NULL OR isinf({x}) THEN 'feature_missing' WHEN st.kind IS NULL THEN 'cluster_noise' {"WHEN NOT cell_stable THEN 'cell_unstable'" if cell else ""}
        WHEN {med} IS NULL THEN 'no_peer_norm' WHEN {mad} IS NULL THEN 'zero_dispersion' ELSE 'defined' END"""


_SPECS = (("z_cell_cost", "sanction_amount", "c1.median", "c1.mad", True), ("z_kind_cost", "sanction_amount", "kmed", "kmad", False), ("z_spend", "spend_ratio", "c2.median", "c2.mad", True), ("z_duration", "duration_days", "c3.median", "c3.mad", True))
DEVIATIONS = f"""dv AS MATERIALIZED (SELECT st.*, {", ".join(f"{_reason(x, m, d, c)} AS {z}_reason, CASE WHEN {_reason(x, m, d, c)} = 'defined' THEN ({x} - {m}) / {d} END AS {z}" for z, x, m, d, c in _SPECS)},
        st.kind IS NOT NULL AND (kmed IS NOT NULL OR c1.median IS NOT NULL) AS has_norm
    FROM st LEFT JOIN cn c1 ON st.kind = c1.kind AND st.stratum = c1.stratum AND c1.feature = 'sanction_amount' LEFT JOIN cn c2 ON st.kind = c2.kind AND st.stratum = c2.stratum AND c2.feature = 'spend_ratio'
        LEFT JOIN cn c3 ON st.kind = c3.kind AND st.stratum = c3.stratum AND c3.feature = 'duration_days' LEFT JOIN kn ON st.kind = kn.kind)"""
_Z = ("z_cost", "z_spend", "z_duration")
_HAVE = " + ".join(f"({z} IS NOT NULL)::INT" for z in _Z)
RISK = f"""sg AS (SELECT *, coalesce(z_cell_cost, z_kind_cost) AS z_cost FROM dv),
    sv AS (SELECT *, {_HAVE} AS valid_signals, (coalesce(0.45 * least(abs(z_cost) / 5, 1), 0) + coalesce(0.3 * least(abs(z_spend) / 5, 1), 0) + coalesce(0.15 * least(abs(z_duration) / 5, 1), 0))
        / nullif(CASE WHEN z_cost IS NOT NULL THEN 0.45 ELSE 0 END + CASE WHEN z_spend IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN z_duration IS NOT NULL THEN 0.15 ELSE 0 END, 0) AS severity,
        list_filter([CASE WHEN abs(z_cost) >= 3 THEN 'cost_outlier' END, CASE WHEN z_spend >= 3 THEN 'overspend' END, CASE WHEN z_spend <= -3 AND lifecycle_state = 'terminal' THEN 'underspend' END,
            CASE WHEN abs(z_duration) >= 3 THEN 'duration_outlier' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END,
            CASE WHEN {_HAVE} = 0 OR NOT cell_stable OR NOT has_norm THEN 'insufficient_context' END], lambda x: x IS NOT NULL) AS anomaly_types FROM sg),
    pk AS (SELECT *, greatest(abs(z_cost), abs(z_spend), abs(z_duration)) AS peak, least(confidence, completeness, CASE WHEN temporal_defined THEN temporal END, CASE WHEN branch <> 'both_null' THEN reconciliation END) AS lq,
        len(list_filter(anomaly_types, lambda x: x NOT IN ('low_confidence', 'insufficient_context'))) AS nt FROM sv),
    rk AS MATERIALIZED (SELECT *, severity + (1 - severity) * (0.2 * least(nt / 3, 1) + 0.3 * CASE WHEN peak >= 20 THEN 1 WHEN peak >= 5 THEN 0.5 ELSE 0 END) AS strength,
        CASE WHEN hard_fail THEN least(lq, 0.05) ELSE lq END * CASE WHEN confidence < 0.5 THEN 0.25 ELSE 1 END AS quality,
        least(1, CASE WHEN severity IS NULL THEN 1 ELSE 0 END + CASE WHEN has_norm THEN 0 ELSE 0.6 END + CASE WHEN cell_stable THEN 0 ELSE 0.25 END + 0.3 * (1 - valid_signals / 3)) AS uncertainty,
        CASE WHEN confidence < 0.5 THEN 'confidence_below_gate' WHEN severity IS NULL THEN 'severity_undefined' WHEN NOT has_norm THEN 'no_peer_norm' ELSE 'ok' END AS risk_reason FROM pk),
    rr AS (SELECT *, CASE WHEN risk_reason = 'ok' THEN strength * quality * (1 - uncertainty) END AS risk FROM rk)"""
TO_DEVIATIONS = f"{TO_SCORED}, {PEERS}, {DEVIATIONS}"
TO_RISK = f"{TO_DEVIATIONS}, {RISK}"
_PLAIN = ", ".join([*cleaning.TEXTS, *cleaning.AMOUNTS, *(f"CAST({d} AS VARCHAR) AS {d}" for d in cleaning.DATES), *(f"null_reason__{f}" for f in cleaning.FIELDS)])


# ---- cleaning, validation, description ---------------------------------------------------------------------------------
@query(f"WITH {CLEAN} SELECT record_id, {_PLAIN} FROM clean")
def clean_works(spark, sf_dir):
    return cleaned(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in cleaning.DATES})


@query(f"""WITH {CLEAN}, {CELLS} SELECT field, count(*) FILTER (reason = 'present') AS present, count(*) FILTER (reason = 'missing') AS missing,
    count(*) FILTER (reason = 'placeholder') AS placeholder, count(*) FILTER (reason = 'unparseable') AS unparseable, round(100 * count(*) FILTER (reason <> 'present') / count(*), 6) AS pct_null FROM cells GROUP BY field""")
def missing_report(spark, sf_dir):
    return cleaning.missing_report(cleaned(spark, sf_dir)).withColumn("pct_null", F.round("pct_null", 6))


_ISSUES = f"""same AS (SELECT work_id, count(*) AS k FROM clean WHERE work_id IS NOT NULL GROUP BY work_id),
    found AS (SELECT record_id, CASE reason WHEN 'unparseable' THEN 'type_unparseable:' WHEN 'missing' THEN 'completeness_missing:' ELSE 'completeness_placeholder:' END || field AS issue
        FROM cells WHERE reason <> 'present' AND (field <> 'work_id' OR reason = 'unparseable')
    {" ".join(f"UNION ALL SELECT record_id, 'value_negative:{a}' FROM clean WHERE {a} < 0 UNION ALL SELECT record_id, 'value_non_finite:{a}' FROM clean WHERE isinf({a}) UNION ALL SELECT record_id, 'value_implausible_magnitude:{a}' FROM clean WHERE abs({a}) > 1e15 AND NOT isinf({a})" for a in cleaning.AMOUNTS)}
    UNION ALL SELECT record_id, 'value_unknown_status:status' FROM clean WHERE status NOT IN ('proposed', 'approved', 'completed')
    {" ".join(f"UNION ALL SELECT record_id, 'logical_date_order:{a}>{b}' FROM clean WHERE {a} > {b}" for a, b in zip(cleaning.DATES, cleaning.DATES[1:]))}
    {" ".join(f"UNION ALL SELECT record_id, 'logical_date_before_scheme_start:{d}' FROM clean WHERE {d} < DATE '1993-01-01' UNION ALL SELECT record_id, 'logical_date_in_future:{d}' FROM clean WHERE {d} > DATE '2024-12-31'" for d in cleaning.DATES)}
    UNION ALL SELECT record_id, 'schema_missing_key:work_id' FROM clean WHERE work_id IS NULL
    UNION ALL SELECT record_id, 'schema_duplicate_key:work_id' FROM clean JOIN same USING (work_id) WHERE k > 1)"""


@query(f"WITH {CLEAN}, {CELLS}, {_ISSUES} SELECT record_id, issue FROM found")
def validation_issues(spark, sf_dir):
    return cleaning.issues(cleaned(spark, sf_dir)).select("record_id", F.explode("issues").alias("issue"))


@query(f"""WITH {CLEAN}, {CELLS}, {_ISSUES}, bad AS (SELECT DISTINCT record_id FROM found WHERE string_split(issue, ':')[1] IN ({", ".join(f"'{e}'" for e in cleaning.ERRORS)}))
    SELECT count(*) AS records, count(bad.record_id) AS invalid, count(*) - count(bad.record_id) AS valid FROM clean LEFT JOIN bad USING (record_id)""")
def validation_report(spark, sf_dir):
    checked = cleaning.issues(cleaned(spark, sf_dir))
    return checked.agg(F.count("*").alias("records"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if("is_valid").alias("valid"))


@query(f"WITH {CLEAN}, {CELLS}, {_ISSUES} SELECT string_split(issue, ':')[1] AS code, count(*) AS n FROM found GROUP BY 1 ORDER BY n DESC, code LIMIT 10")
def issue_top10(spark, sf_dir):
    return cleaning.top_issues(cleaning.issues(cleaned(spark, sf_dir)))


@query(f"""WITH {CLEAN}, l AS (SELECT 'sanction_amount' AS field, sanction_amount AS x FROM clean UNION ALL SELECT 'amount_spent', amount_spent FROM clean)
    SELECT field, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS p25, median(x) AS median, quantile_cont(x, 0.75) AS p75
    FROM l WHERE NOT isinf(x) GROUP BY field""")
def describe_amounts(spark, sf_dir):
    return cleaning.describe_amounts(cleaned(spark, sf_dir))


@query(f"WITH {CLEAN}, s AS (SELECT work_id, count(*) AS copies FROM clean WHERE work_id IS NOT NULL GROUP BY work_id HAVING count(*) > 1) SELECT record_id, work_id, copies FROM clean JOIN s USING (work_id)")
def duplicate_keys(spark, sf_dir):
    return cleaning.duplicated_keys(cleaned(spark, sf_dir))


@query(f"""WITH {CLEAN} SELECT * FROM (SELECT district, row_number() OVER (PARTITION BY district ORDER BY sanction_amount DESC, record_id) AS place, record_id, sanction_amount FROM clean
    WHERE district IS NOT NULL AND sanction_amount IS NOT NULL) WHERE place <= 5""")
def district_top5(spark, sf_dir):
    return cleaning.status_window(cleaned(spark, sf_dir))


# ---- confidence --------------------------------------------------------------------------------------------------------
@query(f"WITH {CLEAN}, {CELLS}, {ENTROPY} SELECT field, round(coverage, 9) AS coverage, n_distinct, round(h_null, 9) AS h_null, round(h_value, 9) AS h_value FROM entropy")
def field_entropy(spark, sf_dir):
    return confidence.field_entropy(materialize(cleaned(spark, sf_dir), "cleaned")).select("field", F.round("coverage", 9).alias("coverage"), "n_distinct", F.round("h_null", 9).alias("h_null"), F.round("h_value", 9).alias("h_value"))


@query(f"""{TO_SCORED} SELECT record_id, round(completeness, 7) AS completeness, round(temporal, 7) AS temporal, round(reconciliation, 7) AS reconciliation, branch AS reconciliation_branch, lifecycle_state,
    round(confidence, 7) AS confidence FROM scored""")
def confidence_scores(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("record_id", *[F.round(c, 7).alias(c) for c in ("completeness", "temporal", "reconciliation")], "reconciliation_branch", "lifecycle_state", F.round("confidence", 7).alias("confidence"))


@query(f"""{TO_SCORED} SELECT CASE WHEN confidence <= 0 THEN 'none' WHEN confidence < 0.2 THEN 'low' WHEN confidence <= 0.8 THEN 'moderate' ELSE 'high' END AS verdict, count(*) AS n,
    round(avg(confidence), 7) AS mean_confidence FROM scored GROUP BY 1""")
def confidence_report(spark, sf_dir):
    return confidence.report(scored(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 7))


@query(f"{TO_SCORED} SELECT least(floor(round(confidence, 9) * 10), 9)::INT AS bin, count(*) AS n FROM scored GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return confidence.histogram(scored(spark, sf_dir).withColumn("confidence", F.round("confidence", 9)))


# ---- peers, anomalies, risk --------------------------------------------------------------------------------------------
@query(f"{TO_SCORED}, {PEERS} SELECT kind, stratum, count(*) AS n, count(*) FILTER (cell_stable) AS stable, count(*) FILTER (is_reference) AS reference FROM st GROUP BY ALL")
def peer_cells(spark, sf_dir):
    return structured(spark, sf_dir).groupBy("kind", "stratum").agg(F.count("*").alias("n"), F.count_if("cell_stable").alias("stable"), F.count_if("is_reference").alias("reference"))


@query(f"{TO_SCORED}, {PEERS} SELECT kind, stratum, feature, n, round(median, 6) AS median, round(mad, 6) AS mad FROM cn")
def peer_norms(spark, sf_dir):
    n = peers.norms(structured(spark, sf_dir), ["kind", "stratum"], ["sanction_amount", "spend_ratio", "duration_days"], F.col("is_reference") & F.col("cell_stable"))
    return n.select("kind", "stratum", "feature", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query(f"{TO_DEVIATIONS} SELECT record_id, {', '.join(f'round({z}, 5) AS {z}, {z}_reason' for z, *_ in _SPECS)}, has_norm FROM dv")
def deviations(spark, sf_dir):
    d = peers.deviations(structured(spark, sf_dir))
    return d.select("record_id", *[x for z, *_ in _SPECS for x in (F.round(z, 5).alias(z), f"{z}_reason")], "has_norm")


@query(f"""{TO_DEVIATIONS} SELECT CASE WHEN z_kind_cost IS NULL THEN 'undefined' WHEN abs(z_kind_cost) >= 20 THEN 'extreme' WHEN abs(z_kind_cost) >= 5 THEN 'high' ELSE 'normal' END AS bucket, count(*) AS n FROM dv GROUP BY 1""")
def deviation_buckets(spark, sf_dir):
    return peers.deviations(structured(spark, sf_dir)).groupBy(peers.bucket(F.col("z_kind_cost")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""{TO_RISK} SELECT record_id, round(severity, 6) AS severity, round(strength, 6) AS strength, round(quality, 6) AS quality, round(uncertainty, 6) AS uncertainty, round(risk, 6) AS risk, risk_reason,
    array_to_string(anomaly_types, ',') AS anomaly_types FROM rr""")
def risk(spark, sf_dir):
    r = risky(spark, sf_dir)
    return r.select("record_id", *[F.round(c, 6).alias(c) for c in ("severity", "strength", "quality", "uncertainty", "risk")], "risk_reason", F.array_join("anomaly_types", ",").alias("anomaly_types"))


@query(f"{TO_RISK}, x AS (SELECT record_id, round(risk, 6) AS risk FROM rr WHERE risk IS NOT NULL) SELECT record_id, round((rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2) * 100 / count(*) OVER (), 6) AS percentile FROM x")
def risk_percentile(spark, sf_dir):
    r = risky(spark, sf_dir).select("record_id", F.round("risk", 6).alias("risk")).filter("risk IS NOT NULL")
    return anomaly.percentile_rank(materialize(r, "risk"), "risk").select("record_id", F.round("percentile", 6).alias("percentile"))


@query(f"""{TO_SCORED}, {PEERS}, a AS (SELECT stratum, count(*) / (SELECT count(*) FROM st WHERE status = 'completed') AS p FROM st WHERE status = 'completed' GROUP BY 1),
    b AS (SELECT stratum, count(*) / (SELECT count(*) FROM st WHERE status = 'approved') AS q FROM st WHERE status = 'approved' GROUP BY 1)
    SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 7) AS drift FROM a FULL JOIN b USING (stratum)""")
def strata_drift(spark, sf_dir):
    s = structured(spark, sf_dir)
    return peers.total_variation(s.filter("status = 'completed'"), s.filter("status = 'approved'"), "stratum").select(F.round("drift", 7).alias("drift"))


# ---- text and duplicates -----------------------------------------------------------------------------------------------
_TERMS = """tt AS (SELECT DISTINCT ktext AS t FROM k0 WHERE ktext <> ''), ww AS (SELECT t, string_split(t, ' ') AS w FROM tt),
    gr AS (SELECT t, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ww),
    tf AS (SELECT t, term, 1 + ln(count(*)) AS tf FROM gr GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT t, term, tf * (ln((1 + (SELECT count(*) FROM tt)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
    vec AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS weight FROM raw)"""


def _texts(spark, sf_dir):
    return materialize(cleaned(spark, sf_dir).select("record_id", "district", "status", text.work_text(F.col("work_name"), delimiters=peers.PLACES, extra=peers.ACTIONS).alias("text"), "date_approval"), "texts")


@query(rf"WITH {CLEAN}, k0 AS (SELECT *, {_KIND_TEXT} AS ktext FROM clean), {_TERMS} SELECT t AS text, term, round(weight, 7) AS weight FROM vec")
def tfidf(spark, sf_dir):
    return duplicates.tfidf(_texts(spark, sf_dir), "text").withColumn("weight", F.round("weight", 7))


@query(rf"""WITH {CLEAN}, k0 AS (SELECT *, {_KIND_TEXT} AS ktext FROM clean), words AS (SELECT status, unnest(string_split(ktext, ' ')) AS word FROM k0 WHERE ktext <> ''),
    v AS (SELECT DISTINCT word FROM words WHERE status = 'completed'), c AS (SELECT word, count(*) AS c FROM words GROUP BY word)
    SELECT round(count(*) FILTER (v.word IS NULL) / count(*), 7) AS unseen_distinct, round(coalesce(sum(c) FILTER (v.word IS NULL), 0) / sum(c), 7) AS unseen_weighted FROM c LEFT JOIN v USING (word)""")
def vocabulary_drift(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    vocabulary = texts.filter("status = 'completed'").select(F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))
    return duplicates.drift(texts, vocabulary, "text").select(*[F.round(c, 7).alias(c) for c in ("unseen_distinct", "unseen_weighted")])


_STOP_FULL = ", ".join(f"'{x}'" for x in (*text.BOILERPLATE, *text.LOCALITY, ""))
_FULL_TEXT = f"array_to_string(list_filter(string_split(regexp_replace(coalesce(work_name, ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t NOT IN ({_STOP_FULL})), ' ')"


@query(f"""WITH {CLEAN}, k0 AS (SELECT record_id, district, date_approval AS day, {_FULL_TEXT} AS ktext FROM clean), {_TERMS},
    x AS (SELECT record_id, district, day, term, weight FROM k0 JOIN vec ON ktext = t WHERE district IS NOT NULL AND day IS NOT NULL),
    p AS (SELECT a.record_id AS a, b.record_id AS b, sum(a.weight * b.weight) AS c, any_value(abs(a.day - b.day)) AS days FROM x a JOIN x b ON a.district = b.district AND a.term = b.term AND a.record_id < b.record_id GROUP BY 1, 2)
    SELECT a, b, round(c, 6) AS cosine, round(c * exp(-days / 180), 6) AS score FROM p WHERE c * exp(-days / 180) >= 0.85""")
def duplicate_scores(spark, sf_dir):
    return _duplicate_scores(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("cosine", "score")})


def _duplicate_scores(spark, sf_dir):
    rows = cleaned(spark, sf_dir).select("record_id", "district", text.work_text(F.col("work_name"), keep_digits=True, delimiters=()).alias("text"), "date_approval")
    return duplicates.block_scores(materialize(rows, "texts"), ["district"], "text", "date_approval")


_DEV, _LAT = r"length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g'))", r"length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query(rf"""SELECT CASE WHEN d + a = 0 OR text IS NULL THEN 'none' WHEN d / (d + a) BETWEEN 0.1 AND 0.9 THEN 'mixed' WHEN d / (d + a) > 0.9 THEN 'devanagari' ELSE 'latin' END AS script, count(*) AS n
    FROM (SELECT text, {_DEV} AS d, {_LAT} AS a FROM documents) GROUP BY 1""")
def script_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents", "text").groupBy(text.script_profile(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


# ---- matching and entities ---------------------------------------------------------------------------------------------
_KEY = lambda c: rf"trim(regexp_replace(regexp_replace(replace(upper({c}), '&', ' AND '), '[^A-Z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_NOTHING = ", ".join(f"'{k}'" for k in text.KEY_NOTHING)
_ID = lambda c: f"CASE WHEN {_KEY(c)} NOT IN ({_NOTHING}) THEN {_KEY(c)} END"
_NAME = lambda c: f"CASE WHEN {_KEY(c)} NOT IN ({_NOTHING}) AND length({_KEY(c)}) >= 3 THEN {_KEY(c)} END"
_YEAR = r"CASE WHEN regexp_extract(financial_year, '(^|[^0-9])((19|20)[0-9]{2})', 2) <> '' THEN regexp_extract(financial_year, '(^|[^0-9])((19|20)[0-9]{2})', 2)::INT WHEN regexp_extract(financial_year, '^[^0-9]*([0-9]{2})[^0-9]', 1) <> '' THEN regexp_extract(financial_year, '^[^0-9]*([0-9]{2})[^0-9]', 1)::INT + 2000 END"
MATCH = rf"""rec AS (SELECT record_id, {_ID("work_id")} AS w, {_NAME("district")} AS d, year(date_approval - INTERVAL 3 MONTH)::VARCHAR AS y, {_NAME("vendor_name")} AS v FROM clean),
    fnd AS (SELECT audit_id, {_ID("work_id")} AS w, {_NAME("district")} AS d, ({_YEAR})::VARCHAR AS y FROM audit_findings),
    kr AS (SELECT record_id, 'WORK_ID' AS method, w AS key FROM rec WHERE w IS NOT NULL UNION ALL SELECT record_id, 'DISTRICT_YEAR', d || '|' || y FROM rec WHERE d IS NOT NULL AND y IS NOT NULL),
    kf AS (SELECT audit_id, 'WORK_ID' AS method, w AS key FROM fnd WHERE w IS NOT NULL UNION ALL SELECT audit_id, 'DISTRICT_YEAR', d || '|' || y FROM fnd WHERE d IS NOT NULL AND y IS NOT NULL)"""


def _match_sides(spark, sf_dir):
    year = F.year(F.add_months("date_approval", -3)).cast("string")
    records = cleaned(spark, sf_dir).select("record_id", "work_id", "district", year.alias("financial_year"))
    findings = table(spark, sf_dir, "audit_findings").select("audit_id", "work_id", "district", matching.start_year(F.col("financial_year")).cast("string").alias("financial_year"))
    return records, findings


@query(f"WITH {CLEAN}, {MATCH} SELECT record_id, audit_id, max(method) AS match_method, arg_max(key, method) AS match_key FROM kr JOIN kf USING (method, key) GROUP BY 1, 2")
def match_blocked(spark, sf_dir):
    return matching.match_blocked(*_match_sides(spark, sf_dir))


@query(f"""WITH {CLEAN}, {MATCH}, a AS (SELECT method, key, count(*) AS a FROM kr GROUP BY ALL), b AS (SELECT method, key, count(*) AS b FROM kf GROUP BY ALL)
    SELECT method, sum(a * b)::BIGINT AS pairs, count(*) AS keys FROM a JOIN b USING (method, key) GROUP BY method""")
def match_counts(spark, sf_dir):
    return matching.match_counts(*_match_sides(spark, sf_dir))


@query(rf"""WITH {CLEAN}, r AS (SELECT record_id, {_NAME("state")} AS s, {_NAME("district")} AS d, year(date_approval - INTERVAL 3 MONTH) AS y FROM clean),
    f AS (SELECT {_NAME("state")} AS s, {_NAME("district")} AS d, {_YEAR} AS y FROM audit_findings)
    SELECT record_id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.s = r.s AND f.d = r.d AND f.y = r.y) THEN 'exact' WHEN EXISTS (SELECT 1 FROM f WHERE f.s = r.s AND f.d = r.d) THEN 'partial'
        WHEN EXISTS (SELECT 1 FROM f WHERE f.s = r.s AND f.d IS NULL) THEN 'loose' WHEN EXISTS (SELECT 1 FROM f WHERE f.s = r.s) THEN 'covered' ELSE 'none' END AS label FROM r""")
def weak_labels(spark, sf_dir):
    records = cleaned(spark, sf_dir).select("record_id", "state", "district", F.year(F.add_months("date_approval", -3)).alias("year"))
    return matching.weak_labels(records, table(spark, sf_dir, "audit_findings"))


_SUFFIX, _PREFIX, _NOBODY = "|".join(sorted(text.VENDOR_SUFFIXES, key=len, reverse=True)), "|".join(text.VENDOR_PREFIXES), ", ".join(f"'{x}'" for x in text.VENDOR_NOBODY)
_V0 = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(vendor_name)), '\s*&\s*', ' and ', 'g'), '\bpvt\b', ' private ', 'g'), '\bltd\b', ' limited ', 'g'), '[^a-z0-9ऀ-ॿ ]+', ' ', 'g'), '\s+', ' ', 'g'))"


_V1 = rf"""trim(regexp_replace(replace(replace(replace(regexp_replace(' ' || replace({_V0}, ' ', '  ') || ' ', ' ([a-z]) ', '<\1>', 'g'), '><', ''), '<', ' '), '>', ' '), '\s+', ' ', 'g'))"""
_V2 = rf"trim(regexp_replace(regexp_replace({_V1}, '^(?:(?:{_PREFIX})(?: |$))+', ''), '(?:(?:^| )(?:{_SUFFIX}))+$', ''))"


@query(f"""WITH v AS (SELECT record_id, {_V2} AS k FROM synthetic_dataset), n AS (SELECT record_id, CASE WHEN k NOT IN ({_NOBODY}) AND length(k) >= 3 THEN k END AS k FROM v),
    f AS (SELECT k, min(record_id) AS first, count(*) AS size FROM n WHERE k IS NOT NULL GROUP BY k)
    SELECT record_id, k AS vendor_normalised, CASE WHEN first IS NOT NULL THEN 'VE-' || lpad(first::VARCHAR, 9, '0') ELSE 'VE-UNRESOLVED-' || lpad(record_id::VARCHAR, 9, '0') END AS vendor_entity,
    coalesce(size, 1) AS group_size FROM n LEFT JOIN f USING (k)""")
def vendor_entities(spark, sf_dir):
    return matching.vendor_entities(works(spark, sf_dir))


@query(f"""WITH {CLEAN}, e AS (SELECT district AS source, implementing_agency AS target, count(*) AS records FROM clean WHERE district IS NOT NULL AND implementing_agency IS NOT NULL GROUP BY ALL)
    SELECT source, target, records, count(*) OVER (PARTITION BY source) AS degree FROM e""")
def entity_graph(spark, sf_dir):
    return matching.entity_graph(cleaned(spark, sf_dir).select("district", "implementing_agency"), "district", "implementing_agency")


# ---- screens and rankings ----------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT concat_ws('|', coalesce(buyer_id, 'None'), coalesce(tender_publications_firstcallfortenderdate, 'None'), coalesce(main_cpv_4, 'None')) AS tender, CASE WHEN bid_price > 0 THEN bid_price END AS p FROM bids),
    o AS (SELECT tender, p, row_number() OVER (PARTITION BY tender ORDER BY p) AS r FROM t WHERE p IS NOT NULL),
    a AS (SELECT tender, count(*) AS bids, count(p) AS n, avg(p) AS mean, stddev_samp(p) AS std, max(p) AS high, skewness(p) AS skew, kurtosis(p) AS kurt FROM t GROUP BY tender),
    b AS (SELECT tender, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2, stddev_samp(p) FILTER (r > 1) AS loser FROM o GROUP BY tender)
    SELECT tender, bids, n, round(mean, 4) AS mean, round(std, 4) AS std, p1, p2, round(CASE WHEN n > 2 AND std > 0 THEN skew END, 5) AS skew, round(CASE WHEN n > 3 AND std > 0 THEN kurt END, 5) AS kurt,
        round(std / nullif(mean, 0), 6) AS cv, round((p2 - p1) / nullif(p1, 0), 6) AS diffp, round((p2 - p1) / nullif(std, 0), 6) AS rd, round((high - p1) / nullif(mean, 0), 6) AS range_ratio
    FROM a LEFT JOIN b USING (tender)""")
def bid_screens(spark, sf_dir):
    s = screens.tender_screens(table(spark, sf_dir, "bids"))
    rounded = {"mean": 4, "std": 4, "skew": 5, "kurt": 5, "cv": 6, "diffp": 6, "rd": 6, "range_ratio": 6}
    return s.select("tender", "bids", "n", "p1", "p2", *[F.round(c, k).alias(c) for c, k in rounded.items()])


@query("SELECT bidder_id, count(*) AS bids, sum(bid_iswinning)::BIGINT AS wins FROM bids WHERE bidder_id IS NOT NULL GROUP BY 1")
def bidder_activity(spark, sf_dir):
    return screens.activity(table(spark, sf_dir, "bids"), "bidder_id")


@query(f"""WITH {CLEAN}, e AS (SELECT district, vendor_name, sum(amount_spent) AS a FROM clean WHERE amount_spent > 0 GROUP BY ALL)
    SELECT district, count(*) AS actors, round(sum(a * a) / (sum(a) * sum(a)), 7) AS hhi FROM e GROUP BY district""")
def vendor_concentration(spark, sf_dir):
    return screens.concentration(cleaned(spark, sf_dir), ["district"], "vendor_name", "amount_spent").withColumn("hhi", F.round("hhi", 7))


@query(f"""WITH {CLEAN}, m AS (SELECT district, strftime(date_approval, '%Y-%m') AS month, count(*) AS n FROM clean WHERE district IS NOT NULL AND date_approval IS NOT NULL GROUP BY ALL)
    SELECT district, month, n, round(ln((n + 1) / (avg(n) OVER (PARTITION BY district) + 1)), 7) AS burst FROM m""")
def approval_bursts(spark, sf_dir):
    return screens.bursts(cleaned(spark, sf_dir), "district", "date_approval").withColumn("burst", F.round("burst", 7))


@query("""WITH x AS (SELECT score, (verdict = 'same')::INT AS y FROM work_matches WHERE score IS NOT NULL AND verdict IS NOT NULL),
    r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM x)
    SELECT sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 7) AS auc FROM r""")
def match_auc(spark, sf_dir):
    m = table(spark, sf_dir, "work_matches").select("score", (F.col("verdict") == "same").alias("y"))
    return anomaly.auc(m, "score", "y").withColumn("auc", F.round("auc", 7))


@query(f"""WITH {CLEAN}, x AS (SELECT sanction_amount AS a, amount_spent AS b FROM clean WHERE sanction_amount IS NOT NULL AND amount_spent IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x)
    SELECT count(*) AS n, round(corr(ra, rb), 7) AS rho FROM r""")
def amount_rank_correlation(spark, sf_dir):
    return anomaly.spearman(cleaned(spark, sf_dir), "sanction_amount", "amount_spent").withColumn("rho", F.round("rho", 7))


@query(f"""WITH {CLEAN}, x AS (SELECT record_id, CASE WHEN sanction_amount IS NOT NULL THEN (rank() OVER (PARTITION BY sanction_amount IS NULL ORDER BY sanction_amount) + (count(*) OVER (PARTITION BY sanction_amount) - 1) / 2) * 100
        / count(*) OVER (PARTITION BY sanction_amount IS NULL) END AS a, CASE WHEN amount_spent IS NOT NULL THEN (rank() OVER (PARTITION BY amount_spent IS NULL ORDER BY amount_spent)
        + (count(*) OVER (PARTITION BY amount_spent) - 1) / 2) * 100 / count(*) OVER (PARTITION BY amount_spent IS NULL) END AS b FROM clean)
    SELECT record_id, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) AS score FROM x""")
def rank_aggregated(spark, sf_dir):
    return screens.rank_aggregate(materialize(cleaned(spark, sf_dir).select("record_id", "sanction_amount", "amount_spent"), "amounts"), ["sanction_amount", "amount_spent"]).withColumn("score", F.round("score", 6))


@query(f"""WITH {CLEAN} SELECT CASE WHEN date_approval IS NULL THEN 'UNKNOWN' ELSE year(date_approval - INTERVAL 3 MONTH)::VARCHAR || '-' || (year(date_approval - INTERVAL 3 MONTH) + 1)::VARCHAR END AS fiscal_year,
    count(*) AS n, round(avg(date_completion - date_approval), 6) AS mean_lag FROM clean GROUP BY 1""")
def fiscal_years(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.groupBy(dates.fiscal_year(F.col("date_approval")).alias("fiscal_year")).agg(F.count("*").alias("n"), F.round(F.avg(dates.lag_days(F.col("date_approval"), F.col("date_completion"))), 6).alias("mean_lag"))


@query("""SELECT audit_id, sha256('{"payload":{"district":' || coalesce(to_json(district)::VARCHAR, 'null') || ',"severity":' || coalesce(to_json(severity)::VARCHAR, 'null') || '},"record_id":' || to_json(audit_id)::VARCHAR || '}') AS input_hash FROM audit_findings WHERE audit_id IS NOT NULL""")
def audit_hashes(spark, sf_dir):
    f = table(spark, sf_dir, "audit_findings", "audit_id", "district", "severity").filter("audit_id IS NOT NULL")
    payload = F.to_json(F.struct(F.struct("district", "severity").alias("payload"), F.col("audit_id").alias("record_id")), {"ignoreNullFields": "false"})
    return f.select("audit_id", F.sha2(payload, 256).alias("input_hash"))


@query("""SELECT audit_id, district, severity FROM audit_findings WHERE audit_id IS NOT NULL""")
def audit_payloads(spark, sf_dir):
    """The payloads written as canonical JSON and read again; a severity outside the vocabulary is an error."""
    f = table(spark, sf_dir, "audit_findings", "audit_id", "district", "severity").filter("audit_id IS NOT NULL")
    return reports.read_payloads(f.select("audit_id", F.to_json(F.struct("district", "severity"), {"ignoreNullFields": "false"}).alias("payload")), "payload", "district string, severity string", {"severity": ("HIGH", "MEDIUM", "LOW", "UNKNOWN")})


# ---- entities, reports, windows ----------------------------------------------------------------------------------------
@query()
def work_entities(spark, sf_dir):
    out = entities.work_entities(cleaned(spark, sf_dir))
    return out.select("record_id", "work_entity", "group_size", "confidence", "consistency", F.array_join("matched", ",").alias("matched"), F.array_join("conflicting", ",").alias("conflicting"))


@query()
def fuzzy_firms(spark, sf_dir):
    return entities.fuzzy_firms(materialize(matching.vendor_entities(works(spark, sf_dir)), "firms"))


@query(rf"""WITH RECURSIVE {CLEAN}, k0 AS (SELECT record_id, district, date_approval AS day, {_FULL_TEXT} AS ktext FROM clean), {_TERMS},
    x AS (SELECT record_id, district, day, term, weight FROM k0 JOIN vec ON ktext = t WHERE district IS NOT NULL AND day IS NOT NULL),
    p AS (SELECT a.record_id AS a, b.record_id AS b, sum(a.weight * b.weight) AS c, any_value(abs(a.day - b.day)) AS days FROM x a JOIN x b ON a.district = b.district AND a.term = b.term AND a.record_id < b.record_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM p WHERE c * exp(-days / 180) >= 0.85), s AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
    r(x, y) AS (SELECT u, least(u, v) FROM s UNION SELECT s.v, r.y FROM r JOIN s ON s.u = r.x WHERE r.y < s.v)
    SELECT x AS node, min(y) AS head FROM r GROUP BY x""")
def duplicate_groups(spark, sf_dir):
    return groups.components(_duplicate_scores(spark, sf_dir))


_IS = lambda table: "CASE " + " ".join(f"WHEN regexp_matches(p, '{v}') THEN '{k}'" for k, v in table.items()) + " END"
_RS = r"(?i)(?:₹|inr|rs\.?)\s*(\d[\d,]*(?:\.\d+)?)"
_UNIT = rf"lower(regexp_extract(p, '{_RS}(?:\s*(crore|cr|lakh|lac|million|thousand)s?\b)?', 2))"
_MONEY = f"try_cast(replace(regexp_extract(p, '{_RS}', 1), ',', '') AS DOUBLE)"


@query(rf"""WITH d AS (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS ps FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS n FROM d),
    x AS (SELECT doc_id, n, p, {_IS(reports.ISSUES)} AS issue, {_IS(reports.SEVERITIES)} AS severity, {_UNIT} AS unit, {_MONEY} AS money FROM q WHERE length(p) >= 40)
    SELECT doc_id, n::INT AS n, issue, severity, CASE WHEN unit IN ('crore', 'cr') THEN money * 1e7 WHEN unit IN ('lakh', 'lac') THEN money * 1e5 WHEN unit = 'million' THEN money * 1e6 WHEN unit = 'thousand' THEN money * 1e3
        WHEN money >= 1000 THEN money END AS amount, coalesce(try_cast(regexp_extract(p, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})[-/][0-9]{{2}}', 1) AS INT), try_cast(regexp_extract(p, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) AS INT)) AS year
    FROM x WHERE issue IS NOT NULL""")
def audit_paragraphs(spark, sf_dir):
    return reports.paragraphs(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("""SELECT work_id, max((severity = 'HIGH')::INT) AS "HIGH", max((severity = 'MEDIUM')::INT) AS "MEDIUM", max((severity = 'LOW')::INT) AS "LOW" FROM audit_findings WHERE work_id IS NOT NULL GROUP BY work_id""")
def findings_multi_hot(spark, sf_dir):
    return reports.multi_hot(table(spark, sf_dir, "audit_findings", "work_id", "severity"), "work_id", "severity", ("HIGH", "MEDIUM", "LOW"))


_LEX = ("work_name", "district", "state", "implementing_agency", "vendor_name", "status", "date_approval")


@query(rf"""WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS field, lower(trim({c})) AS token FROM synthetic_dataset" for c in _LEX)})
    SELECT token, count(DISTINCT field) AS fields, count(*) AS n FROM c WHERE length(token) <= 14 AND (NOT regexp_matches(token, '[0-9]')
        OR (regexp_full_match(token, '[0\W_]+') AND NOT regexp_full_match(replace(replace(token, ',', ''), ' ', ''), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)'))) GROUP BY token HAVING count(DISTINCT field) >= 2 AND count(*) >= 10""")
def nullish_lexicon(spark, sf_dir):
    return reports.nullish_lexicon(works(spark, sf_dir), _LEX)


@query(f"""WITH {CLEAN} SELECT coalesce(vendor_name, 'MISSING') AS value, (row_number() OVER (ORDER BY count(*) DESC, coalesce(vendor_name, 'MISSING')) - 1)::INT AS index, count(*) AS n FROM clean GROUP BY 1 HAVING count(*) >= 20""")
def frequent_vendors(spark, sf_dir):
    return reports.frequent(cleaned(spark, sf_dir), "vendor_name")


@query(f"""WITH {CLEAN} SELECT work_id, count(*) AS n, count(DISTINCT district) AS districts, count(DISTINCT status) AS statuses, count(DISTINCT district) > 1 OR count(DISTINCT status) > 1 AS conflict
    FROM clean WHERE work_id IS NOT NULL GROUP BY work_id HAVING count(*) > 1""")
def work_context(spark, sf_dir):
    return reports.work_context(cleaned(spark, sf_dir))


@query("""SELECT verdict, count(*) AS n, round((h / n0 + 1.96 * 1.96 / (2 * n0) - 1.96 * sqrt(h / n0 * (1 - h / n0) / n0 + 1.96 * 1.96 / (4 * n0 * n0))) / (1 + 1.96 * 1.96 / n0), 7) AS low
    FROM (SELECT verdict, count(*) AS n0, count(score)::DOUBLE AS h FROM work_matches GROUP BY verdict) JOIN work_matches USING (verdict) GROUP BY verdict, n0, h""")
def score_coverage(spark, sf_dir):
    m = table(spark, sf_dir, "work_matches", "verdict", "score").filter("verdict IS NOT NULL").groupBy("verdict").agg(F.count("*").alias("n"), F.count("score").alias("h"))
    return m.select("verdict", "n", F.round(reports.wilson(F.col("h"), F.col("n"))[0], 7).alias("low"))


@query(f"""WITH {CLEAN}, a AS (SELECT record_id FROM clean WHERE sanction_amount IS NOT NULL ORDER BY sanction_amount DESC, record_id LIMIT 100), b AS (SELECT record_id FROM clean WHERE amount_spent IS NOT NULL
    ORDER BY amount_spent DESC, record_id LIMIT 100) SELECT count(*) / 100 AS overlap FROM a JOIN b USING (record_id)""")
def ranking_overlap(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    pick = lambda f: c.select("record_id", F.col(f).alias("s"))
    return reports.overlap(pick("sanction_amount"), pick("amount_spent"), "record_id", "s", 100)


@query(f"""WITH {CLEAN}, x AS (SELECT record_id, amount_spent FROM clean WHERE amount_spent IS NOT NULL), e AS (SELECT quantile_cont(amount_spent, [0.2, 0.4, 0.6, 0.8]) AS q FROM x)
    SELECT len(list_filter(q, lambda v: v <= amount_spent)) AS band, count(*) AS n FROM x, e GROUP BY 1""")
def spending_bands(spark, sf_dir):
    c = cleaned(spark, sf_dir).select("amount_spent").filter("amount_spent IS NOT NULL")
    edges = exact_quantiles(c, [], "amount_spent", [0.2, 0.4, 0.6, 0.8]).select(F.array("q0", "q1", "q2", "q3").alias("q"))
    banded = c.crossJoin(F.broadcast(edges)).select(F.size(F.filter("q", lambda v: v <= F.col("amount_spent"))).alias("band"))  # edges is one row
    return banded.groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windows.counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events")).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))
