import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions import dates, text
from tallymark.operators import anomaly, cleaning, confidence, duplicates, matching, quantile, screens
from tests.conftest import rows

BASE = {
    "record_id": 1, "work_id": "MPL-KA-2019-000001", "work_name": "Construction of CC Road at Ward No. 7, Mysuru", "district": "Mysuru", "state": "Karnataka", "sanction_amount": "850000.0",
    "amount_spent": "812345.50", "date_proposal": "2019-03-01", "date_approval": "2019-05-20", "date_completion": "2020-01-15", "implementing_agency": "Mysuru Zilla Parishad", "vendor_name": "Iyer Constructions", "status": "completed",
}


def works(spark, *overrides):
    schema = ", ".join(f"{k} {'long' if k == 'record_id' else 'string'}" for k in BASE)
    return spark.createDataFrame([tuple((BASE | {"record_id": i, "work_id": f"W-{i}"} | o).values()) for i, o in enumerate(overrides)], schema)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "value, want",
    [("5/3/2020", dt.date(2020, 3, 5)), ("mar 5, 2020", dt.date(2020, 3, 5)), ("2020-1-5", dt.date(2020, 1, 5)), ("2020-03-05T10:00:00Z", dt.date(2020, 3, 5)), ("20200305", dt.date(2020, 3, 5)),
     ("20200-01-01", None), ("2020-02-30", None), ("2020-05-10 25:61", None), ("1.2.2020", dt.date(2020, 2, 1)), ("5 Marzo 2020", None), ("", None), (None, None)],
)
def test_parse_date(spark, value, want):
    assert one(spark, value, dates.parse_date) == want


@pytest.mark.parametrize("value, want", [("Rs 1,25,000.50", 125000.5), ("₹850000.00", 850000.0), ("1d", None), ("1.2e400", float("inf")), ("-5", -5.0), ("", None), (None, None), ("5 lakh", None)])
def test_number(spark, value, want):
    assert one(spark, value, text.number) == want


@pytest.mark.parametrize("value, want", [("M/s Sharma & Sons Pvt. Ltd.", "sharma"), ("P.W.D. Contractors", "pwd contractors"), ("m/s", None), ("Unknown", None), ("XY", None), (None, None)])
def test_vendor_key(spark, value, want):
    assert one(spark, value, text.vendor_key) == want


def test_keys_scripts_amounts(spark):
    assert one(spark, " Jammu & Kashmir ", text.join_key) == "JAMMU AND KASHMIR" and one(spark, "orissa", text.join_key) == "ODISHA" and one(spark, "--", text.join_key) is None
    assert [one(spark, x, text.script_profile) for x in ("road", "सड़क", "सड़क road", "12", None)] == ["latin", "devanagari", "mixed", "none", "none"]
    assert one(spark, "about Rs 2.5 crore", text.worded_amount) == 2.5e7 and one(spark, "Rs 12", text.worded_amount) is None
    assert one(spark, "1250000.5", lambda x: text.indian_grouping(x.cast("double"))) == "12,50,000.50"
    assert one(spark, "Repair of Tank at Ward 7", text.work_text) == "tank"


def test_every_null_has_its_reason(spark):
    df = works(spark, {}, {"district": "N/A"}, {"district": "  "}, {"district": None}, {"date_approval": "soon"}, {"sanction_amount": "x"}, {"sanction_amount": "nan"}).withColumn("issues", F.lit(1))
    got = {r.record_id: (r.null_reason__district, r.null_reason__date_approval, r.null_reason__sanction_amount) for r in cleaning.clean(df).collect()}
    assert [got[i][0] for i in range(4)] == ["present", "placeholder", "missing", "missing"]
    assert got[4][1] == "unparseable" and got[5][2] == "unparseable" and got[6][2] == "placeholder"
    assert cleaning.clean(df.limit(0)).count() == 0


def test_issues(spark):
    df = works(spark, {}, {"work_id": "W-0"}, {"work_id": None}, {"amount_spent": "-5"}, {"sanction_amount": "1e300"}, {"date_proposal": "2019-06-01"}, {"date_proposal": "1990-01-01"}, {"status": "odd"}, {"date_completion": "2031-01-01"})
    got = {r.record_id: (r.issues, r.is_valid) for r in cleaning.issues(cleaning.clean(df)).collect()}
    assert got[0] == got[1] == (["schema_duplicate_key:work_id"], False)
    assert got[2] == (["schema_missing_key:work_id"], False) and got[8] == (["logical_date_in_future:date_completion"], True)
    assert [got[i][0][0].split(":")[0] for i in (3, 4, 5, 6, 7)] == ["value_negative", "value_implausible_magnitude", "logical_date_order", "logical_date_before_scheme_start", "value_unknown_status"]
    assert len(got) == 9


def test_confidence_components(spark):
    df = works(spark, {}, {"date_proposal": "2019-05-30"}, {"amount_spent": None}, {"sanction_amount": None, "amount_spent": None}, {"sanction_amount": "inf"}, {"sanction_amount": "0"}, {"amount_spent": "1700000"}, {"date_approval": "x"})
    s = {r.record_id: r for r in confidence.score(cleaning.clean(df), dict.fromkeys(cleaning.FIELDS, 1.0)).collect()}
    assert s[0].confidence == pytest.approx(1.0) and s[1].temporal == pytest.approx(np.exp(-0.1))
    assert (s[2].reconciliation, s[3].reconciliation, s[3].reconciliation_defined, s[5].reconciliation) == (0.7, 1.0, False, 0.25)
    assert s[6].reconciliation == pytest.approx(np.exp(-2 * (2 - 1.05)), rel=1e-4) and s[7].temporal == 0 and s[7].confidence == 0
    # "inf" is no number of the register: it is unparseable and counts as absent
    assert s[4].reconciliation_branch == "one_null"


@pytest.mark.parametrize("small", [5000, 10])
def test_exact_quantiles(spark, small, monkeypatch):
    monkeypatch.setattr(quantile, "SMALL", small)
    monkeypatch.setattr(quantile, "MARGIN", 0.2 if small == 10 else quantile.MARGIN)
    x = np.random.default_rng(0).normal(size=400).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), (None, 2.0), ("c", None)], "g string, x double")
    got = {r.g: (r.n, r.q0, r.q1) for r in quantile.exact_quantiles(df, ["g"], "x", [0.5, 0.9]).collect()}
    assert got.keys() == {"a", "b", None} and got["a"][0] == 400
    assert got["a"][1:] == pytest.approx(np.quantile(x, [0.5, 0.9])) and got["b"] == (1, 1.0, 1.0)


def test_ranks_and_auc(spark):
    x = np.random.default_rng(2).integers(0, 40, 300)
    y = (np.random.default_rng(3).random(300) < x / 50).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "x double, y int")
    ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert sorted(r.percentile for r in anomaly.percentile_rank(df, "x").collect() if r.percentile is not None) == pytest.approx(sorted(ranks * 100 / 300))
    want = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (300 - y.sum()))
    assert anomaly.auc(df, "x", "y").first().auc == pytest.approx(want)


def test_blocked_matching_equals_naive(spark):
    rng = np.random.default_rng(4)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    make = lambda i: (i, pick("W1", "W2", "W3", None), pick("Pune", "PUNE ", "Nashik", "UNKNOWN", None), pick("2019-20", "2020-21", None), pick("PMGSY", "Gram Sadak Yojana", None))
    left, right = [make(i) for i in range(60)], [make(i) for i in range(20)]
    schema = "{} long, work_id string, district string, financial_year string, scheme string"
    got = {tuple(r) for r in matching.match_blocked(spark.createDataFrame(left, schema.format("record_id")), spark.createDataFrame(right, schema.format("audit_id"))).collect()}

    def keys(r):
        w, d = r[1], {"PUNE": "PUNE", "NASHIK": "NASHIK"}.get((r[2] or "").strip().upper())
        y, s = r[3] and r[3].replace("-", " "), r[4] and "PMGSY"
        found = [("WORK_ID", (w,)), ("SCHEME_WORK_DISTRICT_YEAR", (s, w, d, y)), ("SCHEME_DISTRICT_YEAR", (s, d, y)), ("DISTRICT_YEAR", (d, y))]
        return [(m, "|".join(k)) for m, k in found if all(k)]

    want = {(a[0], b[0], *next(k for k in keys(a) if k in keys(b))) for a in left for b in right if set(keys(a)) & set(keys(b))}
    assert got == want


def test_blocked_matching_shuffles_no_pairs(spark, monkeypatch):
    # keys split over tasks, repeated ids with equal and with other keys, ids that are null
    schema = "{} long, work_id string, district string, financial_year string"
    left = [(i, f"W{i % 7}", "pune", "2019-20") for i in range(40)]
    right = [(i, f"W{i % 5}" if i % 3 else None, "Pune", "2019-20") for i in range(30)]

    def matched(a, b):
        return matching.match_blocked(spark.createDataFrame(a, schema.format("record_id")), spark.createDataFrame(b, schema.format("audit_id")))

    def want(a, b):
        keys = lambda r: [("WORK_ID", r[1])] * bool(r[1]) + [("DISTRICT_YEAR", f"{r[2].upper()}|2019 20")]
        best = {}
        for x in a:
            for y in b:
                for k in set(keys(x)) & set(keys(y)):
                    best[x[0], y[0]] = max(best.get((x[0], y[0]), k), k)  # WORK_ID is the stronger and sorts last
        return sorted(((*ids, *k) for ids, k in best.items()), key=repr)

    for most in (4_000_000, 50):
        monkeypatch.setattr(matching, "PAIRS", most, raising=False)
        plain = matched(left, right + right[:3])
        assert sorted(map(tuple, plain.collect()), key=repr) == want(left, right)
        assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString()
        a, b = left + [(0, "W3", "pune", "2019-20"), (None, "W1", "pune", "2019-20"), (None, "W2", "pune", "2019-20")], right + [(1, "W6", "pune", "2019-20"), (1, "W0", "nashik", "2019-20"), (None, None, "pune", "2019-20")]
        assert sorted(map(tuple, matched(a, b).collect()), key=repr) == want(a, b)


def test_screens(spark):
    bids = [("b", "d", "c", float(p)) for p in (100, 110, 150, 160)] + [("b", "d", None, 5.0), ("b", "d", "t", 7.0), ("b", "d", "t", 7.0), ("b", "d", "z", None)]
    df = spark.createDataFrame(bids, "buyer_id string, tender_publications_firstcallfortenderdate string, main_cpv_4 string, bid_price double")
    s = {r.tender[-1]: r for r in screens.tender_screens(df).collect()}
    p = np.array([100, 110, 150, 160.0])
    assert s["c"].spd == pytest.approx(10 / p[1:].std(ddof=1)) and s["c"].cv == pytest.approx(p.std(ddof=1) / p.mean()) and s["c"].diffp == pytest.approx(0.1)
    assert (s["t"].p1, s["t"].p2, s["t"].diffp) == (7.0, 7.0, 0.0) and s["e"].p2 is None and s["z"].n == 0


def test_vendor_entities(spark):
    df = spark.createDataFrame([(3, "M/s Sharma Builders Ltd"), (1, "sharma builders"), (2, None), (4, "N/A")], "record_id long, vendor_name string")
    got = {r.record_id: (r.vendor_entity, r.group_size) for r in matching.vendor_entities(df).collect()}
    assert got[1] == got[3] == ("VE-000000001", 2) and got[2][0] == "VE-UNRESOLVED-000000002" and got[4][1] == 1
    assert rows(matching.vendor_entities(df.limit(0))) == []


def test_duplicate_scores_of_words_in_more_than_fifty_records(spark):
    rng = np.random.default_rng(6)
    pool = ["tank", "well", "school", "road", "drain"]
    texts = ["tank near school"] * 60 + [" ".join(rng.permutation(pool)[: rng.integers(1, 6)]) for _ in range(120)] + ["", None]
    data = [(i, "d" if i % 7 else "e", t, dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(0, 90)))) for i, t in enumerate(texts)] + [(990, None, "tank", dt.date(2020, 1, 1)), (991, "d", "tank", None)]
    df = spark.createDataFrame(data, "record_id long, district string, text string, day date")
    v = {}
    for r in duplicates.tfidf(df, "text").collect():
        v.setdefault(r.text, {})[r.term] = r.weight
    want = {}
    for a in data:
        for b in data:
            if a[0] < b[0] and a[1] and a[1] == b[1] and a[2] and b[2] and a[3] and b[3]:
                s = sum(w * v[b[2]].get(t, 0) for t, w in v[a[2]].items()) * np.exp(-abs((a[3] - b[3]).days) / 180)
                if s >= 0.85:
                    want[a[0], b[0]] = s
    got = duplicates.block_scores(df, ["district"], "text", "day").collect()
    assert len(got) == len(want) > 500 and {(r.a, r.b): r.score for r in got} == pytest.approx(want)
