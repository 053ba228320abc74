"""The registered queries of the two general data-quality problems: damaged lines and mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import moments, recover
from tallymark.runtime import PLACEHOLDERS, table

DATE_COLUMNS = ("date_proposal", "date_approval", "date_completion")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover.rejected(recover.read_lines(table(spark, sf_dir, "raw_lines", "line_id", "sep", "raw")))


def p5_good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover.good_rows(recover.read_lines(table(spark, sf_dir, "raw_lines", "line_id", "sep", "raw")))


def p5_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the field it is in and where in the line it was noticed (-1: not in one place)."""
    parsed = recover.read_lines(table(spark, sf_dir, "raw_lines", "line_id", "sep", "raw")).filter("NOT ok AND segment = 0")
    return parsed.select("line_id", F.explode("errors").alias("e")).select("line_id", "e.reason", "e.field", "e.position")


def p5_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch as one text, its lines in order: the records found, those behind a broken quote resumed at anchors."""
    lines = table(spark, sf_dir, "raw_lines", "line_id", "batch_id", "line_no", "sep", "raw")
    return recover.read_texts(lines).groupBy("batch_id").agg(F.count("*").alias("records"), F.count_if("ok").alias("good"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "synthetic_dataset", "record_id", "portal", *DATE_COLUMNS)
    return works.join(table(spark, sf_dir, "portals", "portal", "tz", "date_order"), "portal", "left")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portals' declared orders hold: a reading against one is no moment. Only a portal that declares none is left to choose."""
    return moments.normalise(_dated(spark, sf_dir), DATE_COLUMNS, trusted=True).select("record_id", "field", "utc_us")


def p6_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if no portal had declared its order: each numeric date is read as its source's records in their order suggest.
    The SQL reads by the declared orders: some thousand records are enough for the same rows, a few hundred are not."""
    silent = _dated(spark, sf_dir).withColumn("date_order", F.lit(None).cast("string"))
    return moments.normalise(silent, DATE_COLUMNS).select("record_id", "field", "utc_us")


def p6_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that the inferred readings of each portal follow; it should be the declared one."""
    works = table(spark, sf_dir, "synthetic_dataset", "record_id", "portal")
    silent = _dated(spark, sf_dir).withColumn("date_order", F.lit(None).cast("string"))
    read = moments.normalise(silent, DATE_COLUMNS).filter("order_read IS NOT NULL").join(works, "record_id")
    return read.groupBy("portal").agg(F.mode("order_read", True).alias("date_order"))


QUERIES = {"p5_found": p5_found, "p5_good_rows": p5_good_rows, "p5_located": p5_located, "p5_resumed": p5_resumed, "p6_found": p6_found, "p6_inferred": p6_inferred, "p6_orders": p6_orders}

_PH = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
_SEPS = {",": "','", ";": "';'", "|": "'|'", "\\t": "chr(9)"}


def _by_sep(sql: str) -> str:
    return "CASE sep " + " ".join(f"WHEN {literal} THEN {sql.replace('SEP', s)}" for s, literal in _SEPS.items()) + " END"


_FIELD = '(?:"(?:[^"]|"")*"|[^"SEP][^SEP]*|)'
_FINE = _by_sep(f"regexp_full_match(r, '{_FIELD}(?:[SEP]{_FIELD})*')")
_SPLIT = _by_sep(f"regexp_extract_all(r || sep, '({_FIELD})[SEP]', 1)")
_OF = lambda i: f"trim(CASE WHEN starts_with(f[{i}], '\"') THEN replace(substr(f[{i}], 2, length(f[{i}]) - 2), '\"\"', '\"') ELSE f[{i}] END, ' ' || chr(9) || chr(10) || chr(13))"
_MON = "(jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|september|oct|october|nov|november|dec|december)"
_MNO = lambda x: f"((strpos('janfebmaraprmayjunjulaugsepoctnovdec', left({x}, 3)) + 2) // 3)"


def _no_amount(v: str) -> str:
    mark = r"(rs[.]?|inr|₹)\s*"
    bare = f"replace(regexp_replace(lower({v}), '^{mark}', ''), ',', '')"
    return rf"""lower({v}) NOT IN ({_PH}) AND NOT (regexp_full_match(lower({v}), '({mark})?[+-]?([0-9]+(,[0-9]+)*([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?')
        AND coalesce(try_cast({bare} AS DOUBLE) BETWEEN 0 AND 1.7e308, false))"""


def _no_date(v: str) -> str:
    dn, nd = rf"([0-9]{{1,2}})\s+{_MON}\s+([0-9]{{4}})", rf"{_MON}\s+([0-9]{{1,2}}),\s+([0-9]{{4}})"
    g = lambda p, i: f"regexp_extract(lower({v}), '{p}', {i})"
    last = " ".join(rf"WHEN regexp_full_match({v}, '[0-9]{{1,2}}{x}[0-9]{{1,2}}{x}[0-9]{{4}}') THEN regexp_replace({v}, '([0-9]+){x}([0-9]+){x}([0-9]+)', '\3-\2-\1')" for x in ("-", "/", "[.]"))
    return rf"""lower({v}) NOT IN ({_PH}) AND try_cast(CASE WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {v} {last}
        WHEN regexp_full_match({v}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN replace({v}, '/', '-') WHEN regexp_full_match(lower({v}), '{dn}') THEN {g(dn, 3)} || '-' || {_MNO(g(dn, 2))} || '-' || {g(dn, 1)}
        WHEN regexp_full_match(lower({v}), '{nd}') THEN {g(nd, 3)} || '-' || {_MNO(g(nd, 1))} || '-' || {g(nd, 2)}
        WHEN regexp_full_match({v}, '[0-9]{{8}}') THEN left({v}, 4) || '-' || substr({v}, 5, 2) || '-' || right({v}, 2) END AS DATE) IS NULL"""


ORACLE = {
    "p5_found": rf"""WITH l AS (SELECT line_id, sep, regexp_replace(coalesce(raw, ''), '\r$', '') AS r FROM raw_lines),
        p AS (SELECT line_id, {_FINE} AS fine, {_SPLIT} AS f FROM l), g AS (SELECT * FROM p WHERE fine AND len(f) = 12)
        SELECT line_id, 'quoting' AS reason FROM p WHERE NOT fine UNION ALL SELECT line_id, 'column_count' FROM p WHERE fine AND len(f) <> 12
        UNION ALL SELECT line_id, 'sanction_amount' FROM g WHERE {_no_amount(_OF(5))} UNION ALL SELECT line_id, 'amount_spent' FROM g WHERE {_no_amount(_OF(6))}
        UNION ALL SELECT line_id, 'date_approval' FROM g WHERE {_no_date(_OF(8))}""",
}


def _moments_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT record_id, '{c}' AS field, portal, trim({c}) AS x FROM synthetic_dataset WHERE {c} IS NOT NULL" for c in DATE_COLUMNS)
    g = lambda p, i: f"regexp_extract(v, '{p}', {i})"
    iso, num, named, mon, compact = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(.*)$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(.*)$", r"^(\d{1,2})[\s-]([A-Za-z]+)[\s-](\d{4})(.*)$", r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})(.*)$", r"^(\d{4})(\d{2})(\d{2})(T.*)?$"
    month = lambda p, i: f"CASE WHEN regexp_full_match(lower({g(p, i)}), '{_MON}') THEN {_MNO(f'lower({g(p, i)})')} END"
    part = lambda a, b, c, d, e: f"CASE WHEN regexp_matches(v, '{iso}') THEN {a} WHEN regexp_matches(v, '{num}') THEN {b} WHEN regexp_matches(v, '{named}') THEN {c} WHEN regexp_matches(v, '{mon}') THEN {d} WHEN regexp_matches(v, '{compact}') THEN {e} END"
    # within dates ending in the year the portal's order holds
    day = part(g(iso, 3), f"CASE date_order WHEN 'MDY' THEN {g(num, 2)} ELSE {g(num, 1)} END", g(named, 1), g(mon, 2), g(compact, 3))
    mo = part(g(iso, 2), f"CASE date_order WHEN 'MDY' THEN {g(num, 1)} ELSE {g(num, 2)} END", f"CAST({month(named, 2)} AS VARCHAR)", f"CAST({month(mon, 1)} AS VARCHAR)", g(compact, 2))
    rest = r"^(?:(?:T|,?\s+)(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.](\d{1,6}))?)?(?:\s*([AaPp])[Mm]\b)?)?\s*((?:UTC|GMT)?[+-]\d{1,2}:?(?:\d{2})?|[A-Z]+|[A-Za-z]+/[A-Za-z_]+)?$"
    r = lambda i: f"regexp_extract(w, '{rest}', {i})"
    names = " ".join(f"WHEN '{k.upper()}' THEN {m}" for k, m in moments.ZONES.items())
    off = r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?"
    o = lambda i: f"regexp_extract(z, '{off}', {i})"
    return rf"""WITH c AS (SELECT record_id, field, x, regexp_replace(x, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+', '') AS v, tz, date_order FROM ({cells}) JOIN portals USING (portal)),
        s AS (SELECT *, {part(g(iso, 1), g(num, 3), g(named, 3), g(mon, 3), g(compact, 1))} AS y, {mo} AS m, {day} AS d, {part(g(iso, 4), g(num, 4), g(named, 4), g(mon, 4), g(compact, 4))} AS w FROM c),
        t AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9]{{5}}') THEN DATE '1899-12-30' + x::INT ELSE try_cast(y || '-' || m || '-' || d AS DATE) END AS day, coalesce(w, '') AS w2 FROM s),
        u AS (SELECT record_id, field, x, tz, day, {r(6)} AS z, coalesce(try_cast({r(1)} AS INT), 0) AS h0, coalesce(try_cast({r(2)} AS INT), 0) AS mi, coalesce(try_cast({r(3)} AS INT), 0) AS sec,
            rpad({r(4)}, 6, '0')::BIGINT AS us, lower({r(5)}) AS ap FROM (SELECT * REPLACE (w2 AS w) FROM t) WHERE day IS NOT NULL AND regexp_matches(w, '{rest}')),
        h AS (SELECT *, CASE ap WHEN '' THEN h0 ELSE h0 % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END END AS hh FROM u WHERE mi < 60 AND sec < 60 AND CASE ap WHEN '' THEN h0 < 24 ELSE h0 BETWEEN 1 AND 12 END),
        l AS (SELECT record_id, field, z, us, day + to_hours(hh) + to_minutes(mi) + to_seconds(sec) AS ts, CASE WHEN z = '' THEN tz WHEN contains(z, '/') THEN z END AS zone,
            CASE WHEN regexp_full_match(z, '{off}') THEN CASE {o(1)} WHEN '-' THEN -1 ELSE 1 END * ({o(2)}::INT * 60 + coalesce(try_cast({o(3)} AS INT), 0)) ELSE CASE z {names} END END AS east FROM h),
        k AS (SELECT *, CASE WHEN zone IS NOT NULL THEN timezone(zone, ts) END AS utc FROM l WHERE zone IS NOT NULL OR east IS NOT NULL)
        SELECT record_id, field, us + CASE WHEN zone IS NULL THEN epoch_us(ts) - east::BIGINT * 60000000 WHEN timezone(zone, utc - INTERVAL 1 HOUR) = ts THEN epoch_us(utc) - 3600000000 ELSE epoch_us(utc) END AS utc_us FROM k
        UNION ALL SELECT record_id, field, x::BIGINT * CASE length(x) WHEN 13 THEN 1000 ELSE 1000000 END FROM c WHERE regexp_full_match(x, '[0-9]{{10}}|[0-9]{{13}}')"""


ORACLE["p6_found"] = _moments_sql()
ORACLE["p6_inferred"] = ORACLE["p6_found"]
ORACLE["p6_orders"] = "SELECT portal, date_order FROM portals"
