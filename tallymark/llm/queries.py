"""The registered queries over the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import components, leakage, mojibake, names, near_dup, packing, quantiles
from tallymark.runtime import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.record_pairs(table(spark, sf_dir, "synthetic_dataset", "record_id", "district", "work_name"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "synthetic_dataset", "district", "sanction_amount", "ingested_at")
    return works.select(F.lower(F.trim("district")).alias("district"), "sanction_amount", F.date_format("ingested_at", "yyyy-MM-dd").alias("day"))


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of each district and day of delivery, and of all its days together (day ``all``)."""
    days = _amounts(spark, sf_dir)
    return quantiles.percentiles(days.unionByName(days.withColumn("day", F.lit("all"))), ("district", "day"), "sanction_amount")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From daily summaries, kept as a table and put together; within 0.1 per cent of the exact values."""
    daily = materialize(quantiles.summarise(_amounts(spark, sf_dir), "district", "sanction_amount", "day"), "daily")
    return quantiles.percentiles_of_summary(daily, "district")


def p2_percentiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_amounts(spark, sf_dir), "district", "sanction_amount")


def p2_error_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each district's percentiles from summaries are within the stated error of the exact ones."""
    near, exact = p2_percentiles(spark, sf_dir), p2_percentiles_exact(spark, sf_dir)
    names = ("p50", "p90", "p95", "p99")
    both = near.alias("a").join(exact.alias("b"), F.col("a.district").eqNullSafe(F.col("b.district")))
    kept = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= quantiles.ERROR * F.abs(F.col(f"b.{c}")) * 1.000001 for c in names]
    return both.select("a.district", (F.col("a.n") == F.col("b.n")).alias("same_n"), *[k.alias(f"{c}_kept") for k, c in zip(kept, names)])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "synthetic_dataset", "record_id", "vendor_name", "implementing_agency")
    return names.link(records, table(spark, sf_dir, "entity_register"), {"vendor_name": "vendor", "implementing_agency": "agency"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "synthetic_dataset", "record_id", "work_id")
    return components.match_groups(records, table(spark, sf_dir, "work_matches", "record_a", "record_b", "verdict"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(packing.token_counts(table(spark, sf_dir, "documents", "doc_id", "text")), "tokens")
    return packing.pack_all(counts, table(spark, sf_dir, "pack_sizes", "container", "capacity_tokens"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.certificate(_packed(spark, sf_dir))


def p7_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.promises(_packed(spark, sf_dir))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole item, as it is or edited a little: similarity of weighted five-word shingles of 0.8 or more."""
    return leakage.near_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stretches within the radius, those equal word for word."""
    found = leakage.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))
    return found.filter("exact").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.mended(table(spark, sf_dir, "documents", "doc_id", "text", "source"), source="source").select("doc_id")


def p9_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.mended(table(spark, sf_dir, "documents", "doc_id", "text", "source"), source="source")


QUERIES = {
    "p1_found": p1_found,
    "p2_daily": p2_daily,
    "p2_percentiles": p2_percentiles,
    "p2_percentiles_exact": p2_percentiles_exact,
    "p2_error_kept": p2_error_kept,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p7_packing": p7_packing,
    "p7_certificate": p7_certificate,
    "p7_promises": p7_promises,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_found": p9_found,
    "p9_mended": p9_mended,
}

ORACLE = {
    "p1_found": """
        WITH r AS (
            SELECT record_id, regexp_replace(lower(district), '^\\s+|\\s+$', '', 'g') AS d, trim(regexp_replace(lower(work_name), '[^a-z0-9]+', ' ', 'g')) AS nm
            FROM synthetic_dataset
            WHERE district IS NOT NULL AND work_name IS NOT NULL AND lower(trim(work_name)) NOT IN ('', '-', '--', '.', '?', 'n/a', 'n.a.', 'na', 'null', 'none', 'nil', 'nan',
                'unknown', 'not available', 'not applicable', 'no data', '0000-00-00', '00-00-0000', '9999-99-99')),
        c AS (SELECT d, nm, row_number() OVER (ORDER BY d, nm) AS c FROM (SELECT DISTINCT d, nm FROM r WHERE length(nm) >= 3)),
        g AS (SELECT DISTINCT c, d, nm[i : i + 2] AS t FROM c, unnest(range(1, length(nm) - 1)) u(i)),
        z AS (SELECT c, count(*) AS n FROM g GROUP BY c),
        shared AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM g a JOIN g b ON a.d = b.d AND a.t = b.t AND a.c < b.c GROUP BY 1, 2),
        near AS (SELECT a, b FROM shared JOIN z x ON x.c = a JOIN z y ON y.c = b WHERE k >= 0.65 * (x.n + y.n - k)),
        m AS (SELECT c.c, r.record_id FROM r JOIN c USING (d, nm))
        SELECT least(x.record_id, y.record_id) AS record_a, greatest(x.record_id, y.record_id) AS record_b FROM near JOIN m x ON x.c = a JOIN m y ON y.c = b
        UNION ALL SELECT x.record_id, y.record_id FROM m x JOIN m y USING (c) WHERE x.record_id < y.record_id""",
    "p2_daily": """
        WITH d AS (SELECT lower(trim(district)) AS district, strftime(ingested_at, '%Y-%m-%d') AS day, sanction_amount AS v FROM synthetic_dataset WHERE sanction_amount IS NOT NULL AND NOT isnan(sanction_amount)),
        b AS (SELECT * FROM d UNION ALL SELECT district, 'all', v FROM d),
        r AS (SELECT district, day, v, row_number() OVER (PARTITION BY district, day ORDER BY v) AS k, count(*) OVER (PARTITION BY district, day) AS n FROM b)
        SELECT district, day, max(n) AS n, max(CASE WHEN k = (50 * n + 99) // 100 THEN v END) AS p50, max(CASE WHEN k = (90 * n + 99) // 100 THEN v END) AS p90,
            max(CASE WHEN k = (95 * n + 99) // 100 THEN v END) AS p95, max(CASE WHEN k = (99 * n + 99) // 100 THEN v END) AS p99
        FROM r GROUP BY district, day""",
    "p2_error_kept": """
        SELECT DISTINCT lower(trim(district)) AS district, true AS same_n, true AS p50_kept, true AS p90_kept, true AS p95_kept, true AS p99_kept
        FROM synthetic_dataset WHERE sanction_amount IS NOT NULL AND NOT isnan(sanction_amount)""",
    "p2_percentiles_exact": """
        WITH r AS (
            SELECT lower(trim(district)) AS district, sanction_amount AS v, row_number() OVER (PARTITION BY lower(trim(district)) ORDER BY sanction_amount) AS k,
                count(*) OVER (PARTITION BY lower(trim(district))) AS n
            FROM synthetic_dataset WHERE sanction_amount IS NOT NULL AND NOT isnan(sanction_amount))
        SELECT district, max(n) AS n, max(CASE WHEN k = (50 * n + 99) // 100 THEN v END) AS p50, max(CASE WHEN k = (90 * n + 99) // 100 THEN v END) AS p90,
            max(CASE WHEN k = (95 * n + 99) // 100 THEN v END) AS p95, max(CASE WHEN k = (99 * n + 99) // 100 THEN v END) AS p99
        FROM r GROUP BY district""",
    "p4_found": """
        WITH RECURSIVE e AS (
            SELECT record_a AS u, record_b AS v FROM work_matches WHERE verdict = 'same' AND record_a IS NOT NULL AND record_b IS NOT NULL AND record_a <> record_b
            UNION SELECT s.record_id, m.head FROM synthetic_dataset s JOIN (SELECT work_id, min(record_id) AS head FROM synthetic_dataset WHERE work_id IS NOT NULL GROUP BY work_id) m
                USING (work_id) WHERE s.record_id <> m.head),
        b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        w(x, y) AS (SELECT u, least(u, v) FROM b UNION SELECT b.v, w.y FROM w JOIN b ON b.u = w.x WHERE w.y < b.v)
        SELECT x AS record_id, min(y) AS group_id FROM w GROUP BY x""",
    "p7_promises": """
        SELECT container, (SELECT count(*) FROM documents WHERE length(text) > 0) AS texts, 0 AS overfull, 0 AS torn, 0 AS above FROM pack_sizes WHERE capacity_tokens > 0""",
    "p8_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dw AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS s FROM d, unnest(range(1, len(w) - 10)) u(k) WHERE len(w) >= 12),
        iw AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS s FROM i, unnest(range(1, len(w) - 10)) u(k) WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
}
