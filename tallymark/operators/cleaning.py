"""Works records cleaned, validated and described. No row is dropped, repaired or imputed: every null has its reason."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.dates import parse_squeezed
from tallymark.functions.text import number, squeeze
from tallymark.runtime import PLACEHOLDERS

TEXTS = ("work_id", "work_name", "district", "state", "implementing_agency", "vendor_name", "status")
AMOUNTS = ("sanction_amount", "amount_spent")
DATES = ("date_proposal", "date_approval", "date_completion")
FIELDS = ("work_id", "work_name", "district", "state", *AMOUNTS, *DATES, "implementing_agency", "vendor_name", "status")
STATUSES = ("proposed", "approved", "completed")
SCHEME_START, REFERENCE_DAY, LARGEST = date(1993, 1, 1), date(2024, 12, 31), 1e15
ERRORS = (
    "type_unparseable", "value_negative", "value_non_finite", "value_implausible_magnitude", "value_unknown_status", "logical_date_order",
    "logical_date_before_scheme_start", "schema_missing_key", "schema_duplicate_key",
)


def clean(df: DataFrame, key: str = "record_id") -> DataFrame:
    """``key``, the twelve fields typed, and ``null_reason__<field>`` in {present, missing, placeholder, unparseable}."""
    kinds = dict(df.dtypes)
    # in steps, so that no expression is looked at twice: tidy text, then its value, then the reason
    tidy = df.select(key, *[(F.nanvl(F.col(f), F.lit(None)) if kinds[f] == "double" else squeeze(F.col(f).cast("string"))).alias(f) for f in FIELDS])

    def value(f: str) -> Column:
        text = F.col(f)
        if kinds[f] == "double":
            return text
        read = number(text) if f in AMOUNTS else parse_squeezed(text) if f in DATES else F.lower(text)
        return F.when(~F.lower(text).isin(*PLACEHOLDERS), read)

    read = tidy.select(key, *[value(f).alias(f) for f in FIELDS], *[F.col(f).alias(f"_t_{f}") for f in FIELDS])

    def reason(f: str) -> Column:
        if kinds[f] == "double":
            return F.when(F.col(f).isNull(), "missing").otherwise("present")
        text = F.col(f"_t_{f}")
        return F.when(text.isNull() | (text == ""), "missing").when(F.col(f).isNotNull(), "present").when(F.lower(text).isin(*PLACEHOLDERS), "placeholder").otherwise("unparseable")

    return read.select(key, *FIELDS, *[reason(f).alias(f"null_reason__{f}") for f in FIELDS])


def issues(cleaned: DataFrame) -> DataFrame:
    """Every record with ``issues`` (array of ``code:field``) and ``is_valid`` (no error among them)."""
    c, found = F.col, []
    for f in FIELDS:
        for reason, code in (("unparseable", "type_unparseable"), ("missing", "completeness_missing"), ("placeholder", "completeness_placeholder")):
            if f != "work_id" or reason == "unparseable":
                found.append(F.when(c(f"null_reason__{f}") == reason, f"{code}:{f}"))
    for f in AMOUNTS:
        found += [F.when(c(f) < 0, f"value_negative:{f}"), F.when(F.abs(c(f)) == float("inf"), f"value_non_finite:{f}"), F.when((F.abs(c(f)) > LARGEST) & (F.abs(c(f)) < float("inf")), f"value_implausible_magnitude:{f}")]
    found.append(F.when(~c("status").isin(*STATUSES), "value_unknown_status:status"))
    for a, b in zip(DATES, DATES[1:]):
        found.append(F.when(c(a) > c(b), f"logical_date_order:{a}>{b}"))
    for f in DATES:
        found += [F.when(c(f) < F.lit(SCHEME_START), f"logical_date_before_scheme_start:{f}"), F.when(c(f) > F.lit(REFERENCE_DAY), f"logical_date_in_future:{f}")]
    found.append(F.when(c("work_id").isNull(), "schema_missing_key:work_id"))
    found.append(F.when(c("work_id").isNotNull() & (F.col("_same") > 1), "schema_duplicate_key:work_id"))
    # a work_id is shared by few rows; the null key is not grouped at all, so no key of this window is hot by being null
    shared = cleaned.filter("work_id IS NOT NULL").groupBy("work_id").agg(F.count("*").alias("_same")).filter("_same > 1")
    out = cleaned.join(shared, "work_id", "left").withColumn("issues", F.array_compact(F.array(*found))).drop("_same")
    return out.withColumn("is_valid", ~F.exists("issues", lambda x: F.split_part(x, F.lit(":"), F.lit(1)).isin(*ERRORS)))


def with_issue(checked: DataFrame, code: str) -> DataFrame:
    return checked.filter(F.exists("issues", lambda x: F.split_part(x, F.lit(":"), F.lit(1)) == code))


def cells(cleaned: DataFrame) -> DataFrame:
    """(field, reason, value as text): the table unpivoted, one row per cell."""
    return cleaned.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"null_reason__{f}").alias("reason"), F.col(f).cast("string").alias("value")) for f in FIELDS])).alias("c")).select("c.*")


def missing_report(cleaned: DataFrame) -> DataFrame:
    """Per field the cells by reason and the share that is null, in percent; one pass, no unpivoting."""
    kinds = ("present", "missing", "placeholder", "unparseable")
    one = cleaned.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"null_reason__{f}") == k).alias(f"{f}__{k}") for f in FIELDS for k in kinds])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f"{f}__{k}").alias(k) for k in kinds]) for f in FIELDS])).alias("r")).select("r.*", "n")
    return rows.select("field", *kinds, F.coalesce(F.try_divide((F.col("n") - F.col("present")) * 100.0, F.col("n")), F.lit(0.0)).alias("pct_null")).orderBy(F.desc("pct_null"), "field")


def describe_amounts(cleaned: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the finite amounts."""
    from tallymark.operators.quantile import exact_quantiles

    long = cleaned.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in AMOUNTS])).alias("c")).select("c.*").filter("abs(x) < double('infinity')")
    base = long.groupBy("field").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return base.join(exact_quantiles(long, ["field"], "x", [0.25, 0.5, 0.75]).drop("n").withColumnsRenamed({"q0": "p25", "q1": "median", "q2": "p75"}), "field")


def duplicated_keys(cleaned: DataFrame) -> DataFrame:
    shared = cleaned.filter("work_id IS NOT NULL").groupBy("work_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    return cleaned.select("record_id", "work_id").join(shared, "work_id").select("record_id", "work_id", "copies")


def top_issues(checked: DataFrame, k: int = 10) -> DataFrame:
    counted = checked.select(F.explode("issues").alias("i")).groupBy(F.split_part("i", F.lit(":"), F.lit(1)).alias("code")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "code").limit(k)


def status_window(cleaned: DataFrame) -> DataFrame:
    """Each record's place among its district's works by amount: 1 is the largest; ties by record."""
    known = cleaned.filter("district IS NOT NULL AND sanction_amount IS NOT NULL")
    w = Window.partitionBy("district").orderBy(F.desc("sanction_amount"), "record_id")
    return known.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("district", "place", "record_id", "sanction_amount")
