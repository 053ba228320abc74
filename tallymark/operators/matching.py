"""Matching records with findings over a cascade of keys, weak labels by place and year, and firms by normal name."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import join_key, vendor_key
from tallymark.runtime import materialize, small_side

METHODS = {
    "WORK_ID": ("work_id",), "TRANSACTION_ID": ("transaction_id",), "SCHEME_WORK_DISTRICT_YEAR": ("scheme", "work_id", "district", "financial_year"),
    "VENDOR_DISTRICT_YEAR": ("vendor", "district", "financial_year"), "SCHEME_DISTRICT_YEAR": ("scheme", "district", "financial_year"), "DISTRICT_YEAR": ("district", "financial_year"),
}
IDENTIFIERS = ("work_id", "transaction_id")


#: Pairs that one task makes, and tasks of a join beyond which each makes more.
PAIRS, TASKS = 4_000_000, 2_000


def _rows(df: DataFrame, id_column: str) -> DataFrame:
    """(id, a column for each method): the key that a row supports; one with a hole in it is null."""
    fields = {f for fs in METHODS.values() for f in fs}
    put = df.select(F.col(id_column).alias("id"), *[(join_key(F.col(f).cast("string"), f in IDENTIFIERS) if f in df.columns else F.lit(None).cast("string")).alias(f) for f in sorted(fields)])
    whole = lambda fs: F.when(sum(F.col(f).isNull().cast("int") for f in fs) == 0, F.concat_ws("|", *fs))
    return put.select("id", *[whole(fs).alias(m) for m, fs in METHODS.items()])


def _keys(df: DataFrame, id_column: str) -> DataFrame:
    """(id, method, key): each key a row supports."""
    found = [F.struct(F.lit(m).alias("method"), F.col(m).alias("key")) for m in METHODS]
    return _rows(df, id_column).select("id", F.explode(F.array(*found)).alias("k")).select("id", "k.*").filter("key IS NOT NULL")


def _held(df: DataFrame, id_column: str, methods: list[str], side: str) -> DataFrame:
    """(side, several_side, method, key, side0, side1, ...): each key of the distinct rows, with the stronger keys of the same row.
    several: the id has rows that differ in their keys."""
    rows = _rows(df, id_column).select("id", *methods).repartition("id").distinct()
    rows = materialize(rows.withColumn("several", F.count(F.coalesce(*methods)).over(Window.partitionBy("id")) > 1), "keys")
    above = lambda i: [(F.col(m) if j < i else F.lit(None).cast("string")).alias(f"{side}{j}") for j, m in enumerate(methods[:-1])]
    found = [F.struct(F.lit(m).alias("method"), F.col(m).alias("key"), *above(i)) for i, m in enumerate(methods)]
    return rows.select(F.col("id").alias(side), F.col("several").alias(f"several_{side}"), F.explode(F.array(*found)).alias("k")).select(side, f"several_{side}", "k.*").filter("key IS NOT NULL")


def match_blocked(records: DataFrame, findings: DataFrame, record: str = "record_id", finding: str = "audit_id") -> DataFrame:
    """(record, finding, method, key): each pair that shares a key, by its strongest. The pairs are the result, and come
    straight from the join: two rows that share a stronger key don't meet by a weaker one. Only the pairs of ids whose rows
    differ in their keys are shuffled, for the strongest key over those rows. Keys of many pairs are split."""
    methods = [m for m, fs in METHODS.items() if {*fs} <= {*records.columns} & {*findings.columns}] or [*METHODS]
    a, b = _held(records, record, methods, "r"), _held(findings, finding, methods, "f")
    count = lambda d, n: d.groupBy("method", "key").agg(F.count("*").alias(n))
    meet = materialize(count(a, "a").join(count(b, "b"), ["method", "key"]).select("method", "key", (F.col("a").cast("double") * F.col("b")).alias("pairs")), "meetings")
    total = meet.agg(F.sum("pairs")).first()[0] or 0.0
    most = max(PAIRS, total / TASKS)
    hot = small_side(meet.filter(F.col("pairs") > most).select("method", "key", F.ceil(F.col("pairs") / most).cast("int").alias("parts")))
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / most))
    on = ["method", "key", "part"]
    a, b = (d.join(hot, ["method", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for d in (a, b))
    a = a.withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int")).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    weaker = F.lit(False)
    for j in range(len(methods) - 1):
        weaker |= F.coalesce(F.col(f"r{j}") == F.col(f"f{j}"), F.lit(False))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.repartition(tasks, *on).join(y.repartition(tasks, *on), on).filter(~weaker).select("r", "f", "method", "key")

    out = pairs(a.filter("NOT several_r"), b.filter("NOT several_f"))
    found = [pairs(x, y) for x, y, some in ((a.filter("several_r"), b, a.filter("several_r")), (a.filter("NOT several_r"), b.filter("several_f"), b.filter("several_f"))) if not some.isEmpty()]
    if found:
        strength = F.create_map(*[F.lit(v) for i, m in enumerate(METHODS) for v in (m, len(METHODS) - i)])[F.col("method")]
        best = reduce(DataFrame.unionByName, found).groupBy("r", "f").agg(F.max(F.struct(strength.alias("strength"), "method", "key")).alias("b"))
        out = out.unionByName(best.select("r", "f", "b.method", "b.key"))
    return out.select(F.col("r").alias(record), F.col("f").alias(finding), F.col("method").alias("match_method"), F.col("key").alias("match_key"))


def match_counts(records: DataFrame, findings: DataFrame, record: str = "record_id", finding: str = "audit_id") -> DataFrame:
    """Pairs per method without making them: the product of the rows on each side of a key."""
    side = lambda d, i, n: _keys(d, i).groupBy("method", "key").agg(F.count("*").alias(n))
    return side(records, record, "a").join(side(findings, finding, "b"), ["method", "key"]).groupBy("method").agg(F.sum(F.col("a") * F.col("b")).alias("pairs"), F.count("*").alias("keys"))


def start_year(text: Column) -> Column:
    """The first year of a financial year however it is written (2019-20, 2019-2020, FY19-20)."""
    full = F.regexp_extract(text, "(?:^|[^0-9])((?:19|20)[0-9]{2})", 1)
    short = F.regexp_extract(text, "^[^0-9]*([0-9]{2})[^0-9]", 1)
    return F.when(full != "", full.try_cast("int")).when(short != "", short.try_cast("int") + 2000)


def weak_labels(records: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_id, label): the strongest tier of findings over a record's place: exact (state, district, year), partial
    (state, district), loose (state, of findings that name a state only), covered (a state with findings) or none."""
    r = records.select("record_id", join_key(F.col("state")).alias("s"), join_key(F.col("district")).alias("d"), F.col("year").alias("y"))
    f = findings.select(join_key(F.col("state")).alias("s"), join_key(F.col("district")).alias("d"), start_year(F.col("financial_year")).alias("y")).filter("s IS NOT NULL")
    tier = lambda d, on, name: small_side(d.select(*on).distinct().withColumn(name, F.lit(True)))
    out = r.join(tier(f.filter("d IS NOT NULL AND y IS NOT NULL"), ["s", "d", "y"], "exact"), ["s", "d", "y"], "left")
    out = out.join(tier(f.filter("d IS NOT NULL"), ["s", "d"], "partial"), ["s", "d"], "left").join(tier(f.filter("d IS NULL"), ["s"], "loose"), "s", "left").join(tier(f, ["s"], "covered"), "s", "left")
    return out.select("record_id", F.when(F.col("exact"), "exact").when(F.col("partial"), "partial").when(F.col("loose"), "loose").when(F.col("covered"), "covered").otherwise("none").alias("label"))


def vendor_entities(records: DataFrame, vendor: str = "vendor_name", key: str = "record_id") -> DataFrame:
    """(key, vendor_normalised, vendor_entity, group_size): firms by normal name, numbered by their first record; a cell
    that names nobody is an entity of its own."""
    named = records.select(key, vendor_key(F.col(vendor)).alias("vendor_normalised"))
    firms = small_side(named.filter("vendor_normalised IS NOT NULL").groupBy("vendor_normalised").agg(F.min(key).alias("_first"), F.count("*").alias("_size")))
    out = named.join(firms, "vendor_normalised", "left")
    entity = F.when(F.col("_first").isNotNull(), F.concat(F.lit("VE-"), F.lpad(F.col("_first").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("VE-UNRESOLVED-"), F.lpad(F.col(key).cast("string"), 9, "0")))
    return out.select(key, "vendor_normalised", entity.alias("vendor_entity"), F.coalesce("_size", F.lit(1)).alias("group_size"))


def entity_graph(records: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct edges between two columns, with the records behind each and the neighbours of the left node."""
    edges = records.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("source"), F.col(right).alias("target")).agg(F.count("*").alias("records"))
    degree = edges.groupBy("source").agg(F.count("*").alias("degree"))
    return edges.join(degree, "source").select("source", "target", "records", "degree")


def best_partner(pairs: DataFrame, key: str, other: str, score: str) -> DataFrame:
    """Each key's partner with the highest score, the smallest one on ties."""
    w = Window.partitionBy(key).orderBy(F.desc(score), other)
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
