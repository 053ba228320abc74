"""Text vectors and duplicate scores inside blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.runtime import materialize


def terms(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def tfidf(texts: DataFrame, text: str) -> DataFrame:
    """(text, term, weight) of distinct texts: 1 + ln tf, times ln((1 + n) / (1 + df)) + 1, of length 1 per text."""
    tf = texts.select(F.col(text).alias("text")).filter("text != ''").distinct().select("text", F.explode(terms(F.col("text"))).alias("term")).groupBy("text", "term").agg((1 + F.ln(F.count("*"))).alias("tf"))
    tf = materialize(tf, "tf")
    n = tf.agg(F.count_distinct("text").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).select("text", "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # n is one row
    norm = raw.groupBy("text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "text").select("text", "term", (F.col("w") / F.col("norm")).alias("weight"))


def drift(texts: DataFrame, vocabulary: DataFrame, text: str) -> DataFrame:
    """Shares of distinct and of all words that a frozen vocabulary lacks."""
    words = texts.select(F.explode(F.filter(F.split(text, " "), lambda w: w != "")).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    known = words.join(vocabulary.select("word").distinct().withColumn("known", F.lit(True)), "word", "left")
    unseen = F.col("known").isNull()
    return known.agg((F.count_if(unseen) / F.count("*")).alias("unseen_distinct"), (F.sum(F.when(unseen, F.col("c")).otherwise(0)) / F.sum("c")).alias("unseen_weighted"))


def block_scores(records: DataFrame, block: list[str], text: str, day: str, key: str = "record_id", least: float = 0.85, half: float = 180.0) -> DataFrame:
    """Pairs of a block with cosine of their word vectors times exp(-days apart / half) at ``least`` or more.

    Equal texts are one class. Two texts at the limit share a term of their prefixes: the rarest terms of each, up to where the
    rest is too short for the limit by itself. From their rarest common term on, the lengths of what remains bound the cosine,
    so a pair met at a term where that bound is under the limit is dropped there. Pairs are looked for within the days that the
    limit allows. Nothing is capped."""
    ids = materialize(records.select(F.col(text).alias("text")).filter("text != ''").distinct().withColumn("t", F.monotonically_increasing_id()), "texts")
    vectors = materialize(tfidf(records, text).join(ids, "text").select("t", "term", "weight"), "vectors")
    width = int(-half * math.log(least)) + 1  # days: farther apart, the cosine would have to be over 1
    rows = records.filter(" AND ".join(f"{b} IS NOT NULL" for b in block) + f" AND {day} IS NOT NULL AND {text} != ''").select(F.col(key).alias("id"), *block, F.col(text).alias("text"), F.col(day).alias("day"))
    rows = materialize(rows.join(ids, "text").drop("text").withColumn("span", F.floor(F.unix_date("day") / width)), "rows")
    near = F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1))
    rest = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("t").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = vectors.join(vectors.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("rest", rest)
    prefix = ranked.filter(F.col("rest") >= least * least - 1e-9).select("t", F.xxhash64("term").alias("term"), F.col("weight").alias("w"), "rest")
    lists = materialize(rows.select(*block, "t", "span").distinct().join(prefix, "t"), "prefixes")
    a, b = lists.withColumnsRenamed({"t": "ta", "w": "wa", "rest": "ra"}), lists.withColumn("span", near).withColumnsRenamed({"t": "tb", "w": "wb", "rest": "rb"})
    bound = F.expr("wa * wb + sqrt(greatest(ra - wa * wa, 0D) * greatest(rb - wb * wb, 0D))")
    found = a.join(b, [*block, "term", "span"]).filter((F.col("ta") < F.col("tb")) & (bound >= least - 1e-9)).select("ta", "tb").distinct()
    vector = vectors.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))
    both = materialize(found, "found").join(vector.withColumnsRenamed({"t": "ta", "v": "va"}), "ta").join(vector.withColumnsRenamed({"t": "tb", "v": "vb"}), "tb")
    cosine = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, t: s + F.element_at("va", t) * F.coalesce(F.try_element_at("vb", t), F.lit(0.0)))
    alike = both.select("ta", "tb", cosine.alias("cosine")).filter(F.col("cosine") >= least)
    copies = rows.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(1.0).alias("cosine"))
    left = rows.withColumnsRenamed({"id": "ia", "t": "ta", "day": "da"})
    right = rows.withColumn("span", near).withColumnsRenamed({"id": "ib", "t": "tb", "day": "db"})
    pairs = materialize(alike.unionByName(copies), "alike").join(left, "ta").join(right, [*block, "tb", "span"]).filter("ta < tb OR ia < ib")
    score = F.col("cosine") * F.exp(-F.abs(F.datediff("da", "db")) / half)
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "cosine", score.alias("score")).filter(F.col("score") >= least)
