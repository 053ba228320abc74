"""Reading registers from files with a quarantine, aligning them to the twelve fields, and writing results."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.cleaning import FIELDS
from tallymark.runtime import materialize

CORRUPT = "_corrupt_record"
ENCODINGS = ("utf-8", "cp1252", "iso-8859-1")


class IngestionError(ValueError):
    """An input whose columns cannot be used."""


def normalise_columns(df: DataFrame) -> DataFrame:
    """Labels trimmed, lower case, blanks and dashes as underscores; two labels that become one are an error."""
    names = [re.sub(r"[\s\-]+", "_", c.strip().lower()) for c in df.columns]
    if len(set(names)) < len(names):
        raise IngestionError(f"columns collide after normalising: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def align(df: DataFrame, key: str = "work_id", keep: Sequence[str] = ()) -> DataFrame:
    """The twelve fields in order; extra columns dropped, missing ones null; the key column must be there."""
    if key not in df.columns:
        raise IngestionError(f"no column {key}")
    return df.select(*keep, *[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in FIELDS])


def with_record_ids(df: DataFrame, name: str = "record_id") -> DataFrame:
    """Unique, not dense: numbered within partitions, so no task counts all rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a file with a header, every value as text. A row with more or fewer fields than the header
    goes to the quarantine with its number of fields and the first 200 characters. multi_line: quoted fields may hold line
    breaks, for which a file has to be one task; without, large files are split."""
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    if not head or not head[0][0].strip():
        empty = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
        return spark.createDataFrame([], empty), spark.createDataFrame([], "kind string, n_fields int, preview string")
    labels = spark.read.csv(spark.sparkContext.parallelize([head[0][0].lstrip("﻿")]), sep=sep).collect()[0]
    schema = T.StructType([T.StructField(str(c), T.StringType()) for c in labels] + [T.StructField(CORRUPT, T.StringType())])
    options = {"header": True, "sep": sep, "encoding": encoding, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "multiLine": multi_line, "nullValue": "\u0000", "emptyValue": "", "enforceSchema": True}
    read = materialize(spark.read.schema(schema).options(**options).csv(path), "csv")  # the text is parsed once for both results
    bad = read.filter(F.col(CORRUPT).isNotNull()).select(F.lit("column_count").alias("kind"), F.size(F.split(F.regexp_replace(CORRUPT, '"(?:[^"]|"")*"', "q"), re.escape(sep))).alias("n_fields"), F.substring(CORRUPT, 1, 200).alias("preview"))
    return read.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), bad


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """csv, tsv, parquet or json lines, by the ending; text encodings are tried in turn on the whole file."""
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if low.endswith((".csv", ".tsv")):
        lines = spark.read.text(path)  # bytes as they are in the file; this reader decodes nothing
        unused = F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike("[\\x81\\x8d\\x8f\\x90\\x9d]")
        wrong = dict(zip(ENCODINGS, (~F.is_valid_utf8("value"), unused, F.lit(False))))
        encoding = next(e for e in ENCODINGS if lines.filter(wrong[e]).isEmpty())
        name = "spark.sql.legacy.javaCharsets"  # else Spark has no cp1252; read_csv has parsed the text when it returns
        before = spark.conf.get(name)
        spark.conf.set(name, "true")
        try:
            return read_csv(spark, path, "\t" if low.endswith(".tsv") else ",", encoding)[0]
        finally:
            spark.conf.set(name, before)
    raise IngestionError(f"unknown kind of file: {path}")


def load_register(spark: SparkSession, path: str) -> DataFrame:
    """A file of any kind as the twelve fields with record ids."""
    return with_record_ids(align(normalise_columns(read_any(spark, path))))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, usable, reason, size) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending.isin("csv", "tsv", "xlsx", "xls", "parquet", "json", "jsonl"), "table").when(ending == "pdf", "report").otherwise("other")
    usable = (kind == "table") & ~ending.isin("xlsx", "xls") & (F.col("size") > 0)
    reason = F.when(F.col("size") == 0, "empty").when(kind == "other", "unknown ending").when(~usable, "needs a converter").otherwise("ok")
    return files.select("path", kind.alias("kind"), usable.alias("usable"), reason.alias("reason"), "size")


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls as empty cells; arrays joined with a bar."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as JSON with sorted keys, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    canonical_json(df).write.mode("append" if append else "overwrite").text(path)


def write_report(df: DataFrame, path: str, key: str, most: int = 10_000) -> None:
    """A small report as one JSON file on the shared file system: rows by key, sorted names, not-a-number and infinities as
    text. More than ``most`` rows are an error."""
    rows = df.orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    plain = lambda x: str(x) if isinstance(x, float) and not math.isfinite(x) else x
    held = json.dumps([{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in rows], sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, True)
    out.write(bytearray(held.encode("utf-8")))
    out.close()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; a log that is not there is empty."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(schema).json(path) if system.exists(there) else spark.createDataFrame([], schema)


def save_artifacts(folder: str, edges: Sequence[float], vocabulary: dict[str, float], overwrite: bool = False) -> None:
    """The frozen feature space (small, on the driver): stratum edges and term weights. A folder in use is not overwritten."""
    path = os.path.join(folder, "features.json")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"edges": list(edges), "vocabulary": vocabulary}, f, sort_keys=True, ensure_ascii=False)


def load_artifacts(folder: str) -> tuple[list[float], dict[str, float]]:
    with open(os.path.join(folder, "features.json"), encoding="utf-8") as f:
        held = json.load(f)
    edges = held["edges"]
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must ascend")
    return edges, held["vocabulary"]
