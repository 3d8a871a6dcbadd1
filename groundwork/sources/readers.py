"""Scans: strict and lenient JSONL, CSV, JSON documents, graphs, caches; each with an explicit schema or a contract."""

from __future__ import annotations

import os
import urllib.request
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork import contracts, schemas
from groundwork.constants import TASKS

BAD = "__corrupt"


def download(url: str, destination: str, force: bool = False) -> str:
    """Fetch a pinned file to a driver-side folder under a temporary name, then rename it; an existing file is
    kept unless forced."""
    if os.path.exists(destination) and not force:
        return destination
    os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
    part = f"{destination}.{uuid.uuid4().hex}.part"
    try:
        urllib.request.urlretrieve(url, part)
        os.replace(part, destination)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return destination


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines. strict: a bad or blank line is an error; skip_blank: blank lines are skipped, bad ones are
    errors; lenient: both are dropped (count the bad ones with bad_lines)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"))
    blank = F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) == ""
    if mode != "strict":
        lines = lines.filter(~blank)
    bad = F.try_parse_json("value").isNull()
    if mode == "lenient":
        lines = lines.filter(~bad)
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    text = F.when(bad, F.raise_error(F.concat(F.lit("bad JSON in "), F.col("__file"), F.lit(": "), F.left("value", F.lit(80)))).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")  # also for values of another type


def bad_lines(spark: SparkSession, path: str) -> int:
    """How many lines that are not blank don't parse."""
    return spark.read.text(path).filter((F.trim("value") != "") & F.try_parse_json("value").isNull()).count()


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files of one JSON value each."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def csv(spark: SparkSession, path: str, schema: str | None = None, missing: str = "") -> DataFrame:
    """CSV with a header, quoted fields that may hold newlines, and quotes doubled; `missing` reads as null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", missing).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).csv(path)


def numbered_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """csv() with `line`, increasing in file order."""
    return csv(spark, path, schema).withColumn("line", F.monotonically_increasing_id())


def validated_texts(df: DataFrame) -> DataFrame:
    """Texts to extract from: string ids, trimmed tasks, no nulls; ids unique, tasks known, texts not blank."""
    contracts.require_columns(df, ["sample_id", "task_type", "context", "response"])
    out = df.withColumns({"sample_id": F.col("sample_id").cast("string"), "task_type": F.trim(F.col("task_type").cast("string")), "context": F.coalesce("context", F.lit("")), "response": F.coalesce("response", F.lit(""))})
    contracts.unique(out, "sample_id")
    full = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) != ""
    return contracts.require(out, known_task=F.col("task_type").isin(*TASKS), context=full("context"), response=full("response"))


def prepared(df: DataFrame, dataset: str, split: str) -> DataFrame:
    """A prepared dataset: ids with the dataset's prefix, generator_model "unknown" where missing, a 0/1 label,
    and the split."""
    contracts.require_columns(df, ["sample_id", "source_id", "task_type", "context", "response", "generator_model", "hallucinated"])
    prefixed = lambda c: F.concat(F.lit(f"{dataset}::"), F.col(c).cast("string"))
    out = df.withColumns({"sample_id": prefixed("sample_id"), "source_id": prefixed("source_id"), "generator_model": F.coalesce("generator_model", F.lit("unknown")), "hallucinated": F.col("hallucinated").cast("double").cast("int"), "split": F.lit(split)})
    return contracts.require(out, label=F.col("hallucinated").isin(0, 1))


def split_of(parts: Sequence[DataFrame]) -> DataFrame:
    """Prepared datasets of one split as one, whatever further columns each has."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def graphs(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Graph pairs from JSON lines, checked for shape; only those whose sample_id is in ids, if given. An id
    that comes twice is an error."""
    df = jsonl(spark, path, schemas.GRAPH_PAIR)
    if ids is not None:
        df = df.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    return checked_graphs(df)


def checked_graphs(df: DataFrame) -> DataFrame:
    whole = {f"{s}_{p}": F.col(f"{s}_graph.{p}").isNotNull() for s in ("context", "response") for p in ("entities", "relations")}
    contracts.require(df, sample_id=F.coalesce(F.col("sample_id"), F.lit("")) != "", task_type=F.col("task_type").isin(*TASKS), **whole)
    return contracts.unique(df, "sample_id")


def entity_cache(df: DataFrame, line: str = "line") -> DataFrame:
    """(k, e, t): of the records of a key, the last."""
    return df.groupBy("k").agg(F.max_by("e", line).alias("e"), F.max_by("t", line).alias("t"))


def articles(df: DataFrame, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """An id -> document dimension, ids as strings; unique."""
    return contracts.unique(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("document")), "id")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def bounded_batches(df: DataFrame, rows: int) -> DataFrame:
    """df with batch numbers: batches of at most `rows` consecutive rows of a partition."""
    w = Window.partitionBy("__part").orderBy("__row")
    numbered = df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    return numbered.withColumn("batch", F.concat_ws("-", "__part", F.floor((F.row_number().over(w) - 1) / rows))).drop("__part", "__row")
