"""Sinks: splits, graphs, checkpoints, upserts, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork import contracts


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_splits(df: DataFrame, path: str, expected: dict[str, int] | None = None, force: bool = False) -> None:
    """df partitioned by dataset and split; an existing path is an error unless forced, a split of another
    number of rows than expected ("dataset/split": rows) always."""
    if expected is not None:
        got = {f"{r['dataset']}/{r['split']}": r["count"] for r in df.groupBy("dataset", "split").count().collect()}
        if got != expected:
            raise contracts.ContractError(f"rows by split {got}, {expected} expected")
    df.write.mode("overwrite" if force else "errorifexists").partitionBy("dataset", "split").parquet(path)


def export_csv(df: DataFrame, path: str, by: list[str] | None = None, force: bool = False) -> None:
    """CSV with a header, a folder for each value of `by`."""
    w = df.write.mode("overwrite" if force else "errorifexists").option("header", True).option("quote", '"').option("escape", '"')
    (w.partitionBy(*by) if by else w).csv(path)


def write_graphs(df: DataFrame, path: str, append: bool = False) -> None:
    """Graph pairs as JSON lines in UTF-8; each appended batch is a file set of its own."""
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", False).json(path)


def upsert(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of `key` values that df has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written first if it is not there. A half-written one has no _SUCCESS and is
    made anew."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object as a text file set."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict | None = None) -> None:
    """The artefacts of a run: each table as Parquet, the settings as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if settings is not None:
        write_json(spark, settings, f"{path}/settings")


def staged(df: DataFrame, path: str) -> DataFrame:
    """df written beside path and read back: for tables that are read and then replaced."""
    at = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def rows_as_json(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
