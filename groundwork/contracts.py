"""Checks that data must pass; each is one aggregate query, and raises with what it found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data broke a contract."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def require(df: DataFrame, **checks: Column) -> DataFrame:
    """Every check holds in every row; a null counts as broken."""
    names = list(checks)
    row = df.agg(*[F.count_if(~F.coalesce(checks[n], F.lit(False))).alias(n) for n in names]).first()
    bad = {n: row[n] for n in names if row[n]}
    if bad:
        raise ContractError(f"rows that break a contract: {bad}")
    return df


def unique(df: DataFrame, *keys: str) -> DataFrame:
    n = df.groupBy(*keys).count().filter("count > 1").count()
    if n:
        raise ContractError(f"{n} keys of {keys} occur more than once")
    return df


def row_count(df: DataFrame, expected: int) -> DataFrame:
    n = df.count()
    if n != expected:
        raise ContractError(f"{n} rows, {expected} expected")
    return df


def shared(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys that both sides hold."""
    return a.select(*keys).intersect(b.select(*keys))


def disjoint(a: DataFrame, b: DataFrame, *keys: str) -> None:
    if not shared(a, b, *keys).isEmpty():
        raise ContractError(f"both sides hold some of {keys}")


def covered(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Every key of df is in other."""
    n = df.join(other, list(keys), "left_anti").count()
    if n:
        raise ContractError(f"{n} rows without a match on {keys}")
    return df


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one", require_match: bool = False) -> DataFrame:
    """A join whose cardinality is checked: one_to_one, one_to_many or many_to_one."""
    if validate in ("one_to_one", "many_to_one"):
        unique(right, *on)
    if validate in ("one_to_one", "one_to_many"):
        unique(left, *on)
    if require_match:
        covered(left, right, *on)
    return left.join(right, list(on), how)


def digest(df: DataFrame, column: str) -> DataFrame:
    """(source_count, digest): number of distinct ids and SHA-256 of them, sorted and joined by newlines.
    The ids of one dataset of some thousand sources meet in one row; larger sets have digests_by_bucket."""
    ids = df.agg(F.array_sort(F.collect_set(F.col(column).cast("string"))).alias("ids"))
    return ids.select(F.size("ids").cast("long").alias("source_count"), F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))


def digests_by_bucket(df: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """A digest for each bucket of ids (by MD5), for id sets beyond one row."""
    key = F.col(column).cast("string")
    bucket = (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    ids = df.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_set(key)).alias("ids"))
    return ids.select("bucket", F.size("ids").cast("long").alias("source_count"), F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))


def first_rows(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
