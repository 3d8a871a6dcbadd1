"""Deterministic sampling and splitting: rows and groups are ordered by MD5 of their key and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.constants import RANDOM_SEED
from groundwork.contracts import ContractError


def keyed(column: str, seed: int = RANDOM_SEED) -> Column:
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"|{seed}")))


def shuffled(df: DataFrame, key: str, n: int | None = None, seed: int = RANDOM_SEED) -> DataFrame:
    """df in a fixed random order, the first n of it if asked for: a choice without replacement."""
    out = df.orderBy(keyed(key, seed), F.col(key))
    return out if n is None else out.limit(n)


def one_per_group(df: DataFrame, group: str, key: str, seed: int = RANDOM_SEED, *within: str) -> DataFrame:
    """One row of each group (and value of `within`), chosen by the key's hash."""
    w = Window.partitionBy(*within, group).orderBy(keyed(key, seed), F.col(key))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _first(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def balanced_groups(df: DataFrame, label: str, group: str, key: str, n_pos: int, n_neg: int, seed: int = RANDOM_SEED, strict: bool = True) -> DataFrame:
    """n_pos rows of label 1 and n_neg of label 0, each of a group of its own within its class; one group may
    be in both. Too few groups raise, unless not strict."""
    one = one_per_group(df, group, key, seed, label)
    parts = [_first(one.filter(F.col(label) == y), n, [keyed(group, seed), F.col(group)]) for y, n in ((1, n_pos), (0, n_neg))]
    if strict:
        for (y, n), p in zip(((1, n_pos), (0, n_neg)), parts):
            got = p.count()
            if got < n:
                raise ContractError(f"class {y}: {got} groups, {n} needed")
    return parts[0].unionByName(parts[1])


def class_sample(df: DataFrame, label: str, value: int, group: str, key: str, n: int, seed: int = RANDOM_SEED, excluded: DataFrame | None = None) -> DataFrame:
    """Up to n rows of a class, one of each group, without the groups of `excluded`."""
    part = df.filter(F.col(label) == value)
    if excluded is not None:
        part = part.join(excluded.select(group).distinct(), group, "left_anti")
    return _first(one_per_group(part, group, key, seed), n, [keyed(key, seed), F.col(key)])


def stratified_downsample(df: DataFrame, stratum: str, label: str, key: str, seed: int = RANDOM_SEED) -> DataFrame:
    """Every stratum cut to the size of the smallest, keeping its share of label 1 (rounded half to even, one
    at least)."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    least = sizes.agg(F.min("n").alias("least"))
    want = sizes.crossJoin(F.broadcast(least)).select(stratum, F.greatest(F.lit(1), F.bround(F.col("least") * F.col("pos") / F.col("n"), 0).cast("long")).alias("want_pos"), "least")
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(stratum, label).orderBy(keyed(key, seed), F.col(key))))
    limit = F.when(F.col(label) == 1, F.col("want_pos")).otherwise(F.col("least") - F.col("want_pos"))
    return ranked.join(F.broadcast(want), stratum).filter(F.col("__n") <= limit).drop("__n", "want_pos", "least")


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = RANDOM_SEED) -> DataFrame:
    """df with `fold` (0 to k - 1): groups never straddle folds, and groups of either majority label are dealt
    round by their hash. Counting is by group, so a hot group is one row of the ranking."""
    groups = df.groupBy(group).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("major"))
    fold = ((F.row_number().over(Window.partitionBy("major").orderBy(keyed(group, seed), F.col(group))) - 1) % k).cast("int")
    return df.join(groups.select(group, fold.alias("fold")), group)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = RANDOM_SEED) -> DataFrame:
    """Folds of single rows, each label dealt round: the fallback where groups are too few."""
    fold = ((F.row_number().over(Window.partitionBy(label).orderBy(keyed(key, seed), F.col(key))) - 1) % k).cast("int")
    return df.withColumn("fold", fold)
