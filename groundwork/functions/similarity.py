"""Name similarity: native guards and scores, and one Arrow UDF for the character ratio, only where it can matter."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as X

#: Rows of a group that meet at once, about; and pairs of rows to a task, about.
BLOCK, PAIRS_IN_TASK = 2048, 1 << 23


@F.pandas_udf(DoubleType())
def character_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of the standard library; its arguments are not interchangeable. Null if either is."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def native_similarity(a: Column, b: Column) -> Column:
    """Best of token F1, containment and acronym."""
    return F.greatest(X.token_f1(a, b), X.containment(a, b), X.acronym(a, b))


def with_similarity(pairs: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """pairs of normalised names with their similarity: 0 for empty names or different numbers, 1 for equal
    names, else the best of all scores.

    Distinct pairs only are scored. A ratio is at most 2 min / (sum of lengths): where that can't beat the
    native scores, Python isn't asked."""
    a, b = F.col(left), F.col(right)
    distinct = pairs.select(a, b).distinct()
    la, lb = F.char_length(a), F.char_length(b)
    fixed = F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).when(X.numbers_differ(a, b), 0.0)
    best = distinct.withColumn("fixed", fixed).withColumn("native", F.when(F.col("fixed").isNull(), native_similarity(a, b)))
    open_ = F.col("fixed").isNull() & (2 * F.least(la, lb) / (la + lb) > F.col("native"))
    # A null argument costs the UDF nothing.
    ratio = character_ratio(F.when(open_, a), F.when(open_, b))
    scored = best.withColumn("ratio", ratio).select(left, right, F.coalesce("fixed", F.greatest("native", F.coalesce("ratio", F.lit(0.0)))).alias(out))
    return pairs.join(scored, [left, right])


def scored_pairs(rows: DataFrame, by: list[str], key: str, name: str, left: Callable[[Column], Column], right: Callable[[Column], Column], score: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """a_id, b_id and out = score(left(name of a), right(name of b)) for every two rows alike in `by`, a the one of
    the lesser key. Nulls in `by` and keys pair with nothing.

    Names are read once a row, before rows meet. A group is dealt by key to blocks of some BLOCK rows, any two of
    which meet in one place, so that a large group is many tasks' work and no pair is shuffled. Equal names of a
    block are scored once against a row; their keys lie in one array, spelled out behind the score."""
    rows = rows.select(*by, F.col(key).alias("id"), F.col(name).alias("name")).dropna(subset=[*by, "id"])
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0
    tasks = min(max(rows.sparkSession.sparkContext.defaultParallelism, round(pairs / PAIRS_IN_TASK)), 20_000)
    dealt = rows.join(sizes.select(*by, F.ceil(F.col("n") / BLOCK).alias("blocks")), by).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    at = [*by, "i", "j"]
    a = dealt.select(*by, F.col("own").alias("i"), others.alias("j"), F.col("id").alias("a_id"), left(F.col("name")).alias("x")).repartition(tasks, *at)
    b = dealt.select(*by, others.alias("i"), F.col("own").alias("j"), "id", "name").repartition(tasks, *at)
    b = b.groupBy(*at, "name").agg(F.collect_list("id").alias("ids"), F.max("id").alias("last")).select(*at, "ids", "last", right(F.col("name")).alias("y"))
    met = a.join(b.hint("merge"), at).filter(F.col("a_id") < F.col("last")).select("a_id", "ids", score(F.col("x"), F.col("y")).alias(out))
    return met.select("a_id", F.explode("ids").alias("b_id"), out).filter("a_id < b_id")
