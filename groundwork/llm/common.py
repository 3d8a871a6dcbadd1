"""What the operators share: scratch tables, skew-safe joins, components, small numeric helpers."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters of the contracts, ``[\x20\x09-\x0D]``.
WHITE = " \t\n\v\f\r"

_ARROW_ROWS = "512"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset a temporary one, in local mode only,
    where all of Spark is on this machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="groundwork-")
        atexit.register(shutil.rmtree, at[7:], True)
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts can be long, and a Python worker holds a batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _ARROW_ROWS)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what runs in the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def partitions(df: DataFrame, each: int) -> int:
    """As many partitions as shuffles have, and more where df's files, by Catalyst's estimate, hold over `each` bytes for one."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // each), 100_000)) if size < 1 << 60 else least


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written here go as soon as it is written."""
    had = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, had)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._groundwork_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_groundwork_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra columns of any name do no harm; a missing one is an error."""
    return df.select(*[df[f"`{x}`"] for x in names])


def crc32_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def id_crc(value) -> int:
    """Python's side of crc32_of_id; a null id counts as 0."""
    return 0 if value is None else zlib.crc32(str(value).encode())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (multiply and xor-shift)."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def joined_on_hot(left: DataFrame, groups: DataFrame, key: str, size: str, share: int = 10_000) -> DataFrame:
    """left joined to groups (one row per key, its row count in `size`) on key, safe for hot keys.

    A key that holds over 1/share of all rows is hot. There are fewer than `share` such keys whatever the
    input, of a short row each, so that side is broadcast; all other keys meet in a shuffle in which none can
    dominate, and which Spark splits further where it finds a long partition.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * share > total)
    cold = groups.filter(F.col(size) * share <= total)
    if total < 10_000 or hot.isEmpty():
        return left.join(groups, key)
    near = left.join(F.broadcast(hot), key)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for the components of these edges, members that are not smallest only."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, m = len(nodes), len(a)
    u, v = inverse[:m], inverse[m:]
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(n)
    return nodes[keep], nodes[root[keep]]


def _contract(batches, most: int = 400_000):
    held, n = [], 0

    def forest():
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in local_forest(a, b)], ["a", "b"])

    for batch in batches:
        held.append([np.asarray(batch.column(i)) for i in (0, 1)])
        n += batch.num_rows
        if n >= most:
            yield forest()
            held, n = [], 0
    if n:
        yield forest()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node on an edge (columns a, b: long) that is not the smallest of its
    component; component is that smallest node.

    Alternating large and small stars; each round is a group-by minimum (combined before the shuffle) and
    a join, and is checkpointed. Edges are first contracted batch by batch, so a dense group leaves a
    forest. Nothing is collected but a row count and a checksum. It ends when these settle; if that takes
    more than `rounds` rounds (where given), it is an error.
    """
    spark = edges.sparkSession
    scratch(spark)
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = e.mapInArrow(_contract, "a long, b long").distinct().checkpoint()
    state = None
    for n in itertools.count():
        if n == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        e = (
            down.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.*")
            .filter("a <> b")
            .distinct()
            .checkpoint()
        )
        new = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")


def mapped(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def local_table(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A few rows of the driver's, by way of Arrow: rows that Python pickles are read by a second set of Python workers,
    which then stay on the executors."""
    columns = {name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(kinds.items())}
    return spark.createDataFrame(pa.table(columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
