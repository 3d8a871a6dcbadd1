"""Exact dedup against a persistent digest index: a table bucketed and sorted by digest.

New data is hashed, reduced to one row for each digest, held against the index by a sort-merge anti-join
on its buckets, and what is new is appended. DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def normalised(text: Column) -> Column:
    """text without the six ASCII white-space characters; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), common.WHITE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, length, digest) of every row; texts stay where they are read. row is null without a row_col."""
    text, row = docs[f"`{text_col}`"], docs[f"`{row_col}`"] if row_col else F.lit(None)
    return docs.select(docs[f"`{id_col}`"].alias("id"), row.cast("long").alias("row"), F.char_length(F.coalesce(text, F.lit(""))).alias("length"), F.sha2(normalised(text).cast("binary"), 256).alias("digest"))


class DigestIndex:
    """digest -> keep_id, keep_length, of the row that stays; one row per digest, bucketed and sorted by it.

    The table lives at `path` in shared storage. attach() of an existing path goes on with what is there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self._ready = False

    def attach(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, keep_length INT, group_size BIGINT) USING parquet OPTIONS (path '{self.path}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        self._ready = True
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> DataFrame:
        """rows: (id, row, length, digest) of new data. Appends digests that are new, with the row that stays: the
        longest original text, then the smallest id (null ids last), then the smallest row. Returns (digest,
        keep_id, keep_length, group_size, keep_row) of the digests that were added; those the index had keep
        their old row. The table is sorted anew within a bucket when it has been appended to."""
        # Bitwise not turns the order round as minus does, without an overflow at the least id.
        best = F.max(F.struct(F.col("length"), F.col("id").isNotNull().alias("has"), F.bitwise_not("id").alias("minus"), F.bitwise_not("row").alias("row"))).alias("best")
        groups = rows.groupBy("digest").agg(best, F.count("*").alias("group_size"))
        groups = groups.select("digest", F.bitwise_not("best.minus").alias("keep_id"), F.col("best.length").alias("keep_length"), "group_size", F.bitwise_not("best.row").alias("keep_row"))
        if self._ready:
            groups = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        groups = common.written(groups, "new-digests")
        writer = groups.drop("keep_row").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        if self._ready:
            writer.mode("append").saveAsTable(self.table)
        else:
            writer.option("path", self.path).saveAsTable(self.table)
            self._ready = True
        return groups


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows whose texts are equal without white space form a group; the longest original, then the smallest id
    stays. Null texts are empty and empty texts are one group. Rows with a null id are kept rows only if the
    whole group has none; of repeated ids with equal text all count as kept. With an index that already has
    a digest, none of the new rows stays: keep_id is the index's row. With row_col, a column of distinct
    numbers, exactly one row of a new group is kept, of those that tie the smallest, and the column comes
    along. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # A new index is an empty table, so that it goes through the same anti-join and append as one with rows.
    index = index or DigestIndex(spark, common.fresh(spark, "digest-index"), buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))).attach()
    rows = common.written(digests(docs, id_col, text_col, row_col), "digests")
    added = index.add(rows)
    if row_col:
        known = index.rows().join(added.select("digest", "keep_row"), "digest", "left")
        out = common.joined_on_hot(rows, known, "digest", "group_size")
        return out.select(F.col("row").alias(row_col), F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))
    out = common.joined_on_hot(rows, index.rows(), "digest", "group_size")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
