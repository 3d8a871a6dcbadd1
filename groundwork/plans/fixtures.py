"""Sample, entity and relation tables derived from the test tables, in Spark and as SQL text.

A labelled document is a sample: its first half is the context, its second half the response. Capitalised
words are entities, neighbouring ones are related; scores and relation ids follow from lengths.
"""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions.text import norm
from groundwork.operators import align, graphs, prepare

TASK_OF_LANGUAGE = {"en": "QA", "de": "Data2txt", "fr": "Summary", "es": "XSum"}
RELATION_IDS = ("part_of", "located_in", "spouse_of", "member_of")
ENTITY_TYPES = ("person", "location", "event")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(make):
    """The table is kept for the session, in memory or on local disk, as many queries begin with it; what is lost
    with an executor is made anew."""

    @functools.wraps(make)
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = spark.sparkContext.__dict__.setdefault("_groundwork_tables", {})
        key = (make.__name__, sf_dir)
        if key not in held or not held[key].is_cached:
            held[key] = make(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        return held[key]

    return made


@_once
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.char_length("text") / 2).cast("int")
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("source_id"), prepare.lookup(F.col("lang"), TASK_OF_LANGUAGE).alias("task_type"),
        F.substring("text", F.lit(1), half).alias("context"), F.substring("text", half + 1, F.char_length("text")).alias("response"), (1 - F.col("quality")).alias("hallucinated"), "toxic",
    )


@_once
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, side, pos, text, key, score, type."""
    sides = samples(spark, sf_dir).select("sample_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("t")) for s in ("context", "response")])).alias("x"))
    found = sides.select("sample_id", "x.side", F.posexplode(F.regexp_extract_all("x.t", F.lit(r"(\p{Lu}\p{Ll}{2,})"), F.lit(1))).alias("pos", "text"))
    key = norm(F.col("text"))
    n = F.char_length("key")
    kinds = F.array(*map(F.lit, ENTITY_TYPES))
    return found.withColumn("key", key).withColumn("score", F.when(n % 7 == 0, 0.0).otherwise(F.least(n, F.lit(12)) / 12)).withColumn("type", F.get(kinds, n % 3))


@_once
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, side, pos, head_text, relation_id, tail_text, score."""
    w = Window.partitionBy("sample_id", "side").orderBy("pos")
    e = entities(spark, sf_dir).withColumn("tail_text", F.lead("text").over(w)).filter("tail_text is not null")
    number = (F.char_length("text") + F.char_length("tail_text")) % len(RELATION_IDS)
    return e.select("sample_id", "side", "pos", F.col("text").alias("head_text"), F.get(F.array(*map(F.lit, RELATION_IDS)), number).alias("relation_id"), "tail_text", "score")


@_once
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, key, context, response, support."""
    return align.supported_names(graphs.names_by_side(entities(spark, sf_dir), relations(spark, sf_dir)))


SQL = r"""
WITH sample AS (
  SELECT d.doc_id::VARCHAR AS sample_id, d.source AS source_id,
    CASE d.lang WHEN 'en' THEN 'QA' WHEN 'de' THEN 'Data2txt' WHEN 'fr' THEN 'Summary' WHEN 'es' THEN 'XSum' END AS task_type,
    substring(d.text, 1, length(d.text) // 2) AS context, substring(d.text, length(d.text) // 2 + 1) AS response, 1 - l.quality AS hallucinated, l.toxic
  FROM documents d JOIN labels l USING (doc_id)
), sides AS (
  SELECT sample_id, 'context' AS side, context AS t FROM sample UNION ALL SELECT sample_id, 'response', response FROM sample
), found AS (
  SELECT sample_id, side, regexp_extract_all(t, '\p{Lu}\p{Ll}{2,}') AS l FROM sides
), mention AS (
  SELECT sample_id, side, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM found
), entity AS (
  SELECT *, CASE WHEN length(key) % 7 = 0 THEN 0.0 ELSE least(length(key), 12) / 12 END::DOUBLE AS score,
    (['person', 'location', 'event'])[length(key) % 3 + 1] AS type
  FROM (SELECT *, replace(lower(text), 'ß', 'ss') AS key FROM mention)
), follows AS (
  SELECT *, lead(text) OVER (PARTITION BY sample_id, side ORDER BY pos) AS tail_text FROM entity
), relation AS (
  SELECT sample_id, side, pos, text AS head_text, key AS head, tail_text, replace(lower(tail_text), 'ß', 'ss') AS tail, score,
    (['part_of', 'located_in', 'spouse_of', 'member_of'])[(length(text) + length(tail_text)) % 4 + 1] AS relation_id
  FROM follows WHERE tail_text IS NOT NULL
), node AS (
  SELECT sample_id, side, key, max(score) AS score FROM (
    SELECT sample_id, side, key, score FROM entity UNION ALL SELECT sample_id, side, head, 0.0 FROM relation UNION ALL SELECT sample_id, side, tail, 0.0 FROM relation
  ) GROUP BY ALL
), ctx AS (SELECT sample_id, key FROM node WHERE side = 'context'
), ans AS (SELECT sample_id, key, score FROM node WHERE side = 'response'
), shared AS (
  SELECT a.sample_id, count(*) AS n_answer, count(c.key) AS n_shared FROM ans a LEFT JOIN ctx c USING (sample_id, key) GROUP BY 1
), scored AS (
  SELECT s.*, coalesce(n_answer, 0) AS n_answer, coalesce(n_shared, 0) AS n_shared, n_shared::DOUBLE / n_answer AS eg, round(1 - n_shared::DOUBLE / n_answer, 6) AS risk FROM sample s LEFT JOIN shared USING (sample_id)
), triple AS (
  SELECT DISTINCT sample_id, side, CASE WHEN relation_id = 'spouse_of' THEN least(head, tail) ELSE head END AS head, relation_id, CASE WHEN relation_id = 'spouse_of' THEN greatest(head, tail) ELSE tail END AS tail FROM relation
)
"""
