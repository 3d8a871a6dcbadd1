"""From raw documents to packed training sequences, in five stages; each is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import common, exact, language, packing, simhash, toxicity

#: Least posterior of a document's language.
LEAST_SCORE = 0.5
#: Words of 64 rows' verdicts that are broadcast at most; one takes some 64 bytes of memory.
WORDS = 1 << 20


def _passing(docs: DataFrame, predict, model, condition) -> DataFrame:
    """docs' rows for which the prediction meets the condition. Columns are numbered meanwhile, so that none
    of docs' clashes with a prediction's."""
    apart = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = predict(apart, model, *apart.columns, text_col=f"c{docs.columns.index('text')}").filter(condition)
    return out.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and a language found with a posterior of LEAST_SCORE or more stay.

    Decided row by row, so repeated rows fare alike; null and empty texts go. Learned from these documents. All
    columns pass through, and an empty table stays empty."""
    return _passing(docs, language.predict, language.train(docs), (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay, null and empty texts among them; learned from these documents and the
    labels table. Decided row by row, so repeated rows fare alike; an empty table stays empty."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _passing(docs, toxicity.predict, model, F.col("score") < 0.5)


def _parquet(docs: DataFrame) -> bool:
    """Whether docs is what Parquet files hold, row by row, each file once."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or str(plan.relation().fileFormat().toString()) != "Parquet":
        return False
    return len(plan.relation().location().inputFiles()) == len(docs._jdf.inputFiles())  # the latter has each once


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of row numbers, the same in every read, and its name: ids can be null or repeat, rows can't.

    A number is the file's, in order of paths, and the row's place in it. What doesn't lie in Parquet files is written first."""
    row = "row_number"
    while row in docs.columns:
        row += "_"
    docs = docs if _parquet(docs) else common.written(docs, "documents")
    at = docs.metadataColumn("_metadata")
    files = docs.select(at["file_path"].alias("path")).distinct().coalesce(1).sortWithinPartitions("path")
    files = common.written(files.select("path", F.monotonically_increasing_id().alias("file")), "files")
    placed = docs.select("*", F.struct(at["file_path"].alias("path"), at["row_index"].alias("place")).alias(row))
    number = F.shiftleft(files["file"], 40) + placed[row]["place"]
    # Met by hash, for which a broadcast takes few bytes (one by text takes a page of memory in each executor); then by the path itself.
    here, there = placed[row]["path"], files["path"]
    joined = placed.join(F.broadcast(files), (F.xxhash64(here) == F.xxhash64(there)) & here.startswith(there) & there.startswith(here))
    return joined.select(*[placed[f"`{x}`"] for x in docs.columns], number.alias(row)), row


def _kept(docs: DataFrame, found: DataFrame, row: str) -> DataFrame:
    """docs' rows that found has as kept, without the row number.

    Verdicts travel to the texts, not texts to the verdicts: a bit for each row, in words of 64. Over WORDS words, both
    meet in a shuffle."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(row).bitwiseAND(63).cast("int"))
    words = found.filter("kept").groupBy(F.shiftright(row, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = common.written(words, "kept-rows")
    near = F.broadcast(words) if words.count() <= WORDS else words
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), docs[row].bitwiseAND(63).cast("int"))
    out = docs.join(near, F.shiftright(docs[row], 6) == words["word"]).filter(words["bits"].bitwiseAND(bit) != 0)
    return out.select(*[docs[f"`{x}`"] for x in docs.columns if x != row])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays: the longest, then that with the smallest doc_id, null ones
    last, then the first. Null and empty texts are equal; an empty table stays empty."""
    docs, row = _numbered(docs)
    return _kept(docs, exact.exact_duplicates(docs, row_col=row), row)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal fingerprints one stays: that with the smallest doc_id, null ones last, then
    the first. Null and empty texts have fingerprint zero; an empty table stays empty."""
    docs, row = _numbered(docs)
    return _kept(docs, simhash.near_duplicates(docs, row_col=row), row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of 2048: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("best_fit_packing", pack)]

#: SQL can't express the models, fingerprints and tokenizer of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
