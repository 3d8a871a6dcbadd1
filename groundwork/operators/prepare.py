"""From raw corpora to labelled samples: labels, serialisation, joins, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork import contracts
from groundwork.constants import EXPECTED_SPLIT_ROWS, SYSTEM_SCORE_IDS
from groundwork.functions import text as X


def label_not_implicit(labels: Column) -> Column:
    """1 if any annotation is not marked implicitly true; missing marks count as not marked."""
    return F.when(F.coalesce(F.exists(labels, lambda x: ~F.coalesce(x["implicit_true"], F.lit(False))), F.lit(False)), 1).otherwise(0)


def label_any(labels: Column) -> Column:
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, 1).otherwise(0)


def label_unfaithful(faithful: Column) -> Column:
    return (faithful < 1.0 - 1e-12).cast("int")


def label_not_factual(verdict: Column) -> Column:
    """1 unless the verdict is one of those that mean "factual"."""
    return (~F.lower(F.coalesce(verdict.cast("string"), F.lit("nan"))).isin("factual", "no", "false", "0", "nan")).cast("int")


def serialize_source(task: Column, raw: Column, collapse: bool = True) -> Column:
    """Struct (context, query) of a raw JSON source: passages and question of a QA source, the string of a
    summary source, the object itself of a data source; any other task raises."""
    clean = X.collapse if collapse else (lambda c: c)
    v = F.parse_json(raw)
    field = lambda name: clean(F.coalesce(F.variant_get(v, name, "string"), F.lit("")))
    pair = lambda c, q: F.struct(c.alias("context"), q.alias("query"))
    unknown = F.raise_error(F.concat(F.lit("unknown task type: "), F.coalesce(task, F.lit("null")))).cast("struct<context:string,query:string>")
    return F.when(task == "QA", pair(field("$.passages"), field("$.question"))).when(task == "Summary", pair(clean(F.variant_get(v, "$", "string")), F.lit(""))).when(task == "Data2txt", pair(F.to_json(v), F.lit(""))).otherwise(unknown)


def flatten_source(raw: Column) -> Column:
    """A source of any shape as lines of text: the string itself, question and passages, or the fields of a
    business record, hours and attributes as "key value" lists, stars, review texts."""
    v = F.parse_json(raw)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    full = lambda c: F.when(c != "", c)
    listed = lambda name, m: F.when(m.isNotNull(), F.concat(F.lit(f"{name}: "), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(" ", e["key"], e["value"])), "; ")))
    attributes = F.map_filter(get("$.attributes", "map<string,string>"), lambda k, x: x.isNotNull() & (x != "None"))
    reviews = F.array_join(F.filter(F.transform(F.coalesce(get("$.review_info", "array<struct<review_text:string>>"), F.array().cast("array<struct<review_text:string>>")), lambda r: r["review_text"]), lambda t: t.isNotNull() & (t != "")), "\n")
    fields = [F.when(full(get(f"$.{k}")).isNotNull(), F.concat(F.lit(f"{k}: "), get(f"$.{k}"))) for k in ("name", "address", "city", "state", "categories")]
    stars = F.when(get("$.business_stars").isNotNull(), F.concat(F.lit("business stars: "), get("$.business_stars")))
    record = F.concat_ws("\n", *fields, listed("hours", get("$.hours", "map<string,string>")), listed("attributes", attributes), stars, full(reviews))
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", get("$")).when(get("$.question", "variant").isNotNull(), F.concat_ws("\n", full(get("$.question")), full(get("$.passages")))).otherwise(record)


def source_text(raw: Column) -> Column:
    """A string source as it is, any other as JSON."""
    v = F.parse_json(raw)
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """table's value for key, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def join_sources(responses: DataFrame, sources: DataFrame, missing: str = "error", defaults: dict[str, str] | None = None) -> DataFrame:
    """responses with their source's columns. missing: "error", or "default" to keep rows without a source, with
    defaults in its columns (task_type "?" and an empty source object)."""
    if missing == "error":
        return contracts.join(responses, sources, ["source_id"], require_match=True)
    out = responses.join(sources, "source_id", "left")
    filled = {"task_type": "?", "source_info": "{}"} | (defaults or {})
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items() if c in sources.columns})


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean Faithful and Factual for each (system_key, bbcid), keys split off "<system>_<id>"; rows without a
    key are dropped, missing scores skipped."""
    system, bbcid = X.rsplit_once(F.col("system_bbcid"))
    keyed = scores.select(system.alias("system_key"), X.normalize_bbcid(bbcid).alias("bbcid"), "Faithful", "Factual").dropna(subset=["system_key", "bbcid"])
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    return keyed.groupBy("system_key", "bbcid").agg(F.avg(value("Faithful")).alias("Faithful"), F.avg(value("Factual")).alias("Factual"))


def prepare_responses(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """Samples of the response corpus: responses, and sources (source_id, task_type, source_info as raw JSON)."""
    pair = serialize_source(F.col("task_type"), F.col("source_info"))
    joined = join_sources(responses, sources).withColumn("pair", pair)
    return joined.select(
        F.col("id").cast("string").alias("sample_id"), F.col("source_id").cast("string").alias("source_id"), "task_type", F.col("pair.context").alias("context"), F.col("pair.query").alias("query"),
        X.collapse(F.col("response")).alias("response"), F.col("model").alias("generator_model"), "quality", label_not_implicit(F.col("labels")).alias("hallucinated"), F.to_json("labels").alias("raw_labels"), F.col("split").alias("original_split"),
    )


def prepare_summaries(annotations: DataFrame, scores: DataFrame, articles: DataFrame) -> DataFrame:
    """Samples of the summary corpus: annotations (bbcid, system, summary, line), one row for each (bbcid,
    system, summary), with mean scores and the article's text; rows without either are left out."""
    known = annotations.withColumn("system_key", lookup(F.col("system"), SYSTEM_SCORE_IDS)).withColumn("bbcid", X.normalize_bbcid(F.col("bbcid"))).dropna(subset=["system_key", "bbcid", "summary"])
    known = contracts.first_rows(known, ["bbcid", "system", "summary"], F.col("line"))
    joined = contracts.join(known, mean_scores(scores), ["system_key", "bbcid"]).dropna(subset=["Faithful"])
    text = contracts.unique(articles.select(X.normalize_bbcid(F.col("id")).alias("bbcid"), F.col("document").alias("context")), "bbcid")
    joined = joined.join(text, "bbcid")
    return joined.select(
        F.concat_ws("::", "system_key", "bbcid").alias("sample_id"), F.col("bbcid").alias("source_id"), F.lit("XSum").alias("task_type"), X.collapse(F.col("context")).alias("context"), F.lit("").alias("query"),
        X.collapse(F.col("summary")).alias("response"), F.col("system").alias("generator_model"), label_unfaithful(F.col("Faithful")).alias("hallucinated"), "Faithful", "Factual",
    )


def assign_splits(samples: DataFrame, assignment: DataFrame, key: str = "source_id") -> DataFrame:
    """samples with `split` from assignment (key, split); sources it doesn't name are train."""
    contracts.unique(assignment, key)
    return samples.join(F.broadcast(assignment) if _small(assignment) else assignment, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def manifest_assignment(manifest: DataFrame, dataset: str) -> DataFrame:
    """(source_id, split) of a split manifest's dataset."""
    d = manifest.select(F.element_at("datasets", dataset).alias("d"))
    part = lambda name, split: d.select(F.explode(f"d.{name}").alias("source_id"), F.lit(split).alias("split"))
    return part("validation", "val").unionByName(part("test", "test"))


def split_by_manifest(samples: DataFrame, manifest: DataFrame, dataset: str) -> DataFrame:
    """Splits under four contracts: the number of sources, their digest, disjoint lists, all of them known."""
    want = manifest.select(F.element_at("datasets", dataset).alias("d")).select("d.source_count", "d.source_ids_sha256").first()
    got = contracts.digest(samples, "source_id").first()
    if (got["source_count"], got["digest"]) != (want[0], want[1]):
        raise contracts.ContractError(f"{dataset}: the sources are not those of the manifest")
    assignment = manifest_assignment(manifest, dataset)
    contracts.unique(assignment, "source_id")
    contracts.covered(assignment, samples.select("source_id").distinct(), "source_id")
    return assign_splits(samples, assignment)


def expected_rows(samples: DataFrame, dataset: str) -> DataFrame:
    """samples, if train, val and test have as many rows as the published corpus."""
    got = {r["split"]: r["count"] for r in samples.groupBy("split").count().collect()}
    if tuple(got.get(x, 0) for x in ("train", "val", "test")) != EXPECTED_SPLIT_ROWS[dataset]:
        raise contracts.ContractError(f"{dataset}: rows by split are {got}, {EXPECTED_SPLIT_ROWS[dataset]} expected")
    return samples


def leading(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns first and all others behind them."""
    return df.select(*names, *[c for c in df.columns if c not in names])


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Columns whose name holds part, whatever the case."""
    return [c for c in df.columns if part.lower() in c.lower()]
