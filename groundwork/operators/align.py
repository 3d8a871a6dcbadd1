"""Alignment of response graphs with their context: support of names and relations, feature rows, components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.constants import ENTITY_MATCH_THRESHOLD
from groundwork.functions import text as X
from groundwork.functions.similarity import with_similarity

from . import graphs


def side(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("side") == name).drop("side")


def weighted_bad_rate(confidence, bad):
    """Share of confidence on bad rows: 0 without rows, their plain share where all confidences are 0."""
    total = F.sum(confidence)
    return F.when(F.count(confidence) == 0, 0.0).when(total == 0, F.avg(bad.cast("double"))).otherwise(F.sum(F.when(bad, confidence).otherwise(0.0)) / total)


def status(context_names: Column, response_names: Column) -> Column:
    """Whether a sample can be predicted, by its numbers of names; null counts as none."""
    none = lambda n: F.coalesce(n, F.lit(0)) == 0
    return F.when(none(context_names), "no_context_entities").when(none(response_names), "no_response_entities").otherwise("predicted")


def supported_names(names: DataFrame) -> DataFrame:
    """names (graphs.names_by_side) with the support of response names; null for names of the context alone."""
    in_context, in_response = F.col("context").isNotNull(), F.col("response").isNotNull()
    open_ = names.filter(in_response & ~in_context).select("sample_id", F.col("key").alias("left_name"))
    pairs = open_.join(names.filter(in_context).select("sample_id", F.col("key").alias("right_name")), "sample_id")
    best = with_similarity(pairs, "left_name", "right_name").groupBy("sample_id", F.col("left_name").alias("key")).agg(F.max("similarity").alias("best"))
    support = F.when(in_response & in_context, 1.0).when(in_response, F.coalesce("best", F.lit(0.0)))
    return names.join(best, ["sample_id", "key"], "left").select("sample_id", "key", "context", "response", support.alias("support"))


def feature_rows(samples: DataFrame, entities: DataFrame, relations: DataFrame, key=X.norm, names: DataFrame | None = None) -> DataFrame:
    """The 17-column feature row of every sample (sample_id, task_type), from long graph tables.

    names: supported_names of the graphs, if at hand. They are read three times, so a caller with a place for
    tables hands in a written or persisted one. Each triple is looked up once, however often it comes."""
    names = supported_names(graphs.names_by_side(entities, relations, key)) if names is None else names
    in_context, in_response = F.col("context").isNotNull(), F.col("response").isNotNull()
    bad = F.col("support") < ENTITY_MATCH_THRESHOLD
    of_response = lambda x: F.when(in_response, x)
    scored = lambda score: F.coalesce(F.avg(F.when(F.col(score) > 0, F.col(score))), F.lit(0.0))
    n = names.groupBy("sample_id").agg(
        F.count("context").alias("nc"), scored("context").alias("cc"), F.count("response").alias("nr"), scored("response").alias("rc"),
        weighted_bad_rate(F.col("response"), bad).alias("weighted"), F.avg(of_response(bad.cast("double"))).alias("fuzzy"),
        F.count_if(in_response & ~in_context).alias("unknown"), F.min("support").alias("least"), F.avg("support").alias("mean"),
    )

    triples = graphs.counted_triples(side(relations, "response"), key)
    for end in ("head", "tail"):
        found = names.select("sample_id", F.col("key").alias(end), F.coalesce("support", F.lit(0.0)).alias(f"{end}_s"), in_context.alias(f"{end}_known"))
        triples = triples.join(found, ["sample_id", end], "left")
    poor = lambda end: F.coalesce(F.col(f"{end}_s"), F.lit(0.0)) < ENTITY_MATCH_THRESHOLD
    novel = ~F.coalesce("head_known", F.lit(False)) | ~F.coalesce("tail_known", F.lit(False))
    t = triples.groupBy("sample_id").agg(
        F.count("*").alias("n_triples"), F.avg(novel.cast("double")).alias("novel_rate"),
        (F.sum(F.when(poor("head") | poor("tail"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fuzzy_rel"),
    )

    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    none = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    out = samples.select("sample_id", "task_type").join(n, "sample_id", "left").join(t, "sample_id", "left")
    state = status(F.col("nc"), F.col("nr"))
    return out.select(
        "sample_id", "task_type", state.alias("status"), (state == "predicted").cast("int").alias("can_predict"), zero("nc").alias("context_entity_count"), zero("nr").alias("response_entity_count"), zero("n_triples").alias("response_relation_count"),
        none("weighted").alias("weighted_ungrounded_entity_rate"), (zero("nr") / F.greatest(zero("nc"), F.lit(1))).alias("response_context_entity_ratio"), F.log1p(zero("n_triples")).alias("log_response_relation_count"),
        none("fuzzy_rel").alias("fuzzy_novel_endpoint_relation_rate"), none("fuzzy").alias("fuzzy_ungrounded_entity_rate"), (none("rc") - none("cc")).alias("entity_confidence_gap"),
        F.log1p(zero("unknown")).alias("ungrounded_response_entity_count_log"), none("least").alias("min_entity_support_similarity"), none("mean").alias("mean_entity_support_similarity"), none("rc").alias("mean_response_entity_confidence"), none("novel_rate").alias("novel_endpoint_relation_rate"),
    )


def strict_novel(relations: DataFrame, context_names: DataFrame, key=X.norm) -> DataFrame:
    """(sample_id, n_triples, n_novel, novel_rate) of unique response triples with an end outside the context."""
    triples = side(graphs.unique_triples(relations, key), "response")
    for end in ("head", "tail"):
        triples = triples.join(context_names.select("sample_id", F.col("key").alias(end), F.lit(True).alias(f"{end}_known")), ["sample_id", end], "left")
    novel = F.col("head_known").isNull() | F.col("tail_known").isNull()
    return triples.groupBy("sample_id").agg(F.count("*").alias("n_triples"), F.count_if(novel).alias("n_novel"), F.avg(novel.cast("double")).alias("novel_rate"))


def grounding(samples: DataFrame, response: DataFrame, reference: DataFrame, empty: str = "null") -> DataFrame:
    """samples with n_answer, n_shared and eg, the share of response names found among the reference names.
    response, reference: (sample_id, key), distinct. empty: eg of a sample without names: "null" or "one";
    "drop" leaves such samples out."""
    hit = response.join(reference.withColumn("hit", F.lit(1)), ["sample_id", "key"], "left").groupBy("sample_id").agg(F.count("*").alias("n_answer"), F.count("hit").alias("n_shared"))
    out = samples.join(hit, "sample_id", "inner" if empty == "drop" else "left").withColumn("n_answer", F.coalesce("n_answer", F.lit(0))).withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    eg = F.try_divide(F.col("n_shared").cast("double"), F.col("n_answer").cast("double"))
    return out.withColumn("eg", F.coalesce(eg, F.lit(1.0)) if empty == "one" else eg)


def soft_matches(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """Rows (sample_id, name) of left that soft_in any name of right in the same sample."""
    other = right.select(F.col("sample_id").alias("o_id"), F.col("name").alias("o_name"))
    return left.join(other, (F.col("sample_id") == F.col("o_id")) & X.soft_in(F.col("name"), F.col("o_name"), least), "left_semi")


def soft_grounded(answer: DataFrame, context: DataFrame, least: int = 3) -> DataFrame:
    """Rows of answer with a context name of `least` characters or more that holds, or is held by, the name."""
    other = context.filter(F.char_length("name") >= least).select(F.col("sample_id").alias("o_id"), F.lower("name").alias("o_name"))
    low = F.lower("name")
    return answer.join(other, (F.col("sample_id") == F.col("o_id")) & (low.contains(F.col("o_name")) | F.col("o_name").contains(low)), "left_semi")


def soft_triples(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted triples (sample_id, head, tail) that match a gold one in both ends; relations don't count."""
    g = gold.select(F.col("sample_id").alias("o_id"), F.col("head").alias("o_head"), F.col("tail").alias("o_tail"))
    return predicted.join(g, (F.col("sample_id") == F.col("o_id")) & X.soft_in(F.col("head"), F.col("o_head")) & X.soft_in(F.col("tail"), F.col("o_tail")), "left_semi")


def supported_relations(response: DataFrame, reference: DataFrame, key=X.normalize_entity) -> DataFrame:
    """Response relations (bag) with a reference relation of equal id and ends."""
    keyed = lambda d: d.withColumn("head", key(F.col("head_text"))).withColumn("tail", key(F.col("tail_text"))).filter("head <> '' and tail <> ''")
    return keyed(response).join(keyed(reference).select("sample_id", "relation_id", "head", "tail").distinct(), ["sample_id", "relation_id", "head", "tail"], "left_semi")


def _largest(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"]):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes: dict[str, int] = {}
    for x in parent:
        nodes[find(x)] = nodes.get(find(x), 0) + 1
    best = min(nodes, key=lambda r: (-nodes[r], r))
    return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "largest_edges": [sum(find(a) == best for a in pdf["a"])]})


def largest_component(edges: DataFrame) -> DataFrame:
    """(sample_id, largest_edges): edges within the component of most nodes (the one with the smallest name on
    ties) of each sample's simple undirected graph. edges: (sample_id, head, tail). A graph is one answer's."""
    simple = edges.select(F.col("sample_id").cast("string").alias("sample_id"), F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).distinct()
    return simple.groupBy("sample_id").applyInPandas(_largest, "sample_id string, largest_edges long")


def alignment_metrics(samples: DataFrame, entities: DataFrame, relations: DataFrame, key=X.normalize_entity) -> DataFrame:
    """eg, rp, sc, flags of those missing, and sizes of each sample's graphs; sides context, query, response.
    The reference is the union of context and query."""
    ref_e, ref_r = (d.filter(F.col("side").isin("context", "query")) for d in (entities, relations))
    names = lambda d: d.select("sample_id", key(F.col("text")).alias("key")).filter("key <> ''").distinct()
    out = grounding(samples, names(side(entities, "response")), names(ref_e)).drop("n_answer", "n_shared")
    response = side(relations, "response")
    supported = supported_relations(response, ref_r, key)
    n_all = response.groupBy("sample_id").agg(F.count("*").alias("n_response_relations"))
    n_good = supported.groupBy("sample_id").agg(F.count("*").alias("n_supported"))
    counts = [n_all, n_good, largest_component(supported)]
    for name, d in (("n_context_entities", side(entities, "context")), ("n_context_relations", side(relations, "context")), ("n_response_entities", side(entities, "response"))):
        counts.append(d.groupBy("sample_id").agg(F.count("*").alias(name)))
    for part in counts:
        out = out.join(part, "sample_id", "left")
    n = [x for p in counts for x in p.columns if x != "sample_id"]
    out = out.withColumns({x: F.coalesce(x, F.lit(0)) for x in n})
    out = out.withColumns({"rp": F.try_divide(F.col("n_supported").cast("double"), F.col("n_response_relations").cast("double")), "sc": F.try_divide(F.col("largest_edges").cast("double"), F.col("n_response_relations").cast("double"))})
    flags = {f"missing_{x}": F.col(x).isNull().cast("int") for x in ("eg", "rp", "sc")} | {f"{a}_{b}_empty": (F.col(f"n_{a}_{p}") == 0).cast("int") for a in ("context", "response") for b, p in (("entity", "entities"), ("relation", "relations"))}
    return out.withColumns(flags).drop("n_supported", "largest_edges")


# Alignment with gold clusters: clusters (sample_id, cluster_id, name), one row for each mention.


def aligned_cluster(names: DataFrame, clusters: DataFrame, key=X.normalize_entity) -> DataFrame:
    """(sample_id, key, cluster_id): the single cluster a name belongs to; ambiguous names are left out."""
    known = clusters.select("sample_id", key(F.col("name")).alias("key"), "cluster_id").filter("key <> ''").distinct()
    hit = names.select("sample_id", "key").distinct().join(known, ["sample_id", "key"])
    return hit.groupBy("sample_id", "key").agg(F.min("cluster_id").alias("cluster_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


def aligned_triples(relations: DataFrame, clusters: DataFrame, key=X.normalize_entity) -> DataFrame:
    """Distinct (sample_id, h, r, t) of predicted relations, ends as cluster numbers. Relations with an end
    that has no cluster of its own, or both in one, get negative numbers by their canonical key: each stays
    one false positive."""
    rel = relations.select("sample_id", key(F.col("head_text")).alias("hk"), F.col("relation_id").alias("r"), key(F.col("tail_text")).alias("tk"))
    found = aligned_cluster(rel.select("sample_id", F.explode(F.array("hk", "tk")).alias("key")), clusters, key)
    for k, c in (("hk", "h"), ("tk", "t")):
        rel = rel.join(found.select("sample_id", F.col("key").alias(k), F.col("cluster_id").cast("long").alias(c)), ["sample_id", k], "left")
    bad = F.col("h").isNull() | F.col("t").isNull() | (F.col("h") == F.col("t"))
    number = F.pmod(F.xxhash64("hk", "r", "tk"), F.lit(10**15))
    return rel.select("sample_id", F.when(bad, -number - 1).otherwise(F.col("h")).alias("h"), "r", F.when(bad, -number - 2).otherwise(F.col("t")).alias("t")).distinct()


def covered_clusters(names: DataFrame, clusters: DataFrame, key=X.normalize_entity) -> DataFrame:
    """Distinct (sample_id, cluster_id) with a mention among names (sample_id, key)."""
    return clusters.select("sample_id", "cluster_id", key(F.col("name")).alias("key")).filter("key <> ''").join(names, ["sample_id", "key"], "left_semi").select("sample_id", "cluster_id").distinct()


def endpoint_ceiling(gold: DataFrame, covered: DataFrame) -> DataFrame:
    """(sample_id, n_gold, n_reachable, ceiling): gold relations (sample_id, h, r, t) with both ends covered."""
    rel = gold.select("sample_id", "h", "r", "t").distinct()
    for end in ("h", "t"):
        rel = rel.join(covered.select("sample_id", F.col("cluster_id").alias(end), F.lit(1).alias(f"{end}_in")), ["sample_id", end], "left")
    return rel.groupBy("sample_id").agg(F.count("*").alias("n_gold"), F.count_if(F.col("h_in").isNotNull() & F.col("t_in").isNotNull()).alias("n_reachable")).withColumn("ceiling", F.try_divide(F.col("n_reachable").cast("double"), F.col("n_gold").cast("double")))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    taken, matched = set(), 0
    for options in pdf.sort_values("pos")["options"]:
        free = [c for c in options if c not in taken]
        if len(free) == 1:
            taken.add(free[0])
            matched += 1
    return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "matched": [matched], "n_pred": [len(pdf)]})


def greedy_matches(entities: DataFrame, clusters: DataFrame, key=X.normalize_entity) -> DataFrame:
    """(sample_id, matched, n_pred): distinct names in order, each taking its cluster if exactly one of those it
    belongs to is still free. Order matters, so a document is matched in one go."""
    names = entities.select(F.col("sample_id").cast("string").alias("sample_id"), key(F.col("text")).alias("key"), "pos").filter("key <> ''").groupBy("sample_id", "key").agg(F.min("pos").alias("pos"))
    known = clusters.select(F.col("sample_id").cast("string").alias("sample_id"), key(F.col("name")).alias("key"), "cluster_id").distinct().groupBy("sample_id", "key").agg(F.array_sort(F.collect_set("cluster_id")).alias("options"))
    rows = names.join(known, ["sample_id", "key"], "left").withColumn("options", F.coalesce("options", F.array().cast("array<int>")))
    return rows.groupBy("sample_id").applyInPandas(_greedy, "sample_id string, matched long, n_pred long")


def token_offsets(tokens: DataFrame) -> DataFrame:
    """tokens (sample_id, sent_id, tok_id, token) with start and end in the text that joins them by blanks."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("sent_id", "tok_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("token") + 1).over(w), F.lit(0))
    return tokens.withColumn("start", start).withColumn("end", start + F.char_length("token"))
