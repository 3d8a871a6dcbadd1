"""Graphs as two long tables, entities and relations, each with sample, side and position.

A sample without entities has no rows here: aggregates start from the sample table and join from the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.constants import RELATIONS, SYMMETRIC_RELATIONS
from groundwork.contracts import first_rows
from groundwork.functions import text as X


def explode_graphs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of graph pairs (schemas.GRAPH_PAIR): sample_id, task_type, side, pos, fields."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_graph").alias("g")) for s in ("context", "response")])
    long = pairs.select("sample_id", "task_type", F.explode(sides).alias("x")).select("sample_id", "task_type", "x.side", "x.g")
    part = lambda name: long.select("sample_id", "task_type", "side", F.posexplode(f"g.{name}").alias("pos", "v")).select("sample_id", "task_type", "side", "pos", "v.*")
    return part("entities"), part("relations")


def clean_entities(entities: DataFrame) -> DataFrame:
    """The best-scored of entities alike in span, name and label; the first of equals."""
    keyed = entities.withColumn("__text", X.norm(F.col("text"))).withColumn("__label", X.norm(F.col("label")))
    return first_rows(keyed, ["sample_id", "side", "start", "end", "__text", "__label"], F.col("score").desc(), F.col("pos")).drop("__text", "__label")


def clean_relations(relations: DataFrame) -> DataFrame:
    """The best-scored of relations alike in both spans and id; the first of equals."""
    return first_rows(relations, ["sample_id", "side", "head_start", "head_end", "relation_id", "tail_start", "tail_end"], F.col("score").desc(), F.col("pos"))


def dedup_entities(entities: DataFrame, type_col: str = "type") -> DataFrame:
    """The best-scored of entities alike in name (normalize_entity) and type; nameless ones are dropped."""
    keyed = entities.withColumn("key", X.normalize_entity(F.col("text"))).filter("key <> ''")
    return first_rows(keyed, ["sample_id", "side", "key", type_col], F.col("score").desc(), F.col("pos"))


def dedup_relations(relations: DataFrame) -> DataFrame:
    """The best-scored of relations alike in both names and id; those with a nameless end are dropped."""
    keyed = relations.withColumn("head_key", X.normalize_entity(F.col("head_text"))).withColumn("tail_key", X.normalize_entity(F.col("tail_text"))).filter("head_key <> '' and tail_key <> ''")
    return first_rows(keyed, ["sample_id", "side", "head_key", "relation_id", "tail_key"], F.col("score").desc(), F.col("pos"))


def union_graphs(entities: list[DataFrame], relations: list[DataFrame], side: str = "reference") -> tuple[DataFrame, DataFrame]:
    """One graph of several: all rows under one side, positions graph by graph, then deduplicated."""

    def stack(parts: list[DataFrame]) -> DataFrame:
        out = None
        for i, p in enumerate(parts):
            p = p.withColumn("pos", F.col("pos").cast("long") + F.lit(i << 40)).withColumn("side", F.lit(side))
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    return dedup_entities(stack(entities)), dedup_relations(stack(relations))


def graph_entities(entities: DataFrame, relations: DataFrame, key=X.norm) -> DataFrame:
    """(sample_id, side, key, score): each distinct name with its best score; ends of relations that no entity
    names come with score 0. One aggregation with a map-side maximum (scores are not negative)."""
    named = entities.select("sample_id", "side", key(F.col("text")).alias("key"), F.coalesce("score", F.lit(0.0)).alias("score"))
    ends = relations.select("sample_id", "side", F.explode(F.array("head_text", "tail_text")).alias("text")).select("sample_id", "side", key(F.col("text")).alias("key"), F.lit(0.0).alias("score"))
    return named.unionByName(ends).filter("key <> ''").groupBy("sample_id", "side", "key").agg(F.max("score").alias("score"))


def names_by_side(entities: DataFrame, relations: DataFrame, key=X.norm) -> DataFrame:
    """(sample_id, key, context, response): each distinct name once, with its best score on either side, null where
    it isn't; ends of relations that no entity names have score 0."""
    ends = relations.select("sample_id", "side", F.explode(F.array("head_text", "tail_text")).alias("text"), F.lit(0.0).alias("score"))
    both = entities.select("sample_id", "side", "text", F.coalesce("score", F.lit(0.0)).alias("score")).unionByName(ends)
    keyed = both.select("sample_id", "side", key(F.col("text")).alias("key"), "score").filter("key <> ''")
    best = lambda side: F.max(F.when(F.col("side") == side, F.col("score"))).alias(side)
    return keyed.filter(F.col("side").isin("context", "response")).groupBy("sample_id", "key").agg(best("context"), best("response"))


def canonical_ends(head: Column, relation_id: Column, tail: Column) -> tuple[Column, Column]:
    """Ends in order for symmetric relations; a null end stays where it is."""
    both = relation_id.isin(*SYMMETRIC_RELATIONS) & head.isNotNull() & tail.isNotNull()
    return F.when(both, F.least(head, tail)).otherwise(head), F.when(both, F.greatest(head, tail)).otherwise(tail)


def unique_triples(relations: DataFrame, key=X.norm) -> DataFrame:
    """(sample_id, side, head, relation_id, tail) once each, symmetric relations in one direction."""
    h, t = canonical_ends(key(F.col("head_text")), F.col("relation_id"), key(F.col("tail_text")))
    return relations.select("sample_id", "side", h.alias("head"), "relation_id", t.alias("tail")).distinct()


def counted_triples(relations: DataFrame, key=X.norm) -> DataFrame:
    """(sample_id, head, relation_id, tail, n) of the relations of one side, symmetric ones in one direction."""
    h, t = canonical_ends(key(F.col("head_text")), F.col("relation_id"), key(F.col("tail_text")))
    return relations.select("sample_id", h.alias("head"), "relation_id", t.alias("tail")).groupBy("sample_id", "head", "relation_id", "tail").agg(F.count("*").alias("n"))


def label_to_id(label: Column, task: Column, on_unknown: str = "error") -> Column:
    """Relation id of a model's label in a task's schema. on_unknown: error, drop (null) or unmapped
    ("UNMAPPED::" and the label)."""
    pairs = [F.lit(x) for t, schema in RELATIONS.items() for i, text in schema for x in (f"{t}|{text}", i)]
    found = F.element_at(F.create_map(*pairs), F.concat_ws("|", task, X.norm(label)))
    if on_unknown == "drop":
        return found
    if on_unknown == "unmapped":
        return F.coalesce(found, F.concat(F.lit("UNMAPPED::"), label))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unexpected relation label: "), F.coalesce(label, F.lit("null")))).cast("string"))


def mapped_triples(gold: DataFrame, mapping: DataFrame) -> DataFrame:
    """Gold triples (sample_id, h, r, t) in the target schema: mapped relations only, turned round where the
    mapping says so, once each. mapping: docred_id, status, hgr_relation, reverse_direction."""
    m = mapping.filter("status = 'mapped'").select(F.col("docred_id").alias("r"), "hgr_relation", "reverse_direction")
    turn = lambda a, b: F.when(F.col("reverse_direction"), F.col(a)).otherwise(F.col(b))
    return gold.join(m, "r").select("sample_id", turn("t", "h").alias("h"), F.col("hgr_relation").alias("r"), turn("h", "t").alias("t")).distinct()


def assembled(samples: DataFrame, entities: DataFrame, relations: DataFrame, sides: tuple[str, ...] = ("context", "response")) -> DataFrame:
    """The inverse of explode_graphs for samples (sample_id, task_type): entities by start and end, relations by
    starts of head and tail and by id; rows that tie keep their positions. A sample without rows has empty graphs."""

    def listed(df: DataFrame, order: list[str], kind: str) -> DataFrame:
        fields = [f.split()[0] for f in kind[len("array<struct<") : -2].replace(":", " ").split(",")]
        row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*order, "pos"])], F.struct(*fields).alias("v"))
        return df.groupBy("sample_id", "side").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).cast(kind).alias("l"))

    ents = listed(entities, ["start", "end"], "array<struct<start:int,end:int,text:string,label:string,score:double>>")
    rels = listed(relations, ["head_start", "tail_start", "relation_id"], "array<struct<head_start:int,head_end:int,head_text:string,relation_id:string,tail_start:int,tail_end:int,tail_text:string,score:double>>")
    out = samples.select("sample_id", "task_type")
    for s in sides:
        for name, part in (("entities", ents), ("relations", rels)):
            out = out.join(part.filter(F.col("side") == s).select("sample_id", F.col("l").alias(f"{s}_{name}")), "sample_id", "left")
    whole = lambda c, part: F.coalesce(c, F.array().cast(dict(part.dtypes)["l"]))
    graph = lambda s: F.struct(whole(F.col(f"{s}_entities"), ents).alias("entities"), whole(F.col(f"{s}_relations"), rels).alias("relations")).alias(f"{s}_graph")
    return out.select("sample_id", "task_type", *[graph(s) for s in sides])


def name_sets(*lists: Column) -> Column:
    """The distinct trimmed names of these lists together, those of a single character left out."""
    names = F.transform(F.flatten(F.array(*lists)), lambda n: F.trim(n))
    return F.array_distinct(F.filter(names, lambda n: F.char_length(n) > 1))


def first_mentions(clusters: Column) -> Column:
    """Lower-cased first mention of each cluster (arrays of mentions); null for an empty one."""
    return F.transform(clusters, lambda mentions: F.lower(F.get(mentions, F.lit(0))))


def gold_triplets(names: Column, relations: Column) -> Column:
    """Triplets (head, relation, tail) of relations (h, r, t: numbers of clusters) by the clusters' names."""
    return F.transform(relations, lambda x: F.struct(F.get(names, x["h"]).alias("head"), x["r"].alias("relation"), F.get(names, x["t"]).alias("tail")))
