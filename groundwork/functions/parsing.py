"""Parsers of model output: tolerant JSON, linearised triplets, relation items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "struct<start:int,end:int,text:string,label:string,type:string,score:double>"
RESULT = "entities array<string>, triplets array<struct<head:string,relation:string,tail:string>>"
_TRAILING = r",\s*([}\]])"


def object_text(raw: Column, control: bool = True) -> Column:
    """From the first { to the last }, null without; control characters to blanks if asked for."""
    found = F.when(raw.rlike(r"(?s)\{.*\}"), F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    return F.regexp_replace(found, r"[\x00-\x1f]+", " ") if control else found


def tolerant_variant(raw: Column, fix_first: bool = False) -> Column:
    """The object in raw as a VARIANT, trailing commas forgiven; null where nothing parses. fix_first drops
    trailing commas before the first try, and leaves control characters alone."""
    text = object_text(raw, control=not fix_first)
    fixed = F.regexp_replace(text, _TRAILING, "$1")
    return F.try_parse_json(fixed) if fix_first else F.coalesce(F.try_parse_json(text), F.try_parse_json(fixed))


def extraction(raw: Column) -> Column:
    """Struct of trimmed entities and whole triplets, empty lists on any failure."""
    v = tolerant_variant(raw)
    ents = F.coalesce(F.try_variant_get(v, "$.entities", "array<string>"), F.array().cast("array<string>"))
    trips = F.coalesce(F.try_variant_get(v, "$.triplets", "array<struct<head:string,relation:string,tail:string>>"), F.array().cast("array<struct<head:string,relation:string,tail:string>>"))
    whole = F.filter(trips, lambda t: t["head"].isNotNull() & t["relation"].isNotNull() & t["tail"].isNotNull())
    trim = lambda t: F.struct(*[F.trim(t[k]).alias(k) for k in ("head", "relation", "tail")])
    return F.struct(F.transform(F.filter(ents, lambda e: e.isNotNull()), lambda e: F.trim(e)).alias("entities"), F.transform(whole, trim).alias("triplets"))


def linearised_triplets(text: Column) -> Column:
    """array<struct<subject, relation, object>> of text such as "<triplet> s <subj> o <obj> r": what follows
    <triplet> is the subject, what follows <subj> goes to the object, what follows <obj> to the relation. A
    second <subj> goes on with the same object."""
    t = text
    for mark in ("<s>", "</s>", "<pad>"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(t, r"(?U)\s+", " "), " "), lambda w: w != "")
    kind = "struct<done:array<struct<subject:string,relation:string,object:string>>,s:string,r:string,o:string,at:string>"
    start = F.struct(F.array().alias("done"), F.lit("").alias("s"), F.lit("").alias("r"), F.lit("").alias("o"), F.lit("x").alias("at")).cast(kind)

    def flushed(acc):
        whole = (acc["s"] != "") & (acc["r"] != "") & (acc["o"] != "")
        one = F.struct(F.trim(acc["s"]).alias("subject"), F.trim(acc["r"]).alias("relation"), F.trim(acc["o"]).alias("object"))
        return F.when(whole, F.concat(acc["done"], F.array(one))).otherwise(acc["done"])

    def step(acc, w):
        new = w == "<triplet>"
        add = lambda field, at: F.when(new, F.lit("")).when((acc["at"] == at) & ~w.isin("<subj>", "<obj>"), F.concat(acc[field], F.lit(" "), w)).otherwise(acc[field])
        at = F.when(new, F.lit("t")).when(w == "<subj>", F.lit("s")).when(w == "<obj>", F.lit("o")).otherwise(acc["at"])
        return F.struct(F.when(new, flushed(acc)).otherwise(acc["done"]).alias("done"), add("s", "t").alias("s"), add("r", "o").alias("r"), add("o", "s").alias("o"), at.alias("at")).cast(kind)

    return F.aggregate(words, start, step, flushed)


def relation_item(head: Column, tail: Column, relation: Column, entities: Column, allowed: Column) -> Column:
    """Struct of head and tail text for a model's item ("e3", "e5", id), null unless both numbers parse and
    exist, the id is allowed and the ends differ. Negative numbers count from the end, as list indices do."""
    number = lambda x: F.expr("1").cast("int") * F.try_to_number(F.regexp_replace(x, "^e+", ""), F.lit("S999999999")).cast("int")
    h, t = number(head), number(tail)
    at = lambda i: F.when(i >= 0, F.try_element_at(entities, i + 1)).when(i >= -F.size(entities), F.try_element_at(entities, i))
    ok = F.array_contains(allowed, relation) & (h != t) & at(h).isNotNull() & at(t).isNotNull()
    return F.when(ok, F.struct(at(h).alias("head_text"), relation.alias("relation_id"), at(t).alias("tail_text")))


def parsed_entity(raw_json: Column) -> Column:
    """Entity struct from raw JSON: label falls back to type, score to 0; bad offsets or missing parts raise."""
    e = F.from_json(raw_json, ENTITY)
    bad = e["start"].isNull() | e["end"].isNull() | e["text"].isNull() | (e["start"] < 0) | (e["end"] < e["start"])
    out = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), F.coalesce(e["label"], e["type"], F.lit("")).alias("label"), F.coalesce(e["score"], F.lit(0.0)).alias("score"))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid entity: "), raw_json)).cast("struct<start:int,end:int,text:string,label:string,score:double>")).otherwise(out)


RELATION = "struct<head_start:int,head_end:int,head_text:string,tail_start:int,tail_end:int,tail_text:string,relation_id:string,score:double>"


def parsed_relation(raw_json: Column) -> Column:
    """Relation struct from raw JSON: score falls back to 0; bad offsets or missing parts raise."""
    r = F.from_json(raw_json, RELATION)
    bad = F.coalesce(r["head_text"], F.lit("")) == ""
    for part in ("tail_text", "relation_id"):
        bad |= F.coalesce(r[part], F.lit("")) == ""
    for end in ("head", "tail"):
        start, stop = r[f"{end}_start"], r[f"{end}_end"]
        bad |= start.isNull() | stop.isNull() | (start < 0) | (stop < start)
    out = r.withField("score", F.coalesce(r["score"], F.lit(0.0)))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid relation: "), F.coalesce(raw_json, F.lit("null")))).cast(RELATION)).otherwise(out)
