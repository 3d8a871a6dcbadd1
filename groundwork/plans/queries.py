"""Queries over the test tables, one for each operator or small group of operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork import contracts
from groundwork.constants import TASKS
from groundwork.functions import parsing
from groundwork.functions import text as X
from groundwork.functions.similarity import scored_pairs, with_similarity
from groundwork.operators import align, graphs, metrics, model, prepare, sampling, windows
from groundwork.plans import fixtures as fx
from groundwork.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, base: bool = True):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (fx.SQL if base else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = graphs.graph_entities(fx.entities(spark, sf), fx.relations(spark, sf))
    return align.side(nodes, "context").select("sample_id", "key"), align.side(nodes, "response").select("sample_id", "key", "score")


def _scored(spark: SparkSession, sf: str, empty: str = "null") -> DataFrame:
    context, answer = _names(spark, sf)
    return align.grounding(fx.samples(spark, sf), answer.select("sample_id", "key"), context, empty).withColumn("risk", _r(1 - F.col("eg")))


# Grounding by task: the flagship query.


@_query("""
, pairs AS (SELECT task_type, sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*) AS auroc
  FROM (SELECT task_type, risk FROM scored WHERE hallucinated = 1 AND risk IS NOT NULL) a JOIN (SELECT task_type, risk FROM scored WHERE hallucinated = 0 AND risk IS NOT NULL) b USING (task_type) GROUP BY 1)
, sizes AS (SELECT sample_id, count(*) AS n_context FROM ctx GROUP BY 1)
SELECT s.task_type, count(*) AS n, round(avg(hallucinated), 6) AS hallucination_rate, median(coalesce(n_context, 0))::DOUBLE AS median_context, median(n_answer)::DOUBLE AS median_answer, round(avg((n_answer = 0)::INT) * 100, 6) AS pct_empty,
  round(avg(eg), 6) AS mean_eg, round(avg(CASE WHEN hallucinated = 0 THEN eg END), 6) AS mean_eg_clean, round(avg(CASE WHEN hallucinated = 1 THEN eg END), 6) AS mean_eg_hallucinated, round(any_value(auroc), 6) AS auroc,
  CASE WHEN median(coalesce(n_context, 0)) >= 20 THEN 'HIGH' ELSE 'LOW' END AS regime
FROM scored s LEFT JOIN sizes USING (sample_id) LEFT JOIN pairs USING (task_type) GROUP BY 1
""")
def eg_by_task(spark: SparkSession, sf: str) -> DataFrame:
    context, _ = _names(spark, sf)
    s = _scored(spark, sf).join(context.groupBy("sample_id").agg(F.count("*").alias("n_context")), "sample_id", "left").withColumn("n_context", F.coalesce("n_context", F.lit(0)))
    y = F.col("hallucinated")
    rows = s.groupBy("task_type").agg(
        F.count("*").alias("n"), _r(F.avg(y)).alias("hallucination_rate"), F.median("n_context").alias("median_context"), F.median("n_answer").alias("median_answer"), _r(F.avg((F.col("n_answer") == 0).cast("int")) * 100).alias("pct_empty"),
        _r(F.avg("eg")).alias("mean_eg"), _r(F.avg(F.when(y == 0, F.col("eg")))).alias("mean_eg_clean"), _r(F.avg(F.when(y == 1, F.col("eg")))).alias("mean_eg_hallucinated"),
    )
    auc = metrics.ranking(s, ["task_type"]).select("task_type", _r(F.col("roc_auc")).alias("auroc"))
    return rows.join(auc, "task_type", "left").withColumn("regime", F.when(F.col("median_context") >= 20, "HIGH").otherwise("LOW"))


# Deduplication and graph tables.


@_query("SELECT sample_id, side, lower(text) AS key, type, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM (SELECT * FROM entity WHERE lower(text) NOT IN ('the', 'an', 'a')) GROUP BY ALL")
def entity_dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.dedup_entities(fx.entities(spark, sf)).select("sample_id", "side", "key", "type", "score", F.col("pos").cast("long").alias("pos"))


@_query("SELECT sample_id, side, head, relation_id, tail, count(*) AS n, max(score) AS score FROM relation GROUP BY ALL")
def relation_bag_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.relations(spark, sf)
    return r.groupBy("sample_id", "side", X.norm(F.col("head_text")).alias("head"), "relation_id", X.norm(F.col("tail_text")).alias("tail")).agg(F.count("*").alias("n"), F.max("score").alias("score"))


@_query("SELECT sample_id, side, lower(head_text) AS head_key, relation_id, lower(tail_text) AS tail_key, arg_min(pos, (-score, pos)) AS pos FROM relation WHERE lower(head_text) NOT IN ('the', 'an', 'a') AND lower(tail_text) NOT IN ('the', 'an', 'a') GROUP BY ALL")
def relation_dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.dedup_relations(fx.relations(spark, sf)).select("sample_id", "side", "head_key", "relation_id", "tail_key", F.col("pos").cast("long").alias("pos"))


@_query("SELECT * FROM node")
def graph_entities(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.graph_entities(fx.entities(spark, sf), fx.relations(spark, sf))


@_query("SELECT * FROM triple")
def unique_triples(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.unique_triples(fx.relations(spark, sf))


@_query("""
, f AS (SELECT t.sample_id, (h.key IS NULL OR k.key IS NULL)::INT AS novel FROM triple t LEFT JOIN ctx h ON h.sample_id = t.sample_id AND h.key = t.head LEFT JOIN ctx k ON k.sample_id = t.sample_id AND k.key = t.tail WHERE side = 'response')
SELECT sample_id, count(*) AS n_triples, sum(novel)::BIGINT AS n_novel, round(avg(novel), 6) AS novel_rate FROM f GROUP BY 1
""")
def strict_novel_relations(spark: SparkSession, sf: str) -> DataFrame:
    context, _ = _names(spark, sf)
    return align.strict_novel(fx.relations(spark, sf), context).withColumn("novel_rate", _r(F.col("novel_rate")))


@_query("""
, m AS (SELECT *, pos + CASE side WHEN 'context' THEN 0 ELSE 1099511627776 END AS p FROM entity WHERE lower(text) NOT IN ('the', 'an', 'a'))
SELECT sample_id, side, key, type, score, pos FROM (SELECT sample_id, 'reference' AS side, lower(text) AS key, type, max(score) AS score, arg_min(p, (-score, p)) AS pos FROM m GROUP BY ALL)
""")
def union_graphs(spark: SparkSession, sf: str) -> DataFrame:
    e, r = fx.entities(spark, sf), fx.relations(spark, sf)
    of = lambda d, s: d.filter(F.col("side") == s)
    ents, _ = graphs.union_graphs([of(e, "context"), of(e, "response")], [of(r, "context"), of(r, "response")])
    return ents.select("sample_id", "side", "key", "type", "score", "pos")


@_query("""
, a AS (SELECT sample_id, key, score, (c.key IS NULL) AS bad FROM ans LEFT JOIN ctx c USING (sample_id, key))
SELECT sample_id, round(CASE WHEN sum(score) = 0 THEN avg(bad::INT) ELSE sum(CASE WHEN bad THEN score ELSE 0 END) / sum(score) END, 6) AS bad_rate, count(*) AS n FROM a GROUP BY 1
""")
def weighted_ungrounded_exact(spark: SparkSession, sf: str) -> DataFrame:
    context, answer = _names(spark, sf)
    a = answer.join(context.withColumn("hit", F.lit(True)), ["sample_id", "key"], "left").withColumn("bad", F.col("hit").isNull())
    return a.groupBy("sample_id").agg(_r(align.weighted_bad_rate(F.col("score"), F.col("bad"))).alias("bad_rate"), F.count("*").alias("n"))


@_query("""
SELECT s.task_type, CASE WHEN c.sample_id IS NULL THEN 'no_context_entities' WHEN a.sample_id IS NULL THEN 'no_response_entities' ELSE 'predicted' END AS status, count(*) AS n
FROM sample s LEFT JOIN (SELECT DISTINCT sample_id FROM ctx) c USING (sample_id) LEFT JOIN (SELECT DISTINCT sample_id FROM ans) a USING (sample_id) GROUP BY ALL
""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    context, answer = _names(spark, sf)
    size = lambda d, n: d.groupBy("sample_id").agg(F.count("*").alias(n))
    s = fx.samples(spark, sf).join(size(context, "c"), "sample_id", "left").join(size(answer, "a"), "sample_id", "left")
    return s.groupBy("task_type", align.status(F.col("c"), F.col("a")).alias("status")).agg(F.count("*").alias("n"))


# Similarity: consecutive sentences of benchmark items as names.

_PAIRS = r"""
WITH p AS (SELECT part_a.p_partkey AS a_id, part_b.p_partkey AS b_id, lower(part_a.p_name) AS a, lower(part_b.p_name) AS b FROM part part_a JOIN part part_b ON part_a.p_brand = part_b.p_brand AND part_a.p_size = part_b.p_size AND part_a.p_partkey < part_b.p_partkey)
, t AS (SELECT *, list_distinct(regexp_extract_all(a, '[\p{L}\p{N}_]+')) AS x, list_distinct(regexp_extract_all(b, '[\p{L}\p{N}_]+')) AS y, regexp_extract_all(a, '[\p{L}\p{N}_]+') AS tx, regexp_extract_all(b, '[\p{L}\p{N}_]+') AS ty FROM p)
"""


def _part_names(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))


def _part_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts of one brand and size, every pair of them."""
    p = _part_names(spark, sf)
    return p.toDF("brand", "size", "a_id", "a").join(p.toDF("brand", "size", "b_id", "b"), ["brand", "size"]).filter("a_id < b_id").select("a_id", "b_id", "a", "b")


def _part_scores(spark: SparkSession, sf: str, left, right, score, out: str) -> DataFrame:
    """A score of every pair of parts of one brand and size, of what left and right read from the names."""
    return scored_pairs(_part_names(spark, sf), ["brand", "size"], "id", "name", left, right, score, out)


@_query(_PAIRS + "SELECT a_id, b_id, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) ELSE 0 END AS f1 FROM t", base=False)
def token_f1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _part_scores(spark, sf, X.words, X.words, lambda x, y: _r(X.words_f1(x, y)), "f1")


@_query(_PAIRS + r"SELECT a_id, b_id, list_sort(list_distinct(regexp_extract_all(a, '\p{Nd}+(?:[.,]\p{Nd}+)?'))) <> list_sort(list_distinct(regexp_extract_all(b, '\p{Nd}+(?:[.,]\p{Nd}+)?'))) AS differ FROM t", base=False)
def number_guard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _part_scores(spark, sf, X.numbers, X.numbers, lambda x, y: x != y, "differ")


@_query(_PAIRS + """
, s AS (SELECT *, CASE WHEN len(tx) <= len(ty) THEN tx ELSE ty END AS short, CASE WHEN len(tx) <= len(ty) THEN ty ELSE tx END AS long FROM t)
SELECT a_id, b_id, CASE WHEN len(short) > 0 AND list_has_all(long, short) AND (len(short) > 1 OR length(short[1]) >= 4) THEN 0.9 ELSE 0.0 END::DOUBLE AS contained FROM s
""", base=False)  # fmt: skip
def containment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _part_scores(spark, sf, X.tokens, X.tokens, X.tokens_contained, "contained")


@_query(_PAIRS + """
, i AS (SELECT a_id, b_id, tx, ty, list_aggregate(list_transform(ty, lambda v: v[1]), 'string_agg', '') AS initials FROM t UNION ALL SELECT a_id, a_id, tx, tx, list_aggregate(list_transform(tx, lambda v: v[1]), 'string_agg', '') FROM (SELECT DISTINCT a_id, tx FROM t))
SELECT a_id, b_id, CASE WHEN len(tx) > 1 AND list_aggregate(list_transform(tx, lambda v: v[1]), 'string_agg', '') = initials THEN 0.92 ELSE 0.0 END::DOUBLE AS acronym FROM i
""", base=False)  # fmt: skip
def acronym_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's name against its own initials and those of the other parts of its brand and size."""
    abbreviated = lambda c: X.short_and_long(X.initials(X.tokens(c)))
    pairs = _part_scores(spark, sf, X.short_and_long, abbreviated, X.stands_for, "acronym")
    # A part meets itself where it is the lesser of some pair.
    p = _part_names(spark, sf)
    last = p.groupBy("brand", "size").agg(F.max("id").alias("last"))
    own = p.join(last, ["brand", "size"]).filter("id < last").select("id", X.tokens(F.col("name")).alias("t"), F.col("name")).dropDuplicates(["id", "t"])
    return pairs.unionByName(own.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), X.stands_for(X.short_and_long(F.col("name")), abbreviated(F.col("name"))).alias("acronym")))


@_query()
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return with_similarity(_part_pairs(spark, sf), "a", "b").select("a_id", "b_id", "similarity")


@_query("""
, c AS (SELECT DISTINCT sample_id, lower(text) AS name FROM entity WHERE side = 'context'), a AS (SELECT DISTINCT sample_id, lower(text) AS name FROM entity WHERE side = 'response')
SELECT * FROM a WHERE EXISTS (SELECT 1 FROM c WHERE c.sample_id = a.sample_id AND (c.name = a.name OR (length(c.name) >= 3 AND length(a.name) >= 3 AND (contains(c.name, a.name) OR contains(a.name, c.name)))))
""")
def soft_in_matches(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entities(spark, sf)
    part = lambda s: e.filter(F.col("side") == s).select("sample_id", F.lower("text").alias("name")).distinct()
    return align.soft_matches(part("response"), part("context"))


@_query("""
, c AS (SELECT DISTINCT sample_id, lower(text) AS name FROM entity WHERE side = 'context'), a AS (SELECT DISTINCT sample_id, text AS name FROM entity WHERE side = 'response')
SELECT sample_id, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM c WHERE c.sample_id = a.sample_id AND length(c.name) >= 3 AND (contains(c.name, lower(a.name)) OR contains(lower(a.name), c.name))) GROUP BY 1
""")
def soft_grounded_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entities(spark, sf)
    part = lambda s: e.filter(F.col("side") == s).select("sample_id", F.col("text").alias("name")).distinct()
    return align.soft_grounded(part("response"), part("context")).groupBy("sample_id").agg(F.count("*").alias("n"))


@_query("""
, p AS (SELECT DISTINCT sample_id, head, tail FROM triple WHERE side = 'response'), g AS (SELECT DISTINCT sample_id, head, tail FROM triple WHERE side = 'context')
SELECT * FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.sample_id = p.sample_id AND (contains(g.head, p.head) OR contains(p.head, g.head)) AND (contains(g.tail, p.tail) OR contains(p.tail, g.tail)))
""")
def soft_triple_matches(spark: SparkSession, sf: str) -> DataFrame:
    t = graphs.unique_triples(fx.relations(spark, sf)).select("sample_id", "side", "head", "tail").distinct()
    return align.soft_triples(align.side(t, "response"), align.side(t, "context"))


@_query(r"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')))", base=False)
def benchmark_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item. Items and documents meet by a hash of the item's first six words at
    every place of a document, then the text decides; shorter items are compared by what they have."""
    d = fx.table(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("t"))
    b = fx.table(spark, sf, "benchmark").select("item_id", X.normalize(F.col("text")).alias("i"))
    # The item's first and last word may be cut within a document's word: inner words are compared.
    words = lambda c: F.split(c, " ")
    b = b.withColumn("k", F.least(F.size(words(F.col("i"))) - 2, F.lit(6)))
    hits = None
    for k in sorted(r["k"] for r in b.select("k").distinct().collect()):  # eight sizes at most
        own = b.filter(F.col("k") == k)
        if k > 0:
            keyed = own.withColumn("h", F.xxhash64(F.array_join(F.slice(words(F.col("i")), 2, k), " ")))
            n = F.size("w") - k + 1
            grams = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))  # noqa: B023
            at = d.withColumn("w", words(F.col("t"))).select("doc_id", F.explode(F.array_distinct(grams)).alias("h"))
            cand = at.join(keyed.select("h", "item_id"), "h").select("doc_id", "item_id").distinct()
        else:  # one word or two: by their first characters, wherever these stand in a document
            size = F.least(F.char_length("i"), F.lit(4))
            keyed = own.select("item_id", size.alias("q"), F.left("i", size).alias("h"))
            at = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("q"), "t")
            n = F.char_length("t") - F.col("q") + 1
            starts = F.when(F.col("q") == 0, F.array(F.lit(1))).when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
            at = at.select("doc_id", "q", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("t", i, F.col("q"))))).alias("h"))
            cand = at.join(keyed, ["q", "h"]).select("doc_id", "item_id").distinct()
        found = cand.join(d, "doc_id").join(own, "item_id").filter(F.col("t").contains(F.col("i"))).select("doc_id", "item_id")
        hits = found if hits is None else hits.unionByName(found)
    return d.select("doc_id", F.lit(None).cast("long").alias("item_id")).limit(0) if hits is None else hits


# Alignment metrics and components.


@_query("""
, sup AS (SELECT r.sample_id, r.head, r.tail FROM relation r WHERE side = 'response' AND EXISTS (SELECT 1 FROM relation c WHERE c.side = 'context' AND c.sample_id = r.sample_id AND c.relation_id = r.relation_id AND c.head = r.head AND c.tail = r.tail))
, nr AS (SELECT sample_id, count(*) AS n FROM relation WHERE side = 'response' GROUP BY 1), ns AS (SELECT sample_id, count(*) AS k FROM sup GROUP BY 1)
SELECT s.sample_id, round(n_shared::DOUBLE / nullif(n_answer, 0), 6) AS eg, round(coalesce(k, 0)::DOUBLE / n, 6) AS rp, (n_answer = 0)::INT AS missing_eg, (n IS NULL)::INT AS missing_rp, coalesce(n, 0) AS n_response_relations
FROM scored s LEFT JOIN nr USING (sample_id) LEFT JOIN ns USING (sample_id)
""")
def eg_rp(spark: SparkSession, sf: str) -> DataFrame:
    e, r = fx.entities(spark, sf), fx.relations(spark, sf)
    m = align.alignment_metrics(fx.samples(spark, sf).select("sample_id"), e, r, key=X.norm)
    return m.select("sample_id", _r(F.col("eg")).alias("eg"), _r(F.col("rp")).alias("rp"), "missing_eg", "missing_rp", "n_response_relations")


_EDGES = """
, edge AS (SELECT DISTINCT r.sample_id, least(r.head, r.tail) AS a, greatest(r.head, r.tail) AS b FROM relation r JOIN relation c USING (sample_id, relation_id, head, tail) WHERE r.side = 'response' AND c.side = 'context')
, arc AS (SELECT sample_id, a, b FROM edge UNION SELECT sample_id, b, a FROM edge)
, reach AS (WITH RECURSIVE w AS (SELECT sample_id, a AS n, a AS m FROM arc UNION SELECT w.sample_id, w.n, arc.b FROM w JOIN arc ON arc.sample_id = w.sample_id AND arc.a = w.m) SELECT * FROM w)
, comp AS (SELECT sample_id, n, min(m) AS c FROM reach GROUP BY 1, 2), size AS (SELECT sample_id, c, count(*) AS k FROM comp GROUP BY 1, 2)
, best AS (SELECT sample_id, arg_min(c, (-k, c)) AS c FROM size GROUP BY 1)
, largest AS (SELECT e.sample_id, count(*) AS largest_edges FROM edge e JOIN comp ON comp.sample_id = e.sample_id AND comp.n = e.a JOIN best ON best.sample_id = comp.sample_id AND best.c = comp.c GROUP BY 1)
"""
_ALIGNED = _EDGES + """
, good AS (SELECT r.sample_id FROM relation r WHERE side = 'response' AND EXISTS (SELECT 1 FROM relation c WHERE c.side = 'context' AND c.sample_id = r.sample_id AND c.relation_id = r.relation_id AND c.head = r.head AND c.tail = r.tail))
, size_of AS (SELECT sample_id, count_if(k = 're') AS ne, count_if(k = 'rr') AS nr, count_if(k = 'ce') AS ce, count_if(k = 'cr') AS cr, count_if(k = 'g') AS g FROM (
    SELECT sample_id, CASE side WHEN 'response' THEN 're' ELSE 'ce' END AS k FROM entity UNION ALL SELECT sample_id, CASE side WHEN 'response' THEN 'rr' ELSE 'cr' END FROM relation UNION ALL SELECT sample_id, 'g' FROM good) GROUP BY 1)
, al AS (SELECT s.sample_id, s.task_type, s.hallucinated, s.eg, z.g::DOUBLE / nullif(z.nr, 0) AS rp, coalesce(largest_edges, 0)::DOUBLE / nullif(z.nr, 0) AS sc, coalesce(z.ne, 0) AS ne, coalesce(z.nr, 0) AS nr, coalesce(z.ce, 0) AS ce, coalesce(z.cr, 0) AS cr
    FROM scored s LEFT JOIN size_of z USING (sample_id) LEFT JOIN largest USING (sample_id))
"""


@_query(_ALIGNED + """
SELECT sample_id, task_type, round(eg, 6) AS eg, round(rp, 6) AS rp, round(sc, 6) AS sc, nr::BIGINT AS n_response_relations, ce::BIGINT AS n_context_entities, cr::BIGINT AS n_context_relations, ne::BIGINT AS n_response_entities,
  (eg IS NULL)::INT AS missing_eg, (rp IS NULL)::INT AS missing_rp, (sc IS NULL)::INT AS missing_sc, (ce = 0)::INT AS context_entity_empty, (cr = 0)::INT AS context_relation_empty, (ne = 0)::INT AS response_entity_empty, (nr = 0)::INT AS response_relation_empty FROM al
""")
def eg_rp_sc(spark: SparkSession, sf: str) -> DataFrame:
    m = align.alignment_metrics(fx.samples(spark, sf).select("sample_id", "task_type"), fx.entities(spark, sf), fx.relations(spark, sf), key=X.norm)
    return m.withColumns({c: _r(F.col(c)) for c in ("eg", "rp", "sc")})


@_query(_EDGES + "SELECT sample_id, largest_edges FROM largest")
def largest_components(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.relations(spark, sf)
    return align.largest_component(align.supported_relations(align.side(r, "response"), align.side(r, "context"), key=X.norm))


@_query()
def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return align.feature_rows(fx.samples(spark, sf), fx.entities(spark, sf), fx.relations(spark, sf), names=fx.names(spark, sf))


# Ranking and classification.


@_query("""
, level AS (SELECT task_type, risk AS s, sum(hallucinated) AS p, sum(1 - hallucinated) AS q FROM scored WHERE risk IS NOT NULL GROUP BY 1, 2)
, run AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM level WINDOW w AS (PARTITION BY task_type ORDER BY s DESC))
SELECT task_type, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS positives, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) END AS roc_auc, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(p * tp / (tp + fp)) / sum(p), 6) END AS average_precision FROM run GROUP BY 1
""")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.ranking(_scored(spark, sf), ["task_type"])
    return m.withColumns({c: _r(F.col(c)) for c in ("roc_auc", "average_precision")})


@_query("""
, run AS (SELECT task_type, hallucinated AS y, sum(hallucinated) OVER (PARTITION BY task_type ORDER BY risk DESC, sample_id) AS tp FROM scored WHERE risk IS NOT NULL)
SELECT task_type, round_even(sum(CASE WHEN y = 0 THEN tp END)::DOUBLE / nullif(sum(y) * (count(*) - sum(y)), 0), 3) AS auroc FROM run GROUP BY 1
""")
def untied_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.untied_auroc(_scored(spark, sf), ["task_type"], "sample_id")


_CURVE = """
, rows_ AS (SELECT task_type, row_number() OVER w AS step, sum(hallucinated) OVER w AS tp, sum(1 - hallucinated) OVER w AS fp, sum(hallucinated) OVER v AS p, sum(1 - hallucinated) OVER v AS q FROM scored WHERE risk IS NOT NULL WINDOW w AS (PARTITION BY task_type ORDER BY risk DESC, sample_id), v AS (PARTITION BY task_type))
"""


@_query(_CURVE + "SELECT DISTINCT task_type, 0 AS step, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM rows_ UNION ALL SELECT task_type, step, round(fp / nullif(q, 0), 6), round(tp / nullif(p, 0), 6) FROM rows_")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.roc_points(_scored(spark, sf), ["task_type"], "sample_id")
    return p.select("task_type", F.col("step").cast("long").alias("step"), _r(F.col("fpr")).alias("fpr"), _r(F.col("tpr")).alias("tpr"))


@_query(_CURVE + "SELECT DISTINCT task_type, 0 AS step, 0.0::DOUBLE AS recall, 1.0::DOUBLE AS precision FROM rows_ UNION ALL SELECT task_type, step, round(tp / nullif(p, 0), 6), round(tp / step, 6) FROM rows_")
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.pr_points(_scored(spark, sf), ["task_type"], "sample_id")
    return p.select("task_type", F.col("step").cast("long").alias("step"), _r(F.col("recall")).alias("recall"), _r(F.col("precision")).alias("precision"))


@_query("""
, c AS (SELECT task_type, hallucinated = 1 AS y, risk >= 0.5 AS z FROM scored WHERE risk IS NOT NULL)
, g AS (SELECT task_type, count_if(y AND z) AS tp, count_if(NOT y AND z) AS fp, count_if(y AND NOT z) AS fn, count_if(NOT y AND NOT z) AS tn FROM c GROUP BY 1)
SELECT task_type, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce((tn / nullif(tn + fp, 0) + tp / nullif(tp + fn, 0)) / 2, tn / nullif(tn + fp, 0), tp / nullif(tp + fn, 0)), 6) AS balanced_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM g
""")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.confusion(_scored(spark, sf).withColumn("prediction", (F.col("risk") >= 0.5).cast("int")), ["task_type"])
    return m.withColumns({c: _r(F.col(c)) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")})


@_query("""
, k AS (SELECT task_type, risk, hallucinated FROM scored WHERE risk IS NOT NULL), t AS (SELECT DISTINCT task_type, risk AS s FROM k UNION SELECT DISTINCT task_type, unnest([0.0, 1.0]) FROM k)
, f AS (SELECT t.task_type, t.s, coalesce(2.0 * sum(CASE WHEN risk >= s THEN hallucinated ELSE 0 END) / nullif(sum((risk >= s)::INT) + sum(hallucinated), 0), 0) AS f1 FROM t JOIN k USING (task_type) GROUP BY 1, 2)
SELECT task_type, arg_min(s, (-f1, s))::DOUBLE AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY 1
""")
def best_f1_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_f1_threshold(_scored(spark, sf), ["task_type"]).withColumn("f1", _r(F.col("f1")))


@_query("SELECT task_type, hallucinated, least(floor(risk * 15), 14)::INT AS bin, count(*) AS n FROM scored WHERE risk IS NOT NULL GROUP BY ALL")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(_scored(spark, sf), ["task_type", "hallucinated"], "risk", 15)


@_query("SELECT task_type, count(n_answer) AS n, min(n_answer) AS low, quantile_cont(n_answer, 0.25)::DOUBLE AS q1, quantile_cont(n_answer, 0.5)::DOUBLE AS median, quantile_cont(n_answer, 0.75)::DOUBLE AS q3, max(n_answer) AS high FROM scored GROUP BY 1")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.box_stats(_scored(spark, sf), ["task_type"], "n_answer")


_PRF = """
, p AS (SELECT sample_id, head, relation_id, tail FROM triple WHERE side = 'response'), g AS (SELECT sample_id, head, relation_id, tail FROM triple WHERE side = 'context')
, b AS (SELECT coalesce(p.sample_id, g.sample_id) AS sample_id, count_if(p.head IS NOT NULL AND g.head IS NOT NULL) AS tp, count_if(g.head IS NULL) AS fp, count_if(p.head IS NULL) AS fn FROM p FULL JOIN g USING (sample_id, head, relation_id, tail) GROUP BY 1)
"""


def _doc_prf(spark: SparkSession, sf: str) -> DataFrame:
    t = graphs.unique_triples(fx.relations(spark, sf))
    return metrics.set_prf(align.side(t, "response"), align.side(t, "context"), ["sample_id", "head", "relation_id", "tail"])


@_query(_PRF + "SELECT sample_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, (fp = 0 AND fn = 0)::INT AS exact FROM b")
def set_prf(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_prf(spark, sf).withColumns({c: _r(F.col(c)) for c in ("precision", "recall", "f1")})


@_query(_PRF + ", s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg((fp = 0 AND fn = 0)::INT) AS e FROM b) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(e, 6) AS exact_graph_accuracy FROM s")
def micro_prf(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.micro(_doc_prf(spark, sf)).withColumns({c: _r(F.col(c)) for c in ("precision", "recall", "f1", "exact_graph_accuracy")})


# Sampling and splits. Row keys are ordered by MD5 of the key and the seed.

_KEY = "md5(sample_id || '|42')"
_ONE = f", one AS (SELECT * FROM sample QUALIFY row_number() OVER (PARTITION BY hallucinated, source_id ORDER BY {_KEY}, sample_id) = 1)"


@_query(_ONE + ", top AS (SELECT *, row_number() OVER (PARTITION BY hallucinated ORDER BY md5(source_id || '|42'), source_id) AS n FROM one) SELECT sample_id, source_id, hallucinated FROM top WHERE n <= 10")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_groups(fx.samples(spark, sf), "hallucinated", "source_id", "sample_id", 10, 10, strict=False).select("sample_id", "source_id", "hallucinated")


@_query(f"""
, c AS (SELECT * FROM (SELECT * FROM sample WHERE hallucinated = 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {_KEY}, sample_id) = 1) ORDER BY {_KEY}, sample_id LIMIT 15)
, h AS (SELECT * FROM (SELECT * FROM sample WHERE hallucinated = 1 AND source_id NOT IN (SELECT source_id FROM c) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {_KEY}, sample_id) = 1) ORDER BY {_KEY}, sample_id LIMIT 15)
SELECT sample_id, source_id, hallucinated FROM c UNION ALL SELECT sample_id, source_id, hallucinated FROM h
""")
def exclusive_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.samples(spark, sf)
    clean = sampling.class_sample(s, "hallucinated", 0, "source_id", "sample_id", 15)
    return clean.unionByName(sampling.class_sample(s, "hallucinated", 1, "source_id", "sample_id", 15, excluded=clean)).select("sample_id", "source_id", "hallucinated")


@_query(f"""
, z AS (SELECT task_type, count(*) AS n, sum(hallucinated) AS pos FROM sample GROUP BY 1), l AS (SELECT min(n) AS least FROM z)
, w AS (SELECT task_type, greatest(1, round_even(least * pos::DOUBLE / n, 0))::BIGINT AS want, least FROM z, l)
, r AS (SELECT sample_id, task_type, hallucinated, row_number() OVER (PARTITION BY task_type, hallucinated ORDER BY {_KEY}, sample_id) AS k FROM sample)
SELECT sample_id, task_type, hallucinated FROM r JOIN w USING (task_type) WHERE k <= CASE WHEN hallucinated = 1 THEN want ELSE least - want END
""")
def stratified_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_downsample(fx.samples(spark, sf), "task_type", "hallucinated", "sample_id").select("sample_id", "task_type", "hallucinated")


@_query("""
, g AS (SELECT source_id, (avg(hallucinated) >= 0.5)::INT AS major FROM sample GROUP BY 1), f AS (SELECT source_id, ((row_number() OVER (PARTITION BY major ORDER BY md5(source_id || '|42'), source_id) - 1) % 5)::INT AS fold FROM g)
SELECT sample_id, source_id, fold FROM sample JOIN f USING (source_id)
""")
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.group_folds(fx.samples(spark, sf), "source_id", "hallucinated", 5).select("sample_id", "source_id", "fold")


@_query(f"SELECT sample_id, hallucinated, ((row_number() OVER (PARTITION BY hallucinated ORDER BY {_KEY}, sample_id) - 1) % 5)::INT AS fold FROM sample")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_folds(fx.samples(spark, sf), "hallucinated", "sample_id", 5).select("sample_id", "hallucinated", "fold")


@_query(f"SELECT sample_id FROM sample ORDER BY {_KEY}, sample_id LIMIT 50")
def seeded_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffled(fx.samples(spark, sf), "sample_id", 50).select("sample_id")


_ASSIGN = "CASE ascii(md5(source_id)) % 8 WHEN 0 THEN 'val' WHEN 1 THEN 'test' END"


@_query(f"SELECT coalesce({_ASSIGN}, 'train') AS split, task_type, count(*) AS n, count(DISTINCT source_id) AS sources FROM sample GROUP BY ALL")
def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.samples(spark, sf)
    h = F.ascii(F.md5("source_id")) % 8
    assignment = s.select("source_id").distinct().withColumn("split", F.when(h == 0, "val").when(h == 1, "test")).filter("split is not null")
    return prepare.assign_splits(s, assignment).groupBy("split", "task_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


@_query("SELECT count(*) AS source_count, sha256(string_agg(source_id, chr(10) ORDER BY source_id)) AS digest FROM (SELECT DISTINCT source_id FROM sample)")
def source_digest(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.digest(fx.samples(spark, sf), "source_id")


@_query("SELECT sample_id, task_type FROM sample WHERE sample_id NOT IN (SELECT conv_id::VARCHAR FROM conversations)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    from groundwork.streaming.extraction import remaining

    done = fx.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("sample_id"))
    return remaining(fx.samples(spark, sf), done).select("sample_id", "task_type")


# Joins.


@_query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", base=False)
def join_many_to_one(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return contracts.join(o, fx.table(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), ["k"], require_match=True).select("o_orderkey", "c_name", "o_totalprice")


@_query("SELECT d.doc_id AS source_id, d.lang, coalesce(CASE l.toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END, '?') AS task_type, coalesce(l.quality::VARCHAR, '{}') AS source_info FROM documents d LEFT JOIN labels l USING (doc_id)", base=False)
def join_left_defaults(spark: SparkSession, sf: str) -> DataFrame:
    sources = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("source_id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("task_type"), F.col("quality").cast("string").alias("source_info"))
    return prepare.join_sources(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "lang"), sources, "default")


@_query("SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'", base=False)
def question_answer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "question", "answer")


@_query("SELECT l.doc_id FROM labels l WHERE toxic = 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND lang = 'en')", base=False)
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "labels").filter("toxic = 1").join(fx.table(spark, sf, "documents").filter("lang = 'en'"), "doc_id", "left_semi").select("doc_id")


# Aggregates, sets and tables.


@_query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, median(n_chars)::DOUBLE AS median_chars FROM documents GROUP BY 1, 2", base=False)
def named_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), _r(F.avg("n_chars")).alias("mean_chars"), F.median("n_chars").alias("median_chars"))


@_query("SELECT event_type || '|' || user_id AS k, arg_max(value, event_id) AS e, arg_max(props, event_id) AS t FROM events GROUP BY 1", base=False)
def last_record_wins(spark: SparkSession, sf: str) -> DataFrame:
    records = fx.table(spark, sf, "events").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("k"), F.col("value").alias("e"), F.col("props").alias("t"), "event_id")
    return readers.entity_cache(records, "event_id")


@_query("SELECT source_id FROM (SELECT DISTINCT source_id FROM sample WHERE hallucinated = 1 INTERSECT SELECT DISTINCT source_id FROM sample WHERE hallucinated = 0)")
def shared_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.samples(spark, sf)
    return contracts.shared(s.filter("hallucinated = 1"), s.filter("hallucinated = 0"), "source_id")


@_query("SELECT sample_id, key FROM ans EXCEPT SELECT sample_id, key FROM ctx")
def novel_names(spark: SparkSession, sf: str) -> DataFrame:
    context, answer = _names(spark, sf)
    return answer.select("sample_id", "key").join(context, ["sample_id", "key"], "left_anti")


@_query("SELECT doc_id, CASE WHEN quality >= 1 - 1e-12 THEN 0 ELSE 1 END AS unfaithful, (NOT (CASE toxic WHEN 0 THEN 'no' ELSE 'yes' END) IN ('factual', 'no', 'false', '0', 'nan'))::INT AS not_factual FROM labels", base=False)
def label_rules(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 0, "No").otherwise("Yes")
    return fx.table(spark, sf, "labels").select("doc_id", prepare.label_unfaithful(F.col("quality").cast("double")).alias("unfaithful"), prepare.label_not_factual(verdict).alias("not_factual"))


@_query("SELECT task_type, count(*) AS n_samples, count(risk) AS n_predicted, round(avg((risk IS NOT NULL)::INT), 6) AS coverage, round(avg(hallucinated), 6) AS hallucination_rate FROM scored GROUP BY 1")
def coverage_by_task(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    p = s.withColumn("risk_score", F.col("risk")).withColumn("prediction", (F.col("risk") >= 0.5).cast("int"))
    return metrics.task_metrics(p).select("task_type", "n_samples", "n_predicted", _r(F.col("coverage")).alias("coverage"), _r(F.col("hallucination_rate")).alias("hallucination_rate"))


@_query("SELECT t.task_type, t.task_order::INT AS task_order, s.n FROM (VALUES ('Data2txt', 0), ('QA', 1), ('Summary', 2), ('XSum', 3)) t(task_type, task_order) LEFT JOIN (SELECT task_type, count(*) AS n FROM sample WHERE toxic = 1 GROUP BY 1) s USING (task_type)")
def task_order(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.in_task_order(fx.samples(spark, sf).filter("toxic = 1").groupBy("task_type").agg(F.count("*").alias("n")), TASKS)


# Text.


@_query(r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tokens FROM documents", base=False)
def text_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return fx.table(spark, sf, "documents").select("doc_id", X.normalize(t).alias("t"), X.word_count(t).cast("long").alias("words"), F.size(X.tokens(F.lower(t))).cast("long").alias("tokens"))


@_query(r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '(^|[^\p{L}\p{N}_])(the|a|an)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(the|a|an)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM benchmark", base=False)
def entity_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "benchmark").select("item_id", X.normalize_entity(F.col("text")).alias("key"))


@_query("""
, tok AS (SELECT d.doc_id AS sample_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS tok_id FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents) d)
, o AS (SELECT sample_id, tok_id, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY sample_id ORDER BY tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tok)
SELECT sample_id, tok_id, start, start + length(token) AS "end" FROM o
""")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("sent_id"), F.posexplode(F.split("text", " ")).alias("tok_id", "token"))
    return align.token_offsets(d).select("sample_id", F.col("tok_id").cast("long").alias("tok_id"), "start", "end")


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, (props IS NOT NULL AND json_valid(props)) AS valid FROM events", base=False)
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    v = parsing.tolerant_variant(F.concat(F.lit("x "), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit(" y")))
    return fx.table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("valid"))


@_query("SELECT doc_id, source || '::' || doc_id AS key, regexp_extract(source || '_' || doc_id, '^(.*)_([^_]*)$', 1) AS system, regexp_extract(source || '_' || doc_id, '^(.*)_([^_]*)$', 2) AS bbcid FROM documents", base=False)
def composite_keys(spark: SparkSession, sf: str) -> DataFrame:
    a, b = X.rsplit_once(F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".0"))))
    return fx.table(spark, sf, "documents").select("doc_id", F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("key"), a.alias("system"), X.normalize_bbcid(b).alias("bbcid"))


@_query("SELECT sample_id, side, string_agg(head_text || '|' || relation_id || '|' || tail_text, ';' ORDER BY pos) AS triplets FROM relation GROUP BY 1, 2")
def linearised_relations(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.relations(spark, sf)
    one = F.concat_ws(" ", F.lit("<triplet>"), "head_text", F.lit("<subj>"), "tail_text", F.lit("<obj>"), "relation_id")
    lines = r.groupBy("sample_id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))).alias("l"))
    got = lines.select("sample_id", "side", parsing.linearised_triplets(F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("t"))
    return got.select("sample_id", "side", F.array_join(F.transform("t", lambda x: F.concat_ws("|", x["subject"], x["relation"], x["object"])), ";").alias("triplets"))


@_query()
def sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.windows(fx.table(spark, sf, "documents"), windows.word_limit(80), "doc_id")


@_query()
def single_pass_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.windows(fx.table(spark, sf, "documents"), windows.word_limit(80), "doc_id", windowing=False)


# Gold clusters: the names of a sample's context, clustered by their first three letters.

_CLUSTER = ", cl AS (SELECT DISTINCT sample_id, key AS name, ascii(key) AS cluster_id FROM ctx), gold AS (SELECT DISTINCT sample_id, ascii(head) AS h, relation_id AS r, ascii(tail) AS t FROM triple WHERE side = 'context')"


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    context, _ = _names(spark, sf)
    t = align.side(graphs.unique_triples(fx.relations(spark, sf)), "context")
    return context.select("sample_id", F.col("key").alias("name"), F.ascii("key").alias("cluster_id")), t.select("sample_id", F.ascii("head").alias("h"), F.col("relation_id").alias("r"), F.ascii("tail").alias("t")).distinct()


@_query(_CLUSTER + """
, cov AS (SELECT DISTINCT cl.sample_id, cluster_id FROM cl JOIN ans ON ans.sample_id = cl.sample_id AND ans.key = cl.name)
SELECT g.sample_id, count(*) AS n_gold, count_if(a.cluster_id IS NOT NULL AND b.cluster_id IS NOT NULL)::BIGINT AS n_reachable, round(count_if(a.cluster_id IS NOT NULL AND b.cluster_id IS NOT NULL) / count(*), 6) AS ceiling
FROM gold g LEFT JOIN cov a ON a.sample_id = g.sample_id AND a.cluster_id = h LEFT JOIN cov b ON b.sample_id = g.sample_id AND b.cluster_id = t GROUP BY 1
""")
def endpoint_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    clusters, gold = _clusters(spark, sf)
    _, answer = _names(spark, sf)
    return align.endpoint_ceiling(gold, align.covered_clusters(answer, clusters, key=lambda c: c)).withColumn("ceiling", _r(F.col("ceiling")))


@_query(_CLUSTER + """
, cov AS (SELECT DISTINCT cl.sample_id, cluster_id FROM cl JOIN ans ON ans.sample_id = cl.sample_id AND ans.key = cl.name)
SELECT count(*) AS n_gold, count_if(a.cluster_id IS NOT NULL AND b.cluster_id IS NOT NULL)::BIGINT AS n_reachable, round(count_if(a.cluster_id IS NOT NULL AND b.cluster_id IS NOT NULL) / count(*), 6) AS ceiling
FROM gold g LEFT JOIN cov a ON a.sample_id = g.sample_id AND a.cluster_id = h LEFT JOIN cov b ON b.sample_id = g.sample_id AND b.cluster_id = t
""")
def micro_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.micro_ceiling(endpoint_ceiling(spark, sf)).withColumn("ceiling", _r(F.col("ceiling")))


@_query("SELECT task_type, count(eg) AS n, count_if(eg IS NULL)::BIGINT AS n_missing, round_even(median(eg), 1)::DOUBLE AS median, round_even(avg(eg), 1) AS mean, count_if(eg < 0.5)::BIGINT AS n_below, round_even(100 * count_if(eg < 0.5) / nullif(count(eg), 0), 0) AS pct_below FROM scored GROUP BY 1")
def global_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.global_report(_scored(spark, sf), "eg", 0.5, ["task_type"])


@_query("SELECT task_type, round(avg(n_answer), 6) AS n_answer, round(avg(n_shared), 6) AS n_shared, round(avg(eg), 6) AS eg FROM scored GROUP BY 1")
def column_means(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.column_means(_scored(spark, sf), ["task_type"], "n_answer", "n_shared", "eg")
    return m.withColumns({c: _r(F.col(c)) for c in ("n_answer", "n_shared", "eg")})


@_query("""
SELECT doc_id, json_extract_string(j, '$.text') AS text, score FROM (SELECT doc_id, to_json({'text': source, 'score': NULL}) AS j, 0.0::DOUBLE AS score FROM documents)
""", base=False)  # fmt: skip
def parsed_relations(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.to_json(F.struct(F.lit(0).alias("head_start"), F.char_length("source").alias("head_end"), F.col("source").alias("head_text"), F.lit(0).alias("tail_start"), F.lit(1).alias("tail_end"), F.lit("x").alias("tail_text"), F.lit("part_of").alias("relation_id")))
    r = parsing.parsed_relation(raw)
    return fx.table(spark, sf, "documents").select("doc_id", r["head_text"].alias("text"), r["score"].alias("score"))


@_query(_CLUSTER + "SELECT a.sample_id, a.key, min(cluster_id) AS cluster_id FROM ans a JOIN cl ON cl.sample_id = a.sample_id AND cl.name = a.key GROUP BY 1, 2 HAVING count(DISTINCT cluster_id) = 1")
def unique_alignment(spark: SparkSession, sf: str) -> DataFrame:
    clusters, _ = _clusters(spark, sf)
    _, answer = _names(spark, sf)
    return align.aligned_cluster(answer, clusters, key=lambda c: c)


@_query(_CLUSTER + """
, m AS (SELECT * FROM (VALUES ('part_of', 'inside', false), ('member_of', 'has_member', true)) v(docred_id, name, turn))
SELECT DISTINCT sample_id, CASE WHEN turn THEN t ELSE h END AS h, name AS r, CASE WHEN turn THEN h ELSE t END AS t FROM gold JOIN m ON r = docred_id
""")
def mapped_gold(spark: SparkSession, sf: str) -> DataFrame:
    _, gold = _clusters(spark, sf)
    mapping = spark.createDataFrame([("part_of", "mapped", "inside", False), ("member_of", "mapped", "has_member", True), ("spouse_of", "unmapped", None, None)], "docred_id string, status string, hgr_relation string, reverse_direction boolean")
    return graphs.mapped_triples(gold, mapping)


@_query(_CLUSTER + """
, rel AS (SELECT r.sample_id, r.head, r.relation_id AS r, r.tail, a.cluster_id AS h, b.cluster_id AS t FROM relation r LEFT JOIN cl a ON a.sample_id = r.sample_id AND a.name = r.head LEFT JOIN cl b ON b.sample_id = r.sample_id AND b.name = r.tail WHERE side = 'response')
, lost AS (SELECT sample_id, count(*) AS n FROM (SELECT DISTINCT sample_id, head, r, tail FROM rel WHERE h IS NULL OR t IS NULL OR h = t) GROUP BY 1)
, m AS (SELECT coalesce(g.sample_id, p.sample_id) AS sample_id, count_if(g.h IS NOT NULL AND p.h IS NOT NULL) AS tp, count_if(g.h IS NULL) AS fp, count_if(p.h IS NULL) AS fn
    FROM gold g FULL JOIN (SELECT DISTINCT sample_id, h, r, t FROM rel WHERE h <> t) p ON p.sample_id = g.sample_id AND p.h = g.h AND p.r = g.r AND p.t = g.t GROUP BY 1)
SELECT coalesce(m.sample_id, lost.sample_id) AS sample_id, coalesce(tp, 0)::BIGINT AS tp, (coalesce(fp, 0) + coalesce(n, 0))::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn FROM m FULL JOIN lost ON lost.sample_id = m.sample_id
""")
def document_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    clusters, gold = _clusters(spark, sf)
    rel = align.side(fx.relations(spark, sf), "response").withColumn("head_text", X.norm(F.col("head_text"))).withColumn("tail_text", X.norm(F.col("tail_text")))
    predicted = align.aligned_triples(rel, clusters, key=lambda c: c)
    return metrics.set_prf(predicted, gold.select("sample_id", F.col("h").cast("long").alias("h"), "r", F.col("t").cast("long").alias("t")), ["sample_id", "h", "r", "t"]).select("sample_id", "tp", "fp", "fn")


@_query()
def greedy_entity_matches(spark: SparkSession, sf: str) -> DataFrame:
    clusters, _ = _clusters(spark, sf)
    return align.greedy_matches(align.side(fx.entities(spark, sf), "response"), clusters, key=X.norm)


# Models.

_W, _B = (0.8, -1.5), 0.25


@_query("SELECT sample_id, round(1 / (1 + exp(-(0.25 + 0.8 * ln(1 + n_answer - n_shared) - 1.5 * coalesce(eg, 0)))), 6) AS risk_score, (1 / (1 + exp(-(0.25 + 0.8 * ln(1 + n_answer - n_shared) - 1.5 * coalesce(eg, 0)))) >= 0.5)::INT AS prediction FROM scored")
def score_fixed_coefs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).withColumns({"x1": F.log1p(F.col("n_answer") - F.col("n_shared")), "x2": F.coalesce("eg", F.lit(0.0)), "can_predict": F.lit(1)})
    models = {t: model.Logistic(["x1", "x2"], [0.0, 0.0], [1.0, 1.0], [*_W], _B) for t in TASKS}
    return model.predict(rows, models).select("sample_id", _r(F.col("risk_score")).alias("risk_score"), "prediction")


@_query(_ALIGNED + """
, m AS (SELECT coalesce(median(1 - eg), 0.5) AS e, coalesce(median(1 - rp), 0.5) AS r, coalesce(median(1 - sc), 0.5) AS c FROM al)
SELECT sample_id, round(coalesce(1 - eg, e), 6) AS risk_eg, round(coalesce(1 - rp, r), 6) AS risk_rp, round(coalesce(1 - sc, c), 6) AS risk_sc, (eg IS NULL)::INT AS missing_eg, (rp IS NULL)::INT AS missing_rp, (sc IS NULL)::INT AS missing_sc FROM al, m
""")
def impute_missing(spark: SparkSession, sf: str) -> DataFrame:
    s = align.alignment_metrics(fx.samples(spark, sf).select("sample_id"), fx.entities(spark, sf), fx.relations(spark, sf), key=X.norm)
    out = model.detector_features(s.drop("missing_eg", "missing_rp", "missing_sc"), model.impute_medians(s))
    return out.select("sample_id", *[_r(F.col(f"risk_{x}")).alias(f"risk_{x}") for x in ("eg", "rp", "sc")], *[f"missing_{x}" for x in ("eg", "rp", "sc")])


@_query()
def task_models(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of every sample by the model of its task, fitted on the feature rows; a task with one class has none."""
    y = fx.samples(spark, sf).select("sample_id", "hallucinated")
    rows = align.feature_rows(fx.samples(spark, sf), fx.entities(spark, sf), fx.relations(spark, sf), names=fx.names(spark, sf)).join(y, "sample_id").persist()
    return model.predict(rows, model.fit_tasks(rows)).select("sample_id", "task_type", "status", _r(F.col("risk_score")).alias("risk_score"), "prediction")
