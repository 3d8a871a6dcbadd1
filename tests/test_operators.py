"""Operators on small tables with expected results worked out by hand or by a plain version."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork import contracts, schemas
from groundwork.constants import FEATURES
from groundwork.operators import align, graphs, metrics, model, prepare, sampling, windows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols or df.columns).collect())


ENT = "sample_id string, side string, pos int, text string, type string, score double"
REL = "sample_id string, side string, pos int, head_text string, relation_id string, tail_text string, score double"


def test_graph_entities_adds_ends(spark):
    e = spark.createDataFrame([("1", "response", 0, "Ann", "p", 0.5), ("1", "response", 1, "ANN", "p", 0.9), ("1", "response", 2, " ", "p", 1.0)], ENT)
    r = spark.createDataFrame([("1", "response", 0, "Ann", "spouse_of", "Bob", 1.0), ("1", "response", 1, "Bob", "spouse_of", "ann", 1.0)], REL)
    assert rows(graphs.graph_entities(e, r)) == [("1", "response", "ann", 0.9), ("1", "response", "bob", 0.0)]
    assert rows(graphs.unique_triples(r)) == [("1", "response", "ann", "spouse_of", "bob")]


def test_keep_best_keeps_first_of_equals(spark):
    e = spark.createDataFrame([("1", "context", 0, "The Hat", "x", 0.5), ("1", "context", 1, "hat", "x", 0.5), ("1", "context", 2, "the", "x", 1.0)], ENT)
    assert rows(graphs.dedup_entities(e), "pos", "key") == [(0, "hat")]
    s = spark.createDataFrame([("1", "context", 0, 0, 3, "Hat", "x", 0.5), ("1", "context", 1, 0, 3, "hat", "X", 0.7), ("1", "context", 2, 0, 3, "hat", "x", 0.7)], "sample_id string, side string, pos int, start int, end int, text string, label string, score double")
    assert rows(graphs.clean_entities(s), "pos") == [(1,)]


@pytest.mark.parametrize(("conf", "bad", "want"), [([0, 0], [True, False], 0.5), ([0.9, 0.1], [False, True], 0.1), ([], [], 0.0)])
def test_weighted_bad_rate(spark, conf, bad, want):
    df = spark.createDataFrame([(float(c), b) for c, b in zip(conf, bad)], "c double, b boolean")
    assert df.agg(align.weighted_bad_rate(F.col("c"), F.col("b"))).first()[0] == pytest.approx(want)


def _features(spark):
    s = spark.createDataFrame([("1", "QA"), ("2", "QA"), ("3", "QA"), ("4", "QA")], "sample_id string, task_type string")
    e = spark.createDataFrame(
        [("1", "context", 0, "United States", "l", 0.8), ("1", "response", 0, "US", "l", 0.6), ("1", "response", 1, "Zzz", "l", 0.4), ("2", "context", 0, "Ann", "p", 1.0), ("3", "response", 0, "Ann", "p", 1.0)], ENT
    )
    r = spark.createDataFrame([("1", "response", 0, "US", "part_of", "Zzz", 1.0), ("1", "response", 1, "US", "located_in", "united states", 1.0)], REL)
    return s, e, r


def test_feature_rows(spark):
    got = {r.sample_id: r for r in align.feature_rows(*_features(spark)).collect()}
    assert [got[i].status for i in "1234"] == ["predicted", "no_response_entities", "no_context_entities", "no_context_entities"]
    one = got["1"]
    # "united states" is an end of a response relation, so a response entity of score 0.
    assert (one.context_entity_count, one.response_entity_count, one.response_relation_count) == (1, 3, 2)
    assert one.weighted_ungrounded_entity_rate == pytest.approx(0.4)
    assert one.fuzzy_ungrounded_entity_rate == pytest.approx(1 / 3)
    assert one.fuzzy_novel_endpoint_relation_rate == pytest.approx(0.5)
    assert one.novel_endpoint_relation_rate == pytest.approx(1.0)
    assert one.ungrounded_response_entity_count_log == pytest.approx(math.log1p(2))
    assert one.entity_confidence_gap == pytest.approx(0.5 - 0.8)
    assert one.min_entity_support_similarity < 0.86
    assert got["3"].min_entity_support_similarity == 0.0
    assert len(one) == 18


def test_alignment_metrics_and_components(spark):
    s = spark.createDataFrame([("1",), ("2",)], "sample_id string")
    e = spark.createDataFrame([("1", "context", 0, "A1", "x", 1.0), ("1", "query", 0, "B1", "x", 1.0), ("1", "response", 0, "b1", "x", 1.0), ("1", "response", 1, "C1", "x", 1.0)], ENT)
    r = [("1", "context", i, h, "r", t, 1.0) for i, (h, t) in enumerate([("A1", "B1"), ("B1", "A1"), ("D1", "E1")])]
    r += [("1", "response", i, h, "r", t, 1.0) for i, (h, t) in enumerate([("a1", "b1"), ("b1", "a1"), ("x1", "y1"), ("a1", "b1")])]
    got = {x.sample_id: x for x in align.alignment_metrics(s, e, spark.createDataFrame(r, REL)).collect()}
    assert got["1"].eg == 0.5
    assert got["1"].rp == 0.75
    assert got["1"].sc == 0.25  # parallel edges are one, the denominator counts all
    assert (got["2"].eg, got["2"].rp, got["2"].sc, got["2"].missing_sc) == (None, None, None, 1)


def test_gold_clusters(spark):
    clusters = spark.createDataFrame([("1", 0, "Ann"), ("1", 0, "Annie"), ("1", 1, "Bob"), ("1", 2, "Bob")], "sample_id string, cluster_id int, name string")
    names = spark.createDataFrame([("1", "ann"), ("1", "bob"), ("1", "zed")], "sample_id string, key string")
    assert rows(align.aligned_cluster(names, clusters)) == [("1", "ann", 0)]
    gold = spark.createDataFrame([("1", 0, "r", 1), ("1", 0, "r", 3)], "sample_id string, h int, r string, t int")
    cover = align.covered_clusters(names, clusters)
    assert rows(cover) == [("1", 0), ("1", 1), ("1", 2)]
    assert rows(align.endpoint_ceiling(gold, cover)) == [("1", 2, 1, 0.5)]
    rel = spark.createDataFrame([("1", "response", 0, "Ann", "r", "zed", 1.0), ("1", "response", 1, "Ann", "r", "Annie", 1.0)], REL)
    assert all(h < 0 and t < 0 for _, h, _, t in rows(align.aligned_triples(rel, clusters)))
    ents = spark.createDataFrame([("1", "response", 0, "bob", "x", 1.0), ("1", "response", 1, "annie", "x", 1.0), ("1", "response", 2, "ann", "x", 1.0)], ENT)
    assert rows(align.greedy_matches(ents, clusters)) == [("1", 1, 3)]


def test_token_offsets(spark):
    t = spark.createDataFrame([("1", 0, 0, "Ab"), ("1", 0, 1, "c"), ("1", 1, 0, "d")], "sample_id string, sent_id int, tok_id int, token string")
    assert rows(align.token_offsets(t), "token", "start", "end") == [("Ab", 0, 2), ("c", 3, 4), ("d", 5, 6)]


def _auc(y, s):
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, p in zip(s, y) for b, q in zip(s, y) if p == 1 and q == 0]
    return sum(pairs) / len(pairs)


def test_ranking_metrics_against_definitions(spark):
    r = random.Random(3)
    data = [("g", r.randrange(2), r.randrange(6) / 5) for _ in range(60)] + [("one", 1, 0.5), ("one", 1, 0.7)]
    df = spark.createDataFrame(data, "g string, hallucinated int, risk double")
    got = {x.g: x for x in metrics.ranking(df, ["g"]).collect()}
    y, s = zip(*[(b, c) for a, b, c in data if a == "g"])
    assert got["g"].roc_auc == pytest.approx(_auc(y, s))
    ap, last = 0.0, 0.0
    for t in sorted({*s}, reverse=True):
        tp, n = sum(a for a, b in zip(y, s) if b >= t), sum(b >= t for b in s)
        ap, last = ap + (tp / sum(y) - last) * tp / n, tp / sum(y)
    assert got["g"].average_precision == pytest.approx(ap)
    assert got["one"].roc_auc is None
    best = {x.g: x for x in metrics.best_f1_threshold(df, ["g"]).collect()}["g"]
    f1 = lambda t: 2 * sum(a for a, b in zip(y, s) if b >= t) / (sum(b >= t for b in s) + sum(y))
    assert best.threshold == min({0.0, 1.0, *s}, key=lambda t: (-f1(t), t))
    assert best.f1 == pytest.approx(f1(best.threshold))


def test_task_metrics_null_where_undefined(spark):
    df = spark.createDataFrame([("QA", 1, 0.9, 1), ("QA", 0, 0.2, 0), ("QA", 0, None, None), ("XSum", 1, 0.5, 1)], "task_type string, hallucinated int, risk_score double, prediction int")
    got = {r.task_type: r for r in metrics.task_metrics(df).collect()}
    assert got["QA"].coverage == pytest.approx(2 / 3)
    assert (got["QA"].roc_auc, got["QA"].f1, got["QA"].pr_auc) == (1.0, 1.0, 1.0)
    assert got["XSum"].roc_auc is None
    assert got["XSum"].f1 is None


def test_histogram_and_boxes(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.5, 1.0, 1.0)], "g string, x double")
    assert rows(metrics.histogram(df, ["g"], "x", 10)) == [("a", 0, 1), ("a", 5, 1), ("a", 9, 2)]
    assert rows(metrics.box_stats(df, ["g"], "x")) == [("a", 4, 0.0, 0.375, 0.75, 1.0, 1.0)]


def test_labels_and_sources(spark):
    schema = "labels array<struct<implicit_true:boolean>>"
    df = spark.createDataFrame([([(True,)],), ([(True,), (None,)],), ([],), (None,)], schema)
    assert [tuple(r) for r in df.select(prepare.label_not_implicit(F.col("labels")), prepare.label_any(F.col("labels"))).collect()] == [(0, 1), (1, 1), (0, 0), (0, 0)]
    src = [("QA", json.dumps({"question": "q  ?", "passages": "p\n1"})), ("Summary", json.dumps("a  b")), ("Data2txt", json.dumps({"name": "N"}))]
    got = spark.createDataFrame(src, "t string, raw string").select(prepare.serialize_source(F.col("t"), F.col("raw")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("p 1", "q ?"), ("a b", ""), ('{"name":"N"}', "")]
    with pytest.raises(Exception, match="unknown task type"):
        spark.createDataFrame([("X", "{}")], "t string, raw string").select(prepare.serialize_source(F.col("t"), F.col("raw"))).collect()
    record = json.dumps({"name": "N", "city": "", "hours": {"Mon": "9-5"}, "attributes": {"a": None, "b": "None", "c": "x"}, "business_stars": 4.5, "review_info": [{"review_text": "good"}, {}]})
    flat = spark.createDataFrame([(record,), ('"plain"',), ('{"question":"q","passages":"p"}',)], "raw string").select(prepare.flatten_source(F.col("raw")).alias("v")).collect()
    assert [r.v for r in flat] == ["name: N\nhours: Mon 9-5\nattributes: c x\nbusiness stars: 4.5\ngood", "plain", "q\np"]


def test_prepare_summaries(spark):
    ann = spark.createDataFrame([("1.0", "BERTS2S", "s one", 0), ("1", "BERTS2S", "s one", 1), ("2", "PtGen", "t", 2), ("3", "Other", "u", 3)], "bbcid string, system string, summary string, line long")
    sc = spark.createDataFrame([("bert_withckpt_1", 1.0, 1.0), ("bert_withckpt_1", 0.5, float("nan")), ("ptgen_2", 1.0, 0.0)], "system_bbcid string, Faithful double, Factual double")
    art = spark.createDataFrame([("1", "doc"), ("2", "two")], "id string, document string")
    assert rows(prepare.prepare_summaries(ann, sc, art), "sample_id", "hallucinated", "Faithful", "Factual") == [("bert_withckpt::1", 1, 0.75, 1.0), ("ptgen::2", 0, 1.0, 0.0)]


def test_join_contracts(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(contracts.ContractError):
        contracts.join(a, b, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.join(a, b.limit(1), ["k"], require_match=True)
    with pytest.raises(contracts.ContractError):
        contracts.disjoint(a, b, "k")


def test_manifest_split(spark):
    import hashlib

    s = spark.createDataFrame([(str(i), f"s{i % 4}") for i in range(8)], "sample_id string, source_id string")
    digest = hashlib.sha256("s0\ns1\ns2\ns3".encode()).hexdigest()
    schema = "datasets map<string,struct<source_count:int,source_ids_sha256:string,validation:array<string>,test:array<string>>>"
    m = spark.createDataFrame([({"d": (4, digest, ["s1"], ["s2"])},)], schema)
    assert rows(prepare.split_by_manifest(s, m, "d").groupBy("split").count()) == [("test", 2), ("train", 4), ("val", 2)]
    with pytest.raises(contracts.ContractError):
        prepare.split_by_manifest(s.filter("source_id <> 's0'"), m, "d")


def test_sampling(spark):
    df = spark.createDataFrame([(f"i{i}", f"g{i % 7}", i % 3 // 2, "ab"[i % 5 == 0]) for i in range(70)], "k string, g string, y int, t string")
    b = sampling.balanced_groups(df, "y", "g", "k", 3, 3)
    assert rows(b.groupBy("y").agg(F.count("*"), F.countDistinct("g"))) == [(0, 3, 3), (1, 3, 3)]
    with pytest.raises(contracts.ContractError):
        sampling.balanced_groups(df, "y", "g", "k", 8, 1)
    f = sampling.group_folds(df, "g", "y", 3)
    assert f.select("g", "fold").distinct().count() == 7
    down = rows(sampling.stratified_downsample(df, "t", "y", "k").groupBy("t").count())
    assert down == [("a", 14), ("b", 14)]


def test_windows_cover_and_advance(spark):
    text = "One two. Three four five! Six? Seven eight nine ten eleven. Twelve"
    spans = windows.sentence_spans(text)
    assert [text[a:b] for a, b in spans][:3] == ["One two.", "Three four five!", "Six?"]
    got = list(windows.overlapping(text, windows.word_limit(4)))
    assert all(len(t.split()) <= 4 and text[a:b] == t for t, a, b, *_ in got)
    assert {i for _, a, b, *_ in got for i in range(a, b)} >= {i for a, b in spans for i in range(a, b) if not text[i].isspace()}
    assert windows.single_pass(text, windows.word_limit(5))[0] == "One two. Three four five!"
    assert windows.single_pass(text, windows.word_limit(99))[0] == text
    with pytest.raises(ValueError, match="exceeds"):
        windows.overlapping(text, lambda *a: False)
    long = "One two. " + "x" * 25 + " Three four. Five."
    assert [w[1:] for w in windows.overlapping(long, lambda t, a, b: b - a <= 10)] == [(0, 8, 0, 1), (9, 19, 1, 2), (19, 29, 1, 2), (29, 39, 1, 2), (39, 46, 1, 2), (47, 52, 2, 3)]
    assert [w[3:] for w in windows.overlapping("A b. C d. E f. G h. I j. K l.", windows.word_limit(10))] == [(0, 5), (4, 6), (5, 6)]
    b = spark.range(1).select(windows.batches_of(F.array(*map(F.lit, range(5))), 2).alias("b")).first()["b"]
    assert b == [[0, 1], [2, 3], [4]]


def test_balanced_fit_solves_its_objective(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2)) * [1, 5] + [0, 3]
    y = (x[:, 0] + rng.normal(size=200) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    m = model.fit_balanced(df, ["a", "b"], "y", 0.1)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(200)]
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum()))) * 0.1
    theta = np.array([*m.weights, m.intercept])
    gradient = theta + z.T @ (w * (1 / (1 + np.exp(-z @ theta)) - y))
    assert np.abs(gradient).max() < 1e-6


def test_nonnegative_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=150) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    m = model.fit_nonnegative(df, ["a", "b"], "y", 0.1)
    assert m.weights[0] > 0.5
    assert m.weights[1] == 0.0


def test_models_are_saved_and_scored(spark, tmp_path):
    names = FEATURES["QA"]
    rows_ = [("QA", 1, float(i % 7), i / 50, int(i % 7 > 3)) for i in range(50)] + [("QA", 0, 0.0, 0.0, 0), ("XSum", 1, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows_, f"task_type string, can_predict int, {names[0]} double, {names[1]} double, hallucinated int")
    df = df.withColumns({n: F.lit(0.0) for fs in FEATURES.values() for n in fs if n not in names})
    models = model.fit_tasks(df)
    assert [*models] == ["QA"]
    model.save_models(spark, models, f"{tmp_path}/m")
    again = model.load_models(spark, f"{tmp_path}/m")
    out = model.predict(df, again)
    assert out.filter("risk_score is null").count() == 2
    first, second = (model.predict(df, m).orderBy(*names, "can_predict").select("risk_score").collect() for m in (models, again))
    assert first == second
    assert out.filter("can_predict = 1 and task_type = 'QA' and prediction <> hallucinated").count() <= 5
    assert model.coefficients(spark, models).count() == 2


def test_nested_folds_predict_every_row_once(spark):
    r = random.Random(2)
    data = [(f"k{i}", f"s{i % 12}", "QA", int(r.random() < 0.5), r.random(), None if i % 4 == 0 else r.random(), r.random()) for i in range(48)]
    df = spark.createDataFrame(data, "sample_id string, source_id string, task_type string, hallucinated int, eg double, rp double, sc double")
    out, folds = model.nested_oof(df, outer=2, inner=2, grid=(1.0,))
    assert out.count() == 48
    assert out.select("sample_id").distinct().count() == 48
    assert len(folds) == 2


def test_graphs_come_together_again_in_order(spark):
    kind = "sample_id string, task_type string, " + ", ".join(f"{s}_graph {schemas.GRAPH}" for s in ("context", "response"))
    e = lambda a, t: {"start": a, "end": a + 1, "text": t, "label": "x", "score": 1.0}
    r = lambda a, b, i: {"head_start": a, "head_end": a + 1, "head_text": "h", "tail_start": b, "tail_end": b + 1, "tail_text": "t", "relation_id": i, "score": 0.5}
    full = {"entities": [e(5, "b"), e(1, "a"), e(5, "c")], "relations": [r(5, 1, "z"), r(1, 5, "y"), r(1, 5, "x")]}
    pairs = spark.createDataFrame([("s", "QA", full, {"entities": [], "relations": []})], kind)
    got = graphs.assembled(pairs, *graphs.explode_graphs(pairs)).first()
    assert [x["text"] for x in got["context_graph"]["entities"]] == ["a", "b", "c"]
    assert [x["relation_id"] for x in got["context_graph"]["relations"]] == ["x", "y", "z"]
    assert got["response_graph"]["entities"] == got["response_graph"]["relations"] == []


def test_names_and_triplets_of_gold_clusters(spark):
    d = spark.createDataFrame([([["Ann", "she"], [], ["Bo"]], [(0, "p", 2), (2, "q", 1)], [" Ann ", "x"], ["Ann", "Bob"])], "c array<array<string>>, r array<struct<h:int,r:string,t:int>>, a array<string>, b array<string>")
    d = d.withColumn("n", graphs.first_mentions(F.col("c")))
    got = d.select("n", graphs.gold_triplets(F.col("n"), F.col("r")).alias("t"), graphs.name_sets(F.col("a"), F.col("b")).alias("s")).first()
    assert got["n"] == ["ann", None, "bo"]
    assert [tuple(x) for x in got["t"]] == [("ann", "p", "bo"), ("bo", "q", None)]
    assert got["s"] == ["Ann", "Bob"]


def test_wide_and_folded_letters_are_one_name(spark):
    from groundwork.functions import text as X

    texts = ["ＵＳ", "Straße ÉCOLE", "ﬁn", "ΣΊΣΥΦΟΣ", "K", "ı İ x", "①  ②"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.norm(F.col("t")).alias("a"), X.norm_exact(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows if "İ" not in r["t"]] == [r["b"] for r in rows if "İ" not in r["t"]]
    assert rows[0]["a"] == "us"


def test_runs_for_every_combination(spark):
    from groundwork.operators import model

    d = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), (None, 1, 5.0)], "t string, m int, x double")
    got = model.for_each(d, ["t", "m"], lambda part: part.agg(F.sum("x").alias("x")))
    assert sorted(map(tuple, got.collect()), key=str) == [(2.0, "a", 1), (3.0, "a", 2), (5.0, None, 1)]


def test_extractors_are_set_up_by_task():
    from groundwork.streaming import extraction

    seen = []
    run = extraction.by_task(lambda labels, relations, least: seen.append((len(labels), len(relations) > 0, least)) or (lambda texts, task: [task] * len(texts)))()
    assert run(["a", "b"], "QA") + run(["c"], "QA") + run(["d"], "XSum") == ["QA", "QA", "QA", "XSum"]
    assert seen == [(10, True, 0.7), (10, True, 0.3)]
