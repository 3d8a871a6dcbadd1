"""Sources, sinks and resumable extraction on files."""

import json

import pytest
from pyspark.sql import functions as F

from groundwork import contracts, schemas
from groundwork.sources import readers, sinks
from groundwork.streaming import extraction


def lines(path, *texts):
    path.write_text("\n".join(texts) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_modes(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", '{"k":1}', "", "{bad", '{"k":2}')
    assert sorted(r.k for r in readers.jsonl(spark, p, "k int", "lenient").collect()) == [1, 2]
    assert readers.bad_lines(spark, p) == 1
    for mode in ("strict", "skip_blank"):
        with pytest.raises(Exception, match="bad JSON"):
            readers.jsonl(spark, p, "k int", mode).collect()
    good = lines(tmp_path / "b.jsonl", '{"k":1}', "", '{"k":2}')
    assert readers.jsonl(spark, good, "k int", "skip_blank").count() == 2


def test_csv_with_newlines_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y""\nz"\n2,\n')
    got = readers.numbered_csv(spark, str(tmp_path / "a.csv"), "a int, b string").orderBy("line").collect()
    assert [(r.a, r.b) for r in got] == [(1, 'x "y"\nz'), (2, None)]


def test_texts_and_prepared(spark):
    ok = spark.createDataFrame([(1, " QA ", "c", "r")], "sample_id int, task_type string, context string, response string")
    assert readers.validated_texts(ok).first().task_type == "QA"
    with pytest.raises(contracts.ContractError):
        readers.validated_texts(ok.withColumn("context", F.lit(None).cast("string")))
    with pytest.raises(contracts.ContractError):
        readers.validated_texts(ok.union(ok))
    with pytest.raises(contracts.ContractError):
        readers.prepared(ok, "d", "train")
    full = ok.withColumns({"source_id": F.lit("s"), "generator_model": F.lit(None).cast("string"), "hallucinated": F.lit("1")})
    one = readers.prepared(full, "d", "train")
    assert tuple(one.select("sample_id", "source_id", "generator_model", "hallucinated", "split").first()) == ("d::1", "d::s", "unknown", 1, "train")
    assert readers.split_of([one, one.withColumn("extra", F.lit(1))]).count() == 2


def test_cache_hash_and_columns(spark, tmp_path):
    c = spark.createDataFrame([("a", ["x"], 1.0, 0), ("a", ["y"], 2.0, 1)], "k string, e array<string>, t double, line int")
    assert tuple(readers.entity_cache(c).first()) == ("a", ["y"], 2.0)
    p = lines(tmp_path / "x", "hello")
    import hashlib

    assert readers.file_hashes(spark, p).first().sha256 == hashlib.sha256(b"hello\n").hexdigest()


def test_split_sink(spark, tmp_path):
    df = spark.createDataFrame([("d", "train", 1), ("d", "test", 2)], "dataset string, split string, x int")
    sinks.write_splits(df, f"{tmp_path}/s", {"d/train": 1, "d/test": 1})
    with pytest.raises(Exception, match="already exists"):
        sinks.write_splits(df, f"{tmp_path}/s")
    with pytest.raises(contracts.ContractError):
        sinks.write_splits(df, f"{tmp_path}/s", {"d/train": 2}, force=True)
    sinks.upsert(df.filter("split = 'test'").withColumn("x", F.lit(9)).drop("dataset"), f"{tmp_path}/u", "split")
    sinks.upsert(df.filter("split = 'train'").drop("dataset"), f"{tmp_path}/u", "split")
    assert spark.read.parquet(f"{tmp_path}/u").count() == 2
    assert sinks.cached(spark, f"{tmp_path}/c", lambda: df).count() == sinks.cached(spark, f"{tmp_path}/c", lambda: 1 / 0).count()


def test_resumable_extraction(spark, tmp_path):
    s = spark.createDataFrame([("1", "QA", "Ann met Bob", "Ann left"), ("2", "QA", "", "Zed"), ("3", "Summary", "Kim", "Kim")], schemas.TEXTS)
    path = f"{tmp_path}/graphs"
    first = extraction.extract_resumable(spark, s.filter("sample_id = '1'"), extraction.capitalised_words, path)
    assert first.count() == 1
    both = extraction.extract_resumable(spark, s, extraction.capitalised_words, path, slices=2)
    assert both.count() == 3
    assert spark.read.schema(schemas.GRAPH_PAIR).json(path).count() == 3
    g = {r.sample_id: r for r in both.collect()}
    assert [e.text for e in g["1"].context_graph.entities] == ["Ann", "Bob"]
    assert g["2"].context_graph.entities == []
    with pytest.raises(contracts.ContractError):
        extraction.get_graphs(spark, s.withColumn("sample_id", F.concat("sample_id", F.lit("x"))), path)


def test_stream_extraction(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rec = {"sample_id": "1", "task_type": "QA", "context": "Ann", "response": "Bob"}
    lines(src / "a.json", json.dumps(rec), json.dumps(rec | {"sample_id": "2"}))
    for extra in ("2", "3"):
        extraction.extract_stream(spark, str(src), schemas.TEXTS, extraction.capitalised_words, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        lines(src / f"b{extra}.json", json.dumps(rec | {"sample_id": extra}))
    assert readers.graphs(spark, f"{tmp_path}/out").count() == 2


def test_halving():
    calls = []

    def run(texts, task):
        calls.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return [{}] * len(texts)

    assert len(extraction.with_halving(run, ["x"] * 5, "QA", lambda e: isinstance(e, MemoryError))) == 5
    assert calls[0] == 5
    assert extraction.or_empty(lambda t, k: 1 / 0)(["a"], "QA") == [{"entities": [], "relations": []}]
