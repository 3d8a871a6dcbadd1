"""Scores of pairs of parts: every pair of a group, names read once a row."""

import random

import pytest
from pyspark.sql import functions as F

from groundwork.functions import similarity
from groundwork.functions import text as X
from groundwork.plans.queries import queries


def _parts(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("query", ["acronym_starts", "token_f1_pairs", "containment_pairs", "number_guard_pairs"])
def test_names_are_read_before_rows_meet(spark, tmp_path, query):
    sf = _parts(spark, tmp_path, [(1, "red ring", "B", 1), (2, "red bolt", "B", 1)])
    plan = queries()[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[: plan.index("Join")]


def test_acronyms_in_groups_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "PAIRS_IN_TASK", 50)
    r = random.Random(7)
    rows = [(i, r.choice([None, "", "nasa", "north sea", "n s", "sea 9", "of"]), r.choice(["B", "B", "B", "C", None]), r.choice([1, 1, 1, 2, None])) for i in range(120)]
    rows += [(None, "n s", "B", 1), (500, "a b", "D", 9), (501, "a-b", "D", 9), (500, "a-b", "D", 9)]
    got = sorted(tuple(x) for x in queries()["acronym_starts"](spark, _parts(spark, tmp_path, rows)).collect())
    first = lambda name: "".join(w[0] for w in _words(name))
    told = lambda a, b: 0.92 if a is not None and b is not None and len(_words(a)) > 1 and first(a) == first(b) else 0.0
    pairs = [(a, b) for a in rows for b in rows if None not in (*a[2:], *b[2:], a[0], b[0]) and a[2:] == b[2:] and a[0] < b[0]]
    own = {(a[0], None if a[1] is None else tuple(_words(a[1]))): a[1] for a, _ in pairs}
    assert got == sorted([(a[0], b[0], told(a[1], b[1])) for a, b in pairs] + [(i, i, told(name, name)) for (i, _), name in own.items()])


def _words(name):
    return name.replace("-", " ").split()


def test_groups_of_many_blocks(spark, monkeypatch):
    """Any two rows of a group meet once, whatever blocks they are in, and the left is the one of the lesser key."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    monkeypatch.setattr(similarity, "PAIRS_IN_TASK", 40)
    rows = [(i, f"n{i % 4}", i % 10 == 0) for i in range(-60, 60)] + [(None, "n0", False), (3, "n3", None), (7, "n9", False)]
    df = spark.createDataFrame(rows, "k long, name string, g boolean")
    got = similarity.scored_pairs(df, ["g"], "k", "name", lambda c: c, F.upper, lambda x, y: F.concat(x, y), "both")
    want = [(a[0], b[0], a[1] + b[1].upper()) for a in rows for b in rows if None not in (a[0], b[0], a[2]) and a[2] == b[2] and a[0] < b[0]]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, name string, g int")
    assert similarity.scored_pairs(df, ["g"], "k", "name", X.words, X.words, X.words_f1, "f1").collect() == []
