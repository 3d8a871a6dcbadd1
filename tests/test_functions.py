"""Scalar functions on hand-made cases with expected values worked out by hand."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from groundwork.functions import parsing
from groundwork.functions import text as X
from groundwork.functions.similarity import with_similarity


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in cells.items()))
    return row.select(column.alias("v")).first()["v"]


SIMILAR = [
    ("us", "us", 1.0), ("", "x", 0.0), ("may 2019", "may 2018", 0.0), ("apollo", "apollo 11", 0.0), ("us", "united states", 0.92),
    ("united states", "the united states", 0.90), ("of", "bank of america", None), ("nasa", "nasa centre", 0.90), ("north", "south", None),
]


def test_similarity(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in SIMILAR], "a string, b string")
    got = {(r.a, r.b): r.similarity for r in with_similarity(df, "a", "b").collect()}
    for a, b, want in SIMILAR:
        ratio = SequenceMatcher(None, a, b).ratio()
        if want is None:
            f1 = {"of": 0.5}.get(a, 0.0)
            want = max(ratio, f1)
        elif want in (0.9, 0.92):
            want = max(want, ratio)
        assert got[a, b] == pytest.approx(want), (a, b)


def _spec(a: str, b: str) -> float:
    """The similarity by its definition."""
    import re

    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    na, nb = (set(re.findall(r"\d+(?:[.,]\d+)?", x)) for x in (a, b))
    if na != nb:
        return 0.0
    ta, tb = (re.findall(r"\w+", x) for x in (a, b))
    best = SequenceMatcher(None, a, b).ratio()
    if ta and tb:
        best = max(best, 2 * len({*ta} & {*tb}) / (len({*ta}) + len({*tb})))
    short, long = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
    if short and {*short} <= {*long} and (len(short) > 1 or len(short[0]) >= 4):
        best = max(best, 0.9)
    for one, many in ((ta, tb), (tb, ta)):
        if len(one) == 1 and len(many) > 1 and one[0] == "".join(w[0] for w in many):
            best = max(best, 0.92)
    return best


def test_similarity_on_random_names(spark):
    r = random.Random(5)
    words = ["north", "sea", "port", "of", "st", "new", "york", "ny", "9", "1,5", "b-c", "x_y", "a" * 120]
    pairs = list({tuple(" ".join(r.choices(words, k=r.randrange(4))) for _ in range(2)) for _ in range(400)})
    got = {(x.a, x.b): x.similarity for x in with_similarity(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert all(got[p] == pytest.approx(_spec(*p)) for p in pairs)


def test_norm_exact_and_native(spark):
    df = spark.createDataFrame([("ＵＳ ",), ("  ",), ("Straße\n x",), (None,)], "t string")
    assert [r.v for r in df.select(X.norm_exact(F.col("t")).alias("v")).collect()] == ["us", "", "strasse x", None]
    assert [r.v for r in df.filter("t like 'Str%'").select(X.norm(F.col("t")).alias("v")).collect()] == ["strasse x"]


@pytest.mark.parametrize(
    ("text", "want"), [(" The Queen’s  Hat! ", "queen hat"), ("Rock-n-roll, an A", "rock-n-roll"), ("Été d'or", "été d or"), ("...", "")]
)
def test_normalize_entity(spark, text, want):
    assert value(spark, X.normalize_entity(F.col("t")), t=text) == want


def test_keys_and_numbers(spark):
    assert value(spark, X.normalize_bbcid(F.col("t")), t=" 123.0 ") == "123"
    assert value(spark, F.array(*X.rsplit_once(F.col("t"))), t="a_b_12") == ["a_b", "12"]
    assert value(spark, F.array(*X.rsplit_once(F.col("t"))), t="none") == [None, None]
    assert value(spark, X.normalize_relation(F.col("t")), t=" Part_of  x") == "part of x"
    assert value(spark, X.half_even(F.col("x"), 0), x=2.5) == 2
    assert value(spark, X.sigmoid(F.col("x")), x=1000.0) == pytest.approx(1 / (1 + math.exp(-30)))
    assert value(spark, X.word_count(F.col("t")), t="  ") == 0
    assert value(spark, X.ratio_or(F.col("a"), F.col("b")), a=1, b=0) == 0
    assert value(spark, X.prompt("{a}-{b}", a=F.col("t"), b=F.lit("y")), t="x") == "x-y"


@pytest.mark.parametrize(
    ("a", "b", "want"), [("Ab", "ab", True), ("", "x", False), ("york", "New  York", True), ("of", "bank of", False), ("abc", "xabcx", True)]
)
def test_soft_in(spark, a, b, want):
    assert value(spark, X.soft_in(F.col("a"), F.col("b")), a=a, b=b) is want


def test_tolerant_json(spark):
    got = lambda raw, fix=False: value(spark, F.to_json(parsing.tolerant_variant(F.col("t"), fix)), t=raw)
    assert got('x {"a":[1,],} y') == '{"a":[1]}'
    assert got("no braces") is None
    assert got('{"a":"x\ny"}') == '{"a":"x y"}'
    assert got("{bad}") is None
    e = value(spark, parsing.extraction(F.col("t")), t='{"entities":[" A ","B"],"triplets":[{"head":"a","relation":"r","tail":"b"},{"head":"a"}]}')
    assert e["entities"] == ["A", "B"]
    assert [tuple(t) for t in e["triplets"]] == [("a", "r", "b")]
    assert value(spark, parsing.extraction(F.col("t")), t="nothing")["entities"] == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<triplet> A <subj> B <obj> r", [("A", "r", "B")]),
        ("<s><triplet> A b <subj> C <obj> p q <triplet> D <subj> E <obj> f</s>", [("A b", "p q", "C"), ("D", "f", "E")]),
        ("<triplet> A <subj> B <obj> r <subj> C <obj> s", [("A", "r s", "B C")]),
        ("<triplet> A <subj> B", []), ("", []),
    ],
)
def test_linearised_triplets(spark, text, want):
    assert [tuple(t) for t in value(spark, parsing.linearised_triplets(F.col("t")), t=text)] == want


def test_relation_items(spark):
    item = lambda h, t, r="r": value(spark, parsing.relation_item(F.col("h"), F.col("t"), F.lit(r), F.col("e"), F.array(F.lit("r"))), h=h, t=t, e=["a", "b", "c"])
    assert tuple(item("e0", "e2")) == ("a", "r", "c")
    assert tuple(item("e0", "-1")) == ("a", "r", "c")
    assert item("e1", "e1") is None
    assert item("e1", "e9") is None
    assert item("x", "e1") is None
    assert item("e0", "e1", "other") is None


def test_parsed_entity(spark):
    got = value(spark, parsing.parsed_entity(F.col("t")), t='{"start":1,"end":3,"text":"ab","type":"person"}')
    assert tuple(got) == (1, 3, "ab", "person", 0.0)
    with pytest.raises(Exception, match="invalid entity"):
        value(spark, parsing.parsed_entity(F.col("t")), t='{"start":3,"end":1,"text":"ab"}')
