"""Suffix tree scores against a dictionary-based version of the definition."""

import math
import zlib
from collections import Counter

import pytest

from groundwork.llm import suffixtree as S

from .conftest import prose


def brute(rows, depth=S.DEPTH):
    seqs = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    learn = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    c = Counter(w for s, k in zip(seqs, learn) if k for w in s)
    total, distinct = sum(c.values()), len(c)
    root = lambda w: (c[w] + 1) / (total + distinct + 1)
    pairs = Counter()
    for s, k in zip(seqs, learn):
        for i in range(len(s)):
            for d in range(1, depth + 1):
                if k and i >= d:
                    pairs[tuple(s[i - d : i]), s[i]] += 1
    occurs = Counter()
    for (ctx, _), n in pairs.items():
        occurs[ctx] += n
    states, looked = {}, set()

    def p(ctx, w):
        if not ctx:
            return root(w)
        m = occurs[ctx] ** S.SHARE
        return (pairs[ctx, w] + m * p(ctx[1:], w)) / (occurs[ctx] + m)

    for d in range(1, depth + 1):
        for ctx, n in occurs.items():
            if len(ctx) == d and n >= S.LEAST and (d == 1 or states.get(ctx[1:]) and ctx[:-1] in looked):
                looked.add(ctx)
                m, gain = n**S.SHARE, 0
                for (c2, w), k in pairs.items():
                    if c2 == ctx:
                        q = math.exp(round(math.log(p(ctx[1:], w)) * S.GRID) / S.GRID)
                        gain += k * math.log((k - 1 + m * q) / (n - 1 + m) / q)
                states[ctx] = gain / n >= S.EPSILON
    out = []
    for (i, _), s, k in zip(rows, seqs, learn):
        score = 0
        for j, w in enumerate(s):
            ctx = ()
            for d in range(1, depth + 1):
                if j >= d and states.get(tuple(s[j - d : j])):
                    ctx = tuple(s[j - d : j])
                else:
                    break
            score += math.log10(p(ctx, w))
        out.append((i is None, i, not k, len(s), sum(c[w] > 0 for w in s), total, sum(math.log10(root(w)) for w in s), score))
    brute.states = states
    return sorted(out, key=lambda r: (r[0], r[1] or 0, r[7]))


@pytest.mark.parametrize("hot", [S.HOT, 60])  # contexts dealt by their next words give the same
def test_against_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, prose(i, 200)) for i in range(30)]
    rows += [(200 + i, "so it goes on and on until the end comes " * 3) for i in range(20)] + [(200, "so it goes on and on until the end comes ")]
    got = S.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r.doc_id is None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (r[0], r[1] or 0, r[7]))
    want = brute(rows)
    assert any(r[2] for r in want)
    assert {len(c) for c, s in brute.states.items() if s} == {1, 2, 3}
    assert not all(brute.states.values())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:6] == w[:6]
        assert g[6:] == pytest.approx(w[6:], rel=1e-6)


def test_small_blocks_and_buckets_give_the_same(spark, docs, monkeypatch):
    whole = sorted((r.n_tokens, round(r.score, 6)) for r in S.score(docs).collect())
    monkeypatch.setattr(S, "BLOCK", 500)
    monkeypatch.setattr(S, "BUCKET", 200)
    monkeypatch.setattr(S, "HOT", 100)
    assert sorted((r.n_tokens, round(r.score, 6)) for r in S.score(docs).collect()) == whole


def test_empty(empty):
    assert S.score(empty).collect() == []


def test_what_counts_as_a_context_does_not_rise_with_the_table(spark):
    """A context that comes 39 times is a state among 5 million tokens as it is among some thousands."""
    rare = [(i, "alpha beta gamma") for i in range(45)]
    learned = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rare)
    assert S.LEAST <= learned < 50
    for filler in (1, 500):
        rows = spark.range(1000, 1000 + filler).selectExpr("id AS doc_id", "repeat('x y z w ', 2500) AS text")
        got = S.score(rows.unionByName(spark.createDataFrame(rare, "doc_id long, text string"))).filter("doc_id < 1000").collect()
        n, m = learned, learned**S.SHARE
        total, distinct = got[0].train_tokens, 8 if filler > 1 or zlib.crc32(b"1000") % 7 != 2 else 4
        p = (learned + 1) / (total + distinct + 1)
        one = (n + m * p) / (n + m)  # gamma after beta, the end after gamma: always so
        end = (total - 3 * learned) // 10_001 + learned
        q = (end + 1) / (total + distinct + 1)
        last = q
        for _ in range(3):  # after gamma, beta gamma, alpha beta gamma
            last = (n + m * last) / (n + m)
        want = math.log10(p) + math.log10(one) + math.log10((n + m * one) / (n + m)) + math.log10(last)
        assert {round(r.score, 3) for r in got} == {round(want, 3)}


def test_word_hashes_do_not_stay(spark, monkeypatch):
    """Once words have numbers, what lies on disk for a block is less than its words' hashes alone: 8 bytes for each."""
    from pathlib import Path

    n = 120_000  # words, distinct and not guessable from one another
    rows = spark.range(40).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, {n // 40}), i -> sha2(concat(id, ' ', i), 256))) AS text")
    top, sizes, written = Path(S.common.scratch(spark).removeprefix("file://")), [], S.common.written
    before = {*top.glob("lm-blocks-*")}

    def measured(df, name, *rest):
        sizes.append(sum(f.stat().st_size for d in {*top.glob("lm-blocks-*")} - before for f in d.rglob("*.parquet")))
        return written(df, name, *rest)

    monkeypatch.setattr(S.common, "written", measured)
    assert S.score(rows).count() == 40
    assert 0 < sizes[-1] < 8 * n


def test_names_of_contexts_from_their_words_numbers():
    import numpy as np

    words = np.array([[1, 1, 5], [1, 1, 7], [1, 4, 0], [2, 0, 0], [2, 0, 0], [9, 9, 3]], np.uint64)  # a hot context may come twice
    want = words[:, 0]
    for i in (1, 2):
        want = S._longer(want, words[:, i])
    columns = list(words.T)
    steps = [S._steps(x, S._new_runs(columns[:i]) if i else np.zeros(1, int)) for i, x in enumerate(columns)]
    assert S._names(steps).tolist() == want.tolist()
    assert len(set(want.tolist())) == 5
