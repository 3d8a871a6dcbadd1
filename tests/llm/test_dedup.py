"""Exact, SimHash and embedding near-dedup against brute-force versions."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from groundwork.llm import common, embeddings, exact, simhash

from .conftest import prose


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# Exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for text, members in groups.items():
        best = max(members, key=lambda m: (m[1], m[0] is not None, -(m[0] or 0)))[0]
        out += [(str(i), str(best), len(members), i == best, hashlib.sha256(text.encode()).hexdigest()) for i, _ in members]
    return sorted(out)


def as_rows(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_against_brute_force(spark, docs):
    want = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert as_rows(exact.exact_duplicates(docs)) == want


def test_exact_hot_group(spark):
    rows = [(i, "same " * (i % 3) if i % 2 else f"text {i}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(exact.exact_duplicates(df)) == brute_exact(rows)


def test_index_persists(spark):
    path = common.fresh(spark, "index")
    first = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    index = exact.DigestIndex(spark, path, 4)
    exact.exact_duplicates(first, index=index)
    again = exact.DigestIndex(spark, path, 4).attach()
    more = spark.createDataFrame([(3, "ab  "), (4, "d"), (5, "d")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_duplicates(more, index=again).collect()}
    assert got == {3: (1, False), 4: (4, True), 5: (4, False)}
    assert again.rows().count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    join = more.select(F.col("text").alias("digest")).join(again.rows().hint("merge"), "digest", "left_anti")
    plan = join._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the index stays in its buckets


def test_exact_empty(empty):
    assert exact.exact_duplicates(empty).collect() == []


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, docs):
    base = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [prose(i, 300) for i in range(20)]
    near = [(200 + i, t.replace("fox", "cat", 1)) for i, t in enumerate(texts)]
    rows = base + [(100 + i, t) for i, t in enumerate(texts)] + near
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(t for _, t in rows)}
    links = [(i, j) for i in fps for j in fps if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4]
    comp = components(fps, links)
    least = {}
    for n, c in comp.items():
        if rows[n][0] is not None:
            least[c] = min(least.get(c, 1 << 60), rows[n][0])
    want = sorted((str(rows[n][0]), f"{fps[n]:016x}", str(least.get(c))) for n, c in comp.items())
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len({w[2] for w in want}) < len(want) - 10


@pytest.mark.parametrize(("k", "block"), [(0, 10**9), (5, 10**9), (5, 300_000)])
def test_ball_hashing_loses_no_link(k, block):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    extra = []
    for b in base[:200]:
        for d in range(1, 7):
            f = int(b)
            for i in rng.choice(64, d, replace=False):
                f ^= 1 << int(i)
            extra.append(f)
    f = np.unique(np.concatenate([base, np.array(extra, np.uint64)]))
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    want = components(f.tolist(), zip(f[i].tolist(), f[j].tolist()))
    p, o = simhash.prefixes_of(f, k, 2)
    links = []
    for prefix in np.unique(p):
        a, b = simhash.links_in(o[p == prefix], int(prefix), k, 4, block)
        links += zip(a.tolist(), b.tolist())
    assert all(bin(a ^ b).count("1") for a, b in links)
    assert components(f.tolist(), links) == want


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


# Embeddings


def brute_embeddings(rows, least=0.93):
    good = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, n = [], dict.fromkeys(range(len(rows)), 0)
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2]:
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((a, b))
                    n[a], n[b] = n[a] + 1, n[b] + 1
    comp, least = components(range(len(rows)), links), {}
    for i, c in comp.items():
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], least[c], rows[i][0] == least[c]) for i, c in comp.items())


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), int(rng.integers(3))) for i in range(150)]
    rows += [(150 + i, (np.array(rows[i % 7][1]) * (i + 1) + rng.normal(size=5) * 0.05).tolist(), rows[i % 7][2]) for i in range(40)]
    special = [None, [0.0] * 5, [1.0, float("nan"), 0.0, 0.0, 0.0], [1.0, None, 2.0, 1.0, 1.0], [float("inf")] * 5, []]
    rows += [(300 + i, v, 1) for i, v in enumerate(special)] + [(310, rows[0][1], None), (311, rows[0][1], rows[0][2]), (312, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize("tile", [1024, 16])
def test_embeddings_against_brute_force(spark, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df, tile=tile).collect())
    assert got == brute_embeddings(rows)


def test_embeddings_of_repeated_ids(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 1), (1, b, 1), (5, b, 1), (7, [1.0, 0.1], 1), (9, a, 2), (9, a, 2)]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == brute_embeddings(rows) == [(1, 1, 1, True), (1, 1, 1, True), (5, 1, 1, False), (7, 1, 1, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_links_at_the_threshold_are_those_of_the_given_vectors(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(200):  # cosines a hair above and below 0.93
        x, y = np.linalg.qr(rng.normal(size=(6, 2)))[0].T * rng.uniform(0.1, 1e3)
        c = 0.93 + (1e-14 if i % 3 else -1e-14)
        rows += [(2 * i, x.tolist(), i), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), i)]
    rows += [(1000, [1e200, 1e200], 1000), (1001, [1e200, 1.01e200], 1000), (1002, [1e-300, 1e-300], 1000)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {2 * i + k: int(i % 3 > 0) for i in range(200) for k in (0, 1)} | {1000: 2, 1001: 2, 1002: 2}


def test_bounds_prune_but_keep_pairs():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 64)) * np.linspace(2, 0.1, 64)
    a[200:] = a[:200] + rng.normal(size=(200, 64)) * 0.05
    a /= np.linalg.norm(a, axis=1)[:, None]
    i, j = embeddings.verified(a, a, *embeddings.near_pairs(a, a, 0.93), 0.93)
    assert {*zip(i.tolist(), j.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(a @ a.T >= 0.93)))}


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_a_fresh_index_is_joined_and_appended_to(docs, monkeypatch):
    ready, add = [], exact.DigestIndex.add
    monkeypatch.setattr(exact.DigestIndex, "add", lambda self, rows: ready.append(self._ready) or add(self, rows))
    got = exact.exact_duplicates(docs).collect()
    assert ready == [True]
    assert len(got) == docs.count()


def test_components_of_a_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in common.components(e).collect()}
    assert got == {**dict.fromkeys(range(1, n + 1), 0), 1001: 1000}


def test_components_that_have_not_settled_are_an_error(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        common.components(e, rounds=1)
