"""Tokenisation, packing, id shards, WARC and subwords: brute-force versions and round trips."""

import base64
import hashlib
import random
import weakref
import zlib

import numpy as np
import pytest

from groundwork.llm import common, idstore, packing, subwords, tokens, warc

ODD = ["", " ", "a  b\t\nc", "it's can't we'll I'd DON'T", "Σίσυφος ΣΑΣ", "ﬁ ½ ² é İ ı ß", "c\x1cd\x85e", "x<|endoftext|>y", "你好 😀", "A1B2 3.14", "x@y.com", "'s 'LL", "µ ª ÿ à̧", "end. (x) a,b; one! |", "`q`"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_encoding_is_the_librarys(tokenizer):
    r = random.Random(1)
    letters = "aB c'sSdDtT.,!?09éÉßΣσς́İı½ \n\t½<|>_-$€你ñÑ"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(800)]
    encoder = tokens.encoder(tokens.default_path())
    assert encoder.quick
    assert [t for t in texts if np.frombuffer(encoder.encode(t), "<u4").tolist() != ids_of(tokenizer, t)] == []


def test_bounded_cache_forgets():
    made = []
    c = tokens.Bounded(lambda k: made.append(k) or k, most=4)
    assert [c[i] for i in (1, 2, 1, 3, 4, 5, 1)] == [1, 2, 1, 3, 4, 5, 1]
    assert len(c) + len(c.old) <= 5


# Packing


def best_fit_decreasing(lengths, capacity):
    gaps: list = []
    for x in sorted(lengths, reverse=True):
        best = min((g for g in gaps if g >= x), default=None)
        if best is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(best)] = best - x
    return len(gaps)


@pytest.mark.parametrize("rows_each", [packing.RANGE, 90])
def test_packing_lengths(spark, rows_each):
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 101, 400).tolist() + [100] * 5, [1] * 250, [34] * 50, rng.integers(2, 20, 300).tolist()):
        df = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
        got = packing.pack_lengths(df, capacity=100, rows_each=rows_each).collect()
        assert sorted((r.pid, r.length) for r in got) == list(enumerate(lengths))
        held = {}
        for r in got:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in held.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 100
        assert len(held) <= 1.02 * best_fit_decreasing(lengths, 100) + 1


def test_packing_holds_every_piece(spark, docs, tokenizer):
    got = packing.packed(docs, capacity=128).collect()
    want = []
    for r in docs.collect():
        ids = [*ids_of(tokenizer, r.text), 0]
        want += [(str(r.doc_id), p, at, len(ids[at : at + 128]), crc(ids[at : at + 128])) for p, at in enumerate(range(0, len(ids), 128))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 128
    assert len(seqs) <= -(-sum(w[3] for w in want) // 128) + 1


def test_packing_starts_no_second_python_workers(spark, monkeypatch):
    """Rows that Python pickles would be read by Python workers of their own, which stay on the executors."""

    def refused(*_, **__):
        raise AssertionError("rows pickled by Python")

    pieces = spark.range(400).selectExpr("id as pid", "1 + pmod(xxhash64(id), 2048) as length")
    sizes = [tuple(r) for r in pieces.collect()]
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    got = packing.pack_lengths(pieces, rows_each=50).collect()
    assert sorted((r["pid"], r["length"]) for r in got) == sorted(sizes)


def test_encoders_are_dropped_for_other_stages():
    kept = tokens.encoder(tokens.default_path())
    kept.encode("one two")
    gone = weakref.ref(kept.words)
    del kept
    tokens.forget()
    assert gone() is None and tokens.encoder.cache_info().currsize == 0


def test_packing_empty(empty):
    assert packing.packed(empty).collect() == []


# Id shards


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash(n):
    fp = common.mix64(np.arange(n, dtype=np.uint64) * np.uint64(977))
    seeds, slots = idstore.perfect_hash(fp)
    assert sorted(slots.tolist()) == list(range(n))
    assert (idstore.unmix64(fp) == np.arange(n, dtype=np.uint64) * np.uint64(977)).all()


def test_id_store_round_trip(spark, docs, tokenizer):
    folder = common.fresh(spark, "ids")
    idstore.write(docs, folder, shard_ids=2000)
    got = idstore.read(spark, folder, digest_only=False).collect()
    rows = docs.collect()
    want = sorted((str(r.doc_id), len(ids_of(tokenizer, r.text)) + 1, crc([*ids_of(tokenizer, r.text), 2])) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0))
    assert idstore.manifest(spark, folder).count() > 1
    assert idstore.lookup(spark, folder, 10).tolist() == [*ids_of(tokenizer, next(r.text for r in rows if r.doc_id == 10)), 2]
    assert idstore.lookup(spark, folder, 999) is None


def test_id_store_empty(spark, empty):
    folder = common.fresh(spark, "ids")
    idstore.write(empty, folder)
    assert idstore.read(spark, folder).collect() == []


# WARC


PAGES = [(1, "http://a", "x" * 200_000), (2, "http://b", "same"), (3, None, "same"), (4, "http://d", None), (5, "http://e\r\nX: y", ""), (6, "http://f", "é\r\n\r\nWARC/1.1\r\n"), (7, "http://g", "x" * 200_000), (7, "http://g", "x" * 200_000), (None, "http://n", "no id")]


def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha1 string").repartition(3)


@pytest.mark.parametrize("least", [0, 10])
def test_warc_records(spark, least):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages(spark), least).collect())
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        keep = max(same, default=None) if len(data) >= least else i
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == keep else "revisit", None if i == keep else keep))
    assert got == sorted(want, key=lambda w: (w[0], w[1]))


def test_warc_chunks_rebuild_payloads(spark):
    folder = common.fresh(spark, "warc")
    names = warc.write(warc.chunked(pages(spark), chunk=1000), folder, file_bytes=500)
    rows = warc.read(names, folder, chunk=777, with_data=True).filter("record_type = 'response'").collect()
    parts = {}
    for r in rows:
        parts.setdefault((r.page_id, r.payload_digest), []).append((r.chunk_no, bytes(r.data), r.last, r.verified))
    assert all(v for p in parts.values() for *_, last, v in p if last)
    text = b"".join(d for _, d, *_ in sorted(parts[6, [k[1] for k in parts if k[0] == 6][0]]))
    assert text.decode() == PAGES[5][2]
    assert max(len(d) for p in parts.values() for _, d, *_ in p) <= 777


def test_a_payload_above_the_size_of_an_archive(spark, monkeypatch):
    text = "".join(chr(97 + i % 23) * (i % 7) for i in range(60_000))
    df = spark.createDataFrame([(1, "http://a", text), (2, "http://b", "short"), (3, "http://c", text)], "page_id long, url string, html string").repartition(2)
    folder = common.fresh(spark, "warc")
    names = warc.write(warc.chunked(df, chunk=4096), folder, file_bytes=1000)
    rows = warc.read(names, folder, chunk=1000, with_data=True).collect()
    whole = b"".join(bytes(r.data) for r in sorted((r for r in rows if r.page_id == 3), key=lambda r: r.chunk_no))
    assert whole.decode() == text
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {(1, "revisit", 3), (2, "response", None), (3, "response", None)}
    assert all(r.verified for r in rows if r.last and r.record_type == "response")


def test_chunks_stay_in_their_buckets(spark):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = warc.chunked(pages(spark))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_warc_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# Subwords


SUB = ["", " ", "  ", "a", " a", "a ", "a  b   c ", "▁x ▁", "\x00a b", "x" * 3000, "é漢😀\n\n", "Hello world, this is text."]


def test_without_dropout_ids_are_the_librarys():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.default_path())
    c = subwords.codec(subwords.default_path(), 0.0, 1)
    r = random.Random(2)
    texts = SUB + ["".join(r.choice("aB c  'sé ß\n\t你ñ😀x") for _ in range(r.randrange(70))) for _ in range(500)]
    assert [t for t in texts if "▁" not in t and np.frombuffer(c.encode(t), "<u4").tolist() != sp.encode(t)] == []


def test_dropout_varies_and_is_lossless(spark, docs):
    path = subwords.default_path()
    c, other = subwords.codec(path, 0.3, 1), subwords.codec(path, 0.3, 2)
    text = "transformation of segmentations and other considerations"
    assert len({c.encode(text, k) for k in range(20)} | {other.encode(text, k) for k in range(20)}) > 3
    assert c.encode(text, 5) == subwords.Codec(path, 0.3, 1).encode(text, 5)
    assert all(c.decode(c.encode(t, k)) == t for t in SUB for k in range(6))
    assert c._ids(c._merged([*"▁transformation"], 99)) != b""
    got = subwords.decode(subwords.encode(docs)).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), r.text) for r in got) == want
    assert all(r.lossless for r in subwords.round_trips(docs).collect())


def test_both_agendas_agree():
    c = subwords.Codec(subwords.default_path(), 0.2, 3)
    r = random.Random(4)
    for base in range(200):
        word = "".join(r.choice("transformation") for _ in range(r.randrange(49, 70)))
        assert c._unit(word, base) == c._ids(c._merged([*("▁" + word)], base))  # by heap and by list
        long = word + "\x01" * 60 + word
        assert b"".join(c.table[i] for i in np.frombuffer(c._unit(long, base), "<u4")).decode() == " " + long


def brute_subwords(text, key, rate, seed):
    """Every unit by itself: the best candidate that has not been skipped, until there is none."""
    import re

    import sentencepiece
    import xxhash

    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.default_path())
    rank = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    out, mask = [], (1 << 64) - 1
    mix = lambda x: int(common.mix64(np.array([x & mask], np.uint64))[0])
    doc = xxhash.xxh64_intdigest(str(key), seed)
    for place, unit in enumerate(re.findall(" *[^ ]+| +", " " + text) if text else []):
        base, parts, skipped, step = mix(doc + place * 0x9E3779B97F4A7C15), ["▁" if c == " " else c if c != "▁" else None for c in unit], set(), 0
        while True:
            found = [(rank[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p and q and p + q in rank and (i, p, q) not in skipped]
            if not found:
                break
            _, i = min(found)
            draw = mix(base + (step // 2 + 1) * 0xD6E8FEB86659FD93) >> (32 * (step % 2)) & 0xFFFFFFFF
            step += 1
            if draw < int(rate * 2**32):
                skipped.add((i, parts[i], parts[i + 1]))
            else:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                skipped = {(j if j < i else j - 1, p, q) for j, p, q in skipped if j not in (i - 1, i, i + 1)}
        for p in parts:
            out += [rank[p][1]] if p in rank else [sp.piece_to_id(f"<0x{b:02X}>") for b in (p or "▁").encode()]
    return np.array(out, "<u4").tobytes()


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_dropout_against_brute_force(rate, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("etaoinsrhl") for _ in range(r.randrange(1, 14))) for _ in range(40)]
    texts = [*SUB, "x▁y é漢😀 a\nb\tc", "word " * 30, "one  two   ", *(" ".join(r.choices(words, k=30)) for _ in range(20)), "w" * 39 + " " + "transformation" * 3, SUB[-1], SUB[-1]]
    c = subwords.Codec(subwords.default_path(), rate, 42)
    want = [brute_subwords(t, i % 30, rate, 42) for i, t in enumerate(texts)]
    assert c.encode_all(texts, [i % 30 for i in range(len(texts))]) == want
    monkeypatch.setattr(subwords, "STATES", 5)  # forgetting and small lots change nothing
    monkeypatch.setattr(subwords, "TOGETHER", 50)
    assert c.encode_all(texts, [i % 30 for i in range(len(texts))]) == want


def test_each_occurrence_is_segmented_by_itself():
    c = subwords.Codec(subwords.default_path(), 0.3, 1)
    assert len({c.encode("considerations", k) for k in range(300)}) > 10
    word = "internationalisation" * 3  # too long for the caches
    assert len({c.encode(word, k) for k in range(50)}) > 10
    pieces = c.encode(" ".join(["considerations"] * 300), 7)
    words = "".join(f"|{p}" for p in (c.table[i].decode() for i in np.frombuffer(pieces, "<u4"))).split("| ")
    assert len(set(words)) > 10
    assert pieces == subwords.Codec(subwords.default_path(), 0.3, 1).encode(" ".join(["considerations"] * 300), 7)


def test_cached_outcomes_are_those_of_the_draws():
    c = subwords.Codec(subwords.default_path(), 0.3, 1)
    for i in range(300):
        doc = c.variant(i)
        base = int(subwords.common.mix64(np.array([doc], np.uint64))[0])
        assert c.encode("considerations", i) == c._unit("considerations", base)
    skipped = c._draws(np.arange(20_000, dtype=np.uint64), 0, subwords.STEPS).mean()
    assert abs(skipped - 0.3) < 0.005


def test_subwords_empty(empty):
    assert subwords.round_trips(empty).collect() == []
