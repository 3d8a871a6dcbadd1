"""Language-model scoring with a probabilistic suffix tree over words.

The root is the add-one distribution of single tokens. A context of d words is looked at if it came LEAST
times or more in training, its suffix of d - 1 words is a state, and its first d - 1 words were looked at
themselves. It is a state if a divergence test holds: the mean leave-one-out log ratio of its smoothed
next-symbol distribution to its suffix's (whose logarithms are rounded to 1 / GRID there) is EPSILON nats or
more. LEAST does not grow with the table, so what the tree holds does.
A state's distribution is smoothed towards its suffix's, (c + m p) / (n + m) with m = n ** SHARE. A token is
scored in the state of its longest suffix, of DEPTH words at most.

Nothing of the tree is held in one place. Texts become blocks of a million tokens or two, written once with the
hashes of their words, and again, without them, when the words have numbers. For each depth a block asks about its distinct (context, next) pairs with what it counted of them; requests
meet by context in bounded buckets, are summed over all blocks, and each block gets its answers back: the sums
and which contexts are states, from which it works out the probabilities itself. Words are numbered by
frequency on the way, so that contexts and pairs, sorted by them, travel as small differences: some three bytes a pair.
A context that came HOT times or more is dealt by its next symbols too; the parts of its test are summed and
the outcome goes to the blocks that asked.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, LEAST, EPSILON, SHARE, GRID = 3, 24, 0.01, 0.7, 256
#: Tokens in a block; occurrences from which a context is dealt by its next symbols; tokens for each bucket of requests.
BLOCK, HOT, BUCKET = 1_600_000, 1_000_000, 2_500_000
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word holds white space

_REPLY = "block long, bucket int, level int, reply binary, n long, v long, gain double"


def _blocks(docs: DataFrame, id_type: str) -> DataFrame:
    """Blocks of whole documents: ids, lengths with the end token (u4), train flags (u1), distinct words by
    ascending hash (steps, u8), tokens as numbers of these (u4); both octet by octet."""

    def run(batches):
        from pyspark import TaskContext

        made, part = 0, TaskContext.get().partitionId()
        words: defaultdict = defaultdict()
        words.default_factory = words.__len__
        end = words[b" "]
        ids, lengths, train, tokens, n = [], [], [], [], 0

        def flush():
            nonlocal made, ids, lengths, train, tokens, n
            hashes = common.mix64(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            row = [pa.array([(part << 32) + made], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type))]
            row += [pa.array([x.tobytes()], pa.binary()) for x in (np.array(lengths, np.uint32), np.array(train, np.uint8), _octets(_steps(hashes[order], np.zeros(1, int))), _octets(place[np.concatenate(tokens)]))]
            made, ids, lengths, train, tokens, n = made + 1, [], [], [], [], 0
            words.clear()
            words[b" "]
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "lengths", "train", "words", "tokens"])

        for batch in batches:
            flags = batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(1)):
                got = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                got = [*map(words.__getitem__, got), end]
                tokens.append(np.array(got, np.uint32))
                ids.append(batch.column(0).slice(i, 1))
                lengths.append(len(got))
                train.append(flags[i])
                n += len(got)
                if n >= BLOCK:
                    yield flush()
        if lengths:
            yield flush()

    return common.mapped(docs, run, f"block long, ids array<{id_type}>, lengths binary, train binary, words binary, tokens binary")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _octets(x: np.ndarray) -> np.ndarray:
    """First octets of all numbers, then second ones, and so on: alike ones come together."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T)


def _numbers(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    out, compress = [], zstandard.ZstdCompressor(3).compress
    for x in arrays:
        data = compress(_octets(x).tobytes())
        out += [np.uint64(len(data)).tobytes(), data]
    return b"".join(out)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    out, at, decompress = [], 0, zstandard.ZstdDecompressor().decompress
    for kind in kinds:
        n = int(np.frombuffer(data, np.uint64, 1, at)[0])
        out.append(_numbers(decompress(data[at + 8 : at + 8 + n]), kind))
        at += 8 + n
    return out


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the number before; runs begin anew at starts."""
    out = x.copy()
    out[1:] -= x[:-1]
    out[starts] = x[starts]
    return out


def _walked(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The inverse of _steps for runs of these lengths."""
    x, starts = np.cumsum(steps), np.cumsum(lengths) - lengths
    return x - np.repeat(x[starts] - steps[starts], lengths) if len(x) else x


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


# Depth 0: words.


def _words_asked(row: dict, buckets: int) -> dict[int, bytes]:
    words, tokens = np.cumsum(_numbers(row["words"], np.uint64)), _numbers(row["tokens"], np.uint32).astype(np.int64)
    learn = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), np.frombuffer(row["lengths"], np.uint32))
    n = np.bincount(tokens[learn], minlength=len(words)).astype(np.uint32)
    cuts = np.searchsorted(_bucket(words, buckets), np.arange(buckets + 1)).tolist()
    return {b: _pack(_steps(words[lo:hi], np.zeros(1, int)), n[lo:hi]) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi}


def _settled(tokens: bytes, replies: dict[int, bytes]) -> tuple[bytes, bytes, bytes]:
    """Of a block whose words have got numbers: the numbers, ascending (steps, u8), how often each came in training
    (u8), and tokens as places among them (u4); all octet by octet. Small numbers are frequent words."""
    got = [_unpack(replies[b], np.uint64, np.uint64) for b in sorted(replies)]
    number, count = (np.concatenate([x[i] for x in got]) for i in (0, 1))
    order = np.argsort(number)
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return tuple(_octets(x).tobytes() for x in (_steps(number[order], np.zeros(1, int)), count[order], place[_numbers(tokens, np.uint32)]))


def _longer(names: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Names of contexts with one more word."""
    with np.errstate(over="ignore"):
        return common.mix64(names * np.uint64(0x9E3779B97F4A7C15) + number)


def _new_runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows begin that differ from those before in any of these columns; the first row counts."""
    return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)]))


class _Walk:
    """A settled block with the answers so far: per token its log probability, and the contexts to ask about next.

    Contexts have numbers in the block, `ctx` at each token, in the order of their words' numbers, which `chain`
    has word by word; `names` are the same in all blocks: a word's number, or the hash of a chain of them. `times`
    says how often each came in training."""

    def __init__(self, row: dict, total: int, distinct: int):
        self.lengths, self.train = np.frombuffer(row["lengths"], np.uint32).astype(np.int64), np.frombuffer(row["train"], np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.learn = np.repeat(self.train.astype(bool), self.lengths)
        self.token, self.times = _numbers(row["tokens"], np.uint32).astype(np.int64), _numbers(row["times"], np.uint64).astype(np.int64)
        self.first = np.zeros(len(self.token), bool)
        self.first[self.begin] = True
        self.names = np.cumsum(_numbers(row["numbers"], np.uint64))
        self.number, self.chain = self.names.astype(np.int64), [self.names]
        self.count = self.times[self.token]
        self.log = np.log((self.count + 1) / (total + distinct + 1))
        self.base = np.add.reduceat(self.log, self.begin)
        self.ctx = np.concatenate([[-1], self.token[:-1]])
        self.ctx[self.first] = -1
        self.asked = (self.ctx >= 0) & (self.times[self.ctx] >= LEAST)

    # Depth d: (context, next) pairs.

    def pairs(self, buckets: int) -> None:
        """Number the distinct pairs of what is asked, by context and next word, and their runs, by bucket."""
        self.at = np.flatnonzero(self.asked)
        n, wide = len(self.at), max(1, len(self.number).bit_length())
        deep, places = len(self.times).bit_length(), n.bit_length()
        pair = (self.ctx[self.at] << wide) | self.token[self.at]
        if deep + wide + places <= 63:
            pair = np.sort((pair << places) | np.arange(n))
            order, pair = pair & ((1 << places) - 1), pair >> places
        else:
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, n))
        self.inverse = np.empty(n, np.int64)
        self.inverse[order] = np.repeat(np.arange(len(starts)), size)
        self.pair_ctx, self.pair_next = pair[starts] >> wide, pair[starts] & ((1 << wide) - 1)
        learned = np.concatenate([[0], np.cumsum(self.learn[self.at][order])])
        self.own = (learned[starts + size] - learned[starts]).astype(np.uint64)
        self.parent = np.round(self.log[self.at[order[starts]]] * GRID).astype(np.int16)
        # Runs are contexts, those of hot ones parts by next word; `place` lists pairs by bucket and run.
        salts = -(-self.times[self.pair_ctx] // HOT)
        salt = np.zeros(len(starts), np.uint64)
        hot = np.flatnonzero(salts > 1)
        salt[hot] = common.mix64(self.number[self.pair_next[hot]].astype(np.uint64)) % salts[hot].astype(np.uint64)
        by_run = np.lexsort((salt, self.pair_ctx)) if len(hot) else np.arange(len(starts))
        c, t = self.pair_ctx[by_run], salt[by_run]
        begin = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])])) if len(c) else np.zeros(0, np.int64)
        run = np.diff(np.append(begin, len(c)))
        bucket = _bucket(common.mix64(self.names[c[begin]] ^ common.mix64(t[begin])), buckets)
        rows = np.argsort(bucket, kind="stable")
        self.run_ctx, self.run_length, self.run_bucket = c[begin][rows], run[rows], bucket[rows]
        self.place = by_run[_ranges(begin[rows], self.run_length)]

    def pairs_asked(self, buckets: int, level: int) -> dict[int, bytes]:
        """Contexts go by the numbers of their words, one word after the other. Parents come with each pair; at level 1
        they hang on the next word alone, and come once for each."""
        self.pairs(buckets)
        cuts = np.searchsorted(self.run_bucket, np.arange(buckets + 1)).tolist()
        ends = np.concatenate([[0], np.cumsum(self.run_length)])
        out = {}
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo < hi:
                own, c, length = self.place[ends[lo] : ends[hi]], self.run_ctx[lo:hi], self.run_length[lo:hi]
                starts = np.cumsum(length) - length
                hot = np.flatnonzero(self.times[c] >= HOT)
                next_ = self.number[self.pair_next[own]].astype(np.uint64)
                parent = _steps(self.parent[own], starts) if level > 1 else _steps(self.parent[own[np.unique(next_, return_index=True)[1]]], np.zeros(1, int))
                words = [x[c] for x in self.chain]
                words = [_steps(x, _new_runs(words[:i]) if i else np.zeros(1, int)) for i, x in enumerate(words)]
                out[b] = _pack(*words, length.astype(np.uint32), hot.astype(np.uint32), self.times[c[hot]].astype(np.uint64), _steps(next_, starts), self.own[own], parent)
        return out

    def pairs_told(self, replies: dict[int, bytes], hot: set[int], buckets: int) -> None:
        """hot: names of the hot contexts that are states."""
        self.pairs(buckets)
        got = [_unpack(replies[b], np.uint8, np.uint64) for b in sorted(replies)]
        flag, told = (np.concatenate([x[i] for x in got] or [np.zeros(0, np.int64)]) for i in (0, 1))
        count = np.zeros(len(self.pair_ctx), np.int64)
        count[self.place] = told.astype(np.int64)
        state = np.zeros(len(self.times), bool)
        state[self.run_ctx] = flag == 1
        for c in self.run_ctx[flag == 2]:
            state[c] = int(self.names[c]) in hot
        scored = state[self.ctx[self.at]]
        at = self.at[scored]
        n = self.times[self.ctx[at]].astype(np.float64)
        m = n**SHARE
        self.log[at] = np.log((count[self.inverse[scored]] + m * np.exp(self.log[at])) / (n + m))
        pair = np.full(len(self.token), -1)
        pair[self.at] = self.inverse
        suffix = np.zeros(len(self.token), bool)
        suffix[at] = True
        last = self.number[self.pair_next].astype(np.uint64)
        self.names, self.chain = _longer(self.names[self.pair_ctx], last), [*(x[self.pair_ctx] for x in self.chain), last]
        self.times = count
        self.ctx = np.concatenate([[-1], pair[:-1]])
        self.ctx[self.first] = -1
        self.asked = suffix & (self.ctx >= 0)
        self.asked[self.asked] = count[self.ctx[self.asked]] >= LEAST


def _answer(bucket: int, level: int, **what) -> dict:
    return {"block": -1, "bucket": bucket, "level": level, "reply": None, "n": None, "v": None, "gain": None} | what


def _merge_words(table: pa.Table, bucket: int, buckets: int) -> list[dict]:
    """A reply has a number and a count for each word. Numbers follow frequency within a bucket."""
    parts = [_unpack(x, np.uint64, np.uint32) for x in table.column("payload").to_pylist()]
    u, inverse = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(u)).astype(np.uint64)
    number = np.empty(len(u), np.uint64)
    number[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(u), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    answers = zip(table.column("block").to_pylist(), np.split(number[inverse], cuts), np.split(total[inverse], cuts))
    out = [_answer(bucket, 0, block=b, reply=_pack(x, y)) for b, x, y in answers]
    return [*out, _answer(bucket, 0, n=int(total.sum()), v=int((total > 0).sum()))]


def _names(words: list[np.ndarray]) -> np.ndarray:
    """Names of the contexts of a request, from the steps of their words' numbers."""
    chain = [np.cumsum(words[0])]
    names = chain[0]
    for steps in words[1:]:
        chain.append(_walked(steps, np.diff(np.append(_new_runs(chain), len(steps)))))
        names = _longer(names, chain[-1])
    return names


def _merge_pairs(table: pa.Table, bucket: int, level: int) -> list[dict]:
    """A reply has for each run 1 if its context is a state, 2 if that is not known here, else 0; and for each
    pair its sum. Parts of the test of hot contexts are rows of block -2: name, occurrences, gain."""
    parts = [_unpack(x, *[np.uint64] * level, np.uint32, np.uint32, np.uint64, np.uint64, np.uint64, np.int16) for x in table.column("payload").to_pylist()]
    parts = [[_names(p[:level]), *p[level:]] for p in parts]
    lengths = [p[1].astype(np.int64) for p in parts]
    names, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n, hot = np.zeros(len(names)), np.zeros(len(names), bool)
    at = 0
    for p in parts:
        mine = of[at + p[2].astype(np.int64)]
        hot[mine], n[mine] = True, p[3]
        at += len(p[1])
    run = np.repeat(of, np.concatenate(lengths))
    words = [_walked(p[4], x) for p, x in zip(parts, lengths)]
    if level > 1:
        parents = [_walked(p[6], x) for p, x in zip(parts, lengths)]
    else:
        parents = [np.cumsum(p[6])[np.unique(w, return_inverse=True)[1]] for p, w in zip(parts, words)]
    _, word = np.unique(np.concatenate(words), return_inverse=True)
    u, one, inverse = np.unique(run * (int(word.max()) + 1) + word, return_index=True, return_inverse=True)
    c = np.bincount(inverse, np.concatenate([p[5] for p in parts]), len(u))
    run, sizes = run[one], [len(p[4]) for p in parts]
    p = np.exp(np.concatenate(parents)[one] / GRID)
    n = np.where(hot, n, np.bincount(run, c, len(names)))
    m = n[run] ** SHARE
    gain = np.where(c > 0, c * (np.log((np.maximum(c - 1, 0) + m * p) / np.maximum(n[run] - 1 + m, 1)) - np.log(p)), 0)
    gain = np.bincount(run, gain, len(names))
    flag = np.where(hot, 2, gain >= EPSILON * n).astype(np.uint8)
    answers = zip(table.column("block").to_pylist(), np.split(flag[of], np.cumsum([len(x) for x in lengths])[:-1]), np.split(c.astype(np.uint64)[inverse], np.cumsum(sizes)[:-1]))
    out = [_answer(bucket, level, block=b, reply=_pack(x, y)) for b, x, y in answers]
    return out + [_answer(bucket, level, block=-2, n=int(names[i].view(np.int64)), v=int(n[i]), gain=float(gain[i])) for i in np.flatnonzero(hot)]


_ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("reply", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("gain", pa.float64())])


def _merger(level: int, buckets: int):
    def merge(table):
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_pylist(_merge_words(table, bucket, buckets) if level == 0 else _merge_pairs(table, bucket, level), _ANSWERS)

    return merge


def _hot_states(told: DataFrame) -> DataFrame:
    """For each block the hot contexts of a level that are states, of those in buckets it asked: rows of bucket -1.

    One row for each part of a hot context, which holds HOT occurrences or so: few, whatever the corpus."""
    parts = told.filter("block = -2").select("bucket", "level", "n", "v", "gain")
    states = parts.groupBy("level", "n").agg(F.sum("gain").alias("gain"), F.max("v").alias("v")).filter(F.col("gain") >= EPSILON * F.col("v"))
    where = parts.select("bucket", "level", "n").join(states.select("level", "n"), ["level", "n"])
    asked = told.filter("block >= 0 and level > 0").select("block", "bucket", "level")
    # The parts of a context lie in several buckets that a block asked: it hears of it once.
    return where.join(asked, ["bucket", "level"]).select("block", F.lit(-1).alias("bucket"), "level", "n").distinct().select("*", F.lit(None).cast("binary").alias("reply"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("gain")).select("block", "bucket", "level", "reply", "n", "v", "gain")


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id) mod 7 is 2 are held out; all others are learned from. Null texts are empty and are
    scored as one end token; null ids are not held out. Repeated rows are learned from and scored each. With no training row all counts are 0 and every
    probability is that of the root. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    held = F.coalesce(common.crc32_of_id(id_col) % 7 == 2, F.lit(False))
    rows = docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"].cast("string").alias("text"), (~held).cast("int").alias("train"))
    spread = common.partitions(rows, 64 << 20)
    tables: list[tuple[str, str]] = []

    def kept(df: DataFrame, after: tuple[str, str] | None = None) -> tuple[str, str]:
        """df in buckets by block, appended to a table if given: blocks and their answers stay where they are."""
        name, path = after or (f"lm_blocks_{uuid.uuid4().hex}", common.fresh(spark, "lm-blocks"))
        with common.shuffles_dropped(spark):
            df.write.format("parquet").bucketBy(spread, "block").option("path", path).option("compression", "zstd").mode("append").saveAsTable(name)
        if not after:
            tables.append((name, path))
        return name, path

    def gone(*which: tuple[str, str]) -> None:
        for name, path in which:
            tables.remove((name, path))
            spark.sql(f"DROP TABLE {name}")
            common.delete(spark, path)

    raw = kept(_blocks(rows, kind))
    size = spark.table(raw[0]).agg(F.sum(F.octet_length("tokens") / 4)).first()[0] or 0
    buckets = max(spread, -(-int(size) // BUCKET))
    request = "block long, bucket int, payload binary"
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])

    def sent(block: int, got: dict[int, bytes]) -> pa.Table:
        return pa.table({"block": [block] * len(got), "bucket": list(got), "payload": list(got.values())}, schema)

    def merged(requests: DataFrame, level: int, after: tuple[str, str] | None) -> tuple[str, str]:
        with common.batches_of(spark, 4):  # of blocks
            return kept(requests.groupBy("bucket").applyInArrow(_merger(level, buckets), _REPLY).repartition(spread, "block"), after)

    def together(blocks: DataFrame, replies: DataFrame, function, out: str) -> DataFrame:
        own = replies.filter("block >= 0").select("block", "bucket", "level", "reply", "n")
        return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(function, out)

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from sent(row["block"], _words_asked(row, buckets)).to_batches()

    def settle(block: pa.Table, replies: pa.Table) -> pa.Table:
        of = dict(zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist()))
        got = _settled(block.column("tokens")[0].as_py(), of)
        return pa.table([*(block.column(x) for x in ("block", "ids", "lengths", "train")), *(pa.array([x], pa.binary()) for x in got)], ["block", "ids", "lengths", "train", "numbers", "times", "tokens"])

    told = merged(spark.table(raw[0]).select("block", "lengths", "train", "words", "tokens").mapInArrow(first, request), 0, None)
    total, distinct = spark.table(told[0]).filter("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    blocks = kept(together(spark.table(raw[0]).drop("words"), spark.table(told[0]), settle, f"block long, ids array<{kind}>, lengths binary, train binary, numbers binary, times binary, tokens binary"))
    gone(raw, told)
    told = None

    def answered(*columns: str, function, out: str) -> DataFrame:
        replies = spark.table(told[0]) if told else spark.createDataFrame([], _REPLY)
        return together(spark.table(blocks[0]).select("block", *columns, "lengths", "train", "numbers", "times", "tokens"), replies, function, out)

    def walked(block: pa.Table, replies: pa.Table, levels: int) -> _Walk:
        walk, replies = _Walk(block.to_pylist()[0], total, distinct), replies.to_pylist()
        for d in range(1, levels):
            of = {r["bucket"]: r["reply"] for r in replies if r["level"] == d and r["bucket"] >= 0}
            walk.pairs_told(of, {r["n"] & 0xFFFFFFFFFFFFFFFF for r in replies if r["level"] == d and r["bucket"] < 0}, buckets)
        return walk

    def next_requests(level: int):
        return lambda block, replies: sent(block.column("block")[0].as_py(), walked(block, replies, level).pairs_asked(buckets, level))

    for level in range(1, depth + 1):
        told = merged(answered(function=next_requests(level), out=request), level, told)
        own = spark.table(told[0]).filter(f"level = {level}")
        if not own.filter("block = -2").isEmpty():
            kept(_hot_states(own).repartition(spread, "block"), told)

    out_schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def final(block, replies):
        walk = walked(block, replies, depth + 1)
        ten = np.log(10)
        return pa.table({
            id_col: block.column("ids")[0].as_py(), "held_out": ~walk.train.astype(bool), "n_tokens": walk.lengths, "n_known": np.add.reduceat((walk.count > 0).astype(np.int64), walk.begin),
            "train_tokens": np.full(len(walk.lengths), total, np.int64), "base_score": walk.base / ten, "score": np.add.reduceat(walk.log, walk.begin) / ten,
        })

    out = common.written(answered("ids", function=final, out=out_schema), "lm-scores")
    gone(*tables)
    return out
