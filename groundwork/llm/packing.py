"""Best-fit packing of documents into fixed-length sequences, bulk-synchronously.

Documents longer than a sequence are cut. A round then range-sorts what is left of the pieces together with
the gaps of all sequences, largest first, and sweeps over each range: a gap is remembered with as many places
as the longest piece left fits into it (one at least), and a piece takes a place of the gap remembered last,
its successor in size. What a range leaves over, pieces too long for its gaps and places of gaps without a
piece, is numbered, and a second sweep over the numbers alone (two for each range) says which pieces of later
ranges go to which places of earlier ones; so two pieces never want one place. Places are dealt by rank, the
gaps are updated, and the next round begins. The first round has as many empty sequences as the total length
fills; later ones add some only for pieces longer than any gap, or where the gaps can't hold what is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
#: Pieces and gaps in a range, about.
RANGE = 200_000
#: What rows of a sweep are: a piece in its place, a piece left over, a gap as it is now.
PLACED, LEFT, GAP = 0, 1, 2
INT, LONG = pa.int32(), pa.int64()

_SWEPT = "what int, part int, at long, pid long, length long, seq long, gap long, offset long, n long"


def sweep(size: np.ndarray, is_piece: np.ndarray, key: np.ndarray, longest: int, capacity: int) -> dict[str, list[tuple]]:
    """One range, by falling size, gaps before pieces: (piece, length, sequence, offset) placed, (piece, length)
    left over, and (sequence, gap now, places left) for each gap; what is left over is in order."""
    placed, left, gaps, held = [], [], [], []
    for x, piece, k in zip(size.tolist(), is_piece.tolist(), key.tolist()):
        if not piece:
            held.append([k, x, max(1, x // longest)])
            gaps.append(held[-1])
        elif held:
            top = held[-1]
            placed.append((k, x, top[0], capacity - top[1]))
            top[1] -= x
            top[2] -= 1
            if not top[2]:
                held.pop()
        else:
            left.append((k, x))
    return {"placed": placed, "left": left, "gaps": gaps}


def across(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which places earlier ranges left go to pieces that later ones left: from (range, pieces left, places left)
    in order, (range, first piece, end, range of the places, place of the first piece); places fall from there."""
    held, out = [], []
    for part, pieces_left, places_left in ranges:
        at = 0
        while at < pieces_left and held:
            other, top = held[-1]
            n = min(pieces_left - at, top)
            out.append((part, at, at + n, other, top - 1))
            at += n
            held[-1][1] -= n
            if not held[-1][1]:
                held.pop()
        if places_left:
            held.append([part, places_left])
    return out


def _swept(todo: DataFrame, gaps: DataFrame, ranges: int, longest: int, capacity: int) -> DataFrame:
    items = gaps.select(F.col("gap").alias("size"), F.lit(False).alias("is_piece"), F.col("seq").alias("key"))
    items = items.unionByName(todo.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), F.col("pid").alias("key")))
    order = [F.col("size").desc(), F.col("is_piece"), F.col("key")]

    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        got = sweep(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3)), longest, capacity)
        cols = lambda rows, n: [np.array(x, np.int64) for x in zip(*rows)] or [np.zeros(0, np.int64)] * n
        placed, left, gap = cols(got["placed"], 4), cols(got["left"], 2), cols(got["gaps"], 3)
        sizes = [len(placed[0]), len(left[0]), len(gap[0])]
        none = [np.zeros(n, np.int64) for n in sizes]
        before = np.cumsum(gap[2]) - gap[2]
        names = {
            "what": [np.full(n, w, np.int64) for n, w in zip(sizes, (PLACED, LEFT, GAP))], "part": [x + part for x in none], "at": [none[0], np.arange(sizes[1]), before],
            "pid": [placed[0], left[0], none[2]], "length": [placed[1], left[1], none[2]], "seq": [placed[2], none[1], gap[0]],
            "gap": [none[0], none[1], gap[1]], "offset": [placed[3], none[1], none[2]], "n": [none[0], none[1], gap[2]],
        }
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int32() if k in ("what", "part") else pa.int64()) for k, x in names.items()], list(names))

    dealt = items.repartitionByRange(ranges, *order) if ranges > 1 else items.coalesce(1)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, _SWEPT)


def _crossed(swept: DataFrame, found: list[tuple], capacity: int) -> DataFrame:
    """Pieces that find a place in another range: pid, length, seq, offset. found has two rows or so for each range."""
    spark = swept.sparkSession
    cut = F.broadcast(common.local_table(spark, found, part=INT, lo=LONG, hi=LONG, other=INT, top=LONG))
    used: dict[int, int] = {}
    for _, lo, hi, other, top in found:
        used[other] = min(used.get(other, top), top - (hi - lo) + 1)
    low = F.broadcast(common.local_table(spark, list(used.items()), part=INT, low=LONG))
    pieces_ = swept.filter(F.col("what") == LEFT).join(cut, "part").filter("at >= lo and at < hi").select("pid", "length", "other", (F.col("top") - F.col("at") + F.col("lo")).alias("place"))
    places = swept.filter((F.col("what") == GAP) & (F.col("n") > 0)).join(low, "part").filter("at + n > low")
    places = places.select(F.col("part").alias("other"), "seq", "gap", F.explode(F.sequence(F.greatest("at", "low"), F.col("at") + F.col("n") - 1)).alias("place"))
    before = F.sum("length").over(Window.partitionBy("seq").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1))
    return pieces_.join(places, ["other", "place"]).select("pid", "length", "seq", (capacity - F.col("gap") + F.coalesce(before, F.lit(0))).alias("offset"))


def pack_lengths(pieces: DataFrame, length: str = "length", pid: str = "pid", capacity: int = CAPACITY, rows_each: int = RANGE) -> DataFrame:
    """pieces (lengths 1 to capacity, told apart by pid: long) with sequence_id and offset."""
    spark = pieces.sparkSession
    todo = pieces.select(F.col(pid).cast("long").alias("pid"), F.col(length).cast("long").alias("length"))
    n, total, longest, shortest = todo.agg(F.count("*"), F.sum("length"), F.max("length"), F.min("length")).first()
    opened = -(-(total or 0) // capacity)
    gaps = spark.range(opened).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
    done, n_gaps = [], opened
    while n:
        swept = common.written(_swept(todo, gaps.filter(F.col("gap") >= shortest), -(-(n + n_gaps) // rows_each), longest, capacity), "packing-swept")
        done.append(swept.filter(F.col("what") == PLACED).select("pid", "seq", "offset"))
        is_left, is_gap = F.col("what") == LEFT, F.col("what") == GAP
        ranges = swept.groupBy("part").agg(F.count(F.when(is_left, 1)).alias("left"), F.coalesce(F.sum(F.when(is_gap, F.col("n"))), F.lit(0)).alias("places")).collect()
        found = across(sorted(tuple(r) for r in ranges))  # a row for each range
        todo, gaps = swept.filter(is_left).select("part", "at", "pid", "length"), swept.filter(is_gap).select("seq", "gap")
        if found:
            crossed = common.written(_crossed(swept, found, capacity), "packing-crossed")
            done.append(crossed.select("pid", "seq", "offset"))
            ends: dict[int, int] = {}
            for part, _, hi, *_ in found:
                ends[part] = max(ends.get(part, 0), hi)
            taken = F.broadcast(common.local_table(spark, list(ends.items()), part=INT, taken=LONG))
            todo = todo.join(taken, "part", "left").filter(F.col("at") >= F.coalesce("taken", F.lit(0)))
            gaps = gaps.unionByName(crossed.select("seq", (-F.col("length")).alias("gap"))).groupBy("seq").agg(F.sum("gap").alias("gap"))
            gaps = common.written(gaps, "packing-gaps")
        todo = todo.select("pid", "length")
        n, total, longest, shortest = todo.agg(F.count("*"), F.sum("length"), F.max("length"), F.min("length")).first()
        if n:
            usable = gaps.filter(F.col("gap") >= shortest)
            n_gaps, room, widest = usable.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0)), F.coalesce(F.max("gap"), F.lit(0))).first()
            longer = todo.filter(F.col("length") > widest).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] if longest > widest else 0
            new = max(-(-longer // capacity), -(-(total - room) // capacity), 0)
            gaps = usable.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
            opened, n_gaps = opened + new, n_gaps + new
    if not done:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = done[0]
    for some in done[1:]:
        places = places.unionByName(some)
    places = places.select(F.col("pid").alias(pid), F.col("seq").alias("sequence_id"), "offset")
    return pieces.join(places, pid)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every row: id, piece, start, length, ids_crc32 and, if asked for, ids (binary,
    unsigned 32-bit little-endian). A row's ids end with end_id; null texts are empty and give just that."""
    path = tokenizer or tokens.default_path()
    two = common.only(docs, id_col, text_col)
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = tokens.encoder(path).encode
        for batch in batches:
            ids, rows = batch.column(0), [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1)):
                data = encode(text.as_py()) + end
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for held, x in zip(rows, (i, p, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        held.append(x)
            made = [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5]), pa.array(rows[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(made[: len(names)], names)

    schema = f"`{id_col}` {dict(two.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return common.mapped(two, run, schema)


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """All rows of docs in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row has at least one piece (null and empty texts: the end id alone). Null and repeated ids are
    packed like any other row. An empty table gives no rows. Extra columns are ignored.
    """
    table = common.written(pieces(docs, tokenizer, capacity, end_id).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    out = pack_lengths(table, capacity=capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
