"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at 2h or fewer differing bits have a common variant within h bits of each. Every distinct
fingerprint therefore stands for all its variants within h bits (1 + 64 + 2016 for h = 2); equal variants
meet after a shuffle on variants, and colliding fingerprints are verified and linked.

The shuffle is by the leading bits of the variants. A fingerprint goes once to each of the few prefixes in
which it has variants (1 + k + k(k-1)/2 for k bits) and its variants with that prefix are spelled out
there, so 8 bytes travel for some thousand variants. k follows the number of fingerprints. A task goes
through its prefix in blocks of longer prefixes where it holds many fingerprints, which bounds memory.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Variants that a task spells out at once, about.
BLOCK = 3_000_000

_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(text: str | None, k: int = 4) -> list[bytes]:
    """Space-joined k-word shingles, repeats included; the whole sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-k]]).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over XXH64 of the shingles: a bit is set if it is in over half of them."""
    parts = shingles(text, k)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, seed) for p in parts], np.uint64)
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    held = np.bincount((octets + (np.arange(8) * 256)).ravel(), minlength=2048).reshape(8, 256)
    ones = (held @ _TABLE).ravel()  # of bit i at i, as octets are little-endian
    return int(np.bitwise_or.reduce(np.where(ones * 2 > len(h), np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """(id, fp long) for every row, and row_col if given. Null and blank texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            got = [fingerprint(t.as_py(), k, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64)), *batch.columns[2:]], [id_col, "fp", *rest])

    rest = [row_col] if row_col else []
    two = common.only(docs, id_col, text_col, *rest)
    return common.mapped(two, run, f"`{id_col}` {dict(two.dtypes)[id_col]}, fp long" + "".join(f", `{x}` long" for x in rest))


@cache
def _masks(bits: int, most: int) -> list[np.ndarray]:
    """Masks over the low `bits` bits, by the number of bits they flip, 0 to most."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def prefixes_of(fps: np.ndarray, k: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, fingerprint) for each prefix of k bits in which a fingerprint has variants."""
    flips = np.concatenate(_masks(k, half)) if k else np.zeros(1, np.uint64)
    top = fps >> np.uint64(BITS - k) if k else np.zeros(len(fps), np.uint64)
    return (top[:, None] ^ flips[None, :]).ravel(), np.repeat(fps, len(flips))


def links_in(fps: np.ndarray, prefix: int, k: int, radius: int = 4, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints that have equal variants beginning with this prefix of k bits."""
    half, low = radius // 2, BITS - k
    per = 1 + low + (low * (low - 1) // 2 if half == 2 else 0)
    if len(fps) * per > block and k < 40:  # longer prefixes, one after the other
        more = min(8, 40 - k)
        sub, owner = prefixes_of((fps << np.uint64(k)) if k else fps, more, half)
        far = _popcount((fps >> np.uint64(low)) ^ np.uint64(prefix)) if k else np.zeros(len(fps), np.int64)
        whole = np.repeat(fps, len(sub) // len(fps))
        flips = _popcount(((whole >> np.uint64(low - more)) & np.uint64((1 << more) - 1)) ^ sub) + np.repeat(far, len(sub) // len(fps))
        ok = flips <= half
        sub, whole = sub[ok], whole[ok]
        order = np.argsort(sub, kind="stable")
        sub, whole = sub[order], whole[order]
        edges = np.flatnonzero(np.diff(sub)) + 1
        out = [links_in(part, (prefix << more) | int(p), k + more, radius, block) for p, part in zip(sub[np.concatenate([[0], edges])], np.split(whole, edges))]
        a, b = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        return common.local_forest(a, b) if len(a) else (a, b)
    masks = _masks(low, half)
    far = _popcount((fps >> np.uint64(low)) ^ np.uint64(prefix)) if k else np.zeros(len(fps), np.int64)
    tail = fps & np.uint64((1 << low) - 1) if low < 64 else fps
    variants, owners = [], []
    for used in range(half + 1):
        own = np.flatnonzero(far == used)
        if len(own):
            flips = np.concatenate(masks[: half - used + 1])
            variants.append((tail[own][:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(own, len(flips)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    # Only a variant that came at least twice can collide: count by hashed slot first, sort what is left.
    with np.errstate(over="ignore"):
        slot = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - min(23, len(v).bit_length() + 1))).astype(np.int64)
    keep = np.bincount(slot)[slot] > 1
    v, o = v[keep], o[keep]
    order = np.argsort(v, kind="stable")
    v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    pairs = np.unique(np.minimum(o[same], o[same + 1]) * len(fps) + np.maximum(o[same], o[same + 1]))
    a, b = fps[pairs // len(fps)], fps[pairs % len(fps)]
    ok = (_popcount(a ^ b) <= radius) & (a != b)
    return common.local_forest(a[ok], b[ok]) if ok.any() else (a[:0], b[:0])


def linked(distinct: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """Links (a, b: fingerprints as long) among distinct fingerprints (column fp) that connect all those
    within `radius` bits of each other, directly or through others; a forest of each prefix's links."""
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4: fingerprints with a common variant are all within twice half of it")
    spark = distinct.sparkSession
    common.small_batches(spark)
    n = distinct.count() if n is None else n
    half = radius // 2
    per = {1: 65, 2: 2081}[half]
    k = 0
    while k < 24 and n * per >> k > BLOCK // 2:
        k += 1

    def spread(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            p, f = prefixes_of(fps, k, half)
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(f.view(np.int64))], ["prefix", "fp"])

    def meet(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        a, b = links_in(fps, int(table.column("prefix")[0].as_py()), k, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(spread, "prefix long, fp long").groupBy("prefix").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42, radius: int = 4, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable), group_size.

    Rows with equal fingerprints count as linked; links go between distinct fingerprints. Null and empty
    texts have fingerprint zero, which is linked like any other. Null ids stay as rows; a group's
    component_id is its smallest non-null id (null if it has none). Repeated rows stay repeated. An empty
    table gives an empty result. With row_col, a column of distinct numbers (long), it comes along, and `kept`
    says which one row of a group stays: that with the smallest id, then the smallest number. Other columns
    are ignored.
    """
    fps = common.written(fingerprints(docs, id_col, text_col, k, seed, row_col), "fingerprints")
    first = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), (F.col(f"`{row_col}`") if row_col else F.lit(0)).alias("row"))
    groups = common.written(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "fp-groups")
    links = common.written(linked(groups, radius), "fp-links")
    comp = common.components(links)
    named = groups.join(comp, groups.fp == comp.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("c"))
    named = common.written(named, "fp-components")
    least = named.groupBy("c").agg(F.min("first").alias("least"), F.sum("n").alias("group_size"), F.count("*").alias("fps"))
    named = common.joined_on_hot(named, common.written(least, "fp-least"), "c", "fps").select("fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("keep_row"), "group_size", "n")
    out = common.joined_on_hot(fps, common.written(named, "fp-named"), "fp", "n")
    extra = [row_col, (F.col(f"`{row_col}`") == F.col("keep_row")).alias("kept")] if row_col else []
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_size", *extra)
