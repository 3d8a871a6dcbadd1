"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, so that leading dimensions carry most of any product.
Vectors of a label are laid out in tiles along the first axes, some tiles to a block. Blocks meet only if
their boxes come near enough for the threshold, and so do tiles of two blocks; then products are accumulated
over leading dimensions, what is left is bounded by the product of suffix norms (Cauchy-Schwarz), and pairs
that can't reach the threshold any more drop out before the next dimensions are added. The pairs that are left
are decided by the cosine of the vectors as given, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a tile at most; tiles in a block, about; leading dimensions after which bounds are taken.
TILE, TILES, STEPS = 1024, 16, (8, 16, 32)
#: Rounding error allowed for before a pair is verified; leading dimensions of a box; parts a label's blocks meet in.
SLACK, WIDE, PARTS = 1e-9, 8, 16
#: Pairs of blocks up to which their list is broadcast; a row has two short strings and a number.
FEW = 100_000


def usable_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, vec) of every row; vec is binary, in the precision given, and null where a row can't link."""
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"

    def run(batches):
        for batch in batches:
            ids, labels, dims, vecs = batch.column(0), batch.column(1).to_pylist(), [], []
            for i, label, v in zip(ids.to_pylist(), labels, batch.column(2).to_pylist()):
                x = np.array(v, kind) if v and None not in v and i is not None and label is not None else np.zeros(1)
                good = bool(np.isfinite(x).all() and x.any())
                dims.append(len(x) if good else None)
                vecs.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "label", "dim", "vec"])

    three = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{label_col}`"].cast("string").alias("label"), df[f"`{vector_col}`"].alias("v"))
    return common.mapped(three, run, "id long, label string, dim int, vec binary")


def matrix(data: list[bytes], dim: int) -> np.ndarray:
    """Vectors as doubles, each scaled by a power of two, so that no square overflows and no cosine changes."""
    flat = b"".join(data)
    x = np.frombuffer(flat, "<f4" if len(flat) == 4 * dim * len(data) else "<f8").astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def verified(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of a and b whose cosine reaches threshold."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    ok = [np.einsum("ij,ij->i", a[p], b[q]) / np.sqrt(na[p] * nb[q]) >= threshold for s in range(0, len(i), 1 << 15) for p, q in [(i[s : s + (1 << 15)], j[s : s + (1 << 15)])]]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal axes (columns) by falling variance, from second moments of all unit vectors (column vec), summed
    in the workers, then by 32 tasks, a few matrices at a time."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = units(matrix(batch.column(0).to_pylist(), dim))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    def added(batches):
        total = np.zeros(dim * dim)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    some = common.mapped(rows.select("vec"), moments, "m binary")
    with common.batches_of(rows.sparkSession, max(1, (1 << 22) // dim**2)):
        some = some.repartition(32).mapInArrow(added, "m binary").collect()
    total = np.sum([np.frombuffer(r["m"], np.float64) for r in some], axis=0).reshape(dim, dim)
    values, axes = np.linalg.eigh(total)
    return axes[:, np.argsort(-values, kind="stable")]


def split_tiles(x: np.ndarray, most: int = TILE, axes: int = 6) -> list[np.ndarray]:
    """Row numbers of x in tiles of at most `most`, halved along whichever of the first axes is widest."""
    out, work = [], [np.arange(len(x))]
    while work:
        rows = work.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        lead = x[rows, :axes]
        axis = int(np.ptp(lead, axis=0).argmax())
        order = rows[np.argsort(lead[:, axis], kind="stable")]
        work += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a[i] . b[j] that can reach threshold after all bounds, to be verified by verified()."""
    dim = a.shape[1]
    cuts = [0, *(s for s in steps if s < dim), dim]
    ra, rb = np.arange(len(a)), np.arange(len(b))
    product = np.zeros((len(a), len(b)))
    for lo, hi in zip(cuts, cuts[1:]):
        product += a[ra, lo:hi] @ b[rb, lo:hi].T
        if hi == dim:
            i, j = np.nonzero(product >= threshold - SLACK)
            return ra[i], rb[j]
        rest_a, rest_b = (np.sqrt(np.maximum((y[:, hi:] ** 2).sum(axis=1), 0)) for y in (a[ra], b[rb]))
        alive = product + rest_a[:, None] * rest_b[None, :] >= threshold - SLACK
        n = int(alive.sum())
        if n * 32 < alive.size:  # few are left: finish them one by one
            i, j = np.nonzero(alive)
            i, j = ra[i], rb[j]
            ok = np.concatenate([np.einsum("ij,ij->i", a[i[s : s + 65536]], b[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold - SLACK
            return i[ok], j[ok]
        keep_a, keep_b = alive.any(axis=1), alive.any(axis=0)
        if keep_a.mean() < 0.8 or keep_b.mean() < 0.8:
            product, ra, rb = product[np.ix_(keep_a, keep_b)], ra[keep_a], rb[keep_b]
    raise AssertionError


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept, for links between vectors of equal, non-null
    labels whose cosine in double precision is >= threshold.

    Vectors that are null, zero, or hold null or non-finite components, vectors of null labels and of null
    ids link with nothing (n_links 0, component_id their own id); vectors of different dimensions don't link.
    Equal vectors of a label count as linked with each other and are compared once. Each row is a vector of
    its own, also where ids repeat; component_id is the smallest id of any row reachable. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = common.written(usable_rows(df, id_col, vector_col, label_col), "vectors")
    # Copies meet once: a class of equal vectors of a label has a number, its smallest id, how many there are.
    key = F.sha2(F.concat(F.col("label").cast("binary"), F.lit("|").cast("binary"), F.col("vec")), 256)
    classes = rows.filter("vec is not null").groupBy("label", "dim", "vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = common.written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    dims = [r[0] for r in classes.select("dim").distinct().collect()]  # a handful: the dimensions of the column
    alone = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not dims:
        return alone
    pairs = None
    for dim in dims:
        some = _tile_links(classes.filter(F.col("dim") == dim), dim, threshold, tile)
        pairs = some if pairs is None else pairs.unionByName(some)
    links = pairs.filter("n is not null").groupBy("cls").agg(F.sum("n").alias("n"))
    comp = common.components(pairs.filter("n is null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    slim = classes.select("cls", "first", "copies", key.alias("key"))
    named = slim.join(links, "cls", "left").join(comp, slim.cls == comp.node, "left").select("key", "first", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("c"))
    named = common.written(named, "vector-named")
    least = named.groupBy("c").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    named = common.written(common.joined_on_hot(named, common.written(least, "vector-least"), "c", "size").select("key", "copies", "n_links", "component_id"), "vector-components")
    out = common.joined_on_hot(rows.filter("vec is not null").select("id", key.alias("key")), named, "key", "copies")
    out = out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone.filter(rows["vec"].isNull()))


def _gap(low_a: str, high_a: str, low_b: str, high_b: str):
    """Squared distance of two boxes."""
    sides = F.zip_with(F.zip_with(low_a, high_b, lambda p, q: p - q), F.zip_with(low_b, high_a, lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(sides, F.lit(0.0), lambda acc, g: acc + g * g)


def _tile_links(classes: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """(cls, n: links of each of its vectors with other classes in a pair of blocks, other null) and
    (cls, n null, other: spanning links)."""
    spark = classes.sparkSession
    axes, wide = principal_axes(classes, dim), min(WIDE, dim)
    shared = spark.sparkContext.broadcast(axes)  # dim x dim
    most = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors at the threshold

    # Cells: labels, cut along the first axis so finely that no task lays out more than some tiles.
    def rotate(batches):
        for batch in batches:
            x = units(matrix(batch.column(1).to_pylist(), dim)) @ shared.value[:, :wide]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(x[:, 0]), batch.column(2), batch.column(3)], ["label", "vec", "x", "lead", "cls", "copies"])

    turned = common.written(common.mapped(classes.select("label", "vec", "cls", "copies"), rotate, "label string, vec binary, x binary, lead double, cls long, copies long"), "rotated")
    slab = F.floor((F.col("lead") + 1) * 512).cast("int")
    sums = turned.groupBy("label", slab.alias("slab")).agg(F.count("*").alias("n"))  # at most 1025 for each label
    run = F.sum("n").over(Window.partitionBy("label").orderBy("slab").rowsBetween(Window.unboundedPreceding, 0))
    cells = sums.withColumn("cell", F.floor((run - 1) / (TILES * tile)).cast("int")).withColumn("salts", F.ceil(F.col("n") / (2 * TILES * tile)).cast("int")).drop("n")
    placed = turned.withColumn("slab", slab).join(cells, ["label", "slab"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))

    def lay(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(-1, wide)
        vec, cls, copies = table.column("vec").to_pylist(), table.column("cls").to_numpy(), table.column("copies").to_numpy()
        order = np.argsort(cls, kind="stable")
        tiles = [order[t] for t in split_tiles(x[order], tile)]
        n, doubles = len(tiles), pa.list_(pa.float64())
        return pa.table({
            "label": pa.array([table.column("label")[0].as_py()] * n, pa.string()), "block": [f"{table.column('cell')[0].as_py()}-{table.column('salt')[0].as_py()}"] * n,
            "tile": pa.array(range(n), pa.int32()), "low": pa.array([x[t].min(axis=0).tolist() for t in tiles], doubles), "high": pa.array([x[t].max(axis=0).tolist() for t in tiles], doubles),
            "vecs": [b"".join(vec[i] for i in t) for t in tiles], "cls": [cls[t].tobytes() for t in tiles], "copies": [copies[t].tobytes() for t in tiles],
        })

    laid = placed.select("label", "cell", "salt", "vec", "x", "cls", "copies").groupBy("label", "cell", "salt").applyInArrow(lay, "label string, block string, tile int, low array<double>, high array<double>, vecs binary, cls binary, copies binary")
    tiles = common.written(laid, "tiles")
    # Blocks meet by their boxes first (no vectors), those of a label in PARTS parts.
    bound = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(wide)]).alias(c)
    boxes = tiles.groupBy("label", "block").agg(bound(F.min, "low"), bound(F.max, "high"))
    left = boxes.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int"))
    right = boxes.select("label", F.col("block").alias("other"), F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    met = left.join(right, ["label", "part"]).filter((F.col("block") <= F.col("other")) & (_gap("low", "high", "o_low", "o_high") <= most))
    met = common.written(met.select("label", "block", "other"), "block-pairs")
    pairs = F.broadcast(met) if met.count() <= FEW else met
    one = tiles.join(pairs, ["label", "block"]).withColumn("pair", F.concat_ws(" ", "block", "other"))
    two = tiles.withColumnRenamed("block", "other").join(pairs.filter("block <> other"), ["label", "other"]).withColumn("pair", F.concat_ws(" ", "block", "other"))
    columns = ["label", "pair", "tile", "low", "high", "vecs", "cls", "copies"]

    def opened(table: pa.Table) -> list[tuple]:
        out = []
        for r in table.sort_by("tile").to_pylist():
            size = len(r["vecs"]) * 8 // len(r["cls"])
            x = matrix([r["vecs"][i : i + size] for i in range(0, len(r["vecs"]), size)], dim)
            out.append((np.array(r["low"]), np.array(r["high"]), x, units(x) @ shared.value, np.frombuffer(r["cls"], np.int64), np.frombuffer(r["copies"], np.int64)))
        return out

    def compare(first: pa.Table, second: pa.Table) -> pa.Table:
        mine = opened(first)
        other = opened(second.rename_columns(columns)) if second.num_rows else mine
        counts, seen = [], []
        for s, (low, high, x, turned_x, cx, nx) in enumerate(mine):
            for t, (o_low, o_high, y, turned_y, cy, ny) in enumerate(other):
                if (other is mine and t < s) or (np.maximum(np.maximum(low - o_high, o_low - high), 0) ** 2).sum() > most:
                    continue
                i, j = near_pairs(turned_x, turned_y, threshold)
                if other is mine and s == t:
                    i, j = i[i < j], j[i < j]
                i, j = verified(x, y, i, j, threshold)
                if len(i):
                    counts += [(cx, np.bincount(i, ny[j], len(x))), (cy, np.bincount(j, nx[i], len(y)))]
                    seen.append(common.local_forest(cx[i], cy[j]))
        if not seen:
            return pa.table({k: pa.array([], pa.int64()) for k in ("cls", "n", "other")})
        cls, n = (np.concatenate([x[i] for x in counts]) for i in (0, 1))
        u, of = np.unique(cls[n > 0], return_inverse=True)
        total = np.bincount(of, n[n > 0], len(u)).astype(np.int64)
        a, b = common.local_forest(*(np.concatenate([x[i] for x in seen]) for i in (0, 1)))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"cls": np.concatenate([u, a]), "n": pa.concat_arrays([pa.array(total), none(len(a))]), "other": pa.concat_arrays([none(len(u)), pa.array(b)])})

    two = two.select(*[F.col(c).alias(f"o_{c}") for c in columns])
    met_tiles = one.select(*columns).groupBy("label", "pair").cogroup(two.groupBy("o_label", "o_pair"))
    return common.written(met_tiles.applyInArrow(compare, "cls long, n long, other long"), "tile-links")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT a AS vec_id, a AS other FROM l UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON r.other = l.a
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
"""
