"""Token ids in binary shards with a minimal perfect hash index.

A shard holds the raw ids of consecutive documents and, behind them, an index in which a document's key is
found in constant time:

    header   8 bytes magic, version u32, id width u32 (2 or 4 bytes), records u64, indexed u64, buckets u64, ids u64
    payload  all ids, little-endian
    seeds    buckets x i32: hash seed of the bucket, or -1 - slot where it has a single key
    records  records x (fingerprint u64, start u64, count u32, flags u32); start counts ids within the shard

Keys are 64-bit. The first `indexed` records are the slots of the perfect hash; a fingerprint is a
bijective mix of the key, so a foreign key is always refused, and a key can be told from its record.
Rows with a null key, and further rows of a repeated key, follow behind the slots.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, files, tokens

MAGIC = b"GWIDSTOR"
HEADER = struct.Struct("<8sIIQQQQ")
RECORD = np.dtype([("fp", "<u8"), ("start", "<u8"), ("count", "<u4"), ("flags", "<u4")])
#: Flags of records: the key is null; the key was in an earlier record.
NULL_KEY, REPEATED = 1, 2
#: Keys in a bucket, on average; ids in a shard, about.
PER_BUCKET, SHARD_IDS = 4, 4 << 20

_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BACK = tuple(np.uint64(pow(m, -1, 1 << 64)) for m in _ODD)


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of common.mix64."""
    x = np.asarray(x, np.uint64).copy()

    def unshift(v, s):
        y = v.copy()
        for _ in range(64 // s):
            y = v ^ (y >> np.uint64(s))
        return y

    with np.errstate(over="ignore"):
        x = unshift(x, 31) * _BACK[1]
        x = unshift(x, 27) * _BACK[0]
        return unshift(x, 30)


def _slot(fp: np.ndarray, seed, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salted = fp + np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (common.mix64(salted) % np.uint64(n)).astype(np.int64)


def perfect_hash(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each fingerprint) for distinct fingerprints: hash and displace, the
    fullest buckets first; buckets of one key name their slot outright."""
    n = len(fp)
    buckets = max(1, -(-n // PER_BUCKET))
    seeds, slots = np.zeros(buckets, np.int32), np.zeros(n, np.int64)
    if not n:
        return seeds, slots
    bucket = (fp % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    begin = np.concatenate([[0], np.cumsum(size)])
    taken = np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = order[begin[b] : begin[b + 1]]
        tries, base = 32, 1
        while True:  # some seeds at once
            trial = np.arange(base, base + tries)
            at = _slot(fp[own][None, :], trial[:, None], n)
            at.sort(axis=1)
            good = ~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
            if good.any():
                seeds[b] = trial[good.argmax()]
                break
            base += tries
            tries = min(4096, tries * 2)
        slots[own] = _slot(fp[own], int(seeds[b]), n)
        taken[slots[own]] = True
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~taken)
    slots[order[begin[single]]] = free
    seeds[single] = -1 - free
    return seeds, slots


def write_shard(out, keys: list, ids: list[bytes], width: int) -> None:
    """One shard of documents in this order; ids: unsigned 32-bit little-endian."""
    count = np.array([len(x) // 4 for x in ids], np.int64)
    start = np.cumsum(count) - count
    null = np.array([k is None for k in keys], bool)
    fp = common.mix64(np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64))
    flags = null.astype(np.uint32) * NULL_KEY
    real = np.flatnonzero(~null)
    _, first = np.unique(fp[real], return_index=True)
    index = np.sort(real[first])
    again = np.setdiff1d(real, index)
    flags[again] |= REPEATED
    seeds, slots = perfect_hash(fp[index])
    records = np.zeros(len(keys), RECORD)
    place = np.zeros(len(keys), np.int64)
    place[index] = slots
    rest = np.setdiff1d(np.arange(len(keys)), index)
    place[rest] = len(index) + np.arange(len(rest))
    for name, x in (("fp", fp), ("start", start), ("count", count), ("flags", flags)):
        records[name][place] = x
    out.write(HEADER.pack(MAGIC, 1, width, len(keys), len(index), len(seeds), int(count.sum())))
    for x in ids:
        out.write(x if width == 4 else np.frombuffer(x, "<u4").astype("<u2").tobytes())
    out.write(seeds.astype("<i4").tobytes())
    out.write(records.tobytes())


class Shard:
    """Keyed access to one shard: a key costs a positioned read of its seed, one of its record and one of its ids.
    all_records() reads the index whole, for those who want every document."""

    def __init__(self, folder: str, name: str):
        self.file = files.open_file(folder, name)
        magic, version, self.width, self.n, self.indexed, buckets, self.ids = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{name} is not a shard of token ids")
        self.buckets, self.seeds_at = buckets, HEADER.size + self.ids * self.width
        self.records_at, self.seeds, self.records = self.seeds_at + 4 * buckets, None, None

    def all_records(self) -> np.ndarray:
        if self.records is None:
            self.seeds = np.frombuffer(self.file.read_at(4 * self.buckets, self.seeds_at), "<i4")
            self.records = np.frombuffer(self.file.read_at(RECORD.itemsize * self.n, self.records_at), RECORD)
        return self.records

    def _seed(self, bucket: int) -> int:
        return int(self.seeds[bucket] if self.seeds is not None else np.frombuffer(self.file.read_at(4, self.seeds_at + 4 * bucket), "<i4")[0])

    def _record(self, slot: int):
        return self.records[slot] if self.records is not None else np.frombuffer(self.file.read_at(RECORD.itemsize, self.records_at + RECORD.itemsize * slot), RECORD)[0]

    def close(self) -> None:
        self.file.close()

    def ids_at(self, record) -> np.ndarray:
        data = self.file.read_at(int(record["count"]) * self.width, HEADER.size + int(record["start"]) * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def find(self, key: int):
        """The record of a key, or None: one seed, one slot, one comparison of fingerprints."""
        if not self.indexed:
            return None
        fp = common.mix64(np.array([key], np.int64).view(np.uint64))
        seed = self._seed(int(fp[0]) % self.buckets)
        slot = -1 - seed if seed < 0 else int(_slot(fp, seed, self.indexed)[0])
        record = self._record(slot) if 0 <= slot < self.indexed else None
        return record if record is not None and record["fp"] == fp[0] else None

    def get(self, key: int) -> np.ndarray | None:
        record = self.find(key)
        return None if record is None else self.ids_at(record)

    def keys(self) -> list:
        records = self.all_records()
        keys = unmix64(records["fp"]).view(np.int64).tolist()
        return [None if f & NULL_KEY else k for k, f in zip(keys, records["flags"].tolist())]


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, width: int = 2, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write them in ascending id order as shards in `folder`; the manifest is returned and
    written as folder/manifest: part, shard_no, name, first_key, last_key, records, ids, base (ids before).

    width 2 holds ids below 65536; a larger id raises. Repeated ids stay repeated, null ids come first. Null and
    empty texts have the end id alone; a text of any length is one record. An empty table gives an empty
    manifest. Extra columns are ignored.
    """
    path, spark = tokenizer or tokens.default_path(), docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()
    two = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    parts = common.partitions(two, 64 << 20)
    ordered = two.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())

    def run(batches):
        from pyspark import TaskContext

        encode, part, attempt = tokens.encoder(path).encode, TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        keys, ids, held, made = [], [], 0, []

        def flush():
            name = f"part-{part:06d}-{attempt}-{len(made):05d}.ids"
            if width == 2 and any(x and np.frombuffer(x, "<u4").max() > 65535 for x in ids):
                raise ValueError("an id does not fit 2 bytes: use width=4")
            with files.new_file(folder, name) as out:
                write_shard(out, keys, ids, width)
            made.append((part, len(made), name, keys[0], keys[-1], len(keys), held))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                ids.append(encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= shard_ids:
                    flush()
                    keys, ids, held = [], [], 0
        if keys:
            flush()
        names = ("part", "shard_no", "name", "first_key", "last_key", "records", "ids")
        kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], k) for i, k in enumerate(kinds)], list(names))

    shards = common.written(common.mapped(ordered, run, "part int, shard_no int, name string, first_key long, last_key long, records long, ids long"), "id-shards")
    # Sums within a task's shards, and over tasks, of which there is one row each.
    sums, at = [], 0
    for row in sorted(shards.groupBy("part").agg(F.sum("ids").alias("ids")).collect()):
        sums.append((row["part"], at))
        at += row["ids"]
    before = F.sum("ids").over(Window.partitionBy("part").orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(spark.createDataFrame(sums, "part int, start long"))
    based = shards.join(starts, "part").withColumn("base", F.col("start") + F.coalesce(before, F.lit(0))).drop("start")
    based.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, digest_only: bool = True, id_name: str = "doc_id") -> DataFrame:
    """All documents of the shards: id, start (global), n_tokens, ids_crc32 and, unless digest_only, ids.

    Every indexed key is looked up through the perfect hash, as a keyed reader would do it."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(folder, name)
                keys, out = shard.keys(), [[] for _ in range(5)]
                for i, key in enumerate(keys):
                    record = shard.find(key) if i < shard.indexed else shard.records[i]
                    if record is None or int(record["start"]) != int(shard.records[i]["start"]):
                        raise ValueError(f"{name}: the index does not lead to key {key}")
                    data = shard.ids_at(record).tobytes()
                    for held, x in zip(out, (key, base + int(record["start"]), int(record["count"]), zlib.crc32(data), data)):
                        held.append(x)
                shard.close()
                made = [*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4] if not digest_only else [], pa.binary())]
                yield pa.RecordBatch.from_arrays(made[: 4 if digest_only else 5], [id_name, "start", "n_tokens", "ids_crc32", "ids"][: 4 if digest_only else 5])

    schema = f"`{id_name}` long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest(spark, folder).select("name", "base").repartition(parts, "name").mapInArrow(run, schema)


def lookup(spark: SparkSession, folder: str, key: int) -> np.ndarray | None:
    """The ids of one document: the manifest names its shard, the shard's index its place."""
    for row in manifest(spark, folder).filter((F.col("last_key") >= key) & (F.coalesce("first_key", F.lit(-(1 << 63))) <= key)).collect():
        shard = Shard(folder, row["name"])
        got = shard.get(key)
        shard.close()
        if got is not None:
            return got
    return None
