"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled population is the labelled rows as a whole, toxic ones
among them, with their labels left aside: what the class prior is the share of. Both are bounded samples of
labelled rows, MOST_POSITIVE and MOST_UNLABELLED. A linear model over hashed word features is trained in numpy on the class-prior-corrected, non-negative risk: where the
estimated risk on negatives falls below zero, the step goes the other way.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Hash slots of the word features; labelled rows learned from as positives and as unlabelled, at most about.
SLOTS, MOST_POSITIVE, MOST_UNLABELLED = 1 << 18, 5_000, 15_000
STEPS = 300

_STRIP = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def words(text: str | None) -> set[bytes]:
    """A text's distinct lower-cased words as they stand. The whole text counts."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").split())


def slots_of(word: bytes) -> tuple[int, ...]:
    """Slots of a word without its outer ASCII punctuation: the word and its beginnings of four to six bytes,
    so that inflected forms count too."""
    word = word.strip(_STRIP)
    return (zlib.crc32(word) % SLOTS, *(zlib.crc32(word[:n], n) % SLOTS for n in (4, 5, 6) if len(word) > n)) if word else ()


class _Memo(dict):
    """What make(word) gives, kept; when there are too many, all but the last lot go."""

    def __init__(self, make, most: int = 250_000):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: bytes):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.old = {}


_slots = _Memo(slots_of)


def _forget() -> None:
    """Python workers outlive a task and go on to other stages, which need the memory."""
    _slots.forget()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's sparse row: slots, and how many of its distinct words have each."""
    flat = list(chain.from_iterable(map(_slots.__getitem__, words(text))))
    slots, n = np.unique(np.array(flat, np.int64), return_counts=True)
    return slots, n.astype(np.float64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """1 / (1 + exp(-z)), z the bias and the weights of the slots of all distinct words."""
        if "memo" not in self.__dict__:
            held = {int(i): float(self.weights[i]) for i in np.flatnonzero(self.weights)}
            self.memo = _Memo(lambda w: sum(held[s] for s in slots_of(w) if s in held))
        z = math.fsum(map(self.memo.__getitem__, words(text))) + self.bias
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))

    def forget(self) -> None:
        """Drop what score() has kept of words."""
        if "memo" in self.__dict__:
            self.__dict__.pop("memo").forget()


def _stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One flat sparse matrix: row numbers, slots, values."""
    flat = [np.concatenate(x) if rows else np.zeros(0) for x in ([s for s, _ in rows], [v for _, v in rows])]
    return np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows]), flat[0].astype(np.int64), flat[1]


def _apart(rows: list, share: np.ndarray, k: int = 8, most: float = 0.02) -> list:
    """rows without near copies of earlier ones, which would make any word of a copied text look telling:
    those that share over a third of the k least hashes of their rare slots."""
    kept, seen = [], {}
    for s, v in rows:
        rare = s[share[s] < most]
        sketch = np.sort(common.mix64(rare))[:k].tolist()
        hits: dict[int, int] = {}
        for h in sketch:
            for i in seen.get(h, ()):
                hits[i] = hits.get(i, 0) + 1
        if len(sketch) == k and max(hits.values(), default=0) * 3 > k:
            continue
        for h in sketch:
            seen.setdefault(h, []).append(len(kept))
        kept.append((s, v))
    return kept


def telling(positive: list, unlabelled: list, least: float = 13.8, least_rows: int = 3) -> np.ndarray:
    """Slots far more frequent in positive texts than their rate in unlabelled ones explains: the Chernoff bound
    of the Poisson tail is exp(-least) or less, one in a million."""
    p, u = (np.bincount(np.concatenate([s for s, _ in x]), minlength=SLOTS) for x in (positive, unlabelled))
    expected = len(positive) * (u + 1) / len(unlabelled)
    surprise = np.where(p > expected, p * np.log(np.maximum(p, 1) / expected) - (p - expected), 0)
    return (surprise >= least) & (p >= max(least_rows, 0.004 * len(positive))) & (p >= 2.5 * expected)


def train_nnpu(positive: list, unlabelled: list, prior: float, steps: int = STEPS, rate: float = 0.1, l2: float = 1e-5, beta: float = 0.0) -> Model:
    """Minimise prior*R_p(+1) + max(-beta, R_u(-1) - prior*R_p(-1)) with the logistic loss, by Adam over all rows.

    positive, unlabelled: sparse rows as features() makes them; near copies of a positive count once. Only telling() slots
    carry weight. Without positives the bias alone answers, below 0.5.
    """
    weights = np.zeros(SLOTS)
    if not positive or not unlabelled or not sum(len(s) for s, _ in positive) or not sum(len(s) for s, _ in unlabelled):
        return Model(weights, -1.0)
    share = np.bincount(np.concatenate([x for x, _ in unlabelled]), minlength=SLOTS) / len(unlabelled)
    positive = _apart(positive, share)
    used = telling(positive, unlabelled)
    number = np.cumsum(used) - 1
    cut = lambda rows: _stack([(number[x[used[x]]], np.minimum(v[used[x]], 3.0)) for x, v in rows])
    (rp, sp, xp), (ru, su, xu) = cut(positive), cut(unlabelled)
    n_p, n_u, n = len(positive), len(unlabelled), int(used.sum())
    theta = np.append(np.full(n, 1.0), math.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        zp = np.bincount(rp, theta[sp] * xp, n_p) + theta[n]
        zu = np.bincount(ru, theta[su] * xu, n_u) + theta[n]
        hp, hu = (1 / (1 + np.exp(-np.clip(z, -60, 60))) for z in (zp, zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= -beta:
            gp, gu = prior * (hp - 1) / n_p - prior * hp / n_p, hu / n_u
        else:
            gp, gu = prior * hp / n_p, -hu / n_u
        g = np.append(np.bincount(sp, gp[rp] * xp, n) + np.bincount(su, gu[ru] * xu, n) + l2 * theta[:n], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * 0.5 * (1 + math.cos(math.pi * t / steps))
        theta -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[used] = theta[:n]
    return Model(weights, float(theta[n]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(common.crc32_of_id(id_col) % 5 == 0, F.lit(False))


def _share(salt: str, n: int, most: int) -> Column:
    """True for about `most` of n rows, by hash of the id; for all if there are no more."""
    return F.lit(True) if n <= most else F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1_000_000)) < int(1_000_000 * most / n)


def _gather(texts: DataFrame) -> list:
    """(p, u, sparse row) of a bounded number of texts."""

    def run(batches):
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(2)]
            made = [pa.array([s.astype("<u4").tobytes() for s, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["p", "u", "slots", "x"])
        _forget()

    rows = common.mapped(texts.select("p", "u", "text"), run, "p boolean, u boolean, slots binary, x binary").toLocalIterator()
    return [(r["p"], r["u"], (np.frombuffer(r["slots"], "<u4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64))) for r in rows]


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn from rows of the labels table whose crc32(doc_id) mod 5 is not 0: those that toxic marks 1 are
    positive; all of them together, labels aside, are the unlabelled population, of which the class prior is the
    share of toxic ones. Ids are chosen by hash, about most_positive and most_unlabelled of them."""
    texts = common.only(docs, "doc_id", "text").filter(F.col("text").isNotNull() & ~held_out())
    marks = common.only(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    counts = marks.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not counts[0] or not counts[1]:
        return train_nnpu([], [], 0.1)
    prior = min(max(counts[1] / counts[0], 0.001), 0.9)
    # Two bounded lists of ids, whatever the input: fit to broadcast, so that texts stay where they are, in one pass.
    chosen = marks.select("doc_id", (F.col("toxic") & _share("positive", counts[1], most_positive)).alias("p"), _share("unlabelled", counts[0], most_unlabelled).alias("u")).filter("p or u")
    found = _gather(texts.join(F.broadcast(chosen), "doc_id"))
    positive, unlabelled = [x for p, _, x in found if p], [x for _, u, x in found if u]
    return train_nnpu(positive, unlabelled, prior)


def predict(docs: DataFrame, model: Model, *keep: str, text_col: str = "text") -> DataFrame:
    """docs' columns `keep`, then score, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS floats, whatever the input

    def run(batches):
        tokens.forget()
        for batch in batches:
            got = pa.array([shared.value.score(t.as_py()) for t in batch.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), got], [*keep, "score"])
        shared.value.forget()

    kinds = dict(docs.dtypes)
    df = docs.select(*[docs[f"`{x}`"] for x in keep], docs[f"`{text_col}`"].alias("__text"))
    return common.mapped(df, run, ", ".join([*(f"`{x}` {kinds[x]}" for x in keep), "score double"]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Null and empty texts get the score of no words.
    Null ids count as not held out. Without any toxic label all scores are below 0.5. Repeated rows are scored
    each, and an empty table gives no rows. Extra columns are ignored."""
    out = predict(common.only(docs, "doc_id", "text"), train(docs, labels), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
