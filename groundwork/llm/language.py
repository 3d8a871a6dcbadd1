"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded, deterministic sample of labelled rows (MOST_ROWS); the matrix of log
probabilities (SLOTS x languages) has a fixed size and is broadcast; scoring is a sparse sum in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Hash slots of the n-gram table, and labelled rows to learn from (chosen by hash of the id), at most about.
SLOTS, MOST_ROWS = 1 << 16, 20_000
GRAMS = (2, 3)
#: Characters that are hashed at once.
PIECE = 1 << 15

_LETTER = regex.compile(r"\p{L}")
_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint64)


def grams(text: str) -> Iterator[np.ndarray]:
    """Slots of all character n-grams of the lower-cased text, some at a time; of ASCII signs all but letters
    count as a blank, and a blank stands before and behind the text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if len(codes) < 3:
        return
    codes[(codes < 128) & ~((codes >= 97) & (codes <= 122))] = 32
    with np.errstate(over="ignore"):
        for at in range(0, len(codes), PIECE):
            for n in GRAMS:
                some = codes[at : at + PIECE + n - 1].astype(np.uint64)  # those that begin in this piece
                h = np.full(max(len(some) - n + 1, 0), n, np.uint64)
                for i in range(n):
                    h = (h ^ some[i : i + len(h)]) * _PRIMES[i]
                    h ^= h >> np.uint64(29)
                yield (h & np.uint64(SLOTS - 1)).astype(np.int64)


def slot_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's sparse row: slots and how often each came, over the whole text."""
    if len(text) <= PIECE:
        return np.unique(np.concatenate([*grams(text), np.zeros(0, np.int64)]), return_counts=True)
    total = np.zeros(SLOTS, np.int64)
    for some in grams(text):
        total += np.bincount(some, minlength=SLOTS)
    held = np.flatnonzero(total)
    return held, total[held]


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # SLOTS x languages
    prior: np.ndarray

    def score(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior; "und" and 0 for null or a text without letters, or if nothing was learned."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        total = self.prior.copy()
        for some in grams(text):
            rows = self.log_prob[some]
            total += np.ones(len(rows), np.float32) @ rows
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _hashed_share(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """About `most` rows of df, by hash of the id; all of them if there are fewer."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.1) -> Model:
    """Learn from these rows; null texts and null languages are left out. Tasks sum what they read, Spark the
    sums: at most SLOTS rows for each language come to the driver."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                slots, n = slot_counts(text.as_py())
                own = total.setdefault(lang, np.zeros(SLOTS + 1, np.int64))
                own[slots] += n
                own[SLOTS] += 1  # texts
        for lang, own in total.items():
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(own[held])], ["lang", "slot", "n"])

    two = common.only(labelled, lang_col, text_col).filter(f"`{lang_col}` is not null and `{text_col}` is not null")
    merged: dict[str, np.ndarray] = {}
    for row in common.mapped(two, count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        merged.setdefault(row["lang"], np.zeros(SLOTS + 1))[row["slot"]] = row["n"]
    names = sorted(merged)
    if not names:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    table = np.stack([merged[x][:SLOTS] for x in names], axis=1) + alpha
    rows = np.array([merged[x][SLOTS] for x in names])
    return Model(names, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(rows / rows.sum()))


def predict(docs: DataFrame, model: Model, *keep: str, text_col: str = "text") -> DataFrame:
    """docs' columns `keep`, then lang_pred and score, for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # SLOTS x languages floats, whatever the input

    def run(batches):
        tokens.forget()
        for batch in batches:
            got = [shared.value.score(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    df = docs.select(*[docs[f"`{x}`"] for x in keep], docs[f"`{text_col}`"].alias("__text"))
    return common.mapped(df, run, ", ".join([*(f"`{x}` {kinds[x]}" for x in keep), "lang_pred string", "score double"]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(common.crc32_of_id(id_col) % 4 == 2, F.lit(False))


def train(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The contract's model: learned from rows whose crc32(doc_id) mod 4 is not 2, at most about `most_rows`."""
    rows = common.only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    return fit(_hashed_share(rows, "doc_id", most_rows))


def identify(docs: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score. Null texts and texts without a letter: und, 0.
    With no labelled row every text is und. Null ids count as not held out. Extra columns are ignored."""
    out = predict(common.only(docs, "doc_id", "text"), train(docs, most_rows), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
