"""Encoding and decoding with a SentencePiece BPE vocabulary, with seeded merge-dropout.

Candidate merges wait in an agenda by score and place. Each candidate taken from it is skipped if a keyed
hash of (seed, document, position of the unit, step) falls below the dropout rate, so each occurrence of a
word is segmented by itself, reproducibly, and all decode to the very text. With rate 0 the ids are those of
the sentencepiece library. Merges never cross the start of a word in such vocabularies, so units (a run of
blanks and the word behind it) are encoded by themselves.

What a unit becomes depends on which steps are skipped and on nothing else. Outcomes that came lately are
held as states, (unit, set of skipped steps); an occurrence goes from state to state, a skipped step at a
time. States that are missing are made together: the agendas of many units advance step by step in numpy.
The states held bound memory, and no outcome.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common

RATE, SEED = 0.1, 42
#: Steps drawn for all units of a batch at once, and characters of a unit that may do with them; others draw alone.
STEPS, SHORT = 24, 40
#: States held before all are forgotten; characters of texts that are encoded together.
STATES, TOGETHER = 400_000, 1 << 21
_UNIT = re.compile(" *[^ ]+| +")
_BLANK = "▁"
_MASK, _ODD = (1 << 64) - 1, 0xD6E8FEB86659FD93
_NONE = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Numbers(dict):
    """Keys numbered as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Codec:
    """encode() and decode() for one vocabulary; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, rate: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rate, self.seed, self.limit = rate, seed, int(rate * 2**32)
        self.rank, self.bytes, self.table = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.table.append(b"")
            else:
                if _BLANK in piece.lstrip(_BLANK):
                    raise ValueError("pieces of this vocabulary cross words")
                self.rank[piece] = (-sp.get_score(i), i)
                self.table.append(piece.replace(_BLANK, " ").encode())
        self._tables()
        self.forget()

    def _draws(self, base: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Whether each step from start to stop (even numbers) is skipped, a row for each base; two draws a hash."""
        with np.errstate(over="ignore"):
            x = common.mix64(base[:, None] + np.arange(start // 2 + 1, stop // 2 + 1, dtype=np.uint64) * np.uint64(_ODD))
        return np.ascontiguousarray(x).view("<u4").reshape(len(base), stop - start) < self.limit

    def _skips(self, base: int, skipped: int | None):
        """Whether to skip a step: as drawn from base, or as in a set of steps."""
        if skipped is not None:
            return lambda t: skipped >> t & 1
        drawn: list = []

        def skip(t: int) -> bool:
            if t >= len(drawn):
                drawn.extend(self._draws(np.array([base], np.uint64), len(drawn), len(drawn) + 256)[0].tolist())
            return drawn[t]

        return skip

    def _unit(self, rest: str, base: int, skipped: int | None = None) -> bytes:
        """Ids of a unit; rest is the unit without its first blank. Leaves the number of candidates in steps."""
        unit = " " + rest
        rank, limit = self.rank, self.limit
        # A blank sign that is in the text itself is spelled in bytes: it must not come back as a blank.
        part: list = [_BLANK if c == " " else None if c == _BLANK else c for c in unit]
        n = len(part)
        if n <= 48:
            return self._ids(self._merged(part, base, skipped))
        skip, step = self._skips(base, skipped), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if part[i] is not None and part[i + 1] is not None and (got := rank.get(part[i] + part[i + 1])):
                agenda.append((got[0], i, i + 1, got[1], part[i] + part[i + 1]))
        heapq.heapify(agenda)
        alive = [True] * n
        while agenda:
            _, i, j, _, merged = heapq.heappop(agenda)
            if not alive[i] or j >= n or not alive[j] or after[i] != j or part[i] + part[j] != merged:
                continue
            step += 1
            if limit and skip(step - 1):
                continue
            part[i], alive[j] = merged, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if part[k] is not None and (got := rank.get(merged + part[k])):
                    heapq.heappush(agenda, (got[0], i, k, got[1], merged + part[k]))
            k = before[i]
            if k >= 0 and part[k] is not None and (got := rank.get(part[k] + merged)):
                heapq.heappush(agenda, (got[0], k, i, got[1], part[k] + merged))
        self.steps = step
        left, i = [], 0
        while i < n:
            left.append(part[i])
            i = after[i]
        return self._ids(left)

    def _merged(self, part: list, base: int, skipped: int | None = None) -> list:
        """What the agenda makes of a short unit; the next candidate is found by looking at all of them."""
        rank, limit, none = self.rank.get, self.limit, (float("inf"), -1)
        skip, step = self._skips(base, skipped), 0
        waiting = [none if p is None or q is None else rank(p + q, none) for p, q in zip(part, part[1:])]
        while waiting:
            best = min(waiting)
            if best is none or best[1] < 0:
                break
            k = waiting.index(best)
            step += 1
            if limit and skip(step - 1):
                waiting[k] = none
                continue
            part[k] += part[k + 1]
            del part[k + 1], waiting[k]
            if k < len(waiting):
                waiting[k] = none if part[k + 1] is None else rank(part[k] + part[k + 1], none)
            if k:
                waiting[k - 1] = none if part[k - 1] is None else rank(part[k - 1] + part[k], none)
        self.steps = step
        return part

    def _ids(self, parts: list) -> bytes:
        ids = []
        for p in parts:
            got = None if p is None else self.rank.get(p)
            if got:
                ids.append(got[1])
            else:
                ids += [self.bytes[b] for b in (p or _BLANK).encode("utf-8", "surrogatepass")]
        return array("I", ids).tobytes()

    def _tables(self) -> None:
        """Symbols are pieces by id, then single characters that only stand within pieces. Two symbols whose
        union is a piece make a candidate: (order of the agenda, union), found by hash of the two."""
        number = {p: i for p, (_, i) in self.rank.items()}
        chars = sorted({c for p in self.rank for c in p} - set(number))
        self.symbols = len(self.table) + len(chars)
        number |= {c: len(self.table) + i for i, c in enumerate(chars)}
        order = {i: n for n, (_, i) in enumerate(sorted(self.rank.values()))}
        self.union = np.zeros(len(order) + 1, np.int32)
        self.union[list(order.values())] = list(order)
        found = [(number[p[:k]] * self.symbols + number[p[k:]], order[i]) for p, (_, i) in self.rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        bits = (8 * len(found)).bit_length()
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slots, self.orders = np.full(size + 64, -1, np.int64), np.full(size + 64, _NONE, np.int32)
        keys = np.array([k for k, _ in found], np.int64)
        for key, at, o in zip(keys.tolist(), self._slot(keys).tolist(), (o for _, o in found)):
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.orders[at] = key, o
        known = [(ord(c), i) for c, i in number.items() if len(c) == 1 and c != _BLANK]
        self.char = np.full(max([32, *(c for c, _ in known)]) + 2, -1, np.int32)  # the last for all others
        self.char[[c for c, _ in known]] = [i for _, i in known]
        for c in range(128):  # a sign of one byte that is in no piece is its byte's piece
            if self.char[c] < 0:
                self.char[c] = self.bytes[c] or -1
        self.char[32] = number.get(_BLANK, -1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The order of each pair of symbols in the agenda, _NONE where their union is no piece."""
        keys = a.astype(np.int64) * self.symbols + b
        at = self._slot(keys)
        out, held = self.orders[at], self.slots[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        out[held != keys] = _NONE
        while len(left):
            at[left] += 1
            held = self.slots[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.orders[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def forget(self) -> None:
        """Begin with no states."""
        self.numbers, self.units, self.free, self.held = _Numbers(), [], [], 0
        self.unit_of, self.skip_of, self.steps_of = np.zeros(1024, np.int32), np.zeros(1024, np.uint32), np.zeros(1024, np.uint8)
        self.begin, self.length, self.next = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.full((1024, STEPS), -1, np.int32)
        self.pool, self.pooled = np.zeros(1 << 16, np.uint32), 0

    def _hold(self, units: np.ndarray, skips: np.ndarray, steps: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keep states; their numbers."""
        n, total = self.held + len(units), self.pooled + len(ids)
        if n > len(self.unit_of):
            for name in ("unit_of", "skip_of", "steps_of", "begin", "length", "next"):
                had = getattr(self, name)
                new = np.full((max(2 * len(had), n), *had.shape[1:]), -1 if name == "next" else 0, had.dtype)
                new[: self.held] = had[: self.held]
                setattr(self, name, new)
        if total > len(self.pool):
            new = np.zeros(max(2 * len(self.pool), total), np.uint32)
            new[: self.pooled] = self.pool[: self.pooled]
            self.pool = new
        at = np.arange(self.held, n)
        self.unit_of[at], self.skip_of[at], self.steps_of[at], self.length[at] = units, skips, steps, lengths
        self.begin[at] = self.pooled + np.cumsum(lengths) - lengths
        self.pool[self.pooled : total] = ids
        self.held, self.pooled = n, total
        return at

    def _states(self, units: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """New states of these units (by number, up to SHORT characters) and sets of skipped steps."""
        texts = [self.units[u] for u in units.tolist()]
        sizes = np.array([len(t) for t in texts], np.int64) + 1  # with the first blank
        steps, lengths = np.zeros(len(units), np.uint8), np.zeros(len(units), np.int64)
        flat = np.frombuffer(" ".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.char[np.minimum(flat, len(self.char) - 1)]
        starts, parts = np.cumsum(sizes) - sizes, []
        known = np.minimum.reduceat(codes, starts) >= 0 if len(codes) else np.zeros(0, bool)
        for lo, hi in ((0, 6), (6, 9), (9, 13), (13, 20), (20, SHORT + 1)):
            own = np.flatnonzero(known & (sizes > lo) & (sizes <= hi))
            for some in (own[i : i + 1 << 15] for i in range(0, len(own), 1 << 15)):
                left, steps[some] = self._agendas(codes, starts[some], sizes[some], hi, skips[some])
                lengths[some] = (left >= 0).sum(axis=1)
                parts.append((some, left[left >= 0]))
        for i in np.flatnonzero(~known):
            ids = np.frombuffer(self._unit(texts[i], 0, int(skips[i])), np.uint32)
            steps[i], lengths[i] = min(self.steps, 255), len(ids)
            parts.append((np.array([i]), ids))
        begin, out = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), np.uint32)
        for some, ids in parts:
            n = lengths[some]
            out[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return self._hold(units, skips, steps, lengths, out)

    def _agendas(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wide: int, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are left of each unit (a row each, -1 between), and numbers of steps. The agendas of all
        units advance together: a step takes each one's best candidate, skips it or merges the two."""
        n, column = len(starts), np.arange(wide)
        there = column < sizes[:, None]
        symbol = np.where(there, codes[np.minimum(starts[:, None] + column, len(codes) - 1)], -1)
        order = np.full((n, wide), _NONE, np.int32)
        r, c = np.nonzero(there[:, 1:])
        order[r, c] = self._candidates(symbol[r, c], symbol[r, c + 1])
        after, before = np.where(column + 1 < sizes[:, None], column + 1, -1).astype(np.int8), np.broadcast_to(column - 1, (n, wide)).astype(np.int8)
        steps, row = np.zeros(n, np.uint8), np.arange(n)
        while len(row):
            own = order[row] if len(row) < n else order
            k = own.argmin(axis=1)
            best = own[np.arange(len(row)), k]
            go = best < _NONE
            row, k, best = row[go], k[go], best[go]
            skip = (skips[row] >> np.minimum(steps[row], 31).astype(np.uint32)) & 1 == 1
            steps[row] += 1
            order[row[skip], k[skip]] = _NONE
            r, k, best = row[~skip], k[~skip], best[~skip]
            j = after[r, k].astype(np.int64)
            m = self.union[best]
            symbol[r, k], symbol[r, j], order[r, j] = m, -1, _NONE
            end = after[r, j].astype(np.int64)
            after[r, k] = end
            some = end >= 0
            order[r, k] = _NONE
            before[r[some], end[some]] = k[some]
            first = before[r, k].astype(np.int64)
            back = first >= 0
            left = np.concatenate([m[some], symbol[r[back], first[back]]])
            right = np.concatenate([symbol[r[some], end[some]], m[back]])
            order[np.concatenate([r[some], r[back]]), np.concatenate([k[some], first[back]])] = self._candidates(left, right)
        return symbol, steps

    def _numbered(self, units: list[str]) -> np.ndarray:
        """The state of each unit when nothing is skipped, -1 for units that draw alone."""
        had = len(self.numbers)
        got = np.fromiter(map(self.numbers.__getitem__, units), np.int32, len(units))
        new = list(islice(self.numbers, had, None))
        if new:
            self.units += new
            free, short = np.full(len(new), -1, np.int32), np.array([len(u) <= SHORT for u in new])
            own = np.flatnonzero(short)
            free[own] = self._states(had + own, np.zeros(len(own), np.uint32))
            self.free.append(free)
        if len(self.free) > 1:
            self.free = [np.concatenate(self.free)]
        return self.free[0][got] if self.free else got

    def encode_all(self, texts: list, keys: list) -> list[bytes]:
        """Ids of each text, drawn by its key; without a key by the text itself. Null and empty texts have none."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = len(texts[at] or ""), at + 1
            while end < len(texts) and size + len(texts[end] or "") <= TOGETHER:
                size, end = size + len(texts[end] or ""), end + 1
            out += self._together(texts[at:end], keys[at:end])
            at = end
        return out

    def _together(self, texts: list, keys: list) -> list[bytes]:
        if self.held > STATES:
            self.forget()
        split = [[] if not t else t.split(" ") if t[0] != " " and "  " not in t else [u[1:] for u in _UNIT.findall(" " + t)] for t in texts]
        counts = np.array([len(x) for x in split], np.int64)
        units = list(chain.from_iterable(split))
        state = self._numbered(units)
        alone = state < 0
        if self.limit:
            of = [self.variant((t or "").encode("utf-8", "surrogatepass") if k is None else k) for t, k in zip(texts, keys)]
            with np.errstate(over="ignore"):
                place = np.arange(len(units), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
                base = common.mix64(np.repeat(np.array(of, np.uint64), counts) + place * np.uint64(0x9E3779B97F4A7C15))
            drawn, upto = np.zeros(len(units), np.uint32), np.zeros(len(units), np.uint8)
            move = np.flatnonzero(~alone)
            while len(move):
                s = state[move]
                n = self.steps_of[s]
                late = n > STEPS
                alone[move[late]] = True
                for lo in range(0, STEPS, 8):  # eight steps at once are drawn for units that have so many
                    own = move[(n > lo) & ~late & (upto[move] == lo)]
                    eight = np.packbits(self._draws(base[own], lo, lo + 8), axis=1, bitorder="little")[:, 0]
                    drawn[own] |= eight.astype(np.uint32) << np.uint32(lo)
                    upto[own] = lo + 8
                rest = (drawn[move] & ((np.uint32(1) << np.minimum(n, STEPS).astype(np.uint32)) - np.uint32(1))) & ~self.skip_of[s]
                go = (rest != 0) & ~late
                move, s, rest = move[go], s[go], rest[go]
                bit = np.bitwise_count((rest & (~rest + np.uint32(1))) - np.uint32(1)).astype(np.int64)
                to = self.next[s, bit]
                if (to < 0).any():
                    pairs = np.unique(s[to < 0].astype(np.int64) * STEPS + bit[to < 0])
                    a, b = pairs // STEPS, pairs % STEPS
                    made = self._states(self.unit_of[a], self.skip_of[a] | (np.uint32(1) << b.astype(np.uint32)))
                    self.next[a, b] = made
                    to = self.next[s, bit]
                state[move] = to
        lonely = np.flatnonzero(alone)
        if len(lonely):
            ids = [np.frombuffer(self._unit(units[i], int(base[i]) if self.limit else 0), np.uint32) for i in lonely.tolist()]
            none = np.zeros(len(lonely))
            state[lonely] = self._hold(none, none, none, np.array([len(x) for x in ids]), np.concatenate(ids))
        lengths = self.length[state].astype(np.int64)
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.begin[state] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def variant(self, key) -> int:
        """The hash of a document that its draws come from."""
        return xxhash.xxh64_intdigest(key if isinstance(key, bytes) else str(key), self.seed & _MASK)

    def encode(self, text: str | None, key=None) -> bytes:
        return self.encode_all([text], [key])[0]

    def octets(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]

    def decode(self, ids: bytes) -> str:
        return self.octets(ids).decode("utf-8", "surrogatepass")


@cache
def codec(path: str, rate: float = RATE, seed: int = SEED) -> Codec:
    """One for each Python worker."""
    return Codec(path, rate, seed)


def encode(docs: DataFrame, path: str | None = None, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array of int) of every row; the draws come from the id, of null ids from the text."""
    path = path or default_path()
    two = common.only(docs, id_col, text_col)

    def run(batches):
        encode_all = codec(path, rate, seed).encode_all
        for batch in batches:
            got = [np.frombuffer(x, "<u4").astype(np.int32) for x in encode_all(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            flat = pa.array(np.concatenate(got) if got else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [id_col, "ids"])

    return common.mapped(two, run, f"`{id_col}` {dict(two.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids as encode() gives them; null ids arrays decode to null."""
    path = path or default_path()
    two = common.only(encoded, id_col, ids_col)

    def run(batches):
        decode_one = codec(path).decode
        for batch in batches:
            got = [None if x is None else decode_one(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], [id_col, "text"])

    return common.mapped(two, run, f"`{id_col}` {dict(two.dtypes)[id_col]}, text string")


def round_trips(docs: DataFrame, path: str | None = None, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row encoded and decoded in one pass: id, variant (31 bits of the id's hash), n_pieces, ids_crc32, text_crc32 (of the decoded
    text), lossless. Null texts count as empty: no pieces, lossless. Extra columns are ignored."""
    path = path or default_path()
    two = common.only(docs, id_col, text_col)

    def run(batches):
        c = codec(path, rate, seed)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text, ids in zip(keys, texts, c.encode_all(texts, keys)):
                back = c.octets(ids)
                for held, x in zip(out, (c.variant(key) >> 33, len(ids) // 4, zlib.crc32(ids), zlib.crc32(back), back == (text or "").encode("utf-8", "surrogatepass"))):
                    held.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], [id_col, "variant", "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    return common.mapped(two, run, f"`{id_col}` {dict(two.dtypes)[id_col]}, variant int, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
