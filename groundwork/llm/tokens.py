"""Word-cached encoding with a public BPE tokenizer of the tokenizers library.

The tokenizer works on each white-space-separated part of a text by itself, so ids of parts are looked up
in a bounded cache. Parts of plain letters and ASCII signs go to the library's model word by word; all
others go through the library whole. Results equal Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from functools import cache

import numpy as np

#: Entries of a cache before its older half goes; with some 200 bytes each it stays near 120 MB.
MOST = 600_000

_LATIN = "a-zß-öø-ÿ"
_LETTERS = re.compile(f"[A-Za-zÀ-ÖØ-Þ{_LATIN}]+")
_PLAIN = re.compile(f"[!-~A-Za-zÀ-ÖØ-Þ{_LATIN}]+")
# The words that the tokenizer's own pattern makes of such parts.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Bounded(dict):
    """make(key), kept; of what is too much, only the newer half stays."""

    def __init__(self, make, most: int = MOST):
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        known = self.tokenizer.to_str()
        # The shortcut holds for this kind of tokenizer only; any other goes through the library whole.
        self.quick = '"Lowercase"' in known and '"NFC"' in known and "'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|" in known
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.parts = Bounded(self._word), Bounded(self._part)

    def _word(self, word: str) -> bytes:
        # Byte-level alphabet: bytes of Latin letters beyond ASCII stand for other characters.
        if not word.isascii():
            word = "".join(map(_byte_alphabet().__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _part(self, part: bytes) -> bytes:
        # Most parts are a word, or a word and one sign.
        if part.isalpha():  # of bytes: ASCII letters only
            return self.words[part.decode("ascii").lower()]
        if part[:-1].isalpha() and part[-1] in b".,;:!?|":
            return self.words[part[:-1].decode("ascii").lower()] + self.words[chr(part[-1])]
        text = part.decode("utf-8", "surrogatepass")
        if text.isalpha() and _LETTERS.fullmatch(text):
            return self.words[text.lower()]
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, _WORD.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.quick:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.parts.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@cache
def _byte_alphabet() -> list[str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in stays else chr(next(rest)) for b in range(256)]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def forget() -> None:
    """Drop the encoders of this Python worker: it outlives packing and goes on to stages that need the memory."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its caches point at each other
