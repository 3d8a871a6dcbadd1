"""Scalar text functions as Column expressions; only norm_exact needs Python."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from groundwork.constants import ACRONYM_SIMILARITY, CONTAINED_NAME_SIMILARITY

WORD = r"([\p{L}\p{N}_]+)"
NUMBER = r"(\p{Nd}+(?:[.,]\p{Nd}+)?)"


def collapse(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@cache
def _folds() -> tuple[str, str]:
    """Characters of the basic plane whose composed, case-folded form is another single character, and those."""
    pairs = [(c, unicodedata.normalize("NFKC", c).casefold()) for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)])]
    pairs = [(c, f) for c, f in pairs if len(f) == 1 and f != c]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


#: Latin letters that occur in a word without compatibility forms need no table.
_PLAIN = r"^[\x00-\x7F\u00C0-\u017E&&[^\u0130\u0131\u0132\u0133\u013F\u0140\u0149]]*$"
#: Forms of several letters, by rule the ligatures of the Latin block.
_LIGATURES = {c: unicodedata.normalize("NFKC", c).casefold() for c in map(chr, range(0xFB00, 0xFB07))} | {"ß": "ss", "ẞ": "ss", "…": "...", "ŉ": "ʼn"}


def norm(text: Column) -> Column:
    """Compatibility forms composed, case folded, collapsed, natively: wide and other single-letter forms by a
    table made from Unicode's data, Latin ligatures. Equals norm_exact but for combining marks that stand by
    themselves and other forms of several letters."""
    folded = F.translate(text, *_folds())
    for c, letters in _LIGATURES.items():
        folded = F.replace(folded, F.lit(c), F.lit(letters))
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return collapse(F.when(text.rlike(_PLAIN), plain).otherwise(F.lower(folded)))


@F.pandas_udf(StringType())
def norm_exact(text: pd.Series) -> pd.Series:
    """Compatibility-composed, case-folded, collapsed; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def normalize(text: Column) -> Column:
    """Lower-cased and collapsed."""
    return collapse(F.lower(text))


def normalize_entity(text: Column) -> Column:
    """Lower-cased, without articles, possessive s and signs but hyphens; collapsed."""
    t = F.replace(F.lower(F.trim(text)), F.lit("’"), F.lit("'"))
    t = F.regexp_replace(t, r"(?U)\b(the|a|an)\b", " ")
    t = F.regexp_replace(t, r"(?U)'s\b", "")
    return collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\s-]", " "))


def normalize_relation(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("_"), F.lit(" ")), r"(?U)\s+", " ")


def entity_match(a: Column, b: Column) -> Column:
    return (normalize_entity(a) != "") & (normalize_entity(a) == normalize_entity(b))


def normalize_bbcid(x: Column) -> Column:
    """Ids that went through a float lose their ".0"."""
    return F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")


def rsplit_once(x: Column, sep: str = "_") -> tuple[Column, Column]:
    """Parts before and behind the last separator; null without one."""
    pattern = f"^(.*){re.escape(sep)}([^{re.escape(sep)}]*)$"
    part = lambda i: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, i))
    return part(1), part(2)


def tokens(normed: Column) -> Column:
    return F.regexp_extract_all(normed, F.lit(WORD), F.lit(1))


def numbers(normed: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(normed, F.lit(NUMBER), F.lit(1))))


def numbers_differ(a: Column, b: Column) -> Column:
    """True where names hold different numbers: such names are never aliases."""
    return numbers(a) != numbers(b)


def words(normed: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(tokens(normed))


def token_f1(a: Column, b: Column) -> Column:
    return words_f1(words(a), words(b))


def words_f1(x: Column, y: Column) -> Column:
    """token_f1 of names given by their words."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """CONTAINED_NAME_SIMILARITY where the shorter name's tokens are all in the longer's, unless it is one
    token of under four characters; of equal lengths the left counts as the shorter."""
    return tokens_contained(tokens(a), tokens(b))


def tokens_contained(x: Column, y: Column) -> Column:
    """containment of names given by their tokens."""
    left = F.size(x) <= F.size(y)
    short, long = F.when(left, x).otherwise(y), F.when(left, y).otherwise(x)
    telling = (F.size(short) > 1) | (F.char_length(F.get(short, F.lit(0))) >= 4)
    return F.when((F.size(short) > 0) & (F.size(F.array_except(short, long)) == 0) & telling, CONTAINED_NAME_SIMILARITY).otherwise(0.0)


def initials(tokens_: Column) -> Column:
    """First characters of tokens, joined."""
    return F.array_join(F.transform(tokens_, lambda w: F.left(w, F.lit(1))), "")


def acronym(a: Column, b: Column) -> Column:
    """ACRONYM_SIMILARITY where one name is a single token made of the initials of the other's tokens."""
    return stands_for(short_and_long(a), short_and_long(b))


def short_and_long(normed: Column) -> Column:
    """What acronyms are told by: the token of a name that has only one, the initials of one that has more."""
    t = tokens(normed)
    return F.struct(F.when(F.size(t) == 1, F.get(t, F.lit(0))).alias("short"), F.when(F.size(t) > 1, initials(t)).alias("initials"))


def stands_for(x: Column, y: Column) -> Column:
    """acronym of names given by short_and_long."""
    return F.when((x["short"] == y["initials"]) | (y["short"] == x["initials"]), ACRONYM_SIMILARITY).otherwise(0.0)


def soft_in(a: Column, b: Column, least: int = 3) -> Column:
    """Equal when normalised, or one within the other if both have `least` characters."""
    x, y = normalize(a), normalize(b)
    within = (F.char_length(x) >= least) & (F.char_length(y) >= least) & (x.contains(y) | y.contains(x))
    return (x != "") & (y != "") & ((x == y) | within)


def ratio_or(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(default))


def sigmoid(z: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def word_count(text: Column) -> Column:
    t = collapse(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def token_text(sents: Column) -> Column:
    """Text of tokenised sentences: all tokens, joined by blanks."""
    return F.array_join(F.flatten(sents), " ")


def prompt(template: str, **parts: Column) -> Column:
    """template with {name} replaced by the parts."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
