"""Text and code normalisation, LIKE patterns and trigram similarity.

Everything here maps Column to Column and stays inside the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that carry no information in a street name.
PREFIX_TOKENS = [
    "avenida", "av", "avda", "av.", "calle",
    "fray", "pbro", "pbro.", "mons", "monseñor", "monsenor",
    "gral", "gral.", "general", "dr", "dr.", "pte", "pte.", "presidente",
]

# Letters that have no canonical decomposition, with their plain spelling.
_UNDECOMPOSED = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ı": "i", "ð": "d", "Ð": "D",
}
_EXPANDED = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "TH"}

# Score parts.
LIKE_SCORE = 0.7
TOKEN_SCORE = 0.15
MIN_SIMILARITY = 0.35

# Private-use characters standing for the escaped LIKE characters.
_ESCAPED = {"%": "\ue000", "_": "\ue001", "\\": "\ue002"}


@lru_cache(maxsize=1)
def _fold_pairs() -> tuple[str, str]:
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    for ch, base in _UNDECOMPOSED.items():
        src.append(ch)
        dst.append(base)
    return "".join(src), "".join(dst)


def fold_sql(s: str) -> str:
    """SQL text for plain Latin letters instead of accented ones."""
    src, dst = _fold_pairs()
    out = f"translate({s}, '{src}', '{dst}')"
    for ch, plain in _EXPANDED.items():
        out = f"replace({out}, '{ch}', '{plain}')"
    return out


def unaccent(s: Column) -> Column:
    """Plain Latin letters for accented ones; ligatures are spelled out."""
    src, dst = _fold_pairs()
    out = F.translate(s, src, dst)
    for ch, plain in _EXPANDED.items():
        out = F.replace(out, F.lit(ch), F.lit(plain))
    return out


def null_to_empty(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def norm_text(s: Column) -> Column:
    """Lower case, unaccented, every whitespace run one space; not trimmed."""
    return F.regexp_replace(unaccent(F.lower(null_to_empty(s))), r"\s+", " ")


def norm_code(s: Column) -> Column:
    """Upper case without whitespace; accents are kept."""
    return F.upper(F.regexp_replace(null_to_empty(s), r"\s+", ""))


def tokens(norm: Column) -> Column:
    return F.split(norm, " ")


def drop_prefix_tokens(toks: Column) -> Column:
    """Drops the listed tokens at any position, and null tokens."""
    return F.filter(toks, lambda t: t.isNotNull() & ~t.isin(PREFIX_TOKENS))


def name_tokens(norm: Column) -> Column:
    return drop_prefix_tokens(tokens(norm))


def like_pattern(toks: Column) -> Column:
    """``%t1%t2%`` for in-order substrings. Wildcards inside tokens stay wildcards."""
    body = F.concat(F.lit("%"), F.array_join(toks, "%"), F.lit("%"))
    return F.when(F.array_join(toks, "") == "", F.lit("%")).otherwise(body)


def _mark_escapes(pattern: Column) -> Column:
    out = F.replace(pattern, F.lit("\\\\"), F.lit(_ESCAPED["\\"]))
    out = F.replace(out, F.lit("\\%"), F.lit(_ESCAPED["%"]))
    out = F.replace(out, F.lit("\\_"), F.lit(_ESCAPED["_"]))
    return F.replace(out, F.lit("\\"), F.lit(""))


def _unmark(s: Column, escape: str) -> Column:
    for ch, mark in _ESCAPED.items():
        s = F.replace(s, F.lit(mark), F.lit(escape + ch))
    return s


def spark_like_pattern(pattern: Column) -> Column:
    """The same pattern with the needless escapes removed, which Spark rejects."""
    return _unmark(_mark_escapes(pattern), "\\")


def like(s: Column, spark_pattern: Column) -> Column:
    return F.like(s, spark_pattern)


def literal_runs(pattern: Column) -> Column:
    """The texts between the wildcards: each has to occur in a matching name."""
    runs = F.split(_mark_escapes(pattern), "[%_]+")
    return F.filter(F.transform(runs, lambda r: _unmark(r, "")), lambda r: r != "")


def wildcard_min_length(pattern: Column) -> Column:
    """How many characters the single-character wildcards ask for."""
    return F.length(F.regexp_replace(_mark_escapes(pattern), "[^_]", ""))


def grams(s: Column, n: int) -> Column:
    """All n-character slices, distinct; empty for shorter texts."""
    return F.when(
        F.length(s) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n)))),
    ).otherwise(F.array().cast("array<string>"))


def words(norm: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(norm, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def trigrams(norm: Column) -> Column:
    """Distinct trigrams of every word, padded with two spaces before and one after."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(norm), of_word)))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared share of two distinct arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def token_hits(toks: Column, norm: Column) -> Column:
    return F.size(F.filter(toks, lambda t: (t != "") & norm.contains(t)))


def token_bonus(toks: Column, norm: Column) -> Column:
    # One multiplication: adding 0.15 again and again drifts.
    return F.round(token_hits(toks, norm) * F.lit(TOKEN_SCORE), 2)


def suggestion_score(sim: Column, is_like: Column, bonus: Column) -> Column:
    flat = F.when(is_like, F.lit(LIKE_SCORE)).otherwise(F.lit(0.0))
    return F.round(F.greatest(sim, flat, bonus), 6)


def code_list(src: Column) -> Column:
    """``;``-separated codes to a normalised array; order and duplicates are kept."""
    parts = F.split(F.regexp_replace(null_to_empty(src), r"\s+", ""), ";")
    return F.filter(F.transform(parts, norm_code), lambda c: c != "")


def parity_label(number: Column) -> Column:
    # Par, impar.
    return F.when(number % 2 == 0, F.lit("par")).otherwise(F.lit("impar"))
