"""Text expressions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges counted as one token each.
WIDE = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}\\x{20000}-\\x{2A6DF}"
WIDE_HISTORY = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}"
#: Every character of Unicode's White_Space property, and the four separators U+001C to U+001F.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = "(?U)(?<=[。！？…])|(?<=[!?])\\s+|(?<=\\.)\\s+(?=[A-Z一-鿿])"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def estimate_tokens(text: Column, wide: str = WIDE) -> Column:
    """One token for each wide character and one for every four others, rounded down."""
    # n + floor((length - n) / 4), written so that n, the wide characters, is counted once.
    return F.floor((F.length(text) + 3 * F.length(F.regexp_replace(text, f"[^{wide}]++", ""))) / 4).cast("int")


def estimate_tokens_history(text: Column) -> Column:
    """The variant of conversation histories: fewer ranges, at least 1."""
    return F.greatest(F.lit(1), estimate_tokens(text, WIDE_HISTORY))


def split_sentences(text: Column) -> Column:
    """Array of stripped, non-blank sentences."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def clean(text: Column) -> Column:
    """Control characters out, three or more newlines to two, stripped. NFC is up to the caller (see operators.cleaning)."""
    return strip(F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), "\\n{3,}", "\n\n"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays of doubles; null if either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
