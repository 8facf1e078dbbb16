"""Tokenization as column expressions, all of it in the JVM.

A word is a longest run of ASCII letters and digits; every other character separates. Words longer than
LONGEST_WORD are left out, not cut. Case is folded after extraction: words are ASCII then, so no character
outside it can turn into one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_WORD = 15
LONGEST_URL = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, keep_tail: bool = True) -> Column:
    """All words in order. Without `keep_tail` a word that ends the text is lost, as no separator follows it."""
    pattern = "[A-Za-z0-9]+" if keep_tail else "[A-Za-z0-9]++(?=[^A-Za-z0-9])"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def terms(text: Column, keep_tail: bool = True) -> Column:
    """Lower-case words of indexable length, in order."""
    return F.transform(F.filter(words(text, keep_tail), lambda w: F.length(w) <= LONGEST_WORD), F.lower)


def query_words(text: str) -> list[str]:
    """Words of a query, of any length, in lower case and order, repeated ones included."""
    out, run = [], ""
    for c in [*text, " "]:
        if c.isascii() and c.isalnum():
            run += c.lower()
        elif run:
            out.append(run)
            run = ""
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stored_url(url: Column) -> Column:
    """An address of LONGEST_URL bytes or more is stored as its first character."""
    return F.when(F.octet_length(url) >= LONGEST_URL, F.substring(url, 1, 1)).otherwise(url)
