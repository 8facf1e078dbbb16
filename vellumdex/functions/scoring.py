"""BM25 as SQL expressions: what many rows are scored with is one call to the JVM, not one for each operator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def number(x: float) -> str:
    """A double as an SQL literal."""
    return f"double('{x!r}')"


def rarity(df: float, n_docs: float) -> float:
    """What a term's document frequency adds to its scores. It may be negative; it isn't cut at 0."""
    return math.log2((n_docs - df + 0.5) / (df + 0.5))


def rarity_sql(df: str, n_docs: float) -> str:
    return f"log2(({number(n_docs)} - {df} + 0.5D) / ({df} + 0.5D))"


def saturation_sql(freq: str, doc_size: str, avg_doc_size: float) -> str:
    """What a term's frequency in a document of a size adds; BM25 is the product with `rarity`."""
    length = f"({number(1 - B)} + {number(B)} * {doc_size} / {number(avg_doc_size)})"
    return f"({number(K1 + 1)} * {freq} / ({number(K1)} * {length} + {freq}))"


def average_size(total: Column, n: Column) -> Column:
    """Sum of sizes over one document fewer than there are; infinite for a single document, null for none."""
    return F.when(n > 1, total / F.greatest(n - 1, F.lit(1))).when(n == 1, F.lit(float("inf")))
