"""How strongly a term marks a record against the whole collection: log-entropy weighting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumdex.operators.feed import usable_posting
from vellumdex.operators.skew import heavy_keys_of, join_on_skewed, sized_postings
from vellumdex.session import written


def evenness(df: Column, total: Column, spread: Column, n_docs: Column) -> Column:
    """Entropy of a term's occurrences over documents, as a part of the most it could be, between 0 and 1.

    With gf occurrences and freq in each document the entropy is ln gf - sum(freq ln freq) / gf. A term of one
    document, or a collection of one, has 0.
    """
    part = (F.log(total) - spread / total) / F.log(n_docs)
    return F.when((df < 2) | (n_docs < 2), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))


WEIGHTS = "doc_id term_id freq size df occurrences distinctness weight strength".split()


def term_weights(term_chunk: DataFrame, doc_entry: DataFrame, unit_bytes: int = 1000) -> DataFrame:
    """One row for each clean posting: its weight, and its strength given the size of the document.

    Columns: doc_id, term_id, freq, size, df (documents with the term), occurrences (over all documents),
    distinctness (1 - normalised entropy), weight = log2(1 + freq) * distinctness, and strength =
    log2(1 + freq * unit_bytes / size) * distinctness, null where the size is unknown. A term spread evenly over
    all documents has distinctness 0, a term of one document 1. Empty input gives no rows.

    The clean postings with their sizes are made by one shuffle on doc_id and written. Two aggregations read
    them: documents of the collection, and df, occurrences and sum(freq ln freq) by term, both with partial sums
    before the shuffle. A term's statistics are one row; those of heavy terms are broadcast to their postings,
    which stay where they are, the others return by an ordinary join.
    """
    return _weights(term_chunk, doc_entry, unit_bytes).select(*WEIGHTS)


def _weights(term_chunk: DataFrame, doc_entry: DataFrame, unit_bytes: int) -> DataFrame:
    heavy, _ = heavy_keys_of(term_chunk.where(usable_posting()), ["doc_id", "term_id"])
    sized = sized_postings(term_chunk, doc_entry, heavy_docs=heavy["doc_id"]).select("doc_id", "term_id", "freq", "size")
    sized = written(sized, "sized")
    n_docs = sized.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    freq = F.col("freq").cast("bigint")
    terms = sized.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"), F.sum(freq).alias("occurrences"), F.sum(freq * F.log(freq)).alias("spread"))
    distinctness = 1 - evenness(F.col("df"), F.col("occurrences"), F.col("spread"), F.col("n_docs"))
    return (
        join_on_skewed(sized, terms, "term_id", heavy["term_id"])
        .crossJoin(F.broadcast(n_docs))
        .withColumn("distinctness", distinctness)
        .select(
            "doc_id",
            "term_id",
            "freq",
            "size",
            "df",
            "occurrences",
            "n_docs",
            "distinctness",
            (F.log2(1 + F.col("freq").cast("double")) * F.col("distinctness")).alias("weight"),
            (F.log2(1 + freq * unit_bytes / F.col("size")) * F.col("distinctness")).alias("strength"),
        )
    )


def marking_terms(term_chunk: DataFrame, doc_entry: DataFrame, docs: tuple[int, int] = (2, 25), least_freq: int = 4, per_thousand: int = 20) -> DataFrame:
    """(doc_id, term_id): postings that mark their document: few documents with the term, high frequency and density.

    Kept: df within `docs`, freq >= `least_freq`, size known and freq * 1000 >= per_thousand * size. Candidates are
    the postings of at least the strength that these conditions imply: a term of at most docs[1] documents has an
    entropy of at most ln docs[1]. The whole numbers then decide; being implied, the bound loses none of theirs.
    """
    found = _weights(term_chunk, doc_entry, 1000)
    least_distinctness = F.when(F.col("n_docs") > docs[1], 1 - F.lit(math.log(docs[1])) / F.log("n_docs")).otherwise(F.lit(0.0))
    strong = F.col("strength") >= F.lit(math.log2(1 + per_thousand)) * least_distinctness - 1e-6
    dense = F.col("freq").cast("bigint") * 1000 >= F.col("size") * per_thousand
    exact = F.col("df").between(*docs) & (F.col("freq") >= least_freq) & dense
    return found.where(strong & exact).select("doc_id", "term_id")
