"""The inverted index as DataFrames, and its storage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumdex.functions.scoring import average_size
from vellumdex.functions.text import LONGEST_WORD, words
from vellumdex.operators.prefix import running_total


def tokens(corpus: DataFrame, keep_tail: bool = True) -> DataFrame:
    """(doc_id, pos, term): indexable words with their place among all words of the body."""
    return _tokens(corpus, keep_tail, "doc_id").select("doc_id", "pos", "term")


def _tokens(corpus: DataFrame, keep_tail: bool, *columns: str) -> DataFrame:
    every = corpus.select(*columns, F.posexplode(words(F.col("body"), keep_tail)).alias("pos", "word"))
    return every.where(F.length("word") <= LONGEST_WORD).select(*columns, "pos", F.lower("word").alias("term"))


def postings_of(corpus: DataFrame, keep_tail: bool = True) -> DataFrame:
    """(term, doc_id, freq). Keyed by both, so partial sums spread the most frequent terms over all tasks."""
    return tokens(corpus, keep_tail).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("freq"))


def sized_postings_of(corpus: DataFrame, keep_tail: bool = True) -> DataFrame:
    """(term, doc_id, freq, doc_size): with the size beside it, a posting is scored without a join."""
    grouped = _tokens(corpus, keep_tail, "doc_id", "doc_size").groupBy("term", "doc_id")
    return grouped.agg(F.count(F.lit(1)).alias("freq"), F.max("doc_size").alias("doc_size"))


def merge_postings(*runs: DataFrame) -> DataFrame:
    """Postings of several runs as one: frequencies of the same term and document add up."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return merged.groupBy("term", "doc_id").agg(F.sum("freq").alias("freq"))


def lexicon_of(postings: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("freq").alias("cf"))


def prefix_lexicon(lexicon: DataFrame, length: int = 14) -> DataFrame:
    """(prefix, term): terms looked up by their first characters only; the last in byte order stands for all."""
    return lexicon.groupBy(F.substring("term", 1, length).alias("prefix")).agg(F.max("term").alias("term"))


def doc_table(corpus: DataFrame) -> DataFrame:
    """(doc_id, url, doc_size, file, offset): the last two say where a document's region is, null for a table's."""
    place = [F.col(c) if c in corpus.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("file", "string"), ("offset", "bigint"))]
    return corpus.select("doc_id", "url", "doc_size", *place)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row, n_docs and avg_doc_size: see `average_size`."""
    sums = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_size").alias("total"))
    return sums.select("n_docs", average_size(F.col("total"), F.col("n_docs")).cast("double").alias("avg_doc_size"))


def term_ids(corpus: DataFrame) -> DataFrame:
    """(term, term_id): numbers from 0 in the order in which terms first occur."""
    first = tokens(corpus).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    placed = first.select("term", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"))
    return running_total(placed, ["doc_id", "pos"], F.lit(1), "term_id").select("term", "term_id")


def posting_lists(postings: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(term, slice, list): lists nested, ascending by document, in slices of `span` document ids.

    The slices of a term in order are its list; none has more than `span` postings, however long the list is.
    """
    sliced = postings.withColumn("slice", F.floor(F.col("doc_id") / span))
    return sliced.groupBy("term", "slice").agg(F.sort_array(F.collect_list(F.struct("doc_id", "freq"))).alias("list"))


#: Words whose df an opened index remembers.
REMEMBERED = 100_000


@dataclass
class SearchIndex:
    """An index's tables (postings as in `sized_postings_of`), and the two numbers every score needs.

    The tables of an index don't change while it is open, so what the lexicon says of a word is remembered.
    """

    docs: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    n_docs: int
    avg_doc_size: float
    remembered: dict[str, int | None] = field(default_factory=dict, repr=False, compare=False)

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """df of those of some words that the lexicon has. Words not asked for before are looked up in one job."""
        new = sorted(set(words).difference(self.remembered))
        if new:
            if len(self.remembered) + len(new) > REMEMBERED:
                self.remembered.clear()
                new = sorted(set(words))
            # the literals reach the lexicon's files
            found = {r["term"]: r["df"] for r in self.lexicon.where(F.col("term").isin(new)).select("term", "df").collect()}
            self.remembered.update({w: found.get(w) for w in new})
        return {w: n for w in words if (n := self.remembered[w]) is not None}

    @staticmethod
    def build(corpus: DataFrame, folder: str, keep_tail: bool = True) -> SearchIndex:
        """Write an index to a folder: the text is tokenized once, all else comes from the postings.

        Postings are range-partitioned and sorted by term, so that a query reads the row groups of its terms only.
        """
        spark = corpus.sparkSession
        doc_table(corpus).write.option("compression", "zstd").parquet(f"{folder}/docs")
        lists = sized_postings_of(corpus, keep_tail).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        lists.write.option("compression", "zstd").parquet(f"{folder}/postings")
        lexicon = lexicon_of(spark.read.parquet(f"{folder}/postings"))
        lexicon.repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{folder}/lexicon")
        corpus_stats(spark.read.parquet(f"{folder}/docs")).write.parquet(f"{folder}/stats")
        return SearchIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> SearchIndex:
        stats = spark.read.parquet(f"{folder}/stats").first()
        average = stats["avg_doc_size"]
        read = {name: spark.read.parquet(f"{folder}/{name}") for name in ("docs", "postings", "lexicon")}
        return SearchIndex(**read, n_docs=stats["n_docs"], avg_doc_size=float("nan") if average is None else average)


def summary(index: SearchIndex) -> DataFrame:
    """One row: documents, terms, postings and tokens."""
    terms = index.lexicon.agg(F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"), F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"))
    return index.docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(F.broadcast(terms))


def without_last_term(postings: DataFrame) -> DataFrame:
    """Postings but those of the last term in byte order, which some builds of this format lose."""
    last = F.broadcast(postings.agg(F.max("term").alias("_last")))
    return postings.join(last, F.col("term") == F.col("_last"), "left_anti")
