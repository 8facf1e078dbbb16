"""Growing an index by batches of new documents.

Postings of disjoint documents add up, so a batch only adds files: its documents, postings, lexicon and the two sums
that averages need. `compact` merges the batches so far, so that their number doesn't slow queries down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumdex.functions.scoring import average_size
from vellumdex.operators.index import SearchIndex, doc_table, lexicon_of, sized_postings_of
from vellumdex.sources.corpus import from_table

TABLES = ("docs", "postings", "lexicon", "sums")


def _write(tables: dict[str, DataFrame], folder: str, batch: int) -> None:
    """Each table is written before the next is planned, as the lexicon is summed from the postings written."""
    spark = tables["docs"].sparkSession

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}/batch={batch}")

    put(tables["docs"], "docs")
    put(tables["postings"].repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "postings")
    lexicon = lexicon_of(spark.read.parquet(f"{folder}/postings/batch={batch}"))
    put(lexicon.repartitionByRange("term").sortWithinPartitions("term"), "lexicon")
    put(spark.read.parquet(f"{folder}/docs/batch={batch}").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_size"), F.lit(0)).alias("total")), "sums")


def append_batch(documents: DataFrame, folder: str, batch: int) -> None:
    """Add the documents of one batch; the same batch given again replaces its files, so none counts twice."""
    corpus = from_table(documents)
    _write({"docs": doc_table(corpus), "postings": sized_postings_of(corpus)}, folder, batch)


def append_stream(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Index a stream of (doc_id, text), each document given once."""
    writer = documents.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda df, batch: append_batch(df, folder, batch)).start()


def _read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}").drop("batch") for name in TABLES}


def grown_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The index of all batches so far: df, cf and the averages are those of the whole.

    Opening reads one row a batch. A word's df is summed over the batches' lexicons when it is looked up; the
    filter on words passes below that sum to the files.
    """
    tables = _read(spark, folder)
    lexicon = tables["lexicon"].groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    sums = tables["sums"].agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))
    row = sums.select("n_docs", average_size(F.col("total"), F.col("n_docs")).cast("double").alias("average")).first()
    return SearchIndex(tables["docs"], tables["postings"], lexicon, row["n_docs"] or 0, float("nan") if row["average"] is None else row["average"])


def compact(spark: SparkSession, folder: str, target: str) -> SearchIndex:
    """Merge all batches of a folder into one, sorted by term, in another folder, where later batches can go on.

    The old folder isn't changed, so open indexes go on reading it; it can be removed once none does. Batches
    appended to it during the merge may be missing in the new one: stop the stream, compact, start it on `target`
    with the same checkpoint. The merged batch has number -1, which no stream gives.
    """
    tables = _read(spark, folder)
    _write({"docs": tables["docs"], "postings": tables["postings"]}, target, -1)
    return grown_index(spark, target)
