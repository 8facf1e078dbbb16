"""Layout of posting lists as the on-disk format has it, computed as analytics over the postings.

Document ids become gaps to the one before (the first to 0) and go on over block borders; a block has up to 128
postings. Of every block a list's head has the last document and the number of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumdex.functions.codec import vb_size
from vellumdex.operators.prefix import running_total

BLOCK = 128
#: Documents a slice of a list spans; windows are over slices, so that no task needs a whole long list.
SLICE = 1 << 16


def posting_gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, freq, gap, place): gap to the document before, and place in the list from 0.

    Lists are cut into slices by ranges of doc_id. The last document and the number of postings of the slices
    before are one row a slice, so the window over them is short even for a term that is in every document.
    """
    sliced = postings.select("term", "doc_id", "freq", F.floor(F.col("doc_id") / SLICE).alias("slice"))
    sizes = sliced.groupBy("term", "slice").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    order = Window.partitionBy("term").orderBy("slice")
    heads = sizes.select("term", "slice", F.coalesce(F.lag("last").over(order), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("term", "slice").orderBy("doc_id")
    placed = sliced.withColumn("_lag", F.lag("doc_id").over(inside)).withColumn("_row", F.row_number().over(inside) - 1)
    joined = placed.join(heads, ["term", "slice"])
    return joined.select("term", "doc_id", "freq", (F.col("doc_id") - F.coalesce("_lag", "before")).alias("gap"), (F.col("base") + F.col("_row")).alias("place"))


def posting_blocks(postings: DataFrame) -> DataFrame:
    """(term, block_no, n, last_doc, block_bytes): the blocks of each list, with what the list's head says of them."""
    block = F.floor(F.col("place") / BLOCK).cast("bigint").alias("block_no")
    size = vb_size(F.col("gap")) + vb_size(F.col("freq"))
    grouped = posting_gaps(postings).groupBy("term", block)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc"), F.sum(size).alias("block_bytes"))


def list_bytes(blocks: DataFrame) -> DataFrame:
    """(term, df, list_bytes): size of each encoded list with its head."""
    sums = blocks.groupBy("term").agg(
        F.sum("n").alias("df"),
        F.sum(vb_size(F.col("last_doc"))).alias("c1"),
        F.sum(vb_size(F.col("block_bytes"))).alias("c2"),
        F.sum("block_bytes").alias("blocks"),
    )
    head = vb_size(F.col("df")) + vb_size(F.col("c1")) + vb_size(F.col("c2"))
    return sums.select("term", "df", (head + F.col("c1") + F.col("c2") + F.col("blocks")).alias("list_bytes"))


def list_offsets(blocks: DataFrame) -> DataFrame:
    """(term, df, list_bytes, list_offset): lists laid one after another in byte order of their terms."""
    return running_total(list_bytes(blocks), ["term"], F.col("list_bytes"), "list_offset")


def index_sizes(blocks: DataFrame) -> DataFrame:
    """One row: blocks, bytes of all lists, bytes of the lexicon (length, term and offset of each)."""
    lists = list_bytes(blocks).agg(F.sum("list_bytes").alias("index_bytes"), F.sum(F.octet_length("term") + 12).cast("bigint").alias("lexicon_bytes"))
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks")).crossJoin(F.broadcast(lists))
