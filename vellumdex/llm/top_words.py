"""Most frequent values in bounded memory: an exact part for hot values, counters for the rest.

A sketch has `BUCKETS` buckets, each with one value, the weight counted for it and the weight that voted
against it, and two rows of `CELLS` counters. A value whose bucket is held by another votes against it; once
these votes exceed `VOTES` times what the holder has, the holder's weight moves to the counters and the
newcomer takes the bucket. Partitions merge bucket by bucket: weights of the same value add up, the largest
stays, the others move to the counters, which add up as well. The size doesn't depend on the input.

For each value: held weight <= true weight <= held weight + the smaller of its two counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumdex.operators.feed import clean_postings, list_words
from vellumdex.session import written

BUCKETS = 1 << 12
CELLS = 1 << 16
VOTES = 8

#: kind -1: a bucket's holder; 0 and 1: a cell of that row of counters.
PARTS = "kind int, place int, hash bigint, word string, weight bigint"


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h & (BUCKETS - 1)).astype(np.int64)


def cell_of(h: np.ndarray, row: int) -> np.ndarray:
    return ((h >> (16 + 24 * row)) & (CELLS - 1)).astype(np.int64)


def cell_column(row: int) -> Column:
    """The same as `cell_of`, in the JVM."""
    return F.shiftright("hash", 16 + 24 * row).bitwiseAND(F.lit(CELLS - 1)).cast("int")


class Sketch:
    def __init__(self) -> None:
        self.hash = np.zeros(BUCKETS, np.int64)
        self.word = np.full(BUCKETS, None, object)
        self.held = np.zeros(BUCKETS, np.int64)
        self.against = np.zeros(BUCKETS, np.int64)
        self.counters = np.zeros((2, CELLS), np.int64)

    def count(self, h: np.ndarray, weight: np.ndarray) -> None:
        """Add to the counters."""
        for row in (0, 1):
            np.add.at(self.counters[row], cell_of(h, row), weight)

    def add(self, h: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        """Add values with weights of 1 or more. The values of a batch are summed up first, heavy ones go first."""
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, inverse, weight)
        word, bucket = word[first], bucket_of(h)
        order = np.lexsort((h, -total, bucket))
        h, word, total, bucket = h[order], word[order], total[order], bucket[order]
        begins = np.r_[True, bucket[1:] != bucket[:-1]]
        turn = np.arange(len(h)) - np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))
        # the k-th value of every bucket at a time: no bucket occurs twice in a turn
        by_turn = np.argsort(turn, kind="stable")
        for part in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
            self._turn(bucket[part], h[part], word[part], total[part])

    def _turn(self, b: np.ndarray, h: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        same = (self.held[b] > 0) & (self.hash[b] == h)
        self.held[b[same]] += weight[same]
        free = self.held[b] == 0
        other = ~same & ~free
        self.against[b[other]] += weight[other]
        evict = other & (self.against[b] >= VOTES * self.held[b])
        gone = b[evict]
        self.count(self.hash[gone], self.held[gone])
        self.count(h[other & ~evict], weight[other & ~evict])
        take = free | evict
        t = b[take]
        self.hash[t], self.word[t], self.held[t] = h[take], word[take], weight[take]
        self.against[t] = np.where(evict[take], weight[take], 0)

    def parts(self) -> Iterator[pa.RecordBatch]:
        b = np.flatnonzero(self.held)
        yield _parts(-1, b, self.hash[b], self.word[b].tolist(), self.held[b])
        for row in (0, 1):
            c = np.flatnonzero(self.counters[row])
            yield _parts(row, c, np.zeros(len(c), np.int64), [None] * len(c), self.counters[row][c])


def _parts(kind: int, place: np.ndarray, h: np.ndarray, word: list, weight: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(place), kind, np.int32)), pa.array(place.astype(np.int32)), pa.array(h), pa.array(word, pa.string()), pa.array(weight)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "place", "hash", "word", "weight"])


def sketch_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = None
    for batch in batches:
        if batch.num_rows:
            sketch = sketch or Sketch()
            word = batch.column("word").to_numpy(zero_copy_only=False)
            sketch.add(batch.column("hash").to_numpy(), word, batch.column("weight").to_numpy())
    if sketch:
        yield from sketch.parts()


def sketch_of(weighted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketch of (hash, word, weight): holders (hash, word, held, at_most) and counters (kind, place, weight).

    At most BUCKETS rows and 2 * CELLS rows, whatever the input.
    """
    parts = written(weighted.mapInArrow(sketch_partition, PARTS), "sketch")
    rivals = parts.where("kind = -1").groupBy("place", "hash", "word").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct("weight", "hash", "word")).alias("best")
    winners = rivals.groupBy("place").agg(best).select("best.*").withColumnRenamed("weight", "held")
    losers = rivals.join(F.broadcast(winners.select("hash", F.col("word"))), ["hash", "word"], "left_anti")
    moved = losers.select(F.explode(F.array(*(F.struct(F.lit(r).alias("kind"), cell_column(r).alias("place"), "weight") for r in (0, 1)))).alias("c")).select("c.*")
    counters = parts.where("kind >= 0").select("kind", "place", "weight").unionByName(moved).groupBy("kind", "place").agg(F.sum("weight").alias("weight"))
    bounded = winners
    for r in (0, 1):
        row = counters.where(F.col("kind") == r).select(F.col("place").alias(f"cell{r}"), F.col("weight").alias(f"count{r}"))
        bounded = bounded.withColumn(f"cell{r}", cell_column(r)).join(row, f"cell{r}", "left")
    most = F.col("held") + F.least(*(F.coalesce(f"count{r}", F.lit(0)) for r in (0, 1)))
    return bounded.select("hash", "word", "held", most.alias("at_most")), counters


def sums_from(weighted: DataFrame, holders: DataFrame, counters: DataFrame, least: int) -> DataFrame:
    """(word, weight): exact sums of all words that the sketch can't rule out to have `least` or more.

    These are the holders whose upper bound reaches `least`, and words both of whose counters reach it: of
    each row of counters at most total / least do, which bounds what is broadcast.
    """
    if least < 1:
        return weighted.groupBy("word").agg(F.sum("weight").alias("weight"))
    rows = weighted.withColumns({f"cell{r}": cell_column(r) for r in (0, 1)})
    full = [F.broadcast(counters.where((F.col("kind") == r) & (F.col("weight") >= least)).select(F.col("place").alias(f"cell{r}"))) for r in (0, 1)]
    hot = F.broadcast(holders.where(F.col("at_most") >= least).select("hash"))
    held = rows.join(hot, "hash", "left_semi")
    hidden = rows.join(full[0], "cell0", "left_semi").join(full[1], "cell1", "left_semi").join(hot, "hash", "left_anti")
    both = held.select("word", "weight").unionByName(hidden.select("word", "weight"))
    return both.groupBy("word").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least)


def list_weights(term_chunk: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(hash, word, weight): occurrences of each list (run_id, term_id) with its word, null where it has none.

    Summed by list before the shuffle, so a long list is one row a task; written once, as several jobs read it.
    """
    lists = clean_postings(term_chunk).groupBy("run_id", "term_id").agg(F.sum(F.col("freq").cast("bigint")).alias("weight"))
    # a null run_id names no list of the lexicon
    named = lists.join(list_words(lexicon).where("run_id IS NOT NULL AND term_id IS NOT NULL"), ["run_id", "term_id"], "left")
    return written(named.select(F.xxhash64("word").alias("hash"), "word", "weight"), "words")


def frequent_words(term_chunk: DataFrame, lexicon: DataFrame, share: float = 0.005) -> DataFrame:
    """(word, occurrences): words with at least `share` of the occurrences of all clean postings, exact sums.

    Postings without a word count in the total only. Empty input gives no rows.
    """
    weighted = list_weights(term_chunk, lexicon)
    total = weighted.agg(F.sum("weight")).first()[0] or 0
    exact = Fraction(str(share)) * total
    words = weighted.where("word IS NOT NULL")
    return sums_from(words, *sketch_of(words), max(1, -(-exact.numerator // exact.denominator))).withColumnRenamed("weight", "occurrences")


def most_frequent_words(term_chunk: DataFrame, lexicon: DataFrame, n: int = 50) -> DataFrame:
    """(word, occurrences, rank): the n words with the largest exact sums, ties by word.

    The n-th largest held weight is a lower bound of the n-th largest sum; all that can reach it is summed.
    """
    words = list_weights(term_chunk, lexicon).where("word IS NOT NULL")
    holders, counters = sketch_of(words)
    largest = [r[0] for r in holders.orderBy(F.desc("held")).limit(n).select("held").collect()]
    sums = sums_from(words, holders, counters, largest[-1] if len(largest) == n else 0)
    top = sums.orderBy(F.desc("weight"), "word").limit(n)
    place = F.expr("row_number() OVER (ORDER BY weight DESC, word)").cast("int")
    return top.select("word", F.col("weight").alias("occurrences"), place.alias("rank"))


def estimated_words(term_chunk: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, at_least, at_most): what the sketch alone says of the words that hold a bucket, in one pass.

    A frequent word is missing where another holds its bucket; its weight is at most the smaller of its two counters.
    """
    holders, _ = sketch_of(list_weights(term_chunk, lexicon).where("word IS NOT NULL"))
    return holders.select("word", F.col("held").alias("at_least"), "at_most")
