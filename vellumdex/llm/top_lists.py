"""The first N rows of every group by a multiway merge of sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumdex.operators.skew import sized_postings
from vellumdex.session import shuffle_partitions

#: Rows of a run; bounds the memory of the task that sorts it.
RUN_ROWS = 400_000
#: Buckets a shuffle partition holds; a merging task has the runs of one bucket in memory.
BUCKETS_A_PARTITION = 16

RUN = "bucket int, run_no bigint, pos int, run_id int, term_id bigint, freq bigint, size bigint, doc_id bigint"
LISTS = "run_id int, term_id bigint, doc_id bigint, rank int"
UNKNOWN = np.iinfo(np.int64).max


class LoserTree:
    """Tournament over sorted cursors: inner nodes keep the loser, so one path is replayed for each step.

    `heads` has the current key of each cursor, None for one that has ended.
    """

    def __init__(self, heads: list):
        self.heads, self.n = heads, max(1, len(heads))
        self.losers = [-1] * self.n
        winners = [-1] * self.n + list(range(len(heads)))
        for node in range(self.n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.first(a, b) else (b, a)
        self.winner = winners[1] if self.n > 1 else (0 if heads else -1)

    def first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x <= y)

    def step(self, head) -> None:
        """Give the winning cursor its next key and find the new winner."""
        heads, losers = self.heads, self.losers
        at = self.winner
        heads[at] = head
        node = (at + self.n) >> 1
        while node:
            rival = losers[node]
            y = heads[rival]
            if y is not None and (head is None or y < head):
                losers[node], at, head = at, rival, y
            node >>= 1
        self.winner = at


def first_of_groups(sorted_group: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first n of their group, rows lying in order."""
    new = np.ones(len(sorted_group), bool)
    new[1:] = sorted_group[1:] != sorted_group[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.arange(len(new)) - start < n


def sort_runs(n: int):
    """Cut a partition into runs, sorted by bucket, group and score, of which no group needs more than n rows."""

    def sort(held: list[pa.RecordBatch], run_no: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        null = t["run_id"].is_null().to_numpy()
        run, size = t["run_id"].fill_null(0).to_numpy().astype(np.int64), t["size"].fill_null(UNKNOWN).to_numpy()
        bucket, term, doc, freq = (t[c].to_numpy().astype(np.int64) for c in ("bucket", "term_id", "doc_id", "freq"))
        order = np.lexsort((doc, size, -freq, term, run, null, bucket))
        key = np.rec.fromarrays([null[order], run[order], term[order]])
        kept = order[first_of_groups(key, n)]
        missing = size[kept] == UNKNOWN
        columns = [
            pa.array(bucket[kept].astype(np.int32)),
            pa.array(np.full(len(kept), run_no)),
            pa.array(np.arange(len(kept), dtype=np.int32)),
            pa.array(run[kept].astype(np.int32), mask=null[kept]),
            pa.array(term[kept]),
            pa.array(freq[kept]),
            pa.array(size[kept], mask=missing),
            pa.array(doc[kept]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUN.split(", ")])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        run_no = (context.partitionId() if context else 0) << 24
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield sort(held, run_no)
                held, rows, run_no = [], 0, run_no + 1
        if rows:
            yield sort(held, run_no)

    return runs


def merge_bucket(t: pa.Table, n: int) -> pa.RecordBatch:
    """Merge the runs of one bucket; rows come ordered by run and place in it."""
    run_no, term, freq, doc = (t[c].to_numpy() for c in ("run_no", "term_id", "freq", "doc_id"))
    null, run = t["run_id"].is_null().to_numpy(), t["run_id"].fill_null(0).to_numpy().astype(np.int64)
    size = t["size"].fill_null(UNKNOWN).to_numpy()
    # groups get numbers in their order, so that a key is (group, -freq, size, doc)
    order = np.lexsort((term, run, null))
    new = np.zeros(len(order), np.int64)
    new[1:] = (np.diff(term[order]) != 0) | (np.diff(run[order]) != 0) | (null[order][1:] != null[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    keys = list(zip(group.tolist(), (-freq).tolist(), size.tolist(), doc.tolist(), strict=True))
    change = np.ones(len(order), bool)
    change[1:] = (run_no[1:] != run_no[:-1]) | (group[1:] != group[:-1])
    starts = np.append(np.flatnonzero(change), len(order))
    after = np.repeat(starts[1:], np.diff(starts)).tolist()  # where a row's run goes on with the next group
    begins = np.flatnonzero(np.append(True, run_no[1:] != run_no[:-1]))
    at, ends = begins.tolist(), np.append(begins[1:], len(order)).tolist()

    tree = LoserTree([keys[a] for a in at])
    heads, step = tree.heads, tree.step
    out, ranks, current, taken = [], [], -1, 0
    while (w := tree.winner) >= 0 and (head := heads[w]) is not None:
        row = at[w]
        if head[0] != current:
            current, taken = head[0], 0
        if taken < n:
            taken += 1
            out.append(row)
            ranks.append(taken)
            row += 1
        else:
            row = after[row]  # seek
        at[w] = row
        step(keys[row] if row < ends[w] else None)
    rows = np.array(out, np.int64)
    columns = [t["run_id"].combine_chunks().take(pa.array(rows)), pa.array(term[rows]), pa.array(doc[rows]), pa.array(ranks, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["run_id", "term_id", "doc_id", "rank"])


def merge_runs(n: int):
    """Merge bucket after bucket of a partition ordered by bucket, run and place."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column("bucket")[0].as_py() != bucket[a]:
                    yield merge_bucket(pa.Table.from_batches(held), n)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield merge_bucket(pa.Table.from_batches(held), n)

    return merge


def top_documents(term_chunk: DataFrame, doc_entry: DataFrame, n: int = 3) -> DataFrame:
    """(run_id, term_id, doc_id, rank): the first n clean postings of every list (run_id, term_id).

    Order: freq descending, size ascending with unknown sizes last, doc_id ascending; doc_id is unique in a
    list, so the order is total. A null run_id is a list of its own. Shorter lists are given whole.

    Each task sorts what it holds into runs, ordered by bucket, list and score, and stores the first n rows of
    each list in it, as no run can give more: a list of any length is n rows a run. Runs lie in Spark's shuffle
    files by bucket; a task merges the runs of a bucket with a loser tree and, after n rows of a list, moves
    each run on to its next list.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    buckets = BUCKETS_A_PARTITION * shuffle_partitions(term_chunk.sparkSession)
    bucket = F.pmod(F.xxhash64("run_id", "term_id"), F.lit(buckets)).cast("int")
    postings = sized_postings(term_chunk, doc_entry).select(bucket.alias("bucket"), "run_id", "term_id", F.col("freq").cast("bigint").alias("freq"), "size", "doc_id")
    runs = postings.mapInArrow(sort_runs(n), RUN)
    return runs.repartition("bucket").sortWithinPartitions("bucket", "run_no", "pos").mapInArrow(merge_runs(n), LISTS)
