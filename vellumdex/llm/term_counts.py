"""Frequency of every term by compressed bitmaps of record ids with occurrence counters beside them.

A container holds the documents of one term within 65,536 consecutive ids: below 4,096 of them as a sorted
array of two-byte offsets, otherwise as a bitmap of 8,192 bytes; the length tells which. Containers of the
same term and range merge by union, their counters add up; document frequency is read from cardinality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumdex.operators.feed import clean_postings, usable_posting

RANGE_BITS = 16
BITMAP_BYTES = (1 << RANGE_BITS) // 8
ARRAY_BELOW = BITMAP_BYTES // 2
#: Postings gathered before their containers are sent on; bounds a task's memory.
FLUSH_ROWS = 400_000

CONTAINERS = "term_id bigint, range_no bigint, bits binary, occurrences bigint"
UNITED = "term_id bigint, range_no bigint, docs bigint, occurrences bigint, bits binary"


def to_bitmap(offsets: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << RANGE_BITS, bool)
    flags[offsets] = True
    return np.packbits(flags, bitorder="little")


def pack(offsets: np.ndarray) -> bytes:
    """A container of sorted distinct offsets."""
    return (offsets.astype("<u2") if len(offsets) < ARRAY_BELOW else to_bitmap(offsets)).tobytes()


def bitmap_of(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint8) if len(bits) == BITMAP_BYTES else to_bitmap(np.frombuffer(bits, "<u2"))


def cardinality(bits: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(bits, np.uint8)).sum()) if len(bits) == BITMAP_BYTES else len(bits) // 2


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins, in rows sorted by the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def build(term: np.ndarray, doc: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    """Containers of some postings, a posting given more than once being counted once in `bits`."""
    order = np.lexsort((doc, term))
    term, doc, freq = term[order], doc[order], freq[order]
    first = starts_of(term, doc)
    occurrences = np.add.reduceat(freq, first)
    term, doc = term[first], doc[first]
    range_no, offset = doc >> RANGE_BITS, doc & ((1 << RANGE_BITS) - 1)
    at = starts_of(term, range_no)
    ends = np.append(at[1:], len(term))
    raw = offset.astype("<u2").tobytes()
    bits = [raw[2 * a : 2 * b] if b - a < ARRAY_BELOW else pack(offset[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    columns = [pa.array(term[at]), pa.array(range_no[at]), pa.array(bits, pa.binary()), pa.array(np.add.reduceat(occurrences, at))]
    return pa.RecordBatch.from_arrays(columns, names=["term_id", "range_no", "bits", "occurrences"])


def build_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FLUSH_ROWS:
            yield _build_held(held)
            held, rows = [], 0
    if rows:
        yield _build_held(held)


def _build_held(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    return build(*(table[c].to_numpy().astype(np.int64) for c in ("term_id", "doc_id", "freq")))


def unite(term: np.ndarray, range_no: np.ndarray, bits: list[bytes], occurrences: np.ndarray) -> tuple:
    """Union of the containers of each (term, range); rows come sorted by these. All arrays of a batch at once."""
    at = starts_of(term, range_no)
    ends = np.append(at[1:], len(term))
    group = np.repeat(np.arange(len(at)), ends - at)
    lengths = np.array([len(b) for b in bits])
    dense = np.zeros(len(at), bool)
    dense[group[lengths == BITMAP_BYTES]] = True
    out: list[bytes] = [b""] * len(at)
    flat = ~dense[group]
    offsets = np.frombuffer(b"".join(b for b, keep in zip(bits, flat, strict=True) if keep), "<u2").astype(np.int64)
    keys = np.unique((np.repeat(group[flat], lengths[flat] // 2) << RANGE_BITS) | offsets)
    owner, low = keys >> RANGE_BITS, keys & ((1 << RANGE_BITS) - 1)
    raw, bounds = low.astype("<u2").tobytes(), np.searchsorted(owner, np.arange(len(at) + 1))
    docs = np.diff(bounds)
    for g, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        out[g] = raw[2 * a : 2 * b] if b - a < ARRAY_BELOW else pack(low[a:b])
    for g in np.flatnonzero(dense):
        union = bitmap_of(bits[at[g]]).copy()
        for k in range(at[g] + 1, ends[g]):
            union |= bitmap_of(bits[k])
        out[g] = union.tobytes()
        docs[g] = cardinality(out[g])
    return term[at], range_no[at], docs, np.add.reduceat(occurrences, at), out


def unite_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (term_id, range_no). The last group of a batch, united, waits for the next batch."""
    carry: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        term, range_no, occurrences = (batch.column(c).to_numpy().astype(np.int64) for c in ("term_id", "range_no", "occurrences"))
        bits = batch.column("bits").to_pylist()
        if carry:
            term, range_no, occurrences = (np.concatenate([[c], x]) for c, x in zip(carry[:3], (term, range_no, occurrences), strict=True))
            bits = [carry[3], *bits]
        term, range_no, docs, occurrences, bits = unite(term, range_no, bits, occurrences)
        carry = term[-1], range_no[-1], occurrences[-1], bits[-1]
        if len(term) > 1:
            yield _united(term[:-1], range_no[:-1], docs[:-1], occurrences[:-1], bits[:-1])
    if carry:
        yield _united([carry[0]], [carry[1]], [cardinality(carry[3])], [carry[2]], [carry[3]])


def _united(term, range_no, docs, occurrences, bits) -> pa.RecordBatch:
    columns = [pa.array(term, pa.int64()), pa.array(range_no, pa.int64()), pa.array(docs, pa.int64()), pa.array(occurrences, pa.int64()), pa.array(bits, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["term_id", "range_no", "docs", "occurrences", "bits"])


def term_bitmaps(postings: DataFrame) -> DataFrame:
    """(term_id, range_no, docs, occurrences, bits): the united container of each term and range of 65,536 ids.

    `postings` has term_id, doc_id (neither null) and freq. Containers are built where the postings lie, so
    the shuffle carries two bytes a posting of a frequent term; a hot term is spread over its ranges.
    """
    built = postings.select("term_id", "doc_id", "freq").mapInArrow(build_containers, CONTAINERS)
    return built.repartition("term_id", "range_no").sortWithinPartitions("term_id", "range_no").mapInArrow(unite_containers, UNITED)


def count_documents(term_chunk: DataFrame) -> DataFrame:
    """One row, n_docs: documents that have a clean posting, by the union of their containers.

    Only ranges and containers are shuffled: close ids cost two bytes or less each, lone ones a small row.
    """
    doc = term_chunk.where(usable_posting()).select(F.lit(0).cast("bigint").alias("term_id"), "doc_id", F.lit(0).alias("freq"))
    built = doc.mapInArrow(build_containers, CONTAINERS).select("range_no", "bits").repartition("range_no").sortWithinPartitions("range_no")
    united = built.select(F.lit(0).cast("bigint").alias("term_id"), "range_no", "bits", F.lit(0).cast("bigint").alias("occurrences")).mapInArrow(unite_containers, UNITED)
    return united.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"))


def term_frequencies(term_chunk: DataFrame, common_percent: int = 20, rare_docs: int = 3, rare_occurrences: int = 4) -> DataFrame:
    """(term_id, docs, occurrences, mark) of each term with a clean posting.

    mark: 'common' from `common_percent` of all documents with a clean posting on; else 'rare' below
    `rare_docs` documents or `rare_occurrences` occurrences; else null. Empty input gives no rows.
    """
    counts = term_bitmaps(clean_postings(term_chunk)).groupBy("term_id").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))
    common = F.col("docs") * 100 >= F.col("n_docs") * common_percent
    rare = (F.col("docs") < rare_docs) | (F.col("occurrences") < rare_occurrences)
    mark = F.when(common, "common").when(rare, "rare")
    return counts.crossJoin(F.broadcast(count_documents(term_chunk))).select("term_id", "docs", "occurrences", mark.alias("mark"))


def marked_terms(term_chunk: DataFrame) -> DataFrame:
    """(term_id, mark): terms of `term_frequencies` that are too common or too rare."""
    return term_frequencies(term_chunk).where("mark IS NOT NULL").select("term_id", "mark")
