"""Keys that hold a large part of all rows: find them in bounded memory, then treat them apart.

Heavy keys are found by a frequent-items sketch (one pass, merged from partitions). With `tracked` slots its
error is at most 3.5 / tracked of the rows, and `tracked` is 16 / share, so each key at or above `share` is
found; at most 1.3 / share keys come back, whatever the input. They are the only thing the driver or a
broadcast ever holds.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumdex.operators.feed import document_sizes, stated_lengths, usable_posting
from vellumdex.session import shuffle_partitions

#: The sketch takes at most a million slots; 16 of them a heavy key. From some 31,000 shuffle partitions on, a key just
#: below this share is therefore more than half a partition, though never more than 1 / 62,500 of the rows.
LEAST_SHARE = 16 / 1_000_000
#: From so many shuffle partitions on, sketches merge in groups first, so that no task merges those of all tasks.
ONE_STEP_BELOW = 257


def balanced_share(df: DataFrame) -> float:
    """The share from which a key is too much for one of the session's shuffle partitions: half a partition."""
    return max(LEAST_SHARE, min(0.01, 0.5 / shuffle_partitions(df.sparkSession)))


def heavy_keys(df: DataFrame, key: str, share: float | None = None) -> tuple[list, int]:
    """Keys that hold at least `share` of all rows of `df` (and perhaps a few just below), and the row count.

    Null is no key, but its rows count. Runs one job; what comes back is bounded by `share`, not by `df`.
    """
    keys, n = heavy_keys_of(df, [key], share)
    return keys[key], n


def heavy_keys_of(df: DataFrame, columns: list[str], share: float | None = None) -> tuple[dict[str, list], int]:
    """`heavy_keys` of each of some columns, all found in the same pass."""
    share = balanced_share(df) if share is None else share
    if not LEAST_SHARE <= share <= 1:
        raise ValueError(f"share must lie between {LEAST_SHARE} and 1")
    tracked = math.ceil(16 / share)
    k = math.ceil(2 / share) + 1  # the null key takes one
    parts = shuffle_partitions(df.sparkSession)
    n = F.count(F.lit(1)).alias("n")
    if parts < ONE_STEP_BELOW:
        row = df.select(*columns).agg(n, *(F.expr(f"approx_top_k(`{c}`, {k}, {tracked})").alias(f"top{i}") for i, c in enumerate(columns))).first()
    else:
        group = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(parts)))
        sketches = [F.expr(f"approx_top_k_accumulate(`{c}`, {tracked})").alias(f"sketch{i}") for i, c in enumerate(columns)]
        merged = [F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch{i}, {tracked}), {k})").alias(f"top{i}") for i in range(len(columns))]
        row = df.select(*columns).withColumn("_group", group).groupBy("_group").agg(n, *sketches).groupBy(F.lit(1)).agg(F.sum("n").alias("n"), *merged).first()
    if row is None:
        return {c: [] for c in columns}, 0
    return {c: [x["item"] for x in row[f"top{i}"] if x["item"] is not None and x["count"] >= share * row["n"]] for i, c in enumerate(columns)}, row["n"]


def key_table(df: DataFrame, key: str, keys: list) -> DataFrame:
    """The heavy keys as a table to broadcast; its size is bounded as in `heavy_keys`."""
    return F.broadcast(df.sparkSession.createDataFrame([(k,) for k in keys], df.select(key).schema))


def split(df: DataFrame, key: str, keys: list) -> tuple[DataFrame, DataFrame]:
    """Rows of the heavy keys (by broadcast join), and all others, those without a key among them."""
    if not keys:
        return df.limit(0), df
    heavy = key_table(df, key, keys)
    return df.join(heavy, key, "left_semi"), df.join(heavy, key, "left_anti")


def per_term_loads(term_chunk: DataFrame, term_entry: DataFrame | None = None, share: float | None = None) -> DataFrame:
    """Per term: rows as they lie, clean postings, occurrences and, with `term_entry`, the stated list length.

    Columns: term_id, n_rows, postings, occurrences[, stated]. One row for each non-null term_id of
    `term_chunk`; a term of unusable rows only has 0 postings and 0 occurrences; a term without a
    `term_entry` row has null for `stated`. Empty input gives no rows.

    A term's postings must be made unique before they count, so partial sums alone don't help. Heavy terms:
    rows are picked by broadcast join and shuffled on (term_id, doc_id), which spreads each over all tasks;
    their stated lengths, one row a heavy term, are broadcast. Remaining terms: one shuffle on term_id serves
    the unique postings, the sums and the join with the stated lengths. The two are united.
    """
    rows = term_chunk.select("run_id", "term_id", "doc_id", "freq", "loaded_at")
    keys, _ = heavy_keys(rows, "term_id", share)
    heavy, rest = split(rows.where("term_id IS NOT NULL"), "term_id", keys)
    stated = None if term_entry is None else stated_lengths(term_entry)

    def loads(part: DataFrame) -> DataFrame:
        latest = F.max(F.when(usable_posting(), F.struct("loaded_at", "freq"))).alias("latest")
        return (
            part.groupBy("term_id", "doc_id")
            .agg(F.count(F.lit(1)).alias("n"), latest)
            .groupBy("term_id")
            .agg(
                F.sum("n").alias("n_rows"),
                F.count("latest").alias("postings"),
                F.coalesce(F.sum(F.col("latest.freq").cast("bigint")), F.lit(0).cast("bigint")).alias("occurrences"),
            )
        )

    tail = loads(rest.repartition("term_id"))
    if stated is not None:
        tail = tail.join(stated, "term_id", "left")
    if not keys:
        return tail
    head = loads(heavy)
    if stated is not None:
        few = stated.join(key_table(stated, "term_id", keys), "term_id", "left_semi")
        head = head.join(F.broadcast(few), "term_id", "left")
    return head.unionByName(tail)


def heavy_terms(term_chunk: DataFrame, share: float = 0.01) -> DataFrame:
    """(term_id): terms that hold at least `share` of all rows of `term_chunk`, counted exactly.

    Rows without a term_id count towards all rows. Made from `per_term_loads`: the sketch proposes, the exact
    number of rows decides.
    """
    total = term_chunk.agg(F.count(F.lit(1)).alias("total"))
    loads = per_term_loads(term_chunk, share=min(share, balanced_share(term_chunk)))
    exact = Fraction(str(share))
    enough = F.col("n_rows") * exact.denominator >= F.col("total") * exact.numerator
    return loads.crossJoin(F.broadcast(total)).where(enough).select("term_id")


def sized_postings(term_chunk: DataFrame, doc_entry: DataFrame, share: float | None = None, heavy_docs: list | None = None) -> DataFrame:
    """(doc_id, run_id, term_id, freq, size): clean postings with the size of their document, null if unknown.

    One shuffle on doc_id serves both the unique postings and the join with the sizes. A document that holds more
    rows than a task should take (`heavy_docs`, looked for if not given) is shuffled on (doc_id, term_id) instead,
    and its size, one row, is broadcast. Postings without a `doc_entry` row stay, with a null size.
    """
    rows = term_chunk.select("run_id", "term_id", "doc_id", "freq", "loaded_at").where(usable_posting())
    keys = heavy_keys(rows, "doc_id", share)[0] if heavy_docs is None else heavy_docs
    heavy, rest = split(rows, "doc_id", keys)
    sizes = document_sizes(doc_entry)

    def unique(part: DataFrame) -> DataFrame:
        latest = F.max(F.struct("loaded_at", "freq", "run_id")).alias("latest")
        return part.groupBy("doc_id", "term_id").agg(latest).select(F.col("latest.run_id").alias("run_id"), "term_id", "doc_id", F.col("latest.freq").alias("freq"))

    sized = unique(rest.repartition("doc_id")).join(sizes, "doc_id", "left")
    if not keys:
        return sized
    few = sizes.join(key_table(sizes, "doc_id", keys), "doc_id", "left_semi")
    return sized.unionByName(unique(heavy).join(F.broadcast(few), "doc_id", "left"))


def join_on_skewed(left: DataFrame, right: DataFrame, key: str, keys: list) -> DataFrame:
    """Inner join on `key`, `right` having one row a key, of which `keys` hold many rows of `left`.

    These rows stay where they are: what `right` has for them, at most one row each, is broadcast to them. All
    other rows take the ordinary join. Null keys match nothing.
    """
    heavy, rest = split(left, key, keys)
    joined = rest.join(right, key)
    if not keys:
        return joined
    few = right.join(key_table(right, key, keys), key, "left_semi")
    return heavy.join(F.broadcast(few), key).unionByName(joined)
