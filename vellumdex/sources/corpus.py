"""Corpora as (doc_id, url, body, doc_size[, file, offset])."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumdex.functions.text import stored_url
from vellumdex.operators.prefix import running_total
from vellumdex.session import written

OPEN, CLOSE = "<TEXT>\n", "</TEXT>"


def from_table(documents: DataFrame) -> DataFrame:
    """A table of doc_id and text: the text is the body, its bytes the size, there is no address and no gate.

    A null text is no document; an empty one is a document of size 0.
    """
    text = documents.where("text IS NOT NULL").select("doc_id", "text")
    return text.select("doc_id", F.lit(None).cast("string").alias("url"), F.col("text").alias("body"), F.octet_length("text").cast("bigint").alias("doc_size"))


def from_pages(pages: DataFrame) -> DataFrame:
    """A table of doc_id, url and text as the address line and the rest of a region: both count for the size.

    Pages whose address doesn't begin with h, or is null, are rejected.
    """
    kept = pages.select("doc_id", "url", "text").where(F.col("url").startswith("h"))
    size = F.octet_length("url") + 1 + F.octet_length(F.coalesce("text", F.lit("")))
    return kept.select("doc_id", stored_url(F.col("url")).alias("url"), F.coalesce("text", F.lit("")).alias("body"), size.cast("bigint").alias("doc_size"))


#: Splits of the input up to which their table (a file name and three numbers each) is broadcast.
MOST_SPLITS = 1_000_000


def _place(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bytes and candidate regions before each record in its split; a task reads splits one after another, in order."""
    current, carried = None, np.zeros(2, np.int64)
    for split, n_bytes, candidate in batches:
        key = split.to_numpy(zero_copy_only=False)
        if not len(key):
            yield pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, names=["ahead", "nth"])
            continue
        values = np.stack([n_bytes.to_numpy(zero_copy_only=False), candidate.to_numpy(zero_copy_only=False)]).astype(np.int64)
        before = np.cumsum(values, axis=1) - values
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        owner = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(key)]))
        start = -before[:, begins]
        if key[0] == current:
            start[:, 0] += carried
        before += start[:, owner]
        current, carried = key[-1], before[:, -1] + values[:, -1]
        yield pa.StructArray.from_arrays([pa.array(before[0]), pa.array(before[1])], names=["ahead", "nth"])


def read_trec(spark: SparkSession, path: str, tenths: int = 10) -> DataFrame:
    """Tagged text files: regions between `<TEXT>` and `</TEXT>`, the first line of each being its address.

    A region that doesn't begin with h takes no id; a last one that isn't closed is no document. Ids count up
    from 0 in the order of file names and places. doc_size is the region's bytes but the last, body the region
    after its first line without its last character, offset the region's place in its file in bytes. With
    `tenths` below 10, only regions that begin in so many tenths of their file are read: a prefix, no sample.

    Files are cut at the closing tags and read in splits by all tasks. Each task counts bytes and regions
    within its splits, from three numbers a record; sums over whole splits give places in the files and ids. The
    text isn't shuffled; regions are written once, address and body apart, as several jobs read them.
    """
    if not 1 <= tenths <= 10:
        raise ValueError("tenths must lie between 1 and 10")
    m = "_metadata"
    rows = spark.read.option("lineSep", CLOSE).text(path).select(
        "value", F.col(f"{m}.file_path").alias("file"), F.col(f"{m}.file_size").alias("file_size"), F.col(f"{m}.file_block_start").alias("split")
    )
    region = F.expr(f"CASE WHEN locate('<TEXT>\\n', value) > 0 THEN substr(value, locate('<TEXT>\\n', value) + {len(OPEN)}) END")
    rows = rows.select("file", "file_size", "split", F.octet_length("value").cast("bigint").alias("length"), region.alias("region"))
    rest = F.expr(r"CASE WHEN instr(region, '\n') > 0 THEN substr(region, instr(region, '\n') + 1, greatest(0, length(region) - instr(region, '\n') - 1)) ELSE '' END")
    in_region = F.coalesce(F.octet_length("region"), F.lit(0)).cast("bigint")
    rows = rows.select(
        "file",
        "file_size",
        "split",
        (F.col("length") + len(CLOSE)).alias("bytes"),
        (F.col("length") - in_region).alias("lead"),
        F.coalesce(F.col("region").startswith("h"), F.lit(False)).alias("candidate"),
        (in_region - 1).alias("doc_size"),
        stored_url(F.substring_index("region", "\n", 1)).alias("url"),
        rest.alias("body"),
    )
    pair = T.StructType([T.StructField("ahead", T.LongType()), T.StructField("nth", T.LongType())])
    place = F.arrow_udf(_place, pair)(F.xxhash64("file", "split"), "bytes", "candidate")
    placed = written(rows.withColumn("place", place).select(*rows.columns, "place.ahead", "place.nth"), "regions")

    def joined(df: DataFrame, splits: DataFrame) -> DataFrame:
        return df.join(F.broadcast(splits) if n_splits <= MOST_SPLITS else splits, ["file", "split"])

    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("file", "split").agg(F.sum("bytes").alias("n"))
    bases = written(sums.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "splits")
    n_splits = bases.count()
    start = F.col("base") + F.col("ahead")
    kept = joined(placed.where("candidate"), bases).where(start + F.col("bytes") <= F.col("file_size")).withColumn("offset", start + F.col("lead"))
    if tenths < 10:
        kept = kept.where(F.col("offset") < F.floor(F.col("file_size") / 10) * tenths)
    # what is left of a split are its first candidates, so their numbers go on from split to split; one row a split here
    earlier = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    first = written(counts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "firsts")
    return joined(kept, first).select((F.col("first") + F.col("nth")).alias("doc_id"), "url", "body", "doc_size", "file", F.col("offset").cast("bigint").alias("offset"))


def write_trec(pages: DataFrame, path: str) -> None:
    """Write doc_id, url and text as tagged text files, in order of doc_id, one range of ids a file. A null is empty."""
    start = F.format_string("<DOC>\n<DOCNO>D%s</DOCNO>\n" + OPEN.replace("%", "%%"), F.col("doc_id"))
    line = F.concat(start, F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"\n{CLOSE}\n</DOC>"))
    pages.select("doc_id", "url", "text").orderBy("doc_id").select(line.alias("value")).write.text(path)


def _opened(uri: str):
    """A file by its address; one without a scheme is local, s3a and s3n are s3."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path) if parts.scheme else uri)
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return system.open_input_file(path)


def _read_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "doc_size")), range(batch.num_rows), strict=True))
        bodies, file, source = [b""] * batch.num_rows, None, None
        for name, offset, size, k in places:
            if name != file:
                file, source = name, _opened(name)
            source.seek(offset)
            bodies[k] = source.read(size).partition(b"\n")[2]
        kept = [c for c in batch.schema.names if c not in ("file", "offset", "doc_size")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bodies, pa.binary())], names=[*kept, "body"])


def regions_at(places: DataFrame) -> DataFrame:
    """Texts of regions by where they are: file, offset and doc_size are replaced by body; further columns stay.

    Each region is one seek and one read of its own bytes in the task that has its row, so ten documents of a
    corpus of any size cost ten reads. Files are opened by pyarrow (local, hdfs, s3, gs). Rows without file or
    offset, as of a corpus that is a table, are left out.
    """
    others = [f for f in places.schema.fields if f.name not in ("file", "offset", "doc_size")]
    known = places.where("file IS NOT NULL AND offset IS NOT NULL AND doc_size IS NOT NULL")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "body binary"])
    return known.mapInArrow(_read_regions, schema).select(*(f.name for f in others), F.col("body").cast("string").alias("body"))


def byte_prefix(documents: DataFrame, tenths: int) -> DataFrame:
    """(doc_id, before): documents of a corpus that begin within so many tenths of its bytes, in order of doc_id.

    `documents` has doc_id and doc_size; before is the number of bytes of earlier documents.
    """
    if not 1 <= tenths <= 10:
        raise ValueError("tenths must lie between 1 and 10")
    placed = running_total(documents.select("doc_id", "doc_size"), ["doc_id"], F.col("doc_size"), "before")
    limit = documents.agg((F.floor(F.sum("doc_size") / 10) * tenths).alias("until"))
    return placed.crossJoin(F.broadcast(limit)).where(F.col("before") < F.col("until")).select("doc_id", "before")
