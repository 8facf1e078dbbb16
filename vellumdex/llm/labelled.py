"""Bounded samples of labelled texts, and classifiers fitted on them on the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(rows: DataFrame, each: int, longest: int) -> list[tuple[object, str]]:
    """(label, text) pairs: of each label at most `each` distinct texts of 1 to `longest` characters, the first by hash.

    `rows` has label, doc_id and text, the labels being few. Hashes are ranked without the texts, tasks keeping
    the first of each label before they shuffle; copies of a row rank alike and count once. Only the texts chosen
    are then read and collected: labels * each * longest characters at most.
    """
    usable = rows.where(F.col("label").isNotNull() & F.length("text").between(1, longest)).select("label", F.xxhash64("doc_id", "text").alias("key"), "text")
    rank = F.dense_rank().over(Window.partitionBy("label").orderBy("key"))
    chosen = usable.select("label", "key").withColumn("rank", rank).where(F.col("rank") <= each).select("label", "key").distinct()
    texts = usable.join(F.broadcast(chosen), ["label", "key"]).groupBy("label", "key").agg(F.min("text").alias("text"))
    return [(r["label"], r["text"]) for r in sorted(texts.collect(), key=lambda r: (str(r["label"]), r["key"]))]


#: Fitted classifiers the driver keeps, the last ones used.
KEPT = 8
_FITTED: dict[str, object] = {}


def fitted_once(kind: str, sample: list[tuple], fit: Callable[[], object]):
    """What `fit` gives for a sample of tuples, fitted once: the same sample has the same classifier."""
    digest = hashlib.sha256(kind.encode())
    for row in sample:
        for value in row:
            part = str(value).encode("utf-8", "surrogatepass")
            digest.update(b"%d:" % len(part) + part)
        digest.update(b";")
    key = digest.hexdigest()
    _FITTED[key] = _FITTED.pop(key) if key in _FITTED else fit()
    while len(_FITTED) > KEPT:
        del _FITTED[next(iter(_FITTED))]
    return _FITTED[key]
