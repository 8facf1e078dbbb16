"""Small delivered tables with every kind of dirt, and what is right for them in plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

CHUNK = "run_id int, term_id bigint, doc_id bigint, freq int, loaded_at timestamp_ntz"
DOCS = "doc_id bigint, size_of_doc bigint, url string, byte_offset bigint, loaded_at timestamp_ntz"
ENTRY = "run_id int, term_id bigint, tc_length int, total_size bigint, written_at timestamp_ntz"
LEXICON = "run_id int, term_id bigint, term string, term_length int, list_offset bigint, written_at timestamp_ntz"
START = datetime(2024, 3, 1)


def at(n):
    return None if n is None else START + timedelta(seconds=n)


def chunk_rows(seed=1, n=3000, terms=60, docs=150):
    """A third of the rows have one term; ids and frequencies may be null, zero or negative; rows repeat and are revised."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        doc = r.choice([None, *range(-3, docs)]) if r.random() < 0.9 else 7
        term = 5 if r.random() < 0.34 else r.choice([None, *range(terms)])
        row = (None if doc is None else doc % 3, term, doc, r.choice([None, 0, -1, 1, 1, 2, 3, 7]), at(r.choice([None, *range(40)])))
        rows += [row] * r.choice([1, 1, 1, 2])
    return rows


def doc_rows(seed=2, docs=150):
    r = random.Random(seed)
    rows = []
    for d in [None, *range(-3, docs - 20)]:
        for _ in range(r.choice([1, 1, 2, 3])):
            rows.append((d, r.choice([None, 0, -1, 40, 40, 90, 150, 200, 900]), None, 0, at(r.choice([None, *range(40)]))))
    return rows


def newest(t):
    return (t is not None, t or START)


def clean(rows):
    """{(term, doc): (run, freq)}: the latest usable row, of ties the largest freq, then run."""
    best = {}
    for run, term, doc, freq, loaded in rows:
        if term is None or doc is None or freq is None or freq < 1:
            continue
        key = (newest(loaded), freq, (run is not None, run or 0))
        if (term, doc) not in best or key > best[term, doc][0]:
            best[term, doc] = (key, run, freq)
    return {k: v[1:] for k, v in best.items()}


def sizes(rows):
    best = {}
    for doc, size, _, _, loaded in rows:
        if doc is not None:
            key = (newest(loaded), (size is not None, size or 0))
            if doc not in best or key > best[doc][0]:
                best[doc] = (key, size)
    return {d: (s if s is not None and s >= 1 else None) for d, (_, s) in best.items()}


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def with_clashes(df):
    """The same table with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("latest", "n", "size", "df", "n_rows", "weight", "hash", "word", "bucket", "_salt", "place", "rank", "bits", "label", "plain"):
        df = df.withColumn(name, F.lit("x"))
    return df
