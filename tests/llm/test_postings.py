"""Term weights, top lists and term counts against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import CHUNK, DOCS, at, chunk_rows, clean, doc_rows, sizes, tuples, with_clashes

from vellumdex.llm import distinct_terms, term_counts, top_lists


@pytest.fixture(scope="module")
def rows():
    return chunk_rows()


@pytest.fixture(scope="module")
def tables(spark, rows):
    return with_clashes(spark.createDataFrame(rows, CHUNK)), with_clashes(spark.createDataFrame(doc_rows(), DOCS))


def weights(rows, docs):
    postings, known = clean(rows), sizes(docs)
    n = len({d for _, d in postings})
    by_term = {}
    for (t, _), (_, f) in postings.items():
        by_term.setdefault(t, []).append(f)
    out = {}
    for (t, d), (_, f) in postings.items():
        fs = by_term[t]
        gf = sum(fs)
        h = -sum(x / gf * math.log(x / gf) for x in fs)
        distinct = 1 - (h / math.log(n) if len(fs) > 1 and n > 1 else 0)
        size = known.get(d)
        out[d, t] = (f, size, len(fs), gf, distinct, math.log2(1 + f) * distinct, None if size is None else math.log2(1 + f * 1000 / size) * distinct)
    return out


def test_weights(rows, tables):
    want = weights(rows, doc_rows())
    got = {(r["doc_id"], r["term_id"]): tuple(r)[2:] for r in distinct_terms.term_weights(*tables).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k


def test_weight_of_one_document_and_of_an_even_term(spark):
    docs = spark.createDataFrame([(d, 100, None, 0, at(1)) for d in range(4)], DOCS)
    one = spark.createDataFrame([(0, 1, 0, 3, at(1))], CHUNK)
    assert [r["distinctness"] for r in distinct_terms.term_weights(one, docs).collect()] == [1.0]
    even = spark.createDataFrame([(0, 1, d, 2, at(1)) for d in range(4)] + [(0, 2, 3, 2, at(1))], CHUNK)
    got = {(r["doc_id"], r["term_id"]): r["distinctness"] for r in distinct_terms.term_weights(even, docs).collect()}
    assert got[3, 2] == 1.0 and all(abs(got[d, 1]) < 1e-12 for d in range(4))


def test_marking_terms(rows, tables):
    want = {k for k, (f, s, df, *_) in weights(rows, doc_rows()).items() if 2 <= df <= 25 and f >= 4 and s is not None and f * 1000 >= 20 * s}
    assert set(tuples(distinct_terms.marking_terms(*tables))) == want


def first(rows, docs, n):
    known, lists = sizes(docs), {}
    for (t, d), (run, f) in clean(rows).items():
        lists.setdefault((run, t), []).append((-f, known.get(d) is None, known.get(d) or 0, d))
    return sorted(((run, t, x[-1], k + 1) for (run, t), v in lists.items() for k, x in enumerate(sorted(v)[:n])), key=repr)


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_top_documents(rows, tables, n):
    assert tuples(top_lists.top_documents(*tables, n)) == first(rows, doc_rows(), n)


def test_top_documents_over_many_small_runs(rows, tables, monkeypatch):
    monkeypatch.setattr(top_lists, "RUN_ROWS", 1)
    # the function is sent by name to workers, which have their own bound; run it here instead
    held = []
    sort = top_lists.sort_runs(3)
    postings = [(0, run, t, f, sizes(doc_rows()).get(d), d) for (t, d), (run, f) in clean(rows).items()]
    random.Random(3).shuffle(postings)
    names = ["bucket", "run_id", "term_id", "freq", "size", "doc_id"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    batches = []
    for k in range(0, len(postings), 50):
        columns = list(zip(*postings[k : k + 50], strict=True))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names))
    held = list(sort(iter(batches)))
    assert len(held) == len(batches)
    merged = top_lists.merge_bucket(pa.Table.from_batches(held), 3)
    got = sorted(zip(*(merged.column(c).to_pylist() for c in ("run_id", "term_id", "doc_id", "rank")), strict=True), key=repr)
    assert got == first(rows, doc_rows(), 3)


def test_top_documents_of_nothing(tables):
    chunk, docs = tables
    assert tuples(top_lists.top_documents(chunk.limit(0), docs)) == []
    assert len(tuples(top_lists.top_documents(chunk, docs.limit(0)))) > 0
    with pytest.raises(ValueError):
        top_lists.top_documents(chunk, docs, 0)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    r = random.Random(k)
    runs = [sorted(r.sample(range(1000), r.randint(0, 30))) for _ in range(k)]
    at_, out = [0] * k, []
    tree = top_lists.LoserTree([x[0] if x else None for x in runs])
    while tree.heads and tree.heads[tree.winner] is not None:
        w = tree.winner
        out.append(runs[w][at_[w]])
        at_[w] += 1
        tree.step(runs[w][at_[w]] if at_[w] < len(runs[w]) else None)
    assert out == sorted(x for run in runs for x in run)


def test_term_frequencies(rows, tables):
    postings = clean(rows)
    n = len({d for _, d in postings})
    want = {}
    for (t, _), (_, f) in postings.items():
        docs, occurrences = want.get(t, (0, 0))
        want[t] = (docs + 1, occurrences + f)
    marks = {t: "common" if 5 * d >= n else "rare" if d < 3 or o < 4 else None for t, (d, o) in want.items()}
    assert {r["term_id"]: tuple(r)[1:] for r in term_counts.term_frequencies(tables[0]).collect()} == {t: (*v, marks[t]) for t, v in want.items()}
    assert dict(tuples(term_counts.marked_terms(tables[0]))) == {t: m for t, m in marks.items() if m}
    assert tuples(term_counts.term_frequencies(tables[0].limit(0))) == []
    assert tuples(term_counts.count_documents(tables[0])) == [(n,)] and tuples(term_counts.count_documents(tables[0].limit(0))) == [(0,)]


def test_bitmaps_cross_the_array_border():
    """Containers below, at and above the size where arrays become bitmaps, united in every mixture and batching."""
    r = np.random.default_rng(1)
    want, parts = {}, []
    for term in range(4):
        for range_no in (-1, 0, 3):
            docs = set()
            for size in r.choice([1, 10, 4000, 4095, 4096, 4097, 30000], 3):
                low = r.choice(1 << 16, size, replace=False)
                doc = (range_no << 16) + low
                docs |= set(doc.tolist())
                parts.append(term_counts.build(np.full(size, term), doc, np.full(size, 2)))
            want[term, range_no] = docs
    table = pa.Table.from_batches(parts).sort_by([("term_id", "ascending"), ("range_no", "ascending")])
    for batch_rows in (1, 2, 5, 1000):
        out = pa.Table.from_batches(list(term_counts.unite_containers(iter(table.to_batches(max_chunksize=batch_rows)))))
        assert out.num_rows == len(want)
        for row in out.to_pylist():
            docs = want[row["term_id"], row["range_no"]]
            low = np.flatnonzero(np.unpackbits(term_counts.bitmap_of(row["bits"]), bitorder="little"))
            assert {(row["range_no"] << 16) + int(x) for x in low} == docs and row["docs"] == len(docs) and row["docs"] == term_counts.cardinality(row["bits"])


def test_a_posting_given_twice_is_one_document():
    batch = term_counts.build(np.array([1, 1, 1]), np.array([5, 5, 6]), np.array([2, 3, 4])).to_pylist()
    assert [(b["occurrences"], term_counts.cardinality(b["bits"])) for b in batch] == [(9, 2)]


def shuffled(spark, df) -> int:
    """Bytes that a job writes for its shuffles."""

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).head().totalShuffleWrite()

    before = written()
    df.collect()
    return written() - before


@pytest.mark.parametrize("spread", [1, 7, 0x9E3779B97F4A7C15])
def test_documents_are_counted_cheaply_however_sparse_their_ids(spark, spread):
    n = 20_000
    ids = [((k * spread) + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(n)]
    chunk = spark.createDataFrame([(0, 1, d, 1, None) for d in ids], CHUNK).repartition(3)
    found = term_counts.count_documents(chunk)
    assert found.first()["n_docs"] == n
    assert shuffled(spark, found) - shuffled(spark, chunk.select("doc_id", "freq")) < 20 * n


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_weights_with_and_without_heavy_keys(rows, tables, monkeypatch, share):
    want = weights(rows, doc_rows())
    of = distinct_terms.heavy_keys_of
    monkeypatch.setattr(distinct_terms, "heavy_keys_of", lambda df, columns: of(df, columns, share))
    got = {(r["doc_id"], r["term_id"]): tuple(r)[2:] for r in distinct_terms.term_weights(*tables).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w, abs=1e-9) for k, w in want.items())


def test_weights_of_nothing(tables):
    chunk, docs = tables
    assert distinct_terms.term_weights(chunk.limit(0), docs).collect() == [] == distinct_terms.marking_terms(chunk.limit(0), docs.limit(0)).collect()
    assert {r["strength"] for r in distinct_terms.term_weights(chunk, docs.limit(0)).collect()} == {None}
