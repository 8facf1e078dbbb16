import pytest
from helpers import CHUNK, DOCS, ENTRY, at, chunk_rows, clean, doc_rows, sizes, tuples, with_clashes

from vellumdex.operators.feed import clean_postings, document_sizes, list_words, stated_lengths
from vellumdex.operators import skew
from vellumdex.operators.skew import heavy_keys, heavy_terms, join_on_skewed, per_term_loads, sized_postings


@pytest.fixture(scope="module")
def rows():
    return chunk_rows()


def test_clean_postings(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, CHUNK))
    assert {(t, d): (r, f) for t, d, r, f in tuples(clean_postings(df))} == clean(rows)
    assert tuples(clean_postings(df.limit(0))) == []


def test_ties_on_time_take_the_largest_values(spark):
    df = spark.createDataFrame([(1, 1, 1, 3, at(1)), (2, 1, 1, 4, at(1)), (0, 1, 1, 9, None)], CHUNK)
    assert tuples(clean_postings(df)) == [(1, 1, 2, 4)]


def test_document_sizes(spark):
    rows = doc_rows()
    assert dict(tuples(document_sizes(with_clashes(spark.createDataFrame(rows, DOCS))))) == sizes(rows)


def test_list_words(spark):
    schema = "run_id int, term_id bigint, term string, written_at timestamp_ntz"
    rows = [(0, 1, " AbC ", at(1)), (0, 1, "old", at(0)), (0, 2, None, at(5)), (0, 2, "x", at(1)), (1, 3, "\tT", None), (1, 4, "  ", at(1))]
    assert tuples(list_words(spark.createDataFrame(rows, schema))) == sorted([(0, 1, "abc"), (0, 2, None), (1, 3, "\tt"), (1, 4, "")], key=repr)


@pytest.mark.parametrize("one_step_below", [257, 2])
def test_heavy_keys_finds_all_and_is_bounded(spark, monkeypatch, one_step_below):
    monkeypatch.setattr(skew, "ONE_STEP_BELOW", one_step_below)
    rows = [(k,) for k in range(2000)] + [(7,)] * 900 + [(None,)] * 500 + [(8,)] * 40
    keys, n = heavy_keys(spark.createDataFrame(rows, "k bigint").repartition(8), "k", 0.01)
    assert n == len(rows) and 7 in keys and 8 in keys and len(keys) <= 130
    assert heavy_keys(spark.createDataFrame([], "k bigint"), "k", 0.01) == ([], 0)
    with pytest.raises(ValueError):
        heavy_keys(spark.createDataFrame([], "k bigint"), "k", 0)


@pytest.mark.parametrize("share", [0.3, 0.01, 0.9])
def test_loads_equal_plain_counts_whatever_is_heavy(spark, rows, share):
    entries = [(0, 5, 9, 1, at(1)), (1, 5, 2, 1, at(1)), (1, 5, None, 1, at(0)), (0, 6, None, 1, at(1)), (0, None, 3, 1, at(1)), (0, 7, -4, 1, at(2))]
    df = with_clashes(spark.createDataFrame(rows, CHUNK))
    got = {r["term_id"]: tuple(r)[1:] for r in per_term_loads(df, spark.createDataFrame(entries, ENTRY), share).collect()}
    want = {}
    for (term, _), (_, freq) in clean(rows).items():
        n, o = want.get(term, (0, 0))
        want[term] = (n + 1, o + freq)
    lie = {}
    for _, term, *_ in rows:
        if term is not None:
            lie[term] = lie.get(term, 0) + 1
    stated = {5: 11, 6: None, 7: None}
    assert got == {t: (n, *want.get(t, (0, 0)), stated.get(t)) for t, n in lie.items()}


def test_heavy_terms_counts_rows_as_they_lie(spark):
    rows = [(0, 1, 1, 1, at(1))] * 2 + [(0, 2, 1, 0, None)] + [(0, None, 1, 1, at(1))] * 97 + [(0, t, 1, 1, at(1)) for t in range(10, 110)]
    df = spark.createDataFrame(rows, CHUNK)
    assert tuples(heavy_terms(df, 0.01)) == [(1,)]
    assert tuples(heavy_terms(df.limit(0), 0.01)) == []


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_sized_postings_with_and_without_heavy_documents(spark, rows, share):
    docs = doc_rows()
    got = sized_postings(spark.createDataFrame(rows, CHUNK), with_clashes(spark.createDataFrame(docs, DOCS)), share)
    known = sizes(docs)
    assert {(r["term_id"], r["doc_id"]): (r["run_id"], r["freq"], r["size"]) for r in got.collect()} == {k: (*v, known.get(k[1])) for k, v in clean(rows).items()}


def test_join_on_skewed_is_a_join(spark):
    left = spark.createDataFrame([(k % 5, v) for k, v in enumerate(range(400))] + [(None, 1)], "k bigint, v bigint")
    right = spark.createDataFrame([(k, k * 10) for k in range(4)], "k bigint, w bigint")
    plain = tuples(left.join(right, "k"))
    for keys in ([], [1, 2], list(range(100))):
        assert tuples(join_on_skewed(left, right, "k", keys)) == plain


def test_stated_lengths_of_nothing(spark):
    assert tuples(stated_lengths(spark.createDataFrame([], ENTRY))) == []
