import random

import numpy as np
import pytest
from helpers import CHUNK, LEXICON, at, chunk_rows, clean, tuples, with_clashes

from vellumdex.llm import top_words


def lexicon_rows(rows, seed=4):
    r = random.Random(seed)
    out = []
    for run, term in sorted({(run, t) for (t, _), (run, _) in clean(rows).items()}, key=repr):
        for k in range(r.choice([0, 1, 1, 2])):
            out.append((run, term, r.choice([None, f" Word{(term or 0) % 17} ", f"word{(term or 0) % 17}"]), 3, 0, at(k)))
    return out


def words(rows, lexicon):
    latest = {}
    for run, term, word, _, _, written in lexicon:
        key = (written, (word is not None, word or ""))
        if (run, term) not in latest or key > latest[run, term][0]:
            latest[run, term] = (key, word)
    sums = {}
    for (t, _), (run, f) in clean(rows).items():
        word = latest.get((run, t), (None, None))[1] if run is not None else None
        word = None if word is None else word.strip(" ").lower()
        sums[word] = sums.get(word, 0) + f
    return sums


@pytest.fixture(scope="module")
def tables(spark):
    rows = chunk_rows()
    lexicon = lexicon_rows(rows)
    return with_clashes(spark.createDataFrame(rows, CHUNK)), with_clashes(spark.createDataFrame(lexicon, LEXICON)), words(rows, lexicon)


@pytest.mark.parametrize("share", [0.001, 0.05, 0.2])
def test_frequent_words(tables, share):
    chunk, lexicon, sums = tables
    total = sum(sums.values())
    assert dict(tuples(top_words.frequent_words(chunk, lexicon, share))) == {w: s for w, s in sums.items() if w is not None and s >= share * total}


@pytest.mark.parametrize("n", [1, 5, 500])
def test_most_frequent_words(tables, n):
    chunk, lexicon, sums = tables
    want = sorted(((-s, w) for w, s in sums.items() if w is not None))[:n]
    assert [(r["word"], r["occurrences"]) for r in top_words.most_frequent_words(chunk, lexicon, n).orderBy("rank").collect()] == [(w, -s) for s, w in want]


def test_bounds_hold(tables):
    chunk, lexicon, sums = tables
    for r in top_words.estimated_words(chunk, lexicon).collect():
        assert r["at_least"] <= sums[r["word"]] <= r["at_most"]


def test_nothing(tables):
    chunk, lexicon, _ = tables
    for a, b in ((chunk.limit(0), lexicon), (chunk, lexicon.limit(0))):
        assert tuples(top_words.frequent_words(a, b)) == [] and tuples(top_words.most_frequent_words(a, b)) == []


def test_far_more_words_than_buckets(spark):
    """The sketch's bounds and the exact candidates, when nearly all words are evicted."""
    r = np.random.default_rng(2)
    n = 60_000
    ids = np.concatenate([r.integers(0, 50_000, n), np.repeat(np.arange(5), 2000)])
    df = spark.createDataFrame([(f"w{i}",) for i in ids.tolist()], "word string").repartition(7)
    weighted = df.selectExpr("xxhash64(word) AS hash", "word", "1L AS weight")
    counts = dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True))
    holders, counters = top_words.sketch_of(weighted)
    rows = holders.collect()
    assert len(rows) <= top_words.BUCKETS and counters.count() <= 2 * top_words.CELLS
    assert all(x["held"] <= counts[int(x["word"][1:])] <= x["at_most"] for x in rows)
    # every occurrence is in one of the buckets or in a cell of each row of counters
    held = sum(x["held"] for x in rows)
    for row in (0, 1):
        assert held + counters.where(f"kind = {row}").agg({"weight": "sum"}).first()[0] == len(ids)
    for least in (3, 6, 1500):
        assert dict(tuples(top_words.sums_from(weighted, holders, counters, least))) == {f"w{i}": c for i, c in counts.items() if c >= least}


def test_a_newcomer_takes_the_bucket_by_votes():
    s = top_words.Sketch()
    h, other = np.array([5]), np.array([5 + top_words.BUCKETS])
    s.add(h, np.array(["a"], object), np.array([2]))
    for _ in range(top_words.VOTES * 2 - 1):
        s.add(other, np.array(["b"], object), np.array([1]))
    assert s.word[5] == "a"
    s.add(other, np.array(["b"], object), np.array([1]))
    assert s.word[5] == "b" and s.held[5] == 1 and s.counters[0].sum() == 2 + top_words.VOTES * 2 - 1
