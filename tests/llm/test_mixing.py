import os

import numpy as np
import pytest
from helpers import with_clashes

from vellumdex.llm import encode, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(encode.BYTE_BPE), reason="no vocabulary files here")

TARGETS = "source string, target_share double, max_repeats int"
COOKS, SAILORS = "simmer the onion soup and stir the butter sauce", "hoist the sail and steer the harbour ship north"


def documents(spark):
    rows = []
    for k in range(300):
        rows.append((k, f"{COOKS} number {k}", [" Cooking ", "COOKING", "cooking"][k % 3]))
    for k in range(300, 380):
        rows.append((k, f"{SAILORS} number {k}", "sailing"))
    rows += [(k, f"other things {k} of no interest", "unwanted") for k in range(380, 400)]
    rows += [(400 + k, t, None) for k, t in enumerate([SAILORS] * 10 + [COOKS] * 10 + [None, "", "   "])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mix(spark):
    docs = with_clashes(documents(spark))
    targets = with_clashes(spark.createDataFrame([("cooking", 0.3, 2), ("sailing", 0.4, 4), ("poems", 0.1, 3), ("gardens", 0.0, 1)], TARGETS))
    taken, report = mixing.mix(docs, targets)
    rows = {r["source"]: r for r in report.collect()}
    total = encode.token_counts(docs).agg({"n_tokens": "sum"}).first()[0]
    assert {r["total"] for r in rows.values()} == {total}
    mixed = taken.collect()
    assert sorted(r["doc_id"] for r in mixed) == [k for k in range(423) if not 380 <= k < 400]
    most = {"cooking": 2, "sailing": 4, None: 2}
    assert all(0 <= r["copies"] <= most[r["source"]] for r in mixed)
    for s in ("cooking", "sailing"):
        assert sum(r["n_tokens"] * r["copies"] for r in mixed if r["source"] == s) == rows[s]["mix_tokens"]
        assert rows[s]["reachable"] and abs(rows[s]["expected_tokens"] / total - rows[s]["target_share"]) < 1e-3
    of_cooks = {r["copies"] for r in mixed if 410 <= r["doc_id"] < 420}
    assert sum(r["copies"] for r in mixed if 400 <= r["doc_id"] < 410) > 10 and of_cooks <= {0, 1}  # guessed from their words
    assert rows["poems"]["tokens"] == 0 and not rows["poems"]["reachable"] and rows["gardens"]["reachable"]
    assert {r["source"] for r in mixing.short_sources(docs, targets).collect()} == {"poems"}


def test_a_source_that_falls_short_is_taken_whole(spark):
    targets = spark.createDataFrame([("sailing", 0.9, 2), (" Cooking", 0.1, 1)], TARGETS)
    taken, report = mixing.mix(documents(spark), targets)
    rows = {r["source"]: r for r in report.collect()}
    assert not rows["sailing"]["reachable"] and rows["sailing"]["mix_tokens"] == 2 * rows["sailing"]["tokens"] and rows["cooking"]["reachable"]
    assert {r["copies"] for r in taken.where("source = 'sailing'").collect()} == {2}


def test_dirty_targets_and_nothing(spark):
    docs = documents(spark)
    dirty = spark.createDataFrame([(None, 0.5, 1), ("cooking", None, None), ("Cooking ", 0.2, 0), ("", 0.1, 1)], TARGETS)
    assert {r["source"]: (r["target_share"], r["max_repeats"], r["reachable"]) for r in mixing.mix(docs, dirty)[1].collect()} == {"cooking": (0.2, 0, False)}
    targets = spark.createDataFrame([("cooking", 0.3, 2)], TARGETS)
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0)), (docs.where("source IS NULL"), targets)):
        taken, report = mixing.mix(d, t)
        taken.collect(), report.collect()
    assert [r["source"] for r in mixing.short_sources(docs.where("source IS NULL"), targets).collect()] == ["cooking"]


@pytest.mark.parametrize("stored_every", [16, 2])
def test_rates_solve_the_bounded_problem(spark, monkeypatch, stored_every):
    """Against plain projected descent on the same problem, run far longer with all documents in one array."""
    monkeypatch.setattr(mixing, "STORED_EVERY", stored_every)
    r = np.random.default_rng(3)
    membership = r.dirichlet(np.ones(4), 200)
    membership[:150] = np.eye(4)[r.integers(0, 3, 150)]
    tokens, most = r.integers(1, 500, 200).astype(float), r.integers(0, 4, 200).astype(float)
    wanted = np.array([0.5, 0.2, 1.5, 0.0]) * tokens.sum() / 3
    rows = [(m.tolist(), float(c), float(t), 0.0) for m, c, t in zip(membership, most, tokens, strict=True)]
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-4)
    fit = mixing.descend(mixing.of_table(spark.createDataFrame(rows, mixing.GROUPS).repartition(3), 4), wanted, wanted.sum())
    same = mixing.descend(mixing.of_arrays(membership, most, tokens), wanted, wanted.sum())
    assert fit.steps == pytest.approx(same.steps) and fit.expected == pytest.approx(same.expected) and fit.residual <= 1e-4
    monkeypatch.undo()
    long = mixing.descend(mixing.of_arrays(membership, most, tokens), wanted, wanted.sum())
    size, rate = tokens @ membership, np.zeros(200)
    for _ in range(20_000):
        rate = np.clip(rate + membership @ ((wanted - (rate * tokens) @ membership) / size), 0, most)
    best = (rate * tokens) @ membership
    loss = lambda e: (((e - wanted) ** 2) / size).sum()
    assert long.residual <= mixing.TOLERANCE and loss(long.expected) <= loss(best) * 1.001 + 1e-6
    few = mixing.descend(mixing.of_arrays(membership, most, tokens), wanted, wanted.sum(), 2)
    assert len(few.steps) == 2 and few.residual > mixing.TOLERANCE


def test_the_fit_of_labelled_documents_tells_short_sources():
    own, repeats, wanted = np.array([100.0, 0.0, 40.0, 50.0, 30.0]), np.array([2.0, 3.0, 1.0, 0.0, 2.0]), np.array([150.0, 10.0, 60.0, 5.0, 60.0, 0.0])
    fit = mixing.descend(mixing.of_arrays(np.eye(6)[:-1], repeats, own), wanted, 345)
    rates = mixing.replay(fit.steps, np.eye(6)[:-1], repeats, np.zeros(5))
    assert rates == pytest.approx([1.5, 0, 1, 0, 2]) and fit.expected == pytest.approx([150, 0, 40, 0, 60, 0])


def test_cuts_are_as_near_as_can_be(spark):
    r = np.random.default_rng(5)
    rows = [(s, d, int(t)) for s in ("a", "b", "c", "d") for d, t in enumerate(r.integers(0, 50, 2000))]
    df = spark.createDataFrame(rows, "source string, doc_id bigint, n_tokens bigint")
    tokens = {s: sum(t for x, _, t in rows if x == s) for s in "abcd"}
    rates = {"a": 0.0, "b": 0.3, "c": 1.0, "d": 2.71}
    cuts = mixing._cuts(df, rates, tokens)
    places = df.select("source", "n_tokens", mixing.at_place().alias("place")).collect()
    for s, rate in rates.items():
        cut, got = cuts[s]
        assert got == sum(x["n_tokens"] * (int(rate) + (x["place"] < cut)) for x in places if x["source"] == s)
        assert abs(got - rate * tokens[s]) <= 100
    assert cuts["a"] == (0, 0) and cuts["c"] == (0, tokens["c"]) and mixing._cuts(df, {}, {}) == {}


@pytest.mark.parametrize("own_first", [False, True])
def test_copies_without_a_source_are_reported(spark, own_first):
    """A third of the rows has no source; sailing falls short, cooking doesn't."""
    rows = [(k, f"{COOKS} number {k}", "cooking") for k in range(180)] + [(k, f"{SAILORS} number {k}", "sailing") for k in range(180, 200)]
    rows += [(k, f"{COOKS} number {k}" if k % 2 else f"{SAILORS} number {k}", None) for k in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("cooking", 0.4, 2), ("sailing", 0.6, 2)], TARGETS)
    taken, report = mixing.mix(docs, targets, own_first=own_first)
    found, mixed = {r["source"]: r for r in report.collect()}, taken.collect()
    whole = sum(r["n_tokens"] * r["copies"] for r in mixed)
    assert set(found) == {"cooking", "sailing", None}
    for s, r in found.items():
        assert r["mix_tokens"] == sum(x["n_tokens"] * x["copies"] for x in mixed if x["source"] == s)
        assert r["mix_share"] == pytest.approx(r["mix_tokens"] / whole) and r["total_share"] == pytest.approx(r["mix_tokens"] / r["total"])
    assert sum(r["mix_share"] for r in found.values()) == pytest.approx(1)
    assert found[None]["documents"] == 100 and found[None]["reachable"] is None and not found["sailing"]["reachable"]
    copies = {r["doc_id"]: r["copies"] for r in mixed}
    assert all(copies[k] == 2 for k in range(200, 300, 2))
    if own_first:
        assert found["cooking"]["total_share"] == pytest.approx(0.4, abs=0.005)
        assert not any(copies[k] for k in range(201, 300, 2))


def test_size_of_the_mix(spark):
    targets = spark.createDataFrame([("cooking", 0.3, 2), ("sailing", 0.7, 2), ("poems", 0.1, 3)], TARGETS)
    docs = documents(spark)
    for own_first in (False, True):
        rows = {r["source"]: r for r in mixing.mix(docs, targets, own_first=own_first, size=500)[1].collect()}
        assert {r["size"] for r in rows.values()} == {500} and rows["cooking"]["reachable"] and rows["cooking"]["expected_tokens"] == pytest.approx(150, abs=1)
        assert {r["residual"] <= mixing.TOLERANCE for r in rows.values()} == {True}
    met = {r["source"]: r for r in mixing.mix(docs, targets, own_first=True, meet_shares=True)[1].collect()}
    assert not mixing.mix(docs, targets, own_first=True)[1].where("source = 'sailing'").first()["reachable"]
    assert met["sailing"]["size"] < met["sailing"]["total"] and met["sailing"]["total_share"] == pytest.approx(0.7, abs=0.001)
    assert met["cooking"]["total_share"] == pytest.approx(0.3, abs=0.02) and not met["poems"]["reachable"]


def test_flat_probabilities_leave_no_document_out(spark):
    flat = spark.createDataFrame([([1 / 41] * 41,), ([0.9] + [0.0025] * 40,), ([0.0] * 40 + [1.0],)], "membership array<double>")
    assert [r[0] for r in flat.select(mixing._most_of(np.arange(2.0, 42.0))).collect()] == [2.0, 2.0, 0.0]
