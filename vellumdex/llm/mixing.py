"""Mix of sources with target shares of the tokens, no document repeated more often than its source allows.

Each document belongs to domains, the wanted sources and one for all others, with probabilities: certainly to
its own source where that is delivered, otherwise as a classifier trained on labelled documents says. A rate
for each document, between 0 and the most repeats, is fitted by projected gradient descent such that the
expected tokens of each domain meet its target; rates then become whole numbers of copies. A source all of whose
documents the fit leaves at their most repeats, short of its target, can't reach its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumdex.llm.encode import BYTE_BPE, encoder_for, in_parts, texts_of
from vellumdex.llm.labelled import fitted_once, labelled_sample
from vellumdex.llm.language import Classifier, pieces, softmax, train
from vellumdex.llm.language_text import paragraphs_of, words_of
from vellumdex.session import written

#: Bounds of the classifier's training: documents of each domain, characters of one.
TRAINING_DOCUMENTS, TRAINING_CHARS = 60, 20_000
#: Texts that training sees at least, the same ones again if there are fewer.
TRAINING_TEXTS = 20_000
MOST_SOURCES = 1000
#: The fit ends when no domain's expected tokens move by more than this part of the mix's size, or after so many steps;
#: the report says how many it took and by what part the last one moved.
TOLERANCE, MOST_STEPS = 1e-6, 2000
#: Rates are written every so many steps, so that no job goes through more of them.
STORED_EVERY = 16
#: Documents of a source are cut at one of so many places when rates become whole numbers.
CUTS = 1 << 14
#: A document may belong to the domains that are at least this part as probable as its most probable one.
LEAST_PART = 0.1

GROUPS = "membership array<double>, most double, tokens double, rate double"
REPORT = """source string, target_share double, max_repeats int, documents bigint, tokens bigint, total bigint, size bigint, rate double, mix_tokens bigint,
    expected_tokens double, total_share double, mix_share double, reachable boolean, steps int, residual double"""


def plain_source() -> Column:
    """Lower case, without blanks at the ends; an empty one is missing."""
    plain = F.lower(F.trim("source"))
    return F.when(plain != "", plain)


@dataclass
class Targets:
    sources: list[str]
    shares: np.ndarray
    repeats: np.ndarray


def targets_of(mix_targets: DataFrame) -> Targets:
    """The wanted sources in order. Null shares and repeats are 0 and 1; of repeated sources the largest values count."""
    rows = mix_targets.select(plain_source().alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    rows = rows.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources wanted")
    return Targets([r["source"] for r in rows], np.array([max(0.0, r["share"] or 0.0) for r in rows]), np.array([max(0, 1 if r["repeats"] is None else r["repeats"]) for r in rows]))


def fit_domains(documents: DataFrame, sources: list[str]) -> tuple[Classifier | None, np.ndarray]:
    """Classifier of domains (the sources, then all others) and how many labelled documents each has."""
    domain = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(sources) for x in (s, k))), F.col("plain")), F.lit(len(sources))) if sources else F.lit(0)
    labelled = documents.select("doc_id", "text", plain_source().alias("plain")).where("plain IS NOT NULL").withColumn("domain", domain)
    counts = np.zeros(len(sources) + 1)
    for r in labelled.groupBy("domain").count().collect():
        counts[r["domain"]] = r["count"]
    texts, labels = [], []
    for label, text in labelled_sample(labelled.withColumnRenamed("domain", "label"), TRAINING_DOCUMENTS, TRAINING_CHARS):
        for part in pieces([w for p in paragraphs_of(text) for w in words_of(p)], 40):
            texts.append(part)
            labels.append(label)
    if len(set(labels)) < 2:
        return None, counts
    # so many rounds that a small sample is learnt as well
    classes, rounds = [*sources, ""], int(np.clip(TRAINING_TEXTS // len(texts), 3, 60))
    sample = [tuple(classes), *((label, *words) for label, words in zip(labels, texts, strict=True))]
    return fitted_once("domains", sample, lambda: train(texts, np.array(labels), classes, epochs=rounds)), counts


def memberships(model: Classifier | None, prior: np.ndarray, texts: list[str]) -> np.ndarray:
    """Probabilities of the domains; a text without words, or no model, has the prior. A domain of prior 0 has 0."""
    out = np.tile(prior, (len(texts), 1))
    words = [[w for p in paragraphs_of(t) for w in words_of(p)] for t in texts]
    full = [k for k, w in enumerate(words) if w]
    if model and full:
        with np.errstate(divide="ignore"):
            out[full] = softmax(model.log_odds([words[k] for k in full]) + np.log(prior))
    return out


def _measured(file, shared):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(file.value)
        model, prior = shared.value
        for batch in batches:
            texts, known = texts_of(batch.column("text")), batch.column("source").is_valid().to_pylist()
            for a, b in in_parts(texts):
                _, counts = encoder.encode(texts[a:b])
                soft = [k for k in range(a, b) if not known[k]]
                of = dict(zip(soft, memberships(model, prior, [texts[k] for k in soft]).tolist(), strict=True)) if soft else {}
                columns = [
                    batch.column("doc_id").slice(a, b - a),
                    batch.column("source").slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.array([of.get(k) for k in range(a, b)], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "n_tokens", "membership"])

    return measured


def measured_documents(documents: DataFrame, targets: Targets, vocabulary: str) -> DataFrame:
    """(doc_id, source, n_tokens, membership) in the shared folder; membership is null where the source is known."""
    context = documents.sparkSession.sparkContext
    model, counts = fit_domains(documents, targets.sources)
    # a source without documents can't be guessed from any; without labelled documents all are of other domains
    prior = counts / counts.sum() if counts.any() else np.eye(len(counts))[-1]
    file, shared = context.broadcast(Path(vocabulary).read_bytes()), context.broadcast((model, prior))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"), plain_source().alias("source"))
    return written(rows.mapInArrow(_measured(file, shared), f"doc_id {kind}, source string, n_tokens bigint, membership array<double>"), "measured")


def replay(steps: np.ndarray, membership: np.ndarray, most: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Rates after some steps: each adds its domains' pull and keeps to the bounds."""
    for pull in steps:
        rate = np.clip(rate + membership @ pull, 0, most)
    return rate


@dataclass
class Fit:
    """Steps of a descent, the expected tokens of each domain they lead to, and the part of the size the last step moved."""

    steps: np.ndarray
    expected: np.ndarray
    residual: float


def descend(expected: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, scale: float, most_steps: int = MOST_STEPS) -> Fit:
    """Least squares by projected gradient descent, `expected` giving the expected tokens of each domain after some steps.

    Minimised is the sum over domains of (expected - wanted)^2 / size, size being the domain's expected tokens at
    rate 1. In the metric of the documents' tokens the gradient has a Lipschitz constant of at most 1, so steps of
    length 1 converge, and projection is clipping.
    """
    k = len(wanted)
    # rate 1 for all, whatever their most repeats: one step of pull 1 in each domain, as memberships sum to 1
    size = expected(None)
    steps, now, residual = np.zeros((0, k)), np.zeros(k), 0.0
    while len(steps) < most_steps:
        pull = np.divide(wanted - now, size, out=np.zeros(k), where=size > 0)
        steps = np.vstack([steps, pull])
        before, now = now, expected(steps)
        residual = float(np.abs(now - before).max() / max(1.0, scale)) if k else 0.0
        if residual <= TOLERANCE:
            break
    return Fit(steps, now, residual)


def of_arrays(membership: np.ndarray, most: np.ndarray, tokens: np.ndarray) -> Callable[[np.ndarray | None], np.ndarray]:
    """What `descend` asks, for a few groups of documents on the driver."""

    def expected(steps: np.ndarray | None) -> np.ndarray:
        return ((np.ones(len(most)) if steps is None else replay(steps, membership, most, np.zeros(len(most)))) * tokens) @ membership

    return expected


def of_table(groups: DataFrame, k: int) -> Callable[[np.ndarray | None], np.ndarray]:
    """What `descend` asks, for a table of GROUPS: a job sums each step over all rows.

    The driver holds one number a domain and step. Every STORED_EVERY steps the rates so far are written.
    """
    state = {"groups": groups, "done": 0}

    def expected(steps: np.ndarray | None) -> np.ndarray:
        if steps is not None and len(steps) - state["done"] > STORED_EVERY:
            passed = steps[state["done"] : -1]
            state["groups"] = written(state["groups"].mapInArrow(_advanced(passed), GROUPS), "rates")
            state["done"] += len(passed)
        new = None if steps is None else steps[state["done"] :]
        rows = state["groups"].mapInArrow(_totals(new, k), "domain int, tokens double").groupBy("domain").agg(F.sum("tokens").alias("tokens")).collect()
        sums = np.zeros(k)
        for r in rows:
            sums[r["domain"]] = r["tokens"]
        return sums

    return expected


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    n = batch.num_rows
    return [batch.column("membership").flatten().to_numpy().reshape(n, -1), *(batch.column(c).to_numpy() for c in ("most", "tokens", "rate"))]


def _advanced(steps: np.ndarray):
    def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                membership, most, _, rate = _columns(batch)
                yield batch.set_column(3, "rate", pa.array(replay(steps, membership, most, rate)))

    return advanced


def _totals(steps: np.ndarray | None, k: int):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                membership, most, tokens, rate = _columns(batch)
                sums += ((np.ones(len(most)) if steps is None else replay(steps, membership, most, rate)) * tokens) @ membership
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(sums)], names=["domain", "tokens"])

    return totals


def at_place() -> Column:
    """Place of a document among CUTS, by a hash of its id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(CUTS)).cast("int")


def mix(
    documents: DataFrame, mix_targets: DataFrame, vocabulary: str = BYTE_BPE, own_first: bool = False, size: int | None = None, meet_shares: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies), and the report of the shares reached (see REPORT).

    The mix's size is the number of tokens of all rows of `documents`, or `size`. With `meet_shares` it is at most
    what lets every wanted source that has documents meet its share. Sources are compared in lower case without
    blanks at the ends; documents of unwanted ones aren't taken. Documents without a source count by their probable
    domains in expected_tokens, with the fewest repeats of the domains they may belong to. copies is 0 for
    documents left out, so the mix has a row for each document of a wanted or missing source.

    In the report, mix_tokens are those of the labelled documents taken, total_share their part of the mix's
    intended size, mix_share their part of all tokens in the mix, which is smaller where sources fall short;
    reachable is false for sources that the fit leaves short with all their documents at max_repeats, if indeed
    tokens * max_repeats < target_share * size. A wanted source without documents has 0 tokens; with no tokens at
    all every target is 0 and reachable. Where the mix has copies of documents without a source, the report has a
    row of source null for them, without target, repeats and reachable; its expected_tokens stand in those of the
    sources as well. mix_share sums to 1 over all rows. steps and residual are those of the fit (see `Fit`); it has
    converged if residual is at most TOLERANCE.

    With `own_first`, a source's own documents meet its target by themselves where they can. Documents without a
    source are then taken only where the most probable of their domains is a source that falls short; else
    labelled documents give way to those that are probably of the same source.

    The tokens of all texts are counted once; the fit needs a few small jobs; copies need no shuffle.
    """
    spark = documents.sparkSession
    targets = targets_of(mix_targets)
    k = len(targets.sources) + 1
    measured = measured_documents(documents, targets, vocabulary)
    wanted_source = F.when(F.col("source").isin(targets.sources), F.col("source")) if targets.sources else F.lit(None).cast("string")
    sums = measured.groupBy(wanted_source.alias("source"), F.col("source").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).collect()
    held = {r["source"]: (r["documents"], r["tokens"]) for r in sums if r["source"] is not None}
    total = sum(r["tokens"] for r in sums)
    repeats = targets.repeats.astype(float)
    own = np.array([float(held.get(s, (0, 0))[1]) for s in targets.sources])
    goal = total if size is None else size
    if meet_shares:
        goal = min([goal, *(int(n * r / share) for n, r, share in zip(own, repeats, targets.shares, strict=True) if n and share)])
    wanted = np.append(targets.shares * goal, 0.0)

    # all documents of a source are alike in the fit and stand together: one row each
    alone = descend(of_arrays(np.eye(k)[:-1], repeats, own), wanted, goal)
    own_rates = replay(alone.steps, np.eye(k)[:-1], repeats, np.zeros(k - 1))
    short = ((own == 0) | (own_rates >= repeats * (1 - 1e-9))) & (alone.expected[:-1] <= wanted[:-1] * (1 + 1e-9))
    short &= np.array([held.get(s, (0, 0))[1] * int(r) < share * goal for s, r, share in zip(targets.sources, targets.repeats, targets.shares, strict=True)], bool)

    most = _most_of(repeats, short if own_first else None).alias("most")
    soft = measured.where("source IS NULL").select("membership", most, F.col("n_tokens").cast("double").alias("tokens"), F.lit(0.0).alias("rate"))
    if own_first:
        fit = descend(of_table(written(soft, "groups"), k), wanted - alone.expected, goal)
        expected = alone.expected + fit.expected
    else:
        labelled = [(np.eye(k)[i].tolist(), float(repeats[i]), own[i].item(), 0.0) for i, s in enumerate(targets.sources) if s in held]
        fit = descend(of_table(written(spark.createDataFrame(labelled, GROUPS).unionByName(soft), "groups"), k), wanted, goal)
        expected = fit.expected
        own_rates = replay(fit.steps, np.eye(k)[:-1], repeats, np.zeros(k - 1))

    # whole copies: all documents of a source have one rate; those before a cut get one copy more than the others
    rates = {s: float(own_rates[i]) for i, s in enumerate(targets.sources) if s in held}
    known = measured.where(F.col("source").isin(list(held))) if held else measured.limit(0)
    cuts = _cuts(known, rates, {x: held[x][1] for x in rates})
    rate_rows = [(s, int(np.floor(rates[s])), cuts[s][0]) for s in rates]
    table = F.broadcast(spark.createDataFrame(rate_rows, "source string, whole int, cut int"))
    certain = known.join(table, "source").select("doc_id", "source", "n_tokens", (F.col("whole") + (at_place() < F.col("cut")).cast("int")).alias("copies"))
    unsure = measured.where("source IS NULL").withColumn("most", most)
    kind = unsure.schema["doc_id"].dataType.simpleString()
    copied = unsure.select("doc_id", "n_tokens", "membership", "most", (at_place() / F.lit(float(CUTS))).alias("u")).mapInArrow(_copies(fit.steps, k), f"doc_id {kind}, source string, n_tokens bigint, copies int")
    taken = certain.unionByName(copied)

    guessed = copied.agg(F.count(F.lit(1)), F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies"))).first()
    n_guessed, guessed_tokens, guessed_taken = (x or 0 for x in guessed)
    mix_total = sum(t for _, t in cuts.values()) + guessed_taken
    taken_steps = max(len(fit.steps), len(alone.steps)), max(fit.residual, alone.residual)
    rows = []
    for i, s in enumerate(targets.sources):
        n, tokens = held.get(s, (0, 0))
        got = cuts[s][1] if s in cuts else 0
        shares = got / goal if goal else 0.0, got / mix_total if mix_total else 0.0
        rows.append((s, float(targets.shares[i]), int(targets.repeats[i]), n, tokens, total, goal, rates.get(s, 0.0), got, float(expected[i]), *shares, not short[i], *taken_steps))
    if guessed_taken:
        of_guessed = float(expected.sum() - sum(rates[s] * held[s][1] for s in rates))
        shares = guessed_taken / goal, guessed_taken / mix_total
        rows.append((None, None, None, n_guessed, guessed_tokens, total, goal, of_guessed / guessed_tokens, guessed_taken, of_guessed, *shares, None, *taken_steps))
    return taken, spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], REPORT)


def _most_of(repeats: np.ndarray, short: np.ndarray | None = None) -> Column:
    """Most repeats of a document by its membership: the fewest of the wanted domains it may belong to, 0 if of none.

    With `short`, 0 as well where the most probable domain isn't a wanted one that falls short.
    """
    listed = F.array(*(F.lit(float(r)) for r in repeats)) if len(repeats) else F.array().cast("array<double>")
    of_wanted = F.arrays_zip(F.slice("membership", 1, max(1, len(repeats))).alias("p"), listed.alias("r"))
    may = F.transform(of_wanted, lambda x: F.when(x["p"] >= LEAST_PART * F.array_max("membership"), x["r"]))
    most = F.coalesce(F.array_min(may), F.lit(0.0)).cast("double")
    if short is None:
        return most
    likely = F.array_position("membership", F.array_max("membership"))
    places = [i + 1 for i in np.flatnonzero(short).tolist()]
    return F.when(likely.isin(places) if places else F.lit(False), most).otherwise(0.0)


def _cuts(known: DataFrame, rates: dict[str, float], tokens: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Of each source the place before which documents get one copy more, and the tokens that makes in all.

    It is the place where they are closest to rate * tokens. Sums run over at most CUTS rows a source, and one
    row a source comes back.
    """
    if not rates:
        return {}
    extra = {s: (rate - np.floor(rate)) * tokens[s] for s, rate in rates.items()}
    wanted = F.broadcast(known.sparkSession.createDataFrame([(s, float(x)) for s, x in extra.items()], "source string, extra double"))
    by_place = known.groupBy("source", at_place().alias("place")).agg(F.sum("n_tokens").alias("n")).join(wanted, "source")
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("place"))
    off = by_place.select("source", "place", so_far.alias("sum"), "extra").select("source", F.struct(F.abs(F.col("sum") - F.col("extra")).alias("off"), (F.col("place") + 1).alias("cut"), "sum").alias("at"))
    cuts = {s: (0, int(np.floor(rate) * tokens[s])) for s, rate in rates.items()}
    for r in off.groupBy("source").agg(F.min("at").alias("at")).collect():
        s, at = r["source"], r["at"]
        if at["off"] < extra[s]:
            cuts[s] = at["cut"], cuts[s][1] + at["sum"]
    return cuts


def _copies(steps: np.ndarray, k: int):
    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            membership = batch.column("membership").flatten().to_numpy().reshape(batch.num_rows, k)
            rate = replay(steps, membership, batch.column("most").to_numpy(), np.zeros(batch.num_rows))
            n = np.floor(rate) + (batch.column("u").to_numpy() < rate - np.floor(rate))
            columns = [batch.column("doc_id"), pa.nulls(len(n), pa.string()), batch.column("n_tokens"), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "n_tokens", "copies"])

    return copies


def short_sources(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(source): wanted sources of the mix that fall short of their share even with all documents at max_repeats.

    The fit leaves them short with every document at its bound; of these, those with tokens * max_repeats <
    target_share * total, exactly. Documents without a source, which may add to a source's expected tokens, don't
    count here.
    """
    return mix(documents, mix_targets, vocabulary, own_first=True)[1].where(~F.col("reachable")).select("source")
