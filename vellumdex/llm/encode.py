"""Token ids of whole texts by a public byte-level BPE vocabulary: propose greedily, verify pairs, merge what fails.

A text is cut into words by the vocabulary's pattern. For each new word the longest vocabulary entry is taken
again and again from the left (one automaton run over all new words). A token sequence is what merging would
give exactly if each adjacent pair of tokens is, so all pairs are tested at once in numpy; only words with a
failing pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: how this vocabulary parts a text into words.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Words remembered by a worker, and the longest of them in characters.
CACHED_WORDS, CACHED_CHARS = 400_000, 64
#: Characters worked on at a time.
PART_CHARS = 4 << 20
NEVER = np.int64(1) << 40
#: Stands between words in the automaton's input; bytes are the characters below it.
GAP = "Ā"


def byte_letters() -> dict[str, int]:
    """The characters by which the vocabulary file writes bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Of a vocabulary file with `vocab` and `merges`, given as bytes."""

    def __init__(self, file: bytes):
        import ahocorasick

        model = json.loads(file)["model"]
        letter = byte_letters()
        spelled = {t: bytes(letter[c] for c in t) for t in model["vocab"] if all(c in letter for c in t)}
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        n = 1 + max(vocab.values())
        self.byte_id = [0] * 256
        for t, b in spelled.items():
            if len(b) == 1:
                self.byte_id[b[0]] = vocab[t]
        # a merge comes before another if its place in the list does
        self.left, self.right, self.place = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merged[x, y] = k, z
            if self.place[z] < 0:
                self.left[z], self.right[z], self.place[z] = x, y, k
        keys = np.array([x * n + y for x, y in self.merged], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_place, self.n = keys[order], np.array([k for k, _ in self.merged.values()], np.int64)[order], n
        # entries that no merge makes can't come out, so they aren't proposed
        made = {t for t, b in spelled.items() if len(b) == 1 or self.place[vocab[t]] >= 0}
        self.length = np.zeros(n, np.int64)
        self.automaton = ahocorasick.Automaton()
        for t in made:
            self.automaton.add_word(spelled[t].decode("latin-1"), vocab[t])
            self.length[vocab[t]] = len(spelled[t])
        self.automaton.make_automaton()
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.exact_words = self.new_words = 0

    def place_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the merge of each pair, NEVER where there is none."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_place[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b side by side leaves just a and b.

        Over time the border has on its left a, before that a's right part, its right part and so on; on its
        right b, b's left part and so on. A part lasts until the merge that used it up. The pair fails if some
        two parts that met there had an earlier merge than the ends of both. Of merges of the same kind the
        left one comes first, hence a part of b also loses to a merge as early as its own.
        """
        good = np.ones(len(a), bool)
        x, x_end = a.copy(), np.full(len(a), NEVER)
        rows = np.arange(len(a))
        while len(rows):
            y, y_end, inner, u, u_end = b[rows].copy(), np.full(len(rows), NEVER), rows, x[rows], x_end[rows]
            while len(inner):
                place = self.place_of(u, y)
                fails = (place < u_end) & (place <= y_end) & (place < NEVER)
                good[inner[fails]] = False
                go = ~fails & (self.left[y] >= 0)
                inner, u, u_end, y, y_end = inner[go], u[go], u_end[go], self.left[y[go]], self.place[y[go]]
            rows = rows[good[rows] & (self.right[x[rows]] >= 0)]
            x_end[rows], x[rows] = self.place[x[rows]], self.right[x[rows]]
        return good

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge the earliest pair, the left one of equals, until none is left; n log n steps."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        merged = self.merged
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merged.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            m = after[k]
            if ids[k] != a or m < 0 or ids[m] != b:
                continue
            ids[k], ids[m] = made, -1
            after[k] = after[m]
            if after[k] >= 0:
                before[after[k]] = k
                if found := merged.get((made, ids[after[k]])):
                    heapq.heappush(heap, (found[0], k, made, ids[after[k]], found[1]))
            if before[k] >= 0 and (found := merged.get((ids[before[k]], made))):
                heapq.heappush(heap, (found[0], before[k], ids[before[k]], made, found[1]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of some distinct words."""
        raw = [w.encode("utf-8", "replace") for w in words]
        proposed = np.fromiter((i for _, i in self.automaton.iter_long(GAP.join(b.decode("latin-1") for b in raw))), np.int64)
        ends = np.cumsum([len(b) for b in raw])
        reached = np.cumsum(self.length[proposed])
        owner = np.searchsorted(ends, reached, "left")
        whole = len(reached) and reached[-1] == ends[-1] and np.isin(ends, reached).all()
        if not whole:  # the proposal doesn't tile the words
            self.exact_words += len(raw)
            return [self.merge_exactly(b) for b in raw]
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, where = np.unique(proposed[inside] * self.n + proposed[inside + 1], return_inverse=True)
        good = np.fromiter((self.pairs.get(k, 2) for k in keys.tolist()), np.int8, len(keys))
        new = np.flatnonzero(good == 2)
        good[new] = self.compatible(keys[new] // self.n, keys[new] % self.n)
        if len(self.pairs) > 1 << 20:
            self.pairs.clear()
        self.pairs.update(zip(keys[new].tolist(), good[new].tolist(), strict=True))
        failing = set(owner[inside[good[where] == 0]].tolist())
        bounds = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
        flat = proposed.tolist()
        self.new_words += len(raw)
        self.exact_words += len(failing)
        return [self.merge_exactly(raw[k]) if k in failing else flat[bounds[k] : bounds[k + 1]] for k in range(len(raw))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """All ids of some texts one after another, and how many each text has."""
        parted = [WORDS.findall(t) for t in texts]
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = [w for w in dict.fromkeys(w for words in parted for w in words) if w not in known]
        if new:
            known.update(zip(new, self.encode_words(new), strict=True))
        flat: list[int] = []
        counts = []
        for words in parted:
            before = len(flat)
            for w in words:
                flat += known[w]
            counts.append(len(flat) - before)
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return np.array(flat, np.int32), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(file: bytes) -> Encoder:
    """The encoder of a vocabulary, made once a worker."""
    name = hashlib.sha256(file).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(file)
    return _ENCODERS[name]


def in_parts(texts: list[str], most: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about `most` characters; a longer text is a part of its own."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column of UTF-8 bytes; null is empty, bytes that are no UTF-8 become U+FFFD."""
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()]


def _encoded(file, counts_only: bool):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(file.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in in_parts(texts):
                flat, counts = encoder.encode(texts[a:b])
                keys = batch.column(0).slice(a, b - a)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])
                else:
                    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    return encoded


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("binary").alias("text"))


def token_ids(documents: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids): each text's token ids without special tokens; null and empty texts have an empty list.

    Every row of `documents` gives one row, a repeated doc_id or a null one as well. The string of a special
    token in a text is ordinary text. No shuffle; the vocabulary file is read on the driver and broadcast (1.6
    MB, whatever the input).
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    file = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    return _rows(documents).mapInArrow(_encoded(file, False), f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens): the length of each row's `ids` in `token_ids`."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    file = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    return _rows(documents).mapInArrow(_encoded(file, True), f"doc_id {kind}, n_tokens bigint")
