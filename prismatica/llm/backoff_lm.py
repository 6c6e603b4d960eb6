"""Scores under a smoothed bigram model, run as a weighted backoff automaton.

The states are the empty history, the start of a text and every training word. An arc of a
state is a bigram seen in training; its weight is log10 of

    P(w | h) = (c(h w) + strength * P(w)) / (c(h) + strength),   P(w) = (c(w) + 1) / (N + V + 1).

A word without an arc takes the failure arc to the empty history at log10 of
strength / (c(h) + strength). A text is scored in one left-to-right traversal that carries
the state. The counts of the whole corpus stay spread over buckets by n-gram hash: each
block of documents asks for the n-grams that it holds and builds its part of the automaton.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismatica.llm.common import WordHashes, dealt, mixed, shares, ship, whole_text, words_of

ship(sys.modules[__name__])

END, START = b" ", b"\t"  # no word holds white space
PAIR = np.uint64(0x9E3779B97F4A7C15)
DISTINCT = 1_000_000


def _packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and place and count of those over 254."""
    large = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack([large, counts[large]]).astype(np.int64).tobytes()


def _unpacked(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    at, counts = np.frombuffer(large, np.int64).reshape(2, -1)
    out[at] = counts
    return out


class _Block:
    """The texts of a block as word numbers, and its n-grams sorted by bucket and hash."""

    def __init__(self, texts: pa.ChunkedArray, buckets: int):
        words = [words_of(t.as_py()) for t in texts]
        numbers: dict[bytes, int] = {END: 0, START: 1}
        flat = [numbers.setdefault(w, len(numbers)) for ws in words for w in (*ws, END)]
        self.word = np.array(flat, np.int64)
        self.ends = np.cumsum([len(ws) + 1 for ws in words]).astype(np.int64)
        self.starts = np.append(0, self.ends[:-1]) if len(words) else np.empty(0, np.int64)
        self.vocabulary = len(numbers)
        hashes = WordHashes()
        single = hashes.all(list(numbers))
        state = np.empty(len(self.word), np.int64)
        state[1:] = self.word[:-1]
        state[self.starts] = 1
        self.pair, self.pair_of = np.unique(state * self.vocabulary + self.word, return_inverse=True)
        h, w = np.divmod(self.pair, self.vocabulary)
        key = np.concatenate([single, mixed(single[h] * PAIR + single[w])])
        bucket = (key >> np.uint64(20)).astype(np.int64) % buckets
        self.order = np.lexsort((key, bucket))
        self.key, self.bucket = key[self.order], bucket[self.order]

    def counts(self, training: np.ndarray) -> np.ndarray:
        """Of each n-gram in the texts marked as training, in the order of ``key``."""
        taken = np.repeat(training, self.ends - self.starts)
        single = np.bincount(self.word[taken], minlength=self.vocabulary)
        single[1] = int(training.sum())
        return np.concatenate([single, np.bincount(self.pair_of[taken], minlength=len(self.pair))])[self.order]

    def parts(self):
        edges = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1]))
        for a, b in zip(edges, [*edges[1:], len(self.bucket)]):
            yield int(self.bucket[a]), slice(a, b)


def _ask(buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        block = _Block(docs.column("text"), buckets)
        counts = block.counts(docs.column("training").to_numpy(zero_copy_only=False).astype(bool))
        rows = [(b, block.key[s].tobytes(), *_packed(counts[s])) for b, s in block.parts()]
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
                         **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in ((1, "keys"), (2, "small"), (3, "large"))}})
    return run


def _answer(asked: pa.Table) -> pa.Table:
    """The corpus count of each n-gram that a block asked for."""
    keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in asked.column("keys")]
    counts = [_unpacked(s.as_py(), x.as_py()) for s, x in zip(asked.column("small"), asked.column("large"))]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
    edges = np.cumsum([0, *map(len, keys)])
    packed = [_packed(total[place[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"),
                     "small": pa.array([p[0] for p in packed], pa.binary()), "large": pa.array([p[1] for p in packed], pa.binary())})


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, vocabulary: int, single: np.ndarray, double: np.ndarray,
                 total: int, distinct: int, strength: float):
        plain = (single + 1) / (total + distinct + 1)
        self.plain = np.log10(plain)
        self.empty = self.plain.tolist()
        self.fail = (np.log10(strength) - np.log10(single + strength)).tolist()
        self.vocabulary = vocabulary
        seen = double > 0
        h, w = np.divmod(pairs[seen], vocabulary)
        weight = np.log10((double[seen] + strength * plain[w]) / (single[h] + strength))
        self.arcs = dict(zip(pairs[seen].tolist(), weight.tolist()))

    def score(self, words: list[int]) -> float:
        """One traversal from the start state; unseen words lead to a state without arcs."""
        total, state, arcs, n = 0.0, 1, self.arcs, self.vocabulary
        for w in words:
            weight = arcs.get(state * n + w)
            total += self.fail[state] + self.empty[w] if weight is None else weight
            state = w
        return total


def _score(buckets: int, total: int, distinct: int, strength: float):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(docs.column("text"), buckets)
        where = dict(block.parts())
        counts = np.zeros(len(block.key), np.int64)
        for row in told.to_pylist():
            counts[where[row["bucket"]]] = _unpacked(row["small"], row["large"])
        there = np.empty_like(counts)
        there[block.order] = counts
        single, double = there[:block.vocabulary], there[block.vocabulary:]
        model = Automaton(block.word, block.pair, block.vocabulary, single, double, total, distinct, strength)
        known, base, scores = [], [], []
        for a, b in zip(block.starts, block.ends):
            words = block.word[a:b]
            known.append(int((single[words] > 0).sum()))
            base.append(float(model.plain[words].sum()))
            scores.append(model.score(words.tolist()))
        return pa.table([docs.column("id"), docs.column("training"), pa.array(block.ends - block.starts), pa.array(known, pa.int64()),
                         pa.array(base, pa.float64()), pa.array(scores, pa.float64())],
                        names=["id", "training", "n_tokens", "n_known", "base_score", "score"])
    return run


def _vocabulary(buckets: int):
    """Distinct word hashes by bucket, and the number of tokens, of a task's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, tokens = WordHashes(), {END}, 0

        def out(words: set[bytes], tokens: int) -> pa.RecordBatch:
            key = np.unique(hashes.all(list(words)))
            bucket = (key >> np.uint64(20)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            cut = [x.tobytes() for x in np.split(key[order], first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(cut, pa.binary()),
                                               pa.array([tokens] + [0] * (len(cut) - 1), pa.int64())], names=["bucket", "keys", "tokens"])
        rows = 0
        for batch in batches:
            for text in batch.column(0):
                ws = words_of(text.as_py())
                words.update(ws)
                tokens += len(ws) + 1
                rows += 1
                if len(words) >= DISTINCT:
                    yield out(words, tokens)
                    words, tokens = {END}, 0
        if rows:
            yield out(words, tokens)
    return run


def _distinct(part: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k in part.column("keys")]))
    return pa.table({"distinct": [len(keys)], "tokens": [sum(part.column("tokens").to_pylist())]})


def backoff_scores(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", strength: float = 64.0,
                   share_mb: int = 4) -> DataFrame:
    """(key, training, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    ``training`` marks the rows to learn from. Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased and one end token for each text; a null text is an empty one. Without
    training rows every token has probability 1. Null and repeated keys are kept as rows.
    """
    n = shares(docs, F.col(text), share_mb)
    whole = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(training, F.lit(False)).alias("training"), whole_text(F.col(text)).alias("text"),
                        dealt(F.col(f"`{key}`"), whole_text(F.col(text)), n).alias("block"))
    sizes = (whole.filter("training").select("text").mapInArrow(_vocabulary(n), "bucket int, keys binary, tokens long")
             .groupBy("bucket").applyInArrow(_distinct, "distinct long, tokens long").agg(F.sum("distinct"), F.sum("tokens")).first())
    distinct, total = (int(x or 0) for x in sizes)
    blocks = whole.groupBy("block")
    told = (blocks.applyInArrow(_ask(n), "block int, bucket int, keys binary, small binary, large binary")
            .groupBy("bucket").applyInArrow(_answer, "block int, bucket int, small binary, large binary"))
    kind = dict(docs.dtypes)[key]
    scored = blocks.cogroup(told.groupBy("block")).applyInArrow(
        _score(n, total, distinct, strength), f"id {kind}, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(key), "training", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
