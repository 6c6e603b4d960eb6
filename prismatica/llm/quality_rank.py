"""Document quality by Bradley-Terry ranking of preference pairs.

A pair is a document marked good and one marked bad; the model is a score w.x such that the
good one wins with probability 1 / (1 + exp(w.x_bad - w.x_good)). It is fitted by logistic
loss on feature differences, without intercept. The threshold is the quantile of the
training scores that leaves as large a share above as the labels do.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismatica.functions.quantiles import quantiles
from prismatica.llm.common import ship, whole_text
from prismatica.llm.linear import sigmoid

ship(sys.modules[__name__])

SIGNALS = ["all_caps", "letters_only", "repeats", "exclaims", "pipes", "symbols", "stops", "commas", "repeated_lines",
           "digits", "single", "distinct", "words", "word_length", "empty"]
# Rows of a block, which one task holds; opponents of a row; steps and penalty of the fit.
BLOCK, OPPONENTS, STEPS, PENALTY = 8_000, 8, 50, 1e-4


def signals(text: str) -> list[float]:
    """Figures of a text, in the order of ``SIGNALS``; an empty one has only the last."""
    words = text.split()
    n, m = len(text), len(words)
    if m == 0:
        return [0.0] * (len(SIGNALS) - 1) + [1.0]
    lines = text.split("\n")
    count = text.count
    return [sum(w.isupper() and len(w) > 1 for w in words) / m, sum(map(str.isalpha, words)) / m,
            sum(a == b for a, b in zip(words, words[1:])) / m, count("!") / m, count("|") / m,
            sum(map(count, "#$%&*")) / n, count(".") / m, count(",") / m, 1 - len(set(lines)) / len(lines),
            sum(map(count, "0123456789")) / n, sum(len(w) == 1 for w in words) / m, len(set(words)) / m, math.log1p(m), n / m / 10, 0.0]


def _signalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signals(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "signals"])


def _blocked(rows: pa.Table) -> pa.Table:
    """A block as one row, its labelled rows in the order of their hashes."""
    good = rows.column("good").to_numpy()
    order = np.lexsort((good, rows.column("id_hash").to_numpy()))
    x = np.array(rows.column("signals").to_pylist(), np.float64)[order]
    return pa.table({"block": rows.column("block").slice(0, 1), "x": pa.array([x.tobytes()], pa.binary()),
                     "good": pa.array([(good[order] == 1).tobytes()], pa.binary())})


def _summed(blocks: DataFrame, figures) -> list[np.ndarray]:
    """The sum over all blocks of each array of ``figures(block, x, good)``. A row of a few KB per block reaches
    the driver; they are added in the order of the blocks, so the sums do not move with partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x, good in zip(*(batch.column(c).to_pylist() for c in ("block", "x", "good"))):
                found = figures(block, np.frombuffer(x).reshape(-1, len(SIGNALS)), np.frombuffer(good, bool))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([[np.ravel(f).tolist() for f in found]], pa.list_(pa.list_(pa.float64())))],
                                                 names=["block", "found"])
    rows = sorted(blocks.mapInArrow(run, "block long, found array<array<double>>").collect())
    return [sum(np.array(r["found"][i]) for r in rows) for i in range(len(rows[0]["found"]))]


def _pairs(block: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of winners and losers: every row of the rarer class meets at least ``OPPONENTS`` of the other one, and
    every row of the other one is met."""
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    few, many = sorted((winners, losers), key=len)
    if not len(few):
        return few, few
    met = np.random.default_rng(block).permutation(many)
    n = max(OPPONENTS * len(few), len(many))
    few, met = np.resize(few, n), np.resize(met, n)
    return (met, few) if len(losers) <= len(winners) else (few, met)


def _standard(x, middle, spread):
    return np.clip((x - middle) / spread, -8, 8)


def _weights(blocks: DataFrame, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The least logistic loss on the differences of all pairs, by Newton's method: a pass of all blocks per step; a
    step that makes the loss greater is halved."""
    width = len(SIGNALS)
    at, w, move, least = None, np.zeros(width), None, np.inf
    for _ in range(STEPS):
        def figures(block, x, good, w=w):
            a, b = _pairs(block, good)
            z = _standard(x, middle, spread)
            d = z[a] - z[b]
            lost = sigmoid(-(d @ w))
            return [[len(a)], [np.logaddexp(0, -(d @ w)).sum()], -(d.T @ lost), (d * (lost * (1 - lost))[:, None]).T @ d]
        n, loss, slope, bend = _summed(blocks, figures)
        if not n[0]:
            return w
        loss, slope = loss[0] / n[0] + PENALTY / 2 * w @ w, slope / n[0] + PENALTY * w
        if loss > least:
            move = move / 2
        else:
            at, least = w, loss
            move = -np.linalg.solve(bend.reshape(width, width) / n[0] + PENALTY * np.eye(width), slope)
        if np.abs(move).max() < 1e-6:
            break
        w = at + move
    return at


def train_ranking(docs: DataFrame, labels: DataFrame, good: str = "quality", key: str = "doc_id", text: str = "text",
                  only: Column | None = None) -> dict:
    """Weights and threshold learnt from all labelled rows, in blocks of some ``BLOCK`` rows dealt by the key's hash;
    pairs are made within a block.
    ``only`` restricts the keys that may be learnt from. Rows with a null label are left out,
    of documents that share a key one text is learnt from;
    without labelled rows, or with one class only, every score is 0.5."""
    marks = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{good}`").cast("int").alias("good"), (F.lit(True) if only is None else only).alias("only"))
    marks = marks.filter("only and id is not null and good is not null").drop("only").withColumn("id_hash", F.xxhash64("id"))
    nothing = {"middle": [0.0] * len(SIGNALS), "spread": [1.0] * len(SIGNALS), "weights": [0.0] * len(SIGNALS), "threshold": 0.0}
    count = marks.count()
    if not count:
        return nothing
    # Signals are taken before the join, so that no text is shuffled.
    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(f"`{key}`").alias("id"), whole_text(F.col(text)).alias("text")).filter("id is not null")
    slim = texts.select("id", F.sha2("text", 256).alias("digest"), "text").mapInArrow(_signalled, f"id {kind}, digest string, signals array<double>")
    one = slim.join(marks.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct("digest", "signals")).alias("least"))
    rows = one.join(marks, "id").select("id_hash", "good", F.col("least.signals").alias("signals"))
    parts = -(-count // BLOCK)
    blocks = (rows.withColumn("block", F.pmod(F.xxhash64("id_hash"), F.lit(parts))).groupBy("block")
              .applyInArrow(_blocked, "block long, x binary, good binary").persist())
    try:
        if blocks.isEmpty():
            return nothing
        n, wins, total = _summed(blocks, lambda block, x, good: [[len(x)], [good.sum()], x.sum(0)])
        middle = total / n[0]
        squares, = _summed(blocks, lambda block, x, good: [((x - middle) ** 2).sum(0)])
        spread = np.sqrt(squares / n[0]) + 1e-6
        w = _weights(blocks, middle, spread)

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("x").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(_standard(np.frombuffer(x).reshape(-1, len(SIGNALS)), middle, spread) @ w, pa.float64())], names=["score"])
        scored = blocks.mapInArrow(scores, "score double")
        threshold = quantiles(scored, [("score", F.col("score"))], [1 - float(wins[0] / n[0])]).first()["q0"]
    finally:
        blocks.unpersist()
    return {"middle": middle.tolist(), "spread": spread.tolist(), "weights": w.tolist(), "threshold": float(threshold)}


def _scored(model: dict):
    middle, spread, weights = (np.array(model[x]) for x in ("middle", "spread", "weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([signals(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(SIGNALS))
            score = sigmoid(np.clip((x - middle) / spread, -8, 8) @ weights - model["threshold"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])
    return run


def ranked_quality(docs: DataFrame, model: dict, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) and ``score``: 0.5 at the threshold,
    more for better texts. A null text counts as empty. A carried ``score`` gives way."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    kinds = dict(docs.dtypes)
    ready = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], whole_text(F.col(text)).alias("text"))
    scored = ready.mapInArrow(_scored(model), ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(carry)), "score double"]))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "score")
