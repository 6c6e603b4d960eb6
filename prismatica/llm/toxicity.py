"""Toxicity by a classifier chain of linear models.

The categories are predicted in order. Each model is a logistic regression on the presence
of words and word beginnings, and each later model also sees the probabilities of the
earlier categories. In training those are out-of-fold predictions, so a later model learns
how far an earlier one can be trusted on documents that it has not seen.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import labelled, ship, whole_text
from prismatica.llm.linear import fitted, sigmoid, telling

ship(sys.modules[__name__])

WORD = re.compile(r"[^\W\d_]+")
SAMPLE, FEATURES, FOLDS = 12_000, 3072, 3


def _names(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word] + [word[:n] + "*" for n in (4, 6, 8) if len(word) > n]


def _hashes(text: str) -> np.ndarray:
    names = {x for w in set(WORD.findall(text.lower())) for x in _names(w)}
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in sorted(names)), np.uint64, len(names))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_hashes(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id_hash"), batch.column("target"), pa.array(found, pa.binary())],
                                         names=["id_hash", "target", "hashes"])


def _fit(categories: list[str]):
    def run(sample: pa.Table) -> pa.Table:
        order = np.argsort(sample.column("id_hash").to_numpy(), kind="stable")
        sets = [np.frombuffer(sample.column("hashes")[int(i)].as_py(), np.uint64) for i in order]
        targets = np.array(sample.column("target").to_pylist(), float)[order]
        n = len(sets)
        rows, hashes = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
        fold = np.arange(n) % FOLDS

        def learnt(chosen: np.ndarray, dense: np.ndarray, y: np.ndarray):
            mine = chosen[rows]
            features = telling(hashes[mine], rows[mine], y, FEATURES)
            if not len(features):
                features = np.zeros(1, np.uint64)
            place = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
            hit = features[place] == hashes
            share = chosen.astype(float)
            w, d, b = fitted(rows[hit], place[hit], n, len(features), dense, y, weight=share)
            return features, w, d, b, sigmoid(np.bincount(rows[hit], w[place[hit]], n) + dense @ d + b)

        dense, models = np.zeros((n, 0)), []
        for k in range(len(categories)):
            y = targets[:, k]
            features, w, d, b, _ = learnt(np.ones(n, bool), dense, y)
            models.append({"features": [f"{x:x}" for x in features.tolist()], "weights": w.tolist(), "earlier": d.tolist(), "bias": b})
            outside = np.zeros(n)
            for f in range(FOLDS):
                if k + 1 < len(categories) and (fold != f).any():
                    outside[fold == f] = learnt(fold != f, dense, y)[4][fold == f]
            dense = np.column_stack([dense, outside])
        return pa.table({"model": [json.dumps(models)]})
    return run


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id", text: str = "text",
                sample: int = SAMPLE) -> list[dict]:
    """A chain over ``categories`` (name -> SQL expression over the labels, true or false, in
    this order), learnt from at most ``sample`` labelled rows, those of least key hash. Rows
    with a null label are left out; labels that name one key twice count twice, documents
    that share a key count once. Without
    labelled rows every category has probability 0.5."""
    marks = labels.select(F.col(key).alias("id"), F.array(*[F.expr(e).cast("int") for e in categories.values()]).alias("target"))
    marks = marks.filter(~F.exists("target", lambda x: x.isNull())).withColumn("id_hash", F.xxhash64("id"))
    chosen = marks.orderBy("id_hash", "target").limit(sample)
    rows = labelled(docs, chosen, key, text)
    featured = rows.mapInArrow(_featured, "id_hash long, target array<int>, hashes binary")
    fitted_rows = featured.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit(list(categories)), "model string").collect()
    if not fitted_rows:
        return [{"features": [], "weights": [], "earlier": [0.0] * k, "bias": 0.0} for k in range(len(categories))]
    return json.loads(fitted_rows[0][0])


def _predict(models: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [{int(x, 16): i for i, x in enumerate(m["features"])} for m in models]
        weights = [np.array(m["weights"]) for m in models]

        class Features(dict):
            def __missing__(self, word: str) -> tuple:
                if len(self) > 80_000:  # some 16 MB
                    self.clear()
                hashes = [xxhash.xxh3_64_intdigest(x) for x in _names(word)]
                found = self[word] = tuple((k, p[h]) for k, p in enumerate(places) for h in hashes if h in p)
                return found

        known = Features()
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                present = {f for w in set(WORD.findall(text.as_py().lower())) for f in known[w]}
                probabilities: list[float] = []
                for k, model in enumerate(models):
                    at = [i for c, i in present if c == k]
                    z = model["bias"] + float(weights[k][at].sum()) + float(np.dot(model["earlier"], probabilities))
                    probabilities.append(float(sigmoid(z)))
                out.append(probabilities)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names[:-1], "probabilities"])
    return run


def chain_scores(docs: DataFrame, models: list[dict], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) and ``probabilities``, one for each
    category in order. A null text counts as empty. A carried column of that name gives way."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "probabilities"]
    ready = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], whole_text(F.col(text)).alias("text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(carry)), "probabilities array<double>"])
    scored = ready.mapInArrow(_predict(models), schema)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "probabilities")
