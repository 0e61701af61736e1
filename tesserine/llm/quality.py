"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it whole. Filters of WIDTH bytes, moved by STEP, are learnt
as a table value for each place and byte; a chunk keeps each filter's maximum; a document keeps the maximum and the mean of
its chunks' maxima, which a logistic unit combines into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, least_hashes, safe_text

WIDTH, STEP, FILTERS = 8, 2, 16
CHUNK, OVERLAP = 512, 64
#: Training reads this many documents of each label at most (those with the least hash of doc_id), whole.
FIT_DOCS, EPOCHS = 700, 14


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of a text of n bytes; each begins OVERLAP before the last one ends; at least one."""
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


@dataclass
class Network:
    table: np.ndarray  # [WIDTH, 257, FILTERS]; byte 256 is padding
    weights: np.ndarray  # [2 * FILTERS]
    bias: float

    def responses(self, body: np.ndarray) -> np.ndarray:
        """[positions, FILTERS] of body, which is padded by WIDTH at least; a position every STEP bytes."""
        n = (len(body) - WIDTH) // STEP + 1
        out = np.empty((n, FILTERS), np.float32)
        for at in range(0, n, 8192):
            end = min(n, at + 8192)
            sub = self.table[0].take(body[at * STEP : end * STEP : STEP], 0)
            for j in range(1, WIDTH):
                sub += self.table[j].take(body[at * STEP + j : (end - 1) * STEP + j + 1 : STEP], 0)
            out[at:end] = sub
        return out

    def tops(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The padded body; of each chunk and filter the greatest response and its position in the whole text. The text is
        padded at its end alone, so a chunk's last positions look into the next one."""
        body = np.concatenate((np.frombuffer(raw, np.uint8).astype(np.int16), np.full(WIDTH + STEP, 256, np.int16)))
        r = self.responses(body)
        starts = chunk_starts(len(raw))
        lows = np.minimum(starts // STEP, len(r) - 1)
        highs = np.maximum(np.minimum((starts + CHUNK) // STEP, len(r)), lows + 1)
        where = np.stack([a + r[a:b].argmax(0) for a, b in zip(lows, highs, strict=True)])
        return body, r[where, np.arange(FILTERS)], where

    def features(self, raw: bytes) -> np.ndarray:
        act = np.maximum(self.tops(raw)[1], 0)
        return np.concatenate((act.max(0), act.mean(0)))

    def probability(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-(self.features(raw) @ self.weights + self.bias))))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """texts: whole documents, seen as features() sees them. Adam on the log loss; gradients pass each chunk's maximum alone."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, 2 * FILTERS), 0.0
    if not texts:
        return Network(table, np.zeros(2 * FILTERS), 0.0)
    state = [[np.zeros_like(x, dtype=np.float64) for _ in range(2)] for x in (table, weights, np.zeros(1))]
    step = 0
    for epoch in range(epochs):
        rate = 0.02 if epoch < epochs * 2 // 3 else 0.005
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            g_table, g_weights, g_bias = np.zeros_like(table), np.zeros_like(weights), 0.0
            net = Network(table, weights, bias)
            for i in part:
                body, raw, where = net.tops(texts[i])
                act = np.maximum(raw, 0)
                top = act.argmax(0)
                f = np.concatenate((act.max(0), act.mean(0)))
                miss = 1 / (1 + np.exp(-(f @ weights + bias))) - labels[i]
                g_weights += miss * f
                g_bias += miss
                back = np.tile(miss * weights[FILTERS:] / len(act), (len(act), 1))
                back[top, np.arange(FILTERS)] += miss * weights[:FILTERS]
                back *= raw > 0
                for j in range(WIDTH):
                    np.add.at(g_table[j], (body[where * STEP + j], np.arange(FILTERS)), back)
            step += 1
            grads = (g_table / len(part) + 1e-4 * table, g_weights / len(part) + 1e-3 * weights, np.array([g_bias / len(part)]))
            values = [table, weights, np.array([bias])]
            for (m, v), g, x in zip(state, grads, values, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(x.dtype)
            bias = float(values[2][0])
    return Network(table, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS) -> tuple[list[bytes], np.ndarray]:
    """The whole texts and the labels of at most per_label learnable documents of each label.

    Ids are chosen among the labels first, by the least hash; only those documents' texts are read. Rows without a label
    (0 or 1) or with a null id or held out are never chosen, nor are ids that have both labels. Of rows that share an id
    the text with the least hash is learnt from, once.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ids = sorted(set().union(*least_hashes(known, "quality", per_label).values()))
    if not ids:
        return [], np.zeros(0)
    both = known.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    said = {r["doc_id"]: r["low"] for r in both.where("low = high").collect()}
    own = docs.where(F.col("doc_id").isin(list(said))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    texts = [(r["doc_id"], r["text"].encode("utf-8", "replace")) for r in own.collect()]
    texts.sort()
    return [raw for _, raw in texts], np.array([float(said[i]) for i, _ in texts])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` with `score`: the probability of label 1 of each whole text. Reads the text alone; null is empty. Narrow."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = held.value
        for texts in batches:
            yield pd.Series([net.probability(t.encode("utf-8", "replace")) for t in texts], dtype="float64")

    return docs.withColumn("score", F.pandas_udf(score, "double")(safe_text()))


def classify(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS) -> DataFrame:
    """Trains on the learnable documents and scores all: doc_id, held_out, score, predicted (1 from 0.3 up).

    One row per row of docs: repeated rows and ids give a row each, a null doc_id stays null and is not held out, a null
    text is an empty one, a text of any length is read whole. Without any label to learn from all scores are 0.5; ids that
    have both labels are not learnt from; an empty table gives no row.
    """
    net = fit(*sample(docs, labels, per_label))
    out = predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
