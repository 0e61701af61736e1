"""Stored vectors in blocks with a bound each, so that exact inner-product search reads only blocks that can matter.

A block is a ring of a cell: vectors whose nearest centre it is, between two distances from it. For a query q, a vector x, its
centre c and the block's greatest distance r, q.x = q.c + q.(x - c) <= q.c + |q| r, so a block whose bound is below the k-th
best score found so far has nothing to add. Vectors without such structure prune nothing and are still searched exactly.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Versions, read_bytes, stored, write_bytes
from . import retrieval as R

#: Most cells; with RINGS it bounds the table of blocks that a search reads to the driver and sends to the executors.
CELLS, RINGS = 1024, 4
#: Vectors of a cell that centres are fitted on (those of the least hashes of chunk_id), and rounds of fitting.
FIT_VECTORS, FIT_ROUNDS = 32, 6
#: What rounding may hide: scores are ranked at nine places.
SLACK = 1e-8


@dataclass(frozen=True)
class Report:
    """What a search read: blocks in all, those read, vectors in all, (query, vector) products made."""

    blocks: int
    blocks_read: int
    vectors: int
    products: int


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from a start that takes the farthest next; at most as many as differ."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < cells and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    at = sample[chosen]
    for _ in range(FIT_ROUNDS):
        own = _nearest(sample, at)[0]
        sums, n = np.zeros_like(at), np.bincount(own, minlength=len(at))
        np.add.at(sums, own, sample)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def _nearest(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is (computed from the difference, so that it bounds)."""
    own = ((at**2).sum(1) - 2 * rows @ at.T).argmin(1)
    return own, np.sqrt(((rows - at[own]) ** 2).sum(1))


def build(vectors: DataFrame, path: str, cells: int | None = None, rings: int = RINGS) -> VectorBlocks:
    """Writes vectors (chunk_id, embedding) as a new version of the index at path.

    Vectors are those of the size that most have; null ones, others and such as hold a null or what is not finite are counted
    as left_out and never a result. Without `cells` there is one for each 1,000 vectors, CELLS at most. A block that most
    vectors are in is written by many tasks: rows are dealt by block and a hash.
    """
    spark = vectors.sparkSession
    made: dict = {}
    sound = F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    sizes = vectors.groupBy(F.when(sound, F.size("embedding")).alias("dims")).count().orderBy(F.desc("count"), "dims").collect()
    known = [r for r in sizes if r["dims"]]
    dims, n = (known[0]["dims"], known[0]["count"]) if known else (0, 0)
    rows = vectors.where(sound & (F.size("embedding") == dims) & (F.lit(dims) > 0)).select("chunk_id", "embedding")
    cells = max(1, min(CELLS, n // 1000 if cells is None else cells))
    sample = rows.select("embedding").orderBy(F.xxhash64("chunk_id"), F.hash("embedding")).limit(cells * FIT_VECTORS).collect()
    at = centres(np.array([r[0] for r in sample], np.float64).reshape(-1, dims or 1), cells)
    sent = spark.sparkContext.broadcast(at)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"], b["distance"] = _nearest(np.stack(b["embedding"].to_numpy()).astype(np.float64), sent.value)
                yield b

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    element = vectors.schema["embedding"].dataType.simpleString()
    placed = stored(rows.mapInPandas(place, f"chunk_id {kind}, embedding {element}, cell int, distance double"), "placed")

    def write(folder: str) -> None:
        cuts = placed.groupBy("cell").agg(F.percentile_approx("distance", [i / rings for i in range(1, rings)] or [1.0]).alias("cuts"))
        ring = F.size(F.filter("cuts", lambda c: c < F.col("distance"))) if rings > 1 else F.lit(0)
        blocks = placed.join(cuts, "cell").withColumn("block", (F.col("cell") * rings + ring).cast("int")).drop("cuts")
        blocks.repartitionByRange(F.col("block"), F.xxhash64("chunk_id")).select("chunk_id", "embedding", "distance", "block").write.partitionBy("block").parquet(f"{folder}/vectors")
        held = spark.read.schema(f"chunk_id {kind}, embedding {element}, distance double, block int").parquet(f"{folder}/vectors")
        held.groupBy("block").agg(F.count("*").alias("n"), F.max("distance").alias("reach")).coalesce(1).write.parquet(f"{folder}/blocks")
        said = {"dims": dims, "vectors": n, "left_out": sum(r["count"] for r in sizes) - n, "rings": rings, "kind": kind, "element": element, "centres": at.tolist()}
        write_bytes(spark, f"{folder}/blocks.json", json.dumps(said).encode())
        made.update(said)

    if not n:
        made.update({"dims": 0, "vectors": 0, "left_out": sum(r["count"] for r in sizes), "rings": rings, "kind": kind, "element": element, "centres": []})
        version = Versions(spark, path).publish(lambda folder: write_bytes(spark, f"{folder}/blocks.json", json.dumps(made).encode()))
    else:
        version = Versions(spark, path).publish(write)
    return VectorBlocks(spark, version["path"], made)


def load(spark: SparkSession, path: str) -> VectorBlocks:
    """The index in force at path; ValueError if there is none."""
    found = Versions(spark, path).current()
    body = read_bytes(spark, f"{found['path']}/blocks.json") if found else None
    if body is None:
        raise ValueError(f"no vector blocks at {path}")
    return VectorBlocks(spark, found["path"], json.loads(body))


@dataclass(frozen=True)
class VectorBlocks:
    spark: SparkSession
    path: str
    said: dict = field(hash=False)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank): what retrieval.dense() gives, ties included."""
        return self.search_reported(queries, k)[0]

    def search_reported(self, queries: DataFrame, k: int) -> tuple[DataFrame, Report]:
        """The result and what was read for it.

        Queries (query_id, embedding) go in blocks of QUERY_BLOCK. Each of them first reads the blocks of the best bounds that
        hold k vectors, which gives a floor to its k-th score, then those whose bounds reach that. Queries that are null or
        of another size find nothing.
        """
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {self.said['kind']}, score double"
        none = self.spark.createDataFrame([], schema + ", rank int")
        if not self.said["vectors"] or k <= 0:
            return none, Report(0, 0, self.said["vectors"], 0)
        table = self.spark.read.parquet(f"{self.path}/blocks").orderBy("block").collect()
        names, n, reach = (np.array([r[c] for r in table]) for c in ("block", "n", "reach"))
        at = np.array(self.said["centres"])[names // self.said["rings"]]
        parts, read, products = [], set(), 0
        for ids, asked in _asked(queries, self.said["dims"]):
            middle = asked @ at.T
            bound = middle + np.linalg.norm(asked, axis=1)[:, None] * reach
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            top = stored(self._against(ids, asked, names, first, k, schema), "nearest")
            floors = R.ranked(top, ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
            floor = {r["query_id"]: r["floor"] for r in floors.collect() if r["n"] == k}
            least = np.array([floor.get(i, -math.inf) for i in ids])
            more = (bound >= least[:, None] - SLACK * (1 + np.abs(bound))) & ~first
            parts.append(top)
            if more.any():
                parts.append(self._against(ids, asked, names, more, k, schema))
            read |= set(names[(first | more).any(axis=0)].tolist())
            products += int((first | more).astype(np.int64).sum(axis=0) @ n)
        if not parts:
            return none, Report(len(names), 0, int(n.sum()), 0)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return R.ranked(out, ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k), Report(len(names), len(read), int(n.sum()), products)

    def _against(self, ids: np.ndarray, asked: np.ndarray, names: np.ndarray, wanted: np.ndarray, k: int, schema: str) -> DataFrame:
        """The k best of each task for each query among the blocks that it wants; other blocks' files are not opened."""
        some = wanted.any(axis=0)
        sent = self.spark.sparkContext.broadcast((ids, asked, {int(b): np.flatnonzero(wanted[:, j]) for j, b in enumerate(names) if some[j]}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, asked, of = sent.value
            best = chunk = None
            for b in batches:
                for block, part in b.groupby("block", sort=False):
                    own = part["chunk_id"].to_numpy()
                    if best is None:
                        best, chunk = np.full((len(ids), k), -np.inf), np.full((len(ids), k), own[0], dtype=own.dtype)
                    who = of[int(block)]
                    scores = np.round(asked[who] @ np.stack(part["embedding"].to_numpy()).astype(np.float64).T, 12)
                    best[who], chunk[who] = R._better(best[who], chunk[who], scores, own, k)
            if best is not None:
                found = np.isfinite(best)
                yield pd.DataFrame({"query_id": np.repeat(ids, found.sum(axis=1)), "chunk_id": chunk[found], "score": best[found]})

        rows = self.spark.read.schema(f"chunk_id {self.said['kind']}, embedding {self.said['element']}, distance double, block int").parquet(f"{self.path}/vectors")
        return rows.where(F.col("block").isin([int(b) for b in names[some]])).select("chunk_id", "embedding", "block").mapInPandas(run, schema)


def _asked(queries: DataFrame, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.where(F.size("embedding") == dims).select("query_id", "embedding").orderBy("query_id").toLocalIterator(prefetchPartitions=True):
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == R.QUERY_BLOCK:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)
