"""Exact de-duplication by composable polynomial fingerprints.

A text's bytes are the digits of a number in several bases modulo the prime 2^31 - 1. Chunks are hashed side by side, and the
fingerprint of a whole is the sum of its chunks' hashes, each shifted by the number of bytes after it, so chunks can be
hashed anywhere and in any order. Texts of one fingerprint are then compared chunk by chunk, in a stream of rows sorted by
fingerprint; what differs in spite of it is told apart by its SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, stored, unused

PRIME = 2**31 - 1
#: One base for each lane, drawn once; a fingerprint is the length and all lanes.
BASES = tuple(int(x) for x in np.random.default_rng(20250211).integers(2**20, PRIME - 1, 4))
#: Bytes that are hashed in one piece, pieces that are hashed side by side, bytes that are compared at once.
CHUNK, SLAB, COMPARED = 1024, 2048, 1 << 16
#: A task compares copies among texts of so many characters (or one longer text) before any text is shuffled.
RUN_CHARS = 8_000_000
#: Up to so many fingerprints of several rows (30 bytes each) are sent to all tasks, to keep other texts out of the shuffle.
SENT = 200_000
#: A group with more than this part of all rows is hot; there are fewer of those than its inverse, whatever the input.
HOT = 1 / 1000


class Polynomial:
    """Hashes of byte strings in several lanes: sum of byte * base ** (bytes after it), modulo the prime."""

    def __init__(self, prime: int = PRIME, bases: tuple[int, ...] = BASES):
        self.prime, self.bases = prime, bases
        powers = np.array([[pow(b, CHUNK - 1 - i, prime) for b in bases] for i in range(CHUNK)], np.int64)
        #: Halves of 16 bits: sums of CHUNK products with bytes are whole numbers that a double holds.
        self.low, self.high = (powers & 0xFFFF).astype(np.float64), (powers >> 16).astype(np.float64)
        self.shifts = np.ones((1, len(bases)), np.int64)

    def _shift(self, most: int) -> np.ndarray:
        """base ** (CHUNK * k) for k up to `most`."""
        while len(self.shifts) <= most:
            step = np.array([pow(b, CHUNK * len(self.shifts), self.prime) for b in self.bases], np.int64)
            self.shifts = np.concatenate((self.shifts, self.shifts * step % self.prime))
        return self.shifts

    def of(self, bodies: list[bytes]) -> np.ndarray:
        """[texts, lanes]: all chunks are hashed side by side, then shifted and summed for each text."""
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        out = np.zeros((len(bodies), len(self.bases)), np.int64)
        counts = -(-sizes // CHUNK)
        if not counts.sum():
            return out
        zeros = bytes(CHUNK)  # before the text: they are worth nothing there
        joined = b"".join([x for body in bodies for x in (zeros[: -len(body) % CHUNK], body)])
        grid = np.frombuffer(joined, np.uint8).reshape(-1, CHUNK)
        parts = [self._slab(grid[i : i + SLAB]) for i in range(0, len(grid), SLAB)]
        ends = np.cumsum(counts)
        after = np.repeat(ends, counts) - 1 - np.arange(len(grid))
        shifted = np.concatenate(parts) * self._shift(int(counts.max()))[after] % self.prime
        some = np.flatnonzero(counts)
        out[some] = np.add.reduceat(shifted, (ends - counts)[some]) % self.prime
        return out

    def _slab(self, grid: np.ndarray) -> np.ndarray:
        x = grid.astype(np.float64)
        low, high = (x @ self.low).astype(np.int64) % self.prime, (x @ self.high).astype(np.int64) % self.prime
        return (low + (high << 16)) % self.prime

    def combined(self, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
        """The hash of two strings, one after the other, from their hashes and the bytes of the second."""
        return (first * np.array([pow(b, size, self.prime) for b in self.bases], np.int64) + second) % self.prime

    def prints(self, bodies: list[bytes]) -> list[bytes]:
        """Length and hash in all lanes, as bytes."""
        rows = self.of(bodies).astype("<u4")
        return [len(b).to_bytes(8, "big") + r.tobytes() for b, r in zip(bodies, rows, strict=True)]


@lru_cache(maxsize=4)
def polynomial(prime: int = PRIME, bases: tuple[int, ...] = BASES) -> Polynomial:
    return Polynomial(prime, bases)


def of_chunks(rows: DataFrame, prime: int = PRIME, bases: tuple[int, ...] = BASES) -> DataFrame:
    """Fingerprints (key, print) of documents that are stored as chunks (key, offset, body): offset in bytes, in any order.

    Chunks are hashed where they are and shifted by what stands before them; the shifted hashes are added up (partly in each
    task) and the sum is shifted by the whole length, so no body is moved and no document is put together. A null body
    is empty; a null key is a document; chunks must cover a document without gap or overlap. No rows give no row.
    """
    lanes = [f"h{i}" for i in range(len(bases))]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        poly = polynomial(prime, bases)
        back = [pow(b, -1, prime) for b in bases]
        for b in batches:
            bodies = [x or b"" for x in b["body"]]
            ends = [int(o) + len(x) for o, x in zip(b["offset"], bodies, strict=True)]
            shift = np.array([[pow(r, e, prime) for r in back] for e in ends], np.int64).reshape(len(ends), len(bases))
            yield pd.DataFrame(poly.of(bodies) * shift % prime, columns=lanes).assign(key=b["key"].to_numpy(), end=ends)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = [[int(h) * pow(r, int(n), prime) % prime for h, r in zip(row, bases, strict=True)] for *row, n in b[[*lanes, "end"]].itertuples(index=False)]
            prints = [int(n).to_bytes(8, "big") + np.array(row, "<u4").tobytes() for row, n in zip(sums, b["end"], strict=True)]
            yield pd.DataFrame({"key": b["key"].to_numpy(), "print": prints})

    kind = rows.schema["key"].dataType.simpleString()
    parts = rows.select("key", "offset", "body").mapInPandas(lean(hashed), ", ".join([f"{h} long" for h in lanes] + [f"key {kind}", "end long"]))
    # sums of hashes below 2^31 stay exact for 2^32 chunks
    sums = parts.groupBy("key").agg(*[(F.sum(h) % prime).alias(h) for h in lanes], F.max("end").alias("end"))
    return sums.mapInPandas(lean(whole), f"key {kind}, print binary")


def same(a: bytes, b: bytes) -> bool:
    """Whether two texts are equal, chunk by chunk up to the first difference."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + COMPARED] == y[i : i + COMPARED] for i in range(0, len(a), COMPARED))


def _printed(docs: DataFrame, key: str, text: Column, poly: tuple) -> DataFrame:
    """key, text_sha256, print of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            for low, high in chunks(bodies):
                prints = pa.array(polynomial(*poly).prints(bodies[low:high]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), prints], names=["key", "text_sha256", "print"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.sha2(text, 256).alias("text_sha256"), F.encode(text, "UTF-8").alias("body"))
    return rows.mapInArrow(lean(run), f"key {kind}, text_sha256 string, print binary")


def _leads(docs: DataFrame, text: Column, poly: tuple) -> DataFrame:
    """(print, body): the different texts of each run; copies are compared with the first one and stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads: dict[bytes, list[bytes]] = {}
        held = 0
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            for low, high in chunks(bodies):
                new: list[tuple[bytes, bytes]] = []
                for p, body in zip(polynomial(*poly).prints(bodies[low:high]), bodies[low:high], strict=True):
                    known = leads.setdefault(p, [])
                    if not any(same(body, x) for x in known):
                        known.append(body)
                        new.append((p, body))
                        held += len(body)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.binary()) for i in (0, 1)], names=["print", "body"])
                if held > RUN_CHARS:
                    leads, held = {}, 0

    return docs.select(F.encode(text, "UTF-8")).mapInArrow(lean(run), "print binary, body binary")


def _collided(leads: DataFrame) -> DataFrame:
    """Fingerprints that different texts have. leads: (print, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, told = None, b"", False
        for batch in batches:
            found = []
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != at:
                    at, first, told = p, body.as_py(), False
                elif not told and not same(first, body.as_py()):
                    told = True
                    found.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["print"])

    return leads.repartition("print").sortWithinPartitions("print").mapInArrow(lean(run), "print binary")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", normalised: Column | None = None, prime: int = PRIME, bases: tuple[int, ...] = BASES) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Rows are of one group if their texts (`normalised`, if given) are equal byte for byte; null is empty. Of each group the
    row with the greatest key stays (null comes last; of rows equal in key and text one stays, whichever); keep_id is that
    key, null if all keys of the group are. text_sha256 is of the text compared. Other columns do not matter. An empty table
    gives no row.

    What is shuffled are fingerprints, and each different text of a task once, to be compared in a sorted stream; only
    texts whose fingerprint several rows have, where there are few enough of those to be sent to all tasks. Summaries of hot
    groups are sent to the tasks, those of others joined, so a group may hold all rows.
    """
    value, poly = F.coalesce(normalised if normalised is not None else F.col(text), F.lit("")), (prime, bases)
    prints = stored(_printed(docs, key, value, poly).withColumn("row", F.monotonically_increasing_id()), "prints")
    shared = stored(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "shared")
    leads = _leads(docs, value, poly)
    if shared.count() <= SENT:
        leads = leads.join(F.broadcast(shared), "print", "left_semi")
    apart = stored(_collided(leads), "collided").withColumn("apart", F.lit(True))
    rows = prints.join(apart, "print", "left").withColumn("which", F.when(F.col("apart"), F.col("text_sha256")).otherwise(""))
    best = F.max(F.struct("key", "row"))
    groups = rows.groupBy("print", "which").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stored(groups.select("print", "which", F.col("best.key").alias("keep"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    line = F.lit(prints.count() * HOT)
    hot, on = groups.where(F.col("group_size") > line), ["print", "which"]
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col("group_size") <= line), on, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("key")).otherwise(F.col("keep"))
    kept = alone | (F.col("row") == F.col("keep_row"))
    return near.unionByName(far).select(F.col("key").alias(key), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the rows that copies() keeps, all their columns as they were."""
    own, sha = unused(docs, "key", "sha")
    stay = copies(docs, key, text).where("kept").select(F.coalesce(F.col(key).cast("string"), F.lit("-")).alias(own), F.col("text_sha256").alias(sha)).distinct()
    marked = docs.withColumns({own: F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("-")), sha: F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)})
    return marked.join(stay, [own, sha], "left_semi").dropDuplicates([own, sha]).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same for DuckDB, for tables whose doc_ids do not repeat.
SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
