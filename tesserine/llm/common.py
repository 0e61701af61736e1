"""Helpers that the training-data operators share: table access, the shared scratch folder, neighbours in an order."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import tempfile
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; in local mode a folder of our own where
    that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jvm_dir.get() if jvm_dir.isDefined() else None
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tesserine-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Scratch paths that exist; removed by discard() or at the driver's end.
_scratch: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the driver's end."""
    if not _scratch:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/tesserine-{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _scratch.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path in list(_scratch):
        with contextlib.suppress(Exception):  # the session may have ended before
            _remove(path)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: the lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Removes what stored() wrote for frames that nothing reads any more."""
    for df in dfs:
        if getattr(df, "stored_at", None) in _scratch:
            _remove(df.stored_at)


def numbered(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """rows, stored, with their place in the order of the keys as `_at` (0, 1, ...), without a window over all of them.

    Rows are range partitioned and sorted; a partition's rows are counted on from the partitions before it. Rows that are
    equal in all keys are in any order.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id())
    dealt = stored(dealt, "numbered").withColumn("_part", F.shiftright("_n", 33))
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect())  # a row for each partition
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "_p long, _offset long")
    at = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_offset")
    return dealt.join(F.broadcast(table), dealt["_part"] == table["_p"]).withColumn("_at", at).drop("_n", "_part", "_p", "_offset")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver
    happens to collect its garbage."""
    for _ in range(2):  # what Python lets go of in the first round, Java can collect in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, whatever the case: the name itself or with a number after it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = next(x for x in (f"{name}{i or ''}" for i in range(len(taken) + 1)) if x.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


#: Characters of the texts that a worker splits at once; one longer text is a run of its own.
CHUNK_CHARS = 1_500_000


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most `most` characters together, or of one longer text."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(texts) > start:
        yield start, len(texts)


def lean(run: Callable) -> Callable:
    """run(batches), after whose last batch the worker gives freed memory back: workers live on into other stages."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def least_hashes(df: DataFrame, by: str, k: int) -> dict[Any, set[int]]:
    """Of each value of the column `by` (null left out): the k doc_ids with the least hashes (all, if they are fewer).

    Values must be few. Counts come first; then only doc_ids whose hash is below a bound, at which about 4 k of a value are
    expected, are sent to the driver. Where repeated doc_ids leave fewer than k below it, the bound grows.
    """
    h, known = F.xxhash64("doc_id"), df.where(F.col(by).isNotNull() & F.col("doc_id").isNotNull())
    open_ = {r[0]: min(1.0, 4 * k / r[1]) for r in known.groupBy(by).count().collect()}
    out: dict[Any, set[int]] = {}
    while open_:
        near = reduce(Column.__or__, [(F.col(by) == v) & (h <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))) for v, share in open_.items()])
        found: dict[Any, list[tuple[int, int]]] = {v: [] for v in open_}
        for r in known.where(near).select(by, h.alias("h"), "doc_id").distinct().collect():
            found[r[0]].append((r[1], r[2]))
        out |= {v: {i for _, i in sorted(rows)[:k]} for v, rows in found.items()}
        open_ = {v: min(1.0, 16 * share) for v, share in open_.items() if share < 1 and len(found[v]) < k}
    return out


def successors(df: DataFrame, order: str, carry: list[str], make: Callable[[DataFrame], DataFrame], blocks: int | None = None) -> DataFrame:
    """make(df) with `next_value`: the struct that the next row by the integer column `order` carries.

    make() adds a struct column `_value` from the columns `carry`. Rows of equal order are put in the order of the hash of
    what they carry; a null order comes first; the last row has a null next_value. No window spans the table: the order is
    cut into blocks at quantiles (an order that many rows share is cut by the hash), a window inside a block finds all
    neighbours but the last one's, and that one is the first row of the next block. Only rows that are equal in order and
    in what they carry stay together whatever their number. What goes to the driver is a number for each block.
    """
    n = blocks or 12 * shuffle_partitions(df.sparkSession)
    keyed = df.withColumn("_order", F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))).withColumn("_tie", F.xxhash64(*carry))
    shares = [i / n for i in range(1, n)]
    cuts = keyed.agg(F.percentile_approx("_order", shares, 20 * n)).first()[0] if shares else []
    keyed = keyed.withColumn("_block", _block(sorted(cuts or [])))
    inside = make(keyed).withColumn("_inside", F.lead("_value").over(Window.partitionBy("_block").orderBy("_order", "_tie")))
    first = F.min_by(F.struct(*[F.col(c) for c in carry]), F.struct("_order", "_tie"))
    heads = stored(keyed.groupBy("_block").agg(first.alias("_head")).select("_block", "_head.*"), "heads")
    known = sorted(r[0] for r in heads.select("_block").collect())
    heads = make(heads).select(F.col("_block").alias("_after"), F.col("_value").alias("_next"))
    chain = df.sparkSession.createDataFrame(list(zip(known, known[1:])), "_b long, _after long")
    after = chain.join(heads, "_after").select("_b", "_next")
    joined = inside.join(after, inside["_block"] == after["_b"], "left").drop("_b")
    return joined.withColumn("next_value", F.coalesce("_inside", "_next")).drop("_inside", "_next", "_value", "_block", "_order", "_tie")


def _block(cuts: list[int]) -> Column:
    """A number that grows with (_order, _tie): the cuts below _order and, where cuts repeat _order, a part of the hash."""
    if not cuts:
        return F.lit(0).cast("long")
    times = Counter(cuts)
    distinct = sorted(times)
    wide = max(1, math.isqrt(len(distinct)))
    groups = [distinct[i : i + wide] for i in range(0, len(distinct), wide)]
    table = F.array(*[F.array(*[F.struct(F.lit(c).cast("long").alias("cut"), F.lit(times[c]).cast("long").alias("times")) for c in g]) for g in groups])
    tops = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    order = F.col("_order")
    row = F.greatest(F.size(F.filter(tops, lambda c: c <= order)) - 1, F.lit(0))
    own = F.filter(F.get(table, row), lambda x: x["cut"] <= order)
    last = F.element_at(F.when(F.size(own) > 0, own), -1)
    # an order that is itself a cut has a block of its own, in as many parts as the cut has repetitions
    place = 2 * (row * wide + F.size(own)) - F.when(last["cut"] == order, 1).otherwise(0)
    part = F.when(last["cut"] == order, F.shiftright((F.shiftright("_tie", 32) + F.lit(2**31)) * last["times"], 32)).otherwise(F.lit(0))
    return (place.cast("long") * F.lit(2**31) + part).cast("long")
