"""Scratch tables of a run, small files that are replaced whole, and versions of artifacts behind a commit.

Scratch tables live in a folder that all executors share, until their scope or the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode a folder of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tesserine-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Scratch paths that exist, in the order in which they were made.
_scratch: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the innermost scope() or of the driver."""
    if not _scratch:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/tesserine-{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def _sweep(paths: list[str] | None = None) -> None:
    for path in list(_scratch) if paths is None else paths:
        spark = _scratch.pop(path, None)
        with contextlib.suppress(Exception):  # the session may have ended before
            fs, at = hadoop_path(spark, path)
            fs.delete(at, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Scratch tables made inside are removed at its end: a service consumes (writes or collects) a query's result within
    one, so its disk does not grow from query to query."""
    before = set(_scratch)
    try:
        yield
    finally:
        _sweep([p for p in _scratch if p not in before])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as tasks can run, where it is read from fewer: files of one large row group are one task
    else. Tables of many files, and what was shuffled before, stay as they are."""
    tasks, run = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():  # its partitions are known only by running it
        return df
    return df.repartition(tasks) if run.toRdd().getNumPartitions() < tasks else df


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file, written beside its place and then renamed over it in one step: readers see the old one or the new one,
    also if this ends in between."""
    beside = _beside(spark, path, body)
    try:
        _rename(spark, beside, path, overwrite=True)
    except Exception:
        fs, at = hadoop_path(spark, beside)
        fs.delete(at, False)
        raise


def _beside(spark: SparkSession, path: str, body: bytes) -> str:
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, at = hadoop_path(spark, beside)
    out = fs.create(at, True)
    out.write(bytearray(body))
    out.hsync()
    out.close()
    return beside


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """One step; without overwrite an error if the target exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(getattr(hadoop, "Options$Rename"), "OVERWRITE" if overwrite else "NONE")
    at = hadoop.Path(target)
    hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(hadoop.Path(source), at, options)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file, or None where there is none."""
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class Conflict(RuntimeError):
    """Somebody else has committed a version since this one was begun."""


class Versions:
    """Versions of an artifact below `root`: folders, and one small file for each commit whose number says the order.

    What is written becomes the artifact by its commit alone, a rename that fails if the number is taken, so of writers that
    began on the same version one wins and the others raise Conflict. A version that fails its check, or whose writer ends
    before the commit, was never one; its folder is removed by the writer or by collect().
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, at = hadoop_path(self.spark, f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def commits(self) -> list[int]:
        return [int(n[:20]) for n in self._names("_commits") if n.endswith(".json") and n[:20].isdigit()]

    def current(self) -> dict | None:
        """The greatest commit: number, path, and what was said at the commit; None if there is none."""
        numbers = self.commits()
        body = read_bytes(self.spark, f"{self.root}/_commits/{numbers[-1]:020d}.json") if numbers else None
        return None if body is None else json.loads(body) | {"path": f"{self.root}/{json.loads(body)['folder']}"}

    def publish(self, write: Callable[[str], dict | None], check: Callable[[str], None] | None = None, on: int | None = None) -> dict:
        """write(folder) fills a new folder and may return what the commit says; check(folder) raises if it is not fit.

        on: the number that this version follows; by default the current one when it begins.
        """
        found = self.current()
        number = (on if on is not None else found["number"] if found else 0) + 1
        folder = f"v{number:08d}-{uuid.uuid4().hex}"
        try:
            said = write(f"{self.root}/{folder}") or {}
            if check is not None:
                check(f"{self.root}/{folder}")
            target = f"{self.root}/_commits/{number:020d}.json"
            fs, at = hadoop_path(self.spark, f"{self.root}/_commits")
            fs.mkdirs(at)
            beside = _beside(self.spark, target, json.dumps(said | {"number": number, "folder": folder}, sort_keys=True).encode())
            try:
                _rename(self.spark, beside, target, overwrite=False)
            except Exception as why:
                fs.delete(hadoop_path(self.spark, beside)[1], False)
                if number in self.commits():
                    raise Conflict(f"version {number} of {self.root} was committed by another writer") from why
                raise
        except BaseException:
            fs, at = hadoop_path(self.spark, f"{self.root}/{folder}")
            fs.delete(at, True)
            raise
        return said | {"number": number, "folder": folder, "path": f"{self.root}/{folder}"}

    @contextlib.contextmanager
    def reading(self) -> Iterator[dict | None]:
        """The current version, which collect() leaves alone until the end."""
        found = self.current()
        lease = f"{self.root}/_readers/{found['folder']}-{uuid.uuid4().hex}" if found else None
        if lease:
            write_bytes(self.spark, lease, b"")
        try:
            yield found
        finally:
            if lease:
                fs, at = hadoop_path(self.spark, lease)
                fs.delete(at, False)

    def collect(self, keep: int = 1) -> list[str]:
        """Removes folders of versions older than the last `keep` ones that no reader holds, with their commits, and what
        writers of such versions left behind; the names removed. A folder of a later number may be in the making and stays."""
        numbers = self.commits()
        if not numbers:
            return []
        held = {n.rsplit("-", 1)[0] for n in self._names("_readers")}
        alive = {json.loads(read_bytes(self.spark, f"{self.root}/_commits/{n:020d}.json"))["folder"] for n in numbers[-keep:]}
        gone = [n for n in self._names("") if n.startswith("v") and int(n[1:9]) <= numbers[-1] and n not in alive | held]
        for name in gone:
            fs, at = hadoop_path(self.spark, f"{self.root}/{name}")
            fs.delete(at, True)
        for n in numbers[:-keep]:
            fs, at = hadoop_path(self.spark, f"{self.root}/_commits/{n:020d}.json")
            if json.loads(read_bytes(self.spark, f"{self.root}/_commits/{n:020d}.json"))["folder"] in gone:
                fs.delete(at, False)
        return gone
