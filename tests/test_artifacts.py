"""Versions behind commits, files replaced in one step, scratch scopes, ordinals of whole tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tesserine import storage
from tesserine.operators import index_store, ordinals
from tesserine.sources import files


def test_a_failure_between_the_steps_keeps_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    files.write_csv(spark.range(3), root)
    old = files.csv_folder(spark, root)

    def broken(*args, **kwargs):
        raise OSError("the machine stopped")

    monkeypatch.setattr(storage, "_rename", broken)
    with pytest.raises(OSError):
        files.write_csv(spark.range(5), root)
    monkeypatch.undo()
    assert files.csv_folder(spark, root) == old and files.read_csv(spark, old + "/*.csv").count() == 3
    assert len([n for n in os.listdir(root) if n.startswith("v")]) == 1
    files.write_csv(spark.range(5), root)
    assert files.read_csv(spark, files.csv_folder(spark, root) + "/*.csv").count() == 5
    path = str(tmp_path / "one.json")
    storage.write_bytes(spark, path, b"old")
    monkeypatch.setattr(storage, "_rename", broken)
    with pytest.raises(OSError):
        storage.write_bytes(spark, path, b"new")
    monkeypatch.undo()
    assert storage.read_bytes(spark, path) == b"old" and not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]
    storage.write_bytes(spark, path, b"new")
    assert storage.read_bytes(spark, path) == b"new"


def test_versions(spark, tmp_path):
    v = storage.Versions(spark, str(tmp_path / "artifact"))
    assert v.current() is None and v.collect() == []
    write = lambda n: lambda folder: spark.range(n).write.parquet(f"{folder}/t")
    first = v.publish(write(1))
    with pytest.raises(ValueError):
        v.publish(write(2), lambda folder: (_ for _ in ()).throw(ValueError("unfit")))
    assert v.current()["number"] == 1 and v.current()["path"] == first["path"]
    with v.reading() as held:
        v.publish(write(2))
        with pytest.raises(storage.Conflict):  # a writer that began on version 1
            v.publish(write(3), on=1)
        assert v.collect() == [] and spark.read.parquet(f"{held['path']}/t").count() == 1
    os.makedirs(tmp_path / "artifact" / "v00000001-left-by-a-writer-that-stopped")
    assert len(v.collect()) == 2 and v.commits() == [2] and spark.read.parquet(f"{v.current()['path']}/t").count() == 2
    assert v.publish(write(4))["number"] == 3 and v.collect(keep=2) == []


def test_scope_keeps_the_disk_flat(spark):
    at = storage.shared_dir(spark)
    with storage.scope():
        outer = storage.stored(spark.range(3), "outer")
        for _ in range(3):
            before = set(os.listdir(at))
            with storage.scope():
                assert storage.stored(spark.range(2), "inner").count() == 2
            assert set(os.listdir(at)) == before
        assert outer.count() == 3


def test_ordinals(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("tie"), F.lit(2).alias("place"))
    found = []
    for parts in (1, 8):
        df = ordinals.numbered(rows.repartition(parts), [F.col("k")], "row", 10)
        assert "SinglePartition" not in df._jdf.queryExecution().toString()
        found.append(sorted((r.row, r.k, r.id) for r in df.collect()))
    assert found[0] == found[1] and [r[0] for r in found[0]] == list(range(10, 2010)) and [r[1] for r in found[0]] == sorted(r[1] for r in found[0])
    assert ordinals.numbered(rows.limit(0), [F.col("k")]).count() == 0
    chunks = spark.createDataFrame([("b", "B.pdf", 2, "x"), ("a", "b.PDF", 1, None), ("c", None, None, "z"), ("d", "a.pdf", 9, "w")], "chunk_id string, relative_path string, page int, text string")
    assert [(r.chunk_id, r.vector_row) for r in ordinals.embedding_rows(chunks).orderBy("vector_row").collect()] == [("c", 0), ("d", 1), ("a", 2), ("b", 3)]


def test_vectors_are_bound_to_rows_and_texts(spark, tmp_path):
    chunks = spark.createDataFrame([("x", "red"), ("y", "blue")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    path = str(tmp_path / "index")
    index = index_store.build_sparse(chunks, path, vectors=vectors)
    assert {(r.chunk_id, r.vector_row) for r in index_store.load_vectors(index, chunks).collect()} == {("x", 0), ("y", 1)}
    with pytest.raises(index_store.IndexMismatch):
        index_store.load_vectors(index, chunks.withColumn("text", F.upper("text")))
    assert json.loads(storage.read_bytes(spark, f"{index.path}/manifest.json"))["vector_count"] == 2
