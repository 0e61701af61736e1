import pytest
from pyspark.sql import functions as F

from tesserine.operators import ingest
from tesserine.sources import files
from tesserine.streaming import telemetry


def test_csv_headers(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('﻿id,question\n1,"a, ""b"""\n2,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(good), ["id"]).collect()
    assert [(r.id, r.question) for r in rows] == [("1", 'a, "b"'), ("2", None)]
    with pytest.raises(files.HeaderError):
        files.read_csv(spark, str(good), ["answer"])
    bad = tmp_path / "bad.csv"
    bad.write_text("id,id\n1,2\n")
    with pytest.raises(files.HeaderError):
        files.read_csv(spark, str(bad))


def test_aliases_labels_and_languages(spark):
    df = spark.createDataFrame([(" ", "x", "a;b | a", "q1", None), ("y", "z", '["p","q"]', "q2", "frage")], "id string, question_id string, pages string, english string, german string")
    got = files.aliased(df, {"id": ["id", "question_id"], "none": ["missing"]}).collect()
    assert [(r.id, r.none) for r in got] == [("x", None), ("y", None)]
    assert [r.v for r in df.select(files.labels(F.col("pages")).alias("v")).collect()] == [["a", "b"], ["p", "q"]]
    assert files.per_language(df, "question_id", {"en": "english", "de": "german"}).count() == 3


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "run")
    rows = spark.range(10).withColumnRenamed("id", "key")
    files.write_checkpoint(rows.where("key < 5"), path, 1, "r1")
    files.write_checkpoint(rows.where("key >= 5 and key < 8"), path, 2, "r1")
    done = files.read_checkpoint(spark, path, "key", "r1")
    assert sorted(r.key for r in ingest.without_known(rows, done, "key").collect()) == [8, 9]
    files.write_checkpoint(rows.where("key = 1"), path, 4, "r1")
    with pytest.raises(files.CheckpointError):
        files.read_checkpoint(spark, path, "key", "r1")


def test_publish_keeps_the_old_version(spark, tmp_path):
    root = str(tmp_path / "index")
    files.publish({"t": spark.range(3)}, root, lambda t: None)

    def refuse(tables):
        raise ValueError("too small")

    with pytest.raises(ValueError):
        files.publish({"t": spark.range(1)}, root, refuse)
    assert files.current(spark, root)["t"].count() == 3
    assert files.markdown(spark.range(1)).startswith("| id |")


def test_discovery(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"same")
    (tmp_path / "y.pdf").write_bytes(b"same")
    (tmp_path / "z.txt").write_bytes(b"no")
    got = ingest.discover(spark, str(tmp_path)).collect()
    assert sorted(r.relative_path for r in got) == ["a/x.PDF", "y.pdf"] and len({r.sha256 for r in got}) == 1
    assert len({r.document_id for r in got}) == 2 and all(len(r.document_id) == 28 for r in got)


def test_discovery_of_odd_names(spark, tmp_path):
    """Any case of the suffix, regex characters in the base path, and none at all."""
    plain = tmp_path / "one.two+(three)"
    (plain / "sub").mkdir(parents=True)
    for name in ("x.Pdf", "sub/y%20z+.pDF"):
        (plain / name).write_bytes(name.encode())
    assert sorted(r.relative_path for r in ingest.discover(spark, str(plain)).collect()) == ["sub/y%20z+.pDF", "x.Pdf"]
    assert sorted(r.relative_path for r in ingest.discover(spark, f"file://{plain}/").collect()) == ["sub/y%20z+.pDF", "x.Pdf"]
    with pytest.raises(FileNotFoundError):
        ingest.discover(spark, str(plain), "docx")


def test_streaming_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("event_id < 300").union(events.where("event_id < 10")).coalesce(1).write.parquet(src)
    for more in (False, True):
        if more:
            events.where("event_id >= 300").coalesce(1).write.mode("append").parquet(src)
        telemetry.run_to_end(telemetry.unique(spark.readStream.schema(events.schema).parquet(src), late="1000 days"), out, ck)
    assert spark.read.parquet(out).count() == events.count()
    assert telemetry.windowed(events).count() > 0 and telemetry.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("t", F.col("id").cast("string"))
    one, two, other = (ingest.fingerprint(x, ["id", "t"]).first() for x in (a, a.orderBy(F.desc("id")), a.where("id < 99")))
    assert one == two and one.fingerprint != other.fingerprint and other.rows == 99
