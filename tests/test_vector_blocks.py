import numpy as np
import pytest

from tesserine.operators import retrieval as R
from tesserine.operators import vector_blocks as B


def rows_of(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def clustered(hot=400):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 4
    sizes = [hot] + [40] * 11
    rows = np.concatenate([m + rng.normal(size=(n, 16)) * 0.05 for m, n in zip(middles, sizes)])
    rows[5] = rows[6] = rows[7]  # ties
    return rows.astype(np.float32)


def frame(spark, rows, name="chunk_id", kind="long"):
    own = [(f"c{i:04}" if kind == "string" else i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(own, f"{name} {kind}, embedding array<float>").repartition(4)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_equals_flat_search_and_reads_less(spark, tmp_path, kind, monkeypatch):
    rows = clustered()
    vectors, queries = frame(spark, rows, kind=kind), frame(spark, rows[::37], "query_id")
    index = B.build(vectors, str(tmp_path / "v"), cells=12)
    monkeypatch.setattr(R, "QUERY_BLOCK", 9)
    got, report = index.search_reported(queries, 7)
    assert rows_of(got) == rows_of(R.dense(vectors, queries, 7))
    assert report.vectors == len(rows) and report.products < len(rows) * len(rows[::37]) / 2
    one, seen = B.load(spark, str(tmp_path / "v")).search_reported(queries.where("query_id = 14"), 7)
    assert rows_of(one) == rows_of(R.dense(vectors, queries.where("query_id = 14"), 7)) and seen.blocks_read < seen.blocks / 2


def test_vectors_without_structure(spark, tmp_path):
    rows = np.random.default_rng(5).normal(size=(300, 8)).astype(np.float32)
    vectors, queries = frame(spark, rows), frame(spark, rows[:20], "query_id")
    for cells, rings in ((1, 1), (5, 3)):
        index = B.build(vectors, str(tmp_path / f"v{cells}"), cells=cells, rings=rings)
        for k in (1, 10, 400):
            assert rows_of(index.search(queries, k)) == rows_of(R.dense(vectors, queries, k))


def test_nulls_other_sizes_and_empty_tables(spark, tmp_path):
    rows = [[1.0, 0.0], None, [1.0, float("nan")], [1.0, 2.0, 3.0], [0.0, 1.0], [1.0, 0.0]]
    index = B.build(frame(spark, rows), str(tmp_path / "v"))
    queries = frame(spark, [[1.0, 0.0], None, [1.0, 2.0, 3.0]], "query_id")
    assert index.said["vectors"] == 3 and index.said["left_out"] == 3
    assert [(q, c) for q, _, c, _ in rows_of(index.search(queries, 5))] == [(0, 0), (0, 5), (0, 4)]
    assert index.search(queries.limit(0), 5).count() == 0 and index.search(queries, 0).count() == 0
    empty = B.build(frame(spark, rows).limit(0), str(tmp_path / "e"))
    assert empty.search(queries, 5).count() == 0 and B.load(spark, str(tmp_path / "e")).said["vectors"] == 0
    with pytest.raises(ValueError):
        B.load(spark, str(tmp_path / "none"))


def test_pruned_files_are_not_opened(spark, tmp_path):
    rows = clustered()
    index = B.build(frame(spark, rows), str(tmp_path / "v"), cells=12)
    names = np.array([r[0] for r in spark.read.parquet(f"{index.path}/blocks").orderBy("block").select("block").collect()])
    wanted = np.zeros((1, len(names)), bool)
    wanted[0, 0] = True
    plan = index._against(np.array([0]), rows[:1].astype(float), names, wanted, 3, "query_id long, chunk_id long, score double")
    assert "PartitionFilters: [isnotnull(block" in (text := plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) or "PartitionFilters: [(block" in text or "PartitionFilters: [block" in text
