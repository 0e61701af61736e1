"""Summaries against plain Python, equality of runs, parity of evidence and values."""

import math
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserine.operators import evaluation as E
from tesserine.operators import summary as Z


def test_group_summary_against_python(spark):
    rows = [(i, ("a", "b", None)[i % 3], i % 7, i % 2 == 0 if i % 5 else None, float(i * i % 997) if i % 11 else None) for i in range(3000)] + [(i, "rare", 9, True, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, kind string, course int, ok boolean, seconds double").repartition(5)
    m = Z.Measures(rates={"ok": (F.col("ok"), None), "ok_odd": (F.col("ok"), F.col("i") % 2 == 1)}, means={"i_mean": F.col("i")}, totals={"fast": F.when(F.col("seconds") < 10, 1)}, seconds=("seconds",), hours={"t": "seconds"})
    got = {(r.dimension, r.value): r for r in Z.group_summary(df, {"kind": F.col("kind"), "course": F.col("course")}, m, {"course": 5}).collect()}
    groups = defaultdict(list)
    for r in rows:
        for key in (("all", "all"), ("kind", r[1] or "NOT_AVAILABLE"), ("course", str(r[2]))):
            groups[key].append(r)
    groups.pop(("course", "9"))
    assert set(got) == set(groups)
    for key, rs in groups.items():
        g, oks, sec = got[key], [r[3] for r in rs if r[3] is not None], sorted(r[4] for r in rs if r[4] is not None)
        odd = [r[3] for r in rs if r[3] is not None and r[0] % 2]
        assert (g.n, g.ok_n, g.ok_hits, g.ok_odd_n, g.ok_odd_hits) == (len(rs), len(oks), sum(oks), len(odd), sum(odd))
        assert g.fast == sum(x < 10 for x in sec) and g.seconds_n == len(sec)
        want = (statistics.mean(sec), statistics.median(sec), sec[math.ceil(0.95 * len(sec)) - 1], len(rs) / sum(sec) * 3600)
        assert all(abs(a - b) < 1e-4 for a, b in zip((g.seconds_mean, g.seconds_median, g.seconds_p95, g.t_per_hour), want)), (key, g, want)
    assert Z.group_summary(df.limit(0), {"kind": F.col("kind")}, m).count() == 0


def test_strict_run_equality(spark):
    kind = "k int, lang string, v int"
    a = spark.createDataFrame([(1, "en", 5), (2, None, 6), (None, "en", 7)], kind)
    b = spark.createDataFrame([(None, "en", 8), (1, "en", 4), (2, None, 6)], kind)
    assert E.set_digest(a, ["k", "lang"])[:3] == E.set_digest(b.repartition(3), ["k", "lang"])[:3]
    x, y = E.aligned_runs(a, b, ["k", "lang"])
    assert x is a and y is b
    for other in (b.where("k = 1"), b.withColumn("lang", F.coalesce("lang", F.lit("")))):
        with pytest.raises(E.RunsDiffer, match="only in the"):
            E.aligned_runs(a, other, ["k", "lang"])
    with pytest.raises(E.RunsDiffer, match="repeat"):
        E.aligned_runs(a, b.unionByName(b.limit(1)), ["k", "lang"], "aligned_subset")
    x, y = E.aligned_runs(a, b.where("k is null or k = 1"), ["k", "lang"], "aligned_subset")
    assert sorted(r.v for r in x.collect()) == [5, 7] and y.count() == 2
    assert {(r.k, r.side) for r in E.unmatched(a, b.where("k = 1"), ["k"]).collect()} == {(2, "first"), (None, "first")}
    assert E.set_digest(a.limit(0), ["k"]) == (0, 0, 0, 0)
    assert {r.change for r in E.compare_runs(a, b.where("k = 1"), "k", "v", "aligned_subset").collect()} == {"regressed"}


def test_full_parity(spark):
    rows = []
    for base, docs, answers, values, status in (
        ("same", ("d", "d", "d"), ("3 and 4", "4, 3", "3 4"), (["A", "b"], ["b", "a"], ["a", "B", "a"]), "sss"),
        ("other evidence", ("d", "d", "e"), ("3", "3", "3"), (["a"], ["a"], ["b"]), "sss"),
        ("other numbers", ("d", "d", "d"), ("3", "3 3", "3"), (None, ["a"], ["a"]), "sss"),
        ("no numbers", ("d", "d", "d"), ("x", "y", None), ([], [], []), "sss"),
        ("one short", ("d", "d", "d"), ("3", "3", "3"), (["a"], ["a"], ["a"]), "ss-"),
    ):
        rows += [(base, lang, s == "s", d, 1, a, v) for lang, d, a, v, s in zip("xyz", docs, answers, values, status)]
    df = spark.createDataFrame(rows, "base string, lang string, ok boolean, doc string, page int, answer string, vals array<string>")
    got = {r.base: (r.category, r.same_evidence, r.same_numbers, r.same_values) for r in E.full_parity(df, "base", "lang", F.col("ok"), F.col("ok"), F.struct("doc", "page"), F.col("answer"), F.col("vals"), ("x", "y", "z")).collect()}
    assert got == {
        "same": ("ALL_THREE", True, True, True), "other evidence": ("ALL_THREE", False, True, False), "other numbers": ("ALL_THREE", True, False, None),
        "no numbers": ("ALL_THREE", True, None, None), "one short": ("FIRST_AND_SECOND", None, None, None),
    }
