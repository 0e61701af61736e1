import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.config import RetrievalConfig
from tesserine.functions import text as T
from tesserine.operators import chunking as C
from tesserine.operators import evaluation as E
from tesserine.operators import retrieval as R


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    got = tokens(spark, "CSE 205: mail a.b@c.edu on 12-05-2024, 75.5% of ক্রেডিট")
    assert got[:10] == ["cse", "205", "mail", "a.b@c.edu", "on", "12-05-20", "24", "75.5%", "of", "ক্রেডিট"] and got[10:13] == ["cse", "205", "cse205"]
    assert tokens(spark, None) == [] and tokens(spark, "mat 101 (b)")[-5:] == ["mat", "101", "mat101", "b", "mat101b"]


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("x", "red red blue"), ("y", "blue"), ("z", None), ("w", "green tea")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "red blue red"), (2, ""), (3, "none such")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in R.bm25(chunks, q, 5).collect()}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.5))
    assert set(got) == {(1, "x"), (1, "y")}
    assert abs(got[1, "x"] - part(2, 3, 1) - part(1, 3, 2)) < 1e-9 and abs(got[1, "y"] - part(1, 1, 2)) < 1e-9
    assert R.bm25(chunks, q, 0).count() == 0 and R.bm25(chunks.limit(0), q, 3).count() == 0


def test_dense_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(rows[:7], "query_id long, embedding array<float>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    got = R.dense(vectors, queries, 4).orderBy("query_id", "rank").collect()
    for i in range(7):
        want = sorted(range(60), key=lambda j: -float(v[i].astype(float) @ v[j].astype(float)))[:4]
        assert [r.chunk_id for r in got if r.query_id == i] == want
    assert R.dense(vectors, queries.limit(0), 3).count() == 0


def test_fusion_by_hand(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")
    chunks = spark.createDataFrame([("a", "d", "one"), ("b", "d", "two"), ("c", "d", "ONE "), ("e", "d", "")], "chunk_id string, document_id string, text string")
    config = RetrievalConfig(rrf_k=10, metadata_weight=0.5)
    got = R.fuse(rank([(1, "a", 1), (1, "b", 2), (1, "", 3)]), rank([(1, "b", 1), (1, "c", 2)]), rank([(1, "e", 1), (1, "e", 3)]), chunks, config).orderBy("final_rank").collect()
    assert [(r.chunk_id, r.final_rank) for r in got] == [("b", 1), ("a", 2), ("e", 3)]
    assert abs(got[0].fusion_score - 1 / 12 - 1 / 11) < 1e-12 and abs(got[2].fusion_score - 0.5 / 11 - 0.5 / 13) < 1e-12 and got[2].metadata_rank == 3
    two = R.fuse_two(rank([(1, "a", 1)]), rank([(1, "b", 1), (1, "a", 2)]), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in two] == ["a", "b"] and two[1].original_rank is None


def test_windows(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(n, text(n)) for n in (0, 1, 10, 11, 17, 18, 24, 25)] + [(-1, None)], "doc_id long, text string")
    got = {}
    for r in C.windows(df, 10, 3).collect():
        got.setdefault(r.doc_id, []).append((r.word_start, r.word_end, r.text))
    for n in (1, 10, 11, 17, 18, 24, 25):
        want, s = [], 0
        while True:
            want.append((s, min(s + 10, n), " ".join(f"w{i}" for i in range(s, min(s + 10, n)))))
            if s + 10 >= n:
                break
            s += 7
        assert sorted(got[n]) == want
    assert 0 not in got and -1 not in got
    with pytest.raises(ValueError):
        C.windows(df, 5, 5)


def test_kappa_corners(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    assert E.kappa(frame([(1, None)]), "a", "b").first().kappa is None
    assert E.kappa(frame([(1, 1), (1, 1)]), "a", "b").first().kappa == 1.0
    assert E.kappa(frame([(0, 4), (4, 0)]), "a", "b", 5).first().kappa == -1.0
    assert E.kappa(frame([(0, 0), (1, 1), (0, 1), (1, 0)]), "a", "b").first().kappa == 0.0


def test_proxies_and_hits(spark):
    p = spark.createDataFrame([(1, "Pay 10 or 12 now", "pay 12"), (2, "", ""), (3, "a b", None)], "pair_id int, reference string, answer string")
    got = {r.pair_id: r for r in E.proxies(p).collect()}
    assert (got[1].token_precision, got[1].token_recall, got[1].numbers_kept) == (1.0, 0.4, False)
    assert (got[2].token_f1, got[2].exact_match, got[2].numbers_kept) == (0.0, True, None) and got[3].token_recall == 0.0
    r = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (3, 4, True)], "query_id int, rank int, ok boolean")
    h = {x.query_id: x for x in E.hits(r, F.col("ok")).collect()}
    assert (h[1].hit_1, h[1].hit_3, h[1].mrr) == (False, True, 0.5) and h[2].mrr == 0.0 and not h[3].hit_3


def test_lexical_scores_by_hand(spark):
    texts = [("a", "CSE 205 Course Content: sets. cse205"), ("b", "The content of tables"), ("c", "Week 3 weekly plan of trees"), ("d", None), ("e", "Boolean Algebra: gates"), ("f", "Final Exam (50%) evaluation policy")]
    asked = [(1, "topics of CSE 205"), (2, "week 3 trees?"), (3, "What is covered under Boolean Algebra?"), (4, "final exam marks percentage"), (5, "zzz"), (6, None)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    got = {(r.query_id, r.chunk_id): r.score for r in R.lexical(chunks, spark.createDataFrame(asked, "query_id int, text string"), 3).collect()}
    # a: cse and 205 are words (4), the code (6), course content (10); c: week, trees (4), weekly plan (10), week 3 (18)
    assert got[1, "a"] == 20.0 and got[2, "c"] == 32.0 and got[3, "e"] == 2 + 2 + 12 and got[4, "f"] == 4 + 12 + 10 + 20 and not any(q in (5, 6) for q, _ in got)
    assert R.lexical(chunks, spark.createDataFrame(asked, "query_id int, text string"), 0).count() == 0


def test_rule_components_by_hand(spark):
    rows = [
        (1, "a", "prerequisite of CSE 205", "Course Code: CSE 205 Prerequisite: CSE 101", 0.5), (1, "b", "prerequisite of CSE 205", "Course Code: CSE 301 Prerequisite: MAT 101", 0.6), (1, "c", "prerequisite of CSE 205", "Course Title only", 0.4),
        (2, "a", "week 3 of trees", "Weekly plan Week 3 trees CLO1", 0.1), (3, "a", "credit of CSE 205", None, 0.1),
    ]
    got = {(r.query_id, r.chunk_id): r for r in R.rerank_components(spark.createDataFrame(rows, "query_id int, chunk_id string, query string, text string, score double")).collect()}
    a, b, c = got[1, "a"], got[1, "b"], got[1, "c"]
    assert (a.course_boost, a.intent_boost, a.section_boost, a.penalty, a.rank) == (1.0, 0.8, 0.9, 0.0, 1) and (b.course_boost, b.penalty) == (0.0, -1.0) and (c.metadata_penalty, c.intent_boost) == (-1.6, 0.0)
    assert abs(a.final_score - (0.5 + 1.0 + 0.8 + 0.9 + a.lexical_boost)) < 1e-9 and a.lexical_boost == 0.36
    w = got[2, "a"]
    assert (w.field_boost, w.topic_plan_boost, w.intent_boost) == (3.2, 2.2, 0.8) and got[3, "a"].final_score == 0.1


def test_jaccard_matches_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    words = [f"tok{i}" for i in range(60)]
    base = [set(rng.choice(words, 20, replace=False)) for _ in range(30)]
    sets = base + [set(sorted(s)[rng.integers(0, 3) :]) | {f"own{i}"} for i, s in enumerate(base)] + [set()]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "item_id int, text string")
    got = {(r.query_id, r.item_id): r.score for r in R.jaccard_pairs(df, df.toDF("query_id", "text"), 0.8).collect()}
    want = {(i, j): round(len(a & b) / len(a | b), 9) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= 0.8}
    assert got == want and len(want) > len(sets)


def test_quantiles_of_skewed_groups(spark):
    rng = np.random.default_rng(7)
    groups = {"a": [5.0] * 4000 + list(rng.normal(size=3001)), "b": [1.0], "c": [1.0, 2.0], None: list(range(1, 41)), "d": list(rng.integers(0, 3, 999))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("e", None)], "g string, v double").repartition(5)
    got = {r.g: r for r in E.latency_summary(df, ["g"], "v").collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        own = sorted(map(float, vs))
        assert abs(got[g].median - float(np.median(own))) < 1e-6 and abs(got[g].p95 - own[math.ceil(0.95 * len(own)) - 1]) < 1e-6


def test_lexical_against_every_rule_tried(spark, monkeypatch):
    """All rules on all texts, terms counted by plain search; queries in several blocks, words not remembered for long."""
    texts = [
        "CSE 205 Course Content: Boolean Algebra: gates 3.5 x_trees trees", "cſe205 courſe content week", "WEEK 3 weekly plan of trees, CLO 2 and CLO2", "Course Learning Outcomes CLO 1", "Final Exam (50%) Evaluation Policy", "Clasſ Tests 20 %",
        "Mid-Term Examination: 30.5%", "course\nobjectives of the course", "Алгебра: ряды и алгебра", "trees" * 40, "", None, "বুলিয়ান বীজগণিত trees_3 3.55", "Term\tExamination 40 %", "alignment of topics; weighting",
    ]
    asked = ["topics of CSE 205", "week 3 trees?", "What is covered under Boolean Algebra?", "final exam marks percentage", "mark distribution of CSE 205", "course objectives of CSE205", "What is CLO 2 of CSE 205?", "assessment policy 3.5", "weekly plan", "বুলিয়ান বীজগণিত কী", "", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").repartition(2)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    want = {}
    for q in R.profile(queries).collect():
        q = q.asDict()
        for i, text in enumerate(texts):
            text = text or ""
            low = f" {text.lower()} "
            beside = lambda c: c == "_" or c.isalnum()
            alone = lambda t: any(low.startswith(t, i) and not beside(low[i - 1]) and not beside(low[i + len(t)]) for i in range(1, len(low) - len(t)))  # noqa: B023, E731
            plain = sum((t in low) + alone(t) for t in q["terms"])
            if plain:
                want[q["query_id"], i] = plain + sum(next((w for p, w, _ in rule if re.search(p, text, re.I)), 0.0) for rule in R._earned(q))
    monkeypatch.setattr(R, "TERM_BLOCK", 5)
    got = {(r.query_id, r.chunk_id): r.score for r in R.lexical(chunks, queries, 99).collect()}
    assert got == want and len({q for q, _ in want}) > 6


def test_failure_causes_by_hand(spark):
    from tesserine.operators import labels as L

    good, bad = ("a.pdf", "4", "CSE 205 Credit Value 3"), ("b.pdf", "9", "nothing")
    ask = "What is the credit of CSE 205?"
    cases = [  # question, normalized, language, pages, candidates (channel, rank, what), cause by fused, normalized, reranked
        (ask, None, "english", ["4"], [("final", 3, good)], None, None, None),
        (ask, None, "bangla", ["4"], [("final", 4, good)], "BOTH_MISSED", "LANGUAGE_DETECTION_ERROR", "LANGUAGE_NORMALIZATION_ERROR"),
        (ask, None, "english", ["4", "5"], [], "LABEL_AMBIGUITY", "GROUND_TRUTH_LABEL_AMBIGUITY", "GROUND_TRUTH_LABEL_AMBIGUITY"),
        (ask, "What is the credit?", "english", ["4"], [("dense", 1, good), ("sparse", 2, good)], "ENTITY_METADATA_MISSED", "QUERY_NORMALIZATION_ERROR", "ENTITY_ERROR"),
        (ask, None, "english", ["4"], [("sparse", 2, good), ("final", 1, bad)], "DENSE_MISSED", "DENSE_CANDIDATE_MISS", "ENTITY_ERROR"),
        (ask, None, "english", ["4"], [("dense", 2, good), ("final", 1, ("b.pdf", "9", "CSE-205"))], "SPARSE_MISSED", "SPARSE_CANDIDATE_MISS", "FIELD_ERROR"),
        (ask, None, "english", ["4"], [("dense", 2, good), ("sparse", 1, good)], "ENTITY_METADATA_MISSED", "ENTITY_RESOLUTION_ERROR", "ENTITY_ERROR"),
        (ask, None, "english", ["4"], [("dense", 2, good[:2] + (None,)), ("sparse", 1, good[:2] + ("",)), ("metadata", 1, bad)], "FIELD_METADATA_MISSED", "FIELD_RESOLUTION_ERROR", "ENTITY_ERROR"),
        (ask, None, "english", ["4"], [("dense", 2, good), ("sparse", 1, good), ("metadata", 1, bad), ("final", 1, ("a.pdf", "5", "cse205 credit value 3"))], "FUSION_RANK_ERROR", "FUSION_ERROR", "RERANKER_ORDERING_ERROR"),
        (ask, None, "english", None, [], "BOTH_MISSED", "DENSE_CANDIDATE_MISS", "FIRST_STAGE_CANDIDATE_MISS"),
    ]
    expected = spark.createDataFrame([(i, c[0], c[1], c[2], "a.pdf", c[3]) for i, c in enumerate(cases)], "query_id int, question string, normalized string, language string, source string, pages array<string>")
    found = spark.createDataFrame([(i, ch, rank, *what) for i, c in enumerate(cases) for ch, rank, what in c[4]], "query_id int, channel string, rank int, source string, page string, text string")
    got = L.failure_signals(expected, found).select("query_id", *[L.failure_cause(n).alias(n) for n in L.CAUSES]).orderBy("query_id").collect()
    assert [(r.query_id, r.fused, r.normalized, r.reranked) for r in got] == [(i, *c[5:]) for i, c in enumerate(cases)]
    judged = L.failure_signals(expected, found.withColumn("supported", F.lit(False))).where("query_id = 8").select(L.failure_cause("normalized").alias("c")).first()
    assert judged.c == "FIELD_RESOLUTION_ERROR"
    counted = {(r.level, r.of): r.asDict() for r in L.histogram(spark.createDataFrame([("x", "A"), ("x", None), (None, "B")], "g string, v string"), "v", ["g"], ["A", "C"]).collect()}
    assert counted["all", None] == {"level": "all", "of": None, "n_A": 1, "n_C": 0, "other": 2, "total": 3} and counted["g", "x"]["other"] == 1 and counted["g", None]["total"] == 1


def test_gold_rows_are_all_there_once(spark):
    from tesserine.operators import labels as L

    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "question_id string")
    gold = frame(["a", "b", "c", "c"])
    assert L.with_gold(frame(["a", "a", "b"]), gold).count() == 3 and L.with_gold(frame([]), gold).count() == 0
    for wrong in (["a", "z"], ["c"], [None]):
        with pytest.raises(ValueError):
            L.with_gold(frame(wrong), gold)
