"""Queries held against their SQL on small tables of odd rows."""

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions import understanding as U
from tesserine.operators import retrieval as R
from tesserine.operators import structure as S
from tesserine.operators import traces as X
from tesserine.plans import registry

from .parity import plain


def differs(spark, tmp_path, name, **tables):
    """The query's rows and its SQL's over these tables (columns as DDL, rows), as sorted lists."""
    for t, (kinds, rows) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    return sorted([plain(r[c]) for c in columns] for r in df.collect()), sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())


def test_document_intents_ends_words_as_its_sql_does(spark, tmp_path):
    texts = ["domiue noñcobomente", "niño", "un niño no", "él dateé", "gradeñ", "", "plain words"]
    ours, theirs = differs(spark, tmp_path, "document_intents", documents=("doc_id long, text string", list(enumerate(texts))))
    assert ours == theirs


def test_document_intents_takes_letters_in_any_case_as_its_sql_does(spark, tmp_path):
    """Before, a dotless i was an "i", which it is not in the SQL."""
    texts = ["polıcy", "wıthout", "POLICY", "WITHOUT", "wa\u017fn't", "\u017fno", "it iſn't", "tıtle", "\u212a no", "attendance\x01 (x"]
    ours, theirs = differs(spark, tmp_path, "document_intents", documents=("doc_id long, text string", list(enumerate(texts))))
    assert ours == theirs


def test_whole_texts_are_searched_only_for_fields_whose_letters_they_have(spark):
    """Before, each pattern was tried on each text, which took most of the time."""
    said = "clo 3;course learning outcome;pre-requisites;prereq;attendance;e-mail;a@b.cd;credits;credit value;course title;course no.;code;course number;semesters;term;grades;cgpa;percentage;5 %;requirements;required;duration;years;months;weeks;days;topics;course content;content;covered;porano;policies;policy;rules;regulations;publishing;publisher;publication;who;dates;when;course type;type;objectives;course summary;uddesh;week 4;weekly plan;assessment;examination;marks;উপস্থিতি;নম্বর;tıtle".split(";")
    fields = [(n, p) for n in U.FIELD_ORDER for p in (*U.FIELD_WORDS[n], *U.QUESTION_WORDS.get(n, ()))]
    forms = [(r.text, r.form) for r in spark.createDataFrame([(t,) for t in said], "text string").select("text", U.retrieval_text(F.col("text")).alias("form")).collect()]
    rows = spark.createDataFrame(forms, "text string, form string").coalesce(1).select("text", U.requested_field(F.col("text")).alias("field"), F.array(*[U.matches(F.col("form"), p) for _, p in fields]).alias("found")).collect()
    met = set()
    for r in rows:
        first = [n for (n, _), yes in zip(fields, r.found) if yes]
        assert r.field == first[0], r.text
        met |= {p for (_, p), yes in zip(fields, r.found) if yes}
    assert {p for _, p in fields if p.isascii()} - met == {r"\bprereq\b"}  # a form that retrieval text replaces
    plan = spark.range(1).select(U.requested_field(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and len(U.FORM_LETTERS) == len(U.RETRIEVAL_FORMS)


def test_expanded_spans_fit_by_the_lengths_of_their_chunks(spark, tmp_path):
    # three windows of one document: 3600 characters in all, 3602 with the blanks between windows
    def chars(t):
        w = t.split()
        return sum(len(" ".join(w[s : s + 260])) for s in (0, 220, 440))

    words = ["abcde"] * 500
    while chars(" ".join(words)) < 3600:
        words[-1] += "x"
    t = " ".join(words)
    assert chars(t) == 3600
    ours, theirs = differs(spark, tmp_path, "expanded_spans", documents=("doc_id long, text string, source string", [(1, t, "s"), (2, t + "x", "s"), (3, t[:-1], "s"), (4, t[:-2], "s")]))
    assert ours == theirs and any(int(r[1]) == 3602 for r in ours)


def test_expanded_spans_move_texts_once(spark, tmp_path):
    """Before, texts were moved eight times, and each row of an id that is there twice met both."""
    texts = [" ".join(f"w{i * j % 97}" for j in range(n)) + end for i, (n, end) in enumerate([(3, ""), (30, ""), (30, "."), (259, ""), (260, ""), (261, ""), (480, "."), (481, "!"), (700, ""), (1400, " "), (0, "")])]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, texts[1], "s"), (2, texts[2], "s"), (4, texts[4], "t"), (40, "x" * 4000, "s"), (41, " ".join(["longer" * 4] * 300), "s"), (43, " ".join(["last"] * 240 + ["wordofmanyletters"] * 240), "s"), (44, " ".join(["last"] * 260), "s"), (None, texts[3], "s"), (42, None, None)]
    ours, theirs = differs(spark, tmp_path, "expanded_spans", documents=("doc_id long, text string, source string", rows))
    assert ours == theirs and {int(r[2]) for r in ours} >= {0, 1, 2}
    plan = registry.QUERIES["expanded_spans"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rule_rerank_components_reads_the_words_of_the_question(spark, tmp_path):
    docs = [(1, "ss and sü lichgete", "src1", "de"), (2, "schau strasse ss", "src2", "de"), (3, "no words", None, None)]
    asked = [(1, "lichgete ßü schau"), (2, "Straße ss")]
    ours, theirs = differs(spark, tmp_path, "rule_rerank_components", documents=("doc_id long, text string, source string, lang string", docs), benchmark=("item_id long, text string", asked))
    assert ours == theirs and ours


DOCUMENTS, BENCHMARK = "doc_id long, text string, lang string, source string", "item_id long, text string"
DOCS = [(i, f"common word w{i % 7} x{i % 11} " + "common " * (i % 4), ("en", "de", "fr", "es")[i % 4], f"src{i % 20}") for i in range(60)]
ASKED = [(i, f"common w{i} x{i + 3} rare{i}") for i in range(9)]


@pytest.mark.parametrize("limits", [{}, {"LITERALS": 1}, {"QUERY_BLOCK": 2, "TERM_BLOCK": 5, "SCORE_CELLS": 7}])
def test_bm25_topk_with_rows_of_one_id(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    twice = [DOCS[5], DOCS[5], (6, "common w6 of another length w6 x9 word word", "fr", "src6"), (77, None, "en", "src1")]
    ours, theirs = differs(spark, tmp_path, "bm25_topk", documents=(DOCUMENTS, DOCS + twice), benchmark=(BENCHMARK, ASKED))
    assert ours == theirs and len(ours) > 200


def test_bm25_shuffles_no_pairs_of_queries_and_chunks(spark):
    """Every chunk has the token that every query has: before, each pair of them was a row of the plan."""
    chunks = spark.createDataFrame([(i, "common") for i in range(500)], "chunk_id long, text string")
    queries = spark.createDataFrame([(i, "common") for i in range(40)], "query_id long, text string")
    found = R.bm25(chunks, queries, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [query_id" not in plan
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in found.collect()) == [(q, c, c + 1) for q in range(40) for c in range(3)]


def test_fusion_looks_only_at_texts_that_a_channel_names(spark):
    chunks = spark.createDataFrame([(i, f"text {i}", "d") for i in range(50)], "chunk_id long, text string, document_id string")
    named = spark.createDataFrame([(1,), (1,), (2,), (99,), (None,)], "chunk_id long")
    assert sorted(r.chunk_id for r in R.bodies(chunks, named).collect()) == [1, 2]


def test_queries_that_ask_for_the_same_share_a_ranking(spark, tmp_path):
    more = [(i, "x") for i in range(100)]
    ours, theirs = differs(spark, tmp_path, "metadata_topk", documents=(DOCUMENTS, DOCS * 12), benchmark=(BENCHMARK, more))
    assert len(ours) == len(theirs) == 2000
    chunks = spark.createDataFrame([(i, "A" if i % 2 else "b", None if i % 3 else "F", i) for i in range(20)], "chunk_id long, entity string, field string, page long")
    asked = spark.createDataFrame([(1, "a", "f"), (2, "A", "F"), (3, "B", None), (4, "", "f"), (5, "a", "f"), (5, "b", "f")], "query_id long, entity string, field string")
    found = R.metadata_candidates(chunks, asked, 4)
    got = {q: [r.chunk_id for r in found.where(f"query_id = {q}").orderBy("rank").collect()] for q in range(1, 6)}
    assert got == {1: [3, 9, 15, 1], 2: [3, 9, 15, 1], 3: [0, 2, 4, 6], 4: [], 5: [0, 3, 6, 9]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(key" in plan  # ranked once for what is asked, not for each query


def test_two_query_fusion_reads_the_chunks_once(spark, tmp_path, monkeypatch):
    calls, whole = [], R.tokenized
    monkeypatch.setattr(R, "tokenized", lambda *a, **k: calls.append(1) or whole(*a, **k))
    asked = [(i, f"common w{i} x{i + 3} more words w{i + 1} w{i + 2}") for i in range(9)]
    ours, theirs = differs(spark, tmp_path, "two_query_fusion", documents=(DOCUMENTS, DOCS), benchmark=(BENCHMARK, asked))
    assert ours == theirs and len(ours) == 90 and len(calls) == 1


def test_index_problems_in_one_pass_over_the_postings(spark):
    postings = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("", 2, 1), ("c", 3, 0), ("d", None, 1), ("e", 4, 5)], "token string, chunk_id long, tf long")
    lengths = spark.createDataFrame([(1, 3), (2, 9), (2, 1), (3, None), (7, 1)], "chunk_id long, dl long")
    found = X.index_problems(postings, lengths)
    assert found.first().asDict() == {"bad_postings": 2, "orphans": 2, "wrong_lengths": 1}
    assert X.index_problems(postings.limit(0), lengths).first().asDict() == {"bad_postings": 0, "orphans": 0, "wrong_lengths": 0}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_near_matches_of_copies_and_near_copies(spark, tmp_path, monkeypatch):
    """Before, each pair of copies was a row that carried both token sets."""
    rng, counted, keep = random.Random(3), {}, R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: counted.setdefault(name, keep(df, name)) if name in ("met", "classes") else keep(df, name))
    words = [f"tok{i}" for i in range(150)]
    bases = [rng.sample(words, 30) for _ in range(8)]
    texts = [" ".join(rng.choice([b, b[1:], b[:-1], b[:-2] + ["own"], b[2:] + [f"x{i % 9}", f"y{i % 5}"], list(reversed(b))])) for i, b in enumerate(bases * 12)]
    rows = [(i * 3 % 500 + 1, t) for i, t in enumerate(texts)] + [(600 + i, "one text of many copies") for i in range(60)] + [(700, ""), (701, None), (702, "the of"), (703, "alone")]
    ours, theirs = differs(spark, tmp_path, "jaccard_near_match", documents=("doc_id long, text string", rows))
    assert ours == theirs and len(ours) > 100
    classes = len({frozenset(t.split()) for _, t in rows if t}) - 1  # "the of" has no tokens that count
    assert counted["classes"].count() == classes and counted["met"].count() < classes * classes / 2


def test_near_matches_send_a_set_once_to_a_group_of_its_family(spark, tmp_path, monkeypatch):
    """Before, both sets went along with each pair; now with the groups, also where a family has several."""
    rng, counted, keep = random.Random(5), {}, R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: counted.setdefault(name, []).append(keep(df, name)) or counted[name][-1])
    words = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join([w for w in words if rng.random() > 0.06] + [f"own{i}"])) for i in range(70)] + [(100 + i, f"text {i} alone") for i in range(5)]
    for size in (256, 8):
        counted.clear()
        monkeypatch.setattr(R, "FAMILY_BLOCK", size)
        ours, theirs = differs(spark, tmp_path, "jaccard_near_match", documents=("doc_id long, text string", rows))
        assert ours == theirs and len(ours) > 60
        pairs, sent = (sum(x.count() for x in counted[n]) for n in ("to-score", "asked"))
        assert pairs > 300 and (size == 8 or sent <= 2 * 70)


def test_fields_of_a_block_are_those_of_their_patterns():
    odd = ["Course Code: ABC 101", "12/3/2020", "1-2-99", "1/2/2000 x", "must", "muſt", "polıcy", "POLİCY", "pre requisite", "10 %", "a@b.cc", "Credıts 3", "１２%", "course\ncontent", "", "REQUIRED"]
    for text in odd:
        assert S.field_types(text) == tuple(k for k, p in S.FIELDS.items() if p.search(text))
    for text in ["First Year Second Semester", "FINAL YEAR", "Firſt Year", "none"]:
        semester, year = S.SEMESTER.search(text), S.YEAR.search(text)
        assert S.semester_and_year(text) == (semester and semester.group(1), year and year.group())


def test_chunk_problems_parse_each_page_once(spark):
    """Before, the pages were parsed for each of three groups of rules, and a table of one partition by one task."""
    pages = spark.createDataFrame([(f"d{i}", 1, f"page number {i % 3} with some words") for i in range(30)], "document_id string, page int, text string").coalesce(1)
    blocks = S.blocks(pages)
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    found = S.quality_lists(S.chunks(blocks))
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.problem, r["count"]) for r in found.groupBy("problem").count().collect()} == {("very_short", 30), ("duplicate_text", 3)}


def test_evidence_cases_are_judged_by_all_tasks(spark, tmp_path):
    """Before, documents met the cases by a shuffle on eight keys, and small rows with much work were put into one task."""
    spark.createDataFrame([(i,) for i in range(40)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = registry.QUERIES["evidence_cases"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "hashpartitioning(case" not in plan


def test_tokens_of_texts_without_addresses_are_those_of_the_whole_pattern(spark):
    """Before, the pattern for addresses ran over each word of each text."""
    odd = ["a1b2 3c 12/3/99 4.5% 1-2", "আমি৫টি abcআমি আমিabc ১২ é", "ñandú-x_y z.w a+b 10%x", "", "x" * 40 + "1", "mail a.b@c.de x@y z@é.comic", "\u0964 \u09cd\u0995 k\u09be ａｂ", "abc 123 (x) ab-12"]
    whole = lambda t: F.regexp_extract_all(t, F.lit(T._TOKEN_JAVA), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", T.tokens(F.col("text")).alias("all"), whole(T._token_text(F.col("text"))).alias("whole")).collect()
    assert any(r["whole"] for r in rows) and all(r["all"][: len(r["whole"])] == r["whole"] for r in rows)
    plain = spark.createDataFrame([(t,) for t in odd if "@" not in t], "text string").select(F.lower("text").alias("t"))
    assert all(r.a == r.b for r in plain.select(F.regexp_extract_all("t", F.lit(T._TOKEN_PLAIN), F.lit(0)).alias("a"), whole(F.col("t")).alias("b")).collect())
