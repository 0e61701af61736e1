import zipfile

import pytest
from pyspark.sql import functions as F

from tesserine import storage
from tesserine.operators import index_store, ingest, labels, review, runs, structure
from tesserine.operators import retrieval as R
from tesserine.sources import files


def test_retrieval_labels(spark):
    expected = [
        (1, "What is CSE 101 credit?", ["a.pdf", "b.pdf"], ["4", "8"], []), (2, "What is CSE 101 credit?", [], [], []),
        (3, "Which page?", ["a.pdf", "b.pdf"], ["4", "8"], [("a.pdf", "4"), ("b.pdf", "8")]), (4, "x", ["a.pdf"], [], []), (5, "y", ["A.PDF"], ["2"], None),
    ]
    candidates = [(1, 1, "b.pdf", "docs/b.pdf", 8, "CSE 101 credit 3", None), (2, 1, "b.pdf", None, 8, "x", None), (3, 1, "a.pdf", None, 8, "unrelated", None), (5, 1, "z.pdf", None, 2, "", None), (5, 2, "z.pdf", "dir\\a.pdf", 2, "", None)]
    e = spark.createDataFrame(expected, "query_id long, question string, sources array<string>, pages array<string>, pairs array<struct<source:string,page:string>>")
    c = spark.createDataFrame(candidates, "query_id long, rank int, source string, relative_path string, page int, text string, field_types array<string>")
    got = {r.query_id: r for r in labels.scores(c, e).collect()}
    assert (got[1].hit_1, got[1].page_accuracy, got[1].entity_hit_1, got[1].field_hit_3) == (True, True, True, True)
    assert got[2].hit_1 is None and got[2].mrr_3 is None and got[2].entity_hit_1 is False and got[3].hit_1 is False
    assert (got[4].hit_1, got[4].mrr_3, got[4].page_accuracy) == (False, 0.0, None) and (got[5].hit_1, got[5].hit_3, got[5].mrr_3) == (False, True, 0.5)
    r = {x.measure: x for x in labels.rates(labels.scores(c, e), [], ["hit_1", "entity_hit_1"]).collect()}
    assert (r["hit_1"].numerator, r["hit_1"].denominator, r["entity_hit_1"].denominator) == (1, 4, 2)
    b = labels.breakdowns(spark.createDataFrame([("en", "x", 1.0), ("en", "", 0.0), ("de", "x", None)], "l string, i string, m double"), ["l", "i"], ["m"], {"l": 2}).collect()
    assert {(x.dimension, x.value): (x.n, x.mean_m) for x in b} == {("overall", "all"): (3, 0.5), ("l", "en"): (2, 0.5), ("i", "x"): (2, 1.0)}
    pages = spark.createDataFrame([("4;8",), ("4, 8,x",), (None,)], "v string").select(labels.expected_pages(F.col("v")).alias("p"), labels.expected_pages(F.col("v"), False).alias("q")).collect()
    assert [x.p for x in pages] == [["4", "8"], ["4", "8"], []] and pages[1].q == ["4", "8", "x"]


def test_configurations_and_selections(spark):
    s = spark.createDataFrame([("base", 0.5, 0.9), ("better", 0.6, 0.895), ("greedy", 0.9, 0.5)], "name string, mrr double, hit double")
    assert labels.best_configuration(s, "name", ["mrr"], ["hit"], "base").first()["name"] == "better"
    c = spark.createDataFrame([(1, i, i, v) for i, v in enumerate([0.1, 0.2, 0.9, 0.5], 1)], "query_id int, chunk_id int, rank int, semantic_score double")
    assert [r.chunk_id for r in labels.legacy_selection(c, 3).orderBy("place").collect()] == [1, 3, 4]
    d = labels.summary_delta(s.where("name = 'base'"), s.where("name = 'better'"), ["mrr", "hit"])
    assert {r.measure: r.delta for r in d.collect()} == {"mrr": 0.1, "hit": -0.005}
    near = labels.paired_depths(spark.createDataFrame([(1, [7])], "question_id int, chunk_ids array<int>"), spark.createDataFrame([(1, "bn", 7, 5), (1, "bl", 8, 1)], "question_id int, language string, chunk_id int, rank int"))
    assert {r.language: (r.within_3, r.within_10) for r in near.collect()} == {"bn": (False, True), "bl": (False, False)}


def test_human_review(spark):
    rows = [(f"A{i}:{x}", x, "s" if i % 2 else "t", "SUPPORTED", "i", "easy", "sys") for x in ("en", "bn", "bl") for i in range(10)]
    df = spark.createDataFrame(rows, "evaluation_id string, language string, answer_strategy string, answerability_status string, intent string, difficulty string, system_id string")
    got = review.sample(df, 14, 5).collect()
    per = [sum(r.language == x for r in got) for x in ("en", "bn", "bl")]
    assert len(got) == 14 and sorted(per) == [4, 5, 5] and all(abs(sum(r.language == x and r.answer_strategy == "s" for r in got) - n / 2) <= 1 for x, n in zip(("en", "bn", "bl"), per))
    assert {r.evaluation_id for r in review.sample(df, 14, 5).collect()} == {r.evaluation_id for r in got} and review.sample(df, 99).count() == 30
    hidden, key = review.blinded(review.sample(df, 4))
    assert not {"evaluation_id", "answer_strategy", "system_id"} & set(hidden.columns) and hidden.count() == key.count() == 4
    back = review.unblinded(hidden, key)
    assert all(r.evaluation_id.startswith("sys::A") for r in back.collect())
    with pytest.raises(review.ReviewError):
        review.unblinded(hidden, key.union(key))
    with pytest.raises(review.ReviewError):
        review.unblinded(hidden, key.limit(2))
    cells = [("A1", "r1", "5", "PASS", "ACCEPT"), ("A1", "r2", "5", "FAIL", "ACCEPT"), ("A2", "r1", "1", "PASS", "REJECT"), ("A2", "r2", "2", "", "REJECT"), ("A3", "r1", "6", "maybe", "ACCEPT"), ("A9", "r1", "", "", ""), ("A1", "r1", "4", "", "")]
    reviews = spark.createDataFrame(cells, "evaluation_id string, reviewer_id string, correctness string, semantic_consistency string, overall_acceptability string")
    for c in review.SCORES[1:]:
        reviews = reviews.withColumn(c, F.lit(None).cast("string"))
    known = spark.createDataFrame([("A1",), ("A2",), ("A3",)], "evaluation_id string")
    assert sorted((r.evaluation_id, r.problem) for r in review.problems(reviews, known).collect()) == [("A1", "duplicate_review"), ("A3", "correctness_not_1_to_5"), ("A3", "semantic_consistency_not_allowed"), ("A9", "unknown_evaluation_id")]
    good = reviews.limit(4)
    m = review.metrics(good).first()
    assert (m.n, m.mean_correctness, m.semantic_pass_rate, m.accept_rate, m.mean_relevance) == (4, 3.25, 0.666667, 0.5, None) and review.metrics(good, ["reviewer_id"]).count() == 0
    a = {r.field: r for r in review.agreement(good).collect()}
    assert a["overall_acceptability"].kappa == 1.0 and a["semantic_consistency"].n == 1 and a["correctness"].n == 2 and a["relevance"].n == 0


QUESTIONS = "question_id,english_question,bangla_question,expected_source,expected_page,expected_evidence,ground_truth_status,ground_truth_answer_en\n"


def test_datasets_and_runs(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(QUESTIONS + 'q1,What is x?,এক্স কী?,a.pdf;b.pdf,4;8,"[{""source"":""a.pdf"",""page"":""4""}]",verified,y\nq2,Why?,,,,,,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(path))
    assert runs.dataset_problems(rows).count() == 0
    asked, manifest = runs.prepare(rows)
    got = {r.evaluation_id: r for r in asked.collect()}
    assert got.keys() == {"q1:english", "q1:bangla", "q2:english"} and got["q1:bangla"].expected_pages == ["4", "8"] and got["q1:english"].expected_evidence[0].source == "a.pdf" and got["q2:english"].annotation_status == "unlabeled"
    assert runs.prepare(rows, saved=manifest)[1] == manifest
    for bad in ({"mode": "retrieval_only", "saved": manifest}, {"classification": "FINAL_BENCHMARK", "limit": 1}, {"every": 0}):
        with pytest.raises(runs.RunError):
            runs.prepare(rows, **bad)
    broken = spark.createDataFrame([("q1", "same", "0;2", "x", "a;;b", "[1]"), ("q1", "same", "1", "verified", None, None), ("q3", " ", None, None, None, None), ("q4", "Ã©", None, None, None, None)], "question_id string, english_question string, expected_page string, ground_truth_status string, expected_source string, expected_evidence string")
    assert {(r.question_id, r.problem) for r in runs.dataset_problems(broken).collect()} >= {("q1", "invalid_page"), ("q1", "unknown_annotation"), ("q1", "blank_label"), ("q1", "invalid_evidence"), ("q1", "repeated_question_id"), ("q1", "repeated_question"), ("q3", "no_question"), ("q4", "broken_letters")}
    answers = spark.createDataFrame([("q1:english", "SUPPORTED", "y", True, None, ["x"], None, None), ("q1:bangla", "SUPPORTED", "y", True, "RuntimeError: no", [], None, None)], "evaluation_id string, status string, answer string, allowed boolean, error string, excerpts array<string>, relation string, relation_values array<string>")
    out = {r.evaluation_id: r for r in runs.inference_rows(asked, answers, "r1").collect()}
    assert (out["q1:english"].answer_returned, out["q1:bangla"].answerability_status, out["q1:bangla"].error_type, out["q2:english"].answerability_status) == (True, "SYSTEM_ERROR", "RuntimeError", "SYSTEM_ERROR")
    frozen = str(tmp_path / "freeze.json")
    runs.dataset_freeze(spark, rows, frozen, ["ground_truth_status"])
    runs.dataset_freeze(spark, rows, frozen, ["ground_truth_status"])
    with pytest.raises(runs.RunError):
        runs.dataset_freeze(spark, rows.limit(1), frozen, ["ground_truth_status"])


def test_run_summaries(spark):
    rows = [("e1", "SUPPORTED", True, True, None, True, [], 1, "a", 2, True, True, False, 2.0, 10, True), ("e2", "SUPPORTED", True, False, True, True, ["X"], 0, " ", 1, True, False, True, 4.0, 30, False), ("e3", "GENERATION_REJECTED", False, False, None, None, None, 0, None, 1, False, False, True, None, None, None)]
    df = spark.createDataFrame(rows, "evaluation_id string, answerability_status string, answer_returned boolean, grounding_status boolean, semantic_status boolean, language_status boolean, answer_safety_failures array<string>, evidence_count int, answer string, attempts int, generation_used boolean, safe boolean, retried boolean, seconds double, tokens int, facts_kept boolean")
    assert [r.audit for r in runs.audit(df).orderBy("evaluation_id").collect()] == [[], ["UNSAFE_GATE", "BLANK_ANSWER", "NO_EVIDENCE", "X"], []]
    g = runs.generation_summary(df.withColumn("status", F.col("answerability_status")), []).first()
    assert (g.attempts, g.used, g.accepted, g.rejected, g.retries, g.successful_retries, g.median_seconds, g.facts_kept_rate) == (4, 2, 1, 1, 2, 0, 3.0, 0.5)
    x = runs.resource_extremes(spark.createDataFrame([("5", "9"), ("NOT_AVAILABLE", "3")], "rss string, free string"), ["rss"], ["free"]).first()
    assert (x.max_rss, x.min_free) == (5.0, 3.0)
    c = runs.status_changes(spark.createDataFrame([(1, "SUPPORTED"), (2, "X")], "id int, status string"), spark.createDataFrame([(1, "X"), (2, "SUPPORTED"), (3, "X")], "id int, status string"), ["id"])
    assert {r.id: r.change for r in c.collect()} == {1: "LOST_SUPPORT", 2: "GAINED_SUPPORT", 3: "NEW"}
    t = runs.tiered_sample(spark.range(20).withColumnRenamed("id", "k"), [(F.col("k") % 2 == 0, 2), (F.col("k") > 10, 3)], "k", ["7"])
    assert sorted((r.tier, r.k) for r in t.collect()) == [(0, 7), (1, 0), (1, 2), (2, 11), (2, 13), (2, 15)]
    s = runs.category_sample(spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "k int, c string"), "c", ["c", "a"], "k", 4)
    assert sorted(r.k for r in s.collect()) == [0, 1, 2, 3]
    cases = spark.createDataFrame([("CSE205 pre-req ki?", ["cse 205", "prerequisite"], "banglish"), ("x", ["y"], "english")], "query string, expected array<string>, language string")
    assert [r.passed for r in runs.spelling_checks(cases).collect()] == [True, False]
    p = runs.factual_overlap(spark.createDataFrame([(1, "CSE 205 has 3 credits", "3 credits"), (2, "no facts", "none")], "pair_id int, reference string, answer string")).collect()
    assert (p[0].facts_kept, p[0].precision, p[1].facts_kept) == (False, 1.0, None)
    j = runs.joined_candidates(spark.createDataFrame([(1, 2, "b", 4), (1, 1, "a", 3)], "query_id int, rank int, source string, page int"), ["source", "page"]).first()
    assert (j.source, j.page) == ("a;b", "3;4")


def test_scans(spark):
    rows = [("d1", "b.txt", "s1", b"one\fno \xff\f \ftwo-\nthree"), ("d2", "A.txt", "s2", b""), ("d3", "c.txt", "s3", b"boom"), ("d4", "D.txt", "s1", b"one"), ("d5", "e.txt", "s5", b"locked"), ("d6", "f.txt", "s6", b" \f ")]

    def parse(path, content):
        if content == b"boom":
            raise ValueError("broken")
        if content == b"locked":
            raise ingest.EncryptedError
        return ingest.text_pages(path, content)

    scanned = ingest.scan(spark.createDataFrame(rows, "document_id string, relative_path string, sha256 string, content binary"), parse)
    pages, issues = ingest.pages_and_issues(scanned)
    assert sorted((r.document_id, r.page, r.text) for r in pages.collect()) == [("d1", 1, "one"), ("d1", 4, "twothree")]
    assert {(r.document_id, r.page, r.issue_type) for r in issues.collect()} == {("d1", 2, "extraction_error"), ("d1", 3, "empty_page"), ("d2", None, "empty_document"), ("d3", None, "open_error"), ("d4", None, "duplicate_document"), ("d5", None, "encrypted_document"), ("d6", 1, "empty_page"), ("d6", 2, "empty_page"), ("d6", None, "requires_ocr")}
    statuses = ingest.scan_statuses(scanned)
    assert {r.document_id: r.status for r in statuses.collect()} == {"d1": "partial", "d2": "failed", "d3": "failed", "d4": "duplicate", "d5": "failed", "d6": "failed"}
    t = ingest.totals(statuses).first()
    assert (t.documents, t.duplicate, t.pages, t.pages_with_text) == (6, 1, 6, 2)


def test_page_structure(spark):
    torn = ["Course Code Course Title Credits Pre-Requisite", "ABC", "First part", "2.00", "Nil", "First Year First Semester", "Course", "Code", "Course Title Credits", "Pre-", "Requisite", "111(B) Second part", "XYZ 102 Another Course 3.00 Nil"]
    assert "ABC 111(B) First part Second part 2.00 Nil" in structure.rejoined_rows(torn)
    unsure = [*torn[:5], "111(B) Second part", "112(C) Third part", torn[-1]]
    assert structure.rejoined_rows(unsure) == unsure and structure.rejoined_rows(["ABC", "x", "2.00", "Nil"]) == ["ABC", "x", "2.00", "Nil"]
    record = "Course Code: CSE 205\nCourse Title: Logic Design\nCredits: 3.00\n" + "word " * 300
    table = "Third Year First Semester\nCourse Code Course Title Credits Pre-Requisite\nABC 234 Systems 3.00 Nil\nDEF 300 Logic 1.50 ABC 234"
    prose = "7\nATTENDANCE POLICY\nStudents must attend all classes of a course without any exception at all and on time every day of the week.\nGeneral Rules\nshort body"
    rows = [("d", 1, "preface of some length here\n" + record), ("d", 2, table), ("d", 3, prose), ("d", 4, "just some running text of a page that goes on, without any heading."), ("d", 5, None), ("d", 6, "12\nab")]
    pages = spark.createDataFrame(rows, "document_id string, page int, text string")
    got = structure.blocks(pages).orderBy("page", "block_index").collect()
    kinds = [(r.page, r.block_type, r.entity_id) for r in got]
    assert (1, "course_record", "CSE 205") in kinds and kinds.count((2, "table_row", "ABC 234")) == 1 and (2, "table_row", "DEF 300") in kinds and not any(r.page > 4 for r in got)
    by = {(r.page, r.entity_id): r for r in got}
    assert by[1, "CSE 205"].course_title == "Logic Design" and by[2, "ABC 234"].course_title == "Systems" and by[2, "ABC 234"].heading == "Third Year First Semester" and by[2, "ABC 234"].year is None
    assert [(r.block_type, r.heading) for r in got if r.page == 3] == [("policy_section", "ATTENDANCE POLICY"), ("policy_section", "General Rules")] and [r.block_type for r in got if r.page == 4] == ["fallback"]
    chunks = structure.chunks(structure.blocks(pages))
    own = chunks.where("entity_id = 'CSE 205'").orderBy("word_start").collect()
    assert [(r.word_start, r.word_end) for r in own] == [(0, 260), (220, 310)] and own[1].text.startswith("Course Code: CSE 205\nCourse Title: Logic Design\nCredits: 3.00\nword")
    assert structure.matching_chunks(chunks, page=2, entity="abc234").count() == 1 and structure.type_counts(chunks).count() == 5
    bad = spark.createDataFrame([("a", "", "d", 1, None, None), ("b", "CSE 101 CSE 102 CSE 103 CSE 104 are here", "d", 1, None, None), ("b", "x " * 400, None, 1, None, None), ("c", "x " * 400, "d", 1, None, None)], "chunk_id string, text string, document_id string, page int, entity_id string, block_type string").withColumns({"word_start": F.lit(0), "word_end": F.lit(1)})
    found = {(r.problem, r.chunk_id) for r in structure.quality_lists(bad).collect() if r.problem != "duplicate_text"}
    assert found == {("empty", "a"), ("very_short", "b"), ("mixed_entity", "b"), ("very_long", "b"), ("very_long", "c"), ("missing_provenance", "b"), ("duplicate_chunk_id", "b")}
    assert structure.course_code("eng (cse)101(a)") == "ENG (CSE) 101 (A)" and structure.course_codes("WEEK 12 and CSE 205, cse205") == ["CSE 205"]


def test_stored_index(spark, tmp_path):
    rows = [("x", "red red blue", "E 1", "f", 1), ("y", "blue", "E1", "g", 2), ("z", None, None, None, None), ("w", "green tea", "e-2", "f", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, entity string, field string, page int")
    q = spark.createDataFrame([(1, "red blue red", "E 1", "g"), (2, "", None, None)], "query_id int, text string, entity string, field string")
    path = str(tmp_path / "index")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    built = index_store.build_sparse(chunks, path, vectors=vectors, vector_settings={"model": "m"})
    index = index_store.load_sparse(spark, path, chunks.repartition(3), deep=True)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert index.manifest == built.manifest and same(index.search(q, 5), R.bm25(chunks, q, 5)) and index.search(q, 0).count() == 0
    assert [r.chunk_id for r in index.metadata_candidates(q, 5).orderBy("rank").collect()] == ["y", "x"]
    assert index_store.load_vectors(index, chunks, {"model": "m"}).count() == 2 and index_store.reuse_or_build(chunks, path).manifest == built.manifest
    for wrong in (lambda: index_store.load_sparse(spark, path, chunks.limit(2)), lambda: index_store.load_sparse(spark, str(tmp_path / "none")), lambda: index_store.load_sparse(spark, path, chunks, R.RetrievalConfig(k1=2.0)), lambda: index_store.load_vectors(index, chunks, {"model": "n"}), lambda: index_store.load_vectors(index, chunks.where("chunk_id = 'x'"))):
        with pytest.raises(index_store.IndexMismatch):
            wrong()
    other = chunks.withColumn("text", F.concat("text", F.lit("!")))
    assert not index_store.is_fresh(index_store.read_manifest(spark, path), other) and index_store.reuse_or_build(other, path).manifest != built.manifest
    files.write_json(spark, f"{storage.Versions(spark, path).current()['path']}/manifest.json", {})
    with pytest.raises(index_store.IndexMismatch):
        index_store.load_sparse(spark, path)


def test_workbooks_logs_and_reports(spark, tmp_path):
    path = tmp_path / "q.xlsx"
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>English Query</t></is></c></row><row/><row><c r="B3" t="s"><v>1</v></c></row><row><c r="A4"><v>7</v></c><c r="B4" t="s"><v>1</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>question_id</t></si><si><r><t>How many cred</t></r><r><t>its has CSE 205?</t></r></si></sst>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    got = files.canonical_questions(files.read_xlsx(spark, str(path), ["question_id"])).orderBy("question_id").collect()
    assert [(r.course_code, r.intent, r.english_question) for r in got] == [("CSE 205", "credits", "How many credits has CSE 205?")] * 2 and got[0].question_id == "7" and got[1].question_id.startswith("Q-")
    with pytest.raises(files.HeaderError):
        files.read_xlsx(spark, str(path), ["answer"])
    log = str(tmp_path / "log")
    for at, v in ((1, "a"), (2, "b")):
        files.append_log(spark.createDataFrame([(1, at, v), (2, at, "c")], "k int, at int, v string"), log)
    assert {(r.k, r.v) for r in files.read_log(spark, log, "k int, at int, v string", "k").collect()} == {(1, "b"), (2, "c")}
    t = files.typed(spark.createDataFrame([("1", "[1,2]"), ("x", None)], "n string, a string"), {"n": "int", "a": "array<int>"}).collect()
    assert [(r.n, r.a) for r in t] == [(1, [1, 2]), (None, None)]
    out = str(tmp_path / "table")
    for n in (3, 2):
        files.write_csv(spark.range(n).withColumn("x", F.array(F.lit(1))), out)
    back = files.read_csv(spark, files.csv_folder(spark, out) + "/*.csv")
    assert back.count() == 2 and back.first().x == "[1]"
    files.write_json(spark, str(tmp_path / "a.json"), {"b": 1, "a": 2})
    assert (tmp_path / "a.json").read_text().startswith('{\n  "a"') and "9 rows more" in files.markdown(spark.range(10), 1) and files.report("T", {"s": spark.range(1)}).startswith("# T\n\n## s")
