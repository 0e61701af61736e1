"""Evidence rules on small passages of our own: whole cases go through assessed() in one batch."""

import pytest
from pyspark.sql import functions as F

from tesserine.functions import understanding as U
from tesserine.operators import answers as A
from tesserine.operators import contract as K
from tesserine.operators import crosslingual as X
from tesserine.operators import evidence as V
from tesserine.operators import relations as L
from tesserine.operators.metadata import document_metadata, metadata_fields


def values(spark, rows, names, **columns):
    """The columns' values over literal rows, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} {t}" for n, t in names.items()))
    return df.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()


def test_entities_languages_fields_intents(spark):
    asks = [
        ("CSE(XY) 205 and cse 205, page 12, week 3", ["CSE (XY) 205", "CSE 205"], "english", "weekly_content", "weekly_content"), ("ABC DE 101(b) ও MAT ২০১", ["ABC (DE) 101(B)", "MAT 201"], "bangla", "general", "course_metadata"),
        ("ＣＳＥ—３０১", ["CSE 301"], "bangla", "general", "course_metadata"), ("what is above 50 marks of CLO 12", [], "english", "learning_outcome", "clo"), ("How many credits has CSE 205?", ["CSE 205"], "english", "credits", "course_credit"),
        ("CSE 205 er credit koto?", ["CSE 205"], "banglish", "credits", "course_credit"), ("CSE 205 এর ক্রেডিট কত?", ["CSE 205"], "bangla", "credits", "course_credit"), ("mark distribution of CSE 101?", ["CSE 101"], "english", "assessment", "mark_distribution"),
        ("Explain the university library services", [], "english", "general", "unknown"), ("What is the prerequisite of HSS 111(B)?", ["HSS 111(B)"], "english", "prerequisite", "prerequisite"), ("123 ?", [], "unknown", "general", "unknown"), (None, [], "unknown", "general", "unknown"),
        ("Who teaches EEE221?", ["EEE 221"], "english", "publication", "course_metadata"), ("which email and credits of CSE 1?", [], "english", "email", "course_credit"), ("course type and semester", [], "english", "course_type", "course_type"),
        ("final exam percentage", [], "english", "percentage", "final_exam_marks"),
    ]
    got = values(spark, [(a[0],) for a in asks], {"t": "string"}, a=U.analysis(F.col("t")))
    for a, r in zip(asks, got, strict=True):
        assert (r.a.canonical, r.a.language, r.a.field, r.a.intent) == a[1:], a[0]


def test_named_things_and_numbers(spark):
    asks = ["Grade A in Spring 2024 for B.Sc in Computer Science, 3 credits of CSE 205", "section B of semester 2, mail a@b.edu, on 12/05/2024", "CSE 205 credits", None]
    got = [[(x.kind, x.normalized) for x in r.n] for r in values(spark, [(a,) for a in asks], {"t": "string"}, n=U.requested_entities(F.col("t")))]
    assert got[0] == [("course_code", "SPRING2024"), ("course_code", "CSE205"), ("semester", "spring 2024"), ("grade", "grade a"), ("program", "b.sc in computer science"), ("date", "2024"), ("value", "3 credits")]
    assert got[1] == [("email", "a@b.edu"), ("semester", "semester 2"), ("section", "section b"), ("date", "12 05 2024")] and got[2] == [("course_code", "CSE205")] and got[3] == []
    asks = ["week five of MAT 201", "7th week", "সপ্তাহ 3", "week 12", "CLO 4 of x", "two of 3 and ২"]
    got = values(spark, [(a,) for a in asks], {"t": "string"}, w=U.week_number(F.col("t")), c=U.clo_number(F.col("t")), n=U.cardinalities(F.col("t")))
    assert [r.w for r in got] == [5, 7, 3, 12, None, None] and got[4].c == 4 and got[5].n == ["2", "3"]


def test_retrieval_text(spark):
    asks = {"CSE205(A) pre-req?": "cse 205(a) prerequisite", "Topic-gulo ki  kii": "topic gulo ki ki", "ENG (CSE) 101 er credit": "eng (cse) 101 er credit", "week 5 e boraddo": "week 5 allocated", "75.5%, a@b.edu!": "75.5% a@b.edu", "": ""}
    got = values(spark, [(a,) for a in asks], {"t": "string"}, r=U.retrieval_text(F.col("t")), q=U.expanded_query(F.col("t")), d=U.dense_query(F.col("t"), "original"))
    assert [r.r for r in got] == list(asks.values()) and got[0].q == "CSE205(A) pre-req? cse 205(a) prerequisite" and got[0].d == "CSE205(A) pre-req?"
    with pytest.raises(ValueError):
        U.dense_query(F.col("t"), "other")


COURSE = "Course Code: ABC 234 Course Title: Systems"
TABLE = "Course Code Course Title Credits Pre-Requisite"
THEORY = "Theoretical Courses: 1 credit = {} per week."
POLICY = "University attendance policy Category {}: attendance of at least {}% in every course is required."
#: question, passages (text, entity, field types), support, conflicting values
CASES = [
    ("How many credits is ABC 234?", [(f"{COURSE} Credit Value: 3.0", None, None)], "supported", []),
    ("What is the prerequisite of ABC 234?", [("Course Code: XYZ 987 Prerequisite: XYZ 100", None, None)], "insufficient", []),
    ("What is the prerequisite of ABC 234?", [(COURSE, None, None)], "insufficient", []),
    ("What is the prerequisite of ABC 234?", [("Course Code: XYZ 987 Prerequisite: ABC 234", None, None)], "insufficient", []),
    ("How many credits is ABC 234?", [("A student of ABC 234 needs 3.0 credits", None, None)], "insufficient", []),
    ("How many credits is ABC 234?", [("Course Code: ABC 234 Credit Value: 3.0", None, None), ("Course Code: ABC 234 Credit Value: 4.0", None, None)], "conflicting", ["3.0", "4.0"]),
    ("What is the credit?", [("ABC 234 Credit Value: 3.0", None, None)], "ambiguous", []),
    ("What is the email for ZZZ 999?", [("Contact for ABC 234: registrar@example.edu", None, None)], "insufficient", []),
    ("How is one credit assigned for theoretical courses?", [("Assignment of Credits: Theoretical Courses: One lecture per week per semester will be equivalent to one credit. Laboratory work differs.", None, ["credits"]), ("Laboratory/Field Work: One credit is based on two hours per week.", None, ["credits"]), (f"{COURSE} Credits: 3.00 Prerequisite: None", "ABC 234", ["credits"])], "supported", []),
    ("থিওরেটিক্যাল কোর্সে এক ক্রেডিট কীভাবে নির্ধারিত হয়?", [(THEORY.format("1 lecture"), None, ["credits"])], "supported", []),
    ("How is one credit assigned for theoretical courses?", [(THEORY.format("1 lecture"), None, ["credits"]), (THEORY.format("2 lectures"), None, ["credits"])], "conflicting", ["1:lecture_per_week:1:credit", "2:lecture_per_week:1:credit"]),
    ("How many credits is ABC 234?", [(f"{COURSE} Credits: 3.00", "ABC 234", ["credits"]), ("Course Code: ABC 234 Semester Total Credits: 19.00", "ABC 234", ["credits"])], "supported", []),
    ("How many credits is ABC 234?", [(f"{COURSE} Credits: 3.00", "ABC 234", ["credits"]), (f"{COURSE} Credits: 4.00", "ABC 234", ["credits"])], "conflicting", ["3.0", "4.0"]),
    ("How many credits is ABC 234?", [(f"{TABLE} ABC 234 Systems 3.00 Nil", "ABC 234", ["credits"]), (f"{COURSE} Credits: 3.0 Prerequisite: None", "ABC 234", ["credits"])], "supported", []),
    ("How many credits is ABC 234?", [(f"{TABLE} ABC 234 Systems 3.00 Nil", "ABC 234", ["credits"]), (f"{TABLE} ABC 234 Systems 4.00 Nil", None, None)], "conflicting", ["3.0", "4.0"]),
    ("What attendance percentage is required by the university policy?", [(POLICY.format(1, 70), None, ["attendance"]), (POLICY.format(1, 75), None, ["attendance"])], "conflicting", ["70", "75"]),
    ("What attendance percentage is required by the university policy?", [(POLICY.format(1, 70), None, ["attendance"]), (POLICY.format(2, 75), None, ["attendance"])], "supported", []),
    ("What is the prerequisite of ABC 234?", [(f"{COURSE} Credits: 3.00 Prerequisite: {x}", "ABC 234", ["prerequisite"]) for x in ("Nil", "None", "N/A")], "supported", []),
    ("প্রসপেক্টাসে কোন সংস্করণ ও তারিখ দেওয়া আছে?", [("Published by Example Department\nEdition\n13th Edition, July 2017", None, None)], "supported", []),
    ("Prospectus-ta ke publish koreche?", [("Faculty publish research papers.", None, None), ("A faculty paper was published by Another House in 2017.", None, None)], "insufficient", []),
    ("Is the library open for every student?", [("The library is open all week for every registered student.", None, None), (None, None, None)], "supported", []),
    ("What is its prerequisite?", [], "ambiguous", []), ("Who published it?", [], "ambiguous", []),
    ("What percentage of total seats is reserved for children of Freedom Fighters?", [], "insufficient", []),
]


def test_cases(spark):
    rows = [(q, f"{q}-{i}", i + 1, t, f"d{i}", i, "course" if e else None, e, f) for q, (_, ps, *_) in enumerate(CASES) for i, (t, e, f) in enumerate(ps)]
    candidates = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, text string, document_id string, page int, entity_type string, entity_id string, field_types array<string>")
    questions = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "query_id long, question string").withColumn("a", U.analysis(F.col("question")))
    got = {r.query_id: r for r in V.assessed(candidates, questions).collect()}
    assert len(got) == len(CASES)
    for i, (question, _, support, conflicting) in enumerate(CASES):
        assert (got[i].support, got[i].conflicting_values if support == "conflicting" else []) == (support, conflicting), (question, got[i])
    assert got[8].best.chunk_id == "8-0" and got[8].verified == 1
    assert (got[0].status, got[0].reason, got[0].level) == ("SUPPORTED", "SINGLE_VERIFIED_PASSAGE", "ADEQUATE") and got[17].reason == "DIRECT_STRUCTURED_SUPPORT" and got[17].independent == 3
    assert (got[4].status, got[7].reason, got[23].reason) == ("INSUFFICIENT_EVIDENCE", "ENTITY_NOT_SUPPORTED", "FIELD_NOT_SUPPORTED")


def test_values_and_rows(spark):
    rows = [("credits", "Credits: 3.00", ["3.00"]), ("credits", "Credits: N/A", []), ("prerequisite", "Credits: N/A Prerequisite: DEF 101", ["def 101"]), ("prerequisite", "Prerequisite: Nil", ["NO_PREREQUISITE"]), ("attendance", "attendance of at least 70% of classes", ["70"]), ("email", "Mail a.b@c.edu now", ["a.b@c.edu"]), ("date", "on 12/05/2024", ["12 05 20"]), ("credits", None, []), ("nothing", "x", [])]
    got = values(spark, [r[:2] for r in rows], {"f": "string", "t": "string"}, v=V.field_values(F.col("f"), F.col("t")))
    assert [r.v for r in got] == [r[2] for r in rows]
    text = f"{TABLE} ABC 234 Systems of Sets 3.00 XYZ 100, XYZ 101 DEF 300 Logic 1.5 Nil Course Code: GHI 400 Credits: 2 Pre-requisite: ABC 234. Course Code: JKL 500 Credits: 4. MNO 600 has no prerequisite."
    rows = [("ABC 234", "credits", ["3.0"]), ("ABC 234", "prerequisite", ["XYZ 100, XYZ 101"]), ("DEF 300", "prerequisite", ["NO_PREREQUISITE"]), ("GHI 400", "credits", ["2.0"]), ("GHI 400", "prerequisite", ["ABC 234"]), ("MNO 600", "prerequisite", ["NO_PREREQUISITE"]), ("XYZ 100", "credits", []), ("ABC 234", "topic", [])]
    got = values(spark, [(*r[:2], text) for r in rows], {"e": "string", "f": "string", "t": "string"}, v=V.row_values(F.col("e"), F.col("f"), F.col("t")))
    assert [r.v for r in got] == [r[2] for r in rows]
    long = "word " * 100 + "ABC 234 has Credits: 3 " + "tail " * 100
    got = values(spark, [(long,), ("short text",)], {"t": "string"}, x=V.excerpt(F.col("t"), F.lit("credits"), F.array(F.lit("ABC 234"))))
    assert got[0].x.startswith("…word") and got[0].x.endswith("…") and "ABC 234 has Credits: 3" in got[0].x and len(got[0].x) <= 422 and got[1].x == "short text"


def test_grounding_binding_and_safety(spark):
    evidence = "At least 70% attendance is required for CSE 205. Write to a@b.edu"
    rows = [("CSE 205 needs 70.0%", True, []), ("CSE 206 needs 71%", False, ["course_codes:cse206", "numbers:206.0", "numbers:71.0%"]), ("", False, []), ("The answer could not be found", False, []), ("attendance is required: 70%", True, [])]
    got = values(spark, [(r[0],) for r in rows], {"a": "string"}, g=V.grounding(F.col("a"), F.lit(evidence)), b=V.claim_bound(F.col("a"), F.lit(evidence)))
    assert [(r.g.passed, r.g.unsupported) for r in got] == [r[1:] for r in rows] and [r.b for r in got] == [False, False, False, False, True]
    assert [r.g.reason for r in got][2:4] == ["EMPTY_ANSWER", "MODEL_ABSTAINED_DESPITE_VERIFIED_EVIDENCE"]
    office = "Admission Office Email: a@example.edu, b@example.edu Department of Architecture Email: c@example.edu"
    asks = "What email addresses are listed for the Admission Office?"
    rows = [
        (asks, "a@example.edu", [office], None, [], ["REQUIRED_VALUE_LOSS"]), (asks, "a@example.edu and b@example.edu", [office], None, [], []), ("Give any one Admission Office email", "a@example.edu", [office], None, [], []),
        ("একটি নিয়মিত সেমিস্টারের মোট মেয়াদ কত?", "এক শিক্ষাবর্ষে 2টি নিয়মিত সেমিস্টার আছে", [], "regular_semester_count", [], ["RELATION_MISMATCH"]),
        ("attendance of CSE 205?", "CSE 301 needs 70%", [evidence], "attendance_exam_requirement", [], ["ENTITY_MISMATCH", "ESSENTIAL_QUALIFIER_LOSS"]),
        ("prerequisite of ABC 234?", "XYZ 100", ["Prerequisite: XYZ 100, XYZ 101"], None, [], ["REQUIRED_VALUE_LOSS", "ENTITY_MISMATCH"]), ("prerequisite of ABC 234?", "ABC 234 needs XYZ 100 and XYZ 101", ["Prerequisite: XYZ 100, XYZ 101"], None, [], []),
        ("marks distribution?", "Final 50%", [], "mark_distribution", ["50%", "25%"], ["REQUIRED_VALUE_LOSS"]), ("How many courses may be repeated at maximum?", "three", [], "repeat_course_maximum", [], ["ESSENTIAL_QUALIFIER_LOSS"]),
    ]
    got = values(spark, [r[:5] for r in rows], {"q": "string", "a": "string", "e": "array<string>", "r": "string", "v": "array<string>"}, s=V.safety_failures(F.col("q"), F.col("a"), F.col("e"), F.col("r"), F.col("v")), w=V.asked_relation(F.col("q")))
    assert [r.s for r in got] == [r[5] for r in rows] and got[3].w == "regular_semester_duration"
    asks = {"How many regular semesters are there?": "regular_semester_count", "How many class weeks are in a semester?": "class_duration_weeks", "What are the semester names?": "semester_names", "hello": None}
    assert [r.w for r in values(spark, [(a,) for a in asks], {"q": "string"}, w=V.asked_relation(F.col("q")))] == list(asks.values())


RELATIONS = [
    ("ABC 111(B) course-er credit koto?", "ABC 111(B) Sample History 2.00 Nil", "course_credits", ["2.00"], "ABC 111(B) course-er credit 2.00."),
    ("ABC 111(B) course-er prerequisite ki?", "ABC 111(B) Sample History 2.00 Nil", "course_prerequisite", ["Nil"], "ABC 111(B) course-er kono prerequisite deya nei."),
    ("ABC 111(A) course-er credit koto?", "ABC 111(B) Sample History 2.00 Nil", None, None, None),
    ("EU কোন আইনের অধীনে কার্যক্রম শুরু করেছিল?", "Example University (EU) started its operation under the Private University Act 2001.", "started_under", ["Private University Act 2001"], "EU Private University Act 2001-এর অধীনে কার্যক্রম শুরু করেছিল।"),
    ("EU শুরুতে কোন দুইটি ব্যাচেলর ডিগ্রি প্রোগ্রাম অফার করেছিল?", "EU started its operation by offering Bachelor Degree Programs in Physics and Business Administration only.", "initially_offered", ["Physics", "Business Administration"], None),
    ("What is Category 4?", "Category 4: Students who have passed all the prescribed courses and have no backlog of courses. A student of Category 4 is eligible for registration in all courses prescribed for the next semester.", None, None, None),
    ("রেজিস্ট্রেশনে Category 4 কী?", "Category 4: Those who have passed all the prescribed courses prescribed and have no backlog. A student of Category 4 is eligible for registration in all courses prescribed.", "category_definition", None, None),
    ("What is the mark distribution?", "For theoretical courses the distribution of marks is as follows: Assessment 25% Mid Semester 25% Final Exam 50% Total 100%", "mark_distribution", ["25%", "25%", "50%"], "The mark distribution is Assessment 25%, Mid Semester 25%, Final Exam 50%."),
    ("Prospectus-ta ke publish koreche?", "Published by Example Department, Example University\nEdition 2nd Edition, May 2020", "published_by", ["Example Department, Example University"], None),
    ("What does the disclaimer of the prospectus say?", "Disclaimer The information in this prospectus may change at the department's discretion.", "publication_disclaimer", ["the department"], "The disclaimer says the prospectus information may change at the discretion of the department."),
    ("What is the maximum number of courses that can be repeated? how many", "A student may repeat up to two courses to improve.", "repeat_course_maximum", ["two"], "A student may repeat at most 2 courses for grade improvement."),
    ("What attendance is needed for the final exam?", "Students are required to attend at least 70% of all the classes in every course to sit for the final examination.", "attendance_exam_requirement", ["70%"], "A student must attend at least 70% of classes in every course to sit for the final examination."),
    ("CGPA for honors?", "A student gets the degree with honors if his/her CGPA is 3.75 or above.", "honors_cgpa", ["3.75"], "A degree with honors requires a CGPA of 3.75 or above."),
    ("How many regular semesters?", "There will be two semesters - Spring and Fall Semester in an academic year.", "regular_semester_count", ["two", "Spring", "Fall"], "An academic year has 2 regular semesters: Spring and Fall."),
    ("When must the re-examination application be submitted?", "within 7 (seven) working days from the publication of final results", "reexamination_deadline", ["7"], None),
    ("hello", "nothing of the kind", None, None, None), (None, None, None, None, None),
]


def test_relations(spark):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(RELATIONS)], "i long, q string, t string")
    df = df.withColumn("r", L.extract(F.col("q"), F.col("t"))).withColumn("l", U.language(F.col("q"))).withColumn("said", L.realise(F.col("r"), F.col("l")))
    df = df.withColumn("g", L.grounded(F.col("q"), F.col("r"), F.col("t"), F.col("said"))).withColumn("bad", L.grounded(F.col("q"), F.col("r"), F.lit("other"), F.col("said")))
    for (q, _, relation, vals, said), r in zip(RELATIONS, df.orderBy("i").collect(), strict=True):
        if relation is None:
            assert r.r is None or q == "What is Category 4?", (q, r.r)
            continue
        assert r.r is not None and r.r.relation == relation and (vals is None or r.r["values"] == vals), (q, r.r)
        assert said is None or r.said == said, (q, r.said)
        assert r.said and r.g.passed and not r.bad.passed, (q, r.g)


OFFERED = "The school offered Bachelor Degree Programs in Physics and Law only and later Music and Art only."
#: A question and a passage for each relation; every pair of them in one passage, in both orders, must give the one asked for.
ONE_OF_EACH = {
    "started_under": ("Under which act did EU start?", "EU started its operation under the Private University Act 2001."),
    "initially_offered": ("Which bachelor programs were initially there?", OFFERED),
    "program_discipline_counts": ("How many undergraduate disciplines?", "It has undergraduate programs in eight disciplines and post-graduate programs in five disciplines."),
    "repeat_course_maximum": ("How many courses may be repeated?", "One may repeat at most three courses."),
    "category_definition": ("What is Category 2?", "Category 1: Those who have nothing. A student of Category 1 may wait. Category 2: Those who passed all the prescribed courses and have no backlog. A student of Category 2 is eligible for registration in all courses."),
    "mark_distribution": ("What is the marks distribution?", "The distribution of marks is: Attendance 10% Final Exam 90% Total 100%"),
    "attendance_exam_requirement": ("What attendance does the final exam need?", "Students are required to attend at least 70% of all the classes to sit for the final examination."),
    "honors_cgpa": ("Which CGPA gives honors?", "A degree with honors if his/her CGPA is 3.75 or above."),
    "normal_progress_cgpa": ("Which CGPA is normal progress?", "It is normal progress towards a degree if his/her CGPA at the end is 2.20 or better."),
    "regular_semester_count": ("How many regular semesters are there?", "There will be two semesters - Spring and Fall Semester in an academic year."),
    "reexamination_deadline": ("When must a re-examination application come?", "within 7 (seven) working days from the publication of final results"),
}


def test_each_relation_beside_each_other(spark):
    rows = [(a, ONE_OF_EACH[a][0], "\n".join(ONE_OF_EACH[x][1] for x in order)) for a in ONE_OF_EACH for b in ONE_OF_EACH if a != b for order in ((a, b), (b, a))]
    got = spark.createDataFrame(rows, "want string, q string, t string").withColumn("r", L.extract(F.col("q"), F.col("t"))).collect()
    assert [(r.want, r.q) for r in got if r.r is None or r.r.relation != r.want] == []


def test_first_relation_by_order_and_spans(spark):
    """Questions that ask for two relations, spans that must stop early, categories beside each other."""
    both = ONE_OF_EACH["attendance_exam_requirement"][1] + "\n" + ONE_OF_EACH["mark_distribution"][1]
    rows = [
        ("What is the marks distribution of attendance and final exam?", both, "mark_distribution", ["10%", "90%"], ["Attendance", "Final Exam"]),
        ("initially which bachelor programs?", OFFERED, "initially_offered", ["Physics", "Law"], []),
        ("initially which bachelor programs?", "It offered Bachelor Degree Programs in Arts and Crafts and Law only.", "initially_offered", ["Arts and Crafts", "Law"], []),
        ("initially which bachelor programs?", "It offered Bachelor Degree Programs in Law only.", None, None, None),
        ("What is Category 1?", ONE_OF_EACH["category_definition"][1], None, None, None),
        ("What is Category 3?", ONE_OF_EACH["category_definition"][1], None, None, None),
        ("How many courses may be repeated?", "One may repeat at most several courses.", None, None, None),
        ("ABC 111 and ABC 112 credits?", "ABC 111 Sample History 2.00 Nil", None, None, None),
        ("ABC 111 credit and prerequisite?", "ABC 111 Sample History 2.00 ABC 110", "course_credits", ["2.00"], ["ABC 111"]),
    ]
    got = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, q string, t string").withColumn("r", L.extract(F.col("q"), F.col("t"))).orderBy("i").collect()
    for want, r in zip(rows, got, strict=True):
        assert (r.r and (r.r.relation, r.r["values"], r.r["labels"])) == (want[2] and want[2:]), (want, r.r)


def test_metadata(spark):
    text = "Published by Example Department, 12/A, Some Road Edition 13th Edition, July 2017 Disclaimer This text may be subject to change without notice."
    got = values(spark, [(text,), ("Faculty publish papers.",), (None,)], {"t": "string"}, m=document_metadata(F.col("t")))
    assert got[0].m == {"edition": "13th Edition", "publication_date": "July 2017", "published_by": "Example Department", "publication_disclaimer": "This text may be subject to change without notice."} and got[1].m == {} == got[2].m
    asks = {"Which edition and date of the prospectus?": ["edition", "publication_date"], "Who published the document?": ["published_by"], "Who published it?": [], "date?": []}
    assert [r.f for r in values(spark, [(a,) for a in asks], {"t": "string"}, f=metadata_fields(F.col("t")))] == list(asks.values())


def test_strategies_facts_and_languages(spark):
    rows = [("supported", "credits", "course_credit", "credits of x?", "structured_exact"), ("supported", "credits", "x", "Explain the credits", "gguf_generation"), ("supported", "topic", "topics", "topics?", "structured_list"), ("supported", "general", "unknown", "how many courses may be repeated", "gguf_generation"), ("ambiguous", "credits", "x", "", "ambiguous"), ("insufficient", "credits", "x", "", "unsupported"), ("supported", "general", "unknown", "", "gguf_generation")]
    got = values(spark, [r[:4] for r in rows], {"s": "string", "f": "string", "n": "string", "q": "string"}, x=A.strategy(F.col("s"), F.col("f"), F.col("n"), F.col("q")))
    assert [r.x for r in got] == [r[4] for r in rows]
    rows = [("cse 205", "credits", "3", "english", "CSE 205 carries 3 credits."), ("CSE 205", "prerequisite", "Nil", "banglish", "CSE 205 course-er kono prerequisite deya nei."), (None, "email", "a@b.edu", "english", "The email address is a@b.edu."), ("x", "percentage", "70%", "english", "The requested percentage for x is 70%."), ("x", "credits", " ", "english", None), (None, "other", "5", "bangla", "অনুরোধ করা বিষয়টির: 5।")]
    got = values(spark, [r[:4] for r in rows], {"e": "string", "f": "string", "v": "string", "l": "string"}, x=A.exact_fact(F.col("e"), F.col("f"), F.col("v"), F.col("l")))
    assert [r.x for r in got] == [r[4] for r in rows]
    rows = [("The credit is 3.", "english", True, "ENGLISH_BODY_VALID"), ("Credit holo 3.", "english", False, "ENGLISH_CONTAINS_BANGLISH_FRAMING"), ("Credit holo 3.", "banglish", True, "BANGLISH_MARKERS_PRESENT"), ("কোর্সটির ক্রেডিট হলো 3।", "bangla", True, "BANGLA_BODY_MEANINGFUL"), ("The credit is 3.", "bangla", False, "BANGLA_BODY_TOO_ENGLISH"), ("", "english", False, "EMPTY_ANSWER"), ("ответ", "english", False, "UNEXPECTED_FOREIGN_SCRIPT"), ("কোর্সxyz", "bangla", False, "MIXED_SCRIPT_TOKEN"), ("Only English here", "banglish", False, "BANGLISH_BODY_PURE_ENGLISH")]
    got = values(spark, [r[:2] for r in rows], {"a": "string", "l": "string"}, x=A.answer_language(F.col("a"), F.col("l")))
    assert [(r.x.passed, r.x.reason) for r in got] == [r[2:] for r in rows]
    got = values(spark, [("What is x?", "Answer: What is x? It is y."), ("q", None)], {"q": "string", "a": "string"}, c=A.cleaned(F.col("q"), F.col("a")))
    assert [r.c for r in got] == ["It is y.", ""]
    assert values(spark, [("credit holo 3 ebong grade-er limit",)], {"t": "string"}, e=A.in_english(F.col("t")))[0].e == "Credit is 3 and grade limit"
    got = values(spark, [("credits", ["Credits: 3", "Credit 3"]), ("credits", ["Credits: 3", "Credits: 4"]), ("attendance", ["attendance of 70 % is needed"])], {"f": "string", "e": "array<string>"}, v=A.single_value(F.col("f"), F.col("e")))
    assert [r.v for r in got] == ["3", None, "70 %"]


def test_sections(spark):
    plan = "14. Course Content: Sets, Logic and Graphs 15. Alignment of topics"
    rows = [
        ("CLO 2 of CSE 205?", "CLO 1 know sets. CLO 2 prove theorems. CLO 3 more", "CLO 2: prove theorems."), ("topics of CSE 205?", plan, "Topics include Sets, Logic and Graphs."), ("What topics are under Boolean Algebra?", "Boolean Algebra: gates, tables and maps. Week 3", "Under boolean algebra, topics include gates, tables, maps."),
        ("week 3 of CSE 205?", "Week 2 CLO1 Trees Week 3 CLO2", "Week 3: Trees."), ("final exam marks percentage?", "The Final Exam (50%) is written", "Final Exam: 50%."), ("mark distribution?", "Final Exam 50% and Class Tests 20%", "Mark distribution: - Final Exam: 50% - Class Tests: 20%"),
        ("prerequisite of CSE 205?", "Prerequisite: CSE 101", "Prerequisite: CSE 101."), ("prerequisite of CSE 205?", "CSE 205 Logic Design 3.00 Nil CSE 206 Other", "Prerequisite: Nil."), ("course title of CSE 205?", "CSE 205 Logic Design 3.00 Nil CSE 206 Other", "Course title: Logic Design."), ("attendance in assessment?", "Students must attend all. At least 70% attendance is required.", "At least 70% attendance is required."), ("CLO 9?", "nothing", None),
    ]
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(rows)], "i long, q string, t string").withColumn("a", U.analysis(F.col("q")))
    got = df.select("i", A.section(F.col("a.intent"), F.col("q"), F.get("a.canonical", F.lit(0)), F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [r[2] for r in rows]


BANK = [(1, "english", "What is the credit of CSE 205?", "credit holo 3"), (2, "english", "Which book is used for the logic design course at night?", "book one"), (3, "english", "At night which book is used for the logic design course?", "book two"), (4, "bangla", "কোর্সের নাম কী", "নাম"), (5, "english", "What is the credit of CSE 205?", "credit holo 3")]


def test_answer_bank(spark):
    bank = spark.createDataFrame(BANK, "item_id long, language string, question string, reference string")
    asks = [(1, "english", "what is the credit of cse 205"), (2, "english", "Which book is used for the logic design course at night today?"), (3, "english", "something else entirely"), (4, "bangla", "কোর্সের নাম কী?"), (5, "bangla", "What is the credit of CSE 205?")]
    got = {r.query_id: r.answer for r in A.bank_answers(bank, spark.createDataFrame(asks, "query_id long, language string, text string")).collect()}
    assert got.keys() == {1, 2, 4} and got[1] == "Credit is 3" and got[4] == "উত্তর: নাম" and "- Book one\n- Book two" in got[2]


def test_rewriting_and_second_assessment(spark):
    asks = ["CSE 205 এর ক্রেডিট কত?", "উপস্থিতি শতাংশ কত", "কত", "EU কোন আইনের অধীনে কার্যক্রম শুরু করেছিল?"]
    got = values(spark, [(a,) for a in asks], {"q": "string"}, w=X.rewritten(F.col("q")))
    assert [r.w.query for r in got][:3] == ["CSE 205 credits", "attendance percentage", ""] and got[2].w.validation == "NO_RELIABLE_DETERMINISTIC_QUERY"
    pairs = [("CSE 205 credits?", "credits of CSE 206", "PROTECTED_FACT_CHANGED"), ("CSE 205 credits?", "CSE 205 credits 3", "NEW_PROTECTED_FACT"), ("CSE 205 credits?", "CSE 205 attendance", "FIELD_CHANGED"), ("credits?", "ক্রেডিট", "NOT_CONCISE_ENGLISH_QUERY"), ("CSE 205 credits?", "CSE 205 credits", "VALIDATED")]
    assert [r.v for r in values(spark, [p[:2] for p in pairs], {"q": "string", "w": "string"}, v=X.rewrite_verdict(F.col("q"), F.col("w")))] == [p[2] for p in pairs]
    first = spark.createDataFrame([(i, x) for i, x in enumerate(["insufficient"] * 5 + ["supported"])], "query_id long, support string")
    second = [(0, "attendance percentage rule", "VALIDATED", "supported", ("Attendance rule of 70 percentage",)), (1, "attendance rule", "VALIDATED", "supported", ("other words",)), (2, "x", "VALIDATED", "conflicting", ("",)), (3, "", "NONE", "supported", ("",)), (4, "x y", "VALIDATED", "ambiguous", ("",))]
    got = {r.query_id: (r.gate, r.adopted) for r in X.second_assessment(first, spark.createDataFrame(second, "query_id long, query string, validation string, support string, best struct<excerpt:string>")).collect()}
    assert got == {0: ("CANONICAL_QUERY_GATE", True), 1: ("CANONICAL_TERMS_NOT_IN_EVIDENCE", False), 2: ("CANONICAL_QUERY_CONFLICT", True), 3: ("REWRITE_NOT_VALIDATED", False), 4: ("CANONICAL_QUERY_GATE_FAILED", False), 5: ("ORIGINAL_QUERY_GATE", False)}
    chunks = spark.createDataFrame([(1, "d", 1, "EU offers Prospectus text on attendance."), (2, "d", 2, "Course Code: CSE 205 Credits: 3.00")], "chunk_id long, document_id string, page int, text string")
    questions = spark.createDataFrame([(1, "CSE 999 এর ক্রেডিট কত?"), (2, "How many credits has CSE 205?")], "query_id long, text string")
    got = {r.query_id: r for r in X.reassessed(chunks, questions).collect()}
    assert (got[1].gate, got[1].status, got[1].query) == ("CANONICAL_QUERY_GATE_FAILED", "INSUFFICIENT_EVIDENCE", "CSE 999 credits") and (got[2].gate, got[2].status) == ("ORIGINAL_QUERY_GATE", "SUPPORTED")


def test_contracts(spark):
    rows = [
        ("Who published the prospectus?", "publication", None, "english", ["The prospectus was published by Example House. Other Press is elsewhere."], "The prospectus was published by Example House.", "SEMANTIC_CONTRACT_SATISFIED"),
        ("Who published the prospectus?", "publication", None, "english", ["The prospectus was published by Example House. Other Press is elsewhere."], "The prospectus was published by Other Press.", "WRONG_RELATION_VALUE"),
        ("Who published the prospectus?", "publication", None, "english", ["The prospectus was published by Example House."], "The prospectus was not published by Example House.", "WRONG_POLARITY"),
        ("Credits of CSE 205?", "credits", "CSE 205", "english", ["Course Code: CSE 205 Credits: 3.00"], "CSE 205 carries 3 credits.", "SEMANTIC_CONTRACT_SATISFIED"),
        ("Credits of CSE 205?", "credits", "CSE 205", "english", ["Course Code: CSE 205 Credits: 3.00"], "CSE 205 carries 4 credits.", "WRONG_FIELD_VALUE"),
        ("Credits of CSE 205?", "credits", "CSE 205", "english", ["Course Code: CSE 205 Credits: 3.00"], "It carries 3 credits.", "MISSING_REQUIRED_ENTITY"),
        ("Credits of CSE 205?", "credits", "CSE 205", "english", ["nothing of that"], "CSE 205 carries 3 credits.", "UNVERIFIED_COURSE_ROW"), ("x", "general", None, "english", ["The hall is open."], "", "EMPTY_ANSWER"),
    ]
    made = K.contract(F.col("q"), F.col("f"), F.col("e"), F.col("l"), F.col("x"))
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(rows)], "i long, q string, f string, e string, l string, x array<string>, a string").withColumn("c", made)
    got = df.select("i", K.kept(F.col("a"), F.col("c")).alias("k"), K.realised(F.col("a"), F.col("a"), F.lit("english"), F.col("c")).alias("r"), K.prompt_block(F.col("c"), K.fact_plan(F.col("q"), F.col("f"), F.col("x"))).alias("p")).orderBy("i").collect()
    assert [r.k.reason for r in got] == [r[6] for r in rows] and got[0].r.passed and "relation=published_by; value=Example House" in got[0].p


CHUNKS = [
    (1, "a", 1, "Course Code: CSE 205\nCourse Title: Logic Design\nCredits: 3.00\nPrerequisite: CSE 101"),
    (2, "a", 2, "Course Code: CSE 301\nCredits: 3.00"), (3, "b", 1, "Course Code: CSE 301\nCredits: 4.00"),
    (4, "b", 2, "The library is open all week for every registered student."), (5, "b", 3, None),
]
QUESTIONS = [(1, "How many credits has CSE 205?"), (2, "How many credits has CSE 301?"), (3, "How many credits?"), (4, "How many credits has CSE 999?"), (5, "CSE 205 er prerequisite ki?"), (6, None), (7, "Is the library open for every student?")]


def test_answers(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, document_id string, page int, text string")
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    got = {r.query_id: r for r in V.answer(chunks, questions).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "SUPPORTED", 2: "CONFLICTING_EVIDENCE", 3: "AMBIGUOUS_QUERY", 4: "INSUFFICIENT_EVIDENCE", 5: "SUPPORTED", 6: "OUT_OF_DOMAIN", 7: "SUPPORTED"}
    assert got[1].answer == "CSE 205 carries 3.0 credits." and got[5].answer == "CSE 205 course-er prerequisite holo CSE 101." and not got[7].answered and got[1].evidence_chunk == 1
    made = {r.query_id: r for r in V.answer(chunks, questions, generate=lambda q, e: F.concat(F.lit("As is said: "), e)).collect()}
    assert made[7].answer.startswith("As is said: The library") and made[7].attempts == 1 and made[1].attempts == 0 and V.answer(chunks, questions.limit(0)).count() == 0
