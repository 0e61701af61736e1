"""Answers from widened spans, asked again in English, and repaired under their contract."""

import pytest
from pyspark.sql import functions as F

from tesserine.operators import evidence as V
from tesserine.operators import repair as P
from tesserine.operators import spans as S

KIND = "chunk_id string, text string, document_id string, page int, parent_id string, word_start int, next_chunk_id string, continuation_of string"


def test_spans(spark):
    long = "The rules of the hall. " + "It goes on with many words. " * 50
    chunks = [
        ("a", long + "and no end", "d1", 1, "p1", 0, None, None), ("a2", "sibling\n end.", "d1", 1, "p1", 260, None, None), ("other page", "no", "d1", 2, "p1", 0, None, None),
        ("b", "short text", "d1", 1, "p2", 0, None, None), ("c", "cut text that goes on", "d1", 2, None, 0, "c2", None), ("c2", "to here.", "d1", 2, None, 0, None, "c"),
        ("d", "cut one " + "x" * 3590, "d2", 1, "p9", 0, None, None), ("d3", "y" * 100, "d2", 1, "p9", 9, None, None), ("e", "ends well. So it does.", "d3", 1, "p", 0, "e2", None), ("e2", "more", "d3", 1, "p", 5, None, "e"),
        ("f", "on the next page it", "d4", 1, None, 0, "f2", None), ("f2", "goes on", "d4", 2, None, 0, None, "f"), ("g", "z" * 4000, "d5", 1, None, 0, None, None),
    ]
    ask = {"a": "The rules of", "b": "short text", "c": "cut", "zz": "x", "d": "cut one", "e": "ends", "f": "on", "g": "zz", None: "y"}
    ev = spark.createDataFrame([(i, k, e) for i, (k, e) in enumerate(ask.items())], "span int, chunk_id string, excerpt string").withColumnRenamed("span", "full")
    got = {r.chunk_id: r for r in S.expanded(ev, spark.createDataFrame(chunks, KIND)).collect()}
    one = lambda t: " ".join(t.split())
    assert got["a"].span == one(long + "and no end sibling end.") and got["a"].linked == ["a2"]
    assert [(got[k].span, got[k].linked) for k in ("b", "c", "zz", "e", "f", "g", None)] == [
        ("short text", []), ("cut text that goes on to here.", ["c2"]), ("x", []), ("ends well. So it does.", []), ("on the next page it", []), ("zz", []), ("y", []),
    ]
    assert got["d"].span == chunks[6][1] and got["d"].linked == [] and len(got) == len(ask)


FILL = "Many other rules are listed in this part of the handbook. " * 20


def test_relation_far_from_its_anchor(spark):
    text = f"Attendance policy: attendance of 70% is the rule. {FILL}Students are required to attend at least 70% of all the classes in every course to sit for the final examination."
    chunks = spark.createDataFrame([(9, "d", 1, text), (3, "d", 2, "Nothing of that.")], "chunk_id long, document_id string, page int, text string")
    r = V.answer(chunks, spark.createDataFrame([(1, "What attendance is needed for the final exam?")], "query_id long, text string")).first()
    assert (r.status, r.strategy, r.evidence_chunk) == ("SUPPORTED", "relation", 9)
    assert r.answer == "A student must attend at least 70% of classes in every course to sit for the final examination."


def test_asked_again_in_english(spark):
    """A Banglish question whose own words find nothing; its rewriting does, and the answer is in the question's language."""
    chunks = spark.createDataFrame([(1, "a", 1, "Course Code: CSE 205\nCourse Title: Logic Design\nCredits: 3.00"), (2, "a", 2, "ABC nothing")], "chunk_id long, document_id string, page int, text string")
    q = spark.createDataFrame([(1, "CSE205 te koto kredit ache?"), (2, "How many credits has CSE 205?")], "query_id long, text string")
    empty = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "query_id long, chunk_id long, rank int")
    got = {r.query_id: r for r in V.answer(chunks, q, ranking=empty).collect()}
    assert got[2].gate == "ORIGINAL_QUERY_GATE" and got[2].answered
    assert (got[1].gate, got[1].status, got[1].language, got[1].evidence_chunk) == ("CANONICAL_QUERY_GATE", "SUPPORTED", "banglish", 1) and "3" in got[1].answer


TASK = "query_id int, question string, field string, entity string, language string, evidence array<string>"


def test_repairs(spark):
    """Answers that are wrong at first, for ever, or at once right; each is asked for as often as that."""
    ev = ["Course Code: CSE 205 Credits: 3.00", "second " * 30]
    tasks = spark.createDataFrame([(i, "Credits of CSE 205?", "credits", "CSE 205", "english", ev) for i in range(4)], TASK)
    again = lambda p: F.contains(p, F.lit("WRONG_FIELD_VALUE"))
    first = F.when(F.col("query_id") == 0, "CSE 205 carries 3 credits.")

    def generate(prompt, evidence):
        return first.when((F.col("query_id") == 1) & again(prompt), "CSE 205 carries 3 credits.").when((F.col("query_id") == 2) & F.contains(prompt, F.lit("EMPTY_ANSWER")), "CSE 205 carries 3 credits.").when(F.col("query_id") == 2, "").otherwise("CSE 205 carries 4 credits.")

    got = {r.query_id: (r.answer, r.passed, r.reason, r.attempts, r.retry_used) for r in P.generated(tasks, generate, 20).collect()}
    good = "CSE 205 carries 3 credits."
    assert got == {0: (good, True, "SEMANTIC_CONTRACT_SATISFIED", 1, False), 1: (good, True, "SEMANTIC_CONTRACT_SATISFIED", 2, True), 2: (good, True, "SEMANTIC_CONTRACT_SATISFIED", 2, True), 3: (None, False, "WRONG_FIELD_VALUE", 3, True)}
    assert P.generated(tasks.limit(0), generate, 20).count() == 0


def test_budget(spark):
    tasks = spark.createDataFrame([(1, "Credits of CSE 205?", "credits", "CSE 205", "english", ["one two three", "four " * 30, "five six"])], TASK)
    prompt = P.prompted(tasks, 10).first().prompt
    assert prompt.endswith("one two three\nfive six") and "four" not in prompt
    with pytest.raises(P.PromptOverflow, match="1"):
        P.prompted(tasks, 6)


def test_wordings_are_repaired_too(spark):
    tasks = spark.createDataFrame([(1, "CSE 205 er credit koto?", "credits", "CSE 205", "banglish", ["Course Code: CSE 205 Credits: 3.00"])], TASK)
    said = lambda text, lang: F.when(F.contains(text, F.lit("Rejected answer")), "CSE 205 course-er credit holo 3.").otherwise("CSE 205 course-er credit holo 4.")
    r = P.generated(tasks, lambda p, e: F.lit("CSE 205 carries 3 credits."), 50, said).first()
    assert (r.answer, r.passed, r.attempts) == ("CSE 205 course-er credit holo 3.", True, 3), r
