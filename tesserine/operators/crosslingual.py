"""Questions in other languages: concepts, a rewriting in English that changes no fact, and the second assessment with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import understanding as U
from ..storage import stored
from . import evidence as V
from . import retrieval as R

# Search words of academic concepts and what names them, in order.
CONCEPTS = {
    "credits": ("credits", r"\bcredits?\b|ক্রেডিট|\bkredit\b"),
    "prerequisite": ("prerequisite", r"\bpre\s*[- ]?req(?:uisite)?s?\b|পূর্বশর্ত|প্রিরিকুইজিট"),
    "course_title": ("course title", r"\btitle\b|শিরোনাম|কোর্সের নাম"),
    "course_code": ("course code", r"\bcode\b|কোড"),
    "attendance": ("attendance", r"\battendance\b|উপস্থিতি|হাজিরা"),
    "assessment": ("marks assessment", r"\bmarks?\b|মার্কস|নম্বর|পরীক্ষা"),
    "semester": ("semester", r"\bsemester\b|সেমিস্টার"),
    "program": ("degree program", r"\bprograms?\b|প্রোগ্রাম"),
    "publication": ("publication", r"\bpublish(?:ed|er)?\b|প্রকাশ"),
    "publisher": ("publisher", r"\bpublisher\b|প্রকাশক"),
    "accreditation": ("accreditation", r"\baccreditation\b|অ্যাক্রেডিটেশন"),
    "topic": ("course topics", r"\btopics?\b|বিষয়বস্তু|বিষয়"),
    "objective": ("objective", r"\bobjective\b|উদ্দেশ্য"),
    "learning_outcome": ("CLO learning outcome", r"\bCLO\b|শিখনফল"),
    "weekly_content": ("weekly content", r"\bweekly\b|সাপ্তাহিক|সপ্তাহ"),
    "requirement": ("requirement", r"\brequirement\b|প্রয়োজন|যোগ্যতা"),
    "percentage": ("percentage", r"\bpercent(?:age)?\b|শতাংশ|\d+%"),
    "date": ("date", r"\bdate\b|\bwhen\b|তারিখ|কবে|কখন"),
    "exam": ("exam", r"\bexam\b|পরীক্ষা"),
    "disclaimer": ("disclaimer", r"\bdisclaimer\b|ডিসক্লেইমার"),
    "registration": ("registration", r"\bregistration\b|রেজিস্ট্রেশন"),
    "prospectus": ("prospectus", r"\bprospectus\b|প্রসপেক্টাস"),
    "establishment": ("established", r"\bestablish(?:ed|ment)?\b|প্রতিষ্ঠিত"),
    "graduation": ("graduates degree", r"\bgraduates?\b|গ্র্যাজুয়েট"),
    "law": ("act law", r"\bact\b|\blaw\b|আইন"),
    "discipline": ("disciplines", r"\bdisciplines?\b|ডিসিপ্লিন"),
    "category": ("category", r"\bcategory\b|ক্যাটাগরি"),
    "edition": ("edition", r"\bedition\b|সংস্করণ"),
}
PROTECTED = (
    r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", r"\d+(?:\.\d+)?\s*%", r"\b\d{1,2}[/-]\d{1,2}[/-](?:\d{2}|\d{4})\b", r"\b\d+(?:\.\d+)?\b", r"\b[A-Z]{2,}(?:\.[A-Z]+)*\b",
)
KEPT = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\b\d+(?:\.\d+)?%?(?!\w)|\b[A-Z]{2,}(?:\.[A-Z]+)*\b"
MOST_CONCEPTS, LONGEST = 5, 180
NOT_REQUIRED = ("course", "degree", "university")


def concepts(text: Column) -> Column:
    """Names of the concepts that a text has, in the table's order."""
    t = T.normalize_unicode(text)
    return F.array_compact(F.array(*[F.when(U.matches(t, p), F.lit(k)) for k, (_, p) in CONCEPTS.items()]))


def protected(text: Column) -> Column:
    """Codes, addresses, percentages, dates, numbers and acronyms, sorted: what no rewriting may lose or add."""
    t = T.normalize_unicode(text)
    found = F.concat(F.transform(U.course_entities(text), lambda e: e["compact"]), *[F.transform(F.regexp_extract_all(t, F.lit("(?U)" + p), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))) for p in PROTECTED])
    return F.array_sort(F.array_distinct(found))


def rewrite_verdict(question: Column, rewritten: Column) -> Column:
    """VALIDATED, or why a rewriting cannot stand for the question."""
    plain = F.trim(F.regexp_replace(F.coalesce(rewritten, F.lit("")), "^[\"' ]+|[\"' ]+$", ""))

    def told(t: Column) -> Column:
        named = F.transform(U.requested_entities(t), lambda e: F.concat(e["kind"], F.lit(":"), e["normalized"]))
        return F.struct(t.alias("t"), protected(t).alias("facts"), named.alias("named"), U.requested_field(t).alias("field"), concepts(t).alias("concepts"))

    def of(x: Column) -> Column:
        own, new, r = x["own"], x["new"], x["new"]["t"]
        return (
            F.when((r == "") | (F.length(r) > LONGEST) | F.contains(r, F.lit("\n")) | r.rlike("[ঀ-৿]"), "NOT_CONCISE_ENGLISH_QUERY")
            .when(F.size(F.array_except(own["facts"], new["facts"])) > 0, "PROTECTED_FACT_CHANGED").when(F.size(F.array_except(new["facts"], own["facts"])) > 0, "NEW_PROTECTED_FACT")
            .when(F.size(F.array_except(own["named"], new["named"])) > 0, "ENTITY_CHANGED").when((own["field"] != "general") & (new["field"] != "general") & (new["field"] != own["field"]), "FIELD_CHANGED")
            .when((F.size(own["concepts"]) > 0) & ~F.arrays_overlap(own["concepts"], new["concepts"]), "CONCEPT_CHANGED").otherwise("VALIDATED")
        )

    return T.let(F.struct(T.let(F.coalesce(question, F.lit("")), told).alias("own"), T.let(plain, told).alias("new")), of)


def rewritten(question: Column) -> Column:
    """struct<query, method, validation>: codes, search words of the first concepts and of the field, and what else must be
    kept. Without a code it takes two concepts; what does not validate is no rewriting."""
    terms = F.create_map(*[x for k, (word, _) in CONCEPTS.items() for x in (F.lit(k), F.lit(word))])
    t = T.normalize_unicode(question)
    parts = F.struct(F.transform(U.course_entities(question), lambda e: e["raw"]).alias("codes"), concepts(question).alias("had"), U.requested_field(question).alias("field"), F.regexp_extract_all(t, F.lit("(?U)" + KEPT), F.lit(0)).alias("kept"))

    def query(x: Column) -> Column:
        words = F.transform(F.slice(x["had"], 1, MOST_CONCEPTS), lambda k: F.element_at(terms, k))
        inside = F.array_join(x["codes"], " ")
        others = F.filter(x["kept"], lambda y: ~F.contains(inside, y))
        said = F.array_join(F.array_distinct(F.concat(x["codes"], words, F.array_compact(F.array(F.element_at(terms, x["field"]))), others)), " ")
        return F.when((F.size(x["codes"]) > 0) | (F.size(x["had"]) >= 2), said)

    def of(q: Column) -> Column:
        made = lambda text, method, why: F.struct(text.alias("query"), F.lit(method).alias("method"), why.alias("validation"))
        return F.when(q.isNull(), made(F.lit(""), "NONE", F.lit("NO_RELIABLE_DETERMINISTIC_QUERY"))).otherwise(T.let(rewrite_verdict(question, q), lambda v: F.when(v == "VALIDATED", made(q, "DETERMINISTIC", v)).otherwise(made(F.lit(""), "NONE", v))))

    return T.let(T.let(parts, query), of)


def fused(first: DataFrame, second: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """fuse_two() with the language of each chunk. Rankings without a chunk_id are known by source, page and rank."""
    key = lambda df: df.withColumn("chunk_id", F.coalesce(F.nullif(F.col("chunk_id").cast("string"), F.lit("")), F.concat_ws(":", "source", F.col("page").cast("string"), F.col("rank").cast("string")))) if {"source", "page"} <= set(df.columns) else df
    out = R.fuse_two(key(first), key(second), k)
    own = chunks.select(F.col("chunk_id").cast(out.schema["chunk_id"].dataType).alias("chunk_id"), T.script_profile(F.col("text")).alias("chunk_language"))
    return out.join(own, "chunk_id", "left")


def second_assessment(first: DataFrame, second: DataFrame) -> DataFrame:
    """Which assessment of a question holds, by query_id: `gate` says why, `adopted` whether the second one does.

    first, second: assessed() for the question and for its rewriting (second with `query` and `validation`). The question's
    own assessment holds unless it is insufficient; the rewriting's holds if it conflicts, or if it is supported and the
    evidence has two of its words (or its only one).
    """
    a, b = first.select("query_id", F.col("support").alias("own")), second.select("query_id", "query", "validation", F.col("support").alias("other"), F.lower(F.coalesce("best.excerpt", F.lit(""))).alias("said"))
    words = F.filter(F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*NOT_REQUIRED))
    there = F.size(F.filter(words, lambda w: F.contains(F.col("said"), w)))
    gate = (
        F.when(F.col("own") != "insufficient", "ORIGINAL_QUERY_GATE").when((F.coalesce("query", F.lit("")) == "") | (F.col("validation") != "VALIDATED"), "REWRITE_NOT_VALIDATED")
        .when(F.col("other") == "conflicting", "CANONICAL_QUERY_CONFLICT").when(F.col("other") != "supported", "CANONICAL_QUERY_GATE_FAILED")
        .when((F.size(words) > 0) & (there < F.least(F.lit(2), F.size(words))), "CANONICAL_TERMS_NOT_IN_EVIDENCE").otherwise("CANONICAL_QUERY_GATE")
    )
    return a.join(b, "query_id", "left").select("query_id", gate.alias("gate"), gate.isin("CANONICAL_QUERY_CONFLICT", "CANONICAL_QUERY_GATE").alias("adopted"))


def rewritings(questions: DataFrame) -> DataFrame:
    """query_id, query, method, validation of the questions (query_id, text) in Bangla or Banglish; query is blank where no
    rewriting stands for the question."""
    q = questions.select("query_id", F.coalesce("text", F.lit("")).alias("question"))
    other = q.where(U.language(F.col("question")).isin("bangla", "banglish"))
    return stored(other.withColumn("w", rewritten(F.col("question"))).select("query_id", "w.*"), "rewritten")


def rankings(chunks: DataFrame, questions: DataFrame, again: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """BM25's rankings (query_id, chunk_id, rank) of the questions and of their rewritings (again), from one reading of the
    corpus: both forms are queries of one batch over one stored table of postings."""
    form = lambda df, n, text: df.select(F.struct("query_id", F.lit(n).alias("form")).alias("query_id"), text.alias("text"))
    both = form(questions, 0, F.col("text")).unionByName(form(again.where("query != ''"), 1, F.col("query")))
    found = stored(R.bm25(chunks, both, k).select("query_id.*", "chunk_id", "rank"), "rankings")
    return tuple(found.where(F.col("form") == n).select("query_id", "chunk_id", "rank") for n in (0, 1))  # type: ignore[return-value]


def second_pass(chunks: DataFrame, first: DataFrame, own: DataFrame, other: DataFrame, again: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(gates, second): the assessments of rewritings over both rankings fused, for the questions whose own assessment
    (first) is insufficient, and which of both holds (see second_assessment())."""
    weak = first.where("support = 'insufficient'").select("query_id")
    good = again.where("query != ''").join(weak, "query_id", "left_semi")
    both = R.fuse_two(own.join(good.select("query_id"), "query_id", "left_semi"), other.join(good.select("query_id"), "query_id", "left_semi"), k).select("query_id", "chunk_id", "rank")
    asked = good.select("query_id", F.col("query").alias("question")).withColumn("a", U.analysis(F.col("question")))
    second = stored(V.assessed(both.join(chunks, "chunk_id"), asked).join(again, "query_id"), "assessed")
    return second_assessment(first, second), second


def reassessed(chunks: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Assessments of questions (query_id, text) of which those in Bangla or Banglish with insufficient evidence are asked
    again in English, over both rankings fused: query_id, gate, adopted, status, reason, level, query."""
    q = questions.select("query_id", F.coalesce("text", F.lit("")).alias("question")).withColumn("a", U.analysis(F.col("question")))
    again = rewritings(questions)
    own, other = rankings(chunks, questions, again, k)
    first = stored(V.assessed(own.join(chunks, "chunk_id"), q), "assessed")
    gates, second = second_pass(chunks, first, own, other, again, k)
    new = second.select("query_id", "query", *[F.col(c).alias(f"new_{c}") for c in ("status", "reason", "level")])
    out = first.join(gates, "query_id").join(new, "query_id", "left")
    return out.select("query_id", "gate", "adopted", *[F.when(F.col("adopted"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("status", "reason", "level")], "query")
