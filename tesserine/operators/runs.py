"""Benchmark runs: descriptors, preparation, one row per inference, audits, summaries and samples of what happened."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources import files
from . import evaluation as E
from . import evidence as V
from .retrieval import ranked

# Fixed values.
LANGUAGES = ("english", "bangla", "banglish")
QUESTIONS = {"english": ["english_question", "English Query", "english_query", "question_en"], "bangla": ["bangla_question", "Bengali Query", "bengali_query", "question_bn"], "banglish": ["banglish_question", "Banglish Query", "banglish_query", "question_bl"]}
REFERENCES = {"english": ["ground_truth_answer_en", "reference_answer_en", "reference_answer"], "bangla": ["ground_truth_answer_bn", "reference_answer_bn", "reference_answer"], "banglish": ["ground_truth_answer_banglish", "reference_answer_banglish", "reference_answer"]}
ANNOTATIONS = ("verified", "needs_review", "source_conflict", "ambiguous_reference", "unsupported")
CLASSES, MODES = ("DEVELOPMENT", "PILOT", "FINAL_BENCHMARK"), ("full", "skip_generation", "retrieval_only")
MOJIBAKE = "Ã.|â€|à¦|à§|�"
PAIRS = "array<struct<source:string,page:string>>"


class RunError(ValueError):
    """A dataset or a run that must not be used."""


def descriptors(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """One row for each question in each language: evaluation_id '<question_id>:<language>', question, reference_answer,
    expected_sources, expected_pages, expected_evidence, annotation_status, intent, difficulty, course_code."""
    first = lambda names: files.first_of(rows, names)
    each = [F.struct(F.lit(x).alias("language"), first(QUESTIONS[x]).alias("question"), first(REFERENCES[x]).alias("reference_answer")) for x in languages]
    out = rows.select(
        first(["question_id", "Question ID", "ID", "id"]).alias("base_question_id"), F.explode(F.array(*each)).alias("q"), files.labels(first(["expected_sources", "expected_source"])).alias("expected_sources"),
        files.labels(first(["expected_pages", "expected_page", "expected_page_of_answer"])).alias("expected_pages"), F.from_json(first(["expected_evidence"]), PAIRS).alias("expected_evidence"),
        F.coalesce(first(["ground_truth_status", "annotation_status"]), F.lit("unlabeled")).alias("annotation_status"), first(["intent", "expected_intent"]).alias("intent"), first(["difficulty"]).alias("difficulty"), first(["course_code"]).alias("course_code"),
    )
    out = out.select("base_question_id", "q.*", *[c for c in out.columns if c not in ("base_question_id", "q")]).where("question is not null")
    return out.withColumn("evaluation_id", F.concat_ws(":", "base_question_id", "language"))


def dataset_problems(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, references: bool = False) -> DataFrame:
    """(question_id, problem): repeated ids, unknown annotations, labels that are blank or no page numbers, evidence that is
    no list of pairs, no question, a question that is asked twice, broken letters, a missing reference (if needed)."""
    first = lambda names: files.first_of(rows, names)
    qid = first(["question_id", "Question ID", "ID", "id"])
    pages, sources = first(["expected_pages", "expected_page", "expected_page_of_answer"]), first(["expected_sources", "expected_source"])
    asked = [first(QUESTIONS[x]) for x in languages]
    text = F.concat_ws("\n", *asked)
    raw = lambda v: F.coalesce(F.when(F.startswith(F.trim(v), F.lit("[")), F.from_json(v, "array<string>")), F.split(v, r"\s*[;|]\s*"))
    evidence, status = first(["expected_evidence"]), first(["ground_truth_status", "annotation_status"])
    pairs = F.from_json(evidence, PAIRS)
    tests = [
        ("unknown_annotation", status.isNotNull() & ~F.coalesce(status.isin(*ANNOTATIONS), F.lit(False))), ("blank_label", F.coalesce(F.exists(raw(sources), lambda x: F.trim(x) == ""), F.lit(False))),
        ("invalid_page", F.coalesce(F.exists(raw(pages), lambda x: ~F.trim(x).rlike(r"^[1-9]\d*$")), F.lit(False))), ("no_question", F.trim(text) == ""), ("broken_letters", text.rlike(MOJIBAKE)),
        ("invalid_evidence", evidence.isNotNull() & (pairs.isNull() | F.coalesce(F.exists(pairs, lambda p: F.coalesce(p["source"], F.lit("")).isin("") | ~F.coalesce(p["page"], F.lit("")).rlike(r"^[1-9]\d*$")), F.lit(False)))),
    ]
    if references:
        tests += [(f"no_{x}_reference", q.isNotNull() & first(REFERENCES[x]).isNull()) for x, q in zip(languages, asked, strict=True)]
    own = rows.select(qid.alias("question_id"), F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests]))).alias("problem"))
    ids = rows.select(qid.alias("question_id")).groupBy("question_id").count().where("count > 1").select("question_id", F.lit("repeated_question_id").alias("problem"))
    same = rows.select(qid.alias("question_id"), F.lower(F.trim(text)).alias("t")).where("t != ''").groupBy("t").agg(F.count("*").alias("n"), F.min("question_id").alias("question_id")).where("n > 1").select("question_id", F.lit("repeated_question").alias("problem"))
    return own.unionByName(ids).unionByName(same)


def prepare(rows: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, limit: int | None = None, mode: str = "full", classification: str = "DEVELOPMENT", every: int = 10, strict: bool = True, references: bool = False, saved: dict | None = None) -> tuple[DataFrame, dict]:
    """(descriptors, manifest) of a run. RunError for settings that contradict each other, an unfit dataset, or, with the
    saved manifest of a run to go on with, any difference from it."""
    if every < 1 or (limit is not None and limit < 1) or classification not in CLASSES or mode not in MODES:
        raise RunError("interval and limit must be positive, classification and mode known")
    if classification == "FINAL_BENCHMARK" and (not strict or mode != "full" or limit is not None):
        raise RunError("a final benchmark is strict, full and without a limit")
    found = dataset_problems(rows, languages, references).limit(10).collect()
    if found:
        raise RunError("; ".join(f"{r['question_id']}: {r['problem']}" for r in found))
    asked = descriptors(rows, languages)
    if limit is not None:
        asked = asked.orderBy("base_question_id", "language").limit(limit)
    ids = asked.agg(F.count("*").alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list("evaluation_id"))), 256).alias("ids")).first()
    settings = {"languages": list(languages), "limit": limit, "mode": mode, "classification": classification, "every": every, "strict": strict, "references": references}
    manifest = {"settings": settings, "expected_rows": ids["n"], "evaluation_ids_sha256": ids["ids"]}
    manifest["compatibility_sha256"] = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    if saved is not None and {k: saved.get(k) for k in manifest} != manifest:
        raise RunError("the saved run has another dataset, other settings or other questions")
    return asked, manifest


def inference_rows(asked: DataFrame, answers: DataFrame, run_id: str) -> DataFrame:
    """One row per descriptor with its answer's columns (evaluation_id, status, answer, allowed, error, excerpts, relation,
    relation_values, ...): a missing answer or an error is SYSTEM_ERROR; only SUPPORTED and allowed answers are returned,
    and those are audited. Labels stand beside, they never went in."""
    out = asked.join(answers, "evaluation_id", "left").withColumn("run_id", F.lit(run_id))
    error = F.substring(F.coalesce("error", F.lit("")), 1, 300)
    out = out.withColumn("error", error).withColumn("error_type", F.element_at(F.split("error", ":"), 1))
    out = out.withColumn("answerability_status", F.when((F.col("error") != "") | F.col("status").isNull(), "SYSTEM_ERROR").otherwise(F.col("status"))).drop("status")
    out = out.withColumn("answer_returned", (F.col("answerability_status") == "SUPPORTED") & F.coalesce("allowed", F.lit(True)))
    none = F.array().cast("array<string>")
    failures = V.safety_failures(F.col("question"), F.col("answer"), F.coalesce("excerpts", none), F.col("relation"), F.coalesce("relation_values", none))
    return out.withColumn("answer_safety_failures", F.when(F.col("answer_returned"), failures).otherwise(none)).withColumn("reference_available", F.coalesce("reference_answer", F.lit("")) != "")


def traces(rows: DataFrame) -> DataFrame:
    """run_id, evaluation_id, language and the fields of each candidate in retrieval_top3."""
    return rows.select("run_id", "evaluation_id", "language", F.explode("retrieval_top3").alias("c")).select("run_id", "evaluation_id", "language", "c.*")


def flat_summary(summary: DataFrame, group: str) -> DataFrame:
    """A summary of structs as columns: group, value, n and every field as <struct>_<field>."""
    columns = []
    for f in summary.schema:
        nested = getattr(f.dataType, "fields", None)
        columns += [F.col(f"{f.name}.{x.name}").alias(f"{f.name}_{x.name}") for x in nested] if nested else [F.col(f.name)]
    return summary.select(F.lit(group).alias("group"), *columns)


def generation_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Generation per group: attempts, questions that used it, accepted, rejected, retries and successful ones, medians of
    seconds and tokens over those that used it, share of answers that kept all facts."""
    used, safe = F.col("generation_used"), F.col("safe")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("attempts").alias("attempts"), F.count_if(used).alias("used"), F.count_if(used & safe).alias("accepted"), F.count_if((F.col("attempts") > 0) & (F.col("status") == "GENERATION_REJECTED")).alias("rejected"),
        F.count_if("retried").alias("retries"), F.count_if(F.col("retried") & safe).alias("successful_retries"), F.round(F.median(F.when(used, F.col("seconds"))), 6).alias("median_seconds"),
        F.round(F.median(F.when(used, F.col("tokens"))), 6).alias("median_tokens"), F.round(S.share(F.count_if(used & F.col("facts_kept")), F.count_if(used & F.col("facts_kept").isNotNull())), 6).alias("facts_kept_rate"),
    )


def resource_extremes(rows: DataFrame, peaks: list[str], floors: list[str]) -> DataFrame:
    """max_<column> and min_<column> of text columns; cells that are no numbers are passed over."""
    n = lambda c: F.col(c).try_cast("double")
    return rows.agg(*[F.max(n(c)).alias(f"max_{c}") for c in peaks], *[F.min(n(c)).alias(f"min_{c}") for c in floors])


def generation_failure(status: Column, attempts: Column, language: Column, grounded: Column, semantic: Column, empty: Column) -> Column:
    """Why a generated answer was not returned."""
    off = lambda c: F.coalesce(~c, F.lit(False))
    return (
        F.when(status == "SUPPORTED", "NONE").when(F.coalesce(attempts, F.lit(0)) == 0, "NOT_ATTEMPTED").when(empty, "EMPTY_OUTPUT").when(off(language), "LANGUAGE_FAILURE")
        .when(off(grounded), "GROUNDING_FAILURE").when(off(semantic), "SEMANTIC_FAILURE").otherwise("OTHER")
    )


def audit(rows: DataFrame) -> DataFrame:
    """Rows with `audit`: what is wrong with a returned answer, each once: unsafe gate, wrong language, blank answer, no
    evidence, failures of the safety rules; or an answer that came back though the status forbids it."""
    safe = E.safe_return(F.col("answer_returned"), F.col("grounding_status"), F.col("semantic_status"), F.col("language_status"), F.col("answer_safety_failures"))
    back = F.coalesce("answer_returned", F.lit(False))
    tests = [("UNSAFE_GATE", back & ~safe), ("WRONG_LANGUAGE", back & ~F.coalesce("language_status", F.lit(False))), ("BLANK_ANSWER", back & (F.trim(F.coalesce("answer", F.lit(""))) == "")), ("NO_EVIDENCE", back & (F.coalesce("evidence_count", F.lit(0)) == 0)), ("RETURNED_WITHOUT_SUPPORT", back & (F.col("answerability_status") != "SUPPORTED"))]
    said = F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests])), F.when(back, F.coalesce("answer_safety_failures", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))
    return rows.withColumn("audit", said)


def evidence_audit(rows: DataFrame) -> DataFrame:
    """Per chunk that backed an answer: its first row by evaluation_id, its languages, and how often it was used."""
    return rows.where("chunk_id is not null").groupBy("chunk_id").agg(F.min_by("excerpt", "evaluation_id").alias("excerpt"), F.min("evaluation_id").alias("first_evaluation"), F.array_sort(F.collect_set("language")).alias("languages"), F.count("*").alias("uses"))


def status_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after, change): NEW, LOST_SUPPORT, GAINED_SUPPORT, SAME or OTHER_CHANGE of each row of `after`."""
    old = before.select(*keys, F.col("status").alias("before"))
    change = F.when(F.col("before").isNull(), "NEW").when(F.col("before") == F.col("after"), "SAME").when(F.col("after") == "SUPPORTED", "GAINED_SUPPORT").when(F.col("before") == "SUPPORTED", "LOST_SUPPORT").otherwise("OTHER_CHANGE")
    return after.select(*keys, F.col("status").alias("after")).join(old, keys, "left").select(*keys, "before", "after", change.alias("change"))


def relabelled(rows: DataFrame, rules: list[tuple[Column, str]], column: str = "failure") -> DataFrame:
    """The column replaced by the first rule that holds, or as it was."""
    return rows.withColumn(column, F.coalesce(*[F.when(test, label) for test, label in rules], F.col(column)))


def tiered_sample(rows: DataFrame, tiers: list[tuple[Column, int]], key: str, mandatory: list[str] = ()) -> DataFrame:
    """Mandatory keys, then of each tier at most its number; a row is of the first tier that it fits. Rows come in the order
    of their key; `tier` is 0 for mandatory ones."""
    tier = F.when(F.col(key).cast("string").isin(*mandatory), 0) if mandatory else F.when(F.lit(False), 0)
    for i, (test, _) in enumerate(tiers, 1):
        tier = tier.when(test, i)
    own = rows.withColumn("tier", tier)
    out = own.where("tier = 0")
    for i, (_, n) in enumerate(tiers, 1):  # a limit that is a number is taken in each task before rows meet
        out = out.unionByName(own.where(F.col("tier") == i).orderBy(F.asc(key)).limit(n))
    return out


def category_sample(rows: DataFrame, category: str, order: list[str], key: str, size: int) -> DataFrame:
    """The first row (by key) of each category in `order`, then rows in the order of the key, `size` in all."""
    first = ranked(rows, [category], [F.asc(key)], None, "_nth")
    place = F.lit(len(order))
    for i, c in enumerate(order):
        place = F.when((F.col(category) == c) & (F.col("_nth") == 1), i).otherwise(place)
    out = ranked(first.withColumn("_place", place).withColumn("_all", F.lit(1)), ["_all"], [F.asc("_place"), F.asc(key)], size, "_n")
    return out.drop("_nth", "_place", "_all", "_n")


def spelling_checks(cases: DataFrame) -> DataFrame:
    """(query, passed): all expected terms are in the retrieval text and the language is as expected."""
    from ..functions import understanding as U

    low = U.retrieval_text(F.col("query"))
    return cases.select("query", (F.forall("expected", lambda t: F.contains(low, F.lower(t))) & (U.language(F.col("query")) == F.col("language"))).alias("passed"))


def factual_overlap(pairs: DataFrame) -> DataFrame:
    """Of (pair_id, reference, answer): precision, recall and f1 over words of more than one character with their marks,
    and whether all addresses, codes, numbers and dates of the reference are in the answer (null if it has none)."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9@.+%-]+"), F.lit(0)), lambda t: F.length(t) > 1))
    p, r, f = S.precision_recall_f1(words("answer"), words("reference"))
    kinds = ("emails", "course_codes", "numbers")
    wanted, got = V.facts(F.col("reference"), kinds), V.facts(F.col("answer"), kinds)
    return pairs.select("pair_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), F.when(F.size(wanted) > 0, F.size(F.array_except(wanted, got)) == 0).alias("facts_kept"))


def joined_candidates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per query the candidates' columns as text joined by ';' in the order of their rank."""
    each = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    out = rows.groupBy("query_id").agg(each.alias("_all"))
    return out.select("query_id", *[F.array_join(F.col(f"_all.{c}").cast("array<string>"), ";").alias(c) for c in columns])


def dataset_freeze(spark: SparkSession, rows: DataFrame, path: str, dimensions: list[str]) -> dict:
    """Writes what a dataset is (rows, digest, distributions) to a JSON file once; RunError if the file says otherwise."""
    from ..storage import read_bytes, write_bytes
    from .ingest import fingerprint

    said = fingerprint(rows, sorted(rows.columns)).first()
    counts = {d: {str(r[0]): r[1] for r in rows.groupBy(d).count().collect()} for d in dimensions}
    now = {"rows": said["rows"], "fingerprint": said["fingerprint"], "columns": sorted(rows.columns), "distributions": counts}
    body = read_bytes(spark, path)
    if body is not None and json.loads(body) != now:
        raise RunError("the frozen dataset is another one")
    if body is None:
        write_bytes(spark, path, json.dumps(now, indent=2, sort_keys=True, ensure_ascii=False).encode())
    return now
