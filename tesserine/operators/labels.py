"""Retrieval labels: which candidates match the expected sources and pages, scores that are null where nothing is labelled,
rates over the rows that they apply to, failure classes and selections of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import understanding as U
from . import evidence as V
from .retrieval import ranked


def _path(c: Column) -> Column:
    return F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")))


def _name(c: Column) -> Column:
    return F.regexp_extract(_path(c), "([^/]*)$", 1)


def source_match(source: Column, relative_path: Column, expected: Column) -> Column:
    """An expected source (array) is the candidate's source or path, or has the same file name; any case, either slash."""
    own = F.array(_path(source), _path(relative_path), _name(source), _name(relative_path))
    return F.exists(F.coalesce(expected, F.array().cast("array<string>")), lambda e: F.array_contains(own, _path(e)) | F.array_contains(own, _name(e)))


def page_match(page: Column, expected: Column) -> Column:
    return F.coalesce(F.array_contains(expected, page.cast("string")), F.lit(False))


def is_hit(source: Column, relative_path: Column, page: Column, sources: Column, pages: Column, pairs: Column) -> Column:
    """A candidate matches its expectation: one pair of source and page if there are pairs, else a source and a page of
    those that are given."""
    none = F.array().cast("array<string>")
    paired = F.exists(pairs, lambda p: source_match(source, relative_path, F.array(p["source"])) & page_match(page, F.array(p["page"])))
    apart = ((F.size(F.coalesce(sources, none)) <= 0) | source_match(source, relative_path, sources)) & ((F.size(F.coalesce(pages, none)) <= 0) | page_match(page, pages))
    return F.coalesce(F.when(F.size(pairs) > 0, paired).otherwise(apart), F.lit(False))


def scores(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: hit_1, hit_3, mrr_3, source_accuracy, page_accuracy (the last two of rank 1), entity_hit_1/3, field_hit_1/3.

    candidates: query_id, rank, source, relative_path, page, text, field_types; expected: query_id, question, sources,
    pages (arrays), pairs (array<struct<source,page>>). Null where the query has no such label, no entity or no field;
    false and 0 where it has one and no candidate does it.
    """
    e = expected.select("query_id", "sources", "pages", "pairs", U.requested_field(F.col("question")).alias("field"), F.get(F.transform(U.course_entities(F.col("question")), lambda x: x["compact"]), F.lit(0)).alias("entity"))
    rows = e.join(candidates.where(F.col("rank") <= 3), "query_id", "left")
    there = F.col("rank").isNotNull()
    hit = there & is_hit(F.col("source"), F.col("relative_path"), F.col("page"), F.col("sources"), F.col("pages"), F.col("pairs"))
    first = F.col("rank") == 1
    with_entity = there & F.contains(V.code_key(F.col("text")), F.col("entity"))
    with_field = there & (U.field_named(F.col("field"), F.coalesce("text", F.lit(""))) | F.coalesce(F.array_contains("field_types", F.col("field")), F.lit(False)))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = rows.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("at"), some(first & source_match(F.col("source"), F.col("relative_path"), F.col("sources"))).alias("_source"), some(first & page_match(F.col("page"), F.col("pages"))).alias("_page"),
        some(first & with_entity).alias("_e1"), some(with_entity).alias("_e3"), some(first & with_field).alias("_f1"), some(with_field).alias("_f3"),
    )
    out = e.join(per, "query_id")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    labelled, fielded = n("sources") | n("pages") | n("pairs"), F.col("field") != "general"
    return out.select(
        "query_id", F.when(labelled, F.coalesce(F.col("at") == 1, F.lit(False))).alias("hit_1"), F.when(labelled, F.col("at").isNotNull()).alias("hit_3"), F.when(labelled, F.round(F.coalesce(1.0 / F.col("at"), F.lit(0.0)), 6)).alias("mrr_3"),
        F.when(n("sources"), F.col("_source")).alias("source_accuracy"), F.when(n("pages"), F.col("_page")).alias("page_accuracy"), F.when(F.col("entity").isNotNull(), F.col("_e1")).alias("entity_hit_1"),
        F.when(F.col("entity").isNotNull(), F.col("_e3")).alias("entity_hit_3"), F.when(fielded, F.col("_f1")).alias("field_hit_1"), F.when(fielded, F.col("_f3")).alias("field_hit_3"),
    )


def rates(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """(by, measure, numerator, denominator, rate, low, high): each boolean measure over the rows where it is not null."""
    flat = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("boolean").alias("v")) for m in measures])).alias("x")).select(*by, "x.*")
    out = flat.groupBy(*by, "measure").agg(F.count_if("v").alias("numerator"), F.count("v").alias("denominator"))
    low, high = S.wilson(F.col("numerator"), F.col("denominator"))
    return out.select(*by, "measure", "numerator", "denominator", F.round(S.share(F.col("numerator"), F.col("denominator")), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def breakdowns(rows: DataFrame, dimensions: list[str], measures: list[str], least: dict[str, int] | None = None) -> DataFrame:
    """Means of measures over all rows and over each value of each dimension: dimension, value, n, mean_<measure>.

    Blank values are passed over; a dimension in `least` lists values of at least so many rows. One pass: each row stands
    once for each dimension, and groups combine in each task.
    """
    own = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]]
    flat = rows.select(F.explode(F.array(*own)).alias("k"), *[F.col(m).cast("double").alias(m) for m in measures]).where("trim(coalesce(k.value, '')) != ''")
    out = flat.groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in measures])
    for d, n in (least or {}).items():
        out = out.where((F.col("dimension") != d) | (F.col("n") >= n))
    return out


def summary_delta(before: DataFrame, after: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, before, after, delta) of two one-row summaries."""
    flat = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(name)) for m in measures])).alias("x")).select("x.*")
    return flat(before, "before").join(flat(after, "after"), "measure").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def expected_pages(value: Column, digits_only: bool = True) -> Column:
    """Pages of a cell: parts between ';' or, without one, ','; whole numbers alone, or whatever is not blank."""
    v = F.coalesce(value, F.lit(""))
    parts = F.transform(F.when(F.contains(v, F.lit(";")), F.split(v, ";")).otherwise(F.split(v, ",")), lambda x: F.trim(x))
    return F.filter(parts, lambda p: p.rlike("^[0-9]+$") if digits_only else p != "")


def failure_channels(dense: Column, sparse: Column, fused: Column) -> Column:
    """Which channel missed an expected page that another had."""
    return (
        F.when(fused, "NONE").when(~dense & ~sparse, "BOTH_MISSED").when(dense & sparse, "FUSION_FAILURE").when(dense, "SPARSE_FAILURE").otherwise("DENSE_FAILURE")
    )


#: What a miss is put down to, in order of precedence, by the signal of failure_signals() that says so; the last
#: stands where none does.
CAUSES = {
    "fused": (
        ("LABEL_AMBIGUITY", "several_pages"), ("BOTH_MISSED", "neither"), ("DENSE_MISSED", "not_dense"), ("SPARSE_MISSED", "not_sparse"), ("ENTITY_METADATA_MISSED", "entity_unresolved"), ("FIELD_METADATA_MISSED", "field_unsupported"),
        ("FUSION_RANK_ERROR", None),
    ),
    "normalized": (
        ("LANGUAGE_DETECTION_ERROR", "other_language"), ("GROUND_TRUTH_LABEL_AMBIGUITY", "several_pages"), ("QUERY_NORMALIZATION_ERROR", "entity_lost"), ("DENSE_CANDIDATE_MISS", "not_dense"), ("SPARSE_CANDIDATE_MISS", "not_sparse"),
        ("ENTITY_RESOLUTION_ERROR", "entity_unresolved"), ("FIELD_RESOLUTION_ERROR", "field_unsupported"), ("FUSION_ERROR", None),
    ),
    "reranked": (
        ("LANGUAGE_NORMALIZATION_ERROR", "other_language"), ("GROUND_TRUTH_LABEL_AMBIGUITY", "several_pages"), ("FIRST_STAGE_CANDIDATE_MISS", "not_pooled"), ("ENTITY_ERROR", "entity_missed"), ("FIELD_ERROR", "field_missed"), ("RERANKER_ORDERING_ERROR", None),
    ),
}


def failure_signals(expected: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """Per query what its candidates say of a miss: found, and the boolean columns that CAUSES names.

    expected: query_id, question, normalized (the question as it was searched for; null: the same), language, source, pages
    (array of numbers as text). candidates: query_id, channel (dense, sparse, metadata, final), rank, source, page, text
    and, if there is one, supported (whether it alone would support an answer: `accepted` of evidence.judged(); without it, a
    text that names the field does). language is a value of understanding.language(). A candidate is right if its source is the expected one and its page one of the expected. One shuffle of the candidates by
    query; queries without any are all misses; a null expectation is met by none.
    """
    named = lambda c: F.get(F.transform(U.course_entities(c), lambda x: x["compact"]), F.lit(0))
    searched = F.coalesce("normalized", "question")
    e = expected.select(
        "query_id", F.col("source").alias("of"), "pages", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), (~U.language(F.col("question")).eqNullSafe(F.col("language"))).alias("other_language"),
        named(F.col("question")).alias("entity"), named(searched).alias("kept"), U.requested_field(searched).alias("field"),
    )
    rows = e.join(candidates, "query_id", "left")
    right = F.coalesce((F.col("source") == F.col("of")) & page_match(F.col("page"), F.col("pages")), F.lit(False))
    channel, body = F.col("channel"), F.coalesce("text", F.lit(""))
    final = (channel == "final") & (F.col("rank") <= k)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    with_field, with_entity = U.field_named(F.col("field"), body), F.contains(V.code_key(F.col("text")), F.col("entity"))
    own = F.col("supported") if "supported" in candidates.columns else with_field
    per = rows.groupBy("query_id").agg(
        some(right & final).alias("found"), (~some(right & (channel == "dense"))).alias("not_dense"), (~some(right & (channel == "sparse"))).alias("not_sparse"), (~some(right & (channel != "final"))).alias("not_pooled"), some(channel == "metadata").alias("resolved"),
        some(own & (channel != "final")).alias("supported"), some(with_entity & final).alias("entity_there"), some(with_field & final).alias("field_there"),
    )
    fielded = F.col("field") != "general"
    return e.join(per, "query_id").select(
        "query_id", "found", "other_language", (F.col("n_pages") > 1).alias("several_pages"), (F.col("entity").isNotNull() & F.col("kept").isNull()).alias("entity_lost"), "not_dense", "not_sparse", (F.col("not_dense") & F.col("not_sparse")).alias("neither"), "not_pooled",
        (F.col("entity").isNotNull() & ~F.col("resolved")).alias("entity_unresolved"), (fielded & ~F.col("supported")).alias("field_unsupported"),
        (F.col("entity").isNotNull() & ~F.col("entity_there")).alias("entity_missed"), (fielded & ~F.col("field_there")).alias("field_missed"),
    )


def failure_cause(causes: str) -> Column:
    """The first cause of CAUSES[causes] whose signal holds; null where the right passage was found."""
    out = F.when(F.col("found"), F.lit(None).cast("string"))
    for name, signal in CAUSES[causes]:
        out = out.when(F.col(signal), name) if signal else out.otherwise(name)
    return out


def histogram(rows: DataFrame, value: str, by: list[str], values: list[str]) -> DataFrame:
    """Counts of each value within each group and overall: a column n_<value> for each, 0 where there is none, `other` for
    what is not listed (null too) and `total`. level is `all` or the name of the dimension, `of` its value. One pass: each
    row stands once for each dimension, and groups combine in each task."""
    count = [F.count_if(F.col(value) == v).alias(f"n_{v}") for v in values]
    sets = [F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(b).alias("level"), F.col(b).cast("string").alias("value")) for b in by]]
    flat = rows.select(F.col(value), F.explode(F.array(*sets)).alias("g"))
    return flat.groupBy(F.col("g.level").alias("level"), F.col("g.value").alias("of")).agg(*count, F.count_if(~F.coalesce(F.col(value).isin(values), F.lit(False))).alias("other"), F.count("*").alias("total"))


def with_gold(results: DataFrame, gold: DataFrame, key: str = "question_id") -> DataFrame:
    """results with their row of the gold table. ValueError that names keys (five at most) if one has none, or has several."""
    repeated = gold.groupBy(key).count().where("count > 1").select(key)
    wrong = results.select(key).distinct().join(gold.select(key), key, "left_anti").unionByName(results.select(key).distinct().join(repeated, key, "left_semi"))
    if named := [r[0] for r in wrong.limit(5).collect()]:
        raise ValueError(f"not one gold row: {named}")
    return results.join(gold, key)


def funnel(found: dict[int, Column], rewritten: Column, validated: Column, supported: Column) -> Column:
    """The stage at which an expected passage was lost; found: by depth, whether it is among the first so many."""
    out = F.when(supported, "SUPPORTED")
    for depth in sorted(found):
        out = out.when(found[depth], F.lit(f"EVIDENCE_GATE_AT_{depth}") if depth == min(found) else F.lit(f"RANKED_BELOW_{min(found)}_WITHIN_{depth}"))
    return out.when(~rewritten, "NOT_REWRITTEN").when(~validated, "REWRITE_NOT_VALIDATED").otherwise("NOT_RETRIEVED")


def paired_depths(expected: DataFrame, candidates: DataFrame, depths: tuple[int, ...] = (1, 3, 10, 30)) -> DataFrame:
    """Per (question_id, language): whether the chunk that the English variant was supported by is among the first so many
    candidates. expected: question_id, chunk_ids (array); candidates: question_id, language, chunk_id, rank."""
    near = candidates.join(expected, "question_id").withColumn("hit", F.array_contains("chunk_ids", F.col("chunk_id")))
    return near.groupBy("question_id", "language").agg(*[F.coalesce(F.bool_or(F.col("hit") & (F.col("rank") <= d)), F.lit(False)).alias(f"within_{d}") for d in depths])


def recovered_parity(baseline: DataFrame, recovered: DataFrame) -> DataFrame:
    """Statuses before and after a recovery run: baseline (base, language, status), recovered the same for some."""
    new = recovered.select("base", "language", F.col("status").alias("_new"))
    return baseline.join(new, ["base", "language"], "left").select("base", "language", F.col("status").alias("before"), F.coalesce("_new", "status").alias("after"))


def best_configuration(summaries: DataFrame, name: str, keys: list[str], guarded: list[str], baseline: str, slack: float = 0.01) -> DataFrame:
    """The configuration with the greatest keys, in their order, among those no more than `slack` below the baseline in any
    guarded measure; among all if none is. Ties: the first name."""
    floor = summaries.where(F.col(name) == baseline).select(*[(F.col(g) - slack).alias(f"_{g}") for g in guarded], F.lit(1).alias("_k"))
    ok = F.lit(True)
    for g in guarded:
        ok = ok & (F.col(g) >= F.col(f"_{g}") - 1e-12)
    rows = summaries.withColumn("_k", F.lit(1)).join(floor, "_k").withColumn("allowed", ok)
    return ranked(rows.withColumn("_all", F.lit(1)), ["_all"], [F.desc("allowed"), *[F.desc(k) for k in keys], F.asc(name)], 1).select(name, "allowed", *keys)


def legacy_selection(candidates: DataFrame, k: int) -> DataFrame:
    """Rank 1 stays first; the other places go by semantic score, then by rank: query_id, chunk_id, place."""
    order = [F.when(F.col("rank") == 1, 0).otherwise(1), F.desc("semantic_score"), F.asc("rank")]
    return ranked(candidates, ["query_id"], order, k, "place").select("query_id", "chunk_id", "place")
