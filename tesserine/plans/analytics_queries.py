"""Ingestion, chunking and evaluation queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import ingest as I
from ..operators import structure as structure
from ..session import table


def doc_exact_dedup(spark, sf):
    return I.exact_duplicates(table(spark, sf, "documents"))


def doc_duplicate_counts(spark, sf):
    own = table(spark, sf, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return own.where("copies > 1")


def doc_profile_by_source(spark, sf):
    return I.profile(table(spark, sf, "documents"), "source")


def doc_profile_by_lang(spark, sf):
    return I.profile(table(spark, sf, "documents"), "lang")


def corpus_fingerprint_rows(spark, sf):
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", path.alias("relative_path"), sha.alias("sha256"), I.document_id(path, sha).alias("document_id"))


def page_issues(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), "text")
    return I.issues(pages)


def document_statuses(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("source").alias("document_id"), "text")
    return I.statuses(pages)


def _windows(spark, sf) -> DataFrame:
    return C.windows(table(spark, sf, "documents").select("doc_id", "text"))


def _chunks(spark, sf) -> DataFrame:
    w = C.windows(table(spark, sf, "documents").select("doc_id", "source", "text"), keep=("source",))
    return w.select(F.col("doc_id").alias("document_id"), (F.expr("word_start div 220") + 1).cast("int").alias("page"), C.chunk_id(F.col("doc_id"), F.col("word_start")).alias("chunk_id"), "text", F.lit("fallback").alias("block_type"), F.lit(None).cast("string").alias("heading"), "source", "word_start", "word_end")


def chunk_windows(spark, sf):
    return _windows(spark, sf).select("doc_id", "word_start", "word_end", F.sha2("text", 256).alias("text_sha256"))


def chunk_links(spark, sf):
    return C.links(_chunks(spark, sf)).select("document_id", "chunk_id", "previous_chunk_id", "next_chunk_id", "continuation_of")


def chunk_stats(spark, sf):
    return C.stats(_chunks(spark, sf), "source")


def chunk_quality(spark, sf):
    return C.quality(_chunks(spark, sf))


def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.strip_html(F.col("html")).alias("text"))


def page_text_blocks(spark, sf):
    pages = table(spark, sf, "documents").select(F.format_string("d%d", "doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    return structure.blocks(pages).select("block_id", "block_type", "heading", F.length("text").alias("n_chars"))


def field_types(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.field_types(F.col("text")), ",").alias("fields"))


def chunk_language_profile(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.script_profile(F.col("text")).alias("script"))


def injection_ood_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(T.strip_directives(t), 256).alias("clean_sha256"), T.out_of_domain(t).alias("out_of_domain"))


def _pairs(spark, sf) -> DataFrame:
    """User turns with the assistant's next turn."""
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference")).join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "reference", "answer")


def token_prf_proxies(spark, sf):
    return E.proxies(_pairs(spark, sf))


def overlap_gates(spark, sf):
    return E.gates(E.proxies(_pairs(spark, sf)))


def overlap_recall(spark, sf):
    return _pairs(spark, sf).select("pair_id", F.round(E.overlap_recall(F.col("answer"), F.col("reference")), 6).alias("recall"))


def _rated(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def wilson_by_group(spark, sf):
    return E.rate_summary(_rated(spark, sf), ["lang"], F.col("quality") == 1)


def latency_summary(spark, sf):
    return E.latency_summary(table(spark, sf, "events"), ["event_type"], "value")


def throughput(spark, sf):
    return E.throughput(table(spark, sf, "events"), ["event_type"], "value")


def group_summary_grouping_sets(spark, sf):
    e = table(spark, sf, "events").withColumn("hour", F.hour("ts"))
    sets = e.groupingSets([[], [F.col("event_type")], [F.col("hour")], [F.col("event_type"), F.col("hour")]], F.col("event_type"), F.col("hour"))
    out = sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_distinct("user_id").alias("users"))
    return out.where("n >= 5").select("level", "event_type", "hour", "n", "mean_value", "users")


def _signals(spark, sf) -> DataFrame:
    """Run records made of event numbers, so that every branch of the decision lists is met."""
    return table(spark, sf, "events").select("event_id", "event_type", *[(F.col("event_id") % m).alias(f"m{m}") for m in (2, 3, 5, 7, 11, 13)])


_STATUSES = ["SUPPORTED", "AMBIGUOUS_QUERY", "CONFLICTING_EVIDENCE", "GENERATION_REJECTED", "INSUFFICIENT_EVIDENCE", "RETRIEVAL_UNCERTAIN", "SYSTEM_ERROR"]


def error_classification(spark, sf):
    s = _signals(spark, sf)
    status = F.element_at(F.array(*[F.lit(x) for x in _STATUSES]), (F.col("m7") + 1).cast("int"))
    record = {"error": F.col("m13") == 12, "returned": F.col("m2") == 1, "safe": F.col("m5") > 0, "annotation": F.when(F.col("m11") == 1, "needs_review").when(F.col("m11") == 2, "source_conflict").otherwise("verified"), "status": status, "attempts": F.col("m3"), "language": F.col("m5") != 1, "grounded": F.col("m5") != 2, "semantic": F.col("m5") != 3, "hit_1": F.col("m3") == 0, "hit_3": F.col("m3") < 2}
    return s.groupBy(E.error_class(record).alias("error_class")).agg(F.count("*").alias("n"))


def safe_returns(spark, sf):
    s = _signals(spark, sf)
    safe = E.safe_return(F.col("m2") == 1, F.col("m3") > 0, F.when(F.col("m7") > 0, F.col("m7") > 1), F.col("m5") > 0, F.when(F.col("m11") == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return E.rate_summary(s, ["event_type"], safe)


def parity_categories(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
    return E.parity(e, "user_id", "event_type", F.col("best") >= 50, ("click", "purchase", "signup"))


def conflict_detection(spark, sf):
    return E.conflicts(table(spark, sf, "part"), ["p_brand", "p_type"], "p_size")


def text_language_conflicts(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_sha256"), "source")
    return E.conflicts(d, ["text_sha256"], "source")


def answerability_decision(spark, sf):
    s = _signals(spark, sf)
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("supported", "supported", "insufficient", "conflicting", "ambiguous")]), (F.col("m5") + 1).cast("int"))
    status, reason, level = E.answerability({"support": kinds, "verified": F.col("m11"), "entities": F.col("m3"), "owner_uncertain": F.col("m13") == 0, "relation": F.when(F.col("m7") == 0, False).when(F.col("m7") == 1, True), "entity_ok": F.col("m13") != 1, "field_ok": F.col("m13") != 2, "labelled": F.col("m2") == 1, "independent": F.col("m3")})
    return s.groupBy(status.alias("status"), reason.alias("reason"), level.alias("level")).agg(F.count("*").alias("n"))


def confusion_pivot(spark, sf):
    return table(spark, sf, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


def cohen_kappa(spark, sf):
    return E.kappa(table(spark, sf, "labels"), "quality", "toxic")


def weighted_kappa(spark, sf):
    bins = _rated(spark, sf).select(F.least(F.expr("n_chars div 1000"), F.lit(4)).alias("a"), F.least(F.expr("(n_chars + doc_id % 3 * 700) div 1000"), F.lit(4)).alias("b"))
    return E.kappa(bins, "a", "b", 5)


def stratified_sample(spark, sf):
    return E.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 10, "42")


def run_compare_paired(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("lang != 'fr'").select("doc_id", (F.col("n_chars") % 100).alias("score"))
    b = d.where("lang != 'es'").select("doc_id", (F.col("n_chars") % 90).alias("score"))
    return E.compare_runs(a, b, "doc_id", "score")


def resume_anti_join(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.without_known(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


def dataset_validation_report(spark, sf):
    return E.validation_report(table(spark, sf, "conversations"), ["conv_id", "turn"], ["text", "role"], {"role": ["user", "assistant"]})


def unpivot_expand(spark, sf):
    return table(spark, sf, "labels").unpivot("doc_id", ["quality", "toxic"], "rater", "score")


def rolling_latency(spark, sf):
    return spark.sql(f"""
      SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling
      FROM parquet.`{sf}/events.parquet` WHERE value IS NOT NULL""")


def best_configuration(spark, sf):
    """The source with the best rate among those no more than 0.3 below the overall rate; lexicographic ties."""
    r = E.rate_summary(_rated(spark, sf), ["source"], F.col("quality") == 1)
    floor = _rated(spark, sf).agg((F.avg((F.col("quality") == 1).cast("double")) - 0.3).alias("floor")).withColumn("_k", F.lit(1))
    ok = r.withColumn("_k", F.lit(1)).join(floor, "_k").where("rate >= floor")
    return ok.agg(F.max_by("source", F.struct("rate", "n", "source")).alias("source"), F.max("rate").alias("rate"))


_Q1 = "CAST(quality = 1 AS INTEGER)"
_SHA = "sha256(coalesce(text, ''))"
_W = f"w AS (SELECT doc_id, source, {T.words_sql('text')} AS w FROM documents), x AS (SELECT doc_id, source, w, len(w) AS n, unnest(range(0, greatest(0, CAST(ceil((len(w) - 260) / 220e0) AS BIGINT)) + 1)) * 220 AS s FROM w WHERE len(w) > 0), k AS (SELECT doc_id, source, s AS word_start, least(s + 260, n) AS word_end, array_to_string(w[s + 1 : s + 260], ' ') AS text, printf('%012d-w%06d', doc_id, s) AS chunk_id, s // 220 + 1 AS page FROM x)"
_PAIR = "pr AS (SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS reference, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_TOK = r"[A-Za-z]+[0-9]*|[0-9]+|[\x{0980}-\x{09ff}]+"
_NUM = r"[0-9]+(?:\.[0-9]+)?"
_PRF = f"""{_PAIR}, tk AS (SELECT pair_id, regexp_extract_all(lower(coalesce(reference, '')), '{_TOK}') AS r, regexp_extract_all(lower(coalesce(answer, '')), '{_TOK}') AS a,
  list_distinct(regexp_extract_all(lower(coalesce(reference, '')), '{_NUM}')) AS rn, list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '{_NUM}')) AS an FROM pr),
 sc AS (SELECT pair_id, r = a AS exact_match, CASE WHEN len(rn) > 0 THEN len(list_intersect(rn, an)) = len(rn) END AS numbers_kept,
  CASE WHEN len(a) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(r))) / CAST(len(list_distinct(a)) AS DOUBLE) ELSE 0e0 END AS p,
  CASE WHEN len(r) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(r))) / CAST(len(list_distinct(r)) AS DOUBLE) ELSE 0e0 END AS c FROM tk),
 pf AS (SELECT pair_id, round(p, 6) AS token_precision, round(c, 6) AS token_recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0e0 END, 6) AS token_f1, exact_match, numbers_kept FROM sc)"""
_SIG = "sg AS (SELECT event_id, event_type, event_id % 2 AS m2, event_id % 3 AS m3, event_id % 5 AS m5, event_id % 7 AS m7, event_id % 11 AS m11, event_id % 13 AS m13 FROM events)"


def _rate(table_: str, by: str, hit: str) -> str:
    low, high = S.wilson_sql("hits", "n")
    return f"SELECT {by}, n, hits, round(CAST(hits AS DOUBLE) / n, 6) AS rate, round({low}, 6) AS low, round({high}, 6) AS high FROM (SELECT {by}, count(*) AS n, count(*) FILTER ({hit}) AS hits FROM {table_} GROUP BY {by})"


def _profile(by: str) -> str:
    return f"SELECT {by}, count(*) AS documents, count(*) FILTER (length(coalesce(text, '')) = 0) AS empty, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters, round(avg(length(coalesce(text, ''))), 6) AS mean_characters, count(DISTINCT {_SHA}) AS distinct_texts FROM documents GROUP BY {by}"


def _kappa(pairs: str, weight: str) -> str:
    return f"""WITH pr AS ({pairs}), t AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS c FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y), s AS (SELECT sum(c) AS n, sum({weight} * c) AS off FROM t),
r AS (SELECT x, sum(c) AS r FROM t GROUP BY x), k AS (SELECT y, sum(c) AS k FROM t GROUP BY y), e AS (SELECT sum({weight} * r * k) AS ch FROM r, k)
SELECT CAST(n AS BIGINT) AS n, round(1 - off / n, 6) AS observed, round(1 - ch / (n * n), 6) AS expected, round(CASE WHEN ch = 0 THEN CASE WHEN off = 0 THEN 1e0 END ELSE 1 - (off / n) / (ch / (n * n)) END, 6) AS kappa FROM s, e"""


_PARITY_SQL = """WITH e AS (SELECT user_id, event_type, max(value) AS best FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY ALL),
f AS (SELECT user_id, count(DISTINCT event_type) AS v, coalesce(bool_or(best >= 50) FILTER (event_type = 'click'), FALSE) AS a, coalesce(bool_or(best >= 50) FILTER (event_type = 'purchase'), FALSE) AS b, coalesce(bool_or(best >= 50) FILTER (event_type = 'signup'), FALSE) AS c FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN v < 3 THEN 'OTHER_MISMATCH' WHEN a AND b AND c THEN 'ALL_THREE' WHEN a AND b THEN 'FIRST_AND_SECOND' WHEN a AND c THEN 'FIRST_AND_THIRD' WHEN b AND c THEN 'SECOND_AND_THIRD' WHEN a THEN 'FIRST_ONLY' WHEN b THEN 'SECOND_ONLY' WHEN c THEN 'THIRD_ONLY' ELSE 'NONE' END AS category FROM f"""
_ERROR_SQL = f"""WITH {_SIG}, r AS (SELECT *, {_STATUSES!r}[m7 + 1] AS status FROM sg)
SELECT CASE WHEN m13 = 12 OR status = 'SYSTEM_ERROR' THEN 'SYSTEM_ERROR' WHEN m2 = 1 AND m5 = 0 THEN 'UNSAFE_RETURN' WHEN m11 = 1 THEN 'ANNOTATION_ERROR' WHEN m11 = 2 OR status = 'CONFLICTING_EVIDENCE' THEN 'SOURCE_CONFLICT'
 WHEN status = 'AMBIGUOUS_QUERY' THEN 'AMBIGUITY_HANDLING' WHEN status = 'GENERATION_REJECTED' THEN CASE WHEN m3 = 0 THEN 'UNKNOWN' WHEN m5 = 1 THEN 'LANGUAGE_REJECTION' WHEN m5 = 2 THEN 'GROUNDING_REJECTION' WHEN m5 = 3 THEN 'SEMANTIC_REJECTION' ELSE 'CANONICAL_GENERATION' END
 WHEN status IN ('INSUFFICIENT_EVIDENCE', 'RETRIEVAL_UNCERTAIN') THEN CASE WHEN m3 >= 2 THEN 'RETRIEVAL_MISS' WHEN m3 <> 0 THEN 'RANKING_MISS' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS error_class, count(*) AS n FROM r GROUP BY ALL"""
_ANSWER_SQL = f"""WITH {_SIG}, r AS (SELECT *, ['supported', 'supported', 'insufficient', 'conflicting', 'ambiguous'][m5 + 1] AS s, m5 = 2 OR m11 = 0 AS missing FROM sg),
d AS (SELECT CASE WHEN s = 'ambiguous' THEN 'AMBIGUOUS_QUERY|AMBIGUOUS_ENTITY|NONE' WHEN s = 'conflicting' THEN 'CONFLICTING_EVIDENCE|CONFLICTING_VALUES|WEAK' WHEN missing AND m13 = 0 THEN 'RETRIEVAL_UNCERTAIN|ENTITY_OWNERSHIP_UNCERTAIN|WEAK'
 WHEN missing AND m3 > 0 THEN 'INSUFFICIENT_EVIDENCE|ENTITY_NOT_SUPPORTED|NONE' WHEN missing THEN 'INSUFFICIENT_EVIDENCE|FIELD_NOT_SUPPORTED|NONE' WHEN m7 = 0 THEN 'RETRIEVAL_UNCERTAIN|RELATION_NOT_SUPPORTED|WEAK' WHEN m13 IN (1, 2) THEN 'RETRIEVAL_UNCERTAIN|ENTITY_OR_FIELD_NOT_VERIFIED|WEAK'
 WHEN m7 = 1 THEN 'SUPPORTED|DIRECT_RELATION_SUPPORT|STRONG' WHEN m2 = 1 THEN 'SUPPORTED|DIRECT_STRUCTURED_SUPPORT|STRONG' WHEN m3 >= 2 THEN 'SUPPORTED|MULTIPLE_AGREEING_PASSAGES|STRONG' ELSE 'SUPPORTED|SINGLE_VERIFIED_PASSAGE|ADEQUATE' END AS x FROM r)
SELECT split_part(x, '|', 1) AS status, split_part(x, '|', 2) AS reason, split_part(x, '|', 3) AS level, count(*) AS n FROM d GROUP BY ALL"""
_LOW = r"(len({w}) <= 4 AND (length(regexp_replace(text, '[^A-Za-z0-9\x{{0980}}-\x{{09ff}}]', '', 'g')) < 18 OR len(list_filter({w}, lambda z: NOT regexp_full_match(z, '[0-9]+'))) = 0))".format(w=T.words_sql("text"))

REGISTRY = {
    "doc_exact_dedup": (doc_exact_dedup, f"WITH s AS (SELECT doc_id, {_SHA} AS sha256 FROM documents), f AS (SELECT sha256, min(doc_id) AS first FROM s GROUP BY sha256) SELECT doc_id, sha256, CASE WHEN doc_id <> first THEN first END AS duplicate_of FROM s JOIN f USING (sha256)"),
    "doc_duplicate_counts": (doc_duplicate_counts, f"SELECT {_SHA} AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "doc_profile_by_source": (doc_profile_by_source, _profile("source")),
    "doc_profile_by_lang": (doc_profile_by_lang, _profile("lang")),
    "corpus_fingerprint_rows": (corpus_fingerprint_rows, f"SELECT doc_id, source || '/' || doc_id AS relative_path, {_SHA} AS sha256, 'doc-' || substr(sha256(lower(source || '/' || doc_id) || chr(0) || {_SHA}), 1, 24) AS document_id FROM documents"),
    "page_issues": (page_issues, "SELECT source AS document_id, doc_id AS page, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_page' ELSE 'requires_ocr' END AS issue_type FROM documents WHERE trim(coalesce(text, '')) = '' OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 10"),
    "document_statuses": (document_statuses, "SELECT *, CASE WHEN good = pages THEN 'success' WHEN good > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT source AS document_id, count(*) AS pages, count(*) FILTER (trim(coalesce(text, '')) <> '') AS good FROM documents GROUP BY source)"),
    "chunk_windows": (chunk_windows, f"WITH {_W} SELECT doc_id, word_start, word_end, sha256(text) AS text_sha256 FROM k"),
    "chunk_links": (chunk_links, f"WITH {_W}, l AS (SELECT doc_id AS document_id, chunk_id, page, lag(chunk_id) OVER v AS previous_chunk_id, lead(chunk_id) OVER v AS next_chunk_id, lag(page) OVER v AS pp, lag(text) OVER v AS pt FROM k WINDOW v AS (PARTITION BY doc_id ORDER BY page, chunk_id)) SELECT document_id, chunk_id, previous_chunk_id, next_chunk_id, CASE WHEN page = pp + 1 AND NOT regexp_matches(rtrim(pt), '[.!?।]$') THEN previous_chunk_id END AS continuation_of FROM l"),
    "chunk_stats": (chunk_stats, f"WITH {_W}, c AS (SELECT source, len({T.words_sql('text')}) AS n FROM k) SELECT source, count(*) AS chunks, round(avg(n), 6) AS mean_words, median(n) AS median_words, min(n) AS min_words, max(n) AS max_words FROM c GROUP BY source"),
    "chunk_quality": (chunk_quality, f"WITH {_W}, r AS (SELECT count(*) AS chunks, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (len({T.words_sql('text')}) > 340) AS very_long, 0::BIGINT AS missing_provenance, count(*) FILTER ({_LOW}) AS low_information, count(text) - count(DISTINCT text) AS duplicate_texts, count(*) - count(DISTINCT chunk_id) AS duplicate_chunk_ids FROM k) SELECT *, empty + very_long + missing_provenance + duplicate_chunk_ids = 0 AS ok FROM r"),
    "page_text": (page_text, f"SELECT page_id, {C.strip_html_sql('html')} AS text FROM pages"),
    "page_text_blocks": (page_text_blocks, None),
    "field_types": (field_types, f"SELECT doc_id, array_to_string({T.field_types_sql('text')}, ',') AS fields FROM documents"),
    "chunk_language_profile": (chunk_language_profile, f"SELECT doc_id, {T.script_profile_sql('text')} AS script FROM documents"),
    "injection_ood_flags": (injection_ood_flags, f"SELECT conv_id, turn, sha256({T.strip_directives_sql('text')}) AS clean_sha256, {T.out_of_domain_sql('text')} AS out_of_domain FROM conversations"),
    "token_prf_proxies": (token_prf_proxies, f"WITH {_PRF} SELECT * FROM pf"),
    "overlap_gates": (overlap_gates, f"WITH {_PRF} SELECT pair_id, token_recall >= 0.70e0 AND token_f1 >= 0.45e0 AS acceptable, token_recall >= 0.85e0 AS complete FROM pf"),
    "overlap_recall": (overlap_recall, f"WITH {_PAIR}, t AS (SELECT pair_id, {T.content_tokens_sql('reference')} AS r, {T.content_tokens_sql('answer')} AS a FROM pr) SELECT pair_id, round(CASE WHEN len(r) > 0 THEN len(list_intersect(r, a)) / CAST(len(r) AS DOUBLE) ELSE 0e0 END, 6) AS recall FROM t"),
    "wilson_by_group": (wilson_by_group, _rate("(SELECT * FROM labels JOIN documents USING (doc_id))", "lang", "quality = 1")),
    "latency_summary": (latency_summary, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "throughput": (throughput, "SELECT event_type, count(*) AS n, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) * 3600e0 END, 4) AS per_hour FROM events GROUP BY event_type"),
    "group_summary_grouping_sets": (group_summary_grouping_sets, "SELECT CAST(grouping(event_type, hour) AS INTEGER) AS level, event_type, CAST(hour AS INTEGER) AS hour, count(*) AS n, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS users FROM (SELECT *, hour(ts) AS hour FROM events) GROUP BY GROUPING SETS ((), (event_type), (hour), (event_type, hour)) HAVING count(*) >= 5"),
    "error_classification": (error_classification, _ERROR_SQL),
    "safe_returns": (safe_returns, "WITH " + _SIG + ", s AS (SELECT event_type, m2 = 1 AND m3 > 0 AND (m7 = 0 OR m7 > 1) AND m5 > 0 AND m11 <> 0 AS ok FROM sg) " + _rate("s", "event_type", "ok")),
    "parity_categories": (parity_categories, _PARITY_SQL),
    "conflict_detection": (conflict_detection, "SELECT p_brand, p_type, count(DISTINCT p_size) AS values, count(*) AS claims FROM part WHERE p_size IS NOT NULL GROUP BY p_brand, p_type HAVING count(DISTINCT p_size) > 1"),
    "text_language_conflicts": (text_language_conflicts, "SELECT sha256(text) AS text_sha256, count(DISTINCT source) AS values, count(*) AS claims FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1"),
    "answerability_decision": (answerability_decision, _ANSWER_SQL),
    "confusion_pivot": (confusion_pivot, "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality"),
    "cohen_kappa": (cohen_kappa, _kappa("SELECT quality AS x, toxic AS y FROM labels", "CASE WHEN x = y THEN 0e0 ELSE 1e0 END")),
    "weighted_kappa": (weighted_kappa, _kappa("SELECT CAST(least(n_chars // 1000, 4) AS DOUBLE) AS x, CAST(least((n_chars + doc_id % 3 * 700) // 1000, 4) AS DOUBLE) AS y FROM labels JOIN documents USING (doc_id)", "((x - y) * (x - y) / 16e0)")),
    "stratified_sample": (stratified_sample, "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || ':42'), doc_id) AS draw FROM documents QUALIFY draw <= 10"),
    "run_compare_paired": (run_compare_paired, "WITH a AS (SELECT doc_id, n_chars % 100 AS before FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id, n_chars % 90 AS after FROM documents WHERE lang <> 'es') SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, before, after, CASE WHEN b.doc_id IS NULL THEN 'only_first' WHEN a.doc_id IS NULL THEN 'only_second' WHEN after > before THEN 'improved' WHEN after < before THEN 'regressed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id"),
    "resume_anti_join": (resume_anti_join, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "dataset_validation_report": (dataset_validation_report, "SELECT 'blank_text' AS problem, count(*) FILTER (trim(coalesce(text, '')) = '') AS rows FROM conversations UNION ALL SELECT 'blank_role', count(*) FILTER (trim(coalesce(role, '')) = '') FROM conversations UNION ALL SELECT 'enum_role', count(*) FILTER (coalesce(role, '') NOT IN ('user', 'assistant')) FROM conversations UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)"),
    "unpivot_expand": (unpivot_expand, "SELECT doc_id, 'quality' AS rater, quality AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"),
    "rolling_latency": (rolling_latency, "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events WHERE value IS NOT NULL"),
    "best_configuration": (best_configuration, f"WITH r AS (SELECT source, round(avg({_Q1}), 6) AS rate, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), f AS (SELECT avg({_Q1}) - 0.3e0 AS floor FROM labels JOIN documents USING (doc_id)) SELECT source, rate FROM r, f WHERE rate >= floor ORDER BY rate DESC, n DESC, source DESC LIMIT 1"),
}
