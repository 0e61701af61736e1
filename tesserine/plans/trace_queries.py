"""Trace and context queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import traces as X
from ..session import table
from ..storage import stored
from .analytics_queries import _W, _chunks
from .retrieval_queries import BM25_CTE, DENSE_CTE, bm25_hits, chunks, dense_hits


def support_excerpts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(X.excerpt(F.col("text"), F.substring("source", 4, 2)), 256).alias("excerpt_sha256"))


def sibling_context(spark, sf):
    c = _chunks(spark, sf).withColumn("parent_id", F.col("document_id")).withColumn("page", F.lit(1))
    return X.siblings(c).select("document_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def token_budget_prefix(spark, sf):
    top = stored(bm25_hits(spark, sf, 10), "ranking")
    found = chunks(spark, sf).join(top.select("chunk_id").distinct(), "chunk_id", "left_semi")  # lengths of these alone
    lengths = R.tokenized(found).select("chunk_id", F.col("dl").cast("long").alias("tokens"))
    return X.within_budget(top.join(lengths, "chunk_id"), 1500)


def rank_change_classes(spark, sf):
    before = dense_hits(spark, sf, 10)
    after = bm25_hits(spark, sf, 10).join(before.select("query_id").distinct(), "query_id", "left_semi")
    return X.rank_changes(before, after)


def generation_screens(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.repeats_trigram(F.col("text")).alias("repeats"), X.truncated(F.col("text")).alias("truncated"))


def retrieval_trace(spark, sf):
    return X.flattened(bm25_hits(spark, sf, 10), 3)


def stale_sources(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"))
    known = table(spark, sf, "documents").where("lang = 'es' and n_chars > 20000").select(F.col("source").alias("document_id"))
    return X.unknown_sources(c, known)


def index_integrity(spark, sf):
    """Checks of an index that was broken on purpose: each frequency is one too low and Spanish chunks have no length."""
    c = chunks(spark, sf)
    lengths = R.tokenized(c.where("field != 'es'")).select("chunk_id", "dl")
    return X.index_problems(R.postings(c).select("token", "chunk_id", (F.col("tf") - 1).alias("tf")), lengths)


_LOW_WORDS = T.words_sql("lower(coalesce(text, ''))")
REGISTRY = {
    "support_excerpts": (support_excerpts, "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, greatest(instr(lower(coalesce(text, '')), lower(substr(source, 4, 2))) - 140, 1) AS s FROM documents) SELECT doc_id, sha256(CASE WHEN s > 1 THEN '...' ELSE '' END || substr(t, s, 420) || CASE WHEN s + 420 <= length(t) THEN '...' ELSE '' END) AS excerpt_sha256 FROM d"),
    "sibling_context": (sibling_context, f"WITH RECURSIVE {_W}, n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY word_start) AS i FROM k), r AS (SELECT doc_id, i, CASE WHEN length(text) <= 3600 THEN length(text) ELSE 0 END AS n, CASE WHEN length(text) <= 3600 THEN text END AS c FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN r.n + length(n.text) <= 3600 THEN r.n + length(n.text) ELSE r.n END, CASE WHEN r.n + length(n.text) <= 3600 THEN CASE WHEN r.c IS NULL THEN n.text ELSE r.c || chr(10) || n.text END ELSE r.c END FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1), f AS (SELECT doc_id, coalesce(arg_max(c, i), '') AS c FROM r GROUP BY doc_id) SELECT doc_id AS document_id, length(c) AS n_chars, sha256(c) AS context_sha256 FROM f"),
    "token_budget_prefix": (token_budget_prefix, f"WITH RECURSIVE {BM25_CTE.lstrip()}, n AS (SELECT item_id, bm.doc_id, rank, len(tk) AS dl FROM bm JOIN c USING (doc_id) WHERE rank <= 10), r AS (SELECT item_id, rank, CASE WHEN dl <= 1500 THEN CAST(dl AS BIGINT) ELSE 0 END AS n, CASE WHEN dl <= 1500 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS ids FROM n WHERE rank = 1 UNION ALL SELECT n.item_id, n.rank, CASE WHEN r.n + n.dl <= 1500 THEN r.n + n.dl ELSE r.n END, CASE WHEN r.n + n.dl <= 1500 THEN CASE WHEN r.ids = '' THEN CAST(n.doc_id AS VARCHAR) ELSE r.ids || ',' || n.doc_id END ELSE r.ids END FROM r JOIN n ON n.item_id = r.item_id AND n.rank = r.rank + 1) SELECT item_id AS query_id, arg_max(ids, rank) AS chunk_ids, arg_max(n, rank) AS tokens FROM r GROUP BY item_id"),
    "rank_change_classes": (rank_change_classes, f"WITH {BM25_CTE.lstrip()}, {DENSE_CTE}, o AS (SELECT item_id, doc_id, rank FROM de WHERE rank <= 10), w AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 10 AND item_id IN (SELECT item_id FROM o)) SELECT coalesce(o.item_id, w.item_id) AS query_id, coalesce(o.doc_id, w.doc_id) AS chunk_id, o.rank AS old_rank, w.rank AS new_rank, CASE WHEN o.rank IS NULL THEN 'entered' WHEN w.rank IS NULL THEN 'left' WHEN w.rank < o.rank THEN 'promoted' WHEN w.rank > o.rank THEN 'demoted' ELSE 'unchanged' END AS change FROM o FULL JOIN w ON o.item_id = w.item_id AND o.doc_id = w.doc_id"),
    "generation_screens": (generation_screens, f"WITH a AS (SELECT conv_id, turn, rtrim(coalesce(text, '')) AS t, {_LOW_WORDS} AS w FROM conversations WHERE role = 'assistant'), g AS (SELECT conv_id, turn, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM a), r AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, g FROM g GROUP BY ALL HAVING count(*) >= 3)) SELECT a.conv_id, a.turn, r.conv_id IS NOT NULL AS repeats, t <> '' AND NOT regexp_matches(t, '[.!?।:\"'')\\]]$') AS truncated FROM a LEFT JOIN r ON a.conv_id = r.conv_id AND a.turn = r.turn"),
    "retrieval_trace": (retrieval_trace, f"WITH {BM25_CTE.lstrip()} SELECT item_id AS query_id, rank AS place, doc_id AS chunk_id FROM bm WHERE rank <= 3"),
    "stale_sources": (stale_sources, "SELECT doc_id AS chunk_id, source AS document_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 20000)"),
    "index_integrity": (index_integrity, f"WITH {BM25_CTE.lstrip()}, l AS (SELECT doc_id, len(tk) AS dl FROM c JOIN documents USING (doc_id) WHERE lang <> 'es'), s AS (SELECT doc_id, sum(tf - 1) AS s FROM p GROUP BY doc_id) SELECT (SELECT count(*) FROM p WHERE tf - 1 <= 0) AS bad_postings, (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS orphans, (SELECT count(*) FROM s JOIN l USING (doc_id) WHERE s <> dl) AS wrong_lengths"),
}
