"""Traces and contexts: excerpts, siblings, budgets, rank changes, screens of generated text, provenance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def excerpt(text: Column, anchor: Column, width: int = 420, before: int = 140) -> Column:
    """At most `width` characters around the first anchor, from `before` characters ahead of it, with marks where cut."""
    t = F.coalesce(text, F.lit(""))
    at = F.locate(F.lower(anchor), F.lower(t)) if isinstance(anchor, str) else F.instr(F.lower(t), F.lower(anchor))
    start = F.greatest(at - before, F.lit(1))
    end = start + width
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(t, start, F.lit(width)), F.when(end <= F.length(t), "...").otherwise(""))


def siblings(chunks: DataFrame, most: int = 3600) -> DataFrame:
    """Per chunk the text of the chunks of the same document, page and parent in the order of word_start, up to `most`
    characters; whole chunks only, and the scan goes on past one that does not fit. The scan sees lengths; only the texts that
    it keeps, `most` characters of a parent, are then put together."""
    key = ["document_id", "page", "parent_id"]
    slim = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word_start", "chunk_id", F.length("text").alias("n")))).alias("all"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("n"), F.array().cast(f"array<{kind}>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + x["n"]
        return F.when(n <= most, F.struct(n.alias("n"), F.concat(acc["kept"], F.array(x["chunk_id"])).alias("kept"))).otherwise(acc)

    kept = slim.select(*[F.col(c).alias(f"of_{c}") for c in key], F.posexplode_outer(F.aggregate("all", start, add, lambda acc: acc["kept"])).alias("at", "id"))
    own = chunks.select(F.col("chunk_id").alias("own_id"), *[F.col(c).alias(f"own_{c}") for c in key], "text")
    same = [kept[f"of_{c}"].eqNullSafe(own[f"own_{c}"]) for c in key] + [kept["id"] == own["own_id"]]
    out = kept.join(own, same, "left").groupBy(*[f"of_{c}" for c in key]).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return out.select(*[F.col(f"of_{c}").alias(c) for c in key], F.array_join(F.filter("parts.text", lambda t: t.isNotNull()), "\n").alias("context"))


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """Per query the items in rank order whose tokens fit what is left of the budget: query_id, chunk_ids, tokens."""
    per = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tokens", "chunk_id"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("ids"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + x["tokens"]
        return F.when(n <= budget, F.struct(n.alias("n"), F.concat(acc["ids"], F.array(x["chunk_id"])).alias("ids"))).otherwise(acc)

    return per.withColumn("_r", F.aggregate("all", start, add)).select("query_id", F.array_join("_r.ids", ",").alias("chunk_ids"), F.col("_r.n").alias("tokens"))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """promoted, demoted, unchanged, entered or left of each (query_id, chunk_id)."""
    a, b = before.select("query_id", "chunk_id", F.col("rank").alias("old_rank")), after.select("query_id", "chunk_id", F.col("rank").alias("new_rank"))
    change = F.when(F.col("old_rank").isNull(), "entered").when(F.col("new_rank").isNull(), "left").when(F.col("new_rank") < F.col("old_rank"), "promoted").when(F.col("new_rank") > F.col("old_rank"), "demoted").otherwise("unchanged")
    return a.join(b, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", "old_rank", "new_rank", change.alias("change"))


def repeats_trigram(text: Column, least: int = 3) -> Column:
    """Whether some run of three words occurs at least `least` times."""
    w = T.words(F.lower(F.coalesce(text, F.lit(""))))
    grams = F.zip_with(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    some = F.array_sort(F.filter(grams, lambda g: g.isNotNull()))
    lag = F.slice(some, least, F.greatest(F.size(some), F.lit(1)))
    return F.coalesce(F.exists(F.zip_with(some, lag, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x), F.lit(False))


def truncated(text: Column) -> Column:
    """Text that does not end as a sentence does."""
    t = F.rtrim(F.coalesce(text, F.lit("")))
    return (t != "") & ~t.rlike(r"[.!?।:\"')\]]$")


def flattened(ranking: DataFrame, k: int = 3) -> DataFrame:
    """One row per query with arrays of its first k items, flattened again to one row per place: the trace table."""
    top = ranking.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("place", "item")).select("query_id", (F.col("place") + 1).alias("place"), F.col("item.chunk_id").alias("chunk_id"))


def unknown_sources(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document the corpus does not have (or no longer has)."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def index_problems(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: postings without a chunk, non-positive frequencies, chunks whose frequencies do not add up to their length. One
    pass over the postings, whose sums for each chunk meet the lengths."""
    bad = F.count_if((F.col("tf") <= 0) | (F.coalesce("token", F.lit("")) == ""))
    per = postings.groupBy("chunk_id").agg(F.count("*").alias("n"), bad.alias("bad"), F.sum("tf").alias("s"))
    known = lengths.groupBy("chunk_id").agg(F.collect_list("dl").alias("dls"))
    wrong = F.size(F.filter("dls", lambda dl: dl != F.col("s")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.join(known, "chunk_id", "left").agg(
        zero(F.col("bad")).alias("bad_postings"), zero(F.when(F.col("dls").isNull(), F.col("n"))).alias("orphans"), zero(F.when(F.col("dls").isNotNull(), wrong)).cast("long").alias("wrong_lengths"),
    )


