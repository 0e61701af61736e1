"""Chunks of pages: word windows, neighbour links, quality and statistics, text of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import VERY_LONG_WORDS, WINDOW_OVERLAP, WINDOW_WORDS
from ..functions import text as T


def windows(pages: DataFrame, size: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sliding word windows of every text: key, word_start, word_end, text and the columns to keep. The last window is the one
    that reaches the end; blank and null texts give none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    w = pages.select(key, *keep, T.words(F.col("text")).alias("_w")).withColumn("_n", F.size("_w")).where("_n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / F.lit(step))).cast("int")

    def window(i: Column) -> Column:
        start = i * step
        return F.struct(start.alias("word_start"), F.least(start + size, F.col("_n")).alias("word_end"), F.array_join(F.slice("_w", start + 1, F.lit(size)), " ").alias("text"))

    # only the pieces are exploded: the words of a text are not copied for each of them
    return w.select(key, *keep, F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("_x")).select(key, "_x.word_start", "_x.word_end", "_x.text", *keep)


def chunk_id(key: Column, start: Column) -> Column:
    return F.when(key.isNotNull(), F.format_string("%012d-w%06d", key, start))


def links(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """previous_chunk_id, next_chunk_id and continuation_of within a document, ordered by (page, chunk_id).

    A chunk goes on with the one before it if that is on the page before, it is a heading-less fallback block and the
    text before it has no final punctuation.
    """
    w = Window.partitionBy(document).orderBy("page", "chunk_id")
    out = chunks.withColumns({"previous_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w), "_page": F.lag("page").over(w), "_text": F.lag("text").over(w)})
    open_end = ~F.rtrim(F.col("_text")).rlike(r"[.!?।]$")
    goes_on = (F.col("page") == F.col("_page") + 1) & (F.col("block_type") == "fallback") & (F.coalesce("heading", F.lit("")) == "") & open_end
    return out.withColumn("continuation_of", F.when(goes_on, F.col("previous_chunk_id"))).drop("_page", "_text")


def low_information(text: Column) -> Column:
    w = T.words(text)
    alnum = F.length(F.regexp_replace(text, r"[^A-Za-z0-9\x{0980}-\x{09ff}]", ""))
    return (F.size(w) <= 4) & ((alnum < 18) | F.forall(w, lambda x: x.rlike("^[0-9]+$")))


def quality(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks break each rule; `ok` depends on the four hard ones alone."""
    n = F.size(T.words(F.col("text")))
    repeated = chunks.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("duplicate_chunk_ids"))
    one = chunks.agg(
        F.count("*").alias("chunks"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"),
        F.count_if(n > VERY_LONG_WORDS).alias("very_long"), F.count_if(F.col("document_id").isNull() | F.col("page").isNull()).alias("missing_provenance"),
        F.count_if(low_information(F.col("text"))).alias("low_information"), (F.count("text") - F.count_distinct("text")).alias("duplicate_texts"),
    )
    both = one.withColumn("_k", F.lit(1)).join(repeated.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("ok", (F.col("empty") + F.col("very_long") + F.col("missing_provenance") + F.col("duplicate_chunk_ids")) == 0)


def stats(chunks: DataFrame, by: str) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    return chunks.withColumn("_n", n).groupBy(by).agg(F.count("*").alias("chunks"), F.round(F.avg("_n"), 6).alias("mean_words"), F.median("_n").alias("median_words"), F.min("_n").alias("min_words"), F.max("_n").alias("max_words"))


def strip_html(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, common entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_html_sql(html: str) -> str:
    out = f"regexp_replace(coalesce({html}, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"
