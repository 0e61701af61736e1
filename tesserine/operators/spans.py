"""Spans of evidence: cut excerpts widened within their own chunk, parent or explicit continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evidence as V

MOST = 3600
_ENDS = r"[.!?।]\s*$"
_PLACE = {"document_id": "string", "page": "long", "parent_id": "string", "word_start": "long", "next_chunk_id": "string", "continuation_of": "string"}


def truncated(excerpt: Column, text: Column) -> Column:
    """Whether an excerpt says less than its text."""
    short, full = V.one_line(excerpt), V.one_line(text)
    return (short != "") & (full != "") & (F.contains(short, F.lit("…")) | (F.length(short) < F.length(full)))


def expanded(evidence: DataFrame, chunks: DataFrame, most: int = MOST, count_blanks: bool = True) -> DataFrame:
    """evidence (chunk_id, excerpt and any other columns) with `span` and `linked` (chunk_ids beside its own).

    A cut excerpt becomes its whole chunk; if that ends without final punctuation, all chunks of the same document, page and
    parent in order, if there are several and they fit; else the chunk and the next one, if that says that it goes on with
    it on the same page and both fit. What would be longer than `most` stays the excerpt, as does one that is not cut or whose
    chunk is unknown. chunks: chunk_id, text and, where known, document_id, page, parent_id, word_start, next_chunk_id,
    continuation_of; nothing else ever joins chunks. Lengths of parents are added up first, so only texts of parents
    that fit are put together; the blanks between them count too, unless count_blanks is off. Evidence that brings its chunk's `text` is widened without chunks where those know neither
    parents nor continuations.
    """
    if "text" in evidence.columns and not {"parent_id", "continuation_of"} & set(chunks.columns):
        full = V.one_line(F.col("text"))
        good = truncated(F.col("excerpt"), F.col("text")) & (F.length(full) <= most)
        return evidence.withColumns({"span": F.when(good, full).otherwise(F.col("excerpt")), "linked": F.array().cast("array<string>")})
    own = chunks.select(F.col("chunk_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), *[(F.col(c) if c in chunks.columns else F.lit(None)).cast(t).alias(c) for c, t in _PLACE.items()])
    asked = evidence.select(F.struct(*[F.col(f"`{c}`") for c in evidence.columns]).alias("row"), F.col("chunk_id").cast("string").alias("id"), F.col("excerpt"))
    rows = asked.join(own, "id", "left").withColumn("full", V.one_line(F.col("text")))
    cut = truncated(F.col("excerpt"), F.col("text"))
    rows = rows.withColumns({"cut": F.coalesce(cut, F.lit(False)), "open": F.coalesce(cut & (F.length("full") <= most) & ~F.col("full").rlike(_ENDS), F.lit(False))})
    place = ["document_id", "page", "parent_id"]
    wanted = rows.where("open and parent_id is not null").select(*place).distinct()
    same = lambda a, b: a["parent_id"].eqNullSafe(b["parent_id"]) & a["document_id"].eqNullSafe(b["document_id"]) & a["page"].eqNullSafe(b["page"])
    family = own.join(wanted, same(own, wanted), "left_semi")
    fits = family.groupBy(*place).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where((F.col("n") > 1) & (F.col("chars") <= most)).select(*place)
    parts = family.join(fits, same(family, fits), "left_semi").groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("word_start", F.lit(0)).alias("at"), "id", "text"))).alias("all"))
    whole = parts.select(*[F.col(c).alias(f"of_{c}") for c in place], F.array_join(F.transform("all", lambda x: V.one_line(x["text"])), " ").alias("family"), F.col("all.id").alias("ids"))
    rows = rows.join(whole, F.col("open") & F.col("document_id").eqNullSafe(F.col("of_document_id")) & F.col("page").eqNullSafe(F.col("of_page")) & (F.col("parent_id") == F.col("of_parent_id")), "left")
    after = own.where("continuation_of is not null").select(F.col("id").alias("next_id"), F.col("continuation_of").alias("of"), F.col("document_id").alias("next_document"), F.col("page").alias("next_at"), V.one_line(F.col("text")).alias("next_text"))
    edge = F.col("open") & F.col("ids").isNull() & (F.col("next_chunk_id") == F.col("next_id")) & (F.col("of") == F.col("id"))
    rows = rows.join(after, edge & F.col("document_id").eqNullSafe(F.col("next_document")) & F.col("page").eqNullSafe(F.col("next_at")), "left")
    longer = F.concat_ws(" ", "full", "next_text")
    none = F.array().cast("array<string>")
    goes_on = F.col("next_text").isNotNull() & (F.length(longer) <= most)
    text = F.when(F.col("family").isNotNull(), F.col("family")).when(goes_on, longer).otherwise(F.col("full"))
    linked = F.when(F.col("family").isNotNull(), F.array_except("ids", F.array("id"))).when(goes_on, F.array("next_id")).otherwise(none)
    fit = F.length(text) <= most
    good = F.col("cut") & (fit if count_blanks else F.col("family").isNotNull() | fit)
    return rows.select("row.*", F.when(good, text).otherwise(F.col("excerpt")).alias("span"), F.when(good, linked).otherwise(none).alias("linked"))


def expanded_in_order(chunks: DataFrame, excerpt: Column, most: int = MOST, count_blanks: bool = True) -> DataFrame:
    """chunk_id, span and n_linked of every chunk: what expanded() makes of an excerpt of each, where chunks of a parent go on
    with the next one in order if they say so.

    chunks: chunk_id, text, document_id, page, parent_id, word_start, goes_on; excerpt: of a chunk's columns. Neighbours meet by
    their order in the parent, so texts are moved once.
    """
    order = Window.partitionBy("document_id", "page", "parent_id").orderBy("word_start")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chunks.withColumns({"n": F.count("*").over(whole), "chars": F.sum(F.length("text")).over(whole), "next_text": F.lead("text").over(order)})
    family = F.collect_list(F.when((F.col("n") > 1) & (F.col("chars") <= most) & F.col("parent_id").isNotNull(), V.one_line(F.col("text")))).over(whole)
    rows = rows.withColumns({"family": family, "full": V.one_line(F.col("text")), "next_text": F.when(F.col("goes_on") & F.col("next_text").isNotNull(), V.one_line(F.col("next_text"))), "excerpt": excerpt})
    rows = rows.withColumn("cut", F.coalesce(truncated(F.col("excerpt"), F.col("full")), F.lit(False)))
    rows = rows.withColumn("open", F.col("cut") & (F.length("full") <= most) & ~F.col("full").rlike(_ENDS))
    of_family, longer = F.col("open") & (F.size("family") > 0), F.concat_ws(" ", "full", "next_text")
    goes_on = F.col("open") & F.col("next_text").isNotNull() & (F.length(longer) <= most)
    rows = rows.withColumns({"way": F.when(of_family, 1).when(goes_on, 2).otherwise(0), "wide": F.when(of_family, F.array_join("family", " ")).when(goes_on, longer).otherwise(F.col("full"))})
    fit = F.length("wide") <= most
    good = F.col("cut") & (fit if count_blanks else (F.col("way") == 1) | fit)
    linked = F.when(good & (F.col("way") == 1), F.col("n").cast("int") - 1).when(good & (F.col("way") == 2), F.lit(1)).otherwise(F.lit(0))
    return rows.select("chunk_id", F.when(good, F.col("wide")).otherwise(F.col("excerpt")).alias("span"), linked.alias("n_linked"))
