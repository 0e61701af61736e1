"""I-Match fingerprints in DataFrame operations only.

The lexicon is the terms within a band of inverse document frequency over the whole corpus. A fingerprint has a hash for
each of several random subsets of the lexicon: of the sorted distinct terms of the text that are in the subset. Subsets are
of three sizes, so that short and long texts both have subsets in which they have a few terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import safe_text, stored, successors

#: The band: terms in at least LEAST and at most MOST of the documents.
LEAST, MOST = 0.005, 0.3
#: Terms of a lexicon that goes into the plan.
LITERALS = 300_000
#: Of each hash of a term, these runs of bits decide on subsets; the term is in one if all its bits are 0.
BITS, HASHES = (8, 8, 8, 6, 6, 6, 6, 4, 4, 4, 4), 3


def terms(text: Column) -> Column:
    """Hashes of the distinct terms (runs of letters and digits, lower case)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> list[int] | DataFrame:
    """Hashes of the terms within the band, counted over all documents: a list, or above LITERALS terms a table of `t`.

    At most (mean number of distinct terms of a document) / least of them exist, at any corpus size: each is in `least` of
    all documents.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(safe_text(text))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    low, high = math.ceil(least * n), max(1, math.floor(most * n))
    words = stored(df.where(F.col("df").between(low, high)).select("t"), "lexicon")
    few = [r[0] for r in words.limit(LITERALS + 1).collect()]
    return few if len(few) <= LITERALS else words


def _chosen(seed: int, at: int, bits: int) -> Callable[[Column], Column]:
    def chosen(t: Column) -> Column:
        h = F.xxhash64(t, F.lit(seed)) if seed else t
        return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) == 0

    return chosen


def subset_hashes(known: Column) -> list[Column]:
    """Of a column with sorted lexicon terms: the hash of those in each subset, null where there is none."""
    out = []
    for seed in range(HASHES):
        at = 0
        for bits in BITS:
            own = F.filter(known, _chosen(seed, at, bits))
            out.append(F.when(F.size(own) > 0, F.xxhash64(own)))
            at += bits
    return out


def known_terms(df: DataFrame, words: list[int] | DataFrame) -> DataFrame:
    """df (with `_terms`) and `_known`: those terms, sorted, that the lexicon has. A list goes into the plan as a set, a
    table is joined with the terms of each row."""
    if isinstance(words, list):
        return df.withColumn("_known", F.filter("_terms", lambda t: t.isin(words) if words else F.lit(False)))
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "terms")
    held = rows.select("_row", F.explode("_terms").alias("t")).join(words, "t").groupBy("_row").agg(F.sort_array(F.collect_list("t")).alias("_known"))
    return rows.join(held, "_row", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<bigint>"))).drop("_row")


def with_fingerprint(df: DataFrame, text: Column, words: list[int] | DataFrame, name: str) -> DataFrame:
    """df with `name`: array<bigint> of a hash for each subset; the last element is set only where all others are null."""
    out = known_terms(df.withColumn("_terms", F.sort_array(terms(text))), words)
    out = out.withColumn("_hashes", F.array(*subset_hashes(F.col("_known"))))
    alone = F.when(F.forall("_hashes", lambda x: x.isNull()), F.xxhash64("_terms"))
    return out.withColumn(name, F.concat("_hashes", F.array(alone))).drop("_terms", "_known", "_hashes")


def printed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets in which either text has terms, the share with equal hashes. Equal fingerprints give 1."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(F.coalesce(x == y, F.lit(False))))
    some, same = F.size(F.filter(both, lambda x: x.isNotNull())), F.size(F.filter(both, lambda x: x))
    return F.when(some > 0, same / some).otherwise(F.lit(1.0)).cast("double")


def fingerprints(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """`docs` with the column `fingerprint`. A null text is an empty one; texts without lexicon terms in any subset are
    hashed by all their terms. Equal texts have equal fingerprints; a column `fingerprint` is replaced, all others stay. One shuffle, of the terms' counts."""
    words = lexicon(docs, text, least, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "fingerprint"]).alias("whole"), safe_text(text).alias("body"))
    return with_fingerprint(rows, F.col("body"), words, "fp").select("whole.*", printed(F.col("fp")).alias("fingerprint"))


def edited_pairs(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses.

    A text's last floor(n / 2) characters are replaced by the first as many of the next document's by doc_id (after the
    last: the first's). Rows of equal doc_id follow each other by their texts' hash; a null doc_id comes first; an empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", safe_text().alias("text"))
    words = lexicon(docs, "text", least, most)

    def make(df: DataFrame) -> DataFrame:
        return with_fingerprint(df, F.col("text"), words, "fp").withColumn("_value", F.struct("text", "fp"))

    least_id = docs.agg(F.min(F.coalesce("doc_id", F.lit(-(2**63))))).first()[0]
    heads = docs.where(F.coalesce("doc_id", F.lit(-(2**63))) == F.lit(0 if least_id is None else least_id))
    head = heads.orderBy(F.xxhash64("text")).limit(1).collect()
    first = head[0]["text"] if head else ""
    out = successors(docs, "doc_id", ["text"], make)
    out = out.withColumn("_next", F.coalesce("next_value.text", F.lit(first))).withColumn("_n", F.length("text"))
    half = F.floor(F.col("_n") / 2).cast("int")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("_n") - half), F.substring("_next", F.lit(1), half)))
    out = with_fingerprint(out, F.col("edited"), words, "efp")
    wrapped = make(docs.sparkSession.createDataFrame([(first,)], "text string")).select("fp").first()["fp"]
    first_fp = F.array(*[F.lit(x).cast("long") for x in wrapped])
    out = out.withColumn("_next_fp", F.coalesce("next_value.fp", first_fp))
    return out.select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"), printed(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("_next_fp")).alias("near_next"),
    )
