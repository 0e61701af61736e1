"""Near-duplicate classes by Order MinHash.

A sketch holds, for each of BANDS hash orders, the PICKS least occurrence-labelled five-word shingles of a text in the order
in which the text has them, so two texts agree in a band only if they share those shingles and their order. Texts that
agree in a band are candidates; a banded alignment of their shingles decides: aligned shingles over all shingles of both
(aligned ones once) must be SIMILAR or more. Classes are the connected components of the links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, unused

WORDS, PICKS, BANDS, SIMILAR = 5, 4, 32, 0.8
#: Up to this many different texts in a bucket are compared pair by pair at once; in larger buckets first all with a lead,
#: at last those not yet in one component that share a rare shingle, in blocks of about BLOCK texts against blocks.
SMALL, BLOCK = 6, 2000
#: Lengths of one class differ by less than this factor.
STEP = 1.05
WORD = re.compile(r"\w+")
NONE = 2**63 - 1


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its words (lower case)."""
    split = [WORD.findall((t or "").lower()) for t in texts]
    codes, distinct = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    flat = table[codes] if len(codes) else np.zeros(0, np.uint64)
    return np.split(flat, np.cumsum([len(ws) for ws in split])[:-1]) if split else []


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def labelled(x: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its occurrence in the text."""
    by = np.argsort(x, kind="stable")
    s = x[by]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    place = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[by] = place - np.maximum.accumulate(np.where(first, place, 0)) if len(s) else 0
    y = x + nth * np.uint64(0x94D049BB133111EB)
    return (y ^ (y >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


_ORDERS = np.random.default_rng(20240607).integers(0, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(x: np.ndarray) -> np.ndarray:
    """[BANDS] hash of the PICKS least labelled shingles in text order, for each hash order."""
    y = labelled(x)
    ranks = y[None, :] * _ORDERS[:, None]
    if len(y) > PICKS:
        chosen = np.sort(np.argpartition(ranks, PICKS - 1, axis=1)[:, :PICKS], axis=1)
    else:
        chosen = np.broadcast_to(np.arange(len(y)), ranks.shape)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(chosen.shape[1]):
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0x9E3779B97F4A7C15) + y[chosen[:, i]]
    return out ^ (out >> np.uint64(32))


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Shingles of a and b that an order-keeping alignment can match, exact if there are at least `least` of them.

    Longest common subsequence, a bit for each shingle of a. With `least` matches no matched pair is further off the
    diagonal than the shingles left over, so matches outside that band are not looked at.
    """
    band = len(a) + len(b) - 2 * least
    if band < 0:
        return 0
    head = 0
    n = min(len(a), len(b))
    if n:
        diff = np.flatnonzero(a[:n] != b[:n])
        head = int(diff[0]) if len(diff) else n
    a, b = a[head:], b[head:]
    n, tail = min(len(a), len(b)), 0
    if n:
        diff = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(diff[0]) if len(diff) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    common = np.intersect1d(a, b)
    places: dict[int, list[int]] = {}
    at = np.flatnonzero(np.isin(a, common))
    if head + tail + len(at) < least:
        return 0
    for i, x in zip(at.tolist(), a[at].tolist(), strict=True):
        places.setdefault(x, []).append(i)
    whole = (1 << len(a)) - 1
    v = whole
    at = np.flatnonzero(np.isin(b, common))
    for j, x in zip(at.tolist(), b[at].tolist(), strict=True):
        m = 0
        for i in places[x]:
            if abs(i - j) <= band:
                m |= 1 << i
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & whole
    return head + tail + len(a) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    """Aligned shingles over all; 0.0 stands for any value below `similar`."""
    both = len(a) + len(b)
    if both == 0:
        return 1.0
    least = int(np.ceil(similar * both / (1 + similar) - 1e-9))
    if min(len(a), len(b)) < least:
        return 0.0
    m = aligned(a, b, least)
    return m / (both - m) if m >= least else 0.0


def _sketches(docs: DataFrame, mark: Column) -> DataFrame:
    """Of each row: id (doc_id, NONE for null), mark, text key (two hashes of the words), number of shingles and the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                words = word_hashes(part["text"].tolist())
                own = [shingles(w) for w in words]
                raw = [w.tobytes() for w in words]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "mark": part["mark"].to_numpy(), "key": [xxhash.xxh128_digest(r) for r in raw], "n": [len(x) for x in own],
                    "bands": [sketch(x).view(np.int64).tolist() if len(x) else [] for x in own],
                })

    return docs.select(_id(), mark.alias("mark"), "text").mapInPandas(lean(run), "id long, mark long, key binary, n int, bands array<long>")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id")


def _fits(x: Column, y: Column) -> Column:
    return F.least(x, y) >= F.greatest(x, y) * SIMILAR - 1e-9


def _pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) from (band, id, n, rank): each member with its bucket's lead, the one of greatest rank; in
    small buckets all pairs."""
    lead = F.max_by(F.struct("id", "n"), F.struct(F.col("rank"), -F.col("id")))
    buckets = members.groupBy("band").agg(lead.alias("lead"), F.count("*").alias("size")).where("size > 1")
    joined = members.join(buckets, "band")
    star = joined.where((F.col("id") != F.col("lead.id")) & _fits(F.col("n"), F.col("lead.n"))).select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
    few = joined.where(F.col("size").between(3, SMALL)).groupBy("band").agg(F.collect_list(F.struct("id", "n")).alias("all"))
    each = few.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    small = each.where((F.col("x.id") < F.col("y.id")) & _fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    both = star.unionByName(small).where("a != b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _class(n: Column) -> Column:
    """Length class: lengths of one class differ by less than the factor STEP."""
    return F.floor(F.log(n) / math.log(STEP) + 1e-9).cast("int")


def _apart(tagged: DataFrame, bodies: DataFrame, similar: float) -> DataFrame:
    """All pairs (a, b) that can be links, of texts of different labels that larger buckets hold, from (band, id, n, label).

    Texts that are alike to `similar` share one of the rarest shingles of each: with sizes x and y they have at least
    m = similar / (1 + similar) * (x + y) shingles in common, so not all common ones are among the last m - 1 of either in
    any one order; here that of frequency among these texts. Each text gives those shingles for each class of
    partners' lengths, and pairs meet only where shingle and classes are equal: a long common passage or the many unchanged
    shingles of a large family, being frequent, come last and make no pairs. No link between these texts is lost.
    """
    mixed = tagged.groupBy("band").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where(f"low != high and size > {SMALL}")
    hard = stored(tagged.join(mixed.select("band"), "band").select("id", "n", "label").distinct(), "hard")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, body in zip(b["id"], b["body"], strict=True):
                tokens = labelled(shingles(np.frombuffer(body, np.uint64))).view(np.int64)
                for at in range(0, len(tokens), 100_000):
                    yield pd.DataFrame({"id": i, "token": tokens[at : at + 100_000]})

    tokens = stored(bodies.join(hard.select("id"), "id").mapInPandas(lean(split), "id long, token long"), "tokens")
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(frequent, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    own = hard.join(ordered, "id").withColumn("lone", F.col("n") - F.size("shared")).withColumn("c", _class(F.col("n")))
    reach = math.ceil(math.log(1 / similar) / math.log(STEP) + 1e-6)
    own = own.withColumn("q", F.explode(F.sequence(F.greatest(F.col("c") - reach, F.lit(0)), F.col("c") + reach)))
    least = F.ceil(F.pow(F.lit(STEP), F.col("q") - 1e-6))
    first = F.col("n") - F.ceil(similar / (1 + similar) * (F.col("n") + least) - 1e-6) + 1 - F.col("lone")
    rows = own.where(first > 0).select("id", "n", "label", "c", "lone", F.least("c", "q").alias("i"), F.greatest("c", "q").alias("j"), F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))).alias("place", "t"))
    rows = stored(rows.select("id", "n", "label", "c", "i", "j", (F.col("lone") + F.col("place")).alias("place"), F.col("t.token").alias("token")), "prefixes")
    key = ["token", "i", "j"]
    meet = rows.groupBy(*key).agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    # a shingle of very many texts is dealt to blocks of about BLOCK of them, each of which meets each
    dealt = rows.join(meet.select(*key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), key)
    x = dealt.where("c = i").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    y = dealt.where("c = j").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = x.select(*key, "block", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "label", "place")]), y.select(*key, "block", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "label", "place")])
    common = F.ceil(similar / (1 + similar) * (F.col("x_n") + F.col("y_n")) - 1e-6)
    on = [x[c] == y[c] for c in [*key, "block"]] + [
        F.col("x_label") != F.col("y_label"), (x["i"] < x["j"]) | (F.col("x_id") < F.col("y_id")), _fits(F.col("x_n"), F.col("y_n")),
        F.col("x_place") <= F.col("x_n") - common, F.col("y_place") <= F.col("y_n") - common,
    ]
    return x.join(y, on).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _verified(pairs: DataFrame, bodies: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b, similarity) that the alignment confirms. bodies: id, body (bytes of the word hashes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = lambda x: shingles(np.frombuffer(x, np.uint64))
            s = [similarity(of(x), of(y), similar) for x, y in zip(b["x"], b["y"], strict=True)]
            out = b[["a", "b"]].assign(similarity=s)
            yield out[out["similarity"] > 0]

    x, y = bodies.toDF("a", "x"), bodies.toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(lean(run), "a long, b long, similarity double")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, label) of all ids in links (a, b): the least id of the connected component.

    Each round takes the least label of the neighbours and then that label's own label, so distances shrink by more than
    half; each round's labels are written to the shared folder. Ends when nothing changes.
    """
    edges = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    labels = stored(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")), name)
    while True:
        seen = edges.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        new = stored(step.join(jump, "mid").select("id", "old", F.least("mid", "far").alias("label")), name)
        changed = new.where("old != label").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def _classes(docs: DataFrame, mark: Column, similar: float, rounds: int) -> DataFrame:
    """id, mark, key, class_key, class_id, copy_of, n_links of each row of docs."""
    sk = stored(_sketches(docs, mark), "sketches")
    best = F.min(F.struct("id", "mark")).alias("row")
    # the number is fixed by being written; it stands for the text's words, doc_ids come back at the end alone
    texts = stored(sk.groupBy("key").agg(best, F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("text", F.monotonically_increasing_id()), "texts")
    banded = texts.select(F.col("text").alias("id"), "n", F.explode("bands").alias("band"))
    company = banded.groupBy("band").agg(F.count("*").alias("company")).where("company > 1")
    members = stored(banded.join(company, "band").select("id", "n", "band", "company"), "members")
    pairs = stored(_pairs(members.withColumn("rank", -F.col("id"))), "pairs")

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["number"].to_numpy(), "body": [w.tobytes() for w in word_hashes(b["text"].tolist())]})

    wanted = members.select(F.col("id").alias("number")).distinct().join(texts.select(F.col("text").alias("number"), "row.*"), "number")
    rows = docs.select(_id(), mark.alias("mark"), "text").join(wanted, ["id", "mark"]).groupBy("number").agg(F.first("text").alias("text"))
    bodies = stored(rows.mapInPandas(lean(body), "id long, body binary"), "bodies")

    links = stored(_verified(pairs, bodies, similar), "links")
    tried, labels = pairs, components(links)
    ranks = members.groupBy("id").agg(F.sum("company").alias("rank"))
    tag = lambda: members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    for k in range(rounds):
        if k + 1 < rounds:
            firsts = tag().join(ranks, "id").groupBy("band", "label").agg(F.max_by(F.struct("id", "n", "rank"), F.struct(F.col("rank"), F.xxhash64("id"))).alias("f"))
            more = _pairs(firsts.select("band", "f.*"))
        else:
            more = _apart(tag(), bodies, similar)
        more = stored(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not more.limit(1).count():
            continue
        found = stored(_verified(more, bodies, similar), "links")
        tried = tried.unionByName(more)
        if found.limit(1).count():
            links = stored(links.unionByName(found), "links")
            labels = components(links)
    named = texts.join(labels.withColumnRenamed("id", "text"), "text", "left").withColumn("label", F.coalesce("label", "text"))
    lead = named.groupBy("label").agg(F.min("key").alias("class_key"), F.min("row.id").alias("class_id"), F.min("row").alias("lead"))
    ends = links.select(F.explode(F.array("a", "b")).alias("text")).groupBy("text").agg(F.count("*").alias("n_links"))
    classes = named.select("key", "label", "text", F.col("row.id").alias("copy_of")).join(lead, "label").join(ends, "text", "left").drop("label", "text")
    classes = classes.withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return sk.select("id", "mark", "key").join(classes, "key")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of the class), copy_of (least doc_id with the same words),
    class_key (hexadecimal; tells classes apart also where doc_ids are null or repeat), n_links (alignments of its text with
    other texts that confirmed a link; two texts that others have joined already are not aligned again).

    Texts with the same words are one text from the start; empty and null texts are one class; texts shorter than five
    words are only like themselves. Classes are of texts, not of ids: rows with one doc_id and unlike texts are in classes
    of their own. A null doc_id stays null; a class whose doc_ids are all null has a null class_id. An empty table gives no
    row. At first the members of a bucket are compared with one of them; then, `rounds` in all, components that share
    a bucket by their texts with most company there (the original of many copies has most); at last all pairs of a bucket
    not yet in one component that can be alike at all (see _apart). No link between texts that share a band is left out.
    """
    real = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    out = _classes(docs, F.xxhash64("text"), similar, rounds).withColumn("doc_id", F.col("id"))
    return out.select(real("doc_id"), real("class_id"), real("copy_of"), F.lower(F.hex("class_key")).alias("class_key"), "n_links")


def representatives(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """`docs` with one document of each class: that with the least doc_id (a null one comes last; of rows with one doc_id
    the one with the least hash of its columns; of rows alike in all columns one). Columns may have any names."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mark, names = F.xxhash64(*columns), unused(docs, "id", "mark")
    lead = _classes(docs, mark, similar, 2).select("lead.*").distinct().toDF(*names)
    # one select: both values are of the rows as they came
    kept = docs.select(*columns, _id().alias(names[0]), mark.alias(names[1])).join(lead, names, "left_semi")
    return kept.dropDuplicates(names).select(*columns)
