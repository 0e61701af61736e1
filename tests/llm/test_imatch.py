import hashlib
import math
import random
import struct
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from tesserine.llm import imatch as I
from tesserine.llm.common import _block, successors


def test_successors(spark):
    """Dense, sparse, very far, repeated and null keys; many blocks and few."""
    rng = random.Random(1)
    ids = rng.sample(range(0, 10**6), 200) + [2**40 + i * 2**30 for i in range(200)] + [7] * 120 + [None] * 150
    rows = [(i, f"v{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "i long, v string").repartition(5)
    hashed = {r.v: r.h for r in df.select("v", F.xxhash64("v").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hashed[r[1]]))
    want = {a[1]: b[1] for a, b in zip(order, order[1:])} | {order[-1][1]: None}
    for blocks in (1, 7, 60):
        out = successors(df, "i", ["v"], lambda d: d.withColumn("_value", F.struct("v")), blocks)
        assert {r.v: r.next_value.v if r.next_value else None for r in out.collect()} == want and out.columns == ["i", "v", "next_value"]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_block_has_most_rows(spark):
    """Ids spaced by 2^30, and one id that half of the rows share."""
    df = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id") * 2**30).alias("_order"), F.xxhash64("id").alias("_tie"))
    cuts = df.agg(F.percentile_approx("_order", [k / 40 for k in range(1, 40)], 800)).first()[0]
    sizes = [r["count"] for r in df.groupBy(_block(sorted(cuts)).alias("b")).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 600


def lower_words(text):
    return {w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w}


def xx(seed, *values):
    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def plain_fingerprint(text, band):
    """The list of subset hashes by plain Python, as the module's text has it."""
    terms = sorted(signed(xx(42, w.encode())) for w in lower_words(text))
    known = [t for t in terms if t in band]
    out = []
    for seed in range(I.HASHES):
        at = 0
        for bits in I.BITS:
            own = [t for t in known if (((xxhash.xxh64_intdigest(struct.pack("<i", seed), xx(42, t)) if seed else t) % 2**64) >> at) % 2**bits == 0]
            out.append(xx(42, *own) if own else None)
            at += bits
    return out + [xx(42, *terms) if all(x is None for x in out) else None]


def test_fingerprints_and_likeness_against_plain_python(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(250)] + ["Über", "naïve", "日本"]
    texts = [" ".join(rng.choices(vocab, [1 / (k + 5) for k in range(253)], k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(120)] + [None, "!!", "long " * 30000]
    df = spark.createDataFrame([(i * 2**30, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    counts = Counter(w for t in texts for w in lower_words(t))
    band = {signed(xx(42, w.encode())) for w, n in counts.items() if math.ceil(0.005 * len(texts)) <= n <= math.floor(0.3 * len(texts))}
    assert sorted(I.lexicon(df)) == sorted(band)
    want, plain = {}, [t or "" for t in texts]
    show = lambda fp: ".".join("-" if x is None else f"{x % 2**32:08x}" for x in fp)

    def near(a, b):
        some = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in some) / len(some) if some else 1.0

    for i, t in enumerate(plain):
        after, half = plain[(i + 1) % len(plain)], len(t) // 2
        own, edited, other = (plain_fingerprint(x, band) for x in (t, t[: len(t) - half] + after[:half], after))
        want[i * 2**30] = (show(own), show(edited), near(own, edited), near(own, other))
    for literals in (I.LITERALS, 0):
        monkeypatch.setattr(I, "LITERALS", literals)
        got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in I.edited_pairs(df).collect()}
        assert got == want


def test_edited_pairs(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 80))) for _ in range(150)]
    texts[7], texts[8] = texts[6], None
    rows = [(i * 37, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(5)
    got = {r.doc_id: r for r in I.edited_pairs(df).collect()}
    assert len(got) == len(rows)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        nxt, r, half = plain[(i + 1) % len(plain)], got[i * 37], len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[6 * 37].fingerprint == got[7 * 37].fingerprint and got[6 * 37].near_next == 1.0
    mean = lambda k: sum(getattr(r, k) for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next")


def test_lexicon_is_the_band(spark):
    rows = [(i, "common " + ("mid " if i % 4 == 0 else "") + f"rare{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert I.lexicon(df) == [df.select(F.xxhash64(F.lit("mid"))).first()[0]]


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b"), (3, "c"), (3, "a b")], "doc_id long, text string")
    got = I.edited_pairs(df).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.n_chars == 3}) == 1
    assert I.edited_pairs(df.limit(0)).count() == 0
    assert I.edited_pairs(df.where("doc_id = 3").limit(1)).first().near_next == 1.0
    assert I.fingerprints(df).columns == ["doc_id", "text", "fingerprint"]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"common word{i % 3}", i) for i in range(9)], "doc_id long, text string, _fp long").withColumns({c: F.lit(c) for c in ("_terms", "_known", "_hashes", "_row", "fp", "body", "whole")})
    got = I.fingerprints(df)
    assert got.columns == [*df.columns, "fingerprint"] and sorted(r._fp for r in got.collect()) == list(range(9))
    assert {(r._terms, r._known, r._row, r.whole) for r in got.collect()} == {("_terms", "_known", "_row", "whole")}
