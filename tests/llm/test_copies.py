"""Exact copies against plain grouping, strong and weak fingerprints, chunks in any order."""

import hashlib
import random
from collections import defaultdict

import pytest

from tesserine.llm import copies
from tesserine.llm.queries import op12_copies

from ..parity import differences

KIND = "doc_id long, text string"


def plain(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = []
    for t, ids in groups.items():
        known = [k for k in ids if k is not None]
        keep, left = max(known, default=None), True
        for k in ids:
            kept = k == keep and left
            left = left and not kept
            out.append((k, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def _rows():
    rng = random.Random(5)
    texts = [None, "", "a", "b", "aé", "\x00a", "\x00\x00a", "x" * 1024, "x" * 1025, "y" + "x" * 1023, "long " * 60_000, "long " * 60_000 + "x"]
    rows = [(i, rng.choice(texts)) for i in range(80)] + [(None, "a"), (None, "a"), (None, "only null"), (3, "a"), (3, "a"), (500, "b"), (500, "b")]
    return rows + [(1000 + i, "hot") for i in range(60)]


@pytest.mark.parametrize("weak", [{}, {"prime": 3, "bases": (2,)}])
@pytest.mark.parametrize("sent", [copies.SENT, 0])
def test_equals_grouping(spark, monkeypatch, weak, sent):
    monkeypatch.setattr(copies, "SENT", sent)
    rows = _rows()
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], KIND + ", print binary, row int").repartition(5)
    found = copies.copies(df, **weak).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert _sorted(map(tuple, found.collect())) == _sorted(plain(rows))


def test_same_fingerprint_other_text(spark):
    """Anagrams of 0x01 and 0x04 in base 1 collide; the comparison tells them apart."""
    df = spark.createDataFrame([(1, "\x01\x04"), (2, "\x04\x01"), (3, "\x01\x04"), (4, "\x02\x03")], KIND)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in copies.copies(df, prime=101, bases=(1,)).collect()}
    assert found == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_polynomial():
    poly, x = copies.Polynomial(), random.Random(1).randbytes(5000)
    whole, first, second, none = poly.of([x, x[:1500], x[1500:], b""])
    assert whole.tolist() == [sum(c * pow(b, len(x) - 1 - i, poly.prime) for i, c in enumerate(x)) % poly.prime for b in poly.bases]
    assert poly.combined(first, second, 3500).tolist() == whole.tolist() and not none.any()


def test_chunks_in_any_order(spark):
    x = random.Random(2).randbytes(9000)
    cuts = [0, 10, 1024, 5000, 5000, 9000]
    rows = [("d", a, x[a:b]) for a, b in zip(cuts, cuts[1:])] + [("e", 0, None), (None, 0, b"a")]
    random.Random(3).shuffle(rows)
    found = {r.key: bytes(r.print) for r in copies.of_chunks(spark.createDataFrame(rows, "key string, offset long, body binary").repartition(3)).collect()}
    assert found == dict(zip(["d", "e", None], copies.Polynomial().prints([x, b"", b"a"])))


def test_without_copies(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "a", "l"), (2, "a", "m"), (3, None, "n"), (4, "", "o")], KIND + ", key string")
    found = copies.without_copies(df)
    assert found.columns == df.columns and sorted((r.doc_id, r.text) for r in found.collect()) == [(2, "a"), (4, "")]


def test_normalised(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "A"), (2, "a ")], KIND)
    assert {r.keep_id for r in copies.copies(df, normalised=F.lower(F.trim("text"))).collect()} == {2}


def test_empty_table(spark):
    assert copies.copies(spark.createDataFrame([], KIND)).collect() == []


def test_equals_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", op12_copies, copies.SQL) == []
