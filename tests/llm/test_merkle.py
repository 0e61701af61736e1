"""The manifest against hashlib, level by level, and against SQL."""

import hashlib
import zlib

import pytest

from tesserine.llm import merkle
from tesserine.llm.queries import op11_merkle

from ..parity import differences


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return H(*said)


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def plain(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: sorted((first(r[0]), _leaf(r), r) for r in rows if r[2] == v) for v in langs}
    levels = {v: _levels([x[1] for x in t]) for v, t in trees.items()}
    top = _levels([levels[v][-1][0] for v in langs])
    out = []
    for j, v in enumerate(langs):
        for i, (_, leaf, r) in enumerate(trees[v]):
            path = _path(levels[v], i) + _path(top, j)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = _leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                now = H(left, now, right)
            root = top[-1][0]
            out.append((r[0], leaf, levels[v][-1][0], root, H(*[x for p in path for x in p]), now, now == root))
    return out


def _rows(n, langs):
    return [(i * 7 % 1009, f"s{i % 3}", langs[i % len(langs)], i, f"Text {i} É ABC") for i in range(n)]


KIND = "doc_id long, source string, lang string, n_chars long, text string"
CASES = {
    "one": _rows(1, ["en"]),
    "nine": _rows(9, ["en"]),
    "groups": _rows(30, ["en", "fr", None, "é", "Z"]),
    "many groups": [(i, None, f"l{i:03}", None, None) for i in range(77)],
    "repeats and nulls": [(1, None, None, None, None)] * 3 + [(None, "a", "", 3, "")] * 2 + [(None, "b", "", 3, "X")] + [(1, "a", None, 3, "x" * 5000)] * 10,
    "blocks": _rows(150, ["en", "en", "en", "fr"]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("tiers", [1, 3])
def test_equals_hashlib(spark, monkeypatch, name, tiers):
    if tiers == 1 and name not in ("many groups", "blocks"):
        pytest.skip("one round")
    monkeypatch.setattr(merkle, "TIERS", tiers)
    df = spark.createDataFrame([(*r, "x", 1) for r in CASES[name]], KIND + ", tree string, at int")
    found = [tuple(r) for r in merkle.tampered(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(found, key=key) == sorted(plain(CASES[name]), key=key)


def test_empty_table(spark):
    assert merkle.tampered(spark.createDataFrame([], KIND)).collect() == []


def test_equals_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", op11_merkle, merkle.SQL) == []
