"""Aligned tokenizers against loops over the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tesserine.llm import align
from tesserine.llm.bpe import byte_alphabet
from tesserine.llm.queries import BYTE_BPE, PIECES, op13_alignment

FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_A = Tokenizer.from_file(BYTE_BPE)
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
_BYTES = {c: b for b, c in enumerate(byte_alphabet())}


def _a_bytes(i):
    return bytes(_BYTES[c] for c in _A.id_to_token(i))


def _b_bytes(i):
    piece = _B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if _B.is_byte(i) else piece.replace("▁", " ").encode()


def _spans(ids, body):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(body(i)), i))
        at += len(body(i))
    return out


def plain(rows):
    """The contract, token by token."""
    texts = []
    for k, text in rows:
        whole = " " + (text or "")
        a, b = _A.encode(whole, add_special_tokens=False).ids, _B.encode(text or "")
        if not text or b"".join(map(_a_bytes, a)) != whole.encode() or b"".join(map(_b_bytes, b)) != whole.encode():
            texts.append((k, None))
            continue
        a, b = _spans(a, _a_bytes), _spans(b, _b_bytes)
        shared = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, links, low = [], [], 0
        for stop in shared:
            groups.append(([x for x in a if low <= x[0] and x[1] <= stop], [x for x in b if low <= x[0] and x[1] <= stop]))
            low = stop
        for xs, ys in groups:
            links += [(x[2], y[2]) for x in xs for y in ys if max(x[0], y[0]) < min(x[1], y[1])]
        said = ";".join("|".join(",".join(str(x[2]) for x in side) for side in g) for g in groups)
        texts.append((k, (len(a), len(b), len(groups), links, said)))
    held = Counter(p for _, t in texts if t for p in set(t[3]))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for k, t in texts:
        if t is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(held[p] == most[p[0]] for p in t[3])
            out.append((k, t[0], t[1], t[2], len(t[3]), best, sum(held[p] for p in t[3]), hashlib.sha256(t[4].encode()).hexdigest()))
    return out


def _same(df, rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, df.select(FIELDS).collect()), key=key) == sorted(plain(rows), key=key)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _same(op13_alignment(spark, sf), rows)


ODD = [
    None, "", " ", "  ", "a", "a", "café 日本語 \U0001f600\U0001f600 กิ", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "▁", "\x00\x01\t\r\n x",
    "  two  blanks   three ", "line\n\n  next\n", "it's we'll I'D 12345 1,000.50", " 　 x", "x" * 3000, "é ‍﻿", "ab" * 50 + " " * 200 + "z",
]


def test_odd_texts(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, block int, pairs string")
    assert _same(align.alignments(df, BYTE_BPE, PIECES), rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignments(df, BYTE_BPE, PIECES).collect() == []
    assert align.pair_counts(df, BYTE_BPE, PIECES).collect() == []


@pytest.mark.parametrize("sizes", [(40, 100), (7, 30)])
def test_slices_and_blocks(monkeypatch, sizes):
    """Slices give what whole texts give; runs on the driver, where the sizes can be changed."""
    texts = [t or "" for t in ODD] + ["Words and 12 more words, it's so.\n\n New line  here été " * 5]
    both = align.Aligner(BYTE_BPE, PIECES)
    whole = list(both.texts(texts))
    monkeypatch.setattr(align, "SLICE_CHARS", sizes[0])
    assert max(len(list(align.slices(" " + t))) for t in texts) > 3
    for x, y in zip(both.texts(texts), whole, strict=True):
        assert x[:4] == y[:4] and b"".join(x.groups) == b"".join(y.groups)
        assert x.codes.tolist() == y.codes.tolist() and x.times.tolist() == y.times.tolist()


def test_groups_and_products(spark):
    rows = [(1, "unbelievable cafés"), (2, "▁"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = align.groups(df, BYTE_BPE, PIECES).orderBy("at").collect()
    body = " unbelievable cafés".encode()
    assert {r.doc_id for r in found} == {1} and found[0].start == 0 and found[-1].end == len(body)
    assert all(b"".join(map(_a_bytes, r.a_ids)) == body[r.start : r.end] == b"".join(map(_b_bytes, r.b_ids)) for r in found)
    assert "".join(";".join("|".join(",".join(map(str, x)) for x in (r.a_ids, r.b_ids)) for r in found))
    assert align.products(align.groups(df, BYTE_BPE, PIECES)).count() == sum(len(r.a_ids) * len(r.b_ids) for r in found)


def test_pair_counts(spark):
    rows = [(1, "one two"), (2, "two two"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.a_id, r.b_id): (r.documents, r.best) for r in align.pair_counts(df, BYTE_BPE, PIECES).collect()}
    two = (_A.encode(" two", add_special_tokens=False).ids[0], _B.encode("two")[0])
    assert found[two] == (2, True)
