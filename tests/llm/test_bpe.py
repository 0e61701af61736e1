import hashlib
import random

import pytest

pytest.importorskip("tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from tesserine.llm.bpe import encode_decode, load
from tesserine.llm.common import CHUNK_CHARS

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "aaaaaaa aaaa", "Hello  world!\n\n x", "it's<|endoftext|> the<|endoftext|>", "<|endoftext", "日本語 текст ñandú 🙂🙂", "0x1F 12345678 ###  ***\t\t", "a" * 3000, "thththereanonerst " * 400, "   x\r\n"]


def expected(t):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation(), tok.no_padding()
    ids = tok.encode(t or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def test_words_match_the_library():
    rng, bpe, tok = random.Random(3), load(PATH), Tokenizer.from_file(PATH)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ción", "ß", "é", " ", "  ", "\n", "1", "23", "!!", "aa", "Z", "日", "'s"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x4E00, 0x4FFF)])) for _ in range(40)) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 255), 32, 97, 10])) for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    for t, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(t) == want.ids, t
        assert bpe.decode(want.ids) == tok.decode(want.ids, skip_special_tokens=False)


def test_only_failing_words_are_merged():
    bpe = load(PATH)
    *_, failed = bpe.encode_words([" the", " thing", " reading"])
    assert failed == 0


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[4], "twice")]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, keep_ids=True).collect()
    assert len(got) == len(rows)
    texts = {(i, hashlib.sha256((t or "").encode()).hexdigest()): t for i, t, _ in rows}
    for r in got:
        ids, back = expected(texts[r.doc_id, r.decoded_sha256])
        assert (r.n_tokens, r.ids, r.lossless) == (len(ids), ids, True)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table(spark):
    got = encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"]


def test_texts_beyond_a_run(spark):
    """A text longer than the runs that a worker splits at once, among short ones, and one word of many characters."""
    long = "The harbour's 12 old cranes — ñandú 🙂 " * (CHUNK_CHARS // 38 + 1000)
    texts = ["before", long, "after", "ab" * 20_000]
    got = {r.doc_id: r for r in encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert len(long) > CHUNK_CHARS
    for i, t in enumerate(texts):
        ids, back = expected(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and got[i].lossless
