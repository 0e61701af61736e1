import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tesserine.llm import decontaminate, omh, secrets

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for s, _, e, _ in secrets.spans_of(text):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_against_plain_python(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    keep = sorted(i for i, r in docs.items() if any(c.isalpha() for c in r.text or ""))
    words = omh.word_hashes([docs[i].text for i in keep])
    sh = [omh.shingles(w) for w in words]
    root = list(range(len(keep)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keep)):
        for j in range(i):
            if omh.similarity(sh[i], sh[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    keep = [k for i, k in enumerate(keep) if find(i) == i]
    bench = decontaminate.Benchmark([r.item_id for r in items], [r.text for r in items])
    keep = [k for k, h in zip(keep, bench.hits([docs[k].text for k in keep])) if not h]
    assert sorted(got) == keep
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k in keep:
        text = redacted(docs[k].text)
        ids = tok.encode(text, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "token=abcdefghij und der", None, "s", 5), (2, "12 !!", "en", None, 5), (3, "the one and only", "en", "s", 16), (3, "the one and only", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    for at in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == docs.columns
        rows = sorted(map(str, at.collect()))
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, SF)
    got = at.collect()
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in got) == [("3", "the one and only", 16), ("None", "[SECRET] und der", 16)] and rows == []


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns named as the operators name theirs go through every stage untouched."""
    extra = ["_id", "_mark", "id", "mark", "_said", "said", "_hits", "hits", "_row", "row", "_kinds", "secret_spans", "own_text", "own_key", "digest", "key", "n", "text2"]
    docs = spark.createDataFrame([(1, "the one and only text of this table", "en", "s", 35), (2, "token=abcdefghij is said here", None, "s", 29)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in extra})
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
    rows = at.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2] and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
