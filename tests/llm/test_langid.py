import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesserine.llm import langid as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    p = np.array([0.2, 0.15, 0.3, 0.1, 0.05, 0.01])

    def brute(w):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(w[at:i])
                    at = i
            parts.append(w[at:])
            total += math.prod(p[pieces[x]] if x in pieces else (p[5] if len(x) == 1 else 0) for x in parts)
        return total

    words = ["aba", "abab", "bab", "cab", "a", "abcba"]
    both = np.stack((p, p[::-1]), 1)
    got = np.exp(L.Lattice(words, L.Pieces(pieces)).log_probability(both))
    assert np.allclose(got[:, 0], [brute(w) for w in words]) and not np.allclose(got[:, 0], got[:, 1])
    one_by_one = [L.Pieces(pieces).long_log_probability(w, np.log(both)) for w in words]
    assert np.allclose(np.exp(one_by_one), got)


def test_remembered_words_score_the_same():
    words = [f"{a}{b}{c}" for a in "abc" for b in "abcd" for c in "ab"]
    m = L.fit({"x": dict.fromkeys(words, 1), "y": {"ab": 3}}, {"a": 0, "b": 1, "ab": 2, "c": 3, " a": 4})
    first = m.word_scores(words)
    texts = [" ".join(words[:9]), " ".join(words[5:]), "", None, "x" * 500]
    want = [first[:9].sum(0), first[5:].sum(0), 0, 0, m.word_scores(["x" * 500])[0]]
    for most in (5, 15, 100):
        for _ in range(2):
            got, n = m.text_scores(texts, most)
            assert n.tolist() == [9, len(words) - 5, 0, 0, 1] and all(np.allclose(g, w) for g, w in zip(got, want, strict=True))
        assert len(m.known) == len(m.table) <= most


def test_expected_uses_against_all_segmentations():
    numbers = {"a": 0, "b": 1, "ab": 2, "ba": 3, " a": 4}
    p = np.array([0.2, 0.15, 0.3, 0.1, 0.05, 0.2])
    words, counts = [" abab", " bb", " acab"], np.array([3.0, 1.0, 2.0])

    def ways(w):
        if not w:
            yield []
        for k in range(1, len(w) + 1):
            i = numbers.get(w[:k], 5 if k == 1 else None)
            if i is not None:
                for rest in ways(w[k:]):
                    yield [i, *rest]

    want = np.zeros(6)
    for w, c in zip(words, counts):
        weights = [math.prod(p[i] for i in x) for x in ways(w)]
        for x, v in zip(ways(w), weights):
            for i in x:
                want[i] += c * v / sum(weights)
    assert np.allclose(L.Lattice(words, L.Pieces(numbers)).expected(p, counts), want)
    one_by_one = np.zeros(6)
    for w, c in zip(words, counts):
        L.Pieces(numbers).long_expected(w, np.log(p), c, one_by_one)
    assert np.allclose(one_by_one, want)


def test_em_raises_likelihood():
    words, numbers = {"aab": 5, "ab": 9, "b": 2, "ab" * 30: 1}, {"a": 0, "b": 1, "ab": 2, " ": 3}
    at = [float(np.dot(L.fit({"x": words}, numbers, r, 1e-9).word_scores(list(words))[:, 0], list(words.values()))) for r in (1, 2, 6)]
    assert at[0] <= at[1] + 1e-9 <= at[2] + 2e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs, PATH, 60).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and 0 <= got[1] <= got[2] <= 1


def test_edges(spark):
    rows = [(1, "the and of the thing", "en", 1), (2, "der und die das", "de", 1), (3, None, "en", 1), (4, "12 34 !!", None, 1), (5, "", None, 1), (6, "the " * 30000, None, 1), (None, "und die", None, 1), (6, "the", None, 1), (7, "x" * 500, None, 1), (8, "und" * 40000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = L.identify(df, PATH).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[6].lang_pred == "en"
    assert L.identify(df.limit(0), PATH).count() == 0
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None).cast("string")), PATH).collect()} == {"und"}


def test_a_model_of_no_language_rejects_only_texts_without_a_letter(spark):
    df = spark.createDataFrame([(1, "the thing", None), (2, "12 34 !!", None), (3, None, None), (4, "und", "de")], "doc_id long, text string, lang string")
    got = L.keep_identified(df, L.fit({}, {"a": 0})).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(1, None), (4, "de")]


def test_numbers_are_no_letters(spark):
    """Superscripts, fractions, circled and Roman numerals and other scripts' digits; ª and CJK numerals are letters."""
    assert L.words_of("² ½ ① Ⅷ ٣ x² ª 一") == ["x", "ª", "一"]
    df = spark.createDataFrame([(1, "² ½ ①"), (2, "Ⅷ 12"), (3, "und ²"), (4, "und")], "doc_id long, text string").withColumn("lang", F.lit("de"))
    got = {r.doc_id: r.lang_pred for r in L.identify(df, PATH).collect()}
    assert got == {1: "und", 2: "und", 3: "de", 4: "de"}
    assert {r.doc_id for r in L.keep_identified(df, L.fit({}, {"a": 0})).collect()} == {3, 4}


def test_ties_and_clashing_names(spark):
    """Equally likely languages: the first by name. A caller's columns stay, whatever their names."""
    df = spark.createDataFrame([(1, "same words", "b", 7), (2, "same words", "a", 8)], "doc_id long, text string, lang string, said int").withColumn("_said", F.lit(9))
    model = L.fit({"b": {"same": 1, "words": 1}, "a": {"same": 1, "words": 1}}, L.vocabulary(PATH))
    got = L.predict(df, model).collect()
    assert {(r.lang_pred, r.score, r._said) for r in got} == {("a", 0.5, 9)} and {r.said for r in got} == {7, 8}
    assert L.keep_identified(df, model).columns == df.columns
