import random

import numpy as np
from pyspark.sql import functions as F

from tesserine.llm import omh as M


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_exact_above_the_threshold():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.randint(0, 9)] * rng.randint(0, 1)
        m, both = lcs(a, b), len(a) + len(b)
        s = m / (both - m) if both else 1.0
        got = M.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert abs(got - s) < 1e-12 if s >= 0.8 else got == 0.0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randint(0, 9999)}"
    return out


def test_classes_against_all_pairs(spark):
    rng = random.Random(9)
    texts = []
    for g in range(25):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 80, 200, 900]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            texts.append(" ".join(edited(rng, base, max(1, len(base) // rng.choice([20, 60, 120, 300])))))
    texts += [texts[0], texts[0].upper(), "", None, "one two", "one two", "one two three", "x " * 3000, "x " * 3001]
    rng.shuffle(texts)
    rows = [(i * 7, t, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(4)
    got = {r.doc_id: r.class_id for r in M.near_duplicates(df).collect()}
    sh = [M.shingles(w) for w in M.word_hashes(texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if M.similarity(sh[i], sh[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i * 7: find(i) * 7 for i in range(len(texts))}
    wrong = {i for i in want if want[i] != got[i]}
    assert not wrong, len(wrong)


def test_family_whose_original_has_a_middle_id(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    copies = []
    for _ in range(300):
        out = list(base)
        for at in rng.sample(range(200), 4):
            out[at] = f"new{rng.randint(0, 10**9)}"
        copies.append(" ".join(out))
    texts = copies[:150] + [" ".join(base)] + copies[150:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.class_id for r in M.near_duplicates(df).collect()} == {0}


def test_large_bucket_without_a_hub(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 2)
    base = [f"w{i}" for i in range(150)]
    rng = random.Random(3)
    texts = []
    for _ in range(20):  # couples: alike in 15 words of their own, unlike all others
        own = {at: f"own{rng.randint(0, 10**9)}" for at in rng.sample(range(0, 150, 5), 15)}
        one = [own.get(i, w) for i, w in enumerate(base)]
        texts += [" ".join(one), " ".join(one[:-1] + [f"end{rng.randint(0, 10**9)}"])]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in M.near_duplicates(df, rounds=1).collect()}
    sh = [M.shingles(w) for w in M.word_hashes(texts)]
    pairs = [(i, j) for j in range(40) for i in range(j) if M.similarity(sh[i], sh[j]) >= 0.8]
    assert len(pairs) == 20 and {i: min([i, *(a for a, b in pairs if b == i)]) for i in range(40)} == got


def classes(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.class_key) for r in M.near_duplicates(df).collect())


def test_texts_without_a_lead_that_links(spark):
    """20 texts alike among themselves, 40 relatives of lower id that are like none: one class of 20."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    far, near = [], []
    for _ in range(40):
        out = list(base)
        for at in rng.sample(range(0, 300, 5), 14):
            out[at] = f"far{rng.randint(0, 10**9)}"
        far.append(" ".join(out))
    for _ in range(20):
        out = list(base)
        for at in range(3, 300, 30):
            out[at] = f"kin{at}"
        out[rng.randrange(300)] = f"own{rng.randint(0, 10**9)}"
        near.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(far + near)), "doc_id long, text string").repartition(4)
    sh = [M.shingles(w) for w in M.word_hashes(far + near)]
    want = list(range(60))
    for j in range(60):
        for i in range(j):
            if M.similarity(sh[i], sh[j]) >= 0.8:
                want = [want[i] if x == want[j] else x for x in want]
    want = {i: min(k for k in range(60) if want[k] == want[i]) for i in range(60)}
    assert {r.doc_id: r.class_id for r in M.near_duplicates(df).collect()} == want and len(set(want.values())) == 41


def test_null_and_repeated_ids_do_not_merge_unlike_texts(spark):
    words = [f"w{i}" for i in range(80)]
    a, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(f"x{i}" for i in range(60))
    got = classes(spark.createDataFrame([(1, a), (None, near), (None, other), (5, near), (5, other)], "doc_id long, text string"))
    assert [(x[0], x[1], x[2]) for x in got] == [(False, 1, 1), (False, 5, 1), (False, 5, 5), (True, 0, 1), (True, 0, 5)]
    assert len({x[3] for x in got}) == 2
    got = classes(spark.createDataFrame([(None, a), (None, near), (None, other)], "doc_id long, text string"))
    assert [x[2] for x in got] == [None] * 3 and len({x[3] for x in got}) == 2


def test_representatives(spark):
    words = [f"w{i}" for i in range(80)]
    a, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(f"x{i}" for i in range(60))
    rows = [(3, near, "u"), (1, a, "u"), (1, a, "u"), (None, near, "u"), (None, other, "v"), (7, None, "w"), (8, "", "w"), (9, "lone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = M.representatives(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id in (1, 7, 9) or text like 'x0%'").distinct().collect()))


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (5, None), (6, "")], "doc_id long, text string")
    got = sorted(map(str, M.near_duplicates(df).collect()))
    assert len(got) == 5 and sum("class_id=3" in r for r in got) == 3 and sum("class_id=5" in r for r in got) == 2
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7), (2, "a b c d e f", 8, 9, 1), (3, "g h i j k l", 8, 9, 1)], "doc_id long, text string, _id long, _mark long, id long").withColumn("mark", F.lit("m")).withColumn("a.b", F.lit(1))
    got = M.representatives(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id != 2").collect()))
    assert M.representatives(df.where("doc_id = 3")).count() == 1


def test_link_counts(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), " ".join(words[:-1] + ["other"]), "alone in this world", "alone in this world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in M.near_duplicates(df).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 0, 4: 0}
