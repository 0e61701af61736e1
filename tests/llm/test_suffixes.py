import hashlib
import random

import numpy as np
import pytest

from tesserine.llm import suffixes as S


@pytest.mark.parametrize("alphabet", [b"ab", b"abc", bytes(range(256)), b"a"])
def test_suffix_array(alphabet):
    rng = random.Random(len(alphabet))
    for n in [1, 2, 3, 17, 200]:
        raw = bytes(rng.choices(alphabet, k=n))
        text = np.frombuffer(raw, np.uint8)
        order = S.suffix_array(text, 9).tolist()
        assert sorted(order) == list(range(n))
        heads = [raw[i : i + 9] for i in order]
        assert heads == sorted(heads)
        for lcp, a, b in zip(S.common_prefixes(text, np.array(order), 9).tolist(), order, order[1:]):
            x, y = (raw + bytes(32))[a : a + 9], (raw + bytes(32))[b : b + 9]
            assert lcp == next((k for k in range(9) if x[k] != y[k]), 9)


def brute(rows, window=50):
    first = {}
    for i, t in rows:
        for s in range(len(t) - window + 1):
            w = t[s : s + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] < i:
                gone[s : s + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 7)))
    texts = []
    for _ in range(n):
        t = "".join(word() for _ in range(rng.randint(0, 120)))
        if texts and rng.random() < 0.6:
            src = rng.choice(texts)
            a = rng.randint(0, max(0, len(src) - 1))
            t = t[: len(t) // 2] + src[a : a + rng.randint(10, 300)] + t[len(t) // 2 :]
        texts.append(t if rng.random() > 0.1 else rng.choice(texts or [t]))
    common = "the passage that very many of these documents share, word for word and without change"
    texts = [t + common + t[:9] if i % 3 == 0 else t for i, t in enumerate(texts)]
    return texts + ["a" * 700, "a" * 300, "", "x" * 49, "x" * 50, "x" * 50]


@pytest.mark.parametrize("seed, hot", [(1, 2000), (2, 3)])
def test_against_all_windows(spark, seed, hot):
    rows = [(i * 3 % 997, t) for i, t in enumerate(corpus(seed))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(4)
    got = sorted(map(tuple, S.remove_repeats(df, buckets=5, hot=hot, block=3000).collect()))
    assert got == brute([(i, t.encode()) for i, t in rows])


def test_edges(spark):
    long = "0123456789" * 6
    df = spark.createDataFrame([(None, long), (None, None), (4, long), (4, long), (9, "q" + long)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept) for r in S.remove_repeats(df, keep_text=True).collect()}
    assert got[None, 60] == (0, long.encode()) and got[4, 60] == (60, b"") and got[9, 61] == (60, b"q") and got[None, 0] == (0, b"")
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_a_bucket_is_sorted_in_slices_of_a_bounded_size():
    """Before, a bucket was sorted in eight parts however large it was."""
    rng = np.random.default_rng(1)
    parts, lengths = rng.integers(0, S.PARTS, 5000).astype(np.uint8), rng.integers(50, 90, 5000)
    parts[:3000] = 7
    found = list(S.slices(parts, lengths, 9000))
    assert sorted(np.concatenate(found).tolist()) == list(range(5000)) and len(found) > 8
    assert all(lengths[x].sum() <= 9000 or len(set(parts[x].tolist())) == 1 for x in found)
    assert [p for x in found for p in parts[x].tolist()] == sorted(parts.tolist())
    assert list(S.slices(parts[:0], lengths[:0], 9000)) == []


@pytest.mark.parametrize("step", [7, 1 << 14])
def test_runs_of_windows(monkeypatch, step):
    """Hashed a step at a time: each window of a document, and no other, is in one run and under its own least hash."""
    monkeypatch.setattr(S, "STEP", step)
    rng = random.Random(step)
    docs = [bytes(rng.choices(b"abc ", k=n)) for n in (0, 60, 49, 50, 300, 0, 0, 51, 10)] + [b"a" * 120]
    runs = S.Runs(np.frombuffer(b"".join(docs), np.uint8), np.array([len(d) for d in docs]))
    begin, of = np.cumsum([0, *map(len, docs)]), {}
    for s, n, h, d in zip(runs.start.tolist(), runs.count.tolist(), runs.least.tolist(), runs.owner.tolist(), strict=True):
        for i in range(s, s + n):
            assert i not in of
            of[i] = h, d
    spread = S.spread(S.gram_hashes(np.frombuffer(b"".join(docs), np.uint8)))
    plain = S.gram_hashes(np.frombuffer(b"".join(docs), np.uint8))
    want = {i: (int(spread[i + int(np.argmin(plain[i : i + 35]))]), d) for d, t in enumerate(docs) for i in range(begin[d], begin[d] + len(t) - 49)}
    assert of == want
    known, docs_of = runs.distinct()
    assert known.tolist() == sorted({h for h, _ in want.values()}) and docs_of.tolist() == [len({d for x, d in want.values() if x == h}) for h in known.tolist()]
