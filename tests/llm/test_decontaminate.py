import random

from pyspark.sql import functions as F

from tesserine.llm import decontaminate as D

ITEMS = [
    (1, "Yesterday Alice bought 12 apples for 3 dollars each and gave 12 of them to Bob before lunch. How much did Alice pay?"),
    (2, "A train travels 120 km in 2 hours along the river towards the old harbour. What is its speed on that way?"),
    (3, "Name three large rivers"), (4, ""), (5, None), (None, "ignored item that has no id at all in this table"),
]
FILL = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_leaks(spark):
    same = FILL + ". " + ITEMS[0][1] + " " + FILL
    other = "Yesterday Carol bought 15 apples for 4 dollars each and gave 15 of them to Dan before lunch. How much did Carol pay?"
    torn = "Yesterday Carol bought 15 apples for 4 dollars each and gave 16 of them to Dan before lunch. How much did Erin pay?"
    rows = [(0, FILL), (1, same), (2, FILL + ". " + other), (3, torn), (4, None), (5, ""), (6, "we name three large rivers here"), (7, ITEMS[1][1].replace("120", "95").replace("2 hours", "3 hours")), (1, same), (None, same), (8, "long " * 50000)]
    docs = frame(spark, [(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = frame(spark, ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.exact) for r in D.report(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, True), (2, 1, False), (6, 3, True), (7, 2, False)], key=str)
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [0, 3, 4, 5, 8]
    assert D.report(docs.limit(0), bench).count() == 0 and D.report(docs, bench.limit(0)).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    docs = frame(spark, [(i, t) for i, (_, t) in enumerate(ITEMS)], "doc_id long, text string")
    bench = frame(spark, ITEMS, "item_id long, text string")
    whole = sorted(map(str, D.report(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 80)
    assert sorted(map(str, D.report(docs, bench).collect())) == whole


def brute(items, text):
    """{item: (matched, verbatim)} by comparing all windows of all items with all of the text, token by token."""
    import re

    def template(text):
        words, out = re.findall(r"\d+(?:[.,:/]\d+)*|\w+", text), []
        for w in words:
            low = w.lower()
            kind = "number" if w[0].isdigit() or low in D.NUMBER_WORDS else "name" if len(w) > 1 and w[0].isupper() and w[1:].islower() else "word"
            out.append(("unit" if low in D.UNITS and out and out[-1][0] == "number" else kind, low))
        return out

    doc, found = template(text), {}
    for k, item in enumerate(items):
        it = template(item)
        width = min(8, len(it))
        pairs = set()
        for i in range(len(doc) - width + 1):
            for j in range(len(it) - width + 1):
                a, b = doc[i : i + width], it[j : j + width]
                plain = sum(x[0] == "word" for x in b)
                masked = all(x == y if "word" in (x[0], y[0]) else x[0] == y[0] for x, y in zip(a, b))
                if width and ([x[1] for x in a] == [y[1] for y in b] or masked and min(4, (width + 1) // 2) <= plain < width):
                    pairs |= {(i + x, j + x) for x in range(width)}
        regions, last = [], None
        for i, j in sorted(pairs):
            if last is None or i - last > max(len(it), 16):
                regions.append(set())
            regions[-1].add((i, j))
            last = i
        best = None
        for region in regions:
            kept = set()
            for line in {i - j for i, j in region}:
                own = sorted(p for p in region if p[0] - p[1] == line)
                filled = {}
                for i, j in own:
                    if it[j][0] != "word":
                        filled.setdefault(it[j], set()).add(doc[i][1])
                if any(len(v) > 1 for v in filled.values()):
                    runs, before = [], None
                    for i, j in own:
                        if doc[i][1] == it[j][1]:
                            if before != j - 1:
                                runs.append([])
                            runs[-1].append((i, j))
                            before = j
                    own = [p for r in runs if len(r) >= width for p in r]
                kept |= set(own)
            if kept:
                low, high = min(j for _, j in kept), max(j for _, j in kept)
                verbatim = any(all((line + j, j) in kept and doc[line + j][1] == it[j][1] for j in range(low, high + 1)) for line in {i - j for i, j in kept})
                best = max(best or (0, False), (len({j for _, j in kept}), verbatim))
        if best and (best[0] >= min(13, len(it)) or best[0] >= 0.6 * len(it)):
            found[k] = best
    return found


def test_windows_and_slots_against_brute_force():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    names, numbers = ["Anna", "Bert", "Cleo", "Dora"], ["3", "17", "two", "9"]

    def token():
        return rng.choices([rng.choice(words), rng.choice(names), rng.choice(numbers) + rng.choice(["", " km", " days"])], [8, 1, 1])[0]

    items = [" ".join(token() for _ in range(rng.choice([3, 6, 10, 20, 30]))) for _ in range(20)]
    kinds = set()
    for n in range(150):
        swap = {a: rng.choice(names if a in names else numbers) for a in names + numbers}
        src = rng.choice(items).split()
        if n % 3:
            src = [swap.get(w, w) if n % 3 == 1 or rng.random() < 0.5 else w for w in src]
        a = rng.randint(0, len(src) // 2)
        part = src[a : a + rng.randint(4, 30)]
        filler = [token() for _ in range(60)]
        text = " ".join(filler[:20] + part[: len(part) // 2] + filler[20 : 20 + rng.choice([0, 0, 1, 40])] + part[len(part) // 2 :])
        got = {h[0]: (h[1], h[3]) for h in D.Benchmark(list(range(20)), items).hits([text])[0]}
        assert got == brute(items, text), text
        kinds |= {v[1] for v in got.values()}
    assert kinds == {True, False}


def test_probes():
    one = "What is 12 + 7 - 3 + 19 - 4 + 8 + 22 - 6 + 31 ?"
    two = "Anna met Bert and Cleo near Dora while Emil saw Fred and Gina"
    marie = "Marie had some red apples at home. Marie gave two of them to her old friend and kept the others for later"
    bench = D.Benchmark([1, 2, 3], [one, two, marie])
    assert [h[0] for t in (one, two, marie) for h in bench.hits([t])[0]] == [1, 2, 3]
    paula = bench.hits([marie.replace("Marie", "Paula")])[0]
    assert [(h[0], h[2], h[3]) for h in paula] == [(3, 1.0, False)]
    apart = "Marie had some red apples at home Marie " + FILL * 20 + " and kept the others for later and then"
    assert bench.hits([apart])[0] == [] and bench.hits([marie.lower()])[0][0][2:] == (1.0, True)
    german = D.Benchmark([1], ["Ein Zug fährt in zwei Stunden von hier nach dort und braucht dafür drei Liter, wie viel braucht er in vier Tagen"])
    assert german.hits(["Ein Zug fährt in fünf Stunden von hier nach dort und braucht dafür sechs Liter, wie viel braucht er in acht Tagen"])[0][0][2] == 1.0


def test_ties_and_long_texts():
    text = ITEMS[1][1]
    bench = D.Benchmark([1, 2], [text, text])
    far = f"{text} {FILL} {FILL} {text} {FILL}" * 200
    assert [(h[0], h[2], h[3]) for h in bench.hits([far])[0]] == [(1, 1.0, True), (2, 1.0, True)]


def test_literal_runs_count_on_a_torn_diagonal():
    bench = D.Benchmark([1], [ITEMS[0][1]])
    text = "Filler before. " + ITEMS[0][1].replace("gave 12", "gave 13")
    assert [(h[0], h[1], h[3]) for h in bench.hits([text])[0]] == [(1, 22, False)]
    other = ITEMS[0][1].replace("Alice bought 12", "Carol bought 15")
    assert bench.hits([other])[0][0][1] < 22


def test_items_of_numbers_and_names_have_an_exact_path():
    items = ["Solve 3x + 5 = 20", "Compute 3 5 8 13 21 34 55 89", "12 7 19 26 45 71 116 187 303 490 793 1283 2076 3359"]
    bench = D.Benchmark([1, 2, 3], items)
    got = bench.hits([f"{FILL}. {x} {FILL}" for x in items])
    assert [[(h[0], h[2], h[3]) for h in x] for x in got] == [[(k, 1.0, True)] for k in (1, 2, 3)]
    assert bench.hits(["Solve 3x + 6 = 20", "Compute 3 5 8 13 22 34 55 89", FILL]) == [[], [], []]


def test_clean_keeps_all_columns(spark):
    text = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 5), (2, None, 6), (None, "", 7), (3, "other", 8), (3, "other", 8)], "doc_id long, text string, _hits int").withColumn("hits", F.lit("h"))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = D.clean(df, bench)
    assert got.columns == df.columns and sorted(r._hits for r in got.collect()) == [6, 7, 8, 8]
    assert D.clean(df, bench.limit(0)).count() == 5 and D.clean(df.limit(0), bench).count() == 0


def test_joined_route_finds_the_same(spark, monkeypatch):
    """A benchmark beyond the broadcast blocks: windows joined by hash, with copies, short items, nulls and many of a template."""
    items = ITEMS + [(100 + i, f"A train travels {i} km in {i % 7} hours along the river towards the old harbour. What is its speed on that way?") for i in range(60)] + [(3, "Name three large rivers")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"{FILL} {t} {FILL}" for _, t in items[:30] if t] + [None, "", "short", FILL, "Say: name three large rivers now"] + [f"{FILL} a train travels 5 km"]
    docs = spark.createDataFrame([(i % 40, t, "x", 1) for i, t in enumerate(texts + texts)] + [(None, texts[0], "y", 2)], "doc_id long, text string, digest string, hits int").repartition(4)
    want = sorted(map(str, D.report(docs, bench).collect()))
    kept = sorted(map(str, D.clean(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCKS", 0)
    assert len(want) > 100 and sorted(map(str, D.report(docs, bench).collect())) == want
    got = D.clean(docs, bench)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == kept
    assert D.report(docs, bench.limit(0)).count() == 0 and D.clean(docs.limit(0), bench).count() == 0
