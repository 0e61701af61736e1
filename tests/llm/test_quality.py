import numpy as np
from pyspark.sql import functions as F

from tesserine.llm import quality as Q
from tesserine.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_chunks_cover_everything():
    for n in [0, 1, 63, 64, 65, 448, 449, 512, 513, 896, 897, 5000]:
        seen = np.zeros(n, bool)
        for s in Q.chunk_starts(n):
            seen[s : s + Q.CHUNK] = True
        assert seen.all() and len(Q.chunk_starts(n)) >= 1


def test_responses_are_a_convolution():
    rng = np.random.default_rng(1)
    net = Q.Network(rng.normal(size=(Q.WIDTH, 257, Q.FILTERS)).astype(np.float32), rng.normal(size=2 * Q.FILTERS), 0.1)
    body = rng.integers(0, 257, 101).astype(np.int16)
    got = net.responses(body)
    for k in range(len(got)):
        want = sum(net.table[j, body[k * Q.STEP + j]] for j in range(Q.WIDTH))
        assert np.allclose(got[k], want, atol=1e-5)
    assert 0 <= net.probability(b"") <= 1 and 0 <= net.probability(bytes(range(256)) * 90) <= 1


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = Q.classify(own, labels).join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    y, s = got["quality"].to_numpy(), got["score"].to_numpy()
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    print("auc", auc, "accuracy", ((s >= 0.3) == y).mean(), len(y))
    assert auc > 0.9


def test_probability_and_gradient_against_plain_python():
    rng = np.random.default_rng(3)
    net = Q.Network(rng.normal(0, 0.5, (Q.WIDTH, 257, Q.FILTERS)).astype(np.float32), rng.normal(size=2 * Q.FILTERS), 0.1)

    def plain(raw, net=net):
        body = list(raw) + [256] * (Q.WIDTH + Q.STEP)
        positions = range((len(body) - Q.WIDTH) // Q.STEP + 1)
        r = [[sum(float(net.table[j][body[k * Q.STEP + j]][f]) for j in range(Q.WIDTH)) for f in range(Q.FILTERS)] for k in positions]
        tops = []
        for s in range(0, max(1, len(raw) - Q.OVERLAP), Q.CHUNK - Q.OVERLAP):
            inside = [r[k] for k in positions if s <= k * Q.STEP < s + Q.CHUNK]
            tops.append([max(0.0, max(x[f] for x in inside)) for f in range(Q.FILTERS)])
        features = [max(t[f] for t in tops) for f in range(Q.FILTERS)] + [sum(t[f] for t in tops) / len(tops) for f in range(Q.FILTERS)]
        return 1 / (1 + np.exp(-(sum(x * w for x, w in zip(features, net.weights)) + net.bias)))

    for n in (0, 1, 7, 60, 511, 512, 513, 1400):
        raw = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert abs(net.probability(raw) - plain(raw)) < 1e-4, n


def test_training_lowers_the_loss_and_separates():
    rng = np.random.default_rng(5)
    texts = [b"spam spam spam " * rng.integers(1, 90) if i % 2 else b"calm words here " * rng.integers(1, 90) for i in range(120)]
    y = np.array([i % 2 for i in range(120)], float)
    loss = []
    for epochs in (0, 1, 6):
        net = Q.fit(texts, y, epochs)
        p = np.array([net.probability(x) for x in texts])
        loss.append(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    assert loss[0] > loss[1] > loss[2] and ((p > 0.5) == y).all()


def test_gradient_of_scoring_features():
    """One step of training moves a table value as the loss of probability() itself does."""
    rng = np.random.default_rng(11)
    raw = rng.integers(0, 256, 1500).astype(np.uint8).tobytes()
    start = Q.fit([raw], np.array([1.0]), epochs=0)
    after = Q.fit([raw], np.array([1.0]), epochs=1)
    loss = lambda net: -np.log(net.probability(raw))
    body, _, where = start.tops(raw)
    assert len(where) == len(Q.chunk_starts(len(raw))) > 1
    for chunk, f in ((0, 0), (1, 3), (2, 5)):
        j, byte = 2, int(body[where[chunk, f] * Q.STEP + 2])
        ends = []
        for d in (0.01, -0.01):
            table = start.table.copy()
            table[j, byte, f] += d
            ends.append(loss(Q.Network(table, start.weights, start.bias)))
        slope = (ends[0] - ends[1]) / 0.02
        moved = after.table[j, byte, f] - start.table[j, byte, f]
        assert abs(slope) < 1e-4 or moved * slope < 0


def test_conflicting_labels_and_long_texts(spark):
    docs = spark.createDataFrame([(i, f"{'good prose of many words' if i % 2 else '$$ ## !!'} {i}") for i in range(40)] + [(1, "good again")] * 3 + [(100, "word " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (3, 0)] + [(4, 0)] * 5, "doc_id long, quality int")
    texts, y = Q.sample(docs, labels)
    held = {r.doc_id for r in docs.where(held_out()).collect()}
    assert len(texts) == len({*range(40)} - {2, 3} - held) and set(y) == {0.0, 1.0}
    got = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    assert got[5] > got[6] and 0 <= got[100] <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text", 5), (2, None, 5), (None, "", 5), (3, "### bad", 5), (3, "### bad", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in Q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(docs.limit(0), labels).count() == 0
