import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tesserine.llm import warc as W

PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "http://e/", "big" * 100000), (6, "http://e/", "one"), (None, "http://f/", "<p>é</p>"), (7, "u", "a\r\n\r\nb")]


def frame(spark):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in PAGES], "page_id long, url string, html string, payload int").repartition(3)


def test_round_trip(spark):
    got = {r.page_id: r for r in W.round_trip(frame(spark)).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == raw]
        first = max(x for x in same if x is not None)
        r = got[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.intact
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))


def test_small_payloads_are_responses(spark):
    got = {r.page_id: r.record_type for r in W.round_trip(frame(spark), 9).collect()}
    assert got[3] == got[4] == "response" and got[1] == "revisit"


def test_predicates_and_foreign_archives(spark, tmp_path):
    path = f"file://{tmp_path}/own"
    W.archive(frame(spark), path)
    rows = spark.read.format("warc").load(path).where("record_type = 'response' and target_uri like 'http://e%'").collect()
    assert sorted(bytes(r.payload)[:3] for r in rows) == [b"big", b"one"]
    light = spark.read.format("warc").option("payload", "false").option("types", "response").load(path)
    assert light.where("payload is not null").count() == 0 and light.select("record_type").distinct().count() == 1
    whole = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "own").glob("*.warc.gz")))
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)  # any gzip reader understands the members
    reader = W.WarcReader(path, True, None)
    reader.pushed = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.EqualTo(("payload_bytes",), 3)]))
    assert len(reader.pushed) == 1 and {r for p in reader.partitions() for b in reader.read(p) for r in b.column("record_type").to_pylist()} == {"revisit"}
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    other = tmp_path / "other.warc.gz"
    other.write_bytes(gzip.compress(raw) + gzip.compress(raw.replace(b"hello", b"world")))
    assert [bytes(r.payload) for r in spark.read.format("warc").load(str(other)).collect()] == [b"hello", b"world"]


def test_archives_of_others_plain_and_in_one_member(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoft: x\r\n\r\n\r\n"
    bodies = [b"hello", b"", b"a\r\n\r\nb" * 3000, b"x" * 200_000]
    raw = info
    for i, body in enumerate(bodies):
        block = b"HTTP/1.1 200 OK\r\nX-Filler: " + b"f" * (9000 if i == 2 else 3) + b"\r\n\r\n" + body
        raw += b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x/%d\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % (b"request" if i == 1 else b"response", i, len(block)) + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]))
    W.register(spark)
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    for kind in ("warcinfo", "request", "response"):
        want = {"warcinfo": [b"soft: x\r\n"], "request": [b""], "response": [b"hello", *bodies[2:]]}[kind]
        got = [r for r in rows if r.record_type == kind]
        assert sorted(bytes(r.payload) for r in got) == sorted(want * 3) and all(r.payload_bytes == len(r.payload) and r.intact is None for r in got)
    light = spark.read.format("warc").schema("record_type string, payload_bytes bigint").load(str(tmp_path)).where("record_type = 'response'")
    assert light.columns == ["record_type", "payload_bytes"] and sorted(r.payload_bytes for r in light.collect()) == sorted([5, 18000, 200_000] * 3)
    inflated = []

    class Counted(W.Inflated):
        def read(self, n):
            inflated.append(n)
            return super().read(n)

    with open(tmp_path / "b.warc.gz", "rb") as f:
        assert list(W.records(Counted(f), lambda said: 0)) == [] and sum(inflated) < 60_000  # bodies are passed over


def test_empty(spark):
    assert W.round_trip(frame(spark).limit(0)).count() == 0
    assert W.round_trip(frame(spark)).where(F.col("payload_bytes") < 0).count() == 0


def test_malformed_lengths_are_passed_over(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\n%s\r\n\r\n"
    bad = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %s\r\n\r\nbody\nWARC is a word\r\n\r\n"
    raw = bad % b"ten" + good % b"first" + bad % b"-3" + bad % b"" + good % b"secon" + bad.replace(b"Content-Length: %s\r\n", b"") + good % b"third" + bad % b"1e3"
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw))
    W.register(spark)
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted([b"first", b"secon", b"third"] * 2)


def test_hot_and_rare_digests(spark):
    """A payload of over a thousandth of the pages goes another way than a rare pair; both give what SQL gives."""
    pages = [(i, "u", "hot" if i % 3 else f"own {i}") for i in range(3000)] + [(5000 + i, "u", f"own {3 * i}") for i in range(4)] + [(None, None, "only null"), (None, None, "hot")]
    got = sorted(map(tuple, W.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).select("record_type", "refers_to", "page_id").collect()), key=str)
    first = {}
    for i, _, html in pages:
        first[html] = max(first.get(html, -1), -1 if i is None else i)
    want = [("response", None, i) if (i if i is not None else -1) == first[h] else ("revisit", first[h], i) for i, _, h in pages]
    assert got == sorted(want, key=str)
