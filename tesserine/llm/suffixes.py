"""Removal of long repeats across documents by suffix sorting.

A byte is removed if it lies in a string of WINDOW bytes that also starts in a document with a smaller doc_id. Strings are
routed by content: all equal windows have the same minimiser (least hash of their 16-byte grams), so they meet in one
bucket. Minimisers that only one document has are dropped first. What is left of a bucket is one text whose suffixes are
sorted in two stages: only those smaller than their successors are sorted directly, the others are induced by bucket scans;
the common prefixes of neighbours then show the equal windows.

Documents are packed once into blocks of about BLOCK bytes in the shared folder. Each later pass maps over the blocks, and
a bucket answers a block with bits or runs in the order of what the block sent, so texts never travel by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shuffle_partitions, stored

WINDOW, GRAM, BLOCK = 50, 16, 1 << 21
#: Minimisers of more documents than this are routed window by window, so that no bucket holds all surroundings of one
#: very common passage.
HOT = 2000
#: A bucket is sorted in this many parts at most, neighbouring ones together up to PART bytes, so that the suffixes in memory
#: at a time do not grow with the bucket and stay near the processor.
PARTS, PART = 256, 1 << 19
#: Positions whose grams are hashed at a time.
STEP = 1 << 14
#: Between pieces of text: a byte that UTF-8 never has.
GAP = 0xFF


# --- suffix sorting -----------------------------------------------------------------------------------------------


def words_of(text: np.ndarray, depth: int) -> np.ndarray:
    """The big-endian 8-byte word at each position and at `depth` ones behind the text, which goes on with zeros."""
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    out = np.empty(len(text) + depth + 8, np.uint64)
    for r in range(8):  # unaligned words, by eight aligned views
        n = len(range(r, len(out), 8))
        out[r::8] = padded[r : r + 8 * n].view(">u8")
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Of each suffix whether the next suffix is larger; the last one is not."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    change = np.flatnonzero(text[1:] != text[:-1])  # ends of runs of equal bytes
    up = text[change] < text[change + 1]
    out[: change[-1] + 1 if len(change) else 0] = np.repeat(up, np.diff(np.concatenate(([-1], change))))
    return out


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions `at` in the order of the `depth` bytes there: by 8 bytes at a time, only ties again. words: as words_of()."""
    if not len(at):
        return at
    key = words[at]
    by = np.argsort(key)
    order, key = at[by], key[by]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))  # where another group of ties begins
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    for d in range(8, depth, 8):
        if not len(tied):
            break
        sub, own = order[tied], np.cumsum(fresh[tied]) - 1
        key = words[sub + d]
        if depth - d < 8:
            key >>= np.uint64(8 * (8 - (depth - d)))
        mixed = np.zeros(own[-1] + 1, bool)  # groups of copies that go on alike stay as they are
        mixed[own[1:][(key[1:] != key[:-1]) & (own[1:] == own[:-1])]] = True
        some = np.flatnonzero(mixed[own])
        if len(some):
            by = some[np.argsort(key[some])]
            by = by[np.argsort(own[by], kind="stable")]
            order[tied[some]], key[some] = sub[by], key[by]
        fresh[tied[1:]] |= key[1:] != key[:-1]
        last = np.append(fresh[1:], True)[tied]
        tied = tied[~(fresh[tied] & last)]
    return order


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes, in order at least by their first `depth` bytes (suffixes that agree there stand together).

    Stage one sorts the suffixes smaller than their successors. Stage two scans the buckets of first bytes upwards: each
    suffix in order puts the one before it into that one's bucket, if that one is larger than its successor.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(text)
    direct = sort_directly(words_of(text, depth) if words is None else words, np.flatnonzero(small), depth)
    starts = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))  # the last suffix is larger than its empty successor
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        induced = []
        while len(wave):
            induced.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~small[before]]
        bucket = np.concatenate([*induced, direct[starts[c] : starts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        first = text[before]
        before, sizes = before[np.argsort(first, kind="stable")], np.bincount(first)
        ends = np.cumsum(sizes).tolist()
        for x in np.flatnonzero(sizes).tolist():
            waiting[x].append(before[ends[x - 1] if x else 0 : ends[x]])
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Of each suffix in `order` but the first: bytes in common with the one before it, at most `depth`."""
    words = words_of(text, depth) if words is None else words
    out = np.zeros(max(0, len(order) - 1), np.int64)
    live = np.arange(len(out))
    for d in range(0, depth, 8):
        a, b = words[order[live] + d], words[order[live + 1] + d]
        same = a == b
        x = (a ^ b)[~same]
        out[live[~same]] += np.floor((64 - np.frexp(x.astype(np.float64))[1]) / 8).astype(np.int64).clip(0, 7)
        live = live[same]
        out[live] += 8
    return np.minimum(out, depth)


# --- windows and minimisers ---------------------------------------------------------------------------------------


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at each position."""
    if len(text) < GRAM:
        return np.zeros(0, np.uint64)
    padded = np.concatenate((text, np.zeros((-len(text)) % 8 + 8, np.uint8)))
    lanes = np.empty(len(text) - 7, np.uint64)
    for r in range(8):  # unaligned words, by eight aligned views
        n = len(range(r, len(lanes), 8))
        lanes[r::8] = padded[r : r + 8 * n].view(np.uint64)
    h = lanes[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += lanes[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def spread(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def least_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """The least hash of each `width` consecutive grams; STEP positions at a time, which stay near the processor."""
    n = len(text) - GRAM - width + 2
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.concatenate([sliding_least(gram_hashes(text[s : min(s + STEP, n) + GRAM + width - 2]), width) for s in range(0, n, STEP)])


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    if len(h) < width:
        return h[:0]
    out, w = h, 1
    while 2 * w <= width:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    rest = width - w
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Runs:
    """The windows of a block of documents as runs of equal minimiser: start, number of windows, minimiser, document."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, window: int = WINDOW):
        ends = np.cumsum(sizes)
        self.text = text
        least = least_hashes(text, window - GRAM + 1)
        n = len(least)
        whole = np.maximum(sizes - window + 1, 0)  # windows of each document
        valid = np.repeat(np.tile([True, False], len(sizes)), np.stack((whole, sizes - whole), axis=1).ravel())[:n]
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        begins = ends - sizes
        new[begins[begins < n]] = True
        self.start = np.flatnonzero(new & valid)
        self.owner = np.searchsorted(ends, self.start, side="right")
        after = np.minimum(np.append(self.start[1:], n)[: len(self.start)], (begins + whole)[self.owner])
        # minima crowd at the low end; mixed again they fill all buckets alike
        self.count, self.least = after - self.start, spread(least[self.start])
        by = np.argsort(self.least, kind="stable")
        h, d = self.least[by], self.owner[by]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        fresh = first.copy()
        fresh[1:] |= d[1:] != d[:-1]
        #: the minimisers in order, the number of documents of each, and the place of each run's among them
        self.known = h[first]
        self.docs_of = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(first)) if len(h) else np.zeros(0, np.int64)
        self.place = np.empty(len(h), np.int64)
        self.place[by] = np.cumsum(first) - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The minimisers in order, and the number of documents of each."""
        return self.known, self.docs_of

    def segments(self, shared: np.ndarray, hot: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, windows, routing hash and document of what is compared; hot minimisers' windows one by one."""
        at = self.place
        is_hot = hot[at] if len(at) else np.zeros(0, bool)
        take = shared[at] & ~is_hot if len(at) else is_hot
        starts, counts, keys, owners = [self.start[take]], [self.count[take]], [self.least[take]], [self.owner[take]]
        if is_hot.any():
            n = self.count[is_hot]
            each = np.repeat(self.start[is_hot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            grams = gram_hashes(self.text)
            key = grams[each]
            for off in (GRAM, 2 * GRAM, window - GRAM):
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + grams[each + off]
            starts.append(each), counts.append(np.ones(len(each), np.int64)), keys.append(key), owners.append(np.repeat(self.owner[is_hot], n))
        return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys), np.concatenate(owners)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


class Pieces:
    """The distinct segments of a block in a fixed order: by bucket, then by content."""

    def __init__(self, text: np.ndarray, ids: np.ndarray, segments: tuple, buckets: int, window: int = WINDOW):
        self.start, self.count, key, owner = segments
        raw = text.tobytes()
        bucket = bucket_of(key, buckets)
        place: dict[tuple[int, bytes], int] = {}
        self.which = np.fromiter((place.setdefault((b, raw[s : s + n + window - 1]), len(place)) for b, s, n in zip(bucket.tolist(), self.start.tolist(), self.count.tolist(), strict=True)), np.int64, len(bucket))
        order = sorted(place, key=lambda x: x[0])  # stable
        rank = np.empty(len(place), np.int64)
        rank[[place[x] for x in order]] = np.arange(len(order))
        self.which = rank[self.which] if len(place) else self.which
        self.bucket, self.content = np.array([x[0] for x in order], np.int64), [x[1] for x in order]
        self.least_id = np.full(len(order), np.iinfo(np.int64).max)
        self.ids = ids[owner]
        np.minimum.at(self.least_id, self.which, self.ids)


def slices(parts: np.ndarray, lengths: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """The pieces of a bucket by their parts: of as many parts in turn as `limit` bytes hold, one at least."""
    by = np.argsort(parts, kind="stable")
    size = np.cumsum(np.bincount(parts, lengths, PARTS).astype(np.int64))
    to = np.cumsum(np.bincount(parts, minlength=PARTS))
    part = 0
    while part < PARTS:
        after = max(part + 1, int(np.searchsorted(size, (size[part - 1] if part else 0) + limit, side="right")))
        some = by[to[part - 1] if part else 0 : to[after - 1]]
        part = after
        if len(some):
            yield some


def judge(contents: list[bytes], ids: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of the contents, one after the other: the least id of an equal window; and where each content starts."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    text = np.frombuffer(bytes([GAP]).join(contents) + bytes([GAP]), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(sizes) else sizes
    n_windows = sizes - window + 1
    first = np.concatenate(([0], np.cumsum(n_windows))) if len(sizes) else np.zeros(1, np.int64)
    index = np.full(len(text), -1, np.int64)  # position -> window number
    at = np.repeat(begin - first[:-1], n_windows) + np.arange(first[-1])
    index[at] = np.arange(first[-1])
    words = words_of(text, window)
    order = suffix_array(text, window, words)
    order = order[index[order] >= 0]
    least = np.repeat(ids, n_windows)
    if len(order):
        group = np.concatenate(([True], common_prefixes(text, order, window, words) < window))
        heads = np.flatnonzero(group)
        lows = np.minimum.reduceat(least[index[order]], heads)
        least[index[order]] = np.repeat(lows, np.diff(np.concatenate((heads, [len(order)]))))
    return least, first


# --- passes -------------------------------------------------------------------------------------------------------


def _blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents packed into blocks: block, ids, sizes and zstd-compressed bytes."""
    none = -(2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, number
            row = [number, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), zstandard.compress(b"".join(texts), 1)]
            ids, texts, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict({"block": pa.array([row[0]], pa.int64()), "ids": pa.array([row[1]], pa.binary()), "sizes": pa.array([row[2]], pa.binary()), "body": pa.array([row[3]], pa.binary())})

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(none if (x := i.as_py()) is None else x)
                texts.append(b := t.as_py() or b"")
                size += len(b)
                if size >= block or len(ids) >= 50_000:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, ids binary, sizes binary, body binary")


def _opened(ids: bytes, sizes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), _unpack(body, np.uint8)


def _answers(df: DataFrame, name: str) -> DataFrame:
    """Of each block the answers of the buckets in their order."""
    parts = F.array_sort(F.collect_list(F.struct("bucket", "answer")))
    return df.groupBy("block").agg(F.transform(parts, lambda x: x["answer"]).alias(name))


def _bits(parts: list[bytes] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared and hot, of a block's minimisers in order."""
    if parts is None or not len(parts):
        return np.zeros(n, bool), np.zeros(n, bool)
    marks = np.concatenate([_unpack(p, np.uint8) for p in parts])
    return marks > 0, marks > 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, keep_text: bool = False, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, the kept bytes.

    A null text is an empty one; a null doc_id counts as smaller than all others; rows of equal doc_id never remove each
    other's bytes. Texts shorter than `window` lose nothing; an empty table gives no row; other columns do not matter. Shuffles: 8 bytes for each minimiser (about one in 18
    positions), the blocks twice, compressed, and the distinct repeated stretches.
    """
    spark = docs.sparkSession
    n_buckets = buckets or 4 * shuffle_partitions(spark)
    blocks = stored(_blocks(docs, block), "blocks")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                _, sizes, text = _opened(row.ids, row.sizes, row.body)
                known, docs_of = Runs(text, sizes, window).distinct()
                cut = np.searchsorted(bucket_of(known, n_buckets), np.arange(n_buckets + 1))
                out = [(k, row.block, known[s:e].tobytes(), _pack(np.minimum(docs_of[s:e], 255).astype(np.uint8))) for k, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if e > s]
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "block", "hashes", "counts"])

    def count(b: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, np.uint64) for x in b["hashes"]]
        distinct, back = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(back, np.concatenate([_unpack(x, np.uint8) for x in b["counts"]]), len(distinct))
        marks = ((total > 1) * 1 + (total > hot) * 1).astype(np.uint8)[back]
        parts = np.split(marks, np.cumsum([len(x) for x in each])[:-1])
        return pd.DataFrame({"block": b["block"], "bucket": b["bucket"], "answer": [_pack(p) for p in parts]})

    sent = blocks.mapInPandas(send, "bucket long, block long, hashes binary, counts binary")
    marks = stored(_answers(sent.groupBy("bucket").applyInPandas(count, "block long, bucket long, answer binary"), "marks"), "marks")
    del sent
    release(spark)
    marked = blocks.join(marks, "block", "left")

    def pieces(row) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, text = _opened(row.ids, row.sizes, row.body)
        runs = Runs(text, sizes, window)
        shared, common = _bits(row.marks, len(runs.known))
        return Pieces(text, ids, runs.segments(shared, common, window), n_buckets * PARTS, window), ids, sizes, text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                p = pieces(row)[0]
                at = np.searchsorted(p.bucket, np.arange(n_buckets + 1) * PARTS)
                out = []
                for k in np.unique(p.bucket // PARTS).tolist():
                    s, e = at[k], at[k + 1]
                    lengths = np.fromiter(map(len, p.content[s:e]), np.int64, e - s)
                    parts = (p.bucket[s:e] % PARTS).astype(np.uint8)
                    out.append((k, row.block, zstandard.compress(b"".join(p.content[s:e]), 3), _pack(lengths), _pack(p.least_id[s:e]), _pack(parts)))
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "block", "contents", "lengths", "ids", "parts"])

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        lengths, ids = (np.concatenate([_unpack(x, np.int64) for x in b[c]]) for c in ("lengths", "ids"))
        parts = [_unpack(x, np.uint8) for x in b["parts"]]
        rows = np.cumsum([len(x) for x in parts])
        parts = np.concatenate(parts)
        bodies = b"".join(map(zstandard.decompress, b["contents"]))
        ends, answer = np.cumsum(lengths), np.cumsum(lengths - window + 1)
        lows = np.empty(answer[-1], np.int64)
        for some in slices(parts, lengths, PART):
            place: dict[bytes, int] = {}
            which = np.fromiter((place.setdefault(bodies[x - n : x], len(place)) for x, n in zip(ends[some].tolist(), lengths[some].tolist(), strict=True)), np.int64, len(some))
            least_id = np.full(len(place), np.iinfo(np.int64).max)
            np.minimum.at(least_id, which, ids[some])
            least, first = judge(list(place), least_id, window)
            n = lengths[some] - window + 1
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            lows[np.repeat(answer[some] - n, n) + inner] = least[np.repeat(first[which], n) + inner]
        cuts = np.concatenate(([0], answer[rows - 1]))
        answers = [_pack(lows[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"block": b["block"], "bucket": b["bucket"], "answer": answers})

    stretches = marked.mapInPandas(cut, "bucket long, block long, contents binary, lengths binary, ids binary, parts binary")
    lows = stored(_answers(stretches.groupBy("bucket").applyInPandas(compare, "block long, bucket long, answer binary"), "lows"), "lows")
    del stretches
    release(spark)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                p, ids, sizes, text = pieces(row)
                gone = np.zeros(len(text) + 1, np.int64)
                if len(p.which):
                    low = np.concatenate([_unpack(x, np.int64) for x in row.lows])
                    n = np.fromiter((len(c) - window + 1 for c in p.content), np.int64, len(p.content))
                    first = np.concatenate(([0], np.cumsum(n)[:-1]))
                    shift = np.cumsum(p.count) - p.count
                    inner = np.arange(p.count.sum()) - np.repeat(shift, p.count)
                    bad = low[np.repeat(first[p.which], p.count) + inner] < np.repeat(p.ids, p.count)
                    at = (np.repeat(p.start, p.count) + inner)[bad]
                    gone += np.bincount(at, minlength=len(gone)) - np.bincount(at + window, minlength=len(gone))
                covered = np.cumsum(gone)[:-1] > 0
                ends = np.cumsum(sizes)
                begins = covered.copy()
                begins[1:] &= ~covered[:-1]
                starts = (ends - sizes)[sizes > 0]
                begins[starts] = covered[starts]
                removed, spans = np.concatenate(([0], np.cumsum(covered))), np.concatenate(([0], np.cumsum(begins)))
                out = []
                for i, s, e in zip(ids.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                    kept = text[s:e][~covered[s:e]].tobytes()
                    out.append((None if i == -(2**63) else i, e - s, int(removed[e] - removed[s]), int(spans[e] - spans[s]), hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
                got = pd.DataFrame(out, columns=names)
                yield got.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return marked.join(lows, "block", "left").mapInPandas(drop, schema)
