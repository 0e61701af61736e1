"""Two tokenizers aligned by byte offsets, and how often their tokens meet in the whole corpus.

Each text is encoded by a byte-level vocabulary (A) and by one of pieces (B). The ends of both, merged, cut the text into
elementary intervals; in each lies one overlap of a token of A with one of B. Ends that both have close the groups. A block of
texts gives its distinct pairs of ids with the number of its texts that hold them; the counts of all blocks are added up by
pair and come back to each block once, so texts are read and encoded once and what is shuffled are distinct pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BytePairs
from .common import chunks, lean, stored

#: Characters of the texts whose pairs are counted together; one longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: A longer text is encoded in slices of about so many characters, cut where neither vocabulary can have a token across.
SLICE_CHARS = 1_000_000
#: Distinct words that a worker remembers of each vocabulary.
MEMORY_WORDS = 200_000
BLANK = "▁"
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")


class PlainBytes(BytePairs):
    """The byte-level vocabulary without special tokens: their strings are text like any other."""

    def __init__(self, path: str):
        super().__init__(path)
        self.split, self.numbers = None, {}
        self.starts, self.tokens = np.arange(1), np.zeros(0, np.int32)


class Pieces(BytePairs):
    """A vocabulary of pieces with the same memory of words. A word is a run of blanks and what follows up to the next
    blank: where no piece has a blank after another character, no token reaches over words, so words are encoded apart;
    with any other vocabulary the whole text is one word."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.piece = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in names)
        self.blank = self.model.piece_to_id(BLANK)
        apart = apart and self.blank != self.model.unk_id() and "".join(self.model.encode("  a  b ", out_type=str)) == "   a  b ".replace(" ", BLANK)
        self.words = re.compile(r" +[^ ]*" if apart else r"(?s).+")
        self.numbers: dict[str, int] = {}
        self.starts, self.tokens = np.arange(1), np.zeros(0, np.int32)

    def pieces(self, text: str) -> list[str]:
        return self.words.findall(text)

    def learn(self, words: list[str]) -> None:
        base = len(self.starts) - 1
        found = self.model.encode([w[1:] for w in words]) if words else []  # the model adds the first blank itself, but not to nothing
        found = [[self.blank] if w == " " else x for w, x in zip(words, found, strict=True)]
        self.numbers.update(zip(words, range(base, base + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)))
        self.tokens = np.concatenate((self.tokens, np.fromiter((t for x in found for t in x), np.int32)))


class Links(NamedTuple):
    """A text's numbers of tokens, groups and links, its groups as written, its distinct pairs (code of both ids, ascending)
    and how often the text has each."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: list[bytes]
    codes: np.ndarray
    times: np.ndarray


class Aligner:
    """Both vocabularies; aligns texts in runs."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PlainBytes(a_path), Pieces(b_path)
        self.sizes = [np.fromiter(map(len, v.piece), np.int64, len(v.piece)) for v in (self.a, self.b)]
        self.width = len(self.b.piece)
        self.codes = len(self.a.piece) * self.width
        #: Each id as written before a separator: first A's ids before a comma and a bar, then B's before a comma and a semicolon.
        written = [f"{i}{end}".encode() for v, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(len(v.piece)) for end in ends]
        self.written = np.array(written).view(np.uint8).reshape(len(written), -1)
        self.written_sizes = np.fromiter(map(len, written), np.int64, len(written))

    def encode(self, texts: list[str], most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text (with its first blank) in A and B; none of both where the bytes of either are not the text's."""
        a, b = self.a.encode_texts(texts, most), self.b.encode_texts(texts, most)
        none = np.zeros(0, np.int32)
        for i, t in enumerate(texts):
            body = t.encode("utf-8", "surrogatepass")
            if t == " " or any(b"".join(map(v.piece.__getitem__, ids.tolist())) != body for v, ids in ((self.a, a[i]), (self.b, b[i]))):
                a[i] = b[i] = none
        return a, b

    def intervals(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of ids of texts one after the other: both arrays of ends, the merged ends, and the owner in A and in B of the interval
        before each."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ends = np.union1d(ends_a, ends_b)
        return ends_a, ends_b, ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)

    def run(self, texts: list[str], most: int = MEMORY_WORDS) -> list[Links]:
        """Links of texts that begin with a blank."""
        of_a, of_b = self.encode(texts, most)
        a, b = np.concatenate(of_a).astype(np.int64), np.concatenate(of_b).astype(np.int64)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        ends_a, ends_b, ends, own_a, own_b = self.intervals(a, b)
        shared = ends[(ends_a[own_a] == ends) & (ends_b[own_b] == ends)] if len(ends) else ends
        # texts end where the ends of their last tokens are; a text without tokens ends where the one before it does
        stops = np.concatenate(([0], ends_a))[np.cumsum(n_a)]
        text = np.searchsorted(stops, ends)
        n_links = np.bincount(text, minlength=len(texts))
        n_groups = np.bincount(np.searchsorted(stops, shared), minlength=len(texts))
        pairs, times = np.unique(text * self.codes + a[own_a] * self.width + b[own_b], return_counts=True)
        at = np.searchsorted(pairs, np.arange(len(texts) + 1) * self.codes)
        flat, cuts = self._written(a, b, ends_a, ends_b, shared)
        cuts = cuts[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        return [
            Links(int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), [flat[cuts[i] : cuts[i + 1]].tobytes()], pairs[at[i] : at[i + 1]] - i * self.codes, times[at[i] : at[i + 1]])
            for i in range(len(texts))
        ]

    def _written(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups as written, one after the other, and where each token begins (in the order as written)."""
        in_a, in_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        until_a, until_b = np.searchsorted(ends_a, shared, "right"), np.concatenate(([0], np.searchsorted(ends_b, shared, "right")))
        rows = np.empty(len(a) + len(b), np.int64)
        rows[np.arange(len(a)) + until_b[in_a]] = 2 * a + (shared[in_a] == ends_a) if len(a) else 0
        rows[np.arange(len(b)) + (until_a[in_b] if len(b) else 0)] = 2 * (len(self.a.piece) + b) + (shared[in_b] == ends_b) if len(b) else 0
        cells = self.written[rows]
        return cells[cells > 0], np.concatenate(([0], np.cumsum(self.written_sizes[rows])))

    def texts(self, texts: list[str], most: int = MEMORY_WORDS) -> Iterator[Links]:
        """Links of each text, long ones slice by slice."""
        for low, high in chunks(texts, SLICE_CHARS):
            part = [f" {t}" for t in texts[low:high]]
            if len(part) > 1 or len(part[0]) <= SLICE_CHARS:
                yield from self.run(part, most)
            else:
                yield self.long(part[0], most)

    def long(self, text: str, most: int) -> Links:
        found = [self.run([s], most)[0] for s in slices(text)]
        if any(not x.n_a for x in found):  # a slice whose bytes are not the text's
            return self.run([" "], most)[0]
        codes, place = np.unique(np.concatenate([x.codes for x in found]), return_inverse=True)
        times = np.bincount(place, np.concatenate([x.times for x in found])).astype(np.int64)
        return Links(*(sum(x[i] for x in found) for i in range(4)), [g for x in found for g in x.groups], codes, times)


def slices(text: str) -> Iterator[str]:
    """Parts of a text, cut before a blank between a character that is no space and a letter: words of both vocabularies
    begin there."""
    low = 0
    while m := _CUT.search(text, low + SLICE_CHARS):
        yield text[low : m.start()]
        low = m.start()
    yield text[low:]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold the greatest; the first byte says how many those are."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.dtype(f"u{x[0]}"), offset=1).astype(np.int64)


_PER_TEXT = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs"]


def _blocks(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, most: int) -> DataFrame:
    """A row for each block of texts: block, keys and the columns _PER_TEXT (arrays, a value for each text), pairs and held
    (distinct codes and the number of texts with each), at and times (of each text's pairs the place in `pairs` and the
    number of occurrences)."""
    field = docs.select(F.col(key).alias("key")).schema[0]
    kind = field.dataType.simpleString()

    def block(number: int, keys: list, kind: pa.DataType, found: list[Links], shas: list[str]) -> pa.RecordBatch:
        codes = np.concatenate([x.codes for x in found])
        pairs, at, held = np.unique(codes, return_inverse=True, return_counts=True)
        sizes = np.array([len(x.codes) for x in found])
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        near = np.diff(at, prepend=0)
        near[firsts] = at[firsts]
        per_text = [[x.n_a for x in found], [x.n_b for x in found], [x.n_groups for x in found], [x.n_links for x in found], shas, sizes.tolist()]
        packed = [_packed(np.diff(pairs, prepend=0)), _packed(held), _packed(near), _packed(np.concatenate([x.times for x in found]))]
        columns = [pa.array([number]), pa.array([keys], pa.list_(kind)), *[pa.array([x]) for x in per_text], *[pa.array([x], pa.binary()) for x in packed]]
        return pa.RecordBatch.from_arrays(columns, names=["block", "keys", *_PER_TEXT, "pairs", "held", "at", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        keys, found, shas, size, kind = [], [], [], 0, pa.null()
        for batch in batches:
            texts, kind = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).type
            for k, t, links in zip(batch.column(0).to_pylist(), texts, both.texts(texts, most), strict=True):
                if found and size + len(t) > BLOCK_CHARS:
                    yield block(number, keys, kind, found, shas)
                    keys, found, shas, size, number = [], [], [], 0, number + 1
                keys.append(k)
                shas.append(hashlib.sha256(b"".join(links.groups)[:-1]).hexdigest() if links.n_a else "")
                found.append(links._replace(groups=[]))  # the groups as written take more than the text
                size += len(t)
        if found:
            yield block(number, keys, kind, found, shas)
        both.a.forget(most // 4)
        both.b.forget(most // 4)

    schema = f"block long, keys array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, pairs binary, held binary, at binary, times binary"
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)


def _pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): each distinct pair of each block and the number of the block's texts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, n = np.cumsum(_unpacked(pairs)), _unpacked(held)
                for at in range(0, len(codes), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[part]), number)), pa.array(codes[part]), pa.array(n[part])], names=["block", "pair", "n"])

    return blocks.select("block", "pairs", "held").mapInArrow(lean(run), "block long, pair long, n long")


def _counted(pairs: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many texts each pair is, and whether no other pair of its A id is in more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """One row per row of docs: key, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair of ids is in as many
    texts as any pair of its A id), count_sum (texts that hold a link's pair, over all links), groups_sha256.

    Texts are encoded with a blank before them. A null or empty text, and one whose bytes either vocabulary does not give back
    (such as one with U+2581), has no tokens: zeros and an empty string. Repeated rows are texts of their own in all
    counts; a null key stays null; other columns do not matter. An empty table gives no row. A text of any length is encoded
    in slices; a block's distinct pairs are bounded by its texts and by both vocabularies together.
    """
    blocks = stored(_blocks(docs, a_path, b_path, key, text, memory_words), "aligned", "zstd")
    pairs = _pairs(blocks)
    counted = _counted(pairs, aligner(a_path, b_path).width)
    back = pairs.select("block", "pair").join(counted, "pair")
    seen = back.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("seen"))
    seen = seen.select("block", F.col("seen.n").alias("counts"), F.col("seen.best").alias("bests"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                of = lambda name: batch.column(names.index(name))[i]  # noqa: B023, E731
                sizes = np.array(of("n_pairs").as_py(), np.int64)
                places, times = np.cumsum(_unpacked(of("at").as_py())), _unpacked(of("times").as_py())
                starts = np.cumsum(sizes) - sizes
                places -= np.repeat(np.concatenate(([0], places))[starts], sizes)
                sums = []
                for name in ("bests", "counts"):
                    values = of(name).values
                    values = np.zeros(0, np.int64) if values is None else values.to_numpy(zero_copy_only=False).astype(np.int64)
                    running = np.concatenate(([0], np.cumsum(times * values[places])))
                    sums.append(running[starts + sizes] - running[starts])
                columns = [of("keys").values, *[of(c).values for c in _PER_TEXT[:4]], *[pa.array(s, pa.int64()) for s in sums], of("groups_sha256").values]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    whole = blocks.drop("pairs", "held").join(seen, "block", "left")
    return whole.mapInArrow(lean(run), f"{key} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, documents, best) of all pairs of ids that some text links: a table of how one vocabulary says the other."""
    width = aligner(a_path, b_path).width
    counted = _counted(_pairs(stored(_blocks(docs, a_path, b_path, key, text, MEMORY_WORDS), "aligned", "zstd")), width)
    return counted.select(F.floor(F.col("pair") / width).alias("a_id"), (F.col("pair") % width).alias("b_id"), F.col("n").alias("documents"), "best")


def groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, start, end, a_ids, b_ids): each text's groups in order, with their bytes in the text (its added blank is
    byte 0). Texts without tokens give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts = [both.encode([s], MEMORY_WORDS) for s in slices(f" {t or ''}")]
                if any(not len(x[0]) for x, _ in parts):
                    continue
                a, b = (np.concatenate([p[i][0] for p in parts]).astype(np.int64) for i in (0, 1))
                ends_a, ends_b, ends, own_a, own_b = both.intervals(a, b)
                shared = ends[(ends_a[own_a] == ends) & (ends_b[own_b] == ends)]
                lists = [pa.ListArray.from_arrays(np.concatenate(([0], np.searchsorted(e, shared, "right"))).astype(np.int32), pa.array(x)) for e, x in ((ends_a, a), (ends_b, b))]
                keys = pa.array([k.as_py()] * len(shared), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(len(shared))), pa.array(np.concatenate(([0], shared[:-1]))), pa.array(shared), *lists], names=[key, "at", "start", "end", "a_ids", "b_ids"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"{key} {kind}, at long, start long, end long, a_ids array<long>, b_ids array<long>")


def products(found: DataFrame) -> DataFrame:
    """groups() expanded: a row for each token of A with each of B of the same group. Where one side has one token these are
    the links; in other groups they are more than the overlaps."""
    return found.withColumn("a_id", F.explode("a_ids")).withColumn("b_id", F.explode("b_ids")).drop("a_ids", "b_ids")
