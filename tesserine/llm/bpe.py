"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of each distinct word; a vectorised check then asks of every adjacent pair of
proposed tokens whether BPE itself would ever leave that boundary standing; only the words with a failing pair are merged
exactly. An encoding all of whose adjacent pairs are compatible is the BPE encoding, so the result is exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean

WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of the first 256 characters, with their letters, numbers and blanks written out (several times faster).
LATIN_WORD = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format(L="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", N="0-9\xb2\xb3\xb9\xbc-\xbe", S="\t-\r \x85\xa0")
#: Distinct words that a worker remembers (the first ones, so most frequent words are among them); others are encoded anew.
MEMORY_WORDS = 400_000
#: Words of at most so many bytes are merged side by side.
SHORT = 32


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class BytePairs:
    """One vocabulary: encodes and decodes; keeps the words that it has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        as_bytes = lambda piece: bytes(to_byte[c] for c in piece)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in self.specials}
        self.vocab = vocab
        size = max(max(vocab.values()), *self.specials.values(), 0) + 1
        self.piece = [b""] * size
        for k, v in vocab.items():
            self.piece[v] = k
        for k, v in self.specials.items():
            self.piece[v] = k.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        #: Of each token: its rank (its own merge's place, -1 for bytes) and the halves of that merge.
        self.token_rank = np.full(size, -1, np.int64)
        self.made = np.zeros(len(pairs), np.int32)
        self.left, self.right = np.arange(size), np.arange(size)
        for place, (a, b) in enumerate(pairs):
            x, y = vocab[as_bytes(a)], vocab[as_bytes(b)]
            self.rank.setdefault((x, y), place)
            self.made[place] = made = vocab[as_bytes(a) + as_bytes(b)]
            if self.token_rank[made] < 0:
                self.token_rank[made], self.left[made], self.right[made] = place, x, y
        keys = np.fromiter((x << 32 | y for x, y in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.pair_keys, self.pair_places = keys[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]
        self.split = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        self.words, self.latin = regex.compile(WORD), re.compile(LATIN_WORD)
        #: Tokens that BPE itself would not make of their own bytes: no proposal may hold them.
        self.odd = {t for k, t in vocab.items() if len(k) > 1 and self.token_rank[t] < 0}
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in vocab.items():
            if t not in self.odd:
                self.search.add_word(k.decode("latin-1"), t)
        self.search.make_automaton()
        self.of_byte = np.fromiter((vocab[bytes([b])] for b in range(256)), np.int32, 256)
        self.printed = [str(i) for i in range(size)]
        #: Numbers of the known words, special tokens first; the tokens of word i are tokens[starts[i] : starts[i + 1]].
        self.numbers: dict[str, int] = {w: i for i, w in enumerate(self.specials)}
        self.starts = np.arange(len(self.specials) + 1)
        self.tokens = np.fromiter(self.specials.values(), np.int32, len(self.specials))

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: the tokens one after the other, and the word that each is of.

        words: their bytes as characters. The search runs over the words joined by a character that no token has.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = list(self.search.iter_long("\u0100".join(words)))
        ends, tokens = np.array(found, np.int64).reshape(-1, 2).T
        starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return tokens, np.searchsorted(starts, ends, side="right")

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the merge of each pair (a, b), or a number beyond all places."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_places[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the boundary between each a and b: replays both tokens' merges backwards, latest first.

        At each step the pair at the boundary is the last piece of a's side and the first of b's; a merge of them would
        have won over the later of the two merges that are about to be undone if its place is earlier.
        """
        x, y = a.copy(), b.copy()
        until = np.full(len(a), np.iinfo(np.int64).max)  # the place of the merge that was undone last
        by_left = np.zeros(len(a), bool)  # that merge stood left of the boundary; on equal places the left one goes first
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            xs, ys = x[open_], y[open_]
            place, last = self.places(xs, ys), until[open_]
            rx, ry = self.token_rank[xs], self.token_rank[ys]
            # the boundary's merge happens before `last` does; on equal places the leftmost of the two goes first
            bad = (place < last) | ((place == last) & ~by_left[open_] & (place < np.iinfo(np.int64).max))
            good[open_[bad]] = False
            undo_x = rx > ry  # of equal merges the left one came first, so the right one is undone first
            done = (rx < 0) & (ry < 0)
            go = ~bad & ~done
            left_go, right_go = open_[go & undo_x], open_[go & ~undo_x]
            until[left_go], by_left[left_go] = self.token_rank[x[left_go]], True
            x[left_go] = self.right[x[left_go]]
            until[right_go], by_left[right_go] = self.token_rank[y[right_go]], False
            y[right_go] = self.left[y[right_go]]
            open_ = open_[go]
        return good

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE: the earliest merge first, leftmost on ties. A heap of live pairs keeps long words near-linear."""
        import heapq

        ids = [self.vocab[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.vocab[self.piece[a] + self.piece[b]], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := self.rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := self.rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def merged_short(self, words: list[str]) -> list[list[int]]:
        """The same for many short words at once: each round does every word's next merge."""
        n, width = len(words), max(map(len, words))
        none = np.iinfo(np.int32).max
        ids = np.full((n, width + 2), -1, np.int32)
        sizes = np.fromiter(map(len, words), np.int64, n)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[row, column] = self.of_byte[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
        ranks = np.full((n, width + 1), none, np.int32)
        y, x = np.nonzero(ids[:, 1:] >= 0)
        ranks[y, x] = np.minimum(self.places(ids[y, x], ids[y, x + 1]), none)
        columns, live = np.arange(width + 2), np.arange(n)
        out = ids.copy()
        while len(live):
            at = ranks.argmin(1)
            rows = np.arange(len(live))
            best = ranks[rows, at]
            go = best < none
            if not go.all():
                out[live[~go]] = ids[~go]
                live, ids, ranks, at, best = live[go], ids[go], ranks[go], at[go], best[go]
                rows = np.arange(len(live))
            if not len(live):
                break
            ids[rows, at] = self.made[best]
            beyond = columns[:-1] > at[:, None]
            ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(beyond[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            for left in (at, at - 1):
                y = np.flatnonzero(left >= 0)
                a, b = ids[y, left[y]], ids[y, left[y] + 1]
                ranks[y, left[y]] = np.where(b >= 0, np.minimum(self.places(a, b), none), none)
        return [r[: int(k)].tolist() for r, k in zip(out, (out >= 0).sum(1), strict=True)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words one after the other, their number for each word, and how many words needed exact merging.

        words: their bytes as characters.
        """
        flat, owner = self.propose(words)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        bad = np.zeros(len(words), bool)
        bad[owner[inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        failing = np.flatnonzero(bad).tolist()
        sizes = np.bincount(owner, minlength=len(words))
        if not failing:
            return flat, sizes, 0
        exact: dict[int, list[int]] = {}
        failing.sort(key=lambda i: len(words[i]))
        for at in range(0, len(failing), 20_000):
            part = failing[at : at + 20_000]
            short = [i for i in part if len(words[i]) <= SHORT]
            if short:
                exact.update(zip(short, self.merged_short([words[i] for i in short]), strict=True))
            exact.update((i, self.merged(words[i].encode("latin-1"))) for i in part[len(short) :])
        failing.sort()
        new_sizes = sizes.copy()
        new_sizes[failing] = [len(exact[i]) for i in failing]
        out = np.empty(int(new_sizes.sum()), np.int64)
        to = np.repeat(bad, new_sizes)
        out[to] = np.fromiter((t for i in failing for t in exact[i]), np.int64, int(to.sum()))
        out[~to] = flat[~bad[owner]]
        return out, new_sizes, len(failing)

    def learn(self, words: list[str]) -> None:
        """Gives each of these new words a number and keeps its tokens."""
        base = len(self.starts) - 1
        flat, sizes, _ = self.encode_words([w.encode("utf-8", "surrogatepass").decode("latin-1") for w in words])
        self.numbers.update(zip(words, range(base, base + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.tokens = np.concatenate((self.tokens, flat.astype(np.int32)))

    def forget(self, most: int) -> None:
        """Keeps the first `most` words alone."""
        if len(self.starts) - 1 > most:
            for w in list(islice(self.numbers, most, None)):
                del self.numbers[w]
            self.starts = self.starts[: most + 1].copy()
            self.tokens = self.tokens[: self.starts[-1]].copy()

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as they are."""
        words = self.latin if text.isascii() or max(text) < "\u0100" else self.words
        out, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            out += words.findall(text, at, m.start())
            out.append(m.group())
            at = m.end()
        return out + words.findall(text, at) if at else words.findall(text)

    def encode_texts(self, texts: list[str], most: int = MEMORY_WORDS) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.pieces(t) for t in texts]
        numbered = [np.fromiter(map(self.numbers.get, ws, repeat(-1)), np.int64, len(ws)) for ws in split]
        missed = [np.flatnonzero(at < 0) for at in numbered]
        self.learn(list({ws[i] for ws, new in zip(split, missed, strict=True) for i in new.tolist()}))
        out = []
        for ws, at, new in zip(split, numbered, missed, strict=True):
            at[new] = [self.numbers[ws[i]] for i in new.tolist()]
            low = self.starts[at]
            n = self.starts[at + 1] - low
            ends = np.cumsum(n)
            out.append(self.tokens[np.repeat(low - ends + n, n) + np.arange(ends[-1] if len(n) else 0)])
        self.forget(most)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.piece[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    return BytePairs(path)


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False, text: str = "text", key: str = "doc_id", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """Tokens of every whole text, and the text decoded again.

    One row per row of `docs` (repeated rows too): key, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded text), lossless (decoded equals the text), and with keep_ids the ids. A null text is an
    empty one: no tokens, the digest of the empty string; a null key stays null; an empty table gives no row. A special
    token's string in a text is that token. Narrow: no shuffle; a worker holds a run of texts (CHUNK_CHARS, or one longer
    text) and memory_words words.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        printed, piece = bpe.printed.__getitem__, bpe.piece.__getitem__
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            for low, high in chunks(all_texts):
                texts = all_texts[low:high]
                out: list[list] = [[] for _ in fields]
                for t, found in zip(texts, bpe.encode_texts([t or "" for t in texts], memory_words), strict=True):
                    ids = found.tolist()
                    decoded = b"".join(map(piece, ids)).decode("utf-8", "replace")
                    row = [len(ids), hashlib.sha256(",".join(map(printed, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(), decoded == (t or "")]
                    for column, v in zip(out, row + [ids] * keep_ids, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(c, f[1]) for c, f in zip(out, fields, strict=True))], names=[key, *(f[0] for f in fields)])

        bpe.forget(memory_words // 4)

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)
