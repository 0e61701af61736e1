"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of one fixed public vocabulary. The probability of a word is the sum, over all
ways to cut it into pieces, of the product of their probabilities (the forward algorithm); a text's is the product over its
words. Training maximises just that by EM on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice, repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, lean, least_hashes, safe_text, unused

#: Documents of each language that training reads at most (those with the least hash of doc_id), whole.
FIT_DOCS, ROUNDS = 400, 3
#: Words up to this length are scored side by side, longer ones one by one with running logarithms.
SIDE_BY_SIDE = 40
#: What a probability is multiplied by for each character, so that products stay within a double's range.
SCALE = 16.0
#: Distinct words that a worker remembers (the first ones).
MEMORY_WORDS = 120_000
#: Runs of letters and of numbers that are no decimal digits (superscripts, fractions, Roman and circled numerals), which `\w`
#: has too; runs() takes those out.
RUNS = re.compile(r"[^\W\d_]+")


def runs(text: str) -> list[str]:
    """Runs of letters of a text."""
    found = RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def vocabulary(path: str) -> dict[str, int]:
    """The pieces of a public sentencepiece model, lower case; the mark of a word's start is a space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            pieces.setdefault(sp.id_to_piece(i).replace("▁", " ").lower(), len(pieces))
    return pieces


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    return runs((text or "").lower())


class Pieces:
    """A vocabulary, searched for all pieces at all places of a word at once."""

    def __init__(self, numbers: dict[str, int]):
        self.unknown = len(numbers)
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.size = np.ones(len(numbers) + 1, np.int64)
        for piece, i in numbers.items():
            self.size[i] = len(piece)
            if piece:
                self.search.add_word(piece, i)
        self.search.make_automaton()
        self.found = self.search.iter if numbers else lambda _: ()
        self.longest = int(self.size.max())

    def edges(self, word: str) -> Iterator[tuple[list[int], np.ndarray]]:
        """Of each place in a word: the pieces that end there, and their sizes; any character is a piece of its own."""
        found, size, unknown = iter(self.found(word)), self.size, self.unknown
        ahead = next(found, None)
        for end in range(len(word)):
            own = []
            while ahead is not None and ahead[0] == end:
                own.append(ahead[1])
                ahead = next(found, None)
            if not own or size[own].min() > 1:
                own.append(unknown)
            yield own, size[own]

    def long_log_probability(self, word: str, log_p: np.ndarray) -> np.ndarray:
        """[languages] of one word of any length: only the last `longest` sums are held. log_p: [piece, languages]."""
        ring = np.zeros((self.longest + 1, log_p.shape[1]))
        end = 0
        for end, (own, sizes) in enumerate(self.edges(word), 1):
            ring[end % len(ring)] = np.logaddexp.reduce(ring[(end - sizes) % len(ring)] + log_p[own], 0)
        return ring[end % len(ring)].copy()

    def long_expected(self, word: str, log_p: np.ndarray, count: float, uses: np.ndarray) -> None:
        """Adds the expected number of uses of each piece in one word. log_p: [piece]."""
        edges = list(self.edges(word))
        alpha, beta = np.zeros(len(word) + 1), np.full(len(word) + 1, -np.inf)
        for end, (own, sizes) in enumerate(edges, 1):
            alpha[end] = np.logaddexp.reduce(alpha[end - sizes] + log_p[own])
        beta[-1] = 0
        for end in range(len(word), 0, -1):
            own, sizes = edges[end - 1]
            flow = log_p[own] + beta[end]
            np.add.at(uses, own, count * np.exp(alpha[end - sizes] + flow - alpha[-1]))
            beta[end - sizes] = np.logaddexp(beta[end - sizes], flow)


class Lattice:
    """All segmentations of some words: an edge for each piece that fits, by where it ends."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.n = len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, self.n)
        ends, piece = np.array(list(pieces.found("\0".join(words))), np.int64).reshape(-1, 2).T
        starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        size = pieces.size[piece]
        # characters that are no piece by themselves are unknown ones
        single = np.zeros(int(self.lengths.sum()) + self.n, bool)
        single[ends[size == 1]] = True
        single[starts + self.lengths] = True
        lone = np.flatnonzero(~single)
        ends, piece = np.concatenate((ends, lone)), np.concatenate((piece, np.full(len(lone), pieces.unknown)))
        word = np.searchsorted(starts, ends, side="right") - 1
        to = ends - starts[word] + 1
        by = np.lexsort((word, to))
        word, to, piece = word[by], to[by], piece[by]
        size = pieces.size[piece]
        bounds = np.flatnonzero(np.diff(to, prepend=0, append=self.lengths.max(initial=0) + 1))
        #: (end, distinct words, where each one's edges begin, words, starts, pieces, sizes) by end.
        self.edges = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = word[a:b]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            self.edges.append((int(to[a]), own[first], first, own, to[a:b] - size[a:b], piece[a:b], SCALE ** size[a:b].astype(float)))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """[n, longest + 1, languages] sums over all segmentations of each word's beginnings, scaled by SCALE a character.

        p: [piece, languages].
        """
        alpha = np.zeros((self.n, int(self.lengths.max(initial=0)) + 1, p.shape[1]))
        alpha[:, 0] = 1
        for e, distinct, first, word, start, piece, scale in self.edges:
            alpha[distinct, e] = np.add.reduceat(alpha[word, start] * p[piece] * scale[:, None], first, axis=0)
        return alpha

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        """[n, languages]"""
        alpha = self.forward(p)
        return np.log(np.maximum(alpha[np.arange(self.n), self.lengths], 1e-290)) - (self.lengths * np.log(SCALE))[:, None]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, words weighted by counts. p: [piece]."""
        alpha = self.forward(p[:, None])[:, :, 0]
        whole = np.maximum(alpha[np.arange(self.n), self.lengths], 1e-290)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.lengths] = counts / whole
        uses = np.zeros(len(p))
        for e, _, _, word, start, piece, scale in reversed(self.edges):
            flow = p[piece] * scale * beta[word, e]
            np.add.at(beta, (word, start), flow)
            uses += np.bincount(piece, alpha[word, start] * flow, len(p))
        return uses


@dataclass
class Model:
    languages: list[str]
    numbers: dict[str, int]  # of the pieces
    probabilities: np.ndarray  # [language, piece]; the last piece is any unknown character

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "by_piece")}

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(self.numbers)

    @cached_property
    def by_piece(self) -> np.ndarray:
        return np.ascontiguousarray(self.probabilities.T)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language] log probabilities of words, each with the mark of its start."""
        out = np.empty((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) < SIDE_BY_SIDE]
        for at in range(0, len(short), 4_000):
            part = short[at : at + 4_000]
            out[part] = Lattice([" " + words[i] for i in part], self.pieces).log_probability(self.by_piece)
        if len(short) < len(words):
            logs = np.log(self.by_piece)
            for i, w in enumerate(words):
                if len(w) >= SIDE_BY_SIDE:
                    out[i] = self.pieces.long_log_probability(" " + w, logs)
        return out

    def text_scores(self, texts: list[str | None], most: int = MEMORY_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] log probabilities, and the number of words of each text."""
        split = [words_of(t) for t in texts]
        if not self.languages:
            return np.zeros((len(texts), 0)), np.fromiter(map(len, split), np.int64, len(split))
        numbered = [np.fromiter(map(self.known.get, ws, repeat(-1)), np.int64, len(ws)) for ws in split]
        missed = [np.flatnonzero(at < 0) for at in numbered]
        new = list({ws[i] for ws, m in zip(split, missed, strict=True) for i in m.tolist()})
        if new:
            base = len(self.table)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self.table = np.concatenate((self.table, self.word_scores(new)))
        out = np.zeros((len(texts), len(self.languages)))
        for i, (ws, at, m) in enumerate(zip(split, numbered, missed, strict=True)):
            at[m] = [self.known[ws[j]] for j in m.tolist()]
            out[i] = self.table[at].sum(0)
        self.forget(most)
        return out, np.fromiter(map(len, split), np.int64, len(split))

    def forget(self, most: int) -> None:
        """Keeps the first `most` words alone."""
        if len(self.table) > most:
            for w in list(islice(self.known, most, None)):
                del self.known[w]
            self.table = self.table[:most].copy()


def fit(counts: dict[str, dict[str, int]], numbers: dict[str, int], rounds: int = ROUNDS, smooth: float = 0.1) -> Model:
    """counts: of each language the words' counts. Deterministic; smoothed so that no piece has probability 0."""
    out, pieces = [], Pieces(numbers)
    for lang in sorted(counts):
        words = sorted(counts[lang])
        short = [w for w in words if len(w) < SIDE_BY_SIDE]
        parts = [short[i : i + 20_000] for i in range(0, len(short), 20_000)]
        lattices = [(Lattice([" " + w for w in part], pieces), np.array([counts[lang][w] for w in part], float)) for part in parts]
        p = np.full(len(numbers) + 1, 1.0 / (len(numbers) + 1))
        for _ in range(rounds):
            uses = np.full(len(p), smooth)
            for lattice, weights in lattices:
                uses += lattice.expected(p, weights)
            for w in words:
                if len(w) >= SIDE_BY_SIDE:
                    pieces.long_expected(" " + w, np.log(p), counts[lang][w], uses)
            p = uses / uses.sum()
        out.append(p)
    return Model(sorted(counts), numbers, np.array(out).reshape(len(out), len(numbers) + 1))


def sample_counts(docs: DataFrame, per_language: int = FIT_DOCS) -> dict[str, dict[str, int]]:
    """Counts of all words of the documents whose doc_ids have a language's least hashes, per_language of them at most;
    rows that may not be learnt from, and rows without a doc_id or language, are left out."""
    may = docs.where(~held_out())
    ids = least_hashes(may, "lang", per_language)
    pairs = [F.struct(F.lit(lang), F.lit(i).cast("long")) for lang, own in ids.items() for i in sorted(own)]
    if not pairs:
        return {}
    chosen = may.where(F.struct("lang", F.col("doc_id").cast("long")).isin(*pairs))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                c = pd.Series(words_of(text), dtype=object).value_counts()
                yield pd.DataFrame({"lang": lang, "word": c.index.astype(object), "n": c.to_numpy("int64")})

    each = chosen.select("lang", "text").mapInPandas(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {}
    for r in each.collect():
        out.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return out


def train(docs: DataFrame, path: str, per_language: int = FIT_DOCS) -> Model:
    """A model of the languages that the learnable labelled documents have."""
    return fit(sample_counts(docs, per_language), vocabulary(path))


def _said(docs: DataFrame, model: Model, text: str, memory_words: int) -> Column:
    """Column struct<lang_pred,score> of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x 32,000 pieces: fixed by the vocabulary

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            texts = texts.tolist()
            langs, scores = [], []
            for low, high in chunks(texts):
                total, words = m.text_scores(texts[low:high], memory_words)
                known = (words > 0) & bool(m.languages)
                if not m.languages:
                    total = np.zeros((high - low, 1))
                top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                langs += [m.languages[i] if k else "und" for i, k in zip(total.argmax(1).tolist(), known.tolist(), strict=True)]
                scores += np.where(known, top, 0.0).tolist()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        m.forget(memory_words // 4)

    # as one that is not deterministic it is never planned twice, for a filter and for a column
    return F.pandas_udf(lean(score), "lang_pred string, score double").asNondeterministic()(safe_text(text))


def predict(docs: DataFrame, model: Model, text: str = "text", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """`docs` with lang_pred and score: the likeliest language of each whole text and its posterior (equal priors).

    Only the text is read. A null text or one without a letter gives `und` and 0.0, as does a model of no language; of
    equally likely languages the first by name is taken. Repeated rows give equal rows, an empty table none. Narrow: no
    shuffle; a worker remembers memory_words words. Columns named lang_pred or score are replaced.
    """
    (said,) = unused(docs, "said")
    found = docs.withColumn(said, _said(docs, model, text, memory_words))
    return found.withColumn("lang_pred", F.col(f"{said}.lang_pred")).withColumn("score", F.col(f"{said}.score")).drop(said)


def _lettered(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: any(any(map(str.isalpha, m.group())) for m in RUNS.finditer(t))).astype(bool)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """`docs` without the documents of no letter (or null); a null `lang` becomes the prediction, or stays null if the
    model has no language."""
    if not model.languages:
        return docs.where(F.pandas_udf(_lettered, "boolean")(safe_text(text)))
    (said,) = unused(docs, "said")
    found = docs.withColumn(said, _said(docs, model, text, memory_words)).where(F.col(f"{said}.lang_pred") != "und")
    return found.withColumn(lang, F.coalesce(F.col(lang), F.col(f"{said}.lang_pred"))).drop(said)


def identify(docs: DataFrame, path: str, per_language: int = FIT_DOCS) -> DataFrame:
    """Trains on the learnable documents, predicts all: doc_id, held_out, lang_pred, score (one row per row of docs)."""
    model = train(docs, path, per_language)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
