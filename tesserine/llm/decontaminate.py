"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question with other numbers or names has the same template. A token's
type depends on itself (and, for a unit, on the number before it) alone: any capitalised word counts as a name. Windows of
WIDTH tokens of the benchmark are hashed by template, where they have enough literal tokens, and by their exact tokens, and
both hashes are joined with those of each text. Matches within a region of the text and on one diagonal (text place minus item
place) must fill equal slots of the item with equal values, else they are not a re-parameterised copy and only runs of WIDTH
or more equal tokens count there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, safe_text, stored, unused

#: Template tokens in a window, literal ones that it needs; matched tokens, or share of the item, that make a leak.
WIDTH, LITERAL, ENOUGH, SHARE = 8, 4, 13, 0.6
#: Characters of the benchmark that one broadcast block holds at most (each item whole), and blocks that are broadcast at most:
#: a larger benchmark is joined by the windows' hashes. Both ways find the same.
BLOCK_CHARS, BLOCKS = 16_000_000, 2
#: Bits of the table that tells, before the search, whether a hash can be in a block at all.
SIEVE_BITS = 22
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|\w+")
#: Number words and units in English, German, French and Spanish.
NUMBER_WORDS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen
zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante
soixante cent mille millions
cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta
sesenta setenta ochenta noventa cien ciento mil millón millones
""".split())
UNITS = frozenset("""
mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs ms kmh mph w kw v hz mb gb
second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer
kilometers mile miles gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent
cents percent degree degrees
sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren kilometern gramm
kilogramm pfund prozent grad
seconde secondes heure heures jour jours semaine semaines mois an ans année années mètre mètres kilomètre kilomètres gramme
grammes litres degré degrés
segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo
gramos litro litros euros grado grados
""".split())

LITERAL_TOKEN, NUMBER, NAME, UNIT = range(4)
_SLOT = np.array([0, 0x517CC1B727220A95, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35], np.uint64)


def _kind(token: str) -> int:
    """The slot that a token fills by itself, wherever it stands, so that an item and its copies have one template."""
    if token[0].isdigit() or token.lower() in NUMBER_WORDS:
        return NUMBER
    return NAME if len(token) > 1 and token[0].isupper() and token[1:].islower() else LITERAL_TOKEN


@dataclass
class Templates:
    """Template tokens of some texts, one after the other."""

    literal: np.ndarray  # hash of the lower-case token
    slot: np.ndarray
    owner: np.ndarray
    ends: np.ndarray  # of each text, where its tokens end

    @classmethod
    def of(cls, texts: list[str | None]) -> Templates:
        split = [TOKEN.findall(t or "") for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes, distinct = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
        owner = np.repeat(np.arange(len(split)), sizes)
        if not len(codes):
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), owner, np.cumsum(sizes))
        kinds = np.fromiter(map(_kind, distinct), np.int64, len(distinct))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in distinct), np.uint64, len(distinct))
        units = np.fromiter((w.lower() in UNITS for w in distinct), bool, len(distinct))
        slot = kinds[codes]
        after_number = np.zeros(len(codes), bool)
        after_number[1:] = (slot[:-1] == NUMBER) & (owner[1:] == owner[:-1])
        slot[after_number & units[codes]] = UNIT
        return cls(hashes[codes], slot, owner, np.cumsum(sizes))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows of one text; their hashes by exact tokens and by template; and whether they are templates
        at all: with enough literal tokens, and a slot."""
        n = len(self.literal) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.flatnonzero(self.owner[:n] == self.owner[width - 1 :])
        plain = np.concatenate(([0], np.cumsum(self.slot == LITERAL_TOKEN)))
        literal = (plain[width:] - plain[:-width])[at]
        both = []
        for token in (self.literal, np.where(self.slot == LITERAL_TOKEN, self.literal, _SLOT[self.slot])):
            h = np.full(n, np.uint64(width))
            for i in range(width):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + token[i : i + n]
            both.append(h[at])
        return at, *both, (literal >= min(LITERAL, (width + 1) // 2)) & (literal < width)


class Table:
    """Hashes of windows and where they are."""

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        by = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[by], places[by]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[keys >> np.uint64(64 - SIEVE_BITS)] = True

    def matches(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the texts, place in the items) of all equal windows."""
        live = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE_BITS)])
        low = np.searchsorted(self.keys, h[live])
        n = np.searchsorted(self.keys, h[live], side="right") - low
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at[live], n), self.places[np.repeat(low, n) + inner]


class Benchmark:
    """Windows of the items of one block; items shorter than WIDTH tokens have one window of their own width. Each window is
    in a table by its exact tokens and, with a slot and enough literal tokens, in one by its template."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.t = np.array(ids, np.int64), Templates.of(texts)
        self.begin = np.concatenate(([0], self.t.ends[:-1])) if len(ids) else np.zeros(0, np.int64)
        self.size = self.t.ends - self.begin if len(ids) else self.begin
        self.tables: list[tuple[int, Table, Table]] = []
        for width in sorted({WIDTH, *(int(x) for x in self.size if 0 < x < WIDTH)}):
            at, exact, template, rich = self.t.windows(width)
            own = (width == WIDTH) | (self.size[self.t.owner[at]] == width)
            if own.any():
                self.tables.append((width, Table(exact[own], at[own]), Table(template[own & rich], at[own & rich])))

    def pairs(self, t: Templates) -> pd.DataFrame:
        """doc, item, mine, theirs: the tokens of equal windows, each pair of places once."""
        found = []
        for width, exact, template in self.tables:
            at, h, g, rich = t.windows(width)
            for table, where, keys in ((exact, at, h), (template, at[rich], g[rich])):
                mine, theirs = table.matches(where, keys)
                if len(mine):
                    step = np.tile(np.arange(width), len(mine))
                    found.append((np.repeat(mine, width) + step, np.repeat(theirs, width) + step))
        mine, theirs = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"doc": t.owner[mine], "item": self.t.owner[theirs], "mine": mine, "theirs": theirs}).drop_duplicates()

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, int, float, bool]]]:
        """Of each text: (item_id, matched tokens, share of the item, verbatim) of the best region for each item, by item.

        A region is a run of matches with gaps of at most the item's size. Verbatim: on one diagonal all tokens from the
        first matched to the last are equal.
        """
        out: list[list[tuple[int, int, float, bool]]] = [[] for _ in texts]
        t = Templates.of(texts)
        pair = self.pairs(t)
        if not len(pair):
            return out
        pair = pair.sort_values(["doc", "item", "mine"], kind="stable")
        step = pair[["doc", "item", "mine"]].diff().to_numpy()
        far = (step[:, 0] != 0) | (step[:, 1] != 0) | (step[:, 2] > np.maximum(self.size[pair["item"]], 2 * WIDTH))
        pair["region"] = np.cumsum(far)
        pair["line"] = pair["mine"] - pair["theirs"]
        pair["slot"], pair["want"], pair["got"] = self.t.slot[pair["theirs"]], self.t.literal[pair["theirs"]], t.literal[pair["mine"]]
        slots = pair[pair["slot"] != LITERAL_TOKEN]
        values = slots.groupby(["region", "line", "slot", "want"])["got"].nunique()
        torn = values[values > 1].reset_index()[["region", "line"]].drop_duplicates().assign(torn=True)
        pair = pair.merge(torn, on=["region", "line"], how="left").sort_values(["region", "line", "theirs"])
        pair["torn"] = pair["torn"].notna()
        equal = (pair["want"] == pair["got"]).to_numpy()
        steps = pair[["region", "line", "theirs"]].diff().to_numpy()
        run = np.cumsum(~((steps[:, :2] == 0).all(1) & (steps[:, 2] == 1) & equal & np.roll(equal, 1)))
        long = np.bincount(run)[run] >= np.minimum(WIDTH, self.size[pair["item"]])
        pair["equal"] = equal
        pair = pair[~pair["torn"] | (equal & long)]
        lines = pair.groupby(["doc", "item", "region", "line"]).agg(low=("theirs", "min"), high=("theirs", "max"), same=("equal", "sum")).reset_index()
        lines["verbatim"] = lines["same"] == lines["high"] - lines["low"] + 1
        whole = lines.groupby("region").agg(low=("low", "min"), high=("high", "max"))
        lines["verbatim"] &= (lines["low"] == whole["low"].loc[lines["region"]].to_numpy()) & (lines["high"] == whole["high"].loc[lines["region"]].to_numpy())
        rows = pair.groupby(["doc", "item", "region"]).agg(n=("theirs", "nunique")).reset_index()
        rows["verbatim"] = rows["region"].map(lines.groupby("region")["verbatim"].any())
        size = self.size[rows["item"]]
        rows = rows[(rows["n"] >= np.minimum(ENOUGH, size)) | (rows["n"] >= SHARE * size)]
        rows = rows.sort_values(["doc", "item", "n", "verbatim", "region"], ascending=[True, True, False, False, True]).drop_duplicates(["doc", "item"])
        for doc, item, _, n, verbatim in rows.itertuples(index=False):
            out[doc].append((int(self.ids[item]), int(n), n / int(self.size[item]), bool(verbatim)))
        return out


HITS = "array<struct<item_id:bigint,matched:bigint,share:double,exact:boolean>>"


def _against(held: Broadcast):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = held.value  # windows and tables made once, on the driver
        for texts in batches:
            got = []
            for at in range(0, len(texts), 500):
                got += block.hits(texts.iloc[at : at + 500].tolist())
            yield pd.Series([[dict(zip(("item_id", "matched", "share", "exact"), h, strict=True)) for h in x] for x in got], dtype=object)

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null")


def leaks(benchmark: DataFrame, text: Column, n_blocks: int) -> Column:
    """Column of the benchmark items that a text holds, as HITS (empty for a null text).

    The benchmark is cut by its item ids' hash into n_blocks blocks, whose windows are made once; a block is what is
    broadcast, and each text meets every block. Items without a word or number, or with a null id, are passed over.
    """
    items, parts = _items(benchmark), []
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).orderBy("item_id").collect()
        held = benchmark.sparkSession.sparkContext.broadcast(Benchmark([r[0] for r in rows], [r[1] for r in rows]))
        parts.append(F.pandas_udf(lean(_against(held)), HITS)(text))
    return parts[0] if n_blocks == 1 else F.concat(*parts)


def _window_hashes(rows: DataFrame, widths: list[int] | None) -> DataFrame:
    """(key, width, h): the distinct window hashes of texts (key, text), by exact tokens and by template; of items (no widths
    given) those of WIDTH tokens or, for a shorter item, of its own width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                t = Templates.of(part["text"].tolist())
                size = np.diff(np.concatenate(([0], t.ends)))
                for width in widths or sorted({WIDTH, *(int(x) for x in size if 0 < x < WIDTH)}):
                    place, exact, template, rich = t.windows(width)
                    own = t.owner[place]
                    mine = np.ones(len(own), bool) if widths or width == WIDTH else size[own] == width
                    out = pd.DataFrame({"row": np.concatenate((own[mine], own[mine & rich])), "h": np.concatenate((exact[mine], template[mine & rich])).view(np.int64)}).drop_duplicates()
                    yield pd.DataFrame({"key": part["key"].to_numpy()[out["row"]], "width": width, "h": out["h"]})

    return rows.select("key", "text").mapInPandas(lean(run), f"key {rows.schema['key'].dataType.simpleString()}, width int, h long")


def _joined(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """docs with the column `name` (HITS), by a join of window hashes: texts and items that share one are candidates, and
    only those are compared. A text is known by its digest, so copies of one are compared once."""
    (key,) = unused(docs, "digest")
    items = stored(_items(benchmark).withColumn("key", F.monotonically_increasing_id()), "items")
    texts = docs.select(F.sha2(safe_text(), 256).alias("key"), safe_text().alias("text"))
    theirs = stored(_window_hashes(items, None), "windows").select(F.col("key").alias("item"), "width", "h")
    widths = sorted(r[0] for r in theirs.select("width").distinct().collect())  # WIDTH of them at most
    found = _window_hashes(texts, widths).join(theirs, ["width", "h"]).select("key", "item").distinct()
    pairs = stored(found, "candidates")
    bodies = texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(bodies, "key").join(items.select(F.col("key").alias("item"), "item_id", F.col("text").alias("asked")), "item")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, asked = b.drop_duplicates("key"), b.drop_duplicates("item").sort_values("item_id")
            block = Benchmark(list(range(len(asked))), asked["asked"].tolist())
            place = {k: i for i, k in enumerate(asked["item"])}
            wanted = set(zip(b["key"], (place[i] for i in b["item"]), strict=True))
            ids = asked["item_id"].tolist()
            rows = [(k, ids[i], n, share, exact) for k, hits in zip(own["key"], block.hits(own["text"].tolist()), strict=True) for i, n, share, exact in hits if (k, i) in wanted]
            yield pd.DataFrame(rows, columns=["key", "item_id", "matched", "share", "exact"])

    hits = both.select("key", "item", "item_id", "text", "asked").mapInPandas(lean(compare), "key string, item_id long, matched long, share double, exact boolean")
    hits = stored(hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item_id", "matched", "share", "exact"))).alias(name)).withColumnRenamed("key", key), "hits")
    out = docs.withColumn(key, F.sha2(safe_text(), 256)).join(hits, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(HITS))).drop(key)


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """docs with the column `name`: HITS of each whole text. Up to BLOCKS blocks of the benchmark are sent to all tasks, and
    docs are not shuffled; the windows of a larger one are joined with those of the texts."""
    chars = _items(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS) or 1
    return docs.withColumn(name, leaks(benchmark, safe_text(), n_blocks)) if n_blocks <= BLOCKS else _joined(docs, benchmark, name)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, matched (tokens of the item in its best region of the
    text), share (of the item), exact (that region is verbatim). Clean documents give no row.

    Narrow over docs unless the benchmark is large (with_hits()). Repeated rows give repeated rows; a null doc_id stays null;
    null and empty texts and an empty table or benchmark give no row; texts of any length are read whole. Of regions with
    equally many matched tokens a verbatim one, then the first is reported. Repeated items are items each.
    """
    return with_hits(docs.select("doc_id", "text"), benchmark, "hits").select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated documents.

    All their columns stay, whatever their names; null and empty texts hold no item and stay, as do repeated rows; an empty
    benchmark takes nothing away; an empty table gives no row. Texts of any length are read whole.
    """
    (hits,) = unused(docs, "hits")
    return with_hits(docs, benchmark, hits).where(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
