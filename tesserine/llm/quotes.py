"""Chat formatting by quotation linking.

Quoted lines (nested levels, '>' with or without spaces) and the attribution above a quote are cut out of a message. A run of
lines of one level is a quoted passage; its hash (lower case, all white space single, so re-wrapping changes nothing) is
joined to the messages of the conversation that wrote that passage themselves, as a whole or as a paragraph. Where a passage
is not found, its paragraphs are looked up, then lines, then sentences. Each hit votes, by its length, for the latest earlier
message that wrote it. Messages are then put in reply order: each after the one that it answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
ATTRIBUTION = re.compile(r"^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,40}:\s*$", re.I)
#: First of two lines of an attribution: it begins as one and is not a sentence of its own.
ATTRIBUTION_BEGINS = re.compile(r"^(On|Am|Le|El|At)\b[^\n]{0,200}[^.!?:\s]\s*$")
SPACE, SENTENCE = re.compile(r"\s+"), re.compile(r"(?<=[.!?])\s+")
#: Lines and sentences of fewer words are no evidence by themselves.
FEW_WORDS = 3
PASSAGE, PARAGRAPH, LINE, SENTENCE_KIND = range(4)
PARSED = "own string, wrote array<bigint>, quoted array<struct<level:int,run:int,paragraph:int,kind:int,unit:bigint,chars:int>>"


def plain(text: str) -> str:
    return SPACE.sub(" ", text).strip().lower()


def unit_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Runs of lines that are not blank."""
    out: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def units(lines: list[str]) -> list[tuple[int, int, str]]:
    """(paragraph, kind, normalised text) of a run of lines: the whole, its paragraphs, their lines and sentences."""
    parts = paragraphs(lines)
    out = [(-1, PASSAGE, plain(" ".join(lines)))] if parts else []
    for k, p in enumerate(parts):
        whole = plain(" ".join(p))
        out.append((k, PARAGRAPH, whole))
        for kind, own in ((LINE, [plain(x) for x in p]), (SENTENCE_KIND, SENTENCE.split(whole))):
            out += [(k, kind, x) for x in own if x.count(" ") + 1 >= FEW_WORDS]
    return out


def without_attribution(own: list[str]) -> list[str]:
    """The lines above a quote without its attribution: one or two lines, perhaps with a blank line after them."""
    last = len(own) - 1
    if last > 0 and not own[last].strip():
        last -= 1
    if last < 0 or not ATTRIBUTION.match(own[last]):
        return own
    if last > 0 and ATTRIBUTION_BEGINS.match(own[last - 1]):
        last -= 1
    return own[:last]


def parse(text: str | None) -> tuple[str, list[int], list[tuple[int, int, int, int, int, int]]]:
    """Text without quotes, hashes of what it says itself, and (level, run, paragraph, kind, hash, characters) of what it
    quotes."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    inside = False
    for line in (text or "").split("\n"):
        m = QUOTE.match(line)
        if m:
            if not inside:
                own = without_attribution(own)
            level = m.group(1).count(">")
            if not (inside and runs[-1][0] == level):
                runs.append((level, []))
            runs[-1][1].append(m.group(2))
        else:
            own.append(line)
        inside = m is not None
    said = "\n".join(own).strip("\n") if runs else "\n".join(own)
    quoted = [(level, r, p, kind, unit_hash(x), len(x)) for r, (level, lines) in enumerate(runs) for p, kind, x in units(lines)]
    return said, sorted({unit_hash(x) for _, _, x in units(own)}), quoted


def _parsed(messages: DataFrame) -> DataFrame:
    names = ("level", "run", "paragraph", "kind", "unit", "chars")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(o, x, [dict(zip(names, u, strict=True)) for u in q]) for o, x, q in map(parse, texts)], columns=["own", "wrote", "quoted"])

    return messages.withColumn("_p", F.pandas_udf(run, PARSED)(F.coalesce("text", F.lit(""))))


def latest_before(rows: DataFrame, keys: list[str], at: str, value: str, width: int = 64, levels: int = 3) -> DataFrame:
    """rows (keys, at: distinct within the keys, value) with `before`: the greatest value of the rows of smaller `at`.

    No window spans a whole group: inside blocks of `width` consecutive places a window, over the blocks the same again.
    """
    if not levels:
        w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.max(value).over(w))
    block, top = f"_block{levels}", f"_top{levels}"
    blocked = rows.withColumn(block, F.expr(f"{at} div {width}"))
    w = Window.partitionBy(*keys, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumn("_inside", F.max(value).over(w))
    tops = blocked.groupBy(*keys, block).agg(F.max(value).alias(top))
    high = latest_before(tops, keys, block, top, width, levels - 1).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(block).alias("_b"), F.col("before").alias("_high"))
    on = [inside[k].eqNullSafe(high[f"_k{i}"]) for i, k in enumerate(keys)] + [inside[block] == high["_b"]]
    return inside.join(high, on).select(*rows.columns, F.coalesce("_inside", "_high").alias("before"))


def _votes(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the earlier turn that each message quotes most."""
    known = parsed.where("turn is not null")
    cited = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    asked = cited.select(F.col("conv_id").alias("_conv"), F.col("unit").alias("_unit")).distinct()
    wrote = known.select("conv_id", "turn", F.explode("wrote").alias("unit")).distinct()
    wrote = wrote.join(asked, wrote["conv_id"].eqNullSafe(asked["_conv"]) & (wrote["unit"] == asked["_unit"]), "left_semi")
    events = wrote.withColumn("wrote", F.lit(True)).unionByName(cited.select("conv_id", "turn", "unit").distinct().withColumn("wrote", F.lit(False)))
    events = events.groupBy("conv_id", "unit", "turn").agg(F.max("wrote").alias("wrote")).withColumn("own", F.when(F.col("wrote"), F.col("turn")))
    before = latest_before(events, ["conv_id", "unit"], "turn", "own").where("before is not null")
    before = before.select(F.col("conv_id").alias("_c"), F.col("unit").alias("_u"), F.col("turn").alias("_t"), F.col("before").alias("origin"))
    hits = cited.join(before, cited["conv_id"].eqNullSafe(before["_c"]) & (cited["unit"] == before["_u"]) & (cited["turn"] == before["_t"]))
    # the widest units that were found count: a passage before its paragraphs, a paragraph before its lines, lines before sentences
    message = Window.partitionBy("conv_id", "turn", "run")
    hits = hits.withColumn("_whole", F.min("kind").over(message)).where("_whole != 0 or kind = 0")
    hits = hits.withColumn("_part", F.min("kind").over(Window.partitionBy("conv_id", "turn", "run", "paragraph"))).where("kind = _part")
    direct = F.sum(F.when(F.col("level") == 1, F.col("chars")).otherwise(0))
    votes = hits.groupBy("conv_id", "turn", "origin").agg(direct.alias("direct"), F.sum("chars").alias("all"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct("direct", "all", "origin")).alias("parent"))


def link(messages: DataFrame) -> DataFrame:
    """One row per message (conv_id, turn, role, text): conv_id, turn, role, text without quotes, reply_to, linked,
    quote_levels.

    reply_to is the earlier turn with most quoted characters at level 1, then at any level, then the later one; without a
    quote that is found, the turn before in the conversation (null for the first; linked is false then). A unit that
    several earlier messages wrote is the latest one's. Lines and sentences of fewer than FEW_WORDS words link nothing.
    Null texts are empty; a null conv_id is a conversation of its own; rows with a null turn reply to nothing and nothing
    replies to them; of repeated (conv_id, turn) the rows stay and share their links. An empty table gives no row.
    """
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    parsed = stored(_parsed(base).select("conv_id", "turn", "role", "_p.*"), "messages")
    best = _votes(parsed).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent")
    turns = parsed.where("turn is not null").select("conv_id", "turn").distinct()
    placed = numbered(turns, ["conv_id", "turn"])
    last = placed.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_before"), (F.col("_at") + 1).alias("_next"))
    prior = placed.join(last, placed["_at"] == last["_next"], "left")
    prior = prior.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.when(prior["conv_id"].eqNullSafe(last["_c"]), F.col("_before")).alias("before"))
    both = prior.join(best, prior["_c"].eqNullSafe(best["_conv"]) & (prior["_t"] == best["_turn"]), "left").select("_c", "_t", "before", "parent")
    out = parsed.join(both, parsed["conv_id"].eqNullSafe(both["_c"]) & (parsed["turn"] == both["_t"]), "left")
    levels = F.coalesce(F.array_max(F.transform("quoted", lambda x: x["level"])), F.lit(0))
    return out.select("conv_id", "turn", "role", F.col("own").alias("text"), F.coalesce("parent", "before").alias("reply_to"), F.col("parent").isNotNull().alias("linked"), levels.alias("quote_levels"))


def _threads(linked: DataFrame, rounds: int = 64) -> DataFrame:
    """conv_id, turn, root_turn, depth of each turn, by pointer doubling: a thread of n messages takes log2(n) rounds.

    A round looks up, for the turns that do not know their root yet, the farthest ancestor known; only those turns are
    joined and written. Every second turn of a thread is done by the last round but one.
    """
    turns = linked.where("turn is not null").select("conv_id", "turn", F.col("reply_to").alias("top"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).alias("depth")).distinct()
    start = stored(turns.withColumn("done", F.col("top").isNull()).withColumn("top", F.coalesce("top", "turn")), "threads")
    done, open_ = start.where("done"), start.where("not done")
    for _ in range(rounds):
        if not open_.limit(1).count():
            break
        known = done.unionByName(open_).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        far = open_.join(known, open_["conv_id"].eqNullSafe(known["_c"]) & (open_["top"] == known["_t"]))
        new = stored(far.select("conv_id", "turn", F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).cast("int").alias("depth"), F.col("_done").alias("done")), "threads")
        done, open_ = done.unionByName(new.where("done")), new.where("not done")
    return done.select("conv_id", "turn", F.col("top").alias("root_turn"), "depth")


def ordered(messages: DataFrame) -> DataFrame:
    """link() with root_turn and depth (the first message of its thread and the number of replies between), and position.

    position counts the messages of a thread from 0 in reply order: by depth, then turn (then role and text, of repeated
    turns), so each message stands after the one that it replies to. Rows with a null turn have null in all three.
    """
    linked = stored(link(messages), "linked")
    roots = _threads(linked).withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    rows = linked.join(roots, linked["conv_id"].eqNullSafe(roots["_c"]) & (linked["turn"] == roots["_t"]), "left").drop("_c", "_t")
    tie = [F.col("role"), F.xxhash64("text", "reply_to", "linked", "quote_levels")]
    placed = numbered(rows, ["conv_id", "root_turn", "depth", "turn", *tie])
    first = placed.where("turn is not null").groupBy(F.col("conv_id").alias("_c"), F.col("root_turn").alias("_r")).agg(F.min("_at").alias("_first"))
    out = placed.join(first, placed["conv_id"].eqNullSafe(first["_c"]) & (placed["root_turn"] == first["_r"]), "left")
    return out.select(*linked.columns, "root_turn", "depth", (F.col("_at") - F.col("_first")).alias("position"))


def rendered(messages: DataFrame, stretch: int = 4096) -> DataFrame:
    """Chat text in reply order, in stretches of `stretch` messages: conv_id, root_turn, part, chat.

    A stretch is bounded, so a conversation of any length is many rows that follow each other by part. Rows without a turn
    are in no thread and are left out.
    """
    rows = ordered(messages).where("turn is not null").withColumn("part", F.expr(f"position div {stretch}"))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return rows.groupBy("conv_id", "root_turn", "part").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("chat"))
