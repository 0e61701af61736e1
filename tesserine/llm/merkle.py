"""Merkle manifest of a table: a leaf for each row, a tree for each group, one root over the groups' roots.

Leaves are numbered within their group and dealt to blocks of FAN ** TIERS of them, each an ordered array; higher-order
functions (sequence, transform, slice, aggregate) collapse a block's levels natively, and the roots of the blocks are the
nodes of the next round until one is left in each group. The groups' roots are then one more group. On the way down each
block gets the siblings above it, so a leaf's whole proof is put together where its block is and paths are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

FAN, TIERS = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHIFT = FAN.bit_length() - 1
_STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of the values, each as its length in UTF-8 bytes, a colon and the value, or `-` for null."""
    said = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said])


def _joined(x: Column) -> Column:
    return F.array_join(x, "")


def _collapsed(nodes: Column) -> Column:
    """The level above: a digest of each FAN consecutive nodes (of the last run, of those left)."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(_joined(F.slice(nodes, i * FAN + 1, FAN)), 256))


def _first(k: Column) -> Column:
    """[0, 1, ...] of k elements, at most TIERS; none for 0."""
    return F.slice(F.array(*[F.lit(i) for i in range(TIERS)]), F.lit(1), k)


def _siblings(tiers: Column, at: Column, k: Column) -> Column:
    """Of the node at place `at` of the lowest of k collapsed levels: what stands left and right of it in its run, level by level."""

    def step(level: Column) -> Column:
        place = (at / F.pow(F.lit(float(FAN)), level)).cast("int")
        run = F.slice(F.get(tiers, level), F.shiftright(place, _SHIFT) * FAN + 1, FAN)
        own = place.bitwiseAND(F.lit(FAN - 1))
        return F.struct(_joined(F.slice(run, F.lit(1), own)).alias("left"), _joined(F.slice(run, own + 2, FAN)).alias("right"))

    return F.transform(_first(k), step)


def _depth(n: Column) -> Column:
    """How many levels stand above n nodes."""
    return sum(((n > F.lit(FAN**k)).cast("int") for k in range(20)), F.lit(0))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (tree, at, depth, hash, item): tree, block, depth, k (levels collapsed here), items (in order), tiers, top."""
    size = FAN**TIERS
    rows = nodes.groupBy("tree", F.floor(F.col("at") / size).alias("block"), "depth").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "item"))).alias("items"))
    rows = rows.withColumn("k", F.least("depth", F.lit(TIERS)))
    grow = lambda acc, _: F.concat(acc, F.array(_collapsed(F.element_at(acc, -1))))
    rows = rows.withColumn("tiers", F.aggregate(_first(F.col("k")), F.array(F.col("items.hash")), grow))
    return rows.withColumn("top", F.element_at(F.element_at("tiers", -1), 1))


def _climb(nodes: DataFrame, deepest: int) -> list[DataFrame]:
    """Rounds of stored blocks, from the nodes up to the round in which each tree has one block."""
    rounds = [stored(_blocks(nodes), "blocks")]
    while (deepest := deepest - TIERS) > 0:
        above = rounds[-1].where(F.col("depth") > TIERS)
        above = above.select("tree", F.col("block").alias("at"), (F.col("depth") - TIERS).alias("depth"), F.col("top").alias("hash"), F.lit(None).cast("long").alias("item"))
        rounds.append(stored(_blocks(above), "blocks"))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The blocks of the lowest round with `up` (siblings from the block's root to the whole root), subroot and root.

    above: of each tree its `up`, subroot and root; None if the tops of these trees are the root itself.
    """
    none = F.array().cast(f"array<{_STEP}>")
    known = None
    for place in reversed(range(len(rounds))):
        blocks = rounds[place]
        tops = blocks.where(F.col("depth") <= TIERS)
        if above is None:
            found = tops.withColumn("up", none).withColumn("subroot", F.col("top")).withColumn("root", F.col("top"))
        else:
            found = tops.join(above, "tree")
        if known is not None:
            lower = blocks.where(F.col("depth") > TIERS).join(known, ["tree", "block"])
            found = found.unionByName(lower)
        if not place:
            return found
        each = found.select("tree", "up", "subroot", "root", "k", "tiers", F.posexplode("items").alias("i", "x"))
        known = each.select("tree", F.col("x.at").alias("block"), F.concat(_siblings(F.col("tiers"), F.col("i"), F.col("k")), "up").alias("up"), "subroot", "root")
        known = stored(known, "paths")
    raise AssertionError("a tree has at least one round")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of docs: the column `order`, leaf, subroot (root of its group), root, proof_sha256, folded_root, verified.

    Per group (null first, then bytewise) leaves ascend by `order`, null first, and rows with the same one by their leaf;
    while several nodes remain, each FAN consecutive ones become their digest. proof_sha256 is the digest of a leaf's
    siblings from the leaf to the root, left to right (of nothing, if it has none). folded_root is the root that follows
    from those siblings and the leaf of the row as it is now: with the columns of `changed` where `where` holds (a null
    condition is none), else unchanged; verified says if it is the root. Rows alike in all columns have leaves of their own;
    columns not in `columns` do not matter. An empty table gives no row.

    A row is shuffled as its digests, 200 bytes whatever its text; one group may hold all rows: its leaves are numbered by
    range partitions and their counts, and no task holds more than FAN ** TIERS leaves at once.
    """
    now = {c: (changed or {}).get(c, F.col(c)) for c in columns}
    other = F.when(F.coalesce(where, F.lit(False)), leaf([now[c] for c in columns])) if where is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(order).alias("item"), F.col(group).alias("tree"), leaf([F.col(c) for c in columns]).alias("hash"), other.alias("other"))
    rows = numbered(stored(rows, "leaves"), ["tree", "item", "hash"])
    starts = rows.groupBy(F.col("tree").alias("name")).agg(F.min("_at").alias("start"), F.count("*").alias("n"))
    trees = numbered(starts, ["name"]).withColumnRenamed("_at", "number").withColumn("depth", _depth(F.col("n")))
    trees = stored(trees, "trees")
    deepest, count = trees.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count("*")).first()
    placed = rows.join(trees, F.col("tree").eqNullSafe(F.col("name")))
    nodes = placed.select(F.col("number").alias("tree"), (F.col("_at") - F.col("start")).alias("at"), "depth", "hash", F.struct("item", "other").alias("item"))
    rounds = _climb(nodes, deepest)
    tops = stored(_tops(rounds), "tops")
    top_depth = next(k for k in range(64) if FAN**k >= count)
    over = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(top_depth).alias("depth"), F.col("top").alias("hash"), F.lit(None).cast("long").alias("item"))
    upper = _descend(_climb(over, top_depth), None)
    each = upper.select("root", "up", "k", "tiers", F.posexplode("items").alias("i", "x"))
    above = each.select(F.col("x.at").alias("tree"), F.concat(_siblings(F.col("tiers"), F.col("i"), F.col("k")), "up").alias("up"), F.col("x.hash").alias("subroot"), "root")
    whole = _descend(rounds, stored(above, "roots"))
    each = whole.select("up", "subroot", "root", "k", "tiers", F.posexplode("items").alias("i", "x"))
    each = each.select("x", "subroot", "root", F.concat(_siblings(F.col("tiers"), F.col("i"), F.col("k")), "up").alias("path"))
    fold = F.aggregate("path", F.coalesce("x.item.other", "x.hash"), lambda acc, s: digest(s["left"], acc, s["right"]))
    proof = F.sha2(_joined(F.flatten(F.transform("path", lambda s: F.array(s["left"], s["right"])))), 256)
    out = each.select(F.col("x.item.item").alias(order), F.col("x.hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """The root of each tree: the top of its one block, in the round where it has one."""
    tops = [r.where(F.col("depth") <= TIERS).select("tree", "top") for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest of documents held against copies in which each third text (by crc32 of doc_id) is in lower case."""
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, changed={"text": F.translate("text", UPPER, LOWER)}, where=third)


def _sql() -> str:
    """The same for DuckDB, level by level; a tree with one node keeps it."""
    levels = 14
    said = lambda text: ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ["doc_id::varchar", "source", "lang", "n_chars::varchar", text])
    bit = "list_reduce(list_prepend(xor(crc, ascii(c)::bigint), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, string_split(doc_id::varchar, '')), lambda crc, c: {bit}), 4294967295)"
    # letters are lists of code points, so that the accumulator and the elements have one type
    crc = crc.replace("string_split(doc_id::varchar, '')", "list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)").replace("ascii(c)::bigint", "c")
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        f"l AS (SELECT doc_id, lang, sha256(concat({said('text')})) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256(concat({said(lower)})) END AS other FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS h, '' AS proof, coalesce(other, leaf) AS fold FROM l)",
    ]

    def climb(source: str, target: str, by: str) -> str:
        run = f"PARTITION BY {by} pos // 8, n > 1 ORDER BY pos"
        return (
            f"{target}_u AS (SELECT DISTINCT {by} pos, n, h FROM {source}), "
            f"{target}_r AS (SELECT {by} pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS joined FROM {target}_u GROUP BY ALL), "
            f"{target} AS (SELECT s.* EXCLUDE (pos, n, h, proof, fold), s.pos // 8 AS pos, (s.n + 7) // 8 AS n, CASE WHEN s.n > 1 THEN sha256(r.joined) ELSE s.h END AS h, "
            f"CASE WHEN s.n > 1 THEN s.proof || left(r.joined, (s.pos % 8) * 64) || substr(r.joined, (s.pos % 8) * 64 + 65) ELSE s.proof END AS proof, "
            f"CASE WHEN s.n > 1 THEN sha256(left(r.joined, (s.pos % 8) * 64) || s.fold || substr(r.joined, (s.pos % 8) * 64 + 65)) ELSE s.fold END AS fold "
            f"FROM {source} s JOIN {target}_r r ON s.pos // 8 = r.run{' AND s.lang IS NOT DISTINCT FROM r.lang' if by else ''})"
        )

    parts += [climb(f"n{i}", f"n{i + 1}", "lang, ") for i in range(levels)]
    parts.append("t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM l))")
    parts.append(f"m0 AS (SELECT x.doc_id, x.leaf, x.h AS subroot, t.pos, t.n, x.h, x.proof, x.fold FROM n{levels} x JOIN t ON x.lang IS NOT DISTINCT FROM t.lang)")
    parts += [climb(f"m{i}", f"m{i + 1}", "") for i in range(3)]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM m3"


SQL = _sql()
