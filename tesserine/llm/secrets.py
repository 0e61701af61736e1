"""Secret scanning with a trigram inverted index, in DataFrame operations only.

Each rule's regex gives a Boolean query over trigrams that any match must hold (or none: then every text is scanned). The
postings of those trigrams are intersected by document, and only the candidates of a rule are searched with its regex.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import safe_text, unused


@dataclass(frozen=True)
class Rule:
    """kind, regex (understood alike by Java, RE2 and Python) and the least length of its group `group`."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    either_case: bool = False

    @property
    def pattern(self) -> str:
        return ("(?i)" if self.either_case else "") + self.regex


#: The three base rules, then public token formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]+", 0, 15),
    Rule("stripe", r"sk_live_[0-9A-Za-z]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA


def trigram_query(pattern: str, most_paths: int = 64, widest_class: int = 6) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that are all in any text that matches by it; None: no such query."""
    from re import _constants as C
    from re import _parser

    def step(paths: set[tuple[frozenset, str]], text: str) -> set[tuple[frozenset, str]]:
        out = set()
        for grams, tail in paths:
            whole = tail + text
            out.add((grams | {whole[i : i + 3] for i in range(len(whole) - 2)}, whole[-2:]))
        return out

    def forget(paths: set) -> set:
        return {(grams, "") for grams, _ in paths}

    def walk(paths: set, nodes) -> set:
        for op, arg in nodes:
            if op is C.LITERAL:
                paths = step(paths, chr(arg).lower())
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= widest_class:
                paths = set().union(*(step(paths, chr(a).lower()) for _, a in arg))
            elif op is C.SUBPATTERN:
                paths = walk(paths, arg[3])
            elif op is C.BRANCH:
                paths = set().union(*(walk(paths, x) for x in arg[1]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, body = arg
                once = paths
                for _ in range(min(least, 3)):
                    once = walk(once, body)
                if least == 0 and most == 1:
                    paths = paths | walk(paths, body)
                else:
                    paths = once if least == most <= 3 else forget(once)
            elif op is not C.AT:
                paths = forget(paths)
            if len(paths) > most_paths:
                paths = forget(paths)
        return paths

    found = {grams for grams, _ in walk({(frozenset(), "")}, _parser.parse(pattern))}
    if any(not grams for grams in found):
        return None
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


def row_key(text: str, key: str) -> Column:
    """What postings know a document by: hash of key and text, so rows of one key or a null one do not meet. Should two
    texts share it, they share candidates, which are verified in each row's own text."""
    return F.xxhash64(F.col(key), F.col(text), F.length(text))


def postings(docs: DataFrame, grams: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """The inverted index over the trigrams that queries use: (trigram, key), once for each document that holds it."""
    low = F.lower(safe_text(text))
    held = F.array_compact(F.array(*[F.when(low.contains(g), F.lit(g)) for g in grams]))
    return docs.select(F.col(key), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, rules): of each document the kinds whose trigram query its postings satisfy; documents of none are absent."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in asked.values() for clause in q for g in clause})
    held = postings(docs, grams, text, key).groupBy(key).agg(F.collect_set("trigram").alias("_held"))

    def meets(clause: frozenset[str]) -> Column:
        own = F.array(*[F.lit(g) for g in sorted(clause)])
        return F.size(F.array_except(own, F.col("_held"))) == 0

    def any_of(query: list[frozenset[str]]) -> Column:
        found = F.lit(False)
        for clause in query:
            found = found | meets(clause)
        return found

    kinds = F.array_compact(F.array(*[F.when(any_of(q), F.lit(k)) for k, q in asked.items()]))
    return held.select(F.col(key), kinds.alias("_kinds")).where(F.size("_kinds") > 0)


SPANS = "array<struct<start:int,kind_order:int,end:int,kind:string>>"
#: Matches whose places are added up in one go; runs of them are then moved to where they begin.
RUN = 512
#: Spans that are cut out of one part of a text.
CUT = 64


def rule_spans(text: Column, rule: Rule, order: int, scan: Column) -> Column:
    """array<struct<start,kind_order,end,kind>>, code points: what lies between matches, by split, gives the places.

    Places are running sums, made in runs of RUN matches, so a text full of matches costs no square of their number.
    """
    p = rule.pattern
    found, between = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)
    values = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(p), F.lit(rule.group))
    lengths = lambda x: F.transform(x, F.length)
    pairs = F.zip_with(lengths(found), lengths(values), lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    each = F.zip_with(pairs, F.slice(lengths(between), 1, F.size(found)), lambda x, b: F.struct(x["m"].alias("m"), x["v"].alias("v"), b.alias("b")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["b"]
        end = begin + x["m"]
        own = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(x["v"] >= rule.least, F.concat(acc["out"], F.array(own).cast(SPANS))).otherwise(acc["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    def join(acc: Column, run: Column) -> Column:
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("at"), run["out"].alias("out")))).alias("runs"))

    def moved(run: Column) -> Column:
        return F.transform(run["out"], lambda s: F.struct((s["start"] + run["at"]).alias("start"), s["kind_order"].alias("kind_order"), (s["end"] + run["at"]).alias("end"), s["kind"].alias("kind")))

    def places(all_: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(all_, i * RUN + 1, F.lit(RUN)), start, add))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:{SPANS}>>").alias("runs"))
        return F.flatten(F.transform(F.aggregate(runs, none, join, lambda acc: acc["runs"]), moved))

    empty = F.array().cast(SPANS)
    return F.when(scan, F.element_at(F.transform(F.array(each), lambda all_: F.when(F.size(all_) > RUN, places(all_)).otherwise(F.aggregate(all_, start, add, lambda acc: acc["out"]))), 1)).otherwise(empty)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with the column `secret_spans`: array<struct<start,kind_order,end,kind>> by start, then by the rules' order.

    All rows and columns of `docs` stay (columns named _row, _kinds or secret_spans are replaced). A null text is an empty
    one and has no spans; null and repeated keys are allowed; an empty table gives no row; texts of any length are searched
    whole. One shuffle of the postings and, unless the candidates are few, one of the texts, both by row_key().
    """
    docs = docs.drop("_kinds", "secret_spans").withColumn("_row", row_key(text, key))
    both = docs.join(candidates(docs, rules, text, "_row"), "_row", "left").drop("_row")
    whole = safe_text(text)
    parts = []
    for i, r in enumerate(rules):
        if trigram_query(r.pattern) is None:  # no mandatory trigram: every text is searched
            scan = whole.rlike(r.regex[:-1] + f"{{{r.least},}}") if r.regex.endswith("]+") and not r.group else whole.rlike(r.pattern)
        else:
            scan = F.coalesce(F.array_contains("_kinds", r.kind), F.lit(False))
        parts.append(rule_spans(whole, r, i, scan))
    return both.withColumn("secret_spans", F.array_sort(F.flatten(F.array(*parts)))).drop("_kinds")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, counts of the base kinds, digest of the base spans, all spans, number of extra ones."""
    found = find(docs.select(F.col(key), F.col(text)), rules, text, key).withColumn("_base", F.filter("secret_spans", lambda x: x["kind_order"] < len(BASE)))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col(key), *[count(r.kind) for r in BASE], F.sha2(digest(F.col("_base")), 256).alias("base_sha256"),
        digest(F.col("secret_spans")).alias("spans"), (F.size("secret_spans") - F.size("_base")).cast("long").alias("n_extra"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each maximal run of overlapping spans of the text replaced by `mark`.

    Texts without secrets, null and empty ones stay as they are; repeated rows and null keys stay rows of their own; all
    columns stay, whatever their names; an empty table gives no row. A text of any length is redacted whole: its spans are
    taken in runs of CUT, each within its own part of the text, so time grows with spans and text and not with their product.
    """
    row, spans = unused(docs, "row", "secret_spans")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(key).alias("own_key"), F.col(text).alias("own_text"))
    found = find(whole, rules, "own_text", "own_key")
    body, runs = safe_text("own_text"), F.sequence(F.lit(0), F.floor((F.size("secret_spans") - 1) / CUT).cast("int"))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

    def add(part: Column, base: Column):
        def step(acc: Column, x: Column) -> Column:
            before = F.substring(part, acc["at"] - base + 1, x["start"] - acc["at"])
            more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(before, F.lit(mark)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

        return step

    def cut(acc: Column, i: Column) -> Column:
        """The run's spans within the part of the text from where the last run stopped to the start of its own last span."""
        own = F.slice("secret_spans", i * CUT + 1, F.lit(CUT))
        part = F.substring(body, acc["at"] + 1, F.greatest(F.element_at(own, -1)["start"] - acc["at"], F.lit(0)))
        done = F.element_at(F.transform(F.array(part), lambda p: F.aggregate(own, start(acc["at"]), add(p, acc["at"]))), 1)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(done["out"], ""))).alias("out"))

    clean = F.aggregate(runs, start(F.lit(0)), cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))))
    value = F.when(F.size("secret_spans") > 0, clean).otherwise(F.col("own_text"))
    return found.select(*[value.alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns])


def scan_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for scan() over the view `documents`."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS p, regexp_extract_all(t, {quoted(r.pattern)}) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v FROM d"
        for i, r in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({each}),
u AS (SELECT doc_id, o, kind, least, unnest(range(1, len(m) + 1)) AS i, p, m, v FROM f WHERE len(m) > 0),
l AS (SELECT doc_id, o, kind, least, i, length(p[i]) AS b, length(m[i]) AS n, length(v[i]) AS x FROM u),
s AS (SELECT doc_id, o, kind, x, least, sum(b + n) OVER (PARTITION BY doc_id, o ORDER BY i) AS stop, n FROM l),
k AS (SELECT doc_id, o, kind, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE x >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans, count(*) FILTER (o >= {len(BASE)}) AS n_extra FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_extra, 0) AS n_extra
FROM d LEFT JOIN g USING (doc_id)"""


def spans_of(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """The same by plain search, for tests."""
    return sorted((m.start(), i, m.end(), r.kind) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text or "", re.A) if len(m.group(r.group)) >= r.least)
