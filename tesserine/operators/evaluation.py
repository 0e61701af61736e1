"""Evaluation analytics: labels, proxies, summaries, parity, agreement, comparison, sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T


def hits(ranking: DataFrame, relevant: Column, k: int = 3) -> DataFrame:
    """Per query: hit_1, hit_k, mrr over ranks 1..k. Queries with candidates but no relevant one have 0, not null."""
    first = F.min(F.when(relevant & (F.col("rank") <= k), F.col("rank")))
    out = ranking.groupBy("query_id").agg(first.alias("first_rank"))
    return out.select("query_id", F.coalesce(F.col("first_rank") == 1, F.lit(False)).alias("hit_1"), F.col("first_rank").isNotNull().alias(f"hit_{k}"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"))


def failure_class(found: Column, in_pool: Column, first: Column) -> Column:
    """A right at once, B right but not first, C in the pool only, D not retrieved."""
    return F.when(first, "A_FIRST").when(found, "B_RANKED_LOWER").when(in_pool, "C_POOL_ONLY").otherwise("D_NOT_RETRIEVED")


def proxies(pairs: DataFrame) -> DataFrame:
    """Token overlap of (pair_id, reference, answer): precision, recall, f1, exact match, numbers kept (null if none)."""
    token = F.lit(r"[A-Za-z]+[0-9]*|[0-9]+|[\x{0980}-\x{09ff}]+")
    number = F.lit(r"[0-9]+(?:\.[0-9]+)?")
    of = lambda c, p: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), p, F.lit(0))
    out = pairs.withColumn("_r", of("reference", token)).withColumn("_a", of("answer", token))
    p, r, f = S.precision_recall_f1(F.array_distinct("_a"), F.array_distinct("_r"))
    wanted, got = F.array_distinct(of("reference", number)), F.array_distinct(of("answer", number))
    kept = F.when(F.size(wanted) > 0, F.size(F.array_except(wanted, got)) == 0)
    return out.select("pair_id", F.round(p, 6).alias("token_precision"), F.round(r, 6).alias("token_recall"), F.round(f, 6).alias("token_f1"), (F.col("_r") == F.col("_a")).alias("exact_match"), kept.alias("numbers_kept"))


def gates(scored: DataFrame) -> DataFrame:
    return scored.select("pair_id", ((F.col("token_recall") >= 0.70) & (F.col("token_f1") >= 0.45)).alias("acceptable"), (F.col("token_recall") >= 0.85).alias("complete"))


def safe_return(returned: Column, grounded: Column, semantic: Column, language: Column, failures: Column) -> Column:
    """Returned, grounded, in the right language, no failure; a null semantic check counts as passed."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(returned) & yes(grounded) & F.coalesce(semantic, F.lit(True)) & yes(language) & (F.coalesce(F.size(failures), F.lit(0)) <= 0)


def error_class(r: dict[str, Column]) -> Column:
    """Decision list; the order matters. r: error, returned, safe, annotation, status, attempts, language, grounded,
    semantic, hit_1, hit_3."""
    rejected = F.when(F.coalesce(r["attempts"], F.lit(0)) == 0, "UNKNOWN").when(r["language"] == F.lit(False), "LANGUAGE_REJECTION").when(r["grounded"] == F.lit(False), "GROUNDING_REJECTION").when(r["semantic"] == F.lit(False), "SEMANTIC_REJECTION").otherwise("CANONICAL_GENERATION")
    missed = F.when(r["hit_3"] == F.lit(False), "RETRIEVAL_MISS").when((r["hit_1"] == F.lit(False)) & r["hit_3"], "RANKING_MISS").otherwise("UNKNOWN")
    return (
        F.when(r["error"] | (r["status"] == "SYSTEM_ERROR"), "SYSTEM_ERROR")
        .when(r["returned"] & ~r["safe"], "UNSAFE_RETURN")
        .when(r["annotation"].isin("needs_review", "ambiguous_reference"), "ANNOTATION_ERROR")
        .when((r["annotation"] == "source_conflict") | (r["status"] == "CONFLICTING_EVIDENCE"), "SOURCE_CONFLICT")
        .when(r["status"] == "AMBIGUOUS_QUERY", "AMBIGUITY_HANDLING")
        .when(r["status"] == "GENERATION_REJECTED", rejected)
        .when(r["status"].isin("INSUFFICIENT_EVIDENCE", "RETRIEVAL_UNCERTAIN"), missed)
        .otherwise("UNKNOWN")
    )


def rate_summary(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return out.select(*by, "n", "hits", F.round(S.share(F.col("hits"), F.col("n")), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def ranked_values(df: DataFrame, by: list[str], value: str, share: float, ranks: Callable[[Column], list[Column]], name: str) -> DataFrame:
    """(by, name): the mean of the values at the ranks (from 1) that ranks(n) gives for a group of n, exactly.

    A summary of each group bounds the values whose rank is near `share`; only those, counted by value, are put in order,
    so no task holds a whole group's values.
    """
    near, slack = 10_000, 0.0005
    rows = df.where(F.col(value).isNotNull())
    ends = [max(0.0, share - slack), min(1.0, share + slack)]
    bounds = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(value, ends, near).alias("_ends"))
    bounds = bounds.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_n", F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)] or [F.lit(True)]
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c")).join(bounds, same)
    keys = [f"_g{i}" for i in range(len(by))]
    below = counts.where(F.col(value) < F.col("_low")).groupBy(*keys).agg(F.sum("_c").alias("_below"))
    inside = counts.where(F.col(value).between(F.col("_low"), F.col("_high"))).select(*keys, "_n", F.col(value).alias("_v"), "_c")
    under = below.select(*[F.col(k).alias(f"{k}b") for k in keys], "_below")
    inside = inside.join(under, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys] or [F.lit(True)], "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_v"))
    inside = inside.withColumn("_upto", upto)
    at = [F.min(F.when(F.col("_upto") >= r, F.col("_v"))) for r in ranks(F.col("_n"))]
    return inside.groupBy(*keys).agg((sum(at[1:], at[0]) / len(at)).alias(name))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and nearest-rank 95th percentile of each group."""
    rows = df.where(F.col(value).isNotNull())
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))
    half = lambda n: [F.floor((n + 1) / 2), F.ceil((n + 1) / 2)]
    for name, share, ranks in (("median", 0.5, half), ("p95", 0.95, lambda n: [F.ceil(n * 0.95 - 1e-9)])):
        part = ranked_values(rows, by, value, share, ranks, name)
        out = out.join(part, [out[c].eqNullSafe(part[f"_g{i}"]) for i, c in enumerate(by)]).drop(*[f"_g{i}" for i in range(len(by))])
    return out.select(*by, "n", "mean", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "max")


def throughput(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Items an hour, null where no time passed."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(seconds).alias("_s"))
    return out.select(*by, "n", F.round(F.when(F.col("_s") > 0, F.col("n") / F.col("_s") * 3600.0), 4).alias("per_hour"))


PARITY = {("a", "b", "c"): "ALL_THREE", ("a",): "FIRST_ONLY", ("b",): "SECOND_ONLY", ("c",): "THIRD_ONLY", ("a", "b"): "FIRST_AND_SECOND", ("a", "c"): "FIRST_AND_THIRD", ("b", "c"): "SECOND_AND_THIRD", (): "NONE"}


def parity(rows: DataFrame, base: str, variant: str, supported: Column, names: tuple[str, str, str]) -> DataFrame:
    """Category of each base by which of its three variants are supported; fewer than three variants: OTHER_MISMATCH."""
    flags = [F.coalesce(F.bool_or(F.when(F.col(variant) == n, supported)), F.lit(False)).alias(x) for n, x in zip(names, "abc", strict=True)]
    out = rows.where(F.col(variant).isin(*names)).groupBy(base).agg(F.count_distinct(variant).alias("variants"), *flags)
    said = F.lit("OTHER_MISMATCH")
    for have, label in PARITY.items():
        same = F.lit(True)
        for x in "abc":
            same = same & (F.col(x) == F.lit(x in have))
        said = F.when(same & (F.col("variants") == 3), label).otherwise(said)
    return out.select(base, said.alias("category"))


def _same_sets(kept: Column, value: Column) -> Column:
    """How many different sets the kept rows of a group have, as an order-free digest: value is a hash of a set's members."""
    return F.count_distinct(F.when(kept, value))


def members(values: Column) -> Column:
    """A hash of the members of an array, in any order and however often: for equality of sets. Null for null."""
    plain = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.lower(v.cast("string")))))
    return F.when(values.isNotNull(), F.xxhash64(F.size(plain), F.array_join(F.transform(plain, lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v)), "")))


def full_parity(rows: DataFrame, base: str, variant: str, supported: Column, safe: Column, evidence: Column, answer: Column, values: Column, names: tuple[str, str, str]) -> DataFrame:
    """parity() and, of each base, whether its three variants rest on the same evidence (one (document, page) among the safe
    ones), state the same numbers (as a multiset, of the safe answers) and the same values (as a set; null where a variant
    has none). All three are null unless all variants are supported, and numbers also if no safe answer has any."""
    numbers = F.array_sort(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    own = rows.where(F.col(variant).isin(*names)).withColumns({
        "_s": F.coalesce(supported, F.lit(False)), "_safe": F.coalesce(safe, F.lit(False)), "_e": F.xxhash64(evidence), "_n": F.xxhash64(F.array_join(numbers, " ")), "_some": F.size(numbers) > 0,
        "_v": members(F.when(F.size(values) > 0, values)),
    })
    per = own.groupBy(base).agg(
        F.count_distinct(F.when(F.col("_s"), F.col(variant))).alias("_k"), _same_sets(F.col("_safe"), F.col("_e")).alias("_es"), _same_sets(F.col("_safe"), F.col("_n")).alias("_ns"),
        F.coalesce(F.bool_or(F.when(F.col("_safe"), F.col("_some"))), F.lit(False)).alias("_any"), F.count_distinct("_v").alias("_vs"), F.count_if(F.col("_v").isNull()).alias("_without"),
    )
    all3 = F.col("_k") == 3
    told = per.select(
        F.col(base).alias("_base"), F.when(all3, F.col("_es") == 1).alias("same_evidence"), F.when(all3 & F.col("_any"), F.col("_ns") == 1).alias("same_numbers"),
        F.when(all3 & (F.col("_without") == 0), F.col("_vs") == 1).alias("same_values"),
    )
    out = parity(rows, base, variant, supported, names)
    return out.join(told, out[base].eqNullSafe(told["_base"])).drop("_base")


def kappa(pairs: DataFrame, a: str, b: str, categories: int | None = None) -> DataFrame:
    """Cohen's kappa of two raters, nominal, or quadratic-weighted over 0..categories-1: n, observed, expected, kappa.

    Nulls are dropped. No pairs: null. Where chance alone explains everything: 1.0 if the raters agree throughout, else
    null. The marginals come from the table of counts, whose size is the number of category pairs.
    """
    t = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").cast("double").alias("c"))
    # Sum over all cells of weight(x, y) * row(x) * column(y) needs each pair of marginals, also pairs without a row.
    rows, cols = t.groupBy("x").agg(F.sum("c").alias("r")), t.groupBy("y").agg(F.sum("c").alias("k"))
    span = float((categories - 1) ** 2) if categories else 1.0
    weight = lambda x, y: (x - y) * (x - y) / span if categories else F.when(x == y, 0.0).otherwise(1.0)
    lists = rows.agg(F.collect_list(F.struct("x", "r")).alias("rs")).withColumn("_k", F.lit(1)).join(cols.agg(F.collect_list(F.struct("y", "k")).alias("ks")).withColumn("_k", F.lit(1)), "_k")
    expected = F.aggregate("rs", F.lit(0.0), lambda s, x: s + F.aggregate("ks", F.lit(0.0), lambda q, y: q + weight(x["x"], y["y"]) * x["r"] * y["k"]))
    seen = t.agg(F.sum("c").alias("n"), F.sum(weight(F.col("x"), F.col("y")) * F.col("c")).alias("off")).withColumn("_k", F.lit(1))
    both = seen.join(lists.select("_k", expected.alias("chance")), "_k")
    observed, chance = F.col("off") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    value = F.when(chance == 0, F.when(observed == 0, 1.0)).otherwise(1.0 - observed / chance)
    return both.select(F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"), F.round(1.0 - observed, 6).alias("observed"), F.round(1.0 - chance, 6).alias("expected"), F.round(value, 6).alias("kappa"))


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: str) -> DataFrame:
    """The per_stratum rows of each stratum that come first in the order of sha256(key, seed)."""
    order = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)
    w = Window.partitionBy(stratum).orderBy(order, key)
    return df.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= per_stratum)


class RunsDiffer(ValueError):
    """Two runs that should have the same questions have not."""


def set_digest(rows: DataFrame, keys: list[str]) -> tuple[int, int, int, int]:
    """Of the distinct keys of rows: their number, the xor and the sum of their hashes, and how many rows repeat a key. The same for
    the same set in any order; one aggregate."""
    h = F.xxhash64(*[F.struct(F.col(k).isNull(), F.col(k)) for k in keys])
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n")).select(h.alias("h"), "_n")
    found = one.agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()
    return found[0], found[1], int(found[2]), found[3]


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def unmatched(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): each key of one run that the other lacks; nulls are keys like others."""
    a, b = first.select(*keys).distinct(), second.select(*keys).distinct()
    only = lambda x, y, side: x.join(y, _null_safe(x, y, keys), "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "first").unionByName(only(b, a, "second"))


def aligned_runs(first: DataFrame, second: DataFrame, keys: list[str], mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Both runs, to be compared row by row. `strict`: RunsDiffer unless both have the same keys, each once; the digests of
    both sets decide, and only if these differ is the difference computed, ten keys of which the error names. `aligned_subset`:
    the rows whose keys both have; repeated keys are an error all the same."""
    if mode not in ("strict", "aligned_subset"):
        raise ValueError(f"unknown mode {mode!r}")
    a, b = set_digest(first, keys), set_digest(second, keys)
    if a[3] or b[3]:
        raise RunsDiffer(f"{a[3]} and {b[3]} rows repeat a key")
    if a == b:
        return first, second
    if mode == "strict":
        some = unmatched(first, second, keys).limit(10).collect()
        raise RunsDiffer("; ".join(f"only in the {r['side']} run: {', '.join(str(r[k]) for k in keys)}" for r in some))
    return first.join(second.select(*keys), _null_safe(first, second, keys), "left_semi"), second.join(first.select(*keys), _null_safe(second, first, keys), "left_semi")


def compare_runs(first: DataFrame, second: DataFrame, key: str, value: str, mode: str | None = None) -> DataFrame:
    """Comparison of two runs by key: both values and improved, regressed, unchanged, only_first or only_second. With a mode
    of aligned_runs() the runs are aligned first, so the last two do not occur."""
    if mode is not None:
        first, second = aligned_runs(first, second, [key], mode)
    a, b = first.select(key, F.col(value).alias("before"), F.lit(True).alias("_a")), second.select(key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    change = F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second").when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "regressed").otherwise("unchanged")
    return a.join(b, key, "full").select(key, "before", "after", change.alias("change"))


def conflicts(claims: DataFrame, by: list[str], value: str) -> DataFrame:
    """Keys that have more than one distinct value."""
    return claims.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count_distinct(value).alias("values"), F.count("*").alias("claims")).where("values > 1")


def support(rows: DataFrame) -> DataFrame:
    """Per query: independent passages (document, page, parent), sources, best rank, channels in order."""
    return rows.groupBy("query_id").agg(F.count_distinct(F.struct("document_id", "page", "parent_id")).alias("independent"), F.count_distinct("document_id").alias("sources"), F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def answerability(r: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(status, reason, level) from the signals support (supported, insufficient, conflicting, ambiguous), verified,
    entities, owner_uncertain, relation (true, false or null), entity_ok, field_ok, labelled, independent."""
    missing = (r["support"] == "insufficient") | (r["verified"] == 0)
    no_relation = F.coalesce(~r["relation"], F.lit(False))
    related = F.coalesce(r["relation"], F.lit(False))
    steps = [
        (r["support"] == "ambiguous", "AMBIGUOUS_QUERY", "AMBIGUOUS_ENTITY", "NONE"),
        (r["support"] == "conflicting", "CONFLICTING_EVIDENCE", "CONFLICTING_VALUES", "WEAK"),
        (missing & r["owner_uncertain"], "RETRIEVAL_UNCERTAIN", "ENTITY_OWNERSHIP_UNCERTAIN", "WEAK"),
        (missing & (r["entities"] > 0), "INSUFFICIENT_EVIDENCE", "ENTITY_NOT_SUPPORTED", "NONE"),
        (missing, "INSUFFICIENT_EVIDENCE", "FIELD_NOT_SUPPORTED", "NONE"),
        (no_relation, "RETRIEVAL_UNCERTAIN", "RELATION_NOT_SUPPORTED", "WEAK"),
        (~r["entity_ok"] | ~r["field_ok"], "RETRIEVAL_UNCERTAIN", "ENTITY_OR_FIELD_NOT_VERIFIED", "WEAK"),
        (related, "SUPPORTED", "DIRECT_RELATION_SUPPORT", "STRONG"),
        (r["labelled"], "SUPPORTED", "DIRECT_STRUCTURED_SUPPORT", "STRONG"),
        (r["independent"] >= 2, "SUPPORTED", "MULTIPLE_AGREEING_PASSAGES", "STRONG"),
        (F.lit(True), "SUPPORTED", "SINGLE_VERIFIED_PASSAGE", "ADEQUATE"),
    ]
    return tuple(F.coalesce(*[F.when(s[0], s[i]) for s in steps]) for i in (1, 2, 3))  # type: ignore[return-value]


def validation_report(rows: DataFrame, key: list[str], blank: list[str], enums: dict[str, list[str]]) -> DataFrame:
    """(problem, rows): blank cells, values outside an enumeration, rows of repeated keys."""
    tests = {f"blank_{c}": F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in blank}
    tests |= {f"enum_{c}": ~F.coalesce(F.col(c), F.lit("")).isin(*v) for c, v in enums.items()}
    one = rows.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    flat = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(k).alias("rows")) for k in tests])).alias("x")).select("x.*")
    again = rows.groupBy(*key).count().where("count > 1").agg(F.lit("duplicate_key").alias("problem"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
    return flat.unionByName(again)


def overlap_recall(answer: Column, reference: Column) -> Column:
    ref = T.content_tokens(reference)
    return F.coalesce(S.share(F.size(F.array_intersect(ref, T.content_tokens(answer))), F.size(ref)), F.lit(0.0))
