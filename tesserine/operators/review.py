"""Human review: balanced samples, blinding, checks of scores, means, rates and agreement of reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import evaluation as E
from .retrieval import ranked

# Fixed values.
SCORES = ("correctness", "relevance", "groundedness", "completeness", "naturalness")
OUTCOMES = ("ACCEPT", "PARTIAL", "REJECT")
HIDDEN = ("evaluation_id", "answer_strategy", "answerability_status")


class ReviewError(ValueError):
    """Review rows that cannot be counted."""


def _order(key: str, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)


def sample(rows: DataFrame, size: int, seed: int = 42, key: str = "evaluation_id", by: str = "language", balance: tuple[str, ...] = ("answer_strategy", "answerability_status", "intent", "difficulty")) -> DataFrame:
    """`size` rows: equal shares of each value of `by` (what is left over goes to the first values), and inside a share rows
    whose combination of the `balance` columns has been drawn least; drawn in the order of a hash of key and seed.

    Each combination's rows are numbered, then the first of every combination come before the second ones: two windows,
    the first of which leaves at most `size` rows of a combination.
    """
    own = rows.withColumn("_draw", _order(key, seed))
    spread = ranked(own, [by, *balance], [F.asc("_draw"), F.asc(key)], size, "_turn")
    every = ranked(spread, [by], [F.asc("_turn"), F.asc("_draw"), F.asc(key)], size, "_place")
    values = sorted((r[0] for r in rows.select(by).distinct().collect()), key=lambda v: (v is None, str(v)))  # a few languages
    if not values:
        return rows.limit(0)
    share = {v: size // len(values) + (i < size % len(values)) for i, v in enumerate(values)}
    within = F.lit(0)
    for v, n in share.items():
        within = F.when(F.col(by).eqNullSafe(F.lit(v)), n).otherwise(within)
    return every.where(F.col("_place") <= within).drop("_draw", "_turn", "_place")


def blinded(sampled: DataFrame, seed: int = 42, key: str = "evaluation_id") -> tuple[DataFrame, DataFrame]:
    """(review rows without what tells the system, key rows): both have review_id R00001, R00002, ... in a shuffled order.
    A sample is small, so it is numbered in one window."""
    rows = ranked(sampled.withColumn("_all", F.lit(1)), ["_all"], [_order(key, seed + 1), F.asc(key)], None, "_n").drop("_all")
    rows = rows.withColumn("review_id", F.format_string("R%05d", "_n")).drop("_n")
    target = F.concat_ws("::", F.nullif(F.col("system_id"), F.lit("")), F.col(key)) if "system_id" in rows.columns else F.col(key)
    keys = rows.select("review_id", key, target.alias("review_target_id"), *[c for c in ("system_id", *HIDDEN[1:], "language") if c in rows.columns])
    return rows.drop(*HIDDEN, "system_id"), keys


def unblinded(reviews: DataFrame, keys: DataFrame) -> DataFrame:
    """Reviews with evaluation_id from the key. ReviewError for a repeated review_id in the key or one that it lacks."""
    if keys.groupBy("review_id").count().where("count > 1").limit(1).count():
        raise ReviewError("the key repeats a review_id")
    own = keys.select("review_id", F.coalesce("review_target_id", "evaluation_id").alias("evaluation_id"))
    if reviews.join(own, "review_id", "left_anti").limit(1).count():
        raise ReviewError("a review_id is not in the key")
    return reviews.drop("evaluation_id").join(own, "review_id")


def problems(reviews: DataFrame, known: DataFrame) -> DataFrame:
    """(evaluation_id, reviewer_id, problem): unknown ids, a reviewer's second review of a row, values out of range."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = reviews.withColumn("reviewer_id", F.when(blank("reviewer_id") == "", "reviewer-1").otherwise(blank("reviewer_id")))
    own = rows.join(known.select("evaluation_id", F.lit(True).alias("_known")), "evaluation_id", "left")
    twice = rows.groupBy("evaluation_id", "reviewer_id").count().where("count > 1").select("evaluation_id", "reviewer_id", F.lit("duplicate_review").alias("problem"))
    tests = [("unknown_evaluation_id", F.col("_known").isNull()), *[(f"{c}_not_1_to_5", ~blank(c).isin("", "1", "2", "3", "4", "5")) for c in SCORES if c in rows.columns]]
    tests += [(f"{c}_not_allowed", ~F.upper(blank(c)).isin("", *ok)) for c, ok in (("semantic_consistency", ("PASS", "FAIL")), ("overall_acceptability", OUTCOMES)) if c in rows.columns]
    return own.select("evaluation_id", "reviewer_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests]))).alias("problem")).unionByName(twice)


def metrics(reviews: DataFrame, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """Means of the scores with their numbers, the pass rate, and accept, partial and reject rates with intervals; per group
    of at least `least` rows if `by` is given. Blank cells are passed over; a measure of none is null."""
    score = lambda c: F.col(c).try_cast("double")
    said = lambda c: F.nullif(F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit(""))
    out = reviews.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), *[F.round(F.avg(score(c)), 6).alias(f"mean_{c}") for c in SCORES], *[F.count(score(c)).alias(f"{c}_n") for c in SCORES],
        F.count_if(said("semantic_consistency") == "PASS").alias("_pass"), F.count(said("semantic_consistency")).alias("semantic_n"), F.count(said("overall_acceptability")).alias("acceptability_n"),
        *[F.count_if(said("overall_acceptability") == o).alias(f"_{o}") for o in OUTCOMES],
    )
    out = out.withColumn("semantic_pass_rate", F.round(S.share(F.col("_pass"), F.col("semantic_n")), 6))
    for o in OUTCOMES:
        low, high = S.wilson(F.col(f"_{o}"), F.col("acceptability_n"))
        out = out.withColumns({f"{o.lower()}_rate": F.round(S.share(F.col(f"_{o}"), F.col("acceptability_n")), 6), f"{o.lower()}_low": F.round(low, 6), f"{o.lower()}_high": F.round(high, 6)})
    out = out.drop("_pass", *[f"_{o}" for o in OUTCOMES])
    return out.where(F.col("n") >= least) if by else out


def pairs(reviews: DataFrame, column: str, key: str = "evaluation_id") -> DataFrame:
    """(key, a, b): the values of each two reviewers of a row, the one whose name comes first as a; blanks are dropped."""
    v = reviews.where(F.trim(F.coalesce(column, F.lit(""))) != "").select(key, "reviewer_id", F.trim(column).alias("v"))
    a, b = v.select(key, F.col("reviewer_id").alias("_a"), F.col("v").alias("a")), v.select(key, F.col("reviewer_id").alias("_b"), F.col("v").alias("b"))
    return a.join(b, key).where("_a < _b").select(key, "a", "b")


def agreement(reviews: DataFrame) -> DataFrame:
    """(field, n, observed, expected, kappa) over all pairs of reviewers: weighted by squared distance for scores of 1 to 5,
    nominal for the outcomes."""
    out = None
    for c in (*SCORES, "semantic_consistency", "overall_acceptability"):
        if c not in reviews.columns:
            continue
        both = pairs(reviews, c)
        if c in SCORES:
            one = E.kappa(both.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")), "a", "b", 5)
        else:
            code = lambda x: F.conv(F.substring(F.md5(F.upper(x)), 1, 8), 16, 10).cast("double")
            one = E.kappa(both.select(code(F.col("a")).alias("a"), code(F.col("b")).alias("b")), "a", "b")
        one = one.select(F.lit(c).alias("field"), "n", "observed", "expected", "kappa")
        out = one if out is None else out.unionByName(one)
    return out
