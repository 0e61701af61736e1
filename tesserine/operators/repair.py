"""Generation under a contract: prompts within a budget, answers judged, only those that fail made again, a bounded number of times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored
from . import contract as C

ROUNDS = 2


class PromptOverflow(ValueError):
    """The first evidence of a question does not fit its prompt."""


def within(evidence: Column, left: Column) -> Column:
    """struct<n, kept>: the excerpts of an array, in order, that fit what is left of a budget of words; one that does not fit
    is passed over."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + F.size(T.words(x))
        return F.when(n <= left, F.struct(n.alias("n"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    return F.aggregate(F.filter(evidence, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), start, add)


def prompted(tasks: DataFrame, budget: int) -> DataFrame:
    """tasks (query_id, question, field, entity, language, evidence: array in order) with `contract` and `prompt`, which has
    `budget` words at most besides its fixed lines. PromptOverflow if some task's first excerpt does not fit."""
    contract = C.contract(F.col("question"), F.col("field"), F.col("entity"), F.col("language"), F.col("evidence"))
    plan = C.fact_plan(F.col("question"), F.col("field"), F.col("evidence"), F.col("entity"))
    # stored: what follows reads both several times, and each time would repeat their rules in the plan
    rows = stored(tasks.withColumns({"contract": contract, "plan": plan}), "contracts")
    rows = rows.withColumns({"facts": C.prompt_block(F.col("contract"), F.col("plan")), "fits": within(F.col("evidence"), F.lit(budget) - F.size(T.words(F.col("question"))))})
    first = F.get(F.filter("evidence", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(0))
    rows = stored(rows.withColumn("lost", first.isNotNull() & ~F.coalesce(F.get("fits.kept", F.lit(0)) == first, F.lit(False))), "prompts")
    lost = [str(r[0]) for r in rows.where("lost").select("query_id").limit(10).collect()]
    if lost:
        raise PromptOverflow(f"the first evidence of {', '.join(lost)} does not fit {budget} words")
    head = F.concat_ws("\n", F.lit("Answer the question from the evidence alone."), F.concat(F.lit("Question: "), F.col("question")), F.col("facts"), F.lit("Evidence:"))
    return rows.withColumn("prompt", F.concat_ws("\n", head, F.array_join("fits.kept", "\n"))).drop("plan", "facts", "fits", "lost")


def repaired(rows: DataFrame, make: Callable[[Column], Column], judge: Callable[[Column], Column], rounds: int = ROUNDS) -> DataFrame:
    """rows (query_id, prompt, ...) with answer (null if none passed), passed, reason and attempts.

    make(prompt) is called for all rows, judge(answer) gives struct<passed, reason, details>; rows that fail are made again,
    the prompt saying what was wrong, `rounds` times at most. Each attempt is stored, so a model is asked once for it, and
    each round sees only the rows that failed.
    """
    open_, done = rows.withColumn("ask", F.col("prompt")), None
    for attempt in range(1, rounds + 2):
        made = open_.withColumn("answer", make(F.col("ask")))
        tried = stored(made.withColumn("v", judge(F.col("answer"))).withColumn("attempts", F.lit(attempt)), "attempts")
        last = attempt > rounds
        settled = tried if last else tried.where("v.passed")
        settled = settled.select(*rows.columns, F.when(F.col("v.passed"), F.col("answer")).alias("answer"), F.col("v.passed").alias("passed"), F.col("v.reason").alias("reason"), "attempts")
        done = settled if done is None else done.unionByName(settled)
        failing = tried.where("not v.passed")
        if last or not failing.limit(1).count():
            break
        said = F.concat_ws("\n", "prompt", F.concat(F.lit("Rejected answer: "), F.coalesce("answer", F.lit(""))), F.concat(F.lit("It was rejected for "), F.col("v.reason"), F.when(F.size("v.details") > 0, F.concat(F.lit(": "), F.array_join("v.details", ", "))).otherwise("")), F.lit("Answer again and mend that."))
        open_ = failing.withColumn("ask", said).drop("answer", "v", "attempts")
    return done


def generated(tasks: DataFrame, generate: Callable[[Column, Column], Column], budget: int, realise: Callable[[Column, Column], Column] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per task: query_id, answer (null if rejected), passed, reason, attempts (of the canonical answer and, after it,
    of its wording), retry_used.

    generate(prompt, evidence) answers; what breaks the task's contract is repaired. With realise(canonical, language), tasks in
    another language than English get their accepted answer worded in that, which must say the same (contract.realised)
    and is repaired likewise. A budget of words holds the question and the evidence of each prompt.
    """
    rows = prompted(tasks, budget)
    judged = lambda answer: C.kept(answer, F.col("contract"))
    evidence = F.array_join("evidence", "\n")
    out = stored(repaired(rows, lambda prompt: generate(prompt, evidence), judged, rounds), "canonical")
    if realise is not None:
        again = (F.col("language") != "english") & F.col("passed")
        asked = out.where(again).select("query_id", "language", "contract", F.col("answer").alias("canonical"), F.col("answer").alias("prompt"), F.col("attempts").alias("before"))
        said = repaired(asked, lambda prompt: realise(prompt, F.col("language")), lambda x: C.realised(F.col("canonical"), x, F.col("language"), F.col("contract")), rounds)
        said = said.select("query_id", "answer", "passed", "reason", (F.col("before") + F.col("attempts")).alias("attempts"))
        out = out.where(~F.coalesce(again, F.lit(False))).select("query_id", "answer", "passed", "reason", "attempts").unionByName(said)
    return out.select("query_id", "answer", "passed", "reason", "attempts", (F.col("attempts") > 1).alias("retry_used"))
