"""Rubrics, grading contracts and the consensus of several graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numbers import finite
from gleaner.functions.text import title_key

from .relational import dealt

DISAGREEMENT = 20.0
SAME = 1e-6


def spread_pct(spread: Column, maximum: Column) -> Column:
    """Spread as a percentage of the maximum; without a maximum 0 if there is none, else 100."""
    return F.when(maximum > 0, spread / maximum * 100).when(F.abs(spread) <= 1e-9, F.lit(0.0)).otherwise(F.lit(100.0))


def consensus_criteria(grades: DataFrame, run: str = "run", threshold: float = DISAGREEMENT) -> DataFrame:
    """run, criterion, n, max_score, average, spread, spread_pct, disagreement.

    grades: run, role, criterion, score, max_score, one row per grader and criterion. Everything is a partial aggregate.
    """
    spread = F.max("score") - F.min("score")
    out = grades.groupBy(run, "criterion").agg(F.count("*").alias("n"), F.min("max_score").alias("max_score"), F.avg("score").alias("average"), spread.alias("spread"))
    pct = spread_pct(F.col("spread"), F.col("max_score"))
    return out.withColumns({"spread_pct": pct, "disagreement": pct > threshold})


def consensus_totals(grades: DataFrame, run: str = "run", threshold: float = DISAGREEMENT) -> DataFrame:
    """run, n, max_score, average, spread, spread_pct, n_disagreements, needs_review; equal totals with opposite criteria need a
    review as well. Rows as in consensus_criteria."""
    totals = grades.groupBy(run, "role").agg(F.sum("score").alias("t"), F.sum("max_score").alias("m"))
    spread = F.max("t") - F.min("t")
    runs = totals.groupBy(run).agg(F.count("*").alias("n"), F.min("m").alias("max_score"), F.avg("t").alias("average"), spread.alias("spread"))
    split = consensus_criteria(grades, run, threshold).groupBy(run).agg(F.count_if("disagreement").alias("n_disagreements"))
    pct = spread_pct(F.col("spread"), F.col("max_score"))
    return runs.join(split, run).withColumns({"spread_pct": pct, "needs_review": (pct > threshold) | (F.col("n_disagreements") > 0)})


def consensus_guards(grades: DataFrame, run: str = "run") -> DataFrame:
    """run and the first rule that forbids a consensus: too_few, repeated_role, criteria_differ, maxima_differ; else ok.

    A run's graders are dealt over tasks by run and role, in shares of a number of rows, so the tables of a task are small whatever the input."""
    own = dealt(grades.select(run, "role", "criterion", "max_score"), [run, "role"], grades.count())
    named = own.groupBy(run, "role", "criterion").agg(F.count("*").alias("k"), F.sum("max_score").alias("m"))
    roles = named.groupBy(run, "role").agg(
        F.sum("k").alias("rows"), F.count("criterion").alias("names"), F.sum(F.xxhash64("criterion").cast("decimal(38,0)") * F.col("k")).alias("set"), F.sum("m").alias("m"))
    runs = roles.groupBy(run).agg(
        F.count("*").alias("n"), F.max(F.col("rows") > F.col("names")).alias("repeated"), (F.min("set") != F.max("set")).alias("differ"), (F.max("m") - F.min("m") > SAME).alias("maxima"))
    rule = F.when(F.col("n") < 2, "too_few").when(F.col("repeated"), "repeated_role").when(F.col("differ"), "criteria_differ").when(F.col("maxima"), "maxima_differ").otherwise("ok")
    return runs.select(run, "n", rule.alias("state"))


def rubric_issues(rubric: Column, max_score: Column, tolerance: float = 0.01) -> Column:
    """What is wrong with a rubric (array of name, max_score): empty, blank_name, repeated_name, bad_score, bad_max, sum_differs."""
    names = F.transform(rubric, lambda r: title_key(r["name"]))
    scores = F.transform(rubric, lambda r: r["max_score"])
    good = F.forall(scores, lambda s: finite(s) & (s > 0))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.coalesce(s, F.lit(0.0)))
    filled = F.coalesce(F.size(rubric), F.lit(0)) > 0
    good_max = finite(max_score) & (max_score > 0)
    return F.array_compact(F.array(
        F.when(~filled, "empty"),
        F.when(filled & F.exists(names, lambda n: n == ""), "blank_name"),
        F.when(filled & (F.size(F.array_distinct(names)) < F.size(names)), "repeated_name"),
        F.when(filled & ~good, "bad_score"),
        F.when(~F.coalesce(good_max, F.lit(False)), "bad_max"),
        F.when(filled & good & good_max & (F.abs(total - max_score) > tolerance), "sum_differs"),
    ))


def contract_violation(output: Column, rubric: Column, max_score: Column) -> Column:
    """The first rule that a grader's output breaks; null if none.

    output: unreadable, unreadable_reason, total_score, max_score, criteria (array of name, score, max_score),
    confidence. rubric: array of name, max_score.
    """
    names = lambda c: F.transform(c, lambda x: F.trim(x["name"]))
    bad = F.exists(output["criteria"], lambda x: ~F.coalesce(finite(x["score"]) & (x["score"] >= 0) & (x["score"] <= x["max_score"] + SAME), F.lit(False)))
    maxima = F.exists(output["criteria"], lambda x: ~F.exists(rubric, lambda r: (F.trim(r["name"]) == F.trim(x["name"])) & (F.abs(r["max_score"] - x["max_score"]) <= SAME)))
    total = F.aggregate(output["criteria"], F.lit(0.0), lambda a, x: a + x["score"])
    return F.coalesce(
        F.when(output["unreadable"].isNull(), "unreadable_missing"),
        F.when(output["unreadable"] & (F.coalesce(F.trim(output["unreadable_reason"]), F.lit("")) == ""), "reason_missing"),
        F.when(~F.coalesce(output["confidence"].between(0, 1), F.lit(False)), "confidence_range"),
        F.when(F.abs(output["max_score"] - max_score) > SAME, "max_differs"),
        F.when(F.size(F.array_except(names(rubric), names(output["criteria"]))) > 0, "criteria_missing"),
        F.when(F.size(F.array_except(names(output["criteria"]), names(rubric))) > 0, "criteria_extra"),
        F.when(F.size(F.array_distinct(names(output["criteria"]))) < F.size(output["criteria"]), "criteria_repeated"),
        F.when(bad, "score_range"),
        F.when(maxima, "criterion_max_differs"),
        F.when(F.abs(total - output["total_score"]) > SAME, "total_differs"),
    )


def needs_review(output: Column) -> Column:
    """An unreadable work is reviewed, whatever else the output says."""
    return F.coalesce(output["unreadable"], F.lit(False)) | F.coalesce(output["needs_review"], F.lit(False))


def substantive(asked: Column, unreadable: Column, reasons: Column, confidence_word: str = "confidence") -> Column:
    """Whether a review was asked for because of anything but the model's own confidence."""
    concrete = F.exists(reasons, lambda r: ~F.lower(r).contains(confidence_word))
    return F.coalesce(asked, F.lit(False)) & (F.coalesce(unreadable, F.lit(False)) | (F.coalesce(F.size(reasons), F.lit(0)) <= 0) | concrete)


def completed_grades(steps: Column) -> Column:
    """The steps of a log that are finished grades with a result."""
    return F.filter(steps, lambda s: (s["type"] == "grade") & (s["status"] == "completed") & s["result"].isNotNull())


def pipeline_violation(steps: Column) -> Column:
    """The first rule that a list of steps (type, model, role, temperature, threshold) breaks; null if none."""
    types = F.transform(steps, lambda s: s["type"])
    grades = F.filter(steps, lambda s: s["type"] == "grade")
    roles = F.transform(grades, lambda s, i: F.coalesce(F.lower(F.trim(s["role"])), F.when(i == 0, "primary").when(i == 1, "skeptic").otherwise(F.concat(F.lit("grader_"), (i + 1).cast("string")))))
    first_grade, consensus = F.array_position(types, "grade"), F.array_position(types, "consensus")
    before = F.size(F.filter(F.slice(types, 1, F.greatest(consensus.cast("int"), F.lit(1))), lambda t: t == "grade"))
    return F.coalesce(
        F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, "no_steps"),
        F.when(F.exists(types, lambda t: ~F.coalesce(t.isin("ocr", "grade", "consensus"), F.lit(False))), "unknown_type"),
        F.when((consensus > 0) & (consensus < F.size(steps)), "step_after_consensus"),
        F.when((F.size(F.filter(types, lambda t: t == "ocr")) > 1) | (F.exists(F.filter(types, lambda t, i: i + 1 > first_grade), lambda t: t == "ocr") & (first_grade > 0)), "ocr_not_first"),
        F.when(F.exists(grades, lambda s: F.coalesce(F.trim(s["model"]), F.lit("")) == ""), "model_missing"),
        F.when(F.exists(roles, lambda r: ~r.rlike("^[a-z][a-z0-9_]*$")), "bad_role"),
        F.when(F.exists(grades, lambda s: ~s["temperature"].between(0, 2)), "temperature_range"),
        F.when((consensus > 0) & (before < 2), "too_few_grades"),
        F.when(F.exists(steps, lambda s: (s["type"] == "consensus") & ~s["threshold"].between(0, 100)), "threshold_range"),
        F.when(F.size(grades) == 0, "no_grade"),
        F.when((consensus > 0) & (F.size(F.array_distinct(roles)) < F.size(roles)), "repeated_role"),
    )


def preflight(run: Column) -> Column:
    """The first thing that a run (task_text, rubric, needs_ocr, n_files, ocr_text, n_models, n_graders) lacks; null if it can start."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.coalesce(
        F.when(blank(run["task_text"]), "task_text"),
        F.when(F.coalesce(F.size(run["rubric"]), F.lit(0)) <= 0, "rubric"),
        F.when(run["needs_ocr"] & (run["n_files"] == 0) & blank(run["ocr_text"]), "files"),
        F.when(run["n_models"] < run["n_graders"], "model"),
    )
