"""Gates that decide whether a task may be used: sanity, verdict, approval, export readiness, invalidation, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fingerprint, text

from .grading import rubric_issues

#: What a critic has to confirm.
CRITIC_CHECKS = ("statement_complete", "solution_correct", "answer_matches_solution", "units_consistent", "data_sufficient", "single_answer", "answers_agree")
TRUSTED = ("course_policy", "course_lecture", "reference")
FORMATS = ("numeric", "choice", "text", "formula")
POLICY = 3


def yes(c: Column) -> Column:
    """A condition that does not hold where it is unknown."""
    return F.coalesce(c, F.lit(False))


def empty(c: Column) -> Column:
    """A list that is there and has nothing in it."""
    return yes(F.size(c) == 0)


def sanity_issues(statement: Column, solution: Column, answer: Column, rubric: Column, max_score: Column) -> Column:
    """Short statements and solutions, a missing answer, and what is wrong with the rubric."""
    short = lambda c, n: F.length(F.trim(text(c))) < n
    own = F.array_compact(F.array(F.when(short(statement, 30), "short_statement"), F.when(short(solution, 20), "short_solution"), F.when(short(answer, 1), "no_answer")))
    return F.concat(own, rubric_issues(rubric, max_score))


def current_decision(v: Column, fresh: Column) -> Column:
    """Whether a validation holds in all its parts. fresh: its fingerprint is that of the task as it is.

    v: verdict, answer_format, task_kind, content_fingerprint, policy_version, decision_capable, solver_status, solver_verdict,
    verifier_status, verifier_verdict, cross_verdict, critic (status, checks, issues), chemistry (admission_effect,
    blocking, indeterminate, warnings, required, passed), solution_verdict, data (status, unknown_numbers, unknown_sources),
    lineage (status, unbound), sanity_issues, duplicate, reasons.
    """
    needs_rules = yes(v["task_kind"] == "calculation") | yes(v["answer_format"] == "numeric")
    effect = v["chemistry"]["admission_effect"]
    parts = [
        v["verdict"] == "validated", v["answer_format"].isin(*FORMATS), F.trim(v["content_fingerprint"]) != "", v["policy_version"] == POLICY, v["decision_capable"],
        *(v[k] == "match" for k in ("solver_status", "solver_verdict", "verifier_status", "verifier_verdict", "cross_verdict", "solution_verdict")),
        v["critic"]["status"] == "pass", *(F.try_element_at(v["critic"]["checks"], F.lit(k)) for k in CRITIC_CHECKS), empty(v["critic"]["issues"]),
        (effect == "pass") | (~needs_rules & (effect == "limited")), *(empty(v["chemistry"][k]) for k in ("blocking", "indeterminate", "warnings")),
        F.size(F.array_except(F.coalesce(v["chemistry"]["required"], F.array().cast("array<string>")), v["chemistry"]["passed"])) == 0,
        v["data"]["status"] == "ok", F.coalesce(F.size(v["data"]["unknown_numbers"]), F.lit(0)) <= 0, F.coalesce(F.size(v["data"]["unknown_sources"]), F.lit(0)) <= 0,
        v["lineage"]["status"] == "ok", empty(v["lineage"]["unbound"]), empty(v["sanity_issues"]), ~v["duplicate"], empty(v["reasons"]), fresh,
    ]
    return reduce(and_, map(yes, parts))


def approved(a: Column, fresh: Column, schema_version: int = 1) -> Column:
    """Whether a manual approval (basis, schema_version, reviewed_by, reviewed_at, content_fingerprint, reason) is complete."""
    parts = [
        a["basis"] == "teacher_override", a["schema_version"] == schema_version, F.trim(a["reviewed_by"]) != "", F.try_to_timestamp(F.trim(a["reviewed_at"])).isNotNull(),
        F.trim(a["content_fingerprint"]) != "", F.length(F.trim(a["reason"])) >= 10, fresh,
    ]
    return reduce(and_, map(yes, parts))


def export_ready(status: Column, is_approved: Column, decision: Column, approval: Column) -> Column:
    return (yes(status == "validated") & ~yes(is_approved) & yes(decision)) | (yes(status == "approved") & yes(is_approved) & yes(approval))


def partitions(status: Column, ready: Column) -> dict[str, Column]:
    """The three shelves of a task list: ready by itself, ready by hand, in need of attention."""
    return {"auto_ready": (status == "validated") & ready, "manual_ready": (status == "approved") & ready, "attention": ~ready & (status != "rejected")}


def content_fingerprint(statement: Column, solution: Column, answer: Column, rubric: Column, max_score: Column, config: Column) -> Column:
    """The digest of all that a decision about a task rests on."""
    return fingerprint(F.struct(statement.alias("statement"), solution.alias("solution"), answer.alias("answer"), rubric.alias("rubric"), max_score.alias("max_score"), config.alias("config")))


def normal_config(tolerance: Column, sheets: Column, run_solver: Column) -> Column:
    """A validation's settings in one form: defaults filled in, ids sorted and distinct, strict booleans."""
    return F.struct(F.coalesce(tolerance.try_cast("double"), F.lit(5.0)).alias("tolerance_pct"), F.array_sort(F.array_distinct(F.coalesce(sheets, F.array().cast("array<string>")))).alias("sheet_ids"), F.coalesce(run_solver, F.lit(True)).alias("run_solver"))


def verdict(gates: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(all gates hold, the names of those that don't)."""
    failed = F.array_compact(F.array(*[F.when(~yes(c), name) for name, c in gates]))
    return F.size(failed) == 0, failed


def critic_gate(critic: Column) -> Column:
    """A verdict of pass, all checks true and no issue."""
    return reduce(and_, [yes(critic["verdict"] == "pass"), empty(critic["issues"]), *(yes(F.try_element_at(critic["checks"], F.lit(k))) for k in CRITIC_CHECKS)])


def entailment(answer_format: Column, solver: Column, verifier: Column, cross: Column, rules_passed: Column) -> dict[str, Column]:
    """Which of three ways leads from incomplete comparisons to a match that the critic may confirm.

    solver, verifier, cross: verdict, n_missing, n_unexpected of a comparison. A way is open if nothing contradicts it: the independent answers agree;
    or one matches and the other is only incomplete; or both are only incomplete and the rules passed.
    """
    clean = lambda c: yes(c["n_missing"] == 0) & yes(c["n_unexpected"] == 0)
    match, part = (lambda c: yes(c["verdict"] == "match")), (lambda c: yes(c["verdict"].isin("incomplete", "uncertain")))
    wordy = answer_format.isin("text", "formula")
    return {
        "semantic": match(cross) & part(solver) & part(verifier) & (wordy | rules_passed) & clean(solver) & clean(verifier),
        "solution_backed": ((match(solver) & part(verifier) & clean(verifier)) | (match(verifier) & part(solver) & clean(solver))) & ~yes(cross["verdict"] == "mismatch") & (wordy | rules_passed),
        "reference_anchored": match(solver) & match(verifier) & part(cross) & clean(cross) & rules_passed,
    }


def numeric_override(checks: Column, answer_format: Column, all_match: Column) -> Column:
    """A critic's checks; for numeric answers that all match, the three that the numbers decide are set."""
    sure = F.create_map(*[x for k in ("answer_matches_solution", "answers_agree", "solution_correct") for x in (F.lit(k), F.lit(True))])
    keep = F.map_filter(checks, lambda k, v: ~k.isin("answer_matches_solution", "answers_agree", "solution_correct"))
    return F.when(yes(answer_format == "numeric") & yes(all_match), F.map_concat(keep, sure)).otherwise(checks)


def promoted(report: Column, basis: str) -> Column:
    """A comparison whose verdict becomes a match; what it was and why is kept."""
    return report.withField("previous", report["verdict"]).withField("basis", F.lit(basis)).withField("verdict", F.lit("match"))


def invalidate(tasks: DataFrame, affected: Column, reason: str) -> DataFrame:
    """tasks (status, reasons, approval, content_fingerprint, previous_fingerprint): decided ones that are affected are to be
    reviewed again, with the reason first, their approval gone and their fingerprint kept."""
    hit = yes(affected) & F.col("status").isin("validated", "approved")
    return tasks.withColumns({
        "previous_fingerprint": F.when(hit, F.col("content_fingerprint")).otherwise(F.col("previous_fingerprint")),
        "reasons": F.when(hit, F.concat(F.array(F.lit(reason)), F.coalesce("reasons", F.array().cast("array<string>")))).otherwise(F.col("reasons")),
        "approval": F.when(~hit, F.col("approval")),
        "status": F.when(hit, "needs_review").otherwise(F.col("status")),
    })


def source_violation(visibility: Column, authority: Column, parsed: Column) -> Column:
    """Why a sheet may not be shown to students; null if it may, or need not."""
    return F.when(visibility == "student", F.coalesce(F.when(~yes(authority.isin(*TRUSTED)), "untrusted"), F.when(~yes(parsed), "not_parsed")))


def quarantined(visibility: Column, authority: Column) -> Column:
    """The visibility that holds: what is not verified is not shown to students."""
    return F.when((authority == "unverified") & (visibility == "student"), "quarantine").otherwise(visibility)


def failure_class(reasons: Column, classes: Sequence[tuple[str, str]]) -> Column:
    """The first class, in order of priority, whose pattern any of the reasons has; other without one, null without reasons."""
    joined = F.lower(F.array_join(reasons, "\n"))
    found = F.coalesce(*[F.when(joined.rlike(pattern), name) for name, pattern in classes], F.lit("other"))
    return F.when(F.size(reasons) > 0, found)


def quality_summary(tasks: DataFrame, key: str) -> DataFrame:
    """key, candidates, ready, discarded, complete: a batch is complete if it has as many ready tasks as were asked for."""
    ready, gone = F.count_if("ready"), F.count_if(F.col("status") == "rejected")
    return tasks.groupBy(key).agg(F.count("*").alias("candidates"), ready.alias("ready"), gone.alias("discarded"), (ready >= F.max("requested")).alias("complete"))


def refill(requested: Column) -> dict[str, Column]:
    """Bounds of the refill of a batch: candidates and calls."""
    return {"candidate_budget": F.least(requested * 3, requested + 20), "call_limit": F.ceil(requested / 2).cast("long") + 3}


def candidate_error(statement: Column, data_used: Column, facts: Column, block: Column) -> Column:
    """The first thing that a generated candidate lacks; null if nothing. facts: map of block name to text."""
    return F.coalesce(
        F.when(F.trim(text(statement)) == "", "statement"),
        F.when(data_used.isNull(), "data_used"),
        F.when(facts.isNull() | (F.length(F.to_json(facts)) > 20_000), "facts"),
        F.when(block.isNotNull() & (block != "auto") & ~yes(F.map_contains_key(facts, block)), "block"),
    )


def task_row(item: Column, template_rubric: Column) -> dict[str, Column]:
    """Columns of a task from a model's item (statement, answer, max_score as text, rubric): defaults, and the template's rubric
    before the item's."""
    return {
        "statement": F.trim(text(item["statement"])), "answer": F.trim(text(item["answer"])),
        "max_score": F.coalesce(item["max_score"].try_cast("double"), F.lit(10.0)), "rubric": F.coalesce(template_rubric, item["rubric"], F.array().cast("array<struct<name:string,max_score:double>>")),
    }


def interrupted(status: Column) -> Column:
    """What was running when the process ended has failed."""
    return F.when(status.isin("running", "parsing", "pending"), "failed").otherwise(status)


def model_use(model: Column, decision: Sequence[str], advisory: Sequence[str]) -> Column:
    """decision, advisory or unlisted; a model that is on both lists is advisory."""
    key = F.lower(F.trim(text(model)))
    return F.when(key.isin(*advisory), "advisory").when(key.isin(*decision), "decision").otherwise("unlisted")
