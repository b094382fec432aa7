"""Contracts of stored records: claimed sources, facts, rubrics, validation settings, solver reports, releases, window results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let, markdown_digest, text, title_key, topics

from .admission import yes

#: The blocks of facts that a task may carry.
FACT_BLOCKS = ("stoichiometry", "dilution", "titration", "gravimetry", "conductometry", "faraday", "calibration", "bet", "smoluchowski", "dlvo")
FACT_CHARS = 20_000
SOLUTION_CHARS = 4_000


def normal_data_used(data_used: Column) -> Column:
    """data_used (array of sheet_title, values) with trimmed titles and values; null if it is null or any entry is malformed."""
    good = F.forall(data_used, lambda x: (F.trim(text(x["sheet_title"])) != "") & yes(F.size(x["values"]) > 0) & yes(F.forall(x["values"], lambda v: F.trim(text(v)) != "")))
    clean = F.transform(data_used, lambda x: F.struct(F.trim(x["sheet_title"]).alias("sheet_title"), F.transform(x["values"], lambda v: F.trim(v)).alias("values")))
    return F.when(yes(good), clean)


def normal_facts(json: Column) -> Column:
    """The JSON object of facts; null if it doesn't parse, has a block that is not known, or is too long."""
    v = F.try_parse_json(json)
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    known = F.size(F.array_except(names, F.array(*map(F.lit, FACT_BLOCKS)))) == 0
    return F.when(yes(known) & (F.length(json) <= FACT_CHARS), F.to_json(v))


def parsed_rubric(rubric: Column) -> Column:
    """rubric, problem: criteria (criterion_name or name, max_score) as name, max_score; the first of blank_name, repeated_name and
    bad_score that holds, with a null rubric then."""
    named = F.transform(rubric, lambda r: F.struct(F.trim(F.coalesce(F.nullif(F.trim(r["criterion_name"]), F.lit("")), r["name"])).alias("name"), r["max_score"].try_cast("double").alias("max_score")))
    names = lambda x: F.transform(x, lambda r: title_key(r["name"]))
    problem = lambda x: F.coalesce(
        F.when(F.exists(x, lambda r: text(r["name"]) == ""), "blank_name"), F.when(F.size(F.array_distinct(names(x))) < F.size(x), "repeated_name"),
        F.when(F.exists(x, lambda r: ~yes((r["max_score"] >= 0) & (r["max_score"] < float("inf")))), "bad_score"))
    return let(named, lambda x: let(problem(x), lambda p: F.struct(F.when(p.isNull(), x).alias("rubric"), p.alias("problem"))))


def validation_contract(rendered: Column, selected: Column, stored: Column, template: Column, default: float = 5.0) -> Column:
    """sheet_ids, tolerance_pct: rendered ids win over selected ones even when there are none; a stored tolerance over the template's."""
    ids = F.array_sort(F.array_distinct(F.coalesce(rendered, selected, F.array().cast("array<string>"))))
    return F.struct(ids.alias("sheet_ids"), F.coalesce(stored, template, F.lit(default)).alias("tolerance_pct"))


def discarded(status: Column, generated: Column) -> Column:
    """A revalidated task that did not pass is dropped if a machine wrote it."""
    return ~yes(status == "validated") & yes(generated)


def solver_report(solution: Column, answer: Column, verdict: Column, error: Column) -> Column:
    """status, solution (cut), complete, reason of one independent solution."""
    status = F.when(text(error) != "", "error").otherwise(verdict)
    complete = (text(error) == "") & (F.trim(text(answer)) != "") & (F.trim(text(solution)) != "")
    reason = F.when(status == "error", F.concat(F.lit("error: "), text(error))).when(~complete, "incomplete outcome").when(status != "match", F.concat(F.lit("answer: "), status))
    return F.struct(status.alias("status"), F.substring(text(solution), 1, SOLUTION_CHARS).alias("solution"), complete.alias("complete"), reason.alias("reason"))


def representation_only(comparison: Column) -> Column:
    """Whether a comparison is incomplete only because a number is given in two forms: nothing is missing, and every unexpected
    number is, within a thousandth, one of the reference numbers or a power of ten of one.

    comparison: verdict, missing, unexpected, reference (arrays of numbers).
    """
    ratio = lambda u: F.exists(comparison["reference"], lambda r: F.abs(let(F.log10(F.abs(F.try_divide(u, r))), lambda x: x - F.round(x))) <= 5e-4)
    return yes(comparison["verdict"] == "incomplete") & yes(F.size(comparison["missing"]) == 0) & yes(F.forall(comparison["unexpected"], lambda u: yes(ratio(u))))


def release_problem(release: Column, content: Column) -> Column:
    """The first thing wrong with a release binding (slug, title, sha256, version, manifest_version) of a Markdown content; null if none."""
    return F.coalesce(
        F.when((F.trim(text(release["slug"])) == "") | (F.trim(text(release["title"])) == ""), "field_missing"),
        F.when(~text(release["sha256"]).rlike("^[0-9a-f]{64}$"), "digest_format"),
        F.when(release["sha256"] != markdown_digest(content), "digest_differs"),
        F.when(~release["version"].eqNullSafe(release["manifest_version"]), "version_differs"),
    )


def merged_windows(results: DataFrame, key: str, window: str) -> DataFrame:
    """key, topics, summary, notes of the results of the windows of each text, in order: topics joined without repeats, the first
    summary and note that are not blank."""
    rows = results.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(window, "topics", "summary", "notes"))).alias("w"))
    first = lambda c: F.try_element_at(F.filter(F.transform("w", lambda x: F.trim(text(x[c]))), lambda x: x != ""), F.lit(1))
    joined = F.flatten(F.transform("w", lambda x: F.coalesce(x["topics"], F.array().cast("array<string>"))))
    return rows.select(key, topics(joined).alias("topics"), F.coalesce(first("summary"), F.lit("")).alias("summary"), F.coalesce(first("notes"), F.lit("")).alias("notes"))


def grading_message(parts: dict[str, Column]) -> Column:
    """`label:` and text of the sections that have one, joined by blank lines."""
    return F.concat_ws("\n\n", *[F.when(F.trim(text(c)) != "", F.concat(F.lit(f"{label}:\n"), F.trim(c))) for label, c in parts.items()])
