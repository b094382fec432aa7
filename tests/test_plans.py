from __future__ import annotations

import oracle
import pytest

from gleaner.plans import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert oracle.check(spark, SMALL, QUERIES[name], ORACLE_SQL[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_and_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_equation_search_reads_whole_texts(spark, tmp_path):
    """Document 0 gets a balanced equation, document 1 an unbalanced one; document 12 has an unbalanced one of its own far behind."""
    rows = [(0, "word " * 300), (1, "word " * 300), (12, "word " * 250 + "H2 + O2 -> H2O. " + "word " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.state for r in QUERIES["equation_search"](spark, str(tmp_path)).collect()}
    assert got == {0: "pass", 1: "fail", 12: "fail"}


def test_pipeline_steps_asks_the_operator_for_every_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gleaner.operators import grading

    monkeypatch.setattr(grading, "pipeline_violation", lambda steps: F.lit("asked"))
    assert {r.violation for r in QUERIES["pipeline_steps"](spark, SMALL).collect()} == {"asked"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["scan_prune_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F), " in plan
    assert "o_orderdate" not in plan


def test_latest_keeps_a_row_per_task_before_the_shuffle(spark):
    plan = QUERIES["latest_active_version"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_no_plan_has_a_cross_join(spark):
    for name, query in QUERIES.items():
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "CartesianProduct" not in plan, name


def test_balances_keep_signs_of_zero_and_all_digits(spark, tmp_path):
    amounts = [-0.0, 0.125, 2.675, -0.004, 1234567.891, 1e17, None]
    rows = [(3 * i + shape, x) for i, x in enumerate(amounts) for shape in range(3)]
    for name in oracle.TABLES:
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
    assert oracle.check(spark, str(tmp_path), QUERIES["balances"], ORACLE_SQL["balances"]) == len(rows)


#: Queries of rules, the columns that tell their outcome, and outcomes that all have to occur in the middle tables.
OUTCOMES = {
    "rubric_sum_contract": ("violation", {None, "reason_missing", "confidence_range", "max_differs", "criteria_missing", "score_range", "criterion_max_differs", "total_differs"}),
    "pipeline_steps": ("violation", {None, "no_steps", "unknown_type", "step_after_consensus", "ocr_not_first", "bad_role", "temperature_range", "no_grade"}),
    "run_preflight": ("missing", {None, "task_text", "rubric", "files", "model"}),
    "source_policy": ("violation", {None, "untrusted", "not_parsed"}),
    "candidate_contract": ("error", {None, "statement", "data_used", "facts", "block"}),
    "data_check": ("status", {"skipped", "invalid", "warn", "ok"}),
    "failure_histogram": ("class", {None, "form", "data", "other"}),
    "rule_units": ("state", {"fail", "warning", "pass", "not_applicable"}),
    "rule_balance": ("state", {"unparsed", "balanced", "unbalanced"}),
    "answer_units": ("verdict", {"match", "mismatch"}),
    "work_outcomes": ("state", {"committed", "retry", "failed"}),
    "equation_search": ("state", {"pass", "fail", "indeterminate", "not_applicable"}),
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_every_outcome_occurs(spark, name):
    column, wanted = OUTCOMES[name]
    found = {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert wanted <= found


def test_section_containment_finds_sections_of_any_length(spark, tmp_path):
    """Of two, four and many words, with cut words at their ends; rows that are there twice count twice. Long texts take no square of their words."""
    import time

    for name in oracle.TABLES:
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, "beta gamma"), (3, long), (4, None), (5, "alphabeta gammadelta")]
    sections = [(1, "a gamma"), (2, "pha beta gamma del"), (3, " ".join(f"w{i}" for i in range(700, 709))), (4, "?"), (5, "beta"), (6, "alpha beta gamma delta eps"), (7, "no such words here at all in it"), (8, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(sections, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    start = time.time()
    assert oracle.check(spark, str(tmp_path), QUERIES["section_containment"], ORACLE_SQL["section_containment"]) > 5
    assert time.time() - start < 60


@pytest.mark.parametrize("name", ["measurements", "rule_gravimetry", "rule_units", "rule_conductometry", "rule_faraday", "rule_bet_surface", "rule_balance", "answer_compare", "answer_units"])
def test_equal_texts_are_read_once(spark, name):
    """What is read of texts is a table of different ones before the rows are."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract" not in plan


def test_number_grammar_reads_a_text_once(spark):
    plan = QUERIES["number_grammar"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all") == 2  # tokens, and numbers among them


@pytest.mark.parametrize("name", ["dedup_bounded", "dedup_revalidation"])
def test_profiles_of_texts_are_made_once(spark, name):
    """Words and numbers of the texts are a table before it is ranged, numbered and compared."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract_all" not in plan
