"""Admission, provenance, grading and approval plans.

The driver's tables have no validations, rubrics or grades; plans derive them from existing columns by fixed rules, which
the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import admission as A
from gleaner.operators import grading as G
from gleaner.operators import provenance as P

from .registry import query, table


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as tasks: doc_id, text, quality, toxic, status."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "validated").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "approved").otherwise("draft")
    return joined.withColumn("status", status)


TASKS_SQL = """t AS (SELECT d.doc_id, text, source, quality, toxic, CASE WHEN quality = 1 THEN 'validated' WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'approved' ELSE 'draft' END AS status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def every(n: int) -> Column:
    return F.col("doc_id") % n == 0


def some_if(condition: Column, value: str) -> Column:
    return F.when(condition, F.array(F.lit(value))).otherwise(F.array().cast("array<string>"))


def validation() -> Column:
    """A validation whose parts fail for fixed shares of the tasks."""
    match = lambda n: F.when(every(n), "mismatch").otherwise("match")
    checks = F.create_map(*[x for i, k in enumerate(A.CRITIC_CHECKS) for x in (F.lit(k), (F.col("doc_id") % 97 != i))])
    critic = F.struct(F.when(every(23), "fail").otherwise("pass").alias("status"), checks.alias("checks"), some_if(every(29), "wording").alias("issues"))
    chemistry = F.struct(
        F.when(every(5), "limited").otherwise("pass").alias("admission_effect"), some_if(every(31), "x").alias("blocking"), some_if(F.lit(False), "x").alias("indeterminate"), some_if(every(37), "x").alias("warnings"),
        F.array(F.lit("chemistry.dilution")).alias("required"), some_if(~every(41), "chemistry.dilution").alias("passed"))
    data = F.struct(F.when(every(43), "warn").otherwise("ok").alias("status"), some_if(every(43), "1.5").alias("unknown_numbers"), F.lit(None).cast("array<string>").alias("unknown_sources"))
    lineage = F.struct(F.lit("ok").alias("status"), some_if(every(47), "x").alias("unbound"))
    return F.struct(
        F.when(every(7), "rejected").otherwise("validated").alias("verdict"), F.when(every(3), "text").otherwise("numeric").alias("answer_format"), F.when(every(3), "theory").otherwise("calculation").alias("task_kind"),
        F.sha2("text", 256).alias("content_fingerprint"), F.lit(A.POLICY).alias("policy_version"), F.lit(True).alias("decision_capable"), match(11).alias("solver_status"), match(11).alias("solver_verdict"),
        match(13).alias("verifier_status"), match(13).alias("verifier_verdict"), match(17).alias("cross_verdict"), match(19).alias("solution_verdict"), critic.alias("critic"), chemistry.alias("chemistry"),
        data.alias("data"), lineage.alias("lineage"), some_if(every(53), "x").alias("sanity_issues"), every(59).alias("duplicate"), some_if(F.lit(False), "x").alias("reasons"))


#: The planted validations and approvals as columns, and what has to hold of them.
PLANTED_SQL = """p AS (SELECT *, doc_id % 61 <> 0 AS fresh, CASE WHEN doc_id % 7 = 0 THEN 'rejected' ELSE 'validated' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'numeric' END AS answer_format, CASE WHEN doc_id % 3 = 0 THEN 'theory' ELSE 'calculation' END AS task_kind,
    sha256(text) AS fingerprint, list_transform([11, 11, 13, 13, 17, 19], lambda n: CASE WHEN doc_id % n = 0 THEN 'mismatch' ELSE 'match' END) AS comparisons, CASE WHEN doc_id % 23 = 0 THEN 'fail' ELSE 'pass' END AS critic,
    list_transform(range(7), lambda i: doc_id % 97 <> i) AS critic_checks, CASE WHEN doc_id % 29 = 0 THEN ['wording'] ELSE [] END AS critic_issues, CASE WHEN doc_id % 5 = 0 THEN 'limited' ELSE 'pass' END AS effect,
    CASE WHEN doc_id % 31 = 0 THEN ['x'] ELSE [] END AS blocking, CASE WHEN doc_id % 37 = 0 THEN ['x'] ELSE [] END AS warnings, ['chemistry.dilution'] AS required, CASE WHEN doc_id % 41 = 0 THEN [] ELSE ['chemistry.dilution'] END AS passed,
    CASE WHEN doc_id % 43 = 0 THEN 'warn' ELSE 'ok' END AS data_status, CASE WHEN doc_id % 43 = 0 THEN ['1.5'] ELSE [] END AS unknown_numbers, CASE WHEN doc_id % 47 = 0 THEN ['x'] ELSE [] END AS unbound, CASE WHEN doc_id % 53 = 0 THEN ['x'] ELSE [] END AS sanity, doc_id % 59 = 0 AS duplicate,
    CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS schema_version, CASE WHEN doc_id % 9 = 0 THEN 'yesterday' ELSE '2026-01-02T03:04:05Z' END AS reviewed_at, CASE WHEN doc_id % 6 = 0 THEN 'short' ELSE 'the statement was checked by hand' END AS reason FROM t)"""
DECISION_SQL = """coalesce(fresh AND verdict = 'validated' AND trim(fingerprint) <> '' AND len(list_filter(comparisons, lambda c: c <> 'match')) = 0 AND critic = 'pass' AND list_bool_and(critic_checks) AND len(critic_issues) = 0
    AND (effect = 'pass' OR effect = 'limited' AND task_kind <> 'calculation' AND answer_format <> 'numeric') AND len(blocking) + len(warnings) + len(unknown_numbers) + len(unbound) + len(sanity) = 0 AND list_has_all(passed, required) AND data_status = 'ok' AND NOT duplicate, false)"""
APPROVAL_SQL = "coalesce(fresh AND schema_version = 1 AND try_cast(reviewed_at AS TIMESTAMP) IS NOT NULL AND trim(fingerprint) <> '' AND length(trim(reason)) >= 10, false)"


def approval() -> Column:
    return F.struct(
        F.lit("teacher_override").alias("basis"), F.when(every(4), 0).otherwise(1).alias("schema_version"), F.lit("someone").alias("reviewed_by"), F.when(every(9), "yesterday").otherwise("2026-01-02T03:04:05Z").alias("reviewed_at"),
        F.sha2("text", 256).alias("content_fingerprint"), F.when(every(6), "short").otherwise("the statement was checked by hand").alias("reason"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = ~every(61)
    rows = tasks(spark, sf_dir).withColumn("v", validation()).withColumn("a", approval())
    decision, manual = A.current_decision(F.col("v"), fresh), A.approved(F.col("a"), fresh)
    return rows.withColumns({"decision": decision, "manual": manual}).withColumn("ready", A.export_ready(F.col("status"), F.col("status") == "approved", F.col("decision"), F.col("manual")))


READY_SQL = f"(status = 'validated' AND {DECISION_SQL}) OR (status = 'approved' AND {APPROVAL_SQL})"


@query(f"WITH {TASKS_SQL}, {PLANTED_SQL} SELECT doc_id, status, {DECISION_SQL} AS decision, {APPROVAL_SQL} AS manual, {READY_SQL} AS ready FROM p")
def export_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", "status", "decision", "manual", "ready")


@query(f"WITH {TASKS_SQL}, {PLANTED_SQL}, r AS (SELECT *, {READY_SQL} AS ready FROM p) SELECT doc_id, status = 'validated' AND ready AS auto_ready, status = 'approved' AND ready AS manual_ready, NOT ready AND status <> 'rejected' AS attention FROM r")
def attention_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in A.partitions(F.col("status"), F.col("ready")).items()])


@query(f"""WITH {TASKS_SQL}, {PLANTED_SQL}, r AS (SELECT *, {READY_SQL} AS ready FROM p) SELECT source, count(*) AS candidates, count(*) FILTER (ready) AS ready, count(*) FILTER (status = 'rejected') AS discarded, count(*) FILTER (ready) >= 5 AS complete FROM r GROUP BY 1""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quality_summary(decided(spark, sf_dir).withColumn("requested", F.lit(5)), "source")


@query("""WITH r AS (SELECT list_filter(string_split(substr(text, 1, 40), ' '), lambda w: length(w) > 4) AS reasons FROM documents),
    j AS (SELECT len(reasons) AS n, lower(array_to_string(reasons, chr(10))) AS t FROM r)
    SELECT CASE WHEN n > 0 THEN CASE WHEN regexp_matches(t, 'ing$|ing\\n') THEN 'form' WHEN contains(t, 'th') OR contains(t, 'qu') THEN 'data' ELSE 'other' END END AS class, count(*) AS n FROM j GROUP BY 1""")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer words of a text's opening as reasons: classes by priority, other, and none without a reason."""
    reasons = F.filter(F.split(F.substring("text", 1, 40), " "), lambda w: F.length(w) > 4)
    found = A.failure_class(reasons, [("form", r"ing$|ing\n"), ("data", "th|qu")])
    return table(spark, sf_dir, "documents").groupBy(found.alias("class")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT doc_id, text, source, lang, CASE WHEN n_chars % 11 = 0 THEN '  ' ELSE 'Setup' END AS a, CASE WHEN n_chars % 5 = 0 THEN 'SETUP ' ELSE coalesce(lang, '') END AS b, (n_chars % 7)::DOUBLE AS x, CASE WHEN n_chars % 13 = 0 THEN 'nan'::DOUBLE ELSE doc_id % 6 + 0.5 END AS y, n_chars % 17 = 0 AS none FROM documents),
    g AS (SELECT *, CASE WHEN doc_id % 19 = 0 THEN -1.0 WHEN isnan(y) THEN 10.0 ELSE x + y + (doc_id % 5 - 2) * 0.006 END AS top, NOT none AND x > 0 AND NOT isnan(y) AND y > 0 AS good FROM f)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text, ' ')) < 30 THEN 'short_statement' END, CASE WHEN length(trim(coalesce(source, ''), ' ')) < 20 THEN 'short_solution' END, CASE WHEN length(trim(coalesce(lang, ''), ' ')) < 1 THEN 'no_answer' END,
    CASE WHEN none THEN 'empty' END, CASE WHEN NOT none AND (trim(a) = '' OR trim(b) = '') THEN 'blank_name' END, CASE WHEN NOT none AND lower(trim(a)) = lower(trim(b)) THEN 'repeated_name' END, CASE WHEN NOT none AND NOT good THEN 'bad_score' END, CASE WHEN top <= 0 THEN 'bad_max' END, CASE WHEN good AND top > 0 AND abs(x + y - top) > 0.01 THEN 'sum_differs' END], lambda x: x IS NOT NULL), ',') AS issues FROM g""")
def sanity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics of two criteria whose names and scores come from the documents, and a total up to 0.012 beside their sum."""
    n, doc = F.col("n_chars"), F.col("doc_id")
    one = lambda name, score: F.struct(name.alias("name"), score.alias("max_score"))
    x, y = (n % 7).cast("double"), F.when(n % 13 == 0, float("nan")).otherwise(doc % 6 + 0.5)
    rubric = F.array(one(F.when(n % 11 == 0, "  ").otherwise("Setup"), x), one(F.when(n % 5 == 0, "SETUP ").otherwise(T.text("lang")), y))
    empty = F.array().cast("array<struct<name:string,max_score:double>>")
    top = F.when(doc % 19 == 0, -1.0).when(F.isnan(y), 10.0).otherwise(x + y + (doc % 5 - 2) * 0.006)
    issues = A.sanity_issues(F.col("text"), F.col("source"), F.col("lang"), F.when(n % 17 == 0, empty).otherwise(rubric), top)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(issues, ",").alias("issues"))


@query(f"""WITH {TASKS_SQL} SELECT doc_id, coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AND doc_id % 5 <> 0 AS passed, concat_ws(',', CASE WHEN NOT coalesce(quality = 1, false) THEN 'solver' END, CASE WHEN NOT coalesce(toxic = 0, false) THEN 'critic' END, CASE WHEN doc_id % 5 = 0 THEN 'data' END) AS failed FROM t""")
def verdict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, failed = A.verdict([("solver", F.col("quality") == 1), ("critic", F.col("toxic") == 0), ("data", ~every(5))])
    return tasks(spark, sf_dir).select("doc_id", passed.alias("passed"), F.array_join(failed, ",").alias("failed"))


VERDICTS = ["match", "incomplete", "mismatch", "uncertain", None]


@query("""WITH c AS (SELECT doc_id, list_extract(['match', 'incomplete', 'mismatch', 'uncertain', NULL], CAST(doc_id % 5 + 1 AS INT)) AS s, list_extract(['match', 'incomplete', 'mismatch', 'uncertain', NULL], CAST(doc_id // 5 % 5 + 1 AS INT)) AS v,
        list_extract(['match', 'incomplete', 'mismatch', 'uncertain', NULL], CAST(doc_id // 25 % 5 + 1 AS INT)) AS x, doc_id % 13 + doc_id % 17 > 1 AS s_clean, doc_id % 13 + doc_id % 19 > 1 AS v_clean, doc_id % 13 + doc_id % 23 > 1 AS x_clean, doc_id % 7 < 3 OR doc_id % 11 <> 0 AS backed, doc_id % 11 <> 0 AS rules FROM documents),
    k AS (SELECT *, coalesce(s IN ('incomplete', 'uncertain'), false) AS sp, coalesce(v IN ('incomplete', 'uncertain'), false) AS vp, coalesce(x IN ('incomplete', 'uncertain'), false) AS xp, coalesce(s = 'match', false) AS sm, coalesce(v = 'match', false) AS vm, coalesce(x = 'match', false) AS xm FROM c)
    SELECT doc_id, xm AND sp AND vp AND s_clean AND v_clean AND backed AS semantic, (sm AND vp AND v_clean OR vm AND sp AND s_clean) AND x IS DISTINCT FROM 'mismatch' AND backed AS solution_backed, sm AND vm AND xp AND x_clean AND rules AS reference_anchored FROM k""")
def entailment_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of verdicts, unknown ones too; some comparisons with missing or unexpected parts."""
    doc = F.col("doc_id")

    def comparison(step: int, n: int) -> Column:
        verdict = F.element_at(F.array(*map(F.lit, VERDICTS)), (F.floor(doc / step) % 5 + 1).cast("int"))
        odd = doc % 13 + doc % n
        return F.struct(verdict.alias("verdict"), F.when(odd == 0, 1).otherwise(0).alias("n_missing"), F.when(odd == 1, 2).otherwise(0).alias("n_unexpected"))

    style = F.when(doc % 7 < 2, "text").when(doc % 7 == 2, "formula").otherwise("numeric")
    ways = A.entailment(style, comparison(1, 17), comparison(5, 19), comparison(25, 23), ~every(11))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in ways.items()])


@query("""WITH c AS (SELECT doc_id, doc_id % 2 = 0 AS numeric, doc_id % 3 = 0 AS all_match, [n_chars % 2 = 0, n_chars % 3 = 0, n_chars % 5 < 3, n_chars % 7 = 0] AS checks, list_extract(['mismatch', 'uncertain', 'incomplete'], CAST(n_chars % 3 + 1 AS INT)) AS previous FROM documents)
    SELECT doc_id, numeric, CASE WHEN numeric AND all_match THEN 3 + CAST(checks[4] AS INT) ELSE len(list_filter(checks, lambda x: x)) END AS n_true, previous, 'match' AS verdict FROM c""")
def critic_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four checks from the documents: the numbers decide three of them, the fourth stays the critic's."""
    n = F.col("n_chars")
    checks = F.map_from_arrays(F.array(*map(F.lit, ["answer_matches_solution", "answers_agree", "solution_correct", "units_consistent"])), F.array(n % 2 == 0, n % 3 == 0, n % 5 < 3, n % 7 == 0))
    fixed = A.numeric_override(checks, F.when(every(2), "numeric").otherwise("text"), every(3))
    verdict = F.element_at(F.array(*map(F.lit, ["mismatch", "uncertain", "incomplete"])), (n % 3 + 1).cast("int"))
    report = A.promoted(F.struct(verdict.alias("verdict")), "semantic")
    return table(spark, sf_dir, "documents").select("doc_id", every(2).alias("numeric"), F.size(F.filter(F.map_values(fixed), lambda x: x)).alias("n_true"), report["previous"].alias("previous"), report["verdict"].alias("verdict"))


@query(f"""WITH {TASKS_SQL} SELECT doc_id, CASE WHEN hit THEN 'needs_review' ELSE status END AS status, CASE WHEN hit THEN 'sheet changed;old' ELSE 'old' END AS reasons, CASE WHEN NOT hit AND status = 'approved' THEN 'someone' END AS approval, CASE WHEN hit THEN sha256(text) END AS previous_fingerprint FROM (SELECT *, doc_id % 3 = 0 AND status IN ('validated', 'approved') AS hit FROM t)""")
def invalidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks(spark, sf_dir).withColumns({"reasons": F.array(F.lit("old")), "approval": F.when(F.col("status") == "approved", "someone"), "content_fingerprint": F.sha2("text", 256), "previous_fingerprint": F.lit(None).cast("string")})
    return A.invalidate(rows, every(3), "sheet changed").select("doc_id", "status", F.array_join("reasons", ";").alias("reasons"), "approval", "previous_fingerprint")


@query(f"""WITH {TASKS_SQL} SELECT source, count(*) FILTER (doc_id % 3 = 0 AND status IN ('validated', 'approved')) AS affected, count(*) FILTER (doc_id % 3 = 0 AND status = 'approved') AS approved FROM t GROUP BY 1""")
def impact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = every(3) & F.col("status").isin("validated", "approved")
    return tasks(spark, sf_dir).groupBy("source").agg(F.count_if(hit).alias("affected"), F.count_if(hit & (F.col("status") == "approved")).alias("approved"))


@query("""SELECT doc_id, sha256('{"answer":"' || coalesce(lang, '') || '","config":{"run_solver":true,"sheet_ids":["a","b"],"tolerance_pct":' || CASE WHEN doc_id % 2 = 0 THEN '2.5' ELSE '5' END || '},"max_score":' || n_chars || ',"rubric":["r"],"solution":"s","statement":"t"}') AS fingerprint FROM documents""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = A.normal_config(F.when(every(2), "2.5").otherwise("x"), F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.lit(None).cast("boolean"))
    print_ = A.content_fingerprint(F.lit("t"), F.lit("s"), T.text("lang"), F.array(F.lit("r")), F.col("n_chars"), config)
    return table(spark, sf_dir, "documents").select("doc_id", print_.alias("fingerprint"))


@query("""WITH f AS (SELECT doc_id, list_extract(['student', 'teacher_only', 'quarantine', NULL], CAST(n_chars % 4 + 1 AS INT)) AS v, list_extract(['unverified', 'reference', 'course_policy', 'course_lecture', 'rumour', NULL], CAST(doc_id % 6 + 1 AS INT)) AS a, CASE WHEN n_chars % 11 <> 0 THEN n_chars % 5 <> 0 END AS parsed FROM documents)
    SELECT doc_id, CASE WHEN v = 'student' THEN CASE WHEN NOT coalesce(a IN ('reference', 'course_policy', 'course_lecture'), false) THEN 'untrusted' WHEN NOT coalesce(parsed, false) THEN 'not_parsed' END END AS violation, CASE WHEN a = 'unverified' AND v = 'student' THEN 'quarantine' ELSE v END AS visibility FROM f""")
def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of visibility and authority, unknown ones too, with and without a parsed source."""
    n = F.col("n_chars")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    visibility, authority = pick(["student", "teacher_only", "quarantine", None], n % 4), pick(["unverified", "reference", "course_policy", "course_lecture", "rumour", None], F.col("doc_id") % 6)
    parsed = F.when(n % 11 != 0, n % 5 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", A.source_violation(visibility, authority, parsed).alias("violation"), A.quarantined(visibility, authority).alias("visibility"))


@query("""SELECT p_partkey, least(p_size * 3, p_size + 20) AS candidate_budget, CAST(ceil(p_size / 2.0) AS BIGINT) + 3 AS call_limit FROM part""")
def refill_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in A.refill(F.col("p_size")).items()])


@query("""WITH f AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 7 = 1 THEN ' ' ELSE text END AS statement, doc_id % 5 = 0 AS unused, CASE WHEN doc_id % 3 <> 0 THEN 19970 + n_chars % 30 END AS size, list_extract(['auto', 'dilution', 'bet', NULL], CAST(n_chars % 4 + 1 AS INT)) AS block, list_extract(['7.5', 'ten', '1e1', '', NULL, '-3'], CAST(n_chars % 6 + 1 AS INT)) AS score FROM documents)
    SELECT doc_id, CASE WHEN trim(coalesce(statement, ''), ' ') = '' THEN 'statement' WHEN unused THEN 'data_used' WHEN size IS NULL OR size + length('{"dilution":""}') > 20000 THEN 'facts' WHEN block NOT IN ('auto', 'dilution') THEN 'block' END AS error, coalesce(try_cast(score AS DOUBLE), 10) AS max_score FROM f""")
def candidate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with missing parts, facts of 19,985 to 20,014 characters, blocks with and without facts, and scores that are numbers or not."""
    n = F.col("n_chars")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    facts = F.when(~every(3), F.create_map(F.lit("dilution"), F.repeat(F.lit("x"), (19_970 + n % 30).cast("int"))))
    statement = F.when(n % 7 == 1, " ").when(n % 7 != 0, F.col("text"))
    error = A.candidate_error(statement, F.when(~every(5), F.array(F.lit(1))), facts, pick(["auto", "dilution", "bet", None], n % 4))
    item = F.struct(F.col("text").alias("statement"), F.col("lang").alias("answer"), pick(["7.5", "ten", "1e1", "", None, "-3"], n % 6).alias("max_score"), F.lit(None).cast("array<struct<name:string,max_score:double>>").alias("rubric"))
    row = A.task_row(item, F.lit(None).cast("array<struct<name:string,max_score:double>>"))
    return table(spark, sf_dir, "documents").select("doc_id", error.alias("error"), row["max_score"].alias("max_score"))


NUMS = "list_filter(list_distinct(list_transform(regexp_extract_all({c}, '[0-9]+(\\.[0-9]+)?'), lambda x: x)), lambda x: NOT (regexp_full_match(x, '\\d+') AND CAST(x AS DOUBLE) < 1000) AND NOT (regexp_full_match(x, '\\d+\\.\\d') AND CAST(x AS DOUBLE) < 100))"


@query(f"""WITH s AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')) FILTER (role <> 'user') AS sheets, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')) FILTER (role = 'user') AS statement FROM conversations GROUP BY 1),
    n AS (SELECT conv_id, sheets, {NUMS.format(c="coalesce(statement, '')")} AS st, regexp_extract_all(coalesce(sheets, ''), '[0-9]+(\\.[0-9]+)?') AS sh FROM s),
    u AS (SELECT conv_id, sheets, list_filter(st, lambda x: NOT list_contains(sh, x) AND len(list_filter(sh, lambda y: abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) <= 1e-6 * greatest(CAST(x AS DOUBLE), CAST(y AS DOUBLE)))) = 0) AS un FROM n)
    SELECT conv_id, CASE WHEN trim(coalesce(sheets, ''), ' ') = '' THEN 'skipped' WHEN len(un) > 0 THEN 'warn' ELSE 'ok' END AS status, CASE WHEN trim(coalesce(sheets, ''), ' ') = '' THEN 0 ELSE least(20, len(un)) END AS n_unknown FROM u""")
def legacy_data_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", T.text("text"))
    side = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    both = turns.groupBy("conv_id").agg(side(F.col("role") != "user").alias("sheets"), side(F.col("role") == "user").alias("statement"))
    found = P.legacy_data_check(F.col("statement"), F.col("sheets"), plain=True)
    return both.select("conv_id", found.alias("f")).select("conv_id", "f.status", F.size("f.unknown").cast("long").alias("n_unknown"))


@query("""WITH f AS (SELECT doc_id, list_extract(['Gas constants', 'gas CONSTANTS', 'Gas constant', 'Gas constants (Справка)', 'Missing table', '  ', 'Gas'], CAST(n_chars % 7 + 1 AS INT)) AS title, [CAST(8.31 + (doc_id % 7 - 3) * 0.000004 AS DECIMAL(10, 6)), 298 + CAST(n_chars % 3 AS DECIMAL(10, 6)) / 5000] AS v, n_chars % 13 = 0 AS none, n_chars % 17 = 0 AS skipped FROM documents),
    g AS (SELECT *, none OR trim(title) = '' AS invalid, NOT (starts_with('gas constants (справка)', lower(title)) AND substr('gas constants (справка)', length(title) + 1, 1) IN ('', ' ', '(')) AS unknown_title,
        CASE WHEN none THEN 0 ELSE len(list_filter(v, lambda x: abs(x::DOUBLE - 8.31) > 1e-6 * greatest(x::DOUBLE, 8.31) AND abs(x::DOUBLE - 298) > 1e-6 * greatest(x::DOUBLE, 298))) END AS n FROM f)
    SELECT doc_id, CASE WHEN skipped THEN 'skipped' WHEN invalid THEN 'invalid' WHEN n > 0 OR unknown_title THEN 'warn' ELSE 'ok' END AS status, CASE WHEN skipped THEN 0 ELSE n END AS n_numbers, CASE WHEN skipped OR trim(title) = '' THEN 0 ELSE CAST(unknown_title AS INT) END AS n_sources FROM g""")
def data_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers within and beyond a millionth of those of the sheets, titles that begin a heading, go on beyond it or stop within a word."""
    n = F.col("n_chars")
    title = F.element_at(F.array(*map(F.lit, ["Gas constants", "gas CONSTANTS", "Gas constant", "Gas constants (Справка)", "Missing table", "  ", "Gas"])), (n % 7 + 1).cast("int"))
    gas, warm = (8.31 + (F.col("doc_id") % 7 - 3) * 0.000004).cast("decimal(10,6)"), (298 + (n % 3) / 5000).cast("decimal(10,6)")
    values = F.when(n % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(gas.cast("string"), r"\.", ","), warm.cast("string")))
    used = F.when(n % 17 != 0, F.array(F.struct(title.alias("sheet_title"), values.alias("values"))))
    found = P.data_check(used, F.lit("### Gas constants (Справка)\nR = 8,31; T = 298 K"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.status", F.size("f.unknown_numbers").alias("n_numbers"), F.size("f.unknown_sources").alias("n_sources"))


@query("""SELECT doc_id AS task_id, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'warn' WHEN doc_id % 4 = 3 AND doc_id % 2 = 1 THEN 'ok' WHEN doc_id % 4 = 2 AND doc_id % 7 = 0 THEN 'warn' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 0 OR (doc_id % 4 = 2 AND doc_id % 7 = 0) THEN CASE doc_id % 4 WHEN 1 THEN 'Gas  CONSTANTS' WHEN 2 THEN '### Gas constants' ELSE 'Gas constants' END ELSE '' END AS unbound FROM documents""")
def lineage_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    case = F.col("doc_id") % 4
    title = F.when(case == 1, "Gas  CONSTANTS").when(case == 2, "### Gas constants").otherwise("Gas constants")
    used = F.when(~every(3), F.array(F.struct(title.alias("sheet_title"), F.array(F.lit("8.31")).alias("values"))))
    context = F.when(every(7), "no heading").otherwise("text\n### Gas constants\nR = 8.31")
    rows = docs.select(F.col("doc_id").alias("task_id"), used.alias("data_used"), context.alias("context"))
    sheets = docs.select(F.col("doc_id").alias("task_id"), F.lit("Gas constants").alias("title"), F.lit("d1").alias("document"), (~every(5)).alias("document_exists"), F.lit("reference").alias("authority"))
    return P.lineage_check(rows, sheets).select("task_id", "status", F.array_join("unbound", ";").alias("unbound"))


GRADES_SQL = "g AS (SELECT l_orderkey AS run, l_linenumber AS role, 'c' || (l_suppkey % 2) AS criterion, l_quantity AS score, 50.0 AS max_score FROM lineitem)"


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as grades: the order is the run, the line the grader, the quantity the score out of 50."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("role"), F.concat(F.lit("c"), (F.col("l_suppkey") % 2).cast("string")).alias("criterion"), F.col("l_quantity").alias("score"), F.lit(50.0).alias("max_score"))


@query(f"""WITH {GRADES_SQL} SELECT run, criterion, count(*) AS n, round(avg(score), 6) AS average, max(score) - min(score) AS spread, round((max(score) - min(score)) / min(max_score) * 100, 6) AS spread_pct, (max(score) - min(score)) / min(max_score) * 100 > 20 AS disagreement FROM g GROUP BY 1, 2""")
def consensus_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.consensus_criteria(grades(spark, sf_dir))
    return out.select("run", "criterion", "n", F.round("average", 6).alias("average"), "spread", F.round("spread_pct", 6).alias("spread_pct"), "disagreement")


@query(f"""WITH {GRADES_SQL}, t AS (SELECT run, role, sum(score) AS t, sum(max_score) AS m FROM g GROUP BY 1, 2), r AS (SELECT run, count(*) AS n, min(m) AS max_score, avg(t) AS average, max(t) - min(t) AS spread FROM t GROUP BY 1),
    c AS (SELECT run, count(*) FILTER (d) AS n_disagreements FROM (SELECT run, (max(score) - min(score)) / min(max_score) * 100 > 20 AS d FROM g GROUP BY run, criterion) GROUP BY 1)
    SELECT run, n, round(average, 6) AS average, spread, round(spread / max_score * 100, 6) AS spread_pct, n_disagreements, spread / max_score * 100 > 20 OR n_disagreements > 0 AS needs_review FROM r JOIN c USING (run)""")
def consensus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.consensus_totals(grades(spark, sf_dir))
    return out.select("run", "n", F.round("average", 6).alias("average"), "spread", F.round("spread_pct", 6).alias("spread_pct"), "n_disagreements", "needs_review")


@query(f"""WITH {GRADES_SQL}, r AS (SELECT run, role, count(*) > count(DISTINCT criterion) AS repeated, string_agg(criterion, ',' ORDER BY criterion) AS names, sum(max_score) AS m FROM g GROUP BY 1, 2)
    SELECT run, count(*) AS n, CASE WHEN count(*) < 2 THEN 'too_few' WHEN bool_or(repeated) THEN 'repeated_role' WHEN count(DISTINCT names) > 1 THEN 'criteria_differ' WHEN max(m) - min(m) > 1e-6 THEN 'maxima_differ' ELSE 'ok' END AS state FROM r GROUP BY 1""")
def consensus_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.consensus_guards(grades(spark, sf_dir))


@query("""WITH f AS (SELECT o_orderkey, o_custkey % 11 = 0 AS unreadable, CASE WHEN o_orderkey % 3 = 0 THEN 'blurred' ELSE ' ' END AS reason, (o_custkey % 25) / 20.0 - 0.1 AS confidence, 10 + (o_orderkey % 4) * 0.0000004 AS top, list_extract(['Setup', ' Result ', 'Other'], CAST(CASE WHEN o_custkey % 8 < 6 THEN 2 WHEN o_custkey % 8 = 6 THEN 1 ELSE 3 END AS INT)) AS name, (o_orderkey % 10) * 0.5 AS x, (o_custkey % 14) * 0.5 AS y, CASE WHEN o_orderkey % 13 = 0 THEN 6.5 ELSE 6.0 END AS y_top, list_extract([0, 0.0000005, -0.0000005, 0.000002, 0.5]::DOUBLE[], CAST(o_custkey % 5 + 1 AS INT)) AS off, o_orderkey % 4 = 0 AS asked FROM orders)
    SELECT o_orderkey, CASE WHEN unreadable AND trim(reason) = '' THEN 'reason_missing' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence_range' WHEN abs(top - 10) > 1e-6 THEN 'max_differs' WHEN trim(name) <> 'Result' THEN CASE WHEN trim(name) IN ('Setup', 'Other') THEN 'criteria_missing' END WHEN x > 4 + 1e-6 OR y > y_top + 1e-6 THEN 'score_range' WHEN abs(y_top - 6) > 1e-6 THEN 'criterion_max_differs' WHEN abs(off) > 1e-6 THEN 'total_differs' END AS violation, unreadable OR asked AS needs_review FROM f""")
def rubric_sum_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graders' outputs with scores, maxima, confidences and totals on both sides of their bounds."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rubric = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("max_score")) for n, m in (("Setup", 4.0), ("Result", 6.0))])
    name = F.when(customer % 8 < 6, " Result ").when(customer % 8 == 6, "Setup").otherwise("Other")
    x, y = (key % 10) * 0.5, (customer % 14) * 0.5
    criteria = F.array(F.struct(F.lit("Setup").alias("name"), x.alias("score"), F.lit(4.0).alias("max_score")), F.struct(name.alias("name"), y.alias("score"), F.when(key % 13 == 0, 6.5).otherwise(6.0).alias("max_score")))
    total = x + y + F.element_at(F.array(*map(F.lit, [0.0, 5e-7, -5e-7, 2e-6, 0.5])), (customer % 5 + 1).cast("int"))
    output = F.struct(
        (customer % 11 == 0).alias("unreadable"), F.when(key % 3 == 0, "blurred").otherwise(" ").alias("unreadable_reason"), total.alias("total_score"), (10 + (key % 4) * 4e-7).alias("max_score"), criteria.alias("criteria"),
        ((customer % 25) / 20.0 - 0.1).alias("confidence"), (key % 4 == 0).alias("needs_review"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", output.alias("o"), rubric.alias("r"))
    return rows.select("o_orderkey", G.contract_violation(F.col("o"), F.col("r"), F.lit(10.0)).alias("violation"), G.needs_review(F.col("o")).alias("needs_review"))


STEP_TYPES = ["grade", "ocr", "consensus", "grade", "magic", "grade"]
STEP_ROLES = ["primary", None, "PRIMARY ", "Bad role!", "second"]
ROLES_SQL = "['primary', NULL, 'PRIMARY ', 'Bad role!', 'second']"


@query(f"""WITH d AS (SELECT p_partkey, list_transform(range(CAST(p_size % 5 AS BIGINT)), lambda i: (p_partkey * 7 + p_size * i * i + 3 * i) % 30) AS h, p_size FROM part),
    t AS (SELECT p_partkey, list_transform(h, lambda x: list_extract({STEP_TYPES}, CAST(x % 6 + 1 AS INT))) AS types, list_transform(h, lambda x: list_extract({ROLES_SQL}, CAST(x % 5 + 1 AS INT))) AS roles, list_transform(h, lambda x: CASE WHEN x = 11 THEN ' ' ELSE 'm' END) AS models, list_transform(h, lambda x: x / 14.0) AS temperatures, list_transform(h, lambda x: x * 4.0) AS thresholds FROM d),
    g AS (SELECT *, list_filter(range(1, len(types) + 1), lambda i: types[i] = 'grade') AS grades, coalesce(list_position(types, 'grade'), 0) AS first_grade, coalesce(list_position(types, 'consensus'), 0) AS consensus FROM t),
    r AS (SELECT *, list_transform(grades, lambda i, k: coalesce(lower(trim(roles[i])), CASE k WHEN 1 THEN 'primary' WHEN 2 THEN 'skeptic' ELSE 'grader_' || k END)) AS names FROM g)
    SELECT p_partkey, CASE WHEN len(types) = 0 THEN 'no_steps' WHEN list_contains(types, 'magic') THEN 'unknown_type' WHEN consensus > 0 AND consensus < len(types) THEN 'step_after_consensus'
        WHEN len(list_filter(types, lambda x: x = 'ocr')) > 1 OR first_grade > 0 AND len(list_filter(range(1, len(types) + 1), lambda i: i > first_grade AND types[i] = 'ocr')) > 0 THEN 'ocr_not_first'
        WHEN len(list_filter(grades, lambda i: trim(models[i]) = '')) > 0 THEN 'model_missing' WHEN len(list_filter(names, lambda x: NOT regexp_full_match(x, '[a-z][a-z0-9_]*'))) > 0 THEN 'bad_role' WHEN len(list_filter(grades, lambda i: NOT temperatures[i] BETWEEN 0 AND 2)) > 0 THEN 'temperature_range'
        WHEN consensus > 0 AND len(list_filter(grades, lambda i: i < consensus)) < 2 THEN 'too_few_grades' WHEN consensus > 0 AND NOT thresholds[consensus] BETWEEN 0 AND 100 THEN 'threshold_range' WHEN len(grades) = 0 THEN 'no_grade' WHEN consensus > 0 AND len(list_distinct(names)) < len(names) THEN 'repeated_role' END AS violation FROM r""")
def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four steps whose type, role, model, temperature and threshold follow from the part: every rule is broken by some."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    drawn = F.when(size % 5 > 0, F.transform(F.sequence(F.lit(0), (size % 5 - 1).cast("int")), lambda i: (key * 7 + size * i * i + 3 * i) % 30)).otherwise(F.array().cast("array<bigint>"))
    step = lambda x: F.struct(pick(STEP_TYPES, x % 6).alias("type"), F.when(x == 11, " ").otherwise("m").alias("model"), pick(STEP_ROLES, x % 5).alias("role"), (x / 14.0).alias("temperature"), (x * 4.0).alias("threshold"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.transform(drawn, step).alias("s"))
    return rows.select("p_partkey", G.pipeline_violation(F.col("s")).alias("violation"))


@query("""WITH f AS (SELECT o_orderkey, CASE o_custkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'task' END AS task, CASE o_custkey % 7 WHEN 0 THEN NULL ELSE range(CAST(o_custkey % 7 - 1 AS BIGINT)) END AS rubric, o_orderkey % 2 = 0 AS ocr, o_custkey % 3 AS files, CASE WHEN o_orderkey % 5 = 0 THEN 'read' ELSE ' ' END AS said, o_custkey % 5 AS models, o_orderkey % 4 AS graders FROM orders)
    SELECT o_orderkey, CASE WHEN trim(coalesce(task, '')) = '' THEN 'task_text' WHEN coalesce(len(rubric), 0) = 0 THEN 'rubric' WHEN ocr AND files = 0 AND trim(said) = '' THEN 'files' WHEN models < graders THEN 'model' END AS missing FROM f""")
def run_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with blank, missing and sufficient parts: as many models as graders, one fewer, and more."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(f"c{k}") for k in range(6)])
    run = F.struct(
        F.when(customer % 9 == 0, " ").when(customer % 9 != 1, "task").alias("task_text"), F.when(customer % 7 > 0, F.slice(names, F.lit(1), (customer % 7 - 1).cast("int"))).alias("rubric"), (key % 2 == 0).alias("needs_ocr"),
        (customer % 3).alias("n_files"), F.when(key % 5 == 0, "read").otherwise(" ").alias("ocr_text"), (customer % 5).alias("n_models"), (key % 4).alias("n_graders"))
    return table(spark, sf_dir, "orders").select("o_orderkey", G.preflight(run).alias("missing"))


REASONS = ["low Confidence of the model", "sums differ", "confidence", "page 2 is cut", "CONFIDENCE is low"]
ROLES = ["primary", "grader_3", "skeptic", "custom", "arbiter", "grader_12", "grader_x"]


@query(f"""WITH f AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS asked, o_custkey % 7 = 0 AS unreadable, CASE WHEN o_orderkey % 4 < 3 THEN list_transform(range(CAST(o_orderkey % 4 AS BIGINT)), lambda i: list_extract({REASONS}, CAST((o_custkey + 2 * i) % 5 + 1 AS INT))) END AS reasons, list_extract({ROLES}, CAST(o_custkey % 7 + 1 AS INT)) AS role FROM orders)
    SELECT o_orderkey, coalesce(asked, false) AND (unreadable OR coalesce(len(reasons), 0) = 0 OR len(list_filter(reasons, lambda r: NOT contains(lower(r), 'confidence'))) > 0) AS substantive,
        CASE WHEN role = 'primary' THEN 'Primary grader' WHEN role = 'skeptic' THEN 'Second grader' WHEN role = 'arbiter' THEN 'Arbiter' WHEN regexp_full_match(role, 'grader_[0-9]+') THEN 'Grader ' || substr(role, 8) ELSE role END AS label FROM f""")
def substantive_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No, one or two reasons, with and without the model's confidence, or none given; roles with and without a number."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    some = F.transform(F.sequence(F.lit(0), (key % 4 - 1).cast("int")), lambda i: pick(REASONS, (customer + 2 * i) % 5))
    reasons = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 < 3, some)
    asked = F.when(customer % 3 == 0, True).when(customer % 3 == 1, False)
    return table(spark, sf_dir, "orders").select("o_orderkey", G.substantive(asked, customer % 7 == 0, reasons).alias("substantive"), T.role_label(pick(ROLES, customer % 7)).alias("label"))