"""Plans over stored records: sources claimed, facts, rubrics, contracts, reports, releases, window results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import contracts as K
from gleaner.operators import grading as G
from gleaner.operators.dedup import dedup_bounded as bounded

from .documents import PLAIN, words_sql
from .registry import query, table

NONE = "CAST(NULL AS array<string>)"


def at(column: str, n: int) -> Column:
    return F.col(column) % n == 0


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 'Table A=1,2' END AS used FROM documents""")
def data_used_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.when(at("doc_id", 5), F.expr(NONE)).when(at("doc_id", 3), F.array(F.lit("1"), F.lit(" "))).otherwise(F.array(F.lit(" 1"), F.lit("2")))
    used = F.array(F.struct(F.when(at("doc_id", 7), "  ").otherwise(" Table A ").alias("sheet_title"), values.alias("values")))
    rows = table(spark, sf_dir, "documents").select("doc_id", K.normal_data_used(used).alias("u"))
    shown = F.concat(F.element_at("u", 1)["sheet_title"], F.lit("="), F.array_join(F.element_at("u", 1)["values"], ","))
    return rows.select("doc_id", shown.alias("used"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN '{"bet":{"slope":1},"dilution":{}}' END AS facts FROM documents""")
def facts_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.when(at("doc_id", 7), "{broken").when(at("doc_id", 5), '{"magic":1}').otherwise('{"dilution": {}, "bet": {"slope": 1}}')
    return table(spark, sf_dir, "documents").select("doc_id", K.normal_facts(json).alias("facts"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'blank_name' WHEN p_size % 5 = 0 THEN 'repeated_name' WHEN p_size % 3 = 0 THEN 'bad_score' END AS problem, CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 3 <> 0 THEN 'Setup=4,Result=6' END AS rubric FROM part""")
def rubric_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda a, b, m: F.struct(a.alias("criterion_name"), b.alias("name"), m.alias("max_score"))
    rubric = F.array(one(F.when(at("p_size", 7), " ").otherwise(" Setup"), F.lit(""), F.lit("4")), one(F.lit(""), F.when(at("p_size", 5), "SETUP").otherwise("Result "), F.when(at("p_size", 3), "-1").otherwise("6")))
    rows = table(spark, sf_dir, "part").select("p_partkey", K.parsed_rubric(rubric).alias("r"))
    shown = F.array_join(F.transform("r.rubric", lambda x: F.concat_ws("=", x["name"], x["max_score"].cast("int").cast("string"))), ",")
    return rows.select("p_partkey", F.col("r.problem").alias("problem"), shown.alias("rubric"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'a,c' END AS sheet_ids, CASE WHEN doc_id % 2 = 0 THEN 2.0 WHEN doc_id % 5 = 0 THEN 3.0 ELSE 5.0 END AS tolerance_pct, doc_id % 4 <> 0 AND doc_id % 7 = 0 AS discarded FROM documents""")
def validation_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 3
    rendered = F.when(case == 0, F.array().cast("array<string>")).when(case == 1, F.array(F.lit("b")))
    contract = K.validation_contract(rendered, F.array(F.lit("c"), F.lit("a"), F.lit("c")), F.when(at("doc_id", 2), F.lit(2.0)), F.when(at("doc_id", 5), F.lit(3.0)))
    gone = K.discarded(F.when(at("doc_id", 4), "validated").otherwise("rejected"), at("doc_id", 7))
    rows = table(spark, sf_dir, "documents").select("doc_id", contract.alias("c"), gone.alias("discarded"))
    return rows.select("doc_id", F.array_join("c.sheet_ids", ",").alias("sheet_ids"), F.col("c.tolerance_pct").alias("tolerance_pct"), "discarded")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'match' ELSE 'mismatch' END AS status, length(substr(text, 1, 4000)) AS n, doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND trim(text, ' ') <> '' AS complete,
    CASE WHEN doc_id % 11 = 0 THEN 'error: timeout' WHEN doc_id % 5 = 0 OR trim(text, ' ') = '' THEN 'incomplete outcome' WHEN doc_id % 2 <> 0 THEN 'answer: mismatch' END AS reason FROM documents""")
def solver_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = K.solver_report(F.col("text"), F.when(~at("doc_id", 5), "x"), F.when(at("doc_id", 2), "match").otherwise("mismatch"), F.when(at("doc_id", 11), "timeout"))
    rows = table(spark, sf_dir, "documents").select("doc_id", report.alias("r"))
    return rows.select("doc_id", F.col("r.status").alias("status"), F.length("r.solution").cast("long").alias("n"), F.col("r.complete").alias("complete"), F.col("r.reason").alias("reason"))


@query("""SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS representation_only FROM part""")
def representation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    comparison = F.struct(F.lit("incomplete").alias("verdict"), F.when(at("p_size", 3), F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("missing"), F.array(F.when(at("p_size", 2), price / 1000).otherwise(price * 1.7)).alias("unexpected"), F.array(price).alias("reference"))
    return table(spark, sf_dir, "part").select("p_partkey", K.representation_only(comparison).alias("representation_only"))


@query("""SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'field_missing' WHEN p_size % 7 = 0 THEN 'digest_format' WHEN p_size % 5 = 0 THEN 'digest_differs' WHEN p_size % 3 = 0 THEN 'version_differs' END AS problem FROM part""")
def release_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("# "), F.col("p_name"), F.lit("  \r\n"))
    digest = F.sha2(F.concat(F.lit("# "), F.col("p_name"), F.when(at("p_size", 5), "x").otherwise(""), F.lit("\n")), 256)
    release = F.struct(F.when(~at("p_size", 11), F.col("p_name")).alias("slug"), F.col("p_type").alias("title"), F.when(at("p_size", 7), F.upper(digest)).otherwise(digest).alias("sha256"), F.lit("2").alias("version"), F.when(at("p_size", 3), "1").otherwise("2").alias("manifest_version"))
    return table(spark, sf_dir, "part").select("p_partkey", K.release_problem(release, content).alias("problem"))


@query("""WITH w AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lower(trim(role)) AS k FROM conversations), f AS (SELECT conv_id, k, min((turn, role)) AS first FROM w GROUP BY 1, 2)
    SELECT conv_id, string_agg(k, ';' ORDER BY first) AS topics, coalesce((SELECT sha256(arg_min(trim(w.text, ' '), (w.turn, w.role))) FROM w WHERE w.conv_id = f.conv_id AND trim(w.text, ' ') <> ''), sha256('')) AS summary FROM f GROUP BY 1""")
def window_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as windows: roles are their topics, texts their summaries."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("window"), F.array("role").alias("topics"), F.col("text").alias("summary"), F.lit("").alias("notes"))
    out = K.merged_windows(rows, "conv_id", "window")
    return out.select("conv_id", F.array_join("topics", ";").alias("topics"), F.sha2("summary", 256).alias("summary"))


@query("""SELECT o_orderkey, 'Task:' || chr(10) || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Work:' || chr(10) || 'done' END AS message, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS n_grades FROM orders""")
def grading_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = K.grading_message({"Task": F.col("o_orderpriority"), "Work": F.when(at("o_orderkey", 3), " ").otherwise("done "), "Notes": F.lit(None).cast("string")})
    step = lambda kind, status, result: F.struct(F.lit(kind).alias("type"), status.alias("status"), result.alias("result"))
    steps = F.array(step("ocr", F.lit("completed"), F.lit("x")), step("grade", F.lit("completed"), F.lit("x")), step("grade", F.when(at("o_orderkey", 2), "failed").otherwise("completed"), F.lit("x")), step("grade", F.lit("completed"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", message.alias("message"), F.size(G.completed_grades(steps)).alias("n_grades"))


@query(f"""WITH d AS (SELECT doc_id, source, text, doc_id % 3 <> 0 AS ok, list_distinct({words_sql('text')}) AS w, {PLAIN} AS x FROM documents),
    r AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS e FROM d),
    p AS (SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS wi, len(a.w) + len(b.w) AS wu, len(list_intersect(a.x, b.x)) AS xi, len(a.x) + len(b.x) AS xu FROM r a JOIN r b ON a.source IS NOT DISTINCT FROM b.source AND b.ok AND b.doc_id < a.doc_id AND a.e - CASE WHEN a.ok THEN 1 ELSE 0 END - b.e BETWEEN 0 AND 9),
    s AS (SELECT doc_id, CASE WHEN wu = 0 THEN 0 ELSE wi / (wu - wi) END AS s, xu = 0 OR (xu - xi > 0 AND xi / nullif(xu - xi, 0) >= 0.8) AS near FROM p), m AS (SELECT doc_id, max(s) AS s, bool_or(s > 0.85 AND near) AS d FROM s GROUP BY 1)
    SELECT doc_id, source, round(coalesce(s, 0), 6) AS similarity, coalesce(d, false) AS duplicate FROM r LEFT JOIN m USING (doc_id)""")
def dedup_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the ten statements before that were not rejected (every third is)."""
    return bounded(table(spark, sf_dir, "documents"), "source", "doc_id", "text", neighbours=10, plain=True, eligible=~at("doc_id", 3))
