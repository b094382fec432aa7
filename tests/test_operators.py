from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import units
from gleaner.operators import admission, answers, exports, grading, provenance, relational, retrieval, rules
from gleaner.sources import readers, sinks
from gleaner.streaming import ingest

L = F.lit


def chunks(spark, md, size=2500):
    rows = retrieval.split_markdown(spark.createDataFrame([(1, md)], "id long, t string"), "id", "t", size).orderBy("ord").collect()
    return [(r.heading, r.kind, r.content) for r in rows]


def test_headings_tables_and_text(spark):
    md = "intro\n# A\nx\n\ny\n## B\n| a | b |\n| 1 | 2 |\ntail\n### C\nq\n#### not a heading\n# D\nz\n"
    assert chunks(spark, md) == [
        ("", "text", "intro"), ("A", "text", "x\n\ny"), ("A › B", "table", "| a | b |\n| 1 | 2 |"), ("A › B", "text", "tail"), ("A › B › C", "text", "q\n#### not a heading"), ("D", "text", "z"),
    ]


def test_deeper_headings_are_cleared(spark):
    assert [h for h, _, _ in chunks(spark, "## B\n1\n# A\n2\n### C\n3\n## E\n4")] == ["B", "A", "A › C", "A › E"]


def test_paragraphs_are_packed_and_cut(spark):
    md = "a" * 6 + "\n\n" + "b" * 3 + "\n\n" + "c" * 25 + "\n \n" + "d"
    assert [c for _, _, c in chunks(spark, md, 10)] == ["aaaaaa", "bbb", "c" * 10, "c" * 10, "ccccc\n\nd"]


@pytest.mark.parametrize("md", ["", None, "\n\n", "# only a heading"])
def test_no_chunks(spark, md):
    assert chunks(spark, md) == []


@pytest.mark.parametrize(
    ("reference", "given", "verdict"),
    [
        ("m = 2,5 г", "2.5 г", "match"), ("0,25 л", "250 мл", "match"), ("10", "10.4", "match"), ("10", "11", "mismatch"), ("10; 20", "20 и 10", "match"), ("10; 20", "10", "incomplete"), ("10", "10 и 77", "incomplete"),
        ("5 г", "5", "mismatch"), ("кислота", "Кислота ", "match"), ("растворы солей", "совсем другое слово", "mismatch"), ("соль растворяется", "соль не растворяется", "uncertain"), ("", "1", "uncertain"), ("1", "один", "uncertain"),
        ("7 или 8", "8", "match"), ("c₁ = 2", "c2 = 2", "mismatch"), ("5·10⁻³ моль", "0,005 моль", "match"),
    ],
)
def test_compare_answers(spark, reference, given, verdict):
    df = spark.createDataFrame([(reference, given)], "r string, s string")
    assert answers.compare_answers(df, "r", "s", L(5.0)).first().verdict == verdict


def test_numbers_of_the_statement_are_context(spark):
    df = spark.createDataFrame([("pH = 3", "при T = 298 pH = 3", "T = 298 K")], "r string, s string, c string")
    assert answers.compare_answers(df, "r", "s", L(1.0), "c").first().verdict == "match"
    assert answers.compare_answers(df, "r", "s", L(1.0)).first().verdict == "incomplete"
    assert answers.compare_answers(df, "r", "s", L(1.0), allow_extra=L(True)).first().verdict == "match"


def test_running_sums_over_many_partitions(spark):
    rows = [(None if i % 5 == 0 else i % 3, i, i % 2) for i in range(500)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = relational.running(spark.createDataFrame(rows, "k int, o int, x int"), ["k"], ["o"], {"rn": L(1), "s": F.col("x")}).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in got:
        mine = [x for k, o, x in rows if k == r.k and o <= r.o]
        assert (r.rn, r.s) == (len(mine), sum(mine))


def test_equal_totals_with_opposite_criteria_need_a_review(spark):
    rows = [(1, "a", "x", 5.0, 5.0), (1, "a", "y", 0.0, 5.0), (1, "b", "x", 0.0, 5.0), (1, "b", "y", 5.0, 5.0), (2, "a", "x", 5.0, 5.0), (2, "b", "x", 5.0, 5.0)]
    got = {r.run: r for r in grading.consensus_totals(spark.createDataFrame(rows, "run int, role string, criterion string, score double, max_score double")).collect()}
    assert got[1].spread == 0 and got[1].n_disagreements == 2 and got[1].needs_review and not got[2].needs_review


@pytest.mark.parametrize(("spread", "maximum", "pct"), [(1.0, 4.0, 25.0), (0.0, 0.0, 0.0), (1.0, 0.0, 100.0)])
def test_spread_pct(value, spread, maximum, pct):
    assert value(grading.spread_pct(L(spread), L(maximum))) == pct


def test_data_check_keeps_null_and_empty_apart(value):
    kind = "array<struct<sheet_title:string,values:array<string>>>"
    assert value(provenance.data_check(L(None).cast(kind), L("x"))["status"]) == "skipped"
    assert value(provenance.data_check(F.array().cast(kind), L("x"))["status"]) == "ok"


def test_lineage(spark):
    schema = "task_id int, data_used array<struct<sheet_title:string,values:array<string>>>, context string"
    tasks = spark.createDataFrame(
        [(1, [("Table  A", ["1"])], ""), (2, [("table a (Формулы, справочный источник)", ["1"])], "### Table A (Формулы, справочный источник)"), (3, [("Table A (Формулы, справочный источник)", ["1"])], "no heading"), (4, [("Other", ["1"]), ("", [])], ""), (5, [], ""), (6, None, "")], schema)
    sheets = spark.createDataFrame([(i, "Table A", "d", True, "reference") for i in range(1, 7)], "task_id int, title string, document string, document_exists boolean, authority string")
    got = {r.task_id: (r.status, r.unbound) for r in provenance.lineage_check(tasks, sheets).collect()}
    assert got == {1: ("ok", []), 2: ("ok", []), 3: ("warn", ["Table A (Формулы, справочный источник)"]), 4: ("invalid", ["Other", "data_used[1]"]), 5: ("ok", []), 6: ("skipped", [])}


def test_only_rendered_sheets_stay(spark):
    sheets = spark.createDataFrame([(1, "Table A"), (1, "Table B"), (2, "Table A")], "task_id int, title string")
    contexts = spark.createDataFrame([(1, "### table  a\nx\n#### Table B"), (2, "Table A")], "task_id int, context string")
    assert [tuple(r) for r in provenance.rendered_sheets(sheets, contexts).collect()] == [(1, "Table A")]


def test_rendered_context_and_explicit_selection(spark):
    rows = spark.createDataFrame([(1, 2, "B", "b"), (1, 1, "A", "a")], "k int, o int, title string, content string")
    assert retrieval.rendered_context(rows, ["k"], ["o"], "title", "content").first().context == "### A\na\n\n### B\nb"
    sheets = spark.createDataFrame([(1,), (2,)], "sheet_id int")
    assert retrieval.trusted(sheets, sheets, "sheet_id", explicit=[]).count() == 0


def test_merged_sheets(spark):
    rows = [(1, 0, "table", "Acids", "a\nb"), (1, 1, "odd", "Acids", "z"), (1, 2, "table", " acids ", "b\n c\na"), (1, 3, "table", "", "x")]
    got = exports.merged_sheets(spark.createDataFrame(rows, "k int, p int, kind string, title string, content string"), "k", "p").orderBy("rank").collect()
    assert [(r.kind, r.title, r.content) for r in got] == [("table", "Acids", "a\nb\n c"), ("other", "Acids", "z")]


def test_bank(spark):
    rows = [(3, "B", "t3"), (1, None, "t1"), (2, "B", "t2")]
    got = exports.bank(spark.createDataFrame(rows, "id int, topic string, name string"), "topic", "id", ["name"]).orderBy("paragraph").collect()
    assert [(r.paragraph, r.title, [t["label"] for t in json.loads(r.tasks)]) for r in got] == [(1, exports.NO_TOPIC, ["1.1"]), (2, "B", ["2.1", "2.2"])]


def test_packing_tries_later_rows(spark):
    rows = [(1, i, s) for i, s in enumerate([50, 100, 30, 5])]
    got = retrieval.pack_greedy(spark.createDataFrame(rows, "k int, o int, size int"), ["k"], ["o"], "size", 90, 60).orderBy("o").collect()
    assert [(r.given, r.state) for r in got] == [(50, "whole"), (0, "left_out"), (30, "whole"), (5, "whole")]


def test_page_index(value):
    pages = {"pages": [{"page": 2, "markdown": "two ![i](u)", "figure_metadata": [{"ai_description": " a  b "}, {"ai_description": "a b"}]}, {"page_num": 1, "markdown": "one"}, {"page": 9, "markdown": " "}]}
    got = value(readers.page_index(L(json.dumps(pages))))
    assert (got.n_pages, got.state) == (2, "ok")
    assert got.markdown == f"{readers.PAGE}1\n\none\n\n{readers.PAGE}2\n\ntwo\n\n{readers.FIGURES}\n{readers.WARNING}\n- a b"
    assert value(readers.page_index(L("[]")))["state"] == "not_an_index"
    assert value(readers.page_index(L("nonsense")))["state"] == "not_an_index"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"caf\xc3\xa9 \xff")
    assert readers.text_files(spark, str(tmp_path)).first().text == "café �"
    (tmp_path / "i").mkdir()
    (tmp_path / "i/x.json").write_text(json.dumps([{"markdown": "m"}]))
    assert readers.page_index_files(spark, str(tmp_path / "i")).first().n_pages == 1
    sinks.dump({"t": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/t")).count() == 3
    assert sinks.reconcile(spark.range(3), spark.range(2), "id").count() == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("some-\nthing  here\n12\n")
    rows = ingest.document_stream(spark, str(tmp_path / "in"))
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.txt").write_text("some-\nthing  here\n12\n")
        ingest.to_table(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.window for r in got] == ["something here"] * 2 and len({r.path for r in got}) == 2


def test_progress_stream_equals_the_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("*", "cast(ts AS timestamp) AS at")
    source.write.parquet(str(tmp_path / "in"))
    stream = ingest.progress(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), "user_id", "event_type", "at", "0 seconds")
    ingest.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(str(r.day)[:10], r.user_id): r.total for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.day, r.user_id): r.n for r in source.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count("*").alias("n")).collect()}
    last = max(d for d, _ in want)  # the last day's window is still open
    assert got and got == {k: v for k, v in want.items() if k[0] < last}


def test_rules_without_facts_are_indeterminate(value):
    null = L(None).cast("double")
    assert value(rules.calibration(L(1.0), L(0.0), null, L(1.0), L(0.0), L(2.0))["state"]) == "indeterminate"
    assert value(rules.calibration(L(0.0), L(0.0), L(1.0), L(1.0), L(0.0), L(2.0))["state"]) == "fail"


@pytest.mark.parametrize(
    ("factor", "mass", "state"),
    [("0.69943", "1.3989", "pass"), ("0.699431", "1.3989", "pass"), ("0.699430", "1.3989", "fail"), ("0,69943", "1.3989", "pass"), ("0.6994", "1.3989", "fail"), ("0.69944", "1.3989", "fail"), ("0.7", "1.3989", "fail"), ("0.70", "1.3989", "fail"),
     ("0.69943", "1.3988", "fail"), ("0.69943", "1.40", "pass"), ("0.69943", "1", "fail"), ("x", "1.3989", "indeterminate"), ("0.69943", None, "indeterminate"), ("0", "1.3989", "fail")],
)
def test_gravimetry_audits_digits(value, factor, mass, state):
    given = [L("2"), L("55.845"), L("1"), L("159.687"), L(factor), L("2.00"), L(mass).cast("string")]
    assert value(rules.gravimetry(*given)["state"]) == state


@pytest.mark.parametrize(("statement", "state"), [("M = 55,845 г/моль и 159.687 г/моль, m = 2 г", "pass"), ("M = 55,845 г/моль, m = 2 г", "fail"), ("M = 55,845 г/моль и 159.687 г/моль, m = 3 г", "fail"), (None, "fail")])
def test_hidden_inputs_fail(value, statement, state):
    given = [L("2"), L("55.845"), L("1"), L("159.687"), L("0.69943"), L("2.00"), L("1.3989")]
    assert value(rules.gravimetry(*given, L(statement).cast("string"))["state"]) == state
    cell = [L(50.0), L(0.02), L(100.0), L(2.0)]
    assert value(rules.conductometry(*cell, L("G = 20 mS, k = 1 см⁻¹"))["state"]) == "pass"
    assert value(rules.conductometry(*cell, L("G = 21 mS, k = 1 см⁻¹"))["state"]) == "fail"
    assert value(rules.smoluchowski(L(3e-8), L(1e-3), L(3e-8 * 1e-3 / 80 / rules.VACUUM_PERMITTIVITY), L(80.0), L(100.0), L("ε₀ = 8,854·10⁻¹² Ф/м"))["state"]) == "pass"


def test_what_cannot_be_calculated_is_an_error(value):
    broken = rules.outcome("x", [L(1.0)], [L(None).cast("boolean"), L(False)])
    assert value(broken["state"]) == "error"
    assert value(rules.titration(*[units.measure(L(1.0), u) for u in ("mol/L", "L")], L(0.0), *[units.measure(L(1.0), u) for u in ("mol/L", "L")], L(1.0))["state"]) == "fail"
    assert value(rules.dlvo(L(-1.0), L(1.0), L(0.0), L(1.0), L(True), L(False), L(False))["state"]) == "fail"


def test_routes_to_an_amount(value):
    at = lambda x, u: units.measure(L(x), u)
    assert value(rules.amount(at(18.0, "г"), at(18.0, "г/моль"))) == pytest.approx(1.0)
    assert value(rules.amount(at(2.0, "mol/L"), at(500.0, "mL"))) == pytest.approx(1.0) == value(rules.amount(at(500.0, "mL"), at(2.0, "mol/L")))
    assert value(rules.amount(at(3.0, "моль"), at(1.0, "mL"))) == 3.0 and value(rules.amount(at(3.0, "г"), at(1.0, "mL"))) is None
    relation = lambda s: value(rules.amount_relation(L(s))["state"])
    assert relation("c = 2 моль/л; V = 500 мл; n = 1 моль") == "pass" and relation("c = 2 моль/л; V = 500 мл; n = 2 моль") == "fail" and relation("c = 2 моль/л") == "not_applicable"


def test_declared_excess(spark):
    part = "array<struct<name:string,coefficient:double,amount:double>>"
    rows = [(1, [("A", 2.0, 2.0), ("B", 1.0, None)], (3.0, 3.0), "A", ["B"]), (2, [("A", 2.0, 2.0), ("B", 1.0, None)], (3.0, 3.0), "A", None), (3, [("A", 2.0, 2.0), ("B", 1.0, 0.5)], (3.0, 3.0), "A", [])]
    tasks = spark.createDataFrame(rows, f"id int, reactants {part}, target struct<coefficient:double,amount:double>, limiting string, excess array<string>")
    assert {r.id: r.state for r in rules.stoichiometry(tasks, "id").collect()} == {1: "pass", 2: "indeterminate", 3: "fail"}


def test_reaction_results(spark):
    rows = [(1, "2H2 + O2 -> 2H2O"), (2, "H2 + O2 -> H2O and 2H2 + O2 -> 2H2O"), (3, "no equation"), (4, None)]
    got = {r.id: r.state for r in rules.reaction_results(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {1: "pass", 2: "fail", 3: "not_applicable", 4: "not_applicable"}
    rows = [(1, "H2 + O2 = H2O в прозе"), (2, "Реакция 2H2 + O2 = 2H2O идёт"), (3, "смесь x → ???"), (4, "n = cV = 0.030 mol"), (5, "Cr: +6 → +3"), (6, "Cr: +6 → +3; 2H2 + O2 -> 2H2O")]
    got = {r.id: r.state for r in rules.reaction_results(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {1: "fail", 2: "pass", 3: "indeterminate", 4: "not_applicable", 5: "not_applicable", 6: "pass"}


GOLDEN_ANSWERS = [
    ("F_g = 0.3621; m_MgO = 0.09052 г; w_MgO = 22.63%", "F_g = 0.3621; масса MgO = 0.09052 г; массовая доля MgO = 22.63%", "match"),
    ("m_MgO = 0.09052 г; w_MgO = 22.63%", "масса CaO = 0.09052 г; массовая доля CaO = 22.63%", "mismatch"),
    (r"$F_g = 0.2783$; $m(\mathrm{P}) = 0.1703\ \text{г}$; $w(\mathrm{P}) = 22.71\%$.", "Фактор F_g = 0.2783; масса фосфора в навеске = 0.1703 г; массовая доля фосфора в удобрении = 22.71%.", "match"),
    ("m(P) = 0.1703 г; w(P) = 22.71%", "масса азота в навеске = 0.1703 г; массовая доля азота в образце = 22.71%", "mismatch"),
    ("m_sample = 0.09052 г", "масса образца = 0.09052 г", "mismatch"),
    (r"$F_g = 0.2032;~ m(\mathrm{Ni}) = 0.04538~\text{г};~ w(\mathrm{Ni}) = 9.08~\%$", "Fg = 0.2031, m(Ni) = 0.04538 г, ω(Ni) = 9.076%", "match"),
    (r"$Q=73.1\ \text{Кл};~n(e^-)=7.58\cdot10^{-4}\ \text{моль};~m(Ag)=8.18\cdot10^{-2}\ \text{г}$", "Q=73.1 Кл; n(e-)=7.58×10⁻⁴ моль; m(Ag)=0.0818 г", "match"),
    ("w1 = 5", "w1 = w2 = 5", "match"), ("w1 = w2 = 5", "w1 = 5", "incomplete"), ("w1 = w2 = 5", "w1 = w2 = 5", "match"), ("w_1 = 5", "w_2 = 5", "mismatch"),
    ("x = 0,12345", "x = 0,12345 (0,12)", "match"), ("x = 0,12345", "x = 0,12345 (0,13)", "incomplete"), ("m = 1,2345 г", "m = 1,2345 г (1,23 г)", "match"), ("m = 1,2345 г", "m = 1,2345 г (1,23 мл)", "incomplete"),
    (r"$F_g=0.2032;~m(\mathrm{Ni})=0.04538~\text{г};~w(\mathrm{Ni})=9.08~\%$", "Fg=0.2032; m(Ni)=0.04538 мг; ω(Ni)=9.08%", "incomplete"), ("V = 2 л", "V = 2 дм^3", "match"), ("V = 2 дм^3", "V = 2 л", "match"),
    ("S_уд = 183 м²/г", "S_уд = 1.8·10² м²/г (183 м²/г)", "match"), ("S_уд = 183 м²/г", "S_уд = 1.7·10² м²/г (183 м²/г)", "incomplete"), ("S_уд = 183 м²/г", "S_уд = 1.8·10² м²/кг (183 м²/г)", "incomplete"),
    ("ζ = 0.020 V и 20 mV", "ζ = 20 mV", "match"), ("ζ = 0.020 V и 30 mV", "ζ = 20 mV", "incomplete"), ("μ = 1e-8 m²/(V·s)", "μ = 1e-8 cm²/(V·s)", "mismatch"), ("μ = 1e-8 m²/(V·s)", "μ = 1e-4 cm²/(V·s)", "match"),
    ("S = 183 м²/г", "S = 183 м²/кг", "mismatch"), ("S = 183 м²/г", r"S = 183 \text{м}^2/\text{г}", "match"), ("V = 2 см³", "V = 2 м³", "mismatch"), ("V = 2 см³", "V = 2 мл", "match"), ("ζ = 0.020 V", "градиент = 20 mV/cm", "mismatch"), ("E = 5 mV/cm", "E = 0,5 V/m", "match"),
    ("x = 5 qq/zz", "x = 5 г/л", "mismatch"), ("x = 5 qq/zz", "x = 5 QQ/zz", "match"), ("x = 5 молекул", "x = 5 штук", "match"), ("x = 5", "x = 5 г", "match"), ("m = 5 г", "m = 5", "mismatch"), ("k = 2 1/моль", "k = 2 моль⁻¹", "match"), ("H = 2 кДж/моль", "H = 2000 Дж·моль^{-1}", "match"),
    ("c = 1e-12 mol/L", "c = 9e-10 mol/L", "mismatch"), ("Q = 5 C", "I = 5 A", "mismatch"), ("η = 2 Pa·s", "η = 2 mPa·s", "mismatch"), ("ζ = 20 mV", "ζ = 0.020 V", "match"), ("w(Ni)=10 %; w(Co)=20 %", "ω(Ni)=20 %; ω(Co)=10 %", "mismatch"), ("F_g=0.2031", "Fg=0.2031", "match"),
    ("ζ = 0.020 V; отдельное напряжение Δφ = 20 mV", "ζ = 0.020 V", "incomplete"), ("Q = 225 C; n = 2.25e-3 mol; m = 243 mg", "Q = 225 C; n = 2.25e-3 mol; m = 243 mg", "match"),
    ("Среднее: 10.4975 см (или 10.498 см). Абсолютная погрешность: 0.0025 см. Относительная: 0.024%.", "Среднее 10.4975 см; абсолютная погрешность 0.0025 см; относительная 0.024%.", "match"),
    ("1) n = 0,012 моль\n2) V = 15 мл", "n = 0.0120 моль; V = 15.0 мл", "match"), ("Тогда w1 = w2 = 5", "w2 = 5", "incomplete"), ("x + w1 = w2 = 5", "w2 = 5", "match"), ("массовая доля никеля в этом сплаве = 5 %", "w(Ni) = 5 %", "match"), ("масса CaCO3 = 5 г", "m(CaCO3) = 5 г", "match"), ("масса никеля из трёх старых проб = 5 г", "m(Ni) = 5 г", "match"), ("масса никеля из трёх больших старых проб = 5 г", "m(Ni) = 5 г", "mismatch"),
    ("U = 0,020 В (20 мВ)", "U = 20 мВ", "match"), ("V = 5 или 6", "V = 6", "match"), ("c = 0,010 моль/л", "n = 0,001 моль / 100 мл = 0,010 моль/л", "incomplete"),
]


def test_answers_against_golden_rows(spark):
    rows = [(k, a, b) for k, (a, b, _) in enumerate(GOLDEN_ANSWERS)]
    got = {r.k: r.verdict for r in answers.compare_answers(spark.createDataFrame(rows, "k int, a string, b string"), "a", "b", L(0.5)).collect()}
    assert [(a, b, got[k]) for k, (a, b, _) in enumerate(GOLDEN_ANSWERS)] == GOLDEN_ANSWERS


def test_units_of_one_label(value):
    state = lambda s, a: value(rules.unit_consistency(L(s), L(a), L(True))["state"])
    assert state("m = 5 г; m = 7 мл", "5 г") == "fail" and state("m = 5 г", "5") == "warning" and state("m = 5 г", "5 г") == "pass" and state("text", "5") == "not_applicable"


def test_a_model_on_both_lists_is_advisory(value):
    assert value(admission.model_use(L(" M1 "), ["m1"], ["m1"])) == "advisory" and value(admission.model_use(L(None).cast("string"), ["m1"], [])) == "unlisted"


def test_once_reads_each_different_input_once(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (2, "a", None), (3, None, "x"), (4, "a", "")], "id int, s string, t string")
    sizes = []

    def read(inputs):
        sizes.append(inputs.count())
        return inputs.withColumn("said", F.concat_ws("|", F.coalesce("s", F.lit("?")), F.coalesce("t", F.lit("?"))))

    got = sorted((r.id, r.said) for r in relational.once(rows, ["s", "t"], read).collect())
    assert got == [(1, "a|?"), (2, "a|?"), (2, "a|?"), (3, "?|x"), (4, "a|")] and sizes == [3]


def test_once_deals_small_texts_over_all_tasks(spark):
    """Bytes say nothing of the work that a text makes, so texts of a few bytes are not merged for one task."""
    rows = spark.range(2000).select(F.concat(F.lit("m = "), F.col("id").cast("string")).alias("s"))
    read = relational.once(rows, ["s"], lambda inputs: inputs.withColumn("task", F.spark_partition_id()))
    assert read.select("task").distinct().count() >= spark.sparkContext.defaultParallelism and read.count() == 2000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_guards_are_found_in_shares_of_the_grades(spark):
    """Tasks are by the number of grades, not merged by bytes; a repeated criterion, or one without a name, is that of its grader only."""
    grades = [(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (3, 1, "a"), (3, 1, "a"), (3, 2, "a"), (4, 1, "a"), (4, 2, "b"), (5, 1, None), (5, 2, None), (6, 1, "a"), (6, 1, "b"), (6, 2, "b"), (6, 2, "a")]
    rows = spark.createDataFrame([(*g, 10.0) for g in grades] + [(7, 1, "a", 10.0), (7, 2, "a", 11.0)], "run int, role int, criterion string, max_score double")
    out = grading.consensus_guards(rows)
    plan = plan_of(out)
    assert {r.run: r.state for r in out.collect()} == {1: "ok", 2: "too_few", 3: "repeated_role", 4: "criteria_differ", 5: "repeated_role", 6: "ok", 7: "maxima_differ"}
    assert plan.count("Exchange") == 2 and "REPARTITION_BY_NUM" in plan
    assert relational.dealt(rows, ["run"], 1000, 10).rdd.getNumPartitions() == 100
