from __future__ import annotations

import hashlib
import json
import math
import random
import struct
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import canonical, chemistry, numbers, stem, text, unit_grammar, units

L = F.lit
NULL = lambda: F.lit(None).cast("string")
QUICK = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize(
    ("given_text", "clean"),
    [("свойст-\nвами a  b \r\n12\nx\n\n\n\ny", "свойствами a b\nx\n\ny"), ("", ""), ("a­b\r", "ab"), ("\n\n 7 \n\n", "")],
)
def test_clean_lines(value, given_text, clean):
    assert value(text.clean_lines(L(given_text))) == clean


def test_clean_lines_of_null(value):
    assert value(text.clean_lines(NULL())) == ""


def test_promote_headings(value):
    long = "Глава " + "x" * 130
    assert value(text.promote_headings(L(f"Глава 1. Соли\nГлавный\n§ 5\n{long}"))) == f"## Глава 1. Соли\nГлавный\n## § 5\n{long}"


def test_windows(value):
    assert value(text.windows(L("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij", "j"]
    assert value(text.windows(L(" abc "), 4, 1)) == ["abc"]
    assert value(text.windows(L("  "), 4, 1)) == []


def test_topics_keep_the_first_spelling(value):
    assert value(text.topics(F.array(L(" Acids"), L("acids "), L(""), NULL(), L("Bases")))) == ["Acids", "Bases"]


def test_ordered_union(value):
    assert value(text.ordered_union(F.array(L("b"), L("a")), F.array(L("a"), L("c")))) == ["b", "a", "c"]


@pytest.mark.parametrize(("a", "b", "share"), [("x y z", "x y", 2 / 3), ("", "", 0.0), ("a", "b", 0.0), ("q", "q", 1.0)])
def test_jaccard_is_symmetric(value, a, b, share):
    one, two = text.word_set(L(a)), text.word_set(L(b))
    assert value(text.jaccard(one, two)) == pytest.approx(share) == value(text.jaccard(two, one))


def test_canonical_json_does_not_hang_on_the_order_of_fields(value):
    one = F.struct(L(1).alias("b"), F.struct(L("x").alias("d"), L(2).alias("c")).alias("a"))
    two = F.struct(F.struct(L(2).alias("c"), L("x").alias("d")).alias("a"), L(1).alias("b"))
    assert value(text.canonical_json(one)) == value(text.canonical_json(two)) == '{"a":{"c":2,"d":"x"},"b":1}'


@pytest.mark.parametrize(
    ("raw", "fixed"),
    [(r'{"a":"\frac{1}{2}"}', {"a": r"\frac{1}{2}"}), (r'{"a":"\\frac"}', {"a": r"\frac"}), (r'{"a":"x\ny \alpha"}', {"a": "x\ny \\alpha"}), (r'{"a":"\"q\" A"}', {"a": '"q" A'})],
)
def test_latex_in_json(value, raw, fixed):
    assert json.loads(value(text.repaired_latex(L(raw)))) == fixed


def test_json_object_and_items(value):
    assert value(text.json_object(L('so ```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(text.json_object(L("none"))) is None
    assert value(text.wrapped_items(L('{"tasks":[{"a":1}]}'))) == ['{"a":1}']
    assert value(text.wrapped_items(L('{"anything":[{"a":1},{"b":2}]}'))) == ['{"a":1}', '{"b":2}']
    assert value(text.wrapped_items(L('{"statement":"s"}'))) == ['{"statement":"s"}']


def test_canonical_markdown(value):
    assert value(text.canonical_markdown(L("﻿\n\ncafé \t\r\nb\n\n\n"))) == "café\nb\n"


@pytest.mark.parametrize(
    ("word", "stemmed"),
    [("вагоны", "вагон"), ("важнейшие", "важн"), ("бегавший", "бега"), ("раствором", "раствор"), ("концентрации", "концентрац"), ("красивая", "красив"), ("был", "был"), ("деревянный", "деревя"), ("пр", "пр"), ("acid", "acid"), ("щёлочью", "щелоч")],
)
def test_stem(value, word, stemmed):
    assert value(stem.stem_ru(L(word))) == stemmed


@pytest.mark.parametrize(
    ("given_text", "tokens"),
    [
        ("масса 2,5·10⁻³ г", ["2.5e-3"]), ("$V=0{,}25$ л", ["0.25"]), ("10^{-5} и 10⁻¹⁴", ["1e-5", "1e-14"]), ("H2SO4 и x_2", []), ("1. первый 2) второй", []),
        ("−28,7 кДж", ["-28.7"]), ("a", []), ("25^3", ["25"]), ("1 000", ["1", "000"]), ("1 000,5", ["1000.5"]),
    ],
)
def test_number_tokens(value, given_text, tokens):
    assert value(numbers.number_tokens(L(given_text))) == tokens


def test_unknown_numbers(value):
    got = numbers.unknown_numbers(numbers.number_tokens(L("1,50 и +2 и 7,1 и 7,1")), numbers.number_tokens(L("1.5 2")))
    assert value(got) == ["7.1"]


@pytest.mark.parametrize(("a", "b", "rel", "near"), [(100.0, 101.0, 0.01, True), (100.0, 102.0, 0.01, False), (0.0, 1e-16, 0.01, True), (0.0, 1e-3, 0.01, False)])
def test_close(value, a, b, rel, near):
    assert value(numbers.close(L(a), L(b), rel)) is near is value(numbers.close(L(b), L(a), rel))


@pytest.mark.parametrize(("shown", "exact", "right"), [("2.68", "2.675", True), ("2.67", "2.675", False), ("3", "2.5", True), ("0.6994", "0.69943", True)])
def test_rounds_to(value, shown, exact, right):
    assert value(numbers.rounds_to(L(shown), L(exact))) is right


@pytest.mark.parametrize(("json_text", "number"), [("1.5", 1.5), ("3", 3.0), ("true", None), ('"4"', None), ("null", None)])
def test_strict_number(value, json_text, number):
    assert value(numbers.strict_number(F.parse_json(L(json_text)))) == number


@pytest.mark.parametrize(
    ("spelled", "dimension", "si"),
    [("25 мКл", "charge", 0.025), ("25 мкл", "volume", 2.5e-8), ("2 M", "amount_concentration", 2000.0), ("2 m", "length", 2.0), ("5 S", "electrical_conductance", 5.0), ("5 s", "time", 5.0), ("20 °C", "temperature", 293.15), ("3 м²/г", "specific_surface", 3000.0)],
)
def test_parse_measurement(value, spelled, dimension, si):
    got = value(units.parse_measurement(L(spelled)))
    assert (got.dimension, got.si) == (dimension, pytest.approx(si))


@pytest.mark.parametrize("spelled", ["25", "x мл", "25 parsec", "", "мл"])
def test_no_measurement(value, spelled):
    assert value(units.parse_measurement(L(spelled))) is None


def test_table_has_no_spelling_twice():
    keys = [r[0] for r in units.rows()]
    assert len(keys) == len(set(keys)) and len({r[2] for r in units.rows()}) == 26


@QUICK
@given(x=st.floats(-1e6, 1e6), unit=st.sampled_from(["мл", "°C", "кПа", "mg/L", "см²"]))
def test_units_there_and_back(value, x, unit):
    assert value(units.in_unit(units.measure(L(x), L(unit))["si"], L(unit))) == pytest.approx(x, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("spelled", ["мл", "M", "m", "S/cm", "°C", "м²/г", "Па·с", "parsec"])
def test_a_constant_unit_is_the_same(value, spelled):
    assert value(units.measure(L(2.0), spelled)) == value(units.measure(L(2.0), L(spelled)))


def test_measurements_in_text(value):
    got = value(units.measurements(L("V = 25 мл, m = 2,5 kg; 5 mV/cm не в счёт; c = 0,1 моль/л.")))
    assert [(m.value, m.unit) for m in got] == [(25.0, "mL"), (2.5, "kg"), (0.1, "mol/L")]


@pytest.mark.parametrize(("statement", "there"), [("взяли 0,025 л воды", True), ("взяли 26 мл", False), ("взяли 25 г", False), ("25", False)])
def test_stated_in_any_unit(value, statement, there):
    assert value(units.stated(L(statement), units.measure(L(25.0), "мл"))) is there


def test_last_assignment_wins(value):
    assigned = units.assigned_measurements(L("V = 25 мл, затем V = 30 мл; c₁ = 2 M"))
    assert value(units.last_assigned(assigned, ["v"])).value == 30.0
    assert value(units.last_assigned(assigned, ["c1"], ["volume"])) is None


@pytest.mark.parametrize(
    ("said", "labels"),
    [
        ("c1 = 0.100 mol/L; V1 = 25.0 mL; mu = 3.2e-8 m2/(V*s); eta = 1.0 mPa*s", ["c1", "v1", "mu", "eta"]),
        ("m = 5 г и V = 3 мл", ["m", "v"]), ("V(р-ра) = 0,25 л", ["vрра"]), ("m = 5\nV = 3 мл", ["v"]),
        ("n1 = c1 V1 = 0.400 mol/L", []), ("x = 2 мл = 3 г, y = 4 г", ["x", "y"]), ("мл = 5 г; t = 5 с", ["t"]), ("m = 5 arbitrary_units", []), ("", []),
        ("масса MnO₂ = 0,4583 г; массовая доля MnO₂ = 91,66 %; m(MnO₂) = 0,4583 г", ["mmno2"]), ("масса Fe = 0,5 г; m(Fe) = 0,5 г", ["mfe"]),
        (r"$V_1 = 30.0$ мл; $c_2 = \frac{0.4\,\text{моль/л}\times0.03\,\text{л}}{0.2\,\text{л}} = 0.06$ моль/л. $V_{\text{треб}} = 150.0$ мл", ["v1", "vтреб"]),
    ],
)
def test_only_quantities_are_assigned(value, said, labels):
    assert [x.label for x in value(units.assigned_measurements(L(said)))] == labels


@pytest.mark.parametrize(
    ("said", "found"),
    [
        (r"M(Fe) = 55.85\ \text{г/моль}; N = 6.02 \times 10^{23}\ \text{моль}^{-1}; S = 229\ \text{м}^2/\text{г}", [(55.85, "molar_mass"), (6.02e23, "reciprocal_amount"), (229.0, "specific_surface")]),
        (r"$m_{\text{нав}} = 0.5000~\text{г}$, $M(\mathrm{Mg}) = 24.31\ \text{г·моль}^{-1}$", [(0.5, "mass"), (24.31, "molar_mass")]),
        (r"0.4\,\text{моль/л}\times0.03\,\text{л}", [(0.4, "amount_concentration"), (0.03, "volume")]),
    ],
)
def test_measurements_in_formulas(value, said, found):
    assert [(x.value, x.dimension) for x in value(units.measurements(L(said)))] == found


@pytest.mark.parametrize(
    ("formula", "atoms", "charge"),
    [
        ("H2SO4", {"H": 2, "S": 1, "O": 4}, 0), ("Al2(SO4)3", {"Al": 2, "S": 3, "O": 12}, 0), ("CuSO4·5H2O", {"Cu": 1, "S": 1, "O": 9, "H": 10}, 0), ("SO₄²⁻", {"S": 1, "O": 4}, -2),
        ("[Fe(CN)6]3-", {"Fe": 1, "C": 6, "N": 6}, -3), ("Fe3+", {"Fe": 1}, 3), ("NH4+", {"N": 1, "H": 4}, 1), ("e-", {}, -1), ("NaCl(aq)", {"Na": 1, "Cl": 1}, 0), ("((H)2)3", {"H": 6}, 0),
        ("x2", None, 0), ("H(", None, 0), ("", {}, 0),
    ],
)
def test_species(spark, formula, atoms, charge):
    got = chemistry.species(spark.createDataFrame([(formula,)], "f string"), "f").first()
    assert (got.atoms, got.charge) == (atoms, charge)


def test_balance_does_not_hang_on_scale(spark):
    rows = [(k, f"{2 * k}H2 + {k}O2 -> {2 * k}H2O") for k in (1, 2, 7)] + [(100, "H2 + O2 -> H2O")]
    got = {r.id: r for r in chemistry.reaction_balance(spark.createDataFrame(rows, "id int, e string"), "id", "e").collect()}
    assert [got[k].balanced for k in (1, 2, 7)] == [True] * 3
    assert got[100].balanced is False and got[100].atom_delta == {"O": -1.0}


def test_equations_in_prose(value):
    prose = "Тогда 2H2 + O2 → 2H2O, а степень меняется +6 → +3. Далее Fe + CuSO4 -> FeSO4 + Cu."
    assert value(chemistry.equations_in(L(prose))) == ["2H2 + O2 → 2H2O", "Fe + CuSO4 → FeSO4 + Cu"]


def test_the_grammar_reads_the_table(spark):
    """Every spelling of the unit table, and its vector is that of its dimension only."""
    vectors = units._names()
    assert len(vectors) == len({r[2] for r in units.rows()})
    listed = [r for r in units.rows() if "-заряд" not in r[0]]
    frame = spark.createDataFrame([(k, r[0].lstrip("=")) for k, r in enumerate(listed)], "k int, u string")
    got = {r.k: r.g for r in frame.select("k", unit_grammar.read(frame.u).alias("g")).collect()}
    for k, (_, _, dimension, factor, _) in enumerate(listed):
        assert vectors[",".join(map(str, got[k].vector))] == dimension and got[k].factor == pytest.approx(factor, rel=1e-12)


def test_unit_expressions(spark):
    cases = {
        "м²/г": ("2,-1,0,0,0,0", 1e3), "m²/(V·s)": ("0,-1,2,1,0,0", 1), "(м/с)^2": ("2,0,-2,0,0,0", 1), "Дж/(моль·К)": ("2,1,-2,0,-1,-1", 1), "кг·м^2·с^{-2}": ("2,1,-2,0,0,0", 1), "a/b": None, "г/л·с": ("-3,1,1,0,0,0", 1),
        "мм³": ("3,0,0,0,0,0", 1e-9), "МПа": ("-1,1,-2,0,0,0", 1e6), "мПа": ("-1,1,-2,0,0,0", 1e-3), "мин⁻¹": ("0,0,-1,0,0,0", 1 / 60), "кмин": None, "1/(г·(л))": None, "м//с": None, "/с": None, "(м": None, "м)": None, "": None, "м^99999": None, "5": None, "молекул": None,
        "м" * 50: None, r"г\cdot моль^{-1}": ("0,1,0,0,0,-1", 1e-3),
    }
    frame = spark.createDataFrame([(u,) for u in cases], "u string")
    for r in frame.select("u", unit_grammar.read(frame.u).alias("g")).collect():
        want = cases[r.u]
        assert (r.g is None) == (want is None), r
        if want:
            assert ",".join(map(str, r.g.vector)) == want[0] and r.g.factor == pytest.approx(want[1], rel=1e-12), r


def brute_unit(tokens):
    """Vector and log of the factor of (sign, prefix, base, power) factors."""
    vector, log = [0] * 6, 0.0
    for sign, prefix, base, power in tokens:
        factor, own, _ = unit_grammar.bases()[base]
        vector = [a + sign * power * b for a, b in zip(vector, own, strict=True)]
        log += sign * power * (math.log10(factor) + math.log10(float(unit_grammar._entries()[1].get(prefix, 1))))
    return vector, log


def test_random_products_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        parts = [(rng.choice([1, -1]) if i else 1, rng.choice(["", "к", "м", "мк"]), rng.choice(["м", "моль", "Па", "В", "Дж"]), rng.choice([1, 2, -1, -3])) for i in range(rng.randint(1, 4))]
        bases = unit_grammar.bases()
        parts = [(s, p, b if b in bases else b.lower(), n) for s, p, b, n in parts]
        said = "".join(("" if i == 0 else "·" if s == 1 else "/") + p + b + ("" if n == 1 else f"^{n}") for i, (s, p, b, n) in enumerate(parts))
        rows.append((k, said, *brute_unit(parts)))
    frame = spark.createDataFrame([(k, said) for k, said, _, _ in rows], "k int, u string")
    got = {r.k: r.g for r in frame.select("k", unit_grammar.read(frame.u).alias("g")).collect()}
    for k, said, vector, log in rows:
        assert list(got[k].vector) == vector and math.log10(got[k].factor) == pytest.approx(log, abs=1e-6), said


@pytest.mark.parametrize("prose, found", [
    ("Разложение MgCO3 = MgO идёт", ["MgCO3 = MgO"]), ("P = F", []), ("V = IR", []), ("n = m/M; c = 5", []), ("U = 5 В", []), ("As shown, 2H2 + O2 -> 2H2O.", ["2H2 + O2 → 2H2O"]),
    ("Zn + 2H+ → Zn2+ + H2 в кислоте", ["Zn + 2H+ → Zn2+ + H2"]), ("шаг 1: CaCO3 → CaO → Ca(OH)2", ["CaCO3 → CaO", "CaO → Ca(OH)2"]), ("Cr: +6 → +3", []), ("Fe: +2 → +3, поэтому Fe2+ → Fe3+ + e-", ["Fe2+ → Fe3+ + e-"]),
    ("Reaction → product", ["Reaction → product"]), ("$CuSO_4·5H_2O → CuSO_4 + 5H_2O$", ["CuSO_4·5H_2O → CuSO_4 + 5H_2O"]), ("H2+O2=H2O", ["H2+O2 = H2O"]), ("a = b = c", []), ("NaCl = NaCl = x", []), ("", []), ("2 H2 (g) + O2 (g) -> 2 H2O (l), затем", ["2 H2 (g) + O2 (g) → 2 H2O (l)"]),
    ("Na+ + Cl- → NaCl", ["Na+ + Cl- → NaCl"]), ("[Fe(CN)6]3- + e- → [Fe(CN)6]4-", ["[Fe(CN)6]3- + e- → [Fe(CN)6]4-"]), ("SO₄²⁻ + Ba²⁺ → BaSO₄", ["SO₄²⁻ + Ba²⁺ → BaSO₄"]), ("mH2 = 5", []),
])
def test_sides_grow_from_the_separator(value, prose, found):
    assert value(chemistry.equations_in(L(prose))) == found


def brute_latex(raw):
    """Backslash by backslash."""
    out, i = "", 0
    begins, whole = (tuple(x.split()) for x in (text.LATEX_BEGINS, text.LATEX_WHOLE))
    while i < len(raw):
        if raw[i] != "\\":
            out, i = out + raw[i], i + 1
            continue
        j = i
        while j < len(raw) and raw[j] == "\\":
            j += 1
        rest, run = raw[j:], raw[i:j]
        code = len(rest) > 4 and rest[0] == "u" and all(c in "0123456789abcdefABCDEF" for c in rest[1:5])
        letter = lambda k: k < len(rest) and rest[k].isascii() and rest[k].isalpha()  # noqa: E731, B023
        command = (rest[:1] in ("b", "f") and letter(1)) or rest.startswith(begins) or any(rest.startswith(w) and not letter(len(w)) for w in whole)
        keep = rest == "" or rest[0] in '"/' or code or (rest[0] in "bfnrt" and not command)
        out += run + ("" if len(run) % 2 == 0 or keep else "\\")
        i = j
    return out


def test_latex_repair_against_brute_force(spark):
    """Every run of up to four backslashes before every kind of rest, inside and outside of strings, and random mixtures."""
    rests = ["", '"', "/", "n", "n ", "nabla", "neq", "neqx", "to", "to1", "top", "tau", "taux", "theta", "b", "b1", "beta", "f", "frac{1}{2}", "t", "r", "rho", "rhombus", "right", "u12aF", "u12a", "u00e9x", "alpha", "\n", "é", "0", "times2", "tanh", "tanhx", "tan", "v\n"]
    cases = [f"{head}{chr(92) * n}{rest}" for head in ("", 'x"', "{") for n in range(5) for rest in rests]
    rng = random.Random(5)
    cases += ["".join(rng.choice(["\\", "\\", '"', "n", "t", "to", " ", "u0041", "frac", "é", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    frame = spark.createDataFrame([(k, c) for k, c in enumerate(cases)] + [(-1, None)], "k int, t string")
    got = {r.k: r.x for r in frame.select("k", text.repaired_latex(frame.t).alias("x")).collect()}
    assert got.pop(-1) is None
    assert [(c, got[k]) for k, c in enumerate(cases)] == [(c, brute_latex(c)) for c in cases]


def test_canonical_numbers(spark):
    rng = random.Random(6)
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 1e16, 1e15, 123456789012345680.0, 9999999999999998.0, 1e-4, 1e-5, 0.00012345, 1e21, 1e22, 1e23, 2.0**-44, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 100.0, 1 / 3, 2 / 3, 1e100, 4.35, 0.3, 2e-3, 9007199254740993.0, 2**63 * 1.0]
    xs += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(500)] + [float(rng.randint(0, 10**17)) for _ in range(100)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(xs)] + [(-1, math.nan), (-2, math.inf), (-3, None)], "k int, x double")
    got = {r.k: r.s for r in frame.select("k", canonical.json_number(frame.x).alias("s")).collect()}
    assert [got.pop(k) for k in (-1, -2, -3)] == [None] * 3
    assert [got[k] for k in range(len(xs))] == [json.dumps(x) for x in xs]


def test_canonical_json_of_nested_values(spark):
    values = {"b": [1, None, 3], "a": {"z": 'q"\\\n\u0001\x7fé😀', "ё": None, "_": -0.0, "B": True}, "m": {"k2": 1.5, "k1": 1e21}, "e": [], "none": None}
    schema = "b array<int>, a struct<z:string,`ё`:string,_:double,B:boolean>, m map<string,double>, e array<string>, none struct<x:int>"
    row = spark.createDataFrame([(values["b"], (values["a"]["z"], None, -0.0, True), values["m"], [], None)], schema)
    got = row.select(canonical.canonical(F.struct("*"), row.schema).alias("j"), canonical.digest(F.struct("*"), row.schema).alias("d")).first()
    want = json.dumps(values, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got.j == want and got.d == hashlib.sha256(want.encode()).hexdigest()


def test_json_number_takes_few_tries_and_the_shortest_digits(spark):
    rnd = random.Random(5)
    xs = [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(20_000)] + [s * 2.0**k for k in range(-1074, 1024, 7) for s in (1, -1)]
    xs += [round(rnd.uniform(0, 1e5), 2) * f for f in (1e-11, 1e-7, 1e-3, 1, 1e5, 1e12, 1e19, 1e297) for _ in range(500)] + [rnd.uniform(0, 1e5) / 3 for _ in range(500)]
    xs += [sys.float_info.min, math.nextafter(sys.float_info.min, 0), 5e-324, 1e22, 1e23, 9007199254740993.0, 2e-3, 0.1, 0.3, 123456789012345.0, 999999999999999.9, -0.0, 0.0]
    xs = [x for x in xs if math.isfinite(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", canonical.json_number(F.col("x")).alias("s"))
    got = [(r.x, r.s) for r in df.collect()]
    assert [(x, s) for x, s in got if float(s) != x or len(s) > len(repr(x)) + 1] == []
    assert sum(s != repr(x) for x, s in got) < 20  # beyond 2 ** 124 the JVM's digits, of which a few are one too many
    assert df._jdf.queryExecution().optimizedPlan().toString().count("format_string") < 25


READ = [
    r"m = 2.5 г, V(р-ра) = 0,25 л; n = c₁ = 0.03 моль·л^{-1}; масса MnO₂ = 3 г и n₁ = 2 моль", r"$V = 2\ \text{л}$; R = 5 мОм", "1. m = 3 г\n2) V = 4 мл и 5 парсек; k = 2 A·с", "слова без чисел", "", None,
]


@pytest.mark.parametrize("said", READ)
def test_all_measurements_are_both_kinds(value, said):
    text = L(said).cast("string")
    got = value(units.all_measurements(text))
    assert got.found == value(units.measurements(text)) and got.assigned == value(units.assigned_measurements(text))


def test_measurements_query_spells_a_text_once(spark, monkeypatch):
    """Found and assigned measurements come from one reading of the text, with one expression for the units."""
    from gleaner.operators import relational
    from gleaner.plans import QUERIES

    plans = []
    monkeypatch.setattr(relational, "once", lambda rows, inputs, read: plans.append(read(rows.select(*inputs))) or rows.crossJoin(plans[0].drop(*inputs).limit(0)))
    QUERIES["measurements"](spark, "/root/testdata/sf0.001")
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("mathrm|operatorname") == 1 and plan.count("aggregate(regexp_extract_all") == 1  # the lexer of texts, the grammar of units


@pytest.mark.parametrize(("said", "tokens"), [
    ("слова, and words \t日本 é\nfurther.", ["слова, and words \t日本 é\nfurther."]), ("a b ^2 c", ["a b", " ^", "2", " c"]), ("m − 3⁵", ["m ", "−", " ", "3", "⁵"]),
    ("see 1. first 2) second", ["see", " ", "1", ".", " ", "first", " ", "2", ")", " ", "second"]), ("x = 1, 2", ["x = ", "1", ", ", "2"]),
])
def test_runs_of_words_are_one_token(value, said, tokens):
    """But for the blanks and stops by which numbers of a list's items are told."""
    assert value(F.regexp_extract_all(L(said), L(f"(?u){numbers._TOKENS}"), L(0))) == tokens
