"""Number, unit, answer and rule plans. Facts come from line items and orders by fixed formulas that the SQL repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import chemistry as C
from gleaner.functions import numbers as N
from gleaner.functions import unit_grammar
from gleaner.functions import units as U
from gleaner.operators import answers
from gleaner.operators import relational
from gleaner.operators import rules as R

from .registry import query, table


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]+(\\.[0-9]+)?')) AS n, round(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+(\\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE))) / 1e6, 3) AS millions FROM documents""")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain decimal numbers; the whole grammar is tested on fixtures."""
    tokens = N.plain_tokens("text")
    values = N.as_doubles(tokens)
    total = F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / 1e6, 3))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), total.alias("millions"))


@query()
def number_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", N.number_tokens("text").alias("tokens"))  # read once
    return tokens.select("doc_id", N.as_doubles(F.col("tokens")).alias("values"), N.number_keys(F.col("tokens")).alias("keys"))


UNITS_SQL = "(VALUES ('мл', 'mL', 1e-6), ('mL', 'mL', 1e-6), ('мКл', 'mC', 1e-3), ('M', 'mol/L', 1000.0), ('ммоль/л', 'mmol/L', 1.0), ('°C', '°C', 1.0), ('parsec', NULL, NULL)) u(unit, symbol, factor)"
SPELLINGS = ["мл", "mL", "мКл", "M", "ммоль/л", "°C", "parsec"]


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, list_extract(['мл', 'mL', 'мКл', 'M', 'ммоль/л', '°C', 'parsec'], CAST(l_partkey % 7 + 1 AS INT)) AS unit FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, symbol, round(l_quantity * factor + CASE WHEN symbol = '°C' THEN 273.15 ELSE 0 END, 9) AS si FROM l JOIN {UNITS_SQL} USING (unit)""")
def unit_si_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    rows = U.join_units(table(spark, sf_dir, "lineitem").withColumn("unit", spelled), F.col("unit"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "symbol", F.round(F.col("l_quantity") * F.col("factor") + F.col("offset"), 9).alias("si"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 1e-3 / 1e-6, 6) AS in_ml, true AS same FROM lineitem""")
def measurement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`23.0 дм³` read back from text and turned into millilitres."""
    m = U.parse_measurement(F.concat(F.col("l_quantity").cast("string"), F.lit(" дм³")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", m.alias("m"))
    again = U.measure(F.col("l_quantity") * 1000, "мл")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(U.in_unit(F.col("m.si"), "mL"), 6).alias("in_ml"), U.same_quantity(F.col("m"), again).alias("same"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - l_quantity * 1000) <= greatest(0.5 * greatest(abs(l_extendedprice), abs(l_quantity * 1000)), 1e-15) AS near, abs(l_extendedprice - l_quantity * 1000) / greatest(abs(l_extendedprice), abs(l_quantity * 1000), 1e-30) AS error FROM lineitem""")
def rel_close_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.close(a, b, 0.5).alias("near"), N.relative_error(a, b).alias("error"))


SAID = ["12,5", "abc", "1e3", "", " 7 ", "-0,5", "NaN", "inf", "1 2", "0x10"]


@query(f"""WITH e AS (SELECT event_id, value, event_id % 5 AS kind, replace(trim(list_extract({SAID}, CAST(user_id % 10 + 1 AS INT))), ',', '.') AS said FROM events)
    SELECT event_id, CASE WHEN kind = 0 THEN value WHEN kind = 1 THEN CAST(floor(value) AS DOUBLE) END AS strict, CASE WHEN regexp_full_match(said, '[-+]?[0-9]+([.][0-9]*)?(e[0-9]+)?') THEN CAST(said AS DOUBLE) END AS lenient FROM e""")
def strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values that are numbers, texts of numbers, booleans or null; texts with decimal commas, blanks, words and what is no finite number."""
    case, v = F.col("event_id") % 5, F.col("value").cast("string")
    json = F.when(case == 0, v).when(case == 1, F.floor("value").cast("string")).when(case == 2, F.concat(F.lit('"'), v, F.lit('"'))).when(case == 3, "true").otherwise("null")
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("user_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", N.strict_number(F.parse_json(json)).alias("strict"), N.lenient_number(said).alias("lenient"))


def compared(rows: DataFrame) -> DataFrame:
    """rows with the comparison of `given` with `reference` at 1 %, made once for equal pairs of texts."""
    return relational.once(rows, ["reference", "given"], lambda texts: answers.compare_answers(texts, "reference", "given", F.lit(1.0)))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'mismatch' WHEN p_size % 3 = 0 THEN 'incomplete' WHEN p_size % 2 = 0 THEN 'incomplete' ELSE 'match' END AS verdict, 2 AS n_required, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS n_matched FROM part""")
def answer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    at = lambda n: F.col("p_size") % n == 0
    reference = F.concat(F.lit("m = "), price.cast("string"), F.lit(" г; V = 25 мл"))
    first = F.concat(F.lit("m = "), price.cast("decimal(18,2)").cast("string"), F.lit(" г"))
    given = F.when(at(5), "m = 1 г; V = 999 мл").when(at(3), first).otherwise(F.concat(first, F.lit("; V = 0,025 л"), F.when(at(2), "; T = 77 К").otherwise("")))
    rows = table(spark, sf_dir, "part").select("p_partkey", reference.alias("reference"), given.alias("given"))
    return compared(rows).select("p_partkey", "verdict", "n_required", "n_matched")


# Parts of unit expressions: prefixes with the power of ten, bases with their exponents over m, kg, s, A, K, mol, and what is divided by.
UNIT_PARTS = {
    "prefix": [("", 0), ("к", 3), ("м", -3), ("мк", -6)],
    "base": [("м", (1, 0, 0, 0, 0, 0)), ("моль", (0, 0, 0, 0, 0, 1)), ("Па", (-1, 1, -2, 0, 0, 0)), ("В", (2, 1, -3, -1, 0, 0))],
    "power": ["", "²", "^{3}", "⁻¹"],
    "rest": [("", (0, 0, 0, 0, 0, 0)), ("/с", (0, 0, -1, 0, 0, 0)), ("/(кг·К)", (0, -1, 0, 0, -1, 0)), (" · с^-1", (0, 0, -1, 0, 0, 0)), ("/(с·К)²", (0, 0, -2, 0, -2, 0)), ("/фут", None)],
}


def _axis(k: int) -> str:
    base = [v[k] for _, v in UNIT_PARTS["base"]]
    rest = [v[k] if v else 0 for _, v in UNIT_PARTS["rest"]]
    return f"list_extract({base}, b) * power + list_extract({rest}, r)"


@query(f"""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_partkey % 4 + 1 AS p, l_partkey // 4 % 4 + 1 AS b, list_extract([1, 2, 3, -1], l_linenumber % 4 + 1) AS power, l_orderkey % 6 + 1 AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r <> 6 THEN concat_ws(',', {', '.join(f'CAST({_axis(k)} AS VARCHAR)' for k in range(6))}) END AS vector,
        CASE WHEN r <> 6 THEN round(log10(l_quantity) + power * list_extract([0, 3, -3, -6], p), 6) END AS magnitude FROM u""")
def unit_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements in compound units, put together from prefixes, bases, powers in three notations and divisors: exponents and size in SI."""
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    key, names = F.col("l_partkey"), lambda part: [x[0] for x in UNIT_PARTS[part]]
    spelled = F.concat(pick(names("prefix"), key % 4), pick(names("base"), F.floor(key / 4) % 4), pick(UNIT_PARTS["power"], F.col("l_linenumber") % 4), pick(names("rest"), F.col("l_orderkey") % 6))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", unit_grammar.read(spelled).alias("u"))
    size = F.round(F.log10(F.col("l_quantity") * F.col("u.factor")), 6)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.col("u.vector").cast("array<string>"), ",").alias("vector"), F.when(F.col("u").isNotNull(), size).alias("magnitude"))


# Units in which a specific surface may be given: m² a kg; the last ones are other quantities, of which one has no name.
SURFACES = [("м²/г", 1e3), ("м^2/кг", 1.0), ("см²/мг", 100.0), ("м²·кг⁻¹", 1.0), ("мм^{2}/(мкг)", 1e3), ("м²", None), ("м²/(г·с)", None), ("м²/пуд", None)]


@query(f"""WITH a AS (SELECT p_partkey, p_retailprice AS r, list_extract({[f or 0 for _, f in SURFACES]}::DOUBLE[], p_partkey % 8 + 1) AS factor, 1 + (p_size % 13 - 6) * 0.0031 AS off, p_size % 7 = 0 AS unscaled FROM part),
    g AS (SELECT *, CASE WHEN factor = 0 OR unscaled THEN r * off ELSE r * 1000 / factor * off END AS given FROM a),
    v AS (SELECT *, factor > 0 AND abs(given * factor - r * 1000) <= 0.01 * greatest(given * factor, r * 1000) AS fits FROM g)
    SELECT p_partkey, CASE WHEN fits THEN 'match' ELSE 'mismatch' END AS verdict, CAST(fits AS INT) AS n_matched FROM v""")
def answer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in compound units of one dimension, of another, and unreadable ones, up to 1.9 % off with a tolerance of 1 %; some keep
    the number but not the unit."""
    at = (F.col("p_partkey") % 8 + 1).cast("int")
    unit, factor = F.element_at(F.array(*[F.lit(u) for u, _ in SURFACES]), at), F.element_at(F.array(*[F.lit(float(f or 0)) for _, f in SURFACES]), at)
    r, off = F.col("p_retailprice"), 1 + (F.col("p_size") % 13 - 6) * 0.0031
    value = F.when((factor == 0) | (F.col("p_size") % 7 == 0), r * off).otherwise(F.try_divide(r * 1000, factor) * off)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("S = "), r.cast("string"), F.lit(" м²/г")).alias("reference"), F.concat(F.lit("S = "), value.cast("string"), F.lit(" "), unit).alias("given"))
    return compared(rows).select("p_partkey", "verdict", "n_matched")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 5 AS n_measurements, CASE l_partkey % 3 WHEN 0 THEN 'm,vрра,c1,n1' WHEN 1 THEN 'm,vрра,n1' ELSE 'm,vрра,v,n1' END AS labels,
    round(l_quantity * 1e-3, 9) AS m, CASE WHEN l_partkey % 3 = 0 THEN round(l_tax * 1e3, 9) END AS c1, CASE WHEN l_partkey % 3 = 2 THEN 0.002::DOUBLE END AS v FROM lineitem""")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text assigns: a concentration, or a chain that says nothing of its last name, or a second volume; and what it does not."""
    tax, case = F.col("l_tax").cast("string"), F.col("l_partkey") % 3
    middle = F.when(case == 0, F.concat(F.lit("c₁ = "), tax, F.lit(" моль/л"))).when(case == 1, F.concat(F.lit("n = c₁ = "), tax, F.lit(r" моль·л^{-1}"))).otherwise(r"$V = 2\ \text{л}$")
    statement = F.concat(F.lit("m = "), F.col("l_quantity").cast("string"), F.lit(" г, V(р-ра) = 0,25 л; "), middle, F.lit("; масса MnO₂ = 3 г и n₁ = 2 моль"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", statement.alias("statement"))
    si = lambda label, *kinds: F.round(U.last_assigned(F.col("a"), [label], list(kinds))["si"], 9).alias(label)

    def read(texts: DataFrame) -> DataFrame:
        found = texts.select("statement", U.all_measurements("statement").alias("m")).select("statement", F.col("m.assigned").alias("a"), F.size("m.found").alias("n_measurements"))
        return found.select("statement", "n_measurements", F.array_join(F.transform("a", lambda x: x["label"]), ",").alias("labels"), si("m", "mass"), si("c1", "amount_concentration"), si("v", "volume"))

    return relational.once(rows, ["statement"], read).drop("statement")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a key, and `off`: a factor up to 1.9 % from 1, so that of 13 parts some lie within the tolerance of 1 % and some beyond."""
    off = 1 + (F.col("l_partkey") % 13 - 6) * 0.0031
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), (F.col("l_discount") + 1).alias("d"), (F.col("l_tax") + 1).alias("t"), off.alias("off"))


def m(c: Column, unit: str) -> Column:
    return U.measure(c, unit)


FACTS_SQL = "f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount + 1 AS d, l_tax + 1 AS t, 1 + (l_partkey % 13 - 6) * 0.0031 AS off FROM lineitem)"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def unlike_sql(a: str, b: str, tolerance: float = 0.01) -> str:
    return f"abs(({a}) - ({b})) / greatest(abs({a}), abs({b}), 1e-30) > {tolerance}"


def rule(sql: str):
    return query(f"WITH {FACTS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, {sql} AS state FROM f")


def state(spark: SparkSession, sf_dir: str, result: Column) -> DataFrame:
    return states(facts(spark, sf_dir), result)


def states(rows: DataFrame, result: Column) -> DataFrame:
    return rows.select(*KEYS, result.alias("r")).select(*KEYS, F.col("r.state").alias("state"))


def stated(spark: SparkSession, sf_dir: str, statement: Column, wanted: str) -> tuple[DataFrame, R.Statement]:
    """The facts with their statements, of which `wanted` has been read."""
    return R.with_statement(facts(spark, sf_dir).withColumn("statement", statement), "statement", (wanted,))


@rule(f"CASE WHEN l_partkey % 11 = 0 THEN 'indeterminate' WHEN l_partkey % 17 = 0 OR (CASE WHEN l_partkey % 19 = 0 THEN 0 ELSE d END) <= 0 OR {unlike_sql('(q * 1000) * (d * 0.001)', '(q * d / t * off * 1000) * (t * 0.001)')} THEN 'fail' ELSE 'pass' END")
def rule_dilution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations and volumes; some missing, some volumes zero, some `volumes` that are masses."""
    key, q, d, t = (F.col(c) for c in ("l_partkey", "q", "d", "t"))
    v2 = F.when(key % 17 == 0, m(t, "kg")).otherwise(m(t * 1000, "mL"))
    return state(spark, sf_dir, R.dilution(F.when(key % 11 != 0, m(q, "mol/L")), m(F.when(key % 19 == 0, 0.0).otherwise(d), "L"), m(q * d / t * F.col("off") * 1000, "mmol/L"), v2))


@rule(f"CASE WHEN {unlike_sql('(q * 1000) * (d * 1e-6) / 2', '(q * d / 2 / t * off * 1000) * (t * 1e-6)')} THEN 'fail' ELSE 'pass' END")
def rule_titration(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    return state(spark, sf_dir, R.titration(m(q, "mol/L"), m(d, "mL"), F.lit(2.0), m(q * d / 2 / t * F.col("off"), "mol/L"), m(t, "mL"), F.lit(1.0)))


@rule(f"CASE WHEN l_partkey % 5 = 0 OR {unlike_sql('1 / q', '1 / q * off')} OR {unlike_sql('d / q * off * off', 'd * (1 / q * off)')} THEN 'fail' ELSE 'pass' END")
def rule_conductometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth statement hides the cell constant."""
    q, d, off = F.col("q"), F.col("d"), F.col("off")
    statement = F.concat(F.lit("R = "), q.cast("string"), F.lit(" Ом"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("; k = "), d.cast("string"), F.lit(" м⁻¹"))))
    rows, read = stated(spark, sf_dir, statement, "measurements")
    return states(rows, R.conductometry(q, 1 / q * off, d, d / q * off * off, read))


@rule(f"CASE WHEN l_partkey % 5 = 0 OR {unlike_sql('q * d / 96485.0', 'q * d / 96485.0 * off')} OR {unlike_sql('0.0635 * (q * d) * 0.9 / (2 * 96485.0) * off', '0.0635 * (q * d) * 0.9 / (2 * 96485.0)')} THEN 'fail' ELSE 'pass' END")
def rule_faraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth statement hides the constant."""
    charge, k, off = F.col("q") * F.col("d"), F.lit(96485.0), F.col("off")
    statement = F.when(F.col("l_partkey") % 5 == 0, "Найдите массу меди.").otherwise("Найдите массу меди, F = 96485 Кл/моль.")
    rows, read = stated(spark, sf_dir, statement, "numbers")
    return states(rows, R.faraday(F.col("q"), F.col("d"), charge, charge / k * off, F.lit(0.0635) * charge * 0.9 / (2 * k) * off, F.lit(0.0635), F.lit(2.0), F.lit(0.9), k, read))


@rule(f"CASE WHEN l_partkey % 17 = 0 OR {unlike_sql('q * off', '((d * q + t) - t) / d')} THEN 'fail' WHEN q * off > 40 THEN 'warning' ELSE 'pass' END")
def rule_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventeenth line has no slope."""
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    return state(spark, sf_dir, R.calibration(F.when(F.col("l_partkey") % 17 == 0, 0.0).otherwise(d), t, d * q + t, q * F.col("off"), F.lit(0.0), F.lit(40.0)))


@rule(f"CASE WHEN {unlike_sql('1 / (d + t) * off', '1 / (d + t)')} OR q >= 50 THEN 'fail' WHEN q / 50 < 0.05 OR q / 50 > 0.35 THEN 'warning' ELSE 'pass' END")
def rule_bet(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    return state(spark, sf_dir, R.bet_linear(d, t, 1 / (d + t) * F.col("off"), 1 + d / t, F.array(F.lit(0.1), q / 50)))


@rule(f"CASE WHEN l_partkey % 5 = 0 OR {unlike_sql('q * 6.02214076e23 * 1.62e-19 * off', 'q * 6.022e23 * 1.62e-19')} THEN 'fail' ELSE 'pass' END")
def rule_bet_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth statement hides the constant."""
    statement = F.when(F.col("l_partkey") % 5 == 0, "Найдите поверхность.").otherwise("Найдите поверхность, N_A = 6,022·10²³ моль⁻¹.")
    rows, read = stated(spark, sf_dir, statement, "numbers")
    return states(rows, R.bet_surface(F.col("q"), F.lit(1.62e-19), F.col("q") * R.AVOGADRO * 1.62e-19 * F.col("off"), F.lit(6.022e23), read))


@rule(f"CASE WHEN {unlike_sql('8.9e-4 * (d * 1e-8) / (78.5 * 8.8541878128e-12) * off', '8.9e-4 * (d * 1e-8) / (78.5 * 8.8541878128e-12)')} OR q <= 10 THEN 'fail' WHEN q < 50 THEN 'warning' ELSE 'pass' END")
def rule_smoluchowski(spark: SparkSession, sf_dir: str) -> DataFrame:
    mobility, viscosity, e = F.col("d") * 1e-8, F.lit(8.9e-4), F.lit(78.5)
    zeta = viscosity * mobility / (e * R.VACUUM_PERMITTIVITY) * F.col("off")
    return state(spark, sf_dir, R.smoluchowski(mobility, viscosity, zeta, e, F.col("q")))


@rule(f"CASE WHEN {unlike_sql('0.304 / sqrt(d / 100) * off * off', '0.304 / sqrt(d / 100)', 0.03)} OR (q / 100.0 > 0.1 AND l_linenumber = 2) THEN 'fail' WHEN q / 100.0 > 0.1 THEN 'warning' ELSE 'pass' END")
def rule_dlvo(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.col("d") / 100
    return state(spark, sf_dir, R.dlvo(strength, R.DEBYE_NM / F.sqrt(strength) * F.col("off") * F.col("off"), F.lit(100.0), F.col("q"), F.col("l_linenumber") == 2, F.lit(False), F.lit(True)))


FACTORS = ["0.69943", "0.699431", "0.69944", "0.6994", "0.699430", "0.7", "0.70000"]


@query(f"""WITH {FACTS_SQL}, g AS (SELECT *, list_extract({FACTORS}, CAST(l_partkey % 7 + 1 AS INT)) AS factor, round(q * 111.69 / 159.687 * CASE WHEN l_partkey % 13 = 0 THEN 1.0001 ELSE 1 END, 4) AS mass FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 OR length(factor) - 2 < 5 OR CAST(factor AS DOUBLE) <> CAST(round(111.69::DOUBLE / 159.687, CAST(length(factor) - 2 AS INT)) AS DOUBLE)
        OR abs(mass - q * 111.69 / 159.687) > 0.00005 THEN 'fail' ELSE 'pass' END AS state FROM g""")
def rule_gravimetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of more and fewer digits, right and wrong in the last; every fifth statement hides a molar mass."""
    literal = F.element_at(F.array(*map(F.lit, FACTORS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    mass = F.round(F.col("q") * 111.69 / 159.687 * F.when(F.col("l_partkey") % 13 == 0, 1.0001).otherwise(1.0), 4).cast("decimal(18,4)").cast("string")
    form = F.col("q").cast("string")
    statement = F.concat(F.lit("M = 159,687 г/моль, m = "), form, F.lit(" г"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise("; M(Fe) = 55,845 г/моль"))
    rows = facts(spark, sf_dir).select(*KEYS, literal.alias("factor"), form.alias("form"), mass.alias("mass"), statement.alias("statement"))

    def read(cases: DataFrame) -> DataFrame:
        told, said = R.with_statement(cases, "statement", ("measurements",))
        return told.select(*cases.columns, R.gravimetry(F.lit("2"), F.lit("55.845"), F.lit("1"), F.lit("159.687"), F.col("factor"), F.col("form"), F.col("mass"), said)["state"].alias("state"))

    return relational.once(rows, ["factor", "form", "mass", "statement"], read).select(*KEYS, "state")


@query(f"""WITH {FACTS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q / 2 < d * 10 OR q / 2 = least(q / 2, d * 10) THEN 'A' ELSE 'B' END AS found_limiting, round(least(q / 2, d * 10) * 3, 6) AS amount, CASE WHEN {unlike_sql('least(q / 2, d * 10) * 3 * off', 'least(q / 2, d * 10) * 3')} THEN 'fail' ELSE 'pass' END AS state FROM f""")
def rule_stoichiometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, b = F.col("q"), F.col("d") * 10
    least = F.least(q / 2, b)
    part = lambda name, k, n: F.struct(F.lit(name).alias("name"), F.lit(k).alias("coefficient"), n.alias("amount"))
    rows = facts(spark, sf_dir).withColumn("id", F.struct(*KEYS, F.monotonically_increasing_id().alias("k")))
    rows = rows.select("id", F.array(part("A", 2.0, q), part("B", 1.0, b)).alias("reactants"), F.struct(F.lit(3.0).alias("coefficient"), (least * 3 * F.col("off")).alias("amount")).alias("target"), F.when(q / 2 <= b, "A").otherwise("B").alias("limiting"))
    out = R.stoichiometry(rows, "id")
    return out.select(*[F.col(f"id.{k}").alias(k) for k in KEYS], "found_limiting", F.round("amount", 6).alias("amount"), "state")


RESULTS_SQL = f"""WITH {FACTS_SQL}, r AS (SELECT l_orderkey AS id, 'chemistry.dilution' AS check_id, CASE WHEN {unlike_sql('q * d', 'q * d / t * off * t')} THEN 'fail' ELSE 'pass' END AS state FROM f UNION ALL
    SELECT l_orderkey, 'analytical.calibration', CASE WHEN {unlike_sql('q * off', '((d * q + t) - t) / d')} THEN 'fail' WHEN q * off > 40 THEN 'warning' ELSE 'pass' END FROM f)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    rules = [
        R.dilution(m(q, "mol/L"), m(d, "L"), m(q * d / t * F.col("off"), "mol/L"), m(t, "L")),
        R.calibration(d, t, d * q + t, q * F.col("off"), F.lit(0.0), F.lit(40.0)),
    ]
    return R.evaluate(facts(spark, sf_dir).withColumnRenamed("l_orderkey", "id"), "id", rules)


@query(RESULTS_SQL + """ SELECT id, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (state = 'fail'), '') AS blocking, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (state = 'warning'), '') AS warnings, count(*) AS n_applicable, bool_and(state = 'pass') AS deterministic_pass FROM r GROUP BY 1""")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.report(results(spark, sf_dir), "id")
    return out.select("id", F.array_join("blocking", ",").alias("blocking"), F.array_join("warnings", ",").alias("warnings"), "n_applicable", "deterministic_pass")


@query(RESULTS_SQL + """, s AS (SELECT id, bool_or(state IN ('fail', 'warning')) AS bad, bool_or(state = 'pass') AS good FROM r GROUP BY 1) SELECT id, CASE WHEN bad OR id % 5 = 0 THEN 'block' WHEN good THEN 'pass' ELSE 'limited' END AS effect FROM s""")
def rule_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth run also requires a check that did not run."""
    rows = results(spark, sf_dir)
    ids = rows.select("id").distinct()
    checks = R.required_checks(F.when(F.col("id") % 5 == 0, "colloid.bet").otherwise("auto"), F.array(F.lit("dilution")))
    required = ids.select("id", F.explode(checks).alias("check_id"))
    one = rows.groupBy("id", "check_id").agg(F.max_by("state", F.when(F.col("state") == "fail", 2).when(F.col("state") == "pass", 0).otherwise(1)).alias("state"))
    return R.admission_effect(one, required, "id")


EQUATIONS = [
    (1, "2H2 + O2 -> 2H2O"), (2, "H2 + O2 -> H2O"), (3, "Fe + CuSO4 = FeSO4 + Cu"), (4, "MnO4- + 5Fe2+ + 8H+ → Mn2+ + 5Fe3+ + 4H2O"), (5, "Ca(OH)2 + 2HCl → CaCl2 + 2H2O"),
    (6, "SO₄²⁻ + Ba²⁺ → BaSO₄"), (7, "x -> y"), (8, "1/2N2 + 3/2H2 <=> NH3"), (9, "CuSO4·5H2O → CuSO4 + 5H2O"), (10, "[Fe(CN)6]3- + e- → [Fe(CN)6]4-"), (11, "a = b = c"), (12, "Al2(SO4)3 + 6NaOH -> 2Al(OH)3 + 3Na2SO4"),
    (13, "MgCO3 = MgO"), (14, "2KClO3 = 2KCl + 3O2"), (15, "CaCO3 → CaO + CO2"), (16, "C2H4 = C2H4"), (17, "Zn + 2H+ → Zn2+ + H2"),
]
BALANCED = {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: None, 8: True, 9: True, 10: True, 11: None, 12: True, 13: False, 14: True, 15: True, 16: True, 17: True}


@query("""WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS a, p_partkey % 3 + 1 AS b, p_size % 3 + 1 AS c, p_partkey % 5 = 0 AS charged, p_partkey % 7 = 0 AS odd FROM part)
    SELECT p_partkey, CASE WHEN odd THEN 'unparsed' WHEN a = c AND 2 * b = c AND NOT charged THEN 'balanced' ELSE 'unbalanced' END AS state,
        CASE WHEN NOT odd THEN CAST(2 * c - 2 * a AS DOUBLE) END AS h, CASE WHEN NOT odd THEN CAST(c - 2 * b AS DOUBLE) END AS o, CASE WHEN NOT odd THEN CASE WHEN charged THEN 1.0 ELSE 0.0 END::DOUBLE END AS charge FROM p""")
def rule_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equations with coefficients from the parts, some with an electron too much, some with a word for a formula: which atoms and charges are left."""
    a, b, c = (x.cast("string") for x in (F.col("p_size") % 4 + 1, F.col("p_partkey") % 3 + 1, F.col("p_size") % 3 + 1))
    left = F.concat(a, F.lit("H2 + "), b, F.lit("O2"), F.when(F.col("p_partkey") % 5 == 0, " + e-").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(left, F.lit(" → "), c, F.when(F.col("p_partkey") % 7 == 0, "water").otherwise("H2O")).alias("equation"))
    state = F.when(~F.col("parsed"), "unparsed").when(F.col("balanced"), "balanced").otherwise("unbalanced")
    delta = lambda e: F.when(F.col("parsed"), F.coalesce(F.try_element_at("atom_delta", F.lit(e)), F.lit(0.0)))
    result = [state.alias("state"), delta("H").alias("h"), delta("O").alias("o"), F.col("charge_delta").alias("charge")]
    return relational.once(rows, ["equation"], lambda texts: C.reaction_balance(texts.withColumn("k", F.col("equation")), "k", "equation").select(F.col("k").alias("equation"), *result)).drop("equation")


STATES_SQL = {k: {True: "pass", False: "fail", None: "indeterminate"}[v] for k, v in BALANCED.items()}


@query(f"""WITH e AS (SELECT doc_id, text, list_extract({[e for _, e in EQUATIONS]}, CAST(doc_id % {len(EQUATIONS)} + 1 AS INT)) AS e, list_extract({list(STATES_SQL.values())}, CAST(doc_id % {len(EQUATIONS)} + 1 AS INT)) AS state FROM documents),
    p AS (SELECT doc_id, e, state, list_filter(string_split_regex(substr(text, 1, length(text) // 2) || ': ' || e || '. ' || substr(text, length(text) // 2 + 1), '[\n;]+'), lambda x: contains(x, e))[1] AS part FROM e)
    SELECT doc_id, 'chemistry.reaction_balance' AS check_id, CASE WHEN part IS NULL OR NOT regexp_matches(e, '->|→|<=>') AND len(regexp_extract_all(part, '=')) <> 1 THEN 'not_applicable' ELSE state END AS state FROM p""")
def equation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an equation in the middle of their text: found again and checked. Without an arrow it is one only if no other equals
    sign is in its line."""
    pick = F.element_at(F.array(*[F.lit(e) for _, e in EQUATIONS]), (F.col("doc_id") % len(EQUATIONS) + 1).cast("int"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring("text", F.lit(1), half), F.lit(": "), pick, F.lit(". "), F.substring("text", half + 1, F.length("text"))).alias("t"))
    return R.reaction_results(rows, "doc_id", "t")


SCALES = ["По Полингу χ(Cl) = 3.", "Electronegativity after Pauling.", "Электроотрицательность по Маллику, I + E, и по Полингу.", "Mulliken: I_A + E, the electronegativity is half of it.", "Mulliken and Pauling electronegativity: (I + E) / 2.", "Без шкал."]


@query(f"""WITH l AS (SELECT l_orderkey AS id, CASE WHEN l_partkey % 7 = 0 THEN 'm' WHEN l_partkey % 7 = 1 THEN 'мл' ELSE 'V' END AS second, CASE WHEN l_partkey % 3 = 0 THEN '12' ELSE '12 г' END AS answer, list_extract({SCALES}, CAST(l_partkey % 6 + 1 AS INT)) AS scales FROM lineitem)
    SELECT id, 'chemistry.units' AS check_id, CASE WHEN second = 'm' THEN 'fail' WHEN NOT contains(answer, 'г') THEN 'warning' ELSE 'pass' END AS state FROM l
    UNION ALL SELECT id, 'chemistry.scale_compatibility', CASE WHEN NOT regexp_matches(lower(scales), 'electronegativ|электроотрицательн') THEN 'not_applicable' WHEN regexp_matches(lower(scales), 'mulliken|маллик') AND regexp_matches(lower(scales), 'pauling|полинг') AND regexp_matches(scales, '[IE] *_?[A-Za-z]* *[+]') THEN 'fail' ELSE 'pass' END FROM l""")
def rule_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label with two dimensions, answers without a unit; scales of electronegativity alone, mixed and not mentioned."""
    second = F.when(F.col("l_partkey") % 7 == 0, "m").when(F.col("l_partkey") % 7 == 1, "мл").otherwise("V")
    scales = F.element_at(F.array(*map(F.lit, SCALES)), (F.col("l_partkey") % 6 + 1).cast("int"))
    statement = F.concat(scales, F.lit("; m = "), F.col("q").cast("string"), F.lit(" г, "), second, F.lit(" = 5 мл"))
    answer = F.when(F.col("l_partkey") % 3 == 0, "12").otherwise("12 г")
    rows = facts(spark, sf_dir).select(F.col("l_orderkey").alias("id"), statement.alias("statement"), answer.alias("answer"))
    checks = {"units": R.unit_consistency(F.col("statement"), F.col("answer"), F.lit(True)), "scales": R.scale_compatibility(F.col("statement"))}
    judged = relational.once(rows, ["statement", "answer"], lambda texts: texts.withColumns(checks))
    return R.evaluate(judged, "id", [F.col(c) for c in checks])


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'colloid' WHEN 1 THEN 'analytical' WHEN 2 THEN 'general' ELSE 'unspecified' END AS discipline FROM part""")
def discipline_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("p_size") % 4
    name = F.when(case == 0, "Коллоидная химия").when(case == 1, "Analytical chemistry").when(case == 2, "Общая химия").otherwise("Music")
    return table(spark, sf_dir, "part").select("p_partkey", R.discipline(name).alias("discipline"))
