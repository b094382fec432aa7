"""Physical-consistency rules over fact columns, and their report.

A rule is a Column: a struct of check_id and state (pass, fail, warning, indeterminate, error, not_applicable). Facts are
measurements (value, unit, dimension, si) or numbers; a missing one makes a rule indeterminate, and one that can't be
calculated with makes it an error. Inputs that `visible` names have to be stated in the task, or the rule fails: facts are not a
source of data that a student doesn't see. Rules are plain arithmetic, so any number of them runs over a task table in one scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.chemistry import equations_in, reaction_balance
from gleaner.functions.numbers import numbers, ratio_rounds_to, relative_error, significant_digits
from gleaner.functions.text import let
from gleaner.functions.units import assigned_measurements, last_assigned, measure, measurements, stated_among

from .relational import once

TOLERANCE = 0.01
STATES = ("pass", "fail", "warning", "indeterminate", "not_applicable", "error")
#: Fixed values.
FARADAY, AVOGADRO, VACUUM_PERMITTIVITY = 96485.33212, 6.02214076e23, 8.8541878128e-12
DEBYE_NM = 0.304
BET_RANGE = (0.05, 0.35)
#: Discipline by the first pattern that its name has; check to the block of facts that it needs.
DISCIPLINES = (("colloid", "colloid|коллоид"), ("analytical", "analytic|аналит"), ("organic", "organic|органич(?!.*неорган)"), ("general", "general|inorganic|общ|неорган"))
BLOCK_OF = {
    "chemistry.stoichiometry": "stoichiometry", "chemistry.dilution": "dilution", "analytical.titration": "titration", "analytical.gravimetry": "gravimetry",
    "analytical.conductometry": "conductometry", "analytical.faraday": "faraday", "analytical.calibration": "calibration", "colloid.bet": "bet",
    "colloid.smoluchowski": "smoluchowski", "colloid.dlvo": "dlvo",
}
GENERIC = ("chemistry.units", "chemistry.scale_compatibility", "chemistry.reaction_balance")


class Statement(NamedTuple):
    """A task's statement: its text, and what has been read from it. Rules take it for the text alone, which each of their conditions reads anew."""

    text: Column
    measurements: Column
    numbers: Column


def statement_of(statement: Column | Statement) -> Statement:
    return statement if isinstance(statement, Statement) else Statement(statement, measurements(statement), numbers(statement))


def with_statement(tasks: DataFrame, text_col: str, wanted: tuple[str, ...] = ("measurements", "numbers")) -> tuple[DataFrame, Statement]:
    """The tasks, and their statements for rules that need what is `wanted` of them: each different text is read once."""
    readers = {"measurements": measurements, "numbers": numbers}
    read = lambda texts: texts.select(text_col, *[readers[k](text_col).alias(f"_{k}") for k in wanted])
    return once(tasks, [text_col], read), Statement(F.col(text_col), *[F.col(f"_{k}") if k in wanted else readers[k](text_col) for k in readers])


def near(actual: Column, expected: Column, tolerance: float = TOLERANCE) -> Column:
    return relative_error(actual, expected) <= tolerance


def outcome(check_id: str, facts: list[Column], fails: list[Column], warns: list[Column] | None = None) -> Column:
    """indeterminate if a fact is missing, else fail or warning if any of the conditions for it holds, else error if any is unknown, else pass."""
    missing = reduce(or_, [f.isNull() for f in facts])
    some = lambda conditions: reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])
    unknown = reduce(or_, [c.isNull() for c in [*fails, *(warns or [])]])
    state = F.when(missing, "indeterminate").when(some(fails), "fail").when(unknown, "error")
    if warns:
        state = state.when(some(warns), "warning")
    return F.struct(F.lit(check_id).alias("check_id"), state.otherwise("pass").alias("state"))


def hidden(statement: Column | Statement | None, *inputs: Column) -> list[Column]:
    """Conditions that an input measurement is not stated; none without a statement."""
    return [] if statement is None else [~F.coalesce(stated_among(statement_of(statement).measurements, x), F.lit(False)) for x in inputs]


def positive(*columns: Column) -> list[Column]:
    return [c <= 0 for c in columns]


def unlike(*measured: Column) -> list[Column]:
    """Conditions that measurements do not share the first one's dimension."""
    return [m["dimension"] != measured[0]["dimension"] for m in measured[1:]]


def dilution(c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    a, b = c1["si"] * v1["si"], c2["si"] * v2["si"]
    return outcome("chemistry.dilution", [c1, v1, c2, v2], [*unlike(c1, c2), *unlike(v1, v2), *positive(c1["si"], v1["si"], c2["si"], v2["si"]), ~near(a, b)])


def titration(c1: Column, v1: Column, f1: Column, c2: Column, v2: Column, f2: Column) -> Column:
    """Equal equivalents of analyte and titrant; f is the equivalence factor, or 1 / stoichiometric coefficient."""
    a, b = F.try_divide(c1["si"] * v1["si"], f1), F.try_divide(c2["si"] * v2["si"], f2)
    return outcome("analytical.titration", [c1, v1, f1, c2, v2, f2], [*positive(c1["si"], v1["si"], f1, c2["si"], v2["si"], f2), ~near(a, b)])


def gravimetry(n_analyte: Column, m_analyte: Column, n_form: Column, m_form: Column, factor: Column, form_mass: Column, analyte_mass: Column, statement: Column | Statement | None = None) -> Column:
    """All facts are decimal literals as text: coefficients, molar masses in g/mol, the gravimetric factor, masses in g.

    The factor and the mass of the analyte have to be the exact results rounded half up to the digits that they show, and to show
    as many as the least precise of what they are made from. Molar masses and the mass of the form have to be stated.
    """
    facts = [n_analyte, m_analyte, n_form, m_form, factor, form_mass, analyte_mass]
    number = lambda c: F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    least = F.least(significant_digits(m_analyte), significant_digits(m_form))
    precise = lambda c, digits: significant_digits(c) >= digits
    over, under = [n_analyte, m_analyte], [n_form, m_form]
    inputs = [measure(number(m_analyte), "г/моль"), measure(number(m_form), "г/моль"), measure(number(form_mass), "г")]
    return outcome("analytical.gravimetry", [number(f) for f in facts], [
        *positive(*[number(f) for f in facts]), *hidden(statement, *inputs), ~ratio_rounds_to(factor, over, under), ~precise(factor, least),
        ~ratio_rounds_to(analyte_mass, [form_mass, *over], under), ~precise(analyte_mass, F.least(least, significant_digits(form_mass)))])


def conductometry(resistance: Column, conductance: Column, cell_constant: Column, conductivity: Column, statement: Column | Statement | None = None) -> Column:
    """In ohm, S, 1/m and S/m. Either electrical quantity and the cell constant have to be stated."""
    shown = []
    if statement is not None:
        found = statement_of(statement).measurements
        electrical = F.coalesce(stated_among(found, measure(resistance, "Ом")) | stated_among(found, measure(conductance, "S")), F.lit(False))
        shown = [~electrical, *hidden(statement, measure(cell_constant, "м-1"))]
    return outcome("analytical.conductometry", [resistance, conductance, cell_constant, conductivity], [
        *positive(resistance, conductance, cell_constant, conductivity), *shown, ~near(conductance, F.try_divide(F.lit(1.0), resistance)), ~near(conductivity, cell_constant * conductance)])


def faraday(current: Column, time: Column, charge: Column, amount: Column, mass: Column, molar_mass: Column, electrons: Column, efficiency: Column, constant: Column, statement: Column | Statement | None = None) -> Column:
    """In SI units. A constant that is used has to be the right one, and stated if there is a statement."""
    expected = F.try_divide(molar_mass * charge * efficiency, electrons * constant)
    return outcome("analytical.faraday", [current, time, charge, amount, mass, molar_mass, electrons, efficiency, constant], [
        *positive(current, time, molar_mass, electrons), (efficiency <= 0) | (efficiency > 1), *named_constant(statement, constant, r"(?<![\p{L}\p{N}])F(?![\p{L}\p{N}])|(?iu)фараде|faraday"),
        ~near(constant, F.lit(FARADAY), 0.005), ~near(charge, current * time), ~near(amount, F.try_divide(charge, constant)), ~near(mass, expected)])


def named_constant(statement: Column | Statement | None, constant: Column, name: str) -> list[Column]:
    """Conditions that a statement does not name a constant, or holds no number within 0.5 % of its value; none without a statement."""
    if statement is None:
        return []
    read = statement_of(statement)
    return [~F.coalesce(read.text.rlike(name), F.lit(False)), ~F.exists(read.numbers, lambda x: F.coalesce(near(x, constant, 0.005), F.lit(False)))]


def calibration(slope: Column, intercept: Column, signal: Column, concentration: Column, low: Column, high: Column) -> Column:
    expected = F.try_divide(signal - intercept, slope)
    return outcome("analytical.calibration", [slope, intercept, signal, concentration], [slope == 0, concentration < 0, ~near(concentration, expected)], [F.coalesce((concentration < low) | (concentration > high), F.lit(False))])


def bet_linear(slope: Column, intercept: Column, capacity: Column, constant: Column, pressures: Column) -> Column:
    p = F.coalesce(pressures, F.array().cast("array<double>"))
    return outcome("colloid.bet", [slope, intercept, capacity, constant], [
        slope + intercept <= 0, intercept == 0, ~near(capacity, F.try_divide(F.lit(1.0), slope + intercept)), ~near(constant, 1 + F.try_divide(slope, intercept)), F.exists(p, lambda x: (x <= 0) | (x >= 1))],
        [F.exists(p, lambda x: (x < BET_RANGE[0]) | (x > BET_RANGE[1]))])


def bet_surface(amount_per_mass: Column, cross_section: Column, surface: Column, constant: Column | None = None, statement: Column | Statement | None = None) -> Column:
    """In mol/kg, m² and m²/kg. The constant of Avogadro that is used has to be right, and stated if there is a statement."""
    used = F.lit(AVOGADRO) if constant is None else constant
    return outcome("colloid.bet", [amount_per_mass, cross_section, surface, used], [
        *positive(amount_per_mass, cross_section), ~near(used, F.lit(AVOGADRO), 0.005), *named_constant(statement, used, r"N_?[AaАа]|(?iu)авогадро|avogadro"), ~near(surface, amount_per_mass * used * cross_section)])


def smoluchowski(mobility: Column, viscosity: Column, zeta: Column, permittivity: Column, kappa_a: Column, statement: Column | Statement | None = None) -> Column:
    """In SI units. The permittivity of the vacuum has to be stated if there is a statement."""
    expected = F.try_divide(viscosity * mobility, permittivity * VACUUM_PERMITTIVITY)
    return outcome("colloid.smoluchowski", [mobility, viscosity, zeta, permittivity, kappa_a], [
        *positive(viscosity, permittivity), *hidden(statement, measure(F.lit(VACUUM_PERMITTIVITY), "Ф/м")), ~near(zeta, expected), kappa_a <= 10], [kappa_a < 50])


def dlvo(ionic_strength: Column, debye_nm: Column, radius_nm: Column, separation_nm: Column, claims_derjaguin: Column, claims_sufficient: Column, other_forces: Column) -> Column:
    thick = F.try_divide(separation_nm, radius_nm) > 0.1
    expected = F.try_divide(F.lit(DEBYE_NM), F.sqrt(F.greatest(ionic_strength, F.lit(0.0))))
    return outcome("colloid.dlvo", [ionic_strength, debye_nm, radius_nm, separation_nm], [
        *positive(ionic_strength, radius_nm), ~near(debye_nm, expected, 0.03), F.coalesce(claims_derjaguin, F.lit(False)) & thick, F.coalesce(claims_sufficient & other_forces, F.lit(False))], [thick])


def amount(given: Column, by: Column) -> Column:
    """The amount in mol of a measurement: itself, or with a second one a mass by a molar mass or a concentration by a volume; else null."""
    kinds = lambda a, b: (given["dimension"] == a) & (by["dimension"] == b)
    product = given["si"] * by["si"]
    return F.when(given["dimension"] == "amount", given["si"]).when(kinds("mass", "molar_mass"), F.try_divide(given["si"], by["si"])).when(kinds("amount_concentration", "volume") | kinds("volume", "amount_concentration"), product)


def amount_relation(text: Column) -> Column:
    """n = cV between the values that a text assigns last to n, c and V; not applicable if it has not all three. For tasks without facts."""
    assigned = assigned_measurements(text)
    n, c, v = (last_assigned(assigned, [label], [kind]) for label, kind in (("n", "amount"), ("c", "amount_concentration"), ("v", "volume")))
    some = n.isNotNull() & c.isNotNull() & v.isNotNull()
    return F.struct(F.lit("chemistry.stoichiometry").alias("check_id"), F.when(~some, "not_applicable").when(near(n["si"], c["si"] * v["si"]), "pass").otherwise("fail").alias("state"))


def scale_compatibility(text: Column) -> Column:
    mixed = text.rlike(r"(?iu)mulliken|маллик") & text.rlike(r"(?iu)pauling|полинг") & text.rlike(r"[IE]\s*[_]?[A-Za-z]*\s*\+")
    applies = text.rlike(r"(?iu)electronegativ|электроотрицательн")
    return F.struct(F.lit("chemistry.scale_compatibility").alias("check_id"), F.when(~applies, "not_applicable").when(mixed, "fail").otherwise("pass").alias("state"))


def unit_consistency(text: Column, answer: Column, numeric: Column) -> Column:
    """One label has one dimension, and a numeric answer to a dimensional task has a unit."""

    def facts(assigned: Column) -> Column:
        return F.struct(F.size(assigned).alias("n"), F.array_distinct(F.transform(assigned, lambda a: F.struct(a["label"].alias("l"), a["measurement"]["dimension"].alias("d")))).alias("pairs"))

    def judged(v: Column) -> Column:
        clash = F.size(F.array_distinct(F.transform(v["pairs"], lambda p: p["l"]))) < F.size(v["pairs"])
        bare = numeric & (v["n"] > 0) & (F.size(measurements(answer)) == 0)
        return F.when(clash, "fail").when(bare, "warning").when(v["n"] == 0, "not_applicable").otherwise("pass")

    return F.struct(F.lit("chemistry.units").alias("check_id"), let(let(assigned_measurements(text), facts), judged).alias("state"))


def reaction_results(tasks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, check_id, state: all equations found in a text conserve atoms and charge; one that doesn't parse is indeterminate."""
    rows = tasks.select(id_col, F.posexplode(equations_in(F.col(text_col))).alias("pos", "equation")).withColumn("_k", F.struct(id_col, "pos"))
    each = reaction_balance(rows, "_k", "equation").select(F.col(f"_k.{id_col}").alias(id_col), "parsed", "balanced")
    found = each.groupBy(id_col).agg(F.max(F.coalesce(~F.col("balanced"), F.lit(False))).alias("bad"), F.max(~F.col("parsed")).alias("odd"))
    state = F.when(F.col("bad").isNull(), "not_applicable").when(F.col("bad"), "fail").when(F.col("odd"), "indeterminate").otherwise("pass")
    return tasks.select(id_col).join(found, id_col, "left").select(id_col, F.lit("chemistry.reaction_balance").alias("check_id"), state.alias("state"))


def stoichiometry(tasks: DataFrame, id_col: str) -> DataFrame:
    """id, limiting, amount, state of tasks with reactants (array of name, coefficient, amount in mol), target (coefficient, amount),
    limiting (as declared, or null) and maybe excess (names that are declared to be in excess and need no amount): the extent is the least
    amount per coefficient of the others. A reactant with neither makes a task indeterminate."""
    spare = F.coalesce(F.array_contains("excess", F.col("r.name")), F.lit(False)) if "excess" in tasks.columns else F.lit(False)
    rows = tasks.select(id_col, *(["excess"] if "excess" in tasks.columns else []), F.explode("reactants").alias("r")).filter(~spare)
    rows = rows.select(id_col, "r.name", F.try_divide("r.amount", "r.coefficient").alias("extent"))
    least = rows.groupBy(id_col).agg(F.min(F.struct("extent", "name")).alias("m"), F.max("extent").alias("most"), F.bool_or(F.col("extent").isNull()).alias("unknown"))
    out = tasks.join(least, id_col, "left")
    amount = F.col("m.extent") * F.col("target.coefficient")
    declared = F.col("limiting").isNull() & ~near(F.col("m.extent"), F.col("most"))
    wrong = ~near(F.col("target.amount"), amount) | F.coalesce(F.col("limiting") != F.col("m.name"), F.lit(False)) | declared
    return out.select(id_col, F.col("m.name").alias("found_limiting"), amount.alias("amount"), F.when(F.coalesce("unknown", F.lit(True)), "indeterminate").when(wrong, "fail").otherwise("pass").alias("state"))


def evaluate(tasks: DataFrame, id_col: str, rules: list[Column], selected: Column | None = None) -> DataFrame:
    """id, check_id, state for every rule, or those that the array `selected` names, in one pass over the tasks.

    Each rule is a column before the rows are multiplied: in a projection its repeated parts are computed once, in a generator they are not."""
    names = [f"_rule{k}" for k in range(len(rules))]
    found = tasks.select(id_col, *[r.alias(n) for r, n in zip(rules, names, strict=True)], *([] if selected is None else [selected.alias("_selected")]))
    every = F.array(*map(F.col, names))
    chosen = every if selected is None else F.filter(every, lambda r: F.array_contains("_selected", r["check_id"]))
    return found.select(id_col, F.explode(chosen).alias("_r")).select(id_col, "_r.check_id", "_r.state")


def required_checks(explicit: Column, blocks: Column) -> Column:
    """The checks that a task has to pass: the one it names, and those whose block of facts is there. Sorted."""
    of_block = F.create_map(*[F.lit(x) for check, block in BLOCK_OF.items() for x in (block, check)])
    named = F.when(explicit.isNotNull() & (explicit != "auto"), F.array(explicit)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(named, F.filter(F.transform(blocks, lambda b: F.try_element_at(of_block, b)), lambda c: c.isNotNull())))


def report(results: DataFrame, id_col: str) -> DataFrame:
    """id, blocking, indeterminate, warnings (sorted check ids), n_applicable, deterministic_pass of result rows."""
    ids = lambda *states: F.sort_array(F.collect_list(F.when(F.col("state").isin(*states), F.col("check_id"))))
    applicable = F.count_if(F.col("state") != "not_applicable")
    passed = F.bool_and(F.col("state").isin("pass", "not_applicable")) & (F.count_if(F.col("state") == "pass") > 0)
    return results.groupBy(id_col).agg(ids("fail", "error").alias("blocking"), ids("indeterminate").alias("indeterminate"), ids("warning").alias("warnings"), applicable.alias("n_applicable"), passed.alias("deterministic_pass"))


def admission_effect(results: DataFrame, required: DataFrame, id_col: str) -> DataFrame:
    """id, effect: block if anything fails or a required check did not pass, limited if nothing conclusive was found, else pass.

    required: id, check_id.
    """
    states = required.join(results, [id_col, "check_id"], "left")
    unmet = states.groupBy(id_col).agg(F.max(~F.coalesce(F.col("state") == "pass", F.lit(False))).alias("unmet"))
    seen = results.groupBy(id_col).agg(F.max(F.col("state").isin("fail", "error", "warning", "indeterminate")).alias("bad"), F.max(F.col("state") == "pass").alias("good"))
    effect = F.when(F.col("bad") | F.coalesce("unmet", F.lit(False)), "block").when(F.col("good"), "pass").otherwise("limited")
    return seen.join(unmet, id_col, "left").select(id_col, effect.alias("effect"))


def discipline(c: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(F.trim(c)).rlike(p), name) for name, p in DISCIPLINES], F.lit("unspecified"))


def all_hold(*conditions: Column) -> Column:
    return reduce(and_, conditions)
