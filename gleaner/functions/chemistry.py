"""Formulas and reaction equations. Equations are taken apart by Spark SQL; only the nested formula grammar is a small Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType

from .text import let

#: The elements by atomic number.
ELEMENTS = """H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn
Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U""".split()
#: Elements whose symbol, digits and sign (Fe3+) are an ion's charge rather than a count.
MONATOMIC = "Ag Al Ba Ca Cd Cl Co Cr Cu F Fe H Hg I K Li Mg Mn Na Ni O Pb S Sn Zn".split()
#: What stands between the sides of an equation, and what a phase looks like.
ARROW = r"<=>|<->|=>|->|⇌|↔|→|⟶"
PHASE = r"\((?:aq|s|l|g|газ|ж|тв|р-?р)\)$"

_INNER = re.compile(r"[(\[]([^()\[\]]*)[)\]](\d*)")
_ATOM = re.compile(r"([A-Z][a-z]?)(\d*)")


_UP, _UP_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻−", "0123456789+--"
# A written species: its body, its charge in one of the notations, its phase. Digits before a sign are a charge behind a caret, as
# superscripts, behind a closing bracket and behind the symbol of a monatomic ion; else a sign alone is one.
_CHARGES = (r"\^([0-9]*[-+−])", r"([⁰¹²³⁴⁵⁶⁷⁸⁹]*[⁺⁻])", r"(?<=[\])])([0-9]+[-+−])", rf"(?<=^(?:{'|'.join(MONATOMIC)}))([0-9]+[-+−])", r"([-+−])")
_SPECIES_PARTS = rf"(?u)^(.*?)(?:{'|'.join(_CHARGES)})?(?:(?i){PHASE.removesuffix('$')})?$"


def written_species(c: Column) -> Column:
    """body (in ASCII, without charge and phase) and charge of a formula as it is written; an electron has an empty body."""
    bare = F.regexp_replace(c, r"\\[a-z]+|[{}_$`\s]", "")  # LaTeX and blanks
    part = lambda k: F.regexp_extract(bare, _SPECIES_PARTS, k)
    written = F.translate(F.concat(*[part(k + 2) for k in range(len(_CHARGES))]), _UP, _UP_DIGITS)
    size = F.coalesce(F.regexp_extract(written, "^[0-9]+", 0).try_cast("int"), F.lit(1))
    charge = F.when(written == "", 0).when(F.endswith(written, F.lit("+")), size).otherwise(-size)
    body = F.translate(part(1), "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹∙⋅", "01234567890123456789··")
    return F.struct(F.when((body == "e") & (written != ""), "").otherwise(body).alias("body"), charge.alias("charge"))


def _atoms(body: str | None) -> dict[str, int] | None:
    """Counts of the atoms of a formula without charge; None if it is no formula. Innermost brackets are written out first."""
    if body is None:
        return None
    total: dict[str, int] = {}
    for part in body.split("·") if body else ():
        lead = re.match(r"\d+", part)
        times = int(lead[0]) if lead else 1
        part = part[lead.end() :] if lead else part
        while found := _INNER.search(part):
            inside = "".join(f"{e}{int(n or 1) * int(found[2] or 1)}" for e, n in _ATOM.findall(found[1]))
            if not _ATOM.fullmatch(found[1]) and _ATOM.sub("", found[1]):
                return None
            part = part[: found.start()] + inside + part[found.end() :]
        if not part or _ATOM.sub("", part):
            return None
        for element, n in _ATOM.findall(part):
            total[element] = total.get(element, 0) + times * int(n or 1)
    return total


@F.pandas_udf(MapType(StringType(), IntegerType()))
def atoms_udf(bodies: pd.Series) -> pd.Series:
    """Element to count of formulas without charge; null where it is no formula, empty for an electron."""
    return bodies.map(_atoms)


def species(df: DataFrame, formula: str) -> DataFrame:
    """df with atoms (map of element to count, null if it is no formula) and charge."""
    parts = written_species(F.col(formula))
    return df.withColumn("_s", parts).withColumns({"atoms": atoms_udf("_s.body"), "charge": F.col("_s.charge")}).drop("_s")


def sides(equation: Column) -> Column:
    """The two sides of an equation with exactly one arrow, or with one equals sign and no arrow; null for any other."""
    e = F.regexp_replace(F.trim(equation), r"^[$` ]+|[$` .;]+$", "")
    by_arrow, by_sign = F.split(e, ARROW), F.split(e, r"(?<![<>=])=(?![=>])")
    two = F.when(F.size(by_arrow) == 2, by_arrow).when((F.size(by_arrow) == 1) & (F.size(by_sign) == 2), by_sign)
    return F.when(~F.exists(two, lambda s: F.trim(s) == ""), two)


def terms(side: Column) -> Column:
    """coefficient and formula of the terms of a side; plus signs of charges don't split."""
    pieces = F.split(F.trim(side), r"\s+\+\s+|(?<=[A-Za-z0-9)\]])\+(?=(?:\d+(?:\.\d+)?\s*)?[A-Z\[])")
    pattern = r"^(\d+/\d+|\d+(?:\.\d+)?)\s*(?=[A-Z\[e])"

    def one(x: Column) -> Column:
        written = F.regexp_extract(F.trim(x), pattern, 1)
        fraction = F.try_divide(F.split(written, "/")[0].try_cast("double"), F.try_element_at(F.split(written, "/"), F.lit(2)).try_cast("double"))
        return F.struct(F.when(written == "", F.lit(1.0)).otherwise(F.coalesce(fraction, written.try_cast("double"))).alias("coefficient"), F.trim(F.regexp_replace(F.trim(x), pattern, "")).alias("formula"))

    return F.transform(pieces, one)


def reaction_balance(equations: DataFrame, id_col: str, equation: str) -> DataFrame:
    """id, parsed, balanced, atom_delta (map of element to right minus left, of those that differ), charge_delta.

    Terms are rows, so an equation's atoms are summed by a grouped aggregate. Equations that don't parse have nulls.
    """
    split = equations.select(id_col, sides(F.col(equation)).alias("_sides"))
    rows = split.select(id_col, F.posexplode_outer("_sides").alias("_right", "_side")).select(id_col, "_right", F.explode_outer(terms(F.col("_side"))).alias("_t"))
    parsed = species(rows.select(id_col, (F.col("_right") * 2 - 1).alias("_sign"), "_t.coefficient", "_t.formula"), "formula")
    bad = F.max(F.col("atoms").isNull() | F.col("_sign").isNull())
    factor = F.col("_sign") * F.col("coefficient")
    whole = parsed.groupBy(id_col).agg(bad.alias("_bad"), F.round(F.sum(factor * F.col("charge")), 9).alias("charge_delta"))
    atoms = parsed.select(id_col, factor.alias("_f"), F.explode("atoms").alias("element", "n"))
    delta = atoms.groupBy(id_col, "element").agg(F.round(F.sum(F.col("_f") * F.col("n")), 9).alias("d")).filter("d <> 0")
    lists = delta.groupBy(id_col).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("element", "d")))).alias("atom_delta"))
    out = whole.join(lists, id_col, "left")
    none = F.create_map().cast("map<string,double>")
    return out.select(
        id_col, (~F.col("_bad")).alias("parsed"), F.when(~F.col("_bad"), F.col("atom_delta").isNull() & (F.col("charge_delta") == 0)).alias("balanced"),
        F.when(~F.col("_bad"), F.coalesce("atom_delta", none)).alias("atom_delta"), F.when(~F.col("_bad"), F.col("charge_delta")).alias("charge_delta"))


_EQUALS = r"(?<![<>=!])=(?![=>])"
_DIGITS = r"(?:_?\{?[0-9₀-₉]+\}?)?"
_FORMULA = rf"(?:(?:(?:{'|'.join(sorted(ELEMENTS, key=lambda e: (-len(e), e)))}|[(\[]|[)\]]){_DIGITS})+)"
# A sign is a charge if what follows can't be a further term: a blank, the end, an arrow or a stop.
_CHARGE = rf"(?:\^\{{?[0-9]*[-+−]\}}?|[⁰¹²³⁴-⁹]*[⁺⁻]|[0-9]*[-+−](?=\s|$|[.,:)]|=|{ARROW}))?"
_TERM = rf"(?:[0-9]+(?:[./][0-9]+)?\s*)?(?:{_FORMULA}(?:[·∙⋅][0-9]*{_FORMULA})*{_CHARGE}|e\^?\{{?[-−⁻]\}}?)(?:\s?{PHASE.removesuffix('$')})?(?![\p{{L}}\p{{N}}])"
_SIDE = rf"{_TERM}(?:\s*\+\s*{_TERM})*"
_EDGE = r"[\s$`:,.…]*"
#: A formula that is more than one letter, so that `P = F` is no equation.
_COMPOUND = r"[A-Z].*[A-Z0-9₀-₉]"


def _around(pieces: Column, sign: str, single: bool) -> Column:
    """The equations at each separator of a text that was split at them: from the separator a side grows, term by term, as far as
    the grammar goes; greedy matching takes the most terms. Empty where a side has no term. single: whether both sides may be one term of any kind."""

    def one(i: Column) -> Column:
        left, right = F.get(pieces, i), F.get(pieces, i + 1)
        a = F.trim(F.regexp_extract(left, rf"(?u)(?<![\p{{L}}\p{{N}}_^.,+\-=/\[(])({_SIDE}){_EDGE}$", 1))
        b = F.trim(F.regexp_extract(right, rf"(?u)^{_EDGE}({_SIDE})", 1))
        good = (a != "") & (b != "")
        if not single:
            good &= (a.contains("+") | a.rlike(_COMPOUND)) & (b.contains("+") | b.rlike(_COMPOUND))
        return F.when(good, F.concat(a, F.lit(f" {sign} "), b)).otherwise("")

    return F.transform(F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.size(pieces) - 2)).otherwise(F.array().cast("array<int>")), one)


def _states(pieces: Column) -> Column:
    """For each arrow of a split text, whether a signed whole number stands on both sides of it: oxidation states, not an equation."""
    number = r"^[-+−]?[0-9]+[).,;:]*$"
    last, first = lambda x: F.element_at(F.split(F.rtrim(x), r"[\s:(]+"), -1), lambda x: F.get(F.split(F.ltrim(x), r"\s+"), F.lit(0))
    at = F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.size(pieces) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: last(F.get(pieces, i)).rlike(r"^[-+−]?[0-9]+$") & first(F.get(pieces, i + 1)).rlike(number))


def equations_in(c: Column) -> Column:
    """The reaction equations that a text holds, looked for between line feeds and semicolons.

    Every arrow grows a side on its left and right by the grammar of terms; so does the only equals sign of a part without arrows, where a
    side has to be more than one letter. A part with an arrow but no equation that can be read is given as a whole, so that it is not
    taken for a text without one. Oxidation states with an arrow between them are no equation.
    """

    def found(part: Column) -> Column:
        def cut(x: Column) -> Column:
            arrows = F.filter(F.arrays_zip(x["spans"].alias("span"), x["states"].alias("state")), lambda y: ~F.coalesce(y["state"], F.lit(False)))
            read = F.filter(F.transform(arrows, lambda y: y["span"]), lambda y: y != "")
            whole = F.array(F.regexp_replace(F.trim(part), "^[$` ]+|[$` ]+$", ""))
            by_sign = F.filter(_around(F.split(part, _EQUALS), "=", False), lambda y: y != "")
            none = F.array().cast("array<string>")
            return F.when(F.size(arrows) > 0, F.when(F.size(read) > 0, read).otherwise(whole)).when(F.regexp_count(part, F.lit(_EQUALS)) == 1, by_sign).otherwise(none)

        return let(F.split(part, ARROW), lambda p: let(F.struct(_around(p, "→", True).alias("spans"), _states(p).alias("states")), cut))

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n;]+"), found)))
