"""Units of measurement: a lookup table, conversion to SI and measurements in text."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import unit_grammar
from .numbers import normalize
from .text import let, text

# Dimension, symbol, factor to SI, spellings in lower case (latin and Russian). Temperatures in degrees have
# an offset of their own.
TABLE = """
dimensionless|%|0.01|%
current|A|1|a
current|mA|1e-3|ma
current|µA|1e-6|мка μa
charge|C|1|c кл
charge|mC|1e-3|mc мкл-заряд
charge|µC|1e-6|μc
charge_per_amount|C/mol|1|c/mol кл/моль
electrical_resistance|Ω|1|ω ohm ом
electrical_resistance|kΩ|1e3|kω kohm ком
electrical_conductance|S|1|siemens сименс
voltage|V|1|v в
voltage|mV|1e-3|mv мв
time|s|1|s с сек
time|min|60|min мин
time|h|3600|h ч
amount|mol|1|mol моль
amount|mmol|1e-3|mmol ммоль
amount|µmol|1e-6|μmol мкмоль
amount_per_mass|mol/kg|1|mol/kg моль/кг
amount_per_mass|mmol/kg|1e-3|mmol/kg ммоль/кг
amount_per_mass|mol/g|1e3|mol/g моль/г
amount_per_mass|mmol/g|1|mmol/g ммоль/г
amount_per_mass|µmol/g|1e-3|μmol/g мкмоль/г
reciprocal_amount|mol⁻¹|1|1/mol 1/моль mol-1 моль-1
mass|kg|1|kg кг
mass|g|1e-3|g г
mass|mg|1e-6|mg мг
mass|µg|1e-9|μg мкг
volume|m³|1|m3 м3
volume|L|1e-3|dm3 дм3 l л
volume|mL|1e-6|ml мл cm3 см3
volume|µL|1e-9|μl мкл
amount_concentration|mol/L|1e3|mol/l моль/л mol/dm3 моль/дм3
amount_concentration|mmol/L|1|mmol/l ммоль/л
amount_concentration|mol/m³|1|mol/m3 моль/м3
mass_concentration|g/L|1|g/l г/л
mass_concentration|mg/L|1e-3|mg/l мг/л
mass_concentration|µg/L|1e-6|μg/l мкг/л
molar_mass|kg/mol|1|kg/mol кг/моль
molar_mass|g/mol|1e-3|g/mol г/моль
length|m|1|m м
length|cm|1e-2|cm см
length|mm|1e-3|mm мм
length|µm|1e-6|μm мкм
length|nm|1e-9|nm нм
area|m²|1|m2 м2
area|cm²|1e-4|cm2 см2
area|mm²|1e-6|mm2 мм2
area|µm²|1e-12|μm2 мкм2
area|nm²|1e-18|nm2 нм2
inverse_length|m⁻¹|1|m-1 1/m м-1 1/м
inverse_length|cm⁻¹|100|cm-1 1/cm см-1 1/см
pressure|Pa|1|pa па
pressure|kPa|1e3|kpa кпа
pressure|bar|1e5|bar бар
dynamic_viscosity|Pa·s|1|pa*s па*с
dynamic_viscosity|mPa·s|1e-3|mpa*s мпа*с
permittivity|F/m|1|f/m ф/м
electrophoretic_mobility|m²/(V·s)|1|m2/(v*s) м2/(в*с)
electrophoretic_mobility|cm²/(V·s)|1e-4|cm2/(v*s) см2/(в*с)
specific_surface|m²/kg|1|m2/kg м2/кг
specific_surface|m²/g|1e3|m2/g м2/г
temperature|K|1|k к
temperature|°C|1|°c °с
"""
# Spellings whose case matters, since folding it would change their meaning.
CASED = """
electrical_resistance|mΩ|1e-3|mΩ mOhm мОм
electrical_resistance|MΩ|1e6|MΩ MOhm МОм
electrical_conductance|S|1|S См
electrical_conductance|mS|1e-3|mS мСм
electrical_conductance|µS|1e-6|μS мкСм
electrical_conductivity|S/m|1|S/m См/м
electrical_conductivity|mS/m|1e-3|mS/m мСм/м
electrical_conductivity|µS/m|1e-6|μS/m мкСм/м
electrical_conductivity|S/cm|100|S/cm См/см
electrical_conductivity|mS/cm|0.1|mS/cm мСм/см
electrical_conductivity|µS/cm|1e-4|μS/cm мкСм/см
amount_concentration|mol/L|1e3|M
charge|mC|1e-3|мКл
"""
# The exponents over metre, kilogram, second, ampere, kelvin and mole of each dimension of the table.
VECTORS = """
dimensionless 0,0,0,0,0,0
current 0,0,0,1,0,0
charge 0,0,1,1,0,0
charge_per_amount 0,0,1,1,0,-1
electrical_resistance 2,1,-3,-2,0,0
electrical_conductance -2,-1,3,2,0,0
electrical_conductivity -3,-1,3,2,0,0
voltage 2,1,-3,-1,0,0
time 0,0,1,0,0,0
amount 0,0,0,0,0,1
amount_per_mass 0,-1,0,0,0,1
reciprocal_amount 0,0,0,0,0,-1
mass 0,1,0,0,0,0
volume 3,0,0,0,0,0
amount_concentration -3,0,0,0,0,1
mass_concentration -3,1,0,0,0,0
molar_mass 0,1,0,0,0,-1
length 1,0,0,0,0,0
area 2,0,0,0,0,0
inverse_length -1,0,0,0,0,0
pressure -1,1,-2,0,0,0
dynamic_viscosity -1,1,-1,0,0,0
permittivity -3,-1,4,2,0,0
electrophoretic_mobility 0,-1,2,1,0,0
specific_surface 2,-1,0,0,0,0
temperature 0,0,0,0,1,0
"""
KELVIN_OFFSET = 273.15
#: Fixed value: the number of a measurement.
NUMBER = r"[-+]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][-+]?[0-9]+)?"


@lru_cache(1)
def rows() -> list[tuple[str, str, str, float, float]]:
    """(spelling, symbol, dimension, factor, offset); cased spellings begin with an equals sign."""
    out = []
    for block, mark in ((TABLE, ""), (CASED, "=")):
        for dimension, symbol, factor, spellings in (line.split("|") for line in block.strip().splitlines()):
            out += [(mark + s, symbol, dimension, float(factor), KELVIN_OFFSET if symbol == "°C" else 0.0) for s in spellings.split()]
    return out


def unit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "key string, symbol string, dimension string, factor double, offset double")


def unit_key(c: Column) -> Column:
    """The key of a unit's spelling: digits for superscripts, * for products, / for a product with an inverse, no blanks, lower case."""
    out = F.translate(F.regexp_replace(F.trim(text(c)), r"^[.,;:]+|[.,;:]+$", ""), "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−µ·×", "0123456789--μ**")
    out = F.regexp_replace(F.regexp_replace(out, r"\\cdot", "*"), r"\^|\s+", "")
    out = F.lower(F.regexp_replace(out, r"^([^*/]+)\*([^*/()]+)-1$", "$1/$2"))
    return F.when(c.rlike(r"\A[a-zа-я/]+\z"), c).otherwise(out)  # most are such keys as they are


def cased_key(c: Column) -> Column:
    return F.concat(F.lit("="), F.translate(F.regexp_replace(F.trim(text(c)), r"^[.,;:]+|[.,;:]+$", ""), "µ", "μ"))


def _struct(r: tuple) -> Column:
    return F.struct(F.lit(r[1]).alias("symbol"), F.lit(r[2]).alias("dimension"), F.lit(r[3]).alias("factor"), F.lit(r[4]).alias("offset"))


def unit(c: Column | str) -> Column:
    """symbol, dimension, factor, offset of a unit's spelling; null if unknown. A str is a spelling that holds for all rows and is looked
    up at once; a column is looked up in a constant map of some 190 entries."""
    if isinstance(c, str):
        known = {r[0]: r for r in rows()}
        found = known.get(f"={c}") or known.get(c.translate(str.maketrans("²³·µ", "23*μ")).replace(" ", "").lower())
        return _struct(found) if found else F.lit(None).cast("struct<symbol:string,dimension:string,factor:double,offset:double>")
    return let(let(c, any_unit), lambda u: F.when(u["named"], u.dropFields("named")))


def listed(c: Column) -> Column:
    """The row of the table for a unit's spelling, as an array of texts; null if it is not in the table."""
    cased, folded = map(unit_grammar.constant_map, _lookup())
    return F.split(F.coalesce(F.try_element_at(cased, cased_key(c)), F.try_element_at(folded, unit_key(c))), r"\|")


def any_unit(c: Column) -> Column:
    """unit() of a column for any readable expression: symbol, dimension, factor, offset and named, whether the dimension has a name. A spelling of
    the table is looked up, all others are read by the grammar; a dimension without a name is its exponents in writing."""
    names, symbols = (unit_grammar.constant_map(x) for x in (_names(), _symbols()))

    def spelled(r: Column) -> Column:
        name = F.try_element_at(names, F.array_join(r["vector"].cast("array<string>"), ","))
        dimension = F.coalesce(name, unit_grammar.vector_text(r["vector"]))
        symbol = F.coalesce(F.try_element_at(symbols, F.concat(dimension, F.lit("|"), F.format_string("%.6e", r["factor"]))), unit_grammar.plain_unit(c))
        return F.when(r.isNotNull(), F.struct(symbol.alias("symbol"), dimension.alias("dimension"), r["factor"].alias("factor"), F.lit(0.0).alias("offset"), name.isNotNull().alias("named")))

    known = let(listed(c), lambda u: F.when(u.isNotNull(), F.struct(u[0].alias("symbol"), u[1].alias("dimension"), u[2].cast("double").alias("factor"), u[3].cast("double").alias("offset"), F.lit(True).alias("named"))))
    return F.coalesce(known, let(unit_grammar.read(c), spelled))


@lru_cache(1)
def _names() -> dict[str, str]:
    return {v: name for name, v in (line.split() for line in VECTORS.strip().splitlines())}


@lru_cache(1)
def _symbols() -> dict[str, str]:
    """The table's symbol of each dimension and factor, for units that are spelled otherwise."""
    first: dict[str, str] = {}
    for _, symbol, dimension, factor, offset in rows():
        if not offset:
            first.setdefault(f"{dimension}|{factor:.6e}", symbol)
    return first


@lru_cache(1)
def _lookup() -> tuple[dict[str, str], dict[str, str]]:
    """The table by its cased spellings, and by the others. Maps are searched from their first entry, so each is as short as it can be."""
    entries = {r[0]: f"{r[1]}|{r[2]}|{r[3]!r}|{r[4]!r}" for r in rows()}
    return {k: v for k, v in entries.items() if k[0] == "="}, {k: v for k, v in entries.items() if k[0] != "="}


def join_units(df: DataFrame, c: Column) -> DataFrame:
    """df with symbol, dimension, factor, offset of its unit column, by a join with the unit table; null if unknown. The table
    has some 190 rows whatever the data, so it is broadcast."""
    units = unit_table(df.sparkSession)
    cased, folded = [F.broadcast(units.select(*[F.col(k).alias(f"_{n}_{k}") for k in units.columns])) for n in ("c", "f")]
    out = df.join(cased, cased_key(c) == F.col("_c_key"), "left").join(folded, unit_key(c) == F.col("_f_key"), "left")
    return out.select(*df.columns, *[F.coalesce(f"_c_{k}", f"_f_{k}").alias(k) for k in units.columns[1:]])


def measure(value: Column, unit_text: Column | str) -> Column:
    """value, unit, dimension, si of a number and a unit's spelling (a str: of all rows); null if the unit is unknown or the number not finite."""
    def found(v: Column | dict[str, Column]) -> Column:
        u, x = v["u"], v["x"]
        good = u.isNotNull() & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(good, F.struct(x.alias("value"), u["symbol"].alias("unit"), u["dimension"].alias("dimension"), (x * u["factor"] + u["offset"]).alias("si")))

    if isinstance(unit_text, str):  # no lambda is needed, so the expression stays in generated code
        return found({"u": unit(unit_text), "x": value})
    return let(F.struct(unit(unit_text).alias("u"), value.alias("x")), found)


def parse_measurement(c: Column) -> Column:
    """The measurement that a text like `25 mL` is; null without a known unit."""
    pattern = rf"(?s)^\s*({NUMBER})\s*(.+?)\s*$"
    return measure(F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", ".").try_cast("double"), F.regexp_extract(c, pattern, 2))


def in_unit(si: Column, unit_text: Column | str) -> Column:
    return let(unit(unit_text), lambda u: (si - u["offset"]) / u["factor"])


def close_si(a: Column, b: Column, relative: float = 0.01) -> Column:
    return F.abs(a - b) <= F.lit(relative) * F.greatest(F.abs(a), F.abs(b), F.lit(1e-30))


def same_quantity(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """Whether two measurements have one dimension and, nearly, one value."""
    return F.coalesce((a["dimension"] == b["dimension"]) & close_si(a["si"], b["si"], relative), F.lit(False))


def label_key(c: Column) -> Column:
    """A quantity's name without typography: subscripts as digits, letters and digits only, lower case."""
    return F.regexp_replace(F.lower(F.translate(text(c), "₀₁₂₃₄₅₆₇₈₉", "0123456789")), "[^a-zа-яё0-9]+", "")


#: What may be a unit behind a number: a run without blanks that is read as a whole, so an unknown compound has no unit.
UNIT_TOKEN = r"[%°\p{L}](?:[\p{L}\p{N}²³⁻¹°/·*×^]|-(?=[0-9]))*(?:\([^()\s]*\)(?:\^?-?[0-9])?)?"


#: A quantity's name: a word, with what stands in brackets right behind it, as in m(MgO).
LABEL = r"\p{L}[\p{L}\p{N}_-]{0,32}(?:\([^()=\n]{0,32}\)[\p{L}\p{N}_-]{0,32}){0,4}"
#: Where a clause ends: a semicolon, a comma or stop beside no digit, the word `and`, a line that does not go on with a unit.
CLAUSE_END = rf"(?iu)[;\n](?=\s*{LABEL}\s*=)|;|(?<![0-9])(?:\n|[.,](?![0-9]))|(?<![\p{{L}}\p{{N}}_])(?:and|и)(?![\p{{L}}\p{{N}}_])"
#: One-letter quantity symbols that are units as well.
SYMBOLS = "ACFGIKMNPQRSTVcikmnpqtv"


def compact_units(plain: Column) -> Column:
    """A text of plain numbers without blanks within compound units, some before a factor."""
    return F.regexp_replace(F.regexp_replace(plain, r"[^\S\n]*([\^/]|·(?=\s*\p{L}))[^\S\n]*", "$1"), "·(?=[0-9])", " · ")


def measured_text(c: Column | str) -> Column:
    """A text whose numbers and units can be read: plain numbers, formulas on lines of their own, compact units."""
    return compact_units(normalize(F.translate(text(c), "~$", " \n")))


def sayings(plain: Column) -> Column:
    """The numbers of a measured text with what may be their units, in order."""
    return F.regexp_extract_all(plain, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_.,^]){NUMBER}\s*{UNIT_TOKEN}"), F.lit(0))


def measurements(c: Column | str) -> Column:
    """All measurements of a text, in order: numbers followed by a known unit."""
    return F.filter(F.transform(sayings(measured_text(c)), parse_measurement), lambda m: m.isNotNull())


def names_quantity(label: Column) -> Column:
    """Whether a name in front of an equals sign is that of a quantity: neither a unit nor a bare formula of a species, as in `mass of MnO2 =`."""
    plain = F.translate(label, "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    symbol = plain.rlike(f"^[{SYMBOLS}][0-9]*$")
    species = plain.rlike("^(?:[A-Z][a-z]?[0-9]*)+$") & plain.rlike("[a-z0-9]")
    return symbol | ~(species | listed(label).isNotNull())


def assignments(plain: Column) -> Column:
    """label, said of every `label = number unit` of a measured text, in order, whether the unit is known or not.

    Only the first equals sign of a clause assigns: `n1 = c1 V1 = 0.4 mol/L` says nothing of V1.
    """
    pattern = rf"(?iu)^[^=]*?(?<![\p{{L}}\p{{N}}_(])({LABEL})\s*=\s*({NUMBER}\s*{UNIT_TOKEN})"
    pairs = F.transform(F.split(plain, CLAUSE_END), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), F.regexp_extract(x, pattern, 2).alias("said")))
    named = F.filter(pairs, lambda p: (p["said"] != "") & names_quantity(p["name"]))
    return F.transform(named, lambda p: F.struct(label_key(p["name"]).alias("label"), p["said"].alias("said")))


def assigned_measurements(c: Column | str) -> Column:
    """label, measurement of every assignment of a text with a known unit, in order."""
    read = F.transform(assignments(measured_text(c)), lambda p: F.struct(p["label"].alias("label"), parse_measurement(p["said"]).alias("measurement")))
    return F.filter(read, lambda p: p["measurement"].isNotNull())


def all_measurements(c: Column | str) -> Column:
    """measurements() and assigned_measurements() of a text as `found` and `assigned`. The text is spelled anew once for both, and one
    expression reads the units of both."""

    def read(said: Column) -> Column:
        n, labels = F.size(said["found"]), said["assigned"]["label"]
        both = F.transform(F.concat(said["found"], said["assigned"]["said"]), parse_measurement)

        def parted(m: Column) -> Column:
            named = F.zip_with(labels, F.slice(m, n + 1, F.size(labels)), lambda k, x: F.struct(k.alias("label"), x.alias("measurement")))
            return F.struct(F.filter(F.slice(m, F.lit(1), n), lambda x: x.isNotNull()).alias("found"), F.filter(named, lambda p: p["measurement"].isNotNull()).alias("assigned"))

        return let(both, parted)

    return let(let(measured_text(c), lambda plain: F.struct(sayings(plain).alias("found"), assignments(plain).alias("assigned"))), read)


def last_assigned(assigned: Column, labels: list[str], dimensions: list[str] | None = None) -> Column:
    """The measurement of the last assignment to one of the labels, of one of the dimensions."""
    keep = lambda p: p["label"].isin(labels) & (p["measurement"]["dimension"].isin(dimensions) if dimensions else F.lit(True))
    return F.try_element_at(F.filter(assigned, keep), F.lit(-1))["measurement"]


def stated(text_column: Column | str, wanted: Column, tolerance: float = 0.002) -> Column:
    """Whether a measurement occurs in a text, in any unit of its dimension."""
    return stated_among(measurements(text_column), wanted, tolerance)


def stated_among(found: Column, wanted: Column, tolerance: float = 0.002) -> Column:
    """Whether a measurement is among those of a text that has been read."""
    return F.exists(found, lambda m: (m["dimension"] == wanted["dimension"]) & close_si(m["si"], wanted["si"], tolerance))
