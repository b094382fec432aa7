"""A grammar of unit expressions with dimension algebra, as Spark SQL expressions.

    expression = factor (("*" | "/") factor)*        from left to right: a/b*c is a c / b
    factor     = (atom | "(" expression ")" | "1") exponent?
    atom       = prefix? base

Every base unit has a vector of exponents over metre, kilogram, second, ampere, kelvin and mole and a factor to SI. A product adds
vectors and multiplies factors, an exponent multiplies vectors and raises factors, so any compound of known atoms is read, whether it
has a name or not. There are no brackets within brackets.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text

#: Exponents of a dimension, in this order.
AXES = ("m", "kg", "s", "A", "K", "mol")
#: Base units as factor to SI, exponents, whether prefixes go with them, spellings whose case may be folded, and such whose case counts.
BASES = """
1       1,0,0,0,0,0    yes  m м
1e-3    0,1,0,0,0,0    yes  g г
1       0,0,1,0,0,0    yes  s с сек
60      0,0,1,0,0,0    no   min мин
3600    0,0,1,0,0,0    no   h ч
1       0,0,0,1,0,0    yes  a А а
1       0,0,0,0,1,0    yes  k к
1       0,0,0,0,1,0    no   °c °с
1       0,0,0,0,0,1    yes  mol моль
1       0,0,1,1,0,0    yes  c кл
1       2,1,-3,-1,0,0  yes  v в
1       2,1,-3,-2,0,0  yes  ω ohm ом
1       -2,-1,3,2,0,0  yes  siemens сименс =S =См
1       -1,1,-2,0,0,0  yes  pa па
1e5     -1,1,-2,0,0,0  yes  bar бар
101325  -1,1,-2,0,0,0  no   atm атм
1e-3    3,0,0,0,0,0    yes  l л
1e3     -3,0,0,0,0,1   yes  =M
1       -2,-1,4,2,0,0  yes  f ф
1       2,1,-2,0,0,0   yes  j дж
1.602176634e-19 2,1,-2,0,0,0 yes ev эв
1       1,1,-2,0,0,0   yes  n н
1       2,1,-3,0,0,0   yes  w вт
1       0,0,-1,0,0,0   yes  hz гц
0.01    0,0,0,0,0,0    no   %
"""
#: Prefixes whose case may be folded, and such whose case counts.
PREFIXES = {"1e3": "k к", "1e-1": "d д", "1e-2": "c с", "1e-3": "m м", "1e-6": "μ мк", "1e-9": "n н", "1e-12": "p п", "1e6": "=M =М", "1e9": "=G =Г"}
LONGEST = 40
_READ = "struct<v:array<int>,f:double,ok:boolean,group:int>"


@lru_cache(1)
def bases() -> dict[str, tuple[float, tuple[int, ...], bool]]:
    """Spelling to factor, exponents and whether prefixes go with it. Foldable spellings are there as written and in lower case."""
    out = {}
    for line in BASES.strip().splitlines():
        factor, vector, prefixed, *spellings = line.split()
        for s in spellings:
            out[s.lstrip("=")] = (float(factor), tuple(map(int, vector.split(","))), prefixed == "yes")
    return out


def constant_map(entries: dict[str, str]) -> Column:
    """A constant map of strings, written as one literal, so that plans stay small however many entries it has."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in entries.items())), F.lit("\n"), F.lit("\t"))


@lru_cache(1)
def _entries() -> tuple[dict[str, str], dict[str, str]]:
    base = {s: f"{f!r}|{','.join(map(str, v))}|{p}" for s, (f, v, p) in bases().items()}
    return base, {s.lstrip("="): f for f, group in PREFIXES.items() for s in group.split()}


def plain_unit(c: Column) -> Column:
    """A unit's spelling with digits for superscripts, * for products, no blanks, powers signs or LaTeX braces."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^[.,;:]+|[.,;:]+$", ""), r"\\cdot|\\times", "*")
    return F.regexp_replace(F.translate(bare, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−µ·×∙⋅Ω", "0123456789-+-μ****ω"), r"[\^\s{}]|\*\*", "")


def _atom(c: Column) -> Column:
    """v and f of prefix and base: as written before folded, a base alone before one with a prefix; null if there is none."""
    base, prefix = map(constant_map, _entries())
    prefixes = sorted(_entries()[1], key=lambda s: (-len(s), s))
    pattern = rf"^({'|'.join(prefixes)})(.+)$"
    # written, written with a prefix, its base folded, all folded, folded with a prefix: (prefix, base) behind each other
    ways = F.transform(F.array(c, F.lower(c)), lambda x: F.array(
        F.struct(F.lit("").alias("p"), x.alias("b")), *[F.struct(F.regexp_extract(x, pattern, 1).alias("p"), f(F.regexp_extract(x, pattern, 2)).alias("b")) for f in (lambda y: y, F.lower)]))

    def look(way: Column) -> Column:
        found = F.split(F.try_element_at(base, way["b"]), r"\|")
        times = F.when(way["p"] == "", 1.0).when(found[2] == "True", F.try_element_at(prefix, way["p"]).cast("double"))
        return F.when(times.isNotNull() & found.isNotNull(), F.struct(F.split(found[1], ",").cast("array<int>").alias("v"), (found[0].cast("double") * times).alias("f")))

    return F.get(F.filter(F.transform(F.flatten(ways), look), lambda x: x.isNotNull()), F.lit(0))


def _read(c: Column) -> Column:
    """v, f and ok of an expression in plain spelling; `group` is the exponent that holds for the bracket that is open, 0 for none."""
    # a bracket's exponent goes to its front: (m/s)2 is read as (2|m/s)
    ahead = F.regexp_replace(c, r"\(([^()]*)\)([-+]?[0-9]{1,2})(?![0-9])", "($2|$1)")
    items = F.regexp_extract_all(ahead, F.lit(r"[*/]?\((?:[-+]?[0-9]+\|)?|\)|[*/]?[^*/()|]+"), F.lit(0))
    shape = r"^[*/]?(.*?)([-+]?[0-9]*)$"
    whole = (c != "") & (F.array_join(items, "") == ahead) & ~F.substring(c, 1, 1).isin("*", "/")
    start = F.struct(F.array(*[F.lit(0)] * len(AXES)).alias("v"), F.lit(1.0).alias("f"), whole.alias("ok"), F.lit(0).alias("group")).cast(_READ)
    number = lambda x: F.when(x == "", 1).when(x.rlike("^[-+]?[0-9]{1,2}$"), F.regexp_replace(x, r"^\+", "").try_cast("int"))
    bad = F.lit(None).cast(_READ)

    def step(out: Column, item: Column) -> Column:
        sign = F.when(F.startswith(item, F.lit("/")), -1).otherwise(1)
        name, power = F.regexp_extract(item, shape, 1), F.regexp_extract(item, shape, 2)
        opened = number(F.regexp_extract(item, r"([-+]?[0-9]*)\|?$", 1)) * sign
        times = number(power) * sign * F.when(out["group"] == 0, 1).otherwise(out["group"])
        factor = let(F.struct(_atom(name).alias("a"), times.alias("n")), lambda x: F.when(x["a"].isNotNull() & x["n"].isNotNull(), F.struct(
            F.zip_with(out["v"], x["a"]["v"], lambda p, q: p + q * x["n"]).alias("v"), (out["f"] * F.pow(x["a"]["f"], x["n"].cast("double"))).alias("f"), out["ok"].alias("ok"), out["group"].alias("group"))))
        return (
            F.when(item == ")", F.when(out["group"] != 0, out.withField("group", F.lit(0)))).when(item.rlike(r"\("), F.when((out["group"] == 0) & (opened != 0), out.withField("group", opened)))
            .when((name == "") & (power == "1"), out).when(name != "", factor).otherwise(bad)
        )

    return F.aggregate(items, start, step)


def read(c: Column) -> Column:
    """vector (exponents of AXES) and factor (to SI) of a unit's spelling; null if it is no expression of known atoms."""
    out = let(plain_unit(c), lambda p: F.when(F.length(p) <= LONGEST, _read(p)))
    return let(out, lambda r: F.when(r["ok"] & (r["group"] == 0) & (r["f"] > 0) & (r["f"] < float("inf")), F.struct(r["v"].alias("vector"), r["f"].alias("factor"))))


def vector_text(v: Column) -> Column:
    """A dimension in writing, like m^2*kg^-1; empty for a pure number."""
    return F.array_join(F.filter(F.zip_with(v, F.array(*map(F.lit, AXES)), lambda n, a: F.when(n == 1, a).when(n != 0, F.concat(a, F.lit("^"), n.cast("string")))), lambda x: x.isNotNull()), "*")
