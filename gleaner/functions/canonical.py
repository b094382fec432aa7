"""Canonical JSON, byte by byte: the text that fingerprints are taken of, as Spark SQL expressions over a known type.

Object keys are sorted by code points, there are no blanks, text other than control characters, quotes and backslashes stands as it is, and
a double is written with the fewest digits that give it back: plainly from 1e-4 to below 1e16, else with an exponent of two digits or more.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType

from .text import let

#: Control characters with an escape of their own.
ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_number(x: Column) -> Column:
    """The shortest digits that give a double back. NaN and infinities, which JSON lacks, are null."""
    # what a JVM prints itself may have a digit more than it takes. Decimals of up to 15 digits have doubles of their own, so one that gives a normal
    # double back is what rounding to 15 digits leaves but for zeros; only for numbers below are digits tried from few to many
    def shortest(places: range) -> Column:
        return F.coalesce(*[let(F.format_string(f"%.{p}e", x), lambda s: F.when(s.cast("double") == x, s)) for p in places])

    first = F.when(F.abs(x) >= sys.float_info.min, shortest(range(14, 17))).otherwise(shortest(range(17)))

    def parts(s: Column) -> Column:
        sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
        digits = F.rtrim(F.regexp_replace(F.regexp_extract(s, r"^-?([0-9.]+)e", 1), r"\.", ""), F.lit("0"))
        return F.struct(sign.alias("s"), digits.alias("d"), F.regexp_extract(s, r"e([-+][0-9]+)$", 1).cast("int").alias("e"))

    def nearest(v: Column) -> Column:
        """For whole numbers beyond 2 ** 53 the JVM may print a digit too many, itself rounded. Up to 2 ** 124 all digits are known, as two longs: the
        nearest number of so many digits, or of one less if that gives the double back."""
        size, base = F.abs(x), float(1 << 62)
        high = F.floor(size / base)
        exact = (high.cast("long").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + (size - high * base).cast("long").cast("decimal(19,0)")).cast("decimal(38,0)")

        def rounded(zeros: Column) -> Column:
            unit = F.concat(F.lit("1"), F.repeat(F.lit("0"), zeros)).cast("decimal(38,0)")
            rest = exact % unit
            return (exact - rest + F.when(rest >= unit - rest, unit).otherwise(F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)").cast("string")

        zeros = v["e"] - F.length(v["d"]) + 1
        said = let(rounded(zeros + 1), lambda less: F.when(less.cast("double") == size, less).otherwise(rounded(zeros)))
        return let(said, lambda t: F.struct(v["s"].alias("s"), F.rtrim(t, F.lit("0")).alias("d"), (F.length(t) - 1).alias("e")))

    def laid_out(v: Column) -> Column:
        d, e, n = v["d"], v["e"], F.length(v["d"])
        mantissa = F.when(n > 1, F.concat(F.substring(d, 1, 1), F.lit("."), F.substr(d, F.lit(2)))).otherwise(d)
        wide = F.concat(mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        whole = F.concat(d, F.repeat(F.lit("0"), e - n + 1), F.lit(".0"))
        mixed = F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2))
        return F.concat(v["s"], F.when((e < -4) | (e >= 16), wide).when(e < 0, small).when(n <= e + 1, whole).otherwise(mixed))

    zero = F.when(F.startswith(x.cast("string"), F.lit("-")), "-0.0").otherwise("0.0")
    return F.when(x == 0, zero).when(~F.isnan(x) & (F.abs(x) < float("inf")), let(let(let(first, parts), lambda v: F.when((F.abs(x) < float(1 << 53)) | (F.abs(x) >= float(1 << 124)), v).otherwise(nearest(v))), laid_out))


def json_text(c: Column) -> Column:
    """A quoted string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    bare = out
    for k in range(32):
        out = F.replace(out, F.lit(chr(k)), F.lit(ESCAPES.get(k, f"\\u{k:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), out).otherwise(bare), F.lit('"'))


def canonical(c: Column, kind: DataType) -> Column:
    """The canonical JSON of a value of a type; null values are `null`, decimals and times their text, bytes base64, map keys text."""
    none = F.lit("null")
    if isinstance(kind, NullType):
        return none
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical(c[f.name], f.dataType)) for f in fields]
        return F.when(c.isNull(), none).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}")))
    if isinstance(kind, ArrayType):
        return F.when(c.isNull(), none).otherwise(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]")))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical(e["value"], kind.valueType).alias("v"))))
        return F.when(c.isNull(), none).otherwise(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}")))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(json_number(c.cast("double")), none)
    if isinstance(kind, (IntegralType, BooleanType)):
        return F.coalesce(c.cast("string"), none)
    if isinstance(kind, (StringType, DecimalType, DateType, TimestampType, TimestampNTZType)):
        return F.coalesce(json_text(c.cast("string")), none)
    if isinstance(kind, BinaryType):
        return F.coalesce(json_text(F.base64(c)), none)
    raise TypeError(f"no canonical JSON of {kind.simpleString()}")


def digest(c: Column, kind: DataType) -> Column:
    return F.sha2(canonical(c, kind), 256)
