"""Numbers in text and tolerant comparison, as Spark SQL expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text

#: Digits and signs above and below the line, blanks that group digits, signs of multiplication.
SUPERSCRIPTS, SUPERSCRIPT_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+"
SUBSCRIPTS, SUBSCRIPT_DIGITS = "₀₁₂₃₄₅₆₇₈₉", "0123456789"
BLANKS = "\u00a0\u2007\u2009\u202f"
TIMES = "·×∙⋅*"

# The lexer of numeric text. A text is cut into tokens, each of which is spelled anew by its kind; all else stays.
_UNSIGNED = r"[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_MANTISSA = rf"[0-9]+(?:[{BLANKS}]+[0-9]+)*(?:(?:[.,]|\{{,\}})[0-9]+(?:[{BLANKS}]+[0-9]+)*)?"
_BY_TEN = rf"\s*(?:[{TIMES}]|\\cdot|\\times)\s*10"
_RAISED = rf"(?:\s*\^\s*\{{?\s*[-+−]?[0-9]+\s*\}}?|[{SUPERSCRIPTS}]+)"
_POWER = rf"(?:{_BY_TEN}\s*\^?|^10\s*\^|^10(?=[{SUPERSCRIPTS}]))\s*\{{?\s*([-+−]?[0-9{SUPERSCRIPTS}]+)\s*\}}?$"
# What begins a token that is spelled anew.
_MARK = r"0123456789\\$^_/~−⁰¹²³⁴-⁻"
# A run of characters that do not, nor are blanks. The regex engine looks up single Latin-1 characters in one bit set, and asks for ranges and all others one by
# one, which takes most of the time; so the bit set comes first, then one range, and only what is in neither is compared with the other marks.
_LATIN = "".join(f"\\x{k:02x}" for k in range(256) if chr(k) not in "0123456789\\$^_/~¹²³ \t\n\x0b\f\r")
_WORD = rf"[{_LATIN}]++|[\u0400-\u04ff]++|(?![\x00-\xff])[^−⁰⁴-⁻]"
# Words and blanks, which most text is, come first: no other kind begins with what a word does, or with blanks that go on with neither ^ nor /. A run
# of them is one token, but for what tells a list's items: the blanks before such a number, its stop or bracket, and the blanks behind that.
_TOKENS = "|".join([
    r"(?<=[0-9])[.)](?=\s)", r"(?<=[0-9][.)])\s++(?![\^/])",
    rf"(?:{_WORD}|\s++(?![\^/]|[0-9]{{1,2}}[.)]\s))++", r"\s++(?![\^/])",
    rf"{_MANTISSA}{_BY_TEN}(?:{_RAISED}|\s*[-+−]?[0-9]+)", rf"10{_RAISED}", rf"{_MANTISSA}(?:[eE][-+]?[0-9]+)?",
    rf"[{SUPERSCRIPTS}]+", r"\s*\^\s*\{\s*[-+−]?[0-9]+\s*\}", r"\s*\^\s*",
    r"_\s*\{\s*(?:\\[a-z]+\s*\{[^{}]*\}|[^{}\\]*)\s*\}",  # a subscript
    r"\\(?:text|mathrm|operatorname)\s*\{[^{}]*\}", r"\s*/\s*", r"\\[a-zA-Z]+", r"\\[\s\S]",
    r"[\s\S]",
])


def _spelled(token: Column) -> Column:
    power = F.regexp_extract(token, _POWER, 1)
    mantissa = F.when(power == "", token).when(token.rlike(f"^10\\s*[{SUPERSCRIPTS}^]"), "1").otherwise(F.regexp_extract(token, f"^({_MANTISSA}){_BY_TEN}", 1))
    plain = F.translate(F.regexp_replace(mantissa, r"\{,\}", "."), "," + BLANKS, ".")
    number = F.concat(plain, F.when(power != "", F.concat(F.lit("e"), F.translate(power, SUPERSCRIPTS + "−", SUPERSCRIPT_DIGITS + "-"))).otherwise(""))
    inner = F.trim(F.regexp_extract(token, r"\{([^{}]*)\}\s*\}?$", 1))
    bare = F.trim(token)
    return (
        F.when(token.rlike(r"^[0-9]+(?:[.,][0-9]+)?$"), F.translate(token, ",", ".")).when(token.rlike("^[0-9]"), number).when(token.rlike(f"^[{SUPERSCRIPTS}]"), F.concat(F.lit("^"), F.translate(token, SUPERSCRIPTS, SUPERSCRIPT_DIGITS)))
        .when(F.startswith(bare, F.lit("^")), F.concat(F.lit("^"), F.translate(inner, "−", "-"))).when(token.rlike(r"^_\s*\{"), F.concat(F.lit("_"), inner)).when(bare == "/", "/")
        .when(token.rlike(r"^\\[a-z]+\s*\{"), F.concat(F.lit(" "), inner, F.lit(" "))).when(token.isin("\\cdot", "\\times"), "·").when(token == "\\%", "%")
        .when(token.isin("$", *(f"\\{c}" for c in ",;!:()[]")), "").when(F.startswith(token, F.lit("\\")), " ").when(token == "−", "-").otherwise(token)
    )


#: A number of a text in plain notation: no letter, low line or power sign comes before it.
NUMBER = rf"(?iu)(?=[-+0-9])(?<![a-zа-яё_^])(?<!\^[-+])[-+]?{_UNSIGNED}"


def normalize(c: Column | str) -> Column:
    """Numbers of a text in plain notation: powers of ten as exponents, decimal points, no LaTeX, no numbers of list items. A ~ between a
    number and what may be its unit is a blank."""
    tokens = F.regexp_extract_all(F.regexp_replace(text(c), r"(?<=[0-9}])~(?=\s*(?:[%\p{L}]|\\))", " "), F.lit(f"(?u){_TOKENS}"), F.lit(0))

    def read(all_: Column) -> Column:
        at = lambda k: F.coalesce(F.get(all_, k), F.lit(""))
        blank = lambda k: F.trim(F.regexp_replace(at(k), r"\s", "")) == ""
        # a number of one or two digits, alone but for its stop or bracket, with more behind it, counts a list's items
        item = lambda k: at(k).rlike("^[0-9]{1,2}$") & blank(k - 1) & at(k + 1).isin(".", ")") & (at(k + 2) != "") & blank(k + 2) & (at(k + 3) != "")
        stop = lambda t, k: F.when(item(k - 1), "").otherwise(t)
        # most tokens are words and blanks, which stay
        return F.transform(all_, lambda t, k: F.when(t.isin(".", ")"), stop(t, k)).when(~t.rlike(rf"^\s*[{_MARK}]"), t).when(t.rlike("^[0-9]") & item(k), "").otherwise(_spelled(t)))

    return F.array_join(let(tokens, read), "")



def number_tokens(c: Column | str) -> Column:
    """The numbers of a text as they are written, in order."""
    return F.regexp_extract_all(normalize(c), F.lit(NUMBER), F.lit(0))


def plain_tokens(c: Column | str) -> Column:
    """Unsigned decimal numbers, without any rewriting."""
    return F.regexp_extract_all(text(c), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def numbers(c: Column | str) -> Column:
    return as_doubles(number_tokens(c))


def as_doubles(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t: t.try_cast("double")), finite)


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def strict_number(c: Column) -> Column:
    """The finite number in a JSON value; null for text, booleans and all else."""
    kind = F.schema_of_variant(c)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.nullif(F.try_variant_get(c, "$", "double"), F.lit(float("nan"))))


def lenient_number(c: Column) -> Column:
    """The finite number that a text says, with a decimal point or comma; null for all else."""
    x = F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    return F.when(finite(x), x)


def close(a: Column, b: Column, relative: Column | float, floor: float = 1e-15) -> Column:
    """|a - b| within the share `relative` of the larger of both, or within `floor`."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(floor))


def relative_error(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) / F.greatest(F.abs(actual), F.abs(expected), F.lit(1e-30))


def number_keys(tokens: Column) -> Column:
    """Tokens in the form in which they are compared as text: lower case, no plus sign, each once."""
    return F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), r"^\++", "")))


def unknown_numbers(tokens: Column, known_tokens: Column, near: float = 1e-6) -> Column:
    """The tokens, each once, that are not among the known ones and not within `near` of the value of any of them."""
    known_keys, values = number_keys(known_tokens), as_doubles(known_tokens)
    fresh = F.filter(number_keys(tokens), lambda t: t.try_cast("double").isNotNull() & ~F.array_contains(known_keys, t))
    return F.filter(fresh, lambda t: ~F.exists(values, lambda v: close(t.cast("double"), v, near)))


def significant_digits(literal: Column) -> Column:
    """Digits that a decimal literal shows, without leading zeros; null if it is no decimal number."""
    digits = F.regexp_replace(F.regexp_extract(F.trim(literal), r"^[-+]?([0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][-+]?[0-9]+)?$", 1), "[.,]", "")
    return F.when(digits != "", F.length(F.regexp_replace(digits, "^0+(?=.)", "")))


def rounds_to(shown: Column, exact: Column) -> Column:
    """Whether the literal `shown` is the literal `exact` rounded half up to its decimals."""
    return ratio_rounds_to(shown, [exact], [])


def literal(c: Column) -> Column:
    """digits (a whole number) and places (after the point; exponents taken off) of a decimal literal as text; null if it is none."""
    part = lambda k: F.regexp_extract(F.trim(c), r"^([-+]?[0-9]*)(?:[.,]([0-9]*))?(?:[eE]([-+]?[0-9]+))?$", k)
    digits = F.concat(part(1), part(2)).try_cast("decimal(38,0)")
    places = F.length(part(2)) - F.coalesce(part(3).try_cast("int"), F.lit(0))
    return F.when(digits.isNotNull(), F.struct(digits.alias("digits"), places.alias("places")))


def ratio_rounds_to(shown: Column, over: list[Column], under: list[Column]) -> Column:
    """Whether the literal `shown` is the product of the literals `over` divided by that of `under`, rounded half up to its
    decimals. Whole numbers of up to 38 digits are compared, so no digit is lost; null if there are more, or no literals."""
    two = F.lit(2).cast("decimal(38,0)")
    ten = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))).try_cast("decimal(38,0)")

    def fraction(v: Column) -> Column:
        top, low = ([v[f"{side}{i}"] for i in range(len(xs))] for side, xs in (("a", over), ("b", under)))
        product = lambda xs: F.abs(reduce(F.try_multiply, [x["digits"] for x in xs], F.lit(1).cast("decimal(38,0)")))
        shift = reduce(lambda p, x: p - x["places"], top, reduce(lambda p, x: p + x["places"], low, v["shown"]["places"]))
        return F.struct(F.try_multiply(product(top), ten(shift)).alias("n"), F.try_multiply(product(low), ten(-shift)).alias("d"), F.abs(v["shown"]["digits"]).alias("k"))

    def rounded(w: Column) -> Column:  # n / d is rounded to k if 2 d k <= 2 n + d < 2 d (k + 1)
        reach, twice = F.try_add(F.try_multiply(w["n"], two), w["d"]), F.try_multiply(w["d"], two)
        return (F.try_multiply(twice, w["k"]) <= reach) & (reach < F.try_multiply(twice, w["k"] + 1))

    facts = F.struct(literal(shown).alias("shown"), *[literal(x).alias(f"a{i}") for i, x in enumerate(over)], *[literal(x).alias(f"b{i}") for i, x in enumerate(under)])
    return let(facts, lambda v: let(fraction(v), rounded))


def coarser(shown: Column, exact: Column) -> Column:
    """Whether the number token `shown` is the token `exact` rounded half up to fewer digits. Whole numbers that end in zeros show no
    digits for certain, so they never are."""
    a, b = F.abs(shown.try_cast("double")), F.abs(exact.try_cast("double"))
    certain = lambda t: F.when(t.contains(".") | F.lower(t).contains("e") | ~t.rlike("0$"), F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^[-+]|[eE].*$", ""), r"\.", ""), "^0+", "")))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(b)) - certain(shown) + 1)
    sign = F.startswith(shown, F.lit("-")) == F.startswith(exact, F.lit("-"))
    near = F.abs(F.try_divide(a, unit) - F.floor(F.try_divide(b, unit) + 0.5 + 1e-9)) < 1e-6
    return F.coalesce(sign & (certain(shown) > 0) & (certain(shown) < certain(exact)) & (b > 0) & near, F.lit(False))
