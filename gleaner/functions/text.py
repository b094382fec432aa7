"""Column functions over text. All are Spark SQL expressions but the three that end in `_udf`."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Java's and Python's \w differ on many letters; this class agrees with Python on all but a few recent code points.
WORD = r"[\p{L}\p{N}_]+"
SOFT_HYPHEN = "\u00ad"

#: The words that a query does not search for.
STOP_WORDS = (
    "а без бы в вам ваш где для до его ее если еще же за и из или как когда ли мне можно мой мы на над не но о об он "
    "она они от по под почему при про с так такое то у уже что это я"
).split()

#: Words that open a heading line in text taken from a PDF.
HEADING_LINE = r"(?iu)^(ЛЕКЦИЯ|РАЗДЕЛ|ГЛАВА|ТЕМА|ЧАСТЬ|ПРИЛОЖЕНИЕ|ВВЕДЕНИЕ|ЗАКЛЮЧЕНИЕ|§\s*\d+)(?![\p{L}\p{N}_]).*"


def text(c: Column | str) -> Column:
    """A column as text; null is empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it: inside of lambdas nothing else shares it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(c: Column | str) -> Column:
    """The word tokens of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(WORD), F.lit(0))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(words(c))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays without duplicates; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def squeeze(c: Column | str) -> Column:
    """Trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def title_key(c: Column | str) -> Column:
    """Titles are equal if they differ in case and white space only."""
    return F.lower(squeeze(c))


def clean_lines(c: Column | str) -> Column:
    """Text from a page layout: line feeds only, words joined over hyphenated line breaks, no page numbers on lines of
    their own, no trailing blanks, at most one empty line in a row."""
    out = F.regexp_replace(F.regexp_replace(text(c), "\r\n?", "\n"), SOFT_HYPHEN, "")
    out = F.regexp_replace(out, r"(?iu)([а-яёa-z])[‐‑-]\n\s*([а-яёa-z])", "$1$2")
    out = F.array_join(F.transform(F.filter(F.split(out, "\n"), lambda x: ~F.trim(x).rlike(r"^\d{1,4}$")), lambda x: F.rtrim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def promote_headings(c: Column | str, longest: int = 120) -> Column:
    """Lines of at most `longest` characters that open with a heading word become second-level headings."""
    line = lambda x: F.when((F.length(F.trim(x)) <= longest) & F.trim(x).rlike(HEADING_LINE), F.concat(F.lit("## "), F.trim(x))).otherwise(x)
    return F.array_join(F.transform(F.split(text(c), "\n"), line), "\n")


def windows(c: Column | str, size: int = 90_000, overlap: int = 1_500) -> Column:
    """An array of overlapping windows; none of a blank text, one if it fits."""
    t = F.trim(text(c))
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda s: F.substr(t, s + 1, F.lit(size)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(cut)


def query_terms(c: Column | str) -> Column:
    """Distinct tokens of a query: letters and digits, no stop words, no single letters."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower(text(c)), "ё", "е"), F.lit("[0-9a-zа-я]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(STOP_WORDS) & ((F.length(t) >= 2) | t.rlike("^[0-9]$"))))


def heading_titles(c: Column | str) -> Column:
    """Keys of the third-level headings of a Markdown text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(r"(?m)^###\s+(.+?)\s*$"), F.lit(1)), title_key))


def topics(c: Column, most: int = 40) -> Column:
    """Trimmed, non-empty, in order, the first of those that differ in case and spaces only; `most` at most."""
    trimmed = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (F.length(x) > 0))
    keys = F.transform(trimmed, title_key)
    return F.slice(F.filter(trimmed, lambda x, i: F.array_position(keys, title_key(x)) == i + 1), 1, most)


def ordered_union(a: Column, b: Column) -> Column:
    """a followed by what only b has, each once, in order of first appearance."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def profile_line(label: str, values: Column) -> Column:
    """`label: a; b; c` of the non-blank values on one line; null if there are none."""
    kept = F.filter(F.transform(values, squeeze), lambda x: F.length(x) > 0)
    return F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}: "), F.array_join(kept, "; ")))


def default_if_blank(*columns: Column) -> Column:
    """The first value that is not blank: an empty request inherits from the template, then from the default."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and without blanks: the form that fingerprints are taken of."""
    return F.to_json(F.parse_json(F.to_json(c)))


def fingerprint(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def policy_fingerprint(lines: Column, size: int = 12) -> Column:
    """The first digits of the SHA-256 of the sorted lines."""
    return F.substring(F.sha2(F.array_join(F.array_sort(lines), "\n"), 256), 1, size)


def money(amount: Column, currency: Column) -> Column:
    """`1,234.50 USD`; null without an amount."""
    return F.when(amount.isNotNull(), F.concat_ws(" ", F.format_number(amount, 2), F.nullif(F.trim(currency), F.lit(""))))


def balance(c: Column) -> Column:
    """The balance in the JSON answer of a provider, from the first shape that is known; null for any other."""
    v = F.try_parse_json(c)
    get = lambda path, kind="double": F.try_variant_get(v, path, kind)
    # from the text, since a variant holds 0.0 for -0.0
    number = lambda path: F.when(v.isNotNull(), F.get_json_object(c, path).try_cast("double"))
    amount = F.coalesce(number("$.balance_infos[0].total_balance"), number("$.data.total_credits") - F.coalesce(number("$.data.total_usage"), F.lit(0.0)), number("$.data.balance"), number("$.balance"))
    return money(amount, F.coalesce(get("$.balance_infos[0].currency", "string"), get("$.currency", "string"), F.lit("USD")))


def role_label(role: Column) -> Column:
    """Known grader roles by name; grader_3 and the like by number; others as they are."""
    number = F.regexp_extract(role, r"^grader_(\d+)$", 1)
    return F.when(role == "primary", "Primary grader").when(role == "skeptic", "Second grader").when(role == "arbiter", "Arbiter").when(number != "", F.concat(F.lit("Grader "), number)).otherwise(role)


def json_object(c: Column | str) -> Column:
    """The JSON object in a model's answer: fences removed, from the first brace to the last; null if it doesn't parse."""
    unfenced = F.regexp_replace(F.trim(text(c)), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    inner = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def wrapped_items(c: Column) -> Column:
    """The list of items in an answer: under `tasks`, or a sole list, or the object itself as the only item. JSON texts."""
    v = F.try_parse_json(c)
    inner = F.try_variant_get(v, "$.tasks", "array<variant>")
    one = F.when(F.try_variant_get(v, "$.statement", "string").isNotNull(), F.array(v))
    members = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    sole = F.when(F.size(members) == 1, F.try_variant_get(F.element_at(members, 1), "$", "array<variant>"))
    return F.transform(F.coalesce(inner, one, sole), lambda x: F.to_json(x))


#: LaTeX commands whose first letter is a JSON escape. Some are told by how they begin, the others only whole.
LATEX_BEGINS = "times text frac tfrac theta therefore tilde triangle right rangle rceil rfloor nabla notin"
LATEX_WHOLE = "tau tan tanh to rho neq"


def repaired_latex(c: Column) -> Column:
    r"""JSON text with LaTeX commands behind a single backslash: those backslashes are doubled, real escapes stay.

    The text is cut into runs of backslashes, each with what follows up to the next run. Pairs are escaped already; of an odd run the last backslash
    stays before a quote, a slash, the end of the text or a code point (u and four hex digits), and before b, f, n, r, t unless a command
    goes on from there: after b and f any letter does, after the others only known commands.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(?s)\\+[^\\]*|^[^\\]+"), F.lit(0))
    command = rf"[bf][a-zA-Z]|{'|'.join(LATEX_BEGINS.split())}|(?:{'|'.join(LATEX_WHOLE.split())})(?![a-zA-Z])"
    stays = rf'(?s)^\\+(?:\z|["/]|u[0-9a-fA-F]{{4}}|(?!{command})[bfnrt])'

    def one(run: Column) -> Column:
        odd = F.length(F.regexp_extract(run, r"^\\+", 0)) % 2 == 1
        return F.when(odd & ~run.rlike(stays), F.concat(F.lit("\\"), run)).otherwise(run)

    return F.when(c.isNotNull(), F.array_join(F.transform(runs, one), ""))


@F.pandas_udf(StringType())
def nfc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def canonical_markdown(c: Column | str) -> Column:
    """NFC, no byte order mark, line feeds, no trailing blanks or outer blank lines, one line feed at the end."""
    lines = F.regexp_replace(F.regexp_replace(nfc_udf(text(c)), "^\ufeff", ""), "\r\n?", "\n")
    lines = F.regexp_replace(lines, r"(?m)[ \t\f]+$", "")
    return F.concat(F.regexp_replace(lines, r"^\n+|\n+$", ""), F.lit("\n"))


def markdown_digest(c: Column | str) -> Column:
    return F.sha2(canonical_markdown(c), 256)
