"""Readers of documents: text and Markdown files, page indexes in JSON, tables, and the routing between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.text import clean_lines, promote_headings, text

LEAST_CHARS_PER_PAGE = 90
MOST_PAGES, MOST_CHARS = 2_000, 10_000_000
DESCRIPTION = 2_000

#: The lines of a page section.
PAGE, FIGURES, WARNING = "# Страница ", "## Иллюстрации страницы", "Автоматические описания ниже требуют сверки с оригиналом:"

PAGES = "array<struct<page:int,page_num:int,markdown:string,figure_metadata:array<struct<ai_description:string>>>>"


@F.pandas_udf(StringType())
def _utf8_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file; bytes that are no UTF-8 become replacement characters."""
    return spark.read.format("binaryFile").load(path).select("path", _utf8_udf("content").alias("text"))


def page_index_files(spark: SparkSession, path: str) -> DataFrame:
    """path, n_pages, markdown of each JSON page index under a path: a list of pages, or an object with one under `pages`."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", page_index(F.col("value")).alias("x")).select("path", "x.*")


def page_index(json: Column) -> Column:
    """n_pages, state (ok, not_an_index, too_many_pages, no_text, too_long) and markdown of a page index.

    Pages without text are left out; the others are sorted by their number (or place), without image links, with the distinct
    descriptions of their figures.
    """
    v = F.try_parse_json(json)
    pages = F.coalesce(F.try_variant_get(v, "$.pages", PAGES), F.try_variant_get(v, "$", PAGES))
    filled = F.filter(F.transform(pages, lambda p, i: F.struct(F.coalesce(F.nullif(p["page"], F.lit(0)), F.nullif(p["page_num"], F.lit(0)), i + 1).alias("page"), i.alias("i"), p["markdown"].alias("m"), p["figure_metadata"].alias("f"))), lambda p: F.trim(text(p["m"])) != "")

    def section(p: Column) -> Column:
        body = clean_lines(F.regexp_replace(p["m"], r"!\[[^\]]*\]\([^)]*\)", ""))
        shown = F.array_distinct(F.filter(F.transform(p["f"], lambda f: F.substring(F.regexp_replace(F.trim(text(f["ai_description"])), r"\s+", " "), 1, DESCRIPTION)), lambda d: d != ""))
        figures = F.when(F.size(shown) > 0, F.concat(F.lit(f"\n\n{FIGURES}\n{WARNING}\n"), F.array_join(F.transform(shown, lambda d: F.concat(F.lit("- "), d)), "\n"))).otherwise("")
        return F.concat(F.lit(PAGE), p["page"].cast("string"), F.lit("\n\n"), body, figures)

    markdown = F.array_join(F.transform(F.array_sort(filled), section), "\n\n")
    n = F.coalesce(F.size(filled), F.lit(0))
    state = F.when(~F.coalesce(F.size(pages) > 0, F.lit(False)), "not_an_index").when(F.size(pages) > MOST_PAGES, "too_many_pages").when(n <= 0, "no_text").when(F.length(markdown) > MOST_CHARS, "too_long").otherwise("ok")
    return F.struct(F.greatest(n, F.lit(0)).alias("n_pages"), state.alias("state"), F.when(state == "ok", markdown).alias("markdown"))


def pages_to_markdown(pages: DataFrame, key: str, page: str, text_col: str) -> DataFrame:
    """key, n_pages, chars_per_page, markdown of page texts that come as rows: cleaned, headings promoted, in order."""
    body = promote_headings(clean_lines(text_col))
    rows = pages.select(key, F.struct(page, body.alias("t")).alias("x"))
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    average = F.aggregate("x", F.lit(0), lambda a, x: a + F.length(x["t"])) / F.greatest(F.size("x"), F.lit(1))
    return grouped.select(key, F.size("x").alias("n_pages"), average.alias("chars_per_page"), F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("markdown"))


def route(name: Column, chars_per_page: Column) -> Column:
    """How a file is read: text, index, layer (a PDF with a text layer), ocr (a scan), or unsupported."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("md", "txt", "markdown"), "text").when(suffix == "json", "index").when((suffix == "pdf") & (chars_per_page >= LEAST_CHARS_PER_PAGE), "layer").when(suffix == "pdf", "ocr").otherwise("unsupported")


def visible_text(html: Column) -> Column:
    """The text of a web page: no scripts, styles, comments or tags, the commonest entities resolved."""
    out = F.regexp_replace(text(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])\s*>", "\n"), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n"))
