"""Where a task's values come from: cited sheets, cited numbers, and the documents behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numbers import close, number_keys, number_tokens, plain_tokens, unknown_numbers
from gleaner.functions.text import heading_titles, text, title_key

from .admission import TRUSTED, yes

#: How a sheet's kind and its source's authority are written behind its title in a context.
KINDS = ("Таблица данных", "Глоссарий", "Обозначения", "Формулы", "Справка")
AUTHORITIES = {"course_policy": "правила курса", "course_lecture": "материал курса", "reference": "справочный источник"}


def given_condition(token: Column) -> Column:
    """Whole numbers below 1000 and tenths below 100 are what a task is about, not data from a table."""
    value = F.abs(token.try_cast("double"))
    return yes((token.rlike(r"^[-+]?\d+$") & (value < 1000)) | (token.rlike(r"^[-+]?\d+\.\d$") & (value < 100)))


def legacy_data_check(statement: Column, sheets_text: Column, plain: bool = False, most: int = 20) -> Column:
    """status, unknown: numbers of a statement that no sheet has, leaving out given conditions; skipped without sheets."""
    tokens_of = plain_tokens if plain else number_tokens
    unknown = unknown_numbers(F.filter(tokens_of(statement), lambda t: ~given_condition(t)), tokens_of(sheets_text))
    blank = F.trim(text(sheets_text)) == ""
    none = F.array().cast("array<string>")
    return F.struct(F.when(blank, "skipped").when(F.size(unknown) > 0, "warn").otherwise("ok").alias("status"), F.when(blank, none).otherwise(F.slice(unknown, 1, most)).alias("unknown"))


def cited_titles(data_used: Column) -> Column:
    return F.transform(data_used, lambda x: F.trim(text(x["sheet_title"])))


def data_check(data_used: Column, sheets_text: Column, most: int = 20) -> Column:
    """status, unknown_numbers, unknown_sources, n_invalid of data_used (array of sheet_title, values).

    A cited title has to start a line of the sheets, a heading mark before it allowed; cited values have to occur there. Null
    data_used is skipped, an empty one is ok.
    """
    lines = F.transform(F.split(F.lower(text(sheets_text)), "\n"), lambda x: F.regexp_replace(x, r"^#{1,3}\s+", ""))

    def known(title: Column) -> Column:
        t = F.lower(title)
        return F.exists(lines, lambda x: F.startswith(x, t) & F.substr(x, F.length(t) + 1, F.lit(1)).rlike(r"^$|[\s(\[—]"))

    blank = F.filter(data_used, lambda x: (F.trim(text(x["sheet_title"])) == "") | ~yes(F.size(x["values"]) > 0) | yes(F.exists(x["values"], lambda v: F.trim(text(v)) == "")))
    titles = F.array_distinct(F.filter(cited_titles(data_used), lambda t: (t != "") & ~known(t)))
    values = F.array_join(F.flatten(F.transform(data_used, lambda x: F.coalesce(x["values"], F.array().cast("array<string>")))), "\n")
    unknown = unknown_numbers(number_tokens(values), number_tokens(sheets_text))
    status = F.when(data_used.isNull(), "skipped").when(F.size(blank) > 0, "invalid").when((F.size(unknown) > 0) | (F.size(titles) > 0), "warn").otherwise("ok")
    none = F.array().cast("array<string>")
    return F.struct(status.alias("status"), F.coalesce(F.slice(unknown, 1, most), none).alias("unknown_numbers"), F.coalesce(F.slice(titles, 1, most), none).alias("unknown_sources"), F.greatest(F.size(blank), F.lit(0)).alias("n_invalid"))


def aliases(sheets: DataFrame) -> DataFrame:
    """key, needs_heading, sheet: all ways in which a sheet (task_id, title, authority, ...) may be cited.

    Its title as it is; behind a level-three mark, if that heading was shown; with kind and authority, if that was.
    """
    plain = sheets.select("task_id", title_key("title").alias("key"), F.lit(False).alias("needs_heading"), title_key("title").alias("sheet"), F.lit(None).cast("string").alias("heading"))
    marked = sheets.select("task_id", F.concat(F.lit("### "), title_key("title")).alias("key"), F.lit(True).alias("needs_heading"), title_key("title").alias("sheet"), title_key("title").alias("heading"))
    label = F.try_element_at(F.create_map(*[x for a, b in AUTHORITIES.items() for x in (F.lit(a), F.lit(b))]), F.col("authority"))
    kinds = sheets.withColumn("_kind", F.explode(F.array(*map(F.lit, KINDS)))).filter(label.isNotNull())
    full = title_key(F.concat(F.trim("title"), F.lit(" ("), F.col("_kind"), F.lit(", "), label, F.lit(")")))
    decorated = kinds.select("task_id", full.alias("key"), F.lit(True).alias("needs_heading"), title_key("title").alias("sheet"), full.alias("heading"))
    return plain.unionByName(marked).unionByName(decorated)


def lineage_check(tasks: DataFrame, sheets: DataFrame) -> DataFrame:
    """task_id, status, unbound, n_invalid of tasks (task_id, data_used, context) against the sheets (task_id, title, document,
    document_exists, authority) that they were given: every cited title has to lead to a trusted document that exists.
    """
    cited = tasks.select("task_id", heading_titles("context").alias("headings"), F.posexplode("data_used").alias("pos", "x"))
    bad = (F.trim(text(F.col("x.sheet_title"))) == "") | ~yes(F.size("x.values") > 0) | yes(F.exists("x.values", lambda v: F.trim(text(v)) == ""))
    cited = cited.select("task_id", "headings", "pos", F.trim(text(F.col("x.sheet_title"))).alias("title"), title_key("x.sheet_title").alias("key"), bad.alias("bad"))
    good = sheets.filter(yes(F.trim("document") != "") & yes(F.col("document_exists")) & yes(F.col("authority").isin(*TRUSTED)))
    found = cited.join(aliases(good), ["task_id", "key"]).filter(~F.col("needs_heading") | F.array_contains("headings", F.col("heading")))
    bound = found.select("task_id", "pos").distinct().withColumn("bound", F.lit(True))
    each = cited.join(bound, ["task_id", "pos"], "left")
    label = F.when(F.col("title") == "", F.concat(F.lit("data_used["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.col("title"))
    lists = each.groupBy("task_id").agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("bound").isNull(), F.struct("pos", label.alias("t"))))), lambda s: s["t"])).alias("unbound"), F.count_if("bad").alias("n_invalid"))
    none = F.array().cast("array<string>")
    status = F.when(F.col("data_used").isNull(), "skipped").when(F.col("n_invalid") > 0, "invalid").when(F.size("unbound") > 0, "warn").otherwise("ok")
    return tasks.join(lists, "task_id", "left").select("task_id", status.alias("status"), F.coalesce("unbound", none).alias("unbound"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"))


def rendered_sheets(sheets: DataFrame, contexts: DataFrame) -> DataFrame:
    """The sheets (task_id, title, ...) whose heading is in the context that their task was given."""
    return sheets.join(contexts, "task_id").filter(F.array_contains(heading_titles("context"), title_key("title"))).select(*sheets.columns)


def number_index(sheets_text: Column) -> Column:
    """tokens and values of the numbers in a text of sheets."""
    tokens = number_tokens(sheets_text)
    return F.struct(number_keys(tokens).alias("tokens"), F.filter(F.transform(tokens, lambda t: t.try_cast("double")), lambda v: v.isNotNull()).alias("values"))


def known_value(value: Column, index: Column, near: float = 1e-6) -> Column:
    return F.exists(index["values"], lambda v: close(value, v, near))
