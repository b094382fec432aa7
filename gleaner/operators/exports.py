"""Grouped and nested exports, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions.canonical import canonical
from gleaner.functions.numbers import number_tokens

NO_TOPIC = "Без темы"
SNAPSHOT_BYTES = 1_500_000


def bank_rows(tasks: DataFrame, topic: str, order: str) -> DataFrame:
    """tasks with paragraph, number: groups in order of first appearance, tasks numbered within them; `order` is unique.

    The paragraph of a group is its position in a table with a row per topic. numbered() spreads both over all tasks.
    """
    from .relational import numbered

    name = F.coalesce(F.nullif(F.trim(topic), F.lit("")), F.lit(NO_TOPIC))
    rows = numbered(tasks.withColumn(topic, name), [topic], [order], "number")
    firsts = tasks.select(name.alias(topic), order).groupBy(topic).agg(F.min(order).alias("_first"))
    paragraphs = numbered(firsts, [], ["_first"], "paragraph").drop("_first")
    return rows.join(paragraphs, topic)


def bank(tasks: DataFrame, topic: str, order: str, columns: list[str]) -> DataFrame:
    """paragraph, title, tasks (JSON array in order) of the bank; one row, and one JSON object in a file, per topic."""
    rows = bank_rows(tasks, topic, order)
    label = F.concat(F.col("paragraph").cast("string"), F.lit("."), F.col("number").cast("string"))
    item = F.struct("number", label.alias("label"), *columns)
    lists = rows.groupBy("paragraph", topic).agg(F.sort_array(F.collect_list(item)).alias("tasks"))
    return lists.select("paragraph", F.col(topic).alias("title"), F.to_json("tasks").alias("tasks"))


def answer_tolerance(answer: Column, frozen_pct: Column, template_pct: Column, default_pct: float = 5.0) -> Column:
    """value (the last number of an answer) and tolerance (its share); the contract frozen with a task wins over the template's."""
    tokens = number_tokens(answer)
    value = F.try_element_at(tokens, F.lit(-1)).try_cast("double")
    pct = F.coalesce(frozen_pct, template_pct, F.lit(default_pct))
    return F.struct(value.alias("value"), F.round(F.abs(value) * pct / 100, 10).alias("tolerance"))


def snapshots(rows: DataFrame, key: str, columns: list[str], most: int = SNAPSHOT_BYTES) -> DataFrame:
    """key, body (canonical JSON, byte by byte), version (its SHA-256), too_large of each row."""
    body = canonical(F.struct(*columns), StructType([rows.schema[c] for c in columns]))
    return rows.select(key, body.alias("body")).withColumns({"version": F.sha2("body", 256), "too_large": F.octet_length("body") > most})


def dialogs(turns: DataFrame, key: str, order: list[str], role: str, text: str, labels: dict[str, str]) -> DataFrame:
    """key, dialog: `Label: text` lines of each conversation in order."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), F.col(role)), F.col(role))
    line = F.concat(label, F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"])
    return turns.groupBy(key).agg(F.array_join(parts, "\n").alias("dialog"))


def concatenated(rows: DataFrame, key: str, order: list[str], text: str, separator: str = "\n\n") -> DataFrame:
    """key, text: the texts of each key in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda x: x[text]), separator).alias("text"))


def merged_sheets(sheets: DataFrame, key: str, position: str, kinds: tuple[str, ...] = ("table", "glossary", "notation", "formulas", "other"), most: int = 16) -> DataFrame:
    """key, kind, title, content, rank: sheets of equal kind and title become one; later ones add only lines that it has not.

    The first `most` merged sheets of each key, in order of first appearance, are the result.
    """
    kind = F.when(F.trim("kind").isin(*kinds), F.trim("kind")).otherwise("other")
    good = sheets.filter((F.trim("title") != "") & (F.trim("content") != ""))
    rows = good.select(key, position, kind.alias("kind"), F.lower(F.regexp_replace(F.trim("title"), r"\s+", " ")).alias("_key"), F.trim("title").alias("title"), F.trim("content").alias("content"))
    items = F.sort_array(F.collect_list(F.struct(position, "title", "content")))

    def add(lines: Column, x: Column) -> Column:
        seen = F.transform(lines, lambda y: F.trim(y))
        return F.concat(lines, F.filter(F.split(x["content"], "\n"), lambda y: (F.trim(y) != "") & ~F.array_contains(seen, F.trim(y))))

    first = F.split(F.element_at("_i", 1)["content"], "\n")
    merged = rows.groupBy(key, "kind", "_key").agg(items.alias("_i"))
    merged = merged.select(key, "kind", F.element_at("_i", 1)["title"].alias("title"), F.element_at("_i", 1)[position].alias("_first"), F.array_join(F.aggregate(F.slice("_i", 2, 1 << 30), first, add), "\n").alias("content"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_first", "kind", "title")))
    return ranked.filter(F.col("rank") <= most).drop("_first")


def retention(objects: DataFrame, group: str, order: list[Column], keep: int = 30) -> DataFrame:
    """objects with expired: not among the first `keep` of their group. The threshold is found per group by a limited ranking and joined
    back, so that a large group is not sorted in one task."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    kept = objects.withColumn("_r", rank).filter(F.col("_r") <= keep).select(group, "key").withColumn("_kept", F.lit(True))
    return objects.join(kept, [group, "key"], "left").withColumn("expired", F.col("_kept").isNull()).drop("_kept")
