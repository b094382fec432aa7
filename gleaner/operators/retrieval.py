"""Chunks, the term index, ranking and packing of context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.stem import stems
from gleaner.functions.text import let, query_terms, text, words
from gleaner.session import written

from .relational import dealt

#: Fixed values.
CHUNK = 2_500
K1, B = 1.2, 0.75
FIELD_WEIGHTS = (12, 4, 1)
BUDGET = 24_000


HEADING = r"^(#{1,3})\s+(.+)$"


def _places(lines: Column, keep: Callable[[Column], Column]) -> Column:
    """Positions (from 0) of a list of lines that satisfy a condition on the position."""
    return F.when(F.size(lines) > 0, F.filter(F.sequence(F.lit(0), F.size(lines) - 1), keep)).otherwise(F.array().cast("array<int>"))


def _trails(headings: Column) -> Column:
    """The heading trail of each section: none before the first heading; a level clears the deeper ones."""

    def step(at: Column, line: Column) -> Column:
        marks, title = F.length(F.regexp_extract(line, HEADING, 1)), F.trim(F.regexp_extract(line, HEADING, 2))
        level = lambda k: F.when(marks == k, title).when(marks < k, F.lit("")).otherwise(at[f"h{k}"]).alias(f"h{k}")
        return let(F.struct(level(1), level(2), level(3)), lambda now: F.struct(now["h1"].alias("h1"), now["h2"].alias("h2"), now["h3"].alias("h3"), F.concat(at["out"], F.array(F.concat_ws(" › ", *[F.nullif(now[f"h{k}"], F.lit("")) for k in (1, 2, 3)]))).alias("out")))

    start = F.struct(*[F.lit("").alias(f"h{k}") for k in (1, 2, 3)], F.array(F.lit("")).alias("out"))
    return F.aggregate(headings, start, step, lambda at: at["out"])


def _sections(c: Column) -> Column:
    """heading, lines of each section of a Markdown text: what lies between two headings of level 1 to 3."""
    lines = F.split(F.regexp_replace(text(c), r"\r\n?|[\x0B\x0C\x85\u2028\u2029]", "\n"), "\n")

    def cut(x: Column) -> Column:
        at, bounds = x["at"], F.concat(F.array(F.lit(-1)), x["at"], F.array(F.size(x["lines"])))
        trails = _trails(F.transform(at, lambda i: F.get(x["lines"], i)))
        one = lambda y: lambda k: F.struct(F.get(y["trails"], k).alias("heading"), F.slice(x["lines"], F.get(y["bounds"], k) + 2, F.get(y["bounds"], k + 1) - F.get(y["bounds"], k) - 1).alias("lines"))
        return let(F.struct(trails.alias("trails"), bounds.alias("bounds")), lambda y: F.transform(F.sequence(F.lit(0), F.size(at)), one(y)))

    return let(lines, lambda x: let(F.struct(x.alias("lines"), _places(x, lambda i: F.get(x, i).rlike(HEADING)).alias("at")), cut))


def _blocks(sections: Column) -> Column:
    """Runs of table lines and of other lines within each section: heading, kind, content."""

    def cut(section: Column) -> Column:
        lines = section["lines"]
        table = lambda i: F.startswith(F.ltrim(F.get(lines, i)), F.lit("|"))
        starts = _places(lines, lambda i: (i == 0) | (table(i) != table(F.greatest(i - 1, F.lit(0)))))
        one = lambda y: lambda k: F.struct(section["heading"].alias("heading"), F.when(table(F.get(y, k)), "table").otherwise("text").alias("kind"), F.array_join(F.slice(lines, F.get(y, k) + 1, F.get(y, k + 1) - F.get(y, k)), "\n").alias("content"))
        none = F.array().cast("array<struct<heading:string,kind:string,content:string>>")
        return let(F.concat(starts, F.array(F.size(lines))), lambda y: F.when(F.size(y) > 1, F.transform(F.sequence(F.lit(0), F.size(y) - 2), one(y))).otherwise(none))

    return F.flatten(F.transform(sections, cut))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _pieces(trimmed: Column, size: int) -> Column:
    """Text blocks in paragraphs packed up to `size` characters; longer paragraphs are cut."""
    paragraphs = F.filter(F.transform(F.split(trimmed, r"\n\s*\n"), _trimmed), lambda p: F.length(p) > 0)
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(at: Column, p: Column) -> Column:
        joined = F.when(at["now"] == "", p).otherwise(F.concat(at["now"], F.lit("\n\n"), p))
        closed = F.when(at["now"] == "", at["out"]).otherwise(F.concat(at["out"], F.array(at["now"])))
        whole = F.floor((F.length(p) - 1) / size).cast("int")  # full pieces before the rest
        cuts = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda k: F.substr(p, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(joined) <= size, F.struct(at["out"].alias("out"), joined.alias("now"))).otherwise(F.struct(F.concat(closed, cuts).alias("out"), F.substr(p, whole * size + 1, F.lit(size)).alias("now")))

    packed = F.aggregate(paragraphs, state, step, lambda at: F.when(at["now"] == "", at["out"]).otherwise(F.concat(at["out"], F.array(at["now"]))))
    return F.when(F.length(trimmed) <= size, F.array(trimmed)).otherwise(packed)


def split_markdown(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK) -> DataFrame:
    """id, ord, heading, kind, content, char_len: the chunks of each document in order, tables whole. They are numbered within the row."""

    def cut(block: Column) -> Column:
        one = lambda content: F.struct(block["heading"].alias("heading"), block["kind"].alias("kind"), _trimmed(content).alias("content"))
        whole = _trimmed(block["content"])
        return let(whole, lambda t: F.transform(F.when(block["kind"] == "table", F.array(t)).otherwise(_pieces(t, size)), one))

    chunks = F.filter(F.flatten(F.transform(_blocks(_sections(F.col(text_col))), cut)), lambda x: F.length(x["content"]) > 0)
    rows = docs.select(id_col, F.posexplode(chunks).alias("ord", "_x"))
    return rows.select(id_col, "ord", "_x.heading", "_x.kind", "_x.content", F.length("_x.content").alias("char_len"))


def runs(ordered: Column, key: Callable[[Column], Column], made: Callable[[Column, Column, Column], Column]) -> Column:
    """made(array, first place from 0, length) of each run of equal keys in an array, whose order puts equal keys behind each other."""

    def cut(items: Column) -> Column:
        starts = F.filter(F.transform(items, lambda x, i: F.when((i == 0) | (key(F.get(items, i - 1)) != key(x)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: made(items, i, F.coalesce(F.get(at, k + 1), F.size(items)) - i)))

    return let(ordered, cut)


def term_counts(tokens: Column) -> Column:
    """(term, tf) of the tokens of a row."""
    return runs(F.sort_array(tokens), lambda t: t, lambda items, i, n: F.struct(F.get(items, i).alias("term"), n.cast("long").alias("tf")))


def by_single_id(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id no other row has, and the others, if there are any. The ids alone are shuffled."""
    again = written(rows.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("_again")), "again")
    if again.isEmpty():
        return rows, None
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def asked_terms(queries: DataFrame, query_col: str) -> DataFrame:
    """term: the different terms of all queries, written."""
    return written(queries.select(F.explode(F.array_distinct(words(query_col))).alias("term")).distinct(), "asked")


def postings(chunks: DataFrame, id_col: str, text_col: str, stemmed: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """id, term, tf, len: the term index. Terms are counted within the row that has them, and are not shuffled; those of ids that several rows have count
    together. asked (term): other terms have no postings; for each chunk with words there is a row without term, since the lengths of all count."""
    single, several = by_single_id(chunks.select(id_col, F.col(text_col).alias("_text")), id_col)
    tokens = stems(words("_text")) if stemmed else words("_text")
    listed = lambda rows: rows.select(id_col, tokens.alias("_t")).withColumn("len", F.size("_t"))
    none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
    counts = term_counts(F.col("_t")) if asked is None else F.when(F.col("len") > 0, F.concat(F.array(none), term_counts(F.col("_t"))))
    out = listed(single).select(id_col, "len", F.explode(counts).alias("_x")).select(id_col, "_x.term", "_x.tf", "len")
    if several is not None:
        whole = listed(several).groupBy(F.col(id_col).alias("_whole")).agg(F.sum("len").cast("int").alias("len"))
        rest = listed(several).select(id_col, F.explode("_t").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
        out = out.unionByName(rest.join(whole, F.col(id_col).eqNullSafe(F.col("_whole"))).drop("_whole"))
        if asked is not None:
            out = out.unionByName(whole.filter("len > 0").select(F.col("_whole").alias(id_col), none["term"].alias("term"), none["tf"].alias("tf"), "len"))
    if asked is None:
        return out
    known = asked.withColumn("_asked", F.lit(True))
    return out.join(known, "term", "left").filter(F.col("term").isNull() | F.col("_asked")).select(id_col, "term", "tf", "len")


def without(index: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The index without the chunks of `gone`."""
    return index.join(gone.select(id_col).distinct(), id_col, "left_anti")


def bm25(index: DataFrame, queries: DataFrame, id_col: str, query_id: str, query_col: str, k: int = 8) -> DataFrame:
    """query, id, score, rank of the k best chunks of each query; terms are or-ed, ties go by id.

    Scores are rounded to 6 places before they are ranked, so the order does not hang on the order of sums. Nearly all chunks have a term of most queries, so
    the postings of the queries' terms are dealt by chunk over as many tasks as their hits, which are counted, take: there they are joined with the
    queries, added up and ranked, and only each task's best are shuffled. The queries' terms are written with their frequencies first, so Spark knows their size:
    if they are few, postings are picked by them where they are read.
    """
    lengths = index.groupBy(id_col).agg(F.first("len").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    terms = written(queries.select(query_id, F.explode(F.array_distinct(words(query_col))).alias("term")).distinct(), "terms")
    frequency = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    asked = written(terms.join(frequency, "term").withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one").drop("_one"), "asked")  # one row
    hits = asked.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    picked = index.join(asked.select("term").distinct(), "term", "left_semi")
    scored = dealt(picked, [id_col], hits, 2_000_000).join(asked, "term").groupBy(query_id, id_col).agg(F.round(F.sum(gain), 6).alias("score"))
    return ranked(scored, [query_id], k, F.col("score").desc(), F.col(id_col))


def ranked(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def field_score(terms: Column, field: Column | str, weight: int, stemmed: bool = True) -> Column:
    """weight times the terms that occur in a field as a token, or as a stem of three letters or more."""
    tokens = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text(field)), "ё", "е"), F.lit("[0-9a-zа-я]+"), F.lit(0)))
    exact = F.size(F.array_intersect(terms, tokens))
    if not stemmed:
        return exact * weight
    known = stems(tokens)
    by_stem = F.filter(F.array_except(terms, tokens), lambda t: (F.length(F.element_at(stems(F.array(t)), 1)) >= 3) & F.array_contains(known, F.element_at(stems(F.array(t)), 1)))
    return (exact + F.size(by_stem)) * weight


def weighted_rank(sheets: DataFrame, queries: DataFrame, query_id: str, query_col: str, fields: tuple[str, str, str], order: list[str], k: int = 8, stemmed: bool = False) -> DataFrame:
    """The k best sheets of each query by matches in title, description and content (12, 4, 1), ties by `order`.

    Candidates are found by an equi-join on terms and counted per field: no pair without a common term is made. Nearly all sheets have a term of most queries,
    so the terms asked for are picked and written first, and dealt by sheet over as many tasks as their hits, which are counted, take: there they are
    joined with the queries, added up and ranked, and only each task's best are shuffled.
    """
    asked = queries.select(query_id, F.explode(query_terms(query_col)).alias("term"))
    if stemmed:
        asked = asked.withColumn("term", F.element_at(stems(F.array("term")), 1))
    asked = written(asked, "asked")
    often = asked.groupBy("term").agg(F.count("*").alias("_n"))

    def tokens(field: str, weight: int) -> Column:
        found = F.regexp_extract_all(F.replace(F.lower(text(field)), F.lit("ё"), F.lit("е")), F.lit("[0-9a-zа-я]+"), F.lit(0))
        return F.transform(F.array_distinct(stems(found) if stemmed else found), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    found = sheets.select(*order, F.explode(F.concat(*[tokens(f, w) for f, w in zip(fields, FIELD_WEIGHTS, strict=True)])).alias("_t")).select(*order, "_t.term", "_t.w")
    found = written(found.join(often, "term"), "matches")
    hits = found.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    scored = dealt(found.drop("_n"), order, hits, 2_000_000).join(asked, "term").groupBy(query_id, *order).agg(F.sum("w").alias("score"))
    return ranked(scored, [query_id], k, F.col("score").desc(), *[F.col(c) for c in order])


def trusted(sheets: DataFrame, documents: DataFrame, source: str, explicit: list | None = None) -> DataFrame:
    """Sheets whose source document exists and is verified; with an explicit selection, those that were asked for."""
    if explicit is not None:
        return sheets.filter(F.col("sheet_id").isin(explicit) if explicit else F.lit(False))
    good = documents.filter(F.coalesce("authority", F.lit("unverified")) != "unverified").select(F.col("doc_id").alias(source), "authority")
    return sheets.join(good, source)


def pack_prefix(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int = BUDGET) -> DataFrame:
    """The rows of each key, in order, up to the first that would go beyond the budget. Keys hold a ranking's few rows."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(upto)).filter(F.col("used") <= budget)


def pack_greedy(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int = BUDGET, least: int = 2_000) -> DataFrame:
    """What each row of a key gets of the budget, in order: its size if it fits, the rest of the budget if more than `least`
    characters are left, else nothing; later, smaller rows are still tried. Keys hold a ranking's few rows.

    keys, the order columns, size, given, state (whole, cut, left_out).
    """
    items = F.sort_array(F.collect_list(F.struct(*order, size)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kind = f"array<struct<{','.join(f'{c}:{kinds[c]}' for c in [*order, size])},given:bigint>>"
    state = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(kind).alias("out"))

    def step(at: Column, x: Column) -> Column:
        given = F.when(x[size] <= at["left"], x[size].cast("long")).when(at["left"] > least, at["left"]).otherwise(F.lit(0).cast("long"))
        own = F.array(F.struct(*[x[c].alias(c) for c in [*order, size]], given.alias("given")))
        return F.struct((at["left"] - given).alias("left"), F.concat(at["out"], own).alias("out"))

    packed = rows.groupBy(*keys).agg(F.aggregate(items, state, step, lambda at: at["out"]).alias("_x"))
    out = packed.select(*keys, F.explode("_x").alias("_x")).select(*keys, "_x.*")
    return out.withColumn("state", F.when(F.col("given") == F.col(size), "whole").when(F.col("given") > 0, "cut").otherwise("left_out"))


def rendered_context(rows: DataFrame, keys: list[str], order: list[str], title: str, content: str) -> DataFrame:
    """One text per key: `### title` and content of its rows in order, joined by blank lines."""
    one = F.concat(F.lit("### "), F.col(title), F.lit("\n"), F.col(content))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, one.alias("_x")))), lambda x: x["_x"]), "\n\n").alias("context"))
