"""Text, chunk, search, packing and near-duplicate plans over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions import canonical, stem, text as T
from gleaner.operators import exports, impacts, ranking, retrieval, segments
from gleaner.operators import relational as R
from gleaner.operators.dedup import dedup_bounded as bounded
from gleaner.session import shared_folder, written
from gleaner.sources import readers

from .registry import ORACLE_SQL, query, table

WORDS_SQL = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def words_sql(c: str) -> str:
    return WORDS_SQL.format(c=c)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10), 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(replace(t, chr(173), ''), '(?i)([а-яёa-z])[‐‑-]\n\s*([а-яёa-z])', '\1\2', 'g') AS t FROM a),
    c AS (SELECT doc_id, list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(trim(x, ' '), '\d{1,4}')), lambda x: rtrim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')) AS l FROM b),
    d AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[\t\n\f\r\x0B ]+|[\t\n\f\r\x0B ]+$', '', 'g') AS t FROM c)
    SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM d""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", T.clean_lines("text").alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("sha"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) <= 120 AND regexp_matches(trim(x, ' '), '(?i)^(chapter|is|ein)([^\p{L}\p{N}_]|$)'))) AS n FROM documents""")
def heading_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the lines that a promotion with these opening words would turn into headings."""
    opening = r"(?i)^(chapter|is|ein)([^\p{L}\p{N}_]|$)"
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(F.trim(x)) <= 120) & F.trim(x).rlike(opening))
    return documents(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), s AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 900 THEN [0] ELSE range(0, length(t), 750) END) AS s FROM t WHERE length(t) > 0)
    SELECT doc_id, s // 750 AS ord, length(substr(t, s + 1, 900)) AS n, sha256(substr(t, s + 1, 900)) AS sha FROM s""")
def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.windows("text", 900, 150)).alias("ord", "w"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("w").cast("long").alias("n"), F.sha2("w", 256).alias("sha"))


@query("""WITH k AS (SELECT p_brand, p_partkey, p_name, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key FROM part), f AS (SELECT p_brand, key, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS first FROM k GROUP BY 1, 2)
    SELECT p_brand, string_agg(name, ';' ORDER BY first) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS r FROM f) WHERE r <= 40 GROUP BY 1""")
def norm_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = table(spark, sf_dir, "part").groupBy("p_brand", T.title_key("p_name").alias("key")).agg(F.min(F.struct("p_partkey", "p_name")).alias("f"))
    lists = firsts.groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["p_name"]).alias("names"))
    return lists.select("p_brand", F.array_join(T.topics(F.col("names")), ";").alias("topics"))


@query("""SELECT conv_id, sha256(string_agg(CASE role WHEN 'user' THEN 'Student' WHEN 'assistant' THEN 'Tutor' ELSE role END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS sha FROM conversations GROUP BY 1""")
def flatten_dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = exports.dialogs(turns, "conv_id", ["turn", "role", "text"], "role", "text", {"user": "Student", "assistant": "Tutor"})
    return out.select("conv_id", F.sha2("dialog", 256).alias("sha"))


@query("""WITH c AS (SELECT conv_id, string_agg('### ' || role || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS md FROM conversations GROUP BY 1)
    SELECT conv_id, array_to_string(list_distinct_sorted, ';') AS titles FROM (SELECT conv_id, list_sort(list_distinct(list_transform(regexp_extract_all(md, '(?m)^###\\s+(.+?)\\s*$', 1), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))))) AS list_distinct_sorted FROM c)""")
def heading_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.concat(F.lit("### "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    md = exports.concatenated(table(spark, sf_dir, "conversations").withColumn("s", section), "conv_id", ["turn", "role"], "s", "\n")
    return md.select("conv_id", F.array_join(F.array_sort(T.heading_titles("text")), ";").alias("titles"))


@query("""SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, ''))) AS sha FROM conversations GROUP BY 1""")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return exports.concatenated(turns, "conv_id", ["turn"], "text").select("conv_id", F.sha2("text", 256).alias("sha"))


@query("""SELECT c_custkey, 'Names: ' || c_name || '; ' || c_mktsegment AS line, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN c_mktsegment END), ''), nullif(trim(c_name), ''), 'none') AS topic FROM customer""")
def profile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    line = T.profile_line("Names", F.array("c_name", F.lit("  "), "c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"), T.default_if_blank(asked, F.col("c_name"), F.lit("none")).alias("topic"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(md|txt|markdown)$') THEN 'text' WHEN regexp_matches(lower(url), '\\.json$') THEN 'index' WHEN regexp_matches(lower(url), '\\.pdf$') THEN CASE WHEN length(html) / 10 >= 90 THEN 'layer' ELSE 'ocr' END ELSE 'unsupported' END AS route
    FROM (SELECT page_id, html, split_part(split_part(url, '?', 1), '#', 1) || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.json' ELSE '' END AS url FROM pages)""")
def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 4
    name = F.concat(F.regexp_extract("url", r"^[^?#]*", 0), F.when(kind == 0, ".pdf").when(kind == 1, ".MD").when(kind == 2, ".json").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", readers.route(name, F.length("html") / 10).alias("route"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readers.visible_text(F.col("html")).alias("text"))


@query("""SELECT conv_id, count(*) AS n_pages, round(sum(length(coalesce(text, ''))) / greatest(count(*), 1), 6) AS chars_per_page FROM conversations GROUP BY 1""")
def document_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations")
    return pages.groupBy("conv_id").agg(F.count("*").alias("n_pages"), F.round(F.sum(F.length(T.text("text"))) / F.greatest(F.count("*"), F.lit(1)), 6).alias("chars_per_page"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, t, unnest(range(0, length(t), 2500)) AS s FROM t)
    SELECT doc_id, s // 2500 AS ord, sha256(regexp_replace(substr(t, s + 1, 2500), '^\\s+|\\s+$', '', 'g')) AS sha FROM s WHERE length(regexp_replace(substr(t, s + 1, 2500), '^\\s+|\\s+$', '', 'g')) > 0""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without headings, tables and blank lines: chunks are their slices. Other texts are tested on fixtures."""
    chunks = retrieval.split_markdown(documents(spark, sf_dir), "doc_id", "text")
    return chunks.select("doc_id", F.col("ord").cast("long").alias("ord"), F.sha2("content", 256).alias("sha"))


MARKDOWN = "# A\nx\n\ny\n## B\n| a | b |\n| 1 | 2 |\ntail\n### C\nq\n# D\nz"


@query(r"""WITH t AS (SELECT conv_id, role, turn, trim(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations),
    p AS (SELECT conv_id, role, r, 0 AS part, 'text' AS kind, text AS content FROM t WHERE text <> '' UNION ALL SELECT conv_id, role, r, 1, 'table', '| turn | chars |' || chr(10) || '|---|---|' || chr(10) || '| ' || turn || ' | 1 |' FROM t)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY r, part) - 1 AS ord, role AS heading, kind, content, length(content) AS char_len FROM p""")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading per turn, its text of less than a chunk, and a table. Longer ones are tested on fixtures."""
    part = F.concat(F.lit("## "), "role", F.lit("\n"), T.text("text"), F.lit("\n| turn | chars |\n|---|---|\n| "), F.col("turn").cast("string"), F.lit(" | 1 |\n"))
    docs = exports.concatenated(table(spark, sf_dir, "conversations").withColumn("part", part), "conv_id", ["turn", "role"], "part", "\n")
    return retrieval.split_markdown(docs, "conv_id", "text")


#: Letters of the texts and the Russian ones that stand for them, so that words get Russian endings.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшьыз"
RUSSIAN_SQL = f"translate(lower(text), '{LATIN}', '{CYRILLIC}')"


def russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.translate(F.lower("text"), LATIN, CYRILLIC).alias("text"))


def _stem_sql() -> str:
    """CTEs up to k (term, stem): every word of the texts in Russian letters and its stem."""
    v = stem.VOWELS
    head = f"regexp_extract(w, '^[^{v}]*[{v}]')"
    rep = lambda c, s: f"regexp_replace({c}, '{s[0]}', '{s[1].replace('$1', chr(92) + '1')}')"
    return f"""t AS (SELECT DISTINCT unnest({words_sql(RUSSIAN_SQL)}) AS w0 FROM documents),
    a AS (SELECT w0, replace(w0, 'ё', 'е') AS w FROM t), b AS (SELECT w0, w, {head} AS h, substr(w, length({head}) + 1) AS rv FROM a),
    c AS (SELECT *, {rep('rv', stem.GERUND_STEP)} AS g, {rep('rv', stem.REFLEXIVE_STEP)} AS p FROM b), d AS (SELECT *, {rep('p', stem.ADJECTIVE_STEP)} AS adj FROM c),
    e AS (SELECT *, CASE WHEN g <> rv THEN g WHEN adj <> p THEN {rep('adj', stem.PARTICIPLE_STEP)} WHEN {rep('p', stem.VERB_STEP)} <> p THEN {rep('p', stem.VERB_STEP)} ELSE {rep('p', stem.NOUN_STEP)} END AS one FROM d),
    f AS (SELECT *, h || regexp_replace(one, 'и$', '') AS two, length(regexp_extract(w, '{stem.R2}')) AS r2 FROM e), g2 AS (SELECT *, regexp_extract(two, '({stem.DERIVED})$') AS x FROM f),
    i AS (SELECT *, substr(CASE WHEN x <> '' AND r2 > 0 AND length(two) - length(x) >= r2 THEN substr(two, 1, length(two) - length(x)) ELSE two END, length(h) + 1) AS tail FROM g2),
    j AS (SELECT *, regexp_replace(tail, '({stem.SUPERLATIVE})$', '') AS s FROM i),
    k AS (SELECT w0 AS term, CASE WHEN h = '' THEN w ELSE h || CASE WHEN tail LIKE '%нн' THEN regexp_replace(tail, 'н$', '') WHEN s <> tail THEN regexp_replace(s, 'нн$', 'н') ELSE regexp_replace(tail, 'ь$', '') END END AS stem FROM j)"""


@query(f"WITH {_stem_sql()} SELECT term AS word, stem FROM k")
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different word of the texts, in Russian letters, and its stem."""
    return ranking.stem_dictionary(russian(spark, sf_dir), "text").select(F.col("term").alias("word"), "stem")


@query(f"WITH {_stem_sql()}, p AS (SELECT doc_id, unnest({words_sql(RUSSIAN_SQL)}) AS term FROM documents) SELECT doc_id, stem AS term, count(*) AS tf FROM p JOIN k USING (term) GROUP BY 1, 2")
def stem_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term index of stems: each different word is stemmed once, whatever the number of its places."""
    docs = russian(spark, sf_dir)
    index = retrieval.postings(docs, "doc_id", "text")
    return ranking.stemmed_index(index, written(ranking.stem_dictionary(docs, "text"), "stems"), "doc_id").select("doc_id", "term", "tf")


@query(f"""WITH f AS (SELECT doc_id, {words_sql("source || ' ' || substr(text, 1, 40)")} AS h, {words_sql("text")} AS b FROM documents),
    p AS (SELECT doc_id, unnest(h || b) AS term, unnest(range(len(h) + len(b))) AS pos, unnest(list_transform(range(len(h) + len(b)), lambda i: CASE WHEN i < len(h) THEN 1.0 ELSE 0.1 END))::DOUBLE AS w FROM f),
    j AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY pos) AS j FROM p),
    m AS (SELECT doc_id, term, max(w) AS most, sum(w / (j * j)) AS whole, arg_min(j, (-w, j)) AS first FROM j GROUP BY 1, 2),
    g AS (SELECT doc_id, term, (most + whole - most / (first * first)) / 1.64493406685 AS gain FROM m),
    q AS (SELECT DISTINCT item_id, unnest({words_sql('text')}) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
    r AS (SELECT item_id, doc_id, round(sum(gain / n), 6) AS score FROM q JOIN n USING (item_id) JOIN g USING (term) GROUP BY 1, 2)
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 8""")
def ts_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts as queries; source and opening are the heading (class A), texts the body (class D)."""
    docs = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit(" "), F.substring("text", 1, 40)).alias("heading"), "text")
    index = ranking.positional_postings(docs, "doc_id", {"heading": "A", "text": "D"})
    return ranking.rank_by_places(index, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")


@query(f"""WITH p AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM p GROUP BY 1, 2""")
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "term", "tf")


@query(f"""WITH p AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY 1""")
def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.postings(documents(spark, sf_dir), "doc_id", "text")
    left = retrieval.without(index, table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    return left.groupBy("term").agg(F.count("*").alias("df"))


def _bm25_sql(asked: str) -> str:
    """The search for `asked`, an expression over the columns of benchmark."""
    return f"""WITH i AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM i GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1),
    s AS (SELECT count(*) AS n, avg(len) AS a FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest({words_sql(asked)}) AS term FROM benchmark),
    r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2)
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 8"""


@query(_bm25_sql("text"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts as queries. The index is used for lengths, frequencies and hits, so it is written once, with the postings of their terms."""
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    index = written(retrieval.postings(documents(spark, sf_dir), "doc_id", "text", asked=retrieval.asked_terms(queries, "q")), "index")
    return retrieval.bm25(index, queries, "doc_id", "item_id", "q")


@query(_bm25_sql("substr(text, 1, 200)"))
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by impact bands and upper bounds; a query is the first 200 characters."""
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 200).alias("q"))
    index = written(retrieval.postings(documents(spark, sf_dir), "doc_id", "text", asked=retrieval.asked_terms(queries, "q")), "index")
    return impacts.top_k(*impacts.impact_index(index, "doc_id"), queries, "doc_id", "item_id", "q")


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN text || ' upserted ' || coalesce(source, '') ELSE text END AS text FROM documents WHERE doc_id % 100 <> 11 OR doc_id % 200 = 111),
    p AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS places FROM p GROUP BY 1""")
def segment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all texts, of which 1 % change, 1 % are deleted, and half of those come back, each in a segment of its own, then compacted but for the first."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = segments.SegmentedIndex(spark, shared_folder(spark, "segments"))
    index.upsert(docs, "doc_id", "text")
    changed = documents(spark, sf_dir).filter("doc_id % 100 = 7").select("doc_id", F.concat("text", F.lit(" upserted "), F.coalesce("source", F.lit(""))).alias("text"))
    index.upsert(changed, "doc_id", "text")
    index.delete(docs.filter("doc_id % 100 = 11"), "doc_id")
    index.upsert(docs.filter("doc_id % 200 = 111"), "doc_id", "text")
    index.compact(2)
    places = index.postings().groupBy("term").agg(F.sum("tf").alias("places"))
    return index.frequencies().join(places, "term").select("term", "df", "places")


@query("""WITH d AS (SELECT doc_id, source AS tenant, CASE doc_id % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN 'reference' WHEN 2 THEN 'course_lecture' ELSE 'course_policy' END AS authority FROM documents)
    SELECT item_id, doc_id FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(substr(text, 1, 200)), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark) q
    JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) p USING (term) JOIN d USING (doc_id) WHERE authority IN ('reference', 'course_policy') GROUP BY 1, 2 HAVING count(*) >= 12""")
def fts_policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed documents with twelve or more of a query's terms; a query is the first 200 characters, as in the search."""
    kind = F.col("doc_id") % 4
    authority = F.when(kind == 0, "unverified").when(kind == 1, "reference").when(kind == 2, "course_lecture").otherwise("course_policy")
    allowed = documents(spark, sf_dir).select("doc_id", authority.alias("authority")).filter(R.in_list(F.col("authority"), ["reference", "course_policy"]))
    index = retrieval.postings(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "term").join(allowed.select("doc_id"), "doc_id")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.words(F.substring("text", 1, 200)))).alias("term"))
    return index.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).filter("n >= 12").select("item_id", "doc_id")


@query("""WITH f AS (SELECT doc_id, unnest([12, 4, 1]) AS w, unnest([substr(text, 1, 40), coalesce(source, ''), text]) AS t FROM documents),
    k AS (SELECT DISTINCT doc_id, w, unnest(regexp_extract_all(replace(lower(t), 'ё', 'е'), '[0-9a-zа-я]+')) AS term FROM f),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[0-9a-zа-я]+')) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, sum(w) AS score FROM q JOIN k USING (term) WHERE length(term) >= 2 OR regexp_matches(term, '^[0-9]$') GROUP BY 1, 2)
    SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 8""")
def weighted_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = documents(spark, sf_dir).select("doc_id", F.substring("text", 1, 40).alias("title"), F.coalesce("source", F.lit("")).alias("description"), "text")
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    return retrieval.weighted_rank(sheets, queries, "item_id", "q", ("title", "description", "text"), ["doc_id"])


@query("""WITH s AS (SELECT conv_id, turn, role, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, role, CAST(used AS BIGINT) AS used FROM s WHERE used <= 800""")
def context_pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return retrieval.pack_prefix(turns, ["conv_id"], ["turn", "role"], F.length(T.text("text")), 800).select("conv_id", "turn", "role", "used")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations),
    f AS (SELECT conv_id, 0 AS i, 0::BIGINT AS turn, '' AS role, 0 AS size, 0::BIGINT AS given, 800::BIGINT AS left_ FROM (SELECT DISTINCT conv_id FROM t) UNION ALL
    SELECT t.conv_id, t.i, t.turn, t.role, t.size, CASE WHEN t.size <= f.left_ THEN t.size WHEN f.left_ > 100 THEN f.left_ ELSE 0 END, f.left_ - CASE WHEN t.size <= f.left_ THEN t.size WHEN f.left_ > 100 THEN f.left_ ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
    SELECT conv_id, turn, role, given, CASE WHEN given = size THEN 'whole' WHEN given > 0 THEN 'cut' ELSE 'left_out' END AS state FROM f WHERE i > 0""")
def context_pack_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(T.text("text")).alias("size"))
    return retrieval.pack_greedy(turns, ["conv_id"], ["turn", "role"], "size", 800, 100).select("conv_id", "turn", "role", "given", "state")


@query("""WITH s AS (SELECT item_id AS sheet_id, item_id AS doc_id FROM benchmark), d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN 'reference' ELSE 'course_lecture' END AS authority FROM documents WHERE doc_id % 9 <> 0)
    SELECT sheet_id, authority FROM s JOIN d USING (doc_id) WHERE authority <> 'unverified'""")
def trust_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sheet_id"), F.col("item_id").alias("source_document_id"))
    kind = F.col("doc_id") % 4
    docs = documents(spark, sf_dir).filter("doc_id % 9 <> 0").select("doc_id", F.when(kind == 0, "unverified").when(kind == 1, "reference").otherwise("course_lecture").alias("authority"))
    return retrieval.trusted(sheets, docs, "source_document_id").select("sheet_id", "authority")


@query("""SELECT item_id FROM benchmark WHERE item_id IN (3, 5, 8)""")
def sheet_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "benchmark").withColumn("sheet_id", F.col("item_id"))
    return retrieval.trusted(sheets, documents(spark, sf_dir), "item_id", explicit=[3, 5, 8]).select("item_id")


@query("""SELECT item_id, doc_id, starts_with(d.text, substr(b.text, 1, 30)) AS at_start FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def section_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a benchmark text. Of a section that a text holds all words but the first and last are words of the text, too: candidates share
    five of those behind each other, or one if there are fewer, found by an equi-join; sections of one or two words are looked for in all texts."""
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    run = lambda w, i, n: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])
    runs = lambda w, n: F.transform(w, lambda _, i: run(w, i, n))
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "section").withColumn("w", words("section"))
    n = F.when(F.size("w") > 6, 5).when(F.size("w") > 2, 1).otherwise(0)
    items = written(items.select("item_id", "section", n.alias("n"), F.when(n == 5, run(F.col("w"), F.lit(1), 5)).otherwise(run(F.col("w"), F.lit(1), 1)).alias("key")), "sections")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lengths = {r["n"] for r in items.select("n").distinct().collect()}  # of three

    def found(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.contains("text", F.col("section"))).select("item_id", "doc_id", F.startswith("text", F.substring("section", 1, 30)).alias("at_start"))

    keys = docs.select("doc_id", F.explode(T.let(words("text"), lambda w: F.array_distinct(F.concat(*[runs(w, k) for k in sorted(lengths - {0}) or [5]])))).alias("key"))
    pairs = written(keys.join(items.filter("n > 0").select("item_id", "key"), "key").select("item_id", "doc_id").distinct(), "candidates")
    out = found(docs.join(pairs, "doc_id").join(items.filter("n > 0"), "item_id"))
    return out.unionByName(found(docs.join(F.broadcast(items.filter("n = 0")), F.contains("text", F.col("section"))))) if 0 in lengths else out


PLAIN = "list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?'), lambda x: lower(x)))"


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, list_distinct({words_sql('text')}) AS w, {PLAIN} AS x FROM documents),
    p AS (SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS wi, len(a.w) + len(b.w) AS wu, len(list_intersect(a.x, b.x)) AS xi, len(a.x) + len(b.x) AS xu FROM r a JOIN r b ON a.source IS NOT DISTINCT FROM b.source AND a.rn - b.rn BETWEEN 1 AND 50),
    s AS (SELECT doc_id, CASE WHEN wu = 0 THEN 0 ELSE wi / (wu - wi) END AS s, xu = 0 OR (xu - xi > 0 AND xi / nullif(xu - xi, 0) >= 0.8) AS near FROM p), m AS (SELECT doc_id, max(s) AS s, bool_or(s > 0.85 AND near) AS d FROM s GROUP BY 1)
    SELECT doc_id, source, round(coalesce(s, 0), 6) AS similarity, coalesce(d, false) AS duplicate FROM r LEFT JOIN m USING (doc_id)""")
def dedup_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(documents(spark, sf_dir), "source", "doc_id", "text", plain=True)


@query()
def dedup_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the whole number grammar."""
    return bounded(documents(spark, sf_dir), "source", "doc_id", "text")


@query("""WITH f AS (SELECT p_brand AS topic, min(p_partkey) AS first FROM part GROUP BY 1), p AS (SELECT topic, row_number() OVER (ORDER BY first) AS paragraph FROM f)
    SELECT p_partkey, paragraph, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number FROM part JOIN p ON topic = p_brand""")
def bank_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.bank_rows(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", F.col("paragraph").cast("long").alias("paragraph"), "number")


@query("""WITH f AS (SELECT p_brand AS topic, min(p_partkey) AS first FROM part GROUP BY 1), g AS (SELECT topic, row_number() OVER (ORDER BY first) AS paragraph FROM f),
    p AS (SELECT p_brand, p_name, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number FROM part)
    SELECT paragraph, topic AS title, '[' || string_agg('{"number":' || number || ',"label":"' || paragraph || '.' || number || '","p_name":"' || p_name || '","p_retailprice":' || p_retailprice || '}', ',' ORDER BY number) || ']' AS tasks FROM p JOIN g ON topic = p_brand GROUP BY 1, 2""")
def bank_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.bank(table(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_name", "p_retailprice"])


@query("""SELECT p_partkey, p_retailprice AS value, round(abs(p_retailprice) * CASE WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 3 = 1 THEN 2.5 ELSE 5.0 END / 100, 6) AS tolerance FROM part""")
def variants_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("x_1 = 7; ответ: "), F.col("p_retailprice").cast("string"))
    frozen, template = F.when(F.col("p_size") % 3 == 0, F.lit(1.0)), F.when(F.col("p_size") % 3 == 1, F.lit(2.5))
    return table(spark, sf_dir, "part").select("p_partkey", exports.answer_tolerance(answer, frozen, template).alias("t")).select("p_partkey", "t.value", F.round("t.tolerance", 6).alias("tolerance"))


@query("""SELECT p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' AS body, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS version, false AS too_large FROM part""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.snapshots(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_name", "p_brand"])


_DIGITS_SQL = "CASE l_partkey % 9 WHEN 0 THEN '-0.0'::DOUBLE WHEN 1 THEN 1e21 WHEN 2 THEN l_extendedprice / 3 ELSE l_extendedprice * list_extract([1e-11, 1e-7, 1e-5, 1e-3, 1, 1e5, 1e11, 1e12, 1e19, 1e297]::DOUBLE[], l_partkey % 10 + 1) END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CAST({_DIGITS_SQL} AS DOUBLE) AS x, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag || ' «é日😀"' || chr(92) || chr(9) || chr(1) || '/' END AS t, l_partkey AS k FROM lineitem),
    b AS (SELECT l_orderkey, l_linenumber, '{{"items":[' || CAST(x AS VARCHAR) || ',' || CAST(q AS VARCHAR) || '],"key":' || k || ',"text":' || coalesce('"' || replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't'), chr(1), chr(92) || 'u0001') || '"', 'null') || '}}' AS body FROM l)
    SELECT l_orderkey, l_linenumber, body, sha256(body) AS digest FROM b""")
def canonical_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with exponents, negative zero, huge and tiny numbers, nulls, control characters and letters of any script."""
    key, price = F.col("l_partkey"), F.col("l_extendedprice")
    factor = F.element_at(F.array(*map(F.lit, [1e-11, 1e-7, 1e-5, 1e-3, 1.0, 1e5, 1e11, 1e12, 1e19, 1e297])), (key % 10 + 1).cast("int"))
    x = F.when(key % 9 == 0, -0.0).when(key % 9 == 1, 1e21).when(key % 9 == 2, price / 3).otherwise(price * factor)
    said = F.when(F.col("l_linenumber") % 3 != 0, F.concat("l_returnflag", F.lit(' «é日😀"\\\t\x01/')))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("text"), key.alias("key"), F.array(x, F.col("l_quantity").cast("double")).alias("items"))
    kept = ["text", "key", "items"]
    body = canonical.canonical(F.struct(*kept), StructType([rows.schema[c] for c in kept]))
    return rows.select("l_orderkey", "l_linenumber", body.alias("body")).withColumn("digest", F.sha2("body", 256))


@query("""SELECT p_brand, substr(sha256(string_agg(l, chr(10) ORDER BY l)), 1, 12) AS fingerprint FROM (SELECT DISTINCT p_brand, p_type || '=' || p_name AS l FROM part) GROUP BY 1""")
def policy_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.collect_set(F.concat("p_type", F.lit("="), "p_name"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(T.policy_fingerprint(lines).alias("fingerprint"))


@query("""WITH t AS (SELECT conv_id, role, trim(coalesce(text, ''), ' ') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS item, turn FROM conversations WHERE trim(coalesce(text, ''), ' ') <> ''),
    l AS (SELECT conv_id, role, item, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM t),
    k AS (SELECT *, min(item) OVER (PARTITION BY conv_id, role, trim(line, ' ')) AS seen FROM l),
    m AS (SELECT conv_id, role, min(turn) AS first, string_agg(line, chr(10) ORDER BY item, place) FILTER (item = 1 OR trim(line, ' ') <> '' AND item = seen) AS content FROM k GROUP BY 1, 2)
    SELECT conv_id, 'table' AS kind, role AS title, content, row_number() OVER (PARTITION BY conv_id ORDER BY first, role) AS rank FROM m""")
def sheet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as sheets: equal roles are one sheet."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("table").alias("kind"), F.col("role").alias("title"), T.text("text").alias("content"))
    return exports.merged_sheets(turns, "conv_id", "turn")


@query(r"""SELECT event_id, '{"props":' || replace(props, ' ', '') || ',"statement":"$\\frac{1}{2}$"}' AS items FROM events""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON in fences and with a LaTeX command: repaired, extracted, and its item list."""
    raw = F.concat(F.lit("```json\n{\"tasks\": [{\"statement\": \"$\\frac{1}{2}$\", \"props\": "), F.col("props"), F.lit("}]}\n```"))
    fixed = T.repaired_latex(raw)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.wrapped_items(T.json_object(fixed)), "\n").alias("items"))


@query(rf"""WITH a AS (SELECT conv_id, turn, regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(173), ''), '(?i)([а-яёa-z])[‐‑-]\n\s*([а-яёa-z])', '\1\2', 'g') AS t FROM conversations),
    b AS (SELECT conv_id, turn, list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(trim(x, ' '), '\d{{1,4}}')), lambda x: rtrim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')) AS l FROM a),
    c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM b)
    SELECT conv_id, count(*) AS n_pages, 'ok' AS state, string_agg('{readers.PAGE}' || (turn + 1) || chr(10) || chr(10) || t || chr(10) || chr(10) || '{readers.FIGURES}' || chr(10) || '{readers.WARNING}' || chr(10) || '- a figure', chr(10) || chr(10) ORDER BY turn) AS markdown FROM c GROUP BY 1""")
def page_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as page indexes in JSON, turned into Markdown."""
    page = F.struct((F.col("turn") + 1).alias("page"), F.concat(F.col("text"), F.lit("![x](y)")).alias("markdown"), F.array(F.struct(F.lit(" a  figure ").alias("ai_description"))).alias("figure_metadata"))
    indexes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("json"))
    return indexes.select("conv_id", readers.page_index(F.col("json")).alias("x")).select("conv_id", "x.*")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN format('{:,.2f} USD', c_acctbal) WHEN 1 THEN format('{:,.2f} CNY', c_acctbal) END AS balance FROM customer""")
def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts go into the answers with all their digits and the sign of a zero; they are rounded where they are shown."""
    shape = F.col("c_custkey") % 3
    amount = F.col("c_acctbal").cast("string")
    answer = F.when(shape == 0, F.concat(F.lit('{"balance":'), amount, F.lit("}"))).when(shape == 1, F.concat(F.lit('{"balance_infos":[{"currency":"CNY","total_balance":"'), amount, F.lit('"}]}')))
    return table(spark, sf_dir, "customer").select("c_custkey", T.balance(answer).alias("balance"))
