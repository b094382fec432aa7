"""Scans, predicates, joins, latest-per-key and comparison plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import admission, relational as R
from gleaner.streaming import work

from .registry import query, table


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_prune_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") == 77).select("o_orderkey", "o_custkey", "o_totalprice").limit(2)


@query("SELECT doc_id, lang, 'some' AS asked FROM documents WHERE lang IN ('de', 'fr') UNION ALL SELECT doc_id, lang, 'all' FROM documents")
def in_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    asked = {"some": ["de", "fr"], "none": [], "all": None}
    parts = [docs.filter(R.in_list(F.col("lang"), allowed)).withColumn("asked", F.lit(name)) for name, allowed in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id, coalesce(l.toxic = 1, false) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def null_safe_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", R.is_true(F.col("toxic") == 1).alias("toxic"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang <> 'en' AND n_chars >= 200")
def conditional_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"min_chars": 200, "source": None}
    where = R.all_of(F.col("lang") != "en", F.col("n_chars") >= asked["min_chars"] if asked["min_chars"] else None, F.col("source") == asked["source"] if asked["source"] else None)
    return table(spark, sf_dir, "documents").filter(where).select("doc_id", "lang", "source")


@query("SELECT c_custkey, c_name, least(50, greatest(1, CAST(c_custkey % 120 AS INT) - 10)) AS page_limit FROM customer WHERE contains(lower(c_name), '#0000000') OR contains(lower(c_mktsegment), 'auto')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    hit = R.contains_any("#0000000", F.col("c_name")) | R.contains_any("AUTO", F.col("c_mktsegment"))
    return customers.filter(hit).select("c_custkey", "c_name", R.clamp((F.col("c_custkey") % 120).cast("int") - 10, 1, 50).alias("page_limit"))


@query("""SELECT p_partkey, p_brand, CASE WHEN lower(p_brand) IN ('brand#3', 'brand#7') THEN 'advisory'
    WHEN lower(p_brand) IN ('brand#1', 'brand#2', 'brand#3') THEN 'decision' ELSE 'unlisted' END AS model_use,
    regexp_matches(lower(p_name), '(^|[^a-z])(small|red|mini)([^a-z]|$)') AS known_advisory FROM part""")
def model_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = admission.model_use(F.col("p_brand"), ["brand#1", "brand#2", "brand#3"], ["brand#3", "brand#7"])
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", use.alias("model_use"), F.lower("p_name").rlike("(^|[^a-z])(small|red|mini)([^a-z]|$)").alias("known_advisory"))


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_regionkey IN (1, 2)")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    nations = table(spark, sf_dir, "nation").filter(F.col("n_regionkey").isin(1, 2))
    joined = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "c_name", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_delete_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT s_suppkey, s_nationkey, coalesce(n_name, '') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON s_nationkey = n_nationkey")
def lookup_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return R.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey", "n_name")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n_orders FROM customer")
def counts_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "n_orders")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(known, "item_id", "left_anti")


@query("""WITH best AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20)
    SELECT rank, o_orderkey, c_name FROM best JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def rank_preserving_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_custkey", "o_totalprice")
    best = R.recent(top.withColumn("all", F.lit(1)), ["all"], 20, F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return best.join(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("rank", "o_orderkey", "c_name")


@query("""SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders FROM customer""")
def parent_children_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    out = R.nested(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderkey", "o_orderstatus"], "orders")
    return out.select("c_custkey", F.coalesce(F.array_join(F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"], o["o_orderstatus"])), ","), F.lit("")).alias("orders"))


@query("""WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS title FROM part), h AS (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' — ' || p_type ELSE '' END AS heading FROM part)
    SELECT p_partkey, heading, title FROM h JOIN t ON heading = title OR starts_with(heading, title || ' ')""")
def prefix_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix is the heading's first word, so the theta condition is an equality and needs no nested loop."""
    part = table(spark, sf_dir, "part")
    titles = part.select(F.split("p_name", " ")[0].alias("title")).distinct()
    heading = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" — "), F.col("p_type"))).otherwise(""))
    headings = part.select("p_partkey", heading.alias("heading")).withColumn("title", F.split("heading", " ")[0])
    return headings.join(titles, "title").select("p_partkey", "heading", "title")


@query("""SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1""")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ambiguous_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("""SELECT doc_id AS key, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def closure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, t).select(F.col("doc_id").alias("key")) for t in ("documents", "labels"))
    return R.unmatched(a, b, "key")


@query("""WITH w AS (SELECT DISTINCT source, lang FROM documents), f AS (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars > 2000 GROUP BY 1, 2)
    SELECT w.source, w.lang, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS state FROM w LEFT JOIN f ON w.source IS NOT DISTINCT FROM f.source AND w.lang IS NOT DISTINCT FROM f.lang""")
def exactly_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    out = R.exactly_one(docs.select("source", "lang").distinct(), docs.filter("n_chars > 2000"), ["source", "lang"])
    return out.select(F.nullif("source", F.lit("")).alias("source"), F.nullif("lang", F.lit("")).alias("lang"), "n", "state")


@query("""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) - 1 AS n_siblings FROM conversations""")
def sibling_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    counts = turns.groupBy("conv_id").agg((F.count("*") - 1).alias("n_siblings"))
    return turns.join(counts, "conv_id")


@query("""WITH f AS (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY 1)
    SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) a ON s_nationkey = n_nationkey LEFT JOIN f b ON b.n_regionkey = s_suppkey % 5""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    own = nations.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("own"))
    first = nations.groupBy((F.col("n_regionkey").cast("long")).alias("r")).agg(F.min("n_name").alias("fallback"))
    rows = table(spark, sf_dir, "supplier").withColumn("r", F.col("s_suppkey") % 5)
    return rows.join(own, "s_nationkey", "left").join(first, "r", "left").select("s_suppkey", F.coalesce("own", "fallback").alias("name"))


@query("""SELECT r_regionkey, count(n_nationkey) FILTER (n_name LIKE '%1%') AS n, CASE count(n_nationkey) FILTER (n_name LIKE '%1%') WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS state
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def nested_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    parents = R.nested(table(spark, sf_dir, "region").select("r_regionkey"), nations, "r_regionkey", ["n_name"], "nations")
    children = parents.select("r_regionkey", F.explode("nations.n_name").alias("n_name")).filter(F.col("n_name").like("%1%"))
    return R.exactly_one(parents.select("r_regionkey"), children, ["r_regionkey"])


@query("""SELECT l.doc_id, l.quality = 1 AND d.n_chars > 100 AS enabled, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN NOT (l.quality = 1) THEN 'model_disabled' WHEN NOT (d.n_chars > 100) THEN 'provider_disabled' END AS violation
    FROM labels l LEFT JOIN documents d USING (doc_id)""")
def resolve_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(True).alias("there"))
    model, provider = F.col("quality") == 1, F.col("n_chars") > 100
    violation = F.when(F.col("there").isNull(), "missing").when(~model, "model_disabled").when(~provider, "provider_disabled")
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").select("doc_id", (model & provider).alias("enabled"), violation.alias("violation"))


@query("""WITH s AS (SELECT conv_id, list_sort(list(turn * 10)) AS slugs FROM conversations GROUP BY 1), e AS (SELECT conv_id, unnest(slugs) AS slug, generate_subscripts(slugs, 1) AS pos FROM s)
    SELECT conv_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) - count(doc_id) AS unknown FROM e LEFT JOIN documents ON doc_id = slug GROUP BY 1""")
def slug_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn") * 10)).alias("slugs"))
    rows = slugs.select("conv_id", F.posexplode("slugs").alias("pos", "slug")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), F.col("doc_id").alias("id")), "slug", "left")
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"].cast("string"))
    return rows.groupBy("conv_id").agg(F.nullif(F.array_join(ids, ","), F.lit("")).alias("ids"), F.count_if(F.col("id").isNull()).alias("unknown"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(lang) AS with_lang, count(*) FILTER (n_chars > 1000) AS long_texts, count(*) FILTER (contains(text, '|')) AS with_pipe FROM documents")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count_if(F.col("n_chars") > 1000).alias("long_texts"), F.count_if(F.contains("text", F.lit("|"))).alias("with_pipe"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY 1, 2""")
def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, failed = (F.count_if(F.col("event_type") == x) for x in ("purchase", "error"))
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(done.alias("done"), failed.alias("failed"), F.count("*").alias("total"))


@query("""SELECT event_id, user_id, row_number() OVER w AS done, count(*) FILTER (event_type = 'error') OVER (w ROWS UNBOUNDED PRECEDING) AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    sums = {"done": F.lit(1), "failed": F.when(F.col("event_type") == "error", 1).otherwise(0)}
    return R.running(events, ["user_id"], ["ts", "event_id"], sums).select("event_id", "user_id", "done", "failed")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return R.latest(active, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY 1")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 8")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent(table(spark, sf_dir, "orders"), ["o_custkey"], 8, F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 3, 10, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10 OFFSET (SELECT (least(5000, greatest(1, ceil(count(*) / 10))) - 1) * 10 FROM lineitem)::BIGINT")
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 5,000, or the last one if there are fewer."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return R.OrderedPages(rows, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")).page(5000, 10)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS ordinal FROM orders ORDER BY ordinal, o_orderkey LIMIT 100")
def attention_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordinal = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select("o_orderkey", ordinal.alias("ordinal")).orderBy("ordinal", "o_orderkey").limit(100)


@query("SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS active FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey DESC) = 1")
def prefer_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.col("o_orderstatus") == "F"
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct(active.alias("active"), "o_orderkey")).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", "b.active")


@query("SELECT user_id, event_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) > 30 AS expired FROM events")
def keep_last_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.operators.exports import retention

    objects = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("key"), "ts")
    return retention(objects, "user_id", [F.col("ts").desc(), F.col("key")]).select("user_id", "key", "expired")


@query("""SELECT user_id, event_id, event_type = 'signup' AND row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'signup', ts DESC, event_id) = 1 AS active FROM events""")
def winner_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return R.one_hot(events, ["user_id"], F.col("event_type") == "signup", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), F.col("event_id").alias("e")).select("user_id", "event_id", "active")


@query("""WITH a AS (SELECT p_partkey AS key, p_name, p_size FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS key, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'create' WHEN b.key IS NULL THEN 'delete' WHEN a.p_name IS NOT DISTINCT FROM b.p_name AND a.p_size IS NOT DISTINCT FROM b.p_size THEN 'keep' ELSE 'update' END AS action
    FROM a FULL JOIN b ON a.key = b.key""")
def desired_state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_size")
    desired = part.filter("key % 11 <> 0").withColumn("p_size", F.when(F.col("key") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return R.changes(part.filter("key % 10 <> 0"), desired, "key", ["p_name", "p_size"])


@query("SELECT p_partkey AS key, 'keep' AS action FROM part")
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the desired rows are written over the current ones, the comparison finds nothing to do."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_size")
    current = R.upsert(part.withColumn("p_size", F.col("p_size") + 1).filter("key % 3 = 0"), part, ["key"])
    return R.changes(current, part, "key", ["p_name", "p_size"])


@query("SELECT user_id AS key, arg_min(event_type, (ts, event_id)) AS event_type, min(ts) AS ts FROM events GROUP BY 1")
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type")
    return R.first_of_key(events, "key", ["ts", "event_id", "event_type"]).select("key", "event_type", "ts")


@query("""SELECT coalesce(a.k, b.k) AS o_orderstatus, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, a.n IS NOT DISTINCT FROM b.n AS equal FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 OR o_orderstatus <> 'P' GROUP BY 1) b ON a.k = b.k""")
def copy_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return R.same_counts(orders, orders.filter("o_orderkey % 10 <> 3 OR o_orderstatus <> 'P'"), "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status FROM orders")
def interrupted_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return table(spark, sf_dir, "orders").select("o_orderkey", admission.interrupted(status).alias("status"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type IN ('click', 'purchase')),
    n AS (SELECT *, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS next_ts, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS INT) AS attempt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type, event_id))
    SELECT user_id, attempt, ts AS started, CASE WHEN next_type = 'purchase' AND next_ts <= ts + INTERVAL 6 HOUR THEN 'committed' WHEN attempt < 3 THEN 'retry' ELSE 'failed' END AS state FROM n WHERE event_type = 'click'""")
def work_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks start work, purchases commit it: what each attempt came to, six hours being the limit. The stream of the same rule is tested against this."""
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "commit")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")).filter("kind IS NOT NULL")
    out = work.outcomes(events, 6 * 3600)
    return out.select(F.col("job").alias("user_id"), "attempt", F.col("started").cast("timestamp_ntz").alias("started"), "state")
