"""Queries on merging, keys, graphs, texts and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.functions import urls as U
from assetlens.operators import graph, integrate, ordered
from assetlens.registry import query
from assetlens.sources.tables import table


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
    a AS (SELECT o_custkey, year, o_orderpriority, min(o_orderkey) AS v FROM r GROUP BY ALL HAVING count(*) = 1),
    b AS (SELECT o_custkey, year, min(o_orderkey) AS v FROM r GROUP BY ALL HAVING count(*) = 1)
    SELECT r.o_orderkey, coalesce(a.v, b.v) AS target FROM r LEFT JOIN a USING (o_custkey, year, o_orderpriority) LEFT JOIN b ON b.o_custkey = r.o_custkey AND b.year = r.year""")
def j11_two_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    targets = rows.withColumnRenamed("o_orderkey", "target")
    return integrate.two_key_match(rows, targets, ["o_custkey", "year", "o_orderpriority"], ["o_custkey", "year"], "target").select("o_orderkey", "target")


@query("""WITH k AS (SELECT l_orderkey AS id, l_suppkey AS v, 0 AS level, concat_ws(';', l_partkey, l_returnflag, l_linestatus) AS key FROM lineitem UNION ALL
        SELECT l_orderkey, l_suppkey, 1, concat_ws(';', l_partkey, l_returnflag) FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, 2, CAST(l_partkey AS VARCHAR) FROM lineitem),
    u AS (SELECT level, key, min(v) AS v FROM k GROUP BY ALL HAVING count(DISTINCT v) = 1)
    SELECT k.id, arg_min(u.v, (level, u.v)) AS supplier, CAST(min(level) AS INTEGER) AS level FROM k JOIN u USING (level, key) GROUP BY k.id""")
def j12_variant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("supplier"), "l_partkey", "l_returnflag", "l_linestatus")
    part = F.col("l_partkey").cast("string")
    return integrate.variant_match(rows, rows, [F.concat_ws(";", part, "l_returnflag", "l_linestatus"), F.concat_ws(";", part, "l_returnflag"), part], "id", "supplier")


@query("""WITH r AS (SELECT sha256(coalesce(text, '')) AS sha256, 1 AS s, source AS ref FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT sha256(coalesce(text, '')), 2, source FROM documents WHERE doc_id % 2 = 1)
    SELECT sha256, array_to_string(list_sort(list(DISTINCT ref) FILTER (ref IS NOT NULL)), ',') AS refs, CAST(bit_or(s) AS INTEGER) AS sets FROM r GROUP BY sha256""")
def j13_merge_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("source").alias("ref"))
    merged = integrate.merged_documents(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"))
    return merged.select("sha256", F.array_join("refs", ",").alias("refs"), "sets")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')""")
def j7_persons_without_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""WITH c AS (SELECT o_custkey, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_custkey, arg_max(l_suppkey, (n, -l_suppkey)) AS l_suppkey, max(n) AS n FROM c GROUP BY o_custkey""")
def a12_most_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return integrate.most_shared(pairs, "o_custkey", "l_suppkey")


@query("""WITH o AS (SELECT o_orderkey, concat_ws(';', o_custkey, CAST(year(o_orderdate) AS INTEGER), o_orderstatus) AS passport FROM orders)
    SELECT passport, min(o_orderkey) AS o_orderkey FROM o GROUP BY passport""")
def w16_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", integrate.passport(F.col("o_custkey"), F.year("o_orderdate"), F.col("o_orderstatus")).alias("passport"))
    return integrate.first_seen(rows, "passport", [F.col("o_orderkey")])


@query("""WITH n AS (SELECT o_orderkey, o_custkey, CAST(o_custkey AS VARCHAR) || ';' || o_orderpriority AS p FROM orders), o AS (SELECT o_orderkey AS id, p FROM n WHERE o_orderkey % 3 = 0),
    k AS (SELECT n.o_orderkey, coalesce(a.id, b.id) AS id FROM n LEFT JOIN o a ON a.id = n.o_orderkey LEFT JOIN (SELECT p, min(id) AS id FROM o GROUP BY p) b ON b.p = n.p)
    SELECT o_orderkey, id FROM k WHERE id IS NOT NULL UNION ALL SELECT o_orderkey, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY o_orderkey) FROM k WHERE id IS NULL""")
def e8_surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("key1"), F.concat_ws(";", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key2"))
    old = rows.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), "key1", "key2")
    return integrate.surrogate_keys(rows, old, "key1", "key2", "o_orderkey").select("o_orderkey", "id")


@query("""WITH a AS (SELECT doc_id % 50 AS task, quality AS answer FROM labels WHERE quality IS NOT NULL), c AS (SELECT task, answer, count(*) AS n FROM a GROUP BY ALL),
    m AS (SELECT task, max(n) AS n, count(*) AS kinds FROM c GROUP BY task)
    SELECT m.task, CASE WHEN (SELECT count(*) FROM c WHERE c.task = m.task AND c.n = m.n) = 1 THEN (SELECT max(answer) FROM c WHERE c.task = m.task AND c.n = m.n) END AS majority, kinds = 1 AS unanimous FROM m""")
def a38_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "labels").filter("quality is not null").select((F.col("doc_id") % 50).alias("task"), F.col("quality").alias("answer"))
    return integrate.voted(answers, "task", "answer")


@query("""WITH g AS (SELECT least(n_nationkey, n_regionkey) AS a, greatest(n_nationkey, n_regionkey) AS b, bool_or(n_nationkey % 2 = 0) AS yes FROM nation GROUP BY ALL), f AS (SELECT DISTINCT least(n_nationkey, n_regionkey) AS a, greatest(n_nationkey, n_regionkey) AS b FROM nation WHERE n_nationkey % 3 = 0),
    c AS (SELECT count(*) FILTER (yes AND f.a IS NOT NULL) AS tp, count(*) FILTER (NOT yes AND f.a IS NOT NULL) AS fp, count(*) FILTER (yes AND f.a IS NULL) AS fn FROM g LEFT JOIN f USING (a, b))
    SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1 FROM c""")
def q2_pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    gold = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), (F.col("n_nationkey") % 2 == 0).alias("yes"))
    return integrate.pair_quality(gold, n.filter("n_nationkey % 3 = 0").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b")))


@query("""WITH g AS (SELECT l_orderkey AS doc, l_returnflag AS f, count(*) AS g FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey AS doc, l_linestatus AS f, count(*) AS t FROM lineitem GROUP BY ALL),
    b AS (SELECT doc, f, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM g FULL JOIN t USING (doc, f)), s AS (SELECT doc, sum(least(g, t)) AS tp, sum(greatest(t - g, 0)) AS fp, sum(greatest(g - t, 0)) AS fn FROM b GROUP BY doc)
    SELECT doc, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2 * tp / (2 * tp + fp + fn), 4) AS f_score FROM s""")
def q1_declaration_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return integrate.bag_match(rows.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("f")), rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linestatus").alias("f")), "doc", "f")


@query("""WITH s AS (SELECT o_orderkey % 20 AS score, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders), b AS (SELECT score, count(*) AS n, sum(y) AS yes FROM s GROUP BY score)
    SELECT score, round(sum(yes) OVER w / sum(n) OVER w, 4) AS precision, round(sum(yes) OVER w / sum(yes) OVER (), 4) AS recall FROM b WINDOW w AS (ORDER BY score DESC)""")
def m3_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 20).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return integrate.precision_recall(rows, "score", "y")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey + 1000000000000 AS b FROM orders UNION ALL SELECT DISTINCT l_suppkey + 2000000000000, l_partkey + 3000000000000 FROM lineitem),
    n AS (SELECT a AS id FROM e UNION SELECT b FROM e UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey + 2000000000000 FROM supplier UNION SELECT p_partkey + 3000000000000 FROM part),
    both_ways AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION ALL SELECT b, a FROM e WHERE a IS NOT NULL),
    r(id, cluster, going) AS (SELECT id, id, true FROM n WHERE id IS NOT NULL UNION ALL SELECT id, min(cluster), bool_or(min(cluster) < max(own)) OVER ()
        FROM (SELECT id, cluster, cluster AS own FROM r WHERE going UNION ALL SELECT w.b, cluster, NULL FROM r JOIN both_ways w ON w.a = r.id WHERE going) GROUP BY id)
    SELECT id, min(cluster) AS cluster FROM r GROUP BY id""")
def e3_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with all of their sections, suppliers with all of their parts and what hangs together over them, by all links of orders
    and lineitem; those without links included. Ids of the four kinds don't meet, and a null is no node."""

    def kind(column: str, k: int = 0) -> Column:
        return F.col(column) + F.lit(k * 1_000_000_000_000)

    links = table(spark, sf_dir, "orders").select(kind("o_custkey").alias("a"), kind("o_orderkey", 1).alias("b"))
    links = links.union(table(spark, sf_dir, "lineitem").select(kind("l_suppkey", 2), kind("l_partkey", 3)))
    own = [table(spark, sf_dir, t).select(kind(f"{t[0]}_{key}", k).alias("id")) for t, key, k in (("customer", "custkey", 0), ("supplier", "suppkey", 2), ("part", "partkey", 3))]
    nodes = reduce(DataFrame.union, [*own, links.select("a"), links.select("b")]).dropna().distinct()
    return graph.connected(nodes, links)


@query()
def e3_all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over all links and all suppliers and parts, those without links included. SQL would list all reachable pairs."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000_000_000).alias("b")).dropna()
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).union(table(spark, sf_dir, "part").select(F.col("p_partkey") + 1_000_000_000_000)).dropna()
    return graph.connected(own.union(links.select("a")).union(links.select("b")).distinct(), links)


@query("""WITH RECURSIVE t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey // 2 END AS up FROM supplier),
    r(id, top_id, d) AS (SELECT id, id, 0 FROM t UNION ALL SELECT r.id, up, d + 1 FROM r JOIN t ON t.id = r.top_id WHERE up IN (SELECT s_suppkey FROM supplier))
    SELECT id, arg_max(top_id, d) AS top_id FROM r GROUP BY id""")
def e11_top_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 2).cast("bigint").alias("parent_id"))
    return graph.top_parents(tree, F.col("id") % 4 == 0)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000000 AS dst FROM lineitem UNION SELECT DISTINCT l_partkey + 1000000000000, l_suppkey FROM lineitem),
    r0 AS (SELECT min(s_suppkey) AS id, [min(s_suppkey)] AS path FROM supplier),
    r1 AS (SELECT dst AS id, min(list_append(path, dst)) AS path FROM r0 JOIN e ON src = id GROUP BY dst),
    r2 AS (SELECT dst AS id, min(list_append(path, dst)) AS path FROM r1 JOIN e ON src = id WHERE dst NOT IN (SELECT id FROM r0) GROUP BY dst),
    r3 AS (SELECT dst AS id, min(list_append(path, dst)) AS path FROM r2 JOIN e ON src = id WHERE dst NOT IN (SELECT id FROM r1) GROUP BY dst)
    SELECT id, 0 AS depth, path FROM r0 UNION ALL SELECT id, 1, path FROM r1 UNION ALL SELECT id, 2, path FROM r2 UNION ALL SELECT id, 3, path FROM r3""")
def g5_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first supplier over parts to other suppliers, three steps at most."""
    to = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000_000).alias("dst"))
    edges = to.unionByName(to.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.shortest_paths(edges, table(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("id")), most=3)


@query(r"""SELECT lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '^[wW]{3}\.', ''), '/+$', '')) AS mirror,
    arg_max(url, (length(url), url)) AS url, max(length(html)) AS weight, count(*) AS n FROM pages GROUP BY 1""")
def g1_url_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", F.length("html").cast("bigint").alias("size"))
    return graph.merged_mirrors(pages, U.mirror_key(F.col("url")), "url", "size")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)', 1), '^www\.', '') AS host,
    regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(?:[a-zA-Z][\w+.\-]*:)?//[^/]*(/.*)$', 1) AS path,
    regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(?:[a-zA-Z][\w+.\-]*:)?//[^/]*/(?:.*/)?([^/]*)$', 1) AS file FROM pages""")
def c39_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.host(u).alias("host"), U.path(u).alias("path"), U.file_name(u).alias("file"))


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS clean, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS sha256 FROM documents")
def c1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.one_space(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"), F.sha2(clean, 256).alias("sha256"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '')) AS w FROM documents)
    SELECT substring(w, 1, 4) AS stem, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w WHERE NOT regexp_full_match(w, '\\d+') GROUP BY 1""")
def c9_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.stems(F.regexp_replace("text", r"(?<![\p{L}\p{Nd}])\p{Nd}+(?![\p{L}\p{Nd}])", " "))).alias("stem"))
    return words.groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 100 BETWEEN 11 AND 14 THEN 5 WHEN c_custkey % 10 = 1 THEN 1 WHEN c_custkey % 10 BETWEEN 2 AND 4 THEN 2 ELSE 5 END AS INTEGER) AS form FROM customer")
def c7_numeral_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.numeral_group(F.col("c_custkey")).alias("form"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 5 THEN 1 ELSE 2 END AS INTEGER) AS year FROM orders")
def c37_last_declaration_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.last_declaration_year(F.col("o_orderdate")).alias("year"))


@query("""SELECT page_id, CAST((row_number() OVER (ORDER BY page_id) - 1) // 49 AS BIGINT) AS chunk, CAST((row_number() OVER (ORDER BY page_id) - 1) % 49 AS BIGINT) AS place FROM pages""")
def k9_sitemap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.chunked(table(spark, sf_dir, "pages").select("page_id"), "page_id", 49)


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, value FROM events), h AS (SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, max(ts) AS last FROM e GROUP BY user_id)
    SELECT user_id, calls, failures, round(failures / calls, 4) AS error_rate, CAST(floor(epoch(last)) AS BIGINT) AS last FROM h""")
def a27_host_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last"))
    return calls.select("user_id", "calls", "failures", F.round(F.col("failures") / F.col("calls"), 4).alias("error_rate"), F.unix_timestamp("last").alias("last"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour FROM events""")
def w13_request_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.rates(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", day=86_400, hour=3_600).select("event_id", "day", "hour")


@query("""WITH e AS (SELECT user_id, event_id, ts, value, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, event_id, value FROM r QUALIFY k = max(k) OVER (PARTITION BY user_id)""")
def w11_last_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.last_round(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("user_id", "event_id", "value")


@query("""SELECT user_id, event_id, round(sum(value) OVER w, 4) AS total, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_purchase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w9_w14_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("ts"), F.col("event_id")]
    rows = table(spark, sf_dir, "events").withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    rows = ordered.running(rows, ["user_id"], order, total="value")
    return ordered.carried_forward(rows, ["user_id"], order, "purchase", "last_purchase").select("user_id", "event_id", F.round("total", 4).alias("total"), "last_purchase")


@query("""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
    p AS (SELECT unnest(ws) AS a, unnest(list_append(ws[2:], NULL)) AS b FROM w WHERE len(ws) > 0), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b), u AS (SELECT a AS w, sum(n) AS n FROM c GROUP BY a)
    SELECT c.a || '_' || c.b AS bigram, c.n AS n, CAST(trunc(1e6 * c.n * ln(c.n / (CAST(x.n AS DOUBLE) * y.n))) AS BIGINT) AS information FROM c JOIN u x ON x.w = c.a JOIN u y ON y.w = c.b WHERE c.b IS NOT NULL AND c.n >= 5""")
def a37_bigram_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with the next one, counted once; a word's own count is the sum over what follows it (nothing, at a text's end)."""
    ws = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    words = table(spark, sf_dir, "documents").filter("text is not null").select(ws.alias("ws")).filter(F.size("ws") > 0)
    following = F.concat(F.slice("ws", 2, F.size("ws")), F.array(F.lit(None).cast("string")))
    pairs = words.select(F.explode(F.arrays_zip(F.col("ws").alias("a"), following.alias("b"))).alias("p"))
    counts = graph.cut(pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")))
    single = counts.groupBy("a").agg(F.sum("n").alias("f"))
    often = counts.filter("b is not null and n >= 5").join(single.withColumnRenamed("f", "f1"), "a").join(single.select(F.col("a").alias("b"), F.col("f").alias("f2")), "b")
    return often.select(F.concat_ws("_", "a", "b").alias("bigram"), "n", (F.lit(1e6) * F.col("n") * F.log(F.col("n") / (F.col("f1").cast("double") * F.col("f2")))).cast("bigint").alias("information"))
