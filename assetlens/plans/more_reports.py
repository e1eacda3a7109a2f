"""Further reports: joins by key, histories, samples, sets, classification and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.operators import classify, integrate, ordered, resolve
from assetlens.registry import query
from assetlens.sources.tables import SECTIONS_SQL, offices, properties, sections, table


@query("""WITH v AS (SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ';' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS names, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS section_id, names, coalesce(n, 0) AS n FROM orders LEFT JOIN v ON l_orderkey = o_orderkey""")
def j5_sections_with_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("v")).alias("x"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), ";")
    found = lines.groupBy("section_id").agg(names.alias("names"), F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id")).join(found, "section_id", "left").fillna(0, ["n"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1))")
def j6_nested_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    declared = table(spark, sf_dir, "orders").join(rich, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(declared, "c_custkey", "left_semi")


@query(f"""WITH {SECTIONS_SQL}, m AS (SELECT rubric, year, round(avg(CAST(income AS DECIMAL(18, 2))), 2) AS v FROM sections WHERE year <> 1997 GROUP BY ALL), k AS (SELECT DISTINCT rubric, year FROM sections)
    SELECT k.rubric, k.year, round(coalesce(m.v, (a.v + b.v) / 2), 2) AS value FROM k LEFT JOIN m USING (rubric, year) LEFT JOIN m a ON a.rubric = k.rubric AND a.year = k.year - 1 LEFT JOIN m b ON b.rubric = k.rubric AND b.year = k.year + 1""")
def j19_nearest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir)
    means = rows.filter("year <> 1997").groupBy("rubric", "year").agg(F.round(F.avg(F.col("income").cast("decimal(18,2)")), 2).cast("double").alias("v"))
    near = lambda shift, name: means.select("rubric", (F.col("year") + shift).alias("year"), F.col("v").alias(name))
    found = rows.select("rubric", "year").distinct()
    for shift, name in ((0, "own"), (1, "before"), (-1, "after")):
        found = found.join(near(shift, name), ["rubric", "year"], "left")
    return found.select("rubric", "year", F.round(F.coalesce("own", (F.col("before") + F.col("after")) / 2), 2).alias("value"))


@query(f"""WITH {SECTIONS_SQL}, p AS (SELECT person_id AS old_id, section_id % 1000 AS new_id, count(*) AS n FROM sections GROUP BY ALL) SELECT old_id, arg_max(new_id, (n, -new_id)) AS new_id, max(n) AS n FROM p GROUP BY old_id""")
def j20_e9_person_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.most_shared(sections(spark, sf_dir).select(F.col("person_id").alias("old_id"), (F.col("section_id") % 1000).alias("new_id")), "old_id", "new_id")


@query("""WITH h AS (SELECT regexp_replace(regexp_extract(lower(url), '//([^/:?#]+)', 1), '^www\\.', '') AS host, page_id FROM pages) SELECT host, count(*) AS n, min(page_id) AS first FROM h GROUP BY host HAVING count(*) > 1""")
def j17_pages_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.functions import urls

    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY ALL HAVING max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 0")
def a28_sites_without_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(kinds.alias("kinds"), F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("good")).filter("good = 0").drop("good")


@query("SELECT lang, source, count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def a29_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").select("lang", "source", "n_chars").createOrReplaceTempView("_corpus")
    return spark.sql("SELECT lang, source, count(*) AS n, coalesce(sum(n_chars), 0) AS chars FROM _corpus GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")


@query("SELECT count(*) AS n, round(count(text) / count(*), 4) AS text_recall, round(count(*) FILTER (n_chars >= 1000) / count(*), 4) AS long_share, round(avg(n_chars), 4) AS mean FROM documents")
def a30_corpus_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf_dir, "documents").agg(n.alias("n"), F.round(F.count("text") / n, 4).alias("text_recall"), F.round(F.count_if(F.col("n_chars") >= 1000) / n, 4).alias("long_share"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("""WITH e AS (SELECT doc_id % 10 AS worker, quality, toxic FROM labels) SELECT worker, count(*) AS n, round(avg(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END), 4) AS error_rate FROM e GROUP BY worker""")
def a39_annotator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).otherwise(0)
    return table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 10).alias("worker")).agg(F.count("*").alias("n"), F.round(F.avg(wrong), 4).alias("error_rate"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-n, event_type)) AS kind, max(n) AS n FROM c GROUP BY user_id")
def a40_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("kind"), F.max("n").alias("n"))


@query("SELECT round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 4) AS mean, count(value) AS n, event_type FROM events GROUP BY event_type")
def a44_feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))


@query("""WITH r AS (SELECT n_regionkey AS region_id, c_mktsegment AS name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
    SELECT region_id, name, n FROM r QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY n DESC, name) <= 3 AND n >= 5""")
def o3_top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("office_id"), F.col("c_mktsegment").alias("name")).join(offices(spark, sf_dir), "office_id")
    counts = people.groupBy("region_id", "name").agg(F.count("*").alias("n"))
    return ordered.top_places(counts, ["region_id"], [F.col("n").desc(), F.col("name")], 3).filter("n >= 5").select("region_id", "name", "n")


@query("SELECT p_brand, arg_min(p_name, (length(p_name), p_name, p_partkey)) AS name FROM part GROUP BY p_brand")
def o10_stable_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("name"))


@query("SELECT o_orderkey, count(*) AS copies FROM orders, generate_series(1, 1 + o_orderkey % 3) GROUP BY o_orderkey")
def o12_repeated_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array_repeat(F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int"))))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("copies"))


@query("""WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag)) AS a, list_sort(list(DISTINCT l_linestatus)) AS b FROM lineitem GROUP BY l_orderkey)
    SELECT id, CAST(len(list_intersect(a, b)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either FROM s""")
def u2_u4_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return sets.select("id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE (least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) NOT IN (SELECT (least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey)) FROM lineitem WHERE l_quantity < 25)")
def u5_unused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = [F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")]
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*pair).distinct().join(rows.filter("l_quantity < 25").select(*pair), ["a", "b"], "left_anti")


@query("""WITH v AS (SELECT l_orderkey AS doc, l_extendedprice AS x FROM lineitem), m AS (SELECT doc, list_sort(list(x))[len(list(x)) // 2 + 1] AS middle, count(*) AS n FROM v GROUP BY doc)
    SELECT doc, middle, n > 3 AND middle > 10000 AS plain FROM m""")
def x27_thousands_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_extendedprice").alias("x"))
    lists = amounts.groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    middle = F.get("xs", F.floor(F.size("xs") / 2).cast("int"))
    return lists.select("doc", middle.alias("middle"), ((F.size("xs") > 3) & (middle > 10_000)).alias("plain"))


@query("""WITH v AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS label, p_name AS s FROM part), g AS (SELECT id, label, unnest(list_transform(generate_series(1, length(s)), lambda i: substring('^' || lower(s) || '$', CAST(i AS INTEGER), 3))) AS gram FROM v),
    c AS (SELECT label, gram, count(*) AS f FROM g WHERE id % 2 = 0 GROUP BY ALL), n AS (SELECT label, sum(f) AS n FROM c GROUP BY label), t AS (SELECT sum(n) AS t FROM n),
    s AS (SELECT g.id, n.label, round(sum(-ln((coalesce(f, 0) + 1e-9) / n.n)) - ln(any_value(n.n / t)), 6) AS cost FROM g CROSS JOIN n CROSS JOIN t LEFT JOIN c ON c.label = n.label AND c.gram = g.gram WHERE g.id % 2 = 1 GROUP BY g.id, n.label)
    SELECT id, arg_min(label, (cost, label)) AS label FROM s GROUP BY id""")
def x10_trigram_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), "p_name")
    counts = classify.trigram_counts(rows.filter("id % 2 = 0"), "label", "p_name")
    return classify.predicted(rows.filter("id % 2 = 1"), "id", "p_name", counts, "label").select("id", "label")


@query(f"""WITH {SECTIONS_SQL}, a AS (SELECT person_id, year, list_sort(list(DISTINCT rubric || status)) AS s, max(income) AS m FROM sections GROUP BY ALL)
    SELECT a.person_id, a.year, round(least(a.m, b.m) / (greatest(a.m, b.m) + 1e-9), 6) AS income_ratio, round(len(list_intersect(a.s, b.s)) / (len(list_distinct(list_concat(a.s, b.s))) + 1e-9), 6) AS shared FROM a JOIN a b ON a.person_id = b.person_id AND b.year = a.year + 1""")
def m1_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sections(spark, sf_dir).groupBy("person_id", "year").agg(F.collect_set(F.concat("rubric", "status")).alias("s"), F.max("income").alias("m"))
    other = own.select("person_id", (F.col("year") - 1).alias("year"), F.col("s").alias("s2"), F.col("m").alias("m2"))
    return own.join(other, ["person_id", "year"]).select("person_id", "year", F.round(resolve.ratio(F.col("m"), F.col("m2")), 6).alias("income_ratio"), F.round(resolve.shared(F.col("s"), F.col("s2")), 6).alias("shared"))


@query(f"""WITH {SECTIONS_SQL} SELECT person_id, count(*) FILTER (status = 'P') AS persons, CASE count(*) FILTER (status = 'P') WHEN 0 THEN 'new' WHEN 1 THEN 'reuse' ELSE 'conflict' END AS rule, arg_max(person_name || section_id, (length(person_name || section_id), section_id)) AS name FROM sections GROUP BY person_id""")
def e6_write_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir).withColumn("_name", F.concat("person_name", F.col("section_id").cast("string")))
    n = F.count_if(F.col("status") == "P")
    return rows.groupBy("person_id").agg(n.alias("persons"), F.when(n == 0, "new").when(n == 1, "reuse").otherwise("conflict").alias("rule"), F.max_by("_name", F.struct(F.length("_name"), "section_id")).alias("name"))


@query("SELECT round(1 - count(*) FILTER (o.o_orderkey IS NULL) / count(*), 4) AS kept, count(*) >= 1 AND 1 - count(*) FILTER (o.o_orderkey IS NULL) / count(*) >= 0.95 AS passes FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN orders o ON o_orderkey = l_orderkey")
def e10_permanence(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    joined = old.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("here")), "id", "left")
    kept = 1 - F.count_if(F.col("here").isNull()) / F.count("*")
    return joined.agg(F.round(kept, 4).alias("kept"), ((F.count("*") >= 1) & (kept >= 0.95)).alias("passes"))


@query(f"WITH {SECTIONS_SQL} SELECT section_id, CASE WHEN rubric = 'MACHINERY' AND status = 'F' THEN 'EDUCATION' ELSE rubric END AS rubric FROM sections")
def f3_rubric_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when((F.col("rubric") == "MACHINERY") & (F.col("status") == "F"), "EDUCATION").otherwise(F.col("rubric"))
    return sections(spark, sf_dir).select("section_id", changed.alias("rubric"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events WHERE props IS NOT NULL")
def f1_json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("bigint").alias("n"))


@query("""SELECT l_orderkey AS section_id, l_linenumber AS number, concat_ws(';', CASE WHEN l_quantity <= 0 THEN 'square' END, CASE WHEN l_discount > 0.09 THEN 'share' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'own_type' END) AS messages FROM lineitem WHERE l_quantity <= 0 OR l_discount > 0.09 OR l_returnflag NOT IN ('A', 'N')""")
def k2_constraint_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"square": F.col("l_quantity") <= 0, "share": F.col("l_discount") > 0.09, "own_type": ~F.col("l_returnflag").isin("A", "N")}
    messages = F.concat_ws(";", *(F.when(c, name) for name, c in rules.items()))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("number"), messages.alias("messages")).filter("messages <> ''")


@query()
def o6_stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: a tenth of the rows by a hash of the key, so that reruns agree."""
    return table(spark, sf_dir, "orders").filter(F.pmod(F.xxhash64("o_orderkey", F.lit(1)), F.lit(10)) == 0)


@query("""WITH c AS (SELECT c_name, count(*) AS n FROM customer GROUP BY c_name), u AS (SELECT *, (sum(n) OVER (ORDER BY c_name) - n) // 500 AS k FROM c)
    SELECT min(c_name) AS low, max(c_name) AS high, CAST(sum(n) AS BIGINT) AS rows FROM u GROUP BY k""")
def w8_balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.key_ranges(table(spark, sf_dir, "customer").groupBy("c_name").agg(F.count("*").alias("n")), "c_name", "n", 500)


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def w12_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    last = rows.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    return rows.join(F.broadcast(last)).filter("ts > since").select("event_id")


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS upto, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total FROM orders")
def w10_cumulative_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, own = F.col("o_totalprice").cast("decimal(18,2)"), Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum(price).over(own.orderBy("o_orderkey")).cast("double").alias("upto"), F.sum(price).over(own).cast("double").alias("total"))
