"""Queries on profiles of groups and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions import urls
from assetlens.operators import ordered, profiles, statistics
from assetlens.registry import query
from assetlens.sources.tables import SECTIONS_SQL, sections, table

_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


@query(f"SELECT {_FIRST} AS name, count(DISTINCT {_SECOND}) AS partners, count(*) AS n FROM part GROUP BY 1")
def a15_partners_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").select(F.get(words, F.lit(0)).alias("name"), F.get(words, F.lit(1)).alias("surname"))
    return profiles.distinct_partners(parts, "name", "surname")


@query("""WITH s AS (SELECT user_id, CAST(floor(100 * count(*) FILTER (event_type = 'purchase') / count(*)) AS BIGINT) AS share, count(*) AS n FROM events GROUP BY 1)
    SELECT *, CASE WHEN share > 30 THEN 1 WHEN share < 15 THEN 0 END AS class FROM s""")
def a16_class_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.class_by_share(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", 30, 15)


@query(f"""WITH {SECTIONS_SQL}, t AS (SELECT count(*) FILTER (year = 1995) AS ta, count(*) FILTER (year = 1997) AS tb FROM sections),
    c AS (SELECT person_name, round(100.0 * count(*) FILTER (year = 1995) / nullif(any_value(ta), 0), 4) AS before, round(100.0 * count(*) FILTER (year = 1997) / nullif(any_value(tb), 0), 4) AS after FROM sections, t WHERE year IN (1995, 1997) GROUP BY 1)
    SELECT *, round(after - before, 4) AS change FROM c""")
def a25_popularity_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.popularity_change(sections(spark, sf_dir), "person_name", "year", 1995, 1997)


@query("""WITH b AS (SELECT *, lag(l_returnflag) OVER w AS prev, row_number() OVER w AS i FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)),
    r AS (SELECT *, sum(CASE WHEN l_returnflag IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT l_orderkey, CAST(run AS BIGINT) AS run, l_returnflag, sum(l_quantity) AS total, count(*) AS n FROM r GROUP BY ALL""")
def a35_run_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return profiles.run_sums(lines, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")], "l_returnflag", "l_quantity")


@query(r"""SELECT md5(html) AS hash, min(page_id) AS first, array_to_string(list_sort(list(DISTINCT regexp_replace(regexp_extract(lower(url), '//([^/:?#]+)', 1), '^www\.', ''))), ',') AS domains, count(*) AS n FROM pages WHERE html IS NOT NULL GROUP BY 1""")
def a41_domains_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter("html is not null").select(F.md5("html").alias("hash"), "page_id", urls.host(F.col("url")).alias("host"))
    return pages.groupBy("hash").agg(F.min("page_id").alias("first"), F.array_join(F.array_sort(F.collect_set("host")), ",").alias("domains"), F.count("*").alias("n"))


@query("""WITH q AS (SELECT c_nationkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, median(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_nationkey AS office_id, CAST(y AS INTEGER) AS year, CAST(trunc(avg(m)) AS BIGINT) AS average FROM q GROUP BY ALL""")
def a45_mean_of_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of quarters, their mean by office and year, cut to a whole number."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), "o_totalprice")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("office_id")), "c_custkey")
    return statistics.quantile(rows, ["office_id", "year", "quarter"], "o_totalprice", 0.5, "m").groupBy("office_id", "year").agg(F.avg("m").cast("bigint").alias("average"))


@query("""WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS hits, count(*) FILTER (l_returnflag = 'A') AS said, count(*) FILTER (l_linestatus = 'F') AS golden FROM lineitem GROUP BY 1)
    SELECT *, coalesce(round(2 * hits / nullif(said + golden, 0), 6), 0) AS f FROM s""")
def a46_f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.f_scores(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")


@query("""WITH b AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events), r AS (SELECT *, sum(CASE WHEN event_id - prev < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT user_id, CAST(k AS BIGINT) AS range, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, k""")
def w15_ranges_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.ranges_by_distance(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 40)


@query(f"""WITH {SECTIONS_SQL}, v AS (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS kinds FROM lineitem GROUP BY 1), s AS (SELECT section_id, person_id, year, kinds FROM sections JOIN v ON l_orderkey = section_id)
    SELECT section_id, list_has_all(lag(kinds) OVER (PARTITION BY person_id ORDER BY year, section_id), kinds) AS subset FROM s""")
def u6_subset_of_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("section_id")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("kinds"))
    rows = sections(spark, sf_dir).select("section_id", "person_id", "year").join(kinds, "section_id")
    return profiles.subset_of_previous(rows, ["person_id"], [F.col("year"), F.col("section_id")], "kinds").select("section_id", "subset")


@query("""WITH u AS (SELECT p_name, min(p_brand) AS v FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1), w AS (SELECT p_name, p_type, min(p_brand) AS v FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) = 1)
    SELECT p_partkey, coalesce(u.v, w.v) AS brand FROM part LEFT JOIN u USING (p_name) LEFT JOIN w ON w.p_name = part.p_name AND w.p_type = part.p_type""")
def j25_by_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    reference = part.select("p_name", "p_type", F.col("p_brand").alias("brand"))
    return profiles.by_unique_keys(part.select("p_partkey", "p_name", "p_type"), reference, "brand", ["p_name"], ["p_name", "p_type"]).select("p_partkey", "brand")


@query("""WITH h AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS sections, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS persons FROM orders GROUP BY 1), l AS (UNPIVOT h ON sections, persons INTO NAME metric VALUE value),
    b AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY year) AS before FROM l) SELECT year, metric, before, value FROM b WHERE value < before""")
def a9_falling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("sections"), F.count_distinct("o_custkey").alias("persons"))
    return profiles.falls(history, "year", ["sections", "persons"])


@query(r"""WITH c AS (SELECT c_custkey, list_transform(regexp_extract_all(c_name, '\S'), lambda x: CAST(ord(x) AS BIGINT)) AS codes FROM customer), h AS (SELECT c_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), codes), lambda h, x: (h * 31 + x) & 4294967295) AS h FROM c)
    SELECT c_custkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM h""")
def c15_position_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", profiles.text_hash(F.col("c_name")).alias("hash"))


@query(f"""WITH {SECTIONS_SQL} SELECT section_id, office_id || ';' || year || ';' || CAST(CAST(floor(income) AS BIGINT) AS VARCHAR) || ';' || lower(person_name) || ';' AS long_key, office_id || ';' || year || ';' || lower(person_name) AS short_key FROM sections""")
def c50_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, name = F.floor("income"), F.lower("person_name")
    return sections(spark, sf_dir).select("section_id", profiles.passport(F.col("office_id"), F.col("year"), amount, name, F.lit(None)).alias("long_key"), profiles.passport(F.col("office_id"), F.col("year"), name).alias("short_key"))


@query(r"""WITH h AS (SELECT regexp_replace(regexp_extract(lower(url), '//([^/:?#]+)', 1), '^www\.', '') AS host, url, length(html) AS weight, page_id FROM pages) SELECT host, url, weight FROM h QUALIFY row_number() OVER (PARTITION BY host ORDER BY weight DESC NULLS LAST, page_id) = 1""")
def o8_next_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page each site's crawl takes next: the heaviest, ties to the smaller id."""
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), "url", F.length("html").cast("bigint").alias("weight"), "page_id")
    return ordered.first_of(pages, ["host"], [F.col("weight").desc_nulls_last(), F.col("page_id")]).select("host", "url", "weight")


@query(f"""WITH p AS (SELECT p_partkey, {_FIRST} AS name, {_SECOND} AS surname, p_retailprice AS income FROM part),
    f AS (SELECT name, row_number() OVER (ORDER BY count(DISTINCT surname) DESC, name DESC) - 1 AS r FROM p GROUP BY 1), s AS (SELECT surname, row_number() OVER (ORDER BY count(DISTINCT name) DESC, surname DESC) - 1 AS r FROM p GROUP BY 1)
    SELECT p_partkey, name, surname, income FROM p JOIN f USING (name) JOIN s USING (surname) WHERE f.r * s.r < 12 AND income > 905""")
def f7_rare_and_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.get(words, F.lit(0)).alias("name"), F.get(words, F.lit(1)).alias("surname"), F.col("p_retailprice").alias("income"))
    return profiles.rare_and_rich(parts, ordered.unique_ranks(parts, "name", "surname"), ordered.unique_ranks(parts, "surname", "name"), "name", "surname", "income", 12, 905).select("p_partkey", "name", "surname", "income")


@query("""WITH b AS (SELECT c_custkey AS k, max_by(o_orderstatus, o_orderkey) AS s FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) <= 1996 GROUP BY 1), a AS (SELECT o_custkey AS k, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE year(o_orderdate) > 1996 GROUP BY 1),
    c AS (SELECT b.s AS before, a.s AS after, count(*) AS n FROM b FULL JOIN a ON b.k = a.k GROUP BY ALL)
    SELECT *, CASE sign(coalesce(list_position(['F', 'P', 'O'], after), 0) - coalesce(list_position(['F', 'P', 'O'], before), 0)) WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'same' END AS change FROM c""")
def a31_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each person's sections up to 1996 and after."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus")
    last = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return profiles.status_changes(last(orders.filter("year <= 1996")), last(orders.filter("year > 1996")), "k", "status", ["F", "P", "O"])


@query(f"""WITH {SECTIONS_SQL}, m AS (SELECT office_id, year, median(income) AS m FROM sections GROUP BY ALL)
    SELECT office_id, {", ".join(f"round(max(m) FILTER (year = {y}), 2) AS y{y}" for y in range(1992, 1999))} FROM m GROUP BY 1""")
def k8_pivoted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = statistics.quantile(sections(spark, sf_dir), ["office_id", "year"], "income", 0.5, "m").groupBy("office_id").pivot("year", list(range(1992, 1999))).agg(F.max("m"))
    return wide.select("office_id", *(F.round(F.col(f"`{y}`"), 2).alias(f"y{y}") for y in range(1992, 1999)))
