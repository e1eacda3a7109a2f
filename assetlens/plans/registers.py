"""Queries on what a register shows, imports, searches and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.functions import urls as U
from assetlens.operators import registers as R
from assetlens.plans.people import NAMED_SQL, named_sections
from assetlens.registry import query
from assetlens.sources.tables import SECTIONS_SQL, WAGES_SQL, offices, sections, table, wages


@query("""WITH v AS (SELECT l_orderkey AS section_id, l_linenumber AS number, l_returnflag || l_linestatus AS text FROM lineitem WHERE l_quantity > 10)
    SELECT section_id, number, text FROM v WHERE section_id IN (SELECT o_orderkey FROM orders) AND section_id NOT IN (SELECT section_id FROM v GROUP BY section_id HAVING count(*) > 4)""")
def f2_few_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("number"), F.when(F.col("l_quantity") > 10, F.concat("l_returnflag", "l_linestatus")).alias("text"))
    return R.few_vehicles(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id")), vehicles, "section_id", "text", 4)


@query(f"WITH {SECTIONS_SQL} SELECT section_id, s.year, income, n_regionkey AS region_id FROM sections s JOIN nation ON n_nationkey = office_id JOIN {WAGES_SQL} w ON w.year = s.year WHERE income > 0 AND income < 400000 AND office_id <> 4 AND n_regionkey IS NOT NULL AND n_regionkey NOT IN (0, 3) AND income / 12 > min_wage")
def f6_region_incomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir).join(offices(spark, sf_dir), "office_id")
    return R.region_incomes(rows, wages(spark), 400_000.0, [4], [0, 3]).select("section_id", "year", "income", "region_id")


@query(f"WITH {SECTIONS_SQL}, m AS (SELECT *, income > 450000 AS fits, bool_or(income > 450000) OVER (PARTITION BY person_id) AS any_fits FROM sections) SELECT section_id, person_id, NOT any_fits AS doubtful FROM m WHERE fits OR NOT any_fits")
def f10_filtered_or_doubtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filtered_or_doubtful(sections(spark, sf_dir), "person_id", F.col("income") > 450_000).select("section_id", "person_id", "doubtful")


@query("""WITH f AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events) SELECT day, count(*) AS lines FROM f WHERE day > (SELECT max(day) FROM f) - 7 GROUP BY day""")
def f13_log_files_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files are named by day; those of the last week are counted by the date in their names."""
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("/var/log/access.log-"), F.date_format("ts", "yyyyMMdd"), F.lit(".gz")).alias("file"))
    days = lines.groupBy("file").agg(F.count("*").alias("lines")).withColumn("day", R.file_date(F.col("file")))
    last = days.agg(F.date_sub(F.max("day"), 7).alias("since"))
    return days.join(F.broadcast(last)).filter("day > since").select("day", "lines")


@query(r"SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'at') AND regexp_matches(text, '\d{6}|\d{3} \d{3}')")
def f19_may_be_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(R.may_be_declaration(F.col("text"), ["the", "and", "at"])).select("doc_id")


@query("""WITH k AS (SELECT user_id, ts, event_type <> 'error' AS ok FROM events), o AS (SELECT user_id, max(ts) FILTER (ok) AS ok FROM k GROUP BY user_id)
    SELECT k.user_id, count(*) FILTER (NOT k.ok AND (o.ok IS NULL OR k.ts > o.ok)) AS failures FROM k JOIN o USING (user_id) GROUP BY k.user_id HAVING failures < 2""")
def f20_sites_to_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sites_to_visit(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") != "error", 2).select("user_id", "failures")


@query("SELECT l_orderkey, count(*) AS refs FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_suppkey BETWEEN 20 AND 29) = 0")
def f21_without_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents none of whose references is of the range that was imported before."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("refs"), F.count_if(F.col("l_suppkey").between(20, 29)).alias("_in")).filter("_in = 0").drop("_in")


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), s AS (SELECT DISTINCT sha FROM d WHERE doc_id % 7 = 0)
    SELECT doc_id, sha IN (SELECT sha FROM s) AS selected FROM d""")
def f22_by_hash_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a list of hashes selects (semi join), and those that are left when it deletes them (anti join)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    listed = docs.filter("doc_id % 7 = 0").select("sha").distinct()
    selected, left = docs.join(listed, "sha", "left_semi"), docs.join(listed, "sha", "left_anti")
    return selected.select("doc_id", F.lit(True).alias("selected")).unionByName(left.select("doc_id", F.lit(False).alias("selected")))


@query(f"WITH {SECTIONS_SQL}, c AS (SELECT o_orderkey - 1 AS old_id FROM orders WHERE o_orderstatus = 'P') SELECT section_id, person_id, year FROM sections WHERE section_id NOT IN (SELECT old_id FROM c)")
def f23_without_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section that another one corrects is hidden."""
    corrections = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select((F.col("o_orderkey") - 1).alias("section_id"))
    return sections(spark, sf_dir).join(corrections, "section_id", "left_anti").select("section_id", "person_id", "year")


@query(f"""WITH {NAMED_SQL}, e AS (SELECT DISTINCT person_id FROM named JOIN lineitem ON l_orderkey = section_id WHERE l_quantity >= 49)
    SELECT person_id, count(*) AS sections, count(*) FILTER (section_id % 4 = 1) AS good FROM named WHERE person_id NOT IN (SELECT person_id FROM e) GROUP BY person_id HAVING sections > 1 AND good * 5 < sections""")
def f24_bad_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named_sections(spark, sf_dir)
    good = F.size(F.split("person_name", " ")) == 3
    estates = rows.join(table(spark, sf_dir, "lineitem").filter("l_quantity >= 49"), F.col("section_id") == F.col("l_orderkey")).select("person_id").distinct()
    # of the notations only one is called good here: first name, patronymic, family name
    return R.bad_names(rows, "person_id", good & (F.col("section_id") % 4 == 1), estates)


@query("""WITH d AS (SELECT sha256(coalesce(text, '')) AS sha, source, doc_id FROM documents), b AS (SELECT sha, min(source) AS source, min(doc_id) AS doc_id FROM d GROUP BY sha HAVING count(*) FILTER (doc_id % 2 = 0) > 0 AND count(*) FILTER (doc_id % 2 = 1) > 0)
    SELECT source, min(doc_id) AS doc_id FROM b WHERE source IS NOT NULL GROUP BY source""")
def f25_documents_to_learn_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents that both sets hold, one of each site."""
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "source", "doc_id")
    both = docs.groupBy("sha").agg(F.min("source").alias("source"), F.min("doc_id").alias("doc_id"), F.bool_or(F.col("doc_id") % 2 == 0).alias("a"), F.bool_or(F.col("doc_id") % 2 == 1).alias("b")).filter("a and b and source is not null")
    return both.groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT event_id, CASE WHEN value / m > 0.5 THEN 'automatic' ELSE 'manual' END AS pool FROM events, (SELECT max(value) AS m FROM events)")
def f26_split_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return rows.join(F.broadcast(rows.agg(F.max("value").alias("m")))).select("event_id", F.when(F.col("value") / F.col("m") > 0.5, "automatic").otherwise("manual").alias("pool"))


@query("SELECT source, max(doc_id) AS doc_id FROM documents WHERE contains(text, 'ion') GROUP BY source")
def f27_newest_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest_hit(table(spark, sf_dir, "documents"), "source", "doc_id", F.col("text").contains("ion"))


@query(f"WITH {SECTIONS_SQL} SELECT section_id, person_id, year, income, l_partkey AS vehicle_id FROM sections JOIN lineitem ON l_orderkey = section_id WHERE l_linestatus = 'F'")
def j3_vehicles_of_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("section_id"), F.col("l_partkey").alias("vehicle_id"))
    return sections(spark, sf_dir).join(vehicles, "section_id").select("section_id", "person_id", "year", "income", "vehicle_id")


@query("""WITH v AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), s AS (SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber) AS s FROM lineitem GROUP BY ALL)
    SELECT o_orderkey AS section_id, coalesce(array_to_string(v, ','), '') AS vehicles, coalesce(len(s), 0) AS estates FROM orders LEFT JOIN v ON v.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""")
def j8_sections_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), "l_linenumber", "l_partkey", "l_quantity", "l_linestatus")
    rows = R.with_children(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id")), "section_id", vehicles=(goods.filter("l_linestatus = 'F'"), ["l_linenumber", "l_partkey"]), estates=(goods, ["l_linenumber", "l_quantity"]))
    return rows.select("section_id", F.array_join(F.transform("vehicles", lambda v: v["l_partkey"].cast("string")), ",").alias("vehicles"), F.size("estates").cast("bigint").alias("estates"))


@query("""WITH w AS (SELECT user_id AS id, count(*) AS web_refs, min(ts) AS first FROM events GROUP BY user_id), d AS (SELECT o_custkey AS id, count(*) AS human_refs, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS id, coalesce(web_refs, 0) AS web_refs, coalesce(human_refs, 0) AS human_refs, CAST(floor(epoch(first)) AS BIGINT) AS first, CAST(floor(epoch(last)) AS BIGINT) AS last FROM customer LEFT JOIN w ON w.id = c_custkey LEFT JOIN d ON d.id = c_custkey""")
def j9_documents_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the web and the human register say of them; both are grouped by document first."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    web = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("web_refs"), F.unix_timestamp(F.min("ts")).alias("first"))
    human = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("human_refs"), F.unix_timestamp(F.max("o_orderdate")).alias("last"))
    return docs.join(web, "id", "left").join(human, "id", "left").fillna(0, ["web_refs", "human_refs"])


@query(f"""WITH {NAMED_SQL}, w AS (SELECT DISTINCT person_id, list_sort([family, whole_first, whole_patronymic]) AS key FROM named WHERE section_id % 4 = 0),
    x AS (SELECT DISTINCT person_id, list_sort([family, whole_first, whole_patronymic]) AS key FROM named WHERE section_id % 4 = 1)
    SELECT w.person_id AS own, x.person_id AS other FROM w JOIN x USING (key)""")
def j21_reordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of two lists, of which one has the family name last."""
    rows = named_sections(spark, sf_dir).withColumn("key", R.reordered_key(F.col("person_name")))
    part = lambda k, name: rows.filter(F.col("section_id") % 4 == k).select("key", F.col("person_id").alias(name)).distinct()
    return part(0, "own").join(part(1, "other"), "key").select("own", "other")


@query("""WITH d AS (SELECT n_regionkey, min(n_nationkey) AS office_id FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey HAVING count(*) > 2) SELECT s_suppkey, coalesce(d.office_id, -1) AS office_id FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN d USING (n_regionkey)""")
def j23_office_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The office that a service has in a region, else its federal one (-1)."""
    n = table(spark, sf_dir, "nation")
    of_region = n.filter("n_nationkey % 2 = 0").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("office_id"), F.count("*").alias("n")).filter("n > 2").drop("n")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")), "s_nationkey")
    return rows.join(F.broadcast(of_region), "n_regionkey", "left").select("s_suppkey", F.coalesce("office_id", F.lit(-1)).alias("office_id"))


@query("""WITH own AS (SELECT s_suppkey AS id, s_nationkey % 11 AS host, 'N' || s_suppkey % 4 || 'x' AS name, CASE WHEN s_suppkey % 9 = 0 THEN 1000 END AS old FROM supplier), ext AS (SELECT n_nationkey AS entity, n_nationkey % 11 AS host, 'N' || n_nationkey % 4 || CASE n_nationkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE 'xy' END AS label FROM nation),
    b AS (SELECT own.*, entity, CASE WHEN count(*) OVER (PARTITION BY id) = 1 THEN 0 WHEN label = name THEN 1 WHEN starts_with(name, label) THEN 2 WHEN starts_with(label, name) THEN 3 END AS k FROM own JOIN ext USING (host)),
    t AS (SELECT id, entity, k, min(k) OVER (PARTITION BY id) AS m FROM b WHERE k IS NOT NULL), o AS (SELECT id, min(entity) AS entity FROM t WHERE k = m GROUP BY id HAVING count(*) = 1)
    SELECT own.id, CAST(coalesce(old, entity) AS INTEGER) AS entity FROM own LEFT JOIN o USING (id)""")
def j24_external_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    external = table(spark, sf_dir, "nation").select(n.alias("entity"), (n % 11).alias("host"), F.concat(F.lit("N"), (n % 4).cast("string"), F.when(n % 3 == 0, "x").when(n % 3 == 1, "").otherwise("xy")).alias("label"))
    own = table(spark, sf_dir, "supplier").select(s.alias("id"), (F.col("s_nationkey") % 11).alias("host"), F.concat(F.lit("N"), (s % 4).cast("string"), F.lit("x")).alias("name"), F.when(s % 9 == 0, 1000).alias("old"))
    return R.external_match(own, external)


@query("SELECT DISTINCT source AS site, sha256(coalesce(text, '')) AS sha, dense_rank() OVER (PARTITION BY source ORDER BY sha256(coalesce(text, ''))) AS place FROM documents")
def k11_files_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site's files once, in order of their hashes; the last place is their number."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).distinct()
    return files.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("sha")).cast("bigint"))


@query("""WITH p AS (SELECT *, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)::TIMESTAMP) AS nxt FROM events)
    SELECT user_id, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS elapsed, count(*) AS steps, count(*) FILTER (event_type = 'click') AS heads, CAST(max(floor(nxt) - floor(epoch(ts))) AS BIGINT) AS longest_pause, CASE WHEN floor(epoch(max(ts))) > floor(epoch(min(ts))) THEN round(60 * count(*) / (floor(epoch(max(ts))) - floor(epoch(min(ts)))), 4) END AS per_minute FROM p GROUP BY user_id""")
def a36_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pauses(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "click")


@query(r"""WITH p AS (SELECT regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)', 1), '^www\.', '') AS host, len(list_filter(string_split(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(?:[a-zA-Z][\w+.\-]*:)?//[^/]*(/.*)$', 1), '/'), lambda x: x <> '')) AS depth FROM pages)
    SELECT host, CAST(max(depth) AS INTEGER) AS depth FROM p GROUP BY host""")
def a42_longest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.size(F.filter(F.split(U.path(F.col("url")), "/"), lambda x: x != ""))
    return table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.max(depth).alias("depth"))


@query("""WITH w AS (SELECT c_custkey, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) AS w FROM customer), r AS (SELECT c_custkey, sum(w) OVER (ORDER BY c_custkey) AS upto, w FROM w WHERE w > 0), t AS (SELECT sum(w) AS t FROM w),
    d AS (SELECT CAST(range AS BIGINT) AS draw, CAST(floor(CAST('0x' || substring(md5('7-' || range), 1, 12) AS BIGINT) / 281474976710656.0 * (SELECT t FROM t)) AS BIGINT) AS spot FROM range(2000))
    SELECT draw, c_custkey FROM d JOIN r ON upto - w <= spot AND spot < upto""")
def o7_weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 2,000 draws of customers in proportion to what they own."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("bigint").alias("w"))
    return R.drawn(rows, "c_custkey", "w", 2000, "7")


@query("""WITH d AS (SELECT sha256(coalesce(text, '')) AS sha, source, doc_id FROM documents), a AS (SELECT sha, min(doc_id) AS first, min(source) AS source FROM d WHERE doc_id % 3 > 0 GROUP BY sha), b AS (SELECT sha, min(doc_id) AS first, min(source) AS source FROM d WHERE doc_id % 3 < 2 GROUP BY sha)
    SELECT sha, least(a.first, b.first) AS first, CASE WHEN b.sha IS NOT NULL THEN b.source ELSE a.source END AS source FROM a FULL JOIN b USING (sha)""")
def t5_merged_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "source", "doc_id")
    part = lambda rows: rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.min("source").alias("source"))
    return R.merged_epochs(part(docs.filter("doc_id % 3 > 0")), part(docs.filter("doc_id % 3 < 2")), "sha", "first")


@query("SELECT count(*) AS checked, count(*) FILTER (o_custkey % 7 <> 0) AS right, count(*) FILTER (o_custkey % 7 = 0) <= 0.2 * count(*) AS passes FROM orders")
def q5_failure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that differ from what is known, and whether they are few enough."""
    wrong = F.count_if(F.col("o_custkey") % 7 == 0)
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("checked"), (F.count("*") - wrong).alias("right"), (wrong <= 0.2 * F.count("*")).alias("passes"))


@query(f"WITH {NAMED_SQL} SELECT section_id FROM named WHERE section_id % 4 <> 1 AND section_id % 10 = 0")
def q6_surnames_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to an external person whose label doesn't begin with the family name; every tenth label here is another's."""
    rows = named_sections(spark, sf_dir).filter("section_id % 4 <> 1")
    family = F.split_part("person_name", F.lit(" "), F.lit(1))
    label = F.when(F.col("section_id") % 10 == 0, F.concat(F.lit("Не"), F.lower(family))).otherwise(F.concat(family, F.lit(", чиновник")))
    return rows.filter(~label.startswith(family)).select("section_id")


@query("""SELECT l_orderkey AS doc, array_to_string(list_sort(list(CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ':' || left(l_returnflag || l_linestatus, 10))), ';') AS canon FROM lineitem GROUP BY l_orderkey""")
def q7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a document cut to what is compared, in a fixed order."""
    one = F.concat_ws(":", F.floor("l_quantity").cast("string"), F.substring(F.concat("l_returnflag", "l_linestatus"), 1, 10))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.sort_array(F.collect_list(one)), ";").alias("canon"))


@query("""WITH p AS (SELECT l_orderkey AS a, l_linenumber AS b, CASE WHEN l_orderkey % 50 = 0 THEN 1 WHEN l_quantity > 45 THEN 1 ELSE 0 END AS mark FROM lineitem), n AS (SELECT a, b, mark FROM p WHERE mark = 0 ORDER BY a, b LIMIT (SELECT 2 * count(*) FROM p WHERE mark = 1))
    SELECT a, b, mark FROM p WHERE mark = 1 UNION ALL SELECT a, b, mark FROM n""")
def q8_golden_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), (F.col("l_quantity") > 45).cast("int").alias("mark"))
    fixes = pairs.filter("a % 50 = 0").select("a", "b", F.lit(1).alias("mark")).distinct()
    return R.golden_pool(pairs, "mark", [F.col("a"), F.col("b")], 2, fixes, ["a", "b"])
