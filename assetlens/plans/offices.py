"""Queries on offices: phrases in texts, rubrics and regions of names that are written from the tables, office prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.operators import offices as O
from assetlens.operators import phrases as P
from assetlens.registry import query
from assetlens.sources.tables import table

#: Offices that nations stand for: kinds of offices, their subjects, and regions with their forms (nominative, genitive, dative).
KINDS = ["Министерство", "Департамент", "Управление", "Администрация", "Инспекция"]
SUBJECTS = ["лесного хозяйства", "народного образования", "водного транспорта", "местных финансов", "охотничьего надзора"]
REGIONS = [("Омская область", "Омской области", "Омской области"), ("Алтайский край", "Алтайского края", "Алтайскому краю"), ("Республика Алтай", "Республики Алтай", "Республике Алтай"), ("Город Орел", "города Орла", "городу Орлу"), ("Орловская область", "Орловской области", "Орловской области")]
#: Rubrics in the order in which they are tried: phrases for them and against them; the last letter says that words may go on.
RUBRICS = [("nature", ["лесного хозяйства", "охотнич*"], ["водн*"]), ("schools", ["образовани*"], ["министерство"]), ("finance", ["местных финансов"], []), ("other power", ["министерство", "департамент*", "управлени*"], ["инспекция"])]
_pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))


def _sql(words: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({k}) + 1]"


def named_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """office_id, region_id, name: one for each supplier, whose key chooses kind, subject and region."""
    k = F.col("s_suppkey")
    name = F.concat_ws(" ", _pick(KINDS, k % 5), _pick(SUBJECTS, F.floor(k / 5) % 5), _pick([r[1] for r in REGIONS], F.floor(k / 25) % 5))
    return table(spark, sf_dir, "supplier").select(k.alias("office_id"), (F.floor(k / 25) % 5).cast("int").alias("region_id"), name.alias("name"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{L}\\p{N}]+') AS w FROM documents), p AS (SELECT DISTINCT array_to_string(w[1:4], ' ') AS phrase FROM d WHERE len(w) >= 4),
    t AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d), m AS (SELECT doc_id, phrase FROM t JOIN p ON contains(t, ' ' || phrase || ' '))
    SELECT doc_id, count(DISTINCT phrase) AS phrases, arg_min(phrase, (-length(phrase), phrase)) AS longest FROM m GROUP BY doc_id""")
def c46_phrases_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four words of every document, looked up in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("ws", P.words(F.col("text")))
    dictionary = docs.filter(F.size("ws") >= 4).select(F.array_join(F.slice("ws", 1, 4), " ").alias("phrase")).distinct()
    found = P.matches(docs, "doc_id", "text", dictionary)
    return found.groupBy("doc_id").agg(F.countDistinct("phrase").alias("phrases"), F.min(F.struct((-F.col("chars")).alias("c"), "phrase"))["phrase"].alias("longest"))


def _regions(spark: SparkSession) -> DataFrame:
    short = [(1, "Алтай"), (3, "Орел")]
    return spark.createDataFrame([(k, form) for k, r in enumerate(REGIONS) for form in sorted(set(r))] + short, "region_id int, phrase string")


@query("""WITH k AS (SELECT s_suppkey AS office_id, s_suppkey % 4 AS kind, CAST(s_suppkey // 25 % 5 AS INTEGER) AS r FROM supplier)
    SELECT office_id, CASE WHEN kind = 2 AND r IN (1, 3) THEN 0 ELSE r END AS anywhere, CASE kind WHEN 3 THEN r WHEN 2 THEN 0 END AS at_start, CASE WHEN kind = 2 THEN 0 ELSE r END AS first FROM k""")
def c46_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of an office's address: the longest form in it, the one at its start and the one that ends first. The kinds of addresses
    name the region in one of its cases; one kind also names another region with a shorter form before."""
    k = F.col("s_suppkey")
    form = lambda i: _pick([r[i] for r in REGIONS], F.floor(k / 25) % 5)
    place = F.when(k % 4 == 0, F.concat(F.lit("Отдел "), form(1), F.lit(", дом 5"))).when(k % 4 == 1, F.concat(F.lit("управление по "), form(2))).when(k % 4 == 2, F.concat(F.lit("(омская  ОБЛАСТЬ, центр) "), form(0))).otherwise(F.concat(form(0), F.lit(", центр")))
    texts = table(spark, sf_dir, "supplier").select(k.alias("office_id"), place.alias("text"))
    found = P.matches(texts, "office_id", "text", _regions(spark))
    own = texts.select("office_id")
    longest = P.longest_match(found, "office_id", "region_id").withColumnRenamed("region_id", "anywhere")
    start, first = P.match_at_start(found, "office_id", "region_id").withColumnRenamed("region_id", "at_start"), P.first_match(found, "office_id", "region_id").withColumnRenamed("region_id", "first")
    return own.join(longest, "office_id", "left").join(start, "office_id", "left").join(first, "office_id", "left")


@query("""WITH k AS (SELECT s_suppkey AS office_id, s_suppkey % 5 AS kind, s_suppkey // 5 % 5 AS subject FROM supplier)
    SELECT office_id, CASE WHEN subject IN (0, 4) THEN 'nature' WHEN subject = 1 AND kind <> 0 THEN 'schools' WHEN subject = 3 THEN 'finance' WHEN kind IN (0, 1, 2) THEN 'other power' END AS rubric FROM k""")
def c49_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rubric that a phrase of an office's name speaks for and none speaks against."""
    rows = [(name, k, p.rstrip("*"), p.endswith("*"), no) for k, (name, yes, against) in enumerate(RUBRICS) for no, ps in ((False, yes), (True, against)) for p in ps]
    dictionary = spark.createDataFrame(rows, "rubric string, priority int, phrase string, begins boolean, against boolean")
    names = named_offices(spark, sf_dir)
    found = P.matches(names, "office_id", "name", dictionary, begins="begins")
    return names.select("office_id").join(P.classes(found, "office_id", "rubric", "priority", "against"), "office_id", "left")


@query(f"""WITH n AS (SELECT s_suppkey AS owner, lower({_sql(SUBJECTS, "s_suppkey // 5 % 5")} || ' ' || {_sql([r[1] for r in REGIONS], "s_suppkey // 25 % 5")} || ' ' || s_suppkey // 3) AS name FROM supplier),
    t AS (SELECT o_orderkey, lower({_sql(SUBJECTS, "o_orderkey // 5 % 5")} || ' ' || {_sql([r[2] for r in REGIONS], "o_orderkey // 25 % 5")} || ' ' || o_orderkey % 97) AS title FROM orders),
    ns AS (SELECT owner, unnest(list_distinct(list_transform(string_split(name, ' '), lambda w: left(w, 6)))) AS stem FROM n), f AS (SELECT stem, count(*) AS f FROM ns GROUP BY stem HAVING count(*) <= 100),
    ts AS (SELECT o_orderkey, unnest(list_distinct(list_transform(string_split(title, ' '), lambda w: left(w, 6)))) AS stem FROM t),
    c AS (SELECT o_orderkey, owner, round(sum(1 / f), 6) AS weight, count(*) AS shared FROM ts JOIN f USING (stem) JOIN ns USING (stem) GROUP BY ALL)
    SELECT o_orderkey, arg_max(owner, (weight, shared, -owner)) AS owner, max(weight) AS weight FROM c WHERE weight > 0.3 GROUP BY o_orderkey""")
def c16_names_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The office whose name shares the most telling words with a title."""
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    names = table(spark, sf_dir, "supplier").select(k.alias("owner"), F.concat_ws(" ", _pick(SUBJECTS, F.floor(k / 5) % 5), _pick([r[1] for r in REGIONS], F.floor(k / 25) % 5), F.floor(k / 3).cast("string")).alias("name"))
    titles = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", _pick(SUBJECTS, F.floor(o / 5) % 5), _pick([r[2] for r in REGIONS], F.floor(o / 25) % 5), (o % 97).cast("string")).alias("title"))
    return P.best_name(P.compared_names(titles, "o_orderkey", "title", names, "owner", "name"), "o_orderkey", 0.3)


@query("""WITH h AS (SELECT o_custkey AS id, o_orderkey % 25 AS office, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL), human AS (SELECT id, arg_min(office, (-n, office)) AS office FROM h GROUP BY id),
    r AS (SELECT n_regionkey, min(n_nationkey) AS office FROM nation GROUP BY n_regionkey), tax AS (SELECT c_custkey AS id, office FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN r USING (n_regionkey) WHERE c_mktsegment = 'BUILDING'),
    e AS (SELECT user_id AS id, length(event_type) AS office, ts, event_id FROM events), single AS (SELECT id, min(office) AS office FROM e GROUP BY id HAVING count(DISTINCT office) = 1), one AS (SELECT id, arg_min(office, (ts, office)) AS office FROM e GROUP BY id)
    SELECT c_custkey AS id, CAST(coalesce(human.office, tax.office, CASE WHEN abs(c_acctbal) / 10000 >= 0.99 THEN c_custkey % 25 END, single.office, one.office) AS BIGINT) AS office,
        CASE WHEN human.office IS NOT NULL THEN 'human' WHEN tax.office IS NOT NULL THEN 'regional' WHEN abs(c_acctbal) / 10000 >= 0.99 THEN 'model' WHEN single.office IS NOT NULL THEN 'single site' WHEN one.office IS NOT NULL THEN 'first site' END AS method
    FROM customer LEFT JOIN human ON human.id = c_custkey LEFT JOIN tax ON tax.id = c_custkey LEFT JOIN single ON single.id = c_custkey LEFT JOIN one ON one.id = c_custkey""")
def m7_office_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by hand (the most frequent office), the regional office of one rubric, a model from 0.99 on, the one office of all sites, the
    first site's. Customers stand for documents, orders and events for references."""
    c, office = table(spark, sf_dir, "customer"), lambda x: x.cast("bigint").alias("office")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    human = urgent.groupBy(F.col("o_custkey").alias("id"), office(F.col("o_orderkey") % 25)).agg(F.count("*").alias("weight"))
    nations = table(spark, sf_dir, "nation")
    of_region = nations.groupBy("n_regionkey").agg(office(F.min("n_nationkey")))
    tax = c.filter("c_mktsegment = 'BUILDING'").join(nations.join(of_region, "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), "office")
    model = c.select(F.col("c_custkey").alias("id"), office(F.col("c_custkey") % 25), (F.abs("c_acctbal") / 10_000).alias("weight"))
    sites = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), office(F.length("event_type")), "ts")
    first = sites.groupBy("id").agg(F.min(F.struct("ts", "office"))["office"].alias("office"))
    rules = [("human", human, 1), ("regional", tax, None), ("model", model, 0.99), ("single site", O.agreed(sites, "id", "office"), None), ("first site", first, None)]
    return O.cascade(c.select(F.col("c_custkey").alias("id")), "id", rules)


@query()
def m5_predicted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every fifth id, with the language that a model of the others' words gives them, and its weight."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", "lang", O.signs(F.col("text")).alias("signs"))
    held = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    return O.OfficeModel().fit(docs.filter(~held), "lang", "signs").predict(docs.filter(held), "signs").select("doc_id", "lang", "office", F.round("weight", 4).alias("weight"))
