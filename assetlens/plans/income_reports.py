"""Reports on incomes: medians, growth, ratings, gaps, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.operators import ordered, statistics
from assetlens.registry import query
from assetlens.sources.tables import SECTIONS_SQL, WAGES_SQL, offices, properties, sections, table, wages

LOW, HIGH, YEARS = 10_000.0, 400_000.0, (1993, 2001)
FACTS_SQL = f"{SECTIONS_SQL}, facts AS (SELECT * FROM sections WHERE income > 10000 AND income < 400000 AND year BETWEEN 1993 AND 2001 AND person_id IS NOT NULL), wages AS {WAGES_SQL}"
PAID_SQL = f"{FACTS_SQL}, paid AS (SELECT f.*, min_wage, mean_income FROM facts f JOIN wages w ON f.year = w.year WHERE income / 12 >= min_wage)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.income_facts(sections(spark, sf_dir), LOW, HIGH, YEARS)


@query(f"""WITH {SECTIONS_SQL}, r AS (
    SELECT *, row_number() OVER (PARTITION BY year, office_id ORDER BY income DESC, person_id DESC, section_id DESC) AS place,
           count(*) OVER (PARTITION BY year, office_id) AS competitors FROM sections WHERE income IS NOT NULL AND income <> 0)
    SELECT year, office_id, n_name AS office, CAST(place AS INTEGER) AS place, person_id, section_id, income, competitors
    FROM r JOIN nation ON n_nationkey = office_id WHERE place <= 3 AND competitors >= 10""")
def w3_top_incomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    incomes = sections(spark, sf_dir).filter("income is not null and income <> 0")
    order = [F.col("income").desc(), F.col("person_id").desc(), F.col("section_id").desc()]
    return ordered.top_places(incomes, ["year", "office_id"], order, 3, least=10).join(offices(spark, sf_dir), "office_id").select("year", "office_id", "office", "place", "person_id", "section_id", "income", "competitors")


def _medians(key: str) -> str:
    return f"WITH {PAID_SQL} SELECT {key}, year, round(median(income), 2) AS median_income, count(*) AS n_incomes, count(DISTINCT person_id) AS n_declarants FROM paid GROUP BY {key}, year"


@query(_medians("office_id"))
def a1_office_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.group_medians(statistics.above_minimum_wage(facts(spark, sf_dir), wages(spark)), "office_id", "year")


@query(_medians("rubric"))
def a1_rubric_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.group_medians(statistics.above_minimum_wage(facts(spark, sf_dir), wages(spark)), "rubric", "year")


@query(f"""WITH {FACTS_SQL}, y AS (SELECT rubric, person_id, year, max(income) AS income FROM facts GROUP BY ALL),
    p AS (SELECT *, lead(year) OVER w AS next_year, lead(income) OVER w AS next_income FROM y WINDOW w AS (PARTITION BY rubric, person_id ORDER BY year))
    SELECT rubric, round(median((next_income / p.income) / (b.mean_income / a.mean_income)), 2) AS median_ratio, count(*) AS n_pairs
    FROM p JOIN wages a ON a.year = p.year JOIN wages b ON b.year = p.year + 1 WHERE next_year = p.year + 1 GROUP BY rubric""")
def a2_consecutive_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.consecutive_growth(statistics.yearly_incomes(facts(spark, sf_dir), "rubric"), wages(spark), "rubric")


@query(f"""WITH {FACTS_SQL}, y AS (SELECT person_id, year, max(income) AS income FROM facts GROUP BY ALL),
    v AS (SELECT y.*, mean_income FROM y JOIN wages w ON y.year = w.year WHERE income > 0 AND income >= 12 * min_wage),
    e AS (SELECT person_id, min(year) AS min_year, max(year) AS max_year, arg_min(income, year) AS a, arg_max(income, year) AS b, arg_min(mean_income, year) AS c, arg_max(mean_income, year) AS d FROM v GROUP BY person_id)
    SELECT person_id, min_year, max_year, CAST(trunc(100 * (b - a) / a) AS INTEGER) AS declarant_growth, CAST(trunc(100 * (d - c) / c) AS INTEGER) AS population_growth FROM e WHERE max_year > min_year""")
def w2_first_last_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.first_last_growth(statistics.yearly_incomes(facts(spark, sf_dir)), wages(spark))


@query(f"WITH {SECTIONS_SQL} SELECT office_id, year, count(*) AS n_sections FROM sections GROUP BY ALL")
def a3_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).groupBy("office_id", "year").agg(F.count("*").alias("n_sections"))


@query(f"WITH {SECTIONS_SQL} SELECT office_id, count(DISTINCT person_id) AS n_persons FROM sections GROUP BY office_id")
def a4_persons_by_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).groupBy("office_id").agg(F.countDistinct("person_id").alias("n_persons"))


@query("SELECT n_regionkey AS region_id, count(*) AS n_offices, array_to_string(list_sort(list(n_name))[1:5], ';') AS examples FROM nation GROUP BY n_regionkey")
def a5_child_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ordered.top_places(offices(spark, sf_dir), ["region_id"], [F.col("office")], 5)
    return first.groupBy("region_id").agg(F.max("competitors").alias("n_offices"), F.array_join(F.array_sort(F.collect_list("office")), ";").alias("examples"))


@query(f"""WITH {PAID_SQL}, s AS (SELECT office_id, year, round(median(income), 2) AS median_income, count(*) AS n_incomes, count(DISTINCT person_id) AS n_declarants FROM paid GROUP BY office_id, year),
    k AS (SELECT *, CAST(sum(n_incomes) OVER (PARTITION BY office_id) AS BIGINT) AS n_all, count(*) OVER (PARTITION BY office_id) AS n_years FROM s WHERE n_incomes > 5)
    SELECT * FROM k WHERE n_all > 10 AND n_years >= 2""")
def a6_office_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.too_small(a1_office_medians(spark, sf_dir), 5, 10, 2, "office_id")


@query(f"""WITH {FACTS_SQL} SELECT CASE WHEN n_regionkey = 4 THEN 3 ELSE n_regionkey END AS region_id, year, CAST(trunc(median(income) / 12) AS INTEGER) AS median_month, count(*) AS n,
    round(quantile_cont(income, 0.9) / quantile_cont(income, 0.1), 3) AS inequality
    FROM facts JOIN nation ON n_nationkey = office_id GROUP BY ALL""")
def a7_region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.merged_regions(facts(spark, sf_dir).join(offices(spark, sf_dir), "office_id"), "region_id", {4: 3})
    key = ["region_id", "year"]
    out = rows.groupBy(*key).agg(F.count("*").alias("n"))
    for p, name in ((0.5, "m"), (0.9, "high"), (0.1, "low")):
        out = out.join(statistics.quantile(rows, key, "income", p, name), key)
    return out.select(*key, (F.col("m") / 12).cast("int").alias("median_month"), "n", F.round(F.col("high") / F.col("low"), 3).alias("inequality"))


@query(f"""WITH {SECTIONS_SQL} SELECT count(DISTINCT section_id) AS sections, count(DISTINCT person_id) AS persons,
    count(DISTINCT CASE WHEN person_name IS NOT NULL AND year IS NOT NULL AND income IS NOT NULL THEN (person_name, year, income) END) AS name_year_incomes FROM sections""")
def a8_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.distinct_counters(sections(spark, sf_dir), {"sections": ["section_id"], "persons": ["person_id"], "name_year_incomes": ["person_name", "year", "income"]})


@query(f"WITH {SECTIONS_SQL} SELECT office_id AS document_id, min(year) AS min_year, max(year) AS max_year, count(*) AS n_sections, round(median(income), 2) AS median_income FROM sections GROUP BY office_id")
def a10_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).groupBy(F.col("office_id").alias("document_id")).agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count("*").alias("n_sections"), F.round(F.median("income"), 2).alias("median_income"))


@query("""SELECT c_custkey AS person_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_sections,
    (SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS square FROM customer""")
def a13_fan_out_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"))
    declared = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("section_id"))
    owned = declared.join(properties(spark, sf_dir), "section_id")
    return statistics.fan_out_free(persons, "person_id", (declared, {"n_sections": F.count("*")}), (owned, {"square": F.sum(F.col("square").cast("bigint"))}))


@query("""SELECT o_custkey AS person_id, count(*) AS n, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY o_custkey""")
def a14_joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["o_orderpriority"]), ",").alias("priorities"))


@query(f"""WITH {SECTIONS_SQL}, f AS (SELECT person_id, min(year) AS year, min(rubric) AS rubric FROM sections GROUP BY person_id), c AS (SELECT year, rubric, count(*) AS n FROM f GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY year), 4) AS share FROM c""")
def a18_persons_by_first_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = sections(spark, sf_dir).groupBy("person_id").agg(F.min("year").alias("year"), F.min("rubric").alias("rubric"))
    return statistics.share_of_total(first.groupBy("year", "rubric").agg(F.count("*").alias("n")), "n", "year")


@query(f"""WITH {SECTIONS_SQL}, c AS (SELECT rubric, status, count(DISTINCT person_id) AS n FROM sections GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY rubric), 4) AS share FROM c""")
def a19_class_by_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.share_of_total(sections(spark, sf_dir).groupBy("rubric", "status").agg(F.countDistinct("person_id").alias("n")), "n", "rubric")


@query(f"""WITH {FACTS_SQL}, g AS (SELECT status, rubric, year, grouping(rubric) AS ar, grouping(year) AS ay, count(*) AS n, median(income) AS m FROM facts GROUP BY GROUPING SETS ((status), (status, rubric), (status, year)))
    SELECT o.status, o.rubric, o.year, o.n, round(o.m, 2) AS median_income, CAST(trunc(100 * (b.m - o.m) / o.m) AS INTEGER) AS gap
    FROM g o LEFT JOIN g b ON b.status = 'F' AND o.ar = b.ar AND o.ay = b.ay AND o.rubric IS NOT DISTINCT FROM b.rubric AND o.year IS NOT DISTINCT FROM b.year""")
def a20_income_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.gap_by_class(facts(spark, sf_dir), "status", "F", (), ("rubric",), ("year",))


@query(f"WITH {FACTS_SQL} SELECT lower(split_part(p_name, ' ', 1)) AS word, count(*) AS n, round(median(p_retailprice), 2) AS median_income FROM part GROUP BY 1 HAVING count(*) > 5")
def a21_income_by_first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.first_word_groups(table(spark, sf_dir, "part").select("p_name", F.col("p_retailprice").alias("income")), "p_name", 5)


@query(f"""WITH {SECTIONS_SQL}, v AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)
    SELECT rubric, status, count(*) AS n, count(l_orderkey) AS n_with, round(count(l_orderkey) / count(*), 4) AS index FROM sections LEFT JOIN v ON l_orderkey = section_id GROUP BY ALL""")
def a22_presence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cars = properties(spark, sf_dir).filter("square > 45").select("section_id")
    return statistics.presence_index(sections(spark, sf_dir), cars, "section_id", "rubric", "status")


@query(f"""WITH {SECTIONS_SQL}, h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
    SELECT rubric, count(*) AS n, round(median(income), 2) AS median_income FROM sections JOIN h ON l_orderkey = section_id GROUP BY rubric""")
def a23_incomplete_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = statistics.without_partner(properties(spark, sf_dir), "section_id", "own_type", "N", "R")
    return sections(spark, sf_dir).join(alone, "section_id", "left_semi").groupBy("rubric").agg(F.count("*").alias("n"), F.round(F.median("income"), 2).alias("median_income"))


@query("""WITH c AS (SELECT n_regionkey AS region_id, c_mktsegment AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY region_id), 4) AS share FROM c WHERE n > 2""")
def a24_names_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("office_id"), F.col("c_mktsegment").alias("name")).join(offices(spark, sf_dir), "office_id")
    return statistics.share_of_total(people.groupBy("region_id", "name").agg(F.count("*").alias("n")).filter("n > 2"), "n", "region_id")


@query("""SELECT p_type AS name, count(*) AS n, round(median(p_retailprice), 2) AS median_income FROM (SELECT DISTINCT p_type, p_brand, p_retailprice FROM part) GROUP BY p_type HAVING count(*) > 5""")
def a26_median_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), "p_brand", F.col("p_retailprice").alias("income")).distinct()
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.round(F.median("income"), 2).alias("median_income")).filter("n > 5")


@query("""WITH r AS (SELECT c_nationkey AS office_id, p_brand AS brand, o_custkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
    SELECT office_id, brand, count(DISTINCT o_custkey) AS n FROM r GROUP BY ALL""")
def a33_brand_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vehicle_id"), F.col("p_brand").alias("brand"))
    return properties(spark, sf_dir).join(brands, "vehicle_id").join(sections(spark, sf_dir), "section_id").groupBy("office_id", "brand").agg(F.countDistinct("person_id").alias("n"))


#: Sizes of parts stand for years; a pivot needs its columns named.
SIZES = list(range(1, 51))


@query(f"""WITH w AS (PIVOT (SELECT p_brand AS brand, p_size FROM part) ON p_size IN ({", ".join(map(str, SIZES))}) USING count(*) GROUP BY brand), n AS (SELECT p_brand AS brand, count(*) AS total FROM part GROUP BY p_brand)
    SELECT w.*, total, round(100 * total / sum(total) OVER (), 2) AS percent FROM w JOIN n USING (brand)""")
def a34_brands_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.pivot_shares(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand"), "brand", "p_size", SIZES)


@query("""WITH c AS (SELECT p_type, count(DISTINCT p_brand) AS n FROM part GROUP BY p_type)
    SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type DESC) - 1 AS rank FROM c""")
def w4_unique_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.unique_ranks(table(spark, sf_dir, "part"), "p_type", "p_brand")


@query(f"""WITH {SECTIONS_SQL} SELECT person_id, year, section_id, income FROM sections QUALIFY row_number() OVER (PARTITION BY person_id, year ORDER BY section_id) = 1""")
def w5_first_section_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_of(sections(spark, sf_dir).select("person_id", "year", "section_id", "income"), ["person_id", "year"], [F.col("section_id")])


@query(f"""WITH {SECTIONS_SQL} SELECT person_id, max(year) AS year, arg_max(section_id, (year, -section_id)) AS section_id FROM sections GROUP BY person_id""")
def w6_last_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("section_id", F.struct("year", -F.col("section_id")))
    return sections(spark, sf_dir).groupBy("person_id").agg(F.max("year").alias("year"), last.alias("section_id"))


@query(f"""WITH {SECTIONS_SQL}, y AS (SELECT person_id, year, max(income) AS income FROM sections GROUP BY ALL)
    SELECT a.person_id, a.year, a.income, b.income AS before FROM y a JOIN y b ON a.person_id = b.person_id AND b.year = a.year - 1""")
def j10_previous_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = statistics.yearly_incomes(sections(spark, sf_dir))
    return yearly.join(yearly.select("person_id", (F.col("year") + 1).alias("year"), F.col("income").alias("before")), ["person_id", "year"])


@query(f"""WITH {SECTIONS_SQL}, y AS (SELECT person_id, year, max(income) > 250000 AS positive FROM sections GROUP BY ALL),
    f AS (SELECT person_id, min(year) AS year FROM y WHERE positive GROUP BY person_id)
    SELECT y.person_id, y.year, y.positive FROM y LEFT JOIN f ON f.person_id = y.person_id
    WHERE (f.year IS NULL OR y.year <= f.year) AND (NOT y.positive OR EXISTS (SELECT 1 FROM y p WHERE p.person_id = y.person_id AND p.year = y.year - 1))""")
def w7_purchase_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = sections(spark, sf_dir).groupBy("person_id", "year").agg((F.max("income") > 250_000).alias("positive"))
    return purchase_cases(yearly)


def purchase_cases(yearly: DataFrame) -> DataFrame:
    """Years of a person up to the first positive one, which counts only if the year before was seen."""
    from pyspark.sql import Window

    own = Window.partitionBy("person_id")
    seen = yearly.withColumn("_first", F.min(F.when(F.col("positive"), F.col("year"))).over(own)).withColumn("_before", F.lag("year").over(own.orderBy("year")))
    good = (F.col("_first").isNull() | (F.col("year") <= F.col("_first"))) & (~F.col("positive") | (F.col("_before") == F.col("year") - 1))
    return seen.filter(good).select("person_id", "year", "positive")


@query()
def w18_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rank_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""SELECT l_orderkey AS section_id, l_returnflag AS kind FROM lineitem WHERE l_returnflag IN ('A', 'N') UNION SELECT o_orderkey, o_orderstatus FROM orders""")
def u1_union_of_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = properties(spark, sf_dir).filter(F.col("own_type").isin("A", "N")).select("section_id", F.col("own_type").alias("kind"))
    return owned.union(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")).distinct()
