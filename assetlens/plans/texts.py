"""Queries on cleaning, cutting and classifying texts, on logs and on votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.functions import urls as U
from assetlens.operators import classify, graph, ordered, tables
from assetlens.registry import query
from assetlens.sources import files
from assetlens.sources.tables import SECTIONS_SQL, sections, table


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\S\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ') AS text FROM documents""")
def c1_spaces_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.spaces_by_line(F.col("text")).alias("text"))


@query(r"""SELECT p_partkey, trim(regexp_replace('«' || p_name || '» "' || p_brand || '*"', '["''«»„“”*\s]+', ' ', 'g')) AS name FROM part""")
def s13_without_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("«"), F.col("p_name"), F.lit('» "'), F.col("p_brand"), F.lit('*"'))
    return table(spark, sf_dir, "part").select("p_partkey", T.without_quotes(quoted).alias("name"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: x IN ('the', 'and', 'of', 'der', 'de'))) / len(ws), 6) END AS share FROM w""")
def c8_share_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.share_of_words(F.col("text"), ["the", "and", "of", "der", "de"]), 6).alias("share"))


@query("""SELECT doc_id, substring(text, greatest(CASE WHEN strpos(lower(text), 'ion') > 60 THEN strpos(lower(text), 'ion') - 60 ELSE 1 END, 1), 500) AS part FROM documents""")
def c13_around_a_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.around(F.col("text"), "ion", 500, 60).alias("part"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 1980 + o_custkey % 40 END AS year FROM orders")
def c34_years_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years stand among numbers that are none: too early, or of more digits."""
    k = F.col("o_custkey")
    cell = F.concat(F.lit("no. 20151, of 1723, "), F.when(k % 3 == 0, "none").otherwise((1980 + k % 40).cast("string")), F.lit(" and 2001-0"))
    cell = F.when(k % 3 == 0, F.lit("no. 20151, of 1723")).otherwise(cell)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.year_in(cell).cast("bigint").alias("year"))


@query(r"SELECT doc_id FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '\W+'), ['the', 'und'])) > 0")
def f9_any_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(T.any_token(F.col("text"), ["the", "und"])).select("doc_id")


@query("SELECT event_id, ['.pdf', '.docx', '.html', NULL][event_id % 4 + 1] AS extension FROM events")
def c42_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "Text/HTML; charset=utf-8", "image/png"]
    return table(spark, sf_dir, "events").select("event_id", U.extension_of_type(F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 4).cast("int"))).alias("extension"))


@query("""WITH c AS (SELECT l_suppkey AS col, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL) SELECT col, arg_min(label, (-n, label)) AS label, max(n) AS n FROM c GROUP BY col""")
def x11_column_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.column_vote(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("col"), F.col("l_returnflag").alias("label")), "col", "label")


@query("""WITH w AS (SELECT p_brand AS owner, unnest([p_name, p_type, p_name || ' ' || p_type]) AS word FROM part) SELECT word, min(owner) AS owner FROM w GROUP BY word HAVING count(DISTINCT owner) = 1""")
def m6_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.array("p_name", "p_type", F.concat_ws(" ", "p_name", "p_type")).alias("ws"))
    return classify.word_index(words, "owner", F.col("ws"))


@query(f"WITH {SECTIONS_SQL} SELECT section_id, office_id, row_number() OVER (PARTITION BY office_id, year ORDER BY income DESC, section_id) AS place FROM sections")
def o9_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir).withColumn("g", F.concat_ws("-", F.col("office_id").cast("string"), F.col("year").cast("string")))
    return graph.with_places(rows, "g", [F.col("income").desc(), F.col("section_id")]).select("section_id", "office_id", "place")


@query("""WITH RECURSIVE s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
    f(o_custkey, k, o_orderkey, last) AS (SELECT o_custkey, k, o_orderkey, o_orderkey FROM s WHERE k = 1 UNION ALL SELECT s.o_custkey, s.k, s.o_orderkey, CASE WHEN s.o_orderkey < f.last + 200 THEN s.o_orderkey ELSE f.last END FROM f JOIN s ON s.o_custkey = f.o_custkey AND s.k = f.k + 1)
    SELECT o_custkey, o_orderkey FROM f WHERE last = o_orderkey""")
def w19_until_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.until_gap(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 200)


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'section' ELSE 'person' END AS record_type, user_id AS record_id, count(*) AS req_freq FROM events WHERE event_type <> 'error' AND event_id % 5 > 0 AND event_id % 7 > 0 GROUP BY ALL HAVING count(*) >= 3""")
def s27_a32_page_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a web server's log made of events; errors, bots and posts don't count, nor do broken lines."""
    e = F.col("event_id")
    path = F.concat(F.when(e % 2 == 0, "/section/").otherwise("/person/"), F.col("user_id").cast("string"), F.when(e % 3 == 0, "/").otherwise(""))
    line = F.concat(
        F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), F.when(e % 7 == 0, "POST ").otherwise("GET "), path, F.lit(' HTTP/1.1" '),
        F.when(F.col("event_type") == "error", "404").otherwise("200"), F.lit(' 512 "-" "'), F.when(e % 5 == 0, "Googlebot/2.1").otherwise("Mozilla/5.0"), F.lit('"'))
    lines = table(spark, sf_dir, "events").select(line.alias("value")).unionByName(table(spark, sf_dir, "region").select(F.lit("broken line").alias("value")))
    return files.page_frequency(files.access_log(lines))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linestatus = 'F' THEN 'фамилия имя' ELSE 'x' END AS text FROM lineitem), s AS (SELECT doc_id FROM c GROUP BY doc_id HAVING count(*) >= 5 AND sum(length(text)) >= 30) SELECT doc_id, count(*) AS cells FROM c WHERE doc_id IN (SELECT doc_id FROM s) GROUP BY doc_id""")
def x39_relevant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("tbl"), F.when(F.col("l_linestatus") == "F", "фамилия имя").otherwise("x").alias("text"))
    return tables.relevant(cells).groupBy("doc_id").agg(F.count("*").alias("cells"))


@query("""WITH r AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderpriority, round(o_totalprice, 2) AS income FROM orders), k AS (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 'S' ELSE 'D' END AS kind FROM r),
    p AS (SELECT *, CAST(sum(CASE WHEN kind = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row) AS BIGINT) AS person_index FROM k), x AS (SELECT *, CAST(sum(CASE WHEN kind = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, person_index ORDER BY row) AS BIGINT) AS relative_index FROM p)
    SELECT doc_id, person_index, kind AS relative, relative_index, arg_min(income, row) AS income FROM x GROUP BY ALL""")
def x29_first_incomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table with declarants and their spouses; each one's first income wins."""
    from pyspark.sql import Window

    low = F.col("o_orderpriority") == "5-LOW"
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    amount = F.translate(F.format_number(F.round("o_totalprice", 2), 2), ",.", " ,")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).alias("tbl"), F.row_number().over(w).alias("row"), F.when(low, "Супруга").otherwise(F.concat(F.lit("Иванов Иван № "), F.col("o_orderkey").cast("string"))).alias("name"),
        amount.alias("income"), none.alias("position"), none.alias("realty"), none.alias("square"), none.alias("country"), none.alias("vehicle"))
    return tables.first_incomes(tables.persons(rows)).select("doc_id", "person_index", "relative", "relative_index", "income")
