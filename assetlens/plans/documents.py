"""Queries on pages, logs, names, search, streams and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.operators import crawl, profiles, resolve, tables
from assetlens.registry import query
from assetlens.sources.tables import SECTIONS_SQL, sections, table
from assetlens.streaming import events as streams


@query()
def s17_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.links(table(spark, sf_dir, "pages"), "url", "html")


@query()
def g2_link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.scored_links(s17_page_links(spark, sf_dir))


@query()
def x38_html_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid(tables.html_cells(table(spark, sf_dir, "pages"), "page_id", "html"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def c43_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query(r"""WITH d AS (SELECT doc_id, source, lower(coalesce(text, '')) AS t FROM documents), n AS (SELECT *, len(regexp_extract_all(t, '\d{4,}')) AS n_number, len(regexp_extract_all(t, '@')) AS n_at, len(regexp_extract_all(t, 'licen[cs]e')) AS n_license FROM d),
    v AS (SELECT *, CASE WHEN n_license > 0 OR (n_number = 0 AND n_at = 0) THEN 'NEGATIVE' WHEN n_number > 0 AND n_at > 0 THEN 'POSITIVE' ELSE 'UNKNOWN' END AS verdict FROM n)
    SELECT doc_id, n_number, n_at, n_license, verdict, CASE WHEN source IS NOT NULL AND count(*) FILTER (verdict = 'POSITIVE') OVER (PARTITION BY source) > 1 THEN 'POSITIVE' ELSE verdict END AS final FROM v""")
def m9_m10_recogniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"number": r"\d{4,}", "at": "@", "license": "licen[cs]e"}
    seen = crawl.recognised(table(spark, sf_dir, "documents"), "text", rules, ["number", "at"], ["license"])
    return crawl.archive_rule(seen, "source", "verdict").select("doc_id", *(F.col(f"n_{k}").cast("bigint").alias(f"n_{k}") for k in rules), "verdict", "final")


@query(f"WITH {SECTIONS_SQL} SELECT section_id, person_name, year, income FROM sections WHERE rubric = 'BUILDING' AND year IN (1996, 1997) ORDER BY income DESC, section_id LIMIT 20 OFFSET 20")
def f8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("income").desc(), F.col("section_id")]
    return crawl.searched(sections(spark, sf_dir), {"rubric": "BUILDING", "year": [1996, 1997]}, None, order, page=1).select("section_id", "person_name", "year", "income")


@query("SELECT doc_id FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '\\W+'), ['the', 'and'])) = 2")
def f9_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(T.all_tokens(F.col("text"), ["the", "and"])).select("doc_id")


@query("""SELECT CAST(epoch(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY ALL""")
def t4_call_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.call_windows(table(spark, sf_dir, "events")).withColumn("start", F.unix_timestamp("start"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM k GROUP BY user_id, k""")
def t4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query(f"""WITH {SECTIONS_SQL}, o AS (SELECT section_id AS id, office_id, year, status, income, lag(income) OVER w AS x, lead(income) OVER w AS z FROM sections WINDOW w AS (PARTITION BY office_id, year, status ORDER BY income, section_id)),
    p AS (SELECT *, round(x / (income + 1e-9), 6) AS p, round(income / (z + 1e-9), 6) AS q FROM o),
    k AS (SELECT *, sum(CASE WHEN p >= 0.98 THEN 0 ELSE 1 END) OVER (PARTITION BY office_id, year, status ORDER BY income, id ROWS UNBOUNDED PRECEDING) AS k FROM p)
    SELECT id, min(id) OVER (PARTITION BY office_id, year, status, k) AS cluster, greatest(CASE WHEN p >= 0.98 THEN p END, CASE WHEN q >= 0.98 THEN q END) AS score FROM k""")
def e1_e4_resolved_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of one office, year and status within two percent of an income are taken for one person's."""
    records = sections(spark, sf_dir).select(F.col("section_id").alias("id"), "office_id", "year", "status", "income")
    return resolve.clusters(records, profiles.amount_links(records, ["office_id", "year", "status"], "id", "income"), "id", 0.98)
