"""Queries on crawls: links judged by their features, best-first visits over stored pages, shortest ways between real keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions import urls
from assetlens.operators import crawl, frontier, link_features
from assetlens.registry import query
from assetlens.sources.tables import table

#: Kinds of links that orders are written as: text, address (an order's key follows), page's address, page's title, page's text, and the
#: case and weight that must come out.
KINDS = [
    ("Сведения о доходах за 2018 год", "http://a.ru/p/", "http://b.ru/", "", "", 0, 115.0),
    ("2017", "http://a.ru/dohod/", "http://b.ru/", "", "Противодействие коррупции", 1, 56.0),
    ("Справки за 2016 год", "http://a.ru/svedeniya/", "http://b.ru/", "", "", 2, 25.0),
    ("Начальник отдела", "http://a.ru/n/", "http://b.ru/", "", "все о доходах", 3, 0.0),
    ("Прошлые годы", "http://a.ru/income/", "http://b.ru/", "Отчеты о доходах", "", 4, 50.0),
    ("Управление делами", "http://a.ru/u/", "http://b.ru/", "", "", 5, 1.0),
    ("Лесной район", "http://a.ru/r/", "http://b.ru/", "", "", 6, 1.0),
    ("Архив", "http://a.ru/modules.php?name=anticorruption&rid=", "http://b.ru/", "", "", 7, 51.0),
    ("Новости о доходах", "http://a.ru/dohod/", "http://b.ru/", "", "", None, None),
    ("Приказ за 2015 год", "http://a.ru/dohod/", "http://b.ru/", "", "о доходах", None, None),
    ("Сведения о доходах", "http://a.ru/film.mp4?", "http://b.ru/", "", "о доходах", None, None),
    ("Скачать", "http://a.ru/x/", "http://b.ru/", "", "о доходах", 1, 0.0),
    ("Сводка", "http://www.a.ru/s/", "https://a.ru/s.html", "", "в доходе", 1, 0.0),
    ("Расписание", "http://a.ru/t/", "http://b.ru/", "", "", None, None),
]


@query("SELECT o_orderkey, " + ", ".join(f"CASE o_orderkey % {len(KINDS)} " + " ".join(f"WHEN {k} THEN {'NULL' if x[i] is None else x[i]}" for k, x in enumerate(KINDS)) + f" END::{kind} AS {name}" for i, name, kind in ((5, '"case"', "INTEGER"), (6, "weight", "DOUBLE"))) + " FROM orders")
def g2_g3_judged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links written from orders, with their case and weight by thirteen features."""
    k = (F.col("o_orderkey") % len(KINDS)).cast("int")
    pick = lambda i: F.get(F.array(*(F.lit(x[i]) for x in KINDS)), k)
    seen = link_features.judged(pick(0), F.concat(pick(1), F.col("o_orderkey").cast("string")), pick(2), pick(3), pick(4))
    return table(spark, sf_dir, "orders").select("o_orderkey", seen.alias("x")).select("o_orderkey", "x.case", "x.weight")


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages").select("url", "html")
    links = crawl.links(pages, "url", "html").filter(urls.usable_link(F.col("dst")))
    return pages.select(urls.host(F.col("url")).alias("site"), "url", F.lit(0.0).alias("weight")), links.select("src", "dst", F.length("anchor").cast("double").alias("weight"))


@query()
def g4_best_first_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight visits of every host: all of its pages are known from the start, links with long texts are the better ones."""
    return frontier.best_first(*_pages(spark, sf_dir), budget=8)
