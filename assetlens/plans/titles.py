"""A query on titles of declarations, which are written from orders in six notations and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions import titles
from assetlens.registry import query
from assetlens.sources.tables import table

PEOPLE = ["Осиповой Веры Павловны", "Зуева Петра Ильича", "Лаврова Олега Борисовича"]
ORGS = ["городской больницы № 3", "школы искусств", "комитета по делам молодежи"]


@query(r"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, CAST(year(o_orderdate) AS VARCHAR) AS y, ['Осиповой Веры Павловны', 'Зуева Петра Ильича', 'Лаврова Олега Борисовича'][o_custkey % 3 + 1] AS p,
        ['городской больницы № 3', 'школы искусств', 'комитета по делам молодежи'][o_orderkey // 6 % 3 + 1] AS org FROM orders)
    SELECT id, ['Сведения', 'СПРАВКА', 'Информация', 'Уточненные сведения', 'Сведения', 'Сведения'][k + 1] AS type,
        ['доходах,расходах,имуществе,обязательствах имущественного характера', 'доходах', 'доходах,имуществе', 'расходах', 'доходах', 'доходах'][k + 1] AS objects,
        CASE k WHEN 0 THEN 'за период с 1 января по 31 декабря ' || y || ' года' WHEN 2 THEN 'за отчетный период с 01.01.' || y || ' по 31.12.' || y WHEN 5 THEN NULL ELSE 'за ' || y || ' год' END AS time,
        ['руководителями', 'лиц, замещающих муниципальные должности', 'исполняющего обязанности директора', NULL, 'служащих', NULL][k + 1] AS positions, CASE k WHEN 1 THEN 'Омской области' END AS region,
        CASE WHEN k IN (2, 3) THEN p END AS person, CASE k WHEN 3 THEN '' WHEN 5 THEN 'территориального управления Омской области' ELSE org END AS org FROM o""")
def c14_parsed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, objects, time, positions, region, person and office of every title."""
    key, pick = F.col("o_orderkey"), lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))
    year, person, org = F.year("o_orderdate").cast("string"), pick(PEOPLE, F.col("o_custkey") % 3), pick(ORGS, F.floor(key / 6) % 3)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    written = [
        say("Сведения о доходах, расходах, об имуществе и обязательствах имущественного характера за период с 1 января по 31 декабря ", year, " года, представленные руководителями ", org),
        say("СПРАВКА о доходах\n лиц, замещающих муниципальные должности Омской области, ", org, " за ", year, " год, утверждена"),
        say("Информация о доходах и об имуществе исполняющего обязанности директора ", org, "  ", person, " и членов его семьи за отчетный период с 01.01.", year, " по 31.12.", year),
        say("Уточненные сведения о расходах ", person, " за ", year, " год"),
        say("Приложение 5. Сведения о доходах служащих в ", org, ", а также его супруги и несовершеннолетних детей за ", year, " год"),
        say("Сведения о доходах территориального управления Омской области"),
    ]
    title = F.coalesce(*(F.when(key % 6 == k, t) for k, t in enumerate(written)))
    t = F.col("t")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), titles.parsed(title).alias("t")).filter("t is not null")
    joined = lambda c: F.when(t[c].isNotNull(), F.array_join(t[c], ",")).alias(c)
    return rows.select("id", "t.type", joined("objects"), "t.time", joined("positions"), "t.region", "t.person", "t.org")
