"""Queries on the second pass. The driver's tables hold no declarations, so cells are written from their values in the notations that
declarations use, and parsed again; the SQL gives the values themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.operators import second_pass as S
from assetlens.plans.people import NAMED_SQL, named_sections
from assetlens.registry import query
from assetlens.sources.tables import table

TYPES, OWN = ["Земельный участок", "Квартира", "Жилой дом", "Гараж"], ["Индивидуальная", "Долевая", "Аренда"]
POSITIONS = ["начальник управления", "ведущий специалист", "заместитель министра", "директор департамента"]


def amount(value: F.Column) -> F.Column:
    """1 234 567,89"""
    return F.translate(F.format_number(value, 2), ",.", " ,")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'income_thousands' WHEN 1 THEN 'income' WHEN 2 THEN 'declarant_income_thousands' WHEN 3 THEN 'declarant_income' WHEN 4 THEN 'monthly_income' ELSE 'monthly_income_thousands' END AS field,
    round(round(o_totalprice, 2) * CASE o_orderkey % 6 WHEN 0 THEN 1000 WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 1000 END WHEN 4 THEN 12 WHEN 5 THEN 12000 ELSE 1 END, 2) AS size FROM orders""")
def x28_income_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row has its income in one of six columns; where a document's amounts are plain, the third column's are not in thousands."""
    k, cell = F.col("o_orderkey") % 6, amount(F.round("o_totalprice", 2))
    fields = [f for f, _, _ in S.INCOME_FIELDS]
    forms = [F.concat(cell, F.lit(" тыс.руб.")), cell, cell, F.concat(cell, F.lit(" руб.")), cell, cell]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *(F.when(k == i, form).when(k > i, F.lit("-")).alias(f) for i, (f, form) in enumerate(zip(fields, forms, strict=True))))
    found = S.income(fields, (F.col("o_orderkey") % 5 == 0) & (k == 2))
    return rows.select(F.col("o_orderkey").alias("id"), found.alias("i")).select("id", "i.field", "i.size")


@query("""WITH d AS (SELECT l_orderkey AS doc, round(l_extendedprice, 2) AS x FROM lineitem), m AS (SELECT doc, list_sort(list(x))[len(list(x)) // 2 + 1] AS middle, count(*) AS n FROM d GROUP BY doc)
    SELECT doc, round(sum(x * CASE WHEN m.n > 3 AND middle > 30000 THEN 1 ELSE 1000 END), 2) AS total FROM d JOIN m USING (doc) GROUP BY doc""")
def x27_scaled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in thousands of documents whose middle amount is large are plain after all; the others' amounts are scaled."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), amount(F.round("l_extendedprice", 2)).alias("income_thousands"))
    values = cells.withColumn("x", T.roubles(F.col("income_thousands")))
    lists = values.groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    plain = lists.select("doc", ((F.size("xs") > 3) & (F.get("xs", F.floor(F.size("xs") / 2).cast("int")) > 30_000)).alias("plain"))
    sized = cells.join(plain, "doc").select("doc", S.income(["income_thousands"], F.col("plain"))["size"].alias("size"))
    return sized.groupBy("doc").agg(F.round(F.sum("size"), 2).alias("total"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN p_type WHEN 3 THEN NULL ELSE '' END AS type, CASE p_partkey % 4 WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN NULL ELSE '' END AS model,
    CASE p_partkey % 4 WHEN 1 THEN p_type || ' ' || p_name ELSE p_name END AS text FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, '', p_brand, p_brand FROM part WHERE p_partkey % 4 = 2""")
def x30_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column, type and model, or several models between empty lines; 'не имеет' is none."""
    k, part = F.col("p_partkey") % 4, table(spark, sf_dir, "part")
    apart = part.filter(k.isin(0, 1, 2)).select(
        F.col("p_partkey").alias("id"), F.when(k == 1, F.col("p_type")).otherwise(F.lit("не имеет")).alias("vehicle_type"),
        F.when(k == 0, F.lit("не имеет")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" \n\n\n"), F.col("p_brand"))).alias("vehicle_model"))
    single = part.filter(k == 3).select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(" не имеет")).alias("vehicle"))
    rows = apart.select("id", F.explode(S.vehicles(apart.columns)).alias("v")).unionByName(single.select("id", F.explode(S.vehicles(single.columns)).alias("v")))
    return rows.select("id", "v.text", "v.type", "v.model")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of real-estate cells for each order: its lineitems' types, kinds of ownership, squares and country, in one of five notations."""
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))
    item = F.struct("l_linenumber", "l_partkey", pick(TYPES, F.col("l_partkey") % 4).alias("t"), pick(OWN, F.col("l_partkey") % 3).alias("o"), F.translate(F.format_number(F.col("l_quantity") + 10.5, 1), ".", ",").alias("s"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    k = F.col("id") % 5
    plain = lambda name, sign: F.array_join(F.transform("xs", lambda x: x[name]), sign)
    numbered = lambda name: F.array_join(F.transform("xs", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x[name])), "\n")
    form = lambda name: F.when(k == 0, numbered(name)).when(k == 1, F.concat(F.lit("- "), plain(name, "\n- "))).when(k == 2, plain(name, "\n\n")).when(k == 3, plain(name, "; ")).otherwise(plain(name, "\n"))
    alone = F.size("xs") == 1
    squares = plain("s", "\n")
    swapped = alone & (F.col("id") % 2 == 0)
    return rows.select("id", F.when(alone, plain("t", "")).otherwise(form("t")).alias("types"), F.when(alone, plain("o", "")).otherwise(form("o")).alias("own"), F.when(swapped, F.lit("Россия")).otherwise(squares).alias("square"), F.when(swapped, squares).otherwise(F.lit("Россия")).alias("country"))


_ESTATES = """WITH x AS (SELECT l_orderkey AS id, ['Земельный участок', 'Квартира', 'Жилой дом', 'Гараж'][l_partkey % 4 + 1] AS type, ['Индивидуальная', 'Долевая', 'Аренда'][l_partkey % 3 + 1] AS own_type, l_quantity + 10.5 AS square, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


@query(f"""{_ESTATES} SELECT id, type, own_type, square, 'россия' AS country, 'В собственности' AS by_column FROM x""")
def x31_realty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several items in each cell, numbered, with bullets, by empty lines, semicolons or lines; square and country swapped in some."""
    found = _cells(spark, sf_dir).select("id", F.explode(S.realty("types", "own", "square", "country", owned=True)).alias("r"))
    return found.select("id", "r.type", "r.own_type", "r.square", "r.country", "r.by_column")


@query(f"""{_ESTATES.replace("count(*) OVER", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS k, count(*) OVER")} SELECT id, k, type AS text FROM x WHERE n > 1""")
def x34_split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of cells with several, in order, as they were written."""
    parts = S.split_items(F.col("types"), S.numbered_lines(F.col("square")))
    return _cells(spark, sf_dir).filter(F.size(S.numbered_lines(F.col("square"))) > 1).select("id", F.posexplode(parts).alias("k", "text"))


@query("SELECT l_orderkey AS id, 'квартира' AS type, l_quantity + 10.5 AS square FROM lineitem")
def x32_realty_of_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", F.concat(F.lit("общая долевая, "), F.translate(F.format_number(F.col("l_quantity") + 10.5, 1), ".", ","), F.lit(" кв.м.")).alias("s"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "; ").alias("cell"))
    return rows.select("id", F.explode(S.realty_of_column(F.col("cell"), "apartment")).alias("r")).select("id", "r.type", "r.square")


@query(f"""WITH {NAMED_SQL}, p AS (SELECT *, {"[" + ", ".join(f"'{x}'" for x in POSITIONS) + "]"}[section_id % 4 + 1] AS position FROM named)
    SELECT section_id, CASE WHEN section_id % 4 = 2 THEN family || ' ' || first || '.' || patronymic || '.' ELSE family || ' ' || whole_first || ' ' || whole_patronymic END AS name, position FROM p""")
def x22_names_and_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and position in one cell: one after the other in both orders, with initials and a comma, and with a dash."""
    k, rows = F.col("section_id") % 4, named_sections(spark, sf_dir)
    words = F.split("person_name", r"\s+")
    whole = F.when(k == 1, F.concat_ws(" ", F.get(words, F.lit(2)), F.get(words, F.lit(0)), F.get(words, F.lit(1)))).when(k == 2, F.concat(F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1)), F.get(words, F.lit(2)))).otherwise(F.array_join(words, " "))
    position = F.get(F.array(*map(F.lit, POSITIONS)), k.cast("int"))
    cell = F.when(k == 0, F.concat_ws(" ", F.lit("12."), whole, position)).when(k == 1, F.concat_ws(" ", position, whole)).when(k == 2, F.concat(whole, F.lit(", "), position)).otherwise(F.concat(whole, F.lit(" - "), position))
    found = rows.select("section_id", S.name_and_position(cell).alias("n"))
    return found.select("section_id", F.translate(F.lower("n.name"), "ё", "е").alias("name"), "n.position")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderpriority FROM orders), e AS (SELECT o_custkey, min(k) AS e FROM c WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey)
    SELECT c.o_custkey AS doc_id, count(*) AS rows FROM c LEFT JOIN e USING (o_custkey) WHERE e IS NULL OR k < e GROUP BY c.o_custkey""")
def x43_before_week_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells a row; rows of low priority hold days of the week only, and end the table."""
    days = F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("Понедельник"), F.lit(" ВТОРНИК"))).otherwise(F.array(F.col("o_orderpriority"), F.lit("вторник")))
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("tbl"), F.col("o_orderkey").alias("row"), F.posexplode(days).alias("col", "text"))
    return S.before_week_days(cells).groupBy("doc_id").agg(F.countDistinct("row").alias("rows"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 2000 AND 2020 THEN o_orderkey ELSE o_custkey END AS documentfile_id, CASE WHEN o_custkey NOT BETWEEN 2000 AND 2020 THEN o_orderkey || '.docx' END AS archive_file FROM orders""")
def x37_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/in/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".docx"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.document_id(path).alias("d")).select("o_orderkey", "d.*")


@query("""SELECT o_orderkey, CAST(greatest(2000 + o_orderkey % 20, CASE WHEN o_custkey % 3 = 0 THEN 2000 + o_custkey % 20 END) AS INTEGER) AS year FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, CAST(coalesce(CASE WHEN o_custkey % 3 = 0 THEN 2000 + o_custkey % 20 END, 2000 + o_custkey % 7) AS INTEGER) FROM orders WHERE o_orderkey % 4 = 0""")
def x8_c35_income_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of the title's year and the income column's; where neither has one, the year of the file's name."""
    k, year = F.col("o_orderkey") % 4, (2000 + F.col("o_orderkey") % 20).cast("string")
    title = F.when(k == 1, F.concat(F.lit("Сведения о доходах за период с 1 января по 31 декабря "), year, F.lit(" года"))).when(k == 2, F.concat(F.lit("Сведения за "), year, F.lit(" год, размещены 12.05.2031"))).when(k == 3, F.concat(F.lit("Доходы, "), year)).otherwise(F.lit("Сведения о доходах"))
    column = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Декларированный доход за "), (2000 + F.col("o_custkey") % 20).cast("string"), F.lit(" г. (руб.)"))).otherwise(F.lit("Доход"))
    file = F.concat(F.lit("svedeniya_"), (2000 + F.col("o_custkey") % 7).cast("string"), F.lit(".docx"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.income_year(title, column, file).alias("year"))


@query("""WITH r AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderstatus <> 'F' AS bad FROM orders), s AS (SELECT *, count(*) FILTER (bad) OVER w AS b, count(*) FILTER (NOT bad) OVER w AS g FROM r WINDOW w AS (PARTITION BY doc ORDER BY row))
    SELECT doc, bool_or(b > 3 AND g < 4) AS aborted, count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad) AS declarants FROM s GROUP BY doc""")
def x35_error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("row"), (F.col("o_orderstatus") != "F").alias("bad"))
    return S.error_budget(rows, "doc", F.col("bad"), good=4, errors=3)


@query("""WITH r AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row, l_returnflag, l_linestatus FROM lineitem), k AS (SELECT *, sum(CASE WHEN row = 1 OR l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY row) AS k FROM r)
    SELECT doc, min(row) AS row, string_agg(l_returnflag, ' ' ORDER BY row) AS a, string_agg(l_linestatus, ' ' ORDER BY row) AS b FROM k GROUP BY doc, k""")
def x24_merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of flag N go on from the row before."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("bigint").alias("row"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return S.merged_rows(rows, "doc", "row", (F.col("row") == 1) | (F.col("a") != "N"), "a", "b")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row, l_returnflag, l_partkey FROM lineitem)
    SELECT doc_id, CAST(row + 1 AS INTEGER) AS row, 0 AS col, 2 AS span, l_returnflag AS text FROM r UNION ALL SELECT doc_id, CAST(row + 1 AS INTEGER), 1, 1, CAST(l_partkey AS VARCHAR) FROM r UNION ALL SELECT DISTINCT doc_id, 0, 0, 3, 'ФИО' FROM r""")
def s11_annotated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables kept as JSON, a header cell over two columns and a row for each lineitem, to cells."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    data = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.array(F.struct(x["l_returnflag"].alias("t"), F.lit(2).alias("mc")), F.struct(x["l_partkey"].cast("string").alias("t"), F.lit(None).cast("int").alias("mc"))))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(data.alias("Data"))
    header = F.array(F.array(F.struct(F.lit("ФИО").alias("t"), F.lit(3).alias("mc"))))
    files = files.select("id", F.to_json(F.struct(F.lit("title").alias("Title"), header.alias("Header"), "Data")).alias("json"))
    return S.annotated_cells(files, "id", "json").select("doc_id", "row", "col", "span", "text")


@query("""WITH i AS (SELECT o_custkey AS doc_id, o_orderkey, round(o_totalprice, 2) AS size FROM orders WHERE o_orderstatus <> 'P'), v AS (SELECT o_custkey AS doc_id, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F')
    SELECT doc_id, count(DISTINCT o_orderkey) AS persons FROM (SELECT doc_id, o_orderkey FROM i UNION ALL SELECT * FROM v) GROUP BY doc_id""")
def k1_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations as JSON; those who declare nothing are left out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("person_index"), F.col("o_orderpriority").alias("position"), F.round("o_totalprice", 2).alias("size"), "o_orderstatus")
    goods = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("person_index"))
    vehicles = goods.filter("l_linestatus = 'F'").select("doc_id", "person_index", F.col("l_partkey").cast("string").alias("text"))
    estates = goods.filter("l_linestatus = 'F'").select("doc_id", "person_index", F.col("l_quantity").alias("square"))
    json = S.declarations(o.withColumn("name", F.lit(None).cast("string")), o.filter("o_orderstatus <> 'P'").select("doc_id", "person_index", "size"), estates, vehicles)
    return json.select("doc_id", F.json_array_length(F.get_json_object("json", "$.persons")).cast("bigint").alias("persons"))
