"""Literal cases of functions, and small ones of sources, tables, graphs, search and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from assetlens.functions import names, realty, text, urls
from assetlens.operators import crawl, graph, integrate, ordered, profiles, resolve, tables
from assetlens.sources import files
from assetlens.streaming import events


def each(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v")).alias("x")).collect()]


def test_numbers(spark):
    assert each(spark, text.roubles, ["1 039 300,94", "1 039 300 94", "120 тыс.", "5 руб. 7 коп.", "нет", None, "99999999999"]) == [1039300.94, 1039300.94, 120000.0, 5.07, None, None, None]
    assert each(spark, text.square, ["45,3 кв. м", "0,5 га", "0", "1 200", "-"]) == [45.3, 5000.0, None, 1200.0, None]
    assert each(spark, text.year_in, ["in 1979 and 2015", "20151", None]) == [2015, None, None]
    assert each(spark, text.title_year, ["на 31 декабря 2017 года", "за 2016 год (от 01.02.2018)", "01.02.2018 отчет 2015", "x"]) == [2017, 2016, 2015, None]
    assert each(spark, text.seconds, ["14h", "3m", "7", "2d"]) == [50400, 180, 7, 172800]
    assert each(spark, text.is_empty_value, ["—", " нет ", "дом", None, ""]) == [True, True, False, True, True]
    assert each(spark, text.trigrams, ["ab"]) == [["^ab", "ab$"]]


def test_names(spark):
    got = each(spark, names.resolved, ["Иванов Иван Иванович", "Иван Иванович Иванов", "Иванов И.И.", "И. И. Иванов", "Иванов И", "Сёмин Пётр", "12. Петрова Анна Львовна", "a b c d"])
    assert [None if x is None else tuple(x) for x in got] == [("иванов", "иван", "иванович"), ("иванов", "иван", "иванович"), ("иванов", "и", "и"), ("иванов", "и", "и"), ("иванов", "и", None), ("семин", "петр", None), ("петрова", "анна", "львовна"), None]
    rows = spark.createDataFrame([("Иванов И.И.", "Иванов Иван Иванович", True), ("Иванов И.П.", "Иванов Иван Иванович", False), ("Иванов И", "Иванов Иван", True), ("Петров И", "Иванов Иван", False)], "a string, b string, y boolean")
    assert all(r.x == r.y for r in rows.select(names.compatible(names.resolved(F.col("a")), names.resolved(F.col("b"))).alias("x"), "y").collect())
    assert each(spark, lambda c: names.gender(names.resolved(c)), ["Петрова Анна Львовна", "Ким Олег Ильич", "Смирнова Женя"]) == ["f", "m", "f"]
    assert each(spark, names.relative, ["Супруга", "несовершеннолетний ребенок", "Иванов И.И.", None]) == ["S", "C", "D", None]


def test_realty(spark):
    got = each(spark, realty.records, ["Квартира 54,5 кв.м, общая долевая 1/3, Россия; земельный участок 1 200 кв. м Украина", "нет", None])
    assert [tuple(x) for x in got[0]] == [("квартира", "общая долевая", 0.333333, 54.5, "россия"), ("земельный участок", None, None, 1200.0, "украина")]
    assert got[1] == [] and not got[2]
    assert each(spark, realty.squares, ["10,5\n20", "7 000 000 кв.м"])[1] == []


def test_urls(spark):
    assert each(spark, urls.host, ["https://www.A.ru:80/x?y", "//b.gov.ru", "mailto:x"]) == ["a.ru", "b.gov.ru", ""]
    pairs = spark.createDataFrame([("a.x.gov.ru", "b.x.gov.ru", True), ("x.gov.ru", "y.gov.ru", False), ("a.site.ru", "site.ru", True), ("a.ru", "b.ru", False)], "a string, b string, y boolean")
    assert all(r.x == r.y for r in pairs.select(urls.same_site(F.col("a"), F.col("b")).alias("x"), "y").collect())
    assert each(spark, urls.usable_link, ["#x", "a.pdf", "p.jpg", None, "mailto:q"]) == [False, True, False, False, False]


def test_table_to_persons(spark):
    page = """<table><tr><th>№</th><th>ФИО</th><th>Должность</th><th>Доход</th><th colspan=2>Площадь</th></tr>
      <tr><td>1</td><td rowspan=1>Иванов И.И.</td><td>глава</td><td>1 000,50</td><td>50 кв. м</td><td></td></tr>
      <tr><td></td><td>супруга</td><td></td><td>-</td><td>70</td><td></td></tr>
      <tr><td>2</td><td>Петров П.П.</td><td>врач</td><td>7</td><td>нет</td><td></td></tr></table>"""
    cells = tables.html_cells(spark.createDataFrame([(1, page), (2, None), (3, "<table><tr><td>x")], "page_id bigint, html string"), "page_id", "html")
    got = tables.persons(tables.records(tables.grid(tables.relevant(cells)))).orderBy("row").collect()
    assert [(r.person_index, r.declarant, r.relative, r.relative_index, r.income, r.square) for r in got] == [(1, "Иванов И.И.", "D", 0, 1000.5, 50.0), (1, "Иванов И.И.", "S", 1, None, 70.0), (2, "Петров П.П.", "D", 0, 7.0, None)]


def test_graph(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    nodes = spark.range(1, 41).union(spark.createDataFrame([(100,), (101,), (7000,)], "id bigint"))
    assert {r.id: r.cluster for r in graph.connected(nodes, links).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 7000: 7000}
    over = spark.createDataFrame([("b", 1, 10, 5, 1), ("b", 1, 11, 5, 2), ("b", 2, 10, 4, 1), ("b", 2, 11, 3, 1)], "block string, p bigint, c bigint, n bigint, least bigint")
    assert {(r.p, r.c) for r in graph.greedy_pairs(over, "block", "p", "c", "n", "least").collect()} == {(1, 10), (2, 11)}


def test_order(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 100, 350, 450, 500)], "g string, v int")
    assert sorted(r.v for r in ordered.until_gap(rows, "g", "v", 200).collect()) == [1, 100]
    counts = spark.createDataFrame([(chr(97 + i), 10) for i in range(6)], "k string, n bigint").coalesce(1)
    got = sorted(map(tuple, ordered.key_ranges(counts, "k", "n", 20).collect()))
    assert got == [("a", "b", 20), ("c", "d", 20), ("e", "f", 20)]


def test_hot_block_gives_all_pairs(spark):
    records = spark.range(300).select("id", F.lit("x").alias("block"))
    got = resolve.pairs(records, "block", "id").select("l.id", F.col("r.id").alias("other")).collect()
    assert len(got) == 300 * 299 // 2 and {(r[0], r[1]) for r in got} == {(i, j) for i in range(300) for j in range(i + 1, 300)}


def test_search_falls_back(spark):
    rows = spark.createDataFrame([(1, "a", "tax office"), (2, "b", "tax court")], "id int, rubric string, name string")
    assert [r.id for r in crawl.searched(rows, {"rubric": "z"}, {"name": "tax"}, [F.col("id")], optional=("rubric",)).collect()] == [1, 2]


def test_files(spark, tmp_path):
    line = '1.2.3.4 - - [10/Oct/2020:13:55:36 +0000] "GET /person/17 HTTP/1.1" 200 2326 "-" "Mozilla"'
    log = files.access_log(spark.createDataFrame([(line,)] * 3 + [("junk",), (line.replace("Mozilla", "Googlebot"),)], "value string"))
    assert [tuple(r) for r in files.page_frequency(log).collect()] == [("person", 17, 3)]
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="B1" t="inlineStr"><is><t>hi</t></is></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "in/b.docx").write_bytes(b"no zip")
    cells = files.office_cells(files.binary(spark, str(tmp_path / "in")))
    assert {(r.path.rsplit("/", 1)[1], r.col, r.text, r.error) for r in cells.collect()} == {("a.xlsx", 1, "hi", None), ("a.xlsx", 2, "5", None), ("b.docx", None, None, "BadZipFile")}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/1.txt", "one")
    got = files.expanded(spark.createDataFrame([("z", buffer.getvalue()), ("y", b"")], "path string, content binary")).collect()
    assert [(r.path, r["index"], r.name, bytes(r.content)) for r in got] == [("z", 0, "x/1.txt", b"one")]


def test_streams(spark, tmp_path):
    schema = "key string, version int, value string, ts timestamp"
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, version int, value string").withColumn("ts", F.current_timestamp())
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        events.upserted(events.read(spark, f"{tmp_path}/in", schema), "key", "version", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        spark.createDataFrame([("a", 3, "w")], "key string, version int, value string").withColumn("ts", F.current_timestamp()).write.mode("append").parquet(f"{tmp_path}/in")
    assert {(r.key, r.value) for r in events.latest(spark, f"{tmp_path}/out", "key", "version").collect()} == {("a", "w"), ("b", "z")}


def test_votes_and_keys(spark):
    votes = spark.createDataFrame([(1, "y"), (1, "y"), (1, "n"), (2, "y"), (2, "n"), (3, "n")], "t int, a string")
    assert {(r.t, r.majority, r.unanimous) for r in integrate.voted(votes, "t", "a").collect()} == {(1, "y", False), (2, None, False), (3, "n", True)}


def test_amount_links_find_what_all_pairs_find(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.choice("xy"), r.choice([100.0, 100.0, 101.0, 104.0, r.uniform(50, 200)])) for i in range(80)] + [(90, "x", None), (91, None, 5.0)]
    records = spark.createDataFrame(rows, "id bigint, block string, amount double")
    got = {x.id: (x.cluster, x.score) for x in resolve.clusters(records, profiles.amount_links(records, ["block"], "id", "amount"), "id", 0.98).collect()}
    near = [(a[0], b[0], round(min(a[2], b[2]) / (max(a[2], b[2]) + 1e-9), 6)) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and a[2] and b[2]]
    near = [(a, b, p) for a, b, p in near if p >= 0.98]
    label = {x[0]: x[0] for x in rows}
    for _ in rows:
        for a, b, _p in near:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {i: (label[i], max((p for a, _b, p in near if a == i), default=None)) for i in label}


def test_profiles(spark):
    words = spark.createDataFrame([("ab c",), ("",), (None,), ("z" * 40,)], "t string")
    h = 0
    for _ in range(40):
        h = (31 * h + ord("z")) % 2**32
    assert [r[0] for r in words.select(profiles.text_hash(F.col("t"))).collect()] == [(97 * 31 + 98) * 31 + 99, 0, None, h - 2**32 if h >= 2**31 else h]
    empty = spark.createDataFrame([], "g int, i int, k string, v bigint")
    assert profiles.run_sums(empty, ["g"], [F.col("i")], "k", "v").collect() == []
    runs = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "a", 3), (1, 3, None, 4), (1, 4, None, 1), (1, 5, "a", 1)], empty.schema)
    assert sorted((r.run, r.k, r.total) for r in profiles.run_sums(runs, ["g"], [F.col("i")], "k", "v").collect()) == [(1, "a", 5), (2, None, 5), (3, "a", 1)]
    history = spark.createDataFrame([(1, 5, 5), (2, 4, 5), (3, 6, 1)], "t int, a int, b int")
    assert sorted((r.t, r.metric) for r in profiles.falls(history, "t", ["a", "b"]).collect()) == [(2, "a"), (3, "b")]
