"""Rules kept as data: messages of a schema, labels overridden, offices of sites."""

from pyspark.sql import functions as F

from assetlens.operators import rules


def test_messages_of_a_schema(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}, "c": {"type": ["boolean", "null"]}}}
    cases = {
        '{"a": 2, "b": [], "c": null}': [], '{"a": 1, "b": ["x", "z", 5], "c": true, "more": 1}': ["$.a: below 2", "$.b[1]: not one of x, y", "$.b[2]: not of type string", "$.b[2]: not one of x, y"],
        "{}": ["$.a: missing", "$.b: missing"], "[1]": ["$: not of type object"], "{": ["$: no JSON"], '{"a": "1", "b": {}, "c": 0}': ["$.a: not of type integer", "$.b: not of type array", "$.c: not of type boolean or null"], None: [],
    }
    rows = spark.createDataFrame([(c,) for c in cases], "j string").select("j", rules.schema_messages(F.col("j"), schema).alias("m")).collect()
    assert {r.j: r.m for r in rows} == cases


def test_first_of_several_keys_and_overrides(spark):
    row = spark.createDataFrame([('{"a": {"b": 1}, "c": "", "d": [2]}',), (None,)], "j string").select(rules.projected(F.col("j"), {"x": ["$.z", "$.a.b"], "y": ["$.c", "$.d"], "z": ["$.q"]}).alias("x")).collect()
    assert [tuple(r.x) for r in row] == [("1", "[2]", None), (None, None, None)]
    rows = spark.createDataFrame([(1, "town", "School No 5"), (2, "town", "Court"), (3, None, "School"), (4, "law", None)], "id int, label string, t string")
    table = spark.createDataFrame([(2, "town", "school", "education"), (1, None, "court", "law"), (3, "town", ".", "late")], "priority int, old string, pattern string, new string")
    assert {r.id: r.label for r in rules.overridden(rows, "label", "t", table).collect()} == {1: "education", 2: "law", 3: None, 4: "law"}


def test_offices_of_sites(spark):
    refs = spark.createDataFrame([(1, "http://www.a.ru/x"), (2, "http://b.a.ru"), (3, "https://old.ru"), (4, "http://c.b.a.ru"), (5, None), (6, "no url")], "id int, url string")
    sites = spark.createDataFrame([("A.ru", 10), ("www.a.ru", 11), ("new.ru", 12)], "host string, office int")
    redirects = spark.createDataFrame([("www.old.ru", "new.ru"), ("c.b.a.ru", "new.ru")], "host string, to string")
    got = {r.id: (r.office, r.by) for r in rules.offices_of_sites(refs, "url", sites, redirects).collect()}
    assert got == {1: (10, "site"), 2: (10, "parent site"), 3: (12, "redirect"), 4: (12, "redirect"), 5: (None, None), 6: (None, None)}
