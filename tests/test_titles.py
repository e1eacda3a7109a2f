from pyspark.sql import functions as F

from assetlens.functions import titles


def test_titles(spark):
    cases = {
        "": None, None: None, "Протокол заседания": None, "Сведения о погоде": None,
        "СВЕДЕНИЯ о доходах, об имуществе и обязательствах имущественного характера лица, замещающего государственную должность Томской области, Зуева Петра Ильича и членов его семьи":
            ("СВЕДЕНИЯ", ["доходах", "имуществе", "обязательствах имущественного характера"], None, ["лица, замещающего государственную должность"], "Томской области", "Зуева Петра Ильича", ""),
        "Приложение 1 Сведения о доходах депутатов думы за 2015 год": ("Сведения", ["доходах"], "за 2015 год", ["депутатов"], None, None, "думы"),
        "о доходах работников музея": (None, ["доходах"], None, ["работников"], None, None, "музея"),
        "Сведения о доходах за 2011 год Осипова Вера Павловна": ("Сведения", ["доходах"], "за 2011 год", None, None, "Осипова Вера Павловна", ""),
        "Сведения о доходах лиц, замещающих муниципальные должности и лиц, замещающих должности в думе": ("Сведения", ["доходах"], None, ["лиц, замещающих муниципальные должности", "лиц, замещающих должности"], None, None, "думе"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", titles.parsed(F.col("t")).alias("x")).collect()
    assert {r.t: None if r.x is None else tuple(r.x) for r in rows} == cases
