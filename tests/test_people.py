"""Resolution of persons, exact quantiles and orders over all rows, against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from assetlens.functions import text
from assetlens.operators import graph, ordered, profiles, registers, resolve, second_pass, statistics, tables
from assetlens.plans import people


def test_pairs_are_all_pairs_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CELL", 4)
    rows = [(i, "ab"[i % 7 == 0]) for i in range(40)]
    got = resolve.pairs(spark.createDataFrame(rows, "id bigint, block string"), "block", "id").select("l.id", F.col("r.id").alias("r")).collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, a in rows for j, b in rows if a == b and i < j)


def test_single_linkage_cut(spark):
    """Three records: 1 and 3 at 0.8, 2 and 3 at 0.9, names 1 and 2 don't fit: two clusters at 0.89; a chain of 0.99, 0.99 and 0.9: one."""
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    cut = lambda scored: {r.id: (r.cluster, r.score) for r in resolve.clusters(ids, spark.createDataFrame(scored, "a bigint, b bigint, p double"), "id", 0.89).collect()}
    assert cut([(1, 3, 0.8), (2, 3, 0.9), (1, 2, -9999.0)]) == {1: (1, None), 2: (2, 0.9), 3: (2, 0.9)}
    assert cut([(1, 2, 0.99), (2, 3, 0.99), (1, 3, 0.9)]) == {1: (1, 0.99), 2: (1, 0.99), 3: (1, 0.99)}


def test_clusters_of_sums_as_of_all_pairs(spark, monkeypatch):
    """Against plain pairs, in blocks of one and of several cells and tiles."""
    from assetlens.operators import linkage

    r = random.Random(3)
    weights, least = {"xs": 5, "ws": 2}, 12
    rows = [(i, "ab"[i % 3 == 0], [float(r.randrange(25)) for _ in range(r.randrange(5))] or None, [r.choice("abcdefgh") for _ in range(r.randrange(3))], r.choice(["и", "иван", "ив", "пётр", None]), r.choice(["п", "павлович"])) for i in range(150)]
    near = lambda x, y: x is None or y is None or x.startswith(y) or y.startswith(x)
    sums = {}
    for a in rows:
        for b in rows:
            s = 5 * len(set(a[2] or []) & set(b[2] or [])) + 2 * len(set(a[3]) & set(b[3]))
            if a[0] != b[0] and a[1] == b[1] and near(a[4], b[4]) and near(a[5], b[5]) and s >= least:
                sums[a[0], b[0]] = s
    cluster = {x[0]: x[0] for x in rows}
    for _ in rows:
        for a, b in sums:
            cluster[a] = cluster[b] = min(cluster[a], cluster[b])
    want = {i: (c, max((s for (a, _), s in sums.items() if a == i), default=None)) for i, c in cluster.items()}
    assert len(set(cluster.values())) > 3 and any(s is None for _, s in want.values())
    df = spark.createDataFrame(rows, "id bigint, block string, xs array<double>, ws array<string>, first string, patronymic string")
    link = linkage._links
    for cell, tile in ((8192, 1024), (8192, 16), (20, 1024), (20, 4)):
        monkeypatch.setattr(linkage, "CELL", cell)

        def small(*a, tile=tile):
            linkage.TILE = tile
            return link(*a)

        monkeypatch.setattr(linkage, "_links", small)
        got = resolve.clusters_of_sums(df, "block", "id", weights, ["first", "patronymic"], least)
        assert {x.id: (x.cluster, x.best) for x in got.collect()} == want, (cell, tile)


def test_resolution_lists_no_pairs(spark, sf):
    """Clusters take a row per record from a task: all pairs of a block would grow with the square of a name's frequency."""
    assert "Join Inner, (((_b" not in (plan := people.resolved_people(spark, sf)._jdf.queryExecution().optimizedPlan().toString()) and "array_intersect" not in plan


def greedy(found, old, held):
    """As a list sorted by (-overlap, -first section, person, cluster), each person and cluster once."""
    person_of, shared = dict(old), {}
    for i, c, b in found:
        if i in person_of and c not in held:
            shared.setdefault((b, person_of[i]), []).append((c, i))
    rows = []
    for (_, p), xs in shared.items():
        first = min(i for _, i in xs)
        rows += [(-sum(c == k for c, _ in xs), -first, p, k) for k in {c for c, _ in xs}]
    out, persons, clusters = {}, set(), set()
    for _, _, p, k in sorted(rows):
        if p not in persons and k not in clusters:
            out[k] = p
            persons.add(p)
            clusters.add(k)
    return out


def test_reused_ids(spark):
    for seed in range(2):
        r = random.Random(seed)
        found = [(i, 100 * (i % 4) + r.randrange(6), "b%d" % (i % 4)) for i in range(160)]
        old = [(i, 1000 * (i % 4) + r.randrange(5)) for i in range(160) if r.random() < 0.6]
        held = sorted({c for _, c, _ in found if r.random() < 0.2})[:3]
        got = resolve.reused_ids(spark.createDataFrame(found, "id bigint, cluster bigint, block string"), spark.createDataFrame(old, "id bigint, person bigint"), spark.createDataFrame([(c,) for c in held], "cluster bigint"), "block")
        assert {x.cluster: x.person for x in got.collect()} == greedy(found, old, set(held))


def test_cluster_quality(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(12), r.randrange(9)) for i in range(80)]
    got = resolve.cluster_quality(spark.createDataFrame([x[:2] for x in rows], "id bigint, cluster bigint"), spark.createDataFrame([(i, p) for i, _, p in rows], "id bigint, person bigint")).first()
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0]]
    both, same, real = (sum(map(f, pairs)) for f in (lambda x: x[0][1:] == x[1][1:], lambda x: x[0][1] == x[1][1], lambda x: x[0][2] == x[1][2]))
    assert (got.precision, got.recall, got.passes) == (round(both / same, 4), round(both / real, 4), False)


def test_e5_query(spark, sf):
    rows = people.resolved_people(spark, sf).collect()
    status = {r.o_orderkey: r.o_orderstatus for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus").collect()}
    held = {r.cluster for r in rows if status[r.id] == "P"}
    want = greedy([(r.id, r.cluster, r.block) for r in rows], [(r.id, r.person_id) for r in rows if r.id % 3 == 0], held)
    assert {r.cluster: r.person for r in people.e5_reused_ids(spark, sf).collect()} == want and want


def test_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(5)
    rows = [("big", float(x)) for x in rng.integers(0, 500, 30_000)] + [("same", 7.0)] * 5000 + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("three", 1.0), ("three", 5.0), ("three", 9.0), ("none", None)] + [("wide", float(x)) for x in rng.normal(size=4001)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for p in (0.5, 0.9, 0.0):
        got = {r.g: r.q for r in statistics.quantile(df, ["g"], "x", p, "q").collect()}
        want = {g: float(np.quantile([x for k, x in rows if k == g], p)) for g in {k for k, _ in rows} - {"none"}}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want), p


def test_quantiles_hold_if_the_sketch_differs_by_run(spark, monkeypatch):
    """The sketch of a large group depends on the order in which its parts arrive; each time it is worked out it may give other values."""
    rows = spark.createDataFrame([("a", float(x)) for x in range(3000)], "g string, x double")
    spread = F.udf(lambda q: [q[0] - random.SystemRandom().uniform(0, 500), q[1] + 500], "array<double>").asNondeterministic()
    sketch = F.percentile_approx
    monkeypatch.setattr(statistics.F, "percentile_approx", lambda *a: spread(sketch(*a)))
    assert statistics.quantile(rows, ["g"], "x", 0.5, "q").first().q == 1499.5


def test_orders_over_all_rows(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(50)) for i in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k bigint, n bigint").repartition(7)
    total, upto = 0, {}
    for k, n in sorted(rows):
        upto[k] = total = total + n
    assert {x.k: x.s for x in ordered.running_totals(df, [F.col("k")], s="n").collect()} == upto
    assert sum(x.rows for x in ordered.key_ranges(df, "k", "n", 300).collect()) == total
    drawn = registers.drawn(df, "k", "n", 20_000, "s").groupBy("k").count().collect()
    share = {x.k: x["count"] / 20_000 for x in drawn}
    assert sum(share.values()) == 1.0 and all(abs(share.get(k, 0) - n / total) < 0.01 for k, n in rows)


def test_amount_links_go_over_ranges(spark):
    r = random.Random(6)
    rows = [(i, "ab"[i % 5 == 0], float(r.randint(1, 60))) for i in range(400)]
    got = profiles.amount_links(spark.createDataFrame(rows, "id bigint, g string, x double").repartition(9), ["g"], "id", "x").collect()
    want = []
    for g in "ab":
        own = sorted((x, i) for i, k, x in rows if k == g)
        want += [(a, b, round(x / (y + 1e-9), 6)) for (x, a), (y, b) in zip(own, own[1:], strict=False)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_split_items_by_each_rule(spark):
    cases = [
        ("1. Баня\n2. Сарай\n3. Гараж", 3, ["Баня", "Сарай", "Гараж"]), ("1)Баня\n2)Сарай", 2, ["Баня", "Сарай"]), ("1) Баня 2) Сарай", 2, ["Баня", "Сарай"]), ("- Баня\n- Сарай", 2, ["Баня", "Сарай"]),
        ("- Комната (1/3) - Гараж", 2, ["Комната (1/3)", "Гараж"]), ("Комната (в найме) Гараж (в собственности)", 2, ["Комната (в найме)", "Гараж (в собственности)"]),
        ("Баня\n\nСарай\n \n\nГараж", 3, ["Баня", "Сарай", "Гараж"]), ("Баня; Сарай;", 2, ["Баня", "Сарай"]), ("Баня\nСарай", 2, ["Баня", "Сарай"]),
        ("Баня\n \nСарай\n", 2, ["Баня", "Сарай"]), ("10. Баня\n11. Сарай", 2, ["Баня", "Сарай"]), ("Баня", 2, ["Баня"]), ("", 2, []),
    ]
    rows = spark.createDataFrame([(k, c, list(range(n))) for k, (c, n, _) in enumerate(cases)], "k int, c string, n array<int>")
    got = {r.k: list(r.x) for r in rows.select("k", second_pass.split_items(F.col("c"), F.col("n")).alias("x")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}
    over_lines = spark.createDataFrame([("Баня\nиз бревна\nСарай", [0, 2])], "c string, n array<int>")
    assert over_lines.select(second_pass.split_items(F.col("c"), F.col("n"))).first()[0] == ["Баня из бревна", "Сарай"]


def test_cells_let_down_from_rows_above_move_the_others(spark):
    page = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td rowspan=2>d</td></tr><tr><td>e</td><td>f</td></tr></table>"
    placed = tables.grid(tables.html_cells(spark.createDataFrame([(1, page)], "id bigint, html string"), "id", "html"))
    assert {(r.row, r.at, r.span, r.text) for r in placed.collect()} == {(0, 0, 1, "a"), (1, 0, 1, "a"), (0, 1, 2, "b"), (1, 1, 1, "c"), (1, 2, 1, "d"), (2, 2, 1, "d"), (2, 0, 1, "e"), (2, 1, 1, "f")}


def test_tables_are_placed_one_after_the_other(spark):
    """Tables of a task come in a stream, whose batches end within tables; none gets a call of its own."""
    cells = [(d, t, r, c, 1, 2 if c == 0 and r == 0 else 1, f"{d}.{t}.{r}.{c}") for d in range(6) for t in range(2) for r in range(3) for c in range(2)]
    df = spark.createDataFrame(cells, tables.CELL).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        placed = tables.grid(df)
        got = {(x.doc_id, x.tbl, x.row, x.at): (x.text, x.top, x.rows) for x in placed.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = {(0, 0): "0.0", (0, 1): "0.1", (1, 0): "0.0", (1, 1): "1.0", (1, 2): "1.1", (2, 0): "2.0", (2, 1): "2.1"}
    assert got == {(d, t, r, at): (f"{d}.{t}.{x}", int(x[0]), 2 if x == "0.0" else 1) for d in range(6) for t in range(2) for (r, at), x in one.items()}
    assert "FlatMapGroups" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_tops_of_deep_trees(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None, i == 30) for i in range(50)], "id int, parent_id int, stop boolean")
    assert {r.id: r.top_id for r in graph.top_parents(tree, F.col("stop")).collect()} == {i: 30 if i >= 30 else 0 for i in range(50)}
    odd = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 99), (6, 5), (7, 7), (8, None)], "id int, parent_id int")
    assert {r.id: r.top_id for r in graph.top_parents(odd, F.lit(False)).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 5, 6: 5, 7: None, 8: 8}


def test_names_with_positions(spark):
    cases = {
        "Осипова Вера Павловна директор школы": ("Осипова Вера Павловна", "директор школы"), "главный врач Осипова Вера Павловна": ("Осипова Вера Павловна", "главный врач"),
        "Вера Павловна Осипова, главный врач": ("Вера Павловна Осипова", "главный врач"), "Зуев П.К., советник": ("Зуев П.К.", "советник"), "советник Зуев П. К.": ("Зуев П. К.", "советник"),
        "7) П.К. Зуев помощник судьи": ("П.К. Зуев", "помощник судьи"), "12. Ли Анна - повар": ("Ли Анна", "повар"), "повар": None, "": None,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", second_pass.name_and_position(F.col("c")).alias("x")).collect()
    assert {r.c: None if r.x is None else tuple(r.x) for r in rows} == cases


def test_vehicles_and_brands(spark):
    known = F.create_map(*(F.lit(x) for pair in {"toyota": "TOYOTA", "lada": "LADA", "vaz": "LADA", "mercedes": "MERCEDES", "kia": "KIA"}.items() for x in pair))
    rows = spark.createDataFrame([(0, "Легковой автомобиль Toyota Camry"), (1, "ВАЗ-2107, Лада Гранта, КИА Рио"), (2, "Мерседес-Бенц, прицеп"), (3, None)], "k int, s string")
    got = {r.k: (r.b, r.key) for r in rows.select("k", text.brands(F.col("s"), known).alias("b"), text.vehicle_key(F.col("s")).alias("key")).collect()}
    assert got[0][0] == ["TOYOTA"] and got[1] == (["LADA", "KIA"], "vaz2107,ladagranta,kiario") and got[2][0] == [] and got[3] == (None, None)


def test_a_forest_scores_both_orientations(spark):
    from assetlens.operators import classify

    r = random.Random(2)
    rows = []
    for i in range(200):
        same = i % 2
        x = (same * 2 + r.random(), r.random())
        rows += [(2 * i, *x, same), (2 * i + 1, x[0], 1 - x[1], same)]
    df = spark.createDataFrame(rows, "id int, u double, v double, same int")
    scored = classify.learned_pair_scores(df.filter("id % 3 > 0"), df.filter("id % 3 = 0"), ["u", "v"], "same", trees=20)
    assert all((r.p > 0.61) == bool(r.same) for r in scored.collect())


def test_cells_are_split_by_bound_starts(spark):
    """Starts of items are made once for a cell, not for every list, line and item: an expression of some length stays one of some length."""
    rows = spark.createDataFrame([("1. Баня\n2. Сарай", "10\n20")], "c string, s string")
    plan = rows.select(second_pass.split_items(F.col("c"), second_pass.numbered_lines(F.col("s"))).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[1-9]") == 1


def test_rank_matrix_orders_values_once(spark):
    r = random.Random(8)
    rows = [(float(r.randrange(9)), r.random() if i % 40 else None, float("nan") if i % 50 == 3 else float(r.randrange(3))) for i in range(400)]
    got = statistics.rank_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    whole = [x for x in rows if None not in x and x[2] == x[2]]
    rank = lambda xs: np.array([(sum(y < x for y in xs) + sum(y <= x for y in xs) + 1) / 2 for x in xs])
    ranks = dict(zip("abc", (rank(xs) for xs in zip(*whole, strict=True)), strict=True))
    want = {p: round(float(np.corrcoef(ranks[p[0]], ranks[p[1]])[0, 1]), 4) for p in ("ab", "ac", "bc")}
    assert {x.a + x.b: x.rho for x in got.collect()} == want
    assert "covar_pop" in got._jdf.queryExecution().optimizedPlan().toString()  # each different value is ordered once, not each row
