"""Best-first crawls against a plain heap; links by their features."""

import heapq
import random

from pyspark.sql import functions as F

from assetlens.operators import frontier, link_features
from assetlens.plans import crawls


def fall(weight, depth):
    return round(weight - (0.1 if depth < 15 else 0.5 if depth < 30 else 6.0) * depth, 6)


def plain(seeds, links, budget):
    """One site after the other, with a heap; a better weight is pushed once more, and old entries are passed over."""
    out = {}
    by_source = {}
    for s, d, w in links:
        if d is not None and w is not None:
            by_source.setdefault(s, {})
            by_source[s][d] = max(w, by_source[s].get(d, w))
    for site in {s for s, _, _ in seeds}:
        weight, depth, heap, visited = {}, {}, [], []
        for _, u, w in (x for x in seeds if x[0] == site):
            weight[u], depth[u] = max(w, weight.get(u, w)), 0
        for u, w in weight.items():
            heapq.heappush(heap, (-w, u))
        done = set()
        while heap and len(visited) < budget:
            w, u = heapq.heappop(heap)
            if u in done or -w != weight[u]:
                continue
            done.add(u)
            visited.append((u, -w, depth[u]))
            d = depth[u] + 1
            for v, x in by_source.get(u, {}).items():
                depth[v] = min(d, depth.get(v, d))
                if v not in done and fall(x, d) > weight.get(v, float("-inf")):
                    weight[v] = fall(x, d)
                    heapq.heappush(heap, (-weight[v], v))
        out[site] = visited
    return out


def visits(seeds, links, budget):
    found = {}
    for r in frontier.best_first(seeds, links, budget).orderBy("site", "place").collect():
        found.setdefault(r.site, []).append((r.url, r.weight, r.depth))
        assert r.place == len(found[r.site])
    return found


def test_order_of_a_heap(spark):
    rng = random.Random(5)
    seeds = [(s, f"{s}{rng.randrange(30)}", float(rng.choice([0, 0, 1]))) for s in "abc" for _ in range(2)] + [("d", "d0", 0.0)]
    links = [(f"{s}{rng.randrange(30)}", rng.choice([f"{s}{rng.randrange(30)}", None] if rng.random() < 0.1 else [f"{s}{rng.randrange(30)}"]), rng.choice([None, 1.0, 2.0, 5.0, 5.0, 50.0])) for s in "abc" for _ in range(120)]
    links += [("d0", "d1", 1.0), ("d1", "d0", 99.0)]
    got = visits(spark.createDataFrame(seeds, "site string, url string, weight double"), spark.createDataFrame(links, "src string, dst string, weight double"), 9)
    assert got == plain(seeds, links, 9)
    assert len(got["a"]) == 9 and [u for u, _, _ in got["d"]] == ["d0", "d1"]


def test_pages_of_the_corpus(spark, sf):
    seeds, links = crawls._pages(spark, sf)
    assert visits(seeds, links, 4) == plain([tuple(r) for r in seeds.collect()], [tuple(r) for r in links.collect()], 4)


def test_far_pages_and_empty(spark):
    chain = [(f"u{k}", f"u{k + 1}", 50.0) for k in range(4)]
    got = visits(spark.createDataFrame([("x", "u0", 0.0)], "site string, url string, weight double"), spark.createDataFrame(chain, "src string, dst string, weight double"), 9)
    assert got["x"] == [("u0", 0.0, 0), ("u1", 49.9, 1), ("u2", 49.8, 2), ("u3", 49.7, 3), ("u4", 49.6, 4)]
    depths = spark.createDataFrame([(14,), (15,), (30,)], "d int").select(link_features.fallen(F.lit(50.0), F.col("d")).alias("w")).collect()
    assert [r.w for r in depths] == [48.6, 42.5, -130.0]
    none = spark.createDataFrame([], "site string, url string, weight double")
    assert visits(none, spark.createDataFrame(chain, "src string, dst string, weight double"), 3) == {}


def test_features_of_links(spark):
    rows = [
        ("Справка о доходах депутатов", "http://a.ru/corruption/1.pdf", "http://a.ru/corruption", "", "", "a", ""), ("Иванов", "http://a.ru/1", "http://a.ru/1", "", "о доходах", "iframe", "dohod"),
        (None, None, None, None, None, None, None), ("Cведения 2020", "http://a.ru/1", "http://b.ru", "", "", "a", ""), ("Выборы", "http://a.ru/income", "", "", "о доходах 2020", "a", ""),
    ]
    names = "anchor target source title page tag css".split()
    seen = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(link_features.judged(*map(F.col, names)).alias("x")).select("x.*").collect()
    true = [{k for k in link_features.FEATURES if r.features[k]} for r in seen]
    assert true[0] == {"income_anchor", "report_anchor", "document_url", "sub_page", "corruption_url", "best_match"} and (seen[0].case, seen[0].weight) == (0, 111.0)
    assert true[1] == {"income_page", "income_url", "sub_page"} and (seen[1].case, seen[1].weight) == (1, 51.0)
    assert true[2] == set() and seen[2].case is None
    assert true[3] == {"report_anchor", "year_anchor"} and (seen[3].case, seen[3].weight) == (2, 15.0)
    assert seen[4].case is None and seen[4].weight is None
    assert spark.range(1).select(link_features.is_language(F.lit(" EN ")), link_features.is_language(F.lit("end"))).first() == (True, False)
