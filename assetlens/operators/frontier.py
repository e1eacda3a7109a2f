"""Best-first crawls over stored pages, all sites at once.

Each site has a frontier of addresses that were seen and not visited yet. A round visits the best one of every site, joins its links
in and keeps an address's best weight. Frontiers and visits are one table, cut in every round; nothing of it is on the driver but the
number of sites that went on. A site is visited ``budget`` times at most, so there are as many rounds at most, whatever the number of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.operators.graph import cut
from assetlens.operators.link_features import fallen


def best_first(seeds: DataFrame, links: DataFrame, budget: int) -> DataFrame:
    """seeds (site, url, weight) and links (src, dst, weight) to the visits (site, place from 1, url, weight, depth).

    The best address has the largest weight, of several the smallest text. A link's weight falls with the depth of the page it leads
    to, one more than its source's when that was visited; a page's depth is the least that it was seen at. Links go on within
    the site of their source. Null weights count as no link. An address that was visited isn't visited again."""
    links = cut(links.filter("dst is not null and weight is not null").groupBy("src", "dst").agg(F.max("weight").alias("w")))
    none = F.lit(None).cast("int")
    state = seeds.filter("url is not null").select("site", "url", F.col("weight").cast("double").alias("weight"), F.lit(0).alias("depth"))
    state = cut(state.groupBy("site", "url").agg(F.max("weight").alias("weight"), F.min("depth").alias("depth")).withColumns({"place": none, "at": F.lit(None).cast("struct<weight: double, depth: int>")}))
    for place in range(1, budget + 1):
        best = state.filter("place is null").groupBy("site").agg(F.min(F.struct((-F.col("weight")).alias("w"), "url", "depth")).alias("b"))
        step = best.select("site", F.col("b.url").alias("url"), (-F.col("b.w")).alias("weight"), F.col("b.depth").alias("depth"), F.lit(place).alias("place"), F.struct((-F.col("b.w")).alias("weight"), F.col("b.depth").alias("depth")).alias("at"))
        depth = F.col("depth") + 1
        seen = step.join(links, step["url"] == links["src"]).select("site", F.col("dst").alias("url"), fallen(F.col("w"), depth).alias("weight"), depth.alias("depth"), none.alias("place"), F.lit(None).cast("struct<weight: double, depth: int>").alias("at"))
        both = state.unionByName(step).unionByName(seen).groupBy("site", "url")
        state = cut(both.agg(F.max("weight").alias("weight"), F.min("depth").alias("depth"), F.max("place").alias("place"), F.max("at").alias("at")))
        if state.filter(F.col("place") == place).isEmpty():
            break
    return state.filter("place is not null").select("site", "place", "url", F.col("at.weight").alias("weight"), F.col("at.depth").alias("depth"))
