"""Links of stored pages, their scores, and the choice of documents; search over sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions import text, urls

ANCHOR = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a\s*>", re.I | re.S)
TAG = re.compile(r"<[^>]*>")
#: Words that speak for a link to a declaration, and their weights (values of the demo; callers pass their own).
WEIGHTS = {"declaration": 5.0, "income": 4.0, "property": 2.0, "report": 1.0, "декларац": 5.0, "доход": 4.0, "имуществ": 2.0}


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """src, dst (absolute), anchor of every link of every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for src, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in ANCHOR.finditer(page or ""):
                    try:
                        dst = urljoin(src or "", unescape(m[1] or m[2] or m[3] or "").strip())
                    except ValueError:
                        continue
                    out.append((src, dst, " ".join(unescape(TAG.sub(" ", m[4])).split())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*out, strict=True)) or [()] * 3)], names=["src", "dst", "anchor"])

    return pages.select(F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(each, "src string, dst string, anchor string")


def link_weight(anchor: Column, dst: Column, weights: dict[str, float] | None = None) -> Column:
    """Sum of the weights of words in a link's text, half of them for words in its address."""
    low, at = F.lower(F.coalesce(anchor, F.lit(""))), F.lower(F.coalesce(dst, F.lit("")))
    score = F.lit(0.0)
    for word, w in (weights or WEIGHTS).items():
        score = score + F.when(low.contains(word), w).otherwise(0.0) + F.when(at.contains(word), w / 2).otherwise(0.0)
    return score


def scored_links(found: DataFrame) -> DataFrame:
    """Distinct links that a crawler may follow, with their best weight and whether they stay on the site."""
    good = found.filter(urls.usable_link(F.col("dst")))
    rows = good.groupBy("src", "dst").agg(F.max(link_weight(F.col("anchor"), F.col("dst"))).alias("weight"), F.count("*").alias("n"))
    return rows.withColumn("same_site", urls.same_site(urls.host(F.col("src")), urls.host(F.col("dst"))))


def recognised(docs: DataFrame, body: str, rules: dict[str, str], positive: list[str], negative: list[str], least: int = 2) -> DataFrame:
    """Regex features (count and first place of each rule), and the verdict: POSITIVE from ``least`` positive rules on without a
    negative one, NEGATIVE with a negative rule or no positive one, else UNKNOWN."""
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    docs = docs.withColumns({f"n_{k}": F.regexp_count(low, F.lit(p)) for k, p in rules.items()} | {f"at_{k}": F.regexp_instr(low, F.lit(p)) for k, p in rules.items()})
    count = lambda names: sum((F.when(F.col(f"n_{k}") > 0, 1).otherwise(0) for k in names), F.lit(0))
    return docs.withColumn("verdict", F.when((count(negative) > 0) | (count(positive) == 0), "NEGATIVE").when(count(positive) >= least, "POSITIVE").otherwise("UNKNOWN"))


def archive_rule(verdicts: DataFrame, archive: str, verdict: str) -> DataFrame:
    """In an archive with more than one positive file all files are positive."""
    n = F.count_if(F.col(verdict) == "POSITIVE").over(Window.partitionBy(archive))
    return verdicts.withColumn("final", F.when(F.col(archive).isNotNull() & (n > 1), "POSITIVE").otherwise(F.col(verdict)))


def predicate(terms: dict[str, object], tokens: dict[str, str] | None = None) -> Column:
    """A conjunction: equal values of fields, lists as alternatives, None left out; and texts that have all tokens of a request."""
    out = F.lit(True)
    for field, value in terms.items():
        if isinstance(value, (list, tuple, set)):
            out = out & F.col(field).isin(*value)
        elif value is not None:
            out = out & (F.col(field) == value)
    for field, request in (tokens or {}).items():
        if request:
            out = out & text.all_tokens(F.col(field), request.lower().split())
    return out


def searched(df: DataFrame, terms: dict, tokens: dict | None, order: list[Column], page: int = 0, size: int = 20, optional: tuple[str, ...] = ()) -> DataFrame:
    """A page of hits in order; if none is found, once more without the optional terms."""
    found = df.filter(predicate(terms, tokens))
    if optional and found.limit(1).isEmpty():
        found = df.filter(predicate({k: v for k, v in terms.items() if k not in optional}, tokens))
    return found.orderBy(*order).offset(page * size).limit(size)
