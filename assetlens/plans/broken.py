"""A query on broken rows: lines of documents are rows, long ones are cut in two, and rows that belong together are found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.operators import broken_rows as B
from assetlens.operators.graph import cut
from assetlens.registry import query
from assetlens.sources.tables import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, row, col, text and cut (whether the row is the second half of a line): a row for each line of a document, or for each half of
    a line of six words and more."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    words = lambda x: F.filter(F.split(x, r"[ \t\r\f\x0B]+"), lambda w: w != "")
    half = lambda ws: (F.size(ws) / 2).cast("int")
    one = lambda t, c: F.struct(t.alias("text"), F.lit(c).alias("cut"))
    pieces = lambda ws: F.when(F.size(ws) >= 6, F.array(one(F.array_join(F.slice(ws, 1, half(ws)), " "), False), one(F.array_join(F.slice(ws, half(ws) + 1, F.size(ws)), " "), True))).otherwise(F.array(one(F.array_join(ws, " "), False)))
    parts = F.flatten(F.transform(F.filter(F.transform("ls", words), lambda ws: F.size(ws) > 0), pieces))
    return lines.select("doc_id", F.posexplode(parts).alias("row", "x")).select("doc_id", "row", F.lit(0).alias("col"), "x.text", "x.cut")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(t, '[ \t\r\f\x0B]+'), lambda x: x <> '') AS ws FROM l), k AS (SELECT *, len(ws) // 2 AS h FROM w WHERE len(ws) > 0),
    p AS (SELECT doc_id, i, 0 AS part, array_to_string(CASE WHEN len(ws) >= 6 THEN ws[1:h] ELSE ws END, ' ') AS t FROM k UNION ALL SELECT doc_id, i, 1, array_to_string(ws[h + 1:], ' ') FROM k WHERE len(ws) >= 6),
    r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS row, part = 1 AS cut, t, list_filter(list_transform(regexp_split_to_array(t, '[\s\x{A0}\x{FEFF}]+'), lambda x: regexp_replace(x, '^[\s.,!{}\[\]()"«»'']+|[\s.,!{}\[\]()"«»'']+$', '', 'g')), lambda x: x <> '') AS ws FROM p),
    c AS (SELECT unnest(list_zip(ws[1:len(ws) - 1], ws[2:])) AS z FROM (SELECT list_filter(list_transform(regexp_split_to_array(text, '[\s\x{A0}\x{FEFF}]+'), lambda x: regexp_replace(x, '^[\s.,!{}\[\]()"«»'']+|[\s.,!{}\[\]()"«»'']+$', '', 'g')), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) > 1),
    n AS (SELECT z[1] AS a, z[2] AS b, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS f1, sum(n) OVER (PARTITION BY b) AS f2, sum(n) OVER () AS total FROM n),
    often AS (SELECT a, b FROM s WHERE n >= 5 AND round(n * ln(n * total::DOUBLE / (f1::DOUBLE * f2)), 4) > 0),
    j AS (SELECT x.doc_id, x.row, x.cut, regexp_matches(x.t, '^\s*\(') OR (regexp_matches(y.t, '(?s).\([^)]+$') AND regexp_matches(x.t, '(?s)^[^(]+\)')) OR (regexp_matches(y.ws[-1], '.\p{Pd}$') AND regexp_matches(x.ws[1], '^\p{Ll}')) OR o.a IS NOT NULL AS found
        FROM r x JOIN r y ON y.doc_id = x.doc_id AND y.row = x.row - 1 AND len(x.ws) > 0 AND len(y.ws) > 0 LEFT JOIN often o ON o.a = y.ws[-1] AND o.b = x.ws[1]),
    f AS (SELECT doc_id, count(*) FILTER (found AND cut) AS rejoined, count(*) FILTER (found AND NOT cut) AS wrong FROM j GROUP BY doc_id)
    SELECT doc_id, count(*) AS rows, count(*) FILTER (cut) AS halves, coalesce(any_value(rejoined), 0) AS rejoined, coalesce(any_value(wrong), 0) AS wrong, count(*) - coalesce(any_value(rejoined), 0) - coalesce(any_value(wrong), 0) AS merged
    FROM r LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def x25_broken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: rows, halves of lines among them, halves that were joined to the half before, other rows that were joined, rows that are left."""
    # rows are made of a text anew each time: written out they take more room than all documents
    rows = _rows(spark, sf_dir)
    pairs = B.frequent_pairs(table(spark, sf_dir, "documents"), "text")
    on = cut(B.continued(rows, pairs))
    left = B.joined_rows(rows, on).groupBy("doc_id").agg(F.count("*").alias("merged"))
    judged = rows.join(on, ["doc_id", "row"], "left").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("cut").alias("halves"), F.count_if(F.col("reason").isNotNull() & F.col("cut")).alias("rejoined"), F.count_if(F.col("reason").isNotNull() & ~F.col("cut")).alias("wrong"))
    return judged.join(left, "doc_id")
