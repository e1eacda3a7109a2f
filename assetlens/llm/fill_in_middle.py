"""Fill-in-the-middle: texts cut in three at word boundaries that a hash chooses, rearranged with sentinels, and restored.

A text's units are its words, each with the white space before it, and white space at its end. Two cuts, a form and an
arrangement come from the sha256 of a seed and the doc_id, so they depend on nothing else. Every step is a Spark SQL
function: regexp_extract_all makes the array of units, conv of substrings of sha2 the cuts, slice and array_join the three
parts. A text that holds a sentinel, an empty one, and the share that the hash leaves stay plain. No sentinel can arise
where a part meets one, as each begins with its only ``<`` and ends with its only ``>``; so splitting at sentinels restores
the text.

A null text counts as empty (plain, no units). A null doc_id counts as an empty string after the seed. Rows that repeat are
treated alike, each for itself; long texts are cut whole, one row of units in memory at a time. Columns other than doc_id
and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm.common import table

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def hash_words(seed: int, doc_id: str = "doc_id", n: int = 4) -> list[Column]:
    """The first n groups of 8 hexadecimal digits of a document's hash, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    rate: percent of the texts that are rearranged, spm: percent of these that begin with their suffix."""
    text, h = F.coalesce(F.col("text").cast("string"), F.lit("")), hash_words(seed)
    cut = docs.select("doc_id", text.alias("text"), *(x.alias(f"_h{k}") for k, x in enumerate(h)))
    # units are made for all texts, as n is wanted for all
    cut = cut.withColumn("_units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0))).withColumn("n", F.size("_units").cast("bigint"))
    one, two = F.col("_h0") % (F.col("n") + 1), F.col("_h1") % (F.col("n") + 1)
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | (F.col("_h2") % 100 >= rate) | holds, "plain").when(F.col("_h3") % 100 < spm, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "n", "_units", form.alias("form"), F.least(one, two).cast("int").alias("_a"), F.greatest(one, two).cast("int").alias("_b"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start + 1, length), ""))

    cut = cut.select(
        "doc_id", "text", "n", "form", part(F.lit(0), F.col("_a")).alias("prefix"), part(F.col("_a"), F.col("_b") - F.col("_a")).alias("middle"),
        part(F.col("_b"), F.col("n").cast("int") - F.col("_b")).alias("suffix"),
    )
    p, s, m = (F.concat(F.lit(mark), F.col(of)) for mark, of in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    return cut.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m)))


def restored(rearranged: DataFrame, out: str = "restored") -> DataFrame:
    """The text again, from output and form alone."""
    parts = rearranged.withColumn("_parts", F.when(F.col("form") != "plain", F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)))
    at = lambda k: F.get("_parts", F.lit(k))
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
    return parts.withColumn(out, text).drop("_parts")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    lengths = (F.char_length(c).cast("bigint").alias(f"{c}_chars") for c in ("prefix", "middle"))
    return rows.select("doc_id", "n", "form", *lengths, digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


#: Says it by positions in the text: units are counted, and parts are cut where the lists of units end.
ORACLE_SQL = r"""
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
               sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), numbers AS (
        SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
               CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
        FROM cut
    ), lengths AS (
        SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
               length(array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '')) AS a,
               length(array_to_string(units[1:greatest(h1 % (n + 1), h2 % (n + 1))], '')) AS b
        FROM numbers
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                            WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
                            ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM lengths
"""
