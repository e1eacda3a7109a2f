"""Column expressions on URLs, hosts and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types and the file extensions that they stand for.
EXTENSIONS = {
    "application/msword": ".doc", "application/pdf": ".pdf", "application/rtf": ".rtf", "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/x-7z-compressed": ".7z", "application/zip": ".zip", "text/html": ".html",
}


def host(url: Column) -> Column:
    """The host in lower case, without www, user and port; empty if there is none."""
    h = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(h, r"^www\.", "")


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^(?i)[a-z][a-z0-9+.\-]*://", ""), r"^(?i)www\.", "")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(without_query(url), r"^(?:[a-zA-Z][\w+.\-]*:)?//[^/]*(/.*)$", 1)


def file_name(url: Column) -> Column:
    return F.regexp_extract(without_query(url), r"^(?:[a-zA-Z][\w+.\-]*:)?//[^/]*/(?:.*/)?([^/]*)$", 1)


def mirror_key(url: Column) -> Column:
    """Equal for URLs that differ in scheme, www and a last slash."""
    return F.lower(F.regexp_replace(without_scheme(url), "/+$", ""))


def labels(h: Column) -> Column:
    return F.reverse(F.split(h, r"\."))


def common_labels(a: Column, b: Column) -> Column:
    """How many labels two hosts share, from the top domain down."""
    pairs = F.arrays_zip(labels(a).alias("a"), labels(b).alias("b"))
    state = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")), lambda s, p: F.struct(F.when(s["same"] & (p["a"] == p["b"]), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["same"] & F.coalesce(p["a"] == p["b"], F.lit(False))).alias("same")))
    return state["n"]


def same_site(a: Column, b: Column) -> Column:
    """Two labels in common, three below gov.ru."""
    return common_labels(a, b) >= F.when(a.endswith("gov.ru"), 3).otherwise(2)


def extension_of_type(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.regexp_replace(content_type, ";.*$", "")))
    return F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))[kind]


def usable_link(href: Column) -> Column:
    """Links that a crawler may follow: not empty, not a fragment, mail, phone or script, and no media file."""
    h = F.lower(F.trim(href))
    return href.isNotNull() & (h != "") & ~h.rlike(r"^(#|mailto:|tel:|javascript:|data:)") & ~h.rlike(r"\.(jpe?g|png|gif|svg|css|js|mp[34]|avi|ico)([?#].*)?$")
