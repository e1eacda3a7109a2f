"""Person names: parts, compatibility and gender, as column expressions over one parsed struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of patronymics and of family names by gender.
PATRONYMIC_MALE, PATRONYMIC_FEMALE = "(ович|евич|ич)$", "(овна|евна|ична|инична)$"
FAMILY_MALE, FAMILY_FEMALE = "(ов|ев|ин|ын|ский|цкий|ой|ый)$", "(ова|ева|ина|ына|ская|цкая|ая)$"
#: Words for relatives of a declarant.
SPOUSE = ["супруг", "супруга", "супруг(а)", "супруг (супруга)", "супруга (супруг)", "муж", "жена"]
CHILD = ["ребенок", "ребёнок", "несовершеннолетний ребенок", "несовершеннолетний ребёнок", "сын", "дочь", "дети", "несовершеннолетняя дочь", "несовершеннолетний сын"]


def resolved(c: Column) -> Column:
    """struct<family, first, patronymic> in lower case, ё as е: 'Family First Patronymic', 'First Patronymic Family', 'Family I. P.' or
    'I. P. Family'; initials are single letters. Null for anything else."""
    clean = F.translate(F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\d.,\s]+", ""), r"[\s,]+", " "))), "ё", "е")
    # a lambda binds the cleaned text once; as a plain expression it would be copied into every test
    return F.get(F.transform(F.array(clean), _parts), F.lit(0))


def _parts(s: Column) -> Column:
    word, initial = r"([а-яa-z][а-яa-z'’\-]+)", r"([а-яa-z])\.?"
    part = lambda pattern, n: F.regexp_extract(s, pattern, n)
    full, behind, ahead, two = f"^{word} {word} {word}$", f"^{word} {initial}(?: ?{initial})?$", f"^{initial}(?: ?{initial})? ?{word}$", f"^{word} {word}$"
    row = lambda a, b, d: F.struct(a.alias("family"), F.nullif(b, F.lit("")).alias("first"), F.nullif(d, F.lit("")).alias("patronymic"))
    none = F.lit("")
    patronymic = f"(?:{PATRONYMIC_MALE}|{PATRONYMIC_FEMALE})"
    middle = part(full, 2).rlike(patronymic) & ~part(full, 3).rlike(patronymic)
    return (
        F.when(s.rlike(full) & middle, row(part(full, 3), part(full, 1), part(full, 2)))
        .when(s.rlike(full), row(part(full, 1), part(full, 2), part(full, 3)))
        .when(s.rlike(behind), row(part(behind, 1), part(behind, 2), part(behind, 3)))
        .when(s.rlike(ahead), row(part(ahead, 3), part(ahead, 1), part(ahead, 2)))
        .when(s.rlike(two), row(part(two, 1), part(two, 2), none))
    )


def compatible(a: Column, b: Column) -> Column:
    """Equal family names; first names and patronymics of which one begins the other (an initial, or none at all)."""
    near = lambda x, y: F.coalesce(x.startswith(y) | y.startswith(x), F.lit(True))
    return (a["family"] == b["family"]) & near(a["first"], b["first"]) & near(a["patronymic"], b["patronymic"])


def block_key(name: Column) -> Column:
    """Family and initials: persons of different keys are never compared."""
    return F.concat_ws(" ", name["family"], F.substring(F.coalesce(name["first"], F.lit("")), 1, 1))


def initials(name: Column) -> Column:
    return F.concat_ws(" ", F.initcap(name["family"]), F.concat(F.upper(F.substring(name["first"], 1, 1)), F.lit(".")), F.concat(F.upper(F.substring(name["patronymic"], 1, 1)), F.lit(".")))


def gender(name: Column) -> Column:
    """'m', 'f' or null: by patronymic, then by family name."""
    p, f = name["patronymic"], name["family"]
    return F.when(p.rlike(PATRONYMIC_FEMALE), "f").when(p.rlike(PATRONYMIC_MALE), "m").when(f.rlike(FAMILY_FEMALE), "f").when(f.rlike(FAMILY_MALE), "m")


def relative(c: Column) -> Column:
    """'S' spouse, 'C' child, 'D' the declarant (no such word)."""
    low = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(low.isin(SPOUSE) | low.startswith("супруг"), "S").when(low.isin(CHILD) | low.rlike(r"^(несоверш|реб[её]н)"), "C").when(low.isNotNull(), "D")
