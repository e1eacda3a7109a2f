"""Titles of declarations: what they declare, for when, of whom and of which office.

A title is read from the left. The state is a struct of the fields found so far and of the text that is left; a stage finds its
pattern in that text, puts the match into a field and takes it out. Stages are bound one after the other by lambdas, so a title is
cleaned once and each stage sees what the ones before have left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlens.functions import names
from assetlens.functions.text import one_space

#: Words of titles.
KIND = r"(?iu)^(уточненные сведения|сведения|справка|информация|с в е д е н и я)"
OBJECTS = ["доходах", "расходах", "имуществе", "обязательствах ?имущественного ?характера", "сведения ?об ?источниках ?получения ?средств", "источниках ?получения ?средств"]
_PERIOD = r"за (?:отчетный )?(?:финансовый )?(?:период|год) с "
TIMES = [_PERIOD + r"\d+ января \d+ ?(?:года|г\.) по \d+ декабря \d+ ?(?:года|г\.)", _PERIOD + r"\d+ января по \d+ декабря \d+ ?(?:года|г\.)", _PERIOD + r"\d+\.\d+\.\d+ по \d+\.\d+\.\d+", r"за \d+ год"]
OFFICIALS = [
    "лиц, замещающих муниципальные должности", "лиц, замещающих муниципальные и выборные должности", "лица, замещающего государственную должность",
    "лиц, замещающих должности государственной гражданской службы", "лиц, замещающих должности", "представленные лицами, замещающими государственные должности", "лицами, замещающими должности",
]
#: Beginnings of words for persons who hold a post, in any case; up to five words of a title are searched for one.
PEOPLE = ["руководител", "служащ", "директор", "глав", "депутат", "заведующ", "специалист", "начальник", "министр", "судь", "судей", "сотрудник", "работник", "председател", "инспектор", "советник", "консультант", "секретар", "ректор"]
REGION = r"^((?:республики|города) \p{Lu}\p{L}+|\p{Lu}\p{L}+(?:ской|цкой) (?:области|республики)|\p{Lu}\p{L}+(?:ского|цкого) края)(?!\p{L})"
FAMILY = [r"(?:а также|(?:его|ее) супруг).*(?:детей|ребенка)", r"и членов (?:ее|его|их) сем\p{L}{2}", "для размещения на официальном сайте и средствах массовой информации"]
_PATRONYMIC = rf"\p{{Lu}}\p{{L}}*?(?:{names.PATRONYMIC_MALE[:-1]}|{names.PATRONYMIC_FEMALE[:-1]}|ич[ау]|ич[её]м|овн[ыу]|евн[ыу]|ичн[ыу])(?!\p{{L}})"
PERSON = rf"\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)? \p{{Lu}}\p{{L}}+ {_PATRONYMIC}"
FIELDS = ["type", "objects", "time", "positions", "region", "person", "org"]
_EDGES = r"^[ ,]+|[ ,]+$"

State = Column
Stage = Callable[[State], Column]


def _with(s: State, **fields: Column) -> Column:
    return F.struct(*(fields.get(k, s[k]).alias(k) for k in ["rest", *FIELDS]))


def _tidy(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def _after(rest: Column, match: Column) -> Column:
    return F.ltrim(F.substring(rest, F.length(match) + 1, F.length(rest)))


def _take(field: str, pattern: str, also: str = "") -> Stage:
    """Take a match at the start into a field that is empty; what ``also`` matches right after it goes, too."""

    def stage(s: State) -> Column:
        found = F.regexp_extract(s["rest"], pattern, 0)
        rest = _after(s["rest"], found)
        rest = F.ltrim(F.regexp_replace(rest, also, "")) if also else rest
        hit = (found != "") & s[field].isNull()
        return _with(s, rest=F.when(hit, rest).otherwise(s["rest"]), **{field: F.when(hit, _tidy(found)).otherwise(s[field])})

    return stage


def _begin(s: State) -> Column:
    """What stands before 'сведения о доходах' is no part of the title."""
    at = F.locate("сведения о доходах", F.lower(s["rest"]))
    return _with(s, rest=F.when(at > 1, F.substring(s["rest"], at, F.length(s["rest"]))).otherwise(s["rest"]))


def _objects(s: State) -> Column:
    """A list of objects, joined by commas, 'и' and prepositions."""
    one = "(?:" + "|".join(OBJECTS) + ")"
    all_ = F.regexp_extract(s["rest"], rf"(?iu)^(?:об? )?{one}(?: ?(?:и|,)(?: об?)? {one})*", 0)
    found = F.transform(F.regexp_extract_all(all_, F.lit(f"(?iu){one}"), F.lit(0)), lambda x: F.lower(x))
    return _with(s, rest=_after(s["rest"], all_), objects=F.when(all_ != "", found).otherwise(s["objects"]))


def _positions(s: State) -> Column:
    """Whole phrases for officials (with the region that may follow, and others after 'и'), or up to the first word for a person."""
    phrase = "(?:" + "|".join(OFFICIALS) + ")"
    told = F.regexp_extract(s["rest"], rf"^[ ,]*{phrase}(?: и {phrase})*", 0)
    rest = F.regexp_replace(_after(s["rest"], told), r"^[ ,]+", "")
    region = F.regexp_extract(rest, REGION, 0)
    by_phrase = _with(s, positions=F.regexp_extract_all(told, F.lit(phrase), F.lit(0)), region=F.nullif(region, F.lit("")), rest=F.regexp_replace(_after(rest, region), r"^[ ,]+", ""))
    plain = F.regexp_replace(s["rest"], r"(?iu)^(?:, )?представленные ", "")
    # no word before may begin a name
    post = F.regexp_extract(plain, rf"^(?:\p{{Ll}}[\p{{L}}-]*,? ){{0,4}}?(?iu:{'|'.join(PEOPLE)})\p{{L}}*", 0)
    by_word = _with(s, positions=F.array(_tidy(post)), rest=_after(plain, post))
    return F.when(told != "", by_phrase).when(post != "", by_word).otherwise(s)


def _time_anywhere(s: State) -> Column:
    """A time in the middle ends what is read; what follows it is no office's name."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(s["rest"], f"(?iu){p}", 0), F.lit("")) for p in TIMES))
    at = F.instr(s["rest"], found)
    hit = s["time"].isNull() & found.isNotNull()
    return _with(s, time=F.when(hit, found).otherwise(s["time"]), rest=F.when(hit, F.trim(F.substring(s["rest"], F.lit(1), at - 1))).otherwise(s["rest"]))


def _without_family(s: State) -> Column:
    rest = s["rest"]
    for p in FAMILY:
        rest = F.regexp_replace(rest, p, "")
    return _with(s, rest=_tidy(one_space(rest)))


def _person_at_end(s: State) -> Column:
    found = F.regexp_extract(s["rest"], f"(?:^| )({PERSON})$", 1)
    hit = (found != "") & s["person"].isNull()
    return _with(s, person=F.when(hit, found).otherwise(s["person"]), rest=F.when(hit, F.substring(s["rest"], F.lit(1), F.length(s["rest"]) - F.length(found))).otherwise(s["rest"]))


def _office(s: State) -> Column:
    """The rest, if something said before whose declaration it is, or if it looks like an office's name itself."""
    whole = s["rest"].rlike(r"(?iu)^(структурно|территориал)") & s["rest"].rlike(r"(?iu)(республики|области|края)$")
    known = F.size(F.coalesce(s["positions"], F.array().cast("array<string>"))) + F.when(s["person"].isNotNull(), 1).otherwise(0) > 0
    return _with(s, org=F.when(known | whole, F.regexp_replace(_tidy(s["rest"]), "^в ", "")))


STAGES: list[Stage] = [
    _begin, _take("type", KIND, r"(?iu)^(?:об? )(?=\p{L})"), _objects, *(_take("time", f"(?iu)^,? ?{p}") for p in TIMES), _positions, _take("person", f"^,? ?{PERSON}"),
    _time_anywhere, _without_family, _person_at_end, _office,
]


def parsed(c: Column) -> Column:
    """struct<type, objects, time, positions, region, person, org> of a title; null if it names no type and no objects, or nobody whose
    declaration it is."""
    none = F.lit(None).cast("string")
    lists = {"objects", "positions"}
    state = F.array(F.struct(one_space(c).alias("rest"), *((F.lit(None).cast("array<string>") if f in lists else none).alias(f) for f in FIELDS)))
    for stage in STAGES:
        state = F.transform(state, stage)
    done = F.transform(state, lambda s: F.when((s["type"].isNotNull() | s["objects"].isNotNull()) & s["org"].isNotNull(), F.struct(*(s[f].alias(f) for f in FIELDS))))
    return F.get(done, F.lit(0))
