"""Whether a link leads to declarations: thirteen features of its text, its address and its page, a case and a weight.

All of it is column expressions over one struct of cleaned texts, so links are judged inside the scan's own stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of a link, and words in texts and addresses.
BEST, NORMAL, TRASH, STEP = 50.0, 10.0, 5.0, 1.0
SUBJECT = r"^([0-9. ]+)?(сведения|справк[аи]|информация) о доходах"
INCOME, INCOME_IN_URL, REPORT, REPORT_IN_URL, CORRUPTION_IN_URL = r"доходах|доходе|коррупц", r"(?i)do[ck]?[hx]od|income", r"сведения|справк[аи]|sveden", r"(?i)sveden|sveodoh|de[ck]lara", r"(?i)[ck]orrup"
NEGATIVE = ["координат", "заседании", "выборы", "памятка", "доклад", "конкурс", "пресс-релиз", "правила", "положение", "методические", "заявление", "схема", "концепция", "доктрина", "технические", "новости", "обратная", "обращения", "прочие", "слабовидящих", "выступление", "вступительное", "предупреждает"]
NEGATIVE_FIRST = ["федеральный", "историческ", "закон", "формы", "перечень"]
OTHER_DOCUMENTS = ["указ", "постановление", "приказ", "распоряжение", "решение", "протокол", "инструкция", "регламент"]
OFFICES = ["отдел", "управление", "департамент", "институт", "центр", "министерство", "палата", "управа", "фонд", "комиссия", "служба", "агентство", "отделение", "инспекция", "аппарат", "комитет", "правительство", "администрация", "органы", "власть", "совет", "дума", "собрание", "школа", "больница", "клиника", "поликлиника", "прокуратура", "суд", "глава", "губернатор", "президент", "мэр", "учреждение", "представительство", "префектура", "подведомственные"]
PLACES = ["поселение", "поселения", "район", "районы", "улус", "улусы", "округ"]
ROLES = ["администратор", "ведущий", "врио", "генеральный", "глава", "главный", "директор", "должность", "доцент", "заведующ", "зам", "инспектор", "исполняющий", "консультант", "контролер", "начальник", "первый", "помощник", "председатель", "представитель", "проректор", "ректор", "референт", "руководител", "секретарь", "советник", "специалист", "старший", "статс", "судья", "уполномоченный", "управляющий", "финансовый", "член", "экономист"]
LANGUAGES = ["ru", "en", "de", "fr", "es", "eng", "rus", "русский", "английский", "немецкий", "французский", "russian", "english", "german", "french", "deutsch"]
FILES = ["doc", "docx", "xls", "xlsx", "pdf", "rtf", "zip", "rar", "7z", "odt"]
MEDIA = r"(?i)\.(mp3|mp4|avi|mov|wav|wmv|mkv|flv|mpe?g)([?#].*)?$"
FEATURES = ["income_page", "income_url", "income_anchor", "report_anchor", "report_url", "document_url", "sub_page", "year_anchor", "corruption_url", "role_anchor", "best_match", "office_word", "place_word"]


def is_language(anchor: Column) -> Column:
    """A link that changes the page's language."""
    return F.lower(F.trim(anchor)).isin(LANGUAGES)


def _russian(c: Column) -> Column:
    """Lower case, one space, no quotes at the ends; the Latin letters c, e and o as the Cyrillic ones they look like."""
    return F.translate(F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r'^[ "]+|[ "]+$', ""))), "ceo", "сео")


def _first_words(c: Column, words: list[str], n: int) -> Column:
    return F.arrays_overlap(F.slice(F.split(c, r'[\s,"]'), 1, n), F.array(*map(F.lit, words)))


def _place_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"\.html?$", ""), r"^https?://(www\.)?", "")


def judged(anchor: Column, target: Column, source: Column, source_title: Column, page: Column, tag: Column | None = None, css: Column | None = None) -> Column:
    """struct<features, case, weight> of a link: features is a struct of 13 booleans, case the first rule that fits (0 to 7, null: no link
    to follow), weight a number or null. page is the text of the page that the link stands on; tag and css are the element's."""
    none = F.lit(None).cast("string")
    texts = F.struct(
        _russian(anchor).alias("anchor"), F.lower(F.coalesce(anchor, F.lit(""))).alias("raw"), _russian(page).alias("page"), F.coalesce(target, F.lit("")).alias("url"), F.coalesce(source, F.lit("")).alias("source"),
        F.lower(F.coalesce(source_title, F.lit(""))).alias("title"), F.lower(F.coalesce(none if tag is None else tag, F.lit(""))).alias("tag"), F.coalesce(none if css is None else css, F.lit("")).alias("css"),
    )
    seen = F.transform(F.array(texts), lambda t: F.struct(_features(t).alias("f"), t.alias("t")))
    return F.get(F.transform(seen, lambda s: _verdict(s["f"], s["t"])), F.lit(0))


def _features(t: Column) -> Column:
    any_of = lambda words: "|".join(words)
    anchor, url, low = t["anchor"], t["url"], F.lower(t["url"])
    document = anchor.rlike("скачать|загрузить") | t["raw"].contains("download") | t["raw"].rlike(any_of(FILES)) | low.rlike(rf"\.({any_of(FILES)})$") | low.rlike("docs|documents|files|download")
    found = {
        "income_page": t["page"].rlike(INCOME), "income_url": url.rlike(INCOME_IN_URL) | t["css"].rlike(INCOME_IN_URL), "income_anchor": anchor.rlike(INCOME),
        "report_anchor": anchor.rlike(REPORT) | t["raw"].rlike(REPORT), "report_url": url.rlike(REPORT_IN_URL), "document_url": document,
        "sub_page": (url != "") & ((t["tag"] == "iframe") | ((t["source"] != "") & _place_of(url).startswith(_place_of(t["source"])))),
        "year_anchor": anchor.rlike(r"(?<![\p{L}\p{N}_])20[0-9][0-9](?![\p{L}\p{N}_])"), "corruption_url": url.rlike(CORRUPTION_IN_URL), "role_anchor": anchor.rlike(f"^({any_of(ROLES)})"),
        "best_match": anchor.rlike(SUBJECT), "office_word": _first_words(anchor, OFFICES, 3), "place_word": _first_words(anchor, PLACES, 5),
    }
    return F.struct(*(F.coalesce(found[k], F.lit(False)).alias(k) for k in FEATURES))


def _verdict(f: Column, t: Column) -> Column:
    on_income = f["income_page"] | f["income_url"]
    subject, archive = f["best_match"], t["url"].contains("name=anticorruption") & t["anchor"].endswith("архив")
    bad = t["anchor"].rlike("|".join([*NEGATIVE, *(f"^{w}" for w in NEGATIVE_FIRST), *(f"^.{{0,10}}{w}" for w in OTHER_DOCUMENTS)]))
    rules = [
        (subject, 0), (on_income & (f["report_anchor"] | f["year_anchor"] | f["sub_page"] | f["document_url"]), 1), ((f["report_anchor"] | f["report_url"]) & (f["year_anchor"] | f["document_url"]), 2),
        (on_income & f["role_anchor"], 3), (t["title"].rlike(INCOME) & f["income_url"], 4), (f["office_word"], 5), (f["place_word"], 6), (archive, 7),
    ]
    case = F.when((bad & ~subject) | t["url"].rlike(MEDIA), F.lit(None).cast("int")).otherwise(F.coalesce(*(F.when(rule, k) for rule, k in rules)))
    f = f.withField("best_match", subject | F.coalesce(case == 7, F.lit(False)))
    parts = {"best_match": BEST, "income_anchor": BEST, "income_url": BEST, "report_anchor": NORMAL, "report_url": NORMAL, "year_anchor": TRASH}
    weight = reduce(lambda a, b: a + b, [F.when(f[k], w).otherwise(0.0) for k, w in parts.items()])
    # a page on incomes or an address on corruption only adds to what a link has already
    for k in ("income_page", "corruption_url"):
        weight = weight + F.when(f[k] & (weight > 0), STEP).otherwise(0.0)
    weight = weight + F.when(f["office_word"], STEP).otherwise(0.0) + F.when(f["place_word"], STEP).otherwise(0.0)
    return F.struct(f.alias("features"), case.alias("case"), F.when(case.isNotNull(), weight).alias("weight"))


def fallen(weight: Column, depth: Column) -> Column:
    """A link's weight on a page that is so deep: far pages come late, very far ones hardly ever."""
    return F.round(weight - F.when(depth < 15, 0.1).when(depth < 30, 0.5).otherwise(6.0) * depth, 6)
