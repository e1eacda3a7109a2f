"""Column expressions on texts, numbers and years; nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that look like Cyrillic ones, and the Cyrillic ones.
LATIN, CYRILLIC = "ABCEHKMOPTXaceopxyu", "АВСЕНКМОРТХасеорхуи"
#: Texts of a cell that say that there is nothing.
EMPTY_VALUES = ["", "-", "--", "---", "не имеет", "нет", "отсутствует", "не указано", "n/a"]
#: Cyrillic letters in Latin ones.
IN_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "\"", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
}
SPACE = r"\s+"


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def spaces_by_line(c: Column) -> Column:
    """Runs of white space as one space; line feeds stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\S\n]+", " "), r" ?\n[ \n]*", "\n"))


def without_quotes(c: Column) -> Column:
    return one_space(F.regexp_replace(c, "[\"'«»„“”*]", " "))


def as_cyrillic(c: Column) -> Column:
    return F.translate(c, LATIN, CYRILLIC)


def header_title(c: Column) -> Column:
    """A column title for comparison: lower case, no white space, look-alikes repaired if the title has Cyrillic letters."""
    low = F.lower(F.regexp_replace(c, SPACE, ""))
    return F.when(low.rlike("[а-яё]"), F.lower(as_cyrillic(F.regexp_replace(c, SPACE, "")))).otherwise(low)


def is_empty_value(c: Column) -> Column:
    low = F.lower(one_space(c))
    return c.isNull() | low.isin(EMPTY_VALUES) | low.rlike(r"^[\-–—_.\s]*$")


def numeral_group(n: Column) -> Column:
    """1: one, 2: two to four, 5: the others, by Russian grammar."""
    two, last = F.abs(n) % 100, F.abs(n) % 10
    return F.when(two.between(11, 14), 5).when(last == 1, 1).when(last.between(2, 4), 2).otherwise(5)


def share_of_words(c: Column, words: list[str]) -> Column:
    parts = F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    return F.try_divide(F.size(F.filter(parts, lambda w: w.isin(words))), F.size(parts))


def stems(c: Column, n: int = 4) -> Column:
    """The first letters of each word; numbers that are years stay whole, others go."""
    parts = F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    return F.filter(F.transform(parts, lambda w: F.when(w.rlike(r"^\d+$"), F.when(w.rlike(r"^(19|20)\d\d$"), w)).otherwise(F.substring(w, 1, n))), lambda w: w.isNotNull())


def bigrams(words: Column) -> Column:
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    return F.transform(pairs, lambda p: F.concat_ws("_", p["a"], p["b"]))


def trigrams(c: Column) -> Column:
    """Character trigrams of a text between ^ and $."""
    s = F.concat(F.lit("^"), F.lower(c), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))


def around(c: Column, word: str, most: int, before: int) -> Column:
    """A text cut to ``most`` characters, from ``before`` characters ahead of a word if it has it."""
    at = F.locate(word, F.lower(c))
    return F.substring(c, F.greatest(F.when(at > before, at - before).otherwise(F.lit(1)), F.lit(1)), F.lit(most))


def decimal_value(c: Column) -> Column:
    """A number with a comma or a point, spaces between groups ignored."""
    s = F.regexp_replace(c, r"[\s ]", "")
    return F.regexp_replace(s, ",", ".").try_cast("double")


def roubles(c: Column) -> Column:
    """An income: the first well-formed number; 'коп' and a last group of two digits are kopecks; 'тыс' multiplies; 10^10 and more is null."""
    s = F.lower(F.regexp_replace(c, r"[\s ]+", " "))
    kopecks = F.regexp_extract(s, r"^\D*(\d[\d ]*?)\s*(?:руб|р)\D*(\d{1,2})\s*коп", 0) != ""
    with_kopecks = F.concat(F.regexp_replace(F.regexp_extract(s, r"^\D*(\d[\d ]*?)\s*(?:руб|р)", 1), " ", ""), F.lit("."), F.lpad(F.regexp_extract(s, r"(\d{1,2})\s*коп", 1), 2, "0"))
    split_group = F.regexp_replace(F.regexp_extract(s, r"(\d{1,3}(?: \d{3})+ \d{2})(?!\d)", 1), r" (\d{2})$", ".$1")
    usual = F.regexp_replace(F.regexp_extract(s, r"(-?\d[\d ]*(?:[.,]\d+)?)", 1), ",", ".")
    number = F.when(kopecks, with_kopecks).when(split_group != "", split_group).otherwise(usual)
    value = F.regexp_replace(number, " ", "").try_cast("double") * F.when(s.contains("тыс"), 1000.0).otherwise(1.0)
    return F.when(F.abs(value) < 1e10, F.round(value, 2))


def square(c: Column) -> Column:
    """Square metres: hectares count 10,000, 0 and nothing give null."""
    s = F.lower(c)
    value = decimal_value(F.regexp_extract(s, r"(\d[\d\s ]*(?:[.,]\d+)?)", 1))
    return F.nullif(F.round(value * F.when(s.rlike(r"\bга\b|гектар|hectare"), 10_000.0).otherwise(1.0), 2), F.lit(0.0))


def year_in(c: Column, first: int = 1980, last: Column | None = None) -> Column:
    """The first number of four digits that is a year from ``first`` to now."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: (y >= first) & (y <= (F.year(F.current_date()) if last is None else last))), F.lit(0))


def title_year(c: Column) -> Column:
    """The income year that a title names: '31 декабря 20xx', 'за 20xx', else any year outside a date."""
    s = F.lower(c)
    rest = F.regexp_replace(s, r"\d{1,2}\.\d{1,2}\.20\d\d", " ")
    tries = [F.regexp_extract(s, r"31\s+декабря\s+(20\d\d)", 1), F.regexp_extract(s, r"за\s+(20\d\d)", 1), F.regexp_extract(rest, r"(20\d\d)", 1)]
    return F.coalesce(*(F.nullif(t, F.lit("")).cast("int") for t in tries))


def last_declaration_year(day: Column) -> Column:
    return F.year(day) - F.when(F.month(day) >= 5, 1).otherwise(2)


def seconds(c: Column) -> Column:
    """'14h', '3m', '2d', '10s' or a plain number."""
    n = F.regexp_extract(c, r"^(\d+)\s*[smhd]?$", 1).try_cast("long")
    unit = F.regexp_extract(F.lower(c), r"([smhd])$", 1)
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).otherwise(1)


def any_token(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"\W+"), F.array(*(F.lit(w.lower()) for w in words)))


def all_tokens(text: Column, words: list[str]) -> Column:
    return F.size(F.array_except(F.array(*(F.lit(w.lower()) for w in words)), F.split(F.lower(text), r"\W+"))) == 0


def in_latin(c: Column) -> Column:
    """Cyrillic letters as Latin ones, in lower case."""
    one = {k: v for k, v in IN_LATIN.items() if len(v) == 1}
    out = F.translate(F.lower(c), "".join(one), "".join(one.values()))
    for k, v in IN_LATIN.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def vehicle_key(c: Column) -> Column:
    """A vehicle's name for comparison: Latin letters, no spaces or hyphens."""
    return F.regexp_replace(in_latin(c), r"[\s\-]", "")


def brands(c: Column, known: Column) -> Column:
    """Brands that a vehicle text names, in order, without repeats in a row. known: map of a brand's first word (as in_latin gives it) to the brand."""
    words = F.split(in_latin(one_space(c)), r"[ ,;()]+")
    heads = F.transform(words, lambda w: F.coalesce(known[w], known[F.split_part(w, F.lit("-"), F.lit(1))]))
    named = F.filter(heads, lambda b: b.isNotNull())
    return F.filter(F.transform(named, lambda b, i: F.when((i == 0) | (b != F.get(named, i - 1)), b)), lambda b: b.isNotNull())
