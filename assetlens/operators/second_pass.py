"""From the texts of a declaration's cells to typed records: incomes, vehicles, real estate, names with positions, sheets and documents.

All of it is column expressions, so a row of cells is parsed inside the scan's own stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions import names, text
from assetlens.functions.realty import countries
from assetlens.functions.realty import squares as squares_in

#: Income columns in the order in which they are tried: (field, in thousands, months).
INCOME_FIELDS = [("income_thousands", True, 1), ("income", False, 1), ("declarant_income_thousands", True, 1), ("declarant_income", False, 1), ("monthly_income", False, 12), ("monthly_income_thousands", True, 12)]
#: Beginnings of words for positions, and days of the week.
ROLES = ["заместител", "начальник", "директор", "председател", "главн", "ведущ", "специалист", "консультант", "министр", "депутат", "советник", "помощник", "руководител", "инспектор", "глава"]
WEEK_DAYS = ["понедельник", "вторник", "среда", "четверг", "пятница", "суббота", "воскресенье"]
OWNED, STATE = "В собственности", "В пользовании"
#: Real estate that a column's title names, and its type. Living houses count as land, as the register has it.
TYPE_OF_COLUMN = {"land_area": "земельный участок", "living_house": "земельный участок", "apartment": "квартира", "summer_house": "дача", "garage": "гараж"}


def blank(c: Column | str) -> Column:
    return text.is_empty_value(F.col(c) if isinstance(c, str) else c)


def income(row: list[str], ignore_thousands: Column) -> Column:
    """struct<size, field> of the first income column (of those that the table has) that isn't empty; whole years, in roubles.

    Columns in thousands count so unless the document's amounts are known to be plain (``ignore_thousands``); a text with its own 'тыс.'
    is in thousands anyway."""
    out = None
    for field, thousands, months in INCOME_FIELDS:
        if field not in row:
            continue
        c = F.col(field)
        scale = F.when(F.lit(thousands) & ~ignore_thousands & ~F.lower(c).contains("тыс"), 1000.0).otherwise(1.0) * months
        value = F.struct(F.round(text.roubles(F.regexp_replace(c, r"(?s).*Общая\s+сумма\s+доходов:", "")) * scale, 2).alias("size"), F.lit(field).alias("field"))
        out = F.when(~blank(c), value) if out is None else out.when(~blank(c), value)
    return out


def without_none(c: Column) -> Column:
    return F.nullif(F.trim(F.replace(c, F.lit("не имеет"), F.lit(""))), F.lit(""))


def split_by_empty_lines(c: Column) -> Column:
    """Parts of a text between empty lines, trimmed."""
    parts = F.transform(F.split(F.regexp_replace(c, r"[^\S\n]+\n", "\n"), r"\n\n+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def vehicles(row: list[str]) -> Column:
    """array<struct<text, type, model>> by the table's layout: one column for vehicles, one for the declarant's, or type and model apart
    (several models between empty lines are vehicles of their own)."""
    one = lambda t, k, m: F.struct(t.alias("text"), k.cast("string").alias("type"), m.cast("string").alias("model"))
    none = F.array().cast("array<struct<text: string, type: string, model: string>>")
    for field in ("vehicle", "declarant_vehicle"):
        if field in row:
            c = without_none(F.col(field))
            return F.when(c.isNull() | blank(c), none).otherwise(F.array(one(c, F.lit(None), F.lit(None))))
    if "vehicle_type" not in row:
        return none
    kind, model = without_none(F.col("vehicle_type")), without_none(F.col("vehicle_model"))
    models = F.coalesce(split_by_empty_lines(model), F.array().cast("array<string>"))
    whole = F.when(kind == model, one(kind, kind, F.lit(""))).otherwise(one(F.trim(F.concat_ws(" ", kind, model)), F.coalesce(kind, F.lit("")), F.coalesce(model, F.lit(""))))
    several = F.transform(models, lambda m: one(m, F.lit(""), m))
    return F.when(F.size(models) > 1, several).when((kind.isNotNull() & ~blank(kind)) | (model.isNotNull() & ~blank(model)), F.array(whole)).otherwise(none)


def numbered_lines(c: Column) -> Column:
    """Numbers (from 0) of the lines that begin with a digit from 1 to 9."""
    lines = F.split(c, "\n")
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*[1-9]"), i)), lambda i: i.isNotNull())


#: What parts the items of a cell, the surest mark first. A number or a dash begins an item, the others stand between two.
ITEM_MARKS = {
    "number": r"(?:^|\s)\d{1,2}\s?[.)](?!\d)",
    "dash": r"(?:^|\n|(?<=\)\s))\s*[\p{Pd}•]\s",
    "blank line": r"\n\s*\n",
    "semicolon": ";",
    "bracket": r"(?<=\))",
    "line": "\n",
}


def split_items(c: Column, starts: Column) -> Column:
    """The items of a cell that holds several; ``starts``: the lines at which items begin in the cell beside it, the squares.

    Each kind of mark gives a list of items. The one whose length is nearest to the number of starts is taken, of several the surest.
    Last comes a list by lines: those from one start to the next are an item, for cells that go on over several lines."""
    tidy = lambda x: F.regexp_replace(text.one_space(x), r"^[\s\p{Pd};]+|[\s;]+$", "")
    kept = lambda xs: F.filter(F.transform(xs, tidy), lambda x: x != "")

    def chosen(s: Column) -> Column:
        lines, n = F.split(s["c"], "\n"), F.size(s["starts"])
        item_of = lambda i: F.size(F.filter(s["starts"], lambda x: x <= i))
        by_starts = F.transform(s["starts"], lambda _, k: F.array_join(F.filter(lines, lambda x, i: F.greatest(item_of(i), F.lit(1)) == k + 1), " "))
        lists = [*(F.split(s["c"], mark) for mark in ITEM_MARKS.values()), by_starts]
        # a list of as many items as there are starts can't be beaten by a less sure one, so the lists after it aren't made
        exact = [F.get(F.filter(F.transform(F.array(xs), kept), lambda k: F.size(k) == n), F.lit(0)) for xs in lists]
        choice = [F.struct(F.abs(F.size(kept(xs)) - n).alias("off"), F.lit(k).alias("rank"), kept(xs).alias("items")) for k, xs in enumerate(lists)]
        return F.coalesce(*exact, F.array_min(F.array(*choice))["items"])

    # a lambda binds the cell and its starts once; as plain expressions they would be made anew wherever they stand
    return F.get(F.transform(F.array(F.struct(c.alias("c"), starts.alias("starts"))), chosen), F.lit(0))


def realty(types: str, own_types: str | None, square: str, country: str, owned: bool) -> Column:
    """array<struct<text, type, own_type, square, country, by_column>> of a row's cells for real estate.

    Square and country are put right if they are swapped. Where the squares' cell has several numbered lines all cells are split into
    items; one country stands for all. own_types is None where the types' cell tells the kind of ownership, too."""
    c = {k: F.coalesce(F.col(v), F.lit("")) if v else F.lit("") for k, v in (("types", types), ("own", own_types), ("square", square), ("country", country))}
    swapped = F.lower(F.trim(c["square"])).isin("россия", "рф") & c["country"].rlike("[0-9,.]")
    area, land = F.when(swapped, c["country"]).otherwise(c["square"]), F.when(swapped, c["square"]).otherwise(c["country"])
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    whole = F.struct(c["types"].alias("types"), c["own"].alias("own"), area.alias("square"), land.alias("country"))

    def items(s: Column) -> Column:
        def parts(starts: Column) -> Column:
            split = lambda x: F.when(F.size(starts) > 1, split_items(x, starts)).otherwise(F.array(text.one_space(x)))
            own = {k: split(s[k]).alias(k) for k in ("types", "own", "square", "country")}
            only = lambda xs: F.when(F.size(F.array_distinct(xs)) == 1, F.get(xs, F.lit(0)))
            return bound(F.struct(*own.values()), lambda x: F.struct(*(x[k].alias(k) for k in own), only(x["country"]).alias("only")))

        return bound(numbered_lines(s["square"]), parts)

    def rows(s: Column) -> Column:
        n = F.greatest(F.size(s["types"]), F.size(s["square"]))
        only = s["only"]
        one = lambda i: F.struct(
            F.coalesce(F.get(s["types"], i), F.lit("")).alias("text"), F.get(s["own"], i).alias("own_type"), F.get(squares_in(F.get(s["square"], i)), F.lit(0)).alias("square"),
            F.coalesce(F.get(countries(F.coalesce(F.get(s["country"], i), only)), F.lit(0)), F.coalesce(F.get(s["country"], i), only)).alias("country"))
        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), one), lambda r: ~text.is_empty_value(r["text"]))

    found = bound(bound(whole, items), rows)
    in_use = lambda r: F.when(F.lower(r["text"]).contains("пользовани"), STATE)
    own = lambda r: F.nullif(r["own_type"], F.lit("")) if own_types else in_use(r)
    kind = lambda r: r["text"] if own_types or not owned else F.lit(None).cast("string")
    return F.transform(found, lambda r: F.struct(r["text"].alias("text"), kind(r).alias("type"), own(r).alias("own_type"), r["square"].alias("square"), r["country"].alias("country"), F.lit(OWNED if owned else STATE).alias("by_column")))


def realty_of_column(c: Column, column: str) -> Column:
    """array<struct<text, type, square>> of a column that holds one type of real estate, cut after every square."""
    parts = F.split(F.regexp_replace(c, r"(?i)(кв\.?\s*м\.?)", "$1\u0001"), "\u0001")
    rows = F.transform(F.filter(parts, lambda p: p.rlike(r"\d")), lambda p: F.struct(text.one_space(F.regexp_replace(p, r"^[\s;,]+", "")).alias("text"), F.lit(TYPE_OF_COLUMN.get(column)).alias("type"), text.square(p).alias("square")))
    return F.when(blank(c), F.array().cast("array<struct<text: string, type: string, square: double>>")).otherwise(rows)


#: Kinds of tokens (the first pattern that fits names the kind), and the order of kinds that a name has: family, first name and
#: patronymic; patronymic second; family with initials before or behind; two or three words before a dash.
TOKEN_KINDS = {
    "d": r"^\p{Pd}$",
    "r": "(?iu)^(" + "|".join(ROLES) + ")",
    "i": r"^\p{Lu}\.(\p{Lu}\.?)?$",
    "p": rf"(?i)^\p{{L}}.*({names.PATRONYMIC_MALE}|{names.PATRONYMIC_FEMALE})",
    "w": r"^\p{Lu}",
}
NAME_OF_KINDS = "wwp|wpw|wi{1,2}|i{1,2}w|^w{2,3}(?=d)"


def name_and_position(c: Column) -> Column:
    """struct<name, position> of a cell with both, in any order; null where no name is found.

    Every token (between spaces and commas) gets a letter for its kind, and one search over the letters finds the name's place. What
    is left of the tokens is the position."""

    def kind(w: Column) -> Column:
        out = None
        for letter, pattern in TOKEN_KINDS.items():
            out = F.when(w.rlike(pattern), letter) if out is None else out.when(w.rlike(pattern), letter)
        return out.otherwise("x")

    def found(t: Column) -> Column:
        kinds = F.array_join(F.transform(t, kind), "")
        at, n = F.regexp_instr(kinds, F.lit(NAME_OF_KINDS)), F.length(F.regexp_extract(kinds, NAME_OF_KINDS, 0))
        words = lambda start, many: F.array_join(F.filter(F.slice(t, start, many), lambda w: ~w.rlike(r"^\p{Pd}$")), " ")
        rest = F.concat_ws(" ", F.nullif(words(F.lit(1), at - 1), F.lit("")), F.nullif(words(at + n, F.greatest(F.size(t) - at - n + 1, F.lit(0))), F.lit("")))
        return F.when(at > 0, F.struct(words(at, n).alias("name"), rest.alias("position")))

    tokens = F.filter(F.split(F.regexp_replace(c, r"^\s*\d+\s*[.)]", ""), r"[,\s]+"), lambda w: w != "")
    return F.get(F.transform(F.array(tokens), found), F.lit(0))


def before_week_days(cells: DataFrame) -> DataFrame:
    """Cells of the rows before a table's first row that holds days of the week only; all later rows go, too."""
    day = F.lower(F.trim("text")).isin(WEEK_DAYS)
    rows = cells.groupBy("doc_id", "tbl", "row").agg(F.bool_and(day | (F.trim("text") == "")).alias("days"), F.bool_or(day).alias("any"))
    first = rows.filter("days and any").groupBy("doc_id", "tbl").agg(F.min("row").alias("_end"))
    return cells.join(first, ["doc_id", "tbl"], "left").filter(F.col("_end").isNull() | (F.col("row") < F.col("_end"))).drop("_end")


def document_id(path: Column) -> Column:
    """struct<documentfile_id, archive_file> of a path: the number of the folder, unless it is a year from 2000 to 2020; else the file's own number."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1).try_cast("bigint")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    of_folder = folder.isNotNull() & ~folder.between(2000, 2020)
    return F.struct(F.when(of_folder, folder).otherwise(F.regexp_replace(name, r"\.[^.]*$", "").try_cast("bigint")).alias("documentfile_id"), F.when(of_folder, name).alias("archive_file"))


def income_year(title: Column, column_title: Column, file: Column) -> Column:
    """The later year of the document's title and its income column's title, else one in the file's name."""
    return F.coalesce(F.greatest(text.title_year(title), text.year_in(column_title)), text.year_in(file))


def error_budget(rows: DataFrame, doc: str, error: Column, good: int = 10, errors: int = 10) -> DataFrame:
    """Documents that stay: no more than ``errors`` errors before ``good`` declarants are read."""
    order = Window.partitionBy(doc).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_bad", F.count_if(error).over(order)).withColumn("_good", F.count_if(~error).over(order))
    return seen.groupBy(doc).agg(F.bool_or((F.col("_bad") > errors) & (F.col("_good") < good)).alias("aborted"), F.count_if(error).alias("errors"), F.count_if(~error).alias("declarants"))


def merged_rows(rows: DataFrame, doc: str, order: str, starts: Column, *columns: str) -> DataFrame:
    """Rows that go on from the one before (continuation rows) become one: texts joined by a space, in order."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = rows.withColumn("_k", F.sum(starts.cast("int")).over(w))

    def joined(c: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(c).alias("_x"))))
        return F.trim(F.array_join(F.transform(parts, lambda s: s["_x"]), " ")).alias(c)

    return islands.groupBy(doc, "_k").agg(F.min(order).alias(order), *map(joined, columns)).drop("_k")


TABLE_JSON = "Title string, InputFileName string, DataStart int, DataEnd int, " + ", ".join(f"{k} array<array<struct<t: string, mc: int, mr: int, r: int, c: int>>>" for k in ("Header", "Section", "Data"))


def annotated_cells(files: DataFrame, id_: str, json: str) -> DataFrame:
    """Cells (doc_id, tbl, row, col, span, rows, text) of tables kept as JSON: title, section, header and data rows, one after the other."""
    t = files.select(F.col(id_).alias("doc_id"), F.from_json(json, TABLE_JSON).alias("t")).filter("t is not null")
    rows = F.concat(*(F.coalesce(F.col(f"t.{k}"), F.array().cast("array<array<struct<t: string, mc: int, mr: int, r: int, c: int>>>")) for k in ("Section", "Header", "Data")))
    cells = t.select("doc_id", F.posexplode(rows).alias("row", "cells")).select("doc_id", "row", F.posexplode("cells").alias("col", "cell"))
    return cells.select("doc_id", F.lit(0).alias("tbl"), "row", "col", F.greatest(F.coalesce("cell.mc", F.lit(1)), F.lit(1)).alias("span"), F.greatest(F.coalesce("cell.mr", F.lit(1)), F.lit(1)).alias("rows"), F.coalesce("cell.t", F.lit("")).alias("text"))


def declarations(persons: DataFrame, incomes: DataFrame, estates: DataFrame, vehicles_: DataFrame) -> DataFrame:
    """doc_id and json: a document's persons with what they declare, empty declarants left out, nulls dropped."""
    key = ["doc_id", "person_index"]
    lists = [df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in key]))).alias(name)) for name, df in (("incomes", incomes), ("real_estates", estates), ("vehicles", vehicles_))]
    rows = persons
    for other in lists:
        rows = rows.join(other, key, "left")
    rows = rows.filter("incomes is not null or real_estates is not null or vehicles is not null")
    person = F.struct("person_index", F.struct(F.col("name").alias("name_raw"), F.col("position").alias("role")).alias("person"), "incomes", "real_estates", "vehicles")
    return rows.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(person)).alias("persons"))).alias("json"))
