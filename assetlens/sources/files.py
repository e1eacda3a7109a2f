"""Files as DataFrames: access logs, call logs, pools, office documents, archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
CALLS = "worker_ip string, project_file string, exit_code int, start_time bigint, end_time bigint, result_files_count int, worker_host_name string, reach_status string, web_site string"
BOTS = "(?i)bot|crawler|spider|slurp"


def access_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of a web server's log, as columns; lines of another form are left out."""
    part = lambda k: F.regexp_extract(F.col(value), ACCESS, k)
    rows = lines.filter(F.col(value).rlike(ACCESS)).select(part(1).alias("host"), part(2).alias("user"), F.try_to_timestamp(part(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"), part(4).alias("request"), part(5).cast("int").alias("status"), part(6).try_cast("bigint").alias("size"), part(7).alias("referrer"), part(8).alias("agent"))
    return rows.withColumns({"method": F.split_part("request", F.lit(" "), F.lit(1)), "path": F.split_part("request", F.lit(" "), F.lit(2))})


def page_frequency(log: DataFrame, least: int = 3) -> DataFrame:
    """Requests of section and person pages by people: record type, id and frequency."""
    place = r"^/(section|person)/(\d+)/?$"
    good = log.filter((F.col("method") == "GET") & (F.col("status") == 200) & ~F.col("agent").rlike(BOTS) & F.col("path").rlike(place))
    return good.groupBy(F.regexp_extract("path", place, 1).alias("record_type"), F.regexp_extract("path", place, 2).try_cast("bigint").alias("record_id")).agg(F.count("*").alias("req_freq")).filter(F.col("req_freq") >= least)


def remote_calls(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """Calls from a time on; lines that aren't JSON are left out."""
    return spark.read.schema(CALLS + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).filter(f"_bad is null and start_time >= {int(since)}").drop("_bad")


def pool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated pool; rows with too few or too many fields are left out."""
    return spark.read.schema(schema + ", _bad string").options(sep="\t", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", quote="").csv(path).filter("_bad is null").drop("_bad")


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup="true").load(path).select("path", "length", "content")


def _xlsx(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        for k, name in enumerate(sheets):
            for r, row in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row")):
                for c, cell in enumerate(row.findall("m:c", ns)):
                    v, letters = cell.find("m:v", ns), "".join(x for x in cell.get("r", "") if x.isalpha())
                    col = c
                    if letters:
                        col = 0
                        for x in letters:
                            col = col * 26 + ord(x.upper()) - 64
                        col -= 1
                    inline = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
                    text = shared[int(v.text)] if cell.get("t") == "s" and v is not None else inline or (v.text if v is not None else "") or ""
                    yield k, int(row.get("r", r + 1)) - 1, col, text


def _docx(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for k, table in enumerate(root.iter(f"{w}tbl")):
        for r, row in enumerate(table.findall(f"{w}tr")):
            at = 0
            for cell in row.findall(f"{w}tc"):
                span = cell.find(f"{w}tcPr/{w}gridSpan")
                yield k, r, at, "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in cell.findall(f"{w}p")).strip()
                at += int(span.get(f"{w}val", "1")) if span is not None else 1


READERS = {"xlsx": _xlsx, "docx": _docx}


def office_cells(files: DataFrame) -> DataFrame:
    """path, sheet, row, col, text of the cells of xlsx sheets and docx tables; error says why a file gave none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = READERS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    out += [(path, *cell, None) for cell in read(data)] if read else [(path, None, None, None, None, "no reader")]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    out.append((path, None, None, None, None, type(e).__name__))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names=["path", "sheet", "row", "col", "text", "error"])

    return files.select("path", "content").mapInArrow(each, "path string, sheet int, row int, col int, text string, error string")


def expanded(files: DataFrame) -> DataFrame:
    """Members of zip and tar archives: path, index, name, content. Other files, broken ones too, have none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, data: bytes) -> Iterator[tuple]:
            if zipfile.is_zipfile(io.BytesIO(data)):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield from ((path, k, i.filename, z.read(i)) for k, i in enumerate(x for x in z.infolist() if not x.is_dir()))
            else:
                try:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        yield from ((path, k, m.name, t.extractfile(m).read()) for k, m in enumerate(x for x in t if x.isfile()))
                except tarfile.TarError:
                    return

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows(path, data or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.string(), pa.int32(), pa.string(), pa.binary()], strict=True)], names=["path", "index", "name", "content"])

    return files.select("path", "content").mapInArrow(each, "path string, index int, name string, content binary")
