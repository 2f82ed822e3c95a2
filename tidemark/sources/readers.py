"""Sources: article files, price tables, stores, feeds, archives and settings, with explicit schemas."""

from __future__ import annotations

import csv
import dataclasses
import io
import json
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta
from pathlib import Path, PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "date string, title string, news string, url string"
PRICES = "Date string, Symbol string, Company string, `Index` string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double, Dividends double, `Stock Splits` double"
FILINGS = "symbol string, isin string, date date, announced_at timestamp, after_close boolean, bse_category string, bse_subcategory string, bse_headline string, path string"
STORE = "p string, pages int, t string"


def united(parts: dict[str, DataFrame], day: str = "date") -> DataFrame:
    """Tables of one form as one, with their name (src) and the day (d) that the first ten characters of a text column say, if they do."""
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("src"), F.expr(f"try_cast(substring({day}, 1, 10) as date)").alias("d"), *[c for c in rows.columns if c != day])
        out = one if out is None else out.unionByName(one)
    return out


def corpus(spark: SparkSession, paths: dict[str, str], lead: int = 4000, columns: list[str] | None = None) -> DataFrame:
    """Article CSV files by source name: all columns text, the day by try_cast, the body's first `lead` characters. With `columns` only these (of src, d, title, news, url) are parsed."""
    read = lambda path: spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(ARTICLE).csv(path)
    out = united({n: read(p).withColumn("news", F.substring("news", 1, lead)) for n, p in paths.items()})
    if out is None:
        out = spark.createDataFrame([], "src string, d date, title string, news string, url string")
    return out.select(columns) if columns else out


def about(rows: DataFrame, pattern: str, since: str = "2020-01-01", until: str | None = None, not_url: str | None = None) -> DataFrame:
    """Rows from a day on whose title, or the first 400 characters of the body, match."""
    hit = F.col("title").rlike(f"(?i){pattern}") | F.substring(F.coalesce("news", F.lit("")), 1, 400).rlike(f"(?i){pattern}")
    out = rows.filter((F.col("d") >= since) & F.col("title").isNotNull() & hit)
    if until:
        out = out.filter(F.col("d") <= until)
    return out.filter(~F.coalesce("url", F.lit("")).rlike(not_url)) if not_url else out


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Price CSV files; the day is the text's first ten characters, whatever offset follows."""
    t = spark.read.option("header", True).schema(PRICES).csv(path)
    return t.select(F.col("Symbol").alias("symbol"), F.to_date(F.substring("Date", 1, 10)).alias("d"), F.col("Open").alias("o"), F.col("High").alias("h"), F.col("Low").alias("l"), F.col("Close").alias("c"), F.col("Adj Close").alias("adj"), F.col("Volume").alias("v"))


def preferred(first: DataFrame, second: DataFrame, key: str = "symbol") -> DataFrame:
    """All of `first`, and of `second` what has keys that `first` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def parquet_some(spark: SparkSession, paths: list[str], columns: list[str] | dict[str, str]) -> DataFrame:
    """Several Parquet inputs with whichever of the columns they have; others are null, of the type that a dict of columns names, else text."""
    t = spark.read.option("mergeSchema", True).parquet(*paths)
    kinds = columns if isinstance(columns, dict) else dict.fromkeys(columns, "string")
    return t.select(*[F.col(c) if c in t.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])


def database_bars(spark: SparkSession, url: str, symbols: list[str], since: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Bars of a star schema over JDBC; filters and columns are pushed down."""
    props = properties or {}
    fact, dim = (spark.read.jdbc(url, t, properties=props) for t in ("fact_ohlcv", "dim_instruments"))
    return fact.filter((F.col("interval") == "1d") & (F.col("ts") >= since)).join(dim.filter(F.col("symbol").isin(symbols)), "instrument_id").select("symbol", F.to_date("ts").alias("d"), "open", "high", "low", "close", "volume").orderBy("symbol", "d")


def or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What `read` gives, or no rows if the source cannot be reached."""
    try:
        return read()
    except Exception:  # noqa: BLE001  any failure of an outside source
        return spark.createDataFrame([], schema)


def first_of_sources(*reads: Callable[[], DataFrame]) -> DataFrame:
    """What the first source that can be read gives; the last one's failure is raised."""
    for read in reads[:-1]:
        try:
            found = read()
            found.isEmpty()
            return found
        except Exception:  # noqa: BLE001  any failure of an outside source
            continue
    return reads[-1]()


def text_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines text store keyed by path; of several entries the longest counts."""
    return spark.read.schema(STORE).json(path).groupBy("p").agg(F.max_by(F.struct("pages", "t"), F.length("t")).alias("x")).select("p", "x.*")


def documents(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """Text of binary files by a pluggable extractor; a file that fails has empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": b.path, "t": [_tried(extract, bytes(c)) for c in b.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "p string, t string")


def _tried(extract: Callable[[bytes], str], content: bytes) -> str:
    try:
        return extract(content)
    except Exception:  # noqa: BLE001  one broken file
        return ""


def zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of CSV files inside zip archives, all columns text; columns that a file lacks are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".csv"):
                            yield pd.read_csv(z.open(name), dtype=str).reindex(columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def feed(xml: DataFrame, column: str = "xml", sources: dict[str, str] | None = None) -> DataFrame:
    """Items of RSS texts: published (UTC), the local day, title without the publisher, source, url. Bad dates drop out."""
    item = "array<struct<title:string,link:string,pubDate:string,source:struct<_VALUE:string,_url:string>>>"
    x = xml.select(F.explode(F.from_xml(column, f"struct<channel:struct<item:{item}>>", {"rowTag": "rss"})["channel"]["item"]).alias("i"))
    published = F.try_to_timestamp(F.substring("i.pubDate", 6, 40), F.lit("dd MMM yyyy HH:mm:ss z"))
    name = F.coalesce(F.col("i.source._VALUE"), F.lit(""))
    domain = F.regexp_extract(F.coalesce(F.col("i.source._url"), F.lit("")), r"^https?://(?:www\.)?([^/]+)", 1)
    short = F.create_map(*[F.lit(v) for kv in (sources or {"": ""}).items() for v in kv])[domain]
    title = F.when(F.endswith("i.title", F.concat(F.lit(" - "), name)) & (name != ""), F.expr("substring(i.title, 1, length(i.title) - length(i.source._VALUE) - 3)")).otherwise(F.col("i.title"))
    out = x.select(published.alias("published"), F.to_date(F.from_utc_timestamp(published, "Asia/Kolkata")).alias("d"), F.trim(title).alias("title"), F.coalesce(short, domain).alias("source"), F.col("i.link").alias("url"))
    return out.filter(F.col("published").isNotNull())


def query_text(names: list[str], sites: list[str], start: date | None = None, end: date | None = None) -> str:
    """The search text of a news feed."""
    parts = ["(" + " OR ".join(f'"{n}"' for n in names) + ")"]
    if sites:
        parts.append("(" + " OR ".join(f"site:{s}" for s in sites) + ")")
    return " ".join([*parts, *([f"after:{start}"] if start else []), *([f"before:{end}"] if end else [])])


def split_windows(fetch: Callable[[datetime, datetime], list], start: datetime, end: datetime, full: int, shortest: timedelta, depth: int = 6) -> list:
    """Rows of a window; a page that is full is asked again in halves, down to the shortest window."""
    rows = fetch(start, end)
    if len(rows) < full or end - start <= shortest or depth == 0:
        return rows
    middle = start + (end - start) / 2
    return split_windows(fetch, start, middle, full, shortest, depth - 1) + split_windows(fetch, middle, end, full, shortest, depth - 1)


def windows(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """(a, b): consecutive windows of a step such as `7 days` or `1 month` over [start, end]."""
    s = spark.sql(f"select explode(sequence(date '{start}', date '{end}', interval {step})) as a")
    return s.withColumn("b", F.least(F.date_sub((F.col("a") + F.expr(f"interval {step}")).cast("date"), 1), F.lit(end).cast("date")))


def guarded(rows: DataFrame, must: str | None, exclude: str | None) -> DataFrame:
    """Articles whose title or description match `must` and do not match `exclude`."""
    text = F.concat_ws(" ", "title", "description")
    out = rows.filter(text.rlike(f"(?i){must}")) if must else rows
    return out.filter(~text.rlike(f"(?i){exclude}")) if exclude else out


def unseen(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not known yet, each key once."""
    return rows.dropDuplicates(key).join(known.select(*key), key, "left_anti")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """A table read from `path`, built and written first if it is missing or asked for."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if rebuild or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def labelled_lines(lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """`text@label` lines as (text, label) with known labels only."""
    at = F.get(F.regexp_extract_all("value", F.lit(r"(?s)^(.*)@([^@]*)$"), F.lit(2)), 0)
    label = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.trim(at)]
    return lines.select(F.trim(F.regexp_extract("value", r"(?s)^(.*)@[^@]*$", 1)).alias("text"), label.alias("label")).filter("label is not null")


#: Labels that count.
LABELS = ("positive", "negative", "neutral")
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def decoded(content: bytes, encodings: tuple[str, ...] = ("utf-8-sig", "latin-1")) -> str:
    """The text of a file in the first encoding that fits."""
    for name in encodings[:-1]:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode(encodings[-1])


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """The cells of a workbook's sheet (the first one without a name), row by row, as text; a cell that is not there is empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in xml("xl/sharedStrings.xml").iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target", "") for r in xml("xl/_rels/workbook.xml.rels")}
        sheets = [(s.get("name"), targets[s.get(_LINK)]) for s in xml("xl/workbook.xml").iter(f"{_SHEET}sheet")]
        target = next((t for n, t in sheets if sheet is None or n == sheet), None)
        if target is None:
            raise ValueError(f"no sheet {sheet}")
        rows: list[list[str]] = []
        for row in xml(target.removeprefix("/") if target.startswith("/") else f"xl/{target}").iter(f"{_SHEET}row"):
            cells: list[str] = []
            for c in row.iter(f"{_SHEET}c"):
                letters = "".join(filter(str.isalpha, c.get("r", "")))
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [""] * ((at or len(cells) + 1) - 1 - len(cells))
                value = c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            rows.append(cells)
    return rows


def label_files(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """Rows of label files, all columns text, blank cells null: workbooks by their `sheet`, other files as CSV in UTF-8 with or without a mark, else in Latin-1. Columns that a file lacks are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                raw = bytes(content)
                rows = sheet_rows(raw, sheet) if name.lower().endswith(".xlsx") else list(csv.reader(io.StringIO(decoded(raw), newline="")))
                head = rows[0] if rows else []
                at = {c: head.index(c) for c in columns if c in head}
                yield pd.DataFrame([[r[at[c]].strip() or None if c in at and at[c] < len(r) else None for c in columns] for r in rows[1:] if any(r)], columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def label(c: Column, valid: tuple[str, ...] = LABELS) -> Column:
    """A label in lower case without blanks around it; null unless it is a valid one."""
    clean = F.lower(F.trim(c))
    return F.when(clean.isin(*valid), clean)


def own_or_draft(rows: DataFrame, own: str, draft: str) -> DataFrame:
    """Adds `label`, the own label where it is valid, else the draft, and `provisional` where the draft stands in."""
    return rows.withColumns({"label": F.coalesce(label(F.col(own)), label(F.col(draft))), "provisional": label(F.col(own)).isNull()})


def text_lines(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """Lines (value) of text files in UTF-8, else Latin-1; with `member`, of the first archive member whose name ends so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                raw = bytes(content)
                if member:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        raw = z.read(next(n for n in z.namelist() if n.endswith(member)))
                yield pd.DataFrame({"value": decoded(raw).splitlines()}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def from_report(spark: SparkSession, json_text: str, schema: str) -> DataFrame:
    """The rows of a report that `json_report` made."""
    return spark.createDataFrame([(json_text,)], "j string").select(F.explode(F.from_json("j", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def markdown_report(df: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """All rows as one Markdown table (markdown), in order, numbers rounded, nulls empty: for small published tables."""
    cells = [F.coalesce((F.round(c, digits) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)).cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(c, F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    lines = df.select(F.struct(*by, line.alias("_line")).alias("r")).agg(F.array_sort(F.collect_list("r"))["_line"].alias("lines"))
    return lines.select(F.array_join(F.concat(F.array(F.lit(head)), "lines"), "\n").alias("markdown"))


def json_report(df: DataFrame, by: list[str]) -> DataFrame:
    """All rows as one JSON text, in order: for small published tables."""
    ordered = df.select(F.struct(*by, *[c for c in df.columns if c not in by]).alias("r"))
    return ordered.agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("json"))


def pack(root: str | Path) -> bytes:
    """A state folder as tar.gz."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        t.add(root, arcname=".")
    return out.getvalue()


def unpack(blob: bytes, root: str | Path) -> None:
    """Unpacks a state; absolute paths, `..` and links are refused before anything is written."""
    with tarfile.open(fileobj=io.BytesIO(blob), mode="r:gz") as t:
        for m in t.getmembers():
            p = PurePosixPath(m.name)
            if p.is_absolute() or ".." in p.parts or not (m.isfile() or m.isdir()):
                raise ValueError(f"unsafe member {m.name}")
        t.extractall(root, filter="data")


@dataclasses.dataclass
class Settings:
    """Paths and the company; unknown keys in a file are refused, and the environment overrides."""

    target: str = "TCS"
    data: str = "data"
    results: str = "results"
    horizon: int = 10

    @classmethod
    def load(cls, path: str | Path | None = None, environment: dict[str, str] | None = None) -> Settings:
        given = json.loads(Path(path).read_text()) if path else {}
        fields = {f.name: f for f in dataclasses.fields(cls)}
        if unknown := set(given) - set(fields):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name, f in fields.items():
            if (v := (environment or {}).get(f"TIDEMARK_{name.upper()}")) is not None:
                given[name] = int(v) if f.type in ("int", int) else v
        return cls(**given)


def env_file(text: str) -> dict[str, str]:
    """KEY=value lines; comments and blank lines are left out, quotes around values too."""
    pairs = (line.split("=", 1) for line in map(str.strip, text.splitlines()) if line and not line.startswith("#") and "=" in line)
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def mapped(c: Column, names: dict[str, str]) -> Column:
    """A constant map of codes, null for unknown ones."""
    return F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[c]
