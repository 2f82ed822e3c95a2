"""Paged web sources as a Spark data source: windows are planned as partitions, pages are followed, failures tried again, and the place is kept.

`Api` says how a service is asked. `PagedSource` reads windows of days for keys (company codes, search texts): a row for each record, as
JSON text, and one row without a record for each window that is complete. `harvest` reads group after group of windows into a
folder and notes the complete ones, so a run that is killed goes on where it stopped and every record is there once.
"""

from __future__ import annotations

import dataclasses
import http.cookiejar
import io
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators import daily

SCHEMA = "key string, a date, b date, n int, record string"
MANIFEST = "key string, a date, b date, load long, folder string"


class OutOfBudget(Exception):
    """A task has made as many requests as it may."""


@dataclasses.dataclass(frozen=True)
class Api:
    """How a service is asked.

    urls: (first day, template) pairs, the last one that has begun counts; templates and params may hold {key}, {a} and {b} with
    strftime formats, and {page}. paging: `number` (1, 2, ... until a page has fewer than `full` records), `token` (the field `token` of an answer leads on), `split` (a window whose answer is full is asked
    again in halves, down to `shortest` days) or `one`. records: path of the records in the answer, dotted. form: `json` or `zip` (CSV files in an archive).
    """

    urls: tuple[tuple[str, str], ...]
    params: tuple[tuple[str, str], ...] = ()
    headers: tuple[tuple[str, str], ...] = ()
    paging: str = "number"
    page_param: str = "page"
    token: str = "nextPage"
    records: str = ""
    form: str = "json"
    full: int = 20
    most_pages: int = 59
    shortest: int = 1
    seed: str = ""
    attempts: int = 4
    wait: float = 2.0
    pause: float = 0.0
    timeout: float = 30.0
    weekdays: bool = False

    @classmethod
    def parse(cls, text: str) -> Api:
        fixed = lambda v: tuple(tuple(x) for x in v) if isinstance(v, list) else v
        return cls(**{k: fixed(v) for k, v in json.loads(text).items()})

    def text(self) -> str:
        return json.dumps(dataclasses.asdict(self))


#: Answers that a later attempt may mend; 404 says that there is nothing.
AGAIN = {301, 302, 403, 408, 425, 429, 500, 502, 503, 504}


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects are answers, not followed: services send robots elsewhere."""

    def redirect_request(self, *args, **kwargs):
        return None


class Session:
    """One task's connection: cookies, a seed page, waits between requests, attempts, and a budget of requests."""

    def __init__(self, api: Api, budget: int | None = None, sleep=time.sleep):
        self.api, self.left, self.sleep, self.asked = api, budget, sleep, 0
        self.opener = urllib.request.build_opener(_Stay(), urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))
        self._visit()

    def _visit(self) -> None:
        if self.api.seed:
            try:
                self.opener.open(urllib.request.Request(self.api.seed, headers=dict(self.api.headers)), timeout=self.api.timeout).read()
            except OSError:
                pass  # only the cookies would be missing; the real request tells

    def get(self, url: str) -> bytes | None:
        """The answer's body, or None if there is nothing (404). Raises when all attempts fail."""
        failed = ""
        for attempt in range(self.api.attempts):
            if self.left is not None:
                if self.left == 0:
                    raise OutOfBudget
                self.left -= 1
            if self.asked and self.api.pause:
                self.sleep(self.api.pause * random.uniform(0.6, 1.4))
            self.asked += 1
            asked_to_wait = 0.0
            try:
                with self.opener.open(urllib.request.Request(url, headers=dict(self.api.headers)), timeout=self.api.timeout) as r:
                    return r.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code not in AGAIN:
                    raise RuntimeError(f"HTTP {e.code} from {url}") from e
                failed = f"HTTP {e.code}"
                later = e.headers.get("Retry-After", "")
                asked_to_wait = float(later) if later.isdigit() else 0.0
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                failed = type(e).__name__
            if attempt + 1 < self.api.attempts:
                self.sleep(max(asked_to_wait, self.api.wait * 2**attempt * random.uniform(1, 1.25)))
                self._visit()
        raise RuntimeError(f"{failed} from {url} after {self.api.attempts} attempts")

    def page(self, key: str, a: datetime, b: datetime, page: str | None) -> tuple[list[dict], str | None]:
        """(records, token of the next page)."""
        api, named = self.api, {"key": key, "a": a, "b": b, "page": page or ""}
        template = next(t for since, t in reversed(api.urls) if not since or a.date() >= date.fromisoformat(since))
        query = {k: v.format(**named) for k, v in api.params}
        if page and api.paging in ("number", "token"):
            query[api.page_param] = page
        url = template.format(**{**named, "key": urllib.parse.quote(key, safe="")})
        body = self.get(url + ("?" + urllib.parse.urlencode(query) if query else ""))
        if body is None:
            return [], None
        if api.form == "zip":
            return _unzipped(body), None
        answer = json.loads(body or b"{}")
        rows = answer
        for step in filter(None, api.records.split(".")):
            rows = rows.get(step) if isinstance(rows, dict) else None
        token = answer.get(api.token) if isinstance(answer, dict) else None
        return [r for r in rows or [] if isinstance(r, dict)], None if token in (None, "") else str(token)

    def window(self, key: str, a: datetime, b: datetime, depth: int = 0) -> list[dict]:
        """All records of a window [a, b]."""
        api, rows, page = self.api, [], "1" if self.api.paging == "number" else None
        for n in range(1, api.most_pages + 1):
            got, token = self.page(key, a, b, page)
            rows += got
            if api.paging == "number":
                if len(got) < api.full:
                    return rows
                page = str(n + 1)
            elif api.paging == "token":
                if token is None:
                    return rows
                page = token
            elif api.paging == "split" and len(got) >= api.full:
                days = (b - a).days + 1
                if days <= api.shortest:
                    raise RuntimeError(f"{api.full} records or more in {days} days from {a:%Y-%m-%d}: the service gives no more of them")
                middle = a + timedelta(days=days // 2 - 1)
                return self.window(key, a, middle, depth + 1) + self.window(key, middle + timedelta(days=1), b, depth + 1)
            else:
                return rows
        raise RuntimeError(f"more than {api.most_pages} pages for {key} from {a:%Y-%m-%d}: ask for shorter windows")


def _unzipped(body: bytes) -> list[dict]:
    rows: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        for name in z.namelist():
            if name.lower().endswith(".csv"):
                rows += pd.read_csv(z.open(name), dtype=str).rename(columns=str.strip).to_dict("records")
    return [{k: None if pd.isna(v) else v.strip() for k, v in r.items()} for r in rows]


class Windows(InputPartition):
    def __init__(self, windows: list[tuple[str, str, str]], budget: int | None):
        self.windows, self.budget = windows, budget


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.api = Api.parse(options["api"])
        self.windows = [tuple(w) for w in json.loads(options["windows"])]
        self.tasks = int(options.get("tasks", 8))
        self.budget = int(options["budget"]) if options.get("budget") else None

    def partitions(self) -> list[InputPartition]:
        """Windows dealt out over at most `tasks` connections, the budget of requests with them."""
        n = max(1, min(self.tasks, len(self.windows)))
        share = lambda k: None if self.budget is None else self.budget // n + (k < self.budget % n)
        return [Windows(self.windows[k::n], share(k)) for k in range(n)]

    def read(self, partition: Windows) -> Iterator[tuple]:
        session = Session(self.api, partition.budget) if partition.windows else None
        for key, a, b in partition.windows:
            first, last = date.fromisoformat(a), date.fromisoformat(b)
            try:
                rows = session.window(key, datetime.fromisoformat(a), datetime.fromisoformat(b))
            except OutOfBudget:
                return  # this window and those after it stay open
            for n, r in enumerate(rows):
                yield key, first, last, n, json.dumps(r)
            yield key, first, last, -1, None


class PagedSource(DataSource):
    """Options: `api` (Api.text()), `windows` (JSON of [key, first day, last day]), `tasks`, `budget` (requests of one read)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def pages(spark: SparkSession, api: Api, windows: list[tuple[str, date, date]], tasks: int = 8, budget: int | None = None) -> DataFrame:
    """Records of the windows (SCHEMA); n = -1 and no record marks a complete window."""
    spark.dataSource.register(PagedSource)
    asked = json.dumps([(k, a.isoformat(), b.isoformat()) for k, a, b in windows])
    read = spark.read.format("tidemark_pages").option("api", api.text()).option("windows", asked).option("tasks", str(tasks))
    return (read if budget is None else read.option("budget", str(budget))).load()


def windows(keys: list[str], since: date, until: date, days: int, weekdays: bool = False) -> list[tuple[str, date, date]]:
    """Consecutive windows of `days` for every key; with `weekdays`, single days without Saturdays and Sundays."""
    step, out = 1 if weekdays else days, []
    for key in keys:
        a = since
        while a <= until:
            b = min(a + timedelta(days=step - 1), until)
            if not weekdays or a.weekday() < 5:
                out.append((key, a, b))
            a = b + timedelta(days=1)
    return out


class Harvest:
    """Records of a paged service below one folder, and which windows are complete.

    Each job writes its records to a folder of its own and then appends its complete windows, with that folder's name, to the manifest. Only what the manifest
    names is read, so what a killed job leaves behind does not count. A window that ends before `today` is asked once; one that is still open
    is asked again, and its newest answer counts.
    """

    def __init__(self, spark: SparkSession, folder: str, api: Api, tasks: int = 8):
        self.spark, self.folder, self.api, self.tasks = spark, folder.rstrip("/"), api, tasks

    def manifest(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest") if there else self.spark.createDataFrame([], MANIFEST)

    def open_windows(self, asked: list[tuple[str, date, date]], today: date) -> list[tuple[str, date, date]]:
        done = {(r["key"], r["a"], r["b"]) for r in self.manifest().filter(F.col("b") < F.lit(today)).collect()}  # a row for each window ever asked
        return [w for w in asked if w not in done]

    def run(self, keys: list[str], since: date, today: date, days: int = 31, group: int = 64, budget: int | None = None) -> int:
        """Asks for all open windows up to today, `group` at a time; gives how many are complete now. `budget` bounds the requests of this run's jobs together."""
        todo, complete = self.open_windows(windows(keys, since, today, days, self.api.weekdays), today), 0
        load = (self.manifest().agg(F.max("load")).first()[0] or 0) + 1
        for at in range(0, len(todo), group):
            part = todo[at : at + group]
            share = None if budget is None else budget * len(part) // len(todo)
            target = f"{self.folder}/records/{uuid.uuid4().hex}"
            pages(self.spark, self.api, part, self.tasks, share).write.parquet(target)
            ended = self.spark.read.schema(SCHEMA).parquet(target).filter("n = -1").select("key", "a", "b", F.lit(load).cast("long").alias("load"), F.lit(target).alias("folder"))
            complete += ended.count()
            ended.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return complete

    def records(self, schema: str, unique: list[str] | None = None) -> DataFrame:
        """(key, a, b, n, the schema's columns) of all complete windows; with `unique`, the newest record of each such key."""
        known = self.manifest().groupBy("key", "a", "b").agg(F.max_by("folder", "load").alias("folder"), F.max("load").alias("load"))
        folders = [r["folder"] for r in known.select("folder").distinct().collect()]  # one for each job
        if not folders:
            rows = self.spark.createDataFrame([], f"{SCHEMA}, folder string")
        else:
            rows = self.spark.read.schema(SCHEMA).parquet(*folders).withColumn("folder", F.regexp_extract(F.input_file_name(), r"([0-9a-f]{32})/[^/]*$", 1))
        rows = rows.filter("n >= 0").join(known.withColumn("folder", F.regexp_extract("folder", r"([0-9a-f]{32})$", 1)), ["key", "a", "b", "folder"])
        out = rows.select("key", "a", "b", "n", "load", F.from_json("record", schema).alias("_r")).select("key", "a", "b", "n", "load", "_r.*")
        return (daily.latest(out, unique, ["load", "a", "n"]) if unique else out).drop("load")


def verified(spark: SparkSession, api: Api, expected: dict[str, str], field: str, since: date, until: date) -> DataFrame:
    """(key, name, ok): the name that the service's first record of each key bears, and whether it holds the expected text, whatever the case. No record: no name, not ok."""
    got = pages(spark, dataclasses.replace(api, most_pages=59), [(k, since, until) for k in expected])
    first = got.groupBy("key").agg(F.min_by(F.get_json_object("record", f"$.{field}"), F.when(F.col("n") >= 0, F.col("n"))).alias("name"))
    want = F.create_map(*[F.lit(v) for kv in expected.items() for v in kv])[F.col("key")]
    return first.select("key", "name", F.coalesce(F.contains(F.lower("name"), F.lower(want)), F.lit(False)).alias("ok"))


def probed(spark: SparkSession, api: Api, param: str, choices: list[str], key: str, since: date, until: date, wanted: Column) -> str:
    """The first value of a parameter for which the service gives a wanted record (a condition on `record`); the last one if none does."""
    for value in choices[:-1]:
        tried = dataclasses.replace(api, params=tuple((k, value if k == param else v) for k, v in api.params))
        if not pages(spark, tried, [(key, since, until)]).filter(F.col("record").isNotNull() & wanted).isEmpty():
            return value
    return choices[-1]
