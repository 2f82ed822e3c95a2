"""The paged source against a local server that throttles, fails, has nothing, or sends short pages."""

import io
import json
import threading
import zipfile
from collections import Counter
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.sources import paged

FIRST, LAST = date(2024, 1, 1), date(2024, 3, 20)


class Service:
    """Records of three keys, 0 to 45 a window day; every fifth request is refused once."""

    def __init__(self):
        self.asked, self.refused, self.down, self.cookies = Counter(), set(), False, 0
        self.lock = threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                u = urlparse(self.path)
                outer.answer(self, u.path, {k: v[0] for k, v in parse_qs(u.query).items()})

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def rows(self, key, a, b):
        n = (b - a).days + 1
        days = [a + timedelta(days=i) for i in range(n)]
        return [{"id": f"{key}-{d}-{j}", "day": str(d), "name": f"{key} Limited", "value": j} for d in days for j in range((d.toordinal() * 7 + len(key)) % 5)]

    def send(self, handler, code, body=b"", headers=()):
        handler.send_response(code)
        for k, v in headers:
            handler.send_header(k, v)
        handler.send_header("Content-Length", str(len(body)))
        handler.end_headers()
        handler.wfile.write(body)

    def answer(self, handler, path, q):
        with self.lock:
            self.asked[handler.path] += 1
            once = handler.path not in self.refused and hash(handler.path) % 3 == 0
            self.refused.add(handler.path)
        if path == "/seed":
            return self.send(handler, 200, b"hello", [("Set-Cookie", "k=v")])
        if self.down:
            return self.send(handler, 503)
        if once:
            return self.send(handler, (429, 500, 403)[len(handler.path) % 3], headers=[("Retry-After", "0")])
        if path.startswith("/zip/"):
            d = date.fromisoformat(path.removeprefix("/zip/"))
            if d.day % 9 == 0:
                return self.send(handler, 404)
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("x.csv", f"day, strike \n{d},100\n{d},\n")
            return self.send(handler, 200, out.getvalue())
        if q.get("key") == "NONE":
            return self.send(handler, 404)
        rows = self.rows(q["key"], date.fromisoformat(q["a"]), date.fromisoformat(q["b"]))
        if path == "/number":
            at = (int(q["page"]) - 1) * 20
            return self.send(handler, 200, json.dumps({"Table": rows[at : at + 20]}).encode())
        if path == "/token":
            at = int(q.get("page", 0))
            more = {"nextPage": str(at + 7)} if at + 7 < len(rows) else {"nextPage": None}
            return self.send(handler, 200, json.dumps({"data": {"results": rows[at : at + 7]}, **more}).encode())
        if path == "/split":
            return self.send(handler, 200, json.dumps(rows[:20]).encode())
        return self.send(handler, 400)


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def api(service, path, **more):
    return paged.Api(urls=(("", f"{service.url}/{path}"),), params=(("key", "{key}"), ("a", "{a:%Y-%m-%d}"), ("b", "{b:%Y-%m-%d}")), wait=0.01, seed=f"{service.url}/seed", **more)


SCHEMA = "id string, day date, name string, value int"


def expected(service, keys):
    return {r["id"] for k in keys for r in service.rows(k, FIRST, LAST)}


@pytest.mark.parametrize(("path", "more"), [("number", {"records": "Table"}), ("token", {"records": "data.results", "paging": "token"}), ("split", {"paging": "split"})])
def test_every_record_once(spark, service, tmp_path, path, more):
    h = paged.Harvest(spark, str(tmp_path), api(service, path, **more), tasks=3)
    n = h.run(["AB", "ABC", "NONE"], FIRST, LAST, days=31, group=4)
    assert n == 9
    got = [r["id"] for r in h.records(SCHEMA).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(service, ["AB", "ABC"])
    assert h.records(SCHEMA).filter("day < a or day > b or value is null").isEmpty()


def test_killed_run_goes_on(spark, service, tmp_path):
    h = paged.Harvest(spark, str(tmp_path), api(service, "number", records="Table", attempts=3), tasks=2)
    part = h.run(["AB"], FIRST, date(2024, 2, 10), days=10, group=2)
    service.down = True
    with pytest.raises(Exception, match="503"):
        h.run(["AB", "ABC"], FIRST, LAST, days=10, group=2)
    assert h.manifest().count() == part
    (tmp_path / "records" / "stray").mkdir(parents=True)
    paged.pages(spark, api(service, "number"), []).write.mode("overwrite").parquet(f"{tmp_path}/records/{'0' * 32}")  # what a killed job leaves does not count
    service.down = False
    before = {p for p in service.asked if "a=2024-01-11" in p and "key=AB&" in p}
    count = sum(service.asked[p] for p in before)
    h.run(["AB", "ABC"], FIRST, LAST, days=10, group=2)
    assert sum(service.asked[p] for p in before) == count  # a complete window is not asked again
    got = [r["id"] for r in h.records(SCHEMA, ["id"]).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(service, ["AB", "ABC"])
    asked = service.asked.total()
    h.run(["AB", "ABC"], FIRST, LAST, days=10, group=50)
    again = service.asked.total() - asked
    assert 0 < again < 15  # only windows that end today are open
    assert h.records(SCHEMA, ["id"]).count() == len(got)


def test_budget_leaves_windows_open(spark, service, tmp_path):
    h = paged.Harvest(spark, str(tmp_path), api(service, "number", records="Table"), tasks=2)
    done, rounds = 0, 0
    while h.open_windows(paged.windows(["AB"], FIRST, date(2024, 3, 1), 10), date(2024, 3, 2)):
        asked = service.asked.total()
        done += h.run(["AB"], FIRST, date(2024, 3, 1), days=10, budget=6)
        assert service.asked.total() - asked <= 6 * 2 + 2  # each attempt may visit the seed page too
        rounds += 1
        assert rounds < 30
    assert rounds > 1
    got = {r["id"] for r in h.records(SCHEMA).collect()}
    assert got == {i for i in expected(service, ["AB"]) if i[3:13] <= "2024-03-01"}


def test_daily_archives(spark, service, tmp_path):
    a = paged.Api(urls=(("", "http://127.0.0.1:1/never"), ("2024-01-01", service.url + "/zip/{a:%Y-%m-%d}")), paging="one", form="zip", wait=0.01, weekdays=True)
    h = paged.Harvest(spark, str(tmp_path), a, tasks=4)
    h.run(["all"], FIRST, date(2024, 1, 31))
    days = [FIRST + timedelta(days=i) for i in range(31)]
    want = Counter({str(d): 2 for d in days if d.weekday() < 5 and d.day % 9})
    rows = h.records("day string, strike string").collect()
    assert Counter(r["day"] for r in rows) == want and {r["strike"] for r in rows} == {"100", None}
    assert not any("2024-01-06" in p for p in service.asked)
    assert h.manifest().count() == sum(d.weekday() < 5 for d in days)  # a 404 is a complete day


def test_names_and_categories(spark, service):
    a = api(service, "number", records="Table")
    got = {r["key"]: (r["name"], r["ok"]) for r in paged.verified(spark, a, {"AB": "ab lim", "ABC": "other", "NONE": "x"}, "name", FIRST, LAST).collect()}
    assert got == {"AB": ("AB Limited", True), "ABC": ("ABC Limited", False), "NONE": (None, False)}
    assert paged.probed(spark, a, "key", ["NONE", "AB", "-1"], "x", FIRST, LAST, F.contains("record", F.lit("AB"))) == "AB"
    assert paged.probed(spark, a, "key", ["NONE", "AB"], "x", FIRST, LAST, F.contains("record", F.lit("zz"))) == "AB"


def test_what_cannot_be_mended_is_raised(spark, service):
    with pytest.raises(Exception, match="HTTP 400"):
        paged.pages(spark, api(service, "nowhere"), [("AB", FIRST, LAST)]).collect()
    with pytest.raises(Exception, match="shorter windows"):
        paged.pages(spark, api(service, "number", records="Table", most_pages=2), [("AB", FIRST, LAST)]).collect()
    assert paged.pages(spark, api(service, "number"), []).count() == 0
