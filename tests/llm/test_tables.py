"""Operations on pages and embeddings against brute force."""

import math
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import topk, url_filter
from tidemark.llm.queries import RULES


def test_urls(spark):
    rng, urls = random.Random(1), [None, "", "nothing", "http://", "HTTP://A.Example.NET", "x://b.org?q=/fr/", "://c/d://e", "http://spam.example/é?x#y", "http://sub.spam.example:80/", "http://É.SPAM.example/a\nb"]
    names = [f"h{i}.example.{t}" for i in range(30) for t in ("com", "net", "org")] + ["spam.example", "net", "org", "xnet"]
    urls += [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'A.'])}{rng.choice(names)}{rng.choice(['', '/', '/en/1', '/de/2?x', '/fr/3#y', '?q', '#f'])}" for _ in range(300)]
    listed = ["spam.example", *[f"h{i}.example.com" for i in range(0, 30, 2)], "absent.example", "com.other"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    keys = spark.createDataFrame([(k,) for k in [*listed, listed[0], None]], "key string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, RULES, keys).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0]) + len(r[1]), default=None)
        verdict = best[2] if best else "block" if any(host == k or host.endswith("." + k) for k in listed) else "allow"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[0] + best[1], verdict), u
    assert url_filter.judge(pages.limit(0), RULES, keys).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], keys.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("pmod(xxhash64(key), 5) = 0")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.filter(cascade.holds(F.col("key")) != (F.expr("pmod(xxhash64(key), 5) = 0")))
    assert wrong.count() == 0


def test_top_k(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() ** 3 for _ in range(19)], 1) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1], 2) for i in range(20)]  # ties
    rows += [(500, None, 0), (600, [], 0), (700, [float("nan")] * 19, 0), (800, [1.0, None] + [0.5] * 17, 0), (900, [math.inf] * 19, 0), (None, rows[0][1], 0), (1000, [0.5] * 7, 0), (1001, [0.25] * 7, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    single = {r["vec_id"]: r["embedding"] for r in frame.collect() if r["vec_id"] is not None}
    want = set()
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in single.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in ok if i % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for block in (2, 4096):
        got = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, block=block).collect()}
        assert got == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
