"""Registered queries against brute force over whole tables: no item, filing, window or text is left out."""

from bisect import bisect_right
from collections import Counter, defaultdict
from datetime import timedelta
from inspect import signature
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import entity
from tidemark.functions.scoring import LexiconScorer
from tidemark.operators import bars, graph, inference, walk
from tidemark.plans import catalogue, inferences
from tidemark.plans.scores import _forecasts
from tidemark.plans.tidy import tidy
from tidemark.sources import views as v

SF = "/root/testdata/sf0.001"
#: Series of over 500 days, for the walks.
LONG = "/root/testdata/sf0.01"


def run(spark, name, sf=SF):
    return catalogue.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def network(spark):
    """Names of every item, and the weights of all pairs in both directions."""
    items = defaultdict(set)
    for r in v.mentions(spark, SF).collect():
        items[r["item"]].add(r["name"])
    pairs = Counter(p for names in items.values() for a, b in combinations(sorted(names), 2) for p in ((a, b), (b, a)))
    assert any(len(names) > 2 for names in items.values())
    return items, pairs


def test_graph_queries_take_all_mentions(spark, network):
    _, pairs = network
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    got = {r["name"]: (r["degree"], r["strength"]) for r in run(spark, "degree_strength")}
    assert got == {a: (len(near[a]), sum(w for (x, _), w in pairs.items() if x == a)) for a in near}
    closed = {a: sum(c in near[b] for b, c in combinations(sorted(near[a]), 2)) for a in near}
    assert {r["name"]: r["triangles"] for r in run(spark, "triangles")} == closed
    (t,) = run(spark, "transitivity")
    assert (t["nodes"], t["edges"]) == (len(near), len(pairs) // 2)
    assert t["transitivity"] == pytest.approx(2 * sum(closed.values()) / sum(len(n) * (len(n) - 1) for n in near.values()), abs=1e-6)
    for name in ("components", "betweenness", "modularity", "eigenvector", "weighted_clustering"):
        assert {r["name"] for r in run(spark, name)} == set(near)
    top = max(pairs.values())
    a = min(near)
    v3 = sum((pairs[a, b] / top * pairs[a, c] / top * pairs[b, c] / top) ** (1 / 3) for b, c in combinations(sorted(near[a]), 2) if (b, c) in pairs)
    got = {r["name"]: r["clustering"] for r in run(spark, "weighted_clustering")}
    assert got[a] == pytest.approx(2 * v3 / (len(near[a]) * (len(near[a]) - 1)), abs=1e-6)


def test_assortativity_of_equal_degrees_is_null(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 1)], "source string, target string, weight long")
    assert graph.assortativity(edges).first()[0] is None
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "source string, target string, weight long")
    assert graph.assortativity(path).first()[0] == pytest.approx(-0.5)
    assert len(run(spark, "assortativity")) == 1


def test_shares_take_all_names(spark, network):
    items, pairs = network
    own = Counter(n for names in items.values() for n in names)
    total = {n: own[n] + sum(w for (a, _), w in pairs.items() if a == n) for n in own}
    got = {r["node"]: r for r in run(spark, "connectedness_table")}
    assert set(got) == set(own)
    for n, r in got.items():
        assert r["own"] == pytest.approx(own[n] / total[n], abs=1e-6)
        assert r["to_others"] == pytest.approx(sum(w / total[b] for (a, b), w in pairs.items() if a == n), abs=1e-5)
    assert len(run(spark, "pairwise_net")) == len(pairs) // 2


@pytest.fixture(scope="module")
def dated(spark):
    """Filings as (symbol, day, sub, id), and trading days as {day: seq} with their list."""
    filings = [(r["symbol"], r["d"], r["sub"], r["id"]) for r in v.filings(spark, SF).collect()]
    seq = {r["d"]: r["seq"] for r in v.calendar(v.bars(spark, SF)).collect()}
    return filings, seq, sorted(seq)


def test_meetings_take_all_filings(spark, dated):
    filings, seq, _ = dated
    results = defaultdict(set)
    for symbol, d, sub, _ in filings:
        if sub == "P":
            results[symbol].add(d)
    meet = [(s, d, i) for s, d, sub, i in filings if sub == "O"]
    near = {(s, d): [d + timedelta(k) for k in range(16) if d + timedelta(k) in results[s]] for s, d, _ in meet}
    assert {(r["symbol"], r["d"], r["id"]) for r in run(spark, "meet_before_results")} == {(s, str(d), i) for s, d, i in meet if near[s, d]}
    active = {(s, d + timedelta(k)) for (s, d), found in near.items() for k in range(((found or [d + timedelta(15)])[0] - d).days + 1)}
    assert {(r["symbol"], r["d"]) for r in run(spark, "announcement_flags")} == {(s, str(d)) for s, d in active if d in seq}


def test_every_filing_fans_out(spark, dated):
    filings, _, days = dated
    live = {}
    for symbol, d, _, i in filings:
        at = bisect_right(days, d)  # the number of the last trading day up to d
        for k in range(10 if at else 0):
            if at + k <= len(days):
                live[symbol, at + k] = max(live.get((symbol, at + k), (d, i, k)), (d, i, k))
    got = {(r["symbol"], r["d"], r["id"], r["days_since"]) for r in run(spark, "call_live_fanout")}
    assert got == {(s, str(days[at - 1]), i, k) for (s, at), (_, i, k) in live.items()}


def test_same_event_filter_takes_all_filings(spark, dated):
    first = {}
    for symbol, d, _, i in dated[0]:
        first[symbol, d] = min(i, first.get((symbol, d), i))
    want, last = set(), {}
    for symbol, d in sorted(first):
        if symbol not in last or (d - last[symbol]).days > 20:
            last[symbol] = d
            want.add((symbol, str(d), str(first[symbol, d])))
    assert {(r["symbol"], r["d"], r["path"]) for r in run(spark, "same_event_filter")} == want


def test_event_path_and_focus_take_all_articles(spark, dated):
    _, seq, _ = dated
    rows = v.articles(spark, SF).select("doc_id", "d", "src").collect()
    priced = Counter(seq[r["d"]] for r in bars.realised(v.bars(spark, SF)).collect() if r["d"] in seq)
    events = {seq[r["d"]] for r in rows if r["d"] in seq}
    want = Counter()
    for e in events:
        want.update({o: priced[e + o] for o in range(-5, 21) if e + o in priced})
    assert {r["offset"]: r["n"] for r in run(spark, "event_path")} == dict(want)
    focus = Counter((r["src"][3:4], str(r["d"])) for r in rows)
    carry = {(r["lang"], r["d"]): r["carry"] or 0.0 for r in run(spark, "carry_decay")}
    got = {(r["lang"], r["d"]): r["focus_x_carry"] for r in run(spark, "focus_x_carry")}
    assert got == pytest.approx({k: n * carry.get(k, 0.0) for k, n in focus.items()}, abs=1e-5)


def test_implied_volatility_takes_all_orders(spark):
    atm = defaultdict(dict)
    for r in v.read(spark, SF, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("d")).collect():
        k, days = r["o_orderkey"], r["o_orderkey"] % 90 + 3
        own = atm[{"O": "A", "F": "N", "P": "R"}[r["o_orderstatus"]], str(r["d"])]
        own[days] = max(0.1 + k % 37 / 100, own.get(days, 0.0))
    got = {(r["symbol"], r["date"]): (r["n_expiries"], r["near_days"], r["atm_near"]) for r in run(spark, "iv30_interp")}
    assert got == {d: (len(s), min(s), pytest.approx(s[min(s)], abs=1e-6)) for d, s in atm.items()}
    priced = Counter(r["symbol"] for r in bars.realised(v.bars(spark, SF)).select("symbol", F.col("d").cast("string").alias("d")).collect() if (r["symbol"], r["d"]) in atm)
    assert {r["symbol"]: r["n"] for r in run(spark, "vrp_summary")} == dict(priced)


def test_walks_take_every_day_from_the_first(spark):
    panel = bars.panel(bars.realised(v.bars(spark, LONG)), ["A", "N", "R"]).count()
    spill = run(spark, "rolling_spillover", LONG)
    assert len(spill) == 3 * len(range(249, panel, 5)) and len({r["d"] for r in spill}) == len(spill) // 3
    assert all(abs(sum(r["net"] for r in spill if r["d"] == d)) < 1e-4 for d in list({r["d"] for r in spill})[:5])
    usable = Counter(r["symbol"] for r in bars.har(_forecasts(spark, LONG)).select("symbol", "f2", "lrv_d", "lrv_w", "lrv_m").dropna().collect())
    assert Counter(r["symbol"] for r in run(spark, "ols_multi_walk", LONG)) == {s: n - 120 for s, n in usable.items() if n > 120}


def test_garch_walk_fits_as_the_operator_does(spark, monkeypatch):
    real, asked = walk.garch, []
    monkeypatch.setattr(walk, "garch", lambda *a, **k: asked.append(signature(real).bind(*a, **k)) or real(*a, **k))
    run(spark, "garch_walk")
    (call,) = asked
    call.apply_defaults()
    assert (call.arguments["first"], call.arguments["size"], call.arguments["steps"]) == (500, 21, 200)


def test_bootstraps_take_full_draws(spark):
    losses = inferences._losses(spark, SF)
    for name, want in (("contrast_table", inference.contrasts(losses, "symbol", [("f2", "f1")], 2000)), ("cluster_interval", inference.cluster_bootstrap(losses, "symbol", "f2", "f1", 2000))):
        assert sorted((r["symbol"], r["lo"], r["hi"]) for r in run(spark, name)) == sorted((r["symbol"], r["lo"], r["hi"]) for r in tidy(want).collect())


def test_texts_are_read_to_their_end(spark):
    text = {r["doc_id"]: r["text"] for r in v.read(spark, SF, "documents").select("doc_id", "text").collect()}
    split = {i: t.lower().split(" ") for i, t in text.items()}
    p, n = ({i: sum(x in words for x in w) for i, w in split.items()} for words in (v.POSITIVE, v.NEGATIVE))
    scores = {r["doc_id"]: r["s"] for r in v.articles(spark, SF).select("doc_id", "s").collect()}
    assert scores == {i: pytest.approx((p[i] - n[i]) / (p[i] + n[i])) if p[i] + n[i] else None for i in text}
    model = LexiconScorer(v.POSITIVE, v.NEGATIVE)
    got = {r["doc_id"]: (r["z_lex_positive"], r["z_lex_negative"]) for r in run(spark, "lexicon_scores")}
    assert got == {i: tuple(model.logits([t], [""])[0][:2]) for i, t in text.items()}
    assert sum(r["tokens"] for r in run(spark, "mlm_split")) == pytest.approx(1.3 * sum(len(split[i]) for i in text if len(text[i]) > 40))
    news = "Stocks in focus. Infosys : {}. Wipro : other words here."
    got = {r["doc_id"]: (r["focus_text"], r["focus_how"]) for r in run(spark, "focus_paragraphs")}
    assert got == {i: entity.focus_paragraph(news.format(t), "INFY") for i, t in text.items()}
    assert max(len(x) for x, _ in got.values()) == 600
    said = {(r["conv_id"], r["turn"]): r["text"] for r in v.read(spark, SF, "conversations").collect()}
    for r in run(spark, "call_inputs"):
        assert len(r["text_b"].split()) >= len(f"{said[r['conv_id'], r['turn']]} TCS may face risks but Infosys gains".split())
    assert all(len(r["title"]) > 40 for r in run(spark, "normalise_titles") if len(text[r["doc_id"]].strip()) > 80)
