"""The composed study on a small invented company, and forecasts from moments against least squares."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark import pipeline
from tidemark.functions import entity, scoring
from tidemark.functions import numeric as nm
from tidemark.operators import walk

DAY = dt.date(2022, 1, 3)


def prices(spark, n=260):
    rng, rows, c = random.Random(4), [], 100.0
    days = [d for k in range(n * 2) if (d := DAY + dt.timedelta(k)).weekday() < 5][:n]
    for d in days:
        o = c * (1 + rng.gauss(0, 0.004))
        c = o * (1 + rng.gauss(0, 0.01))
        rows.append(("TCS", d, o, max(o, c) * 1.004, min(o, c) * 0.996, c, 10.0))
    return spark.createDataFrame(rows, "symbol string, d date, o double, h double, l double, c double, v double"), days


def test_study(spark):
    bars, days = prices(spark)
    rng, rows = random.Random(5), []
    for i in range(300):
        d = days[rng.randrange(len(days))]
        rows.append((i, rng.choice(["a", "b"]), d, rng.choice(["TCS wins deal", "TCS shares fall", "Stocks to watch: TCS, Infosys, Wipro", "Sensex ends flat"]) + f" {i % 90}", "Market. TCS : the company said that its profits rise in all of its markets this year. Infosys : no news at all was heard today."))
    rows += [(900, "a", None, "TCS up", ""), (901, "a", days[3], None, "TCS")]
    corpus = spark.createDataFrame(rows, "doc_id long, src string, d date, title string, news string")
    filings = spark.createDataFrame([("TCS", days[200], 1, "Earnings Call Transcript", "", "p1"), ("TCS", days[100], 2, "Earnings Call Transcript", "", None), ("INFY", days[9], 3, "Earnings Call Transcript", "", "p2")], "symbol string, d date, id long, sub string, headline string, path string")
    p = pipeline.Pipeline(bars, corpus, "TCS", lambda: scoring.LexiconScorer(["wins", "rise"], ["fall"]), filings)
    got = pipeline.articles(corpus, "TCS").collect()
    assert {r["role"] for r in got} <= {"primary", "co_mention", "list_member", "peripheral"} and all(r["relevance"] > 0 for r in got)
    focus = [r for r in got if r["is_focus"]]
    assert focus and all(r["focus_text"].startswith("the company said") and r["focus_how"] == "item" for r in focus) and all(r["focus_text"] == "" for r in got if not r["is_focus"])
    table = p.features().cache()
    assert table.count() == len(days) - 1 and table.filter("n_focus > 0 and focus_para_sent > 0").count() > 0 and table.filter("call_live = 1").count() == 10
    assert list(p.rungs(table)) == ["har", "attention", "sentiment", "call"]
    f = p.forecasts(table, first=150, size=60)
    scores = {r["model"]: r for r in p.evaluate(table, f).collect()}
    assert set(scores) == set(p.rungs(table)) and all(r["n"] > 50 and r["qlike"] > 0 for r in scores.values())
    last = p.predict_latest(table).collect()
    assert {str(r["d"]) for r in last} == {str(days[-1])} and all(r["forecast"] > 0 for r in last)


def test_moments_give_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 3)) * [1, 5, 0.1]
    y = x @ [0.3, -0.2, 2.0] + rng.standard_normal(80) * 0.1
    rows = [("k", DAY + dt.timedelta(i), *map(float, x[i]), float(y[i]) if i < 78 else None, 2.0) for i in range(80)]
    frame = spark.createDataFrame([*rows, ("k", DAY + dt.timedelta(99), None, 1.0, 1.0, 1.0, 1.0)], "symbol string, d date, a double, b double, c double, u double, base double")
    got = walk.latest(frame, "symbol", "u", ["a", "b", "c"], "base").first()
    past, mean, sd = x[:78], x[:78].mean(0), x[:78].std(0)
    w = nm.ols(y[:78], (past - mean) / sd)
    u = float(np.append(1.0, (x[79] - mean) / sd) @ w)
    e = y[:78] - np.column_stack([np.ones(78), (past - mean) / sd]) @ w
    assert str(got["d"]) == str(DAY + dt.timedelta(79)) and got["u_hat"] == pytest.approx(u) and got["forecast"] == pytest.approx(2 * np.exp(u + e @ e / 74 / 2))
    effects = {r["feature"]: r["coefficient"] for r in walk.unit_effects(frame.limit(78), "symbol", "u", ["a", "b", "c"]).collect()}
    assert [effects[c] for c in "abc"] == pytest.approx(w[1:].tolist())
    # The walk-forward form keeps the last row, whose target is not known yet.
    walked = {str(r["d"]) for r in walk.ols(frame, "symbol", "u", ["a", "b", "c"], "base", first=60, size=21).collect()}
    assert str(DAY + dt.timedelta(79)) in walked


def test_variance_recursion():
    r = np.random.default_rng(1).standard_normal(700)
    for beta, gamma in ((0.85, 0.0), (0.999, 0.05), (0.0, 0.1)):
        h, e = [0.7], r - 0.01
        for t in range(len(r)):
            h.append(0.05 + (0.1 + gamma * (e[t] < 0)) * e[t] ** 2 + beta * h[t])
        assert nm.garch_filter(r, 0.01, 0.05, 0.1, beta, gamma, 0.7) == pytest.approx(np.array(h), rel=1e-12)


def test_paragraph_without_items():
    text = "TCS said that margins will rise in the next year. Others did not speak. Markets closed."
    assert entity.focus_paragraph(text, "TCS") == ("TCS said that margins will rise in the next year.", "sentences")
    assert entity.focus_paragraph("nothing here", "TCS") == ("", "") and entity.focus_paragraph(None, "TCS") == ("", "") and entity.focus_paragraph(text, "none") == ("", "")
