"""Placebos in cells and rounds: the same results whatever their sizes, and shuffles that do not grow with the replicates."""

from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import placebo

SCHEMES = {"year": ["g", "year"], "company": ["g", "s"]}


def frame(spark, n):
    rng = np.random.default_rng(3)
    rows = [(i, date(2018, 1, 1) + timedelta(days=i % 1500), None if i % 3 == 0 else "g", "AB"[i % 7 == 0], float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, d date, g string, s string, u double, size double, tone double").repartition(3)


def largest(spark, since):
    """Most bytes that a stage shuffled, of the stages from the number `since` on; the next number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    found = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]
    return max((b for s, b in found if s >= since), default=0), max(s for s, _ in found) + 1


@pytest.mark.parametrize("kept", [["size"], []])
def test_shuffles_do_not_grow_with_replicates(spark, monkeypatch, kept):
    monkeypatch.setattr(placebo, "ROUND", 3000, raising=False)
    rows = frame(spark, 3000).cache()
    rows.count()
    since, most = largest(spark, 0)[1], []
    for replicates in (2, 12):
        placebo.shares(placebo.refitted(rows, "u", kept, ["tone"], SCHEMES, replicates=replicates)).collect()
        bytes_, since = largest(spark, since)
        most.append(bytes_)
    assert most[1] < 1.5 * most[0]


@pytest.mark.parametrize("kept", [["size"], []])
def test_cells_and_rounds_change_nothing(spark, monkeypatch, kept):
    rows = frame(spark, 2000)
    of = lambda: {(r["scheme"], r["rep"]): (r["n"], r["mse"]) for r in placebo.refitted(rows, "u", kept, ["tone"], SCHEMES, replicates=5).collect()}
    whole = of()
    monkeypatch.setattr(placebo, "CELL", 150)  # most groups are larger, some share a cell
    monkeypatch.setattr(placebo, "ROUND", 5000)
    monkeypatch.setattr(placebo, "COUNTED", 3)
    parts = of()
    assert set(whole) == set(parts) and all(parts[k][0] == whole[k][0] and parts[k][1] == pytest.approx(whole[k][1], rel=1e-10) for k in whole)
