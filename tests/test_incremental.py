"""Tables of base and deltas, reports out of streams, texts scored once, character references, label files and transcript details."""

import html
import io
import json
import os
import zipfile
from datetime import date, datetime, timedelta
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tidemark import pipeline
from tidemark.functions import entity, references
from tidemark.functions import signals as g
from tidemark.functions.scoring import LexiconScorer
from tidemark.operators import align, calls, daily
from tidemark.sources import readers
from tidemark.streaming import live


def rows_of(table, before=None):
    got = table.read(before)
    return None if got is None else sorted(tuple(r) for r in got.collect())


def test_base_and_deltas(spark, tmp_path):
    t = live.Merged(spark, f"{tmp_path}/t", ["k"], ["v"], fold=3)
    assert rows_of(t) is None
    want, history = {}, {}
    for version in range(10):
        batch = [(k, version * 10 + k) for k in range(version, version + 3)] + [(0, version)]
        history[version] = dict(want)
        for k, v in batch:
            want[k] = max(want.get(k, -1), v)
        t.add(spark.createDataFrame(batch, "k long, v long").coalesce(1), version)
        assert dict(rows_of(t)) == want
        before = rows_of(t, version)
        assert (dict(before) if before else {}) == history[version]  # what a batch that runs again starts from
        t.add(spark.createDataFrame(batch, "k long, v long").coalesce(1), version)
        assert dict(rows_of(t)) == want
    kept = [n for n in os.listdir(f"{tmp_path}/t")]
    assert len([n for n in kept if n.startswith("base")]) <= 2 and len(kept) <= 9  # old ones are gone
    os.makedirs(f"{tmp_path}/t/delta-99")  # a write that failed
    assert dict(rows_of(t)) == want


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    big = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"))
    for part in (big, big.limit(3).withColumn("v", F.lit(5).cast("long")), big.limit(1).withColumn("k", F.lit(None).cast("long"))):
        part.coalesce(1).write.mode("append").parquet(source)
        live.upsert(live.file_stream(spark, source, big.schema), out, check, ["k"], ["v"]).awaitTermination()
    sizes = {v: spark.read.parquet(f"{out}/delta-{v}").count() for v in range(3)}
    assert sizes == {0: 20_000, 1: 3, 2: 1}
    assert live.Merged(spark, out, ["k"], ["v"]).read().agg(F.sum("v"), F.count(F.lit(1))).first()[:] == (20_000 + 12 + 1, 20_001)
    added = f"{tmp_path}/added"
    live.append_new(live.file_stream(spark, source, big.schema), added, f"{tmp_path}/check2", ["k"], ["v"]).awaitTermination()
    t = live.Merged(spark, added).read()
    assert t.count() == 20_001 and t.filter("k is null").count() == 1 and t.filter("v = 5").count() == 0


def test_reports_come_out_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    rows.write.parquet(f"{tmp_path}/in")
    build = lambda df: {"means": df.groupBy("k").agg(F.avg("v").alias("m")), "size": df.agg(F.count(F.lit(1)).alias("n"))}
    live.publish(live.file_stream(spark, f"{tmp_path}/in", rows.schema, files=100), f"{tmp_path}/public", f"{tmp_path}/check", build).awaitTermination()
    assert {r["k"]: r["m"] for r in spark.read.json(f"{tmp_path}/public/means").collect()} == {"a": 2.0, "b": 5.0}
    assert spark.read.json(f"{tmp_path}/public/size").first()["n"] == 3


class Counting(LexiconScorer):
    """Notes every text that it is asked for."""

    def __init__(self, folder):
        super().__init__(["wins"], ["falls"])
        self.folder = folder

    def logits(self, texts, targets):
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return super().logits(texts, targets)


def test_the_study_scores_each_text_once(spark, tmp_path):
    days = [d for k in range(300) if (d := date(2022, 1, 3) + timedelta(k)).weekday() < 5]
    bars = spark.createDataFrame([("TCS", d, 100.0 + i % 7, 103.0 + i % 5 + i % 7, 97.0 + i % 7 - i % 3, 100.0 + (i + 1) % 7, 1.0) for i, d in enumerate(days)], "symbol string, d date, o double, h double, l double, c double, v double")
    corpus = spark.createDataFrame([(i, "s", days[i * 3], f"TCS {'wins' if i % 2 else 'falls'} {i}", "body") for i in range(60)], "doc_id long, src string, d date, title string, news string")
    folder = str(tmp_path)
    p = pipeline.Pipeline(bars, corpus, "TCS", lambda: Counting(folder))
    table = p.features()
    forecasts = p.forecasts(table, first=60, size=40)
    p.evaluate(table, forecasts).collect()
    p.predict_latest(p.features()).collect()
    assert p.daily().count() > 0
    asked = [json.loads(x) for n in os.listdir(folder) for x in open(f"{folder}/{n}")]
    assert len(asked) == len(set(asked)) == 60
    paths = [t.written_to for t in p._tables.values()]
    p.close()
    assert paths and not any(os.path.exists(x.removeprefix("file:")) for x in paths)


def test_character_references(spark):
    texts = [f"a &{n} b" for n in html5] + [f"&{n}x" for n in html5 if not n.endswith(";")] + [f"&{n}" for n in html5]
    numbers = [0, 1, 8, 9, 10, 11, 13, 14, 31, 32, 65, 127, 128, 129, 133, 150, 159, 160, 8377, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x10FFFD, 0x110000, 10**12, 10**30]
    texts += [f"x&#{n}{e}y" for n in numbers for e in (";", "", " ")] + [f"&#{x}{n:x}{e}z" for n in numbers for x in "xX" for e in (";", "")] + ["&#0065;", "&#x;", "&#;", "&;", "&", "&&amp;&", "a & b", "&amp;amp;", "&notit; &notanentity; &noSuchThing", "", "no reference", "&amp", "&é;", "é&eacute;é", "&#65&#66;", "&lt;b&gt;&nbsp;&copy2020"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r["t"]: r["u"] for r in frame.select("t", references.unescape(F.col("t")).alias("u")).collect()}
    assert got.pop(None) is None
    wrong = {t: (u, html.unescape(t)) for t, u in got.items() if u != html.unescape(t)}
    assert not wrong, list(wrong.items())[:5]
    page = "<script>x</script><p>&#8377; 5&nbsp;&mdash; it&rsquo;s  up &lt;b&gt;</p>\x0b end"
    assert spark.createDataFrame([(page,)], "t string").select(g.plain_html(F.col("t"))).first()[0] == "₹ 5 — it’s up <b> end"


def workbook(rows, sheet="labels"):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    words = sorted({c for r in rows for c in r if c})
    cell = lambda i, j, c: f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{words.index(c)}</v></c>' if j != 1 else f'<c r="B{i + 1}" t="inlineStr"><is><t>{c}</t></is></c>'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, c) for j, c in enumerate(r) if c) + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="other" r:id="r1"/><sheet name="{sheet}" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{w[:1]}</t></r><r><t>{w[1:]}</t></r></si>" for w in words) + "</sst>")
    return out.getvalue()


def test_label_files_in_any_form(spark, tmp_path):
    rows = [["id", "your_label", "draft_label"], ["a1", "Positive ", "negative"], ["a2", "", "neutral"], ["a3", "rubbish", "negative"], ["a4", "naïve", ""]]
    text = "\r\n".join(",".join(r) for r in rows)
    (tmp_path / "sheet.xlsx").write_bytes(workbook(rows))
    (tmp_path / "marked.csv").write_bytes(("﻿" + text).encode("utf-8"))
    (tmp_path / "plain.csv").write_bytes(text.encode("utf-8"))
    (tmp_path / "old.csv").write_bytes(text.encode("latin-1"))
    got = [sorted(tuple(r) for r in readers.label_files(spark, str(tmp_path / n), ["id", "your_label", "draft_label", "absent"], sheet="labels").collect()) for n in ("sheet.xlsx", "marked.csv", "plain.csv", "old.csv")]
    assert got[0] == got[1] == got[2] == got[3] == [("a1", "Positive", "negative", None), ("a2", None, "neutral", None), ("a3", "rubbish", "negative", None), ("a4", "naïve", None, None)]
    told = readers.own_or_draft(readers.label_files(spark, str(tmp_path / "plain.csv"), rows[0]), "your_label", "draft_label").collect()
    assert {r["id"]: (r["label"], r["provisional"]) for r in told} == {"a1": ("positive", False), "a2": ("neutral", True), "a3": ("negative", True), "a4": (None, True)}
    with pytest.raises(Exception, match="no sheet"):
        readers.label_files(spark, str(tmp_path / "sheet.xlsx"), ["id"], sheet="none").collect()


def test_label_lines_with_a_second_source(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("d/Sentences_AllAgree.txt", "Caf\xe9 profits rose @positive\nmail@home fell @ negative \nno label\nodd@strange".encode("latin-1"))
    (tmp_path / "bank.zip").write_bytes(out.getvalue())
    spark.createDataFrame([("x", 2), ("y", 9)], "sentence string, label int").write.parquet(f"{tmp_path}/other")
    names = {n: n for n in readers.LABELS}
    first = lambda path: lambda: readers.labelled_lines(readers.text_lines(spark, path, "Sentences_AllAgree.txt"), names)
    second = lambda: spark.read.parquet(f"{tmp_path}/other").select(F.col("sentence").alias("text"), readers.mapped(F.col("label").cast("string"), {"0": "negative", "1": "neutral", "2": "positive"}).alias("label")).filter("label is not null")
    assert sorted(map(tuple, readers.first_of_sources(first(f"{tmp_path}/bank.zip"), second).collect())) == [("Café profits rose", "positive"), ("mail@home fell", "negative")]
    assert [tuple(r) for r in readers.first_of_sources(first(f"{tmp_path}/absent.zip"), second).collect()] == [("x", "positive")]
    with pytest.raises(Exception, match="absent"):
        readers.first_of_sources(first(f"{tmp_path}/absent.zip"), first(f"{tmp_path}/absent2.zip")).collect()


def test_missing_columns_have_their_type(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a long, b double").write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(3,)], "a long").write.parquet(f"{tmp_path}/two")
    t = readers.parquet_some(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], {"a": "long", "b": "double", "day": "date"})
    assert dict(t.dtypes) == {"a": "bigint", "b": "double", "day": "date"} and sorted(map(tuple, t.collect())) == [(1, 2.0, None), (3, None, None)]
    (tmp_path / "n.csv").write_text("date,title,news,url\n2024-01-05 x,T,N,U\n")
    assert [tuple(r) for r in readers.corpus(spark, {"s": f"{tmp_path}/n.csv"}, columns=["d", "title"]).collect()] == [(date(2024, 1, 5), "T")]
    frame = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "k string, n int, v double")
    assert sorted(map(tuple, readers.from_report(spark, readers.json_report(frame, ["k"]).first()[0], "k string, n int, v double").collect())) == sorted(map(tuple, frame.collect()))


ALTERNATING = """Some Company Limited
Q4 FY26 Earnings Conference Call
April 23, 2026
CORPORATE PARTICIPANTS:
Anna Berg
Chief Executive
ANALYSTS
Amit Shah
Goldman Sachs
Raj Rao
Kotak
1
Moderator
Ladies and gentlemen, greetings, and welcome to the call.
Anna Berg
We delivered a strong performance in the year with healthy wins across all segments.
Moderator
Thank you. The first question comes from the line of Amit Shah from Goldman. Please go ahead.
Amit Shah
Why has the growth guidance for next year   been set so cautiously given the wins?
Anna Berg
The environment remains uncertain and some clients may delay decisions in the near term.
Moderator
The next question comes from the line of Raj Rao.
Raj Rao
Could you talk about pricing pressure in the services vertical this quarter?
"""


def test_participants_take_turns_with_their_firms(spark):
    assert calls.listed(ALTERNATING, calls.ANALYST_LIST) == ["Amit Shah", "Raj Rao"]
    assert calls.listed(ALTERNATING, calls.MANAGEMENT_LIST) == ["Anna Berg"]
    assert {(who, role) for who, role, _, _ in calls.turns(ALTERNATING)} == {("Anna Berg", "management"), ("Amit Shah", "analyst"), ("Raj Rao", "analyst"), ("Moderator", "moderator")}
    frame = spark.createDataFrame([("p", ALTERNATING), ("q", None), ("r", "Call of January 5, 2024, 16:30 hrs IST today"), ("s", "nothing")], "path string, text string")
    assert {r["path"]: r["call_time"] for r in calls.times(frame).collect()} == {"p": datetime(2026, 4, 23), "q": None, "r": datetime(2024, 1, 5, 16, 30), "s": None}
    said = calls.sentences(calls.parsed(frame))
    assert any("next year been set" in r["sentence"] for r in said.collect())
    assert calls.real_calls(said, 4).count() == 1 and calls.real_calls(said).count() == 0


def test_three_kinds_of_filing_flags(spark):
    days = [date(2024, 1, 1) + timedelta(k) for k in range(40) if (date(2024, 1, 1) + timedelta(k)).weekday() < 5]
    cal = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "d date, seq long")
    one = lambda *ds: spark.createDataFrame([("S", d) for d in ds], "symbol string, d date")
    got = {r["d"]: (r["results_filing"], r["call_upcoming"], r["transcript_published"]) for r in align.filing_flags(one(date(2024, 1, 13)), one(date(2024, 1, 2), date(2024, 1, 20)), one(date(2024, 1, 15), date(2024, 1, 15)), cal, "symbol").collect()}
    up = {d for d in days if date(2024, 1, 2) <= d <= date(2024, 1, 12) or date(2024, 1, 19) <= d <= date(2024, 2, 3)}
    want = {d: (float(d == date(2024, 1, 12)), float(d in up), float(d == date(2024, 1, 15))) for d in days}
    assert got == {d: v for d, v in want.items() if any(v)}


def test_first_filing_of_a_day_by_time(spark):
    rows = [("S", date(2024, 1, 1), i, t, "results", float(i)) for i, t in ((1, 9), (2, 8), (3, None))]
    frame = spark.createDataFrame(rows, "symbol string, d date, id long, ts int, group string, value double")
    assert daily.top_of_day(frame, {"results": 0}, ["symbol", "d"], "ts").first()["id"] == 2
    assert daily.top_of_day(frame, {"results": 0}, ["symbol", "d"]).first()["id"] == 1


def test_runs_of_names():
    text = "HDFC Bank, TCS, YES Bank & Hindalco among stocks to watch"
    assert entity.list_run(text, text.index("TCS")) == 4 and entity.is_name_list("HDFC Bank, TCS, YES Bank")
    assert entity.list_run("TCS shares fall, says the bank", 0) == 1 and not entity.is_name_list("profits rise, says the bank, TCS")
    assert entity.list_run("why TCS and Infosys shares rose", 4) == 2


def test_each_row_is_scored_for_its_own_target(spark):
    class ByTarget:
        def logits(self, texts, targets):
            import numpy as np

            return np.array([[float(len(t)), 1.0, 0.5] for t in targets])

    from tidemark.functions import scoring

    rows = spark.createDataFrame([(1, "a", "xyz"), (2, "a", ""), (3, "a", None), (4, None, "xyz"), (5, "a", "xyz")], "id long, text string, about string")
    got = {r["id"]: (r["z_m_positive"], r["label_m"]) for r in scoring.scored(rows, "text", ByTarget, "m", target_column="about").collect()}
    assert got == {1: (3.0, "positive"), 2: (0.0, "negative"), 3: (0.0, "negative"), 4: (None, None), 5: (3.0, "positive")}
    assert {r["z_m_positive"] for r in scoring.scored(rows.filter("text is not null"), "text", ByTarget, "m", target="1234").collect()} == {4.0}


def test_pairs_in_a_given_order_and_markdown(spark):
    from tidemark.operators import graph

    m = spark.createDataFrame([(i, n) for i, names in enumerate(("ab", "abc", "cz", "z")) for n in names], "item long, name string")
    got = {(r["source"], r["target"]): r["weight"] for r in graph.comentions(m, order=["c", "b", "a"]).collect()}
    assert got == {("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 1, ("c", "z"): 1}
    assert {tuple(sorted(k)) for k in got} == {(r["source"], r["target"]) for r in graph.comentions(m).collect()}
    t = spark.createDataFrame([("b", 1.23456, None), ("a|c", 2.0, 3)], "k string, v double, n int")
    assert readers.markdown_report(t, ["k"]).first()[0] == "| k | v | n |\n|---|---|---|\n| a\\|c | 2.0 | 3 |\n| b | 1.2346 |  |"


def test_calls_are_scored_once_and_put_before_the_days_after_them(spark):
    from tidemark.functions import scoring

    days = [d for k in range(300) if (d := date(2022, 1, 3) + timedelta(k)).weekday() < 5]
    bars = spark.createDataFrame([("TCS", d, 100.0, 103.0 + i % 5, 97.0 - i % 3, 100.0 + i % 4, 1.0) for i, d in enumerate(days)], "symbol string, d date, o double, h double, l double, c double, v double")
    corpus = spark.createDataFrame([(1, "s", days[5], "TCS wins", "body")], "doc_id long, src string, d date, title string, news string")
    filed = [("TCS", date(2022, 4, 12), 1, "p1"), ("TCS", date(2022, 4, 20), 2, "p2"), ("TCS", date(2022, 7, 15), 3, "p3"), ("TCS", date(2022, 9, 1), 4, "p4"), ("INFY", date(2022, 4, 12), 5, "p5"), ("TCS", date(2022, 10, 20), 6, "gone")]
    filings = spark.createDataFrame([(s, d, i, "Earnings Call Transcript", "", p) for s, d, i, p in filed], "symbol string, d date, id long, sub string, headline string, path string")
    texts = spark.createDataFrame([("p1", ALTERNATING), ("p2", ALTERNATING), ("p3", ALTERNATING), ("p4", "too short"), ("p5", ALTERNATING)], "path string, text string")
    p = pipeline.Pipeline(bars, corpus, "TCS", scoring.first_model(lambda: 1 / 0, lambda: LexiconScorer(["wins"], ["uncertain"])), filings)
    got = p.score_calls(texts, "lexicon", least=3).collect()
    assert {r["path"] for r in got} == {"p1", "p3"}  # p2 is p1's call again, p4 no call, the others are not there or not the target's
    assert all(r["call_time"] == datetime(2026, 4, 23) and r["n_sentences"] == 4 and r["tone_answers"] < 0 for r in got)
    done = spark.createDataFrame([("p1", date(2022, 4, 12), "TCS", "lexicon")], "path string, d date, symbol string, model string")
    assert {r["path"] for r in p.score_calls(texts, "lexicon", done, least=3).collect()} == {"p3"}
    assert {r["path"] for r in p.score_calls(texts, "other", done, least=3).collect()} == {"p1", "p3"}
    panel = {r["path"]: r for r in p.call_window_panel(p.score_calls(texts, "lexicon", least=3), (1, 5)).collect()}
    u = {r["d"]: r["u"] for r in p.features().collect()}
    ahead = sorted(d for d in u if d >= date(2022, 4, 12))[:5]
    assert panel["p1"]["u_1d"] == pytest.approx(u[ahead[0]]) and panel["p1"]["u_5d"] == pytest.approx(sum(u[d] for d in ahead) / 5)
    p.close()
    with pytest.raises(ZeroDivisionError):
        scoring.first_model(lambda: 1 / 0)()
