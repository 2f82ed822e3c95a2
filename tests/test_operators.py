"""Golden cases of alignment, text, transcripts, readers, options and streams."""

import datetime as dt
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import entity, scoring, signals
from tidemark.operators import align, calls, daily, graph, options, state
from tidemark.sources import readers
from tidemark.streaming import live

D = dt.date.fromisoformat


def weekdays(spark, first="2024-01-01", last="2024-02-29"):
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as d").filter(F.weekday("d") < 5)
    return days.selectExpr("d", "row_number() over (order by d) as seq").withColumn("seq", F.col("seq").cast("long"))


def test_carry(spark):
    rows = spark.createDataFrame([("x", D("2024-01-01"), 1.0, 1.0), ("x", D("2024-01-06"), -1.0, 1.0), ("x", D("2024-02-20"), 0.5, 1.0)], "k string, d date, s double, w double")
    got = {str(r["d"]): r["carry"] for r in daily.carried(rows, "k", "s", "w").collect()}
    assert got["2024-01-01"] == got["2024-01-05"] == 1.0 and got["2024-01-06"] == pytest.approx((0.5 - 1) / 1.5) and "2024-02-10" not in got


def test_weekend_rows_and_flags(spark):
    cal = weekdays(spark)
    call = spark.createDataFrame([("T", D("2024-01-06"), 1)], "symbol string, d date, id long")

    placed = align.fan_out(call, cal, "symbol", 3, ["id"]).orderBy("d").collect()
    assert [(str(r["d"]), r["days_since"]) for r in placed] == [("2024-01-05", 0), ("2024-01-08", 1), ("2024-01-09", 2)]
    meet, res = (spark.createDataFrame([("T", D(x))], "symbol string, d date") for x in ("2024-01-02", "2024-01-11"))
    days = {str(r["d"]) for r in align.interval_flags(align.active_intervals(meet, res, "symbol"), cal, "symbol").collect()}
    assert min(days) == "2024-01-02" and max(days) == "2024-01-11" and "2024-01-12" not in days
    react = spark.createDataFrame([(1, D("2024-01-05"), True), (2, D("2024-01-06"), True), (3, D("2024-01-05"), False), (4, D("2024-01-01"), False)], "id long, d date, after_close boolean")
    assert {r["id"]: str(r["react_d"]) for r in align.reaction_day(react, cal).collect()} == {1: "2024-01-08", 2: "2024-01-08", 3: "2024-01-05"}


def test_same_call_rule(spark):
    rows = spark.createDataFrame([("T", D("2024-04-15"), "call"), ("T", D("2024-04-25"), "rev"), ("T", D("2024-07-15"), "next")], "k string, d date, path string")
    paths = lambda known=None: [r["path"] for r in state.keep_apart(rows, "k", 20, known).orderBy("d").collect()]
    event = lambda d: spark.createDataFrame([("T", D(d))], "k string, d date")
    assert paths() == ["call", "next"] and paths(event("2024-04-15")) == ["next"] and paths(event("2024-07-15")) == ["call"]


def test_entities_and_signals(spark):
    assert entity.model_input("Some clients may delay, but TCS wins despite Nifty IT, unlike Infosys", "TCS")[1] == "Some clients may delay, <a> but </a> <t> TCS </t> wins <c> despite </c> <m> Nifty IT </m>, unlike <o> Infosys </o>"
    rows = spark.createDataFrame([("HCLTech drags, Sensex ends flat - Mint", None), ("TCS, Infosys, Wipro shares fall", ""), ("tcs rate on foreign remittance", ""), (None, "Infosys")], "title string, description string")
    got = [r["entity"] for r in entity.analysed(rows, "HCLTECH").collect()]
    assert (got[0]["role"], got[0]["target_span"], got[0]["move_signal"], got[0]["relevance"]) == ("primary", "HCLTech drags", -1, 1.0) and got[1]["relevance"] == 0.0
    assert entity.placed("TCS, Infosys, Wipro shares fall", "", "TCS")["role"] == "list_member" and entity.placed("tcs rate on foreign remittance", "", "TCS")["role"] == "wrong_entity"
    sector = entity.analysed(rows, "SECTOR").select("entity.*").collect()
    assert {r["role"] for r in sector} == {"sector"} and [r["move_signal"] for r in sector] == [-1, -1, 0, 0] and {r["relevance"] for r in sector} == {1.0}
    heads = spark.createDataFrame([("", "Transcript of the Q2 earnings call"), ("Earnings Call Transcript", None), ("", "AGM transcript results"), ("", "transcript")], "sub string, head string")
    assert [r[0] for r in heads.select(signals.is_transcript(F.col("sub"), F.col("head"))).collect()] == [True, True, False, False]
    names = spark.createDataFrame([(1, "TCS"), (1, "WIPRO"), (2, "INFY"), (2, "WIPRO"), (3, "INFY"), (3, "TCS"), (4, "TCS")], "item long, name string")
    assert {(r["source"], r["target"]): r["weight"] for r in graph.comentions(names).collect()} == {("TCS", "WIPRO"): 1, ("INFY", "WIPRO"): 1, ("INFY", "TCS"): 1}


CALL = "Cover page\nLadies and gentlemen, good day and welcome to the call.\n" + "\n".join(
    ["Moderator: Ladies and gentlemen, good day and welcome to the Q2 earnings call.", "Raj Rao: We expect growth to continue next year across markets. It may slow down in some of the areas.", "Moderator: We will now begin the question and answer session. The first question is from the line of Amit Shah from ABC. Please go ahead.", "Amit Shah: What is the outlook for the next quarter on margins?", "Raj Rao: We see a pipeline of 5 billion in the coming quarters. Thank you."]
    + [f"Raj Rao: Further remark number {i} about demand in all our regions." for i in range(6)]
)


def test_transcripts(spark):
    rows = calls.turns(CALL)
    assert [(r[0], r[1], r[2]) for r in rows[:5]] == [("Moderator", "moderator", "prepared"), ("Raj Rao", "management", "prepared"), ("Moderator", "moderator", "qa"), ("Amit Shah", "analyst", "qa"), ("Raj Rao", "management", "qa")]
    s = calls.sentences(calls.parsed(spark.createDataFrame([("p", CALL), ("q", None)], "path string, text string"))).orderBy("turn", "k").collect()
    assert {r["context"] for r in s} == {"management prepared", "management answer", "analyst question"} and s[0]["forward"] and s[1]["hedge"] and not any(r["path"] == "q" for r in s)
    assert calls.call_time("October 12, 2023, 19:00 hrs IST") == dt.datetime(2023, 10, 12, 19, 0)


def test_options(spark):
    from tidemark.functions import numeric as nm

    rows = []
    for days in (2, 24, 52):
        for k in range(80, 121, 4):
            t = days / 365
            for cp in ("call", "put"):
                rows.append((D("2024-01-01"), "X", "option", D("2024-01-01") + dt.timedelta(days), float(k), cp, float(nm.black76(100, k, t, 0.065, 0.22 - 0.3 * nm.np.log(k / 100), cp == "call")), 5.0))
    chain = spark.createDataFrame(rows, "date date, symbol string, kind string, expiry date, strike double, cp string, close double, volume double")
    s = options.surface(chain)
    got = {r["days"]: r for r in s.collect()}
    assert set(got) == {24, 52} and got[24]["F"] == pytest.approx(100) and got[24]["atm"] == pytest.approx(0.22, abs=0.002)
    iv = options.constant_maturity(s.select("date", "days", "atm")).first()
    a, b = got[24]["atm"] ** 2 * 24, got[52]["atm"] ** 2 * 52
    assert iv["iv30"] == pytest.approx(((a + (b - a) * 6 / 28) / 30) ** 0.5) and iv["near_days"] == 24
    both = chain.unionByName(chain.withColumns({"symbol": F.lit("Y"), "strike": F.col("strike") * 50, "close": F.col("close") * 50}))
    idle = [(D("2024-01-01"), "Y", "future", D("2024-01-25"), None, "", 4000.0, 0.0), (D("2024-01-01"), "X", "future", D("2024-01-25"), None, "", 101.0, 3.0)]
    fwd = {(r["symbol"], str(r["expiry"])): r["F"] for r in options.forward(both.unionByName(spark.createDataFrame(idle, chain.schema))).collect()}
    assert fwd["X", "2024-01-25"] == 101.0 and fwd["Y", "2024-01-25"] == pytest.approx(5000) and fwd["X", "2024-02-22"] == pytest.approx(100)
    two = {r["symbol"]: r for r in options.constant_maturity(options.surface(both)).collect()}
    assert two["X"]["iv30"] == pytest.approx(two["Y"]["iv30"]) == pytest.approx(iv["iv30"]) and two["Y"]["F_near"] == pytest.approx(5000) and two["X"]["skew_near"] == got[24]["skew"]
    old = spark.createDataFrame([("OPTIDX", "NIFTY", "25-JAN-2024", "21000", "CE", "10.5", "10.4", "7", "x", "02-JAN-2024"), ("FUTIDX", "NIFTY", "25-JAN-2024", "0", "XX", "21010", "21011", "7", "3", "02-JAN-2024")], list(options.OLD))
    out = {r["kind"]: r for r in options.normalise(old).collect()}
    assert out["option"]["cp"] == "call" and out["option"]["volume"] is None and str(out["option"]["expiry"]) == "2024-01-25" and out["future"]["strike"] is None
    with pytest.raises(Exception, match="unknown instrument"):
        options.normalise(old.replace("OPTIDX", "WHAT")).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,title,news,url\n2024-01-02 00:00:00+05:30,"TCS, up",body,u\nbad,x,"two\nlines",v\n')
    got = readers.corpus(spark, {"a": str(tmp_path / "a.csv")}).orderBy("title").collect()
    assert [(r["src"], str(r["d"]), r["title"], r["news"]) for r in got] == [("a", "2024-01-02", "TCS, up", "body"), ("a", "None", "x", "two\nlines")]
    xml = "<rss><channel>" + "".join(f"<item><title>News {i} - Mint</title><link>l{i}</link><pubDate>{d}</pubDate><source url='https://www.livemint.com'>Mint</source></item>" for i, d in enumerate(["Mon, 01 Jan 2024 20:10:00 GMT", "no date"])) + "</channel></rss>"
    rows = readers.feed(spark.createDataFrame([(xml,)], "xml string"), sources={"livemint.com": "mint"}).collect()
    assert [(str(r["d"]), r["title"], r["source"]) for r in rows] == [("2024-01-02", "News 0", "mint")]
    asked = []
    full = readers.split_windows(lambda a, b: asked.append((a, b)) or [1] * (100 if b - a > dt.timedelta(2) else 30), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9), 95, dt.timedelta(1))
    assert len(asked) == 7 and len(full) == 120
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x").write_text("1")
    readers.unpack(readers.pack(tmp_path / "s"), tmp_path / "t")
    assert (tmp_path / "t" / "x").read_text() == "1"
    for name in ("/etc/x", "../x"):
        bad = io.BytesIO()
        with tarfile.open(fileobj=bad, mode="w:gz") as t:
            t.addfile(tarfile.TarInfo(name))
        with pytest.raises(ValueError, match="unsafe"):
            readers.unpack(bad.getvalue(), tmp_path / "u")
    with pytest.raises(ValueError, match="unknown"):
        (tmp_path / "c.json").write_text('{"nope": 1}')
        readers.Settings.load(tmp_path / "c.json")
    assert readers.Settings.load(environment={"TIDEMARK_HORIZON": "5"}).horizon == 5
    assert readers.windows(spark, "2024-01-01", "2024-01-20", "7 days").count() == 3
    lines = spark.createDataFrame([("good news@positive",), ("at a@b@negative",), ("x@odd",)], "value string")
    assert {(r["text"], r["label"]) for r in readers.labelled_lines(lines, {"positive": "p", "negative": "n"}).collect()} == {("good news", "p"), ("at a@b", "n")}


def test_scorer_and_second_run_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("up", D("2024-01-01"), 1), ("down", D("2024-01-02"), 2), ("up", D("2024-01-03"), 3), (None, D("2024-01-03"), 4)], "title string, d date, id long")
    s = {r["id"]: r for r in scoring.scored(rows, "title", lambda: scoring.LexiconScorer(["up"], ["down"]), "x").collect()}
    assert s[1]["sent_x"] > 0 > s[2]["sent_x"] and s[4]["sent_x"] is None and s[1]["p_x_positive"] + s[1]["p_x_negative"] + s[1]["p_x_neutral"] == pytest.approx(1)
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for _ in range(2):
        rows.filter("title is not null").coalesce(1).write.mode("append").parquet(src)
        live.append_new(live.file_stream(spark, src, rows.schema), out, cp, ["title"], ["d", "id"]).awaitTermination()
        got = live.Merged(spark, out).read()
        assert {(r["title"], r["id"]) for r in got.collect()} == {("up", 1), ("down", 2)}


def test_no_row_is_lost_at_the_edges(spark):
    cal = weekdays(spark)
    rows = spark.createDataFrame([(1, D("2023-12-31")), (2, D("2024-02-29")), (3, D("2199-01-01")), (4, None)], "id long, d date")
    assert {r["id"]: str(r["row_d"]) for r in align.asof_backward(rows, cal).collect()} == {2: "2024-02-29", 3: "2024-02-29"}
    twice = spark.createDataFrame([("a", None), ("a", None), (None, None)], "k string, j string")
    assert sorted(r["dup_count"] for r in daily.dup_count(twice, ["k", "j"]).collect()) == [1, 2, 2]
    days = spark.createDataFrame([("x", D("2024-01-01"), 1.0, 1.0), ("x", D("2024-01-06"), None, 1.0)], "k string, d date, s double, w double")
    got = {str(r["d"]): r["carry"] for r in daily.carried(days, "k", "s", "w").collect()}
    assert got["2024-01-06"] == pytest.approx(0.5 / 1.5) and max(got) == "2024-01-06"


def test_network_summary(spark):
    names = spark.createDataFrame([(x,) for x in "abcdefg"], "name string")
    none = spark.createDataFrame([], "source string, target string, weight long")
    s = graph.summary(none, names).first()
    assert (s["nodes"], s["edges"], s["density"], s["isolates"], s["components"], s["giant"]) == (7, 0, 0.0, 7, 7, 1) and graph.diameter(none).first()[0] == 0
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 1), ("e", "f", 5)], "source string, target string, weight long")
    s = graph.summary(path, names).first()
    assert (s["nodes"], s["edges"], s["isolates"], s["components"], s["giant"]) == (7, 4, 1, 3, 4) and s["density"] == pytest.approx(8 / 42) and graph.diameter(path).first()[0] == 3
    assert [(r["source"], r["weight"]) for r in graph.top_ties(path, 2).collect()] == [("e", 5), ("b", 2)]
    chain = spark.range(40).selectExpr("lpad(id, 3, '0') as source", "lpad(id + 1, 3, '0') as target", "1L as weight")
    assert {r["component"] for r in graph.components(chain).collect()} == {"000"}
