"""Option chains: formats, forwards, smiles, constant maturity and the variance premium."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.functions import numeric as nm

# Instrument and side codes of the two published file formats.
KINDS = {"OPTIDX": "option", "OPTSTK": "option", "FUTIDX": "future", "FUTSTK": "future", "IDO": "option", "STO": "option", "IDF": "future", "STF": "future"}
SIDES = {"CE": "call", "PE": "put", "XX": "", "": ""}
OLD = {"INSTRUMENT": "kind", "SYMBOL": "symbol", "EXPIRY_DT": "expiry", "STRIKE_PR": "strike", "OPTION_TYP": "cp", "CLOSE": "close", "SETTLE_PR": "settle", "OPEN_INT": "oi", "CONTRACTS": "volume", "TIMESTAMP": "date"}
NEW = {"FinInstrmTp": "kind", "TckrSymb": "symbol", "XpryDt": "expiry", "StrkPric": "strike", "OptnTp": "cp", "ClsPric": "close", "SttlmPric": "settle", "UndrlygPric": "underlying", "OpnIntrst": "oi", "TtlTradgVol": "volume", "TradDt": "date"}
DAYS_LEAST, WIDEST, RATE = 3, 0.25, 0.065


def _mapped(c: Column, codes: dict[str, str], what: str) -> Column:
    got = F.create_map(*[F.lit(x) for k in codes.items() for x in k])[F.coalesce(F.trim(c), F.lit(""))]
    return F.coalesce(got, F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)).cast("string"))


def normalise(raw: DataFrame) -> DataFrame:
    """Either file format as (date, symbol, kind, expiry, strike, cp, close, settle, underlying, oi, volume). Unknown codes raise; numbers that do not parse are null, and so are strikes of futures."""
    names = NEW if "FinInstrmTp" in raw.columns else OLD
    t = raw.select(*[F.col(k).alias(v) for k, v in names.items()])
    day = lambda c: F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.initcap(c), F.lit("dd-MMM-yyyy"))).cast("date")
    number = lambda c: F.expr(f"try_cast({c} as double)") if c in t.columns else F.lit(None).cast("double")
    out = t.select(day(F.col("date")).alias("date"), F.trim("symbol").alias("symbol"), _mapped(F.col("kind"), KINDS, "instrument").alias("kind"), day(F.col("expiry")).alias("expiry"), number("strike").alias("strike"), _mapped(F.col("cp"), SIDES, "side").alias("cp"), *[number(c).alias(c) for c in ("close", "settle", "underlying", "oi", "volume")])
    return out.withColumn("strike", F.when(F.col("kind") == "option", F.col("strike")))


def file_url(base: str, d: Column, switch: str = "2024-07-08") -> Column:
    """The address of a day's file; the format changes on the `switch` day."""
    new = F.concat(F.lit(f"{base}/BhavCopy_NSE_FO_0_0_0_"), F.date_format(d, "yyyyMMdd"), F.lit("_F_0000.csv.zip"))
    old = F.concat(F.lit(f"{base}/"), F.date_format(d, "yyyy"), F.lit("/"), F.upper(F.date_format(d, "MMM")), F.lit("/fo"), F.upper(F.date_format(d, "ddMMMyyyy")), F.lit("bhav.csv.zip"))
    return F.when(d >= switch, new).otherwise(old)


def priced(rows: DataFrame, f: str, k: str, t: str, sigma: str, rate: float = RATE) -> DataFrame:
    """`rows` with call and put, the prices of options on a forward (t in years), and the call's delta, gamma (both in the forward), vega (for a unit of volatility) and theta (for a year).

    All are null where an input is null or not positive. The terms are columns of their own, one step after another, so that
    generated code computes each once.
    """
    good = (F.col(f) > 0) & (F.col(k) > 0) & (F.col(t) > 0) & (F.col(sigma) > 0)
    width = F.col(sigma) * F.sqrt(F.col(t))
    a = rows.withColumns({"_d1": F.when(good, F.ln(F.col(f) / F.col(k)) / width + width / 2), "_disc": F.exp(-rate * F.col(t))})
    b = a.withColumns({"_d2": F.col("_d1") - width, "_n1": normal.cdf(F.col("_d1")), "_m1": normal.cdf(-F.col("_d1")), "_density": F.col("_disc") * normal.pdf(F.col("_d1"))})
    c = b.withColumns({"_n2": normal.cdf(F.col("_d2")), "_m2": normal.cdf(-F.col("_d2"))})
    d = c.withColumns({"call": F.col("_disc") * (F.col(f) * F.col("_n1") - F.col(k) * F.col("_n2")), "put": F.col("_disc") * (F.col(k) * F.col("_m2") - F.col(f) * F.col("_m1"))})
    return d.withColumns({
        "delta": F.col("_disc") * F.col("_n1"), "gamma": F.col("_density") / (F.col(f) * width), "vega": F.col("_density") * F.col(f) * F.sqrt(F.col(t)),
        "theta": rate * F.col("call") - F.col("_density") * F.col(f) * F.col(sigma) / (2 * F.sqrt(F.col(t))),
    }).drop("_d1", "_disc", "_d2", "_n1", "_m1", "_n2", "_m2", "_density")


def forward(chain: DataFrame, rate: float = RATE, nearest: int = 3) -> DataFrame:
    """(symbol, date, expiry, F): the traded future's close, else the median over the strikes with the least |C - P| of K + exp(rT)(C - P) of traded options."""
    by = ["symbol", "date", "expiry"]
    o = chain.filter("kind = 'option' and close > 0 and volume > 0").groupBy(*by, "strike").agg(F.max(F.when(F.col("cp") == "call", F.col("close"))).alias("c"), F.max(F.when(F.col("cp") == "put", F.col("close"))).alias("p")).dropna()
    t = F.datediff("expiry", "date") / 365.0
    near = o.select(*by, F.struct(F.abs(F.col("c") - F.col("p")).alias("gap"), "strike", (F.col("strike") + F.exp(F.lit(rate) * t) * (F.col("c") - F.col("p"))).alias("f")).alias("s"))
    picked = near.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("s")), 1, nearest).alias("s"))
    parity = picked.select(*by, F.explode("s.f").alias("f")).groupBy(*by).agg(F.median("f").alias("parity"))
    future = chain.filter("kind = 'future' and close > 0 and volume > 0").groupBy(*by).agg(F.max("close").alias("future"))
    return parity.join(future, by, "full_outer").select(*by, F.coalesce("future", "parity").alias("F"))


def quotes(chain: DataFrame, forwards: DataFrame) -> DataFrame:
    """Out-of-the-money quotes with log-moneyness k, within the widest band, traded, not about to expire."""
    j = chain.filter("kind = 'option' and volume > 0 and close > 0").join(forwards, ["symbol", "date", "expiry"])
    j = j.withColumns({"k": F.ln(F.col("strike") / F.col("F")), "days": F.datediff("expiry", "date")})
    return j.filter((((F.col("cp") == "put") & (F.col("k") < 0)) | ((F.col("cp") == "call") & (F.col("k") >= 0))) & (F.abs("k") <= WIDEST) & (F.col("days") >= DAYS_LEAST))


def interpolated(k: np.ndarray, iv: np.ndarray, at: float, near: float = 0.02) -> float:
    """Linear between quotes; beyond them the nearest quote if it is within `near`."""
    if k[0] <= at <= k[-1]:
        return float(np.interp(at, k, iv))
    i = int(np.abs(k - at).argmin())
    return float(iv[i]) if abs(k[i] - at) <= near else float("nan")


SLICE = "symbol string, date date, expiry date, days int, F double, atm double, iv95 double, iv105 double, skew double, n_quotes int"


def surface(chain: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each symbol, date and expiry with at least two quotes that have an implied volatility. Groups hold one day's strikes of an expiry."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.days.to_numpy() / 365.0
        iv = nm.implied_vol(pdf.close.to_numpy(), pdf.F.to_numpy(), pdf.strike.to_numpy(), t, rate, (pdf.cp == "call").to_numpy())
        ok = np.isfinite(iv)
        if ok.sum() < 2:
            return pd.DataFrame(columns=[c.split()[0] for c in SLICE.split(", ")])
        order = np.argsort(pdf.k.to_numpy()[ok], kind="stable")
        k, v = pdf.k.to_numpy()[ok][order], iv[ok][order]
        a, lo, hi = (interpolated(k, v, x) for x in (0.0, np.log(0.95), np.log(1.05)))
        return pd.DataFrame([[*key, int(pdf.days.iloc[0]), float(pdf.F.iloc[0]), a, lo, hi, lo - hi, int(ok.sum())]], columns=[c.split()[0] for c in SLICE.split(", ")])

    return quotes(chain, forward(chain, rate)).groupBy("symbol", "date", "expiry").applyInPandas(run, SLICE)


def constant_maturity(slices: DataFrame, days: int = 30) -> DataFrame:
    """Volatility at `days` of each symbol and date by total variance between the expiries around it, flat beyond them; near and next, slope and daily sigma.

    Takes symbol, date, days, atm, skew and F (as `surface` gives them); skew_near and F_near are the nearest expiry's.
    Without a symbol all rows are one; without skew or F these are null.
    """
    missing = {"symbol": "string", "skew": "double", "F": "double"}
    slices = slices.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in slices.columns})
    s = slices.filter(F.col("atm").isNotNull() & ~F.isnan("atm")).withColumn("p", F.struct("days", "atm", "skew", "F"))
    g = s.groupBy("symbol", "date").agg(
        F.max(F.when(F.col("days") <= days, F.col("p"))).alias("lo"), F.min(F.when(F.col("days") >= days, F.col("p"))).alias("hi"), F.min("p").alias("near"), F.count(F.lit(1)).alias("n_expiries"), F.slice(F.sort_array(F.collect_list("p")), 2, 1).alias("second")
    )
    w = lambda p: F.col(f"{p}.atm") * F.col(f"{p}.atm") * F.col(f"{p}.days")
    share = F.try_divide(days - F.col("lo.days"), F.col("hi.days") - F.col("lo.days"))
    between = F.sqrt((w("lo") + (w("hi") - w("lo")) * share) / days)
    iv = F.when(F.col("lo").isNull(), F.col("hi.atm")).when(F.col("hi").isNull() | (F.col("lo.days") == F.col("hi.days")), F.col("lo.atm")).otherwise(between)
    nxt = F.get("second", 0)["atm"]
    return g.select("symbol", "date", iv.alias("iv30"), F.col("near.atm").alias("atm_near"), nxt.alias("atm_next"), F.col("near.days").alias("near_days"), F.col("near.skew").alias("skew_near"), F.col("near.F").alias("F_near"), "n_expiries", (nxt - F.col("near.atm")).alias("term_slope"), (100 * iv / np.sqrt(252)).alias("sigma_day_implied"))


def premium(rows: DataFrame, implied: str, realised: str, by: str) -> DataFrame:
    """Mean implied minus realised volatility, its share above zero and the ratio."""
    d = F.col(implied) - F.col(realised)
    return rows.groupBy(by).agg(F.avg(d).alias("vrp"), F.avg((d > 0).cast("double")).alias("positive"), F.median(F.col(implied) / F.col(realised)).alias("ratio"), F.corr(implied, realised).alias("corr"), F.count(F.lit(1)).alias("n"))
