"""Queries: technical indicators on daily bars of brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import indicators as I
from panelspark.plans import fixtures as fx
from panelspark.plans.core import rounded
from panelspark.plans.fixtures import CTE, sql
from panelspark.plans.registry import ORACLE_SQL, query

D = 6
CTE["bars"] = ("ohlcv", "select *, row_number() over (partition by asset order by date) as n from ohlcv")
CTE["moves"] = ("bars", """select *, sum(coalesce(case when high - low <> 0 then (2 * close - low - high) / (high - low) end, 0) * volume) over (partition by asset order by n rows unbounded preceding) as ad,
    coalesce(greatest(close - c1, 0.0), 0) as gain, coalesce(greatest(c1 - close, 0.0), 0) as loss, greatest(high - low, abs(high - c1), abs(low - c1)) as tr,
    case when high - h1 > l1 - low and high - h1 > 0 then high - h1 else 0 end as up, case when l1 - low > high - h1 and l1 - low > 0 then l1 - low else 0 end as down
    from (select *, lag(close) over w as c1, lag(high) over w as h1, lag(low) over w as l1 from bars window w as (partition by asset order by n))""")

#: DuckDB: the smoothings as one recursion, bar by bar.
STATE = {"ema12": ("close", 2 / 13), "ema26": ("close", 2 / 27), "ema20": ("close", 2 / 21), "g14": ("gain", 1 / 14), "l14": ("loss", 1 / 14), "g28": ("gain", 1 / 28), "l28": ("loss", 1 / 28), "atr": ("tr", 1 / 14), "up14": ("up", 1 / 14), "down14": ("down", 1 / 14), "ad3": ("ad", 2 / 4), "ad10": ("ad", 2 / 11)}


def steps() -> str:
    first = ", ".join(f"cast(m.{c} as double) as {k}" for k, (c, _) in STATE.items())
    new = {k: f"({a!r} * m.{c} + {1 - a!r} * s.{k})" for k, (c, a) in STATE.items()}
    dx = lambda u, d: f"coalesce(case when {u} + {d} <> 0 then 100 * abs({u} - {d}) / ({u} + {d}) end, 0)"
    macd = f"({new['ema12']} - {new['ema26']})"
    nexts = ", ".join(f"{v} as {k}" for k, v in new.items())
    return f"""with recursive {', '.join(f'{k} as ({CTE[k][1]})' for k in ('ohlcv', 'bars', 'moves'))},
    s as (select m.asset, m.date, m.n, m.close, {first}, cast(0 as double) as signal, cast({dx('m.up', 'm.down')} as double) as adx from moves m where n = 1
    union all select m.asset, m.date, m.n, m.close, {nexts}, {2 / 10!r} * {macd} + {1 - 2 / 10!r} * s.signal, {1 / 14!r} * {dx(new['up14'], new['down14'])} + {1 - 1 / 14!r} * s.adx
    from s join moves m on m.asset = s.asset and m.n = s.n + 1)"""


#: DuckDB: the expressions of all indicators, over the recursion's rows and over windows.
RECURSIVE: dict[str, str] = {}
WINDOWED: dict[str, str] = {}


def put_recursive(name: str, expressions: dict[str, str]) -> None:
    RECURSIVE.update(expressions)

    @query(name, steps() + " select asset, date, " + ", ".join(f"round({e}, {D}) + 0.0 as {k}" for k, e in expressions.items()) + " from s")
    def _(spark, sf):
        return rounded(I.recursive_set(fx.ohlcv(spark, sf)), "asset", "date", d=D, **{k: k for k in expressions})


put_recursive("t01_ema", {"ema_12": "(ema12 - close) / close", "ema_26": "(ema26 - close) / close"})
put_recursive("t02_macd", {"macd": "(ema12 - ema26) / close", "macd_hist": "(ema12 - ema26 - signal) / close", "macd_signal": "signal / close"})
put_recursive("t03_adx", {"adx": "adx / 100"})
put_recursive("t05_rsi", {"rsi_14": "coalesce(case when g14 + l14 <> 0 then g14 / (g14 + l14) end, 0.5)", "rsi_28": "coalesce(case when g28 + l28 <> 0 then g28 / (g28 + l28) end, 0.5)"})
put_recursive("t08_atr", {"atr": "atr / close"})
put_recursive("t10_keltner", {"keltner_up": "(ema20 + 2 * atr - close) / close", "keltner_low": "(ema20 - 2 * atr - close) / close"})
put_recursive("t15_adosc", {"adosc": "ad3 - ad10"})


def frame(n: int) -> str:
    return f"over (partition by asset order by n rows between {n - 1} preceding and current row)"


CTE["tp"] = ("bars", f"select *, (high + low + close) / 3 as tp, case when max(high) {frame(14)} - min(low) {frame(14)} <> 0 then 100 * (close - min(low) {frame(14)}) / (max(high) {frame(14)} - min(low) {frame(14)}) end as k, case when high - low <> 0 then (2 * close - low - high) / (high - low) end as clv from bars")
CTE["tq"] = ("tp", f"select *, sign(tp - lag(tp) over w) as flow, avg(k) {frame(3)} as k3, sum(coalesce(sign(close - lag(close) over w), 0) * volume) over (partition by asset order by n rows unbounded preceding) as obv from (select *, lag(close) over w as c1 from tp window w as (partition by asset order by n)) window w as (partition by asset order by n)".replace("sum(coalesce(sign(close - lag(close) over w), 0) * volume)", "sum(coalesce(sign(close - c1), 0) * volume)"))


def full(e: str, n: int) -> str:
    return f"case when n >= {n} then {e} end"


def put_window(name: str, expressions: dict[str, str], d: int = D) -> None:
    WINDOWED.update(expressions)

    @query(name, sql("select asset, date, " + ", ".join(f"round({e}, {d}) + 0.0 as {k}" for k, e in expressions.items()) + " from tq window w as (partition by asset order by n)", "tq"))
    def _(spark, sf):
        return rounded(I.window_set(fx.ohlcv(spark, sf)), "asset", "date", d=d, **{k: k for k in expressions})


@query("t04_cci", sql("select a.asset, a.date, round(case when a.n >= 20 and avg(abs(b.tp - a.m)) <> 0 then (a.tp - a.m) / (0.015 * avg(abs(b.tp - a.m))) end, 5) + 0.0 as cci from t a join t b on a.asset = b.asset and b.n between a.n - 19 and a.n group by a.asset, a.date, a.n, a.tp, a.m", "tp", t=f"select *, avg(tp) {frame(20)} as m from tp"))
def _(spark, sf):
    return rounded(I.window_set(fx.ohlcv(spark, sf)), "asset", "date", d=5, cci="cci")


put_window("t06_stochastic", {"stoch_k": full("k3 / 100", 16), "stoch_d": full(f"avg(k3) {frame(3)} / 100", 18)})
put_window("t07_roc_mom", {"roc_5": "close / lag(close, 5) over w - 1", "roc_21": "close / lag(close, 21) over w - 1", "mom_14": "(close - lag(close, 14) over w) / close"})
put_window("t09_bollinger", {"bb_up": full(f"(avg(close) {frame(20)} + 2 * stddev_pop(close) {frame(20)} - close) / close", 20), "bb_low": full(f"(avg(close) {frame(20)} - 2 * stddev_pop(close) {frame(20)} - close) / close", 20), "bb_width": full(f"4 * stddev_pop(close) {frame(20)} / avg(close) {frame(20)}", 20)})
put_window("t11_obv", {"obv_change": "case when lag(obv) over w <> 0 then (obv - lag(obv) over w) / abs(lag(obv) over w) end"}, 10)
put_window("t12_vwap", {"vwap": "(sum(tp * volume) over (partition by asset, date_trunc('month', date) order by n rows unbounded preceding) / sum(volume) over (partition by asset, date_trunc('month', date) order by n rows unbounded preceding) - close) / close"})
POS, NEG = (f"sum(case when flow {s} 0 then tp * volume else 0 end) {frame(14)}" for s in (">", "<"))
put_window("t13_mfi", {"mfi": full(f"coalesce(case when {POS} + {NEG} <> 0 then 100 * {POS} / ({POS} + {NEG}) end, 50) / 100", 14)})
put_window("t14_cmf", {"cmf": full(f"sum(coalesce(clv, 0) * volume) {frame(20)} / sum(volume) {frame(20)}", 20)})
put_window("t16_pivot", {"pivot": "(lag(tp) over w - close) / close", "r1": "(2 * lag(tp) over w - lag(low) over w - close) / close", "s1": "(2 * lag(tp) over w - lag(high) over w - close) / close"})
put_window("t17_donchian", {"don_up": full(f"(max(high) {frame(20)} - close) / close", 20), "don_low": full(f"(min(low) {frame(20)} - close) / close", 20)})


def listed(expressions: dict[str, str], source: str) -> str:
    names, values = ", ".join(f"'{k}'" for k in expressions), ", ".join(f"cast({e} as double)" for e in expressions.values())
    return f"select asset, date, unnest([{names}]) as indicator, unnest([{values}]) as value from {source}"


ALL = f"""select * from ({steps()} {listed(RECURSIVE, 's')}) union all select * from ({sql(listed(WINDOWED, 'tq window w as (partition by asset order by n)'), 'tq')})
    union all select asset, date, 'cci', cci from ({ORACLE_SQL['t04_cci']})"""


@query("t18_indicator_panel", f"select asset, date, indicator, round(value, case indicator when 'cci' then 5 when 'obv_change' then 10 else 6 end) + 0.0 as value from (select asset, date, indicator, coalesce(last_value(value ignore nulls) over (partition by asset, indicator order by date rows unbounded preceding), 0) as value from ({ALL}))")
def _(spark, sf):
    df = I.indicator_panel(fx.ohlcv(spark, sf))
    # Decimals that two engines share: fewer for values of hundreds, more for ratios of whole numbers, which tie.
    v, name = F.col("value"), F.col("indicator")
    value = F.when(name == "cci", F.round(v, 5)).when(name == "obv_change", F.round(v, 10)).otherwise(F.round(v, 6)) + 0.0
    return df.select("asset", "date", "indicator", value.alias("value"))
