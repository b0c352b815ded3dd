"""One query for each operator of the inventory, with DuckDB SQL that must give the same rows.

Panel operators answer with a digest by date: count, sum, and a sum weighted by ticker, of the operator's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import formulas
from panelforge.functions.tables import kept, shared_folder
from panelforge.operators import backtest as bt
from panelforge.operators import memory as me
from panelforge.operators import scoring as sc
from panelforge.operators import experiment, screening
from panelforge.plans import compiler
from panelforge.sources import panel as src
from panelforge.streaming import attribution, coefficients, sink
from panelforge.streaming import events as streaming

SLICE = "rank(ADJUSTED_PRICE / ts_mean(ADJUSTED_PRICE, 20)) * -1"
REVERSAL = "rank(delta(ADJUSTED_PRICE, 20)) * -1"


def digest(df: DataFrame, value: str = "v") -> DataFrame:
    v = F.col(value)
    out = df.groupBy("date").agg(F.count(v).alias("n"), (F.round(F.sum(v) + 1.23457e-5, 4) + 0.0).alias("s1"), (F.round(F.sum(v * F.col("ticker")) + 1.23457e-5, 3) + 0.0).alias("s2"))
    return out.where("n > 0")


DIGEST = "select date, count(v) as n, round(sum(v) + 1.23457e-5, 4) + 0.0 as s1, round(sum(v * ticker) + 1.23457e-5, 3) + 0.0 as s2 from v group by date having count(v) > 0"

DAILY = """daily as (
  select cast(l_shipdate as date) as date, p_size as ticker, round(avg(l_extendedprice / l_quantity) + 1.3e-6, 4) as price, sum(l_quantity) as volume,
    round(sum(l_extendedprice * (1 - l_discount)) + 1.3e-4, 2) as revenue, round(sum(p_retailprice * l_quantity) + 1.3e-4, 2) as cogs, round(sum(l_extendedprice * l_tax) + 1.3e-4, 2) as tax,
    cast(count(distinct l_orderkey) as double) as orders
  from lineitem join part on l_partkey = p_partkey where isodow(l_shipdate) < 6 group by 1, 2)"""
PANEL = f"""with {DAILY}, st as (
  select date, ticker, price, volume, round(sum(revenue) over y + 1.3e-4, 2) as rev, round(sum(cogs) over y + 1.3e-4, 2) as cogs, round(sum(tax) over y + 1.3e-4, 2) as tax, round(sum(orders) over y + 1.3e-4, 2) as sh
  from daily window y as (partition by ticker order by date range between interval 364 days preceding and current row)),
days as (select cast(d as date) as date from (select unnest(generate_series((select min(date) from daily), (select max(date) from daily), interval 1 day)) as d) where isodow(d) < 6),
tick as (select distinct ticker from daily),
p as materialized (
  select days.date, tick.ticker, 'S' || (tick.ticker % 5) as sector, last_value(price ignore nulls) over w as x, last_value(volume ignore nulls) over w as y,
    last_value(rev ignore nulls) over w as rev, last_value(cogs ignore nulls) over w as cogs, last_value(tax ignore nulls) over w as tax, last_value(sh ignore nulls) over w as sh
  from days cross join tick left join st on st.date = days.date and st.ticker = tick.ticker
  window w as (partition by tick.ticker order by days.date rows between unbounded preceding and current row))"""


def panel_query(formula: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(compiler.evaluate(src.panel_a(spark, sf_dir), {"v": formula}).select("date", "ticker", "v"))

    return run


def panel_sql(expr: str, before: str = "", source: str = "p") -> str:
    return f"{PANEL}{before}, v as (select date, ticker, {expr} as v from {source}) {DIGEST}"


CS, WT = "partition by date", "partition by ticker order by date"


def frame(n: int) -> str:
    return f"({WT} rows between {n - 1} preceding and current row)"


def full(agg: str, n: int, x: str = "x") -> str:
    return f"case when count({x}) over {frame(n)} = {n} then {agg} over {frame(n)} end"


def pct_rank(x: str, keys: str = "date") -> str:
    return f"case when {x} is not null then (rank() over (partition by {keys}, {x} is null order by {x}) + (count(*) over (partition by {keys}, {x}) - 1) / 2.0) / count({x}) over (partition by {keys}) end"


def zscore(x: str) -> str:
    return f"({x} - avg({x}) over ({CS})) / (case when coalesce(stddev_samp({x}) over ({CS}), 0) = 0 then 1.0 else stddev_samp({x}) over ({CS}) end + 1e-9)"


def group_z(x: str) -> str:
    return f"({x} - avg({x}) over (partition by date, sector)) / (stddev_samp({x}) over (partition by date, sector) + 1e-9)"


def decay(n: int) -> str:
    return " + ".join(f"lag(x, {n - 1 - i}) over ({WT}) * ({i + 1} / {n * (n + 1) / 2})" for i in range(n))


FIRST = ", q as (select *, row_number() over (partition by ticker order by date) as t from p where x is not null)"


def ema_sql(x: str, n: int) -> str:
    """The recursion in closed form over the ticker's t-th value."""
    a = 2 / (n + 1)
    return f"pow(1 - {a}, t) * sum(case when t = 1 then {x} / (1 - {a}) else {a} * {x} * pow(1 - {a}, -t) end) over ({WT})"


P, V = "ADJUSTED_PRICE", "ADJUSTED_VOLUME"
LISTS = f", q as (select *, list(x) over {frame(10)} as l, count(x) over {frame(10)} as k from p)"
RSI = FIRST + f", d as (select *, x - lag(x) over ({WT}) as u from q), g as (select *, sum(greatest(u, 0) * pow(13 / 14.0, -t)) over ({WT}) as up, sum(greatest(-u, 0) * pow(13 / 14.0, -t)) over ({WT}) as down from d)"
MACD = FIRST + f", d as (select *, {ema_sql('x', 12)} - ({ema_sql('x', 24)}) as m from q)"

#: key: (formula, SQL expression, CTEs before it, its source)
FORMULAS: dict[str, tuple] = {
    "cs01_rank": (f"rank({P})", pct_rank("x")),
    "cs02_zscore": (f"zscore({P})", zscore("x")),
    "cs03_sign": (f"sign({P} - 1000)", "sign(x - 1000)"),
    "cs04_log": (f"log({P} - 1000)", "case when x is not null then ln(greatest(x - 1000, 1e-9)) end"),
    "cs05_abs": (f"abs({P} - 1000)", "abs(x - 1000)"),
    "cs06_scale": (f"scale({P})", f"case when max(x) over ({CS}) > min(x) over ({CS}) then (x - min(x) over ({CS})) / (max(x) over ({CS}) - min(x) over ({CS})) end"),
    "cs07_tanh": (f"tanh({P} / 1000 - 1)", "tanh(x / 1000 - 1)"),
    "cs08_sigmoid": (f"sigmoid({P} - 1000)", "case when x is not null then 1 / (1 + exp(-greatest(least(x - 1000, 500.0), -500.0))) end"),
    "cs09_exp": (f"exp({P} / 100000)", "case when x is not null then exp(least(x / 100000, 500.0)) end"),
    "cs10_sqrt": (f"sqrt({P} - 1000)", "case when x is not null then sqrt(greatest(x - 1000, 0.0)) end"),
    "cs11_power": (f"power({P} / 1000, 3)", "pow(x / 1000, 3)"),
    "cs12_sign_power": (f"sign_power({P} / 1000 - 1, 2)", "sign(x / 1000 - 1) * pow(abs(x / 1000 - 1), 2)"),
    "cs13_max": (f"max({P}, {V} * 20)", "case when x is not null and y is not null then greatest(x, y * 20) end"),
    "cs14_min": (f"min({P}, {V} * 20)", "case when x is not null and y is not null then least(x, y * 20) end"),
    "cs15_clip": (f"clip({P}, 900, 1200)", "case when x is not null then least(greatest(x, 900.0), 1200.0) end"),
    "cs16_where": (f"where({P} > 1000, {V}, -1)", "case when coalesce(x > 1000, false) then y else -1.0 end"),
    "cs17_group_rank": (f"group_rank({P}, SECTOR)", pct_rank("x", "date, sector")),
    "cs18_group_zscore": (f"group_zscore({P}, SECTOR)", group_z("x")),
    "cs19_indneutralize": (f"indneutralize({V}, SECTOR)", group_z("y")),
    "ts01_delta": (f"delta({P}, 5)", f"x - lag(x, 5) over ({WT})"),
    "ts02_ts_delta": (f"ts_delta({V}, 3)", f"y - lag(y, 3) over ({WT})"),
    "ts03_ts_shift": (f"ts_shift({P}, 7)", f"lag(x, 7) over ({WT})"),
    "ts04_ts_mean": (f"ts_mean({P}, 20)", full("avg(x)", 20)),
    "ts05_ts_std": (f"ts_std({P}, 20)", full("stddev_samp(x)", 20)),
    "ts06_ts_max": (f"ts_max({P}, 20)", full("max(x)", 20)),
    "ts07_ts_min": (f"ts_min({P}, 20)", full("min(x)", 20)),
    "ts08_ts_sum": (f"ts_sum({P}, 20)", full("sum(x)", 20)),
    "ts09_ts_rank": (f"ts_rank({P}, 10)", "case when k = 10 then (len(list_filter(l, lambda e: e < x)) + (len(list_filter(l, lambda e: e = x)) + 1) / 2.0) / 10 end", LISTS, "q"),
    "ts10_ts_argmax": (f"ts_argmax({P}, 10)", "case when k = 10 then cast(list_position(l, list_max(l)) - 1 as double) end", LISTS, "q"),
    "ts11_ts_argmin": (f"ts_argmin({P}, 10)", "case when k = 10 then cast(list_position(l, list_min(l)) - 1 as double) end", LISTS, "q"),
    "ts12_ts_corr": (f"ts_corr({P}, {V}, 20)", f"case when count(x) over {frame(20)} = 20 and stddev_samp(x) over {frame(20)} > 0 and stddev_samp(y) over {frame(20)} > 0 then covar_samp(x, y) over {frame(20)} / (stddev_samp(x) over {frame(20)} * stddev_samp(y) over {frame(20)}) end"),
    "ts13_ts_cov": (f"ts_cov({P}, {V}, 20)", full("covar_samp(x, y)", 20)),
    "ts14_decay_linear": (f"decay_linear({P}, 10)", decay(10)),
    "ts15_product": (f"product({P} / 100000, 5)", full("product(x / 100000)", 5)),
    "ts16_ts_av_diff": (f"ts_av_diff({P}, 20)", "x - " + f"({full('avg(x)', 20)})"),
    "ts17_ts_zscore": (f"ts_zscore({V}, 20)", f"case when count(y) over {frame(20)} = 20 then (y - avg(y) over {frame(20)}) / (stddev_samp(y) over {frame(20)} + 1e-9) end"),
    "ta01_ema": (f"ema({P}, 10)", ema_sql("x", 10), FIRST, "q"),
    "ta02_sma": (f"sma({V}, 20)", full("avg(y)", 20, "y")),
    "ta03_wma": (f"wma({P}, 10)", decay(10)),
    "ta04_rsi": (f"rsi({P}, 14)", "case when t > 14 and down > 0 then 100 - 100 / (1 + up / down) end", RSI, "g"),
    "ta05_macd": (f"macd({P}, 24)", f"m - ({ema_sql('m', 6)})", MACD, "d"),
    "ta06_boll_upper": (f"boll_upper({P}, 20)", f"case when count(x) over {frame(20)} = 20 then avg(x) over {frame(20)} + 2 * stddev_samp(x) over {frame(20)} end"),
    "ta07_boll_lower": (f"boll_lower({P}, 20)", f"case when count(x) over {frame(20)} = 20 then avg(x) over {frame(20)} - 2 * stddev_samp(x) over {frame(20)} end"),
    "ta08_boll_mid": (f"boll_mid({P}, 20)", full("avg(x)", 20)),
    "ex01_arithmetic": ("-(REVENUE_LTM - COGS_LTM) / (INCOME_TAX_LTM + 1000) + SHARES_BASIC ** 2 / 1000", "-(rev - cogs) / (tax + 1000) + sh * sh / 1000"),
    "ex02_comparisons": (f"where(({P} > 1000) & ~({V} < 30) | (SHARES_BASIC != 5), 1, 0)", "case when (coalesce(x > 1000, false) and not coalesce(y < 30, false)) or coalesce(sh <> 5, true) then 1.0 else 0.0 end"),
    "ex03_inline_methods": (f"{P}.diff(2) + {P}.shift(1) + {P}.rolling(5).mean() + {P}.pct_change()", f"x - lag(x, 2) over ({WT}) + lag(x, 1) over ({WT}) + ({full('avg(x)', 5)}) + x / lag(x) over ({WT}) - 1"),
    "ex04_inline_whitelist": (f"{V}.rolling(10).std().abs().clip(1, 9)", f"least(greatest(abs({full('stddev_samp(y)', 10, 'y')}), case when count(y) over {frame(10)} = 10 then 1.0 end), case when count(y) over {frame(10)} = 10 then 9.0 end)"),
    "ex05_constants": (f"np.log({P}) + np.sqrt({V}) + np.tanh({P} / 2000)", "ln(x) + sqrt(y) + tanh(x / 2000)"),
    "ex06_panel_eval": (f"rank({P} - ts_shift({P}, 5)) + zscore({V})", f"({pct_rank('u')}) + {zscore('y')}", f", q as (select *, x - lag(x, 5) over ({WT}) as u from p)", "q"),
}



#: The same operators over a trading year, by blocks.
YEAR = 252
LONG_LISTS = LISTS.replace(frame(10), frame(YEAR))
FORMULAS |= {
    "ts04_year_mean": (f"ts_mean({P}, {YEAR})", full("avg(x)", YEAR)),
    "ts05_year_std": (f"ts_std({P}, {YEAR})", full("stddev_samp(x)", YEAR)),
    "ts06_year_max": (f"ts_max({P}, {YEAR})", full("max(x)", YEAR)),
    "ts07_year_min": (f"ts_min({P}, {YEAR})", full("min(x)", YEAR)),
    "ts08_year_sum": (f"ts_sum({P}, {YEAR})", full("sum(x)", YEAR)),
    "ts09_year_rank": (f"ts_rank({P}, {YEAR})", f"case when k = {YEAR} then (len(list_filter(l, lambda e: e < x)) + (len(list_filter(l, lambda e: e = x)) + 1) / 2.0) / {YEAR} end", LONG_LISTS, "q"),
    "ts10_year_argmax": (f"ts_argmax({P}, {YEAR})", f"case when k = {YEAR} then cast(list_position(l, list_max(l)) - 1 as double) end", LONG_LISTS, "q"),
    "ts11_year_argmin": (f"ts_argmin({P}, {YEAR})", f"case when k = {YEAR} then cast(list_position(l, list_min(l)) - 1 as double) end", LONG_LISTS, "q"),
    "ts12_year_corr": (f"ts_corr({P}, {V}, {YEAR})", f"case when count(x) over {frame(YEAR)} = {YEAR} and stddev_samp(x) over {frame(YEAR)} > 0 and stddev_samp(y) over {frame(YEAR)} > 0 then covar_samp(x, y) over {frame(YEAR)} / (stddev_samp(x) over {frame(YEAR)} * stddev_samp(y) over {frame(YEAR)}) end"),
    "ts14_quarter_decay": (f"decay_linear({P}, 60)", decay(60)),
}


def signal_sql(u: str, raw: str) -> str:
    """The signal of a formula: u by ticker from the panel, then its cross-section, winsorised and standardised."""
    return (
        PANEL
        + f""", s1 as (select *, {u} as u from p), s2 as (select *, {raw} as r from s1),
s3 as (select *, case when r is not null then least(greatest(r, quantile_cont(r, 0.01) over ({CS})), quantile_cont(r, 0.99) over ({CS})) end as w from s2),
sig as materialized (select date, ticker, sector, {zscore('w')} as signal from s3 where w is not null)"""
    )


SIGNAL = signal_sql(f"x - lag(x, 20) over ({WT})", f"({pct_rank('u')}) * -1")
CALENDAR = """, cal0 as (select date, cast(last_day(date) - cast(greatest(isodow(last_day(date)) - 5, 0) as integer) as date) as bme from (select distinct date from p)),
cal1 as (select distinct max(date) as date from cal0 where bme <= (select max(date) from p) and date <= bme group by bme),
cal as materialized (select date, lead(date) over (order by date) as next_date from cal1)"""
FORWARD = ", fwd as (select a.date, a.ticker, b.x / a.x - 1 as fwd from cal join p a on a.date = cal.date join p b on b.date = cal.next_date and b.ticker = a.ticker where a.x is not null and b.x is not null)"
PAIRS = """, pr0 as (select sig.*, count(*) over (partition by sig.date) as ns from sig join cal on cal.date = sig.date where next_date is not null),
pr1 as (select pr0.date, pr0.ticker, sector, signal, fwd, count(*) over (partition by pr0.date) as n from pr0 join fwd on fwd.date = pr0.date and fwd.ticker = pr0.ticker where ns >= 20),
pairs as materialized (select * from pr1 where n >= 10)"""


def ranks(keys: str, x: str) -> str:
    return f"rank() over (partition by {keys} order by {x}) + (count(*) over (partition by {keys}, {x}) - 1) / 2.0"


CORR = "case when stddev_samp(a) > 0 and stddev_samp(b) > 0 then covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) end"
IC = f", ic as (select date, {CORR} as ic from (select date, {ranks('date', 'signal')} as a, {ranks('date', 'fwd')} as b from pairs) group by date having {CORR} is not null)"
BINS = """, b0 as (select *, list_sort(list_distinct(quantile_cont(signal, [0.2, 0.4, 0.6, 0.8]) over (partition by date))) as cuts from pairs),
b as materialized (select *, 1 + len(list_filter(cuts, lambda c: c < signal)) as bin, len(cuts) + 1 as k from b0)"""
QS = ", ".join(f"coalesce(avg(case when bin = {i} then fwd end), 0.0) as q{i}" for i in range(1, 6))
PER = f", q as (select date, max(k) as k, count(*) as n, {QS} from b group by date), per as materialized (select q.*, ic, [q1, q2, q3, q4, q5][k] - q1 as port_ret from q join ic on ic.date = q.date)"
PERIODS = CALENDAR + FORWARD + PAIRS + IC + BINS + PER
ALL = SIGNAL + PERIODS
DD = ", eq as (select date, product(1 + port_ret) over (order by date) as equity from per), dd as (select date, equity, equity / max(equity) over (order by date) - 1 as drawdown from eq)"
SHARPE = ", m as (select avg(port_ret) as m, stddev_samp(port_ret) as s, count(*) as n from per), z as (select avg(pow((port_ret - m) / (s + 1e-9), 3)) as skew, avg(pow((port_ret - m) / (s + 1e-9), 4)) as kurt from per, m), sh as (select n, m / (s + 1e-9) * sqrt(12.0) as sharpe, skew, kurt from m, z), dsh as (select *, case when n < 4 then 0.0 else sharpe - sqrt(greatest((1 + 0.5 * sharpe * sharpe - skew * sharpe + ((kurt - 3) / 4) * sharpe * sharpe) / (n - 1), 0.0)) end as deflated_sharpe from sh)"
HELD = ", h as (select b.date, list(ticker) filter (bin = b.k) as top, list(ticker) filter (bin = 1) as bottom from b join per on per.date = b.date group by b.date), t0 as (select date, 'top' as side, top as now, lag(top) over (order by date) as was from h union all select date, 'bottom', bottom, lag(bottom) over (order by date) from h), tv as (select date, side, 1 - len(list_intersect(was, now)) / len(was) as replaced from t0 where len(was) > 0)"
MONO = f", mo as (select date, {CORR} as mono from (select date, {ranks('date', 'i')} as a, {ranks('date', 'r')} as b from (select date, unnest([1, 2, 3, 4, 5]) as i, unnest([q1, q2, q3, q4, q5]) as r from per)) group by date having {CORR} is not null)"


def r6(*names: str) -> list[Column]:
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


class Run:
    """The backtest of a formula over the default panel, step by step."""

    def __init__(self, spark: SparkSession, sf_dir: str, formula: str = REVERSAL):
        self.panel = src.panel_a(spark, sf_dir)
        self.signal = compiler.signal(self.panel, formula)
        self.dates = bt.calendar(self.panel)

    @property
    def pairs(self) -> DataFrame:
        return bt.aligned(self.signal, self.panel, self.dates)

    @property
    def periods(self) -> DataFrame:
        return bt.periods(self.pairs)

    @property
    def index(self) -> DataFrame:
        """A stand-in for an index and a volatility series: mean price and price dispersion by day."""
        return self.panel.groupBy("date").agg(F.round(F.avg("adjusted_price"), 4).alias("index_close"), F.round(F.stddev_samp("adjusted_price"), 4).alias("vol_close")).where("index_close is not null and vol_close is not null")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return bt.metrics(Run(s, d).pairs)


def _turnover(s: SparkSession, d: str) -> DataFrame:
    rows = kept(bt.ranked(Run(s, d).pairs).select("date", "ticker", "fwd", "bin", "k", "rank_signal", "rank_fwd"), shared_folder(s, "turnover"))
    valid = rows.join(F.broadcast(bt.periods_of(rows).select("date")), "date", "left_semi")  # one row a month
    return bt.turnover_of(valid).select("date", "side", *r6("replaced"))


def _strict(s: SparkSession, d: str) -> DataFrame:
    """One sector has no prices, and no signal in odd years: strict periods are those of even years, others keep the priced names."""
    r = Run(s, d)
    signal = r.signal.where("not (sector = 'S3' and year(date) % 2 = 1)")
    prices = r.panel.where("sector != 'S3'")
    strict, loose = (bt.aligned(signal, prices, r.dates, strict=x).groupBy("date").agg(F.count(F.lit(1)).alias(n)) for x, n in ((True, "strict"), (False, "loose")))
    return loose.join(strict, "date", "left")


METRICS_SQL = ALL + DD + SHARPE + HELD + MONO + """ select (select count(*) from per) as n_periods, round((select avg(ic) from per), 4) as IC_mean, round((select avg(ic) / (stddev_samp(ic) + 1e-9) from per), 4) as ICIR,
round((select sharpe from dsh), 4) as sharpe, round((select deflated_sharpe from dsh), 4) as deflated_sharpe, round((select coalesce(avg(mono), 0.0) from mo), 4) as monotonicity,
round((select avg(x) from (select avg(replaced) as x from tv group by side)), 4) as turnover, round((select min(drawdown) from dd), 4) as max_drawdown, round((select avg(port_ret) from per), 4) as Q5_Q1_return,
(select case when sharpe <= 0 then 'high' when deflated_sharpe / sharpe < 0.5 then 'high' when deflated_sharpe / sharpe < 0.75 then 'medium' else 'low' end from dsh) as noise_risk"""
PLACEBO_SQL = (
    SIGNAL
    + CALENDAR
    + FORWARD
    + PAIRS
    + f""", rk as materialized (select date, ticker, {ranks('date', 'signal')} as a, {ranks('date', 'fwd')} as b, row_number() over (partition by date order by ticker) as i from pairs),
sh as (select rk.date, s, a, row_number() over (partition by date, s order by md5('42:' || s || ':' || strftime(date, '%Y-%m-%d') || ':' || ticker), ticker) as i from rk, range(1, 101) t(s)),
nz as (select sh.date, s, abs({CORR.replace('(a', '(sh.a').replace('(b', '(rk.b').replace(', b)', ', rk.b)')}) as r from sh join rk on rk.date = sh.date and rk.i = sh.i group by sh.date, s having count(*) >= 5),
ns as (select avg(r) as noise from (select date, avg(r) as r from nz where r is not null group by date)), mi as (select abs(avg(ic)) as m from (select date, {CORR} as ic from rk group by date))
select round(coalesce(least(greatest(1 - noise / (m + 1e-9), 0.0), 1.0), 0.5), 6) + 0.0 as placebo_score from ns, mi"""
)
#: Twenty formulas of four shapes, with the SQL of their per-ticker value and of their cross-section.
SCREENED = {}
for _n in (20, 30, 40, 60, 90):
    _full = f"case when count(x) over {frame(_n)} = {_n} then {{}} / avg(x) over {frame(_n)} end"
    SCREENED |= {
        f"fall-{_n}": (f"rank(delta(ADJUSTED_PRICE, {_n})) * -1", f"x - lag(x, {_n}) over ({WT})", f"({pct_rank('u')}) * -1"),
        f"below-{_n}": (f"rank(ADJUSTED_PRICE / ts_mean(ADJUSTED_PRICE, {_n})) * -1", _full.format("x"), f"({pct_rank('u')}) * -1"),
        f"flow-{_n}": (f"delta(ADJUSTED_VOLUME, {_n})", f"y - lag(y, {_n}) over ({WT})", "u"),
        f"yield-{_n}": (f"REVENUE_LTM / ts_mean(ADJUSTED_PRICE, {_n})", _full.format("rev"), "u"),
    }


def _screen(s: SparkSession, d: str) -> DataFrame:
    """The metrics of twenty formulas by one plan. Drawdowns of portfolios that lost more than all hang on the last digits and are left out."""
    found = screening.screen(src.panel_a(s, d), {name: formula for name, (formula, _, _) in SCREENED.items()}, digits=9)
    shown = lambda c: F.when(F.abs(c) < (1.5 if c == "max_drawdown" else 1e6), F.round(F.col(c) + 1.3e-6, 4) + 0.0).alias(c)
    return found.select("formula_id", "n_periods", *map(shown, screening.NAMES), "noise_risk")


SCREEN_SQL = " union all ".join(
    f"select '{name}' as formula_id, n_periods, {', '.join(f'case when abs({c}) < {1.5 if c == "max_drawdown" else 1e6} then round({c} + 1.3e-6, 4) + 0.0 end as {c}' for c in screening.NAMES)}, noise_risk from ({METRICS_SQL.replace(ALL, signal_sql(u, raw) + PERIODS).replace(', 4) as ', ', 9) as ')})"
    for name, (_, u, raw) in SCREENED.items()
)
REG = ", ix as (select date, cast(last_day(date) - cast(greatest(isodow(last_day(date)) - 5, 0) as integer) as date) as bme, round(avg(x), 4) as i, round(stddev_samp(x), 4) as v from p group by date having avg(x) is not null and stddev_samp(x) is not null), rg0 as (select bme as date, arg_max(i, date) as i, arg_max(v, date) as v from ix group by bme), reg as (select date, coalesce(i / lag(i, 12) over (order by date) - 1 > 0, false) as bull, v > (select quantile_cont(v, 0.75) from rg0) as high_vol, v < (select quantile_cont(v, 0.25) from rg0) as low_vol from rg0)"

# experiments: metric rows made from part keys by whole-number arithmetic


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def part(a: int, m: int, shift: int, by: float) -> Column:
        return ((k * a) % m - shift) / F.lit(float(by))

    df = src.table(spark, sf_dir, "part").select(
        k.alias("alpha_id"),
        F.when(k % 3 == 0, None).otherwise(F.floor(k / 3)).cast("long").alias("parent_id"),
        ((k * 7919) % 1000003).alias("timestamp"),
        F.when(k % 7 == 0, None).otherwise(F.concat(F.lit("batch"), (k % 5).cast("string"))).alias("batch_id"),
        part(37, 201, 100, 1000).alias("IC_mean"),
        part(53, 401, 200, 100).alias("ICIR"),
        part(71, 601, 300, 100).alias("Sharpe"),
        (part(71, 601, 300, 100) - 0.25).alias("deflated_sharpe"),
        part(29, 201, 100, 100).alias("monotonicity"),
        part(17, 101, 0, 100).alias("turnover"),
        (-part(13, 61, 0, 100)).alias("max_drawdown"),
        part(19, 101, 0, 100).alias("subperiod_stability"),
        part(23, 101, 0, 100).alias("placebo_score"),
        ((k * 5) % 24).cast("int").alias("complexity"),
        part(31, 101, 0, 100).alias("similarity"),
        F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high")]), (k % 3 + 1).cast("int")).alias("noise_risk"),
        F.array(F.concat(F.lit("F"), (k % 11).cast("string")), F.concat(F.lit("F"), (k % 13).cast("string"))).alias("features"),
        F.create_map(F.lit("bull"), part(41, 301, 150, 100), F.lit("bear"), part(43, 301, 150, 100)).alias("regime_sharpe"),
    )
    return sc.scored(df).withColumn("score", F.col("total"))


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"greatest(least(({x} - ({lo})) / ({hi} - ({lo})), 1.0), 0.0)"


def _ramp2(x: str, lo: float, mid: float, hi: float) -> str:
    return f"case when {x} <= {mid} then 0.5 * {_ramp(x, lo, mid)} else 0.5 + 0.5 * {_ramp(x, mid, hi)} end"


def _perf(f: str) -> str:
    g = lambda c: f.format(c)
    return f"0.30 * ({_ramp2(g('IC_mean'), 0.0, 0.02, 0.05)}) + 0.25 * ({_ramp2(g('ICIR'), 0.0, 0.3, 1.0)}) + 0.30 * (0.7 * ({_ramp2(g('Sharpe'), 0.0, 0.5, 1.5)}) + 0.3 * ({_ramp2(g('deflated_sharpe'), 0.0, 0.5, 1.5)})) + 0.15 * ({_ramp2(g('monotonicity'), -0.2, 0.3, 0.8)})"


_TURN = f"case when turnover <= 0.3 then 1.0 when turnover <= 0.7 then 1 - 0.5 * {_ramp('turnover', 0.3, 0.7)} else 0.5 - 0.5 * {_ramp('turnover', 0.7, 0.9)} end"
EXPERIMENTS = f"""with e0 as (
  select p_partkey as alpha_id, case when p_partkey % 3 = 0 then null else p_partkey // 3 end as parent_id, (p_partkey * 7919) % 1000003 as timestamp,
    case when p_partkey % 7 = 0 then null else 'batch' || (p_partkey % 5) end as batch_id, ((p_partkey * 37) % 201 - 100) / 1000.0 as IC_mean, ((p_partkey * 53) % 401 - 200) / 100.0 as ICIR,
    ((p_partkey * 71) % 601 - 300) / 100.0 as Sharpe, ((p_partkey * 71) % 601 - 300) / 100.0 - 0.25 as deflated_sharpe, ((p_partkey * 29) % 201 - 100) / 100.0 as monotonicity,
    ((p_partkey * 17) % 101) / 100.0 as turnover, -((p_partkey * 13) % 61) / 100.0 as max_drawdown, ((p_partkey * 19) % 101) / 100.0 as subperiod_stability, ((p_partkey * 23) % 101) / 100.0 as placebo_score,
    (p_partkey * 5) % 24 as complexity, ((p_partkey * 31) % 101) / 100.0 as similarity, ['low', 'medium', 'high'][p_partkey % 3 + 1] as noise_risk,
    ['F' || (p_partkey % 11), 'F' || (p_partkey % 13)] as features, ((p_partkey * 41) % 301 - 150) / 100.0 as bull, ((p_partkey * 43) % 301 - 150) / 100.0 as bear
  from part),
e1 as (select *, {_perf('{}')} as performance, {_perf('abs({})')} as magnitude, {_TURN} as turnover_score, 0.5 * ({_TURN}) + 0.5 * ({_ramp2('max_drawdown', -0.4, -0.25, -0.1)}) as implementation,
    1 - {_ramp('complexity', 4, 20)} as simplicity, greatest(least(1 - similarity, 1.0), 0.0) as novelty,
    (subperiod_stability + placebo_score + (({_ramp2('bull', -0.5, 0.0, 1.0)}) + ({_ramp2('bear', -0.5, 0.0, 1.0)})) / 2) / 3 as robustness from e0),
e2 as (select *, 100 * (0.65 * performance + 0.2 * implementation + 0.1 * simplicity + 0.05 * novelty) as total, 100 * (0.65 * magnitude + 0.2 * implementation + 0.1 * simplicity + 0.05 * novelty) as predictive_magnitude,
    case when abs(IC_mean) < 0.005 and abs(Sharpe) < 0.1 then 'uncertain' when IC_mean > 0 and Sharpe > 0 then 'supported' when IC_mean < 0 and Sharpe < 0 then 'contradicted' else 'uncertain' end as direction_status,
    (abs(IC_mean) < 0.005 and abs(Sharpe) < 0.1) or max_drawdown <= -0.4 as fatal from e1),
e as (select *, total as score, case when fatal then 'failed' when total >= 65 then 'promising' when total >= 35 then 'revise' else 'failed' end as verdict from e2),
cat as (select *, case when verdict = 'promising' then null when direction_status = 'contradicted' then 'wrong_direction' when turnover > 0.7 then 'high_turnover' when Sharpe < 0 then 'negative_sharpe' when ICIR < 0.3 then 'weak_ic'
    when noise_risk = 'high' then 'high_noise' when subperiod_stability < 0.3 or placebo_score < 0.3 then 'poor_robustness' when simplicity < 0.3 then 'too_complex' when novelty < 0.2 then 'low_novelty' end as category,
    (IC_mean <= -0.005 and Sharpe <= -0.1 and (ICIR <= -0.1 or subperiod_stability >= 0.5)) as stable from e),
ed as (select p.alpha_id as parent, c.alpha_id as child from e c join e p on c.parent_id = p.alpha_id where p.timestamp < c.timestamp),
elig as (select * from cat where (verdict in ('promising', 'revise') and predictive_magnitude >= 35) or (direction_status = 'contradicted' and not fatal and predictive_magnitude >= 50 and stable))"""


#: Experiments of the lifecycle query: id, formula, and its complexity counted by hand; null where it does not run.
LIFECYCLE = [
    ("fall", SCREENED["fall-20"][0], 6), ("flow", SCREENED["flow-30"][0], 3), ("yield", SCREENED["yield-60"][0], 5), ("turned", "rank(delta(ADJUSTED_PRICE, 20))", None),
    ("same", SCREENED["flow-30"][0], None), ("stored", f"-1 * ({SCREENED['yield-40'][0]})", None), ("open", "rank(ADJUSTED_PRICE", None), ("odd", "rank(NO_COLUMN)", None),
]


def _lifecycle(s: SparkSession, d: str) -> DataFrame:
    """A batch of configurations against a store with one record: how far each came, and the scores of those that ran.

    Novelty, and with it the total, is not shown: the similarity to the one record is the same on all tables.
    """
    names = "alpha_id string, formula string, timestamp string, start_date string, end_date string, universe string"
    configs = s.createDataFrame([(n, f, f"t{i}", "1990-01-01", "2009-12-31", "sp500") for i, (n, f, _) in enumerate(LIFECYCLE)], names)
    store = s.createDataFrame([("record", SCREENED["yield-40"][0], [], "t")], experiment.RECORD_SCHEMA)
    r = Run(s, d)
    found = experiment.run(configs, store, r.panel, reg=bt.regimes(r.index), shuffles=2)
    sectors = F.aggregate(F.map_values("sector_ic"), F.lit(0.0), lambda a, v: a + v)
    shown = r6("IC_mean", "performance", "implementation", "simplicity", "subperiod_stability")
    known = F.when(F.col("status") == "completed", F.round(sectors + 1.3e-6, 4) + 0.0).alias("sectors")
    return found.select("alpha_id", "status", "most_similar_id", "n_periods", *shown, known, F.round(F.col("regime_sharpe")["bull"] + 1.3e-6, 4).alias("bull"), "direction_status", "fatal")


def _lifecycle_sql() -> str:
    out = []
    for (name, _, complexity), key in zip(LIFECYCLE[:3], ("fall-20", "flow-30", "yield-60"), strict=True):
        u, raw = SCREENED[key][1:]
        base = signal_sql(u, raw) + PERIODS
        m = METRICS_SQL.replace(ALL, base)
        sub = f"{base}, i as (select ic, row_number() over (order by date) as i, count(*) over () as n from per), h as (select avg(ic) filter (i <= n // 2) as a, avg(ic) filter (i > n // 2) as b, max(n) as n from i) select case when n < 4 then 0.5 else least(greatest(1 - abs(a - b) / (abs(a) + abs(b) + 1e-9), 0.0), 1.0) end as x from h"
        sec = f"{base}, k as (select *, count(*) over (partition by date, sector) as m from pairs), si as (select date, sector, {CORR} as ic from (select date, sector, {ranks('date, sector', 'signal')} as a, {ranks('date, sector', 'fwd')} as b from k where m >= 5) group by date, sector) select sum(ic) as x from (select avg(ic) as ic from si where ic is not null group by sector)"
        bull = f"{base}{REG} select case when count(*) >= 3 then avg(port_ret) / (stddev_samp(port_ret) + 1e-9) * sqrt(12.0) end as x from per join reg on reg.date = per.date where bull"
        dead = "(abs(IC_mean) < 0.005 and abs(Sharpe) < 0.1)"
        out.append(
            f"""select '{name}' as alpha_id, 'completed' as status, 'record' as most_similar_id, n_periods, {r6_sql('IC_mean')}, round({_perf('{}')}, 6) + 0.0 as performance,
round(0.5 * ({_TURN}) + 0.5 * ({_ramp2('max_drawdown', -0.4, -0.25, -0.1)}), 6) + 0.0 as implementation, round(1 - {_ramp(str(complexity), 4, 20)}, 6) + 0.0 as simplicity,
round(case when {dead} then 0.0 else (select x from ({sub})) end, 6) + 0.0 as subperiod_stability, round(case when {dead} then 0.0 else (select x from ({sec})) end + 1.3e-6, 4) + 0.0 as sectors,
case when {dead} then null else round((select x from ({bull})) + 1.3e-6, 4) + 0.0 end as bull,
case when {dead} then 'uncertain' when IC_mean > 0 and Sharpe > 0 then 'supported' when IC_mean < 0 and Sharpe < 0 then 'contradicted' else 'uncertain' end as direction_status, {dead} or max_drawdown <= -0.4 as fatal from ({m})"""
        )
    none = "null, null, null, null, null, null, null, null, null, null"
    for name, status, other in (("turned", "duplicate", "'fall'"), ("same", "duplicate", "'flow'"), ("stored", "duplicate", "'record'"), ("open", "validation_failed", "null"), ("odd", "validation_failed", "null")):
        out.append(f"select '{name}', '{status}', {other}, {none}")
    return " union all ".join(out)


def exp(*columns: str):
    return lambda s, d: experiments(s, d).select("alpha_id", *r6(*columns))


def exp_sql(*columns: str) -> str:
    return f"{EXPERIMENTS} select alpha_id, {r6_sql(*columns)} from e"


def _weak(s: SparkSession, d: str) -> DataFrame:
    return experiments(s, d).select("alpha_id", "weakest", "failure_reason")


def _printed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({x} + 1e-9, {digits}))"


WEAK = "case when least(performance, implementation, simplicity, novelty) = performance then 'performance' when least(performance, implementation, simplicity, novelty) = implementation then 'implementation' when least(performance, implementation, simplicity, novelty) = simplicity then 'simplicity' else 'novelty' end"


def _rings(s: SparkSession, d: str) -> DataFrame:
    return me.layout(me.rings(experiments(s, d))).select("alpha_id", "ring", *r6("x", "y"))


RINGS = """, rn as (select e.alpha_id, e.timestamp, coalesce(dense_rank() over (partition by batch_id is null order by batch_id) - 1, 0) * (case when batch_id is null then 0 else 1 end) as ring from e),
ly as (select alpha_id, ring, 2 * 3.141592653589793 * (row_number() over (partition by ring order by timestamp, alpha_id) - 1) / count(*) over (partition by ring) as angle from rn)"""


def _ancestors(s: SparkSession, d: str) -> DataFrame:
    e = experiments(s, d).select("alpha_id", "parent_id", "timestamp", "score", "predictive_magnitude", "Sharpe")
    return me.ancestors(me.parents(e), me.top_n(e, 20).select("alpha_id"))


def _arms(s: SparkSession, d: str) -> DataFrame:
    return me.arms(experiments(s, d)).select("arm_id", *r6("effective", "alpha", "beta"))


def _reward(s: SparkSession, d: str) -> DataFrame:
    e = experiments(s, d)
    p = e.select(F.col("alpha_id").alias("parent_id"), F.col("predictive_magnitude").alias("base"))
    return e.join(p, "parent_id").select("alpha_id", me.reward(F.col("predictive_magnitude"), F.col("base")).alias("reward")).select("alpha_id", *r6("reward"))


def _replay(s: SparkSession, d: str) -> DataFrame:
    ev = src.table(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("arm_id"), ((F.col("event_id") * 7) % 13 / F.lit(10.0)).alias("reward"))
    priors = s.createDataFrame([(f"u{i}", 1.0 + i / 10, 1.0) for i in range(5)], "arm_id string, alpha double, beta double")
    return me.replay(ev, priors).select("arm_id", *r6("alpha", "beta", "mean"), F.col("pulls").cast("long").alias("pulls"))


def _similarity_sets(s: SparkSession, d: str) -> DataFrame:
    e = experiments(s, d)
    return e.select("alpha_id", F.round(formulas.array_jaccard(F.array_distinct("features"), F.array(F.lit("F1"), F.lit("F2"), F.lit("F3"))), 6).alias("jaccard"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    t = src.table(s, d, "part").select("p_partkey", F.regexp_extract_all(F.concat("p_name", F.lit(" * 2x_"), "p_brand"), F.lit(f"({formulas.TOKEN})"), F.lit(1)).alias("t"))
    return t.select("p_partkey", F.array_join(F.array_sort(F.array_distinct("t")), ",").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


# sources and panel ETL


def _panel(s: SparkSession, d: str) -> DataFrame:
    p = src.panel_a(s, d)
    return p.groupBy("date").agg(*[F.round(F.sum(c) + 1.23457e-5, 2).alias(c) for c in src.VALUES], F.count("adjusted_price").alias("n"))


def _etl_digest(value):
    return lambda s, d: digest(value(src.panel_a(s, d)))


def _etl14(s: SparkSession, d: str) -> DataFrame:
    line = src.table(s, d, "lineitem").select(F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("seq"), "l_quantity")
    return src.keep_last(line, ["ticker", "date"], "seq").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def _etl15(s: SparkSession, d: str) -> DataFrame:
    """A statement of returned lines and one of open lines: suppliers and days that one or both have."""
    line = src.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("ticker"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    a = line.where("l_returnflag != 'A'").groupBy("date", "ticker").agg(F.sum("l_quantity").alias("REVENUE_LTM"))
    b = line.where("l_linestatus = 'O'").groupBy("date", "ticker").agg(F.max("l_quantity").alias("CFO_LTM"), F.lit(0.0).alias("REVENUE_LTM"))
    x = src.full_statements(a, b)
    return x.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count("REVENUE_LTM").alias("a"), F.count("CFO_LTM").alias("b"), F.sum("REVENUE_LTM").alias("revenue"), F.sum("CFO_LTM").alias("cash"))


def _etl16(s: SparkSession, d: str) -> DataFrame:
    p = src.panel_b(s, d)
    return p.where("adjusted_price is not null").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("adjusted_price"), 3).alias("price"))


def _etl18(s: SparkSession, d: str) -> DataFrame:
    """Fundamentals of all days, prices of filled lines only: their days are the trading days."""
    day = src.daily(s, d)
    fundamentals = src.densify(src.statements(day), ["revenue_ltm"])
    line = src.table(s, d, "lineitem").where("l_linestatus = 'F'").join(src.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    prices = line.select(F.to_date("l_shipdate").alias("date"), F.col("p_size").alias("ticker"), F.col("l_extendedprice").alias("adjusted_price"), F.col("l_quantity").alias("adjusted_volume"))
    universe = day.select("ticker").distinct().withColumn("sector", F.concat(F.lit("S"), (F.col("ticker") % 5).cast("string")))
    x = src.assemble(fundamentals, prices, universe)
    return x.groupBy("ticker", "sector").agg(F.count(F.lit(1)).alias("n"), F.count("adjusted_price").alias("prices"), F.round(F.sum("adjusted_volume") + 1e-4, 3).alias("volume"))


def _etl13(s: SparkSession, d: str) -> DataFrame:
    st = src.statements(src.daily(s, d))
    return src.seed(st, "1997-06-02", "1997-12-31", ["revenue_ltm"]).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("revenue_ltm") + 1.23457e-5, 2).alias("rev"))


def _io03(s: SparkSession, d: str) -> DataFrame:
    """Wide prices unpivoted, joined with volumes, missing dropped. The tickers are those of the data, of which a wide table holds a bounded number."""
    day = src.daily(s, d)
    tickers = sorted(r.ticker for r in day.select("ticker").distinct().limit(5001).collect())
    if len(tickers) > 5000:
        raise ValueError("too many tickers for a wide table: give prices as rows")
    wide = day.groupBy("date").pivot("ticker", tickers).agg(F.first("price"))
    price = wide.unpivot("date", [str(t) for t in tickers], "ticker", "adjusted_price")
    volume = day.select("date", F.col("ticker").cast("string").alias("ticker"), F.col("volume").alias("adjusted_volume"))
    x = price.join(volume, ["date", "ticker"]).dropna("any", subset=["adjusted_price", "adjusted_volume"])
    return x.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("adjusted_price") + 1.23457e-5, 2).alias("price"), F.sum("adjusted_volume").alias("volume"))


def _io05(s: SparkSession, d: str) -> DataFrame:
    """Columns that miss more and more values: those that miss more than a thousand go."""
    line = src.table(s, d, "lineitem").select("l_orderkey", *[F.when(F.col("l_quantity") > q, F.col("l_extendedprice")).alias(f"over_{q}") for q in range(0, 50, 5)], F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("tax"))
    kept = src.drop_sparse(line, [c for c in line.columns if c != "l_orderkey"])
    return s.createDataFrame([(c,) for c in sorted(kept.columns)], "column_name string")


IO05 = " union all ".join([f"select 'over_{q}' as column_name, count(*) filter (l_quantity <= {q}) as gone from lineitem" for q in range(0, 50, 5)] + ["select 'tax', count(*) filter (l_returnflag <> 'R') from lineitem", "select 'l_orderkey', 0"])


def _io09(s: SparkSession, d: str) -> DataFrame:
    """Three batches of orders' states, keyed by customer: the newest wins."""
    o = src.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return me.newest(o, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", *[F.round("o_totalprice", 2).alias("o_totalprice")])


def _io13(s: SparkSession, d: str) -> DataFrame:
    e = src.table(s, d, "events").select(F.get(F.split("event_type", "_"), F.lit(0)).alias("kind"), F.from_json("props", "k int").alias("p"))
    back = e.select("kind", F.get_json_object(F.to_json("p"), "$.k").cast("long").alias("k"))
    return back.groupBy("kind").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))


def _rollup(s: SparkSession, d: str) -> DataFrame:
    x = bt.sector_ic(Run(s, d).pairs).withColumn("year", F.year("date"))
    return x.rollup("sector", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ic"), 6).alias("ic"))


def queries() -> dict:
    out = {
        "flagship_slice": lambda s, d: Run(s, d, SLICE).periods.select("date", "n", *r6("ic", "port_ret")),
        "io01_panel_load": _panel,
        "io03_price_source": _io03,
        "io05_sparse_drop": _io05,
        "io09_store_upsert": _io09,
        "io13_json_columns": _io13,
        "io16_stream_equals_batch": streaming.hourly,
        "etl04_dates_with_values": lambda s, d: digest(src.panel_a(s, d).withColumn("k", F.count("adjusted_price").over(Window.partitionBy("date"))).where("k > 0").withColumn("v", F.col("adjusted_price"))),
        "etl05_winsorise": _etl_digest(lambda p: p.withColumn("v", compiler.winsorise(F.col("adjusted_price")))),
        "etl06_standardise": _etl_digest(lambda p: p.withColumn("v", compiler.standardise(F.col("adjusted_volume")))),
        "etl09_drop_incomplete": lambda s, d: src.clean_process(src.panel_a(s, d), src.VALUES).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date")),
        "etl10_business_days": lambda s, d: src.business_days(src.daily(s, d)),
        "etl11_forward_fill": _etl_digest(lambda p: p.withColumn("v", F.col("adjusted_volume"))),
        "etl13_lookback_seed": _etl13,
        "etl14_keep_last": _etl14,
        "etl15_statement_join": _etl15,
        "etl16_sector_lookup": _etl16,
        "etl18_assemble": _etl18,
        "ex07_signal": lambda s, d: digest(Run(s, d).signal.withColumn("v", F.col("signal"))),
        "ex08_single_date": lambda s, d: compiler.on_date(src.panel_a(s, d), "rank(ADJUSTED_PRICE) + scale(ADJUSTED_VOLUME)", "1997-06-30").select("ticker", *r6("value")),
        "bt01_calendar": lambda s, d: Run(s, d).dates,
        "bt02_forward_returns": lambda s, d: digest(bt.forward_returns((r := Run(s, d)).panel, r.dates).withColumn("v", F.col("fwd"))),
        "bt03_period_gates": lambda s, d: Run(s, d).pairs.groupBy("date").agg(F.count(F.lit(1)).alias("n")),
        "bt02b_strict_periods": _strict,
        "bt04_rank_ic": lambda s, d: bt.ic(Run(s, d).pairs).select("date", *r6("ic")),
        "bt05_sector_ic": lambda s, d: bt.sector_ic(Run(s, d).pairs).select("date", "sector", *r6("ic")),
        "bt08_bins": lambda s, d: bt.binned(Run(s, d).pairs).groupBy("date", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("ticker").alias("tickers"), F.max("k").cast("long").alias("k")),
        "bt09_bin_returns": lambda s, d: bt.bin_returns(Run(s, d).pairs).select("date", *r6("q1", "q2", "q3", "q4", "q5", "port_ret")),
        "bt12_metrics": _metrics,
        "bt_screen": _screen,
        "experiment_batch": _lifecycle,
        "bt15_drawdown": lambda s, d: bt.drawdown(Run(s, d).periods).select("date", F.signum("equity").alias("side"), F.ln(F.abs("equity")).alias("log_equity"), (F.col("drawdown") / (1 + F.abs("drawdown"))).alias("depth")).select("date", "side", *r6("log_equity", "depth")),
        "bt16_deflated_sharpe": lambda s, d: bt.deflated(Run(s, d).periods).select("n", *r6("sharpe", "deflated_sharpe", "skew", "kurt")),
        "bt17_turnover": _turnover,
        "bt18_monotonicity": lambda s, d: bt.monotonicity(Run(s, d).periods).select("date", *r6("mono")),
        "rb01_sector_stability": lambda s, d: bt.sector_ic(Run(s, d).pairs).groupBy("sector").agg(F.round(F.avg("ic"), 4).alias("ic")),
        "rb02_subperiod_stability": lambda s, d: bt.subperiod_stability(Run(s, d).periods).select(*r6("subperiod_stability")),
        "rb05_regimes": lambda s, d: bt.regimes(Run(s, d).index),
        "rb06_regime_sharpe": lambda s, d: bt.regime_sharpe((r := Run(s, d)).periods, bt.regimes(r.index)).select("regime", "n", *r6("sharpe")),
        "rb07_placebo": lambda s, d: bt.placebo_exact(Run(s, d).pairs).select(*r6("placebo_score")),
        "sc03_performance": exp("performance"),
        "sc05_implementation": exp("implementation"),
        "sc04_turnover_score": lambda s, d: experiments(s, d).select("alpha_id", sc.turnover_score(F.col("turnover")).alias("turnover_score")).select("alpha_id", *r6("turnover_score")),
        "sc06_robustness": lambda s, d: experiments(s, d).select("alpha_id", sc.robustness().alias("robustness")).select("alpha_id", *r6("robustness")),
        "sc07_simplicity": exp("simplicity"),
        "sc08_novelty": exp("novelty"),
        "sc09_composite": exp("total"),
        "sc10_magnitude": exp("predictive_magnitude"),
        "sc11_direction": lambda s, d: experiments(s, d).select("alpha_id", "direction_status", "fatal", "verdict"),
        "sc14_weakest": _weak,
        "sc15_tier_gates": lambda s, d: experiments(s, d).select("alpha_id", sc.tier_gates()[0].alias("tier1"), sc.tier_gates()[1].alias("tier2")),
        "sm01_tokens": _tokens,
        "sm05_set_jaccard": _similarity_sets,
        "me01_effective_score": lambda s, d: experiments(s, d).select("alpha_id", me.effective_score().alias("effective"), me.stable_contradiction().alias("stable")).select("alpha_id", *r6("effective"), "stable"),
        "me04_failure_category": lambda s, d: experiments(s, d).select("alpha_id", me.failure_category().alias("category")),
        "me05_counts": lambda s, d: me.counts(experiments(s, d), "verdict"),
        "me06_best": lambda s, d: me.best(experiments(s, d)).select("alpha_id", *r6("effective")),
        "me07_recent": lambda s, d: me.recent(experiments(s, d)).select("alpha_id", "timestamp"),
        "me08_unexplored": lambda s, d: me.unexplored(experiments(s, d), [f"F{i}" for i in range(25)]),
        "ba01_eligible": lambda s, d: experiments(s, d).where(me.eligible()).select("alpha_id"),
        "ba02_arms": _arms,
        "ba05_reward": _reward,
        "ba06_replay": _replay,
        "gr01_edges": lambda s, d: me.edges(experiments(s, d)),
        "gr02_filters": lambda s, d: experiments(s, d).where("verdict in ('promising', 'revise') and timestamp >= 500000 and batch_id = 'batch2'").select("alpha_id"),
        "gr03_top_n": lambda s, d: me.top_n(experiments(s, d), 25).select("alpha_id"),
        "gr04_ancestors": _ancestors,
        "gr05_layout": _rings,
        "gr07_summary": lambda s, d: experiments(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("Sharpe"), 4).alias("best_sharpe"), F.round(F.max("IC_mean"), 4).alias("best_ic")),
        "rollup_sector_year": _rollup,
        "st_windows": streaming.windows,
        "st_sessions": streaming.sessions,
        "st_interval_join": attribution.clicks_before_purchases,
        "st_running_ic": coefficients.running_ic,
        "st_keyed_sink": sink.users,
    }
    return out | {k: panel_query(v[0]) for k, v in FORMULAS.items()}


def oracle_sql() -> dict[str, str]:
    ex = EXPERIMENTS
    out = {
        "flagship_slice": f"{signal_sql('case when count(x) over ' + frame(20) + ' = 20 then x / avg(x) over ' + frame(20) + ' end', '(' + pct_rank('u') + ') * -1')}{PERIODS} select date, n, {r6_sql('ic', 'port_ret')} from per",
        "io01_panel_load": f"{PANEL} select date, round(sum(x) + 1.23457e-5, 2) as adjusted_price, round(sum(y) + 1.23457e-5, 2) as adjusted_volume, round(sum(rev) + 1.23457e-5, 2) as revenue_ltm, round(sum(cogs) + 1.23457e-5, 2) as cogs_ltm, round(sum(tax) + 1.23457e-5, 2) as income_tax_ltm, round(sum(sh) + 1.23457e-5, 2) as shares_basic, count(x) as n from p group by date",
        "io03_price_source": f"with {DAILY} select cast(ticker as varchar) as ticker, count(*) as n, round(sum(price) + 1.23457e-5, 2) as price, sum(volume) as volume from daily group by ticker",
        "io05_sparse_drop": f"select column_name from ({IO05}) where gone <= 1000",
        "io09_store_upsert": "select o_custkey, max(o_orderkey) as o_orderkey, round(arg_max(o_totalprice, o_orderkey), 2) as o_totalprice from orders group by o_custkey",
        "io13_json_columns": "select split_part(event_type, '_', 1) as kind, sum(cast(json_extract(props, '$.k') as bigint)) as k, count(*) as n from events group by 1",
        "io16_stream_equals_batch": streaming.HOURLY_SQL,
        "st_windows": streaming.WINDOWS_SQL,
        "st_sessions": streaming.SESSIONS_SQL,
        "st_interval_join": attribution.SQL,
        "st_running_ic": coefficients.SQL,
        "st_keyed_sink": sink.SQL,
        "etl04_dates_with_values": panel_sql("x"),
        "etl05_winsorise": panel_sql(f"case when x is not null then least(greatest(x, quantile_cont(x, 0.01) over ({CS})), quantile_cont(x, 0.99) over ({CS})) end"),
        "etl06_standardise": panel_sql(zscore("y")),
        "etl09_drop_incomplete": f"{PANEL} select ticker, count(*) as n, min(date) as first_date from p where x is not null and y is not null and rev is not null and cogs is not null and tax is not null and sh is not null group by ticker",
        "etl10_business_days": f"{PANEL} select date from days",
        "etl11_forward_fill": panel_sql("y"),
        "etl13_lookback_seed": f"with {DAILY}, st as (select date, ticker, round(sum(revenue) over (partition by ticker order by date range between interval 364 days preceding and current row) + 1.3e-4, 2) as rev from daily), cut as (select * from st where date >= date '1996-06-02' and date <= date '1997-12-31'), days as (select cast(d as date) as date from (select unnest(generate_series((select min(date) from cut), (select max(date) from cut), interval 1 day)) as d) where isodow(d) < 6), g as (select days.date, t.ticker, last_value(rev ignore nulls) over (partition by t.ticker order by days.date rows between unbounded preceding and current row) as rev from days cross join (select distinct ticker from cut) t left join cut on cut.date = days.date and cut.ticker = t.ticker) select date, count(*) as n, round(sum(rev) + 1.23457e-5, 2) as rev from g where date >= date '1997-06-02' and rev is not null group by date",
        "etl14_keep_last": "with r as (select l_partkey, cast(l_shipdate as date) as date, l_quantity, row_number() over (partition by l_partkey, cast(l_shipdate as date) order by l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_quantity desc) as nr from lineitem) select date, count(*) as n, round(sum(l_quantity), 2) as q from r where nr = 1 group by date",
        "etl15_statement_join": "with l as (select cast(l_shipdate as date) as date, l_suppkey as ticker, * from lineitem), a as (select date, ticker, sum(l_quantity) as revenue from l where l_returnflag <> 'A' group by 1, 2), b as (select date, ticker, max(l_quantity) as cash from l where l_linestatus = 'O' group by 1, 2) select ticker, count(*) as n, count(revenue) as a, count(cash) as b, sum(revenue) as revenue, sum(cash) as cash from a full join b using (date, ticker) group by ticker",
        "etl16_sector_lookup": "with day as (select cast(l_shipdate as date) as date, l_suppkey as ticker, round(avg(l_extendedprice / l_quantity) + 1.3e-6, 4) as price from lineitem where isodow(l_shipdate) < 6 group by 1, 2), days as (select cast(d as date) as date from (select unnest(generate_series((select min(date) from day), (select max(date) from day), interval 1 day)) as d) where isodow(d) < 6), g as (select days.date, t.ticker, last_value(price ignore nulls) over (partition by t.ticker order by days.date rows between unbounded preceding and current row) as x from days cross join (select distinct ticker from day) t left join day on day.date = days.date and day.ticker = t.ticker) select 'S' || n_regionkey as sector, count(*) as n, round(avg(x), 3) as price from g join supplier on s_suppkey = ticker join nation on s_nationkey = n_nationkey where x is not null group by 1",
        "etl18_assemble": f"{PANEL}, px as (select cast(l_shipdate as date) as date, p_size as ticker, avg(l_extendedprice) as price, avg(l_quantity) as volume from lineitem join part on l_partkey = p_partkey where l_linestatus = 'F' group by 1, 2) select p.ticker, p.sector, count(*) as n, count(price) as prices, round(sum(volume) + 1e-4, 3) as volume from p left join px on px.date = p.date and px.ticker = p.ticker where p.date in (select date from px) group by 1, 2",
        "ex07_signal": f"{SIGNAL}, v as (select date, ticker, signal as v from sig) {DIGEST}",
        "ex08_single_date": f"{PANEL}, o as (select * from p where date = date '1997-06-30'), v as (select ticker, ({pct_rank('x')}) + case when max(y) over () > min(y) over () then (y - min(y) over ()) / (max(y) over () - min(y) over ()) end as value from o) select ticker, {r6_sql('value')} from v where value is not null",
        "bt01_calendar": f"{PANEL}{CALENDAR} select * from cal",
        "bt02_forward_returns": f"{PANEL}{CALENDAR}{FORWARD}, v as (select date, ticker, fwd as v from fwd) {DIGEST}",
        "bt03_period_gates": f"{ALL} select date, count(*) as n from pairs group by date",
        "bt02b_strict_periods": f"{SIGNAL}{CALENDAR}{FORWARD}, sg as (select * from sig where not (sector = 'S3' and year(date) % 2 = 1)), pr0 as (select sg.date, sg.ticker, count(*) over (partition by sg.date) as ns from sg join cal on cal.date = sg.date where next_date is not null), pr1 as (select pr0.date, count(*) as n from pr0 join fwd on fwd.date = pr0.date and fwd.ticker = pr0.ticker where ns >= 20 and pr0.ticker % 5 <> 3 group by pr0.date) select date, n as loose, case when date not in (select date from sg where sector = 'S3') then n end as strict from pr1 where n >= 10",
        "bt04_rank_ic": f"{ALL} select date, {r6_sql('ic')} from ic",
        "bt05_sector_ic": f"{ALL}, k as (select *, count(*) over (partition by date, sector) as m from pairs) select date, sector, round({CORR}, 6) + 0.0 as ic from (select date, sector, {ranks('date, sector', 'signal')} as a, {ranks('date, sector', 'fwd')} as b from k where m >= 5) group by date, sector having {CORR} is not null",
        "bt08_bins": f"{ALL} select date, bin, count(*) as n, sum(ticker) as tickers, max(k) as k from b group by date, bin",
        "bt09_bin_returns": f"{ALL} select date, {r6_sql('q1', 'q2', 'q3', 'q4', 'q5')}, round([q1, q2, q3, q4, q5][k] - q1, 6) + 0.0 as port_ret from q",
        "bt12_metrics": METRICS_SQL,
        "rb07_placebo": PLACEBO_SQL,
        "bt_screen": SCREEN_SQL,
        "experiment_batch": _lifecycle_sql(),
        "bt15_drawdown": f"{ALL}{DD} select date, sign(equity)::double as side, round(ln(abs(equity)), 6) + 0.0 as log_equity, round(drawdown / (1 + abs(drawdown)), 6) + 0.0 as depth from dd",
        "bt16_deflated_sharpe": f"{ALL}{SHARPE} select n, {r6_sql('sharpe', 'deflated_sharpe', 'skew', 'kurt')} from dsh",
        "bt17_turnover": f"{ALL}{HELD} select date, side, {r6_sql('replaced')} from tv",
        "bt18_monotonicity": f"{ALL}{MONO} select date, {r6_sql('mono')} from mo",
        "rb01_sector_stability": f"{ALL}, k as (select *, count(*) over (partition by date, sector) as m from pairs), si as (select date, sector, {CORR} as ic from (select date, sector, {ranks('date, sector', 'signal')} as a, {ranks('date, sector', 'fwd')} as b from k where m >= 5) group by date, sector) select sector, round(avg(ic), 4) as ic from si where ic is not null group by sector",
        "rb02_subperiod_stability": f"{ALL}, i as (select ic, row_number() over (order by date) as i, count(*) over () as n from per), h as (select avg(ic) filter (i <= n // 2) as a, avg(ic) filter (i > n // 2) as b, max(n) as n from i) select round(case when n < 4 then 0.5 else least(greatest(1 - abs(a - b) / (abs(a) + abs(b) + 1e-9), 0.0), 1.0) end, 6) + 0.0 as subperiod_stability from h",
        "rb05_regimes": f"{PANEL}{REG} select date, bull, high_vol, low_vol, not high_vol and not low_vol as neutral_vol from reg",
        "rb06_regime_sharpe": f"{ALL}{REG}, f as (select port_ret, unnest(['bull', 'bear', 'high_vol', 'low_vol', 'neutral_vol']) as regime, unnest([bull, not bull, high_vol, low_vol, not high_vol and not low_vol]) as flag from per join reg on reg.date = per.date) select regime, count(*) as n, round(avg(port_ret) / (stddev_samp(port_ret) + 1e-9) * sqrt(12.0), 6) + 0.0 as sharpe from f where flag group by regime having count(*) >= 3",
        "sc03_performance": exp_sql("performance"),
        "sc04_turnover_score": exp_sql("turnover_score"),
        "sc05_implementation": exp_sql("implementation"),
        "sc06_robustness": exp_sql("robustness"),
        "sc07_simplicity": exp_sql("simplicity"),
        "sc08_novelty": exp_sql("novelty"),
        "sc09_composite": exp_sql("total"),
        "sc10_magnitude": exp_sql("predictive_magnitude"),
        "sc11_direction": f"{ex} select alpha_id, direction_status, fatal, verdict from e",
        "sc14_weakest": f"""{ex}, w as (select *, {WEAK} as weakest from e)
select alpha_id, weakest, case when fatal then 'fatal: ' || concat_ws('; ', case when abs(IC_mean) < 0.005 and abs(Sharpe) < 0.1 then 'dead signal, IC ' || {_printed('IC_mean', 4)} || ', Sharpe ' || {_printed('Sharpe', 4)} end, case when max_drawdown <= -0.4 then 'drawdown ' || {_printed('max_drawdown', 4)} end)
  when verdict <> 'promising' then 'score ' || {_printed('total', 1)} || ', weakest ' || weakest || ' ' || {_printed("case weakest when 'performance' then performance when 'implementation' then implementation when 'simplicity' then simplicity else novelty end", 2)} || case weakest when 'simplicity' then ', complexity ' || complexity when 'novelty' then ', similarity ' || {_printed('similarity', 2)} else '' end end
  || case when direction_status = 'contradicted' then '; direction contradicted, magnitude ' || {_printed('predictive_magnitude', 1)} || ' against ' || {_printed('total', 1)} else '' end as failure_reason from w""",
        "sc15_tier_gates": f"{ex} select alpha_id, case when IC_mean <= 0 or ICIR <= 0 or monotonicity <= -0.2 then 'failed' when IC_mean <= 0.02 or ICIR <= 0.3 or monotonicity <= 0.3 then 'revise' else 'promising' end as tier1, case when Sharpe <= 0 or max_drawdown <= -0.4 then 'failed' when Sharpe <= 0.5 or turnover >= 0.7 or max_drawdown <= -0.25 then 'revise' else 'promising' end as tier2 from e",
        "sm01_tokens": "with t as (select p_partkey, regexp_extract_all(p_name || ' * 2x_' || p_brand, '[A-Za-z_][A-Za-z0-9_]*') as t from part) select p_partkey, array_to_string(list_sort(list_distinct(t)), ',') as tokens, len(t) as n_tokens from t",
        "sm05_set_jaccard": f"{ex} select alpha_id, round(len(list_intersect(list_distinct(features), ['F1', 'F2', 'F3'])) / len(list_distinct(features || ['F1', 'F2', 'F3'])), 6) as jaccard from e",
        "me01_effective_score": f"{ex} select alpha_id, round(predictive_magnitude, 6) + 0.0 as effective, stable from cat",
        "me04_failure_category": f"{ex} select alpha_id, category from cat",
        "me05_counts": f"{ex} select verdict, count(*) as n from e group by verdict",
        "me06_best": f"{ex} select alpha_id, round(predictive_magnitude, 6) + 0.0 as effective from e where verdict = 'promising' order by predictive_magnitude desc, timestamp limit 3",
        "me07_recent": f"{ex} select alpha_id, timestamp from e order by timestamp desc limit 30",
        "me08_unexplored": f"{ex} select 'F' || i as feature from range(25) t(i) where 'F' || i not in (select unnest(features) from e)",
        "ba01_eligible": f"{ex} select alpha_id from elig",
        "ba02_arms": f"{ex} select alpha_id as arm_id, round(predictive_magnitude, 6) + 0.0 as effective, round(1 + predictive_magnitude / 100, 6) + 0.0 as alpha, 1.0::double as beta from elig order by predictive_magnitude desc, alpha_id limit 5",
        "ba05_reward": f"{ex} select c.alpha_id, round(greatest(least(0.5 + (c.predictive_magnitude - p.predictive_magnitude) / 50, 1.0), 0.0), 6) + 0.0 as reward from e c join e p on c.parent_id = p.alpha_id",
        "ba06_replay": "with r as (select 'u' || (user_id % 5) as arm_id, least(((event_id * 7) % 13) / 10.0, 1.0) as r from events), t as (select arm_id, sum(r) as up, sum(1 - r) as down, count(*) as pulls from r group by arm_id), q as (select 'u' || i as arm_id, 1.0 + i / 10 + coalesce(up, 0) as alpha, 1.0 + coalesce(down, 0) as beta, coalesce(pulls, 0) as pulls from range(5) g(i) left join t on t.arm_id = 'u' || i) select arm_id, round(alpha, 6) + 0.0 as alpha, round(beta, 6) + 0.0 as beta, round(alpha / (alpha + beta), 6) + 0.0 as mean, pulls from q",
        "gr01_edges": f"{ex} select parent, child from ed",
        "gr02_filters": f"{ex} select alpha_id from e where verdict in ('promising', 'revise') and timestamp >= 500000 and batch_id = 'batch2'",
        "gr03_top_n": f"{ex} select alpha_id from e order by predictive_magnitude desc, timestamp limit 25",
        "gr04_ancestors": f"with recursive {ex.removeprefix('with ')}, up as (select alpha_id from (select alpha_id from e order by predictive_magnitude desc, timestamp limit 20) union select p.alpha_id from up join e c on c.alpha_id = up.alpha_id join e p on p.alpha_id = c.parent_id) select alpha_id from up",
        "gr05_layout": f"{ex}{RINGS} select alpha_id, ring, round((100 + 160 * ring) * cos(angle), 6) + 0.0 as x, round((100 + 160 * ring) * sin(angle), 6) + 0.0 as y from ly",
        "gr07_summary": f"{ex} select verdict, count(*) as n, round(max(Sharpe), 4) as best_sharpe, round(max(IC_mean), 4) as best_ic from e group by verdict",
        "rollup_sector_year": f"{ALL}, k as (select *, count(*) over (partition by date, sector) as m from pairs), si as (select date, sector, {CORR} as ic from (select date, sector, {ranks('date, sector', 'signal')} as a, {ranks('date, sector', 'fwd')} as b from k where m >= 5) group by date, sector) select sector, year(date) as year, count(*) as n, round(avg(ic), 6) as ic from si where ic is not null group by rollup (sector, year(date))",
    }
    return out | {k: panel_sql(*v[1:]) for k, v in FORMULAS.items()}


