"""Queries of sources, sinks, panel preparation and relational building blocks, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import registry
from panelforge.functions.tables import shared_folder
from panelforge.operators import backtest as bt
from panelforge.operators import memory as me
from panelforge.operators import segments, sketches
from panelforge.plans import compiler
from panelforge.queries import DIGEST, PANEL, digest, r6
from panelforge.sources import chunks, loader, years
from panelforge.sources import panel as src

# sources


def _nation_page(s: SparkSession, d: str) -> DataFrame:
    """One html page with a table of nations: symbols with dots, region names with references."""
    n = src.table(s, d, "nation").join(src.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("n_nationkey").cast("string")), cell(F.concat(F.lit("<a href='#'>"), F.col("n_name"), F.lit("."), F.col("n_nationkey").cast("string"), F.lit("</a>"))), cell(F.concat("r_name", F.lit(" &amp; more"))), F.lit("</tr>\n"))
    body = n.select(row.alias("row"), "n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "").alias("rows"))  # 25 nations
    head = "<html><p>Symbol</p><table class='x'><tr><th>Key</th><th>Symbol</th><th>GICS Sector</th></tr>\n"
    return body.select(F.concat(F.lit(head), "rows", F.lit("</table><table><tr><td>other</td></tr></table></html>")).alias("html"))


def _universe(s: SparkSession, d: str) -> DataFrame:
    return loader.universe_from_html(_nation_page(s, d))


UNIVERSE_SQL = "select n_name || '-' || n_nationkey as \"TICKER\", r_name || ' & more' as \"SECTOR\", 'US' as \"COUNTRY\" from nation join region on n_regionkey = r_regionkey"


def _cached_load(s: SparkSession, d: str) -> DataFrame:
    """What each of four loads reads from its sources: all, nothing, all again once one table is gone, all without the cache."""
    line = src.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("DATE"), F.col("l_suppkey").cast("string").alias("TICKER"), "l_quantity")

    def of(tickers, start, end):
        return line.join(tickers, "TICKER", "left_semi").where(F.col("DATE").between(start, end))

    sources = {"universe": lambda: src.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("TICKER")), "prices": of, "income_ttm": of, "cashflow_ttm": of}
    cache, span, out = loader.Loader(s, shared_folder(s, "cache"), sources), ("1995-01-01", "1996-12-31"), []
    for step in ("first", "cached", "one missing", "no cache"):
        before = cache.fetched
        cache.use_cache = step != "no cache"
        if step == "one missing":
            cache.forget("income_ttm", *span)
        frames = cache.load(*span)
        out.append((step, cache.fetched - before, frames["prices"].count(), frames["universe"].count()))
    return s.createDataFrame(out, "step string, fetched long, prices long, universe long")


CACHED_SQL = "select step, fetched, (select count(*) from lineitem where cast(l_shipdate as date) between date '1995-01-01' and date '1996-12-31') as prices, (select count(*) from supplier) as universe from (values ('first', 4), ('cached', 0), ('one missing', 4), ('no cache', 4)) t(step, fetched)"


def _delivered(s: SparkSession, d: str) -> DataFrame:
    """Daily prices of suppliers, delivered in three lots of years: read whole, by tickers and days, and as a stream; the months' sums of each."""
    day = F.to_date("l_shipdate").alias("date")
    line = src.table(s, d, "lineitem").groupBy(day, F.lpad((F.col("l_suppkey") % 1000).cast("string"), 4, "0").alias("ticker"))
    prices = line.agg(F.max(F.when(F.col("l_quantity") > 3, F.col("l_extendedprice"))).alias("close"), F.sum(F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))).alias("volume"))
    at = shared_folder(s, "prices")
    for first, last in ((1900, 1993), (1994, 1995), (1996, 2100)):
        chunks.deliver(prices.where(F.year("date").between(first, last)), f"{at}/in", 250)
    q = chunks.stream(s, f"{at}/in").writeStream.format("parquet").option("checkpointLocation", f"{at}/mark").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    wanted = [f"{i:04d}" for i in range(0, 1000, 3)]
    some = chunks.read(s, f"{at}/in", wanted, "1993-05-01", "1996-02-15")
    parts = {"whole": chunks.read(s, f"{at}/in"), "some": some, "stream": s.read.schema(chunks.SCHEMA).parquet(f"{at}/out")}
    out = None
    for name, df in parts.items():
        x = df.groupBy(F.lit(name).alias("way"), F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.round(F.sum("close") + 1e-4, 2).alias("close"), F.sum("volume").alias("volume"))
        out = x if out is None else out.unionByName(x)
    return out


DELIVERED_SQL = (
    "with p as (select l_shipdate::date as date, lpad((l_suppkey % 1000)::varchar, 4, '0') as ticker, max(case when l_quantity > 3 then l_extendedprice end)::double as close, sum(case when l_linenumber < 7 then l_quantity end)::double as volume from lineitem group by 1, 2), "
    "g as (select * from p where close is not null and volume is not null), a as (select 'whole' as way, * from g union all select 'stream', * from g union all select 'some', * from g where ticker::int % 3 = 0 and date between date '1993-05-01' and date '1996-02-15') "
    "select way, strftime(date, '%Y-%m') as month, count(*) as n, count(distinct ticker) as tickers, round(sum(close) + 1e-4, 2) as close, sum(volume) as volume from a group by 1, 2"
)
#: Spans that are loaded one after the other.
SPANS = [("1994-03-01", "1995-06-30"), ("1994-01-01", "1995-12-31"), ("1993-05-01", "1997-02-01"), ("1992-01-01", "1998-12-31"), ("1995-06-01", "1995-08-31")]


def _cache_by_year(s: SparkSession, d: str) -> DataFrame:
    """For each of five spans: the years fetched for it, the partitions of years that its scan read, and its rows."""
    line, orders = src.table(s, d, "lineitem"), src.table(s, d, "orders")

    def of(df: DataFrame, day: str):
        return lambda start, end: df.where(F.to_date(day).between(start, end))

    tables = {"lines": of(line, "l_shipdate"), "orders": of(orders, "o_orderdate")}
    cache, out = years.YearCache(s, shared_folder(s, "years"), tables, {"lines": "l_shipdate", "orders": "o_orderdate"}), []
    for start, end in SPANS:
        before = len(cache.fetched)
        for name, df in cache.load(start, end).items():
            rows, parts = years.scanned(df)
            out.append((start, end, name, ",".join(map(str, cache.fetched[before:])), parts, rows))
    return s.createDataFrame(out, "start string, end string, name string, fetched string, partitions long, rows long")


BY_YEAR_SQL = (
    f"with s as (select * from (values {', '.join(f'({i}, {a!r}, {b!r})' for i, (a, b) in enumerate(SPANS))}) t(i, a, b)), y as (select i, unnest(range(year(a::date), year(b::date) + 1)) as y from s), "
    "f as (select s.i, coalesce(string_agg(y::varchar, ',' order by y), '') as fetched from s left join (select min(i) as i, y from y group by y) g on g.i = s.i group by s.i), "
    "r as (select 'lines' as name, l_shipdate::date as day from lineitem union all select 'orders', o_orderdate::date from orders) "
    'select a as start, b as "end", name, fetched, (select count(distinct year(q.day)) from r q where q.name = n.name and year(q.day) between year(a::date) and year(b::date)) as partitions, '
    "(select count(*) from r q where q.name = n.name and q.day between a::date and b::date) as rows from s join f on f.i = s.i, (values ('lines'), ('orders')) n(name)"
)


def _vendor_statement(s: SparkSession, d: str) -> DataFrame:
    """A statement as a vendor sends it: dotted tickers, bookkeeping columns, undated rows, a sparse column."""
    o = src.table(s, d, "orders").select("o_orderkey", F.concat(F.lit("C."), F.col("o_custkey").cast("string")).alias("Ticker"), "o_orderdate", "o_totalprice", "o_orderstatus")
    return o.select(
        "Ticker",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("Publish Date"),
        F.year("o_orderdate").alias("Fiscal Year"),
        F.lit("USD").alias("Currency"),
        F.col("o_totalprice").alias("Revenue"),
        (F.col("o_totalprice") * 2).alias("Net Income/Starting Line"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("Capital Expenditures"),
    )


def _statement(s: SparkSession, d: str) -> DataFrame:
    customers = src.table(s, d, "customer").where("c_mktsegment != 'BUILDING'").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("TICKER"))
    x = src.renamed(loader.statement_source(s, lambda: _vendor_statement(s, d), customers, 100))
    return x.groupBy("TICKER").agg(F.count(F.lit(1)).alias("n"), F.min("DATE").alias("first_date"), F.round(F.sum("REVENUE_LTM") + 1e-4, 2).alias("revenue"), F.round(F.sum("NET_INCOME_START_LTM") + 1e-4, 2).alias("income"), F.lit(",".join(sorted(x.columns))).alias("names"))


STATEMENT_SQL = """select 'C-' || o_custkey as "TICKER", count(*) as n, cast(min(o_orderdate) as date) as first_date, round(sum(o_totalprice) + 1e-4, 2) as revenue, round(sum(o_totalprice * 2) + 1e-4, 2) as income,
'DATE,NET_INCOME_START_LTM,REVENUE_LTM,TICKER' as names from orders join customer on o_custkey = c_custkey where c_mktsegment <> 'BUILDING' and o_orderstatus <> 'P' group by o_custkey"""


def _statement_fails(s: SparkSession, d: str) -> DataFrame:
    """A statement that cannot be read is an empty frame with its two keys."""
    import warnings

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        x = loader.statement_source(s, lambda: s.read.parquet(f"{d}/no_such_statement.parquet"), s.createDataFrame([("A",)], "TICKER string"))
    return x.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(",".join(x.columns)).alias("names"), F.lit(len(said)).cast("long").alias("warned"))


def _keys(s: SparkSession, d: str) -> DataFrame:
    spans = src.table(s, d, "orders").select(F.trunc("o_orderdate", "month").alias("m")).distinct().select(F.col("m").cast("string").alias("start"), F.last_day("m").cast("string").alias("end"))
    x = spans.withColumn("name", F.explode(F.array(*[F.lit(t) for t in loader.TABLES])))
    return x.select("name", "start", "end", loader.cache_key_of(F.col("name"), F.col("start"), F.col("end")).alias("key"))


KEYS_SQL = "with m as (select distinct date_trunc('month', o_orderdate)::date as m from orders) select name, cast(m as varchar) as \"start\", cast(last_day(m) as varchar) as \"end\", substr(sha256(name || '|' || m || '|' || last_day(m)), 1, 16) as key from m, (select unnest(['prices', 'income_ttm', 'cashflow_ttm', 'universe']) as name)"


def _processed(s: SparkSession, d: str) -> DataFrame:
    """Two reads under one version make a table once; another version makes its own."""
    at, made = shared_folder(s, "processed"), []

    def make():
        made.append(1)
        return src.table(s, d, "region")

    out = []
    for version in ("raw_v2", "raw_v2", "raw_v3"):
        rows = loader.processed(s, at, "income", "2021-01-01", "2022-01-01", make, version).count()
        out.append((len(out) + 1, loader.processed_path("data", "income", "2021-01-01", "2022-01-01", version), rows, len(made)))
    return s.createDataFrame(out, "step int, path string, rows long, made long")


PROCESSED_SQL = "select step, 'data/processed_income_' || substr(sha256('processed_income|2021-01-01|2022-01-01|' || version), 1, 16) || '.parquet' as path, (select count(*) from region) as rows, made from (values (1, 'raw_v2', 1), (2, 'raw_v2', 1), (3, 'raw_v3', 2)) t(step, version, made)"


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s, "parquet")
    src.table(s, d, "part").withColumn("size", F.col("p_size")).write.partitionBy("size").parquet(at)
    return s.read.parquet(at).where("size between 10 and 20").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice") + 1e-4, 2).alias("price"))


def _migration(s: SparkSession, d: str) -> DataFrame:
    """Records kept before a column existed, and later ones with it, of which some replace older ones."""
    store = me.Store(s, shared_folder(s, "store"), "c_custkey")
    c = src.table(s, d, "customer")
    store.upsert(c.select("c_custkey", "c_acctbal"), 1)
    store.upsert(c.where("c_mktsegment = 'BUILDING'").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.upper("c_name").alias("c_name")), 2)
    return store.load().groupBy(F.col("c_name").isNull().alias("old")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal") + 1e-4, 2).alias("balance"))


MIGRATION_SQL = "select c_mktsegment <> 'BUILDING' as old, count(*) as n, round(sum(c_acctbal + case when c_mktsegment = 'BUILDING' then 1 else 0 end) + 1e-4, 2) as balance from customer group by 1"


def _bandit_state(s: SparkSession, d: str) -> DataFrame:
    """Three rounds of pulls, each round's posteriors kept over the last round's."""
    store = me.Store(s, shared_folder(s, "bandit"), "arm_id")
    ev = src.table(s, d, "events").select(F.col("event_type").alias("arm_id"), (F.col("event_id") % 3).alias("round"), ((F.col("event_id") * 7) % 11 / F.lit(10.0)).alias("reward"))
    store.upsert(ev.select("arm_id").distinct().select("arm_id", F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(0).cast("long").alias("pulls")), 0)
    for k in range(3):
        old = store.load()
        new = me.replay(ev.where(F.col("round") == k), old.select("arm_id", "alpha", "beta")).select("arm_id", "alpha", "beta", F.col("pulls").cast("long").alias("more"))
        store.upsert(new.join(old.select("arm_id", "pulls"), "arm_id").select("arm_id", "alpha", "beta", (F.col("pulls") + F.col("more")).alias("pulls")), k + 1)
    return store.load().select("arm_id", *r6("alpha", "beta"), "pulls")


BANDIT_SQL = "select event_type as arm_id, round(1 + sum(least(((event_id * 7) % 11) / 10.0, 1.0)), 6) + 0.0 as alpha, round(1 + sum(1 - least(((event_id * 7) % 11) / 10.0, 1.0)), 6) + 0.0 as beta, count(*) as pulls from events group by 1"


def _configs(s: SparkSession, d: str) -> DataFrame:
    """Configurations written as JSON and read back."""
    p = src.table(s, d, "part")
    made = p.select(F.col("p_name").alias("alpha_id"), F.concat(F.lit('rank("'), "p_brand", F.lit('") \\ x\n')).alias("formula"), F.array("p_brand", "p_type").alias("features"), F.col("p_size").alias("holding_period_days"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("parent_id"))
    at = shared_folder(s, "configs")
    me.write_configs(made, at)
    back = me.read_configs(s, at, "alpha_id string, formula string, features array<string>, holding_period_days int, parent_id string")
    return back.groupBy(F.element_at("features", 1).alias("brand"), "formula").agg(F.count(F.lit(1)).alias("n"), F.count("parent_id").alias("parents"), F.sum("holding_period_days").alias("days"), F.sum(F.size("features")).alias("features"))


CONFIGS_SQL = "select p_brand as brand, 'rank(\"' || p_brand || '\") \\ x' || chr(10) as formula, count(*) as n, count(case when p_size > 25 then 1 end) as parents, sum(p_size)::bigint as days, 2 * count(*) as features from part group by 1, 2"


def _regime_source(s: SparkSession, d: str) -> DataFrame:
    o = src.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    day = o.groupBy("date").agg(F.round(F.avg("o_totalprice") + 1e-6, 4).alias("i"), F.round(F.stddev_samp("o_totalprice") + 1e-6, 4).alias("v"))
    series = loader.regime_source(lambda: (day.select("date", F.col("i").alias("close")), day.select("date", F.col("v").alias("close"))))
    return bt.regimes(series.where("index_close is not null and vol_close is not null"))


REGIME_SQL = """with ix as (select cast(o_orderdate as date) as date, round(avg(o_totalprice) + 1e-6, 4) as i, round(stddev_samp(o_totalprice) + 1e-6, 4) as v from orders group by 1 having stddev_samp(o_totalprice) is not null),
m as (select cast(last_day(date) - cast(greatest(isodow(last_day(date)) - 5, 0) as integer) as date) as bme, arg_max(i, date) as i, arg_max(v, date) as v from ix group by 1),
t as (select *, i / lag(i, 12) over (order by bme) - 1 as trend, quantile_cont(v, 0.25) over () as lo, quantile_cont(v, 0.75) over () as hi from m)
select bme as date, coalesce(trend > 0, false) as bull, v > hi as high_vol, v < lo as low_vol, v >= lo and v <= hi as neutral_vol from t"""

# panel preparation


def _renames(s: SparkSession, d: str) -> DataFrame:
    """Every vendor name and two unknown ones, each column with its own value, under the names they get."""
    names = [*src.RENAMES, "Dividends Paid (Cash)", "  R&D -- Costs "]
    r = src.table(s, d, "region").select(F.current_date().alias("DATE"), F.col("r_name").alias("TICKER"), *[(F.col("r_regionkey") + i).alias(c) for i, c in enumerate(names)])
    x = src.renamed(r)
    return x.unpivot(["DATE", "TICKER"], [c for c in x.columns if c not in ("DATE", "TICKER")], "name", "value").groupBy("name").agg(F.sum("value").alias("total"))


RENAMES_SQL = "with n(name, i) as (values " + ", ".join(f"('{v}', {i})" for i, v in enumerate([*src.RENAMES.values(), "DIVIDENDS_PAID_CASH", "R_D_COSTS"])) + ") select name, cast(sum(r_regionkey + i) as bigint) as total from n, region group by name"


def _sanitised(s: SparkSession, d: str) -> DataFrame:
    p = src.table(s, d, "part").select(F.concat(F.lit(" "), "p_type", F.lit(" -- "), "p_brand", F.lit(" & Co. (x)")).alias("name"))
    return p.groupBy(src.sanitised(F.col("name")).alias("identifier")).agg(F.count(F.lit(1)).alias("n"))


SANITISED_SQL = "select upper(trim(regexp_replace(' ' || p_type || ' -- ' || p_brand || ' & Co. (x)', '[^A-Za-z0-9]+', '_', 'g'), '_')) as identifier, count(*) as n from part group by 1"


def _keyed(s: SparkSession, d: str) -> DataFrame:
    o = src.table(s, d, "orders").select("o_totalprice", F.col("o_orderstatus").alias("TICKER"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("DATE"))
    x = src.keyed(o)
    return x.groupBy("DATE", "TICKER").agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(x.columns)).alias("columns"))


def _flagged(s: SparkSession, d: str, flag: str, name: str) -> DataFrame:
    """Daily revenue of the lines with one return flag."""
    line = src.table(s, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("ticker"), "l_quantity")
    return line.groupBy("date", "ticker").agg(F.sum("l_quantity").alias(name))


def _align(s: SparkSession, d: str) -> DataFrame:
    x = src.align([_flagged(s, d, f, n) for f, n in (("A", "a"), ("N", "b"), ("R", "c"))])
    return x.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in "abc"], *[F.sum(c).alias(c) for c in "abc"])


ALIGN_SQL = "with x as (select cast(l_shipdate as date) as date, l_suppkey as ticker, " + ", ".join(f"sum(l_quantity) filter (l_returnflag = '{f}') as {n}" for f, n in (("A", "a"), ("N", "b"), ("R", "c"))) + " from lineitem group by 1, 2) select ticker, count(*) as n, count(a) as n_a, count(b) as n_b, count(c) as n_c, sum(a) as a, sum(b) as b, sum(c) as c from x group by ticker"


def _filings(s: SparkSession, d: str) -> DataFrame:
    """A figure a nation and day, weekends included; the nation's region and a country beside it."""
    c = src.table(s, d, "customer").join(src.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey")
    o = src.table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    day = o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("n_nationkey").alias("ticker"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("sector")).agg(F.round(F.max("o_totalprice"), 2).alias("figure"), F.round(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("other"))
    return day.withColumn("country", F.lit("US"))


FILINGS = "filings as (select cast(o_orderdate as date) as date, n_nationkey as ticker, 'R' || n_regionkey as sector, round(max(o_totalprice), 2) as figure, round(max(case when o_orderstatus = 'F' then o_totalprice end), 2) as other from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)"


def _grid_sql(source: str, values: str) -> str:
    fill = ", ".join(f"last_value({v} ignore nulls) over w as {v}" for v in values.split())
    return f"days as (select cast(d as date) as date from (select unnest(generate_series((select min(date) from {source}), (select max(date) from {source}), interval 1 day)) as d) where isodow(d) < 6), g as (select days.date, t.ticker, {fill} from days cross join (select distinct ticker from {source}) t left join {source} s on s.date = days.date and s.ticker = t.ticker window w as (partition by t.ticker order by days.date rows between unbounded preceding and current row))"


def _carried(s: SparkSession, d: str) -> DataFrame:
    x = src.process(_filings(s, d), ["figure", "other"])
    return x.groupBy("ticker", "sector", "country").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.round(F.sum("figure") + 1e-4, 2).alias("figure"), F.round(F.sum("other") + 1e-4, 2).alias("other"))


CARRIED_SQL = f"with {FILINGS}, whole as (select * from filings where figure is not null and other is not null), {_grid_sql('whole', 'figure other sector')} select ticker, sector, 'US' as country, count(*) as n, min(date) as first_date, round(sum(figure) + 1e-4, 2) as figure, round(sum(other) + 1e-4, 2) as other from g where figure is not null group by 1, 2"


def _weekend(s: SparkSession, d: str) -> DataFrame:
    """Figures of Saturdays and Sundays never reach the grid, so Monday carries Friday's."""
    x = src.densify(_filings(s, d).select("date", "ticker", "figure"), ["figure"])
    mondays = x.where(F.weekday("date") == 0)
    return mondays.groupBy("ticker").agg(F.count("figure").alias("n"), F.round(F.sum("figure") + 1e-4, 2).alias("figure"))


WEEKEND_SQL = f"with {FILINGS}, {_grid_sql('filings', 'figure')} select ticker, count(figure) as n, round(sum(figure) + 1e-4, 2) as figure from g where isodow(date) = 1 group by ticker"


def _price_join(s: SparkSession, d: str) -> DataFrame:
    """Fundamentals of returned lines, left joined with the prices of all lines, on trading dates."""
    fundamentals = src.densify(_flagged(s, d, "R", "returned"), ["returned"])
    line = src.table(s, d, "lineitem").where("l_returnflag != 'N'").select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("ticker"), F.col("l_extendedprice").alias("adjusted_price"), F.col("l_quantity").alias("adjusted_volume"))
    universe = src.table(s, d, "supplier").where("s_nationkey > 4").select(F.col("s_suppkey").alias("ticker"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("sector"))
    x = src.assemble(fundamentals, line, universe)
    return x.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.count("returned").alias("returned"), F.count("adjusted_price").alias("prices"), F.round(F.sum("adjusted_volume") + 1e-4, 3).alias("volume"))


PRICE_JOIN_SQL = f"""with r as (select cast(l_shipdate as date) as date, l_suppkey as ticker, sum(l_quantity) as returned from lineitem where l_returnflag = 'R' group by 1, 2), {_grid_sql('r', 'returned')},
px as (select cast(l_shipdate as date) as date, l_suppkey as ticker, avg(l_extendedprice) as price, avg(l_quantity) as volume from lineitem where l_returnflag <> 'N' group by 1, 2)
select case when s_nationkey > 4 then 'N' || s_nationkey end as sector, count(*) as n, count(returned) as returned, count(price) as prices, round(sum(volume) + 1e-4, 3) as volume
from g join supplier on s_suppkey = g.ticker left join px on px.date = g.date and px.ticker = g.ticker where g.date in (select date from px) group by 1"""


def _pivot_mean(s: SparkSession, d: str) -> DataFrame:
    """Several prices a date and segment become their mean, one column a segment; then long again."""
    o = src.table(s, d, "orders").join(src.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.trunc("o_orderdate", "month").alias("date"), "c_mktsegment", "o_totalprice")
    segments = sorted(r[0] for r in o.select("c_mktsegment").distinct().limit(100).collect())  # a dimension of five values
    wide = o.groupBy("date").pivot("c_mktsegment", segments).agg(F.avg("o_totalprice"))
    return wide.unpivot("date", segments, "ticker", "price").where("price is not null").select("date", "ticker", F.round(F.col("price") + 1e-6, 4).alias("price"))


def _pruned(s: SparkSession, d: str) -> DataFrame:
    """The columns that the scans read for a formula on prices alone."""
    import re

    x = compiler.evaluate(src.panel_a(s, d), {"v": "rank(ADJUSTED_PRICE)"}).groupBy("date").agg(F.sum("v").alias("v"))
    plan = x._jdf.queryExecution().sparkPlan().toString()
    found = sorted({c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in m.split(",")})
    return s.createDataFrame([(c,) for c in found], "column_name string")


# relational building blocks


def _asof_of(s: SparkSession, d: str, key) -> DataFrame:
    orders = src.table(s, d, "orders").select(key("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_orderkey", F.col("o_totalprice").alias("last_price"))
    shifted = src.table(s, d, "events").select("event_id", key("user_id").alias("k"), (F.col("ts").cast("timestamp_ntz") - F.expr("interval 25 years")).alias("t"))
    return segments.asof_join(shifted, orders, ["k"], "t", "at", ties=[F.col("o_orderkey")]).select("event_id", "last_price")


def _asof(s: SparkSession, d: str) -> DataFrame:
    """Each event with the price of the last order at or before it, by a segmented scan: no range join, no window over a key."""
    return _asof_of(s, d, lambda c: F.col(c) % 7)


def _asof_hot(s: SparkSession, d: str) -> DataFrame:
    """The same where one key has half of all rows on either side, and some keys have rows on one side only."""
    return _asof_of(s, d, lambda c: F.when(F.col(c) % 2 == 0, 0).otherwise(F.col(c) % 1000))


def _segmented_fill(s: SparkSession, d: str) -> DataFrame:
    """The panel's forward fill over blocks of equal size, whatever the tickers' shares of the rows."""
    day = src.daily(s, d)
    grid = src.business_days(day).crossJoin(day.select("ticker").distinct())  # the rectangular panel itself
    rows = grid.join(day.select("date", "ticker", F.col("volume").alias("v")), ["date", "ticker"], "left")
    return digest(segments.fill_forward(rows, ["ticker"], ["date"], ["v"]))


ASOF_SQL = "with o as (select o_custkey % 7 as k, o_orderdate as t, arg_max(o_totalprice, o_orderkey) as price from orders group by 1, 2) select e.event_id, o.price as last_price from (select event_id, user_id % 7 as k, ts - interval 25 years as t from events) e asof left join o on e.k = o.k and e.t >= o.t"


def _intervals(s: SparkSession, d: str) -> DataFrame:
    """Lines shipped within 30 days after an order of the same customer's key: a band join bucketed by 30-day slots."""
    slot = lambda c: F.floor(F.unix_date(F.to_date(c)) / 30)
    o = src.table(s, d, "orders").select(F.col("o_orderkey"), F.to_date("o_orderdate").alias("od"), (F.col("o_custkey") % 1000).alias("k")).withColumn("slot", F.explode(F.array(slot("od"), slot("od") + 1)))
    c = src.table(s, d, "lineitem").select((F.col("l_suppkey") % 1000).alias("k"), F.to_date("l_shipdate").alias("sd"), "l_quantity").withColumn("slot", slot("sd"))
    x = o.join(c, ["k", "slot"]).where("sd >= od and sd < date_add(od, 30)")
    return x.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


INTERVALS_SQL = "select o_orderkey, count(*) as n, sum(l_quantity) as q from orders join lineitem on o_custkey % 1000 = l_suppkey % 1000 and cast(l_shipdate as date) >= cast(o_orderdate as date) and cast(l_shipdate as date) < cast(o_orderdate as date) + 30 group by 1"


def _sets(s: SparkSession, d: str) -> DataFrame:
    line = src.table(s, d, "lineitem")
    a, b = (line.where(F.col("l_returnflag") == f).select("l_suppkey", F.month("l_shipdate").alias("m")) for f in "RA")
    parts = [("except", a.distinct().exceptAll(b.distinct())), ("intersect", a.intersect(b)), ("union", a.union(b).distinct())]
    out = None
    for name, x in parts:
        x = x.groupBy(F.lit(name).alias("op"), "m").agg(F.count(F.lit(1)).alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


HOT_SQL = ASOF_SQL.replace("o_custkey % 7", "case when o_custkey % 2 = 0 then 0 else o_custkey % 1000 end").replace("user_id % 7", "case when user_id % 2 = 0 then 0 else user_id % 1000 end")

SETS_SQL = "with a as (select distinct l_suppkey, month(l_shipdate)::integer as m from lineitem where l_returnflag = 'R'), b as (select distinct l_suppkey, month(l_shipdate)::integer as m from lineitem where l_returnflag = 'A') " + " union all ".join(f"select '{op}' as op, m, count(*) as n from (select * from a {op} select * from b) group by m" for op in ("except", "intersect", "union"))


def _cube(s: SparkSession, d: str) -> DataFrame:
    return src.table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


def _approximate(s: SparkSession, d: str) -> DataFrame:
    """Approximate counts and medians lie within their stated errors."""
    e = src.table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"), F.approx_percentile("value", 0.5, 10_000).alias("m"), F.percentile("value", F.lit(0.45)).alias("lo"), F.percentile("value", F.lit(0.55)).alias("hi"))
    return e.select("event_type", F.col("b").alias("users"), (F.abs(F.col("a") - F.col("b")) <= 0.08 * F.col("b") + 1).alias("distinct_ok"), ((F.col("m") >= F.col("lo")) & (F.col("m") <= F.col("hi"))).alias("median_ok"))


def _kept_sketches(s: SparkSession, d: str) -> DataFrame:
    """Months from daily sketches, without the rows: counts, and whether distinct suppliers and the median lie within the stated errors."""
    line = src.table(s, d, "lineitem")
    kept_days = sketches.Sketches(s, shared_folder(s, "sketches"), ["l_returnflag"])
    kept_days.put(sketches.daily(line, F.col("l_shipdate"), ["l_returnflag"], "l_suppkey", "l_extendedprice"))
    month = lambda c: F.date_format(c, "yyyy-MM")
    found = kept_days.merged(month("day"))
    rows = line.select(month("l_shipdate").alias("span"), "l_suppkey", "l_extendedprice")
    x = rows.join(F.broadcast(found), "span")  # one row a month
    exact = x.groupBy("span").agg(
        F.max("n").alias("n"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.max("distinct_values").alias("_e"),
        (F.count_if(F.col("l_extendedprice") < F.col("`at_0.5`")) / F.count(F.lit(1))).alias("_below"),
        (F.count_if(F.col("l_extendedprice") <= F.col("`at_0.5`")) / F.count(F.lit(1))).alias("_upto"),
    )
    near = F.abs(F.col("_e") - F.col("suppliers")) <= sketches.DISTINCT_ERROR * F.col("suppliers") + 1
    middle = (F.col("_below") <= 0.5 + 2 * sketches.RANK_ERROR) & (F.col("_upto") >= 0.5 - 2 * sketches.RANK_ERROR)
    return exact.select("span", "n", "suppliers", near.alias("distinct_ok"), middle.alias("median_ok"))


def _custom(s: SparkSession, d: str) -> DataFrame:
    """An operator that a user adds, in a formula beside the built-in ones."""
    registry.register("spread", "date", 1, lambda x: x - F.avg(x).over(registry.cs()))
    try:
        return digest(compiler.evaluate(src.panel_a(s, d), {"v": "spread(ADJUSTED_VOLUME) * 2"}).select("date", "ticker", "v"))
    finally:
        registry.OPERATORS.pop("spread")


def queries() -> dict:
    return {
        "io01_cached_load": _cached_load,
        "io02_universe": _universe,
        "io03_delivered_prices": _delivered,
        "io04_statement_source": _statement,
        "io04_statement_failure": _statement_fails,
        "io06_cache_key": _keys,
        "io07_processed_version": _processed,
        "io07_cache_by_year": _cache_by_year,
        "io08_parquet_round_trip": _round_trip,
        "io10_schema_migration": _migration,
        "io11_bandit_state": _bandit_state,
        "io12_json_configs": _configs,
        "io15_regime_source": _regime_source,
        "etl01_rename": _renames,
        "etl02_sanitise": _sanitised,
        "etl03_keys": _keyed,
        "etl07_outer_align": _align,
        "etl08_carried_columns": _carried,
        "etl12_weekend_filings": _weekend,
        "etl17_price_join": _price_join,
        "etl19_pivot_mean": _pivot_mean,
        "etl20_pruned_scan": _pruned,
        "rel_asof_join": _asof,
        "rel_asof_hot": _asof_hot,
        "etl11_segmented_fill": _segmented_fill,
        "rel_interval_join": _intervals,
        "rel_set_operations": _sets,
        "rel_cube": _cube,
        "rel_approximate": _approximate,
        "rel_kept_sketches": _kept_sketches,
        "reg_custom_operator": _custom,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "io01_cached_load": CACHED_SQL,
        "io02_universe": UNIVERSE_SQL,
        "io03_delivered_prices": DELIVERED_SQL,
        "io04_statement_source": STATEMENT_SQL,
        "io04_statement_failure": "select 0::bigint as n, 'TICKER,DATE' as names, 1::bigint as warned",
        "io06_cache_key": KEYS_SQL,
        "io07_processed_version": PROCESSED_SQL,
        "io07_cache_by_year": BY_YEAR_SQL,
        "io08_parquet_round_trip": "select p_brand, count(*) as n, round(sum(p_retailprice) + 1e-4, 2) as price from part where p_size between 10 and 20 group by p_brand",
        "io10_schema_migration": MIGRATION_SQL,
        "io11_bandit_state": BANDIT_SQL,
        "io12_json_configs": CONFIGS_SQL,
        "io15_regime_source": REGIME_SQL,
        "etl01_rename": RENAMES_SQL,
        "etl02_sanitise": SANITISED_SQL,
        "etl03_keys": "select cast(o_orderdate as date) as \"DATE\", o_orderstatus as \"TICKER\", count(*) as n, 'DATE,TICKER,o_totalprice' as columns from orders group by 1, 2",
        "etl07_outer_align": ALIGN_SQL,
        "etl08_carried_columns": CARRIED_SQL,
        "etl12_weekend_filings": WEEKEND_SQL,
        "etl17_price_join": PRICE_JOIN_SQL,
        "etl19_pivot_mean": "select date_trunc('month', o_orderdate)::date as date, c_mktsegment as ticker, round(avg(o_totalprice) + 1e-6, 4) as price from orders join customer on o_custkey = c_custkey group by 1, 2",
        "etl20_pruned_scan": "select unnest(['l_extendedprice', 'l_partkey', 'l_quantity', 'l_shipdate', 'p_partkey', 'p_size']) as column_name",
        "rel_asof_join": ASOF_SQL,
        "rel_asof_hot": HOT_SQL,
        "etl11_segmented_fill": f"{PANEL}, v as (select date, ticker, y as v from p) {DIGEST}",
        "rel_interval_join": INTERVALS_SQL,
        "rel_set_operations": SETS_SQL,
        "rel_cube": "select l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::bigint as level, count(*) as n, sum(l_quantity) as q from lineitem group by cube (l_returnflag, l_linestatus)",
        "rel_approximate": "select event_type, count(distinct user_id) as users, true as distinct_ok, true as median_ok from events group by 1",
        "rel_kept_sketches": "select strftime(l_shipdate, '%Y-%m') as span, count(*) as n, count(distinct l_suppkey) as suppliers, true as distinct_ok, true as median_ok from lineitem group by 1",
        "reg_custom_operator": f"{PANEL}, v as (select date, ticker, (y - avg(y) over (partition by date)) * 2 as v from p) {DIGEST}",
    }
