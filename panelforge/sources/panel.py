"""The panel: adapters from the driver's tables, the business-day grid, forward fill and statement ETL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.nullsafe import clean
from panelforge.functions.tables import small

#: Vendor names and the columns they become (fixed values).
RENAMES = {
    "Revenue": "REVENUE_LTM",
    "Cost of Revenue": "COGS_LTM",
    "Gross Profit": "GROSS_PROFIT_LTM",
    "Operating Expenses": "OPERATING_EXPENSES_LTM",
    "Selling, General & Administrative": "SGA_EXPENSE_LTM",
    "Operating Income (Loss)": "OPERATING_INCOME_LTM",
    "Non-Operating Income (Loss)": "NON_OPERATING_INCOME_LTM",
    "Interest Expense, Net": "NET_INTEREST_EXPENSE_LTM",
    "Pretax Income (Loss), Adj.": "PRETAX_INCOME_ADJ_LTM",
    "Pretax Income (Loss)": "PRETAX_INCOME_LTM",
    "Income Tax (Expense) Benefit, Net": "INCOME_TAX_LTM",
    "Income (Loss) from Continuing Operations": "CONTINUING_INCOME_LTM",
    "Net Income": "NET_INCOME_LTM",
    "Net Income (Common)": "NET_INCOME_COMMON_LTM",
    "EPS (Diluted)": "EPS_DILUTED",
    "Shares (Basic)": "SHARES_BASIC",
    "Shares (Diluted)": "SHARES_DILUTED",
    "Net Income/Starting Line": "NET_INCOME_START_LTM",
    "Depreciation & Amortization": "DA_LTM",
    "Non-Cash Items": "NON_CASH_ITEMS_LTM",
    "Change in Working Capital": "WORKING_CAPITAL_CHANGE_LTM",
    "Net Cash from Operating Activities": "CFO_LTM",
    "Change in Fixed Assets & Intangibles": "FIXED_ASSET_CHANGE_LTM",
    "Net Cash from Investing Activities": "CFI_LTM",
    "Capital Expenditures": "CAPEX_LTM",
    "Cash from (Repayment of) Debt": "DEBT_FINANCING_CF_LTM",
    "Cash from (Repurchase of) Equity": "EQUITY_FINANCING_CF_LTM",
    "Net Cash from Financing Activities": "CFF_LTM",
    "Net Change in Cash": "NET_CHANGE_CASH_LTM",
}
META = ["Fiscal Year", "Fiscal Period", "Currency", "Report Date", "Restated Date", "SimFinId"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sanitise(name: str) -> str:
    """A vendor column name as an identifier."""
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").upper()


def sanitised(name: Column) -> Column:
    """``sanitise`` for names in a column."""
    return F.upper(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def keyed(df: DataFrame) -> DataFrame:
    """DATE (as a date) and TICKER first, whatever their order and type were."""
    return df.select(F.to_date("DATE").alias("DATE"), "TICKER", *[f"`{c}`" for c in df.columns if c not in ("DATE", "TICKER")])


def align(parts: list[DataFrame]) -> DataFrame:
    """Column panels (date, ticker, values) as one long frame: every key that a panel has, null where another lacks it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["date", "ticker"], "full")
    return out


def renamed(df: DataFrame, keys: tuple[str, ...] = ("DATE", "TICKER")) -> DataFrame:
    """Known vendor names mapped, others made identifiers."""
    return df.withColumnsRenamed({c: RENAMES.get(c, sanitise(c)) for c in df.columns if c not in keys})


def drop_sparse(df: DataFrame, columns: list[str], most_nulls: int = 1000) -> DataFrame:
    """Without the value columns that miss more than so many values: one pass counts them all."""
    if not columns:
        return df
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    gone = lambda c: F.col(f"`{c}`").isNull() | (F.isnan(F.col(f"`{c}`")) if c in numbers else F.lit(False))
    nulls = df.agg(*[F.count_if(gone(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return df.drop(*[c for i, c in enumerate(columns) if nulls[i] > most_nulls])


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_nr", F.row_number().over(w)).where("_nr = 1").drop("_nr")


def business_days(df: DataFrame, date: str = "date") -> DataFrame:
    """Monday to Friday between the first and last date of df."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(date))
    return days.where(F.weekday(date) < 5)


def densify(df: DataFrame, values: list[str], date: str = "date", ticker: str = "ticker") -> DataFrame:
    """Every business day for every ticker, values carried forward column by column; days before a ticker's first value are null."""
    tickers = df.select(ticker).distinct()
    grid = business_days(df, date).crossJoin(tickers)  # the rectangular panel itself: days times tickers
    before = Window.partitionBy(ticker).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(df, [date, ticker], "left").select(date, ticker, *[F.last(c, ignorenulls=True).over(before).alias(c) for c in values])


def seed(statement: DataFrame, start: str, end: str, values: list[str]) -> DataFrame:
    """A statement on the business-day grid from start: filings of the year before start seed the fill."""
    lo = F.add_months(F.lit(start).cast("date"), -12)
    dense = densify(statement.where((F.col("date") >= lo) & (F.col("date") <= F.lit(end).cast("date"))), values)
    return dense.where(F.col("date") >= F.lit(start).cast("date")).dropna("all", subset=values)


#: Carried along, never processed.
CARRIED = ["sector", "country"]


def clean_process(df: DataFrame, values: list[str]) -> DataFrame:
    """A column is left out on dates where no ticker has it; then rows lacking any value go. Other columns are carried along."""
    return df.dropna("any", subset=values)


def process(df: DataFrame, values: list[str]) -> DataFrame:
    """Rows lacking a value dropped, the rest carried forward on the business-day grid, with the carried columns."""
    carried = [c for c in CARRIED if c in df.columns]
    return densify(clean_process(df, values), [*values, *carried]).dropna("all", subset=[*values, *carried])


def rounded(x: Column, digits: int) -> Column:
    """Rounded off the halves: money and quantities make exact halves, which engines round apart after summing in their own order."""
    return F.round(x + 1.3e-2 * 10.0**-digits, digits)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a weekday and part size: price, volume, revenue, cost, tax, orders."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.to_date("l_shipdate").alias("date"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    rows = line.where(F.weekday("date") < 5).join(part, line.l_partkey == part.p_partkey)
    return rows.groupBy("date", F.col("p_size").alias("ticker")).agg(
        rounded(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("price"),
        F.sum("l_quantity").alias("volume"),
        rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        rounded(F.sum(F.col("p_retailprice") * F.col("l_quantity")), 2).alias("cogs"),
        rounded(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("tax"),
        F.count_distinct("l_orderkey").cast("double").alias("orders"),
    )


def statements(day: DataFrame) -> DataFrame:
    """Trailing-year sums of the daily figures, by ticker."""
    year = Window.partitionBy("ticker").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-364, 0)
    return day.select("date", "ticker", *[rounded(F.sum(a).over(year), 2).alias(b) for a, b in (("revenue", "revenue_ltm"), ("cogs", "cogs_ltm"), ("tax", "income_tax_ltm"), ("orders", "shares_basic"))])


VALUES = ["adjusted_price", "adjusted_volume", "revenue_ltm", "cogs_ltm", "income_tax_ltm", "shares_basic"]


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default panel: part sizes as tickers, five sectors, weekdays, prices and trailing-year figures."""
    day = daily(spark, sf_dir)
    joined = day.select("date", "ticker", F.col("price").alias("adjusted_price"), F.col("volume").alias("adjusted_volume")).join(statements(day), ["date", "ticker"])
    return densify(joined, VALUES).withColumn("sector", F.concat(F.lit("S"), (F.col("ticker") % 5).cast("string")))


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tickers, their nation's region as sector."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("date")).where(F.weekday("date") < 5)
    day = line.groupBy("date", F.col("l_suppkey").alias("ticker")).agg(rounded(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("adjusted_price"), F.sum("l_quantity").alias("adjusted_volume"))
    sector = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("sector"))
    return densify(day, ["adjusted_price", "adjusted_volume"]).join(sector, "ticker", "left")


def panel_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tickers: mean and sum of event values by day."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("ticker"), clean(F.col("value")).alias("value"))
    day = events.groupBy("date", "ticker").agg(F.round(F.avg("value"), 4).alias("adjusted_price"), F.round(F.sum("value"), 4).alias("adjusted_volume"))
    return densify(day, ["adjusted_price", "adjusted_volume"]).withColumn("sector", F.concat(F.lit("S"), (F.col("ticker") % 5).cast("string")))


def full_statements(income: DataFrame, cash: DataFrame) -> DataFrame:
    """Full outer join of two statements on the keys; columns that both have come from the first."""
    return income.join(cash.drop(*[c for c in cash.columns if c in income.columns and c not in ("date", "ticker")]), ["date", "ticker"], "full")


def assemble(fundamentals: DataFrame, prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Fundamentals with sector and price, on trading dates only."""
    trading = prices.select("date").distinct()
    mean = prices.groupBy("date", "ticker").agg(F.avg("adjusted_price").alias("adjusted_price"), F.avg("adjusted_volume").alias("adjusted_volume"))
    return fundamentals.join(small(universe.select("ticker", "sector")), "ticker", "left").join(mean, ["date", "ticker"], "left").join(trading, "date", "left_semi")
