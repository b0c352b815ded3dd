"""Sources behind a cache: universe, prices, statements, regime series; each a DataFrame from a callable that a user supplies.

What comes from a vendor's server in other systems comes here from any reader (files, tables, a data source): a callable
that is given (start, end) and, where it needs them, the tickers.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.tables import delete, exists
from panelforge.sources import panel

TABLES = ["prices", "income_ttm", "cashflow_ttm", "universe"]
#: Goes into the keys of processed tables: raise it when processing changes, so that no old table is read.
PIPELINE_VERSION = "raw_v2"


def cache_key(*parts: str) -> str:
    """Sixteen hexadecimal digits of the parts' SHA-256."""
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def cache_key_of(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def cached_path(folder: str, table: str, start: str, end: str) -> str:
    return f"{folder}/{table}_{cache_key(table, start, end)}.parquet"


def processed_path(folder: str, statement: str, start: str, end: str, version: str = PIPELINE_VERSION) -> str:
    return f"{folder}/processed_{statement}_{cache_key(f'processed_{statement}', start, end, version)}.parquet"


class Loader:
    """Four tables for a span of dates. If one of them is not in the cache, all are read again, so that they fit each other."""

    def __init__(self, spark: SparkSession, folder: str, sources: dict[str, Callable[..., DataFrame]], use_cache: bool = True):
        if set(sources) != set(TABLES):
            raise ValueError(f"sources must be {TABLES}")
        self.spark, self.folder, self.sources, self.use_cache = spark, folder.rstrip("/"), sources, use_cache
        self.fetched = 0

    def load(self, start: str, end: str) -> dict[str, DataFrame]:
        paths = {t: cached_path(self.folder, t, start, end) for t in TABLES}
        if not (self.use_cache and all(exists(self.spark, f"{p}/_SUCCESS") for p in paths.values())):
            universe = self._store("universe", self.sources["universe"](), paths)
            tickers = universe.select("TICKER").distinct()
            for t in TABLES[:3]:
                self._store(t, self.sources[t](tickers, start, end), paths)
        return {t: self.spark.read.parquet(p) for t, p in paths.items()}

    def _store(self, table: str, df: DataFrame, paths: dict[str, str]) -> DataFrame:
        df.write.mode("overwrite").parquet(paths[table])
        self.fetched += 1
        return self.spark.read.parquet(paths[table])

    def forget(self, table: str, start: str, end: str) -> None:
        delete(self.spark, cached_path(self.folder, table, start, end))


def processed(spark: SparkSession, folder: str, statement: str, start: str, end: str, make: Callable[[], DataFrame], version: str = PIPELINE_VERSION) -> DataFrame:
    """A processed statement from its versioned table, made and kept if there is none."""
    path = processed_path(folder, statement, start, end, version)
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _text(cell: Column) -> Column:
    """A cell's text: markup out, the common character references decoded."""
    out = F.regexp_replace(cell, "<[^>]*>", "")
    for mark, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(mark), F.lit(c))
    return F.trim(out)


def universe_from_html(pages: DataFrame, symbol: str = "Symbol", sector: str = "GICS Sector", country: str = "US") -> DataFrame:
    """TICKER (dots as dashes), SECTOR, COUNTRY from the first table of pages (html), by its header's names."""
    first = F.regexp_extract("html", r"(?is)<table\b.*?</table>", 0)
    rows = F.regexp_extract_all(first, F.lit(r"(?is)(<tr\b.*?</tr>)"), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.col("row"), F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), _text)
    at = lambda name: F.array_position(F.col("head"), name).cast("int")
    x = pages.select(F.posexplode(rows).alias("i", "row"), F.element_at(rows, 1).alias("first")).select("i", "row", "first")
    x = x.withColumn("cells", cells).withColumn("head", F.transform(F.regexp_extract_all("first", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), _text))
    x = x.where("i > 0 and size(cells) > 0")
    return x.select(F.replace(F.element_at("cells", at(symbol)), F.lit("."), F.lit("-")).alias("TICKER"), F.element_at("cells", at(sector)).alias("SECTOR"), F.lit(country).alias("COUNTRY"))


def statement_source(spark: SparkSession, read: Callable[[], DataFrame], tickers: DataFrame, most_nulls: int = 1000) -> DataFrame:
    """TICKER, DATE and a vendor statement's value columns: the universe's tickers only, without bookkeeping columns, undated
    rows and sparse columns. If the statement cannot be read, an empty frame and a warning."""
    try:
        raw = read()
        names = tickers.select(F.replace("TICKER", F.lit("-"), F.lit(".")).alias("Ticker")).distinct()
        df = raw.join(names, "Ticker", "left_semi").withColumnsRenamed({"Ticker": "TICKER", "Publish Date": "DATE"}).drop(*panel.META)
        df = df.withColumn("TICKER", F.replace("TICKER", F.lit("."), F.lit("-"))).withColumn("DATE", F.to_date("DATE")).where("DATE is not null")
        values = [c for c in df.columns if c not in ("TICKER", "DATE")]
        out = panel.drop_sparse(df, values, most_nulls)
        return out.select("TICKER", "DATE", *[f"`{c}`" for c in out.columns if c not in ("TICKER", "DATE")])
    except Exception as e:
        warnings.warn(f"the statement could not be read: {e}", stacklevel=2)
        return spark.createDataFrame([], "TICKER string, DATE date")


def regime_source(read: Callable[[], tuple[DataFrame, DataFrame]]) -> DataFrame | None:
    """date, index_close, vol_close from two daily series (date, close); None if they cannot be read: then there are no regimes."""
    try:
        index, vol = read()
        return index.select("date", F.col("close").alias("index_close")).join(vol.select("date", F.col("close").alias("vol_close")), "date", "full")
    except Exception as e:
        warnings.warn(f"the regime series could not be read: {e}", stacklevel=2)
        return None
