"""A Python data source of daily prices as vendors deliver them: wide answers, one for a chunk of tickers and a year.

A chunk is a JSON file: its dates, and for each ticker a list of closes and a list of volumes, null where there is none. An index
beside the chunks, a JSON object a line for each delivery, holds each one's ticker and date range. The reader plans from the index:
chunks that the tickers or days asked for rule out are not opened, each other one is a task of its own (small ones share one), and its
wide lists become rows of (date, ticker, close, volume), without those that lack a close or a volume. Tickers and days are options of
the read: with filters pushed down by Spark a DataFrame that is used twice keeps the reader, filters and all, of its first use.

As a stream, deliveries are the offsets: every batch reads the chunks of the deliveries that are new, all of them once. A delivery
counts once its index file is there, which is written after its chunks, by a rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from panelforge.functions.tables import kept, shared_folder

FORMAT = "price_chunks"
SCHEMA = "date date, ticker string, close double, volume double"
ARROW = pa.schema([("date", pa.date32()), ("ticker", pa.string()), ("close", pa.float64()), ("volume", pa.float64())])
INDEX = "file string, tickers int, low string, high string, first string, last string, bytes long"
#: Small chunks share a task up to this size.
TASK_BYTES = 64 << 20


def _open(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def deliver(prices: DataFrame, path: str, tickers_a_chunk: int = 100) -> int:
    """Write prices (date, ticker, close, volume) as the next delivery; its number. A ticker and date is given once.

    Chunks are ranges of tickers in their order, so that a ticker filter rules out whole chunks. A group is one chunk and year: at
    most tickers_a_chunk tickers and 366 days. Rows without a date or ticker go. One writer at a time; a second one that takes
    the same number fails.
    """
    from pyarrow import fs as afs

    fs, root = _open(path)
    number = max(deliveries(path), default=-1) + 1
    mark = uuid.uuid4().hex
    rows = prices.select("date", F.col("ticker").cast("string"), F.col("close").cast("double"), F.col("volume").cast("double")).where("date is not null and ticker is not null")
    names = rows.select("ticker").distinct()
    # ranges of the sort, cut again by the place in each
    placed = names.repartitionByRange("ticker").sortWithinPartitions("ticker").withColumn("_p", F.spark_partition_id())
    placed = placed.withColumn("_chunk", F.concat_ws("-", F.lpad(F.col("_p").cast("string"), 6, "0"), F.lpad(F.floor((F.row_number().over(Window.partitionBy("_p").orderBy("ticker")) - 1) / tickers_a_chunk).cast("string"), 6, "0"))).select("ticker", "_chunk")
    placed = kept(placed, shared_folder(prices.sparkSession, "chunks"))  # a task that runs again must not cut the ranges elsewhere
    fs.create_dir(f"{root}/chunks", recursive=True)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        days = sorted(pdf["date"].unique())
        wide = {c: pdf.pivot(index="date", columns="ticker", values=c).reindex(days) for c in ("close", "volume")}
        lists = {c: {t: [None if v != v else v for v in w[t].tolist()] for t in w.columns} for c, w in wide.items()}
        body = json.dumps({"dates": [str(d) for d in days], **lists}).encode()
        name = f"{mark}-{pdf['_chunk'].iloc[0]}-{days[0].year}.json"
        at, top = _open(path)
        with at.open_output_stream(f"{top}/chunks/{name}") as out:
            out.write(body)
        return pd.DataFrame({"file": [name], "tickers": [wide["close"].shape[1]], "low": [pdf["ticker"].min()], "high": [pdf["ticker"].max()], "first": [str(days[0])], "last": [str(days[-1])], "bytes": [len(body)]})

    found = rows.join(placed, "ticker").withColumn("_y", F.year("date")).groupBy("_chunk", "_y").applyInPandas(write, INDEX)
    lines = [json.dumps(r.asDict()) for r in found.toLocalIterator()]  # a line for each chunk, as a listing of the folder would have
    fs.create_dir(f"{root}/index", recursive=True)
    final, temp = f"{root}/index/{number:09d}.jsonl", f"{root}/index/_{mark}"
    with fs.open_output_stream(temp) as out:
        out.write("\n".join(lines).encode())
    if fs.get_file_info(final).type != afs.FileType.NotFound:
        fs.delete_file(temp)
        raise FileExistsError(final)
    fs.move(temp, final)
    return number


def deliveries(path: str) -> list[int]:
    from pyarrow.fs import FileSelector

    fs, root = _open(path)
    names = [i.base_name for i in fs.get_file_info(FileSelector(f"{root}/index", allow_not_found=True))]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".jsonl"))


class Chunks(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class _Reader:
    """What the reader of a table and that of a stream share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.tickers: set[str] | None = set(json.loads(options["tickers"])) if "tickers" in options else None
        self.first, self.last = options.get("start", ""), options.get("end", "9999-12-31")

    def wanted(self, line: dict) -> bool:
        inside = self.tickers is None or any(line["low"] <= t <= line["high"] for t in self.tickers)
        return inside and line["first"] <= self.last and line["last"] >= self.first

    def plan(self, numbers: list[int]) -> list[Chunks]:
        fs, root = _open(self.path)
        out: list[list[str]] = []
        size = TASK_BYTES
        for n in numbers:
            with fs.open_input_stream(f"{root}/index/{n:09d}.jsonl") as f:
                lines = [json.loads(x) for x in f.read().decode().split("\n") if x]
            for line in sorted(filter(self.wanted, lines), key=lambda x: x["file"]):
                if size + line["bytes"] > TASK_BYTES:
                    out.append([])
                    size = 0
                out[-1].append(line["file"])
                size += line["bytes"]
        return [Chunks(f) for f in out] or [Chunks([])]

    def rows(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        for name in partition.value:
            with fs.open_input_stream(f"{root}/chunks/{name}") as f:
                data = json.loads(f.read())
            days = np.array(data["dates"], "datetime64[D]")
            inside = np.array([self.first <= d <= self.last for d in data["dates"]], bool)
            for ticker in sorted(data["close"]):
                if self.tickers is not None and ticker not in self.tickers:
                    continue
                close, volume = (np.array(data[c].get(ticker) or [None] * len(days), float) for c in ("close", "volume"))
                good = inside & ~np.isnan(close) & ~np.isnan(volume)
                n = int(good.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(days[good], pa.date32()), pa.array([ticker] * n, pa.string()), pa.array(close[good]), pa.array(volume[good])], schema=ARROW)


class TableReader(_Reader, DataSourceReader):
    def partitions(self):
        return self.plan(deliveries(self.path))

    def read(self, partition):
        return self.rows(partition)


class StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self):
        return {"next": 0}

    def latestOffset(self):
        return {"next": max(deliveries(self.path), default=-1) + 1}

    def partitions(self, start, end):
        return self.plan([n for n in deliveries(self.path) if start["next"] <= n < end["next"]])

    def read(self, partition):
        return self.rows(partition)

    def commit(self, end):
        pass


class PriceChunks(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TableReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def _options(spark: SparkSession, tickers: Iterable[str] | None, start: str | None, end: str | None) -> dict[str, str]:
    spark.dataSource.register(PriceChunks)
    out = {} if tickers is None else {"tickers": json.dumps(sorted(set(tickers)))}
    return out | {k: v for k, v in (("start", start), ("end", end)) if v is not None}


def read(spark: SparkSession, path: str, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The prices of all deliveries: date, ticker, close, volume; of some tickers and days (both included) if they are named.

    Chunks that these rule out are not opened. A ticker list too long to name is joined with instead.
    """
    return spark.read.format(FORMAT).options(**_options(spark, tickers, start, end)).load(path)


def stream(spark: SparkSession, path: str, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same rows, delivery by delivery."""
    return spark.readStream.format(FORMAT).options(**_options(spark, tickers, start, end)).load(path)
