"""Prices in vendor chunks, as a table and as a stream, against the rows that were delivered."""

import datetime
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from panelforge.sources import chunks

DAYS = [datetime.date(2020, 11, 1) + datetime.timedelta(i) for i in range(120)]


def made(seed, tickers):
    rng = random.Random(seed)
    return [(d, t, rng.choice([None, rng.random(), rng.random()]), rng.choice([0.0, 5.0, None, 7.0])) for d in DAYS for t in tickers if rng.random() < 0.7]


def plain(rows, keep=lambda d, t: True):
    return sorted((d, t, c, v) for d, t, c, v in rows if c is not None and v is not None and keep(d, t))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prices"))
    rows = made(1, [f"T{i:02d}" for i in range(12)]) + [(None, "T01", 1.0, 1.0), (DAYS[0], None, 1.0, 1.0)]
    assert chunks.deliver(spark.createDataFrame(rows, chunks.SCHEMA).repartition(3), path, 3) == 0
    return path, rows[:-2]


def test_table(spark, table):
    path, rows = table
    df = chunks.read(spark, path)
    assert got(df) == plain(rows)
    for where, keep in [("ticker in ('T03', 'none')", lambda d, t: t == "T03"), ("date = '2020-12-31' or ticker = 'T00'", lambda d, t: d == datetime.date(2020, 12, 31) or t == "T00"), ("date > '2021-01-02'", lambda d, t: d > datetime.date(2021, 1, 2))]:
        assert got(df.where(where)) == plain(rows, keep)  # one DataFrame, used again and again
    some = chunks.read(spark, path, ["T03", "T09", "none"], "2020-12-31", "2021-01-02")
    assert got(some) == plain(rows, lambda d, t: t in ("T03", "T09") and datetime.date(2020, 12, 31) <= d <= datetime.date(2021, 1, 2))
    assert got(chunks.read(spark, path, [])) == got(chunks.read(spark, path, start="2030-01-01")) == []


def test_chunks_that_are_ruled_out_are_not_opened(spark, table, tmp_path):
    path, rows = table
    index = [json.loads(x) for x in open(f"{path}/index/000000000.jsonl")]
    reader = chunks.TableReader({"path": path, "tickers": '["T03"]', "end": "2020-11-30"})
    files = [f for p in reader.partitions() for f in p.value]
    assert set(files) == {i["file"] for i in index if i["low"] <= "T03" <= i["high"] and i["first"] < "2020-12-01"} and 0 < len(files) < len(index)
    other = str(tmp_path / "copy")
    shutil.copytree(path, other)
    for i in index:
        if i["file"] not in files:
            open(f"{other}/chunks/{i['file']}", "w").write("spoilt")
    assert got(chunks.read(spark, other, ["T03"], end="2020-11-30")) == plain(rows, lambda d, t: t == "T03" and d < datetime.date(2020, 12, 1))


def test_stream_reads_every_delivery_once(spark, tmp_path):
    path, at = str(tmp_path / "prices"), str(tmp_path / "out")
    seen = []

    def run():
        q = chunks.stream(spark, path).writeStream.format("parquet").option("checkpointLocation", f"{at}-ck").option("path", at).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for k in range(3):
        rows = made(10 + k, [f"{'ABC'[k]}{i}" for i in range(4)])
        seen += rows
        assert chunks.deliver(spark.createDataFrame(rows, chunks.SCHEMA), path, 2) == k
        if k != 1:
            run()
    run()  # nothing new
    assert got(spark.read.schema(chunks.SCHEMA).parquet(at)) == plain(seen) == got(chunks.read(spark, path))


def test_nothing_delivered(spark, tmp_path):
    path = str(tmp_path / "none")
    assert chunks.read(spark, path).collect() == []
    assert chunks.deliver(spark.createDataFrame([], chunks.SCHEMA), path) == 0
    assert chunks.read(spark, path).where(F.col("ticker") == "A").collect() == []
