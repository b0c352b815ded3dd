"""A cache by year against plain filters."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import manifests
from panelforge.functions.tables import delete
from panelforge.sources import years

TODAY = datetime.date(2024, 6, 30)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    days = [datetime.date(2018, 1, 1) + datetime.timedelta(rng.randrange(2400)) for _ in range(600)]
    days = [d for d in days if d.year != 2021] + [None, datetime.date(2019, 12, 31), datetime.date(2020, 1, 1)]
    return spark.createDataFrame([(d, i, f"x{i % 3}" if i % 7 else None) for i, d in enumerate(days)], "DATE date, id int, fetch string").cache()


def cache(spark, rows, folder, **more):
    asked = []

    def source(start, end):
        asked.append((start, end))
        return rows.where(F.col("DATE").between(start, end) | F.col("DATE").isNull())

    made = years.YearCache(spark, str(folder), {"a": source, "b": lambda s, e: source(s, e).select(F.col("DATE").alias("day"), "id")}, {"b": "day"}, today=more.pop("today", TODAY), **more)
    made.asked = asked
    return made


def ids(df):
    return sorted(r.id for r in df.collect())


def want(rows, start, end):
    return ids(rows.where(F.col("DATE").between(start, end)))


def test_only_missing_years_are_fetched(spark, rows, tmp_path):
    c = cache(spark, rows, tmp_path)
    for start, end, fetched in [("2019-03-01", "2020-02-01", [2019, 2020]), ("2019-01-01", "2020-12-31", []), ("2018-05-05", "2022-01-01", [2018, 2021, 2022]), ("2021-01-01", "2021-12-31", [])]:
        before = len(c.fetched)
        got = c.load(start, end)
        assert c.fetched[before:] == fetched
        assert ids(got["a"]) == ids(got["b"]) == want(rows, start, end)
        assert got["a"].columns == rows.columns and got["b"].columns == ["day", "id"]
    assert [a for a in c.asked[::2]] == [("2019-01-01", "2020-12-31"), ("2018-01-01", "2018-12-31"), ("2021-01-01", "2022-12-31")]


def test_partitions_outside_the_span_are_not_read(spark, rows, tmp_path):
    c = cache(spark, rows, tmp_path)
    c.load("2018-01-01", "2023-12-31")
    got = c.load("2019-06-01", "2020-06-01")["a"]
    assert years.scanned(got) == (len(want(rows, "2019-06-01", "2020-06-01")), 2)


def test_the_open_year_is_fetched_again(spark, rows, tmp_path):
    cache(spark, rows, tmp_path).load("2024-01-01", "2024-12-31")
    same = cache(spark, rows, tmp_path)
    assert ids(same.load("2024-01-01", "2030-01-01")["a"]) == want(rows, "2024-01-01", "2024-06-30") and same.fetched == []
    later = cache(spark, rows, tmp_path, today=datetime.date(2024, 7, 20))
    assert ids(later.load("2024-01-01", "2024-12-31")["a"]) == want(rows, "2024-01-01", "2024-07-20") and later.fetched == [2024]
    assert len(later.vacuum()) == 2 and ids(later.load("2024-01-01", "2024-12-31")["a"]) == want(rows, "2024-01-01", "2024-07-20")


def test_one_lost_table_fetches_its_year_alone(spark, rows, tmp_path):
    c = cache(spark, rows, tmp_path)
    c.load("2018-01-01", "2020-12-31")
    delete(spark, f"{c.folder}/b/_fetch={c.ledger()['years']['2019']['tables']['b']}/_year=2019")
    assert c.missing("2018-01-01", "2020-12-31") == [2019]
    assert ids(c.load("2018-01-01", "2020-12-31")["b"]) == want(rows, "2018-01-01", "2020-12-31")


def test_versions_do_not_share(spark, rows, tmp_path):
    cache(spark, rows, tmp_path).load("2019-01-01", "2019-12-31")
    other = cache(spark, rows, tmp_path, version="next")
    other.load("2019-01-01", "2019-12-31")
    assert other.fetched == [2019]


def test_two_loaders_at_once(spark, rows, tmp_path, monkeypatch):
    c, d = cache(spark, rows, tmp_path), cache(spark, rows, tmp_path)
    fetch = c._fetch

    def slow(lack):
        out = fetch(lack)
        if not d.fetched:
            d.load("2020-01-01", "2020-12-31")
        return out

    monkeypatch.setattr(c, "_fetch", slow)
    assert ids(c.load("2019-01-01", "2019-12-31")["a"]) == want(rows, "2019-01-01", "2019-12-31")
    assert set(c.ledger()["years"]) == {"2019", "2020"} and manifests.numbers(spark, f"{c.folder}/ledger") == [1, 2]


def test_nothing_there(spark, rows, tmp_path):
    c = cache(spark, rows.where("false"), tmp_path)
    assert c.load("2019-01-01", "2020-01-01")["a"].collect() == []
    assert c.load("2019-01-01", "2020-01-01")["b"].columns == ["day", "id"] and c.fetched == [2019, 2020]
    assert cache(spark, rows, tmp_path / "later").load("2025-01-01", "2026-01-01")["a"].columns == rows.columns


def test_runs():
    assert years.runs([2003, 2001, 2002, 2006, 2006]) == [(2001, 2003), (2006, 2006)] and years.runs([]) == []
