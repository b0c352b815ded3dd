"""WARC archives over several writes, urls that a header cannot hold, and records that are stepped over."""

import io
from pathlib import Path

import pytest

from panelforge.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows(spark, path, **where):
    df = warc.read(spark, path)
    for c, v in where.items():
        df = df.where(df[c] == v)
    return sorted((r.page_id, r.url, None if r.payload is None else bytes(r.payload).decode()) for r in df.collect())


def test_a_second_write_adds_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "a")
    one, two = [(1, "http://a/", "x"), (2, None, "y")], [(3, "http://b/", "z")]
    warc.write(spark.createDataFrame(one, SCHEMA), path)
    warc.write(spark.createDataFrame(two, SCHEMA), path)
    assert rows(spark, path) == one + two
    warc.register(spark)
    warc.plan(spark.createDataFrame(two, SCHEMA)).write.format("warc").mode("overwrite").save(path)
    assert rows(spark, path) == two
    assert sum(p.name.endswith(".warc.gz") for p in Path(path).iterdir()) == 1


def test_files_without_a_manifest_do_not_count(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame([(1, "http://a/", "x")], SCHEMA), path)
    (tmp_path / "a" / "lost.warc.gz").write_bytes(warc.member(warc.record(9, "http://c/", b"lost", None, False)))
    assert rows(spark, path) == [(1, "http://a/", "x")]


def test_urls_come_back_as_given_and_are_found(spark, tmp_path):
    path = str(tmp_path / "a")
    given = [(i, u, "x" * i) for i, u in enumerate(["http://a/b c", "http://a/b%20c", "http://é/\t\n\"q\"", " ", "", "plain"])]
    warc.write(spark.createDataFrame(given, SCHEMA), path)
    assert rows(spark, path) == sorted(given)
    for i, u, html in given:
        assert rows(spark, path, url=u) == [(i, u, html)]


def test_repeated_rows_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame([(1, "u", "x")] * 3 + [(None, None, None)] * 2, SCHEMA), path)
    found = warc.read(spark, path).collect()
    assert sorted(r.record_type for r in found if r.page_id == 1) == ["response"] * 3 and len(found) == 5
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 5


@pytest.mark.parametrize("seekable", [True, False])
def test_unwanted_records_are_not_read(seekable):
    data = b"".join(warc.member(warc.record(i, "u", bytes(range(256)) * 20_000, None, False), level=0) for i in range(6))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

        def seekable(self):
            return seekable

    reader = warc.WarcReader({"path": "p"})
    reader.tests = [("x-page-id", {"4"})]
    found = list(warc.records(Counted(data), reader.wanted))
    assert [h["x-page-id"] for h, _ in found] == ["4"] and found[0][1].endswith(bytes(range(256)))
    assert (Counted.taken < len(data) / 2) == seekable
