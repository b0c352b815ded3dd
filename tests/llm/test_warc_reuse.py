"""One frame of an archive, used with different filters."""

import pytest

from panelforge.llm import warc


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reuse") / "w")
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i % 3 + 1)) for i in range(12)] + [(None, None, None)], "page_id long, url string, html string")
    warc.write(pages, path, 0)
    return path


@pytest.mark.parametrize("after_pushdown", [False, True])
def test_a_frame_can_be_used_again(spark, archive, after_pushdown):
    if after_pushdown:
        assert warc.read(spark, archive, pushdown=True).where("record_type = 'revisit'").count() == 9
    df = warc.read(spark, archive)
    response, revisit = df.where("record_type = 'response'"), df.where("record_type = 'revisit'")
    assert [df.count(), revisit.count(), df.count(), df.where("record_type like '%pons%'").count()] == [13, 9, 13, 4]
    assert response.union(revisit).count() == 13
    assert response.select("payload_digest").join(revisit.select("payload_digest"), "payload_digest").count() == 9


def test_predicates_of_the_read(spark, archive):
    some = warc.read(spark, archive, only={"record_type": ["revisit"], "refers_to": [0, 1]})
    assert sorted(r.page_id for r in some.collect()) == [3, 4, 6, 7, 9, 10]
    assert sorted(r.page_id for r in some.where("page_id > 4").union(some.where("page_id = 3")).collect()) == [3, 6, 7, 9, 10]
    assert warc.read(spark, archive, only={"record_type": []}).collect() == []
    assert [r.page_id for r in warc.read(spark, archive, "skip", {"url": ["http://a/5"]}).collect()] == [5]


def test_an_unknown_column_is_an_error(spark, archive):
    with pytest.raises(Exception, match="html"):
        warc.read(spark, archive, only={"html": ["x"]}).collect()
