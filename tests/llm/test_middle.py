"""Fill-in-middle: boundary lists, cuts and restored texts against plain slicing."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import middle

SCHEMA = "doc_id long, text string, key string, rid string, salts int"  # key, rid and salts clash with names used inside
ODD = ["", None, "a", "é", "𝔘𝔫𝔦", "a<P>b", "a <S", "<M>", "<", "S><P", "naïve " * 30, "one two three " * 20, "\x00\x7f\u0080߿ࠀ￿", "日本語" * 50]


def expected(doc_id, text):
    x = text or ""
    n = len(x)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not x or any(m in x for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, x
    pre, mid, suf = x[:a], x[a:b], x[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(i, ODD[i % len(ODD)]) for i in range(90)] + [(1000 + i, f"text {i} {'é' * i}") for i in range(40)]
    return out + [(7, ODD[11])] * 3 + [(None, ODD[11]), (None, None), (-5, ODD[12]), (1 << 60, "long id " * 3)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_boundaries_select(text):
    raw = text.encode()
    found = middle.Boundaries(middle.boundaries(raw))
    ends = np.cumsum([0] + [len(c.encode()) for c in text])
    assert found.n == len(text) + 1
    assert [found.select(i) for i in range(found.n)] == ends.tolist()


def test_boundaries_of_a_long_text():
    text = ("aé日𝔘" * 250_000) + "z"
    found = middle.Boundaries(middle.boundaries(text.encode()))
    for i in (0, 1, 2, 3, 4, 511_111, 999_999, 1_000_000, 1_000_001):
        assert found.select(i) == len(text[:i].encode())


@pytest.mark.parametrize("joined", [False, True])
def test_cuts_equal_slicing(spark, rows, monkeypatch, joined):
    monkeypatch.setattr(middle, "GROUP_ROWS", 2)  # several salts for a text
    if joined:  # beyond the broadcast
        monkeypatch.setattr(middle, "checked_broadcast", lambda df: df)
    docs = spark.createDataFrame([(i, t, "k", "r", 1) for i, t in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in middle.transform(docs).collect()]
    assert order(found) == order([expected(i, t) for i, t in rows])


def test_restored_from_output_and_form(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", "r", 1) for i, t in rows], SCHEMA)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = middle.digests(middle.transform(docs)).collect()
    assert order((r.doc_id, r.output_sha256, r.restored_sha256) for r in found) == order((e[0], sha(e[5]), sha(t or "")) for e, (_, t) in ((expected(i, t), (i, t)) for i, t in rows))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM> é", max_size=12), st.integers(0, 400))
def test_marks_cut_in_two_do_not_confuse(text, doc_id):
    raw = text.encode()
    n, form, _, _, made = middle.cut(raw, middle.Boundaries(middle.boundaries(raw)), str(doc_id))
    assert made.decode() == expected(doc_id, text)[5]
    assert middle.restore(made, form) == raw


def test_lists_are_made_once_for_each_shared_text(spark, rows):
    docs = middle.keyed(spark.createDataFrame([(i, t, "k", "r", 1) for i, t in rows], SCHEMA))
    index = middle.text_index(docs.join(middle.shared_keys(docs), "key").select("key", "text", "salts")).collect()
    shared = [t for t in {x or "" for _, x in rows} if sum((x or "") == t for _, x in rows) > 1]
    assert sorted(r.text for r in index) == sorted(shared)
    assert all(r.coded == middle.boundaries(r.text.encode()) for r in index)


def test_empty_table(spark):
    assert middle.digests(middle.transform(spark.createDataFrame([], SCHEMA))).collect() == []
