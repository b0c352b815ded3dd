"""What the Jaccard join writes: postings and candidates must not grow faster than the corpus."""

import random

import numpy as np
import pytest
from test_llm import SCHEMA, brute_components

from panelforge.llm import jaccard
from panelforge.llm.common import Scratch


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def candidates():
    """Texts of which every two neighbours share nearly half and do not link; some near copies, null and repeated ids."""
    rng = random.Random(5)
    passages = [words(rng, 130) for _ in range(81)]
    rows = [(i, f"{passages[i]} {words(rng, 20)} {passages[i + 1]}") for i in range(80)]
    return rows + [(100 + i, rows[i][1] + " more") for i in range(6)] + [(None, rows[7][1] + " null"), (None, words(rng, 40)), (9, words(rng, 50)), (200, ""), (201, rows[9][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "w") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("owners", [8, 64, 700])
def test_a_posting_takes_eight_bytes_at_most(spark, candidates, owners):
    docs = frame(spark, candidates).select("doc_id", "text").coalesce(1)
    blobs = [bytes(r.blob) for r in jaccard.prefixes(docs, np.zeros(1 << jaccard.SKETCH_BITS), owners).where("kind = 1").select("blob").collect()]
    sets = {jaccard.shingles(t).tobytes() for _, t in candidates if t}
    postings = sum(jaccard.prefix_length(len(s) // 8) for s in sets)
    assert sum(len(b) - 4 for b in blobs) <= 8 * postings
    assert sum(len(jaccard._unpack(b)[0]) for b in blobs) == sum(len(jaccard._unpack(b)[1]) for b in blobs) <= postings


def test_candidates_are_kept_as_bitmaps_only(spark, candidates, tmp_path):
    scratch = Scratch(spark)
    scratch.root = f"file://{tmp_path}"
    jaccard.named_rows(frame(spark, candidates), scratch)
    kept = spark.read.parquet(scratch.path("sets"))
    whole = sum(8 * len(jaccard.shingles(t)) for _, t in candidates)
    assert kept.count() > 80
    held = sum(len(v) if isinstance(v, bytes | bytearray) else 8 for r in kept.collect() for v in r)
    assert held < whole / 8


@pytest.mark.parametrize("bits", [1 << 15, 1 << 26])
def test_many_wanted_rows_are_found_by_a_map_of_bits(spark, candidates, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "MAP_BITS", bits)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    docs = frame(spark, candidates)
    wanted = spark.createDataFrame([(3,), (77,), (-(2**63),)], "rep long")
    assert {r.rep for r in jaccard.texts_of(wanted, docs).collect()} >= {3, 77, -(2**63)}
    assert bits == 1 << 15 or jaccard.texts_of(wanted, docs).count() == 4
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()), key=str)
    assert got == brute_components(candidates)


@pytest.mark.parametrize("bits", [0, 4])
def test_groups_whose_numbers_clash_lose_no_link(spark, candidates, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "GROUP_BITS", bits)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, candidates)).collect()), key=str)
    assert got == brute_components(candidates)


def test_wanted_rows_and_their_sets_take_one_worker_a_task(spark, candidates, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    docs = frame(spark, candidates)
    wanted = spark.createDataFrame([(3,), (77,)], "rep long")
    made = jaccard.texts_of(wanted, docs, jaccard._sets, "cls binary, rep long, n int, bits binary")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {r.rep: r.n for r in made.collect()}[3] == len(jaccard.shingles(candidates[3][1]))


def test_powers_follow_the_texts(monkeypatch):
    monkeypatch.setattr(jaccard, "_powers", [])
    for n in (0, 5, 3000, 900):
        assert all(len(x) >= n for x in jaccard._powers_of(n))
    assert all(len(x) <= 6000 for x in jaccard._powers)
