"""The closest record of many candidates against the comparison of every pair."""

import random

import pytest

from panelforge.functions import formulas as fm
from panelforge.operators import similarity

COLS = ["CFO_LTM", "REVENUE_LTM", "ADJUSTED_PRICE", "ADJUSTED_VOLUME", "DA_LTM", "COGS_LTM", "NET_INCOME_LTM", "EPS_DILUTED"]
CALLS = ["rank", "zscore", "sign", "log", "abs", "scale"]
WINDOWED = ["ts_mean", "ts_std", "delta", "ts_zscore", "ts_rank", "decay_linear"]


def formula(rng, depth=0):
    k = rng.random()
    if depth > 2 or k < 0.2:
        return rng.choice(COLS)
    if k < 0.5:
        return f"{rng.choice(CALLS)}({formula(rng, depth + 1)})"
    if k < 0.75:
        return f"{rng.choice(WINDOWED)}({formula(rng, depth + 1)}, {rng.choice([5, 10, 20])})"
    return f"({formula(rng, depth + 1)} {rng.choice('+-*/')} {formula(rng, depth + 1)})"


def rows(rng, n, odd):
    out = []
    for i in range(n):
        f = formula(rng)
        feats = rng.choice([None, [], rng.sample(COLS, rng.randint(1, 3))])
        out.append((i, f, feats, f"2026-01-01T{(n - i) % n:06d}"))
    return out + [(n + j, f, ["DA_LTM"], f"2027-{j:03d}") for j, f in enumerate(odd)]


def brute(candidates, store):
    out = []
    for cid, f, feats, _ in candidates:
        found = []
        for rid, g, theirs, order in store:
            exact = fm.canonical(f or "") is not None and fm.canonical(f or "") == fm.canonical(g or "")
            s = 1.0 if exact else fm.structural(f or "", g or "")
            c = fm.set_jaccard(fm.columns(f or ""), fm.columns(g or ""))
            a, b = set(feats or []), set(theirs or [])
            score = 0.4 * fm.set_jaccard(a, b) + 0.4 * s + 0.2 * c if a and b else (0.4 * s + 0.2 * c) / 0.6
            found.append((s, score, exact, order, rid))
        s, c = max(x[0] for x in found), max(x[1] for x in found)
        sid = min((x[3], x[4]) for x in found if x[0] == s)[1]
        cid_ = min((x[3], x[4]) for x in found if abs(x[1] - c) < 1e-12)[1]
        any_exact = any(x[2] for x in found)
        unique = not (any_exact or s >= fm.DUPLICATE)
        out.append((cid, unique, any_exact, cid_ if unique else sid, round(c, 4), round(s, 4)))
    return sorted(out)


SCHEMA = "{} long, formula string, features array<string>, timestamp string"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_comparison_of_every_pair(spark, seed):
    rng = random.Random(seed)
    store = rows(rng, 400, ["rank(CFO_LTM", "", None, "foo(", "-(CFO_LTM / ADJUSTED_PRICE)"])
    candidates = rows(rng, 60, ["rank(CFO_LTM", "CFO_LTM / ADJUSTED_PRICE", "", None, "rank(rank(UNSEEN", "xyz", "2 * 3"])
    verdict, compared = similarity.closest(spark.createDataFrame(candidates, SCHEMA.format("candidate_id")), spark.createDataFrame(store, SCHEMA.format("alpha_id")).repartition(3))
    got = sorted(tuple(r) for r in verdict.collect())
    want = brute(candidates, store)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1.1e-4), (g, w, candidates[g[0]])
    assert compared.count() < 0.5 * len(store) * len(candidates)


def test_far_fewer_pairs_than_the_product(spark):
    rng = random.Random(5)
    store = rows(rng, 2000, [])
    candidates = [(i, f, feats, o) for i, (_, f, feats, o) in enumerate(rows(rng, 150, []) + rng.sample(store, 50))]
    verdict, compared = similarity.closest(spark.createDataFrame(candidates, SCHEMA.format("candidate_id")), spark.createDataFrame(store, SCHEMA.format("alpha_id")))
    assert sum(r.is_exact_duplicate for r in verdict.collect()) >= 50
    assert compared.count() < 0.2 * len(store) * len(candidates)


def test_empty_store_and_no_candidates(spark):
    empty = spark.createDataFrame([], SCHEMA.format("alpha_id"))
    one = spark.createDataFrame([(1, "rank(CFO_LTM)", None, "t")], SCHEMA.format("candidate_id"))
    verdict, _ = similarity.closest(one, empty)
    assert [tuple(r) for r in verdict.collect()] == [(1, True, False, None, 0.0, 0.0)]
    verdict, _ = similarity.closest(one.limit(0), one.withColumnRenamed("candidate_id", "alpha_id"))
    assert verdict.collect() == []


def test_copies_are_compared_once(spark):
    """Pairs follow the different formulas, not the rows; of copies the earliest record is the answer of every copy of a candidate."""
    rng = random.Random(8)
    kinds = list({f: (f, feats) for _, f, feats, _ in rows(rng, 12, [])}.values())
    store = [(i, *kinds[i % len(kinds)], f"t{(997 * i) % 600:04d}") for i in range(600)]
    candidates = [(i, f, feats[::-1] if feats else feats, "t") for i in range(150) for f, feats in [kinds[i % len(kinds)]]]
    verdict, compared = similarity.closest(spark.createDataFrame(candidates, SCHEMA.format("candidate_id")), spark.createDataFrame(store, SCHEMA.format("alpha_id")).repartition(3))
    got = sorted(tuple(r) for r in verdict.collect())
    for g, w in zip(got, brute(candidates, store), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1.1e-4), (g, w)
    assert compared.count() <= len(kinds) ** 2
