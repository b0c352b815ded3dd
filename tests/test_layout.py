"""Ring layout where one ring holds most records."""

import math
import random

import pytest

from panelforge.operators import memory as me


def test_a_hot_ring_is_numbered_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 10 else f"b{i % 3}", rng.randrange(500)) for i in range(3000)]
    df = me.rings(spark.createDataFrame(rows, "alpha_id long, batch_id string, timestamp long"))
    got = {r.alpha_id: (r.ring, r.x, r.y) for r in me.layout(df).collect()}
    ring = {r.alpha_id: r.ring for r in df.collect()}
    assert len(got) == 3000
    for k in set(ring.values()):
        inside = sorted((t, i) for i, _, t in rows if ring[i] == k)
        for n, (_, i) in enumerate(inside):
            a = 2 * math.pi * n / len(inside)
            assert got[i] == pytest.approx((k, (100 + 160 * k) * math.cos(a), (100 + 160 * k) * math.sin(a)), abs=1e-6)


def test_no_records(spark):
    assert me.layout(me.rings(spark.createDataFrame([], "alpha_id long, batch_id string, timestamp long"))).collect() == []
