"""Compaction of the store."""

from pathlib import Path

from panelforge.operators import memory as me


def rows(df):
    return sorted(map(tuple, df.select("alpha_id", "score", "note").collect()), key=str)


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    store = me.Store(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([(i, float(i)) for i in range(40)], "alpha_id long, score double").repartition(4), 1)
    for v in range(2, 7):
        store.upsert(spark.createDataFrame([(i, float(100 * v + i), f"n{v}") for i in range(0, 40, v)] + [(1000 + v, None, None)], "alpha_id long, score double, note string"), v)
    want, files = rows(store.load()), len(list(Path(tmp_path, "s").glob("*.parquet")))
    assert store.compact() == files
    assert rows(store.load()) == want and spark.read.parquet(store.path).count() == len(want)
    store.upsert(spark.createDataFrame([(3, -1.0, "later")], "alpha_id long, score double, note string"), 7)
    assert {r[1:] for r in rows(store.load()) if r[0] == 3} == {(-1.0, "later")}


def test_a_stop_before_the_old_files_go_changes_nothing(spark, tmp_path, monkeypatch):
    store = me.Store(spark, str(tmp_path / "s"))
    for v in (1, 2):
        store.upsert(spark.createDataFrame([(1, float(v), "a"), (v, 0.5, "b")][: v + 1] if v == 2 else [(1, 1.0, "a")], "alpha_id long, score double, note string"), v)
    want = rows(store.load())

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(me, "delete", stop)
        try:
            store.compact()
        except RuntimeError:
            pass
    assert rows(store.load()) == want
    store.compact()
    assert rows(store.load()) == want and spark.read.parquet(store.path).count() == len(want)
