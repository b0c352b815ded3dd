"""Queries of the engine against their DuckDB SQL on small driver tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from panelforge import queries, queries_research, queries_sources
from panelforge.streaming import arrivals
from panelforge.streaming import events as streaming

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHECKED = ["io01_panel_load", "io09_store_upsert", "etl10_business_days", "etl15_statement_join", "cs01_rank", "cs17_group_rank", "ts05_ts_std", "ts12_ts_corr", "ta01_ema", "ta04_rsi", "ex02_comparisons", "bt01_calendar", "sc09_composite", "sc14_weakest", "me04_failure_category", "ba02_arms", "gr04_ancestors", "gr05_layout"]
SQL = queries.oracle_sql() | queries_sources.oracle_sql() | queries_research.oracle_sql()
QUERIES = queries.queries() | queries_sources.queries() | queries_research.queries()
CHECKED += [k for k in SQL if k not in CHECKED and (k in queries_sources.queries() or k in queries_research.queries() or k in ("flagship_slice", "bt12_metrics", "bt17_turnover", "bt02b_strict_periods", "experiment_batch", "etl18_assemble", "st_sessions", "st_windows"))]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    return sorted((tuple(plain(v) for v in r) for r in data), key=str), sorted(names)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    # prices at the smallest scale stand still for weeks: a price over its mean is 1 up to the order of the sum, and ranks of such ties are noise
    sf = SF.replace("sf0.001", "sf0.01") if name == "flagship_slice" else SF
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [[r[c] for c in cols] for r in df.collect()]
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = [[r[names.index(c)] for c in cols] for r in found.fetchall()]
    assert rows(cols, got) == rows(names, want)
    assert got


def test_every_query_has_a_name_in_lower_case():
    assert all(k == k.lower() for k in QUERIES)
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) == sum(len(m.queries()) for m in (queries, queries_sources, queries_research))


def test_sessions_cover_every_event_in_time(spark):
    """Sessions given out, sessions still open at the end and late events make up all events."""
    delay = datetime.timedelta(hours=streaming.SESSION_DELAY_HOURS)
    gap = datetime.timedelta(minutes=30)
    events = arrivals.arriving(spark.read.parquet(f"{SF}/events.parquet")).select("event_id", "user_id", "ts", "slice").collect()
    newest, seen, mark = {}, None, datetime.datetime(1970, 1, 1)
    for k in range(arrivals.SLICES):
        newest[k] = mark  # by the slices up to k - 2
        if k and any(r.slice == k - 1 for r in events):
            seen = max(r.ts for r in events if r.slice < k)
            mark = seen.replace(microsecond=seen.microsecond // 1000 * 1000) - delay
    last = max(r.ts for r in events)
    last = last.replace(microsecond=last.microsecond // 1000 * 1000) - delay
    late = [r for r in events if r.ts <= newest[r.slice]]
    open_ = closed = 0
    for user in {r.user_id for r in events}:
        times = sorted(r.ts for r in events if r.user_id == user and r.ts > newest[r.slice])
        while times:
            n = 1
            while n < len(times) and times[n] < times[n - 1] + gap:
                n += 1
            if times[n - 1] + gap <= last:
                closed += 1
            else:
                open_ += n
            times = times[n:]
    got = [r.n for r in QUERIES["st_sessions"](spark, SF).collect()]
    assert len(late) > 0 and len(got) == closed
    assert sum(got) + open_ + len(late) == len(events)
