"""Sources cached by year: a wider span of dates fetches only the years that are not there yet.

A fetch writes all tables of the years it covers, partitioned by year, into a folder of its own, and counts once the ledger names
it: year, the day up to which it was fetched, and each table's folder. The ledger is a numbered manifest, so of two loaders that
fetch at once one sees the other's years and starts again from them; readers never meet a half-written year. The tables of a year
come from one fetch, so that they fit each other: if one is missing, all are fetched again, for this year alone.

A span reads the folders of its years only; days outside it are filtered. Rows without a date belong to no year and go. A year
that a source has no rows for is known to be empty and is not asked for again. The year that today lies in is fetched up to
today, and again once a later day is asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import manifests
from panelforge.functions.tables import delete, exists, hadoop_path
from panelforge.sources.loader import PIPELINE_VERSION

TRIES = 10
FETCH, YEAR = "_fetch", "_year"


def runs(years: list[int]) -> list[tuple[int, int]]:
    """Years as runs of neighbours (first, last)."""
    out: list[tuple[int, int]] = []
    for y in sorted(set(years)):
        if out and out[-1][1] == y - 1:
            out[-1] = (out[-1][0], y)
        else:
            out.append((y, y))
    return out


def scanned(df: DataFrame) -> tuple[int, int]:
    """Rows of a scan with filters, and the partitions that it read by the scan's own metrics. Runs the query."""
    plan = df._jdf.queryExecution()
    rows = plan.toRdd().count()
    read, todo = 0, [plan.executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numPartitions")
        if metric.isDefined() and node.children().isEmpty():
            read += metric.get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, read


class YearCache:
    """sources: name to a callable of (start, end) that gives rows of these days; dates: each one's date column, DATE where none is named."""

    def __init__(self, spark: SparkSession, folder: str, sources: dict[str, Callable[[str, str], DataFrame]], dates: dict[str, str] | None = None, version: str = PIPELINE_VERSION, today: date | None = None):
        self.spark, self.sources, self.version, self.today = spark, sources, version, today
        self.folder = f"{folder.rstrip('/')}/{version}"
        self.dates = {t: (dates or {}).get(t, "DATE") for t in sources}
        self.fetched: list[int] = []

    def _now(self) -> date:
        return self.today or date.today()

    def ledger(self) -> dict:
        return manifests.newest(self.spark, f"{self.folder}/ledger") or {"number": 0, "years": {}, "schemas": {}}

    def missing(self, start: str, end: str, ledger: dict | None = None) -> list[int]:
        """The years of the span that have to be fetched."""
        known = (self.ledger() if ledger is None else ledger)["years"]
        last = min(date.fromisoformat(end), self._now())
        out = []
        for y in range(date.fromisoformat(start).year, last.year + 1):
            entry = known.get(str(y))
            whole = entry is not None and set(self.sources) <= set(entry["tables"]) and all(at is None or self._there(t, at, y) for t, at in entry["tables"].items())
            if not whole or date.fromisoformat(entry["through"]) < min(last, date(y, 12, 31)):
                out.append(y)
        return out

    def _there(self, table: str, fetch: str, year: int) -> bool:
        return exists(self.spark, f"{self._at(table)}/{FETCH}={fetch}/{YEAR}={year}")

    def _at(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _fetch(self, years: list[int]) -> tuple[dict, dict]:
        """Ledger entries of the years, and the tables' schemas."""
        entries: dict[str, dict] = {}
        schemas: dict[str, str] = {}
        for first, last in runs(years):
            fetch = uuid.uuid4().hex
            through = min(date(last, 12, 31), self._now())
            for t, source in self.sources.items():
                rows = source(f"{first}-01-01", through.isoformat())
                day = F.to_date(F.col(self.dates[t]))
                schemas[t] = rows.schema.json()
                rows = rows.where(day.between(F.lit(date(first, 1, 1)), F.lit(through))).withColumn(YEAR, F.year(day))
                rows.write.partitionBy(YEAR).parquet(f"{self._at(t)}/{FETCH}={fetch}")
                for y in range(first, last + 1):
                    entry = entries.setdefault(str(y), {"through": min(date(y, 12, 31), through).isoformat(), "tables": {}})
                    entry["tables"][t] = fetch if self._there(t, fetch, y) else None
        return entries, schemas

    def ensure(self, start: str, end: str) -> dict:
        """Fetch what is missing; the ledger that covers the span."""
        ledger = self.ledger()
        entries: dict[str, dict] = {}
        for _ in range(TRIES):
            lack = [y for y in self.missing(start, end, ledger) if str(y) not in entries]
            if not lack and not entries:
                return ledger
            if lack:
                more, schemas = self._fetch(lack)
                entries |= more
                self.fetched += lack
            new = {"number": ledger["number"] + 1, "years": ledger["years"] | entries, "schemas": ledger["schemas"] | schemas}
            try:
                manifests.publish(self.spark, f"{self.folder}/ledger", new)
                return new
            except manifests.Conflict:
                ledger = self.ledger()
        raise manifests.Conflict(f"no free ledger number in {TRIES} tries")

    def load(self, start: str, end: str) -> dict[str, DataFrame]:
        """The tables' rows from start to end, both included."""
        ledger = self.ensure(start, end)
        years = range(date.fromisoformat(start).year, date.fromisoformat(end).year + 1)
        return {t: self._read(t, [(y, e["tables"][t]) for y in years if (e := ledger["years"].get(str(y))) and e["tables"][t]], start, end, ledger["schemas"][t]) if t in ledger["schemas"] else self._none(t) for t in self.sources}

    def _none(self, table: str) -> DataFrame:
        return self.sources[table]("1000-01-01", "1000-01-01").where(F.lit(False))

    def _read(self, table: str, parts: list[tuple[int, str]], start: str, end: str, schema: str) -> DataFrame:
        shape = T.StructType.fromJson(json.loads(schema))
        if not parts:
            return self.spark.createDataFrame([], shape)
        read = self.spark.read.schema(T.StructType([*shape.fields, T.StructField(FETCH, T.StringType()), T.StructField(YEAR, T.IntegerType())])).option("basePath", self._at(table))
        rows = read.parquet(*[f"{self._at(table)}/{FETCH}={fetch}/{YEAR}={y}" for y, fetch in parts])
        return rows.where(F.to_date(F.col(self.dates[table])).between(F.lit(date.fromisoformat(start)), F.lit(date.fromisoformat(end)))).select(*shape.names)

    def vacuum(self) -> list[str]:
        """Delete the fetches that the ledger does not name. Readers that still hold an older ledger lose theirs: run it when none is at work."""
        used = {f for e in self.ledger()["years"].values() for f in e["tables"].values()}
        gone = []
        for t in self.sources:
            at, fs = hadoop_path(self.spark, self._at(t))
            for found in fs.listStatus(at) if fs.exists(at) else []:
                name = found.getPath().getName()
                if name.startswith(f"{FETCH}=") and name.removeprefix(f"{FETCH}=") not in used:
                    delete(self.spark, f"{self._at(t)}/{name}")
                    gone.append(f"{t}/{name}")
        return gone
