"""Segmented scans: values carried forward and as-of joins that no single key can overload.

A window over a key holds that key's whole history in one task. Here rows are ranged over (keys, order) into blocks of about
equal size, so a key that half of all rows share takes half of the blocks:

1. each block is filled on its own, in the task that received it;
2. a block hands on one row, what its last key holds at its end, and these rows are scanned over the blocks;
3. rows at the start of a block whose key began in an earlier block, and which have no value of their own yet, take what the
   scan carried in. All other rows are done after step 1.

One shuffle of the rows, one of a row a block. Rows that agree in keys and order keep an order of their own within a run
only; give a tie-breaker where it matters. Keys may be null: a null key is a key here, as it is to a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.tables import kept, shared_folder, small

BLOCK_ROWS = 1_000_000


def _changes(batch: pa.RecordBatch, keys: list[str], last: list | None) -> np.ndarray:
    """Where a row's key differs from that of the row before."""
    out = np.zeros(batch.num_rows, bool)
    for i, k in enumerate(keys):
        col = batch.column(k)
        if last is not None:
            col = pa.concat_arrays([last[i], col])
        a, b = col.slice(0, len(col) - 1), col.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
        out[len(out) - len(differ) :] |= differ
    if last is None:
        out[0] = True
    return out


def _fill(keys: list[str], values: list[str], order: list[str]):
    """Fill the values of a sorted partition; ``_lead`` marks rows of the partition's first key."""

    def fill(batches):
        last, carried, lead = None, {}, True
        for batch in batches:
            if not batch.num_rows:
                continue
            change = _changes(batch, keys, last)
            lead_rows = np.zeros(len(change), bool)
            if lead:
                later = np.flatnonzero(change[1:] if last is None else change)
                end = (int(later[0]) + (last is None)) if len(later) else len(change)
                lead_rows[:end], lead = True, not len(later)
            at = np.arange(len(change))
            begin = np.maximum.accumulate(np.where(change, at, -1))  # -1: goes on from the batch before
            columns = list(batch.columns)
            for v in values:
                col = batch.column(v)
                found = np.maximum.accumulate(np.where(col.is_valid().to_numpy(zero_copy_only=False), at, -1))
                found = np.where(found >= begin, found, -2)
                found = np.where((found < 0) & (begin < 0), -1, found)  # -1: what was carried; -2: nothing
                source = pa.concat_arrays([carried.get(v, pa.nulls(1, col.type)), col])
                columns.append(source.take(pa.array(found + 1, mask=found < -1)))
                carried[v] = columns[-1].slice(len(change) - 1)
            last = [batch.column(k).slice(len(change) - 1) for k in keys]
            columns.append(pa.array(lead_rows))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[f"_filled_{v}" for v in values], "_lead"])

    return fill


def fill_forward(df: DataFrame, keys: list[str], order: list[str], values: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with each of ``values`` replaced by the key's last value that is not null, at or before the row in ``order``."""
    spark = df.sparkSession
    rows = kept(df, shared_folder(spark, "segments-in"))
    n = rows.count()
    if not n:
        return rows
    blocks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), n), -(-n // block_rows))
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranged = rows.repartitionByRange(blocks, *sort).sortWithinPartitions(*sort)
    added = [T.StructField(f"_filled_{v}", rows.schema[v].dataType) for v in values] + [T.StructField("_lead", T.BooleanType())]
    filled = ranged.mapInArrow(_fill(keys, values, order), T.StructType([*rows.schema.fields, *added])).withColumn("_block", F.spark_partition_id())
    filled = kept(filled, shared_folder(spark, "segments"))
    key, held = F.struct(*keys), F.struct(*[f"_filled_{v}" for v in values])
    ends = filled.groupBy("_block").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(held, F.struct(*keys, *order)).alias("held"))
    out = ends.select(F.col("last").alias("key"), "_block", F.lit(1).alias("kind"), "held")
    into = ends.select(F.col("first").alias("key"), "_block", F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["held"].dataType).alias("held"))
    so_far = Window.partitionBy("key").orderBy("_block", "kind").rowsBetween(Window.unboundedPreceding, 0)  # one row a block
    carry = out.unionByName(into).select("_block", "kind", *[F.last(f"held._filled_{v}", ignorenulls=True).over(so_far).alias(f"_carried_{v}") for v in values]).where("kind = 0").drop("kind")
    open_ = F.col("_lead") & F.lit(False)
    for v in values:
        open_ = open_ | (F.col("_lead") & F.col(f"_filled_{v}").isNull())
    done = lambda x, carried: x.select(*[F.coalesce(f"_filled_{c}", f"_carried_{c}").alias(c) if carried and c in values else F.col(f"_filled_{c}").alias(c) if c in values else F.col(c) for c in rows.columns])
    taken = filled.where(open_).join(small(carry), "_block", "left")
    return done(filled.where(~open_), False).unionByName(done(taken, True))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, ties: list[Column] | None = None, strict: bool = False, tolerance: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of left with the right row of the same keys whose time is the last at or before theirs (before, if ``strict``).

    ``ties`` (columns of right) decide between right rows of one time: the greatest wins, nulls first. ``tolerance`` is the longest
    interval back. The right row's columns other than the keys come along, null where nothing is found. Rows of left with
    a null key or time find nothing; such rows of right are never found. No range join and no window over a key.
    """
    taken = [c for c in right.columns if c not in keys]
    clash = [c for c in taken if c in left.columns]
    if clash:
        raise ValueError(f"both sides have columns {clash}; rename one")
    known = lambda time: F.lit(True) if not keys else F.col(keys[0]).isNotNull() & F.col(time).isNotNull()
    for k in keys[1:]:
        known = (lambda f, k: lambda time: f(time) & F.col(k).isNotNull())(known, k)
    row = F.struct(*taken)
    nothing = F.lit(None).cast(T.StructType([right.schema[c] for c in taken]))
    tie = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)]) if ties else F.struct(F.lit(0).alias("t0"))
    found = right.where(known(right_time)).select(*keys, F.col(right_time).alias("_time"), F.lit(1 if strict else 0).alias("_side"), tie.alias("_tie"), row.alias("_right"), F.lit(None).cast(left.schema.simpleString()).alias("_left"))
    asked = left.where(known(left_time)).select(*keys, F.col(left_time).alias("_time"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(found.schema["_tie"].dataType).alias("_tie"), nothing.alias("_right"), F.struct(*left.columns).alias("_left"))
    filled = fill_forward(found.unionByName(asked), keys, ["_time", "_side", "_tie"], ["_right"], block_rows).where("_left is not null")
    match = F.col("_right")
    if tolerance is not None:
        match = F.when(F.col("_time") - F.col(f"_right.{right_time}") <= tolerance, match)
    out = filled.withColumn("_right", match).select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in taken])
    rest = left.where(~F.coalesce(known(left_time), F.lit(False))).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in taken])
    return out.unionByName(rest)
