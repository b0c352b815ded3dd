"""Exact dedup (9): Golomb-coded fingerprint exchange, then byte verification of the suspects only.

1. Every row gets a 64-bit fingerprint and the SHA-256 of its text without white space, and a sender (a block of at
   most about ``SENDER_ROWS`` rows). These fixed-size rows are written once; all later steps read that table.
2. A sender sorts its distinct fingerprints, cuts them by owner (a range of the fingerprint space) and sends each owner
   one Golomb-Rice coded list.
3. An owner (one for ``OWNER_ROWS`` rows, so fewer than senders) decodes the lists, finds the fingerprints that two senders
   hold, and returns to each sender a bitmap over that sender's list. A fingerprint appears once a list, so a third of all
   rows being copies adds one entry a sender.
4. Senders mark their suspects. Only those rows go on: their texts are grouped by the bytes themselves (a partial
   aggregate, so copies collapse before the shuffle), and groups are attached to rows by (digest, salt).

Defined results: null text counts as empty, so all null, empty and blank texts are one group. Of equal texts the row
with the most code points stays, then the smallest doc_id (a null doc_id after all others), then the first in table
order, so of fully repeated rows exactly one is kept. Columns beside doc_id and text are not read by ``groups`` and
pass ``keep`` unchanged. Were two different texts to share a SHA-256, the job fails loudly rather than merge them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import Scratch, checked_broadcast, id_back, id_parts, salt_of, ship, without_space

SENDER_ROWS, OWNER_ROWS = 250_000, 2_000_000
SALTS = 64


def rice_encode(values: np.ndarray) -> bytes:
    """A sorted list of distinct uint64 as Golomb-Rice coded gaps: header, unary quotients, fixed-width remainders."""
    n = len(values)
    if not n:
        return np.array([0, 0, 0], "<u8").tobytes()
    gaps = np.diff(values, prepend=values[:1])
    mean = max(1, int(values[-1] - values[0]) // n)
    k = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    return np.array([n, k, values[0]], "<u8").tobytes() + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    n, k, first = (int(x) for x in np.frombuffer(data, "<u8", 3))
    if not n:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(data, np.uint8, offset=24)
    rest_bytes = (n * k + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[: len(body) - rest_bytes]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(body[len(body) - rest_bytes :], count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps[0] = 0
    return np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)


def _send(owners: int):
    width = np.uint64((1 << 64) // owners + 1)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        cuts = np.searchsorted(values // width, np.arange(owners + 1, dtype=np.uint64))
        full = [o for o in range(owners) if cuts[o] < cuts[o + 1]]
        return pd.DataFrame({"sender": [int(pdf["sender"].iloc[0])] * len(full), "owner": full, "coded": [rice_encode(values[cuts[o] : cuts[o + 1]]) for o in full]})

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps: of each sender's list, the fingerprints that another sender holds too."""
    lists = [rice_decode(x) for x in pdf["coded"]]
    every = np.sort(np.concatenate(lists))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    maps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bits": maps})


def _mark(owners: int):
    width = np.uint64((1 << 64) // owners + 1)

    def mark(rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        values, at, n = np.unique(rows["fp"].to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
        cuts = np.searchsorted(values // width, np.arange(owners + 1, dtype=np.uint64))
        suspect = n > 1
        for owner, bits in zip(maps["owner"], maps["bits"], strict=True):
            a, b = cuts[owner], cuts[owner + 1]
            suspect[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
        return rows.drop(columns="sender").assign(suspect=suspect[at])

    return mark


def flagged(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, doc_id, n_chars, fp, sha (32 bytes) and suspect, a row for each document."""
    norm = without_space(F.col("text"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        *id_parts(F.col("doc_id")),
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        F.xxhash64(norm).alias("fp"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
    )
    rows = scratch.table(rows, "fingerprints")
    n = rows.count()
    senders = max(4, -(-n // SENDER_ROWS))
    owners = max(4, -(-n // OWNER_ROWS))  # lists are senders times owners
    rows = rows.withColumn("sender", F.pmod(F.xxhash64("rid"), F.lit(senders)).cast("int"))
    sent = rows.select("sender", "fp").groupBy("sender").applyInPandas(_send(owners), "sender int, owner int, coded binary")
    maps = sent.groupBy("owner").applyInPandas(_answer, "sender int, owner int, bits binary")
    marked = rows.groupBy("sender").cogroup(maps.groupBy("sender")).applyInPandas(_mark(owners), "rid long, doc_id long, no_id boolean, n_chars int, fp long, sha binary, suspect boolean")
    return scratch.table(marked.select("rid", id_back(), "n_chars", "fp", "sha", "suspect"), "marked")


def groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each document: rid, doc_id, n_chars, fp, keep_id, group_size, kept, sha."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    marked = flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    alone = marked.where("not suspect").select("rid", "doc_id", "n_chars", "fp", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    suspects = marked.where("suspect").withColumn("salt", salt_of("rid", salts=SALTS))

    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inv_id"), F.bitwise_not("rid").alias("inv_rid")))
    part = suspects.groupBy("sha", "salt").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("sha")
    classes = part.select("sha", "salt", F.max("best").over(whole).alias("best"), F.sum("n").over(whole).alias("group_size"))

    # bytes: the texts of suspects, grouped by content; each task sends a text once
    hot = checked_broadcast(suspects.select("fp").distinct())
    norm = without_space(F.col("text"))
    texts = docs.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm")).join(hot, "fp", "left_semi")
    variants = texts.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "norm").distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("variants"))
    classes = classes.join(variants, "sha").withColumn("group_size", F.when(F.col("variants") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))))
    classes = scratch.table(classes.drop("variants"), "classes")
    found = suspects.join(classes, ["sha", "salt"]).select("rid", "doc_id", "n_chars", "fp", F.bitwise_not("best.inv_id").alias("keep_id"), "group_size", (F.bitwise_not("best.inv_rid") == F.col("rid")).alias("kept"), "sha")
    return alone.unionByName(found)


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Dropped groups are few against all rows, so rows are told apart by (doc_id, fp, n_chars): a row stays unless that
    key is only among the dropped; of fully equal keys one row stays.
    """
    out = groups(docs)
    lost = out.where("not kept").select("doc_id", "fp", "n_chars").distinct()
    names = docs.columns
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("k_id"), F.xxhash64(without_space(F.col("row.text"))).alias("k_fp"), F.length(F.coalesce("row.text", F.lit(""))).alias("k_n")
    )
    # keys that a kept and a dropped row share: fully repeated rows, of which one stays
    both = out.where("kept").select("doc_id", "fp", "n_chars").join(lost, [out.doc_id.eqNullSafe(lost.doc_id), out.fp == lost.fp, out.n_chars == lost.n_chars], "left_semi")
    lost = lost.join(both, [lost.doc_id.eqNullSafe(both.doc_id), lost.fp == both.fp, lost.n_chars == both.n_chars], "left_anti").withColumn("repeated", F.lit(False)).unionByName(both.withColumn("repeated", F.lit(True)))
    lost = checked_broadcast(lost)
    joined = key.join(lost, [key.k_id.eqNullSafe(lost.doc_id), key.k_fp == lost.fp, key.k_n == lost.n_chars], "left")
    unique = joined.where("repeated is null").select("row.*")
    once = joined.where("repeated").groupBy("k_id", "k_fp", "k_n").agg(F.first("row").alias("row")).select("row.*")
    return unique.unionByName(once)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as norm
  from documents
), r as (
  select doc_id, norm,
    first_value(doc_id) over w as keep_id,
    count(*) over (partition by norm) as group_size,
    row_number() over w = 1 as kept
  from t window w as (partition by norm order by length(text) desc, doc_id)
)
select doc_id, keep_id, group_size, kept, sha256(norm) as text_sha256 from r
"""
