"""Token-ID output (5): shard files compressed by Re-Pair grammars.

A shard holds the ids of consecutive documents (ascending doc_id), each ended by the end id. Rounds replace the most
frequent pairs of neighbours by new symbols, up to ``A_ROUND`` a round, each counted again once the others have taken their
places, until a round gains less than ``GAIN`` of the length or the rule limit is met. A file stores the rules, every
symbol's expansion length, checkpoints of decoded positions, the symbols packed to the needed bits by planes, and the
documents' ids and lengths: any range of ids decodes from the checkpoint before it.

Files are written by the tasks under names of their own; only files in the returned manifest are read, so lost or
repeated tasks do no harm. Defined results: null text is empty and gets the end id alone; a null doc_id sorts first;
rows with equal doc_id follow each other by content and each has its own range; an empty table has no files and no rows. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import Scratch, id_parts, parallelism, ship
from panelforge.llm.tokens import tokenised, vocabulary
from panelforge.llm.warc import filesystem

END_ID = 2
SHARD_IDS = 1_000_000
FIRST_RULE = 65_536
MAX_RULES = 4096
A_ROUND = 2048
MIN_COUNT = 24
GAIN = 0.005
CHECKPOINT = 4096
MAGIC = b"RPG1"


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.intp)


def _round(seq: np.ndarray, first: int, room: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: (the sequence with the chosen pairs replaced, the pairs as keys in the order of their symbols from `first`).

    Chosen are the most frequent pairs by exact count. Pairs that overlap take places from each other, so counts are taken
    again after all have been placed from left to right: a pair left with fewer than `least` places is put back.
    """
    keys = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
    slots = _slots(keys)
    places = np.flatnonzero((np.bincount(slots, minlength=1 << 20) >= least)[slots])
    keys, slots = keys[places], slots[places]
    found, n = np.unique(keys, return_counts=True)
    found, n = found[n >= least], n[n >= least]
    pairs = found[np.lexsort((found, -n))[:room]]
    if not len(pairs):
        return seq, pairs
    table = np.full(1 << 20, -1, np.int32)
    table[_slots(pairs)] = np.arange(len(pairs))
    rank = table[slots]
    held = np.flatnonzero(rank >= 0)
    places, keys, rank = places[held], keys[held], rank[held].astype(np.intp)
    other = np.flatnonzero(pairs[rank] != keys)  # not chosen, or chosen with another pair of the same slot
    order = np.argsort(pairs)
    at = np.searchsorted(pairs[order], keys[other])
    at[at == len(pairs)] = 0
    rank[other] = order[at]
    same = pairs[rank] == keys
    hit, rank = places[same], rank[same]
    starts = np.r_[True, np.diff(hit) > 1]  # of neighbouring hits, every other one from the first
    run = hit[np.flatnonzero(starts)][np.cumsum(starts) - 1]
    apart = (hit - run) % 2 == 0
    hit, rank = hit[apart], rank[apart]
    enough = np.bincount(rank, minlength=len(pairs)) >= least
    kept = enough[rank]
    hit, rank = hit[kept], (np.cumsum(enough) - 1)[rank[kept]]
    out = seq.copy()
    out[hit] = first + rank
    keep = np.ones(len(seq), bool)
    keep[hit + 1] = False
    return out[keep], pairs[enough]


def compress(ids: np.ndarray, max_rules: int = MAX_RULES, a_round: int = A_ROUND, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[k] are the two symbols that FIRST_RULE + k stands for."""
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    before = 2 * len(seq)
    while len(rules) < max_rules and len(seq) > 1 and before - len(seq) >= GAIN * before:
        before = len(seq)
        seq, pairs = _round(seq, FIRST_RULE + len(rules), min(a_round, max_rules - len(rules)), least)
        rules = np.concatenate([rules, np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)])
    return seq, rules


def lengths_of(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - FIRST_RULE] if a >= FIRST_RULE else 1) + (out[b - FIRST_RULE] if b >= FIRST_RULE else 1))
    return np.array(out, np.uint32)


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every rule one after the other, and where each begins (with the end as the last)."""
    out: list[list[int]] = []
    for a, b in rules.tolist():
        out.append((out[a - FIRST_RULE] if a >= FIRST_RULE else [a]) + (out[b - FIRST_RULE] if b >= FIRST_RULE else [b]))
    return np.array([x for ids in out for x in ids], np.uint32), np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)


def expand(seq: np.ndarray, rules: np.ndarray, flat: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The ids of symbols, all at once: plain symbols stand for themselves in a table beside the rules' expansions."""
    ids, starts = flat or expansions(rules)
    high = seq >= FIRST_RULE
    n = np.ones(len(seq), np.int64)
    rule = seq[high].astype(np.int64) - FIRST_RULE
    n[high] = many = np.diff(starts)[rule]
    begin = np.cumsum(n) - n
    out = np.repeat(seq, n)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out[inner + np.repeat(begin[high], many)] = ids[inner + np.repeat(starts[rule], many)]
    return out


def _planes(bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the planes that symbols are cut into: whole bytes, then single bits."""
    whole = 16 if bits >= 16 else 8 if bits >= 8 else 0
    return [(0, whole)] * (whole > 0) + [(b, 1) for b in range(whole, bits)]


def pack(seq: np.ndarray, bits: int) -> bytes:
    """Symbols as planes, one after the other, together `bits` bits a symbol."""
    out = []
    for first, n in _planes(bits):
        part = (seq >> np.uint32(first)) & np.uint32((1 << n) - 1)
        out.append(np.packbits(part.astype(np.uint8)).tobytes() if n == 1 else part.astype(f"<u{n // 8}").tobytes())
    return b"".join(out)


def unpack(data, bits: int, n: int, a: int, b: int) -> np.ndarray:
    """Symbols a to b of n, reading only their part of each plane."""
    out, at = np.zeros(max(0, b - a), np.uint32), 0
    for first, width in _planes(bits):
        if width == 1:
            low = a // 8
            part = np.unpackbits(np.frombuffer(data, np.uint8, -(-b // 8) - low, at + low))[a - 8 * low : b - 8 * low] if b > a else out
            at += -(-n // 8)
        else:
            part = np.frombuffer(data, f"<u{width // 8}", b - a, at + a * width // 8)
            at += n * width // 8
        out |= part.astype(np.uint32) << np.uint32(first)
    return out


def write_shard(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """A shard file. doc_ids may hold None."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    seq, rules = compress(every)
    spans = lengths_of(rules)
    each = np.ones(len(seq), np.int64)
    high = seq >= FIRST_RULE
    each[high] = spans[seq[high] - FIRST_RULE]
    marks = (np.cumsum(each) - each)[::CHECKPOINT].astype("<u8")
    bits = max(1, int(seq.max()).bit_length()) if len(seq) else 1
    head = json.dumps({"docs": len(ids), "ids": len(every), "symbols": len(seq), "rules": len(rules), "bits": bits, "nulls": [i for i, d in enumerate(doc_ids) if d is None]}).encode()
    body = [rules.astype("<u4").tobytes(), spans.astype("<u4").tobytes(), marks.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(x) for x in ids], "<u8").tobytes(), pack(seq, bits)]
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


class Shard:
    """A shard file, opened: documents, and ids by range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        n = struct.unpack_from("<I", data, 4)[0]
        self.head = head = json.loads(data[8 : 8 + n])
        at = 8 + n

        def take(kind: str, count: int):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * head["rules"]).reshape(-1, 2)
        self.spans = take("<u4", head["rules"])
        self.marks = take("<u8", -(-head["symbols"] // CHECKPOINT))
        nulls = set(head["nulls"])
        self.doc_ids = [None if i in nulls else d for i, d in enumerate(take("<i8", head["docs"]).tolist())]
        self.lengths = take("<u8", head["docs"]).astype(np.int64)
        self.packed = data[at:]
        self.flat = expansions(self.rules)

    def symbols(self, a: int, b: int) -> np.ndarray:
        return unpack(self.packed, self.head["bits"], self.head["symbols"], a, b)

    def all(self) -> np.ndarray:
        return expand(self.symbols(0, self.head["symbols"]), self.rules, self.flat)

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, decoded from the checkpoint before start."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.marks, start, "right")) - 1
        m = int(np.searchsorted(self.marks, stop, "left"))
        part = expand(self.symbols(k * CHECKPOINT, min(m * CHECKPOINT, self.head["symbols"])), self.rules, self.flat)
        return part[start - int(self.marks[k]) : stop - int(self.marks[k])]


def write(docs: DataFrame, vocab: str, scratch: Scratch, end: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shard files; returns the manifest: file, base (ids before it), docs, ids, bytes."""
    ship(docs.sparkSession)
    root = scratch.path("shards")
    ids = scratch.table(tokenised(docs, vocab, False, end), "ids")

    def save(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, at = filesystem(root)
        fs.create_dir(at, recursive=True)
        doc_ids, held, size, k = [], [], 0, 0

        def close():
            nonlocal doc_ids, held, size, k
            name, data = f"{part:08d}-{k:06d}-{uuid.uuid4().hex}.rpg", write_shard(doc_ids, held)
            with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
                out.write(data)
            row = pd.DataFrame({"file": [name], "part": [part], "k": [k], "docs": [len(held)], "ids": [size], "bytes": [len(data)]})
            doc_ids, held, size, k = [], [], 0, k + 1
            return row

        for pdf in batches:
            for d, none, x in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["ids"], strict=True):
                doc_ids.append(None if none else d)
                held.append(np.frombuffer(x, "<u2"))
                size += len(held[-1])
                if size >= shard_ids:
                    yield close()
        if held:
            yield close()

    ordered = ids.repartitionByRange(parallelism(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    files = scratch.table(ordered.select(*id_parts(F.col("doc_id")), "ids").mapInPandas(save, "file string, part int, k int, docs long, ids long, bytes long"), "manifest")
    scratch.drop("ids")
    # ids before a file: of the parts before its own (one row a part meets in one task), and of the files before it in its part
    parts = files.groupBy("part").agg(F.sum("ids").alias("all"))
    ahead = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("inside", inside).join(F.broadcast(ahead), "part").withColumn("base", F.col("ahead") + F.col("inside")).drop("ahead", "inside")  # one row a part


def read(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        fs, at = filesystem(root)
        for pdf in batches:
            for name, base in zip(pdf["file"], pdf["base"], strict=True):
                with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
                    shard = Shard(f.read())
                ids = shard.all().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, "Int64"), "start": int(base) + starts, "n_tokens": shard.lengths, "ids_crc32": crcs})

    return manifest.select("file", "base").repartition(parallelism(manifest.sparkSession), "file").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_repair_shards(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), scratch)
    return read(manifest, scratch.path("shards"))
