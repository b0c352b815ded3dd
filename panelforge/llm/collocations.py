"""Phrase collocation mining (13): sketch bounds, delimiter-guarded automata, exact counts, exact scores.

Everything is per language. Texts are brought to one form: words apart by one space, pieces apart by `` . `` (a full stop
ends a piece, so no word is one).

1. Sketches count hashed phrases, first of one word, then of two, then of three to five. A phrase is counted only while the
   sketches before show that its words and its pairs may be frequent enough. A task counts to ``at_least`` at most, which
   leaves "at least that many" exact; owners of slices add up and keep one bit a cell. A bit can only overrate a phrase, so
   every frequent phrase is a candidate.
2. Texts are taken in blocks of at most about ``BLOCK`` bytes. The candidates that occur in a block go into automata of at
   most ``AUTOMATON`` phrases, and a block ends when they fill one. Each pattern is guarded by the spaces around it, so it
   matches at word ends only, and neighbours may share a guard.
3. A block's texts are scanned by its own automata; matches overlap and are all counted. Sums over blocks are exact and
   only then meet the threshold. Phrases' parts are candidates themselves, as they are at least as frequent.
4. The cut of the lowest score counts; products are decimals of 38 digits. A candidate goes if a longer one that contains
   it is as frequent; it is enough to look at those of one word more.

Defined results: null texts count as empty and have no words; a null lang is ``und``, and meets rows that say so. Repeated
rows count again. Nothing is cut: the sketch's size steers the work, not the result. Ties go to more occurrences, then to
the smaller phrase in UTF-8 order. Rows of a language are ranked after each task has kept its first ``top``.
doc_id and all other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import LOWER_SQL, Scratch, ship

LONGEST = 5
AT_LEAST, TOP = 100, 2_000
AUTOMATON = 150_000
SLICE = 1 << 14
BYTES_A_CELL, LEAST_BITS, MOST_BITS = 256, 14, 24
TASK_BYTES_A_CELL = 16
WINDOW = 1 << 20
BLOCK = 32 << 20
#: Automata whose phrases' counts a task holds before it sends them.
HELD = 4

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FORM = bytes(ord(".") if i in _BREAKS else ord(" ") if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_ODD = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[32] = 0
_PLACE = _mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) | np.uint64(1)


def normal(text: str | None) -> bytes:
    """A text's words and piece ends, a space around each."""
    words = (text or "").encode().translate(_FORM).replace(b".", b" . ").split(b" ")
    body = b" ".join(filter(None, words))
    return b" " + body + b" " if body else b" "


def n_words(raw: bytes) -> int:
    return raw.count(b" ") - 1 - raw.count(b".")


class Phrases:
    """The phrases of a run of normal texts: limits of words, and hashes of phrases of each length."""

    def __init__(self, raw: bytes, lang: str):
        self.raw = np.frombuffer(raw, np.uint8)
        space = np.flatnonzero(self.raw == 32)
        self.starts, self.ends = space[:-1] + 1, space[1:]
        self.word = ~((self.ends - self.starts == 1) & (self.raw[self.starts] == 46))
        self.hash = self._words() ^ np.uint64(zlib.crc32(lang.encode()))

    def _words(self) -> np.ndarray:
        """A word's hash: the sum of its bytes' numbers, each times a number of its place."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts + 1
        place = np.arange(1, len(self.raw)) - np.repeat(self.starts, size)
        parts = _BYTE[self.raw[1:]] * _PLACE[place & 0xFFFF]
        if size.max() > 1 << 16:
            parts *= np.where(place >> 16, _mix((place >> 16).astype(np.uint64)), np.uint64(1))
        return _mix(np.add.reduceat(parts, self.starts - 1) + size.astype(np.uint64))

    def of(self, k: int, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the phrases of k words: of fine words if k is 1 or 2, beyond that of fine pairs."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        good = fine[:n].copy()
        for i in range(1, k if k < 3 else k - 1):
            good &= fine[i : i + n]
        at = np.flatnonzero(good)
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = _mix((h ^ self.hash[at + i]) * _ODD)
        return at, h

    def text(self, at: int, k: int) -> str:
        return self.raw[self.starts[at] : self.ends[at + k - 1]].tobytes().decode()


class Bits:
    """Two rows of one bit a cell: set where the sketch's count reaches the threshold."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in cells(h, self.bits):
            out &= (self.packed[row >> 3] >> (row & 7).astype(np.uint8) & 1).astype(bool)
        return out


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.uint64((1 << bits) - 1)
    return (h & most).astype(np.int64), ((h >> np.uint64(32)) & most).astype(np.int64) + (1 << bits)


def windows(raw: bytes):
    """A long run in windows of about WINDOW bytes; each begins LONGEST - 1 words before the last one's end, so no phrase is lost."""
    a = 0
    while len(raw) - a > 2 * WINDOW:
        b = raw.find(b" ", a + WINDOW)
        if b in (-1, len(raw) - 1):
            break
        yield raw[a : b + 1]
        back = b
        for _ in range(LONGEST - 1):
            back = raw.rfind(b" ", a + 1, back)
            if back < 0:
                break
        a = back if back > a else b
    yield raw[a:]


def texts_of(batches):
    for batch in batches:
        yield from zip(batch.column("lang").to_pylist(), map(normal, batch.column("text").to_pylist()), strict=True)


def groups(batches):
    """(lang, normal texts of about WINDOW bytes)."""
    held: dict[str, list] = {}
    size: Counter = Counter()
    for lang, raw in texts_of(batches):
        held.setdefault(lang, []).append(raw)
        size[lang] += len(raw)
        if size[lang] >= WINDOW:
            size[lang] = 0
            yield lang, held.pop(lang)
    yield from held.items()


def runs_of(texts: list[bytes]):
    return windows(b".".join(texts))


def runs(batches):
    """(lang, run of normal texts of about WINDOW bytes)."""
    for lang, texts in groups(batches):
        for part in runs_of(texts):
            yield lang, part


def fine_phrases(lang: str, raw: bytes, known: list[Bits], lengths: tuple[int, ...]):
    """(length, phrases, first words, hashes) of a run, as far as the sketches of shorter phrases allow."""
    p = Phrases(raw, lang)
    fine, pairs = p.word, None
    if known:
        at, h = p.of(1, p.word)
        fine = np.zeros(len(p.word), bool)
        fine[at[known[0].has(h)]] = True
    if len(known) > 1 and max(lengths) > 2:
        at, h = p.of(2, fine)
        pairs = np.zeros(len(p.word), bool)
        pairs[at[known[1].has(h)]] = True
    for k in lengths:
        yield (k, p, *p.of(k, fine if k < 3 else pairs))


def sketch(rows: DataFrame, lengths: tuple[int, ...], known: list[Bits], bits: int, at_least: int) -> Bits:
    """The bits of a sketch over all texts. Tasks send slices of counts, owners add them; the driver receives bits only."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    width = min(SLICE, 2 << bits)
    kind = "<u1" if at_least < 256 else "<u4"

    def count(batches):
        total = np.zeros(2 << bits, np.uint32)
        for lang, raw in runs(batches):
            for _, _, _, h in fine_phrases(lang, raw, shared.value, lengths):
                for row in cells(h, bits):
                    np.add.at(total, row, np.uint32(1))
        slices = [(i, part) for i, part in enumerate(total.reshape(-1, width)) if part.any()]
        for a in range(0, len(slices), 64):
            coded = [zlib.compress(np.minimum(part, at_least).astype(kind).tobytes(), 1) for _, part in slices[a : a + 64]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in slices[a : a + 64]], pa.int32()), pa.array(coded, pa.binary())], ["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, coded in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(coded), kind)
                total[i] = np.minimum(total.get(i, 0) + part.astype(np.int64), at_least).astype(np.uint32)
        bits_of = [np.packbits(x >= at_least, bitorder="little").tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits_of, pa.binary())], ["slice", "bits"])

    found = rows.mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, bits binary").collect()
    packed = np.zeros((2 << bits) // 8, np.uint8)
    for r in found:
        packed[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    shared.unpersist()
    return Bits(bits, packed)


class Named:
    """The phrases of 1 to LONGEST words that the sketches do not rule out, once each, as runs of texts are added."""

    def __init__(self, known: list[Bits]):
        self.known = known
        self.seen: dict[int, np.ndarray] = {k: np.zeros(0, np.uint64) for k in range(1, LONGEST + 1)}

    def new(self, lang: str, raw: bytes) -> list[str]:
        out = []
        for k, p, at, h in fine_phrases(lang, raw, self.known, tuple(range(1, LONGEST + 1))):
            good = self.known[min(k, 3) - 1].has(h)
            h, first = np.unique(h[good], return_index=True)
            new = ~np.isin(h, self.seen[k], assume_unique=True)
            self.seen[k] = np.union1d(self.seen[k], h[new])
            out += [p.text(i, k) for i in at[good][first[new]]]
        return out


def candidates(rows: DataFrame, known: list[Bits]) -> DataFrame:
    """lang, phrase: every phrase of 1 to LONGEST words that the sketches do not rule out, from a task once each."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def name(batches):
        named = Named(shared.value)
        for lang, raw in runs(batches):
            out = named.new(lang, raw)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.string())], ["lang", "phrase"])

    return rows.mapInArrow(name, "lang string, phrase string").distinct()


def occurrences(phrases: list[str], texts: list[bytes]) -> Counter:
    """How often each phrase occurs in normal texts, overlaps included, by automata of at most AUTOMATON phrases."""
    found: Counter = Counter()
    for a in range(0, len(phrases), AUTOMATON):
        machine = ahocorasick.Automaton()
        for phrase in phrases[a : a + AUTOMATON]:
            machine.add_word(f" {phrase} ", phrase)
        machine.make_automaton()
        for raw in texts:
            found.update(map(itemgetter(1), machine.iter(raw.decode())))
    return found


def scan(rows: DataFrame, known: list[Bits]) -> DataFrame:
    """lang, phrase, f: how often each candidate occurs, overlaps included; a null phrase holds the language's words.

    A block of texts is scanned by automata of the candidates that it holds itself, and ends once these fill an automaton;
    so a text meets a bounded number of automata, however many candidates there are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        phrases: dict[str, list[str]] = {}
        texts: dict[str, list[bytes]] = {}
        found: dict[str, Counter] = {}
        words: Counter = Counter()
        named, size, n = Named(shared.value), 0, 0

        def block_done():
            for lang, held in texts.items():
                found.setdefault(lang, Counter()).update(occurrences(phrases[lang], held))
                words[lang] += sum(map(n_words, held))

        def sums():
            for lang, at in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([None, *at], pa.string()), pa.array([words[lang], *at.values()], pa.int64())], ["lang", "phrase", "f"])

        for lang, group in groups(batches):
            texts.setdefault(lang, []).extend(group)
            for raw in runs_of(group):
                new = named.new(lang, raw)
                phrases.setdefault(lang, []).extend(new)
                n += len(new)
            size += sum(map(len, group))
            if n >= AUTOMATON or size >= BLOCK:
                block_done()
                phrases, texts = {}, {}
                named, size, n = Named(shared.value), 0, 0
            if sum(map(len, found.values())) >= HELD * AUTOMATON:
                yield from sums()
                found, words = {}, Counter()
        block_done()
        yield from sums()

    return rows.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def mine(docs: DataFrame, at_least: int = AT_LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_CELL).bit_length()))
    # a task reads text in proportion to a sketch's cells, so that what tasks send grows with the input, not with its square
    rows = rows.coalesce(max(1, -(-size // (TASK_BYTES_A_CELL << bits))))
    known: list[Bits] = []
    for lengths in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        known.append(sketch(rows, lengths, known, bits, at_least))
    # a phrase's parts are as frequent as itself, so rarer candidates end here
    counted = scratch.table(scan(rows, known).where((F.col("f") >= at_least) | F.col("phrase").isNull()), "counts")
    return ranked(counted, at_least, top)


def ranked(counted: DataFrame, at_least: int, top: int) -> DataFrame:
    total = counted.where("phrase is null").select("lang", F.col("f").alias("n"))
    f = counted.where("phrase is not null").withColumn("w", F.split("phrase", " "))
    found = f.where((F.size("w") >= 2) & (F.col("f") >= at_least)).withColumnRenamed("f", "a")
    cut = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", cut(F.lit(1), F.col("cut")).alias("one"), cut(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("two"))
    left, right = (f.select("lang", F.col("phrase").alias(c), F.col("f").alias(d)) for c, d in (("one", "l"), ("two", "r")))
    scored = cuts.join(left, ["lang", "one"]).join(right, ["lang", "two"]).join(F.broadcast(total), "lang")
    big = lambda c: f"cast({c} as decimal(38, 0))"
    scored = scored.withColumn("score", F.expr(f"(cast(1000 as decimal(38, 0)) * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    inner = found.where(F.size("w") >= 3).select("lang", "a", F.explode(F.array(cut(F.lit(1), F.size("w") - 1), cut(F.lit(2), F.size("w") - 1))).alias("phrase")).distinct()
    kept = best.join(inner, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = (
    r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p
), g as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 6) t(k))
), f as materialized (
  select lang, k, phrase, count(*) as f from g group by all
), n as (
  select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang
), c as materialized (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= 100
), e as materialized (
  select *, array_to_string(w[1:j], ' ') as one, array_to_string(w[j + 1:], ' ') as two from (select *, unnest(range(1, k)) as j from c)
), s as (
  select c.lang, c.phrase, c.a, j, l.f as l, r.f as r, n.n,
    cast((cast(1000 as hugeint) * c.a * n.n) // (cast(l.f as hugeint) * r.f) as bigint) as score
  from e c
  join f l on l.lang = c.lang and l.phrase = c.one
  join f r on r.lang = c.lang and r.phrase = c.two
  join n on n.lang = c.lang
), b as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1
), o as (
  select lang, a, array_to_string(w[1:k - 1], ' ') as phrase from c where k >= 3
  union select lang, a, array_to_string(w[2:], ' ') from c where k >= 3
), r as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank
  from b anti join o on b.lang = o.lang and b.phrase = o.phrase and b.a = o.a
)
select lang, rank, phrase, a, l, r, n, score from r where rank <= 2000
"""
).replace("{lower}", LOWER_SQL.format("coalesce(text, '')"))
