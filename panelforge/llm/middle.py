"""Fill-in-middle transformation (11): an index of distinct texts with Elias-Fano boundary lists, then one seeded cut a document.

1. Rows are keyed by the SHA-256 of their text. Keys alone are counted; texts that several rows hold are grouped by their
   bytes (a partial aggregate, so copies collapse before the shuffle), and two texts under one key stop the job.
2. ``boundaries`` lists where each code point of a text starts in UTF-8, and where the last one ends, as an Elias-Fano
   list: low bits packed, high bits in unary, with the count of ones before each block of ``BLOCK`` bits, so that any
   boundary is found by one search and one block. A list is computed once for each distinct text. A text that only one
   row holds is its own group: its list is computed where the row lies, and its bytes never move.
3. Rows of shared texts join the index by (key, salt); a text has one salt for each ``GROUP_ROWS`` of its rows, so copies
   held by a third of all rows are cut in many tasks.
4. A document's seeded draws select two boundaries, and the pieces between them are put in the order of its form.

Defined results: a null text counts as empty; an empty text is plain. A null doc_id draws as the empty string would after
``1:``. Repeated rows are answered each on its own, alike. Columns besides doc_id and text are not read. A text of any
length is cut by the same lists; it is held whole by one task, as Spark holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, checked_broadcast, id_back, id_parts, ship

#: Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
KEEP_PLAIN, SUFFIX_FIRST = 90, 20
SEED = "1"

BLOCK = 1024
GROUP_ROWS = 2_000


class Boundaries:
    """A rising list of offsets, Elias-Fano coded: ``select(i)`` without decoding the rest."""

    HEAD = 3

    def __init__(self, data: bytes):
        self.n, self.low_bits, blocks = (int(x) for x in np.frombuffer(data, "<u4", self.HEAD))
        at = 4 * self.HEAD
        self.before = np.frombuffer(data, "<u4", blocks, at)
        at += 4 * blocks
        size = (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(data, np.uint8, size, at)
        self.high = np.frombuffer(data, np.uint8, offset=at + size)

    @staticmethod
    def encode(offsets: np.ndarray, universe: int) -> bytes:
        n = len(offsets)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        ones = (offsets >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        blocks = -(-len(bits) // BLOCK)
        before = np.searchsorted(ones, np.arange(blocks) * BLOCK)
        low = ((offsets[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return b"".join([np.array([n, low_bits, blocks], "<u4").tobytes(), before.astype("<u4").tobytes(), np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes()])

    def select(self, i: int) -> int:
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        a = block * BLOCK // 8
        bits = np.unpackbits(self.high[a : a + BLOCK // 8], bitorder="little")
        one = block * BLOCK + int(np.flatnonzero(bits)[i - int(self.before[block])])
        value = (one - i) << self.low_bits
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            value |= (int(self.low[k >> 3]) >> (k & 7) & 1) << b
        return value


def boundaries(text: bytes) -> bytes:
    """The offsets in UTF-8 at which code points start, and the end, as an Elias-Fano list: one more than there are code points."""
    raw = np.frombuffer(text, np.uint8)
    return Boundaries.encode(np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)], len(raw))


def draws(doc_id: str, seed: str = SEED) -> list[int]:
    found = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: bytes, index: Boundaries, doc_id: str, seed: str = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle (None if plain), output."""
    n = index.n - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= KEEP_PLAIN or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = index.select(a), index.select(b)
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, b"".join([SUFFIX, text[y:], PREFIX, text[:x], MIDDLE, text[x:y]])
    return n, "psm", a, b - a, b"".join([PREFIX, text[:x], SUFFIX, text[y:], MIDDLE, text[x:y]])


def restore(output: bytes, form: str) -> bytes:
    """The exact text from an output and its form: no mark begins inside another, and the text holds none."""
    if form == "plain":
        return output
    first, then = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a = output.index(then, len(first))
    m = output.index(MIDDLE, a)
    one, two, middle = output[len(first) : a], output[a + len(then) : m], output[m + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


_CUT = "doc_id long, no_id boolean, n long, form string, prefix_chars long, middle_chars long, output string"


def _cuts(batches):
    """Cuts rows of (doc_id, no_id, text, list); a list that is missing belongs to this row alone and is computed here."""
    for batch in batches:
        out, last, index = [], None, None
        for doc_id, no_id, text, coded in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "no_id", "text", "coded")), strict=True):
            raw = text.encode()
            if coded is None:
                index, last = Boundaries(boundaries(raw)), None
            elif coded != last:
                index, last = Boundaries(coded), coded
            n, form, a, m, made = cut(raw, index, "" if no_id else str(doc_id))
            out.append((doc_id, no_id, n, form, a, m, made.decode()))
        yield _arrow(out, _CUT)


def _arrow(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _lists(batches):
    for batch in batches:
        yield _arrow([(k, t, s, boundaries(t.encode())) for k, t, s in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "salts")), strict=True)], "key binary, text string, salts int, coded binary")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("rid"), *id_parts(F.col("doc_id")), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that several rows hold, with a salt for each GROUP_ROWS of them. Texts do not move."""
    many = rows.groupBy("key").count().where("count > 1")
    return many.select("key", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("salts"))


def text_index(rows: DataFrame) -> DataFrame:
    """key, text, salts, coded: one row for each distinct text of rows of (key, text, salts), grouped by content."""
    texts = rows.groupBy("key", "text").agg(F.max("salts").alias("salts"))
    return texts.mapInArrow(_lists, "key binary, text string, salts int, coded binary")


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: a row for each document."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = keyed(docs)
    shared = checked_broadcast(scratch.table(shared_keys(rows), "shared"))
    marked = rows.join(shared, "key", "left")
    alone = marked.where("salts is null").select("doc_id", "no_id", "text", F.lit(None).cast("binary").alias("coded"))
    copies = marked.where("salts is not null")
    index = scratch.table(text_index(copies.select("key", "text", "salts")), "index")
    if index.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("two texts share a SHA-256")
    members = copies.select("doc_id", "no_id", "key", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"))
    spread = index.select("key", "text", "coded", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    joined = members.join(spread, ["key", "salt"]).select("doc_id", "no_id", "text", "coded")
    done = alone.unionByName(joined).mapInArrow(_cuts, _CUT)
    return done.select(id_back(), "n", "form", "prefix_chars", "middle_chars", "output")


def digests(done: DataFrame) -> DataFrame:
    """The digest of each output, and of the text rebuilt from the output and its form alone."""

    def restored(batches):
        for batch in batches:
            cols = batch.to_pydict()
            made = [x.encode() for x in cols.pop("output")]
            sha = [hashlib.sha256(x).hexdigest() for x in made]
            back = [hashlib.sha256(restore(x, f)).hexdigest() for x, f in zip(made, cols["form"], strict=True)]
            yield _arrow(list(zip(cols["doc_id"], cols["n"], cols["form"], cols["prefix_chars"], cols["middle_chars"], sha, back, strict=True)), schema)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return done.mapInArrow(restored, schema)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return digests(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as x, length(coalesce(text, '')) as n,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), d as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as c2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from t
), f as (
  select *, least(c1, c2) as a, greatest(c1, c2) as b,
    case when n = 0 or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from d
), p as (
  select *, substr(x, 1, a) as pre, substr(x, a + 1, b - a) as mid, substr(x, b + 1) as suf from f
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(x) as restored_sha256
from p
"""
