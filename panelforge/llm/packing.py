"""Packing (2): lexical retrieval packing of documents into fixed windows.

Documents become token ids once, are dealt to shards of about ``SHARD_IDS`` ids by lexical likeness, and every shard builds
a BM25 inverted index over token ids. Likeness is that of hashed BM25 vectors: a tree of cuts along main directions, grown
on a sample that grows with the number of shards, leads like documents to one leaf; a leaf of too many ids is dealt on by hash.
Document frequencies and the mean length are those of all documents, not of the shard. A seed asks its own shard with all its
terms, so neighbours in other leaves are not found (README: recall against all documents). A window starts with a seed
document; the index returns the seed's best neighbours that no window has used, which fill the window greedily, the last one
cut where the window ends. Its rest seeds the next window. So only the last window of a shard is padded.

Defined results: null or empty text is the end id alone and is packed like any other document; a null doc_id is kept as
null; repeated rows are packed each on its own (start counts within the row's own ids); an empty table gives no rows; ties
in scores go to the document first in (doc_id, content) order. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, id_back, id_parts, ship
from panelforge.llm.tokens import tokenised, vocabulary

WINDOW = 1024
END_ID = 0
SHARD_IDS = 2_000_000
K1, B = 1.2, 0.75
NEIGHBOURS = 32
VOCABULARY = 65_536
SORTED = 100_000
COMMON = 0.05
WIDTH = 128
TOGETHER, BLOCK = 3_000, 256
SAMPLE_LEAF, SAMPLE_LEAST = 16, 4_000


def term_counts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) by document and term: documents are sorted together, about ``SORTED`` ids at a time."""
    sizes = np.array([len(x) for x in ids], np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SORTED)) + 1), len(ids)] if len(ids) else [0]
    cuts = [c for a, b in zip(cuts, [*cuts[1:], None], strict=True) for c in ([a] if b is None else range(a, b, 65_536))]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        key = np.repeat(np.arange(b - a, dtype=np.uint32) << np.uint32(16), sizes[a:b]) | np.concatenate(ids[a:b])
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, n = key[first], np.diff(np.r_[first, len(key)])
        out.append(((key >> np.uint32(16)).astype(np.int64) + a, (key & np.uint32(0xFFFF)).astype(np.int64), n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def weighed(ids: list[np.ndarray], idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, BM25 weight) of documents' terms."""
    doc, term, tf = term_counts(ids)
    length = np.array([len(x) for x in ids], float)[doc]
    return doc, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def vectors(ids: list[np.ndarray], idf: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25 vectors of length 1, terms hashed to ``WIDTH`` signed places."""
    mixed = np.arange(VOCABULARY, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    place, sign = (mixed % np.uint64(WIDTH)).astype(np.int64), np.where(mixed >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
    doc, term, w = weighed(ids, idf, mean_length)
    out = np.bincount(doc * WIDTH + place[term], w * sign[term], len(ids) * WIDTH).reshape(len(ids), WIDTH).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Tree:
    """Leads vectors to one of so many leaves of about as many ids; like ones mostly to the same."""

    def __init__(self, sample: np.ndarray, sizes: np.ndarray, leaves: int):
        self.nodes: list = []  # (direction, cut, node below, node above), or (None, leaf, 0, 0)
        self.leaves = 0
        self._grow(sample, sizes, leaves)

    def _grow(self, x: np.ndarray, sizes: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append((None, self.leaves, 0, 0))
        along = None
        if leaves > 1 and len(x) > 1:
            off = x - x.mean(0)
            along = np.linalg.eigh(off.T @ off)[1][:, -1].astype(np.float32)
            v = x @ along
            order = np.argsort(v, kind="stable")
            v, sums = v[order], np.cumsum(sizes[order])
            a, b = np.searchsorted(sums, sums[-1] * (leaves // 2 / leaves + np.array([-0.1, 0.1])))
            a = min(int(a), len(v) - 2)
            k = a + int(np.argmax(np.diff(v[a : max(a + 2, int(b) + 1)])))  # the widest gap near the middle
            if v[k] == v[k + 1]:
                along = None
        if along is None:
            self.leaves += 1
        else:
            cut = float((v[k] + v[k + 1]) / 2)
            low = x @ along <= cut
            self.nodes[at] = (along, cut, self._grow(x[low], sizes[low], leaves // 2), self._grow(x[~low], sizes[~low], leaves - leaves // 2))
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            along, cut, below, above = self.nodes[at]
            if along is None:
                out[rows] = cut
            elif len(rows):
                low = x[rows] @ along <= cut
                stack += [(below, rows[low]), (above, rows[~low])]
        return out


class Index:
    """BM25 over the documents of a shard; retrieve() ranks those not yet used.

    A score is the sum over all terms of the seed. Terms of at least ``COMMON`` of the documents have a row of weights; a
    block of documents, most of which become seeds, is multiplied by them at once. The others have postings. A shard of
    more than ``TOGETHER`` documents adds a seed's rows alone.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        docs, terms, weights = weighed(ids, idf, mean_length)
        weights = weights.astype(np.float32)
        common = np.bincount(terms, minlength=VOCABULARY) >= max(COMMON * len(ids), 1)
        place = np.cumsum(common) - 1
        often = common[terms]
        self.rows = np.zeros((int(common.sum()), len(ids)), np.float32)
        self.rows[place[terms[often]], docs[often]] = weights[often]
        bounds = np.arange(1, len(ids))
        self.common = np.split(place[terms[often]], np.searchsorted(docs[often], bounds))
        self.rare = np.split(terms[~often], np.searchsorted(docs[~often], bounds))
        terms, docs, weights = terms[~often], docs[~often], weights[~often]
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(VOCABULARY + 1))
        self.counts = np.diff(self.starts)
        self.used = np.zeros(len(ids), bool)
        self.blocks: dict[int, np.ndarray] = {}

    def _common(self, seed: int) -> np.ndarray:
        if len(self.used) > TOGETHER:
            return self.rows[self.common[seed]].sum(0)
        k = seed // BLOCK
        if k not in self.blocks:
            held = self.common[k * BLOCK : (k + 1) * BLOCK]
            asks = np.zeros((len(held), len(self.rows)), np.float32)
            asks[np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate(held)] = 1
            self.blocks[k] = asks @ self.rows
        return self.blocks[k][seed - k * BLOCK]

    def scores(self, seed: int) -> np.ndarray:
        out = self._common(seed).copy()
        first, n = self.starts[self.rare[seed]], self.counts[self.rare[seed]]
        ends = np.cumsum(n)
        if len(ends) and ends[-1]:
            at = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
            out = out + np.bincount(self.docs[at], self.weights[at], len(out))
        return out

    def retrieve(self, seed: int, most: int = NEIGHBOURS) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        scores = self.scores(seed)
        scores[self.used] = 0
        found = np.flatnonzero(scores)
        if len(found) > most:
            found = found[np.argpartition(-scores[found], most)[:most]]
        return found[np.lexsort((found, -scores[found]))]


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    index, out = Index(ids, idf, mean_length), []
    sequence, offset, fresh = 0, 0, 0

    def place(doc: int, start: int) -> int:
        """Put what fits of the document; returns where its rest begins, or -1."""
        nonlocal offset
        n = min(window - offset, len(ids[doc]) - start)
        out.append((doc, start, n, sequence, offset))
        offset += n
        return start + n if start + n < len(ids[doc]) else -1

    seed, rest = -1, -1
    while True:
        if rest < 0:
            while fresh < len(ids) and index.used[fresh]:
                fresh += 1
            if fresh == len(ids):
                return out
            seed, rest = fresh, 0
            index.used[seed] = True
        rest = place(seed, rest)
        if rest < 0 and offset < window:
            for doc in index.retrieve(seed):
                index.used[doc] = True
                rest = place(int(doc), 0)
                if offset == window:
                    seed = int(doc)
                    break
        if offset == window:
            sequence, offset = sequence + 1, 0


def statistics(ids: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency by id (as many numbers as the vocabulary holds), documents, ids: over all documents."""

    def count(batches):
        df = np.zeros(VOCABULARY, np.int64)
        for pdf in batches:
            df += np.bincount(term_counts([np.frombuffer(x, "<u2") for x in pdf["ids"]])[1], minlength=VOCABULARY)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"id": at, "df": df[at]})

    df = np.zeros(VOCABULARY, np.int64)
    for r in ids.select("ids").mapInPandas(count, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r.id] = r.df
    size = ids.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    return df, size.docs, size.ids


def deal(ids: DataFrame, idf: np.ndarray, mean_length: float, shards: int, n_docs: int) -> DataFrame:
    """The ids with each document's leaf; about as many leaves as shards."""
    if shards == 1:
        return ids.withColumn("leaf", F.lit(0).cast("long"))
    sc = ids.sparkSession.sparkContext
    model = sc.broadcast(idf)
    share = min(1.0, max(SAMPLE_LEAST, SAMPLE_LEAF * shards) / n_docs)

    def held(pdf: pd.DataFrame) -> np.ndarray:
        return vectors([np.frombuffer(x, "<u2") for x in pdf["ids"]], model.value, mean_length)

    def show(batches):
        for pdf in batches:
            yield pd.DataFrame({"v": [x.tobytes() for x in held(pdf)], "n": pdf["n"]})

    sample = ids.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) < int(share * (1 << 30))).select("ids", "n").mapInPandas(show, "v binary, n long").collect()
    rows = sorted((bytes(r.v), r.n) for r in sample)
    seen = np.array([np.frombuffer(v, np.float32) for v, _ in rows]).reshape(len(rows), WIDTH)
    tree = sc.broadcast(Tree(seen, np.array([n for _, n in rows], float), shards))

    def place(batches):
        for pdf in batches:
            yield pdf.assign(leaf=tree.value.leaf(held(pdf)))

    return ids.select(*id_parts(F.col("doc_id")), "ids", "n").mapInPandas(place, "doc_id long, no_id boolean, ids binary, n long, leaf long").select(id_back(), "ids", "n", "leaf")


def pack(docs: DataFrame, vocab: str, scratch: Scratch | None = None, window: int = WINDOW, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its ids (16-bit) if asked."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    ids = scratch.table(tokenised(docs, vocab, True, end), "ids", "snappy")  # hardly compressible
    df, n_docs, n_ids = statistics(ids)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    mean_length = n_ids / max(1, n_docs)
    shards = max(1, -(-n_ids // SHARD_IDS))
    model = spark.sparkContext.broadcast(idf)  # one number for each id of the vocabulary
    dealt = scratch.table(deal(ids, idf, mean_length, shards, n_docs), "dealt", "snappy")
    scratch.drop("ids")
    # a leaf of too many ids is dealt on by hash
    first, parts = {}, 0
    for r in dealt.groupBy("leaf").agg(F.sum("n").alias("n")).orderBy("leaf").collect():  # a row for each shard
        first[r.leaf] = (parts, max(1, -(-r.n // (2 * SHARD_IDS))))
        parts += first[r.leaf][1]
    plan = spark.createDataFrame([(k, *v) for k, v in first.items()], "leaf long, first int, parts int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.assign(crc=[zlib.crc32(x) for x in pdf["ids"]]).sort_values(["no_id", "doc_id", "crc"], kind="stable", ignore_index=True)
        held = [np.frombuffer(x, "<u2") for x in pdf["ids"]]
        pieces = pack_shard(held, model.value, mean_length, window)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        cuts = [held[d][s : s + n] for d, s, n in zip(doc, start, length, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].to_numpy()[doc],
                "no_id": pdf["no_id"].to_numpy()[doc],
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in cuts],
                "doc_tokens": pdf["n"].to_numpy()[doc],
                "sequence_id": (shard << 40) + sequence,
                "offset": offset,
                "ids": [x.tobytes() for x in cuts] if with_ids else None,
            }
        )

    dealt = dealt.join(F.broadcast(plan), "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("doc_id", "ids"), F.col("parts")).cast("int")).select(*id_parts(F.col("doc_id")), "ids", "n", "shard")
    out = dealt.groupBy("shard").applyInPandas(run, "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    out = out.withColumn("doc_id", id_back()).drop("no_id")
    return out if with_ids else out.drop("ids")


def op2_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
