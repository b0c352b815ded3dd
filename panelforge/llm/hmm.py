"""LM scoring (4): a hidden Markov language model trained by Baum-Welch.

The model's events are the V words of the training texts (the end of a text counts as one) and "unknown". A state emits
a word class, and the class emits the word by its smoothed unigram share, the same in every state: classes are the
``TOP`` most frequent words, each alone, and ``TAIL`` classes by hash of the last three bytes for all others. So what the
tasks are sent has a fixed size however many words there are, while word counts themselves stay in tables and meet the
texts by a join. Unknown has the mass that Good and Turing give it (words seen once / all words).

1. Texts are read once into blocks of at most about ``BLOCK_TOKENS`` tokens: each text as numbers of its block's words,
   and the block's words with their training counts. Counts are summed by word over all blocks; a block gets back those
   of its words that another block has too, and of the ``TOP`` words from a broadcast of that size.
2. Baum-Welch: every iteration sums expected counts over whole training texts (exact scaled forward-backward), task by
   task and then by class. The start comes from class shares and from iterations over one training text in ``START`` (by
   hash: it grows with the input); then all iterations read all training texts. Both end when the likelihood gains less
   than ``SETTLED`` of itself, after ``ITERATIONS`` passes at most.
3. Every text's score is its exact likelihood by the scaled forward recursion.

Defined results: null text is empty: one token, the end. A null doc_id counts as the empty string, whose crc32 is 0: held
out. Repeated rows are counted and scored each. Without training texts all words are unknown and both scores come from
the smoothing alone. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, id_back, id_parts, ship

STATES = 8
ITERATIONS = 40
SETTLED = 1e-4
START = 16
TOP, TAIL = 4096, 4096
UNKNOWN = TOP + TAIL
BLOCK_TOKENS = 1_500_000
BATCH_TOKENS = 500_000
ADD = 0.1
PRIOR = 20.0
END = ""


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def blocks(docs: DataFrame) -> DataFrame:
    """kind 0: a text as word numbers of its block; kind 1: a word of a block with its training count; kind 2: the block's words as tail classes."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        words: dict[bytes, int] = {}
        rows, size = [], 0

        def close():
            nonlocal k, size, words
            block = (part << 24) + k
            train = [r[2] for r in rows if not r[1]]
            counts = np.bincount(np.concatenate(train), minlength=len(words)) if train else np.zeros(len(words), np.int64)
            tails = np.fromiter((zlib.crc32(w[-3:]) % TAIL for w in words), np.uint16, len(words))
            texts = [*rows, (None, True, tails)]
            n = len(rows)
            out = [
                pd.DataFrame({"kind": [0] * n + [2], "block": block, "doc_id": pd.array([r[0] for r in texts], "Int64"), "held_out": [r[1] for r in texts], "tokens": [r[2].tobytes() for r in texts], "idx": 0, "word": None, "c": 0}),
                pd.DataFrame({"kind": 1, "block": block, "doc_id": pd.array([None] * len(words), "Int64"), "held_out": False, "tokens": None, "idx": np.arange(len(words)), "word": list(words), "c": counts}),
            ]
            rows.clear()
            words, size, k = {}, 0, k + 1
            return out

        for pdf in batches:
            for doc_id, no_id, out, text in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["held_out"], pdf["text"], strict=True):
                found = [*(text or "").encode().lower().split(), b""]  # bytes: A-Z and ASCII white space only
                number = words.setdefault
                rows.append((None if no_id else doc_id, bool(out), np.fromiter((number(w, len(words)) for w in found), np.uint32, len(found))))
                size += len(found)
                if size >= BLOCK_TOKENS:
                    yield from close()
        if rows:
            yield from close()

    rows = docs.select(*id_parts(F.col("doc_id")), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return rows.mapInPandas(run, "kind int, block long, doc_id long, held_out boolean, tokens binary, idx int, word binary, c long")


class Model:
    """start, move (states x states), emit (classes + unknown x states): the unknown row is the same in every state."""

    def __init__(self, share: np.ndarray, unknown: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.share, self.unknown = share, unknown  # unigram shares of the classes (sum 1), mass of unknown
        noise = share[:, None] * np.exp(rng.normal(0, 1.0, (UNKNOWN, STATES)))
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.05 / (STATES - 1)) + np.eye(STATES) * (0.95 - 0.05 / (STATES - 1))
        self.emit = self._with_unknown(noise)

    def _with_unknown(self, counts: np.ndarray) -> np.ndarray:
        known = (counts + PRIOR * self.share[:, None]) / (counts.sum(0) + PRIOR)
        return np.vstack([known * (1 - self.unknown), np.full((1, STATES), self.unknown)])

    def update(self, counts: Counts) -> None:
        self.start = (counts.start + 1) / (counts.start.sum() + STATES)
        self.move = (counts.move + 1) / (counts.move.sum(1, keepdims=True) + STATES)
        self.emit = self._with_unknown(counts.emit[:UNKNOWN])


class Counts:
    def __init__(self):
        self.start, self.move, self.emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((UNKNOWN + 1, STATES))
        self.likelihood = 0.0  # log10, under the model that the counts are expected by


class Batch:
    """Texts laid out step by step, longest first, so that each step of the recursions is one slice."""

    def __init__(self, texts: list[np.ndarray]):
        self.order = np.argsort([-len(x) for x in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in self.order])
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")
        self.at = np.r_[0, np.cumsum(self.active)]
        flat = np.concatenate([texts[i] for i in self.order]).astype(np.int64)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.tokens = np.empty(len(flat), np.int64)
        self.tokens[self.at[step] + np.repeat(np.arange(len(lengths)), lengths)] = flat

    def forward(self, model: Model, keep: bool):
        """log10 likelihoods in the given order; with keep also emissions, scaled forward values and scales."""
        emitted = model.emit[self.tokens]
        alpha = np.empty_like(emitted) if keep else None
        scale = np.empty((len(emitted), 1))
        one, now = np.ones((STATES, 1)), None
        for t in range(len(self.active)):
            a, b = self.at[t], self.at[t + 1]
            here = alpha[a:b] if keep else np.empty((b - a, STATES))
            if t:
                np.matmul(now[: b - a], model.move, out=here)
                here *= emitted[a:b]
            else:
                np.multiply(emitted[a:b], model.start, out=here)
            here /= np.matmul(here, one, out=scale[a:b])
            now = here
        scale = scale[:, 0]
        total = np.zeros(len(self.order))
        owner = np.arange(len(emitted)) - np.repeat(self.at[:-1], self.active)
        out = np.bincount(owner, np.log10(scale), len(self.order))
        total[self.order] = out
        return total, emitted, alpha, scale

    def count(self, model: Model, counts: Counts) -> float:
        """Add expected counts; returns the log10 likelihood."""
        total, emitted, alpha, scale = self.forward(model, True)
        emitted /= scale[:, None]
        beta, n = np.empty_like(alpha), len(self.active)
        beta[self.at[n - 1] :] = 1
        for t in range(n - 1, 0, -1):
            a, b, before = self.at[t], self.at[t + 1], self.at[t - 1]
            emitted[a:b] *= beta[a:b]
            np.matmul(emitted[a:b], model.move.T, out=beta[before : before + b - a])
            beta[before + b - a : a] = 1
        above = np.arange(self.at[1], len(emitted)) - np.repeat(self.active[:-1], self.active[1:])
        counts.move += model.move * (alpha[above].T @ emitted[self.at[1] :])
        alpha *= beta
        counts.start += alpha[: self.at[1]].sum(0)
        for k in range(STATES):
            counts.emit[:, k] += np.bincount(self.tokens, alpha[:, k], UNKNOWN + 1)
        return float(total.sum())


def batches_of(texts: list[np.ndarray]):
    """Index lists of like-long texts, of about BATCH_TOKENS tokens."""
    part, size = [], 0
    for i in np.argsort([-len(x) for x in texts], kind="stable"):
        part.append(int(i))
        size += len(texts[i])
        if size >= BATCH_TOKENS:
            yield part
            part, size = [], 0
    if part:
        yield part


def expect(texts: DataFrame, model: Model) -> Counts:
    """Expected counts over all training texts: summed in tasks, then by class. A fixed number of rows reaches the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # (TOP + TAIL + 1) x STATES numbers
    columns = [f"s{k}" for k in range(STATES)]

    def run(batches):
        counts = Counts()
        for pdf in batches:
            seqs = [np.frombuffer(x, "<u2") for x in pdf["classes"]]
            for part in batches_of(seqs):
                counts.likelihood += Batch([seqs[i] for i in part]).count(shared.value, counts)
        at = np.flatnonzero(counts.emit.any(1))
        rows = np.vstack([counts.emit[at], counts.move, counts.start, np.r_[counts.likelihood, np.zeros(STATES - 1)]])
        yield pd.DataFrame(rows, columns=columns).assign(row=np.r_[at, -1 - np.arange(STATES + 2)])[["row", *columns]]

    spread = texts.where("not held_out").select("classes")
    out = Counts()
    for r in spread.mapInPandas(run, "row int, " + ", ".join(f"{c} double" for c in columns)).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        values = np.array(r[1:], float)
        if r.row >= 0:
            out.emit[r.row] = values
        elif r.row == -1 - STATES:
            out.start = values
        elif r.row == -2 - STATES:
            out.likelihood = values[0]
        else:
            out.move[-1 - r.row] = values
    shared.unpersist()
    return out


def classed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Model, int]:
    """Texts as class sequences with their unigram scores; a model that has seen nothing yet; the training tokens."""
    read = scratch.table(blocks(docs), "blocks")
    words = read.where("kind = 1").select("block", "idx", "word", "c")
    counts = words.groupBy("word").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("blocks")).where("c > 0")
    vocabulary = scratch.table(counts, "vocabulary")
    tail = (TOP + F.crc32(F.expr("substring(word, -3, 3)")) % TAIL).cast("int")
    top = vocabulary.orderBy(F.desc("c"), "word").limit(TOP).collect()  # TOP words
    rank = F.broadcast(docs.sparkSession.createDataFrame([(bytearray(r.word), i, r.c) for i, r in enumerate(top)], "word binary, rank int, top_c long"))
    vocabulary = vocabulary.join(rank, "word", "left").select("word", "c", "blocks", "rank", F.coalesce("rank", tail).alias("class"))
    mass, once, v, n = np.zeros(UNKNOWN), 0, 0, 0
    for r in vocabulary.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():
        mass[r["class"]] = r.c + ADD * r.v
        once, v, n = once + r.once, v + r.v, n + r.c
    floor = ADD / (n + ADD * (v + 1))
    share = (mass + 1e-3) / (mass.sum() + 1e-3 * UNKNOWN)
    unknown = min(0.5, max((once + 0.5) / (n + 1), floor))
    model = Model(share, unknown)
    log_mass = np.log10(np.maximum(mass, ADD))
    log_n = np.log10(n + ADD * (v + 1))

    def join(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        own = texts["kind"] == 2
        kind = TOP + np.frombuffer(texts.loc[own, "tokens"].iloc[0], "<u2").astype(np.int64)
        texts = texts[~own]
        tokens = [np.frombuffer(x, "<u4").astype(np.int64) for x in texts["tokens"]]
        train = [t for t, out in zip(tokens, texts["held_out"], strict=True) if not out]
        c = np.bincount(np.concatenate(train), minlength=len(kind)).astype(float) if train else np.zeros(len(kind))
        ranked = words["rank"].to_numpy() >= 0
        c[words["idx"]] = words["c"]
        kind[words["idx"][ranked]] = words["rank"][ranked]
        kind = np.where(c > 0, kind, UNKNOWN)
        base = np.log10(c + ADD) - log_n
        inner = np.where(c > 0, np.log10(c + ADD) - np.r_[log_mass, 0][kind], 0.0)
        rows = [(len(t), int((c[t] > 0).sum()), float(base[t].sum()), float(inner[t].sum()), kind[t].astype("<u2").tobytes()) for t in tokens]
        more = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "inner", "classes"])
        return pd.concat([texts[["doc_id", "no_id", "held_out"]].reset_index(drop=True), more], axis=1)

    # sent back to a block: the top words, and the words whose count is not the block's own
    known = words.join(rank, "word").select("block", "idx", F.col("top_c").alias("c"), "rank")
    shared = vocabulary.where("blocks > 1 and rank is null").select("word", F.col("c").alias("total"))
    rest = words.join(rank, "word", "left_anti").join(shared, "word").where("c != total").select("block", "idx", F.col("total").alias("c"), F.lit(-1).alias("rank"))
    known = known.union(rest).withColumnRenamed("block", "of_block")
    texts = read.where("kind != 1").select("block", "kind", *id_parts(F.col("doc_id")), "held_out", "tokens")
    out = texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(join, "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary")
    out = scratch.table(out, "classed")
    scratch.drop("blocks")
    scratch.drop("vocabulary")
    return out, model, n


def train(texts: DataFrame, model: Model, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the training texts of a table until the likelihood settles."""
    before = None
    for _ in range(iterations):
        counts = expect(texts, model)
        if not counts.start.any():  # no training texts
            break
        model.update(counts)
        if before is not None and counts.likelihood - before < SETTLED * -before:
            break
        before = counts.likelihood
    return model


def score(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    texts, model, n = classed(docs, scratch)
    start = texts.where("not held_out").where(F.pmod(F.xxhash64("doc_id", "classes"), F.lit(START)) == 0)
    model = train(scratch.table(start.select("held_out", "classes"), "start"), model, iterations)
    shared = spark.sparkContext.broadcast(train(texts, model, iterations))

    def run(batches):
        for pdf in batches:
            seqs = [np.frombuffer(x, "<u2") for x in pdf["classes"]]
            likelihood = np.zeros(len(seqs))
            for part in batches_of(seqs):
                likelihood[part] = Batch([seqs[i] for i in part]).forward(shared.value, False)[0]
            yield pdf[["doc_id", "no_id", "held_out", "n_tokens", "n_known", "base_score"]].assign(score=likelihood + pdf["inner"])

    out = texts.mapInPandas(run, "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(id_back(), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_hmm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
