"""SentencePiece encoding and decoding (1): an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reports, at each end position, every piece that ends there (it follows its output links, longest first); each
relaxes the best score at that position. A character that no piece covers costs the lowest score less 10 and is spelt in
byte pieces. Of equal scores the piece that begins first wins. This is segmentation by piece scores (the unigram
reading of a model), for any model file; for a model trained as BPE it can differ from merge order, by design.

Where no piece holds a space mark after another character, a text's best path goes through every such boundary, so it is found
chunk by chunk, and each worker remembers the chunks it has met (``REMEMBERED`` at most).

Defined results: null text is empty and has no ids; decode(encode(t)) is t for any text that lacks the mark U+2581 (which
decodes to a space, as in the library). Repeated rows are encoded each. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import id_back, id_parts, ship
from panelforge.llm.tokens import blocks, vocabulary

MARK = "▁"
REMEMBERED = 400_000
UNKNOWN_PENALTY = 10.0


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > 65536:
            raise ValueError("ids must fit in 16 bits")
        self.automaton = ahocorasick.Automaton()
        self.byte = {}
        scores = []
        self.shown: list = []  # what an id decodes to: text, or a byte
        self.single = set()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.shown.append(int(piece[3:-1], 16))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.shown.append("")
            else:
                scores.append(sp.get_score(i))
                self.automaton.add_word(piece, (i, len(piece), sp.get_score(i)))
                self.shown.append(piece)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown_id, self.unknown = sp.unk_id(), min(scores) - UNKNOWN_PENALTY
        apart = all(MARK not in p.lstrip(MARK) for p in self.shown if isinstance(p, str))
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if apart else lambda s: [s] if s else []
        self.known: dict[str, bytes] = {}

    def viterbi(self, s: str) -> list[int]:
        """Ids of a normalised text."""
        best, back = [0.0] + [float("-inf")] * len(s), [(0, 0)] * (len(s) + 1)
        matches, single, unknown = self.automaton.iter(s), self.single, self.unknown
        end, found = next(matches, (len(s), None))
        for at in range(len(s)):
            top, how = float("-inf"), None
            while end == at:
                i, n, score = found
                score += best[at + 1 - n]
                if score > top:
                    top, how = score, (i, n)
                end, found = next(matches, (len(s), None))
            if s[at] not in single and best[at] + unknown > top:
                top, how = best[at] + unknown, (-1, 1)
            best[at + 1], back[at + 1] = top, how
        out, at = [], len(s)
        while at:
            i, n = back[at]
            if i < 0:
                spelt = [self.byte.get(b, self.unknown_id) for b in s[at - 1].encode()] if self.byte else [self.unknown_id]
                out.extend(reversed(spelt))
            else:
                out.append(i)
            at -= n
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids, little-endian unsigned 16-bit."""
        cut = self.chunks(self.library.normalize(text))
        known = self.known
        for c in cut:
            if c not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                    return self.encode(text) if len(set(cut)) < REMEMBERED else b"".join(np.array(self.viterbi(x), "<u2").tobytes() for x in cut)
                known[c] = np.array(self.viterbi(c), "<u2").tobytes()
        return b"".join(map(known.__getitem__, cut))

    def decode(self, ids: bytes) -> str:
        shown = [self.shown[i] for i in np.frombuffer(ids, "<u2").tolist()]
        if any(isinstance(x, int) for x in shown):
            out: list[str] = []
            held = bytearray()
            for x in [*shown, ""]:
                if isinstance(x, int):
                    held.append(x)
                else:
                    if held:
                        out.append(held.decode("utf-8", "replace"))
                        held.clear()
                    out.append(x)
            shown = out
        text = "".join(shown).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text  # the mark put before every text


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (little-endian 16-bit), n_tokens, and whether the ids decode to the text again."""
    ship(docs.sparkSession)

    def run(batches):
        p = pieces(model)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in blocks(texts):
                ids = [p.encode(t) for t in texts[a:b]]
                same = [p.decode(x) == t for x, t in zip(ids, texts[a:b], strict=True)]
                yield pdf.iloc[a:b][["doc_id", "no_id"]].assign(ids=ids, n_tokens=[len(x) // 2 for x in ids], round_trip=same)

    coded = docs.select(*id_parts(F.col("doc_id")), "text").mapInPandas(run, "doc_id long, no_id boolean, ids binary, n_tokens long, round_trip boolean")
    return coded.select(id_back(), "ids", "n_tokens", "round_trip")


def decode(ids: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    ship(ids.sparkSession)

    def run(batches):
        p = pieces(model)
        for pdf in batches:
            yield pdf[["doc_id", "no_id"]].assign(text=[p.decode(x or b"") for x in pdf["ids"]])

    return ids.select(*id_parts(F.col("doc_id")), "ids").mapInPandas(run, "doc_id long, no_id boolean, text string").select(id_back(), "text")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the 16-bit ids) and round_trip."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "round_trip")
