"""Ids of the public tokenizers, by two engines that agree.

A vocabulary is read from its file for the tokenizers library; from the same file come the byte strings and ranks for
tiktoken's engine, which does the same merges in a fifth of the time. Texts are cut into words beforehand where that is
quicker: with word ends, a space after each word stands for the end mark. Texts with characters for which the cut has not
been shown to be the same (``_OTHER``) go whole to the library. Nothing is remembered from text to text.

Strings of special tokens in a text are ordinary text, as the vocabularies' README calls the library; ``special=True`` makes
them their ids instead, by the library alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import id_back, id_parts

#: How byte-level vocabularies cut a text (fixed value); the second is the same where white space never comes twice.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT_SINGLE = CUT.replace(r"\s+(?!\S)|", "")
#: With word ends: what is no run of letters. Contractions, single digits, runs of other marks (fixed value), for ASCII and for Latin letters.
_ASCII_MARKS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+")
_LATIN_MARKS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: Outside ASCII text, white space, Latin letters that have a plain lower case, and common marks.
_OTHER = re.compile(r"[^\t-\r -~\u00a1-\u00a9\u00ab-\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u012f\u0131-\u017f\u2013\u2014\u2018-\u201f\u2026]")
#: Bytes of plain texts: ASCII without control characters, and U+00C0 to U+00FF (0xC3 and what follows it).
_PLAIN = bytes([*range(9, 14), *range(32, 127), 0xC3, *range(0x80, 0xC0)])
_BLANK = bytes(32 if b in range(9, 14) else b for b in range(256))
_RUN = re.compile(r"\s{1000}")
WORD_END, BETWEEN = "</w>", "\x1e"
NEVER = "\x1d\x1e\x1d"
#: Classes of bytes: 0 white space (and BETWEEN), 1 letters, 2 other marks, 3 digits; a word ends between unlike ones, and after a digit.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(9, 14), 32, ord(BETWEEN)]] = 0
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 3
_ENDS = np.array([a and b and (a != b or a == 3) for a in range(4) for b in range(4)], bool)
_SPACED = np.frombuffer(_BLANK, np.uint8)

_loaded: dict = {}


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: shown characters themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _plain_words(texts: list[str]) -> list[str]:
    """Plain texts without apostrophes, with a space after each of their words: all at once, over their bytes."""
    raw = np.frombuffer(BETWEEN.join(texts).lower().encode(), np.uint8)
    kind = _CLASS[raw]
    ends = np.flatnonzero(_ENDS[4 * kind[:-1] + kind[1:]]) + 1
    return np.insert(_SPACED[raw], ends, 32).tobytes().decode().split(BETWEEN)


class Encoder:
    """texts -> ids as bytes (little-endian unsigned 16-bit)."""

    def __init__(self, path: str, keeps_space: bool, special: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids must fit in 16 bits")
        self.keeps_space, self.special = keeps_space, special
        byte = _bytes_of()
        ranks = {}
        for name, i in self.library.get_vocab(with_added_tokens=False).items():
            stem = name if keeps_space else name.removesuffix(WORD_END)
            ranks[bytes(byte[c] for c in stem) + b" " * (stem != name)] = i

        def engine(cut: str) -> Callable[[str], bytes]:
            """Ids come as a buffer, not as a list of Python's numbers. That takes a special token, which is never allowed: its string is ordinary text."""
            made = tiktoken.Encoding(path, pat_str=cut, mergeable_ranks=ranks, special_tokens={NEVER: 1 << 16})
            return lambda text: made.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()

        self.engine = engine(CUT if keeps_space else "[^ ]+ ")
        self.single = engine(CUT_SINGLE) if keeps_space else self.engine

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def with_spaces(self, text: str) -> bytes:
        raw = text.encode()
        blank = raw.translate(_BLANK)
        if not raw.translate(None, _PLAIN) and b"  " not in blank.rstrip():
            return self.single(text)
        # the engine's search gives up on very long runs of white space
        long = b" " * 1000 in blank if text.isascii() else _RUN.search(text)
        return self.whole([text])[0] if long else self.engine(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.special:
            return self.whole(texts)
        if self.keeps_space:
            return [self.with_spaces(t) for t in texts]
        out: list = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            raw = text.encode()
            if not raw.translate(None, _PLAIN) and b"'" not in raw and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw:
                plain.append(i)
            elif _OTHER.search(text):
                out[i] = self.whole([text])[0]
            else:
                words = (_ASCII_MARKS if text.isascii() else _LATIN_MARKS).sub(r" \g<0> ", text.lower()).split()
                out[i] = self.engine(" ".join(words) + " ") if words else b""
        if plain:
            for i, words in zip(plain, _plain_words([texts[i] for i in plain]), strict=True):
                out[i] = self.engine(words + " ")
        return out


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One for each worker process, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = Encoder(path, keeps_space)
    return _loaded[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(texts: list[str], chars: int = 400_000):
    """Index ranges of about so many characters, for bounded memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenised(docs: DataFrame, vocab: str, keeps_space: bool, end: int) -> DataFrame:
    """doc_id, ids (little-endian 16-bit, with the end id), n."""

    def run(batches):
        enc = encoder(vocab, keeps_space)
        tail = np.array([end], "<u2").tobytes()
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in blocks(texts):
                ids = [x + tail for x in enc.encode(texts[a:b])]
                yield pdf.iloc[a:b][["doc_id", "no_id"]].assign(ids=ids, n=[len(x) // 2 for x in ids])

    return docs.select(*id_parts(F.col("doc_id")), "text").mapInPandas(run, "doc_id long, no_id boolean, ids binary, n long").select(id_back(), "ids", "n")
