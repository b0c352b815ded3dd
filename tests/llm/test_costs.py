"""What makes ids and packing cheap, and that results stay."""

import numpy as np
import pytest

from panelforge.llm import packing
from panelforge.llm.tokens import NEVER, Encoder, vocabulary


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_the_engine_gives_bytes_and_takes_every_string_as_text(name, keeps_space):
    enc = Encoder(vocabulary(name), keeps_space)
    assert isinstance(enc.engine("a word "), bytes)
    texts = ["", " ", "a", "plain words, 12 of them", f"a {NEVER} b", NEVER * 3, f"caf\u00e9{NEVER}\u4e2d\u6587 it's", "\x1d\x1e", "  two  spaces\n\n\tand tabs ", "\u4e2d" + NEVER]
    assert enc.encode(texts) == enc.whole(texts)


def shard(n: int = 600):
    rng = np.random.default_rng(3)
    return [rng.zipf(1.3, rng.integers(1, 300)).clip(0, 5000).astype("<u2") for _ in range(n)]


def test_seeds_are_scored_in_blocks(monkeypatch):
    ids = shard()
    idf = np.log(1 + np.arange(1, packing.VOCABULARY + 1) / 100.0)
    index = packing.Index(ids, idf, 150.0)
    together = [index.scores(k) for k in range(len(ids))]
    assert len(index.blocks) == -(-len(ids) // packing.BLOCK)
    monkeypatch.setattr(packing, "TOGETHER", 0)
    alone = packing.Index(ids, idf, 150.0)
    for k, scores in enumerate(together):
        np.testing.assert_allclose(scores, alone.scores(k), rtol=1e-4)
    assert not alone.blocks
    before = index.scores(0).copy()
    index.retrieve(0)
    np.testing.assert_array_equal(before, index.scores(0))  # what is used is struck out of a copy


@pytest.mark.parametrize("together", [0, 3000])
def test_every_id_is_packed_once(monkeypatch, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    ids = [*shard(300), np.zeros(1, "<u2"), np.zeros(1, "<u2")]
    pieces = packing.pack_shard(ids, np.ones(packing.VOCABULARY), 150.0, 64)
    seen = [np.zeros(len(x), int) for x in ids]
    for doc, start, n, *_ in pieces:
        seen[doc][start : start + n] += 1
    assert all((x == 1).all() for x in seen)


def test_chosen_pairs_of_one_slot_are_all_replaced():
    """A slot tells one chosen pair only; keys that are not that pair are looked up among all."""
    from panelforge.llm import grammar

    ids = np.random.default_rng(4).integers(0, 700, 300_000).astype(np.uint32)
    seq, pairs = grammar._round(ids, grammar.FIRST_RULE, 60_000, 1)
    assert len(np.unique(grammar._slots(pairs))) < len(pairs)
    rules = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
    assert (grammar.expand(seq, rules) == ids).all()
    keys = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:]
    chosen, left = np.isin(keys, pairs), (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
    assert chosen.sum() > 100_000 and not np.isin(left, pairs).any()
