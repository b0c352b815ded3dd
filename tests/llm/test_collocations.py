"""Phrase collocations against plain counting: overlaps, pieces, languages, ties, odd texts."""

import random
import re
from collections import Counter

import pytest

from panelforge.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, f int"  # phrase and f clash with names used inside
FOLD = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def brute(rows, least, top):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for text, at in rows:
            if (at or "und") == lang:
                for w in pieces(text):
                    f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {(q, c) for p, c in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) for q in [p[i:j]] if len(q) < len(p)}
        scored = []
        for p, a in found.items():
            if (p, a) in inside:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        out += [(lang, rank, x[2].decode(), *x[3:]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = "the of and to in that it is was for New YORK été 日本 𝔘 a-b <x> \x1f (c) it's zum".split(" ")
    out = []
    for i in range(160):
        t = ""
        for _ in range(rng.randint(0, 60)):
            t += rng.choice(["New York City Hall now", "to be or not to be", "été à la", rng.choice(words), rng.choice(words), f"w{rng.randrange(500)}"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", " . "])
        out.append((t, rng.choice(["en", "en", "fr", None, "und"])))
    out += [("", "en"), (None, "fr"), (None, None), ("...", "xx"), (" \t\n", "yy"), ("a " * 3000, "de"), ("one two " * 1500 + "x" * 70_000, "de")]
    return out + out[:5] * 3


@pytest.mark.parametrize(("automaton", "window"), [(150_000, 1 << 20), (40, 500)])
def test_equals_plain_counting(spark, rows, monkeypatch, automaton, window):
    monkeypatch.setattr(collocations, "AUTOMATON", automaton)  # several automata
    monkeypatch.setattr(collocations, "WINDOW", window)
    docs = spark.createDataFrame([(i, t, lang, "p", 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    assert sorted(map(tuple, collocations.mine(docs, at_least=12, top=25).collect())) == brute(rows, 12, 25)


def test_small_sketch_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 4)
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    docs = spark.createDataFrame([(i, t, lang, "p", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, collocations.mine(docs, at_least=12, top=25).collect())) == brute(rows, 12, 25)


def test_sketch_rules_rare_phrases_out(spark, rows):
    docs = spark.createDataFrame([(t or "", lang or "und") for t, lang in rows], "text string, lang string")
    known = []
    for lengths in ((1,), (2,), (3, 4, 5)):
        known.append(collocations.sketch(docs, lengths, known, 16, 12))
    found = {(r.lang, r.phrase) for r in collocations.candidates(docs, known).collect()}
    f = Counter((lang or "und", " ".join(w[i : i + k])) for t, lang in rows for w in pieces(t) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p for p, c in f.items() if c >= 12}
    assert often <= found
    assert len(found) < 1.2 * len(often) < len(f) / 3


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_lose_no_phrase():
    raw = collocations.normal(" ".join(f"w{i % 97}" for i in range(5000)))
    for size in (40, 333):
        old, collocations.WINDOW = collocations.WINDOW, size
        try:
            parts = list(collocations.windows(raw))
        finally:
            collocations.WINDOW = old
        words = raw.split()
        want = {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
        got = {b" ".join(w[i : i + 5]) for p in parts for w in [p.split()] for i in range(len(w) - 4)}
        assert want == got


def test_a_text_meets_few_automata_however_many_phrases_there_are(spark, tmp_path, monkeypatch):
    """Blocks of texts that share nothing: with more of them each is still scanned by its own phrases only."""
    monkeypatch.setattr(collocations, "AUTOMATON", 60)
    monkeypatch.setattr(collocations, "WINDOW", 500)

    def scanned(n):
        at = tmp_path / str(n)
        at.mkdir()
        whole = collocations.occurrences

        def counted(phrases, texts):
            with open(at / "scans", "a") as f:
                f.write(f"{-(-len(phrases) // collocations.AUTOMATON) * sum(map(len, texts))}\n")
            return whole(phrases, texts)

        monkeypatch.setattr(collocations, "occurrences", counted)
        docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j % 9}" for j in range(120)), "en", "p", 1) for i in range(n)], SCHEMA).coalesce(1)
        assert collocations.mine(docs, at_least=12, top=5).count() == 5
        monkeypatch.setattr(collocations, "occurrences", whole)
        return sum(map(int, (at / "scans").read_text().split()))

    assert scanned(80) < 6 * scanned(20)
