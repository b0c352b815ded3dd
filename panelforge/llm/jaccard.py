"""N-gram Jaccard join (8): grouped prefix join over sets of five-word shingles, exact at 100 * intersection >= 75 * union.

1. A sketch of fixed size counts shingles over all documents; it orders shingles from rare to common. Any fixed order is
   exact, this one keeps common passages out of prefixes.
2. Each document's set, in that order, has a prefix of n - ceil(3n/4) + 1 shingles; linked sets share one of them.
   Documents with equal sets form a class; documents with equal prefix and size form a group, and only groups are posted:
   a task posts a group once however many copies it holds. Postings travel as packed arrays to owners of hash ranges, in
   8 bytes each at most however many owners there are. Groups whose 32-bit numbers clash meet as candidates and no more.
   Shingles that the sketch shows to be in more than ``HOT`` documents go as rows instead and meet in partial sums.
3. An owner keeps the shingles which two groups post. Their member lists ("runs", equal lists once) are all that remains
   of the table; groups are then expanded to classes, and a group of several classes is a run too.
4. Runs of at most ``SHORT`` classes give all their pairs. In longer runs that still span components, rounds pair each class
   outside the run's largest component with that component's leader of this round, another one in each run; links contract
   components. What is then still outside is compared with its whole run in blocks of at most about two times ``BLOCK``
   classes, overlapping runs together, on parity bitmaps, and only pairs that may link leave a block. So no link between components is lost, and a
   run of m near copies costs about m pairs, not m squared.
5. A pair is tested on parity bitmaps first, which can only overrate a pair, then on whole sets. Bitmaps are all that is kept
   of candidates, who become nearly all documents as the corpus grows; whole sets are made anew for pairs that may link.

Defined results: null, empty and blank texts have no shingles and are linked with nothing (component_id is their own
doc_id). Repeated rows share a class. A null doc_id takes part but names no component: the smallest other doc_id does,
or null if there is none. Columns besides doc_id and text are not read by ``components`` and pass ``keep`` unchanged;
``keep`` leaves one row of each component, that of the smallest doc_id (null last), then of the smallest text digest, and
every row without words.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_ROWS, LOWER_SQL, WORDS_SQL, Scratch, checked_broadcast, id_parts, salt_of, ship

K = 5
SKETCH_BITS = 21
CHUNK = 16_384
OWNER_POSTINGS = 1_000_000
GROUP_BITS = 32
HOT = 200_000
SHORT = 8
ROUNDS = 2
BLOCK = 2_000
BLOCK_SHINGLES = 8_000_000
CLUMP = 16
NEEDED = 200_000
#: Bits of the map of wanted rows that stands in for a broadcast of many row ids.
MAP_BITS = 1 << 26
ONE_TASK_EDGES = 200_000
_P = np.array([pow(0x9E3779B97F4A7C15, K - 1 - i, 1 << 64) for i in range(K)], np.uint64)


_ODD = np.uint64(0xD1342543DE82EF95)
_UNODD = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
WINDOW = 1 << 20
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers_of(n: int) -> list[np.ndarray]:
    """_ODD and its inverse to the powers 0 to n - 1, as arrays of at least that length and twice that at most."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full((1 << n.bit_length()) - 1, x)]) for x in (_ODD, _UNODD)]
    return _powers


def _hash_words(raw: np.ndarray) -> np.ndarray:
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers_of(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, from sums over its bytes; A-Z as a-z, white space of ASCII. Works through windows cut at white space."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)  # bytes: A-Z only
    if len(raw) <= WINDOW:
        return _hash_words(raw)
    out, a = [], 0
    while a < len(raw):
        b = min(len(raw), a + WINDOW)
        while b < len(raw) and not _SPACE[raw[b - 1]]:  # on to the end of the word
            more = np.flatnonzero(_SPACE[raw[b : b + WINDOW]])
            b = b + int(more[0]) + 1 if len(more) else min(len(raw), b + WINDOW)
        out.append(_hash_words(raw[a:b]))
        a = b
    return np.concatenate(out)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    if len(h) < K:
        return _mix((h * _P[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    s = h[: len(h) - K + 1] * _P[0]
    for i in range(1, K):
        s += h[i : len(h) - K + 1 + i] * _P[i]
    s = _mix(s)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 4 * len(a) < 3 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Occurrence counts of shingles by the top SKETCH_BITS bits of their hash (a task counts to 65,535 at most), and their sum."""

    def count(batches):
        total, seen = np.zeros(1 << SKETCH_BITS, np.uint32), False
        for pdf in batches:
            for text in pdf["text"]:
                slots = (shingles(text) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                np.add.at(total, slots, np.uint32(1))
                seen = True
        if seen:
            for c in range(0, len(total), CHUNK):
                yield pd.DataFrame({"chunk": [c // CHUNK], "counts": [np.minimum(total[c : c + CHUNK], 65535).astype("<u2").tobytes()]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for chunk, x in zip(pdf["chunk"].tolist(), pdf["counts"], strict=True):
                if chunk not in sums:
                    sums[chunk] = np.zeros(CHUNK, np.uint64)
                sums[chunk] += np.frombuffer(x, "<u2")
        for chunk, x in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "counts": [x.astype("<u8").tobytes()]})

    # a chunk's counts pass through its task in small batches, however many tasks have counted
    parts = docs.select("text").mapInPandas(count, "chunk int, counts binary").repartition("chunk")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in parts.mapInPandas(add, "chunk int, counts binary").collect():  # 2**SKETCH_BITS numbers in all
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, "<u8")
    return out, int(out.sum())


def _pack(tokens: np.ndarray, at: np.ndarray, gids: np.ndarray) -> bytes:
    """Postings by group (at, ascending): gids, their numbers of tokens (or else a gid for each token), tokens; 8 bytes each at most."""
    used, n = np.unique(at, return_counts=True)
    by_group = 2 * len(used) < len(tokens)
    head = gids[used].astype("<u4").tobytes() + n.astype("<u4").tobytes() if by_group else gids[at].astype("<u4").tobytes()
    return struct.pack("<I", len(used) * by_group) + head + tokens.astype("<u4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (g,) = struct.unpack_from("<I", data)
    if not g:
        n = (len(data) - 4) // 8
        return np.frombuffer(data, "<u4", n, 4 + 4 * n), np.frombuffer(data, "<u4", n, 4)
    gids, n = np.frombuffer(data, "<u4", g, 4), np.frombuffer(data, "<u4", g, 4 + 4 * g)
    return np.frombuffer(data, "<u4", offset=4 + 8 * g), np.repeat(gids, n)


def prefixes(docs: DataFrame, counts: np.ndarray, owners: int) -> DataFrame:
    """kind 0: a row for each document (doc_id, n, cls, gid, and as blob its text's digest); kind 1: packed postings for an owner; kind 2: a hot posting."""
    import xxhash

    level = np.minimum(np.round(10 * np.log2(1 + counts.astype(float))), 255).astype(np.uint64)
    hot, mask = counts > HOT, (1 << GROUP_BITS) - 1
    shared = docs.sparkSession.sparkContext.broadcast((level.astype(np.uint8), np.packbits(hot)))  # 2**SKETCH_BITS bytes

    def run(batches):
        level, hot = shared.value[0], np.unpackbits(shared.value[1]).astype(bool)
        seen: set[int] = set()
        width = np.uint64((1 << 64) // owners + 1)
        for pdf in batches:
            rows, tokens, at, gids, hots = [], [], [], [], []
            for doc_id, no_id, text in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"], strict=True):
                doc_id = None if no_id else doc_id
                s = shingles(text)
                n = len(s)
                if not n:
                    rows.append((doc_id, 0, None, None, None))
                    continue
                slot = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                size = prefix_length(n)
                order = (level[slot].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                head = np.sort(s[np.argpartition(order, size - 1)[:size]])
                group = xxhash.xxh3_64_intdigest(head.tobytes(), seed=n)
                gid = group & mask
                rows.append((doc_id, n, xxhash.xxh3_128_digest(s.tobytes()), gid, hashlib.md5(text.encode()).digest()))
                if group in seen:
                    continue
                seen.add(group)
                if len(seen) > 500_000:
                    seen.clear()
                warm = hot[(head >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                hots += [(int(t), gid, n) for t in head[warm].view(np.int64)]
                head = head[~warm]
                tokens.append(head)
                at.append(np.full(len(head), len(gids), np.int64))
                gids.append(gid)
            ids, ns, classes, of, digests = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": ns, "cls": classes, "gid": pd.array(of, "Int64"), "blob": digests})  # never through floats
            yield out.assign(kind=0, owner=0, token=pd.NA)[COLUMNS]
            if hots:
                hot_rows = pd.DataFrame(hots, columns=["token", "gid", "n"])
                yield hot_rows.assign(kind=2, owner=0, doc_id=pd.array([None] * len(hots), "Int64"), cls=None, blob=None)[COLUMNS]
            if gids:
                t, a, g = np.concatenate(tokens), np.concatenate(at), np.array(gids, np.uint32)
                own = (t // width).astype(np.int64)
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(owners + 1))
                full = [o for o in range(owners) if cuts[o] < cuts[o + 1]]
                blobs = [_pack(t[i] & np.uint64(0xFFFFFFFF), a[i], g) for o in full for i in [order[cuts[o] : cuts[o + 1]]]]
                none = pd.array([None] * len(full), "Int64")
                yield pd.DataFrame({"kind": 1, "doc_id": none, "n": 0, "cls": None, "gid": none, "owner": full, "token": none, "blob": blobs})[COLUMNS]

    return docs.select(*id_parts(F.col("doc_id")), "text").mapInPandas(run, "kind int, doc_id long, n int, cls binary, gid long, owner int, token long, blob binary")


SETS = ["cls", "rep", "n", "bits"]
COLUMNS = ["kind", "doc_id", "n", "cls", "gid", "owner", "token", "blob"]


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Member lists of the shingles that two groups post; lists that are equal come once."""
    parts = [_unpack(x) for x in pdf["blob"]]
    token, gid = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = token[1:] == token[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    token, gid = token[shared], gid[order[shared]]
    order = np.lexsort((gid, token))
    token, gid = token[order], gid[order]
    first = np.r_[True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])] if len(token) else np.zeros(0, bool)
    token, gid = token[first], gid[first]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    if not len(starts):
        return pd.DataFrame({"run": [], "gid": []}).astype("int64")
    lengths = np.diff(np.r_[starts, len(token)])
    signature = _mix(np.add.reduceat(_mix(gid.astype(np.uint64)), starts) + lengths.astype(np.uint64))
    _, pick = np.unique(signature, return_index=True)
    pick = pick[lengths[pick] > 1]
    rows = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in pick]) if len(pick) else np.zeros(0, int)
    return pd.DataFrame({"run": np.repeat(signature[pick].view(np.int64), lengths[pick]), "gid": gid[rows].astype(np.int64)})


def _verify(batches):
    for pdf in batches:
        ok = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
        yield pdf.loc[ok, ["a", "b"]]


def _sets(batches):
    """Each text's class, row id, size of the set and parity bitmap (2 to 4 bits a shingle)."""
    import xxhash

    for pdf in batches:
        rows: list = []
        for rep, text in zip(pdf["rep"].tolist(), pdf["text"], strict=True):
            s = shingles(text)
            if len(s):
                bits = 1 << max(6, (2 * len(s) - 1).bit_length())
                parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), rep, len(s), np.packbits(parity.astype(np.uint8)).tobytes()))
        yield pd.DataFrame(rows, columns=SETS)


def _whole(batches):
    """Each text's class and whole set."""
    import xxhash

    rows: list = []
    size = 0
    for pdf in batches:
        for text in pdf["text"]:
            s = shingles(text)
            if len(s):
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), s.astype("<u8").tobytes()))
                size += len(s)
            if size >= 500_000:
                yield pd.DataFrame(rows, columns=["cls", "members"])
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["cls", "members"])


def rep_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-(2**63)))


def texts_of(reps: DataFrame, docs: DataFrame, make: Callable | None = None, schema: str = "rep long, text string") -> DataFrame:
    """rep, text of the rows that reps names, or what ``make`` makes of batches of them; if those are many, of some more, so that no text is ever shuffled.

    Many row ids become a map of ``MAP_BITS`` bits, and a row stays if its id's bit is set. The worker that looks there runs
    ``make`` too: a second worker for each task would be that much more of an executor's memory.
    """
    texts = docs.select(rep_of(F.col("doc_id")).alias("rep"), "text")
    few = reps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        found = texts.join(F.broadcast(reps.distinct()), "rep", "left_semi")
        return found.mapInPandas(make, schema) if make else found
    bit = F.pmod(F.xxhash64("rep"), F.lit(MAP_BITS))
    parts = reps.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    found = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.collect():  # MAP_BITS bits in all
        found[(r.part - 1) * 4096 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)[: len(found) - (r.part - 1) * 4096]
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def pick(batches):
        for pdf in batches:
            bit = pdf["bit"].to_numpy()
            yield pdf.loc[(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool), ["rep", "text"]]

    return texts.withColumn("bit", bit).mapInPandas((lambda batches: make(pick(batches))) if make else pick, schema)


def _union(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        a, b = find(bytes(a)), find(bytes(b))
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"v": list(parent), "l": [find(x) for x in parent]}, columns=["v", "l"])


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, l): the smallest key of each vertex's component, for the vertices of (a, b).

    At most ONE_TASK_EDGES links, by count, are joined up in one task; beyond that, labels spread and jump, log-many times.
    """
    if edges.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        return scratch.table(edges.groupBy(F.lit(0).alias("one")).applyInPandas(_union, "v binary, l binary"), f"{name}-0")
    both = scratch.table(edges.union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("v", "l").alias("l")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("l").alias("m"))
        spread = labels.join(near, labels.v == near.a).select("v", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("l").alias("far"))
        new = spread.join(jump, "m").select("v", F.least("m", "far").alias("l"), (F.least("m", "far") != F.col("l")).alias("moved"))
        step += 1
        new = scratch.table(new, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("v", "l")
        if not new.where("moved").limit(1).count():
            return labels


def _may_link(batches):
    """Pairs whose parity bitmaps allow a link. A bit that differs is a shingle that only one set holds, so none is lost."""
    for pdf in batches:
        ok = []
        for x, y, n, m in zip(pdf["ba"], pdf["bb"], pdf["na"], pdf["nb"], strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            ok.append(7 * int(np.bitwise_count(x ^ y).sum()) <= n + m)
        yield pdf.loc[ok, ["a", "b"]]


def side(pairs: DataFrame, sets: DataFrame, k: str, *columns: str) -> DataFrame:
    """The sets of one side of the pairs, and no others; column c of side k as its first letter and k."""
    needed = checked_broadcast(pairs.select(F.col(k).alias("cls")).distinct(), NEEDED)
    return sets.join(needed, "cls", "left_semi").select(F.col("cls").alias(k), *[F.col(c).alias(c[0] + k) for c in columns])


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b), read from a table, that link by their whole sets, which are made anew of the texts of these classes only."""
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    asked = scratch.table(sets.join(checked_broadcast(asked, NEEDED), "cls", "left_semi").select("cls", "rep"), f"{name}-asked")
    found = texts_of(asked.select("rep"), docs, _whole, "cls binary, members binary")
    found = found.join(checked_broadcast(asked.select("cls"), NEEDED), "cls", "left_semi")
    whole = scratch.table(found.dropDuplicates(["cls"]), f"{name}-whole")
    both = pairs.join(side(pairs, whole, "a", "members"), "a").join(side(pairs, whole, "b", "members"), "b")
    out = both.select("a", "b", F.col("ma").alias("sa"), F.col("mb").alias("sb")).mapInPandas(_verify, "a binary, b binary")
    out = scratch.table(out, name)
    scratch.drop(f"{name}-whole")
    return out


def checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that link: by bitmap first, then by whole sets."""
    pairs = scratch.table(pairs.distinct(), f"{name}-pairs")
    maps = pairs.join(side(pairs, sets, "a", "bits", "n"), "a").join(side(pairs, sets, "b", "bits", "n"), "b").select("a", "b", "ba", "bb", "na", "nb")
    near = scratch.table(maps.mapInPandas(_may_link, "a binary, b binary"), f"{name}-near")
    return verified(near, sets, docs, scratch, name)


def links(members: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(cls, comp) of the classes that have links. members: run, cls, n; docs: the rows that classes were made of."""
    sizes = members.groupBy("run").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sized = scratch.table(members.join(sizes, "run").select("run", "cls", "n", "m"), "sized")
    short, long = sized.where(F.col("m") <= SHORT), sized.where(F.col("m") > SHORT)

    def fits(a: str, b: str) -> str:
        return f"4 * least({a}, {b}) >= 3 * greatest({a}, {b})"

    pairs = short.alias("x").join(short.alias("y"), "run").where("x.cls < y.cls and " + fits("x.n", "y.n"))
    edges = checked(pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")), sets, docs, scratch, "links-short")
    comp, news = None, bool(edges.limit(1).count())
    for turn in range(ROUNDS + 1):
        if news:
            comp = connected(edges, scratch, f"comp-{turn}").select(F.col("v").alias("cls"), F.col("l").alias("comp"))
        now = long.withColumn("comp", F.col("cls")) if comp is None else long.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        # the runs that span components, with their largest one
        parts = now.groupBy("run", "comp").agg(F.count(F.lit(1)).alias("k"))
        tops = parts.groupBy("run").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m")).where("top.k < m")
        tops = scratch.table(tops.select("run", F.col("top.comp").alias("top")), f"tops-{turn}")
        if not tops.limit(1).count():
            return comp
        now = now.join(checked_broadcast(tops, NEEDED), "run")
        if turn == ROUNDS or turn and not news:
            break
        lead = now.where("comp = top").groupBy("run").agg(F.min(F.struct(F.xxhash64("cls", "run", F.lit(turn)).alias("rank"), "cls", "n")).alias("lead"))
        pairs = now.where("comp != top").join(checked_broadcast(lead, NEEDED), "run").where(fits("n", "lead.n"))
        found = checked(pairs.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")), sets, docs, scratch, f"links-{turn}")
        news = bool(found.limit(1).count())
        edges = edges.union(found) if news else edges
    # leaders link no more, or took their rounds: what is outside meets its runs in blocks, which pass on only pairs that may link
    near = scratch.table(in_blocks(now, sets, scratch).distinct(), "near-rest")
    found = verified(near, sets, docs, scratch, "links-rest")
    if found.limit(1).count():
        comp = connected(edges.union(found), scratch, "comp-all").select(F.col("v").alias("cls"), F.col("l").alias("comp"))
    return comp


def _fold(maps: list[bytes], size: int) -> np.ndarray:
    """Parity bitmaps folded to `size` bytes, a row each."""
    out = np.zeros((len(maps), size), np.uint8)
    for i, x in enumerate(maps):
        for part in np.frombuffer(x, np.uint8).reshape(-1, size):
            out[i] ^= part
    return out


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of an asking row and another across components whose sizes and bitmaps allow a link."""
    asks = pdf["asks"].to_numpy(bool)
    n, comp = pdf["n"].to_numpy(np.int64), np.unique([bytes(x) for x in pdf["comp"]], return_inverse=True)[1]
    cls, bits = [bytes(x) for x in pdf["cls"]], [bytes(x) for x in pdf["bits"]]
    width = np.array([len(x) for x in bits])
    pairs: set[tuple[bytes, bytes]] = set()
    for w in np.unique(width[asks]):
        for v in (w // 2, w, 2 * w):  # linked sets differ by a third in size at most
            there, size = np.flatnonzero(~asks & (width == v)), int(min(v, w))
            if not len(there):
                continue
            folded = _fold([bits[k] for k in there], size)
            for x in np.flatnonzero(asks & (width == w)):
                some = np.flatnonzero((4 * n[x] >= 3 * n[there]) & (4 * n[there] >= 3 * n[x]) & (comp[there] != comp[x]))
                if len(some):
                    apart = np.bitwise_count(folded[some] ^ _fold([bits[x]], size)).sum(axis=1, dtype=np.int64)
                    pairs.update((min(cls[x], cls[y]), max(cls[x], cls[y])) for y in there[some[7 * apart <= n[there[some]] + n[x]]])
    return pd.DataFrame(list(pairs), columns=["a", "b"])


def in_blocks(now: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of classes outside their run's largest component with the rest of the run.

    Runs of near copies overlap. Those with the same largest component are put together, about ``CLUMP`` blocks' worth to a
    clump, so that two classes meet once or a few times and not in every run that they share. A clump is cut to chunks of
    about ``BLOCK`` classes.
    """
    weight = now.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / (CLUMP * BLOCK)).cast("int").alias("clumps"))
    rows = now.join(checked_broadcast(weight, NEEDED), "top").withColumn("clump", F.pmod(F.xxhash64("run"), F.col("clumps")).cast("int"))
    rows = scratch.table(rows.select("top", "clump", "cls", "n", "comp").dropDuplicates(["top", "clump", "cls"]), "clumps")
    out = F.col("comp") != F.col("top")
    chunks = lambda rows, size: F.greatest(F.ceil(F.greatest(rows / BLOCK, size / BLOCK_SHINGLES)), F.lit(1)).cast("int")
    cuts = rows.groupBy("top", "clump").agg(chunks(F.count(F.lit(1)), F.sum("n")).alias("all"), chunks(F.count_if(out), F.sum(F.when(out, F.col("n")).otherwise(0))).alias("asking"))
    needed = checked_broadcast(rows.select("cls").distinct(), NEEDED)
    rows = rows.join(checked_broadcast(cuts, NEEDED), ["top", "clump"]).join(sets.join(needed, "cls", "left_semi").select("cls", "bits"), "cls")
    rows = scratch.table(rows.withColumn("outside", out), "open")

    def dealt(rows: DataFrame, asks: bool, own: str, other: str, i: str, j: str) -> DataFrame:
        cut = rows.withColumn(i, F.pmod(F.xxhash64("cls"), F.col(own)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return cut.select("top", "clump", "i", "j", "cls", "n", "comp", "bits", F.lit(asks).alias("asks"))

    meet = dealt(rows.where("outside"), True, "asking", "all", "i", "j").union(dealt(rows, False, "all", "asking", "j", "i"))
    return meet.groupBy("top", "clump", "i", "j").applyInPandas(_block, "a binary, b binary")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def named_rows(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, digest, n and first, the (no_id, doc_id, digest) that its component keeps, of every row; both null without words."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, total = sketch(docs)
    owners = max(8, total // 4 // OWNER_POSTINGS + 1)
    posted = scratch.table(prefixes(docs, counts, owners), "posted")
    rows = scratch.table(posted.where("kind = 0").select("doc_id", "n", "cls", "gid", F.col("blob").alias("digest")), "rows")
    named = rows.where("n > 0").withColumn("salt", salt_of("doc_id"))

    cool = posted.where("kind = 1").select("owner", "blob").groupBy("owner").applyInPandas(_runs, "run long, gid long")
    hot = posted.where("kind = 2").select(F.col("token").alias("run"), "gid").distinct()
    runs = cool.union(hot).distinct()
    classes = named.groupBy("cls", "gid", "n", "salt").agg(F.min(rep_of(F.col("doc_id"))).alias("rep")).groupBy("cls", "gid", "n").agg(F.min("rep").alias("rep"))
    inner = classes.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gid", F.col("gid").alias("run"))
    runs = runs.union(inner.select("run", "gid"))
    members = scratch.table(runs.join(classes, "gid").select("run", "cls", "n", "rep"), "members")
    scratch.drop("posted")

    found = texts_of(members.select("rep"), docs, _sets, "cls binary, rep long, n int, bits binary")
    needed = members.select("cls").distinct()
    sets = scratch.table(found.join(needed, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    comp = links(members.select("run", "cls", "n"), sets, docs, scratch)

    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    part = named.groupBy("cls", "salt").agg(F.min(key).alias("first"))
    if comp is None:
        part = part.withColumn("comp", F.col("cls"))
    else:
        part = part.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    # the smallest row of each component, over its (class, salt) parts, again in two steps
    name = part.groupBy("comp", salt_of("cls", "salt").alias("s")).agg(F.min("first").alias("first")).groupBy("comp").agg(F.min("first").alias("first"))
    label = scratch.table(part.drop("first").join(name, "comp").select("cls", "salt", "first"), "labels")
    out = named.join(label, ["cls", "salt"]).select("doc_id", "digest", "n", "first")
    return out.unionByName(rows.where("n = 0").select("doc_id", "digest", "n"), allowMissingColumns=True)


def components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return named_rows(docs, scratch).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, and the rows without words, with all columns."""
    scratch = Scratch(docs.sparkSession)
    rows = named_rows(docs, scratch).where("n > 0")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    spare = rows.groupBy(F.col("doc_id").alias("spare_id"), F.col("digest").alias("spare_digest")).agg(F.first(chosen).alias("chosen"), F.count(F.lit(1)).alias("rows"))
    spare = scratch.table(spare.where("not chosen or rows > 1"), "spare")

    def of(keys: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        keys = checked_broadcast(keys.select("spare_id", "spare_digest"))
        return rows.join(keys, rows.doc_id.cast("long").eqNullSafe(keys.spare_id) & (text_digest(rows.text) == keys.spare_digest), how)

    left = of(spare.where("not chosen"), docs, "left_anti")
    again = spare.where("chosen")
    if not again.limit(1).count():
        return left
    # rows equal in doc_id and text: one of them
    names = [f"_{k}" for k in ("id", "digest")]
    more = of(again, left, "left_semi").withColumns({names[0]: F.col("doc_id").cast("long"), names[1]: text_digest(F.col("text"))})
    return of(again, left, "left_anti").union(more.dropDuplicates(names).drop(*names))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
with recursive w as (select doc_id, {WORDS_SQL.format(LOWER_SQL.format("coalesce(text, '')"))} as words from documents),
s as (select doc_id, case when len(words) = 0 then cast([] as varchar[]) when len(words) < 5 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) end as sh from w),
u as (select doc_id, len(sh) as n, unnest(sh) as g from s),
k as (select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n + b.n) as total from u a join u b on a.g = b.g and a.doc_id < b.doc_id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) group by 1, 2),
e as (select a, b from k where 100 * shared >= 75 * (total - shared)), l as (select a, b from e union all select b, a from e),
reach as (select doc_id, doc_id as met from documents union select reach.doc_id, l.b from reach join l on l.a = reach.met)
select s.doc_id, len(sh) as n_shingles, least(s.doc_id, m.low) as component_id from s join (select doc_id, min(met) as low from reach group by 1) m on m.doc_id = s.doc_id
"""
