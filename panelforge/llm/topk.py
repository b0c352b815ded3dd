"""Exact top-k search by inner product (12): pivot-table elimination.

Components become whole numbers, ``floor(64 * x)``. With M the greatest length of a vector, (x, sqrt(M^2 - |x|^2)) and
(q, 0) turn the highest inner product into the nearest neighbour, so the triangle inequality bounds scores:

1. Rows with equal vectors are one class. All its members score the same, and ties go to the smaller id, so only a class's
   first k + 1 rows can reach any answer; queries with equal vectors are asked once. A vector that a third of all rows hold
   costs no more than another.
2. ``PIVOTS`` pivots are taken, farthest first, from a sample of about ``SAMPLE`` vectors (they steer the work, not the
   result). The pivot table keeps each candidate's distance to every pivot; its nearest pivot names its cell. A cell's least
   and greatest distance to each pivot are a summary of fixed size.
3. A query first searches its own cell, which gives a score to beat. Then it visits only the cells whose bound reaches that
   score, in blocks of at most about ``BLOCK_ROWS`` candidates and ``QUERY_ROWS`` queries.
4. In a block the greatest lower bound over all pivots bounds each candidate's score; candidates are evaluated in the order
   of their bounds until the next bound is below the k-th best score so far. Scores are exact whole numbers.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those with a component of
2^20 or more, whose sums could pass 64 bits. Only vectors of equal length have an inner product; others do not meet. A row
with a null id is no query and comes after all others with its score. Repeated rows are rows of their own: each repeated
query is answered, and finds its copies but not itself. Columns beside the id and the vector are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import Scratch, id_parts, ship

SCALE, LIMIT = 64, 1 << 26
PIVOTS, SAMPLE = 48, 4096
BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096
TILE = 64
_FOUND = "cls binary, score long, vec_id long, no_id boolean, rid long"


def _matrix(column, dim: int, dtype="<i4") -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(-1, dim) if dim else np.zeros((len(column), 0), dtype)


def packed(rows: DataFrame, is_query: Column, id_name: str, vec_name: str) -> DataFrame:
    """rid, vec_id, no_id, asks, dim, squared length and the whole numbers of each usable vector as little-endian 32-bit integers."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LIMIT // SCALE))))
    found = rows.select(*id_parts(F.col(id_name), "vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vec_name).cast("array<double>").alias("v"))
    found = found.select(F.monotonically_increasing_id().alias("rid"), "*").where(fine).withColumn("v", F.transform(v, lambda x: F.floor(x * SCALE).cast("int")))

    def pack(batches):
        for pdf in batches:
            vecs = [np.asarray(x, "<i4") for x in pdf.pop("v")]
            yield pdf.assign(dim=[len(x) for x in vecs], square=[float((x.astype(np.float64) ** 2).sum()) for x in vecs], vec=[x.tobytes() for x in vecs])

    return found.mapInPandas(pack, "rid long, vec_id long, no_id boolean, asks boolean, dim int, square double, vec binary")


class Pivots:
    """Pivots of one vector length, with the distances in the space that has one more coordinate."""

    def __init__(self, points: np.ndarray, reach: float):
        self.points = points.astype(np.float64)
        self.reach = float(reach)  # M^2
        self.norms = (self.points**2).sum(axis=1)
        self.last = np.sqrt(np.maximum(0, self.reach - self.norms))
        self.slack = 4e-6 * np.sqrt(self.reach) + 1e-6

    def _flat(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(axis=1)[:, None] + self.norms - 2 * x @ self.points.T

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(0, self.reach - (x**2).sum(axis=1)))
        return np.sqrt(np.maximum(0, self._flat(x)) + (last[:, None] - self.last) ** 2).astype("<f4")

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self._flat(x)) + self.last**2).astype("<f4")

    def most(self, norms: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The greatest score that a lower bound of the distance leaves possible; rounded upwards."""
        least = np.maximum(lower - self.slack, 0) ** 2
        return (norms[:, None] + self.reach - least) / 2 + 1e-6 * (self.reach + norms[:, None]) + 1e-3


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    dim = int(pdf["dim"].iloc[0])
    x = _matrix(pdf["vec"], dim).astype(np.float64)
    picked = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(PIVOTS, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return pd.DataFrame({"dim": [dim], "points": [x[picked].astype("<i4").tobytes()], "n": [len(picked)]})


def choose_pivots(vecs: DataFrame) -> dict[int, Pivots]:
    """The pivots of each vector length. The driver holds PIVOTS vectors a length."""
    sizes = {r.dim: r for r in vecs.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.max("square").alias("reach")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for d, r in sizes.items() for x in (d, max(1, -(-(SAMPLE << 20) // r.rows)))])
    sample = vecs.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < share[F.col("dim")]).select("dim", "vec")
    found = {r.dim: r for r in sample.groupBy("dim").applyInPandas(_choose, "dim int, points binary, n int").collect()}
    out = {}
    for dim, r in sizes.items():
        points = np.frombuffer(found[dim].points, "<i4").reshape(found[dim].n, dim) if dim in found else np.zeros((1, dim), "<i4")
        out[dim] = Pivots(points, r.reach)
    return out


def pivot_table(vecs: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """Each row with its cell (nearest pivot) and its distances to all pivots."""

    def measure(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                near = pivots[dim].of_rows(_matrix(part["vec"], dim).astype(np.float64))
                yield part.assign(cell=near.argmin(axis=1).astype(np.int32), near=[x.tobytes() for x in near])

    kept = vecs.select("rid", "vec_id", "no_id", "dim", "vec")
    return kept.mapInPandas(measure, "rid long, vec_id long, no_id boolean, dim int, vec binary, cell int, near binary")


def cell_summaries(table: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """Rows, least and greatest distance to each pivot, for each cell: a summary of fixed size."""

    def part(batches):
        have: dict = {}
        for pdf in batches:
            for (dim, cell), rows in pdf.groupby(["dim", "cell"]):
                near = np.stack([np.frombuffer(x, "<f4") for x in rows["near"]])
                n, lo, hi = have.get((dim, cell), (0, np.inf, -np.inf))
                have[dim, cell] = n + len(near), np.minimum(lo, near.min(axis=0)), np.maximum(hi, near.max(axis=0))
        yield pd.DataFrame([(d, c, n, lo.astype("<f4").tobytes(), hi.astype("<f4").tobytes()) for (d, c), (n, lo, hi) in have.items()], columns=["dim", "cell", "n", "lo", "hi"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.stack([np.frombuffer(x, "<f4") for x in pdf[c]]) for c in ("lo", "hi"))
        return pd.DataFrame({"dim": pdf["dim"][:1], "cell": pdf["cell"][:1], "n": [pdf["n"].sum()], "lo": [lo.min(axis=0).tobytes()], "hi": [hi.max(axis=0).tobytes()]})

    schema = "dim int, cell int, n long, lo binary, hi binary"
    rows = table.select("dim", "cell", "near").mapInPandas(part, schema).groupBy("dim", "cell").applyInPandas(whole, schema).collect()
    return {(r.dim, r.cell): (r.n, np.frombuffer(r.lo, "<f4"), np.frombuffer(r.hi, "<f4")) for r in rows}


def best_of(z: np.ndarray, query: np.ndarray, bounds: np.ndarray, beat: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of all that may be among the k best: evaluated in the order of bounds, until the next bound is too low."""
    order = np.flatnonzero(bounds >= beat)
    order = order[np.argsort(-bounds[order], kind="stable")]
    scores = np.zeros(0, z.dtype)
    step, a = 4 * k, 0
    while a < len(order) and bounds[order[a]] >= beat:
        b = min(len(order), a + step)
        scores = np.r_[scores, z[order[a:b]] @ query]
        if len(scores) >= k:
            beat = max(beat, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
        a, step = b, 2 * step
    fit = scores >= beat
    return order[:a][fit], scores[fit]


def _search(pivots: dict[int, Pivots], k: int):
    def search(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        dim, p = key[0], pivots[key[0]]
        out = []
        if len(q) and len(c):
            z, y = _matrix(c["vec"], dim), _matrix(q["vec"], dim)
            exact = float(np.abs(z).max(initial=0)) * float(np.abs(y).max(initial=0)) * dim < 2**53
            z, y = (x.astype(np.float64 if exact else np.int64) for x in (z, y))
            near = np.ascontiguousarray(_matrix(c["near"], len(p.points), "<f4").T)
            asked, norms = p.of_queries(y.astype(np.float64)), (y.astype(np.float64) ** 2).sum(axis=1)
            ids = np.where(c["no_id"], np.iinfo(np.int64).max, c["vec_id"])
            rids, no_id, vec_id, cls, beat = (x.to_numpy() for x in (c["rid"], c["no_id"], c["vec_id"], q["cls"], q["beat"]))
            for t in range(0, len(y), TILE):
                lower = np.zeros((len(asked[t : t + TILE]), len(z)), np.float32)
                for j in range(len(p.points)):
                    np.maximum(lower, np.abs(asked[t : t + TILE, j, None] - near[j]), out=lower)
                bounds = p.most(norms[t : t + TILE], lower)
                for i in range(len(lower)):
                    at, scores = best_of(z, y[t + i], bounds[i], beat[t + i], k)
                    first = np.lexsort((rids[at], ids[at], no_id[at], -scores))[:k]
                    at = at[first]
                    out.append(pd.DataFrame({"cls": [cls[t + i]] * len(at), "score": scores[first].astype(np.int64), "vec_id": vec_id[at], "no_id": no_id[at], "rid": rids[at]}))
        return pd.concat(out) if out else pd.DataFrame({"cls": [], "score": [], "vec_id": [], "no_id": [], "rid": []})

    return search


def _visit(visits: DataFrame, table: DataFrame, rows_in: dict, asks_in: dict, pivots: dict, k: int) -> DataFrame:
    """The k best of each (query class, cell) visit, block by block; a cell's hot side is cut on its own."""
    sizes = [(d, c, -(-n // BLOCK_ROWS), -(-asks_in[d, c] // QUERY_ROWS)) for (d, c), n in rows_in.items() if asks_in.get((d, c))]
    if not sizes:
        return table.sparkSession.createDataFrame([], _FOUND)
    grid = F.broadcast(table.sparkSession.createDataFrame(sizes, "dim int, cell int, blocks int, chunks int"))
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    q = visits.join(grid, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int").alias("chunk"), each("blocks").alias("block"), "cls", "vec", "beat")
    c = table.join(grid, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"), each("chunks").alias("chunk"), "rid", "vec_id", "no_id", "vec", "near")
    key = ["dim", "cell", "block", "chunk"]
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(_search(pivots, k), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("cls").orderBy(F.col("score").desc(), "no_id", "vec_id", "rid")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int, id_name: str = "vec_id", vec_name: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``is_query`` holds and whose id is not null, its k best other rows."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    everything = scratch.table(packed(rows, is_query & F.col(id_name).isNotNull(), id_name, vec_name).withColumn("cls", F.unhex(F.sha2("vec", 256))), "packed")
    members = Window.partitionBy("cls").orderBy("no_id", "vec_id", "rid")
    first = everything.withColumn("place", F.row_number().over(members)).where(F.col("place") <= k + 1)
    pivots = choose_pivots(everything)
    table = scratch.table(pivot_table(first, pivots), "pivots")
    cells = cell_summaries(table)
    rows_in = {at: n for at, (n, _, _) in cells.items()}
    asking = everything.where("asks")
    classes = pivot_table(asking.dropDuplicates(["cls"]), pivots).select(F.unhex(F.sha2("vec", 256)).alias("cls"), "dim", "cell", "vec")
    classes = scratch.table(classes, "classes")
    asks_in = {(r.dim, r.cell): r["count"] for r in classes.groupBy("dim", "cell").count().collect()}
    home = scratch.table(_visit(classes.withColumn("beat", F.lit(float("-inf"))), table, rows_in, asks_in, pivots, k + 1), "home")
    beat = _first(home, k + 1).groupBy("cls").agg(F.when(F.count(F.lit(1)) == k + 1, F.min("score")).cast("double").alias("beat"))

    def away(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                p = pivots[dim]
                y = _matrix(part["vec"], dim).astype(np.float64)
                asked, norms = p.of_queries(y), (y**2).sum(axis=1)
                for cell in sorted(c for d, c in cells if d == dim):
                    _, lo, hi = cells[dim, cell]
                    lower = np.maximum(lo - asked, asked - hi).max(axis=1, initial=0)
                    go = (p.most(norms, lower[:, None])[:, 0] >= part["beat"].to_numpy()) & (part["cell"].to_numpy() != cell)
                    yield part[go].assign(cell=np.int32(cell))

    started = classes.join(beat, "cls", "left").select("cls", "dim", "cell", "vec", F.coalesce("beat", F.lit(float("-inf"))).alias("beat"))
    visits = scratch.table(started.mapInPandas(away, started.schema), "visits")
    asks_in = {(r.dim, r.cell): r["count"] for r in visits.groupBy("dim", "cell").count().collect()}
    found = home.unionByName(_visit(visits, table, rows_in, asks_in, pivots, k + 1))
    answers = _first(found, k + 1).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("place", "rid", "vec_id", "no_id", "score"))).alias("best"))  # k + 1 at most
    own = asking.select("cls", F.col("vec_id").alias("query_id"), F.col("rid").alias("own"))
    best = own.join(answers, "cls").select("query_id", F.posexplode(F.slice(F.filter("best", lambda r: r["rid"] != F.col("own")), 1, k)).alias("at", "r"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), F.when(~F.col("r.no_id"), F.col("r.vec_id")).alias("vec_id"), F.col("r.score").alias("score"))


def op12_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as z
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(range(1, len(q.z) + 1), lambda i: q.z[i] * c.z[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.z) = len(c.z) and q.vec_id % 20 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
