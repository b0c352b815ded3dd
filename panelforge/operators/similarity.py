"""Many formulas against a store at once: the most similar record of each, by an inverted index instead of a scan.

Structural similarity is the weighted Jaccard of two formulas' counted nodes and edges (of their tokens where one cannot be
parsed), combined similarity a weighted mean of it with the Jaccard of declared features and of columns. For each candidate
the best record by either is wanted, the earliest on ties, exactly as a full comparison gives it.

1. Every record's elements go into an index: (kind, element, occurrence), so that a count of three is three elements.
2. Seeds: records that share a candidate's rarest elements, a few for each, and those with its canonical form. Their exact
   scores are bounds to beat.
3. A record whose overlap with a candidate of n elements reaches the share t meets it in one of its n - ceil(t n) + 1 rarest
   elements. A mean reaches u only if one of its parts does. So the prefixes for t and u, part by part, find every record
   that can win. Features, columns and the number of hits bound what a pair can reach, and most pairs end there.
4. What is left is verified on whole shapes.

Candidates that share nothing with the store fall to its earliest record, with a similarity of 0, as in a full comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import formulas as fm
from panelforge.functions.tables import kept, shared_folder, small

SEED_ELEMENTS, SEED_RECORDS = 3, 4
_EMPTY = "array<string>"


def prepared(df: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """key, canonical, shape, cols, tokens and features of each formula."""
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce("formula", F.lit("")), F.lit(f"({fm.TOKEN})"), F.lit(1)))
    features = F.array_distinct(F.coalesce("features", F.array().cast(_EMPTY)))
    return fm.described(df).select(F.col(key), *(extra or []), "canonical", "shape", "cols", tokens.alias("tokens"), features.alias("features"))


def _normal(df: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """key, formula and features, which are a set."""
    return df.select(key, *(extra or []), "formula", F.array_sort(F.array_distinct(F.coalesce("features", F.array().cast(_EMPTY)))).alias("features"))


def elements(d: DataFrame, key: str, store: bool) -> DataFrame:
    """key, kind, element and size (of the kind) of each formula.

    Kinds: shape (nodes and edges, by occurrence), feature, column; token is how a candidate that cannot be parsed meets any
    record, broken how one that can be parsed meets the records that cannot.
    """
    occurrences = F.flatten(F.transform(F.map_entries("shape"), lambda e: F.transform(F.sequence(F.lit(1), e["value"]), lambda i: F.concat_ws("#", i.cast("string"), e["key"]))))
    parsed = F.col("shape").isNotNull()
    none = F.array().cast(_EMPTY)
    lists = {"shape": F.when(parsed, occurrences).otherwise(none), "feature": F.col("features"), "column": F.col("cols")}
    lists |= {"token": F.col("tokens"), "broken": F.when(~parsed, F.col("tokens")).otherwise(none)} if store else {"token": F.when(~parsed, F.col("tokens")).otherwise(none), "broken": F.when(parsed, F.col("tokens")).otherwise(none)}
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("of")) for k, v in lists.items()])).alias("l")
    return d.select(key, long).select(key, "l.kind", F.size("l.of").alias("size"), F.explode("l.of").alias("element"))


def scored(pairs: DataFrame) -> DataFrame:
    """Exact similarities of (c_*, r_*) pairs."""
    exact = F.coalesce(F.col("c_canonical") == F.col("r_canonical"), F.lit(False))
    parsed = F.col("c_shape").isNotNull() & F.col("r_shape").isNotNull()
    tokens = fm.array_jaccard(F.col("r_tokens"), F.col("c_tokens"))
    structural = F.when(exact, F.lit(1.0)).when(parsed, fm.map_jaccard(F.col("r_shape"), F.col("c_shape"))).otherwise(tokens)
    return pairs.withColumn("exact", exact).withColumn("structural", structural).withColumn("combined", combined(F.col("structural")))


def _verified(pairs: DataFrame, cand: DataFrame, rec: DataFrame, key: str, record_key: str, order: str) -> DataFrame:
    """Scores of distinct (candidate, record) pairs."""
    c = cand.select(F.col(key).alias("c_id"), *[F.col(x).alias(f"c_{x}") for x in ("canonical", "shape", "cols", "tokens", "features")])
    r = rec.select(F.col(record_key).alias("r_id"), F.col(order).alias("r_order"), *[F.col(x).alias(f"r_{x}") for x in ("canonical", "shape", "cols", "tokens", "features")])
    return scored(pairs.distinct().join(c, "c_id").join(r, "r_id")).select("c_id", "r_id", "r_order", "exact", "structural", "combined")


def _reach(share: Column, size: Column) -> Column:
    """How many of the rarest elements must be looked up so that no overlap of this share is missed."""
    return F.when(share <= 0, size).otherwise(size - F.ceil(share * size - 1e-6) + 1)


def _size(shape: str) -> Column:
    return F.coalesce(F.aggregate(F.map_values(shape), F.lit(0), lambda a, b: a + b), F.lit(0))


def _possible(met: DataFrame, cand: DataFrame, rec: DataFrame, bound: DataFrame, key: str, record_key: str) -> DataFrame:
    """The pairs that may still win, from features, columns and sizes alone: of n elements of which the p rarest were looked
    up with some hits, no more than hits + n - p can be shared."""
    c = cand.select(F.col(key).alias("c_id"), F.col("cols").alias("c_cols"), F.col("features").alias("c_features"), _size("shape").alias("c_size")).join(bound, "c_id", "left")
    c = c.withColumns({"t": F.coalesce("t", F.lit(0.0)), "u": F.coalesce("u", F.lit(0.0))})
    r = rec.select(F.col(record_key).alias("r_id"), F.col("cols").alias("r_cols"), F.col("features").alias("r_features"), _size("shape").alias("r_size"))
    x = met.join(c, "c_id").join(r, "r_id")
    left = F.col("c_size") - F.least(_reach(F.least("t", "u"), F.col("c_size")), F.col("c_size"))
    shared = F.least(F.col("hits") + left, "c_size", "r_size")
    parsed = (F.col("c_size") > 0) & (F.col("r_size") > 0)
    x = x.withColumn("most", F.when(parsed, shared / (F.col("c_size") + F.col("r_size") - shared)).otherwise(F.lit(1.0)))
    return x.where((F.col("most") + 1e-6 >= F.col("t")) | (combined(F.col("most")) + 1e-6 >= F.col("u"))).select("c_id", "r_id")


def combined(structural: Column) -> Column:
    """The weighted mean of a pair's structural, feature and column similarity; without features on both sides, of the other two."""
    has = (F.size("c_features") > 0) & (F.size("r_features") > 0)
    feature, column = fm.array_jaccard(F.col("r_features"), F.col("c_features")), fm.array_jaccard(F.col("r_cols"), F.col("c_cols"))
    return F.when(has, 0.4 * feature + 0.4 * structural + 0.2 * column).otherwise((0.4 * structural + 0.2 * column) / 0.6)


def closest(candidates: DataFrame, store: DataFrame, key: str = "candidate_id", record_key: str = "alpha_id", order: str = "timestamp", threshold: float = fm.DUPLICATE) -> tuple[DataFrame, DataFrame]:
    """The verdict of each candidate, and the pairs that were compared.

    Verdict: key, is_unique, is_exact_duplicate, most_similar_id, similarity_score, structural_similarity. Candidates have formula and
    features; the store has them too, and an order, whose ties go to the smaller key. Keys name one row each.

    Rows of equal formula and features form a class. Classes are compared, a class of the store by its earliest record, and
    every candidate gets the verdict of its class; so the pairs are those of classes' first members.
    """
    at = shared_folder(store.sparkSession, "similarity")
    members = kept(_normal(candidates, key), f"{at}/members")
    classes = kept(members.groupBy("formula", "features").agg(F.min(key).alias("class_id")), f"{at}/classes")
    cand = kept(prepared(classes.withColumnRenamed("class_id", key), key), f"{at}/candidates")
    firsts = _normal(store, record_key, [order]).groupBy("formula", "features").agg(F.min(F.struct(F.col(order).alias("o"), F.col(record_key).alias("k"))).alias("first"))
    firsts = firsts.select("formula", "features", F.col("first.o").alias(order), F.col("first.k").alias(record_key))
    rec = kept(prepared(firsts, record_key, [order]), f"{at}/records")
    index = kept(elements(rec, record_key, True).withColumnRenamed(record_key, "r_id").withColumnRenamed("size", "r_size"), f"{at}/index")
    often = index.groupBy("kind", "element").agg(F.count(F.lit(1)).alias("df"))
    asked = elements(cand, key, False).withColumnRenamed(key, "c_id").join(often, ["kind", "element"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by_rarity = Window.partitionBy("c_id", "kind").orderBy("df", "element")  # the elements of one formula
    asked = kept(asked.withColumn("at", F.row_number().over(by_rarity)), f"{at}/asked")

    found_at = Window.partitionBy("c_id", "kind").orderBy("df", "element")
    seeds = asked.where("df > 0").withColumn("nth", F.row_number().over(found_at)).where(F.col("nth") <= SEED_ELEMENTS)
    some = Window.partitionBy("kind", "element").orderBy("r_id")
    heads = index.join(small(seeds.select("kind", "element").distinct()), ["kind", "element"], "left_semi").withColumn("n", F.row_number().over(some)).where(F.col("n") <= SEED_RECORDS)
    first = seeds.select("c_id", "kind", "element").join(heads, ["kind", "element"]).select("c_id", "r_id")
    same = cand.select(F.col(key).alias("c_id"), "canonical").where("canonical is not null").join(rec.select(F.col(record_key).alias("r_id"), F.col(order).alias("o"), "canonical").groupBy("canonical").agg(F.min_by("r_id", F.struct("o", "r_id")).alias("r_id")), "canonical").select("c_id", "r_id")
    seeded = kept(_verified(first.unionByName(same), cand, rec, key, record_key, order), f"{at}/seeded")
    bound = seeded.groupBy("c_id").agg(F.max("structural").alias("t"), F.max("combined").alias("u"))

    wide = asked.join(bound, "c_id", "left").withColumns({"t": F.coalesce("t", F.lit(0.0)), "u": F.coalesce("u", F.lit(0.0))})
    need = F.when(F.col("kind").isin("feature", "column"), F.col("u")).otherwise(F.least("t", "u"))
    wide = wide.withColumn("need", need).where((F.col("df") > 0) & (F.col("at") <= _reach(F.col("need"), F.col("size"))))
    met = wide.select("c_id", "kind", "element", "size", "need").join(index, ["kind", "element"])
    met = met.where(F.least("size", "r_size") + 1e-6 >= F.col("need") * F.greatest("size", "r_size"))
    met = met.groupBy("c_id", "r_id").agg(F.count_if(F.col("kind") == "shape").alias("hits")).join(seeded.select("c_id", "r_id"), ["c_id", "r_id"], "left_anti")
    rest = _possible(met, cand, rec, bound, key, record_key)
    compared = kept(seeded.unionByName(_verified(rest, cand, rec, key, record_key, order)), f"{at}/compared")

    compared = compared.withColumn("combined", F.round("combined", fm.DIGITS))
    earliest_of = lambda c, best: F.min_by("r_id", F.when(F.col(c) == F.col(best), F.struct("r_order", "r_id")))
    top = compared.groupBy("c_id").agg(F.max("structural").alias("s"), F.max("combined").alias("c"), F.max("exact").alias("any_exact"))
    best = compared.join(top, "c_id").groupBy("c_id").agg(
        F.first("s").alias("s"), F.first("c").alias("c"), F.first("any_exact").alias("any_exact"),
        earliest_of("structural", "s").alias("sid"), earliest_of("combined", "c").alias("cid"),
    )
    earliest = rec.agg(F.min_by(record_key, F.struct(order, record_key)).alias("earliest"))  # one row
    out = cand.select(F.col(key)).join(best, F.col(key) == F.col("c_id"), "left").crossJoin(F.broadcast(earliest))
    out = out.withColumns({"s": F.coalesce("s", F.lit(0.0)), "c": F.coalesce("c", F.lit(0.0)), "any_exact": F.coalesce("any_exact", F.lit(False))})
    out = out.withColumns({"sid": F.when(F.col("s") > 0, F.col("sid")).otherwise(F.col("earliest")), "cid": F.when(F.col("c") > 0, F.col("cid")).otherwise(F.col("earliest"))})
    unique = ~(F.col("any_exact") | (F.col("s") >= threshold))
    verdict = out.select(key, unique.alias("is_unique"), F.col("any_exact").alias("is_exact_duplicate"), F.when(unique, F.col("cid")).otherwise(F.col("sid")).alias("most_similar_id"), F.round("c", 4).alias("similarity_score"), F.round("s", 4).alias("structural_similarity"))
    same = F.col("m.formula").eqNullSafe(F.col("k.formula")) & (F.col("m.features") == F.col("k.features"))
    belongs = members.alias("m").join(small(classes).alias("k"), same).select(F.col(f"m.{key}").alias(key), "class_id")
    verdict = belongs.join(small(verdict.withColumnRenamed(key, "class_id")), "class_id").drop("class_id")
    return verdict, compared
