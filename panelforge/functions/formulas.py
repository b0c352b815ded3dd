"""Formula text: validation, complexity, canonical form and structural similarity."""

from __future__ import annotations

import ast
import re
from collections import Counter
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.registry import OPERATORS
from panelforge.functions.tables import once_each
from panelforge.plans.compiler import RAW_COLUMNS

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
MAX_DEPTH = 5
UNIVERSES = {"sp500"}
INLINE = set("shift rolling diff pct_change mean std clip abs sum min max float nan np".split())
DUPLICATE = 0.95
#: Digits to which similarities are compared, so that the order of a sum breaks no tie.
DIGITS = 9
#: Keys that a configuration must have (fixed values).
REQUIRED = ["alpha_id", "formula", "universe", "start_date", "end_date"]


def tokens(formula: str) -> set[str]:
    return set(re.findall(TOKEN, formula))


def columns(formula: str) -> set[str]:
    return tokens(formula) & set(RAW_COLUMNS)


def _body(formula: str) -> ast.AST | None:
    try:
        return ast.parse(formula, mode="eval").body
    except (SyntaxError, ValueError):
        return None


def complexity(formula: str) -> int:
    """Calls, plus nesting depth of calls and operators, plus distinct data columns; half the tokens if unparseable."""
    tree = _body(formula)
    if tree is None:
        return len(re.findall(TOKEN, formula)) // 2

    def depth(n: ast.AST) -> int:
        return isinstance(n, (ast.Call, ast.BinOp, ast.UnaryOp, ast.Compare)) + max(map(depth, ast.iter_child_nodes(n)), default=0)

    return sum(isinstance(n, ast.Call) for n in ast.walk(tree)) + depth(tree) + len(columns(formula))


def unsigned(tree: ast.AST) -> ast.AST:
    """The tree below any outer change of sign: -f, -1 * f, f * -1."""
    minus = (ast.dump(ast.parse("-1", mode="eval").body), ast.dump(ast.Constant(-1)))
    while True:
        if isinstance(tree, ast.UnaryOp) and isinstance(tree.op, ast.USub):
            tree = tree.operand
        elif isinstance(tree, ast.BinOp) and isinstance(tree.op, ast.Mult) and ast.dump(tree.left) in minus:
            tree = tree.right
        elif isinstance(tree, ast.BinOp) and isinstance(tree.op, ast.Mult) and ast.dump(tree.right) in minus:
            tree = tree.left
        else:
            return tree


def canonical(formula: str) -> str | None:
    tree = _body(formula)
    return None if tree is None else ast.dump(unsigned(tree))


def shape(formula: str) -> dict[str, int] | None:
    """How often each labelled node and each (parent, place, child) edge occurs; operands of + and * have one place."""
    tree = _body(formula)
    if tree is None:
        return None
    out: Counter[str] = Counter()

    def name(n: ast.AST) -> str:
        match n:
            case ast.Name():
                return "n:" + n.id
            case ast.Constant():
                return f"c:{n.value!r}"
            case ast.Call(func=ast.Name(id=f)):
                return "f:" + f
            case ast.Call(func=ast.Attribute(attr=f)):
                return "m:" + f
            case ast.Attribute():
                return "a:" + n.attr
            case ast.BinOp() | ast.UnaryOp():
                return "o:" + type(n).__name__ + type(n.op).__name__
        return "t:" + type(n).__name__

    stack = [unsigned(tree)]
    while stack:
        n = stack.pop()
        out[name(n)] += 1
        free = isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Mult))
        for place, value in ast.iter_fields(n):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    out[f"{name(n)}>{'*' if free and place in ('left', 'right') else place}>{name(child)}"] += 1
                    stack.append(child)
    return dict(out)


def weighted_jaccard(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def set_jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def structural(a: str, b: str) -> float:
    """Overlap of two formulas' shapes, blind to an outer sign; of their tokens if one cannot be parsed."""
    x, y = shape(a), shape(b)
    return set_jaccard(tokens(a), tokens(b)) if x is None or y is None else weighted_jaccard(x, y)


def array_jaccard(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def map_jaccard(a: Column, b: Column) -> Column:
    """Weighted overlap of two count maps; null where one of them is."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    both = F.aggregate(keys, F.lit(0), lambda s, k: s + F.least(at(a, k), at(b, k)))
    either = F.aggregate(keys, F.lit(0), lambda s, k: s + F.greatest(at(a, k), at(b, k)))
    return F.try_divide(both.cast("double"), either.cast("double"))


def described(df: DataFrame, formula: str = "formula") -> DataFrame:
    """df with canonical, shape (map), cols and complexity of each formula; equal formulas are parsed once."""
    x = once_each(df, [formula], lambda values: _described(values, formula))
    return x.select(*df.columns, "_of.canonical", "_of.shape", "_of.cols", "_of.complexity")


def _described(df: DataFrame, formula: str) -> DataFrame:

    @F.pandas_udf("canonical string, shape map<string,int>, cols array<string>, complexity int")
    def describe(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"canonical": [canonical(f or "") for f in s], "shape": [shape(f or "") for f in s], "cols": [sorted(columns(f or "")) for f in s], "complexity": [complexity(f or "") for f in s]})

    return df.withColumn("_d", describe(formula)).select(*df.columns, "_d.canonical", "_d.shape", "_d.cols", "_d.complexity")


def search(store: DataFrame, formula: str, features: list[str] | None = None) -> DataFrame:
    """The store's formulas with structural, column, feature and combined similarity to one formula; equal formulas are compared once."""
    x = once_each(store, ["formula"], lambda values: _compared(_described(values, "formula"), formula))
    d = x.select(*store.columns, *[f"_of.{c}" for c in ("canonical", "shape", "cols", "complexity", "structural", "column_similarity", "exact")])
    feats = F.array(*[F.lit(t) for t in features or []]).cast("array<string>")
    has = (F.size(feats) > 0) & (F.size("features") > 0)
    d = d.withColumn("feature_similarity", F.when(has, array_jaccard(F.col("features"), feats)).otherwise(0.0))
    combined = F.when(has, 0.4 * F.col("feature_similarity") + 0.4 * F.col("structural") + 0.2 * F.col("column_similarity")).otherwise((0.4 * F.col("structural") + 0.2 * F.col("column_similarity")) / 0.6)
    return d.withColumn("combined", combined)


def _compared(d: DataFrame, formula: str) -> DataFrame:
    """Described formulas with structural, column_similarity and exact to one formula."""
    mine, own = shape(formula), canonical(formula)
    if mine:
        mine_map = F.create_map(*[F.lit(x) for kv in mine.items() for x in kv])
        struct = F.when(F.col("canonical") == F.lit(own), F.lit(1.0)).otherwise(map_jaccard(F.col("shape"), mine_map))
    else:
        struct = F.lit(None).cast("double")
    theirs_tokens = F.array_distinct(F.regexp_extract_all("formula", F.lit(f"({TOKEN})"), F.lit(1)))
    struct = F.coalesce(struct, array_jaccard(theirs_tokens, F.array(*[F.lit(t) for t in sorted(tokens(formula))]).cast("array<string>")))
    cols = array_jaccard(F.col("cols"), F.array(*[F.lit(t) for t in sorted(columns(formula))]).cast("array<string>"))
    return d.withColumns({"structural": struct, "column_similarity": cols, "exact": F.coalesce(F.col("canonical") == F.lit(own), F.lit(False))})


def most_similar(found: DataFrame, order: str = "timestamp", threshold: float = DUPLICATE) -> DataFrame:
    """One row: the most similar experiment (the earliest on ties, then the smallest id), and whether the formula is a duplicate."""
    found = found.withColumn("combined", F.round("combined", DIGITS))
    top = found.agg(F.max("structural").alias("s"), F.max("combined").alias("c"), F.max("exact").alias("any_exact"))
    earliest = F.struct(order, "alpha_id")
    first = found.join(F.broadcast(top)).agg(F.min_by("alpha_id", F.when(F.col("structural") == F.col("s"), earliest)).alias("sid"), F.min_by("alpha_id", F.when(F.col("combined") == F.col("c"), earliest)).alias("cid"), F.first("s").alias("structural_similarity"), F.first("c").alias("similarity_score"), F.first("any_exact").alias("is_exact_duplicate"))
    unique = ~(F.col("is_exact_duplicate") | (F.col("structural_similarity") >= threshold))
    percent = lambda c: F.format_string("%d%%", F.round(100 * F.col(c)).cast("int"))
    reason = (
        F.when(F.col("sid").isNull() & F.col("cid").isNull(), "nothing to compare with")
        .when(F.col("is_exact_duplicate"), F.concat(F.lit("the same as "), F.col("sid").cast("string"), F.lit(" up to its sign")))
        .when(~unique, F.concat(percent("structural_similarity"), F.lit(" structural similarity to "), F.col("sid").cast("string"), F.lit(f", at or over {threshold:.0%}")))
        .otherwise(F.concat(F.lit("closest is "), F.col("cid").cast("string"), F.lit(" at "), percent("similarity_score"), F.lit(", structural at most "), percent("structural_similarity")))
    )
    first = first.withColumns({"is_exact_duplicate": F.coalesce("is_exact_duplicate", F.lit(False)), "similarity_score": F.coalesce("similarity_score", F.lit(0.0)), "structural_similarity": F.coalesce("structural_similarity", F.lit(0.0))})
    return first.select(
        unique.alias("is_unique"),
        "is_exact_duplicate",
        F.when(unique, F.col("cid")).otherwise(F.col("sid")).alias("most_similar_id"),
        F.round("similarity_score", 4).alias("similarity_score"),
        F.round("structural_similarity", 4).alias("structural_similarity"),
        reason.alias("reason"),
    )


def validate(config: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) of an alpha's configuration. Missing keys end the check."""
    missing = [k for k in REQUIRED if config.get(k) is None]
    if missing:
        return [f"missing key: {k}" for k in missing], []
    errors, warnings = formula_errors(config["formula"]), []
    unused = set(config.get("features") or []) & set(RAW_COLUMNS) - columns(config["formula"])
    if unused:
        warnings.append(f"declared but not in the formula: {sorted(unused)}")
    if config["universe"] not in UNIVERSES:
        errors.append(f"universe {config['universe']!r} is not supported")
    try:
        start, end = (datetime.strptime(config[k], "%Y-%m-%d") for k in ("start_date", "end_date"))
        if start >= end:
            errors.append("start_date must come before end_date")
    except ValueError as e:
        errors.append(f"dates must be YYYY-MM-DD: {e}")
    return errors, warnings


def formula_errors(formula: str) -> list[str]:
    if not formula.strip():
        return ["the formula is empty"]
    depth = deepest = 0
    for c in formula:
        depth += (c == "(") - (c == ")")
        deepest = max(deepest, depth)
        if depth < 0:
            return ["a parenthesis closes before it opens"]
    errors = ["a parenthesis stays open"] * bool(depth) + [f"nesting depth {deepest} is over {MAX_DEPTH}"] * (deepest > MAX_DEPTH)
    if errors:
        return errors
    if not columns(formula):
        errors.append("no known data column is used")
    known = set(RAW_COLUMNS) | set(OPERATORS) | INLINE
    for t in sorted(tokens(formula) - known):
        if t.isupper() and "_" in t:
            errors.append(f"{t} is not a data column")
        elif (t.islower() or "_" in t) and not t[0].isupper() and len(t) > 2:
            near = sorted(o for o in OPERATORS if o.startswith(t[:4]))
            errors.append(f"{t} is not an operator" + (f"; near: {', '.join(near)}" if near else ""))
    return errors


def checked(configs: DataFrame) -> DataFrame:
    """A table of configurations (alpha_id, formula, features, universe, start_date, end_date) with errors and warnings as kinds.

    The same verdicts as ``validate``, as Columns. Kinds: missing:<key>, empty, closes_early, stays_open, too_deep, no_column,
    column:<name>, operator:<name>, universe, date_format, date_order; unused:<name> warns.
    """
    names = [f.name for f in configs.schema.fields]
    formula = F.col("formula")
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    when = lambda cond, kind: F.when(cond, F.array(F.lit(kind))).otherwise(array([]))
    missing = F.concat(*[when(F.col(k).isNull() if k in names else F.lit(True), f"missing:{k}") for k in REQUIRED])
    # running depth: (now, lowest, highest)
    step = lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    walk = lambda d, c: F.struct((d["now"] + step(c)).alias("now"), F.least(d["low"], d["now"] + step(c)).alias("low"), F.greatest(d["high"], d["now"] + step(c)).alias("high"))
    depth = F.aggregate(F.regexp_extract_all(formula, F.lit("([()])"), F.lit(1)), zero, walk)
    parens = F.when(depth["low"] < 0, array(["closes_early"])).otherwise(F.concat(when(depth["now"] > 0, "stays_open"), when(depth["high"] > MAX_DEPTH, "too_deep")))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit(f"({TOKEN})"), F.lit(1))))
    strange = F.array_except(words, array(sorted(set(RAW_COLUMNS) | set(OPERATORS) | INLINE)))
    upper = lambda t: t.rlike("[A-Z]") & ~t.rlike("[a-z]") & t.contains("_")
    lower = lambda t: ((t.rlike("[a-z]") & ~t.rlike("[A-Z]")) | t.contains("_")) & ~t.rlike("^[A-Z]") & (F.length(t) > 2)
    odd = F.transform(F.filter(strange, lambda t: upper(t) | lower(t)), lambda t: F.concat(F.when(upper(t), "column:").otherwise("operator:"), t))
    text = F.when(F.trim(formula) == "", array(["empty"])).when(F.size(parens) > 0, parens).otherwise(F.concat(when(F.size(F.array_intersect(words, array(RAW_COLUMNS))) == 0, "no_column"), odd))
    start, end = (F.when(F.col(k).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(F.col(k), "yyyy-M-d")) for k in ("start_date", "end_date"))
    dates = F.when(start.isNull() | end.isNull(), array(["date_format"])).otherwise(when(start >= end, "date_order"))
    rest = F.concat(text, when(~F.col("universe").isin(*UNIVERSES), "universe"), dates)
    declared = F.array_except(F.array_intersect(F.coalesce("features", array([])), array(RAW_COLUMNS)), words)
    out = configs.withColumn("errors", F.when(F.size(missing) > 0, missing).otherwise(rest))
    unused = F.when(F.size(missing) > 0, array([])).otherwise(F.transform(F.array_sort(declared), lambda t: F.concat(F.lit("unused:"), t)))
    return out.withColumn("warnings", unused).withColumn("valid", F.size("errors") == 0)
