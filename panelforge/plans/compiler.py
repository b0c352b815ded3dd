"""Formula text to a staged DataFrame plan. Formulas are parsed with ``ast`` against a whitelist; nothing is evaluated.

Equal subtrees become one column. Every node that needs a window is put in stage 1 + max(stage of its operands); nodes of
one stage that share a key are one projection, so they share an exchange.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import nullsafe as ns
from panelforge.functions.registry import DATE, OPERATORS, TICKER, shift, ts_mean
from panelforge.functions import registry as ops
from panelforge.plans import blocks

#: Formula columns that are legal (fixed values of the language): price, income statement, cash flow.
RAW_COLUMNS = (
    "ADJUSTED_PRICE ADJUSTED_VOLUME "
    "REVENUE_LTM COGS_LTM GROSS_PROFIT_LTM OPERATING_EXPENSES_LTM SGA_EXPENSE_LTM OPERATING_INCOME_LTM NON_OPERATING_INCOME_LTM NET_INTEREST_EXPENSE_LTM PRETAX_INCOME_ADJ_LTM "
    "PRETAX_INCOME_LTM INCOME_TAX_LTM CONTINUING_INCOME_LTM NET_INCOME_LTM NET_INCOME_COMMON_LTM EPS_DILUTED SHARES_BASIC SHARES_DILUTED "
    "NET_INCOME_START_LTM DA_LTM NON_CASH_ITEMS_LTM WORKING_CAPITAL_CHANGE_LTM CFO_LTM FIXED_ASSET_CHANGE_LTM CFI_LTM DEBT_FINANCING_CF_LTM EQUITY_FINANCING_CF_LTM CFF_LTM NET_CHANGE_CASH_LTM"
).split()
GROUPS = {"SECTOR"}
UNCLIPPED = {"log": lambda x: ns.clean(F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-ns.INF))), "exp": F.exp, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "abs": F.abs, "sign": F.signum, "tanh": F.tanh}


class FormulaError(ValueError):
    pass


class Compiler:
    def __init__(self, df: DataFrame, allow_lookahead: bool = False):
        self.df = df
        self.names = {c.upper(): c for c in df.columns}
        self.allow_lookahead = allow_lookahead
        self.memo: dict[str, tuple] = {}
        self.windows = 0
        self.stages: list[dict[str, list]] = []

    def add(self, formula: str, name: str) -> None:
        value, stage = self.node(_parse(formula).body)
        if not isinstance(value, Column):
            raise FormulaError("the formula is a constant, not a panel")
        self.stage(stage)["out"].append((name, value))

    def stage(self, k: int) -> dict[str, list]:
        while len(self.stages) <= k:
            self.stages.append({"ticker": [], "date": [], "fold": [], "out": []})
        return self.stages[k]

    def result(self) -> DataFrame:
        df = self.df
        for s in self.stages:
            if s["fold"]:
                df = fold(df, s["fold"])
            for key in ("ticker", "date"):
                if s[key]:
                    df = df.select("*", *[v.alias(n) for n, v in s[key]])
            if s["out"]:
                df = df.select("*", *[v.cast("double").alias(n) for n, v in s["out"]])
        return df

    def node(self, n: ast.AST) -> tuple:
        """(Column or constant, stage from which it can be read)."""
        key = ast.dump(n)
        if key not in self.memo:
            self.memo[key] = self.build(n)
        return self.memo[key]

    def windowed(self, keyed: str, value, after: int, extra=None) -> tuple:
        self.windows += 1
        name = f"_w{self.windows}_{after}"
        self.stage(after)[keyed].append((name, value) if extra is None else (name, value, extra))
        return F.col(name), after + 1

    def row_number(self) -> tuple:
        """A ticker's rows from 0 on, in the order of their dates."""
        if "row number" not in self.memo:
            self.memo["row number"] = self.windowed("ticker", F.row_number().over(ops.wt()) - 1, 0)
        return self.memo["row number"]

    def build(self, n: ast.AST) -> tuple:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return n.value, 0
        if isinstance(n, ast.Name):
            if n.id == "nan":
                return F.lit(None).cast("double"), 0
            if n.id in GROUPS:
                return F.col(self.names[n.id]), 0
            if n.id.upper() == n.id and n.id in self.names:
                return ns.clean(F.col(self.names[n.id]).cast("double")), 0
            raise FormulaError(f"unknown column {n.id}")
        if isinstance(n, ast.UnaryOp):
            x, s = self.node(n.operand)
            if isinstance(n.op, ast.USub):
                return -x, s
            if isinstance(n.op, ast.Invert):
                return ~self.truth(x), s
            if isinstance(n.op, ast.UAdd):
                return x, s
        if isinstance(n, ast.BinOp):
            (a, s), (b, t) = self.node(n.left), self.node(n.right)
            return self.binary(n.op, a, b), max(s, t)
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            (a, s), (b, t) = self.node(n.left), self.node(n.comparators[0])
            return self.compare(n.ops[0], ns.col(a), ns.col(b)), max(s, t)
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "np" and n.attr == "nan":
            return F.lit(None).cast("double"), 0
        if isinstance(n, ast.Call):
            if n.keywords:
                raise FormulaError("keyword arguments are not part of the language")
            if isinstance(n.func, ast.Name) and n.func.id in OPERATORS:
                return self.call(n.func.id, n.args)
            if isinstance(n.func, ast.Attribute):
                return self.method(n)
        raise FormulaError(f"not part of the language: {ast.unparse(n)}")

    @staticmethod
    def truth(x) -> Column:
        """A condition: a comparison, or a number, of which missing counts as true."""
        if not isinstance(x, Column):
            return F.lit(bool(x))
        return F.coalesce(x.cast("double") != 0, F.lit(True))

    def binary(self, op, a, b):
        if isinstance(op, (ast.BitAnd, ast.BitOr)):
            a, b = self.truth(a), self.truth(b)
            return a & b if isinstance(op, ast.BitAnd) else a | b
        plain = not isinstance(a, Column) and not isinstance(b, Column)
        if isinstance(op, ast.Add):
            return a + b
        if isinstance(op, ast.Sub):
            return a - b
        if isinstance(op, ast.Mult):
            return a * b if plain else ns.clean(ns.col(a) * ns.col(b))
        if isinstance(op, ast.Div):
            return a / b if plain else ns.divide(ns.col(a), ns.col(b))
        if isinstance(op, ast.Pow):
            return a**b if plain else ns.clean(F.pow(ns.col(a), ns.col(b)))
        raise FormulaError(f"operator {type(op).__name__} is not part of the language")

    @staticmethod
    def compare(op, a, b) -> Column:
        if isinstance(op, ast.NotEq):
            return F.coalesce(a != b, F.lit(True))
        out = {ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Eq: lambda: a == b}.get(type(op))
        if out is None:
            raise FormulaError("comparison is not part of the language")
        return F.coalesce(out(), F.lit(False))

    def call(self, name: str, args: list[ast.AST]) -> tuple:
        op = OPERATORS[name]
        if len(args) != op.arity:
            raise FormulaError(f"{name} takes {op.arity} arguments")
        built = [self.node(a) for a in args]
        values, after = [v for v, _ in built], max((s for _, s in built), default=0)
        if name == "where":
            values[0] = self.truth(values[0])
        if op.keyed == "scalar":
            if not any(isinstance(v, Column) for v in values):
                raise FormulaError(f"{name} needs a panel")
            return op.fn(*[ns.col(v) if k == 0 else v for k, v in enumerate(values)]), after
        if op.keyed == "fold":
            return self.windowed("fold", values[0], after, (op.fn, int(values[1])))
        if op.keyed == "ticker" and not isinstance(values[-1], int):
            raise FormulaError(f"{name} takes a whole number of days")
        if op.keyed == "ticker" and values[-1] >= blocks.LEAST and any(isinstance(v, Column) for v in values):
            if name == "ts_rank":
                return self.windowed("fold", values[0], after, (blocks.fold_rank, values[-1]))
            if name in blocks.NAMES:
                return blocks.build(self, name, values[:-1], values[-1], after)
        if name == "ts_shift":
            return self.windowed("ticker", shift(values[0], values[1], self.allow_lookahead), after)
        return self.windowed(op.keyed, op.fn(*values), after)

    def method(self, n: ast.Call) -> tuple:
        """X.shift(n), X.diff(n), X.pct_change([n]), X.rolling(n).f(), X.clip(a, b), X.abs(), np.f(X)."""
        f = n.func
        if isinstance(f.value, ast.Name) and f.value.id == "np":
            if f.attr not in UNCLIPPED or len(n.args) != 1:
                raise FormulaError(f"np.{f.attr} is not part of the language")
            x, s = self.node(n.args[0])
            return UNCLIPPED[f.attr](ns.col(x)), s
        if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Attribute) and f.value.func.attr == "rolling":
            inner = {"mean": "ts_mean", "std": "ts_std", "sum": "ts_sum", "min": "ts_min", "max": "ts_max", "rank": "ts_rank"}.get(f.attr)
            if inner is None or n.args:
                raise FormulaError(f"rolling(...).{f.attr} is not part of the language")
            return self.call(inner, [f.value.func.value, *f.value.args])
        x, s = self.node(f.value)
        args = [self.node(a)[0] for a in n.args]
        if f.attr in ("shift", "diff", "pct_change"):
            k = args[0] if args else 1
            if not isinstance(k, int):
                raise FormulaError("a whole number of days is needed")
            before = shift(x, k, self.allow_lookahead)
            value = {"shift": before, "diff": x - before, "pct_change": ns.divide(x, before) - 1}[f.attr]
            return self.windowed("ticker", value, s)
        if f.attr == "clip" and len(args) == 2:
            return OPERATORS["clip"].fn(x, *args), s
        if f.attr == "abs" and not args:
            return F.abs(x), s
        if f.attr in ("mean", "std", "sum", "min", "max"):
            raise FormulaError(f".{f.attr}() over the whole history looks ahead")
        raise FormulaError(f".{f.attr} is not part of the language")


def _parse(formula: str) -> ast.Expression:
    try:
        return ast.parse(formula.strip(), mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {e.msg}") from e


def fold(df: DataFrame, jobs: list[tuple]) -> DataFrame:
    """Columns that need a pass over each ticker's history, all of one stage in one grouped map."""
    df = df.select("*", *[v.alias(f"{n}_in") for n, v, _ in jobs])
    keep = [c for c in df.columns if not c.endswith("_in")]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField(n, T.DoubleType()) for n, _, _ in jobs])
    plan = [(n, fn, k) for n, _, (fn, k) in jobs]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE, kind="stable")
        for name, fn, k in plan:
            pdf[name] = fn(pdf[f"{name}_in"].astype(float), k)
        return pdf[[f.name for f in schema.fields]]

    return df.groupBy(TICKER).applyInPandas(run, schema)


def evaluate(panel: DataFrame, formulas: dict[str, str], allow_lookahead: bool = False) -> DataFrame:
    """The panel with a column for each named formula, all in one plan."""
    c = Compiler(panel, allow_lookahead)
    for name, formula in formulas.items():
        c.add(formula, name)
    hidden = [n for s in c.stages for k in ("ticker", "date", "fold") for n, *_ in s[k]]
    return c.result().drop(*hidden)


def winsorise(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    a, b = F.percentile(x, F.lit(low)).over(ops.cs()), F.percentile(x, F.lit(high)).over(ops.cs())
    return F.when(x.isNotNull(), F.least(F.greatest(x, a), b))


def standardise(x: Column) -> Column:
    return ops.cs_zscore(x)


def signal(panel: DataFrame, formula: str) -> DataFrame:
    """date, ticker, sector, signal: evaluated, winsorised, then standardised by date; missing dropped."""
    df = evaluate(panel, {"_raw": formula}).select(DATE, TICKER, "sector", "_raw")
    df = df.withColumn("_wins", winsorise(ns.finite(F.col("_raw")))).withColumn("signal", standardise(F.col("_wins")))
    return df.where("signal is not null").select(DATE, TICKER, "sector", "signal")


def on_date(panel: DataFrame, formula: str, date: str) -> DataFrame:
    """The formula on one date's cross-section; operators that need history are refused."""
    tree = _parse(formula)
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and (isinstance(n.func, ast.Attribute) or OPERATORS.get(getattr(n.func, "id", ""), None) and OPERATORS[n.func.id].keyed in ("ticker", "fold")):
            raise FormulaError("this operator needs history")
    return evaluate(panel.where(F.col(DATE) == F.lit(date).cast("date")), {"value": formula}).select(DATE, TICKER, "value").where("value is not null")
