"""URL filters (10): path rules first, then gradient-boosted trees on lexical features.

The trees are trained here, by Newton boosting on binned features, from labelled URLs: a table (url, label) with 1 for
block. The sample is bounded by ``TRAIN_ROWS`` (taken by hash order); features read the whole URL. The tables here carry
no URL labels, so the query labels URLs whose registered name holds a word of ``SEED_WORDS``; the trees then judge by
lexical shape alone.

Defined results: a null URL and one without "://" have empty host and path, meet no rule and are judged by the trees on
an empty text. Repeated rows get equal answers. Without labelled rows, or with one label only, the trees give the
prior, and ``train`` warns. Columns besides page_id and url are not read.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import LOWER_SQL, ship

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2 = 40, 3, 0.3, 32, 1.0

#: The rules of the contract: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
SEED_WORDS = ["casino", "pills", "adult", "bets", "spam", "track"]
FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "value_length", "fragment", "tld_rate", "suffix_rate"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); of equal lengths the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def split_url(url: str) -> tuple[str, str, str, str]:
    _, sep, rest = url.partition("://")
    rest = rest if sep else ""
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path, query, fragment


def suffix_of(path: str) -> str:
    last = path.rpartition("/")[2]
    return last.rpartition(".")[2].lower() if "." in last else ""


def features(urls: list[str], tld_rate: dict[str, float], suffix_rate: dict[str, float], prior: float) -> np.ndarray:
    rows = []
    for url in urls:
        host, path, query, fragment = split_url(url)
        params = [x for x in query.split("&") if x]
        rows.append(
            (
                len(url),
                len(host),
                len(path),
                host.count(".") + 1 if host else 0,
                path.count("/"),
                sum(c.isdigit() for c in url) / max(1, len(url)),
                host.count("-"),
                entropy(host),
                len(params),
                sum(len(x.partition("=")[2]) for x in params),
                len(fragment),
                tld_rate.get(host.rpartition(".")[2], prior),
                suffix_rate.get(suffix_of(path), prior),
            )
        )
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on quantile bins."""

    def __init__(self):
        self.prior, self.start, self.trees = 0.5, 0.0, []
        self.tld_rate: dict[str, float] = {}
        self.suffix_rate: dict[str, float] = {}

    def fit(self, urls: list[str], labels: np.ndarray) -> Boosted:
        n = len(urls)
        if not n:
            return self
        y = np.asarray(labels, float)
        self.prior = (y.sum() + 0.5) / (n + 1)
        self.start = math.log(self.prior / (1 - self.prior))
        for name, key in (("tld_rate", lambda u: split_url(u)[0].rpartition(".")[2]), ("suffix_rate", lambda u: suffix_of(split_url(u)[1]))):
            seen, hit = Counter(map(key, urls)), Counter(key(u) for u, t in zip(urls, y, strict=True) if t)
            setattr(self, name, {k: (hit[k] + 5 * self.prior) / (c + 5) for k, c in seen.items()})
        x = features(urls, self.tld_rate, self.suffix_rate, self.prior)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        margin = np.full(n, self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, edges, p - y, p * (1 - p))
            if not tree:
                break
            self.trees.append(tree)
            margin += leaf
        return self

    @staticmethod
    def _grow(binned, edges, g, h):
        """A tree as [(feature, cut, left, right)] with leaf values below 0-based node numbers; and each row's value."""
        tree: list = []
        value = np.zeros(len(g))

        def grow(rows, depth):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if depth and len(rows) >= 20:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            at = len(tree)
            tree.append(None)
            if best[1] is None:
                v = -RATE * gs / (hs + L2)
                value[rows] = v
                tree[at] = (-1, v, 0, 0)
            else:
                _, f, k = best
                left = binned[rows, f] <= k
                tree[at] = (f, float(edges[f][k]), grow(rows[left], depth - 1), grow(rows[~left], depth - 1))
            return at

        grow(np.arange(len(g)), DEPTH)
        return (tree if len(tree) > 1 else []), value

    def margin(self, urls: list[str]) -> np.ndarray:
        x = features(urls, self.tld_rate, self.suffix_rate, self.prior)
        out = np.full(len(urls), self.start)
        for tree in self.trees:
            stack = [(0, np.arange(len(urls)))]
            while stack:
                at, rows = stack.pop()
                f, v, left, right = tree[at]
                if f < 0:
                    out[rows] += v
                else:
                    low = x[rows, f] <= v
                    stack += [(left, rows[low]), (right, rows[~low])]
        return out


def train(labelled: DataFrame, most: int = TRAIN_ROWS) -> Boosted:
    """Fit on at most ``most`` distinct labelled URLs, the first in hash order."""
    rows = labelled.where("url is not null and label is not null").select("url", "label").distinct().orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()
    if len({bool(r.label) for r in rows}) < 2:
        warnings.warn("labelled URLs of one class only: without a rule, every URL gets the same verdict", stacklevel=2)
    return Boosted().fit([r.url for r in rows], np.array([r.label for r in rows], float))


def seed_labels(pages: DataFrame, words: list[str] = SEED_WORDS) -> DataFrame:
    """(url, label): 1 where the host holds a seed word."""
    host, _ = parts(F.col("url"))
    hit = F.lit(False)
    for w in words:
        hit = hit | host.contains(w)
    return pages.where("url is not null").select("url", hit.cast("int").alias("label"))


def judge(pages: DataFrame, model: Boosted, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score (log odds of block)."""
    ship(pages.sparkSession)

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        return pd.Series(model.margin(["" if u is None else u for u in urls]))

    host, path = parts(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    out = out.withColumn("score", score("url"))
    verdict = F.coalesce("found.verdict", F.when(F.col("score") > 0, F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(seed_labels(pages)))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """Host, path and the rule that decides every url, for which there is SQL; op10 gives them beside the trees' verdict."""
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), Boosted())
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


SQL = f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, {LOWER_SQL.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from u),
r(ruled, h, d) as (values {", ".join(f"('{v}', '{h}', '{d}')" for v, h, d in RULES)}),
f as (select page_id, ruled, h || d as rule, row_number() over (partition by page_id order by length(h || d) desc) as nr from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, d))
select p.page_id, host, path, rule, ruled from p left join f on f.page_id = p.page_id and nr = 1
"""
