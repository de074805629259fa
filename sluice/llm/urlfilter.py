"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

Host and path are cut from the url by position alone (see `host_of`). The rule whose
host is the url's host or a parent domain of it, and whose path begins the url's path,
decides; of several the longest does, and of equally long ones the greatest text. Up to
`CHAIN` rules are one expression; more are joined by the parent domains of the distinct
hosts and paths, without a limit on their number.

Where no rule fits, boosted trees decide, trained from labelled URLs on lengths, depth,
digit ratio, entropy, parameter counts, hyphens, labels and suffix statistics (how often
the labelled URLs of a last domain label are to be blocked, of the `suffixes` most
frequent ones). Without labelled URLs of one's own, those that a rule decides are the
labelled ones, with the rule's verdict; if there are none either, the score is 0.

Features and trees are Column expressions, so judging is one projection without Python
or shuffle. Training takes at most `most` labelled URLs; their features come from the
same expressions. A null url, or one without `://`, has empty host and path, matches no
rule and is judged by its features (all zero); null ids and repeated rows are carried;
extra columns are ignored; an empty table gives an empty result. Long urls are read whole.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST, SUFFIXES, CHAIN = 20_000, 200, 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """`block com/en/` is the host com with the path /en/."""
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, verdict)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: str = "url") -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(F.col(url)), "^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: str = "url") -> Column:
    """From the host's end up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(F.col(url)), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, or nulls; one condition for each rule."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def ruled(rows: DataFrame, rules: list[Rule], chain: int = CHAIN) -> DataFrame:
    """rows (with host and path) with columns rule and ruled, the verdict of the rule that fits, or nulls."""
    if len(rules) <= chain:
        text, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
        return rows.withColumn("rule", text).withColumn("ruled", verdict)
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, ruled string")
    most = max(r.host.count(".") + 1 for r in rules)
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("rule_host"))
    fits = asked.join(table, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    longest = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("ruled"))).alias("best"))
    return rows.join(longest, ["host", "path"], "left").withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.ruled")).drop("best")


FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "longest_label", "suffix_rate"]


def features(suffix_rates: dict[str, float], url: str = "url") -> dict[str, Column]:
    """Expressions over the columns host, path and the url."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    size = F.greatest(F.length(host), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(host, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(host) - F.length(F.replace(host, c, F.lit("")))) / size))
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    split = F.split(host, "\\.")
    suffix = F.element_at(split, -1)
    rate = functools.reduce(lambda rest, kv: F.when(suffix == kv[0], F.lit(kv[1])).otherwise(rest), sorted(suffix_rates.items()), F.lit(0.5))
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    exprs = [F.length(u), F.length(host), F.length(path), count(path, "/"), count(u, "[0-9]") / n, F.round(entropy, 6), count(u, "[&=]"), count(host, "-"), F.size(split), F.array_max(F.transform(split, lambda x: F.length(x))), rate]
    return {k: e.cast("double") for k, e in zip(FEATURES, exprs, strict=True)}


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    value: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def column(self) -> Column:
        if self.left is None:
            return F.lit(round(self.value, 6))
        return F.when(F.col(FEATURES[self.feature]) <= self.cut, self.left.column()).otherwise(self.right.column())

    def shrink(self, rate: float) -> None:
        self.value *= rate
        for side in (self.left, self.right):
            if side is not None:
                side.shrink(rate)

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.apply(x), self.right.apply(x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    value = -g.sum() / (h.sum() + ridge)
    best = (1e-6, None, 0.0)
    if depth and len(x) >= 2 * least:
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            ends = np.flatnonzero(v[:-1] < v[1:])
            ends = ends[(ends + 1 >= least) & (len(v) - ends - 1 >= least)]
            if len(ends):
                gain = cg[ends] ** 2 / (ch[ends] + ridge) + (cg[-1] - cg[ends]) ** 2 / (ch[-1] - ch[ends] + ridge) - whole
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, float((v[ends[i]] + v[ends[i] + 1]) / 2))
    if best[1] is None:
        return Tree(value=float(value))
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], float(value), *(_grow(x[m], g[m], h[m], depth - 1, least, ridge) for m in (low, ~low)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0) -> list[Tree]:
    """Trees for the log loss; each leaf's value has the learning rate in it."""
    z, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, p - y, p * (1 - p), depth, least, ridge)
        tree.shrink(rate)
        z += tree.apply(x)
        out.append(tree)
    return out


def train(labelled: DataFrame, most: int = MOST, suffixes: int = SUFFIXES, **options) -> tuple[list[Tree], dict[str, float]]:
    """labelled: url, label (1: block). Reads at most `most` of its rows, by a hash of the url."""
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).orderBy(F.xxhash64("url"), "url").limit(most)
    cut = rows.withColumn("host", host_of()).withColumn("path", path_of())
    suffix = cut.groupBy(F.element_at(F.split("host", "\\."), -1).alias("s")).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").limit(suffixes)
    rates = {r["s"]: round((r["b"] + 1) / (r["n"] + 2), 4) for r in suffix.collect()}
    got = np.array([list(r) for r in cut.select(*[e.alias(k) for k, e in features(rates).items()], "label").collect()])
    return (boost(got[:, :-1], got[:, -1], **options) if len(got) else []), rates


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).withColumn("host", host_of()).withColumn("path", path_of())
    with_rules = ruled(rows, rules)
    if labelled is None:
        labelled = with_rules.filter("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("label"))
    trees, rates = train(labelled, **options)
    total = functools.reduce(lambda a, t: a + t.column(), trees, F.lit(0.0))
    score = F.round(1 / (1 + F.exp(-total)), 6) if trees else F.lit(0.0)
    scored = with_rules.withColumns(features(rates)).withColumn("score", score)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
