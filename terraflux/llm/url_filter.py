"""URL filters: rules by host and path, and a logistic regression for the rest.

The regression works on hashed character n-grams of host and path. Features are
made by the same SQL expressions for training and for scoring; scoring is an
expression over the url alone, with the weights as one array literal of fixed
size. The model learns from a small labelled URL table: a given one, or the urls that
a rule decides, of which at most ``max_labelled`` distinct ones by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without a "://"."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none does. A host that
    has the rule's host as its last labels fits, if the path starts with the rule's path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overrides
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def features(host: Column, path: Column, *, sizes: tuple[int, ...] = (3, 4), buckets: int = 4096) -> Column:
    """Bucket numbers of all character n-grams of "^host$" and of "^path$", repeats included."""

    def grams(text: Column, tag: str, n: int) -> Column:
        text = F.concat(F.lit(tag), text, F.lit("$"))
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n)), F.lit(tag)), F.lit(buckets)).cast("int"))

    return F.concat(*(grams(text, tag, n) for text, tag in ((host, "^h"), (path, "^p")) for n in sizes))


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    bias: float

    def logit(self, feats: Column) -> Column:
        """Mean weight of the n-grams, and the bias."""
        w = F.expr("cast(split('" + ",".join(repr(round(x, 6)) for x in self.weights) + "', ',') as array<double>)")
        total = F.aggregate(feats, F.lit(0.0), lambda acc, i: acc + F.element_at(w, i + 1))
        return total / F.greatest(F.size(feats), F.lit(1)) + F.lit(self.bias)


def fit(labelled: DataFrame, *, max_labelled: int = 3000, buckets: int = 4096, rounds: int = 300, rate: float = 2.0, decay: float = 1e-5) -> UrlModel:
    """Logistic regression by full-batch gradient descent with momentum, on a labelled table
    (host, path, block boolean) of at most ``max_labelled`` distinct rows: those that come
    first by hash. Labels count with equal total weight. With one label only, or none, the
    model says that label, or allow."""
    rows = (
        labelled.where("block is not null").select("host", "path", "block").distinct()
        .orderBy(F.xxhash64("host", "path"), "host", "path", "block").limit(max_labelled)
        .select(features(F.col("host"), F.col("path"), buckets=buckets).alias("f"), "block").collect()
    )
    y = np.array([r.block for r in rows], float)
    if not len(y) or y.min() == y.max():
        return UrlModel((0.0,) * buckets, 10.0 if len(y) and y[0] else -10.0)
    at = np.array([i for r in rows for i in r.f], np.int64)
    sizes = np.array([len(r.f) for r in rows])  # never 0: "^h$" alone is an n-gram
    row = np.repeat(np.arange(len(rows)), sizes)
    value = 1.0 / sizes[row]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b, vw, vb = np.zeros(buckets), 0.0, np.zeros(buckets), 0.0
    scale = len(rows) / max(1e-9, float((np.bincount(row * buckets + at, value, len(rows) * buckets) ** 2).sum()))
    for _ in range(rounds):
        logit = np.bincount(row, w[at] * value, len(rows)) + b
        g = share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        vw = 0.9 * vw - rate * (scale * np.bincount(at, g[row] * value, buckets) + decay * w)
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return UrlModel(tuple(map(float, w)), float(b))


def judge(pages: DataFrame, model: UrlModel | None = None, *, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for each row of pages (page_id, url).

    verdict is the longest fitting rule's, else "block" where the model's probability
    reaches the threshold, else "allow". The model is the given one, else it is trained from
    ``labelled`` (url, block boolean), else from the urls of pages that a rule decides. A null url, or one without "://", has an empty
    host and path, fits no rule, and is judged by the model. Repeated rows are each
    returned, an empty table gives no rows, and other columns play no part.
    """
    host, path = F.col("host"), F.col("path")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(host, path, rules)
    ruled = split.withColumns({"rule": rule, "says": says})
    if model is None and labelled is not None:
        model = fit(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "block"))
    if model is None:
        model = fit(ruled.where("says is not null").select("host", "path", (F.col("says") == "block").alias("block")))
    scored = ruled.withColumn("__f", features(host, path, buckets=len(model.weights)))
    scored = scored.withColumn("block_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-model.logit(F.col("__f")))))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "block_score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
