"""Quality rules: fixed rules, and robust multivariate outliers by language and source.

Each document gets a vector of five transformed statistics. For each language and
source the minimum covariance determinant is estimated, from several starts: the
medians with their absolute deviations, and small subsets chosen by hash. A step
measures all rows from an estimate, and takes mean and covariance of the ``share`` of
rows with the smallest distances. After two steps from each start the one with the
least determinant goes on until the determinant falls no more. A row whose squared
Mahalanobis distance from the final estimate exceeds ``cutoff`` is rejected.

All of it is DataFrame work. Texts are read once; their statistics go to a small
table. In each step rows add up, by group and narrow bin of distance, to counts and
sums before the shuffle, so a source with a third of all rows costs some bins for each
task, and no task sees the rows of a group; of the farthest bin a part of the sums counts.
Estimates are joined to rows by broadcast while there are few of them, else on
group and salt.

Estimates of groups lean towards their language's, those towards the one of all rows,
and that towards a broad one, each as if it had PRIOR_ROWS rows; so a small group is
judged by its language, and a small table hardly at all, without a threshold of size.
A variance floor for each statistic keeps constant ones (most texts have no symbols at
all) from making every other value an outlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, discard, free_name, materialise, table

SYMBOLS = "#*$%&|<>"
#: Least standard deviation of each statistic.
FLOORS = {"x_length": 0.8, "x_word": 0.25, "x_symbols": 0.25, "x_lines": 0.15, "x_repeats": 0.15}
#: Standard deviations that hold without rows.
BROAD = {"x_length": 2.0, "x_word": 1.5, "x_symbols": 1.5, "x_lines": 0.5, "x_repeats": 0.5}
PRIOR_ROWS = 50.0
SHARE = 0.75
#: share / P(chi-square with p + 2 = 7 degrees <= the share quantile of that with p = 5): makes
#: the covariance of the nearest 75 % consistent for normal rows.
CONSISTENCY = 1.41
CUTOFF = 30.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
XS = list(FLOORS)
PAIRS = [(x, y) for i, x in enumerate(XS) for y in XS[: i + 1]]
#: Starts by hash besides that from the medians, and rows of each on average.
SUBSETS, SUBSET_ROWS = 3, 10
#: Bins in each doubling of the squared distance, and the doublings from 1 that have bins.
FINE, LOW, HIGH = 16, -2, 14
SALTS = 32


def with_counts(docs: DataFrame, text: Column, window: int = 8) -> DataFrame:
    """docs with the counts of a text, and n_lines (lines with a word); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    names = docs.columns
    got = docs.withColumns({
        "__words": F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != ""),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "__lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.ltrim(x, F.lit(SPACES))) > 0),
    })
    n = F.size("__words")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>"))
    got = got.select(
        *names, "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, window))).alias("__windows"),
    )
    # only texts with a window that recurs are sorted
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    got = got.withColumn("__placed", F.when(again, placed)).drop("__windows")
    same = lambda x, i: F.coalesce(F.get("__placed", i)["h"] == x["h"], F.lit(False))
    twin = lambda x, i: same(x, i - 1) | same(x, i + 1)
    got = got.withColumn("__at", F.sort_array(F.transform(F.filter("__placed", twin), lambda x: x["i"]))).drop("__placed")
    covered = F.aggregate(F.transform("__at", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("__at", i + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    return got.select(*names, *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def with_vector(df: DataFrame) -> DataFrame:
    n, chars = F.col("n_words"), F.col("word_chars")
    return df.withColumns({
        "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "x_length": F.log(n + F.lit(1.0)),
        "x_word": (chars + 30 * 6) / (n + 30),  # short texts lean to six characters a word
        "x_symbols": F.log(1 + 100 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        "x_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "x_repeats": F.col("n_repeat_words") / F.greatest(n, F.lit(1)),
    })


def _distance(df: DataFrame, name: str) -> DataFrame:
    """df, with mean m_x and lower triangular factor f_x_y of the covariance, and the squared distance."""
    z: dict[str, Column] = {}
    for i, x in enumerate(XS):
        rest = F.col(x) - F.col(f"m_{x}")
        for y in XS[:i]:
            rest = rest - F.col(f"f_{x}_{y}") * F.col(f"__z_{y}")
        df = df.withColumn(f"__z_{x}", rest / F.col(f"f_{x}_{x}"))
        z[x] = F.col(f"__z_{x}")
    return df.withColumn(name, sum((v * v for v in z.values()), F.lit(0.0))).drop(*[f"__z_{x}" for x in XS])


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s_{x}") for x in XS], *[F.sum(F.col(x) * F.col(y)).alias(f"q_{x}_{y}") for x, y in PAIRS]]


_SUMS = ["n", *[f"s_{x}" for x in XS], *[f"q_{x}_{y}" for x, y in PAIRS]]


def _mean_and_covariance(sums: DataFrame, factor: float) -> DataFrame:
    """Mean m_x and covariance c_x_y, times ``factor``, of each row of sums."""
    df = sums.withColumns({f"m_{x}": F.col(f"s_{x}") / F.col("n") for x in XS})
    cov = lambda x, y: F.col(f"q_{x}_{y}") / F.col("n") - F.col(f"m_{x}") * F.col(f"m_{y}")
    return df.withColumns({f"c_{x}_{y}": (cov(x, y) if x != y else F.greatest(cov(x, y), F.lit(0.0))) * factor for x, y in PAIRS})


def _factors(df: DataFrame) -> DataFrame:
    """Cholesky factor f_x_y of the covariances c_x_y with their floors, and log_det."""
    df = df.withColumns({f"c_{x}_{x}": F.col(f"c_{x}_{x}") + F.lit(FLOORS[x] ** 2) for x in XS})
    for i, x in enumerate(XS):
        for j, y in enumerate(XS[: i + 1]):
            rest = F.col(f"c_{x}_{y}")
            for k in XS[:j]:
                rest = rest - F.col(f"f_{x}_{k}") * F.col(f"f_{y}_{k}")
            df = df.withColumn(f"f_{x}_{y}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if x == y else rest / F.col(f"f_{y}_{y}"))
    return df.withColumn("log_det", sum((2 * F.log(f"f_{x}_{x}") for x in XS), F.lit(0.0))).drop(*[f"c_{x}_{y}" for x, y in PAIRS])


def _estimated(rows: DataFrame, per_group: DataFrame, few: bool) -> DataFrame:
    """rows (group, salt) with the columns of per_group, once for each of its rows of the group. ``few``:
    per_group has few enough rows for a broadcast."""
    other = per_group.withColumnRenamed("group", "__group")
    if few:
        return rows.join(F.broadcast(other), F.col("group") == F.col("__group"), "left").drop("__group")
    salted = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted.hint("merge"), (F.col("group") == F.col("__group")) & (F.col("salt") == F.col("__salt")), "left").drop("__group", "__salt")


def starts(rows: DataFrame, few: bool) -> DataFrame:
    """(group, start, m_x, f_x_y, log_det) to start from; start 0: medians and absolute deviations."""
    mid = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_group"), *[F.percentile_approx(x, 0.5, 2000).alias(f"m_{x}") for x in XS])
    mid = materialise(mid, "medians")
    near = _estimated(rows, mid, few)
    spread = near.groupBy("group").agg(*[F.max(f"m_{x}").alias(f"m_{x}") for x in XS], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 2000).alias(f"d_{x}") for x in XS])
    first = _factors(spread.select("group", F.lit(0).alias("start"), *[f"m_{x}" for x in XS], *[((1.4826 * F.col(f"d_{x}")) ** 2 if x == y else F.lit(0.0)).alias(f"c_{x}_{y}") for x, y in PAIRS]))
    chosen = lambda k: F.pmod(F.xxhash64(F.lit(k), *XS), F.lit(1 << 30)) < F.lit(SUBSET_ROWS * (1 << 30)) / F.col("n_group")
    some = near.withColumn("start", F.explode(F.filter(F.array(*[F.when(chosen(k), F.lit(k)) for k in range(1, SUBSETS + 1)]), lambda k: k.isNotNull())))
    subsets = _factors(_mean_and_covariance(some.groupBy("group", "start").agg(*_moments()), 1.0))
    keep = ["group", "start", *[f"m_{x}" for x in XS], *[f"f_{x}_{y}" for x, y in PAIRS], "log_det"]
    return first.select(*keep).unionByName(subsets.select(*keep))


def step(rows: DataFrame, models: DataFrame, few: bool, share: float = SHARE) -> DataFrame:
    """The models (group, start, m_x, f_x_y, log_det), with the sums behind them, of the ``share`` of
    rows that are nearest to the given ones, by bins of distance, of the last one in part."""
    bin_of = F.floor(F.log2(F.least(F.greatest("d2", F.lit(2.0**LOW)), F.lit(2.0**HIGH))) * FINE).cast("int")
    binned = _distance(_estimated(rows, models.drop("log_det", *_SUMS), few), "d2").withColumn("bin", bin_of).groupBy("group", "start", "bin").agg(*_moments())
    each = Window.partitionBy("group", "start")
    before = F.coalesce(F.sum("n").over(each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("n").over(each) * share - before
    near = binned.withColumn("part", F.least(F.lit(1.0), left / F.col("n"))).where("part > 0")
    return _factors(_mean_and_covariance(near.groupBy("group", "start").agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in _SUMS]), CONSISTENCY))


def leaning(best: DataFrame, langs: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """(group, m_x, f_x_y): the estimates (group and sums) drawn towards those of their language
    (langs: group, lang), of all rows and the broad one."""
    total = lambda df: [F.sum(c).alias(c) for c in _SUMS]
    own = best.select("group", *_SUMS).join(langs.withColumnRenamed("group", "__group"), F.col("group") == F.col("__group")).drop("__group")
    whole = best.agg(*total(best)).first()  # one row
    n = float(whole["n"] or 0)
    mean = {x: (whole[f"s_{x}"] / n if n else 0.0) for x in XS}
    cov = {(x, y): ((whole[f"q_{x}_{y}"] / n - mean[x] * mean[y]) * CONSISTENCY if n else 0.0) for x, y in PAIRS}
    cov = {(x, y): (n * max(c, 0.0 if x == y else c) + prior_rows * (BROAD[x] ** 2 if x == y else 0.0)) / (n + prior_rows) for (x, y), c in cov.items()}

    def drawn(df: DataFrame, m: dict[str, Column], c: dict[tuple[str, str], Column]) -> DataFrame:
        w = F.col("n") / (F.col("n") + prior_rows)
        new = {f"m_{x}": w * F.col(f"m_{x}") + (1 - w) * m[x] for x in XS}
        return df.withColumns(new | {f"c_{x}_{y}": w * F.col(f"c_{x}_{y}") + (1 - w) * c[x, y] for x, y in PAIRS})

    by_lang = _mean_and_covariance(own.groupBy("lang").agg(*total(own)), CONSISTENCY)
    by_lang = drawn(by_lang, {x: F.lit(v) for x, v in mean.items()}, {k: F.lit(v) for k, v in cov.items()})
    by_lang = by_lang.select(F.col("lang").alias("__lang"), *[F.col(f"m_{x}").alias(f"lm_{x}") for x in XS], *[F.col(f"c_{x}_{y}").alias(f"lc_{x}_{y}") for x, y in PAIRS])
    both = _mean_and_covariance(own, CONSISTENCY).join(by_lang, F.col("lang") == F.col("__lang"))
    both = drawn(both, {x: F.col(f"lm_{x}") for x in XS}, {(x, y): F.col(f"lc_{x}_{y}") for x, y in PAIRS})
    return _factors(both).select("group", *[f"m_{x}" for x in XS], *[f"f_{x}_{y}" for x, y in PAIRS])


def least_determinant(rows: DataFrame, few: bool = True, *, share: float = SHARE, most_steps: int = 15, least_fall: float = 1e-3) -> DataFrame:
    """The best estimate of each group, as ``step`` has it, from rows (group, salt, x...). It ends
    when no group's log determinant falls by more than least_fall, or after most_steps."""
    models = materialise(starts(rows, few), "model")
    for _ in range(2):
        old, models = models, materialise(step(rows, models, few, share), "model")
        discard(old)
    columns = [c for c in models.columns if c not in ("group", "start")]
    best = materialise(models.groupBy("group").agg(F.min_by(F.struct("start", *columns), F.struct("log_det", "start")).alias("b")).select("group", "b.*"), "model")
    for _ in range(most_steps - 2):
        new = materialise(step(rows, best, few, share), "model")
        old = best.select(F.col("group").alias("__group"), F.col("log_det").alias("__log_det"))
        fall = new.join(old, F.col("group") == F.col("__group")).agg(F.max(F.col("__log_det") - F.col("log_det"))).first()[0]
        discard(best)
        best = new
        if fall is None or fall <= least_fall:
            break
    return best


def outlier_model(rows: DataFrame, few: bool = True) -> DataFrame:
    """(group, m_x, f_x_y) from rows (group, lang, salt, x...): the estimate of every group that
    has rows. Repeated rows each weigh; equal values and single rows give the floors."""
    return materialise(leaning(least_determinant(rows, few), rows.groupBy("group").agg(F.min("lang").alias("lang"))), "model")


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, info: str = "quality", cutoff: float = CUTOFF, few_groups: int = 5000) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and a struct ``info``: the counts,
    base_failed, distance (squared; null where no row of the group passes the base rules)
    and kept.

    kept is false where base_failed, or where the distance exceeds ``cutoff``. A null
    or empty text has no words and fails the base rules. Null languages and sources
    form groups like any other, and equal "". Repeated rows are each judged and each
    weigh in the estimate, an empty table gives no rows, texts count whole. Other
    columns of any name pass through; where ``info`` is the name of one that is kept, the
    struct's gets underscores until it is not. With more than few_groups groups, their
    estimates are joined by group and salt and not broadcast, with equal results.
    """
    keep = docs.columns if keep is None else keep
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    own = [f"k{i}" for i in range(len(keep))]
    inner = docs.toDF(*names).select(*[of[c].alias(k) for c, k in zip(keep, own, strict=True)], of[text_col].alias("__text"), F.coalesce(of[lang_col].cast("string"), F.lit("")).alias("lang"), F.coalesce(of[source_col].cast("string"), F.lit("")).alias("__source"))
    counted = with_vector(with_counts(inner, F.col("__text"))).withColumn("group", F.concat_ws("\x1f", "lang", "__source"))
    counted = materialise(counted.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).drop("__text", "__source"), "quality")
    rows = counted.where("not base_failed").select("group", "lang", "salt", *XS)
    few = rows.select("group").distinct().count() <= few_groups
    done = _distance(_estimated(counted, outlier_model(rows, few), few), "distance")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    name = free_name(keep, info)
    return done.select(*own, F.struct(*COUNTS, "base_failed", "distance", kept.alias("kept")).alias(name)).toDF(*keep, name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", *[f"quality.{c}" for c in (*COUNTS, "base_failed", "kept", "distance")])
