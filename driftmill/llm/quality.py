"""Quality rules with robust multivariate outliers, by DataFrame functions only.

Base rules look at each text alone. The texts that pass are vectors of four transformed statistics. For each language and
source the minimum-covariance-determinant estimate of their mean and covariance is sought: concentration steps from
several starts, of which the one of least determinant goes on until its determinant no longer falls, then one reweighted
step. A group's estimate is drawn towards its language's, and that towards the estimate of all, the more the fewer rows it
has, so that a group of any size has one. Vectors of large Mahalanobis distance are rejected.

Vectors are whole numbers, so that equal ones are counted once and sums are exact in whatever order Spark adds them. A step
is one aggregation of these counts to at most some hundred bins of distance a group, however many rows one group has;
the bin that the subset ends in counts by the share that is needed of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, files, written

#: Share of a group in the subset of least determinant, and of a normal distribution in the reweighted step.
SHARE, REWEIGHTED = 0.6, 0.975
#: Concentration steps of every start, and at most of the best one; starts at hashed vectors beside the median and the mean.
FIRST_STEPS, MOST_STEPS, HASHED_STARTS = 2, 30, 4
#: So many rows does the estimate weigh that a group's own is drawn to.
PRIOR_ROWS = 60
#: A clean vector is rejected with about this chance.
TAIL = 1e-3
#: Standard deviations added to each estimate: word length (log), then the roots of symbols a word and of the shares of repeated lines and words. They
#: keep a covariance of copies or of constant statistics regular; 0.12 is about what chance does to the root of a share of 17 lines. Each statistic alone can
#: exceed CUTOFF: a share of 1 is at 1 / 0.12 ** 2 = 69, one of a half, the most that passes the base rules, at 35.
SPREAD = (0.06, 0.08, 0.12, 0.12)
UNIT = 250
BINS = 48
#: Groups whose estimates are written in one file: each has some hundred bins for every start.
FILE_GROUPS = 500

WORD = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, df: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return low


CUTOFF = round(chi2_quantile(1 - TAIL, 4), 6)
INNER = round(chi2_quantile(REWEIGHTED, 4), 6)


def consistent(share: float) -> float:
    """What the covariance of the inner share of a normal distribution is multiplied by."""
    return round(share / chi2_cdf(chi2_quantile(share, 4), 6), 6)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns STATS of the whole text (null: none). Columns of docs with these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.drop(*STATS).withColumn("__words", F.array_remove(F.split(text, WORD), "")).withColumn("__lines", lines)
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    # three-word windows by their first word; three words hashed to 64 bits count as equal by the hash
    three = F.transform(F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    out = out.withColumn("__three", three)
    some = F.size(F.array_distinct("__three")) < F.size("__three")
    # only texts that repeat a window are sorted
    out = out.withColumn("__sorted", F.when(some, F.array_sort(F.transform("__three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(F.transform("__sorted", lambda x, k: F.when((F.get("__sorted", k - 1)["h"] == x["h"]) | (F.get("__sorted", k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("__sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
        }
    ).drop("__words", "__lines", "__three", "__sorted")


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    whole = lambda x: F.floor(x * UNIT + 0.5).cast("long")
    return {
        "__x0": whole(F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0)))),
        "__x1": whole(F.sqrt(F.least(F.col("n_symbols") / n, F.lit(100.0)))),
        "__x2": whole(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)))),
        "__x3": whole(F.sqrt(F.col("n_repeat_words") / n)),
    }


X = [f"__x{k}" for k in range(4)]
PAIRS = [(j, k) for j in range(4) for k in range(j + 1)]
GROUP = ["g_lang", "g_source"]
SUMS = ["n", *(f"s{j}" for j in range(4)), *(f"p{j}{k}" for j, k in PAIRS)]
MEANS = [f"m{j}" for j in range(4)]
COVARIANCES = [f"c{j}{k}" for j, k in PAIRS]


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m0.. and the Cholesky factor's l00.., by forward substitution."""
    y: list[Column] = []
    for j in range(4):
        rest = F.col(X[j]) - F.col(f"m{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * y[k]
        y.append(rest / F.col(f"l{j}{j}"))
    return y[0] * y[0] + y[1] * y[1] + y[2] * y[2] + y[3] * y[3]


def _sums() -> dict[str, Column]:
    """Of counted vectors: their number, sums and sums of products, as whole numbers."""
    n = F.col("count")
    return {"n": F.sum(n), **{f"s{j}": F.sum(n * F.col(X[j])) for j in range(4)}, **{f"p{j}{k}": F.sum(n * F.col(X[j]) * F.col(X[k])) for j, k in PAIRS}}


def _moments(sums: DataFrame, share: float) -> DataFrame:
    """Means m0.. and covariances c00.. from SUMS of the inner share."""
    out = sums.withColumns({f"m{j}": F.col(f"s{j}") / F.col("n") for j in range(4)})
    out = out.withColumns({f"c{j}{k}": (F.col(f"p{j}{k}") / F.col("n") - F.col(f"m{j}") * F.col(f"m{k}")) * consistent(share) for j, k in PAIRS})
    return out.drop(*SUMS)


def _factored(moments: DataFrame) -> DataFrame:
    """Beside the moments, the Cholesky factor l00.. of the covariance with SPREAD on its diagonal, and log_det."""
    out = moments
    for j in range(4):
        for k in range(j + 1):
            rest = F.col(f"c{j}{k}") + (F.lit((SPREAD[j] * UNIT) ** 2) if j == k else F.lit(0.0))
            for i in range(k):
                rest = rest - F.col(f"l{j}{i}") * F.col(f"l{k}{i}")
            # rounding alone may leave less than what SPREAD adds
            out = out.withColumn(f"l{j}{k}", F.sqrt(F.greatest(rest, F.lit((SPREAD[j] * UNIT) ** 2))) if j == k else rest / F.col(f"l{k}{k}"))
    return out.withColumn("log_det", 2 * sum((F.log(f"l{j}{j}") for j in range(1, 4)), F.log("l00")))


def _starts(cells: DataFrame) -> DataFrame:
    """Where concentration starts in each group: its medians, its mean and covariance, and vectors of smallest hashes."""
    middle = cells.groupBy(*GROUP).agg(*(F.percentile(X[j], 0.5, F.col("count")).alias(f"m{j}") for j in range(4)))
    flat = middle.withColumns({c: F.lit(0.0) for c in COVARIANCES}).withColumn("start", F.lit(0))
    whole = _moments(cells.groupBy(*GROUP).agg(*(c.alias(n) for n, c in _sums().items())), 0.999999).withColumn("start", F.lit(1))
    picked = [F.min_by(F.struct(*X), F.struct(F.xxhash64(F.lit(k), *X), *X)).alias(f"v{k}") for k in range(HASHED_STARTS)]
    some = cells.groupBy(*GROUP).agg(*picked).select(*GROUP, F.posexplode(F.array(*(f"v{k}" for k in range(HASHED_STARTS)))).alias("start", "v"))
    some = some.select(*GROUP, *(F.col(f"v.{X[j]}").cast("double").alias(f"m{j}") for j in range(4)), *(F.lit(0.0).alias(c) for c in COVARIANCES), (F.col("start") + 2).alias("start"))
    columns = [*GROUP, "start", *MEANS, *COVARIANCES]
    return flat.select(columns).unionByName(whole.select(columns)).unionByName(some.select(columns))


def _step(cells: DataFrame, model: DataFrame, held) -> DataFrame:
    """A concentration step of every group and start: moments of the SHARE nearest by the model before."""
    near = cells.join(held(_factored(model)), GROUP).withColumn("bin", F.floor(F.log(1 + _distance()) * BINS))
    binned = near.groupBy(*GROUP, "start", "bin").agg(*(c.alias(n) for n, c in _sums().items()))
    group = Window.partitionBy(*GROUP, "start")
    so_far = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = binned.withColumns({"so_far": so_far, "most": SHARE * F.sum("n").over(group)}).where(F.col("so_far") < F.col("most"))
    # whole bins add up exactly; the last one counts by what is needed of it
    part = F.when(F.col("so_far") + F.col("n") > F.col("most"), (F.col("most") - F.col("so_far")) / F.col("n"))
    inner = inner.withColumn("part", part)
    both = [(F.coalesce(F.sum(F.when(F.col("part").isNull(), F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(F.col("part").isNotNull(), F.col(c) * F.col("part"))), F.lit(0.0))).alias(c) for c in SUMS]
    return _moments(inner.groupBy(*GROUP, "start").agg(*both), SHARE)


def estimates(cells: DataFrame, held=lambda df: df, most: int | None = None) -> tuple[DataFrame, str]:
    """Of counted vectors (GROUP, X, count): each group's rows, means and covariances of least determinant, reweighted.

    held marks small tables for a broadcast; each step's table has most files at most, if given. The path of the written table comes with it.
    """
    spark = cells.sparkSession
    columns = [*GROUP, "start", *MEANS, *COVARIANCES]
    model, at = written(_starts(cells), "estimate")
    for _ in range(FIRST_STEPS):
        new, new_at = written(_step(cells, model, held).select(columns), "estimate", most)
        discard(spark, at)
        model, at = new, new_at
    least = F.row_number().over(Window.partitionBy(*GROUP).orderBy("log_det", "start"))
    best, best_at = written(_factored(model).withColumn("k", least).where("k = 1").select(*columns, "log_det", F.lit(True).alias("falls")), "estimate", most)
    discard(spark, at)
    for _ in range(MOST_STEPS):
        if best.where("falls").isEmpty():
            break
        # only groups whose determinant still falls take part
        open_ = best.where("falls").select(columns)
        next_ = _factored(_step(cells.join(held(open_.select(*GROUP)), GROUP, "left_semi"), open_, held)).select(*columns, F.col("log_det").alias("new_det"))
        both = best.select(*GROUP, F.struct(*columns[2:]).alias("old"), "log_det").join(held(next_.select(*GROUP, F.struct(*columns[2:]).alias("new"), "new_det")), GROUP, "left")
        falls = F.coalesce(F.col("new_det") < F.col("log_det") - 1e-6, F.lit(False))
        both = both.select(*GROUP, F.when(falls, F.col("new")).otherwise(F.col("old")).alias("m"), F.when(falls, F.col("new_det")).otherwise(F.col("log_det")).alias("log_det"), falls.alias("falls"))
        new, new_at = written(both.select(*GROUP, "m.*", "log_det", "falls"), "estimate", most)
        discard(spark, best_at)
        best, best_at = new, new_at
    near = cells.join(held(_factored(best.select(columns))), GROUP).withColumn("inside", _distance() <= INNER)
    n = near.groupBy(*GROUP).agg(F.sum("count").alias("rows"))
    # at least SHARE of the rows lie inside, but where most of a group is far from its densest part
    inner = _moments(near.where("inside").groupBy(*GROUP).agg(*(c.alias(k) for k, c in _sums().items())), REWEIGHTED)
    out = n.join(inner, GROUP, "left").join(best.select(*GROUP, *(F.col(c).alias(f"raw_{c}") for c in (*MEANS, *COVARIANCES))), GROUP)
    out, out_at = written(out.select(*GROUP, "rows", *(F.coalesce(c, f"raw_{c}").alias(c) for c in (*MEANS, *COVARIANCES))), "estimates", most)
    discard(spark, best_at)
    return out, out_at


def _drawn(own: DataFrame, to: DataFrame, on: list[str], held) -> DataFrame:
    """own's moments drawn to those of `to`, which count as PRIOR_ROWS rows."""
    to = to.select(*on, *(F.col(c).alias(f"to_{c}") for c in (*MEANS, *COVARIANCES)))
    both = own.join(held(to), on) if on else own.crossJoin(F.broadcast(to))  # without a key it is one row
    return both.select(*GROUP, "rows", *(((F.col("rows") * F.col(c) + PRIOR_ROWS * F.col(f"to_{c}")) / (F.col("rows") + PRIOR_ROWS)).alias(c) for c in (*MEANS, *COVARIANCES)))


def judged(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with its statistics, base_failed, distance (squared; null where base_failed) and kept.

    keep names the columns of docs that are carried along, by default all; columns of docs that clash with new ones are
    replaced. base_failed: under 50 words, or over half of the words in repeated three-word windows. Null languages or
    sources count as empty strings; null texts have no words. Every text that passes the base rules is judged by the
    estimate of its language and source, however few these are: a group's estimate is drawn to its language's, which is
    drawn to that of all. Repeated rows are judged alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    new = [*STATS, "base_failed", "distance", "kept"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in new]
    own = {"__g_lang": F.concat(F.lit("="), F.coalesce(F.col(lang_col), F.lit(""))), "__g_source": F.concat(F.lit("="), F.coalesce(F.col(source_col), F.lit("")))}
    stats = with_statistics(docs.withColumns(own), text_col)
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumns(_vector())
    stats, stats_at = written(stats.select(*carried, *STATS, "base_failed", "__g_lang", "__g_source", *X), "statistics")

    cells = stats.where("not base_failed").groupBy(F.col("__g_lang").alias("g_lang"), F.col("__g_source").alias("g_source"), *X).agg(F.count("*").alias("count"))
    most = files(spark, stats.count())
    cells, cells_at = written(cells, "cells", most)
    # a star stands for any; other names begin with an equals sign
    levels = F.explode(F.array(F.struct("g_lang", "g_source"), F.struct("g_lang", F.lit("*").alias("g_source")), F.struct(F.lit("*").alias("g_lang"), F.lit("*").alias("g_source"))))
    every = cells.select(levels.alias("g"), *X, "count").groupBy("g.g_lang", "g.g_source", *X).agg(F.sum("count").alias("count"))
    every, every_at = written(every, "levels", most)
    discard(spark, cells_at)
    groups = every.select(*GROUP).distinct().limit(20_001).count()
    small = groups <= 20_000
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    most = -(-groups // FILE_GROUPS) or 1 if small else most
    found, found_at = estimates(every, held, most)
    discard(spark, every_at)
    of_lang = _drawn(found.where("g_lang <> '*' AND g_source = '*'"), found.where("g_lang = '*'").drop(*GROUP), [], held)
    model = _factored(_drawn(found.where("g_source <> '*'"), of_lang.drop("g_source"), ["g_lang"], held))
    model, _ = written(model.select(F.col("g_lang").alias("__g_lang"), F.col("g_source").alias("__g_source"), *MEANS, *(f"l{j}{k}" for j, k in PAIRS)), "model", most)
    discard(spark, found_at)
    out = stats.join(held(model), ["__g_lang", "__g_source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select(*carried, *STATS, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"))


def quality_rules(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that judged() keeps, with the columns of docs."""
    own = docs.columns
    marked = docs.select(F.struct(*own).alias("row"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.col(source_col).alias("s"))
    return judged(marked, "l", "s", "t", keep=["row"]).where("kept").select("row.*")
