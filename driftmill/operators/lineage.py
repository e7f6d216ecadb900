"""Lineage, splits and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import statistics, tables


class LineageCycle(ValueError):
    """Parents that lead back to where they started."""


def roots(spark: SparkSession, edges: DataFrame, cycles: str = "error") -> DataFrame:
    """id and root of (id, parent) rows: parents are followed to a row without one, to one that is its own, or to an id that has no row.

    A round joins what each row has reached with what that has reached, so rounds are as many as the logarithm of the longest
    chain, and neither rows nor depth are limited. A cycle is an error (LineageCycle, with its smallest id), or with cycles
    "smallest" ids that lead into one get its smallest id as root. An id of several rows has a row for each path; if the
    table has a cycle too, so that paths may have no end, one for each root (and for chains without an end the smallest id
    met). Null ids with a parent are left out.
    """
    if cycles not in ("error", "smallest"):
        raise ValueError("cycles are an error or go by their smallest id")
    own = F.col("parent").isNull() | (F.col("parent") == F.col("id"))
    start = edges.where("id IS NOT NULL OR parent IS NULL").select("id", F.coalesce("parent", "id").alias("at"), own.alias("done"), F.least("id", "parent").alias("low"), F.lit(1.0).alias("paths"))
    now, drop = tables.written(start, "lineage")
    n, ids = now.agg(F.count("*"), F.count_distinct("id")).first()
    steps = 1
    while going := now.where("NOT done").limit(1).count() > 0:
        if steps > n:  # more steps than rows
            break
        reached = now.select(F.col("id").alias("via"), F.col("at").alias("to"), F.col("done").alias("ended"), F.col("low").alias("lower"), F.col("paths").alias("times"))
        on = now.where("NOT done").join(reached, F.col("at") == F.col("via"), "left")
        on = on.select("id", F.coalesce("to", "at").alias("at"), F.coalesce("ended", F.lit(True)).alias("done"), F.least("low", "lower").alias("low"), (F.col("paths") * F.coalesce("times", F.lit(1.0))).alias("paths"))
        both = now.where("done").unionByName(on)
        if n > ids:
            both = both.groupBy("id", "at", "done").agg(F.min("low").alias("low"), F.sum("paths").alias("paths"))
        last, (now, drop) = drop, tables.written(both, "lineage")
        last()
        steps *= 2
    if going:
        # a walk may stand on an end that it has only just reached
        walks = now.where("NOT done")
        walks = walks.join(walks.select(F.col("id").alias("via")).distinct(), F.col("at") == F.col("via"), "left_semi")
        low = walks.groupBy(F.col("id").alias("via")).agg(F.min("low").alias("root"))
        if cycles == "error" and not walks.isEmpty():
            raise LineageCycle(f"lineage has a cycle through {low.agg(F.min('root')).first()[0]}")
        out = now.where("done").select("id", F.col("at").alias("root")).unionByName(walks.join(low, F.col("at") == F.col("via")).select("id", "root"))
        return out.distinct() if n > ids else out
    if n > ids:
        now = now.withColumn("paths", F.explode(F.array_repeat("done", F.col("paths").cast("int"))))
    return now.select("id", F.col("at").alias("root"))


def partitioned(groups: DataFrame, baseline: int, holdout: int) -> DataFrame:
    """root, n and part: whole groups in order of their name fill the baseline, then the holdout; the rest is for tests."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).withColumn("name", F.col("root").cast("string"))
    placed = statistics.cumulative(sizes.select("name", "n"), [], "name", ["n"]).join(sizes.select("name", "root"), "name").withColumn("first", F.col("n_before") < baseline)
    placed, _ = tables.written(placed, "partition")
    # the holdout begins at what the baseline really holds
    held = placed.agg(F.sum(F.when(F.col("first"), F.col("n"))).alias("held"))
    return placed.crossJoin(F.broadcast(held)).select("root", "n", F.when(F.col("first"), "baseline").when(F.col("n_before") < F.col("held") + holdout, "holdout").otherwise("test").alias("part"))  # one row


def leaked(roots: DataFrame, train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Roots that training and holdout ids share; there must be none. Ids that have no row are their own root."""
    of = lambda ids: ids.select("id").distinct().join(roots, "id", "left").select(F.coalesce("root", "id").alias("root")).distinct()
    return of(train).join(of(holdout), "root")


def audited(spark: SparkSession, acquisitions: DataFrame, broken: DataFrame) -> DataFrame:
    """Three checks, passed and detail: the contract (broken: id, reason), unique ids, and the lineage of simulations.

    acquisitions have id, source, parent_acquisition_id and simulation_version.
    """
    counts = acquisitions.groupBy("id").agg(F.count("*").alias("n"))
    twice = counts.agg(F.count_if(F.col("n") > 1).alias("x")).first()["x"]
    wrong = broken.agg(F.count("*").alias("n"), F.min_by("reason", "id").alias("reason")).first()
    simulated = acquisitions.where("source = 'simulated'")
    every = acquisitions.count()
    try:
        own = roots(spark, acquisitions.select("id", F.col("parent_acquisition_id").alias("parent")))
        judged = simulated.join(own, "id").agg(F.count("*").alias("n"), F.min(F.when(F.col("parent_acquisition_id").isNull() | F.col("simulation_version").isNull(), F.concat(F.lit("incomplete lineage of "), "id")).when(F.col("root") == F.col("id"), F.concat("id", F.lit(" is its own root")))).alias("fault")).first()
        lineage = (judged["fault"] is None, judged["fault"] or f"{judged['n']} simulations have a valid lineage")
    except LineageCycle as e:
        lineage = (False, str(e))
    rows = [("acquisition_contract", not wrong["n"], wrong["reason"] or f"{every} acquisitions keep the contract"), ("unique_acquisition_ids", not twice, f"{twice} ids are repeated" if twice else "ids are unique"), ("simulation_lineage", *lineage)]
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")


def split(df: DataFrame, order: list[str], training: int, calibration: int, test: int) -> DataFrame:
    """df with part by place: sizes that add up to the number of rows, or an error."""
    if min(training, calibration, test) < 0 or training + calibration + test != df.count():
        raise ValueError("the sizes of the parts add up to the number of rows")
    t = F.col("__t")
    return tables.indexed(df, order, "__t").withColumn("part", F.when(t < training, "training").when(t < training + calibration, "calibration").otherwise("test")).drop("__t")


def exact_duplicates(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Groups of rows with equal content by SHA-256: sha256, n and the smallest key."""
    return df.groupBy(F.sha2(content.cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns))
    return one.unpivot(["rows"], columns, "field", "missing")


def near_hashes(df: DataFrame, key: str, bits: str, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Classes of equal 64-bit hashes (key, class: the smallest key) and pairs of classes at most `most` bits apart (a, b, distance).

    Of most + 1 bands of bits one at least is equal in a pair, so only such classes meet. Copies are in one class and never
    paired; a pair that agrees in several bands is made in its first one alone, so that none has to be dropped later.
    """
    if not 0 <= most <= 15:
        raise ValueError("bands of four bits at least")
    width = -(-64 // (most + 1))
    df, _ = tables.written(df.select(key, bits), "hashes")  # hashes are read several times
    first = df.groupBy(bits).agg(F.min(key).alias("class"))
    members = df.join(first, bits).select(key, "class")
    part = lambda h, b: F.shiftrightunsigned(h, b * width).bitwiseAND(F.lit((1 << width) - 1))
    bands = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), part(F.col(bits), b).alias("part")) for b in range(most + 1))))
    x = first.select(F.col("class").alias("a"), F.col(bits).alias("ha"), bands.alias("k"))
    y = x.toDF("b", "hb", "k")
    far = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    earlier = F.lit(False)
    for b in range(most + 1):
        earlier = earlier | ((F.lit(b) < F.col("k.band")) & (part(F.col("ha"), b) == part(F.col("hb"), b)))
    return members, x.join(y, "k").where((F.col("a") < F.col("b")) & (far <= most) & ~earlier).select("a", "b", far.alias("distance"))


def near_links(df: DataFrame, key: str, bits: str, most: int = 4) -> DataFrame:
    """Every row's class of equal hashes and with how many other classes it is linked."""
    members, pairs = near_hashes(df, key, bits, most)
    pairs, _ = tables.written(pairs, "pairs")
    links = pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(links, "class", "left").select(key, "class", F.coalesce("links", F.lit(0)).alias("links"))


def inspected_sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files (source, path, sha256, height, width): by source files, duplicates (files beyond the first of their content) and distinct contents; and by source and size, files, the most frequent first."""
    once = files.groupBy("source", "sha256").agg(F.count("*").alias("n"))
    counts = once.groupBy("source").agg(F.sum("n").alias("files"), F.sum(F.col("n") - 1).alias("duplicates"), F.count("*").alias("contents"))
    sizes = files.groupBy("source", "height", "width").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "source", "height", "width")
    return counts, sizes


def paired(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images (name, height, width) with their masks, whose names begin with the image's and _mask: masks, missing, matched (one has the image's size)."""
    base = F.regexp_replace("name", r"_mask.*$", "")
    own = masks.select(base.alias("name"), F.struct("height", "width").alias("size"))
    out = images.join(own, "name", "left").groupBy("name", "height", "width").agg(F.count("size").alias("masks"), F.coalesce(F.bool_or((F.col("size.height") == F.col("height")) & (F.col("size.width") == F.col("width"))), F.lit(False)).alias("matched"))
    return out.withColumn("missing", F.col("masks") == 0)


def annotated(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images and annotations (name, height, width, px) of one name: whether the sizes differ, whether the annotation is empty, and its values."""
    a = annotations.select("name", F.col("height").alias("h"), F.col("width").alias("w"), F.array_sort(F.array_distinct("px")).alias("values"))
    return images.join(a, "name").select("name", ((F.col("height") != F.col("h")) | (F.col("width") != F.col("w"))).alias("size_mismatch"), F.forall("values", lambda v: v == 0).alias("empty"), "values")


def tagged(parts: dict[tuple[str, str, str], DataFrame]) -> DataFrame:
    """All datasets one below the other, by dataset, class and split."""
    out = None
    for (dataset, kind, part), df in parts.items():
        own = df.withColumns({"dataset": F.lit(dataset), "class": F.lit(kind), "split": F.lit(part)})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value occurs, the most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)
