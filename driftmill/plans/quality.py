"""Queries on the quality of tables: descriptive statistics, comparisons, lineage, duplicates, and what is written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmill.operators import lineage, statistics, tables
from driftmill.sources import metadata, sinks

from .common import FEATURES, rounded, table
from .oracles import F4, LONG, PAIRS, ROOTS

#: Sign hashes at most so many bits apart are a near pair, as in the SQL.
NEAR_BITS = 4


def calibration_stats(spark, sf_dir):
    return rounded(statistics.calibration(table(spark, sf_dir, "events"), "value"))


def variability_by_feature(spark, sf_dir):
    return rounded(statistics.variability(table(spark, sf_dir, "lineitem"), FEATURES), 7)


def described_features(spark, sf_dir):
    own = statistics.described(table(spark, sf_dir, "lineitem"), FEATURES, ["l_returnflag"])
    return rounded(own, 5)


def flagged_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("max_intensity"), (0.1 + F.col("l_tax") / 1000).alias("edge_density"), (F.col("l_linenumber") % 3).cast("double").alias("entropy"), F.col("l_discount").alias("sharpness"))
    own = statistics.flags(statistics.described(rows, ["max_intensity", "edge_density", "entropy", "sharpness"], []))
    return rounded(own.select("feature", "unique_values", F.concat_ws(",", "flags").alias("flags")))


def pooled_and_group_stats(spark, sf_dir):
    return rounded(statistics.pooled_and_grouped(table(spark, sf_dir, "lineitem"), "l_returnflag", FEATURES), 7)


def pearson_pairs(spark, sf_dir):
    return rounded(statistics.redundancy(statistics.pearson_pairs(table(spark, sf_dir, "lineitem"), FEATURES)))


def spearman_pairs(spark, sf_dir):
    return rounded(statistics.spearman_pairs(table(spark, sf_dir, "lineitem"), FEATURES))


def correlated_features(spark, sf_dir):
    """Pairs from 0.9 in size; the net price follows the price."""
    rows = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("duty", F.round(100 * F.col("l_tax")) * F.col("l_tax"))
    return rounded(statistics.correlated(rows, [*FEATURES, "net", "duty"]))


def two_sample_tests(spark, sf_dir):
    own = statistics.two_samples(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "N", FEATURES)
    return rounded(own.withColumn("effect", statistics.effect_size(F.col("cohens_d"))))


def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(statistics.confusion(rows, F.col("n_chars") < 600, F.col("quality") == 0))


def wilson_intervals(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))
    low, high = statistics.wilson(F.col("hits"), F.col("n"), 1.959963984540054)
    return rounded(groups.select("l_linestatus", "n", "hits", low.alias("low"), high.alias("high")))


def required_sequences(spark, sf_dir):
    out = None
    for target, alarms in ((0.05, 0), (0.05, 2), (0.01, 0), (0.2, 5)):
        own = statistics.required_sequences(spark, target, 0.95, alarms, 5000).select(F.lit(target).alias("target"), F.lit(alarms).alias("alarms"), "n")
        out = own if out is None else out.unionByName(own)
    return rounded(out)


def bootstrap_mean(spark, sf_dir):
    return rounded(statistics.bootstrap_mean(table(spark, sf_dir, "labels"), "quality", ["doc_id"], 200))


def repeatability(spark, sf_dir):
    own = statistics.repeatability(table(spark, sf_dir, "lineitem"), FEATURES, "l_returnflag")
    return rounded(own.withColumn("margin", statistics.robustness_margin(F.col("between_session_range"), F.col("within_session_std"))), 5)


def principal_components(spark, sf_dir):
    return rounded(statistics.principal_components(table(spark, sf_dir, "lineitem"), FEATURES)[0])


def relevance(spark, sf_dir):
    return rounded(statistics.relevance(spark))


def _turns(spark, sf_dir):
    key = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("n")).select(key.alias("id"), F.when(F.col("turn") > 0, key - 1).otherwise(key).alias("parent"))


def lineage_roots(spark, sf_dir):
    return lineage.roots(spark, _turns(spark, sf_dir))


def lineage_partition(spark, sf_dir):
    return lineage.partitioned(lineage.roots(spark, _turns(spark, sf_dir)), 100, 50)


def lineage_leaks(spark, sf_dir):
    """Conversations that both an even and an odd hundred of turns come from."""
    turns = _turns(spark, sf_dir)
    part = F.floor(F.col("id") / 2) % 2
    return lineage.leaked(lineage.roots(spark, turns), turns.where(part == 0).select("id"), turns.where(part == 1).select("id"))


def positional_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    return lineage.split(orders, ["o_orderkey"], n // 2, n // 4, n - n // 2 - n // 4).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def audit_checks(spark, sf_dir):
    """Turns as acquisitions: the first of a conversation is a scan, the others are simulations of the turn before."""
    rows = _turns(spark, sf_dir).withColumn("simulated", F.col("id") != F.col("parent"))
    rows = rows.select(F.col("id").cast("string").alias("id"), F.when(F.col("simulated"), "simulated").otherwise("experimental").alias("source"), F.when(F.col("simulated"), F.col("parent").cast("string")).alias("parent_acquisition_id"), F.when(F.col("simulated"), "1.0").alias("simulation_version"))
    return lineage.audited(spark, rows, rows.where("false").select("id", F.lit("").alias("reason"))).select("check", "passed")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def exact_duplicates(spark, sf_dir):
    return lineage.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")))


def source_counts(spark, sf_dir):
    files = _texts(spark, sf_dir).select("source", F.sha2("text", 256).alias("sha256"), F.lit(0).alias("height"), F.length("text").alias("width"))
    return lineage.inspected_sources(files)[0]


def text_bits(text):
    """63 bits of a text: whether an odd number of its words, parted by blanks, fall into each of 63 kinds by first letter and length."""
    kind = lambda w: (F.ascii(w) * 7 + F.length(w) * 13) % 63
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), kind(w))))


def near_hash_links(spark, sf_dir):
    """Texts by classes of equal hashes, and how many other classes are at most NEAR_BITS away."""
    rows = _texts(spark, sf_dir).select("doc_id", text_bits(F.col("text")).alias("bits"))
    return rounded(lineage.near_links(rows, "doc_id", "bits", NEAR_BITS))


def missing_fields(spark, sf_dir):
    return rounded(metadata.inspected_metadata(table(spark, sf_dir, "documents"), ["text", "lang", "source"], "doc_id")[0])


def repeated_texts(spark, sf_dir):
    return rounded(metadata.inspected_metadata(table(spark, sf_dir, "documents"), ["text"], "source")[1])


def unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def paired_orders(spark, sf_dir):
    """Orders as images and line items as their masks, by name; an order's size is its number of digits."""
    images = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("name"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("height"), F.lit(1).alias("width"))
    masks = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select(F.concat(F.lit("o"), "l_orderkey", F.lit("_mask_"), "l_linenumber").alias("name"), F.col("l_linenumber").cast("int").alias("height"), F.lit(1).alias("width"))
    out = lineage.paired(images, masks)
    return rounded(out.groupBy("missing", "matched").agg(F.count("*").alias("images"), F.sum("masks").alias("masks")))


def tagged_union(spark, sf_dir):
    parts = {("customers", "a", "train"): table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v")), ("suppliers", "b", "test"): table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"))}
    return rounded(lineage.histogram(lineage.tagged(parts), ["dataset", "class", "split"]))


def csv_round_trip(spark, sf_dir):
    """Events written as CSV and read again as a feature table; values that are no numbers become NaN."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit(" "), "event_type").alias("dataset"), F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("value").cast("string")).alias("v"))
    path, _ = tables.fresh(spark, "csv")
    sinks.write_csv(rows, path)
    read = metadata.read_feature_table(spark, path, ["v"])
    return rounded(read.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("bad"), F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("mean")))


def metadata_round_trip(spark, sf_dir):
    """Customers as acquisition metadata, written as CSV and read by its contract."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("a"), "c_custkey").alias("acquisition_id"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" s"), F.col("c_nationkey"), F.lit(" "))).alias("session_id"), F.col("c_acctbal").alias("gain"), (F.col("c_custkey") % 5).cast("int").alias("frame_count"), F.lit("2024-01-02T03:04:05").alias("timestamp"))
    path, _ = tables.fresh(spark, "metadata")
    sinks.write_csv(rows, path)
    read = metadata.read_metadata(spark, path)
    return rounded(read.groupBy("session_id").agg(F.count("*").alias("n"), F.avg("gain").alias("gain"), F.sum("frame_count").alias("frames"), F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.count("focus").alias("focus")))


def json_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("r"))
    path, _ = tables.fresh(spark, "json")
    sinks.write_json(rows, path)
    return metadata.read_json(spark, path, lines=True).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("r").cast("bigint").alias("r"))


def run_summary(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    latest = table(spark, sf_dir, "orders").agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"), F.max_by("o_totalprice", "o_orderkey").alias("quality"), F.lit("STABLE").alias("drift_status"))
    return rounded(sinks.run_summary(spark, "orders", "public", n // 2, n // 4, n - n // 2 - n // 4, latest), 5)


QUERIES = (calibration_stats, variability_by_feature, described_features, flagged_features, pooled_and_group_stats, pearson_pairs, spearman_pairs, correlated_features, two_sample_tests, confusion_metrics, wilson_intervals, required_sequences, bootstrap_mean, repeatability, principal_components, relevance, lineage_roots, lineage_partition, lineage_leaks, positional_split, audit_checks, exact_duplicates, source_counts, near_hash_links, missing_fields, repeated_texts, unlabelled, paired_orders, tagged_union, csv_round_trip, metadata_round_trip, json_round_trip, run_summary)

_LEVEL = "CASE WHEN abs({r}) >= 0.9 THEN 'HIGH' WHEN abs({r}) >= 0.7 THEN 'MODERATE' ELSE 'LOW' END"
_RANKS = "r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2 AS {f}" for f in F4) + " FROM lineitem)"
_Z = "1.959963984540054::DOUBLE"
_SIX = [*F4, "net", "duty"]

ORACLES = {
    "calibration_stats": "WITH m AS (SELECT median(value) AS m FROM events) SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(any_value(m), 6) AS median, round(median(abs(value - m)), 6) AS mad, round(min(value), 6) AS min, round(max(value), 6) AS max, "
    + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99))
    + " FROM events, m",
    "variability_by_feature": f"""WITH {LONG}, m AS (SELECT feature, median(v) AS m FROM long GROUP BY feature)
      SELECT feature, count(v) AS n, round(avg(v), 7) AS mean, round(stddev_samp(v), 7) AS std, round(any_value(m), 7) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 7) AS iqr, round(median(abs(v - m)), 7) AS mad,
      round(stddev_samp(v) / abs(avg(v)), 7) AS cv, stddev_samp(v) / abs(avg(v)) < 0.01 AS near_constant FROM long JOIN m USING (feature) GROUP BY feature""",
    "described_features": f"""WITH {LONG}, m AS (SELECT l_returnflag, feature, median(v) AS m FROM long GROUP BY ALL)
      SELECT l_returnflag, feature, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(any_value(m), 5) AS median, round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.75), 5) AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 5) AS iqr, round(median(abs(v - m)), 5) AS mad, round(min(v), 5) AS min, round(max(v), 5) AS max,
      count(DISTINCT v) AS unique_values, round(stddev_samp(v) / abs(avg(v)), 5) AS cv_abs FROM long JOIN m USING (l_returnflag, feature) GROUP BY l_returnflag, feature""",
    "flagged_features": """SELECT 'max_intensity' AS feature, count(DISTINCT l_quantity) AS unique_values, 'extrema_or_saturation_sensitive' AS flags FROM lineitem UNION ALL SELECT 'edge_density', count(DISTINCT 0.1::DOUBLE + l_tax / 1000), 'definitionally_constrained' FROM lineitem
      UNION ALL SELECT 'entropy', count(DISTINCT l_linenumber % 3), 'near_constant' FROM lineitem UNION ALL SELECT 'sharpness', count(DISTINCT l_discount), '' FROM lineitem""",
    "pooled_and_group_stats": f"WITH {LONG} SELECT feature, l_returnflag, count(v) AS n, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std, round(min(v), 7) AS min, round(max(v), 7) AS max FROM long GROUP BY GROUPING SETS ((feature, l_returnflag), (feature))",
    "pearson_pairs": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, {_LEVEL.format(r=f'corr({a}, {b})')} AS level FROM lineitem" for a, b in PAIRS),
    "spearman_pairs": f"WITH {_RANKS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in PAIRS),
    "correlated_features": f"WITH x AS (SELECT {', '.join(F4)}, l_extendedprice * (1 - l_discount) AS net, round(100 * l_tax) * l_tax AS duty FROM lineitem), r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2 AS {f}" for f in _SIX) + " FROM x), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (SELECT corr({a}, {b}) FROM x) AS pearson, corr({a}, {b}) AS spearman FROM r" for k, a in enumerate(_SIX) for b in _SIX[k + 1 :])
    + "), q AS (SELECT *, greatest(abs(pearson), abs(spearman)) AS g FROM p) SELECT a, b, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(g, 6) AS strength, g >= 0.95 AS very_high FROM q WHERE g >= 0.9",
    "two_sample_tests": f"""WITH {LONG}, x AS (SELECT feature, count(v) FILTER (l_returnflag = 'A') AS na, count(v) FILTER (l_returnflag = 'N') AS nb, avg(v) FILTER (l_returnflag = 'A') AS ma, avg(v) FILTER (l_returnflag = 'N') AS mb, var_samp(v) FILTER (l_returnflag = 'A') AS va, var_samp(v) FILTER (l_returnflag = 'N') AS vb FROM long GROUP BY feature),
      c AS (SELECT DISTINCT feature, v, count(*) FILTER (l_returnflag = 'A') OVER w AS a, count(*) FILTER (l_returnflag = 'N') OVER w AS b FROM long WHERE l_returnflag IN ('A', 'N') WINDOW w AS (PARTITION BY feature ORDER BY v)),
      k AS (SELECT feature, max(abs(a / na - b / nb)) AS ks FROM c JOIN x USING (feature) GROUP BY feature), l AS (SELECT x.*, ks, (ma - mb) / sqrt((va + vb) / 2) AS smd, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d, sqrt(na * nb / (na + nb)) AS e FROM x JOIN k USING (feature)),
      q AS (SELECT feature, sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * ((e + 0.12 + 0.11 / e) * ks) ^ 2 * j * j)) AS p, any_value((e + 0.12 + 0.11 / e) * ks) AS lam FROM l CROSS JOIN range(1, 101) t(j) GROUP BY feature)
      SELECT feature, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(smd, 6) AS smd, round(d, 6) AS cohens_d, round(ks, 6) AS ks, round(CASE WHEN lam <= 0.2 THEN 1 ELSE greatest(0, least(1, p)) END, 6) AS ks_p, abs(smd) >= 0.5 OR ks >= 0.2 AS domain_sensitive,
        CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM l JOIN q USING (feature)""",
    "confusion_metrics": """WITH c AS (SELECT count(*) FILTER (n_chars < 600 AND quality = 0) AS tp, count(*) FILTER (n_chars < 600 AND quality <> 0) AS fp, count(*) FILTER (n_chars >= 600 AND quality <> 0) AS tn, count(*) FILTER (n_chars >= 600 AND quality = 0) AS fn FROM labels JOIN documents USING (doc_id)),
      r AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS tpr, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(tp / nullif(tp + fp, 0), 0) AS ppv, coalesce(tn / nullif(tn + fn, 0), 0) AS npv FROM c)
      SELECT tp, fp, tn, fn, round(tpr, 6) AS detection_rate, round(tpr, 6) AS sensitivity, round(fpr, 6) AS false_positive_rate, round(1 - fpr, 6) AS specificity, round(ppv, 6) AS precision, round(coalesce(2 * ppv * tpr / nullif(ppv + tpr, 0), 0), 6) AS f1, round(npv, 6) AS negative_predictive_value, round((tpr + 1 - fpr) / 2, 6) AS balanced_accuracy FROM r""",
    "wilson_intervals": f"""WITH g AS (SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1), p AS (SELECT *, hits / n AS p, {_Z} AS z FROM g)
      SELECT l_linestatus, n, hits, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM p""",
    "required_sequences": f"""WITH t(target, alarms) AS (VALUES (0.05::DOUBLE, 0), (0.05, 2), (0.01, 0), (0.2, 5)), x AS (SELECT target, alarms, CAST(n AS DOUBLE) AS n, alarms / n AS p, {_Z} AS z FROM t CROSS JOIN range(1, 5001) r(n) WHERE n >= greatest(1, alarms))
      SELECT round(target, 6) AS target, CAST(alarms AS BIGINT) AS alarms, CAST(min(n) AS BIGINT) AS n FROM x WHERE least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) <= target GROUP BY target, alarms""",
    "repeatability": f"""WITH {LONG}, a AS (SELECT feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM long GROUP BY feature), b AS (SELECT feature, l_returnflag, avg(v) AS m, stddev_samp(v) AS s FROM long GROUP BY ALL), c AS (SELECT feature, count(*) AS sessions, avg(s) AS w, max(m) - min(m) AS r FROM b GROUP BY feature)
      SELECT feature, n, round(mean, 5) AS mean, round(std, 5) AS std, round(std / greatest(abs(mean), 1e-8), 5) AS cv, sessions, round(w, 5) AS within_session_std, round(r, 5) AS between_session_range, round(r - 3 * w, 5) AS margin FROM a JOIN c USING (feature)""",
    "relevance": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{g}', {n}::BIGINT)" for n, (k, g) in enumerate(statistics.CANDIDATES.items())) + ") v(feature, engineering_group, place)",
    "lineage_roots": f"WITH RECURSIVE {ROOTS} SELECT id, root FROM roots",
    "lineage_partition": f"""WITH RECURSIVE {ROOTS}, g AS (SELECT root, count(*) AS n FROM roots GROUP BY root), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY CAST(root AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
      t AS (SELECT sum(n) AS held FROM b WHERE before < 100) SELECT root, n, CASE WHEN before < 100 THEN 'baseline' WHEN before < held + 50 THEN 'holdout' ELSE 'test' END AS part FROM b, t""",
    "lineage_leaks": f"WITH RECURSIVE {ROOTS} SELECT root FROM roots WHERE (id // 2) % 2 = 0 INTERSECT SELECT root FROM roots WHERE (id // 2) % 2 = 1",
    "positional_split": "WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS t, count(*) OVER () AS n FROM orders) SELECT CASE WHEN t < n // 2 THEN 'training' WHEN t < n // 2 + n // 4 THEN 'calibration' ELSE 'test' END AS part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM t GROUP BY 1",
    "audit_checks": "SELECT * FROM (VALUES ('acquisition_contract', true), ('unique_acquisition_ids', true), ('simulation_lineage', true)) v(\"check\", passed)",
    "exact_duplicates": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "source_counts": "SELECT source, count(*) AS files, count(*) - count(DISTINCT coalesce(text, '')) AS duplicates, count(DISTINCT coalesce(text, '')) AS contents FROM documents GROUP BY source",
    "near_hash_links": f"""WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents), x AS (SELECT doc_id, bit_xor(1::BIGINT << ((ascii(w) * 7 + length(w) * 13) % 63)) AS b FROM w WHERE w <> '' GROUP BY doc_id),
      h AS (SELECT documents.doc_id, coalesce(b, 0) AS b FROM documents LEFT JOIN x ON x.doc_id = documents.doc_id), c AS (SELECT b, min(doc_id) AS class FROM h GROUP BY b),
      l AS (SELECT x.class, count(*) AS links FROM c x JOIN c y ON x.class <> y.class AND bit_count(xor(x.b, y.b)) <= {NEAR_BITS} GROUP BY x.class) SELECT doc_id, c.class, coalesce(links, 0) AS links FROM h JOIN c USING (b) LEFT JOIN l ON l.class = c.class""",
    "missing_fields": " UNION ALL ".join(f"SELECT count(*) AS rows, '{c}' AS field, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS missing FROM documents" for c in ("text", "lang", "source")),
    "repeated_texts": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND trim(source) <> '' GROUP BY source HAVING count(*) > 1",
    "unlabelled": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "paired_orders": "WITH m AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS h, count(l_linenumber) AS masks, coalesce(bool_or(l_linenumber = o_orderkey % 7 + 1), false) AS matched FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber > 2) ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT masks = 0 AS missing, matched, count(*) AS images, CAST(sum(masks) AS BIGINT) AS masks FROM m GROUP BY 1, 2",
    "tagged_union": "SELECT 'customers' AS dataset, 'a' AS class, 'train' AS split, count(*) AS n FROM customer UNION ALL SELECT 'suppliers', 'b', 'test', count(*) FROM supplier",
    "csv_round_trip": "SELECT event_type AS dataset, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS bad, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS mean FROM events GROUP BY event_type",
    "metadata_round_trip": "SELECT CASE WHEN c_custkey % 3 <> 0 THEN 's' || c_nationkey END AS session_id, count(*) AS n, round(avg(c_acctbal), 6) AS gain, CAST(sum(c_custkey % 5) AS BIGINT) AS frames, '2024-01-02 03:04:05' AS last, 0::BIGINT AS focus FROM customer GROUP BY 1",
    "json_round_trip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS BIGINT) END AS r FROM nation",
    "run_summary": "WITH n AS (SELECT count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_totalprice, o_orderkey) AS q FROM orders) SELECT 'orders' AS project, n AS n_acquisitions, 'public' AS source, n // 2 AS baseline_size, n // 4 AS calibration_size, n - n // 2 - n // 4 AS test_size, s AS latest_state, round(q, 5) AS latest_quality, 'STABLE' AS latest_drift_status FROM n",
}
